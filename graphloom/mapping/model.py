"""What a mapping says, after normalization: rules over logical sources."""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from .template import Ref, parse_template


class MappingError(ValueError):
    """A mapping that can't be right."""


class UnsupportedMapping(MappingError):
    """A mapping outside the supported part of the language."""


@dataclass(frozen=True)
class LogicalSource:
    path: str
    iterator: str | None = None


@dataclass(frozen=True)
class TermMap:
    """kind: template, reference, constant or function; term_type: iri, bnode or literal; inputs: a function's parameters and their values."""

    kind: str
    value: str
    term_type: str
    lang: str | None = None
    datatype: str | None = None
    inputs: tuple[tuple[str, TermMap], ...] = ()

    def references(self) -> list[str]:
        if self.kind == "reference":
            return [self.value]
        if self.kind == "template":
            return [s.name for s in parse_template(self.value) if isinstance(s, Ref)]
        return [n for _, t in self.inputs for n in t.references()]

    def retyped(self, term_type: str) -> TermMap:
        return replace(self, term_type=term_type)


@dataclass(frozen=True)
class Rule:
    """One predicate, object and graph of a triples map. parent: the source the object comes from by a join."""

    source: LogicalSource
    subject: TermMap
    predicate: TermMap
    object: TermMap
    graph: TermMap | None = None
    parent: LogicalSource | None = None
    joins: tuple[tuple[str, str], ...] = field(default=())

    def terms(self) -> list[TermMap]:
        return [t for t in (self.subject, self.predicate, self.object, self.graph) if t is not None]

    def constant(self) -> bool:
        return self.parent is None and all(t.kind in ("constant", "function") and not t.references() for t in self.terms())
