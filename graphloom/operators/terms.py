"""Term maps to Columns in N-Triples form."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.registry import call_function
from ..functions.text import INVALID_IRI, blank_label, invalid_iri, percent_encode
from ..mapping.model import MappingError, TermMap
from ..mapping.template import Ref, parse_template

ABSOLUTE = ("http://", "https://")


def literal_suffix(term: TermMap) -> str:
    """A datatype goes before a language."""
    return f"^^<{term.datatype}>" if term.datatype else f"@{term.lang}" if term.lang else ""


def fold_constant(term: TermMap) -> str | None:
    """The whole term, where it is known before any row is read. Constants are never resolved against the base."""
    if term.kind != "constant":
        return None
    if term.term_type == "iri":
        return f"<{term.value}>"
    if term.term_type == "bnode":
        return f"_:{term.value}"
    return f'"{term.value}"{literal_suffix(term)}'


def segments(term: TermMap, base: str) -> list[str | Ref]:
    """Template with the base in front where its first literal segment shows that it is relative."""
    parts = parse_template(term.value)
    if term.term_type == "iri" and parts and isinstance(parts[0], str) and not _undecided(parts):
        if not parts[0].startswith(ABSOLUTE):
            parts[0] = base + parts[0]
    elif term.term_type == "iri" and not parts:
        return [base]
    return parts


def _undecided(parts: list[str | Ref]) -> bool:
    """Can only a row's values tell whether the IRI is absolute?"""
    if isinstance(parts[0], Ref):
        return True
    return len(parts) > 1 and any(a.startswith(parts[0]) and a != parts[0] for a in ABSOLUTE)


def fixed_prefix(term: TermMap, base: str) -> str:
    """Text that every value of the term starts with."""
    if (whole := fold_constant(term)) is not None:
        return whole
    mark = {"iri": "<", "bnode": "_:", "literal": '"'}[term.term_type]
    if term.kind != "template" or term.term_type == "bnode":
        return mark
    parts = segments(term, base)
    if term.term_type == "iri" and _undecided(parse_template(term.value) or [""]):
        return mark
    return mark + (parts[0] if parts and isinstance(parts[0], str) else "")


def compile_term(term: TermMap, value_of: Callable[[str], Column], base: str) -> tuple[Column, Column | None]:
    """The term, and a condition under which it is invalid (None: never)."""
    if (whole := fold_constant(term)) is not None:
        return F.lit(whole), None
    check = False
    if term.kind == "function":
        value = call_function(term.value, {name: _raw(t, value_of) for name, t in term.inputs})
    elif term.kind == "reference":
        value, check = value_of(term.value), True
    else:
        iri = term.term_type == "iri"
        parts = segments(term, base)
        if iri and any(c in s for s in parts if isinstance(s, str) for c in INVALID_IRI):
            raise MappingError(f"template {term.value!r} can't give a valid IRI")
        cols = [F.lit(s) if isinstance(s, str) else percent_encode(value_of(s.name)) if iri else value_of(s.name) for s in parts]
        value = F.concat(*cols) if len(cols) > 1 else cols[0] if cols else F.lit("")
    if term.term_type == "bnode":
        return F.concat(F.lit("_:"), blank_label(value)), None
    if term.term_type == "literal":
        return F.concat(F.lit('"'), value, F.lit(f'"{literal_suffix(term)}')), None
    if term.kind != "template" or _undecided(parse_template(term.value) or [""]):
        value = F.when(value.startswith(ABSOLUTE[0]) | value.startswith(ABSOLUTE[1]), value).otherwise(F.concat(F.lit(base), value))
    return F.concat(F.lit("<"), value, F.lit(">")), invalid_iri(value) if check or term.kind == "function" else None


def _raw(term: TermMap, value_of: Callable[[str], Column]) -> Column:
    """A value before it becomes a term, as functions get it."""
    if term.kind == "constant":
        return F.lit(term.value)
    if term.kind == "reference":
        return value_of(term.value)
    if term.kind == "function":
        return call_function(term.value, {name: _raw(t, value_of) for name, t in term.inputs})
    return F.concat(*[F.lit(s) if isinstance(s, str) else value_of(s.name) for s in parse_template(term.value)], F.lit(""))


def keeps_apart(term: TermMap, base: str) -> set[str]:
    """References whose values can be read off the term, so that different values give different terms."""
    if term.kind == "reference":
        return {term.value} if term.term_type == "literal" else set()
    if term.kind != "template" or term.term_type == "bnode":
        return set()
    parts = parse_template(term.value)
    refs = [s.name for s in parts if isinstance(s, Ref)]
    if term.term_type == "literal":
        return set(refs) if len(refs) == 1 else set()
    if not parts or _undecided(parts):
        return set()
    # between two encoded values stands a character that encoding removes from them
    for a, mid, b in zip(parts, parts[1:], parts[2:], strict=False):
        if isinstance(a, Ref) and isinstance(b, Ref) and not (isinstance(mid, str) and any(c in "/:#?&=+;@" for c in mid)):
            return set()
    if any(isinstance(a, Ref) and isinstance(b, Ref) for a, b in zip(parts, parts[1:], strict=False)):
        return set()
    return set(refs)
