"""Rules to groups whose outputs can't overlap; a group is made distinct by itself.

Two rules are disjoint if at one position their fixed prefixes exclude each
other, both are constants and differ, or their literals' suffixes differ. Groups
are the connected components of what isn't provably disjoint. Rules that are
groups of their own and read one source that has to be parsed share its scan.
"""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass
from functools import reduce

from pyspark.sql import DataFrame

from ..mapping.model import LogicalSource, MappingError, Rule, TermMap
from ..operators.rules import Options, compile_rule, compile_together, empty, shares_scan
from ..operators.terms import fixed_prefix, fold_constant, literal_suffix
from ..sources import SourceCatalog


def _apart(a: TermMap | None, b: TermMap | None, base: str) -> bool:
    if a is None or b is None:
        return (a is None) != (b is None)
    x, y = fold_constant(a), fold_constant(b)
    if x is not None and y is not None:
        return x != y
    if a.term_type != b.term_type:
        return True
    if a.term_type == "literal" and literal_suffix(a) != literal_suffix(b):
        return True
    p, q = fixed_prefix(a, base), fixed_prefix(b, base)
    if x is not None or y is not None:  # a constant must have the other's prefix
        return not (x.startswith(q) if x is not None else y.startswith(p))
    return not (p.startswith(q) or q.startswith(p))


def disjoint(a: Rule, b: Rule, base: str) -> bool:
    return any(_apart(x, y, base) for x, y in ((a.subject, b.subject), (a.predicate, b.predicate), (a.object, b.object), (a.graph, b.graph)))


@dataclass
class Plan:
    """Rules by group, and the base IRI for relative ones."""

    groups: list[list[Rule]]
    base: str

    @classmethod
    def of(cls, rules: list[Rule], base: str) -> Plan:
        groups: list[list[Rule]] = []
        for rule in rules:
            touching = [g for g in groups if any(not disjoint(rule, r, base) for r in g)]
            merged = [r for g in touching for r in g] + [rule]
            groups = [g for g in groups if not any(g is t for t in touching)] + [merged]
        return cls(groups, base)

    def rules(self) -> list[Rule]:
        return [r for g in self.groups for r in g]

    def compile(self, catalog: SourceCatalog, options: Options, *, dedup: bool = True) -> DataFrame:
        """s, p, o, g of all rules: a set, unless dedup is off."""
        parts = []
        alone: dict[LogicalSource, list[Rule]] = {}
        for group in self.groups if dedup else []:
            if len(group) == 1 and catalog.open(group[0].source).parsed and shares_scan(group[0], options):
                alone.setdefault(group[0].source, []).append(group[0])
        together = [rules for rules in alone.values() if len(rules) > 1]
        parts += [compile_together(rules, catalog, options) for rules in together]
        for group in self.groups:
            if any(group[0] in rules for rules in together):
                continue
            if len(group) == 1 or not dedup:
                parts += [compile_rule(r, catalog, options, distinct=dedup) for r in group]
            else:
                parts.append(reduce(DataFrame.unionByName, [compile_rule(r, catalog, options, distinct=False) for r in group]).distinct())
        return reduce(DataFrame.unionByName, parts) if parts else empty(catalog.spark)

    def to_json(self) -> str:
        return json.dumps({"base": self.base, "groups": [[asdict(r) for r in g] for g in self.groups]}, ensure_ascii=False, indent=1)

    @classmethod
    def from_json(cls, text: str) -> Plan:
        try:
            data = json.loads(text)
            return cls([[_rule(r) for r in g] for g in data["groups"]], data["base"])
        except (ValueError, KeyError, TypeError) as e:
            raise MappingError(f"this isn't a plan: {e}") from None


def _rule(d: dict) -> Rule:
    source = lambda x: LogicalSource(**x) if x else None
    term = lambda x: TermMap(**{**x, "inputs": tuple((n, term(t)) for n, t in x.get("inputs", ()))}) if x else None
    return Rule(source(d["source"]), term(d["subject"]), term(d["predicate"]), term(d["object"]), term(d["graph"]), source(d["parent"]), tuple(map(tuple, d["joins"])))
