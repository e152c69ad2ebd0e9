"""Rules to DataFrames (s, p, o, g): project, drop nulls, join, create terms."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..mapping.model import Rule
from ..sources import Relation, SourceCatalog
from .terms import compile_term, keeps_apart

COLUMNS = ("s", "p", "o", "g")


@dataclass(frozen=True)
class Options:
    base: str
    on_error: str = "fail"
    null_values: tuple[str, ...] = ("", "NULL")


def project(relation: Relation, names: Iterable[str], prefix: str, null_values: tuple[str, ...]) -> tuple[DataFrame, dict[str, str]]:
    """Referenced columns as text under fresh names, without rows in which any of them is null."""
    fresh = {n: f"{prefix}{i}" for i, n in enumerate(dict.fromkeys(names))}
    df = relation.select(fresh)
    for f in fresh.values():
        df = df.where(F.col(f).isNotNull() & ~F.col(f).isin(*null_values))
    return df, fresh


def compile_rule(rule: Rule, catalog: SourceCatalog, options: Options, *, distinct: bool = True) -> DataFrame:
    """All quads of a rule; distinct: each once (rows are made distinct instead where that says the same)."""
    if rule.constant():
        return _create(catalog.spark.range(1), rule, {}, {}, options)
    own = [n for t in (rule.subject, rule.predicate, *([] if rule.parent else [rule.object]), *([rule.graph] if rule.graph else [])) for n in t.references()]
    left, names = project(catalog.open(rule.source), [*own, *(c for c, _ in rule.joins)], "c", options.null_values)
    if rule.parent is None:
        rows_do = set(names) <= set().union(*(keeps_apart(t, options.base) for t in rule.terms()))
        if distinct and rows_do:
            return _create(left.distinct(), rule, names, names, options)
        out = _create(left, rule, names, names, options)
    else:
        right, others = project(catalog.open(rule.parent), [*rule.object.references(), *(p for _, p in rule.joins)], "p", options.null_values)
        if rule.parent == rule.source:  # keys of a self join may repeat on both sides: keep its fan-out small
            left, right = left.distinct(), right.distinct()
        on = [F.col(names[c]) == F.col(others[p]) for c, p in rule.joins]
        out = _create(left.join(right, on, "inner"), rule, names, others, options)
    return out.distinct() if distinct else out


def _own(rule: Rule) -> list[str]:
    return list(dict.fromkeys(n for t in rule.terms() for n in t.references()))


def shares_scan(rule: Rule, options: Options) -> bool:
    """Can the rule be made distinct on its rows, beside others of its source?"""
    if rule.parent is not None or rule.constant() or any(t.kind == "function" for t in rule.terms()):
        return False
    return set(_own(rule)) <= set().union(*(keeps_apart(t, options.base) for t in rule.terms()))


def compile_together(rules: list[Rule], catalog: SourceCatalog, options: Options) -> DataFrame:
    """All quads of rules of one source, each once: one scan, one exchange of (rule, values), whatever the number of rules."""
    names = list(dict.fromkeys(n for r in rules for n in _own(r)))
    fresh = {n: f"c{i}" for i, n in enumerate(names)}
    df = catalog.open(rules[0].source).select(fresh)
    wide = max(len(_own(r)) for r in rules)
    made = []
    for i, r in enumerate(rules):
        cols = [F.col(fresh[n]) for n in _own(r)]
        full = reduce(Column.__and__, [c.isNotNull() & ~c.isin(*options.null_values) for c in cols])
        values = [c.alias(f"v{k}") for k, c in enumerate(cols)] + [F.lit(None).cast("string").alias(f"v{k}") for k in range(len(cols), wide)]
        made.append(F.when(full, F.struct(F.lit(i).alias("rule"), *values)))
    rows = df.select(F.inline(F.array_compact(F.array(*made)))).distinct()
    out = []
    for k, name in enumerate(COLUMNS):
        terms = [(r.subject, r.predicate, r.object, r.graph)[k] for r in rules]
        places = [{n: f"v{j}" for j, n in enumerate(_own(r))} for r in rules]
        seen: dict[tuple, tuple[Column, list[int]]] = {}
        for i, (t, at) in enumerate(zip(terms, places, strict=True)):
            key = (t, tuple(at[n] for n in t.references()) if t else ())
            if key not in seen:
                seen[key] = (compile_term(t, lambda n, at=at: F.col(at[n]), options.base)[0] if t else F.lit(None).cast("string"), [])
            seen[key][1].append(i)
        *some, (last, _) = seen.values()
        out.append(reduce(lambda rest, x: F.when(F.col("rule").isin(*x[1]), x[0]).otherwise(rest), some, last).alias(name))
    return rows.select(*out)


def _create(df: DataFrame, rule: Rule, own: dict[str, str], other: dict[str, str], options: Options) -> DataFrame:
    def value_of(names: dict[str, str]):
        return lambda n: F.col(names[n])

    made: list[tuple[str, Column]] = []
    bad: list[Column] = []
    for name, term, names in (("s", rule.subject, own), ("p", rule.predicate, own), ("o", rule.object, other), ("g", rule.graph, own)):
        if term is None:
            made.append((name, F.lit(None).cast("string")))
            continue
        col, invalid = compile_term(term, value_of(names), options.base)
        if invalid is not None and options.on_error == "skip":
            bad.append(invalid)
        elif invalid is not None:
            col = F.when(invalid, F.raise_error(F.concat(F.lit("invalid IRI: "), col)).cast("string")).otherwise(col)
        made.append((name, col))
    for b in bad:
        df = df.where(~b)
    return df.select(*[c.alias(n) for n, c in made])


def empty(spark: SparkSession) -> DataFrame:
    return spark.range(0).select(*[F.lit(None).cast("string").alias(c) for c in COLUMNS])
