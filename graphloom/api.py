"""The library's entry points."""

from __future__ import annotations

import os
from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession

from .mapping.build import read_mapping
from .mapping.model import MappingError
from .operators.rules import Options
from .plans.planner import Plan
from .sinks import to_string
from .sources import SourceCatalog

BASE_IRI = "http://example.com/base/"


def load_mapping(mapping: str) -> str:
    """Turtle text as it is, or that of the file so named."""
    if "\n" not in mapping and len(mapping) < 4096 and os.path.isfile(mapping):
        with open(mapping, encoding="utf-8") as f:
            return f.read()
    return mapping


def make_plan(mapping: str, base_iri: str | None = None) -> Plan:
    """base_iri goes before a base that the mapping states, and that before the default."""
    rules, stated = read_mapping(load_mapping(mapping), base_iri)
    return Plan.of(rules, base_iri or stated or BASE_IRI)


def execute_plan(
    spark: SparkSession, plan: Plan | str, *, sources: Mapping[str, DataFrame | str] | None = None, base_dir: str = "",
    on_error: str = "fail", dedup: bool = True, csv_compat: bool = False, null_values: tuple[str, ...] = ("", "NULL"),
) -> DataFrame:
    """s, p, o, g of a plan or its JSON; g is null in the default graph."""
    if on_error not in ("fail", "skip"):
        raise ValueError("on_error must be fail or skip")
    plan = Plan.from_json(plan) if isinstance(plan, str) else plan
    catalog = SourceCatalog(spark, sources or {}, base_dir, csv_compat)
    return plan.compile(catalog, Options(plan.base, on_error, tuple(null_values)), dedup=dedup)


def materialize(spark: SparkSession, mapping: str, *, base_iri: str | None = None, **options) -> DataFrame:
    """s, p, o, g of a mapping (Turtle text or a file's name); options as for execute_plan."""
    return execute_plan(spark, make_plan(mapping, base_iri), **options)


def execute(mapping_source: str | None = None, plan: str | None = None, base_uri: str | None = None, generate_plan: bool = False, use_threading: bool = True, data: Mapping[str, str] | None = None) -> str:
    """N-Triples as one text, or the plan's JSON. use_threading is accepted; Spark schedules by itself."""
    if mapping_source is None and plan is None:
        raise MappingError("either a mapping or a plan is needed")
    made = Plan.from_json(plan) if plan is not None else make_plan(mapping_source, base_uri)
    if generate_plan:
        return made.to_json()
    return to_string(execute_plan(SparkSession.builder.getOrCreate(), made, sources=data))
