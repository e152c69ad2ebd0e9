"""Mappings over streams: the same rules on streaming sources."""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..api import make_plan
from ..mapping.model import UnsupportedMapping
from ..operators.rules import Options, compile_rule
from ..sources import SourceCatalog


def materialize_stream(spark: SparkSession, mapping: str, sources: Mapping[str, DataFrame], *, base_iri: str | None = None, watermark: str | None = None, on_error: str = "skip") -> DataFrame:
    """s, p, o, g as a stream. Joins may go from a stream to a static table.

    watermark: quads seen within that time (by arrival) come once, with the
    arrival as ``at``; without it every row's quads come, repeats too.
    """
    plan = make_plan(mapping, base_iri)
    options = Options(plan.base, on_error)
    catalog = SourceCatalog(spark, sources)
    for rule in plan.rules():
        if rule.parent is not None and rule.parent in (rule.source,):
            raise UnsupportedMapping("a stream can't be joined with itself")
    quads = reduce(DataFrame.unionByName, [compile_rule(r, catalog, options, distinct=False) for r in plan.rules()])
    if watermark is None:
        return quads
    stamped = quads.withColumn("at", F.current_timestamp()).withWatermark("at", watermark)
    return stamped.dropDuplicatesWithinWatermark(["s", "p", "o", "g"])
