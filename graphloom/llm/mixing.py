"""Mixing sources to target weights by weighted fair queueing.

Each source gets a target: its weight's share of the total size, at most
``repeats`` times what it has; the excess is shared again by weight. Documents
of a source are shuffled by a hash of their id, once for each repeat. A copy's
virtual finish time is the source's cumulative size up to the copy's middle,
divided by the source's target. The copies of all sources, sorted by finish
time, are truncated at the total budget: a time is in if the copies of earlier
times and half of its own fit. All sources reach their targets at time 1, and
the targets add up to the budget, so the cut lies at about 1.

Cumulative sums are taken in two steps: within slices (of the hash by source, of
the time over all sources) and over the slices' sums. Slices of the hash grow in
number with the rows; the cut is narrowed to a slice of times, then to a slice of
that, so no task sorts more than its slice. The mix itself is sorted by range
over all sources. Only DataFrame operations.

Defined results: null text has size 0; null source is a source of its own, last
in order; rows of size 0 take part with taken 0. Repeated rows count one by one;
rows of one id share a slice. A very long text is one document of its size. An
empty table gives no rows. Columns are found by place, so others may have any
names, dots included. Ties in time are in or out together.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, drop_scratch, numbered, scratch_table

#: Rows of a slice of the hash, about; slices of time looked at at once.
SLICE_ROWS, TIME_SLICES = 1 << 16, 4096
WEIGHTS = (5, 2, 1)
REPEATS = 3
SEED = "mix"


def text_size(col: Column) -> Column:
    """Number of words; 0 for null."""
    return F.coalesce(F.regexp_count(col.cast("string"), F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, repeats: int = REPEATS) -> DataFrame:
    """source, source_size, target from rows (source, size): one row a source.

    A source is capped if its share of what sources of smaller size for their
    weight leave over would be more than repeats times its size.
    """
    total = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.pmod(rank, F.lit(len(weights))) + 1).cast("int"))
    w = total.withColumn("rank", rank).withColumn("weight", weight.cast("long"))
    order = Window.orderBy(F.col("source_size") / F.col("weight"), "rank")
    every = Window.partitionBy()
    w = w.withColumns({
        "budget": F.sum("source_size").over(every), "all_weight": F.sum("weight").over(every),
        "cap_before": F.coalesce(F.sum(repeats * F.col("source_size")).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)),
        "weight_before": F.coalesce(F.sum("weight").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)),
    })
    level = (F.col("budget") - F.col("cap_before")).cast("double") / (F.col("all_weight") - F.col("weight_before")).cast("double")
    w = w.withColumn("capped", level * F.col("weight") >= (repeats * F.col("source_size")).cast("double"))
    first = F.min_by(F.when(~F.col("capped"), level), F.when(~F.col("capped"), F.col("weight_before"))).over(every)
    target = F.when(F.col("capped"), (repeats * F.col("source_size")).cast("double")).otherwise(F.col("weight").cast("double") * first)
    return w.withColumn("target", target).select("source", "source_size", "target")


def _sized(docs: DataFrame, id_col: str, text_col: str, source_col: str, seed: str) -> tuple[DataFrame, DataFrame]:
    """doc_id, source, size, hash and the columns c0, c1, ... of docs; the first four as a table of its own, written once."""
    d = numbered(docs)
    own = {name: F.col(f"c{docs.columns.index(name)}") for name in (id_col, text_col, source_col)}
    key = F.md5(F.concat_ws("/", F.lit(seed), own[id_col].cast("string")))
    rows = d.select("*", own[id_col].alias("doc_id"), own[source_col].alias("source"), text_size(own[text_col]).alias("size"), key.alias("hash"))
    return rows, scratch_table(rows.select("doc_id", "source", "size", "hash"), "sizes")


def schedule(sizes: DataFrame, rows: DataFrame | None = None, *, weights: tuple[int, ...] = WEIGHTS, repeats: int = REPEATS) -> DataFrame:
    """rows (or sizes: doc_id, source, size, hash) with source_size, target, before (size of the source's documents ahead)."""
    digits = max(3, math.ceil(math.log(max(sizes.count(), 1) / SLICE_ROWS, 16)))
    name = F.concat(F.substring("hash", 1, digits), F.when(F.col("source").isNull(), F.lit("-")).otherwise(F.concat(F.lit("+"), "source")))
    part = sizes.select(name.alias("slice"), "source", "size")
    sums = part.groupBy("slice", "source").agg(F.sum("size").alias("slice_size"))
    offset = F.sum("slice_size").over(Window.partitionBy("source").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1))
    targets = source_targets(part, weights, repeats)
    sums = sums.withColumn("offset", F.coalesce(offset, F.lit(0))).join(targets.withColumnRenamed("source", "__s"), F.col("source").eqNullSafe(F.col("__s")))
    within = Window.partitionBy("slice").orderBy("hash", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    rows = (sizes if rows is None else rows).withColumn("slice", name).withColumn("ahead", F.coalesce(F.sum("size").over(within), F.lit(0)))
    out = rows.join(sums.select("slice", "offset", "source_size", "target"), "slice")
    return out.withColumn("before", F.col("offset") + F.col("ahead")).drop("slice", "ahead", "offset")


def finish_time(copy: Column) -> Column:
    """Virtual finish time of a row's copy (from 0), at its middle; none for what has no size."""
    middle = copy.cast("double") * F.col("source_size") + F.col("before") + F.col("size") / 2.0
    return F.when((F.col("target") > 0) & (F.col("size") > 0), middle / F.col("target"))


def finish_times(repeats: int) -> Column:
    return F.filter(F.array(*[finish_time(F.lit(e)) for e in range(repeats)]), lambda t: t.isNotNull())


def budget_cut(copies: DataFrame, budget: int) -> float:
    """The last finish time that is in, from rows (time, size) of all copies; below every time where there is none.

    Times are sorted into slices, the slice that spends the budget into slices
    again, until one time is left: TIME_SLICES sums reach the driver at once.
    """
    spread = copies.select("time", "size", (F.col("time") / (F.col("time") + 1)).alias("at"))
    low, high, spent, cut = 0.0, 1.0, 0, -1.0
    while True:
        place = F.least(F.floor((F.col("at") - low) / (high - low) * TIME_SLICES), F.lit(TIME_SLICES - 1))
        sums = spread.where((F.col("at") >= low) & (F.col("at") <= high)).groupBy(place.alias("k")).agg(
            F.sum("size").alias("size"), F.min("time").alias("first"), F.max("time").alias("last"), F.min("at").alias("low"), F.max("at").alias("high")
        )
        for s in sorted(sums.collect(), key=lambda s: s["k"]):
            if s["low"] == s["high"]:  # one time, or times that no slicing tells apart
                if spent + s["size"] / 2 > budget:
                    return cut
            elif spent + s["size"] > budget:
                low, high = s["low"], s["high"]
                break
            spent, cut = spent + s["size"], s["last"]
        else:
            return cut


def _scheduled(sizes: DataFrame, repeats: int, weights: tuple[int, ...], rows: DataFrame | None = None) -> tuple[DataFrame, float]:
    """The schedule with each row's finish times, and the last time that is in."""
    times = scratch_table(schedule(sizes, weights=weights, repeats=repeats).withColumn("times", finish_times(repeats)), "times")
    budget = sizes.agg(F.sum("size")).first()[0] or 0
    cut = budget_cut(times.select("size", F.explode("times").alias("time")), budget)
    if rows is None:
        return times, cut
    drop_scratch(times)
    return schedule(sizes, rows, weights=weights, repeats=repeats).withColumn("times", finish_times(repeats)), cut


def taken(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = WEIGHTS, repeats: int = REPEATS, seed: str = SEED) -> DataFrame:
    """doc_id, source, size, source_size, target, copies, taken of every row."""
    _, sizes = _sized(docs, id_col, text_col, source_col, seed)
    s, cut = _scheduled(sizes, repeats, weights)
    copies = F.size(F.filter("times", lambda t: t <= cut))
    return s.withColumn("copies", copies).select("doc_id", "source", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).cast("long").alias("taken"))


def mix(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = WEIGHTS, repeats: int = REPEATS, seed: str = SEED) -> DataFrame:
    """The mix itself: rows of docs, repeated as taken, in the order of their finish times over all sources."""
    rows, sizes = _sized(docs, id_col, text_col, source_col, seed)
    s, cut = _scheduled(sizes, repeats, weights, rows)
    out = s.withColumn("time", F.explode(F.filter("times", lambda t: t <= cut))).orderBy("time")
    return out.select(*[f"c{i}" for i in range(len(docs.columns))]).toDF(*docs.columns)


#: The same in DuckDB's SQL, for documents.
SQL = """
WITH d AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS BIGINT) AS size, md5('mix/' || CAST(doc_id AS VARCHAR)) AS h FROM documents),
t AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source ASC NULLS LAST) - 1 AS r FROM d GROUP BY source),
w AS (SELECT *, CASE r % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS weight FROM t),
c AS (
  SELECT *, sum(source_size) OVER () AS budget, sum(weight) OVER () AS all_weight,
    coalesce(sum(3 * source_size) OVER o, 0) AS cap_before, coalesce(sum(weight) OVER o, 0) AS weight_before
  FROM w WINDOW o AS (ORDER BY CAST(source_size AS DOUBLE) / weight, r ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
l AS (SELECT *, CAST(budget - cap_before AS DOUBLE) / CAST(all_weight - weight_before AS DOUBLE) AS level FROM c),
k AS (SELECT *, level * weight >= CAST(3 * source_size AS DOUBLE) AS capped FROM l),
g AS (
  SELECT source, source_size, CASE WHEN capped THEN CAST(3 * source_size AS DOUBLE)
    ELSE CAST(weight AS DOUBLE) * (SELECT level FROM k WHERE NOT capped ORDER BY weight_before LIMIT 1) END AS target FROM k),
b AS (
  SELECT d.doc_id, d.size, g.source_size, g.target,
    coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.h, d.doc_id, d.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM d JOIN g ON d.source IS NOT DISTINCT FROM g.source),
f AS (
  SELECT row_number() OVER () AS k, doc_id, size, source_size, target, CASE WHEN target > 0 AND size > 0 THEN [
    (before + size / 2.0::DOUBLE) / target, (1.0::DOUBLE * source_size + before + size / 2.0::DOUBLE) / target,
    (2.0::DOUBLE * source_size + before + size / 2.0::DOUBLE) / target] ELSE [] END AS times FROM b),
e AS (SELECT time, sum(size) AS size FROM (SELECT size, unnest(times) AS time FROM f) GROUP BY time),
r AS (SELECT time, coalesce(sum(size) OVER (ORDER BY time ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + size / 2.0::DOUBLE AS spent FROM e),
x AS (SELECT coalesce(max(time), -1) AS cut FROM r WHERE spent <= (SELECT sum(size) FROM d))
SELECT doc_id, size, source_size, target, CAST(size * coalesce(CAST(times[1] <= cut AS INT) + CAST(times[2] <= cut AS INT) + CAST(times[3] <= cut AS INT), 0) AS BIGINT) AS taken FROM f, x
"""
