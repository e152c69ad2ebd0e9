"""Nearest neighbours by inner product: multiprobe p-stable hashing, exact reranking.

Inner products become distances by one more coordinate, sqrt(M^2 - |x|^2) for
rows (M the greatest norm) and 0 for queries. Each of ``TABLES`` tables hashes a
vector to k values floor((a.x + b) / w) with Gaussian a: its bucket. A query
visits the buckets of its perturbed hash values in the order of estimated
success: least sum of squared distances from the query's projections to the
bucket's sides. Candidates of all tables are scored by matrix products on the
original vectors in double precision. The number of probes is fitted on a
bounded sample of queries (``SAMPLE``), for which the true neighbours are found
by a full scan: the least number at which ``TARGET`` of them lie in probed
buckets. Where ``MOST_PROBES`` a table do not reach it, k falls until they do;
where no k does, every query is compared with all rows.

Buckets that agree in their first hash values form a group of about ``GROUP``
rows. A query goes to a group once, with the list of its buckets there, and
leaves it with its best rows only. The groups of the query's own hash values
come first; the worst score they give is the least that rows of other groups
must reach. So what leaves the groups is in proportion to the queries, whatever
the number of probes. Groups of too many rows or queries are cut into blocks.

Equal vectors are indexed once, with their least ids (as many as can appear in a
result). Queries for which too few are found are compared with all rows, in
blocks.

Defined results: rows of null id or of a vector that is null, empty, zero or
holds a null or non-finite component take no part. Vectors of different lengths
have no inner product and are never each other's neighbours. Rows that repeat an
id and vector count once, and rows of the query's id are never its neighbours.
Ties go to the smaller id. An empty table gives no rows. Other columns, whatever
their names, are ignored; so are texts.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import map_arrow, mix64, scratch_table

TABLES, SAMPLE, TARGET, OCCUPANCY, REACH = 3, 64, 0.965, 400, 3
MOST_PROBES = 4096
#: Rows of a group, on average; numbers of a block of rows, and queries of a block.
GROUP, ROW_NUMBERS, QUERY_BLOCK = 16_384, 1 << 21, 4096
SEED = 7
_GOLD = np.uint64(0x9E3779B97F4A7C15)


class Hashes:
    """k hash values of TABLES tables; the first ``lead`` of them name a group."""

    def __init__(self, rows: int, norm: float, spread: float, k: int | None = None):
        self.norm = norm
        self.k = k or max(1, min(24, round(math.log(max(rows / OCCUPANCY, 2)) / math.log(3))))
        self.lead = max(0, min(self.k - 1, math.ceil(math.log(max(rows / GROUP, 1)) / math.log(3))))
        self.width = 1.35 * spread  # about three cells hold most of a projection's spread
        self.drawn: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def project(self, x: np.ndarray, query: bool) -> np.ndarray:
        """rows x TABLES x k, in cells."""
        dim = x.shape[1]
        if dim not in self.drawn:
            rng = np.random.default_rng([SEED, dim])
            self.drawn[dim] = rng.standard_normal((TABLES, self.k, dim + 1)), rng.uniform(0, self.width, (TABLES, self.k))
        a, b = self.drawn[dim]
        more = np.zeros(len(x)) if query else np.sqrt(np.maximum(self.norm**2 - (x**2).sum(1), 0))
        return (np.tensordot(np.concatenate([x, more[:, None]], axis=1), a, axes=(1, 2)) + b) / self.width

    def keys(self, cells: np.ndarray, dim: int) -> tuple[np.ndarray, np.ndarray]:
        """One number for the group and one for the bucket of each vector of k cells (last axis; TABLES along the second)."""
        table = np.arange(TABLES, dtype=np.uint64).reshape(-1, *[1] * (cells.ndim - 3))
        out = np.broadcast_to(mix64(table + np.uint64(TABLES * dim)), cells.shape[:-1])
        group = out
        for i in range(self.k):
            if i == self.lead:
                group = out
            out = mix64(out * _GOLD + cells[..., i].astype(np.int64).view(np.uint64))
        return group.astype(np.uint64).view(np.int64), out.view(np.int64)

    def probes(self, x: np.ndarray, count: int) -> np.ndarray:
        """Cells of the first count probes of each query and table: rows x TABLES x (count or fewer) x k."""
        p = self.project(x, True)
        home = np.floor(p)
        at = p - home
        cost = np.zeros((*p.shape[:2], 1))
        cells = np.zeros((*p.shape[:2], 1, 0))
        steps = np.arange(-REACH, REACH + 1)
        for i in range(self.k):  # sums of the first i costs: only the count least can lead to one of the count least
            f = at[:, :, i, None]
            far = np.where(steps < 0, f - steps - 1, np.where(steps > 0, steps - f, 0.0)) ** 2
            all_cost = (cost[..., :, None] + far[..., None, :]).reshape(*p.shape[:2], -1)
            step = home[:, :, i, None] + steps
            old = np.repeat(cells, len(steps), axis=2)
            new = np.tile(step, (1, 1, cells.shape[2]))[..., None]
            cells = np.concatenate([old, new], axis=3)
            order = np.argsort(all_cost, axis=2, kind="stable")[:, :, :count]
            cost = np.take_along_axis(all_cost, order, axis=2)
            cells = np.take_along_axis(cells, order[..., None], axis=2)
        return cells


def _matrix(col: pa.Array, dim: int) -> np.ndarray:
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    return col.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)


def _by_length(batch: pa.RecordBatch, at: int):
    """(rows of the batch, their vectors as a matrix) for each length of the vectors in column at."""
    length = batch.column(at).value_lengths().to_numpy(zero_copy_only=False)
    for dim in np.unique(length):
        part = batch if (length == dim).all() else batch.take(pa.array(np.flatnonzero(length == dim)))
        yield part, _matrix(part.column(at), int(dim))


def _valid(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """vec_id, v (array of floats if they are given as such, else of doubles), k1, k2 of the rows that take part."""
    kind = vectors.select(vector_col).schema[0].dataType
    as_float = isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.FloatType)
    v = vectors.select(F.col(id_col).alias("vec_id"), F.col(vector_col).cast(f"array<{'float' if as_float else 'double'}>").alias("v")).where(F.col("vec_id").isNotNull() & F.col("v").isNotNull())
    v = v.where(F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0.0))
    return v.select("vec_id", "v", F.xxhash64("v").alias("k1"), F.hash("v", F.lit(1)).alias("k2"))


def _distinct(valid: DataFrame, most: int) -> DataFrame:
    """row (least id), ids (the most least ones), v of each different vector."""
    one = valid.groupBy("k1", "k2", "vec_id").agg(F.first("v").alias("v"))
    rank = F.row_number().over(Window.partitionBy("k1", "k2").orderBy("vec_id"))
    few = one.withColumn("n", rank).where(F.col("n") <= most)
    return few.groupBy("k1", "k2").agg(F.sort_array(F.collect_list("vec_id")).alias("ids"), F.first("v").alias("v")).select(F.col("ids")[0].alias("row"), "ids", "v")


def _best(scores: np.ndarray, rows: np.ndarray, most: int) -> list[np.ndarray]:
    """Columns of the most best scores of each line, ties to the smaller row; all ties at the edge are looked at."""
    out = []
    for line in scores:
        if len(line) > most:
            edge = np.partition(line, len(line) - most)[len(line) - most]
            pick = np.flatnonzero(line >= edge)
        else:
            pick = np.arange(len(line))
        out.append(pick[np.lexsort((rows[pick], -line[pick]))][:most])
    return out


def compare_block(x: np.ndarray, rows: np.ndarray, bucket: np.ndarray, y: np.ndarray, least: np.ndarray, visits: tuple[np.ndarray, np.ndarray], most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query's place, row, score) of the most best rows of each query among the buckets it visits, of score least or more.

    visits: query's place and bucket of each visit. ``least`` rises to the worst of a query's most best so far.
    """
    order = np.argsort(bucket, kind="stable")
    x, rows, bucket, least = x[order], rows[order], bucket[order], least.copy()
    who, where = visits
    by = np.argsort(where, kind="stable")
    who, where = who[by], where[by]
    kept: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    edge = np.flatnonzero(np.append(True, where[1:] != where[:-1])) if len(where) else np.zeros(0, np.int64)
    for lo, hi in zip(edge, np.append(edge[1:], len(where)), strict=True):
        a, b = np.searchsorted(bucket, where[lo], "left"), np.searchsorted(bucket, where[lo], "right")
        for at in range(lo, hi if b > a else lo, 256):
            q = who[at : min(at + 256, hi)]
            s = y[q] @ x[a:b].T
            if b - a >= most:
                least[q] = np.maximum(least[q], np.partition(s, b - a - most, axis=1)[:, b - a - most])
            i, j = np.nonzero(s >= least[q][:, None])
            kept.append((q[i], a + j, s[i, j]))
    if not kept:
        return np.zeros(0, np.int64), rows[:0], np.zeros(0)
    q, j, s = (np.concatenate(z) for z in zip(*kept, strict=True))
    rank = np.lexsort((rows[j], -s, q))
    q, j, s = q[rank], j[rank], s[rank]
    start = np.flatnonzero(np.append(True, q[1:] != q[:-1])) if len(q) else np.zeros(0, np.int64)
    n = np.arange(len(q)) - np.repeat(start, np.diff(np.append(start, len(q))))
    return q[n < most], rows[j[n < most]], s[n < most]


def _compare(index: DataFrame, queries: DataFrame, heavy: DataFrame, most: int) -> DataFrame:
    """q, row, score: the most best rows of each query within its groups, of score least or more.

    index: g, c (bucket), row, v; queries: g, q, v, least, visits (buckets); heavy: g, rb, qb of groups in several blocks.
    """
    share = lambda c, n: F.pmod(F.xxhash64(c), F.col(n)).cast("int")
    blocks = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    known = lambda df: df.join(heavy, "g", "left").withColumns({n: F.coalesce(n, F.lit(1)) for n in ("rb", "qb")})
    i = known(index).withColumn("x", share("row", "rb")).withColumn("y", blocks("qb")).select("g", "x", "y", "c", "row", "v")
    q = known(queries).withColumn("y", share("q", "qb")).withColumn("x", blocks("rb")).select("g", "x", "y", "q", "v", "least", "visits")
    kind_q, kind_r = queries.schema["q"].dataType.simpleString(), index.schema["row"].dataType.simpleString()

    def run(a: pa.Table, b: pa.Table) -> pa.Table:
        if len(a) and len(b):
            dim = len(a["v"][0])
            lists = b["visits"].combine_chunks()
            visits = np.repeat(np.arange(len(b)), lists.value_lengths().to_numpy(zero_copy_only=False)), lists.flatten().to_numpy()
            place, row, score = compare_block(_matrix(a["v"], dim), a["row"].to_numpy(), a["c"].to_numpy(), _matrix(b["v"], dim), b["least"].to_numpy(), visits, most)
        else:
            place, row, score = np.zeros(0, np.int64), [], []
        return pa.table([b["q"].combine_chunks().take(pa.array(place)), pa.array(row, a["row"].type), pa.array(score, pa.float64())], names=["q", "row", "score"])

    return i.groupBy("g", "x", "y").cogroup(q.groupBy("g", "x", "y")).applyInArrow(run, f"q {kind_q}, row {kind_r}, score double")


def _heavy(index: DataFrame, queries: DataFrame, most_rows: int) -> DataFrame:
    """g, rb, qb of the groups of more than most_rows rows or QUERY_BLOCK queries."""
    count = lambda df, n, most: df.groupBy("g").agg(F.ceil(F.count("*") / most).cast("int").alias(n)).where(F.col(n) > 1)
    both = count(index.select("g"), "rb", most_rows).join(count(queries.select("g"), "qb", QUERY_BLOCK), "g", "full_outer")
    return both.select("g", *[F.coalesce(n, F.lit(1)).alias(n) for n in ("rb", "qb")])


def _top(found: DataFrame, most: int) -> DataFrame:
    """The most best rows of each query, each once."""
    one = found.groupBy("q", "row").agg(F.max("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), "row"))
    return one.withColumn("n", rank).where(F.col("n") <= most)


def _placed(rows: DataFrame, h: Hashes, vectors: bool = True) -> DataFrame:
    """g, c, row, v of each row in each table; without vectors: g alone."""
    kind, kind_v = (rows.schema[c].dataType.simpleString() for c in ("row", "v"))

    def run(batches):
        for b in batches:
            for part, x in _by_length(b, 1):
                group, bucket = h.keys(np.floor(h.project(x, False)), x.shape[1])
                for t in range(TABLES):
                    g, c = pa.array(np.ascontiguousarray(group[:, t])), pa.array(np.ascontiguousarray(bucket[:, t]))
                    yield pa.RecordBatch.from_arrays([g, c, part.column(0), part.column(1)] if vectors else [g], names=["g", "c", "row", "v"] if vectors else ["g"])

    return map_arrow(rows.select("row", "v"), run, f"g long, c long, row {kind}, v {kind_v}" if vectors else "g long")


def _visits(asked: DataFrame, h: Hashes, probes: int, home: bool) -> DataFrame:
    """g, q, v, least, visits: each query's buckets by group; home: those of the query's own groups, else the others. asked: q, v, least."""
    kind, kind_v = (asked.schema[c].dataType.simpleString() for c in ("q", "v"))

    def run(batches):
        for b in batches:
            for part, x in _by_length(b, 1):
                step = max(1, (1 << 16) // probes)
                for lo in range(0, len(x), step):
                    some = x[lo : lo + step]
                    group, bucket = h.keys(h.probes(some, probes), x.shape[1])
                    own, _ = h.keys(np.floor(h.project(some, True)), x.shape[1])
                    q, t, k = np.nonzero((group == own[:, :, None]) == home)
                    if not len(q):
                        continue
                    g, c = group[q, t, k], bucket[q, t, k]
                    order = np.lexsort((g, q))
                    q, g, c = q[order], g[order], c[order]
                    start = np.flatnonzero(np.append(True, (q[1:] != q[:-1]) | (g[1:] != g[:-1])))
                    lists = pa.ListArray.from_arrays(pa.array(np.append(start, len(q)), pa.int32()), pa.array(c))
                    rows = part.take(pa.array(lo + q[start]))
                    yield pa.RecordBatch.from_arrays([pa.array(g[start]), *rows.columns, lists], names=["g", "q", "v", "least", "visits"])

    return map_arrow(asked.select("q", "v", "least"), run, f"g long, q {kind}, v {kind_v}, least double, visits array<long>")


def nearest(vectors: DataFrame, is_query: Column, *, id_col: str = "vec_id", vector_col: str = "embedding", most: int = 20) -> DataFrame:
    """query_id, rank, vec_id, score of the ``most`` nearest rows found for each row where is_query holds (a Column on vec_id)."""
    spark = vectors.sparkSession
    valid = _valid(vectors, id_col, vector_col)
    rows = scratch_table(_distinct(valid, most + 1), "vectors")
    asked = valid.where(is_query)
    members = asked.select(F.col("vec_id").alias("query_id"), "k1", "k2").distinct()
    classes = scratch_table(asked.groupBy("k1", "k2").agg(F.min("vec_id").alias("q"), F.first("v").alias("v")), "queries")
    square = F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x)
    fact = rows.agg(F.count("*").alias("n"), F.max(square).alias("m"), F.avg(square).alias("a"), F.avg(F.size("v")).alias("length")).first()
    if not fact["n"]:
        return spark.createDataFrame([], f"query_id {members.schema['query_id'].dataType.simpleString()}, rank int, vec_id {members.schema['query_id'].dataType.simpleString()}, score double")
    norm, most_rows = math.sqrt(fact["m"]), max(256, int(ROW_NUMBERS / fact["length"]))
    h, probes = _fit(rows, classes, lambda k: Hashes(fact["n"], norm, math.sqrt(max(fact["a"], 1e-30)), k), most)
    any_score = F.lit(float("-inf")).alias("least")
    if probes:
        first = _visits(classes.select("q", "v", any_score), h, probes, True)
        found = _top(_compare(_placed(rows, h), first, _heavy(_placed(rows, h, False), first, most_rows), most + 1), most + 1)
        found = scratch_table(found, "found")
        if h.lead:
            least = found.where(F.col("n") == most + 1).select("q", F.col("score").alias("least"))
            again = classes.select("q", "v").join(least, "q", "left").select("q", "v", F.coalesce("least", any_score).alias("least"))
            later = _visits(again, h, probes, False)
            more = _compare(_placed(rows, h), later, _heavy(_placed(rows, h, False), later, most_rows), most + 1)
            found = scratch_table(_top(found.select("q", "row", "score").unionByName(more), most + 1), "found")
    else:  # no k reaches TARGET: none found, all are compared with every row
        found = classes.select("q", F.col("q").alias("row"), F.lit(0.0).alias("score"), F.lit(1).alias("n")).where(F.lit(False))
    found = found.drop("n")
    # ids that the found rows stand for; queries with too few are compared with every row of their length
    full = rows.groupBy(F.size("v").alias("length")).agg(F.sum(F.size("ids")).alias("full"))
    held = found.join(rows.select("row", F.size("ids").alias("n")), "row").groupBy("q").agg(F.sum("n").alias("n"))
    lack = classes.join(held, "q", "left").withColumn("length", F.size("v")).join(full, "length").where(F.coalesce("n", F.lit(0)) < F.least(F.lit(most + 1), "full"))
    short = scratch_table(lack.select("q", "v"), "short")
    if not short.isEmpty():
        g = F.size("v").cast("long").alias("g")
        every, those = rows.select(g, F.lit(0).cast("long").alias("c"), "row", "v"), short.select(g, "q", "v", any_score, F.array(F.lit(0).cast("long")).alias("visits"))
        exact = _top(_compare(every, those, _heavy(every, those, most_rows), most + 1), most + 1).drop("n")
        found = found.join(short.select("q"), "q", "left_anti").unionByName(exact)
    ids = found.join(rows.select("row", "ids"), "row").select("q", "score", F.explode("ids").alias("vec_id"))
    whole = ids.join(classes.select("q", "k1", "k2"), "q").withColumn("n", F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), "vec_id"))).where(F.col("n") <= most + 1)
    own = whole.groupBy("k1", "k2").agg(F.array_sort(F.collect_list(F.struct("n", "vec_id", "score"))).alias("list"))
    mine = members.join(own, ["k1", "k2"]).select("query_id", F.slice(F.filter("list", lambda x: x["vec_id"] != F.col("query_id")), 1, most).alias("list"))
    return mine.select("query_id", F.posexplode("list").alias("rank", "x")).select("query_id", (F.col("rank") + 1).alias("rank"), "x.vec_id", "x.score")


def _fit(rows: DataFrame, classes: DataFrame, hashes, most: int) -> tuple[Hashes, int]:
    """Hashes of the greatest k, and least number of probes, at which TARGET of the sample's true neighbours are in probed buckets; 0 where there are none."""
    sample = classes.orderBy(F.xxhash64("q"), "q").limit(SAMPLE).collect()
    if not sample:
        return hashes(None), 1
    asked = [np.array(r["v"], dtype=np.float64) for r in sample]
    at = {d: np.array([i for i, v in enumerate(asked) if len(v) == d]) for d in {len(v) for v in asked}}
    by_length = {d: np.stack([asked[i] for i in where]) for d, where in at.items()}

    def scan(batches):
        for b in batches:
            for part, x in _by_length(b, 1):
                if x.shape[1] not in by_length:
                    continue
                ids, s = part.column(0).to_numpy(zero_copy_only=False), by_length[x.shape[1]] @ x.T
                for k, pick in zip(at[x.shape[1]], _best(s, ids, most), strict=True):
                    line = s[np.searchsorted(at[x.shape[1]], k)]
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(pick), k), pa.int64()), part.column(0).take(pa.array(pick)), pa.array(line[pick])], names=["q", "row", "score"])

    near = _top(map_arrow(rows.select("row", "v"), scan, f"q long, row {rows.schema['row'].dataType.simpleString()}, score double"), most)
    true = near.join(rows.select("row", "v"), "row").select("q", "v").collect()  # SAMPLE x most rows
    pairs = [(asked[r["q"]], np.array([x["v"] for x in true if x["q"] == r["q"]], dtype=np.float64)) for r in {r["q"]: r for r in true}.values()]
    for k in range(hashes(None).k, 0, -1):
        h = hashes(k)
        want, top = _probes_wanted(h, pairs)
        if want <= top:
            return h, max(want, 1)
    return h, 0


def _probes_wanted(h: Hashes, pairs: list[tuple[np.ndarray, np.ndarray]]) -> tuple[int, int]:
    """Least number of probes at which TARGET of the (query, neighbours) are in probed buckets (most + 1: more than most); most."""
    top = min((2 * REACH + 1) ** h.k, MOST_PROBES)
    first: list[int] = []
    for y, x in pairs:
        _, cells = h.keys(np.floor(h.project(x, False)), len(y))
        _, keys = h.keys(h.probes(y[None], top), len(y))
        for own in cells:
            hits = [np.flatnonzero(keys[0, t] == own[t]) for t in range(TABLES)]
            first.append(min((int(z[0]) + 1 for z in hits if len(z)), default=top + 1))
    return (int(np.sort(first)[max(0, math.ceil(TARGET * len(first)) - 1)]) if first else 1), top
