"""SimHash near-duplicates, searched by a generalised pigeonhole over unequal bit partitions.

A fingerprint is the 64-bit majority of the XXH64 (seed 42) values of a text's
word shingles. Equal fingerprints are collapsed first, so copies cost one row.
Two fingerprints within ``radius`` bits agree, for any split of the bits into m
partitions and thresholds t with sum(t) = radius - m + 1, within t[i] bits on at
least one partition i. Correlated bits share a partition; partition widths and
thresholds are chosen by dynamic programming on estimated candidate counts.
Every candidate is verified on all 64 bits. A bucket hands on one pair for each
fingerprint but one of a class, not all pairs; crowded buckets are dealt anew by
parts of their other bits.

Three bits of 64 see texts that share nearly all shingles. Where texts are to be
joined from a ``similarity`` of their shingle sets on (0.8 differs in ten bits
of 64 on average, too many for a pigeonhole), ``similar_links`` adds links: ``BANDS``
keys of ``ROWS`` min-wise hashes put fingerprints into buckets, and the exact
Jaccard similarity of the sets decides. Bucket ends are compared first, which
joins most copies; then every pair of a bucket that is still in different
classes is verified, unless set sizes or parity sketches prove it less similar.
Large buckets are compared in blocks. Pairs without a common bucket stay apart.

Defined results: null text counts as empty; a text of fewer words than a
shingle is one shingle of all its words; no word gives fingerprint 0, which
links like any other. Repeated rows are kept. An empty table gives no rows.
Whole texts count, however long. Columns are found by place, so others may have
any names, dots included, and stay as they are.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import LOWER, RollingHash, drop_scratch, map_arrow, mix64, numbered, release_shuffles, repeat_ranges, scratch_table, text_blocks
from .xxh import xxh64_ranges

BITS = 64
BANDS, ROWS = 20, 6
#: Cost of verifying a pair against that of shuffling a key; pairs verified at once.
PAIR_COST, PAIRS = 1 / 500, 1 << 17
#: Rows and shingles of a bucket that are compared with as many others at a time; most bits of a parity sketch.
BLOCK, BLOCK_SHINGLES, WIDEST = 4096, 1 << 21, 1 << 16
_draw = np.random.default_rng(64)
_FACTORS = _draw.integers(0, 2**63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_SHIFTS = _draw.integers(0, 2**63, BANDS * ROWS, dtype=np.uint64)


def shingle_fingerprints(data: np.ndarray, begin: np.ndarray, end: np.ndarray, count: np.ndarray, shingle: int) -> np.ndarray:
    """Fingerprint of each doc from its words; words must be joined by one blank in data."""
    first = np.cumsum(count) - count
    many = np.where(count == 0, 0, np.maximum(count - shingle + 1, 1))
    doc = np.repeat(np.arange(len(count)), many)
    k = np.arange(int(many.sum())) - np.repeat(np.cumsum(many) - many, many)
    left = first[doc] + k
    right = np.minimum(left + shingle - 1, first[doc] + count[doc] - 1)
    h = xxh64_ranges(data, begin[left], end[right]) if len(left) else np.zeros(0, dtype=np.uint64)
    out = np.zeros(len(count), dtype=np.uint64)
    edge = np.cumsum(many)
    octets = h.view(np.uint8).reshape(-1, 8)
    for i in np.flatnonzero(many):
        part = octets[edge[i] - many[i] : edge[i]]
        ones = np.zeros(BITS, dtype=np.int64)
        for j in range(0, len(part), 4096):
            ones += np.unpackbits(part[j : j + 4096], axis=1, bitorder="little").sum(0, dtype=np.int32)
        out[i] = np.packbits(2 * ones > many[i], bitorder="little").view(np.uint64)[0]
    return out


def normalised(texts):
    """Lower-case A-Z, and one blank after each word: bytes, word starts and ends, words per doc."""
    low = LOWER[texts.data]
    begin, end, count = texts.words(low)
    size = end - begin
    stop = np.cumsum(size + 1)
    start = stop - size - 1
    out = np.full(int(stop[-1]) if len(stop) else 0, 0x20, dtype=np.uint8)
    if len(size):
        shift = np.repeat(begin - start, size + 1)
        src = np.arange(len(out)) + shift
        keep = np.ones(len(out), dtype=bool)
        keep[stop - 1] = False
        out[keep] = low[src[keep]]
    return out, start, stop - 1, count


def row_keys(id_col: str | Column, text_col: str | Column) -> list[Column]:
    """96 bits that tell rows of different id or text apart."""
    return [F.xxhash64(id_col, text_col).alias("k1"), F.hash(F.lit("row"), text_col, id_col).alias("k2")]


def _id_text(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """doc_id, k1, k2, text of docs, whatever its other columns are called."""
    own, text = (F.col(f"c{docs.columns.index(c)}") for c in (id_col, text_col))
    return numbered(docs).select(own.alias("doc_id"), *row_keys(own, text), text.cast("string").alias("text"))


def fingerprints(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3) -> DataFrame:
    """doc_id, k1, k2, fp (the fingerprint's bits as a long) of every row of docs."""

    def run(batches):
        for b in batches:
            fps = [shingle_fingerprints(*normalised(t), shingle) for t in text_blocks(b.column(3))]
            fp = np.concatenate(fps).view(np.int64) if fps else np.zeros(0, dtype=np.int64)
            yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array(fp, pa.int64())], names=["doc_id", "k1", "k2", "fp"])

    docs = _id_text(docs, id_col, text_col)
    kind = docs.schema["doc_id"].dataType.simpleString()
    return map_arrow(docs, run, f"doc_id {kind}, k1 long, k2 int, fp long")


def shingle_sets(data: np.ndarray, begin: np.ndarray, end: np.ndarray, count: np.ndarray, shingle: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Band keys of each doc with a word (others: zeros); sorted 32-bit hashes of all docs' different shingles; how many each doc has."""
    many = np.where(count == 0, 0, np.maximum(count - shingle + 1, 1))
    doc = np.repeat(np.arange(len(count)), many)
    left = (np.cumsum(count) - count)[doc] + np.arange(len(doc)) - np.repeat(np.cumsum(many) - many, many)
    right = np.minimum(left + shingle - 1, (np.cumsum(count) - 1)[doc])
    h = RollingHash(data).ranges(begin[left], end[right]) if len(doc) else np.zeros(0, dtype=np.uint64)
    keys = np.zeros((len(count), BANDS), dtype=np.uint64)
    full = np.flatnonzero(many)
    if len(full):
        first = (np.cumsum(many) - many)[full]
        for k in range(BANDS):
            key = np.full(len(full), k + 1, dtype=np.uint64)
            for i in range(k * ROWS, (k + 1) * ROWS):
                least = np.minimum.reduceat((h * _FACTORS[i] + _SHIFTS[i]) >> np.uint64(32), first)
                key = mix64(key * np.uint64(0x9E3779B97F4A7C15) + least)
            keys[full, k] = key
    different = np.unique(doc.astype(np.uint64) << np.uint64(32) | h >> np.uint64(32))
    sizes = np.bincount((different >> np.uint64(32)).astype(np.int64), minlength=len(count))
    return keys, different.astype(np.uint32), sizes


def parity_sketch(values: np.ndarray) -> bytes:
    """Bit i says whether an odd number of values end in i. Two sets differ in as many values as their sketches in bits, at least."""
    width = min(max(64, 1 << (2 * len(values) - 1).bit_length()), WIDEST) if len(values) else 64
    odd = np.bincount(values & np.uint32(width - 1), minlength=width) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


def signatures(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5) -> DataFrame:
    """fingerprints(), and keys (one a band; null for a text without words), shingles (sorted 32-bit hashes) and their sketch."""

    def run(batches):
        for b in batches:
            for t in text_blocks(b.column(3)):
                words = normalised(t)
                fp = shingle_fingerprints(*words, shingle).view(np.int64)
                keys, sets, sizes = shingle_sets(*words, shingle)
                edge = np.cumsum(sizes)
                rows = [k.tolist() if n else None for k, n in zip(keys.view(np.int64), sizes, strict=True)]
                parts = [sets[e - n : e] for e, n in zip(edge, sizes, strict=True)]
                blobs, sketches = [x.tobytes() for x in parts], [parity_sketch(x) for x in parts]
                cols = [b.column(i).slice(t.first, len(t)) for i in range(3)]
                yield pa.RecordBatch.from_arrays([*cols, pa.array(fp, pa.int64()), pa.array(rows, pa.list_(pa.int64())), pa.array(blobs, pa.binary()), pa.array(sketches, pa.binary())], names=["doc_id", "k1", "k2", "fp", "keys", "shingles", "sketch"])

    docs = _id_text(docs, id_col, text_col)
    kind = docs.schema["doc_id"].dataType.simpleString()
    return map_arrow(docs, run, f"doc_id {kind}, k1 long, k2 int, fp long, keys array<long>, shingles binary, sketch binary")


def shared_buckets(signed: DataFrame) -> DataFrame:
    """band, key, fp, size, low, high: each bucket of two fingerprints or more, with the least and the greatest."""
    keyed = scratch_table(signed.where("keys IS NOT NULL").select("fp", "size", F.posexplode("keys").alias("band", "key")), "bands")
    ends = keyed.groupBy("band", "key").agg(F.min("fp").alias("low"), F.max("fp").alias("high")).where("low < high")
    shared = scratch_table(keyed.join(ends, ["band", "key"]), "shared")
    drop_scratch(keyed)
    return shared


def possible_pairs(size: np.ndarray, group: np.ndarray, side: np.ndarray, sketch: list[bytes], similarity: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of rows of different group (and side, where not negative) that may have that similarity; no pair that has it is left out.

    group may change between two steps: pairs that are of one group by then are left out.
    """
    width = np.array([len(x) // 8 for x in sketch])
    kinds = [(w, np.flatnonzero(width == w)) for w in np.unique(width)]
    words = [np.frombuffer(b"".join(sketch[i] for i in at), dtype=np.uint64).reshape(-1, w) for w, at in kinds]
    share = (1 - similarity) / (1 + similarity)
    for i, (w, at) in enumerate(kinds):
        for j, (_, to) in enumerate(kinds[i:], i):
            if similarity * size[to].min() > size[at].max() or similarity * size[at].min() > size[to].max():
                continue
            y = np.bitwise_xor.reduce(words[j].reshape(len(to), -1, w), axis=1)
            step = max(1, (1 << 17) // (len(to) * int(w)))
            for lo in range(0, len(at), step):
                few = at[lo : lo + step]
                m, n = size[few][:, None], size[to][None]
                good = (group[few][:, None] != group[to][None]) & (similarity * np.maximum(m, n) <= np.minimum(m, n))
                good &= (side[few][:, None] < 0) | (side[few][:, None] != side[to][None])
                if i == j:
                    good &= few[:, None] < to[None]
                a, b = np.nonzero(good)
                for k in range(0, len(a), step * len(to)):
                    u, v = a[k : k + step * len(to)], b[k : k + step * len(to)]
                    apart = np.bitwise_count(words[i][lo + u] ^ y[v]).sum(1, dtype=np.int64)
                    near = apart <= share * (size[few[u]] + size[to[v]]) + 1e-6
                    yield few[u[near]], to[v[near]]


def is_similar(u: np.ndarray, v: np.ndarray, similarity: float) -> bool:
    """Do two sets of different values have that Jaccard similarity?"""
    if similarity * max(len(u), len(v)) > min(len(u), len(v)):
        return False
    both = len(np.intersect1d(u, v, assume_unique=True))
    return both >= similarity * (len(u) + len(v) - both)


def joining_pairs(group: np.ndarray, side: np.ndarray, sets: list[np.ndarray], sketch: list[bytes], similarity: float) -> list[tuple[int, int]]:
    """Similar pairs of rows that join all groups which such pairs connect: fewer than rows. Every other pair is in one group then, or less similar."""
    at, names = np.arange(len(sets)), np.unique(group, return_inverse=True)[1]
    now, out = names.copy(), []

    def find(i):
        while at[i] != i:
            at[i] = at[at[i]]
            i = at[i]
        return i

    for a, b in possible_pairs(np.array([len(x) for x in sets]), now, side, sketch, similarity):
        before = len(out)
        for i, j in zip(a.tolist(), b.tolist(), strict=True):
            x, y = find(names[i]), find(names[j])
            if x != y and is_similar(sets[i], sets[j], similarity):
                at[x] = y
                out.append((i, j))
        if len(out) > before:
            now[:] = np.array([find(i) for i in range(names.max() + 1)])[names]
    return out


def bucket_links(shared: DataFrame, lead: DataFrame, fp: DataFrame, label: DataFrame, similarity: float) -> DataFrame:
    """a, b: similar fingerprints of a bucket that join its classes. label: components(); lead, fp: as in similar()."""
    root = label.select(F.col("node").alias("fp"), "root")
    rows = shared.join(root, "fp", "left").select("band", "key", "fp", "size", F.coalesce("root", "fp").alias("root"))
    stat = rows.groupBy("band", "key").agg(F.count("*").alias("n"), F.sum("size").alias("shingles"), F.min("root").alias("low"), F.max("root").alias("high")).where("low < high")
    blocks = stat.select("band", "key", F.ceil(F.greatest(F.col("n") / BLOCK, F.col("shingles") / BLOCK_SHINGLES)).cast("int").alias("blocks"))
    own = F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int")
    dealt = rows.join(blocks, ["band", "key"]).withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    g = F.xxhash64("band", "key", F.least("own", "other"), F.greatest("own", "other")).alias("g")
    dealt = dealt.select(g, "fp", "root", F.when(F.col("own") == F.col("other"), F.lit(-1)).otherwise(F.col("own")).alias("side"))
    leads = lead.join(dealt.select("fp").distinct(), "fp")
    sets = leads.join(fp.select("k1", "k2", "shingles", "sketch"), ["k1", "k2"]).dropDuplicates(["fp"]).select("fp", "shingles", "sketch")

    def run(batches):
        def pairs(t):
            both = [np.frombuffer(x.as_buffer(), dtype=np.uint32) for x in t["shingles"]]
            found = joining_pairs(t["root"].to_numpy(), t["side"].to_numpy(), both, t["sketch"].to_pylist(), similarity)
            a, b = np.array(found, dtype=np.int64).reshape(-1, 2).T
            name = t["fp"].to_numpy()
            return pa.RecordBatch.from_arrays([pa.array(np.minimum(name[a], name[b])), pa.array(np.maximum(name[a], name[b]))], names=["a", "b"])

        rest = None
        for batch in batches:
            t = pa.Table.from_batches([batch])
            t = (t if rest is None else pa.concat_tables([rest, t])).combine_chunks()
            key = t["g"].to_numpy()
            edge = [0, *(np.flatnonzero(key[1:] != key[:-1]) + 1)]
            for lo, hi in zip(edge, edge[1:]):
                yield pairs(t.slice(lo, hi - lo))
            rest = t.slice(edge[-1])
        if rest is not None and len(rest):
            yield pairs(rest)

    met = dealt.join(sets, "fp").select("g", "fp", "root", "side", "shingles", "sketch").repartition("g").sortWithinPartitions("g")
    return map_arrow(met, run, "a long, b long")


def similar(pairs: DataFrame, lead: DataFrame, fp: DataFrame, similarity: float) -> DataFrame:
    """The pairs a < b whose shingle sets have that Jaccard similarity. pairs: fp, end; lead: fp, k1, k2 of the row of fp whose set counts."""
    pairs = pairs.select(F.least("fp", "end").alias("a"), F.greatest("fp", "end").alias("b")).distinct()
    pairs = pairs.join(lead.toDF("a", "a1", "a2"), "a").join(lead.toDF("b", "b1", "b2"), "b")
    sets = fp.select("k1", "k2", "shingles")
    both = pairs.join(sets.toDF("a1", "a2", "x"), ["a1", "a2"]).join(sets.toDF("b1", "b2", "y"), ["b1", "b2"]).select("a", "b", "x", "y")

    def run(batches):
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                u, v = np.frombuffer(x.as_buffer(), dtype=np.uint32), np.frombuffer(y.as_buffer(), dtype=np.uint32)
                keep.append(is_similar(u, v, similarity))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return map_arrow(both, run, "a long, b long")


def similar_links(fp: DataFrame, edges: DataFrame, similarity: float) -> DataFrame:
    """edges (a, b), and links between similar texts as far as they join classes. fp: signatures().

    Texts of one fingerprint are taken as copies: the first by key stands for
    them. Each fingerprint is held against the bucket end it shares most bands
    with; then all pairs of a bucket that are still in different classes are.
    """
    first = lambda c: F.min_by(c, F.struct("k1", "k2"))
    size = (F.octet_length("shingles") / 4).cast("int")
    signed = scratch_table(fp.withColumn("size", size).groupBy("fp").agg(*[first(c).alias(c) for c in ("keys", "size")], F.min(F.struct("k1", "k2")).alias("lead")), "lead")
    lead = signed.select("fp", "lead.k1", "lead.k2")
    shared = shared_buckets(signed)
    ends = shared.select("fp", F.explode(F.array("low", "high")).alias("end")).where("fp != end").groupBy("fp", "end").agg(F.count("*").alias("n"))
    best = ends.groupBy("fp").agg(F.max_by("end", F.struct("n", "end")).alias("end"))
    edges = scratch_table(edges.union(similar(best, lead, fp, similarity)).distinct(), "links")
    release_shuffles(fp.sparkSession)
    more = scratch_table(bucket_links(shared, lead, fp, components(edges), similarity), "more")
    drop_scratch(shared)
    release_shuffles(fp.sparkSession)
    return edges.union(more).distinct()


def bit_statistics(fps: DataFrame) -> tuple[int, np.ndarray]:
    """Number of fingerprints and, for each pair of bits, how many have both: a 64 x 64 matrix whatever the input."""

    def run(batches):
        n, both = 0, np.zeros((BITS, BITS), dtype=np.int64)
        for b in batches:
            v = b.column(0).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
            for i in range(0, len(v), 1 << 14):
                bits = np.unpackbits(v[i : i + (1 << 14)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(np.float32)
                both += np.rint(bits.T @ bits).astype(np.int64)
                n += len(bits)
        if n:
            i, j = np.indices((BITS, BITS))
            yield pa.RecordBatch.from_arrays([pa.array([-1, *(i.ravel() * BITS + j.ravel())], pa.int32()), pa.array([n, *both.ravel()], pa.int64())], names=["cell", "n"])

    rows = map_arrow(fps.select("fp"), run, "cell int, n long").groupBy("cell").agg(F.sum("n").alias("n")).collect()
    both = np.zeros(BITS * BITS)
    total = 0
    for r in rows:  # 64 * 64 + 1 rows
        if r["cell"] < 0:
            total = r["n"]
        else:
            both[r["cell"]] = r["n"]
    return total, both.reshape(BITS, BITS)


def _order_bits(n: int, both: np.ndarray) -> list[int]:
    """Bits in an order that puts correlated ones side by side: a greedy chain from the most skewed bit."""
    p = np.diag(both) / max(n, 1)
    cov = both / max(n, 1) - np.outer(p, p)
    sd = np.sqrt(np.maximum(p * (1 - p), 1e-12))
    corr = np.abs(cov / np.outer(sd, sd))
    left = set(range(BITS))
    at = int(np.argmax(np.abs(p - 0.5)))
    chain = [at]
    left.discard(at)
    while left:
        at = max(left, key=lambda j: (max(corr[k, j] for k in chain[-4:]), -j))
        chain.append(at)
        left.discard(at)
    return chain


def _agree(n: int, both: np.ndarray, chain: list[int], top: int) -> np.ndarray:
    """agree[a, b, t]: chance that two fingerprints differ in exactly t of the bits chain[a:b], along a first-order chain."""
    both = both / max(n, 1)
    p = np.diag(both)
    same = p**2 + (1 - p) ** 2
    out = np.zeros((BITS + 1, BITS + 1, top + 1))
    for a in range(BITS):
        # state: (differs at last bit?, bits that differ)
        d = np.zeros((2, top + 1))
        for b in range(a, BITS):
            j = chain[b]
            if b == a:
                d[0, 0] = same[j]
                if top:
                    d[1, 1] = 1 - same[j]
            else:
                i = chain[b - 1]
                p11, p10, p01 = both[i, j], p[i] - both[i, j], p[j] - both[i, j]
                p00 = max(0.0, 1 - p11 - p10 - p01)
                ss = p11**2 + p10**2 + p01**2 + p00**2  # both bits agree
                dd = 2 * (p11 * p00 + p10 * p01)  # both differ
                si = same[i]
                s_s = min(1.0, ss / max(si, 1e-12))
                d_d = min(1.0, dd / max(1 - si, 1e-12)) if si < 1 else 0.0
                new = np.zeros_like(d)
                new[0] = d[0] * s_s + d[1] * (1 - d_d)
                new[1, 1:] = d[0, :-1] * (1 - s_s) + d[1, :-1] * d_d
                d = new
            out[a, b + 1] = d.sum(0)
    return out


def plan_partitions(n: int, both: np.ndarray, radius: int = 3, most: int = 4, pair_cost: float = PAIR_COST, row_cost: float = 1.0) -> list[tuple[list[int], int]]:
    """[(bits, threshold)] of least estimated cost with sum(threshold) = radius - m + 1 over m <= most partitions.

    Cost: the rows that a partition's keys make (one for t = 0, its width for
    t = 1, pairs of bits for t = 2) and the pairs they bring together.
    Dynamic programming over the chain position, the partitions so far and the
    thresholds spent; threshold -1 leaves a partition unprobed.
    """
    chain = _order_bits(n, both)
    top = min(2, radius)
    agree = np.cumsum(_agree(n, both, chain, top), axis=2)
    pairs = n * max(n - 1, 0) / 2

    def keys(width: int, t: int) -> float:
        return 0.0 if t < 0 else (1.0, float(width), width * (width - 1) / 2)[t]

    def cost(a: int, b: int, t: int) -> float:
        if t < 0:
            return 0.0
        if t >= b - a:
            return float("inf")
        seen = pairs * agree[a, b, t] * (1 if t == 0 else (b - a) if t == 1 else (b - a) ** 2 / 2)
        return row_cost * max(n, 1) * keys(b - a, t) + pair_cost * seen

    best: tuple[float, list[tuple[int, int, int]]] = (float("inf"), [])
    for m in range(1, most + 1):
        want = radius - m + 1
        state: dict[tuple[int, int], tuple[float, list]] = {(0, 0): (0.0, [])}
        for k in range(m):
            after: dict[tuple[int, int], tuple[float, list]] = {}
            for (a, spent), (c, way) in state.items():
                for b in [BITS] if k == m - 1 else range(a + 4, BITS - 4 * (m - k - 1) + 1):
                    for t in range(-1, top + 1):
                        c2 = c + cost(a, b, t)
                        key = (b, spent + t)
                        if c2 < after.get(key, (float("inf"),))[0]:
                            after[key] = (c2, [*way, (a, b, t)])
            state = after
        found = state.get((BITS, want))
        if found and found[0] < best[0]:
            best = found
    if not best[1]:  # nothing estimated, as for no rows
        best = (0.0, [(16 * i, 16 * i + 16, 0) for i in range(radius + 1)])
    return [(sorted(chain[a:b]), t) for a, b, t in best[1] if t >= 0]


def key_masks(plan: list[tuple[list[int], int]]) -> list[int]:
    """A mask of bits for each key of a fingerprint: those within t bits on a partition agree on all bits of one of its masks."""
    out = []
    for bits, t in plan:
        cleared = [[]] if t == 0 else [[b] for b in bits] if t == 1 else [[a, b] for k, a in enumerate(bits) for b in bits[k + 1 :]]
        out += [sum(1 << b for b in bits) & ~sum(1 << b for b in c) for c in cleared]
    return out


def _long(mask: int) -> Column:
    return F.lit(mask - ((mask >> 63) << 64)).cast("long")


def _finer(mask: int, radius: int) -> list[int]:
    """Masks of radius + 1 parts of the other bits: fingerprints within radius agree on all bits of one part."""
    rest = [b for b in range(BITS) if not mask >> b & 1]
    return [sum(1 << b for b in rest[k :: radius + 1]) for k in range(radius + 1)]


def bucket_forest(fp: np.ndarray, bucket: np.ndarray, side: np.ndarray, radius: int) -> np.ndarray:
    """For each row the first row of its bucket that it is joined to by fingerprints within radius, pair by pair. Rows sorted by bucket.

    Every pair of a bucket is verified on all bits, but those of one side (0 or more): another block holds them.
    """
    n = len(fp)
    root = np.arange(n)
    if not n:
        return root
    start = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1]))
    many = np.repeat(np.append(start[1:], n), np.diff(np.append(start, n))) - np.arange(n) - 1  # later rows of the bucket
    total = np.cumsum(many)
    lo = 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(total, (total[lo - 1] if lo else 0) + PAIRS, "right")))
        i = np.repeat(np.arange(lo, hi), many[lo:hi])
        j = i + 1 + repeat_ranges(many[lo:hi])
        near = np.bitwise_count(fp[i] ^ fp[j]) <= radius
        near &= (side[i] < 0) | (side[i] != side[j])
        i, j = i[near], j[near]
        while len(i):  # the greater root takes the lesser one for its own until no pair is apart
            a, b = root[i], root[j]
            apart = a != b
            if not apart.any():
                break
            i, j, a, b = i[apart], j[apart], a[apart], b[apart]
            np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
            while (root[root] != root).any():
                root = root[root]
        lo = hi
    return root


def links(fps: DataFrame, *, radius: int = 3) -> DataFrame:
    """Pairs a < b of fingerprints of one class; they join all that are within radius bits of one another, step by step. fps: distinct fp.

    A bucket gives one pair for each fingerprint that isn't the least of its
    class there, so a dense group makes few pairs. A bucket of more than BLOCK
    fingerprints is dealt anew by parts of its other bits, as the pigeonhole
    allows; what is too large even so is compared block by block.
    """
    n, both = bit_statistics(fps)
    masks = key_masks(plan_partitions(n, both, radius))
    one = fps.select("fp", F.inline(F.array(*[F.struct(F.lit(i).alias("tag"), F.xxhash64(F.lit(i), F.col("fp").bitwiseAND(_long(m))).alias("g")) for i, m in enumerate(masks)])))
    crowded = lambda df: df.groupBy("g").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks")).where("blocks > 1")
    parts = zip(*[_finer(m, radius) for m in masks], strict=True)
    finer = F.array(*[F.xxhash64("g", F.lit(k), F.col("fp").bitwiseAND(F.get(F.array(*map(_long, of)), F.col("tag")))) for k, of in enumerate(parts)])
    two = one.join(crowded(one), "g", "left").select("fp", F.explode(F.when(F.col("blocks").isNull(), F.array("g")).otherwise(finer)).alias("g"))
    dealt = two.join(crowded(two), "g", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    dealt = dealt.withColumn("own", F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    block = F.when(F.col("blocks") == 1, F.col("g")).otherwise(F.xxhash64("g", F.least("own", "other"), F.greatest("own", "other")))
    dealt = dealt.select(block.alias("g"), "fp", F.when(F.col("own") == F.col("other"), F.lit(-1)).otherwise(F.col("own")).alias("side"))

    def run(batches):
        def joined(g, fp, side):
            root = bucket_forest(fp.view(np.uint64), g, side, radius)
            at = np.flatnonzero(root != np.arange(len(root)))
            a, b = fp[root[at]], fp[at]
            return pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], names=["a", "b"])

        held: list = []
        for batch in batches:
            cols = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
            if held and len(cols[0]) and cols[0][-1] == held[0][0][0]:
                held.append(cols)
                continue
            g, fp, side = (np.concatenate(x) for x in zip(*held, cols, strict=True))
            cut = np.flatnonzero(g[1:] != g[:-1])
            edge = int(cut[-1]) + 1 if len(cut) else 0
            if edge:
                yield joined(g[:edge], fp[:edge], side[:edge])
            held = [[g[edge:], fp[edge:], side[edge:]]] if len(g) else []
        if held:
            yield joined(*(np.concatenate(x) for x in zip(*held, strict=True)))

    return map_arrow(dealt.repartition("g").sortWithinPartitions("g", "fp"), run, "a long, b long").distinct()


def components(edges: DataFrame) -> DataFrame:
    """node, root (least node reachable) for every node of edges (a, b).

    A round joins each class to the least class that any of its members touches,
    then follows that class's own choice, so long chains merge as fast as stars.
    Each round is written to the shared folder; labels only fall, so it ends.
    """
    both = scratch_table(edges.select("a", "b").union(edges.select(F.col("b"), F.col("a"))), "edges")
    label = scratch_table(both.groupBy(F.col("a").alias("node")).agg(F.least(F.col("a"), F.min("b")).alias("root")), "label")
    while True:
        seen = both.join(label.select(F.col("node").alias("b"), "root"), "b").groupBy(F.col("a").alias("node")).agg(F.min("root").alias("low"))
        step = label.join(seen, "node").select("node", F.col("root").alias("old"), F.least("root", "low").alias("low"))
        choice = scratch_table(step.groupBy("old").agg(F.min("low").alias("low")), "choice")
        far = choice.join(choice.select(F.col("old").alias("low"), F.col("low").alias("far")), "low").select(F.col("old").alias("root"), "far")
        done = choice.where("low < old").isEmpty()
        if not done:
            before, label = label, scratch_table(label.join(far, "root").select("node", F.col("far").alias("root")), "label")
            drop_scratch(before)
        drop_scratch(choice)
        if done:
            drop_scratch(both)
            return label


def _classified(docs: DataFrame, id_col: str, text_col: str, shingle: int, radius: int, similarity: float | None = None) -> tuple[DataFrame, DataFrame]:
    """Every row's fingerprint; and fp, root for each different fingerprint."""
    make = fingerprints if similarity is None else signatures
    fp = scratch_table(make(docs, id_col=id_col, text_col=text_col, shingle=shingle), "fingerprints")
    one = scratch_table(fp.select("fp").distinct(), "distinct")
    edges = links(one, radius=radius)
    if similarity is not None:
        edges = similar_links(fp, edges, similarity)
    label = components(edges)
    return fp, one.join(label.withColumnRenamed("node", "fp"), "fp", "left").select("fp", F.coalesce("root", "fp").alias("root"))


def near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, radius: int = 3) -> DataFrame:
    """doc_id, fp, component_id (least doc_id reachable) of every row."""
    fp, roots = _classified(docs, id_col, text_col, shingle, radius)
    lead = fp.groupBy("fp").agg(F.min("doc_id").alias("least")).join(roots, "fp")
    least = lead.groupBy("root").agg(F.min("least").alias("component_id"))
    return fp.select("doc_id", "fp").join(roots.join(least, "root").select("fp", "component_id"), "fp").select("doc_id", "fp", "component_id")


def keep_one(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, radius: int = 3, similarity: float | None = 0.8) -> DataFrame:
    """docs without all but one row of each component: the row of least id (null ids last; rows alike: one of them)."""
    fp, roots = _classified(docs, id_col, text_col, shingle, radius, similarity)
    first = F.min(F.struct(F.isnull("doc_id").alias("none"), "doc_id", "k1", "k2")).alias("lead")
    lead = fp.groupBy("fp").agg(first).join(roots, "fp").groupBy("root").agg(F.min("lead").alias("lead"))
    lead = lead.select("lead.k1", "lead.k2").distinct()
    names = [f"c{i}" for i in range(len(docs.columns))]
    own, text = (F.col(names[docs.columns.index(c)]) for c in (id_col, text_col))
    kept = numbered(docs).select("*", *row_keys(own, text)).join(lead, ["k1", "k2"])
    copy = F.row_number().over(Window.partitionBy("k1", "k2").orderBy("k1"))
    return kept.withColumn("copy", copy).where("copy = 1").select(*names).toDF(*docs.columns)


def fingerprint_hex(col: str) -> Column:
    """A long's 64 bits as 16 lower-case hex digits."""
    return F.lower(F.lpad(F.hex(F.col(col)), 16, "0"))
