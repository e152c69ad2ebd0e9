"""N-gram language model (trigrams by default) with Katz backoff.

P(w | h) = d(c(h,w)) c(h,w) / D(h) where h w was seen, else alpha(h) P(w | h'),
h' being h without its first word, with Good-Turing discounts d of each order up
to counts of 5 and alpha(h) = (1 - seen mass) / (1 - sum of P(w | h') over seen
w), so each context sums to 1. P(w) is discounted alike, its left-over mass
standing for one unknown word. A context without a discounted count gets
D(h) = c(h) + 1, so alpha stays above 0; a context never seen backs off at no
cost. A text starts in a context of its own, its k-th token has at most k words
before it (the start among them), and it ends with one end token.

How it runs: texts become chunks of bounded size, each with a list of its
words' 64-bit hashes and its tokens as positions in that list. A chunk asks
for what it needs once for each different word or n-gram; requests go to hash
buckets, which add up the training counts of all chunks and answer. So a word
or n-gram that makes up a third of the corpus costs one entry a chunk. N-grams
of a bucket share their contexts, except the contexts that hold 1/HOT of all
tokens or more (at most HOT of each order): those are spread over all buckets
and their sums are added up. Orders go up one by one: the answers for one order
number its n-grams, and the next order's requests name their contexts by these
numbers. Counts stay in tables of one row a bucket. Texts never move, nor do
tokens: chunks are written once, bucketed by their number.

Two words share a hash with probability 2**-64. A bucket's answer numbers its
words, and n-grams are asked for by these numbers: they are exact and take a few
bytes where hashes take eight. Only the hot contexts above bigrams go by a hash.

Defined results: null text counts as empty (one end token); repeated rows count
and are scored one by one; very long texts are counted whole; without training
rows every word is unknown and P is 1; an empty table gives no rows; other
columns, whatever their names, are not read.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import LOWER, RollingHash, bucketed_table, lean, map_arrow, mix64, numbered, scratch_table, text_blocks

CHUNK_TOKENS, BUCKET_TOKENS, HOT, LARGEST = 2_200_000, 1_500_000, 1024, 5
#: Sums of P below 1 are added up over buckets as whole multiples of 1/SCALE, in any order alike.
SCALE = 2**60
SPREAD = np.uint64(0x9E3779B97F4A7C15)
END, START = np.uint64(0x5851F42D4C957F2D), np.uint64(0x14057B7EF767814F)


def pack(a: np.ndarray, *, rising: bool = False) -> bytes:
    """Compressed bytes of an array, by byte planes; rising: as differences; int64 in as few bytes as the largest needs, told by the first byte."""
    a = np.ascontiguousarray(np.diff(a, prepend=a.dtype.type(0)) if rising else a)
    head = b""
    if a.dtype == np.int64:
        if not len(a) or a.min() >= 0:
            a = a.astype(next((t for t in (np.uint8, np.uint16, np.uint32) if not len(a) or a.max() <= np.iinfo(t).max), np.int64))
        head = bytes([a.dtype.itemsize])
    return head + zstandard.ZstdCompressor(level=3).compress(a.view(np.uint8).reshape(len(a), -1).T.tobytes() if len(a) else b"")


def unpack(blob: bytes, dtype, *, rising: bool = False) -> np.ndarray:
    width = np.dtype(dtype).itemsize
    kind = dtype
    if dtype == np.int64:
        width, blob = blob[0], memoryview(blob)[1:]
        kind = np.int64 if width == 8 else f"u{width}"
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), dtype=np.uint8)
    a = np.ascontiguousarray(raw.reshape(width, -1).T).view(kind).ravel().astype(dtype, copy=False)
    return np.cumsum(a, dtype=dtype) if rising else a


def bucket_of(h: np.ndarray, buckets: int) -> np.ndarray:
    """Equal ranges of the hash: a sorted list falls into contiguous parts."""
    return ((h >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)


def katz_discounts(n: list[int]) -> list[float]:
    """d[r] for r = 0..LARGEST from the numbers n[r] of items seen r times; the largest discounted count is lowered, or half a count taken off, where Good-Turing gives no proper ratio."""
    for k in range(LARGEST, 0, -1):
        if not all(n[r] for r in range(1, k + 1)):
            continue
        a = (k + 1) * n[k + 1] / n[1]
        if a >= 1:
            continue
        d = [((r + 1) * n[r + 1] / (r * n[r]) - a) / (1 - a) for r in range(1, k + 1)]
        if all(0 < x < 1 for x in d):
            return [1.0, *d, *[1.0] * (LARGEST - k)]
    return [1.0, *[(r - 0.5) / r for r in range(1, LARGEST + 1)]]


def discounted(c: np.ndarray, d: list[float]) -> np.ndarray:
    """d(c) c."""
    return np.asarray(d)[np.where(c <= LARGEST, c, 0)] * c


class Unigrams:
    """P of a word by its training count."""

    def __init__(self, total: int, kinds: int, n: list[int]):
        self.total, self.kinds, self.d = total, kinds, katz_discounts(n)
        mass = float(total) - sum(r * n[r] * (1 - self.d[r]) for r in range(1, LARGEST + 1)) if total else 0.0
        self.bottom = float(total) if total and mass < total - 1e-9 else total + 1.0
        if self.bottom != total:
            self.d, mass = [1.0] * (LARGEST + 1), float(total)
        self.unknown = 1 - mass / self.bottom

    def p(self, c: np.ndarray) -> np.ndarray:
        return np.where(c > 0, discounted(c, self.d) / self.bottom, self.unknown)


def alpha_of(n: np.ndarray, big: np.ndarray, back: np.ndarray, d: list[float]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """D(v), alpha(v), and whether v's counts are discounted, from its numbers of words seen 1..LARGEST times, the sum of larger counts, and the sum of P over its words."""
    r = np.arange(1, LARGEST + 1)
    total = n @ r + big
    mass = n @ (r * np.asarray(d[1:])) + big
    plain = mass >= total - 1e-9  # nothing is discounted
    bottom = np.where(plain, total + 1.0, total)
    left = np.where(plain, 1.0, total - mass)
    alpha = np.where(total > 0, left / bottom / np.maximum(1 - back, 1e-300), 1.0)
    return bottom, alpha, ~plain


def make_chunks(docs: DataFrame, train: Column, id_col: str, text_col: str) -> DataFrame:
    """chunk, tokens, docs (ids), trained, sizes (tokens by doc), words (hashes, frequent ones first), at (tokens as positions in words)."""

    def run(batches):
        made, ids, trained, sizes, hashes, held = 0, [], [], [], [], 0
        base = TaskContext.get().partitionId() << 24
        kind = None

        def emit():
            nonlocal made
            h = np.concatenate(hashes)
            words, at, many = np.unique(h, return_inverse=True, return_counts=True)
            often = np.argsort(-many)  # small positions for frequent words take fewer bytes
            place = np.empty(len(words), dtype=np.uint32)
            place[often] = np.arange(len(words), dtype=np.uint32)
            words, at = words[often], place[at]
            cols = [
                pa.array([base + made], pa.int64()), pa.array([len(h)], pa.int64()), pa.array([pa.concat_arrays(ids).to_pylist()], pa.list_(kind)), pa.array([pack(np.concatenate(trained).astype(np.uint8))], pa.binary()),
                pa.array([pack(np.concatenate(sizes).astype(np.uint32))], pa.binary()), pa.array([pack(words)], pa.binary()), pa.array([pack(at)], pa.binary()),
            ]
            made += 1
            for x in (ids, trained, sizes, hashes):
                x.clear()
            return pa.RecordBatch.from_arrays(cols, names=["chunk", "tokens", "docs", "trained", "sizes", "words", "at"])

        for b in batches:
            kind = b.column(0).type
            for t in text_blocks(b.column(2)):
                low = LOWER[t.data]
                begin, end, count = t.words(low)
                own = RollingHash(low).ranges(begin, end) if len(begin) else np.zeros(0, np.uint64)
                h = np.full(len(own) + len(t), END, dtype=np.uint64)
                h[np.arange(len(own)) + np.repeat(np.arange(len(t)), count)] = own
                ids.append(b.column(0).slice(t.first, len(t)))
                trained.append(np.asarray(b.column(1).slice(t.first, len(t)).to_numpy(zero_copy_only=False), dtype=bool))
                sizes.append(count + 1)
                hashes.append(h)
                held += len(h)
                if held >= CHUNK_TOKENS:
                    yield emit()
                    held = 0
        if held:
            yield emit()

    at = [f"c{docs.columns.index(c)}" for c in (id_col, text_col)]
    own = numbered(docs.select("*", F.coalesce(train, F.lit(False)))).select(F.col(at[0]).alias("id"), F.col(f"c{len(docs.columns)}").alias("trained"), F.col(at[1]).cast("string").alias("text"))
    kind = own.schema["id"].dataType.simpleString()
    return map_arrow(own, run, f"chunk long, tokens long, docs array<{kind}>, trained binary, sizes binary, words binary, at binary")


class Chunk:
    """A chunk's row, unpacked."""

    def __init__(self, row: dict):
        self.id, self.docs = row["chunk"], row["docs"]
        self.sizes = unpack(row["sizes"], np.uint32).astype(np.int64)
        self.trained = unpack(row["trained"], np.uint8).astype(bool)
        self.words, self.at = unpack(row["words"], np.uint64), unpack(row["at"], np.uint32)
        self.reorder(np.argsort(self.words))
        self.weight = np.repeat(self.trained, self.sizes)
        self.first = np.cumsum(self.sizes) - self.sizes

    def reorder(self, order: np.ndarray) -> None:
        """Put the words in another order."""
        place = np.empty(len(order), dtype=np.int32)
        place[order] = np.arange(len(order), dtype=np.int32)
        self.words, self.at = self.words[order], place[self.at]

    def word_counts(self) -> np.ndarray:
        return np.bincount(self.at, weights=self.weight, minlength=len(self.words)).astype(np.int64)

    def grams(self, code: np.ndarray, tokens: np.ndarray):
        """Different codes, rising: number of each of the tokens, a token of each, training counts."""
        order = np.argsort(code)
        s = code[order]
        new = np.ones(len(s), dtype=bool)
        new[1:] = s[1:] != s[:-1]
        start = np.flatnonzero(new)
        order = tokens[order]
        which = np.full(len(self.at), -1, dtype=np.int32)
        which[order] = np.cumsum(new, dtype=np.int32) - 1
        del s
        count = np.add.reduceat(self.weight[order].astype(np.int64), start) if len(start) else np.zeros(0, np.int64)
        return which, order[start], count

    def bigrams(self, hot: np.ndarray, buckets: int, number: np.ndarray, known: np.ndarray) -> Grams:
        """Bigrams, from the words' numbers and training counts."""
        before = np.empty(len(self.at), dtype=np.int64)
        before[1:] = self.at[:-1]
        before[self.first] = len(self.words)
        which, token, count = self.grams(before * (len(self.words) + 1) + self.at, np.arange(len(self.at)))
        v, w = before[token], self.at[token]
        hashes = np.append(self.words, START)
        spread = np.isin(hashes, hot)
        context = np.where(spread, hashes.view(np.int64), np.append(number, 0))[v]
        return Grams.of(self, which, w, w, count, v, hashes.__getitem__, context, spread[v], bucket_of(hashes, buckets)[v], buckets, known[w], None)

    def longer(self, low: Grams, order: int, least: int, buckets: int) -> Grams:
        """N-grams of an order, from those one shorter: the token before ends the context, the token itself the n-gram to back off to. Contexts seen least times or more are spread."""
        place = np.arange(len(self.at)) - np.repeat(self.first, self.sizes)
        here = np.flatnonzero(place >= order - 2)
        rank = np.empty(len(low.w), dtype=np.int64)
        by_part = np.concatenate([x for _, x in low.parts])
        rank[by_part[np.argsort(low.bucket[by_part], kind="stable")]] = np.arange(len(rank))  # by bucket and number
        which, token, count = self.grams(rank[low.which[here - 1]] * len(self.words) + self.at[here], here)
        h, shorter = low.which[token - 1], low.which[token]
        spread = low.total >= least
        context = low.number.copy()
        context[spread] = low.key(np.flatnonzero(spread)).view(np.int64)
        below = low.bottom[shorter].astype(np.int64) * 2 + low.cut[shorter]
        return Grams.of(self, which, self.at[token], shorter, count, h, low.key, context[h], spread[h], low.bucket[h], buckets, low.total[shorter], below)


@dataclass
class Grams:
    """A chunk's different n-grams of one order, and what the buckets say about them."""

    which: np.ndarray  # of each token
    w: np.ndarray  # last word, as a position in the chunk's words
    shorter: np.ndarray  # the n-gram, or word, to back off to
    count: np.ndarray  # in the chunk's training texts
    key: Callable  # hashes of n-grams
    context: np.ndarray  # a number in its bucket; where spread, a hash
    bucket: np.ndarray
    parts: list[tuple[bool, np.ndarray]]  # is the context spread, n-grams in the order of their requests: bucket, context, word
    known: np.ndarray  # training count of shorter
    below: np.ndarray | None  # twice D of shorter's context, plus one if its counts are discounted
    total: np.ndarray | None = None  # training count
    number: np.ndarray | None = None  # in its bucket
    bottom: np.ndarray | None = None  # D of its context
    alpha: np.ndarray | None = None
    cut: np.ndarray | None = None  # are its context's counts discounted?

    @classmethod
    def of(cls, c: Chunk, which, w, shorter, count, h, key_of_context, context, spread, bucket, buckets, known, below) -> Grams:
        """From n-grams in the order of their contexts' buckets, contexts and words."""
        key = lambda i: mix64(key_of_context(h[i]) * SPREAD + c.words[w[i]])
        warm = np.flatnonzero(spread)
        if len(warm):
            bucket = bucket.copy()
            bucket[warm] = bucket_of(key(warm), buckets)
            kinds, at = np.unique(context[warm], return_inverse=True)
            warm = warm[np.argsort((bucket[warm] * len(kinds) + at) * len(c.words) + w[warm])]
        return cls(which, w, shorter, count, key, context, bucket, [(False, np.flatnonzero(~spread)), (True, warm)], known, below)

    def p(self, lower: np.ndarray, d: list[float]) -> np.ndarray:
        """P of each; lower: P of what is backed off to."""
        return np.where(self.total > 0, np.where(self.cut, discounted(self.total, d), self.total) / self.bottom, self.alpha * lower[self.shorter])

    def read(self, answers: pa.Table, order: int, d: list[float], hot: np.ndarray, hot_facts: tuple) -> None:
        """Fill in the answers."""
        size = len(self.w)
        self.total, self.number = np.zeros(size, np.int64), np.zeros(size, np.int64)
        self.bottom, self.alpha, self.cut = np.ones(size), np.ones(size), np.zeros(size, bool)
        for warm, part in self.parts:
            what = f"{'hot' if warm else 'gram'}{order}"
            if not len(part):
                continue
            self.total[part] = _aligned(answers, what)
            number = _aligned(answers, what, "number", rising=True)
            if len(number):
                self.number[part] = number
            if warm:
                at, facts = np.searchsorted(hot, self.context[part]), hot_facts
            else:
                at = np.cumsum(_changes(self.bucket[part], self.context[part])) - 1
                rows = sorted((r["bucket"], r["b"]) for r in answers.select(["what", "bucket", "b"]).to_pylist() if r["what"] == what)
                n = np.concatenate([unpack(b, np.int64).reshape(LARGEST + 1, -1) for _, b in rows], axis=1)
                back = np.zeros(n.shape[1])
                back[np.bincount(at, weights=self.total[part] == 0) > 0] = _aligned(answers, what, "back").view(np.float64)
                facts = alpha_of(n[:LARGEST].T, n[LARGEST], back, d)
            for x, y in zip((self.bottom, self.alpha, self.cut), facts, strict=True):
                x[part] = y[at]


def _changes(*columns: np.ndarray) -> np.ndarray:
    """Where a row differs from the row before."""
    new = np.zeros(len(columns[0]), dtype=bool)
    new[:1] = True
    for c in columns:
        new[1:] |= c[1:] != c[:-1]
    return new


def _word_requests(chunks: DataFrame, buckets: int) -> DataFrame:
    def run(batches):
        for b in batches:
            for row in b.to_pylist():
                c = Chunk(row)
                n, k = c.word_counts(), bucket_of(c.words, buckets)
                rows = [(int(x), c.id, pack(c.words[i:j], rising=True), pack(n[i:j])) for x, i, j in _runs(k)]
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int64(), pa.binary(), pa.binary()), strict=True)], names=["bucket", "chunk", "words", "counts"])

    return map_arrow(chunks, run, "bucket long, chunk long, words binary, counts binary")


def _runs(k: np.ndarray) -> list[tuple[int, int, int]]:
    """(value, start, end) of each run of a sorted array."""
    if not len(k):
        return []
    cut = np.flatnonzero(np.diff(k)) + 1
    return list(zip(k[np.append(0, cut)].tolist(), np.append(0, cut).tolist(), np.append(cut, len(k)).tolist(), strict=True))


def _histogram(c: np.ndarray) -> list[int]:
    return np.bincount(c[c <= LARGEST + 1], minlength=LARGEST + 2).tolist()


_ANSWER = "what string, bucket long, chunk long, a binary, b binary, number binary, back binary, n array<long>"


def _answer(rows: list[tuple]) -> pa.Table:
    kinds = (pa.string(), pa.int64(), pa.int64(), *[pa.binary()] * 4, pa.list_(pa.int64()))
    return pa.table([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=["what", "bucket", "chunk", "a", "b", "number", "back", "n"])


@lean()
def _count_words(table: pa.Table) -> pa.Table:
    """Answers to each chunk (its words' counts and their numbers in the bucket), the bucket's table of counts, and its statistics."""
    rows = table.to_pylist()
    words = [unpack(r["words"], np.uint64, rising=True) for r in rows]
    counts = [unpack(r["counts"], np.int64) for r in rows]
    key, where = np.unique(np.concatenate(words), return_inverse=True)
    total = np.zeros(len(key), dtype=np.int64)
    np.add.at(total, where, np.concatenate(counts))
    out, at = [], 0
    number = np.empty(len(key), dtype=np.int64)
    number[np.argsort(-total, kind="stable")] = np.arange(len(key))  # small ones for frequent words
    for r, w in zip(rows, words, strict=True):
        own = where[at : at + len(w)]
        out.append(("word", r["bucket"], r["chunk"], pack(total[own]), None, pack(number[own]), None, None))
        at += len(w)
    seen = total > 0
    out.append(("table", rows[0]["bucket"], None, pack(key[seen], rising=True), pack(total[seen]), None, None, [int(total.sum()), int(seen.sum()), *_histogram(total)]))
    return _answer(out)


@dataclass
class Model:
    """What all chunks need of the words and of the orders done so far."""

    buckets: int
    uni: Unigrams
    hot: np.ndarray  # hashes of the words that are spread as contexts
    least: int  # training count from which a context is spread
    orders: list[tuple]  # of order 2, 3, ...: discounts, spread contexts, their D, alpha and kind

    def words(self, c: Chunk, answers: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        """Training counts and numbers of the chunk's words, which are put in the order of the numbers."""
        known = _aligned(answers, "word")
        number = bucket_of(c.words, self.buckets) << 32 | _aligned(answers, "word", "number")
        order = np.argsort(number)
        c.reorder(order)
        return known[order], number[order]

    def climb(self, c: Chunk, answers: pa.Table, known: np.ndarray, number: np.ndarray, order: int) -> Iterator[Grams]:
        """The chunk's n-grams of orders 2, 3, ..., answered where the model has the order; none is held when the next is made."""
        g = c.bigrams(self.hot, self.buckets, number, known)
        for k in range(2, order + 1):
            if k > 2:
                g = c.longer(g, k, self.least, self.buckets)
            if k == order:
                g.key = None
            if k - 2 < len(self.orders):
                g.count = g.known = g.below = None
                g.read(answers, k, *self.orders[k - 2])
            yield g


_REQUEST = "bucket long, chunk long, hot boolean, v binary, many binary, below binary, w binary, count binary, known binary"


@lean()
def _requests(left: pa.Table, right: pa.Table, model: Model, order: int) -> pa.Table:
    """A chunk's n-grams of the order, by bucket: contexts, the numbers of their words, training counts."""
    c = Chunk(left.to_pylist()[0])
    known, number = model.words(c, right)
    for g in model.climb(c, right, known, number, order):  # noqa: B007  the last one
        pass
    rows = []
    for warm, part in g.parts:
        for x, i, j in _runs(g.bucket[part]):
            p = part[i:j]
            start = np.flatnonzero(_changes(g.context[p]))
            seen = g.count[p] > 0  # others add nothing to a context's sums
            below = pack(np.maximum.reduceat(np.where(seen, g.below[p], 0), start)) if g.below is not None else None
            rows.append((
                x, c.id, warm, pack(g.context[p[start]], rising=True), pack(np.diff(start, append=len(p))), below,
                pack(number[g.w[p]]), pack(g.count[p]), pack(np.where(seen, g.known[p], 0)),
            ))
    kinds = (pa.int64(), pa.int64(), pa.bool_(), *[pa.binary()] * 6)
    names = [x.split()[0] for x in _REQUEST.split(", ")]
    return pa.table([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], names=names)


def _aligned(answers: pa.Table, what: str, part: str = "a", *, rising: bool = False) -> np.ndarray:
    rows = sorted((r["bucket"], r[part]) for r in answers.select(["what", "bucket", part]).to_pylist() if r["what"] == what and r[part] is not None)
    return np.concatenate([unpack(b, np.int64, rising=rising) for _, b in rows]) if rows else np.zeros(0, np.int64)


def _dense(v: np.ndarray) -> np.ndarray:
    """Numbers below 2**31 in the order of v."""
    low = v.min()
    return v - low if int(v.max()) - int(low) < 2**31 else np.unique(v, return_inverse=True)[1]


def _order(v: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Sorts by v, then by w = bucket << 32 | number."""
    v, w = _dense(v), (w >> 32) * (int((w & 0xFFFFFFFF).max()) + 1) + (w & 0xFFFFFFFF)
    span = int(w.max()) + 1
    return np.argsort(v * span + w) if (int(v.max()) + 1) * span < 2**63 else np.lexsort((w, v))


def _group(v: np.ndarray, w: np.ndarray, count: np.ndarray, p: np.ndarray):
    """Entries of the same (v, w), at least one: context, largest p, group of each entry, summed counts."""
    order = _order(v, w)
    new = _changes(v[order], w[order])
    start = np.flatnonzero(new)
    which = np.empty(len(v), dtype=np.int64)
    which[order] = np.cumsum(new) - 1
    return v[order[start]], np.maximum.reduceat(p[order], start), which, np.add.reduceat(count[order], start)


def _sums(v: np.ndarray, total: np.ndarray, p: np.ndarray):
    """For each different v (rising): v, numbers of words seen 1..LARGEST times, sum of larger counts, sum of P of seen words."""
    new = _changes(v)
    at = np.cumsum(new) - 1
    kinds = v[new]
    few = (total > 0) & (total <= LARGEST)
    n = np.bincount(at[few] * LARGEST + total[few] - 1, minlength=len(kinds) * LARGEST).reshape(-1, LARGEST)
    big = np.bincount(at, weights=np.where(total > LARGEST, total, 0), minlength=len(kinds))
    back = np.bincount(at, weights=np.where(total > 0, p, 0.0), minlength=len(kinds))
    return kinds, n, big.astype(np.int64), back


def _lower(model: Model, order: int, known: np.ndarray, below: np.ndarray | None) -> np.ndarray:
    """P of an n-gram's last word one order down, where that was seen."""
    if order == 2:
        return model.uni.p(known)
    return np.where(below & 1, discounted(known, model.orders[order - 3][0]), known) / np.maximum(below >> 1, 1)


@lean()
def _count(table: pa.Table, model: Model, order: int, last: bool) -> pa.Table:
    """Answers to each chunk, the sums of spread contexts, and the bucket's numbers of n-grams seen 1, 2, ... times."""
    rows, out = table.to_pylist(), []
    seen, done = np.zeros(LARGEST + 2, dtype=np.int64), 0
    for hot in (False, True):
        own = [r for r in rows if r["hot"] == hot]
        if not own:
            continue
        vs, many = [unpack(r["v"], np.int64, rising=True) for r in own], [unpack(r["many"], np.int64) for r in own]
        v = np.concatenate([np.repeat(a, m) for a, m in zip(vs, many, strict=True)])
        w, count, known = (np.concatenate([unpack(r[k], np.int64) for r in own]) for k in ("w", "count", "known"))
        below = np.concatenate([np.repeat(unpack(r["below"], np.int64), m) for r, m in zip(own, many, strict=True)]) if order > 2 else None
        p = np.where(count > 0, _lower(model, order, known, below), 0.0)
        del below, known
        gv, gp, which, total = _group(v, w, count, p)
        del v, w, count, p
        kinds, n, big, back = _sums(gv, total, gp)
        seen += np.array(_histogram(total))
        at = 0
        for r, a, m in zip(own, vs, many, strict=True):
            mine = which[at : at + int(m.sum())]
            t, number = total[mine], None if last else pack(mine + done, rising=True)
            at += len(mine)
            if hot:
                out.append((f"hot{order}", r["bucket"], r["chunk"], pack(t), None, number, None, None))
                continue
            i = np.searchsorted(kinds, a)
            unseen = np.add.reduceat((t == 0).astype(np.int64), np.cumsum(m) - m) > 0  # only these contexts back off
            out.append((f"gram{order}", r["bucket"], r["chunk"], pack(t), pack(np.concatenate([n[i].T.ravel(), big[i]])), number, pack(back[i[unseen]].view(np.int64)), None))
        if hot:
            out += [(f"sum{order}", rows[0]["bucket"], int(k), None, None, None, None, [*n[i].tolist(), int(big[i]), round(back[i] * SCALE)]) for i, k in enumerate(kinds)]
        done += len(total)
    out.append((f"stats{order}", rows[0]["bucket"], None, None, None, None, None, seen.tolist()))
    return _answer(out)


@lean()
def _score(left: pa.Table, right: pa.Table, model: Model) -> pa.Table:
    c = Chunk(left.to_pylist()[0])
    known, number = model.words(c, right)
    lower, p = model.uni.p(known), np.empty(len(c.at))
    discounts = iter(model.orders)
    for g in model.climb(c, right, known, number, len(model.orders) + 1):
        lower = g.p(lower, next(discounts)[0])
        here = g.which >= 0
        p[here] = lower[g.which[here]]
        del g  # before the next order is made
    base = np.log10((known + 0.5) / (model.uni.total + 0.5 * (model.uni.kinds + 1)))
    add = lambda x: np.add.reduceat(x, c.first)
    cols = [pa.array(c.docs, left.schema.field("docs").type.value_type), pa.array(c.sizes), pa.array(add((known > 0)[c.at].astype(np.int64))), pa.array(np.full(len(c.docs), model.uni.total)), pa.array(add(base[c.at])), pa.array(add(np.log10(p)))]
    return pa.table(cols, names=["doc_id", "n_tokens", "n_known", "train_tokens", "base_score", "score"])


def _asking(model: Model, order: int) -> Callable:
    return lambda a, b: _requests(a, b, model, order)


def _counting(model: Model, order: int, last: bool) -> Callable:
    return lambda t: _count(t, model, order, last)


def _added(answers: DataFrame, what: str, size: int) -> list:
    """Sums of n over the buckets, by chunk (of sums: the context)."""
    return answers.where(F.col("what") == what).groupBy("chunk").agg(*[F.sum(F.col("n")[i]).alias(f"n{i}") for i in range(size)]).orderBy("chunk").collect()


def score_texts(docs: DataFrame, train: Column, *, id_col: str = "doc_id", text_col: str = "text", order: int = 3) -> DataFrame:
    """doc_id, n_tokens, n_known, train_tokens, base_score, score of every row; learnt from the rows where train holds. order: of the longest n-grams, 2 or more."""
    if order < 2:
        raise ValueError("order is 2 or more")
    spark = docs.sparkSession
    made = make_chunks(docs, train, id_col, text_col)
    width = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    chunks = bucketed_table(made, "chunks", "chunk", max(width, 2 * made.rdd.getNumPartitions()))
    tokens = chunks.agg(F.sum("tokens")).first()[0] or 0
    buckets = max(16, math.ceil(tokens / BUCKET_TOKENS))
    deal = max(width, math.ceil(buckets / 4))  # partitions of the buckets: four a task at most

    def counted(asked: DataFrame, count: Callable, name: str) -> DataFrame:
        return scratch_table(asked.repartition(deal, "bucket").groupBy("bucket").applyInArrow(count, _ANSWER), name, end_shuffles=True)

    words = counted(_word_requests(chunks, buckets), lambda t: _count_words(t), "words")
    total, kinds, *n = [x or 0 for x in _added(words.withColumn("chunk", F.lit(0)), "table", LARGEST + 4)[0][1:]] if tokens else [0] * (LARGEST + 4)
    least = max(1, math.ceil(total / HOT))
    model = Model(buckets, Unigrams(total, kinds, n), _hot_words(words, least), least, [])
    answers = words.where("what = 'word'").drop("n")
    both = lambda: chunks.groupBy("chunk").cogroup(answers.groupBy("chunk"))
    for k in range(2, order + 1):
        done = Model(buckets, model.uni, model.hot, least, list(model.orders))
        found = counted(both().applyInArrow(_asking(done, k), _REQUEST), _counting(done, k, k == order), f"grams{k}")
        seen = _added(found, f"stats{k}", LARGEST + 2)
        d = katz_discounts(list(seen[0][1:]) if seen else [0] * (LARGEST + 2))
        hot = _added(found, f"sum{k}", LARGEST + 2)  # at most HOT of them
        facts = np.array([r[1:] for r in hot], dtype=np.int64).reshape(-1, LARGEST + 2)
        model.orders.append((d, np.array([r[0] for r in hot], dtype=np.int64), alpha_of(facts[:, :LARGEST], facts[:, LARGEST], facts[:, LARGEST + 1] / SCALE, d)))
        answers = answers.unionByName(found.where(F.col("what").isin(f"gram{k}", f"hot{k}")).drop("n"))
    kind = docs.schema[id_col].dataType.simpleString()
    return both().applyInArrow(lambda a, b: _score(a, b, model), f"doc_id {kind}, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def _hot_words(words: DataFrame, least: int) -> np.ndarray:
    """Sorted hashes of words with least training tokens or more (HOT at most, as least is 1/HOT of all), and the start."""

    def run(batches):
        for b in batches:
            for r in b.to_pylist():
                key, n = unpack(r["a"], np.uint64, rising=True), unpack(r["b"], np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(key[n >= least].view(np.int64), pa.int64())], names=["h"])

    found = map_arrow(words.where("what = 'table'").select("a", "b"), run, "h long").collect()
    return np.unique(np.array([START, *(np.int64(r["h"]).view(np.uint64) for r in found)], dtype=np.uint64))
