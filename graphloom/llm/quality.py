"""Quality classifier: histogram gradient-boosted trees over document statistics.

Statistics come from the whole text in numpy. Labels are learnt from a bounded
sample of labelled rows (``TRAIN_ROWS``, by a hash of the id); only its
statistics reach the driver. Trees are grown there level by level on histograms
of ``BINS`` quantile bins and flattened into arrays (feature, threshold, value;
node k has children 2k + 1 and 2k + 2), so a batch goes down all trees by array
indexing.

Defined results: null text counts as empty and is scored like any other. A
document labelled more than once counts once for each label. Without any label
every score is 0.5. Equal rows get equal scores; a score at the threshold is
kept; an empty table gives no rows. Texts count whole, however long; the length
of the longest word counts up to 200. Columns are found by place, so others may
have any names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Texts, chosen, map_arrow, map_rows, text_blocks
from .textstats import SYMBOL, TextStats

TRAIN_ROWS, BINS, TREES, DEPTH, RATE, LEAF, L2 = 20_000, 64, 80, 5, 0.15, 20, 1.0


def _table(chars: str) -> np.ndarray:
    out = np.zeros(256, dtype=bool)
    out[[ord(c) for c in chars]] = True
    return out


_BYTES = {
    "upper": _table("ABCDEFGHIJKLMNOPQRSTUVWXYZ"), "lower": _table("abcdefghijklmnopqrstuvwxyz"), "digit": _table("0123456789"), "symbol": SYMBOL,
    "bang": _table("!?"), "bar": _table("|"), "stop": _table("."), "comma": _table(",;:"), "newline": _table("\n"), "at": _table("@/=_"), "bracket": _table("()[]{}\"'"),
}
_BYTES["high"] = np.arange(256) >= 128
FEATURES = (
    *(f"{k}_share" for k in _BYTES), "log_chars", "log_words", "word_mean", "word_spread", "word_longest", "short_share", "long_share", "distinct_share", "top_share",
    "next_same_share", "shout_share", "mark_share", "repeat3_share", "repeat5_share", "dup_line_share", "line_words", "once_share", "title_share",
)


def statistics(texts: Texts) -> np.ndarray:
    """Rows x FEATURES."""
    s = TextStats(texts)
    n = len(texts)
    size = np.maximum(texts.ends - texts.starts, 1)
    words = np.maximum(s.n_words, 1)
    cols = {f"{k}_share": s.count_bytes(v) / size for k, v in _BYTES.items()}
    length = s.word_points
    cols["log_chars"] = np.log1p(texts.ends - texts.starts)
    cols["log_words"] = np.log1p(s.n_words)
    cols["word_mean"] = s.per_doc(length) / words
    cols["word_spread"] = np.sqrt(np.maximum(s.per_doc(length * length) / words - cols["word_mean"] ** 2, 0))
    longest = np.zeros(n)
    np.maximum.at(longest, s.doc, np.minimum(length, 200))
    cols["word_longest"] = longest
    cols["short_share"] = s.per_doc(length <= 3) / words
    cols["long_share"] = s.per_doc(length >= 15) / words
    key = s.word ^ s.salt[s.doc] if len(s.word) else s.word
    order = np.argsort(key, kind="stable")
    k = key[order]
    new = np.ones(len(k), dtype=bool)
    new[1:] = k[1:] != k[:-1]
    at = np.flatnonzero(new)
    times = np.diff(np.append(at, len(k)))
    owner = s.doc[order][at]
    cols["distinct_share"] = np.bincount(owner, minlength=n) / words
    cols["once_share"] = np.bincount(owner, weights=times == 1, minlength=n) / words
    top = np.zeros(n)
    np.maximum.at(top, owner, times)
    cols["top_share"] = top / words
    same = np.zeros(len(key), dtype=bool)
    same[1:] = key[1:] == key[:-1]
    cols["next_same_share"] = s.per_doc(same) / words
    up = np.concatenate([[0], np.cumsum(_BYTES["upper"][texts.data])])
    low = np.concatenate([[0], np.cumsum(_BYTES["lower"][texts.data])])
    ups, lows = up[s.end] - up[s.begin], low[s.end] - low[s.begin]
    cols["shout_share"] = s.per_doc((ups >= 2) & (lows == 0)) / words
    cols["title_share"] = s.per_doc((ups == 1) & (lows > 0)) / words
    last = texts.data[s.end - 1] if len(s.end) else np.zeros(0, dtype=np.uint8)
    cols["mark_share"] = s.per_doc(SYMBOL[last] | _BYTES["bang"][last]) / words
    cover = s.covered(3)
    cols["repeat3_share"] = s.per_doc(cover) / words
    cols["repeat5_share"] = s.per_doc(s.covered(5, cover)) / words
    doc, _, later, lines = s.lines()
    cols["dup_line_share"] = np.bincount(doc, weights=later, minlength=n) / np.maximum(lines, 1)
    cols["line_words"] = s.n_words / np.maximum(lines, 1)
    return np.stack([np.asarray(cols[f], dtype=np.float32) for f in FEATURES], axis=1)


class BoostedTrees:
    """Logistic loss, second-order leaves; arrays feature, threshold and value of trees x nodes."""

    def __init__(self, x: np.ndarray, y: np.ndarray, *, trees: int = TREES, depth: int = DEPTH, rate: float = RATE, bins: int = BINS, leaf: int = LEAF):
        n, d = x.shape
        self.depth = depth
        nodes = 2 ** (depth + 1) - 1
        self.feature = np.zeros((trees, nodes), dtype=np.int32)
        self.threshold = np.full((trees, nodes), np.inf, dtype=np.float32)
        self.value = np.zeros((trees, nodes), dtype=np.float64)
        p = np.clip(y.mean(), 1e-3, 1 - 1e-3) if n else 0.5
        self.start = float(np.log(p / (1 - p)))
        if not n:
            return
        cuts = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, bins + 1)[1:-1], method="lower")) for f in range(d)]
        code = np.stack([np.searchsorted(c, x[:, f], side="left") for f, c in enumerate(cuts)], axis=1)  # code <= k: x <= cuts[k]
        flat = code + np.arange(d) * bins
        raw = np.full(n, self.start)
        for t in range(trees):
            prob = 1 / (1 + np.exp(-raw))
            g, h = prob - y, np.maximum(prob * (1 - prob), 1e-9)
            node = np.zeros(n, dtype=np.int64)
            for level in range(depth):
                lo, wide = 2**level - 1, 2**level
                cell = ((node - lo)[:, None] * (d * bins) + flat).ravel()
                total = wide * d * bins
                hist = [np.bincount(cell, weights=np.repeat(v, d), minlength=total).reshape(wide, d, bins).cumsum(2) for v in (g, h, np.ones(n))]
                left_g, left_h, left_n = hist
                all_g, all_h, all_n = (v[:, :1, -1:] for v in hist)
                gain = left_g**2 / (left_h + L2) + (all_g - left_g) ** 2 / (all_h - left_h + L2) - all_g**2 / (all_h + L2)
                gain[(left_n < leaf) | (all_n - left_n < leaf)] = -1
                for f, c in enumerate(cuts):
                    gain[:, f, len(c) :] = -1
                best = gain.reshape(wide, -1).argmax(1)
                good = gain.reshape(wide, -1)[np.arange(wide), best] > 1e-6
                f, k = best // bins, best % bins
                for i in np.flatnonzero(good):
                    self.feature[t, lo + i], self.threshold[t, lo + i] = f[i], cuts[f[i]][k[i]]
                node = 2 * node + 1 + (x[np.arange(n), self.feature[t, node]] > self.threshold[t, node])
            sum_g, sum_h = np.bincount(node, weights=g, minlength=nodes), np.bincount(node, weights=h, minlength=nodes)
            self.value[t] = -rate * sum_g / (sum_h + L2)
            raw += self.value[t, node]

    def predict(self, x: np.ndarray) -> np.ndarray:
        raw = np.full(len(x), self.start)
        rows = np.arange(len(x))
        for t in range(len(self.feature)):
            node = np.zeros(len(x), dtype=np.int64)
            for _ in range(self.depth):
                node = 2 * node + 1 + (x[rows, self.feature[t, node]] > self.threshold[t, node])
            raw += self.value[t, node]
        return 1 / (1 + np.exp(-raw))


def train(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", train_rows: int = TRAIN_ROWS) -> BoostedTrees:
    """Fit on train_rows labelled documents or a few more, chosen by a hash of the id."""
    labels = chosen(labels, __id=id_col, __y=label_col).where(F.col("__y").isin(0, 1)).withColumn("__y", F.col("__y").cast("double"))
    n = labels.count()
    draw = lambda c: F.pmod(F.xxhash64(F.col(c), F.lit("quality")), F.lit(1 << 30)) < int(min(1.0, train_rows / max(n, 1)) * (1 << 30))

    def run(batches):
        for b in batches:
            for t in text_blocks(b.column(1)):
                x = statistics(t)
                yield pa.RecordBatch.from_arrays([b.column(0).slice(t.first, len(t)), pa.array([r.tobytes() for r in x], pa.binary())], names=["__id", "x"])

    some = chosen(docs, __id=id_col, __t=text_col).where(draw("__id")).withColumn("__t", F.col("__t").cast("string"))
    kind = some.schema["__id"].dataType.simpleString()
    some = some.join(labels.where(draw("__id")).select("__id").distinct(), "__id", "left_semi")
    x = map_arrow(some, run, f"__id {kind}, x binary")
    rows = x.join(labels.where(draw("__id")), "__id").collect()  # about train_rows rows of 120 bytes
    rows = sorted((bytes(r["x"]), r["__y"]) for r in rows)
    feats = np.frombuffer(b"".join(r[0] for r in rows), dtype=np.float32).reshape(len(rows), len(FEATURES))
    return BoostedTrees(feats, np.array([r[1] for r in rows]))


def score(docs: DataFrame, model: BoostedTrees, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, score (0 to 1) of every row."""
    docs = chosen(docs, doc_id=id_col, text=text_col)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        for b in batches:
            for t in text_blocks(b.column(1)):
                p = model.predict(statistics(t))
                yield pa.RecordBatch.from_arrays([b.column(0).slice(t.first, len(t)), pa.array(p, pa.float64())], names=["doc_id", "score"])

    return map_arrow(docs.select("doc_id", F.col("text").cast("string")), run, f"doc_id {kind}, score double")


def keep_good(docs: DataFrame, model: BoostedTrees, *, text_col: str = "text", least: float = 0.3) -> DataFrame:
    """Rows of docs whose score is at least ``least``; all columns as they come."""
    at = docs.columns.index(text_col)

    def run(batches):
        for b in batches:
            keep = [model.predict(statistics(t)) >= least for t in text_blocks(b.column(at))]
            yield b.filter(pa.array(np.concatenate(keep) if keep else np.zeros(0, dtype=bool)))

    return map_rows(docs, run)
