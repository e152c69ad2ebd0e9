"""Quality rules on repetition: characters inside duplicated n-grams and lines.

Words are hashed by a rolling polynomial hash (64 bits, per text), n-grams by
mixing their words' hashes; nothing leaves the task that reads a text.

Defined results: null text counts as empty: every count is 0 and the base rule
fails it. Repeated rows are judged one by one; an empty table gives no rows. A
share at its limit passes. Texts count whole, however long. Columns are found by
place, so others may have any names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import chosen, map_arrow, map_rows, text_blocks
from .textstats import SYMBOL, TextStats, sums

#: Most of a text's word characters that may lie in n-grams found twice or more (first included), by n.
NGRAM_SHARE = {5: 0.32, 6: 0.31, 7: 0.30, 8: 0.29, 9: 0.28, 10: 0.25}
#: Most of the line characters, and of the lines, that may be repeats of an earlier line.
LINE_CHAR_SHARE, LINE_SHARE = 0.20, 0.40
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def measure(texts) -> tuple[dict[str, np.ndarray], dict[str, np.ndarray]]:
    """Base counts, and shares of characters in duplicated n-grams and lines."""
    s = TextStats(texts)
    cover = s.covered(3)
    doc, chars, later, lines = s.lines()
    n_dup = np.bincount(doc, weights=later, minlength=len(texts)).astype(np.int64)
    counts = {"n_words": s.n_words, "word_chars": s.word_chars, "n_symbols": s.count_bytes(SYMBOL), "n_dup_lines": n_dup, "n_repeat_words": s.per_doc(cover)}
    share = {}
    all_chars = np.maximum(s.word_chars, 1)
    inner = cover
    for n in NGRAM_SHARE:
        inner = s.covered(n, inner)
        share[f"dup_{n}gram"] = sums(inner * s.word_points, s.first, s.last) / all_chars
    total = np.bincount(doc, weights=chars, minlength=len(texts))
    share["dup_line_chars"] = np.bincount(doc, weights=chars * later, minlength=len(texts)) / np.maximum(total, 1)
    share["dup_lines"] = n_dup / np.maximum(lines, 1)
    return counts, share


def repetition(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, base counts, shares (dup_<n>gram, dup_line_chars, dup_lines), base_failed and kept of every row."""
    shares = [*(f"dup_{n}gram" for n in NGRAM_SHARE), "dup_line_chars", "dup_lines"]
    docs = chosen(docs, doc_id=id_col, text=text_col)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        for b in batches:
            for t in text_blocks(b.column(1)):
                counts, share = measure(t)
                ids = b.column(0).slice(t.first, len(t))
                yield pa.RecordBatch.from_arrays([ids, *(pa.array(counts[c], pa.int64()) for c in COUNTS), *(pa.array(share[c], pa.float64()) for c in shares)], names=["doc_id", *COUNTS, *shares])

    schema = ", ".join([f"doc_id {kind}", *(f"{c} long" for c in COUNTS), *(f"{c} double" for c in shares)])
    out = map_arrow(docs.select("doc_id", F.col("text").cast("string")), run, schema)
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    good = (F.col("dup_line_chars") <= LINE_CHAR_SHARE) & (F.col("dup_lines") <= LINE_SHARE)
    for n, most in NGRAM_SHARE.items():
        good &= F.col(f"dup_{n}gram") <= most
    return out.withColumn("base_failed", failed).withColumn("kept", ~failed & good)


def keep_good(docs: DataFrame, *, text_col: str = "text") -> DataFrame:
    """docs without the rows whose text fails; all columns as they come."""
    at = docs.columns.index(text_col)

    def run(batches):
        for b in batches:
            keep = []
            for t in text_blocks(b.column(at)):
                c, share = measure(t)
                ok = ~((c["n_words"] < 50) | (100 * c["n_repeat_words"] > 50 * c["n_words"])) & (share["dup_line_chars"] <= LINE_CHAR_SHARE) & (share["dup_lines"] <= LINE_SHARE)
                for n, most in NGRAM_SHARE.items():
                    ok &= share[f"dup_{n}gram"] <= most
                keep.append(ok)
            yield b.filter(pa.array(np.concatenate(keep) if keep else np.zeros(0, dtype=bool)))

    return map_rows(docs, run)
