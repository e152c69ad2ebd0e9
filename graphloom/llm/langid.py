"""Language identification by a blended-spectrum n-gram presence kernel.

k(x, y) is the mean over n of |G_n(x) & G_n(y)| / sqrt(|G_n(x)| |G_n(y)|), with
G_n(x) the set of n-grams (of lower-cased UTF-8 bytes) present in the whole of
x, hashed to ``DIMS[n]`` cells. Nystrom landmarks Z give the features
phi(x) = K_ZZ^(-1/2) k(Z, x), on which one ridge regression is fitted for each
language against the rest. A score is sum_z a_z k(z, x): as k is linear in the
presence bits of x for each n, landmarks and coefficients fold into one matrix
of cells x languages for each n, and a batch of texts is scored by one matrix
product for each n.

Landmarks and training texts are a bounded sample (``train_rows`` for each
language at most, by a hash of the id); features of the sample come to the
driver as bits. Defined results: null text, or one without a letter, is ``und``
with score 0; equal scores go to the language of smaller code points. Without
any training language every row is ``und``. Equal rows get equal results; an
empty table gives no rows. Texts count whole, however long. Columns are found by
place, so others may have any names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWER, Texts, chosen, id_crc, map_arrow, text_blocks

#: Cells by n-gram length; unigrams are exact, longer ones hashed.
DIMS = {1: 1 << 8, 2: 1 << 13, 3: 1 << 14, 4: 1 << 14}
OFFSET = {n: sum(d for m, d in DIMS.items() if m < n) for n in DIMS}
WIDTH = sum(DIMS.values())
_MULT = {1: np.uint32(1), 2: np.uint32(2654435761), 3: np.uint32(2246822519), 4: np.uint32(3266489917)}
TRAIN_ROWS, LANDMARKS, RIDGE = 1500, 400, 1e-3
#: Docs whose bits stand together in memory, unpacked.
ROWS = 64


def presence(texts: Texts, lo: int, hi: int) -> np.ndarray:
    """Presence bits (rows x WIDTH, uint8) of docs lo to hi of a block."""
    out = np.zeros((hi - lo, WIDTH), dtype=np.uint8)
    for i in range(lo, hi):
        b = LOWER[texts.data[texts.starts[i] : texts.ends[i]]].astype(np.uint32)
        code = np.zeros(len(b) + 1, dtype=np.uint32)[: len(b)]
        row = out[i - lo]
        for n, d in DIMS.items():
            if len(b) < n:
                break
            code = b if n == 1 else (code[:-1] << np.uint32(8)) | b[n - 1 :]
            cell = code if n == 1 else (code * _MULT[n]) >> np.uint32(32 - (d.bit_length() - 1))
            row[OFFSET[n] + cell] = 1
    return out


def norms(bits: np.ndarray) -> np.ndarray:
    """1 / (number of ns * sqrt(|G_n|)) of each row and n."""
    out = np.stack([bits[:, OFFSET[n] : OFFSET[n] + d].sum(1, dtype=np.int64) for n, d in DIMS.items()], axis=1)
    return 1.0 / np.sqrt(np.maximum(out, 1))


def kernel(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Blended kernel of rows of presence bits."""
    na, nb = norms(a), norms(b)
    out = np.zeros((len(a), len(b)))
    for k, (n, d) in enumerate(DIMS.items()):
        s = slice(OFFSET[n], OFFSET[n] + d)
        out += (a[:, s].astype(np.float32) @ b[:, s].astype(np.float32).T) * na[:, k : k + 1] * nb[:, k]
    return out / len(DIMS)


def unpacked(packed: np.ndarray) -> np.ndarray:
    return np.unpackbits(packed, axis=1)[:, :WIDTH]


class KernelRidge:
    """One-versus-rest ridge regression on Nystrom features, folded to cell weights. packed: presence bits of the sample, eight a byte, unpacked by blocks of rows."""

    def __init__(self, packed: np.ndarray, lang: list[str], landmarks: int = LANDMARKS, ridge: float = RIDGE):
        self.langs = sorted(set(lang))
        y = np.array([[1.0 if v == c else -1.0 for c in self.langs] for v in lang])
        # landmarks: the same number of each language where there are as many, in the order of the sample
        by = [np.flatnonzero(y[:, c] > 0) for c in range(len(self.langs))]
        pick = np.sort(np.concatenate([ix[: max(1, landmarks // len(self.langs))] for ix in by]))
        z = unpacked(packed[pick])
        val, vec = np.linalg.eigh(kernel(z, z))
        ok = val > 1e-6 * val[-1]
        root = vec[:, ok] / np.sqrt(val[ok])
        phi = np.concatenate([kernel(unpacked(packed[i : i + 8 * ROWS]), z) for i in range(0, len(packed), 8 * ROWS)]) @ root
        weight = 1.0 / np.maximum((y > 0).sum(0), 1)  # languages count alike, however many rows they have
        self.bias = np.zeros(len(self.langs))
        beta = np.zeros((phi.shape[1], len(self.langs)))
        for c in range(len(self.langs)):
            w = np.where(y[:, c] > 0, weight[c], 1.0 / max((y[:, c] < 0).sum(), 1))
            w /= w.sum()
            mean, aim = w @ phi, w @ y[:, c]
            x = phi - mean
            beta[:, c] = np.linalg.solve((x * w[:, None]).T @ x + ridge * np.eye(phi.shape[1]), (x * w[:, None]).T @ (y[:, c] - aim))
            self.bias[c] = aim - mean @ beta[:, c]
        alpha = root @ beta  # landmarks x languages
        nz = norms(z)
        self.weights = [((z[:, OFFSET[n] : OFFSET[n] + d].astype(np.float64) * (nz[:, k : k + 1] / len(DIMS))).T @ alpha).astype(np.float32) for k, (n, d) in enumerate(DIMS.items())]

    def margins(self, bits: np.ndarray) -> np.ndarray:
        nb = norms(bits)
        out = np.tile(self.bias, (len(bits), 1))
        for k, (n, d) in enumerate(DIMS.items()):
            out += (bits[:, OFFSET[n] : OFFSET[n] + d].astype(np.float32) @ self.weights[k]) * nb[:, k : k + 1]
        return out


def has_letter(raw: bytes) -> bool:
    return any(c.isalpha() for c in raw.decode("utf-8", "replace"))


_ASCII_LETTER = np.zeros(256, dtype=bool)
_ASCII_LETTER[65:91] = _ASCII_LETTER[97:123] = True


def _lettered(t: Texts) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(_ASCII_LETTER[t.data])])
    out = total[t.ends] > total[t.starts]
    for i in np.flatnonzero(~out):
        out[i] = has_letter(t.raw(i))
    return out & ~t.null


def sample_bits(docs: DataFrame, lang_col: str, text_col: str, id_col: str, train_rows: int) -> tuple[np.ndarray, list[str]]:
    """Presence bits (eight a byte) and languages of train_rows rows of each language or a few more, by a hash of the id."""
    docs = chosen(docs, id=id_col, lang=lang_col, text=text_col).where("lang IS NOT NULL")
    count = {r[0]: r[1] for r in docs.groupBy("lang").count().collect()}
    if not count:
        return np.zeros((0, WIDTH // 8), dtype=np.uint8), []
    draw = F.pmod(F.xxhash64("id", F.lit("language")), F.lit(1 << 30)) / (1 << 30)
    rate = F.create_map(*[F.lit(x) for k, v in count.items() for x in (k, min(1.0, train_rows / v))])
    some = docs.where(draw < F.element_at(rate, F.col("lang")))

    def run(batches):
        for b in batches:
            for t in text_blocks(b.column(1)):
                ok = _lettered(t)
                langs = b.column(0).slice(t.first, len(t))
                for lo in range(0, len(t), ROWS):
                    bits = np.packbits(presence(t, lo, min(lo + ROWS, len(t))), axis=1)
                    keep = ok[lo : lo + ROWS]
                    yield pa.RecordBatch.from_arrays([langs.slice(lo, len(bits)).filter(pa.array(keep)), pa.array([x.tobytes() for x in bits[keep]], pa.binary())], names=["lang", "bits"])

    rows = map_arrow(some.select("lang", F.col("text").cast("string")), run, "lang string, bits binary").collect()  # train_rows x languages, 5 KB each
    rows.sort(key=lambda r: (r["lang"], bytes(r["bits"])))
    if not rows:
        return np.zeros((0, WIDTH // 8), dtype=np.uint8), []
    return np.frombuffer(b"".join(bytes(r["bits"]) for r in rows), dtype=np.uint8).reshape(len(rows), -1), [r["lang"] for r in rows]


def identify(docs: DataFrame, train: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", train_rows: int = TRAIN_ROWS, landmarks: int = LANDMARKS) -> DataFrame:
    """doc_id, lang_pred, score (0 to 1) of every row of docs, learnt from train's text and non-null languages."""
    bits, lang = sample_bits(train, lang_col, text_col, id_col, train_rows)
    model = KernelRidge(bits, lang, landmarks) if lang else None
    docs = chosen(docs, doc_id=id_col, text=text_col)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        for b in batches:
            for t in text_blocks(b.column(1)):
                ok = _lettered(t)
                for lo in range(0, len(t), ROWS):
                    hi = min(lo + ROWS, len(t))
                    pred, score = ["und"] * (hi - lo), np.zeros(hi - lo)
                    if model is not None:
                        m = model.margins(presence(t, lo, hi))
                        best = m.argmax(1)
                        e = np.exp(4 * (m - m.max(1, keepdims=True)))
                        score = np.where(ok[lo:hi], 1 / e.sum(1), 0.0)
                        pred = [model.langs[k] if g else "und" for k, g in zip(best, ok[lo:hi], strict=True)]
                    yield pa.RecordBatch.from_arrays([b.column(0).slice(t.first + lo, hi - lo), pa.array(pred, pa.string()), pa.array(score, pa.float64())], names=["doc_id", "lang_pred", "score"])

    return map_arrow(docs.select("doc_id", F.col("text").cast("string")), run, f"doc_id {kind}, lang_pred string, score double")


def held_out(id_col: str, modulus: int, remainder: int):
    return F.pmod(id_crc(id_col), F.lit(modulus)) == remainder
