"""Secret spans: fixed patterns, and a randomness battery on the other long tokens.

A token is a run of at least ``LEAST`` characters of the base64 alphabets (so a
token with dots, as a JWT, is tested in parts). Its signs are left out, and the
encoding inferred for the rest is the smallest alphabet that holds it. Three
tests measure how far it is from written language towards uniform randomness:
the chi-squared statistic against uniformity over that alphabet, the share of
neighbours of different class (digits, small letters, capitals; vowels, where
there is one class), and the lag-one serial correlation of the characters'
ranks. Their null distribution is simulated for each encoding and length, by
made-up tokens as people write them; the weights with which they are pooled to
one p-value follow from the same simulation and one of uniform tokens. A token
that fails a test of uniformity outright isn't random. False discoveries are
controlled by Benjamini-Hochberg within strata of length, over the tokens of the
whole table: p-values are counted in a histogram of fixed size, from which each
stratum's threshold follows, so short tokens with little power do not borrow
from long ones.

Defined results: null text counts as empty and has no span; spans are in code
points, end exclusive; a token that a fixed pattern covers isn't reported again.
Rows are kept as they come, repeated ones too; an empty table gives no rows.
Texts are scanned whole, in time linear in their length. Columns are found by
place, so others may have any names.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_right
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import map_arrow, numbered, scratch_table

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
#: Shortest token tested. Half of the random base62 tokens of 16 characters stand out among a few dozen others; ordinary words of fewer are too many.
LEAST = 16
TOKEN = re.compile(r"[A-Za-z0-9+/_=-]{%d,}" % LEAST)
KINDS = ("assign", "access", "hex", "random")
#: Share of false ones among the tokens reported as random in a stratum, at most.
RATE = 1e-2

DIGIT, LOW, UP, SIGN = "0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "+/-_="
#: Alphabets by inferred encoding, smallest first; signs aside.
ALPHABETS = {
    "decimal": DIGIT, "hex": DIGIT + LOW[:6], "hex_upper": DIGIT + UP[:6], "lower": LOW, "upper": UP, "base32": UP + "234567",
    "base36": DIGIT + LOW, "base36_upper": DIGIT + UP, "letters": UP + LOW, "base62": DIGIT + UP + LOW,
}
#: Model of ordinary tokens, fixed values: percent of a to z in written European languages; chances that a vowel or a
#: consonant is followed by a vowel, that a word is an abbreviation and that of a vowel in it, that digits follow a word,
#: and that a word is in capitals where cases are mixed.
LETTER = (8.2, 1.5, 2.8, 4.3, 12.7, 2.2, 2.0, 6.1, 7.0, 0.2, 0.8, 4.0, 2.4, 6.7, 7.5, 1.9, 0.1, 6.0, 6.3, 9.1, 2.8, 1.0, 2.4, 0.2, 2.0, 0.1)
VOWEL_AFTER, ABBREVIATED, DIGITS_AFTER, CAPITALS = (0.15, 0.55), (0.25, 0.25), 0.4, 0.15
#: Share of 0 to 9 in numbers that people write, and the chance that a number of digits alone repeats its last one.
NUMERAL, REPEATED = (0.2, 0.2, 0.2, 0.07, 0.06, 0.06, 0.05, 0.05, 0.05, 0.06), 0.25
#: Simulated tokens of each kind, for each encoding and length; longer tokens than EXACT use the next shorter of some lengths.
SIMULATED, EXACT = 4000, 64
#: A token that fails a test of randomness by so many standard deviations isn't random, whatever else it is.
FAILS = 4.0
STRATA = (20, 24, 28, 32, 48, 80)
#: Histogram of -log10 p: cells of 1/20, up to 30.
CELLS, SCALE = 600, 20

_RANK = {name: np.array([a.find(chr(c)) for c in range(128)]) for name, a in ALPHABETS.items()}
_SETS = [(name, frozenset(a)) for name, a in ALPHABETS.items()]
_KIND = np.array([0 if chr(c) in DIGIT else 1 if chr(c) in LOW else 2 for c in range(128)])
_VOWEL = np.array([chr(c) in "aeiouAEIOU" for c in range(128)])
_SIGNS = str.maketrans("", "", SIGN)


def infer_encoding(core: str) -> str:
    """Name of the smallest alphabet that holds the token, whose signs are gone."""
    have = set(core)
    return next(name for name, chars in _SETS if have <= chars)


def measures(codes: np.ndarray, encoding: str) -> np.ndarray:
    """Tests of tokens of one length (rows of ASCII codes): chi-squared against uniformity a character, share of changes of class, lag-one serial correlation."""
    m, n = codes.shape
    x, k = _RANK[encoding][codes], len(ALPHABETS[encoding])
    seen = np.bincount((np.arange(m)[:, None] * k + x).ravel(), minlength=m * k).reshape(m, k)
    chi = ((seen.astype(float) ** 2).sum(1) * k / n - n) / n
    if encoding == "decimal":
        side = x >= 5
    elif encoding in ("lower", "upper"):
        side = _VOWEL[codes]
    else:  # a capital before a small letter starts a word: it is no change
        side = _KIND[codes]
        side[:, :-1][(side[:, :-1] == 2) & (side[:, 1:] == 1)] = 1
    runs = (side[:, 1:] != side[:, :-1]).mean(1)
    far = x - x.mean(1, keepdims=True)
    serial = (far[:, 1:] * far[:, :-1]).sum(1) / np.maximum((far**2).sum(1), 1e-9)
    return np.stack([chi, runs, serial], axis=1)


def ordinary(encoding: str, many: int, n: int, rng: np.random.Generator) -> np.ndarray:
    """Codes of made-up tokens as people write them in this alphabet: words, names in mixed case, numbers and dates among them."""
    have = ALPHABETS[encoding]
    digits = [c for c in have if c in DIGIT]
    small = not any(c in LOW for c in have)
    share = np.array([LETTER[i] if LOW[i] in have or UP[i] in have else 0 for i in range(26)])
    vowel = np.array([c in "aeiou" for c in LOW])
    out = np.empty((many, n), dtype=np.int64)
    if encoding == "decimal":
        draw = rng.choice(10, (many, n), p=NUMERAL)
        for j in range(n):
            out[:, j] = np.where(rng.random(many) < REPEATED, out[:, j - 1], draw[:, j] + 48) if j else draw[:, j] + 48
        return out
    letters = [rng.choice(26, (many, n), p=share * is_v / (share * is_v).sum()) for is_v in (vowel, ~vowel)]
    numbers = rng.choice(10, (many, n), p=NUMERAL) + 48 if len(digits) == 10 else rng.choice([ord(c) for c in digits] or [48], (many, n))
    left, number, capital, was, short = np.zeros(many, int), np.ones(many, bool), np.full(many, small), np.zeros(many, bool), np.zeros(many, bool)
    mixed = any(c in LOW for c in have) and any(c in UP for c in have)
    for j in range(n):
        new = left == 0
        number = np.where(new, ~number & (rng.random(many) < (DIGITS_AFTER if digits else 0)), number)
        left = np.where(new, np.where(number, rng.choice([1, 2, 3, 4], many, p=[0.3, 0.3, 0.1, 0.3]), np.minimum(2 + rng.geometric(0.2, many), 14)), left)
        capital = np.where(new, small | (mixed & (rng.random(many) < CAPITALS)), capital)
        short = np.where(new, rng.random(many) < ABBREVIATED[0], short)
        is_v = rng.random(many) < np.where(short, ABBREVIATED[1], np.where(was & ~new, VOWEL_AFTER[0], VOWEL_AFTER[1]))
        letter = np.where(is_v, letters[0][:, j], letters[1][:, j]) + np.where(capital | (mixed & new), 65, 97)
        out[:, j] = np.where(number, numbers[:, j], letter)
        was, left = is_v & ~number, left - 1
    return out


@lru_cache(maxsize=4096)
def calibration(encoding: str, n: int) -> tuple[np.ndarray, ...]:
    """Of tokens of n characters, simulated: means and deviations of the tests for ordinary and for random ones, the weights of the tests, and the scale of their sum.

    Weights are those of the best linear rule between the two. The scale is the
    deviation of the weighted sum for ordinary tokens, or more where its 999th
    thousandth lies further out than a normal's.
    """
    rng = np.random.default_rng([n, *encoding.encode()])
    usual = measures(ordinary(encoding, SIMULATED, n, rng), encoding)
    chars = np.array([ord(c) for c in ALPHABETS[encoding]])
    chance = measures(chars[rng.integers(0, len(chars), (SIMULATED, n))], encoding)
    mean, mean1 = usual.mean(0), chance.mean(0)
    weight = np.linalg.solve((np.cov(usual.T) + np.cov(chance.T)) / 2 + 1e-9 * np.eye(3), mean1 - mean)
    weight = np.where(weight * (mean1 - mean) > 0, weight, 0.0)
    total = (_short_of(usual, mean, mean1) - mean) @ weight
    z = (total - total.mean()) / total.std()
    scale = total.std() * max(1.0, float(np.quantile(z, 0.999)) / 3.09, float(np.quantile(z, 0.99)) / 2.326)
    return mean, mean1, np.maximum(chance.std(0), 1e-9), weight, np.array([total.mean(), scale])


def _short_of(x: np.ndarray, mean: np.ndarray, mean1: np.ndarray) -> np.ndarray:
    """Measures, those beyond the mean of random tokens moved back to it."""
    return np.where(mean1 > mean, np.minimum(x, mean1), np.maximum(x, mean1))


def battery(token: str) -> tuple[str, float, float, float, float]:
    """Encoding, the three tests' z-scores against ordinary tokens (high: random), and the pooled p-value."""
    core = token.translate(_SIGNS)
    if len(core) < 8:
        return "signs", 0.0, 0.0, 0.0, 1.0
    encoding, n = infer_encoding(core), len(core)
    grid = n if n <= EXACT else int(2 ** (math.floor(4 * math.log2(n)) / 4))
    mean, mean1, deviation, weight, (middle, scale) = calibration(encoding, min(grid, 2048))
    x = measures(np.frombuffer(core.encode(), dtype=np.uint8).astype(np.int64)[None], encoding)
    each = np.sign(mean1 - mean) * (x[0] - mean) / deviation
    z = (float((_short_of(x, mean, mean1)[0] - mean) @ weight) - middle) / scale
    # a longer token than those simulated varies less, so z is too small rather than too large
    p = 1.0 if (np.abs(x[0] - mean1) > FAILS * deviation * math.sqrt(grid / n)).any() else 0.5 * math.erfc(z / math.sqrt(2))
    return encoding, *each.tolist(), p


def base_spans(text: str) -> list[tuple[int, int, str]]:
    out = [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        out += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    return out + [(m.start(), m.end(), "hex") for m in HEX.finditer(text)]


def stratum(n: int) -> int:
    return sum(n >= s for s in STRATA)


def cell(p: float) -> int:
    return min(CELLS - 1, int(-SCALE * math.log10(max(p, 1e-300))))


def other_tokens(text: str, spans: list[tuple[int, int, str]]) -> list[tuple[int, int, str]]:
    """Start, end, token of the long tokens that no span touches."""
    starts, ends, last = [], [], 0
    for s, e, _ in sorted(spans):  # their union, in order
        if starts and s <= last:
            ends[-1] = last = max(last, e)
        else:
            starts.append(s)
            ends.append(e)
            last = e
    out = []
    for m in TOKEN.finditer(text):
        k = bisect_right(starts, m.end() - 1) - 1  # the last span that starts before the token's end
        if k < 0 or ends[k] <= m.start():
            out.append((m.start(), m.end(), m[0]))
    return out


_EVIDENCE = "array<struct<s: long, e: long, k: int>>", "array<struct<s: long, e: long, h: int, c: int>>"


def _evidence(df: DataFrame, text_at: int) -> DataFrame:
    """df with fixed spans (start, end, kind) and tested tokens (start, end, stratum, cell of p) of the text in column text_at."""

    def run(batches):
        kinds = [pa.list_(pa.struct([("s", pa.int64()), ("e", pa.int64()), *x])) for x in ([("k", pa.int32())], [("h", pa.int32()), ("c", pa.int32())])]
        for b in batches:
            fixed, tested = [], []
            for text in b.column(text_at).to_pylist():
                text = text or ""
                spans = base_spans(text)
                fixed.append([{"s": s, "e": e, "k": KINDS.index(k)} for s, e, k in sorted(spans, key=lambda x: (x[0], KINDS.index(x[2])))])
                tested.append([{"s": s, "e": e, "h": stratum(e - s), "c": cell(battery(t)[4])} for s, e, t in other_tokens(text, spans)])
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(fixed, kinds[0]), pa.array(tested, kinds[1])], names=[*b.schema.names, "fixed", "tested"])

    schema = T.StructType([*df.schema.fields, *T.StructType.fromDDL(f"fixed {_EVIDENCE[0]}, tested {_EVIDENCE[1]}").fields])
    return map_arrow(df, run, schema)


def _least(found: DataFrame, rate: float) -> list[int]:
    counts = found.select(F.inline("tested")).groupBy("h", "c").count().collect()  # strata x cells rows at most
    return thresholds([tuple(r) for r in counts], rate)


def thresholds(counts: list[tuple[int, int, int]], rate: float) -> list[int]:
    """Least cell accepted in each stratum: Benjamini-Hochberg on a histogram of (stratum, cell, number)."""
    out = []
    for h in range(len(STRATA) + 1):
        n = np.zeros(CELLS + 1, dtype=np.int64)
        for s, c, k in counts:
            if s == h:
                n[c] += k
        total, least, above = int(n.sum()), CELLS, 0
        for c in range(CELLS - 1, -1, -1):
            above += int(n[c])
            if above and 10 ** (-c / SCALE) * total <= rate * above:  # every p of the cell is at most this
                least = c
        out.append(least)
    return out


def find_secrets(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", rate: float = RATE) -> DataFrame:
    """doc_id, k1, k2 and spans: array of (start, end, kind) by start, then kind, of every row of docs."""
    own, text = (F.col(f"c{docs.columns.index(c)}") for c in (id_col, text_col))
    rows = numbered(docs).select(own.alias("doc_id"), F.xxhash64(own, text).alias("k1"), F.hash(F.lit("row"), text, own).alias("k2"), text.cast("string").alias("text"))
    found = scratch_table(_evidence(rows, 3).drop("text"), "secrets")
    least = _least(found, rate)
    new = F.transform(F.filter("tested", lambda t: t["c"] >= F.get(F.array(*[F.lit(x) for x in least]), t["h"])), lambda t: F.struct(t["s"].alias("s"), t["e"].alias("e"), F.lit(KINDS.index("random")).alias("k")))
    spans = F.transform(F.array_sort(F.concat(F.transform("fixed", lambda t: F.struct(t["s"].alias("s"), t["k"].alias("k"), t["e"].alias("e"))), F.transform(new, lambda t: F.struct(t["s"].alias("s"), t["k"].alias("k"), t["e"].alias("e"))))), lambda t: F.struct(t["s"].alias("start"), t["e"].alias("end"), F.get(F.array(*[F.lit(k) for k in KINDS]), t["k"]).alias("kind")))
    return found.select("doc_id", "k1", "k2", spans.alias("spans"))


def redact(docs: DataFrame, *, text_col: str = "text", rate: float = RATE, mark: str = "[secret]") -> DataFrame:
    """docs with each secret span of text_col replaced by mark; overlapping spans become one mark. No row goes.

    The texts are scanned once: rows wait with their evidence in a scratch table
    until the p-values of all are counted. They are not shuffled.
    """
    at, width = docs.columns.index(text_col), len(docs.columns)
    found = scratch_table(_evidence(numbered(docs), at), "evidence")
    least = _least(found, rate)
    names = docs.columns

    def run(batches):
        for b in batches:
            spans = [[(x["s"], x["e"], "") for x in f] + [(x["s"], x["e"], "") for x in t if x["c"] >= least[x["h"]]] for f, t in zip(b.column(width).to_pylist(), b.column(width + 1).to_pylist(), strict=True)]
            hit = [i for i, x in enumerate(spans) if x]
            cols = b.columns[:width]
            if hit:
                text = b.column(at).to_pylist()
                for i in hit:
                    text[i] = blanked(text[i], spans[i], mark)
                cols[at] = pa.array(text, b.schema.field(at).type)
            yield pa.RecordBatch.from_arrays(cols, names=names)

    return map_arrow(found, run, docs.schema)


def blanked(text: str, spans: list[tuple[int, int, str]], mark: str) -> str:
    """text with the union of the spans replaced by mark."""
    out, done, last = [], 0, -1
    for s, e, _ in sorted(spans):
        if s >= done or last < 0:
            out += [text[done:s], mark]
        done = max(done, e)
        last = e
    return "".join(out) + text[done:] if spans else text
