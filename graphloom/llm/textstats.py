"""Repetition and character counts of many texts at once, in numpy over UTF-8 bytes."""

from __future__ import annotations

import numpy as np

from .common import RollingHash, Texts, code_points, mix64

SYMBOL = np.zeros(256, dtype=bool)
SYMBOL[[ord(c) for c in "#*$%&|<>"]] = True
_K = np.uint64(0x9FB21C651E98DF25)


def repeated(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each key: is it there twice or more; is it not the first of its kind."""
    order = np.argsort(keys, kind="stable")
    s = keys[order]
    same = s[1:] == s[:-1]
    twice, later = np.zeros(len(keys), dtype=bool), np.zeros(len(keys), dtype=bool)
    later[order[1:]] = same
    twice[order[1:]] = same
    twice[order[:-1]] |= same
    return twice, later


def sums(flags: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Sum of flags[start:end] for each range."""
    total = np.zeros(len(flags) + 1, dtype=np.int64)
    np.cumsum(flags, out=total[1:])
    return total[end] - total[start]


class TextStats:
    """Words, lines and repeated n-grams of the docs of a block."""

    def __init__(self, texts: Texts):
        self.texts = texts
        data = texts.data
        self.begin, self.end, self.n_words = texts.words()
        self.last = np.cumsum(self.n_words)
        self.first = self.last - self.n_words
        self.points = code_points(data)
        self.doc = np.repeat(np.arange(len(texts)), self.n_words)
        self.hash = RollingHash(data)
        self.salt = mix64(np.arange(1, len(texts) + 1, dtype=np.uint64))
        self.word = self.hash.ranges(self.begin, self.end) if len(self.begin) else np.zeros(0, dtype=np.uint64)
        self.word_points = self.points[self.end] - self.points[self.begin]
        self.word_chars = self.per_doc(self.word_points)

    def per_doc(self, values: np.ndarray) -> np.ndarray:
        return sums(values, self.first, self.last)

    def count_bytes(self, table: np.ndarray) -> np.ndarray:
        return sums(table[self.texts.data], self.texts.starts, self.texts.ends)

    def covered(self, n: int, within: np.ndarray | None = None) -> np.ndarray:
        """Is a word inside an n-word window found twice or more in its text. within: words outside it can't be."""
        w = len(self.word)
        out = np.zeros(w + 1, dtype=np.int32)
        if w >= n:
            ok = self.doc[: w - n + 1] == self.doc[n - 1 :]
            if within is not None:
                total = np.zeros(w + 1, dtype=np.int64)
                np.cumsum(within, out=total[1:])
                ok &= total[n:] - total[:-n] == n
            at = np.flatnonzero(ok)
            key = self.salt[self.doc[at]]
            for k in range(n):
                key = mix64(key * _K + self.word[at + k])
            hit = at[repeated(key)[0]]
            np.add.at(out, hit, 1)
            np.add.at(out, hit + n, -1)
        return np.cumsum(out[:-1]) > 0

    def lines(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Doc, code points, and whether it equals an earlier line, of each line with a word; all lines by doc."""
        t = self.texts
        cut = np.flatnonzero(t.data == 10)
        start = np.concatenate([t.starts, cut + 1])
        doc = np.concatenate([np.arange(len(t)), np.searchsorted(t.ends, cut, side="right")])
        order = np.lexsort((np.arange(len(start)), start, doc))
        start, doc = start[order], doc[order]
        end = np.empty_like(start)
        end[:-1] = start[1:] - 1
        lastline = np.ones(len(start), dtype=bool)
        lastline[:-1] = doc[1:] != doc[:-1]
        end[lastline] = t.ends[doc[lastline]]
        has = np.searchsorted(self.begin, end) > np.searchsorted(self.begin, start)
        start, end, doc = start[has], end[has], doc[has]
        key = mix64(self.salt[doc] * _K + self.hash.ranges(start, end)) if len(doc) else np.zeros(0, dtype=np.uint64)
        later = repeated(key)[1]
        return doc, self.points[end] - self.points[start], later, np.bincount(doc, minlength=len(t))
