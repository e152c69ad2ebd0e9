"""Byte-level BPE of many texts: pieces are found in numpy, and each different piece is encoded once.

The ids are those of the tokenizer file. A text that holds the string of a
special token goes through the tokenizer itself. Needs the tokenizer's path; no
vocabulary is part of this package.
"""

from __future__ import annotations

import json

import numpy as np

from .common import RollingHash, Texts

BLANK, SPACE, LETTER, NUMBER, OTHER = range(5)
#: Different pieces remembered by a worker before it starts anew.
REMEMBER = 600_000
_STATE: dict = {}


def _classes() -> np.ndarray:
    """Class of each code point."""
    if "classes" not in _STATE:
        import regex

        out = np.full(0x110000, OTHER, dtype=np.uint8)
        for lo, hi in ((0, 0xD800), (0xE000, 0x110000)):
            text = "".join(map(chr, range(lo, hi)))
            for name, cls in ((r"\p{L}+", LETTER), (r"\p{N}+", NUMBER), (r"\p{White_Space}+", SPACE)):
                for m in regex.finditer(name, text):
                    out[lo + m.start() : lo + m.end()] = cls
        out[0x20] = BLANK
        _STATE["classes"] = out
    return _STATE["classes"]


def pieces(points: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Where pieces of the byte-level pre-tokenizer start among code points; texts start at first (not empty ones)."""
    n = len(points)
    cls = _classes()[points]
    kind = np.where(cls == BLANK, SPACE, cls)
    edge = np.ones(n, dtype=bool)
    edge[1:] = kind[1:] != kind[:-1]
    fresh = np.zeros(n + 1, dtype=bool)
    fresh[first] = True
    fresh[n] = True
    edge |= fresh[:n]
    run = np.flatnonzero(edge)
    stop = np.append(run[1:], n)
    white = kind[run] == SPACE
    start = np.zeros(n + 1, dtype=bool)
    start[run[white]] = True
    inner = white & ~fresh[stop]  # white space before something else of the same text: its last character stands apart
    start[stop[inner] - 1] = True
    solid = run[~white]
    joined = np.zeros(len(solid), dtype=bool)
    ok = ~fresh[solid]
    joined[ok] = cls[solid[ok] - 1] == BLANK
    start[solid[~joined]] = True
    # contractions: an apostrophe that starts a piece and stands alone before s, t, m, d, re, ve or ll
    length = stop - run
    lone = (points[run] == 39) & (length == 1) & start[run]
    lone[:-1] &= (kind[run[1:]] == LETTER) & ~fresh[run[1:]] if len(run) > 1 else True
    lone[-1:] = False
    at = run[lone]
    if len(at):
        after = stop[np.flatnonzero(lone) + 1]
        a = points[at + 1]
        b = np.where(at + 2 < after, points[np.minimum(at + 2, n - 1)], 0)
        one = np.isin(a, [ord(c) for c in "stmd"])
        two = ((a == ord("r")) & (b == ord("e"))) | ((a == ord("v")) & (b == ord("e"))) | ((a == ord("l")) & (b == ord("l")))
        take = np.where(one, 1, np.where(two, 2, 0))
        at, after, take = at[take > 0], after[take > 0], take[take > 0]
        start[at + 1] = False
        more = at + 1 + take < after
        start[(at + 1 + take)[more]] = True
    return np.flatnonzero(start[:n])


class Encoder:
    """Ids of whole texts by the byte-level BPE tokenizer at path."""

    def __init__(self, path: str):
        import tiktoken
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.special = [t["content"] for t in spec.get("added_tokens", [])]
        unicode_of = _byte_letters()
        back = {c: b for b, c in unicode_of.items()}
        special = set(self.special)
        ranks = {bytes(back[c] for c in k): v for k, v in spec["model"]["vocab"].items() if k not in special}
        self.fast = all(c in (None, {}) for c in (spec.get("normalizer"),)) and not (spec["model"].get("dropout") or spec["model"].get("ignore_merges"))
        # merges in the order of ids: ids of merged tokens then rank the merges
        order = [bytes(back[c] for c in (m if isinstance(m, str) else " ".join(m)).replace(" ", "")) for m in spec["model"]["merges"]]
        self.fast &= all(ranks[a] < ranks[b] for a, b in zip(order, order[1:], strict=False))
        self.core = tiktoken.Encoding("own", pat_str=r"\S+|\s+", mergeable_ranks=ranks, special_tokens={})._core_bpe if self.fast else None
        self._forget()

    def _forget(self) -> None:
        self.keys, self.at, self.size = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.flat = np.zeros(0, np.uint32)

    def _learn(self, keys: np.ndarray, start: np.ndarray, end: np.ndarray, raw: bytes) -> None:
        """Encode pieces not seen before; keys are sorted and different."""
        if len(self.keys) > REMEMBER:
            self._forget()
        if len(self.keys):
            k = np.searchsorted(self.keys, keys)
            k[k == len(self.keys)] = 0
            new = self.keys[k] != keys
            keys, start, end = keys[new], start[new], end[new]
        if not len(keys):
            return
        single = self.core.encode_single_piece
        ids = [single(raw[s:e]) for s, e in zip(start.tolist(), end.tolist(), strict=True)]
        size = np.fromiter(map(len, ids), dtype=np.int64, count=len(ids))
        flat = np.fromiter((x for i in ids for x in i), dtype=np.uint32, count=int(size.sum()))
        at = len(self.flat) + np.cumsum(size) - size
        self.flat = np.concatenate([self.flat, flat])
        where = np.searchsorted(self.keys, keys)
        self.keys, self.at, self.size = (np.insert(a, where, b) for a, b in ((self.keys, keys), (self.at, at), (self.size, size)))

    def encode(self, texts: Texts, end_id: int | None = 0) -> list[np.ndarray]:
        """Ids (uint32) of each text, then end_id."""
        tail = np.zeros(0, np.uint32) if end_id is None else np.array([end_id], np.uint32)
        slow = [i for i in range(len(texts)) if not self.fast] if not self.fast else self._special(texts)
        out: list[np.ndarray] = []
        if self.fast and len(texts.data):
            raw = texts.data.tobytes()
            points = np.frombuffer(raw.decode("utf-8").encode("utf-32-le"), dtype=np.uint32)
            size = 1 + (points >= 0x80).astype(np.int64) + (points >= 0x800) + (points >= 0x10000)
            byte_at = np.zeros(len(points) + 1, dtype=np.int64)
            np.cumsum(size, out=byte_at[1:])
            full = texts.starts < texts.ends
            begin = pieces(points, np.searchsorted(byte_at, texts.starts[full]))
            s = byte_at[begin]
            e = np.append(s[1:], len(raw))
            key = RollingHash(texts.data).ranges(s, e)
            order = np.argsort(key)
            new = np.ones(len(order), dtype=bool)
            new[1:] = key[order[1:]] != key[order[:-1]]
            pick = order[new]
            self._learn(key[pick], s[pick], e[pick], raw)
            known = np.searchsorted(self.keys, key[pick])
            which = np.empty(len(order), dtype=np.int64)
            which[order] = known[np.cumsum(new) - 1]
            at, many = self.at[which], self.size[which]
            stop = np.cumsum(many)
            ids = self.flat[np.arange(int(stop[-1])) + np.repeat(at - (stop - many), many)]
            edge = np.concatenate([[0], stop])
            lo, hi = edge[np.searchsorted(s, texts.starts)], edge[np.searchsorted(s, texts.ends)]
            out = [np.concatenate([ids[a:b], tail]) for a, b in zip(lo.tolist(), hi.tolist(), strict=True)]
        else:
            out = [tail] * len(texts)
        for i in slow:
            text = texts.raw(i).decode("utf-8")
            out[i] = np.concatenate([np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype=np.uint32), tail])
        return out

    def _special(self, texts: Texts) -> list[int]:
        raw = texts.data.tobytes()
        found = set()
        for s in self.special:
            k = raw.find(s.encode())
            while k >= 0:
                i = int(np.searchsorted(texts.ends, k, side="right"))
                found.add(i)
                k = raw.find(s.encode(), k + 1)
        return sorted(found)


def _byte_letters() -> dict[int, str]:
    """The printable stand-in of each byte in byte-level vocabularies: printable Latin-1 as is, the others from 256 on."""
    keep = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out = {b: chr(b) for b in keep}
    out.update({b: chr(256 + k) for k, b in enumerate(b for b in range(256) if b not in out)})
    return out


def encoder(path: str) -> Encoder:
    """One encoder for each worker and path."""
    if ("encoder", path) not in _STATE:
        _STATE["encoder", path] = Encoder(path)
    return _STATE["encoder", path]
