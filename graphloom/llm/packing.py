"""Vector bin packing of examples into fixed-size training sequences.

Items have three sizes: tokens, segments and loss-bearing tokens, each with a
limit that a sequence keeps. A sequence is filled by the dot-product heuristic:
of the items that fit in every dimension, take the one with the largest product
of its sizes and what is left of the sequence, all as shares of the limits. When
no item fits into a gap of ``cut_from`` tokens or more, the largest item is cut
to fill it, where items may be cut. Items wait in a window of bounded size within
their task, so nothing is shuffled and ids never leave the task that tokenizes
them, until they go out.

``pack_texts`` packs documents: each piece is one segment, and all its ids bear
loss but a document's first. Texts longer than a sequence are cut into full ones
first, and what is left at a task's end into sequences of powers of two, which
need no padding; all limits hold there too. ``pack_rows`` packs uncut examples
of given sizes, as instruction data: turns are segments, and answers bear loss.

Sequence ids hold the task's partition in their high bits, so a repeated task
gives the same ones. Defined results: null text counts as empty and gives its
end id alone; repeated rows are packed one by one; items of equal product are
taken by larger sizes; very long texts are cut as any; an empty table gives no
rows. Columns are found by place, so others may have any names.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import encoder
from .common import map_arrow, numbered, text_blocks

SIZE, SEGMENTS, LOSS, CUT_FROM = 1024, 32, 1024, 24
#: Items and tokens that wait in a task.
WINDOW_ITEMS, WINDOW_TOKENS = 30_000, 8_000_000


class Packer:
    """Fills sequences from items of kind (tokens, segments, loss); payloads are cut by ``cut(payload, n)`` to (head, kind, tail, kind)."""

    def __init__(self, size: int = SIZE, segments: int = SEGMENTS, loss: int = LOSS, cut_from: int = CUT_FROM, cut=None):
        self.limit = np.array([size, segments, loss], dtype=np.int64)
        if self.limit.min() < 1:
            raise ValueError("each limit must be 1 or more")
        self.cut_from, self.cut = cut_from, cut
        self.stock: dict[tuple[int, int, int], list] = defaultdict(list)
        self.items = self.tokens = 0

    def fits(self, kind: tuple[int, int, int]) -> bool:
        return all(a <= b for a, b in zip(kind, self.limit, strict=True))

    def add(self, kind: tuple[int, int, int], payload) -> None:
        if not self.fits(kind):
            raise ValueError("an item is larger than a sequence")
        self.stock[kind].append(payload)
        self.items += 1
        self.tokens += kind[0]

    def _take(self, kind: tuple[int, int, int]):
        self.items -= 1
        self.tokens -= kind[0]
        return self.stock[kind].pop()

    def fill(self, down_to: int) -> Iterator[list]:
        """Payloads of one sequence after the other, while more than down_to tokens wait."""
        names = sorted(k for k, v in self.stock.items() if v)
        where = {k: i for i, k in enumerate(names)}
        kinds = np.array(names, dtype=np.int64).reshape(-1, 3)
        have = np.array([len(self.stock[k]) for k in names], dtype=np.int64)
        while self.items and self.tokens > down_to:
            room, out = self.limit.copy(), []
            while room[0] and room[1]:
                product = np.where((have > 0) & (kinds <= room).all(1), kinds / self.limit**2.0 @ room, -1.0)
                best = len(product) - 1 - int(product[::-1].argmax())
                if product[best] >= 0:
                    have[best] -= 1
                    kind = names[best]
                    payload = self._take(kind)
                elif self.cut and min(room[0], room[2]) >= self.cut_from and (have > 0).any():
                    best = len(have) - 1 - int((have > 0)[::-1].argmax())
                    have[best] -= 1
                    payload, kind, tail, rest = self.cut(self._take(names[best]), int(min(room[0], room[2], names[best][0] - 1)))
                    self.add(rest, tail)
                    if rest in where:
                        have[where[rest]] += 1
                    else:
                        at = int(np.searchsorted(kinds[:, 0] * (1 << 40) + kinds[:, 1] * (1 << 20) + kinds[:, 2], rest[0] * (1 << 40) + rest[1] * (1 << 20) + rest[2]))
                        names.insert(at, rest)
                        kinds, have = np.insert(kinds, at, rest, axis=0), np.insert(have, at, 1)
                        where = {k: i for i, k in enumerate(names)}
                else:
                    break
                out.append(payload)
                room -= kind
            yield out

    def rest(self) -> list:
        """All that waits, largest first."""
        out = [p for k in sorted(self.stock, reverse=True) for p in self.stock[k]]
        self.stock.clear()
        self.items = self.tokens = 0
        return out


class _Piece:
    __slots__ = ("doc", "ids", "start", "total")

    def __init__(self, doc, start, ids, total):
        self.doc, self.start, self.ids, self.total = doc, start, ids, total

    @property
    def kind(self) -> tuple[int, int, int]:
        """Tokens, one segment, loss-bearing tokens: a document's first id has nothing to be predicted from."""
        return len(self.ids), 1, len(self.ids) - (self.start == 0)

    def split(self, n: int) -> tuple[_Piece, _Piece]:
        return _Piece(self.doc, self.start, self.ids[:n], self.total), _Piece(self.doc, self.start + n, self.ids[n:].copy(), self.total)


def _cut(piece: _Piece, n: int):
    head, tail = piece.split(n)
    return head, head.kind, tail, tail.kind


def last_sequences(left: list[_Piece], segments: int, loss: int) -> Iterator[list[_Piece]]:
    """Sequences of powers of two of tokens, within the limits, of all the pieces."""
    left = left[::-1]
    while left:
        row, tokens, bears = [], 0, 0
        while left and len(row) < segments and bears + left[-1].kind[2] <= loss:
            row.append(left.pop())
            tokens, bears = tokens + row[-1].kind[0], bears + row[-1].kind[2]
        if not row:  # a piece of more loss than a sequence may have
            head, tail = left.pop().split(loss)
            row, tokens = [head], loss
            left.append(tail)
        over = tokens - (1 << (tokens.bit_length() - 1))
        while over >= len(row[-1].ids):
            over -= len(row[-1].ids)
            left.append(row.pop())
        if over:
            row[-1], tail = row[-1].split(len(row[-1].ids) - over)
            left.append(tail)
        yield row


def pack_texts(
    docs: DataFrame, tokenizer: str, *, id_col: str = "doc_id", text_col: str = "text", end_id: int = 0, size: int = SIZE, segments: int = SEGMENTS, loss: int = LOSS, cut_from: int = CUT_FROM
) -> DataFrame:
    """doc_id, start, length, ids (little-endian uint32), doc_tokens, loss_tokens, sequence_id, offset of each piece."""
    own, text = (F.col(f"c{docs.columns.index(c)}") for c in (id_col, text_col))
    docs = numbered(docs).select(own.alias("doc_id"), text.cast("string"))
    kind = docs.schema["doc_id"].dataType.simpleString()
    full = min(size, loss)

    def run(batches):
        code = encoder(tokenizer)
        base = TaskContext.get().partitionId() << 33
        made = 0
        packer = Packer(size, segments, loss, cut_from, _cut)
        ready: list[tuple[_Piece, int, int]] = []
        id_type = None

        def place(pieces: list[_Piece]) -> None:
            nonlocal made
            at = 0
            for p in pieces:
                ready.append((p, base + made, at))
                at += len(p.ids)
            made += 1

        def flush():
            p = [x[0] for x in ready]
            cols = [
                pa.array([x.doc for x in p], id_type), pa.array([x.start for x in p], pa.int64()), pa.array([len(x.ids) for x in p], pa.int64()),
                pa.array([x.ids.astype("<u4").tobytes() for x in p], pa.binary()), pa.array([x.total for x in p], pa.int64()), pa.array([x.kind[2] for x in p], pa.int64()),
                pa.array([x[1] for x in ready], pa.int64()), pa.array([x[2] for x in ready], pa.int64()),
            ]
            ready.clear()
            return pa.RecordBatch.from_arrays(cols, names=["doc_id", "start", "length", "ids", "doc_tokens", "loss_tokens", "sequence_id", "offset"])

        for b in batches:
            id_type = b.column(0).type
            for t in text_blocks(b.column(1)):
                ids = b.column(0).slice(t.first, len(t)).to_pylist()
                for doc, x in zip(ids, code.encode(t, end_id), strict=True):
                    whole = len(x) // full * full
                    for s in range(0, whole, full):
                        place([_Piece(doc, s, x[s : s + full], len(x))])
                    if whole < len(x):
                        rest = _Piece(doc, whole, x[whole:].copy(), len(x))
                        packer.add(rest.kind, rest)
                    if packer.items >= WINDOW_ITEMS or packer.tokens >= WINDOW_TOKENS:
                        for pieces in packer.fill(packer.tokens // 4):
                            place(pieces)
                    if len(ready) >= 8192:
                        yield flush()
        for pieces in packer.fill(size - 1):
            place(pieces)
        for row in last_sequences(packer.rest(), segments, loss):
            place(row)
        if ready:
            yield flush()

    schema = f"doc_id {kind}, start long, length long, ids binary, doc_tokens long, loss_tokens long, sequence_id long, offset long"
    return map_arrow(docs, run, schema)


def pack_rows(df: DataFrame, *, id_col: str, tokens_col: str, segments_col: str, loss_col: str, size: int = SIZE, segments: int = SEGMENTS, loss: int = LOSS) -> DataFrame:
    """id, sequence_id, offset of each row, packed uncut by its three sizes (null: 0). A row larger than a sequence stands alone in one."""
    columns = [F.col(f"c{df.columns.index(c)}") for c in (id_col, tokens_col, segments_col, loss_col)]
    rows = numbered(df).select(columns[0].alias("id"), *[F.coalesce(c.cast("long"), F.lit(0)) for c in columns[1:]])

    def run(batches):
        base, made, packer, kind = TaskContext.get().partitionId() << 33, 0, Packer(size, segments, loss), None

        def out(sequences):
            nonlocal made
            ids, at, offset = [], [], []
            for row in sequences:
                begin = 0
                for name, tokens in row:
                    ids.append(name)
                    at.append(base + made)
                    offset.append(begin)
                    begin += tokens
                made += 1
            return pa.RecordBatch.from_arrays([pa.array(ids, kind), pa.array(at, pa.int64()), pa.array(offset, pa.int64())], names=["id", "sequence_id", "offset"])

        for b in batches:
            kind, alone = b.column(0).type, []
            for name, *sizes in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if packer.fits(tuple(sizes)):
                    packer.add(tuple(sizes), (name, sizes[0]))
                else:
                    alone.append([(name, sizes[0])])
            yield out(alone)
            if packer.items >= WINDOW_ITEMS:
                yield out(packer.fill(packer.tokens // 4))
        if packer.items:
            yield out(packer.fill(-1))

    return map_arrow(rows, run, f"id {rows.schema['id'].dataType.simpleString()}, sequence_id long, offset long")


def pack_examples(sizes: list[tuple[int, int, int]], *, size: int = SIZE, segments: int = SEGMENTS, loss: int = LOSS) -> list[list[int]]:
    """Pack a list of uncut examples of (tokens, segments, loss-bearing tokens): their indices by sequence."""
    packer = Packer(size, segments, loss)
    for i, kind in enumerate(sizes):
        packer.add(kind, i)
    return list(packer.fill(-1))
