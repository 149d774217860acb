"""Bounded-space online packing of token streams into fixed windows.

Each task keeps at most ``open_windows`` windows.  A document's full windows are emitted at once;
its remainder goes to the window that it fills best.  When none has room, the fullest is emitted
(topped up with a cut of the arriving piece if its gap exceeds ``max_gap`` ids, as pieces may be cut
freely) and a new one is opened.  What is open at the end of a task goes, with its ids, to a merge
tree: groups of ``MERGE_FANIN`` tasks put their leftovers together by best fit and cut the rest, so
that each group passes at most one partly filled window on; one such window is left in the end.

Cases: null text is empty (one end id); repeated rows are packed as often as they occur; an empty
table gives no rows; a document longer than a window spans several; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import materialize
from .tokens import encoder

WINDOW = 2048
OPEN_WINDOWS = 64
MAX_GAP = 16
MERGE_FANIN = 16
SCHEMA = "doc_id long, start long, length long, doc_tokens long, sequence_id long, offset long, ids binary, part int, is_open boolean"
_FIELDS = [("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64()), ("ids", pa.binary()), ("part", pa.int32()), ("is_open", pa.bool_())]
BATCH_BYTES = 4 << 20


class Piece:
    """A run of one document's ids."""

    __slots__ = ("doc_id", "start", "ids", "doc_tokens")

    def __init__(self, doc_id, start: int, ids: bytes, doc_tokens: int):
        self.doc_id, self.start, self.ids, self.doc_tokens = doc_id, start, ids, doc_tokens

    def __len__(self) -> int:
        return len(self.ids) // 4

    def cut(self, n: int) -> tuple[Piece, Piece]:
        return Piece(self.doc_id, self.start, self.ids[: 4 * n], self.doc_tokens), Piece(self.doc_id, self.start + n, self.ids[4 * n :], self.doc_tokens)


class Packer:
    """The online packer; ``emit(pieces, is_open)`` is called once for each window that is done."""

    def __init__(self, emit, window: int = WINDOW, open_windows: int = OPEN_WINDOWS, max_gap: int = MAX_GAP):
        self.emit, self.window, self.most, self.max_gap = emit, window, open_windows, max_gap
        self.open: list[list] = []  # [free, pieces]

    def add(self, piece: Piece) -> None:
        while len(piece) >= self.window:
            head, piece = piece.cut(self.window)
            self.emit([head], False)
        if len(piece):
            self.place(piece)

    def place(self, piece: Piece) -> None:
        n = len(piece)
        best = min((w for w in self.open if w[0] >= n), key=lambda w: w[0], default=None)
        if best is None and len(self.open) >= self.most:
            fullest = min(self.open, key=lambda w: w[0])
            if fullest[0] > self.max_gap:
                head, piece = piece.cut(fullest[0])
                fullest[1].append(head)
            self.open.remove(fullest)
            self.emit(fullest[1], False)
            if len(piece) < n:
                return self.place(piece)
        if best is None:
            self.open.append([self.window - n, [piece]])
        else:
            best[0] -= n
            best[1].append(piece)
            if not best[0]:
                self.open.remove(best)
                self.emit(best[1], False)

    def close(self) -> None:
        for _, pieces in self.open:
            self.emit(pieces, True)
        self.open = []


def merge_leftovers(windows: list[list[Piece]], emit, window: int = WINDOW) -> None:
    """Whole windows go together by best fit, largest first; of the rest the emptiest are cut to fill the fullest."""
    bins: list[list] = []
    for pieces in sorted(windows, key=lambda w: -sum(map(len, w))):
        n = sum(map(len, pieces))
        best = min((b for b in bins if b[0] >= n), key=lambda b: b[0], default=None)
        if best is None:
            bins.append([window - n, list(pieces)])
        else:
            best[0] -= n
            best[1] += pieces
    bins.sort(key=lambda b: b[0])
    low, high = 0, len(bins) - 1
    while low < high:
        gap = bins[low][0]
        while gap and low < high:
            donor = bins[high]
            piece = donor[1].pop()
            if len(piece) > gap:
                piece, rest = piece.cut(gap)
                donor[1].append(rest)
            donor[0] += len(piece)
            gap -= len(piece)
            bins[low][1].append(piece)
            if not donor[1]:
                high -= 1
        if gap == 0:
            emit(bins[low][1], False)
            low += 1
        else:
            bins[low][0] = gap
    if low == high and bins:
        b = bins[low]
        emit(b[1], b[0] > 0)


class _Rows:
    """Rows of emitted windows, as Arrow batches of bounded size."""

    def __init__(self, base: int, part: int):
        self.base, self.part, self.count, self.size = base, part, 0, 0
        self.columns: list[list] = [[] for _ in _FIELDS]

    def emit(self, pieces: list[Piece], is_open: bool) -> None:
        offset = 0
        for p in pieces:
            for c, v in zip(self.columns, (p.doc_id, p.start, len(p), p.doc_tokens, self.base | self.count, offset, p.ids, self.part, is_open), strict=True):
                c.append(v)
            offset += len(p)
            self.size += len(p.ids)
        self.count += 1

    def take(self, least: int) -> Iterator[pa.RecordBatch]:
        if self.size >= least:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(self.columns, _FIELDS, strict=True)], [n for n, _ in _FIELDS])
            self.columns, self.size = [[] for _ in _FIELDS], 0


def pack_documents(docs: DataFrame, tokenizer_path: str, end_id: int = 1, window: int = WINDOW, open_windows: int = OPEN_WINDOWS, max_gap: int = MAX_GAP) -> DataFrame:
    """One row per piece: doc_id, start, length, doc_tokens, sequence_id, offset, ids (uint32 LE)."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, part = encoder(tokenizer_path), TaskContext.get().partitionId()
        rows = _Rows(part << 32, part)
        packer = Packer(rows.emit, window, open_windows, max_gap)
        for batch in batches:
            doc_ids = batch.column(0).to_pylist()
            for a, ids, at in enc.encode_ended(batch.column(1), end_id):
                view, edge = ids.tobytes(), at.tolist()
                for i in range(len(edge) - 1):
                    x, y = edge[i], edge[i + 1]
                    packer.add(Piece(doc_ids[a + i], 0, view[4 * x : 4 * y], y - x))
                yield from rows.take(BATCH_BYTES)
        packer.close()
        yield from rows.take(1)

    def merger(level: int):
        def merge(key: tuple, table: pa.Table) -> pa.Table:
            group = key[0].as_py()
            rows = _Rows(level << 56 | group << 32, group)
            windows: dict[int, list] = {}
            for r in table.to_pylist():
                windows.setdefault(r["sequence_id"], []).append((r["offset"], Piece(r["doc_id"], r["start"], r["ids"], r["doc_tokens"])))
            merge_leftovers([[p for _, p in sorted(w, key=lambda x: x[0])] for _, w in sorted(windows.items())], rows.emit, window)
            return pa.Table.from_batches(rows.take(1), pa.schema(_FIELDS))

        return merge

    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    packed = materialize(d.mapInArrow(pack, SCHEMA), "packed")
    done, parts, level = packed.where(~F.col("is_open")), (packed.agg(F.max("part")).first()[0] or 0) + 1, 0
    rest = packed.where("is_open")
    while True:
        level, parts = level + 1, -(-parts // MERGE_FANIN)
        grouped = rest.groupBy((F.col("part") / F.lit(MERGE_FANIN)).cast("int").alias("part_group"))
        merged = materialize(grouped.applyInArrow(merger(level), SCHEMA), "packed")
        if parts == 1:
            done = done.unionByName(merged)
            break
        done, rest = done.unionByName(merged.where(~F.col("is_open"))), merged.where("is_open")
    return done.drop("part", "is_open")
