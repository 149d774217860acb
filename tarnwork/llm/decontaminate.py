"""Benchmark decontamination: size-partitioned MinHash containment search, exactly verified.

The few test items are the index, the documents stream past it.  Items are partitioned by their
number of shingles.  For each partition the containment threshold t fixes how many of an item's
smallest shingle hashes (its containment MinHash) are kept: with k kept, an item of containment c is
missed with probability (1-c)^k, and k grows until that is below ``miss`` at c = t; an item with no
more than k shingles keeps all, so small items are never missed.  A document that holds a kept hash
of an item becomes a candidate, however long it is, and is verified at once by the exact share of the
item's distinct shingles that it holds, the words themselves being compared.  Partitions whose smallest item could not be contained in a
document as short as the present one are not looked up.

The scan is a single map over documents: no shuffle, no Python string per word.  The item index is
sent to the tasks in blocks of at most ``BLOCK_ITEMS`` items and ``BLOCK_BYTES`` bytes; a larger
benchmark takes several passes, so what is sent does not grow with it.

Cases: null and empty items or documents never match; of items at the threshold all are told (no ties);
very long documents are read whole, one at a time; an item of fewer than ``width`` words is looked
for as a run of just these words; repeated items and rows are answered each; empty tables give no
rows; other columns of either table are kept out.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shingles import buffers, chunks, shingles, words

WIDTH = 5
THRESHOLD = 0.8
MISS = 1e-9
BLOCK_ITEMS = 20_000
BLOCK_BYTES = 32 << 20
SCHEMA = "doc_id long, item_id long, n_common long, n_item long, containment double"


def sketch_size(threshold: float, miss: float = MISS) -> int:
    """Smallest k with (1-threshold)^k <= miss."""
    return 1 if threshold >= 1 else max(1, math.ceil(math.log(miss) / math.log(1 - threshold)))


def word_shingles(text: str | bytes, width: int) -> set[bytes]:
    """The distinct shingles of a text as words: A-Z lower-cased, cut at ASCII blanks."""
    w = (text.encode() if isinstance(text, str) else text).lower().split()
    return {b" ".join(w[i : i + width]) for i in range(len(w) - width + 1)}


class ItemIndex:
    """Sketches and full shingle sets of a block of items, by shingle width and size partition."""

    def __init__(self, items: list[tuple[int, str]], width: int, threshold: float):
        self.threshold = threshold
        self.by_width: dict[int, list[dict]] = {}
        data, offsets = buffers(pa.array([t for _, t in items], pa.string()))
        word, at = words(data, offsets)
        counts = np.diff(at)
        self.ids = [i for i, _ in items]
        self.texts = [t for _, t in items]
        self.width = [min(width, int(c)) for c in counts]
        self.sets: list[np.ndarray | None] = [None] * len(items)
        k = sketch_size(threshold)
        for w in sorted({min(width, int(c)) for c in counts if c}):
            partitions: dict[int, list[int]] = {}
            for x in np.flatnonzero(np.minimum(counts, width) == w):
                self.sets[x] = np.unique(shingles(word[at[x] : at[x + 1]], np.array([0, counts[x]]), w)[0])
                partitions.setdefault(len(self.sets[x]).bit_length(), []).append(x)
            self.by_width[w] = [self._partition(xs, k) for _, xs in sorted(partitions.items())]

    def _partition(self, xs: list[int], k: int) -> dict:
        """Items of like size: their k smallest hashes (hashes are uniform: a MinHash sample), sorted."""
        keys = np.concatenate([self.sets[x][:k] for x in xs])
        owners = np.concatenate([np.full(min(k, len(self.sets[x])), x) for x in xs])
        order = np.argsort(keys, kind="stable")
        bits = np.zeros(1 << 20, bool)
        bits[(keys >> np.uint64(44)).astype(np.int64)] = True
        least = math.ceil(self.threshold * min(len(self.sets[x]) for x in xs) - 1e-9)
        return {"keys": keys[order], "owners": owners[order], "bits": bits, "least": least}

    def matches(self, column: pa.Array) -> Iterator[tuple[int, int, int, int]]:
        """(row, item, common shingles, item's shingles) of every verified pair."""
        data, offsets = buffers(column)
        for a, b in chunks(offsets):
            word, at = words(data, offsets[a : b + 1])
            for w, partitions in self.by_width.items():
                s, row = shingles(word, at, w)
                size, found = np.bincount(row, minlength=b - a), set()
                high = (s >> np.uint64(44)).astype(np.int64)
                for part in partitions:
                    near = np.flatnonzero(part["bits"][high])
                    near = near[size[row[near]] >= part["least"]]
                    lo, hi = np.searchsorted(part["keys"], s[near], "left"), np.searchsorted(part["keys"], s[near], "right")
                    hit = hi > lo
                    found |= {(r, int(part["owners"][q])) for r, x, y in zip(row[near][hit].tolist(), lo[hit].tolist(), hi[hit].tolist(), strict=True) for q in range(x, y)}
                edge = np.searchsorted(row, np.arange(b - a + 1)) if found else None
                cached, own = -1, None
                for r, x in sorted(found):
                    if r != cached:
                        cached, own = r, np.unique(s[edge[r] : edge[r + 1]])
                    item = self.sets[x]
                    spot = np.minimum(np.searchsorted(own, item), len(own) - 1)
                    if int((own[spot] == item).sum()) < self.threshold * len(item) - 1e-9:
                        continue
                    words_of = word_shingles(self.texts[x], self.width[x])
                    common = len(words_of & word_shingles(data[offsets[a + r] : offsets[a + r + 1]].tobytes(), self.width[x]))
                    if common >= self.threshold * len(words_of) - 1e-9:
                        yield a + r, x, common, len(words_of)


def _blocks(benchmark: DataFrame) -> Iterator[list[tuple[int, str]]]:
    """The items in blocks of bounded size, streamed through the driver partition by partition."""
    block, size = [], 0
    for r in benchmark.select(F.col("item_id").cast("long"), F.col("text").cast("string")).where(F.col("text").isNotNull()).toLocalIterator():
        block.append((r[0], r[1]))
        size += len(r[1])
        if len(block) >= BLOCK_ITEMS or size >= BLOCK_BYTES:
            yield block
            block, size = [], 0
    yield block


def contaminated(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD, width: int = WIDTH) -> DataFrame:
    """One row for each (document, item) with at least ``threshold`` of the item's shingles in the document."""
    spark = docs.sparkSession
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    out = None
    for block in _blocks(benchmark):
        index = spark.sparkContext.broadcast(ItemIndex(block, width, threshold))

        def run(batches: Iterator[pa.RecordBatch], index=index) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                rows = list(index.value.matches(batch.column(1)))
                ids = batch.column(0).to_pylist()
                cols = [[ids[r[0]] for r in rows], [index.value.ids[r[1]] for r in rows], [r[2] for r in rows], [r[3] for r in rows]]
                arrays = [pa.array(c, pa.int64()) for c in cols] + [pa.array([r[2] / r[3] for r in rows], pa.float64())]
                yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "item_id", "n_common", "n_item", "containment"])

        part = d.mapInArrow(run, SCHEMA)
        out = part if out is None else out.unionByName(part)
    return out


def decontaminate(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD, width: int = WIDTH) -> DataFrame:
    """The documents that hold no item; all columns.  Rows of null doc_id are judged by their text too.

    The verdict is made next to the row, so no join and no shuffle of texts is needed.
    """
    spark, schema = docs.sparkSession, docs.schema
    at = schema.fieldNames().index("text")
    out = docs
    for block in _blocks(benchmark):
        index = spark.sparkContext.broadcast(ItemIndex(block, width, threshold))

        def run(batches: Iterator[pa.RecordBatch], index=index) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                keep = np.ones(batch.num_rows, bool)
                keep[[r[0] for r in index.value.matches(batch.column(at))]] = False
                yield batch.filter(pa.array(keep))

        out = out.mapInArrow(run, schema)
    return out
