"""Product codes of vectors: Elkan's exact Lloyd iteration with persisted bounds.

Components become integers floor(1024 x); a vector is cut into four parts, each coded by the nearest
entry of its part's codebook.  A round assigns every part and moves every entry to the floored mean of
its parts.  Between rounds each vector keeps, for each part, its entry, one upper bound of the distance
to it and one lower bound of the distance to *every* entry, in a table of the shared folder:

* an entry's movement raises the upper bounds of its parts and lowers everyone's lower bound to it;
* an entry is left out only where its lower bound, or half its distance to the part's own entry, is
  strictly above the upper bound: then it is strictly farther, so that ties are never pruned;
* what is left is measured in integers, and the least (distance, index) wins.

Bounds are rounded away from the truth (upper ones up, lower ones down, which are kept in half
precision), so that no rounding prunes a nearest entry.  A round is one pass over the table; its sums
per part and entry, at most 4 x 256 x (dimension / 4 + 1) numbers, are added up per task, then by Spark,
and only they reach the driver.

Cases: rows whose vector is null or holds a null or non-finite component are dropped, as are vectors of
another length than that of the first seed (the kept row of smallest id); a length that 4 does not divide
is cut at i * length // 4; null ids are coded like others and come last among the seeds; rows of equal id are
rows of their own (ties among seeds: by components); fewer than 256 rows make smaller codebooks; equal
entries: the lower index wins; an empty table gives no rows; components beyond 2**28 / 1024 raise an
error, as squared distances would leave 64 bits; only vec_id, embedding and label are read, so other
columns may have any name.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import materialize

PARTS = 4
ENTRIES = 256
ROUNDS = 4
SCALE = 1024
#: Components of larger size could leave 64 bits when squared and added.
LARGEST = 1 << 28
#: Sums per label are broadcast up to so many labels, and joined by shuffle beyond.
BROADCAST_LABELS = 100_000
#: Vector parts and entries that are measured at once.
PAIRS = 1 << 19
_UP, _DOWN = 1 + 2.0**-50, 1 - 2.0**-50


def cuts(dimension: int) -> list[tuple[int, int]]:
    """[start, end) of each part."""
    at = [i * dimension // PARTS for i in range(PARTS + 1)]
    return list(zip(at[:-1], at[1:], strict=True))


def squared(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact squared distances of all rows to all entries."""
    most = int(max(np.abs(x).max(initial=0), np.abs(c).max(initial=0)))
    if 4 * most * most * max(1, x.shape[1]) < 1 << 52:  # exact in doubles
        a, b = x.astype(np.float64), c.astype(np.float64)
        return ((a * a).sum(1)[:, None] - 2 * (a @ b.T) + (b * b).sum(1)[None, :]).astype(np.int64)
    out = np.zeros((len(x), len(c)), np.int64)
    for j in range(x.shape[1]):
        out += (x[:, j : j + 1] - c[None, :, j]) ** 2
    return out


def half_down(v: np.ndarray) -> np.ndarray:
    """Half precision, never above ``v``."""
    with np.errstate(over="ignore"):
        h = v.astype(np.float16)
    return np.where(h.astype(np.float64) > v, np.nextafter(h, np.float16(-np.inf)), h)


@dataclass
class Bounds:
    """Of one part of some vectors: entry, upper bound, lower bound to each entry."""

    code: np.ndarray
    upper: np.ndarray
    lower: np.ndarray

    @classmethod
    def measured(cls, x: np.ndarray, c: np.ndarray) -> Bounds:
        d = squared(x, c)
        code = d.argmin(axis=1)  # the first of equal ones
        return cls(code, np.sqrt(d[np.arange(len(x)), code]) * _UP, half_down(np.sqrt(d) * _DOWN))

    def follow(self, moved: np.ndarray) -> None:
        """Entries have moved so far."""
        self.upper = (self.upper + moved[self.code]) * _UP
        self.lower = half_down(np.maximum((self.lower.astype(np.float64) - moved[None, :]) * _DOWN, 0))

    def _near(self, half: np.ndarray, rows: np.ndarray) -> np.ndarray:
        upper, code = self.upper[rows, None], self.code[rows]
        near = (self.lower[rows] <= upper) & (half[code] <= upper)
        near[np.arange(len(rows)), code] = False
        return near

    def assign(self, x: np.ndarray, c: np.ndarray, half: np.ndarray) -> int:
        """Move to the nearest entries; how many distances to other entries were measured."""
        rows = np.flatnonzero(self._near(half, np.arange(len(x))).any(axis=1))
        own = ((x[rows] - c[self.code[rows]]) ** 2).sum(axis=1)
        self.upper[rows] = np.sqrt(own) * _UP
        r, j = np.nonzero(self._near(half, rows))
        if not len(r):
            return 0
        d = np.concatenate([((x[rows[r[a : a + PAIRS]]] - c[j[a : a + PAIRS]]) ** 2).sum(axis=1) for a in range(0, len(r), PAIRS)])
        self.lower[rows[r], j] = half_down(np.sqrt(d) * _DOWN)
        heads = np.flatnonzero(np.diff(r, prepend=-1))
        least = np.minimum.reduceat(d, heads)
        ties = np.flatnonzero(d == np.repeat(least, np.diff(heads, append=len(r))))
        first = ties[np.searchsorted(ties, heads)]  # entries ascend within a row
        at, entry = r[heads], j[first]
        code = self.code[rows[at]]
        better = (least < own[at]) | ((least == own[at]) & (entry < code))
        at, entry, least, code = at[better], entry[better], least[better], code[better]
        self.lower[rows[at], code] = half_down(np.sqrt(own[at]) * _DOWN)
        self.code[rows[at]] = entry
        self.upper[rows[at]] = np.sqrt(least) * _UP
        return len(r)


def half_distances(c: np.ndarray) -> np.ndarray:
    return np.sqrt(squared(c, c)) * (0.5 * _DOWN)


def movements(old: np.ndarray, new: np.ndarray) -> np.ndarray:
    return np.sqrt(((old - new) ** 2).sum(axis=1)) * _UP


def integers(vectors: DataFrame) -> DataFrame:
    """(vec_id, label, x) of the rows that take part."""
    fit = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < F.lit(float("inf"))))
    kept = vectors.where(F.col("embedding").isNotNull() & fit)
    return kept.select(F.col("vec_id").cast("long").alias("vec_id"), "label", F.transform("embedding", lambda x: F.floor(x.cast("double") * SCALE)).alias("x"))


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    if len(flat) and np.abs(flat).max() > LARGEST:
        raise ValueError(f"components beyond {LARGEST / SCALE:g} are not coded")
    return flat.reshape(len(column), -1)


def _packed(a: np.ndarray) -> pa.Array:
    """One binary value a row."""
    a = np.ascontiguousarray(a)
    width = a[:1].nbytes
    return pa.Array.from_buffers(pa.binary(), len(a), [None, pa.py_buffer((np.arange(len(a) + 1) * width).astype(np.int32).tobytes()), pa.py_buffer(a.tobytes())])


def _unpacked(column: pa.Array, dtype, *shape: int) -> np.ndarray:
    offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(column.buffers()[2], np.uint8)[offsets[0] : offsets[-1]].view(dtype).reshape(len(column), *shape).copy()


def _batches(batches: Iterator[pa.RecordBatch], rows: int = 4096) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for a in range(0, batch.num_rows, rows):
            yield batch.slice(a, rows)


def _round(old: list[np.ndarray] | None, new: list[np.ndarray], last: bool):
    """A pass over the state: bounds follow the entries from ``old`` to ``new``, parts are assigned."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        half = [half_distances(c) for c in new]
        moved = [movements(a, b) for a, b in zip(old, new, strict=True)] if old else None
        k = len(new[0])
        for batch in _batches(batches):
            x = _matrix(batch.column("x"))
            parts = []
            if old:
                code, upper, lower = (_unpacked(batch.column(n), t, *s) for n, t, s in (("code", np.uint8, (PARTS,)), ("upper", np.float64, (PARTS,)), ("lower", np.float16, (PARTS, k))))
            for p, (a, b) in enumerate(cuts(x.shape[1])):
                if old:
                    bounds = Bounds(code[:, p].astype(np.int64), upper[:, p].copy(), lower[:, p].copy())
                    bounds.follow(moved[p])
                    bounds.assign(x[:, a:b], new[p], half[p])
                else:
                    bounds = Bounds.measured(x[:, a:b], new[p])
                parts.append(bounds)
            codes = np.stack([b.code for b in parts], 1).astype(np.uint8)
            columns = [batch.column("vec_id"), batch.column("label")]
            if last:
                error = sum(((x[:, a:b] - c[q.code]) ** 2).sum(axis=1) for (a, b), c, q in zip(cuts(x.shape[1]), new, parts, strict=True))
                text = codes.tobytes().hex()
                columns += [pa.array([text[i : i + 2 * PARTS] for i in range(0, len(text), 2 * PARTS)], pa.string()), pa.array(error, pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, ["vec_id", "label", "code", "error"])
            else:
                columns += [batch.column("x"), _packed(codes), _packed(np.stack([b.upper for b in parts], 1)), _packed(np.stack([b.lower for b in parts], 1))]
                yield pa.RecordBatch.from_arrays(columns, ["vec_id", "label", "x", "code", "upper", "lower"])

    return run


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """part, entry, place (-1: the count), sum, over a task."""
    total: np.ndarray | None = None
    for batch in _batches(batches):
        x, code = _matrix(batch.column("x")), _unpacked(batch.column("code"), np.uint8, PARTS)
        if total is None:
            width = max(b - a for a, b in cuts(x.shape[1]))
            total = np.zeros((PARTS, ENTRIES, width + 1), np.int64)
        for p, (a, b) in enumerate(cuts(x.shape[1])):
            np.add.at(total[p], (code[:, p], slice(1, b - a + 1)), x[:, a:b])
            total[p, :, 0] += np.bincount(code[:, p], minlength=ENTRIES)
    if total is not None:
        p, e, j = np.nonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(p.astype(np.int32)), pa.array(e.astype(np.int32)), pa.array((j - 1).astype(np.int32)), pa.array(total[p, e, j])], ["part", "entry", "place", "sum"])


def moved_entries(state: DataFrame, books: list[np.ndarray]) -> list[np.ndarray]:
    """Floored means of the assigned parts; entries without parts stay."""
    sums = state.select("x", "code").mapInArrow(_sums, "part int, entry int, place int, sum long")
    rows = sums.groupBy("part", "entry", "place").agg(F.sum("sum").alias("sum")).collect()  # at most PARTS x ENTRIES x (width + 1) rows
    count = {(r.part, r.entry): r.sum for r in rows if r.place < 0}
    new = [c.copy() for c in books]
    for p, e in count:
        new[p][e] = 0
    for r in rows:
        if r.place >= 0:
            new[r.part][r.entry, r.place] = r.sum // count[r.part, r.entry]
    return new


@dataclass
class Coded:
    """rows: vec_id, label, code, error; books: the final codebook of each part."""

    rows: DataFrame
    books: list[np.ndarray]

    def sha256(self) -> str:
        text = ",".join(str(v) for c in self.books for row in c.tolist() for v in row)
        return hashlib.sha256(text.encode()).hexdigest()


def encode_vectors(vectors: DataFrame, entries: int = ENTRIES, rounds: int = ROUNDS) -> Coded:
    """Codes of every vector that takes part after ``rounds`` rounds, at most 256 ``entries`` a part."""
    assert 1 <= entries <= ENTRIES
    x = integers(vectors)
    seeds = x.orderBy(F.asc_nulls_last("vec_id"), "x").select("x").limit(entries).collect()  # the codebooks' first entries
    label = next(f.dataType.simpleString() for f in x.schema if f.name == "label")
    if not seeds:
        return Coded(x.select("vec_id", "label", F.lit("").alias("code"), F.lit(0).cast("long").alias("error")).where("false"), [np.zeros((0, 0), np.int64)] * PARTS)
    dimension = len(seeds[0].x)
    x = x.where(F.size("x") == dimension)
    first = x.orderBy(F.asc_nulls_last("vec_id"), "x").select("x").limit(entries).collect() if any(len(r.x) != dimension for r in seeds) else seeds
    points = np.array([r.x for r in first], np.int64).reshape(len(first), dimension)
    if np.abs(points).max(initial=0) > LARGEST:
        raise ValueError(f"components beyond {LARGEST / SCALE:g} are not coded")
    books = [points[:, a:b].copy() for a, b in cuts(dimension)]
    state, old = x, None
    for _ in range(rounds):
        state = materialize(state.mapInArrow(_round(old, books, last=False), f"vec_id long, label {label}, x array<long>, code binary, upper binary, lower binary"), "bounds")
        old, books = books, moved_entries(state, books)
    rows = materialize(state.mapInArrow(_round(old, books, last=True), f"vec_id long, label {label}, code string, error long"), "codes")
    return Coded(rows, books)


def with_label_errors(coded: DataFrame) -> DataFrame:
    """The rows with ``label_error``, the error of all rows of the label (nulls are one label)."""
    sums = materialize(coded.groupBy("label").agg(F.sum("error").alias("label_error")).withColumnRenamed("label", "of"), "label-errors")
    sums = F.broadcast(sums) if sums.limit(BROADCAST_LABELS + 1).count() <= BROADCAST_LABELS else sums
    return coded.join(sums, F.col("label").eqNullSafe(F.col("of"))).drop("of")
