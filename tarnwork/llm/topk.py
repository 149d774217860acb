"""Exact top-k inner-product search with two cover trees searched together.

Vectors are integers, floor(64 * x).  Candidates are dealt to blocks near one of a bounded number of
pivots, hot pivots being split; queries are dealt to buckets alike.  Every pair of query bucket and block
that may hold results is one task: it builds a cover tree over the block and one over the queries and
descends both.  A pair of nodes with centres p, c and covering radii R, r is left out if
    <p, c> + R |c| + r |p| + R r  <  the smallest k-th score so far of the queries below p,
which bounds every inner product below the pair (Cauchy-Schwarz).  The k-th scores start from a
bounded pivot sample that every query is scored against first, so the same bound, with the pivots as
centres, leaves out whole pairs of bucket and block before anything is sent to them.
The k best of each pair of block and query are merged by a window whose limit is applied before the
shuffle.

Of equal candidate vectors only the k+1 smallest ids can be among any query's k best (ties go to the
smaller id, and a query leaves out no more than its own), so the others are set aside beforehand;
this is exact.

Cases: vectors that are null, empty, or hold null or non-finite components take no part; so do rows
of null vec_id; only vectors of equal length are compared; repeated query rows are answered once;
a query with fewer candidates gets all of them; an empty table gives no rows; only the id and the vector
are read, so other columns may have any name.  Scores are exact while they stay below 2^53 in size.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import materialize

K = 20
SCALE = 64
PIVOTS = 256
BLOCK = 4096
LEAF = 48


class CoverTree:
    """Levels of halving radius: a node's children are chosen greedily so that they are farther than the
    child radius from one another and together cover the node's points within it.  ``radius`` is the
    measured distance to the farthest point below; children of a few points are put together in leaves."""

    def __init__(self, x: np.ndarray, leaf: int = LEAF):
        self.x, self.leaf = x, leaf
        self.center: list[int] = []
        self.radius: list[float] = []
        self.children: list[np.ndarray] = []
        self.points: list[np.ndarray | None] = []
        self.norm = np.sqrt((x * x).sum(axis=1))
        self._build()
        self.at, self.r = np.array(self.center), np.array(self.radius)

    def _add(self, center: int, radius: float) -> int:
        self.center.append(center)
        self.radius.append(radius)
        self.children.append(np.zeros(0, np.int64))
        self.points.append(None)
        return len(self.center) - 1

    def _build(self) -> None:
        n = len(self.x)
        d = np.sqrt(((self.x - self.x[0]) ** 2).sum(axis=1))
        root = self._add(0, float(d.max()))
        todo = [(root, np.arange(n), d)]
        while todo:
            node, ids, d = todo.pop()
            far = float(d.max())
            if len(ids) <= self.leaf or far == 0:
                self.points[node] = ids
                continue
            left, left_d, sets, center = ids, d, [], self.center[node]
            while len(left):
                near = left_d <= far / 2
                if near.any():
                    sets.append((center, left[near], left_d[near]))
                left = left[~near]
                if len(left):
                    center = int(left[0])
                    left_d = np.sqrt(((self.x[left] - self.x[center]) ** 2).sum(axis=1))
            kids = []
            for center, own, own_d in sets:
                if len(own) > self.leaf // 4:
                    kids.append(self._add(center, float(own_d.max())))
                    todo.append((kids[-1], own, own_d))
            # Sets of a few points (far points in many dimensions) share leaves around the node's centre.
            few = [own for _, own, _ in sets if len(own) <= self.leaf // 4]
            few = np.concatenate(few) if few else np.zeros(0, np.int64)
            for i in range(0, len(few), self.leaf):
                own = few[i : i + self.leaf]
                away = np.sqrt(((self.x[own] - self.x[self.center[node]]) ** 2).sum(axis=1))
                kids.append(self._add(self.center[node], float(away.max())))
                self.points[kids[-1]] = own
            self.children[node] = np.array(kids)


class Search:
    """Best k of ``x`` (ids ``xid``, ascending ids on ties) for each query, by dual descent."""

    def __init__(self, q: np.ndarray, qid: np.ndarray, floor: np.ndarray, x: np.ndarray, xid: np.ndarray, k: int):
        self.k, self.q, self.qid, self.xid, self.x = k, q, qid, xid, x
        self.qt, self.xt = CoverTree(q), CoverTree(x)
        self.score = np.full((len(q), k), -np.inf)
        self.ids = np.full((len(q), k), np.iinfo(np.int64).max)
        self.floor = floor.astype(float)
        self.kth = self.floor.copy()
        self.below = self._below()
        self.pairs = 0
        self._run()

    def _below(self) -> list[np.ndarray]:
        out: list = [None] * len(self.qt.center)
        for n in range(len(out) - 1, -1, -1):  # children are made after their parents
            out[n] = self.qt.points[n] if self.qt.points[n] is not None else np.concatenate([out[c] for c in self.qt.children[n]])
        return out

    def _bounds(self, qn: int, xn: np.ndarray) -> np.ndarray:
        """Upper bound of all products below (qn, each of xn); a little above, for rounding."""
        p, c = self.q[self.qt.at[qn]], self.xt.at[xn]
        R, r = self.qt.r[qn], self.xt.r[xn]
        b = self.x[c] @ p + R * self.xt.norm[c] + r * self.qt.norm[self.qt.at[qn]] + R * r
        return b + 1e-9 * np.abs(b) + 1e-6

    def _base(self, rows: np.ndarray, cols: np.ndarray) -> None:
        self.pairs += len(rows) * len(cols)
        s = self.q[rows] @ self.x[cols].T
        s[self.qid[rows][:, None] == self.xid[cols][None, :]] = -np.inf
        for i in np.flatnonzero((s >= self.kth[rows][:, None]).any(axis=1)):
            row = rows[i]
            good = s[i] >= max(self.kth[row], -1e300)
            if not good.any():
                continue
            score = np.concatenate([self.score[row], s[i][good]])
            ids = np.concatenate([self.ids[row], self.xid[cols[good]]])
            best = np.lexsort((ids, -score))[: self.k]
            self.score[row], self.ids[row] = score[best], ids[best]
            self.kth[row] = max(self.floor[row], self.score[row, -1])

    def _run(self) -> None:
        stack = [(0, 0)]
        while stack:
            qn, xn = stack.pop()
            if self._bounds(qn, np.array([xn]))[0] < self.kth[self.below[qn]].min():
                continue
            q_leaf, x_leaf = self.qt.points[qn] is not None, self.xt.points[xn] is not None
            if q_leaf and x_leaf:
                self._base(self.below[qn], self.xt.points[xn])
            elif x_leaf or (not q_leaf and self.qt.r[qn] > self.xt.r[xn]):
                stack += [(int(c), xn) for c in self.qt.children[qn]]
            else:
                kids = self.xt.children[xn]
                b = self._bounds(qn, kids)
                keep = b >= self.kth[self.below[qn]].min()
                kids, b = kids[keep], b[keep]
                if q_leaf:  # small leaves below one node meet the query leaf in one product
                    leaf = np.array([self.xt.points[c] is not None for c in kids], bool)
                    ranked = kids[leaf][np.argsort(-b[leaf], kind="stable")]
                    batch, size = [], 0
                    for c in ranked:
                        batch.append(self.xt.points[c])
                        size += len(batch[-1])
                        if size >= 256:
                            self._base(self.below[qn], np.concatenate(batch))
                            batch, size = [], 0
                    if batch:
                        self._base(self.below[qn], np.concatenate(batch))
                    kids, b = kids[~leaf], b[~leaf]
                stack += [(qn, int(c)) for c in kids[np.argsort(b, kind="stable")]]


def integer_vectors(df: DataFrame, id_col: str, vector_col: str, scale: int = SCALE) -> DataFrame:
    """(vec_id, v): floor(scale * component) of the rows that take part."""
    x = F.transform(F.col(vector_col), lambda c: c.cast("double"))
    fine = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))))
    rows = df.select(F.col(id_col).cast("long").alias("vec_id"), x.alias("x"), fine.alias("fine")).where(F.col("vec_id").isNotNull() & F.col("fine") & (F.size("x") > 0))
    return rows.select("vec_id", F.transform("x", lambda c: F.floor(F.lit(float(scale)) * c).cast("double")).alias("v"))


def _matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    a = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    n = len(a)
    return a.flatten().to_numpy(zero_copy_only=False).reshape(n, -1) if n else np.zeros((0, 0))


def dealt(vectors: DataFrame, queries: DataFrame, k: int = K, pivots: int = PIVOTS, block: int = BLOCK) -> tuple[DataFrame, DataFrame, DataFrame]:
    """vectors, queries: (vec_id, v).  Blocks, buckets, and the (dim, bucket, block) pairs that may hold results."""
    spark = vectors.sparkSession
    h = F.xxhash64("v")
    same = Window.partitionBy(h, F.xxhash64(F.lit(1), "v"), "v").orderBy("vec_id")
    # a query leaves out all rows of its own id: k + 1 ids of each vector; of the rows of one id, each a result, k
    refs = vectors.withColumn("rn", F.dense_rank().over(same)).where(F.col("rn") <= k + 1)
    of_id = Window.partitionBy(h, F.xxhash64(F.lit(1), "v"), "v", "vec_id").orderBy("rn")
    refs = refs.withColumn("rn", F.row_number().over(of_id)).where(F.col("rn") <= k).drop("rn")
    refs = materialize(refs.withColumn("dim", F.size("v")), "vectors")
    queries = materialize(queries.distinct().withColumn("dim", F.size("v")), "vectors")
    sample = refs.orderBy(F.xxhash64("vec_id"), "vec_id").limit(4 * pivots).collect()  # bounded
    anchors: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    for d in {r.dim for r in sample}:
        own = [r for r in sample if r.dim == d]
        anchors[d] = (np.array([r.v for r in own], float), np.array([r.vec_id for r in own]))
    sent = spark.sparkContext.broadcast(anchors)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The nearest pivot, a lower bound of the k-th score from the sample, and how far the pivot is."""
        for batch in batches:
            dims = np.array(batch.column(2).to_pylist(), int)
            pivot, low, away = np.zeros(len(dims), np.int32), np.full(len(dims), -np.inf), np.zeros(len(dims))
            for d in np.unique(dims):
                if int(d) not in sent.value:
                    continue
                x, ids = sent.value[int(d)]
                at = np.flatnonzero(dims == d)
                for a in range(0, len(at), 2048):
                    part = at[a : a + 2048]
                    v = _matrix(batch.column(1).take(pa.array(part)))
                    s = v @ x.T
                    p = x[:pivots]
                    near = s[:, :pivots] * 2 - (p * p).sum(axis=1)[None, :]
                    pivot[part] = near.argmax(axis=1)
                    away[part] = np.sqrt(np.maximum(0.0, (v * v).sum(axis=1) - near.max(axis=1)))
                    s[np.array(batch.column(0).take(pa.array(part)).to_pylist())[:, None] == ids[None, :]] = -np.inf
                    if s.shape[1] >= k:
                        low[part] = np.partition(s, s.shape[1] - k, axis=1)[:, s.shape[1] - k]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(pivot), pa.array(low), pa.array(away)], ["vec_id", "v", "dim", "pivot", "low", "away"])

    def deal(df: DataFrame, most: int) -> DataFrame:
        """``part``: rows of like pivots together, at most about ``most`` of them."""
        placed = materialize(df.mapInArrow(place, "vec_id long, v array<double>, dim int, pivot int, low double, away double"), "placed")
        counts = placed.groupBy("dim", "pivot").agg(F.count("*").alias("n"))
        # light pivots share parts in order of pivot; heavy ones are split over several parts
        run = F.sum("n").over(Window.partitionBy("dim").orderBy("pivot")) - F.col("n")
        spans = counts.select("dim", "pivot", F.floor(run / most).alias("first"), F.ceil(F.col("n") / most).alias("m"))
        return placed.join(F.broadcast(spans), ["dim", "pivot"]).withColumn("part", (F.col("first") + F.pmod(F.xxhash64("vec_id"), F.col("m"))).cast("int")).select("vec_id", "v", "dim", "pivot", "low", "away", "part")

    blocks, buckets = deal(refs, block), deal(queries, 2 * block)

    def bounded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The pairs of pivots whose bound reaches the least k-th score of the queries near the first."""
        for batch in batches:
            dim, q, x, q_away, x_away, floor = (batch.column(i).to_numpy() for i in range(6))
            keep = np.ones(len(dim), bool)
            for d in np.unique(dim):
                if int(d) in sent.value:
                    at, p = np.flatnonzero(dim == d), sent.value[int(d)][0]
                    norm = np.sqrt((p * p).sum(axis=1))
                    most = (p[q[at]] * p[x[at]]).sum(axis=1) + q_away[at] * norm[x[at]] + x_away[at] * norm[q[at]] + q_away[at] * x_away[at]
                    keep[at] = most + 1e-9 * np.abs(most) + 1e-6 >= floor[at]
            yield pa.RecordBatch.from_arrays([batch.column(i).filter(pa.array(keep)) for i in range(3)], ["dim", "q", "x"])

    # at most ``pivots`` rows of a length on either side
    near_q = buckets.groupBy("dim", F.col("pivot").alias("q")).agg(F.max("away").alias("q_away"), F.min("low").alias("floor"))
    near_x = blocks.groupBy("dim", F.col("pivot").alias("x")).agg(F.max("away").alias("x_away"))
    open_pivots = near_q.join(near_x, "dim").select("dim", "q", "x", "q_away", "x_away", "floor").mapInArrow(bounded, "dim int, q int, x int")
    of_q = buckets.select("dim", F.col("pivot").alias("q"), F.col("part").alias("bucket")).distinct()
    of_x = blocks.select("dim", F.col("pivot").alias("x"), F.col("part").alias("block")).distinct()
    pairs = open_pivots.join(of_q, ["dim", "q"]).join(of_x, ["dim", "x"]).select("dim", "bucket", "block").distinct()
    return blocks, buckets, materialize(pairs, "pairs")


def search(vectors: DataFrame, queries: DataFrame, k: int = K, pivots: int = PIVOTS, block: int = BLOCK) -> DataFrame:
    """vectors, queries: (vec_id, v).  query_id, rank, vec_id, score of each query's k best."""
    blocks, buckets, pairs = dealt(vectors, queries, k, pivots, block)
    asked = buckets.select("dim", F.col("part").alias("bucket"), "vec_id", "v", "low").join(pairs, ["dim", "bucket"])
    given = blocks.select("dim", F.col("part").alias("block"), "vec_id", "v").join(pairs, ["dim", "block"])

    def meet(key: tuple, q: pa.Table, x: pa.Table) -> pa.Table:
        empty = pa.table({"query_id": pa.array([], pa.int64()), "vec_id": pa.array([], pa.int64()), "score": pa.array([], pa.int64())})
        if not q.num_rows or not x.num_rows:
            return empty
        qid, xid = q["vec_id"].to_numpy(), x["vec_id"].to_numpy()
        s = Search(_matrix(q["v"]), qid, q["low"].to_numpy(), _matrix(x["v"]), xid, k)
        has = s.score > -np.inf
        return pa.table({"query_id": pa.array(np.repeat(qid, has.sum(axis=1))), "vec_id": pa.array(s.ids[has]), "score": pa.array(s.score[has].astype(np.int64))})

    found = asked.groupBy("dim", "bucket", "block").cogroup(given.groupBy("dim", "bucket", "block")).applyInArrow(meet, "query_id long, vec_id long, score long")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def search_twentieth(embeddings: DataFrame, k: int = K) -> DataFrame:
    """Queries: rows whose vec_id is divisible by 20; candidates: all rows."""
    v = integer_vectors(embeddings, "vec_id", "embedding")
    return search(v, v.where(F.col("vec_id") % 20 == 0), k)
