"""Near-duplicate classes of documents by DartMinHash signatures, banded and exactly verified.

A document is a weighted set of five-word shingles, the weight being the number of occurrences.  As
in DartMinHash, darts fall on each unit of weight of an element as a Poisson process in rank that
depends on the element alone; a document of total weight w looks at ranks up to t/w, so that it meets
about t = k ln k + 2k darts whatever its size, hashes every dart to one of k coordinates and keeps the
earliest per coordinate (rows with an unmet coordinate look twice as far, until none is unmet).  Two
documents agree in a coordinate with the probability of their weighted Jaccard similarity.

1. Equal texts are collapsed to one, which has the smallest of their doc_ids; only these go on.
2. Signatures are cut into bands; representatives with an equal band share a bucket.
3. In each bucket all members are compared with its smallest id: as the smallest id of a group of
   copies leads nearly all of the group's buckets, a group of n gives about n pairs, not n squared.
   Both the minimum and the join back to the members split hot buckets.
4. Buckets whose members (the leader aside, which has met all) are not yet in one linked set are
   searched again, like the leader or not, by a set-similarity join with the prefix filter on shingles
   sorted by rareness, in blocks of bounded size: members outside the bucket's largest linked set meet
   each other and all of that set, whose members do not meet each other.  So every pair that shared a
   bucket is compared or already linked; nothing is emitted but verified links.
5. Links are resolved to connected components by repeated minimum-label contraction.

Similarity is the exact weighted Jaccard similarity of the shingle multisets, at least ``threshold``.
With the defaults a pair at 0.8 meets in some band with probability 0.99994.

Cases: texts without words (null, empty, blank) are alone in their class unless other rows of their doc_id
have words; texts shorter than five words have one shingle of all words; rows of equal doc_id form one
document with all links of their texts, and so have one class;
repeated rows get the same class; ties for a class's representative go to the smallest doc_id; rows of
null doc_id get a null class and link nothing; very long texts are hashed whole, one at a time; an empty
table gives no rows; only doc_id and text are read, so other columns may have any name.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import materialize
from .shingles import U, buffers, chunks, mix, shingles, words

WIDTH = 5
THRESHOLD = 0.8
BANDS = 32
ROWS = 6
#: Members of a bucket that are compared in one task, in step 4.
BLOCK = 1024
SIGNED = "doc_id long, t1 long, t2 long, n_cells long, bands array<long>"
_STEP, _SALT, _NAME = U(0xA0761D6478BD642F), U(0xE7037ED1A0B428DB), U(0x8EBC6AF09C88C6E3)


def cells(shingle: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """One cell for each unit of weight: the n-th occurrence of a shingle in a row is a cell of its own."""
    order = np.lexsort((shingle, row))
    s, r = shingle[order], row[order]
    if not len(s):
        return s, r
    new = np.ones(len(s), bool)
    new[1:] = (s[1:] != s[:-1]) | (r[1:] != r[:-1])
    at = np.arange(len(s))
    nth = at - np.maximum.accumulate(np.where(new, at, 0))
    with np.errstate(over="ignore"):
        return np.where(nth > 0, mix(s + nth.astype(np.uint64) * _STEP), s), r


def _waits(x: np.ndarray) -> np.ndarray:
    """Exponential variates from hashes."""
    return -np.log(((x >> U(11)).astype(np.float64) + 0.5) * (1.0 / (1 << 53)))


def dart_minhash(cell: np.ndarray, row: np.ndarray, rows: int, k: int) -> np.ndarray:
    """(rows, k) signatures of dart names; rows without cells keep zeros."""
    sig = np.zeros(rows * k, np.uint64)
    weight = np.bincount(row, minlength=rows).astype(np.float64)
    reach = np.where(weight > 0, (k * np.log(k) + 2 * k) / np.maximum(weight, 1), 0.0)
    todo = weight > 0
    with np.errstate(over="ignore"):
        while todo.any():
            pick = todo[row]
            c, r = cell[pick], row[pick]
            rank, n = np.zeros(len(c)), 0
            found_rank, found_at, found_name = [], [], []
            while len(c):
                x = mix(c + U(n) * _STEP + _SALT)
                rank = rank + _waits(x)
                near = rank <= reach[r]
                c, r, rank, x = c[near], r[near], rank[near], x[near]
                name = mix(x ^ _NAME)
                found_rank.append(rank)
                found_at.append(r * k + (name % U(k)).astype(np.int64))
                found_name.append(name)
                n += 1
            ranks, at, names = np.concatenate(found_rank), np.concatenate(found_at), np.concatenate(found_name)
            order = np.argsort(-ranks, kind="stable")  # of equal places the last, the earliest dart, stays
            met = np.zeros(rows * k, bool)
            met[at] = True
            sig[at[order]] = names[order]
            todo &= ~met.reshape(rows, k).all(axis=1)
            reach[todo] *= 2
    return sig.reshape(rows, k)


def band_keys(sig: np.ndarray, bands: int) -> np.ndarray:
    rows, k = sig.shape
    with np.errstate(over="ignore"):
        out = np.zeros((rows, bands), np.uint64)
        parts = sig.reshape(rows, bands, k // bands)
        for j in range(k // bands):
            out = out * U(0x9FB21C651E98DF25) + parts[:, :, j]
        return mix(out + np.arange(bands, dtype=np.uint64)[None, :] * _STEP).view(np.int64)


def signatures(docs: DataFrame, bands: int = BANDS, rows_per_band: int = ROWS, width: int = WIDTH) -> DataFrame:
    """doc_id, hashes of the exact text, number of cells, band keys (empty without words)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = buffers(batch.column(3))
            for a, b in chunks(offsets, 2 << 20):
                word, at = words(data, offsets[a : b + 1])
                cell, row = cells(*shingles(word, at, width))
                keys = band_keys(dart_minhash(cell, row, b - a, bands * rows_per_band), bands)
                n = np.bincount(row, minlength=b - a)
                counts = np.where(n > 0, bands, 0)
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)), pa.array(keys[n > 0].reshape(-1)))
                yield pa.RecordBatch.from_arrays([batch.column(i).slice(a, b - a) for i in range(3)] + [pa.array(n.astype(np.int64)), lists], ["doc_id", "t1", "t2", "n_cells", "bands"])

    text = F.col("text").cast("string")
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("t1"), F.xxhash64(F.lit(1), text).alias("t2"), text.alias("text"))
    return d.mapInArrow(run, SIGNED)


def _blobs(docs: DataFrame, wanted: DataFrame, width: int) -> DataFrame:
    """id, sorted cell hashes of the wanted texts (rep, t1, t2, id)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = buffers(batch.column(1))
            for a, b in chunks(offsets):
                word, at = words(data, offsets[a : b + 1])
                cell, row = cells(*shingles(word, at, width))
                cell, edge = cell[np.lexsort((cell, row))], np.searchsorted(row, np.arange(b - a + 1))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array([cell[x:y].tobytes() for x, y in zip(edge[:-1], edge[1:], strict=True)], pa.binary())], ["id", "cells"])

    text = F.col("text").cast("string")
    d = docs.select(F.col("doc_id").cast("long").alias("rep"), text.alias("text"), F.xxhash64(text).alias("t1"), F.xxhash64(F.lit(1), text).alias("t2"))
    d = d.join(wanted.hint("shuffle_hash"), ["rep", "t1", "t2"]).select("id", "text")
    return d.mapInArrow(run, "id long, cells binary").groupBy("id").agg(F.first("cells").alias("cells"))  # repeated rows have equal cells


def overlap(a: bytes, b: bytes) -> tuple[int, int]:
    """Common and all cells of two blobs (multisets)."""
    x, y = np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)
    z = np.concatenate([x, y])
    z.sort(kind="stable")
    common = int((z[1:] == z[:-1]).sum()) if len(z) else 0
    return common, len(z) - common


def similar(a: bytes, b: bytes, threshold: float) -> bool:
    if min(len(a), len(b)) < threshold * max(len(a), len(b)) or not a:
        return False
    common, union = overlap(a, b)
    return common >= threshold * union - 1e-9


def links_among(ids: list[int], blobs: list[bytes], side: list[int], cross: bool, threshold: float, linked: list[int] | None = None) -> list[tuple[int, int]]:
    """Verified links that connect what is similar among the members, found by a prefix-filtered join.

    side: 0 or 1; members of side 1 meet those of side 0 only, and with ``cross`` so do those of side 0.
    linked: members of equal value need no link.
    """
    arrays = [np.unique(np.frombuffer(b, np.uint64)) for b in blobs]
    tokens, freq = np.unique(np.concatenate(arrays), return_counts=True)
    first: dict[int, int] = {}
    group = [first.setdefault(v, x) for x, v in enumerate(linked or ids)]

    def root(x: int) -> int:
        while group[x] != x:
            group[x] = group[group[x]]
            x = group[x]
        return x

    index: tuple[dict[int, list[int]], dict[int, list[int]]] = ({}, {})
    out = []
    for x in sorted(range(len(ids)), key=lambda x: (len(blobs[x]), ids[x])):
        a = arrays[x]
        f = freq[np.searchsorted(tokens, a)]
        rare = a[np.lexsort((a, f))]
        # cells that a pair may lack, of the blob with its repetitions; those and one more must meet
        lacks = len(blobs[x]) // 8 - int(np.ceil(threshold * (len(blobs[x]) // 8) - 1e-9))
        prefix = rare[: lacks + 1].tolist()
        seen: set[int] = set()
        for met in [index[0]] if side[x] else [index[1]] if cross else index:
            for t in prefix:
                for y in met.get(t, ()):
                    if y in seen:
                        continue
                    seen.add(y)
                    if root(x) != root(y) and similar(blobs[x], blobs[y], threshold):
                        group[root(x)] = root(y)
                        out.append((min(ids[x], ids[y]), max(ids[x], ids[y])))
        for t in prefix:
            index[side[x]].setdefault(t, []).append(x)
    return out


def _verify(pairs: DataFrame, blobs: DataFrame, threshold: float) -> DataFrame:
    """pairs (a, b) with ``ok``: whether they are similar."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ok = [similar(x.as_py(), y.as_py(), threshold) for x, y in zip(batch.column(2), batch.column(3), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(ok, pa.bool_())], ["a", "b", "ok"])

    both = pairs.join(blobs.select(F.col("id").alias("b"), F.col("cells").alias("cb")), "b").join(blobs.select(F.col("id").alias("a"), F.col("cells").alias("ca")), "a")
    return both.select("a", "b", "ca", "cb").mapInArrow(run, "a long, b long, ok boolean")


def _rest_links(rest: DataFrame, blobs: DataFrame, threshold: float) -> DataFrame:
    """Links among members of a bucket, (bucket, id, linked) rows, that are not in one linked set, in blocks."""
    sets = rest.groupBy("bucket", "linked").agg(F.count("*").alias("n"))
    size = sets.groupBy("bucket").agg(F.max_by("linked", F.struct("n", "linked")).alias("most"), F.max("n").alias("n1"), F.sum("n").alias("n"), F.count("*").alias("k")).where("k > 1")
    blocks = [F.ceil(n / F.lit(BLOCK)).cast("int").alias(m) for n, m in ((F.col("n") - F.col("n1"), "m0"), (F.col("n1"), "m1"))]
    r = rest.join(size.select("bucket", "most", *blocks), "bucket").withColumn("side", F.when(F.col("linked") == F.col("most"), 1).otherwise(0))
    r = r.withColumn("own", F.pmod(F.xxhash64("id"), F.when(F.col("side") == 1, F.col("m1")).otherwise(F.col("m0"))).cast("int"))
    # the largest set (side 1) against the others (side 0); a single block of others meets itself there too
    at = r.withColumn("other", F.explode(F.sequence(F.lit(0), F.when(F.col("side") == 1, F.col("m0")).otherwise(F.col("m1")) - 1)))
    i, j = F.when(F.col("side") == 1, F.col("other")).otherwise(F.col("own")), F.when(F.col("side") == 1, F.col("own")).otherwise(F.col("other"))
    at = at.select("bucket", "id", "linked", F.lit(1).alias("kind"), i.alias("i"), j.alias("j"), "side", ((F.col("m0") > 1) | (j > 0)).alias("cross"))
    # several blocks of others against each other
    among = r.where("side = 0 and m0 > 1").withColumn("other", F.explode(F.sequence(F.lit(0), F.col("m0") - 1)))
    i, j = F.least("own", "other"), F.greatest("own", "other")
    among = among.select("bucket", "id", "linked", F.lit(0).alias("kind"), i.alias("i"), j.alias("j"), F.when(F.col("own") <= F.col("other"), 0).otherwise(1).alias("side"), (i != j).alias("cross"))
    r = at.unionByName(among).join(blobs, "id")

    def run(key: tuple, table: pa.Table) -> pa.Table:
        links = links_among(table["id"].to_pylist(), table["cells"].to_pylist(), table["side"].to_pylist(), table["cross"][0].as_py(), threshold, table["linked"].to_pylist())
        return pa.table({"a": pa.array([x for x, _ in links], pa.int64()), "b": pa.array([y for _, y in links], pa.int64())})

    return r.groupBy("bucket", "kind", "i", "j").applyInArrow(run, "a long, b long")


def components(links: DataFrame) -> DataFrame:
    """(id, class): the smallest id that each linked id reaches.

    Every round hangs each node and its neighbours on the smallest id among them (large star and
    small star in one); the number of rounds is logarithmic in the longest chain.
    """
    edges = materialize(links.select("a", "b").where("a <> b").distinct(), "edges")
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("low"))
        hung = both.join(low, "a").select(F.col("b").alias("x"), F.col("low").alias("y")).unionByName(low.select(F.col("a").alias("x"), F.col("low").alias("y")))
        new = materialize(hung.where("x <> y").select(F.greatest("x", "y").alias("b"), F.least("x", "y").alias("a")).distinct(), "edges")
        # done when every node hangs on one root and no root hangs itself
        state = new.groupBy("b").agg(F.count("*").alias("n"))
        if not new.join(state.select(F.col("b").alias("a")), "a", "left_semi").limit(1).count() and not state.where("n > 1").limit(1).count():
            return new.select(F.col("b").alias("id"), F.col("a").alias("class"))
        edges = new


def near_duplicates(docs: DataFrame, threshold: float = THRESHOLD, bands: int = BANDS, rows_per_band: int = ROWS, width: int = WIDTH) -> DataFrame:
    """One row per document row: doc_id, class_id, rep_id (smallest id of the equal texts).

    The nodes of the graph are distinct texts, numbered; a document of several texts links them.
    """
    signed = materialize(signatures(docs, bands, rows_per_band, width), "signed")
    texts = signed.where("doc_id is not null and n_cells > 0").groupBy("t1", "t2").agg(F.min_by(F.struct("doc_id", "bands"), "doc_id").alias("r"))
    texts = materialize(texts.select(F.monotonically_increasing_id().alias("id"), "t1", "t2", F.col("r.doc_id").alias("rep"), "r.bands"), "texts")
    members = materialize(texts.select("id", F.explode("bands").alias("bucket")), "buckets")
    leaders = members.groupBy("bucket").agg(F.min("id").alias("a"), F.count("*").alias("n")).where("n > 1").select("bucket", "a")
    led = materialize(members.join(leaders, "bucket").where("id <> a").select("bucket", "a", F.col("id").alias("b")), "led")
    pairs = led.select("a", "b").distinct()
    wanted = led.select(F.col("a").alias("id")).unionByName(led.select(F.col("b").alias("id"))).distinct()
    wanted = wanted.join(texts.select("id", "rep", "t1", "t2"), "id")
    blobs = materialize(_blobs(docs, wanted, width), "blobs")
    verified = materialize(_verify(pairs, blobs, threshold), "verified")
    first = components(verified.where("ok").select("a", "b"))
    rest = led.select("bucket", F.col("b").alias("id")).join(first, "id", "left").select("bucket", "id", F.coalesce("class", "id").alias("linked"))
    rows = materialize(signed.where("n_cells > 0").select("doc_id", "t1", "t2").join(texts.select("id", "t1", "t2", "rep"), ["t1", "t2"], "left").select("doc_id", "id", "rep"), "rows")
    # rows of one doc_id with several texts are one document: it links its texts
    several = rows.where("doc_id is not null").groupBy("doc_id").agg(F.min("id").alias("a"), F.max("id").alias("z")).where("a < z").select("doc_id", "a")
    own = rows.join(several, "doc_id").select("a", F.col("id").alias("b"))
    links = first.select(F.col("class").alias("a"), F.col("id").alias("b")).unionByName(_rest_links(rest, blobs, threshold)).unionByName(own)
    found = materialize(components(links), "classes").withColumnRenamed("class", "root")
    names = found.join(texts.select("id", "rep"), "id").groupBy("root").agg(F.min("rep").alias("class_id"))
    names = names.join(texts.select(F.col("id").alias("root"), F.col("rep").alias("root_rep")), "root").select("root", F.least("class_id", "root_rep").alias("class_id"))
    classes = found.join(names, "root").select("id", "class_id").unionByName(names.withColumnRenamed("root", "id"))  # no root is its own row
    out = rows.join(classes, "id", "left").withColumn("class_id", F.coalesce("class_id", "rep"))
    named = F.col("doc_id").isNotNull()
    out = out.select("doc_id", F.when(named, F.col("class_id")).alias("class_id"), F.when(named, F.col("rep")).alias("rep_id"))
    # a text without words belongs to its document's other texts, if there are any
    blank = signed.where("n_cells = 0").select("doc_id")
    others = out.join(blank.where("doc_id is not null").distinct(), "doc_id", "left_semi").groupBy("doc_id").agg(F.min("class_id").alias("class_id"))
    return out.unionByName(blank.join(others, "doc_id", "left").select("doc_id", F.coalesce("class_id", "doc_id").alias("class_id"), F.col("doc_id").alias("rep_id")))


def keep_one_of_each(docs: DataFrame, **options) -> DataFrame:
    """The documents whose id is the smallest of its class (and all of null id); all columns."""
    found = near_duplicates(docs, **options)
    gone = found.where("doc_id is not null and doc_id <> class_id").select("doc_id").distinct().alias("gone")
    return docs.join(gone.hint("shuffle_hash"), docs["doc_id"].cast("long") == F.col("gone.doc_id"), "left_anti")
