"""Corpus-wide removal of repeated lines with levelled sorted runs of line hashes.

``LineRuns`` keeps the set of line keys seen so far as *runs*: tables bucketed and sorted by the 128-bit
hash of the key, one sorted file a bucket, pairwise disjoint.  A batch is reduced to one sorted table, a
row per key.  It is merge-anti-joined with the runs, bucket by bucket: both sides are read as they lie,
neither is shuffled nor sorted again.  What no run holds is a new run of level 0, with its counts; the
rest, counts for keys that some run holds, is a *delta*.  As soon as a level has two runs, they are
merged (a full outer merge join of sorted buckets) into one run of the next level; deltas are merged
alike.  ``compact()`` merges what is left to one run and one delta and joins the two: one row per key
with the documents that hold it and the largest doc_id.

``drop_repeated_lines`` feeds a table through the runs in batches, joins the keys that too many
documents hold back to the line positions, and rewrites the texts.  The ``HOT_KEYS`` most frequent keys
are joined from a broadcast table of that many rows, so that no line, however common, meets in one task.

DataFrame functions only.  Cases: a null or empty text is one empty line; null doc_id orders before
all ids; rows with equal doc_id count as one document and lose or keep a line alike (ties for the
largest id are this case); repeated rows are answered each; a key below ``min_chars`` is never dropped;
a very long text costs time in proportion to its lines; an empty table gives no rows; input columns
named n_lines or n_dropped are replaced, all others come back as they are, whatever their names.
"""

from __future__ import annotations

import contextlib
import uuid
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import id_or_min, materialize, shared_dir

MIN_CHARS = 20
MIN_DOCS = 3
BATCHES = 4
HOT_KEYS = 1000
BLANKS = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def line_key(line: Column) -> Column:
    """ASCII blanks stripped, A-Z lower-cased; plain ``lower`` where the line is ASCII, as it is faster."""
    key = F.btrim(line, F.lit(BLANKS))
    return F.when(F.octet_length(key) == F.char_length(key), F.lower(key)).otherwise(F.translate(key, UPPER, LOWER))


@contextlib.contextmanager
def sorted_buckets(spark: SparkSession) -> Iterator[None]:
    """Spark takes a bucket that is one sorted file for sorted only with this setting."""
    name = "spark.sql.legacy.bucketedTableScan.outputOrdering"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


class LineRuns:
    """The levelled runs; rows (h1, h2, n, last): documents with the key, their largest id."""

    KEY = ("h1", "h2")

    def __init__(self, spark: SparkSession, buckets: int | None = None):
        self.spark = spark
        self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.runs: list[list[str]] = [[]]  # by level, at most one of each between batches
        self.deltas: list[list[str]] = [[]]
        self.names: list[str] = []

    def _write(self, df: DataFrame) -> str:
        """One sorted file a bucket: each task of ``df`` holds one bucket."""
        name = f"line_run_{uuid.uuid4().hex}"
        writer = df.write.format("parquet").bucketBy(self.buckets, *self.KEY).sortBy(*self.KEY)
        writer.option("compression", "zstd").option("path", shared_dir(self.spark, "runs")).saveAsTable(name)
        self.names.append(name)
        return name

    def merged(self, one: str, two: str) -> DataFrame:
        """Two sorted tables as one, by a merge join of their buckets."""
        a, b = self.spark.table(one), self.spark.table(two).hint("merge")
        both = a.join(b, list(self.KEY), "full_outer")
        return both.select(*self.KEY, (F.coalesce(a["n"], F.lit(0)) + F.coalesce(b["n"], F.lit(0))).alias("n"), F.greatest(a["last"], b["last"]).alias("last"))

    def without(self, own: str, others: list[str]) -> DataFrame:
        """Rows of ``own`` whose key no other table has: merge-anti-joins of their buckets."""
        left = self.spark.table(own)
        for name in others:
            left = left.join(self.spark.table(name).select(*self.KEY).hint("merge"), list(self.KEY), "left_anti")
        return left

    def _put(self, levels: list[list[str]], name: str) -> None:
        """Add a table at level 0; two of a level are merged into one of the next."""
        level = 0
        while levels[level]:
            name = self._write(self.merged(levels[level].pop(), name))
            level += 1
            if level == len(levels):
                levels.append([])
        levels[level].append(name)

    def add(self, batch: DataFrame) -> None:
        """batch: (h1, h2, did), any number of times each; ids of a batch are in no other batch."""
        own = batch.groupBy(*self.KEY, "did").agg(F.lit(1).alias("one")).groupBy(*self.KEY).agg(F.count("did").alias("n"), F.max("did").alias("last"))
        own = self._write(own.repartition(self.buckets, *self.KEY))
        held = [n for level in self.runs for n in level]
        if not held:
            self._put(self.runs, own)
            return
        fresh = self._write(self.without(own, held))
        self._put(self.deltas, self._write(self.without(own, [fresh])))
        self._put(self.runs, fresh)

    def _one(self, levels: list[list[str]]) -> str | None:
        names = [n for level in levels for n in level]
        while len(names) > 1:
            names = [self._write(self.merged(names[0], names[1])), *names[2:]]
        return names[0] if names else None

    def compact(self) -> DataFrame:
        """One row per key over all batches."""
        run, delta = self._one(self.runs), self._one(self.deltas)
        a = self.spark.table(run)
        if delta is None:
            return a
        b = self.spark.table(delta).hint("merge")
        both = a.join(b, list(self.KEY), "left")
        return both.select(*self.KEY, (a["n"] + F.coalesce(b["n"], F.lit(0))).alias("n"), F.greatest(a["last"], b["last"]).alias("last"))

    def close(self) -> None:
        """Drop the catalog entries."""
        for n in self.names:
            self.spark.sql(f"DROP TABLE IF EXISTS {n}")
        self.names = []


def repeated_keys(lines: DataFrame, batches: int, min_docs: int, buckets: int | None) -> DataFrame:
    """(h1, h2, n, last) of the keys that at least ``min_docs`` documents hold."""
    spark = lines.sparkSession
    runs = LineRuns(spark, buckets)
    with sorted_buckets(spark):
        try:
            for b in range(batches):
                runs.add(lines.where(F.col("batch") == b).select("h1", "h2", "did"))
            return materialize(runs.compact().where(F.col("n") >= min_docs), "repeated")
        finally:
            runs.close()


def drop_repeated_lines(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS, batches: int = BATCHES, buckets: int | None = None) -> DataFrame:
    """The input's rows and columns with ``text`` rewritten, plus n_lines and n_dropped.

    A key of at least ``min_chars`` code points in at least ``min_docs`` documents loses its lines in
    all of them but the one of largest doc_id.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), id_or_min("doc_id").alias("did"), text.alias("text"), F.xxhash64(text).alias("th"))
    lines = (
        rows.select("did", "th", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
        .select("did", "th", "pos", line_key(F.col("line")).alias("key"))
        .where(F.char_length("key") >= min_chars)
        .select("did", "th", "pos", F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(1), "key").alias("h2"), F.pmod(F.xxhash64("did"), F.lit(batches)).cast("int").alias("batch"))
    )
    lines = materialize(lines, "lines", "batch")
    repeated = repeated_keys(lines, batches, min_docs, buckets)
    hot = F.broadcast(materialize(repeated.orderBy(F.desc("n"), "h1", "h2").limit(HOT_KEYS), "hot").select("h1", "h2", "last"))  # HOT_KEYS rows
    found = lines.join(hot, ["h1", "h2"]).unionByName(lines.join(hot, ["h1", "h2"], "left_anti").join(repeated.select("h1", "h2", "last"), ["h1", "h2"]))
    gone = found.where(F.col("did") != F.col("last")).groupBy("did", "th").agg(F.sort_array(F.collect_set("pos")).alias("gone"))
    # a flag for each line to the last that goes: as many kept ones as lie between two that go
    flags = F.flatten(F.transform("gone", lambda p, i: F.concat(F.array_repeat(F.lit(False), p - F.coalesce(F.get("gone", i - 1), F.lit(-1)) - 1), F.array(F.lit(True)))))
    gone = gone.select(F.col("did").alias("gone_did"), F.col("th").alias("gone_th"), F.size("gone").cast("long").alias("lost"), flags.alias("flags"))
    out = rows.join(gone.hint("shuffle_hash"), (F.col("did") == F.col("gone_did")) & (F.col("th") == F.col("gone_th")), "left")
    kept = F.array_join(F.filter(F.split("text", "\n"), lambda x, i: ~F.coalesce(F.get("flags", i), F.lit(False))), "\n")
    lost = F.coalesce("lost", F.lit(0).cast("long"))
    new = {"text": F.when(F.col("flags").isNull(), F.col("text")).otherwise(kept), "n_lines": F.size(F.split("text", "\n")).cast("long"), "n_dropped": lost}
    columns = [c for c in docs.columns if c not in ("n_lines", "n_dropped")]
    return out.select(*(new[c].alias(c) if c == "text" else F.col(f"row.`{c}`") for c in columns), *(new[c].alias(c) for c in ("n_lines", "n_dropped")))
