"""Ledgers of snapshots as a stream: each snapshot emits only what its trees gained or lost.

A feed has one row for each path of a snapshot: (tree, snapshot, path, keys, docs), its distinct entries by key, the key
being capability and trimmed text, the document the first entry of that key in ledger order.  A path whose entries are
gone has a row without entries.  State is keyed by tree and bucket of paths and holds each path's entries of the last
snapshot seen of it, so no tree is ever in one task, and a snapshot may send the paths that changed alone; a bucket's state
is one row, as calls of the keyed function cost more than the paths do.

    feed = snapshot_feed(entries, "pkg", 2, before=entries_of_1)      # append to the folder of feeds
    changes(read_feed(spark, folder)).writeStream...

Cases: the first snapshot of a path gains all its entries; a snapshot not above the last seen of its path, so one that is
sent again or late, emits nothing; rows of one path and snapshot in one batch count together; null trees are a tree.
Leading folders that all paths share are kept: strip them before.  ``stateful`` keeps the
state in RocksDB.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions.text import strip
from ..operators.surface import COLUMNS
from ..session import shared_folder, ship_code

FEED = "tree string, snapshot long, path string, keys array<string>, docs array<string>"
DOC = "line int, evidence string, text string, trigger string, confidence string, scope string"
CHANGES = "tree string, path string, snapshot long, side string, key string, doc string"
HELD = "paths array<string>, last array<long>, keys array<array<string>>, docs array<array<string>>"
#: Buckets of a tree's paths.
BUCKETS = 1024
STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def snapshot_feed(entries: DataFrame, tree: str, snapshot: int, before: DataFrame | None = None) -> DataFrame:
    """The feed rows of a snapshot; ``before``: paths of the one before, of which those without entries now are emptied."""
    first = F.min(F.struct(*(n.split()[0] for n in DOC.split(", "))))
    rows = entries.select(*COLUMNS).groupBy("path", "capability", strip(F.col("text")).alias("key")).agg(first.alias("doc"))
    # by length, so that no two pairs spell one key
    key = F.concat(F.char_length("capability").cast("string"), F.lit(":"), "capability", "key")
    each = F.struct(key.alias("k"), F.to_json("doc").alias("d"))
    paths = rows.groupBy("path").agg(F.collect_list(each).alias("e"))
    if before is not None:
        paths = before.select("path").distinct().join(paths, "path", "full").withColumn("e", F.coalesce("e", F.array().cast("array<struct<k:string,d:string>>")))
    return paths.select(F.lit(tree).alias("tree"), F.lit(snapshot).cast("long").alias("snapshot"), "path", F.col("e.k").alias("keys"), F.col("e.d").alias("docs"))


def read_feed(spark: SparkSession, folder: str, files_per_batch: int = 100) -> DataFrame:
    return spark.readStream.schema(FEED).option("maxFilesPerTrigger", files_per_batch).parquet(folder)


def held_changes(key: tuple, rows: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """The changes of one bucket's paths, each by what it held as of its own last snapshot."""
    arrived: dict[str, dict[int, dict[str, str]]] = {}
    for batch in rows:
        for path, number, keys, docs in zip(batch["path"], batch["snapshot"], batch["keys"], batch["docs"], strict=True):
            arrived.setdefault(path, {}).setdefault(int(number), {}).update(zip(keys, docs, strict=True))
    held: dict[str, tuple[int, dict[str, str]]] = {}
    if state.exists:
        held = {path: (last, dict(zip(keys, docs, strict=True))) for path, last, keys, docs in zip(*state.get, strict=True)}
    out = []
    for path, snapshots in arrived.items():
        last, had = held.get(path, (None, {}))
        for number in sorted(n for n in snapshots if last is None or n > last):
            now = snapshots[number]
            out += [(key[0], path, number, "removed", k, doc) for k, doc in had.items() if k not in now]
            out += [(key[0], path, number, "added", k, doc) for k, doc in now.items() if k not in had]
            last, had = number, now
        held[path] = (last, had)
    state.update(([*held], [n for n, _ in held.values()], [[*e] for _, e in held.values()], [[*e.values()] for _, e in held.values()]))
    if out:
        yield pd.DataFrame(out, columns=[n.split()[0] for n in CHANGES.split(", ")])


def stateful(spark: SparkSession) -> None:
    """State in RocksDB, so that it need not fit an executor's memory."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)


def changes(feed: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """(tree, snapshot, side, entry): what each snapshot gained (added) or lost (removed); a checkpoint keeps to its ``buckets``."""
    ship_code(feed.sparkSession)
    rows = feed.where("snapshot is not null and path is not null").withColumn("bucket", F.pmod(F.xxhash64("path"), F.lit(buckets)))
    rows = rows.groupBy("tree", "bucket")
    rows = rows.applyInPandasWithState(held_changes, CHANGES, HELD, "append", GroupStateTimeout.NoTimeout)
    length = F.substring_index("key", ":", 1)
    capability = F.substring("key", F.char_length(length) + 2, length.cast("int"))
    return rows.select("tree", "snapshot", "side", capability.alias("capability"), "path", F.from_json("doc", DOC).alias("e")).select("tree", "snapshot", "side", "capability", "path", "e.*").select("tree", "snapshot", "side", *COLUMNS)


def replay(snapshots: list[DataFrame], checkpoint: str, out: str) -> DataFrame:
    """All changes of snapshots that arrive one after the other; ``out`` then holds them as Parquet."""
    spark = snapshots[0].sparkSession
    stateful(spark)
    feed = shared_folder(spark, "feed")
    for rows in snapshots:
        rows.write.mode("append").parquet(feed)
        changes(read_feed(spark, feed)).writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(out)
