"""Shared storage and small DataFrame helpers for the training-data operators.

Intermediate tables go to the folder that ``spark.checkpoint.dir`` names, which the driver and all
executors share; a lost executor loses no intermediate result.  Where the setting is absent, a session
on one machine (``local`` master: tests) gets a folder of its own; a cluster must set it.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ship_code

#: Stands for a null id, before all others.
MIN_LONG = -(1 << 63)


def shared_dir(spark: SparkSession, name: str) -> str:
    """A fresh path below the cluster's shared folder."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = "file://" + tempfile.mkdtemp(prefix="tarnwork-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/tarnwork/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str, *partition_by: str) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back: cuts lineage, survives executors."""
    spark = df.sparkSession
    path = shared_dir(spark, name)
    writer = df.write.option("compression", "zstd")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold(doc_id: str | Column, mod: int) -> Column:
    """crc32 of the id as text, modulo ``mod`` (null for a null id)."""
    c = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.crc32(c.cast("string").cast("binary")) % F.lit(mod)


def id_or_min(c: str | Column) -> Column:
    """Null ids order before all others."""
    c = F.col(c) if isinstance(c, str) else c
    return F.coalesce(c.cast("long"), F.lit(MIN_LONG))


__all__ = ["MIN_LONG", "fold", "id_or_min", "materialize", "read_table", "shared_dir", "ship_code"]
