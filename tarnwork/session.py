"""Session helpers."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession

_SHIPPED: set[str] = set()


def ship_code(spark: SparkSession) -> None:
    """Give the Python workers this package, through Spark's own file distribution, once a session."""
    app = spark.sparkContext.applicationId
    if app in _SHIPPED:
        return
    _SHIPPED.add(app)
    top = os.path.dirname(os.path.abspath(__file__))
    path = os.path.join(tempfile.mkdtemp(prefix="tarnwork-code-"), "tarnwork_code.zip")
    with zipfile.ZipFile(path, "w") as z:
        for d, _, names in os.walk(top):
            for n in names:
                if n.endswith(".py"):
                    full = os.path.join(d, n)
                    z.write(full, os.path.relpath(full, os.path.dirname(top)))
    spark.sparkContext.addPyFile(path)


def cut(df: DataFrame) -> DataFrame:
    """``df`` computed once: in the checkpoint folder that the cluster names; in memory on one machine."""
    spark = df.sparkSession
    if spark.conf.get("spark.checkpoint.dir", None):
        return df.checkpoint()
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
    return df.persist()


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder below the checkpoint folder that the cluster names; one of its own on one machine."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base is None:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = tempfile.mkdtemp(prefix="tarnwork-")
    return f"{base.rstrip('/')}/tarnwork/{name}-{uuid.uuid4().hex}"
