"""What a tree's ledger gained or lost by (capability, path, trimmed text).

Both ledgers are computed once and tagged with their side; one aggregation by key then tells which keys
only one side has, and the first entry of each in ledger order.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import strip
from ..session import cut
from .surface import COLUMNS


def without_wrapper(entries: DataFrame) -> DataFrame:
    """Drop the leading directory of each ``side`` whose paths all have the same one; two-row aggregate, broadcast."""
    first = F.substring_index("path", "/", 1)
    inside = F.contains("path", F.lit("/"))
    facts = entries.groupBy("side").agg(F.min(first).alias("lo"), F.max(first).alias("hi"), F.bool_and(inside).alias("inside"))
    shared = facts.select("side", F.when((F.col("lo") == F.col("hi")) & F.col("inside") & (F.col("lo") != ""), F.concat("lo", F.lit("/"))).alias("wrapper"))
    out = entries.join(F.broadcast(shared), "side")
    cut_off = F.when(F.col("wrapper").isNotNull(), F.substring(F.col("path"), F.char_length("wrapper") + 1, F.char_length("path"))).otherwise(F.col("path"))
    return out.withColumn("path", cut_off).drop("wrapper")


def diff(a: DataFrame, b: DataFrame) -> DataFrame:
    """(side, entry): added in b, removed from a."""
    both = cut(a.select(*COLUMNS, F.lit("removed").alias("side")).unionByName(b.select(*COLUMNS, F.lit("added").alias("side"))))
    # of equal capability, in ledger order: line (none first), evidence, text
    rest = [c for c in ("line", "evidence", "text", "trigger", "confidence", "scope")]
    rows = without_wrapper(both).groupBy("capability", "path", strip(F.col("text")).alias("key"))
    rows = rows.agg(F.min("side").alias("side"), F.max("side").alias("other"), F.min(F.struct(*rest)).alias("e")).where("side = other")
    return rows.select("side", "capability", "path", "e.*").select("side", *COLUMNS)
