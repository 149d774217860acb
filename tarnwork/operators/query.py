"""Evidence queries: regular expressions per kind, all of which a file must meet."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import LOWER, UPPER

#: Regular-expression features of linear-time dialects only.
_BEYOND = re.compile(r"\(\?(?:[=!]|<[=!])|\\[1-9]")


class UsageError(ValueError):
    """Bad arguments; exit status 2."""


def pattern(flag: str, rx: str | None) -> str | None:
    """A checked pattern in which ``.`` stops at line feeds only."""
    if rx is None:
        return None
    if _BEYOND.search(rx):
        raise UsageError(f"invalid regex for --{flag}: look-around and back-references are not supported")
    try:
        re.compile(rx)
    except re.error as e:
        raise UsageError(f"invalid regex for --{flag}: {e}") from e
    return f"(?d){rx}"


@dataclass(frozen=True)
class Filters:
    calls: str | None = None
    imports: str | None = None
    signatures: str | None = None
    external: str | None = None
    any: str | None = None
    lang: str | None = None
    path: str | None = None

    def checked(self) -> Filters:
        if not any(v is not None for v in self.__dict__.values()):
            raise UsageError("no filter given")
        return Filters(**{k: (v if k == "lang" else pattern(k, v)) for k, v in self.__dict__.items()})


def about_file(f: Filters, lang: Column | None = None) -> Column:
    """Whether a file's language and path are asked for."""
    keep, lang = F.lit(True), F.col("lang") if lang is None else lang
    if f.lang is not None:
        keep = keep & (F.translate(F.coalesce(lang, F.lit("")), UPPER, LOWER) == f.lang.translate(str.maketrans(UPPER, LOWER)))
    return keep & F.col("path").rlike(f.path) if f.path is not None else keep


def matches(evidence: DataFrame, filters: Filters, files: DataFrame | None = None) -> DataFrame:
    """Distinct (path, lang, kind, line, text) of files in which every evidence filter has a hit.

    ``evidence``: locations and, with kind ``external`` and no line, external references.  Without an
    evidence filter the rows of ``files`` are listed, their evidence columns null.
    """
    f = filters.checked()
    hits = {
        "call": f.calls, "import": f.imports, "signature": f.signatures, "external": f.external,
    }
    asked = {k: (F.col("kind") == k) & F.col("text").rlike(rx) for k, rx in hits.items() if rx is not None}
    if f.any is not None:
        asked["any"] = F.col("text").rlike(f.any)
    if not asked:
        rows = (files if files is not None else evidence).where(about_file(f)).select("path", "lang").distinct()
        return rows.select("path", "lang", F.lit(None).cast("string").alias("kind"), F.lit(None).cast("int").alias("line"), F.lit(None).cast("string").alias("text"))
    rows = evidence.where(about_file(f))
    flags = {f"hit_{k}": c for k, c in asked.items()}
    any_hit = None
    for c in flags:
        any_hit = F.col(c) if any_hit is None else any_hit | F.col(c)
    rows = rows.withColumns(flags).where(any_hit)  # only rows that are hits leave the scan
    whole = Window.partitionBy("path")
    for c in flags:
        rows = rows.withColumn(c, F.max(c).over(whole))
    every = None
    for c in flags:
        every = F.col(c) if every is None else every & F.col(c)
    return rows.where(every).select("path", "lang", "kind", "line", "text").distinct()


def limited(found: DataFrame, limit: int, order: str = "path") -> DataFrame:
    """Evidence up to ``limit`` in walk order; counts stay whole and files beyond keep an empty row.

    Returns one row per file: path, lang, n_matched, n_shown.  The running sum is over files, in two
    steps: per range of the walk order and over the few ranges, so no task sees all files.
    """
    per = found.groupBy("path", "lang").agg(F.count("kind").alias("n"))
    if limit <= 0:
        return per.select("path", "lang", F.col("n").alias("n_matched"), F.col("n").alias("n_shown"))
    ranged = per.repartitionByRange(int(found.sparkSession.conf.get("spark.sql.shuffle.partitions")), order).sortWithinPartitions(order).withColumn("part", F.spark_partition_id())
    totals = ranged.groupBy("part").agg(F.sum("n").alias("t"))
    before = totals.select("part", (F.sum("t").over(Window.orderBy("part")) - F.col("t")).alias("before"))
    run = F.sum("n").over(Window.partitionBy("part").orderBy(order)) - F.col("n")
    out = ranged.withColumn("run", run).join(F.broadcast(before), "part")
    room = F.greatest(F.lit(0).cast("long"), F.lit(limit) - F.col("before") - F.col("run"))
    return out.select("path", "lang", F.col("n").alias("n_matched"), F.least(F.col("n"), room).alias("n_shown"))


def grep_lines(found: DataFrame) -> DataFrame:
    """(path, out): text lines as a pager shows them; a listed file is its bare path."""
    line = F.coalesce(F.col("line").cast("string"), F.lit("-"))
    return found.select("path", F.when(F.col("kind").isNull(), F.col("path")).otherwise(F.concat("path", F.lit(":"), line, F.lit(": "), "kind", F.lit(": "), "text")).alias("out"))
