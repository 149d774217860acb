"""Go or no go: coverage, verdict, reasons and blockers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from .paths import scope, severity_rank

STATUSES = ("dehydrated", "unsupported", "read_failed", "parse_failed", "serialization_failed")


def _outcomes() -> list[Column]:
    """Counts by status of rows with ``status``, one per candidate file."""
    counts = [F.count_if(F.col("status") == s).alias(f"{s}_files" if s in ("dehydrated", "unsupported") else s) for s in STATUSES]
    return [F.count("*").alias("candidate_files"), *counts]


def _sizes() -> list[Column]:
    return [F.count_if(F.col("truncated")).alias("record_truncated"), F.coalesce(F.sum("seed_bytes"), F.lit(0)).cast("long").alias("seed_bytes")]


def coverage(files: DataFrame) -> DataFrame:
    """One row of counts over (status, truncated, seed_bytes) rows, one per candidate file."""
    return files.agg(*_outcomes(), *_sizes())


def counted(files: DataFrame, seen: Observation) -> DataFrame:
    """``files``, whose next pass counts their statuses on the way."""
    return files.observe(seen, *_outcomes())


def coverage_on_the_way(seeds: DataFrame, seen: Observation) -> DataFrame:
    """The coverage row of ``counted`` files, without reading them again; ``seeds``: (truncated, seed_bytes), made from them.

    Sums up ``seeds`` first, the pass by which the counts of ``seen`` are there where nothing else has asked for them.
    """
    sizes = seeds.agg(*_sizes()).first()
    counts = seen.get | sizes.asDict()
    return seeds.sparkSession.range(1).select(*(F.lit(n).cast("long").alias(c) for c, n in counts.items()))


def incomplete_reasons(cov: DataFrame, n_artifacts: str = "n_artifacts", limit: int | None = None) -> DataFrame:
    """The coverage row with ``reasons``, why it does not support a verdict."""
    failed = [F.when(F.col(c) > 0, F.concat(F.lit(f"{c}="), F.col(c).cast("string"))) for c in ("read_failed", "parse_failed", "serialization_failed")]
    none = F.when((F.col("candidate_files") > 0) & (F.col("dehydrated_files") == 0) & (F.col(n_artifacts) == 0), "no_supported_files_dehydrated")
    most = [F.when(F.col("candidate_files") > limit, F.concat(F.lit("candidate_files="), F.col("candidate_files").cast("string"), F.lit(f" exceeds policy max_candidate_files={limit}")))] if limit is not None else []
    return cov.withColumn("reasons", F.array_compact(F.array(*failed, none, *most)))


def verdict(findings: DataFrame, artifacts: DataFrame, cov: DataFrame, limit: int | None = None) -> DataFrame:
    """One row: verdict, safe, counts, reasons.  Three one-row aggregates, put side by side."""
    f = findings.agg(F.count("*").alias("n_findings"), F.count_if(F.col("severity") == "high").alias("n_high"))
    a = artifacts.agg(F.count("*").alias("n_artifacts"))
    row = incomplete_reasons(cov.crossJoin(f).crossJoin(a), limit=limit)
    out = F.when(F.size("reasons") > 0, "INCOMPLETE").when(F.col("n_high") > 0, "REJECT").when((F.col("n_artifacts") > 0) | (F.col("n_findings") > 0), "CAUTION").otherwise("ACCEPT")
    return row.withColumn("verdict", out).withColumn("safe_to_agent_run", F.col("verdict") == "ACCEPT")


def summary(found: DataFrame):
    """Column: one finding as a line."""
    at = F.when(F.col("line").isNotNull(), F.concat("path", F.lit(":"), F.col("line").cast("string"))).otherwise(F.col("path"))
    return F.concat(at, F.lit(" ["), "rule", F.lit("]: "), "title", F.lit(" ("), "evidence", F.lit(") [scope="), scope(F.col("path")), F.lit("]"))


def _order(before: str):
    return [severity_rank(F.col(before)), "path", F.asc_nulls_first("line"), "rule", "rule_seq", "evidence"]


def blockers(found: DataFrame, k: int = 10, before: str = "severity") -> DataFrame:
    """The first k findings above low, in the order that they had before policy."""
    return found.where(F.col("severity") != "low").orderBy(*_order(before)).limit(k).select(summary(found).alias("blocker"))


def why(found: DataFrame, k: int = 3, before: str = "severity") -> DataFrame:
    return found.orderBy(*_order(before)).limit(k).select(F.concat(F.upper("severity"), F.lit(" "), summary(found)).alias("why"))
