"""Repository references and limits of a fetched checkout (the fetch itself is an outside step)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MAX_FILES, MAX_TREE_BYTES = 20_000, 250 << 20


def valid_segment(c: Column) -> Column:
    """Owner or repository name."""
    return c.rlike(r"^[A-Za-z0-9._-]{1,100}$") & ~c.isin(".", "..")


def valid_ref(c: Column) -> Column:
    """A ref that is safe as an argument."""
    return c.rlike(r"^[A-Za-z0-9._/-]{1,200}$") & ~F.startswith(c, F.lit("-")) & ~F.contains(c, F.lit("..")) & ~F.startswith(c, F.lit("/")) & ~F.endswith(c, F.lit("/"))


def parse_repo(c: Column) -> Column:
    """(owner, repo) of owner/repo or its https URL; null if it is neither."""
    bare = F.regexp_replace(F.regexp_replace(c, r"^https://github\.com/", ""), r"(\.git)?/?$", "")
    owner, repo = F.get(F.split(bare, "/"), F.lit(0)), F.get(F.split(bare, "/"), F.lit(1))
    return F.when((F.size(F.split(bare, "/")) == 2) & valid_segment(owner) & valid_segment(repo), F.struct(owner.alias("owner"), repo.alias("repo")))


def inspected(files: DataFrame) -> DataFrame:
    """One row: counts, sizes, submodules, large-file pointers, and whether limits hold."""
    lfs = (F.col("path").rlike(r"(^|/)\.gitattributes$")) & F.contains(F.col("content").cast("string"), F.lit("filter=lfs"))
    facts = files.agg(F.count("*").alias("n_files"), F.coalesce(F.sum("length"), F.lit(0)).alias("n_bytes"), F.coalesce(F.bool_or(F.col("path") == ".gitmodules"), F.lit(False)).alias("submodules"), F.coalesce(F.bool_or(lfs), F.lit(False)).alias("lfs"))
    return facts.withColumn("within_limits", (F.col("n_files") <= MAX_FILES) & (F.col("n_bytes") <= MAX_TREE_BYTES))


def annotated(reports: DataFrame, owner: str, repo: str, sha: str) -> DataFrame:
    """A report with where its tree came from."""
    return reports.withColumn("source", F.struct(F.lit(owner).alias("owner"), F.lit(repo).alias("repo"), F.lit(sha).alias("commit")))
