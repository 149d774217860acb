"""Evidence that arrives in files: a file stream of evidence rows to findings.

Rules of lines are judged in each micro-batch.  Rules of whole trees are not: a manifest and its lockfile, or the
lines of one container file, may come in different batches.  Their facts are streaming aggregations, whose state holds
a few values a tree and a flag a container file; each batch writes the facts that it changed, and ``tree_findings``
judges the last facts of each key, so a finding that a later lockfile answers is gone.

Cases: the flag of a workflow that names secrets is judged per batch, so let a workflow's rows come in one input file;
replayed batches overwrite their folder; trees without manifests or containers give no facts; null paths take no part;
before the first batch there are no findings.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import rules as R
from ..operators.extract import EVIDENCE


def read_evidence(spark: SparkSession, path: str, files_per_batch: int = 100) -> DataFrame:
    """A stream of evidence rows (JSON lines)."""
    return spark.readStream.schema(EVIDENCE).option("maxFilesPerTrigger", files_per_batch).json(path)


def _by_batch(rows: DataFrame, out: str, checkpoint: str, made=lambda batch: batch) -> StreamingQuery:
    """Each batch's rows as Parquet under ``out``, one folder a batch: replays overwrite."""

    def write(batch: DataFrame, number: int) -> None:
        made(batch).write.mode("overwrite").parquet(f"{out}/batch={number}")

    return rows.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def findings_stream(evidence: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """The findings of lines, distinct in each batch."""
    return _by_batch(evidence, out, checkpoint, lambda batch: R.ledger(R.line_findings(batch)).select(*R.COLUMNS))


def facts_streams(evidence: DataFrame, out: str, checkpoint: str, tree: Column | None = None) -> list[StreamingQuery]:
    """The facts that the rules of trees ask for; ``tree``: of a path, where several trees arrive."""
    rows = evidence.where("path is not null").select((F.lit("") if tree is None else tree).alias("tree"), "path", "text")
    facts = {"locks": R.lockfile_facts(rows, "tree"), "containers": R.container_facts(rows, "tree")}
    return [_by_batch(f, f"{out}/{name}", f"{checkpoint}/{name}") for name, f in facts.items()]


def _last(spark: SparkSession, folder: str, *keys: str) -> DataFrame:
    newest = Window.partitionBy(*keys).orderBy(F.desc("batch"))
    return spark.read.parquet(folder).withColumn("newest", F.row_number().over(newest)).where("newest = 1").drop("newest", "batch")


def tree_findings(spark: SparkSession, out: str) -> DataFrame:
    """Findings of the rules of trees, by the facts that ``facts_streams`` last wrote under ``out``."""
    locks, containers = _last(spark, f"{out}/locks", "tree"), _last(spark, f"{out}/containers", "tree", "path")
    return R.ledger(R.lockless(locks, "tree").unionByName(R.rootful(containers, "tree"))).select(*R.COLUMNS)
