"""Token-ID output: id-ordered Parquet files of token lists, made for selective reads.

Layout.  ``write_token_files`` range-partitions documents by doc_id, so file k holds smaller ids than
file k+1 and rows inside a file ascend.  Columns: doc_id, block (file number), block_start (ids of
the block before this document), n_tokens, ids (list of int).  Token ids are dictionary-encoded,
the metadata columns delta-encoded (Parquet v2 pages); row groups and pages are bounded and Parquet's
column and offset indexes are written, so a reader of few documents or of metadata alone skips the
token pages.

Cases: null text is empty (only the end id); null doc_id sorts first; equal doc_ids are ordered by
text; an empty table gives no rows; other columns of the input are ignored, whatever their names.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import shared_dir
from .tokens import encoder

END_ID = 1
#: Parquet writer settings: v2 pages (delta encodings), bounded row groups, pages and dictionaries.
FORMAT = {
    "compression": "zstd",
    "parquet.writer.version": "v2",
    "parquet.block.size": str(32 << 20),
    "parquet.page.size": str(256 << 10),
    "parquet.page.row.count.limit": "2000",
    "parquet.dictionary.page.size": str(1 << 20),
    "parquet.enable.dictionary": "false",
    "parquet.enable.dictionary#ids.list.element": "true",
}
FILE_SCHEMA = "doc_id long, block int, block_start long, n_tokens long, ids array<int>"


def write_token_files(docs: DataFrame, tokenizer_path: str, path: str, end_id: int = END_ID) -> str:
    """Encode every whole text, append ``end_id``, write the format above to ``path``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, block, before = encoder(tokenizer_path), TaskContext.get().partitionId(), 0
        for batch in batches:
            for a, ids, at in enc.encode_ended(batch.column(1), end_id):
                n = len(at) - 1
                lists = pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(ids.view("<i4"), pa.int32()))
                arrays = [batch.column(0).slice(a, n), pa.array(np.full(n, block, np.int32)), pa.array(before + at[:-1]), pa.array(np.diff(at)), lists]
                yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "block", "block_start", "n_tokens", "ids"])
                before += int(at[-1])

    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    d.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text").mapInArrow(run, FILE_SCHEMA).write.options(**FORMAT).parquet(path)
    return path


def read_token_files(spark, path: str, columns: list[str] | None = None) -> DataFrame:
    """The files' rows with ``start``, the ids of all documents before each.

    ``columns`` without ``ids`` never touches token pages.  Block offsets come from the n_tokens
    column alone; they are one row per file, few enough to be sent to all tasks (a few MB for 100,000
    files), so that token lists are not shuffled.
    """
    from pyspark.sql import Window

    files = spark.read.schema(FILE_SCHEMA).parquet(path)
    sums = files.groupBy("block").agg(F.sum("n_tokens").alias("t"))
    ends = sums.select("block", (F.sum("t").over(Window.orderBy("block")) - F.col("t")).alias("before"))
    out = files.join(F.broadcast(ends), "block").withColumn("start", F.col("block_start") + F.col("before"))
    return out.select(*(columns or ["doc_id", "start", "n_tokens", "ids"]))




def ids_crc32(df: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens and the unsigned crc32 of the ids read back as little-endian uint32."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(3)
            values, offsets = ids.values.to_numpy(zero_copy_only=False).astype("<i4", copy=False), ids.offsets.to_numpy()
            view = memoryview(np.ascontiguousarray(values)).cast("B")
            crc = [zlib.crc32(view[4 * a : 4 * b]) for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
            counted = np.diff(offsets).astype(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(counted), pa.array(crc, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    return df.select("doc_id", "start", "n_tokens", "ids").mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def encode_documents(docs: DataFrame, tokenizer_path: str, path: str | None = None, end_id: int = END_ID) -> DataFrame:
    """Write token files (to the shared folder unless ``path`` is given) and read them back."""
    spark = docs.sparkSession
    path = write_token_files(docs, tokenizer_path, path or shared_dir(spark, "tokens"), end_id)
    return read_token_files(spark, path)
