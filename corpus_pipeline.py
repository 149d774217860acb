"""The corpus pipeline: five stages over ``documents``, each written as Parquet and read again.

Every stage but the last returns the columns of documents.  1. language identification drops texts in
which no language is found; 2. lines that three or more documents share stay in the last of them only;
3. of each class of near-duplicates the document of smallest id stays; 4. documents that hold a
benchmark item go; 5. what is left is packed into windows of 2048 ids, one row per piece.

Cases: texts that are null or have no letter go in stage 1; null doc_ids come before all others, are no
one's duplicate and stay; repeated rows stay or go alike and are packed as often as they occur; of equal
and similar documents the smallest id stays (ties: rows of that id); a text that loses all its lines
stays as an empty one; very long texts are taken whole; empty tables give no rows; columns besides
those of documents are carried through the first four stages unchanged, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnwork.llm.decontaminate import decontaminate
from tarnwork.llm.language_id import reject_unknown, train
from tarnwork.llm.line_dedup import drop_repeated_lines
from tarnwork.llm.near_dedup import keep_one_of_each
from tarnwork.llm.packing import pack_documents
from tarnwork.llm.shared import materialize, read_table, ship_code


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which a language is found."""
    ship_code(spark)
    return reject_unknown(docs, train(docs))


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without repeated lines; n_chars follows the text."""
    kept = drop_repeated_lines(docs)
    return kept.withColumn("n_chars", F.char_length("text").cast("long")).select(*docs.columns)


def dedup_near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate class."""
    ship_code(spark)
    return keep_one_of_each(docs).select(*docs.columns)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without benchmark items."""
    ship_code(spark)
    return decontaminate(docs, read_table(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces in windows, with their ids."""
    import public_tokenizers

    ship_code(spark)
    packed = pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"))
    return packed.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


STAGES = [
    ("language_id", identify_language),
    ("line_dedup", dedup_lines),
    ("near_dedup", dedup_near),
    ("decontaminate", drop_contaminated),
    ("packing", pack),
]

#: Cross-parsing, similarity classes and byte-pair packing are beyond SQL; tests use brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = materialize(docs, f"pipeline-{name}")
    return docs
