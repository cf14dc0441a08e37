"""A pipeline over documents: each stage reads what the one before it kept.

Toxic documents go, then later copies of repeated runs of lines, then all but one document of each group of
near duplicates; the rest is mixed to its sources' target weights and packed into sequences.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrymill.llm import linededup, mixing, neardup, packing, toxicity
from quarrymill.llm.common import forget, materialise, table
from quarrymill.llm.queries import vocabulary


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that score below the threshold. Null and empty texts stay, and so do all rows where there are no labels; no rows, no result."""
    return toxicity.drop_toxic(docs, table(spark, sf_dir, "labels"))


def delete_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts lose the runs that an earlier document has; n_chars follows. Rows all stay; null texts stay null, with null n_chars."""
    return linededup.dedup_lines(docs).withColumn("n_chars", F.char_length("text").cast("long"))


def keep_one_of_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The row with the least doc_id (null last) of each group. Rows without words are alike to none and stay."""
    return neardup.drop_near_duplicates(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row, whole, for each draw, dealt to shards and shuffled in them. Documents without words are not drawn."""
    return mixing.deal(mixing.mix(docs)).select(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each piece of each drawn row, null and empty texts included: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, bucket."""
    pieces = packing.pack_documents(docs, vocabulary())
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "bucket")


STAGES = [
    ("toxicity", reject_toxic),
    ("line_dedup", delete_repeated_lines),
    ("near_duplicates", keep_one_of_near_duplicates),
    ("mixing", mix_sources),
    ("packing", pack),
]
#: SQL has neither zstandard nor the vocabulary.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = table(spark, sf_dir, "documents"), []
    for name, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir), f"stage-{name}")
        forget(*before)
        before = [docs]
    return docs
