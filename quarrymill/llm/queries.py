"""The queries of this package, by name, and the SQL that checks them."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrymill.llm import ann, fertility, fillmiddle, fingerprints, linededup, mixing, neardup, packing, periods, suffixdedup, tokencounts, toxicity, warc
from quarrymill.llm.common import new_dir, table


def vocabulary(name: str = "word_bpe_49k.json") -> str:
    """Where a public vocabulary lies: in QUARRYMILL_TOKENIZERS, or in the installed package."""
    if root := os.environ.get("QUARRYMILL_TOKENIZERS"):
        return f"{root}/{name}"
    import public_tokenizers

    return str(public_tokenizers.path(name))


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = suffixdedup.remove_repeats(table(spark, sf_dir, "documents"))
    return kept.withColumn("text", F.make_valid_utf8(F.col("kept").cast("string"))).drop("kept")  # a cut may lie within a character


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    root = new_dir(spark, "archive")
    pages = table(spark, sf_dir, "pages")
    warc.write_archive(pages, root)
    return warc.lookup(spark, root, warc.keys_of(pages), payload=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url")


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity_table(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicate_table(table(spark, sf_dir, "documents"))


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokencounts.token_count_table(table(spark, sf_dir, "documents"), new_dir(spark, "tokens"), {"words": None, "word_bpe_49k": vocabulary()})


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linededup.line_dedup_table(table(spark, sf_dir, "documents"))


def op7_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(table(spark, sf_dir, "embeddings"))


def op8_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.neighbour_fingerprints(table(spark, sf_dir, "documents"))


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.pack_documents(table(spark, sf_dir, "documents"), vocabulary())
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "bucket")


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixture_table(table(spark, sf_dir, "documents"))


def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = fillmiddle.fill_in_middle(table(spark, sf_dir, "documents"))
    digest = lambda c: F.sha2(c.cast("binary"), 256)
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", digest(F.col("output")).alias("output_sha256"), digest(fillmiddle.restored(F.col("output"), F.col("form"))).alias("restored_sha256"))


def op12_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fertility.quality_table(table(spark, sf_dir, "documents"), *fertility.vocabulary_paths())


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periods.run_table(periods.planted(table(spark, sf_dir, "documents")))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_suffix_dedup": op1_suffix_dedup,
    "op2_warc": op2_warc,
    "op3_toxicity": op3_toxicity,
    "op4_near_duplicates": op4_near_duplicates,
    "op5_token_counts": op5_token_counts,
    "op6_line_dedup": op6_line_dedup,
    "op7_nearest": op7_nearest,
    "op8_fingerprints": op8_fingerprints,
    "op9_packing": op9_packing,
    "op10_mixing": op10_mixing,
    "op11_fill_in_middle": op11_fill_in_middle,
    "op12_quality_rules": op12_quality_rules,
    "op13_periodic_runs": op13_periodic_runs,
}
ORACLES: dict[str, str] = {
    "op2_warc": """
        WITH p AS (SELECT page_id, url, coalesce(html, '') AS h FROM pages),
        d AS (SELECT page_id, url, strlen(h) AS payload_bytes, sha256(h) AS payload_digest FROM p),
        f AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first_id FROM d)
        SELECT page_id, payload_bytes, payload_digest, url,
               CASE WHEN payload_bytes >= 100 AND page_id <> first_id THEN 'revisit' ELSE 'response' END AS record_type,
               CASE WHEN payload_bytes >= 100 AND page_id <> first_id THEN first_id END AS refers_to
        FROM f""",
    "op6_line_dedup": linededup.ORACLE,
    "op11_fill_in_middle": fillmiddle.ORACLE,
}
