"""Sources and sinks for landed files: tolerant JSON lines, paged JSON, XML records, append of unseen rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from quarrymill.sources.shared import Store


def json_lines(spark: SparkSession, path: str, schema: str) -> tuple[DataFrame, DataFrame]:
    """(rows, broken lines): malformed lines are set apart, not fatal."""
    parsed = F.from_json("value", f"{schema}, _broken string", {"columnNameOfCorruptRecord": "_broken"})
    both = spark.read.text(path).where("trim(value) <> ''").select("value", parsed.alias("r"))
    return both.where("r._broken is null").select("r.*").drop("_broken"), both.where("r._broken is not null").select(F.col("value").alias("line"))


def json_pages(spark: SparkSession, path: str, item_schema: str) -> DataFrame:
    """Items of pages such as {"total": n, "items": [...]}, one row for each."""
    return spark.read.schema(f"total long, items array<struct<{item_schema}>>").option("multiLine", True).json(path).select(F.inline("items"))


def xml_records(spark: SparkSession, path: str, row_tag: str, schema: str) -> DataFrame:
    """Records of XML files by Spark's reader; those that don't fit the schema are left out."""
    return spark.read.format("xml").option("rowTag", row_tag).option("mode", "DROPMALFORMED").schema(schema).load(path)


def append_unseen(new: DataFrame, path: str, key: list[str]) -> int:
    """Append the rows whose key hash the Parquet table at `path` lacks; how many."""
    spark, written = new.sparkSession, Observation()
    hashed = new.withColumn("row_hash", F.sha2(F.to_json(F.struct(*key)), 256)).dropDuplicates(["row_hash"])
    if Store(spark, path).exists(path):
        hashed = hashed.join(spark.read.parquet(path).select("row_hash"), "row_hash", "left_anti")
    hashed.observe(written, F.count("*").alias("n")).write.mode("append").parquet(path)
    return written.get["n"]
