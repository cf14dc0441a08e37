"""Event windows over batches or streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def event_windows(events: DataFrame, *, length: str = "1 hour", late: str = "1 day") -> DataFrame:
    """start, event_type, n, total: tumbling windows; on a stream, events later than `late` are dropped and state is bounded by it."""
    marked = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    out = marked.groupBy(F.window("ts", length).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return out.select(F.col("w.start").alias("start"), "event_type", "n", "total")


def stream_to_table(spark: SparkSession, folder: str, schema: str, out: str, checkpoint: str) -> None:
    """Read what a folder of Parquet files has, window it, and append closed windows to `out`; restarts go on from the checkpoint."""
    stream = spark.readStream.schema(schema).parquet(folder)
    event_windows(stream).writeStream.outputMode("append").option("checkpointLocation", checkpoint).trigger(availableNow=True).format("parquet").start(out).awaitTermination()
