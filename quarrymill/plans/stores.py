"""Queries over tables that change: merge, delete, partial update, quarantine, exclusive flags."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrymill.functions import text as T
from quarrymill.plans.catalog import query, read
from quarrymill.plans.texts import AREAS, _first_sql, _joined, _JOINED
from quarrymill.sources.shared import fresh_path
from quarrymill.sources.versioned import VersionedTable
from quarrymill.streaming import ingest

_CHANGED = "o_orderkey + CASE o_orderpriority WHEN '1-URGENT' THEN 1000000000 ELSE 0 END"
_BAD = "(o_totalprice <= 2000 OR o_orderpriority = '4-NOT SPECIFIED')"
_STORE = (
    "WITH s AS (SELECT o_orderkey, o_orderstatus, o_totalprice, o_orderpriority FROM orders), "
    f"n AS (SELECT {_CHANGED} AS o_orderkey, 'N' AS o_orderstatus, o_totalprice * 2 AS o_totalprice, o_orderpriority FROM orders WHERE o_orderstatus = 'O'), "
    f"v AS (SELECT * FROM n WHERE NOT {_BAD}), m AS (SELECT coalesce(v.o_orderkey, s.o_orderkey) AS o_orderkey, CASE WHEN v.o_orderkey IS NULL THEN s.o_orderstatus ELSE v.o_orderstatus END AS o_orderstatus, "
    "CASE WHEN v.o_orderkey IS NULL THEN s.o_totalprice ELSE v.o_totalprice END AS o_totalprice, CASE WHEN v.o_orderkey IS NULL THEN s.o_orderpriority ELSE v.o_orderpriority END AS o_orderpriority FROM s FULL JOIN v ON s.o_orderkey = v.o_orderkey), "
    "d AS (SELECT * FROM m WHERE o_orderstatus <> 'P'), "
    "u AS (SELECT o_orderkey, o_orderstatus, round(CASE WHEN o_totalprice > 200000 THEN o_totalprice * 0.9e0 ELSE o_totalprice END, 6) AS o_totalprice, CASE WHEN o_totalprice > 200000 THEN 'LARGE' ELSE o_orderpriority END AS o_orderpriority FROM d) "
)


def _changed_orders(spark: SparkSession, sf: str) -> VersionedTable:
    """All orders; open ones merged back as doubled (urgent ones under new keys, some invalid), those in process deleted, large ones updated."""
    orders = read(spark, sf, "orders")
    table = VersionedTable.create(orders.select("o_orderkey", "o_orderstatus", "o_totalprice", "o_orderpriority"), fresh_path(spark, "orders"), ["o_orderkey"], buckets=16)
    changes = orders.where("o_orderstatus = 'O'").selectExpr(f"{_CHANGED} as o_orderkey", "'N' as o_orderstatus", "o_totalprice * 2 as o_totalprice", "o_orderpriority")
    table.merge(changes, valid=~F.expr(_BAD))
    table.delete(F.col("o_orderstatus") == "P")
    large = F.col("o_totalprice") > 200000
    table.update(large, {"o_totalprice": F.col("o_totalprice") * 0.9, "o_orderpriority": F.lit("LARGE")})
    return table


@query("store_changes", _STORE + "SELECT * FROM u")
def store_changes(spark: SparkSession, sf: str) -> DataFrame:
    """What a table holds after a merge, a delete by term and a partial update."""
    return _changed_orders(spark, sf).read().withColumn("o_totalprice", F.round("o_totalprice", 6))


@query(
    "store_history",
    _STORE + ", c AS (SELECT (SELECT count(*) FROM s) AS s, (SELECT count(*) FROM v) AS v, (SELECT count(*) FROM n) AS n, (SELECT count(*) FROM m) AS m, (SELECT count(*) FROM d) AS d, (SELECT count(*) FROM d WHERE o_totalprice > 200000) AS u) "
    "SELECT unnest([0, 1, 2, 3, 4])::BIGINT AS version, unnest(['create', 'merge', 'merge', 'delete', 'update']) AS operation, unnest([0, s, m, d, d])::BIGINT AS rows, unnest([0, s, m - s, 0, 0])::BIGINT AS inserted, unnest([0, 0, v - (m - s), 0, u])::BIGINT AS updated, unnest([0, 0, 0, m - d, 0])::BIGINT AS deleted, unnest([0, 0, n - v, 0, 0])::BIGINT AS failed FROM c",
)
def store_history(spark: SparkSession, sf: str) -> DataFrame:
    """Rows inserted, updated, deleted and set aside, version by version."""
    return _changed_orders(spark, sf).history()


@query("store_quarantine", _STORE + f"SELECT o_orderkey, o_totalprice FROM n WHERE {_BAD}")
def store_quarantine(spark: SparkSession, sf: str) -> DataFrame:
    """Changes that a merge refused, with the rest written."""
    return _changed_orders(spark, sf).quarantine().select("o_orderkey", "o_totalprice")


@query("store_reclassify", f"WITH j AS ({_JOINED}), l AS (SELECT doc_id, lower(t) AS t FROM j), a AS (SELECT doc_id, {_first_sql('t', AREAS[:3], chr(39) + 'OUTRO' + chr(39))} AS a, {_first_sql('t', AREAS, chr(39) + 'OUTRO' + chr(39))} AS b FROM l) SELECT doc_id, CASE WHEN a = 'OUTRO' THEN b ELSE a END AS area FROM a")
def store_reclassify(spark: SparkSession, sf: str) -> DataFrame:
    """Rows of no known area are classified again by more patterns; only their buckets are rewritten."""
    rows = _joined(spark, sf).select("doc_id", F.lower("t").alias("t")).select("doc_id", "t", T.first_match(F.col("t"), AREAS[:3], "OUTRO").alias("area"))
    table = VersionedTable.create(rows, fresh_path(spark, "areas"), ["doc_id"], buckets=16)
    table.update(F.col("area") == "OUTRO", {"area": T.first_match(F.col("t"), AREAS, "OUTRO")})
    return table.read().select("doc_id", "area")


@query("store_exclusive_flag", "WITH p AS (SELECT conv_id, max(turn) AS pick FROM conversations WHERE role = 'assistant' GROUP BY conv_id) SELECT conv_id, turn, CASE WHEN pick IS NULL THEN turn = 0 ELSE turn = pick END AS recommended FROM conversations LEFT JOIN p USING (conv_id)")
def store_exclusive_flag(spark: SparkSession, sf: str) -> DataFrame:
    """The first turn of each session carries the flag; then the last turn of the assistant gets it, alone, where there is one."""
    c = read(spark, sf, "conversations")
    table = VersionedTable.create(c.select("conv_id", "turn", (F.col("turn") == 0).alias("recommended")), fresh_path(spark, "flags"), ["conv_id", "turn"], buckets=16)
    table.set_exclusive("conv_id", "recommended", c.where("role = 'assistant'").groupBy("conv_id").agg(F.max("turn").alias("turn")))
    return table.read()


def _event_feed(spark: SparkSession, sf: str) -> tuple[VersionedTable, str, DataFrame]:
    """Events in four files, not in order of time, every click again in a file of its own; and an empty table for them."""
    rows = read(spark, sf, "events").select("event_id", F.col("ts").cast("timestamp").alias("ts"), "user_id", "event_type", "value")
    folder = fresh_path(spark, "landed")
    rows.repartition(4, "user_id").write.parquet(f"{folder}/in/a")
    rows.where("event_type = 'click'").coalesce(1).write.parquet(f"{folder}/in/b")
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 2).parquet(f"{folder}/in/*")
    return VersionedTable.create(rows.limit(0), fresh_path(spark, "events"), ["event_id"], buckets=16), folder, stream


def _ingested(spark: SparkSession, sf: str) -> VersionedTable:
    table, folder, stream = _event_feed(spark, sf)
    ingest.ingest(stream, table, "events", f"{folder}/checkpoint", valid=F.col("value") >= 5, newest=["ts"], cursor=F.max("ts")).awaitTermination()
    return table


@query("stream_ingest", "SELECT event_id, user_id, event_type, value FROM events WHERE value >= 5")
def stream_ingest(spark: SparkSession, sf: str) -> DataFrame:
    """A stream with repeats, written batch by batch to a table with a key; bad rows go aside."""
    return _ingested(spark, sf).read().select("event_id", "user_id", "event_type", "value")


@query(
    "stream_counts",
    "SELECT count(*) FILTER (value >= 5) AS inserted, count(*) FILTER (value >= 5 AND event_type = 'click') AS updated, (count(*) FILTER (NOT coalesce(value >= 5, false)) + count(*) FILTER (NOT coalesce(value >= 5, false) AND event_type = 'click'))::BIGINT AS failed, "
    "((max(ts) FILTER (value >= 5))::DATE - 3)::VARCHAR AS since FROM events",
)
def stream_counts(spark: SparkSession, sf: str) -> DataFrame:
    """What the batches did in all, and the day from which the feed would be read again."""
    table = _ingested(spark, sf)
    sums = [F.sum(c).alias(c) for c in ("inserted", "updated", "failed")]
    return table.history().agg(*sums).withColumn("since", F.lit(ingest.since(table, "events", 3, "2024-01-01")))


@query("stream_reconcile", "SELECT count(*) FILTER (coalesce(value < 5, true)) AS lacking, 0::BIGINT AS after_retry FROM events")
def stream_reconcile(spark: SparkSession, sf: str) -> DataFrame:
    """Rows that a feed should have written and did not, before and after one retry."""
    table, rows = _ingested(spark, sf), read(spark, sf, "events")
    fetch = lambda keys: rows.join(keys, "event_id", "left_semi").select("event_id", F.col("ts").cast("timestamp").alias("ts"), "user_id", "event_type", "value")
    return spark.createDataFrame([ingest.reconcile(rows, table, fetch)], "lacking long, after_retry long")


@query("window_control", "WITH m AS (SELECT date_trunc('month', o_orderdate)::DATE AS m, count(*) AS n FROM orders GROUP BY 1) SELECT m::VARCHAR AS start, n AS rows, CASE WHEN month(m) = 2 THEN 'failed' ELSE 'done' END AS status, CASE WHEN month(m) = 2 THEN 3 WHEN month(m) = 7 THEN 2 ELSE 1 END AS attempts FROM m")
def window_control(spark: SparkSession, sf: str) -> DataFrame:
    """Months of orders read until each is done or has failed three times: Februaries always fail, Julies once."""
    m = F.date_trunc("month", "o_orderdate").cast("date")
    months = read(spark, sf, "orders").groupBy(m.cast("string").alias("start"), F.last_day(m).cast("string").alias("end")).agg(F.count("*").alias("rows"))
    table = VersionedTable.create(spark.createDataFrame([], ingest.CONTROL), fresh_path(spark, "control"), ["feed", "start", "end"], buckets=4)
    for attempt in range(4):
        todo = ingest.windows_to_do(months, table, "orders")
        month = F.month(F.col("start").cast("date"))
        ok = (month != 2) & ((month != 7) | F.lit(attempt > 0))
        ingest.record_windows(todo.select("start", "end", ok.alias("ok"), "rows"), table, "orders")
    return table.read().join(months.withColumnRenamed("rows", "n"), ["start", "end"]).select("start", F.col("n").alias("rows"), "status", "attempts")
