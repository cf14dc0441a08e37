"""Feeds: replayed, late and interrupted batches leave the table that one run leaves."""

import pytest
from pyspark.sql import functions as F

from quarrymill.sources.shared import fresh_path
from quarrymill.sources.versioned import VersionedTable
from quarrymill.streaming import ingest

SCHEMA = "id long, ts timestamp, v double"


def rows_of(table):
    return sorted(map(str, table.read().collect()))


def batch(spark, rows):
    return spark.createDataFrame(rows, "id long, t string, v double").select("id", F.col("t").cast("timestamp").alias("ts"), "v")


@pytest.fixture()
def batches(spark):
    days = [f"2024-01-{d:02d}" for d in range(1, 29)]
    return [
        batch(spark, [(i, days[i % 28], float(i)) for i in range(30)]),
        batch(spark, [(5, "2024-02-01", 50.0), (6, "2023-01-01", 60.0), (None, "2024-01-01", 1.0), (7, "2024-01-01", None)]),
        batch(spark, [(5, "2024-01-20", 51.0), (31, "2024-01-05", 31.0), (31, "2024-01-05", 31.5)]),
    ]


def fresh(spark):
    return VersionedTable.create(spark.createDataFrame([], SCHEMA), fresh_path(spark, "feed"), ["id"], buckets=3)


def test_any_order_and_any_replay_is_one_run(spark, batches):
    tables = []
    for order in ([0, 1, 2], [2, 1, 0], [1, 0, 2]):
        table = fresh(spark)
        write = ingest.write_batch(table, "f", valid=F.col("v").isNotNull(), newest=["ts"], cursor=F.max("ts"))
        for number, k in enumerate(order):
            write(batches[k], number)
            before = table.manifest().version
            write(batches[k], number)  # replayed after its commit
            write(batches[0], 0)  # and an old one
            assert table.manifest().version == before
        tables.append(rows_of(table))
        assert table.manifest().cursors["f"].startswith("2024-02-01") and ingest.since(table, "f", 3, "2020-01-01") == "2024-01-29" and ingest.since(table, "g", 3, "2020-01-01") == "2020-01-01"
    table = fresh(spark)
    ingest.write_batch(table, "f", valid=F.col("v").isNotNull(), newest=["ts"])(batches[0].unionByName(batches[1]).unionByName(batches[2]), 0)
    assert tables == [rows_of(table)] * 3
    got = {r["id"]: r["v"] for r in table.read().collect()}
    assert (got[5], got[6], got[7], got[31], len(got)) == (50.0, 6.0, 7.0, 31.5, 31)


def test_a_stream_that_dies_before_and_after_its_commit(spark, batches, monkeypatch):
    folder = fresh_path(spark, "landed")
    for b in batches:
        b.coalesce(1).write.mode("append").parquet(f"{folder}/in")
    table = fresh(spark)
    run = lambda: ingest.ingest(spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in"), table, "f", f"{folder}/checkpoint", newest=["ts"])
    real, calls = VersionedTable._commit, []

    def dying(self, manifest):
        calls.append(manifest.version)
        if len(calls) == 2:
            raise OSError("killed before the commit")
        out = real(self, manifest)
        if len(calls) == 4:
            raise OSError("killed after the commit")
        return out

    monkeypatch.setattr(VersionedTable, "_commit", dying)
    for _ in range(2):
        with pytest.raises(Exception, match="killed"):
            run().awaitTermination()
    run().awaitTermination()
    whole = fresh(spark)
    ingest.write_batch(whole, "f", newest=["ts"])(batches[0].unionByName(batches[1]).unionByName(batches[2]), 0)
    assert rows_of(table) == rows_of(whole) and table.quarantine().distinct().count() == 1


def test_repeats_inside_a_delay(spark, batches):
    folder = fresh_path(spark, "landed")
    batches[0].unionByName(batches[0]).coalesce(1).write.parquet(f"{folder}/in")
    table = fresh(spark)
    ingest.ingest(spark.readStream.schema(SCHEMA).parquet(f"{folder}/in"), table, "f", f"{folder}/checkpoint", within=("ts", "60 days")).awaitTermination()
    assert table.read().count() == 30


def test_gaps_are_found_and_filled(spark, batches):
    table = fresh(spark)
    table.merge(batches[0].where("id < 20"))
    assert ingest.reconcile(batches[0], table) == (10, 10)
    assert ingest.reconcile(batches[0], table, lambda keys: batches[0].where("id < 25").join(keys, "id", "left_semi")) == (10, 5)
    assert ingest.reconcile(batches[0].where("id < 25"), table) == (0, 0)


def test_windows(spark):
    control = VersionedTable.create(spark.createDataFrame([], ingest.CONTROL), fresh_path(spark, "control"), ["feed", "start", "end"], buckets=2)
    windows = spark.createDataFrame([(f"2024-0{m}-01", f"2024-0{m}-28") for m in (1, 2, 3)], "start string, end string")
    for round_ in range(5):
        todo = ingest.windows_to_do(windows, control, "f")
        assert todo.count() == [3, 2, 1, 0, 0][round_]
        ok = (F.col("start") == "2024-01-01") | ((F.col("start") == "2024-02-01") & F.lit(round_ == 1))
        ingest.record_windows(todo.select("start", "end", ok.alias("ok"), F.lit(7).cast("long").alias("rows")), control, "f")
    assert sorted((r["start"][5:7], r["status"], r["attempts"], r["rows"]) for r in control.read().collect()) == [("01", "done", 1, 7), ("02", "done", 2, 7), ("03", "failed", 3, 0)]
    assert ingest.windows_to_do(windows, control, "other").count() == 3
