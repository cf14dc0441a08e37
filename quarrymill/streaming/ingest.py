"""Feeds that write to versioned tables: each batch once, bad rows aside, cursors and windows remembered, gaps found.

A batch's rows, its number and the feed's cursor become one version of the table or none of them does. So a batch that the engine replays
after a crash, whether the crash came before or after the write, leaves the table as one run would. With
`newest` columns rows may arrive in any order, late ones too: the stored row is compared with the new one.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from quarrymill.sources.versioned import VersionedTable


def write_batch(table: VersionedTable, feed: str, *, valid: Column | None = None, newest: list[str] | None = None, cursor: Column | None = None) -> Callable[[DataFrame, int], None]:
    """What `foreachBatch` calls."""

    def write(rows: DataFrame, number: int) -> None:
        table.merge(rows, valid=valid, latest=newest, newest_wins=True, batch=(feed, number), cursor=cursor)

    return write


def ingest(stream: DataFrame, table: VersionedTable, feed: str, checkpoint: str, *, within: tuple[str, str] | None = None, valid: Column | None = None, newest: list[str] | None = None, cursor: Column | None = None) -> StreamingQuery:
    """Write what a stream has to a table and stop; the next call goes on from the checkpoint.

    `within`, a time column and a delay, drops repeats of a key inside the delay before they are written, with state bounded by it. The engine then also
    drops rows that are later than the delay. Without it nothing is dropped: repeats meet in the merge.
    """
    if within:
        stream = stream.withWatermark(*within).dropDuplicatesWithinWatermark(table.manifest().key)
    writer = stream.writeStream.foreachBatch(write_batch(table, feed, valid=valid, newest=newest, cursor=cursor))
    return writer.option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def since(table: VersionedTable, feed: str, overlap_days: int, first: str) -> str:
    """The day from which a feed should be read again: some days before its cursor, or `first` if it has none."""
    cursor = table.manifest().cursors.get(feed)
    if cursor is None:
        return first
    return table.spark.range(1).select(F.date_sub(F.lit(cursor).cast("date"), overlap_days).cast("string")).first()[0]


def reconcile(expected: DataFrame, table: VersionedTable, fetch: Callable[[DataFrame], DataFrame] | None = None) -> tuple[int, int]:
    """How many expected rows the table lacks by key; and after one retry, in which `fetch` gives the rows of the keys that lack."""
    key = table.manifest().key
    lacking = lambda: expected.select(*key).distinct().join(table.read().select(*key), key, "left_anti")
    before = lacking().count()
    if before and fetch is not None:
        table.merge(fetch(lacking()))
        return before, lacking().count()
    return before, before


CONTROL = "feed string, start string, end string, status string, attempts int, rows long"


def windows_to_do(windows: DataFrame, control: VersionedTable, feed: str, most: int = 3) -> DataFrame:
    """start, end of the windows that are not done and have not failed `most` times."""
    seen = control.read().where((F.col("feed") == feed) & ((F.col("status") == "done") | (F.col("attempts") >= most)))
    return windows.join(seen.select("start", "end"), ["start", "end"], "left_anti")


def record_windows(results: DataFrame, control: VersionedTable, feed: str) -> None:
    """Note windows (start, end, ok, rows): done, or failed once more. A window that is done stays done."""
    old = control.read().where(F.col("feed") == feed).select("start", "end", F.col("status").alias("was"), "attempts", F.col("rows").alias("had"))
    both = results.join(old, ["start", "end"], "left")
    done = F.coalesce(F.col("ok") | (F.col("was") == "done"), F.lit(False))
    control.merge(
        both.select(
            F.lit(feed).alias("feed"), "start", "end", F.when(done, "done").otherwise("failed").alias("status"), (F.coalesce("attempts", F.lit(0)) + 1).alias("attempts"), F.when(F.col("ok"), F.col("rows")).otherwise(F.coalesce("had", F.lit(0))).cast("long").alias("rows")
        )
    )
