"""Tables with a key that merge, delete and update in place, as versions of Parquet folders.

Rows lie in buckets by a hash of their key. A change writes new folders for the buckets that it touches and then a manifest that
says which folder holds each bucket; all other buckets stay as they are. A version exists once its manifest does,
and a manifest's name can be taken once only: a write that dies before leaves folders that nobody reads, and of two
writers from one version the later gets `Conflict` and has to start again. Old versions stay readable until `vacuum`.

Driver work is a row for each bucket. Rows only pass through joins on the key and writes by bucket.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from quarrymill.sources.shared import Store


class Conflict(RuntimeError):
    """Another writer took the version that this one was about to be."""


@dataclass
class Manifest:
    version: int
    key: list[str]
    buckets: int
    schema: dict
    folders: dict[str, tuple[str, int]] = field(default_factory=dict)  # of a bucket: the write that holds it, and its rows
    operation: str = "create"
    counts: dict[str, int] = field(default_factory=dict)
    batches: dict[str, int] = field(default_factory=dict)  # the last batch of each feed that is in the table
    cursors: dict[str, str] = field(default_factory=dict)  # how far each feed has come


class VersionedTable:
    """A table at a path. Keys are unique and not null; other columns may hold nulls. Column names must not begin with an underscore."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path, self.store = spark, path.rstrip("/"), Store(spark, path)

    # Versions

    @classmethod
    def create(cls, rows: DataFrame, path: str, key: list[str], *, buckets: int = 64) -> VersionedTable:
        """A table from rows; those with a null key go to quarantine, and of rows with one key one stays, as in `merge`."""
        table = cls(rows.sparkSession, path)
        table._commit(Manifest(0, key, buckets, rows.schema.jsonValue()))
        table.merge(rows)
        return table

    def _name(self, version: int) -> str:
        return f"{self.path}/versions/{version:012d}.json"

    def manifest(self, version: int | None = None) -> Manifest:
        """That version's, or the last one's."""
        if version is None:
            version = max(int(n[:12]) for n in self.store.names(f"{self.path}/versions") if n.endswith(".json"))
        return Manifest(**json.loads(self.store.read(self._name(version))))

    def _commit(self, manifest: Manifest) -> Manifest:
        if not self.store.create(self._name(manifest.version), json.dumps(manifest.__dict__)):
            raise Conflict(f"version {manifest.version} of {self.path} exists")
        return manifest

    def read(self, version: int | None = None) -> DataFrame:
        return self._rows(self.manifest(version))

    def _rows(self, m: Manifest, only: set[str] | None = None) -> DataFrame:
        schema = StructType.fromJson(m.schema)
        paths = [f"{self.path}/data/{write}/_bucket={b}" for b, (write, _) in sorted(m.folders.items()) if only is None or b in only]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def history(self) -> DataFrame:
        """version, operation, rows and the counts of each version."""
        rows = []
        for name in self.store.names(f"{self.path}/versions"):
            if name.endswith(".json"):
                m = self.manifest(int(name[:12]))
                rows.append((m.version, m.operation, sum(n for _, n in m.folders.values()), *(m.counts.get(c, 0) for c in ("inserted", "updated", "deleted", "failed"))))
        return self.spark.createDataFrame(rows, "version long, operation string, rows long, inserted long, updated long, deleted long, failed long")

    def vacuum(self) -> int:
        """Delete folders and drafts that the last version does not read, and older versions; how many folders. No writer may be at work."""
        last = self.manifest()
        live = {write for write, _ in last.folders.values()}
        gone = [w for w in self.store.names(f"{self.path}/data") if w not in live]
        for name in self.store.names(f"{self.path}/versions"):
            if name != self._name(last.version).rpartition("/")[2]:
                self.store.delete(f"{self.path}/versions/{name}")
        for w in gone:
            self.store.delete(f"{self.path}/data/{w}")
        return len(gone)

    # Changes

    def _bucket(self, m: Manifest) -> Column:
        return F.pmod(F.xxhash64(*m.key), F.lit(m.buckets)).cast("int")

    def _write(self, rows: DataFrame, m: Manifest, write: str) -> dict[str, tuple[str, int]]:
        """Write rows by bucket; where each bucket is now. Large buckets are split over tasks and small ones share one."""
        at = f"{self.path}/data/{write}"
        rows.withColumn("_bucket", self._bucket(m)).hint("rebalance", "_bucket").write.partitionBy("_bucket").option("compression", "zstd").parquet(at)
        if not any(n.startswith("_bucket=") for n in self.store.names(at)):
            return {}
        counts = self.spark.read.parquet(at).groupBy("_bucket").agg(F.count("*").alias("n")).collect()  # a row for each bucket, from footers
        return {str(r["_bucket"]): (write, r["n"]) for r in counts}

    def _next(self, m: Manifest, touched: set[str], rows: DataFrame, write: str, operation: str, counts: dict[str, int]) -> Manifest:
        folders = {b: f for b, f in m.folders.items() if b not in touched} | self._write(rows, m, write)
        return Manifest(m.version + 1, m.key, m.buckets, m.schema, folders, operation, counts, dict(m.batches), dict(m.cursors))

    def merge(
        self, changes: DataFrame, *, valid: Column | None = None, latest: list[str] | None = None, insert_only: bool = False, newest_wins: bool = False, batch: tuple[str, int] | None = None, cursor: Column | None = None
    ) -> dict[str, int]:
        """Rows whose key is stored replace the stored row, others are added; counts of inserted, updated and failed rows.

        Rows with a null key, and those for which `valid` does not hold, go to `quarantine`, whatever their number: they never stop
        the rest. Of changes with one key the one with the greatest `latest` columns counts, then the greatest of all columns (for columns that can be
        ordered; nulls are least). With `insert_only` stored rows win; with `newest_wins` the stored row is one of those that are compared, so the order
        in which changes arrive does not matter. No changes make a version like the one before.

        A `batch` (feed, number) that is not above the feed's last one is in the table already and does nothing. `cursor`, an aggregate over the valid
        changes, moves the feed's cursor, as text, forward. Both are part of the version: they hold exactly if its rows do.
        """
        m = self.manifest()
        if batch and m.batches.get(batch[0], -1) >= batch[1]:
            return {"failed": 0, "inserted": 0, "updated": 0}
        names = StructType.fromJson(m.schema).names
        if sorted(changes.columns) != sorted(names):
            raise ValueError(f"columns {changes.columns} are not those of the table: {names}")
        write = uuid.uuid4().hex
        good = F.lit(True)
        for k in m.key:
            good = good & F.col(k).isNotNull()
        if valid is not None:
            good = good & F.coalesce(valid, F.lit(False))
        staged = f"{self.path}/staged/{write}"  # pinned: they are read more than once
        changes.select(*names, good.alias("_good"), self._bucket(m).alias("_at")).write.option("compression", "zstd").parquet(staged)
        rows = self.spark.read.parquet(staged)
        tally = rows.groupBy("_good", F.when(F.col("_good"), F.col("_at")).alias("_at")).agg(F.count("*").alias("n")).collect()  # a row for each bucket
        failed = sum(r["n"] for r in tally if not r["_good"])
        if failed:
            rows.where("not _good").drop("_good", "_at").write.option("compression", "zstd").parquet(f"{self.path}/quarantine/{write}")
        touched = {str(r["_at"]) for r in tally if r["_good"]}
        order = F.struct(*(latest or []), *[n for n in names if n not in (latest or [])])
        new = rows.where("_good").groupBy(*m.key).agg(F.max_by(F.struct(*names), order).alias("_new"))  # combined before the exchange: a key with many changes is no burden
        stored = self._rows(m, touched).select(*[F.col(k) for k in m.key], F.struct(*names).alias("_old"))
        both = stored.join(new, m.key, "full")
        rank = lambda row: F.struct(*[F.col(row)[n] for n in (latest or [])], *[F.col(row)[n] for n in names if n not in (latest or [])])
        kept = F.coalesce("_old", "_new") if insert_only else F.coalesce("_new", "_old")
        if newest_wins:
            kept = F.when(F.col("_old").isNotNull() & F.col("_new").isNotNull() & (rank("_old") > rank("_new")), F.col("_old")).otherwise(kept)
        counts = {"failed": failed}
        out = self._next(m, touched, both.select(kept.alias("_row")).select("_row.*"), write, "merge", counts)
        before = sum(n for b, (_, n) in m.folders.items() if b in touched)
        counts["inserted"] = sum(n for b, (_, n) in out.folders.items() if b in touched) - before
        counts["updated"] = 0 if insert_only else new.count() - counts["inserted"]
        if batch:
            out.batches[batch[0]] = batch[1]
            reached = rows.where("_good").agg(cursor.cast("string").alias("c")).first()["c"] if cursor is not None else None
            if reached is not None:
                out.cursors[batch[0]] = max(reached, out.cursors.get(batch[0], reached))
        self._commit(out)
        self.store.delete(staged)
        return counts

    def _touched(self, m: Manifest, where: Column) -> dict[str, int]:
        found = self._rows(m).where(where).groupBy(self._bucket(m).alias("_at")).agg(F.count("*").alias("n")).collect()
        return {str(r["_at"]): r["n"] for r in found}

    def delete(self, where: Column) -> int:
        """Rows for which `where` holds go (not those for which it is null); how many."""
        m = self.manifest()
        found = self._touched(m, where)
        rest = self._rows(m, set(found)).where(~F.coalesce(where, F.lit(False)))
        self._commit(self._next(m, set(found), rest, uuid.uuid4().hex, "delete", {"deleted": sum(found.values())}))
        return sum(found.values())

    def update(self, where: Column, values: dict[str, Column]) -> int:
        """Set columns, all from the old row, where a condition holds; how many rows. Key columns can't be set."""
        m = self.manifest()
        if set(values) & set(m.key):
            raise ValueError("a key can't be updated: delete and merge")
        schema = StructType.fromJson(m.schema)
        found = self._touched(m, where)
        test = F.coalesce(where, F.lit(False))
        rows = self._rows(m, set(found)).select(*[F.when(test, values[f.name].cast(f.dataType)).otherwise(F.col(f.name)).alias(f.name) if f.name in values else F.col(f.name) for f in schema])
        self._commit(self._next(m, set(found), rows, uuid.uuid4().hex, "update", {"updated": sum(found.values())}))
        return sum(found.values())

    def set_exclusive(self, group: str, flag: str, chosen: DataFrame) -> int:
        """In each group of `chosen` (group and key columns, a row a group) only the chosen row carries the flag; how many rows were looked at."""
        m = self.manifest()
        picks = chosen.select(F.col(group), *[F.col(k).alias(f"_pick_{k}") for k in m.key]).dropDuplicates([group])
        hit = self._rows(m).join(picks.select(group), group, "left_semi")
        found = {str(r["_at"]): r["n"] for r in hit.groupBy(self._bucket(m).alias("_at")).agg(F.count("*").alias("n")).collect()}
        both = self._rows(m, set(found)).join(picks, group, "left")
        is_pick = F.lit(True)
        for k in m.key:
            is_pick = is_pick & (F.col(k) == F.col(f"_pick_{k}"))
        schema = StructType.fromJson(m.schema)
        names = schema.names
        value = F.when(F.col(f"_pick_{m.key[0]}").isNull(), F.col(flag)).otherwise(is_pick.cast(schema[flag].dataType))
        rows = both.select(*[value.alias(n) if n == flag else F.col(n) for n in names])
        self._commit(self._next(m, set(found), rows, uuid.uuid4().hex, "exclusive", {"updated": sum(found.values())}))
        return sum(found.values())

    def quarantine(self) -> DataFrame:
        """All rows that merges set aside."""
        schema = StructType.fromJson(self.manifest().schema)
        paths = [f"{self.path}/quarantine/{w}" for w in self.store.names(f"{self.path}/quarantine")]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)
