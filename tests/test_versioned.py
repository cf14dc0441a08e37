"""The versioned table against a dictionary: nulls, repeated keys, lost writes, two writers."""

import random

import pytest
from pyspark.sql import functions as F

from quarrymill.sources.shared import Store, fresh_path
from quarrymill.sources.versioned import Conflict, VersionedTable

SCHEMA = "id long, kind string, v double"


def frame(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def rows_of(table, version=None):
    return sorted((tuple(r) for r in table.read(version).collect()), key=str)


@pytest.fixture()
def table(spark):
    return VersionedTable.create(frame(spark, [(i, f"k{i % 3}", float(i)) for i in range(50)]), fresh_path(spark, "t"), ["id"], buckets=4)


def test_a_life_of_changes_equals_a_dictionary(spark, table):
    rng, want = random.Random(4), {i: (f"k{i % 3}", float(i)) for i in range(50)}
    for step in range(4):
        changes = [(rng.choice([None, *range(80)]), rng.choice(["k0", "k9", None]), rng.choice([None, -1.0, *map(float, range(9))])) for _ in range(30)]
        good = [c for c in changes if c[0] is not None and c[2] is not None and c[2] >= 0]
        new = {}
        for i, kind, v in sorted(good, key=lambda c: (c[2], c[1] or "")):
            new[i] = (kind, v)
        counts = table.merge(frame(spark, changes), valid=F.col("v") >= 0, latest=["v"])
        assert counts == {"failed": len(changes) - len(good), "inserted": len(set(new) - set(want)), "updated": len(set(new) & set(want))}
        want |= new
        assert rows_of(table) == sorted(((i, *x) for i, x in want.items()), key=str)
        gone = {i for i, (kind, _) in want.items() if kind == f"k{step}"}
        assert table.delete(F.col("kind") == f"k{step}") == len(gone)
        want = {i: x for i, x in want.items() if i not in gone}
        hit = {i for i, (_, v) in want.items() if v > 20}
        assert table.update(F.col("v") > 20, {"v": F.col("v") / 2, "kind": F.concat("kind", F.lit("'"))}) == len(hit)
        want = {i: (None if x[0] is None else x[0] + "'", x[1] / 2) if i in hit else x for i, x in want.items()}
        assert rows_of(table) == sorted(((i, *x) for i, x in want.items()), key=str)
    assert table.quarantine().where("v >= 0 and id is not null").count() == 0 and table.quarantine().count() > 0
    assert rows_of(table, 1) == sorted(((i, f"k{i % 3}", float(i)) for i in range(50)), key=str)


def test_only_touched_buckets_are_rewritten(spark, table):
    before = table.manifest().folders
    table.merge(frame(spark, [(7, "new", 7.0)]))
    after = table.manifest().folders
    assert sum(before[b] != after[b] for b in before) == 1
    table.update(F.col("id") == 7, {"kind": F.lit("x")})
    assert sum(after[b] != table.manifest().folders[b] for b in after) == 1


def test_a_write_lost_before_its_commit_changes_nothing(spark, table, monkeypatch):
    before = rows_of(table)
    monkeypatch.setattr(VersionedTable, "_commit", lambda self, m: (_ for _ in ()).throw(OSError("killed")))
    for change in (lambda: table.merge(frame(spark, [(1, "lost", 0.0), (999, "lost", 0.0)])), lambda: table.delete(F.lit(True)), lambda: table.update(F.lit(True), {"v": F.lit(0.0)})):
        with pytest.raises(OSError):
            change()
    monkeypatch.undo()
    assert rows_of(table) == before
    assert table.merge(frame(spark, [(999, "kept", 1.0)])) == {"failed": 0, "inserted": 1, "updated": 0}
    assert table.vacuum() >= 3 and rows_of(table) == sorted([*before, (999, "kept", 1.0)], key=str)


def test_two_writers(spark, table, monkeypatch):
    old = table.manifest()
    other = VersionedTable(spark, table.path)
    monkeypatch.setattr(other, "manifest", lambda version=None: old)
    assert table.delete(F.col("id") < 10) == 10
    with pytest.raises(Conflict):
        other.delete(F.col("id") >= 10)
    assert table.read().count() == 40


def test_odd_tables(spark):
    empty = VersionedTable.create(frame(spark, []), fresh_path(spark, "t"), ["id", "kind"], buckets=2)
    assert empty.read().count() == 0 and empty.delete(F.lit(True)) == 0 and empty.update(F.lit(True), {"v": F.lit(1)}) == 0
    assert empty.merge(frame(spark, [(1, None, 1.0), (None, "a", 1.0)])) == {"failed": 2, "inserted": 0, "updated": 0}
    assert empty.merge(frame(spark, [(1, "a", 1.0)] * 3)) == {"failed": 0, "inserted": 1, "updated": 0}
    assert empty.merge(frame(spark, [(1, "a", 2.0), (2, "a", 2.0)]), insert_only=True) == {"failed": 0, "inserted": 1, "updated": 0}
    assert rows_of(empty) == [(1, "a", 1.0), (2, "a", 2.0)] and [r["operation"] for r in empty.history().orderBy("version").collect()] == ["create", "merge", "delete", "update", "merge", "merge", "merge"]
    with pytest.raises(ValueError):
        empty.merge(spark.range(1))
    with pytest.raises(ValueError):
        empty.update(F.lit(True), {"id": F.lit(1)})


def test_flag_of_one_row_a_group(spark):
    rows = [(i, f"s{i % 3}", float(i % 3 == 0)) for i in range(9)]
    table = VersionedTable.create(frame(spark, rows), fresh_path(spark, "t"), ["id"], buckets=3)
    table.set_exclusive("kind", "v", spark.createDataFrame([("s0", 3), ("s1", 4)], "kind string, id long"))
    assert rows_of(table) == sorted(((i, f"s{i % 3}", float(i in (3, 4)) if i % 3 < 2 else 0.0) for i in range(9)), key=str)


def test_a_name_is_taken_once(spark):
    path = fresh_path(spark, "names")
    store = Store(spark, path)
    assert store.create(f"{path}/a", "one") and not store.create(f"{path}/a", "two") and store.read(f"{path}/a") == "one" and store.names(path) == ["a"]
