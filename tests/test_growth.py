"""What a task holds does not grow with the table."""

import duckdb

from quarrymill.operators import calibration, tables
from quarrymill.plans import catalog


def test_overlap_counts_pairs_where_the_text_lies(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(tables, "TEXTS", 5, raising=False)
    items = spark.createDataFrame([(1, "dois tres quatro cinco"), (2, None), (3, "sete")], "item_id long, text string")
    items.write.parquet(f"{tmp_path}/items")  # files have a size, by which Spark plans the join
    items = spark.read.parquet(f"{tmp_path}/items")
    rows = [(1, "dois cinco"), (1, "tres"), (None, "Sete"), (None, None), (2, "seis"), *((i, "quatro três") for i in range(10, 45))]
    got = tables.overlap_join(items, spark.createDataFrame(rows, "doc_id long, text string"))
    # Four words need one. Rows of one id are one text, and no id is an id of its own, as in the SQL's GROUP BY.
    assert {tuple(r) for r in got.collect()} == {(1, 1, 3), (3, None, 1), *((1, i, 2) for i in range(10, 45))}
    assert got.rdd.getNumPartitions() == 8  # 40 texts, 5 to a task


def test_multiset_overlap_counts_pairs_where_the_text_lies(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(tables, "TEXTS", 5, raising=False)
    spark.createDataFrame([(1, "dois tres quatro cinco"), (2, None), (3, "sete")], "item_id long, text string").write.parquet(f"{tmp_path}/items")
    rows = [(1, 0, "dois dois"), (1, 0, "tres"), (1, 1, "dois"), (None, None, "sete sete"), (2, 0, None), *((i, 0, "quatro três seis") for i in range(10, 45))]
    got = calibration.multiset_overlap(spark.read.parquet(f"{tmp_path}/items"), spark.createDataFrame(rows, "conv_id long, turn int, text string"), ["conv_id", "turn"])
    # Four words need two hits, repeats and rows of one key added up.
    assert {tuple(r) for r in got.collect()} == {(1, 1, 0, 3), (3, None, None, 2), *((1, i, 0, 2) for i in range(10, 45))}
    assert got.rdd.getNumPartitions() == 8  # 40 texts, 5 to a task


def test_timeline_is_sorted_in_parts_that_follow_its_rows(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(tables, "ROWS", 10, raising=False)
    spark.range(40).selectExpr("if(id = 7, null, id) as o_orderkey", "cast(if(id = 9, null, date_add('2020-01-01', cast(id % 5 as int))) as timestamp_ntz) as o_orderdate").write.parquet(f"{tmp_path}/orders.parquet")
    spark.range(50).selectExpr("id as l_orderkey", "if(id = 3, null, 1) as l_linenumber", "2 as l_partkey", "cast(date_add('2020-01-01', cast(id % 7 as int)) as timestamp_ntz) as l_shipdate").write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.range(10).selectExpr("id as event_id", "cast('2020-01-03 10:00:00' as timestamp_ntz) as ts").write.parquet(f"{tmp_path}/events.parquet")
    con = duckdb.connect()
    for name in ("orders", "lineitem", "events"):
        con.execute(f"create view {name} as select * from '{tmp_path}/{name}.parquet/*.parquet'")
    got = catalog.timeline(spark, str(tmp_path))
    assert [tuple(r) for r in got.collect()] == con.execute(catalog.ORACLES["timeline"]).fetchall()  # null ids and days last
    assert got.rdd.getNumPartitions() == 10 and max(map(len, got.rdd.glom().collect())) <= 30
