"""Small cases: nulls, ties, empty tables, broken lines, restarts."""

from pyspark.sql import functions as F

from quarrymill.functions import text as T
from quarrymill.operators import analytics, rules, search, tables
from quarrymill.sources import landed
from quarrymill.streaming.events import event_windows, stream_to_table


def test_text_functions(spark):
    row = spark.range(1).select(
        T.fold(F.lit("Órgão")).alias("fold"), T.clean(F.lit(" a   b\n")).alias("clean"), T.slug(F.lit("Ação nº 1")).alias("slug"), T.tokens(F.lit(None).cast("string")).alias("none"),
        T.mask_personal(F.lit(" cpf 123.456.789-09, rg 1.234.567-x, autos 0001234-56.2020.4.03.6100 e 2001.61.000123-4" + " z" * 90)).alias("masked"), T.html_to_text(F.lit("<li>a</li>&amp;&eacute;&#233;&lt;b&gt;<br/>\n\n\nz")).alias("html"),
        T.iso_date(F.lit("1/2/2020")).alias("d"), T.iso_date(F.lit("99/77/2020")).alias("odd"), T.iso_date(F.lit("x")).alias("bad"), T.year_of(F.lit("em 2014")).alias("year"), T.long_date(F.lit("12 de Março de 2020")).alias("long"), T.fold(F.lit("Łódź ő é")).alias("fold2"),
        T.slug(F.lit("é")).alias("short"), T.slug(F.lit("ab " * 40)).alias("cut"), T.absolute_url(F.lit("a/b"), "https://x/").alias("relative"), T.fnv1a(F.lit("a")).alias("fnv"), T.clamp01(F.lit("nan?")).alias("clamped"), T.tiered(F.lit(6), [1, 3, 5, 8], [0.25, 0.5, 0.75, 1], 20).alias("tier"),
    ).first()
    assert (row["fold"], row["clean"], row["slug"], row["none"]) == ("orgao", "a b", "acao_n_1", [])
    assert row["masked"].startswith("cpf [CPF], rg [RG], autos [PROCESSO] e [PROCESSO] z") and len(row["masked"]) <= 120
    assert row["html"] == "- a\n&éé\n\nz" and (row["d"], row["odd"], row["bad"], row["year"], row["long"]) == ("2020-02-01", "2020-77-99", "", 2014, "2020-03-12")
    assert (row["fold2"], row["short"], row["relative"], row["fnv"], row["clamped"], row["tier"]) == ("łodz o e", "", "https://x/a/b", 3826002220, 0.0, 15) and len(row["cut"]) == 40


def test_bm25_of_nulls_and_no_rows(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, None), (3, "b")], "doc_id long, text string")
    assert [r["doc_id"] for r in search.bm25(docs, {"t": (F.col("text"), 1.0)}, ["a"]).collect()] == [1]
    assert search.bm25(docs.limit(0), {"t": (F.col("text"), 1.0)}, ["a"]).count() == 0


def test_fusion_breaks_ties_by_key(spark):
    a = spark.createDataFrame([(2, 0, "x"), (1, 1, "x")], "k long, place int, branch string")
    b = spark.createDataFrame([(1, 0, "y"), (2, 1, "y")], "k long, place int, branch string")
    assert [(r["k"], r["branches"]) for r in search.reciprocal_rank_fusion([a, b], "k", 5).collect()] == [(1, "x+y"), (2, "x+y")]


def test_upsert_twice_is_the_same(spark):
    stored, new = spark.createDataFrame([(1, "a"), (2, "b")], "id long, v string"), spark.createDataFrame([(2, None), (3, "c")], "id long, v string")
    once = tables.upsert(stored, new, "id")
    assert {tuple(r) for r in once.collect()} == {(1, "a", "kept"), (2, None, "updated"), (3, "c", "inserted")}
    assert {r[:2] for r in map(tuple, tables.upsert(once.drop("action"), new, "id").collect())} == {(1, "a"), (2, None), (3, "c")}


def test_metrics_without_positives(spark):
    cases = spark.createDataFrame([(0, 0, "a"), (0, 1, "b")], "expected int, predicted int, lang string")
    got = {r["value"]: (r["precision"], r["recall"], r["f1"]) for r in analytics.metrics_slices(cases, ["lang"]).collect()}
    assert got == {"a": (1.0, 1.0, 1.0), "b": (0.0, 1.0, 0.0), "ALL": (0.0, 1.0, 0.0)}
    assert analytics.pearson(cases, "expected", "predicted").first()["r"] == 0


def test_rules_on_empty_text(spark):
    docs = spark.createDataFrame([(1, None), (2, "bad reason. therefore: denied")], "doc_id long, text string")
    split = rules.sections(docs, "text", "therefore")
    found = rules.findings(split, [rules.Rule("X", "FATAL", reason="bad", outcome="denied")])
    assert [tuple(r) for r in found.collect()] == [(2, "X", "FATAL")]
    assert {r["doc_id"]: r["status"] for r in rules.report(split, found).collect()} == {1: "APPROVE", 2: "REJECT"}


def test_landed_files(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"a": 1}\n{"a": \n{"a": 2}\n')
    good, broken = landed.json_lines(spark, str(tmp_path / "a.jsonl"), "a int")
    assert sorted(r["a"] for r in good.collect()) == [1, 2] and broken.count() == 1
    rows = spark.createDataFrame([(1, "x"), (1, "x"), (2, "y")], "id int, v string")
    assert landed.append_unseen(rows, str(tmp_path / "t"), ["id"]) == 2
    assert landed.append_unseen(rows, str(tmp_path / "t"), ["id"]) == 0
    (tmp_path / "p.json").write_text('{"total": 2, "items": [{"id": "a"}, {"id": null}]}')
    assert landed.json_pages(spark, str(tmp_path / "p.json"), "id: string").count() == 2


def test_stream_equals_batch(spark, tmp_path):
    events = spark.createDataFrame([(f"2024-01-0{d} 0{h}:10:00", "a", 1.0) for d in (1, 2, 3, 4) for h in (1, 2)], "ts string, event_type string, value double").withColumn("ts", F.to_timestamp("ts"))
    events.repartition(1).sortWithinPartitions("ts").write.parquet(str(tmp_path / "in"))
    for _ in range(2):  # a restart adds nothing
        stream_to_table(spark, str(tmp_path / "in"), "ts timestamp, event_type string, value double", str(tmp_path / "out"), str(tmp_path / "check"))
    got = {tuple(r) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    want = {tuple(r) for r in event_windows(events).collect()}
    assert got <= want and len(got) >= 4


def test_html_name_of_an_ampersand_cut_by_a_tag(spark):
    texts = ["a&&am<style>p{margin:0}</style>", "a&&am<b>p", "x&amp;lt;y &am<i>p;", "&am<i>p</i>\nz", "&quot<style></style>p{} &copy &notit; &copy;&#65;&#x42;\0", None]
    got = [T.html_to_text(F.lit(t)).alias(f"c{i}") for i, t in enumerate(texts)]
    assert list(spark.range(1).select(*got).first()) == ["a&&{margin:0}", "a&&", "x&lt;y &amp;", "&\nz", "&quotp{} &copy &notit; ©AB", ""]


def test_gated_patterns_find_what_the_plain_ones_find(spark):
    import random
    import re

    from quarrymill.plans import stances as P

    patterns = [*P.MARKS, P.STRONG, P.REJECTION, *[p for x in P.PREMISES for p in (x.claim, x.contrary)], r"\b(ab+c|x(?:yz)?w)\b", r"\b(foo)(bar|quux)\b", r"(?:abc)?def", r"[(]abc|(\)x){2}yy", r"(?=abc)a"]
    assert T.spread(patterns[-5]) == [r"\b(?:ab+c)\b", r"\b(?:x(?:yz)?w)\b"] and T.spread(patterns[-4]) == [patterns[-4]]
    assert T.needed_literals("(?:abc)?(?!never)(?:defg|hij)k") == ["defg", "hij"] and T.needed_literals("a|bcd") == []
    words = ["perdeu", "qualidade", "de", "segurado", "Julgo", "IMPROCEDENTE", "EC 41", "sem", "paridade", "não faz jus", "à", "ſituação", "ſituação fática distinta", "foo", "foobar", "abbc", "xw", "def", "procedente", "procedência do pedido", "JEF", "\n", "tem", "direito"]
    rng = random.Random(5)
    texts = [" ".join(rng.choices(words, k=6)) for _ in range(200)]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").withColumn("low", F.lower("t"))
    tests = [T.found_in_any_case(F.col("t"), F.col("low"), p).alias(f"a{i}") for i, p in enumerate(patterns)] + [T.found(F.col("t"), p).alias(f"b{i}") for i, p in enumerate(patterns)]
    plain = [F.col("t").rlike("(?iu)" + T.ascii_edges(p)) for p in patterns] + [F.col("t").rlike(T.ascii_edges(p)) for p in patterns]
    got = rows.select(F.array(*tests).alias("gated"), F.array(*plain).alias("plain")).collect()
    assert all(r["gated"] == r["plain"] for r in got) and any(any(r["plain"]) for r in got)
