"""Draft audits: windows against brute force, edges of the guard, the cut and the score."""

import re

from pyspark.sql import functions as F

from quarrymill.operators import drafts as D
from quarrymill.plans import drafts as P


def test_windows_equal_brute_force(spark):
    texts = ["", "fixo", "xx fixo yy condeno fixo zz", "fixofixo fixo" + "é😀 " * 30 + "condeno", "a" * 25 + " fixo " * 9, None]
    pattern = r"\bfixo\b|\bcondeno\b"
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", D.windows(F.col("t"), pattern, 20, 30).alias("w")).collect()
    for i, got in rows:
        t = texts[i]
        want = None if t is None else [t[max(0, m.start() - 20) : m.start() + 30] for m in re.finditer(pattern, t, re.A)]
        assert (got and [w.lstrip("\n") for w in got]) == (want and [w.lstrip("\n") for w in want])


def test_cut_and_edges(spark):
    docs = spark.createDataFrame([(1, "Ante o exposto, fim"), (2, "0123456789"), (3, None), (4, "")], "doc_id long, t string")
    got = {r[0]: r[1:] for r in D.parts(docs, "t", P.OUTCOME).select("doc_id", "reasoning", "outcome").collect()}
    assert got == {1: ("", "ante o exposto, fim"), 2: ("01234567", "89"), 3: ("", ""), 4: ("", "")}
    assert D.request_findings(D.parts(docs, "t", P.OUTCOME), P.REQUESTS).count() == 0
    assert D.pair_findings(D.parts(docs.limit(0), "t", P.OUTCOME), P.EVIDENCE).count() == 0
    assert [r[0] for r in docs.orderBy("doc_id").select(D.enough_words(F.col("t"))).collect()] == [False] * 4


def test_orders_against_the_other_side_are_no_grant(spark):
    docs = spark.createDataFrame([(1, "coisa julgada", "condeno o autor em custas"), (2, "coisa julgada", "condeno o reu")], "doc_id long, reasoning string, outcome string")
    assert [r[0] for r in D.pair_findings(docs, P.CONTRADICTIONS).collect()] == [2]


def test_validity_without_rows_or_variance(spark):
    pairs = spark.createDataFrame([(True, 5), (True, 1), (None, 4)], "passed boolean, overall int")
    assert D.validity(pairs.limit(0), "passed", "overall").first()[:] == (0, 0.0, 0.0, 0.0, 0.0)
    n, agreement, fp, fn, r = D.validity(pairs, "passed", "overall").first()
    assert (n, agreement, fp, fn) == (3, 1 / 3, 1 / 3, 1 / 3) and abs(r + 0.2774) < 1e-3
    assert D.validity(pairs.where("passed"), "passed", "overall").first()["r"] == 0
