"""The built index against whole scans: scores, top lists with filters, edits, stems, folders that are opened."""

import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from quarrymill.functions import portuguese
from quarrymill.functions.text import tokens
from quarrymill.operators import index as I
from quarrymill.sources.shared import fresh_path

WEIGHTS = {"title": 2.0, "body": 1.0}
WORDS = "a ab abc abd abcd abcde abcdef abcdeg xbcdef bacdef abdef lei leis leia recurso recursos the of" .split()


def make(spark, rows, **more):
    docs = spark.createDataFrame(rows, "id long, title string, body string, lang string").repartition(3)
    return I.build(docs, "id", {"title": tokens(F.col("title")), "body": tokens(F.col("body"))}, fresh_path(spark, "index"), stored=["lang"], **more)


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(8)
    text = lambda most: " ".join(rng.choices(WORDS, weights=[9, 7, 5, 3, 3, 2, 2, 1, 1, 1, 1, 1, 1, 1, 1, 1, 30, 20], k=rng.randint(0, most)))
    return [(i, text(4), text(60), rng.choice(["en", "de"])) for i in range(300)] + [(900, None, None, "en"), (901, "", "", None), (901, "the", "", "de")]


@pytest.fixture(scope="module")
def index(spark, rows):
    return make(spark, rows)


def brute(rows, terms, boosts=None):
    """(id, row): score by the formula, over all rows."""
    fields = [[Counter((r[1] or "").split()), Counter((r[2] or "").split())] for r in rows]
    n, mean = len(rows), [sum(sum(f[i].values()) for f in fields) / len(rows) for i in (0, 1)]
    out = {}
    for row, f in enumerate(fields):
        best = 0.0
        for i, weight in enumerate((2.0, 1.0)):
            total = 0.0
            for t in terms:
                near = (boosts or {}).get(t, {t: 1.0})
                dfs = {w: sum(w in g[i] for g in fields) for w in near}
                df = max(dfs.values(), default=0)
                for w, boost in near.items():
                    if df and f[i][w]:
                        total += boost * math.log(1 + (n - df + 0.5) / (df + 0.5)) * f[i][w] * 2.2 / (f[i][w] + 1.2 * (0.25 + 0.75 * sum(f[i].values()) / mean[i]))
            best = max(best, weight * total)
        if best > 0:
            out[row] = best
    return out


def test_scores_of_any_terms(rows, index):
    rng = random.Random(1)
    for terms in (["the"], ["abc", "zzz"], ["lei", "lei", "of"], ["zzz"], [], *[rng.sample(WORDS, 3) for _ in range(4)]):
        want = sorted((rows[i][0], round(s, 6)) for i, s in brute(rows, terms).items())
        assert sorted((r["key"], round(r["score"], 6)) for r in I.Search(index, terms, WEIGHTS).scores().collect()) == want
    assert I.Search(index, ["the", "abc"], WEIGHTS).total().first()["total"] == len(brute(rows, ["the", "abc"]))


@pytest.mark.parametrize("bits", [2, 10])
def test_top_skips_blocks_and_loses_nothing(spark, rows, monkeypatch, bits):
    monkeypatch.setattr(I, "BLOCK_BITS", bits)
    index = make(spark, rows)
    for terms in (["the", "abcdef"], ["of"], ["xbcdef", "recurso", "a"], ["zzz"]):
        for k, where in ((3, None), (10, F.col("lang") == "de"), (1000, None)):
            keep = [i for i, r in enumerate(rows) if where is None or r[3] == "de"]
            want = sorted(((-round(s, 9), rows[i][0]) for i, s in brute(rows, terms).items() if i in keep))[:k]
            got = [(-round(r["score"], 9), r["key"]) for r in I.Search(index, terms, WEIGHTS).top(k, where).collect()]
            assert [(pytest.approx(s, abs=1e-6), key) for s, key in want] == got
    if bits == 2:
        search = I.Search(index, ["xbcdef"], WEIGHTS)
        bounds = search._bounds().collect()
        scores = brute(rows, ["xbcdef"])
        third = sorted(scores.values())[-3]
        assert len(bounds) > 10 and sum(b["bound"] >= third for b in bounds) < len(bounds)  # some blocks are never read


def test_only_the_terms_folders_are_opened(index):
    """Folders by their number, row groups by the least and greatest term in them."""
    plan = I.Search(index, ["lei", "abc"], WEIGHTS).blocks._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [shelf" in plan and "In(term, [abc,lei])" in plan
    unread = I.Search(index, ["lei", "abc"], WEIGHTS)._bounds()._jdf.queryExecution().executedPlan().toString()
    assert "entries" not in unread  # postings are not read to find what blocks promise


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row = row, [i]
        for j, y in enumerate(b, 1):
            row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
    return row[-1]


def test_spellings_against_all_words(spark, monkeypatch):
    rng = random.Random(6)
    words = sorted({"".join(rng.choice("abc") for _ in range(rng.randint(1, 9))) for _ in range(400)} | {"x" * n for n in range(28, 38)} | {"x" * 30 + "y"})
    asked = rng.sample(words, 12) + ["", "b", "zz", "aacba", "x" * 31, "x" * 33, "x" * 36, "cbacbacba"]
    index = make(spark, [(i, w, w, "en") for i, w in enumerate(words)])
    got = sorted((r["term"], r["token"], r["distance"], r["df"]) for r in I.expand(index, asked).collect())
    assert got == sorted((t, w, edits(t, w), 1) for t in set(asked) for w in words if edits(t, w) <= I.allowed_edits(t))


def test_fuzzy_scores(rows, index):
    vocabulary = {w for r in rows for t in r[1:3] for w in (t or "").split()}
    for terms in (["abcdef", "lea"], ["recursa"], ["ab"]):
        boosts = {t: {w: 1 - edits(t, w) / min(len(t), len(w)) for w in vocabulary if edits(t, w) <= I.allowed_edits(t) and edits(t, w) < min(len(t), len(w))} for t in terms}
        want = sorted((rows[i][0], round(s, 6)) for i, s in brute(rows, terms, boosts).items())
        assert sorted((r["key"], round(r["score"], 6)) for r in I.Search(index, terms, WEIGHTS, fuzzy=True).scores().collect()) == want and want


def test_no_documents(spark):
    index = I.build(spark.createDataFrame([], "id long, body string"), "id", {"title": tokens(F.col("body")), "body": tokens(F.col("body"))}, fresh_path(spark, "index"))
    s = I.Search(index, ["a"], WEIGHTS, fuzzy=True)
    assert s.scores().count() == 0 and s.top(3).count() == 0 and s.total().first()["total"] == 0


#: Published examples of the stemmer.
STEMS = "boa boa boas boas boataria boat boate boat boatos boat bobagem bobag bobalhões bobalhõ bobear bob bobeira bobeir bocaiúva bocaiúv boêmio boêmi bogotá bogot boiando boi quicaram quic quickly quickly quietos quiet quilométricas quilométr quilômetros quilômetr química químic quimioterápicos quimioteráp quinhão quinhã quintessência quintessent quintuplicou quintuplic quiosque quiosqu".split()


def test_portuguese(spark):
    assert [portuguese.stem(w) for w in STEMS[::2]] == STEMS[1::2] and portuguese.stem("") == "" and len(portuguese.STOP_WORDS) == 203
    row = spark.range(1).select(portuguese.words(F.lit("O Réu não PAGOU d'água as custas 1.234 e/ou multas.")).alias("w"), portuguese.words(F.lit(None).cast("string")).alias("none")).first()
    assert row["w"] == ["réu", "pagou", "d'água", "custas", "1.234", "multas"] and row["none"] == []
    rows = [(1, "Recurso provido", "o réu apelou"), (2, "nada", "recursos dos réus"), (3, None, "as multas")]
    docs = spark.createDataFrame(rows, "id long, title string, body string")
    index = I.build(docs, "id", {f: portuguese.words(F.col(f)) for f in ("title", "body")}, fresh_path(spark, "index"), stem=portuguese.stem)
    found = lambda q: sorted(r["key"] for r in I.Search(index, portuguese.query_words(q), WEIGHTS).scores().collect())
    assert found("os recursos") == [1, 2] and found("multa") == [3] and found("o de") == []
