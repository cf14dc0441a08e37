"""Classifiers, style, citations, dates and cycles on hand-made cases, with the expected values written out."""

import pytest
from pyspark.sql import functions as F

from quarrymill.functions import text as T
from quarrymill.operators import calibration as K
from quarrymill.plans import texts

OUTCOMES = {
    "concedo a ordem": "CONCEDO_ORDEM", "order concedida": "CONCEDO_ORDEM", "segurança denegada": "DENEGO_ORDEM", "denegar a ordem": "DENEGO_ORDEM", "houve condenação": "CONDENO", "condenacao": "CONDENO",
    "absolvição": "ABSOLVO", "absolvendo": "ABSOLVO", "indefiro o pedido": "INDEFIRO", "defiro": "DEFIRO", "deferido": "DEFIRO", "art. 485 do cpc": "EXTINCAO_SEM_RESOLUCAO", "art 485 cpc": "EXTINCAO_SEM_RESOLUCAO",
    "extingui sem resolução": "EXTINCAO_SEM_RESOLUCAO", "julgar extinto sem": "EXTINCAO_SEM_RESOLUCAO", "homologação de transação": "HOMOLOGACAO", "homologar acordo": "HOMOLOGACAO", "homologar o acordo": "HOMOLOGACAO",
    "procedência parcial": "PARCIALMENTE_PROCEDENTE", "procedente em parte": "PARCIALMENTE_PROCEDENTE", "improcedência": "IMPROCEDENTE", "improcedentes": "IMPROCEDENTE", "a procedência do pedido": "PROCEDENTE", "procedente": "PROCEDENTE",
    "nada": None, "condenou": None, "xprocedente": None,
}


def test_outcomes(spark):
    rows = spark.createDataFrame(list(OUTCOMES.items()), "t string, want string")
    for r in rows.withColumn("got", T.first_match(F.col("t"), texts.OUTCOMES, None)).collect():
        assert r["got"] == r["want"], r["t"]
    assert [name for _, name in texts.OUTCOMES] == ["CONCEDO_ORDEM", "DENEGO_ORDEM", "CONDENO", "ABSOLVO", "INDEFIRO", "DEFIRO", "EXTINCAO_SEM_RESOLUCAO", "HOMOLOGACAO", "PARCIALMENTE_PROCEDENTE", "IMPROCEDENTE", "PROCEDENTE"]


def test_fixed_tables_are_whole():
    assert len(texts.BANNED) == 21 and len(texts.REPETITIVE) == 9 and len(texts.AREAS) == 7 and len(texts.BRANCHES) == 14 and len(texts.COURTS) == 7
    assert {"data maxima venia", "nobre julgador", "douto juízo", "patente que", "resta demonstrado", "não merece prosperar"} <= set(texts.BANNED)


@pytest.mark.parametrize("text, norms", [("art. 5 e art. 5-A e art. 5º-B", 3), ("artigo. 7 e Art.7", 1), ("lei n. 8.213 e lei 8.213", 2), ("EC 103/2019 e emenda constitucional n. 103", 2), ("CPC/2015, cf/88 e cdc", 3), ("", 0)])
def test_norms(spark, monkeypatch, text, norms):
    monkeypatch.setattr(texts, "_joined", lambda spark, sf: spark.createDataFrame([(1, text)], "doc_id long, t string"))
    assert texts.citation_counts(spark, "").first()["norms"] == norms + ("artigo." in text)  # "artigo.7" and "art.7" differ


@pytest.mark.parametrize("text, score", [("data maxima venia, nobre julgador", 80), ("não merece prosperar", 80), ("Vem, respeitosamente", 90), ("pede deferimento.", 80), ("termos em que, pede deferimento.", 60), ("cumpre destacar, cumpre destacar e cumpre destacar", 90), ("ok", 100)])
def test_style(spark, monkeypatch, text, score):
    monkeypatch.setattr(texts, "_joined", lambda spark, sf: spark.createDataFrame([(1, text)], "doc_id long, t string"))
    assert texts.style_lint(spark, "").first()["score"] == score


def test_literals_that_a_pattern_needs():
    assert T.alternatives(r"a|b[|]c|(?:d|e)f|g\|h") == ["a", "b[|]c", "(?:d|e)f", r"g\|h"]
    assert [T.needed_literal(x) for x in ("tribut", r"iss\b", "execu.{1,5}fiscal", r"\bhomolog(?:ar|a[cç][aã]o)\s+acordo\b", "extinguir?", "ab+c", "x{2}y")] == ["tribut", "iss", "fiscal", "homolog", "extingui", "ab", "y"]


def test_found_equals_the_pattern(spark):
    """Gates lose no match: every pattern of the tables on its own alternatives' words."""
    words = ["execução fiscal", "execu fiscal", "iss", "missa", "acidente de trabalho", "réu", "o réu", "crime", "licitação", "área de proteção", "adoção", "união estável", "inss", "clt", "clta", "taxa", "taxas", "responsabilidade do estado", ""]
    rows = spark.createDataFrame([(w,) for w in words], "t string")
    for pattern, _ in [*texts.AREAS, *texts.OUTCOMES]:
        for r in rows.select("t", T.found(F.col("t"), pattern).alias("a"), F.col("t").rlike(T.ascii_edges(pattern)).alias("b")).collect():
            assert r["a"] == r["b"], (r["t"], pattern)


@pytest.mark.parametrize("start, now, want", [("1990-01-15", "2024-07-15", ("2024-07-15", "2024-08-15")), ("2024-01-31", "2024-07-15", ("2024-06-29", "2024-07-29")), ("2024-07-20", "2024-07-15", ("2024-07-20", "2024-08-20")), ("1890-05-01", "2024-07-15", ("2024-07-01", "2024-08-01"))])
def test_cycles_of_any_age(spark, start, now, want):
    r = K.rolled_cycles(spark.createDataFrame([(start,), (None,)], "s string").select(F.to_date("s").alias("start")), now).orderBy(F.desc_nulls_last("cycle_start")).collect()
    assert (str(r[0]["cycle_start"]), str(r[0]["cycle_end"])) == want and r[1]["cycle_start"] is None


@pytest.mark.parametrize("raw, day, year, long", [("2020-02-03", "2020-02-03", 2020, None), ("3/2/2020", "2020-02-03", 2020, None), (" 03/02/2020 ", "2020-02-03", 2020, None), ("99/77/2020", "2020-77-99", 2020, None), ("em 2014, salvo 2015", "", 2014, None), ("12 de março de 2020", "", 2020, "2020-03-12"), ("1 de DEZEMBRO de 1999", "", None, "1999-12-01"), ("12 de marte de 2020", "", 2020, None), ("2020-2-3", "", 2020, None), ("12020", "", None, None), (None, "", None, None)])
def test_dates(spark, raw, day, year, long):
    c = F.lit(raw).cast("string")
    assert tuple(spark.range(1).select(T.iso_date(c), T.year_of(c), T.long_date(c)).first()) == (day, year, long)
