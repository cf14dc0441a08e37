"""Reports, classes and modes on hand-made cases."""

import pytest
from pyspark.sql import functions as F

from quarrymill.operators import audit as A
from quarrymill.plans.audits import GENERIC, classify


def test_reports(spark):
    drafts = spark.createDataFrame([(1, 80, None), (2, 60, "CONTRADICTED"), (3, None, "MIXED"), (4, 100, "SUPPORTED")], "k int, richness int, stance string")
    findings = spark.createDataFrame([(1, "MISSING_STRUCTURE", True), (1, "SENTENCA_MISSING_CUSTAS", False), (2, "EVIDENCE_STANCE_VIOLATION", True), (2, "STANCE_CONTRADICTION_JEF", True), (2, "X", True), (3, "MISSING_STRUCTURE", False), (3, "MISSING_STRUCTURE", False)] + [(3, "TRIBUNAL_MISMATCH", False)] * 9, "k int, rule string, fatal boolean")
    got = {r["k"]: r for r in A.report(drafts, findings, "k").collect()}
    one = lambda k, *names: tuple(got[k][n] for n in names)
    assert one(1, "structure", "evidence", "argument", "consistency", "technical", "viability", "class", "quick_score") == (72, 100, 80, 100, 87, 70, "ATENCAO", 63)
    assert one(2, "structure", "evidence", "consistency", "viability", "class", "consistent", "quick_score") == (100, 75, 25, 0, "CRITICA", "INCONSISTENTE", 35)
    assert one(3, "structure", "evidence", "evidence_label", "argument", "consistency", "viability", "quick_score") == (80, 0, "Crítica", 0, 90, 100, 58)
    assert one(4, "technical", "class", "quick_score", "strengths", "suggestions") == (100, "VIAVEL", 80, ["structure", "appeal", "contrary_precedents", "stance"], [])
    assert got[3]["suggestions"] == ["MISSING_STRUCTURE", "TRIBUNAL_MISMATCH"] and got[2]["strengths"] == ["structure", "appeal"]
    assert A.report(drafts, findings.limit(0), "k").count() == 4


CLASSES = [
    ("Recurso inominado contra o JEF", ("RECURSO", "CIVIL", "JEF", "Recurso")), ("Decido. O INSS indeferiu o auxílio-doença", ("DECISAO", "RGPS", "ESTADUAL", "Benefício Previdenciário — Auxílio-doença")),
    ("Julgo improcedente; reclamante", ("SENTENCA", "CLT", "TRABALHO", "Relação de Trabalho")), ("despacho, RPPS", ("DESPACHO", "RPPS", "ESTADUAL", "Regime Próprio de Previdência Social")),
    ("execução fiscal", ("PETICAO_INICIAL", "CIVIL", "EXECUCAO_FISCAL", "Execução / Cumprimento de Sentença")), ("dano moral, TRF1", ("PETICAO_INICIAL", "CIVIL", "FEDERAL", "Direito do Consumidor")), (None, ("PETICAO_INICIAL", "CIVIL", "ESTADUAL", "Demanda Judicial")),
]


def test_classes(spark):
    rows = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(CLASSES)], "i int, t string")
    for r in classify(rows, "t").collect():
        assert (r["piece"], r["regime"], r["justice"], r["subject"]) == CLASSES[r["i"]][1], CLASSES[r["i"]][0]


@pytest.mark.parametrize("args, want", [
    (("curta", 0.9, "ESTADUAL", "SUFICIENTE", 5, 5, 5), "SAFE_SKELETON"), ((None, 0.9, "ESTADUAL", "SUFICIENTE", 5, 5, 5), "SAFE_SKELETON"), (("uma descrição que basta", 0.74, "ESTADUAL", "SUFICIENTE", 5, 5, 5), "SAFE_SKELETON"),
    (("uma descrição que basta", 0.75, "INDETERMINADA", "SUFICIENTE", 5, 5, 5), "SAFE_SKELETON"), (("modelo de petição inicial", 0.9, None, "SUFICIENTE", 5, 5, 5), "TEMPLATE_MODEL"), (("um modelo de petição inicial", 0.9, None, "SUFICIENTE", 3, 2, 2), "POSSIBLE_FINAL_DRAFT"),
    (("uma descrição que basta", 0.9, None, "INSUFICIENTE", 5, 5, 5), "SAFE_SKELETON"), (("uma descrição que basta", 0.9, None, "PARCIAL", 5, 5, 5), "TEMPLATE_MODEL"), (("uma descrição que basta", 0.9, None, None, 2, 5, 5), "TEMPLATE_MODEL"),
])
def test_modes(spark, args, want):
    kinds = ["string", "double", "string", "string", "int", "int", "int"]
    assert spark.range(1).select(A.generation_mode(*[F.lit(a).cast(k) for a, k in zip(args, kinds, strict=True)], GENERIC)).first()[0] == want
