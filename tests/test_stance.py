"""Stance on hand-made cases and against loops over patterns and precedents."""

import random
import re

import pytest
from pyspark.sql import functions as F

from quarrymill.operators import stance as S
from quarrymill.plans.stances import DIRECT, DISTINCTION, MARKS, PREMISES, REJECTION, STRONG

NUMBER = "0001234-56.2020.4.01.0000"
DRAFTS = {
    f"Conforme entendimento do TRF1 nos autos {NUMBER}, o direito é reconhecido.": 0,
    f"Embora exista precedente em sentido contrário do TRF1 ({NUMBER}), a hipótese dos autos difere porque o servidor faleceu antes da EC 41/2003.": 2,
    "A parte autora tem direito à paridade conforme o art. 7º da EC 41/2003.": None,
    f"Conforme o entendimento do TRF1 no processo {NUMBER}, o pensionista não faz jus à paridade após a EC 41/2003. Diante disso, JULGO IMPROCEDENTE o pedido formulado na inicial.": 1,
    f"O TRF1 no processo {NUMBER} assentou que não há amparo legal para o pleito. Ante o exposto, denego a ordem impetrada.": 1,
    f"Conforme entendimento do TRF1 nos autos {NUMBER}, o direito é reconhecido. JULGO PROCEDENTE o pedido.": 0,
    "O trf1 decidiu assim.": 0,
    "distinguishing " + "x" * 700 + f" {NUMBER}": 0,
    f"{NUMBER} " + "x" * 500 + " improcedente": 0,
    "": None,
}


def test_contrary_precedents_in_drafts(spark):
    drafts = spark.createDataFrame([("c", i, t) for i, t in enumerate(DRAFTS)] + [("c", 99, None), ("other", 98, NUMBER)], "case string, draft long, text string")
    jurs = spark.createDataFrame([("c", "j1", NUMBER, "TRF1", "CONTRARIO"), ("c", "j2", NUMBER, "TRF1", "FAVORAVEL"), ("c", "j3", None, "TRF1", "CONTRARIO"), ("c", "j4", "zz", "TR", "CONTRARIO")], "case string, id string, number string, court string, stance string")
    got = {(r["draft"], r["id"]): r["score"] for r in S.misused(drafts, jurs, STRONG, REJECTION).collect()}
    assert got == {(i, "j1"): s for i, s in enumerate(DRAFTS.values()) if s is not None}


@pytest.mark.parametrize("at_once", [3, 1000])
def test_citations_against_a_loop(spark, monkeypatch, at_once):
    monkeypatch.setattr(S, "AT_ONCE", at_once)
    rng = random.Random(at_once)
    jurs = [(f"c{rng.choice('aab')}", i, "".join(rng.choice("AB1") for _ in range(rng.randint(0, 4))), rng.choice(["A", "B1A", "1BBB1", None])) for i in range(60)]
    drafts = [(f"c{rng.choice('aaabz')}", i, "".join(rng.choice("ab1 .") for _ in range(rng.randint(0, 60)))) for i in range(50)]
    want = {}
    for case, d, text in drafts:
        for other, j, number, court in jurs:
            if case == other and number:
                at = text.lower().find(number.lower())
                at = text.lower().find(court.lower()) if at < 0 and court and len(court) >= 3 else at
                if at >= 0:
                    want[d, j] = text[max(0, at - 600) : at + 400]
    got = S.citations(spark.createDataFrame(drafts, "case string, draft long, text string"), spark.createDataFrame(jurs, "case string, id long, number string, court string"))
    assert {(r["draft"], r["id"]): r["window"] for r in got.collect()} == want and want


ARTICLES = [
    ("O autor faz jus à aposentadoria nos termos do art. 201 da CF/88.", "201", "DIRECT_FOUNDATION"), ("Pleiteia o servidor a aposentadoria com fundamento no art. 40 da Constituição Federal.", "40", "DIRECT_FOUNDATION"),
    ("O direito ao benefício é assegurado pelo art. 201 CF, conforme entendimento pacífico.", "201", "DIRECT_FOUNDATION"), ("O regime do servidor RPPS não se confunde com o art. 201 CF, que rege o RGPS.", "201", "DISTINCTION"),
    ("Diferentemente do art. 201 CF, o regime aplicável aqui é o RPPS (art. 40).", "201", "DISTINCTION"), ("O caso é de RPPS. Diferentemente, o art. 201 CF disciplina o RGPS.", "201", "DISTINCTION"),
    ("O servidor pleiteia a aposentadoria com fundamento no art. 40 CF.", "201", "NOT_PRESENT"), ("art. 201 CF", "201", "AMBIGUOUS"), ("RPPS, nos termos do art. 201 CF", "201", "AMBIGUOUS"), (None, "201", "NOT_PRESENT"),
    ("RPPS e art. 201 CF" + " x" * 300 + " conforme o art. 201 CF", "201", "DIRECT_FOUNDATION"), ("RPPS" + "é" * 250 + "art. 201 CF", "201", "AMBIGUOUS"), ("RPPS" + "é" * 246 + "art. 201 CF", "201", "DISTINCTION"),
]


@pytest.mark.parametrize("text, article, want", ARTICLES)
def test_article_contexts(spark, text, article, want):
    assert spark.range(1).select(S.article_context(F.lit(text).cast("string"), article, DISTINCTION, DIRECT)).first()[0] == want


def test_starts_of_matches(spark):
    texts = ["", "aXbXX", "XX", "é😀X", "none", "X" * 40]
    got = [r[0] for r in spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").orderBy("i").select(S.starts(F.col("t"), "X+?")).collect()]
    assert got == [[m.start() for m in re.finditer("X+?", t)] for t in texts]


def loop(claim, authorities, facts):
    hit = lambda p, t: re.search(p, t or "", re.I) is not None
    claimed = [p for p in PREMISES if hit(p.claim, claim)]
    found = [p.name for p in claimed if any(hit(p.contrary, a) for a in authorities)]
    for f in facts:
        first = next((p.name for p in claimed if hit(p.contrary, f)), None)
        if first and first not in found:
            found.append(first)
    favorable = any(hit(MARKS.favorable, a) for a in authorities)
    result = ("SUPPORTED" if favorable else "UNKNOWN") if not found else "MIXED" if favorable and len(found) == 1 else "CONTRADICTED"
    confidence = {"SUPPORTED": 0.65, "UNKNOWN": 0.30, "MIXED": 0.60}.get(result, 0.92 if len(found) > 1 else 0.80)
    distinguishing, subsidiary = hit(MARKS.distinguishing, claim) or any(hit(MARKS.distinguishing, f) for f in facts), hit(MARKS.subsidiary, claim)
    block = result == "CONTRADICTED" and not distinguishing and not subsidiary
    return result, confidence, len(found), found[0] if block else None, block, distinguishing, subsidiary


CASES = [
    ("pede paridade", ["A EC 41 impede a paridade"], [], ("CONTRADICTED", 0.80, 1, "RPPS_PARIDADE_EC41", True, False, False)),
    ("pede paridade", ["Pensionista não faz jus à paridade"], [], ("MIXED", 0.60, 1, None, False, False, False)),  # "faz jus" counts as favourable, negated or not
    ("pede paridade", ["A EC 41 veda a paridade", "o autor tem direito"], [], ("MIXED", 0.60, 1, None, False, False, False)),
    ("aposentadoria e paridade", ["sem paridade pós-EC 41", "perdeu a qualidade de segurado", "procedente"], [], ("CONTRADICTED", 0.92, 2, "RPPS_PARIDADE_EC41", True, False, False)),
    ("aposentadoria, subsidiariamente requer auxílio", [], ["carência não cumprida"], ("CONTRADICTED", 0.80, 1, None, False, False, True)),
    ("aposentadoria", [], ["período de graça expirou", "situação fática distinta do precedente"], ("CONTRADICTED", 0.80, 1, None, False, True, False)),
    ("outra coisa", ["não faz jus à paridade", "deve ser concedido"], [], ("SUPPORTED", 0.65, 0, None, False, False, False)),
    (None, [None], [None], ("UNKNOWN", 0.30, 0, None, False, False, False)),
    ("causa no JEF", ["sem renúncia ao excedente", "incompetência do juizado"], [], ("CONTRADICTED", 0.92, 2, "JEF_VALOR_EXCEDE_COMPETENCIA", True, False, False)),
]


def test_stance_of_cases(spark):
    rng = random.Random(7)
    pieces = [c[0] for c in CASES[:5]] + [a for c in CASES for a in c[1] + c[2] if a] + ["nada", ""]
    cases = [(c, list(a), list(f)) for c, a, f, _ in CASES]
    cases += [(" ".join(rng.sample(pieces, 2)), rng.sample(pieces, rng.randint(0, 4)), rng.sample(pieces, rng.randint(0, 3))) for _ in range(60)]
    claims = spark.createDataFrame([(i, c[0]) for i, c in enumerate(cases)], "case long, text string")
    authorities = spark.createDataFrame([(i, a) for i, c in enumerate(cases) for a in c[1]] + [(9999, "x")], "case long, text string")
    evidence = spark.createDataFrame([(i, k, f) for i, c in enumerate(cases) for k, f in enumerate(c[2])], "case long, pos int, text string")
    got = {r[0]: tuple(r)[1:] for r in S.analyze(claims, authorities, evidence, PREMISES, MARKS).collect()}
    for i, c in enumerate(cases):
        assert got[i] == loop(*c), c
        if i < len(CASES):
            assert got[i] == CASES[i][3], c
