"""Statutes against a line-by-line parser, JSON against the json module, repairs in any order, files of unknown encoding, quality runs by hand."""

import itertools
import json
import random
import re

import pytest
from pyspark.sql import functions as F

from quarrymill.functions import records as R
from quarrymill.operators import quality as Q
from quarrymill.sources.shared import fresh_path


def parser(text):
    out, now = [], None
    for line in (" ".join(re.split(r"[ \t\r\f\x0b]+", x)).strip() for x in (text or "").split("\n")):
        if not line:
            continue
        m = re.match(r"art\.\s*([0-9]+)[ºo.]?", line, re.I)
        if m:
            now = [f"Art. {m[1]}", line]
            out.append(now)
        elif re.match("livro|título|capítulo|seção", line, re.I):
            now = None
        elif now:
            now[1] += "\n" + line
    return [tuple(x) for x in out]


def test_articles_against_a_parser(spark):
    rng = random.Random(3)
    lines = ["Art. 1º Texto", "Art. 2o", "art. 3. x", "Art.4", "§ 1º algo", "I - inciso Art. 9", "CAPÍTULO II", "título", "Seção única", "LIVRO I", "", "  ", "Artigo 7", "  Art. 12  a   b ", "outra\tlinha"]
    texts = [None, "", "Art. 1", *["\n".join(rng.choices(lines, k=rng.randint(1, 40))) for _ in range(80)], "\n".join(f"Art. {i}º " + "palavra " * 50 for i in range(1, 3000))]
    got = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", R.articles(F.col("t")).alias("a")).collect()
    for r in got:
        assert [tuple(x) for x in r["a"]] == parser(texts[r["i"]]), texts[r["i"]][:200]


def test_statute_pages(spark):
    html = "<body><p>CAPÍTULO I</p><p>Art. 1º Vale. (Redação dada pela Lei 5)</p><div>§ 1º <strike>velho</strike> novo (Vide Lei 9)</div><p><del>Art. 2º morto</del></p><span style='text-decoration: line-through'>nada</span><p>Art. 3&ordm; fim<br>linha</p><p>TÍTULO II</p><p>solto</p></body>"
    rows = spark.createDataFrame([("N", 1, html), ("N", 2, "<p>Art. 3º outro</p>"), ("M", 1, None)], "norm string, seq int, html string").withColumn("t", R.statute_text(F.col("html")))
    assert {(r["norm"], r["device"], r["text"]) for r in R.devices(rows, "norm", "t", "seq").collect()} == {("N", "Art. 1", "Art. 1º Vale.\n§ 1º novo"), ("N", "Art. 3", "Art. 3º outro")}


def test_files_of_unknown_encoding(spark, tmp_path):
    text = "<p>Seção É</p>"
    for name, data in {"a.html": text.encode("utf-16"), "b.htm": text.encode("latin-1"), "c.html": text.encode(), "d.html": b"\xef\xbb\xbf" + text.encode(), "e.html": text.encode("utf-16-le"), "f.html": text.encode("utf-16-be"), "g.html": b"", "h.txt": b"x"}.items():
        (tmp_path / name).write_bytes(data)
    got = {r["path"].rsplit("/", 1)[1]: r["html"] for r in R.html_files(spark, str(tmp_path)).collect()}
    assert got == {n: text for n in ("a.html", "b.htm", "c.html", "d.html", "e.html", "f.html")}  # Spark lists no empty files


JSON = ['{"a": 1}', 'x {"a": "}{", "b": [1, {"c": "\\"}"}]} y {"z": 1}', "{}", "{broken", "none", "", None, '{"a": }', "[1, 2]", 'say "{" {"a": 1}', '{"a": "x\\\\"} }', '{"a": {"b": {"c": null}}} {', '```json\n{"n": 1.5e3, "t": true}\n```', "{1: 2}", '{"long": "' + "y" * 20000 + '"}', "{" * 500, '{"é": "😀 \\u00e9"}', '"{"a": 1}']


def test_first_json_against_the_module(spark):
    for r in spark.createDataFrame(list(enumerate(JSON)), "i int, t string").select("i", F.to_json(R.first_json(F.col("t"))).alias("j")).collect():
        text = JSON[r["i"]] or ""
        try:
            want, _ = json.JSONDecoder().raw_decode(text[text.index("{") :])
        except ValueError:
            want = None
        assert (None if r["j"] is None else json.loads(r["j"])) == want, text[:60]


RECORD = "k int, processo string, relator string, orgao_julgador string, data_julgamento string, data_publicacao string, tema string, destaque string"


def test_repairs_in_any_order(spark):
    record = (1, "REsp", "istro Fulano de Tal", "", "2020", None, "curto", "d" * 10)
    offers = [(1, "0.9", "REsp 1.234", "Ministro Fulano", "Turma", "2021", "2022", "um tema bem mais longo", "d" * 31), (1, "0.8", "REsp 1.234/SP", "x", "Seção", None, "", "um tema", "d" * 40), (1, "0.1", "REsp 9" * 9, "zzz" * 9, "zzz", "z", "z", "z" * 99, "z" * 99), (1, "nan?", "z" * 50, "", "", "", "", "", "")]
    seen = set()
    for order in itertools.permutations(offers):
        out = R.repaired(spark.createDataFrame([record, (2, *record[1:])], RECORD), spark.createDataFrame(list(order), RECORD.replace("k int", "k int, confidence string")), "k", R.FIELDS, 0.5).orderBy("k").collect()
        seen.add(tuple(out[0]))
        assert tuple(out[1]) == (2, *record[1:], False)
        if len(seen) > 1 or order == tuple(offers[::-1]):
            break
    assert seen == {(1, "REsp 1.234/SP", "Ministro Fulano", "Turma", "2020", "2022", "um tema bem mais longo", "d" * 40, True)}


@pytest.mark.parametrize("value, case, name", [("", True, True), (None, True, True), ("REsp 12", False, True), ("REsp", True, True), ("processo sem numero", False, False), ("istro Fulano", True, True), ("Min. Fulano", True, False), ("1234567890", False, True)])
def test_doubtful_fields(spark, value, case, name):
    v = F.lit(value).cast("string")
    assert tuple(spark.range(1).select(R.suspicious_case(v), R.suspicious_name(v)).first()) == (case, name)


def test_quality_run(spark):
    schema = "area string, document_type string, theme string, trap string, trap_outcome string, status string, document_status string, score double, input_tokens long, output_tokens long, cost double, ms long, errors array<struct<rule: string, fatal: boolean>>"
    rows = [("A", "d", "t1", "X", "DETECTED", "success", "REPROVADA", 50.0, 1, 2, 0.5, 10, [("JEF_Z", True), ("R", False)]), ("A", "e", "t1", "X", None, "error", None, None, 1, 2, 0.5, 20, []), ("B", "d", "t2", None, "DETECTED", "success", "MINUTA APROVADA", 100.0, 1, 2, 0.5, 30, [("R", True), ("JEF_Z", False)])]
    df = spark.createDataFrame(rows, schema)
    got = {(r["dimension"], r["value"]): r for r in Q.quality_summary(df).collect()}
    assert set(got) == {("all", ""), ("area", "A"), ("area", "B"), ("document_type", "d"), ("document_type", "e"), ("theme", "t1"), ("theme", "t2"), ("trap", "X")}
    a = got["all", ""]
    assert (a["total"], a["succeeded"], a["approved"], a["rejected"], a["avg_score"], a["traps"], a["detected"], a["missed"], a["cost"]) == (3, 2, 1, 1, 75.0, 2, 1, 1, 1.5)
    assert got["document_type", "e"]["avg_score"] == 0 and got["trap", "X"]["total"] == 2
    rules = {tuple(r) for r in Q.top_rules(df, Q.validator_of(F.col("rule"))).collect()}
    assert rules == {("all", "", 1, "JEF_Z", 1), ("all", "", 2, "R", 1), ("theme", "t1", 1, "JEF_Z", 1), ("theme", "t2", 1, "R", 1), ("validator", "JefCivelValidator", 1, "JEF_Z", 2), ("validator", "Other", 1, "R", 2)}
    assert Q.quality_summary(df.limit(0)).where("dimension <> 'all'").count() == 0


@pytest.mark.parametrize("rule, name", [("EVIDENCE_X", "EvidenceAnalyzer"), ("JEF_JEC_WRONG_APPEAL", "AppealValidator"), ("JEF_OTHER", "JefCivelValidator"), ("STANCE_CONTRADICTION_JEF", "EvidenceAnalyzer"), ("WRONG_HONORARIOS", "LegalValidator"), ("nothing", "Other")])
def test_validators(spark, rule, name):
    assert spark.range(1).select(Q.validator_of(F.lit(rule))).first()[0] == name


DOUBLED = re.compile("[A-Z\xc0-\xd6\xd8-\xde]{4,}")


def test_pages(spark):
    rng = random.Random(2)
    texts = ["TTRRIIBBUUNNAALL DDEE JJUUSSTTIIÇÇAA", "AABB AABBC ABAB AA x", "palavra que- brada  e\nlinha .  fim", "12- 34", "", *["".join(rng.choice("AAABBÇ a\n-.") for _ in range(30)) for _ in range(60)]]
    one = lambda m: m[0][::2] if len(m[0]) % 2 == 0 and all(m[0][i] == m[0][i + 1] for i in range(0, len(m[0]), 2)) else m[0]

    def flat(t):
        t = re.sub(r" {2,}", " ", t.replace("\n", " "))
        t = re.sub("([A-Za-z\xc0-\xff])- ([A-Za-z\xc0-\xff])", r"\1\2", t)
        return re.sub(r" +", " ", re.sub(r" \.", ".", re.sub(r" {2,}", " ", t))).strip()

    for r in spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", R.undoubled(F.col("t")).alias("u"), R.flattened(F.col("t")).alias("f")).collect():
        assert (r["u"], r["f"]) == (DOUBLED.sub(one, texts[r["i"]]), flat(texts[r["i"]])), texts[r["i"]]


@pytest.mark.parametrize("text, n", [("Tese 1 e tese 2", 2), ("1. Um\n2. Dois\nx 3. y", 2), ("I – DOS FATOS", 1), ("no meio II - do direito", 1), ("DO MÉRITO\nrelatório\nConclusão", 3), ("nada", 0), ("", 0)])
def test_sections(spark, text, n):
    assert spark.range(1).select(R.section_count(F.lit(text))).first()[0] == n
