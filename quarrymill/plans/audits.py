"""Queries of whole audits: reports from findings, what a text is by its words, how far a draft can be written."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrymill.operators import audit as A
from quarrymill.plans.catalog import query, read

_RULES = ["MISSING_STRUCTURE", "WRONG_SUPERIOR_COURT", "SENTENCA_MISSING_CUSTAS", "EVIDENCE_STANCE_VIOLATION", "GENERIC_JURISPRUDENCE", "STANCE_CONTRADICTION_JEF", "NO_SUCH_RULE", "FORBIDDEN_STRUCTURE", "TRIBUNAL_MISMATCH", "OTHER_RULE", "MORE_RULE"]
_LIST = "[" + ", ".join(f"'{r}'" for r in _RULES) + "]"
_IN = lambda rules: "rule IN (" + ", ".join(f"'{r}'" for r in rules) + ")"


@query(
    "audit_report",
    f"WITH f AS (SELECT l_orderkey AS k, {_LIST}[(l_partkey % {len(_RULES)})::INT + 1] AS rule, l_quantity > 30 AS fatal FROM lineitem), "
    f"g AS (SELECT k, sum(CASE WHEN {_IN((*A.STRUCTURAL, *A.APPEAL))} THEN CASE WHEN fatal THEN 20 ELSE 10 END WHEN {_IN(A.CIVIL)} THEN 8 ELSE 0 END) AS s, sum(CASE WHEN {_IN(A.PROBATORY)} THEN CASE WHEN fatal THEN 25 ELSE 12 END ELSE 0 END) AS e, "
    f"sum(CASE WHEN {_IN(A.STANCE)} THEN 30 WHEN rule = 'EVIDENCE_STANCE_VIOLATION' THEN 20 ELSE 0 END) AS c, count(*) FILTER (fatal) AS nf, count(*) FILTER (NOT fatal) AS nw, string_agg(DISTINCT rule, '+' ORDER BY rule) AS rules, "
    f"bool_or({_IN(A.STRUCTURAL)}) AS b1, bool_or({_IN(A.APPEAL)}) AS b2, bool_or(rule = 'EVIDENCE_STANCE_VIOLATION') AS b3, bool_or({_IN(A.STANCE)}) AS b4 FROM f GROUP BY k), "
    "o AS (SELECT o_orderkey, (o_custkey % 101)::INT AS argument, CASE o_orderstatus WHEN 'O' THEN 'CONTRADICTED' WHEN 'P' THEN 'MIXED' END AS stance FROM orders), "
    "x AS (SELECT o_orderkey, argument, greatest(0, 100 - coalesce(s, 0))::INT AS structure, greatest(0, 100 - coalesce(e, 0))::INT AS evidence, greatest(0, 100 - coalesce(c, 0) - CASE stance WHEN 'CONTRADICTED' THEN 25 WHEN 'MIXED' THEN 10 ELSE 0 END)::INT AS consistency, coalesce(nf, 0) AS nf, coalesce(nw, 0) AS nw, coalesce(rules, '') AS suggestions, coalesce(b1, false) AS b1, coalesce(b2, false) AS b2, coalesce(b3, false) AS b3, coalesce(b4, false) AS b4 FROM o LEFT JOIN g ON k = o_orderkey) "
    "SELECT o_orderkey, structure, evidence, argument, consistency, CASE WHEN structure >= 85 THEN 'Excelente' WHEN structure >= 70 THEN 'Boa' WHEN structure >= 50 THEN 'Regular' ELSE 'Crítica' END AS structure_label, CASE WHEN evidence >= 85 THEN 'Excelente' WHEN evidence >= 70 THEN 'Boa' WHEN evidence >= 50 THEN 'Regular' ELSE 'Crítica' END AS evidence_label, "
    "floor((25 * structure + 25 * evidence + 30 * argument + 20 * consistency) / 100e0 + 0.5e0)::INT AS technical, CASE nf WHEN 0 THEN 100 WHEN 1 THEN 70 WHEN 2 THEN 40 ELSE 0 END AS viability, CASE nf WHEN 0 THEN 'VIAVEL' WHEN 1 THEN 'ATENCAO' WHEN 2 THEN 'RISCO_ELEVADO' ELSE 'CRITICA' END AS class, "
    "least(95, greatest(25, 80 - 15 * nf - 2 * nw))::INT AS quick_score, CASE WHEN consistency >= 80 THEN 'CONSISTENTE' WHEN consistency >= 50 THEN 'PARCIALMENTE CONSISTENTE' ELSE 'INCONSISTENTE' END AS consistent, "
    "concat_ws('+', CASE WHEN NOT b1 THEN 'structure' END, CASE WHEN NOT b2 THEN 'appeal' END, CASE WHEN NOT b3 THEN 'contrary_precedents' END, CASE WHEN NOT b4 THEN 'stance' END) AS strengths, suggestions FROM x",
)
def audit_report(spark: SparkSession, sf: str) -> DataFrame:
    """Orders as drafts, their lines as findings of the validators' rules."""
    rule = F.get(F.array(*map(F.lit, _RULES)), (F.col("l_partkey") % len(_RULES)).cast("int"))
    findings = read(spark, sf, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), rule.alias("rule"), (F.col("l_quantity") > 30).alias("fatal"))
    status = F.col("o_orderstatus")
    drafts = read(spark, sf, "orders").select("o_orderkey", (F.col("o_custkey") % 101).alias("richness"), F.when(status == "O", "CONTRADICTED").when(status == "P", "MIXED").alias("stance"))
    out = A.report(drafts, findings, "o_orderkey")
    return out.withColumns({c: F.array_join(c, "+") for c in ("strengths", "suggestions")})


#: What a text is by its own words, the first that is found.
PIECE = A.Ladder([
    (r"\b(?:raz[õo]es?\s+(?:de\s+)?recurs|recurs(?:o|ais?)\s+(?:inominado|ordin[aá]rio|de\s+apela[cç][aã]o|especial|extraordin[aá]rio|agrav|apelaç)|apela[cç][aã]o\s+c[íi]vel|agrav(?:o|ando)\s+(?:de\s+instrumento|regiment|regimental)|embargos?\s+(?:de\s+(?:declara[cç][aã]o|divergência)|infring))\b", "RECURSO"),
    (r"\b(?:decido|decisão\s+interlocut[oó]ria|E\s+o\s+relatório\.\s+Decido)\b", "DECISAO"),
    (r"\b(?:julgo\s+(?:procedente|improcedente|parcialmente)|condeno\s+o\s+(?:r[eé]u|executado)|absolvo\s+o\s+r[eé]u|DISPOSITIVO|defiro\s+(?:a\s+)?guarda|concedo\s+(?:a\s+)?guarda|fixo\s+(?:a\s+)?guarda\s+(?:unilateral|compartilhada)?)\b", "SENTENCA"),
    (r"\bdespacho\b", "DESPACHO"),
], "PETICAO_INICIAL")
REGIME = A.Ladder([
    (r"\b(?:RPPS|regime\s+pr[oó]prio|art\.?\s*40\s+(?:da\s+)?(?:CF|Constitui[cç][aã]o)|EC\s*41)\b", "RPPS"),
    (r"\b(?:RGPS|INSS|Lei\s+(?:n[.°º]?\s*)?8\.213|art\.?\s*201\s+(?:da\s+)?(?:CF|Constitui[cç][aã]o)|\bLOAS\b|previd[eê]ncia\s+social)\b", "RGPS"),
    (r"\b(?:CLT|CTPS|Reclamante|Reclamado|TRT\d?|TST|v[íi]nculo\s+empreg[ae]t[íi]cio)\b", "CLT"),
], "CIVIL")
JUSTICE = A.Ladder([
    (r"\b(?:juizado\s+especial\s+federal|JEF|lei\s+(?:n[.°º]?\s*)?10\.259)\b", "JEF"),
    (r"\b(?:juizado\s+especial\s+(?:c[íi]vel|criminal)|lei\s+(?:n[.°º]?\s*)?9\.099)\b", "JEC"),
    (r"\b(?:CLT|TRT\d?|TST|Reclamante)\b", "TRABALHO"),
    (r"\b(?:execu[cç][aã]o\s+fiscal|d[íi]vida\s+ativa|CDA)\b", "EXECUCAO_FISCAL"),
    (r"\b(?:crime|criminal|r[eé]u\s+(?:foi|está)|pena\s+de|art\.?\s*\d+.*?\bCP\b)\b", "CRIMINAL"),
    (r"\b(?:TRF\d?|Vara\s+(?:Federal|da\s+Justi[cç]a\s+Federal))\b", "FEDERAL"),
], "ESTADUAL")
BENEFIT = A.Ladder([(r"aux[íi]lio[-\s]doen[cç]a", "Benefício Previdenciário — Auxílio-doença"), (r"aposentadori", "Benefício Previdenciário — Aposentadoria"), (r"BPC|LOAS", "Benefício de Prestação Continuada")], "Benefício Previdenciário")
CIVIL_SUBJECT = A.Ladder([(r"execu[cç][aã]o|cumprimento\s+de\s+senten[cç]a|SISBAJUD", "Execução / Cumprimento de Sentença"), (r"consumidor|CDC|dano\s+moral|rela[cç][aã]o\s+de\s+consumo", "Direito do Consumidor")], "")
_PASSAGES = ["Recurso inominado ao JEF", "Decido. O INSS negou o auxílio-doença.", "Julgo procedente; reclamante no TRT2", "despacho no regime próprio", "execução fiscal da CDA", "consumidor e dano moral", "réu foi preso, art. 155 do CP", "Vara Federal, aposentadoria pela Lei 8.213", "apelação cível", "nada", "benefício LOAS no juizado especial cível"]


def _case(ladder: A.Ladder) -> str:
    return "CASE " + " ".join(f"WHEN regexp_matches(t, '{p}', 'i') THEN '{n}'" for p, n in ladder.steps) + f" ELSE '{ladder.default}' END"


@query(
    "heuristic_classes",
    f"WITH d AS (SELECT doc_id, coalesce(text, '') || chr(10) || {_PASSAGES}[(doc_id % {len(_PASSAGES)})::INT + 1] AS t FROM documents), c AS (SELECT doc_id, t, {_case(PIECE)} AS piece, {_case(REGIME)} AS regime, {_case(JUSTICE)} AS justice, {_case(BENEFIT)} AS benefit, {_case(CIVIL_SUBJECT)} AS civil FROM d) "
    "SELECT doc_id, piece, regime, justice, CASE WHEN regime = 'RPPS' THEN 'Regime Próprio de Previdência Social' WHEN regime = 'RGPS' THEN benefit WHEN regime = 'CLT' THEN 'Relação de Trabalho' WHEN civil <> '' THEN civil WHEN piece = 'RECURSO' THEN 'Recurso' ELSE 'Demanda Judicial' END AS subject FROM c",
)
def heuristic_classes(spark: SparkSession, sf: str) -> DataFrame:
    """Piece, regime, justice and subject of whole texts."""
    phrase = F.get(F.array(*map(F.lit, _PASSAGES)), (F.col("doc_id") % len(_PASSAGES)).cast("int"))
    docs = read(spark, sf, "documents").select("doc_id", F.concat(F.coalesce("text", F.lit("")), F.lit("\n"), phrase).alias("t"))
    return classify(docs, "t").drop("t")


def classify(docs: DataFrame, text: str) -> DataFrame:
    """`docs` with piece, regime, justice and subject by the words of a text; null counts as empty."""
    whole = F.coalesce(F.col(text), F.lit(""))
    t = F.col("_whole"), F.col("_lower")
    known = docs.withColumns({"_whole": whole, "_lower": F.lower(whole)}).withColumns({"piece": PIECE.of(*t), "regime": REGIME.of(*t), "justice": JUSTICE.of(*t)})
    civil = CIVIL_SUBJECT.of(*t)
    regime = F.col("regime")
    subject = F.when(regime == "RPPS", "Regime Próprio de Previdência Social").when(regime == "RGPS", BENEFIT.of(*t)).when(regime == "CLT", "Relação de Trabalho").when(civil != "", civil).when(F.col("piece") == "RECURSO", "Recurso")
    return known.withColumn("subject", subject.otherwise("Demanda Judicial")).drop("_whole", "_lower")


#: Descriptions that describe no case.
GENERIC = [r"pesquisa\s+livre", r"^teste\b", r"^modelo\b", r"^exemplo\b"]
_MODE = "CASE doc_id % 6 WHEN 0 THEN 'curto' WHEN 1 THEN ' Modelo de uma peça qualquer' WHEN 2 THEN 'uma Pesquisa  livre de precedentes' ELSE left(coalesce(text, ''), 200) END"


@query(
    "generation_modes",
    f"WITH d AS (SELECT doc_id, trim({_MODE}, chr(32) || chr(9) || chr(10) || chr(13) || chr(12) || chr(11)) AS t, (doc_id % 30) / 29e0 AS sure, CASE doc_id % 13 WHEN 0 THEN 'INDETERMINADA' WHEN 1 THEN NULL ELSE 'ESTADUAL' END AS justice, ['SUFICIENTE', 'PARCIAL', 'INSUFICIENTE', 'SUFICIENTE', NULL][(doc_id // 2 % 5)::INT + 1] AS q, doc_id // 3 % 5 AS a, doc_id // 5 % 4 AS b, doc_id // 7 % 4 AS c FROM documents) "
    "SELECT doc_id, CASE WHEN length(t) < 20 OR sure < 0.75 OR justice = 'INDETERMINADA' THEN 'SAFE_SKELETON' WHEN " + " OR ".join(f"regexp_matches(t, '{p}', 'i')" for p in GENERIC) + " THEN 'TEMPLATE_MODEL' WHEN q = 'INSUFICIENTE' THEN 'SAFE_SKELETON' WHEN q = 'PARCIAL' THEN 'TEMPLATE_MODEL' WHEN a >= 3 AND b >= 2 AND c >= 2 THEN 'POSSIBLE_FINAL_DRAFT' ELSE 'TEMPLATE_MODEL' END AS mode FROM d",
)
def generation_modes(spark: SparkSession, sf: str) -> DataFrame:
    """How far drafts can be written, by description, classification and extraction."""
    i = F.col("doc_id")
    at = lambda n, m: F.floor(i / n) % m
    quality = F.get(F.array(F.lit("SUFICIENTE"), F.lit("PARCIAL"), F.lit("INSUFICIENTE"), F.lit("SUFICIENTE"), F.lit(None)), at(2, 5).cast("int"))
    justice: Column = F.when(i % 13 == 0, "INDETERMINADA").when(i % 13 != 1, "ESTADUAL")
    mode = A.generation_mode(F.expr(_MODE), (i % 30) / 29, justice, quality, at(3, 5), at(5, 4), at(7, 4), GENERIC)
    return read(spark, sf, "documents").select("doc_id", mode.alias("mode"))
