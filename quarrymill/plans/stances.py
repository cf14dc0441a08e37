"""Queries of stance: claims against authorities and facts, contrary precedents in drafts, contexts of articles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrymill.operators import stance as S
from quarrymill.plans.catalog import query, read

#: Marks of claims, facts and authorities, without regard to case.
MARKS = S.Marks(
    distinguishing=r"\b(distinguishing|o\s+(?:presente\s+)?caso\s+(?:em\s+tela\s+)?(?:difere\s+do\s+precedente|apresenta\s+peculiaridade\s+que\s+o\s+distingue|é\s+distinto\s+do\s+paradigma)|hipótese\s+dos\s+autos\s+(?:difere|é\s+distinta)\s+(?:do\s+precedente|do\s+caso\s+paradigma)|situação\s+fática\s+(?:é\s+)?distinta\s+(?:do\s+precedente|do\s+caso)|peculiaridade\s+(?:fática|concreta)\s*[:—]\s*|inaplicabilidade\s+do\s+precedente\s+(?:ao\s+caso\s+concreto|pela\s+diferença\s+fática)|o\s+presente\s+(?:caso|processo)\s+(?:possui|apresenta|tem)\s+(?:peculiaridade|característica)\s+(?:fática\s+)?distinta\s+que)\b",
    subsidiary=r"\b(alternativamente|subsidiariamente|pedido\s+subsidiário|tese\s+subsidiária|em\s+caso\s+de\s+(?:não\s+)?(?:provimento|procedência)|ou,\s+caso\s+(?:assim|não)\s+(?:entenda|seja)|subsidiariamente\s+(?:requer|pede|pugna))\b",
    favorable=r"\b(faz\s+jus|tem\s+direito|deve\s+ser\s+(?:concedid[oa]|deferido|reconhecid[oa])|direito\s+reconhecido|procedência\s+(?:é\s+)?cabível|procedente|deve\s+ser\s+provido|procedência\s+do\s+pedido)\b",
)
#: Premises that defeat claims, in their order.
PREMISES = [
    S.Premise(
        "RPPS_PARIDADE_EC41",
        r"\b(paridade|integralidade)\b",
        r"EC\s*41.{0,150}(?:não\s+faz\s+jus|afasta|veda|impede|suprime|elimina|não\s+(?:tem|possui|assegura|garante)\s+direito).{0,80}(?:paridade|integralidade)"
        r"|sem\s+(?:paridade|integralidade)\s+pós[-\s]EC\s*41"
        r"|sem\s+(?:paridade|integralidade).{0,80}(?:EC\s*41|2003|ingressantes?\s+posteriores?)"
        r"|ingressou?.{0,100}(?:após|posterior|depois\s+d[ae]).{0,60}(?:EC\s*41|31\/12\/2003|dezembro\s+de\s+2003).{0,150}(?:sem\s+(?:direito|paridade)|não\s+faz\s+jus|paridade.{0,40}(?:afastada?|vedada?|não\s+(?:é\s+)?devida?))"
        r"|(?:EC\s*41|emenda\s+constitucional\s+41).{0,80}(?:paridade|integralidade).{0,80}(?:afastada?|vedada?|suprimida?|extinta?|não\s+(?:é\s+)?(?:devida?|garantida?|assegurada?))"
        r"|(?:paridade|integralidade).{0,100}(?:afastada?|vedada?|suprimida?|extinta?).{0,80}(?:EC\s*41|emenda\s+constitucional\s+41)"
        r"|não\s+faz\s+jus\s+(?:à|a)\s+(?:paridade|integralidade)",
    ),
    S.Premise(
        "RGPS_PERDA_QUALIDADE_SEGURADO",
        r"\b(auxílio|aposentadoria|benefício|pensão\s+por\s+morte|salário-maternidade)\b",
        r"perdeu?\s+(?:a\s+)?qualidade\s+de\s+segurado"
        r"|sem\s+qualidade\s+de\s+segurado"
        r"|não\s+(?:mantinha|manteve)\s+(?:a\s+)?qualidade\s+de\s+segurado"
        r"|período\s+de\s+graça.{0,80}(?:expirou|encerrou|findou|venceu|esgotou|(?:já\s+)?(?:está|estava)\s+(?:expirado|encerrado|vencido|esgotado))"
        r"|(?:expirou|encerrou|findou|venceu|esgotou).{0,80}período\s+de\s+graça"
        r"|última\s+contribuição.{0,120}(?:há\s+(?:mais\s+de\s+)?\d+\s+meses|em\s+\d{4}|já\s+faz\s+(?:mais\s+de\s+)?\d+\s+meses)"
        r"|sem\s+(?:recolhimento|contribuição)\s+(?:há|por)\s+(?:mais\s+de\s+)?\d+\s+(?:meses|anos)"
        r"|ausência\s+de\s+recolhimentos?\s+(?:por|há)\s+(?:mais\s+de\s+)?\d+\s+(?:meses|anos)"
        r"|há\s+mais\s+de\s+\d+\s+meses\s+sem\s+(?:recolhimento|contribuição)"
        r"|carência\s+(?:não\s+)?(?:insuficiente|não\s+(?:cumprida|implementada|atingida|completada))"
        r"|não\s+cumpri[ou]\s+(?:a\s+)?(?:carência|período\s+de\s+carência)"
        r"|faltam.{0,60}(?:contribuições?|meses\s+de\s+carência)\s+para"
        r"|carência\s+de\s+(?:cento\s+e\s+oitenta|180)\s+meses.{0,80}(?:não\s+(?:atingida|cumprida|implementada))"
        r"|(?:180|cento\s+e\s+oitenta)\s+contribuições?.{0,80}(?:não\s+atingiu?|insuficiente)",
    ),
    S.Premise(
        "RGPS_CARENCIA_INSUFICIENTE",
        r"\b(auxílio|aposentadoria|salário-maternidade|benefício\s+previdenciário)\b",
        r"carência\s+(?:insuficiente|não\s+(?:cumprida|implementada|atingida))|não\s+cumpri[ou]\s+(?:a\s+)?carência|período\s+de\s+carência.{0,80}(?:não\s+)?(?:implementado|cumprido|completado)|faltam.{0,40}(?:contribuições?|meses)\s+para\s+a\s+carência",
    ),
    S.Premise(
        "JEF_VALOR_EXCEDE_COMPETENCIA",
        r"\b(juizado\s+especial|JEF|JEC|rito\s+sumar[íi]ssimo)\b",
        r"\b(acima\s+de\s+(?:40|60)\s+salários?\s+mínimos?|excede\s+(?:o\s+)?(?:limite|teto)\s+(?:de\s+competência\s+)?do\s+juizado|valor\s+excede\s+(?:a\s+)?competência|superior\s+ao?\s+limite\s+do\s+juizado|sem\s+renúncia\s+ao\s+excedente)\b",
    ),
    S.Premise(
        "JEF_MATERIA_EXCLUIDA",
        r"\b(juizado\s+especial|JEF|JEC)\b",
        r"\b(excluído?\s+(?:da\s+)?competência\s+do\s+juizado|incompetência\s+do\s+juizado|matéria\s+excluída?\s+(?:do|da\s+competência\s+do)\s+juizado|art\.\s*3[oº]\s+§\s*2[oº]|imóvel\s+(?:rústico|urbano).{0,60}juizado|não\s+(?:é|está)\s+(?:no\s+)?rol\s+das\s+(?:causas|matérias)\s+(?:do|aceitas?\s+pelo)\s+juizado)\b",
    ),
]
#: What distinguishes a contrary precedent, and what rests a rejection on it.
STRONG = r"\b(distinguishing|distingue[\s-]se|distinguindo-se|a\s+hipótese\s+dos\s+autos\s+(?:difere|é\s+distinta)|não\s+se\s+aplic[ao]\s+(?:ao\s+caso|aqui|à\s+hipótese)|(?:o\s+)?precedente\s+(?:foi\s+)?superado|superado[ao]?\s+(?:o\s+)?(?:entendimento|precedente)|não\s+guarda\s+identidade\s+com|inaplicável\s+(?:ao\s+caso|à\s+hipótese|aqui)|situação\s+fática\s+distinta|peculiaridade\s+(?:do\s+caso|fática)|caso\s+concreto\s+(?:difere|é\s+distinto\s+do\s+paradigma)|regras?\s+de\s+transição|ingresso\s+(?:anterior|antes)\s+(?:à|à\s+vigência|da\s+promulgação)|ingressou\s+antes|legislação\s+(?:local|estadual|municipal)\s+específica|hipótese\s+(?:dos\s+autos\s+)?(?:difere|é\s+distinta|não\s+se\s+amolda)|distinguível\s+do\s+precedente|precedente\s+(?:não\s+(?:é\s+)?aplicável|inaplicável))\b"
REJECTION = r"\b(?:não\s+(?:faz\s+jus|tem\s+direito|possui\s+direito|merece\s+(?:prosperar|acolhida)|há\s+(?:direito|amparo))|julgo\s+improcedente|improcedente|indefiro\s+o\s+pedido|nego\s+provimento|denego\s+a?\s*ordem|deve\s+ser\s+(?:negado|indeferido|julgado\s+improcedente)|sem\s+(?:direito|paridade|integralidade|amparo\s+legal)|razão\s+pela\s+qual.*?(?:improcede|indefiro|nego))\b"
#: Markers that an article sets regimes apart, and that a request rests on it.
DISTINCTION = [r"não\s+se\s+confunde", r"distingue-se", r"diferentemente", r"ao\s+contrário", r"regime\s+distinto", r"não\s+se\s+aplica", r"enquanto\s+(o\s+)?(art\.|regime)", r"diversamente", r"em\s+oposição", r"rpps", r"rgps", r"regime\s+próprio", r"regime\s+geral"]
DIRECT = [
    r"com\s+fundamento\s+no\s+art\.\s*\d+", r"nos\s+termos\s+do\s+art\.\s*\d+", r"assegurado\s+pelo\s+art\.\s*\d+", r"amparado\s+pelo\s+art\.\s*\d+", r"previsto\s+no\s+art\.\s*\d+",
    r"faz\s+jus.*nos\s+termos\s+do\s+art\.\s*\d+", r"direito\s+(à|a)\s+.*art\.\s*\d+", r"conforme\s+(o\s+)?art\.\s*\d+", r"pleiteia.*art\.\s*\d+",
]

_CLAIMS = ["pede paridade", "requer aposentadoria e paridade no JEF", "benefício, subsidiariamente auxílio", "aposentadoria: o presente caso difere do precedente", "sem tese", "rito sumaríssimo no juizado especial", "pensão por morte"]
_AUTHORITIES = ["não faz jus à paridade", "A EC 41 veda toda paridade", "perdeu a qualidade de segurado", "carência não cumprida", "o autor faz jus ao pedido", "procedência do pedido", "sem renúncia ao excedente", "incompetência do juizado", "nada", "há mais de 14 meses sem contribuição", "outra coisa"]
_FACTS = ["ingressou após a EC 41, sem direito", "período de graça que expirou", "nada consta", "hipótese dos autos difere do precedente", "faltam 3 contribuições para a carência, acima de 60 salários mínimos"]


def _phrase(phrases: list[str]) -> str:
    return "[" + ", ".join("'" + p + "'" for p in phrases) + f"][(doc_id % {len(phrases)})::INT + 1]"


def _with(docs: DataFrame, phrases: list[str]) -> F.Column:
    """The whole text, and one of the phrases by the id."""
    return F.concat(F.coalesce("text", F.lit("")), F.lit("\n"), F.get(F.array(*map(F.lit, phrases)), (F.col("doc_id") % len(phrases)).cast("int")))


_HIT = lambda t, p: f"regexp_matches({t}, '{p}', 'i')"
_MASK = lambda t, ps: "(" + " | ".join(f"CASE WHEN {_HIT(t, p)} THEN {1 << i} ELSE 0 END" for i, p in enumerate(ps)) + ")::BIGINT"
_TEXT = lambda phrases: f"coalesce(text, '') || chr(10) || {_phrase(phrases)}"


@query(
    "stance_analysis",
    f"WITH c AS (SELECT doc_id AS k, {_TEXT(_CLAIMS)} AS t FROM documents), a AS (SELECT doc_id - doc_id % 3 AS k, {_TEXT(_AUTHORITIES)} AS t FROM documents), e AS (SELECT doc_id - doc_id % 4 AS k, doc_id AS pos, {_TEXT(_FACTS)} AS t FROM documents), "
    f"cm AS (SELECT k, {_MASK('t', [p.claim for p in PREMISES])} AS m, {_HIT('t', MARKS.distinguishing)} AS own, {_HIT('t', MARKS.subsidiary)} AS subsidiary FROM c), "
    f"am AS (SELECT k, bit_or({_MASK('t', [p.contrary for p in PREMISES])}) AS m, max({_HIT('t', MARKS.favorable)}::INT) AS fav FROM a GROUP BY k), "
    f"ef AS (SELECT k, pos, {_MASK('t', [p.contrary for p in PREMISES])} AS m, {_HIT('t', MARKS.distinguishing)} AS differs FROM e), "
    "em AS (SELECT ef.k, pos, differs, (ef.m & cm.m) & -(ef.m & cm.m) AS hit FROM ef JOIN cm USING (k)), "
    "eg AS (SELECT k, bit_or(hit) AS m, arg_min(hit, pos) FILTER (hit > 0) AS first, bool_or(differs) AS differs FROM em GROUP BY k), "
    "j AS (SELECT cm.k, coalesce(am.m & cm.m, 0) AS a, coalesce(eg.m, 0) AS e, coalesce(fav, 0) > 0 AS fav, first, own OR coalesce(differs, false) AS distinguishing, subsidiary FROM cm LEFT JOIN am USING (k) LEFT JOIN eg USING (k)), "
    "r AS (SELECT *, bit_count(a | e)::INT AS n, CASE WHEN a > 0 THEN a & -a ELSE first END AS lead FROM j), "
    "s AS (SELECT *, CASE WHEN n = 0 AND fav THEN 'SUPPORTED' WHEN n = 0 THEN 'UNKNOWN' WHEN n = 1 AND fav THEN 'MIXED' ELSE 'CONTRADICTED' END AS result FROM r), b AS (SELECT *, result = 'CONTRADICTED' AND NOT distinguishing AND NOT subsidiary AS block FROM s) "
    f"SELECT k AS doc_id, result, CASE WHEN n = 0 AND fav THEN 0.65e0 WHEN n = 0 THEN 0.3e0 WHEN n = 1 AND fav THEN 0.6e0 WHEN n > 1 THEN 0.92e0 ELSE 0.8e0 END AS confidence, n AS contradictions, CASE WHEN block THEN {[p.name for p in PREMISES]}[log2(lead)::INT + 1] END AS premise, block, distinguishing, subsidiary FROM b",
)
def stance_analysis(spark: SparkSession, sf: str) -> DataFrame:
    """Each document as a claim, with authorities and facts of its case; some cases have several, some none."""
    docs = read(spark, sf, "documents")
    i = F.col("doc_id")
    claims = docs.select("doc_id", _with(docs, _CLAIMS).alias("text"))
    authorities = docs.select((i - i % 3).alias("doc_id"), _with(docs, _AUTHORITIES).alias("text"))
    evidence = docs.select((i - i % 4).alias("doc_id"), i.alias("pos"), _with(docs, _FACTS).alias("text"))
    return S.analyze(claims, authorities, evidence, PREMISES, MARKS, "doc_id")


_DRAFTS = ["Conforme o processo P-{0}-X, o direito é reconhecido.", "A hipótese dos autos difere do processo P-{0}-X.", "Nos autos p-{0}-x se assentou que não há amparo; denego a ordem.", "Segundo o TRF{1}, o direito existe.", "sem citação"]


def _draft_sql() -> str:
    phrases = ["'" + p.replace("{0}", "' || (doc_id % 40) || '").replace("{1}", "' || (doc_id % 5) || '") + "'" for p in _DRAFTS]
    return "coalesce(text, '') || chr(10) || [" + ", ".join(phrases) + f"][(doc_id % {len(_DRAFTS)})::INT + 1] || chr(10) || left(coalesce(text, ''), 500)"


@query(
    "evidence_stance",
    f"WITH d AS (SELECT source, doc_id, {_draft_sql()} AS t FROM documents), p AS (SELECT 'src' || (item_id % 20) AS source, item_id AS id, 'P-' || item_id || '-X' AS number, CASE WHEN item_id % 7 = 0 THEN 'TR' ELSE 'TRF' || (item_id % 5) END AS court FROM benchmark WHERE item_id % 3 <> 1), "
    "x AS (SELECT doc_id, id, t, CASE WHEN contains(lower(t), lower(number)) THEN strpos(lower(t), lower(number)) WHEN length(court) >= 3 THEN strpos(lower(t), lower(court)) ELSE 0 END AS pos FROM d JOIN p USING (source)), "
    "w AS (SELECT doc_id, id, substr(t, greatest(1, pos - 600), least(600, pos - 1) + 400) AS w FROM x WHERE pos > 0) "
    f"SELECT doc_id, id, CASE WHEN {_HIT('w', STRONG)} THEN 2 WHEN {_HIT('w', REJECTION)} THEN 1 ELSE 0 END AS score FROM w",
)
def evidence_stance(spark: SparkSession, sf: str) -> DataFrame:
    """Contrary precedents of a source that its drafts cite: by number, else by court."""
    docs, i = read(spark, sf, "documents"), F.col("doc_id")
    phrases = [F.replace(F.replace(F.lit(p), F.lit("{0}"), (i % 40).cast("string")), F.lit("{1}"), (i % 5).cast("string")) for p in _DRAFTS]
    text = F.coalesce("text", F.lit(""))
    drafts = docs.select("source", i.alias("draft"), F.concat(text, F.lit("\n"), F.get(F.array(*phrases), (i % len(_DRAFTS)).cast("int")), F.lit("\n"), F.substring(text, 1, 500)).alias("text"))
    k = F.col("item_id")
    precedents = read(spark, sf, "benchmark").select(
        F.concat(F.lit("src"), (k % 20).cast("string")).alias("source"), k.alias("id"), F.concat(F.lit("P-"), k.cast("string"), F.lit("-X")).alias("number"),
        F.when(k % 7 == 0, "TR").otherwise(F.concat(F.lit("TRF"), (k % 5).cast("string"))).alias("court"), F.when(k % 3 == 1, "FAVORAVEL").otherwise("CONTRARIO").alias("stance"),
    )
    return S.misused(drafts, precedents, STRONG, REJECTION, "source").withColumnRenamed("draft", "doc_id")


_ARTICLES = ["faz jus nos termos do art. 201 da CF/88", "o RPPS não se confunde com o art. 201 CF", "art. 201 da Constituição", "com fundamento no art. 40 CF", "nada", "Diferentemente do art. 201 CF, nos termos do art. 40 da CF"]


@query("article_contexts")
def article_contexts(spark: SparkSession, sf: str) -> DataFrame:
    """How texts cite two articles; SQL has no windows around matches."""
    docs = read(spark, sf, "documents")
    texts = docs.select("doc_id", _with(docs, _ARTICLES).alias("t"))
    return texts.select("doc_id", *[S.article_context(F.col("t"), a, DISTINCTION, DIRECT).alias(f"article_{a}") for a in ("40", "201")])
