"""Queries over texts: classifiers, dates, numbers, addresses, masking, style and citations.

The driver's texts are invented, so phrases that the patterns know are joined to whole texts where a pattern would find nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrymill.functions import text as T
from quarrymill.plans.catalog import FOLD, query, read

PHRASES = [
    "execução fiscal de icms", "aposentadoria por invalidez no inss", "rescisão com horas extras", "habeas corpus por tráfico", "improbidade administrativa e DIREITO PENAL", "dano ambiental", "divórcio e guarda, direito civil",
    "PROCESSUAL CIVIL. TRIBUTÁRIO. Julgo parcialmente procedente. Cumpre destacar, cumpre destacar.", "Defiro o pedido. Pede deferimento.", "art. 5 da lei n. 8.213 c/c Art. 5, Súmula 7, CPC/2015, STF e STJ", "nada",
    "houve condenação", "a procedência do pedido", "improcedência", "absolvição, data maxima venia, nobre julgador", "segurança denegada", "art. 485 do CPC", "homologação de transação, patente que resta demonstrado", "art. 5 e art. 5-A e art. 5º-B, douto juízo",
]
_PHRASES_SQL = "[" + ", ".join("'" + p.replace("'", "''") + "'" for p in PHRASES) + "]"
_JOINED = f"SELECT doc_id, coalesce(text, '') || ' ' || {_PHRASES_SQL}[(doc_id % {len(PHRASES)})::INT + 1] AS t FROM documents"


def _joined(spark: SparkSession, sf: str) -> DataFrame:
    phrase = F.get(F.array(*map(F.lit, PHRASES)), (F.col("doc_id") % len(PHRASES)).cast("int"))
    return read(spark, sf, "documents").select("doc_id", F.concat(F.coalesce("text", F.lit("")), F.lit(" "), phrase).alias("t"))


def _lowered(spark: SparkSession, sf: str) -> DataFrame:
    """Lower-cased once: the patterns read a column."""
    return _joined(spark, sf).select("doc_id", F.lower("t").alias("t"))


def _first_sql(text: str, patterns: list[tuple[str, str]], default: str) -> str:
    return "CASE " + " ".join(f"WHEN regexp_matches({text}, '{p}') THEN '{n}'" for p, n in patterns) + f" ELSE {default} END"


#: Areas by the first pattern that a lower-cased text has.
AREAS = [
    (r"tribut|fiscal|imposto|icms|iss\b|ipi\b|iof\b|iptu|ipva|pis\b|cofins|csll|irpj|irpf|\btaxa\b|execu.{1,5}fiscal|cr.dito tribut", "TRIBUTARIO"),
    (r"previd.n|aposentadori|inss|benef.cio previd|pens.o por morte|aux.lio.doen|incapacidade|invalide|segurado especial|acidente.*trabalho|bpc\b|loas\b", "PREVIDENCIARIO"),
    (r"trabalhist|v.nculo empregat|horas extras|sal.rio|rescis.o|fgts|clt\b|sindicato|insalubrid|periculosid|jornada|intervalo intrajornada|equipara..o salarial", "TRABALHISTA"),
    (r"\bpenal\b|crime|delito|\bréu\b|pris.o|habeas corpus|tr.fico|roubo|furto|homic.dio|esteli|corrup..o|peculato|lavagem|execu..o penal|liberdade condicional", "CRIMINAL"),
    (r"administrativo|licita..o|contrato admin|servidor p.blico|concurso p.blico|improbidade|desapropria..o|responsabilidade.*estado|concess.o|regula..o", "ADMINISTRATIVO"),
    (r"ambiental|meio ambiente|polui..o|desmatamento|licen.a ambiental|.rea de prote..o|reserva legal|dano ambiental", "AMBIENTAL"),
    (r"\bcivil\b|fam.lia|div.rcio|alimentos|guarda|invent.rio|heran.a|responsabilidade civil|dano moral|loca..o|usucapi.o|ado..o|uni.o est.vel", "CIVIL"),
]


@query("area_classify", f"WITH j AS ({_JOINED}), l AS (SELECT doc_id, lower(t) AS t FROM j) SELECT doc_id, {_first_sql('t', AREAS, chr(39) + 'OUTRO' + chr(39))} AS area FROM l")
def area_classify(spark: SparkSession, sf: str) -> DataFrame:
    return _lowered(spark, sf).select("doc_id", T.first_match(F.col("t"), AREAS, "OUTRO").alias("area"))


#: Branches by the words that a folded, upper-cased text has; several may hold.
BRANCHES = [
    ("PROCESSUAL PENAL|EXECUCAO PENAL", "Processual Penal"), ("DIREITO PENAL", "Penal"), ("PROCESSUAL CIVIL", "Processual Civil"), ("TRIBUTAR", "Tributario"), ("PREVIDENCI", "Previdenciario"), ("TRABALH", "Trabalho"),
    ("ADMINISTRAT|IMPROBIDADE|URBANIST", "Administrativo"), ("CONSTITUCION", "Constitucional"), ("CONSUMIDOR", "Consumidor"), ("EMPRESARIAL|FALIMENTAR|BANCAR|SOCIETAR", "Empresarial"), ("AMBIENT", "Ambiental"),
    ("INTERNACIONAL|DIREITOS HUMANOS", "Internacional"), ("ELEITORAL", "Eleitoral"), ("DIREITO CIVIL|FAMILIA|SUCESSO|CRIANCA E DO ADOLESCENTE", "Civil"),
]
_PENAL_SQL = "regexp_matches(t, 'DIREITO PENAL') OR (t LIKE '% PENAL%' AND NOT regexp_matches(t, 'PROCESSUAL PENAL|EXECUCAO PENAL'))"


@query(
    "branch_multilabel",
    f"WITH j AS ({_JOINED}), u AS (SELECT doc_id, upper({FOLD.format('t')}) AS t FROM j), b AS (SELECT doc_id, list_filter([" + ", ".join(f"CASE WHEN {_PENAL_SQL if n == 'Penal' else f'regexp_matches(t, {chr(39)}{p}{chr(39)})'} THEN '{n}' END" for p, n in BRANCHES) + "], lambda x: x IS NOT NULL) AS b FROM u) "
    "SELECT doc_id, CASE WHEN len(b) = 0 THEN 'Outros' ELSE array_to_string(b, '; ') END AS branches FROM b",
)
def branch_multilabel(spark: SparkSession, sf: str) -> DataFrame:
    t = F.col("t")
    penal = T.found(t, "DIREITO PENAL") | (t.contains(" PENAL") & ~T.found(t, "PROCESSUAL PENAL|EXECUCAO PENAL"))
    found = F.array_compact(F.array(*[F.when(penal if n == "Penal" else T.found(t, p), n) for p, n in BRANCHES]))
    folded = _joined(spark, sf).select("doc_id", F.upper(T.fold(F.col("t"))).alias("t"))
    return folded.select("doc_id", found.alias("b")).select("doc_id", F.when(F.size("b") == 0, "Outros").otherwise(F.array_join("b", "; ")).alias("branches"))


#: What a decision decides, the first pattern that a lower-cased text has.
OUTCOMES = [
    (r"\bconcedo\s+(?:a\s+)?ordem\b|\bconceder\s+(?:a\s+)?ordem\b|\bhc\s+concedido\b|\border\s+concedida\b", "CONCEDO_ORDEM"),
    (r"\bdenego\s+(?:a\s+)?(?:ordem|seguran[cç]a)\b|\bdenegar\s+(?:a\s+)?(?:ordem|seguran[cç]a)\b|\bhc\s+denegado\b|\border\s+denegada\b|\bseguran[cç]a\s+denegada\b", "DENEGO_ORDEM"),
    (r"\bcondeno\b|\bcondenar\b|\bcondena[cç][aã]o\b", "CONDENO"),
    (r"\babsolvo\b|\babsolver\b|\babsolvendo\b|\babsolvição\b", "ABSOLVO"),
    (r"\bindefiro\b|\bindeferido\b|\bindefiro\s+o\s+pedido\b", "INDEFIRO"),
    (r"\bdefiro\b|\bdeferido\b|\bdefiro\s+o\s+pedido\b", "DEFIRO"),
    (r"extinguir?\s+sem\s+resolu[cç][aã]o|extinto\s+sem\s+(?:resolu[cç][aã]o|m[eé]rito)|extin[cç][aã]o\s+sem\s+(?:resolu[cç][aã]o|m[eé]rito)|julgar\s+extinto\s+sem\b|art\.?\s*485\s+(?:do\s+)?cpc", "EXTINCAO_SEM_RESOLUCAO"),
    (r"\bhomolog(?:ar|a[cç][aã]o)\s+(?:d[oae]\s+)?acordo\b|\bhomolog(?:ar|a[cç][aã]o)\s+(?:d[oae]\s+)?transa[cç][aã]o\b|\bhomologar\s+o?\s*acordo\b", "HOMOLOGACAO"),
    (r"\bparcialmente\s+procedente\b|\bprocedente\s+em\s+parte\b|\bprocedência\s+parcial\b", "PARCIALMENTE_PROCEDENTE"),
    (r"\bimprocedente\b|\bimprocedência\b|\bimprocedentes?\b|\bjulgar\s+improcedente\b|\bsentença\s+de\s+improcedência\b", "IMPROCEDENTE"),
    (r"\bprocedente\b|\bprocedência\b|\bjulgar\s+procedente\b|\bsentença\s+de\s+procedência\b", "PROCEDENTE"),
]


@query("outcome_extract", f"WITH j AS ({_JOINED}), l AS (SELECT doc_id, lower(t) AS t FROM j) SELECT doc_id, {_first_sql('t', OUTCOMES, 'NULL')} AS outcome FROM l")
def outcome_extract(spark: SparkSession, sf: str) -> DataFrame:
    return _lowered(spark, sf).select("doc_id", T.first_match(F.col("t"), OUTCOMES, None).alias("outcome"))


#: Phrases that cost 10 points once, and 5 for each repetition.
BANNED = [
    "vem, respeitosamente", "vem perante vossa excelência", "vem à presença de vossa excelência", "vem a presença de vossa excelência", "data maxima venia", "nobre julgador", "douto juízo",
    "merece prosperar", "não merece prosperar", "patente que", "resta demonstrado", "resta comprovado", "conforme amplamente demonstrado", "diante do exposto, requer", "ante o exposto, requer",
    "pelo exposto, requer", "requer-se", "termos em que,", "termos em que", "pede deferimento", "pede deferimento.",
]
REPETITIVE = ["cumpre destacar", "cumpre observar", "cumpre registrar", "importa destacar", "importa salientar", "vale destacar", "vale ressaltar", "nesse contexto", "nesse sentido"]


@query(
    "style_lint",
    f"WITH j AS ({_JOINED}), l AS (SELECT doc_id, lower(t) AS t FROM j) SELECT doc_id, greatest(0, 100 - 10 * ("
    + " + ".join(f"contains(t, '{p}')::INT" for p in BANNED)
    + ") - 5 * ("
    + " + ".join(f"greatest(0, ((length(t) - length(replace(t, '{p}', ''))) // {len(p)})::INT - 1)" for p in REPETITIVE)
    + "))::INT AS score FROM l",
)
def style_lint(spark: SparkSession, sf: str) -> DataFrame:
    t = F.col("t")
    banned = sum((t.contains(p).cast("int") for p in BANNED), F.lit(0))
    repeated = sum((F.greatest(F.lit(0), T.occurrences(t, p) - 1) for p in REPETITIVE), F.lit(0))
    return _joined(spark, sf).select("doc_id", F.lower("t").alias("t")).select("doc_id", F.greatest(F.lit(0), 100 - 10 * banned - 5 * repeated).cast("int").alias("score"))


#: Courts, precedents and norms that a text cites.
COURTS = [r"\bSTF\b", r"\bSTJ\b", r"\bTST\b", r"\bTNU\b", r"\bTRF\b", r"\bTJ[A-Z]{2}\b", r"\bTRT\b"]
PRECEDENTS = r"tema\s+(?:stf|stj)\s+[0-9]+|resp\.?\s*[0-9./]+|re\s+[0-9./]+|súmula\s+(?:n[.°º]?\s*)?[0-9]+|eresp\.?\s*[0-9./]+"
ARTICLES = r"art(?:igo)?\.\s*[0-9]+[\w\-º°]*"
LAWS = [r"lei\s+(?:n[.°º]?\s*)?[0-9][0-9.,/]*", r"decreto[\s-]lei\s+n[.°º]?\s*[0-9]+", r"ec\s+[0-9]+/[0-9]+|emenda\s+constitucional\s+n[.°º]?\s*[0-9]+", r"\bcpc/[0-9]{4}|\bcf/[0-9]{2}\b|\bcdc\b"]


@query(
    "citation_counts",
    f"WITH j AS ({_JOINED}), l AS (SELECT doc_id, t, lower(t) AS w FROM j), c AS (SELECT doc_id, "
    + " + ".join(f"regexp_matches(t, '{p}')::INT" for p in COURTS)
    + f" AS courts, len(list_distinct(regexp_extract_all(w, '{PRECEDENTS}'))) AS precedents, len(list_distinct(list_transform(regexp_extract_all(w, '{ARTICLES}'), lambda x: regexp_replace(x, '\\s', '', 'g')))) AS articles, "
    + "len(list_distinct(list_transform(list_concat(" + ", ".join(f"regexp_extract_all(w, '{p}')" for p in LAWS) + "), lambda x: regexp_replace(x, '\\s', '', 'g')))) AS laws FROM l) "
    "SELECT doc_id, courts::INT AS courts, precedents::INT AS precedents, (articles + laws)::INT AS norms, CASE WHEN articles + laws >= 8 THEN 20 WHEN articles + laws >= 5 THEN 15 WHEN articles + laws >= 3 THEN 10 WHEN articles + laws >= 1 THEN 5 ELSE 0 END AS norm_score FROM c",
)
def citation_counts(spark: SparkSession, sf: str) -> DataFrame:
    """Distinct courts, precedents and norms, and a score of norms in four steps."""
    t, w = F.col("t"), F.col("w")
    none = F.array().cast("array<string>")
    found = lambda p: F.when(T.found(w, p), F.regexp_extract_all(w, F.lit(T.ascii_edges(p)), F.lit(0))).otherwise(none)
    packed = lambda a: F.size(F.array_distinct(F.transform(a, lambda x: F.regexp_replace(x, r"\s", ""))))
    courts = sum((T.found(t, p).cast("int") for p in COURTS), F.lit(0))
    counts = _joined(spark, sf).select("doc_id", "t", F.lower("t").alias("w")).select("doc_id", courts.alias("courts"), F.size(F.array_distinct(found(PRECEDENTS))).alias("precedents"), (packed(found(ARTICLES)) + packed(F.concat(*map(found, LAWS)))).alias("norms"))
    return counts.withColumn("norm_score", T.tiered(F.col("norms"), [1, 3, 5, 8], [0.25, 0.5, 0.75, 1], 20))


@query("slug_tags", "WITH s AS (SELECT doc_id, trim(regexp_replace(" + FOLD.format("string_split(text, chr(10))[1]") + ", '[^a-z0-9]+', '_', 'g'), '_') AS s FROM documents) SELECT doc_id, CASE WHEN length(s) < 2 THEN '' ELSE left(s, 40) END AS slug FROM s")
def slug_tags(spark: SparkSession, sf: str) -> DataFrame:
    """The first line of each text, whole, as a tag."""
    return read(spark, sf, "documents").select("doc_id", T.slug(F.get(F.split("text", "\n"), 0)).alias("slug"))


@query(
    "tag_lists",
    "WITH p AS (SELECT doc_id, string_split_regex(lang || ';' || source || '|' || lang || '; X ;Área Fiscal', '[;|]+') AS p FROM documents), s AS (SELECT doc_id, list_transform(p, lambda x: left(trim(regexp_replace(lower(strip_accents(x)), '[^a-z0-9]+', '_', 'g'), '_'), 40)) AS s FROM p) "
    "SELECT doc_id, unnest(list_filter(s, lambda x, i: length(x) >= 2 AND list_position(s, x) = i)) AS tag FROM s",
)
def tag_lists(spark: SparkSession, sf: str) -> DataFrame:
    tags = T.tags([F.concat(F.col("lang"), F.lit(";"), F.col("source"), F.lit("|"), F.col("lang")), F.lit(" X ;Área Fiscal")])
    return read(spark, sf, "documents").select("doc_id", F.explode(tags).alias("tag"))


def _masked_sql(text: str) -> str:
    for pattern, name in T.PERSONAL:
        text = f"regexp_replace({text}, '{pattern}', '{name}', 'g')"
    return text


_NUMBERS = "CASE o_orderkey % 4 WHEN 0 THEN 'cpf 123.456.789-09 rg 1.234.567-x' WHEN 1 THEN 'nb 123.456.789-0' WHEN 2 THEN 'autos 0001234-56.2020.4.03.6100' ELSE '2001.61.000123-4' END"


@query("pii_mask", f"WITH d AS (SELECT doc_id AS id, {_masked_sql('text')} AS t FROM documents UNION ALL SELECT -1 - o_orderkey, {_masked_sql('o_orderkey || chr(32) || (' + _NUMBERS + ')')} FROM orders) SELECT id, trim(left(t, 120), chr(32) || chr(9) || chr(10) || chr(13)) AS masked FROM d")
def pii_mask(spark: SparkSession, sf: str) -> DataFrame:
    """Snippets of all texts, and of lines with numbers of each kind."""
    k = F.col("o_orderkey")
    numbers = F.concat(k.cast("string"), F.lit(" "), F.expr(_NUMBERS))
    return read(spark, sf, "documents").select(F.col("doc_id").alias("id"), "text").unionByName(read(spark, sf, "orders").select((-1 - k).alias("id"), numbers.alias("text"))).select("id", T.mask_personal(F.col("text")).alias("masked"))


_HTML = "replace(replace(coalesce(html, ''), chr(13) || chr(10), chr(10)), chr(13), chr(10))"
for _name, _char in (("&copy;", "©"), ("&middot;", "·"), ("&quot;", '"'), ("&amp;", "&")):
    _HTML = f"replace({_HTML}, '{_name}', '{_char}')"
for _pattern, _to in ((r"(?i)<br\s*/?>", "chr(10)"), (r"(?i)</(p|div|li|tr|h[0-9]|section|article)>", "chr(10)"), (r"(?i)<li[^>]*>", "'- '"), ("<[^>]+>", "''"), (r"\n{3,}", "chr(10) || chr(10)")):
    _HTML = f"regexp_replace({_HTML}, '{_pattern}', {_to}, 'g')"


@query("html_to_text", f"SELECT page_id, md5(trim(replace(regexp_replace({_HTML}, '&amp($|[^;])', '&\\1', 'g'), chr(0), ''), chr(32) || chr(9) || chr(10) || chr(13) || chr(12) || chr(11))) AS text_md5 FROM pages")
def html_to_text(spark: SparkSession, sf: str) -> DataFrame:
    return read(spark, sf, "pages").select("page_id", F.md5(F.encode(T.html_to_text(F.col("html")), "UTF-8")).alias("text_md5"))


_LINKS = "['', '//' || url, ' ' || url, '/a/' || page_id, 'b/c', 'mailto:x@y', 'HTTPS://z']"


@query(
    "url_normalize",
    f"WITH l AS (SELECT page_id, trim(unnest({_LINKS})) AS v FROM pages) SELECT page_id, v AS raw, CASE WHEN v = '' THEN '' WHEN starts_with(v, '//') THEN 'https:' || v WHEN regexp_matches(v, '(?i)^https?://') THEN v WHEN starts_with(v, '/') THEN 'https://base.example' || v WHEN NOT regexp_matches(v, '(?i)^[a-z][a-z0-9+.-]*:') THEN 'https://base.example/' || v ELSE v END AS url FROM l",
)
def url_normalize(spark: SparkSession, sf: str) -> DataFrame:
    links = F.array(F.lit(""), F.concat(F.lit("//"), "url"), F.concat(F.lit(" "), "url"), F.concat(F.lit("/a/"), F.col("page_id").cast("string")), F.lit("b/c"), F.lit("mailto:x@y"), F.lit("HTTPS://z"))
    return read(spark, sf, "pages").select("page_id", F.explode(links).alias("raw")).select("page_id", F.trim("raw").alias("raw"), T.absolute_url(F.col("raw"), "https://base.example/").alias("url"))


_RAW = "CASE o_orderkey % 6 WHEN 0 THEN strftime(o_orderdate, '%Y-%m-%d') WHEN 1 THEN ' ' || strftime(o_orderdate, '%-d/%-m/%Y') WHEN 2 THEN '99/77/2020' WHEN 3 THEN 'em 2014, salvo 2015' WHEN 4 THEN '12 de março de 2020' ELSE 'unknown' END"


def _raw_dates(spark: SparkSession, sf: str) -> DataFrame:
    d, m = F.col("o_orderdate"), F.col("o_orderkey") % 6
    raw = F.when(m == 0, F.date_format(d, "yyyy-MM-dd")).when(m == 1, F.concat(F.lit(" "), F.date_format(d, "d/M/yyyy"))).when(m == 2, "99/77/2020").when(m == 3, "em 2014, salvo 2015").when(m == 4, "12 de março de 2020").otherwise("unknown")
    return read(spark, sf, "orders").select("o_orderkey", "o_orderdate", raw.alias("raw"))


@query(
    "date_parse",
    f"WITH r AS (SELECT o_orderkey, o_orderkey % 6 AS m, o_orderdate, {_RAW} AS raw FROM orders) SELECT o_orderkey, raw, CASE WHEN m < 2 THEN strftime(o_orderdate, '%Y-%m-%d') WHEN m = 2 THEN '2020-77-99' ELSE '' END AS day, (CASE WHEN m < 2 THEN year(o_orderdate) WHEN m = 2 THEN 2020 WHEN m = 3 THEN 2014 WHEN m = 4 THEN 2020 ELSE 0 END)::INT AS year, "
    "CASE WHEN m = 4 THEN '2020-03-12' ELSE '' END AS long_day, CASE WHEN m < 2 THEN strftime(o_orderdate, '%Y-%m-%d') WHEN m = 2 THEN '2020-77-99' WHEN m = 3 THEN '2014-01-01' WHEN m = 4 THEN '2020-03-12' ELSE '' END AS any_day FROM r",
)
def date_parse(spark: SparkSession, sf: str) -> DataFrame:
    """Short dates (ranges unchecked), years, long dates, and the first of these with a year alone as its first day."""
    raw = F.col("raw")
    day, long = F.nullif(T.iso_date(raw), F.lit("")), T.long_date(raw)
    first = F.concat(T.year_of(raw).cast("string"), F.lit("-01-01"))
    return _raw_dates(spark, sf).select("o_orderkey", "raw", T.iso_date(raw).alias("day"), F.coalesce(T.year_of(raw), F.lit(0)).alias("year"), F.coalesce(long, F.lit("")).alias("long_day"), F.coalesce(day, long, first, F.lit("")).alias("any_day"))


@query("clamped_values", "WITH v AS (SELECT event_id, CASE event_id % 4 WHEN 0 THEN (value / 200)::VARCHAR WHEN 1 THEN '-3' WHEN 2 THEN 'high' ELSE NULL END AS raw FROM events) SELECT event_id, round(least(greatest(coalesce(try_cast(raw AS DOUBLE), 0), 0), 1), 9) AS value FROM v")
def clamped_values(spark: SparkSession, sf: str) -> DataFrame:
    m = F.col("event_id") % 4
    raw = F.when(m == 0, (F.col("value") / 200).cast("string")).when(m == 1, "-3").when(m == 2, "high")
    return read(spark, sf, "events").select("event_id", F.round(T.clamp01(raw), 9).alias("value"))


@query("hashed_picks", "WITH h AS (SELECT page_id, list_reduce(list_prepend(2166136261::BIGINT, list_transform(string_split(url, ''), lambda c: unicode(c)::BIGINT)), lambda h, c: (xor(h, c) * 16777619) & 4294967295) AS h FROM pages WHERE url <> '') SELECT page_id, h, ['a', 'b', 'c', 'd', 'e'][(h % 5)::INT + 1] AS pick FROM h")
def hashed_picks(spark: SparkSession, sf: str) -> DataFrame:
    """A hash of a text, and what it picks from a list by the remainder."""
    picks = F.array(*map(F.lit, "abcde"))
    return read(spark, sf, "pages").where("url <> ''").select("page_id", T.fnv1a(F.col("url")).alias("h")).withColumn("pick", F.get(picks, (F.col("h") % 5).cast("int")))


@query("process_numbers", "WITH n AS (SELECT o_orderkey, lpad(o_orderkey::VARCHAR, 7, '0') || '-12.' || year(o_orderdate) || '.4.03.6100' AS raw FROM orders), d AS (SELECT o_orderkey, raw, regexp_replace(raw, '[^0-9]', '', 'g') AS d FROM n) SELECT o_orderkey, d, d[1:7] || '-' || d[8:9] || '.' || d[10:13] || '.' || d[14:14] || '.' || d[15:16] || '.' || d[17:20] AS number FROM d")
def process_numbers(spark: SparkSession, sf: str) -> DataFrame:
    """Case numbers as digits and in their written form."""
    raw = F.concat(F.lpad(F.col("o_orderkey").cast("string"), 7, "0"), F.lit("-12."), F.year("o_orderdate").cast("string"), F.lit(".4.03.6100"))
    digits = F.regexp_replace(raw, "[^0-9]", "")
    return read(spark, sf, "orders").select("o_orderkey", digits.alias("d")).withColumn("number", F.regexp_replace("d", "^(.{7})(..)(.{4})(.)(..)(.{4})$", "$1-$2.$3.$4.$5.$6"))


@query("spaced_pages", "WITH t AS (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN regexp_replace(text, '(\\S)', '\\1 ', 'g') ELSE text END AS t FROM documents), w AS (SELECT doc_id, regexp_extract_all(coalesce(t, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM t) SELECT doc_id, len(w) > 0 AND len(list_filter(w, lambda x: length(x) = 1)) > 0.6e0 * len(w) AS spaced FROM w")
def spaced_pages(spark: SparkSession, sf: str) -> DataFrame:
    """Whether more than 60 % of a text's words are single characters; every third text is spaced out."""
    t = F.when(F.col("doc_id") % 3 == 0, F.regexp_replace("text", r"([^ \t\n\x0B\f\r])", "$1 ")).otherwise(F.col("text"))
    words = F.regexp_extract_all(F.coalesce(t, F.lit("")), F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))
    return read(spark, sf, "documents").select("doc_id", words.alias("w")).select("doc_id", ((F.size("w") > 0) & (F.size(F.filter("w", lambda x: F.char_length(x) == 1)) > 0.6 * F.size("w"))).alias("spaced"))


@query("match_segments", "WITH s AS (SELECT doc_id, string_split(replace(coalesce(text, ''), chr(10), chr(1) || chr(10)), chr(1)) AS s FROM documents) SELECT doc_id, i::INT - 1 AS place, length(s[i]) AS n_chars, md5(s[i]) AS segment FROM (SELECT doc_id, s, unnest(range(1, len(s) + 1)) AS i FROM s)")
def match_segments(spark: SparkSession, sf: str) -> DataFrame:
    """Texts cut from each match (a line feed) to the next; the part before the first match is segment 0."""
    return read(spark, sf, "documents").select("doc_id", F.posexplode(F.split(F.coalesce("text", F.lit("")), "(?=\n)")).alias("place", "s")).select("doc_id", "place", F.char_length("s").cast("long").alias("n_chars"), F.md5(F.encode("s", "UTF-8")).alias("segment"))
