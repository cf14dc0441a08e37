"""Queries that make records: statutes by article, JSON in free text, repairs, summaries of quality runs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrymill.functions import records as R
from quarrymill.operators import quality as Q
from quarrymill.plans.catalog import query, read


def _statutes(docs: DataFrame) -> DataFrame:
    """Lines of documents as those of statutes: every seventh a heading, every fifth opens one of four articles."""
    line = lambda x, i: F.when(i % 7 == 6, F.concat(F.lit("Capítulo "), i.cast("string"))).when(i % 5 == 0, F.concat(F.lit("Art. "), (F.floor(i / 5) % 4 + 1).cast("string"), F.lit("º "), x)).otherwise(x)
    return docs.select("doc_id", "source", F.array_join(F.transform(F.split(F.coalesce("text", F.lit("")), "\n"), line), "\n").alias("t"))


@query(
    "statute_articles",
    "WITH l AS (SELECT source, doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS x, unnest(range(len(string_split(coalesce(text, ''), chr(10))))) AS i FROM documents), "
    "m AS (SELECT source, doc_id, i, trim(regexp_replace(CASE WHEN i % 7 = 6 THEN 'Capítulo ' || i WHEN i % 5 = 0 THEN 'Art. ' || (i // 5 % 4 + 1) || 'º ' || x ELSE x END, '[ \\t\\n\\r\\f\\x0B]+', ' ', 'g')) AS x FROM l), "
    "e AS (SELECT *, CASE WHEN regexp_matches(x, '(?i)^Art\\.\\s*[0-9]+') THEN regexp_extract(x, '(?i)^Art\\.\\s*([0-9]+)', 1) WHEN regexp_matches(x, '(?i)^(LIVRO|TÍTULO|CAPÍTULO|SEÇÃO)') THEN '' END AS event FROM m WHERE x <> ''), "
    "g AS (SELECT *, count(event) OVER (PARTITION BY doc_id ORDER BY i) AS part FROM e), "
    "s AS (SELECT source, doc_id, part, arg_min(event, i) AS event, string_agg(x, chr(10) ORDER BY i) AS text FROM g WHERE part > 0 GROUP BY ALL) "
    "SELECT source, 'Art. ' || event AS device, md5(text) AS text FROM s WHERE event <> '' QUALIFY row_number() OVER (PARTITION BY source, event ORDER BY doc_id DESC, part DESC) = 1",
)
def statute_articles(spark: SparkSession, sf: str) -> DataFrame:
    """The text in force of each article of a norm: from its line to the next article or heading; later texts replace earlier ones."""
    return R.devices(_statutes(read(spark, sf, "documents")), "source", "t", "doc_id").select("source", "device", F.md5(F.encode("text", "UTF-8")).alias("text"))


_TAILS = ["", " fim", " {broken", ' {"b": 1}', " } }", "\n```"]
_HEADS = ["", "Resposta: ", "```json\n", "a \" b ", "\\ ", "[1] "]


@query(
    "json_in_text",
    "SELECT event_id, CASE WHEN event_id % 7 < 6 THEN json_extract_string(props, '$.k')::INT ELSE -1 END AS k, CASE WHEN event_id % 7 < 6 THEN '}{\"' || event_type ELSE 'none' END AS note FROM events",
)
def json_in_text(spark: SparkSession, sf: str) -> DataFrame:
    """Objects found again in texts that hold them among other things; every seventh is cut before its end."""
    i = F.col("event_id")
    whole = F.concat(F.lit('{"a": {"n": ['), F.lit('1, {"z": "}\\\\"}]}, "note": "}{\\"'), F.col("event_type"), F.lit('", '), F.substring("props", 2, 1000))
    body = F.when(i % 7 < 6, whole).otherwise(F.substring(whole, F.lit(1), F.char_length(whole) - 1))
    pick = lambda xs: F.get(F.array(*map(F.lit, xs)), (i % 6).cast("int"))
    text = F.concat(pick(_HEADS), body, F.when(i % 7 < 6, pick(_TAILS)).otherwise(""))
    v = R.first_json(F.col("t"))
    return read(spark, sf, "events").select("event_id", text.alias("t")).select("event_id", v.alias("v")).select("event_id", F.coalesce(F.try_variant_get("v", "$.k", "int"), F.lit(-1)).alias("k"), F.coalesce(F.try_variant_get("v", "$.note", "string"), F.lit("none")).alias("note"))


_REC = (
    "WITH r AS (SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN '' WHEN 1 THEN 'REsp' WHEN 2 THEN 'REsp ' || o_custkey ELSE NULL END AS processo, CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE o_orderpriority END AS orgao, left(o_orderpriority, (o_orderkey % 9)::INT) AS tema FROM orders), "
    "p AS (SELECT l_orderkey AS k, l_linenumber / 8.0e0 AS sure, CASE WHEN l_linenumber % 2 = 0 THEN 'REsp ' || l_partkey || ' / ' || l_suppkey ELSE '' END AS processo, l_returnflag || ' ' || l_linestatus AS orgao, repeat(l_returnflag, floor(l_quantity / 2)::INT) AS tema FROM lineitem WHERE l_linenumber >= 3), "
    "b AS (SELECT k, max({'n': length(processo), 's': sure, 't': processo}) FILTER (processo <> '') AS pr, max({'s': sure, 'n': length(orgao), 't': orgao}) FILTER (orgao <> '') AS og, max({'n': length(tema), 's': sure, 't': tema}) FILTER (tema <> '') AS te FROM p GROUP BY k), "
    "d AS (SELECT r.*, b.*, coalesce(processo, '') = '' OR NOT regexp_matches(processo, '[0-9]') AS bad FROM r LEFT JOIN b ON k = o_orderkey), "
    "x AS (SELECT *, coalesce(pr.t IS NOT NULL AND (bad OR pr.n > length(coalesce(processo, '')) + 4), false) AS a, coalesce(og.t IS NOT NULL AND coalesce(orgao, '') = '', false) AS b2, coalesce(te.t IS NOT NULL AND (coalesce(tema, '') = '' OR te.n > length(tema) + 12), false) AS c FROM d) "
)


@query("records_repaired", _REC + "SELECT o_orderkey, CASE WHEN a THEN pr.t ELSE processo END AS processo, CASE WHEN b2 THEN og.t ELSE orgao END AS orgao_julgador, CASE WHEN c THEN te.t ELSE tema END AS tema, a OR b2 OR c AS changed FROM x")
def records_repaired(spark: SparkSession, sf: str) -> DataFrame:
    """Orders as records with doubtful fields, their lines as offers to repair them, some not sure enough."""
    k = F.col("o_orderkey")
    processo = F.when(k % 4 == 0, "").when(k % 4 == 1, "REsp").when(k % 4 == 2, F.concat(F.lit("REsp "), F.col("o_custkey").cast("string")))
    records = read(spark, sf, "orders").select("o_orderkey", processo.alias("processo"), F.when(k % 3 != 0, F.col("o_orderpriority")).alias("orgao_julgador"), F.substring("o_orderpriority", F.lit(1), (k % 9).cast("int")).alias("tema"))
    number = F.concat(F.lit("REsp "), F.col("l_partkey").cast("string"), F.lit(" / "), F.col("l_suppkey").cast("string"))
    offers = read(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("o_orderkey"), (F.col("l_linenumber") / 8).cast("string").alias("confidence"), F.when(F.col("l_linenumber") % 2 == 0, number).otherwise("").alias("processo"),
        F.concat("l_returnflag", F.lit(" "), "l_linestatus").alias("orgao_julgador"), F.repeat("l_returnflag", F.floor(F.col("l_quantity") / 2).cast("int")).alias("tema"),
    )
    return R.repaired(records, offers, "o_orderkey", {f: R.FIELDS[f] for f in ("processo", "orgao_julgador", "tema")}, 0.375)


@query("repair_candidates", _REC + "SELECT o_orderkey FROM x WHERE bad OR coalesce(orgao, '') = ''")
def repair_candidates(spark: SparkSession, sf: str) -> DataFrame:
    """Records whose number is doubtful or whose body is empty."""
    k = F.col("o_orderkey")
    processo = F.when(k % 4 == 0, "").when(k % 4 == 1, "REsp").when(k % 4 == 2, F.concat(F.lit("REsp "), F.col("o_custkey").cast("string")))
    return read(spark, sf, "orders").where(R.suspicious_case(processo) | (k % 3 == 0)).select("o_orderkey")


_NAMES = ["EVIDENCE_STANCE_VIOLATION", "MISSING_STRUCTURE", "JEF_VALUE", "JEF_JEC_WRONG_APPEAL", "CDC_APPLICATION_MISSING", "RICHNESS_LOW", "SOMETHING_ELSE"]
_OF = "CASE rule WHEN 'EVIDENCE_STANCE_VIOLATION' THEN 'EvidenceAnalyzer' WHEN 'MISSING_STRUCTURE' THEN 'StructuralValidator' WHEN 'JEF_VALUE' THEN 'JefCivelValidator' WHEN 'JEF_JEC_WRONG_APPEAL' THEN 'AppealValidator' WHEN 'CDC_APPLICATION_MISSING' THEN 'ConsumerValidator' WHEN 'RICHNESS_LOW' THEN 'RichnessValidator' ELSE 'Other' END"
_RUN = (
    "WITH r AS (SELECT o_orderkey, o_orderpriority AS area, o_orderstatus AS document_type, 't' || (o_custkey % 13) AS theme, CASE o_orderkey % 5 WHEN 0 THEN 'X' WHEN 1 THEN 'Y' END AS trap, CASE o_orderkey % 3 WHEN 0 THEN 'DETECTED' WHEN 1 THEN 'AVOIDED' END AS outcome, "
    "o_orderkey % 11 <> 0 AS ok, ['MINUTA APROVADA', 'APROVADA COM RESSALVAS', 'REPROVADA', NULL][(o_custkey % 4)::INT + 1] AS ds, CASE WHEN o_orderkey % 11 <> 0 THEN (o_custkey % 101)::DOUBLE END AS score, o_custkey AS i, o_orderkey % 1000 AS o, o_totalprice AS cost, o_orderkey % 997 AS ms FROM orders), "
    "e AS (SELECT theme, l_linenumber, [" + ", ".join(f"'{n}'" for n in _NAMES) + "][(l_partkey % 7)::INT + 1] AS rule, l_quantity > 25 AS fatal FROM lineitem JOIN r ON l_orderkey = o_orderkey) "
)
_SUMS = "count(*) AS total, count(*) FILTER (ok) AS succeeded, count(*) FILTER (ds = 'MINUTA APROVADA') AS approved, count(*) FILTER (ds = 'APROVADA COM RESSALVAS') AS with_caveats, count(*) FILTER (ds = 'REPROVADA') AS rejected, round(coalesce(avg(score), 0), 6) AS avg_score, count(trap) AS traps, count(*) FILTER (trap IS NOT NULL AND outcome = 'DETECTED') AS detected, count(*) FILTER (trap IS NOT NULL AND outcome = 'AVOIDED') AS avoided, count(*) FILTER (trap IS NOT NULL AND outcome IS NULL) AS missed, sum(i)::BIGINT AS input_tokens, sum(o)::BIGINT AS output_tokens, round(sum(cost), 2) AS cost, round(avg(ms), 6) AS avg_ms FROM r"


def _run(spark: SparkSession, sf: str) -> DataFrame:
    """Orders as cases of a quality run, their lines as errors."""
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    name = F.get(F.array(*map(F.lit, _NAMES)), (F.col("l_partkey") % 7).cast("int"))
    errors = read(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.collect_list(F.struct(name.alias("rule"), (F.col("l_quantity") > 25).alias("fatal"))).alias("errors"))  # an order has a few lines
    status = F.get(F.array(F.lit("MINUTA APROVADA"), F.lit("APROVADA COM RESSALVAS"), F.lit("REPROVADA"), F.lit(None)), (c % 4).cast("int"))
    return read(spark, sf, "orders").join(errors, "o_orderkey", "left").select(
        F.col("o_orderpriority").alias("area"), F.col("o_orderstatus").alias("document_type"), F.concat(F.lit("t"), (c % 13).cast("string")).alias("theme"), F.when(k % 5 == 0, "X").when(k % 5 == 1, "Y").alias("trap"),
        F.when(k % 3 == 0, "DETECTED").when(k % 3 == 1, "AVOIDED").alias("trap_outcome"), F.when(k % 11 != 0, "success").otherwise("error").alias("status"), status.alias("document_status"),
        F.when(k % 11 != 0, (c % 101).cast("double")).alias("score"), c.alias("input_tokens"), (k % 1000).alias("output_tokens"), F.col("o_totalprice").alias("cost"), (k % 997).alias("ms"), "errors",
    )


@query("quality_summary", _RUN + f"SELECT 'all' AS dimension, '' AS value, {_SUMS}" + "".join(f" UNION ALL SELECT '{d}', {d}, {_SUMS} {'WHERE trap IS NOT NULL ' if d == 'trap' else ''}GROUP BY {d}" for d in Q.DIMENSIONS))
def quality_summary(spark: SparkSession, sf: str) -> DataFrame:
    out = Q.quality_summary(_run(spark, sf))
    return out.withColumns({"avg_score": F.round("avg_score", 6), "cost": F.round("cost", 2), "avg_ms": F.round("avg_ms", 6)})


@query(
    "quality_top_rules",
    _RUN + f", x AS (SELECT 'all' AS dimension, '' AS value, rule, count(*) AS n FROM e WHERE fatal GROUP BY rule UNION ALL SELECT 'theme', theme, rule, count(*) FROM e WHERE fatal GROUP BY theme, rule UNION ALL SELECT 'validator', {_OF} AS v, rule, count(*) FROM e GROUP BY v, rule), "
    "y AS (SELECT dimension, value, rule, n, row_number() OVER (PARTITION BY dimension, value ORDER BY n DESC, rule)::INT AS place FROM x) SELECT * FROM y WHERE place <= CASE WHEN dimension = 'all' THEN 10 ELSE 5 END",
)
def quality_top_rules(spark: SparkSession, sf: str) -> DataFrame:
    """Fatal rules overall and by theme, all rules by validator."""
    return Q.top_rules(_run(spark, sf), Q.validator_of(F.col("rule")))


_OPENERS = ["I - DOS FATOS", "1. Primeiro", "Tese 2", "relatório", "DO MÉRITO", "nada", "II – Do Direito; Tese 4"]
_PAGE = f"replace(coalesce(text, ''), '. ', '-' || chr(10)) || chr(10) || {_OPENERS}[(doc_id % {len(_OPENERS)})::INT + 1] || chr(10) || 'TTRRIIBBUUNNAALL DDE AABBCC ÇÇÃÃOO  Página 3 .'"


@query(
    "page_texts",
    f"WITH d AS (SELECT doc_id, {_PAGE} AS t FROM documents), "
    "h AS (SELECT doc_id, t, string_split_regex(t, '[A-ZÀ-ÖØ-Þ]{4,}') AS gaps, list_transform(regexp_extract_all(t, '[A-ZÀ-ÖØ-Þ]{4,}'), lambda r: CASE WHEN len(r) % 2 = 0 AND string_split(r, '')[1:-1:2] = string_split(r, '')[2:-1:2] THEN array_to_string(string_split(r, '')[1:-1:2], '') ELSE r END) AS runs FROM d), "
    "u AS (SELECT doc_id, t, array_to_string(list_transform(range(1, len(gaps) + 1), lambda i: gaps[i] || coalesce(runs[i], '')), '') AS u FROM h), "
    "f AS (SELECT *, regexp_replace(replace(u, chr(10), ' '), ' {2,}', ' ', 'g') AS a FROM u), g AS (SELECT *, regexp_replace(regexp_replace(a, '([A-Za-zÀ-ÿ])- ([A-Za-zÀ-ÿ])', '\\1\\2', 'g'), 'Página [0-9]+', ' ', 'g') AS b FROM f) "
    f"SELECT doc_id, md5(trim(regexp_replace(regexp_replace(regexp_replace(b, ' {{2,}}', ' ', 'g'), ' \\.', '.', 'g'), '[ \\t\\n\\r\\f\\x0B]+', ' ', 'g'))) AS flat, len(regexp_extract_all(t, '(?im){R.SECTION_MARKS}'))::INT AS sections FROM g",
)
def page_texts(spark: SparkSession, sf: str) -> DataFrame:
    """Pages as scans leave them: doubled capitals mended, lines flattened, headers off; and how many sections they open."""
    opener = F.get(F.array(*map(F.lit, _OPENERS)), (F.col("doc_id") % len(_OPENERS)).cast("int"))
    page = F.concat(F.replace(F.coalesce("text", F.lit("")), F.lit(". "), F.lit("-\n")), F.lit("\n"), opener, F.lit("\nTTRRIIBBUUNNAALL DDE AABBCC ÇÇÃÃOO  Página 3 ."))
    pages = read(spark, sf, "documents").select("doc_id", page.alias("t"))
    flat = R.flattened(R.undoubled(F.col("t")), ("Página [0-9]+",))
    return pages.select("doc_id", F.md5(F.encode(flat, "UTF-8")).alias("flat"), R.section_count(F.col("t")).alias("sections"))
