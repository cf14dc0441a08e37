"""The queries of the engine's own operators over the driver's tables, and the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrymill.functions import text as T
from quarrymill.operators import analytics, rules, search, tables
from quarrymill.streaming.events import event_windows

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

TERMS = ["trash", "anon", "license", "the"]
FOLD = "lower(strip_accents(coalesce({0}, '')))"
TOKENS = "regexp_extract_all(" + FOLD + ", '[a-z0-9]{{{1},}}')"


def tokens_sql(text: str, least: int = 1) -> str:
    return TOKENS.format(text, least)


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql is not None:
            ORACLES[name] = sql
        return f

    return add


def read(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


# Retrieval

_BM25 = (
    "WITH d AS (SELECT doc_id, " + tokens_sql("split_part(text, chr(10), 1)") + " AS a, " + tokens_sql("text") + " AS b FROM documents), "
    "t AS (SELECT unnest([" + ", ".join(f"'{t}'" for t in TERMS) + "]) AS term), "
    "c AS (SELECT doc_id, term, len(list_filter(a, lambda w: w = term))::DOUBLE AS fa, len(list_filter(b, lambda w: w = term))::DOUBLE AS fb, len(a)::DOUBLE AS la, len(b)::DOUBLE AS lb FROM d, t), "
    "s AS (SELECT count(*)::DOUBLE AS n, avg(len(a)::DOUBLE) AS ma, avg(len(b)::DOUBLE) AS mb FROM d), "
    "f AS (SELECT term, (count(*) FILTER (fa > 0))::DOUBLE AS da, (count(*) FILTER (fb > 0))::DOUBLE AS db FROM c GROUP BY term), "
    "p AS (SELECT doc_id, sum(ln(1 + (n - da + 0.5e0) / (da + 0.5e0)) * fa * 2.2e0 / (fa + 1.2e0 * (0.25e0 + 0.75e0 * la / ma))) * 2 AS x, "
    "sum(ln(1 + (n - db + 0.5e0) / (db + 0.5e0)) * fb * 2.2e0 / (fb + 1.2e0 * (0.25e0 + 0.75e0 * lb / mb))) AS y FROM c JOIN f USING (term), s GROUP BY doc_id), "
    "bm AS (SELECT doc_id, round(greatest(x, y), 6) AS score FROM p WHERE greatest(x, y) > 0), "
)


def _bm25(spark: SparkSession, sf: str) -> DataFrame:
    docs = read(spark, sf, "documents")
    fields = {"head": (F.substring_index("text", "\n", 1), 2.0), "body": (F.col("text"), 1.0)}
    return search.bm25(docs, fields, TERMS).withColumn("score", F.round("score", 6))


@query("bm25_best_fields", _BM25 + "z AS (SELECT 1) SELECT * FROM bm")
def bm25_best_fields(spark: SparkSession, sf: str) -> DataFrame:
    return _bm25(spark, sf)


@query("bm25_filtered", _BM25 + "z AS (SELECT 1) SELECT bm.* FROM bm JOIN documents USING (doc_id) WHERE lang = 'en' AND source IN ('src0', 'src1', 'src2') ORDER BY score DESC, doc_id LIMIT 20")
def bm25_filtered(spark: SparkSession, sf: str) -> DataFrame:
    allowed = read(spark, sf, "documents").where("lang = 'en' and source in ('src0', 'src1', 'src2')").select("doc_id")
    return _bm25(spark, sf).join(allowed, "doc_id", "left_semi").orderBy(F.desc("score"), "doc_id").limit(20)


@query(
    "bm25_fuzzy_auto",
    "WITH w AS (SELECT token, count(*) AS n_docs FROM (SELECT doc_id, unnest(list_distinct(" + tokens_sql("text") + ")) AS token FROM documents) GROUP BY token), "
    "t AS (SELECT unnest(['idiot', 'licence', 'on']) AS term) "
    "SELECT term, token, levenshtein(token, term) AS distance, n_docs FROM w, t WHERE levenshtein(token, term) <= CASE WHEN len(term) < 3 THEN 0 WHEN len(term) < 6 THEN 1 ELSE 2 END",
)
def bm25_fuzzy_auto(spark: SparkSession, sf: str) -> DataFrame:
    return search.fuzzy_terms(read(spark, sf, "documents"), F.col("text"), ["idiot", "licence", "on"])


_COS = "round(list_cosine_similarity(e.embedding::DOUBLE[], q.embedding::DOUBLE[]), 6) AS score FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 0) q"


def _vectors(spark: SparkSession, sf: str) -> DataFrame:
    all_ = read(spark, sf, "embeddings")
    return search.vector_scores(all_, all_.where("vec_id = 0").select(F.col("embedding").alias("q"))).withColumn("score", F.round("score", 6)).drop("embedding")


@query("vector_topk", f"SELECT vec_id, label, {_COS} ORDER BY score DESC, vec_id LIMIT 10")
def vector_topk(spark: SparkSession, sf: str) -> DataFrame:
    return _vectors(spark, sf).orderBy(F.desc("score"), "vec_id").limit(10)


@query("vector_quota_per_label", f"WITH s AS (SELECT vec_id, label, {_COS} WHERE label IN (1, 2, 3, 4)), r AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY score DESC, vec_id) AS place FROM s) SELECT * FROM r WHERE place <= 3")
def vector_quota_per_label(spark: SparkSession, sf: str) -> DataFrame:
    """Ten results from four labels: a quota of max(3, ceil(10 / 4)) each."""
    return search.top_per_group(_vectors(spark, sf).where("label in (1, 2, 3, 4)"), "label", 3, "vec_id")


_RRF = _BM25 + f"v AS (SELECT vec_id AS doc_id, {_COS}), x AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) - 1 AS place, 'text' AS branch FROM bm QUALIFY place < 20 UNION ALL SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) - 1 AS place, 'vector' AS branch FROM v QUALIFY place < 20) "


@query("rrf_hybrid", _RRF + "SELECT doc_id, round(sum(1e0 / (61 + place)), 9) AS score, string_agg(DISTINCT branch, '+' ORDER BY branch) AS branches FROM x GROUP BY doc_id ORDER BY score DESC, doc_id LIMIT 10")
def rrf_hybrid(spark: SparkSession, sf: str) -> DataFrame:
    a = search.ranked_list(_bm25(spark, sf), "doc_id", 20, "text")
    b = search.ranked_list(_vectors(spark, sf).withColumnRenamed("vec_id", "doc_id"), "doc_id", 20, "vector")
    return search.reciprocal_rank_fusion([a, b], "doc_id", 10)


@query("route_single_branch", _RRF + "SELECT doc_id, place, branch FROM x WHERE branch = 'text' AND place < 10")
def route_single_branch(spark: SparkSession, sf: str) -> DataFrame:
    """Courts of one branch only: its list as it is, cut, not ranked again."""
    return search.ranked_list(_bm25(spark, sf), "doc_id", 20, "text").where("place < 10")


@query(
    "hash_embedding",
    "WITH w AS (SELECT doc_id, sha256(unnest(" + tokens_sql("text", 2) + ")) AS h FROM documents), "
    "x AS (SELECT doc_id, ('0x' || h[1:8])::BIGINT % 768 AS idx, round(sum(CASE WHEN ('0x' || h[9:10])::BIGINT % 2 = 0 THEN 1e0 ELSE -1e0 END * (1 + (('0x' || h[11:12])::BIGINT % 9) / 10e0)), 6) AS x FROM w GROUP BY ALL), "
    "n AS (SELECT *, sqrt(sum(x * x) OVER (PARTITION BY doc_id)) AS norm FROM x) SELECT doc_id, idx, round(x / norm, 6) AS weight FROM n WHERE norm > 0 AND x <> 0",
)
def hash_embedding(spark: SparkSession, sf: str) -> DataFrame:
    return search.hash_embedding(read(spark, sf, "documents"), F.col("text"))


@query(
    "source_merge_dedupe",
    "WITH h AS (SELECT md5(lower(text)) AS name, source, min(doc_id) AS f, count(*) AS n FROM documents GROUP BY ALL) "
    "SELECT name, min(f) AS doc_id, string_agg(source, ' + ' ORDER BY f, source) AS origins, sum(n)::BIGINT AS n_hits FROM h GROUP BY name",
)
def source_merge_dedupe(spark: SparkSession, sf: str) -> DataFrame:
    """Hits are one work if their whole lower-cased texts are equal."""
    return search.merge_sources(read(spark, sf, "documents"), F.md5(F.encode(F.lower("text"), "UTF-8")))


@query(
    "keyword_queries",
    "WITH w AS (SELECT doc_id, list_filter(" + tokens_sql("text") + ", lambda x: len(x) > 3)[1:4] AS w FROM documents) "
    "SELECT doc_id, q AS query FROM (SELECT doc_id, unnest([CASE WHEN len(w) > i THEN w[i] || ' ' || w[i + 1] END FOR i IN [1, 2, 3]]) AS q FROM w) WHERE q IS NOT NULL",
)
def keyword_queries(spark: SparkSession, sf: str) -> DataFrame:
    return read(spark, sf, "documents").select("doc_id", F.explode(search.keyword_queries(F.col("text"))).alias("query"))


_FOUND = "len(list_filter([{0}], lambda t: list_contains(w, t)))"


@query(
    "relevance_rank",
    "WITH d AS (SELECT doc_id, source, text, " + tokens_sql("text") + " AS w FROM documents), "
    "h AS (SELECT *, 1 + 0.1e0 * " + _FOUND.format("'license', 'version', 'stupid'") + " AS s, " + _FOUND.format("'the', 'license', 'apache'") + " AS k FROM d), "
    "r AS (SELECT doc_id, round((CASE WHEN k >= 2 THEN s + 0.25e0 * k WHEN k = 0 THEN s * 0.1e0 ELSE s END) + CASE WHEN source = 'src0' THEN 0.3e0 ELSE 0 END + CASE WHEN len(text) > 150 THEN 0.2e0 ELSE 0 END + CASE WHEN regexp_matches(lower(text), 'licensed under|copyright') THEN 0.4e0 ELSE 0 END, 2) AS score FROM h) "
    "SELECT doc_id, score, score > 0.3 AS kept FROM r",
)
def relevance_rank(spark: SparkSession, sf: str) -> DataFrame:
    score = search.relevance(F.col("text"), F.col("source"), ["license", "version", "stupid"], ["the", "license", "apache"], "src0", "licensed under|copyright")
    return read(spark, sf, "documents").select("doc_id", score.alias("score")).withColumn("kept", F.col("score") > 0.3)


# Text

@query("accent_fold", "SELECT doc_id, md5(lower(strip_accents(text))) AS folded FROM documents")
def accent_fold(spark: SparkSession, sf: str) -> DataFrame:
    return read(spark, sf, "documents").select("doc_id", F.md5(F.encode(T.fold(F.col("text")), "UTF-8")).alias("folded"))


@query("clean_text", "SELECT doc_id, md5(trim(regexp_replace(replace(text, chr(160), ' '), '[ \\t\\n\\r\\f\\x0B]+', ' ', 'g'))) AS cleaned FROM documents")
def clean_text(spark: SparkSession, sf: str) -> DataFrame:
    return read(spark, sf, "documents").select("doc_id", F.md5(F.encode(T.clean(F.col("text")), "UTF-8")).alias("cleaned"))


@query("law_refs", "WITH r AS (SELECT doc_id, unnest(list_distinct(regexp_extract_all(" + FOLD.format("text") + ", '(?:art\\.?|lei|version|section|no\\.?) ?[0-9]+(?:\\.[0-9]+)*'))) AS ref FROM documents) SELECT ref, count(*) AS n_docs, min(doc_id) AS first_doc FROM r GROUP BY ref")
def law_refs(spark: SparkSession, sf: str) -> DataFrame:
    refs = read(spark, sf, "documents").select("doc_id", F.explode(T.law_references(F.col("text"))).alias("ref"))
    return refs.groupBy("ref").agg(F.count("*").alias("n_docs"), F.min("doc_id").alias("first_doc"))


@query("link_extract", "SELECT page_id, unnest(regexp_extract_all(coalesce(html, ''), 'href=\"([^\"]*)\"', 1)) AS link FROM pages")
def link_extract(spark: SparkSession, sf: str) -> DataFrame:
    return read(spark, sf, "pages").select("page_id", F.explode(T.links(F.col("html"))).alias("link"))


@query(
    "line_sections",
    "WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS pos FROM documents WHERE text IS NOT NULL), "
    "s AS (SELECT *, last_value(CASE WHEN len(line) < 40 THEN pos END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY pos) AS section FROM l) SELECT doc_id, coalesce(section, -1) AS section, count(*) AS n_lines FROM s GROUP BY ALL",
)
def line_sections(spark: SparkSession, sf: str) -> DataFrame:
    """A line under 40 characters heads the lines after it; -1 before the first."""
    lines = read(spark, sf, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    return tables.carried_sections(lines, "doc_id", "pos", F.when(F.char_length("line") < 40, F.col("pos"))).groupBy("doc_id", F.coalesce("section", F.lit(-1)).alias("section")).agg(F.count("*").alias("n_lines"))


# Roll-ups

@query("terms_agg", "SELECT source, count(*) AS n FROM documents GROUP BY source ORDER BY n DESC, source LIMIT 60")
def terms_agg(spark: SparkSession, sf: str) -> DataFrame:
    return analytics.terms(read(spark, sf, "documents"), "source", 60)


@query("prefix_rollup", "SELECT coalesce(bucket, 'total') AS bucket, count(*) AS n FROM (SELECT CASE WHEN starts_with(source, 'src1') THEN 'superior' WHEN starts_with(source, 'src2') OR starts_with(source, 'src3') THEN 'state' WHEN starts_with(source, 'src4') THEN 'labour' END AS bucket FROM documents) WHERE bucket IS NOT NULL GROUP BY GROUPING SETS ((bucket), ())")
def prefix_rollup(spark: SparkSession, sf: str) -> DataFrame:
    s = F.col("source")
    bucket = F.when(s.startswith("src1"), "superior").when(s.startswith("src2") | s.startswith("src3"), "state").when(s.startswith("src4"), "labour")
    rows = read(spark, sf, "documents").select(bucket.alias("b")).where("b is not null")
    return rows.rollup("b").agg(F.count("*").alias("n")).select(F.coalesce("b", F.lit("total")).alias("bucket"), "n")


@query("year_hist", "SELECT year(o_orderdate)::INT AS year, count(*) AS n FROM orders GROUP BY 1")
def year_hist(spark: SparkSession, sf: str) -> DataFrame:
    return read(spark, sf, "orders").groupBy(F.year("o_orderdate").alias("year")).agg(F.count("*").alias("n"))


@query("top_hit", "SELECT source, count(*) AS n, arg_max(doc_id, n_chars * 1000000000 - doc_id) AS sample FROM documents GROUP BY source")
def top_hit(spark: SparkSession, sf: str) -> DataFrame:
    best = F.max_by("doc_id", F.struct("n_chars", -F.col("doc_id")))
    return read(spark, sf, "documents").groupBy("source").agg(F.count("*").alias("n"), best.alias("sample"))


_SERVICE = "CASE event_type WHEN 'purchase' THEN 'purchase' WHEN 'click' THEN 'click' ELSE 'other' END"


@query("usage_by_day", "SELECT ts::DATE::VARCHAR AS day, coalesce(sum(floor(value)::BIGINT) FILTER (event_type = 'purchase'), 0)::BIGINT AS purchase, coalesce(sum(floor(value)::BIGINT) FILTER (event_type = 'click'), 0)::BIGINT AS click, coalesce(sum(floor(value)::BIGINT) FILTER (event_type NOT IN ('purchase', 'click')), 0)::BIGINT AS other FROM events GROUP BY 1")
def usage_by_day(spark: SparkSession, sf: str) -> DataFrame:
    v = F.floor("value").cast("long")
    one = lambda cond, name: F.coalesce(F.sum(F.when(cond, v)), F.lit(0)).cast("long").alias(name)
    e = F.col("event_type")
    return read(spark, sf, "events").groupBy(F.to_date("ts").cast("string").alias("day")).agg(one(e == "purchase", "purchase"), one(e == "click", "click"), one(~e.isin("purchase", "click"), "other"))


@query("usage_by_doctype", f"SELECT {_SERVICE} AS service, (props->>'$.k')::BIGINT % 5 AS doc_type, sum(floor(value)::BIGINT)::BIGINT AS tokens, count(*) AS n FROM events WHERE event_type IN ('purchase', 'click') AND (props->>'$.k') IS NOT NULL GROUP BY ALL")
def usage_by_doctype(spark: SparkSession, sf: str) -> DataFrame:
    rows = read(spark, sf, "events").where(F.col("event_type").isin("purchase", "click")).withColumn("k", F.get_json_object("props", "$.k").cast("long")).where("k is not null")
    return rows.groupBy(F.col("event_type").alias("service"), (F.col("k") % 5).alias("doc_type")).agg(F.sum(F.floor("value").cast("long")).alias("tokens"), F.count("*").alias("n"))


@query("count_per_day", "SELECT o_orderdate::DATE::VARCHAR AS day, count(*) AS n FROM orders GROUP BY 1 ORDER BY day LIMIT 20")
def count_per_day(spark: SparkSession, sf: str) -> DataFrame:
    return read(spark, sf, "orders").groupBy(F.to_date("o_orderdate").cast("string").alias("day")).agg(F.count("*").alias("n")).orderBy("day").limit(20)


@query("max_valid_date", "SELECT max(o_orderdate::DATE)::VARCHAR AS day, max(try_cast(replace(o_orderpriority[1:1], '-', '') AS INT)) AS top FROM orders WHERE o_orderdate::DATE <= DATE '1997-06-30'")
def max_valid_date(spark: SparkSession, sf: str) -> DataFrame:
    """The latest day not after the `as of` day, and the greatest number that a text column casts to."""
    return read(spark, sf, "orders").where(F.to_date("o_orderdate") <= F.lit("1997-06-30").cast("date")).agg(F.max(F.to_date("o_orderdate")).cast("string").alias("day"), F.max(F.substring("o_orderpriority", 1, 1).try_cast("int")).alias("top"))


_DECISIONS = "SELECT CASE o_orderstatus WHEN 'F' THEN 'APPROVED' WHEN 'O' THEN 'REJECTED' WHEN 'P' THEN 'PENDING' ELSE 'SKIPPED' END AS status, o_orderpriority AS rule, c_mktsegment AS provider, n_name AS area FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey"


def _decisions(spark: SparkSession, sf: str) -> DataFrame:
    """Orders as review decisions; customers meet on their key, the 25 nations are broadcast."""
    joined = read(spark, sf, "orders").join(read(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey")).join(F.broadcast(read(spark, sf, "nation")), F.col("c_nationkey") == F.col("n_nationkey"))
    s = F.col("o_orderstatus")
    return joined.select(F.when(s == "F", "APPROVED").when(s == "O", "REJECTED").when(s == "P", "PENDING").otherwise("SKIPPED").alias("status"), F.col("o_orderpriority").alias("rule"), F.col("c_mktsegment").alias("provider"), F.col("n_name").alias("area"))


_EFFECT = f"WITH d AS ({_DECISIONS}), x AS (SELECT status, unnest(['rule', 'provider', 'area']) AS dim, unnest([rule, provider, area]) AS value FROM d), e AS (SELECT dim, value, count(*) AS total, count(*) FILTER (status = 'APPROVED') AS approved, count(*) FILTER (status = 'REJECTED') AS rejected, round(100e0 * count(*) FILTER (status = 'APPROVED') / count(*), 6) AS approval_rate, round(100e0 * count(*) FILTER (status = 'REJECTED') / count(*), 6) AS rejection_rate FROM x WHERE value <> '' GROUP BY ALL) "


@query("decision_effectiveness", _EFFECT + "SELECT * FROM e")
def decision_effectiveness(spark: SparkSession, sf: str) -> DataFrame:
    return analytics.decision_effectiveness(_decisions(spark, sf), ["rule", "provider", "area"])


@query("automation_eligible", _EFFECT + "SELECT * FROM e WHERE approval_rate >= 30 AND rejection_rate <= 60 AND total >= 20")
def automation_eligible(spark: SparkSession, sf: str) -> DataFrame:
    return analytics.automation_eligible(decision_effectiveness(spark, sf), 30, 60, 20)


@query("review_summary", f"WITH d AS ({_DECISIONS}) SELECT count(*) AS total, count(*) FILTER (status = 'PENDING') AS pending, round(100e0 * count(*) FILTER (status = 'APPROVED') / nullif(count(*) FILTER (status IN ('APPROVED', 'REJECTED')), 0), 6) AS approval_rate FROM d")
def review_summary(spark: SparkSession, sf: str) -> DataFrame:
    """Approval over answered decisions only."""
    s = F.col("status")
    return _decisions(spark, sf).agg(F.count("*").alias("total"), F.count_if(s == "PENDING").alias("pending"), analytics.rate(F.count_if(s == "APPROVED"), F.count_if(s.isin("APPROVED", "REJECTED"))).alias("approval_rate"))


@query("audit_analytics", f"WITH d AS ({_DECISIONS}) SELECT coalesce(status, 'ALL') AS status, coalesce(rule, 'ALL') AS rule, count(*) AS n FROM d GROUP BY GROUPING SETS ((status), (rule), (status, rule), ())")
def audit_analytics(spark: SparkSession, sf: str) -> DataFrame:
    return _decisions(spark, sf).cube("status", "rule").agg(F.count("*").alias("n")).select(F.coalesce("status", F.lit("ALL")).alias("status"), F.coalesce("rule", F.lit("ALL")).alias("rule"), "n")


_FINDINGS = "SELECT l_orderkey AS execution, l_returnflag || l_linestatus AS type, 0.75e0 + l_discount * 2 AS confidence, (l_linenumber % 2)::INT AS useful, l_suppkey % 5 AS provider FROM lineitem"


def _findings(spark: SparkSession, sf: str) -> DataFrame:
    return read(spark, sf, "lineitem").select(F.col("l_orderkey").alias("execution"), F.concat("l_returnflag", "l_linestatus").alias("type"), (0.75 + F.col("l_discount") * 2).alias("confidence"), (F.col("l_linenumber") % 2).alias("useful"), (F.col("l_suppkey") % 5).alias("provider"))


@query("finding_frequency", f"WITH f AS ({_FINDINGS}) SELECT type, count(*) AS n, round(100e0 * count(*) / sum(count(*)) OVER (), 1) AS pct FROM f GROUP BY type")
def finding_frequency(spark: SparkSession, sf: str) -> DataFrame:
    return analytics.finding_frequency(_findings(spark, sf))


@query("top_by_domain", f"WITH f AS ({_FINDINGS}), c AS (SELECT provider, type, count(*) AS n FROM f GROUP BY ALL) SELECT provider, type, n, row_number() OVER (PARTITION BY provider ORDER BY n DESC, type)::INT AS place FROM c QUALIFY place <= 5")
def top_by_domain(spark: SparkSession, sf: str) -> DataFrame:
    counts = _findings(spark, sf).groupBy("provider", "type").agg(F.count("*").alias("n"))
    return tables.top_children(counts, "provider", [F.desc("n"), F.col("type")], 5)


@query("provider_stats", f"WITH f AS ({_FINDINGS}) SELECT provider, count(*) AS n, round(count(*) / count(DISTINCT execution), 6) AS mean_findings, round(avg(confidence), 6) AS mean_confidence FROM f GROUP BY provider")
def provider_stats(spark: SparkSession, sf: str) -> DataFrame:
    return _findings(spark, sf).groupBy("provider").agg(F.count("*").alias("n"), F.round(F.count("*") / F.count_distinct("execution"), 6).alias("mean_findings"), F.round(F.avg("confidence"), 6).alias("mean_confidence"))


@query("feedback_stats", f"WITH f AS ({_FINDINGS}) SELECT coalesce(type, 'ALL') AS type, sum(useful)::BIGINT AS useful, sum(1 - useful)::BIGINT AS not_useful, round(100e0 * sum(useful) / count(*), 6) AS rate FROM f GROUP BY GROUPING SETS ((type), ())")
def feedback_stats(spark: SparkSession, sf: str) -> DataFrame:
    out = _findings(spark, sf).rollup("type").agg(F.sum("useful").alias("useful"), F.sum(1 - F.col("useful")).alias("not_useful"), analytics.rate(F.sum("useful"), F.count("*")).alias("rate"))
    return out.withColumn("type", F.coalesce("type", F.lit("ALL")))


@query(
    "finding_quality",
    f"WITH f AS ({_FINDINGS}), e AS (SELECT count(DISTINCT execution) AS n FROM f), g AS (SELECT type, avg(useful) AS u, avg(confidence) AS c, round(count(DISTINCT execution) / any_value(e.n), 3) AS g FROM f, e GROUP BY type) "
    "SELECT type, round(u, 6) AS useful, round(c, 6) AS confidence, g AS genericity, round(0.6e0 * u + 0.3e0 * c + 0.1e0 * (1 - CASE WHEN g > 0.8 THEN round((g - 0.8e0) / 0.2e0, 3) ELSE 0 END), 6) AS quality FROM g",
)
def finding_quality(spark: SparkSession, sf: str) -> DataFrame:
    return analytics.finding_quality(_findings(spark, sf))


_CASES = "SELECT d.doc_id, lang, source, toxic AS expected, regexp_matches(lower(text), 'idiot|moron|scum|loser')::INT AS predicted FROM labels l JOIN documents d ON l.doc_id = d.doc_id"
_SLICES = f"WITH c AS ({_CASES}), x AS (SELECT expected, predicted, unnest(['ALL', 'lang', 'source']) AS dim, unnest(['ALL', lang, source]) AS value FROM c), s AS (SELECT dim, value, count(*) FILTER (expected = 1 AND predicted = 1) AS tp, count(*) FILTER (expected = 0 AND predicted = 1) AS fp, count(*) FILTER (expected = 1 AND predicted = 0) AS fn FROM x GROUP BY ALL), r AS (SELECT *, CASE WHEN tp + fp = 0 THEN CASE WHEN fn = 0 THEN 1e0 ELSE 0e0 END ELSE tp::DOUBLE / (tp + fp) END AS p, CASE WHEN tp + fn = 0 THEN 1e0 ELSE tp::DOUBLE / (tp + fn) END AS r FROM s) "


def _cases(spark: SparkSession, sf: str) -> DataFrame:
    docs = read(spark, sf, "documents").select("doc_id", "lang", "source", F.lower("text").rlike("idiot|moron|scum|loser").cast("int").alias("predicted"))
    return read(spark, sf, "labels").select("doc_id", F.col("toxic").alias("expected")).join(docs, "doc_id")


@query("metrics_slices", _SLICES + "SELECT dim, value, tp, fp, fn, round(p, 6) AS precision, round(r, 6) AS recall, round(CASE WHEN p + r = 0 THEN 0 ELSE 2 * p * r / (p + r) END, 6) AS f1 FROM r")
def metrics_slices(spark: SparkSession, sf: str) -> DataFrame:
    return analytics.metrics_slices(_cases(spark, sf), ["lang", "source"])


@query("validity_pearson", f"WITH c AS ({_CASES}) SELECT count(*) AS n, round(coalesce(corr(expected, predicted), 0), 6) AS r FROM c")
def validity_pearson(spark: SparkSession, sf: str) -> DataFrame:
    return analytics.pearson(_cases(spark, sf), "expected", "predicted")


# Tables

@query(
    "overlap_match",
    "WITH e AS (SELECT item_id, list_distinct(" + tokens_sql("text", 3) + ") AS w FROM benchmark), x AS (SELECT item_id, greatest(1, floor(len(w) * 0.3)::INT) AS need, unnest(w) AS word FROM e), "
    "d AS (SELECT doc_id, unnest(list_distinct(" + tokens_sql("text", 3) + ")) AS word FROM documents) SELECT item_id, doc_id, count(*) AS shared FROM d JOIN x USING (word) GROUP BY item_id, doc_id, need HAVING count(*) >= need",
)
def overlap_match(spark: SparkSession, sf: str) -> DataFrame:
    return tables.overlap_join(read(spark, sf, "benchmark"), read(spark, sf, "documents"))


@query("alerts_diff", "WITH a AS (SELECT DISTINCT l_partkey FROM lineitem WHERE l_returnflag = 'R'), b AS (SELECT DISTINCT l_partkey FROM lineitem WHERE l_returnflag = 'A') SELECT coalesce(a.l_partkey, b.l_partkey) AS l_partkey, CASE WHEN a.l_partkey IS NULL THEN 'new' WHEN b.l_partkey IS NULL THEN 'removed' ELSE 'kept' END AS state FROM a FULL JOIN b ON a.l_partkey = b.l_partkey")
def alerts_diff(spark: SparkSession, sf: str) -> DataFrame:
    items = read(spark, sf, "lineitem")
    return tables.compare_codes(items.where("l_returnflag = 'R'"), items.where("l_returnflag = 'A'"), "l_partkey")


@query("child_counts", "SELECT c_custkey, count(o_orderkey) AS n_orders, max(o_orderdate)::DATE::VARCHAR AS last_order FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY c_custkey")
def child_counts(spark: SparkSession, sf: str) -> DataFrame:
    counts = read(spark, sf, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("n"), F.max(F.to_date("o_orderdate")).cast("string").alias("last_order"))
    return read(spark, sf, "customer").select("c_custkey").join(counts, "c_custkey", "left").select("c_custkey", F.coalesce("n", F.lit(0)).alias("n_orders"), "last_order")


@query("top_children", "SELECT o_custkey, o_orderkey, o_totalprice, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey)::INT AS place FROM orders QUALIFY place <= 10")
def top_children(spark: SparkSession, sf: str) -> DataFrame:
    return tables.top_children(read(spark, sf, "orders"), "o_custkey", [F.desc("o_orderdate"), F.col("o_orderkey")], 10).select("o_custkey", "o_orderkey", "o_totalprice", "place")


@query("missing_ids", "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_custkey IS NOT NULL AND o_orderpriority LIKE '1%')")
def missing_ids(spark: SparkSession, sf: str) -> DataFrame:
    return read(spark, sf, "customer").join(read(spark, sf, "orders").where("o_orderpriority like '1%'"), F.col("c_custkey") == F.col("o_custkey"), "left_anti").select("c_custkey")


@query("stale_rows", "SELECT o_orderkey, total IS NULL AS absent FROM orders LEFT JOIN (SELECT l_orderkey, sum(l_quantity) AS total FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey WHERE total IS NULL OR total > 150")
def stale_rows(spark: SparkSession, sf: str) -> DataFrame:
    sums = read(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.sum("l_quantity").alias("total"))
    return read(spark, sf, "orders").select("o_orderkey").join(sums, "o_orderkey", "left").where("total is null or total > 150").select("o_orderkey", F.col("total").isNull().alias("absent"))


_UPSERT = "WITH s AS (SELECT o_orderkey AS id, o_totalprice AS price FROM orders), n AS (SELECT o_orderkey + CASE o_orderpriority WHEN '1-URGENT' THEN 1000000000 ELSE 0 END AS id, o_totalprice * 2 AS price FROM orders WHERE o_orderstatus = 'O') "


def _upsert_sides(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """All orders as stored; the open ones as changes, the urgent of them under new ids."""
    o = read(spark, sf, "orders")
    return o.selectExpr("o_orderkey as id", "o_totalprice as price"), o.where("o_orderstatus = 'O'").selectExpr("o_orderkey + if(o_orderpriority = '1-URGENT', 1000000000, 0) as id", "o_totalprice * 2 as price")


@query("upsert_result", _UPSERT + "SELECT coalesce(n.id, s.id) AS id, coalesce(n.price, s.price) AS price, CASE WHEN n.id IS NULL THEN 'kept' WHEN s.id IS NULL THEN 'inserted' ELSE 'updated' END AS action FROM s FULL JOIN n ON s.id = n.id")
def upsert_result(spark: SparkSession, sf: str) -> DataFrame:
    return tables.upsert(*_upsert_sides(spark, sf), "id")


@query("insert_ignore", _UPSERT + "SELECT * FROM s UNION ALL SELECT * FROM n WHERE id NOT IN (SELECT id FROM s)")
def insert_ignore(spark: SparkSession, sf: str) -> DataFrame:
    return tables.insert_ignore(*_upsert_sides(spark, sf), "id")


@query("dedupe_first", "SELECT o_custkey, o_orderkey, o_orderstatus FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) = 1")
def dedupe_first(spark: SparkSession, sf: str) -> DataFrame:
    return tables.keep_one(read(spark, sf, "orders"), ["o_custkey"], [F.col("o_orderdate"), F.col("o_orderkey")]).select("o_custkey", "o_orderkey", "o_orderstatus")


@query("dedupe_last", "SELECT o_custkey, o_orderkey, o_orderstatus FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1")
def dedupe_last(spark: SparkSession, sf: str) -> DataFrame:
    return tables.keep_one(read(spark, sf, "orders"), ["o_custkey"], [F.desc("o_orderdate"), F.desc("o_orderkey")]).select("o_custkey", "o_orderkey", "o_orderstatus")


@query("version_numbers", "SELECT conv_id, max(turn) + 1 AS next_version, count(*) AS n, arg_max(role, turn) AS last_role FROM conversations GROUP BY conv_id")
def version_numbers(spark: SparkSession, sf: str) -> DataFrame:
    return read(spark, sf, "conversations").groupBy("conv_id").agg((F.max("turn") + 1).alias("next_version"), F.count("*").alias("n"), F.max_by("role", "turn").alias("last_role"))


@query("recommended_flag", "SELECT conv_id, turn, coalesce(turn = max(turn) FILTER (role = 'assistant') OVER (PARTITION BY conv_id), false) AS recommended FROM conversations")
def recommended_flag(spark: SparkSession, sf: str) -> DataFrame:
    """One version of a session carries the flag: here the last turn of the assistant."""
    c = read(spark, sf, "conversations")
    last = c.groupBy("conv_id").agg(F.max(F.when(F.col("role") == "assistant", F.col("turn"))).alias("last"))
    return c.join(last, "conv_id").select("conv_id", "turn", F.coalesce(F.col("turn") == F.col("last"), F.lit(False)).alias("recommended"))


@query("timeline", "SELECT 'order' AS kind, o_orderkey::VARCHAR AS id, o_orderdate::DATE::VARCHAR AS day FROM orders UNION ALL SELECT 'shipment', l_orderkey || '-' || l_linenumber || '-' || l_partkey, l_shipdate::DATE::VARCHAR FROM lineitem UNION ALL SELECT 'event', event_id::VARCHAR, ts::DATE::VARCHAR FROM events ORDER BY day DESC, kind, id")
def timeline(spark: SparkSession, sf: str) -> DataFrame:
    one = lambda t, kind, i, at: read(spark, sf, t).select(F.lit(kind).alias("kind"), i.cast("string").alias("id"), F.to_date(at).cast("string").alias("day"))
    rows = one("orders", "order", F.col("o_orderkey"), "o_orderdate").unionByName(one("lineitem", "shipment", F.concat("l_orderkey", F.lit("-"), "l_linenumber", F.lit("-"), "l_partkey"), "l_shipdate")).unionByName(one("events", "event", F.col("event_id"), "ts"))
    return tables.sorted_in_parts(rows, [F.desc("day"), F.col("kind"), F.asc_nulls_last("id")])


@query("review_sample", "WITH c AS (SELECT l.doc_id, source, quality FROM labels l JOIN documents d ON l.doc_id = d.doc_id), r AS (SELECT *, row_number() OVER (PARTITION BY source, quality ORDER BY doc_id) AS q, 0 AS z FROM c), o AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY q > 1, quality DESC, doc_id)::INT AS place FROM r) SELECT source, doc_id, quality, place FROM o WHERE place <= 5")
def review_sample(spark: SparkSession, sf: str) -> DataFrame:
    """Of each source one good and one poor case first, then by id, five in all."""
    c = read(spark, sf, "labels").select("doc_id", "quality").join(read(spark, sf, "documents").select("doc_id", "source"), "doc_id")
    first = c.groupBy("source", "quality").agg(F.min("doc_id").alias("first"))
    c = c.join(first, ["source", "quality"]).withColumn("rest", F.col("doc_id") != F.col("first"))
    return tables.top_children(c, "source", [F.col("rest"), F.desc("quality"), F.col("doc_id")], 5).select("source", "doc_id", "quality", "place")


for _name, _step, _sql in (("week_windows", "7 days", "7 DAY"), ("month_windows", "1 month", "1 MONTH")):

    def _windows(spark: SparkSession, sf: str, step: str = _step) -> DataFrame:
        return tables.date_windows(read(spark, sf, "orders"), F.min("o_orderdate"), F.max("o_orderdate"), step).select(F.col("start").cast("string"), F.col("end").cast("string"))

    query(_name, f"WITH d AS (SELECT min(o_orderdate)::DATE AS lo, max(o_orderdate)::DATE AS hi FROM orders), s AS (SELECT hi, unnest(generate_series(lo::TIMESTAMP, hi::TIMESTAMP, INTERVAL {_sql}))::DATE AS start FROM d) SELECT start::VARCHAR AS start, least((start + INTERVAL {_sql})::DATE - 1, hi)::VARCHAR AS \"end\" FROM s")(_windows)


@query("cost_totals", f"SELECT {_SERVICE} AS service, count(*) AS n, count(*) FILTER (event_type = 'error') AS failed, round(sum(value) * 0.002, 4) AS cost FROM events GROUP BY 1")
def cost_totals(spark: SparkSession, sf: str) -> DataFrame:
    e = F.col("event_type")
    return read(spark, sf, "events").groupBy(F.when(e.isin("purchase", "click"), e).otherwise("other").alias("service")).agg(F.count("*").alias("n"), F.count_if(e == "error").alias("failed"), F.round(F.sum("value") * 0.002, 4).alias("cost"))


@query("correction_plan", "SELECT l_orderkey, l_linenumber, CASE l_returnflag WHEN 'R' THEN 'HIGH' WHEN 'A' THEN 'MEDIUM' ELSE 'LOW' END AS priority, row_number() OVER (PARTITION BY l_orderkey ORDER BY CASE l_returnflag WHEN 'R' THEN 0 WHEN 'A' THEN 1 ELSE 2 END, l_linenumber)::INT AS place FROM lineitem")
def correction_plan(spark: SparkSession, sf: str) -> DataFrame:
    r = F.col("l_returnflag")
    rows = read(spark, sf, "lineitem").withColumn("priority", F.when(r == "R", "HIGH").when(r == "A", "MEDIUM").otherwise("LOW"))
    order = F.when(F.col("priority") == "HIGH", 0).when(F.col("priority") == "MEDIUM", 1).otherwise(2)
    return tables.top_children(rows, "l_orderkey", [order, F.col("l_linenumber")], 1 << 30).select("l_orderkey", "l_linenumber", "priority", "place")


# Rules

#: Patterns that occur in the driver's prose; packs with real ones are passed in the same way.
MARK = "licensed under|copyright"
PACK = [
    rules.Rule("R1", "FATAL", reason="idiot|moron", outcome="the|de "),
    rules.Rule("R2", "WARNING", reason="version", veto="disclaimer"),
    rules.Rule("R3", "WARNING", reason="[a-z]", blocks=("apache", "version", "licen", "anon"), enough=1),
    rules.Rule("R4", "FATAL", outcome="scum|loser|trash"),
]
_SECTIONS = (
    "WITH b AS (SELECT doc_id, " + FOLD.format("text") + " AS whole FROM documents), "
    f"m AS (SELECT *, len(whole) AS n_chars, CASE WHEN regexp_extract(whole, '{MARK}') = '' THEN 0 ELSE instr(whole, regexp_extract(whole, '{MARK}')) END AS spot FROM b), "
    "c AS (SELECT *, CASE WHEN spot > 1 THEN spot - 1 ELSE floor(n_chars * 8 / 10)::INT END AS cut FROM m), "
    "s AS (SELECT doc_id, n_chars, whole, substring(whole, 1, cut) AS reasoning, substring(whole, cut + 1) AS outcome, spot > 1 AS marked FROM c), "
    "f AS (SELECT doc_id, 'R1' AS code, 'FATAL' AS severity FROM s WHERE n_chars >= 100 AND regexp_matches(reasoning, 'idiot|moron') AND regexp_matches(outcome, 'the|de ') "
    "UNION ALL SELECT doc_id, 'R2', 'WARNING' FROM s WHERE n_chars >= 100 AND regexp_matches(reasoning, 'version') AND NOT regexp_matches(whole, 'disclaimer') "
    "UNION ALL SELECT doc_id, 'R3', 'WARNING' FROM s WHERE n_chars >= 100 AND regexp_matches(reasoning, '[a-z]') AND NOT regexp_matches(whole, 'apache|version|licen|anon') "
    "UNION ALL SELECT doc_id, 'R4', 'FATAL' FROM s WHERE n_chars >= 100 AND regexp_matches(outcome, 'scum|loser|trash')) "
)


def _split(spark: SparkSession, sf: str) -> DataFrame:
    return rules.sections(read(spark, sf, "documents"), "text", MARK)


@query("section_split", _SECTIONS + "SELECT doc_id, len(reasoning) AS n_reasoning, len(outcome) AS n_outcome, marked FROM s")
def section_split(spark: SparkSession, sf: str) -> DataFrame:
    return _split(spark, sf).select("doc_id", F.char_length("reasoning").alias("n_reasoning"), F.char_length("outcome").alias("n_outcome"), "marked")


@query("contradiction_rules", _SECTIONS + "SELECT * FROM f")
def contradiction_rules(spark: SparkSession, sf: str) -> DataFrame:
    return rules.findings(_split(spark, sf), PACK, least_chars=100)


@query(
    "report_rollup",
    _SECTIONS + ", g AS (SELECT s.doc_id, s.marked, count(*) FILTER (f.severity = 'FATAL') AS n_fatal, count(*) FILTER (f.severity = 'WARNING') AS n_warning FROM s LEFT JOIN f ON s.doc_id = f.doc_id GROUP BY s.doc_id, s.marked), "
    "h AS (SELECT *, round((25 * greatest(0, 100 - 20 * n_fatal - 10 * n_warning - CASE WHEN marked THEN 0 ELSE 8 END) + 55 * greatest(0, 100 - 25 * n_fatal - 12 * n_warning) + 20 * greatest(0, 100 - 30 * n_fatal - 10 * n_warning)) / 100e0)::INT AS technical FROM g) "
    "SELECT doc_id, n_fatal, n_warning, technical, CASE n_fatal WHEN 0 THEN 100 WHEN 1 THEN 70 WHEN 2 THEN 40 ELSE 0 END AS viability, least(95, greatest(25, 80 - 15 * n_fatal - 2 * n_warning))::INT AS quick_score, "
    "CASE WHEN n_fatal > 0 THEN 'REJECT' WHEN technical >= 90 THEN 'APPROVE' WHEN technical >= 81 THEN 'CAVEATS' ELSE 'REJECT' END AS status FROM h",
)
def report_rollup(spark: SparkSession, sf: str) -> DataFrame:
    split = _split(spark, sf)
    return rules.report(split, rules.findings(split, PACK, least_chars=100))


# Streams

@query("event_windows_stream", "SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type, count(*) AS n, sum(value) AS total FROM events GROUP BY ALL")
def event_windows_stream(spark: SparkSession, sf: str) -> DataFrame:
    """The same windows that the stream appends, over the whole table."""
    return event_windows(read(spark, sf, "events")).withColumn("start", F.col("start").cast("timestamp_ntz"))
