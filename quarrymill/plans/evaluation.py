"""Queries that calibrate, compare and summarise: findings against feedback, regression cases, human reviews, joins and guards of runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarrymill.operators import calibration as K
from quarrymill.operators.guard import guard
from quarrymill.plans.catalog import _DECISIONS, _decisions, query, read, tokens_sql

#: lineitem as findings of executions (orders), and as feedback on types, of which one gets none.
_F = (
    "f AS (SELECT l_orderkey AS execution, l_linenumber AS pos, l_partkey, l_suppkey, l_returnflag || l_linestatus AS type, 0.75e0 + l_discount * 2 AS confidence, l_orderkey % 5 AS provider, "
    "CASE WHEN l_orderkey % 7 > 0 THEN 'd' || (l_orderkey % 7) END AS domain, l_orderkey % 997 AS ms FROM lineitem), "
    "fb AS (SELECT type, domain, (pos % 2)::INT AS useful FROM f WHERE pos <= 3 AND type <> 'AF'), "
    "t AS (SELECT type, sum(useful) AS useful, count(*) AS total FROM fb GROUP BY type) "
)


def _findings(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("l_orderkey")
    return read(spark, sf, "lineitem").select(
        k.alias("execution"), F.col("l_linenumber").alias("pos"), "l_partkey", "l_suppkey", F.concat("l_returnflag", "l_linestatus").alias("type"), (0.75 + F.col("l_discount") * 2).alias("confidence"),
        (k % 5).alias("provider"), F.when(k % 7 > 0, F.concat(F.lit("d"), (k % 7).cast("string"))).alias("domain"), (k % 997).alias("ms"),
    )


def _feedback(findings: DataFrame) -> DataFrame:
    return findings.where("pos <= 3 and type <> 'AF'").select("type", "domain", (F.col("pos") % 2).alias("useful"))


@query(
    "confidence_bands",
    f"WITH {_F}, b AS (SELECT CASE WHEN confidence < 0.8e0 THEN '0.75-0.79' WHEN confidence < 0.9e0 THEN '0.80-0.89' ELSE '0.90-1.00' END AS band, type FROM f WHERE confidence >= 0.75e0 AND confidence < 1.01e0) "
    "SELECT band, count(*) AS n, round(coalesce(100e0 * sum(useful) / sum(total), 0), 1) AS usefulness FROM b LEFT JOIN t USING (type) GROUP BY band",
)
def confidence_bands(spark: SparkSession, sf: str) -> DataFrame:
    f = _findings(spark, sf)
    return K.confidence_bands(f, _feedback(f))


@query(
    "domain_calibration",
    f"WITH {_F}, d AS (SELECT coalesce(domain, 'desconhecido') AS domain, * EXCLUDE (domain) FROM f), e AS (SELECT domain, count(DISTINCT execution) AS executions, round(count(*) / count(DISTINCT execution), 2) AS mean_findings FROM d GROUP BY domain), "
    "c AS (SELECT domain, type, count(*) AS n FROM d GROUP BY ALL), u AS (SELECT coalesce(domain, 'desconhecido') AS domain, type, round(100e0 * sum(useful) / count(*), 1) AS usefulness FROM fb GROUP BY ALL), "
    "r AS (SELECT *, row_number() OVER (PARTITION BY domain ORDER BY n DESC, type)::INT AS place FROM c) SELECT domain, executions, mean_findings, type, n, place, coalesce(usefulness, 0) AS usefulness FROM r JOIN e USING (domain) LEFT JOIN u USING (domain, type) WHERE place <= 5",
)
def domain_calibration(spark: SparkSession, sf: str) -> DataFrame:
    f = _findings(spark, sf)
    return K.domain_calibration(f, _feedback(f))


@query(
    "provider_comparison",
    f"WITH {_F}, x AS (SELECT DISTINCT provider, execution, ms FROM f), e AS (SELECT provider, count(*) AS executions, round(avg(ms))::BIGINT AS mean_ms FROM x GROUP BY provider), n AS (SELECT provider, count(*) AS n FROM f GROUP BY provider), "
    "u AS (SELECT provider, sum(useful) AS useful, sum(total) AS total FROM (SELECT DISTINCT provider, type FROM f) JOIN t USING (type) GROUP BY provider) "
    "SELECT provider, executions, round(n / executions, 2) AS mean_findings, mean_ms, round(100e0 * useful / total, 1) AS usefulness FROM e JOIN n USING (provider) LEFT JOIN u USING (provider)",
)
def provider_comparison(spark: SparkSession, sf: str) -> DataFrame:
    f = _findings(spark, sf)
    return K.provider_comparison(f, _feedback(f))


@query(
    "best_examples",
    f"WITH {_F}, r AS (SELECT *, row_number() OVER (PARTITION BY type ORDER BY execution, pos, l_partkey, l_suppkey)::INT AS place FROM f) "
    "SELECT type, place, execution, pos, coalesce(useful, 0)::BIGINT AS useful FROM r LEFT JOIN t USING (type) WHERE place <= 3 ORDER BY useful DESC, type, place LIMIT 20",
)
def best_examples(spark: SparkSession, sf: str) -> DataFrame:
    f = _findings(spark, sf)
    return K.best_examples(f, _feedback(f), ["execution", "pos", "l_partkey", "l_suppkey"]).select("type", "place", "execution", "pos", "useful")


@query(
    "recommendations",
    f"WITH {_F}, n AS (SELECT type, count(*) AS n, round(count(DISTINCT execution) / (SELECT count(DISTINCT execution) FROM f), 3) AS g FROM f GROUP BY type), q AS (SELECT type, n, g, coalesce(100e0 * useful / total, 0) AS u FROM n LEFT JOIN t USING (type)) "
    "SELECT CASE WHEN u < 30 AND n >= 5 THEN 'HIGH' ELSE 'MEDIUM' END AS severity, 'usefulness' AS reason, type FROM q WHERE (u < 30 AND n >= 5) OR (u < 50 AND n >= 3) "
    "UNION ALL SELECT 'MEDIUM', 'generic', type FROM q WHERE g > 0.4e0 UNION ALL SELECT 'LOW', 'no feedback', type FROM n WHERE type NOT IN (SELECT type FROM fb)",
)
def recommendations(spark: SparkSession, sf: str) -> DataFrame:
    f = _findings(spark, sf)
    return K.recommendations(f, _feedback(f), generic=0.4)


@query("opportunity_dist", f"WITH {_F} SELECT CASE WHEN confidence >= 0.9e0 THEN 'HIGH' WHEN confidence >= 0.8e0 THEN 'MEDIUM' ELSE 'LOW' END AS level, count(*) AS n FROM f GROUP BY 1")
def opportunity_dist(spark: SparkSession, sf: str) -> DataFrame:
    c = F.col("confidence")
    return _findings(spark, sf).groupBy(F.when(c >= 0.9, "HIGH").when(c >= 0.8, "MEDIUM").otherwise("LOW").alias("level")).agg(F.count("*").alias("n"))


#: Labelled documents as regression cases: a good one expects no finding, so any finding there is a false positive.
_C = (
    "c AS (SELECT d.doc_id, lang AS domain, source AS provider, CASE quality WHEN 1 THEN 'GOOD' ELSE 'BAD' END AS quality, CASE quality WHEN 1 THEN 0 ELSE toxic END AS expected, regexp_matches(lower(coalesce(text, '')), 'idiot|moron|scum|loser')::INT AS actual, (n_chars > 500)::INT AS score_pass FROM labels l JOIN documents d USING (doc_id)), "
    "p AS (SELECT *, (expected = actual)::INT AS pass, (expected = 0 OR actual = 1)::INT AS finding_pass FROM c) "
)


def _cases(spark: SparkSession, sf: str) -> DataFrame:
    docs = read(spark, sf, "documents").select("doc_id", F.col("lang").alias("domain"), F.col("source").alias("provider"), F.lower(F.coalesce("text", F.lit(""))).rlike("idiot|moron|scum|loser").cast("int").alias("actual"), (F.col("n_chars") > 500).cast("int").alias("score_pass"))
    good = F.col("quality") == 1
    out = read(spark, sf, "labels").join(docs, "doc_id").select("doc_id", "domain", "provider", F.when(good, "GOOD").otherwise("BAD").alias("quality"), F.when(good, 0).otherwise(F.col("toxic")).alias("expected"), "actual", "score_pass")
    return out.withColumns({"pass": (F.col("expected") == F.col("actual")).cast("int"), "finding_pass": ((F.col("expected") == 0) | (F.col("actual") == 1)).cast("int")})


@query(
    "regression_summary",
    f"WITH {_C} SELECT CASE WHEN grouping(domain) = 0 THEN 'domain' WHEN grouping(quality) = 0 THEN 'quality' ELSE 'ALL' END AS dim, coalesce(domain, quality, 'ALL') AS value, count(*) AS total, sum(pass)::BIGINT AS passed, count(*) - sum(pass)::BIGINT AS failed, "
    "round(avg(pass), 6) AS pass_rate, round(avg(score_pass), 6) AS score_pass_rate, round(avg(finding_pass), 6) AS finding_pass_rate FROM p GROUP BY GROUPING SETS ((), (domain), (quality))",
)
def regression_summary(spark: SparkSession, sf: str) -> DataFrame:
    return K.regression_summary(_cases(spark, sf))


@query(
    "provider_ranking",
    f"WITH {_C}, s AS (SELECT provider, count(*) AS n, sum((expected = 1 AND actual = 1)::INT) AS tp, sum((expected = 0 AND actual = 1)::INT) AS fp, sum((expected = 1 AND actual = 0)::INT) AS fn, avg(pass) AS cp, avg(score_pass) AS sp FROM p WHERE provider <> 'src3' GROUP BY provider), "
    "r AS (SELECT *, CASE WHEN tp + fp = 0 THEN (CASE WHEN tp + fn = 0 THEN 1e0 ELSE 0e0 END) ELSE tp / (tp + fp) END AS p, CASE WHEN tp + fn = 0 THEN 1e0 ELSE tp / (tp + fn) END AS r FROM s), "
    "k AS (SELECT *, round(0.40e0 * CASE WHEN p + r = 0 THEN 0 ELSE 2 * p * r / (p + r) END + 0.25e0 * p + 0.20e0 * r + 0.10e0 * cp + 0.05e0 * sp, 6) AS composite FROM r) SELECT provider, fp::BIGINT AS fp, fn::BIGINT AS fn, composite, rank() OVER (ORDER BY composite DESC)::INT AS place FROM k",
)
def provider_ranking(spark: SparkSession, sf: str) -> DataFrame:
    return K.provider_ranking(_cases(spark, sf), failed=["src3"])


@query(
    "human_review_slices",
    "WITH e AS (SELECT d.doc_id, source AS provider, lang AS domain, quality AS correct, 1 - toxic AS relevant, (n_chars % 2)::INT AS actionable, (1 + d.doc_id % 5)::INT AS score FROM labels l JOIN documents d USING (doc_id)), "
    "s AS (SELECT CASE WHEN grouping(provider) = 0 THEN 'provider' WHEN grouping(domain) = 0 THEN 'domain' ELSE 'ALL' END AS dim, coalesce(provider, domain, 'ALL') AS value, count(*) AS n, avg(correct) AS c, avg(relevant) AS r, avg(actionable) AS a, avg(score) AS m FROM e GROUP BY GROUPING SETS ((), (provider), (domain))) "
    "SELECT dim, value, n, round(c, 6) AS correct_rate, round(r, 6) AS relevance_rate, round(a, 6) AS actionability_rate, round(m, 6) AS mean_score, round(0.4e0 * c + 0.3e0 * r + 0.2e0 * a + 0.1e0 * (m - 1) / 4, 6) AS validated_quality FROM s",
)
def human_review_slices(spark: SparkSession, sf: str) -> DataFrame:
    docs = read(spark, sf, "documents").select("doc_id", F.col("source").alias("provider"), F.col("lang").alias("domain"), (F.col("n_chars") % 2).alias("actionable"))
    rows = read(spark, sf, "labels").join(docs, "doc_id").select("provider", "domain", F.col("quality").alias("correct"), (1 - F.col("toxic")).alias("relevant"), "actionable", (1 + F.col("doc_id") % 5).alias("score"))
    return K.review_slices(rows, ["provider", "domain"])


@query(
    "usage_window",
    "WITH q AS (SELECT unnest(['', '7', '500', 'x', '0']) AS asked), n AS (SELECT asked, CASE WHEN coalesce(try_cast(asked AS INT), 0) = 0 THEN 30 ELSE least(90, try_cast(asked AS INT)) END AS days FROM q), m AS (SELECT max(ts) AS now FROM events) "
    "SELECT asked, days, count(ts) AS n FROM n, m LEFT JOIN events ON ts >= now - to_days(days) GROUP BY asked, days",
)
def usage_window(spark: SparkSession, sf: str) -> DataFrame:
    events = read(spark, sf, "events")
    return K.counted_in_windows(events, "ts", events.agg(F.max("ts").alias("now")), ["", "7", "500", "x", "0"])


@query("max_cast", "SELECT lang, max(coalesce(try_cast(substr(source, 4) AS INT), 0)) AS largest FROM documents GROUP BY lang")
def max_cast(spark: SparkSession, sf: str) -> DataFrame:
    """Text that is no number counts as 0."""
    return read(spark, sf, "documents").groupBy("lang").agg(F.max(F.coalesce(F.substring("source", 4, 20).try_cast("int"), F.lit(0))).alias("largest"))


@query("audit_rates", f"WITH d AS ({_DECISIONS}) SELECT count(*) AS total, count(*) FILTER (status = 'APPROVED') AS approved, count(*) FILTER (status = 'REJECTED') AS rejected, round(100e0 * count(*) FILTER (status = 'APPROVED') / count(*), 6) AS approval_rate, round(100e0 * count(*) FILTER (status = 'REJECTED') / count(*), 6) AS rejection_rate FROM d")
def audit_rates(spark: SparkSession, sf: str) -> DataFrame:
    """Rates over all audits, answered or not."""
    s, n = F.col("status"), F.nullif(F.count("*"), F.lit(0))
    return _decisions(spark, sf).agg(F.count("*").alias("total"), *[F.count_if(s == k.upper()).alias(k) for k in ("approved", "rejected")], *[F.round(100e0 * F.count_if(s == k) / n, 6).alias(r) for k, r in (("APPROVED", "approval_rate"), ("REJECTED", "rejection_rate"))])


@query(
    "audit_top_codes",
    f"WITH d AS ({_DECISIONS}), x AS (SELECT unnest(['warning', 'fatal', 'area']) AS kind, unnest([CASE WHEN status = 'PENDING' THEN rule END, CASE WHEN status = 'REJECTED' THEN coalesce(nullif(rule, '2-HIGH'), 'UNKNOWN') END, area]) AS code FROM d), "
    "c AS (SELECT kind, code, count(*) AS n FROM x WHERE code IS NOT NULL GROUP BY ALL) SELECT kind, code, n, row_number() OVER (PARTITION BY kind ORDER BY n DESC, code)::INT AS place FROM c QUALIFY place <= 10",
)
def audit_top_codes(spark: SparkSession, sf: str) -> DataFrame:
    """Ten most frequent warnings, fatal codes (a missing code counts as UNKNOWN) and areas."""
    s = F.col("status")
    return K.top_codes(_decisions(spark, sf), {"warning": F.when(s == "PENDING", F.col("rule")), "fatal": F.when(s == "REJECTED", F.coalesce(F.nullif("rule", F.lit("2-HIGH")), F.lit("UNKNOWN"))), "area": F.col("area")}, 10)


@query("first_examples", "SELECT conv_id, turn, text FROM conversations WHERE trim(coalesce(text, '')) <> '' ORDER BY conv_id, turn, text LIMIT 50")
def first_examples(spark: SparkSession, sf: str) -> DataFrame:
    """The first 50 in record order, blanks skipped."""
    return read(spark, sf, "conversations").where("trim(coalesce(text, '')) <> ''").orderBy("conv_id", "turn", "text").limit(50).select("conv_id", "turn", "text")


_PAIRS = "e AS (SELECT DISTINCT l_orderkey AS k, l_linenumber AS rule FROM lineitem WHERE l_returnflag = 'R'), a AS (SELECT DISTINCT l_orderkey AS k, l_linenumber AS rule FROM lineitem WHERE l_linestatus = 'F')"


@query("rule_corpus_metrics", f"WITH {_PAIRS} SELECT rule, count(*) FILTER (e.k IS NOT NULL AND a.k IS NOT NULL) AS tp, count(*) FILTER (e.k IS NULL) AS fp, count(*) FILTER (a.k IS NULL) AS fn FROM e FULL JOIN a USING (k, rule) GROUP BY rule")
def rule_corpus_metrics(spark: SparkSession, sf: str) -> DataFrame:
    items = read(spark, sf, "lineitem").select(F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("rule"), "l_returnflag", "l_linestatus")
    return K.rule_metrics(items.where("l_returnflag = 'R'").select("k", "rule"), items.where("l_linestatus = 'F'").select("k", "rule"))


@query(
    "reaudit_metrics",
    "WITH o AS (SELECT *, (o_orderpriority = '1-URGENT')::INT AS fatal, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS i, count(*) OVER (PARTITION BY o_custkey) AS n FROM orders), "
    "x AS (SELECT b.o_custkey, b.o_totalprice AS score_before, a.o_totalprice AS score_after, b.fatal AS fatal_before, a.fatal AS fatal_after FROM o b JOIN o a ON b.o_custkey = a.o_custkey AND b.i = 1 AND a.i = a.n WHERE a.n > 1) "
    "SELECT *, round(score_after - score_before, 6) AS delta, score_after > score_before OR fatal_after < fatal_before AS improved, score_after < score_before OR fatal_after > fatal_before AS regressed FROM x",
)
def reaudit_metrics(spark: SparkSession, sf: str) -> DataFrame:
    """First audit of each subject against its last. Both flags may hold."""
    x = F.struct("o_orderdate", "o_orderkey", F.col("o_totalprice").alias("score"), (F.col("o_orderpriority") == "1-URGENT").cast("int").alias("fatal"))
    return K.before_and_after(read(spark, sf, "orders"), "o_custkey", x)


@query("status_expected", "WITH s AS (SELECT o_orderkey, CASE WHEN o_orderpriority = '1-URGENT' THEN 'FATAL' WHEN o_orderstatus = 'P' THEN 'BLOCKED' WHEN o_totalprice > 250000 THEN 'WARNING' ELSE 'PASS' END AS status, CASE WHEN o_orderstatus = 'F' THEN 'PASS' ELSE 'WARNING' END AS expected FROM orders) SELECT status, expected, count(*) AS n, count(*) FILTER (status = expected) AS as_expected FROM s GROUP BY ALL")
def status_expected(spark: SparkSession, sf: str) -> DataFrame:
    status = F.when(F.col("o_orderpriority") == "1-URGENT", "FATAL").when(F.col("o_orderstatus") == "P", "BLOCKED").when(F.col("o_totalprice") > 250000, "WARNING").otherwise("PASS")
    rows = read(spark, sf, "orders").select(status.alias("status"), F.when(F.col("o_orderstatus") == "F", "PASS").otherwise("WARNING").alias("expected"))
    return rows.groupBy("status", "expected").agg(F.count("*").alias("n"), F.count_if(F.col("status") == F.col("expected")).alias("as_expected"))


@query("presence_counts", "WITH c AS (SELECT conv_id, count(*) AS turns, bool_or(role = 'user') AS any_user, sum(length(text)) AS chars, sum((role = 'assistant')::INT) AS answers FROM conversations GROUP BY conv_id) SELECT count(*) AS n, count(*) FILTER (any_user) AS with_user, count(*) FILTER (answers > 1) AS with_answers, sum(turns)::BIGINT AS turns, sum(chars)::BIGINT AS chars FROM c")
def presence_counts(spark: SparkSession, sf: str) -> DataFrame:
    c = read(spark, sf, "conversations").groupBy("conv_id").agg(F.count("*").alias("turns"), F.bool_or(F.col("role") == "user").alias("any_user"), F.sum(F.length("text")).alias("chars"), F.count_if(F.col("role") == "assistant").alias("answers"))
    return c.agg(F.count("*").alias("n"), F.count_if("any_user").alias("with_user"), F.count_if(F.col("answers") > 1).alias("with_answers"), F.sum("turns").alias("turns"), F.sum("chars").alias("chars"))


@query("runs_to_do", "WITH c AS (SELECT n_nationkey AS case_id, unnest([0, 1, 2, 3, 4]) AS provider FROM nation), done AS (SELECT DISTINCT s_nationkey AS case_id, (s_suppkey % 5)::INT AS provider FROM supplier) SELECT case_id, provider FROM c ANTI JOIN done USING (case_id, provider)")
def runs_to_do(spark: SparkSession, sf: str) -> DataFrame:
    """Every case with every provider, without those that are done."""
    cases = read(spark, sf, "nation").select(F.col("n_nationkey").alias("case_id"))
    done = read(spark, sf, "supplier").select(F.col("s_nationkey").alias("case_id"), (F.col("s_suppkey") % 5).cast("int").alias("provider"))
    return K.runs_to_do(cases, list(range(5)), done)


@query("composite_join", "WITH a AS (SELECT l_orderkey AS k, l_suppkey % 5 AS provider, count(*) AS n FROM lineitem GROUP BY ALL) SELECT o_orderkey AS k, provider, n, o_orderstatus AS status FROM orders JOIN a ON o_orderkey = k AND o_custkey % 5 = provider")
def composite_join(spark: SparkSession, sf: str) -> DataFrame:
    a = read(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("k"), (F.col("l_suppkey") % 5).alias("provider")).agg(F.count("*").alias("n"))
    return read(spark, sf, "orders").select(F.col("o_orderkey").alias("k"), (F.col("o_custkey") % 5).alias("provider"), F.col("o_orderstatus").alias("status")).join(a, ["k", "provider"])


@query("first_match_join", "WITH f AS (SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) = 1) SELECT o_orderkey, coalesce(l_linenumber, -1)::BIGINT AS l_linenumber, coalesce(l_partkey, -1) AS l_partkey FROM orders LEFT JOIN f ON o_orderkey = l_orderkey")
def first_match_join(spark: SparkSession, sf: str) -> DataFrame:
    first = read(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.min(F.struct("l_linenumber", "l_partkey", "l_suppkey")).alias("x"))
    return read(spark, sf, "orders").select("o_orderkey").join(first, "o_orderkey", "left").select("o_orderkey", F.coalesce(F.col("x.l_linenumber").cast("long"), F.lit(-1)).alias("l_linenumber"), F.coalesce("x.l_partkey", F.lit(-1)).alias("l_partkey"))


@query(
    "overlap_match_multiset",
    "WITH e AS (SELECT item_id, list_distinct(" + tokens_sql("text", 3) + ") AS w FROM benchmark), x AS (SELECT item_id, greatest(1, ceil(len(w) * 0.3e0)::INT) AS need, unnest(w) AS word FROM e), "
    "d AS (SELECT conv_id, turn, unnest(" + tokens_sql("text", 3) + ") AS word FROM conversations) SELECT item_id, conv_id, turn, count(*) AS hits FROM d JOIN x USING (word) GROUP BY item_id, conv_id, turn, need HAVING count(*) >= need",
)
def overlap_match_multiset(spark: SparkSession, sf: str) -> DataFrame:
    return K.multiset_overlap(read(spark, sf, "benchmark"), read(spark, sf, "conversations"), ["conv_id", "turn"])


@query("domain_lookup", "SELECT doc_id, coalesce(CASE regexp_extract(source, '^[a-z]+([0-9])', 1) WHEN '0' THEN 'civil' WHEN '1' THEN 'labour' WHEN '2' THEN 'tax' END, 'general') AS domain FROM documents")
def domain_lookup(spark: SparkSession, sf: str) -> DataFrame:
    """A domain by the prefix of an id, with a default row."""
    return read(spark, sf, "documents").select("doc_id", K.lookup(F.regexp_extract("source", "^[a-z]+([0-9])", 1), {"0": "civil", "1": "labour", "2": "tax"}, "general").alias("domain"))


@query("missing_fields", "SELECT unnest(['text', 'lang', 'source', 'short_text']) AS field, unnest([count(*) FILTER (text IS NULL), count(*) FILTER (lang IS NULL), count(*) FILTER (source IS NULL), count(*) FILTER (length(text) < 100)]) AS missing, unnest([round((1 - count(*) FILTER (text IS NULL) / count(*)) * 100, 6), round((1 - count(*) FILTER (lang IS NULL) / count(*)) * 100, 6), round((1 - count(*) FILTER (source IS NULL) / count(*)) * 100, 6), round((1 - count(*) FILTER (length(text) < 100) / count(*)) * 100, 6)]) AS pct_filled FROM documents")
def missing_fields(spark: SparkSession, sf: str) -> DataFrame:
    docs = read(spark, sf, "documents")
    return K.missing(docs, {"text": F.col("text").isNull(), "lang": F.col("lang").isNull(), "source": F.col("source").isNull(), "short_text": F.length("text") < 100})


@query("history_filter", "SELECT o_orderkey, o_orderdate::VARCHAR AS at FROM orders WHERE o_orderstatus = 'F' AND o_orderpriority IN ('1-URGENT', '2-HIGH') AND o_totalprice >= 100000 ORDER BY o_orderdate DESC, o_orderkey LIMIT 50")
def history_filter(spark: SparkSession, sf: str) -> DataFrame:
    found = K.history(read(spark, sf, "orders"), {"o_orderstatus": ["F"], "o_orderpriority": ["1-URGENT", "2-HIGH"], "o_custkey": []}, F.col("o_totalprice") >= 100000, [F.desc("o_orderdate"), F.col("o_orderkey")], 50)
    return found.select("o_orderkey", F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss").alias("at"))


@query("mode_ladder", "SELECT o_orderkey, CASE WHEN o_totalprice < 5000 THEN 'SAFE_SKELETON' WHEN o_orderstatus = 'P' THEN 'TEMPLATE_MODEL' WHEN o_orderpriority = '1-URGENT' AND o_totalprice < 50000 THEN 'SAFE_SKELETON' ELSE 'FINAL_DRAFT' END AS mode FROM orders")
def mode_ladder(spark: SparkSession, sf: str) -> DataFrame:
    """The first rule that holds names the mode."""
    price = F.col("o_totalprice")
    rules = [(price < 5000, "SAFE_SKELETON"), (F.col("o_orderstatus") == "P", "TEMPLATE_MODEL"), ((F.col("o_orderpriority") == "1-URGENT") & (price < 50000), "SAFE_SKELETON")]
    return read(spark, sf, "orders").select("o_orderkey", K.first_of(rules, "FINAL_DRAFT").alias("mode"))


@query(
    "confidence_score",
    "WITH x AS (SELECT o_orderkey, CASE WHEN o_totalprice < 5000 THEN 'SAFE_SKELETON' WHEN o_orderstatus = 'P' THEN 'TEMPLATE_MODEL' ELSE 'FINAL_DRAFT' END AS mode, (o_custkey % 11) / 10e0 AS c, o_orderkey % 5 AS facts, o_orderkey % 3 AS claims, o_custkey % 4 AS theses, o_orderkey % 3 AS q, o_totalprice / 4000 AS audit, o_custkey % 7 AS g, o_orderpriority = '1-URGENT' AS fatal FROM orders), "
    "w AS (SELECT *, floor((least(c, 1) * 0.20e0 + least(facts / 3, 1) * 0.18e0 + least(claims / 2, 1) * 0.13e0 + (CASE WHEN claims > 0 THEN least(theses / claims, 1) ELSE 0.5e0 END) * 0.18e0 + (CASE q WHEN 0 THEN 1e0 WHEN 1 THEN 0.5e0 ELSE 0.2e0 END) * 0.10e0 + least(audit / 100, 1) * 0.15e0 + (1 - least(g * 0.05e0, 0.25e0)) * 0.06e0) * 100 + 0.5e0) / 100 AS s FROM x), "
    "m AS (SELECT *, CASE mode WHEN 'SAFE_SKELETON' THEN 0.2e0 WHEN 'TEMPLATE_MODEL' THEN 0.5e0 ELSE greatest(0, s) END AS k FROM w) SELECT o_orderkey, mode, round(CASE WHEN mode = 'FINAL_DRAFT' THEN least(k, CASE WHEN fatal THEN 0.49e0 ELSE 1 END, CASE WHEN g >= 3 THEN 0.69e0 ELSE 1 END) ELSE k END, 6) AS confidence FROM m",
)
def confidence_score(spark: SparkSession, sf: str) -> DataFrame:
    k, u = F.col("o_orderkey"), F.col("o_custkey")
    mode = K.first_of([(F.col("o_totalprice") < 5000, "SAFE_SKELETON"), (F.col("o_orderstatus") == "P", "TEMPLATE_MODEL")], "FINAL_DRAFT")
    score = K.confidence(mode, u % 11 / 10, k % 5, k % 3, u % 4, K.lookup((k % 3).cast("string"), {"0": "SUFICIENTE", "1": "PARCIAL"}, "INSUFICIENTE"), F.col("o_totalprice") / 4000, u % 7, F.col("o_orderpriority") == "1-URGENT")
    return read(spark, sf, "orders").select("o_orderkey", mode.alias("mode"), F.round(score, 6).alias("confidence"))


@query(
    "status_ladder",
    "WITH x AS (SELECT o_orderkey, CASE WHEN o_totalprice < 5000 THEN 'SAFE_SKELETON' WHEN o_totalprice < 9000 THEN 'TEMPLATE_MODEL' ELSE 'FINAL_DRAFT' END AS mode, (o_custkey % 101)::INT AS score, o_orderpriority = '1-URGENT' AS fatal FROM orders), "
    "s AS (SELECT *, CASE WHEN mode <> 'FINAL_DRAFT' THEN 'APROVADA COM RESSALVAS' WHEN fatal THEN 'REPROVADA' WHEN score >= 90 THEN 'MINUTA APROVADA' WHEN score >= 81 THEN 'APROVADA COM RESSALVAS' ELSE 'REPROVADA' END AS status FROM x) SELECT o_orderkey, status, status = 'REPROVADA' AS blocked FROM s",
)
def status_ladder(spark: SparkSession, sf: str) -> DataFrame:
    price = F.col("o_totalprice")
    status = K.document_status(K.first_of([(price < 5000, "SAFE_SKELETON"), (price < 9000, "TEMPLATE_MODEL")], "FINAL_DRAFT"), F.col("o_custkey") % 101, F.col("o_orderpriority") == "1-URGENT")
    return read(spark, sf, "orders").select("o_orderkey", status.alias("status"), (status == "REPROVADA").alias("blocked"))


@query("first_seen_ids", "WITH f AS (SELECT text, min(conv_id * 1000 + turn) AS seen FROM conversations WHERE role = 'user' GROUP BY text) SELECT md5(text) AS item, seen, row_number() OVER (ORDER BY seen, md5(text)) AS id FROM f")
def first_seen_ids(spark: SparkSession, sf: str) -> DataFrame:
    """Ids by first occurrence, from one range-partitioned sort."""
    rows = read(spark, sf, "conversations").where("role = 'user'").select(F.md5(F.encode("text", "UTF-8")).alias("item"), (F.col("conv_id") * 1000 + F.col("turn")).alias("seen"))
    return K.numbered(rows.groupBy("item").agg(F.min("seen").alias("seen")), ["seen", "item"], "id")


@query(
    "quota_cycles",
    "WITH RECURSIVE a AS (SELECT c_custkey, DATE '1990-01-01' + (c_custkey * 7 % 12400)::INT AS s FROM customer), r AS (SELECT c_custkey, s, s AS e FROM a UNION ALL SELECT c_custkey, e, least((e + INTERVAL 1 MONTH)::DATE, last_day(date_trunc('month', e) + INTERVAL 1 MONTH)) FROM r WHERE e <= DATE '2024-07-15') "
    "SELECT c_custkey, max_by(s, e)::VARCHAR AS cycle_start, max(e)::VARCHAR AS cycle_end FROM r GROUP BY c_custkey",
)
def quota_cycles(spark: SparkSession, sf: str) -> DataFrame:
    """Monthly cycles rolled forward until they end after a date; the day is clamped each month and stays clamped."""
    start = F.date_add(F.lit("1990-01-01").cast("date"), (F.col("c_custkey") * 7 % 12400).cast("int"))
    return K.rolled_cycles(read(spark, sf, "customer").select("c_custkey", start.alias("start")), "2024-07-15").select("c_custkey", F.col("cycle_start").cast("string").alias("cycle_start"), F.col("cycle_end").cast("string").alias("cycle_end"))


@query("cost_estimates", "SELECT event_id, greatest(1, length(props) // 4)::BIGINT AS tokens_floor, ceil(length(props) / 3.5e0)::BIGINT AS tokens_ceil, round(length(props) / 1e3 * CASE event_type WHEN 'purchase' THEN 0.5e0 WHEN 'click' THEN 0.1e0 ELSE 0.05e0 END + value / 1e3 * CASE event_type WHEN 'purchase' THEN 1.5e0 WHEN 'click' THEN 0.4e0 ELSE 0.1e0 END, 9) AS cost FROM events")
def cost_estimates(spark: SparkSession, sf: str) -> DataFrame:
    """Estimated tokens of a text, and the cost of tokens in and out by rates for a thousand."""
    n = F.length("props")
    rates = {"purchase": (0.5, 1.5), "click": (0.1, 0.4)}
    return read(spark, sf, "events").select("event_id", F.greatest(F.lit(1), F.floor(n / 4)).cast("long").alias("tokens_floor"), F.ceil(n / 3.5).cast("long").alias("tokens_ceil"), F.round(K.cost(F.col("event_type"), n, F.col("value"), rates, (0.05, 0.1)), 9).alias("cost"))


@query("future_capped", "WITH c AS (SELECT event_type, least(ts::DATE, DATE '2024-01-20') AS day FROM events) SELECT event_type, max(day)::VARCHAR AS last_day, count(*) FILTER (day = DATE '2024-01-20') AS n_capped FROM c GROUP BY event_type")
def future_capped(spark: SparkSession, sf: str) -> DataFrame:
    """Dates beyond a day count as that day."""
    day = F.least(F.to_date("ts"), F.lit("2024-01-20").cast("date"))
    return read(spark, sf, "events").select("event_type", day.alias("day")).groupBy("event_type").agg(F.max("day").cast("string").alias("last_day"), F.count_if(F.col("day") == F.lit("2024-01-20").cast("date")).alias("n_capped"))


@query("since_dates", "WITH q AS (SELECT unnest(['2024-01-10', NULL]) AS asked), c AS (SELECT user_id, max(ts)::DATE AS cursor FROM events WHERE event_type = 'purchase' GROUP BY user_id), u AS (SELECT DISTINCT user_id FROM events) SELECT user_id, asked, coalesce(asked::DATE, cursor - 3, DATE '2024-01-01')::VARCHAR AS since FROM u LEFT JOIN c USING (user_id), q")
def since_dates(spark: SparkSession, sf: str) -> DataFrame:
    """Where a source resumes: the date asked for, else three days before its cursor, else the year's first day."""
    events = read(spark, sf, "events")
    cursors = events.where("event_type = 'purchase'").groupBy("user_id").agg(F.to_date(F.max("ts")).alias("cursor"))
    asked = F.explode(F.array(F.lit("2024-01-10"), F.lit(None).cast("string"))).alias("asked")
    return events.select("user_id").distinct().join(cursors, "user_id", "left").select("user_id", "cursor", asked).select("user_id", "asked", K.since(F.col("asked").cast("date"), F.col("cursor"), 3, "2024-01-01").cast("string").alias("since"))


@query(
    "cost_guard",
    "WITH i AS (SELECT l_returnflag || l_linestatus AS run, {'c': round(l_extendedprice * 100)::BIGINT, 'spent': 0::BIGINT, 'n': 0::BIGINT, 'last': l_orderkey * 10 + l_linenumber} AS x FROM lineitem), "
    "r AS (SELECT run, count(*) AS items, list(x ORDER BY x.last) AS x FROM i GROUP BY run), "
    "f AS (SELECT run, items, list_reduce(list_prepend({'c': 0::BIGINT, 'spent': 0::BIGINT, 'n': 0::BIGINT, 'last': -1::BIGINT}, x), lambda a, b: CASE WHEN a.spent + b.c <= 20000000000 THEN {'c': 0::BIGINT, 'spent': a.spent + b.c, 'n': a.n + 1, 'last': b.last} ELSE a END) AS a FROM r) "
    "SELECT run, items, a.n AS accepted, a.spent AS spent, a.last AS last_accepted FROM f",
)
def cost_guard(spark: SparkSession, sf: str) -> DataFrame:
    """Items in order, each accepted if the run's costs stay within 200 million; a rejected one adds nothing. Two runs have most items."""
    items = read(spark, sf, "lineitem").select(F.concat("l_returnflag", "l_linestatus").alias("run"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("item"), F.round(F.col("l_extendedprice") * 100).cast("long").alias("cents"))
    out = guard(items, "run", ["item"], F.col("cents"), F.lit(20_000_000_000))
    took = F.col("accepted")
    return out.groupBy("run").agg(F.count("*").alias("items"), F.count_if(took).alias("accepted"), F.max("spent").alias("spent"), F.coalesce(F.max(F.when(took, F.col("item"))), F.lit(-1)).alias("last_accepted"))
