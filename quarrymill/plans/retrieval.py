"""Queries through a built index: scores, the best of them, total hits, spellings, stemmed Portuguese."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrymill.functions import portuguese
from quarrymill.functions.text import tokens
from quarrymill.operators import index as I
from quarrymill.plans.catalog import _BM25, TERMS, query, read, tokens_sql
from quarrymill.sources.shared import Store, fresh_path

WEIGHTS = {"head": 2.0, "body": 1.0}
_built: dict[tuple, I.Index] = {}


def _index(spark: SparkSession, sf: str, language: str | None = None) -> I.Index:
    """The index over documents: first line and whole text. A session builds it once for each folder."""
    at = (spark.sparkContext.applicationId, sf, language)
    if at not in _built or not Store(spark, _built[at].path).exists(f"{_built[at].path}/totals/_SUCCESS"):  # the shared folder may have been cleared
        split = portuguese.words if language else tokens
        fields = {"head": split(F.substring_index("text", "\n", 1)), "body": split(F.col("text"))}
        _built[at] = I.build(read(spark, sf, "documents"), "doc_id", fields, fresh_path(spark, "index"), stored=["lang", "source"], stem=portuguese.stem if language else None)
    return _built[at]


@query("index_search", _BM25 + "z AS (SELECT 1) SELECT doc_id, score FROM bm")
def index_search(spark: SparkSession, sf: str) -> DataFrame:
    return I.Search(_index(spark, sf), TERMS, WEIGHTS).scores().select(F.col("key").alias("doc_id"), F.round("score", 6).alias("score"))


@query("index_top", _BM25 + "z AS (SELECT 1) SELECT bm.* FROM bm JOIN documents USING (doc_id) WHERE lang <> 'en' AND source <> 'src3' ORDER BY score DESC, doc_id LIMIT 20")
def index_top(spark: SparkSession, sf: str) -> DataFrame:
    """The best of some sources; blocks that cannot hold one of them are not read."""
    best = I.Search(_index(spark, sf), TERMS, WEIGHTS).top(20, F.expr("lang <> 'en' and source <> 'src3'"))
    return best.select(F.col("key").alias("doc_id"), F.round("score", 6).alias("score"))


@query("index_total", "WITH d AS (SELECT " + tokens_sql("text") + " AS t FROM documents) SELECT count(*) AS total FROM d WHERE list_has_any(t, [" + ", ".join(f"'{t}'" for t in TERMS) + "])")
def index_total(spark: SparkSession, sf: str) -> DataFrame:
    return I.Search(_index(spark, sf), TERMS, WEIGHTS).total()


_ASKED = ["idiot", "licence", "on", "trsh"]
_EDITS = "CASE WHEN len(term) < 3 THEN 0 WHEN len(term) < 6 THEN 1 ELSE 2 END"
_NEAR = (
    "WITH k AS (SELECT doc_id, " + tokens_sql("text") + " AS b, " + tokens_sql("split_part(text, chr(10), 1)") + " AS a FROM documents), "
    "o AS (SELECT doc_id, 0 AS field, unnest(a) AS token, len(a)::DOUBLE AS len FROM k UNION ALL SELECT doc_id, 1, unnest(b), len(b)::DOUBLE FROM k), "
    "c AS (SELECT doc_id, field, token, len, count(*)::DOUBLE AS tf FROM o GROUP BY ALL), w AS (SELECT token, field, count(*) AS df FROM c GROUP BY ALL), "
    "t AS (SELECT unnest([" + ", ".join(f"'{t}'" for t in _ASKED) + "]) AS term), "
    f"e AS (SELECT term, token, levenshtein(token, term) AS distance, max(df) AS df FROM (SELECT DISTINCT token, df FROM w), t WHERE abs(len(token) - len(term)) <= 2 AND levenshtein(token, term) <= {_EDITS} GROUP BY ALL) "
)


@query("index_spellings", _NEAR + "SELECT term, token, distance, df FROM e")
def index_spellings(spark: SparkSession, sf: str) -> DataFrame:
    """The vocabulary within the edits that a term allows, by one pass over it."""
    return I.expand(_index(spark, sf), _ASKED)


@query(
    "index_fuzzy_search",
    _NEAR + ", n AS (SELECT count(*)::DOUBLE AS n, avg(len(a)::DOUBLE) AS m0, avg(len(b)::DOUBLE) AS m1 FROM k), r AS (SELECT term, token, 1 - distance / least(len(term), len(token))::DOUBLE AS boost FROM e QUALIFY row_number() OVER (PARTITION BY term ORDER BY boost DESC, token) <= 50), "
    "x AS (SELECT r.*, w.field, max(df) OVER (PARTITION BY term, w.field) AS df FROM r JOIN w USING (token) WHERE boost > 0), "
    "p AS (SELECT doc_id, c.field, sum(boost * ln(1 + (n - df + 0.5e0) / (df + 0.5e0)) * tf * 2.2e0 / (tf + 1.2e0 * (0.25e0 + 0.75e0 * len / CASE c.field WHEN 0 THEN m0 ELSE m1 END))) * CASE c.field WHEN 0 THEN 2 ELSE 1 END AS score FROM c JOIN x ON c.token = x.token AND c.field = x.field, n GROUP BY doc_id, c.field) "
    "SELECT doc_id, round(max(score), 6) AS score FROM p GROUP BY doc_id",
)
def index_fuzzy_search(spark: SparkSession, sf: str) -> DataFrame:
    """Like spellings score too, less by their distance; all spellings of a term count as equally rare."""
    return I.Search(_index(spark, sf), _ASKED, WEIGHTS, fuzzy=True).scores().select(F.col("key").alias("doc_id"), F.round("score", 6).alias("score"))


@query("index_portuguese")
def index_portuguese(spark: SparkSession, sf: str) -> DataFrame:
    """Stemmed words without stop words; SQL has no stemmer."""
    found = I.Search(_index(spark, sf, "pt"), portuguese.query_words("os tions thereas, licensed under a license"), WEIGHTS)
    return found.scores().select(F.col("key").alias("doc_id"), F.round("score", 6).alias("score"))
