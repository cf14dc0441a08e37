"""Retrieval: BM25, fuzzy terms, vectors, fusion, routing, relevance."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarrymill.functions.text import tokens


def bm25(docs: DataFrame, fields: dict[str, tuple[Column, float]], terms: list[str], *, key: str = "doc_id", k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """key, score: the best of the fields' BM25 scores, each times its weight; documents without a term are left out.

    Terms are counted inside each row, so the only exchange is of one row of statistics a task.
    """
    base = docs.select(key, *[tokens(c).alias(f"t_{f}") for f, (c, _) in fields.items()])

    def count(f: str, term: str) -> Column:
        return F.size(F.filter(f"t_{f}", lambda w: w == term)).cast("double")

    tf = {(f, i): count(f, t).alias(f"tf_{f}_{i}") for f in fields for i, t in enumerate(terms)}
    base = base.select(key, *[F.size(f"t_{f}").cast("double").alias(f"len_{f}") for f in fields], *tf.values())
    stats = base.agg(F.count("*").cast("double").alias("n"), *[F.avg(f"len_{f}").alias(f"avg_{f}") for f in fields], *[F.count_if(F.col(f"tf_{f}_{i}") > 0).cast("double").alias(f"df_{f}_{i}") for f, i in tf])
    both = base.join(F.broadcast(stats))  # one row

    def one(f: str, i: int) -> Column:
        n, df, t = F.col("n"), F.col(f"df_{f}_{i}"), F.col(f"tf_{f}_{i}")
        idf = F.log(1 + (n - df + 0.5) / (df + 0.5))
        return idf * t * (k1 + 1) / (t + k1 * (1 - b + b * F.col(f"len_{f}") / F.col(f"avg_{f}")))

    scores = [sum((one(f, i) for i in range(1, len(terms))), one(f, 0)) * F.lit(float(w)) for f, (_, w) in fields.items()]
    score = scores[0] if len(scores) == 1 else F.greatest(*scores)
    return both.select(key, F.round(score, 9).alias("score")).where("score > 0")


def fuzzy_terms(docs: DataFrame, text: Column, terms: list[str]) -> DataFrame:
    """term, token, distance, n_docs: tokens within the edit distance a term's length allows (0 below 3 characters, 1 to 5, else 2)."""
    words = docs.select(F.explode(F.array_distinct(tokens(text))).alias("token")).groupBy("token").agg(F.count("*").alias("n_docs"))
    allowed = [(t, 0 if len(t) < 3 else 1 if len(t) < 6 else 2) for t in terms]
    hits = F.filter(F.array(*[F.struct(F.lit(t).alias("term"), F.levenshtein("token", F.lit(t), m).alias("distance")) for t, m in allowed]), lambda h: h["distance"] >= 0)
    return words.select("token", "n_docs", F.explode(hits).alias("h")).select("h.term", "token", "h.distance", "n_docs")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0e0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / (F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def vector_scores(vectors: DataFrame, query: DataFrame) -> DataFrame:
    """`vectors` with the cosine to the one row of `query` (column q)."""
    return vectors.join(F.broadcast(query.limit(1))).withColumn("score", F.round(cosine(F.col("embedding"), F.col("q")), 9)).drop("q")


def top_per_group(scored: DataFrame, group: str, quota: int, key: str) -> DataFrame:
    """The best `quota` rows of each group; all groups together may exceed what was asked."""
    at = F.row_number().over(Window.partitionBy(group).orderBy(F.desc("score"), key))
    return scored.withColumn("place", at).where(F.col("place") <= quota)


def ranked_list(scored: DataFrame, key: str, limit: int, branch: str) -> DataFrame:
    """key, place (from 0), branch: the first `limit` of a result list."""
    best = scored.orderBy(F.desc("score"), key).limit(limit)
    return best.select(key, (F.row_number().over(Window.orderBy(F.desc("score"), key)) - 1).alias("place"), F.lit(branch).alias("branch"))


def reciprocal_rank_fusion(lists: list[DataFrame], key: str, k: int, constant: int = 60) -> DataFrame:
    """key, score, branches: sums of 1 / (constant + place + 1) over the (bounded) result lists, k best."""
    rows = lists[0]
    for x in lists[1:]:
        rows = rows.unionByName(x)
    part = 1e0 / (constant + F.col("place") + 1)
    fused = rows.groupBy(key).agg(F.round(F.sum(part), 9).alias("score"), F.array_join(F.sort_array(F.collect_set("branch")), "+").alias("branches"))
    return fused.orderBy(F.desc("score"), key).limit(k)


def hash_embedding(docs: DataFrame, text: Column, *, key: str = "doc_id", width: int = 768) -> DataFrame:
    """key, idx, weight: the sparse, normalised embedding of each text by hashes of its tokens."""
    h = F.sha2(F.col("w"), 256)
    byte = lambda at, n=1: F.conv(F.substring(h, 2 * at + 1, 2 * n), 16, 10).cast("long")
    words = docs.select(key, F.explode(tokens(text, 2)).alias("w"))
    signed = F.when(byte(4) % 2 == 0, 1e0).otherwise(-1e0) * (1 + (byte(5) % 9) / F.lit(10e0))
    cells = words.select(key, (byte(0, 4) % width).alias("idx"), signed.alias("x")).groupBy(key, "idx").agg(F.round(F.sum("x"), 6).alias("x"))
    norm = F.sqrt(F.sum(F.col("x") * F.col("x")).over(Window.partitionBy(key)))
    return cells.withColumn("norm", norm).where("norm > 0 and x <> 0").select(key, "idx", F.round(F.col("x") / F.col("norm"), 6).alias("weight"))


def merge_sources(hits: DataFrame, name: Column, *, key: str = "doc_id", source: str = "source") -> DataFrame:
    """name, key of the first hit, origins in order of first appearance joined by " + ", and the number of hits."""
    each = hits.select(name.alias("name"), key, source).groupBy("name", source).agg(F.min(key).alias("first"), F.count("*").alias("n"))
    both = each.groupBy("name").agg(F.min("first").alias(key), F.sort_array(F.collect_list(F.struct("first", source))).alias("all"), F.sum("n").alias("n_hits"))  # one entry a source
    return both.select("name", key, F.array_join(F.transform("all", lambda x: x[source]), " + ").alias("origins"), "n_hits")


def keyword_queries(text: Column) -> Column:
    """Fallback queries: the first four words over three characters, in neighbouring pairs."""
    words = F.slice(F.filter(tokens(text), lambda w: F.length(w) > 3), 1, 4)
    return F.filter(F.transform(F.sequence(F.lit(1), F.lit(3)), lambda i: F.concat_ws(" ", F.get(words, i - 1), F.get(words, i))), lambda q: q.contains(" "))


def relevance(text: Column, source: Column, thesis: list[str], keywords: list[str], top_source: str, markers: str) -> Column:
    """Additive relevance of a hit: thesis words, keywords (none of at least three: a tenth), top court, length, markers."""
    words = tokens(text)
    found = lambda terms: sum((F.array_contains(words, t).cast("int") for t in terms), F.lit(0))
    score = 1 + 0.1 * found([t for t in thesis if len(t) > 4])
    hits = found(keywords)
    score = F.when(hits >= 2, score + 0.25 * hits).when((hits == 0) & F.lit(len(keywords) >= 3), score * 0.1).otherwise(score)
    score = score + F.when(source == top_source, 0.3).otherwise(0.0) + F.when(F.char_length(text) > 150, 0.2).otherwise(0.0)
    return F.round((score + F.when(F.lower(text).rlike(markers), 0.4).otherwise(0.0)).cast("double"), 2)
