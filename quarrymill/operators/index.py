"""A built inverted index: postings written once, read by term, scored as BM25 with fuzzy terms.

`build` passes over the texts once and writes, under a path: `docs` (a row for each document: key, lengths, stored columns), `blocks`
(for each term, field and block of documents the postings, with the largest count and least length in it) and `terms` (the
vocabulary with document counts). `blocks` and `terms` lie in folders by a hash of the term and are sorted by it, so a search opens the folders of its
terms and, within them, the row groups that may hold them. A term that most documents have is many blocks over many files.

`top` needs no block whose best possible score is under the k-th score of the most promising blocks.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Documents of a block, as a power of two; folders by hash of a term.
BLOCK_BITS, SHELVES = 10, 32
K1, B = 1.2, 0.75
#: Expansions of a fuzzy term that count, best first.
EXPANSIONS = 50
ROWS_AT_ONCE = 128

#: Of the tables in folders, which have no file if there are no documents.
_SCHEMAS = {
    "blocks": "term string, field int, block long, n int, max_tf int, min_len int, entries array<struct<docno: long, tf: int, len: int>>, shelf int",
    "terms": "term string, field int, df long, shelf int",
}


@dataclass
class Index:
    spark: SparkSession
    path: str
    fields: list[str]

    def table(self, name: str) -> DataFrame:
        reader = self.spark.read.schema(_SCHEMAS[name]) if name in _SCHEMAS else self.spark.read
        return reader.parquet(f"{self.path}/{name}")


def _shelf(term: Column) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(SHELVES)).cast("int")


def build(docs: DataFrame, key: str, fields: dict[str, Column], path: str, *, stored: list[str] | None = None, stem: Callable[[str], str] | None = None) -> Index:
    """Index the tokens of `fields` (columns of arrays of strings; null has none), with `stored` columns for filters.

    Rows with a null key are indexed like others. Repeated keys are documents of their own. No documents: an empty index.
    """
    spark, stored, names = docs.sparkSession, stored or [], list(fields)
    empty = F.array().cast("array<string>")
    plain = docs.select(F.col(key).alias("key"), *stored, F.monotonically_increasing_id().alias("docno"), *[F.coalesce(c, empty).alias(f"_t{i}") for i, c in enumerate(fields.values())])
    kept = plain.drop(*[f"_t{i}" for i in range(len(names))])
    posting = pa.struct([("field", pa.int32()), ("term", pa.string()), ("tf", pa.int32())])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS_AT_ONCE):
                part = batch.slice(at, ROWS_AT_ONCE)
                base = part.num_columns - len(names)
                found: list[list[dict]] = [[] for _ in range(part.num_rows)]
                lengths: list[list[int]] = [[] for _ in range(part.num_rows)]
                for i in range(len(names)):
                    for row, tokens in enumerate(part.column(base + i).to_pylist()):
                        counts = Counter(map(stem, tokens) if stem else tokens)
                        lengths[row].append(len(tokens))
                        found[row] += [{"field": i, "term": t, "tf": n} for t, n in counts.items()]
                yield pa.RecordBatch.from_arrays([*part.columns[:base], pa.array(lengths, pa.list_(pa.int32())), pa.array(found, pa.list_(posting))], [*part.schema.names[:base], "lengths", "postings"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema) + ", lengths array<int>, postings array<struct<field: int, term: string, tf: int>>"
    plain.mapInArrow(count, schema).write.option("compression", "zstd").parquet(f"{path}/counted")
    counted = spark.read.parquet(f"{path}/counted")  # pinned: document numbers are fixed from here on
    counted.drop("postings").write.option("compression", "zstd").parquet(f"{path}/docs")
    each = counted.select("docno", "lengths", F.inline("postings")).select("docno", "field", "term", "tf", F.get("lengths", F.col("field")).alias("len"), _shelf(F.col("term")).alias("shelf"), F.shiftright("docno", BLOCK_BITS).alias("block"))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    order = ["shelf", "term", "field", "block"]
    blocks = each.repartitionByRange(parts, *order).groupBy(*order).agg(
        F.count("*").cast("int").alias("n"), F.max("tf").alias("max_tf"), F.min("len").alias("min_len"), F.sort_array(F.collect_list(F.struct("docno", "tf", "len"))).alias("entries")
    )  # a group holds one block's documents at most
    blocks.sortWithinPartitions(*order).write.partitionBy("shelf").option("compression", "zstd").parquet(f"{path}/blocks")
    index = Index(spark, path, names)
    terms = index.table("blocks").groupBy("shelf", "term", "field").agg(F.sum("n").alias("df"))
    terms.repartitionByRange(parts, "shelf", "term").sortWithinPartitions("shelf", "term").write.partitionBy("shelf").parquet(f"{path}/terms")
    means = [F.avg(F.get("lengths", F.lit(i))).alias(f"mean_{i}") for i in range(len(names))]
    index.table("docs").agg(F.count("*").alias("n"), *means).write.parquet(f"{path}/totals")
    return index


def allowed_edits(term: str) -> int:
    """None below three characters, one below six, else two."""
    return 0 if len(term) < 3 else 1 if len(term) < 6 else 2


def expand(index: Index, terms: list[str]) -> DataFrame:
    """term, token, distance, df: the vocabulary within the edits that a term's length allows.

    One pass over the vocabulary, which compares the words of about a term's length up to that many edits. Neighbours are not written ahead: a word of n letters
    has some n * n / 2, and words that occur once are most of a large vocabulary.
    """
    own = list(dict.fromkeys(terms))
    asked = F.broadcast(index.spark.createDataFrame([(t, allowed_edits(t)) for t in own], "asked string, most int"))
    about = F.abs(F.char_length("term") - F.char_length("asked")) <= F.col("most")
    close = index.table("terms").join(asked, about & (F.levenshtein("term", "asked") <= F.col("most"))).groupBy("asked", "term").agg(F.max("df").alias("df"))
    return close.select(F.col("asked").alias("term"), F.col("term").alias("token"), F.levenshtein("term", "asked").alias("distance"), "df")


def _weights(index: Index, weights: dict[str, float], terms: list[str], fuzzy: bool) -> list[tuple[str, int, float]]:
    """(token, field, what a posting's saturation is worth) for the terms of a query: a few rows, from the folders of those terms."""
    spark = index.spark
    totals = index.table("totals").first()
    boosts: dict[tuple[str, str], float] = {(t, t): 1.0 for t in terms}
    if fuzzy:
        near = expand(index, terms).collect()  # the spellings of a query's terms
        for t in dict.fromkeys(terms):
            rated = [(1 - r["distance"] / min(len(t), len(r["token"])), r["token"]) for r in near if r["term"] == t]
            for boost, token in sorted((x for x in rated if x[0] > 0), key=lambda x: (-x[0], x[1]))[:EXPANSIONS]:
                boosts[t, token] = boost
    tokens = sorted({token for _, token in boosts})
    shelves = sorted({r["s"] for r in spark.createDataFrame([(t,) for t in tokens], "t string").select(_shelf(F.col("t")).alias("s")).collect()}) if tokens else []
    known = {(r["term"], r["field"]): r["df"] for r in index.table("terms").where(F.col("shelf").isin(shelves) & F.col("term").isin(tokens)).collect()} if tokens else {}
    out: Counter = Counter()
    import math

    for t in terms:  # repeats count
        own = {token: boost for (asked, token), boost in boosts.items() if asked == t}
        for field in range(len(index.fields)):
            counts = {token: known[token, field] for token in own if (token, field) in known}
            if counts:
                df = max(counts.values())  # spellings of one term count as equally rare
                idf = math.log(1 + (totals["n"] - df + 0.5) / (df + 0.5))
                for token in counts:
                    out[token, field] += own[token] * idf * weights[index.fields[field]]
    return [(token, field, w) for (token, field), w in out.items()]


def _saturation(index: Index, tf: Column, length: Column, field: Column) -> Column:
    totals = index.table("totals").first()
    mean = F.element_at(F.array(*[F.lit(float(totals[f"mean_{i}"] or 0.0)) for i in range(len(index.fields))]), field + 1)
    return tf * (K1 + 1) / (tf + K1 * (1 - B + B * length / mean))


class Search:
    """A query against an index: terms as the index has them, a weight for each field, and whether like spellings count.

    A document's score is that of its best field; a field's is the sum over the terms. Terms that no document has add nothing.
    """

    def __init__(self, index: Index, terms: list[str], weights: dict[str, float], *, fuzzy: bool = False):
        self.index, self.weights = index, _weights(index, weights, terms, fuzzy)
        spark = index.spark
        self._asked = F.broadcast(spark.createDataFrame(self.weights, "term string, field int, worth double"))
        names = sorted({t for t, _, _ in self.weights})
        shelves = sorted({r["s"] for r in spark.createDataFrame([(t,) for t in names], "t string").select(_shelf(F.col("t")).alias("s")).collect()}) if names else []
        blocks = index.table("blocks")
        self.blocks = blocks.where(F.col("shelf").isin(shelves) & F.col("term").isin(names)).drop("shelf") if names else blocks.where("false").drop("shelf")

    def _scored(self, blocks: DataFrame) -> DataFrame:
        tf, length, field = F.col("tf").cast("double"), F.col("len").cast("double"), F.col("field")
        each = blocks.join(self._asked, ["term", "field"]).select("field", "worth", F.inline("entries"))
        part = each.select("docno", "field", (F.col("worth") * _saturation(self.index, tf, length, field)).alias("part"))
        return part.groupBy("docno", "field").agg(F.sum("part").alias("score")).groupBy("docno").agg(F.max("score").alias("score"))

    def scores(self) -> DataFrame:
        """key, score and stored columns of all documents that have a term."""
        return self.index.table("docs").drop("lengths").join(self._scored(self.blocks), "docno").drop("docno").select("key", "score", *[c for c in self.index.table("docs").columns if c not in ("key", "docno", "lengths")])

    def total(self) -> DataFrame:
        """How many documents have a term: one row."""
        return self.blocks.select(F.explode("entries.docno").alias("d")).agg(F.count_distinct("d").alias("total"))

    def _bounds(self) -> DataFrame:
        """block, bound: what no document of a block can exceed."""
        most = F.col("worth") * _saturation(self.index, F.col("max_tf").cast("double"), F.col("min_len").cast("double"), F.col("field"))
        each = self.blocks.select("term", "field", "block", "n", "max_tf", "min_len").join(self._asked, ["term", "field"])
        return each.groupBy("block", "field").agg(F.sum(most).alias("bound"), F.max("n").alias("n")).groupBy("block").agg(F.max("bound").alias("bound"), F.max("n").alias("n"))

    def top(self, k: int, where: Column | None = None) -> DataFrame:
        """key, score: the k best documents of those for which `where` (over stored columns) holds; ties to the smaller key.

        The k blocks that promise most are scored first. Their k-th score is one that a block must be able to reach to be read at all.
        """
        docs = self.index.table("docs").drop("lengths")
        docs = docs.where(where) if where is not None else docs
        ranked = lambda s: docs.join(s, "docno").select("key", "score").orderBy(F.desc(F.round("score", 9)), "key").limit(k)
        first = [r["block"] for r in self._bounds().orderBy(F.desc("bound"), "block").limit(k).collect()]  # k block numbers
        best = ranked(self._scored(self.blocks.where(F.col("block").isin(first)))).collect() if first else []  # k rows
        floor = best[-1]["score"] - 1e-8 if len(best) == k else 0.0  # scores that are equal when rounded tie
        live = self._bounds().where(F.col("bound") >= floor).select("block")
        return ranked(self._scored(self.blocks.join(live, "block", "left_semi")))
