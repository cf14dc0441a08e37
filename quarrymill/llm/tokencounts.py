"""Token counts as delta-maintained rollups.

A ledger under a root URI holds, for each committed batch, signed rows of two tables:
`documents` (per document and tokenizer version: +1 with its new count, -1 with the one it had) and
`totals` (their sums by source, language and version). Totals of the corpus are sums of the second table, so
a batch tokenises what it changes, and reads of the first table what its ids have; nothing is counted again.

A batch writes its rows first and its commit mark last. Only marked batches are read, and a
batch that is committed again changes nothing, so a job that died can just be repeated. One writer at a time;
batch numbers rise.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrymill.llm.common import WORD, materialise, table_exists, with_row_key

KEYS = ["source", "lang", "tokenizer_version"]
_DOCUMENTS = "doc_id long, source string, lang string, tokenizer_version string, documents long, tokens long"
_TOTALS = "source string, lang string, tokenizer_version string, documents long, tokens long"


def word_count(text: Column) -> Column:
    """Number of `[^\\x20\\x09-\\x0D]+` in a text; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def with_vocabulary_count(df: DataFrame, text: str, vocabulary: str, name: str) -> DataFrame:
    """Add the number of ids that a word-level BPE vocabulary file gives for each whole text; null has none."""
    at, names, schema = df.columns.index(text), df.columns, df.withColumn(name, F.lit(0).cast("long")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from quarrymill.llm.packing import WordBpe

        encode = WordBpe(vocabulary).encode
        for batch in batches:
            counts = [len(encode(x.as_py() or "")) // 4 for x in batch.column(at)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(counts, pa.int64())], [*names, name])

    return df.mapInArrow(run, schema)


class TokenLedger:
    """Additive token totals by source, language and tokenizer version.

    `vocabularies` maps a version to the path of a vocabulary file, or to None for plain words.
    """

    def __init__(self, spark: SparkSession, root: str, vocabularies: Mapping[str, str | None]):
        self.spark, self.root, self.vocabularies = spark, root.rstrip("/"), dict(vocabularies)

    def batches(self) -> list[int]:
        """Committed batches in order."""
        if not table_exists(self.spark, f"{self.root}/commits"):
            return []
        return sorted(r["batch"] for r in self.spark.read.schema("batch long").parquet(f"{self.root}/commits/*").distinct().collect())

    def _read(self, name: str, schema: str, upto: int | None) -> DataFrame:
        paths = [f"{self.root}/{name}/{b}" for b in self.batches() if upto is None or b <= upto]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def _counted(self, rows: DataFrame) -> DataFrame:
        out, columns = rows, {}
        for k, (version, vocabulary) in enumerate(self.vocabularies.items()):
            columns[version] = f"n_{k}"
            out = out.withColumn(f"n_{k}", word_count(F.col("text"))) if vocabulary is None else with_vocabulary_count(out, "text", vocabulary, f"n_{k}")
        each = F.explode(F.array(*[F.struct(F.lit(v).alias("tokenizer_version"), F.col(c).alias("tokens")) for v, c in columns.items()])).alias("x")
        return out.select("doc_id", "source", "lang", each).select("doc_id", "source", "lang", "x.tokenizer_version", F.lit(1).cast("long").alias("documents"), "x.tokens")

    def state(self, upto: int | None = None) -> DataFrame:
        """doc_id, source, lang, tokenizer_version, documents, tokens: what counts now, or as of a batch."""
        return self._net(self._read("documents", _DOCUMENTS, upto))

    @staticmethod
    def _net(rows: DataFrame) -> DataFrame:
        return rows.groupBy("doc_id", *KEYS).agg(F.sum("documents").alias("documents"), F.sum("tokens").alias("tokens")).where("documents <> 0 or tokens <> 0")

    def commit(self, batch: int, changes: DataFrame) -> bool:
        """Apply changes (op, doc_id, source, lang, text; more columns are not read) as one batch; False if it was committed before.

        op is `insert` (adds the row), `delete` (takes back all that counts under its doc_id) or `revise` (both). A batch
        sees the state before it: an id is taken back once however often it is named, and each inserted or revised row is
        added, so repeated rows count each for itself. Deleting what isn't there changes nothing. A null doc_id is an id like any other;
        null sources and languages are groups of their own; null and empty texts are documents of no tokens. Any other op
        raises. An empty batch is committed too.
        """
        done = self.batches()
        if batch in done:
            return False
        if done and batch < done[-1]:
            raise ValueError(f"batch {batch} comes after {done[-1]}")
        known = F.col("op").isin("insert", "delete", "revise")
        op = F.when(known, F.col("op")).otherwise(F.raise_error(F.concat(F.lit("unknown op: "), F.coalesce("op", F.lit("null")))))
        rows = changes.select(op.alias("op"), F.col("doc_id").cast("long").alias("doc_id"), "source", "lang", "text")
        signed = self._counted(rows.where("op <> 'delete'").select("doc_id", "source", "lang", "text"))
        if done:
            gone = rows.where("op <> 'insert'").select(F.col("doc_id").alias("gone")).distinct()
            old = self._read("documents", _DOCUMENTS, None)
            # Only what the named ids have is summed.
            old = self._net(old.join(gone.hint("merge"), old["doc_id"].eqNullSafe(gone["gone"]), "left_semi"))
            signed = signed.unionByName(old.withColumns({"documents": -F.col("documents"), "tokens": -F.col("tokens")}))
        path = f"{self.root}/documents/{batch}"
        signed.write.mode("overwrite").option("compression", "zstd").parquet(path)
        sums = self.spark.read.schema(_DOCUMENTS).parquet(path).groupBy(*KEYS).agg(F.sum("documents").alias("documents"), F.sum("tokens").alias("tokens"))
        sums.write.mode("overwrite").parquet(f"{self.root}/totals/{batch}")
        self.spark.createDataFrame([(batch,)], "batch long").coalesce(1).write.mode("overwrite").parquet(f"{self.root}/commits/{batch}")
        return True

    def totals(self, upto: int | None = None) -> DataFrame:
        """source, lang, tokenizer_version, documents, tokens: now, or as of a batch. Groups without documents are left out."""
        rows = self._read("totals", _TOTALS, upto)
        return rows.groupBy(*KEYS).agg(F.sum("documents").alias("documents"), F.sum("tokens").alias("tokens")).where("documents <> 0 or tokens <> 0")


def withdrawn_copies(docs: DataFrame) -> DataFrame:
    """Changes that take back every document whose text an earlier one has (by doc_id, null last; of equal ids the first row).

    Null and empty texts are equal. Where only some of the rows of an id are copies, the others are revised, that is, counted again.
    `docs` must be replayable.
    """
    keyed = with_row_key(docs.select("doc_id", "source", "lang", "text"), "row")
    place = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row")
    hashed = materialise(keyed.select("doc_id", "row", F.sha2(F.coalesce(F.col("text"), F.lit("")), 256).alias("text_hash")), "text-hashes")
    first = hashed.groupBy("text_hash").agg(F.min(place).alias("first"), F.count("*").alias("n")).where("n > 1")
    # Written, so that both sides of the join are exchanged and a text that a third of the rows share can be split.
    first = materialise(first.select("text_hash", F.col("first.row").alias("first_row")), "first-copies")
    late = hashed.join(first.hint("merge"), "text_hash").where("row <> first_row").select("doc_id", "row")
    late = materialise(late, "late-copies")
    ids = late.groupBy("doc_id").agg(F.count("*").alias("n_late"))
    all_of = hashed.groupBy(F.col("doc_id").alias("id")).agg(F.count("*").alias("n_rows"))
    mixed = materialise(ids.join(all_of.hint("merge"), ids["doc_id"].eqNullSafe(all_of["id"])).where("n_late < n_rows").select("id"), "mixed-ids")
    nothing = [F.lit(None).cast("string").alias(c) for c in ("source", "lang", "text")]
    changes = late.select(F.lit("delete").alias("op"), "doc_id", *nothing)
    if mixed.isEmpty():
        return changes
    rest = keyed.join(mixed.hint("merge"), keyed["doc_id"].eqNullSafe(mixed["id"]), "left_semi").join(late.select("row").hint("merge"), "row", "left_anti")
    return changes.unionByName(rest.select(F.lit("revise").alias("op"), "doc_id", "source", "lang", "text"))


def token_count_table(docs: DataFrame, root: str, vocabularies: Mapping[str, str | None]) -> DataFrame:
    """Totals of all documents, and of those that remain once exact copies are withdrawn, kept as two batches.

    Null sources and languages are groups; null and empty texts are documents without tokens; without documents there is no row.

    source, lang, tokenizer_version, documents, tokens, distinct_documents, distinct_tokens.
    """
    ledger = TokenLedger(docs.sparkSession, root, vocabularies)
    ledger.commit(1, docs.select(F.lit("insert").alias("op"), "doc_id", "source", "lang", "text"))
    ledger.commit(2, withdrawn_copies(docs))
    ledger.commit(2, withdrawn_copies(docs))  # as after a restart: changes nothing
    every = ledger.totals(upto=1)
    left = ledger.totals().select(*[F.col(c).alias(f"{c}_") for c in KEYS], F.col("documents").alias("left_documents"), F.col("tokens").alias("left_tokens"))
    same = [every[c].eqNullSafe(left[f"{c}_"]) for c in KEYS]
    both = every.join(left, same, "left")
    return both.select(*KEYS, "documents", "tokens", F.coalesce("left_documents", F.lit(0)).alias("distinct_documents"), F.coalesce("left_tokens", F.lit(0)).alias("distinct_tokens"))
