"""One-permutation MinHash fingerprints of documents, in built-in functions only.

Each distinct five-word shingle is hashed once. Its low bits choose one of `BINS` bins, the rest
is its value; a bin keeps its least value. An empty bin borrows from a filled one, chosen by its
own universal-hash order of all bins (optimal densification: every filled bin is equally likely,
and two texts that fill the same bins borrow alike). Of each bin `BITS` low-order bits are
stored. Two stored fingerprints agree by chance in a share 2**-BITS of the bins, which
`likeness` takes out again.

All of this is arithmetic within a row: no explode, no shuffle, no Python.
"""

from __future__ import annotations

import random

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarrymill.llm.common import SPACE, free_name, partitions

BINS = 128
BITS = 8
WORDS = 5
_BIN_BITS = BINS.bit_length() - 1
_VALUE_BITS = 63 - _BIN_BITS
#: Bins of its own order in which an empty bin looks before all filled ones are compared.
PROBES = 8
#: Each bin's own order of bins: where it starts, and an odd step.
_ORDERS = [(r.randrange(BINS), r.randrange(1, BINS, 2)) for r in map(random.Random, range(BINS))]


def _steps(name: str, text: Column) -> list[dict[str, Column]]:
    """Columns to add, a dict at a time, that lead from a text to its bins' low bits."""
    words, n, keys, firsts = (f"{name}_{x}" for x in ("words", "n", "keys", "firsts"))
    split = F.filter(F.split(F.translate(F.coalesce(text, F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), SPACE), lambda w: w != "")
    at = lambda i, k: F.get(words, i + k)
    hashes = F.transform(F.sequence(F.lit(0), F.col(n) - WORDS), lambda i: F.xxhash64(*[at(i, k) for k in range(WORDS)]))
    short = F.array(F.aggregate(words, F.lit(0).cast("long"), lambda h, w: F.xxhash64(h, w)))
    hashed = F.when(F.col(n) >= WORDS, hashes).when(F.col(n) > 0, short).otherwise(F.array().cast("array<bigint>"))
    keyed = F.transform(hashed, lambda h: F.shiftleft(h.bitwiseAND(F.lit(BINS - 1)), _VALUE_BITS).bitwiseOR(F.shiftrightunsigned(h, 64 - _VALUE_BITS)))
    bin_of = lambda x: F.shiftright(x, _VALUE_BITS)
    least = F.filter(keys, lambda x, i: (i == 0) | (bin_of(x) != bin_of(F.get(keys, i - 1))))
    low = lambda x: x.bitwiseAND(F.lit((1 << BITS) - 1)).cast("int")
    own = F.map_from_arrays(F.transform(firsts, lambda x: bin_of(x).cast("int")), F.transform(firsts, low))

    starts, steps, backs = (F.array(*map(F.lit, x)) for x in ([a for a, _ in _ORDERS], [b for _, b in _ORDERS], [pow(b, -1, BINS) for _, b in _ORDERS]))
    dense = F.col(f"{name}_dense")

    def probed(j: Column, t: int) -> Column:
        return F.get(dense, (F.get(starts, j) + F.get(steps, j) * t).bitwiseAND(F.lit(BINS - 1)))

    def borrowed(j: Column) -> Column:
        """Low bits of the filled bin that comes first in bin j's order of bins."""
        place = lambda x: ((bin_of(x) - F.get(starts, j)) * F.get(backs, j)).bitwiseAND(F.lit(BINS - 1))
        return low(F.array_min(F.transform(firsts, lambda x: F.shiftleft(place(x), BITS).bitwiseOR(x.bitwiseAND(F.lit((1 << BITS) - 1))))))

    bins = F.sequence(F.lit(0), F.lit(BINS - 1))
    filled = lambda j: F.coalesce(F.get(dense, j), *[probed(j, t) for t in range(PROBES)], borrowed(j))
    some = F.when(F.size(firsts) == BINS, F.transform(firsts, low)).when(F.size(firsts) > 0, F.transform(bins, filled))
    by_bin = F.when(F.size(firsts) < BINS, F.transform(bins, lambda j: F.element_at(f"{name}_own", j)))
    return [{words: split}, {n: F.size(words)}, {keys: F.sort_array(keyed)}, {firsts: least}, {f"{name}_own": F.when(F.size(firsts) < BINS, own)}, {f"{name}_dense": by_bin}, {name: some}]


def with_fingerprint(df: DataFrame, text: Column, name: str) -> DataFrame:
    """Add `name`, the low bits of each bin as array<int>: null for a text without words.

    Equal texts have equal fingerprints; null counts as empty. Words are `[^\\x20\\x09-\\x0D]+`
    with A-Z lowered; fewer than five make one shingle. Long texts cost time in proportion.
    """
    base = free_name(df, f"fp_{name}")
    keep = df.columns
    for columns in _steps(base, text):
        df = df.withColumns(columns)
    return df.select(*[df[c] for c in keep], F.col(base).alias(name))


def packed(bins: Column) -> Column:
    """The stored form: BITS bits a bin, in hexadecimal; empty for a text without words."""
    return F.coalesce(F.array_join(F.transform(bins, lambda v: F.lpad(F.lower(F.hex(v)), BITS // 4, "0")), ""), F.lit(""))


def likeness(a: Column, b: Column) -> Column:
    """Estimated resemblance from 0 to 1, free of the bias of chance agreement of low bits.

    Two texts without words are alike (1); one without and one with words are not (0).
    """
    equal = F.size(F.filter(F.zip_with(a, b, lambda x, y: x == y), lambda e: e)).cast("double") / BINS
    chance = 2.0**-BITS
    share = F.greatest(F.lit(0.0), (equal - chance) / (1 - chance))
    return F.when(a.isNull() & b.isNull(), F.lit(1.0)).when(a.isNull() | b.isNull(), F.lit(0.0)).otherwise(share)


def _bucket(value: Column, bounds: list[Column]) -> Column:
    """Number of bounds at most value, by binary search."""
    if not bounds:
        return F.lit(0)
    table = F.array(*bounds)
    halves = F.array(*[F.lit(1 << k) for k in reversed(range(len(bounds).bit_length()))])
    return F.aggregate(halves, F.lit(0), lambda lo, s: F.when(F.get(table, lo + s - 1) <= value, lo + s).otherwise(lo))


def neighbour_fingerprints(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Fingerprint of each text, of its edited text, and their likenesses.

    The edited text has the last floor(n_chars / 2) code points replaced by the first as many (or
    all) of the next document in ascending order of id (null ids last, equal ids by a hash of the text and then as the
    files have them, null text as empty); after the last comes the first. Alone, a document follows itself. Ids may be of any type that can be ordered.

    The order is made of ranges, eight for each shuffle partition, so that the rows of one window, and what hashing deals to one task, stay
    small, also where many rows share an id or have none; a small table adds what follows each range. No documents, no rows. `docs` must be replayable.
    """
    spark = docs.sparkSession
    base = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    key = {"none": F.col("doc_id").isNull(), "doc_id": F.col("doc_id"), "hash": F.xxhash64("text"), "row": F.monotonically_increasing_id()}
    base = base.withColumn("key", F.struct(*[c.alias(n) for n, c in key.items()]))
    ranges = min(1 << 14, partitions(spark, 8))
    parts = base.select("key.*").repartitionByRange(ranges, *key).groupBy(F.spark_partition_id().alias("part")).agg(F.min(F.struct(*key)).alias("least"))
    kinds = [f.dataType.simpleString() for f in base.schema["key"].dataType]
    least = sorted((tuple(r["least"]) for r in parts.collect()), key=lambda k: (k[0], 0 if k[1] is None else k[1], k[2:]))  # a key for each range
    bounds = [F.struct(*[F.lit(x).cast(t).alias(n) for n, x, t in zip(key, k, kinds, strict=True)]) for k in least[1:]]
    base = base.withColumn("range", _bucket(F.col("key"), bounds))

    # The first document of each range: at most 2**14 rows, so a broadcast has a size bound.
    first_rows = spark.createDataFrame([(k[3],) for k in least], "first_row long")
    first_of = base.join(F.broadcast(first_rows), base["key.row"] == first_rows["first_row"]).select("range", "text")
    first_of = with_fingerprint(first_of, F.col("text"), "bins").select("range", F.struct("text", "bins").alias("doc"))
    base = with_fingerprint(base, F.col("text"), "bins")
    # One row for each range: what follows the last document of the range before it.
    every = Window.orderBy("range")
    after = first_of.withColumn("next_doc", F.lead("doc").over(every)).withColumn("next_doc", F.coalesce("next_doc", F.first("doc").over(every.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))))
    after = after.select(F.col("range").alias("after_range"), F.col("next_doc.text").alias("after_text"), F.col("next_doc.bins").alias("after_bins"))

    order = Window.partitionBy("range").orderBy("key")
    seen = base.withColumns({"next_text": F.lead("text").over(order), "next_bins": F.lead("bins").over(order), "more": F.lead(F.lit(True)).over(order)})
    seen = seen.join(after, seen["range"] == after["after_range"], "left")
    seen = seen.select("doc_id", "text", "bins", F.when(F.col("more"), F.col("next_text")).otherwise(F.col("after_text")).alias("next_text"), F.when(F.col("more"), F.col("next_bins")).otherwise(F.col("after_bins")).alias("next_bins"))
    seen = seen.withColumn("n_chars", F.char_length("text").cast("long"))
    half = F.floor(F.col("n_chars") / 2).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), (F.col("n_chars") - half).cast("int")), F.substring("next_text", F.lit(1), half))
    seen = seen.select("doc_id", "n_chars", "bins", "next_bins", edited.alias("edited"))
    seen = with_fingerprint(seen, F.col("edited"), "edited_bins")
    return seen.select(
        "doc_id",
        "n_chars",
        F.sha2(F.encode("edited", "UTF-8"), 256).alias("edited_sha256"),
        packed(F.col("bins")).alias("fingerprint"),
        packed(F.col("edited_bins")).alias("edited_fingerprint"),
        likeness(F.col("bins"), F.col("edited_bins")).alias("near_edited"),
        likeness(F.col("bins"), F.col("next_bins")).alias("near_next"),
    )
