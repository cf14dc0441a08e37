"""Mixing sources to target weights with a multivariate-hypergeometric splitting tree.

1. Count the words of every document and deal each source's documents into permuted blocks by a
   hash. The blocks of a source are at most `blocks` many, so tables of blocks stay small
   however large a source is.
2. Share the words of all documents among the sources by weight. A source gives at most
   `max_repeat` times its size; what it cannot give is shared again among the others.
3. A source gives its blocks in permuted order, whole passes first, until its target is met. The
   last block is cut at document level: each of its documents is drawn whole, or not, whichever comes nearer.
4. How many block draws of each source go to each output shard is decided by a tree: the counts
   of a node are split between its two halves by a multivariate hypergeometric draw. Leaves hold
   exact quotas; shards draw consecutive, so disjoint, ranges of the permuted draws.
5. Inside a shard, `position` shuffles the drawn documents.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarrymill.llm.common import WORD, free_name, materialise, partitions, with_row_key

#: The driver holds one row of numbers for each source, and refuses more sources than this: below it, sources have under 10**9
#: draws of blocks in all, which is what the generator takes.
MAX_SOURCES = 60_000
#: Output shards, if the caller does not say.
SHARDS = 64


def share_targets(sizes: list[int], weights: list[float], max_repeat: float) -> list[float]:
    """Words for each source: the sum of sizes by weight, none above max_repeat times its size."""
    caps = [max_repeat * s for s in sizes]
    out, open_, left = [0.0] * len(sizes), set(range(len(sizes))), float(sum(sizes))
    while open_:
        unit = left / sum(weights[i] for i in open_)
        full = [i for i in sorted(open_) if unit * weights[i] > caps[i]]
        if not full:
            for i in open_:
                out[i] = unit * weights[i]
            break
        for i in full:
            out[i] = caps[i]
            left -= caps[i]
            open_.discard(i)
    return out


def split_quotas(counts: np.ndarray, shards: int, seed: int) -> np.ndarray:
    """Draws of each source in each shard (shards x sources). Rows' totals differ by one at most."""
    rng = np.random.default_rng(seed)

    def split(have: np.ndarray, k: int) -> list[np.ndarray]:
        if k == 1:
            return [have]
        left = k // 2
        take = int(have.sum()) * left // k
        got = rng.multivariate_hypergeometric(have, take, method="marginals") if have.sum() else have
        return split(got, left) + split(have - got, k - left)

    return np.array(split(np.asarray(counts, dtype=np.int64), shards))


def _position(key: Column, seed: int, salt: str) -> Column:
    return F.xxhash64(key, F.lit(seed), F.lit(salt))


def mixing_plan(docs: DataFrame, *, weights: dict | None = None, cycle: tuple[float, ...] = (1, 2, 3), max_repeat: int = 3, blocks: int = 4096, shards: int = SHARDS, seed: int = 7, source: str = "source", text: str = "text", row: str) -> DataFrame:
    """How often each document is drawn: one row for each row of `docs`.

    Columns: the key `row`, size, source_size, target, taken (all in words), and draws, an array
    of {pass, shard, words, position}. Documents are drawn whole, so a source's taken words miss its target by
    half a document at most.

    Weights: `weights` by source (1 if absent), or else `cycle` over the sources in code-point
    order, null last. A null source is a source of its own. Null and empty texts have size 0
    and are never drawn. Equal rows are drawn each for itself. Without documents or words
    nothing is drawn. The same rows in the same files give the same draws.
    """
    key, src = F.col(row), F.col(source)
    sized = docs.select(key.alias("row"), src.alias("source"), F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long").alias("size"))
    sized = materialise(sized.withColumn("block", F.pmod(F.xxhash64("row", F.lit(seed)), F.lit(blocks)).cast("int")), "mix-sizes")

    by_block = sized.groupBy("source", "block").agg(F.sum("size").alias("words"))
    by_block = materialise(by_block.where("words > 0"), "mix-blocks")
    per_source = by_block.groupBy("source").agg(F.sum("words").alias("size"), F.count("*").alias("blocks"))
    names = sized.select("source").distinct()
    known = names.join(per_source, names["source"].eqNullSafe(per_source["source"]), "left").select(names["source"], F.coalesce("size", F.lit(0)).alias("size"), F.coalesce("blocks", F.lit(0)).alias("blocks"))
    rows = known.limit(MAX_SOURCES + 1).collect()
    if len(rows) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources: group them first")
    rows.sort(key=lambda r: (r.source is None, str(r.source).encode() if r.source is not None else b""))
    w = [float((weights or {}).get(r.source, 1)) if weights is not None else float(cycle[i % len(cycle)]) for i, r in enumerate(rows)]
    targets = share_targets([r["size"] for r in rows], w, max_repeat) if rows else []
    wanted = [min(round(t), max_repeat * r["size"]) for t, r in zip(targets, rows, strict=True)]
    full = [q // r["size"] if r["size"] else 0 for q, r in zip(wanted, rows, strict=True)]
    rest = [q - f * r["size"] for q, f, r in zip(wanted, full, rows, strict=True)]

    spark = docs.sparkSession
    kind = docs.schema[source].dataType.simpleString()
    # A row for each source, of which there are MAX_SOURCES at most: small enough to broadcast.
    about = F.broadcast(spark.createDataFrame([(r.source, r["size"], t, f, x) for r, t, f, x in zip(rows, targets, full, rest, strict=True)], f"source {kind}, source_size long, target double, full int, rest long"))

    # Passes over the permuted blocks: whole ones, and one that ends where the target is met.
    same = by_block["source"].eqNullSafe(about["source"])
    passes = by_block.join(about, same).select(by_block["source"], "block", "words", "full", "rest", F.explode(F.sequence(F.lit(0), F.col("full"))).alias("pass"))
    order = Window.partitionBy("source", "pass").orderBy(F.xxhash64("block", "pass", F.lit(seed)), "block")
    passes = passes.withColumns({"at": F.row_number().over(order), "before": F.sum("words").over(order.rowsBetween(Window.unboundedPreceding, -1))})
    passes = passes.withColumn("give", F.when(F.col("pass") < F.col("full"), F.col("words")).otherwise(F.greatest(F.lit(0), F.least("words", F.col("rest") - F.coalesce("before", F.lit(0))))))
    passes = materialise(passes.where("give > 0"), "mix-passes")

    counts = {r.source: r.n for r in passes.groupBy("source").agg(F.count("*").alias("n")).collect()}
    quota = split_quotas(np.array([counts.get(r.source, 0) for r in rows], dtype=np.int64), shards, seed) if rows else np.zeros((shards, 0), dtype=np.int64)
    ends = F.broadcast(spark.createDataFrame([(r.source, [int(x) for x in np.cumsum(quota[:, i])]) for i, r in enumerate(rows)], f"source {kind}, ends array<long>"))
    number = Window.partitionBy("source").orderBy("pass", "at")
    passes = passes.withColumn("draw", F.row_number().over(number))
    dealt = passes.join(ends, passes["source"].eqNullSafe(ends["source"])).select(passes["source"], "block", "words", "give", "pass", F.size(F.filter("ends", lambda x: x < F.col("draw"))).alias("shard"))
    dealt = dealt.groupBy("source", "block").agg(F.sort_array(F.collect_list(F.struct("pass", "shard", F.when(F.col("give") < F.col("words"), F.col("give")).alias("cut")))).alias("given"))  # at most max_repeat + 1 passes

    joined = sized.join(about, sized["source"].eqNullSafe(about["source"])).drop(about["source"])
    joined = joined.join(dealt, joined["source"].eqNullSafe(dealt["source"]) & (joined["block"] == dealt["block"]), "left").select("row", joined["source"], joined["block"], "size", "source_size", "target", "given")
    cut_at = F.array_max(F.transform("given", lambda g: g["cut"]))
    joined = joined.withColumn("cut", cut_at)
    # The documents of a cut block, one block a source, are drawn in permuted order up to the cut.
    inner = Window.partitionBy("source", "block").orderBy(F.xxhash64("row", F.lit(seed + 1)), "row").rowsBetween(Window.unboundedPreceding, -1)
    part = joined.where("cut is not null").withColumn("before", F.coalesce(F.sum("size").over(inner), F.lit(0)))
    part = part.withColumn("last", F.when(2 * F.col("before") + F.col("size") <= 2 * F.col("cut"), F.col("size")).otherwise(0)).drop("before")
    whole = joined.where("cut is null").withColumn("last", F.col("size"))
    both = whole.unionByName(part)
    draws = F.transform("given", lambda g: F.struct(g["pass"].alias("pass"), g["shard"].alias("shard"), F.when(g["cut"].isNull(), F.col("size")).otherwise(F.col("last")).alias("words"), F.xxhash64("row", g["pass"], F.lit(seed + 2)).alias("position")))
    draws = F.coalesce(F.filter(draws, lambda d: d["words"] > 0), F.array().cast("array<struct<pass:int,shard:int,words:bigint,position:bigint>>"))
    return both.select("row", "size", "source_size", "target", draws.alias("draws")).withColumn("taken", F.aggregate("draws", F.lit(0).cast("long"), lambda a, d: a + d["words"])).withColumnRenamed("row", row)


def mix(docs: DataFrame, *, text: str = "text", **options) -> DataFrame:
    """The mixture itself: a row of `docs`, whole, for each draw, with mix_shard and mix_position (underscores are added where `docs`
    has such columns). Documents without words are never drawn; edge cases as in `mixing_plan`.

    Rows are in their shard's order once sorted by position.
    """
    row = free_name(docs, "mix_row")
    keyed = with_row_key(docs, row)
    names = [free_name(docs, n) for n in ("mix_shard", "mix_position")]
    plan = mixing_plan(keyed, text=text, row=row, **options).where("taken > 0").select(row, F.explode("draws").alias("draw"))
    plan = plan.select(row, *[F.col(f"draw.{k}").alias(n) for k, n in zip(("shard", "position"), names, strict=True)])
    return keyed.join(plan.hint("merge"), row).select(*docs.columns, *names)


def deal(drawn: DataFrame, shard: str = "mix_shard", position: str = "mix_position") -> DataFrame:
    """The rows of `mix`, each shard in its own order. A shard spreads over as many tasks as the session's shuffle partitions allow."""
    n = partitions(drawn.sparkSession)
    salts = F.lit(-(-n // SHARDS))
    return drawn.repartition(n, shard, F.pmod(position, salts)).sortWithinPartitions(shard, position)


def mixture_table(docs: DataFrame, **options) -> DataFrame:
    """doc_id, size, source_size, target and taken of every row of `docs`, and where the mix puts it: shards and positions, one of
    each for each draw (see mixing_plan)."""
    keyed = with_row_key(docs.select("doc_id", "source", "text"), "row")
    plan = mixing_plan(keyed, row="row", **options)
    plan = plan.select("row", "size", "source_size", "target", "taken", F.col("draws.shard").alias("shards"), F.col("draws.position").alias("positions"))
    return keyed.select("row", "doc_id").join(plan.hint("merge"), "row").drop("row")
