"""A cost guard: items in order, each accepted if what was accepted so far and its cost stay within a limit.

A rejected item adds nothing, so no running sum tells who is accepted. Items are sorted by ranges of (run, order), so a run that
most items belong to spreads over tasks, and put into blocks of at most `BLOCK` items. A block has a summary by powers of two: the sum of its costs below each
power, and the least cost of each octave. While what is left of the limit is within one octave, costs below the octave all fit until it is left,
and costs above it never do: so most blocks are passed by their summary alone, and a block is opened only if the octave may end inside it.
Then all blocks, each with what was left before it, decide their items side by side.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarrymill.sources.shared import write_once

#: Items of a block; octaves of a cost, which is a long.
BLOCK, OCTAVES = 4096, 63


def _octave(costs: np.ndarray) -> np.ndarray:
    """The number of bits of each cost: 0 for 0, k for 2 ** (k - 1) up to 2 ** k - 1."""
    out = np.zeros(len(costs), np.int64)
    rest = costs.copy()
    for step in (32, 16, 8, 4, 2, 1):
        high = rest >> step > 0
        out[high] += step
        rest[high] >>= step
    return out + (rest > 0)


def _summary(costs: np.ndarray) -> tuple[list[float], list[int]]:
    """Sums of the costs of fewer bits than 0, 1, ..., and the least cost of each number of bits (-1: none). Sums are exact below 2 ** 53, else an excess."""
    octave = _octave(costs)
    own = np.zeros(OCTAVES + 1)
    np.add.at(own, octave, costs.astype(float))
    least = np.full(OCTAVES + 1, np.iinfo(np.int64).max)
    np.minimum.at(least, octave, costs)
    return np.concatenate([[0.0], np.cumsum(own)[:-1]]).tolist(), np.where(least == np.iinfo(np.int64).max, -1, least).tolist()


def fold(costs: list[int], left: int) -> tuple[list[bool], list[int]]:
    """Which items are accepted one after the other, and what is left after each. Negative costs are never accepted."""
    taken, lefts = [], []
    for c in costs:
        fits = 0 <= c <= left
        left -= c if fits else 0
        taken.append(fits)
        lefts.append(left)
    return taken, lefts


def passed(below: list[float], least: list[int], left: int) -> int | None:
    """What is left after a block by its summary; None if it has to be opened."""
    k = left.bit_length()
    sure = below[k] < 2.0**52 and below[k] <= left and (least[k] < 0 or least[k] > left)
    return left - int(below[k]) if sure else None


def guard(items: DataFrame, run: str, order: list[str], cost: Column, limit: Column) -> DataFrame:
    """`items` with accepted (boolean) and spent (long: accepted costs of the run up to and with this item).

    cost and limit are longs (say, millionths), limit the same throughout a run. A null or negative cost is not accepted and adds nothing; a null limit
    is zero. `order` should tell a run's items apart; ties come in any order. Runs may be null. Column names must not begin with an underscore.
    """
    spark, names = items.sparkSession, items.columns
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    cost, limit = F.coalesce(cost.cast("long"), F.lit(-1)), F.greatest(F.coalesce(limit.cast("long"), F.lit(0)), F.lit(0))
    numbered = write_once(items.withColumns({"_cost": cost, "_limit": limit}).repartitionByRange(parts, run, *order).sortWithinPartitions(run, *order).withColumn("_at", F.monotonically_increasing_id()), "guard")
    kind = numbered.schema[run].dataType.simpleString()

    def to_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []

        def block() -> pa.RecordBatch:
            costs = [max(h[2], -1) for h in held]
            below, least = _summary(np.array([c for c in costs if c >= 0], np.int64))
            made = [[held[0][0]], [held[0][1]], [held[0][3]], [costs], [below], [least]]
            types = [run_type, pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.float64()), pa.list_(pa.int64())]
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(made, types, strict=True)], ["_run", "_at", "_limit", "_costs", "_below", "_least"])

        for batch in batches:
            run_type = batch.schema.field(0).type
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if held and (held[-1][0] != row[0] or held[-1][1] + 1 != row[1] or len(held) == BLOCK):  # a block's numbers are consecutive
                    yield block()
                held.append(row)
        if held:
            yield block()

    sorted_ = numbered.select(F.col(run).alias("_run"), "_at", "_cost", "_limit").repartitionByRange(parts, "_at").sortWithinPartitions("_at")
    blocks = write_once(sorted_.mapInArrow(to_blocks, f"_run {kind}, _at long, _limit long, _costs array<long>, _below array<double>, _least array<long>"), "guard-blocks")

    def carry(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        run_now, left, first = None, 0, True
        for batch in batches:
            lefts = []
            for i in range(batch.num_rows):
                r = batch.column(0)[i].as_py()
                if first or r != run_now:
                    run_now, left, first = r, batch.column(2)[i].as_py(), False
                lefts.append(left)
                after = passed(batch.column(4)[i].as_py(), batch.column(5)[i].as_py(), left)
                left = fold(batch.column(3)[i].as_py(), left)[1][-1] if after is None else after
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(lefts, pa.int64())], ["_at", "_left"])

    lefts = blocks.repartition(parts, "_run").sortWithinPartitions("_run", "_at").mapInArrow(carry, "_at long, _left long")

    def decide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                at, costs, left, most = (batch.column(j)[i].as_py() for j in range(4))
                taken, lefts = fold(costs, left)
                yield pa.RecordBatch.from_arrays([pa.array(range(at, at + len(costs)), pa.int64()), pa.array(taken), pa.array([most - x for x in lefts], pa.int64())], ["_at", "accepted", "spent"])

    decided = blocks.join(lefts, "_at").select("_at", "_costs", "_left", "_limit").mapInArrow(decide, "_at long, accepted boolean, spent long")
    return numbered.join(decided, "_at").select(*names, "accepted", "spent")
