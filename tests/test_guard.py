"""The cost guard against a loop, with small blocks so that runs span many."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarrymill.operators import guard as G


def loop(costs, limit):
    left, out = max(limit or 0, 0), []
    for c in costs:
        fits = c is not None and 0 <= c <= left
        left -= c if fits else 0
        out.append((fits, max(limit or 0, 0) - left))
    return out


def test_summaries_pass_blocks_as_a_loop_does():
    rng = random.Random(5)
    unopened = 0
    for _ in range(4000):
        top = rng.choice([3, 20, 1000, 10**6, 2**61])
        costs = [rng.choice([0, 1, rng.randint(0, top), rng.randint(0, max(1, top // 50))]) for _ in range(rng.randint(1, 12))]
        left = rng.randint(0, 3 * top)
        below, least = G._summary(np.array(costs, np.int64))
        after = G.passed(below, least, left)
        unopened += after is not None
        assert after in (None, G.fold(costs, left)[1][-1]), (costs, left)
    assert unopened > 500


@pytest.mark.parametrize("block", [1, 7, 4096])
def test_runs_equal_a_loop(spark, monkeypatch, block):
    monkeypatch.setattr(G, "BLOCK", block)
    rng = random.Random(block)
    limits, rows = {"hot": 50_000, "tiny": 0, "none": None, None: 900, "wide": 2**62}, []
    for i in range(1500):
        run = rng.choice(["hot"] * 6 + ["tiny", "none", None, "wide", "small"])
        rows.append((i, run, rng.choice([None, -5, 0, rng.randint(1, 40), rng.randint(1, 2000), rng.randint(1, 60_000)]), limits.get(run, 5000), "x"))
    df = spark.createDataFrame(rows, "seq long, run string, cost long, limit long, accepted_ string").repartition(5)
    got = {r["seq"]: (r["accepted"], r["spent"]) for r in G.guard(df, "run", ["seq"], F.col("cost"), F.col("limit")).collect()}
    want = {}
    for run in {r[1] for r in rows}:
        own = [r for r in rows if r[1] == run]
        want |= dict(zip((r[0] for r in own), loop([r[2] for r in own], limits.get(run, 5000)), strict=True))
    assert got == want


def test_no_items(spark):
    assert G.guard(spark.createDataFrame([], "seq long, run string, cost long"), "run", ["seq"], F.col("cost"), F.lit(5)).count() == 0
