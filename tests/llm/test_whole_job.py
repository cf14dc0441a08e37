"""Cases in which an operator once did less than the whole job."""

import pytest

pytest.importorskip("quarrymill.llm")

import random  # noqa: E402

import numpy as np  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402

from quarrymill.llm import ann, toxicity  # noqa: E402


def test_nearest_inside_tight_clusters(spark):
    """Groups of near copies whose products differ by less than 8-bit numbers show; registered defaults."""
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(4, 64))
    vectors = np.repeat(centres / np.linalg.norm(centres, axis=1, keepdims=True), 400, 0) + rng.normal(scale=0.003, size=(1600, 64))
    vectors /= np.linalg.norm(vectors, axis=1, keepdims=True)
    frame = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)], "vec_id long, embedding array<double>")
    got = {}
    for r in ann.nearest(frame).collect():
        got.setdefault(r["query_id"], set()).add(r["vec_id"])
    scores = vectors @ vectors.T
    np.fill_diagonal(scores, -np.inf)
    hits = sum(len(got[q] & set(np.argsort(-scores[q])[:20].tolist())) for q in range(0, 1600, 20))
    print("recall", hits / (80 * 20))
    assert set(got) == set(range(0, 1600, 20)) and hits >= 0.96 * 80 * 20


def test_packed_products_keep_their_bounds():
    rng = np.random.default_rng(5)
    v = np.concatenate([rng.normal(size=(200, 64)), rng.normal(size=(50, 64)) * 10.0 ** rng.integers(-30, 30, (50, 1)), np.eye(64)])
    rows = ann._unpack(ann._pack(v))
    (low, high), true = ann._products(*rows, *rows), v @ v.T
    assert (low <= true).all() and (true <= high).all() and np.median((high - low)[:200, :200]) < 0.02


def test_toxicity_knows_rare_wording(spark):
    """Each insult is in 2 % of the toxic texts."""
    rng = random.Random(6)
    word = lambda n: "".join(rng.choice("abcdefghijklmnop") for _ in range(n))
    insults = [word(9) for _ in range(50)]
    rows = []
    for i in range(6000):
        words = [word(rng.randint(2, 7)) for _ in range(15)]
        if i % 4 == 0:
            words[5:5] = rng.choice(insults), word(3)
            words[10:10] = [words[5]]
        rows.append((i, " ".join(words), int(i % 4 == 0)))
    docs = spark.createDataFrame(rows, "doc_id long, text string, truth int")
    got = toxicity.toxicity_table(docs, docs.select("doc_id", F.col("truth").alias("toxic"))).where("held_out").join(docs, "doc_id")
    caught = {r["truth"]: r["share"] for r in got.groupBy("truth").agg(F.avg("predicted").alias("share")).collect()}
    print("caught", caught)
    assert caught[1] >= 0.6 and caught[0] <= 0.02


def test_probing_and_comparing_all_filled_bins_agree(spark, monkeypatch):
    from quarrymill.llm import fingerprints

    docs = spark.createDataFrame([(i, " ".join(f"w{(i * 7 + k) % 97}x{k % (i + 3)}" for k in range(i * 9))) for i in range(40)], "doc_id long, text string")
    run = lambda: sorted(fingerprints.with_fingerprint(docs, docs["text"], "bins").select("doc_id", "bins").collect())
    probed = run()
    monkeypatch.setattr(fingerprints, "PROBES", 0)
    assert run() == probed and probed[0]["bins"] is None and all(len(r["bins"]) == fingerprints.BINS for r in probed[1:])
