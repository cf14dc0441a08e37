"""The training-data operators against brute force on small tables with nulls, empty and repeated rows, and ties."""

import hashlib
import itertools
import random

import numpy as np
import pytest

pytest.importorskip("quarrymill.llm")

from pyspark.sql import functions as F  # noqa: E402

from quarrymill.llm import ann, fingerprints, linededup, mixing, neardup, packing, suffixdedup, tokencounts, toxicity, warc  # noqa: E402
from quarrymill.llm.common import new_dir  # noqa: E402

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, row long, bands string"


def prose(rng, n):
    return " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 7))) for _ in range(n))


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(3)
    base, passage = prose(rng, 200), prose(rng, 120)
    lines = [prose(rng, 20) for _ in range(6)]
    out = [None, "", "   ", "one two", "one two", base, base, base.replace("a", "b", 8), prose(rng, 60) + " " + passage, passage + " " + prose(rng, 40), "x" * 1500, "é" * 450]
    out += ["\n".join(lines), "\n".join([prose(rng, 9), *lines[1:5], ""]), "\n".join(lines[2:5] * 2), "\n\n"]
    return out + [" ".join(w if rng.random() > 0.01 else "zz" for w in base.split()) for _ in range(6)]


@pytest.fixture(scope="module")
def docs(spark, texts):
    rows = [(i, t, "en", None if i % 7 == 0 else f"s{i % 3}", 0, i, "x") for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, SCHEMA).repartition(3, "doc_id")


def test_repeated_bytes(docs, texts):
    got = {r["doc_id"]: tuple(r)[1:5] for r in suffixdedup.remove_repeats(docs).collect()}
    data = [(t or "").encode() for t in texts]
    starts = {}
    for i, d in enumerate(data):
        for s in range(len(d) - 399):
            starts.setdefault(d[s : s + 400], []).append((i, s))
    gone = [bytearray(len(d)) for d in data]
    for at in starts.values():
        for i, s in at if len(at) > 1 else []:
            gone[i][s : s + 400] = b"\x01" * 400
    for i, d in enumerate(data):
        kept = bytes(c for c, g in zip(d, gone[i]) if not g)
        spans = sum(1 for k, _ in itertools.groupby(gone[i]) if k)
        assert got[i] == (len(d), len(d) - len(kept), spans, hashlib.sha256(kept).hexdigest())


def test_archive_round_trip(spark, docs):
    pages = docs.select(F.col("doc_id").alias("page_id"), F.lit("https://a.example/x?y=1").alias("url"), F.col("text").alias("html"), "source")
    root = new_dir(spark, "archive")
    warc.write_archive(pages, root)
    got = {r["page_id"]: r for r in warc.read_archive(spark, root).collect()}
    assert len(got) == docs.count() and got[6]["record_type"] == "revisit" and got[6]["refers_to"] == 5 and got[4]["record_type"] == "response"
    ask = lambda *urls: warc.lookup(spark, root, warc.keys_of(spark.createDataFrame([(u,) for u in urls], "url string")))
    assert ask("https://a.example/x?y=1", "https://a.example/x?y=1", "https://0.example/", "https://z.example/").count() == len(got) and ask("https://b.example/").count() == 0


def test_look_up_of_many_keys(spark, monkeypatch):
    """Blocks of three lines, a key that fills many blocks, null and odd URLs, null ids, other columns."""
    monkeypatch.setattr(warc, "BLOCK_LINES", 3)
    urls = ["http://hot.example/", *[f"http://h{i}.example/p?q={i % 3}" for i in range(40)], None, "no url", "http://[bad"]
    rows = [(None if i == 7 else i, urls[0] if i % 3 == 0 else urls[i % len(urls)], f"<p>{i % 50}</p>" * (i % 9), "x", "y") for i in range(200)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, key string, payload string").repartition(3, "page_id")
    root = new_dir(spark, "archive")
    warc.write_archive(pages, root)
    everything = warc.lookup(spark, root, warc.keys_of(pages))
    assert sorted((r["page_id"] is None, r["page_id"] or 0) for r in everything.collect()) == sorted((i is None, i or 0) for i, *_ in rows)
    by_key = {}
    for i, u, *_ in rows:
        by_key.setdefault(warc.url_key(u), []).append(-1 if i is None else i)
    for u in (urls[0], urls[5], urls[39], None, "no url", "http://[bad"):
        found = warc.lookup(spark, root, warc.keys_of(spark.createDataFrame([(u,), ("http://absent.example/",)], "url string")))
        assert sorted(-1 if r["page_id"] is None else r["page_id"] for r in found.collect()) == sorted(by_key[warc.url_key(u)])
    empty = new_dir(spark, "archive")
    warc.write_archive(pages.limit(0), empty)
    assert warc.read_archive(spark, empty).count() == 0


def test_toxicity_learns_and_keeps_clean(spark):
    rng = random.Random(5)
    rows = [(i, prose(rng, 60) + (" ".join(["", *rng.choices(["worthless", "disgusting", "pathetic"], k=6), ""]) if i % 4 == 0 else "") + prose(rng, 30), int(i % 4 == 0)) for i in range(600)] + [(600, None, 0), (601, "", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, truth int")
    labels = docs.select("doc_id", F.col("truth").alias("toxic"))
    got = {r["doc_id"]: r for r in toxicity.toxicity_table(docs, labels).collect()}
    held = [(got[i]["predicted"], t) for i, _, t in rows if got[i]["held_out"]]
    assert sum(p == t for p, t in held) >= 0.95 * len(held) and len(got) == 602 and got[600]["predicted"] == got[601]["predicted"] == 0
    kept = toxicity.drop_toxic(docs.withColumn("toxicity_score", F.lit(1)), labels)
    assert kept.columns == ["doc_id", "text", "truth", "toxicity_score"]
    assert toxicity.toxicity_table(docs.limit(0), labels).count() == 0 and toxicity.toxicity_table(docs, labels.limit(0)).count() == 602


def near(a, b):
    return a and b and 100 * len(a & b) >= 75 * len(a | b)


def test_near_duplicates(docs, texts):
    words = [(t or "").lower().split() for t in texts]
    sets = [{tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set() for w in words]
    label = list(range(len(sets)))
    for _ in sets:
        for i, j in itertools.combinations(range(len(sets)), 2):
            if near(sets[i], sets[j]):
                label[i] = label[j] = min(label[i], label[j])
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in neardup.near_duplicate_table(docs).collect()}
    assert got == {i: (len(s), label[i], label[i] == i) for i, s in enumerate(sets)}
    assert sorted(r["doc_id"] for r in neardup.drop_near_duplicates(docs).collect()) == sorted(i for i in got if got[i][2])
    assert neardup.near_duplicate_table(docs.limit(0)).count() == 0


def test_token_ledger(spark, docs, texts):
    ledger = tokencounts.TokenLedger(spark, new_dir(spark, "tokens"), {"words": None})
    change = lambda op, rows: spark.createDataFrame([(op, *r) for r in rows], "op string, doc_id long, source string, lang string, text string")
    first = docs.select(F.lit("insert").alias("op"), "doc_id", "source", "lang", "text", "row")
    assert ledger.commit(1, first) and not ledger.commit(1, first)
    ledger.commit(2, change("delete", [(5, None, None, None), (99, None, None, None)]).unionByName(change("revise", [(3, "s9", "de", "a b c")])))
    ledger.commit(3, change("insert", []))
    state = {i: ((None if i % 7 == 0 else f"s{i % 3}", "en"), len((t or "").split())) for i, t in enumerate(texts)}
    want = lambda rows: {k: (len(list(v := [n for kk, n in rows if kk == k])), sum(v)) for k in {kk for kk, _ in rows}}
    got = lambda upto=None: {(r["source"], r["lang"]): (r["documents"], r["tokens"]) for r in ledger.totals(upto).collect()}
    assert got(1) == want(list(state.values()))
    del state[5]
    state[3] = (("s9", "de"), 3)
    assert got() == want(list(state.values()))
    with pytest.raises(ValueError):
        ledger.commit(2 - 2, first)


def test_token_count_table(spark):
    """Repeated and null ids, equal, null and empty texts, against a recount; clashing columns; no rows."""
    from tokenizers import Tokenizer

    from quarrymill.llm.queries import vocabulary

    rows = [(1, "s", "en", "a b c"), (2, "s", "en", "a b c"), (2, "s", "en", "other words"), (None, "t", None, "a b c"), (None, "t", None, "d"), (3, None, "en", None), (4, "s", "en", ""), (5, "s", "de", "d"), (6, "s", "en", "é x")]
    docs = spark.createDataFrame(rows, "doc_id long, source string, lang string, text string").withColumns({"row": F.lit(1), "text_hash": F.lit("h"), "op": F.lit("delete"), "n_0": F.lit(5)})
    exact, want = Tokenizer.from_file(vocabulary()), {}
    seen = {}
    for k, (i, source, lang, text) in sorted(enumerate(rows), key=lambda x: (x[1][0] is None, x[1][0] or 0, x[0])):
        kept = seen.setdefault(text or "", k) == k
        for version, n in (("words", len((text or "").split())), ("bpe", len(exact.encode(text or "", add_special_tokens=False).ids))):
            sums = want.setdefault((source, lang, version), [0, 0, 0, 0])
            for j, x in enumerate((1, n, kept, kept * n)):
                sums[j] += x
    table = lambda d: tokencounts.token_count_table(d, new_dir(spark, "tokens"), {"words": None, "bpe": vocabulary()})
    got = {tuple(r)[:3]: list(r)[3:] for r in table(docs).collect()}
    assert got == want and table(docs.limit(0)).count() == 0


def runs_gone(texts, least):
    """Lines in a run of `least` words or more that an earlier place has, by brute force."""
    lines = [(t or "").split("\n") for t in texts]
    seen, gone = {}, [set() for _ in texts]
    spans = [(i, s, e) for i, x in enumerate(lines) for s in range(len(x)) for e in range(s + 1, len(x) + 1) if sum(len(y.split()) for y in x[s:e]) >= least]
    for i, s, e in sorted(spans):
        key = tuple(lines[i][s:e])
        if key in seen:
            gone[i] |= set(range(s, e))
        seen.setdefault(key, i)
    return lines, gone


def test_line_dedup(docs, texts):
    lines, gone = runs_gone(texts, 50)
    got = {r["doc_id"]: r for r in linededup.dedup_lines(docs, counts=True).collect()}
    for i, t in enumerate(texts):
        assert got[i]["n_removed"] == len(gone[i]) and got[i]["n_lines"] == len(lines[i])
        assert got[i]["text"] == (t if t is None else "\n".join(x for k, x in enumerate(lines[i]) if k not in gone[i]))
    assert linededup.dedup_lines(docs.limit(0)).columns == docs.columns


def test_nearest(spark):
    rng = random.Random(1)
    rows = [(i, [rng.gauss(i % 5, 1) for _ in range(8)]) for i in range(300)] + [(300 + i, [1.0] * 8) for i in range(60)] + [(400, None), (401, [0.0] * 8), (402, [float("nan")] * 8), (403, [None] * 8), (404, [1.0]), (None, [1.0] * 8)]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {}
    for r in ann.nearest(vectors, recall=1.0).collect():
        got.setdefault(r["query_id"], {})[r["rank"]] = (r["vec_id"], r["score"])
    good = [(i, v) for i, v in rows[:360]]
    hits = total = 0
    for i, v in good:
        if i % 20 == 0:
            best = sorted((-sum(a * b for a, b in zip(v, w)), j) for j, w in good if j != i)[:20]
            assert sorted(got[i]) == list(range(1, 21))
            hits += len({j for _, j in best} & {x for x, _ in got[i].values()})
            total += 20
    assert hits >= 0.9 * total and set(got) == {i for i, _ in good if i % 20 == 0}
    assert ann.nearest(vectors.limit(0)).count() == 0


def test_fingerprints(docs, texts):
    got = {r["doc_id"]: r for r in fingerprints.neighbour_fingerprints(docs).collect()}
    clean = [t or "" for t in texts]
    for i, t in enumerate(clean):
        n, after = len(t) // 2, clean[(i + 1) % len(clean)]
        edited = t[: len(t) - n] + after[:n]
        assert got[i]["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest() and got[i]["n_chars"] == len(t)
        assert 0 <= got[i]["near_edited"] <= 1 and 0 <= got[i]["near_next"] <= 1
    assert got[5]["fingerprint"] == got[6]["fingerprint"] and got[5]["near_next"] == 1 and got[3]["fingerprint"] == got[4]["fingerprint"]


def test_packing_round_trip(docs, texts):
    from tokenizers import Tokenizer

    from quarrymill.llm.queries import vocabulary

    exact = Tokenizer.from_file(vocabulary())
    pieces = {}
    for r in packing.pack_documents(docs, vocabulary(), max_len=64).collect():
        assert r["length"] & (r["length"] - 1) == 0 and r["length"] <= 64 and r["offset"] == 0
        pieces.setdefault(r["doc_id"], []).append((r["start"], bytes(r["ids"])))
    for i, t in enumerate(texts):
        ids = exact.encode(t or "", add_special_tokens=False).ids + [1]
        assert b"".join(x for _, x in sorted(pieces[i])) == b"".join(x.to_bytes(4, "little") for x in ids)


def test_mixing(docs, texts):
    got = mixing.mixture_table(docs).collect()
    again = {r["doc_id"]: r["taken"] for r in mixing.mixture_table(docs).collect()}
    assert len(got) == len(texts) and all(r["taken"] <= 3 * r["size"] and again[r["doc_id"]] == r["taken"] for r in got)
    total, per = sum(r["size"] for r in got), {}
    for r in got:
        i = r["doc_id"]
        per.setdefault((None if i % 7 == 0 else i % 3, r["target"]), []).append(r["taken"])
    assert abs(sum(t for _, t in per) - total) < 1e-6 and all(abs(sum(v) - t) <= 1 + max(v) / 2 for (_, t), v in per.items())
    # Draws: whole documents, a shard and a position each; shards get equal shares of the blocks drawn.
    assert all(r["taken"] == r["size"] * len(r["shards"]) == r["size"] * len(r["positions"]) for r in got)
    clash = docs.withColumns({c: F.lit(-1) for c in ("size", "_key", "draw", "mix_shard", "words", "target", "block")})
    mixed = mixing.mix(clash).collect()
    assert len(mixed) == sum(len(r["shards"]) for r in got) and all(r["text"] == texts[r["doc_id"]] and r["mix_shard"] == -1 for r in mixed)
    assert sorted((r["doc_id"], r["mix_shard_"], r["mix_position"]) for r in mixed) == sorted((r["doc_id"], *x) for r in got for x in zip(r["shards"], r["positions"]))
    dealt = mixing.deal(mixing.mix(docs)).rdd.glom().collect()
    assert all(p == sorted(p, key=lambda r: (r["mix_shard"], r["mix_position"])) for p in dealt)


def test_splitting_tree_draws_without_return():
    counts = np.array([7, 0, 40, 300, 1])
    quota = mixing.split_quotas(counts, 8, 3)
    assert quota.shape == (8, 5) and (quota >= 0).all() and (quota.sum(0) == counts).all()
    assert quota.sum(1).max() - quota.sum(1).min() <= 1 and (quota == mixing.split_quotas(counts, 8, 3)).all()
    # The mean of a node's share over seeds is that of the multivariate hypergeometric law.
    mean = np.mean([mixing.split_quotas(counts, 8, s)[0] for s in range(400)], 0)
    assert np.abs(mean - counts / 8).max() < 0.6


def test_targets_by_hand():
    assert mixing.share_targets([100, 100, 100], [1, 2, 3], 3) == [50, 100, 150]
    assert mixing.share_targets([10, 1000, 990], [6, 1, 1], 3) == [30, 985, 985] and mixing.share_targets([], [], 3) == []


def test_mixing_empty(docs):
    assert mixing.mixture_table(docs.limit(0)).count() == 0
