"""The pipeline over a small corpus, stage by stage, against what each stage must do to its own input."""

import random

import pytest

pytest.importorskip("quarrymill.llm")

import corpus_pipeline  # noqa: E402
from quarrymill.llm.queries import vocabulary  # noqa: E402


def prose(rng, n, letters="abcdefghijklm"):
    return " ".join("".join(rng.choice(letters) for _ in range(rng.randint(2, 7))) for _ in range(n))


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = random.Random(11)
    insults = ["worthless", "pathetic", "disgusting"]
    run = "\n".join(prose(rng, 20) for _ in range(4))
    rows, labels = [], []
    for i in range(300):
        toxic = i % 5 == 0
        words = prose(rng, 60).split()
        if toxic:
            for at in (5, 20, 40):
                words.insert(at, rng.choice(insults))
        rows.append((i, " ".join(words), "en", f"s{i % 3}", 0))
        labels.append((i, 1, int(toxic)))
    base = prose(rng, 120)
    rows += [(400, base, "en", "s0", 0), (401, base.replace(" ", "  "), "en", "s1", 0), (402, base + " tail", "en", None, 0), (403, None, None, "s1", None), (404, "", "en", "s2", 0), (None, prose(rng, 30), "en", "s2", 0)]
    rows += [(410, prose(rng, 30) + "\n" + run, "en", "s0", 0), (411, run + "\n" + prose(rng, 30), "en", "s1", 0)]
    root = tmp_path_factory.mktemp("corpus")
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{root}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{root}/labels.parquet")
    return str(root), run


def test_every_stage(spark, folder):
    from tokenizers import Tokenizer

    root, run = folder
    docs, seen = spark.read.parquet(f"{root}/documents.parquet"), {}
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES:
        before = [r.asDict() for r in docs.collect()]
        docs = stage(spark, docs, root)
        docs.write.parquet(f"{root}/{name}")
        docs = spark.read.parquet(f"{root}/{name}")
        seen[name] = before, [r.asDict() for r in docs.collect()]
        assert name == "packing" or docs.columns == columns
    before, after = seen["toxicity"]
    kept = {r["doc_id"] for r in after}
    toxic = {i for i in range(0, 300, 5)}
    assert len(toxic - kept) >= 0.9 * len(toxic) and len({r["doc_id"] for r in before} - toxic - kept) <= 3 and {None, 403, 404} <= kept
    before, after = seen["line_dedup"]
    text = {r["doc_id"]: r["text"] for r in after}
    assert run in text[410] and run.split("\n")[1] not in text[411] and text[403] is None and len(after) == len(before)
    assert all(r["n_chars"] == (None if r["text"] is None else len(r["text"])) for r in after)
    before, after = seen["near_duplicates"]
    assert {r["doc_id"] for r in before} - {r["doc_id"] for r in after} == {401, 402} and {None, 403, 404} <= {r["doc_id"] for r in after}
    before, after = seen["mixing"]
    whole = {r["doc_id"]: r["text"] for r in before}
    assert all(r["text"] == whole[r["doc_id"]] for r in after)
    size = lambda rows, s=None: sum(len((r["text"] or "").split()) for r in rows if s is None or r["source"] == s)
    # Weights 1, 2, 3, 1 over s0, s1, s2 and null.
    assert abs(size(after) - size(before)) < 400 and size(after, "s2") > size(after, "s1") > size(after, "s0")
    before, after = seen["packing"]
    exact = Tokenizer.from_file(vocabulary())
    ids = sum(len(exact.encode(r["text"] or "", add_special_tokens=False).ids) + 1 for r in before)
    assert sum(r["length"] for r in after) == ids and len({r["sequence_id"] for r in after}) == len(after)


def test_run_of_the_whole(spark, folder):
    out = corpus_pipeline.run(spark, folder[0])
    assert {"doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"} <= set(out.columns) and out.count() > 100
