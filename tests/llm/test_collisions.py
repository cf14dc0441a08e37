"""Texts on which hashes that are polynomials modulo 2**64 collide, and texts above the block size."""

import hashlib
import random

import pytest

pytest.importorskip("quarrymill.llm")

from quarrymill.llm import hashing, linededup, neardup, suffixdedup  # noqa: E402

SCHEMA = "doc_id long, text string"


def thue_morse(n, a, b):
    return [b if bin(i).count("1") % 2 else a for i in range(n)]


def test_lines_that_differ_stay(spark):
    rows = [(0, " ".join(thue_morse(1024, "cat", "dog"))), (1, " ".join(thue_morse(1024, "dog", "cat")))]
    got = linededup.dedup_lines(spark.createDataFrame(rows, SCHEMA), counts=True).collect()
    assert [r["n_removed"] for r in got] == [0, 0]


def test_words_that_differ_are_no_copies(spark):
    rows = [(0, "".join(thue_morse(1024, "a", "b"))), (1, "".join(thue_morse(1024, "b", "a"))), (2, "".join(thue_morse(1024, "A", "b")))]
    got = {r["doc_id"]: r["component_id"] for r in neardup.near_duplicate_table(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == {0: 0, 1: 1, 2: 0}


def test_bytes_that_differ_stay(spark):
    rows = [(0, "".join(thue_morse(1024, "a", "b"))), (1, "".join(thue_morse(1024, "b", "a")))]
    rows += [(2, rows[0][1][:500] + "x"), (3, "é" * 300)]
    got = {r["doc_id"]: r for r in suffixdedup.remove_repeats(spark.createDataFrame(rows, SCHEMA)).collect()}
    data = {i: t.encode() for i, t in rows}
    starts = {}
    for i, d in data.items():
        for s in range(len(d) - 399):
            starts.setdefault(d[s : s + 400], []).append((i, s))
    for i, d in data.items():
        gone = bytearray(len(d))
        for at in starts.values():
            for j, s in at if len(at) > 1 else []:
                if i == j:
                    gone[s : s + 400] = b"\x01" * 400
        assert got[i]["n_removed"] == sum(gone)
        assert got[i]["kept_sha256"] == hashlib.sha256(bytes(c for c, g in zip(d, gone, strict=True) if not g)).hexdigest()


def test_word_hashes_of_any_length():
    rng = random.Random(2)
    words = ["".join(rng.choice("abABé") for _ in range(n)) for n in [*range(1, 80), 4000]]
    starts, one = hashing.word_hashes(" \n".join(words).encode())
    assert len(starts) == len(words) and len(set(one.tolist())) == len({w.replace("A", "a").replace("B", "b") for w in words})
    for w, h in zip(words, one.tolist(), strict=True):
        assert hashing.word_hashes(("\t" + w.replace("A", "a")).encode())[1].tolist() == [h]


def test_texts_above_the_block_size(spark):
    """Over 512 KB, in parts that meet inside words, lines and windows."""
    rng = random.Random(9)
    line = lambda n: " ".join("".join(rng.choice("abcdefghij") for _ in range(6)) for _ in range(n))
    lines = [line(30) for _ in range(4000)]
    long = "\n".join(lines)
    assert len(long) > hashing.BLOCK
    other = [line(30) for _ in range(1900)]
    other[700:703] = lines[2500:2503]
    rows = [(0, long), (1, "\n".join(other)), (2, "\n".join([*lines[:3990], line(9)])), (3, "x" * (hashing.BLOCK + 700))]
    docs = spark.createDataFrame(rows, SCHEMA)
    near = {r["doc_id"]: r for r in neardup.near_duplicate_table(docs).collect()}
    want = [len({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))}) for w in (t.split() for _, t in rows)]
    assert [near[i]["n_shingles"] for i in range(4)] == want and [near[i]["component_id"] for i in range(4)] == [0, 1, 0, 3]
    cut = {r["doc_id"]: r["n_removed"] for r in linededup.dedup_lines(docs, counts=True).collect()}
    assert cut == {0: 0, 1: 3, 2: 3990, 3: 0}
    gone = {r["doc_id"]: r["n_removed"] for r in suffixdedup.remove_repeats(docs).collect()}
    shared = len("\n".join(lines[:3990])) + 1
    # A line end may be followed by equal bytes on both sides of a match, by chance.
    assert shared <= gone[0] <= shared + 9 and gone[0] == gone[2] and gone[1] >= len("\n".join(lines[2500:2503])) and gone[3] == len(rows[3][1])
