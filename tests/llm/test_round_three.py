"""Fill-in-middle, quality rules and periodic runs against brute force, with nulls, empty and repeated rows, long texts and clashing columns."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

pytest.importorskip("quarrymill.llm")

from pyspark.sql import functions as F  # noqa: E402

from quarrymill.llm import fertility, fillmiddle, periods  # noqa: E402

SCHEMA = "doc_id long, text string, lang string, n long, form string, runs string, kept string"
sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
WORDS = re.compile(r"[^\x20\x09-\x0D]+").findall


def frame(spark, texts, ids=None):
    ids = range(len(texts)) if ids is None else ids
    return spark.createDataFrame([(i, t, ["en", "de", None][k % 3], k, "x", "y", "z") for k, (i, t) in enumerate(zip(ids, texts, strict=True))], SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(5)
    out = [None, "", " ", "a", "é", "ab<S>cd", "<P", "<M>", "x" * 300, "\n\t\v\f\r\x1c  z", "😀a😀bc", "<" * 9, "a<S b>M<"]
    return out + ["".join(rng.choice("abz é😀\n<S>.") for _ in range(rng.randint(1, 400))) for _ in range(120)]


def fim(doc_id, t):
    t = t or ""
    h = hashlib.sha256(f"1:{doc_id}".encode()).hexdigest()
    h = [int(h[8 * i : 8 * i + 8], 16) for i in range(4)]
    units = re.findall(r"[A-Za-z]+|[^A-Za-z]", t)
    n = len(units)
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if not t or any(x in t for x in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return n, "plain", None, None, t
    return (n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}") if h[3] % 100 < 20 else (n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}")


@pytest.mark.parametrize("chunk", [1, 2, 7, 1 << 16])
def test_cuts_of_any_chunk_size(texts, chunk):
    for t in texts:
        data, units = (t or "").encode(), re.findall(r"[A-Za-z]+|[^A-Za-z]", t or "")
        [(chars, tokens)] = fillmiddle.counts_of([data], chunk)
        assert tokens.sum() == len(units) and chars.sum() == len(t or "")
        for r in {0, len(units) // 3, len(units) // 2, max(0, len(units) - 1), len(units)}:
            before = "".join(units[:r])
            assert fillmiddle.cut_at(data, chars, tokens, r, chunk) == (len(before.encode()), len(before))


def test_fill_in_middle(spark, texts):
    long = "".join(random.Random(1).choice("ab é1") for _ in range(300_000))
    rows = [*texts, long, "same text here", "same text here"]
    ids = [*range(len(texts) + 1), 7000, 7000]
    got = fillmiddle.fill_in_middle(frame(spark, rows, ids)).withColumn("back", fillmiddle.restored(F.col("output"), F.col("form"))).collect()
    want = Counter((i, *fim(i, t), t or "") for i, t in zip(ids, rows, strict=True))
    assert Counter((r["doc_id"], r["n"], r["form"], r["prefix_chars"], r["middle_chars"], r["output"], r["back"]) for r in got) == want
    assert {r["form"] for r in got} == {"plain", "psm", "spm"}


def test_fill_in_middle_of_odd_tables(spark):
    assert fillmiddle.fill_in_middle(frame(spark, ["x"]).limit(0)).count() == 0
    [r] = fillmiddle.fill_in_middle(frame(spark, ["one two"], [None])).collect()
    assert r["doc_id"] is None and r["n"] == 3
    named = frame(spark, ["a b c"]).withColumn("doc_id", F.lit("k1"))
    assert fillmiddle.fill_in_middle(named).first()["output"] == fim("k1", "a b c")[4]


def brute_runs(words, least=24, times=3):
    """All maximal stretches of each period; a stretch counts for its smallest period."""
    out, n = {}, len(words)
    for q in range(1, n // times + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if j > i and j - i + q >= max(least, times * q):
                s, length = i, j - i + q
                if not any(a <= s and s + length <= a + b and q % c == 0 for a, b, c in out):
                    out[s, length, q] = True
            i = j + 1
    return sorted(out, key=lambda r: (r[0], r[2]))


def random_words(rng):
    kind = rng.randint(0, 5)
    if kind == 0:
        return [rng.choice("ab") for _ in range(rng.randint(0, 120))]
    words = [rng.choice("abcdefgh") for _ in range(rng.randint(0, 30))]
    for _ in range(rng.randint(1, 4)):
        unit = [rng.choice("abc" if kind < 3 else "abcdefghijkl") for _ in range(rng.randint(1, 14))]
        words += (unit * 40)[: rng.randint(1, 90)] + [rng.choice("abcxyz") for _ in range(rng.randint(0, 4))]
    return words


def test_runs_against_brute_force():
    rng = random.Random(11)
    some = 0
    for _ in range(700):
        words = random_words(rng)
        want = brute_runs(words)
        assert periods.word_runs([w.encode() for w in words]) == want, words
        assert sorted(periods.runs_in([ord(w) for w in words], 6, 2), key=lambda r: (r[0], r[2])) == brute_runs(words, 6, 2), words
        some += bool(want)
    assert some > 200


def test_runs_of_known_words():
    fib = ["a", "ab"]
    while len(fib[-1]) < 3000:
        fib.append(fib[-1] + fib[-2])
    for words in (list(fib[-1][:2500]), [bin(i).count("1") % 2 for i in range(1000)], ["x"] * 5000, (["a", "b"] * 20 + ["c"]) * 12):
        data = [str(w).encode() for w in words]
        assert periods.word_runs(data) == brute_runs(words)


def test_blocks_of_end_positions(monkeypatch):
    monkeypatch.setattr(periods.Ends, "WIDE", 4)
    rng = random.Random(2)
    for _ in range(50):
        values = rng.sample(range(200), 60)
        e = periods.Ends(values[0])
        for i, x in enumerate(values[1:], 1):
            so_far = sorted(values[:i])
            assert e.around(x) == (max((y for y in so_far if y < x), default=-1), min((y for y in so_far if y > x), default=-1))
            assert e.next(values[0]) == min((y for y in so_far if y > values[0]), default=-1)
            e.add(x)
        assert list(e) == sorted(values) and e.size == 60
    assert periods.word_runs([b"a", b"b"] * 300) == [(0, 600, 2)]


def run_row(doc_id, t):
    words = WORDS(t or "")
    h, n = zlib.crc32(str(doc_id).encode()), len(words)
    g = h // 10
    if doc_id is not None and h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = words[:a] + [words[a + (i - a) % p] for i in range(a, n)]
    runs = brute_runs(words)
    gone = {i for s, m, q in runs for i in range(s + q, s + m)}
    best = min(runs, key=lambda r: (-r[1] / r[2], r[0], r[2]), default=None)
    tail = (None,) * 4 if best is None else (*best, 1000 * best[1] // best[2])
    return (doc_id, len(runs), *tail, sha("".join(f"{s},{m},{q}\n" for s, m, q in runs)), sha(" ".join(w for i, w in enumerate(words) if i not in gone)), n)


def test_run_table(spark):
    rng = random.Random(3)
    rows = [None, "", " \n", "é " * 40, "a b " * 30, *[rng.choice([" ", "\n", "\t"]).join(random_words(rng)) for _ in range(150)]]
    rows += [rows[-1], " ".join(f"w{i % 700}" for i in range(4000))]
    ids = [None, *range(len(rows) - 2), 3]
    got = Counter(tuple(r) for r in periods.run_table(periods.planted(frame(spark, rows, ids))).collect())
    assert got == Counter(run_row(i, t) for i, t in zip(ids, rows, strict=True))
    assert sum(r[1] > 0 for r in got) > 20 and periods.run_table(frame(spark, ["x"]).limit(0)).count() == 0


def base_row(t):
    t = t or ""
    words = WORDS(t)
    grams = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    counts = Counter(grams)
    covered = {i + j for i, g in enumerate(grams) if counts[g] > 1 for j in range(3)}
    seen, dup = set(), 0
    for line in t.split("\n"):
        dup += bool(WORDS(line)) and line in seen
        seen.add(line)
    failed = len(words) < 50 or 100 * len(covered) > 50 * len(words)
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in t), dup, len(covered), failed


def quality_rows():
    rng = random.Random(9)
    syllables = "the er an in re on at en nd ti es or te of ed is it al ar st".split()
    word = lambda: "".join(rng.choice(syllables) for _ in range(rng.choice([1, 1, 2, 2, 3])))
    good = [" ".join(word() for _ in range(rng.randint(60, 300))) for _ in range(120)]
    junk = [" ".join(word() + rng.choice(["***", "###", "&&&"]) for _ in range(120)), " ".join("ᚠᚢᚦ" + chr(0x16A0 + i % 80) for i in range(90)), "".join(rng.choice("qxzjkvwp7#") for _ in range(5000)), " ".join("".join(rng.choice("qxzjkvwp759") for _ in range(14)) for _ in range(90))]
    odd = [None, "", "a b c", "x y z " * 40, "one\none\n \n \ntwo\none", good[0], "w" * 4000, "\x1c a b\x85c " * 60]
    return good, junk, odd


def test_quality_rules(spark):
    good, junk, odd = quality_rows()
    rows = good + junk + odd
    got = fertility.quality_table(frame(spark, rows).withColumn("lang", F.lit("en")), *fertility.vocabulary_paths()).collect()
    assert len(got) == len(rows)
    by = {r["doc_id"]: r for r in got}
    for i, t in enumerate(rows):
        assert tuple(by[i])[1:7] == base_row(t), t
    assert all(by[i]["kept"] for i in range(len(good))) and not any(by[len(good) + i]["kept"] for i in range(len(junk)))
    assert not any(r["kept"] for r in got if r["base_failed"]) and by[len(good) + 1]["fallback_share"] > 300


def test_bands_against_brute_force(spark):
    """Measures by whole-text tokenising of word after word, quartiles by sorting, each language for itself."""
    good, junk, odd = quality_rows()
    rows = good + junk + odd
    v = fertility.Vocabularies(*fertility.vocabulary_paths())
    facts = []
    for k, t in enumerate(rows):
        words = WORDS(t or "")
        ids = [x for w in words for x in v._tokens(" " + w)] if max(map(len, words), default=0) <= fertility.LONG_WORD else None
        if ids is None or base_row(t)[5]:
            continue
        pieces = [x for w in words for x in v._pieces.encode(w)]
        share = np.array(list(Counter(ids).values())) / len(ids)
        facts.append({"k": k, "lang": ["en", "de", ""][k % 3], "size": int(np.floor(4 * np.log2(len(ids)))), "chars_per_token": 1000 * sum(map(len, words)) // len(ids), "tokens_per_word": 1000 * len(ids) // len(words), "fallback_share": 1000 * sum(v._pieces.is_byte(x) for x in pieces) // len(pieces), "entropy": int(round(-1000 * float((share * np.log2(share)).sum())))})
    quantile = lambda x, q: sorted(x)[max(0, int(np.ceil(q * len(x))) - 1)]
    for f in facts:
        f["entropy_excess"] = f["entropy"] - quantile([g["entropy"] for g in facts if (g["lang"], g["size"]) == (f["lang"], f["size"])], 0.5)
    want = {}
    for f in facts:
        bad = None
        for name, (down, up) in fertility.BANDS.items():
            own = [g[name] for g in facts if g["lang"] == f["lang"]]
            q1, q3 = quantile(own, 0.25), quantile(own, 0.75)
            wide = max(q3 - q1, fertility.LEAST_SPREAD[name])
            if bad is None and ((down is not None and f[name] < q1 - down * wide) or f[name] > q3 + up * wide):
                bad = name
        want[f["k"]] = (*(f[n] for n in fertility.BANDS), bad)
    got = {r["doc_id"]: (*(r[n] for n in fertility.BANDS), r["rejected_by"]) for r in fertility.quality_table(frame(spark, rows), *fertility.vocabulary_paths()).where("not base_failed").collect()}
    assert got == want and any(x[-1] for x in want.values())


def test_quality_of_odd_tables(spark):
    paths = fertility.vocabulary_paths()
    assert fertility.quality_table(frame(spark, ["x"]).limit(0), *paths).count() == 0
    [r] = fertility.quality_table(frame(spark, [None], [None]), *paths).collect()
    assert r["doc_id"] is None and r["base_failed"] and not r["kept"] and r["rejected_by"] is None


def brute_fingerprint(text):
    """Bins of the least shingle hashes, empty ones densified, by loops; hashes by Spark's xxhash64 are given."""
    from quarrymill.llm import fingerprints as fp

    def make(hashes):
        if not hashes:
            return None
        value_bits = fp._VALUE_BITS
        bins = {}
        for h in hashes:
            b, v = h & (fp.BINS - 1), (h % (1 << 64)) >> (64 - value_bits)
            bins[b] = min(v, bins.get(b, v))
        out = []
        for j in range(fp.BINS):
            start, step = fp._ORDERS[j]
            at = j if j in bins else next((start + step * t) % fp.BINS for t in range(fp.BINS) if (start + step * t) % fp.BINS in bins)
            out.append(bins[at] & ((1 << fp.BITS) - 1))
        return out

    return make(text)


def test_fingerprints_against_loops(spark):
    from quarrymill.llm import fingerprints as fp

    rng = random.Random(4)
    texts = [None, "", "one", "One two  three", *[" ".join(rng.choice("abcdefgh") + str(rng.randint(0, 30)) for _ in range(rng.choice([4, 5, 6, 20, 150, 900]))) for _ in range(40)]]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    rows = fp.with_fingerprint(df, F.col("text"), "bins").collect()
    asked = [(r["doc_id"], i, g) for r in rows for w in [WORDS((r["text"] or "").lower())] for i, g in enumerate([w[k : k + 5] for k in range(len(w) - 4)] if len(w) >= 5 else [w] if w else [])]
    whole = spark.createDataFrame([(d, i, g) for d, i, g in asked if len(g) == 5], "d int, i int, g array<string>").select("d", "i", F.xxhash64(*[F.get("g", F.lit(k)) for k in range(5)]).alias("h")).collect()
    short = spark.createDataFrame([(d, i, g) for d, i, g in asked if len(g) < 5], "d int, i int, g array<string>").select("d", "i", F.aggregate("g", F.lit(0).cast("long"), lambda h, w: F.xxhash64(h, w)).alias("h")).collect()
    hashes = {}
    for r in [*whole, *short]:
        hashes.setdefault(r["d"], []).append(r["h"])
    for r in rows:
        assert r["bins"] == brute_fingerprint(hashes.get(r["doc_id"])), r["text"]
    some = {r["doc_id"]: r["bins"] for r in rows}
    pairs = [(a, b) for a in list(some)[:20] for b in list(some)[:20]]
    got = spark.createDataFrame([(a, b, some[a], some[b]) for a, b in pairs], "a int, b int, x array<int>, y array<int>").select("a", "b", fp.likeness(F.col("x"), F.col("y")).alias("l")).collect()
    for r in got:
        x, y = some[r["a"]], some[r["b"]]
        equal = 1.0 if x is None and y is None else 0.0 if x is None or y is None else max(0.0, (sum(p == q for p, q in zip(x, y, strict=True)) / 128 - 1 / 256) / (1 - 1 / 256))
        assert abs(r["l"] - equal) < 1e-12


@pytest.mark.parametrize("kind", ["string", "long"])
def test_fingerprints_of_neighbours(spark, kind):
    from quarrymill.llm import fingerprints as fp

    texts = [None, "", *["t%d " % i * (1 + i % 40) for i in range(120)]]
    ids = [None if i % 3 == 0 else 5 if i % 5 == 0 else i for i in range(len(texts))]
    df = spark.createDataFrame([(i, t, "x", "y") for i, t in zip(ids, texts, strict=True)], "doc_id long, text string, key string, row string").withColumn("doc_id", F.col("doc_id").cast(kind)).repartition(4)
    shown = df.select("doc_id", F.coalesce("text", F.lit("")).alias("t"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("h")).collect()
    assert len({r["h"] for r in shown}) == len(texts) - 1  # null and empty are one text
    order = sorted(shown, key=lambda r: (r["doc_id"] is None, r["doc_id"] if r["doc_id"] is not None else ("" if kind == "string" else 0), r["h"]))
    want = Counter()
    for i, r in enumerate(order):
        t, after = r["t"], order[(i + 1) % len(order)]["t"]
        half = len(t) // 2
        want[r["doc_id"], len(t), sha(t[: len(t) - half] + after[:half])] += 1
    got = Counter((r["doc_id"], r["n_chars"], r["edited_sha256"]) for r in fp.neighbour_fingerprints(df).collect())
    assert got == want
    assert fp.neighbour_fingerprints(df.limit(0)).count() == 0


def test_ranks_of_keys_that_span_partitions_need_no_join(spark):
    from quarrymill.llm.common import materialise
    from quarrymill.llm.linededup import ranked

    rows = [(7 if i % 3 else i, i) for i in range(4000)]
    given = materialise(spark.createDataFrame(rows, "k long, row long"), "given")
    out, _ = ranked(given, ["k"], ["row"], "ranks")
    assert "Join" not in out._jdf.queryExecution().optimizedPlan().toString()
    got = out.orderBy("place").collect()
    assert [(r["k"], r["row"]) for r in got] == sorted(rows) and len({r["place"] >> 33 for r in got if r["k"] == 7}) > 1
    places: dict = {}
    assert all(r["rank"] == places.setdefault(r["k"], r["place"]) for r in got)
    assert all(not r["alone"] for r in got if r["k"] == 7)
