"""Runs of repeated words: a suffix automaton with small-to-large merging of ordered end-position sets.

A run is a stretch of words with smallest period q, of at least max(`LEAST`, `TIMES` * q) words, that no neighbouring word
extends. The automaton of a text holds for each state the set of positions where its strings end. States are
visited by falling length, and the sets of the states that link to one are merged into it, small into large. Two
neighbours p < p' of a merged set that come from different sets share exactly the state's length of words before
them, so with d = p' - p not above that length they seed a square of period d; it reaches as far left as the length
says, and it is a run if the words after p and p' differ. Neighbours d apart have no smaller period.

A word sequence of `GRAM` words inside a run occurs at least twice in it. So the automaton is built only over the stretches
whose sequences all recur within the stretch; the rest of a text can hold no run. That loses nothing, at any size.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarrymill.llm.common import WORD

#: A run has so many words at least, and so many periods.
LEAST, TIMES = 24, 3
#: Words whose sequence recurs in any run: 2 * q + GRAM - 1 <= max(LEAST, TIMES * q) for every q.
GRAM = 9
ROWS_AT_ONCE = 256
_FACTOR = np.uint64(0x9E3779B97F4A7C15)


class Ends:
    """An ordered set of positions in blocks, so that an insertion moves no more than a block."""

    WIDE = 512
    __slots__ = ("blocks", "lows", "size")

    def __init__(self, at: int):
        self.blocks, self.lows, self.size = [[at]], [at], 1

    def __iter__(self) -> Iterator[int]:
        for block in self.blocks:
            yield from block

    def _block(self, x: int) -> int:
        return max(0, bisect_left(self.lows, x + 1) - 1)

    def around(self, x: int) -> tuple[int, int]:
        """The neighbours of x, which is not in the set; -1 where there is none."""
        k = self._block(x)
        block = self.blocks[k]
        i = bisect_left(block, x)
        before = block[i - 1] if i else -1
        after = block[i] if i < len(block) else self.lows[k + 1] if k + 1 < len(self.lows) else -1
        return before, after

    def next(self, x: int) -> int:
        return self.around(x + 0.5)[1]

    def add(self, x: int) -> None:
        k = self._block(x)
        block = self.blocks[k]
        insort(block, x)
        self.lows[k] = block[0]
        self.size += 1
        if len(block) > self.WIDE:
            half = len(block) // 2
            self.blocks[k : k + 1] = [block[:half], block[half:]]
            self.lows[k : k + 1] = [block[0], block[half]]


def automaton(words: list[int]) -> tuple[list[int], list[int], list[int]]:
    """Length, link and own end position (-1 for copies of states) of each state; state 0 is the empty string."""
    length, link, own, to = [0], [-1], [-1], [{}]
    last = 0
    for at, w in enumerate(words):
        new = len(length)
        length.append(at + 1)
        link.append(0)
        own.append(at)
        to.append({})
        p = last
        while p >= 0 and w not in to[p]:
            to[p][w] = new
            p = link[p]
        if p >= 0:
            q = to[p][w]
            if length[q] == length[p] + 1:
                link[new] = q
            else:
                copy = len(length)
                length.append(length[p] + 1)
                link.append(link[q])
                own.append(-1)
                to.append(dict(to[q]))
                while p >= 0 and to[p].get(w) == q:
                    to[p][w] = copy
                    p = link[p]
                link[q] = link[new] = copy
        last = new
    return length, link, own


def runs_in(words: list[int], least: int = LEAST, times: int = TIMES) -> list[tuple[int, int, int]]:
    """start, length, period of the runs of a sequence, in no order."""
    n = len(words)
    shortest = min(max((times - 1) * q, least - q) for q in range(1, least + 1))  # what a run's length is at least above its period
    length, link, own = automaton(words)
    order = np.argsort(-np.array(length), kind="stable")
    waiting: dict[int, list] = {}
    out = []
    for v in order.tolist():
        long = length[v]
        if long < shortest:
            break
        parts = waiting.pop(v, [])
        if own[v] >= 0:
            parts.append(Ends(own[v]))
        parts.sort(key=lambda e: e.size)
        ends, seeds = parts.pop(), []
        while parts:
            small = list(parts.pop())
            met = [ends.around(x) for x in small]
            for i, x in enumerate(small):
                before, after = met[i]
                if before >= 0 and not (i and small[i - 1] > before):
                    seeds.append((before, x))
                if after >= 0 and not (i + 1 < len(small) and small[i + 1] < after):
                    seeds.append((x, after))
                ends.add(x)
        for p, r in seeds:
            d = r - p
            if long >= (times - 1) * d and long + d >= least and (r + 1 == n or words[p + 1] != words[r + 1]) and ends.next(p) == r:
                out.append((p - long + 1, long + d, d))
        if link[v] > 0:
            waiting.setdefault(link[v], []).append(ends)
    return out


def _recurring(grams: np.ndarray) -> np.ndarray:
    """Whether each value occurs twice or more."""
    order = np.argsort(grams, kind="stable")
    sorted_ = grams[order]
    same = sorted_[1:] == sorted_[:-1]
    out = np.zeros(len(grams), bool)
    out[order[1:][same]] = True
    out[order[:-1][same]] = True
    return out


def stretches(hashes: np.ndarray, least: int = LEAST) -> list[tuple[int, int]]:
    """Begin and end of the parts of a text that may hold runs, from hashes of its words."""
    if len(hashes) < least:
        return []
    with np.errstate(over="ignore"):
        grams = hashes[: len(hashes) - GRAM + 1].copy()
        for j in range(1, GRAM):
            grams = (grams ^ (grams >> np.uint64(29))) * _FACTOR + hashes[j : len(hashes) - GRAM + 1 + j]
    found = [(0, len(grams))]
    for _ in range(2):  # any number of rounds is right; more leave less to search
        kept = []
        for a, b in found:
            edge = np.diff(np.concatenate([[False], _recurring(grams[a:b]), [False]]).astype(np.int8))
            kept += [(a + i, a + j) for i, j in zip(np.flatnonzero(edge > 0).tolist(), np.flatnonzero(edge < 0).tolist(), strict=True) if j - i >= least - GRAM + 1]
        if kept == found:
            break
        found = kept
    return [(a, b + GRAM - 1) for a, b in found]


def word_runs(words: list[bytes], least: int = LEAST, times: int = TIMES) -> list[tuple[int, int, int]]:
    """start, length, period of all runs of a text's words, by start and period."""
    if len(words) < least:
        return []
    hashes = np.fromiter(map(hash, words), np.int64, len(words)).view(np.uint64)
    out = []
    for a, b in stretches(hashes, least):
        ids: dict[bytes, int] = {}
        out += [(a + s, n, q) for s, n, q in runs_in([ids.setdefault(w, len(ids)) for w in words[a:b]], least, times)]
    return sorted(out, key=lambda r: (r[0], r[2]))


def _measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kinds = [pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])), pa.string(), pa.int64()]
    for batch in batches:
        for at in range(0, batch.num_rows, ROWS_AT_ONCE):
            part = batch.slice(at, ROWS_AT_ONCE)
            rows, texts, counts = [], [], []
            for value in part.column(1):
                words = (value.as_py() or "").encode().split()  # bytes part at exactly the six separators
                runs = word_runs(words)
                gone = bytearray(len(words))
                for s, n, q in runs:
                    gone[s + q : s + n] = b"\1" * (n - q)
                rows.append([{"start": s, "length": n, "period": q} for s, n, q in runs])
                texts.append(b" ".join(w for w, g in zip(words, gone, strict=True) if not g) if runs else b" ".join(words))
                counts.append(len(words))
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(rows, kinds[0]), pa.array(texts, pa.binary()).cast(kinds[1]), pa.array(counts, kinds[2])], ["doc_id", "runs", "collapsed", "n_words"])


def periodic_runs(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, runs (array of start, length, period, by start and period), collapsed (the words that stay, joined by a space), n_words.

    A word stays unless a run holds it after that run's first period. Null and empty texts have no words: no runs, empty
    collapsed. Null ids stay, repeated rows count each for itself, no documents give no rows, other columns are not read. A text is searched in
    its task, as it is one value of one row; beside it the automaton takes some 500 bytes for each word of a stretch that may hold runs.
    """
    kind = docs.schema[doc_id].dataType.simpleString()
    return docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).mapInArrow(_measure, f"doc_id {kind}, runs array<struct<start: long, length: long, period: long>>, collapsed string, n_words long")


def best_run(runs: Column) -> Column:
    """The run with the greatest exact length / period; ties: smallest start, then period. Null of none."""
    better = lambda a, b: a["length"] * b["period"] > b["length"] * a["period"]  # noqa: E731  cross products: exact
    return F.aggregate(F.slice(runs, 2, F.greatest(F.size(runs) - 1, F.lit(0))), F.get(runs, 0), lambda a, b: F.when(better(b, a), b).otherwise(a))


def planted(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, text: texts of ids whose crc32 is divisible by ten become periodic from some word on; others, and those of null ids, stay as they are."""
    h = F.crc32(F.col(doc_id).cast("string").cast("binary"))
    g, n = F.floor(h / 10), F.size("_w")
    pieces = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), g.alias("_g"), F.when(h % 10 == 0, F.regexp_extract_all(text, F.lit(f"({WORD})"), 1)).alias("_w"))
    cut = pieces.withColumn("_a", F.when(n > 0, F.col("_g") % n).cast("int"))
    cut = cut.withColumn("_p", (1 + F.floor((n - F.col("_a")) / (3 + F.col("_g") % 8))).cast("int"))
    unit = F.slice("_w", F.col("_a") + 1, F.col("_p"))
    times = F.ceil((n - F.col("_a")) / F.col("_p")).cast("int")
    words = F.concat(F.slice("_w", F.lit(1), F.col("_a")), F.slice(F.flatten(F.array_repeat(unit, times)), F.lit(1), n - F.col("_a")))
    return cut.select("doc_id", F.when(F.col("_a").isNotNull(), F.array_join(words, " ")).otherwise(F.col("text")).alias("text"))


def run_table(docs: DataFrame) -> DataFrame:
    """Per row: doc_id, n_runs, the best run (start, length, period, exponent_milli), runs_sha256, collapsed_sha256, n_words."""
    line = lambda r: F.concat(r["start"], F.lit(","), r["length"], F.lit(","), r["period"], F.lit("\n"))
    found = periodic_runs(docs).withColumn("_b", best_run(F.col("runs")))
    b = F.col("_b")
    return found.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), b["start"].alias("start"), b["length"].alias("length"), b["period"].alias("period"),
        F.expr("_b.length * 1000 div _b.period").alias("exponent_milli"),
        F.sha2(F.array_join(F.transform("runs", line), ""), 256).alias("runs_sha256"), F.sha2(F.col("collapsed"), 256).alias("collapsed_sha256"), "n_words",
    )
