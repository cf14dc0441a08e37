"""Removal of long byte strings that occur more than once, by recursive induction from sampled suffixes.

The question at each byte is whether the suffix there shares its first `WINDOW` bytes with another one.
As in induced sorting, few suffixes are sorted, chosen by their content, and the others take their answer
from the sampled suffix that they lead to:

1. Of the `WINDOW - GRAM + 1` grams in a window the least by hash (the first of equals) is its anchor. Equal windows
   have equal anchors at equal distances, so only windows with a repeated anchor can be repeated. Neighbouring windows share
   an anchor: a tuple (anchor, first and last distance, name of all bytes that the windows cover) stands for about a
   hundred suffixes.
2. Tuples are sorted and counted by anchor, then by name, in Spark's disk-backed exchanges. A tuple whose name occurs
   again is settled: every one of its windows is repeated. One whose anchor doesn't is settled too: none is.
3. The rest splits into cells of `CELL` windows at fixed distances from the anchor. The bytes common to a cell's
   windows are a lower bound of the common prefix: if those don't occur again no window of the cell does. What is
   still open goes down to single windows.

So memory holds a block of text and the spans of one document, whatever the size of the corpus or of a group of copies.
Names are BLAKE2b-128 of the bytes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrymill.llm.common import free_name, materialise, with_row_key
from quarrymill.llm.hashing import BLOCK, mix, names

WINDOW = 400
GRAM = 150
CELL = 16
_U = np.uint64
_PLACE = 24  # bits of a sort key that hold a place in a block of text
_FIELDS = {"anchor": "long", "row": "long", "pos": "long", "near": "int", "far": "int", "a": "long", "b": "long"}


_BASE = 0x9E3779B97F4A7C15 | 1
_CODE = mix(np.arange(1, 257, dtype=np.uint64) * _U(0xD1342543DE82EF95))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of an odd base, and of its inverse, modulo 2**64."""
    with np.errstate(over="ignore"):
        return tuple(np.multiply.accumulate(np.concatenate([np.ones(1, _U), np.full(n - 1, x, _U)])) for x in (_BASE, pow(_BASE, -1, 1 << 64)))


_POWERS = _powers(2 * BLOCK + 4096)


class _Marks:
    """A 64-bit hash of any byte range of data. It only chooses and gathers anchors: what is removed is decided by names."""

    def __init__(self, data: bytes):
        raw = np.frombuffer(data, np.uint8)
        up, self.down = _POWERS if len(data) < len(_POWERS[0]) else _powers(len(data) + 1)
        with np.errstate(over="ignore"):
            self.sums = np.concatenate([np.zeros(1, _U), np.cumsum(_CODE[raw] * up[: len(raw)], dtype=_U)])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return mix((self.sums[end] - self.sums[start]) * self.down[start] + (end - start).astype(_U)).view(np.int64)


def _pieces(texts: list[bytes]) -> Iterator[list[tuple[int, int, bytes]]]:
    """Lists of (index of text, offset in it, bytes) of about BLOCK bytes; parts of a long text overlap by WINDOW - 1."""
    held, size = [], 0
    for i, t in enumerate(texts):
        if len(t) < WINDOW:
            continue
        for at in range(0, len(t) - WINDOW + 1, BLOCK):
            held.append((i, at, t[at : at + BLOCK + WINDOW - 1]))
            size += len(held[-1][2])
            if size >= BLOCK:
                yield held
                held, size = [], 0
    if held:
        yield held


def _tuples(pieces: list[tuple[int, int, bytes]]) -> list[np.ndarray]:
    """index of text, and anchor, pos, near, far, a, b of each tuple: its windows start at pos - far to pos - near."""
    data = b"".join(p[2] for p in pieces)
    n, reach = len(data), WINDOW - GRAM + 1
    at = np.arange(n - GRAM + 1)
    grams = _Marks(data).of(at, at + GRAM).view(_U)
    keys = grams >> _U(_PLACE) << _U(_PLACE) | at.astype(_U)
    padded = np.full(-(-(n + reach) // reach) * reach, np.iinfo(_U).max, _U)
    padded[: len(keys)] = keys
    rows = padded.reshape(-1, reach)
    ahead = np.minimum.accumulate(rows, axis=1).ravel()
    behind = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    starts = n - WINDOW + 1
    best = (np.minimum(behind[:starts], ahead[reach - 1 : reach - 1 + starts]) & _U((1 << _PLACE) - 1)).astype(np.int64)
    begins = np.cumsum([0] + [len(p[2]) for p in pieces])
    piece = np.repeat(np.arange(len(pieces)), np.diff(begins))[:starts]
    valid = np.arange(starts) + WINDOW <= begins[piece + 1]
    best[~valid] = -1
    first = np.flatnonzero(np.concatenate([[True], (best[1:] != best[:-1]) | (piece[1:] != piece[:-1])]))
    last = np.concatenate([first[1:], [starts]]) - 1
    keep = best[first] >= 0
    first, last = first[keep], last[keep]
    where, of = best[first], piece[first]
    moved = np.array([p[1] for p in pieces])[of] - begins[of]
    return [np.array([p[0] for p in pieces])[of], grams[where].view(np.int64), where + moved, where - last, where - first, *names(data[i:j] for i, j in zip(first.tolist(), (last + WINDOW).tolist(), strict=True))]


def _sampled(docs: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                rows = part.column(0).to_numpy(zero_copy_only=False)
                for pieces in _pieces([(x.as_py() or "").encode() for x in part.column(1)]):
                    of, anchor, pos, near, far, a, b = _tuples(pieces)
                    values = (anchor, rows[of], pos, near.astype(np.int32), far.astype(np.int32), a, b)
                    yield pa.RecordBatch.from_arrays([pa.array(v) for v in values], list(_FIELDS))

    return docs.select("row", "text").mapInArrow(run, ", ".join(f"{n} {t}" for n, t in _FIELDS.items()))


def _open_tuples(docs: DataFrame, spans: DataFrame) -> DataFrame:
    """The unsettled tuples with the bytes that their windows cover, and the document they are in."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                data, row = batch.column(1)[i].as_py().encode(), batch.column(0)[i].as_py()
                spans = batch.column(2)[i].as_py()
                out = [(s["pos"], s["near"], s["far"], data[s["pos"] - s["far"] : s["pos"] - s["near"] + WINDOW]) for s in spans]
                yield pa.RecordBatch.from_arrays([pa.array([row] * len(out), pa.int64()), pa.array([x[0] for x in out], pa.int64()), pa.array([x[1] for x in out], pa.int32()), pa.array([x[2] for x in out], pa.int32()), pa.array([x[3] for x in out], pa.binary())], ["row", "pos", "near", "far", "data"])

    listed = spans.groupBy("row").agg(F.collect_list(F.struct("pos", "near", "far")).alias("spans"))
    return docs.select("row", "text").join(listed, "row").mapInArrow(run, "row long, pos long, near int, far int, data binary")


def _split(tuples: DataFrame, cell: int) -> DataFrame:
    """Parts of tuples (row, pos, near, far, data, offset): the windows of distances from k * cell up to the next. For each
    its name (a, b) and a hash of the bytes common to all windows of the cell (anchor)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                row, pos, near, far, base = (part.column(i).to_numpy().astype(np.int64) for i in range(5))
                data = part.column(5).to_pylist()
                begin = np.cumsum([0] + [len(d) for d in data])[:-1]
                whole = b"".join(data)
                marks = _Marks(whole)
                parts = far // cell - near // cell + 1
                of = np.repeat(np.arange(len(row)), parts)
                k = near[of] // cell + np.arange(len(of)) - np.repeat(np.cumsum(parts) - parts, parts)
                lo, hi = np.maximum(k * cell, near[of]), np.minimum((k + 1) * cell - 1, far[of])
                here = begin[of] + base[of]  # place of the anchor in the joined bytes
                start, end = here - hi, here - lo + WINDOW
                common = marks.of(here - k * cell, here - (k + 1) * cell + 1 + WINDOW)
                values = (common, row[of], pos[of], lo.astype(np.int32), hi.astype(np.int32), *names(whole[i:j] for i, j in zip(start.tolist(), end.tolist(), strict=True)))
                yield pa.RecordBatch.from_arrays([pa.array(v) for v in values], list(_FIELDS))

    return tuples.select("row", "pos", "near", "far", "base", "data").mapInArrow(run, ", ".join(f"{n} {t}" for n, t in _FIELDS.items()))


def _settle(tuples: DataFrame, label: str) -> tuple[DataFrame, DataFrame]:
    """(repeated, open): tuples whose windows are all repeated, and those to split: of which some windows may be,
    and with them one of each repeated name under a shared anchor, which may hold their counterparts."""
    anchors = tuples.groupBy("anchor").agg(F.count("*").alias("n"), F.min(F.struct("a", "b")).alias("least"), F.max(F.struct("a", "b")).alias("most")).where("n > 1")
    anchors = materialise(anchors.select("anchor", (F.col("least") == F.col("most")).alias("same")), f"{label}-anchors")
    again = materialise(tuples.join(anchors, "anchor").select("row", "pos", "near", "far", "a", "b", "same"), f"{label}-again")
    mixed = again.where("not same")
    whole = F.struct("row", "pos", "near", "far")
    names = mixed.groupBy("a", "b").agg(F.count("*").alias("n"), F.min(whole).alias("one")).where("n > 1").select("a", "b", "one")
    mixed = materialise(mixed.join(materialise(names, f"{label}-names"), ["a", "b"], "left").select("row", "pos", "near", "far", F.col("one").isNotNull().alias("found"), (whole == F.col("one")).alias("first")), f"{label}-mixed")
    span = ("row", "pos", "near", "far")
    return again.where("same").select(*span).unionByName(mixed.where("found").select(*span)), mixed.where("not found or first").select(*span)


def repeated_windows(docs: DataFrame) -> DataFrame:
    """row, first, last: ranges of starts of all WINDOW-byte strings of `docs` (row, text) that start elsewhere too. Ranges may overlap."""
    found, rest = _settle(materialise(_sampled(docs), "tuples"), "tuples")
    parts = materialise(_open_tuples(docs, rest), "open").withColumn("base", F.col("far"))
    for cell in (CELL, 1):
        more, rest = _settle(materialise(_split(parts, cell), "cells"), "cells")
        found = found.unionByName(more)
        if cell > 1:
            cells = rest.select("row", "pos", F.col("near").alias("lo"), F.col("far").alias("hi"))
            parts = parts.join(cells, ["row", "pos"]).where("lo >= near and hi <= far")
            # Only the bytes of the cell go on.
            parts = materialise(parts.select("row", "pos", F.col("lo").alias("near"), F.col("hi").alias("far"), F.col("hi").alias("base"), F.expr("substring(data, base - hi + 1, hi - lo + 400)").alias("data")), "open-cells")
    return found.select("row", (F.col("pos") - F.col("far")).alias("first"), (F.col("pos") - F.col("near")).alias("last"))


def remove_repeats(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 and kept (bytes) of each row of `docs`.

    Removed is each byte covered by a 400-byte string that also starts anywhere else, in the same or another document, overlaps
    included; all copies go, the first too. Strings are judged on the input. Texts are UTF-8 bytes; null is empty; texts under 400
    bytes stay. Equal rows remove each other. kept may cut a character. `docs` must be replayable. No rows, no result rows.
    """
    key = free_name(docs.select(doc_id, text), "dedup_row")
    keyed = with_row_key(docs.select(doc_id, text), key).select(F.col(key).alias("row"), F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    spans = repeated_windows(keyed).groupBy("row").agg(F.collect_list(F.struct("first", "last")).alias("spans"))
    kind = docs.schema[doc_id].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for value, spans in zip(batch.column(1), batch.column(2), strict=True):
                data, spans = (value.as_py() or "").encode(), spans.as_py() or []
                ranges: list[list[int]] = []
                for first, end in sorted((s["first"], s["last"] + WINDOW) for s in spans):
                    if ranges and first <= ranges[-1][1]:
                        ranges[-1][1] = max(ranges[-1][1], end)
                    else:
                        ranges.append([first, end])
                kept = b"".join(data[a:b] for a, b in zip([0] + [r[1] for r in ranges], [r[0] for r in ranges] + [len(data)], strict=True))
                out.append((len(data), len(data) - len(kept), len(ranges), hashlib.sha256(kept).hexdigest(), kept))
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array([x[i] for x in out], k) for i, k in enumerate(kinds))], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])

    both = keyed.join(spans, "row", "left").select("doc_id", "text", "spans")
    return both.mapInArrow(run, f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")
