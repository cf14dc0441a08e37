"""Line dedup with a suffix array over sequences of line ids, built by distributed prefix doubling.

A text is a sequence of lines. The suffixes that start at its lines are sorted by their first line,
then by 2, 4, 8, ... lines: the rank of a suffix at depth 2h is the order of the pair of the ranks at
depth h of it and of the suffix h lines on. Each depth takes one range-partitioned sort, so a line
that a third of all rows share is spread over partitions, and one regrouping by document.

A run of lines counts as repeated if it has `min_words` words or more. What has to be known of the
array are the intervals of suffixes with a common prefix of that many words, so a suffix is sorted only
as deep as the shortest such prefix needs (two overlapping powers of two cover any depth between), and
those whose lines are nowhere repeated drop out after the first depth. The shortest runs of enough
words that start or end at a line cover every maximal repeated run. In an interval the first run, by
document and line, stays; later copies are deleted.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from quarrymill.llm.common import forget, free_name, materialise, partitions, with_row_key

MIN_WORDS = 50
_PART = 33  # monotonically_increasing_id() holds the partition above these bits


def _shortest_runs(words: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """For each line the number of lines of the shortest run from it, and up to it, of `least` words; 0 if none."""
    total = np.concatenate([[0], np.cumsum(words)])
    n = len(words)
    at = np.arange(n)
    end = np.searchsorted(total, total[:-1] + least, side="left")  # the first end that has enough
    ahead = np.where(end <= n, np.maximum(end, at + 1) - at, 0)
    start = np.searchsorted(total, total[1:] - least, side="right") - 1  # the last start that has enough
    back = np.where(total[1:] >= least, at + 1 - np.minimum(start, at), 0)
    return ahead, back


def _lines(docs: DataFrame, min_words: int) -> DataFrame:
    """row, pos, a, b (the line's 128-bit hash) and the lengths of the shortest runs ahead and back."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from quarrymill.llm import hashing

        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                rows, cols = part.column(0).to_numpy(zero_copy_only=False), [[] for _ in range(6)]
                for row, (a, b, words) in zip(rows, hashing.lines_of(x.as_py() for x in part.column(1)), strict=True):
                    n = len(a)
                    for col, x in zip(cols, (np.full(n, row), np.arange(n), a, b, *_shortest_runs(words, min_words)), strict=True):
                        col.append(x)
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c).astype(np.int64)) for c in cols], ["row", "pos", "a", "b", "ahead", "back"])

    return docs.select("row", "text").mapInArrow(run, "row long, pos long, a long, b long, ahead long, back long")


def ranked(df: DataFrame, keys: list[str], ties: list[str], label: str) -> tuple[DataFrame, DataFrame]:
    """`df` (of longs, written before) with place, its position in the order of keys and ties; rank, the place of the
    first row with the same keys; and alone, which is true only of rows that share their keys with no other row. The second
    result is the table that the first reads, to be forgotten with it.

    One range-partitioned sort. Equal keys may span partitions; what a partition begins with is
    looked up in a table of one row for each partition.
    """
    order, names = [*keys, *ties], df.columns
    index = [names.index(k) for k in keys]

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, rank = None, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            cols = [batch.column(i).to_numpy() for i in index]
            place = batch.column(len(names)).to_numpy()
            new = np.concatenate([[last != tuple(c[0] for c in cols)], np.logical_or.reduce([c[1:] != c[:-1] for c in cols])])
            alone = new & np.concatenate([new[1:], [False]])
            alone[0] = False
            found = np.maximum.accumulate(np.where(new, place, -1))
            found = np.where(found < 0, rank, found)
            last, rank = tuple(c[-1] for c in cols), found[-1]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found), pa.array(alone)], [*names, "place", "rank", "alone"])

    spark = df.sparkSession
    sort = df.repartitionByRange(partitions(spark), *order).sortWithinPartitions(*order).withColumn("place", F.monotonically_increasing_id())
    out = materialise(sort.mapInArrow(mark, ", ".join(f"{n} long" for n in [*names, "place", "rank"]) + ", alone boolean"), label)
    edge = F.struct(*keys, "rank")
    ends = out.groupBy(F.shiftright("place", _PART).alias("part")).agg(F.min_by(edge, "place").alias("first"), F.max_by(edge, "place").alias("last")).orderBy("part").collect()
    renamed, before = {}, None
    for e in ends:  # a row for each partition
        first, last = tuple(e["first"]), tuple(e["last"])
        true = before[-1] if before is not None and before[:-1] == first[:-1] else first[-1]
        if true != first[-1]:
            renamed[e["part"]] = (first[-1], true)
        before = (*last[:-1], true if last[-1] == first[-1] else last[-1])
    if not renamed:
        return out, out
    slots = [renamed.get(p, (None, None)) for p in range(max(renamed) + 1)]  # a rank occurs in one partition only, so its number says which to look at
    stale, true = (F.get(F.array(*[F.lit(x[k]).cast("long") for x in slots]), F.shiftright("place", _PART).cast("int")) for k in (0, 1))
    return out.withColumn("rank", F.when(F.col("rank") == stale, true).otherwise(F.col("rank"))).select(*names, "place", "rank", "alone"), out


def _by_document(batches: Iterator[pa.RecordBatch]) -> Iterator[list[np.ndarray]]:
    """Columns of whole documents from rows that are sorted by the first column: some eight longs for each line of one document,
    whose text Spark holds as one value anyway."""
    held: list[list[np.ndarray]] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        cols = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
        cut = int(np.searchsorted(cols[0], cols[0][-1]))  # the last document may go on
        if cut:
            yield [np.concatenate(x) for x in zip(*held, [c[:cut] for c in cols], strict=True)] if held else [c[:cut] for c in cols]
            held = []
        held.append([c[cut:] for c in cols])
        if len(held) > 1 and held[0][0][0] != held[-1][0][0]:
            yield [np.concatenate(x) for x in zip(*held[:-1], strict=True)]
            held = held[-1:]
    if held:
        yield [np.concatenate(x) for x in zip(*held, strict=True)]


def _deepen(ranks: DataFrame, depth: int, label: str) -> DataFrame:
    """From ranks at `depth` to runs that are named by now (kind 0: shortest ahead, 1: back) and, for
    the suffixes of longer runs, the pairs of ranks that make the next depth (kind 2).

    A run ahead of length m is held by its first suffix, one back by the last suffix that lies in
    it whole, so at `depth` its first line is m - depth before.
    """
    h = depth

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row, pos, rank, alone, ahead, back in _by_document(batches):
            n = len(row)
            if h == 1:  # a run with a line that occurs once is no repeat
                once = np.concatenate([[0], np.cumsum(alone)])
                at = np.arange(n)
                ahead = np.where((ahead > 0) & (once[np.minimum(at + ahead, n)] == once[at]), ahead, 0)
                back = np.where((back > 0) & (once[at + 1] == once[np.maximum(at + 1 - back, 0)]), back, 0)
            out = [[] for _ in range(8)]

            def put(kind, rows, start, a, b, m, to_ahead, to_back, out=out):
                for o, x in zip(out, (np.full(len(rows), kind), rows, start, a, b, m, to_ahead, to_back), strict=True):
                    o.append(np.asarray(x, np.int64))

            none = np.zeros(0, np.int64)
            for kind, m in ((0, ahead), (1, back)):
                i = np.flatnonzero((m >= h) & (m < 2 * h))
                over = m[i] - h
                first, last = (i, i + over) if kind == 0 else (i - over, i)
                put(kind, row[i], pos[first], rank[first], rank[last], m[i], np.zeros(len(i)), np.zeros(len(i)))
            fore, aft = np.flatnonzero(ahead >= 2 * h), np.flatnonzero(back >= 2 * h)
            cover = np.zeros(n + 1, np.int64)
            np.add.at(cover, fore, 1)
            np.add.at(cover, fore + ahead[fore] - 2 * h + 1, -1)
            np.add.at(cover, aft - back[aft] + h, 1)
            np.add.at(cover, aft - h + 1, -1)
            i = np.flatnonzero(np.cumsum(cover[:-1]) > 0)
            to_ahead, to_back = np.zeros(n, np.int64), np.zeros(n, np.int64)
            to_ahead[fore] = ahead[fore]
            to_back[aft - h] = back[aft]
            put(2, row[i], pos[i], rank[i], rank[i + h] if len(i) else none, np.zeros(len(i)), to_ahead[i], to_back[i])
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(o)) for o in out], ["kind", "row", "pos", "a", "b", "m", "ahead", "back"])

    together = ranks.select("row", "pos", "rank", "alone", "ahead", "back").repartition(partitions(ranks.sparkSession), "row").sortWithinPartitions("row", "pos")
    return materialise(together.mapInArrow(run, ", ".join(f"{c} long" for c in ("kind", "row", "pos", "a", "b", "m", "ahead", "back"))), label)


def later_copies(docs: DataFrame, *, min_words: int = MIN_WORDS) -> DataFrame:
    """row, start, lines: runs of `docs` (row, seq, text) that copy an earlier one; order is by seq, then row, then line.

    Runs may overlap. seq must be a long and may repeat.
    """
    at = materialise(_lines(docs, min_words), "lines")
    (ranks, written), depth, named, runs = ranked(at, ["a", "b"], ["row", "pos"], "ranks"), 1, None, []
    forget(at)
    while True:
        made = _deepen(ranks, depth, "runs")
        forget(written)
        runs.append(made)
        found = made.where("kind < 2").select("kind", "m", "a", "b", "row", "pos")
        named = found if named is None else named.unionByName(found)
        pairs = made.where("kind = 2").select("row", "pos", "a", "b", "ahead", "back")
        if pairs.isEmpty():
            break
        (ranks, written), depth = ranked(pairs, ["a", "b"], ["row", "pos"], "ranks"), 2 * depth
    order = docs.select("row", "seq")
    named = materialise(named.join(order.hint("merge"), "row").select("kind", "m", "a", "b", "seq", "row", "pos"), "named-runs")
    forget(*runs)
    copies = ranked(named, ["kind", "m", "a", "b"], ["seq", "row", "pos"], "intervals")[0]
    forget(named)
    return copies.where("place != rank").select("row", F.col("pos").alias("start"), F.col("m").alias("lines"))


def dedup_lines(docs: DataFrame, *, min_words: int = MIN_WORDS, doc_id: str = "doc_id", text: str = "text", counts: bool = False) -> DataFrame:
    """`docs`, all columns, without the later copies of repeated runs of lines.

    A run is one line or more of one document, `min_words` words or more in all, that also occurs earlier:
    in a document with a smaller doc_id (null last, then by row), or further up in the same one. Lines end at
    line feeds. Null and empty texts stay as they are; a text may become empty, its row stays. Equal rows are copies of
    the first. With `counts`, n_lines, n_removed and n_runs (maximal removed runs) are added
    (names that the input has get underscores). `docs` must be replayable and its doc_id an integer. No rows, no result rows.
    """
    if not isinstance(docs.schema[doc_id].dataType, IntegralType):
        raise TypeError(f"{doc_id} must be an integer: it says which copy is earlier")
    key, found = free_name(docs, "line_row"), free_name(docs, "line_runs")
    keyed = with_row_key(docs, key)
    seq = F.coalesce(F.col(doc_id).cast("long"), F.lit((1 << 63) - 1))
    runs = later_copies(keyed.select(F.col(key).alias("row"), seq.alias("seq"), F.col(text).alias("text")), min_words=min_words)
    runs = runs.groupBy(F.col("row").alias(key)).agg(F.collect_list(F.struct("start", "lines")).alias(found))
    both = keyed.join(runs.hint("merge"), key, "left").select(*docs.columns, found)
    at, names = docs.columns.index(text), list(docs.columns)
    extra = [free_name(docs, n) for n in ("n_lines", "n_removed", "n_runs")]

    def cut(value: str | None, spans) -> tuple[str | None, int, int, int]:
        lines = (value or "").split("\n")
        if not spans:
            return value, len(lines), 0, 0
        cover = np.zeros(len(lines) + 1, np.int64)
        for s in spans:
            cover[s["start"]] += 1
            cover[s["start"] + s["lines"]] -= 1
        gone = np.cumsum(cover[:-1]) > 0
        runs = int(np.sum(np.diff(np.concatenate([[0], gone.astype(np.int8)])) == 1))
        return "\n".join(x for x, g in zip(lines, gone, strict=True) if not g), len(lines), int(gone.sum()), runs

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            new = [cut(t.as_py(), s.as_py()) for t, s in zip(batch.column(at), batch.column(len(names)), strict=True)]
            cols = list(batch.columns[: len(names)])
            cols[at] = pa.array([x[0] for x in new], cols[at].type)
            more = [pa.array([x[k] for x in new], pa.int64()) for k in (1, 2, 3)]
            yield pa.RecordBatch.from_arrays([*cols, *more], [*names, *extra])

    schema = docs.withColumns({n: F.lit(0).cast("long") for n in extra}).schema
    out = both.mapInArrow(run, schema)
    return out if counts else out.select(*names)


def line_dedup_table(docs: DataFrame, *, min_words: int = MIN_WORDS) -> DataFrame:
    """doc_id, n_lines, n_removed, n_runs and kept_sha256 (lowercase hex, null for a null text) of every document; edge cases as in
    `dedup_lines`."""
    out = dedup_lines(docs.select("doc_id", "text"), min_words=min_words, counts=True)
    return out.select("doc_id", "n_lines", "n_removed", "n_runs", F.sha2(F.encode("text", "UTF-8"), 256).alias("kept_sha256"))


#: What line_dedup_table returns, in DuckDB SQL over `documents` with distinct ids.
ORACLE = """
WITH l AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, unnest(range(len(string_split(coalesce(text, ''), chr(10))))) AS pos FROM documents),
w AS (SELECT *, len(regexp_extract_all(line, '[^\\x20\\x09-\\x0D]+')) AS n FROM l),
t AS (SELECT *, sum(n) OVER (PARTITION BY doc_id ORDER BY pos) AS upto, sum(n) OVER (PARTITION BY doc_id ORDER BY pos) - n AS before FROM w),
d AS (SELECT doc_id, list(line ORDER BY pos) AS lines FROM l GROUP BY doc_id),
ahead AS (SELECT a.doc_id, a.pos AS s, min(b.pos) AS e FROM t a JOIN t b ON a.doc_id = b.doc_id AND b.pos >= a.pos AND b.upto - a.before >= 50 GROUP BY ALL),
back AS (SELECT b.doc_id, max(a.pos) AS s, b.pos AS e FROM t a JOIN t b ON a.doc_id = b.doc_id AND b.pos >= a.pos AND b.upto - a.before >= 50 GROUP BY ALL),
r AS (SELECT 0 AS kind, * FROM ahead UNION ALL SELECT 1, * FROM back),
k AS (SELECT kind, doc_id, s, e, row_number() OVER (PARTITION BY kind, e - s, array_to_string(lines[s + 1 : e + 1], chr(10)) ORDER BY doc_id, s) AS copy FROM r JOIN d USING (doc_id)),
gone AS (SELECT DISTINCT t.doc_id, t.pos FROM t JOIN k ON t.doc_id = k.doc_id AND t.pos BETWEEN k.s AND k.e AND k.copy > 1),
m AS (SELECT l.doc_id, l.pos, l.line, g.pos IS NOT NULL AS g, lag(g.pos IS NOT NULL, 1, false) OVER (PARTITION BY l.doc_id ORDER BY l.pos) AS p FROM l LEFT JOIN gone g ON l.doc_id = g.doc_id AND l.pos = g.pos)
SELECT m.doc_id, count(*) AS n_lines, count(*) FILTER (g) AS n_removed, count(*) FILTER (g AND NOT p) AS n_runs,
       CASE WHEN any_value(x.text) IS NOT NULL THEN sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT g), '')) END AS kept_sha256
FROM m JOIN documents x USING (doc_id) GROUP BY m.doc_id"""
