"""Nearest neighbours by shifted Hilbert curves.

1. Equal vectors form one node, so a vector that a third of all rows share is searched once. Of a node's
   ids only the `k` + 1 smallest can be in a result; a windowed limit finds them.
2. `CURVES` Hilbert curves, each over its own `AXES` directions of a random rotation and with its own
   shift, give every node a key on each curve. One range-partitioned sort gives its position there.
3. The window is what the data need: for a bounded sample of queries the true neighbours are found by
   reading all vectors in blocks, and the window is the least distance in positions that holds `RECALL` of them
   on one curve or another. The index covers every row whatever the window is.
4. Along each curve, stretches of queries meet the packed blocks of candidates in their windows. Vectors are
   compared as 16-bit numbers that carry a bound on their error: a candidate is left out only if its product is
   surely below that of `k` others, so all neighbours in a window reach the ranking by exact products, and the
   share that the sample measures is the share of the results.

No step holds more than a block, a stretch, its best products, or `PENDING` candidates in memory.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarrymill.llm.common import materialise, partitions

CURVES = 16
AXES = 4
BITS = 12
#: Share of the sample's true neighbours that the window must hold.
RECALL = 0.98
SAMPLE_ROWS = 4096
SAMPLE_QUERIES = 128
#: Positions in a block of candidates and in a stretch of queries.
BLOCK = 1024
STRETCH = 4096
#: Candidates of a stretch held at most before they are passed on.
PENDING = 1 << 20


def hilbert_keys(cells: np.ndarray, bits: int) -> np.ndarray:
    """Positions on the Hilbert curve of integer cells (n, axes), each below 2**bits."""
    x = cells.astype(np.int64).T.copy()
    n, top = len(x), 1 << (bits - 1)
    q = top
    while q > 1:  # undo the rotations from the largest cube down
        low = q - 1
        for i in range(n):
            high = (x[i] & q) != 0
            swap = np.where(high, 0, (x[0] ^ x[i]) & low)
            x[0] = np.where(high, x[0] ^ low, x[0]) ^ swap
            x[i] ^= swap
        q >>= 1
    for i in range(1, n):
        x[i] ^= x[i - 1]
    flip, q = np.zeros_like(x[0]), top
    while q > 1:
        flip = np.where((x[-1] & q) != 0, flip ^ (q - 1), flip)
        q >>= 1
    x ^= flip
    key = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(n):
            key = key << 1 | x[i] >> b & 1
    return key


class ShiftedCurves:
    """Keys of vectors on several curves; centre and spread come from a sample."""

    def __init__(self, sample: np.ndarray, curves: int = CURVES, axes: int = AXES, seed: int = 7):
        rng, width = np.random.default_rng(seed), sample.shape[1]
        self.axes, self.curves = min(axes, width), curves
        turns = []
        while sum(t.shape[1] for t in turns) < curves * self.axes:
            turns.append(np.linalg.qr(rng.normal(size=(width, width)))[0])
        self.turn = np.hstack(turns)[:, : curves * self.axes]
        at = sample @ self.turn
        self.centre, self.spread = at.mean(0), at.std(0) + 1e-12
        self.shift = rng.random(curves * self.axes) / 2

    def keys(self, vectors: np.ndarray) -> np.ndarray:
        z = np.clip((vectors @ self.turn - self.centre) / self.spread, -30, 30)
        cells = ((1 / (1 + np.exp(-1.702 * z)) + self.shift) / 1.5 * (1 << BITS)).astype(np.int64)
        return np.stack([hilbert_keys(np.minimum(cells[:, c * self.axes : (c + 1) * self.axes], (1 << BITS) - 1), BITS) for c in range(self.curves)], 1)


def _matrix(column: pa.Array) -> np.ndarray:
    return np.array([np.frombuffer(x.as_py(), np.float64) for x in column])


def _nodes(vectors: DataFrame, width: int) -> DataFrame:
    """vec_id, node (digest of the vector) and v (its doubles) of the rows that take part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flat = batch.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, width) + 0.0
            good = np.flatnonzero(np.isfinite(flat).all(1) & (flat != 0).any(1))
            raw = [flat[i].tobytes() for i in good]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(good)), pa.array([hashlib.blake2b(r, digest_size=16).digest() for r in raw], pa.binary()), pa.array(raw, pa.binary())], ["vec_id", "node", "v"])

    whole = vectors.where(F.col("vec_id").isNotNull() & (F.size("embedding") == width) & ~F.exists("embedding", F.isnull))
    return whole.mapInArrow(run, "vec_id long, node binary, v binary")


def _pack(v: np.ndarray) -> list[bytes]:
    """Rows as 16-bit numbers after a scale, a bound on the error of a product for each unit of the other's length, and a bound on the own length."""
    with np.errstate(over="ignore"):
        scale = (np.abs(v).max(1, keepdims=True) / 32767).astype(np.float32)
    near = np.rint(np.divide(v, scale, out=np.zeros_like(v), where=scale > 0)).clip(-32767, 32767).astype(np.int16)
    length = np.linalg.norm(v, axis=1)
    # The rest that rounding leaves, and what a product summed in single precision can be off.
    off = np.linalg.norm(v - near.astype(np.float32) * scale, axis=1) + (v.shape[1] + 8) * 2.0**-23 * length
    head = np.column_stack([scale[:, 0], *(np.nextafter(x.astype(np.float32), np.float32(np.inf)) for x in (off, length))])
    return [a.tobytes() + b.tobytes() for a, b in zip(head, near, strict=True)]


def _unpack(rows: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The rounded vectors, and (error, length) of each."""
    raw = np.array([np.frombuffer(x, np.int16) for x in rows])
    head = np.ascontiguousarray(raw[:, :6]).view(np.float32)
    return raw[:, 6:].astype(np.float32) * head[:, :1], head[:, 1:]


def _products(q: np.ndarray, q_bounds: np.ndarray, v: np.ndarray, v_bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lower and upper bounds of the exact products of unpacked rows; numbers out of single precision's range bound nothing."""
    with np.errstate(all="ignore"):
        product = q @ v.T
        error = q_bounds[:, ::-1] @ v_bounds.T + np.float32(2.0**-126)  # |q| off(v) + off(q) |v|
        low, high = product - error, product + error
    low[~(low < np.inf)] = -np.inf
    high[~(high > -np.inf)] = np.inf
    return low, high


def _best(scores: np.ndarray, k: int) -> np.ndarray:
    """Columns of the k largest of each row."""
    return np.argpartition(-scores, k - 1, axis=1)[:, :k] if scores.shape[1] > k else np.broadcast_to(np.arange(scores.shape[1]), scores.shape)


def _true_neighbours(classes: DataFrame, queries: list, k: int) -> DataFrame:
    """q, node: for each of a bounded list of (node, vector) the k nearest other nodes of all."""
    names, matrix = [q[0] for q in queries], np.array([np.frombuffer(q[1]) for q in queries])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            nodes, scores = batch.column(0).to_pylist(), matrix @ _matrix(batch.column(1)).T
            for i, name in enumerate(names):
                scores[i, [j for j, n in enumerate(nodes) if n == name]] = -np.inf
            best = _best(scores, k)
            q = np.repeat(np.arange(len(names)), best.shape[1])
            yield pa.RecordBatch.from_arrays([pa.array(q), pa.array([nodes[j] for j in best.ravel()], pa.binary()), pa.array(scores[q, best.ravel()])], ["q", "node", "score"])

    found = classes.select("node", "v").mapInArrow(run, "q long, node binary, score double").where("score > double('-Infinity')")
    return found.withColumn("n", F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), "node"))).where(F.col("n") <= k).select("q", "node")


def _positions(keyed: DataFrame) -> DataFrame:
    """curve, pos (from 0 on each curve), node, v, is_query: the order on each curve, by one range-partitioned sort."""
    order = ["curve", "key", "node"]
    sort = keyed.repartitionByRange(partitions(keyed.sparkSession), *order).sortWithinPartitions(*order).withColumn("place", F.monotonically_increasing_id())
    sort = materialise(sort.drop("key"), "curves")
    # A row for each curve in each partition.
    parts = sort.groupBy("curve", F.shiftright("place", 33).alias("part")).agg(F.min("place").alias("first"), F.count("*").alias("n")).orderBy("curve", "part").collect()
    base, rows = {}, []
    for p in parts:
        rows.append((p["curve"], p["part"], base.get(p["curve"], 0) - p["first"]))
        base[p["curve"]] = base.get(p["curve"], 0) + p["n"]
    moves = F.broadcast(keyed.sparkSession.createDataFrame(rows, "curve int, part long, move long"))
    return sort.withColumn("part", F.shiftright("place", 33)).join(moves, ["curve", "part"]).select("curve", (F.col("place") + F.col("move")).alias("pos"), "node", "v", "is_query")


def nearest(vectors: DataFrame, *, k: int = 20, every: int = 20, recall: float = RECALL, curves: int = CURVES) -> DataFrame:
    """The k nearest of all other rows of `vectors` (vec_id, embedding) to each row whose vec_id is divisible by `every`.

    Returns query_id, rank (from 1), vec_id, score: the inner product in double precision, largest first, ties to the
    smaller vec_id. Rows with a null vec_id, or a vector that is null, zero, of another length than the most common one, or
    holds null or non-finite numbers, take no part. Equal vectors of different rows are found; of equal rows (same id and
    vector) one is kept. With k other rows or fewer all are returned. Without queries or candidates there is no row.
    """
    spark = vectors.sparkSession
    vectors = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding")
    common = vectors.where("embedding is not null").groupBy(F.size("embedding").alias("n")).count().orderBy(F.desc("count"), F.desc("n")).first()
    empty = spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    if common is None or common["n"] < 1:
        return empty
    base = materialise(_nodes(vectors, common["n"]), "vectors")
    asked = F.col("vec_id") % every == 0
    classes = materialise(base.groupBy("node").agg(F.first("v").alias("v"), F.max(asked).alias("is_query")), "nodes")
    sample = classes.orderBy(F.xxhash64("node")).limit(SAMPLE_ROWS).select("v").collect()
    some = classes.where("is_query").orderBy(F.xxhash64("node", F.lit(1))).limit(SAMPLE_QUERIES).select("node", "v").collect()
    if not some:
        return empty
    fitted = ShiftedCurves(np.array([np.frombuffer(r["v"]) for r in sample]), curves)
    step = STRETCH

    def key(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                v = _matrix(batch.column(1))
                keys = fitted.keys(v)
                packed = pa.array(_pack(v), pa.binary())
                for c in range(keys.shape[1]):
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(v), c, np.int32)), pa.array(keys[:, c]), batch.column(0), packed, batch.column(2)], ["curve", "key", "node", "v", "is_query"])

    placed = _positions(classes.mapInArrow(key, "curve int, key long, node binary, v binary, is_query boolean"))

    true = _true_neighbours(classes, some, k).withColumn("other", F.lit(True))
    near = true.unionByName(spark.createDataFrame([(i, r["node"], False) for i, r in enumerate(some)], "q long, node binary, other boolean"))
    spots: dict = {}
    for r in placed.join(F.broadcast(near), "node").select("q", "curve", "pos", "other", "node").collect():  # of the sample's neighbours only
        spots.setdefault((r["q"], r["other"], bytes(r["node"])), {})[r["curve"]] = r["pos"]
    own = {q: at for (q, other, _), at in spots.items() if not other}
    gaps = sorted(min(abs(p - own[q][c]) for c, p in at.items()) for (q, other, _), at in spots.items() if other)
    window = int(gaps[min(len(gaps) - 1, int(np.ceil(recall * len(gaps))) - 1)]) if gaps else 0

    blocks = placed.groupBy("curve", F.floor(F.col("pos") / BLOCK).alias("block")).agg(F.collect_list(F.struct("pos", "node", "v")).alias("rows"))  # BLOCK rows each
    first = F.floor(F.greatest(F.col("block") * BLOCK - window, F.lit(0)) / step)
    last = F.floor(((F.col("block") + 1) * BLOCK - 1 + window) / step)
    asking = placed.where("is_query").groupBy("curve", F.floor(F.col("pos") / step).alias("stretch")).agg(F.collect_list(F.struct("pos", "node", "v")).alias("rows"))  # STRETCH rows at most
    asking = asking.select("curve", "stretch", F.lit(-1).cast("long").alias("block"), "rows")
    meeting = blocks.select("curve", F.explode(F.sequence(first, last)).alias("stretch"), "block", "rows").join(asking.select("curve", "stretch"), ["curve", "stretch"], "left_semi").unionByName(asking)
    # Dealt by a hash of its own: both sides are already dealt by curve and stretch, but not into the same partitions once AQE has merged some.
    meeting = meeting.repartition(partitions(spark), F.xxhash64("curve", "stretch", F.lit(2))).sortWithinPartitions("curve", "stretch", "block")

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []

        def pairs() -> pa.RecordBatch:
            q, nodes, low, high = (np.concatenate(x) for x in zip(*held, strict=True))
            return pa.RecordBatch.from_arrays([pa.array([names[i] for i in q], pa.binary()), pa.array(nodes.tolist(), pa.binary()), pa.array(low.astype(np.float64)), pa.array(high.astype(np.float64))], ["q", "node", "low", "high"])

        def pruned() -> list:
            return [tuple(x[keep] for x in part) for part in held if (keep := ~(part[3] < floor[part[0]])).any()]

        for batch in batches:
            for i in range(batch.num_rows):
                at, block, rows = (batch.column(0)[i].as_py(), batch.column(1)[i].as_py()), batch.column(2)[i].as_py(), batch.column(3)[i].values
                pos, nodes, (v, bounds) = rows.field("pos").to_numpy(), rows.field("node").to_pylist(), _unpack(rows.field("v").to_pylist())
                if block < 0:
                    if now is not None and (held := pruned()):
                        yield pairs()
                    now, mine, mine_bounds, names, where, held = at, v, bounds, nodes, pos, []
                    best, floor = np.full((len(v), k), -np.inf, np.float32), np.full(len(v), -np.inf, np.float32)
                    continue
                low, high = _products(mine, mine_bounds, v, bounds)
                gap = pos[None, :] - where[:, None]
                out = (np.abs(gap) > window) | (gap == 0)
                low[out] = -np.inf
                best = np.concatenate([best, low], 1)
                best = np.take_along_axis(best, _best(best, k), 1)
                floor = best.min(1)  # k others have at least this product
                q, j = np.nonzero(~out & ~(high < floor[:, None]))
                held.append((q, np.array([*nodes, None], object)[:-1][j], low[q, j], high[q, j]))
                if sum(len(part[0]) for part in held) > PENDING:
                    held = pruned()
                    if sum(len(part[0]) for part in held) > PENDING // 2:
                        yield pairs()
                        held = []
        if now is not None and (held := pruned()):
            yield pairs()

    found = meeting.select("curve", "stretch", "block", "rows").mapInArrow(meet, "q binary, node binary, low double, high double")
    found = found.groupBy("q", "node").agg(F.max("low").alias("low"), F.min("high").alias("high"))
    ranked = Window.partitionBy("q").orderBy(F.desc("low")).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    pairs = found.withColumn("floor", F.nth_value("low", k).over(ranked)).where("floor is null or not high < floor").select("q", "node")
    itself = classes.where("is_query").select(F.col("node").alias("q"), "node")
    pairs = materialise(pairs.unionByName(itself), "pairs")

    def products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                score = np.einsum("ij,ij->i", _matrix(batch.column(2)), _matrix(batch.column(3)))
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(score)], ["q", "node", "score"])

    both = pairs.join(classes.select("node", F.col("v").alias("v")), "node").join(classes.select(F.col("node").alias("q"), F.col("v").alias("v_q")), "q")
    exact = both.select("q", "node", "v_q", "v").mapInArrow(products, "q binary, node binary, score double")
    ids = base.select("node", "vec_id").distinct().withColumn("n", F.row_number().over(Window.partitionBy("node").orderBy("vec_id"))).where(F.col("n") <= k + 1).select("node", "vec_id")
    listed = exact.join(ids, "node").withColumn("n", F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), "vec_id"))).where(F.col("n") <= k + 1)
    listed = listed.groupBy("q").agg(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("far"), "vec_id"))).alias("near"))  # k + 1 each
    askers = base.where(asked).select(F.col("node").alias("q"), F.col("vec_id").alias("query_id")).distinct()
    out = askers.join(listed, "q").select("query_id", F.posexplode(F.slice(F.filter("near", lambda x: x["vec_id"] != F.col("query_id")), 1, k)).alias("at", "x"))
    return out.select("query_id", (F.col("at") + 1).cast("int").alias("rank"), F.col("x.vec_id").alias("vec_id"), (-F.col("x.far")).alias("score"))
