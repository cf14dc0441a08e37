"""Toxicity by compression distance.

A text is coded word by word: eight bytes of a hash of the word's beginning, eight of the whole word. So
a match of the compressor is a word or a stem, never a chance run of letters, and short words weigh as
much as long ones. One zstandard dictionary is trained on ordinary text, another on spans that mark toxic
texts: runs of codes that are many times rarer in all ordinary texts of the fold, without which the words
that any text has would fill both dictionaries alike. Each window is compressed with either dictionary. What
the lengths differ by makes a few features of a text, and a logistic curve fitted on other labelled documents
turns them into a calibrated probability.

Learning reads whole texts of a bounded sample of labelled rows (`MAX_ROWS` distinct texts of each label and
fold), and all ordinary texts of the fold to tell rare wording from chance. Texts stay in tasks: the driver
gets `TRAIN_WINDOWS` windows and spans, `MARKS` codes and a row of features for each sampled text at most.
Scoring reads every window of every text.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrymill.llm.common import forget, free_name, materialise

#: Distinct labelled texts of each label that learning samples at most, for the dictionaries and again to calibrate.
MAX_ROWS = 1500
#: Windows of ordinary text, and spans of toxic text, that a dictionary is trained on at most: those of the least hashes.
TRAIN_WINDOWS = 40_000
#: Codes that may mark toxic texts, the commonest first.
MARKS = 4096
#: Codes in a window, two for each word, of eight bytes each.
WINDOW = 16
STEM = 5
#: A code marks toxic texts if so many of them have it, and this many times the share of others.
LEAST_TEXTS = 3
LEAST_RATIO = 24.0
ORDINARY_BYTES, TOXIC_BYTES = 16384, 8192
FEATURES = 5
#: Codes of words seen, per Python worker. A full table is emptied, so only speed depends on it.
CACHE_WORDS = 100_000
_WORDS = re.compile(r"\w+").findall


class Coder:
    """Texts as codes of their words."""

    def __init__(self):
        self.known: dict[str, bytes] = {}

    def _new(self, word: str) -> bytes:
        if len(self.known) >= CACHE_WORDS:
            self.known.clear()
        one = lambda x: hashlib.blake2b(x.encode(errors="replace"), digest_size=8).digest()
        out = one(word[:STEM]) + one(word + " ")
        if len(word) <= 64:
            self.known[word] = out
        return out

    def codes(self, text: str | None) -> bytes:
        known, new = self.known.get, self._new
        return b"".join([known(w) or new(w) for w in _WORDS((text or "").lower())])

    def windows(self, text: str | None) -> list[bytes]:
        """The whole text in windows; one empty window if there is no word."""
        codes, step = self.codes(text), 8 * WINDOW
        return [codes[i : i + step] for i in range(0, len(codes), step)] or [b""]


def _units(codes: bytes) -> np.ndarray:
    return np.frombuffer(codes, ">i8")


def _texts_with(texts: DataFrame, name: str) -> DataFrame:
    """unit and, in `name`, in how many texts it occurs; unit null: the number of texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = Coder()
        for batch in batches:
            own = [np.unique(_units(coder.codes(x.as_py()))) for x in batch.column(0)]
            unit, n = np.unique(np.concatenate([np.zeros(0, np.int64), *own]).astype(np.int64), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array([*unit.tolist(), None], pa.int64()), pa.array([*n.tolist(), len(own)], pa.int64())], ["unit", "n"])

    return texts.select("text").mapInArrow(run, "unit long, n long").groupBy("unit").agg(F.sum("n").alias(name))


def _marks(toxic: DataFrame, ordinary: DataFrame) -> np.ndarray:
    """Codes much more usual in the toxic texts than in the ordinary ones, sorted."""
    own, others = _texts_with(toxic, "n"), _texts_with(ordinary, "others")
    both = own.where((F.col("n") >= LEAST_TEXTS) | F.col("unit").isNull()).join(others.hint("merge"), own["unit"].eqNullSafe(others["unit"]), "left").select(own["unit"], "n", F.coalesce("others", F.lit(0)).alias("others"))
    both = materialise(both, "marks")
    total = both.where("unit is null").first()
    found = []
    if total is not None and total["n"]:
        rare = F.col("n") / total["n"] > LEAST_RATIO * (F.col("others") + 1) / max(1, total["others"])
        found = [r["unit"] for r in both.where(F.col("unit").isNotNull() & rare).orderBy(F.desc("n"), "unit").limit(MARKS).collect()]  # MARKS rows
    forget(both)
    return np.array(sorted(found), np.int64)


def _spans(codes: bytes, marks: np.ndarray) -> list[bytes]:
    """Runs of marking codes."""
    hit = np.isin(_units(codes).astype(np.int64), marks)
    edge = np.diff(np.concatenate([[0], hit.astype(np.int8), [0]]))
    return [codes[8 * a : 8 * b] for a, b in zip(np.flatnonzero(edge == 1), np.flatnonzero(edge == -1), strict=True)]


def _samples(texts: DataFrame, cut) -> list[bytes]:
    """TRAIN_WINDOWS distinct pieces that `cut(coder, text)` makes, in the order of their hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = Coder()
        for batch in batches:
            for x in batch.column(0):
                yield pa.RecordBatch.from_arrays([pa.array(list(dict.fromkeys(cut(coder, x.as_py()))), pa.binary())], ["piece"])

    pieces = texts.select("text").mapInArrow(run, "piece binary").distinct()
    return [bytes(r["piece"]) for r in pieces.orderBy(F.xxhash64("piece"), "piece").limit(TRAIN_WINDOWS).collect()]  # TRAIN_WINDOWS rows


def _dictionary(samples: list[bytes], size: int) -> bytes:
    """Content of a trained zstandard dictionary; what there is of the samples if too little to train."""
    import zstandard

    total = sum(map(len, samples))
    if not total:
        return b""
    if total < 50 * size:  # the trainer wants many samples
        samples = samples * (1 + 50 * size // total)
    try:
        trained = zstandard.train_dictionary(size, samples, k=16, d=8, level=3).as_bytes()
    except (zstandard.ZstdError, ValueError):
        return b"".join(dict.fromkeys(samples))[:size]
    return trained[-size:]


@dataclass(frozen=True)
class ToxicityModel:
    ordinary: bytes
    toxic: bytes
    #: Centre and scale of each feature, weights, and the constant term.
    centre: tuple[float, ...] = (0.0,) * FEATURES
    scale: tuple[float, ...] = (1.0,) * FEATURES
    weights: tuple[float, ...] = (0.0,) * (FEATURES + 3)
    constant: float = 0.0

    def compressors(self):
        import zstandard

        def one(content: bytes):
            # With this strategy and target length literals stay plain, so a length is what no match covers.
            options = zstandard.ZstdCompressionParameters(strategy=zstandard.STRATEGY_FAST, target_length=1, min_match=7, hash_log=17, chain_log=17, search_log=4, window_log=18, write_content_size=False)
            if not content:
                return zstandard.ZstdCompressor(compression_params=options).compress
            words = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            words.precompute_compress(compression_params=options)
            return zstandard.ZstdCompressor(dict_data=words, compression_params=options).compress

        return one(b""), one(self.ordinary), one(self.toxic)

    def features(self, windows: list[bytes], compressors) -> tuple[float, ...]:
        """Mean and largest saving of the toxic dictionary on a window, share of windows with a clear one, log of their
        number, and the mean of what the toxic dictionary saves beyond the ordinary one."""
        none, ordinary, toxic = compressors
        saved, beyond = np.zeros(len(windows)), np.zeros(len(windows))
        for i, w in enumerate(windows):
            length = len(toxic(w))
            saved[i], beyond[i] = len(none(w)) - length, len(ordinary(w)) - length
        return saved.mean(), min(saved.max(), 24.0), (saved >= 4).mean(), np.log(len(windows)), beyond.mean()

    def probability(self, features: np.ndarray) -> np.ndarray:
        if not len(features):
            return np.zeros(0)
        x = _expand((features - np.array(self.centre)) / np.array(self.scale))
        return 1 / (1 + np.exp(-np.clip(x @ np.array(self.weights) + self.constant, -35, 35)))


def _expand(x: np.ndarray) -> np.ndarray:
    """With the products of mean, largest and share."""
    return np.column_stack([x, x[:, 0] * x[:, 1], x[:, 1] * x[:, 2], x[:, 0] * x[:, 2]])


def _calibrated(model: ToxicityModel, features: np.ndarray, labels: np.ndarray, weight: np.ndarray) -> ToxicityModel:
    """Logistic regression by Newton steps, with a small ridge. Without both labels: their share."""
    if not len(labels):
        return ToxicityModel(model.ordinary, model.toxic)
    centre, scale = features.mean(0), features.std(0) + 1e-6
    x = np.column_stack([_expand((features - centre) / scale), np.ones(len(labels))])
    w = np.zeros(x.shape[1])
    ridge = np.diag([1.0] * (x.shape[1] - 1) + [1e-3])
    for _ in range(40):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -35, 35)))
        w -= np.linalg.solve((x.T * (weight * p * (1 - p))) @ x + ridge, x.T @ (weight * (p - labels)) + ridge @ w)
    return ToxicityModel(model.ordinary, model.toxic, tuple(centre), tuple(scale), tuple(w[:-1]), float(w[-1]))


def _featured(texts: DataFrame, model: ToxicityModel) -> DataFrame:
    """toxic and the features f of each of `texts` (toxic, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tools, coder = model.compressors(), Coder()
        for batch in batches:
            found = [[float(v) for v in model.features(coder.windows(x.as_py()), tools)] for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.list_(pa.float64()))], ["toxic", "f"])

    return texts.select("toxic", "text").mapInArrow(run, "toxic int, f array<double>")


def _fold(doc_id) -> "F.Column":
    return F.pmod(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(3))


def train(docs: DataFrame, labels: DataFrame, *, doc_id: str = "doc_id", text: str = "text", label: str = "toxic") -> ToxicityModel:
    """A model from the labelled rows of `docs` whose crc32(doc_id as text) mod 3 is 0 (dictionaries) or 2 (calibration).

    A document with both labels counts as toxic; null labels, ids and unlabelled rows are left out. Equal
    texts of a label count once. Without rows of a fold or a label the score is the share of label 1 (0.5 with none).
    """
    known = labels.where(F.col(label).isNotNull() & F.col(doc_id).isNotNull() & (_fold(doc_id) != 1)).groupBy(F.col(doc_id).alias("labelled")).agg((F.max(label) == 1).cast("int").alias("toxic"))
    rows = docs.where(_fold(doc_id) != 1).select(F.col(doc_id).alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text")).join(known.hint("merge"), F.col("id") == F.col("labelled"))
    # Written once: the samples and counts below each read all of it.
    rows = materialise(rows.select("toxic", _fold("id").cast("int").alias("fold"), "text", F.xxhash64("text").alias("order")), "labelled")
    distinct = rows.groupBy("fold", "toxic", "order").agg(F.lit(1).alias("one"))
    totals = {(r["fold"], r["toxic"]): r["n"] for r in distinct.groupBy("fold", "toxic").agg(F.count("*").alias("n")).collect()}  # four rows

    def sample(fold: int, kind: int) -> DataFrame:
        part = F.broadcast(distinct.where((F.col("fold") == fold) & (F.col("toxic") == kind)).select("order").orderBy("order").limit(MAX_ROWS))  # MAX_ROWS longs
        return rows.where((F.col("fold") == fold) & (F.col("toxic") == kind)).join(part, "order", "left_semi").select("toxic", "text", "order").dropDuplicates(["order"])

    marks = _marks(sample(0, 1), rows.where("fold = 0 and toxic = 0").dropDuplicates(["order"]))
    ordinary = _dictionary(_samples(sample(0, 0), lambda coder, x: coder.windows(x)), ORDINARY_BYTES)
    toxic = _dictionary(_samples(sample(0, 1), lambda coder, x: _spans(coder.codes(x), marks)), TOXIC_BYTES) if len(marks) else b""
    model = ToxicityModel(ordinary, toxic)
    found = [(r["f"], r["toxic"]) for kind in (0, 1) for r in _featured(sample(2, kind), model).orderBy("f").collect()]  # MAX_ROWS rows each
    forget(rows)
    kinds = np.array([k for _, k in found], int)
    # Samples of the two labels may have been cut differently: weights restore their shares.
    weight = np.array([totals[2, k] / (kinds == k).sum() for k in kinds], float)
    return _calibrated(model, np.array([f for f, _ in found]).reshape(-1, FEATURES), kinds.astype(float), weight / weight.mean() if len(weight) else weight)


def score(docs: DataFrame, model: ToxicityModel, *, text: str = "text", name: str = "score") -> DataFrame:
    """`docs` with a column `name`, the probability that a text is toxic, from 0 to 1.

    Every window of the whole text counts. Null counts as empty; an empty text gets the score of a text without savings.
    Equal texts get equal scores. All columns are kept; one of that name is replaced. Without rows the result is empty.
    """
    rest = docs.select(*[c for c in docs.columns if c.lower() != name.lower()])
    schema = rest.withColumn(name, F.lit(0.0)).schema
    at = rest.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tools, coder = model.compressors(), Coder()
        for batch in batches:
            found = np.array([model.features(coder.windows(x.as_py()), tools) for x in batch.column(at)]).reshape(-1, FEATURES)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(model.probability(found), pa.float64())], [*batch.schema.names, name])

    return rest.mapInArrow(run, schema)


def toxicity_table(docs: DataFrame, labels: DataFrame, *, threshold: float = 0.7) -> DataFrame:
    """doc_id, held_out (not used to learn), score, predicted (1 from `threshold` on) of every document.

    A null id is not held out. Null and empty texts get the score of a text without savings; equal texts get equal scores,
    repeated rows a row each. Without documents there is no row, without labels every score is 0.5.
    """
    scored = score(docs.select("doc_id", "text"), train(docs, labels))
    return scored.select("doc_id", F.coalesce(_fold("doc_id") == 1, F.lit(False)).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def drop_toxic(docs: DataFrame, labels: DataFrame, *, threshold: float = 0.7) -> DataFrame:
    """The rows of `docs`, all columns, whose score is below `threshold`; edge cases as in `score` and `train`."""
    name = free_name(docs, "toxicity_score")
    return score(docs, train(docs, labels), name=name).where(F.col(name) < threshold).drop(name)
