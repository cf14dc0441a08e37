"""Quality rules by tokeniser fertility.

Two public vocabularies measure every whole text: a byte-level BPE gives characters per token, tokens per word and the
entropy of the tokens, a BPE with byte fallback the share of its pieces that are fallback bytes. What is usual is learnt from all
documents that pass the base rules, for each language apart: the quartiles of a measure give a band, and a text outside one of
its language's bands is rejected. Entropy grows with length, so it is held against the median of texts of
its language of about the same number of tokens. Texts without a language form a language of their own.

Measures are whole thousandths, so the quartiles come exact from counts of values: each task counts before anything
is shuffled, and a language that most documents have is a few thousand counts. Texts are read once and never shuffled.
"""

from __future__ import annotations

import base64
import functools
import os
from array import array
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarrymill.llm.common import forget, materialise

#: Base rules: least words, and the share of words in repeated windows, in percent, that is too much.
LEAST_WORDS, REPEAT_PERCENT, WINDOW = 50, 50, 3
SYMBOLS = b"#*$%&|<>"
#: How many interquartile ranges below and above the quartiles a band reaches; None: no limit. Set by looking at check_s and its labels.
BANDS: dict[str, tuple[float | None, float | None]] = {"chars_per_token": (4.0, 4.0), "tokens_per_word": (4.0, 4.0), "fallback_share": (None, 3.0), "entropy_excess": (2.5, 6.0)}
#: Least interquartile range, in thousandths: of characters, tokens, shares and bits.
LEAST_SPREAD = {"chars_per_token": 20, "tokens_per_word": 30, "fallback_share": 10, "entropy_excess": 60}
#: Words whose tokens a Python worker keeps in each of two tables; only speed depends on it. A slice of rows may exceed it by its own words.
CACHE_WORDS = 200_000
#: Longer words are tokenised in parts of so many characters, all of them.
LONG_WORD = 256
ROWS_AT_ONCE = 256
_BLANKS = " \t\n\v\f\r"
_NUMBERS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_tokens", "n_pieces", "n_fallback", "entropy"]


class Vocabularies:
    """Tokens of words under a byte-level BPE (a file of ranks) and a sentencepiece model with byte fallback."""

    def __init__(self, ranks_path: str, piece_path: str):
        import public_tokenizers
        import sentencepiece
        import tiktoken

        with open(ranks_path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f)}
        self._tokens = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})._core_bpe.encode_ordinary
        self._pieces = sentencepiece.SentencePieceProcessor(model_file=piece_path)
        self._fallback = frozenset(i for i in range(self._pieces.get_piece_size()) if self._pieces.is_byte(i))
        self._known: dict[str, tuple[bytes, int, int]] = {}
        self._older: dict[str, tuple[bytes, int, int]] = {}

    def _learn(self, words: Iterable[str]) -> None:
        """Tokenise words that are not known. Of two tables the older goes when the newer is full, so common words stay."""
        new = []
        for w in words:
            if (old := self._older.get(w)) is not None:
                self._known[w] = old
            elif w not in self._known:
                new.append(w)
        parts = [[w[at : at + LONG_WORD] for at in range(0, len(w), LONG_WORD)] for w in new]
        pieces = iter(self._pieces.encode([p for ps in parts for p in ps], num_threads=1))
        for w, ps in zip(new, parts, strict=True):
            tokens, found = array("i", self._tokens(" " + ps[0])), next(pieces)
            for p in ps[1:]:
                tokens.extend(self._tokens(p))
                found = found + next(pieces)
            self._known[w] = (tokens.tobytes(), len(found), sum(map(self._fallback.__contains__, found)))

    def measure(self, texts: list[list[str]]) -> list[tuple[int, int, int, int]]:
        """Tokens, pieces, fallback pieces, and the entropy of the tokens in millibits, of each text's words."""
        if len(self._known) >= CACHE_WORDS:
            self._known, self._older = {}, self._known
        known = self._known
        self._learn({w for words in texts for w in words if w not in known})
        out = []
        for words in texts:
            found = [known[w] for w in words]
            ids = np.frombuffer(b"".join([f[0] for f in found]), np.int32)
            share = np.unique(ids, return_counts=True)[1] / max(1, len(ids))
            out.append((len(ids), sum([f[1] for f in found]), sum([f[2] for f in found]), int(round(-1000 * float((share * np.log2(share)).sum())))))
        return out


@functools.lru_cache(maxsize=1)
def _vocabularies(ranks_path: str, piece_path: str) -> Vocabularies:
    """One for each Python worker: the next task finds the words known."""
    return Vocabularies(ranks_path, piece_path)


def repeated_words(words: list[str]) -> int:
    """Words in windows of three that the text has twice or more."""
    if len(words) <= WINDOW:
        return 0
    seen: dict[str, int] = {}
    ids = np.array([seen.setdefault(w, len(seen)) for w in words], np.int64)
    keys = ids[: len(ids) - WINDOW + 1]
    for j in range(1, WINDOW):  # a window's number so far, made dense: it stays below the number of words
        if j > 1:
            keys = np.unique(keys, return_inverse=True)[1]
        keys = keys * len(seen) + ids[j : len(ids) - WINDOW + 1 + j]
    _, inverse, counts = np.unique(keys, return_inverse=True, return_counts=True)
    twice = counts[inverse] > 1
    cover = np.zeros(len(words), bool)
    for j in range(WINDOW):
        cover[j : len(words) - WINDOW + 1 + j] |= twice
    return int(np.count_nonzero(cover))


def repeated_lines(text: str) -> int:
    """Lines with a word that equal an earlier line."""
    lines = [x for x in text.split("\n") if x.strip(_BLANKS)]
    return len(lines) - len(set(lines))


def measures(docs: DataFrame, ranks_path: str, piece_path: str, *, doc_id: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """doc_id, lang and the counts of each whole text; a null text has no words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabularies = _vocabularies(ranks_path, piece_path)
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS_AT_ONCE):
                part, rows, texts = batch.slice(at, ROWS_AT_ONCE), [], []
                for value in part.column(2):
                    t = value.as_py() or ""
                    data = t.encode()
                    texts.append([w.decode() for w in data.split()])  # bytes part at exactly the six separators
                    chars = len(t) - sum(t.count(c) for c in _BLANKS)
                    rows.append([len(texts[-1]), chars, len(data) - len(data.translate(None, SYMBOLS)), repeated_lines(t), repeated_words(texts[-1])])
                for row, more in zip(rows, vocabularies.measure(texts), strict=True):
                    row += more
                numbers = np.array(rows, np.int64).reshape(-1, len(_NUMBERS)).T
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), *map(pa.array, numbers)], ["doc_id", "lang", *_NUMBERS])

    kind = docs.schema[doc_id].dataType.simpleString()
    plain = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(lang).cast("string"), F.lit("")).alias("lang"), F.col(text).alias("text"))
    return plain.mapInArrow(run, f"doc_id {kind}, lang string, " + ", ".join(f"{c} long" for c in _NUMBERS))


def quantiles(values: DataFrame, keys: list[str], value: str, at: dict[str, float]) -> DataFrame:
    """For each key the least value up to which a share of its rows lies, for each named share: exact, from counts of values."""
    counts = values.groupBy(*keys, value).agg(F.count("*").alias("_n"))
    upto = Window.partitionBy(*keys).orderBy(value)
    sums = counts.withColumns({"_upto": F.sum("_n").over(upto), "_all": F.sum("_n").over(Window.partitionBy(*keys))})
    return sums.groupBy(*keys).agg(*[F.min(F.when(F.col("_upto") >= share * F.col("_all"), F.col(value))).alias(name) for name, share in at.items()])


def _per_thousand(a: str, b: str) -> Column:
    return F.expr(f"if({b} > 0, 1000 * {a} div {b}, 0)")


def quality_table(docs: DataFrame, ranks_path: str, piece_path: str, *, doc_id: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """Per row: doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept; then the measures, in
    thousandths (null where the base rules fail), and `rejected_by`, the first measure that is out of its band (null: none).

    Null and empty texts fail the base rules for want of words. Null ids stay, repeated rows count each for itself. Where no
    document passes the base rules there are no bands and none is needed. No documents, no rows; other columns are not read.
    A band needs no least number of documents: of few alike ones it is at least `LEAST_SPREAD` wide.
    """
    found = measures(docs, ranks_path, piece_path, doc_id=doc_id, text=text, lang=lang)
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > REPEAT_PERCENT * F.col("n_words"))
    shares = {"chars_per_token": _per_thousand("word_chars", "n_tokens"), "tokens_per_word": _per_thousand("n_tokens", "n_words"), "fallback_share": _per_thousand("n_fallback", "n_pieces")}
    size = F.floor(4 * F.log2(F.greatest("n_tokens", F.lit(1)))).cast("int")  # quarter octaves
    found = materialise(found.withColumns({"base_failed": failed, "size_class": size, **shares}), "measures")
    usual = materialise(quantiles(found.where("not base_failed"), ["lang", "size_class"], "entropy", {"usual": 0.5}), "usual")  # its size on disk decides how it is joined
    held = materialise(found.join(usual, ["lang", "size_class"], "left").withColumn("entropy_excess", F.col("entropy") - F.col("usual")).drop("usual", "size_class"), "excess")
    forget(found, usual)
    passed, bands = held.where("not base_failed"), None
    for name, (down, up) in BANDS.items():
        spread = F.greatest(F.col("_q3") - F.col("_q1"), F.lit(LEAST_SPREAD[name]))
        edge = lambda q, k, spread=spread: F.lit(None).cast("double") if k is None else F.col(q) + k * spread
        one = quantiles(passed, ["lang"], name, {"_q1": 0.25, "_q3": 0.75}).select("lang", edge("_q1", None if down is None else -down).alias(f"{name}_low"), edge("_q3", up).alias(f"{name}_high"))
        bands = one if bands is None else bands.join(one, "lang")
    bands = materialise(bands, "bands")  # a row for each language
    outside = [F.when((F.col(n) < F.col(f"{n}_low")) | (F.col(n) > F.col(f"{n}_high")), n) for n in BANDS]
    judged = held.join(bands, "lang", "left").withColumn("rejected_by", F.when(~F.col("base_failed"), F.coalesce(*outside)))
    shown = [F.when(~F.col("base_failed"), F.col(n)).alias(n) for n in BANDS]
    return judged.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        (~F.col("base_failed") & F.col("rejected_by").isNull()).alias("kept"), *shown, "rejected_by",
    )


def vocabulary_paths(root: str | None = None) -> tuple[str, str]:
    """The two files in a folder of public vocabularies: by default QUARRYMILL_TOKENIZERS, else the installed package."""
    names = ("byte_bpe_50k.tiktoken", "piece_bpe_32k.model")
    if root := root or os.environ.get("QUARRYMILL_TOKENIZERS"):
        return tuple(f"{root}/{n}" for n in names)
    import public_tokenizers

    return tuple(str(public_tokenizers.path(n)) for n in names)
