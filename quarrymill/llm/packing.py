"""Packing by power-of-two decomposition.

Each document becomes token ids, then pieces whose lengths are powers of two: as many of
`max_len` as fit, then the binary digits of the rest in falling order. Every piece is a sequence
of its own, so no sequence crosses documents and none needs padding; batches are made from one
`bucket` (the logarithm of the length) at a time. The work is one pass without a shuffle.
"""

from __future__ import annotations

import json
import unicodedata
from collections.abc import Iterator
from struct import pack

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Ids of words seen, per Python worker. A full table is emptied, so only speed depends on it.
CACHE_WORDS = 400_000
ROWS_AT_ONCE = 128


def _byte_of_symbol() -> dict[str, int]:
    """The printable stand-ins that byte-level vocabularies use for the 256 bytes."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(printable)]
    return {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(rest)}


class WordBpe:
    """The ids that the `tokenizers` library gives for a lower-casing BPE with word ends, faster.

    White space parts a text into chunks that no token crosses. The ids of a chunk are remembered.
    A new chunk is merged by tiktoken, with byte 0xFF (never in UTF-8) for the word end: ids in
    such a vocabulary follow the order of merges, which is all that tiktoken needs. Chunks with
    letters beyond U+036F, special tokens or control characters go to `tokenizers` itself.
    """

    def __init__(self, path: str):
        import regex
        import tiktoken
        from tokenizers import Tokenizer

        self.exact = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        end, byte_of = spec["model"]["end_of_word_suffix"], _byte_of_symbol()
        self.special = [t["content"] for t in spec["added_tokens"]]
        ranks = {}
        for token, i in spec["model"]["vocab"].items():
            if token not in self.special:
                last = token.endswith(end)
                ranks[bytes(byte_of[c] for c in (token[: -len(end)] if last else token)) + b"\xff" * last] = i
        self._merge = tiktoken.Encoding("word_bpe", pat_str=r"[\s\S]+", mergeable_ranks=ranks, special_tokens={})._core_bpe.encode_single_piece
        split = next(p for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self._parts = regex.compile(split["pattern"]["Regex"]).findall
        self._odd = regex.compile("|".join([r"[Ͱ-\U0010FFFF]", *map(regex.escape, self.special)])).search
        self._known: dict[str, bytes] = {}

    def _new(self, chunk: str) -> bytes:
        if self._odd(chunk):
            ids = self.exact.encode(chunk, add_special_tokens=False).ids
        else:
            plain = (chunk if chunk.isascii() else unicodedata.normalize("NFC", chunk)).lower()
            if plain.isascii() and plain.isalpha():
                ids = self._merge(plain.encode() + b"\xff")
            else:
                ids = [i for part in self._parts(plain) for i in self._merge(part.encode() + b"\xff")]
        if len(self._known) >= CACHE_WORDS:
            self._known.clear()
        out = pack(f"<{len(ids)}I", *ids)
        if len(chunk) <= 64:
            self._known[chunk] = out
        return out

    def encode(self, text: str) -> bytes:
        """Little-endian unsigned 32-bit ids of a text."""
        if any(c in text for c in "\x1c\x1d\x1e\x1f"):  # white space for str.split() only
            ids = self.exact.encode(text, add_special_tokens=False).ids
            return pack(f"<{len(ids)}I", *ids)
        known, new = self._known.get, self._new
        return b"".join([known(c) or new(c) for c in text.split()])


def piece_lengths(n: int, max_len: int) -> list[int]:
    """n as a sum of powers of two, none above max_len, largest first."""
    rest = n % max_len
    return [max_len] * (n // max_len) + [1 << b for b in range(max_len.bit_length() - 1, -1, -1) if rest >> b & 1]


def pack_documents(docs: DataFrame, vocabulary: str, *, max_len: int = 2048, end_id: int = 1, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Sequences of `docs`: one row for each piece.

    Columns: doc_id, start (ids of the document before it), length, ids (little-endian unsigned
    32-bit), doc_tokens (with the closing `end_id`), bucket (log2 of length), sequence_id, offset
    (always 0: a sequence is one piece).

    A null or empty text is a document of `end_id` alone. Null ids stay null. Repeated rows are
    packed each for itself. Very long texts give more pieces. No documents, no rows. Other columns
    are not read. `max_len` must be a power of two. sequence_id is unique, and the same on every
    run over the same files.
    """
    if max_len < 1 or max_len & (max_len - 1):
        raise ValueError("max_len must be a power of two")
    kind = docs.schema[doc_id].dataType
    schema = f"doc_id {kind.simpleString()}, start long, length long, ids binary, doc_tokens long"
    close = pack("<I", end_id)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = WordBpe(vocabulary).encode
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS_AT_ONCE):
                part = batch.slice(at, ROWS_AT_ONCE)
                rows, start, length, ids, total = [], [], [], [], []
                for i, value in enumerate(part.column(1)):
                    data = encode(value.as_py() or "") + close
                    n, done = len(data) // 4, 0
                    for size in piece_lengths(n, max_len):
                        rows.append(i)
                        start.append(done)
                        length.append(size)
                        ids.append(data[4 * done : 4 * (done + size)])
                        total.append(n)
                        done += size
                longs = [pa.array(x, pa.int64()) for x in (start, length, total)]
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(rows, pa.int64())), longs[0], longs[1], pa.array(ids, pa.binary()), longs[2]], ["doc_id", "start", "length", "ids", "doc_tokens"])

    pieces = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, schema)
    return pieces.withColumns({"bucket": F.log2("length").cast("int"), "sequence_id": F.monotonically_increasing_id(), "offset": F.lit(0).cast("long")})


def write_buckets(pieces: DataFrame, path: str) -> None:
    """Sequences under path, in a folder for each length, ready to be batched without padding."""
    pieces.write.partitionBy("bucket").parquet(path)
