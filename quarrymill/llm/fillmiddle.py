"""Fill-in-middle texts by overlapping-chunk decomposition.

A token is a run of ASCII letters or one other code point, so whether a token starts at a byte is a predicate of
that byte and the one before. A text falls into chunks of `CHUNK` bytes, each with the byte before it as overlap;
the starts of all chunks of many texts are counted in one vector operation, none waiting for another. Prefix sums of
the counts give a text's number of tokens and say which chunk owns each of the two cuts, and only those chunks are
scanned again for where the cut lies. Nothing is shuffled: a text is one value of one row, and is cut where it lies.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bytes of a chunk, and bytes whose chunks are counted together.
CHUNK = 1 << 16
BLOCK = 1 << 20
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
PLAIN_PERCENT, SPM_PERCENT = 10, 20
ROWS_AT_ONCE = 256


def _marks(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Whether a code point, and whether a token, starts at each byte; the first byte is overlap."""
    lead = (raw & 0xC0) != 0x80
    letter = ((raw | 32) - np.uint8(97)) < 26
    start = lead.copy()
    start[1:] &= ~(letter[1:] & letter[:-1])
    return lead, start


def _chunks(size: int, chunk: int) -> list[int]:
    """Where chunks begin; an empty text is one empty chunk."""
    return list(range(0, max(size, 1), chunk))


def _overlapped(data: bytes, at: int, chunk: int) -> bytes:
    return data[at - 1 : at + chunk] if at else b"\0" + data[:chunk]


def counts_of(texts: list[bytes], chunk: int = CHUNK) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each text the code points and the token starts in each of its chunks."""
    out: list[tuple[np.ndarray, np.ndarray]] = []
    held: list[bytes] = []
    done: list[np.ndarray] = []
    size = 0

    def together() -> None:
        nonlocal held, size
        begin = np.cumsum([0] + [len(x) for x in held[:-1]])
        lead, start = _marks(np.frombuffer(b"".join(held), np.uint8))
        lead[begin] = start[begin] = False
        done.append(np.stack([np.add.reduceat(m, begin, dtype=np.int64) for m in (lead, start)]))
        held, size = [], 0

    for data in texts:
        for at in _chunks(len(data), chunk):
            held.append(_overlapped(data, at, chunk))
            size += len(held[-1])
            if size > BLOCK:
                together()
    if held:
        together()
    both, at = np.concatenate(done, axis=1) if done else np.zeros((2, 0), np.int64), 0
    for data in texts:
        n = len(_chunks(len(data), chunk))
        out.append((both[0, at : at + n], both[1, at : at + n]))
        at += n
    return out


def cut_at(data: bytes, chars: np.ndarray, tokens: np.ndarray, rank: int, chunk: int = CHUNK) -> tuple[int, int]:
    """Bytes and code points before the token of this rank (from 0), or of the whole text if there are no more tokens."""
    upto = np.cumsum(tokens)
    owner = int(np.searchsorted(upto, rank, side="right"))
    if owner == len(tokens):
        return len(data), int(chars.sum())
    lead, start = _marks(np.frombuffer(_overlapped(data, owner * chunk, chunk), np.uint8))
    lead[0] = start[0] = False
    at = int(np.flatnonzero(start)[rank - (upto[owner] - tokens[owner])])
    return owner * chunk + at - 1, int(chars[:owner].sum() + np.count_nonzero(lead[:at]))


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, ROWS_AT_ONCE):
            part = batch.slice(at, ROWS_AT_ONCE)
            h1, h2 = part.column(3).to_pylist(), part.column(4).to_pylist()
            texts = [x.as_py().encode() for x in part.column(1)]
            pieces: list[list] = [[] for _ in range(3)]
            numbers: list[list[int]] = [[] for _ in range(3)]
            for data, (chars, tokens), a, b in zip(texts, counts_of(texts), h1, h2, strict=True):
                n = int(tokens.sum())
                (first, c1), (second, c2) = (cut_at(data, chars, tokens, r) for r in sorted((a % (n + 1), b % (n + 1))))
                for to, x in zip(pieces, (data[:first], data[first:second], data[second:]), strict=True):
                    to.append(x)
                for to, x in zip(numbers, (n, c1, c2 - c1), strict=True):
                    to.append(x)
            made = [pa.array(x, pa.binary()).cast(pa.string()) for x in pieces] + [pa.array(x, pa.int64()) for x in numbers]
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), *made], ["doc_id", "form", "prefix", "middle", "suffix", "n", "prefix_chars", "middle_chars"])


def fill_in_middle(docs: DataFrame, *, seed: int = 1, plain_percent: int = PLAIN_PERCENT, spm_percent: int = SPM_PERCENT, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n (tokens), form (plain, psm or spm), prefix, middle, suffix, prefix_chars, middle_chars (null if plain) and output.

    Cuts and form follow from the sha256 of `seed:doc_id` alone, so reruns agree, and rows with one id are cut at the
    ranks of the same numbers. A null or empty text is plain, with n 0 and empty output; so is a text that holds a mark. A null id counts as the
    word null. Very long texts take a few chunks of memory beside themselves. No documents, no rows; other columns are not read.
    """
    word = lambda k: F.conv(F.substring("_h", 8 * k - 7, 8), 16, 10).cast("long")
    t = F.coalesce(F.col(text), F.lit(""))
    known = docs.select(F.col(doc_id).alias("doc_id"), t.alias("_t"), F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(doc_id).cast("string"), F.lit("null"))), 256).alias("_h"))
    marked = F.col("_t").contains(PREFIX) | F.col("_t").contains(SUFFIX) | F.col("_t").contains(MIDDLE)
    plain = (F.col("_t") == "") | marked | (word(3) % 100 >= 100 - plain_percent)
    form = F.when(plain, "plain").when(word(4) % 100 < spm_percent, "spm").otherwise("psm")
    kind = known.schema["doc_id"].dataType.simpleString()
    cut = known.select("doc_id", "_t", form.alias("form"), word(1).alias("h1"), word(2).alias("h2")).mapInArrow(
        _cut, f"doc_id {kind}, form string, prefix string, middle string, suffix string, n long, prefix_chars long, middle_chars long"
    )
    p, m, s = F.col("prefix"), F.col("middle"), F.col("suffix")
    output = F.when(F.col("form") == "plain", F.concat(p, m, s)).when(F.col("form") == "psm", F.concat(F.lit(PREFIX), p, F.lit(SUFFIX), s, F.lit(MIDDLE), m)).otherwise(F.concat(F.lit(SUFFIX), s, F.lit(PREFIX), p, F.lit(MIDDLE), m))
    shown = lambda c: F.when(F.col("form") != "plain", F.col(c)).alias(c)
    return cut.select("doc_id", "n", "form", "prefix", "middle", "suffix", shown("prefix_chars"), shown("middle_chars"), output.alias("output"))


def restored(output: Column, form: Column) -> Column:
    """The text that `fill_in_middle` made an output of. Marks share no character with what they could overlap, so each is found where it was put."""
    parts = F.split(output, "<[PSM]>", -1)
    part = lambda i: F.get(parts, i)
    return F.when(form == "plain", output).when(form == "psm", F.concat(part(1), part(3), part(2))).otherwise(F.concat(part(2), part(3), part(1)))


ORACLE = """
    WITH d AS (SELECT doc_id, coalesce(text, '') AS t, sha256('1:' || doc_id) AS h FROM documents),
    k AS (SELECT doc_id, t, regexp_extract_all(t, '[A-Za-z]+|[^A-Za-z]') AS w, ('0x' || h[1:8])::BIGINT AS h1, ('0x' || h[9:16])::BIGINT AS h2,
                 ('0x' || h[17:24])::BIGINT AS h3, ('0x' || h[25:32])::BIGINT AS h4 FROM d),
    c AS (SELECT *, len(w) AS n, least(h1 % (len(w) + 1), h2 % (len(w) + 1)) AS a, greatest(h1 % (len(w) + 1), h2 % (len(w) + 1)) AS b FROM k),
    f AS (SELECT *, array_to_string(w[1:a], '') AS p, array_to_string(w[a + 1:b], '') AS m, array_to_string(w[b + 1:], '') AS s,
                 CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 90 THEN 'plain' WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM c)
    SELECT doc_id, n::BIGINT AS n, form, CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
           sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256, sha256(t) AS restored_sha256
    FROM f"""
