"""Word, shingle and line hashes of whole texts, for the operators that run Arrow batches.

Words are the maximal runs of bytes outside 0x20 and 0x09-0x0D, with A-Z lowered. Texts are
handled together up to about `BLOCK` bytes; a longer text is cut between words, so memory does
not follow a text's length except for its 8-byte hash a word. No hash that decides a result is a
polynomial: words are mixed eight bytes at a time (long ones by BLAKE2b), lines are BLAKE2b-128.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np

BLOCK = 1 << 19
_U = np.uint64


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser: a bijection of 64-bit values."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_GOLD = 0x9E3779B97F4A7C15
_BASE = _GOLD | 1
#: Words above so many bytes are hashed by BLAKE2b.
LONG_WORD = 64
_KEEP = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)


def word_hashes(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Start and hash of each word in data, A-Z lowered."""
    raw = _LOWER[np.frombuffer(data, np.uint8)]
    gap = np.concatenate([[True], _SPACE[raw], [True]])
    starts = np.flatnonzero(gap[:-1] & ~gap[1:])
    size = np.flatnonzero(~gap[:-1] & gap[1:]) - starts
    padded = np.concatenate([raw, np.zeros(8, np.uint8)])
    eights = np.ndarray(len(raw) + 1, "<u8", padded, strides=(1,))
    with np.errstate(over="ignore"):
        out = mix(size.astype(np.uint64) * _U(_GOLD) + _U(1))
        live = np.flatnonzero(size <= LONG_WORD)
        for at in range(0, LONG_WORD, 8):
            live = live[size[live] > at]
            if not len(live):
                break
            chunk = eights[starts[live] + at] & _KEEP[np.minimum(size[live] - at, 8)]
            out[live] = mix((out[live] ^ chunk) + _U(_GOLD))
    for i in np.flatnonzero(size > LONG_WORD):
        word = raw[starts[i] : starts[i] + size[i]].tobytes()
        out[i] = int.from_bytes(hashlib.blake2b(word, digest_size=8).digest(), "little")
    return starts, out


def _cuts(text: bytes) -> Iterator[bytes]:
    """A text in parts of about BLOCK bytes that end where a word ends."""
    at = 0
    while len(text) - at > BLOCK:
        cut = at + BLOCK
        while cut < len(text) and not _SPACE[text[cut]]:
            cut += 1
        yield text[at:cut]
        at = cut
    yield text[at:]


def words_of(texts: Iterable[str | None]) -> Iterator[np.ndarray]:
    """The word hashes of each text, in order; null is empty."""
    held: list[bytes] = []
    size = 0

    def together() -> Iterator[np.ndarray]:
        starts, hashes = word_hashes(b" ".join(held))
        begins = np.cumsum([0] + [len(t) + 1 for t in held])
        at = np.searchsorted(starts, begins)
        for a, b in zip(at[:-1], at[1:], strict=True):
            yield hashes[a:b]

    for text in texts:
        data = (text or "").encode()
        if len(data) > BLOCK:
            if held:
                yield from together()
                held, size = [], 0
            yield np.concatenate([word_hashes(part)[1] for part in _cuts(data)])
            continue
        held.append(data)
        size += len(data) + 1
        if size > BLOCK:
            yield from together()
            held, size = [], 0
    if held:
        yield from together()


def shingles(words: np.ndarray, width: int = 5) -> np.ndarray:
    """Sorted distinct hashes of runs of `width` words; of all words if there are fewer."""
    if not len(words):
        return words
    k = min(width, len(words))
    with np.errstate(over="ignore"):
        total = words[: len(words) - k + 1] + _U(k)
        for j in range(1, k):
            total = total * _U(_BASE) + words[j : len(words) - k + 1 + j]
    total = mix(total)
    total.sort()
    return total[np.concatenate([[True], total[1:] != total[:-1]])]


def names(parts: Iterable[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """BLAKE2b-128 of each byte string, as two longs."""
    both = np.frombuffer(b"".join([hashlib.blake2b(x, digest_size=16).digest() for x in parts]), np.int64).reshape(-1, 2)
    return both[:, 0], both[:, 1]


def _line_hashes(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Start, two halves of the hash and word count of each line of data; data of n line feeds has n + 1 lines."""
    raw = np.frombuffer(data, np.uint8)
    ends = np.concatenate([np.flatnonzero(raw == 10), [len(raw)]])
    starts = np.concatenate([[0], ends[:-1] + 1])
    gap = np.concatenate([[True], _SPACE[raw]])
    words = np.flatnonzero(gap[:-1] & ~gap[1:])
    return starts, *names(data.split(b"\n")), np.searchsorted(words, ends) - np.searchsorted(words, starts)


def lines_of(texts: Iterable[str | None]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """The two halves of the 128-bit hash and the word count of each line of each text; null is empty, which is one empty line."""
    held: list[bytes] = []
    size = 0

    def together() -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        starts, a, b, words = _line_hashes(b"\n".join(held))
        at = np.searchsorted(starts, np.cumsum([0] + [len(t) + 1 for t in held]))
        for i, j in zip(at[:-1], at[1:], strict=True):
            yield a[i:j], b[i:j], words[i:j]

    for text in texts:
        data = (text or "").encode()
        if len(data) > BLOCK:
            if held:
                yield from together()
                held, size = [], 0
            parts, at = [], 0
            while len(data) - at > BLOCK and (cut := data.find(b"\n", at + BLOCK)) >= 0:
                parts.append(_line_hashes(data[at:cut])[1:])
                at = cut + 1
            parts.append(_line_hashes(data[at:])[1:])
            yield tuple(np.concatenate(x) for x in zip(*parts, strict=True))
            continue
        held.append(data)
        size += len(data) + 1
        if size > BLOCK:
            yield from together()
            held, size = [], 0
    if held:
        yield from together()
