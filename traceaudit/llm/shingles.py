"""Hashed word shingles of many texts at once, on the bytes of an Arrow column."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

WORDS = 5
# Bytes of text that are hashed at a time.
CHUNK = 1 << 20

# Random odd multipliers and a random number for each byte, drawn from fixed seeds.
_DRAW = np.random.default_rng(20240229)
_BYTE = _DRAW.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_PLACE = _DRAW.integers(1, 2**63, WORDS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_STEP = np.uint64(0x9E3779B97F4A7C15)
_STEP_BACK = np.uint64(pow(0x9E3779B97F4A7C15, -1, 2**64))

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BLANK = np.zeros(256, dtype=bool)
_BLANK[[9, 10, 11, 12, 13, 32]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit numbers (a bijection)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(n: int, base: np.uint64) -> np.ndarray:
    out = np.full(n, base, dtype=np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


_AHEAD, _BEHIND = _powers(CHUNK, _STEP), _powers(CHUNK, _STEP_BACK)


def _tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers for ``n`` bytes; those for a single long text are not kept."""
    return (_AHEAD, _BEHIND) if n <= CHUNK else (_powers(n, _STEP), _powers(n, _STEP_BACK))


# Bytes that are no part of words of digits, a-z and everything beyond ASCII.
PLAIN = np.ones(256, dtype=bool)
PLAIN[48:58] = PLAIN[97:123] = PLAIN[128:] = False


class Bytes:
    """Hashes of any runs of some bytes, A-Z lower-cased: equal runs have equal hashes wherever they stand."""

    def __init__(self, data: np.ndarray) -> None:
        self.data = _LOWER[data]
        ahead, self.behind = _tables(len(data))
        self.sums = np.cumsum(_BYTE[self.data] * ahead[:len(data)], dtype=np.uint64)

    def hashes(self, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        """Hash of the bytes from each ``start`` to each ``stop``, both included."""
        before = np.where(start > 0, self.sums[start - 1], np.uint64(0))
        return mix((self.sums[stop] - before) * self.behind[start] + (stop - start + 1).astype(np.uint64))


def word_edges(data: np.ndarray, ends: np.ndarray, blank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of the first and the last byte of each word; texts end at ``ends``."""
    inside = ~blank[data]
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    first = np.concatenate(([0], ends[:-1]))
    first = first[first < len(data)]
    begins[first] = inside[first]
    stops = inside.copy()
    stops[:-1] &= ~inside[1:]
    last = ends[ends > 0] - 1
    stops[last] = inside[last]
    return np.flatnonzero(begins), np.flatnonzero(stops)


def word_places(data: np.ndarray, ends: np.ndarray, blank: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash of each word of the bytes, and the places of its first and last byte; texts end at ``ends``."""
    known = Bytes(data)
    start, stop = word_edges(known.data, ends, blank)
    return known.hashes(start, stop), start, stop


def pieces(texts: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first text, text after the last, bytes, ends of the texts in them) of about ``CHUNK`` bytes at a time; null is empty."""
    if len(texts) == 0:
        return
    texts = texts.cast(pa.large_binary())
    if texts.null_count:
        texts = pc.fill_null(texts, b"")
    _, offsets, values = texts.buffers()
    offsets = np.frombuffer(offsets, dtype=np.int64)[texts.offset:texts.offset + len(texts) + 1]
    values = np.frombuffer(values, dtype=np.uint8) if values is not None else np.zeros(0, dtype=np.uint8)
    at = 0
    while at < len(texts):
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + CHUNK, side="right")) - 1)
        lo, hi = offsets[at], offsets[to]
        yield at, to, values[lo:hi], offsets[at + 1:to + 1] - lo
        at = to


def word_hashes(texts: pa.Array, blank: np.ndarray = _BLANK) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(hash of each word, number of its last two bytes, first word of each text and the end) of some texts at a time; ``blank`` marks the bytes between words."""
    for at, to, data, ends in pieces(texts):
        if len(data):
            words, start, stop = word_places(data, ends, blank)
            low = _LOWER[data].astype(np.int64)
            ending = low[stop] * 31 + low[np.maximum(stop - 1, start)] * 7
            yield words, ending, np.concatenate(([0], np.searchsorted(start, ends)))
        else:
            yield np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64), np.zeros(to - at + 1, dtype=np.int64)


def shingle_sets(texts: pa.Array) -> Iterator[np.ndarray]:
    """The distinct shingle hashes of each text, in ascending order; none for null or a text without words.

    Words are cut at white space, A-Z lower-cased. A text of fewer than five
    words has one shingle of all of them.
    """
    for words, _, cut in word_hashes(texts):
        total = len(words) - WORDS + 1
        every = np.zeros(max(total, 0), dtype=np.uint64)
        for k in range(WORDS):
            if total > 0:
                every += words[k:k + total] * _PLACE[k]
        every = mix(every)
        for a, b in zip(cut[:-1], cut[1:], strict=True):
            if b - a >= WORDS:
                yield np.unique(every[a:b - WORDS + 1])
            elif b > a:
                yield mix(np.array([(words[a:b] * _PLACE[:b - a]).sum(dtype=np.uint64) + np.uint64(b - a)], dtype=np.uint64))
            else:
                yield np.zeros(0, dtype=np.uint64)
