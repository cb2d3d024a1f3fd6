"""Words of many texts at once, over their UTF-8 bytes, with NumPy inside a task."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np

BASE = 0x9E3779B97F4A7C15  # odd, so that it has an inverse modulo 2^64
CHUNK = 1 << 18
LONG_SPAN = 4096

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def byte_class(*ranges: tuple[int, int]) -> np.ndarray:
    """A table that marks the bytes in these inclusive ranges."""
    marks = np.zeros(256, bool)
    for first, last in ranges:
        marks[first : last + 1] = True
    return marks


def spans(raw: np.ndarray, offsets: np.ndarray, is_word: np.ndarray):
    """Where words begin and end, and the number of the first word of each text."""
    inside = is_word[raw]
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    begins = offsets[:-1][offsets[:-1] < offsets[1:]]
    first[begins] = inside[begins]
    ends = offsets[1:][offsets[:-1] < offsets[1:]] - 1
    last[ends] = inside[ends]
    starts = np.flatnonzero(first)
    return starts, np.flatnonzero(last) + 1, np.searchsorted(starts, offsets)


def _powers(base: int) -> np.ndarray:
    powers = np.full(CHUNK + LONG_SPAN + 1, base, np.uint64)
    powers[0] = 1
    return np.cumprod(powers)


_UP, _DOWN = _powers(BASE), _powers(pow(BASE, -1, 1 << 64))


def mix(values: np.ndarray) -> np.ndarray:
    """Spreads 64-bit values over the whole range, one to one."""
    values = values ^ (values >> np.uint64(30))
    values = values * np.uint64(0xBF58476D1CE4E5B9)
    values ^= values >> np.uint64(27)
    values *= np.uint64(0x94D049BB133111EB)
    return values ^ (values >> np.uint64(31))


def span_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the bytes of each span; spans ascend and do not overlap.

    A polynomial modulo 2^64 from running sums, in chunks that fit the cache. Longer spans than
    LONG_SPAN take a digest instead, on every side of a comparison.
    """
    out = np.empty(len(starts), np.uint64)
    i = 0
    while i < len(starts):
        base = starts[i]
        j = max(i + 1, int(np.searchsorted(starts, base + CHUNK)))
        s, e = starts[i:j] - base, ends[i:j] - base
        long = np.flatnonzero(e - s > LONG_SPAN)
        reach = min(int(e[-1]), CHUNK + LONG_SPAN)
        sums = np.zeros(reach + 1, np.uint64)
        chunk = raw[base : base + reach].astype(np.uint64) + np.uint64(1)
        np.cumsum(chunk * _UP[:reach], out=sums[1:])
        out[i:j] = (sums[np.minimum(e, reach)] - sums[s]) * _DOWN[s]
        for k in long:
            digest = hashlib.blake2b(raw[base + s[k] : base + e[k]].tobytes(), digest_size=8)
            out[i + k] = int.from_bytes(digest.digest(), "little")
        i = j
    return mix(out)


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The positions of all ranges, one after the other."""
    total = int(lengths.sum())
    ahead = np.cumsum(lengths) - lengths
    return np.repeat(starts - ahead, lengths) + np.arange(total)


def pieces(raw: np.ndarray, is_word: np.ndarray, size: int) -> Iterator[tuple[int, int]]:
    """Cuts bytes into pieces of about `size` that divide no word, so that long texts need little memory."""
    a = 0
    while a < len(raw):
        b = min(a + size, len(raw))
        while b < len(raw) and is_word[raw[b]]:
            gap = np.flatnonzero(~is_word[raw[b : b + size]])
            b = b + int(gap[0]) if len(gap) else min(b + size, len(raw))
        yield a, b
        a = b


def spans_of_pieces(raw: np.ndarray, offsets: np.ndarray, is_word: np.ndarray, size: int):
    """Of each piece that has words: its lower-cased bytes, where words begin and end in it, their texts."""
    edges = np.unique(offsets)
    for a, b in pieces(raw, is_word, size):
        piece = LOWER[raw[a:b]]
        inside = edges[(edges > a) & (edges < b)] - a
        starts, ends, _ = spans(piece, np.concatenate([[0], inside, [b - a]]), is_word)
        if len(starts):
            yield piece, starts, ends, np.searchsorted(offsets, starts + a, "right") - 1
