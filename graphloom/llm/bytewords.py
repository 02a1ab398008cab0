"""Words of many texts at once, over their UTF-8 bytes in numpy: spans, 64-bit hashes, word n-gram sets.

Work goes in pieces of whole texts of about PIECE bytes; memory is a small multiple of that, or of the longest text.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa

from graphloom.llm.common import LOWER, mixed, runs, utf8

PIECE = 1 << 19
BYTE_VALUE = np.random.default_rng(20240607).integers(1, 1 << 63, 256, dtype=np.uint64)
BASE = 0x9E3779B97F4A7C15 | 1
BASE_INVERSE = pow(BASE, -1, 1 << 64)

#: Spans of more bytes are hashed one by one.
SHORT = 32
LOW_BYTES = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)

#: Members of words: all but space and tab to carriage return; letters (ASCII letters and every byte of other scripts).
NOT_SPACE = np.ones(256, bool)
NOT_SPACE[[32, 9, 10, 11, 12, 13]] = False
LETTERS = np.zeros(256, bool)
LETTERS[65:91] = LETTERS[97:123] = LETTERS[128:] = True

_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE ** i and BASE ** -i modulo 2 ** 64 for i < n."""
    if len(_powers[0]) < n:
        for k, b in enumerate((BASE, BASE_INVERSE)):
            steps = np.full(max(n, 2 * PIECE), np.uint64(b))
            steps[0] = 1
            _powers[k] = np.cumprod(steps, dtype=np.uint64)
    return _powers[0][:n], _powers[1][:n]


def spans(data: np.ndarray, offsets: np.ndarray, member: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words, and for each text the number of words before it (n + 1 counts)."""
    inside = np.zeros(len(data) + 1, bool)
    inside[:-1] = member[data]
    first = inside[:-1].copy()
    first[1:] &= ~inside[:-2]
    edges = offsets[:-1][offsets[:-1] < offsets[1:]]
    first[edges] = inside[edges]  # a text's first byte begins a word, whatever ends the text before
    last = inside[1:].copy()
    last[edges[edges > 0] - 1] = False
    last = inside[:-1] & ~last
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each data[start:end], equal for equal bytes.

    Up to SHORT bytes go in steps of eight: each step is xored in and mixed by a bijection, so spans of one length up to eight bytes
    never meet. Longer ones are hashed by BLAKE2b. No structure of the text (repeats, mirrored or Morse-like words) makes hashes meet.
    """
    size = ends - starts
    if not len(starts):
        return np.zeros(0, np.uint64)
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    eight = np.ndarray((len(data) + 1,), "<u8", padded, strides=(1,))  # eight bytes from each place on
    h = size.astype(np.uint64) * np.uint64(0x94D049BB133111EB)
    longest = int(min(size.max(), SHORT))
    at, rest, use = starts, size, None
    for k in range(0, longest, 8):
        if k:
            use = np.flatnonzero((size > k) & (size <= SHORT))
            at, rest = starts[use] + k, size[use] - k
        word = eight[at] & LOW_BYTES[np.clip(rest, 0, 8)]
        if use is None:
            h = mixed(h ^ word)
        else:
            h[use] = mixed(h[use] * np.uint64(0xD6E8FEB86659FD93) ^ word)
    long_ = np.flatnonzero(size > SHORT)
    if len(long_):
        view = memoryview(np.ascontiguousarray(data))
        h[long_] = np.frombuffer(b"".join([blake2b(view[i:j], digest_size=8).digest() for i, j in zip(starts[long_].tolist(), ends[long_].tolist(), strict=True)]), "<u8")
    return h


def pieces(column: pa.Array, lower: bool = True) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Number of the first text, bytes and offsets of each piece."""
    data, offsets = utf8(column)
    for i, j in runs(offsets, PIECE):
        own = data[offsets[i] : offsets[j]]
        yield i, LOWER[own] if lower else own, offsets[i : j + 1] - offsets[i]


def distinct(x: np.ndarray) -> np.ndarray:
    """np.unique by sorting alone, which for numbers of this size takes a third of the time of its hash table."""
    x = np.sort(x)
    keep = np.ones(len(x), bool)
    np.not_equal(x[1:], x[:-1], out=keep[1:])
    return x[keep]


def shingle_sets(column: pa.Array, n: int = 5) -> Iterator[np.ndarray]:
    """For each text the ascending distinct hashes of its n-word shingles; a shorter text is one shingle, no words are none."""
    for _, data, offsets in pieces(column):
        starts, ends, at = spans(data, offsets, NOT_SPACE)
        h = span_hashes(data, starts, ends)
        grams = np.zeros(max(len(h) - n + 1, 0), np.uint64)
        for k in range(n):
            grams = grams * np.uint64(0xD6E8FEB86659FD93) + h[k : k + len(grams)]
        grams = mixed(grams)
        for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
            if b - a >= n:
                yield distinct(grams[a : b - n + 1])
            elif b > a:
                x = np.full(1, b - a, np.uint64)
                for k in range(a, b):
                    x = mixed(x * np.uint64(0xD6E8FEB86659FD93) + h[k : k + 1])
                yield x
            else:
                yield np.zeros(0, np.uint64)
