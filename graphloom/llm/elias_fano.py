"""Elias-Fano coding of non-decreasing integers: near-minimal space, select without decoding the rest."""

from __future__ import annotations

import struct

import numpy as np

HEAD = struct.Struct("<QQB")
#: A cumulative count of ones is kept for each block of so many bytes of the upper bits.
BLOCK = 64
ONES = np.array([bin(x).count("1") for x in range(256)], np.uint8)


def encode(values: np.ndarray) -> bytes:
    """Values: non-decreasing, 0 or more. About 2 + log2(largest / n) bits each."""
    v = np.asarray(values, np.uint64)
    n, top = len(v), int(v[-1]) if len(v) else 0
    low = max(0, (max(top, 1) // max(n, 1)).bit_length() - 1)
    upper = (v >> np.uint64(low)).astype(np.int64) + np.arange(n)
    bits = np.zeros((int(upper[-1]) + 1 if n else 0), np.uint8)
    bits[upper] = 1
    high = np.packbits(bits, bitorder="little")
    high = np.concatenate([high, np.zeros(-len(high) % BLOCK, np.uint8)])
    lows = np.packbits(((v[:, None] >> np.arange(low, dtype=np.uint64)) & np.uint64(1)).astype(np.uint8).ravel(), bitorder="little")
    ranks = np.cumsum(ONES[high].reshape(-1, BLOCK).sum(axis=1, dtype=np.uint32), dtype=np.uint32)
    return HEAD.pack(n, top, low) + struct.pack("<III", len(high), len(lows), len(ranks)) + high.tobytes() + lows.tobytes() + ranks.tobytes()


class EliasFano:
    """Reads what encode() wrote, from a buffer at `at`."""

    def __init__(self, buffer: bytes | memoryview, at: int = 0):
        self.n, self.top, self.low = HEAD.unpack_from(buffer, at)
        high, lows, ranks = struct.unpack_from("<III", buffer, at + HEAD.size)
        at += HEAD.size + 12
        self.high = np.frombuffer(buffer, np.uint8, high, at)
        self.lows = np.frombuffer(buffer, np.uint8, lows, at + high)
        self.ranks = np.frombuffer(buffer, np.uint32, ranks, at + high + lows)
        self.end = at + high + lows + 4 * ranks

    def select(self, i: int) -> int:
        """The i-th value: a search in the counts, one block of upper bits, `low` lower bits."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        block = int(np.searchsorted(self.ranks, i, "right"))
        before = int(self.ranks[block - 1]) if block else 0
        ones = np.flatnonzero(np.unpackbits(self.high[block * BLOCK : (block + 1) * BLOCK], bitorder="little"))
        upper = block * BLOCK * 8 + int(ones[i - before]) - i
        at = i * self.low
        piece = int.from_bytes(self.lows[at // 8 : (at + self.low + 7) // 8].tobytes(), "little") >> (at % 8)
        return (upper << self.low) | (piece & ((1 << self.low) - 1))

    def all(self) -> np.ndarray:
        upper = np.flatnonzero(np.unpackbits(self.high, bitorder="little")) - np.arange(self.n)
        bits = np.unpackbits(self.lows, count=self.n * self.low, bitorder="little").reshape(self.n, self.low).astype(np.uint64)
        return (upper.astype(np.uint64) << np.uint64(self.low)) | (bits << np.arange(self.low, dtype=np.uint64)).sum(axis=1, dtype=np.uint64)
