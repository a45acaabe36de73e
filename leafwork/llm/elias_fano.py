"""Elias-Fano coding of a non-decreasing sequence, with select by sampled positions."""

from __future__ import annotations

import struct

import numpy as np

SAMPLE = 256  # one bit position is kept for so many values
HEAD = struct.Struct("<QQBQQQ")  # values, universe, low bits, bytes of low part, high part, samples


BLOCK = 1 << 16  # values worked on at once: a multiple of SAMPLE, and so of the eight bits of a byte


def encode(values: np.ndarray) -> bytes:
    """values: non-decreasing, not negative. Each costs about 2 + log2(universe / values) bits; beside them a block at a time is held."""
    n, top = len(values), int(values[-1]) + 1 if len(values) else 1
    low = max(0, (top // max(n, 1)).bit_length() - 1)
    size = (((top - 1) >> low) + n + 7 if n else 7) >> 3
    high, lows, samples = np.zeros(size, np.uint8), [], []
    for at in range(0, n, BLOCK):
        some = np.asarray(values[at : at + BLOCK]).astype(np.uint64)
        if low:
            bits = ((some[:, None] >> np.arange(low, dtype=np.uint64)) & np.uint64(1)).astype(np.uint8)
            lows.append(np.packbits(bits.ravel(), bitorder="little").tobytes())
        ones = (some >> np.uint64(low)).astype(np.int64) + np.arange(at, at + len(some))
        for part in np.split(ones, np.flatnonzero(np.diff(ones) > 8 * BLOCK) + 1):  # far apart: on their own
            first, last = int(part[0]) >> 3, int(part[-1]) >> 3
            field = np.zeros(8 * (last - first + 1), np.uint8)
            field[part - 8 * first] = 1
            high[first : last + 1] |= np.packbits(field, bitorder="little")
        samples.append(ones[::SAMPLE])
    wide = 8 * size >= 1 << 32
    marks = b"".join(x.astype(np.uint64 if wide else np.uint32).tobytes() for x in samples)
    packed = b"".join(lows)
    return HEAD.pack(n, top, low, len(packed), size, len(marks)) + packed + high.tobytes() + marks


class EliasFano:
    """Reads what encode() wrote."""

    def __init__(self, data: bytes, at: int = 0) -> None:
        self.n, self.top, self.low, a, b, c = HEAD.unpack_from(data, at)
        at += HEAD.size
        self.lows = np.frombuffer(data, np.uint8, a, at)
        self.high = np.frombuffer(data, np.uint8, b, at + a)
        self.samples = np.frombuffer(data, np.uint64 if 8 * b >= 1 << 32 else np.uint32, c // (8 if 8 * b >= 1 << 32 else 4), at + a + b)
        self.end = at + a + b + c

    def select(self, i: int, count: int = 1) -> np.ndarray:
        """Values i .. i + count - 1, from the nearest sample on; nothing else is decoded."""
        if not 0 <= i <= i + count <= self.n:
            raise IndexError(i)
        if not count:
            return np.zeros(0, np.uint64)
        s = i // SAMPLE
        begin = int(self.samples[s])
        last = (i + count - 1) // SAMPLE + 1
        stop = int(self.samples[last]) if last < len(self.samples) else 8 * len(self.high)
        bits = np.unpackbits(self.high[begin // 8 : -(-stop // 8)], bitorder="little")
        bits[: begin % 8] = 0
        ones = np.flatnonzero(bits)[i - s * SAMPLE :][:count] + begin // 8 * 8
        out = (ones - np.arange(i, i + count)).astype(np.uint64) << np.uint64(self.low)
        if self.low:
            first = i * self.low
            part = np.unpackbits(self.lows[first // 8 : -(-(i + count) * self.low // 8)], bitorder="little")[first % 8 :][: count * self.low]
            out |= part.reshape(count, self.low).astype(np.uint64) @ (np.uint64(1) << np.arange(self.low, dtype=np.uint64))
        return out
