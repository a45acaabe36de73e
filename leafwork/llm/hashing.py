"""Vectorised word finding and rolling hashes over byte buffers."""

from __future__ import annotations

import numpy as np

_U = np.uint64
BASE = 0x9E3779B97F4A7C15  # odd, so that its powers have inverses modulo 2**64
SPACE = np.zeros(256, bool)
SPACE[[0x20, 9, 10, 11, 12, 13]] = True
BYTE_CODE = np.random.Generator(np.random.PCG64(20240501)).integers(1, 2**63, 256, dtype=np.uint64) * _U(2) + _U(1)
_powers: dict[int, np.ndarray] = {}


def powers(n: int, base: int = BASE) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64; kept and grown by doubling."""
    got = _powers.get(base)
    if got is None:
        got = np.ones(1, _U)
    while len(got) < n:
        got = np.concatenate([got, got * _U(pow(base, len(got), 2**64))])
    _powers[base] = got if len(got) <= 1 << 22 else got[: 1 << 22]
    return got[:n]


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> _U(27))) * _U(0x94D049BB133111EB)
    return h ^ (h >> _U(31))


def rolling(codes: np.ndarray, n: int, mixed: bool = True) -> np.ndarray:
    """A hash of each n consecutive codes, by prefix sums of code * BASE**position."""
    if len(codes) < n:
        return np.zeros(0, _U)
    total = np.concatenate(([_U(0)], np.cumsum(codes * powers(len(codes)))))
    got = (total[n:] - total[:-n]) * powers(len(codes), pow(BASE, -1, 2**64))[: len(codes) - n + 1]
    return mix(got) if mixed else got


def words(buf: np.ndarray, offs: np.ndarray, space: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of each maximal run of bytes that are not space, never across rows; each row's first word."""
    full = np.zeros(len(buf) + 2, bool)
    np.logical_not(space[buf], out=full[1:-1])
    cut = np.zeros(len(buf) + 1, bool)
    cut[offs] = True
    starts = np.flatnonzero(full[1:-1] & (~full[:-2] | cut[:-1]))
    ends = np.flatnonzero(full[1:-1] & (~full[2:] | cut[1:])) + 1
    return starts, ends, np.searchsorted(starts, offs)


def word_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    if not len(starts):
        return np.zeros(0, _U)
    total = np.concatenate(([_U(0)], np.cumsum(BYTE_CODE[buf] * powers(len(buf)))))
    got = (total[ends] - total[starts]) * powers(len(buf), pow(BASE, -1, 2**64))[starts]
    return mix(got + (ends - starts).astype(_U))
