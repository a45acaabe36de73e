"""Suffix order of a repetitive text by prefix-free parsing.

Rolling-hash triggers cut the text into phrases that overlap by one trigger. The distinct phrases are the dictionary,
the sequence of their ranks is the parse. No phrase suffix longer than a trigger is a prefix of another, so a text
suffix is ordered first by the phrase suffix it starts with, then by the rank of the parse suffix that follows:
sorting the dictionary and the parse sorts the text, at the cost of the dictionary's distinct text.
"""

from __future__ import annotations

import numpy as np

from leafwork.llm import hashing as H

TRIGGER = 10  # bytes
DIVISOR = 32  # one window in so many is a trigger


def refine(rank: np.ndarray, order: np.ndarray, left: np.ndarray, step: int, enough: int) -> np.ndarray:
    """Prefix doubling on ranks that are group starts and right for `step` symbols. left: symbols from each place to its string's end."""
    while step < enough:
        size = np.bincount(rank, minlength=len(rank))
        tied = order[(size[rank[order]] > 1) & (left[order] > step)]
        if not len(tied):
            break
        key = rank[tied] * np.int64(len(rank) + 1) + rank[tied + step] + 1
        by = np.argsort(key)
        tied, key = tied[by], key[by]
        new = np.ones(len(tied), bool)
        new[1:] = key[1:] != key[:-1]
        # `tied` is sorted by rank, so members of a group stand together; each new subgroup starts behind the former ones
        group = rank[tied]
        head = np.ones(len(tied), bool)
        head[1:] = group[1:] != group[:-1]
        index = np.arange(len(tied))
        in_group = index - np.maximum.accumulate(np.where(head, index, 0))
        sub = np.maximum.accumulate(np.where(new, index, 0))
        fresh = group + in_group[sub]
        rank = rank.copy()
        rank[tied] = fresh
        order = tied
        step *= 2
    return rank


def grouped(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rank of each key as the first place of its group in sorted order, and that order."""
    order = np.argsort(key)
    s = key[order]
    new = np.ones(len(s), bool)
    new[1:] = s[1:] != s[:-1]
    rank = np.empty(len(s), np.int64)
    rank[order] = np.maximum.accumulate(np.where(new, np.arange(len(s)), 0))
    return rank, order


def dictionary_ranks(phrases: list[bytes], enough: int) -> tuple[np.ndarray, np.ndarray]:
    """Ranks of all suffixes of the phrases, laid end to end, equal for equal suffixes; and where each phrase starts."""
    sizes = np.array([len(p) for p in phrases], np.int64)
    begin = np.cumsum(sizes) - sizes
    n = int(sizes.sum())
    flat = np.zeros(n + 8, np.uint8)
    flat[:n] = np.frombuffer(b"".join(phrases), np.uint8)
    left = np.repeat(begin + sizes, sizes) - np.arange(n)
    key = np.zeros(n, np.uint64)
    for i in range(7):
        key |= np.where(left > i, flat[i : n + i], 0).astype(np.uint64) << np.uint64(56 - 8 * i)
    key |= np.minimum(left, 7).astype(np.uint64)
    rank, order = grouped(key)
    return refine(rank, order, left, 7, enough), begin


def suffix_keys(text: np.ndarray, at: np.ndarray, enough: int) -> np.ndarray:
    """For the suffixes of text that start at `at`: sort keys that order them at least by their first `enough` bytes."""
    n = len(text)
    padded = np.concatenate([text, np.zeros(TRIGGER, np.uint8)])
    hashes = H.rolling(H.BYTE_CODE[padded], TRIGGER)
    end = H.rolling(H.BYTE_CODE[np.zeros(TRIGGER, np.uint8)], TRIGGER)[0]
    cuts = np.flatnonzero((hashes[:n] % np.uint64(DIVISOR) == 0) | (hashes[:n] == end))
    begin = np.concatenate(([0], cuts[cuts > 0]))
    past = np.append(begin[1:], n) + TRIGGER
    whole = padded.tobytes()
    seq = [whole[a:b] for a, b in zip(begin.tolist(), past.tolist(), strict=True)]
    phrases = sorted(set(seq))
    number = {p: i for i, p in enumerate(phrases)}
    parse = np.fromiter((number[p] for p in seq), np.int64, len(seq))
    ranks, where = dictionary_ranks(phrases, enough)
    first, order = grouped(parse)
    after = refine(first, order, len(parse) - np.arange(len(parse)), 1, enough)
    after = np.append(after + 1, 0)  # behind the last phrase comes nothing
    phrase = np.searchsorted(begin, at, "right") - 1
    return ranks[where[parse[phrase]] + at - begin[phrase]] * np.int64(len(after) + 1) + after[phrase + 1]


def eights(text: np.ndarray) -> np.ndarray:
    """The eight bytes from each place on as one number."""
    n = len(text)
    padded = np.concatenate([text, np.zeros(7, np.uint8)])
    out = np.zeros(n, np.uint64)
    for i in range(8):
        out |= padded[i : n + i].astype(np.uint64) << np.uint64(8 * i)
    return out


def windows(sizes: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Windows of each string, of strings end to end, and where all of them start."""
    wins = np.maximum(sizes - size + 1, 0)
    return wins, np.arange(int(wins.sum())) - np.repeat(np.cumsum(wins) - wins, wins) + np.repeat(np.cumsum(sizes) - sizes, wins)


def repeated_windows(strings: list[bytes], size: int) -> list[np.ndarray]:
    """Which `size`-byte windows of each string occur more than once in the strings together.

    Strings without a window whose hash occurs twice hold nothing that repeats: the others alone are put in suffix order.
    """
    sizes = np.array([len(s) for s in strings], np.int64)
    wins, at = windows(sizes, size)
    hit = np.zeros(len(at), bool)
    near = H.rolling(H.BYTE_CODE[np.frombuffer(b"".join(strings), np.uint8)], size)[at]
    ranked = np.sort(near)
    twice = ranked[1:][ranked[1:] == ranked[:-1]]
    if len(twice):
        maybe = twice[np.minimum(np.searchsorted(twice, near), len(twice) - 1)] == near
        string = np.repeat(np.arange(len(sizes)), wins)
        some = np.unique(string[maybe])
        hit[np.isin(string, some)] = neighbours([strings[i] for i in some.tolist()], size)
    return np.split(hit, np.cumsum(wins)[:-1])


def neighbours(strings: list[bytes], size: int) -> np.ndarray:
    """For all windows of the strings, whether one next to it in suffix order is equal."""
    text = np.frombuffer(b"".join(strings), np.uint8)
    _, at = windows(np.array([len(s) for s in strings], np.int64), size)
    order = np.argsort(suffix_keys(text, at, size))
    near = H.rolling(H.BYTE_CODE[text], size)[at[order]]
    same = np.flatnonzero(near[1:] == near[:-1])
    a, b = at[order[same]], at[order[same + 1]]
    true = np.ones(len(same), bool)
    wide = eights(text) if size >= 8 else text
    for i in (*range(0, size - 7, 8), size - 8) if size >= 8 else range(size):  # the hash only spares comparisons
        true &= wide[a + i] == wide[b + i]
    same = same[true]
    hit = np.zeros(len(at), bool)
    hit[order[same]] = True
    hit[order[same + 1]] = True
    return hit
