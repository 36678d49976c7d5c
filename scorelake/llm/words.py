"""Batches of texts as word numbers, and hashed character n-grams of the distinct words; numpy only."""

from __future__ import annotations

from collections import defaultdict
from itertools import count

import numpy as np

MIX = np.uint64(0x9E3779B97F4A7C15)


def numbered(texts: list[list[str]]) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """ids of all words in order, each text's end among them, and the distinct words."""
    number = defaultdict(count().__next__)
    ids: list[int] = []
    ends = np.empty(len(texts), np.int64)
    at = number.__getitem__
    for k, words in enumerate(texts):
        ids.extend(map(at, words))
        ends[k] = len(ids)
    return np.array(ids, np.int64), ends, list(number)


def grams(words: list[str], sizes: tuple[int, ...], buckets: int, whole: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """(word number, bucket) of each character n-gram of <word>, n in sizes; with whole, also one for the word itself."""
    if not words:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    own = np.arange(len(words))
    cp = np.frombuffer(("<" + "><".join(words) + ">").encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    size = np.fromiter(map(len, words), np.int64, len(words)) + 2
    start = np.cumsum(size) - size
    of = np.repeat(own, size)
    left = np.repeat(start + size, size) - np.arange(len(cp))  # characters to the piece's end
    at, to = [], []
    h = np.zeros(len(cp), np.uint64)
    with np.errstate(over="ignore"):
        for n in range(1, max(sizes) + 1):
            shifted = cp if n == 1 else np.concatenate([cp[n - 1 :], np.zeros(min(n - 1, len(cp)), np.uint64)])
            h = (h ^ shifted) * MIX
            h ^= h >> np.uint64(29)
            if n in sizes:
                ok = left >= n
                at.append(own[of[ok]])
                to.append(((h[ok] + np.uint64(n)) * MIX >> np.uint64(20)) % np.uint64(buckets))
        if whole:
            mixed = (cp + MIX) * (np.arange(len(cp), dtype=np.uint64) - np.repeat(start, size).astype(np.uint64) + np.uint64(7)) * MIX
            mixed ^= mixed >> np.uint64(31)
            at.append(own)
            to.append((np.add.reduceat(mixed, start) * MIX >> np.uint64(20)) % np.uint64(buckets))
    return np.concatenate(at), np.concatenate(to).astype(np.int64)
