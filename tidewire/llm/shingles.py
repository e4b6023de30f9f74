"""Token shingles of whole texts, hashed in numpy over Arrow batches."""

from __future__ import annotations

import re
from collections.abc import Iterable

import numpy as np
import xxhash

#: Fixed value: the token pattern of the collectors, on lower-cased text.
TOKEN = re.compile(r"[0-9a-zA-Zа-яА-ЯіІїЇєЄґҐ']+")
_FACTORS = np.random.default_rng(20250106).integers(1, 1 << 63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


class TokenHashes(dict):
    """Token to 64-bit hash, kept per worker; emptied when it has grown to `most` tokens."""

    most = 500_000

    def __missing__(self, token: str) -> int:
        if len(self) >= self.most:
            self.clear()
        value = self[token] = xxhash.xxh3_64_intdigest(token)
        return value


HASHES = TokenHashes()


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective mix of 64-bit values."""
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def token_hashes(titles: Iterable[str | None], texts: Iterable[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """All tokens' hashes, one record after the other, and the number of tokens of each record."""
    flat: list[np.ndarray] = []
    counts = []
    look = HASHES.__getitem__
    for title, text in zip(titles, texts):
        tokens = TOKEN.findall(f"{title or ''} {text or ''}".lower())
        counts.append(len(tokens))
        flat.append(np.fromiter(map(look, tokens), np.uint64, len(tokens)))
    return np.concatenate(flat) if flat else np.empty(0, np.uint64), np.array(counts, np.int64)


def grams(flat: np.ndarray, counts: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of `size` tokens within records, in order, and their number per record."""
    n = np.maximum(counts - (size - 1), 0)
    if not n.sum():
        return np.empty(0, np.uint64), n
    length = len(flat) - size + 1
    h = np.zeros(length, np.uint64)
    for j in range(size):
        h += flat[j : j + length] * _FACTORS[j]
    starts = np.cumsum(counts) - counts
    at = np.repeat(starts - (np.cumsum(n) - n), n) + np.arange(n.sum())
    return mixed(h[at]), n


def distinct_sorted(values: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct values of each record in ascending order, and their number."""
    if not len(values):
        return values, n
    record = np.repeat(np.arange(len(n)), n)
    order = np.lexsort((values, record))
    v, r = values[order], record[order]
    keep = np.ones(len(v), bool)
    keep[1:] = (v[1:] != v[:-1]) | (r[1:] != r[:-1])
    return v[keep], np.bincount(r[keep], minlength=len(n))


def per_record(ufunc: np.ufunc, values: np.ndarray, n: np.ndarray) -> np.ndarray:
    """ufunc reduced over each record's values; records without any must be left out before."""
    return ufunc.reduceat(values, np.cumsum(n) - n)


def overlap(a: np.ndarray, b: np.ndarray) -> float:
    """Jaccard similarity of two sorted arrays of distinct values."""
    shared = len(np.intersect1d(a, b, assume_unique=True))
    return shared / (len(a) + len(b) - shared) if len(a) + len(b) else 0.0
