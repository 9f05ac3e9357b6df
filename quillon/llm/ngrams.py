"""Hashed word and character n-grams of words, vectorised over a buffer of words."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from quillon.llm.textbatch import flat_bytes

BUCKETS = 1 << 17
LEAST, MOST = 3, 5
PRIME = np.uint64(0x100000001B3)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(29))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


def word_features(words: pa.Array, buckets: int = BUCKETS) -> tuple[np.ndarray, np.ndarray]:
    """Bucket and word number of each feature: the whole word, and byte n-grams of ``<word>``."""
    raw, offsets = flat_bytes(words)
    size = np.diff(offsets) + 2
    buf = np.empty(int(size.sum()), np.uint64)
    ends = np.cumsum(size)
    inner = np.ones(len(buf), bool)
    inner[ends - size] = inner[ends - 1] = False
    buf[inner] = raw
    buf[ends - size], buf[ends - 1] = ord("<"), ord(">")
    owner = np.repeat(np.arange(len(words)), size)
    found, owners = [], []
    with np.errstate(over="ignore"):
        start = np.cumsum(size) - size
        place = np.arange(len(buf)) - np.repeat(start, size)
        powers = np.cumprod(np.full(int(size.max(initial=1)), PRIME))
        whole = np.add.reduceat((buf + np.uint64(1)) * powers[place], start) if len(words) else np.zeros(0, np.uint64)
        found.append(_mixed(whole + np.uint64(11)))
        owners.append(np.arange(len(words)))
        h = buf + np.uint64(1)
        for n in range(2, MOST + 1):
            h = h[:-1] * PRIME + buf[n - 1 :] + np.uint64(1) if len(h) > 1 else h[:0]
            if n >= LEAST:
                inside = owner[: len(h)] == owner[n - 1 : n - 1 + len(h)]
                found.append(_mixed(h[inside] + np.uint64(n)))
                owners.append(owner[: len(h)][inside])
    return (np.concatenate(found) % np.uint64(buckets)).astype(np.int64), np.concatenate(owners)
