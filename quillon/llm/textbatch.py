"""Reading text columns in Arrow batches, in slices of bounded size."""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 4 << 20


def slices(batches: Iterator[pa.RecordBatch], text: str = "text", most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The rows of ``batches`` in order, in pieces of about ``most`` bytes of text; a longer text is a piece of its own."""
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        size = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        piece = (np.cumsum(size) - 1) // most
        cuts = [0, *(np.flatnonzero(np.diff(piece)) + 1).tolist(), n]
        for a, b in zip(cuts, cuts[1:], strict=False):
            if b > a:
                yield batch.slice(a, b - a)


def as_bytes(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of each text; null is empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def coded_words(column: pa.Array) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    """All ASCII-whitespace separated words of the texts in order as numbers, the distinct words, the words of each text."""
    raw, offsets = flat_bytes(column)
    inside = ~((raw == 32) | (raw - np.uint8(9) <= 4))
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    texts = offsets[:-1][np.diff(offsets) > 0]
    first[texts] = inside[texts]
    starts = np.flatnonzero(first)
    place = np.cumsum(inside)
    words = byte_strings(raw[inside], np.append(place[starts] - 1, place[-1] if len(place) else 0))
    d = words.dictionary_encode()
    return d.indices.to_numpy(zero_copy_only=False).astype(np.int64), d.dictionary, np.diff(np.searchsorted(starts, offsets))


def freed(rows: Iterator) -> Iterator:
    """``rows``; after the last one, the memory that the task has freed goes back to the system.

    Python workers outlive their tasks, and what their allocators keep would count against the executor.
    """
    try:
        yield from rows
    finally:
        del rows
        release()


def release() -> None:
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):  # of the GNU C library
        trim(0)


def flat_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All UTF-8 bytes of the texts, and where each text begins (and the last ends); null is empty."""
    whole = pc.fill_null(column.cast(pa.large_binary()), b"")
    offsets = np.frombuffer(whole.buffers()[1], np.int64)[whole.offset : whole.offset + len(whole) + 1]
    raw = np.frombuffer(whole.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
    return raw, offsets - offsets[0]


def byte_strings(raw: np.ndarray, offsets: np.ndarray) -> pa.Array:
    """The strings of ``raw`` between ``offsets``, without a copy."""
    return pa.Array.from_buffers(pa.large_binary(), len(offsets) - 1, [None, pa.py_buffer(np.ascontiguousarray(offsets, np.int64)), pa.py_buffer(raw)])


def spread(first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """first[0], first[0] + 1, ... (size[0] of them), first[1], ..."""
    return np.repeat(first - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))
