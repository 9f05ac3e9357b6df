"""Benchmark decontamination by the q-gram lemma with diagonal bands and banded alignment.

Texts and benchmark items are folded (lower case, runs of anything but letters and digits become one space; code
points beyond the basic plane count as letters). An
item of m characters within k edits of a stretch of text shares at least m + 1 - q - k * q of its q-grams with it,
on diagonals that lie within k of each other. Shared q-grams are counted in overlapping bands of diagonals, bands
below the bound are discarded, and what remains is verified by an alignment inside the band. Long items are
searched in overlapping parts, so that a long stretch of them counts. Items of fewer than ``Q`` characters are found as
exact copies between word bounds; scripts written without spaces have a bound at every character.

The benchmark is taken in chunks of about ``CHUNK`` characters, each collected, indexed and sent by itself against all
documents; of several chunks each one's result is written before the next one is read. Where a text and a chunk share
more than ``ENTRIES`` pairs of q-grams, ranges of the chunk's parts, then overlapping stretches of the text, are taken one
after another, so that a common q-gram costs time but no memory.

Defined results: null and empty texts, and items that fold to nothing, match nothing; repeated
rows and items are reported each; texts of any length are searched whole; empty tables give no rows; other columns
are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.llm.common import discard, staged
from quillon.llm.textbatch import freed, slices, spread

Q, SHARE, PART = 10, 0.08, 200
CHUNK, ENTRIES = 4 << 20, 1 << 20
FILTER_BITS = 22
PRIME = np.uint64(0x100000001B3)
SPACELESS = ((0x0E00, 0x0F00), (0x1000, 0x10A0), (0x1780, 0x1800), (0x2E80, 0x110000))  # fixed ranges


def fold_table() -> np.ndarray:
    """What each code point of the basic plane folds to: its lower case, or a space."""
    return np.array([ord(c.lower()[0]) if c.isalnum() else 32 for c in map(chr, range(1 << 16))], np.uint32)


def folded(text: str | None, table: np.ndarray) -> np.ndarray:
    """The folded text as code points, without space at the ends."""
    code = np.frombuffer((text or "").encode("utf-32-le", "replace"), np.uint32)
    if len(code) and code.max() >> 16:
        code = np.where(code >> 16, code, table[code & 0xFFFF])
    else:
        code = table[code]
    space = code == 32
    keep = ~space
    keep[1:] |= ~space[:-1]  # the first space of a run
    code = code[keep]
    a, b = int(len(code) > 0 and code[0] == 32), len(code)
    return code[a : b - int(b > a and code[-1] == 32)]


def codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le"), np.uint32)


def grams(code: np.ndarray) -> np.ndarray:
    """A hash of the q-gram at each place."""
    n = len(code) - Q + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    with np.errstate(over="ignore"):
        one = code.astype(np.uint64) + np.uint64(1)
        two = one[:-1] * PRIME + one[1:]
        four = two[:-2] * PRIME**2 + two[2:]
        eight = four[:-4] * PRIME**4 + four[4:]
        h = eight[:n] * PRIME**2 + two[8 : 8 + n]
        h = (h ^ (h >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
        return h ^ (h >> np.uint64(29))


class Part(NamedTuple):
    item: int | None
    code: np.ndarray
    edits: int
    bound: int


class Index(NamedTuple):
    fold: np.ndarray
    parts: list[Part]
    seen: np.ndarray  # filter on the leading bits of a q-gram's hash
    grams: np.ndarray  # sorted distinct hashes
    key: np.ndarray  # of each entry, ascending: place in ``grams`` times the number of parts, and the part
    part: np.ndarray
    place: np.ndarray
    width: np.ndarray  # of each part's bands
    bound: np.ndarray
    short: dict[int, tuple[np.ndarray, dict[bytes, list[int | None]]]]  # by length: sorted hashes, items by code points


def parts_of(item: int | None, text: str | None, table: np.ndarray) -> list[Part]:
    """The item, or overlapping parts of it if it is long, with edit budget and q-gram bound."""
    code = folded(text, table)
    m = len(code)
    starts = [0] if m <= PART else [*range(0, m - PART, PART // 2), m - PART]
    out = []
    for a in starts if m >= Q else []:
        own = code[a : a + PART]
        edits = min(int(SHARE * len(own)), (len(own) - Q) // Q)
        out.append(Part(item, own, edits, len(own) + 1 - Q - edits * Q))
    return out


def index_of(items: list[tuple[int | None, str | None]]) -> Index:
    table = fold_table()
    parts = [p for item, text in items for p in parts_of(item, text, table)]
    h = np.concatenate([grams(p.code) for p in parts] or [np.zeros(0, np.uint64)])
    part = np.repeat(np.arange(len(parts)), [len(p.code) - Q + 1 for p in parts])
    place = np.concatenate([np.arange(len(p.code) - Q + 1) for p in parts] or [np.zeros(0, np.int64)])
    by = np.argsort(h, kind="stable")
    distinct, rank = np.unique(h[by], return_inverse=True)
    seen = np.zeros(1 << FILTER_BITS, bool)
    seen[h >> np.uint64(64 - FILTER_BITS)] = True
    return Index(table, parts, seen, distinct, rank * len(parts) + part[by], part[by], place[by], np.array([p.edits + 1 for p in parts]), np.array([p.bound for p in parts]), short_items(items, table))


def short_items(items: list[tuple[int | None, str | None]], table: np.ndarray) -> dict[int, tuple[np.ndarray, dict[bytes, list[int | None]]]]:
    by: dict[int, dict[bytes, list[int | None]]] = {}
    for item, text in items:
        code = folded(text, table)
        if 0 < len(code) < Q:
            by.setdefault(len(code), {}).setdefault(code.astype(np.uint32).tobytes(), []).append(item)
    return {m: (np.unique([hashed(np.frombuffer(c, np.uint32)[None])[0] for c in own]), own) for m, own in by.items()}


def hashed(windows: np.ndarray) -> np.ndarray:
    """A hash of each row of code points."""
    h = np.zeros(len(windows), np.uint64)
    for column in windows.T:
        h = h * PRIME + column.astype(np.uint64) + np.uint64(1)
    return h


def bounds(code: np.ndarray) -> np.ndarray:
    """For each place between characters, and both ends, whether a word may begin or end there."""
    free = code == 32
    for a, b in SPACELESS:
        free |= (code >= a) & (code < b)
    return np.r_[True, free[1:] | free[:-1], True]


def short_matches(code: np.ndarray, index: Index) -> Iterator[tuple[int | None, int]]:
    """Each short item found in the folded text, and its length."""
    edge = bounds(code) if index.short and len(code) else np.zeros(1, bool)
    for m, (hashes, own) in index.short.items():
        at = np.flatnonzero(edge[: max(0, len(edge) - m)] & edge[m:])
        if len(at):
            windows = code[at[:, None] + np.arange(m)].astype(np.uint32)
            windows = windows[np.isin(hashed(windows), hashes)]
            for found in {w.tobytes() for w in windows} & own.keys():
                yield from ((item, m) for item in own[found])


def banded(pattern: np.ndarray, text: np.ndarray, low: int, high: int, most: int | None = None) -> int:
    """Least edits that turn ``pattern`` into a stretch of ``text``, on diagonals (place in text less place in pattern) low to high.

    Beyond ``most`` edits any greater number may be given.
    """
    width = high - low + 1
    steps = np.arange(width)
    far = len(pattern) + len(text) + 1
    # row[d]: edits for the pattern so far, ending on diagonal low + d
    row = np.where((steps + low >= 0) & (steps + low <= len(text)), 0, far)
    padded = np.concatenate([np.full(max(0, -low), 0xFFFFFFFF, np.uint32), text, np.full(max(0, high + len(pattern) - len(text)) + 1, 0xFFFFFFFF, np.uint32)])
    shift = low + max(0, -low)
    for i, c in enumerate(pattern):
        window = padded[shift + i : shift + i + width]
        new = row + (window != c)  # along the diagonal
        new[:-1] = np.minimum(new[:-1], row[1:] + 1)  # a character of the pattern is left out
        new = np.minimum.accumulate(new - steps) + steps  # characters of the text are left out
        end = low + steps + i + 1
        row = np.where((end >= 0) & (end <= len(text)), new, far)
        if most is not None and i % 8 == 7 and row.min() > most:
            break
    return int(row.min())


def matches(text: str | None, index: Index) -> dict[int | None, tuple[int, int]]:
    """For each item found in the text, the least edits of a part and how many characters it has."""
    code = folded(text, index.fold)
    return long_matches(code, index) | {item: (0, m) for item, m in short_matches(code, index)}


def long_matches(code: np.ndarray, index: Index) -> dict[int | None, tuple[int, int]]:
    h = grams(code)
    at = np.flatnonzero(index.seen[h >> np.uint64(64 - FILTER_BITS)])
    if not len(at) or not len(index.grams):
        return {}
    found = np.minimum(np.searchsorted(index.grams, h[at]), len(index.grams) - 1)
    real = index.grams[found] == h[at]
    at, found = at[real], found[real]
    if not len(at):
        return {}
    out: dict[int | None, tuple[int, int]] = {}
    todo = [(0, len(code), 0, len(index.parts))]  # stretches of the text, ranges of parts
    while todo:
        a, b, low, high = todo.pop()
        i, j = np.searchsorted(at, [a, b - Q + 1])
        first, last = (np.searchsorted(index.key, found[i:j] * len(index.parts) + p) for p in (low, high))
        if (last - first).sum() <= ENTRIES or (high - low == 1 and b - a <= 8 * PART):
            verified(code, at[i:j], first, last - first, index, out)
        elif high - low > 1:
            todo += [(a, b, low, (low + high) // 2), (a, b, (low + high) // 2, high)]
        else:  # copies of a part, of fewer than 2 * PART characters, lie whole in one of the two
            todo += [(a, (a + b) // 2 + 2 * PART, low, high), ((a + b) // 2, b, low, high)]
    return out


def verified(code: np.ndarray, at: np.ndarray, first: np.ndarray, n: np.ndarray, index: Index, out: dict[int | None, tuple[int, int]]) -> None:
    """Adds to ``out`` what is found by the q-grams at the places ``at``, each with n of the index's entries from ``first``."""
    entry = spread(first, n)
    if not len(entry):
        return
    part, place = index.part[entry], index.place[entry]
    band = (np.repeat(at, n) - place) // index.width[part]
    # bands are two widths long and overlap by one, so diagonals within the budget meet in one of them; a q-gram of
    # the part counts once in a band
    part, band, place = np.r_[part, part], np.r_[band, band - 1], np.r_[place, place]
    by = np.lexsort((place, band, part))
    part, band, place = part[by], band[by], place[by]
    first = np.r_[True, (part[1:] != part[:-1]) | (band[1:] != band[:-1])]
    fresh = first | np.r_[True, place[1:] != place[:-1]]
    start = np.flatnonzero(first)
    count = np.add.reduceat(fresh.astype(np.int64), start)
    part, band = part[start], band[start]
    good = count >= index.bound[part]
    for p, b in zip(part[good].tolist(), band[good].tolist(), strict=True):
        item, own, most, _ = index.parts[p]
        low, high = b * (most + 1) - most, (b + 2) * (most + 1) - 1 + most
        from_ = max(0, low)
        region = code[from_ : max(from_, high + len(own) + most + 1)]
        edits = 0 if own.tobytes() in region.tobytes() and contains(region, own) else banded(own, region, low - from_, high - from_, most)
        if edits <= most and (item not in out or edits < out[item][0]):
            out[item] = (edits, len(own))


def contains(text: np.ndarray, part: np.ndarray) -> bool:
    raw, own, k = text.tobytes(), part.tobytes(), -1
    while (k := raw.find(own, k + 1)) >= 0:
        if k % 4 == 0:
            return True
    return False


def _found(batches: Iterator[pa.RecordBatch], index: Index) -> Iterator[pa.RecordBatch]:
    for piece in slices(batches):
        rows = [(d, i, e, m) for d, t in zip(piece.column(0).to_pylist(), piece.column(1).to_pylist(), strict=True) for i, (e, m) in matches(t, index).items()]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*rows, strict=True)], names=["doc_id", "item_id", "edits", "length"])


def chunks(benchmark: DataFrame) -> list[DataFrame]:
    """The benchmark's items in tables of about ``CHUNK`` characters."""
    size = benchmark.agg(F.sum(F.length("text"))).first()[0] or 0
    n = max(1, -(-size // CHUNK))
    dealt = F.pmod(F.xxhash64("item_id", "text"), F.lit(n))
    return [benchmark.where(F.col("text").isNotNull() & (dealt == k)).select("item_id", "text") for k in range(n)]


def items_of(chunk: DataFrame) -> list[tuple[int | None, str | None]]:
    return [(r["item_id"], r["text"]) for r in chunk.collect()]


def leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """doc_id, item_id, edits, length (of the item or part that matched) for every document and item found in it."""
    rows = docs.select(docs[id_col].alias("doc_id"), docs["text"])

    def found(chunk: DataFrame) -> DataFrame:
        index = index_of(items_of(chunk))
        return rows.mapInArrow(lambda it: freed(_found(it, index)), "doc_id long, item_id long, edits long, length long")

    each = chunks(benchmark)
    return found(each[0]) if len(each) == 1 else reduce(DataFrame.union, [staged(found(c), "leaks") for c in each])


def _clean(batches: Iterator[pa.RecordBatch], index: Index) -> Iterator[pa.RecordBatch]:
    for piece in slices(batches):
        yield piece.filter(pa.array([not matches(t, index) for t in piece.column("text").to_pylist()]))


def without_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs``, with all columns, in which no benchmark item is found."""

    def clean(rows: DataFrame, chunk: DataFrame) -> DataFrame:
        index = index_of(items_of(chunk))
        return rows.mapInArrow(lambda it: freed(_clean(it, index)), rows.schema)

    *some, last = chunks(benchmark)
    own = False
    for c in some:
        before, docs = docs, staged(clean(docs, c), "clean-documents")
        if own:
            discard(before)
        own = True
    return clean(docs, last)
