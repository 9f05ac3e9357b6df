"""Removal of long repeated byte strings by merging Burrows-Wheeler transforms column by column.

A string of ``length`` bytes is judged where it meets its copies: its anchor is the leftmost least hash among its
``K``-byte grams, so equal strings have equal anchors at equal places. Only anchors that occur twice can hold a
repeat. The bytes around such an anchor, as far as the strings go that choose it, are its context. Contexts are
aligned at their anchors and their (positional) Burrows-Wheeler transforms merged: the contexts' order is refined
from one column to the next by a stable pass over the column's symbols, which interleaves all contexts without
sorting a suffix again, and common lengths of neighbours follow from the ranges' minima of the column before. A
context whose neighbour agrees on the last ``length`` bytes has a repeated string there; each string belongs to one
anchor, so it never meets itself.

Equal texts are one text with a number of copies, equal contexts one context with a number of places; only one
copy of a context's bytes is shuffled. Counts, anchors and places cover all documents.

Defined results: null texts are empty; texts shorter than ``length`` stay; a text that occurs twice and is long
enough goes wholly (repeated rows are copies); matches never cross documents; texts of any length are judged whole;
an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.llm.common import staged
from quillon.llm.textbatch import freed, slices

K = 32
PRIME = np.uint64(0x100000001B3)
SEGMENT, PLACE_BITS = 1 << 18, 20
SALTS = 8
CELLS = 8 << 20  # cells of the matrix that a task merges at once; a larger group of contexts is merged by itself


def gram_hashes(raw: np.ndarray) -> np.ndarray:
    """A hash of the ``K`` bytes at each place."""
    with np.errstate(over="ignore"):
        h, p = raw.astype(np.uint64) + np.uint64(1), PRIME
        for step in (1, 2, 4, 8, 16):
            h = h[:-step] * p + h[step:]
            p = p * p
        h = (h ^ (h >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
        return h ^ (h >> np.uint64(29))


def anchors(raw: bytes, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For each anchor its hash and place, and the first and last string start that choose it."""
    window = length - K + 1
    h = gram_hashes(np.frombuffer(raw, np.uint8))
    low = np.uint64((1 << PLACE_BITS) - 1)
    chosen = []
    for a in range(0, len(h) - window + 1, SEGMENT):
        own = h[a : a + SEGMENT + window - 1]
        n = len(own) - window + 1
        key = (own & ~low) | np.arange(len(own), dtype=np.uint64)  # leftmost among equals
        key = np.r_[key, np.full(-len(key) % window, ~np.uint64(0))].reshape(-1, window)
        before = np.minimum.accumulate(key, 1).ravel()
        after = np.minimum.accumulate(key[:, ::-1], 1)[:, ::-1].ravel()
        chosen.append((np.minimum(after[:n], before[window - 1 : window - 1 + n]) & low).astype(np.int64) + a)
    place = np.concatenate(chosen)
    first = np.flatnonzero(np.r_[True, place[1:] != place[:-1]])
    last = np.r_[first[1:], len(place)] - 1
    return h[place[first]] & ~low, place[first], first, last


def _anchor_rows(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    for piece in slices(batches, "text"):
        keys, hs, ps = [], [], []
        for raw in piece.column("text").cast(pa.binary()).to_pylist():
            if raw and len(raw) >= length:
                h, p, *_ = anchors(raw, length)
                keys += [hashlib.sha256(raw).digest()] * len(h)
                hs.append(h.view(np.int64))
                ps.append(p)
        if keys:
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(np.concatenate(hs)), pa.array(np.concatenate(ps))], names=["key", "h", "place"])


def _contexts(raw: bytes, places: list[int], length: int) -> Iterator[tuple[int, int, int, int, bytes]]:
    """Hash, place of the anchor, first start, number of starts and bytes of the context of each anchor in ``places``."""
    h, p, first, last = anchors(raw, length)
    for i in np.flatnonzero(np.isin(p, places)).tolist():
        a, b = int(first[i]), int(last[i])
        yield int(h.view(np.int64)[i]), int(p[i]), a, b - a + 1, raw[a : b + length]


def _context_rows(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    """Where contexts are, and a hash of their bytes and of the anchor's place in them."""
    for piece in slices(batches, "text"):
        rows = []
        for key, raw, places in zip(piece.column("key").to_pylist(), piece.column("text").cast(pa.binary()).to_pylist(), piece.column("places").to_pylist(), strict=True):
            rows += [(key, h, a, n, xxhash.xxh128_digest(b"%d:" % (p - a) + own)) for h, p, a, n, own in _contexts(raw, places, length)]
        if rows:
            kinds = (pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=["key", "h", "first", "starts", "context"])


def _context_bytes(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    """The bytes of the wanted contexts: rows with text, places and firsts."""
    for piece in slices(batches, "text"):
        rows = []
        for raw, places, wanted in zip(piece.column("text").cast(pa.binary()).to_pylist(), piece.column("places").to_pylist(), piece.column("firsts").to_pylist(), strict=True):
            want = set(wanted)
            rows += [(h, p - a, n, own) for h, p, a, n, own in _contexts(raw, places, length) if a in want]
        if rows:
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=["h", "anchor", "starts", "bytes"])


def merged(texts: list[bytes], anchor: np.ndarray, starts: np.ndarray, length: int) -> list[list[tuple[int, int]]]:
    """For each context the ranges of starts whose string occurs in another context at the same place before the anchor.

    The contexts' transforms are interleaved column by column; column c holds the byte at c - width from the anchor.
    """
    m, width = len(texts), length - K
    shift = width - anchor  # column of each context's first byte
    size = np.array([len(t) for t in texts])
    columns = int((shift + size).max())
    cells = np.full((m, columns), 256, np.uint16)  # 256: no byte here
    for i, t in enumerate(texts):
        cells[i, shift[i] : shift[i] + len(t)] = np.frombuffer(t, np.uint8)
    cells = np.ascontiguousarray(cells.T)
    order = np.arange(m)
    common = np.zeros(m + 1, np.int64)  # of order[i - 1] and order[i], up to the column before; one more at the end
    open_ = np.full(m, -1)
    out: list[list[tuple[int, int]]] = [[] for _ in range(m)]
    was = np.zeros(m, bool)
    for c in range(columns):
        symbol = cells[c][order]
        by = np.argsort(symbol, kind="stable")
        sorted_ = symbol[by]
        same = (sorted_[1:] == sorted_[:-1]) & (sorted_[1:] != 256)
        at = np.flatnonzero(same)
        new = np.zeros(m + 1, np.int64)
        if len(at):
            bounds = np.stack([by[at] + 1, by[at + 1] + 1], 1).ravel()
            new[at + 1] = np.minimum.reduceat(common, bounds)[::2] + 1
        order, common = order[by], new
        if c >= length - 1:
            long = np.maximum(common[:-1], common[1:]) >= length
            now = np.zeros(m, bool)
            now[order[long]] = True
            begin = c - length + 1 - shift  # the start of the string that ends here, in its context
            now &= (begin >= 0) & (begin < starts)
            for i in np.flatnonzero(now & ~was).tolist():
                open_[i] = begin[i]
            for i in np.flatnonzero(was & ~now).tolist():
                out[i].append((int(open_[i]), int(begin[i])))
            was = now
    for i in np.flatnonzero(was).tolist():
        out[i].append((int(open_[i]), int(columns - length + 1 - shift[i])))
    return out


def _merged_rows(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    """Hash and repeated starts of each context; rows come sorted by anchor hash, a group is never cut."""

    def done(t: pa.Table) -> pa.RecordBatch:
        texts, anchor, starts = t.column("bytes").to_pylist(), t.column("anchor").to_numpy(), t.column("starts").to_numpy()
        ranges = merged(texts, anchor, starts, length)
        names = [xxhash.xxh128_digest(b"%d:" % a + x) for a, x in zip(anchor.tolist(), texts, strict=True)]
        kind = pa.list_(pa.struct([("a", pa.int64()), ("b", pa.int64())]))
        return pa.RecordBatch.from_arrays([pa.array(names, pa.binary()), pa.array([[{"a": a, "b": b} for a, b in r] for r in ranges], kind)], names=["context", "ranges"])

    held, most = None, CELLS // (2 * length)
    for batch in batches:
        new = pa.Table.from_batches([batch])
        held = new if held is None else pa.concat_tables([held, new])
        while held.num_rows > most:
            h = held.column("h").to_numpy()
            cut = int(np.searchsorted(h, h[most]))  # whole groups of at most ``most`` contexts, or one larger group
            if not cut:
                cut = int(np.searchsorted(h, h[0], side="right"))
            if cut == len(h):
                break  # it may go on
            yield done(held.slice(0, cut))
            held = held.slice(cut)
    if held is not None and held.num_rows:
        yield done(held)


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Removes covered bytes: counts, and the hash and bytes of what is left."""
    for piece in slices(batches, "text"):
        rows = []
        for key, raw, spans in zip(piece.column("key").to_pylist(), piece.column("text").cast(pa.binary()).to_pylist(), piece.column("spans").to_pylist(), strict=True):
            runs: list[list[int]] = []
            for a, b in sorted((s["a"], s["b"]) for s in spans):
                if runs and a <= runs[-1][1]:
                    runs[-1][1] = max(runs[-1][1], b)
                else:
                    runs.append([a, b])
            edges = [0, *(x for r in runs for x in r), len(raw)]
            left = b"".join(raw[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True))
            rows.append((key, len(raw) - len(left), len(runs), hashlib.sha256(left).hexdigest(), left))
        if rows:
            kinds = (pa.binary(), pa.int64(), pa.int64(), pa.string(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=["key", "n_removed", "n_spans", "kept_sha256", "kept"])


def repeated_spans(docs: DataFrame, length: int = 400, text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """(key, text, places) of the distinct texts with repeated anchors, and (key, spans) of what is repeated in them."""
    texts = docs.where(F.octet_length(text_col) >= length).select(F.col(text_col).alias("text"))
    found = staged(texts.mapInArrow(lambda it: freed(_anchor_rows(it, length)), "key binary, h long, place long"), "anchors")
    at = F.struct("key", "place")
    often = found.groupBy("h").agg(F.min(at).alias("a"), F.max(at).alias("b")).where(F.col("a") != F.col("b")).select("h")
    places = found.join(often, "h").groupBy("key").agg(F.collect_set("place").alias("places"))
    distinct = texts.select(F.unhex(F.sha2("text", 256)).alias("key"), "text").groupBy("key").agg(F.first("text").alias("text"))
    holders = staged(distinct.join(places, "key"), "anchored-texts")

    rows = holders.mapInArrow(lambda it: freed(_context_rows(it, length)), "key binary, h long, first long, starts long, context binary")
    rows = staged(rows, "contexts")
    kinds = staged(rows.groupBy("context", "h").agg(F.count("*").alias("n"), F.min(F.struct("key", "first")).alias("at")), "context-kinds")
    several = kinds.groupBy("h").agg(F.min("context").alias("a"), F.max("context").alias("b")).where(F.col("a") != F.col("b")).select("h")
    wanted = kinds.join(several, "h", "left_semi").select(F.col("at.key").alias("key"), F.col("at.first").alias("first")).groupBy("key").agg(F.collect_set("first").alias("firsts"))
    shipped = holders.join(wanted, "key").select("text", "places", "firsts").mapInArrow(lambda it: freed(_context_bytes(it, length)), "h long, anchor long, starts long, bytes binary")
    ranges = shipped.repartition("h").sortWithinPartitions("h").mapInArrow(lambda it: freed(_merged_rows(it, length)), "context binary, ranges array<struct<a:long,b:long>>")

    # a context that occurs twice is repeated wholly, others where the merge says so
    whole = F.array(F.struct(F.lit(0).cast("long").alias("a"), F.lit(1 << 40).cast("long").alias("b")))
    known = kinds.where(F.col("n") > 1).select("context", whole.alias("ranges")).union(ranges.where(F.size("ranges") > 0).select("context", "ranges"))
    known = known.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    salted = rows.withColumn("_salt", F.pmod(F.xxhash64("key"), F.lit(SALTS)).cast("int"))
    spans = salted.join(known, ["context", "_salt"]).select("key", "first", "starts", F.explode("ranges").alias("r"))
    end = F.least(F.col("r.b"), F.col("starts"))
    spans = spans.select("key", F.struct((F.col("first") + F.col("r.a")).alias("a"), (F.col("first") + end + length - 1).alias("b")).alias("span"))
    return holders, spans.groupBy("key").agg(F.collect_list("span").alias("spans"))


def without_repeats(docs: DataFrame, length: int = 400, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 and kept (the remaining bytes; null where none were removed) for every row."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = staged(docs.select(F.col(id_col).alias("doc_id"), F.unhex(F.sha2(text, 256)).alias("key"), F.octet_length(text).cast("long").alias("n_bytes")), "texts")
    holders, spans = repeated_spans(docs, length, text_col)
    cut = holders.join(spans, "key").select("key", "text", "spans").mapInArrow(lambda it: freed(_cut(it)), "key binary, n_removed long, n_spans long, kept_sha256 string, kept binary")
    copied = rows.where(F.col("n_bytes") >= length).groupBy("key").agg(F.count("*").alias("copies")).where("copies > 1")
    empty = hashlib.sha256(b"").hexdigest()
    gone = copied.select("key", F.lit(None).cast("long").alias("n_removed"), F.lit(1).cast("long").alias("n_spans"), F.lit(empty).alias("kept_sha256"), F.lit(b"").alias("kept"))
    changed = cut.join(copied, "key", "left_anti").union(gone).withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    salted = rows.withColumn("_salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int"))
    out = salted.join(changed, ["key", "_salt"], "left")
    zero = F.lit(0).cast("long")
    return out.select(
        "doc_id",
        "n_bytes",
        F.when(F.col("n_spans").isNull(), zero).otherwise(F.coalesce("n_removed", "n_bytes")).alias("n_removed"),
        F.coalesce("n_spans", zero).alias("n_spans"),
        F.coalesce("kept_sha256", F.lower(F.hex("key"))).alias("kept_sha256"),
        "kept",
    )


def repeats_report(docs: DataFrame, length: int = 400) -> DataFrame:
    """The digest of ``without_repeats``, and has_repeat: whether anything was removed."""
    return without_repeats(docs, length).drop("kept").withColumn("has_repeat", F.col("n_removed") > 0)
