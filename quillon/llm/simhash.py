"""SimHash near-duplicates with pivot distance tables.

Fingerprints: XXH64 of word shingles, 64 majority bits. Fingerprints that differ in at most ``bits`` bits are linked.
Distinct fingerprints are dealt to buckets so that linked ones share one at least: the bits are cut into
``bits + r`` blocks and a bucket fixes r of them (r grows with the number of fingerprints, so that buckets stay
small). In a bucket, a table holds each fingerprint's Hamming distances to reference fingerprints (pivots); by the
triangle inequality pairs whose greatest coordinate difference exceeds ``bits`` cannot be linked and are discarded,
and the survivors are verified. A bucket yields a spanning forest of its links, at most one row per fingerprint,
so large groups of near copies never become pairs; components are joined afterwards.

Defined results: null and empty texts have fingerprint zero and are linked like any other; repeated rows share a
fingerprint; a null id never names a component unless all its members' ids are null; texts of any length are
hashed whole; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import math
import random
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.llm.common import staged
from quillon.llm.graph import components
from quillon.llm.near_copies import near_copies
from quillon.llm.textbatch import as_bytes, freed, slices

SEED, PIVOTS, SALTS = 42, 24, 8
MASK = (1 << 64) - 1
RECALL = 0.95  # of pairs at the greatest distance, by which tables are counted
BUCKET = 64  # fingerprints a bucket should hold on average, at most
AT_ONCE = 1 << 15


def fingerprint(text: bytes, shingle: int, width: int = 1) -> tuple[int, ...]:
    """``width`` numbers of 64 majority bits; the first is that of the shingles' XXH64, the others of values mixed from it."""
    words = text.lower().split()
    if not words:
        return (0,) * width
    joined, size = b" ".join(words), np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(size + 1) - 1
    starts = ends - size
    k = min(shingle, len(words))
    first, last = starts[: len(words) - k + 1].tolist(), ends[k - 1 :].tolist()
    total = np.zeros((width, 64), np.int64)
    digest = xxhash.xxh64_digest
    for a in range(0, len(first), AT_ONCE):
        block = b"".join([digest(joined[x:y], SEED) for x, y in zip(first[a : a + AT_ONCE], last[a : a + AT_ONCE], strict=True)])
        h = np.frombuffer(block, ">u8")
        for w in range(width):
            if w:
                h = mixed(h.astype(np.uint64), w).astype(">u8")
            total[w] += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
    return tuple(int.from_bytes(np.packbits(2 * t > len(first)).tobytes(), "big") for t in total)


def mixed(h: np.ndarray, w: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        h = (h + np.uint64(w * 0x9E3779B97F4A7C15 & MASK)) * np.uint64(0xBF58476D1CE4E5B9)
        h = (h ^ (h >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
        return h ^ (h >> np.uint64(32))


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def columns(width: int) -> list[str]:
    return ["fp", *(f"fp{w}" for w in range(1, width))]


def _fingerprints(batches: Iterator[pa.RecordBatch], shingle: int, width: int) -> Iterator[pa.RecordBatch]:
    for piece in slices(batches):
        found = [fingerprint(x, shingle, width) for x in as_bytes(piece.column(1))]
        parts = [pa.array([signed(f[w]) for f in found], pa.int64()) for w in range(width)]
        yield pa.RecordBatch.from_arrays([piece.column(0).cast(pa.int64()), *parts], names=["doc_id", *columns(width)])


def fingerprints(docs: DataFrame, shingle: int = 4, width: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and the fingerprint's words as signed longs (fp, fp1, ...) for every row."""
    schema = ", ".join(f"{c} long" for c in ["doc_id", *columns(width)])
    return docs.select(docs[id_col], docs[text_col]).mapInArrow(lambda it: freed(_fingerprints(it, shingle, width)), schema)


def masks(bits: int, n: int) -> list[int]:
    """Bit masks of which any two fingerprints within ``bits`` agree on one, with about ``BUCKET`` of n in a bucket."""
    for r in range(1, 9):
        cut = [64 * i // (bits + r) for i in range(bits + r + 1)]
        blocks = [(1 << b) - (1 << a) for a, b in zip(cut, cut[1:], strict=False)]
        out = [sum(c) for c in combinations(blocks, r)]
        if n <= BUCKET << min(m.bit_count() for m in out) or len(out) > 200:
            break
    return out


def sampled_masks(bits: int, width: int, n: int) -> list[tuple[int, ...]]:
    """Masks of sampled bits for wide fingerprints: few enough chance meetings among n, and enough tables.

    A pair at the full distance agrees on all bits of one mask at least with probability ``RECALL`` (nearer pairs
    with more).
    """
    size = max(14, math.ceil(math.log2(max(n, 2))) + 2)
    meet = math.comb(64 * width - bits, size) / math.comb(64 * width, size)  # bits of a mask differ from one another
    tables = math.ceil(math.log(1 - RECALL) / math.log(1 - meet))
    rng = random.Random(SEED)
    out = []
    for _ in range(tables):
        mask = [0] * width
        for b in rng.sample(range(64 * width), size):
            mask[b // 64] |= 1 << b % 64
        out.append(tuple(mask))
    return out


def pivots(width: int) -> np.ndarray:
    """Reference fingerprints: fixed numbers from XXH64."""
    return np.array([[xxhash.xxh64_intdigest(bytes([i, w]), SEED) for w in range(width)] for i in range(PIVOTS)], np.uint64)


def linked(key: np.ndarray, fp: np.ndarray, bits: int) -> np.ndarray:
    """Smallest place of each row's component; rows of one key are together, links join rows of a key.

    fp: rows x words. Row i is held against row i + d for d = 1, 2, ... while any two have the same key.
    """
    n = len(fp)
    label = np.arange(n)
    table = np.stack([np.bitwise_count(fp ^ p).sum(1, dtype=np.int16) for p in pivots(fp.shape[1])])  # pivots x rows
    run = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
    end = np.repeat(np.r_[run[1:], n], np.diff(np.r_[run, n]))
    at = np.arange(n)
    d = 1
    while True:
        at = at[at + d < end[at]]
        if not len(at):
            return label
        i, j = at, at + d
        differ = label[i] != label[j]
        i, j = i[differ], j[differ]
        for row in table:  # discard by coordinates, one pivot after another
            if not len(i):
                break
            near = np.abs(row[i] - row[j]) <= bits
            i, j = i[near], j[near]
        if len(i):
            true = np.bitwise_count(fp[i] ^ fp[j]).sum(1, dtype=np.int64) <= bits
            i, j = i[true], j[true]
        while len(i):  # hook the larger label on the smaller, then flatten
            a, b = label[i], label[j]
            np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))
            while (label[label] != label).any():
                label = label[label]
            open_ = label[i] != label[j]
            i, j = i[open_], j[open_]
        d += 1


def _forest(batches: Iterator[pa.RecordBatch], bits: int) -> Iterator[pa.RecordBatch]:
    """Links (a, b) that span the components of each bucket; rows (key, node, words) come sorted by key."""

    def spanned(rows: np.ndarray) -> pa.RecordBatch:
        label = linked(rows[:, 0], rows[:, 2:].view(np.uint64), bits)
        by = np.argsort(label, kind="stable")
        same = label[by][1:] == label[by][:-1]
        node = rows[by, 1]
        return pa.RecordBatch.from_arrays([pa.array(node[:-1][same]), pa.array(node[1:][same])], names=["a", "b"])

    held = None
    for batch in batches:
        new = np.stack([c.to_numpy() for c in batch.columns], 1)
        held = new if held is None else np.concatenate([held, new])
        if len(held) >= AT_ONCE:
            cut = int(np.searchsorted(held[:, 0], held[-1, 0]))  # the last bucket may go on
            if cut:
                yield spanned(held[:cut])
                held = held[cut:]
    if held is not None and len(held):
        yield spanned(held)


def links(distinct: DataFrame, bits: int, width: int, n: int) -> DataFrame:
    """a, b: a spanning forest for each bucket of the distinct fingerprints (node and words)."""
    cols = columns(width)
    found = [(m,) for m in masks(bits, n)] if width == 1 else sampled_masks(bits, width, n)
    tables = F.array(*[F.array(F.lit(t).cast("long"), *[F.lit(signed(m)).cast("long") for m in mask]) for t, mask in enumerate(found)])
    keyed = distinct.select("node", *cols, F.explode(tables).alias("x"))
    keyed = keyed.select(F.xxhash64(F.col("x")[0], *[F.col(c).bitwiseAND(F.col("x")[i + 1]) for i, c in enumerate(cols)]).alias("key"), "node", *cols)
    dealt = keyed.repartition("key").sortWithinPartitions("key", "node")
    return dealt.mapInArrow(lambda it: freed(_forest(it, bits)), "a long, b long")


def near_duplicates(docs: DataFrame, shingle: int = 4, bits: int = 4, width: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, the fingerprint's words, component_id (the smallest id reachable through links) for every row.

    With one word (64 bits) every link is found; with more, links at the full distance are found with the
    probability ``RECALL`` and nearer ones with more.
    """
    cols = columns(width)
    rows = staged(fingerprints(docs, shingle, width, id_col, text_col).withColumn("node", F.col("fp") if width == 1 else F.xxhash64(*cols)), "fingerprints")
    classes = staged(rows.groupBy("node", *cols).agg(F.min("doc_id").alias("least")), "fingerprint-classes")
    roots = components(links(classes, bits, width, classes.count()))
    return named(rows, classes, roots).select("doc_id", *cols, "component_id")


def named(rows: DataFrame, classes: DataFrame, roots: DataFrame) -> DataFrame:
    """``rows`` (doc_id, node, ...) with component_id, the least id of the classes (node, least) that have the node's root."""
    roots = roots.withColumnRenamed("node", "_node")
    rooted = classes.join(roots, classes.node == roots._node, "left").select("node", "least", F.coalesce("root", "node").alias("root"))
    least = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    least = rooted.join(least, "root").select("node", "component_id", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("_salt"))
    salted = rows.withColumn("_salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int"))
    return salted.join(least, ["node", "_salt"])


def one_of_each(docs: DataFrame, shingle: int = 5, similarity: float = 0.8) -> DataFrame:
    """The rows of ``docs`` that name their component: one document of each group of near copies.

    Links are the pairs whose sets of shingles have the similarity (shared by all) or more, found and decided
    exactly. Rows without an id stay, and so do rows that repeat the id that is kept; of an id with several texts
    each is judged by its own text.
    """
    rows, roots = near_copies(docs, shingle, similarity)
    classes = staged(rows.groupBy("node").agg(F.min("doc_id").alias("least")), "set-classes")
    found = named(rows, classes, roots)
    dropped = found.where(F.col("doc_id") != F.col("component_id")).select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash")).distinct()
    return docs.join(dropped, (docs["doc_id"] == F.col("_id")) & (F.xxhash64(docs["text"]) == F.col("_hash")), "left_anti")


def simhash_report(docs: DataFrame) -> DataFrame:
    found = near_duplicates(docs, shingle=4, bits=4)
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
