"""Exact groups of near copies: texts whose sets of word shingles have a similarity (shared by all) at or above a limit.

Candidates lose no pair. A set's shingle hashes are put in order, as a ring; its grams are ``GRAM`` hashes that follow
one another. A hash that only this set has breaks ``GRAM`` of its grams, one that only the other set has breaks
``GRAM - 1``. With n hashes and similarity t at most ``broken`` = (1 - t) * n * max(GRAM, (GRAM - 1) / t) of the n
grams break, so each of two near copies has one of the grams in common among its ``broken + 1`` least ones. Sets that
share such a gram are chained, never paired. A component of the chains meets in one task or, if it has more than
``BLOCK`` hashes, is cut into blocks of which any two meet in one task (so a task's memory is bounded, and a component of k
blocks is sent k - 1 times). A task finds the pairs at or above the limit by prefix filtering on the component's rarest hashes, tables of Hamming distances from SimHash
fingerprints to pivots (pairs whose greatest coordinate difference exceeds the bound go, as do pairs beyond it), and exact
counts of what survives, and joins their groups; sets already in a group of that task are not held against one another. The bound on
the fingerprints lies eight standard deviations beyond the distance of the least similar near copies, so that what it
loses (below one pair in 10**14) is left out of account.

Defined results: words are split at ASCII white space and A-Z are folded; a text of fewer words than a shingle is one
shingle; null and empty texts have the empty set and are copies of one another; equal sets are copies; texts of any
length are taken whole; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.llm.common import discard, staged
from quillon.llm.graph import components
from quillon.llm.textbatch import as_bytes, freed, slices, spread

SEED, GRAM = 42, 3
WIDTH, PIVOTS = 4, 16  # words of a fingerprint, reference fingerprints of a component
BLOCK = 1 << 20  # hashes of sets in a block of a component
MIX = np.uint64(0xBF58476D1CE4E5B9)


def shingle_set(text: bytes, shingle: int) -> np.ndarray:
    """The distinct XXH64 of the text's word shingles, ascending."""
    words = text.lower().split()
    if not words:
        return np.zeros(0, np.int64)
    joined, size = b" ".join(words), np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(size + 1) - 1
    k = min(shingle, len(words))
    first, last = (ends - size)[: len(words) - k + 1].tolist(), ends[k - 1 :].tolist()
    digest = xxhash.xxh64_intdigest
    found = np.fromiter((digest(joined[x:y], SEED) for x, y in zip(first, last, strict=True)), np.uint64, len(first))
    return np.unique(found.view(np.int64))


def _sets(batches: Iterator[pa.RecordBatch], shingle: int) -> Iterator[pa.RecordBatch]:
    for piece in slices(batches):
        found = [shingle_set(x, shingle) for x in as_bytes(piece.column(1))]
        node = np.array([xxhash.xxh64_intdigest(s.tobytes(), SEED) for s in found], np.uint64).view(np.int64)
        offsets = np.cumsum([0, *map(len, found)]).astype(np.int32)
        sets = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(found)))
        yield pa.RecordBatch.from_arrays([piece.column(0).cast(pa.int64()), piece.column(2), pa.array(node), pa.array(np.diff(offsets).astype(np.int64)), sets], names=["doc_id", "text_hash", "node", "size", "shingles"])


def flat(column: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
    """All values of a list column, and where each list begins (and the last ends)."""
    offsets = column.offsets.to_numpy().astype(np.int64)
    return column.values.to_numpy()[offsets[0] : offsets[-1]], offsets - offsets[0]


def broken(n: int, least: Fraction) -> int:
    """Most grams of a set of n that a near copy's set lacks."""
    return int((1 - least) * n * max(Fraction(GRAM), (GRAM - 1) / least))


def signatures(values: np.ndarray, offsets: np.ndarray, least: Fraction) -> list[np.ndarray]:
    """For each set, its ``broken + 1`` least grams."""
    size = np.diff(offsets)
    start = np.repeat(offsets[:-1], size)
    n = np.repeat(size, size)
    place = np.arange(len(values)) - start
    v = values.view(np.uint64)
    h = v.copy()
    with np.errstate(over="ignore"):
        for d in range(1, GRAM):
            h = (h ^ (h >> np.uint64(29))) * MIX + v[start + (place + d) % n]
        h = (h ^ (h >> np.uint64(29))) * MIX
        h ^= h >> np.uint64(32)
    out = []
    for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
        most = broken(b - a, least) + 1
        out.append(np.partition(h[a:b], most - 1)[:most] if most < b - a else h[a:b])
    return out


def _signatures(batches: Iterator[pa.RecordBatch], least: Fraction) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for a in range(0, batch.num_rows, 1024):
            piece = batch.slice(a, 1024)
            found = signatures(*flat(piece.column("shingles")), least)
            node = np.repeat(piece.column("node").to_numpy(), [len(x) for x in found])
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(found).view(np.int64)), pa.array(node)], names=["gram", "node"])


def _chains(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links (a, b) of neighbours with one gram; rows (gram, node) come sorted."""
    last = np.zeros((2, 0), np.int64)
    for batch in batches:
        gram, node = (np.r_[x, c.to_numpy()] for x, c in zip(last, batch.columns, strict=True))
        last = np.stack([gram[-1:], node[-1:]])
        same = (gram[1:] == gram[:-1]) & (node[1:] != node[:-1])
        links = np.unique(np.stack([node[:-1][same], node[1:][same]], 1), axis=0)
        yield pa.RecordBatch.from_arrays([pa.array(links[:, 0]), pa.array(links[:, 1])], names=["a", "b"])


def wide_fingerprints(values: np.ndarray, offsets: np.ndarray, at_once: int = 1 << 16) -> np.ndarray:
    """sets x words: majority bits of the hashes of each set, and of numbers mixed from them."""
    size = np.diff(offsets)
    total = np.zeros((len(size), 64 * WIDTH), np.int32)
    for a in range(0, len(values), at_once):
        h = values[a : a + at_once].view(np.uint64)
        own = np.searchsorted(offsets, np.arange(a, a + len(h)), side="right") - 1
        first = np.flatnonzero(np.r_[True, own[1:] != own[:-1]])
        for w in range(WIDTH):
            with np.errstate(over="ignore"):
                h = (h ^ (h >> np.uint64(31))) * MIX if w else h
            bits = np.unpackbits(np.ascontiguousarray(h).view(np.uint8).reshape(-1, 8), axis=1)
            total[own[first], 64 * w : 64 * w + 64] += np.add.reduceat(bits, first, axis=0, dtype=np.int32)
    return np.packbits(2 * total > size[:, None], axis=1).view(np.uint64)


def most_bits(least: Fraction) -> int:
    """Differing bits of the fingerprints of two sets at the similarity ``least``, and eight standard deviations.

    The angle between the sets' indicators gives the share of differing bits; sets of few hashes differ by at most
    0.05 more.
    """
    share = float(np.arccos(float(2 * least / (1 + least))) / np.pi) + 0.05
    return int(64 * WIDTH * share + 8 * (64 * WIDTH * share * (1 - share)) ** 0.5)


def grouped(values: np.ndarray, offsets: np.ndarray, least: Fraction) -> np.ndarray:
    """For each of these sets, the place of the first one that it is joined with by pairs at or above ``least``."""
    p, q = least.numerator, least.denominator
    size = np.diff(offsets)
    count = len(size)
    owner = np.repeat(np.arange(count), size)
    _, code, often = np.unique(values, return_inverse=True, return_counts=True)
    rank = np.empty(len(often), np.int64)
    rank[np.argsort(often, kind="stable")] = np.arange(len(often))
    code = rank[code]
    code = code[np.lexsort((code, owner))]  # the rarest first in each set
    prefix = size - -(-p * size // q) + 1  # one of these is shared with any near copy
    inside = np.arange(len(code)) - offsets[:-1][owner] < prefix[owner]
    by = np.argsort(code[inside], kind="stable")
    post_code, post = code[inside][by], owner[inside][by]
    first = np.searchsorted(post_code, np.arange(len(often) + 1))
    label = np.full(count, -1)
    mark = np.zeros(len(often), bool)
    left = listed = count
    fp, bits = wide_fingerprints(values, offsets), most_bits(least)
    pivots = fp[np.linspace(0, count - 1, min(PIVOTS, count)).astype(np.int64)]
    table = np.stack([np.bitwise_count(fp ^ p).sum(1, dtype=np.int16) for p in pivots])
    for seed in range(count):
        if label[seed] >= 0:
            continue
        label[seed] = seed
        left -= 1
        todo = [seed]
        while todo and left:
            m = todo.pop()
            own = code[offsets[m] : offsets[m + 1]]
            a = first[own[: prefix[m]]]
            n = first[own[: prefix[m]] + 1] - a
            near = post[spread(a, n)]
            near = np.unique(near[label[near] < 0])
            near = near[(q * size[near] >= p * size[m]) & (p * size[near] <= q * size[m])]
            for row in table:  # discard by coordinates, one pivot after another
                near = near[np.abs(row[near] - row[m]) <= bits]
            near = near[np.bitwise_count(fp[near] ^ fp[m]).sum(1, dtype=np.int16) <= bits]
            if not len(near):
                continue
            n = size[near]
            ends = np.cumsum(n)
            mark[own] = True
            shared = np.add.reduceat(mark[code[spread(offsets[near], n)]], ends - n, dtype=np.int64)
            mark[own] = False
            near = near[(p + q) * shared >= p * (n + size[m])]
            label[near] = seed
            todo += near.tolist()
            left -= len(near)
            if 2 * left < listed:  # lists without the sets that have a group
                open_ = label[post] < 0
                post_code, post, listed = post_code[open_], post[open_], left
                first = np.searchsorted(post_code, np.arange(len(often) + 1))
    return label


def _groups(batches: Iterator[pa.RecordBatch], least: Fraction) -> Iterator[pa.RecordBatch]:
    """Links (node, root) from the sets that meet; rows (node, shingles, piece) come sorted by piece."""

    def ended(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        node = np.concatenate([b.column(0).to_numpy() for b in held])
        sets = pa.concat_arrays([b.column(1) for b in held])
        node, at = np.unique(node, return_index=True)  # batches may repeat the set they end with
        label = grouped(*flat(sets.take(pa.array(at))), least)
        own = label != np.arange(len(node))
        return pa.RecordBatch.from_arrays([pa.array(node[own]), pa.array(node[label[own]])], names=["node", "root"])

    held: list[pa.RecordBatch] = []
    for batch in batches:
        node = batch.column(0).to_numpy()
        piece = batch.column(2).to_numpy()
        batch = batch.take(pa.array(np.flatnonzero(np.r_[True, (node[1:] != node[:-1]) | (piece[1:] != piece[:-1])])))  # equal sets of many rows once
        piece = batch.column(2).to_numpy()
        cuts = [0, *(np.flatnonzero(np.diff(piece)) + 1).tolist(), len(piece)]
        for a, b in zip(cuts, cuts[1:], strict=False):
            if b > a:
                if held and held[-1].column(2)[0] != batch.column(2)[a]:
                    yield ended(held)
                    held = []
                held.append(batch.slice(a, b - a))
    if held:
        yield ended(held)


def near_copies(docs: DataFrame, shingle: int, similarity: float, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """Two tables: doc_id, text_hash and node (the text's set) for every row; node and root for every set that joins another's group."""
    least = Fraction(str(similarity))
    if not Fraction(GRAM - 1, GRAM) < least <= 1:
        raise ValueError(f"similarity {similarity}: grams of {GRAM} find all pairs only above {GRAM - 1}/{GRAM}")
    texts = docs.select(docs[id_col].alias("doc_id"), docs[text_col].alias("text"), F.xxhash64(docs[text_col]).alias("text_hash"))  # read three times: sets take more room than texts
    rows = staged(texts.mapInArrow(lambda it: freed(b.select(["doc_id", "text_hash", "node", "size"]) for b in _sets(it, shingle)), "doc_id long, text_hash long, node long, size long"), "set-nodes")
    grams = texts.mapInArrow(lambda it: freed(_signatures(_sets(it, shingle), least)), "gram long, node long").repartition("gram").sortWithinPartitions("gram", "node")
    chained = blocked(components(grams.mapInArrow(lambda it: freed(_chains(it)), "a long, b long")), rows)
    sets = texts.mapInArrow(lambda it: freed(b.select(["node", "shingles"]) for b in _sets(it, shingle)), "node long, shingles array<long>")
    met = sets.join(chained.hint("shuffle_hash"), "node").select("node", "shingles", F.explode("pieces").alias("piece"))
    met = met.repartition("piece").sortWithinPartitions("piece", "node")
    links = staged(met.mapInArrow(lambda it: freed(_groups(it, least)), "node long, root long"), "near-copies")
    if not chained.where(F.size("pieces") > 1).isEmpty():  # groups of several tasks are to be joined
        links = components(links.withColumnsRenamed({"node": "a", "root": "b"}))
    return rows.drop("size"), links


def blocked(chained: DataFrame, rows: DataFrame) -> DataFrame:
    """node and the pieces of its component in which it meets others: one, or one for each other block of the component."""
    size = rows.groupBy("node").agg(F.max("size").alias("size"))
    chained = staged(chained.join(size, "node"), "chains")
    large = chained.groupBy("root").agg(F.ceil(F.sum("size") / BLOCK).alias("blocks")).where(F.col("blocks") > 2)
    block, other = F.pmod(F.xxhash64("node"), F.col("blocks")), F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)
    pieces = F.transform(F.filter(other, lambda x: x != block), lambda x: F.xxhash64("root", F.least(x, block), F.greatest(x, block)))
    out = staged(chained.join(large, "root", "left").select("node", F.when(F.col("blocks").isNull(), F.array("root")).otherwise(pieces).alias("pieces")), "set-pieces")
    discard(chained)
    return out
