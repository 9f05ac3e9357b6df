"""BPE encoding through a distinct-word table, and decoding through an id-to-piece table.

Encoding: texts are taken in blocks of bounded size and split into words (white space with the run that follows it;
the pattern of byte-level vocabularies splits before white space in any case). A block knows its texts as numbers of
its distinct words. It sends those words to buckets by hash; a bucket is a distinct-word table that encodes each of
its words once with the tokenizers library; the ids go back to the blocks, where they are joined to the words by
position. A frequent word is one entry a block, so no key is hot, and what is shuffled is the word numbers, the words
and their ids, all compressed.

Decoding: ids are joined to the table of pieces (as long as the vocabulary) by position, and the bytes put together.

A block is known by a hash of its rows, and both sides of the join read ``docs``. A table or a staged result gives the
same rows in the same order each time; for anything else say ``stable=False``, which writes the rows first. Blocks that
still differ raise an error.

Defined results: null and empty texts have no ids and decode to the empty text; special tokens in a text are the
special ids; repeated rows are encoded alike; a text longer than a block is a block of its own; an empty table
gives no rows; null ids stay null; other columns are ignored. A vocabulary whose normalizer, pre-tokenizer or special
tokens do not allow the cuts takes each text as one word.
"""

from __future__ import annotations

import json
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillon.llm.common import staged
from quillon.llm.textbatch import byte_strings, flat_bytes, freed, release, slices, spread

BLOCK_BYTES = 8 << 20
AT_ONCE, TEXT_BYTES = 1 << 14, 1 << 13  # words given to the tokenizer at once, in texts of about so many bytes
IDS_AT_ONCE = 1 << 22
PRIME = np.uint64(0x100000001B3)


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def load_tokenizer(path: str):
    """The file's tokenizer without truncation and padding; a worker loads it once for all its tasks."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    import tokenizers

    loaded = tokenizers.__dict__.setdefault("_files_loaded", {})  # functions come to workers by value, without this module
    if path not in loaded:
        t = loaded[path] = tokenizers.Tokenizer.from_file(path)
        t.no_truncation()
        t.no_padding()
    return loaded[path]


def cuttable(path: str) -> bool:
    """Whether texts may be cut before white space: plain byte-level BPE, special tokens without white space."""
    with open(path, encoding="utf-8") as f:
        told = json.load(f)
    split = told.get("pre_tokenizer") or {}
    plain = split.get("type") == "ByteLevel" and split.get("use_regex", True) and not split.get("add_prefix_space") and told.get("normalizer") is None
    odd = any(x["lstrip"] or x["rstrip"] or x["single_word"] or x["content"] != "".join(x["content"].split()) for x in told.get("added_tokens") or [])
    return bool(plain and not odd and not told["model"].get("dropout"))


def spaces(raw: np.ndarray) -> np.ndarray:
    return (raw == 32) | (raw - np.uint8(9) <= 4)


def word_starts(raw: np.ndarray, offsets: np.ndarray, cut: bool = True) -> np.ndarray:
    """Where words begin: at each text, and at ASCII white space after a character that is none in any engine."""
    begins = np.zeros(len(raw), bool)
    begins[offsets[:-1][np.diff(offsets) > 0]] = True
    if cut and len(raw):
        space = spaces(raw)
        at = np.flatnonzero(space[1:] & ~space[:-1]) + 1
        begins[at[certain(raw, at)]] = True
    return np.flatnonzero(begins)


def certain(raw: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Whether the characters that end before ``at``, no ASCII white space, are no other white space either."""
    one = raw[at - 1]
    odd = (one >= 0x1C) & (one <= 0x1F)
    far = np.flatnonzero(one >= 0x80)  # the last byte of a longer character, which may be white space
    if len(far):
        own = at[far]
        two, three, one = raw[np.maximum(own - 2, 0)], raw[np.maximum(own - 3, 0)], one[far]
        wide = (three == 0xE2) & (((two == 0x80) & ((one <= 0x8A) | (one == 0xA8) | (one == 0xA9) | (one == 0xAF))) | ((two == 0x81) & (one == 0x9F)))
        wide |= (three == 0xE1) & (((two == 0x9A) & (one == 0x80)) | ((two == 0xA0) & (one == 0x8E))) | (three == 0xE3) & (two == 0x80) & (one == 0x80)
        odd[far] = wide | (two == 0xC2) & ((one == 0x85) | (one == 0xA0))
    return ~odd


def words(text: str, cut: bool = True) -> list[str]:
    """The words of one text; joined they are the text."""
    raw, offsets = flat_bytes(pa.array([text]))
    starts = word_starts(raw, offsets, cut)
    return byte_strings(raw, np.append(starts, len(raw))).cast(pa.large_string()).to_pylist()


def hashed(words: pa.Array) -> np.ndarray:
    """A hash of each word; no word is empty."""
    raw, offsets = flat_bytes(words)
    size = np.diff(offsets)
    with np.errstate(over="ignore"):
        powers = np.cumprod(np.full(int(size.max(initial=1)), PRIME))
        place = np.arange(len(raw)) - np.repeat(offsets[:-1], size)
        h = np.add.reduceat((raw.astype(np.uint64) + np.uint64(1)) * powers[place], offsets[:-1]) if len(size) else np.zeros(0, np.uint64)
        h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


def packed(*numbers: np.ndarray) -> bytes:
    """32-bit numbers, their bytes by place, compressed."""
    return zstandard.compress(b"".join(np.array([len(x)], "<i8").tobytes() + np.ascontiguousarray(x.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes() for x in numbers), 3)


def unpacked(blob: bytes) -> list[np.ndarray]:
    raw, at, out = zstandard.decompress(blob), 0, []
    while at < len(raw):
        n = int(np.frombuffer(raw, "<i8", 1, at)[0])
        out.append(np.ascontiguousarray(np.frombuffer(raw, np.uint8, 4 * n, at + 8).reshape(4, n).T).view("<u4").reshape(-1).astype(np.int64))
        at += 8 + 4 * n
    return out


class Block:
    """A piece of the table: its number, its distinct words by falling frequency, their buckets, its texts in word numbers."""

    def __init__(self, piece: pa.RecordBatch, buckets: int, cut: bool):
        raw, offsets = flat_bytes(piece.column("text"))
        h = xxhash.xxh64(raw)
        h.update(offsets.tobytes())
        h.update(str(piece.column("doc_id").to_pylist()).encode())
        self.number = h.intdigest() - (1 << 63)
        starts = word_starts(raw, offsets, cut)
        coded = byte_strings(raw, np.append(starts, len(raw))).dictionary_encode()
        codes = coded.indices.to_numpy(zero_copy_only=False)
        by = np.argsort(-np.bincount(codes, minlength=len(coded.dictionary)), kind="stable")
        rank = np.empty(len(by), np.int64)
        rank[by] = np.arange(len(by))
        self.words, self.codes = coded.dictionary.take(pa.array(by)), rank[codes]
        self.sizes = np.diff(np.searchsorted(starts, offsets))
        self.bucket = (hashed(self.words) % np.uint64(buckets)).astype(np.int64)


def _blocks(batches: Iterator[pa.RecordBatch], buckets: int, cut: bool) -> Iterator[tuple[pa.RecordBatch, Block]]:
    for piece in slices(batches, "text", BLOCK_BYTES):
        yield piece, Block(piece, buckets, cut)


def _word_lists(batches: Iterator[pa.RecordBatch], buckets: int, cut: bool) -> Iterator[pa.RecordBatch]:
    """The distinct words of each block by bucket."""
    for _, block in _blocks(batches, buckets, cut):
        by = np.argsort(block.bucket, kind="stable")
        raw, offsets = flat_bytes(block.words.take(pa.array(by)))
        found, first = np.unique(block.bucket[by], return_index=True)
        if not len(found):
            continue
        ends = np.append(first[1:], len(by))
        lists = [packed(np.diff(offsets[a : b + 1])) for a, b in zip(first, ends, strict=True)]
        texts = [zstandard.compress(raw[offsets[a] : offsets[b]].tobytes(), 3) for a, b in zip(first, ends, strict=True)]
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.full(len(found), block.number)), pa.array(found.astype(np.int32)), pa.array(lists, pa.binary()), pa.array(texts, pa.binary())], names=["block", "bucket", "sizes", "words"]
        )


def _numbered(batches: Iterator[pa.RecordBatch], buckets: int, cut: bool) -> Iterator[pa.RecordBatch]:
    """Each block's ids of documents, sizes of texts, word numbers, and the bucket of each word."""
    for piece, block in _blocks(batches, buckets, cut):
        ids = pa.array([piece.column("doc_id").to_pylist()], pa.list_(pa.int64()))
        yield pa.RecordBatch.from_arrays(
            [pa.array([block.number]), ids, pa.array([packed(block.sizes, block.codes, block.bucket)], pa.binary())], names=["block", "doc_ids", "codes"]
        )


def encoded_each(tokenizer, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The ids of all words, and how many each has; every word is a text of its own."""
    ids, size = [], []
    for a in range(0, len(words), AT_ONCE):
        for e in tokenizer.encode_batch_fast(words.slice(a, AT_ONCE).cast(pa.large_string()).to_pylist(), add_special_tokens=False):
            own = e.ids
            size.append(len(own))
            ids += own
    return np.array(ids, np.int64), np.array(size, np.int64)


def encoded(tokenizer, words: pa.Array, widths: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """The ids of all words, and how many each has.

    With the byte lengths of the pieces (``widths``), words that begin with white space and end with none are put
    together to texts, which the tokenizer cuts where they join; the lengths tell whose the ids are.
    """
    if widths is None or not len(words):
        return encoded_each(tokenizer, words)
    raw, offsets = flat_bytes(words)
    space = spaces(raw)
    joins = space[offsets[:-1]] & ~space[offsets[1:] - 1] & certain(raw, offsets[1:])
    out = [(np.flatnonzero(~joins), *encoded_each(tokenizer, words.filter(pa.array(~joins))))]
    at = np.flatnonzero(joins)
    for a in range(0, len(at), AT_ONCE):
        own = at[a : a + AT_ONCE]
        part, ends = flat_bytes(words.take(pa.array(own)))
        cuts = np.searchsorted(ends, np.arange(0, ends[-1], TEXT_BYTES))
        texts = [part[x:y].tobytes().decode() for x, y in zip(ends[cuts], [*ends[cuts[1:]], ends[-1]], strict=True) if y > x]
        ids = np.concatenate([np.array(e.ids, np.int64) for e in tokenizer.encode_batch_fast(texts, add_special_tokens=False)])
        last = np.searchsorted(np.cumsum(widths[ids]), ends[1:])
        out.append((own, ids, np.diff(last + 1, prepend=0)))
    where, ids, size = (np.concatenate(x) for x in zip(*out, strict=True))
    first, by = np.cumsum(size) - size, np.argsort(where)
    return ids[spread(first[by], size[by])], size[by]


def _encoded_lists(batches: Iterator[pa.RecordBatch], path: str, widths: np.ndarray | None) -> Iterator[pa.RecordBatch]:
    """The ids of each list's words. The task's table has each distinct word once; it is a bucket's share of the words."""
    tokenizer = load_tokenizer(path)
    known = pa.array([], pa.large_binary())
    ids, size = np.zeros(0, np.int64), np.zeros(0, np.int64)
    for batch in batches:
        sizes = [unpacked(x)[0] for x in batch.column("sizes").to_pylist()]
        raw = np.frombuffer(b"".join(map(zstandard.decompress, batch.column("words").to_pylist())), np.uint8)
        new = byte_strings(raw, np.append(0, np.cumsum(np.concatenate(sizes)))) if sizes else known
        coded = pa.concat_arrays([known, new]).dictionary_encode()  # known words come first and keep their numbers
        fresh = encoded(tokenizer, coded.dictionary.slice(len(known)), widths)
        ids, size, codes = np.append(ids, fresh[0]), np.append(size, fresh[1]), coded.indices.to_numpy(zero_copy_only=False)[len(known) :]
        known = coded.dictionary
        first, out, at = np.cumsum(size) - size, [], 0
        for n in map(len, sizes):
            own = codes[at : at + n]
            out.append(packed(size[own], ids[spread(first[own], size[own])]))
            at += n
        yield pa.RecordBatch.from_arrays([batch.column("block"), batch.column("bucket"), pa.array(out, pa.binary())], names=["block", "bucket", "ids"])


def _joined(blocks: pa.Table, lists: pa.Table) -> pa.Table:
    """doc_id and ids of a block's texts: the ids of its words, at the words' places."""
    if not blocks.num_rows:
        raise RuntimeError("encode read other rows the second time; use stable=False")
    sent = dict(zip(lists.column("bucket").to_pylist(), lists.column("ids").to_pylist(), strict=True))
    doc_ids, flat, sizes = [], [], []
    for own, blob in zip(blocks.column("doc_ids").to_pylist(), blocks.column("codes").to_pylist(), strict=True):
        words, codes, bucket = unpacked(blob)
        if not sent.keys() >= set(np.unique(bucket).tolist()):
            raise RuntimeError("encode read other rows the second time; use stable=False")
        parts = [unpacked(sent[k]) for k in np.unique(bucket).tolist()]
        size, first = np.zeros(len(bucket), np.int64), np.zeros(len(bucket), np.int64)
        if parts:
            by = np.argsort(bucket, kind="stable")
            size[by] = np.concatenate([p[0] for p in parts])
            first[by] = np.cumsum(size[by]) - size[by]
            ids = np.concatenate([p[1] for p in parts]).astype(np.int32)
            flat.append(ids[spread(first[codes], size[codes])])
        doc_ids += own
        sizes.append(np.diff(np.append(0, np.cumsum(size[codes]))[np.append(0, np.cumsum(words))]))
    offsets = np.append(0, np.cumsum(np.concatenate(sizes)))
    ids = pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(np.concatenate(flat) if flat else np.zeros(0, np.int32)))
    release()
    return pa.table([pa.array(doc_ids, pa.int64()), ids], names=["doc_id", "ids"])


def encode(docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text", stable: bool = True) -> DataFrame:
    """doc_id, ids (array of int) of every row's text."""
    path = path or default_path()
    cut = cuttable(path)
    widths = np.diff(flat_bytes(pieces(path))[1]).astype(np.int32) if cut else None
    buckets = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].alias("text"))
    if not stable:
        rows = staged(rows, "texts")
    lists = rows.mapInArrow(lambda it: freed(_word_lists(it, buckets, cut)), "block long, bucket int, sizes binary, words binary")
    table = lists.repartitionById(buckets, "bucket").mapInArrow(lambda it: freed(_encoded_lists(it, path, widths)), "block long, bucket int, ids binary")
    blocks = rows.mapInArrow(lambda it: freed(_numbered(it, buckets, cut)), "block long, doc_ids array<long>, codes binary")
    return blocks.groupBy("block").cogroup(table.groupBy("block")).applyInArrow(_joined, "doc_id long, ids array<int>")


def pieces(path: str) -> pa.Array:
    """The bytes of each id of a byte-level vocabulary."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]  # bytes that stand for themselves; the rest follow from 256 on
    byte = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in set(plain))}
    t = load_tokenizer(path)
    tokens = [t.id_to_token(i) or "" for i in range(t.get_vocab_size())]
    return pa.array([bytes(byte[c] for c in x) if all(c in byte for c in x) else x.encode() for x in tokens], pa.binary())


def _texts(ids: pa.ListArray, table: pa.Array) -> pa.Array:
    """The text of each list of ids; bytes that are no UTF-8 become replacement characters."""
    offsets = ids.offsets.to_numpy().astype(np.int64)
    taken = table.take(ids.values.slice(offsets[0], offsets[-1] - offsets[0]))
    raw, ends = flat_bytes(taken)
    whole = byte_strings(raw, ends[offsets - offsets[0]])
    try:
        return whole.cast(pa.large_string())
    except pa.ArrowInvalid:
        return pa.array([x.decode("utf-8", "replace") for x in whole.to_pylist()], pa.large_string())


def _decoded(batches: Iterator[pa.RecordBatch], table: pa.Array) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids = pc.fill_null(batch.column("ids"), [])
        at = ids.offsets.to_numpy().astype(np.int64)
        cuts = [0, *(np.flatnonzero(np.diff((at[1:] - at[0]) // IDS_AT_ONCE)) + 1).tolist(), len(ids)]
        texts = [_texts(ids.slice(a, b - a), table) for a, b in zip(cuts, cuts[1:], strict=False) if b > a]
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.concat_arrays([x.cast(pa.string()) for x in texts])], names=[*batch.schema.names, "decoded"])


def decode(coded: DataFrame, path: str | None = None) -> DataFrame:
    """``coded`` (with ids, an array of int) and ``decoded``, their text; a null array decodes to the empty text."""
    table = pieces(path or default_path())
    return coded.mapInArrow(lambda it: freed(_decoded(it, table)), T.StructType([*coded.schema.fields, T.StructField("decoded", T.StringType())]))


def bpe_report(docs: DataFrame, path: str | None = None) -> DataFrame:
    both = decode(encode(docs, path), path)
    return both.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
