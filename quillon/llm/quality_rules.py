"""Repetition rules from a suffix array over words.

The suffix array of a text's words is built by prefix doubling (batches of texts at once; suffixes of different
texts never compare equal). The longest common prefixes of neighbouring suffixes give, for each suffix, the
deepest LCP interval that holds it, that is the longest repeated run of words that starts there. The union of
these spans is the union of all maximal repeats; rules limit the covered share and the longest repeat.

Defined results: null and empty texts have zero counts and fail the base rule on words; repeated rows are judged
alike; texts of any length are judged whole; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from quillon.llm.textbatch import as_bytes, coded_words, freed, slices

SPACE = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"  # fixed value
SCHEMA = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, longest_repeat long"


def suffix_ranks(tokens: np.ndarray, docs: np.ndarray) -> tuple[np.ndarray, list[np.ndarray], np.ndarray]:
    """Suffix array of concatenated texts, the ranks by prefixes of 1, 2, 4, ... words, and the array's end offsets.

    ``tokens``: a number for each word; ``docs``: its text, ascending. A suffix ends with its text.
    """
    n = len(tokens)
    _, rank = np.unique(docs * (int(tokens.max(initial=0)) + 1) + tokens, return_inverse=True)
    rank = rank.astype(np.int64)
    ends = np.searchsorted(docs, docs, side="right")
    levels, k = [rank], 1
    order = np.argsort(rank, kind="stable")
    while True:
        sorted_rank = rank[order]
        same = np.r_[False, sorted_rank[1:] == sorted_rank[:-1], False]
        places = np.flatnonzero(same[1:] | same[:-1])  # only suffixes that are not yet told apart are sorted again
        if not len(places):
            break
        group = order[places]
        at = group + k
        after = np.where(at < ends[group], rank[np.minimum(at, n - 1)] + 1, 0)
        key = rank[group] * (n + 1) + after
        by = np.argsort(key, kind="stable")
        key, group = key[by], group[by]
        order[places] = group
        # the rank of a group is the place of its first member; the order of all other ranks stays as it was
        if len(levels) == 1:
            rank = np.empty(n, np.int64)
            rank[order] = np.maximum.accumulate(np.where(np.r_[True, sorted_rank[1:] != sorted_rank[:-1]], np.arange(n), 0))
        else:
            rank = rank.copy()
        first = np.r_[True, key[1:] != key[:-1]]
        rank[group] = places[np.maximum.accumulate(np.where(first, np.arange(len(places)), 0))]
        levels.append(rank)
        k *= 2
    return order, levels, ends


def repeats(tokens: np.ndarray, docs: np.ndarray, least: int) -> np.ndarray:
    """For each word, the length of the longest run of words that starts there and occurs elsewhere in its text.

    Runs of fewer than the greatest power of two up to ``least`` count as none.
    """
    n = len(tokens)
    out = np.zeros(n, np.int64)
    if not n:
        return out
    order, levels, ends = suffix_ranks(tokens, docs)
    low = least.bit_length() - 1
    if low >= len(levels):
        return out
    # neighbours in the suffix array that share the first 2**low words
    rank = levels[low]
    places = np.flatnonzero(rank[order[1:]] == rank[order[:-1]])
    first, second = order[places], order[places + 1]
    inside = np.maximum(first, second) + (1 << low) <= ends[first]
    first, second = first[inside], second[inside]
    lcp = np.zeros(len(first), np.int64)
    for level in range(len(levels) - 1, -1, -1):  # the rest by descending powers of two
        step, rank = 1 << level, levels[level]
        a, b = first + lcp, second + lcp
        fits = np.maximum(a, b) + step <= ends[first]
        fits &= rank[np.minimum(a, n - 1)] == rank[np.minimum(b, n - 1)]
        lcp[fits] += step
    np.maximum.at(out, first, lcp)
    np.maximum.at(out, second, lcp)
    return out


def covered(length: np.ndarray, least: int) -> np.ndarray:
    """True for words inside a span [i, i + length[i]) with length[i] >= least."""
    n = len(length)
    edge = np.zeros(n + 1, np.int64)
    at = np.flatnonzero(length >= least)
    np.add.at(edge, at, 1)
    np.add.at(edge, at + length[at], -1)
    return np.cumsum(edge[:-1]) > 0


def judge(batches: Iterator[pa.RecordBatch], window: int, most_covered: float, most_longest: float) -> Iterator[pa.RecordBatch]:
    for piece in slices(batches):
        raw = as_bytes(piece.column(1))
        texts = [x.decode("utf-8", "replace") for x in raw]
        tokens, _, n_words = coded_words(piece.column(1))
        docs = np.repeat(np.arange(len(raw)), n_words)
        length = repeats(tokens, docs, window)
        inside = covered(length, window)
        n_repeat = np.bincount(docs, weights=inside, minlength=len(raw)).astype(np.int64)
        longest = np.zeros(len(raw), np.int64)
        np.maximum.at(longest, docs, length)
        word_chars = np.array([len(t) - sum(map(t.count, SPACE)) for t in texts], np.int64)
        symbols = np.array([sum(map(t.count, SYMBOLS)) for t in texts], np.int64)
        dup = np.empty(len(raw), np.int64)
        for i, x in enumerate(raw):
            lines = [y for y in x.split(b"\n") if y and not y.isspace()]
            dup[i] = len(lines) - len(set(lines))
        failed = (n_words < 20) | (100 * n_repeat > 30 * n_words)
        long_repeat = (longest >= 50) & (longest > most_longest * n_words)
        kept = ~failed & ~(n_repeat > most_covered * n_words) & ~long_repeat
        yield pa.RecordBatch.from_arrays(
            [piece.column(0).cast(pa.int64()), *map(pa.array, (n_words, word_chars, symbols, dup, n_repeat, failed, kept, longest))],
            names=["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "longest_repeat"],
        )


def quality_rules(docs: DataFrame, window: int = 8, most_covered: float = 0.12, most_longest: float = 0.05, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Counts and verdicts per document.

    A document is kept if the base rules pass, maximal repeats of ``window`` or more words cover at most
    ``most_covered`` of its words, and no repeat of 50 or more words is longer than ``most_longest`` of its words.
    Both limits are stricter than the base rule, which allows repeats over 0.3 of the words.
    """
    return docs.select(docs[id_col], docs[text_col]).mapInArrow(lambda it: freed(judge(it, window, most_covered, most_longest)), SCHEMA)
