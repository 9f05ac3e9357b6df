"""URL verdicts: host and path rules first, then gradient-boosted trees on lexical features.

The trees (logistic loss, histogram splits, numpy) are learnt from labelled URLs, at most ``SAMPLE`` of them by
the hash of their text. Suffix statistics (how many URLs, and which share of the labelled ones is blocked, for the
last labels of the host) are counted over all rows, in a fixed number of buckets. A URL that is learnt from sees the share
among the labelled URLs of the other folds, so that its own label never is one of its features.

Defined results: null URLs and URLs without ``://`` have an empty host and path; without labelled URLs of both
verdicts the method's verdict is ``allow`` unless all labels say ``block``; repeated rows are judged alike; an
empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.llm.common import ascii_lower

RULES = (("block", "com/en/"), ("allow", "example.com/en/7"), ("allow", "net/de/"), ("block", "example.net/de/8"), ("block", "org/es/"))  # fixed values
SAMPLE, TREES, DEPTH, RATE, BINS, LEAF, PENALTY = 20_000, 40, 4, 0.2, 32, 8, 1.0
SUFFIXES, FOLDS = 4096, 5


def host_and_path(url: Column) -> tuple[Column, Column]:
    rest = F.when(url.contains("://"), F.regexp_extract(url, r"(?s)^.*?://(.*)$", 1))
    host = F.coalesce(ascii_lower(F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1)), F.lit(""))
    path = F.coalesce(F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1), F.lit(""))
    return host, path


def rule_of(host: Column, path: Column, rules) -> Column:
    """(verdict, rule) of the longest rule that fits; null without one."""
    out = None
    for verdict, rule in sorted(rules, key=lambda r: (-len(r[1]), r[1])):
        at, _, start = rule.partition("/")
        fits = ((host == at) | host.endswith("." + at)) & path.startswith("/" + start)
        out = (out.when if out is not None else F.when)(fits, F.struct(F.lit(verdict).alias("verdict"), F.lit(rule).alias("rule")))
    return out if out is not None else F.lit(None).cast("struct<verdict:string,rule:string>")


def entropy(text: str) -> float:
    return -sum(c / len(text) * math.log2(c / len(text)) for c in Counter(text).values()) if text else 0.0


def features(url: str | None, host: str, path: str) -> list[float]:
    """Lexical features: lengths, depth, ratios, entropy, parameter counts."""
    url = url or ""
    query = url.partition("#")[0].partition("?")[2]
    n = max(len(url), 1)
    labels = host.split(".")
    return [
        len(url), len(host), len(path), len(query), host.count("."), path.count("/"), len(labels[-1]), len(max(labels, key=len)),
        sum(map(str.isdigit, url)) / n, sum(map(str.isdigit, host)), sum(map(str.isalpha, url)) / n, host.count("-"), path.count("-") + path.count("_"),
        len([x for x in query.split("&") if x]), query.count("="), url.count("%"), float("#" in url), float(url[:8].lower() == "https://"), float(host.startswith("www.")),
        float("." in path.rpartition("/")[2]), entropy(host), entropy(path), float(url.count("@")),
    ]


def suffix(host: Column) -> Column:
    """Bucket of the host's last two labels."""
    return F.pmod(F.xxhash64(F.substring_index(host, ".", -2)), F.lit(SUFFIXES)).cast("int")


class Trees(NamedTuple):
    """Complete binary trees: feature and threshold of each inner node, value of each leaf."""

    base: float
    feature: np.ndarray
    threshold: np.ndarray
    value: np.ndarray


def fit(x: np.ndarray, y: np.ndarray) -> Trees:
    """Boosts trees of depth ``DEPTH`` on the logistic loss; splits are sought among ``BINS`` quantiles a feature."""
    share = float(y.mean()) if len(y) else 0.0
    base = math.log((share + 1e-6) / (1 - share + 1e-6))
    inner = (1 << DEPTH) - 1
    if not len(y) or share in (0.0, 1.0):
        return Trees(base, np.zeros((0, inner), np.int64), np.zeros((0, inner)), np.zeros((0, inner + 1)))
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, BINS + 1)[1:-1])) for j in range(x.shape[1])]
    binned = np.stack([np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(edges)], 1)
    feature, threshold, value = np.zeros((TREES, inner), np.int64), np.full((TREES, inner), np.inf), np.zeros((TREES, inner + 1))
    score = np.full(len(y), base)
    for t in range(TREES):
        p = 1 / (1 + np.exp(-score))
        g, h = p - y, p * (1 - p)
        node = np.zeros(len(y), np.int64)
        for k in range(inner):
            rows = np.flatnonzero(node == k)
            best = (1e-9, 0, -1)
            for j, e in enumerate(edges):
                if not len(e) or len(rows) < 2 * LEAF:
                    continue
                b = binned[rows, j]
                gl, hl, nl = (np.cumsum(np.bincount(b, weights=w, minlength=len(e) + 1))[:-1] for w in (g[rows], h[rows], np.ones(len(rows))))
                gs, hs = g[rows].sum(), h[rows].sum()
                gain = gl**2 / (hl + PENALTY) + (gs - gl) ** 2 / (hs - hl + PENALTY) - gs**2 / (hs + PENALTY)
                gain[(nl < LEAF) | (len(rows) - nl < LEAF)] = -1
                if (m := int(gain.argmax())) >= 0 and gain[m] > best[0] + 1e-9:
                    best = (float(gain[m]), j, m)
            if best[2] >= 0:
                feature[t, k], threshold[t, k] = best[1], edges[best[1]][best[2]]
                node[rows] = 2 * k + 1 + (binned[rows, best[1]] > best[2])
            else:
                node[rows] = 2 * k + 1
        leaf = node - inner
        value[t] = -RATE * np.bincount(leaf, weights=g, minlength=inner + 1) / (np.bincount(leaf, weights=h, minlength=inner + 1) + PENALTY)
        score += value[t][leaf]
    return Trees(base, feature, threshold, value)


def predict(model: Trees, x: np.ndarray) -> np.ndarray:
    """Probability of ``block``."""
    score = np.full(len(x), model.base)
    inner, rows = model.feature.shape[1], np.arange(len(x))
    for t in range(len(model.feature)):
        node = np.zeros(len(x), np.int64)
        for _ in range(DEPTH):
            node = 2 * node + 1 + (x[rows, model.feature[t][node]] > model.threshold[t][node])
        score += model.value[t][node - inner]
    return 1 / (1 + np.exp(-score))


def suffix_shares(suffix: np.ndarray, fold: np.ndarray, known: np.ndarray, bad: np.ndarray) -> np.ndarray:
    """FOLDS + 1 x SUFFIXES: the smoothed share of blocked URLs outside each fold, and (last) among all of them."""
    seen, blocked = np.zeros((2, FOLDS + 1, SUFFIXES))
    np.add.at(seen, (fold, suffix), known)
    np.add.at(blocked, (fold, suffix), bad)
    seen, blocked = seen.sum(0) - seen, blocked.sum(0) - blocked  # nothing has the fold FOLDS, so its row is that of all
    return (blocked + 1) / (seen + 2)


def matrix(batch: pa.RecordBatch, often: np.ndarray, share: np.ndarray) -> np.ndarray:
    """Features of each row; ``share``: of each suffix, or of each fold and suffix for rows with a fold."""
    lexical = [features(*r) for r in zip(*(batch.column(c).to_pylist() for c in ("url", "host", "path")), strict=True)]
    at = batch.column("suffix").to_numpy()
    blocked = share[at] if share.ndim == 1 else share[batch.column("fold").to_numpy(), at]
    return np.column_stack([np.array(lexical, float).reshape(len(at), -1), often[at], blocked])


def _judged(batches: Iterator[pa.RecordBatch], model: Trees, often: np.ndarray, share: np.ndarray) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if batch.num_rows:
            risk = predict(model, matrix(batch, often, share))
            verdict = [v or ("block" if p >= 0.5 else "allow") for v, p in zip(batch.column("ruled").to_pylist(), risk.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("page_id", "host", "path", "rule")), pa.array(verdict, pa.string()), pa.array(risk)], names=["page_id", "host", "path", "rule", "verdict", "block_score"])


def url_verdicts(pages: DataFrame, rules=RULES, labelled: DataFrame | None = None, sample: int = SAMPLE) -> DataFrame:
    """page_id, host, path, rule, verdict, block_score for every page.

    ``labelled`` (url, verdict): URLs to learn from; by default the pages that a rule fits, with its verdict.
    """
    host, path = host_and_path(F.col("url"))
    rows = pages.select("page_id", "url", host.alias("host"), path.alias("path"))
    rows = rows.withColumn("_rule", rule_of(F.col("host"), F.col("path"), rules))
    rows = rows.select("page_id", "url", "host", "path", suffix(F.col("host")).alias("suffix"), F.col("_rule.verdict").alias("ruled"), F.col("_rule.rule").alias("rule"))
    if labelled is None:
        known = rows.where(F.col("ruled").isNotNull()).select("url", "host", "path", "suffix", (F.col("ruled") == "block").cast("int").alias("y"))
    else:
        h, p = host_and_path(F.col("url"))
        known = labelled.where(F.col("verdict").isin("block", "allow")).select("url", h.alias("host"), p.alias("path"), (F.col("verdict") == "block").cast("int").alias("y")).withColumn("suffix", suffix(F.col("host")))
    known = known.withColumn("fold", F.pmod(F.xxhash64("url"), F.lit(FOLDS)).cast("int"))
    counted = rows.groupBy("suffix").agg(F.count("*").alias("n")).toArrow()  # SUFFIXES rows at most
    often = np.zeros(SUFFIXES)
    often[counted.column("suffix").to_numpy()] = np.log1p(counted.column("n").to_numpy())
    by_fold = known.groupBy("suffix", "fold").agg(F.count("*").alias("known"), F.sum("y").alias("bad")).toArrow()  # SUFFIXES x FOLDS rows at most
    share = suffix_shares(*(by_fold.column(c).to_numpy() for c in ("suffix", "fold", "known", "bad")))
    learnt = known.orderBy(F.xxhash64("url"), "url", "y").limit(sample).toArrow().combine_chunks()
    learnt = learnt.to_batches()[0] if learnt.num_rows else None
    model = fit(matrix(learnt, often, share), learnt.column("y").to_numpy().astype(float)) if learnt else Trees(-1.0, *fit(np.zeros((0, 1)), np.zeros(0))[1:])
    whole = share[FOLDS]
    return rows.select("page_id", "url", "host", "path", "suffix", "ruled", "rule").mapInArrow(lambda it: _judged(it, model, often, whole), "page_id long, host string, path string, rule string, verdict string, block_score double")
