"""The thin queries over the operators of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quillon.llm.bpe import bpe_report
from quillon.llm.common import load
from quillon.llm.decontaminate import leaks
from quillon.llm.langid import language_id
from quillon.llm.quality_model import quality_scores
from quillon.llm.quality_rules import quality_rules
from quillon.llm.secrets import secret_report
from quillon.llm.sharding import feistel_shards
from quillon.llm.simhash import simhash_report
from quillon.llm.suffix_dedup import repeats_report
from quillon.llm.url_filter import url_verdicts


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_report(load(spark, sf_dir, "documents"))


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_verdicts(load(spark, sf_dir, "pages"))


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_report(load(spark, sf_dir, "documents"))


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(load(spark, sf_dir, "documents")).drop("longest_repeat")


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id(load(spark, sf_dir, "documents"))


def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats_report(load(spark, sf_dir, "documents"))


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks(load(spark, sf_dir, "documents"), load(spark, sf_dir, "benchmark"))


def op8_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_scores(load(spark, sf_dir, "documents"), load(spark, sf_dir, "labels"))


def op9_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_report(load(spark, sf_dir, "documents"))


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return feistel_shards(load(spark, sf_dir, "documents"), shards=24)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (op1_bpe, op2_url_filter, op3_simhash, op4_quality_rules, op5_language_id, op6_suffix_dedup, op7_decontamination, op8_quality_classifier, op9_secret_scan, op10_sharding)
}

WORD = r"[^\x20\x09-\x0D]+"

# Windows of words by position. The verdict on the longest repeat needs no lengths: a repeat of 50 words or more is longer
# than a twentieth of the words just if a window of the least such length occurs twice.
OP4_SQL = rf"""WITH d AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT r, regexp_extract_all(text, '{WORD}') AS ws FROM d),
n AS (SELECT r, ws, len(ws) AS n, greatest(50, len(ws) // 20 + 1) AS m FROM w),
p AS (SELECT r, ws, n, m, unnest(range(1, n + 1)) AS i FROM n),
g AS (SELECT r, i, CASE WHEN i + 7 <= n THEN array_to_string(list_slice(ws, i, i + 7), ' ') END AS g8 FROM p),
t AS (SELECT r, i, g8 IS NOT NULL AND count(*) OVER (PARTITION BY r, g8) > 1 AS twice FROM g),
h AS (SELECT r, i, twice, CASE WHEN twice AND i + m - 1 <= n THEN md5(array_to_string(list_slice(ws, i, i + m - 1), ' ')) END AS gm FROM t JOIN n USING (r)),
f AS (SELECT r, i, twice, gm IS NOT NULL AND count(*) OVER (PARTITION BY r, gm) > 1 AS long FROM h),
c AS (SELECT r, long, max(twice::int) OVER (PARTITION BY r ORDER BY i ROWS BETWEEN 7 PRECEDING AND CURRENT ROW) AS hit FROM f),
s AS (SELECT r, sum(hit)::bigint AS n_repeat, bool_or(long) AS long FROM c GROUP BY r),
a AS (SELECT doc_id, n AS n_words, length(array_to_string(ws, '')) AS word_chars, length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS n_symbols,
list_filter(string_split(text, chr(10)), lambda l: regexp_matches(l, '{WORD}')) AS lines, coalesce(n_repeat, 0) AS n_repeat_words, coalesce(long, false) AS long FROM d JOIN n USING (r) LEFT JOIN s USING (r)),
b AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM a)
SELECT doc_id, n_words, word_chars, n_symbols, len(lines) - len(list_distinct(lines)) AS n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND NOT long AND 100 * n_repeat_words <= 12 * n_words AS kept FROM b"""

# kind, pattern, group whose length counts, least length: in the order of the kinds
OP9_KINDS = (
    ("assign", r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)""", 2, 12),
    ("access", "AKIA[A-Z0-9]+", 0, 18),
    ("hex", "[0-9a-f]+", 0, 16),
    ("ghtoken", "gh[pousr]_[A-Za-z0-9]{36,}", 0, 40),
    ("pem", "-----BEGIN [A-Z ]*PRIVATE KEY-----", 0, 1),
)


def _matches_sql(rank: int, kind: str, pattern: str, group: int, least: int) -> str:
    """r, rank, kind, start, len of the long enough matches: a match starts after all gaps so far and all matches before it."""
    return f"""SELECT r, {rank} AS rank, '{kind}' AS kind, before - len AS start, len FROM (SELECT r, len, counted, sum(gap + len) OVER (PARTITION BY r ORDER BY i) AS before
FROM (SELECT r, unnest(range(1, len(found) + 1)) AS i, length(gaps[i]) AS gap, length(found[i]) AS len, length(counts[i]) AS counted
FROM (SELECT r, string_split_regex(text, '{pattern}') AS gaps, regexp_extract_all(text, '{pattern}') AS found, regexp_extract_all(text, '{pattern}', {group}) AS counts FROM d))) WHERE counted >= {least}"""


OP9_SQL = f"""WITH d AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
m AS ({" UNION ALL ".join(_matches_sql(i, *kind) for i, kind in enumerate(OP9_KINDS))}),
s AS (SELECT r, count(*) FILTER (rank = 0) AS n_assign, count(*) FILTER (rank = 1) AS n_access, count(*) FILTER (rank = 2) AS n_hex,
string_agg(span, ',' ORDER BY start, rank) FILTER (rank < 3) AS base, string_agg(span, ',' ORDER BY start, rank) AS spans
FROM (SELECT *, kind || ':' || start || ':' || (start + len) AS span FROM m) GROUP BY r)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM d LEFT JOIN s USING (r)"""

ORACLE_SQL: dict[str, str] = {"op4_quality_rules": OP4_SQL, "op9_secret_scan": OP9_SQL}
