"""Secret scan over an incremental blob ledger.

Every version of a document is addressed by the SHA-256 of its content. The ledger holds one row per (blob, rule
version) that has been scanned, with its findings; a run scans only pairs that the ledger has not seen, appends
them, and joins findings back to every path that carries the blob. Only built-in functions run on the executors.

Defined results: null texts count as empty; empty texts have no findings; repeated rows and copies share one scan
and each get the findings; empty tables give no rows; columns other than id and text are ignored.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.llm.common import fresh_path

# The base patterns (kind, pattern, group whose length counts, least length), in the order of the kinds.
BASE_RULES = (
    ("assign", r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12),
    ("access", r"AKIA[A-Z0-9]+", 0, 18),
    ("hex", r"[0-9a-f]+", 0, 16),
)
EXTRA_RULES = (
    ("ghtoken", r"gh[pousr]_[A-Za-z0-9]{36,}", 0, 40),
    ("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----", 0, 1),
)
RULES = BASE_RULES + EXTRA_RULES
RULE_VERSION = "rules-1"
# What a text must hold for a rule to fit: a cheap test before matches are located.
HINTS = {
    "assign": r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]""",
    "access": r"AKIA[A-Z0-9]{14}",
    "hex": r"[0-9a-f]{16}",
    "ghtoken": r"gh[pousr]_[A-Za-z0-9]{36}",
    "pem": r"PRIVATE KEY-----",
}
SALTS = 16
SPAN = "array<struct<start:int,rank:int,kind:string,end:int>>"


def spans_of(text: Column, rank: int, kind: str, pattern: str, group: int, least: int) -> Column:
    """Spans (code points, end exclusive) of the leftmost non-overlapping matches whose ``group`` is long enough.

    ``split`` gives the text between the matches and ``regexp_extract_all`` the matches, so the running sum of
    their lengths gives each position.
    """
    if kind == "hex":  # runs are maximal, so short ones can be left out of the pattern
        pattern = r"[0-9a-f]{%d,}" % least
    between = F.transform(F.split(text, pattern, -1), lambda s: F.length(s))
    found = F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda s: F.length(s))
    counted = F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(group)), lambda s: F.length(s)) if group else found
    steps = F.arrays_zip(between.alias("gap"), found.alias("len"), counted.alias("counted"))

    def step(s: Column, x: Column) -> Column:
        start = s["at"] + x["gap"]
        end = start + F.coalesce(x["len"], F.lit(0))
        span = F.struct(start.alias("start"), F.lit(rank).alias("rank"), F.lit(kind).alias("kind"), end.alias("end"))
        return F.struct(end.alias("at"), F.when(x["counted"] >= least, F.concat(s["out"], F.array(span))).otherwise(s["out"]).alias("out"))

    none = F.expr(f"cast(array() as {SPAN})")
    all_spans = F.aggregate(steps, F.struct(F.lit(0).alias("at"), none.alias("out")), step, lambda s: s["out"])
    return F.when(text.rlike(HINTS[kind]), all_spans).otherwise(none)


def scan(blobs: DataFrame, rules=RULES) -> DataFrame:
    """blob, spans (sorted by start, then kind) of blobs (blob, text)."""
    text = F.col("text")
    spans = F.concat(*[spans_of(text, k, *rule) for k, rule in enumerate(rules)])
    return blobs.select("blob", F.array_sort(spans).alias("spans"))


def read_ledger(spark, path: str) -> DataFrame | None:
    try:
        return spark.read.parquet(path)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" in str(e):
            return None
        raise


def update_ledger(docs: DataFrame, ledger: str, rules=RULES, version: str = RULE_VERSION, text_col: str = "text") -> DataFrame:
    """Scans the blobs of ``docs`` that ``ledger`` has not seen under ``version``, appends them, and gives the version's ledger.

    Copies collapse to one blob before the shuffle (a partial aggregate per task), so a hot text costs one scan.
    """
    spark = docs.sparkSession
    text = F.coalesce(F.col(text_col), F.lit(""))
    blobs = docs.select(F.sha2(text, 256).alias("blob"), text.alias("text")).groupBy("blob").agg(F.first("text").alias("text"))
    known = read_ledger(spark, ledger)
    if known is not None:
        blobs = blobs.join(known.where(F.col("rule_version") == version).select("blob"), "blob", "left_anti")
    scan(blobs, rules).withColumn("rule_version", F.lit(version)).write.mode("append").option("compression", "zstd").parquet(ledger)
    return spark.read.parquet(ledger).where(F.col("rule_version") == version).dropDuplicates(["blob"])


def secret_findings(docs: DataFrame, ledger: str | None = None, rules=RULES, version: str = RULE_VERSION, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, blob, spans for every row of ``docs``, through the ledger at ``ledger`` (a new one by default)."""
    ledger = ledger or fresh_path(docs.sparkSession, "blob-ledger")
    found = update_ledger(docs, ledger, rules, version, text_col).where(F.size("spans") > 0).select("blob", "spans")
    found = found.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    paths = docs.select(F.col(id_col).alias("doc_id"), F.sha2(F.coalesce(F.col(text_col), F.lit("")), 256).alias("blob"))
    paths = paths.withColumn("_salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int"))
    joined = paths.join(found, ["blob", "_salt"], "left")
    return joined.select("doc_id", "blob", F.coalesce("spans", F.expr(f"cast(array() as {SPAN})")).alias("spans"))


def span_text(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def secret_report(docs: DataFrame, **options) -> DataFrame:
    """Counts of base kinds, the digest of base spans and all spans as text, per document."""
    base = {k for k, *_ in BASE_RULES}
    found = secret_findings(docs, **options)
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")
    return found.select(
        "doc_id",
        count("assign").alias("n_assign"),
        count("access").alias("n_access"),
        count("hex").alias("n_hex"),
        F.sha2(span_text(F.filter("spans", lambda s: s["kind"].isin(*base))), 256).alias("base_sha256"),
        span_text(F.col("spans")).alias("spans"),
    )


def unused(df: DataFrame, name: str) -> str:
    """``name`` with as many underscores in front as no column of ``df`` has."""
    while name.lower() in {c.lower() for c in df.columns}:
        name = "_" + name
    return name


def redacted(docs: DataFrame, mark: str = "[SECRET]", **options) -> DataFrame:
    """``docs`` with every found span replaced by ``mark`` and ``n_chars`` brought up to date.

    Texts without findings stay as they are, and so do all other columns, whatever their names.
    """
    ledger = options.pop("ledger", None) or fresh_path(docs.sparkSession, "blob-ledger")
    found = update_ledger(docs, ledger, **options).where(F.size("spans") > 0).select("blob", "spans")

    def merge(acc: Column, s: Column) -> Column:
        last = F.try_element_at(acc, F.lit(-1))
        span = F.named_struct(F.lit("start"), s["start"], F.lit("end"), s["end"])
        joined = F.named_struct(F.lit("start"), last["start"], F.lit("end"), F.greatest(last["end"], s["end"]))
        return F.when((F.size(acc) > 0) & (s["start"] <= last["end"]), F.concat(F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0))), F.array(joined))).otherwise(F.concat(acc, F.array(span)))

    merged = F.aggregate("spans", F.expr("cast(array() as array<struct<start:int,end:int>>)"), merge)
    cut_at, blob, salt = (unused(docs, x) for x in ("cut", "blob", "salt"))
    found = found.select(F.col("blob").alias(blob), merged.alias(cut_at), F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias(salt))
    text = F.coalesce(F.col("text"), F.lit(""))
    keyed = docs.withColumn(blob, F.sha2(text, 256)).withColumn(salt, F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int"))
    joined = keyed.join(found, [blob, salt], "left")
    cut = F.col(cut_at)

    def clean(acc: Column, s: Column) -> Column:
        piece = F.substring(text, acc["at"] + 1, s["start"] - acc["at"])
        return F.struct(s["end"].alias("at"), F.concat(acc["out"], piece, F.lit(mark)).alias("out"))

    rebuilt = F.aggregate(cut, F.struct(F.lit(0).alias("at"), F.lit("").alias("out")), clean, lambda a: F.concat(a["out"], F.substring(text, a["at"] + 1, F.length(text))))
    out = joined.withColumn("text", F.when(cut.isNull(), F.col("text")).otherwise(rebuilt))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(cut.isNull(), F.col("n_chars")).otherwise(F.length("text").cast("long")))
    return out.select(*docs.columns)
