"""Catalogue operators: file variants, work lists, titles, names, rename plans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillon.functions import catalog as N
from quillon.functions.text import stripped
from quillon.operators.ranking import first_per
from quillon.sources.staging import staged

BYLINE = r"(?i)\b(BY|TRANSLATED\s+BY|EDITED\s+BY)\b"
DAYS = r"(?i)\b(MONDAY|TUESDAY|WEDNESDAY|THURSDAY|FRIDAY|SATURDAY|SUNDAY|JANUARY|FEBRUARY|MARCH|APRIL|MAY|JUNE|JULY|AUGUST|SEPTEMBER|OCTOBER|NOVEMBER|DECEMBER)\b"  # fixed value
ARTICLES = ("THE", "A", "AN", "LE", "LA", "EL")  # fixed value


def best_variant(files: DataFrame) -> DataFrame:
    """The best file of each number (path, name): by its variant, the first path of equals; names without number go."""
    numbered = files.withColumn("number", N.number_in(F.col("name"))).where(F.col("number").isNotNull())
    return first_per(numbered.withColumn("score", N.variant_score(F.col("name"))), ["number"], [F.desc("score"), F.col("path")])


def url_worklist(ids: DataFrame, base: str, extra: DataFrame | None = None, plain_first: bool = True, batch: int = 500) -> DataFrame:
    """(id, at, url, batch): each id's candidate places in order, each place once (its first appearance)."""
    rows = ids.select("id", F.posexplode(N.candidate_urls(F.col("id"), base, plain_first)).alias("at", "url"))
    if extra is not None:
        rows = extra.select("id", F.lit(-1).alias("at"), "url").unionByName(rows)
    return first_per(rows, ["url"], [F.col("id"), F.col("at")]).withColumn("batch", F.floor(F.col("id") / batch))


def not_indexed(files: DataFrame, index: DataFrame, key: str = "path") -> DataFrame:
    """Files that the index does not have yet."""
    return files.join(index.select(key).distinct(), key, "left_anti")


def unique_names(names: DataFrame, name: str = "name", order: str = "path", taken: DataFrame | None = None) -> DataFrame:
    """Adds unique: the name on its first use (by ``order``), and the stem with the least free number after it on further ones.

    Numbers are free if no row is named so, no name in ``taken`` is so, and no earlier row has got it; names already taken
    count as used. What is made of one stem can only meet names that are that stem and a number, so numbers are dealt a
    stem at a time: a window counts, for the r-th use, the used numbers that have fewer than r free ones below them.
    """
    names = staged(names, "names")  # read for uses and for used numbers
    stem = F.regexp_replace(F.col(name), r"\.txt$", "")
    rows = names.withColumn("_stem", stem).withColumn("_use", F.row_number().over(Window.partitionBy("_stem").orderBy(order)))
    used = names.select(stem.alias("_stem"))
    if taken is not None:
        before = taken.select(stem.alias("_stem")).distinct()
        used = used.union(before)
        rows = rows.join(before.withColumn("_taken", F.lit(1)), "_stem", "left")
    rows = rows.withColumn("_use", F.col("_use") - 1 + (F.coalesce("_taken", F.lit(0)) if taken is not None else 0)).drop("_taken")
    number = F.regexp_extract("_stem", r"^.*_([1-9]\d{0,8})$", 1)
    used = used.where(number != "").select(F.regexp_extract("_stem", r"^(.*)_[1-9]\d{0,8}$", 1).alias("_stem"), number.cast("int").alias("_n")).distinct()
    used = used.join(rows.where("_use > 0").select("_stem").distinct(), "_stem", "left_semi")
    free = F.col("_n") - F.row_number().over(Window.partitionBy("_stem").orderBy("_n"))  # free numbers below
    marks = used.select("_stem", free.alias("_use")).groupBy("_stem", "_use").agg(F.count("*").alias("_more"))
    uses = rows.where("_use > 0").select("_stem", "_use").withColumn("_more", F.lit(None).cast("bigint"))
    earlier = Window.partitionBy("_stem").orderBy("_use").rangeBetween(Window.unboundedPreceding, -1)
    shifted = uses.unionByName(marks).withColumn("_shift", F.coalesce(F.sum("_more").over(earlier), F.lit(0))).where(F.col("_more").isNull()).drop("_more")
    numbered = rows.join(shifted, ["_stem", "_use"], "left")
    tail = F.when(F.col("_use") > 0, F.concat(F.lit("_"), (F.col("_use") + F.col("_shift")).cast("string"))).otherwise("")
    return numbered.withColumn("unique", F.concat("_stem", tail, F.lit(".txt"))).select(*names.columns, "unique")


def lines_of(documents: DataFrame, key: str = "doc_id", most: int = 1500) -> DataFrame:
    """key, at, line, and the lines around: one window a document, frames by place."""
    rows = documents.select(key, F.posexplode(N.head_lines(F.col("text"), most)).alias("at", "line"))
    own = Window.partitionBy(key).orderBy("at")
    joined = lambda a, b: F.array_join(F.collect_list("line").over(own.rowsBetween(a, b)), " ")
    return rows.withColumns(
        {
            "before": F.coalesce(F.lag("line").over(own), F.lit("")),
            "after": F.coalesce(F.lead("line").over(own), F.lit("")),
            "next5": joined(1, 5),
            "next9": joined(1, 9),
            "back30": joined(-30, -1),
            "around": joined(-30, 30),
        }
    )


def candidate_score(line: Column, at: Column, before: Column, after: Column, next5: Column, back30: Column) -> Column:
    """How likely a title-like line is the title: length, words, capitals, what surrounds it."""
    s = stripped(line)
    n = F.length(s)
    tokens = F.size(F.filter(F.split(s, r"(?U)\s+", -1), lambda t: t != ""))
    upper, digits = N.mostly_upper(s), s.rlike(r"\d")
    names = s.rlike(r"^(\p{Lu}\p{L}*\s+){1,3}\p{Lu}\p{L}*$") & next5.rlike(r"\(\s*\d{3,4}\s*[-–—]\s*\d{2,4}\s*\)|\b\d{4}\b")
    terms = [
        F.when(n.between(10, 60), 3).when(n.between(6, 80), 1),
        F.when(tokens.between(2, 12), 2),
        F.when(upper, 1),
        F.when((tokens == 1) & s.rlike(r"'[sS]$") & (n <= 12), -2),
        F.when(N.art_heavy(before) | N.art_heavy(after), -2),
        F.when(digits, -3),
        F.when(next5.rlike(BYLINE), 2),
        F.when((at < 15) & upper, 2),
        F.when(names, -3),
        F.when(back30.rlike(r"(?i)\b(CONTENTS|CREDITS)\b"), -5),
        F.when(tokens.between(1, 5) & upper & ~digits & next5.rlike(DAYS), 3),
    ]
    return sum((F.coalesce(t, F.lit(0)) for t in terms), F.lit(0))


def titles(documents: DataFrame, key: str = "doc_id") -> DataFrame:
    """key, title, confidence: the best finding by stage.

    Stages: a title field with catalogue lines around it; the heading phrase; the line above a byline; a title-like
    line near the top with a byline below; the best scored title-like line; the first line that is not boilerplate.
    The first two are of high, the next two of medium confidence. A document without any line has a null title.
    """
    lines = lines_of(documents, key).withColumn("s", stripped(F.col("line")))
    field = F.regexp_extract("line", r"(?i)^\s*Title\s*[:\-]\s*(.+)$", 1)
    known = F.col("around").rlike(r"(?i)project\s+gutenberg|author\s*[:\-]|release\s+date\s*[:\-]")
    phrase = r"(?i)project\s+gutenberg(?:[^\n]*?\be?(?:text|book)\b\s+of|'?s)\s+(.+?)(?:,\s+by\b|\s+by\b|$)"
    headed = F.regexp_replace(stripped(F.regexp_extract("line", phrase, 1)), "^[\"'“”]+|[\"'“”]+$", "")
    like = N.title_like(F.col("line"))
    own = Window.partitionBy(key).orderBy("at")
    below = F.max(F.col("s").rlike(r"(?i)^(by|translated\s+by|edited\s+by)\b").cast("int")).over(own.rowsBetween(1, 5))
    boiler = F.arrays_overlap(F.split(F.regexp_replace(F.upper("s"), "[^A-Z]", " "), " +", -1), F.array(*map(F.lit, N.EXCLUDED)))
    one, two = stripped(F.col("before")), stripped(F.coalesce(F.lag("line", 2).over(own), F.lit("")))
    above = F.when(one != "", one).otherwise(two)  # one blank line may stand between
    article = F.when(F.upper(above).isin(*ARTICLES) & N.mostly_upper(above), F.concat(above, F.lit(" "))).otherwise(F.lit(""))
    score = candidate_score(*[F.col(c) for c in ("line", "at", "before", "after", "next5", "back30")])
    found = lines.withColumn("below", below).withColumn("like", like).withColumn("score", F.when(F.col("like"), score)).withColumn("whole", F.concat(article, F.col("s")))
    whole = F.col("whole")
    at = F.col("at")
    options = [
        F.when((at < 400) & (field != "") & known, F.struct(F.lit(1).alias("stage"), at.alias("order"), stripped(field).alias("title"), F.lit("high").alias("confidence"))),
        F.when(headed != "", F.struct(F.lit(2), at, headed, F.lit("high"))),
        F.when((at < 600) & F.col("like") & (F.col("below") == 1), F.struct(F.lit(3), at, whole, F.lit("medium"))),
        F.when((at < 80) & F.col("like") & F.col("next9").rlike(BYLINE), F.struct(F.lit(4), at, whole, F.lit("medium"))),
        F.when((at < 200) & F.col("like") & (F.col("score") >= 1), F.struct(F.lit(5), at - 1000 * F.col("score"), whole, F.lit("low"))),
        F.when((at < 300) & (F.col("s") != "") & ~boiler, F.struct(F.lit(6), at, F.col("s"), F.lit("low"))),
    ]
    kind = "struct<stage:int,order:int,title:string,confidence:string>"
    best = found.groupBy(key).agg(F.min(F.array_min(F.filter(F.array(*[o.cast(kind) for o in options]), lambda x: x.isNotNull()))).alias("best"))
    return best.select(key, F.col("best.title").alias("title"), F.coalesce("best.confidence", F.lit("low")).alias("confidence"))


def rename_plan(documents: DataFrame, key: str = "doc_id", least: str = "low") -> DataFrame:
    """key, old, new, confidence, error: file names from titles of at least this confidence; documents without title are kept with an error."""
    level = lambda c: F.when(c == "high", 3).when(c == "medium", 2).otherwise(1)
    found = titles(documents, key).withColumn("old", F.concat(F.col(key).cast("string"), F.lit(".txt")))
    found = found.withColumn("error", F.when(F.col("title").isNull(), "no_title_found").when(level(F.col("confidence")) < level(F.lit(least)), "low_confidence"))
    named = found.withColumn("name", F.when(F.col("error").isNull(), N.file_name(F.col("title"))))
    return unique_names(named.withColumn("name", F.coalesce("name", "old")), "name", key).select(key, "old", F.when(F.col("error").isNull(), F.col("unique")).alias("new"), "confidence", "error")


def ingest(documents: DataFrame, key: str = "doc_id") -> DataFrame:
    """key, title, author, languages, slug path of English texts (or texts that name no language); equal paths get a number."""
    text = F.col("text")
    rows = documents.withColumn("languages", N.languages(text)).where(N.english_only(F.col("languages")))
    rows = rows.select(key, N.head_field(text, "Title").alias("title"), F.coalesce(N.head_field(text, "Author"), N.byline(text)).alias("author"), "languages", F.length(text).alias("n_chars"))
    author = N.clipped(N.slug(F.coalesce("author", F.lit("unknown author"))), 80, F.col(key).cast("string"))
    title = N.clipped(N.slug(F.col("title")), 120, F.col(key).cast("string"))
    return unique_names(rows.withColumn("name", F.concat(author, F.lit("/"), title, F.lit(".txt"))), "name", key).drop("name").withColumnRenamed("unique", "path")
