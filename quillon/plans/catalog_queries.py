"""Queries over names, lines, URLs, shards and files."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillon.functions import catalog as N
from quillon.functions import text as T
from quillon.operators import catalog as G
from quillon.operators.ranking import first_per
from quillon.plans import fragments as Q
from quillon.sources.tables import table

QUERIES, ORACLE_SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def documents(spark, sf_dir):
    return table(spark, sf_dir, "documents")


FIRST = "(SELECT doc_id, string_split(text, chr(10))[1] AS line FROM documents)"


def first_lines(spark, sf_dir):
    return documents(spark, sf_dir).select("doc_id", F.split("text", "\n", -1)[0].alias("line"))


SLUG = r"trim(regexp_replace(regexp_replace(translate(lower(trim(line)), '''’-', '   '), '[^a-z0-9\s]', '', 'g'), '\s+', ' ', 'g'))"


@query(f"SELECT doc_id, CASE WHEN s = '' THEN 'untitled' WHEN length(s) <= 40 THEN s ELSE substr(s, 1, 30) || '__' || substr(sha1(s || doc_id), 1, 8) END AS slug FROM (SELECT doc_id, replace({SLUG}, ' ', '_') AS s FROM {FIRST})")
def slug_clip(spark, sf_dir):
    s = first_lines(spark, sf_dir).select("doc_id", N.slug(F.col("line"), fold=False).alias("s"))
    return s.select("doc_id", N.clipped(F.col("s"), 40, F.col("doc_id").cast("string")).alias("slug"))


@query(r"SELECT doc_id, CASE WHEN t = '' THEN 'untitled' WHEN length(t) > 60 THEN rtrim(substr(t, 1, 60), '_') ELSE t END || '.txt' AS name FROM (SELECT doc_id, trim(regexp_replace(replace(regexp_replace(lower(trim(line)), '''s\b', 's', 'g'), '''', ''), '[^a-z0-9]+', '_', 'g'), '_') AS t FROM " + FIRST + ")")
def title_file_name(spark, sf_dir):
    return first_lines(spark, sf_dir).select("doc_id", N.file_name(F.col("line"), 60).alias("name"))


LINES = "(SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1)::int AS at, line FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS i FROM documents))"


@query(rf"SELECT doc_id, count(*) AS n FROM {LINES.replace(' AS at', ' AS pat')} WHERE length(regexp_replace(line, '[^\p{{Lu}}]', '', 'g'))::double / nullif(length(regexp_replace(line, '[^\p{{L}}]', '', 'g')), 0) >= 0.7::double GROUP BY doc_id")
def mostly_upper_lines(spark, sf_dir):
    rows = documents(spark, sf_dir).select("doc_id", F.explode(F.split("text", "\n", -1)).alias("line"))
    return rows.where(N.mostly_upper(F.col("line"))).groupBy("doc_id").agg(F.count("*").alias("n"))


@query(rf"SELECT doc_id, count(*) AS n FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents) WHERE length(line) - length(translate(line, '|+-=_*#[]{{}}~`^\/', '')) >= greatest(5.0::double, length(line) * 0.3::double) GROUP BY doc_id")
def art_lines(spark, sf_dir):
    rows = documents(spark, sf_dir).select("doc_id", F.explode(F.split("text", "\n", -1)).alias("line"))
    return rows.where(N.art_heavy(F.col("line"))).groupBy("doc_id").agg(F.count("*").alias("n"))


def _title_like_sql(c: str) -> str:
    # RE2 and Java agree on these patterns
    bad = " OR ".join("regexp_matches(" + c + ", '" + p.replace("'", "''") + "')" for p in N.REJECTING)
    listed = "[" + ", ".join(f"'{w}'" for w in N.EXCLUDED) + "]"
    tokens = f"list_filter(string_split_regex({c}, '\\s+'), lambda t: t <> '')"
    upper = f"coalesce(length(regexp_replace({c}, '[^\\p{{Lu}}]', '', 'g'))::double / nullif(length(regexp_replace({c}, '[^\\p{{L}}]', '', 'g')), 0) >= 0.7::double, false)"
    capital = f"len(list_filter({tokens}, lambda t: regexp_matches(t, '^[A-Z][a-z''\\-]+$')))"
    return (
        f"(length({c}) BETWEEN 6 AND 120 AND NOT ({bad}) AND NOT list_has_any(string_split_regex(regexp_replace(upper({c}), '[^A-Z]', ' ', 'g'), ' +'), {listed})"
        f" AND (({upper} AND NOT (len({tokens}) = 1 AND length({c}) < 10)) OR (NOT {upper} AND len({tokens}) BETWEEN 2 AND 12 AND {capital} >= greatest(2, len({tokens}) // 2))))"
    )


@query(f"SELECT doc_id, count(*) AS n FROM (SELECT doc_id, trim(unnest(string_split(text, chr(10)))) AS line FROM documents) WHERE {_title_like_sql('line')} GROUP BY doc_id")
def title_candidates(spark, sf_dir):
    rows = documents(spark, sf_dir).select("doc_id", F.explode(F.split("text", "\n", -1)).alias("line"))
    return rows.where(N.title_like(F.col("line"))).groupBy("doc_id").agg(F.count("*").alias("n"))


@query()
def best_title(spark, sf_dir):
    return G.titles(documents(spark, sf_dir))


@query()
def rename_plan(spark, sf_dir):
    return G.rename_plan(documents(spark, sf_dir))


HEADED = "concat('Title: Book ', doc_id, chr(10), 'Author: Writer ', doc_id % 7, chr(10), 'Language: ', CASE doc_id % 3 WHEN 0 THEN 'English' WHEN 1 THEN 'English, French' ELSE 'German; ' END, chr(10), text)"


def headed(spark, sf_dir):
    """Documents with a catalogue header made from their numbers; a quarter go without."""
    n = F.col("doc_id")
    language = F.when(n % 3 == 0, "English").when(n % 3 == 1, "English, French").otherwise("German; ")
    head = F.concat(F.lit("Title: Book "), n.cast("string"), F.lit("\nAuthor: Writer "), (n % 7).cast("string"), F.lit("\nLanguage: "), language, F.lit("\n"), F.col("text"))
    return documents(spark, sf_dir).select("doc_id", F.when(n % 4 == 0, F.col("text")).otherwise(head).alias("text"))


@query("SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN NULL WHEN doc_id % 3 = 0 THEN 'english' WHEN doc_id % 3 = 1 THEN 'english,french' ELSE 'german' END AS languages, doc_id % 4 = 0 OR doc_id % 3 = 0 AS kept FROM documents")
def language_filter(spark, sf_dir):
    langs = N.languages(F.col("text"))
    return headed(spark, sf_dir).select("doc_id", langs.alias("l")).select("doc_id", F.array_join("l", ",").alias("languages"), N.english_only(F.col("l")).alias("kept"))


@query("SELECT doc_id, CASE WHEN doc_id % 4 <> 0 THEN 'Book ' || doc_id END AS title, CASE WHEN doc_id % 4 <> 0 THEN 'Writer ' || doc_id % 7 END AS author FROM documents")
def title_author(spark, sf_dir):
    rows = headed(spark, sf_dir)
    return rows.select("doc_id", N.head_field(F.col("text"), "Title").alias("title"), N.head_field(F.col("text"), "Author").alias("author"))


@query("SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN 'unknown_author/untitled' || CASE WHEN r > 0 THEN '_' || r ELSE '' END ELSE 'writer_' || doc_id % 7 || '/book_' || doc_id END || '.txt' AS path FROM (SELECT doc_id, row_number() OVER (PARTITION BY doc_id % 4 = 0 ORDER BY doc_id) - 1 AS r FROM documents WHERE doc_id % 4 = 0 OR doc_id % 3 = 0)")
def ingest_paths(spark, sf_dir):
    return G.ingest(headed(spark, sf_dir)).select("doc_id", "path")


BASE = "https://example.org/files"


@query(f"SELECT id, at, url, floor(id / 500.0)::bigint AS batch FROM (SELECT page_id AS id, unnest([0, 1, 2, 3, 4])::int AS at, unnest(['/pg' || page_id || '.txt', '/pg' || page_id || '-0.txt', '/pg' || page_id || '.txt.utf-8', '/pg' || page_id || '-utf8.txt', '/pg' || page_id || '-8.txt']) AS tail, '{BASE}/' || page_id || tail AS url FROM pages) UNION ALL SELECT page_id, -1, url, floor(page_id / 500.0)::bigint FROM (SELECT * FROM pages QUALIFY row_number() OVER (PARTITION BY url ORDER BY page_id) = 1)".replace(" AS at,", ' AS "at",').replace("id, at,", 'id, "at",'))
def url_worklist(spark, sf_dir):
    pages = table(spark, sf_dir, "pages").select(F.col("page_id").alias("id"), "url")
    return G.url_worklist(pages.select("id"), BASE, pages)


SUFFIXES = ["-0.txt", ".txt.utf-8", "-utf8.txt", "-8.txt", ".txt", ".zip"]
FILES = "(SELECT 'pg' || (doc_id % 97) || ['-0.txt', '.txt.utf-8', '-utf8.txt', '-8.txt', '.txt', '.zip'][(doc_id % 6) + 1] AS name, lpad(doc_id::varchar, 8, '0') AS path FROM documents)"


def files(spark, sf_dir):
    n = F.col("doc_id")
    name = F.concat(F.lit("pg"), (n % 97).cast("string"), F.element_at(F.array(*map(F.lit, SUFFIXES)), (n % 6 + 1).cast("int")))
    return documents(spark, sf_dir).select(name.alias("name"), F.lpad(n.cast("string"), 8, "0").alias("path"))


@query(f"SELECT number, path, score FROM (SELECT regexp_extract(name, '(\\d+)', 1) AS number, path, (CASE WHEN name LIKE '%-0.txt' THEN 400 WHEN name LIKE '%.txt.utf-8' OR name LIKE '%-utf8.txt' THEN 350 WHEN name LIKE '%-8.txt' THEN 300 WHEN name LIKE '%.txt' THEN 100 ELSE 0 END)::int AS score FROM {FILES}) QUALIFY row_number() OVER (PARTITION BY number ORDER BY score DESC, path) = 1")
def best_file_per_id(spark, sf_dir):
    return G.best_variant(files(spark, sf_dir)).select("number", "path", "score")


@query(f"SELECT path FROM {FILES} WHERE path::bigint % 3 <> 0")
def incremental_anti_join(spark, sf_dir):
    index = files(spark, sf_dir).where("cast(path as bigint) % 3 = 0").select("path")
    return G.not_indexed(files(spark, sf_dir).select("path"), index)


@query("SELECT conv_id, turn, md5(text) AS digest FROM conversations QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC, md5(text) DESC) = 1")
def shard_last_writer(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.md5("text").alias("digest"))
    return first_per(rows, ["conv_id"], [F.desc("turn"), F.desc("digest")])


@query("SELECT doc_id, (doc_id % 5 + doc_id % 7) / 2.0::double AS mean FROM documents")
def parsed_lists(spark, sf_dir):
    text = F.concat((F.col("doc_id") % 5).cast("string"), F.lit(", "), (F.col("doc_id") % 7).cast("string"), F.lit(","))
    items = T.parsed_list(text)
    return documents(spark, sf_dir).select("doc_id", (F.aggregate(items, F.lit(0.0), lambda a, x: a + x) / F.size(items)).alias("mean"))


CLASHING = "'n' || doc_id % 40 || CASE WHEN doc_id % 3 = 0 THEN '_' || (doc_id % 4 + 1) ELSE '' END"


@query(f"""WITH rows AS (SELECT doc_id, {CLASHING} AS stem FROM documents), taken AS (SELECT DISTINCT 'n' || doc_id % 40 || CASE WHEN doc_id % 2 = 0 THEN '_7' ELSE '' END AS stem FROM documents WHERE doc_id % 5 = 0),
used AS (SELECT stem FROM rows UNION SELECT stem FROM taken),
nums AS (SELECT regexp_extract(stem, '^(.*)_([1-9][0-9]*)$', 1) AS stem, list_sort(list(regexp_extract(stem, '^(.*)_([1-9][0-9]*)$', 2)::int)) AS u FROM used WHERE regexp_matches(stem, '_[1-9][0-9]*$') GROUP BY 1),
uses AS (SELECT doc_id, stem, row_number() OVER (PARTITION BY stem ORDER BY doc_id) - 1 + (stem IN (SELECT stem FROM taken))::int AS r FROM rows)
SELECT doc_id, stem || CASE WHEN r = 0 THEN '' ELSE '_' || (r + coalesce(len(list_filter(list_transform(u, lambda x, i: x - i), lambda f: f < r)), 0)) END || '.txt' AS name FROM uses LEFT JOIN nums USING (stem)""")
def unique_names(spark, sf_dir):
    """Names of which many are equal, and others are what numbering would make."""
    n = F.col("doc_id")
    stem = F.concat(F.lit("n"), (n % 40).cast("string"))
    rows = documents(spark, sf_dir).select("doc_id", F.concat(stem, F.when(n % 3 == 0, F.concat(F.lit("_"), (n % 4 + 1).cast("string"))).otherwise(""), F.lit(".txt")).alias("name"))
    taken = documents(spark, sf_dir).where("doc_id % 5 = 0").select(F.concat(stem, F.when(n % 2 == 0, "_7").otherwise(""), F.lit(".txt")).alias("name"))
    return G.unique_names(rows, "name", "doc_id", taken).select("doc_id", F.col("unique").alias("name"))
