"""SQL fragments shared by the checking queries."""

from __future__ import annotations

from quillon.functions import text as T

STOPS = "[" + ", ".join(f"'{w}'" for w in T.STOP_WORDS) + "]"


def h32(*keys: str) -> str:
    return "('0x' || substr(md5(concat_ws('|', '42', " + ", ".join(f"({k})::varchar" for k in keys) + ")), 1, 8))::bigint"


def collapsed(c: str) -> str:
    return rf"regexp_replace(replace(replace({c}, chr(160), ' '), chr(8203), ''), '\s+', ' ', 'g')"


def words(c: str) -> str:
    return f"list_filter(string_split_regex({c}, '\\s+'), lambda w: w <> '')"


def sentences(c: str) -> str:
    cut = rf"""string_split(regexp_replace({c}, '[.!?]+["''\)]*\s+([A-Z])', chr(1) || '\1', 'g'), chr(1))"""
    kept = f"list_filter(list_transform({cut}, lambda s: trim(s)), lambda s: length(s) > 20)"
    return f"CASE WHEN len({kept}) > 0 THEN {kept} WHEN length(trim({c})) > 20 THEN [trim({c})] ELSE [] END"


def english(c: str) -> str:
    return (
        f"(length({c}) < 40 OR (coalesce(length(regexp_replace(lower({c}), '[^a-z]', '', 'g'))::double / nullif(length(regexp_replace(lower({c}), '[^\\p{{L}}]', '', 'g')), 0) >= 0.6, false)"
        f" AND len(list_intersect(list_distinct({words(f'lower({c})')}), {STOPS})) >= 2))"
    )


def fingerprint(c: str) -> str:
    return rf"sha1(trim(regexp_replace(regexp_replace(lower({c}), '[^a-z0-9\s]', '', 'g'), '\s+', ' ', 'g')))"


def topic_scores(c: str, topics=T.TOPICS) -> list[str]:
    return ["(" + " + ".join(f"(length(lower({c})) - length(replace(lower({c}), '{w}', ''))) // {len(w)}" for w in keys) + ")" for keys in topics.values()]


def topic_id(c: str, topics=T.TOPICS) -> str:
    s = topic_scores(c, topics)
    best = f"greatest({', '.join(s)})"
    return f"CASE WHEN {best} <= 0 THEN {len(topics)} " + " ".join(f"WHEN {x} = {best} THEN {i}" for i, x in enumerate(s)) + " END"


def topic_name(c: str, topics=T.MIXED_TOPICS) -> str:
    s = topic_scores(c, topics)
    best = f"greatest({', '.join(s)})"
    return f"CASE WHEN {best} <= 0 THEN '' " + " ".join(f"WHEN {x} = {best} THEN '{t}'" for t, x in zip(topics, s, strict=True)) + " END"


def style(c: str) -> tuple[str, str, str]:
    w = words(f"lower({c})")
    counts = f"list_transform(list_filter(string_split_regex({c}, '[.!?]+'), lambda s: trim(s, ' ' || chr(10) || chr(9) || chr(13)) <> ''), lambda s: len({words('s')}))"
    return (
        f"coalesce(len(list_distinct({w}))::double / nullif(len({w}), 0), 0)",
        f"""coalesce((length({c}) - length(translate({c}, '.,;:!?"()-[]{{}}', '')))::double / nullif(length({c}), 0), 0)""",
        f"coalesce(list_sum({counts})::double / nullif(len({counts}), 0), 0)",
    )


def score(c: str) -> str:
    a, b, d = style(c)
    return f"round(({a} + least(1.0::double, 10 * {b}) + least(1.0::double, {d} / 40)) / 3, 6)"


BOOKS = "books AS (SELECT source || '/' || lpad(doc_id::varchar, 8, '0') AS book_id, source AS author, doc_id, lang, text FROM documents)"
SENTENCES = f"norm AS (SELECT book_id, author, doc_id, {collapsed('nfc_normalize(text)')} AS t FROM books), sents AS (SELECT book_id, author, doc_id, {sentences('t')} AS s FROM norm)"
WINDOWS = "wins AS (SELECT book_id, author, doc_id, (i // 10)::int AS idx, trim(array_to_string(s[i + 1:i + 14], ' ')) AS chunk FROM (SELECT *, unnest(range(0, len(s), 10)) AS i FROM sents))"
CHUNKS = f"{BOOKS}, {SENTENCES}, {WINDOWS}, chunks AS (SELECT * FROM wins WHERE length(chunk) >= 200 AND {english('chunk')})"
PRINTS = f"{CHUNKS}, prints AS (SELECT *, {fingerprint('chunk')} AS fp FROM chunks)"
DEDUP = f"{PRINTS}, often AS (SELECT fp FROM prints GROUP BY fp HAVING count(DISTINCT book_id) > 3), dedup AS (SELECT * FROM prints WHERE fp NOT IN (SELECT fp FROM often))"
SPLITS = """ranks AS (SELECT book_id, row_number() OVER (ORDER BY md5('42|split|' || book_id), book_id) AS r, count(*) OVER () AS n FROM (SELECT DISTINCT book_id FROM dedup)),
splits AS (SELECT book_id, CASE WHEN r <= floor(n * 0.7::double) THEN 'train' WHEN r <= floor(n * 0.7::double) + floor(n * 0.15::double) THEN 'validation' ELSE 'test' END AS split FROM ranks)"""
POSITIONED = f"{DEDUP}, {SPLITS}, pos AS (SELECT d.book_id, author, idx, chunk, split, (row_number() OVER (PARTITION BY d.book_id ORDER BY idx) - 1)::int AS pos, (count(*) OVER (PARTITION BY d.book_id))::int AS n FROM dedup d JOIN splits USING (book_id))"
ANON = "(lower(trim(coalesce({c}, ''))) IN ('', 'anonymous', 'unknown', 'unknown_author', 'various', 'misc', 'multiple_authors') OR regexp_matches(lower(coalesce({c}, '')), 'anonymous|unknown|various'))"
SCORED = f"scored AS (SELECT d.doc_id AS id, d.lang AS domain, l.quality::int AS label, {score('d.text')} AS score FROM documents d JOIN labels l USING (doc_id) WHERE l.quality IS NOT NULL)"
VECS = "vecs AS (SELECT vec_id AS id, label AS book, embedding::double[] AS vec FROM embeddings)"
