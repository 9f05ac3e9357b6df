"""Text as Column expressions: white space, sentences, chunks, language, fingerprints, topics, style."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values.
STOP_WORDS = (
    "the of and to in a that is it for on as with by be this from at are was were have has had or an not but which "
    "you he she they we his her their our its can could would should into about than then them no so such more any "
    "may one other who what when where how why all those these some if do does did been being very over out up down "
    "again ever always never upon under between"
).split()
TOPICS: dict[str, tuple[str, ...]] = {
    "religious": ("god", "church", "prayer", "scripture", "lord", "faith", "holy", "sacred", "divine"),
    "historical": ("prince", "king", "castle", "knight", "lord", "duke", "empire", "queen", "court"),
    "adventure": ("captain", "ship", "sea", "voyage", "island", "expedition", "jungle", "desert", "treasure"),
    "romance": ("love", "heart", "soul", "passion", "beloved", "darling", "kiss", "romance", "marriage"),
}
DEFAULT_TOPIC = "general"
MIXED_TOPICS: dict[str, tuple[str, ...]] = TOPICS | {
    "legal": ("court", "appeal", "plaintiff", "defendant", "precedent", "statute", "opinion", "justice", "jury"),
    "technical": ("algorithm", "data", "model", "experiment", "theorem", "equation", "system", "network", "performance"),
    "government": ("agency", "policy", "regulation", "federal", "program", "initiative", "public", "official", "department"),
    "fiction": ("dialogue", "whispered", "suddenly", "shadow", "door", "eyes", "voice", "silence", "room"),
}
ANONYMOUS = ("anonymous", "unknown", "unknown_author", "various", "misc", "multiple_authors")
ANONYMOUS_PARTS = ("anonymous", "unknown", "various")
PUNCTUATION = """.,;:!?"()-[]{}"""

SENTENCE_END = r"""(?U)[.!?]+["'\)]*\s+(?=[A-Z])"""
SHORTEST_SENTENCE = 20


def stripped(c: Column) -> Column:
    """Without white space of any kind at both ends."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def collapsed(c: Column) -> Column:
    """No-break spaces become spaces, zero-width spaces go, runs of white space become one space."""
    return F.regexp_replace(F.translate(c, " ​", " "), r"(?U)\s+", " ")


def sentences(c: Column) -> Column:
    """Sentences of more than 20 characters; the whole text if there is none and it is long enough."""
    parts = F.filter(F.transform(F.split(c, SENTENCE_END, -1), stripped), lambda s: F.length(s) > SHORTEST_SENTENCE)
    whole = F.when(F.length(stripped(c)) > SHORTEST_SENTENCE, F.array(stripped(c))).otherwise(F.expr("cast(array() as array<string>)"))
    return F.when(F.size(parts) > 0, parts).otherwise(whole)


def words(c: Column) -> Column:
    """Words between white space; none for a blank text."""
    return F.filter(F.split(c, r"(?U)\s+", -1), lambda w: w != "")


def is_english(c: Column, shortest: int = 40, least_ratio: float = 0.6, least_words: int = 2) -> Column:
    """Share of a-z among letters and number of distinct stop words; short texts pass, texts without letters fail."""
    low = F.lower(c)
    latin = F.length(low) - F.length(F.translate(low, "abcdefghijklmnopqrstuvwxyz", ""))
    letters = F.length(F.regexp_replace(low, r"[^\p{L}]", ""))
    stops = F.size(F.array_intersect(words(low), F.array(*map(F.lit, STOP_WORDS))))
    return (F.length(c) < shortest) | F.coalesce(F.try_divide(latin, letters) >= least_ratio, F.lit(False)) & (stops >= least_words)


def windows(items: Column, size: int = 14, overlap: int = 4) -> Column:
    """Items joined by spaces in windows that start every ``size - overlap`` (1 at least)."""
    starts = F.sequence(F.lit(1), F.size(items), F.lit(max(1, size - overlap)))
    joined = F.transform(starts, lambda i: F.array_join(F.slice(items, i, F.lit(size)), " "))
    return F.when(F.size(items) > 0, joined).otherwise(F.expr("cast(array() as array<string>)"))


def chunks(items: Column, size: int = 14, overlap: int = 4, min_chars: int = 200, english: bool = True, fallback: str = "none") -> Column:
    """(idx, chunk) of the windows that are long enough (and English).

    ``fallback``: without any, the first window if it is not empty (``any``) or at least half as long (``half``).
    """
    if fallback not in ("none", "any", "half"):
        raise ValueError(f"unknown fallback {fallback!r}")
    every = F.transform(windows(items, size, overlap), lambda s, i: F.struct(i.alias("idx"), stripped(s).alias("chunk")))
    good = F.filter(every, lambda x: (F.length(x["chunk"]) >= min_chars) & (is_english(x["chunk"]) if english else F.lit(True)))
    if fallback == "none":
        return good
    least = 1 if fallback == "any" else min_chars // 2
    return F.when(F.size(good) > 0, good).otherwise(F.filter(F.slice(every, 1, 1), lambda x: F.length(x["chunk"]) >= least))


def chunk_estimate(c: Column, tokens: Column | None = None, most: int = 8, max_tokens: int = 512, size: int = 14) -> Column:
    """How many chunks a text should give: 1 if it is short, else by tokens or sentences, 1 to ``most``."""
    n_tokens = F.size(words(c)) if tokens is None else tokens
    n_sentences = F.size(sentences(c))
    short = (n_tokens > 0) & (n_tokens <= max_tokens) & (n_sentences <= size)
    scaled = F.ceil(F.greatest(n_tokens / F.lit(float(max_tokens)), n_sentences / F.lit(float(size)))).cast("int")
    return F.when(short, 1).otherwise(F.least(F.lit(most), F.greatest(F.lit(1), scaled)))


def fingerprint(c: Column) -> Column:
    """SHA-1 of the text in lower case without anything but a-z, 0-9 and single spaces."""
    plain = F.regexp_replace(F.lower(c), r"(?U)[^a-z0-9\s]", "")
    return F.sha1(stripped(F.regexp_replace(plain, r"(?U)\s+", " ")))


def occurrences(c: Column, word: str) -> Column:
    """Occurrences of ``word`` as a substring, not overlapping. Bytes are compared: a text knows how many it has."""
    return ((F.octet_length(c) - F.octet_length(F.replace(c, F.lit(word), F.lit("")))) / len(word.encode())).cast("int")


def _best_topic(c: Column, topics: Mapping[str, Sequence[str]], values: list[Column], default: Column) -> Column:
    """The value of the topic with most keyword occurrences, the first of equals; the text and the scores are bound once."""

    def judged(low: Column) -> Column:
        counts = {w: occurrences(low, w) for keys in topics.values() for w in keys}
        scores = F.array(*[sum((counts[w] for w in keys), F.lit(0)) for keys in topics.values()])
        best = lambda s: F.when(F.array_max(s) <= 0, default).otherwise(F.element_at(F.array(*values), F.array_position(s, F.array_max(s)).cast("int")))
        return F.transform(F.array(scores), best)[0]

    return F.transform(F.array(F.lower(c)), judged)[0]


def topic_id(c: Column, topics: Mapping[str, Sequence[str]] = TOPICS) -> Column:
    """Number of the topic with most keyword occurrences, the first of equals; the number of topics if there is none."""
    return _best_topic(c, topics, [F.lit(i) for i in range(len(topics))], F.lit(len(topics)))


def topic_name(c: Column, topics: Mapping[str, Sequence[str]] = MIXED_TOPICS) -> Column:
    """Name of the topic with most keyword occurrences, the first of equals; empty if there is none."""
    return _best_topic(c, topics, [F.lit(t) for t in topics], F.lit(""))


def style_features(c: Column) -> Column:
    """(type_token_ratio, punct_ratio, avg_sentence_len); zeros for an empty text."""
    w = words(F.lower(c))
    punct = F.length(c) - F.length(F.translate(c, PUNCTUATION, ""))
    counts = F.transform(F.filter(F.split(c, "[.!?]+", -1), lambda s: stripped(s) != ""), lambda s: F.size(words(s)))
    total = F.aggregate(counts, F.lit(0), lambda a, x: a + x)
    return F.struct(
        F.coalesce(F.try_divide(F.size(F.array_distinct(w)), F.size(w)), F.lit(0.0)).alias("type_token_ratio"),
        F.coalesce(F.try_divide(punct, F.length(c)), F.lit(0.0)).alias("punct_ratio"),
        F.coalesce(F.try_divide(total, F.size(counts)), F.lit(0.0)).alias("avg_sentence_len"),
    )


def token_style_features(ids: Column, mask: Column, batch: int = 1, punctuation_above: int = 50_000) -> Column:
    """(type_token_ratio, punct_ratio, avg_length) of token ids: of those in the mask, of ids above a bound, over the batch.

    Zeros where the mask is empty.
    """
    own = F.transform(F.filter(F.arrays_zip(ids.alias("t"), mask.alias("m")), lambda x: x["m"] != 0), lambda x: x["t"])
    n = F.size(own)
    return F.struct(
        F.coalesce(F.try_divide(F.size(F.array_distinct(own)), n), F.lit(0.0)).alias("type_token_ratio"),
        F.coalesce(F.try_divide(F.size(F.filter(ids, lambda t: t > punctuation_above)), n), F.lit(0.0)).alias("punct_ratio"),
        (n / F.lit(float(batch))).alias("avg_length"),
    )


def is_anonymous(author: Column) -> Column:
    """Blank, one of the collective names, or containing one of the collective words."""
    a = F.lower(F.trim(F.coalesce(author, F.lit(""))))
    return (a == "") | a.isin(*ANONYMOUS) | a.rlike("|".join(ANONYMOUS_PARTS))


def author_of(book_id: Column) -> Column:
    """The part before the first slash; empty without a slash."""
    return F.when(F.instr(book_id, "/") > 0, F.substring_index(book_id, "/", 1)).otherwise(F.lit(""))


def hash32(*keys: Column | str, seed: str = "42") -> Column:
    """A number in [0, 2**32) from the MD5 of the seed and keys: every random choice of this library."""
    parts = [F.lit(seed), *[(k if isinstance(k, Column) else F.col(k)).cast("string") for k in keys]]
    return F.conv(F.substring(F.md5(F.concat_ws("|", *parts)), 1, 8), 16, 10).cast("bigint")


def excerpt(items: Column, key: Column, n: int = 15, seed: str = "42") -> Column:
    """(start, total, text): a window of ``n`` items at a place drawn by ``key``; all of them if there are fewer."""
    room = F.greatest(F.size(items) - n + 1, F.lit(1))
    start = F.pmod(hash32(key, seed=seed), room.cast("bigint")).cast("int")
    return F.struct(start.alias("start"), F.size(items).alias("total"), F.array_join(F.slice(items, start + 1, F.lit(n)), " ").alias("text"))


def prompt(text: Column, topic: Column, low: int = 600, high: int = 900) -> Column:
    """The request to write on ``topic`` in the style of ``text``."""
    # Fixed value: the wording of the request.
    form = (
        "STYLE REFERENCE\n---\n%s\n---\n\nWrite an original short story about: %s.\n"
        "Match the reference's voice, rhythm, and paragraph structure.\n"
        "Avoid copying plot points, named entities, or distinctive phrases.\n"
        f"Target length: {low}-{high} words."
    )
    return F.format_string(form, text, topic)


def parsed_list(c: Column, kind: str = "double") -> Column:
    """The numbers of a comma-separated list; blank items are left out."""
    return F.transform(F.filter(F.split(c, ",", -1), lambda x: F.trim(x) != ""), lambda x: F.trim(x).cast(kind))
