"""Labelled pairs: positives, negatives by kind, mixed domains, balanced samples, generation tasks.

Nothing here crosses books with books: partners are drawn by index and joined by equality on it.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillon.functions import text as T
from quillon.operators.ranking import ordered_place, ranked
from quillon.sources.staging import merged, staged

KINDS = ("author_same", "embed_neighbor", "random")


def anchors(chunks: DataFrame) -> DataFrame:
    """book_id, author, split, n of books with two chunks or more; chunks: positioned, with split."""
    return chunks.where((F.col("pos") == 0) & (F.col("n") >= 2)).select("book_id", "author", "split", "n")


def _draws(books: DataFrame, n: int) -> DataFrame:
    return books.withColumn("k", F.explode(F.sequence(F.lit(1), F.lit(n))))


def _side(chunks: DataFrame, i: int) -> DataFrame:
    topic = F.col("topic") if "topic" in chunks.columns else T.topic_id(F.col("chunk"))
    return chunks.select(F.col("book_id").alias(f"book{i}"), F.col("pos").alias(f"pos{i}"), F.col("chunk").alias(f"text{i}"), F.col("author").alias(f"author{i}"), topic.alias(f"topic{i}"))


def described(pairs: DataFrame) -> DataFrame:
    """Adds same_topic, same_author and pair_id to book1, pos1, text1, topic1, ... pairs."""
    known = ~T.is_anonymous(F.col("author1")) & ~T.is_anonymous(F.col("author2"))
    out = pairs.withColumn("same_topic", F.col("topic1") == F.col("topic2")).withColumn("same_author", known & (F.col("author1") == F.col("author2")))
    return out.withColumn("pair_id", F.md5(F.concat_ws("|", "book1", F.col("pos1").cast("string"), "book2", F.col("pos2").cast("string"), F.coalesce("neg_type", F.lit("positive")), F.col("k").cast("string"))))


def positives(chunks: DataFrame, per_book: int = 20) -> DataFrame:
    """Two different chunks of one book, ``per_book`` draws a book (a pair may be drawn twice)."""
    drawn = _draws(anchors(chunks), per_book)
    first = F.pmod(T.hash32(F.lit("pos1"), "book_id", "k"), F.col("n").cast("bigint")).cast("int")
    drawn = drawn.withColumn("pos1", first)
    step = F.pmod(T.hash32(F.lit("pos2"), "book_id", "k"), (F.col("n") - 1).cast("bigint")).cast("int")
    drawn = drawn.withColumn("pos2", (F.col("pos1") + 1 + step) % F.col("n"))
    drawn = drawn.select("split", "k", F.col("book_id").alias("book1"), "pos1", F.col("book_id").alias("book2"), "pos2")
    joined = drawn.join(_side(chunks, 1), ["book1", "pos1"]).join(_side(chunks, 2), ["book2", "pos2"])
    return described(joined.withColumn("label", F.lit(1)).withColumn("pair_type", F.lit("positive")).withColumn("neg_type", F.lit(None).cast("string"))).withColumn("same_author", F.lit(True))


def kind_weights(has_author: Column, has_neighbor: Column, random_share: float = 0.10) -> list[Column]:
    """Weights of ``KINDS``: the random share, the rest divided among the hard kinds there are; random alone without any."""
    r = min(max(random_share, 0.0), 0.9)
    hard = F.when(has_author & has_neighbor, (1 - r) / 2).otherwise(1 - r)
    return [
        F.when(has_author, hard).otherwise(0.0),
        F.when(has_neighbor, hard).otherwise(0.0),
        F.when(has_author | has_neighbor, F.lit(r)).otherwise(1.0),
    ]


def _near_books(edges: DataFrame, books: DataFrame) -> DataFrame:
    """book_id, neighbor_id, n2 (the neighbour's chunks), at_near (from 0), n_near: the edges within a split, placed by neighbour."""
    ends = books.select(F.col("book_id").alias("neighbor_id"), "split", F.col("n").alias("n2"))
    near = edges.select("book_id", "neighbor_id").where("book_id <> neighbor_id").join(merged(books.select("book_id", "split")), "book_id").join(merged(ends), ["neighbor_id", "split"])
    around = Window.partitionBy("book_id")
    return near.select("book_id", "neighbor_id", "n2", (F.row_number().over(around.orderBy("neighbor_id")) - 1).alias("at_near"), F.count("*").over(around).alias("n_near"))


def drawn_negatives(books: DataFrame, edges: DataFrame | None = None, per_book: int = 40, random_share: float = 0.10) -> DataFrame:
    """book1, pos1, book2, pos2, split, k, neg_type: a kind by weight, a partner book of the split by index, a chunk of each by hash.

    books: book_id, author, split, n (chunks) of every book with a chunk, best as a written table: it is read for each use.
    ``edges`` (book_id, neighbor_id): neighbours, counted only within the split. Anonymous authors have no
    ``author_same`` partners. A book without any partner gives no rows. No chunk is read.

    The tables of neighbours and of what is drawn from are written once. They grow with the input, so none of them is broadcast.
    """
    by_split = ordered_place(books, "split", "book_id", "at").withColumnRenamed("_n", "n_split")
    named = books.where(~T.is_anonymous(F.col("author")))
    placed = ordered_place(named.select("author", "split", "book_id", "n", F.struct("author", "split").alias("_owner")), "_owner", "book_id", "at_author")
    by_author = placed.select("author", "split", "book_id", "n", "at_author", F.col("_n").alias("n_author"))
    rows = by_split.where((F.col("n") >= 2) & (F.col("n_split") > 1)).join(merged(by_author.select("book_id", "at_author", "n_author")), "book_id", "left")
    if edges is None:
        rows = rows.withColumn("n_near", F.lit(0).cast("bigint"))
    else:
        near = staged(_near_books(edges, books), "near-books")
        rows = rows.join(merged(near.where("at_near = 0").select("book_id", "n_near")), "book_id", "left")
    rows = staged(rows, "drawing-books")
    weights = kind_weights(F.coalesce(F.col("n_author") > 1, F.lit(False)), F.coalesce(F.col("n_near") > 0, F.lit(False)), random_share)
    drawn = _draws(rows, per_book).withColumn("_u", T.hash32(F.lit("kind"), "book_id", "k") / F.lit(4294967296.0))
    drawn = drawn.withColumn("neg_type", F.when(F.col("_u") < weights[0], KINDS[0]).when(F.col("_u") < weights[0] + weights[1], KINDS[1]).otherwise(KINDS[2]))
    pick = T.hash32(F.lit("book"), "book_id", "k")

    def other(n: str, at: str) -> Column:
        """An index below n, not ``at``."""
        draw = F.pmod(pick, F.col(n) - 1)
        return F.when(draw < F.col(at), draw).otherwise(draw + 1)

    keep, book2 = ["book_id", "split", "n", "k", "neg_type", "book2", "n2"], [F.col("book_id").alias("book2"), F.col("n").alias("n2")]
    partners = [
        drawn.where("neg_type = 'author_same'").withColumn("_at", other("n_author", "at_author")).join(merged(by_author.select("author", "split", F.col("at_author").alias("_at"), *book2)), ["author", "split", "_at"]).select(*keep),
        drawn.where("neg_type = 'random'").withColumn("_at", other("n_split", "at")).join(merged(by_split.select("split", F.col("at").alias("_at"), *book2)), ["split", "_at"]).select(*keep),
    ]
    if edges is not None:
        partners.append(drawn.where("neg_type = 'embed_neighbor'").withColumn("_at", F.pmod(pick, F.col("n_near"))).join(merged(near.select("book_id", F.col("at_near").alias("_at"), F.col("neighbor_id").alias("book2"), "n2")), ["book_id", "_at"]).select(*keep))
    chosen = reduce(DataFrame.unionByName, partners).withColumnRenamed("book_id", "book1")
    chosen = chosen.withColumn("pos1", F.pmod(T.hash32(F.lit("neg1"), "book1", "k"), F.col("n").cast("bigint")).cast("int"))
    chosen = chosen.withColumn("pos2", F.pmod(T.hash32(F.lit("neg2"), "book1", "k"), F.col("n2").cast("bigint")).cast("int"))
    return chosen.select("book1", "pos1", "book2", "pos2", "split", "k", "neg_type")


def negatives(chunks: DataFrame, edges: DataFrame | None = None, per_book: int = 40, random_share: float = 0.10) -> DataFrame:
    """Chunks of two books of one split, as ``drawn_negatives`` draws them from the books of ``chunks`` (positioned, with split).

    Books are written once, so that no plan holds ``chunks`` more than for both sides' texts.
    """
    books = staged(chunks.where(F.col("pos") == 0).select("book_id", "author", "split", "n"), "books")
    chosen = drawn_negatives(books, edges, per_book, random_share)
    joined = chosen.join(merged(_side(chunks, 1)), ["book1", "pos1"]).join(merged(_side(chunks, 2)), ["book2", "pos2"])
    return described(joined.withColumn("label", F.lit(0)).withColumn("pair_type", F.lit("negative")))


def mined(candidates: DataFrame, most_probability: float = 0.20, least_similarity: float = 0.55, per_book: int = 20, in_all: int | None = None) -> DataFrame:
    """Scored candidates (book1, anchor, item, sim, prob) that pass floor and ceiling, hardest first, with caps.

    Hard is a high probability. ``in_all`` caps the whole result by the same order.
    """
    good = candidates.where((F.col("sim") >= least_similarity) & (F.col("prob") <= most_probability))
    out = ranked(good, ["book1"], [F.desc("prob"), F.col("anchor"), F.col("item")]).where(F.col("rank") <= per_book)
    return out.orderBy(F.desc("prob"), "book1", "rank").limit(in_all) if in_all else out


def balanced(pairs: DataFrame, per_class: int = 5000, hard: tuple[str, ...] = ("model_mined", "ann_mined", "embed_neighbor", "metadata_similar"), seed: str = "42") -> DataFrame:
    """As many negatives as positives (at most ``per_class``), half of them of the same topic, hard kinds first.

    What one half lacks comes from the larger one; pairs without text are left out.
    """
    rows = pairs.where((F.length("text1") > 0) & (F.length("text2") > 0))
    order = F.md5(F.concat_ws("|", F.lit(seed), F.col("pair_id")))
    pos = ranked(rows.where("label = 1").withColumn("_g", F.lit("pos")), ["_g"], [F.col("pair_id")], "_r").where(F.col("_r") <= per_class)
    neg = rows.where("label = 0").withColumn("_g", F.when(F.col("same_topic"), "same").otherwise("diff"))
    neg = ranked(neg, ["_g"], [F.coalesce(F.col("neg_type"), F.lit("")).isin(*hard).cast("int").desc(), order, F.col("pair_id")], "_r").where(F.col("_r") <= per_class)
    totals = pos.agg(F.count("*").alias("_target")).crossJoin(neg.agg(F.count_if(F.col("_g") == "same").alias("_same"), F.count_if(F.col("_g") == "diff").alias("_diff")))
    n_same = F.least(F.floor(F.col("_target") / 2), F.col("_same"))
    n_diff = F.least(F.col("_target") - n_same, F.col("_diff"))
    short = F.col("_target") - n_same - n_diff
    fill = F.col("_same") > F.col("_diff")  # the larger pool fills up, from its start
    joined = neg.crossJoin(F.broadcast(totals))
    own = F.when(F.col("_g") == "same", n_same).otherwise(n_diff)
    again = F.when((F.col("_g") == "same") == fill, short).otherwise(F.lit(0))
    chosen = joined.withColumn("_times", (F.col("_r") <= own).cast("int") + (F.col("_r") <= again).cast("int"))
    chosen = chosen.where("_times > 0").withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_times"))))
    return pos.drop("_g", "_r").unionByName(chosen.drop("_g", "_r", "_times", "_copy", "_target", "_same", "_diff"))


def mixed_positives(chunks: DataFrame, per_author: int = 5) -> DataFrame:
    """Two documents of one author of a domain, a chunk of each; authors with one document, domains with one author give nothing.

    chunks: domain, author, doc, pos, chunk, and topic if documents have one (empty: the chunk's own).
    """
    given = F.coalesce(F.nullif(F.col("topic"), F.lit("")), T.topic_name(F.col("chunk"))) if "topic" in chunks.columns else T.topic_name(F.col("chunk"))
    docs = chunks.groupBy("domain", "author", "doc").agg(F.count("*").alias("size"))
    own = Window.partitionBy("domain", "author")
    docs = docs.withColumn("d", F.row_number().over(own.orderBy("doc")) - 1).withColumn("n_docs", F.count("*").over(own))
    several = docs.select("domain", "author").distinct().groupBy("domain").agg(F.count("*").alias("_a")).where("_a > 1").select("domain")
    drawn = _draws(docs.where("d = 0 and n_docs > 1").join(several, "domain", "left_semi").select("domain", "author", "n_docs"), per_author)
    keys = ("domain", "author", "k")
    drawn = drawn.withColumn("d1", F.pmod(T.hash32(F.lit("doc1"), *keys), F.col("n_docs")))
    drawn = drawn.withColumn("d2", F.pmod(F.col("d1") + 1 + F.pmod(T.hash32(F.lit("doc2"), *keys), F.col("n_docs") - 1), F.col("n_docs")))
    placed = chunks.select("domain", "author", "doc", "pos", given.alias("topic")).withColumn("at", F.row_number().over(Window.partitionBy("domain", "author", "doc").orderBy("pos")) - 1)
    for i in (1, 2):
        side = docs.select("domain", "author", F.col("d").alias(f"d{i}"), F.col("doc").alias(f"doc{i}"), F.col("size").alias(f"_size{i}"))
        drawn = drawn.join(side, ["domain", "author", f"d{i}"]).withColumn(f"_at{i}", F.pmod(T.hash32(F.lit(f"chunk{i}"), *keys), F.col(f"_size{i}")))
        chosen = placed.select("domain", "author", F.col("doc").alias(f"doc{i}"), F.col("at").alias(f"_at{i}"), F.col("pos").alias(f"pos{i}"), F.col("topic").alias(f"topic{i}"))
        drawn = drawn.join(chosen, ["domain", "author", f"doc{i}", f"_at{i}"])
    return drawn.select("domain", F.col("author").alias("author1"), F.col("author").alias("author2"), "k", "doc1", "pos1", "topic1", "doc2", "pos2", "topic2", F.lit(1).alias("label"))


def candidate_union(hard: DataFrame, medium: DataFrame, easy: DataFrame, by: str = "book_id", item: str = "other") -> DataFrame:
    """by, item, tier, at: the candidates of each book, hard before medium before easy, each once, in order from 0."""
    tiers = [t.select(by, item).withColumn("tier", F.lit(k)) for k, t in enumerate((hard, medium, easy))]
    first = reduce(DataFrame.unionByName, tiers).where(F.col(by) != F.col(item)).groupBy(by, item).agg(F.min("tier").alias("tier"))
    return ranked(first, [by], [F.col("tier"), F.col(item)], "at").withColumn("at", F.col("at") - 1)


def mining_trials(candidates: DataFrame, chunks: DataFrame, most: int = 200, by: str = "book_id", item: str = "other") -> DataFrame:
    """Chunk pairs to be scored: min(``most``, 5 x candidates) draws a book of a candidate and a chunk of each.

    candidates: by, item, at; chunks: book_id, pos, n. Each draw is by hash and joined by index.
    """
    sized = candidates.groupBy(by).agg(F.count("*").alias("n_candidates"))
    drawn = sized.withColumn("trial", F.explode(F.sequence(F.lit(1), F.least(F.lit(most), 5 * F.col("n_candidates")).cast("int"))))
    drawn = drawn.withColumn("at", F.pmod(T.hash32(F.lit("candidate"), by, "trial"), F.col("n_candidates")))
    drawn = drawn.join(candidates.select(by, "at", item), [by, "at"])
    sizes = chunks.where("pos = 0").select("book_id", "n")
    for i, book in ((1, by), (2, item)):
        drawn = drawn.join(sizes.select(F.col("book_id").alias(book), F.col("n").alias(f"_n{i}")), book)
        drawn = drawn.withColumn(f"pos{i}", F.pmod(T.hash32(F.lit(f"mine{i}"), by, "trial"), F.col(f"_n{i}").cast("bigint")).cast("int"))
    return drawn.select(F.col(by).alias("book1"), "pos1", F.col(item).alias("book2"), "pos2", "trial")


def mixed_negatives(chunks: DataFrame, per_author: int = 5, candidates: int = 6) -> DataFrame:
    """Two authors of one domain: for each draw the first of a few chunks of the other that shares the topic.

    chunks: domain, author, doc, pos, chunk. Domains with one author give nothing.
    """
    own = Window.partitionBy("domain", "author")
    members = chunks.withColumn("at", F.row_number().over(own.orderBy("doc", "pos")) - 1).withColumn("size", F.count("*").over(own))
    authors = members.where("at = 0").select("domain", "author", "size")
    authors = authors.withColumn("a", F.row_number().over(Window.partitionBy("domain").orderBy("author")) - 1).withColumn("n_authors", F.count("*").over(Window.partitionBy("domain")))
    drawn = _draws(authors.where("n_authors > 1"), per_author)
    draw = F.pmod(T.hash32(F.lit("other"), "domain", "author", "k"), F.col("n_authors") - 1)
    drawn = drawn.withColumn("_a", F.when(draw < F.col("a"), draw).otherwise(draw + 1))
    drawn = drawn.join(authors.select("domain", F.col("a").alias("_a"), F.col("author").alias("author2"), F.col("size").alias("size2")), ["domain", "_a"])
    drawn = drawn.withColumn("at1", F.pmod(T.hash32(F.lit("own"), "domain", "author", "k"), F.col("size")))
    topic = T.topic_name(F.col("chunk"))  # only of what is drawn
    first = members.select("domain", "author", F.col("at").alias("at1"), F.col("doc").alias("doc1"), F.col("pos").alias("pos1"), F.col("chunk").alias("_one"))
    drawn = drawn.join(first, ["domain", "author", "at1"]).withColumn("topic1", T.topic_name(F.col("_one"))).drop("_one")
    drawn = drawn.withColumn("c", F.explode(F.sequence(F.lit(0).cast("bigint"), F.least(F.lit(candidates), F.col("size2")) - 1)))
    start = T.hash32(F.lit("theirs"), "domain", "author", "k")
    drawn = drawn.withColumn("at2", F.pmod(start + F.col("c"), F.col("size2")))
    second = members.select("domain", F.col("author").alias("author2"), F.col("at").alias("at2"), F.col("doc").alias("doc2"), F.col("pos").alias("pos2"), "chunk")
    scored = drawn.join(second, ["domain", "author2", "at2"]).withColumn("topic2", topic).drop("chunk").withColumn("match", ((F.col("topic1") == F.col("topic2")) & (F.col("topic1") != "")).cast("int"))
    best = ranked(scored, ["domain", "author", "k"], [F.desc("match"), F.col("c")]).where("rank = 1")
    return best.select("domain", F.col("author").alias("author1"), "author2", "k", "doc1", "pos1", "topic1", "doc2", "pos2", "topic2", F.lit(0).alias("label"))


def generation_tasks(excerpts: DataFrame, topics: list[str], samples: int = 3) -> DataFrame:
    """(excerpt_id, sample, topic, prompt, seed) for each excerpt (excerpt_id, text)."""
    drawn = excerpts.withColumn("sample", F.explode(F.sequence(F.lit(0), F.lit(samples - 1))))
    at = F.pmod(T.hash32(F.lit("topic"), "excerpt_id", "sample"), F.lit(len(topics)).cast("bigint")).cast("int")
    drawn = drawn.withColumn("topic", F.element_at(F.array(*map(F.lit, topics)), at + 1))
    return drawn.select("excerpt_id", "sample", "topic", T.prompt(F.col("text"), F.col("topic")).alias("prompt"), F.pmod(T.hash32(F.lit("seed"), "excerpt_id", "sample"), F.lit(2**31 - 1).cast("bigint")).alias("seed"))


def best_attempt(attempts: DataFrame, by: list[str], least: int = 50) -> DataFrame:
    """The first attempt whose text is long enough (ok), else the last; attempts: ``by``, attempt, output."""
    text = F.trim(F.coalesce("output", F.lit("")))
    rows = attempts.withColumn("output", text).withColumn("ok", F.length(text) >= least)
    order = [F.desc("ok"), F.when(F.col("ok"), F.col("attempt")).otherwise(-F.col("attempt"))]
    return ranked(rows, by, order).where("rank = 1").drop("rank")
