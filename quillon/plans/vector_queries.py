"""Queries over vectors: neighbours, pooling, similarity, outliers, layouts."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillon.functions import vectors as V
from quillon.operators import corpus_map as Z
from quillon.operators import neighbors as N
from quillon.operators import pairs as P
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


def vectors(spark, sf_dir):
    """Embeddings as chunk vectors of books: id, book, idx, vec."""
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("label").cast("int").alias("book"), F.col("vec_id").alias("idx"), V.doubles(F.col("embedding")).alias("vec"))


def shown(df, *by):
    """Vectors as their first components and length, rounded."""
    return df.select(*by, *[F.round(F.col("vec")[i], 5).alias(f"v{i}") for i in range(4)], F.round(V.norm(F.col("vec")), 5).alias("length"))


SHOW = ", ".join(f"round(vec[{i + 1}], 5) AS v{i}" for i in range(4)) + ", round(sqrt(list_inner_product(vec, vec)), 5) AS length"
UNITS = "units AS (SELECT id, book, list_transform(vec, lambda x: x / sqrt(list_inner_product(vec, vec))) AS u, vec FROM vecs)"
KNN = f"WITH {Q.VECS}, {UNITS}, sims AS (SELECT a.id, b.id AS neighbor_id, round(list_inner_product(a.u, b.u), 6) AS score FROM units a JOIN units b ON a.id <> b.id), knn AS (SELECT *, (row_number() OVER (PARTITION BY id ORDER BY score DESC, neighbor_id))::int AS rank FROM sims)"


def mean_of(source: str, by: str = "book") -> str:
    return f"SELECT {by}, list(m ORDER BY i) AS vec FROM (SELECT {by}, i, avg(x) AS m FROM (SELECT {by}, unnest(vec) AS x, unnest(range(len(vec))) AS i FROM {source}) GROUP BY {by}, i) GROUP BY {by}"


def unit_of(source: str) -> str:
    return f"SELECT book, list_transform(vec, lambda x: x / (sqrt(list_inner_product(vec, vec)) + 1e-9::double)) AS vec FROM ({source})"


@query(KNN + " SELECT id, neighbor_id, rank, score FROM knn WHERE rank <= 10")
def vector_topk(spark, sf_dir):
    return N.top_k(vectors(spark, sf_dir), 10).select("id", "neighbor_id", "rank", "score")


@query(f"WITH {Q.VECS}, {UNITS}, c AS (SELECT book, list_transform(u, lambda x: x) AS vec FROM units QUALIFY row_number() OVER (PARTITION BY book ORDER BY id) <= 80), m AS ({mean_of('c')}) SELECT book, {SHOW} FROM m")
def centroids(spark, sf_dir):
    return shown(N.centroids(vectors(spark, sf_dir)), "book")


@query(f"""WITH {Q.VECS}, {UNITS}, c AS (SELECT book, u AS vec FROM units QUALIFY row_number() OVER (PARTITION BY book ORDER BY id) <= 80), m AS ({mean_of('c')}),
s AS (SELECT a.book AS id, b.book AS neighbor_id, round(list_inner_product(a.vec, b.vec) / sqrt(list_inner_product(a.vec, a.vec) * list_inner_product(b.vec, b.vec)), 6) AS score FROM m a JOIN m b ON a.book <> b.book)
SELECT id::bigint AS id, neighbor_id::bigint AS neighbor_id, (row_number() OVER (PARTITION BY id ORDER BY score DESC, neighbor_id))::int AS rank FROM s QUALIFY row_number() OVER (PARTITION BY id ORDER BY score DESC, neighbor_id) <= 5""")
def book_topk(spark, sf_dir):
    return N.top_k(N.centroids(vectors(spark, sf_dir)).withColumnRenamed("book", "id"), 5).select("id", "neighbor_id", "rank")


NEAR = f"mu AS ({unit_of(mean_of('vecs'))}), near AS (SELECT v.*, round(list_inner_product(v.vec, mu.vec), 6) AS sim, count(*) OVER (PARTITION BY v.book) AS n FROM vecs v JOIN mu USING (book)), rk AS (SELECT *, row_number() OVER (PARTITION BY book ORDER BY sim DESC, id) AS r FROM near)"


@query(f"WITH {Q.VECS}, m AS ({unit_of(mean_of('vecs'))}) SELECT book, {SHOW} FROM m")
def pool_mean(spark, sf_dir):
    return shown(N.pooled(vectors(spark, sf_dir), "mean"), "book")


@query(f"WITH {Q.VECS}, {NEAR}, k AS (SELECT * FROM rk WHERE r <= greatest(1, round_even(0.8::double * n, 0))), m AS ({unit_of(mean_of('k'))}) SELECT book, {SHOW} FROM m")
def pool_trimmed(spark, sf_dir):
    return shown(N.pooled(vectors(spark, sf_dir), "trimmed_mean"), "book")


@query(f"WITH {Q.VECS}, {NEAR}, k AS (SELECT * FROM rk WHERE r <= 10), m AS ({unit_of(mean_of('k'))}) SELECT book, {SHOW} FROM m")
def pool_topk(spark, sf_dir):
    return shown(N.pooled(vectors(spark, sf_dir), "topk_mean"), "book")


@query(f"WITH {Q.VECS}, d AS (SELECT book, list(m ORDER BY i) AS vec FROM (SELECT book, i, quantile_cont(x, 0.5::double) AS m FROM (SELECT book, unnest(vec) AS x, unnest(range(len(vec))) AS i FROM vecs) GROUP BY book, i) GROUP BY book), m AS ({unit_of('SELECT * FROM d')}) SELECT book, {SHOW} FROM m")
def pool_median(spark, sf_dir):
    return shown(N.pooled(vectors(spark, sf_dir), "median"), "book")


@query(f"WITH {Q.VECS} SELECT a.id, round(list_sum(list_transform(list_zip(a.vec, b.vec), lambda p: abs(p[1] - p[2]))), 5) AS gap, round(list_sum(list_transform(list_zip(a.vec, b.vec), lambda p: p[1] * p[2])), 5) AS product, (4 * len(a.vec))::int AS size FROM vecs a JOIN vecs b ON b.id = a.id + 1")
def pair_symmetric_features(spark, sf_dir):
    v = vectors(spark, sf_dir).select("id", "vec")
    pairs = v.join(v.select((F.col("id") - 1).alias("id"), F.col("vec").alias("other")), "id")
    f = pairs.select("id", V.pair_features(F.col("vec"), F.col("other")).alias("f"), F.size("vec").alias("d"))
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda s, x: s + x)
    return f.select("id", F.round(total(F.slice("f", 2 * F.col("d") + 1, F.col("d"))), 5).alias("gap"), F.round(total(F.slice("f", 3 * F.col("d") + 1, F.col("d"))), 5).alias("product"), F.size("f").alias("size"))


@query(KNN + f", book AS (SELECT id, book FROM vecs), k AS (SELECT knn.id AS anchor, a.book, neighbor_id AS item, b.book AS neighbor, score AS sim FROM knn JOIN book a ON a.id = knn.id JOIN book b ON b.id = neighbor_id WHERE rank <= 21 AND a.book <> b.book AND score >= 0.1) SELECT anchor, item, neighbor, (row_number() OVER (PARTITION BY anchor ORDER BY sim DESC, item))::int AS rank FROM k QUALIFY row_number() OVER (PARTITION BY anchor ORDER BY sim DESC, item) <= 20")
def ann_candidates_global(spark, sf_dir):
    return N.global_candidates(vectors(spark, sf_dir), 20, least=0.1).select("anchor", "item", "neighbor", "rank")


ADJACENT = f"""WITH {Q.VECS}, {UNITS}, o AS (SELECT *, row_number() OVER (PARTITION BY book ORDER BY md5('42|' || id), id) AS r FROM units),
s AS (SELECT a.book, b.book AS neighbor, a.id AS anchor, b.id AS item, round(list_inner_product(a.u, b.u), 6) AS sim FROM o a JOIN o b ON b.book = (a.book + 1) % 10 WHERE a.r <= 40 AND b.r <= 20),
c AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY anchor ORDER BY sim DESC, item) = 1)"""


def adjacent(spark, sf_dir):
    edges = vectors(spark, sf_dir).select("book").distinct().select("book", ((F.col("book") + 1) % 10).alias("neighbor"))
    return N.neighbor_candidates(vectors(spark, sf_dir), edges, least=0.1)


@query(ADJACENT + " SELECT book, neighbor, anchor, item, sim FROM c WHERE sim >= 0.1")
def ann_candidates_neighbor(spark, sf_dir):
    return adjacent(spark, sf_dir)


@query(ADJACENT + ", p AS (SELECT book AS book1, anchor, item, sim, round(sim / 2, 6) AS prob FROM c WHERE sim >= 0.1 AND round(sim / 2, 6) <= 0.2) SELECT book1, anchor, item FROM p QUALIFY row_number() OVER (PARTITION BY book1 ORDER BY prob DESC, anchor, item) <= 5")
def mined_negatives(spark, sf_dir):
    c = adjacent(spark, sf_dir).select(F.col("book").alias("book1"), "anchor", "item", "sim", F.round(F.col("sim") / 2, 6).alias("prob"))
    return P.mined(c, least_similarity=0.1, per_book=5).select("book1", "anchor", "item")


SIDES = "sides AS (SELECT book // 2 AS pair_id, book % 2 + 1 AS side, id AS idx, u FROM units), cs AS (SELECT a.pair_id, a.idx AS i, b.idx AS j, round(list_inner_product(a.u, b.u), 6) AS cos FROM sides a JOIN sides b USING (pair_id) WHERE a.side = 1 AND b.side = 2)"


def sides(spark, sf_dir):
    return vectors(spark, sf_dir).select(F.floor(F.col("book") / 2).alias("pair_id"), (F.col("book") % 2 + 1).alias("side"), "idx", "vec")


@query(f"WITH {Q.VECS}, {UNITS}, {SIDES} SELECT pair_id::bigint AS pair_id, round(avg(cos), 5) AS sim, count(*) AS n FROM cs GROUP BY pair_id")
def style_similarity_mean(spark, sf_dir):
    return N.style_similarity(sides(spark, sf_dir), digits=5)


@query(f"WITH {Q.VECS}, {UNITS}, {SIDES} SELECT pair_id::bigint AS pair_id, round(avg(cos), 5) AS sim, count(*) AS n FROM (SELECT * FROM cs QUALIFY row_number() OVER (PARTITION BY pair_id ORDER BY cos DESC, i, j) <= 5) GROUP BY pair_id")
def style_similarity_topk(spark, sf_dir):
    return N.style_similarity(sides(spark, sf_dir), "topk_mean", 5).withColumn("sim", F.round("sim", 5))


@query(KNN + " SELECT id, round(sum(1 - score), 6) AS score_of_ten FROM knn WHERE rank <= 10 GROUP BY id")
def knn_outlier(spark, sf_dir):
    return N.outlier_scores(vectors(spark, sf_dir)).select("id", F.round(10 * F.col("score"), 6).alias("score_of_ten"))


@query(KNN + ", s AS (SELECT id, avg(1 - score) AS score FROM knn WHERE rank <= 10 GROUP BY id) SELECT id FROM s WHERE score <= (SELECT quantile_cont(score, 0.95::double) FROM s)")
def prune_quantile(spark, sf_dir):
    return N.quantile_pruned(N.outlier_scores(vectors(spark, sf_dir)), 0.05).select("id")


HALF = f"""WITH {Q.VECS}, {UNITS}, few AS (SELECT * FROM units), low AS (SELECT id, vec[1:8] AS vec FROM few)"""
DIST = "(-round(sqrt(greatest(list_sum(list_transform(list_zip(a.vec, b.vec), lambda p: (p[1] - p[2]) * (p[1] - p[2]))), 0)), 6))"


def lowered(spark, sf_dir):
    few = vectors(spark, sf_dir).select("id", "vec")
    return few, few.select("id", F.slice("vec", 1, 8).alias("vec"))


@query(HALF + f""", kx AS (SELECT a.id, b.id AS j FROM few a JOIN few b ON a.id <> b.id QUALIFY row_number() OVER (PARTITION BY a.id ORDER BY round(list_inner_product(a.u, b.u), 6) DESC, b.id) <= 15),
ky AS (SELECT a.id, b.id AS j FROM low a JOIN low b ON a.id <> b.id QUALIFY row_number() OVER (PARTITION BY a.id ORDER BY {DIST} DESC, b.id) <= 15)
SELECT round((SELECT count(*) FROM kx JOIN ky USING (id, j)) / (15.0::double * (SELECT count(*) FROM few)), 6) AS nhit""")
def nhit_rate(spark, sf_dir):
    return N.hit_rate(*lowered(spark, sf_dir)).select(F.round("nhit", 6).alias("nhit"))


@query(HALF + f""", rx AS (SELECT a.id, b.id AS j, row_number() OVER (PARTITION BY a.id ORDER BY {DIST} DESC, b.id) AS r FROM few a JOIN few b ON a.id <> b.id),
ky AS (SELECT a.id, b.id AS j FROM low a JOIN low b ON a.id <> b.id QUALIFY row_number() OVER (PARTITION BY a.id ORDER BY {DIST} DESC, b.id) <= 15), n AS (SELECT count(*) AS n FROM few)
SELECT round((1 - 2.0::double / ((SELECT n * 15 * (2 * n - 46) FROM n)) * sum(greatest(r - 15, 0)))::double, 6) AS trust FROM ky JOIN rx USING (id, j)""")
def trustworthiness(spark, sf_dir):
    return N.trustworthiness(*lowered(spark, sf_dir)).select(F.round("trust", 6).alias("trust"))


@query(f"""WITH {Q.VECS}, f AS (SELECT * FROM vecs), d AS (SELECT a.id AS i, b.id AS j, greatest(list_inner_product(a.vec, a.vec) + list_inner_product(b.vec, b.vec) - 2 * list_inner_product(a.vec, b.vec), 0) AS d2, (a.book = b.book)::int::double AS l FROM f a, f b),
m AS (SELECT list_sort(list(d2))[(count(*) + 1) // 2] AS m FROM d WHERE i <> j AND d2 > 0), k AS (SELECT i, j, l, exp(-d2 / (2 * (m + 1e-6::double))) AS k FROM d, m),
c AS (SELECT (k - avg(k) OVER (PARTITION BY i) - avg(k) OVER (PARTITION BY j) + avg(k) OVER ()) * (l - avg(l) OVER (PARTITION BY i) - avg(l) OVER (PARTITION BY j) + avg(l) OVER ()) AS x FROM k)
SELECT round(sum(x) / ((SELECT count(*)::double * count(*) FROM f) + 1e-6::double), 7) AS hsic FROM c""")
def rbf_hsic(spark, sf_dir):
    rows = vectors(spark, sf_dir).select("id", "vec", F.col("book").alias("label"))
    return N.kernel_dependence(rows).select(F.round("hsic", 7).alias("hsic"))


@query()
def pca(spark, sf_dir):
    placed = Z.pca_layout(vectors(spark, sf_dir), 2)
    return placed.select("id", F.round(F.abs(F.col("xy")[0]), 4).alias("x"), F.round(F.abs(F.col("xy")[1]), 4).alias("y"))


@query()
def remove_top_pcs(spark, sf_dir):
    return Z.without_top_components(vectors(spark, sf_dir), 2).select("id", F.round(V.norm(F.col("vec")), 4).alias("length"))


@query()
def kmeans(spark, sf_dir):
    return Z.clusters(vectors(spark, sf_dir), 12, starts=3)


@query()
def style_map(spark, sf_dir):
    """A row a vector: the map in three dimensions (its x, y are the map in two); outliers have no place and no cluster."""
    items = vectors(spark, sf_dir).select("id", "vec")
    placed = Z.style_map(items, dimensions=3, prune=0.05, remove=1, k=6)
    axes = [F.round(F.col(a), 4).alias(a) for a in "xyz"]
    return items.select("id").join(placed, "id", "left").select("id", *axes, "cluster", F.col("cluster").isNotNull().alias("kept"))
