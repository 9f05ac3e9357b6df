import json
import math

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from quillon.operators import calibration, catalog, chunks, corpus_map, metrics, neighbors, pairs, ranking, scoring
from quillon.plans import pair_queries, vector_queries
from quillon.sources import files, sinks, staging
from quillon.streaming import ingest


def scored(spark, rows):
    return spark.createDataFrame([(i, y, float(s)) for i, (y, s) in enumerate(rows)], "id long, label int, score double")


def test_global_rank(spark):
    df = spark.range(500).select(F.col("id").cast("string").alias("k"))
    got = ranking.global_rank(df, F.md5("k"), F.col("k")).collect()
    import hashlib

    order = sorted((hashlib.md5(str(i).encode()).hexdigest(), str(i)) for i in range(500))
    assert {r.k: r["rank"] for r in got} == {k: i + 1 for i, (_, k) in enumerate(order)}


def test_dedup_threshold(spark):
    rows = [(f"b{b}", "a", b, i, t) for b in range(4) for i, t in enumerate(["every book", "every book", f"own {b}"] + (["three books"] if b else []))]
    df = chunks.with_fingerprints(spark.createDataFrame(rows, "book_id string, author string, doc_id int, idx int, chunk string"))
    kept = [r.chunk for r in chunks.deduplicated(df).collect()]
    assert kept.count("three books") == 3 and "every book" not in kept and len(kept) == 7


def test_split_sizes(spark):
    books = spark.range(90).select(F.col("id").cast("string").alias("book_id"))
    got = {r.split: r["count"] for r in chunks.split_books(books).groupBy("split").count().collect()}
    assert got == {"train": math.floor(90 * 0.7), "validation": 13, "test": 90 - math.floor(90 * 0.7) - 13}


def corpus(spark):
    rows = [(f"a{b % 4}/{b}", f"a{b % 4}" if b % 4 else "anonymous", b, i, f"text {b} {i}") for b in range(16) for i in range(1 + b % 3)]
    df = chunks.positioned(spark.createDataFrame(rows, "book_id string, author string, doc_id int, idx int, chunk string"))
    return df.withColumn("split", F.when(F.col("doc_id") < 10, "train").otherwise("test"))


def test_pairs_keep_to_their_split(spark):
    c = corpus(spark)
    split = {r.book_id: (r.split, r.author) for r in c.collect()}
    pos = pairs.positives(c).collect()
    assert pos and all(r.book1 == r.book2 and r.pos1 != r.pos2 for r in pos)
    edges = spark.createDataFrame([("a1/1", "a2/2"), ("a1/1", "a3/15"), ("a2/2", "a2/2")], "book_id string, neighbor_id string")
    neg = pairs.negatives(c, edges).collect()
    assert neg and all(r.book1 != r.book2 and split[r.book1][0] == split[r.book2][0] == r.split for r in neg)
    assert all(split[r.book1][1] != "anonymous" and r.same_author for r in neg if r.neg_type == "author_same")
    assert {(r.book1, r.book2) for r in neg if r.neg_type == "embed_neighbor"} == {("a1/1", "a2/2")}
    assert pairs.negatives(c.where("doc_id = 1")).count() == 0


def test_ranking_metrics(spark):
    tied = scored(spark, [(1, 0.5), (0, 0.5), (1, 0.5), (0, 0.5)])
    assert metrics.roc_auc(tied).first().auc == 0.5
    assert math.isnan(metrics.roc_auc(scored(spark, [(1, 0.1), (1, 0.4)])).first().auc)
    rng = np.random.default_rng(1)
    rows = [(int(rng.random() < 0.4), round(rng.random(), 1)) for _ in range(200)]
    p, n = [s for y, s in rows if y], [s for y, s in rows if not y]
    auc = sum((a > b) + 0.5 * (a == b) for a in p for b in n) / len(p) / len(n)
    ap, seen = 0.0, 0
    for t in sorted({s for _, s in rows}, reverse=True):
        hit = sum(s >= t for s in p)
        ap += (hit - seen) / len(p) * hit / sum(s >= t for _, s in rows)
        seen = hit
    df = scored(spark, rows)
    assert metrics.roc_auc(df).first().auc == pytest.approx(auc)
    assert metrics.average_precision(df).first().ap == pytest.approx(ap)


def test_ece_edges(spark):
    assert metrics.ece(scored(spark, [(1, 0.3), (0, 0.3)])).first().ece == 0.0
    assert math.isnan(metrics.ece(scored(spark, []), strategy="fixed").first().ece)
    assert metrics.ece(scored(spark, [(1, 1.0), (1, 1.0)]), strategy="fixed").first().ece == 0.0


def test_threshold_choice(spark):
    sweep = metrics.threshold_sweep(scored(spark, [(1, 0.9), (1, 0.8), (0, 0.2)]))
    best = metrics.best_threshold(sweep).first()
    assert best.accuracy == 1.0 and best.threshold == pytest.approx(0.21)
    assert metrics.best_threshold(sweep, target_accuracy=2.0).first().accuracy == 1.0


def test_isotonic_ends(spark):
    df = spark.createDataFrame([(x,) for x in (-1.0, 0.0, 0.5, 1.0, 2.0)], "x double")
    got = [r.y for r in df.select(calibration.apply_isotonic(F.col("x"), [0.0, 1.0], [0.2, 0.8]).alias("y")).collect()]
    assert got == pytest.approx([0.2, 0.2, 0.5, 0.8, 0.8])


def test_temperature(spark):
    rng = np.random.default_rng(2)
    z = rng.normal(size=2000)
    y = (rng.random(2000) < 1 / (1 + np.exp(-z))).astype(int)
    df = spark.createDataFrame([(int(a), 0.0, float(3 * b)) for a, b in zip(y, z, strict=True)], "label int, logit0 double, logit1 double")
    assert calibration.fit_temperature(df) == pytest.approx(3.0, rel=0.15)


def vectors(spark, n=40, d=6):
    x = np.random.default_rng(3).normal(size=(n, d))
    return x, spark.createDataFrame([(i, i % 4, i, [float(v) for v in r]) for i, r in enumerate(x)], "id long, book int, idx int, vec array<double>")


def test_top_k(spark, monkeypatch):
    x, df = vectors(spark)
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    s = np.round(u @ u.T, 6)
    np.fill_diagonal(s, -9)
    expected = {(i, j) for i in range(40) for j in sorted(range(40), key=lambda j: (-s[i, j], j))[:5]}
    assert {(r.id, r.neighbor_id) for r in neighbors.top_k(df, 5).collect()} == expected
    monkeypatch.setattr(neighbors, "BLOCK_BYTES", 500)
    assert {(r.id, r.neighbor_id) for r in neighbors.top_k(df, 5).collect()} == expected
    assert neighbors.top_k(df, 100).count() == 40 * 39


@pytest.mark.parametrize("method", ["mean", "median", "topk_mean", "trimmed_mean"])
def test_pooling(spark, method):
    x, df = vectors(spark)
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    df = spark.createDataFrame([(i % 4, i, [float(v) for v in r]) for i, r in enumerate(u)], "book int, idx int, vec array<double>")
    got = {r.book: np.array(r.vec) for r in neighbors.pooled(df, method, keep=3).collect()}
    for b in range(4):
        a = u[b::4]
        mu = a.mean(0) / np.linalg.norm(a.mean(0))
        near = a[np.argsort(-(a @ mu))]
        v = {"mean": a.mean(0), "median": np.median(a, 0), "topk_mean": near[:3].mean(0), "trimmed_mean": near[: round(0.8 * len(a))].mean(0)}[method]
        assert got[b] == pytest.approx(v / np.linalg.norm(v), abs=1e-6)


def test_map(spark):
    x, df = vectors(spark)
    placed = {r.id: r.xy for r in corpus_map.pca_layout(df, 2).collect()}
    c = x - x.mean(0)
    _, _, v = np.linalg.svd(c, full_matrices=False)
    assert np.abs([placed[i] for i in range(40)]) == pytest.approx(np.abs(c @ v[:2].T), abs=1e-6)
    left = np.array([r.vec for r in corpus_map.without_top_components(df, 2).orderBy("id").collect()])
    assert left == pytest.approx(c - c @ v[:2].T @ v[:2], abs=1e-6)
    assert corpus_map.pruned(df.select("id", "vec"), 0.1).count() == 36
    with pytest.raises(ValueError):
        corpus_map.layout(df, "other")


def test_titles(spark):
    rows = [
        (1, "Author: X\nTitle: The Book\n\ntext"),
        (2, "x\n\nTHE OLD MILL HOUSE\n\nby Jane\n\ntext goes on here"),
        (3, "some line of text here\nmore"),
        (4, ""),
        (5, "This is Project Gutenberg's Red Stones, by A. Person\nx"),
    ]
    got = {r.doc_id: (r.title, r.confidence) for r in catalog.titles(spark.createDataFrame(rows, "doc_id int, text string")).collect()}
    assert got == {1: ("The Book", "high"), 2: ("THE OLD MILL HOUSE", "medium"), 3: ("some line of text here", "low"), 4: (None, "low"), 5: ("Red Stones", "high")}
    plan = {r.doc_id: (r.new, r.error) for r in catalog.rename_plan(spark.createDataFrame(rows, "doc_id int, text string"), least="medium").collect()}
    assert plan[1] == ("the_book.txt", None) and plan[3] == (None, "low_confidence") and plan[4] == (None, "no_title_found")


def test_sources_and_sinks(spark, tmp_path):
    tree = tmp_path / "tree" / "dom" / "ann"
    tree.mkdir(parents=True)
    (tree / "one.txt").write_text("First text.")
    (tree / "two.txt").write_bytes(b"bad \xff byte")
    (tree / "topics.json").write_text('{"one": "sea"}')
    root = str(tmp_path / "tree")
    assert {r.book_id for r in files.books(spark, root).collect()} == {"ann/one", "ann/two"}
    assert files.count_texts(spark, root) == 2
    assert {(r.domain, r.doc, r.topic) for r in files.domain_tree(spark, root).collect()} == {("dom", "one.txt", "sea"), ("dom", "two.txt", "")}
    assert {r.text for r in files.lenient_texts(spark, root).collect()} == {"First text.", "bad  byte"}
    (tmp_path / "shard.jsonl").write_text('{"book_id":"b","chunks":["x"]}\nbroken\n{"chunks":["y"]}\n{"book_id":"b","chunks":["z"]}\n')
    assert [r.chunks for r in files.shards(spark, str(tmp_path / "shard.jsonl")).collect()] == [["z"]]
    (tmp_path / "pairs.csv").write_text('t1,t2,y,author,extra\n"a ""q""\nb",c,2,p,1\nd,e,x,,2\n')
    got = [tuple(r) for r in files.pairs_csv(spark, str(tmp_path / "pairs.csv")).collect()]
    assert got == [('a "q"\nb', "c", 1, "p", "1"), ("d", "e", 0, None, "2")]
    (tmp_path / "empty.csv").write_text("t1,t2,y\n")
    with pytest.raises(ValueError):
        files.pairs_csv(spark, str(tmp_path / "empty.csv"))
    (tmp_path / "topics.txt").write_text("one\n\ntwo\n")
    (tmp_path / "topics.json").write_text('["a", "b"]')
    assert [r.topic for r in files.topics(spark, str(tmp_path / "topics.txt")).collect()] == ["one", "two"]
    assert [r.topic for r in files.topics(spark, str(tmp_path / "topics.json")).collect()] == ["a", "b"]
    stats = sinks.write_shards(spark.createDataFrame([("b", 1, "y"), ("b", 0, "x")], "book_id string, idx int, chunk string"), str(tmp_path / "out"))
    assert tuple(stats.first()) == (1, 2)
    sinks.write_calibration(spark, {"method": "logistic", "coef": 1.0}, str(tmp_path / "cal"))
    assert sinks.read_calibration(spark, str(tmp_path / "cal"))["coef"] == 1.0
    table = metrics.percentile_table(scored(spark, [(1, 0.2), (0, 0.4)]).withColumn("domain", F.lit("d")))
    value = json.loads(sinks.reference_json(table).first().value)
    assert value["global"]["positive"]["mean"] == 0.2 and value["by_domain"]["d"]["negative"]["median"] == 0.4


def test_stream(spark, tmp_path):
    sentence = "The ship that was at sea went on with the wind and the crew of it. "
    (tmp_path / "in" / "ann").mkdir(parents=True)
    (tmp_path / "in" / "ann" / "one.txt").write_text(sentence * 30)
    for _ in range(2):
        ingest.ingest(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "check")).awaitTermination()
    n = spark.read.parquet(str(tmp_path / "out")).count()
    (tmp_path / "in" / "bob").mkdir()
    (tmp_path / "in" / "bob" / "two.txt").write_text(sentence * 30)
    ingest.ingest(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "check")).awaitTermination()
    assert n > 0 and spark.read.parquet(str(tmp_path / "out")).count() == 2 * n


def test_similarity_and_benchmark(spark):
    text = "The river ran through the old town and the people were walking along it. " * 4
    pairs_ = spark.createDataFrame([("same", text, text), ("other", text, "Numbers 1 2 3 4 5 6 7 8 9 all day in a row of things."), ("blank", text, " ")], "pair_id string, text1 string, text2 string")
    got = {r.pair_id: r.sim for r in scoring.text_similarity(pairs_).collect()}
    assert got["same"] == pytest.approx(1.0) and got["other"] < 0.9 and "blank" not in got
    answers = spark.createDataFrame([(0, "short"), (1, text), (2, text[:80])], "key long, output string")
    excerpts = spark.createDataFrame([(1, text), (2, text)], "excerpt_id long, text string")
    rows, total = scoring.benchmark(excerpts, scoring.LookupGenerator(answers), ["sea", "war"])
    assert rows.count() == 6 and total.first().n == 6


def test_fetch(spark):
    from quillon.sources.fetch import fetched

    def get(url):
        if "down" in url:
            raise OSError
        return (200, "<html>" if "page" in url else f"text of {url}") if "gone" not in url else (404, "")

    rows = [(1, 0, "gone"), (1, 1, "good"), (2, 0, "down"), (2, 1, "page"), (3, 0, "a"), (3, 1, "b")]
    got = {r.id: (r.url, r.text, r.tries) for r in fetched(spark.createDataFrame(rows, "id long, at int, url string"), get, wait=0.0).collect()}
    assert got == {1: ("good", "text of good", 2), 2: (None, None, 4), 3: ("a", "text of a", 1)}


def test_unique_names_avoid_given_taken_and_made(spark):
    def named(names, taken=()):
        rows = spark.createDataFrame(list(enumerate(names)), "i int, name string")
        known = spark.createDataFrame([(t,) for t in taken], "name string")
        return [r.unique for r in catalog.unique_names(rows, "name", "i", known).orderBy("i").collect()]

    assert named(["a.txt", "a.txt", "a_1.txt"]) == ["a.txt", "a_2.txt", "a_1.txt"]
    assert named(["a.txt"] * 4, ["a.txt", "a_2.txt", "a_1.txt"]) == ["a_3.txt", "a_4.txt", "a_5.txt", "a_6.txt"]
    assert named(["a.txt", "a.txt", "a_1.txt", "a_1.txt", "a_1_1.txt"]) == ["a.txt", "a_2.txt", "a_1.txt", "a_1_2.txt", "a_1_1.txt"]
    assert named([]) == []
    many = ["x.txt"] * 30 + [f"x_{k}.txt" for k in range(1, 40, 3)] * 2
    got = named(many, ["x_2.txt", "x_50.txt"])
    assert len(set(got)) == len(got) and not {"x_2.txt", "x_50.txt"} & set(got)


def test_titles_take_an_article_above_a_blank_line(spark):
    docs = spark.createDataFrame([(1, "THE\n\nSILVER RIVER\nBy John Smith\n"), (2, "THE\nSILVER RIVER\nby John Smith\n"), (3, "x\n\nSILVER RIVER\nby John Smith")], "doc_id int, text string")
    got = {r.doc_id: r.title for r in catalog.titles(docs).collect()}
    assert got == {1: "THE SILVER RIVER", 2: "THE SILVER RIVER", 3: "SILVER RIVER"}


def test_book_statuses(spark):
    long = "This is a sentence of the book that has some words in it. " * 20
    books = spark.createDataFrame([("a/1", "a", 1, long), ("a/2", "a", 2, "short"), ("a/3", "a", 3, None)], "book_id string, author string, doc_id int, text string")
    assert {r.book_id: (r.status, r.n_chunks > 0) for r in chunks.statuses(books).collect()} == {"a/1": ("ok", True), "a/2": ("empty", False), "a/3": ("error", False)}


def test_mirror_of_cleaned_texts(spark, tmp_path):
    books = spark.createDataFrame([("A", "one", "text  \n\n\n\nmore"), ("B", "two", "\r\nx")], "author string, title string, text string")
    report = {r.title: (r.author, r.n_before, r.n_after) for r in sinks.write_cleaned(books, f"{tmp_path}/m").collect()}
    assert report == {"one": ("A", 14, 11), "two": ("B", 3, 2)}
    assert {r.title: r.text for r in spark.read.parquet(f"{tmp_path}/m").collect()} == {"one": "text\n\nmore\n", "two": "x\n"}


def test_neighbors_in_small_blocks(spark, monkeypatch):
    rng = np.random.default_rng(8)
    x = rng.integers(-2, 3, (40, 3)).astype(float)
    items = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, vec array<double>").repartition(3)
    d = np.round(np.sqrt(((x[:, None] - x[None]) ** 2).sum(2)), 6)
    order = {i: sorted((j for j in range(40) if j != i), key=lambda j: (d[i, j], j)) for i in range(40)}
    monkeypatch.setattr(neighbors, "BLOCK_BYTES", 300)
    monkeypatch.setattr(neighbors, "CELLS", 50)
    got = {}
    for r in neighbors.top_k(items, 4, metric="euclidean").collect():
        got.setdefault(r.id, {})[r["rank"]] = r.neighbor_id
    assert {i: [v[k] for k in sorted(v)] for i, v in got.items()} == {i: o[:4] for i, o in order.items()}
    pairs_ = spark.createDataFrame([(i, j) for i in range(0, 40, 7) for j in range(40) if i != j], "id long, neighbor_id long")
    assert all(r["rank"] == order[r.id].index(r.neighbor_id) + 1 for r in neighbors.ranks_of(items, pairs_).collect())


def test_ordered_places(spark):
    rows = spark.createDataFrame([("train" if i % 10 < 7 else "test", f"b{i:04}") for i in range(300)], "split string, book string").repartition(7)
    got = ranking.ordered_place(rows, "split", "book", "at").collect()
    for split in ("train", "test"):
        own = sorted(r.book for r in got if r.split == split)
        assert {r.book: (r["at"], r["_n"]) for r in got if r.split == split} == {b: (i, len(own)) for i, b in enumerate(own)}


def test_quantiles(spark):
    rows = [("hot", float(i * i % 97)) for i in range(500)] + [("one", 4.0), ("two", -1.0), ("two", 2.0), ("nulls", None), ("ties", 1.0), ("ties", 1.0), ("ties", None)]
    df = spark.createDataFrame(rows, "g string, x double")
    levels = [0.0, 1 / 15, 0.5, 0.95, 1.0]
    got = {r.g: r.q for r in ranking.quantiles(df, "g", "x", levels).collect()}
    assert set(got) == {"hot", "one", "two", "ties"}
    for g, q in got.items():
        assert q == pytest.approx(np.quantile([x for h, x in rows if h == g and x is not None], levels).tolist())
    assert ranking.quantiles(df.limit(0), "g", "x", levels).count() == 0


def test_quantiles_to_the_last_bit(spark):
    """Bins are closed at their edges, so an edge between equal scores must be that score."""
    values = [round(0.4 + (i * 7919 % 401) / 1000, 3) for i in range(2000)]
    levels = [i / 15 for i in range(16)]
    df = spark.createDataFrame([("all", x) for x in values], "g string, x double")
    got = ranking.quantiles(df, "g", "x", levels).first().q
    con = duckdb.connect()
    con.execute("CREATE TABLE t (x double)")
    con.execute(f"INSERT INTO t SELECT unnest({values!r}::double[])")
    assert got == con.execute("SELECT quantile_cont(x, [" + ", ".join(f"{i}::double / 15" for i in range(16)) + "]) FROM t").fetchall()[0][0]
    ordered, at = sorted(values), [(len(values) - 1) * q for q in levels]
    inside = [(q, ordered[int(p)]) for p, q in zip(at, got, strict=True) if ordered[int(p)] == ordered[min(int(p) + 1, len(values) - 1)]]
    assert len(inside) > 5 and all(q == x for q, x in inside)


def sided(spark, n=90, d=5):
    x = np.round(np.random.default_rng(3).normal(size=(n, d)), 3)
    x[7], x[8] = 0.0, x[9]
    rows = [(f"p{i % 2}", 1 + i % 3 % 2, i, x[i].tolist()) for i in range(n)] + [("alone", 1, n, x[0].tolist()), ("p0", 2, n + 1, None)]
    u = np.divide(x, np.linalg.norm(x, axis=1, keepdims=True), out=np.zeros_like(x), where=x.any(1)[:, None])
    cos = {p: np.round(u[[i for g, s, i, v in rows if g == p and s == 1 and v]] @ u[[i for g, s, i, v in rows if g == p and s == 2 and v]].T, 6) for p in ("p0", "p1")}
    return spark.createDataFrame(rows, "pair_id string, side int, idx int, vec array<double>"), cos


def test_style_similarity_topk_by_blocks(spark, monkeypatch):
    monkeypatch.setattr(neighbors, "SIDE_BYTES", 8 * 5 * 7)  # seven vectors a block
    df, cos = sided(spark)
    found = neighbors.style_similarity(df, "topk_mean", 5)
    assert "FlatMapCoGroupsInArrow" in found._jdf.queryExecution().toString()  # no row for each pair of chunks
    got = {r.pair_id: (r.sim, r.n) for r in found.collect()}
    assert got == {p: (pytest.approx(np.sort(c.ravel())[-5:].mean(), abs=1e-9), 5) for p, c in cos.items()}


def test_percentiles_without_labels_or_scores(spark):
    df = spark.createDataFrame([("a", None, 0.5), (None, 1, 0.25), ("a", 1, float("nan")), ("a", 1, None)], "domain string, label int, score double")
    got = {(r.domain, r.label): (r.n, r.median, r.p99) for r in metrics.percentile_table(df).collect()}
    assert got == {(None, None): (1, 0.5, 0.5), ("a", None): (1, 0.5, 0.5), (None, 1): (1, 0.25, 0.25), ("unknown", 1): (1, 0.25, 0.25)}
    assert metrics.benchmark_aggregate(df.limit(0), ["score"]).collect() == [(0, None, None)]
    assert metrics.reliability(df.limit(0)).count() == 0 and neighbors.quantile_pruned(df.limit(0), 0.1).count() == 0


def test_style_similarity_mean_by_blocks(spark, monkeypatch):
    monkeypatch.setattr(neighbors, "SIDE_BYTES", 8 * 5 * 7)
    df, cos = sided(spark)
    found = neighbors.style_similarity(df)
    assert "FlatMapCoGroupsInArrow" in found._jdf.queryExecution().toString()
    assert {r.pair_id: (r.sim, r.n) for r in found.collect()} == {p: (pytest.approx(c.mean(), abs=1e-9), c.size) for p, c in cos.items()}
    assert neighbors.style_similarity(df.where("side = 1")).count() == 0


def test_style_similarity_rounded_meets_only_unclear_pairs(spark, monkeypatch):
    """Where the mean vectors settle the rounded mean no chunks meet; near a turn of the rounding the rounded cosines decide."""
    df, cos = sided(spark)
    met = []
    blocks = neighbors.block_pairs
    monkeypatch.setattr(neighbors, "block_pairs", lambda rows, *a: met.append({r.pair_id for r in rows.collect()}) or blocks(rows, *a))
    got = {r.pair_id: (r.sim, r.n) for r in neighbors.style_similarity(df, digits=3).collect()}
    assert got == {p: (round(float(c.mean()), 3), c.size) for p, c in cos.items()} and not met
    c = 0.0249996  # rounds to 0.025, so the mean of both is 0.0125, which is 0.013; that of the cosines is below
    turn = [("p0", 1, 0, [1.0, 0.0]), ("p0", 2, 1, [c, (1 - c * c) ** 0.5]), ("p0", 2, 2, [0.0, 1.0]), ("sure", 1, 3, [1.0, 0.0]), ("sure", 2, 4, [0.6, 0.8]), ("sure", 2, 5, [0.6, 0.8])]
    rows = spark.createDataFrame(turn, "pair_id string, side int, idx int, vec array<double>")
    got = {r.pair_id: (r.sim, r.n) for r in neighbors.style_similarity(rows, digits=3).collect()}
    assert got == {"p0": (0.013, 2), "sure": (0.6, 2)} and met == [{"p0"}]
    odd = spark.createDataFrame([("p", 1, 0, [float("nan"), 1.0]), ("p", 2, 1, [1.0, 0.0])], "pair_id string, side int, idx int, vec array<double>")
    assert neighbors.style_similarity(odd, digits=3).first() == neighbors.style_similarity(odd).first()


def test_negatives_read_chunks_for_both_sides_only(spark):
    """Books, neighbours and draws are tables of their own; the driver's plan does not repeat the chunks for each use of them."""
    rows = [(f"b{i:02d}", f"a{i % 3}", "train", p, 3, f"text {i} {p}", 0) for i in range(12) for p in range(3)]
    chunks = spark.createDataFrame(rows, "book_id string, author string, split string, pos int, n int, chunk string, topic int").repartition(3, "book_id")
    edges = spark.createDataFrame([(f"b{i:02d}", f"b{(i + j) % 12:02d}") for i in range(12) for j in (0, 1, 5)], "book_id string, neighbor_id string")
    found = pairs.negatives(chunks, edges, per_book=10)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("LogicalRDD") + plan.count("LocalRelation") <= 2
    assert "Broadcast" not in found._jdf.queryExecution().sparkPlan().toString()
    got = found.collect()
    assert len(got) == 120 and len({(r.book1, r.k) for r in got}) == 120
    near = {(f"b{i:02d}", f"b{(i + j) % 12:02d}") for i in range(12) for j in (1, 5)}
    kinds = {k: [(r.book1, r.book2) for r in got if r.neg_type == k] for k in pairs.KINDS}
    assert all(kinds.values()) and set(kinds["embed_neighbor"]) <= near and all(a != b for k in kinds.values() for a, b in k)
    assert all(int(a[1:]) % 3 == int(b[1:]) % 3 for a, b in kinds["author_same"])
    assert all(r.text1 == f"text {int(r.book1[1:])} {r.pos1}" and r.text2 == f"text {int(r.book2[1:])} {r.pos2}" for r in got)


def test_neg_type_hist_keeps_no_text(spark, tmp_path, monkeypatch):
    """Kinds are counted where they are drawn: no chunk's text is written, and both sides' chunks are not joined."""
    monkeypatch.setattr(staging, "shared_dir", lambda _: f"file://{tmp_path}")
    found = pair_queries.neg_type_hist(spark, "/root/testdata/sf0.001")
    assert found.agg(F.sum("n")).first()[0] > 0
    written = {p.name.rsplit("-", 1)[0]: set(spark.read.parquet(str(p)).columns) for p in (tmp_path / "quillon").iterdir()}
    assert {"books", "near-books", "drawing-books"} <= set(written)
    assert not set.union(*written.values()) & {"chunk", "text", "topic"}
    assert "pos1" not in found._jdf.queryExecution().optimizedPlan().toString()


def test_kernel_dependence_by_blocks(spark, monkeypatch):
    """Copies, one very common vector and several blocks; no row for each pair."""
    rng = np.random.default_rng(4)
    x = np.concatenate([rng.normal(size=(40, 5)), np.repeat(rng.normal(size=(1, 5)), 30, 0)])
    x[50:60] = x[:10]
    label = rng.integers(0, 3, len(x))
    d2 = ((x[:, None] - x[None]) ** 2).sum(-1)
    positive = np.sort(d2[d2 > 0])
    k, same = np.exp(-d2 / (2 * (positive[(len(positive) + 1) // 2 - 1] + 1e-6))), (label[:, None] == label[None]).astype(float)
    h = np.eye(len(x)) - 1 / len(x)
    expected = ((h @ k @ h) * (h @ same @ h)).sum() / (len(x) ** 2 + 1e-6)
    df = spark.createDataFrame([(i, v.tolist(), int(g)) for i, (v, g) in enumerate(zip(x, label, strict=True))], "id long, vec array<double>, label int")
    for size, few in ((8 * 5 * 16, 1 << 20), (8 * 5 * 100, 1)):
        monkeypatch.setattr(neighbors, "SIDE_BYTES", size)
        monkeypatch.setattr(neighbors, "FEW", few)
        found = neighbors.kernel_dependence(df)
        assert "CartesianProduct" not in (plan := found._jdf.queryExecution().toString()) and "NestedLoop" not in plan
        assert found.first().hsic == pytest.approx(expected, abs=1e-12)
    assert neighbors.kernel_dependence(df.limit(1)).first().hsic is None


@pytest.mark.parametrize("metric", ["cosine", "euclidean"])
def test_search_by_blocks_sends_lists_only(spark, monkeypatch, metric):
    """Copies, ties by id, a vector without length; several blocks of items, and no window over all tasks' lists."""
    rng = np.random.default_rng(6)
    x = np.round(rng.normal(size=(150, 4)), 1)
    x[20:60], x[5] = x[70], 0.0
    u = np.divide(x, np.linalg.norm(x, axis=1, keepdims=True), out=np.zeros_like(x), where=x.any(1)[:, None])
    score = np.round(u @ u.T if metric == "cosine" else -np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1)), 6)
    expected = {(i, r + 1): j for i in range(150) for r, j in enumerate(sorted((j for j in range(150) if j != i), key=lambda j: (-score[i, j], j))[:7])}
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, vec array<double>").repartition(3)
    monkeypatch.setattr(neighbors, "TASK_CELLS", 4000)
    for size, cells in ((64 << 20, 1 << 22), (8 * 4 * 40, 256)):
        monkeypatch.setattr(neighbors, "BLOCK_BYTES", size)
        monkeypatch.setattr(neighbors, "CELLS", cells)
        found = neighbors.top_k(df, 7, metric=metric)
        assert "Window" not in found._jdf.queryExecution().toString()
        assert {(r.id, r["rank"]): r.neighbor_id for r in found.collect()} == expected


def test_ranks_by_blocks(spark, monkeypatch):
    x = np.round(np.random.default_rng(7).normal(size=(90, 3)), 1)
    x[10:30] = x[40]
    d = np.round(np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1)), 6)
    asked = [(i, (i + s) % 90) for i in range(90) for s in (1, 7, 30)]
    expected = {(i, j): 1 + sum((d[i, o], o) < (d[i, j], j) for o in range(90) if o != i) for i, j in asked}
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, vec array<double>")
    pairs = spark.createDataFrame(asked, "id long, neighbor_id long")
    for size in (64 << 20, 8 * 3 * 25):
        monkeypatch.setattr(neighbors, "BLOCK_BYTES", size)
        assert {(r.id, r.neighbor_id): r["rank"] for r in neighbors.ranks_of(df, pairs).collect()} == expected


def test_style_map_searches_outliers_once(spark, monkeypatch):
    plain = neighbors._best
    counted = spark.sparkContext.accumulator(0)

    def best(*args):
        counted.add(1)
        yield from plain(*args)

    monkeypatch.setattr(neighbors, "_best", best)
    x = np.random.default_rng(8).normal(size=(60, 4))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, vec array<double>")
    found = corpus_map.style_map(df, prune=0.05, remove=1, k=3)
    assert found.count() == 57 and {r.cluster for r in found.collect()} == {0, 1, 2}
    assert counted.value == 1


def test_style_map_clears_then_prunes(spark):
    rng = np.random.default_rng(9)
    x = rng.normal(size=(80, 5)) * 0.3
    x[:, 0] += np.where(np.arange(80) % 2 == 0, 9, -9)  # hides what lies apart in the others
    x[::20, 1] += 4 * rng.normal(size=4)
    c = x - x.mean(0)
    first = np.linalg.svd(c, full_matrices=False)[2][:1]
    left = c - c @ first.T @ first
    u = left / np.linalg.norm(left, axis=1, keepdims=True)
    sims = np.round(u @ u.T, 6)
    np.fill_diagonal(sims, -np.inf)
    scores = (1 - np.sort(sims, axis=1)[:, -10:]).mean(1)
    kept = np.flatnonzero(scores <= np.quantile(scores, 0.9))
    rest = left[kept] - left[kept].mean(0)
    axes = np.linalg.svd(rest, full_matrices=False)[2][:3]
    axes *= np.sign(axes[np.arange(3), np.abs(axes).argmax(1)])[:, None]
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, vec array<double>")
    found = {r.id: (r.x, r.y, r.z) for r in corpus_map.style_map(df, dimensions=3, prune=0.1, remove=1, k=3).collect()}
    assert sorted(found) == kept.tolist()
    assert np.array([found[i] for i in kept]) == pytest.approx(rest @ axes.T, abs=1e-6)


def test_clusters_come_to_rest(spark, monkeypatch):
    x = np.random.default_rng(10).normal(size=(4000, 12))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, vec array<double>")
    found = {r.id: r.cluster for r in corpus_map.clusters(df, 6, starts=1).collect()}
    assert {r.id: r.cluster for r in corpus_map.clusters(df.repartition(7), 6, starts=1).collect()} == found
    label = np.array([found[i] for i in range(4000)])

    def again(label):
        centres = np.stack([x[label == c].mean(0) for c in range(6)])
        return centres, ((x[:, None] - centres) ** 2).sum(2).argmin(1)

    centres, label = again(label)
    assert ((again(label)[0] - centres) ** 2).sum() <= 2 * 1e-4 * x.var(0).mean()
    monkeypatch.setattr(corpus_map, "MOST_ROUNDS", 3)
    with pytest.raises(RuntimeError):
        corpus_map.clusters(df, 6, starts=2)
    same = spark.createDataFrame([(i, [0.1, 0.7]) for i in range(30)], "id long, vec array<double>")
    assert corpus_map.clusters(same, 3, starts=2).select("cluster").distinct().count() == 1


def test_style_map_query_has_a_row_a_vector(spark):
    sf = "/root/testdata/sf0.001"
    rows = vector_queries.style_map(spark, sf).collect()
    assert sorted(r.id for r in rows) == sorted(r.vec_id for r in spark.read.parquet(f"{sf}/embeddings.parquet").select("vec_id").collect())
    assert {r.cluster for r in rows if r.kept} == set(range(6)) and 0.94 <= sum(r.kept for r in rows) / len(rows) < 1
    assert all((v is not None) == r.kept for r in rows for v in (r.x, r.y, r.z, r.cluster))
    assert len({(r.x, r.y, r.z) for r in rows if r.kept}) > 10
