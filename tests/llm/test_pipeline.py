"""The pipeline's contract on the smallest tables."""

import pytest

pytest.importorskip("quillon.llm")
corpus_pipeline = pytest.importorskip("corpus_pipeline")

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, n = docs.columns, docs.count()
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline.staged(stage(spark, docs, SF), name)
        assert docs.columns == columns and 0 < docs.count() <= n
        n = docs.count()
    kept = {r.doc_id for r in docs.select("doc_id").collect()}
    good = [i for i, q in labels.items() if q == 1]
    assert sum(i in kept for i in good) / len(good) > 0.75
    assert sum(i in kept for i, q in labels.items() if q == 0) <= 3
    out = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
    joined = out.join(docs.select("doc_id", docs.text.alias("was")), "doc_id")
    assert out.count() == n and joined.where("text <> was").count() == 0


def odd_documents(spark):
    texts = [None, "", "", "word " * 40_000, "password = abcdefghijklmnop", "password = abcdefghijklmnop", "the river ran past the old stone bridge and the garden wall"]
    made = [(i, t, "en", "s", None, "b", "c", 1, "d") for i, t in enumerate(texts)]
    made += [made[-1], (None, "no id", None, None, None, None, None, None, None)]
    return spark.createDataFrame(made, "doc_id long, text string, lang string, source string, n_chars long, blob string, _cut string, _salt int, ids string")


@pytest.mark.parametrize("stage", [s for s in corpus_pipeline.STAGES[:-1]], ids=lambda s: s[0])
def test_stages_on_odd_documents(spark, tmp_path, stage):
    docs = odd_documents(spark)
    for name in ("labels", "benchmark"):
        spark.read.parquet(f"{SF}/{name}.parquet").write.parquet(f"{tmp_path}/{name}.parquet")
    name, f = stage
    out = f(spark, docs, str(tmp_path))
    assert out.columns == docs.columns and out.count() <= docs.count()
    assert f(spark, docs.limit(0), str(tmp_path)).count() == 0
    got = sorted((-1 if r.doc_id is None else r.doc_id, r.text) for r in out.select("doc_id", "text").collect() if r.text is not None)
    rest = [(r.blob, r._cut, r._salt, r.ids) for r in out.collect() if r.doc_id is not None]
    assert all(r == ("b", "c", 1, "d") for r in rest)
    if name == "near_duplicates":
        assert [i for i, _ in got] == [-1, 3, 4, 6, 6] and out.where("doc_id = 0").count() == 1
    if name == "decontamination":
        assert out.count() == docs.count()
    if name == "secrets":
        assert [t for i, t in got if i in (4, 5)] == ["[SECRET]"] * 2 and out.count() == docs.count()


def test_stages_without_labels_or_benchmark(spark, tmp_path):
    docs = odd_documents(spark)
    for name in ("labels", "benchmark"):
        spark.read.parquet(f"{SF}/{name}.parquet").limit(0).write.parquet(f"{tmp_path}/{name}.parquet")
    stages = dict(corpus_pipeline.STAGES)
    assert stages["decontamination"](spark, docs, str(tmp_path)).count() == docs.count()
    assert stages["quality"](spark, docs, str(tmp_path)).count() == 0


def test_tokens_of_odd_documents(spark, tmp_path):
    docs = odd_documents(spark)
    out = corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path))
    assert out.columns == ["doc_id", "n_tokens", "ids", "text"]
    was = sorted((-1 if r.doc_id is None else r.doc_id, r.text or "") for r in docs.collect())
    assert sorted((-1 if r.doc_id is None else r.doc_id, r.text) for r in out.collect()) == was
    assert corpus_pipeline.STAGES[-1][1](spark, docs.limit(0), str(tmp_path)).count() == 0


def test_run_against_the_stages_one_by_one(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.staged(stage(spark, docs, SF), name)
    assert sorted(map(tuple, corpus_pipeline.run(spark, SF).collect())) == sorted(map(tuple, docs.collect()))
