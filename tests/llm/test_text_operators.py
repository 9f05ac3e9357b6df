"""BPE, repetition rules, language identification, classifier, URL filter."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest

pytest.importorskip("quillon.llm")

from pyspark.sql import functions as F  # noqa: E402

from quillon.llm import bpe, langid, quality_model, quality_rules, url_filter  # noqa: E402

DOCS = "doc_id long, text string, lang string, source string, n_chars long, score double"


def rows(texts):
    return [(i, t, None, None, None, None) for i, t in enumerate(texts)]


def test_bpe_is_the_librarys(spark):
    rng = random.Random(1)
    alphabet = ["a", "B", "é", " ", "  ", "\n", "\t", "\x1c", "\x85", "\xa0", "1", "½", "!", "'s", "<|endoftext|>", "\U0001f600", "中", "​", "　"]
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 25))) for _ in range(400)] + [None, "", " ", "  ", "x" * 50_000, "same", "same"]
    tokenizer = bpe.load_tokenizer(bpe.default_path())

    def expected(text):
        ids = tokenizer.encode(text or "", add_special_tokens=False).ids
        decoded = tokenizer.decode(ids, skip_special_tokens=False)
        return len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest()

    docs = spark.createDataFrame([*rows(texts), (None, "no id", None, None, None, None)], DOCS).repartition(3)
    got = Counter((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in bpe.bpe_report(docs).collect())
    assert got == Counter([(i, *expected(t)) for i, t in enumerate(texts)] + [(None, *expected("no id"))])
    assert bpe.bpe_report(docs.limit(0)).count() == 0


def test_words_join_to_the_text():
    space = " \t\n\v\f\r"
    for text in ("a  b", " a", "a ", "\n \n b", "  ", "", "a \nb c", "\u00e9 x\u3000 y\x1c z\xa0 \u201cq\u201d r"):
        words = bpe.words(text)
        assert "".join(words) == text and all(words)
        assert all(w[0] in space and v[-1] not in space for v, w in zip(words, words[1:], strict=False))
    assert bpe.words("a b  c\nd") == ["a", " b", "  c", "\nd"] and bpe.words("a b", False) == ["a b"]


def test_bpe_takes_many_special_tokens_and_other_vocabularies(spark):
    texts = ["x <|endoftext|> " * 1200, "<|endoftext|>" * 1100, "Two  words\n"]
    docs = spark.createDataFrame(rows(texts), DOCS)
    import public_tokenizers

    for path in (bpe.default_path(), public_tokenizers.path("word_bpe_49k.json")):
        tokenizer = bpe.load_tokenizer(path)
        got = {r.doc_id: list(r.ids) for r in bpe.encode(docs, path, stable=False).collect()}
        assert got == {i: tokenizer.encode(t, add_special_tokens=False).ids for i, t in enumerate(texts)}
    bad = spark.createDataFrame([(1, None), (2, []), (3, [188, 64])], "k int, ids array<int>")
    tokenizer = bpe.load_tokenizer(bpe.default_path())
    assert {r.k: r.decoded for r in bpe.decode(bad).collect()} == {1: "", 2: "", 3: tokenizer.decode([188, 64], skip_special_tokens=False)}


def repeated_words(text):
    w = (text or "").encode().split()
    places = {}
    for i in range(len(w) - 7):
        places.setdefault(tuple(w[i : i + 8]), []).append(i)
    return len({j for v in places.values() if len(v) > 1 for i in v for j in range(i, i + 8)})


def test_quality_rules(spark):
    rng = random.Random(2)
    clean = " ".join(f"w{rng.randrange(5000)}" for _ in range(300))
    texts = [clean, None, "", "buy now " * 200, clean + " " + clean, "# * $ %\n\nx\nx\n", "a b\n" * 3, "long " * 30_000]
    texts += [" ".join(rng.choice("ab") for _ in range(rng.randint(0, 60))) for _ in range(60)]
    got = {r.doc_id: r for r in quality_rules.quality_rules(spark.createDataFrame(rows(texts), DOCS)).collect()}
    for i, t in enumerate(texts):
        assert got[i].n_repeat_words == repeated_words(t), t
        assert got[i].n_words == len((t or "").encode().split())
        lines = [x for x in (t or "").split("\n") if x.strip(" \t\n\x0b\x0c\r")]
        assert got[i].n_dup_lines == len(lines) - len(set(lines))
    assert got[0].kept and not got[3].kept and not got[4].kept and got[5].n_symbols == 4
    assert got[1].base_failed and got[2].base_failed
    assert quality_rules.quality_rules(spark.createDataFrame([], DOCS)).count() == 0


def test_quality_rules_reject_more_than_the_base(spark):
    rng = random.Random(11)
    w = [f"w{i}" for i in range(1000)]
    fresh = lambda n: [f"v{rng.randrange(10**9)}" for _ in range(n)]
    pasted = w[:400] + fresh(100) + w[:100] + w[400:800]  # a passage of 100 words twice
    block = [x for _ in range(3) for x in w[:60] + fresh(290)]  # 60 words three times
    small = [x for i in range(8) for x in [*w[i * 10 : i * 10 + 8], *fresh(42), *w[i * 10 : i * 10 + 8], *fresh(42)]]  # 16 of 100 words
    slight = w[:400] + fresh(100) + w[:40] + w[400:860]
    got = {r.doc_id: r for r in quality_rules.quality_rules(spark.createDataFrame(rows([" ".join(t) for t in (pasted, block, small, slight)]), DOCS)).collect()}
    assert not any(r.base_failed for r in got.values())
    assert [got[i].kept for i in range(4)] == [False, False, False, True]


def test_language_id(spark):
    rng = random.Random(3)
    vocab = {"en": ["the", "thing", "and", "with"], "fr": ["le", "été", "que", "aux"], "de": ["und", "über", "nicht", "schön"]}
    made = [(i, " ".join(rng.choice(vocab[k]) for _ in range(40)), k, None, None, None) for i, k in enumerate(rng.choice(list(vocab)) for _ in range(400))]
    odd = [(1000, None, "en", None, None, None), (1001, "", "fr", None, None, None), (1002, "123 !", None, None, None, None), (None, "the thing", None, None, None, None)]
    got = {r.doc_id: r for r in langid.language_id(spark.createDataFrame(made + odd, DOCS)).collect()}
    held = [(got[i].lang_pred, k) for i, _, k, *_ in made if got[i].held_out]
    assert len(held) > 50 and sum(a == b for a, b in held) / len(held) > 0.98
    assert all(got[i].lang_pred == "und" for i in (1000, 1001, 1002)) and got[None].lang_pred == "en"
    assert all(0 <= r.score <= 1 for r in got.values())
    assert langid.language_id(spark.createDataFrame([], DOCS)).count() == 0
    blank = spark.createDataFrame([(1, "the", None, None, None, None)], DOCS)
    assert langid.language_id(blank).first().lang_pred == "und"


def test_every_language_is_learnt(spark):
    made = [(4 * k + j, " ".join([chr(0x4E00 + 8 * k + j), chr(0x4E00 + 8 * k + 7)] * 20), f"l{k:03}", None, None, None) for k in range(264) for j in range(4)]
    got = {r.doc_id: r for r in langid.language_id(spark.createDataFrame(made, DOCS)).collect()}
    learnt = {k for i, _, k, *_ in made if not got[i].held_out}
    assert {"l256", "l263"} <= learnt and len(learnt) > 256
    assert {k for i, _, k, *_ in made if got[i].lang_pred == k} >= learnt


def test_quality_model_held_out(spark):
    rng = random.Random(4)
    made = [(i, " ".join((rng.choice(["spam!!", "WIN$$", "free##"]) if i % 4 == 0 else rng.choice(["river", "stone", "garden", "walked"])) for _ in range(30)), None, None, None, None) for i in range(400)]
    docs = spark.createDataFrame([*made, (900, None, None, None, None, None), (901, "", None, None, None, None)], DOCS)
    labels = spark.createDataFrame([(i, int(i % 4 != 0), 0) for i in range(400)] + [(900, None, None)], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in quality_model.quality_scores(docs, labels).collect()}
    held = [i for i in range(400) if got[i].held_out]
    assert sum(got[i].predicted == int(i % 4 != 0) for i in held) / len(held) > 0.97
    assert got[900].score == got[901].score and 0 <= got[900].score <= 1
    assert quality_model.quality_scores(docs, labels.limit(0)).where("score <> 0.5").count() == 0
    assert quality_model.quality_scores(docs.limit(0), labels).count() == 0
    kept = quality_model.keep_good(docs, labels)
    assert kept.columns == docs.columns and kept.where("doc_id < 400 and doc_id % 4 = 0").count() < 5


def test_url_rules_and_trees(spark):
    urls = [
        ("http://A.example.com/en/7x?q", "a.example.com", "/en/7x", "example.com/en/7", "allow"),
        ("https://x.com/en/1", "x.com", "/en/1", "com/en/", "block"),
        ("https://example.net/de/81#t", "example.net", "/de/81", "example.net/de/8", "block"),
        ("https://notexample.net/de/8", "notexample.net", "/de/8", "net/de/", "allow"),
        ("ftp://b.org/es/", "b.org", "/es/", "org/es/", "block"),
        ("http://b.org", "b.org", "", None, None),
        ("no scheme", "", "", None, None),
        (None, "", "", None, None),
        ("x://Ünï.ORG?q=/es/", "Ünï.org".replace("org", "org"), "", None, None),
    ]
    pages = spark.createDataFrame([(i, u[0], "<p>") for i, u in enumerate(urls)], "page_id long, url string, html string")
    got = {r.page_id: r for r in url_filter.url_verdicts(pages).collect()}
    for i, (_, host, path, rule, verdict) in enumerate(urls):
        assert (got[i].host, got[i].path, got[i].rule) == (host, path, rule)
        assert got[i].verdict == verdict if verdict else got[i].verdict in ("allow", "block")
    assert url_filter.url_verdicts(pages.limit(0)).count() == 0
    rng = random.Random(5)
    labelled = [(f"http://{'cheap-pills-' if i % 2 else 'news'}{rng.randrange(999)}.org/{i}", "block" if i % 2 else "allow") for i in range(300)]
    fresh = spark.createDataFrame([(1, "http://cheap-pills-5.org/x", ""), (2, "http://news77.org/x", "")], "page_id long, url string, html string")
    verdicts = {r.page_id: r.verdict for r in url_filter.url_verdicts(fresh, labelled=spark.createDataFrame(labelled, "url string, verdict string")).collect()}
    assert verdicts == {1: "block", 2: "allow"}


def test_trees_against_plain_versions(monkeypatch):
    rng = np.random.default_rng(7)
    x = np.column_stack([rng.integers(0, 9, 200), rng.random(200), rng.integers(0, 2, 200)]).astype(float)
    y = ((x[:, 0] > 4) ^ (rng.random(200) < 0.1)).astype(float)
    monkeypatch.setattr(url_filter, "TREES", 2)
    model = url_filter.fit(x, y)
    base = np.log((y.mean() + 1e-6) / (1 - y.mean() + 1e-6))

    def walked(row, trees):  # score by walking each tree from its root
        score = base
        for t in range(trees):
            k = 0
            while k < 15:
                k = 2 * k + 1 + int(row[model.feature[t, k]] > model.threshold[t, k])
            score += model.value[t, k - 15]
        return score

    for t in range(2):
        p = np.array([1 / (1 + np.exp(-walked(r, t))) for r in x])
        g, h = p - y, p * (1 - p)
        gains = []
        for j in range(3):
            for cut in np.unique(np.quantile(x[:, j], np.linspace(0, 1, url_filter.BINS + 1)[1:-1])):
                left = x[:, j] <= cut
                if min(left.sum(), (~left).sum()) >= url_filter.LEAF:
                    gains.append((sum(g[s].sum() ** 2 / (h[s].sum() + url_filter.PENALTY) for s in (left, ~left)) - g.sum() ** 2 / (h.sum() + url_filter.PENALTY), j, cut))
        own = [v for v, j, cut in gains if (j, cut) == (model.feature[t, 0], model.threshold[t, 0])]
        assert own and abs(own[0] - max(gains)[0]) < 1e-9
        leaf = np.zeros(200, int)
        for _ in range(url_filter.DEPTH):
            leaf = 2 * leaf + 1 + (x[np.arange(200), model.feature[t][leaf]] > model.threshold[t][leaf])
        for k in set(leaf.tolist()):
            s = leaf == k
            assert abs(model.value[t, k - 15] + url_filter.RATE * g[s].sum() / (h[s].sum() + url_filter.PENALTY)) < 1e-9
    assert np.allclose(url_filter.predict(model, x), [1 / (1 + np.exp(-walked(r, 2))) for r in x])


def test_suffix_shares_leave_the_own_fold_out():
    rng = np.random.default_rng(8)
    rows = np.column_stack([rng.integers(0, 6, 300), rng.integers(0, url_filter.FOLDS, 300), rng.integers(0, 2, 300)])
    share = url_filter.suffix_shares(rows[:, 0], rows[:, 1], np.ones(300), rows[:, 2])
    for fold in range(url_filter.FOLDS + 1):
        for at in range(7):
            other = rows[(rows[:, 0] == at) & (rows[:, 1] != fold)]
            assert abs(share[fold, at] - (other[:, 2].sum() + 1) / (len(other) + 2)) < 1e-12


def test_url_precision_held_out(spark):
    rng = random.Random(9)

    def made(i):
        bad = rng.random() < 0.4
        host = f"{'win-' if bad and rng.random() < 0.8 else ''}{rng.choice(['shop', 'blog', 'wiki'])}{rng.randrange(10 ** (6 if bad else 2))}.{rng.choice(['org', 'com', 'net'])}"
        return f"http://{host}/{'a/' * rng.randint(0, 3)}{i}" + ("?id=1&ref=2&u=3" if bad and rng.random() < 0.7 else ""), "block" if bad else "allow"

    learnt, fresh = [made(i) for i in range(1500)], [made(i) for i in range(1500, 2500)]
    pages = spark.createDataFrame([(i, u) for i, (u, _) in enumerate(fresh)], "page_id long, url string")
    got = {r.page_id: r.verdict for r in url_filter.url_verdicts(pages, rules=(), labelled=spark.createDataFrame(learnt, "url string, verdict string")).collect()}
    blocked = [i for i, v in got.items() if v == "block"]
    right = sum(fresh[i][1] == "block" for i in blocked)
    assert right / len(blocked) > 0.93 and right / sum(v == "block" for _, v in fresh) > 0.9


def test_extra_columns_do_not_clash(spark):
    docs = spark.createDataFrame([(1, "one two", "en", "s", 7, 0.5)], DOCS).withColumn("ids", F.lit(1)).withColumn("block", F.lit(2)).withColumn("word", F.lit(3))
    assert bpe.bpe_report(docs).first().n_tokens == 2
    assert quality_rules.quality_rules(docs).first().n_words == 2


def test_repeated_ids_are_learnt_once(spark):
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(40)] * 3, "doc_id long, quality int, toxic int")
    made = [(i, ("good river stone" if i % 2 else "bad spam") + f" {k}", "en" if i % 2 else "fr", None, None, None) for i in range(40) for k in range(5)]
    docs = spark.createDataFrame(made, DOCS)
    once = spark.createDataFrame([r for r in made if r[1].endswith(" 0")], DOCS)
    (a, b), (c, d) = quality_model.train(docs, labels), quality_model.train(once, labels.distinct())
    assert b == d and (a == c).all()
    assert (langid.train(docs).weights.shape, len(langid.train(docs, 5).langs)) == ((langid.BUCKETS, 2), 2)
    assert quality_model.quality_scores(docs, labels).count() == 200
