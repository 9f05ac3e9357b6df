import hashlib

import duckdb
import pytest
from pyspark.sql import functions as F

from quillon.functions import catalog as N
from quillon.functions import text as T
from quillon.functions import vectors as V
from quillon.operators import cleaning
from quillon.plans.catalog_queries import _title_like_sql


def one(spark, expr, **columns):
    schema = ", ".join(f"{k} {'string' if isinstance(v, str) or v is None else 'double' if isinstance(v, float) else 'array<double>' if isinstance(v, list) else 'int'}" for k, v in columns.items())
    return spark.createDataFrame([tuple(columns.values())], schema).select(expr.alias("x")).first().x


@pytest.mark.parametrize(
    ("text", "expected"),
    [
        ("A" * 20 + ". " + "B" * 21, ["B" * 21]),
        ("This one has no capital. after the stop it goes on", ["This one has no capital. after the stop it goes on"]),
        ('She said it all "twice over!") Then came the next long one', ['She said it all "twice over', "Then came the next long one"]),
        ("First sentence is long enough. Second sentence too", ["First sentence is long enough", "Second sentence too"[:0]]),
        ("Short. Also short. Tiny one.", ["Short. Also short. Tiny one."]),
        ("short", []),
        ("", []),
    ],
)
def test_sentences(spark, text, expected):
    assert one(spark, T.sentences(F.col("t")), t=text) == [e for e in expected if e]


def test_windows(spark):
    items = F.transform(F.sequence(F.lit(1), F.col("n")), lambda i: i.cast("string"))
    assert [w.split()[0] for w in one(spark, T.windows(items, 14, 4), n=14)] == ["1", "11"]
    assert len(one(spark, T.windows(items, 3, 3), n=4)) == 4
    assert one(spark, T.windows(F.expr("cast(array() as array<string>)")), n=1) == []


def test_chunk_length_and_fallback(spark):
    items = F.array(F.col("t"))
    assert len(one(spark, T.chunks(items, english=False), t="x" * 200)) == 1
    assert one(spark, T.chunks(items, english=False), t="x" * 199) == []
    assert len(one(spark, T.chunks(items, english=False, fallback="half"), t="x" * 100)) == 1
    assert one(spark, T.chunks(items, english=False, fallback="half"), t="x" * 99) == []
    assert len(one(spark, T.chunks(items, english=False, fallback="any"), t="x")) == 1


@pytest.mark.parametrize(("text", "expected"), [("x" * 39, True), ("1" * 40, False), ("the xyz of " + "q" * 40, True), ("the " + "q" * 40, False), ("the of " + "a" * 25 + "é" * 20, True), ("the of " + "a" * 24 + "é" * 20, False)])
def test_english(spark, text, expected):
    assert one(spark, T.is_english(F.col("t")), t=text) is expected


def test_fingerprint(spark):
    a, b = (one(spark, T.fingerprint(F.col("t")), t=t) for t in ("Hello,  World é", "hello world "))
    assert a == b == hashlib.sha1(b"hello world").hexdigest()


@pytest.mark.parametrize(("text", "topic"), [("lord", 0), ("a season", 2), ("nothing", 4), ("king king god", 1)])
def test_topic(spark, text, topic):
    assert one(spark, T.topic_id(F.col("t")), t=text) == topic


def test_style(spark):
    assert tuple(one(spark, T.style_features(F.col("t")), t="")) == (0.0, 0.0, 0.0)
    assert one(spark, T.style_features(F.col("t")), t="...!!!")["avg_sentence_len"] == 0.0
    assert tuple(one(spark, T.style_features(F.col("t")), t="A b. a c!")) == pytest.approx((0.75, 2 / 9, 2.0))


def test_anonymous(spark):
    for a in ("", " ", None, "Anonymous", "unknown_author", "various_hands"):
        assert one(spark, T.is_anonymous(F.col("a")), a=a)
    assert not one(spark, T.is_anonymous(F.col("a")), a="jane_doe")


def test_slug(spark):
    assert one(spark, N.slug(F.col("t")), t="Café d'Été - Vol") == "cafe_d_ete_vol"
    assert one(spark, N.slug(F.col("t")), t=None) == "untitled"
    cut = one(spark, N.clipped(F.col("t"), 20), t="a" * 30)
    assert cut == "a" * 10 + "__" + hashlib.sha1(b"a" * 30).hexdigest()[:8]


def test_languages(spark):
    assert one(spark, N.languages(F.col("t")), t="x\nLanguage: English, French\ny") == ["english", "french"]
    assert one(spark, N.languages(F.col("t")), t="none") is None
    for text, kept in (("none", True), ("Language: English", True), ("Language: English, French", False)):
        assert one(spark, N.english_only(N.languages(F.col("t"))), t=text) is kept


def test_variant_order(spark):
    names = ["pg1-0.txt", "pg1.txt.utf-8", "pg1-8.txt", "pg1.txt", "pg1.zip"]
    scores = [one(spark, N.variant_score(F.col("t")), t=n) for n in names]
    assert scores == sorted(scores, reverse=True) and len(set(scores)) == 5


def test_title_lines(spark):
    for line, good in (("A TALE OF TWO CITIES", True), ("The Old House", True), ("CHAPTER ONE HERE", False), ("by someone else", False), ("SHOUT", False), ("", False)):
        assert one(spark, N.title_like(F.col("t")), t=line) is good, line


def test_title_lines_as_in_sql(spark):
    """Edges of words, white space and capitals beyond ASCII."""
    lines = ["DENENUNGIEVER!! EN\u00dcST!! CHZU,!!", "\u00dcNO BIRDS HERE", "TRANSLATED\u00a0BY ANNA", "TRANSLATED\tBY ANNA", "The Old\u00a0House", "  The Old House  ", "\tThe Old House\r"]
    lines += ["The Old House\u2028", "OLD PRE\u017f\u017f PRINTING", "ACCE\u00df TO ALL THINGS", "ART OF LIVIN\ufb01", "INDE\u1e8aX ROOMS", "X" * 120, "X" * 119 + " Y", "\u00a0" * 4 + "AB CD", "\u3000A\u00a0Day Dawns\u2003", "\x85The Old House\v", "CAF\u00c9 BOOK\u00c9 NIGHTS"]
    con = duckdb.connect()
    con.execute("CREATE TABLE t (line varchar)")
    con.executemany("INSERT INTO t VALUES (?)", [[x] for x in lines])
    expected = dict(con.execute(f"SELECT line, {_title_like_sql('trim(line)')} FROM t").fetchall())
    rows = spark.createDataFrame([(x,) for x in lines], "t string").select("t", N.title_like(F.col("t")).alias("x")).collect()
    assert {r.t: r.x for r in rows} == expected
    assert expected[lines[0]] is False


def test_vectors(spark):
    a, b = [3.0, 4.0], [4.0, 3.0]
    assert one(spark, V.cosine(F.col("a"), F.col("b")), a=a, b=b) == pytest.approx(0.96)
    assert one(spark, V.cosine(F.col("a"), F.col("b")), a=a, b=[0.0, 0.0]) is None
    assert one(spark, V.unit(F.col("a")), a=a) == pytest.approx([0.6, 0.8])
    assert one(spark, V.pair_features(F.col("a"), F.col("b")), a=a, b=b) == [3, 4, 4, 3, 1, 1, 12, 12]


def test_white_space(spark):
    assert one(spark, cleaning.tidy_space(F.col("t")), t="\n\n a  \n\n\n\nb\t\n\n") == " a\n\nb\n"


def test_cleaning(spark):
    rows = [
        (1, "head\n*** START OF THE PROJECT GUTENBERG EBOOK X ***\nbody  \n\n\n\nmore\n*** END OF THE PROJECT GUTENBERG EBOOK X ***\ntail"),
        (2, "\nProduced by someone\n\n[Transcriber's note: one line]\nstill note]\n\nbody"),
        (3, "a\nTranscriber's Notes:\nnote\n\n\n\nb"),
        (4, "plain é\r\ntext"),
        (5, None),
        (6, ""),
    ]
    got = {r.doc_id: r.text for r in cleaning.cleaned(spark.createDataFrame(rows, "doc_id int, text string")).collect()}
    assert got == {1: "body\n\nmore\n", 2: "body\n", 3: "a\n\nb\n", 4: "plain é\ntext\n", 5: None, 6: "\n"}
    again = cleaning.cleaned(spark.createDataFrame(list(got.items()), "doc_id int, text string"))
    assert {r.doc_id: r.text for r in again.collect()} == got


def test_pooling_and_averages(spark):
    rows = F.array(F.array(F.lit(1.0), F.lit(2.0)), F.array(F.lit(9.0), F.lit(9.0)), F.array(F.lit(3.0), F.lit(4.0)))
    assert one(spark, V.masked_mean(rows, F.array(F.lit(1), F.lit(0), F.lit(1))), a=1) == [2.0, 3.0]
    assert one(spark, V.masked_mean(rows, F.array(F.lit(0), F.lit(0), F.lit(0))), a=1) is None
    assert one(spark, V.moving_average(F.col("v")), v=[1.0, 2.0]) == pytest.approx(1.1)
