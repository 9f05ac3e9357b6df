"""Queries for metrics and calibration."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillon.functions import text as T
from quillon.functions import vectors as V
from quillon.operators import calibration as K
from quillon.operators import losses as L
from quillon.operators import metrics as M
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


def scored(spark, sf_dir):
    """Documents with a quality label and the default score: id, domain, label, score."""
    d, lab = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels").where(F.col("quality").isNotNull())
    return d.join(lab, "doc_id").select(F.col("doc_id").alias("id"), F.col("lang").alias("domain"), F.col("quality").cast("int").alias("label"), K.default_score(F.col("text")).alias("score"))


def rounded(df, *columns, digits=6):
    return df.select(*[F.round(c, digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes if not columns or c in columns])


CONF = f"WITH {Q.SCORED}, c AS (SELECT count(*) FILTER (label = 1 AND score >= 0.5::double) AS tp, count(*) FILTER (label = 0 AND score >= 0.5::double) AS fp, count(*) FILTER (label = 1 AND score < 0.5::double) AS fn, count(*) FILTER (label = 0 AND score < 0.5::double) AS tn FROM scored)"


def metric_sql(source: str, extra: str = "") -> str:
    return f"""SELECT {extra} tp, fp, fn, tn, round(accuracy, 6) AS accuracy, round(p, 6) AS precision, round(r, 6) AS recall, round(coalesce(2 * p * r / nullif(p + r, 0), 0), 6) AS f1,
round(coalesce(1.25::double * p * r / nullif(0.25::double * p + r, 0), 0), 6) AS f05, round(coalesce(5 * p * r / nullif(4 * p + r, 0), 0), 6) AS f2, round((r + coalesce(tn::double / nullif(tn + fp, 0), 0)) / 2, 6) AS balanced_accuracy
FROM (SELECT *, (tp + tn)::double / nullif(tp + fp + fn + tn, 0) AS accuracy, coalesce(tp::double / nullif(tp + fp, 0), 0) AS p, coalesce(tp::double / nullif(tp + fn, 0), 0) AS r FROM {source})"""


@query(CONF + " SELECT * FROM c")
def confusion(spark, sf_dir):
    return M.confusion(scored(spark, sf_dir))


@query(CONF + " " + metric_sql("c"))
def prf(spark, sf_dir):
    return rounded(M.classification(M.confusion(scored(spark, sf_dir))))


@query(f"""WITH {Q.SCORED}, g AS (SELECT score, count(*) FILTER (label = 1) AS p, count(*) FILTER (label = 0) AS n FROM scored GROUP BY score),
r AS (SELECT *, coalesce(sum(p) OVER (ORDER BY score DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS pp FROM g)
SELECT round((sum(n * (pp + p / 2.0::double)) / (sum(p) * sum(n)))::double, 6) AS auc FROM r""")
def roc_auc(spark, sf_dir):
    return rounded(M.roc_auc(scored(spark, sf_dir)))


@query(f"""WITH {Q.SCORED}, g AS (SELECT score, count(*) FILTER (label = 1) AS p, count(*) FILTER (label = 0) AS n FROM scored GROUP BY score),
r AS (SELECT *, sum(p) OVER (ORDER BY score DESC) AS cp, sum(n) OVER (ORDER BY score DESC) AS cn FROM g)
SELECT round((sum(p * cp::double / (cp + cn)) / sum(p))::double, 6) AS ap FROM r""")
def average_precision(spark, sf_dir):
    return rounded(M.average_precision(scored(spark, sf_dir)))


SWEEP = f"""WITH {Q.SCORED}, b AS (SELECT label, least(floor(score * 100 + 1e-9::double), 99) AS b FROM scored), g AS (SELECT unnest(range(1, 100)) AS i),
c AS (SELECT i / 100.0::double AS threshold, count(*) FILTER (label = 1 AND b >= i) AS tp, count(*) FILTER (label = 0 AND b >= i) AS fp, count(*) FILTER (label = 1 AND b < i) AS fn, count(*) FILTER (label = 0 AND b < i) AS tn FROM g, b GROUP BY i)"""


@query(SWEEP + " " + metric_sql("c", "threshold,"))
def threshold_sweep(spark, sf_dir):
    return rounded(M.threshold_sweep(scored(spark, sf_dir)))


@query(SWEEP + ", m AS (" + metric_sql("c", "threshold,") + ") SELECT threshold, accuracy, recall FROM m ORDER BY (recall >= 0.85) DESC, accuracy DESC, threshold LIMIT 1")
def best_threshold(spark, sf_dir):
    return rounded(M.best_threshold(M.threshold_sweep(scored(spark, sf_dir))).select("threshold", "accuracy", "recall"))


@query(f"WITH {Q.SCORED} SELECT id % 2 = 0 AS same_topic, count(*) AS n, round(avg((score < 0.5::double)::int), 6) AS accuracy FROM scored WHERE label = 0 GROUP BY 1")
def topic_sliced_negacc(spark, sf_dir):
    rows = scored(spark, sf_dir).select("label", (F.col("id") % 2 == 0).alias("same_topic"), (F.col("score") >= 0.5).cast("int").alias("predicted"))
    return rounded(M.sliced_accuracy(rows))


def bins_sql(edges: str) -> str:
    return f"""WITH {Q.SCORED}, e AS (SELECT {edges} AS edges FROM scored), b AS (SELECT label, score, least(len(list_filter(edges, lambda x: x <= score)), len(edges) - 1)::int AS bin FROM scored, e WHERE len(edges) > 1),
r AS (SELECT bin, count(*) AS n, avg(score) AS conf, avg(label) AS acc FROM b WHERE bin > 0 GROUP BY bin)"""


QUANTILES = "list_sort(list_distinct(quantile_cont(score, [" + ", ".join(f"{i}::double / 15" for i in range(16)) + "])))"
FIXED = "[" + ", ".join(f"{i}::double / 15" for i in range(16)) + "]"


@query(bins_sql(QUANTILES) + " SELECT round(sum(n * abs(acc - conf)) / (SELECT count(*) FROM scored), 6) AS ece FROM r")
def ece_quantile(spark, sf_dir):
    return rounded(M.ece(scored(spark, sf_dir)))


@query(bins_sql("any_value(" + FIXED + ")") + " SELECT round(sum(n * abs(acc - conf)) / (SELECT count(*) FROM scored), 6) AS ece FROM r")
def ece_fixed(spark, sf_dir):
    return rounded(M.ece(scored(spark, sf_dir), strategy="fixed"))


@query(bins_sql(QUANTILES) + " SELECT bin, n, round(conf, 6) AS conf, round(acc, 6) AS acc FROM r")
def reliability_bins(spark, sf_dir):
    return rounded(M.reliability(scored(spark, sf_dir)))


@query(f"WITH {Q.SCORED} SELECT round(avg((score - label) * (score - label)), 6) AS brier FROM scored")
def brier(spark, sf_dir):
    return rounded(M.brier(scored(spark, sf_dir)))


Z = "(score * 3.0::double - 1.0::double)"


@query(f"WITH {Q.SCORED} SELECT id, round(1 / (1 + exp(-{Z})), 6) AS p FROM scored")
def apply_logistic(spark, sf_dir):
    return rounded(scored(spark, sf_dir).select("id", K.apply_logistic(F.col("score"), 3.0, -1.0).alias("p")))


KNOTS, VALUES = [0.3, 0.5, 0.5, 0.7], [0.1, 0.3, 0.5, 0.9]


@query(f"""WITH {Q.SCORED} SELECT id, round(CASE WHEN score < 0.3::double THEN 0.1::double WHEN score >= 0.7::double THEN 0.9::double WHEN score < 0.5::double THEN 0.1::double + 0.2::double * ((score - 0.3::double) / 0.2::double) ELSE 0.5::double + 0.4::double * ((score - 0.5::double) / 0.2::double) END, 6) AS p FROM scored""")
def apply_isotonic(spark, sf_dir):
    return rounded(scored(spark, sf_dir).select("id", K.apply_isotonic(F.col("score"), KNOTS, VALUES).alias("p")))


PCTS = ", ".join(f"round(quantile_cont(score, {q}::double), 8) AS p{round(100 * q)}" for q in M.LEVELS)


@query(f"WITH {Q.SCORED} SELECT domain, label, count(*) AS n, round(avg(score), 8) AS mean, round(quantile_cont(score, 0.5::double), 8) AS median, {PCTS} FROM scored GROUP BY GROUPING SETS ((label), (domain, label))")
def percentiles_by_group(spark, sf_dir):
    return rounded(M.percentile_table(scored(spark, sf_dir)), digits=8)


@query(f"WITH {Q.SCORED}, r AS (SELECT CASE WHEN label = 0 THEN NULL ELSE score * 2 - 1 END AS cosine, score AS score_0_1 FROM scored) SELECT count(*) AS n, round(avg(cosine), 6) AS cosine_mean, round(quantile_cont(cosine, 0.5::double), 6) AS cosine_median, round(avg(score_0_1), 6) AS score_0_1_mean, round(quantile_cont(score_0_1, 0.5::double), 6) AS score_0_1_median FROM r")
def bench_aggregate(spark, sf_dir):
    both = scored(spark, sf_dir).select(F.when(F.col("label") == 1, F.col("score") * 2 - 1).otherwise(F.lit(float("nan"))).alias("cosine"), F.col("score").alias("score_0_1"))
    return rounded(M.benchmark_aggregate(both, ["cosine", "score_0_1"]))


@query(f"WITH {Q.SCORED} SELECT id, CASE WHEN score < 0.5::double THEN score ELSE round(1 - score / 2, 6) END AS prob, score >= 0.5::double AND round(1 - score / 2, 6) >= 0.7::double AS same, CASE WHEN score < 0.5::double THEN 'bi-only' ELSE 'cross' END AS stage FROM scored")
def two_stage(spark, sf_dir):
    first = lambda df: df.withColumn("prob", F.col("score"))
    second = lambda df: df.withColumn("prob", F.round(1 - F.col("score") / 2, 6))
    return K.two_stage(scored(spark, sf_dir).select("id", "score"), first, second, 0.5, 0.7).select("id", "prob", "same", "stage")


@query("SELECT doc_id, round(CASE WHEN p < 0.1::double THEN 0 WHEN p < 0.3::double THEN (p - 0.1::double) / 0.2::double ELSE 1 END, 6)::double AS scale FROM (SELECT doc_id, (doc_id % 100) / 100.0::double AS p FROM documents)")
def ramp_schedule(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.round(K.ramp(F.col("doc_id") % 100, 100), 6).alias("scale"))


LOGITS = "(SELECT id, label, 1 - 2 * score AS logit0, 3 * score - 1 AS logit1 FROM scored)"


def logits(spark, sf_dir):
    return scored(spark, sf_dir).select("id", "label", (1 - 2 * F.col("score")).alias("logit0"), (3 * F.col("score") - 1).alias("logit1"))


@query(f"WITH {Q.SCORED}, p AS (SELECT id, round(1 / (1 + exp((logit0 - logit1) / 1.5)), 6) AS prob FROM {LOGITS}) SELECT id, prob, prob >= 0.6 AS same, round(CASE WHEN prob >= 0.6 THEN prob ELSE 1 - prob END, 6) AS confidence FROM p")
def pair_decision(spark, sf_dir):
    p = logits(spark, sf_dir).select("id", F.round(V.probability(F.col("logit0"), F.col("logit1"), 1.5), 6).alias("prob"))
    return p.select("id", "prob", (F.col("prob") >= 0.6).alias("same"), F.round(F.when(F.col("prob") >= 0.6, F.col("prob")).otherwise(1 - F.col("prob")), 6).alias("confidence"))


@query()
def temperature(spark, sf_dir):
    return rounded(K.calibrate(logits(spark, sf_dir)).select("temperature", "threshold", "opt_metric"), digits=4)


def similarities(spark, sf_dir):
    return scored(spark, sf_dir).select("id", "domain", "label", (F.col("score") * 2 - 1).alias("cos"))


@query()
def fit_logistic(spark, sf_dir):
    m = K.fit_logistic(similarities(spark, sf_dir))
    return spark.createDataFrame([(round(m["coef"], 4), round(m["intercept"], 4))], "coef double, intercept double")


@query()
def fit_isotonic(spark, sf_dir):
    m = K.fit_isotonic(similarities(spark, sf_dir))
    return rounded(similarities(spark, sf_dir).select("id", K.apply_map(F.col("cos"), m).alias("p")))


@query()
def cv_select(spark, sf_dir):
    s = K.cv_scores(similarities(spark, sf_dir))
    return spark.createDataFrame([(m, round(v, 4), v == min(s.values())) for m, v in s.items()], "method string, brier double, chosen boolean")


@query(f"SELECT doc_id, {Q.score('text')} AS score FROM documents")
def default_score(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", K.style_score(T.style_features(F.col("text"))).alias("score"))


@query(f"WITH {Q.SCORED} SELECT id, round(CASE WHEN id % 3 = 0 THEN score / 2 ELSE score END, 9) AS score FROM scored")
def preferred_score(spark, sf_dir):
    """Every third document has a calibrated score, half the plain one."""
    calibrated = F.when(F.col("id") % 3 == 0, F.col("score") / 2)
    return scored(spark, sf_dir).select("id", F.round(M.preferred_score(calibrated, F.col("score")), 9).alias("score"))


TOPIC_LOGITS = "SELECT vec_id, list_transform(embedding[1:10], lambda x: round(x::double, 5)) AS z1, list_transform(embedding[11:20], lambda x: round(x::double, 5)) AS z2, label::int AS y1, ((label + vec_id) % 10)::int AS y2 FROM embeddings"


def topic_logits(spark, sf_dir):
    part = lambda a: F.transform(F.slice("embedding", a, 10), lambda x: F.round(x.cast("double"), 5))
    return table(spark, sf_dir, "embeddings").select("vec_id", part(1).alias("z1"), part(11).alias("z2"), F.col("label").cast("int").alias("y1"), ((F.col("label") + F.col("vec_id")) % 10).cast("int").alias("y2"))


@query(f"WITH t AS ({TOPIC_LOGITS}), a AS (SELECT avg((list_position(z1, list_max(z1)) - 1 = y1)::int::double) AS acc_1, avg((list_position(z2, list_max(z2)) - 1 = y2)::int::double) AS acc_2 FROM t) SELECT round(acc_1, 6) AS acc_1, round(acc_2, 6) AS acc_2, round((acc_1 + acc_2) / 2, 6) AS mean_acc FROM a")
def topic_adversary(spark, sf_dir):
    return rounded(M.adversary_accuracy(topic_logits(spark, sf_dir), ("z1", "z2"), ("y1", "y2")))


def softmax_sql(z: str, t: str = "1") -> str:
    return f"list_transform({z}, lambda x: exp((x - list_max({z})) / {t}) / list_sum(list_transform({z}, lambda y: exp((y - list_max({z})) / {t}))))"


@query(f"WITH t AS ({TOPIC_LOGITS}), p AS (SELECT *, {softmax_sql('z1')} AS p1, {softmax_sql('z1', '2.0::double')} AS s, {softmax_sql('z2', '2.0::double')} AS q FROM t) SELECT vec_id, round(-ln(p1[y1 + 1]), 6) AS ce, round(4 * list_sum(list_transform(list_zip(q, s), lambda x: x[1] * ln(x[1] / x[2]))), 6) AS distilled FROM p")
def loss_terms(spark, sf_dir):
    z = topic_logits(spark, sf_dir)
    return z.select("vec_id", F.round(V.cross_entropy(F.col("z1"), F.col("y1")), 6).alias("ce"), F.round(V.distillation_loss(F.col("z1"), F.col("z2")), 6).alias("distilled"))


@query("""WITH v AS (SELECT vec_id, list_transform(embedding[1:8], lambda x: x::double) AS x, [list_transform(embedding[9:16], lambda x: x::double), list_transform(embedding[17:24], lambda x: x::double), list_transform(embedding[25:32], lambda x: x::double)] AS w, vec_id % 3 AS y FROM embeddings),
c AS (SELECT vec_id, y, list_transform(w, lambda u: list_inner_product(x, u) / (sqrt(list_inner_product(x, x)) * sqrt(list_inner_product(u, u)))) AS c FROM v)
SELECT vec_id, round(30 * c[1], 5) AS plain, round(30 * CASE WHEN c[y + 1] > cos(pi() - 0.2::double) THEN c[y + 1] * cos(0.2::double) - sqrt(1 - c[y + 1] * c[y + 1]) * sin(0.2::double) ELSE c[y + 1] - sin(pi() - 0.2::double) * 0.2::double END, 5) AS at_label FROM c""")
def margin_logits(spark, sf_dir):
    part = lambda a: V.doubles(F.slice("embedding", a, 8))
    rows = table(spark, sf_dir, "embeddings").select("vec_id", part(1).alias("x"), F.array(part(9), part(17), part(25)).alias("w"), (F.col("vec_id") % 3).cast("int").alias("y"))
    plain, turned = V.margin_logits(F.col("x"), F.col("w")), V.margin_logits(F.col("x"), F.col("w"), F.col("y"))
    return rows.select("vec_id", F.round(plain[0], 5).alias("plain"), F.round(F.element_at(turned, F.col("y") + 1), 5).alias("at_label"))


@query("""WITH v AS (SELECT vec_id, vec_id // 32 AS batch, vec_id % 2 AS label, list_transform(embedding[1:32], lambda x: x::double) AS a0, list_transform(embedding[33:64], lambda x: x::double) AS b0 FROM embeddings),
u AS (SELECT vec_id, batch, label, list_transform(a0, lambda x: x / sqrt(list_inner_product(a0, a0))) AS a, list_transform(b0, lambda x: x / sqrt(list_inner_product(b0, b0))) AS b FROM v),
s AS (SELECT p.batch, p.vec_id AS i, q.vec_id AS j, list_inner_product(p.a, q.b) / 0.07::double AS s1, list_inner_product(p.b, q.a) / 0.07::double AS s2 FROM u p JOIN u q ON p.batch = q.batch WHERE p.label = 1),
l AS (SELECT batch, i, ln(sum(exp(s1))) - max(CASE WHEN i = j THEN s1 END) AS l1, ln(sum(exp(s2))) - max(CASE WHEN i = j THEN s2 END) AS l2 FROM s GROUP BY batch, i),
n AS (SELECT batch, count(*) FILTER (label = 1) AS n_pos FROM v GROUP BY batch)
SELECT n.batch, n_pos, round(coalesce(loss, 0), 6) AS loss FROM n LEFT JOIN (SELECT batch, avg((l1 + l2) / 2) AS loss FROM l GROUP BY batch) USING (batch)""")
def info_nce(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    rows = e.select(F.floor(F.col("vec_id") / 32).alias("batch"), F.col("vec_id").alias("i"), F.slice("embedding", 1, 32).alias("vec1"), F.slice("embedding", 33, 32).alias("vec2"), (F.col("vec_id") % 2).alias("label"))
    return rounded(L.info_nce(rows))


EVALUATED = metric_sql("c", "rule,")


@query(f"""WITH {Q.SCORED}, c AS (SELECT rule, count(*) FILTER (label = 1 AND score >= t) AS tp, count(*) FILTER (label = 0 AND score >= t) AS fp, count(*) FILTER (label = 1 AND score < t) AS fn, count(*) FILTER (label = 0 AND score < t) AS tn FROM scored, (VALUES ('argmax', 0.5::double), ('calibrated', 0.6::double)) v(rule, t) GROUP BY rule),
g AS (SELECT score, count(*) FILTER (label = 1) AS p, count(*) FILTER (label = 0) AS n FROM scored GROUP BY score),
r AS (SELECT *, coalesce(sum(p) OVER (ORDER BY score DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS pp, sum(p) OVER (ORDER BY score DESC) AS cp, sum(n) OVER (ORDER BY score DESC) AS cn FROM g)
SELECT m.*, (SELECT round((sum(n * (pp + p / 2.0::double)) / (sum(p) * sum(n)))::double, 6) FROM r) AS auc, (SELECT round((sum(p * cp::double / (cp + cn)) / sum(p))::double, 6) FROM r) AS ap FROM ({EVALUATED}) m""")
def evaluation(spark, sf_dir):
    return rounded(M.evaluation(scored(spark, sf_dir), 0.6))


@query(f"""WITH w AS (SELECT doc_id, list_transform({Q.words('text')}, lambda x: length(x) * 9000) AS ids FROM documents)
SELECT doc_id, round(coalesce(len(list_distinct(ids[1:64]))::double / nullif(len(ids[1:64]), 0), 0), 6) AS type_token_ratio, round(coalesce(len(list_filter(ids, lambda x: x > 50000))::double / nullif(len(ids[1:64]), 0), 0), 6) AS punct_ratio, round(len(ids[1:64]) / 4.0::double, 6) AS avg_length FROM w""")
def token_style(spark, sf_dir):
    """Word lengths stand for token ids; the mask holds the first 64."""
    ids = F.transform(T.words(F.col("text")), lambda w: F.length(w) * 9000)
    rows = table(spark, sf_dir, "documents").select("doc_id", ids.alias("ids"))
    f = T.token_style_features(F.col("ids"), F.transform("ids", lambda x, i: (i < 64).cast("int")), 4)
    return rows.select("doc_id", f.alias("f")).select("doc_id", *[F.round(F.col("f")[c].cast("double"), 6).alias(c) for c in ("type_token_ratio", "punct_ratio", "avg_length")])
