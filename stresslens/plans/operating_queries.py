"""Operating points and resampling by name."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stresslens.operators import grid, operating, pairs, resample
from stresslens.operators.metrics import r6
from stresslens.plans.metric_queries import _CONF, _RATES, _W
from stresslens.plans.registry import query

COVERAGES = (1.0, 0.95, 0.9, 0.8, 0.7, 0.6, 0.5)

_FPR = f"""{_W}, n AS (SELECT method_id, p, row_number() OVER (PARTITION BY method_id ORDER BY p DESC, source_id) AS i, count(*) OVER (PARTITION BY method_id) AS n FROM pred WHERE condition_id = 'clean' AND label = 0),
t AS (SELECT method_id, max(n) AS n, CAST(floor(max(n) * CAST(0.05 AS double)) AS bigint) AS k, max(CASE WHEN i = CAST(floor(n * CAST(0.05 AS double)) AS bigint) THEN p END) AS threshold FROM n GROUP BY method_id)
"""


@query("w05_fpr_matched", _FPR + "SELECT t.method_id, CAST(n AS bigint) AS negatives, k, round(threshold, 6) AS threshold, round((SELECT CAST(count(*) AS double) FROM n WHERE n.method_id = t.method_id AND n.p >= t.threshold) / n, 6) AS realised_fpr, k = 0 AS above_all FROM t")
def w05(spark: SparkSession, d: str) -> DataFrame:
    return operating.fpr_matched(grid.predictions(spark, d), 0.05)


@query("b07_realised_fpr", _FPR + "SELECT t.method_id, round((SELECT CAST(count(*) AS double) FROM n WHERE n.method_id = t.method_id AND n.p >= t.threshold) / n - CAST(0.05 AS double), 6) AS overshoot FROM t")
def b07(spark: SparkSession, d: str) -> DataFrame:
    return operating.fpr_matched(grid.predictions(spark, d), 0.05).select("method_id", r6(F.col("realised_fpr") - 0.05).alias("overshoot"))


_CURVE = """cs AS (SELECT method_id, p AS threshold, sum(label) AS pos, sum(1 - label) AS neg FROM pred WHERE condition_id = 'clean' GROUP BY ALL),
cc AS (SELECT method_id, threshold, sum(pos) OVER w AS tp, sum(neg) OVER w AS fp, sum(pos) OVER (PARTITION BY method_id) AS n_pos, sum(neg) OVER (PARTITION BY method_id) AS n_neg FROM cs WINDOW w AS (PARTITION BY method_id ORDER BY threshold DESC ROWS UNBOUNDED PRECEDING)),
cr AS (SELECT method_id, threshold, CAST(fp AS double) / n_neg AS fpr, (CAST(tp AS double) / n_pos + 1 - CAST(fp AS double) / n_neg) / 2 AS bacc FROM cc)"""


@query("b06_candidates", f"{_W} SELECT method_id, CAST(count(DISTINCT p) AS bigint) AS candidates, round(min(p), 6) AS low, round(max(p), 6) AS high FROM pred GROUP BY ALL")
def b06(spark: SparkSession, d: str) -> DataFrame:
    c = operating.candidates(grid.predictions(spark, d), ["method_id"])
    return c.groupBy("method_id").agg(F.count("*").alias("candidates"), r6(F.min("threshold")).alias("low"), r6(F.max("threshold")).alias("high"))


@query("b06b_quantile_candidates", f"{_W} SELECT method_id, round(unnest(list_distinct(quantile_cont(p, [i / 256.0::double FOR i IN range(257)]))), 6) AS threshold FROM pred GROUP BY method_id")
def b06b(spark: SparkSession, d: str) -> DataFrame:
    return operating.quantile_candidates(grid.predictions(spark, d), ["method_id"]).select("method_id", r6(F.col("threshold")).alias("threshold"))


@query("b08_quantile_threshold", f"{_W} SELECT method_id, round(quantile_cont(p, 1 - CAST(0.05 AS double)), 6) AS threshold, CAST(count(*) AS bigint) AS n_clean FROM pred WHERE condition_id = 'clean' AND label = 0 GROUP BY ALL")
def b08(spark: SparkSession, d: str) -> DataFrame:
    return operating.quantile_threshold(grid.predictions(spark, d), 0.05)


@query("b09_best_accuracy", f"{_W}, {_CURVE} SELECT method_id, threshold, round(CAST(tp + n_neg - fp AS double) / (n_pos + n_neg), 6) AS accuracy FROM cc QUALIFY row_number() OVER (PARTITION BY method_id ORDER BY tp + n_neg - fp DESC, threshold) = 1")
def b09(spark: SparkSession, d: str) -> DataFrame:
    return operating.best_accuracy(grid.predictions(spark, d).where("condition_id = 'clean'"), ["method_id"])


_TWO = ", two AS (SELECT a.source_id, a.condition_id, a.label, a.p AS p_a, b.p AS p_b, a.family, a.reliability FROM pred a JOIN pred b ON a.source_id = b.source_id AND a.condition_id = b.condition_id AND a.method_id = 'm1' AND b.method_id = 'm2')"


@query("a26_rescue", f"""{_W}{_TWO}, s AS (SELECT family, grouping(family) AS g, count(*) AS n, count(*) FILTER (WHERE (p_a >= 0.5) <> (label = 1) AND (p_b >= 0.5) = (label = 1)) AS c,
count(*) FILTER (WHERE (p_a >= 0.5) = (label = 1) AND (p_b >= 0.5) <> (label = 1)) AS h, count(*) FILTER (WHERE (p_a >= 0.5) <> (label = 1)) AS w FROM two GROUP BY ROLLUP (family))
SELECT CASE WHEN g = 1 THEN 'all' ELSE family END AS family, CAST(n AS bigint) AS n, CAST(c AS bigint) AS corrections, CAST(h AS bigint) AS harms, CAST(c - h AS bigint) AS net, round(1000 * (c - h) / CAST(n AS double), 6) AS net_per_1000, round(c / CAST(nullif(w, 0) AS double), 6) AS p_right_if_wrong FROM s""")
def a26(spark: SparkSession, d: str) -> DataFrame:
    return operating.rescue(grid.with_family(pairs.two_methods(grid.predictions(spark, d), "m1", "m2")))


@query("b10_rescue_threshold", f"""{_W}{_TWO}, s AS (SELECT round(p_b, 4) AS t, label, (p_a >= 0.5) <> (label = 1) AS wrong, count(*) AS n FROM two GROUP BY ALL), t AS (SELECT DISTINCT t FROM s),
x AS (SELECT t.t AS threshold, sum(CASE WHEN wrong AND (s.t >= t.t) = (label = 1) THEN n WHEN NOT wrong AND (s.t >= t.t) <> (label = 1) THEN -n ELSE 0 END) AS net FROM t, s GROUP BY t.t)
SELECT CAST(net AS bigint) AS net, threshold FROM x ORDER BY net DESC, threshold LIMIT 1""")
def b10(spark: SparkSession, d: str) -> DataFrame:
    return operating.rescue_threshold(pairs.two_methods(grid.predictions(spark, d), "m1", "m2"))


_RISK = f"""{_W}, r AS (SELECT method_id, CASE WHEN (p >= 0.5) = (label = 1) THEN 1 ELSE 0 END AS ok, row_number() OVER (PARTITION BY method_id ORDER BY reliability DESC, source_id, idx) AS i, count(*) OVER (PARTITION BY method_id) AS n FROM pred),
k AS (SELECT DISTINCT method_id, coverage, CAST(greatest(round_even(coverage * n, 0), 1) AS bigint) AS k FROM r, (VALUES {', '.join(f'(CAST({c} AS double))' for c in COVERAGES)}) c(coverage)),
risk AS (SELECT k.method_id, k.coverage, k.k, round(avg(ok), 6) AS accuracy FROM k JOIN r ON r.method_id = k.method_id AND r.i <= k.k GROUP BY ALL)"""


@query("a33_selective_risk", f"{_RISK} SELECT * FROM risk")
def a33(spark: SparkSession, d: str) -> DataFrame:
    return operating.selective_risk(grid.predictions(spark, d), COVERAGES)


@query("b14_abstention_policy", f"""{_RISK}, b AS (SELECT method_id, accuracy AS base FROM risk WHERE coverage = 1)
SELECT b.method_id, base AS accuracy_all, x.coverage, x.accuracy FROM b LEFT JOIN (SELECT r.* FROM risk r JOIN b USING (method_id) WHERE coverage < 1 AND accuracy >= base + CAST(0.02 AS double) QUALIFY row_number() OVER (PARTITION BY r.method_id ORDER BY coverage DESC) = 1) x ON x.method_id = b.method_id""")
def b14(spark: SparkSession, d: str) -> DataFrame:
    return operating.abstention_policy(operating.selective_risk(grid.predictions(spark, d), COVERAGES))


@query("b14b_frozen_abstention", f"""{_RISK}, b AS (SELECT method_id, accuracy AS base FROM risk WHERE coverage = 1),
x AS (SELECT b.method_id, base, r.coverage, r.accuracy FROM b LEFT JOIN (SELECT r.* FROM risk r JOIN b USING (method_id) WHERE coverage < 1 AND accuracy >= base + CAST(0.02 AS double) QUALIFY row_number() OVER (PARTITION BY r.method_id ORDER BY coverage DESC) = 1) r ON r.method_id = b.method_id),
o AS (SELECT method_id, reliability, row_number() OVER (PARTITION BY method_id ORDER BY reliability) - 1 AS pos, count(*) OVER (PARTITION BY method_id) AS n FROM pred),
h AS (SELECT method_id, coverage, (n - 1) * (1 - CAST(coverage AS double)) AS h, reliability, pos FROM o JOIN x USING (method_id)),
q AS (SELECT method_id, max(reliability) FILTER (WHERE pos = floor(h)) AS lo, max(reliability) FILTER (WHERE pos = floor(h) + 1) AS hi, max(h - floor(h)) AS part FROM h GROUP BY method_id)
SELECT x.method_id, coverage IS NOT NULL AS adopted, round(lo + coalesce((hi - lo) * part, 0), 6) AS reliability_threshold, coverage, accuracy, base AS accuracy_all, round(accuracy - base, 6) AS gain FROM x LEFT JOIN q USING (method_id)""")
def b14b(spark: SparkSession, d: str) -> DataFrame:
    f = operating.frozen_abstention(grid.predictions(spark, d), COVERAGES)
    return f.withColumn("reliability_threshold", r6("reliability_threshold"))


@query("a22_abstention_table", f"""{_W}, x AS (SELECT *, CASE WHEN (p >= 0.5) = (label = 1) THEN 1.0 ELSE 0.0 END AS ok, reliability >= 0.3 AS kept FROM pred),
f AS (SELECT method_id, family, {_RATES} FROM (SELECT method_id, family, {_CONF} FROM x WHERE kept AND family <> 'clean' GROUP BY ALL)),
w AS (SELECT method_id, recall AS worst_recall, family AS worst_family FROM f QUALIFY row_number() OVER (PARTITION BY method_id ORDER BY recall, family) = 1),
g AS (SELECT method_id, round(avg(CASE WHEN kept THEN 1.0 ELSE 0.0 END), 6) AS coverage, round(avg(ok), 6) AS accuracy_all, round(avg(ok) FILTER (WHERE kept), 6) AS accuracy_kept, round(avg(ok) FILTER (WHERE NOT kept), 6) AS accuracy_deferred FROM x GROUP BY ALL)
SELECT g.*, worst_recall, worst_family FROM g LEFT JOIN w USING (method_id)""")
def a22(spark: SparkSession, d: str) -> DataFrame:
    return operating.abstention(grid.predictions(spark, d), 0.3)


_STATS = ", st AS (SELECT method_id, source_id, family, count(*) AS n, count(*) FILTER (WHERE p >= 0.5) AS hit FROM pred WHERE family <> 'clean' AND label = 1 GROUP BY ALL)"
REPLICATES = 1000


SEED = 20260826


def _draws(where: str) -> str:
    return ", " + resample.draws_sql(f"SELECT o_orderkey AS source_id, CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END AS label FROM orders {where}", REPLICATES, SEED)


#: By the bootstrap mean of each allowed candidate among the lowest six; recalls fall as thresholds rise, so the others can't be better.
@query("b05_select_threshold", f"""{_W}{_draws("WHERE o_orderstatus = 'F'")},
ca AS (SELECT DISTINCT method_id, least(greatest(p, 0), 1) AS threshold FROM pred),
cl AS (SELECT method_id, p, sum(label) AS pos, sum(1 - label) AS neg FROM pred WHERE condition_id = 'clean' GROUP BY ALL),
nn AS (SELECT method_id, sum(pos) AS n_pos, sum(neg) AS n_neg, CAST(sum(CASE WHEN p >= 0.5 THEN neg ELSE 0 END) AS double) / sum(neg) AS base_fpr,
  (CAST(sum(CASE WHEN p >= 0.5 THEN pos ELSE 0 END) AS double) / sum(pos) + 1 - CAST(sum(CASE WHEN p >= 0.5 THEN neg ELSE 0 END) AS double) / sum(neg)) / 2 AS base_bacc FROM cl GROUP BY ALL),
cr AS (SELECT ca.method_id, ca.threshold, coalesce(sum(pos), 0) AS tp, coalesce(sum(neg), 0) AS fp FROM ca LEFT JOIN cl ON cl.method_id = ca.method_id AND cl.p >= ca.threshold GROUP BY ALL),
cx AS (SELECT cr.*, CAST(fp AS double) / n_neg AS fpr, (CAST(tp AS double) / n_pos + 1 - CAST(fp AS double) / n_neg) / 2 AS bacc, base_fpr, base_bacc FROM cr JOIN nn USING (method_id)),
ok AS (SELECT *, row_number() OVER (PARTITION BY method_id ORDER BY threshold) AS r FROM cx WHERE fpr <= base_fpr + CAST(0.01 AS double) AND bacc >= base_bacc - CAST(0.01 AS double) QUALIFY r <= 6),
sx AS (SELECT p.method_id, source_id, family, r, count(*) AS n, count(*) FILTER (WHERE p >= threshold) AS hit FROM pred p JOIN ok ON ok.method_id = p.method_id WHERE family <> 'clean' AND label = 1 GROUP BY ALL),
fa AS (SELECT method_id, replicate, family, r, CAST(sum(times * hit) AS double) / sum(times * n) AS recall FROM dr JOIN sx USING (source_id) GROUP BY ALL),
wo AS (SELECT method_id, replicate, r, min(recall) AS worst FROM fa GROUP BY ALL),
ob AS (SELECT method_id, r, round(avg(worst), 12) AS objective, quantile_cont(worst, CAST(0.025 AS double)) AS low, quantile_cont(worst, CAST(0.975 AS double)) AS high FROM wo GROUP BY ALL),
b AS (SELECT ok.*, objective, low, high FROM ok JOIN ob USING (method_id, r) QUALIFY row_number() OVER (PARTITION BY method_id ORDER BY objective DESC, bacc DESC, fpr, threshold DESC) = 1),
hits AS (SELECT p.method_id, family, condition_id, CASE WHEN p >= threshold THEN 1.0 ELSE 0.0 END AS hit FROM pred p JOIN b ON b.method_id = p.method_id WHERE family <> 'clean' AND label = 1),
hf AS (SELECT method_id, family FROM hits GROUP BY method_id, family QUALIFY row_number() OVER (PARTITION BY method_id ORDER BY avg(hit), family) = 1),
hc AS (SELECT method_id, condition_id, avg(hit) AS recall FROM hits GROUP BY method_id, condition_id QUALIFY row_number() OVER (PARTITION BY method_id ORDER BY avg(hit), condition_id) = 1)
SELECT method_id, threshold, round(objective, 6) AS objective, round(low, 6) AS low, round(high, 6) AS high, round(bacc, 6) AS balanced_accuracy, round(fpr, 6) AS fpr, true AS feasible, hf.family AS worst_family, hc.condition_id AS worst_condition, round(recall, 6) AS worst_condition_recall
FROM b JOIN hf USING (method_id) JOIN hc USING (method_id)""")
def b05(spark: SparkSession, d: str) -> DataFrame:
    return operating.select_threshold(grid.predictions(spark, d), replicates=REPLICATES, seed=SEED)


_WORST = f"""{_STATS}{_draws("WHERE o_orderstatus = 'F'")}, fa AS (SELECT method_id, replicate, family, CAST(sum(times * hit) AS double) / sum(times * n) AS recall FROM dr JOIN st USING (source_id) GROUP BY ALL),
wo AS (SELECT method_id, replicate, min(recall) AS worst FROM fa GROUP BY ALL)"""


def _interval(name: str) -> str:
    return f"round(avg({name}), 6) AS mean, round(quantile_cont({name}, CAST(0.025 AS double)), 6) AS low, round(quantile_cont({name}, CAST(0.975 AS double)), 6) AS high"


@query("b01_bootstrap_strat", f"{_W}{_WORST} SELECT method_id, {_interval('worst')} FROM wo GROUP BY ALL")
def b01(spark: SparkSession, d: str) -> DataFrame:
    w = resample.worst_family(resample.contributions(grid.predictions(spark, d)), REPLICATES, SEED)
    return resample.interval(w, ["method_id"], "worst")


@query("b02_paired_delta", f"{_W}{_WORST}, de AS (SELECT b.worst - a.worst AS delta FROM wo a JOIN wo b ON a.replicate = b.replicate AND a.method_id = 'm1' AND b.method_id = 'm2') SELECT {_interval('delta')} FROM de")
def b02(spark: SparkSession, d: str) -> DataFrame:
    w = resample.worst_family(resample.contributions(grid.predictions(spark, d)), REPLICATES, SEED)
    return resample.interval(resample.paired_delta(w, "m1", "m2"), [], "delta")


_RATE = ("recall", "fpr", "balanced_accuracy")


@query("b04_ci_block", f"""{_W}{_draws("")}, m AS (SELECT p.method_id, replicate, CAST(sum(CASE WHEN label = 1 AND p >= 0.5 THEN times ELSE 0 END) AS double) / sum(CASE WHEN label = 1 THEN times ELSE 0 END) AS recall,
CAST(sum(CASE WHEN label = 0 AND p >= 0.5 THEN times ELSE 0 END) AS double) / sum(CASE WHEN label = 0 THEN times ELSE 0 END) AS fpr FROM dr JOIN pred p USING (source_id) WHERE condition_id = 'clean' GROUP BY ALL),
v AS ({" UNION ALL ".join(f"SELECT method_id, '{m}' AS metric, {'(recall + 1 - fpr) / 2' if m == 'balanced_accuracy' else m} AS value FROM m" for m in _RATE)})
SELECT method_id, metric, {_interval('value')} FROM v GROUP BY ALL""")
def b04(spark: SparkSession, d: str) -> DataFrame:
    clean = grid.predictions(spark, d).where("condition_id = 'clean'")
    return resample.ci_block(resample.rate_replicates(clean, REPLICATES, SEED), _RATE)


@query("b04b_ci_auroc", f"""{_W}{_draws("")}, h AS (SELECT p.method_id, replicate, p, CAST(sum(times * label) AS double) AS pos, CAST(sum(times * (1 - label)) AS double) AS neg FROM dr JOIN pred p USING (source_id) WHERE condition_id = 'clean' GROUP BY ALL),
a AS (SELECT *, pos * (coalesce(sum(neg) OVER (PARTITION BY method_id, replicate ORDER BY p ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + neg / 2) AS area FROM h),
m AS (SELECT method_id, replicate, sum(area) / (sum(pos) * sum(neg)) AS auroc FROM a GROUP BY ALL) SELECT method_id, 'auroc' AS metric, {_interval('auroc')} FROM m GROUP BY ALL""")
def b04b(spark: SparkSession, d: str) -> DataFrame:
    clean = grid.predictions(spark, d).where("condition_id = 'clean'")
    return resample.ci_block(resample.auroc_replicates(clean, REPLICATES, SEED), ("auroc",))


@query("b15_pairwise_deltas", f"{_W} SELECT a.method_id AS method_a, b.method_id AS method_b, a.family, round(b.recall - a.recall, 6) AS delta FROM (SELECT method_id, family, {_RATES} FROM (SELECT method_id, family, {_CONF} FROM pred GROUP BY ALL)) a JOIN (SELECT method_id, family, {_RATES} FROM (SELECT method_id, family, {_CONF} FROM pred GROUP BY ALL)) b ON a.family = b.family AND a.method_id < b.method_id")
def b15(spark: SparkSession, d: str) -> DataFrame:
    from stresslens.operators import metrics

    r = metrics.confusion(grid.predictions(spark, d), ["method_id", "family"]).select("method_id", "family", *metrics.rates())
    a, b = r.select(F.col("method_id").alias("method_a"), "family", F.col("recall").alias("x")), r.select(F.col("method_id").alias("method_b"), "family", F.col("recall").alias("y"))
    return a.join(b, "family").where("method_a < method_b").select("method_a", "method_b", "family", r6(F.col("y") - F.col("x")).alias("delta"))
