"""Metrics, pairs and retention by name."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stresslens.operators import grid, metrics, pairs
from stresslens.operators.metrics import r6
from stresslens.plans.registry import ORACLES, query

KEY = ["method_id", "condition_id"]
_W = "WITH " + grid.SQL
_CONF = """CAST(count(*) FILTER (WHERE label = 1 AND p >= 0.5) AS bigint) AS tp, CAST(count(*) FILTER (WHERE label = 1 AND p < 0.5) AS bigint) AS fn,
CAST(count(*) FILTER (WHERE label = 0 AND p >= 0.5) AS bigint) AS fp, CAST(count(*) FILTER (WHERE label = 0 AND p < 0.5) AS bigint) AS tn"""
_RATES = """round(tp / CAST(nullif(tp + fn, 0) AS double), 6) AS recall, round(tn / CAST(nullif(tn + fp, 0) AS double), 6) AS tnr, round(fp / CAST(nullif(tn + fp, 0) AS double), 6) AS fpr,
round((tp / CAST(nullif(tp + fn, 0) AS double) + tn / CAST(nullif(tn + fp, 0) AS double)) / 2, 6) AS balanced_accuracy"""


def _auroc_sql(source: str, by: str, score: str = "p", weight: str = "1", name: str = "auroc") -> str:
    b = f"{by}, " if by else ""
    part = f"PARTITION BY {by}" if by else ""
    group = f"GROUP BY {by}" if by else ""
    return f"""SELECT {b}round(sum(ps * (coalesce(below, 0) + ns / 2.0::double)) / nullif(CAST(sum(ps) AS double) * CAST(sum(ns) AS double), 0), 6) AS {name} FROM (
  SELECT {b}ps, ns, CAST(sum(ns) OVER ({part} ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS double) AS below FROM (
    SELECT {b}{score} AS s, CAST(sum(CASE WHEN label = 1 THEN {weight} ELSE 0 END) AS double) AS ps, CAST(sum(CASE WHEN label = 0 THEN {weight} ELSE 0 END) AS double) AS ns FROM {source} GROUP BY {b}{score})) {group}"""


@query("a01_confusion", f"{_W} SELECT method_id, condition_id, {_CONF} FROM pred GROUP BY ALL")
def a01(spark: SparkSession, d: str) -> DataFrame:
    return metrics.confusion(grid.predictions(spark, d), KEY)


@query("a02_rates", f"{_W} SELECT method_id, condition_id, {_RATES} FROM (SELECT method_id, condition_id, {_CONF} FROM pred GROUP BY ALL)")
def a02(spark: SparkSession, d: str) -> DataFrame:
    return metrics.confusion(grid.predictions(spark, d), KEY).select(*KEY, *metrics.rates())


@query("a03_auroc", _W + _auroc_sql("pred", "method_id, condition_id"))
def a03(spark: SparkSession, d: str) -> DataFrame:
    return metrics.auroc(grid.predictions(spark, d), KEY)


@query("a04_auroc_weighted", _W + _auroc_sql("pred", "method_id, condition_id", weight="(1 + source_id % 3)"))
def a04(spark: SparkSession, d: str) -> DataFrame:
    return metrics.auroc(grid.predictions(spark, d).withColumn("w", 1 + F.col("source_id") % 3), KEY, weight="w")


@query("a07_signed_auroc", f"{_W} SELECT method_id, condition_id, round(greatest(auroc, 1 - auroc), 6) AS separation, CASE WHEN auroc >= 0.5 THEN 'higher' ELSE 'lower' END AS direction FROM ({_auroc_sql('pred', 'method_id, condition_id', 'reliability')})")
def a07(spark: SparkSession, d: str) -> DataFrame:
    a = metrics.auroc(grid.predictions(spark, d), KEY, p="reliability")
    return a.select(*KEY, r6(F.greatest("auroc", 1 - F.col("auroc"))).alias("separation"), F.when(F.col("auroc") >= 0.5, "higher").otherwise("lower").alias("direction"))


@query("a08_avg_precision", f"""{_W}, g AS (SELECT method_id, condition_id, p AS s, CAST(sum(label) AS double) AS ps, CAST(count(*) AS double) AS n FROM pred GROUP BY ALL),
c AS (SELECT *, sum(ps) OVER w AS t, sum(n) OVER w AS a FROM g WINDOW w AS (PARTITION BY method_id, condition_id ORDER BY s DESC ROWS UNBOUNDED PRECEDING))
SELECT method_id, condition_id, round(sum(ps * t / a) / nullif(sum(ps), 0), 6) AS average_precision FROM c GROUP BY ALL""")
def a08(spark: SparkSession, d: str) -> DataFrame:
    return metrics.average_precision(grid.predictions(spark, d), KEY)


@query("a09_brier", f"{_W} SELECT method_id, condition_id, round(avg((p - label) * (p - label)), 6) AS brier FROM pred GROUP BY ALL")
def a09(spark: SparkSession, d: str) -> DataFrame:
    return grid.predictions(spark, d).groupBy(*KEY).agg(r6(metrics.brier()).alias("brier"))


_CLIP = "least(greatest(p, CAST(1e-12 AS double)), 1 - CAST(1e-12 AS double))"


@query("a10_nll", f"{_W} SELECT method_id, condition_id, round(-avg(CASE WHEN label = 1 THEN ln({_CLIP}) ELSE ln(1 - {_CLIP}) END), 6) AS nll FROM pred GROUP BY ALL")
def a10(spark: SparkSession, d: str) -> DataFrame:
    return grid.predictions(spark, d).groupBy(*KEY).agg(r6(metrics.nll()).alias("nll"))


def _ece_sql(bin_: str) -> str:
    return f"""SELECT method_id, condition_id, round(sum(n * abs(c - y)) / sum(n), 6) AS ece FROM (
SELECT method_id, condition_id, {bin_} AS b, CAST(count(*) AS double) AS n, avg(p) AS c, avg(label) AS y FROM pred GROUP BY ALL) GROUP BY ALL"""


@query("a11_ece15", f"{_W} {_ece_sql('least(floor(p * 15), 14)')}")
def a11(spark: SparkSession, d: str) -> DataFrame:
    return metrics.calibration_error(grid.predictions(spark, d), KEY)


@query("a12_ece_variant", f"{_W} {_ece_sql('least(greatest(ceil(p * 15) - 1, 0), 14)')}")
def a12(spark: SparkSession, d: str) -> DataFrame:
    return metrics.calibration_error(grid.predictions(spark, d), KEY, right=True)


_EACH = "".join(f" JOIN ({ORACLES[n]}) USING (method_id, condition_id)" for n in ("a09_brier", "a10_nll", "a03_auroc", "a08_avg_precision", "a11_ece15"))


@query("a13_condition_bundle", f"{_W}, b AS (SELECT method_id, condition_id, CAST(count(*) AS bigint) AS n, {_CONF} FROM pred GROUP BY ALL) SELECT * EXCLUDE (tp, fn, fp, tn) FROM (SELECT *, {_RATES} FROM b){_EACH}")
def a13(spark: SparkSession, d: str) -> DataFrame:
    return metrics.bundle(grid.predictions(spark, d), KEY)


@query("a16_family_pool", f"{_W} SELECT method_id, family, tp, fn, {_RATES} FROM (SELECT method_id, family, {_CONF} FROM pred WHERE family <> 'clean' GROUP BY ALL)")
def a16(spark: SparkSession, d: str) -> DataFrame:
    return metrics.family_recall(grid.predictions(spark, d))


@query("a17_worst_family", f"""{_W}, f AS (SELECT method_id, family, {_RATES} FROM (SELECT method_id, family, {_CONF} FROM pred WHERE family <> 'clean' GROUP BY ALL))
SELECT method_id, recall AS worst_recall, family AS worst_family FROM f QUALIFY row_number() OVER (PARTITION BY method_id ORDER BY recall, family) = 1""")
def a17(spark: SparkSession, d: str) -> DataFrame:
    return metrics.worst(metrics.family_recall(grid.predictions(spark, d)), ["method_id"], "family")


@query("a17b_worst_condition", f"""{_W}, f AS (SELECT method_id, condition_id, {_RATES} FROM (SELECT method_id, condition_id, {_CONF} FROM pred WHERE condition_id <> 'clean' GROUP BY ALL))
SELECT method_id, recall AS worst_recall, condition_id AS worst_condition_id FROM f QUALIFY row_number() OVER (PARTITION BY method_id ORDER BY recall, condition_id) = 1""")
def a17b(spark: SparkSession, d: str) -> DataFrame:
    return metrics.worst(metrics.confusion(grid.predictions(spark, d), KEY).select(*KEY, *metrics.rates()), ["method_id"], "condition_id")


@query("a18_weighted_block", f"""{_W}, w AS (SELECT *, CAST(1 + source_id % 3 AS double) AS w FROM pred)
SELECT method_id, family, round(sum(w) FILTER (WHERE label = 1 AND p >= 0.5) / sum(w) FILTER (WHERE label = 1), 6) AS recall,
round(sum(w) FILTER (WHERE label = 0 AND p >= 0.5) / sum(w) FILTER (WHERE label = 0), 6) AS fpr,
round(sum(CASE WHEN (p >= 0.5) = (label = 1) THEN w ELSE 0 END) / sum(w), 6) AS accuracy FROM w GROUP BY ALL""")
def a18(spark: SparkSession, d: str) -> DataFrame:
    w, hit, y = F.col("w"), F.col("p") >= 0.5, F.col("label") == 1
    rows = grid.predictions(spark, d).withColumn("w", (1 + F.col("source_id") % 3).cast("double"))
    share = lambda of, among: r6(F.try_divide(F.sum(F.when(of & among, w)), F.sum(F.when(among, w))))
    return rows.groupBy("method_id", "family").agg(share(hit, y).alias("recall"), share(hit, ~y).alias("fpr"), share(hit == y, F.lit(True)).alias("accuracy"))


@query("a19_grouping_sets", f"""{_W}, s AS (SELECT method_id, family, condition_id, {_CONF} FROM pred GROUP BY GROUPING SETS ((method_id, condition_id), (method_id, family), (method_id)))
SELECT method_id, CASE WHEN condition_id IS NOT NULL THEN 'condition' WHEN family IS NOT NULL THEN 'family' ELSE 'overall' END AS level, coalesce(condition_id, family, 'all') AS name, tp, fn, fp, tn, {_RATES} FROM s""")
def a19(spark: SparkSession, d: str) -> DataFrame:
    return metrics.grouping_sets(grid.predictions(spark, d))


_CLEAN = ", c AS (SELECT method_id, source_id, p AS clean_p FROM pred WHERE condition_id = 'clean'), j AS (SELECT t.*, c.clean_p FROM pred t JOIN c USING (method_id, source_id))"


@query("j01_clean_join", f"{_W}{_CLEAN} SELECT method_id, condition_id, CAST(count(*) AS bigint) AS n, round(avg(clean_p - p), 6) AS mean_drop, round(max(clean_p - p), 6) AS max_drop FROM j WHERE condition_id <> 'clean' GROUP BY ALL")
def j01(spark: SparkSession, d: str) -> DataFrame:
    j = pairs.with_clean(grid.predictions(spark, d)).where("condition_id <> 'clean'")
    drop = F.col("clean_p") - F.col("p")
    return j.groupBy(*KEY).agg(F.count("*").alias("n"), r6(F.avg(drop)).alias("mean_drop"), r6(F.max(drop)).alias("max_drop"))


@query("j02_method_pairs", f"""{_W} SELECT a.condition_id, CAST(count(*) AS bigint) AS n, CAST(count(*) FILTER (WHERE (a.p >= 0.5) <> (b.p >= 0.5)) AS bigint) AS disagree, round(avg(b.p - a.p), 6) AS mean_delta
FROM pred a JOIN pred b ON a.source_id = b.source_id AND a.condition_id = b.condition_id AND a.method_id = 'm1' AND b.method_id = 'm2' GROUP BY ALL""")
def j02(spark: SparkSession, d: str) -> DataFrame:
    p = pairs.two_methods(grid.predictions(spark, d), "m1", "m2")
    return p.groupBy("condition_id").agg(F.count("*").alias("n"), F.count_if((F.col("p_a") >= 0.5) != (F.col("p_b") >= 0.5)).alias("disagree"), r6(F.avg(F.col("p_b") - F.col("p_a"))).alias("mean_delta"))


@query("a14_paired_flips", f"""{_W}{_CLEAN} SELECT method_id, condition_id, round(avg(CASE WHEN (p >= 0.5) <> (clean_p >= 0.5) THEN 1.0 ELSE 0.0 END), 6) AS flip_rate,
round(avg(CASE WHEN clean_p >= 0.5 AND p < 0.5 THEN 1.0 ELSE 0.0 END) FILTER (WHERE label = 1), 6) AS fake_to_real,
round(avg(CASE WHEN clean_p < 0.5 AND p >= 0.5 THEN 1.0 ELSE 0.0 END) FILTER (WHERE label = 0), 6) AS real_to_fake FROM j WHERE condition_id <> 'clean' GROUP BY ALL""")
def a14(spark: SparkSession, d: str) -> DataFrame:
    return pairs.flips(pairs.with_clean(grid.predictions(spark, d)).where("condition_id <> 'clean'"), KEY)


@query("a15_conditional_flips", f"""{_W}{_CLEAN} SELECT method_id, condition_id, CAST(count(*) AS bigint) AS n,
round(avg(CASE WHEN p < 0.5 THEN 1.0 ELSE 0.0 END) FILTER (WHERE label = 1), 6) AS fake_to_real, round(avg(CASE WHEN p >= 0.5 THEN 1.0 ELSE 0.0 END) FILTER (WHERE label = 0), 6) AS real_to_fake
FROM j WHERE condition_id <> 'clean' AND (clean_p >= 0.5) = (label = 1) GROUP BY ALL""")
def a15(spark: SparkSession, d: str) -> DataFrame:
    return pairs.conditional_flips(grid.predictions(spark, d), KEY)


@query("p11_signed_drop", f"{_W}{_CLEAN} SELECT method_id, family, label, round(avg(clean_p - p), 6) AS signed_drop FROM j WHERE condition_id <> 'clean' GROUP BY ALL")
def p11(spark: SparkSession, d: str) -> DataFrame:
    j = pairs.with_clean(grid.predictions(spark, d)).where("condition_id <> 'clean'")
    return j.groupBy("method_id", "family", "label").agg(r6(F.avg(F.col("clean_p") - F.col("p"))).alias("signed_drop"))


@query("a38_max_flip", f"""{_W}{_CLEAN}, f AS (SELECT method_id, condition_id, any_value(idx) AS idx, round(avg(CASE WHEN (p >= 0.5) <> (clean_p >= 0.5) THEN 1.0 ELSE 0.0 END), 6) AS flip_rate FROM j WHERE condition_id <> 'clean' GROUP BY method_id, condition_id)
SELECT method_id, condition_id, flip_rate FROM f QUALIFY row_number() OVER (PARTITION BY method_id ORDER BY flip_rate DESC, idx) = 1""")
def a38(spark: SparkSession, d: str) -> DataFrame:
    f = pairs.flips(pairs.with_clean(grid.predictions(spark, d)).where("condition_id <> 'clean'"), [*KEY, "idx"])
    best = f.groupBy("method_id").agg(F.max_by(F.struct("condition_id", "flip_rate"), F.struct("flip_rate", -F.col("idx"))).alias("x"))
    return best.select("method_id", "x.condition_id", "x.flip_rate")


_RET = _CLEAN + ", r AS (SELECT method_id, source_id, any_value(label) AS label, CAST(count(*) FILTER (WHERE (p >= 0.5) = (clean_p >= 0.5)) AS int) AS retained, any_value(clean_p) AS clean_p FROM j GROUP BY method_id, source_id HAVING count(*) = 20)"
_GRADE = "CASE WHEN retained = 20 THEN 'HIGH' WHEN retained >= 18 THEN 'MEDIUM' WHEN retained >= 15 THEN 'LOW' ELSE 'VERY LOW' END"


@query("a28_retention", f"{_W}{_RET} SELECT method_id, retained, CAST(count(*) AS bigint) AS sources FROM r GROUP BY ALL")
def a28(spark: SparkSession, d: str) -> DataFrame:
    return pairs.retention(grid.predictions(spark, d)).groupBy("method_id", "retained").agg(F.count("*").alias("sources"))


@query("p21_grade", f"{_W}{_RET} SELECT method_id, {_GRADE} AS grade, CAST(count(*) AS bigint) AS sources FROM r GROUP BY ALL")
def p21(spark: SparkSession, d: str) -> DataFrame:
    return pairs.graded(pairs.retention(grid.predictions(spark, d))).groupBy("method_id", "grade").agg(F.count("*").alias("sources"))


@query("a29_band_accuracy", f"{_W}{_RET} SELECT method_id, {_GRADE} AS grade, round(avg(CASE WHEN (clean_p >= 0.5) = (label = 1) THEN 1.0 ELSE 0.0 END), 6) AS accuracy, round(CAST(count(*) AS double) / sum(count(*)) OVER (PARTITION BY method_id), 6) AS share FROM r GROUP BY method_id, grade")
def a29(spark: SparkSession, d: str) -> DataFrame:
    return pairs.band_accuracy(pairs.graded(pairs.retention(grid.predictions(spark, d))))


@query("a30_flag_rules", f"""{_W}{_RET} SELECT method_id, t AS below, CAST(count(*) FILTER (WHERE retained < t) AS bigint) AS flagged,
round(CAST(count(*) FILTER (WHERE retained < t AND (clean_p >= 0.5) <> (label = 1)) AS double) / nullif(count(*) FILTER (WHERE (clean_p >= 0.5) <> (label = 1)), 0), 6) AS catch_share,
round(CAST(count(*) FILTER (WHERE retained < t AND (clean_p >= 0.5) <> (label = 1)) AS double) / nullif(count(*) FILTER (WHERE retained < t), 0), 6) AS precision,
round(CAST(count(*) FILTER (WHERE retained < t) AS double) / count(*), 6) AS defer_share FROM r, (VALUES (20), (19), (18), (17), (16)) x(t) GROUP BY method_id, t""")
def a30(spark: SparkSession, d: str) -> DataFrame:
    return pairs.flag_rules(pairs.retention(grid.predictions(spark, d)), (20, 19, 18, 17, 16))


@query("a06_auroc_retention", f"{_W}{_RET}, q AS (SELECT method_id, retained, CASE WHEN (clean_p >= 0.5) = (label = 1) THEN 1 ELSE 0 END AS label FROM r) {_auroc_sql('q', 'method_id', 'retained')}")
def a06(spark: SparkSession, d: str) -> DataFrame:
    r = pairs.retention(grid.predictions(spark, d))
    return metrics.auroc(r.withColumn("label", ((F.col("clean_p") >= 0.5) == (F.col("label") == 1)).cast("int")), ["method_id"], p="retained")


@query("a31_stress_summary", f"""{_W}{_CLEAN}, s AS (SELECT method_id, source_id, round(max(p) - min(p), 6) AS spread, CAST(count(*) FILTER (WHERE (p >= 0.5) <> (clean_p >= 0.5)) AS int) AS flips, CAST(count(*) AS int) AS n FROM j GROUP BY method_id, source_id)
SELECT method_id, CASE WHEN n < 20 THEN 'incomplete' WHEN flips = 0 THEN 'stable' ELSE 'unstable' END AS status, CAST(count(*) AS bigint) AS sources, round(avg(spread), 6) AS mean_spread, CAST(sum(flips) AS bigint) AS flips FROM s GROUP BY ALL""")
def a31(spark: SparkSession, d: str) -> DataFrame:
    s = pairs.stress_summary(grid.predictions(spark, d))
    return s.groupBy("method_id", "status").agg(F.count("*").alias("sources"), r6(F.avg("spread")).alias("mean_spread"), F.sum("n_flips").alias("flips"))


@query("b12_single_condition_auroc", f"""{_W}{_CLEAN}, s AS (SELECT method_id, condition_id, CASE WHEN (clean_p >= 0.5) = (label = 1) THEN 1 ELSE 0 END AS label, CASE WHEN (p >= 0.5) = (clean_p >= 0.5) THEN 1 ELSE 0 END AS kept FROM j WHERE condition_id <> 'clean')
{_auroc_sql('s', 'method_id, condition_id', 'kept')}""")
def b12(spark: SparkSession, d: str) -> DataFrame:
    j = pairs.with_clean(grid.predictions(spark, d)).where("condition_id <> 'clean'")
    right, kept = (F.col("clean_p") >= 0.5) == (F.col("label") == 1), (F.col("p") >= 0.5) == (F.col("clean_p") >= 0.5)
    return metrics.auroc(j.select(*KEY, right.cast("int").alias("label"), kept.cast("int").alias("kept")), KEY, p="kept")


@query("b11_greedy_selection")
def b11(spark: SparkSession, d: str) -> DataFrame:
    return pairs.greedy_conditions(grid.predictions(spark, d).where("method_id = 'm1'"), 19, 0.75)


_PART = "(method_id = 'm1' OR source_id % 11 < 9) AND (condition_id = 'clean' OR (source_id + CAST(length(condition_id) AS bigint)) % 5 > 0)"


def _part(rows: DataFrame) -> DataFrame:
    """Grids with gaps, and sources that one method lacks."""
    return rows.where(f"({_PART.replace('CAST(length(condition_id) AS bigint)', 'length(condition_id)')})")


@query("p21b_certificates", f"""{_W}, g AS (SELECT * FROM pred WHERE {_PART}), j AS (SELECT g.*, c.p AS clean_p FROM g JOIN g c ON g.method_id = c.method_id AND g.source_id = c.source_id AND c.condition_id = 'clean'),
r AS (SELECT method_id, source_id, any_value(clean_p) AS clean_p, CAST(count(*) FILTER (WHERE (p >= 0.5) = (clean_p >= 0.5)) AS int) AS retained, CAST(count(*) AS int) AS scored, arg_min(condition_id, (CASE WHEN clean_p >= 0.5 THEN p ELSE -p END, condition_id)) AS worst_condition FROM j GROUP BY ALL)
SELECT method_id, grade, measured_accuracy, worst_condition, CAST(count(*) AS bigint) AS sources, CAST(sum(retained) AS bigint) AS retained, CAST(sum(scored) AS bigint) AS scored, CAST(count(*) FILTER (WHERE scored = 20) AS bigint) AS complete, CAST(count(*) FILTER (WHERE clean_p >= 0.5) AS bigint) AS fake
FROM (SELECT *, {_GRADE.replace('retained', 'retained * 20.0::double / scored')} AS grade, CASE WHEN retained * 20.0::double / scored = 20 THEN 0.991::double WHEN retained * 20.0::double / scored >= 18 THEN 0.949::double WHEN retained * 20.0::double / scored >= 15 THEN 0.849::double ELSE 0.606::double END AS measured_accuracy FROM r) GROUP BY ALL""")
def p21b(spark: SparkSession, d: str) -> DataFrame:
    c = pairs.certificates(_part(grid.predictions(spark, d)))
    return c.groupBy("method_id", "grade", "measured_accuracy", "worst_condition").agg(F.count("*").alias("sources"), F.sum("retained").alias("retained"), F.sum("scored").alias("scored"), F.count_if("complete").alias("complete"), F.count_if(F.col("verdict") == "fake").alias("fake"))


@query("u01_pair_equality", f"""{_W}, g AS (SELECT * FROM pred WHERE {_PART}), a AS (SELECT * FROM g WHERE method_id = 'm1'), b AS (SELECT * FROM g WHERE method_id = 'm2')
SELECT CASE WHEN b.source_id IS NULL THEN 'only m1' WHEN a.source_id IS NULL THEN 'only m2' ELSE 'label' END AS reason, CAST(count(*) AS bigint) AS n FROM a FULL JOIN b ON a.source_id = b.source_id AND a.condition_id = b.condition_id
WHERE b.source_id IS NULL OR a.source_id IS NULL OR a.label <> b.label GROUP BY 1""")
def u01(spark: SparkSession, d: str) -> DataFrame:
    return pairs.unmatched(_part(grid.predictions(spark, d)), "m1", "m2")
