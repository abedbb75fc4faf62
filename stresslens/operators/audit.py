"""Audits: error taxonomy, complementarity, correlations, histograms, latency, reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from stresslens.operators.metrics import r6


def error_taxonomy(rows: DataFrame, least: float, threshold: float = 0.5) -> DataFrame:
    """By method and condition: false negatives and positives, their rates, and the share that abstention would catch."""
    y, hit, deferred = F.col("label") == 1, F.col("p") >= threshold, F.coalesce(F.col("reliability") < least, F.lit(False))
    g = rows.groupBy("method_id", "condition_id").agg(F.count_if(y & ~hit).alias("fn"), F.count_if(~y & hit).alias("fp"), F.count_if(y).alias("pos"), F.count_if(~y).alias("neg"), F.count_if((y != hit) & deferred).alias("caught"))
    return g.select("method_id", "condition_id", "fn", "fp", r6(F.try_divide("fn", "pos")).alias("fn_rate"), r6(F.try_divide("fp", "neg")).alias("fp_rate"), r6(F.try_divide("caught", F.col("fn") + F.col("fp"))).alias("caught_share"))


def worst_errors(rows: DataFrame, n: int, threshold: float = 0.5) -> DataFrame:
    """The n false negatives of the lowest and the n false positives of the highest score; ties by view."""
    fn = rows.where((F.col("label") == 1) & (F.col("p") < threshold)).orderBy("p", "source_id", "condition_id", "method_id").limit(n)
    fp = rows.where((F.col("label") == 0) & (F.col("p") >= threshold)).orderBy(F.desc("p"), "source_id", "condition_id", "method_id").limit(n)
    pick = lambda d, kind: d.select(F.lit(kind).alias("kind"), "method_id", "source_id", "condition_id", "p")
    return pick(fn, "fn").unionByName(pick(fp, "fp"))


def complementarity(pairs: DataFrame, threshold: float = 0.5, gate: float = 0.02) -> DataFrame:
    """What an oracle that picks the right one of two methods would gain."""
    a, b = (F.col("p_a") >= threshold) == (F.col("label") == 1), (F.col("p_b") >= threshold) == (F.col("label") == 1)
    s = pairs.agg(F.count("*").alias("n"), F.count_if(a).alias("a"), F.count_if(b).alias("b"), F.count_if(~a & ~b).alias("neither"), F.count_if(a & ~b).alias("only_a"), F.count_if(a != b).alias("disagree"))
    best = F.greatest("a", "b")
    upside = (F.col("n") - F.col("neither") - best) / F.col("n")
    return s.select("n", r6(F.try_divide("only_a", F.col("n") - F.col("b"))).alias("a_right_if_b_wrong"), r6(F.col("neither") / F.col("n")).alias("joint_failure"), r6(F.col("disagree") / F.col("n")).alias("disagreement"), r6(1 - F.col("neither") / F.col("n")).alias("oracle_accuracy"), r6(upside).alias("upside"), F.when(upside < gate, "stop").otherwise("go").alias("verdict"))


def guarded_corr(a: Column, b: Column, eps: float = 1e-12) -> Column:
    """Pearson correlation; null where either side hardly varies."""
    return F.when((F.stddev_pop(a) < eps) | (F.stddev_pop(b) < eps), F.lit(None)).otherwise(F.try_divide(F.covar_pop(a, b), F.stddev_pop(a) * F.stddev_pop(b)))


def correlations(rows: DataFrame, columns: list[str]) -> DataFrame:
    """a, b, r for every pair of columns, all in one aggregate."""
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i + 1 :]]
    flat = rows.agg(*[r6(guarded_corr(F.col(a), F.col(b))).alias(f"{a}|{b}") for a, b in pairs])
    return flat.unpivot([], [f"{a}|{b}" for a, b in pairs], "ab", "r").select(F.split("ab", r"\|")[0].alias("a"), F.split("ab", r"\|")[1].alias("b"), "r")


def confusion_matrix(rows: DataFrame, truth: str, guess: str, classes: list[str]) -> DataFrame:
    """One row a true class, one column a guessed one, and the class's recall."""
    m = rows.groupBy(F.col(truth).alias("truth")).pivot(guess, classes).agg(F.count(F.lit(1)))
    m = m.select("truth", *[F.coalesce(F.col(c), F.lit(0)).alias(c) for c in classes])
    total = sum((F.col(c) for c in classes), F.lit(0))
    right = F.coalesce(*[F.when(F.col("truth") == c, F.col(c)) for c in classes])
    return m.select("truth", *classes, r6(F.try_divide(right, total)).alias("recall"))


def latency(rows: DataFrame, by: str, value: str) -> DataFrame:
    """Exact median and 95th percentile, linearly interpolated, and their ratio."""
    q = F.percentile(value, F.array(F.lit(0.5), F.lit(0.95)))
    return rows.groupBy(by).agg(F.count("*").alias("n"), q.alias("_q")).select(by, "n", r6(F.col("_q")[0]).alias("p50"), r6(F.col("_q")[1]).alias("p95"), r6(F.try_divide(F.col("_q")[1], F.col("_q")[0])).alias("ratio"))


def histogram(rows: DataFrame, value: str, edges: list[int]) -> DataFrame:
    """Counts in [edge, next edge), the last open; empty buckets too."""
    spark = rows.sparkSession
    low = F.lit(edges[0])
    for e in edges[1:]:
        low = F.when(F.col(value) >= e, e).otherwise(low)
    n = rows.where(F.col(value) >= edges[0]).groupBy(low.alias("low")).agg(F.count("*").alias("n"))
    every = spark.createDataFrame([(e,) for e in edges], "low int")
    return every.join(n, "low", "left").select("low", F.coalesce("n", F.lit(0)).alias("n"))


def index_percentiles(rows: DataFrame, value: str, shares: tuple[float, ...]) -> DataFrame:
    """The value at position round half even (share * (n - 1)) of the order, from counts of values."""
    c = rows.groupBy(F.col(value).alias("v")).agg(F.count("*").alias("m")).withColumn("part", F.lit(0))
    up = W.partitionBy("part").orderBy("v").rowsBetween(W.unboundedPreceding, 0)
    c = c.withColumn("upto", F.sum("m").over(up)).withColumn("n", F.sum("m").over(W.partitionBy("part"))).withColumn("share", F.explode(F.array(*[F.lit(s) for s in shares])))
    at = F.bround(F.col("share") * (F.col("n") - 1)).cast("long")
    return c.where((F.col("upto") > at) & (F.col("upto") - F.col("m") <= at)).select("share", F.col("v").alias("value"))


def spread(rows: DataFrame, by: list[str], value: str) -> DataFrame:
    """Largest less smallest over repeats: zero if runs are deterministic."""
    return rows.groupBy(*by).agg(r6(F.max(value) - F.min(value)).alias("spread"), F.count("*").alias("n"))
