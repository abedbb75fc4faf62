"""Confusion, ranking and calibration metrics over groups of prediction rows.

Rows hold label (0 or 1) and p; p >= threshold predicts 1. Ranking metrics group equal scores before anything is
ordered, so ties are averaged and no group is ever sorted row by row.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from stresslens.operators.shared import cut

DIGITS = 6


def r6(c: Column) -> Column:
    return F.round(c, DIGITS)


def predicted(threshold: float | Column, p: str = "p") -> Column:
    t = threshold if isinstance(threshold, Column) else F.lit(float(threshold))
    return (F.col(p) >= t).cast("int")


def counts(threshold: float | Column, p: str = "p") -> list[Column]:
    """tp, fn, fp, tn as aggregates."""
    hit, y = predicted(threshold, p) == 1, F.col("label") == 1
    return [F.count_if(y & hit).alias("tp"), F.count_if(y & ~hit).alias("fn"), F.count_if(~y & hit).alias("fp"), F.count_if(~y & ~hit).alias("tn")]


def rates() -> list[Column]:
    """recall, tnr, fpr, balanced_accuracy from tp, fn, fp, tn; null where a class is missing."""
    recall, tnr = F.try_divide("tp", F.col("tp") + F.col("fn")), F.try_divide("tn", F.col("tn") + F.col("fp"))
    return [r6(recall).alias("recall"), r6(tnr).alias("tnr"), r6(F.try_divide("fp", F.col("tn") + F.col("fp"))).alias("fpr"), r6((recall + tnr) / 2).alias("balanced_accuracy")]


def confusion(rows: DataFrame, by: list[str], threshold: float = 0.5) -> DataFrame:
    return rows.groupBy(*by).agg(*counts(threshold))


def _by_score(rows: DataFrame, by: list[str], p: str, weight: str | None) -> DataFrame:
    w = F.col(weight) if weight else F.lit(1)
    return rows.groupBy(*by, F.col(p).alias("_s")).agg(F.sum(F.when(F.col("label") == 1, w).otherwise(0)).alias("_p"), F.sum(F.when(F.col("label") == 0, w).otherwise(0)).alias("_n"))


def auroc(rows: DataFrame, by: list[str], p: str = "p", weight: str | None = None, name: str = "auroc") -> DataFrame:
    """Area under the curve with averaged ties; null where a class is missing. Weights count as repetitions."""
    s = _by_score(rows, by, p, weight)
    below = F.coalesce(F.sum("_n").over(W.partitionBy(*by).orderBy("_s").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    s = s.withColumn("_a", F.col("_p") * (below + F.col("_n") / 2))
    return s.groupBy(*by).agg(r6(F.try_divide(F.sum("_a"), F.sum("_p") * F.sum("_n").cast("double"))).alias(name))


def auroc_by_ranges(rows: DataFrame, by: list[str], p: str = "p", name: str = "auroc") -> DataFrame:
    """auroc() of scores that are mostly different: they are dealt by ranges, so a group may have more of them than a task holds.

    What lies below a range are the sums of the ranges before it; the driver sees one row a range and group.
    """
    s = _by_score(rows, by, p, None)
    d = cut(s.repartitionByRange(*[F.col(c) for c in by], F.col("_s")).withColumn("_r", F.spark_partition_id()))
    ranges = d.groupBy(*by, "_r").agg(F.sum("_p").alias("_rp"), F.sum("_n").alias("_rn"))
    start = F.coalesce(F.sum("_rn").over(W.partitionBy(*by).orderBy("_r").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    ranges = F.broadcast(ranges.select(*[F.col(c).alias(f"_g_{c}") for c in by], F.col("_r").alias("_at"), start.alias("_start")))
    d = d.join(ranges, reduce(Column.__and__, [F.col(c).eqNullSafe(F.col(f"_g_{c}")) for c in by], F.col("_r") == F.col("_at")))
    within = F.coalesce(F.sum("_n").over(W.partitionBy("_r", *by).orderBy("_s").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    d = d.withColumn("_a", F.col("_p") * (F.col("_start") + within + F.col("_n") / 2))
    return d.groupBy(*by).agg(r6(F.try_divide(F.sum("_a"), F.sum("_p") * F.sum("_n").cast("double"))).alias(name))


def average_precision(rows: DataFrame, by: list[str], p: str = "p") -> DataFrame:
    """Equal scores are one step."""
    s = _by_score(rows, by, p, None)
    w = W.partitionBy(*by).orderBy(F.desc("_s")).rowsBetween(W.unboundedPreceding, 0)
    s = s.withColumn("_t", F.sum("_p").over(w)).withColumn("_a", F.sum(F.col("_p") + F.col("_n")).over(w))
    return s.groupBy(*by).agg(r6(F.try_divide(F.sum(F.col("_p") * F.col("_t") / F.col("_a")), F.sum("_p"))).alias("average_precision"))


def brier(p: str = "p") -> Column:
    return F.avg((F.col(p) - F.col("label")) * (F.col(p) - F.col("label")))


def nll(p: str = "p", eps: float = 1e-12) -> Column:
    c = F.least(F.greatest(F.col(p), F.lit(eps)), F.lit(1 - eps))
    return -F.avg(F.when(F.col("label") == 1, F.log(c)).otherwise(F.log1p(-c)))


def calibration_bin(bins: int, p: str = "p", right: bool = False) -> Column:
    """Equal-width bins: the last holds 1 too. right: an edge belongs to the bin below it."""
    x = F.col(p) * bins
    return F.least(F.greatest(F.ceil(x) - 1, F.lit(0)) if right else F.floor(x), F.lit(bins - 1)).cast("int")


def calibration_error(rows: DataFrame, by: list[str], bins: int = 15, p: str = "p", right: bool = False) -> DataFrame:
    b = rows.groupBy(*by, calibration_bin(bins, p, right).alias("_b")).agg(F.count("*").alias("_n"), F.avg(p).alias("_c"), F.avg("label").alias("_y"))
    return b.groupBy(*by).agg(r6(F.sum(F.col("_n") * F.abs(F.col("_c") - F.col("_y"))) / F.sum("_n")).alias("ece"))


def bundle(rows: DataFrame, by: list[str], threshold: float = 0.5, bins: int = 15) -> DataFrame:
    """All metrics of each group."""
    flat = rows.groupBy(*by).agg(F.count("*").alias("n"), *counts(threshold), r6(brier()).alias("brier"), r6(nll()).alias("nll"))
    flat = flat.select(*by, "n", *rates(), "brier", "nll")
    return flat.join(auroc(rows, by), by).join(average_precision(rows, by), by).join(calibration_error(rows, by, bins), by)


def grouping_sets(rows: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Rates by condition, by family and overall for each method, in one pass over pre-counted rows."""
    small = rows.groupBy("method_id", "family", "condition_id").agg(*counts(threshold))
    sets = small.groupingSets([["method_id", "condition_id"], ["method_id", "family"], ["method_id"]], "method_id", "family", "condition_id").agg(*[F.sum(c).alias(c) for c in ("tp", "fn", "fp", "tn")], F.grouping_id().alias("g"))
    level = F.when(F.col("condition_id").isNotNull(), "condition").when(F.col("family").isNotNull(), "family").otherwise("overall")
    return sets.select("method_id", level.alias("level"), F.coalesce("condition_id", "family", F.lit("all")).alias("name"), "tp", "fn", "fp", "tn", *rates())


def worst(recalls: DataFrame, by: list[str], name: str, value: str = "recall") -> DataFrame:
    """The least value of each group; of equal ones the first name. Clean is never a candidate."""
    return recalls.where(F.col(name) != "clean").groupBy(*by).agg(F.min(value).alias(f"worst_{value}"), F.min_by(name, F.struct(value, name)).alias(f"worst_{name}"))


def family_recall(rows: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Severities of a family pooled."""
    return confusion(rows.where("family <> 'clean'"), ["method_id", "family"], threshold).select("method_id", "family", "tp", "fn", *rates())
