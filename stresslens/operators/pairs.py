"""Transformed views beside their clean ones: flips, drops, retention; two methods side by side."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from stresslens.operators import metrics
from stresslens.operators.metrics import r6

#: A band needs so many of twenty verdicts retained; and what share of its clean verdicts was measured to be right.
GRADES = (("HIGH", 20, 0.991), ("MEDIUM", 18, 0.949), ("LOW", 15, 0.849), ("VERY LOW", 0, 0.606))
VIEWS = 20


def with_clean(rows: DataFrame) -> DataFrame:
    """clean_p beside every row of a source that has a clean view. One shuffle by source, none for the join itself."""
    clean = F.max(F.when(F.col("condition_id") == "clean", F.col("p")))
    return rows.withColumn("clean_p", clean.over(W.partitionBy("source_id", "method_id"))).where("clean_p is not null")


def without_clean(rows: DataFrame) -> DataFrame:
    """The sources that with_clean() leaves out: a count that has to be zero for a headline."""
    return rows.groupBy("method_id", "source_id").agg(F.count_if(F.col("condition_id") == "clean").alias("n")).where("n = 0").select("method_id", "source_id")


def two_methods(rows: DataFrame, a: str, b: str) -> DataFrame:
    """source_id, condition_id, label, p_a, p_b where both methods have the view."""
    side = lambda m, c: rows.where(F.col("method_id") == m).select("source_id", "condition_id", F.col("label").alias(f"label_{c}"), F.col("p").alias(f"p_{c}"))
    return side(a, "a").join(side(b, "b"), ["source_id", "condition_id"]).withColumnRenamed("label_a", "label")


def unmatched(rows: DataFrame, a: str, b: str) -> DataFrame:
    """reason, n: views that only one of two methods has, and views whose labels differ. A paired number needs all to be zero."""
    side = lambda m, c: rows.where(F.col("method_id") == m).select("source_id", "condition_id", F.col("label").alias(c))
    both = side(a, "x").join(side(b, "y"), ["source_id", "condition_id"], "full")
    reason = F.when(F.col("y").isNull(), f"only {a}").when(F.col("x").isNull(), f"only {b}").when(F.col("x") != F.col("y"), "label")
    return both.select(reason.alias("reason")).where("reason is not null").groupBy("reason").agg(F.count("*").alias("n"))


def matched(rows: DataFrame, a: str, b: str) -> DataFrame:
    """two_methods() for rows that pair without rest; refuses others."""
    if found := unmatched(rows, a, b).collect():
        raise ValueError("rows don't pair: " + ", ".join(f"{r.reason}: {r.n}" for r in sorted(found)))
    return two_methods(rows, a, b)


def flips(paired: DataFrame, by: list[str], threshold: float = 0.5) -> DataFrame:
    """Share of changed verdicts, and by direction over all sources of the class."""
    was, now, y = F.col("clean_p") >= threshold, F.col("p") >= threshold, F.col("label") == 1
    share = lambda x, among: r6(F.avg(F.when(among, F.when(x, 1.0).otherwise(0.0))))
    return paired.groupBy(*by).agg(share(was != now, F.lit(True)).alias("flip_rate"), share(was & ~now, y).alias("fake_to_real"), share(~was & now, ~y).alias("real_to_fake"))


def conditional_flips(rows: DataFrame, by: list[str], threshold: float = 0.5) -> DataFrame:
    """The same among sources whose clean verdict is right only."""
    right = with_clean(rows).where((F.col("condition_id") != "clean") & ((F.col("clean_p") >= threshold) == (F.col("label") == 1)))
    now, y = F.col("p") >= threshold, F.col("label") == 1
    share = lambda x, among: r6(F.avg(F.when(among, F.when(x, 1.0).otherwise(0.0))))
    return right.groupBy(*by).agg(F.count("*").alias("n"), share(~now, y).alias("fake_to_real"), share(now, ~y).alias("real_to_fake"))


def retention(rows: DataFrame, threshold: float = 0.5, views: int | None = VIEWS) -> DataFrame:
    """How many of a source's views, the clean one among them, keep the clean verdict; whole grids only, or with views None all, by how many are scored."""
    kept = (F.col("p") >= threshold) == (F.col("clean_p") >= threshold)
    r = with_clean(rows).groupBy("method_id", "source_id").agg(F.max("label").alias("label"), F.count_if(kept).cast("int").alias("retained"), F.count("*").cast("int").alias("scored"), F.max("clean_p").alias("clean_p"))
    return r if views is None else r.where(F.col("scored") == views).drop("scored")


def graded(retained: DataFrame) -> DataFrame:
    """grade, and the accuracy measured in its band: retained verdicts as if of VIEWS, so a part of a grid isn't graded like a whole one."""
    scored = F.col("scored") if "scored" in retained.columns else F.lit(VIEWS)
    of = F.col("retained") * F.lit(float(VIEWS)) / scored
    grade, accuracy = F.lit("UNKNOWN"), F.lit(None).cast("double")
    for name, least, right in reversed(GRADES):
        fits = (scored > 0) & (of >= least)
        grade, accuracy = F.when(fits, name).otherwise(grade), F.when(fits, F.lit(right)).otherwise(accuracy)
    return retained.withColumns({"grade": grade, "measured_accuracy": accuracy})


def certificates(rows: DataFrame, threshold: float = 0.5, views: int = VIEWS) -> DataFrame:
    """A source's verdict beside what it survives: retained of scored, grade, the views that change it, the worst view."""
    r = with_clean(rows).withColumn("kept", (F.col("p") >= threshold) == (F.col("clean_p") >= threshold))
    # the worst view is the one furthest to the other side of the threshold
    against = F.when(F.col("clean_p") >= threshold, F.col("p")).otherwise(-F.col("p"))
    out = r.groupBy("method_id", "source_id").agg(
        F.max("clean_p").alias("clean_p"),
        F.count_if("kept").cast("int").alias("retained"),
        F.count("*").cast("int").alias("scored"),
        F.sort_array(F.collect_list(F.when(~F.col("kept"), F.col("condition_id")))).alias("unstable"),
        F.min(F.struct(against.alias("a"), "condition_id", "p")).alias("w"),
    )
    verdict = F.when(F.col("clean_p") >= threshold, "fake").otherwise("real")
    out = graded(out.withColumns({"verdict": verdict, "retention": r6(F.col("retained") / F.col("scored")), "complete": F.col("scored") == views}))
    return out.select("method_id", "source_id", "verdict", "clean_p", "retained", "scored", "retention", "grade", "measured_accuracy", "unstable", F.col("w.p").alias("worst_p"), F.col("w.condition_id").alias("worst_condition"), "complete")


def band_accuracy(grades: DataFrame, threshold: float = 0.5) -> DataFrame:
    right = (F.col("clean_p") >= threshold) == (F.col("label") == 1)
    g = grades.groupBy("method_id", "grade").agg(r6(F.avg(F.when(right, 1.0).otherwise(0.0))).alias("accuracy"), F.count("*").alias("n"))
    return g.select("method_id", "grade", "accuracy", r6(F.col("n") / F.sum("n").over(W.partitionBy("method_id"))).alias("share"))


def flag_rules(retained: DataFrame, below: tuple[int, ...], threshold: float = 0.5) -> DataFrame:
    """Deferring sources that keep fewer than so many verdicts: what share of the errors is caught, at what cost."""
    wrong = (F.col("clean_p") >= threshold) != (F.col("label") == 1)
    few = retained.groupBy("method_id", "retained").agg(F.count("*").alias("n"), F.count_if(wrong).alias("bad"))
    x = few.withColumn("below", F.explode(F.array(*[F.lit(t) for t in below])))
    flag = F.col("retained") < F.col("below")
    s = x.groupBy("method_id", "below").agg(F.coalesce(F.sum(F.when(flag, F.col("n"))), F.lit(0)).alias("flagged"), F.coalesce(F.sum(F.when(flag, F.col("bad"))), F.lit(0)).alias("caught"), F.sum("bad").alias("bad"), F.sum("n").alias("n"))
    return s.select("method_id", "below", "flagged", r6(F.try_divide("caught", "bad")).alias("catch_share"), r6(F.try_divide("caught", "flagged")).alias("precision"), r6(F.col("flagged") / F.col("n")).alias("defer_share"))


def stress_summary(rows: DataFrame, threshold: float = 0.5, views: int = 20) -> DataFrame:
    """Per source: spread of scores, the conditions that flip the verdict in canonical order, and a status."""
    # views on either side of the threshold, told apart once the clean one is known: no window, and numbers only where the lists aren't asked for
    high, view = F.col("p") >= threshold, F.struct("idx", "condition_id")
    of = lambda side: F.sort_array(F.collect_list(F.when(side, view)))
    clean = F.max(F.when(F.col("condition_id") == "clean", F.col("p")))
    s = rows.groupBy("method_id", "source_id").agg(r6(F.max("p") - F.min("p")).alias("spread"), clean.alias("clean_p"), F.count_if(high).alias("high"), F.count_if(~high).alias("low"), of(high).alias("highs"), of(~high).alias("lows"), F.count("*").alias("n_scored")).where("clean_p is not null")
    other = lambda low, high: F.when(F.col("clean_p") >= threshold, F.col(low)).otherwise(F.col(high))
    n = other("low", "high").cast("int")
    status = F.when(F.col("n_scored") < views, "incomplete").when(n == 0, "stable").otherwise("unstable")
    return s.select("method_id", "source_id", "spread", F.transform(other("lows", "highs"), lambda x: x["condition_id"]).alias("flips"), n.alias("n_flips"), "n_scored", status.alias("status"))


def greedy_conditions(rows: DataFrame, steps: int, threshold: float = 0.5) -> DataFrame:
    """step, condition_id, auroc: the conditions that, added one by one, best tell right clean verdicts by how many views keep them.

    Verdicts are counted by pattern once; each step then works on the patterns.
    """
    spark = rows.sparkSession
    clean, high, fake = F.col("condition_id") == "clean", F.col("p") >= threshold, F.col("label") == 1
    bits = lambda side: F.sum(F.when(~clean & side, F.expr("shiftleft(1L, idx)")).otherwise(F.lit(0).cast("long")))
    either = lambda x: F.max(F.when(~clean, x.cast("int")))
    s = rows.groupBy("source_id", "method_id").agg(F.max(F.when(clean, F.col("p"))).alias("clean_p"), F.count_if(~clean).alias("n"), bits(high).alias("high"), bits(~high).alias("low"), either(fake).alias("fake"), either(~fake).alias("real")).where("clean_p is not null AND n > 0")
    side = lambda a, b: F.when(F.col("clean_p") >= threshold, F.col(a)).otherwise(F.col(b))
    s = s.groupBy("source_id").agg(F.sum(side("high", "low")).alias("mask"), F.max(side("fake", "real")).alias("label"))
    patterns = s.groupBy("mask", "label").agg(F.count("*").alias("w"))
    patterns.persist()
    left = {r.idx: r.condition_id for r in rows.select("idx", "condition_id").where("condition_id <> 'clean'").distinct().collect()}
    chosen, out = [], []
    for step in range(1, min(steps, len(left)) + 1):
        tried = patterns.withColumn("c", F.explode(F.array(*[F.lit(i) for i in sorted(left)])))
        bit = lambda i: F.shiftrightunsigned("mask", i).bitwiseAND(F.lit(1).cast("long"))
        score = sum((bit(i) for i in chosen), F.lit(0).cast("long")) + F.expr("shiftrightunsigned(mask, c) & 1L")
        a = metrics.auroc(tried.withColumn("p", score), ["c"], weight="w").orderBy(F.desc("auroc"), "c").first()
        out.append((step, left.pop(a.c), a.auroc))
        chosen.append(a.c)
    patterns.unpersist()
    return spark.createDataFrame(out, "step int, condition_id string, auroc double")
