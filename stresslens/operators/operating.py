"""Operating points: thresholds under constraints, abstention, rescue, selective risk.

All candidates of a method are evaluated in one pass: scores are counted by value, and running sums over the values
give every threshold's counts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from stresslens.operators import metrics, resample
from stresslens.operators.grid import FAMILIES
from stresslens.operators.metrics import r6
from stresslens.operators.shared import below_by_ranges, cut


def next_up(x: Column) -> Column:
    """The double that follows x, for finite x of 0 or more: x plus half the gap above it rounds up to it."""
    gap = F.pow(F.lit(2.0), F.greatest(F.floor(F.log2(x)), F.lit(-1022)) - 52)
    gap = F.when(F.pow(F.lit(2.0), F.floor(F.log2(x))) > x, gap / 2).otherwise(gap)  # the logarithm was rounded up
    return F.when(x == 0, F.lit(5e-324)).otherwise(x + gap)


def candidates(rows: DataFrame, by: list[str]) -> DataFrame:
    """Every distinct score is a candidate threshold."""
    return rows.select(*by, F.col("p").alias("threshold")).distinct()


def quantile_candidates(rows: DataFrame, by: list[str], n: int = 257) -> DataFrame:
    """n evenly spaced quantiles, linearly interpolated, without repeats."""
    q = F.array(*[F.lit(i / (n - 1)) for i in range(n)])
    return rows.groupBy(*by).agg(F.array_distinct(F.percentile("p", q)).alias("t")).select(*by, F.explode("t").alias("threshold"))


def curve(rows: DataFrame, by: list[str]) -> DataFrame:
    """threshold and how many positives and negatives score at least that, for every distinct score of a group."""
    s = rows.groupBy(*by, F.col("p").alias("threshold")).agg(F.count_if(F.col("label") == 1).alias("pos"), F.count_if(F.col("label") == 0).alias("neg"))
    w = W.partitionBy(*by)
    up = w.orderBy(F.desc("threshold")).rowsBetween(W.unboundedPreceding, 0)
    return s.select(*by, "threshold", F.sum("pos").over(up).alias("tp"), F.sum("neg").over(up).alias("fp"), F.sum("pos").over(w).alias("n_pos"), F.sum("neg").over(w).alias("n_neg"))


def fpr_matched(rows: DataFrame, target: float) -> DataFrame:
    """Per method the k-th highest clean negative score, k = floor(target * n), and the false-positive rate it really has; just above the highest for k = 0.

    Scores are counted by value first; what is run over are distinct scores.
    """
    neg = rows.where("condition_id = 'clean' and label = 0").groupBy("method_id", "p").agg(F.count("*").alias("m"))
    w = W.partitionBy("method_id")
    s = neg.select("method_id", "p", "m", F.sum("m").over(w.orderBy(F.desc("p")).rowsBetween(W.unboundedPreceding, 0)).alias("upto"), F.sum("m").over(w).alias("n")).withColumn("k", F.floor(F.col("n") * F.lit(target)))
    at = (F.col("upto") >= F.col("k")) & (F.col("upto") - F.col("m") < F.col("k"))  # the value that holds the k-th
    t = s.groupBy("method_id").agg(F.max("n").alias("n"), F.max("k").alias("k"), F.max(F.when(at, F.col("p"))).alias("t"), F.max(F.when(at, F.col("upto"))).alias("hit"), F.max("p").alias("top"))
    return t.select("method_id", F.col("n").alias("negatives"), "k", F.coalesce(r6("t"), next_up(F.col("top"))).alias("threshold"), r6(F.coalesce("hit", F.lit(0)) / F.col("n")).alias("realised_fpr"), (F.col("k") == 0).alias("above_all"))


def clean_candidates(rows: DataFrame, base: float, fpr_slack: float, accuracy_slack: float, thresholds: DataFrame | None = None) -> DataFrame:
    """method_id, threshold, fpr, bacc, base_fpr, base_bacc, ok: every dev score, clipped to 0 and 1, as a candidate, and whether clean rates allow it; null, and not allowed, where a class is missing.

    Candidates and clean scores are counted by value and run through together; a threshold's counts are those of the
    clean scores at or above it. thresholds: method_id and threshold, in place of the dev scores.
    """
    p = F.least(F.greatest("p", F.lit(0.0)), F.lit(1.0))
    clean, y = F.col("condition_id") == "clean", F.col("label") == 1
    s = rows.groupBy("method_id", F.col("p").alias("threshold")).agg(F.count_if(clean & y).alias("pos"), F.count_if(clean & ~y).alias("neg"))
    asked = (thresholds if thresholds is not None else rows.select("method_id", p.alias("threshold"))).select("method_id", "threshold").distinct()
    both = s.withColumn("ask", F.lit(0)).unionByName(asked.withColumns({"pos": F.lit(0).cast("long"), "neg": F.lit(0).cast("long"), "ask": F.lit(1)}))
    up = W.partitionBy("method_id").orderBy(F.desc("threshold"), "ask").rowsBetween(W.unboundedPreceding, 0)
    both = both.withColumn("tp", F.sum("pos").over(up)).withColumn("fp", F.sum("neg").over(up)).where("ask = 1")
    at = rows.where(clean).groupBy("method_id").agg(F.count_if(y).alias("n_pos"), F.count_if(~y).alias("n_neg"), F.count_if(y & (F.col("p") >= base)).alias("b_tp"), F.count_if(~y & (F.col("p") >= base)).alias("b_fp"))
    share = lambda a, n: F.try_divide(F.col(a).cast("double"), F.col(n).cast("double"))
    at = at.select("method_id", "n_pos", "n_neg", share("b_fp", "n_neg").alias("base_fpr"), ((share("b_tp", "n_pos") + 1 - share("b_fp", "n_neg")) / 2).alias("base_bacc"))
    c = both.join(at, "method_id").withColumn("fpr", share("fp", "n_neg")).withColumn("bacc", (share("tp", "n_pos") + 1 - F.col("fpr")) / 2)
    ok = (F.col("fpr") <= F.col("base_fpr") + fpr_slack) & (F.col("bacc") >= F.col("base_bacc") - accuracy_slack)
    return c.select("method_id", "threshold", "fpr", "bacc", "base_fpr", "base_bacc", ok.alias("ok"))


#: Candidates whose objective one pass over the rows tells.
ASKED = 16


def objectives(rows: DataFrame, thresholds: dict[str, list[float]], replicates: int, seed: int, size: int = resample.BLOCK) -> DataFrame:
    """method_id, i, objective, low, high: of each method's i-th threshold the mean over replicates of the worst family's recall, and its 95 % interval.

    All thresholds of a method are columns of one pass, and share the draws.
    """
    most = max(map(len, thresholds.values()))
    at = F.create_map(*[x for m, ts in thresholds.items() for x in (F.lit(m), F.array(*[F.lit(float(t)) for t in ts]))])
    views = rows.where(F.col("label") == 1).where(F.col("family").isin(*FAMILIES) & F.col("method_id").isin(*thresholds)).withColumn("_at", at[F.col("method_id")])
    inside = {f: F.col("family") == f for f in FAMILIES}
    sums = [F.count_if(c).alias(f"n_{f}") for f, c in inside.items()] + [F.count_if(c & (F.col("p") >= F.get("_at", F.lit(i)))).alias(f"h{i}_{f}") for i in range(most) for f, c in inside.items()]
    stats = views.groupBy("method_id", "source_id", "label").agg(*sums)
    s = resample.resampled(stats, ["method_id"], [f"n_{f}" for f in FAMILIES] + [f"h{i}_{f}" for i in range(most) for f in FAMILIES], replicates, seed, size=size)
    worst = [F.array_min(F.array_compact(F.array(*[F.try_divide(f"h{i}_{f}", f"n_{f}") for f in FAMILIES]))) for i in range(most)]
    q = F.percentile("worst", F.array(F.lit(0.025), F.lit(0.975)))
    each = s.select("method_id", F.posexplode(F.array(*worst)).alias("i", "worst"))
    return each.groupBy("method_id", "i").agg(F.avg("worst").alias("objective"), q.alias("q")).select("method_id", "i", "objective", F.col("q")[0].alias("low"), F.col("q")[1].alias("high"))


def select_threshold(rows: DataFrame, base: float = 0.5, fpr_slack: float = 0.01, accuracy_slack: float = 0.01, replicates: int = 1000, seed: int = 20260826, thresholds: DataFrame | None = None, size: int = resample.BLOCK) -> DataFrame:
    """Per method the threshold with the best bootstrap mean of worst-family recall whose clean rates stay near those of the base threshold.

    method_id, threshold, objective, low, high, balanced_accuracy, fpr, feasible, worst_family, worst_condition,
    worst_condition_recall. Ties fall to the higher balanced accuracy, the lower false-positive rate, the higher
    threshold. No candidate that the clean rates allow: the base, flagged, with its own objective.

    A replicate's recalls can only fall as the threshold rises, so the lowest allowed candidate has the best mean, and
    those that tie with it are the next above, up to the first that loses a hit that counts. That one is searched for in
    passes of ASKED candidates: the first asks ranks 1, 2, 4, 8 and so on, as few usually tie, later ones ranks spread
    between two known ones, so one pass is the rule, millions of candidates cost a few and no window a replicate. The driver sees one row a method and ASKED thresholds a pass.
    """
    c = clean_candidates(rows, base, fpr_slack, accuracy_slack, thresholds).persist()
    ranked = c.where("ok").withColumn("rank", F.row_number().over(W.partitionBy("method_id").orderBy("threshold")))
    methods = [r.method_id for r in c.select("method_id").distinct().collect()]
    ends = {r.method_id: r.n for r in ranked.groupBy("method_id").agg(F.max("rank").alias("n")).collect()}
    known: dict[str, dict[int, tuple]] = {m: {} for m in methods}  # rank -> threshold, objective, low, high; rank 0 is the base
    low, high = dict.fromkeys(ends, 1), {m: n + 1 for m, n in ends.items()}  # a rank that ties, and one above all that do
    first = True
    while first or any(high[m] - low[m] > 1 for m in ends):
        spread = lambda m: {min(1 << i, ends[m]) for i in range(ASKED)} if first else {low[m] + (high[m] - low[m]) * i // ASKED for i in range(ASKED)}  # noqa: B023, E731
        want = {m: sorted(spread(m) - known[m].keys()) for m in ends}
        if first:
            want |= {m: [0] for m in methods if m not in ends}
        pairs = [(m, r) for m, rs in want.items() for r in rs if r]
        at = {}
        if pairs:
            wanted = F.broadcast(rows.sparkSession.createDataFrame(pairs, "method_id string, rank int"))
            at = {(r.method_id, r["rank"]): r.threshold for r in ranked.join(wanted, ["method_id", "rank"]).collect()}
        asked = {m: [at.get((m, r), base) for r in rs] for m, rs in want.items() if rs}
        for r in objectives(rows, asked, replicates, seed, size).collect():
            if r.i < len(asked[r.method_id]):
                known[r.method_id][want[r.method_id][r.i]] = (asked[r.method_id][r.i], r.objective, r.low, r.high)
        for m in ends:
            best = known[m].get(1, (None, None))[1]
            tied = [r for r, x in known[m].items() if x[1] == best]
            low[m], high[m] = max(tied, default=1), min([r for r, x in known[m].items() if x[1] != best], default=high[m])
            if best is None:  # no family has a positive view: no candidate can be told from another
                high[m] = low[m] + 1
        first = False
    told = [(m, low.get(m, 0), *(known[m].get(1 if m in ends else 0) or (base, None, None, None))[1:]) for m in methods]
    found = rows.sparkSession.createDataFrame(told, "method_id string, upto int, objective double, low double, high double")
    tied = ranked.join(F.broadcast(found.select("method_id", "upto")), "method_id").where(F.col("rank") <= F.col("upto"))
    best = tied.groupBy("method_id").agg(F.max(F.struct("bacc", (-F.col("fpr")).alias("f"), "threshold")).alias("b"))
    chosen = found.join(best, "method_id", "left").select("method_id", F.coalesce("b.threshold", F.lit(base)).alias("threshold"), "objective", "low", "high", F.col("b").isNotNull().alias("feasible"))
    at = rows.join(F.broadcast(chosen.select("method_id", "threshold")), "method_id").where(F.col("label") == 1).withColumn("hit", (F.col("p") >= F.col("threshold")).cast("int"))
    share = lambda by: at.where("family <> 'clean'").groupBy("method_id", by).agg(F.avg("hit").alias("r")).groupBy("method_id").agg(F.min(F.struct("r", by)).alias("x"))
    family, condition = share("family").select("method_id", F.col("x.family").alias("worst_family")), share("condition_id").select("method_id", F.col("x.condition_id").alias("worst_condition"), r6("x.r").alias("worst_condition_recall"))
    clean = rows.where("condition_id = 'clean'").join(F.broadcast(chosen.select("method_id", "threshold")), "method_id").withColumn("hit", (F.col("p") >= F.col("threshold")).cast("int"))
    rate = lambda y: F.avg(F.when(F.col("label") == y, F.col("hit")))
    clean = clean.groupBy("method_id").agg(r6((rate(1) + 1 - rate(0)) / 2).alias("balanced_accuracy"), r6(rate(0)).alias("fpr"))
    out = chosen.join(clean, "method_id", "left").join(family, "method_id", "left").join(condition, "method_id", "left")
    return out.select("method_id", "threshold", r6("objective").alias("objective"), r6("low").alias("low"), r6("high").alias("high"), "balanced_accuracy", "fpr", "feasible", "worst_family", "worst_condition", "worst_condition_recall")


def quantile_threshold(rows: DataFrame, target: float, least: int = 5) -> DataFrame:
    """The 1 - target quantile of clean negative scores; too few of them: of all negatives; none: the median of all."""
    neg, clean = F.col("label") == 0, F.col("condition_id") == "clean"
    q = lambda c, x: F.percentile(F.when(c, F.col("p")), F.lit(x))
    s = rows.groupBy("method_id").agg(F.count_if(neg & clean).alias("n_clean"), F.count_if(neg).alias("n_neg"), q(neg & clean, 1 - target).alias("a"), q(neg, 1 - target).alias("b"), F.percentile("p", F.lit(0.5)).alias("c"))
    t = F.when(F.col("n_clean") >= least, F.col("a")).when(F.col("n_neg") > 0, F.col("b")).otherwise(F.col("c"))
    return s.select("method_id", r6(t).alias("threshold"), "n_clean")


def best_accuracy(rows: DataFrame, by: list[str]) -> DataFrame:
    """The lowest threshold of the highest accuracy."""
    c = curve(rows, by).withColumn("right", F.col("tp") + F.col("n_neg") - F.col("fp"))
    return c.groupBy(*by).agg(F.max("right").alias("right"), F.max_by("threshold", F.struct("right", -F.col("threshold"))).alias("threshold"), F.max(F.col("n_pos") + F.col("n_neg")).alias("n")).select(*by, "threshold", r6(F.col("right") / F.col("n")).alias("accuracy"))


def rescue(rows: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Per family what replacing the first method's verdict by the second's mends and breaks."""
    a, b = (F.col("p_a") >= threshold) == (F.col("label") == 1), (F.col("p_b") >= threshold) == (F.col("label") == 1)
    s = rows.rollup("family").agg(F.count("*").alias("n"), F.count_if(~a & b).alias("corrections"), F.count_if(a & ~b).alias("harms"), F.count_if(~a).alias("wrong"), F.grouping("family").alias("g"))
    net = F.col("corrections") - F.col("harms")
    return s.select(F.when(F.col("g") == 1, "all").otherwise(F.col("family")).alias("family"), "n", "corrections", "harms", net.alias("net"), r6(1000 * net / F.col("n")).alias("net_per_1000"), r6(F.try_divide("corrections", "wrong")).alias("p_right_if_wrong"))


def rescue_threshold(rows: DataFrame, threshold: float = 0.5) -> DataFrame:
    """For the second method's score the lowest threshold (to four digits) of the most corrections less harms."""
    wrong = (F.col("p_a") >= threshold) != (F.col("label") == 1)
    # a verdict of the second method at t is right for a positive if p_b >= t and for a negative otherwise
    s = rows.groupBy(F.round("p_b", 4).alias("t")).agg(*[F.count_if(c).alias(n) for n, c in (("wp", wrong & (F.col("label") == 1)), ("wn", wrong & (F.col("label") == 0)), ("rp", ~wrong & (F.col("label") == 1)), ("rn", ~wrong & (F.col("label") == 0)))])
    s = s.withColumn("part", F.lit(0))
    up, down = W.partitionBy("part").orderBy(F.desc("t")).rowsBetween(W.unboundedPreceding, 0), W.partitionBy("part").orderBy("t").rowsBetween(W.unboundedPreceding, -1)
    at = s.select("t", F.sum("wp").over(up).alias("fixed_p"), F.coalesce(F.sum("wn").over(down), F.lit(0)).alias("fixed_n"), F.coalesce(F.sum("rp").over(down), F.lit(0)).alias("broken_p"), F.sum("rn").over(up).alias("broken_n"))
    net = F.col("fixed_p") + F.col("fixed_n") - F.col("broken_p") - F.col("broken_n")
    return at.select("t", net.alias("net")).agg(F.max("net").alias("net"), F.max_by("t", F.struct("net", -F.col("t"))).alias("threshold"))


def _levels(rows: DataFrame, threshold: float) -> DataFrame:
    """method_id, reliability, m, r: how many rows have a reliability and how many of them are right, written once."""
    right = ((F.col("p") >= threshold) == (F.col("label") == 1)).cast("int")
    return cut(rows.groupBy("method_id", "reliability").agg(F.count("*").alias("m"), F.sum(right).alias("r")))


def selective_risk(rows: DataFrame, coverages: tuple[float, ...], threshold: float = 0.5, levels: DataFrame | None = None) -> DataFrame:
    """Accuracy of the most reliable share of the rows, k = max(1, round half even (c * n)); ties by source and condition.

    Rows are ranked over their reliability's value counts (levels, if they are known); only the value that a cut falls
    into is ordered row by row.
    """
    right = ((F.col("p") >= threshold) == (F.col("label") == 1)).cast("int")
    d = rows.select("method_id", "source_id", "idx", "reliability", right.alias("right"))
    levels = _levels(rows, threshold) if levels is None else levels
    w = W.partitionBy("method_id").orderBy(F.desc("reliability")).rowsBetween(W.unboundedPreceding, 0)
    levels = levels.select("method_id", "reliability", "m", F.sum("m").over(w).alias("upto"), F.sum("r").over(w).alias("right_upto"), "r", F.sum("m").over(W.partitionBy("method_id")).alias("n"))
    cuts = levels.withColumn("coverage", F.explode(F.array(*[F.lit(c) for c in coverages]))).withColumn("k", F.greatest(F.bround(F.col("coverage") * F.col("n")), F.lit(1.0)).cast("long"))
    cuts = cuts.where((F.col("upto") >= F.col("k")) & (F.col("upto") - F.col("m") < F.col("k"))).select("method_id", "reliability", "coverage", "k", (F.col("upto") - F.col("m")).alias("before"), (F.col("right_upto") - F.col("r")).alias("right_before"))
    edge = d.join(F.broadcast(cuts.select("method_id", "reliability").distinct()), ["method_id", "reliability"], "left_semi")
    edge = edge.withColumn("i", F.row_number().over(W.partitionBy("method_id", "reliability").orderBy("source_id", "idx")))
    inside = cuts.join(edge, ["method_id", "reliability"]).where(F.col("i") <= F.col("k") - F.col("before")).groupBy("method_id", "coverage", "k", "right_before").agg(F.sum("right").alias("right"))
    return inside.select("method_id", "coverage", "k", r6((F.col("right_before") + F.col("right")) / F.col("k")).alias("accuracy"))


def abstention_policy(risk: DataFrame, gain: float = 0.02) -> DataFrame:
    """Per method the largest coverage below one whose accuracy is `gain` above that of keeping all, if there is one."""
    base = risk.where("coverage = 1.0").select("method_id", F.col("accuracy").alias("base"))
    return base.join(risk.where("coverage < 1.0"), "method_id", "left").groupBy("method_id", "base").agg(F.max(F.when(F.col("accuracy") >= F.col("base") + gain, F.struct("coverage", "accuracy"))).alias("x")).select("method_id", F.col("base").alias("accuracy_all"), "x.coverage", "x.accuracy")


def frozen_abstention(rows: DataFrame, coverages: tuple[float, ...], gain: float = 0.02, threshold: float = 0.5) -> DataFrame:
    """abstention_policy() with adopted and the value below which a verdict is deferred: the quantile of 1 - coverage of these
    rows' reliabilities, interpolated between neighbours. It is frozen as a value, as a share of new rows would tune itself to them.

    Rows without a reliability have no part in the quantile; a method of which none has one adopts nothing. Rows are counted
    by value once for both; places in the order are sums of these counts.
    """
    some = rows.where(F.col("reliability").isNotNull())
    levels = _levels(some, threshold)
    policy = abstention_policy(selective_risk(some, coverages, threshold, levels), gain)
    at = below_by_ranges(levels.select("method_id", "reliability", "m"), "reliability", ["method_id"], "m")
    j = at.join(policy.select("method_id", F.col("coverage").alias("c")).where("c is not null"), "method_id")
    h = (F.col("n") - 1) * (1 - F.col("c"))
    j = j.select("method_id", "reliability", "below", F.col("below") + F.col("m") - 1, F.floor(h).alias("place"), (h - F.floor(h)).alias("part")).toDF("method_id", "reliability", "first", "last", "place", "part")
    value = lambda step: F.max(F.when((F.col("place") + step).between(F.col("first"), F.col("last")), F.col("reliability")))
    cuts = j.groupBy("method_id").agg(value(0).alias("lo"), value(1).alias("hi"), F.max("part").alias("part"))
    cuts = cuts.select("method_id", (F.col("lo") + F.coalesce((F.col("hi") - F.col("lo")) * F.col("part"), F.lit(0.0))).alias("reliability_threshold"))
    out = policy.join(cuts, "method_id", "left")
    return out.select("method_id", F.col("coverage").isNotNull().alias("adopted"), "reliability_threshold", "coverage", "accuracy", "accuracy_all", r6(F.col("accuracy") - F.col("accuracy_all")).alias("gain"))


def abstention(rows: DataFrame, least: float, threshold: float = 0.5) -> DataFrame:
    """Coverage, accuracy of all, kept and deferred, and the worst family among the kept, all from one count of the rows."""
    right, kept = (F.col("p") >= threshold) == (F.col("label") == 1), F.coalesce(F.col("reliability") >= least, F.lit(True))
    n = ("tp", "fn", "fp", "tn")
    few = cut(rows.groupBy("method_id", "family", kept.alias("kept")).agg(F.count("*").alias("n"), F.count_if(right).alias("right"), *metrics.counts(threshold)))
    of = lambda c, among: F.sum(F.when(among, F.col(c)))
    share = lambda among: r6(F.try_divide(of("right", among), of("n", among)))
    flat = few.groupBy("method_id").agg(r6(F.coalesce(of("n", F.col("kept")), F.lit(0)) / F.sum("n")).alias("coverage"), share(F.lit(True)).alias("accuracy_all"), share(F.col("kept")).alias("accuracy_kept"), share(~F.col("kept")).alias("accuracy_deferred"))
    family = few.where("kept and family <> 'clean'").groupBy("method_id", "family").agg(*[F.sum(c).alias(c) for c in n]).select("method_id", "family", *metrics.rates())
    return flat.join(metrics.worst(family, ["method_id"], "family"), "method_id", "left")


class SplitError(ValueError):
    """A threshold was to be fitted on rows that it may not be fitted on."""


def threshold_rows(split: str, train: DataFrame, dev: DataFrame, acknowledged: bool = False) -> DataFrame:
    """The rows that a threshold is fitted on: held-out dev; train only by whoever says that this departs from the protocol."""
    if split == "dev":
        return dev
    if split != "train":
        raise SplitError(f"a threshold is fitted on dev or train, not {split!r}")
    if not acknowledged:
        raise SplitError("a threshold is fitted on held-out dev; to fit it on train, acknowledge the departure")
    return train


#: How a provenance begins that stands for no fitted threshold.
UNFITTED = ("PLACEHOLDER", "UNSPECIFIED")


def is_frozen(provenance: str | None) -> bool:
    """Does a provenance name a fitted threshold: neither blank nor a placeholder, in any case."""
    text = (provenance or "").strip().upper()
    return bool(text) and not text.startswith(UNFITTED)


def frozen(provenance: Column) -> Column:
    """is_frozen() as a column; false for null."""
    text = F.upper(F.trim(F.coalesce(provenance, F.lit(""))))
    return (text != "") & ~F.exists(F.array(*[F.lit(u) for u in UNFITTED]), lambda u: F.startswith(text, u))
