"""Feature vectors, standardisation, disagreement; fusion of experts and linear scores as columns."""

from __future__ import annotations

from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stresslens.functions import scalars
from stresslens.operators.metrics import r6

#: An expert's probe statistics and an image's quality numbers, in the order of the feature vector.
PROBE = ("probe_mean", "probe_std", "probe_range", "probe_max_delta")
QUALITY = ("blur_varlap", "blockiness", "noise_sigma", "luminance_mean", "luminance_std", "saturation_mean", "clipped_low_frac", "clipped_high_frac")


def feature_names(experts: list[str]) -> list[str]:
    """The fixed order of the feature vector, 38 columns for one expert; `__present` follows what may be missing."""
    both = lambda name: [name, f"{name}__present"]
    out = []
    for e in experts:
        for n in ("raw_logit", "p_fake", "entropy", *PROBE, "probe_flip"):
            out += both(f"{e}.{n}")
        out.append(f"{e}.n_probes_ok")
    out += both("disagreement.max_abs_p_diff") + both("disagreement.mean_abs_p_diff") + ["disagreement.n_experts_ok"]
    for n in QUALITY:
        out += both(f"quality.{n}")
    return out


def quality_places(experts: list[str]) -> list[int]:
    """Places of the columns that hold nothing of an expert: what a model of quality alone may see."""
    return [i for i, n in enumerate(feature_names(experts)) if n.startswith("quality.")]


def feature_vector(experts: list[str], threshold: float, answers: str = "experts", probes: str = "probes", disagreement: str = "disagreement", quality: str = "quality") -> Column:
    """An array in the order of feature_names(), of rows as a cache holds them.

    answers: a map of expert to ok, p_fake, raw_logit. probes: a map of expert to the PROBE numbers, probe_scores (a map)
    and n_probes_ok. disagreement: a struct, null for a single expert. quality: a struct of QUALITY. What is missing, not
    finite or not ok is 0 with an indicator of 0, never guessed; entropy and flip are worked out here, at this threshold.
    """
    number = lambda c: F.coalesce(c.cast("double"), F.lit(0.0))
    out: list[Column] = []
    for e in experts:
        a, b = F.col(answers)[e], F.col(probes)[e]
        ok = lambda c, a=a: F.when(F.coalesce(a["ok"], F.lit(False)), c)
        p = ok(a["p_fake"])
        out += scalars.pair(ok(a["raw_logit"])) + scalars.pair(p) + scalars.pair(scalars.entropy(F.when(p.isNotNull(), scalars.clip(p, 0.0, 1.0))))
        for n in PROBE:
            out += scalars.pair(b[n])
        scores = F.coalesce(F.map_values(b["probe_scores"]), F.array().cast("array<double>"))
        out += scalars.pair(scalars.probe_flip(scores, p, threshold).cast("double"))
        out.append(number(b["n_probes_ok"]))
    d = F.col(disagreement)
    out += scalars.pair(d["max_abs_p_diff"]) + scalars.pair(d["mean_abs_p_diff"]) + [number(d["n_experts_ok"])]
    for n in QUALITY:
        out += scalars.pair(F.col(quality)[n])
    return F.array(*out)


def quality_only(vector: Column, experts: list[str], weights: list[float], bias: float) -> Column:
    """A linear score of the quality columns of a vector alone."""
    places = quality_places(experts)
    if len(weights) != len(places):
        raise ValueError(f"{len(places)} weights are needed")
    return scalars.sigmoid(sum((F.get(vector, F.lit(i)) * float(w) for i, w in zip(places, weights, strict=True)), F.lit(float(bias))))


def standardiser(rows: DataFrame, columns: list[str]) -> DataFrame:
    """One row: mean and population deviation of each column over training rows; a column that doesn't vary has scale 1."""
    std = lambda c: F.stddev_pop(c)
    return rows.agg(*[F.avg(c).alias(f"{c}__mean") for c in columns], *[F.when(F.coalesce(std(c), F.lit(0.0)) > 0, std(c)).otherwise(1.0).alias(f"{c}__scale") for c in columns])


def standardise(rows: DataFrame, fitted: DataFrame, columns: list[str]) -> DataFrame:
    """fitted is one row, so the join sends nothing around."""
    j = rows.crossJoin(F.broadcast(fitted))
    return j.select(*[c for c in rows.columns if c not in columns], *[((F.col(c) - F.col(f"{c}__mean")) / F.col(f"{c}__scale")).alias(c) for c in columns])


def static_average(logits: Column, available: Column) -> Column:
    return scalars.sigmoid(scalars.masked_mean(logits, available))


def probability_mean(ps: Column, available: Column) -> Column:
    """0.5 if nothing is available, as an undecided fusion; whoever needs a failure asks for availability."""
    return F.coalesce(scalars.masked_mean(ps, available), F.lit(0.5))


def fixed_weights(logits: Column, available: Column, weights: list[float]) -> Column:
    """Weights renormalised over what is available; null if nothing is."""
    w = F.zip_with(F.array(*[F.lit(float(x)) for x in weights]), available, lambda x, ok: F.when(ok, x).otherwise(0.0))
    total = F.aggregate(w, F.lit(0.0), lambda t, x: t + x)
    dot = F.aggregate(F.zip_with(w, logits, lambda x, v: F.when(x > 0, x * v).otherwise(0.0)), F.lit(0.0), lambda t, x: t + x)
    return scalars.sigmoid(F.try_divide(dot, total))


def linear(features: Column, weights: list[float], bias: float) -> Column:
    return F.aggregate(F.zip_with(features, F.array(*[F.lit(float(w)) for w in weights]), lambda x, w: x * w), F.lit(float(bias)), lambda t, x: t + x)


def simplex(n: int, step: float = 0.1) -> list[tuple[float, ...]]:
    """All weights of n experts on a grid that add up to one, in lexical order."""
    k = round(1 / step)
    return [tuple(i / k for i in x) for x in product(range(k + 1), repeat=n) if sum(x) == k]


def simplex_search(rows: DataFrame, logits: list[str], step: float = 0.1, threshold: float = 0.5) -> DataFrame:
    """w (array), balanced_accuracy of the best weights; the first of equal ones. One scan: every grid point is an aggregate."""
    from stresslens.operators import metrics

    points = simplex(len(logits), step)
    tagged = rows.select("label", F.posexplode(F.array(*[scalars.sigmoid(sum((F.col(c) * w for c, w in zip(logits, p, strict=True)), F.lit(0.0))) for p in points])).alias("i", "p"))
    c = tagged.groupBy("i").agg(*metrics.counts(threshold))
    value = (F.col("tp") / (F.col("tp") + F.col("fn")) + F.col("tn") / (F.col("tn") + F.col("fp"))) / 2
    best = c.select("i", value.alias("v")).agg(F.max_by("i", F.struct("v", -F.col("i"))).alias("i"), F.max("v").alias("v"))
    return best.select(F.element_at(F.array(*[F.array(*[F.lit(x) for x in p]) for p in points]), F.col("i") + 1).alias("w"), r6("v").alias("balanced_accuracy"))


def reliability_target(threshold: float, p: str = "p") -> Column:
    """Is the decision right."""
    return ((F.col(p) >= threshold) == (F.col("label") == 1)).cast("int")
