"""Scalar functions on columns. A missing or impossible value gives null, never a number."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def finite(c: Column) -> Column:
    return c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf")))


def entropy(p: Column) -> Column:
    """Binary entropy in nats; 0 at 0 and 1, null outside."""
    return F.when((p == 0) | (p == 1), 0.0).when((p > 0) & (p < 1), -(p * F.log(p) + (1 - p) * F.log1p(-p)))


def sigmoid(x: Column) -> Column:
    """Never exponentiates a large positive number."""
    return F.when(x >= 0, 1 / (1 + F.exp(-x))).otherwise(F.exp(x) / (1 + F.exp(x)))


def clip(x: Column, low: float, high: float) -> Column:
    """Null stays null; least and greatest alone would leave it out and give a bound."""
    return F.when(x.isNotNull(), F.least(F.greatest(x, F.lit(low)), F.lit(high)))


def logit(p: Column, eps: float = 1e-12) -> Column:
    c = clip(p, eps, 1 - eps)
    return F.log(c / (1 - c))


def pair(c: Column) -> list[Column]:
    """A value and whether it is there; (0, 0) for what is missing or not finite."""
    ok = finite(c)
    return [F.when(ok, c).otherwise(0.0), F.when(ok, 1.0).otherwise(0.0)]


def calibrated(raw: Column, temperature: float, bias: float) -> Column:
    return sigmoid(raw / temperature + bias)


def hamming(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def hash_bits(hex16: Column) -> Column:
    """Sixteen hex digits as a signed long."""
    return F.conv(hex16, 16, -10).cast("long")


def half_even(x: Column) -> Column:
    return F.bround(x)


def container(content: Column) -> Column:
    """What a file's first bytes say it is."""
    head = F.hex(F.substring(content, 1, 8))
    return F.when(head.startswith("FFD8FF"), "JPEG").when(head == "89504E470D0A1A0A", "PNG").otherwise("OTHER")


def sample_id(prefix: str, n: Column) -> Column:
    return F.format_string(f"{prefix}-%06d", n)


def source_id(label: Column, sha: Column) -> Column:
    return F.concat_ws("-", label.cast("string"), F.substring(sha, 1, 16))


def array_stats(values: Column, base: Column) -> Column:
    """mean, population std, range, max |delta| of a base and its probes; null without probes."""
    every = F.concat(F.array(base), values)
    n = F.size(every).cast("double")
    mean = F.aggregate(every, F.lit(0.0), lambda a, x: a + x) / n
    var = F.aggregate(every, F.lit(0.0), lambda a, x: a + (x - mean) * (x - mean)) / n
    stats = F.struct(mean.alias("mean"), F.sqrt(var).alias("std"), (F.array_max(every) - F.array_min(every)).alias("range"), F.array_max(F.transform(values, lambda x: F.abs(x - base))).alias("max_delta"))
    return F.when((F.size(values) > 0) & base.isNotNull(), stats)


def probe_flip(values: Column, base: Column, threshold: float) -> Column:
    """Does any probe change the verdict; null if nothing can be said."""
    return F.when((F.size(values) > 0) & base.isNotNull(), F.exists(values, lambda v: (v >= threshold) != (base >= threshold)))


def disagreement(values: Column) -> Column:
    """max, mean and number of |a - b| over all pairs of an array; null for fewer than two."""
    i = F.sequence(F.lit(1), F.size(values))
    pairs = F.flatten(F.transform(i, lambda a: F.transform(F.filter(i, lambda b: b > a), lambda b: F.abs(F.element_at(values, a) - F.element_at(values, b)))))
    s = F.struct(F.array_max(pairs).alias("max"), (F.aggregate(pairs, F.lit(0.0), lambda t, x: t + x) / F.size(pairs)).alias("mean"), F.size(pairs).alias("pairs"))
    return F.when(F.size(values) >= 2, s)


def perplexity(values: Column) -> Column:
    """exp of the entropy of an array's absolute values as shares; null if they are all zero."""
    a = F.transform(values, lambda x: F.abs(x))
    total = F.aggregate(a, F.lit(0.0), lambda t, x: t + x)
    return F.when(total > 0, F.exp(-F.aggregate(a, F.lit(0.0), lambda t, x: t + F.when(x > 0, x / total * F.log(x / total)).otherwise(0.0))))


def fused_weights(logits: Column, available: Column) -> Column:
    """Softmax over the available entries; all zeros if none is."""
    top = F.array_max(F.zip_with(logits, available, lambda x, ok: F.when(ok, x)))
    e = F.zip_with(logits, available, lambda x, ok: F.when(ok, F.exp(x - top)).otherwise(0.0))
    total = F.aggregate(e, F.lit(0.0), lambda t, x: t + x)
    return F.when(total > 0, F.transform(e, lambda x: x / total)).otherwise(F.transform(e, lambda x: F.lit(0.0)))


def masked_mean(values: Column, available: Column) -> Column:
    """Mean of the available entries; null if none is."""
    total = F.aggregate(F.zip_with(values, available, lambda x, ok: F.when(ok, x).otherwise(0.0)), F.lit(0.0), lambda t, x: t + x)
    return F.try_divide(total, F.size(F.filter(available, lambda a: a)).cast("double"))
