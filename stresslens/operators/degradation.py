"""Which perturbation a view went through, told from descriptors: a class-weighted network trained from summed gradients.

A step is one scan: every task sums loss and gradient over its rows, Spark adds them up, and the driver, which holds
nothing but the parameters, moves them. Counts of classes, means and deviations come from aggregates before.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType

from stresslens.operators import batchfit
from stresslens.operators.batchfit import Fit
from stresslens.operators.fit import Network
from stresslens.operators.metrics import r6

#: Families that the detector is weak in, and the two that descriptors can't tell apart.
HARD, ALIKE = ("blur", "resize", "noise"), ("clean", "color")
CAVEAT = "`clean` and mild colour adjustment are not reliably separable from these descriptors"


@dataclass
class Reporter:
    classes: tuple[str, ...]
    columns: tuple[str, ...]
    mean: np.ndarray
    scale: np.ndarray
    network: Network
    losses: list[float]


def described(rows: DataFrame, columns: tuple[str, ...]) -> tuple[DataFrame, list[str]]:
    """rows with two numbers a descriptor: its value, 0 where it is missing or not finite, and whether it is there."""
    ok = lambda c: F.col(c).isNotNull() & ~F.isnan(F.col(c).cast("double")) & (F.abs(F.col(c).cast("double")) < float("inf"))
    names = [f"_d{i}{x}" for i in range(len(columns)) for x in "vp"]
    pairs = [y for c in columns for y in (F.when(ok(c), F.col(c).cast("double")).otherwise(0.0), ok(c).cast("double"))]
    return rows.select("*", *[p.alias(n) for p, n in zip(pairs, names, strict=True)]), names


def train(rows: DataFrame, family: str, columns: tuple[str, ...], classes: tuple[str, ...], hidden: int = 32, rounds: int = 600, rate: float = 0.05, seed: int = 20260828) -> Reporter:
    """Adam over whole-table gradients; classes weigh the inverse of how often they are, rows of other classes take no part."""
    index = F.create_map(*[x for i, c in enumerate(classes) for x in (F.lit(c), F.lit(i))])
    d, names = described(rows.where(F.col(family).isin(*classes)), columns)
    d = d.select(*names, index[F.col(family)].alias("label"), F.lit(True).alias("all")).persist()
    fit, k = [Fit("network", tuple(names), "all")], len(classes)
    first = batchfit.summed(d, fit, lambda i, x, y: np.concatenate([np.bincount(y.astype(int), minlength=k), x.sum(0)])).get(0)
    if first is None:
        raise ValueError("no row of any class")
    count, mean = first[:k], first[k:] / first[:k].sum()
    mean[1::2] = 0.0  # indicators keep their meaning
    scale = np.sqrt(batchfit.summed(d, fit, lambda i, x, y: ((x - mean) ** 2).sum(0))[0] / count.sum())
    scale[1::2] = 1.0
    scale[scale < 1e-8] = 1.0
    weight = count.sum() / (k * np.maximum(count, 1))
    total = float((weight * count).sum())
    network = Network([len(names), hidden, k], "relu", seed)

    def step(i: int, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """The rows' share of the loss and of its gradient."""
        c = y.astype(int)
        out, inputs, sums = network.forward((x - mean) / scale)
        z = out - out.max(1, keepdims=True)
        p = np.exp(z) / np.exp(z).sum(1, keepdims=True)
        w = weight[c] / total
        value = -(w * np.log(p[np.arange(len(c)), c] + 1e-300)).sum()
        p[np.arange(len(c)), c] -= 1
        return np.concatenate([[value], *[g.ravel() for g in network.gradient(x, p * w[:, None], inputs, sums)]])

    losses, moment, second = [], 0.0, 0.0
    parts = [p for pair in zip(network.w, network.b, strict=True) for p in pair]
    edges = np.cumsum([0, *[p.size for p in parts]])
    for t in range(1, rounds + 1):
        s = batchfit.summed(d, fit, step)[0]
        losses.append(float(s[0]))
        g = s[1:]
        moment, second = 0.9 * moment + 0.1 * g, 0.999 * second + 0.001 * g * g
        move = rate * (moment / (1 - 0.9**t)) / (np.sqrt(second / (1 - 0.999**t)) + 1e-8)
        for p, a, b in zip(parts, edges, edges[1:], strict=False):
            p -= move[a:b].reshape(p.shape)
    d.unpersist()
    return Reporter(classes, columns, mean, scale, network, losses)


def report(rows: DataFrame, r: Reporter) -> DataFrame:
    """rows with family (the likeliest), confidence, second, weak_here and caveat: set where the two likeliest are those that can't be told apart."""
    d, names = described(rows, r.columns)
    schema = d.drop(*names).schema.add("probabilities", ArrayType(DoubleType()))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = np.column_stack([b.column(c).to_numpy(zero_copy_only=False) for c in names])
            z = r.network((x - r.mean) / r.scale)
            p = np.exp(z - z.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            flat = pa.ListArray.from_arrays(pa.array(np.arange(0, p.size + 1, p.shape[1], dtype=np.int32)), pa.array(p.ravel()))
            yield pa.RecordBatch.from_arrays([*[b.column(c.name) for c in schema[:-1]], flat], schema.names)

    named = F.zip_with(F.array(*[F.lit(c) for c in r.classes]), F.col("probabilities"), lambda c, p: F.struct((-p).alias("p"), c.alias("c")))
    told = d.mapInArrow(work, schema).withColumn("_r", F.array_sort(named))
    top: list[Column] = [F.col("_r")[i]["c"] for i in (0, 1)]
    alike = F.array_sort(F.array(*top)) == F.array(*[F.lit(c) for c in sorted(ALIKE)])
    return told.select(*schema.names[:-1], top[0].alias("told_family"), r6(-F.col("_r")[0]["p"]).alias("confidence"), top[1].alias("second"), top[0].isin(*HARD).alias("weak_here"), F.when(alike, F.lit(CAVEAT)).alias("caveat"))


def confusion(told: DataFrame, family: str) -> DataFrame:
    """family, n, recall, most_confused, confused: by true family, what it is mistaken for most, the first by name of equal ones."""
    c = told.groupBy(family, "told_family").agg(F.count("*").alias("m"))
    other = F.when(F.col("told_family") != F.col(family), F.struct((-F.col("m")).alias("m"), F.col("told_family").alias("f")))
    s = c.groupBy(F.col(family).alias("family")).agg(F.sum("m").alias("n"), F.sum(F.when(F.col("told_family") == F.col(family), F.col("m")).otherwise(0)).alias("right"), F.min(other).alias("x"))
    return s.select("family", "n", r6(F.col("right") / F.col("n")).alias("recall"), F.col("x.f").alias("most_confused"), (-F.col("x.m")).alias("confused"))

