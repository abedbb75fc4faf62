"""Scoring a stream with frozen models that may be swapped between micro-batches: a bad digest stops it, no row is scored twice."""

from __future__ import annotations

import math
from dataclasses import asdict, dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.utils import AnalysisException

from stresslens.functions import scalars
from stresslens.operators import features
from stresslens.operators.fit import digest

MODEL = "version long, features array<string>, experts array<string>, mean array<double>, scale array<double>, weights array<double>, bias double, reliability_weights array<double>, reliability_bias double, threshold double, abstain_below double, sha256 string"


class ModelError(ValueError):
    """A model that may not score: what it says of itself doesn't hold."""


@dataclass(frozen=True)
class Model:
    """A frozen linear head over feature_names(experts). Without reliability weights there is no reliability and nothing abstains."""

    version: int
    experts: list[str]
    features: list[str]
    mean: list[float]
    scale: list[float]
    weights: list[float]
    bias: float
    threshold: float
    reliability_weights: list[float] | None = None
    reliability_bias: float | None = None
    abstain_below: float | None = None

    def faults(self) -> list[str]:
        n, out = len(self.features), []
        numbers = [*self.mean, *self.scale, *self.weights, self.bias, *(self.reliability_weights or []), *([] if self.reliability_bias is None else [self.reliability_bias])]
        if self.features != features.feature_names(self.experts):
            out.append("features have drifted")
        if not n == len(self.mean) == len(self.scale) == len(self.weights) or self.reliability_weights is not None and len(self.reliability_weights) != n:
            out.append("lengths differ")
        if not all(map(math.isfinite, numbers)) or any(s <= 0 for s in self.scale):
            out.append("numbers that aren't finite, or a scale that isn't positive")
        if not (math.isfinite(self.threshold) and 0 <= self.threshold <= 1):
            out.append("threshold out of range")
        if (self.reliability_weights is None) != (self.reliability_bias is None):
            out.append("half a reliability head")
        if self.abstain_below is not None and (self.reliability_weights is None or not 0 <= self.abstain_below <= 1):
            out.append("an abstention that no reliability stands behind")
        return out


def publish(spark: SparkSession, path: str, model: Model) -> None:
    """Append a model to the table of models. A version is published once: another model under it is refused when it is read."""
    if faults := model.faults():
        raise ModelError(f"version {model.version}: {'; '.join(faults)}")
    body = asdict(model)
    row = {**body, "sha256": digest(body)}
    spark.createDataFrame([tuple(row[f.split()[0]] for f in MODEL.split(", "))], MODEL).coalesce(1).write.mode("append").parquet(path)


def newest(spark: SparkSession, path: str, threshold: float | None = None) -> Model:
    """The model of the highest version, held to its digest. threshold: what a caller expects; a frozen model isn't retargeted.

    Only the rows of the highest version come to the driver.
    """
    table = spark.read.schema(MODEL).parquet(path)
    top = table.agg(F.max("version").alias("v")).first().v
    if top is None:
        raise ModelError("no model is published")
    rows = table.where(F.col("version") == top).dropDuplicates(["sha256"]).limit(2).collect()
    if len(rows) > 1:
        raise ModelError(f"version {top} was published with two digests")
    body = rows[0].asDict()
    told = body.pop("sha256")
    try:
        model = Model(**body)
        same = digest(asdict(model)) == told
    except ValueError:  # digests are of finite numbers
        same = False
    if not same:
        raise ModelError(f"version {top} isn't what was published: digest differs")
    if faults := model.faults():
        raise ModelError(f"version {top}: {'; '.join(faults)}")
    if threshold is not None and abs(threshold - model.threshold) > 1e-12:
        raise ModelError(f"version {top} is frozen at {model.threshold}, not {threshold}")
    return model


def _dot(x: str, weights: list[float], bias: float) -> Column:
    return F.aggregate(F.zip_with(x, F.array(*[F.lit(float(w)) for w in weights]), lambda a, b: a * b), F.lit(float(bias)), lambda t, v: t + v)


def score(rows: DataFrame, model: Model, keep: list[str]) -> DataFrame:
    """keep, version, p_fake, decision, reliability, abstain, n_experts, error of cache rows.

    A row that no expert answered has an error and no verdict. decision is null for an abstention. Without a fitted
    reliability it is null, never a number. Flips of probes are told at the model's own threshold.
    """
    answered = F.size(F.filter(F.array(*[F.coalesce(F.col("experts")[e]["ok"], F.lit(False)) for e in model.experts]), lambda x: x))
    numbers = lambda v: F.array(*[F.lit(float(x)) for x in v])
    x = F.zip_with(F.zip_with(features.feature_vector(model.experts, model.threshold), numbers(model.mean), lambda a, m: a - m), numbers(model.scale), lambda a, s: a / s)
    d = rows.withColumns({"_x": x, "n_experts": answered})
    ok = F.col("n_experts") > 0
    fitted = model.reliability_weights is not None
    d = d.withColumn("p_fake", F.when(ok, scalars.sigmoid(_dot("_x", model.weights, model.bias))))
    d = d.withColumn("reliability", F.when(ok, scalars.sigmoid(_dot("_x", model.reliability_weights, model.reliability_bias))) if fitted else F.lit(None).cast("double"))
    d = d.withColumn("abstain", F.coalesce(F.col("reliability") < model.abstain_below, F.lit(False)) if model.abstain_below is not None else F.lit(False))
    decision = F.when(ok & ~F.col("abstain"), F.when(F.col("p_fake") >= model.threshold, "fake").otherwise("real"))
    return d.select(*keep, F.lit(model.version).cast("long").alias("version"), "p_fake", decision.alias("decision"), "reliability", "abstain", "n_experts", F.when(~ok, "no expert answered").alias("error"))


def run(rows: DataFrame, models: str, out: str, checkpoint: str, keep: list[str], threshold: float | None = None, trigger: dict | None = None) -> StreamingQuery:
    """Start scoring a stream of cache rows into the folder `out`, each micro-batch by the model that is newest when it begins.

    A batch has a folder of its own, written over when the batch is run again after a failure, so each row is there once
    and by one version. A model that fails its checks raises in the batch: the stream stops there and what came before stays.
    """

    def batch(d: DataFrame, number: int) -> None:
        model = newest(d.sparkSession, models, threshold)
        score(d, model, keep).write.mode("overwrite").parquet(f"{out}/batch={number}")

    return rows.writeStream.option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).foreachBatch(batch).start()


def scored(spark: SparkSession, out: str, keep: str) -> DataFrame:
    """What run() wrote, by the schema of keep (as DDL) and the scores. Nothing written is no rows."""
    schema = f"{keep}, version long, p_fake double, decision string, reliability double, abstain boolean, n_experts int, error string, batch long"
    try:
        return spark.read.schema(schema).option("basePath", out).parquet(out)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)
