"""Scoring views with a registry of experts: a failure is a typed row, never a number."""

from __future__ import annotations

import hashlib
import math
import time
from collections.abc import Callable, Iterator
from typing import Protocol

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stresslens.operators import kernels
from stresslens.operators.features import static_average

FUSIONS = ("naive_mean", "logit_mean")


class ExpertError(Exception):
    """An expert can't score a raster; code is for machines."""

    def __init__(self, code: str, message: str = ""):
        super().__init__(message or code)
        self.code = code


class Expert(Protocol):
    id: str

    def predict(self, raster: np.ndarray) -> float:
        """The raw logit of a raster; raises ExpertError."""


class ContrastExpert:
    """A deterministic stand-in without weights: the logit grows with fine contrast. For tests and dry runs."""

    def __init__(self, id_: str = "contrast", gain: float = 40.0, least: int = 3):
        self.id, self.gain, self.least = id_, gain, least

    def predict(self, raster: np.ndarray) -> float:
        if min(raster.shape[:2]) < self.least:
            raise ExpertError("too_small", f"smaller than {self.least} pixels")
        return self.gain * (math.sqrt(kernels.blur_varlap(kernels.luma(raster))) - 0.1)


def registry(makers: dict[str, Callable[[], Expert]]) -> tuple[dict[str, Expert], dict[str, str]]:
    """Experts that could be made, and why the others couldn't; none at all is an error."""
    made: dict[str, Expert] = {}
    failed: dict[str, str] = {}
    for name, make in makers.items():
        try:
            made[name] = make()
        except Exception as e:  # noqa: BLE001  an expert may fail in any way; it is told, and the others go on
            failed[name] = f"{type(e).__name__}: {e}"
    if not made:
        raise RuntimeError(f"no expert could be made: {failed}")
    return made, failed


_EXPERT = pa.struct([("ok", pa.bool_()), ("raw_logit", pa.float64()), ("p", pa.float64()), ("inference_ms", pa.float64()), ("reason_code", pa.string()), ("message", pa.string())])
_SCORED = "rel_path string, condition_id string, view_sha256 string, experts map<string,struct<ok:boolean,raw_logit:double,p:double,inference_ms:double,reason_code:string,message:string>>, probes array<double>, error string"


def score(views: DataFrame, experts: dict[str, Expert], primary: str) -> DataFrame:
    """experts (a block for each, failures typed) and probes (the primary's scores of the probes) of every view.

    views: what kernels.views() returns. One Arrow pass; training and serving share it.
    """

    def one(x: np.ndarray, e: Expert) -> dict:
        began = time.perf_counter()
        try:
            z = float(e.predict(x))
            if not math.isfinite(z):
                raise ExpertError("not_finite")
            return {"ok": True, "raw_logit": z, "p": 1 / (1 + math.exp(-z)) if z >= 0 else math.exp(z) / (1 + math.exp(z)), "inference_ms": 1000 * (time.perf_counter() - began), "reason_code": None, "message": None}
        except ExpertError as err:
            return {"ok": False, "raw_logit": None, "p": None, "inference_ms": None, "reason_code": err.code, "message": str(err)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("rel_path", pa.string()), ("condition_id", pa.string()), ("view_sha256", pa.string()), ("experts", pa.map_(pa.string(), _EXPERT)), ("probes", pa.list_(pa.float64())), ("error", pa.string())])
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                row = {k: r[k] for k in ("rel_path", "condition_id", "view_sha256", "error")}
                if not r["error"]:
                    x = np.frombuffer(r["data"], np.uint8).reshape(r["height"], r["width"], 3)
                    row["experts"] = [(n, one(x, e)) for n, e in experts.items()]
                    row["probes"] = [p for p in (one(f(x), experts[primary])["p"] for f in kernels.PROBES.values()) if p is not None]
                    if not any(b["ok"] for _, b in row["experts"]):
                        row["error"] = "no expert could score it"
                out.append(row)
            yield pa.RecordBatch.from_pylist(out, schema)

    return views.select("rel_path", "condition_id", "view_sha256", "height", "width", "data", "error").mapInArrow(run, _SCORED)


def fuse(scored: DataFrame, experts: list[str], threshold: float, mode: str = "naive_mean") -> DataFrame:
    """p, decision and the number of experts behind them; null where nothing could be scored."""
    if mode not in FUSIONS:
        raise ValueError(f"fusion is one of {FUSIONS}")
    block = lambda e, f: F.col("experts")[e][f]
    ok = F.array(*[F.coalesce(block(e, "ok"), F.lit(False)) for e in experts])
    n = F.size(F.filter(ok, lambda x: x))
    if mode == "logit_mean":
        p = static_average(F.array(*[block(e, "raw_logit") for e in experts]), ok)
    else:
        some = F.filter(F.array(*[block(e, "p") for e in experts]), lambda x: x.isNotNull())
        p = F.try_divide(F.aggregate(some, F.lit(0.0), lambda t, x: t + x), n.cast("double"))
    p = F.when((n > 0) & F.col("error").isNull(), p)
    return scored.withColumn("n_experts", F.coalesce(n, F.lit(0))).withColumn("p_fake", p).withColumn("decision", F.when(F.col("p_fake") >= threshold, "fake").when(F.col("p_fake").isNotNull(), "real"))


def parity(a: DataFrame, b: DataFrame, keys: list[str], value: str, tolerance: float) -> DataFrame:
    """The largest difference of two paths' values and whether it is within the tolerance; rows on one side only count as not."""
    j = a.select(*keys, F.col(value).alias("_a")).join(b.select(*keys, F.col(value).alias("_b")), keys, "full_outer")
    return j.agg(F.max(F.abs(F.col("_a") - F.col("_b"))).alias("largest"), F.count_if(F.col("_a").isNull() != F.col("_b").isNull()).alias("one_sided")).withColumn("ok", (F.coalesce("largest", F.lit(0.0)) <= tolerance) & (F.col("one_sided") == 0))


def cache_key(versions: dict[str, str], config: dict) -> str:
    """What a feature cache was made with, as a digest; caches of different keys are never mixed."""
    from stresslens.operators.fit import digest

    return hashlib.sha256((digest(versions) + digest(config)).encode()).hexdigest()


def same_key(rows: DataFrame, key: str) -> None:
    other = rows.where(F.coalesce(F.col("cache_key") != key, F.lit(True))).select("cache_key").first()
    if other:
        raise ValueError(f"rows of another cache: {other.cache_key}")
