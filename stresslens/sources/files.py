"""Reading and writing: image directories, prediction rows, denylists, manifests, resumable and atomic output."""

from __future__ import annotations

import json
import math
import os
import tempfile
from pathlib import Path
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: The suffixes that are taken for images.
SUFFIXES = ("jpg", "jpeg", "png", "webp", "bmp", "tif", "tiff", "gif", "ppm", "pgm")

FAILURE = T.StructType([T.StructField(n, T.StringType()) for n in ("expert_id", "reason_code", "message", "image_sha256")])
PREDICTION_ROW = T.StructType(
    [T.StructField(n, T.StringType()) for n in ("schema_version", "run_id", "method_id", "sample_id", "source_id", "image_path", "dataset", "source_group", "content_sha256")]
    + [T.StructField("label", T.IntegerType()), T.StructField("condition_id", T.StringType()), T.StructField("p_fake", T.DoubleType()), T.StructField("reliability", T.DoubleType())]
    + [T.StructField("decision", T.StringType()), T.StructField("rescue_invoked", T.BooleanType()), T.StructField("inference_ms", T.DoubleType())]
    + [T.StructField("expert_failures", T.ArrayType(FAILURE)), T.StructField("warnings", T.ArrayType(T.StringType()))]
)


def images(spark: SparkSession, root: str, recursive: bool = True) -> DataFrame:
    """rel_path, content, length, sha256 of every image below root, by suffix in any case."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", recursive).load(root)
    base = F.regexp_replace(F.lit(root.rstrip("/")), "^file:", "")
    plain = F.regexp_replace("path", "^file:/*", "/")
    suffix = F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1))
    return files.where(suffix.isin(*SUFFIXES)).select(F.expr("1").alias("_"), plain.alias("path"), F.substring(plain, F.length(base) + 2, F.length(plain)).alias("rel_path"), "content", "length", F.sha2("content", 256).alias("sha256")).drop("_")


def pixels(spark: SparkSession, root: str) -> DataFrame:
    """rel_path, height, width, channels, mode, data in blue, green, red order; an undecodable image has error and no data."""
    d = spark.read.format("image").option("dropInvalid", False).load(root)
    bad = F.col("image.height") < 0
    keep = lambda c: F.when(~bad, F.col(f"image.{c}")).alias(c)
    return d.select(F.col("image.origin").alias("path"), *[keep(c) for c in ("height", "width", "nChannels", "data")], F.when(bad, "undecodable").alias("error"))


def prediction_rows(spark: SparkSession, path: str, strict: bool = True) -> DataFrame:
    """JSON lines by an explicit schema; a malformed line fails the read, or, if not strict, is kept in _corrupt_record."""
    if strict:
        return spark.read.schema(PREDICTION_ROW).option("mode", "FAILFAST").json(path)
    return spark.read.schema(T.StructType([*PREDICTION_ROW.fields, T.StructField("_corrupt_record", T.StringType())])).option("mode", "PERMISSIVE").json(path)


def denylist(spark: SparkSession, path: str) -> DataFrame:
    """sha256, phash (null without) of lines `sha256 [phash=hex] # comment`; a malformed line or an empty list is an error."""
    line = F.trim(F.regexp_replace("value", "#.*$", ""))
    d = spark.read.text(path).select(line.alias("line")).where("line <> ''")
    ok = F.col("line").rlike("^[0-9a-fA-F]{64}([ \\t]+phash=[0-9a-fA-F]{16})?$")
    n = d.agg(F.count("*").alias("n"), F.count_if(~ok).alias("bad")).first()
    if n.bad or not n.n:
        raise ValueError(f"{path}: {n.bad} malformed lines" if n.bad else f"{path} lists nothing")
    phash = F.lower(F.regexp_extract("line", "phash=([0-9a-fA-F]{16})", 1))
    return d.select(F.lower(F.substring("line", 1, 64)).alias("sha256"), F.when(phash != "", phash).alias("phash"))


def manifest(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """images[] of a JSON document, or the document itself if it is a list."""
    text = spark.read.text(path, wholetext=True)
    images_ = F.from_json("value", f"struct<images:array<struct<{schema}>>>")["images"]
    bare = F.from_json("value", f"array<struct<{schema}>>")
    return text.select(F.explode(F.coalesce(F.when(F.ltrim("value").startswith("["), bare).otherwise(images_), F.array())).alias("i")).select("i.*")


def pruned(spark: SparkSession, path: str, columns: list[str], condition: str | None = None) -> DataFrame:
    """Only these columns, and only rows of a condition: both reach the Parquet scan."""
    d = spark.read.parquet(path)
    return (d.where(F.col("condition_id") == condition) if condition else d).select(*columns)


def append_pending(rows: DataFrame, path: str, keys: list[str]) -> int:
    """Append the rows whose keys the output doesn't have yet; how many. Run again after a failure it writes the rest."""
    spark = rows.sparkSession
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    if hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop):
        rows = rows.join(spark.read.parquet(path).select(*keys).distinct(), keys, "left_anti")
    n = rows.count()
    if n:
        rows.write.mode("append").parquet(path)
    return n


def inference_output(rows: DataFrame, on_error: str, path: str = "image_path", value: str = "p_fake") -> DataFrame:
    """image_path, pred, error: errors as null predictions, left out ("skip"), or refused ("strict")."""
    out = rows.select(F.col(path).alias("image_path"), F.when(F.col("error").isNull(), F.col(value)).alias("pred"), "error")
    if on_error == "null":
        return out
    if on_error == "skip":
        return out.where("error is null").drop("error")
    if on_error == "strict":
        bad = out.where("error is not null").first()
        if bad:
            raise ValueError(f"{bad.image_path}: {bad.error}")
        return out.drop("error")
    raise ValueError("on_error must be null, skip or strict")


def find_non_finite(value: Any, at: str = "$") -> list[str]:
    """Where in a nested value a number isn't finite."""
    if isinstance(value, float):
        return [] if math.isfinite(value) else [at]
    if isinstance(value, dict):
        return [x for k, v in value.items() for x in find_non_finite(v, f"{at}.{k}")]
    if isinstance(value, list | tuple):
        return [x for i, v in enumerate(value) for x in find_non_finite(v, f"{at}[{i}]")]
    return []


def write_json(value: Any, path: str) -> None:
    """All or nothing: written beside the target, synced, and renamed. A number that isn't finite is refused."""
    if bad := find_non_finite(value):
        raise ValueError(f"not finite: {', '.join(bad[:5])}")
    target = Path(path)
    fd, name = tempfile.mkstemp(dir=target.parent, prefix=f".{target.name}.")
    try:
        with os.fdopen(fd, "w", encoding="utf-8") as f:
            json.dump(value, f, indent=2, sort_keys=True, allow_nan=False)
            f.flush()
            os.fsync(f.fileno())
        os.replace(name, target)
    except BaseException:
        Path(name).unlink(missing_ok=True)
        raise


def verify_hashes(files: DataFrame, expected: DataFrame) -> DataFrame:
    """path, status (OK, DRIFT, MISSING) of expected files (path, sha256) against what was read (path, sha256)."""
    e, f = expected.select("path", F.col("sha256").alias("want")), files.select("path", F.col("sha256").alias("have"))
    return e.join(f, "path", "left").select("path", F.when(F.col("have").isNull(), "MISSING").when(F.col("have") == F.col("want"), "OK").otherwise("DRIFT").alias("status"))
