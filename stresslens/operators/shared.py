"""Lineage cut in the shared folder, and ranks of any number of rows without a task that sees them all."""

from __future__ import annotations

import re
import tempfile
import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def _named(spark: SparkSession) -> None:
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = sc.getConf().get("spark.checkpoint.dir")
        if not named and not re.fullmatch(r"local(\[[^-]*\])?", sc.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="checkpoints-"))


def cut(df: DataFrame) -> DataFrame:
    """df written to the folder in spark.checkpoint.dir. Only a session in one process may go without, and gets a folder of its own."""
    _named(df.sparkSession)
    return df.checkpoint(eager=True)


def folder(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, for tables and state that driver and executors both reach."""
    _named(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/{name}-{uuid.uuid4().hex}"


def ranked(rows: DataFrame, order: list[Column], within: list[str] | None = None, name: str = "rank", n: str | None = None) -> DataFrame:
    """rows with their rank from 0 within groups, in an order that should be total; n names a column for the group's size.

    Rows are dealt by ranges of group and order and sorted there, so a group may hold any share of them; a row's place
    is its range's start and its place in the range, and a group starts at its least place. The driver sees one
    number a range. Nulls in within are a group.
    """
    within = within or []
    d = cut(rows.repartitionByRange(*[F.col(c) for c in within], *order).sortWithinPartitions(*[F.col(c) for c in within], *order).withColumn("_m", F.monotonically_increasing_id()))
    at, starts = 0, []
    for r in d.groupBy(F.shiftright("_m", 33).alias("p")).count().orderBy("p").collect():
        starts.append((r.p, at))
        at += r["count"]
    offsets = F.broadcast(d.sparkSession.createDataFrame(starts or [(0, 0)], "_p long, _at long"))  # a row a range
    d = d.join(offsets, F.shiftright("_m", 33) == F.col("_p")).withColumn("_place", F.col("_at") + F.col("_m").bitwiseAND((1 << 33) - 1))
    groups = d.groupBy(*within).agg(F.min("_place").alias("_first"), F.count("*").alias("_n"))
    if within:
        d = d.join(groups.select(*[F.col(c).alias(f"_g_{c}") for c in within], "_first", "_n"), [F.col(c).eqNullSafe(F.col(f"_g_{c}")) for c in within])
    else:
        d = d.crossJoin(F.broadcast(groups))  # one row
    return d.select(*rows.columns, (F.col("_place") - F.col("_first")).alias(name), *([F.col("_n").alias(n)] if n else []))


def below_by_ranges(counts: DataFrame, value: str, within: list[str], m: str) -> DataFrame:
    """counts (within, value, m: one row a value) with below, how many rows of the group have a lesser value, and n, the group's rows.

    Values are dealt by ranges, so a group may have more of them than a task holds; ranges' sums are broadcast, a row a range and group.
    """
    keys = [F.col(c) for c in within]
    d = cut(counts.repartitionByRange(*keys, F.col(value)).withColumn("_r", F.spark_partition_id()))
    ranges = d.groupBy(*within, "_r").agg(F.sum(m).alias("_rm"))
    upto = W.partitionBy(*within).orderBy("_r").rowsBetween(W.unboundedPreceding, -1)
    ranges = ranges.select(*[F.col(c).alias(f"_g_{c}") for c in within], F.col("_r").alias("_at"), F.coalesce(F.sum("_rm").over(upto), F.lit(0)).alias("_start"), F.sum("_rm").over(W.partitionBy(*within)).alias("n"))
    same = [F.col(c).eqNullSafe(F.col(f"_g_{c}")) for c in within]
    d = d.join(F.broadcast(ranges), reduce(Column.__and__, same, F.col("_r") == F.col("_at")))
    inside = F.coalesce(F.sum(m).over(W.partitionBy("_r", *within).orderBy(value).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    return d.select(*counts.columns, (F.col("_start") + inside).alias("below"), "n")
