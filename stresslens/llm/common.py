"""What several operators share: cut lineage, ranks without hot tasks, connected components."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Word separators of every operator here: space and the ASCII control characters tab to carriage return.
BLANKS = r"\x20\x09-\x0D"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder that the cluster names. Only a session in one process may go without: it gets a folder of its own."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = sc.getConf().get("spark.checkpoint.dir")
        if not named and not re.fullmatch(r"local(\[[^-]*\])?", sc.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="checkpoints-"))
    return sc.getCheckpointDir()


def fresh(*frames: DataFrame) -> str:
    """What no column name of the frames begins with."""
    return "_" * (1 + max((len(c) for f in frames for c in f.columns), default=0))


def kept(frame: DataFrame) -> list[Column]:
    """A frame's columns as they are, whatever their names hold."""
    return [F.col("`" + c.replace("`", "``") + "`") for c in frame.columns]


def cut(df: DataFrame) -> DataFrame:
    """Write df to the shared checkpoint folder and go on from there: lost executors don't bring back what came before."""
    checkpoint_dir(df.sparkSession)
    out = df.checkpoint(eager=True)
    df.sparkSession.sparkContext._jvm.System.gc()  # shuffle files are only dropped once the driver has collected what they belonged to
    return out


def packed(df: DataFrame) -> DataFrame:
    """The same by a Parquet table in the shared folder, for wide or many rows: a third of the size, and columns can be left out."""
    path = f"{checkpoint_dir(df.sparkSession)}/packed-{uuid.uuid4().hex}"
    df.write.parquet(path)
    df.sparkSession.sparkContext._jvm.System.gc()
    return df.sparkSession.read.schema(df.schema).parquet(path)


def text_key(text: Column) -> list[Column]:
    """128 bits of a text and its length, as columns k1, k2, k3; null texts share a key of their own."""
    return [F.xxhash64(text).alias("k1"), F.xxhash64(F.lit(1), text).alias("k2"), F.coalesce(F.octet_length(text), F.lit(-1)).alias("k3")]


def running(df: DataFrame, within: list[str], order: Column, ties: list[str], value: Column, name: str, rows: int | None = None) -> DataFrame:
    """Add the sum of value over the rows before this one, within a group, in the order of a 64-bit number.

    A group may hold any share of the rows: the order's top bits deal a group into ranges of some ten thousand rows,
    the sums of the ranges are run over on their own, and a window only ever sees one range of one group. rows: how
    many df has, where that is known; df is counted otherwise.
    """
    bits = min(24, max(4, (df.count() if rows is None else rows).bit_length() - 13))
    d = df.withColumn("_o", order).withColumn("_v", value.cast("long"))
    d = d.withColumn("_r", F.shiftright("_o", 64 - bits))
    sums = d.groupBy(*within, "_r").agg(F.sum("_v").alias("_s"))
    before = W.partitionBy(*within).orderBy("_r").rowsBetween(W.unboundedPreceding, -1) if within else W.orderBy("_r").rowsBetween(W.unboundedPreceding, -1)
    sums = sums.select(*[F.col(c).alias(f"_w{i}") for i, c in enumerate(within)], F.col("_r").alias("_q"), F.coalesce(F.sum("_s").over(before), F.lit(0)).alias("_b"))
    on = F.col("_r") == F.col("_q")
    for i, c in enumerate(within):
        on &= F.col(c).eqNullSafe(F.col(f"_w{i}"))
    inside = W.partitionBy(*within, "_r").orderBy("_o", *ties).rowsBetween(W.unboundedPreceding, -1)
    d = d.withColumn("_i", F.coalesce(F.sum("_v").over(inside), F.lit(0)))
    keep = [F.col(c) for c in df.columns]
    return d.join(sums, on).select(*keep, (F.col("_b") + F.col("_i")).alias(name))


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root): for every node of an edge the smallest node that it reaches.

    Alternates two star contractions until nothing changes; the rounds grow with the logarithm of the longest chain.
    Every round is written to the checkpoint folder; a node of very many edges is aggregated before the shuffle and
    its join can be split.
    """
    e = cut(edges.where(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct())
    seen = None
    while True:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("w"), F.least("u", "m").alias("m"))
        large = both.join(low, F.col("u") == F.col("w")).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("w"), "m")
        small = large.join(low, F.col("u") == F.col("w")).select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("x")).select("x.u", "x.v").where("u != v").distinct()
        e = cut(small)
        now = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == seen:
            break
        seen = now
    roots = e.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return roots.unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def times(documents: DataFrame, counts: DataFrame, text: str = "text", doc_id: str = "doc_id", carry: tuple[str, ...] = ()) -> DataFrame:
    """The rows of documents, each different (doc_id, text) as often as counts (doc_id, th, n) says; th is xxhash64 of the text.

    Rows that counts doesn't have go. A row that documents has several times counts once.
    carry: columns of counts that the rows get.
    """
    x = fresh(documents, counts)
    given = counts.select(F.struct("doc_id", "th").alias(f"{x}of"), F.col("n").alias(f"{x}n"), *carry).where(F.col(f"{x}n") > 0)
    d = documents.withColumn(f"{x}h", F.struct(F.col(doc_id).cast("long").alias("doc_id"), F.xxhash64(text).alias("th")))
    found = d.join(given, F.col(f"{x}h").eqNullSafe(F.col(f"{x}of")))
    several = cut(d.groupBy(F.col(f"{x}h").alias(f"{x}g")).agg(F.count("*").alias(f"{x}m")).where(F.col(f"{x}m") > 1).select(f"{x}g"))
    if not several.isEmpty():
        same = F.col(f"{x}h").eqNullSafe(F.col(f"{x}g"))
        found = found.join(several, same, "left_anti").unionByName(found.join(several, same, "left_semi").dropDuplicates([f"{x}h"]))
    return found.withColumn(f"{x}i", F.explode(F.sequence(F.lit(1), F.col(f"{x}n").cast("int")))).select(*kept(documents), *carry)
