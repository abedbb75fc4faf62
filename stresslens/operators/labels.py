"""Connected components by shrinking stars; every round is checkpointed to the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stresslens.operators.shared import cut


def connected(pairs: DataFrame) -> DataFrame:
    """node, root (the smallest node reached) of every node of pairs (two columns).

    Each round a node takes the least label among its neighbours', then the label of that label; it ends when no
    label moves.
    """
    a, b = pairs.columns
    e = pairs.select(F.col(a).alias("x"), F.col(b).alias("y")).where("x <> y")
    both = cut(e.unionByName(e.select(F.col("y").alias("x"), F.col("x").alias("y"))).distinct())
    labels = cut(both.groupBy("x").agg(F.min("y").alias("m")).select(F.col("x").alias("node"), F.least("x", "m").alias("root")))
    while True:
        near = both.join(labels.select(F.col("node").alias("y"), F.col("root").alias("r")), "y").groupBy("x").agg(F.min("r").alias("r"))
        step = labels.join(near, F.col("node") == F.col("x")).select("node", F.col("root").alias("old"), F.least("root", "r").alias("root"))
        jump = step.select(F.col("node").alias("of"), F.col("root").alias("far"))
        new = cut(step.join(jump, F.col("root") == F.col("of"), "left").select("node", "old", F.least("root", F.coalesce("far", "root")).alias("root")))
        if new.where("root <> old").isEmpty():
            return new.select("node", "root")
        labels = new.select("node", "root")
