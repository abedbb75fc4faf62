"""Mixing sources to target weights, natively.

Target words per source follow from the weights by filling up to the caps; the document occurrences of a source,
laid end to end in a hashed order and once more for a second epoch, are taken until its target is reached; so a
source's quota of blocks is exact. Output shards then come from a splitting tree: the node that holds all blocks
halves its positions again and again, and a child's blocks of each source are distributed as a multivariate
hypergeometric draw without replacement. It is drawn by one hashed permutation of all blocks, whose ranks are found
without a global sort; the leading part of a block's rank is its path down the tree, which makes the shards' blocks
disjoint and their numbers exact. Inside a shard the permutation's order is the local shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stresslens.llm.common import BLANKS, cut, running

#: Relative weights of the sources in the order of their names, repeating.
WEIGHTS = (5, 2, 1)


def hashed(*what: Column) -> Column:
    """60 bits of md5 as a non-negative number: the same order in every engine."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", *[F.coalesce(w.cast("string"), F.lit("")) for w in what])), 1, 15), 16, 10).cast("long")


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(f"[^{BLANKS}]+")), F.lit(0)).cast("long")


def targets(sizes: DataFrame, share: float = 1.5, epochs: int = 2, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """source, source_size, target for the rows (source, source_size) of sizes, one for each source, null last.

    The sources share `share` of all words by weight; what a source's weight gives it above `epochs` times its own
    words is shared again by the others. Sorted by the level at which a source is full, the full ones are a prefix, so
    one pass finds them.
    """
    order = W.orderBy(F.col("source").asc_nulls_last())
    pick = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("n") % len(weights) + 1).cast("int"))
    d = sizes.withColumn("n", F.row_number().over(order) - 1).withColumn("w", pick).withColumn("cap", (F.col("source_size") * epochs).cast("double"))
    by_level = W.orderBy(F.col("cap") / F.col("w"), "n")
    everything = W.partitionBy()
    before = by_level.rowsBetween(W.unboundedPreceding, -1)
    d = d.withColumn("goal", F.sum("source_size").over(everything) * F.lit(float(share)))
    d = d.withColumn("left", F.col("goal") - F.coalesce(F.sum("cap").over(before), F.lit(0.0)))
    d = d.withColumn("weight", F.sum("w").over(everything) - F.coalesce(F.sum("w").over(before), F.lit(0.0)))
    # the level at which the rest would share, if all before this source were full; the true level is the first that doesn't fill its source
    d = d.withColumn("level", F.col("left") / F.col("weight"))
    d = d.withColumn("open", F.col("level") * F.col("w") < F.col("cap"))
    d = d.withColumn("level", F.min_by("level", F.struct(F.when(F.col("open"), 0).otherwise(1), F.col("cap") / F.col("w"), "n")).over(everything)).withColumn("any", F.max("open").over(everything))
    return d.select("source", "source_size", F.when(F.col("any"), F.least("cap", F.col("level") * F.col("w"))).otherwise(F.col("cap")).alias("target"))


def mix(documents: DataFrame, share: float = 1.5, epochs: int = 2, weights: tuple[int, ...] = WEIGHTS, seed: int = 7, text: str = "text", doc_id: str = "doc_id", source: str = "source") -> DataFrame:
    """doc_id, th (xxhash64 of the text), source, size, at, source_size, target, taken and copies for every row of documents.

    taken counts the words that the mix takes of the row, repeats included, at most `epochs` times its size; over a
    source they add up to its target, rounded down. copies is taken in whole documents, to the nearest. A null text has
    no words and is never taken; at counts the source's words before the row; a null source is a source; rows that are the same are rows of their own; the order
    and so the result is the same in every run. Other columns are not looked at.
    """
    d = cut(documents.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(source).alias("source"), word_count(F.col(text)).alias("size"), hashed(F.lit(seed), F.col(doc_id), F.length(text)).alias("h"), F.xxhash64(text).alias("th")))
    goal = targets(d.groupBy("source").agg(F.sum("size").alias("source_size")), share, epochs, weights).withColumnRenamed("source", "s")
    at = running(d, ["source"], F.shiftleft("h", 3), ["doc_id", "th", "size"], F.col("size"), "at")
    d = at.join(goal, F.col("source").eqNullSafe(F.col("s"))).withColumn("goal", F.floor("target").cast("long"))
    taken = sum((F.greatest(F.least(F.col("goal") - F.col("source_size") * e - F.col("at"), F.col("size")), F.lit(0)) for e in range(epochs)), F.lit(0))
    d = d.withColumn("taken", taken.cast("long"))
    return d.select("doc_id", "th", "source", "size", "at", "source_size", "target", "taken", F.coalesce(F.round(F.try_divide("taken", "size")), F.lit(0)).cast("int").alias("copies"))


def split(counts: list[int], shards: int, seed: int) -> Iterator[tuple[int, int, int, int]]:
    """(number of the source, shard, first, end): the ranks of a source's permuted blocks that a shard draws.

    counts: blocks by source. A node of the tree holds a range of shards and blocks of each source; its left half draws
    its number of blocks without replacement, which is a multivariate hypergeometric draw over the sources, and the
    right half keeps the rest. Shards differ by one block at most; over the shards a source's quotas add up to counts.
    """
    draw = np.random.Generator(np.random.PCG64(seed))
    total, used = sum(counts), np.zeros(len(counts), np.int64)
    nodes = [(0, shards, np.arange(len(counts)), np.array(counts, np.int64))]
    while nodes:
        low, high, which, held = nodes.pop()
        some = held > 0
        which, held = which[some], held[some]
        if not len(held):
            continue
        if high - low == 1:
            for s, n in zip(which.tolist(), held.tolist(), strict=True):
                yield s, low, int(used[s]), int(used[s]) + n
                used[s] += n
            continue
        middle = (low + high) // 2
        left = draw.multivariate_hypergeometric(held, total * middle // shards - total * low // shards, method="marginals")
        nodes += [(middle, high, which, held - left), (low, middle, which, left)]


def deal(mixed: DataFrame, shards: int, block_words: int = 4096, seed: int = 11) -> DataFrame:
    """doc_id, th, source, at, epoch, words, whole, block, shard, slot: the mix dealt to output shards in whole blocks.

    mixed: what mix() returns. A source's occurrences, in a hashed order, form blocks of about block_words words (an
    occurrence belongs to the block in which it starts). split() draws how many blocks of each source a shard gets;
    it gets so many of the source's blocks in their permuted order, and slot is its local shuffle. words are those
    that the mix takes of the occurrence, so over all shards they add up to taken; whole says if that is half of it or
    more. The numbers of blocks by source come to the driver.
    """
    spark = mixed.sparkSession
    epochs = F.explode(F.sequence(F.lit(0), F.ceil(F.col("taken") / F.col("size")).cast("int") - 1)).alias("epoch")
    taken = mixed.where("taken > 0").select("doc_id", "th", "source", "at", "size", "taken", epochs)
    taken = taken.withColumn("words", F.least("size", F.col("taken") - F.col("epoch") * F.col("size"))).drop("taken")
    taken = cut(taken.withColumn("h", hashed(F.lit(seed), F.col("epoch"), F.col("doc_id"), F.col("size"))))
    lined = running(taken, ["source"], F.shiftleft("h", 3), ["doc_id", "epoch", "at"], F.col("words"), "line").withColumn("block", F.floor(F.col("line") / block_words).cast("long"))
    lined = cut(lined)
    blocks = cut(lined.select("source", "block").distinct())
    counts = sorted(blocks.groupBy("source").count().collect(), key=lambda r: (r.source is None, r.source))
    quotas = [(counts[s].source, j, first, end) for s, j, first, end in split([r["count"] for r in counts], shards, seed)]
    schema = T.StructType([T.StructField("s", mixed.schema["source"].dataType)]).add("shard", T.IntegerType()).add("first", T.LongType()).add("end", T.LongType())
    drawn = spark.createDataFrame(quotas, schema).select("s", "shard", F.explode(F.sequence("first", F.col("end") - 1)).alias("drawn"))
    permuted = F.shiftleft(hashed(F.lit(seed + 1), F.col("source"), F.col("block")), 3)
    ranked = running(blocks, ["source"], permuted, ["block"], F.lit(1), "rank")
    path = ranked.join(drawn, F.col("source").eqNullSafe(F.col("s")) & (F.col("rank") == F.col("drawn")))
    path = cut(path.select(F.col("source").alias("s"), F.col("block").alias("k"), "shard"))
    dealt = lined.join(path, F.col("source").eqNullSafe(F.col("s")) & (F.col("block") == F.col("k")))
    mixed_order = F.shiftleft(hashed(F.lit(seed + 2), F.col("source"), F.col("block"), F.col("h")), 3)
    dealt = running(dealt, ["shard"], mixed_order, ["doc_id", "epoch", "at"], F.lit(1), "slot")
    return dealt.select("doc_id", "th", "source", "at", "epoch", "words", (F.col("words") * 2 >= F.col("size")).alias("whole"), "block", "shard", "slot")


def drawn(mixed: DataFrame, dealt: DataFrame) -> DataFrame:
    """mixed with taken as the words of the blocks that deal() gave to the shards; a row is told by source and at."""
    words = dealt.groupBy(F.col("source").alias("s"), F.col("at").alias("a")).agg(F.sum("words").alias("words"))
    same = F.col("source").eqNullSafe(F.col("s")) & (F.col("at") == F.col("a")) & (F.col("size") > 0)
    columns = [F.coalesce("words", F.lit(0)).cast("long").alias(c) if c == "taken" else F.col(c) for c in mixed.columns]
    return mixed.join(words, same, "left").select(*columns)


MIX_SQL = """
WITH d AS (
  SELECT doc_id, source, text,
         CAST(coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0) AS bigint) AS size,
         CAST('0x' || substr(md5('7:' || coalesce(CAST(doc_id AS varchar), '') || ':' || coalesce(CAST(length(text) AS varchar), '')), 1, 15) AS bigint) AS h
  FROM documents
), p AS (
  SELECT *, coalesce(CAST(sum(size) OVER (PARTITION BY source ORDER BY h, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS bigint), 0) AS at FROM d
), s AS (
  SELECT source, CAST(sum(size) AS bigint) AS source_size FROM d GROUP BY source
), w AS (
  SELECT *, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS n FROM s
), c AS (
  SELECT *, CAST(CASE n % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS double) AS wt, CAST(2 * source_size AS double) AS cap,
         CAST(sum(source_size) OVER () AS double) * CAST(1.5 AS double) AS goal FROM w
), l AS (
  SELECT *, (goal - coalesce(sum(cap) OVER (ORDER BY cap / wt, n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), CAST(0 AS double)))
          / (sum(wt) OVER () - coalesce(sum(wt) OVER (ORDER BY cap / wt, n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), CAST(0 AS double))) AS level FROM c
), f AS (
  SELECT level FROM l WHERE level * wt < cap ORDER BY cap / wt, n LIMIT 1
), t AS (
  SELECT source, source_size, coalesce(least(cap, (SELECT level FROM f) * wt), cap) AS target FROM l
)
SELECT p.doc_id, p.size, t.source_size, t.target,
       CAST(greatest(least(CAST(floor(t.target) AS bigint) - p.at, p.size), 0)
          + greatest(least(CAST(floor(t.target) AS bigint) - t.source_size - p.at, p.size), 0) AS bigint) AS taken
FROM p JOIN t ON p.source IS NOT DISTINCT FROM t.source
"""
