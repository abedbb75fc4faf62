"""A corpus from raw documents to shards: quality, near duplicates, benchmark passages, source weights, shards."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stresslens.llm import decontaminate, mixing, quality, sharding, similar
from stresslens.llm.common import checkpoint_dir, cut, fresh, kept, table, times
from stresslens.llm.texts import held_out

#: Output shards of the mix and of the last stage.
SHARDS = 40


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go."""
    labels = table(spark, sf_dir, "labels")
    return quality.keep(docs, quality.train(docs, labels.where(~held_out(F.col("doc_id")))))


def dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates (five-word shingles, similarity 0.8 or more) the document with the smallest id stays."""
    return times(docs, similar.representatives(docs).withColumn("n", F.lit(1)))


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go; a row given twice goes or stays as one."""
    x = fresh(docs)
    found = decontaminate.matches(docs, table(spark, sf_dir, "benchmark")).select(F.struct("doc_id", "th").alias(f"{x}bad")).distinct()
    same = F.struct(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("th")).eqNullSafe(F.col(f"{x}bad"))
    return docs.join(found, same, "left_anti")


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix as dealt to the shards: each document as often as the mix takes it, to the nearest whole document.

    Rows are laid down shard by shard, in a shard's local shuffle. Null and blank texts have no words and go; of a row
    given twice each counts.
    """
    x = fresh(docs)
    dealt = mixing.deal(cut(mixing.mix(docs)), SHARDS).where("whole")
    place = F.struct(F.col("shard").alias(f"{x}shard"), F.col("slot").alias(f"{x}slot"))
    places = dealt.groupBy("doc_id", "th").agg(F.collect_list(place).alias(f"{x}places"))
    rows = times(docs, places.withColumn("n", F.lit(1)), carry=(f"{x}places",)).select(*kept(docs), F.inline(f"{x}places"))
    return rows.repartition(f"{x}shard").sortWithinPartitions(f"{x}shard", f"{x}slot").select(*kept(docs))


def sharding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each row goes: doc_id, size, text_crc32, shard, slot."""
    return sharding.shard(docs, SHARDS)


STAGES = [
    ("quality classifier", quality_stage),
    ("near duplicates", dedup_stage),
    ("benchmark decontamination", decontamination_stage),
    ("mixing", mixing_stage),
    ("sharding", sharding_stage),
]

#: SQL can express neither the classifier nor the groups.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; what a stage keeps is written to the shared folder and read again by the next."""
    docs, folder = table(spark, sf_dir, "documents"), f"{checkpoint_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for i, (_, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        if i == len(STAGES) - 1:
            return out
        out.write.parquet(f"{folder}/{i}")
        docs = spark.read.parquet(f"{folder}/{i}")
    return docs
