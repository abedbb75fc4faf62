"""The queries of this subpackage, by name, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stresslens.llm.common import cut, table


def op1_privacy(spark: SparkSession, sf_dir: str) -> DataFrame:
    from stresslens.llm import privacy

    return privacy.report(table(spark, sf_dir, "documents"))


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from stresslens.llm import decontaminate

    return decontaminate.matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("th")


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from stresslens.llm import quality

    return quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from stresslens.llm import sharding

    d = sharding.shard(table(spark, sf_dir, "documents"), 40)
    return d.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op5_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    from stresslens.llm import topk

    return topk.top_k(topk.quantised(table(spark, sf_dir, "embeddings")), "vec_id % 20 = 0", 20)


def op6_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents have no paths: each source is a tree of directories of a thousand and of ten ids."""
    from stresslens.llm import licenses

    d = table(spark, sf_dir, "documents")
    path = F.concat_ws("/", F.coalesce("source", F.lit("")), *[F.floor(F.col("doc_id") / n).cast("string") for n in (1000, 10)], F.col("doc_id").cast("string"))
    r = licenses.scan(d.select(F.col("doc_id").alias("id"), path.alias("path"), "text"))
    return r.withColumnRenamed("id", "doc_id")


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from stresslens.llm import simhash

    g = simhash.groups(table(spark, sf_dir, "documents"))
    return g.select("doc_id", simhash.as_hex(F.col("fp")).alias("fingerprint"), "component_id")


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """taken is what the blocks dealt to forty shards hold; shards themselves have no column here, as SQL can't draw them."""
    from stresslens.llm import mixing

    mixed = cut(mixing.mix(table(spark, sf_dir, "documents")))
    return mixing.drawn(mixed, mixing.deal(mixed, 40)).select("doc_id", "size", "source_size", "target", "taken")


def op9_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    from stresslens.llm import language

    return language.identify(table(spark, sf_dir, "documents"))


def op10_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    from stresslens.llm.repeats import remove_repeats

    return remove_repeats(table(spark, sf_dir, "documents"))


def op11_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    from stresslens.llm import pointintime

    return pointintime.label_features(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op12_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from stresslens.llm import packing

    p = packing.pack_texts(table(spark, sf_dir, "documents"))
    return p.select(F.col("of").alias("doc_id"), "start", "length", "ids_crc32", F.col("tokens").alias("doc_tokens"), "sequence_id", "offset")


def op13_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    from stresslens.llm import alignment

    return alignment.align(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: f for k, f in globals().items() if k.startswith("op") and callable(f)}


def oracle_sql() -> dict[str, str]:
    from stresslens.llm import mixing, pointintime

    return {"op8_mixing": mixing.MIX_SQL, "op11_features": pointintime.LABELS_SQL}
