import os

import pytest
from pyspark.sql import functions as F

from stresslens.llm.common import components, running, times

SF = "/root/testdata/sf0.001"


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 200 + i) for i in range(30)] + [(5, 5), (300, 301), (301, 300)]
    got = {x.node: x.root for x in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, 100: 100, **{200 + i: 100 for i in range(30)}, 300: 300, 301: 300}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_running_sums(spark):
    df = spark.range(500).select((F.col("id") % 3).alias("g"), "id", F.lit(2).alias("v"))
    got = running(df, ["g"], F.xxhash64("id"), ["id"], F.col("v"), "at").collect()
    for g in range(3):
        assert sorted(x["at"] for x in got if x.g == g) == list(range(0, 2 * sum(i % 3 == g for i in range(500)), 2))


def test_times(spark):
    d = spark.createDataFrame([(1, "a"), (1, "a"), (2, None), (None, "c"), (3, "d")], "doc_id long, text string")
    counts = d.distinct().select("doc_id", F.xxhash64("text").alias("th"), F.when(F.col("doc_id") == 3, 0).otherwise(2).alias("n"))
    assert sorted(map(tuple, times(d, counts).collect()), key=str) == sorted([(1, "a")] * 2 + [(2, None)] * 2 + [(None, "c")] * 2, key=str)


@pytest.mark.skipif(not os.path.exists(SF), reason="no test data here")
def test_stages(spark, tmp_path):
    import corpus_pipeline as p

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, sizes = docs.columns, [docs.count()]
    for i, (_, stage) in enumerate(p.STAGES):
        stage(spark, docs, SF).write.parquet(f"{tmp_path}/{i}")
        docs = spark.read.parquet(f"{tmp_path}/{i}")
        sizes.append(docs.count())
        assert i == len(p.STAGES) - 1 or docs.columns == columns
    assert sizes[0] > sizes[1] > sizes[2] >= sizes[3] and sizes[4] == sizes[5]
    n = [x["count"] for x in docs.groupBy("shard").count().collect()]
    assert max(n) - min(n) <= 1
    empty = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, stage in p.STAGES:
        assert stage(spark, empty, SF).count() == 0
