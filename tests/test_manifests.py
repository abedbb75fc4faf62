from pyspark.sql import functions as F

from stresslens.operators import manifests


def test_smoke_manifest(spark):
    good = [(f"s{i}", i % 2, ["real", "fully_synthetic"][i % 2], "cc0", "ab", 4, 4, "0F") for i in range(4)]
    cols = "sample_id string, label int, class_name string, license_id string, original_sha256 string, width int, height int, decoded_phash string"
    seen = spark.createDataFrame([(f"s{i}", "ab", 4, 4, "0f") for i in range(4)], "sample_id string, sha256 string, width int, height int, phash string")
    rows = spark.createDataFrame(good, cols)
    assert manifests.smoke_breaches(rows, seen, ["cc0"]).count() == 0 and manifests.unbalanced(rows).count() == 0
    bad = rows.withColumn("class_name", F.lit("real")).withColumn("license_id", F.when(F.col("label") == 0, "cc0")).withColumn("width", F.lit(5))
    found = {r.reason: (r.n, r.example) for r in manifests.smoke_breaches(bad, seen.where("sample_id <> 's3'"), ["cc0"]).collect()}
    assert found == {"class": (2, "s1"), "license": (2, "s1"), "unreadable": (1, "s3"), "sha256": (1, "s3"), "size": (4, "s0"), "phash": (1, "s3")}
    assert manifests.unbalanced(rows.where("sample_id <> 's3'")).first().zeros == 2
    assert manifests.unbalanced(rows.limit(0)).count() == 1


def test_deferred_is_capped_and_repeats(spark):
    rows = spark.range(100).select(F.col("id").alias("source_id"), (F.col("id") / 100).alias("reliability"))
    few = [r.source_id for r in manifests.deferred(rows, 0.5, 7, 3, "source_id").collect()]
    assert len(few) == 7 and max(few) < 50 and few == [r.source_id for r in manifests.deferred(rows.repartition(5), 0.5, 7, 3, "source_id").collect()]
    assert {r.source_id for r in manifests.deferred(rows, 0.5, 200, 3, "source_id").collect()} == set(range(50))


def test_equal_sets_and_ranks(spark):
    a = spark.createDataFrame([(1,), (2,), (2,), (None,)], "k int")
    assert manifests.only_in(a, a.distinct(), ["k"]).count() == 0
    assert [tuple(r) for r in manifests.only_in(a, a.where("k = 1"), ["k"]).collect()] == [("a", 2)]
    r = spark.range(1).select(manifests.ranked({"x": F.lit(0.2), "b": F.lit(0.4), "a": F.lit(0.4)}).alias("r")).first().r
    assert [x["class"] for x in r] == ["a", "b", "x"]


def test_canonical_images_that_several_rows_share(spark):
    c = spark.createDataFrame([(1, "h"), (1, "h"), (2, "h")], "source_id long, canonical_sha256 string")
    roles = spark.createDataFrame([(1,), (2,), (3,)], "source_id long")
    assert {r.reason: r.n for r in manifests.rewiring_breaches(roles, c).collect()} == {"missing": 1, "several": 1, "shared hash": 1}


def test_sealed_breaches_with_nulls_and_without_a_sort(spark):
    from stresslens.operators import manifests

    dump = spark.createDataFrame([("a", 0, 1, "x"), ("a", 1, 1, "x"), ("b", 0, 1, None), ("c", 0, 1, "x"), ("c", 1, 2, "x"), ("d", 0, 5, "x"), ("d", 0, 5, "x"), (None, 0, 1, "x"), ("f", 0, 1, "x")], "sha256 string, condition_id int, label int, split string")
    manifest = spark.createDataFrame([("a", 1, "x"), ("a", 1, "x"), ("b", 1, None), ("c", 1, "x"), ("d", 5, "x"), ("d", 6, "x"), ("e", 1, "x"), (None, 1, "x"), ("f", 1, "y")], "sha256 string, label int, split string")
    told = manifests.sealed_breaches(dump, manifest, ["label", "split"])
    assert {r.reason: r.n for r in told.collect()} == {"not in manifest": 1, "not in dump": 2, "attributes": 2, "copies differ": 1, "pair twice": 1}
    assert "SortAggregate" not in told._jdf.queryExecution().executedPlan().toString()
