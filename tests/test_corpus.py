import random

import pytest
from pyspark.sql import functions as F

from stresslens.operators import audit, dedup, shared
from stresslens.streaming import incremental


def hashes(spark, seed=5):
    r = random.Random(seed)
    hs = [r.getrandbits(64) for _ in range(20)]
    for _ in range(60):
        hs.append(r.choice(hs) ^ sum(1 << b for b in r.sample(range(64), r.randint(0, 7))))
    data = list(enumerate(hs))
    return data, spark.createDataFrame([(i, h - (1 << 64) if h >> 63 else h) for i, h in data], "id long, h long")


def test_near_pairs_and_clusters(spark):
    data, d = hashes(spark)
    for radius in (0, 4, 6):
        want = {(a, b): n for a, x in data for b, y in data if a < b and (n := bin(x ^ y).count("1")) <= radius}
        for crowd in (4096, 5, 0):
            got = dedup.near_pairs(d, None, radius, crowd).collect()
            assert {(r.id_a, r.id_b): r.distance for r in got} == want and len(got) == len(want)
    parent = {i: i for i, _ in data}

    def find(i):
        return i if parent[i] == i else find(parent[i])

    for a, b in want:
        x, y = sorted((find(a), find(b)))
        parent[y] = x
    got = {r.id: r.cluster for r in dedup.clusters(d.select("id"), dedup.near_pairs(d, None, 6)).collect()}
    assert got == {i: find(i) for i, _ in data}


def test_copies_are_one_class(spark):
    data, d = hashes(spark)
    d = d.unionByName(d.select((F.col("id") + 100).alias("id"), "h")).unionByName(d.limit(1).select(F.lit(500).cast("long").alias("id"), F.lit(None).cast("long").alias("h")))
    first = {}
    for i, h in data:
        first.setdefault(h, i)
    members, pairs = dedup.near_classes(d, 6, 3)
    assert {(r.id, r["class"]) for r in members.collect()} == {(i + k, first[h]) for i, h in data for k in (0, 100)}
    reps = sorted((i, h) for h, i in first.items())
    assert {(r.id_a, r.id_b) for r in pairs.collect()} == {(a, b) for a, x in reps for b, y in reps if a < b and bin(x ^ y).count("1") <= 6}
    got = {r.id: r.cluster for r in dedup.near_clusters(d, 6).collect()}
    assert len(got) == 2 * len(data) and all(got[i] == got[i + 100] <= i for i, _ in data)


def test_contamination(spark):
    data, d = hashes(spark)
    d = d.withColumn("sha256", F.sha2(F.col("h").cast("string"), 256))
    c = dedup.contamination(d.where("id < 40"), d.where("id >= 40"), 6).first()
    want = [(a, bin(x ^ y).count("1")) for a, x in data if a < 40 for b, y in data if b >= 40 and bin(x ^ y).count("1") <= 6]
    assert (c.perceptual, c.least_distance) == (len({a for a, _ in want}), min(n for _, n in want))


def test_splits_hold_together(spark):
    d = spark.range(100).select(F.col("id"), (F.col("id") % 3).alias("lang"), F.md5(F.col("id").cast("string")).alias("h"))
    n = {(r.lang, r.role): r["count"] for r in dedup.hash_split(d, "lang", "h", 0.25).groupBy("lang", "role").count().collect()}
    assert n[0, "dev"] == 8 and n[1, "dev"] == 8 and n[0, "train"] == 26
    f = dedup.folds(spark.range(23).unionByName(spark.range(23)), "id", 5, "s").groupBy("fold").count().collect()
    assert sorted(r["count"] for r in f) == [4, 4, 5, 5, 5]


def one_by_one(sizes, quotas):
    """Each cluster, largest first, to the first role that it still fits."""
    left, out = {role: dict(q) for role, q in quotas.items()}, {}
    for cluster, label, size in sorted(sizes, key=lambda x: (-x[2], x[0])):
        role = next((r for r, q in left.items() if q.get(label, 0) >= size), "spare")
        if role != "spare":
            left[role][label] -= size
        out[cluster] = role
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_roles_equal_the_sequential_fill(spark, seed):
    r = random.Random(seed)
    sizes = [(i, r.randint(0, 1), r.choice([1, 1, 1, 2, 3, 7, 20])) for i in range(300)]
    quotas = {"test": {0: 101, 1: 55}, "dev": {0: 33, 1: 0}, "train": {0: 150}}
    d = spark.createDataFrame(sizes, "cluster long, label int, n long").repartition(5)
    got = {x.cluster: x.role for x in dedup.assign_roles(d, quotas).collect()}
    assert got == one_by_one(sizes, quotas) and set(got.values()) == {"test", "dev", "train", "spare"}
    for role in quotas:
        for y in (0, 1):
            assert sum(s for c, label, s in sizes if label == y and got[c] == role) <= quotas[role].get(y, 0)
    assert dedup.assign_roles(d.limit(0), quotas).count() == 0


def test_leaks(spark):
    d = spark.createDataFrame([(1, "a"), (1, "a"), (2, "a"), (2, "b"), (3, None)], "cluster long, role string")
    assert {x.cluster for x in dedup.leaks(d).collect()} == {2, 3}


def test_ranks_within_groups_and_over_all(spark):
    r = random.Random(3)
    rows = [(i, r.choice(["hot", "hot", "hot", "b", None]), r.randint(0, 9)) for i in range(400)]
    d = spark.createDataFrame(rows, "i long, g string, v int").repartition(7)
    got = {x.i: (x["rank"], x.n) for x in shared.ranked(d, [F.col("v"), F.col("i")], ["g"], n="n").collect()}
    for g in ("hot", "b", None):
        own = sorted((v, i) for i, h, v in rows if h == g)
        assert [got[i] for _, i in own] == [(k, len(own)) for k in range(len(own))]
    got = {x.i: x["rank"] for x in shared.ranked(d, [F.desc("v"), F.col("i")]).collect()}
    assert [got[i] for _, i in sorted((-v, i) for i, _, v in rows)] == list(range(400))
    assert shared.ranked(d.limit(0), [F.col("i")], ["g"]).count() == 0


def test_first_of_each(spark):
    d = spark.createDataFrame([(i, i % 3) for i in range(50)], "i long, g int").repartition(4)
    assert {(x.g, x.i) for x in dedup.first_of_each(d, "g", [F.desc("i")], 2).collect()} == {(0, 48), (0, 45), (1, 49), (1, 46), (2, 47), (2, 44)}


def test_audits(spark):
    d = spark.createDataFrame([(i, float(i % 7), 1.0) for i in range(50)], "i long, a double, b double")
    assert audit.correlations(d, ["a", "b"]).first().r is None
    h = {r.low: r.n for r in audit.histogram(d.select(F.col("i").cast("int").alias("x")), "x", [0, 10, 45, 90]).collect()}
    assert h == {0: 10, 10: 35, 45: 5, 90: 0}
    assert {r.share: r.value for r in audit.index_percentiles(d, "i", (0.0, 0.5, 1.0)).collect()} == {0.0: 0, 0.5: 24, 1.0: 49}
    m = audit.confusion_matrix(spark.createDataFrame([("x", "x"), ("x", "y"), ("y", "y")], "t string, g string"), "t", "g", ["x", "y"]).orderBy("truth").collect()
    assert [(r.x, r.y, r.recall) for r in m] == [(1, 1, 0.5), (0, 1, 1.0)]


def test_stream_counts_each_key_once(spark, tmp_path):
    data = [(i % 30, "2024-01-01 00:%02d:00" % (i % 50), i % 2, (i % 10) / 10) for i in range(30)] + [(1, "2024-01-01 00:01:00", 1, 0.1)]
    d = spark.createDataFrame(data, "k long, t string, label int, p double").withColumn("ts", F.to_timestamp("t"))
    d.coalesce(1).write.parquet(str(tmp_path / "in"))
    s = spark.readStream.schema(d.schema).parquet(str(tmp_path / "in"))
    q = incremental.once(s, ["k"]).writeStream.format("memory").queryName("once_out").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert spark.table("once_out").count() == 30
    q = incremental.append_batches(s.select("k", "p"), str(tmp_path / "out"), ["k"], str(tmp_path / "cp"))
    q.awaitTermination(60)
    assert spark.read.parquet(str(tmp_path / "out")).select("k").distinct().count() == 30


def test_hashes_are_worked_out_once(spark):
    """What near_classes() gives reads hashes that were written, not the texts again."""
    from stresslens.operators import dedup
    from stresslens.plans import corpus_queries

    for d in dedup.near_classes(corpus_queries.text_hashes(spark, "/root/testdata/sf0.001"), corpus_queries.RADIUS):
        assert "documents.parquet" not in d._jdf.queryExecution().executedPlan().toString()
