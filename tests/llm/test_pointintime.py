import hashlib
import random

from pyspark.sql import functions as F

from stresslens.llm import pointintime


def brute(asks, versions):
    """For each (key, at) the best (start, end, p, n) of its key that holds."""
    out = []
    for key, at in asks:
        holding = [v for v in versions if key is not None and at is not None and v[0] == key and None not in v[1:3] and v[1] <= at < v[2]]
        out.append((key, at, max(holding, key=lambda v: (v[3] is not None, v[3], v[4]), default=None)))
    return sorted(out, key=repr)


def got(df):
    return sorted(((r.ask["key"], r.ask["at"], tuple(r.won) if r.won else None) for r in df.collect()), key=repr)


def frames(spark, asks, versions):
    v = spark.createDataFrame(versions, "key string, start long, end long, p long, n long")
    return spark.createDataFrame(asks, "key string, at long"), v


def test_against_all_pairs(spark):
    r = random.Random(5)
    keys = ["hot"] * 6 + ["a", "b", "c", "cold", None]
    versions = [(r.choice(keys), s := r.randint(-300, 900), s + r.randint(-5, 200), r.choice([None, 1, 2, 3]), i) for i in range(1500)]
    asks = [(r.choice(keys), r.randint(-400, 1200)) for _ in range(700)]
    a, v = frames(spark, asks, versions)
    want = brute(asks, versions)
    assert sum(x[2] is not None for x in want) > 300
    for seconds, parts in ((64, 1), (256, 7), (4096, 3)):
        assert got(pointintime.as_of(a.repartition(parts), v.repartition(parts), "key", "at", "start", "end", ["p", "n"], seconds)) == want


def test_small_batches_carry_a_chunk_on(spark):
    r = random.Random(6)
    versions = [("k", s := r.randint(0, 240), s + r.randint(1, 40), r.randint(0, 9), i) for i in range(200)]
    asks = [("k", t) for t in range(256)] * 2
    a, v = frames(spark, asks, versions)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        assert got(pointintime.as_of(a, v, "key", "at", "start", "end", ["p", "n"])) == brute(asks, versions)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_ties_repeats_nulls_and_empty(spark):
    versions = [("k", 0, 10, 1, 1), ("k", 0, 10, 1, 1), ("k", 0, 10, 1, 2), ("k", 5, 5, 9, 9), ("k", None, 10, 9, 9), ("k", 3, None, 9, 9), (None, 0, 10, 9, 9), ("k", 9, 12, None, 7)]
    asks = [("k", 0), ("k", 0), ("k", 9), ("k", 10), ("k", 12), (None, 3), ("k", None), ("other", 3)]
    a, v = frames(spark, asks, versions)
    assert got(pointintime.as_of(a, v, "key", "at", "start", "end", ["p"])) == brute(asks, versions)
    assert got(pointintime.as_of(a, v.limit(0), "key", "at", "start", "end", ["p"])) == brute(asks, [])
    assert pointintime.as_of(a.limit(0), v, "key", "at", "start", "end", ["p"]).count() == 0


def test_columns_of_any_name(spark):
    a = spark.createDataFrame([("k", 3, "x")], ["k", "won", "c`s.e"])
    v = spark.createDataFrame([("k", 0, 9, 1, "y")], ["k", "s", "e", "o0", "kind"])
    r = pointintime.as_of(a, v, "k", "won", "s", "e", ["o0"]).first()
    assert r.ask["c`s.e"] == "x" and r.won["kind"] == "y"


def parts(i):
    h = hashlib.sha256(str(i).encode()).hexdigest()
    return [int(h[8 * k : 8 * k + 8], 16) for k in range(4)]


def label_brute(documents, labels):
    source = {}
    for i, s, *_ in documents:
        if s is not None and i is not None:
            source[i] = min(s, source.get(i, s))
    out = []
    for (i,) in labels:
        t, best = None if i is None else parts(i)[3] % 50000, None
        for j, s, n, lang in documents:
            if i is None or j is None or s is None or source.get(i) != s:
                continue
            a, b, c, _ = parts(j)
            event = a % 50000
            arrival = event - 60 + b % 600
            if event <= t and arrival <= t < event + c % 900:
                best = max(best or (event, arrival, j, n, lang), (event, arrival, j, n, lang))
        age = best and t - best[0]
        fresh = best is not None and age <= 120
        out.append((i, t, best and best[2], age, "none" if best is None else "fresh" if fresh else "stale", best[3] if fresh else None, best[4] if fresh else None))
    return sorted(out, key=repr)


def test_labels_against_all_pairs(spark):
    r = random.Random(7)
    documents = [(i, r.choice(["hot", "hot", "b", None]), r.randint(0, 99), r.choice(["en", "fr"])) for i in range(3000)] + [(None, "hot", 1, "en")]
    labels = [(i,) for i in range(0, 3200, 8)] + [(0,), (None,)]
    d = spark.createDataFrame(documents, "doc_id long, source string, n_chars long, lang string").withColumn("event", F.lit("clash")).withColumn("k", F.lit(0))
    rows = pointintime.label_features(d, spark.createDataFrame(labels, "doc_id long").withColumn("source", F.lit("clash"))).collect()
    want = label_brute(documents, labels)
    assert sorted((tuple(x) for x in rows), key=repr) == want
    assert {x[4] for x in want} == {"none", "fresh", "stale"}
