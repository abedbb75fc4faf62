import random

import pytest
from pyspark.sql import functions as F

from stresslens.llm import topk


def brute(vectors, k):
    out = []
    for n, (q, v) in enumerate(vectors):
        if q is None or q % 20:
            continue
        s = sorted((-sum(a * b for a, b in zip(v, w, strict=True)), i) for m, (i, w) in enumerate(vectors) if m != n and len(w) == len(v))[:k]
        out += [(q, r + 1, i, -x) for r, (x, i) in enumerate(s)]
    return sorted(out)


def test_against_brute_force(spark):
    r = random.Random(2)
    vectors = [(i, [r.randint(-9, 9) for _ in range(6)]) for i in range(700)] + [(700 + i, [1, 2, 3, 4, 5, 6]) for i in range(300)] + [(2000, [1]), (2001, [2])]
    vectors += [(40, [9, 9, 9, 9, 9, 9]), (41, [1, 2, 3, 4, 5, 6])]  # ids that are there already
    df = spark.createDataFrame(vectors, "vec_id long, v array<long>")
    for rows, block in ((16384, 2048), (150, 20)):
        got = topk.top_k(df.withColumn("norm", F.lit("a name of ours")), "vec_id % 20 = 0", 7, rows, block)
        assert sorted((x.query_id, x["rank"], x.vec_id, x.score) for x in got.collect()) == brute(vectors, 7)


def test_quantised_leaves_out_what_is_not_a_vector(spark):
    rows = [(1, [0.5, -0.01]), (2, None), (3, [None, 1.0]), (4, [float("nan"), 1.0]), (5, [float("inf"), 1.0]), (None, [1.0, 1.0]), (6, [])]
    got = topk.quantised(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).collect()
    assert [(x.vec_id, x.v) for x in got] == [(1, [32, -1])]


def test_few_and_none(spark):
    df = spark.createDataFrame([(0, [1, 1]), (1, [2, 2])], "vec_id long, v array<long>")
    assert [(x.query_id, x["rank"], x.vec_id, x.score) for x in topk.top_k(df, "vec_id = 0", 20).collect()] == [(0, 1, 1, 4)]
    assert topk.top_k(df.limit(0), "true", 20).count() == 0
    assert topk.top_k(df.where(F.col("vec_id") == 0), "true", 20).count() == 0


def test_rows_that_share_an_id_and_large_numbers(spark):
    df = spark.createDataFrame([(0, [1]), (0, [5]), (1, [2]), (None, [2])], "vec_id long, v array<long>")
    got = sorted((x["rank"], str(x.vec_id), x.score) for x in topk.top_k(df, "vec_id = 0", 3).collect())
    assert got == sorted([(1, "0", 5), (2, "1", 2), (3, "None", 2), (1, "1", 10), (2, "None", 10), (3, "0", 5)])
    big = [(i, [(1 << 30) + 7 * i + 1, (1 << 29) - i, 3]) for i in range(60)]
    got = topk.top_k(spark.createDataFrame(big, "vec_id long, v array<long>"), "vec_id % 20 = 0", 5)
    assert sorted((x.query_id, x["rank"], x.vec_id, x.score) for x in got.collect()) == brute(big, 5)
    with pytest.raises(OverflowError):
        topk.top_k(spark.createDataFrame([(0, [1 << 40]), (1, [1 << 40])], "vec_id long, v array<long>"), "true", 1)
