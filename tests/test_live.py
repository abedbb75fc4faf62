"""The live scorer: a plain loop's numbers, models swapped between batches, bad models that stop the stream."""

import math
import tempfile
from dataclasses import asdict, replace

import pytest
from pyspark.sql.streaming import StreamingQueryException

from stresslens.operators import features
from stresslens.streaming import live

NAMES = features.feature_names(["e"])
N = len(NAMES)
BLOCK = "struct<probe_mean: double, probe_std: double, probe_range: double, probe_max_delta: double, probe_scores: map<string, double>, n_probes_ok: int>"
SCHEMA = f"id long, experts map<string, struct<ok: boolean, p_fake: double, raw_logit: double>>, probes map<string, {BLOCK}>, disagreement struct<max_abs_p_diff: double, mean_abs_p_diff: double, n_experts_ok: int>, quality struct<{', '.join(f'{q}: double' for q in features.QUALITY)}>"


def model(version, **more):
    base = {"mean": [0.1] * N, "scale": [2.0] * N, "weights": [0.03 * (i % 5 - 2) for i in range(N)], "bias": 0.2 * version, "threshold": 0.5}
    return live.Model(version=version, experts=["e"], features=NAMES, **{**base, **more})


def row(i, ok=True):
    p = 0.1 + 0.8 * (i % 7) / 7
    return (i, {"e": (ok, p, math.log(p / (1 - p)))}, {"e": (p, 0.1, 0.2, 0.15, {"a": 1 - p, "b": p}, 2)}, (None, None, 1), tuple(0.1 * j + i for j in range(8)))


def vector(i, threshold):
    _, e, b, d, q = row(i)
    ok, p, z = e["e"]
    probe = b["e"]
    pairs = [z, p, -(p * math.log(p) + (1 - p) * math.log(1 - p)), *probe[:4], float(any((v >= threshold) != (p >= threshold) for v in probe[4].values()))]
    out = [x for v in pairs for x in (v, 1.0)] + [float(probe[5]), 0.0, 0.0, 0.0, 0.0, float(d[2])]
    return out + [x for v in q for x in (v, 1.0)]


def plain(i, m, weights, bias):
    return 1 / (1 + math.exp(-(bias + sum(w * (x - a) / s for w, x, a, s in zip(weights, vector(i, m.threshold), m.mean, m.scale, strict=True)))))


@pytest.fixture
def place(spark):
    root = tempfile.mkdtemp(prefix="live-")

    def feed(ids, ok=True):
        spark.createDataFrame([row(i, ok) for i in ids], SCHEMA).coalesce(1).write.mode("append").parquet(f"{root}/in")

    def go(**more):
        stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"{root}/in")
        q = live.run(stream, f"{root}/models", f"{root}/out", f"{root}/state", ["id"], **more)
        q.awaitTermination(120)

    return root, feed, go


def test_scores_are_a_plain_loops(spark):
    m = model(3, reliability_weights=[0.01] * N, reliability_bias=-0.3, abstain_below=0.55)
    got = {r.id: r for r in live.score(spark.createDataFrame([row(i) for i in range(20)] + [row(99, False)], SCHEMA), m, ["id"]).collect()}
    for i in range(20):
        p, rel = plain(i, m, m.weights, m.bias), plain(i, m, m.reliability_weights, m.reliability_bias)
        assert math.isclose(got[i].p_fake, p, rel_tol=1e-12) and math.isclose(got[i].reliability, rel, rel_tol=1e-12) and got[i].version == 3
        assert got[i].abstain == (rel < 0.55) and got[i].decision == (None if rel < 0.55 else "fake" if p >= 0.5 else "real")
    assert {got[i].abstain for i in range(20)} == {True, False}
    assert got[99].error == "no expert answered" and got[99].p_fake is None and got[99].decision is None and got[99].reliability is None
    assert live.score(spark.createDataFrame([row(1)], SCHEMA), model(1), ["id"]).first().reliability is None


def test_models_swap_between_batches_and_each_row_has_one_version(spark, place):
    root, feed, go = place
    assert live.scored(spark, f"{root}/out", "id long").count() == 0
    live.publish(spark, f"{root}/models", model(1))
    feed(range(10))
    go()
    live.publish(spark, f"{root}/models", model(2))
    feed(range(10, 25))
    feed(range(25, 30))
    go(threshold=0.5)
    rows = live.scored(spark, f"{root}/out", "id long").collect()
    assert sorted((r.id, r.version) for r in rows) == [(i, 1 if i < 10 else 2) for i in range(30)]
    assert len({r.batch for r in rows if r.version == 2}) == 2
    assert all(math.isclose(r.p_fake, plain(r.id, model(r.version), model(r.version).weights, model(r.version).bias), rel_tol=1e-12) for r in rows)


def test_a_bad_digest_stops_the_stream_and_a_repaired_table_goes_on(spark, place):
    root, feed, go = place
    live.publish(spark, f"{root}/models", model(1))
    feed(range(5))
    go()
    body = {**asdict(model(2)), "sha256": "0" * 64}
    spark.createDataFrame([tuple(body[f.split()[0]] for f in live.MODEL.split(", "))], live.MODEL).write.mode("append").parquet(f"{root}/models")
    feed(range(5, 9))
    with pytest.raises(StreamingQueryException, match="digest differs"):
        go()
    assert live.scored(spark, f"{root}/out", "id long").count() == 5
    live.publish(spark, f"{root}/models", model(3))
    go()
    assert sorted((r.id, r.version) for r in live.scored(spark, f"{root}/out", "id long").collect()) == [(i, 1 if i < 5 else 3) for i in range(9)]


@pytest.mark.parametrize("more", [{"threshold": 1.5}, {"scale": [0.0] * N}, {"weights": [float("nan")] * N}, {"weights": [1.0]}, {"abstain_below": 0.5}, {"reliability_weights": [0.0] * N}])
def test_faulty_models_are_not_published(spark, more):
    with pytest.raises(live.ModelError):
        live.publish(spark, tempfile.mkdtemp(prefix="live-"), model(1, **more))


def test_drift_retargeting_and_two_models_of_a_version(spark):
    with pytest.raises(live.ModelError, match="drifted"):
        live.publish(spark, "/nowhere", replace(model(1), features=NAMES[::-1]))
    path = tempfile.mkdtemp(prefix="live-") + "/models"
    live.publish(spark, path, model(1))
    live.publish(spark, path, model(1))  # the same again is the same
    assert live.newest(spark, path).version == 1
    with pytest.raises(live.ModelError, match="frozen at"):
        live.newest(spark, path, 0.6)
    live.publish(spark, path, model(1, bias=9.0))
    with pytest.raises(live.ModelError, match="two digests"):
        live.newest(spark, path)
