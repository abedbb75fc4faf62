import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from stresslens.functions import scalars
from stresslens.operators import features, fit, grid, kernels, service


def picture(h=40, w=56, seed=1):
    r = np.random.Generator(np.random.PCG64(seed))
    y, x = np.mgrid[0:h, 0:w]
    f = np.stack([np.sin(x / 5) * 60 + 120, np.cos(y / 7) * 50 + 130, (x + y) * 2.0 % 255], 2) + r.normal(0, 4, (h, w, 3))
    return np.clip(f, 0, 255).astype(np.uint8)


def test_every_condition_on_edge_sizes():
    for h, w in ((1, 1), (3, 3), (2, 5), (40, 56)):
        x = picture(h, w)
        for name, family, p in grid.CONDITIONS:
            y = kernels.apply(x, name, "ab")
            want = (kernels.dimension(h * p), kernels.dimension(w * p), 3) if family == "crop" else (h, w, 3)
            assert y.shape == want and y.dtype == np.uint8, name
            assert np.array_equal(y, kernels.apply(x, name, "ab"))
        assert all(np.isfinite(v) for v in kernels.quality(x).values())
    for bad in (np.zeros((2, 2), np.uint8), np.zeros((2, 2, 4), np.uint8), np.zeros((2, 2, 3))):
        with pytest.raises(kernels.TransformError):
            kernels.apply(bad, "clean")
    with pytest.raises(kernels.TransformError):
        kernels.apply(picture(), "unknown")


def test_physics():
    x = picture()
    y = kernels.luma(x)
    q = kernels.quality
    assert kernels.blur_varlap(kernels.luma(kernels.apply(x, "blur_s2.0"))) < kernels.blur_varlap(kernels.luma(kernels.apply(x, "blur_s0.5"))) < kernels.blur_varlap(y)
    assert q(kernels.apply(x, "noise_s0.10", "a"))["noise_sigma"] > q(kernels.apply(x, "noise_s0.02", "a"))["noise_sigma"]
    assert q(kernels.apply(x, "jpeg_q30"))["blockiness"] > q(x)["blockiness"]
    flat = np.full((20, 20, 3), 9, np.uint8)
    assert q(flat)["blur_varlap"] == q(flat)["blockiness"] == q(flat)["noise_sigma"] == 0
    err = [np.abs(kernels.requantise(x, k).astype(int) - x).mean() for k in (90, 70, 50, 30)]
    assert err == sorted(err)
    assert np.array_equal(kernels.resize(x, *x.shape[:2]).round().astype(np.uint8), x)
    assert abs(kernels.resize(x, 20, 28).mean() - x.mean()) < 1
    assert np.array_equal(kernels.colour(x, "bright", 1.0), x) and kernels.colour(x, "saturation", 0.0).std(2).max() < 1
    assert kernels.noise_seed("ab", "c") == int(hashlib.sha256(b"ab:c").hexdigest()[:16], 16)
    a, b = (int(kernels.cosine_hash(z), 16) for z in (x, kernels.apply(x, "jpeg_q90")))
    assert bin(a ^ b).count("1") <= 16
    o = kernels.occlusion(x, lambda z: float(z[:10, :14].mean()))
    assert np.abs(o).argmax() == 0


def test_stencils_match_direct_loops():
    y = kernels.luma(picture(9, 8))
    lap = [[y[i - 1, j] + y[i + 1, j] + y[i, j - 1] + y[i, j + 1] - 4 * y[i, j] for j in range(1, 7)] for i in range(1, 8)]
    assert abs(kernels.blur_varlap(y) - np.var(lap)) < 1e-12


def test_views_scores_and_failures(spark):
    x, tiny = picture(24, 24), picture(2, 2)
    rows = [("a", 24, 24, x.tobytes(), None), ("tiny", 2, 2, tiny.tobytes(), None), ("bad", 5, 5, b"123", None), ("gone", None, None, None, "undecodable")]
    d = spark.createDataFrame(rows, "rel_path string, height int, width int, data binary, error string").withColumn("sha256", F.sha2("data", 256))
    v = kernels.views(d.join(F.broadcast(grid.conditions(spark)).where("condition_id in ('clean', 'crop_0.8')"), how="cross"))
    experts, failed = service.registry({"contrast": service.ContrastExpert, "broken": lambda: 1 / 0})
    assert list(experts) == ["contrast"] and "ZeroDivisionError" in failed["broken"]
    got = {(r.rel_path, r.condition_id): r for r in service.fuse(service.score(v, experts, "contrast"), ["contrast"], 0.5).collect()}
    assert len(got) == 8
    a = got["a", "clean"]
    assert a.decision in ("fake", "real") and a.n_experts == 1 and len(a.probes) == 3 and a.view_sha256 == hashlib.sha256(x.tobytes()).hexdigest()
    for name in ("tiny", "bad", "gone"):
        r = got[name, "clean"]
        assert r.p_fake is None and r.decision is None and r.error
    assert got["tiny", "clean"].experts["contrast"].reason_code == "too_small"
    with pytest.raises(ValueError):
        service.fuse(v, ["contrast"], 0.5, "magic")
    with pytest.raises(RuntimeError):
        service.registry({"broken": lambda: 1 / 0})
    assert service.parity(v.select("rel_path", "condition_id", "height"), v.select("rel_path", "condition_id", "height"), ["rel_path", "condition_id"], "height", 0).first().ok


def test_scalars(spark):
    d = spark.createDataFrame([(0.0,), (0.5,), (1.0,), (1.5,), (float("nan"),), (None,)], "p double")
    got = [r.h for r in d.select(scalars.entropy(F.col("p")).alias("h")).collect()]
    assert got[0] == got[2] == 0 and abs(got[1] - np.log(2)) < 1e-12 and got[3:] == [None, None, None]
    assert [tuple(r) for r in d.select(*[c.alias(n) for c, n in zip(scalars.pair(F.col("p")), "vn", strict=True)]).collect()][3:] == [(1.5, 1.0), (0.0, 0.0), (0.0, 0.0)]
    s = spark.createDataFrame([(-800.0,), (0.0,), (800.0,)], "x double").select(scalars.sigmoid(F.col("x")).alias("s"))
    assert [r.s for r in s.collect()] == [0.0, 0.5, 1.0]
    assert d.select(scalars.hash_bits(F.lit("f" * 16)).alias("h")).first().h == -1
    assert d.select(scalars.container(F.lit(b"\xff\xd8\xff\xe0")).alias("c")).first().c == "JPEG"
    assert d.select(scalars.sample_id("smoke", F.lit(7)).alias("c")).first().c == "smoke-000007"


#: Fixed value: the names of a vector of one expert.
EXPECTED = [
    *[f"e.{n}{p}" for n in ("raw_logit", "p_fake", "entropy", "probe_mean", "probe_std", "probe_range", "probe_max_delta", "probe_flip") for p in ("", "__present")],
    "e.n_probes_ok",
    "disagreement.max_abs_p_diff", "disagreement.max_abs_p_diff__present", "disagreement.mean_abs_p_diff", "disagreement.mean_abs_p_diff__present", "disagreement.n_experts_ok",
    *[f"quality.{n}{p}" for n in ("blur_varlap", "blockiness", "noise_sigma", "luminance_mean", "luminance_std", "saturation_mean", "clipped_low_frac", "clipped_high_frac") for p in ("", "__present")],
]


def test_vector_and_fusion(spark):
    assert features.feature_names(["e"]) == EXPECTED and len(features.feature_names(["e", "f"])) == 38 + 17
    block = lambda ok, p, z: {"e": (ok, p, z)}
    probe = lambda scores, n: {"e": (0.5, 0.1, float("nan"), None, scores, n)}
    image = tuple([None, *[0.25] * 7])
    rows = [
        (1, block(True, 0.5, 2.0), probe({"a": 0.4, "b": 0.9}, 2), (0.3, 0.2, 2), image),
        (2, block(True, 1.0, float("inf")), probe({"a": 0.7}, 1), None, image),
        (3, block(False, 0.5, 2.0), probe({"a": 0.4}, 1), None, None),
        (4, {}, None, None, None),
        (5, block(True, None, None), probe({}, None), None, image),
    ]
    schema = f"i int, experts map<string, struct<ok: boolean, p_fake: double, raw_logit: double>>, probes map<string, struct<{', '.join(n + ': double' for n in features.PROBE)}, probe_scores: map<string, double>, n_probes_ok: int>>, disagreement struct<max_abs_p_diff: double, mean_abs_p_diff: double, n_experts_ok: int>, quality struct<{', '.join(n + ': double' for n in features.QUALITY)}>"
    d = spark.createDataFrame(rows, schema)
    got = {r.i: dict(zip(EXPECTED, r.v, strict=True)) for r in d.select("i", features.feature_vector(["e"], 0.5).alias("v")).collect()}
    at = got[1]
    assert (at["e.raw_logit"], at["e.p_fake__present"], at["e.probe_flip"], at["e.n_probes_ok"], at["disagreement.max_abs_p_diff"], at["disagreement.n_experts_ok"]) == (2, 1, 1, 2, 0.3, 2)
    assert abs(at["e.entropy"] - np.log(2)) < 1e-12 and at["e.probe_range__present"] == at["e.probe_max_delta__present"] == at["quality.blur_varlap__present"] == 0 and at["quality.blockiness"] == 0.25
    assert (got[2]["e.raw_logit__present"], got[2]["e.entropy"], got[2]["e.entropy__present"], got[2]["e.probe_flip"], got[2]["e.probe_flip__present"], got[2]["disagreement.mean_abs_p_diff__present"]) == (0, 0, 1, 0, 1, 0)
    assert got[3]["e.p_fake__present"] == got[3]["e.entropy__present"] == got[3]["e.probe_flip__present"] == 0 and got[3]["e.probe_mean"] == 0.5 and got[3]["quality.blockiness__present"] == 0
    assert set(got[4].values()) == {0.0} and got[5]["e.probe_flip__present"] == got[5]["e.n_probes_ok"] == 0
    assert features.quality_places(["e"]) == list(range(22, 38))
    q = d.select("i", features.quality_only(features.feature_vector(["e"], 0.5), ["e"], [1.0] * 16, -2.0).alias("q")).where("i = 3").first().q
    assert abs(q - 1 / (1 + np.exp(2))) < 1e-12
    logits, none, both = F.array(F.lit(2.0), F.lit(-1.0)), F.array(F.lit(False), F.lit(False)), F.array(F.lit(True), F.lit(True))
    r = spark.range(1).select(features.static_average(logits, none).alias("a"), features.probability_mean(logits, none).alias("b"), features.fixed_weights(logits, none, [1, 1]).alias("c"), scalars.fused_weights(logits, none).alias("d"), features.fixed_weights(logits, F.array(F.lit(True), F.lit(False)), [0.2, 0.8]).alias("e"), features.static_average(logits, both).alias("f")).first()
    assert r.a is None and r.b == 0.5 and r.c is None and r.d == [0.0, 0.0] and abs(r.e - 1 / (1 + np.exp(-2))) < 1e-12 and abs(r.f - 1 / (1 + np.exp(-0.5))) < 1e-12
    assert len(features.simplex(3)) == 66


def test_logistic_matches_gradient(spark):
    r = np.random.Generator(np.random.PCG64(2))
    x = r.normal(size=(300, 2))
    y = (r.random(300) < 1 / (1 + np.exp(-(x[:, 0] - 0.5 * x[:, 1] + 0.2)))).astype(int)
    d = spark.createDataFrame([(float(a), float(b), int(c)) for (a, b), c in zip(x, y, strict=True)], "a double, b double, label int")
    m = fit.logistic(d, ["a", "b"])
    q = 1 / (1 + np.exp(-(x @ m.weights + m.bias)))
    assert np.abs(x.T @ (q - y) + m.weights).max() < 1e-5 and abs((q - y).sum()) < 1e-5
    t, b = fit.temperature(d.withColumn("raw", F.col("a") * 3), "raw")
    assert t > 0 and np.isfinite(b)


def test_networks(tmp_path):
    r = np.random.Generator(np.random.PCG64(3))
    x = r.normal(size=(200, 38))
    y = (x[:, 0] + x[:, 1] * x[:, 2] > 0).astype(float)
    n = fit.Network([38, 32, 16, 3])
    assert n.parameters == 38 * 32 + 32 + 32 * 16 + 16 + 16 * 3 + 3 == 1827
    for activation, loss, sizes in (("gelu", fit.worst_group(y, np.arange(200) % 3), [38, 6, 3]), ("relu", fit.class_loss(np.arange(200) % 4, 4), [38, 6, 4])):
        m = fit.Network(sizes, activation)
        out, inputs, sums = m.forward(x)
        g = m.gradient(x, loss(out)[1], inputs, sums)
        for i, j in ((0, 3), (5, 2)):  # slopes against small steps
            m.w[0][i, j] += 1e-5
            up = loss(m(x))[0]
            m.w[0][i, j] -= 2e-5
            down = loss(m(x))[0]
            m.w[0][i, j] += 1e-5
            assert abs((up - down) / 2e-5 - g[0][i, j]) < 1e-5
    history = n.train(x, fit.worst_group(y, np.zeros(200)), rounds=60)
    assert history[-1] < history[0] / 2
    before = n(x).copy()
    w = [v.copy() for v in n.w[:2]]
    n.train(x, fit.worst_group(y, np.zeros(200)), rounds=3, only={2})
    assert all(np.array_equal(a, b) for a, b in zip(w, n.w[:2], strict=True)) and not np.array_equal(before, n(x))
    path = str(tmp_path / "c.json")
    fit.save(path, n, ["a", "b"], 0.4)
    again, t = fit.load(path, ["a", "b"])
    assert t == 0.4 and np.array_equal(again(x), n(x))
    with pytest.raises(ValueError):
        fit.load(path, ["b", "a"])
    assert fit.ladder({"base": 0.5, "a": 0.51}, "base") == "base" and fit.ladder({"base": 0.5, "a": 0.53, "b": 0.53}, "base") == "a"
    assert fit.Network([16, 32, 7], "relu").parameters == 775


def test_view_query_deals_its_rasters(spark):
    """However few files and row groups the rasters come in, a task makes the views of some of them only."""
    from stresslens.operators import grid, kernels
    from stresslens.plans import catalogue

    assert grid.dealt(spark.range(1000), "id", kernels.TASK).rdd.getNumPartitions() == 8
    plan = catalogue.queries()["d09_views"](spark, "/root/testdata/sf0.01")._jdf.queryExecution().optimizedPlan().toString()
    assert "RepartitionByExpression" in plan
