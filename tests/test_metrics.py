import random

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from stresslens.operators import grid, metrics, operating, pairs, resample


def rows(spark, y, p, **more):
    return spark.createDataFrame([("m", i, a, float(b)) for i, (a, b) in enumerate(zip(y, p, strict=True))], "method_id string, source_id long, label int, p double").withColumns({k: F.lit(v) for k, v in more.items()})


def test_confusion_is_inclusive(spark):
    r = metrics.confusion(rows(spark, [0, 0, 1, 1], [0.1, 0.5, 0.5, 0.9]), ["method_id"])
    assert r.first().asDict() == {"method_id": "m", "tp": 2, "fn": 0, "fp": 1, "tn": 1}
    assert r.select(*metrics.rates()).first().asDict() == {"recall": 1.0, "tnr": 0.5, "fpr": 0.5, "balanced_accuracy": 0.75}


def test_known_ranking_values(spark):
    r = rows(spark, [0, 0, 1, 1], [0.1, 0.4, 0.35, 0.8])
    assert metrics.auroc(r, ["method_id"]).first().auroc == 0.75
    assert metrics.average_precision(r, ["method_id"]).first().average_precision == round(5 / 6, 6)
    for y in ([0, 1], [1, 0]):
        t = rows(spark, y, [0.5, 0.5])
        assert metrics.auroc(t, ["method_id"]).first().auroc == 0.5 and metrics.average_precision(t, ["method_id"]).first().average_precision == 0.5
    assert metrics.calibration_error(rows(spark, [0, 1], [0.1, 0.8]), ["method_id"], bins=2).first().ece == 0.15
    assert metrics.auroc(rows(spark, [1, 1], [0.1, 0.2]), ["method_id"]).first().auroc is None


def test_auroc_against_all_pairs_in_any_order_and_weighted(spark):
    r = random.Random(7)
    y, p, w = [r.randint(0, 1) for _ in range(200)], [r.randint(0, 9) / 10 for _ in range(200)], [r.randint(1, 4) for _ in range(200)]
    pairs_ = lambda weight: (
        sum((a > b) * u * v + (a == b) * u * v / 2 for a, i, u in zip(p, y, weight, strict=True) if i for b, j, v in zip(p, y, weight, strict=True) if not j),
        sum(u for i, u in zip(y, weight, strict=True) if i) * sum(u for i, u in zip(y, weight, strict=True) if not i),
    )
    d = spark.createDataFrame([("m", a, b, c) for a, b, c in zip(y, p, w, strict=True)], "method_id string, label int, p double, w int")
    a, n = pairs_([1] * 200)
    for k in (1, 7):
        assert metrics.auroc(d.repartition(k), ["method_id"]).first().auroc == round(a / n, 6)
    a, n = pairs_(w)
    assert metrics.auroc(d, ["method_id"], weight="w").first().auroc == round(a / n, 6)
    assert metrics.auroc(d.withColumn("w", F.explode(F.sequence(F.lit(1), "w"))), ["method_id"]).first().auroc == round(a / n, 6)


def test_flips(spark):
    r = rows(spark, [0, 0, 1, 1], [0.9, 0.1, 0.1, 0.9], condition_id="jpeg_q30")
    clean = rows(spark, [0, 0, 1, 1], [0.1, 0.9, 0.9, 0.1], condition_id="clean")
    f = pairs.flips(pairs.with_clean(r.unionByName(clean)).where("condition_id <> 'clean'"), ["method_id"]).first()
    assert (f.flip_rate, f.fake_to_real, f.real_to_fake) == (1.0, 0.5, 0.5)
    c = pairs.conditional_flips(r.unionByName(clean), ["method_id"]).first()
    assert (c.n, c.fake_to_real, c.real_to_fake) == (2, 1.0, 1.0)
    assert pairs.without_clean(r).count() == 4


def test_worst_falls_to_the_first_name(spark):
    d = spark.createDataFrame([("m", "jpeg_q30", 0.5), ("m", "blur_s2.0", 0.5), ("m", "clean", 0.1)], "method_id string, condition_id string, recall double")
    assert metrics.worst(d, ["method_id"], "condition_id").first().worst_condition_id == "blur_s2.0"


def test_family_is_derived(spark):
    d = spark.createDataFrame([("jpeg_q30", "a lie")], "condition_id string, family string")
    assert grid.with_family(d).first().family == "jpeg"
    assert grid.expand(spark.range(3)).count() == 60 and len(grid.CONDITIONS) == 20


def test_grades_and_rules(spark):
    d = spark.createDataFrame([("m", 1, 1, 20, 0.9), ("m", 2, 1, 18, 0.1), ("m", 3, 0, 14, 0.9), ("m", 4, 0, 0, 0.1)], "method_id string, source_id long, label int, retained int, clean_p double")
    assert [r.grade for r in pairs.graded(d).orderBy("source_id").collect()] == ["HIGH", "MEDIUM", "VERY LOW", "VERY LOW"]
    part = spark.createDataFrame([(1, 9, 10), (2, 10, 10), (3, 0, 0)], "source_id long, retained int, scored int")
    assert [(r.grade, r.measured_accuracy) for r in pairs.graded(part).orderBy("source_id").collect()] == [("MEDIUM", 0.949), ("HIGH", 0.991), ("UNKNOWN", None)]
    r = {x.below: x for x in pairs.flag_rules(d, (20, 15)).collect()}
    assert (r[20].flagged, r[20].catch_share, r[20].precision) == (3, 1.0, round(2 / 3, 6)) and (r[15].flagged, r[15].catch_share) == (2, 0.5)


def test_thresholds(spark):
    neg = rows(spark, [0] * 10 + [1] * 2, [i / 10 for i in range(10)] + [0.95, 0.2], condition_id="clean")
    t = operating.fpr_matched(neg, 0.2).first()
    assert (t.k, t.threshold, t.realised_fpr, t.above_all) == (2, 0.8, 0.2, False)
    assert operating.fpr_matched(neg, 0.01).first().above_all
    tied = rows(spark, [0] * 4, [0.5, 0.5, 0.5, 0.1], condition_id="clean")
    assert operating.fpr_matched(tied, 0.25).first().realised_fpr == 0.75
    assert operating.best_accuracy(rows(spark, [0, 0, 1, 1], [0.1, 0.4, 0.6, 0.9]), ["method_id"]).first().threshold == 0.6


def test_selective_risk_against_sorting(spark):
    r = random.Random(3)
    data = [("m", i, r.randint(0, 1), r.random(), r.randint(0, 5) / 5, 0) for i in range(101)]
    d = spark.createDataFrame(data, "method_id string, source_id long, label int, p double, reliability double, idx int")
    order = sorted(data, key=lambda x: (-x[4], x[1]))
    for x in operating.selective_risk(d, (1.0, 0.75, 0.5, 0.001)).collect():
        k = max(1, round(x.coverage * 101))
        assert x.k == k and x.accuracy == round(sum((a[3] >= 0.5) == (a[2] == 1) for a in order[:k]) / k, 6)


def times_of(rows, replicates, seed, size):
    """(replicate, source) -> draws, by the draws' SQL in another engine."""
    con = duckdb.connect()
    con.register("given_rows", pa.table({"source_id": [r[0] for r in rows], "label": pa.array([r[1] for r in rows], pa.int32())}))
    return {(r, s): n for s, r, n in con.sql(f"WITH {resample.draws_sql('SELECT * FROM given_rows', replicates, seed, size)} SELECT source_id, replicate, times FROM dr").fetchall()}


@pytest.mark.parametrize("size", [1 << 14, 16])
def test_bootstrap_draws_each_class_to_its_size(spark, size):
    """Draws of a class sum to its size in each replicate, are the same for all methods, multinomial, and equal another engine's."""
    sources = [(i, int(i % 3 == 0)) for i in range(150)]
    s = spark.createDataFrame([(m, i, y, i, 1) for i, y in sources for m in ("a", "b")], "method_id string, source_id long, label int, n long, one int").repartition(3)
    d = resample.resampled(s, ["method_id", "n"], ["one"], 40, 7, size=size).collect()
    got = {m: {(r.replicate, r.n): r.one for r in d if r.method_id == m and r.one} for m in ("a", "b")}
    assert got["a"] == got["b"] == times_of(sources, 40, 7, size)
    for replicate in range(40):
        for y, n in ((0, 100), (1, 50)):
            assert sum(got["a"].get((replicate, i), 0) for i, label in sources if label == y) == n
    # a draw count has variance 1 - 1/n, and two of a class the covariance -1/n
    squares = sum(x**2 for x in got["a"].values()) / (150 * 40)
    assert abs(squares - 2) < 0.1 and len(set(got["a"].items())) > 3000


@pytest.mark.parametrize("families", [("jpeg",), ("jpeg", "noise")])
def test_worst_family_is_what_resampled_rows_give(spark, families):
    """Against rows copied as often as their source is drawn."""
    data = [("m", i, 1, "c", f, (i * 7 + len(f)) % 10 / 10) for i in range(12) for f in families]
    d = spark.createDataFrame(data, "method_id string, source_id long, label int, condition_id string, family string, p double")
    times = times_of([(i, 1) for i in range(12)], 30, 5, 4)
    got = {r.replicate: r.worst for r in resample.worst_family(resample.contributions(d), 30, 5, size=4).collect()}
    for k in range(30):
        copies = [x for x in data for _ in range(times.get((k, x[1]), 0))]
        recall = [np.mean([x[5] >= 0.5 for x in copies if x[4] == f]) for f in families]
        assert abs(got[k] - min(recall)) < 1e-12


def test_rates_and_auroc_against_copied_rows(spark):
    r = random.Random(4)
    data = [("m", i, int(i < 20), "clean", "clean", r.randint(0, 12) / 12) for i in range(50)]
    d = spark.createDataFrame(data, "method_id string, source_id long, label int, condition_id string, family string, p double")
    times = times_of([(x[1], x[2]) for x in data], 25, 9, 1 << 14)
    rates = {x.replicate: x for x in resample.rate_replicates(d, 25, 9).collect()}
    area = {x.replicate: x.auroc for x in resample.auroc_replicates(d, 25, 9).collect()}
    for k in range(25):
        pos, neg = ([x[5] for x in data if x[2] == y for _ in range(times.get((k, x[1]), 0))] for y in (1, 0))
        assert (len(pos), len(neg)) == (20, 30)
        assert abs(rates[k].recall - np.mean(np.array(pos) >= 0.5)) < 1e-12 and abs(rates[k].fpr - np.mean(np.array(neg) >= 0.5)) < 1e-12
        assert abs(area[k] - np.mean([(a > b) + (a == b) / 2 for a in pos for b in neg])) < 1e-12


def test_bootstrap_of_nothing_and_of_one_class(spark):
    s = spark.createDataFrame([("m", 1, 1, 2), ("m", 1, 1, 3), ("m", None, 1, None)], "method_id string, source_id long, label int, v int")
    assert resample.resampled(s.limit(0), ["method_id"], ["v"], 5, 1).count() == 0
    got = [x.v for x in resample.resampled(s, ["method_id"], ["v"], 50, 1).collect()]
    assert set(got) == {0, 5, 10}


def test_greedy_selection_to_the_end(spark):
    r = random.Random(8)
    names = [(i, c, f) for i, (c, f, _) in enumerate(grid.CONDITIONS) if i in (0, 1, 5, 10, 13, 19)]
    data = [("m", i, i % 2, c, f, k, min(1.0, max(0.0, 0.25 + 0.5 * (i % 2) + r.gauss(0, 0.1 + 0.02 * k)))) for i in range(70) for k, c, f in names]
    d = spark.createDataFrame(data, "method_id string, source_id long, label int, condition_id string, family string, idx int, p double")
    got = [(x.step, x.condition_id, x.auroc) for x in pairs.greedy_conditions(d, 19).orderBy("step").collect()]
    p = {(x[1], x[3]): x[6] for x in data}
    right = {i: (p[i, "clean"] >= 0.5) == bool(i % 2) for i in range(70)}
    keeps = lambda i, c: (p[i, c] >= 0.5) == (p[i, "clean"] >= 0.5)
    left, chosen, want = [(k, c) for k, c, _ in names[1:]], [], []
    while left:
        tried = []
        for k, c in left:
            s = {i: sum(keeps(i, x) for x in [*chosen, c]) for i in range(70)}
            area = np.mean([(s[a] > s[b]) + (s[a] == s[b]) / 2 for a in right if right[a] for b in right if not right[b]])
            tried.append((-round(area, 6), k, c))
        area, k, c = min(tried)
        chosen.append(c)
        left.remove((k, c))
        want.append((len(chosen), c, -area))
    assert got == want and len(got) == 5


def test_pairs_without_rest(spark):
    d = rows(spark, [1, 0, 1], [0.9, 0.1, 0.8], condition_id="clean").select("source_id", "condition_id", "label", "p")
    both = d.withColumn("method_id", F.lit("m1")).unionByName(d.withColumn("method_id", F.lit("m2")))
    assert pairs.matched(both, "m1", "m2").count() == 3
    for bad, reason in ((both.where("not (method_id = 'm2' and source_id = 0)"), "only m1: 1"), (both.withColumn("label", F.expr("if(method_id = 'm2', 1 - label, label)")), "label: 3")):
        with pytest.raises(ValueError, match=reason):
            pairs.matched(bad, "m1", "m2")


def test_draws_are_dealt_in_parts(monkeypatch):
    """The same numbers as searching all picks at once, while no array is longer than PART."""
    rng, whole, longest = np.random.default_rng(8), resample.picks, []
    monkeypatch.setattr(resample, "PART", 1000)
    monkeypatch.setattr(resample, "picks", lambda k, draws, n, first=0: (longest.append(draws), whole(k, draws, n, first))[1])
    for sizes in ([1], [5000], [1, 1, 1], [7, 1, 9000], [4096] * 5, list(rng.integers(900, 1100, 40))):
        edges = np.cumsum(np.array(sizes, np.int64))
        n = int(edges[-1])
        want = np.bincount(np.searchsorted(edges, whole(17, n, n), "right"), minlength=len(edges))
        assert (resample.shares(17, edges) == want).all()
        monkeypatch.setattr(resample, "CELLS", 4)
        assert (resample.shares(17, edges) == want).all()
        monkeypatch.setattr(resample, "CELLS", 1 << 22)
    assert max(longest) <= 1000


@pytest.mark.parametrize("few", [0, 1 << 20])
def test_blocks_summed_together_draw_the_same(spark, monkeypatch, few):
    """Several blocks a group, by both ways to multiply: rows fewer than one a block, draws as another engine's."""
    monkeypatch.setattr(resample, "FEW", few)
    monkeypatch.setattr(resample, "CELLS", 8)
    sources, size = [(i, int(i % 3 == 0)) for i in range(150)], max(1, 150 // (8 * spark.sparkContext.defaultParallelism))
    s = spark.createDataFrame([(i % 3, i, y, float(i), 1.0) for i, y in sources for _ in range(1 + i % 2)], "g int, source_id long, label int, n double, one double").repartition(3)
    got = {(r.replicate, r.g): (r.n, r.one) for r in resample.resampled(s, ["g"], ["n", "one"], 12, 7, size=size).collect()}
    times = times_of(sources, 12, 7, size)
    for (replicate, g), (n, one) in got.items():
        own = [(i, times.get((replicate, i), 0) * (1 + i % 2)) for i, _ in sources if i % 3 == g]
        assert (n, one) == (sum(i * t for i, t in own), sum(t for _, t in own))
    assert len(got) == 36


def test_summaries_without_a_window(spark, monkeypatch):
    r = random.Random(5)
    names = [(i, c) for i, (c, *_) in enumerate(grid.CONDITIONS)]
    rows = [(m, s, c, i, s % 2, r.choice([None, 0.1, 0.5, 0.9])) for m in ("m1", "m2") for s in range(40) for i, c in r.sample(names, r.choice([1, 5, 20]))]
    rows += rows[::17]
    d = spark.createDataFrame(rows, "method_id string, source_id long, condition_id string, idx int, label int, p double").repartition(3)
    want = {}
    for key in {x[:2] for x in rows}:
        own = [x for x in rows if x[:2] == key]
        clean = max((x[5] for x in own if x[2] == "clean" and x[5] is not None), default=None)
        if clean is None:
            continue
        ps = [x[5] for x in own if x[5] is not None]
        flips = [c for _, c in sorted((x[3], x[2]) for x in own if x[5] is not None and (x[5] >= 0.5) != (clean >= 0.5))]
        status = "incomplete" if len(own) < 20 else "unstable" if flips else "stable"
        want[key] = (round(max(ps) - min(ps), 6), flips, len(flips), len(own), status)
    monkeypatch.setattr(pairs, "with_clean", None)
    got = pairs.stress_summary(d)
    assert {(x.method_id, x.source_id): tuple(x)[2:] for x in got.collect()} == want
    plan = got.groupBy("status").agg(F.sum("n_flips"))._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "collect_list" not in plan and "Sort" not in plan
    assert pairs.greedy_conditions(d.where("method_id = 'm1'"), 3).count() == 3
