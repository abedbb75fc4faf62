"""Threshold selection against a loop over all candidates, and operating points at their edges."""

import random

import numpy as np
import pytest

from stresslens.operators import grid, operating
from tests.test_metrics import rows, times_of

SCHEMA = "method_id string, source_id long, label int, condition_id string, family string, p double"


def dev(method, sources, families, real=0.05, seed=0, step=None):
    """A dev set whose families' positive scores are given, so that the worst is known."""
    r, out = random.Random(seed), []
    for i in range(sources):
        for _, (condition, family, _) in enumerate(grid.CONDITIONS):
            p = families.get(family, 0.9) if i % 2 else real
            p = min(1.0, max(0.0, p + r.gauss(0, 0.08 if step else 1e-4)))
            out.append((method, i, i % 2, condition, family, round(p / step) * step if step else p))
    return out


def brute(data, replicates, seed, base=0.5):
    """Every clipped score as a candidate, each replicate by copied rows."""
    times = times_of(sorted({(x[1], 1) for x in data if x[2] == 1}), replicates, seed, 1 << 14)
    y, p, clean = np.array([x[2] for x in data]), np.array([x[5] for x in data]), np.array([x[3] == "clean" for x in data])
    family, source = np.array([x[4] for x in data]), np.array([x[1] for x in data])

    def rates(t):
        fpr = np.mean(p[clean & (y == 0)] >= t)
        return fpr, (np.mean(p[clean & (y == 1)] >= t) + 1 - fpr) / 2

    weight = np.array([[times.get((k, s), 0) for s in source] for k in range(replicates)])
    b_fpr, b_bacc = rates(base)
    best = None
    for t in np.unique(np.clip(p, 0, 1)):
        fpr, bacc = rates(t)
        if fpr > b_fpr + 0.01 or bacc < b_bacc - 0.01:
            continue
        worst = np.min([weight[:, own] @ (p[own] >= t) / weight[:, own].sum(1) for f in grid.FAMILIES for own in [(family == f) & (y == 1)]], axis=0)
        key = (worst.mean(), bacc, -fpr, t)
        best = max(best or key, key)
    return best


def test_planted_worst_family(spark):
    data = dev("m", 40, {"noise": 0.62, "blur": 0.7})
    x = operating.select_threshold(spark.createDataFrame(data, SCHEMA), replicates=50).first()
    assert (x.feasible, x.objective) == (True, 1.0) and 0.05 < x.threshold <= 0.62 and x.low <= x.objective <= x.high
    data = dev("m", 40, {"noise": 0.3}, real=0.4)
    x = operating.select_threshold(spark.createDataFrame(data, SCHEMA), replicates=50).first()
    assert x.worst_family == "noise" and x.objective == 0 and x.threshold > 0.4


@pytest.mark.parametrize("step", [0.01, 0.04])
def test_selection_against_every_candidate(spark, step):
    a, b = dev("a", 60, {"noise": 0.55, "jpeg": 0.6}, 0.42, 1, step), dev("b", 60, {"blur": 0.5}, 0.3, 2, step)
    d = spark.createDataFrame(a + b, SCHEMA).repartition(3)
    got = {x.method_id: x for x in operating.select_threshold(d, replicates=40, seed=3).collect()}
    for m, data in (("a", a), ("b", b)):
        objective, bacc, fpr, t = brute(data, 40, 3)
        assert got[m].threshold == t and got[m].feasible
        assert (got[m].objective, got[m].balanced_accuracy, got[m].fpr) == (round(objective, 6), round(bacc, 6), round(-fpr, 6))


def test_no_allowed_candidate_and_no_positive_views(spark):
    data = dev("m", 20, {}) + [("none", i, 0, "clean", "clean", 0.2) for i in range(5)]
    d = spark.createDataFrame(data, SCHEMA)
    few = spark.createDataFrame([("m", 0.0)], "method_id string, threshold double")
    got = {x.method_id: x for x in operating.select_threshold(d, replicates=10, thresholds=few).collect()}
    assert not got["m"].feasible and got["m"].threshold == 0.5 and got["m"].objective == 1.0
    got = {x.method_id: x for x in operating.select_threshold(d, replicates=10).collect()}
    assert got["m"].feasible and not got["none"].feasible and got["none"].objective is None


def test_next_up_and_matching_above_all(spark):
    values = [0.0, 0.1, 0.5, 1.0, 3.0, 1 - 2**-53, 5e-324, 1e-310, 2.0**-1022, 0.9999999999999999, 7e300]
    got = spark.createDataFrame([(v,) for v in values], "x double").select("x", operating.next_up(operating.F.col("x")).alias("y")).collect()
    assert all(r.y == np.nextafter(r.x, np.inf) for r in got)
    x = operating.fpr_matched(rows(spark, [0] * 3, [0.5, 0.25, 0.1], condition_id="clean"), 0.1).first()
    assert x.threshold == np.nextafter(0.5, 1) and x.realised_fpr == 0 and x.above_all


def test_threshold_that_ties_with_none_takes_one_pass(spark, monkeypatch):
    """The lowest candidates are asked first: where the second already loses a hit, nothing is searched for."""
    from stresslens.operators import grid, operating

    passes, plain = [], operating.objectives
    monkeypatch.setattr(operating, "objectives", lambda *a, **k: passes.append(a[1]) or plain(*a, **k))
    rows = [("m", i, c, f, k, i % 2, (i * 20 + k + 1) / 1000) for i in range(40) for k, (c, f, _) in enumerate(grid.CONDITIONS)]
    d = spark.createDataFrame(rows, "method_id string, source_id long, condition_id string, family string, idx int, label int, p double")
    operating.select_threshold(d, base=0.001, fpr_slack=1.0, accuracy_slack=1.0, replicates=50, seed=3).collect()
    assert 1 <= len(passes) <= 2 and passes[0]["m"][:3] == sorted({x[6] for x in rows})[:2] + [sorted({x[6] for x in rows})[3]]


def test_frozen_abstention_writes_values_not_rows(spark, monkeypatch):
    from stresslens.operators import shared

    rng, written = np.random.default_rng(3), []
    data = [(m, i, 0, int(rng.integers(2)), float(rng.random()), None if i % 50 == 0 else int(rng.integers(9)) / 10) for m in ("a", "b") for i in range(400)]
    rows = spark.createDataFrame(data, "method_id string, source_id int, idx int, label int, p double, reliability double")
    whole = shared.cut
    for module in (shared, operating):
        monkeypatch.setattr(module, "cut", lambda df: (written.append(df.count()), whole(df))[1], raising=False)
    got = {r.method_id: r for r in operating.frozen_abstention(rows, (1.0, 0.8, 0.5), gain=-1.0).collect()}
    assert written and max(written) <= 18
    for m, r in got.items():
        assert r.reliability_threshold == pytest.approx(np.quantile([x[5] for x in data if x[0] == m and x[5] is not None], 0.2))


def test_below_by_ranges(spark):
    from stresslens.operators.shared import below_by_ranges

    rng = np.random.default_rng(4)
    data = [(g, float(v), int(rng.integers(1, 9))) for g in ("a", None) for v in rng.permutation(300)]
    got = below_by_ranges(spark.createDataFrame(data, "g string, v double, m long").repartition(5), "v", ["g"], "m").collect()
    assert len(got) == 600
    for r in got:
        own = [x for x in data if x[0] == r.g]
        assert (r.below, r.n) == (sum(x[2] for x in own if x[1] < r.v), sum(x[2] for x in own))


def test_abstention_reads_its_rows_once(spark):
    seen = spark.sparkContext.accumulator(0)
    data = [("m", i, i % 2, "clean" if i % 3 else "blur", [0.2, 0.9][(i // 5) % 2], None if i == 7 else i % 10 / 10) for i in range(60)]

    def told(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    schema = "method_id string, source_id int, label int, family string, p double, reliability double"
    r = operating.abstention(spark.createDataFrame(data, schema).mapInArrow(told, schema), 0.3).first()
    assert seen.value == 60
    kept, right = [x[5] is None or x[5] >= 0.3 for x in data], [(x[4] >= 0.5) == (x[2] == 1) for x in data]
    mean = lambda xs: round(sum(xs) / len(xs), 6)
    assert (r.coverage, r.accuracy_all) == (mean(kept), mean(right))
    assert (r.accuracy_kept, r.accuracy_deferred) == (mean([a for a, k in zip(right, kept, strict=True) if k]), mean([a for a, k in zip(right, kept, strict=True) if not k]))
    assert r.worst_recall == mean([x[4] >= 0.5 for x, k in zip(data, kept, strict=True) if k and x[3] == "blur" and x[2] == 1]) and r.worst_family == "blur"
