"""Stress records, dumps, guards, responses and configured conditions against plain loops."""

import math
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from stresslens.operators import dedup, grid, manifests, operating, response, stress

NAMES = [c for c, *_ in grid.CONDITIONS]
SCHEMA = "method_id string, source_id string, condition_id string, p_fake double, decision string, threshold_used double, threshold_provenance string"


def plain(rows):
    keys, of = Counter(r[:3] for r in rows), defaultdict(list)
    prob = lambda x: x is not None and math.isfinite(x) and 0 <= x <= 1

    def own(r):
        _, _, c, p, d, t, v = r
        if c not in NAMES:
            return "condition"
        if not prob(p):
            return "p_fake"
        if not prob(t):
            return "threshold"
        if d not in ("real", "fake"):
            return "decision"
        if (d == "fake") != (p >= t):
            return "inconsistent"
        if not (v or "").strip():
            return "provenance"
        return "repeated" if keys[r[:3]] > 1 else None

    for r in rows:
        of[r[:2]].append(r)
    errors, status = [], {}
    for key, rs in of.items():
        cleans = [r for r in rs if r[2] == "clean"]
        bad = any(own(r) for r in cleans)
        clean = cleans[0] if cleans and not bad else None
        good = []
        for r in rs:
            e = own(r) or ("no clean" if not cleans else "clean" if bad else "threshold differs" if abs(r[5] - clean[5]) > 1e-12 else "provenance differs" if r[6] != clean[6] else None)
            errors.append((*r[:3], e))
            if e is None:
                good.append(r)
        flips = sorted((NAMES.index(r[2]), r[2]) for r in good if r[4] != clean[4])
        status[key] = (len(good), 20 - len(good), [c for _, c in flips], "refused" if clean is None else "incomplete" if len(good) < 20 else "unstable" if flips else "stable")
    return errors, status


def test_records_and_status_are_a_plain_loops(spark):
    r, rows = random.Random(2), []
    for s in [*(f"s{i}" for i in range(60)), None]:
        noisy = r.random() < 0.7
        for c in [*NAMES, *(["odd", None] if noisy else [])]:
            p = r.randrange(11) / 10
            p = p if s != "s3" else 0.9
            row = ["m" if s != "s5" else None, s, c, p, "fake" if p >= 0.5 else "real", 0.5, "dev"]
            if noisy and r.random() < 0.15:
                i, v = r.choice([(3, None), (3, float("nan")), (3, 1.5), (4, "REAL"), (4, None), (4, "fake"), (5, 0.6), (5, None), (5, 0.5 + 1e-13), (6, " "), (6, None), (6, "dev2")])
                row[i] = v
            if noisy and r.random() < 0.02:
                continue
            rows += [tuple(row)] * (2 if noisy and r.random() < 0.03 else 1)
    rows = [x for x in rows if not (x[1] == "s7" and x[2] == "clean")]
    got = stress.checked(spark.createDataFrame(rows, SCHEMA).repartition(3))
    errors, status = plain(rows)
    key = lambda x: tuple(map(str, x))
    assert sorted(((x.method_id, x.source_id, x.condition_id, x.error) for x in got.collect()), key=key) == sorted(errors, key=key)
    assert {(x.method_id, x.source_id): (x.n_scored, x.n_errors, x.flips, x.status) for x in stress.summary(got).collect()} == status
    assert {v[3] for v in status.values()} == {"refused", "incomplete", "unstable", "stable"}
    assert len({e for *_, e in errors}) >= 11


def test_no_records(spark):
    assert stress.summary(stress.checked(spark.createDataFrame([], SCHEMA))).count() == 0


def test_dump_faults(spark):
    schema = "sha256 string, condition_id string, label int, `group` string, file_multiplicity int, p_fake double, reliability double, primary_p_fake double, ok boolean"
    fine = [(("%064x" % i), c, i % 2, "g", 1, 0.5, None, 0.5, [True, None][i % 2]) for i in range(4) for c in NAMES]
    assert manifests.dump_faults(spark.createDataFrame(fine, schema)).count() == 0
    rows = [r for r in fine if r[1] != "crop_0.8" and not (r[1] == "clean" and r[2] == 1)]
    rows += [("Z" * 64, "clean", 1, "g", 1, 0.5, None, None, True), ("a" * 64, "odd", 1, "g", 1, 2.0, None, None, True), ("a" * 64, "clean", 1, None, 1, 0.5, None, None, True), ("b" * 64, "clean", 1, "g", 0, 0.5, None, None, True),
        ("c" * 64, "clean", 1, "g", 1, float("nan"), None, None, True), ("d" * 64, "clean", 1, "g", 1, 0.5, 1.5, None, True), ("e" * 64, "clean", 1, "g", 1, 0.5, None, -0.1, True), ("f" * 64, "clean", 1, "g", 1, 0.5, None, None, False), (None, None, None, None, None, None, None, None, None)]
    got = {r.reason: (r.n, r.example) for r in manifests.dump_faults(spark.createDataFrame(rows, schema)).collect()}
    assert got == {"sha256": (2, "Z" * 64), "condition_id": (1, "a" * 64), "group": (1, "a" * 64), "file_multiplicity": (1, "b" * 64), "p_fake": (1, "c" * 64), "reliability": (1, "d" * 64), "primary_p_fake": (1, "e" * 64), "failed": (1, "f" * 64), "no positive": (2, "clean")}
    assert {r.reason: r.n for r in manifests.dump_faults(spark.createDataFrame([], schema)).collect()} == {"no positive": 20}


def test_signature_and_arms(spark):
    r = random.Random(4)
    rows = [(i, ((i % 5 > 0), r.random(), r.gauss(0, 2)), (r.random(), r.random(), r.random(), r.random(), {"a": r.random(), "b": [0.0, 1.0, 0.4][i % 3], "c": r.random()}, 3 - (i % 7 == 0))) for i in range(40)]
    d = spark.createDataFrame(rows, "id int, a struct<ok: boolean, p_fake: double, raw_logit: double>, b struct<probe_mean: double, probe_std: double, probe_range: double, probe_max_delta: double, probe_scores: map<string, double>, n_probes_ok: int>")
    s = response.signature(F.col("a"), F.col("b"), ["a", "b", "c"])
    q = F.array(*[F.lit(float(i)) for i in range(8)])
    got = {x.id: x for x in d.where(response.usable(F.col("a"), F.col("b"), 3)).select("id", s.alias("s"), response.arm("C", F.col("a.raw_logit"), q, s).alias("C"), response.arm("D", F.col("a.raw_logit"), q, s).alias("D"), response.arm("Q", F.col("a.raw_logit"), q, s).alias("Q")).collect()}
    assert set(got) == {i for i in range(40) if i % 5 and i % 7}
    for i, (_, p, z), (mean, std, wide, far, scores, _) in rows:
        if i in got:
            d3 = np.array([math.log(c / (1 - c)) for c in (min(max(scores[k], 1e-6), 1 - 1e-6) for k in "abc")]) - z
            want = [*d3, d3.mean(), d3.std(), np.abs(d3).max(), d3.max() - d3.min(), std, wide, far, mean - p]
            assert np.allclose(got[i].s, want, rtol=1e-9, atol=1e-12) and (len(got[i].C), len(got[i].D), len(got[i].Q)) == (20, 12, 8) and got[i].C[0] == z
    assert d.select(response.signature(F.col("a"), F.col("b"), ["a", "none"]).alias("s")).where("s is not null").count() == 0
    with pytest.raises(ValueError):
        response.arm("E", F.lit(1.0), q, s)


def test_readings(spark):
    d = spark.createDataFrame([(0.95,), (0.9499,), (0.65,), (0.55,), (0.1,), (float("nan"),), (None,)], "v double")
    assert [x.r and x.r.split()[0] for x in d.select(response.reading(F.col("v")).alias("r")).collect()] == ["near-perfect", "strong", "moderate", "weak", "at", None, None]


def test_the_threshold_split_is_guarded(spark):
    train, dev = spark.range(1), spark.range(2)
    assert operating.threshold_rows("dev", train, dev) is dev and operating.threshold_rows("train", train, dev, acknowledged=True) is train
    for split in ("train", "test", ""):
        with pytest.raises(operating.SplitError):
            operating.threshold_rows(split, train, dev, acknowledged=split == "test")


def test_provenances(spark):
    texts = ["dev-2", " ", "", None, "placeholder: 0.5", "Unspecified", " UNSPECIFIED-x", "a placeholder"]
    want = [True, False, False, False, False, False, False, True]
    assert [operating.is_frozen(t) for t in texts] == want
    d = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").orderBy("i")
    assert [r.f for r in d.select(operating.frozen(F.col("t")).alias("f")).collect()] == want


def test_orders(spark):
    c = spark.createDataFrame([(i, "abc"[i % 3] if i < 9 else "d") for i in range(20)], "id int, cluster string")
    assert [tuple(r) for r in dedup.largest_first(c).collect()] == [("d", 11), ("a", 3), ("b", 3), ("c", 3)]
    s = spark.createDataFrame([("x", 0.5), ("y", -2.0), ("a", 0.5), ("n", None)], "feature string, smd double")
    assert [r.feature for r in dedup.most_telling(s).collect()] == ["y", "a", "x", "n"]


def protocol(change=None):
    lines = ["pipeline_version: '1'", "conditions:"]
    for c, f, p in grid.CONDITIONS:
        lines.append(f"  '{c}': {{family: {f}, kind: {f if p else 'identity'}{f', amount: {p}' if p else ''}}}")
    return "\n".join(lines).replace(*(change or ("", "")))


def test_configured_conditions(spark):
    pytest.importorskip("yaml")
    rows = grid.configured(spark, protocol(), "1").collect()
    assert [(r.condition_id, r.family, r.parameter) for r in rows] == [tuple(c) for c in grid.CONDITIONS] and rows[0].kind == "identity"
    for change, version in [(("amount: 90.0", "amount: 91.0"), "1"), (("'clean'", "'plain'"), "1"), (("family: jpeg", "family: blur"), "1"), (("", ""), "2"), (("conditions:", "other:"), "1"), (("amount: 90.0", "amount: 90.0, more: 2"), "1"), (("kind: identity", "kind: 3"), "1")]:
        with pytest.raises(ValueError):
            grid.configured(spark, protocol(change), version)


def test_abstention_is_frozen_as_a_value(spark):
    r, rows = random.Random(8), []
    for m in ("sharp", "flat"):
        for i in range(400):
            rel = r.randrange(200) / 200
            wrong = r.random() < (0.6 * (1 - rel) if m == "sharp" else 0.2)
            rows.append((m, f"s{i}", 0, 1, 0.1 if wrong else 0.9, rel))
    rows += [("none", "s", 0, 1, 0.9, None), ("sharp", "null", 0, 1, 0.1, None)]
    coverages = (1.0, 0.95, 0.9, 0.8, 0.7, 0.6, 0.5)
    got = {x.method_id: x for x in operating.frozen_abstention(spark.createDataFrame(rows, "method_id string, source_id string, idx int, label int, p double, reliability double").repartition(3), coverages).collect()}
    assert set(got) == {"sharp", "flat"}
    rel = np.array([x[5] for x in rows if x[0] == "sharp" and x[5] is not None])
    assert got["sharp"].adopted and got["sharp"].coverage < 1 and got["sharp"].gain >= 0.02
    assert math.isclose(got["sharp"].reliability_threshold, np.quantile(rel, 1 - got["sharp"].coverage), rel_tol=1e-12)
    if not got["flat"].adopted:
        assert got["flat"].reliability_threshold is None


def test_views_dealt_by_source_are_not_shuffled(spark, monkeypatch):
    """Only the sources move: what is grouped or windowed by source later stays where it was made."""
    from stresslens.operators import grid
    from stresslens.plans import stress_queries

    monkeypatch.setattr(grid, "TASK", 100)
    plan = stress.summary(stress.checked(stress_queries.records(spark, "/root/testdata/sf0.001")))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning(source_id") == 1 == plan.count("Exchange hashpartitioning") and "REPARTITION_BY_NUM" in plan
    assert "SortAggregate" not in plan and "ObjectHashAggregate" not in plan
