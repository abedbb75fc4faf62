"""Validators that give all reasons from one read, against loops; digests under any partitioning."""

import math
import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from stresslens.operators import evidence, grid

SCHEMA = "sample_id string, source_id string, condition_id string, family string, label int, dataset_split string, cache_key string, experts map<string, struct<ok: boolean, p_fake: double, raw_logit: double>>"
KEY = "a" * 64
FAMILY = {c: f for c, f, _ in grid.CONDITIONS}


def good(n=6, split="test"):
    rows = []
    for i in range(n):
        for c, f, _ in grid.CONDITIONS:
            p = 0.1 + 0.8 * (i % 2)
            rows.append([f"{i}:{c}", f"s{i}", c, f, i % 2, split, KEY, {"x": (True, p, math.log(p / (1 - p)))}])
    return rows


def frame(spark, rows):
    return spark.createDataFrame([tuple(r) for r in rows], SCHEMA).repartition(3)


MANIFEST = {"status": "complete", "may_not_be_used_for_fitting": True, "rows_total": 120, "n_sources": 6, "experts": ["x@rev1"], "cache_key": KEY}


def evaluation_brute(rows, manifest):
    n = Counter()
    keys, conditions, labels = Counter((r[1], r[2]) for r in rows), defaultdict(set), defaultdict(set)
    for r in rows:
        conditions[r[1]].add(r[2])
        labels[r[1]].add(r[4])
        n["label"] += r[4] not in (0, 1)
        n["split"] += r[5] != "test"
        n["family"] += bool(r[3]) and r[3] != FAMILY.get(r[2])
        n["foreign_key"] += r[6] != manifest["cache_key"]
        block = (r[7] or {}).get("x")
        p = block and block[1]
        n["score_missing"] += p is None
        n["score_range"] += p is not None and not 0 <= p <= 1
    n["repeated"] = sum(v > 1 for v in keys.values())
    n["incomplete_grid"] = sum(len(c & FAMILY.keys()) < 20 for c in conditions.values())
    n["label_changes"] = sum(len(x) > 1 for x in labels.values())
    n["rows_total"], n["n_sources"] = abs(manifest["rows_total"] - len(rows)), abs(manifest["n_sources"] - len(conditions))
    return {k: v for k, v in n.items() if v}


def test_a_good_table_has_no_reason(spark):
    assert evidence.evaluation_reasons(frame(spark, good()), MANIFEST, "x", "rev1").count() == 0
    assert evidence.cache_reasons(frame(spark, good(split="dev")), ("x",)).count() == 0


def test_all_evaluation_reasons_at_once(spark):
    r, rows = random.Random(3), good()
    for _ in range(3):
        for column, values in ((4, [None, 2, 0]), (5, ["dev", None]), (3, ["noise", ""]), (6, ["b" * 64, None]), (7, [{}, None, {"x": (True, float("nan"), 0.0)}, {"x": (True, 1.5, 0.0)}, {"x": (True, None, 0.0)}])):
            r.choice(rows)[column] = r.choice(values)
    del rows[7]
    rows.append(list(rows[3]))
    rows[30][2] = "unknown"
    got = {x.reason: x.n for x in evidence.evaluation_reasons(frame(spark, rows), MANIFEST, "x", "rev1").collect()}
    assert got == evaluation_brute(rows, MANIFEST) and len(got) >= 8
    claims = {"status": "partial", "experts": ["y@rev2"], "rows_total": None}
    got = {x.reason for x in evidence.evaluation_reasons(frame(spark, good()), claims, "x", "rev1").collect()}
    assert got == {"status", "may_be_fitted_on", "expert", "revision", "no_key"}


def test_cache_reasons(spark):
    rows = good(split="train")
    rows[0][1] = ""
    rows[1][4] = 3
    rows[2][6] = "A" * 64
    rows[3][5] = "dev"
    rows[4][5] = "test"
    rows[25][7] = {"x": (False, None, None)}
    rows[26][7] = {}
    rows[27][7] = None
    rows[28][7] = {"x": (None, 0.5, 0.0)}
    rows[29][7] = {"x": (True, 0.5, 0.1)}
    rows[30][7] = {"x": (True, 0.5, float("inf"))}
    rows[31][7] = {"x": (True, 2.0, 0.0)}
    got = {x.reason: (x.n, x.example) for x in evidence.cache_reasons(frame(spark, rows), ("x",)).collect()}
    assert {k: v[0] for k, v in got.items()} == {"source_id": 1, "label": 1, "cache_key": 1, "split": 1, "several_cache_key": 1, "label_changes": 1, "dataset_split_changes": 1, "experts": 1, "ok_missing": 1, "logit_off": 1, "raw_logit": 1, "p_fake": 1, "excluded": 2}
    assert got["label"][1] == rows[1][0] and got["dataset_split_changes"][1] == "s0"
    assert evidence.usable(frame(spark, rows), ("x",)).count() == len(rows) - 3
    assert [x.reason for x in evidence.cache_reasons(frame(spark, rows).limit(0), ("x",)).collect()] == ["no_rows"]


def test_digest_under_any_partitioning(spark):
    rows = [(i, float(i) / 3, f"t{i}" if i % 5 else None, [i, None]) for i in range(500)] + [(1, 1 / 3, "t1", [1, None])]
    d = spark.createDataFrame(rows, "a long, b double, `c.d` string, e array<int>")
    want = evidence.frozen(d)
    assert want["rows"] == 501
    for n in (1, 7, 64):
        assert evidence.frozen(d.repartition(n)) == want
    assert evidence.frozen(d.select("e", "`c.d`", "b", "a")) == want
    for changed in (rows[:-1], [*rows[1:], (0, 0.0, "", [0, None])], [*rows[:9], (9, 3.0, "t9", [9])] + rows[10:], rows + rows[-1:]):
        assert evidence.frozen(spark.createDataFrame(changed, d.schema))["sha256"] != want["sha256"]
    assert evidence.frozen(d.withColumn("a", F.col("a").cast("int")))["sha256"] != want["sha256"]
    assert evidence.frozen(d.limit(0))["rows"] == 0


@pytest.mark.parametrize("broken", [False, True])
def test_coverage_adds_up(spark, broken):
    rows = frame(spark, good()).withColumn("method_id", F.explode(F.array(F.lit("a"), F.lit("b"))))
    freeze = evidence.frozen(rows)
    if broken:
        rows = rows.where("not (source_id = 's1' and condition_id = 'clean' and method_id = 'a')")
    coverage = {"expected_source_count": 6, "expected_view_count": 240, "successful_view_count": 240, "failure_count": 0}
    got = {x.reason: (x.expected, x.found) for x in evidence.coverage_reasons(rows, coverage, 0, freeze).collect()}
    assert got.keys() == ({"successful_view_count", "freeze_rows", "freeze_digest"} if broken else set())
    got = {x.reason for x in evidence.coverage_reasons(rows, {**coverage, "successful_view_count": 239}, 1).collect()}
    assert got == {"failure_count", "denominator", "failures"} | (set() if broken else {"successful_view_count"})


def test_sources_carry_no_row_checks(spark):
    from stresslens.plans import validation_queries

    rows = validation_queries.evaluated(spark, "/root/testdata/sf0.001")
    plan = evidence.summary(rows, evidence.cache_checks(("x", "y")))._jdf.queryExecution().optimizedPlan().toString()
    by_source = [line for line in plan.splitlines() if "Aggregate [source" in line]
    assert by_source and not any("e_label" in line or "n_label#" in line for line in by_source)
    assert "lambda" not in plan


def test_no_experts_asked(spark):
    from stresslens.plans import validation_queries

    rows = validation_queries.evaluated(spark, "/root/testdata/sf0.001")
    one = evidence.summary(rows, evidence.cache_checks(())).first()
    assert one.n_ok_missing == one.n_p_fake == 0 and one.rows == rows.count()
    assert one.c_no_expert == rows.where("experts is not null").count()
