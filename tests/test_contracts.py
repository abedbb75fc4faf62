import json

import pytest
from pyspark.sql import functions as F

from stresslens.operators import grid, validate
from stresslens.plans import report
from stresslens.sources import files

GOOD = {"schema_version": "prediction-row.v1", "run_id": "r", "method_id": "m", "sample_id": "s", "source_id": "a", "image_path": "p", "dataset": "d", "source_group": "g", "content_sha256": "0" * 64, "label": 1, "condition_id": "clean", "p_fake": 0.5, "reliability": None, "decision": None, "rescue_invoked": None, "inference_ms": 1.0, "expert_failures": None, "warnings": []}


def table(spark, *changes):
    return spark.createDataFrame([tuple({**GOOD, **c}[f.name] for f in files.PREDICTION_ROW.fields) for c in changes], files.PREDICTION_ROW)


def test_a_good_row_passes_and_each_breach_is_told(spark):
    assert validate.row_violations(table(spark, {})).count() == 0
    bad = [("label", 2), ("label", None), ("p_fake", float("nan")), ("p_fake", float("inf")), ("p_fake", 1.01), ("p_fake", None), ("reliability", -0.1), ("condition_id", "jpeg_q31"), ("content_sha256", "A" * 64), ("run_id", ""), ("run_id", None), ("inference_ms", -1.0), ("inference_ms", float("nan")), ("schema_version", "v0"), ("expert_failures", [("", "x", None, None)]), ("inference_ms", float("inf")), ("warnings", None), ("warnings", ["a", None])]
    for name, value in bad:
        found = validate.row_violations(table(spark, {}, {name: value})).collect()
        assert [(r.reason, r.n) for r in found] == [(name, 1)], (name, value)
        with pytest.raises(validate.ContractError):
            validate.raise_if(validate.row_violations(table(spark, {name: value})), "rows")


def test_a_family_must_be_its_condition_s(spark):
    d = table(spark, {"condition_id": "jpeg_q30"})
    for family, n in (("jpeg", 0), ("noise", 1), (None, 0)):
        assert validate.row_violations(d.withColumn("family", F.lit(family).cast("string"))).count() == n


def test_keys_and_grids(spark):
    d = table(spark, {}, {}, {"condition_id": "jpeg_q30"}, {"source_id": "b", "condition_id": "jpeg_q30", "label": 0})
    assert validate.duplicate_keys(d, ["method_id", "source_id", "condition_id"]).first().n == 2
    assert validate.dependency(d, ["sample_id"], ["source_id", "condition_id"]).count() == 1
    assert {r.source_id: (r.missing, r.has_clean) for r in validate.grid_coverage(d, ["source_id"]).collect()} == {"a": (18, True), "b": (19, False)}
    assert [r.source_id for r in validate.grid_coverage(d, ["source_id"], every=False).collect()] == ["b"]
    assert validate.headline_gaps(d).count() == 40 - 3
    assert {r.condition_id for r in validate.one_class_only(d, ["condition_id"]).collect()} == {"clean"}
    m = spark.createDataFrame([("a", 1), ("c", 0)], "source_id string, label int")
    r = d.groupBy("source_id").agg(F.max("label").alias("label"))
    assert {x.status: x.n for x in validate.reconcile(m, r, "source_id", ["label"]).collect()} == {"equal": 1, "missing": 1, "extra": 1}
    assert validate.forbidden(d.withColumn("warnings", F.array(F.lit("VAL2017/x"))), "(?i)val2017", "sample_id").count() == 4
    assert {x.column: x.n for x in validate.non_finite(table(spark, {"p_fake": float("nan")}, {})).collect()} == {"p_fake": 1, "reliability": 0, "inference_ms": 0}


def test_json_rows(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text(json.dumps({k: v for k, v in GOOD.items()}) + "\n\n" + json.dumps(GOOD) + "\n")
    assert files.prediction_rows(spark, str(tmp_path / "a.jsonl")).count() == 2
    (tmp_path / "b.jsonl").write_text('{"label": true}\n')
    with pytest.raises(Exception):  # noqa: B017  whatever the reader raises
        files.prediction_rows(spark, str(tmp_path / "b.jsonl")).collect()
    assert [r._corrupt_record for r in files.prediction_rows(spark, str(tmp_path / "b.jsonl"), strict=False).collect()] == ['{"label": true}']


def test_denylist_and_manifest(spark, tmp_path):
    p = tmp_path / "deny.txt"
    p.write_text(f"# head\n{'A' * 64}  phash={'0f' * 8} # why\n\n{'b' * 64}\n")
    assert sorted(map(tuple, files.denylist(spark, str(p)).collect())) == [("a" * 64, "0f" * 8), ("b" * 64, None)]
    for text in ("# nothing\n", "xyz\n"):
        p.write_text(text)
        with pytest.raises(ValueError):
            files.denylist(spark, str(p))
    m = tmp_path / "m.json"
    for text in ('{"images": [{"source_id": "a", "label": 1}]}', '[{"source_id": "a", "label": 1}]'):
        m.write_text(text)
        assert list(map(tuple, files.manifest(spark, str(m), "source_id:string,label:int").collect())) == [("a", 1)]


def test_resume_and_atomic_output(spark, tmp_path):
    d = grid.expand(spark.range(2)).select("id", "condition_id")
    out = str(tmp_path / "out")
    assert files.append_pending(d.where("condition_id = 'clean'"), out, ["id", "condition_id"]) == 2
    assert files.append_pending(d, out, ["id", "condition_id"]) == 38 and files.append_pending(d, out, ["id", "condition_id"]) == 0
    files.write_json({"a": [1.5]}, str(tmp_path / "x.json"))
    with pytest.raises(ValueError, match=r"\$\.a\[1\]"):
        files.write_json({"a": [1, float("nan")]}, str(tmp_path / "x.json"))
    assert json.loads((tmp_path / "x.json").read_text()) == {"a": [1.5]} and len(list(tmp_path.glob(".x.json*"))) == 0


def test_inference_modes(spark):
    d = spark.createDataFrame([("a", 0.5, None), ("b", 0.1, "broken")], "image_path string, p_fake double, error string")
    assert [tuple(r) for r in files.inference_output(d, "null").orderBy("image_path").collect()] == [("a", 0.5, None), ("b", None, "broken")]
    assert files.inference_output(d, "skip").count() == 1
    with pytest.raises(ValueError, match="broken"):
        files.inference_output(d, "strict")


THRESHOLD = {
    "schema_version": "threshold-artifact.v1", "threshold": 0.4, "objective": "worst family", "feasible": True, "selection_granularity": "family", "objective_value": 0.8, "objective_ci95": [0.7, 0.9],
    "worst_family": "noise", "worst_exact_condition": "noise_s0.10", "worst_exact_condition_recall": 0.7, "clean_fpr": 0.01, "clean_bacc": 0.9, "baseline_clean_fpr": 0.01, "baseline_clean_bacc": 0.9,
    "constraint_max_clean_fpr": 0.02, "constraint_min_clean_bacc": 0.89, "n_dev_sources": 100, "n_dev_rows": 2000, "n_fake_sources_per_exact_condition_min": 0,
    "bootstrap": {"n_replicates": 1000, "seed": 7, "unit": "source_id", "stratified_by": "label", "interval": "percentile_95"}, "dev_manifest_sha256": "b" * 64, "config_sha256": "c" * 64,
    "pipeline_version": "0.1.0", "fitting_code_version": "x", "created_at": "now", "tie_break": "higher", "warnings": [],
}


def test_frozen_threshold(tmp_path):
    p = tmp_path / "t.json"
    p.write_text(json.dumps(THRESHOLD))
    assert len(THRESHOLD) == 27 and report.FrozenThreshold.load(str(p)).value == 0.4
    boot = THRESHOLD["bootstrap"]
    for change in (
        {"threshold": True}, {"threshold": 1.2}, {"threshold": float("nan")}, {"extra": 1}, {"objective_ci95": [0.9, 0.7]}, {"objective_ci95": [0.1]}, {"worst_family": "clean"}, {"worst_exact_condition": "clean"},
        {"config_sha256": "C" * 64}, {"n_dev_rows": 0}, {"n_dev_rows": 1.5}, {"feasible": 1}, {"tie_break": " "}, {"warnings": [1]}, {"pipeline_version": "0.2.0"}, {"selection_granularity": "source"},
        {"bootstrap": {**boot, "unit": "row"}}, {"bootstrap": {**boot, "n_replicates": 0}}, {"bootstrap": {**boot, "more": 1}},
    ):
        p.write_text(json.dumps({**THRESHOLD, **change}))
        with pytest.raises(ValueError, match=next(iter(change))):
            report.FrozenThreshold.load(str(p))
    assert report.threshold_faults({k: v for k, v in THRESHOLD.items() if k != "bootstrap"}) == ["missing field bootstrap"] and report.threshold_faults([]) == ["not an object"]
    with pytest.raises(TypeError):
        report.FrozenThreshold(None, 0.5, "")


def test_report(spark):
    doc = report.document({"t": spark.createDataFrame([("a", 0.12345), ("b", None)], "name string, v double")}, 0.5)
    assert "| a | 0.1235 |" in report.markdown(doc) and "| b | – |" in report.markdown(doc) and report.bar(0.5, 4) == "##"
    with pytest.raises(ValueError):
        report.document({"t": spark.range(5)}, 0.5, limit=4)
