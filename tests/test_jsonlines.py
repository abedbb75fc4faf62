"""Torn JSON lines against a plain loop over bytes, and a file cut at each byte of its last line."""

import json
import random
import tempfile
from pathlib import Path

import pytest
from pyspark.sql import types as T

from stresslens.sources import jsonlines

SCHEMA = T.StructType([T.StructField("view_id", T.StringType()), T.StructField("cache_key", T.StringType()), T.StructField("schema_version", T.StringType()), T.StructField("p", T.DoubleType())])


def line(i, key="k", **more):
    return json.dumps({"view_id": f"v{i}", "cache_key": key, "schema_version": "s1", "p": i / 8, **more}).encode() + b"\n"


def loop(data: bytes):
    """View ids and good bytes: line by line to the first that is torn."""
    ids, good = [], 0
    for raw in data.splitlines(keepends=True) if b"\r" not in data else [x + b"\n" for x in data.split(b"\n")[:-1]] + [data.split(b"\n")[-1]]:
        if not raw.endswith(b"\n"):
            break
        text = raw.decode("utf-8", "replace").strip()
        if text:
            try:
                row = json.loads(text)
            except json.JSONDecodeError:
                break
            ids.append(row["view_id"])
        good += len(raw)
    return ids, good


def check(spark, bodies):
    root = tempfile.mkdtemp(prefix="jsonlines-")
    for n, b in bodies.items():
        (Path(root) / n).write_bytes(b)
    r = jsonlines.recovered(spark, root, SCHEMA)
    got = {n: [] for n in bodies}
    for x in r.rows.collect():
        got[Path(x.file).name].append(x.view_id)
    files = {Path(x.file).name: x for x in r.files.collect()}
    for n, b in bodies.items():
        ids, good = loop(b)
        assert sorted(got[n]) == sorted(ids), n
        if b:
            assert (files[n].rows, files[n].good_bytes, files[n].torn, files[n].size) == (len(ids), good, good < len(b), len(b)), n
        else:
            assert n not in files
    return root


def test_cut_at_each_byte_of_the_last_line(spark):
    head, last = line(0) + line(1), line(2)
    check(spark, {f"f{n:03}.jsonl": head + last[:n] for n in range(len(last) + 1)})


def test_odd_lines(spark):
    one, two = line(1), line(2)
    check(spark, {
        "glued.jsonl": one + two[:-1] + line(3) + line(4), "garbage.jsonl": one[:-1] + b"x\n" + two, "pair.jsonl": one + two[:-1] + b"," + line(3) + line(4), "blank.jsonl": one + b"\n  \n" + two,
        "middle.jsonl": one + b'{"view_id": "v\n' + two, "windows.jsonl": one[:-1] + b"\r\n" + two, "empty.jsonl": b"", "only.jsonl": b'{"vi', "extra.jsonl": line(5, more=[1, {"a": "}"}], file="f"), "utf8.jsonl": line(6)[:-2] + b', "x": "\xc3\xa9"}\n',
    })


def test_splits_of_one_file(spark):
    rng = random.Random(5)
    good = b"".join(line(i, pad="x" * rng.randrange(200)) for i in range(3000))
    tail = b"".join(line(i) for i in range(3000, 4000))
    was = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        root = check(spark, {"torn.jsonl": good + b'{"view_id": "v\n' + tail, "whole.jsonl": good + tail})
        assert spark.read.text(root).rdd.getNumPartitions() > 8
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", was)


def test_foreign_rows_are_refused_and_rewrite_keeps_the_rest(spark):
    root = Path(tempfile.mkdtemp(prefix="jsonlines-"))
    (root / "a.jsonl").write_bytes(line(0) + line(1) + line(2)[:9])
    with pytest.raises(jsonlines.CacheKeyMismatch, match="2 rows of another cache"):
        jsonlines.resume(spark, str(root), SCHEMA, "other")
    with pytest.raises(jsonlines.CacheKeyMismatch):
        jsonlines.resume(spark, str(root), SCHEMA, "k", "s2")
    target = str(root / "new")
    assert jsonlines.rewrite(spark, str(root / "a.jsonl"), target, SCHEMA, "k", "s1") == 2
    again = jsonlines.resume(spark, target, SCHEMA, "k", "s1")
    assert sorted(r.view_id for r in again.rows.collect()) == ["v0", "v1"] and not again.files.where("torn").count()
    (root / "b.jsonl").write_bytes(line(0)[:5] + b"\n" + line(7, key="other"))  # behind a tear nothing is read, so nothing is refused
    assert jsonlines.resume(spark, str(root / "b.jsonl"), SCHEMA, "k").rows.count() == 0
