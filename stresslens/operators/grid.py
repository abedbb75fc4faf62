"""The condition dimension, and prediction rows derived from any table of sources."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The perturbations, by family, with their one parameter.
CONDITIONS = (
    ("clean", "clean", None),
    ("jpeg_q90", "jpeg", 90.0),
    ("jpeg_q70", "jpeg", 70.0),
    ("jpeg_q50", "jpeg", 50.0),
    ("jpeg_q30", "jpeg", 30.0),
    ("blur_s0.5", "blur", 0.5),
    ("blur_s1.0", "blur", 1.0),
    ("blur_s2.0", "blur", 2.0),
    ("resize_0.5", "resize", 0.5),
    ("resize_0.25", "resize", 0.25),
    ("noise_s0.02", "noise", 0.02),
    ("noise_s0.05", "noise", 0.05),
    ("noise_s0.10", "noise", 0.10),
    ("bright_-20", "color", 0.8),
    ("bright_+20", "color", 1.2),
    ("contrast_-20", "color", 0.8),
    ("contrast_+20", "color", 1.2),
    ("saturation_-20", "color", 0.8),
    ("saturation_+20", "color", 1.2),
    ("crop_0.8", "crop", 0.8),
)
CLEAN = "clean"
FAMILIES = ("jpeg", "blur", "resize", "noise", "color", "crop")
#: How much each condition takes from the signal of derived rows, in percent; ours, in the order of CONDITIONS.
SEVERITY = (0, 10, 25, 40, 60, 15, 35, 65, 30, 60, 20, 45, 80, 10, 10, 12, 12, 8, 8, 20)
METHODS = ("m1", "m2")


def conditions(spark: SparkSession) -> DataFrame:
    """idx, condition_id, family, parameter, severity: twenty rows, always small enough to broadcast."""
    rows = [(i, c, f, p, s) for i, ((c, f, p), s) in enumerate(zip(CONDITIONS, SEVERITY, strict=True))]
    return spark.createDataFrame(rows, "idx int, condition_id string, family string, parameter double, severity int")


def configured(spark: SparkSession, text: str, version: str | None = None) -> DataFrame:
    """idx, condition_id, family, kind, parameter, property of a protocol's YAML text; as small as the protocol.

    `conditions` maps ids to family, kind and at most one number under a name of its own. Refused are another
    pipeline_version, conditions that aren't exactly CONDITIONS, another family, and a parameter that isn't that of CONDITIONS.
    """
    import yaml  # not part of every installation; only who reads YAML needs it

    body = yaml.safe_load(text)
    if not isinstance(body, dict) or not isinstance(body.get("conditions"), dict):
        raise ValueError("no conditions")
    if version is not None and body.get("pipeline_version") != version:
        raise ValueError(f"pipeline_version is {body.get('pipeline_version')!r}, not {version!r}")
    given, known = body["conditions"], {c: (f, p) for c, f, p in CONDITIONS}
    if odd := sorted(set(map(str, given)) ^ set(known)):
        raise ValueError(f"not the conditions that are known: {', '.join(odd)}")
    rows = []
    for i, c in enumerate(known):
        spec = given[c] if isinstance(given[c], dict) else {}
        numbers = [v for k, v in spec.items() if isinstance(v, int | float) and not isinstance(v, bool)]
        parameter = float(numbers[0]) if numbers else None
        if len(numbers) > 1 or not isinstance(spec.get("kind"), str) or (spec.get("family"), parameter) != known[c]:
            raise ValueError(f"{c} isn't as known: {spec}")
        rows.append((i, c, spec["family"], spec["kind"], parameter, spec.get("property")))
    return spark.createDataFrame(rows, "idx int, condition_id string, family string, kind string, parameter double, property string")


def expand(sources: DataFrame) -> DataFrame:
    """Every source under every condition."""
    return sources.crossJoin(F.broadcast(conditions(sources.sparkSession)))


def with_family(rows: DataFrame) -> DataFrame:
    """The family is always derived from the condition; what a row says of it isn't believed."""
    c = conditions(rows.sparkSession).select("condition_id", "family", "idx")
    return rows.drop("family", "idx").join(F.broadcast(c), "condition_id")


def md5_int(text: Column) -> Column:
    """32 bits of md5 as a long: draws that are the same in every engine."""
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long")


def pending(grid: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """Resume: the views of a grid that no output has yet."""
    return grid.join(done.select(*keys).distinct(), keys, "left_anti")


#: Sources of a task, about.
TASK = 16384


def dealt(sources: DataFrame, key: str, task: int | None = None) -> DataFrame:
    """sources dealt by key to tasks of about so many, before anything is made of them.

    A source's views are then made where the source is: what groups by source later needs no shuffle of the views, and
    a file of one row group is no single task.
    """
    return sources.repartition(max(1, -(-sources.count() // (task or TASK))), key)


def _answer(u: str) -> tuple[Column, Column]:
    """p and reliability by a draw, the condition's severity and the label."""
    signal = F.expr("(600 * label * (100 - severity)) div 100")
    score = F.least(signal + F.expr(f"({u} * 400) div 4294967296"), F.lit(1000))
    return score / 1000, F.expr(f"({u} % 1000) * (100 - severity) div 100") / 1000


def _draw(method: Column) -> Column:
    return md5_int(F.concat_ws(":", F.col("source_id").cast("string"), "condition_id", method))


def _sources(spark: SparkSession, sf_dir: str, *more: Column) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.col("o_orderkey").alias("source_id"), (F.col("o_orderstatus") == "F").cast("int").alias("label"), *more)


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """method_id, source_id, condition_id, family, idx, label, p, reliability for all orders, all conditions, two methods.

    Scores are whole thousandths, made by integer arithmetic, so that they tie often and are the same everywhere.
    """
    g = expand(dealt(_sources(spark, sf_dir), "source_id")).withColumn("method_id", F.explode(F.array(*[F.lit(m) for m in METHODS])))
    g = g.withColumn("u", _draw(F.col("method_id")))
    p, reliability = _answer("u")
    return g.select("method_id", "source_id", "condition_id", "family", "idx", "label", p.alias("p"), reliability.alias("reliability"))


def paired(sources: DataFrame) -> DataFrame:
    """Every source under every condition with both methods' answers in one row, as p_ and reliability_ of each: what predictions() has in two."""
    g = expand(sources).withColumns({f"_u_{m}": _draw(F.lit(m)) for m in METHODS})
    cells = [x for m in METHODS for x in zip(_answer(f"_u_{m}"), (f"p_{m}", f"reliability_{m}"), strict=True)]
    return g.select(*sources.columns, "condition_id", "family", "idx", *[c.alias(n) for c, n in cells])


SQL = """
conditions AS (SELECT * FROM (VALUES """ + ", ".join(f"({i}, '{c}', '{f}', {s})" for i, ((c, f, _), s) in enumerate(zip(CONDITIONS, SEVERITY, strict=True))) + """) t(idx, condition_id, family, severity)),
pred0 AS (
  SELECT m.method_id, o.o_orderkey AS source_id, c.condition_id, c.family, c.idx, CASE WHEN o.o_orderstatus = 'F' THEN 1 ELSE 0 END AS label, c.severity,
         CAST('0x' || substr(md5(o.o_orderkey || ':' || c.condition_id || ':' || m.method_id), 1, 8) AS bigint) AS u
  FROM orders o, conditions c, (VALUES ('m1'), ('m2')) m(method_id)),
pred AS (
  SELECT method_id, source_id, condition_id, family, idx, label,
         CAST(least((600 * label * (100 - severity)) // 100 + (u * 400) // 4294967296, 1000) AS double) / 1000 AS p,
         CAST(((u % 1000) * (100 - severity)) // 100 AS double) / 1000 AS reliability FROM pred0)
"""
