"""Row contracts by name, on rows made from order lines: keys repeat there, grids have gaps, scores leave their range."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stresslens.operators import evidence, grid, validate
from stresslens.plans.registry import query

_SPARSE = grid.SQL + """, sparse AS (
  SELECT 'prediction-row.v1' AS schema_version, 'run-' || (l_orderkey % 3) AS run_id, 'm1' AS method_id, l_orderkey || ':' || l_linenumber AS sample_id, l_orderkey AS source, CAST(l_orderkey AS varchar) AS source_id,
    CASE l_linenumber WHEN 1 THEN 'clean' WHEN 2 THEN 'jpeg_q30' WHEN 3 THEN 'blur_s2.0' WHEN 4 THEN 'resize_0.25' WHEN 5 THEN 'noise_s0.10' WHEN 6 THEN 'contrast_-20' ELSE 'crop_0.8' END AS condition_id,
    CASE WHEN o_orderstatus = 'F' THEN 1 WHEN o_orderstatus = 'O' THEN 0 ELSE 2 END AS label, l_quantity / 49.0::double AS p_fake, l_tax AS reliability, l_extendedprice - 1000 AS inference_ms,
    l_returnflag AS dataset, CASE WHEN l_suppkey % 7 = 0 THEN '' ELSE 's' || l_suppkey END AS source_group, l_partkey AS part FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"""


def sparse(spark: SparkSession, d: str) -> DataFrame:
    """Prediction rows from order lines: partial grids, repeated keys, and breaches of most kinds."""
    line = spark.read.parquet(f"{d}/lineitem.parquet").select("l_orderkey", "l_linenumber", "l_quantity", "l_tax", "l_extendedprice", "l_returnflag", "l_suppkey", "l_partkey")
    order = spark.read.parquet(f"{d}/orders.parquet").select("o_orderkey", "o_orderstatus")
    names = ["clean", "jpeg_q30", "blur_s2.0", "resize_0.25", "noise_s0.10", "contrast_-20", "crop_0.8"]
    condition = F.element_at(F.array(*[F.lit(n) for n in names]), F.least(F.col("l_linenumber"), F.lit(7)))
    r = line.join(order, F.col("l_orderkey") == F.col("o_orderkey"))
    sample = F.concat_ws(":", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string"))
    return r.select(
        F.lit(validate.ROW_VERSION).alias("schema_version"),
        F.concat(F.lit("run-"), (F.col("l_orderkey") % 3).cast("string")).alias("run_id"),
        F.lit("m1").alias("method_id"),
        sample.alias("sample_id"),
        F.col("l_orderkey").cast("string").alias("source_id"),
        F.concat(F.lit("img/"), sample).alias("image_path"),
        F.col("l_returnflag").alias("dataset"),
        F.when(F.col("l_suppkey") % 7 == 0, "").otherwise(F.concat(F.lit("s"), F.col("l_suppkey").cast("string"))).alias("source_group"),
        F.sha2(sample, 256).alias("content_sha256"),
        F.when(F.col("o_orderstatus") == "F", 1).when(F.col("o_orderstatus") == "O", 0).otherwise(2).alias("label"),
        condition.alias("condition_id"),
        (F.col("l_quantity") / 49.0).alias("p_fake"),
        F.col("l_tax").alias("reliability"),
        (F.col("l_extendedprice") - 1000).alias("inference_ms"),
        F.lit(None).cast("array<struct<expert_id:string,reason_code:string>>").alias("expert_failures"),
        F.when(F.col("l_partkey") % 7 > 0, F.array().cast("array<string>")).alias("warnings"),
        F.when(F.col("l_partkey") % 9 == 0, "noise").alias("family"),
        F.col("l_partkey").alias("part"),
    )


@query("f01_row_violations", f"""WITH {_SPARSE}, v AS (SELECT sample_id, unnest(list_filter([CASE WHEN label NOT IN (0, 1) THEN 'label' END, CASE WHEN NOT (p_fake BETWEEN 0 AND 1) THEN 'p_fake' END, CASE WHEN NOT (reliability BETWEEN 0 AND 1) THEN 'reliability' END,
CASE WHEN inference_ms < 0 THEN 'inference_ms' END, CASE WHEN source_group = '' THEN 'source_group' END, CASE WHEN part % 7 = 0 THEN 'warnings' END, CASE WHEN part % 9 = 0 AND condition_id <> 'noise_s0.10' THEN 'family' END], lambda x: x IS NOT NULL)) AS reason FROM sparse) SELECT reason, CAST(count(*) AS bigint) AS n, min(sample_id) AS example FROM v GROUP BY ALL""")
def f01(spark: SparkSession, d: str) -> DataFrame:
    return validate.row_violations(sparse(spark, d))


@query("f03_duplicate_keys", f"WITH {_SPARSE} SELECT method_id, source_id, condition_id, CAST(count(*) AS bigint) AS n FROM sparse GROUP BY ALL HAVING count(*) > 1")
def f03(spark: SparkSession, d: str) -> DataFrame:
    return validate.duplicate_keys(sparse(spark, d), ["method_id", "source_id", "condition_id"])


@query("f04_sample_fd", f"WITH {_SPARSE} SELECT sample_id FROM sparse GROUP BY ALL HAVING count(DISTINCT (source_id, condition_id, part)) > 1")
def f04(spark: SparkSession, d: str) -> DataFrame:
    return validate.dependency(sparse(spark, d), ["sample_id"], ["source_id", "condition_id", "part"])


@query("f05_identity_fd", f"WITH {_SPARSE} SELECT run_id, source_id FROM sparse GROUP BY ALL HAVING count(DISTINCT (label, dataset, source_group)) > 1")
def f05(spark: SparkSession, d: str) -> DataFrame:
    return validate.dependency(sparse(spark, d), ["run_id", "source_id"], ["label", "dataset", "source_group"])


@query("f06_grid_coverage", f"WITH {_SPARSE} SELECT run_id, method_id, source_id, CAST(20 - count(DISTINCT condition_id) AS int) AS missing, bool_or(condition_id = 'clean') AS has_clean FROM sparse GROUP BY ALL")
def f06(spark: SparkSession, d: str) -> DataFrame:
    return validate.grid_coverage(sparse(spark, d), ["run_id", "method_id", "source_id"])


@query("f07_both_classes", f"WITH {_SPARSE} SELECT method_id, condition_id, part FROM sparse WHERE label < 2 GROUP BY ALL HAVING count(DISTINCT label) = 1")
def f07(spark: SparkSession, d: str) -> DataFrame:
    return validate.one_class_only(sparse(spark, d).where("label < 2"), ["method_id", "condition_id", "part"])


@query("f08_headline_coverage", f"WITH {_SPARSE} SELECT c.condition_id, CAST((SELECT count(DISTINCT source_id) FROM sparse) - (SELECT count(DISTINCT source_id) FROM sparse s WHERE s.condition_id = c.condition_id) AS bigint) AS missing FROM conditions c WHERE missing > 0")
def f08(spark: SparkSession, d: str) -> DataFrame:
    return validate.headline_gaps(sparse(spark, d)).groupBy("condition_id").agg(F.count("*").alias("missing"))


@query("f09_manifest_recon", """WITH m AS (SELECT c_custkey AS source_id, c_nationkey AS k FROM customer), r AS (SELECT o_custkey AS source_id, min(o_custkey % 25) AS k FROM orders GROUP BY 1)
SELECT CASE WHEN r.source_id IS NULL THEN 'missing' WHEN m.source_id IS NULL THEN 'extra' WHEN m.k IS NOT DISTINCT FROM r.k THEN 'equal' ELSE 'different' END AS status, CAST(count(*) AS bigint) AS n FROM m FULL JOIN r ON m.source_id = r.source_id GROUP BY 1""")
def f09(spark: SparkSession, d: str) -> DataFrame:
    m = spark.read.parquet(f"{d}/customer.parquet").select(F.col("c_custkey").alias("source_id"), F.col("c_nationkey").cast("long").alias("k"))
    r = spark.read.parquet(f"{d}/orders.parquet").groupBy(F.col("o_custkey").alias("source_id")).agg(F.min(F.col("o_custkey") % 25).alias("k"))
    return validate.reconcile(m, r, "source_id", ["k"])


@query("f11_cache_rows", f"WITH {_SPARSE}, v AS (SELECT *, ln(least(greatest(p_fake, 0.02::double), 0.98::double) / (1 - least(greatest(p_fake, 0.02::double), 0.98::double))) AS logit FROM sparse) SELECT condition_id, CAST(count(*) FILTER (WHERE abs(1 / (1 + exp(-logit)) - p_fake) > 0.0001) AS bigint) AS off, CAST(count(*) AS bigint) AS n FROM v GROUP BY ALL")
def f11(spark: SparkSession, d: str) -> DataFrame:
    from stresslens.functions import scalars

    v = sparse(spark, d).withColumn("raw", scalars.logit(F.col("p_fake"), 0.02))
    return v.groupBy("condition_id").agg(F.count_if(F.abs(scalars.sigmoid(F.col("raw")) - F.col("p_fake")) > 0.0001).alias("off"), F.count("*").alias("n"))


@query("f13_split_overlap", "SELECT CAST(count(*) AS bigint) AS shared FROM (SELECT DISTINCT l_orderkey FROM lineitem WHERE l_linenumber = 1 INTERSECT SELECT DISTINCT l_orderkey FROM lineitem WHERE l_linenumber = 2)")
def f13(spark: SparkSession, d: str) -> DataFrame:
    line = spark.read.parquet(f"{d}/lineitem.parquet")
    a, b = (line.where(F.col("l_linenumber") == i).select("l_orderkey") for i in (1, 2))
    return a.intersect(b).agg(F.count("*").alias("shared"))


@query("f14_dev_sufficiency", f"WITH {_SPARSE}, f AS (SELECT part, list(DISTINCT family) AS have FROM sparse JOIN conditions USING (condition_id) WHERE label = 1 GROUP BY part) SELECT part, CAST(len(list_filter(['jpeg', 'blur', 'resize', 'noise', 'color', 'crop'], lambda x: NOT list_contains(have, x))) AS int) AS missing FROM f WHERE missing > 0")
def f14(spark: SparkSession, d: str) -> DataFrame:
    return validate.families_missing(grid.with_family(sparse(spark, d)), ["part"]).select("part", F.size("missing").alias("missing"))


@query("f16_eval_reasons", f"""WITH {_SPARSE} SELECT 'duplicate' AS reason, CAST(count(*) AS bigint) AS n FROM (SELECT 1 FROM sparse GROUP BY source_id, condition_id HAVING count(*) > 1)
UNION ALL SELECT 'no clean view', CAST(count(*) AS bigint) FROM (SELECT 1 FROM sparse GROUP BY source_id HAVING NOT bool_or(condition_id = 'clean')) UNION ALL SELECT 'label', CAST(count(*) AS bigint) FROM sparse WHERE label NOT IN (0, 1) UNION ALL SELECT 'score', CAST(count(*) AS bigint) FROM sparse WHERE NOT (p_fake BETWEEN 0 AND 1)""")
def f16(spark: SparkSession, d: str) -> DataFrame:
    s = sparse(spark, d)
    n = lambda df, name: df.agg(F.count("*").alias("n")).select(F.lit(name).alias("reason"), "n")
    out = n(validate.duplicate_keys(s, ["source_id", "condition_id"]), "duplicate")
    out = out.unionByName(n(validate.grid_coverage(s, ["source_id"], every=False), "no clean view"))
    out = out.unionByName(n(s.where(~F.col("label").isin(0, 1)), "label"))
    return out.unionByName(n(s.where(~validate.probability(F.col("p_fake"))), "score"))


@query("f18_forbidden_token", "SELECT doc_id FROM documents WHERE regexp_matches(text, '(?i)example\\.com') OR regexp_matches(lang, '(?i)example\\.com') OR regexp_matches(source, '(?i)example\\.com')")
def f18(spark: SparkSession, d: str) -> DataFrame:
    return validate.forbidden(spark.read.parquet(f"{d}/documents.parquet"), r"(?i)example\.com", "doc_id")


@query("f21_nonfinite", """SELECT 'l_quantity' AS "column", CAST(count(*) FILTER (WHERE isnan(l_quantity) OR isinf(l_quantity)) AS bigint) AS n FROM lineitem UNION ALL SELECT 'ratio', CAST(count(*) FILTER (WHERE l_discount = 0) AS bigint) FROM lineitem""")
def f21(spark: SparkSession, d: str) -> DataFrame:
    line = spark.read.parquet(f"{d}/lineitem.parquet").select("l_quantity", F.when(F.col("l_discount") == 0, F.lit(float("inf"))).otherwise(F.col("l_tax")).alias("ratio"))
    return validate.non_finite(line)


@query("s17_infer_modes", f"WITH {_SPARSE}, x AS (SELECT CASE WHEN p_fake BETWEEN 0 AND 1 THEN 'ok' ELSE 'error' END AS state, p_fake FROM sparse) SELECT state, CAST(count(*) AS bigint) AS n, round(avg(CASE WHEN state = 'ok' THEN p_fake END), 6) AS mean_pred FROM x GROUP BY ALL")
def s17(spark: SparkSession, d: str) -> DataFrame:
    from stresslens.sources import files

    rows = sparse(spark, d).select("image_path", "p_fake", F.when(~validate.probability(F.col("p_fake")), "score out of range").alias("error"))
    out = files.inference_output(rows, "null")
    return out.groupBy(F.when(F.col("error").isNull(), "ok").otherwise("error").alias("state")).agg(F.count("*").alias("n"), F.round(F.avg("pred"), 6).alias("mean_pred"))


_KEY = "a" * 64
_EV = f"""{_SPARSE}, ev AS (SELECT sample_id, source_id, condition_id, CASE WHEN part % 9 = 0 THEN 'noise' END AS family, label, CASE WHEN part % 50 = 0 THEN 'dev' ELSE 'test' END AS dataset_split,
CASE WHEN part % 40 = 0 THEN 'b' ELSE '{_KEY}' END AS cache_key, CASE WHEN part % 11 > 0 THEN p_fake END AS p, part, p_fake FROM sparse)"""


def _reason(name: str, where: str, example: str = "min(sample_id)", of: str = "ev") -> str:
    return f"SELECT '{name}' AS reason, CAST(count(*) AS bigint) AS n, {example} AS example FROM {of} WHERE {where} HAVING count(*) > 0"


def evaluated(spark: SparkSession, d: str) -> DataFrame:
    """The sparse rows as a cache: some of other splits, keys and families, some without a score."""
    part, p = F.col("part"), F.col("p_fake")
    block = F.struct(F.lit(True).alias("ok"), F.when(part % 11 > 0, p).alias("p_fake"), F.when(part % 13 > 0, F.log(F.greatest(p, F.lit(0.02)) / (1 - F.least(p, F.lit(0.98))))).alias("raw_logit"))
    return sparse(spark, d).select("sample_id", "source_id", "condition_id", F.when(part % 9 == 0, "noise").alias("family"), "label", F.when(part % 50 == 0, "dev").otherwise("test").alias("dataset_split"), F.when(part % 40 == 0, "b").otherwise(_KEY).alias("cache_key"), F.when(part % 17 > 0, F.create_map(F.lit("x"), block)).alias("experts"), "part")


_MANIFEST = {"status": "partial", "may_not_be_used_for_fitting": True, "rows_total": 1000, "n_sources": 10, "experts": ["x@rev1"], "cache_key": _KEY}


@query("f16b_all_reasons", f"""WITH {_EV.replace("part % 11 > 0", "part % 11 > 0 AND part % 17 > 0")}, fam AS (SELECT ev.*, c.family AS own FROM ev JOIN conditions c USING (condition_id)), k AS (SELECT source_id, condition_id, count(*) AS m FROM ev GROUP BY ALL),
s AS (SELECT source_id, count(DISTINCT condition_id) AS c, count(DISTINCT label) AS l FROM ev GROUP BY ALL)
{" UNION ALL ".join([_reason("label", "label NOT IN (0, 1)"), _reason("split", "dataset_split <> 'test'"), _reason("family", "family <> own", of="fam"), _reason("foreign_key", f"cache_key <> '{_KEY}'"), _reason("score_missing", "p IS NULL"), _reason("score_range", "p NOT BETWEEN 0 AND 1"),
_reason("repeated", "m > 1", "min(source_id || ':' || condition_id)", "k"), _reason("incomplete_grid", "c < 20", "min(source_id)", "s"), _reason("label_changes", "l > 1", "min(source_id)", "s")])}
UNION ALL SELECT 'status', 1, 'partial' UNION ALL SELECT 'rows_total', abs(count(*) - 1000), CAST(count(*) AS varchar) FROM ev UNION ALL SELECT 'n_sources', abs(count(*) - 10), CAST(count(*) AS varchar) FROM s UNION ALL SELECT 'revision', 1, 'x@rev1'""")
def f16b(spark: SparkSession, d: str) -> DataFrame:
    return evidence.evaluation_reasons(evaluated(spark, d), _MANIFEST, "x", "rev2")


@query("f11b_cache_reasons", f"""WITH {_EV}, fam AS (SELECT ev.*, c.family AS own FROM ev JOIN conditions c USING (condition_id)),
x AS (SELECT sample_id, p, part % 17 > 0 AS has, CASE WHEN part % 13 > 0 THEN ln(greatest(p_fake, 0.02::double) / (1 - least(p_fake, 0.98::double))) END AS z FROM ev),
s AS (SELECT source_id, count(DISTINCT label) AS l, count(DISTINCT dataset_split) AS d FROM ev GROUP BY ALL)
{" UNION ALL ".join([_reason("label", "label NOT IN (0, 1)"), _reason("cache_key", f"cache_key <> '{_KEY}'"), _reason("split", "dataset_split NOT IN ('train', 'dev')"), _reason("family", "family <> own", of="fam"), _reason("experts", "NOT has", of="x"),
_reason("p_fake", "has AND (p IS NULL OR p NOT BETWEEN 0 AND 1)", of="x"), _reason("raw_logit", "has AND z IS NULL", of="x"), _reason("logit_off", "has AND p BETWEEN 0 AND 1 AND abs(1 / (1 + exp(-z)) - p) > 0.0001", of="x"),
_reason("label_changes", "l > 1", "min(source_id)", "s"), _reason("dataset_split_changes", "d > 1", "min(source_id)", "s")])} UNION ALL SELECT 'several_cache_key', 1, 'b'""")
def f11b(spark: SparkSession, d: str) -> DataFrame:
    return evidence.cache_reasons(evaluated(spark, d), ("x",))


@query("f09b_coverage", f"""WITH {_SPARSE}, v AS (SELECT count(DISTINCT source_id) AS s, count(*) AS r FROM sparse)
SELECT * FROM (SELECT 'expected_source_count' AS reason, '1500' AS expected, CAST(s AS varchar) AS found FROM v UNION ALL SELECT 'expected_view_count', '30000', CAST(s * 20 AS varchar) FROM v UNION ALL SELECT 'successful_view_count', '6000', CAST(r AS varchar) FROM v
UNION ALL SELECT 'failure_count', '24000', '3' UNION ALL SELECT 'denominator', '30000', CAST(s * 20 AS varchar) FROM v UNION ALL SELECT 'failures', '0', '3') WHERE expected <> found""")
def f09b(spark: SparkSession, d: str) -> DataFrame:
    return evidence.coverage_reasons(sparse(spark, d), {"expected_source_count": 1500, "expected_view_count": 30000, "successful_view_count": 6000, "failure_count": 24000}, 3)


def _part(i: int) -> str:
    return f"CAST('0x' || substr(h, {8 * i + 1}, 8) AS bigint)"


_CELLS = ", ".join(f"'{c}:{t}:v' || '{{\"v\":' || to_json({c}) || '}}'" for c, t in (("c_custkey", "bigint"), ("c_mktsegment", "string"), ("c_name", "string"), ("c_nationkey", "int")))


@query("f09c_freeze_digest", f"""WITH h AS (SELECT sha256(to_json([{_CELLS}])) AS h FROM customer),
r AS (SELECT {_part(0)} >> 20 AS r, count(*) AS n, {', '.join(f'CAST(sum({_part(i)}) AS varchar) AS p{i}' for i in range(8))} FROM h GROUP BY 1)
SELECT CAST(sum(n) AS bigint) AS rows, sha256(string_agg(concat_ws(':', r, n, {', '.join(f'p{i}' for i in range(8))}), ';' ORDER BY r)) AS sha256 FROM r""")
def f09c(spark: SparkSession, d: str) -> DataFrame:
    return evidence.digest(spark.read.parquet(f"{d}/customer.parquet").select("c_custkey", "c_name", "c_nationkey", "c_mktsegment"))
