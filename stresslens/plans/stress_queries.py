"""Stress records, dumps, response arms, torn JSON lines and the live scorer by name."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stresslens.operators import dedup, features, grid, manifests, operating, response, stress
from stresslens.operators.metrics import r6
from stresslens.operators.shared import folder
from stresslens.plans.corpus_queries import _CL, _FEAT, _SHORT, RADIUS, shortcut_rows, text_hashes
from stresslens.plans.feature_queries import _CACHE, _CELLS38, _STATS4, cache_rows
from stresslens.plans.registry import query
from stresslens.sources import jsonlines
from stresslens.streaming import live

_REC = grid.SQL + """, rec AS (SELECT method_id, source_id, condition_id, idx, source_id * 7 + idx AS k, p FROM pred),
tam AS (SELECT method_id, source_id, condition_id, idx, CASE WHEN k % 67 = 3 THEN 1.5 ELSE p END AS p_fake, CASE WHEN k % 59 = 1 THEN 0.6::double ELSE 0.5::double END AS threshold_used,
  CASE WHEN k % 71 = 5 THEN 'REAL' WHEN (p >= 0.5) <> (k % 53 = 0) THEN 'fake' ELSE 'real' END AS decision, CASE WHEN k % 61 = 2 THEN ' ' WHEN k % 73 = 4 THEN 'dev-2' ELSE 'dev-1' END AS threshold_provenance FROM rec),
own AS (SELECT *, CASE WHEN NOT (p_fake BETWEEN 0 AND 1) THEN 'p_fake' WHEN decision NOT IN ('real', 'fake') THEN 'decision' WHEN (decision = 'fake') <> (p_fake >= threshold_used) THEN 'inconsistent' WHEN trim(threshold_provenance) = '' THEN 'provenance' END AS own FROM tam),
chk AS (SELECT o.*, CASE WHEN c.own IS NULL THEN c.p_fake END AS clean_p, CASE WHEN c.own IS NULL THEN c.decision END AS clean_decision,
  coalesce(o.own, CASE WHEN c.own IS NOT NULL THEN 'clean' WHEN abs(o.threshold_used - c.threshold_used) > 1e-12 THEN 'threshold differs' WHEN o.threshold_provenance <> c.threshold_provenance THEN 'provenance differs' END) AS error
  FROM own o JOIN own c ON c.condition_id = 'clean' AND o.method_id = c.method_id AND o.source_id = c.source_id)"""


def records(spark: SparkSession, d: str) -> DataFrame:
    """Stress records of all orders; some say a score, a threshold, a decision or a provenance that can't be."""
    k = F.col("source_id") * 7 + F.col("idx")
    p = F.col("p")
    decision = F.when(k % 71 == 5, "REAL").when((p >= 0.5) != (k % 53 == 0), "fake").otherwise("real")
    provenance = F.when(k % 61 == 2, " ").when(k % 73 == 4, "dev-2").otherwise("dev-1")
    return grid.predictions(spark, d).select("method_id", "source_id", "condition_id", F.when(k % 67 == 3, 1.5).otherwise(p).alias("p_fake"), decision.alias("decision"), F.when(k % 59 == 1, 0.6).otherwise(0.5).alias("threshold_used"), provenance.alias("threshold_provenance"))


@query("f26_stress_records", f"WITH {_REC} SELECT method_id, condition_id, coalesce(error, 'score') AS told, CAST(count(*) AS bigint) AS n FROM chk GROUP BY ALL")
def f26(spark: SparkSession, d: str) -> DataFrame:
    return stress.checked(records(spark, d)).groupBy("method_id", "condition_id", F.coalesce("error", F.lit("score")).alias("told")).agg(F.count("*").alias("n"))


@query("a31b_stress_status", f"""WITH {_REC}, s AS (SELECT method_id, source_id, max(clean_decision) AS clean, count(*) FILTER (WHERE error IS NULL) AS n_scored, count(*) FILTER (WHERE error IS NULL AND decision <> clean_decision) AS n_flips,
round(coalesce(max(p_fake) FILTER (WHERE error IS NULL) - min(p_fake) FILTER (WHERE error IS NULL), 0), 6) AS spread FROM chk GROUP BY ALL)
SELECT method_id, CASE WHEN clean IS NULL THEN 'refused' WHEN n_scored < 20 THEN 'incomplete' WHEN n_flips > 0 THEN 'unstable' ELSE 'stable' END AS status, CAST(count(*) AS bigint) AS n, CAST(sum(20 - n_scored) AS bigint) AS errors, CAST(sum(n_flips) AS bigint) AS flips, round(max(spread), 6) AS widest FROM s GROUP BY ALL""")
def a31b(spark: SparkSession, d: str) -> DataFrame:
    s = stress.summary(stress.checked(records(spark, d)))
    return s.groupBy("method_id", "status").agg(F.count("*").alias("n"), F.sum("n_errors").cast("long").alias("errors"), F.sum(F.size("flips")).cast("long").alias("flips"), F.max("spread").alias("widest"))


_DUMP = grid.SQL + """, dump AS (SELECT sha256(CAST(source_id AS varchar)) AS sha256, condition_id, label, CASE WHEN source_id % 31 = 0 THEN '' ELSE 'g' || (source_id % 5) END AS grp, CAST(source_id % 23 AS int) AS file_multiplicity,
CASE WHEN source_id % 29 = 0 THEN 2 ELSE p END AS p_fake, reliability, (source_id + idx) % 37 > 0 AS ok FROM pred WHERE method_id = 'm1' AND NOT (condition_id = 'jpeg_q50' AND label = 1) AND condition_id <> 'crop_0.8'),
told AS (SELECT *, CASE WHEN NOT ok THEN 'failed' WHEN grp = '' THEN 'group' WHEN file_multiplicity < 1 THEN 'file_multiplicity' WHEN p_fake > 1 THEN 'p_fake' END AS reason FROM dump),
strata AS (SELECT c.condition_id, count(*) FILTER (WHERE label = 1) AS pos, count(*) FILTER (WHERE label = 0) AS neg FROM conditions c LEFT JOIN (SELECT * FROM told WHERE reason IS NULL) t ON c.condition_id = t.condition_id GROUP BY ALL)"""


@query("f17_dump_faults", f"""WITH {_DUMP} SELECT reason, CAST(count(*) AS bigint) AS n, min(sha256) AS example FROM told WHERE reason IS NOT NULL GROUP BY 1
UNION ALL SELECT CASE WHEN pos = 0 THEN 'no positive' ELSE 'no negative' END, CAST(count(*) AS bigint), min(condition_id) FROM strata WHERE pos = 0 OR neg = 0 GROUP BY 1""")
def f17(spark: SparkSession, d: str) -> DataFrame:
    """A dump of all orders with faults of most kinds, one condition without positives and one that isn't there."""
    s = F.col("source_id")
    p = grid.predictions(spark, d).where("method_id = 'm1' and not (condition_id = 'jpeg_q50' and label = 1) and condition_id <> 'crop_0.8'")
    return manifests.dump_faults(p.select(
        F.sha2(s.cast("string"), 256).alias("sha256"), "condition_id", "label", F.when(s % 31 == 0, "").otherwise(F.concat(F.lit("g"), (s % 5).cast("string"))).alias("group"), (s % 23).cast("int").alias("file_multiplicity"),
        F.when(s % 29 == 0, 2.0).otherwise(F.col("p")).alias("p_fake"), "reliability", F.lit(None).cast("double").alias("primary_p_fake"), ((s + F.col("idx")) % 37 > 0).alias("ok")))


@query("f29_provenance", "SELECT o_orderpriority AS provenance, CASE WHEN o_orderkey % 3 = 0 THEN 'Placeholder ' || o_orderstatus WHEN o_orderkey % 3 = 1 THEN ' unspecified' ELSE o_orderpriority END AS told, o_orderkey % 3 = 2 AS frozen, CAST(count(*) AS bigint) AS n FROM orders GROUP BY ALL")
def f29(spark: SparkSession, d: str) -> DataFrame:
    o, k = spark.read.parquet(f"{d}/orders.parquet"), F.col("o_orderkey") % 3
    told = F.when(k == 0, F.concat(F.lit("Placeholder "), "o_orderstatus")).when(k == 1, " unspecified").otherwise(F.col("o_orderpriority"))
    return o.select(F.col("o_orderpriority").alias("provenance"), told.alias("told"), operating.frozen(told).alias("frozen")).groupBy("provenance", "told", "frozen").agg(F.count("*").alias("n"))


@query("o03_largest_clusters", f"WITH RECURSIVE {_CL} SELECT cluster, CAST(count(*) AS bigint) AS n FROM cl GROUP BY 1")
def o03(spark: SparkSession, d: str) -> DataFrame:
    return dedup.largest_first(dedup.near_clusters(text_hashes(spark, d), RADIUS))


@query("o04_most_telling", f"""WITH {_SHORT}, u AS (UNPIVOT sh ON n_chars, n_words, n_lines INTO NAME feature VALUE v), s AS (SELECT feature, avg(v) FILTER (WHERE label = 0) AS m0, avg(v) FILTER (WHERE label = 1) AS m1, stddev_pop(v) FILTER (WHERE label = 0) AS s0, stddev_pop(v) FILTER (WHERE label = 1) AS s1 FROM u GROUP BY feature)
SELECT feature, round((m1 - m0) / CASE WHEN sqrt((s0 * s0 + s1 * s1) / 2) > 0 THEN sqrt((s0 * s0 + s1 * s1) / 2) ELSE 1 END, 6) AS smd FROM s""")
def o04(spark: SparkSession, d: str) -> DataFrame:
    return dedup.most_telling(dedup.class_stats(shortcut_rows(spark, d), list(_FEAT))).select("feature", "smd")


_SIG = f"""{_CACHE}, dl AS (SELECT *, list_transform(v, lambda x: ln(x / (1 - x)) - z) AS dd FROM c WHERE ok),
sig AS (SELECT vec_id, z, q, list_concat(dd, [list_avg(dd), list_stddev_pop(dd), list_max(list_transform(dd, lambda x: abs(x))), list_max(dd) - list_min(dd), {_STATS4[1]}, {_STATS4[2]}, {_STATS4[3]}, {_STATS4[0]} - p]) AS r FROM dl)"""


def _signed(spark: SparkSession, d: str) -> DataFrame:
    """vec_id, base, quality, response of the rows whose expert and probes all answered; quality numbers that are missing are 0."""
    a, b = F.col("experts")["e"], F.col("probes")["e"]
    rows = cache_rows(spark, d).where(response.usable(a, b, 3))
    q = F.array(*[F.coalesce(F.col("quality")[n], F.lit(0.0)) for n in features.QUALITY])
    return rows.select("vec_id", a["raw_logit"].alias("base"), q.alias("quality"), response.signature(a, b, [f"probe{i}" for i in range(3)]).alias("response"))


@query("p16_response", f"WITH {_SIG} SELECT vec_id, CAST(i - 1 AS int) AS i, round(r[i], 6) AS x FROM sig, range(1, 12) t(i)")
def p16(spark: SparkSession, d: str) -> DataFrame:
    return _signed(spark, d).select("vec_id", F.posexplode("response").alias("i", "x")).select("vec_id", "i", r6("x").alias("x"))


_Q8 = "list_transform(q, lambda x: CASE WHEN x > 0 THEN x ELSE 0 END)"
_ARMS = {"A": "[z]", "A2": "[z]", "B": f"list_concat([z], {_Q8})", "C": f"list_concat([z], {_Q8}, r)", "D": "list_concat([z], r)", "Q": _Q8}


@query("p17_arms", f"WITH {_SIG}, a AS ({' UNION ALL '.join(f'''SELECT '{k}' AS arm, {v} AS f FROM sig''' for k, v in _ARMS.items())}) SELECT arm, CAST(len(f) AS int) AS width, CAST(count(*) AS bigint) AS n, round(sum(list_sum(f)), 3) AS total FROM a GROUP BY ALL")
def p17(spark: SparkSession, d: str) -> DataFrame:
    arms = F.explode(F.array(*[F.struct(F.lit(k).alias("arm"), response.arm(k, F.col("base"), F.col("quality"), F.col("response")).alias("f")) for k in response.ARMS])).alias("x")
    s = _signed(spark, d).select(arms).select("x.*").withColumn("s", F.aggregate("f", F.lit(0.0), lambda t, x: t + x))
    return s.groupBy("arm", F.size("f").alias("width")).agg(F.count("*").alias("n"), F.round(F.sum("s"), 3).alias("total"))


@query("p20_readings", f"WITH {grid.SQL} SELECT condition_id, method_id, " + "CASE WHEN a >= 0.95 THEN 'near-perfect separability' WHEN a >= 0.8 THEN 'strong separability' WHEN a >= 0.65 THEN 'moderate separability, clearly above chance' WHEN a >= 0.55 THEN 'weak separability, modestly above chance' ELSE 'at chance' END AS reading FROM (SELECT method_id, condition_id, (sum(CASE WHEN label = 1 THEN r END) - count(*) FILTER (WHERE label = 1) * (count(*) FILTER (WHERE label = 1) + 1) / 2.0::double) / (count(*) FILTER (WHERE label = 1) * CAST(count(*) FILTER (WHERE label = 0) AS double)) AS a FROM (SELECT method_id, condition_id, label, rank() OVER (PARTITION BY method_id, condition_id ORDER BY p) + (count(*) OVER (PARTITION BY method_id, condition_id, p) - 1) / 2.0::double AS r FROM pred) GROUP BY ALL)")
def p20(spark: SparkSession, d: str) -> DataFrame:
    from stresslens.operators import metrics

    a = metrics.auroc(grid.predictions(spark, d), ["method_id", "condition_id"])
    return a.select("condition_id", "method_id", response.reading(F.col("auroc")).alias("reading"))


_CLICK = T.StructType([T.StructField("cache_key", T.StringType()), T.StructField("schema_version", T.StringType()), T.StructField("kind", T.StringType()), T.StructField("value", T.DoubleType())])


@query("s16_recovered", "SELECT kind, CAST(count(*) AS bigint) AS n, CAST(count(value) AS bigint) AS valued, CAST(sum(CAST(round(value * 100) AS bigint)) AS bigint) AS cents FROM clicks WHERE NOT coalesce(arrived_at > ts + INTERVAL 10 MINUTE, false) GROUP BY 1")
def s16(spark: SparkSession, d: str) -> DataFrame:
    """Clicks as files of JSON lines whose late ones, at each file's end, were cut short; what the reader still takes."""
    c = spark.read.parquet(f"{d}/clicks.parquet").select("ts", "arrived_at", "kind", "value")
    late = F.coalesce(F.col("arrived_at") > F.col("ts") + F.expr("interval 10 minutes"), F.lit(False))
    whole = F.to_json(F.struct(F.lit("k").alias("cache_key"), F.lit("s1").alias("schema_version"), "kind", "value"))
    path = folder(spark, "clicks")
    c.select(late.alias("late"), F.when(late, F.substring(whole, 1, 25)).otherwise(whole).alias("line")).sortWithinPartitions("late").select("line").write.text(path)
    rows = jsonlines.resume(spark, path, _CLICK, "k", "s1").rows
    return rows.groupBy("kind").agg(F.count("*").alias("n"), F.count("value").alias("valued"), F.sum(F.round(F.col("value") * 100).cast("long")).alias("cents"))


_W38 = [0.03 * (i % 5 - 2) for i in range(38)]
_LIVE = f"x AS (SELECT vec_id, ok, i, (CAST(x AS double) - 0.1::double) / 2 AS x FROM c, LATERAL (VALUES {_CELLS38}) t(i, x)), w AS (SELECT * FROM (VALUES {', '.join(f'({i}, CAST({w} AS double))' for i, w in enumerate(_W38))}) t(i, w)), y AS (SELECT vec_id, bool_and(ok) AS ok, 1 / (1 + exp(-(0.25 + sum(x * w)))) AS p, 1 / (1 + exp(-(0.5 - 0.05 * sum(x)))) AS r FROM x JOIN w USING (i) GROUP BY vec_id)"


@query("m20_live", f"WITH {_CACHE}, {_LIVE} SELECT vec_id, CAST(2 AS bigint) AS version, CASE WHEN ok THEN round(p, 6) END AS p_fake, CASE WHEN ok THEN round(r, 6) END AS reliability, coalesce(ok AND r < 0.5, false) AS abstain, CASE WHEN ok AND r >= 0.5 THEN CASE WHEN p >= 0.5 THEN 'fake' ELSE 'real' END END AS decision, CASE WHEN NOT ok THEN 'no expert answered' END AS error FROM y")
def m20(spark: SparkSession, d: str) -> DataFrame:
    """All embeddings as cache rows, streamed through the newest of two published models."""
    names = features.feature_names(["e"])
    base = dict(experts=["e"], features=names, mean=[0.1] * 38, scale=[2.0] * 38, weights=_W38, threshold=0.5)
    models, source, out, state = (folder(spark, n) for n in ("models", "cache", "scores", "state"))
    live.publish(spark, models, live.Model(version=1, bias=-4.0, **base))
    live.publish(spark, models, live.Model(version=2, bias=0.25, reliability_weights=[-0.05] * 38, reliability_bias=0.5, abstain_below=0.5, **base))
    rows = cache_rows(spark, d)
    rows.write.parquet(source)
    stream = spark.readStream.schema(rows.schema).parquet(source)
    live.run(stream, models, out, state, ["vec_id"], threshold=0.5).awaitTermination()
    key = rows.select("vec_id").schema.fields[0].dataType.simpleString()
    return live.scored(spark, out, f"vec_id {key}").select("vec_id", "version", r6("p_fake").alias("p_fake"), r6("reliability").alias("reliability"), "abstain", "decision", "error")
