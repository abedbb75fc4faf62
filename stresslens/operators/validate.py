"""Row contracts that fail closed: every breach is a row of a violations table; raise_if() refuses what has any."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stresslens.operators.grid import CONDITIONS, FAMILIES, conditions

ROW_VERSION = "prediction-row.v1"
SHA256 = "^[0-9a-f]{64}$"
_NAMES = [c for c, *_ in CONDITIONS]


class ContractError(ValueError):
    """Rows break their contract; says how, how often and with an example."""


def probability(c: Column) -> Column:
    """Finite and from 0 to 1. NaN is greater than every number here, so it is asked for by name."""
    return c.isNotNull() & ~F.isnan(c) & c.between(0.0, 1.0)


def nonempty(c: Column) -> Column:
    return F.coalesce(F.length(c) > 0, F.lit(False))


def breaches(rows: DataFrame, checks: dict[str, Column], example: str) -> DataFrame:
    """reason, n, example for each check that any row fails. A check that is null counts as failed."""
    found = F.array_compact(F.array(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in checks.items()]))
    return rows.select(F.explode(found).alias("reason"), F.col(example).alias("e")).groupBy("reason").agg(F.count("*").alias("n"), F.min("e").alias("example"))


def family_of(condition: str = "condition_id") -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for c, f, *_ in CONDITIONS for x in (c, f)]), F.col(condition))


def prediction_checks(columns: list[str]) -> dict[str, Column]:
    """columns: those that the rows have; a family may be left out, but one that is given must be the condition's."""
    optional = lambda c: F.col(c).isNull() | probability(F.col(c))
    return {
        "schema_version": F.col("schema_version") == ROW_VERSION,
        **{c: nonempty(F.col(c)) for c in ("run_id", "method_id", "sample_id", "source_id", "image_path", "dataset", "source_group")},
        "content_sha256": F.col("content_sha256").rlike(SHA256),
        "label": F.col("label").isin(0, 1),
        "condition_id": F.col("condition_id").isin(_NAMES),
        "p_fake": probability(F.col("p_fake")),
        "reliability": optional("reliability"),
        "inference_ms": F.col("inference_ms").isNull() | (~F.isnan("inference_ms") & (F.col("inference_ms") >= 0) & (F.col("inference_ms") < float("inf"))),
        "warnings": F.col("warnings").isNotNull() & F.coalesce(F.forall("warnings", lambda x: x.isNotNull()), F.lit(False)),
        **({"family": F.col("family").isNull() | (F.col("family") == family_of())} if "family" in columns else {}),
        "expert_failures": F.col("expert_failures").isNull() | F.forall("expert_failures", lambda x: nonempty(x["expert_id"]) & nonempty(x["reason_code"])),
    }


def row_violations(rows: DataFrame) -> DataFrame:
    return breaches(rows, prediction_checks(rows.columns), "sample_id")


def duplicate_keys(rows: DataFrame, keys: list[str]) -> DataFrame:
    return rows.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def dependency(rows: DataFrame, key: list[str], determines: list[str]) -> DataFrame:
    """Keys that don't determine the columns they should. Compares two ends of an order instead of gathering a set."""
    s = F.struct(*[F.coalesce(F.col(c).cast("string"), F.lit("\0")).alias(c) for c in determines])
    return rows.groupBy(*key).agg(F.min(s).alias("a"), F.max(s).alias("b")).where("a <> b").select(*key)


def grid_coverage(rows: DataFrame, keys: list[str], every: bool = True) -> DataFrame:
    """Keys without a clean view, or, if every, with fewer than all conditions: what is missing."""
    need = F.array(*[F.lit(n) for n in (_NAMES if every else ["clean"])])
    g = rows.groupBy(*keys).agg(F.collect_set("condition_id").alias("c"))
    return g.select(*keys, F.size(F.array_except(need, "c")).alias("missing"), F.array_contains("c", "clean").alias("has_clean")).where("missing > 0")


def one_class_only(rows: DataFrame, by: list[str]) -> DataFrame:
    return rows.groupBy(*by).agg(F.min("label").alias("a"), F.max("label").alias("b")).where("a = b").select(*by)


def headline_gaps(rows: DataFrame) -> DataFrame:
    """The views of the full product of methods, sources and conditions that no row has."""
    spark = rows.sparkSession
    sources = rows.select("source_id").distinct()
    methods = rows.select("method_id").distinct()
    full = sources.crossJoin(F.broadcast(conditions(spark).select("condition_id"))).crossJoin(F.broadcast(methods))
    return full.join(rows.select("method_id", "source_id", "condition_id").distinct(), ["method_id", "source_id", "condition_id"], "left_anti")


def reconcile(manifest: DataFrame, rows: DataFrame, key: str, same: list[str]) -> DataFrame:
    """status and count of a manifest's keys against the rows': missing, extra, different, equal."""
    m = manifest.select(F.col(key), F.lit(1).alias("_m"), *[F.col(c).alias(f"_m_{c}") for c in same])
    r = rows.select(F.col(key), F.lit(1).alias("_r"), *[F.col(c).alias(f"_r_{c}") for c in same])
    equal = F.lit(True)
    for c in same:
        equal &= F.col(f"_m_{c}").eqNullSafe(F.col(f"_r_{c}"))
    status = F.when(F.col("_r").isNull(), "missing").when(F.col("_m").isNull(), "extra").when(equal, "equal").otherwise("different")
    return m.join(r, key, "full_outer").groupBy(status.alias("status")).agg(F.count("*").alias("n"))


def forbidden(rows: DataFrame, pattern: str, key: str) -> DataFrame:
    """Rows that hold a pattern anywhere, in nested values too."""
    return rows.where(F.to_json(F.struct("*")).rlike(pattern)).select(key)


def non_finite(rows: DataFrame) -> DataFrame:
    """column and count of values that are NaN or infinite, for every floating column, in one pass."""
    names = [n for n, t in rows.dtypes if t in ("double", "float")]
    bad = rows.agg(*[F.count_if(F.isnan(c) | (F.abs(F.col(c)) == float("inf"))).alias(c) for c in names])
    return bad.unpivot([], names, "column", "n")


def families_missing(rows: DataFrame, by: list[str]) -> DataFrame:
    """Families without a positive: a threshold can't be chosen on such rows."""
    need = F.array(*[F.lit(f) for f in FAMILIES])
    return rows.where("label = 1").groupBy(*by).agg(F.array_except(need, F.collect_set("family")).alias("missing")).where(F.size("missing") > 0)


def raise_if(violations: DataFrame, what: str) -> None:
    """Fail with the first few violations, if there are any."""
    some = violations.limit(5).collect()
    if some:
        raise ContractError(f"{what}: " + "; ".join(str(r.asDict()) for r in some))
