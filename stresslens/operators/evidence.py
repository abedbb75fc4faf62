"""All reasons why a table of rows may not be used, in one row; and digests that bind a table of any size.

Checks of rows and of the whole table are one aggregate over all rows, where they are: a count and one example each, nothing
is sorted or shuffled. Checks of keys and sources read the rows once more, but only their keys and the columns that a source
must not change: those are summed by key where keys are asked for, by source, and to one row. So what rows' checks find isn't
carried through the shuffle by source, and the driver sees one row however many rows are bad.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stresslens.functions import scalars
from stresslens.operators.grid import CONDITIONS
from stresslens.operators.validate import family_of, nonempty, probability

NAMES = [c for c, *_ in CONDITIONS]
#: How a cache key looks, the splits there are, and how far a logit may be from its probability.
CACHE_KEY, SPLITS, TOLERANCE = "^[0-9a-f]{64}$", ("train", "dev", "test"), 1e-4


@dataclass
class Checks:
    """rows: true for a good row. constant: columns that a source must not change. single: columns with one value in the
    whole table. counted: rows that are told but are no fault. Null is a failure of a row check."""

    rows: dict[str, Column]
    constant: tuple[str, ...] = ()
    single: tuple[str, ...] = ()
    counted: dict[str, Column] = field(default_factory=dict)
    unique: bool = True
    complete: bool = True


def summary(rows: DataFrame, checks: Checks, source: str = "source_id", condition: str = "condition_id", example: str = "sample_id") -> DataFrame:
    """One row: rows, sources, the number n_ and an example e_ of each reason, c_ of what is counted, and least and greatest of single columns (l_, g_).

    Rows without a source or a condition are one source, or one condition of theirs. An empty table gives zeros.
    """
    bad = {k: ~F.coalesce(c, F.lit(False)) for k, c in checks.rows.items()}
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("\0"))
    # each check is worked out once a row, for its count and its example
    marks = rows.select(F.col(example).cast("string").alias("example"), *[c.alias(f"b_{k}") for k, c in bad.items()], *[F.coalesce(c, F.lit(False)).alias(f"c_{k}") for k, c in checks.counted.items()], *[text(c).alias(f"s_{c}") for c in checks.single])
    whole = [F.count("*").alias("rows")]
    whole += [x for k in bad for x in (F.count_if(f"b_{k}").alias(f"n_{k}"), F.min(F.when(F.col(f"b_{k}"), F.col("example"))).alias(f"e_{k}"))]
    whole += [F.count_if(f"c_{k}").alias(f"c_{k}") for k in checks.counted]
    whole += [x for c in checks.single for x in (F.min(f"s_{c}").alias(f"l_{c}"), F.max(f"s_{c}").alias(f"g_{c}"))]

    keys = rows.select(F.col(source).alias("source"), F.col(condition).alias("condition"), *[text(c).alias(f"{e}_{c}") for c in checks.constant for e in "lg"])
    ends = [x for c in checks.constant for x in (F.min(f"l_{c}").alias(f"l_{c}"), F.max(f"g_{c}").alias(f"g_{c}"))]
    carried, found, of = [], [], {}
    if checks.unique or checks.complete:
        keys = keys.groupBy("source", "condition").agg(F.count("*").alias("rows"), *ends)
    if checks.unique:
        again = F.col("rows") > 1
        found += [F.count_if(again).alias("n_repeated"), F.min(F.when(again, F.concat_ws(":", "source", "condition"))).alias("e_repeated")]
        carried += [F.sum("n_repeated").alias("n_repeated"), F.min("e_repeated").alias("e_repeated")]
    if checks.complete:
        found += [F.count_if(F.col("condition").isin(NAMES)).alias("conditions")]
        of["incomplete_grid"] = F.col("conditions") < len(NAMES)
    of |= {f"{c}_changes": F.col(f"l_{c}") != F.col(f"g_{c}") for c in checks.constant}
    name = F.coalesce(F.col("source").cast("string"), F.lit(""))
    carried += [x for k, c in of.items() for x in (F.count_if(c).alias(f"n_{k}"), F.min(F.when(c, name)).alias(f"e_{k}"))]
    # a source is one row even where nothing is asked of it
    sources = keys.groupBy("source").agg(*found, *ends, F.lit(1).alias("one")).agg(F.count("*").alias("sources"), *carried)
    one = marks.agg(*whole).crossJoin(F.broadcast(sources))  # one row
    return one.select(*[F.coalesce(F.col(c), F.lit(0)).alias(c) if c[:2] in ("n_", "c_") or c in ("rows", "sources") else F.col(c) for c in one.columns])


def reasons(one: DataFrame, checks: Checks, also: dict[str, tuple[Column, Column]] | None = None) -> DataFrame:
    """reason, n, example of all that was found in a summary. also: more reasons, as number and example, over the summary's columns."""
    found = {c[2:]: (F.col(c), F.col(f"e_{c[2:]}")) for c in one.columns if c.startswith("n_")}
    found |= {f"several_{c}": ((F.col(f"l_{c}") != F.col(f"g_{c}")).cast("long"), F.col(f"g_{c}")) for c in checks.single}
    found |= also or {}
    each = F.array(*[F.struct(F.lit(k).alias("reason"), F.coalesce(n.cast("long"), F.lit(0)).alias("n"), e.cast("string").alias("example")) for k, (n, e) in found.items()])
    return one.select(F.explode(each).alias("x")).select("x.*").where("n > 0")


def expert_checks(experts: tuple[str, ...]) -> tuple[dict[str, Column], Column]:
    """Checks of `experts` (a map of name to ok, p_fake, raw_logit), and whether any of them answered."""
    e = {x: F.col("experts")[x] for x in experts}
    on = {x: F.coalesce(b["ok"], F.lit(True)) & b.isNotNull() for x, b in e.items()}
    finite = lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))
    every = lambda f: reduce(Column.__and__, [~on[x] | F.coalesce(f(b), F.lit(False)) for x, b in e.items()], F.lit(True))
    near = lambda b: ~(probability(b["p_fake"]) & finite(b["raw_logit"])) | (F.abs(scalars.sigmoid(b["raw_logit"]) - b["p_fake"]) <= TOLERANCE)
    answered = reduce(Column.__or__, on.values(), F.lit(False))
    return {"experts": F.col("experts").isNotNull(), "ok_missing": every(lambda b: b["ok"].isNotNull()), "p_fake": every(lambda b: probability(b["p_fake"])), "raw_logit": every(lambda b: finite(b["raw_logit"])), "logit_off": every(near)}, answered


def cache_checks(experts: tuple[str, ...]) -> Checks:
    """What a cache to fit on must hold; rows that no expert answered are counted, not refused."""
    of, answered = expert_checks(experts)
    rows = {
        "source_id": nonempty(F.col("source_id")),
        "label": F.col("label").isin(0, 1),
        "cache_key": F.col("cache_key").rlike(CACHE_KEY),
        "split": F.col("dataset_split").isin("train", "dev"),
        "condition": F.col("condition_id").isin(NAMES),
        "family": F.col("family").isNull() | (F.col("family") == family_of()),
        **of,
    }
    return Checks(rows, ("label", "dataset_split"), ("cache_key",), {"no_expert": F.col("experts").isNotNull() & ~F.coalesce(answered, F.lit(False))}, unique=False, complete=False)


def cache_reasons(rows: DataFrame, experts: tuple[str, ...]) -> DataFrame:
    """reason, n, example for each fault of a cache; `excluded` says how many rows no expert answered, and is no fault."""
    checks = cache_checks(experts)
    one = summary(rows, checks)
    return reasons(one, checks, {"excluded": (F.col("c_no_expert"), F.lit(None)), "no_rows": ((F.col("rows") == 0).cast("long"), F.lit(None))})


def usable(rows: DataFrame, experts: tuple[str, ...]) -> DataFrame:
    """The rows that at least one expert answered."""
    return rows.where(expert_checks(experts)[1])


def evaluation_reasons(rows: DataFrame, manifest: dict, expert: str, revision: str) -> DataFrame:
    """reason, n, example: every reason why rows under a manifest may not make a headline."""
    block = F.col("experts")[expert]
    checks = Checks(
        {
            "label": F.col("label").isin(0, 1),
            "split": F.col("dataset_split") == "test",
            "family": F.col("family").isNull() | (F.col("family") == "") | (F.col("family") == family_of()),
            "foreign_key": F.col("cache_key") == manifest.get("cache_key") if manifest.get("cache_key") else F.lit(True),
            "score_missing": block["p_fake"].isNotNull(),
            "score_range": block["p_fake"].isNull() | probability(block["p_fake"]),
        },
        ("label",),
    )
    one, declared = summary(rows, checks), [str(e) for e in manifest.get("experts") or []]
    told = lambda bad, value: (F.lit(int(bad)), F.lit(None if value is None else str(value)))
    claim = lambda key, column: (F.lit(0), F.lit(None)) if manifest.get(key) is None else (F.abs(F.col(column) - int(manifest[key])), F.col(column))
    return reasons(one, checks, {
        "status": told(manifest.get("status") != "complete", manifest.get("status")),
        "may_be_fitted_on": told(manifest.get("may_not_be_used_for_fitting") is not True, manifest.get("may_not_be_used_for_fitting")),
        "rows_total": claim("rows_total", "rows"),
        "n_sources": claim("n_sources", "sources"),
        "expert": told(not any(e.startswith(expert) for e in declared), ", ".join(declared)),
        "revision": told(not any(revision in e for e in declared), ", ".join(declared)),
        "no_key": told(not manifest.get("cache_key"), None),
    })


def digest(rows: DataFrame, bits: int = 12) -> DataFrame:
    """rows and sha256 of a table, whatever its order, partitions or the order of its columns; any changed cell or repeated row changes it.

    A row's digest is that of its cells by column name, with their types and with null told from text. Rows go into
    2**bits ranges by their digest; a range sums its digests in pieces of 32 bits that keep every carry, and the ranges'
    sums, counts and numbers are digested in order. Nothing is sorted; the ranges are what the driver's task sees.
    """
    cell = lambda c: F.concat_ws(":", F.lit(c), F.lit(rows.schema[c].dataType.simpleString()), F.when(F.col(q(c)).isNull(), "n").otherwise(F.concat(F.lit("v"), F.to_json(F.struct(F.col(q(c)).alias("v"))))))
    q = lambda c: "`" + c.replace("`", "``") + "`"
    whole = F.sha2(F.to_json(F.array(*[cell(c) for c in sorted(rows.columns)])), 256)
    d = rows.select(whole.alias("h"))
    piece = lambda i: F.conv(F.substring("h", 8 * i + 1, 8), 16, 10).cast("long")
    ranges = d.select(F.shiftright(piece(0), 32 - bits).alias("r"), *[piece(i).alias(f"p{i}") for i in range(8)]).groupBy("r").agg(F.count("*").alias("n"), *[F.sum(F.col(f"p{i}").cast("decimal(38,0)")).alias(f"p{i}") for i in range(8)])
    line = F.concat_ws(":", "r", "n", *[F.col(f"p{i}").cast("string") for i in range(8)])
    one = ranges.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("rows"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("r", line.alias("l")))), lambda x: x["l"]), ";").alias("x"))
    return one.select("rows", F.sha2("x", 256).alias("sha256"))


def frozen(rows: DataFrame, bits: int = 12) -> dict:
    """What a freeze says of a table."""
    r = digest(rows, bits).first()
    return {"rows": r.rows, "sha256": r.sha256}


def coverage_reasons(rows: DataFrame, coverage: dict, failures: int, freeze: dict | None = None) -> DataFrame:
    """reason, expected, found: where a run's manifest and its rows don't add up.

    expected views are sources x methods x conditions; successes are rows; failures are the ledger's; successes and
    failures make the expected views, and a headline has no failures. freeze: what frozen() said of the rows.
    """
    s = rows.groupBy("source_id", "method_id").agg(F.count("*").alias("n"))
    by_source = s.groupBy("source_id").agg(F.sum("n").alias("n"), F.collect_set("method_id").alias("m"))
    one = by_source.agg(F.count("*").alias("sources"), F.coalesce(F.sum("n"), F.lit(0)).alias("rows"), F.size(F.array_distinct(F.flatten(F.collect_set("m")))).alias("methods"))
    views = F.col("sources") * F.col("methods") * len(NAMES)
    claims = {
        "expected_source_count": (coverage.get("expected_source_count"), F.col("sources")),
        "expected_view_count": (coverage.get("expected_view_count"), views),
        "successful_view_count": (coverage.get("successful_view_count"), F.col("rows")),
        "failure_count": (coverage.get("failure_count"), F.lit(failures)),
        "denominator": ((coverage.get("successful_view_count") or 0) + (coverage.get("failure_count") or 0), views),
        "failures": (0, F.lit(failures)),
    }
    each = F.array(*[F.struct(F.lit(k).alias("reason"), F.lit(e).cast("string").alias("expected"), f.cast("string").alias("found")) for k, (e, f) in claims.items()])
    out = one.select(F.explode(each).alias("x")).select("x.*")
    if freeze is not None:
        d = digest(rows)
        out = out.unionByName(d.select(F.lit("freeze_rows").alias("reason"), F.lit(str(freeze.get("rows"))).alias("expected"), F.col("rows").cast("string").alias("found")))
        out = out.unionByName(d.select(F.lit("freeze_digest").alias("reason"), F.lit(freeze.get("sha256")).alias("expected"), F.col("sha256").alias("found")))
    return out.where(~F.col("expected").eqNullSafe(F.col("found")))
