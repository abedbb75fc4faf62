"""Joins and guards between manifests, dumps and rows: what has no partner is told, never dropped in silence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stresslens.operators import validate
from stresslens.operators.grid import CONDITIONS, conditions, md5_int
from stresslens.operators.shared import cut
from stresslens.operators.validate import breaches, probability


def only_in(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """side, n: the distinct keys that one of two tables lacks. Equal sets give no row."""
    one, other = (x.select(*keys).distinct() for x in (a, b))
    left = one.exceptAll(other).select(F.lit("a").alias("side"))
    return left.unionByName(other.exceptAll(one).select(F.lit("b").alias("side"))).groupBy("side").agg(F.count("*").alias("n"))


def rewiring_breaches(roles: DataFrame, canonical: DataFrame) -> DataFrame:
    """reason, n, example: rows without a canonical image, sources with several, and canonical hashes that rows share."""
    sha = canonical.select("source_id", "canonical_sha256")
    j = roles.select("source_id").join(sha, "source_id", "left")
    none = j.where("canonical_sha256 is null").select(F.lit("missing").alias("reason"), "source_id")
    several = sha.groupBy("source_id").count().where("count > 1").select(F.lit("several").alias("reason"), "source_id")
    shared = j.where("canonical_sha256 is not null").groupBy("canonical_sha256").agg(F.min("source_id").alias("source_id"), F.count("*").alias("n")).where("n > 1")
    found = none.unionByName(several).unionByName(shared.select(F.lit("shared hash").alias("reason"), "source_id"))
    return found.groupBy("reason").agg(F.count("*").alias("n"), F.min("source_id").alias("example"))


def rewired(roles: DataFrame, canonical: DataFrame) -> DataFrame:
    """Rows that read their canonical image; what they were acquired as stays in acquired_*. Guard with rewiring_breaches()."""
    was = {"acquired_relative_path": F.col("relative_path"), "acquired_sha256": F.col("original_sha256"), "acquired_phash": F.col("decoded_phash")}
    c = canonical.select("source_id", "canonical_relative_path", "canonical_sha256", "canonical_phash", "phash_shift_from_original")
    j = roles.withColumns(was).drop("relative_path", "original_sha256", "decoded_phash").join(c, "source_id")
    new = {"canonical_relative_path": "relative_path", "canonical_sha256": "original_sha256", "canonical_phash": "decoded_phash", "phash_shift_from_original": "phash_shift_from_acquired"}
    return j.withColumnsRenamed(new)


def with_split(rows: DataFrame, corpus: DataFrame) -> DataFrame:
    """The corpus's split beside each row; rows of sources that it gives no split go."""
    s = corpus.select("source_id", "dataset_split")
    return rows.drop("dataset_split").join(s, "source_id", "left").where(F.length("dataset_split") > 0)


def canonicalised(results: DataFrame, originals: DataFrame, hashes: DataFrame) -> DataFrame:
    """Original rows with their canonical image and how far its hash moved; error says which source has no hash."""
    j = results.join(originals, "source_id").join(hashes.select("source_id", F.col("phash").alias("_h")), "source_id", "left")
    shift = F.bit_count(F.col("_h").bitwiseXOR(F.col("canonical_phash"))).cast("int")
    return j.withColumns({"phash_shift_from_original": shift, "error": F.when(F.col("_h").isNull(), "no hash")}).drop("_h")


#: Rows of a task, about.
TASK = 1 << 18


def sealed_breaches(dump: DataFrame, manifest: DataFrame, same: list[str]) -> DataFrame:
    """reason, n: a dump (sha256, condition_id, same) against a manifest (sha256, same) that has a row for each copy.

    Pairs are there once, hashes are the same set, a row's attributes are its manifest's, and all copies of a hash agree.
    Rows are dealt by hash to tasks of about TASK, and different (hash, attributes) are counted there: no task sorts its rows.
    """
    attributes = F.struct(*[F.col(c) for c in same]).alias("own")
    side = lambda rows, d: rows.select("sha256", F.when(F.col("sha256").isNull(), F.lit(d)).alias("of"), attributes, F.lit(d).alias("d"))
    both = side(dump, 1).unionByName(side(manifest, 0))
    n = max(1, -(-both.count() // TASK))
    kinds = both.repartition(n, "sha256", "of").groupBy("sha256", "of", "own").agg(F.max("d").alias("in_d"), F.min("d").alias("least")).withColumn("in_m", 1 - F.col("least"))
    told = kinds.groupBy("sha256", "of").agg(F.sum("in_m").alias("m"), F.max("in_d").alias("d"), F.count("*").alias("kinds"))
    reason = F.when(F.col("m") == 0, "not in manifest").when(F.col("d") == 0, "not in dump").when(F.col("m") > 1, "copies differ").when(F.col("kinds") > 1, "attributes")
    twice = dump.select("sha256", "condition_id").repartition(n, "sha256", "condition_id").groupBy("sha256", "condition_id").count().where("count > 1").select(F.lit("pair twice").alias("reason"))
    return told.select(reason.alias("reason")).where("reason is not null").unionByName(twice).groupBy("reason").agg(F.count("*").alias("n"))


def dump_checks() -> dict[str, Column]:
    """What each row of a scored dump must hold, by the field that would be at fault."""
    optional = lambda c: F.col(c).isNull() | validate.probability(F.col(c))
    return {
        "sha256": F.col("sha256").rlike(validate.SHA256), "condition_id": F.col("condition_id").isin([c for c, *_ in CONDITIONS]), "group": validate.nonempty(F.col("group")),
        "file_multiplicity": F.col("file_multiplicity") >= 1, "p_fake": validate.probability(F.col("p_fake")), "reliability": optional("reliability"), "primary_p_fake": optional("primary_p_fake"),
    }


def first_fault(checks: dict[str, Column]) -> Column:
    """The name of the first check that a row fails, or null."""
    return F.coalesce(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in checks.items()])


def dump_faults(dump: DataFrame) -> DataFrame:
    """reason, n, example: field errors (each row by its first), failed rows (ok is false), and conditions where a class is missing.

    Strata are those of rows that are fine; a condition without any such row lacks both classes. One aggregate by condition
    and reason is all that is shuffled. An empty dump lacks every condition.
    """
    reason = F.when(~F.coalesce(F.col("ok"), F.lit(True)), F.lit("failed")).otherwise(first_fault(dump_checks()))
    known = F.when(F.col("condition_id").isin([c for c, *_ in CONDITIONS]), F.col("condition_id"))
    few = cut(dump.groupBy(known.alias("condition_id"), reason.alias("reason")).agg(F.count("*").alias("n"), F.min("sha256").alias("example"), F.count_if(F.col("label") == 1).alias("pos"), F.count_if(F.col("label") == 0).alias("neg")))
    fields = few.where("reason is not null").groupBy("reason").agg(F.sum("n").alias("n"), F.min("example").alias("example"))
    seen = conditions(dump.sparkSession).select("condition_id").join(few.where("reason is null"), "condition_id", "left")
    lacking = F.when(F.coalesce("pos", F.lit(0)) == 0, "no positive").when(F.coalesce("neg", F.lit(0)) == 0, "no negative")
    return fields.unionByName(seen.select(lacking.alias("reason"), "condition_id").where("reason is not null").groupBy("reason").agg(F.count("*").alias("n"), F.min("condition_id").alias("example")))


def scored(rows: DataFrame, score: str, ok: str = "ok") -> DataFrame:
    """Rows that have a score and aren't marked as failed; without a mark they count as fine."""
    return rows.where(F.coalesce(F.col(ok), F.lit(True)) & F.col(score).isNotNull())


def deferred(rows: DataFrame, below: float, most: int, seed: int, key: str) -> DataFrame:
    """Rows of a reliability below a bound, and where there are more than most, as many drawn by a seeded hash of the key."""
    order = md5_int(F.concat_ws(":", F.lit(str(seed)), F.col(key).cast("string")))
    return rows.where(F.col("reliability") < below).orderBy(order, F.col(key)).limit(most)


def candidate_breaches(rows: DataFrame, threshold: str) -> DataFrame:
    """Candidate thresholds that aren't finite numbers from 0 to 1."""
    return breaches(rows, {"threshold": probability(F.col(threshold))}, threshold)


def candidates(rows: DataFrame, threshold: str) -> DataFrame:
    """The distinct candidates in order; guard with candidate_breaches()."""
    return rows.select(threshold).distinct().orderBy(threshold)


def smoke_breaches(rows: DataFrame, decoded: DataFrame, licences: list[str]) -> DataFrame:
    """reason, n, example by sample_id: labels and classes, licences, and what the decoded images (sample_id, sha256, width, height, phash) say."""
    names = {f"_{c}": F.col(c) for c in ("sha256", "width", "height", "phash")}
    j = rows.join(decoded.select("sample_id", *[c.alias(n) for n, c in names.items()]), "sample_id", "left")
    checks = {
        "class": F.col("class_name") == F.when(F.col("label") == 0, "real").when(F.col("label") == 1, "fully_synthetic"),
        "license": F.col("license_id").isin(licences),
        "unreadable": F.col("_sha256").isNotNull(),
        "sha256": F.col("original_sha256") == F.col("_sha256"),
        "size": (F.col("width") == F.col("_width")) & (F.col("height") == F.col("_height")) & (F.col("width") > 0) & (F.col("height") > 0),
        "phash": F.lower("decoded_phash") == F.lower("_phash"),
    }
    return breaches(j, checks, "sample_id")


def unbalanced(rows: DataFrame) -> DataFrame:
    """zeros, ones of a manifest that lacks one of the labels or has not as many of each; no row if it is balanced."""
    n = rows.agg(F.count_if(F.col("label") == 0).alias("zeros"), F.count_if(F.col("label") == 1).alias("ones"))
    return n.where((F.col("zeros") != F.col("ones")) | (F.col("zeros") == 0))


def correction(rows: DataFrame, primary: str, p: str, threshold: float) -> DataFrame:
    """router_correction, and whether it changes the verdict."""
    changed = (F.col(primary) >= threshold) != (F.col(p) >= threshold)
    return rows.withColumns({"router_correction": F.round(F.col(p) - F.col(primary), 6), "verdict_changed": changed})


def in_order(rows: DataFrame, *by: Column | str, first: int | None = None) -> DataFrame:
    """The edge of a report: rows in a full order, and only the first so many if asked."""
    out = rows.orderBy(*by)
    return out if first is None else out.limit(first)


def ranked(probabilities: dict[str, Column]) -> Column:
    """Classes with their probabilities, the likeliest first, ties by name."""
    neg = F.array(*[F.struct((-p).alias("q"), F.lit(c).alias("class")) for c, p in probabilities.items()])
    return F.transform(F.array_sort(neg), lambda x: F.struct(x["class"].alias("class"), (-x["q"]).alias("p")))
