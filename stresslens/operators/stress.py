"""Records of a stress run against their clean record: what may be a score, what is an error, and a source's status."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from stresslens.operators.grid import CLEAN, CONDITIONS
from stresslens.operators.metrics import r6
from stresslens.operators.validate import probability

#: Two thresholds are the same within this.
TOLERANCE = 1e-12
DECISIONS = ("real", "fake")
_NAMES = [c for c, *_ in CONDITIONS]
_OF = ["method_id", "source_id"]


def checked(rows: DataFrame) -> DataFrame:
    """rows with clean_p, clean_decision and error: null, or the first reason why a record is no score.

    rows: method_id, source_id, condition_id, p_fake, decision, threshold_used, threshold_provenance. A record's own
    reasons come first: condition, p_fake, threshold, decision, inconsistent, provenance, repeated (every record of a key
    that stands twice); then those against the clean record: no clean, clean (which has a reason of its own), threshold
    differs, provenance differs. A null where a reason looks is that fault; a null method or source is one of
    its own. Clean records
    and repeated keys are found by windows over (source, method), one sort for both, numbers first; rows that are dealt
    by source already aren't shuffled.
    """
    p, t = F.col("p_fake"), F.col("threshold_used")
    fault = lambda ok, name: F.when(~F.coalesce(ok, F.lit(False)), F.lit(name))
    twice = F.count(F.lit(1)).over(W.partitionBy(*_OF[::-1], "condition_id")) > 1
    own = F.coalesce(
        fault(F.col("condition_id").isin(_NAMES), "condition"), fault(probability(p), "p_fake"), fault(probability(t), "threshold"), fault(F.col("decision").isin(*DECISIONS), "decision"),
        fault((F.col("decision") == "fake") == (p >= t), "inconsistent"), fault(F.trim("threshold_provenance") != "", "provenance"), F.when(F.col("_twice"), F.lit("repeated")))
    d = rows.withColumn("_twice", twice).withColumn("_own", own).drop("_twice")
    of, clean = W.partitionBy(*_OF[::-1]), F.col("condition_id") == CLEAN
    record = F.struct("p_fake", "decision", "threshold_used", "threshold_provenance")
    d = d.withColumns({"_clean": F.max(F.when(clean, record)).over(of), "_fault": F.max(F.when(clean, F.col("_own"))).over(of)})
    against = F.coalesce(
        F.when(F.col("_clean").isNull(), F.lit("no clean")), F.when(F.col("_fault").isNotNull(), F.lit("clean")),
        fault(F.abs(t - F.col("_clean.threshold_used")) <= TOLERANCE, "threshold differs"), fault(F.col("threshold_provenance") == F.col("_clean.threshold_provenance"), "provenance differs"))
    fine = F.col("_fault").isNull()
    return d.select(*rows.columns, F.when(fine, F.col("_clean.p_fake")).alias("clean_p"), F.when(fine, F.col("_clean.decision")).alias("clean_decision"), F.coalesce("_own", against).alias("error"))


def summary(records: DataFrame) -> DataFrame:
    """A row per method and source of checked() records: n_scored, n_errors (conditions without a score), spread, flips in canonical order, status.

    status: refused where no clean record may be believed, else incomplete, unstable (some verdict flips) or stable.
    """
    ok = F.col("error").isNull()
    at = F.element_at(F.create_map(*[F.lit(x) for i, c in enumerate(_NAMES) for x in (c, i)]), F.col("condition_id"))
    flip = ok & (F.col("decision") != F.col("clean_decision"))
    verdict = F.coalesce(*[F.when(F.col("clean_decision") == d, i + 1) for i, d in enumerate(DECISIONS)])  # numbers, so that groups are hashed and not sorted
    s = records.groupBy(*_OF).agg(
        F.count_if(ok).alias("n_scored"), F.coalesce(r6(F.max(F.when(ok, F.col("p_fake"))) - F.min(F.when(ok, F.col("p_fake")))), F.lit(0.0)).alias("spread"),
        F.coalesce(F.bit_or(F.when(flip, F.call_function("shiftleft", F.lit(1), at))), F.lit(0)).alias("f"), F.max(verdict).alias("v"))
    s = s.withColumn("clean_decision", F.coalesce(*[F.when(F.col("v") == i + 1, d) for i, d in enumerate(DECISIONS)]))
    names = F.array_compact(F.array(*[F.when(F.col("f").bitwiseAND(F.lit(1 << i)) != 0, F.lit(c)) for i, c in enumerate(_NAMES)]))
    status = F.when(F.col("clean_decision").isNull(), "refused").when(F.col("n_scored") < len(_NAMES), "incomplete").when(F.col("f") != 0, "unstable").otherwise("stable")
    return s.select(*_OF, "clean_decision", "n_scored", (F.lit(len(_NAMES)) - F.col("n_scored")).alias("n_errors"), "spread", names.alias("flips"), status.alias("status"))
