"""Documents from result tables: nothing is computed again here."""

from __future__ import annotations

import hashlib
import json
import math
import re
from typing import Any

from pyspark.sql import DataFrame

from stresslens.operators import grid
from stresslens.sources.files import find_non_finite


def document(tables: dict[str, DataFrame], threshold: float, limit: int = 10_000) -> dict[str, Any]:
    """A nested document of small result tables; one larger than `limit` rows is refused, not cut."""
    out: dict[str, Any] = {"threshold": threshold}
    for name, df in tables.items():
        rows = [r.asDict(recursive=True) for r in df.limit(limit + 1).collect()]
        if len(rows) > limit:
            raise ValueError(f"{name} is no summary: more than {limit} rows")
        out[name] = rows
    if bad := find_non_finite(out):
        raise ValueError(f"not finite: {', '.join(bad[:5])}")
    return out


def cell(value: Any, digits: int = 4) -> str:
    return "–" if value is None else f"{value:.{digits}f}" if isinstance(value, float) else str(value)


def markdown(doc: dict[str, Any]) -> str:
    lines = [f"Threshold: {cell(doc['threshold'])}", ""]
    for name, rows in doc.items():
        if not isinstance(rows, list):
            continue
        lines += [f"## {name}", ""]
        if rows:
            lines += ["| " + " | ".join(rows[0]) + " |", "|" + "---|" * len(rows[0])]
            lines += ["| " + " | ".join(cell(v) for v in r.values()) + " |" for r in rows]
        lines.append("")
    return "\n".join(lines)


def bar(share: float | None, width: int = 20) -> str:
    return "" if share is None else "#" * round(max(0.0, min(1.0, share)) * width)


class FrozenThreshold:
    """A threshold that was read from a validated document; it can't be made by hand, so a headline can't be either."""

    _made_here = object()

    def __init__(self, token: object, value: float, sha256: str):
        if token is not FrozenThreshold._made_here:
            raise TypeError("use FrozenThreshold.load")
        self.value, self.sha256 = value, sha256

    @classmethod
    def load(cls, path: str) -> FrozenThreshold:
        with open(path, "rb") as f:
            data = f.read()
        d = json.loads(data)
        if bad := threshold_faults(d):
            raise ValueError("; ".join(bad))
        return cls(cls._made_here, float(d["threshold"]), hashlib.sha256(data).hexdigest())


#: The schema, the pipeline that may read it, and the fields of a threshold document, by what they hold.
THRESHOLD_SCHEMA, PIPELINE_VERSION = "threshold-artifact.v1", "0.1.0"
TEXTS = ("objective", "pipeline_version", "fitting_code_version", "created_at", "tie_break")
DIGESTS = ("dev_manifest_sha256", "config_sha256")
SHARES = ("threshold", "objective_value", "worst_exact_condition_recall", "clean_fpr", "clean_bacc", "baseline_clean_fpr", "baseline_clean_bacc", "constraint_max_clean_fpr", "constraint_min_clean_bacc")
COUNTS = {"n_dev_sources": 1, "n_dev_rows": 1, "n_fake_sources_per_exact_condition_min": 0}
CHOICES = {"schema_version": (THRESHOLD_SCHEMA,), "pipeline_version": (PIPELINE_VERSION,), "selection_granularity": ("family", "exact_condition")}
BOOTSTRAP = {"unit": "source_id", "stratified_by": "label", "interval": "percentile_95"}
OTHERS = ("feasible", "objective_ci95", "worst_family", "worst_exact_condition", "bootstrap", "warnings")


def _number(x: Any) -> bool:
    return isinstance(x, int | float) and not isinstance(x, bool) and math.isfinite(x)


def _share(x: Any) -> bool:
    return _number(x) and 0 <= x <= 1


def _whole(x: Any, least: int | None = None) -> bool:
    return isinstance(x, int) and not isinstance(x, bool) and (least is None or x >= least)


def threshold_faults(d: Any) -> list[str]:
    """What is wrong with a threshold document; nothing for one that may be used."""
    if not isinstance(d, dict):
        return ["not an object"]
    fields = {*TEXTS, *DIGESTS, *SHARES, *COUNTS, *CHOICES, *OTHERS}
    if set(d) != fields:
        return [f"{'missing' if f in fields else 'unexpected'} field {f}" for f in sorted(set(d) ^ fields)]
    families, conditions = {f for _, f, _ in grid.CONDITIONS} - {"clean"}, {c for c, *_ in grid.CONDITIONS} - {"clean"}
    ci, boot, names = d["objective_ci95"], d["bootstrap"], d["warnings"]
    fine = {
        **{f: isinstance(d[f], str) and bool(d[f].strip()) for f in TEXTS},
        **{f: isinstance(d[f], str) and bool(re.fullmatch("[0-9a-f]{64}", d[f])) for f in DIGESTS},
        **{f: _share(d[f]) for f in SHARES},
        **{f: _whole(d[f], least) for f, least in COUNTS.items()},
        "feasible": isinstance(d["feasible"], bool),
        "objective_ci95": isinstance(ci, list) and len(ci) == 2 and all(map(_share, ci)) and ci[0] <= ci[1],
        "worst_family": d["worst_family"] in families,
        "worst_exact_condition": d["worst_exact_condition"] in conditions,
        "bootstrap": isinstance(boot, dict) and set(boot) == {"n_replicates", "seed", *BOOTSTRAP} and _whole(boot["n_replicates"], 1) and _whole(boot["seed"]) and all(boot[k] == v for k, v in BOOTSTRAP.items()),
        "warnings": isinstance(names, list) and all(isinstance(w, str) for w in names),
    }
    for f, some in CHOICES.items():
        fine[f] = fine.get(f, True) and d[f] in some
    return [f"bad {f}: {d[f]!r}" for f, ok in fine.items() if not ok]
