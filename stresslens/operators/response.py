"""How a score answers to probes, the arms made of it, and readings of bands."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from stresslens.functions import scalars

#: Columns of each arm, by their groups.
ARMS = {"A": ("base",), "A2": ("base",), "B": ("base", "quality"), "C": ("base", "quality", "response"), "D": ("base", "response"), "Q": ("quality",)}
#: Lower ends of bands of AUROC and their readings, the highest first.
SEPARABILITY = ((0.95, "near-perfect separability"), (0.8, "strong separability"), (0.65, "moderate separability, clearly above chance"), (0.55, "weak separability, modestly above chance"), (float("-inf"), "at chance"))


def usable(answer: Column, block: Column, probes: int) -> Column:
    """Did the expert answer and all probes with it."""
    return F.coalesce(answer["ok"] & (block["n_probes_ok"] == probes), F.lit(False))


def signature(answer: Column, block: Column, probes: list[str]) -> Column:
    """An array: each probe's logit less the view's, their mean, deviation, largest size and range, then what the block
    says in probabilities: deviation, range, largest difference, and its mean less the view's score. Null where any is."""
    base = answer["raw_logit"]
    deltas = [scalars.logit(block["probe_scores"][p], 1e-6) - base for p in probes]
    n = float(len(probes))
    mean = sum(deltas[1:], deltas[0]) / n
    square = sum(((d - mean) * (d - mean) for d in deltas[1:]), (deltas[0] - mean) * (deltas[0] - mean)) / n
    several = len(deltas) > 1
    high, low, size = (F.greatest(*deltas), F.least(*deltas), F.greatest(*[F.abs(d) for d in deltas])) if several else (deltas[0], deltas[0], F.abs(deltas[0]))
    out = [*deltas, mean, F.sqrt(square), size, high - low, *[block[f"probe_{c}"] for c in ("std", "range", "max_delta")], block["probe_mean"] - answer["p_fake"]]
    whole = F.lit(True)
    for c in out:
        whole = whole & c.isNotNull()
    return F.when(whole, F.array(*out))


def arm(name: str, base: Column, quality: Column, response: Column) -> Column:
    """The features of an arm as an array: base is a number, the others are arrays."""
    if name not in ARMS:
        raise ValueError(f"an arm is one of {', '.join(ARMS)}")
    parts = {"base": F.array(base), "quality": quality, "response": response}
    return F.concat(*[parts[p] for p in ARMS[name]])


def reading(value: Column, bands: tuple[tuple[float, str], ...] = SEPARABILITY) -> Column:
    """The text of the first band whose lower end a value reaches; null for null and NaN."""
    out = F.when(F.isnan(value) | value.isNull(), F.lit(None))
    for low, text in bands:
        out = out.when(value >= low, text)
    return out
