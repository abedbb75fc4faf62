"""Small models, fitted from sums that Spark aggregates or on the driver from bounded, pre-aggregated rows."""

from __future__ import annotations

import hashlib
import json
import math
from dataclasses import dataclass
from typing import Any

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stresslens.functions import scalars


@dataclass
class Logistic:
    weights: list[float]
    bias: float
    rounds: int

    def column(self, columns: list[str]):
        return scalars.sigmoid(sum((F.col(c) * w for c, w in zip(columns, self.weights, strict=True)), F.lit(self.bias)))


def logistic(rows: DataFrame, columns: list[str], l2: float = 1.0, rounds: int = 50, tolerance: float = 1e-8) -> Logistic:
    """L2 logistic regression, bias not penalised, by Newton steps over exactly aggregated gradient and curvature.

    Each round is one aggregate of (k + 1) * (k + 4) / 2 sums over the rows, whatever their number.
    """
    k = len(columns)
    x = [F.col(c) for c in columns] + [F.lit(1.0)]
    w = np.zeros(k + 1)
    penalty = np.diag([l2] * k + [0.0])
    for i in range(rounds):
        z = sum((c * float(v) for c, v in zip(x, w, strict=True)), F.lit(0.0))
        d = rows.select(*columns, "label", scalars.sigmoid(z).alias("_q"))
        s = F.col("_q") * (1 - F.col("_q"))
        sums = d.agg(*[F.sum((F.col("_q") - F.col("label")) * a).alias(f"g{n}") for n, a in enumerate(x)], *[F.sum(s * a * b).alias(f"h{n}_{m}") for n, a in enumerate(x) for m, b in enumerate(x) if m >= n]).first()
        g = np.array([sums[f"g{n}"] or 0.0 for n in range(k + 1)]) + penalty @ w
        h = np.array([[sums[f"h{min(n, m)}_{max(n, m)}"] or 0.0 for m in range(k + 1)] for n in range(k + 1)]) + penalty + 1e-12 * np.eye(k + 1)
        step = np.linalg.solve(h, g)
        w = w - step
        if np.abs(step).max() < tolerance * max(1.0, np.abs(w).max()):
            break
    return Logistic([float(v) for v in w[:k]], float(w[k]), i + 1)


def temperature(rows: DataFrame, raw: str = "raw", rounds: int = 50) -> tuple[float, float]:
    """temperature and bias of sigmoid(raw / t + b): a logistic regression of one feature, so the same sums do."""
    m = logistic(rows.select(F.col(raw).alias("_r"), "label"), ["_r"], l2=0.0, rounds=rounds)
    if m.weights[0] <= 0:
        raise ValueError("scores do not rise with the label")
    return 1 / m.weights[0], m.bias


def gelu(x: np.ndarray) -> np.ndarray:
    return 0.5 * x * (1 + np.vectorize(math.erf)(x / math.sqrt(2)))


def gelu_slope(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.vectorize(math.erf)(x / math.sqrt(2))) + x * np.exp(-(x**2) / 2) / math.sqrt(2 * math.pi)


class Network:
    """A small perceptron with one output for each head, trained in full batches by Adam."""

    def __init__(self, sizes: list[int], activation: str = "gelu", seed: int = 0):
        r = np.random.Generator(np.random.PCG64(seed))
        self.sizes, self.activation = sizes, activation
        self.w = [r.normal(0, math.sqrt(2 / a), (a, b)) for a, b in zip(sizes, sizes[1:], strict=False)]
        self.b = [np.zeros(b) for b in sizes[1:]]

    @property
    def parameters(self) -> int:
        return sum(w.size for w in self.w) + sum(b.size for b in self.b)

    def forward(self, x: np.ndarray) -> tuple[np.ndarray, list[np.ndarray], list[np.ndarray]]:
        inputs, sums = [x], []
        for i, (w, b) in enumerate(zip(self.w, self.b, strict=True)):
            z = inputs[-1] @ w + b
            sums.append(z)
            last = i == len(self.w) - 1
            inputs.append(z if last else gelu(z) if self.activation == "gelu" else np.maximum(z, 0))
        return inputs[-1], inputs, sums

    def __call__(self, x: np.ndarray) -> np.ndarray:
        return self.forward(x)[0]

    def gradient(self, x: np.ndarray, slope: np.ndarray, inputs: list, sums: list) -> list[np.ndarray]:
        out, d = [], slope
        for i in reversed(range(len(self.w))):
            out = [inputs[i].T @ d, d.sum(0), *out]
            if i:
                d = d @ self.w[i].T
                d = d * (gelu_slope(sums[i - 1]) if self.activation == "gelu" else (sums[i - 1] > 0))
        return out

    def train(self, x: np.ndarray, loss: Any, rounds: int = 200, rate: float = 0.02, decay: float = 0.0, only: set[int] | None = None) -> list[float]:
        """loss(output) gives the value and its slope. only: the layers that may move; the others stay as they are, to the bit."""
        moment, second, history = None, None, []
        for t in range(1, rounds + 1):
            y, inputs, sums = self.forward(x)
            value, slope = loss(y)
            history.append(float(value))
            g = self.gradient(x, slope, inputs, sums)
            moment = [np.zeros_like(v) for v in g] if moment is None else moment
            second = [np.zeros_like(v) for v in g] if second is None else second
            for i, v in enumerate(g):
                if only is not None and i // 2 not in only:
                    continue
                p = self.w[i // 2] if i % 2 == 0 else self.b[i // 2]
                v = v + decay * p
                moment[i] = 0.9 * moment[i] + 0.1 * v
                second[i] = 0.999 * second[i] + 0.001 * v * v
                p -= rate * (moment[i] / (1 - 0.9**t)) / (np.sqrt(second[i] / (1 - 0.999**t)) + 1e-8)
        return history

    def to_dict(self) -> dict[str, Any]:
        return {"sizes": self.sizes, "activation": self.activation, "w": [w.tolist() for w in self.w], "b": [b.tolist() for b in self.b]}

    @staticmethod
    def from_dict(d: dict[str, Any]) -> Network:
        n = Network(list(d["sizes"]), d["activation"])
        w, b = [np.array(x, float) for x in d["w"]], [np.array(x, float) for x in d["b"]]
        if [x.shape for x in w] != [x.shape for x in n.w] or [x.shape for x in b] != [x.shape for x in n.b]:
            raise ValueError("weights don't have the sizes that are stated")
        n.w, n.b = w, b
        return n


def worst_group(labels: np.ndarray, groups: np.ndarray, strength: float = 1.0, heat: float = 0.1) -> Any:
    """Loss of logits: mean cross-entropy plus a soft maximum of the groups' means, empty groups left out."""
    names, which = np.unique(groups, return_inverse=True)
    n = np.bincount(which)

    def loss(out: np.ndarray) -> tuple[float, np.ndarray]:
        z = out[:, 0]
        each = np.logaddexp(0, z) - labels * z
        mean = np.bincount(which, each) / n
        top = mean.max()
        e = np.exp((mean - top) / heat)
        soft = heat * np.log(e.sum()) + top
        share = e / e.sum()
        weight = 1 / len(z) + strength * share[which] / n[which]
        slope = np.zeros_like(out)
        slope[:, 0] = (1 / (1 + np.exp(-z)) - labels) * weight
        return float(each.mean() + strength * soft), slope

    return loss


def class_loss(classes: np.ndarray, n: int) -> Any:
    """Cross-entropy over n classes, each weighted by how rare it is."""
    count = np.maximum(np.bincount(classes, minlength=n), 1)
    w = (len(classes) / (n * count))[classes]

    def loss(out: np.ndarray) -> tuple[float, np.ndarray]:
        z = out - out.max(1, keepdims=True)
        p = np.exp(z) / np.exp(z).sum(1, keepdims=True)
        value = -(w * np.log(p[np.arange(len(p)), classes] + 1e-300)).sum() / w.sum()
        d = p.copy()
        d[np.arange(len(p)), classes] -= 1
        return float(value), d * w[:, None] / w.sum()

    return loss


def ladder(rungs: dict[str, float], baseline: str, gain: float = 0.02) -> str:
    """The best rung if it beats the baseline by enough, the first of equal ones; else the baseline."""
    best = max(rungs, key=lambda k: rungs[k])
    return best if rungs[best] >= rungs[baseline] + gain else baseline


def digest(value: Any) -> str:
    """SHA-256 of a value as canonical JSON."""
    return hashlib.sha256(json.dumps(value, sort_keys=True, separators=(",", ":"), allow_nan=False).encode()).hexdigest()


def save(path: str, model: Network, features: list[str], threshold: float, version: str = "checkpoint.v1") -> None:
    from stresslens.sources import files

    body = {"version": version, "model": model.to_dict(), "features": features, "threshold": threshold}
    files.write_json({**body, "sha256": digest(body)}, path)


def load(path: str, features: list[str], version: str = "checkpoint.v1") -> tuple[Network, float]:
    """Refuses what has other fields, another version, drifted features, or isn't what was saved."""
    with open(path, encoding="utf-8") as f:
        body = json.load(f)
    if set(body) != {"version", "model", "features", "threshold", "sha256"}:
        raise ValueError("missing or unknown fields")
    told = body.pop("sha256")
    if body["version"] != version or body["features"] != features or told != digest(body):
        raise ValueError("version, features or digest differ")
    if not 0 <= body["threshold"] <= 1:
        raise ValueError("threshold out of range")
    return Network.from_dict(body["model"]), body["threshold"]
