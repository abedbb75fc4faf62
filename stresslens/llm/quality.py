"""Quality by naive Bayes support vectors.

A text's features are indicators of n-grams (one to three) of words, lower-cased and hashed, and of token shapes: how
a token is cased, what signs it ends in, whether it repeats the token before it. Shapes say what words that were never
seen can't. A text's word features together weigh as much as WORDS of them, so that a long text's many words don't
drown its shapes.
Indicators are scaled by their class log-count ratio, and a linear hinge-loss model is fitted to them by dual
coordinate descent, with classes weighted to balance. A sigmoid fitted to the margins gives the score.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stresslens.llm.texts import held_out, pieces, raw, windows

#: Features are hashed to so many, of each kind: the shapes' first, then the words'.
WIDTH = 1 << 17
#: The square of the norm that a text's word indicators have together.
WORDS = 16.0
#: The classifier is fitted on at most so many labelled documents, the first by a hash of their ids.
SAMPLE = 4000
_ENDS = re.compile(rb"[\x21-\x2f\x3a-\x40\x5b-\x60\x7b-\x7e]+$")
_SIGNS = bytes(c for c in range(33, 127) if not chr(c).isalnum())
_MEMO = 200_000


def shape(token: bytes) -> int:
    """What a token looks like, below 1024."""
    tail = _ENDS.search(token)
    signs = tail.group() if tail else b""
    if not signs:
        end = 0
    elif signs in b".,;:" and len(signs) == 1:
        end = 1
    elif len(signs) == 1:
        end = 2 if signs in b"!?" else 3
    elif len(set(signs)) == 1:
        end = 4 if signs[:1] in b"!?." else 5
    else:
        end = 6
    body = token[: len(token) - len(signs)].decode("utf-8", "replace")
    if not body:
        case = 0
    elif body.isalpha():
        case = 1 if body.islower() else 2 if body[1:].islower() or len(body) == 1 else 3 if body.isupper() else 4
    elif any(c.isalpha() for c in body):
        case = 5 if any(c.isdigit() for c in body) else 6
    else:
        case = 7
    size = 0 if len(body) < 2 else 1 if len(body) < 15 else 2 if len(body) < 30 else 3
    return (end * 8 + case) * 4 + size


class Features:
    """The distinct features of a text, as numbers below 2 * WIDTH."""

    def __init__(self) -> None:
        self.memo: dict[bytes, int] = {}

    def tokens(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The shape of each token, and 50 bits of the hash of its word without the signs around it."""
        if len(self.memo) > _MEMO:
            self.memo.clear()
        get, memo = self.memo.get, self.memo
        out = [get(w, -1) for w in words]
        for i, s in enumerate(out):
            if s < 0:
                word = xxhash.xxh64_intdigest(words[i].strip(_SIGNS).lower())
                out[i] = memo[words[i]] = shape(words[i]) | (word >> 14) << 10
        both = np.array(out, np.uint64)
        return both & np.uint64(1023), both >> np.uint64(10)

    def __call__(self, text: bytes) -> np.ndarray:
        found, carry = [np.zeros(1, np.uint64)], []
        for piece in pieces(text):
            words = carry + piece.split()
            if not words:
                continue
            s, w = self.tokens(words)
            again = np.fromiter((a == b for a, b in zip(words, words[1:], strict=False)), bool, len(words) - 1)
            s[1:] += again.astype(np.uint64) * np.uint64(1024)
            s += np.uint64(1)
            g = [s]
            for n in (1, 2):
                if len(s) > n:
                    g.append(g[-1][:-1] * np.uint64(4096) + s[n:])
            for n, x in enumerate(g):
                x = (x + np.uint64(n << 60)) * np.uint64(0x9E3779B97F4A7C15)
                found.append(np.unique((x ^ (x >> np.uint64(31))) % np.uint64(WIDTH)))
            for n in (1, 2, 3):
                if len(w) >= n:
                    found.append(np.unique(windows(w, n) >> np.uint64(64 - 17)) + np.uint64(WIDTH))
            carry = words[-2:]
        return np.unique(np.concatenate(found)).astype(np.int32)


def values(features: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """The weights of a text's features, those of words as much as makes WORDS of all of them."""
    v, first = weights[features].astype(np.float32), int(np.searchsorted(features, WIDTH))
    v[first:] *= (WORDS / max(1, len(features) - first)) ** 0.5
    return v


@dataclass
class Model:
    weights: np.ndarray
    bias: float
    slope: float
    offset: float

    def score(self, features: np.ndarray) -> float:
        z = self.slope * (float(values(features, self.weights).sum()) + self.bias) + self.offset
        return float(1 / (1 + np.exp(-np.clip(z, -30, 30))))


def fit(rows: list[np.ndarray], labels: np.ndarray, alpha: float = 1.0, cost: float = 1.0, rounds: int = 30, seed: int = 3) -> Model:
    """rows: the features of each document; labels: 0 or 1. With one class only, that class gets every document."""
    weights = np.zeros(2 * WIDTH)
    if not len(rows) or labels.min() == labels.max():
        return Model(weights, 0.0, 1.0, 0.0 if not len(rows) else 4.0 * (2 * int(labels[0]) - 1))
    counts = np.full((2, 2 * WIDTH), alpha)
    for f, y in zip(rows, labels, strict=True):
        counts[y, f] += 1
    share = [np.concatenate([np.log(c[k] / c[k].sum()) for k in (slice(0, WIDTH), slice(WIDTH, None))]) for c in counts]
    ratio = share[1] - share[0]
    y = 2.0 * labels - 1
    most = cost * len(y) / (2 * np.where(labels == 1, (labels == 1).sum(), (labels == 0).sum()))
    x = [values(f, ratio) for f in rows]
    norms = np.array([max(1e-12, float(v @ v) + 1) for v in x])
    most = most / np.median(norms)
    a, bias, rng = np.zeros(len(y)), 0.0, np.random.Generator(np.random.PCG64(seed))
    for _ in range(rounds):
        moved = 0.0
        for i in rng.permutation(len(y)):
            f, v = rows[i], x[i]
            slack = 1 - y[i] * (float(weights[f] @ v) + bias)
            new = min(max(a[i] + slack / norms[i], 0.0), most[i])
            if new != a[i]:
                step = (new - a[i]) * y[i]
                weights[f] += step * v
                bias += step
                moved, a[i] = max(moved, abs(new - a[i]) * norms[i]), new
        if moved < 1e-3:
            break
    margin = np.array([float(weights[f] @ v) for f, v in zip(rows, x, strict=True)]) + bias
    slope, offset = sigmoid(margin, labels)
    return Model(weights * ratio, bias, slope, offset)


def sigmoid(margin: np.ndarray, labels: np.ndarray) -> tuple[float, float]:
    """Slope and offset of a sigmoid of the margins, classes of equal weight, by damped Newton steps."""
    n = [(labels == k).sum() for k in (0, 1)]
    goal = np.where(labels == 1, (n[1] + 1) / (n[1] + 2), 1 / (n[0] + 2))
    w = np.where(labels == 1, 1 / n[1], 1 / n[0])
    x, p = np.stack([margin, np.ones_like(margin)], 1), np.array([1.0, 0.0])
    for _ in range(50):
        q = 1 / (1 + np.exp(-np.clip(x @ p, -30, 30)))
        g = x.T @ (w * (q - goal)) + 1e-4 * (p - [1.0, 0.0])
        h = (x * (w * np.maximum(q * (1 - q), 1e-6))[:, None]).T @ x + 1e-4 * np.eye(2)
        step = np.linalg.solve(h, g)
        p = p - step * min(1.0, 2.0 / max(1e-12, np.abs(step).max()))
        if np.abs(step).max() < 1e-8:
            break
    return (float(p[0]), float(p[1])) if p[0] > 0 else (1.0, 0.0)


def train(documents: DataFrame, labels: DataFrame, sample: int = SAMPLE, text: str = "text", doc_id: str = "doc_id", label: str = "quality") -> Model:
    """Fit on at most `sample` labelled documents; labels that aren't 0 or 1 are left out, several for a document count as their least.

    Of different texts with one doc_id that with the least hash counts.
    """
    known = labels.where(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").alias("_id")).agg(F.min(label).cast("int").alias("y"))
    some = known.orderBy(F.xxhash64(F.lit(17), "_id"), "_id").limit(sample)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features = Features()
        for batch in batches:
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array([features(t) for t in raw(batch.column(2))], pa.list_(pa.int32()))], ["doc_id", "y", "f"])

    # at most `sample` ids are sent to every task; the documents stay where they are
    d = documents.select(F.col(doc_id).alias("_doc"), F.col(text).alias("text"))
    rows = d.join(F.broadcast(some), F.col("_doc") == F.col("_id")).groupBy(F.col("_id").alias("doc_id"), "y").agg(F.min_by("text", F.xxhash64("text")).alias("text"))
    found = rows.mapInArrow(run, "doc_id long, y int, f array<int>").toArrow()
    order = np.argsort(found.column("doc_id").to_numpy()).tolist()
    f = [np.asarray(x.values) for chunk in found.column("f").chunks for x in chunk]
    return fit([f[i] for i in order], np.asarray(found.column("y"), np.int64)[order])


def score(documents: DataFrame, model: Model, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, score (that the label is 1), predicted for every row of documents.

    A null or empty text has the one feature that every text has. Repeated rows each come back; other columns are not
    looked at.
    """
    shared = documents.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features, m = Features(), shared.value
        for batch in batches:
            p = np.array([m.score(features(t)) for t in raw(batch.column(1))])
            yield pa.record_batch([batch.column(0), pa.array(p, pa.float64()), pa.array((p >= 0.5).astype(np.int32))], ["doc_id", "score", "predicted"])

    return documents.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, "doc_id long, score double, predicted int")


def keep(documents: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """The rows of documents whose predicted label is 1, in one pass."""
    shared = documents.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features, m = Features(), shared.value
        for batch in batches:
            good = [m.score(features(t)) >= 0.5 for t in raw(batch.column(batch.schema.get_field_index(text)))]
            yield batch.filter(pa.array(good, pa.bool_()))

    return documents.mapInArrow(run, documents.schema)


def classify(documents: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """doc_id, held_out, score, predicted; learned from labels of documents that aren't held out."""
    model = train(documents, labels.where(~held_out(F.col("doc_id"))), sample)
    return score(documents, model).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")
