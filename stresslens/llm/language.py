"""Language identification by interpolated Kneser-Ney character models.

Each language has a model of four characters over lower-cased letters, with runs of anything else as one space.
N-grams of all languages stand in one sorted array of hashes for each order, beside their log-probability in each
language; a second array holds what a context leaves to the next lower order. A text gets the language with the
lowest cross-entropy a character. A text whose cross-entropy is far above what its language's own documents have is
marked as rejected. Every language of the documents is learned; tables are dense only within a block of BLOCK of them,
so the model grows with their number and not with its square.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from stresslens.llm.common import cut
from stresslens.llm.texts import held_out

ORDER = 4
#: A language's model is fitted on at most so many documents, the first by a hash of their ids.
SAMPLE = 400
#: Languages whose tables are one; characters of texts, or pieces of texts, that are looked at together.
BLOCK, CHUNK = 32, 1 << 19
_MIX = np.uint64(0x9E3779B97F4A7C15)


def _letters() -> np.ndarray:
    out = np.zeros(0x110000, bool)
    out[[c for c in range(0x110000) if chr(c).isalpha()]] = True
    return out


class Normal:
    """Texts as code points: lower-cased letters, each run of anything else one space, a space before and after."""

    def __init__(self) -> None:
        self.letter = _letters()

    def __call__(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All texts end to end, and where each begins; a text without letters is empty."""
        low = [f" {t.lower()} " for t in texts]
        raw = np.frombuffer("".join(low).encode("utf-32-le", "surrogatepass"), np.uint32)
        new = np.concatenate([[0], np.cumsum(np.fromiter(map(len, low), np.int64, len(low)))])
        letter = self.letter[raw]
        keep = letter.copy()
        keep[1:] |= letter[:-1]
        keep[new[:-1]] = np.diff(np.concatenate([[0], np.cumsum(letter)])[new]) > 0
        return np.where(letter, raw, 32)[keep].astype(np.uint64), np.concatenate([[0], np.cumsum(keep)])[new]


def codes(points: np.ndarray, order: int) -> np.ndarray:
    """A hash of the `order` characters that end at each position from order - 1 on."""
    h = np.zeros(len(points) - order + 1, np.uint64)
    for k in range(order):
        h = (h ^ points[k : len(points) - order + 1 + k]) * _MIX
        h ^= h >> np.uint64(32)
    return h


@dataclass
class Sorted:
    """Rows by a sorted array of hashes, with an index by their leading bits."""

    keys: np.ndarray
    rows: np.ndarray
    starts: np.ndarray = field(init=False)
    longest: int = field(init=False)

    def __post_init__(self) -> None:
        order = np.argsort(self.keys)
        self.keys, self.rows = np.append(self.keys[order], np.uint64(0xFFFFFFFFFFFFFFFF)), self.rows[order]
        self.starts = np.searchsorted(self.keys[:-1], np.arange(1 << 16, dtype=np.uint64) << np.uint64(48)).astype(np.int64)
        self.longest = int(np.diff(np.append(self.starts, len(self.keys) - 1)).max(initial=0))

    def find(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where each hash is, and whether it is there."""
        at = self.starts[(h >> np.uint64(48)).astype(np.int64)]
        for _ in range(self.longest):
            at += self.keys[at] < h
        return at, self.keys[at] == h


@dataclass
class Model:
    languages: list[str]
    grams: dict[int, Sorted]
    contexts: dict[int, Sorted]
    unseen: np.ndarray

    def entropies(self, texts: list[str], normal: Normal) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Cross-entropy a character of each text in each language; whether the text has letters; characters predicted."""
        points, at = normal(texts)
        n = np.diff(at)
        total = np.zeros((len(texts), len(self.languages)))
        has = n > 1
        # the characters after the first of each text are predicted; contexts don't reach into the text before
        place = np.ones(len(points) + 1, bool)
        place[at[:-1]] = False
        depth = np.full(len(points), ORDER)
        for k in range(ORDER):
            i = at[:-1][n > k] + k
            depth[i] = k + 1
        logs = np.zeros((len(points), len(self.languages)), np.float32)
        todo = np.flatnonzero(place[:-1] & (np.arange(len(points)) > 0))
        for order in range(ORDER, 0, -1):
            if not len(todo):
                break
            if order == 1:
                c = codes(points[todo], 1)
            else:
                deep = depth[todo] >= order
                later = todo[~deep]
                now = todo[deep]
                c = codes(points, order)[now - order + 1] if len(now) else np.zeros(0, np.uint64)
            if order == 1:
                now, later = todo, todo[:0]
            where, hit = self.grams[order].find(c)
            logs[now[hit]] += self.grams[order].rows[where[hit]]
            missed = now[~hit]
            if order == 1:
                logs[missed] += self.unseen
                break
            if len(missed):
                ctx = codes(points, order - 1)[missed - 1 - (order - 2)]
                where, hit = self.contexts[order].find(ctx)
                logs[missed[hit]] += self.contexts[order].rows[where[hit]]
            todo = np.concatenate([missed, later])
        if len(points):
            sums = np.concatenate([np.zeros((1, logs.shape[1])), np.cumsum(logs, axis=0, dtype=np.float64)])
            total[has] = -(sums[at[1:]] - sums[at[:-1]])[has] / (n[has] - 1)[:, None]
        return total, has, np.where(has, n - 1, 0)


@dataclass
class Languages:
    """All blocks of languages; limits: above which cross-entropy a text of a language is rejected."""

    blocks: list[Model]
    limits: np.ndarray

    @property
    def names(self) -> list[str]:
        return [n for m in self.blocks for n in m.languages]

    def entropies(self, texts: list[str | None], normal: Normal) -> tuple[np.ndarray, np.ndarray]:
        """Cross-entropy a character of each text in each language, long texts in pieces; whether the text has letters."""
        total, weight = np.zeros((len(texts), len(self.names))), np.zeros(len(texts))
        for some in _chunks(texts):
            which = np.array([i for i, _ in some])
            parts = [m.entropies([t for _, t in some], normal) for m in self.blocks]
            n = parts[0][2].astype(float)
            np.add.at(total, which, np.concatenate([h for h, _, _ in parts], axis=1) * n[:, None])
            np.add.at(weight, which, n)
        return total / np.maximum(weight, 1)[:, None], weight > 0

    def predict(self, texts: list[str | None], normal: Normal) -> list[tuple[str, float, bool]]:
        names, out = self.names, []
        if not names:
            return [("und", 0.0, True)] * len(texts)
        for row, ok in zip(*self.entropies(texts, normal), strict=True):
            if not ok:
                out.append(("und", 0.0, True))
                continue
            k = int(np.argmin(row))
            p = float(1 / np.exp(np.minimum(4 * (row[k] - row), 0)).sum())
            bad = bool(row[k] > self.limits[k])
            out.append((names[k], p / 2 if bad else p, bad))
        return out


def build(counts: dict[str, dict[str, int]], alphabet: int | None = None) -> Model:
    """counts: by language, how often each string of ORDER characters occurs (shorter ones at the start of a text).

    alphabet: characters of all languages, where there are others than these.
    """
    languages = sorted(counts)
    p: dict[int, dict[str, dict[int, float]]] = {}
    seen: dict[int, set[str]] = {o: set() for o in range(1, ORDER + 1)}
    tables = []
    for lang in languages:
        c: dict[int, dict[str, float]] = {o: defaultdict(float) for o in range(1, ORDER + 1)}
        for g, n in counts[lang].items():
            if len(g) <= ORDER:
                c[len(g)][g] += n
        for o in range(ORDER, 1, -1):  # lower orders count in how many different contexts a string follows
            for g in c[o]:
                c[o - 1][g[1:]] += 1
        tables.append(c)
        for o in c:
            seen[o] |= set(c[o])
    size = (alphabet or len(seen[1])) + 1
    models = []
    for c in tables:
        top = {o: defaultdict(float) for o in c}
        kinds = {o: defaultdict(int) for o in c}
        cut = {}
        for o in c:
            once, twice = sum(v == 1 for v in c[o].values()), sum(v == 2 for v in c[o].values())
            cut[o] = min(0.95, max(0.1, once / (once + 2 * twice))) if once else 0.5
            for g, n in c[o].items():
                top[o][g[:-1]] += n
                kinds[o][g[:-1]] += 1
        models.append((c, top, kinds, cut))

    def left(m: tuple, o: int, context: str) -> float:
        _, top, kinds, cut = m
        return cut[o] * kinds[o][context] / top[o][context] if context in top[o] and top[o][context] else 1.0

    for o in range(1, ORDER + 1):
        p[o] = {}
        for g in seen[o]:
            row = {}
            for i, m in enumerate(models):
                c, top, _, cut = m
                total = top[o].get(g[:-1], 0.0)
                lower = 1 / size if o == 1 else p[o - 1][g[1:]][i] if g[1:] in p[o - 1] else 1 / size
                row[i] = (max(c[o].get(g, 0.0) - cut[o], 0.0) / total if total else 0.0) + left(m, o, g[:-1]) * lower
            p[o][g] = row
    grams, contexts = {}, {}
    for o in range(1, ORDER + 1):
        names = sorted(p[o])
        grams[o] = _sorted(names, np.array([[np.log(max(p[o][g][i], 1e-12)) for i in range(len(languages))] for g in names], np.float32).reshape(len(names), len(languages)))
        names = sorted({g[:-1] for g in p[o]})
        contexts[o] = _sorted(names, np.array([[np.log(max(left(m, o, x), 1e-12)) for m in models] for x in names], np.float32).reshape(len(names), len(languages))) if o > 1 else grams[o]
    return Model(languages, grams, contexts, np.log([left(m, 1, "") / size for m in models]).astype(np.float32))


def _sorted(names: list[str], rows: np.ndarray) -> Sorted:
    keys = np.zeros(len(names), np.uint64)
    for i, g in enumerate(names):
        keys[i] = codes(np.array([ord(c) for c in g], np.uint64), len(g))[0]
    return Sorted(keys, rows)


def _chunks(texts: list[str | None]) -> Iterator[list[tuple[int, str]]]:
    """The texts by their number, long ones in pieces, so many together that they have about CHUNK characters."""
    some: list[tuple[int, str]] = []
    size = 0
    for i, t in enumerate(texts):
        t = t or ""
        for at in range(0, max(1, len(t)), CHUNK):
            some.append((i, t[at : at + CHUNK]))
            size += min(len(t) - at, CHUNK)
            if size >= CHUNK:
                yield some
                some, size = [], 0
    if some:
        yield some


def train(documents: DataFrame, sample: int = SAMPLE, text: str = "text", lang: str = "lang", doc_id: str = "doc_id", margin: float = 6.0) -> Languages:
    """Fit a model for every language of documents, of `sample` documents each; null languages and texts are left out.

    Of different texts with one doc_id and language that with the least hash counts.
    """
    d = documents.where(F.col(lang).isNotNull() & F.col(text).isNotNull()).select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), F.col(lang).alias("lang"))
    # one pass: each task keeps its first ones of a language, and their first ones are kept
    first = F.row_number().over(W.partitionBy("lang").orderBy(F.xxhash64(F.lit(23), "doc_id"), "doc_id"))
    picks = d.select("doc_id", "lang").withColumn("i", first).where(F.col("i") <= sample).select(F.col("doc_id").alias("_id"), F.col("lang").alias("_lang")).distinct()
    there = d.join(cut(picks), F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("lang") == F.col("_lang")))
    rows = cut(there.groupBy("doc_id", "lang").agg(F.min_by("text", F.xxhash64("text")).alias("text")).select("lang", "text"))
    names = sorted(r[0] for r in rows.select("lang").distinct().collect())
    if not names:
        return Languages([], np.zeros(0))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        normal = Normal()
        found: dict[tuple[str, str], int] = defaultdict(int)
        for batch in batches:
            for name, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                points, _ = normal([t])
                s = "".join(map(chr, points.tolist()))
                for k in range(2, min(ORDER, len(s) + 1)):
                    found[name, s[:k]] += 1
                for k in range(ORDER, len(s) + 1):
                    found[name, s[k - ORDER : k]] += 1
                if len(found) > 500_000:
                    yield _counted(found)
                    found.clear()
        if found:
            yield _counted(found)

    # as many tasks as there are samples, not as the session has partitions: a task adds up what its hundred texts share
    grams = cut(rows.coalesce(4 * len(names)).mapInArrow(run, "lang string, gram string, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n")))
    alphabet = grams.select(F.explode(F.split("gram", "")).alias("c")).where("c <> ''").distinct().count()
    blocks = []
    for at in range(0, len(names), BLOCK):
        some = names[at : at + BLOCK]
        counts: dict[str, dict[str, int]] = {n: {} for n in some}
        t = grams.where(F.col("lang").between(some[0], some[-1])).toArrow()
        for name, g, n in zip(t.column(0).to_pylist(), t.column(1).to_pylist(), t.column(2).to_pylist(), strict=True):
            counts[name][g] = n
        blocks.append(build(counts, alphabet))
    model = Languages(blocks, np.full(len(names), np.inf))
    shared = documents.sparkSession.sparkContext.broadcast(model)

    def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        normal, m = Normal(), shared.value
        for batch in batches:
            e, ok = m.entropies(batch.column(1).to_pylist(), normal)
            h = [(float(x.min()) if y else None) for x, y in zip(e, ok, strict=True)]
            yield pa.record_batch([batch.column(0), pa.array(h, pa.float64())], ["lang", "h"])

    usual = {r.lang: r.limit for r in rows.mapInArrow(own, "lang string, h double").groupBy("lang").agg((F.avg("h") + margin * F.stddev_pop("h")).alias("limit")).collect()}
    model.limits = np.array([np.inf if usual.get(n) is None else usual[n] for n in names])
    return model


def _counted(found: dict[tuple[str, str], int]) -> pa.RecordBatch:
    return pa.record_batch([pa.array([k[0] for k in found], pa.string()), pa.array([k[1] for k in found], pa.string()), pa.array(list(found.values()), pa.int64())], ["lang", "gram", "n"])


def predict(documents: DataFrame, model: Languages, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, lang_pred, score, rejected for every row of documents.

    A null text, and one without a letter, is `und` with score 0; so is every text if nothing was learned. Repeated
    rows each come back; other columns are not looked at.
    """
    shared = documents.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        normal, m = Normal(), shared.value
        for batch in batches:
            out = m.predict(batch.column(1).to_pylist(), normal)
            yield pa.record_batch([batch.column(0), pa.array([x[0] for x in out], pa.string()), pa.array([x[1] for x in out], pa.float64()), pa.array([x[2] for x in out], pa.bool_())], ["doc_id", "lang_pred", "score", "rejected"])

    return documents.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, "doc_id long, lang_pred string, score double, rejected boolean")


def identify(documents: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """doc_id, held_out, lang_pred, score, rejected; learned from documents that aren't held out."""
    model = train(documents.where(~held_out(F.col("doc_id"))), sample)
    return predict(documents, model).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "rejected")
