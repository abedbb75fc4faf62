"""Repeated byte strings of a fixed length, found by distributed prefix doubling and cut out.

A suffix array up to `length` is refined only where it can matter. The scan of a text keeps the positions that
are the smallest in hash of some run of 128 positions (so every string of `length` bytes holds one at the same
place in each of its copies). Round one ranks them by the string of length - 127 bytes that starts there; whoever
is alone in its rank drops out. Each later round ranks what is left by a longer string (169, 193, 199 and 200 bytes
for a threshold of 200) at each offset to the sampled position that may still differ, again drops who is alone, and
reports as repeated the strings that outlast the threshold. Doubling by pairs of ranks would need the ranks of all
positions, several times the input in every round; so a rank is the hash of its string here and not a number in
sorted order, and two positions are in one rank only by equal strings, not by equal pairs. Equal strings go on as one
row of weight two, so a group of copies costs one row a round however large it is.

Nothing is reported by one 64-bit hash alone: strings count as the same when both hashes of theirs are.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stresslens.llm.common import packed

OFFSETS = 128
#: The offsets of a round's rows are split into so many.
FANOUT = (4, 4, 4, 2)
CHUNK = 1 << 20


class Scanner:
    """Positions of a text that are the least of a run of OFFSETS, with the rank of their string and of its surroundings."""

    def __init__(self, length: int):
        self.length, self.gram = length, length - OFFSETS + 1
        rng = np.random.Generator(np.random.PCG64(20240229))
        self.bytes = rng.integers(0, 1 << 64, 256, dtype=np.uint64)
        self.base = int(rng.integers(0, 1 << 63)) * 2 + 1
        self.powers = self.inverse = np.ones(0, np.uint64)

    def reach(self, n: int) -> None:
        if len(self.powers) <= n:
            n = max(n + 1, CHUNK + 1)
            for name, b in (("powers", self.base), ("inverse", pow(self.base, -1, 1 << 64))):
                p = np.full(n, b, np.uint64)
                p[0] = 1
                setattr(self, name, np.multiply.accumulate(p))

    def piece(self, b: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, ...]:
        """b: texts end to end, at most 2**24 bytes. The text, the position in b, and both ranks of each position kept."""
        none = tuple(np.zeros(0, np.int64) for _ in range(4))
        n = len(b)
        if n < self.length:
            return none
        self.reach(n)
        h = np.zeros(n + 1, np.uint64)
        np.cumsum(self.bytes[b] * self.powers[:n], out=h[1:])
        g = (h[self.gram :] - h[: n + 1 - self.gram]) * self.inverse[: n + 1 - self.gram]
        key = g * np.uint64(0x9E3779B97F4A7C15)
        key ^= key >> np.uint64(29)
        key *= np.uint64(0xBF58476D1CE4E5B9)
        low = (key & np.uint64(0xFFFFFFFFFF000000)) | np.arange(len(key), dtype=np.uint64)
        step = 1
        while step < OFFSETS:
            low = np.minimum(low[:-step], low[step:])
            step *= 2
        valid = np.zeros(n + 1, bool)
        for s, e in zip(starts.tolist(), ends.tolist(), strict=True):
            if e - s >= self.length:
                valid[s : e - self.length + 1] = True
        at = (low[valid[: len(low)]] & np.uint64(0xFFFFFF)).astype(np.int64)
        if not len(at):
            return none
        at = at[np.concatenate([[True], at[1:] != at[:-1]])]
        text = np.searchsorted(starts, at, "right") - 1
        left, right = np.maximum(starts[text], at - OFFSETS + 1), np.minimum(ends[text], at + self.length)
        sup = (h[right] - h[left]) * self.inverse[left] + (at - left).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93) + (right - at).astype(np.uint64) * np.uint64(0xA0761D6478BD642F)
        return text, at, key[at].view(np.int64), sup.view(np.int64)

    def long(self, b: np.ndarray) -> tuple[np.ndarray, ...]:
        """The same for one text of any length."""
        out, margin = [], self.length + OFFSETS
        for s in range(0, len(b), CHUNK):
            left, right = max(0, s - margin), min(len(b), s + CHUNK + 2 * margin)
            _, at, core, sup = self.piece(b[left:right], np.array([0]), np.array([right - left]))
            inner = ((at >= margin) | (left == 0)) & ((at + self.length <= right - left - 1) | (right == len(b)))
            out.append((at[inner] + left, core[inner], sup[inner]))
        at, core, sup = (np.concatenate(x) for x in zip(*out, strict=True))
        at, first = np.unique(at, return_index=True)
        return np.zeros(len(at), np.int64), at, core[first], sup[first]

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            k1, k2 = batch.column(0), batch.column(1)
            text = batch.column(2).cast(pa.large_binary())
            offsets = np.frombuffer(text.buffers()[1], np.int64)[text.offset : text.offset + len(text) + 1]
            data = np.frombuffer(text.buffers()[2] or b"", np.uint8)
            i = 0
            while i < len(text):
                j = i + 1
                while j < len(text) and offsets[j + 1] - offsets[i] <= CHUNK:
                    j += 1
                b = data[offsets[i] : offsets[j]]
                starts, ends = offsets[i:j] - offsets[i], offsets[i + 1 : j + 1] - offsets[i]
                which, at, core, sup = self.long(b) if len(b) > 4 * CHUNK else self.piece(b, starts, ends)
                if len(at):
                    rows = pa.array(which + i)
                    yield pa.record_batch([k1.take(rows), k2.take(rows), pa.array(at - starts[which], pa.int32()), pa.array(core), pa.array(sup)], ["k1", "k2", "pos", "core", "sup"])
                i = j


def _kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for text, spans in zip(batch.column("text"), batch.column("spans"), strict=True):
            b = text.as_buffer() if text.is_valid else b""
            view, removed, runs, at = memoryview(b) if len(b) else memoryview(b""), 0, 0, 0
            sha = hashlib.sha256()
            if spans.is_valid:
                f = np.asarray(spans.values.field(0))
                t = np.asarray(spans.values.field(1))
                order = np.argsort(f, kind="stable")
                f, t = f[order].astype(np.int64), np.maximum.accumulate(t[order].astype(np.int64))
                new = np.concatenate([[True], f[1:] > t[:-1]])
                firsts = np.flatnonzero(new)
                lasts = np.append(firsts[1:], len(f)) - 1
                for x, y in zip(f[firsts].tolist(), t[lasts].tolist(), strict=True):
                    sha.update(view[at:x])
                    removed, runs, at = removed + y - x, runs + 1, y
            sha.update(view[at:])
            out.append((len(view), removed, runs, sha.hexdigest()))
        n, removed, runs, digest = zip(*out, strict=True) if out else ((), (), (), ())
        yield pa.record_batch([batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(runs, pa.int64()), pa.array(digest, pa.string())], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])


def _ranked(x: Column, y: Column, length: int) -> list[Column]:
    """Of the offsets x to y around a position (pos, lo, data): the rank of the string that they have in common, and of all they cover.

    data begins at offset OFFSETS - 1 - lo before the position. Null where the text holds none of these offsets whole.
    """
    left = F.lit(OFFSETS - 1) - F.col("lo")
    start, end = F.greatest(left - y, F.lit(0)), F.least(left - x + length, F.octet_length("data"))
    common = F.substring("data", left - x + 1, F.lit(length) - (y - x))
    data = F.substring("data", start + 1, end - start)
    clip = F.greatest(y - left, F.lit(0))
    inside = (left >= x) & (left - y + length <= F.octet_length("data"))
    return [F.when(inside, F.xxhash64(x, common)).alias("core"), F.xxhash64(x, clip, data).alias("all")]


def repeated_spans(documents: DataFrame, length: int = 200) -> DataFrame:
    """(k1, k2, from_byte, to_byte): stretches of a text that lie in strings of `length` bytes that start elsewhere too.

    Stretches may overlap and come more than once. documents: k1, k2, text as binary, without null texts; k1 and k2
    tell documents apart, and rows that share them have the same text.
    """
    if length < OFFSETS + 8:
        raise ValueError(f"length must be at least {OFFSETS + 8}")
    found = documents.select("k1", "k2", "text").mapInArrow(Scanner(length), "k1 long, k2 long, pos int, core long, sup long")
    # ranks are written, so that a rank with very many rows can be split when it is joined
    ranks = packed(found.groupBy("core").agg(F.count("*").alias("n"), F.min("sup").alias("a"), F.max("sup").alias("b")).where("n > 1").select("core", (F.col("a") != F.col("b")).alias("mixed")))
    live = packed(found.join(ranks, "core").select("k1", "k2", "pos", F.when(F.col("mixed"), F.col("core")).alias("core"), F.when(F.col("mixed"), F.col("sup")).alias("sup")))
    mixed = live.where("core is not null")
    same = packed(mixed.groupBy("core", "sup").agg(F.count("*").alias("n"), F.min(F.struct("k1", "k2", "pos")).alias("one")))
    # positions whose surroundings are the same all the way are repeated whole; of each sort one goes on, for the others to be held against
    whole = live.where("core is null").select("k1", "k2", "pos").unionByName(mixed.join(same.where("n > 1").select("core", "sup"), ["core", "sup"]).select("k1", "k2", "pos"))
    whole = whole.select("k1", "k2", F.greatest(F.col("pos") - OFFSETS + 1, F.lit(0)).alias("from_byte"), (F.col("pos") + length).alias("to_byte"))
    at = same.groupBy("one.k1", "one.k2").agg(F.collect_list(F.struct("one.pos", F.least("n", F.lit(2)).cast("int").alias("weight"))).alias("at"))
    d = documents.select(F.col("k1").alias("h1"), F.col("k2").alias("h2"), "text")
    around = F.transform("at", lambda a: F.struct(a["pos"].alias("pos"), a["weight"].alias("weight"), F.greatest(F.lit(OFFSETS - 1) - a["pos"], F.lit(0)).alias("lo"), F.substring(F.col("text"), F.greatest(a["pos"] - OFFSETS + 2, F.lit(1)), F.least(a["pos"], F.lit(OFFSETS - 1)) + length).alias("data")))
    first = at.join(d, (F.col("k1") == F.col("h1")) & (F.col("k2") == F.col("h2")))
    place = packed(first.select("k1", "k2", F.explode(around).alias("r")).select(F.monotonically_increasing_id().alias("id"), "k1", "k2", "r.pos", "r.weight", "r.lo", "r.data"))
    parts, spans, size = place.select("id", F.lit(0).alias("x0"), "weight", "lo", "data"), [], OFFSETS
    for fan in FANOUT:
        size //= fan
        children = [F.struct(c.alias("x"), *_ranked(c, c + size - 1, length)) for c in (F.col("x0") + i * size for i in range(fan))]
        rows = packed(parts.select("id", "weight", F.explode(F.array(*children)).alias("r")).where("r.core is not null").select("id", "r.x", "weight", "r.core", "r.all"))
        # who is alone in its rank drops out; where all that share it are the same all the way, they are repeated whole
        ranks = packed(rows.groupBy("core").agg(F.sum("weight").alias("n"), F.min("all").alias("a"), F.max("all").alias("b")).where("n > 1").select("core", (F.col("a") != F.col("b")).alias("mixed")))
        live = packed(rows.join(ranks, "core"))
        spans.append(live.where("not mixed and weight = 1").select("id", "x", F.lit(size).alias("size")))
        mixed = live.where("mixed")
        same = packed(mixed.groupBy("core", "all").agg(F.sum("weight").alias("n"), F.count("*").alias("rows"), F.min("id").alias("id"), F.max("id").alias("last"), F.min("x").alias("x")))
        again = same.where("n > 1")
        spans.append(again.select(F.explode(F.array_distinct(F.array("id", "last"))).alias("id"), "x", F.lit(size).alias("size")))
        spans.append(mixed.where("weight = 1").join(again.where("rows > 2").select("core", "all"), ["core", "all"]).select("id", "x", F.lit(size).alias("size")))
        if size == 1:
            break
        parts = same.select("id", F.col("x").alias("x0"), F.least("n", F.lit(2)).cast("int").alias("weight")).join(place.select("id", "lo", "data"), "id")
    out = spans[0]
    for s in spans[1:]:
        out = out.unionByName(s)
    y, left = F.col("x") + F.col("size") - 1, F.lit(OFFSETS - 1) - F.col("lo")
    fine = out.join(place.select("id", "k1", "k2", "pos", "lo", F.octet_length("data").alias("n")), "id").select(
        "k1",
        "k2",
        (F.col("pos") - left + F.greatest(left - y, F.lit(0))).alias("from_byte"),
        (F.col("pos") - left + F.least(left - F.col("x") + length, F.col("n"))).alias("to_byte"),
    )
    return whole.unionByName(fine)


def remove_repeats(documents: DataFrame, length: int = 200, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """Remove every byte that lies in a string of `length` bytes that starts anywhere else too.

    Returns doc_id, n_bytes, n_removed, n_spans, kept_sha256, one row per row of documents. A null text counts as
    empty; texts shorter than `length` lose nothing; two equal texts of `length` bytes or more lose everything, the
    same row given twice included; a null doc_id is carried along. Other columns are not looked at.
    """
    d = documents.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.encode(F.col(text), "utf-8"), F.lit(b"")).alias("text"))
    d = d.select("doc_id", "text", F.xxhash64("doc_id", "text").alias("k1"), F.xxhash64(F.lit(1), "text", "doc_id").alias("k2"))
    spans = repeated_spans(d.select("k1", "k2", "text"), length)
    # a set: rows that are the same all have all spans of theirs
    span = F.struct(F.col("from_byte").cast("int").alias("f"), F.col("to_byte").cast("int").alias("t"))
    spans = spans.groupBy(F.col("k1").alias("h1"), F.col("k2").alias("h2")).agg(F.collect_set(span).alias("spans"))
    both = d.join(spans, (F.col("k1") == F.col("h1")) & (F.col("k2") == F.col("h2")), "left")
    clipped = F.transform("spans", lambda s: F.struct(s["f"].alias("f"), F.least(s["t"], F.octet_length("text")).alias("t")))
    return both.select("doc_id", "text", clipped.alias("spans")).mapInArrow(_kept, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
