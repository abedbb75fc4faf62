"""Near duplicates by SimHash, found over signatures with one bit deleted.

A fingerprint is cut into so few segments that of two fingerprints within the distance one segment differs in a
single bit at most: distance // 2 + 1 segments, three for four bits. Each segment is indexed once for each of its
bits with that bit wild, so equality on (segment, wild bit, remaining bits) brings every such pair together: rows are
dealt and sorted by key, and the distance is verified within a run of equal keys, which gives back no more links than
connect what is linked there.

Equal fingerprints are one, however many documents have them. A segment value that more than CROWD fingerprints share
would make long runs; such fingerprints are compared another way, exactly: each emits every number that differs from
it in half the distance of bits, two that are linked meet in one of them, and so few fingerprints can meet in one
number (2081 at four bits) that no run is long.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stresslens.llm.common import components, cut, packed
from stresslens.llm.texts import pieces, raw

SEED = 42
_ONES = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).astype(np.int64)


def _tally(words: list[bytes], size: int, counts: np.ndarray) -> int:
    """Add to counts how often each byte of the hashes of the shingles has each value; the number of shingles."""
    text = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = np.concatenate([[0], ends[:-1]])[: len(words) - size + 1].tolist()
    xx = xxhash.xxh64_intdigest
    h = np.fromiter((xx(text[a:b], SEED) for a, b in zip(starts, (ends[size - 1 :] - 1).tolist(), strict=True)), np.uint64, len(starts))
    place = h.astype(">u8").view(np.uint8).reshape(-1, 8) + np.arange(0, 2048, 256, dtype=np.int64)
    counts += np.bincount(place.ravel(), minlength=2048)
    return len(starts)


def majority(counts: np.ndarray, total: int) -> int:
    """The bits that more than half of total hashes have, by how often each of their bytes has each value; 0 for none."""
    ones = (counts.reshape(8, 256) @ _ONES).ravel()
    return int(np.packbits(2 * ones > total).view(">u8")[0].astype(np.int64)) if total else 0


def fingerprint(text: bytes, size: int) -> int:
    """The SimHash of a text's word shingles, as a signed 64-bit number; 0 without words."""
    counts, total, carry = np.zeros(2048, np.int64), 0, []
    for piece in pieces(text.lower()):
        words = carry + piece.split()
        if len(words) >= size:
            total += _tally(words, size, counts)
            words = words[len(words) - size + 1 :]
        carry = words
    if not total and carry:
        total = _tally([b" ".join(carry)], 1, counts)
    return majority(counts, total)


def fingerprints(documents: DataFrame, size: int = 4) -> DataFrame:
    """doc_id, th (xxhash64 of the text), fp for every row of documents (doc_id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = [fingerprint(t, size) for t in raw(batch.column(2))]
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(fp, pa.int64())], ["doc_id", "th", "fp"])

    return documents.select(F.col("doc_id").cast("long"), F.xxhash64("text").alias("th"), "text").mapInArrow(run, "doc_id long, th long, fp long")


#: A key's run holds at most twice so many fingerprints.
CROWD = 1 << 14
#: The bitmap of crowded segment values has 2**BITS bits; a value that shares another's bit goes the other way too.
BITS = 24
_ODD = np.uint64(0x9E3779B97F4A7C15)


def segments(distance: int) -> list[tuple[int, int]]:
    """The first bit and the number of bits of each segment."""
    if not 0 <= distance <= 5:
        raise ValueError("distance must be from 0 to 5")
    n = distance // 2 + 1
    edges = [64 * i // n for i in range(n + 1)]
    return list(zip(edges, (b - a for a, b in zip(edges, edges[1:], strict=False)), strict=False))


def _mixed(value: np.ndarray, number: int) -> np.ndarray:
    h = (value ^ np.uint64(number)) * _ODD
    h = (h ^ (h >> np.uint64(32))) * _ODD
    return h ^ (h >> np.uint64(29))


def _parts(fp: np.ndarray, distance: int) -> Iterator[tuple[int, int, np.ndarray]]:
    for low, size in segments(distance):
        yield low, size, (fp >> np.uint64(low)) & np.uint64((1 << size) - 1)


def _crowded(fps: DataFrame, distance: int, crowd: int) -> np.ndarray | None:
    """A bit for each segment value that more than crowd fingerprints have; none if there is no such value."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = np.asarray(batch.column(0)).view(np.uint64)
            for low, _, value in _parts(fp, distance):
                yield pa.record_batch([pa.array(_mixed(value, low).view(np.int64))], ["v"])

    # equal fingerprints are counted before the shuffle; a segment has few values or few rows each
    many = fps.mapInArrow(run, "v long").groupBy("v").count().where(F.col("count") > crowd)
    bit = F.shiftrightunsigned("v", 64 - BITS)
    words = many.select(F.shiftright(bit, 6).alias("k"), F.expr(f"shiftleft(1L, cast(shiftrightunsigned(v, {64 - BITS}) & 63 as int))").alias("w")).groupBy("k").agg(F.bit_or("w").alias("w"))
    found = words.collect()  # 2**BITS / 64 rows at most
    if not found:
        return None
    bitmap = np.zeros(1 << BITS - 6, np.int64)
    for r in found:
        bitmap[r.k] = r.w
    return np.unpackbits(bitmap.astype("<i8").view(np.uint8), bitorder="little").astype(bool)


def variants(fp: np.ndarray, distance: int, crowded: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """For each fingerprint a key for each bit of each segment with that bit wild, and whether a run of that key could be long."""
    keys, long = np.empty((len(fp), 64), np.uint64), np.zeros((len(fp), 64), bool)
    for low, size, value in _parts(fp, distance):
        has = np.zeros(len(fp), bool) if crowded is None else crowded[(_mixed(value, low) >> np.uint64(64 - BITS)).astype(np.int64)]
        for j in range(size):
            wild = np.uint64(1 << j)
            keys[:, low + j] = _mixed(value & ~wild, 64 + low + j)
            if crowded is not None:
                long[:, low + j] = has | crowded[(_mixed(value ^ wild, low) >> np.uint64(64 - BITS)).astype(np.int64)]
    return keys, long


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, ...]]:
    """The columns of batches sorted by the first one, cut between its values."""
    held: list[np.ndarray] = []
    for batch in batches:
        now = [np.asarray(c) for c in batch.columns]
        if held:
            now = [np.concatenate(x) for x in zip(held, now, strict=True)]
        last = int(np.searchsorted(now[0], now[0][-1])) if len(now[0]) else 0
        if last:
            yield tuple(x[:last] for x in now)
        held = [x[last:] for x in now]
    if held and len(held[0]):
        yield tuple(held)


def _united(label: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """label, which gives each row the first one that it is linked to, after linking i with j."""
    while True:
        a, b = label[i], label[j]
        new = a != b
        if not new.any():
            return label
        i, j = i[new], j[new]
        np.minimum.at(label, np.maximum(a[new], b[new]), np.minimum(a[new], b[new]))
        while (label != (down := label[label])).any():
            label = down


def _linked(key: np.ndarray, fp: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """Links that connect, in each run of equal keys, the fingerprints within the distance."""
    label, off = np.arange(len(fp)), 1
    i = np.flatnonzero(key[:-1] == key[1:])
    while len(i):
        near = i[np.bitwise_count(fp[i] ^ fp[i + off]) <= distance]
        if len(near):
            label = _united(label, near, near + off)
        off += 1
        i = i[i + off < len(key)]
        i = i[key[i] == key[i + off]]
    moved = np.flatnonzero(label != np.arange(len(fp)))
    return fp[moved], fp[label[moved]]


def _pairs(a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
    return pa.record_batch([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], ["a", "b"])


def flips(half: int) -> list[int]:
    """All numbers with so many bits at most, by how many they have."""
    return [sum(1 << b for b in bits) for n in range(half + 1) for bits in combinations(range(64), n)]


def _met(crowd: DataFrame, distance: int) -> DataFrame:
    """a, b: links that connect those of the fingerprints that are within the distance: they meet halfway."""
    masks = np.array(flips(-(-distance // 2)), np.uint64)
    far = np.bitwise_count(masks) > distance // 2  # of an odd distance, one goes the longer way

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = np.asarray(batch.column(0)).view(np.uint64)
            for at in range(0, len(fp), 64):
                some = fp[at : at + 64]
                columns = ((some[:, None] ^ masks).ravel(), np.tile(far, len(some)), np.repeat(some, len(masks)))
                yield pa.record_batch([pa.array(columns[0].view(np.int64)), pa.array(columns[1]), pa.array(columns[2].view(np.int64))], ["key", "far", "fp"])

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, centre = None, 0
        for batch in batches:
            k, fp = np.asarray(batch.column(0)), np.asarray(batch.column(2))
            far_ = np.asarray(batch.column(1).cast(pa.int8())).astype(bool)
            if not len(k):
                continue
            first = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]]))
            centres, open_ = fp[first].copy(), ~far_[first]
            if key is not None and key[0] == k[0]:
                centres[0], open_[0] = centre, key[1]
            of = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(k))))
            out = open_[of] & (fp != centres[of])
            key, centre = (k[-1], bool(open_[-1])), centres[-1]
            yield _pairs(fp[out], centres[of][out])

    rows = crowd.mapInArrow(emit, "key long, far boolean, fp long").repartition("key").sortWithinPartitions("key", "far", "fp")
    return rows.mapInArrow(meet, "a long, b long")


def edges(fps: DataFrame, distance: int = 4, crowd: int = CROWD) -> DataFrame:
    """a, b: links that connect all distinct fingerprints (fp) that are within the distance of each other."""
    crowded = _crowded(fps, distance, crowd)
    shared = fps.sparkSession.sparkContext.broadcast(crowded)

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = np.asarray(batch.column(0)).view(np.uint64)
            for at in range(0, len(fp), 1024):
                some = fp[at : at + 1024]
                keys, long = variants(some, distance, shared.value)
                fine = ~long
                yield pa.record_batch([pa.array(keys[fine].view(np.int64)), pa.array(np.repeat(some, fine.sum(1)).view(np.int64))], ["key", "fp"])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, fp in _runs(batches):
            yield _pairs(*_linked(key, fp.view(np.uint64), distance))

    keyed = fps.select("fp").mapInArrow(emit, "key long, fp long").repartition("key").sortWithinPartitions("key")
    found = keyed.mapInArrow(compare, "a long, b long")
    if crowded is None:
        return found

    def full(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = np.asarray(batch.column(0)).view(np.uint64)
            yield batch.filter(pa.array(variants(fp, distance, shared.value)[1].any(1)))

    return found.unionByName(_met(fps.select("fp").mapInArrow(full, "fp long"), distance))


def link(fps: DataFrame, distance: int = 4, crowd: int = CROWD) -> DataFrame:
    """(fp, root) for every distinct fp that has another within the distance; root is the same for all that are linked."""
    return components(edges(fps, distance, crowd)).toDF("fp", "root")


#: The rows of a component are dealt into so many parts when they get its id.
_SALTS = 16


def _joined(prints: DataFrame, distance: int) -> DataFrame:
    """prints (doc_id, th, fp) and one: the least (doc_id is null, doc_id, th) of the row's component."""
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "th"))
    spread = int(prints.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    by_fp = cut(prints.groupBy("fp").agg(first.alias("one")).repartition(spread, "fp"))
    roots = cut(by_fp.join(link(by_fp.select("fp"), distance), "fp").withColumn("salt", F.pmod("fp", F.lit(_SALTS))))
    least = roots.groupBy("root").agg(F.min("one").alias("least")).withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(_SALTS - 1).cast("long"))))
    linked = roots.join(least, ["root", "salt"]).select(F.col("fp").alias("f"), "least")
    # a table again, so that Spark can split the rows of a fingerprint that very many documents have
    every = packed(by_fp.join(linked, F.col("fp") == F.col("f"), "left").select("fp", F.coalesce("least", "one").alias("one")))
    return prints.join(every, "fp")


def groups(documents: DataFrame, words: int = 4, distance: int = 4, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, fp and component_id, the smallest doc_id that is reached over links, for every row of documents.

    Null and blank texts have the fingerprint zero and are linked like any other. A null doc_id is never a
    component_id unless the whole component has none. Repeated rows each come back. Other columns are not looked at.
    """
    prints = cut(fingerprints(documents.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")), words))
    return _joined(prints, distance).select("doc_id", "fp", F.col("one.doc_id").alias("component_id"))


def as_hex(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))
