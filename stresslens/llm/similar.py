"""Near duplicates by the Jaccard similarity of word shingles: SimHash and MinHash propose pairs, the texts decide.

The SimHash of the shingle set, linked by the deletion variants of simhash.edges(), proposes the pairs that differ in
few bits. It can't be all: texts of similarity 0.8 differ in ten bits of 64 on average, and no cut of 64 bits into
segments finds those without comparing nearly everything. So MinHash bands propose the others: two texts of similarity
J share one of BANDS bands of ROWS least hashes with probability 1 - (1 - J**ROWS)**BANDS, 0.9995 for 0.8 and more
above. Texts with equal shingle sets are one. Shingle hashes of the sets that anything is proposed for are written once
and dealt by group, and a group's sets are compared in place: each set first with the one that is the least in most of
its buckets, then, in buckets that still hold sets of different components, with all others there. Of a group only links between
components leave the task, fewer than it has sets, however many of its pairs are looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stresslens.llm import simhash
from stresslens.llm.common import components, cut, packed
from stresslens.llm.texts import pieces, raw, windows

BANDS, ROWS = 25, 6
_ODD = np.uint64(0x9E3779B97F4A7C15)
_DRAW = np.random.Generator(np.random.PCG64(42))
_XOR, _TIMES = (_DRAW.integers(0, 1 << 64, BANDS * ROWS, np.uint64) for _ in range(2))
_TIMES |= np.uint64(1)
_CHUNK = 4096
#: So many sets of a group are compared in one place at most, with as many others.
BLOCK = 2048


def shingles(text: bytes, size: int) -> np.ndarray:
    """The sorted distinct hashes of a text's word shingles, of all words where there are fewer; none without words."""
    found, carry = [], []
    for piece in pieces(text.lower()):
        words = carry + piece.split()
        if len(words) >= size:
            found.append(np.unique(windows(_words(words), size)))
            words = words[len(words) - size + 1 :]
        carry = words
    if not found and carry:
        found.append(windows(_words(carry), len(carry)))
    return np.unique(np.concatenate(found)) if found else np.zeros(0, np.uint64)


def _words(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))


def bands(h: np.ndarray) -> np.ndarray:
    """A set's key in each band."""
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max)
    for i in range(0, len(h), _CHUNK):
        np.minimum(least, ((h[i : i + _CHUNK, None] ^ _XOR) * _TIMES).min(axis=0), out=least)
    key = np.arange(BANDS, dtype=np.uint64)
    for k in range(ROWS):
        key = (key ^ least[k::ROWS]) * _ODD
        key ^= key >> np.uint64(29)
    return key.view(np.int64)


def sketch(h: np.ndarray) -> int:
    """The SimHash of a set of hashes, as a signed 64-bit number; 0 for none."""
    counts = np.zeros(2048, np.int64)
    for i in range(0, len(h), 1 << 16):
        place = h[i : i + (1 << 16)].astype(">u8").view(np.uint8).reshape(-1, 8) + np.arange(0, 2048, 256, dtype=np.int64)
        counts += np.bincount(place.ravel(), minlength=2048)
    return simhash.majority(counts, len(h))


def _signed(documents: DataFrame, words: int) -> DataFrame:
    """doc_id, th, s (the hash of the shingle set), its SimHash and its bands for every row of documents (doc_id, th, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            h = [shingles(t, words) for t in raw(batch.column(2))]
            s = np.array([xxhash.xxh64_intdigest(x.tobytes()) for x in h], np.uint64).view(np.int64)
            keys = np.concatenate([bands(x) for x in h]) if h else np.zeros(0, np.int64)
            ends = pa.array(range(0, len(keys) + 1, BANDS), pa.int32())
            fp = pa.array([sketch(x) for x in h], pa.int64())
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(s), fp, pa.ListArray.from_arrays(ends, pa.array(keys))], ["doc_id", "th", "s", "fp", "bands"])

    return documents.mapInArrow(run, "doc_id long, th long, s long, fp long, bands array<long>")


def _hashes(asked: DataFrame, documents: DataFrame, sets: DataFrame, words: int) -> DataFrame:
    """s, h: the shingle hashes of the sets asked for (s, each once), from one text of each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.record_batch([batch.column(0), pa.array([shingles(t, words).tobytes() for t in raw(batch.column(1))], pa.binary())], ["s", "h"])

    where = sets.join(asked, "s").select("s", F.col("one.doc_id").alias("_d"), F.col("one.th").alias("_t"))
    texts = documents.join(where, F.col("doc_id").eqNullSafe(F.col("_d")) & (F.col("th") == F.col("_t"))).select("s", "text").dropDuplicates(["s"])
    return texts.mapInArrow(run, "s long, h binary")


def connecting(sets: list[np.ndarray], c: np.ndarray, side: np.ndarray, least: float) -> list[tuple[int, int]]:
    """Pairs of places in sets that are similar enough, as many as connect what they can connect of different components c.

    Sets with the same side other than -1 meet elsewhere and aren't compared.
    """
    c, out = c.copy(), []
    sizes = np.fromiter(map(len, sets), np.int64, len(sets))
    starts = np.concatenate([[0], np.cumsum(sizes)])
    values, place = np.unique(np.concatenate(sets), return_inverse=True)
    held = np.zeros(len(values), bool)
    for i in range(len(sets) - 1):
        open_ = (c[i + 1 :] != c[i]) & ((side[i + 1 :] != side[i]) | (side[i] == -1))
        if not open_.any():
            continue
        own = place[starts[i] : starts[i + 1]]
        held[own] = True
        both = np.diff(np.concatenate([[0], np.cumsum(held[place[starts[i + 1] :]])])[starts[i + 1 :] - starts[i + 1]])
        held[own] = False
        for j in (np.flatnonzero(open_ & (both / np.maximum(sizes[i] + sizes[i + 1 :] - both, 1) >= least)) + i + 1).tolist():
            if c[j] != c[i]:
                out.append((i, j))
                c[c == c[j]] = c[i]
    return out


def _linked(groups: DataFrame, hashes: DataFrame, least: float) -> DataFrame:
    """Pairs (a, b) that are similar enough of those in a group (key, s, c, side), as many as connect them, by exact comparison.

    Rows are dealt and sorted by key, and a run of equal keys is compared in place.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None
        for batch in batches:
            if not batch.num_rows:
                continue
            now = pa.Table.from_batches([batch])
            now = now if held is None else pa.concat_tables([held, now])
            key = now.column("key").to_numpy()
            last = int(np.searchsorted(key, key[-1]))
            held = now.slice(last)
            if last:
                yield compared(now.slice(0, last))
        if held is not None:
            yield compared(held)

    def compared(rows: pa.Table) -> pa.RecordBatch:
        key, s, c, side = (rows.column(n).to_numpy() for n in ("key", "s", "c", "side"))
        h = [np.frombuffer(x, np.uint64) for x in rows.column("h").to_pylist()]
        edges = np.concatenate([[0], np.flatnonzero(key[1:] != key[:-1]) + 1, [len(key)]]).tolist()
        found = [(at + i, at + j) for at, end in zip(edges, edges[1:], strict=False) for i, j in connecting(h[at:end], c[at:end], side[at:end], least)]
        a, b = np.array(found, np.int64).reshape(-1, 2).T
        return pa.record_batch([pa.array(s[a]), pa.array(s[b])], ["a", "b"])

    return groups.join(hashes, "s").select("key", "s", "c", "side", "h").repartition("key").sortWithinPartitions("key").mapInArrow(run, "a long, b long")


def _blocks(groups: DataFrame) -> DataFrame:
    """Groups (key, s, c) that hold several components, with side; one of more than BLOCK sets as pairs of its blocks."""
    several = groups.groupBy("key").agg(F.count("*").alias("n"), F.min("c").alias("low"), F.max("c").alias("high")).where("low <> high")
    b = F.ceil(F.col("n") / BLOCK).cast("int")
    g = groups.join(several.select(F.col("key").alias("of"), b.alias("b")), F.col("key") == F.col("of"))
    whole = g.where("b = 1").select("key", "s", "c", F.lit(-1).alias("side"))
    own = F.pmod("s", "b").cast("int")
    split = g.where("b > 1").select("key", "s", "c", own.alias("own"), F.explode(F.sequence(F.lit(0), F.col("b") - 1)).alias("x"))
    pair = F.xxhash64("key", F.least("own", "x"), F.greatest("own", "x"))
    # a block's sets are compared with each other where it is paired with itself
    return whole.unionByName(split.select(pair.alias("key"), "s", "c", F.when(F.col("own") == F.col("x"), -1).otherwise(F.col("own")).alias("side")))


def representatives(documents: DataFrame, words: int = 5, least: float = 0.8, bits: int = 4, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, th (xxhash64 of the text): of each group the document with the smallest id, and of its texts the one with the smallest hash.

    Texts whose shingles have a Jaccard similarity of least or more are linked, and groups are what links connect.
    bits: how far apart the SimHashes are that propose a pair. Null and blank texts are one group; a null doc_id
    stands for a group only if all in it are null. Repeated rows are one; other columns are not looked at.
    """
    documents = documents.select(F.col(doc_id).cast("long").alias("doc_id"), F.xxhash64(text).alias("th"), F.col(text).alias("text"))
    rows = cut(_signed(documents, words))
    one = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "th"))
    sets = cut(rows.groupBy("s").agg(one.alias("one"), F.any_value("fp").alias("fp"), F.any_value("bands").alias("bands")))
    prints = cut(sets.groupBy("fp").agg(F.min("s").alias("a")))
    close = simhash.edges(prints, bits).toDF("fp", "to").where("fp <> to").distinct()
    close = cut(close.join(prints, "fp").select("to", "a").join(prints.select(F.col("fp").alias("to"), F.col("a").alias("b")), "to").select("a", "b").where("a <> b"))
    same = sets.select("fp", "s").join(prints, "fp").where("s <> a").select("a", F.col("s").alias("b"))
    keyed = sets.select("s", F.explode("bands").alias("key"))
    buckets = keyed.groupBy("key").agg(F.count("*").alias("n"), F.min("s").alias("known")).where("n > 1").select(F.col("key").alias("of"), "known")
    full = cut(keyed.join(buckets, F.col("key") == F.col("of")).select("key", "s", "known"))
    often = full.where("s <> known").groupBy("s", "known").count().groupBy("s").agg(F.max_by("known", F.struct("count", "known")).alias("a"))
    stars = cut(often.select("a", F.col("s").alias("b")).unionByName(same).distinct())
    asked = full.select("s").union(stars.select(F.explode(F.array("a", "b")))).union(close.select(F.explode(F.array("a", "b")))).distinct()
    asked = cut(asked)
    hashes = packed(_hashes(asked, documents, sets, words))
    # a star's centre goes to each block of its ends
    ends = stars.join(stars.groupBy(F.col("a").alias("of")).agg(F.ceil(F.count("*") / BLOCK).alias("n")), F.col("a") == F.col("of"))
    centres = ends.select("a", "n").distinct().select(F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)).alias("x"), "a", F.col("a").alias("s"))
    ends = ends.select(F.pmod("b", "n").alias("x"), "a", F.col("b").alias("s")).unionByName(centres)
    ends = ends.select(F.xxhash64("a", "x").alias("key"), "s", F.col("s").alias("c"), F.lit(-1).alias("side"))
    first = cut(components(_linked(ends, hashes, least)).toDF("s", "root"))
    pairs = close.select(F.xxhash64("a", "b").alias("key"), F.explode(F.array("a", "b")).alias("s"))
    groups = full.select("key", "s").unionByName(pairs).join(first, "s", "left").select("key", "s", F.coalesce("root", "s").alias("c"))
    found = _linked(_blocks(cut(groups)), hashes, least)
    links = found.unionByName(first.select(F.col("s").alias("a"), F.col("root").alias("b")))
    roots = components(links).toDF("s", "root")
    grouped = rows.select("doc_id", "th", "s").join(roots, "s", "left").groupBy(F.coalesce("root", "s").alias("c")).agg(one.alias("x"))
    return grouped.select("x.doc_id", "x.th")
