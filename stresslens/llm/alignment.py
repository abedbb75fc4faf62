"""Alignment of the tokens of two tokenizers over the same bytes.

Both tokenizers cut before a run of spaces, so a text is a row of runs whose tokens are the same wherever they stand; a
batch of texts comes as its different runs, end to end, with the tokens' ids and the byte offsets at which they end, and
each text as numbers of runs. The offsets that both arrays of ends hold are where groups end: the tokens there are the links,
those from one such place to the next the groups. All runs of a batch are aligned at once by sorted arrays, and a text's
links and groups are those of its runs. How often a pair is linked is counted over exploded links, and each document's
links are summed against those counts.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stresslens.llm.common import cut, packed
from stresslens.llm.texts import raw
from stresslens.llm.tokens import ID_BITS, Twice, runs_of, vocabulary

#: So many pairs with their counts, some 60 MB, are broadcast at most; more are joined by a shuffle.
BROADCAST = 1 << 20
#: A batch of texts holds about so many bytes; what is made of it is some twenty times as large.
BATCH = 1 << 19

RUNS = "a_ids array<int>, a_ends array<int>, b_ids array<int>, b_ends array<int>, run_ends array<int>"
TEXTS = "texts array<struct<row: bigint, doc_id: bigint, part: int, parts: int, n_a: bigint, n_b: bigint, of: array<int>>>"


def given(documents: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    return documents.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))


def reader(byte_path: str | None = None, piece_path: str | None = None) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """What a task makes of its documents: RUNS and TEXTS, a row at a time."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        twice, row = Twice(byte_path or vocabulary("byte_bpe_50k.json"), piece_path or vocabulary("piece_bpe_32k.model")), TaskContext.get().partitionId() << 40
        batch, many = Batch(twice), 0
        for b in batches:
            for of, t in zip(b.column("doc_id").to_pylist(), raw(b.column("text")), strict=True):
                pieces = twice.cut(t)
                if len(pieces) > 1 and not all(map(twice.good, pieces)):
                    pieces = []
                for part, x in enumerate(pieces or [None]):
                    batch.add((row, of, part, max(len(pieces), 1)), x)
                    many += 64 + len(x or b"")
                    if many > BATCH:
                        yield batch.told()
                        batch, many = Batch(twice), 0
                row += 1
        if many:
            yield batch.told()

    return work


def tokenised(documents: DataFrame, byte_path: str | None = None, piece_path: str | None = None, **names: str) -> DataFrame:
    """RUNS and TEXTS: batches of texts. of says which runs a part of a text consists of; of texts without tokens it is null.

    row tells rows apart that share a doc_id. A long text comes in parts that both tokenizers cut at the same place; it
    is read once before any part is told, as a difference of bytes in one part leaves the whole without tokens.
    """
    return given(documents, **names).mapInArrow(reader(byte_path, piece_path), f"{RUNS}, {TEXTS}")


class Batch:
    """Parts of texts, to be told as numbers of their runs beside the runs' tokens, in flat arrays."""

    def __init__(self, twice: Twice):
        self.twice = twice
        self.texts: list[tuple] = []
        self.pieces: list[bytes | None] = []

    def add(self, text: tuple[int, int | None, int, int], piece: bytes | None) -> None:
        self.texts.append(text)
        self.pieces.append(piece)

    def runs(self) -> tuple[list[bytes], np.ndarray, np.ndarray, np.ndarray]:
        """The tokens of the different runs, the parts' runs as numbers of those, how many each part has, and which parts have tokens."""
        try:
            b"".join(x for x in self.pieces if x).decode()
            valid = self.pieces
        except UnicodeDecodeError:
            valid = [x if x and self.twice.good(x) else None for x in self.pieces]
        has = np.array([x is not None for x in valid])
        runs, edges = runs_of([x for x in valid if x is not None])
        of, sizes = runs.indices.to_numpy(), np.zeros(len(has), np.int64)
        sizes[has] = np.diff(edges)
        tokens = self.twice.known.all(runs.dictionary.to_pylist())
        good = np.array([x is not False for x in tokens], bool)
        if not good.all():
            whole = np.repeat(np.arange(len(has)), sizes)
            has[whole[~good[of]]] = False
            of, sizes = (np.cumsum(good) - 1)[of[has[whole]]].astype(np.int32), np.where(has, sizes, 0)
        return [x for x in tokens if x is not False], of, sizes, has

    def told(self) -> pa.RecordBatch:
        tokens, every, many, has = self.runs()
        sizes = np.fromiter(map(len, tokens), np.int64, len(tokens)) >> 2
        words, starts = np.frombuffer(b"".join(tokens), "<u4"), np.concatenate([[0], np.cumsum(sizes)])
        n_a = words[starts[:-1]].astype(np.int64)  # a run's words begin with the number of the first's tokens
        n_b, at = sizes - 1 - n_a, np.arange(len(words)) - np.repeat(starts[:-1], sizes)
        in_a, in_b = (at > 0) & (at <= np.repeat(n_a, sizes)), at > np.repeat(n_a, sizes)
        one = lambda x: pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x)
        columns = []
        for own in (words[in_a], words[in_b]):
            columns += [one(pa.array((own & ((1 << ID_BITS) - 1)).astype(np.int32))), one(pa.array(np.cumsum(own >> ID_BITS).astype(np.int32)))]
        ends = np.concatenate([[0], np.cumsum(words[in_a] >> ID_BITS)])[np.cumsum(n_a)]
        columns.append(one(pa.array(ends.astype(np.int32))))
        edges = np.concatenate([[0], np.cumsum(many)])
        counts = [np.concatenate([[0], np.cumsum(n[every])]) for n in (n_a, n_b)]
        of = pa.ListArray.from_arrays(pa.array(edges.astype(np.int32)), pa.array(every), mask=pa.array(~has))
        told = [pa.array(c, t) for c, t in zip(zip(*self.texts, strict=True), (pa.int64(), pa.int64(), pa.int32(), pa.int32()), strict=True)]
        told += [pa.array(np.diff(c[edges]).astype(np.int64)) for c in counts]
        texts = pa.StructArray.from_arrays([*told, of], ["row", "doc_id", "part", "parts", "n_a", "n_b", "of"])
        return pa.RecordBatch.from_arrays([*columns, one(texts)], ["a_ids", "a_ends", "b_ids", "b_ends", "run_ends", "texts"])


ALIGNED = "row bigint, doc_id bigint, part int, parts int, n_a bigint, n_b bigint, links array<bigint>, groups string"


def listed(values: pa.Array, sizes: np.ndarray) -> pa.Array:
    """values cut into lists of these sizes."""
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32()), values)


def known(a_ids: np.ndarray, a_ends: np.ndarray, b_ids: np.ndarray, b_ends: np.ndarray, run_ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Of all links (a's id times 65536 plus b's), how many each run has, and each run's groups (`a1,a2|b1;a3|b2`).

    For ids with ascending ends; each run ends where tokens of both end.
    """
    ends, a_at, b_at = np.intersect1d(a_ends, b_ends, assume_unique=True, return_indices=True)
    links = a_ids[a_at].astype(np.int64) * 65536 + b_ids[b_at]
    said = lambda ids, at: pc.binary_join(listed(pa.array(ids[: at[-1] + 1 if len(at) else 0]).cast(pa.string()), np.diff(at, prepend=-1)), ",")
    groups = pc.binary_join_element_wise(said(a_ids, a_at), said(b_ids, b_at), "|")
    sizes = np.diff(np.searchsorted(ends, run_ends, "right"), prepend=0)
    return links, sizes, pc.binary_join(listed(groups, sizes), ";")


def told(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """ALIGNED of RUNS and TEXTS. The runs are aligned once; a text's links and groups are those of its runs."""
    flat = lambda x: x.values if x.is_valid else pa.array([], pa.int32())
    for i in range(batch.num_rows):
        links, sizes, groups = known(*[flat(batch.column(c)[i]).to_numpy(zero_copy_only=False) for c in ("a_ids", "a_ends", "b_ids", "b_ends", "run_ends")])
        texts = batch.column("texts")[i].values
        of, starts = texts.field("of"), np.cumsum(sizes) - sizes
        runs, has = of.flatten().to_numpy(), of.is_valid()
        counts = pc.fill_null(pc.list_value_length(of), 0).to_numpy()
        many = sizes[runs]
        # the places of the links of each run of each text, one after the other
        at = np.arange(many.sum()) + np.repeat(starts[runs] - (np.cumsum(many) - many), many)
        edges = np.concatenate([[0], np.cumsum(many)])[np.concatenate([[0], np.cumsum(counts)])]
        none = pc.invert(has)
        linked = pa.ListArray.from_arrays(pa.array(edges, pa.int32()), pa.array(links[at]), mask=none)
        joined = pc.if_else(has, pc.binary_join(listed(groups.take(pa.array(runs)), counts), ";"), pa.scalar(None, pa.string()))
        names = ["row", "doc_id", "part", "parts", "n_a", "n_b"]
        yield pa.RecordBatch.from_arrays([*[texts.field(c) for c in names], linked, joined], [*names, "links", "groups"])


def aligned(tokens: DataFrame) -> DataFrame:
    """row, doc_id, part, parts, n_a, n_b, links and groups of each part of a text; links and groups are null where it has no tokens."""
    return tokens.mapInArrow(lambda batches: (x for b in batches for x in told(b)), ALIGNED)


def read(documents: DataFrame, byte_path: str | None = None, piece_path: str | None = None, **names: str) -> DataFrame:
    """aligned(tokenised(documents)) by one pass through Python: the tokens of a batch don't leave their task."""
    work = reader(byte_path, piece_path)
    return given(documents, **names).mapInArrow(lambda batches: (x for b in work(batches) for x in told(b)), ALIGNED)


def pair_counts(links: DataFrame) -> DataFrame:
    """pair, count, best: how often each pair is linked, and 1 if that is the most of all pairs with its b, ties included, else 0."""
    n = cut(links.select(F.explode("links").alias("pair")).groupBy("pair").agg(F.count("*").alias("count")))
    most = n.groupBy((F.col("pair") % 65536).alias("b")).agg(F.max("count").alias("most"))
    return cut(n.join(most, n["pair"] % 65536 == most["b"]).select("pair", "count", (F.col("count") == F.col("most")).cast("long").alias("best")))


def sums(links: DataFrame, counts: DataFrame, most: int = BROADCAST) -> DataFrame:
    """row, n_best, count_sum: of each row's links."""
    each = links.select("row", F.explode("links").alias("pair"))
    if counts.count() <= most:
        found = each.join(F.broadcast(counts), "pair").withColumn("n", F.lit(1))
    else:  # a pair that a third of all rows hold is split by the engine's skewed joins
        found = each.groupBy("row", "pair").agg(F.count("*").alias("n")).join(counts.hint("merge"), "pair")
    return found.groupBy("row").agg(F.sum(F.col("n") * F.col("best")).alias("n_best"), F.sum(F.col("n") * F.col("count")).alias("count_sum"))


def align(documents: DataFrame, most: int = BROADCAST, **names: str) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256: a row for each row of documents.

    Null and empty texts, invalid UTF-8 and texts whose bytes a tokenizer doesn't give back have zeros and ''. Rows given
    twice are rows each, and all count; doc_id may be null. A document's groups as text must fit into 2 GB.
    """
    d = read(documents, **names)
    alone = F.col("parts") == 1
    d = packed(d.select("row", "doc_id", "part", "parts", "n_a", "n_b", "links", F.when(alone, F.sha2("groups", 256)).alias("sha"), F.when(~alone, F.col("groups")).alias("groups")))
    counts = pair_counts(d)
    n = F.when(F.col("links").isNull(), 0).otherwise(F.size("links"))
    each = d.select("row", "doc_id", "part", "parts", "n_a", "n_b", n.alias("n"), "sha", "groups")
    long = each.where(~alone).groupBy("row", "doc_id").agg(F.sum("n_a").alias("n_a"), F.sum("n_b").alias("n_b"), F.sum("n").alias("n"), F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("part", "groups"))), lambda x: x["groups"]), ";"), 256).alias("sha"))
    whole = each.where(alone).select("row", "doc_id", "n_a", "n_b", "n", "sha").unionByName(long)
    found = sums(d, counts, most)
    got = whole.join(found.withColumnRenamed("row", "of"), F.col("row") == F.col("of"), "left")
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return got.select("doc_id", zero("n_a"), zero("n_b"), F.col("n").cast("long").alias("n_groups"), F.col("n").cast("long").alias("n_links"), zero("n_best"), zero("count_sum"), F.coalesce("sha", F.lit("")).alias("groups_sha256"))
