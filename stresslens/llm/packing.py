"""Vector bin packing of token sequences under limits on tokens, segments and loss-bearing tokens at once.

Every task packs the rows that it reads, so nothing is shuffled and no key matters. It holds a pool of examples of
bounded size; sequences are filled one after another with the example whose demand has the largest dot product with
what the sequence has left, each dimension weighted by how scarce it is in the pool. Where examples may be cut, one
that no longer fits fills what is left. What a task can't fill at its end is cut into sequences of lengths that need
no padding, or, of whole examples, padded: at most one sequence a task below what the pool allows.

A lost task that runs again reads the same rows and packs the same; how rows are split into tasks decides the sequences.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StructField, StructType

from stresslens.llm.texts import raw
from stresslens.llm.tokens import Words, vocabulary

#: Examples that a task holds back at once.
POOL = 1024


@dataclass(frozen=True)
class Limits:
    """What a sequence holds at most. powers: a sequence of a power of two tokens needs no padding."""

    tokens: int = 2048
    segments: int = 256
    loss: int = 2048
    powers: bool = False

    def __post_init__(self):
        if min(self.tokens, self.segments, self.loss) < 1:
            raise ValueError("a sequence must hold one token, one segment and one loss-bearing token at least")


@dataclass
class Piece:
    """Consecutive tokens of one example; heavy says which bear loss."""

    row: int
    start: int
    ids: np.ndarray
    heavy: np.ndarray
    total: list[int]

    def split(self, n: int) -> tuple[Piece, Piece]:
        return Piece(self.row, self.start, self.ids[:n], self.heavy[:n], self.total), Piece(self.row, self.start + n, self.ids[n:], self.heavy[n:], self.total)

    def within(self, tokens: int, loss: int) -> int:
        """The most tokens from the start of this piece that both allow."""
        n = min(tokens, len(self.ids))
        return n if n <= loss else int(np.searchsorted(np.cumsum(self.heavy[:n]), loss, "right"))

    def demand(self) -> tuple[int, int, int]:
        return len(self.ids), 1, int(self.heavy.sum())


class Packer:
    """One task's pool and the sequences that it has closed, as rows (row, start, length, crc, loss, total, sequence, offset)."""

    def __init__(self, limits: Limits, cut: bool, number: int):
        self.limits, self.cut, self.number, self.rows = limits, cut, number << 40, []
        self.most = np.array([limits.tokens, limits.segments, limits.loss])
        self.pool: list[Piece] = []
        self.sizes = np.zeros((0, 3), np.int64)
        self.fresh: list[Piece] = []

    def told(self, p: Piece, sequence: int | None, offset: int | None) -> tuple:
        return p.row, p.start, len(p.ids), zlib.crc32(p.ids.astype("<u4").tobytes()), int(p.heavy.sum()), p.total, sequence, offset

    def close(self, pieces: list[Piece]) -> None:
        at = 0
        for p in pieces:
            self.rows.append(self.told(p, self.number, at))
            at += len(p.ids)
        self.number += 1

    def add(self, row: int, parts: Iterator[tuple[np.ndarray, np.ndarray]]) -> None:
        """An example in consecutive parts of ids and of whether they bear loss."""
        total, start, rest = [0], 0, None
        for ids, heavy in parts:
            total[0] += len(ids)
            p = Piece(row, start, ids, heavy, total)
            start += len(ids)
            if rest is not None:
                p = Piece(row, rest.start, np.concatenate([rest.ids, ids]), np.concatenate([rest.heavy, heavy]), total)
            while self.cut and (n := p.within(self.limits.tokens, self.limits.loss)) < len(p.ids) and n:
                whole, p = p.split(n)
                self.ready(whole)
            rest = p
        if rest is None or not len(rest.ids):
            return
        if not self.cut and (np.array(rest.demand()) > self.most).any():
            self.rows.append(self.told(rest, None, None))
        else:
            self.ready(rest)

    def ready(self, p: Piece) -> None:
        if len(p.ids) == self.limits.tokens:
            self.close([p])
        else:
            self.fresh.append(p)

    def flush(self, last: bool = False) -> None:
        """Close sequences until the pool is within its bound, or empty."""
        if not last and len(self.fresh) < POOL:
            return
        self.pool += self.fresh
        self.sizes = np.concatenate([self.sizes, np.array([p.demand() for p in self.fresh], np.int64).reshape(-1, 3)])
        self.fresh = []
        while self.pool and (last or len(self.pool) > POOL // 2):
            self.close(self.trimmed(self.fill()))

    def take(self, i: int) -> Piece:
        """The last piece of the pool moves into the place of the one taken."""
        p, end = self.pool[i], len(self.pool) - 1
        self.pool[i], self.sizes[i] = self.pool[end], self.sizes[end]
        self.pool.pop()
        self.sizes = self.sizes[:end]
        return p

    def back(self, p: Piece) -> None:
        self.pool.append(p)
        self.sizes = np.concatenate([self.sizes, np.array([p.demand()], np.int64)])

    def fill(self) -> list[Piece]:
        left, pieces = self.most.copy(), []
        weight = self.sizes.mean(axis=0) / self.most / self.most**2
        while self.pool and left[0] and left[1]:
            score = self.sizes @ (weight * left)
            fits = (self.sizes <= left).all(axis=1)
            if fits.any():
                p = self.take(int(np.argmax(np.where(fits, score, -1.0))))
            else:
                i = int(np.argmax(score))
                n = self.pool[i].within(int(left[0]), int(left[2])) if self.cut else 0
                if not n:
                    break
                p, rest = self.take(i).split(n)
                self.back(rest)
            pieces.append(p)
            left -= p.demand()
        return pieces

    def trimmed(self, pieces: list[Piece]) -> list[Piece]:
        """Cut a sequence back to a power of two tokens, where that saves padding."""
        n = sum(len(p.ids) for p in pieces)
        if not (self.cut and self.limits.powers) or n == self.limits.tokens:
            return pieces
        spare = n - (1 << (n.bit_length() - 1))
        while spare:
            p = pieces.pop()
            keep = max(0, len(p.ids) - spare)
            spare -= len(p.ids) - keep
            if keep:
                p, rest = p.split(keep)
                pieces.append(p)
            else:
                rest = p
            self.back(rest)
        return pieces

    def done(self) -> list[tuple]:
        out, self.rows = self.rows, []
        return [(*r[:5], r[5][0], *r[6:]) for r in out]


PIECES = StructType([StructField(n, IntegerType() if n == "loss" else LongType()) for n in ("start", "length", "ids_crc32", "loss", "tokens", "sequence_id", "offset")])


def packed_rows(batches: Iterator[pa.RecordBatch], examples, limits: Limits, cut: bool) -> Iterator[pa.RecordBatch]:
    """examples: of a batch, an iterator of each row's parts. Column `of` names the rows in what comes out."""
    from pyspark import TaskContext

    packer, kept, base = Packer(limits, cut, TaskContext.get().partitionId()), None, 0
    for b in batches:
        of = b.column("of")
        kept = of if kept is None else pa.concat_arrays([kept, of])
        for i, parts in enumerate(examples(b)):
            packer.add(base + i, parts)
            packer.flush()
        base += b.num_rows
        yield from rows_of(packer, kept, base - len(kept))
        needed = min([p.row for p in packer.pool + packer.fresh], default=base)  # rows before it are all told
        kept = kept[needed - (base - len(kept)) :]
    if kept is not None:
        packer.flush(last=True)
        yield from rows_of(packer, kept, base - len(kept))


def rows_of(packer: Packer, kept: pa.Array, first: int) -> Iterator[pa.RecordBatch]:
    """kept: the names of rows from number first on."""
    if rows := packer.done():
        columns = list(zip(*rows, strict=True))
        arrays = [pa.array(c, pa.int32() if f.name == "loss" else pa.int64()) for f, c in zip(PIECES, columns[1:], strict=True)]
        of = kept.take(pa.array([r - first for r in columns[0]], pa.int64()))
        yield pa.RecordBatch.from_arrays([of, *arrays], ["of", *PIECES.names])


def pack_texts(documents: DataFrame, doc_id: str = "doc_id", text: str = "text", limits: Limits = Limits(powers=True), end: int = 1, path: str | None = None) -> DataFrame:
    """A row for each piece of a document: of (doc_id), start, length, ids_crc32, loss, tokens (the document's), sequence_id, offset.

    A document is its text's ids and then the id `end`; all bear loss. Null and empty texts are that id alone. Documents
    are cut freely, so with limits.powers nothing is padded. Rows given twice are packed twice; doc_id may be null.
    """
    d = documents.select(F.col(doc_id).cast("long").alias("of"), F.col(text).alias("text"))

    def work(batches):
        model = Words(path or vocabulary("word_bpe_49k.json"))

        def parts(t):
            for ids in model.ids(t):
                yield ids, np.ones(len(ids), bool)
            yield np.array([end], "<u4"), np.ones(1, bool)

        yield from packed_rows(batches, lambda b: (parts(t) for t in raw(b.column("text"))), limits, cut=True)

    return d.mapInArrow(work, StructType([d.schema["of"], *PIECES]))


def pack_examples(examples: DataFrame, key: str, ids: str, loss: str, limits: Limits = Limits(), cut: bool = False) -> DataFrame:
    """The same for tokenised examples: ids is an array of integers, loss one of booleans that says which bear loss.

    A null loss, or null entries of it, mean that tokens bear loss; one shorter than ids leaves the rest without. Null and
    empty ids make no row. Where cut is false, examples stay whole, and one that exceeds a limit on its own gets a
    row with null sequence_id and offset. key may be null or given twice; each row is an example.
    """
    q = lambda name: F.col("`" + name.replace("`", "``") + "`")
    n = F.size(F.coalesce(q(ids), F.array().cast("array<long>")))
    heavy = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.when(q(loss).isNull(), True).when(i >= F.size(q(loss)), False).otherwise(F.coalesce(F.get(q(loss), i), F.lit(True))))
    d = examples.where(n > 0).select(q(key).alias("of"), F.transform(q(ids), lambda x: F.coalesce(x, F.lit(0)).cast("long")).alias("ids"), heavy.alias("heavy"))

    def work(batches):
        def parts(b):
            a, h = b.column("ids"), b.column("heavy")
            for i in range(b.num_rows):
                yield iter([(a[i].values.to_numpy().astype("<u4"), h[i].values.to_numpy(zero_copy_only=False))])

        yield from packed_rows(batches, parts, limits, cut)

    return d.mapInArrow(work, StructType([d.schema["of"], *PIECES]))
