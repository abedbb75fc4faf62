"""Point-in-time join: of the versions of a key that hold at a moment, the one of highest priority.

A key's time is cut into chunks. Where a task reads versions it sorts them by key, chunk and falling priority and
paints: a version claims those of its seconds that no version before it has, found through next-free pointers, so each
second is claimed once however many versions lie over it. Only what shows is shuffled, as runs of seconds. Behind the
shuffle runs of all tasks are painted once more, key and chunk by key and chunk, and the moments that ask, sorted in
behind a chunk's runs, read their second. No join pairs moments with versions.

State is one chunk's seconds and the rows that own them. A key with a third of all rows is dealt over its chunks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from stresslens.llm.common import kept

#: Seconds of a chunk.
CHUNK = 256


class Timeline:
    """Owners of a chunk's seconds."""

    def __init__(self, seconds: int):
        self.free, self.owner = list(range(seconds + 1)), [-1] * seconds

    def next(self, i: int) -> int:
        """The first second from i on that nobody owns."""
        free = self.free
        while free[i] != i:
            free[i] = free[free[i]]
            i = free[i]
        return i

    def claim(self, start: int, end: int, who: int) -> list[tuple[int, int]]:
        """Give who all seconds from start to before end that are free yet; the runs that it got."""
        runs, i = [], self.next(start)
        while i < end:
            j = i + 1
            while j < end and self.free[j] == j:
                j += 1
            self.free[i:j] = [j] * (j - i)
            self.owner[i:j] = [who] * (j - i)
            runs.append((i, j))
            i = self.next(j)
        return runs


def fresh_groups(batch: pa.RecordBatch, last: tuple | None) -> tuple[list[bool], tuple]:
    """Where a row's key or chunk is another than that of the row before, and the batch's last."""
    k, c = batch.column("k"), batch.column("c")
    new = np.ones(len(k), bool)
    new[1:] = pc.or_(pc.not_equal(k[1:], k[:-1]), pc.not_equal(c[1:], c[:-1])).to_numpy(zero_copy_only=False)
    new[0] = last != (k[0].as_py(), c[0].as_py())
    return new.tolist(), (k[-1].as_py(), c[-1].as_py())


def paint(batches: Iterator[pa.RecordBatch], seconds: int) -> Iterator[pa.RecordBatch]:
    """The runs of seconds that versions, by falling priority within key and chunk, show in."""
    last, line = None, Timeline(seconds)
    for b in batches:
        if not b.num_rows:
            continue
        new, last = fresh_groups(b, last)
        rows, starts, ends = [], [], []
        for i, (fresh, s, e) in enumerate(zip(new, b.column("s").to_pylist(), b.column("e").to_pylist(), strict=True)):
            if fresh:
                line = Timeline(seconds)
            for x, y in line.claim(s, e, 0):
                rows.append(i)
                starts.append(x)
                ends.append(y)
        out = b.take(pa.array(rows, pa.int64()))
        for name, values in (("s", starts), ("e", ends)):
            out = out.set_column(out.schema.get_field_index(name), b.schema.field(name), pa.array(values, pa.int32()))
        yield out


def read(batches: Iterator[pa.RecordBatch], seconds: int) -> Iterator[pa.RecordBatch]:
    """Each moment with the version that owns its second; runs of versions stand before the moments of a chunk."""
    last, line, base, book = None, Timeline(seconds), 0, None
    for b in batches:
        if not b.num_rows:
            continue
        new, last = fresh_groups(b, last)
        before, claimed, asking, owners = 0 if book is None else len(book), [], [], []
        for i, (fresh, ask, s, e) in enumerate(zip(new, b.column("kind").to_pylist(), b.column("s").to_pylist(), b.column("e").to_pylist(), strict=True)):
            if fresh:
                line, base = Timeline(seconds), before + len(claimed)
            if ask:
                asking.append(i)
                owners.append(line.owner[s] if line.owner[s] >= 0 else None)
            elif line.claim(s, e, before + len(claimed)):
                claimed.append(i)
        won = b.column("won").take(pa.array(claimed, pa.int64()))
        pool = won if book is None else pa.concat_arrays([book, won])
        if asking:
            yield pa.RecordBatch.from_arrays([b.column("ask").take(pa.array(asking, pa.int64())), pool.take(pa.array(owners, pa.int64()))], ["ask", "won"])
        book, line.owner, base = pool[base:], [o - base if o >= 0 else -1 for o in line.owner], 0


def as_of(asks: DataFrame, versions: DataFrame, key: str, at: str, start: str, end: str, order: list[str], seconds: int = CHUNK) -> DataFrame:
    """(ask, won): each row of asks as a struct, and of the versions of its key with start <= at < end the one that is
    first by order, every column descending; null where there is none.

    at, start and end are whole seconds. Null keys equal nothing; a version without start or end, or with an end not
    after its start, never holds; an ask without key or moment gets null. Nulls in order come last. Versions equal
    in order are told apart by all their columns, so columns must be sortable; equal rows are one. An ask given
    several times is answered as often. Columns may have any names, as asks and versions stay structs.
    A version costs a row for each chunk that it spans, so seconds should not be far below its usual length.
    """
    q = lambda name: F.col("`" + name.replace("`", "``") + "`")
    first = lambda c: F.floor(c / seconds).cast("long")
    o = [f"o{i}" for i in range(len(order))]
    v = versions.where(q(key).isNotNull()).select(q(key).alias("k"), q(start).cast("long").alias("s"), q(end).cast("long").alias("e"), *[q(c).alias(n) for c, n in zip(order, o, strict=True)], F.struct(*kept(versions)).alias("won")).where("s < e")
    v = v.withColumn("c", F.explode(F.sequence(first(F.col("s")), first(F.col("e") - 1))))
    within = lambda c: (c - F.col("c") * seconds).cast("int")
    v = v.select("k", "c", within(F.greatest("s", F.col("c") * seconds)).alias("s"), within(F.least("e", (F.col("c") + 1) * seconds)).alias("e"), *o, "won")
    falling: list[Column] = [F.col(c).desc_nulls_last() for c in [*o, "won"]]
    runs = v.sortWithinPartitions("k", "c", *falling).mapInArrow(lambda b: paint(b, seconds), v.schema)

    a = asks.select(q(key).alias("k"), q(at).cast("long").alias("t"), F.struct(*kept(asks)).alias("ask"))
    can = F.col("k").isNotNull() & F.col("t").isNotNull()
    moments = a.where(can).withColumn("c", first(F.col("t"))).select("k", "c", within(F.col("t")).alias("s"), "ask", F.lit(1).alias("kind"))
    both = runs.withColumn("kind", F.lit(0)).unionByName(moments, allowMissingColumns=True)
    answer = StructType([both.schema["ask"], StructField("won", both.schema["won"].dataType)])
    told = both.repartition("k", "c").sortWithinPartitions("k", "c", "kind", *falling).mapInArrow(lambda b: read(b, seconds), answer)
    return told.unionByName(a.where(~can).select("ask", F.lit(None).cast(answer["won"].dataType).alias("won")))


def digits(doc_id: Column, group: int) -> Column:
    """The group-th eight hex digits of the sha256 of a number in decimal, as a number."""
    return F.conv(F.substring(F.sha2(doc_id.cast("string"), 256), 8 * group + 1, 8), 16, 10).cast("long")


#: Seconds of the events that digests stand for, and the age from which an answer is stale.
SPAN, STALE = 50000, 120


def feature_versions(documents: DataFrame) -> DataFrame:
    """Each document as a version of its source. doc_id, source, n_chars and lang may be null; one without doc_id or source is never usable."""
    a, b, c = (digits(F.col("doc_id"), i) for i in range(3))
    d = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "source", F.col("n_chars").cast("long").alias("n_chars"), "lang", (a % SPAN).alias("event"), (b % 600).alias("_b"), (c % 900).alias("_c"))
    d = d.withColumn("arrival", F.col("event") - 60 + F.col("_b"))
    return d.select("doc_id", "source", "n_chars", "lang", "event", "arrival", F.greatest("event", "arrival").alias("usable"), (F.col("event") + F.col("_c")).alias("expiry"))


def label_features(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, t, version_id, age, status, n_chars, lang: a row for each row of labels.

    A label whose doc_id is null or no document's, or whose document has no source, has no winner and status `none`;
    t is null only without doc_id. Documents that share a doc_id are versions each; labels then ask about the
    smallest of their sources.
    """
    of = documents.select(F.col("doc_id").cast("long").alias("of"), "source").where("of is not null").groupBy("of").agg(F.min("source").alias("source"))
    asked = labels.select(F.col("doc_id").cast("long").alias("doc_id"))
    asked = asked.join(of.hint("merge"), F.col("doc_id") == F.col("of"), "left").select("doc_id", "source", (digits(F.col("doc_id"), 3) % SPAN).alias("t"))
    got = as_of(asked, feature_versions(documents), "source", "t", "usable", "expiry", ["event", "arrival", "doc_id"])
    age = F.col("ask.t") - F.col("won.event")
    status = F.when(F.col("won").isNull(), "none").when(age > STALE, "stale").otherwise("fresh")
    only = lambda c: F.when(F.col("status") == "fresh", F.col(c))
    d = got.select("ask.doc_id", "ask.t", F.col("won.doc_id").alias("version_id"), age.alias("age"), status.alias("status"), F.col("won.n_chars").alias("_n"), F.col("won.lang").alias("_l"))
    return d.select("doc_id", "t", "version_id", "age", "status", only("_n").alias("n_chars"), only("_l").alias("lang"))


#: The same rows in SQL, by a join of moments with versions.
LABELS_SQL = """
WITH d AS (
  SELECT doc_id, source, n_chars, lang,
    ('0x' || substr(sha256(doc_id::VARCHAR), 1, 8))::BIGINT % 50000 AS event,
    ('0x' || substr(sha256(doc_id::VARCHAR), 9, 8))::BIGINT % 600 AS b,
    ('0x' || substr(sha256(doc_id::VARCHAR), 17, 8))::BIGINT % 900 AS c
  FROM documents),
v AS (SELECT *, event - 60 + b AS arrival, event + c AS expiry FROM d),
q AS (
  SELECT row_number() OVER () AS n, l.doc_id, ('0x' || substr(sha256(l.doc_id::VARCHAR), 25, 8))::BIGINT % 50000 AS t, s.source
  FROM labels l LEFT JOIN (SELECT doc_id, min(source) AS source FROM documents GROUP BY doc_id) s ON s.doc_id = l.doc_id),
w AS (
  SELECT q.n, q.doc_id, q.t, v.doc_id AS version_id, q.t - v.event AS age, v.n_chars, v.lang,
    row_number() OVER (PARTITION BY q.n ORDER BY v.event DESC NULLS LAST, v.arrival DESC, v.doc_id DESC) AS r
  FROM q LEFT JOIN v ON v.source = q.source AND v.event <= q.t AND v.arrival <= q.t AND q.t < v.expiry)
SELECT doc_id, t, version_id, age, CASE WHEN version_id IS NULL THEN 'none' WHEN age > 120 THEN 'stale' ELSE 'fresh' END AS status,
  CASE WHEN age <= 120 THEN n_chars END AS n_chars, CASE WHEN age <= 120 THEN lang END AS lang
FROM w WHERE r = 1
"""
