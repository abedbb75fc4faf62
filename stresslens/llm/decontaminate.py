"""Benchmark passages in documents, re-parameterised ones too.

A text's tokens are canonicalised into a template: numbers, names and units become typed placeholders. Windows of
eight template tokens are hashed; windows of documents that may be in the benchmark (a bitmap of fixed size tells)
are joined to the benchmark's by hash. Where windows of an item follow each other in a document, the values in their
slots must map one to one from item to document; then a template counts as the same question with other values.
A capitalised token is a name, at the start of a sentence too: there it may be a plain word, which then maps to itself.
Copies differ in capitals; so windows are hashed in a second, plain form too, in which only numbers are placeholders,
and either form may match. Windows that are mostly
numbers are hashed with their values, so every window of an item has a hash and counts in its total.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stresslens.llm.common import cut
from stresslens.llm.texts import pieces, raw, windows

#: Tokens of a window; an item of fewer is one window itself, down to LEAST tokens.
WINDOW, LEAST = 8, 4
#: A window with fewer tokens that aren't slots, as a share, counts only where the values of its slots are the same.
LITERAL = 0.5
#: The bitmap that spares the join windows that are in no item has 2**BITS bits at any size of the benchmark.
BITS = 24
#: Units that make a slot of their own after a number.
UNITS = frozenset(
    "mm cm m km in inch inches ft foot feet yd yards mile miles mg g kg t tons oz lb lbs pounds ml l litre litres liter liters gallon gallons "
    "s sec second seconds min minute minutes h hr hour hours day days week weeks month months year years percent degrees "
    "dollar dollars cent cents euro euros usd eur mph kmh hz khz mhz kb mb gb tb w kw v volts".encode().split()
)
_NUMBER = re.compile(rb"[$\xe2\x82\xac]*[+-]?[0-9][0-9.,:/]*[0-9]?(%|[a-z]{1,3})?")
_EDGE = b"\"'`()[]{}<>*_.,;:!?"
_MEMO = 200_000
#: What a number may begin with, in bytes.
_NUMBER_STARTS = frozenset(b"$\xe2\x82\xac+-0123456789")
_hash = xxhash.xxh64_intdigest
_NUMBER_SLOT, _NAME_SLOT, _UNIT_SLOT = (np.uint64(_hash(x)) for x in (b"<number>", b"<name>", b"<unit>"))


def _name(token: bytes) -> bool:
    if not token[:1].isupper() and token[0] < 128:
        return False
    t = token.decode("utf-8", "replace")
    return len(t) > 1 and t[0].isupper() and t.replace("-", "").replace("'", "").isalpha() and not t.isupper()


class Template:
    """Tokens as numbers: their place in the template, and in the plain form with and without the values of numbers."""

    def __init__(self) -> None:
        self.reset()

    def reset(self) -> None:
        self.memo: dict[bytes, int] = {}
        self.typed = np.zeros(1 << 12, np.uint64)
        self.slotted = np.zeros(1 << 12, np.uint64)
        self.plain = np.zeros(1 << 12, np.uint64)
        self.kind = np.zeros(1 << 12, np.uint8)  # 1: a number, 2: a unit, 4: a name

    def add(self, tokens: list[bytes]) -> None:
        """Tokens that the memo doesn't have, each once."""
        n, plain, kind = len(self.memo), [], []
        for token in tokens:
            core = token.strip(_EDGE) or token
            low = core.lower()
            plain.append(_hash(low if low.isascii() else low.decode("utf-8", "replace").lower().encode()))
            number = low[0] in _NUMBER_STARTS and _NUMBER.fullmatch(low) is not None
            kind.append(number * 1 + (low in UNITS) * 2 + _name(core) * 4)
        end = n + len(tokens)
        while end > len(self.kind):
            self.typed, self.slotted, self.plain, self.kind = (np.concatenate([x, np.zeros_like(x)]) for x in (self.typed, self.slotted, self.plain, self.kind))
        self.plain[n:end], self.kind[n:end] = np.array(plain, np.uint64), kind
        number, name = (self.kind[n:end] & 1) > 0, (self.kind[n:end] & 4) > 0
        self.typed[n:end] = np.where(number, _NUMBER_SLOT, self.plain[n:end])
        self.slotted[n:end] = np.where(name & ~number, _NAME_SLOT, self.typed[n:end])
        self.memo.update(zip(tokens, range(n, end), strict=True))

    def __call__(self, tokens: list[bytes]) -> list[tuple[np.ndarray, np.ndarray, np.ndarray | None]]:
        """The tokens as hashes, which are slots, and hashes with the values, as a template (without values) and in the plain form."""
        if len(self.memo) > _MEMO:
            self.reset()
        at = list(map(self.memo.get, tokens))
        if None in at:
            self.add(list(dict.fromkeys(t for t, a in zip(tokens, at, strict=True) if a is None)))
            at = list(map(self.memo.__getitem__, tokens))
        where = np.array(at, np.int64)
        kind = self.kind[where]
        h = self.slotted[where]
        unit = ((kind & 2) > 0) & np.concatenate([[False], (kind[:-1] & 1) > 0])
        h[unit] = _UNIT_SLOT
        number = (kind & 1) > 0
        return [(h, number | unit | ((kind & 4) > 0), None), (self.typed[where], number, self.plain[where])]


class Scan:
    """The windows of texts that the bitmap holds, with the values of their slots; without a bitmap all."""

    def __init__(self, sizes: list[int], bitmap: bytes | None):
        self.sizes, self.bitmap = sizes, bitmap

    def text(self, template: Template, held: np.ndarray | None, text: bytes) -> Iterator[tuple[int, int, int, int, list[str]]]:
        """Window size, token position, hash, tokens of the text so far, slot values."""
        base, carry = 0, []
        for piece in pieces(text):
            fresh = piece.split()
            tokens = carry + fresh
            if not fresh:
                continue
            forms = [(h, slot, values, np.concatenate([[0], np.cumsum(~slot)])) for h, slot, values in template(tokens)]
            for size in self.sizes:
                # what the piece before has already seen whole isn't looked at again
                skip = max(0, len(carry) - size + 1)
                if len(tokens) - skip < size:
                    continue
                seen = None
                for h, slot, values, literal in forms:
                    w = windows(h[skip:], size)
                    fine = literal[skip + size :] - literal[skip : len(literal) - size] >= LITERAL * size
                    if seen is None:
                        seen = np.where(fine, w, ~w)
                    else:
                        if not fine.all():
                            w = np.where(fine, w, windows(values[skip:], size))
                        fine = w != seen  # without names and units both forms are the same
                    if held is not None:
                        fine &= held[(w >> np.uint64(64 - BITS)).astype(np.int64)]
                    for i in np.flatnonzero(fine).tolist():
                        j = i + skip
                        yield size, base + j, int(w[i].view(np.int64)), 0, [tokens[j + k].strip(_EDGE).decode("utf-8", "replace").lower() for k in np.flatnonzero(slot[j : j + size]).tolist()]
            keep = min(len(tokens), WINDOW)  # one more than a window's rest: a unit is told by the number before it
            base += len(tokens) - keep
            carry = tokens[len(tokens) - keep :]

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        template = Template()
        held = None if self.bitmap is None else np.unpackbits(np.frombuffer(self.bitmap, np.uint8), bitorder="little").astype(bool)
        for batch in batches:
            out: tuple[list, ...] = ([], [], [], [], [])
            for row, text in enumerate(raw(batch.column(2))):
                for size, at, w, _, slots in self.text(template, held, text):
                    for column, x in zip(out, (row, size, at, w, slots), strict=True):
                        column.append(x)
            if out[0]:
                rows = pa.array(out[0], pa.int64())
                yield pa.record_batch([batch.column(0).take(rows), batch.column(1).take(rows), pa.array(out[1], pa.int32()), pa.array(out[2], pa.int64()), pa.array(out[3], pa.int64()), pa.array(out[4], pa.list_(pa.string()))], ["id", "th", "size", "at", "w", "slots"])


def tiny_text(text: Column) -> Column:
    """Has a text one to LEAST - 1 words? Told without reading on behind those, however long the text is."""
    blank, word = r"[\x20\x09-\x0D]", r"[^\x20\x09-\x0D]"
    return text.rlike(rf"\A{blank}*+{word}++(?:{blank}++{word}++){{0,{LEAST - 2}}}+{blank}*+\z")


_OUT = "id long, th long, size int, at long, w long, slots array<string>"


def matches(documents: DataFrame, benchmark: DataFrame, coverage: float = 0.5, run: int = 6, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, th, item_id, coverage, exact, matched: the documents that hold a benchmark item, and which.

    th is xxhash64 of the text. A document holds an item if it has `coverage` of the item's windows, or `run` of
    them, with slots that map one to one along each alignment. exact is the share of windows whose slots are the same.
    Null and empty texts hold nothing; an item of fewer than LEAST tokens is found where it is all that a document has.
    Texts of any length are read in pieces. Repeated rows give one row; a null doc_id is carried along, and several
    such documents are told apart by th; an item_id that has several texts is one item; of windows that match in
    several places all count; other columns are not looked at.
    """
    spark = documents.sparkSession
    items = benchmark.select(F.col("item_id").cast("long").alias("id"), F.xxhash64("text").alias("th"), "text")
    n = F.coalesce(F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0))
    long_, short = items.where(n >= WINDOW), items.where((n < WINDOW) & (n >= LEAST))
    known = long_.mapInArrow(Scan([WINDOW], None), _OUT)
    sizes = [WINDOW]
    for size in range(LEAST, WINDOW):
        known = known.unionByName(short.where(n == size).mapInArrow(Scan([size], None), _OUT))
        sizes.append(size)
    known = cut(known.select(F.col("id").alias("item_id"), "size", F.col("at").alias("item_at"), F.col("w"), F.col("slots").alias("item_slots")).distinct())
    total = known.groupBy("item_id").agg(F.count_distinct("item_at").alias("total"))
    used = [r[0] for r in known.select("size").distinct().collect()]
    # the bitmap in words of 64 bits: 2**BITS / 64 rows at most come to the driver
    bit = F.shiftrightunsigned("w", 64 - BITS)
    words = known.select(bit.alias("b")).select(F.shiftright("b", 6).alias("k"), F.expr("shiftleft(1L, cast(b & 63 as int))").alias("v"))
    bitmap = np.zeros(1 << BITS - 6, np.int64)
    for r in words.groupBy("k").agg(F.bit_or("v").alias("v")).collect():
        bitmap[r.k] = r.v
    shared = spark.sparkContext.broadcast(bitmap.astype("<i8").tobytes())

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from Scan(sorted(used), shared.value)(batches)

    d = documents.select(F.col(doc_id).cast("long").alias("id"), F.xxhash64(text).alias("th"), F.col(text).alias("text"))
    hits = d.mapInArrow(scan, _OUT).join(known, ["size", "w"])
    pairs = F.arrays_zip(F.col("item_slots").alias("a"), F.col("slots").alias("b"))
    hits = hits.select(F.col("id").alias("doc_id"), "th", "item_id", "item_at", (F.col("at") - F.col("item_at")).alias("shift"), pairs.alias("pairs"), (F.col("slots") == F.col("item_slots")).alias("same"))
    lined = hits.groupBy("doc_id", "th", "item_id", "shift").agg(F.collect_set("item_at").alias("found"), F.collect_set(F.when(F.col("same"), F.col("item_at"))).alias("exact"), F.array_distinct(F.flatten(F.collect_set("pairs"))).alias("pairs"))
    count = F.size("pairs")
    one_to_one = (F.size(F.array_distinct(F.transform("pairs", lambda p: p["a"]))) == count) & (F.size(F.array_distinct(F.transform("pairs", lambda p: p["b"]))) == count)
    # where the slots contradict each other only windows with the same values count
    lined = lined.select("doc_id", "th", "item_id", F.when(one_to_one, F.col("found")).otherwise(F.col("exact")).alias("found"), "exact")
    held = lined.groupBy("doc_id", "th", "item_id").agg(F.size(F.array_distinct(F.flatten(F.collect_list("found")))).alias("matched"), F.size(F.array_distinct(F.flatten(F.collect_list("exact")))).alias("same"))
    held = held.join(total, "item_id").withColumn("coverage", F.col("matched") / F.col("total"))
    held = held.where((F.col("coverage") >= coverage) | (F.col("matched") >= run)).select("doc_id", "th", "item_id", "coverage", (F.col("same") / F.col("total")).alias("exact"), F.col("matched").cast("long").alias("matched"))
    # an item too short for a window is in a document that is nothing else
    bare = lambda x: F.lower(F.trim(F.regexp_replace(x, r"[\x20\x09-\x0D]+", " ")))
    tiny = items.where((n > 0) & (n < LEAST)).select(F.col("id").alias("item_id"), bare(F.col("text")).alias("bare")).distinct()
    small = d.where(tiny_text(F.col("text"))).select(F.col("id").alias("doc_id"), "th", bare(F.col("text")).alias("bare")).distinct()
    whole = small.join(tiny, "bare").select("doc_id", "th", "item_id", F.lit(1.0).alias("coverage"), F.lit(1.0).alias("exact"), F.lit(1).cast("long").alias("matched"))
    return held.unionByName(whole)
