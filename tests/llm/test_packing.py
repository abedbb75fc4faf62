import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from stresslens.llm import packing, tokens
from stresslens.llm.packing import Limits


def lawful(rows, limits, padded_to=None):
    """Every token of every row in one piece, sequences gapless and within limits; the share of padding."""
    sequences, examples = defaultdict(list), defaultdict(list)
    for r in rows:
        examples[r.of].append((r.start, r.length))
        if r.sequence_id is not None:
            sequences[r.sequence_id].append((r.offset, r.length, r.loss))
    for r in rows:
        at = 0
        for start, n in sorted(examples[r.of]):
            assert start == at and n > 0
            at += n
        assert at == r.tokens
    pad = total = 0
    for s in sequences.values():
        at = 0
        for offset, n, _ in sorted(s):
            assert offset == at
            at += n
        assert at <= limits.tokens and len(s) <= limits.segments and sum(x[2] for x in s) <= limits.loss
        total += at
        pad += 0 if limits.powers and at & (at - 1) == 0 else limits.tokens - at
    return pad / max(1, total + pad)


def test_texts_whole_and_without_padding(spark):
    r = random.Random(3)
    texts = [" ".join(r.choice(["the", "Corpus's", "naïve", "straße", "42", "日本語", "a\n\tb", "x  y", "<|endoftext|>"]) for _ in range(r.choice([0, 1, 3, 40, 900]))) for _ in range(300)]
    texts += [None, "", " ", "w" * 5000, "long words " * 20000]
    limits = Limits(tokens=256, segments=8, loss=256, powers=True)
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("of", F.lit("clash")).withColumn("start", F.lit(-1)).repartition(3)
    rows = packing.pack_texts(d, limits=limits).collect()
    assert lawful(rows, limits) == 0
    model = Tokenizer.from_file(tokens.vocabulary("word_bpe_49k.json"))
    ids = {i: np.array([*model.encode(t or "", add_special_tokens=False).ids, 1], "<u4") for i, t in enumerate(texts)}
    assert {x.of for x in rows} == ids.keys()
    for x in rows:
        assert x.tokens == len(ids[x.of]) and x.ids_crc32 == zlib.crc32(ids[x.of][x.start : x.start + x.length].tobytes())


def test_repeats_null_ids_and_empty(spark):
    d = spark.createDataFrame([(None, "a b"), (7, "c"), (7, "c")], "doc_id long, text string")
    rows = packing.pack_texts(d.coalesce(1)).collect()
    assert sum(x.length for x in rows) == 3 + 2 + 2 and [x.of for x in rows].count(7) >= 2
    assert packing.pack_texts(d.limit(0)).count() == 0


def examples(seed, n):
    r = random.Random(seed)
    out = []
    for i in range(n):
        size = r.choice([3, 20, 60, 100, 250])
        heavy = r.choice([0, size // 4, size])
        out.append((i, list(range(size)), [False] * (size - heavy) + [True] * heavy))
    return out


SCHEMA = "id long, ids array<int>, loss array<boolean>"


def test_whole_examples_under_three_limits(spark):
    limits = Limits(tokens=512, segments=10, loss=300)
    data = examples(1, 4000)
    rows = packing.pack_examples(spark.createDataFrame(data, SCHEMA).coalesce(1), "id", "ids", "loss", limits).collect()
    assert len(rows) == len(data) and all(x.start == 0 and x.length == x.tokens for x in rows)
    lawful(rows, limits)
    used = len({x.sequence_id for x in rows})
    need = max(sum(len(x[1]) for x in data) / 512, len(data) / 10, sum(sum(x[2]) for x in data) / 300)

    def first_come():
        """Sequences of examples in the order given."""
        n, left = 0, (0, 0, 0)
        for _, ids, loss in data:
            want = (len(ids), 1, sum(loss))
            if any(w > x for w, x in zip(want, left, strict=True)):
                n, left = n + 1, (512, 10, 300)
            left = tuple(x - w for w, x in zip(want, left, strict=True))
        return n

    assert need <= used <= 1.08 * need < 0.95 * first_come()


def test_cut_examples_fill_what_limits_allow(spark):
    limits = Limits(tokens=512, segments=10, loss=300)
    data = [(i, ids, [True, False] * (len(ids) // 2) + [False] * (len(ids) % 2)) for i, ids, _ in examples(2, 1000)]
    rows = packing.pack_examples(spark.createDataFrame(data, SCHEMA).coalesce(2), "id", "ids", "loss", limits, cut=True).collect()
    assert lawful(rows, limits) < 0.08  # the small examples left at the end meet the limit on segments
    heavy = {i: loss for i, _, loss in data}
    assert all(x.loss == sum(heavy[x.of][x.start : x.start + x.length]) for x in rows)


def test_what_no_sequence_can_hold_and_nulls(spark):
    data = [(1, list(range(20)), None), (2, [1, None], [None, False, True]), (3, None, None), (4, [], []), (5, [1, 2, 3], [False]), (None, [1], None), (6, list(range(8)), [True] * 8)]
    rows = packing.pack_examples(spark.createDataFrame(data, SCHEMA), "id", "ids", "loss", Limits(10, 4, 5)).collect()
    got = {x.of: (x.tokens, x.loss, x.sequence_id is None, x.offset is None) for x in rows}
    assert got == {1: (20, 20, True, True), 2: (2, 1, False, False), 5: (3, 0, False, False), None: (1, 1, False, False), 6: (8, 8, True, True)}
    with pytest.raises(ValueError):
        Limits(0)
