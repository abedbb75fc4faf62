import hashlib
import random
from collections import Counter, defaultdict

import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from stresslens.llm import alignment, tokens


@pytest.fixture(scope="module")
def models():
    a = Tokenizer.from_file(tokens.vocabulary("byte_bpe_50k.json"))
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=tokens.vocabulary("piece_bpe_32k.model"))


def both(models, text):
    """[(id, end)] of both for whole texts, or none."""
    a, b = models
    want = (" " + (text or "")).encode()
    if not text:
        return None
    # the characters of byte-level entries, as the published rule numbers them
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    of = dict(zip(map(chr, plain), plain, strict=True))
    for i, x in enumerate(x for x in range(256) if x not in plain):
        of[chr(256 + i)] = x
    first = [(i, bytes(of[c] for c in a.id_to_token(i))) for i in a.encode(" " + text, add_special_tokens=False).ids]
    second = [(i, bytes([int(b.id_to_piece(i)[3:-1], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode()) for i in b.encode(text)]
    out = []
    for side in (first, second):
        if b"".join(x for _, x in side) != want:
            return None
        at, told = 0, []
        for i, x in side:
            at += len(x)
            told.append((i, at))
        out.append(told)
    return out


def brute(models, documents):
    pairs, told = Counter(), []
    for i, text in documents:
        x = both(models, text)
        if x is None:
            told.append((i, None, [], []))
            continue
        a, b = x
        ends, links, groups = {e: j for j, (_, e) in enumerate(b)}, [], []
        pa = pb = 0
        for j, (t, e) in enumerate(a):
            if e in ends:
                links.append((t, b[ends[e]][0]))
                groups.append(",".join(str(y[0]) for y in a[pa : j + 1]) + "|" + ",".join(str(y[0]) for y in b[pb : ends[e] + 1]))
                pa, pb = j + 1, ends[e] + 1
        pairs.update(links)
        told.append((i, x, links, groups))
    best = defaultdict(int)
    for (_, t), n in pairs.items():
        best[t] = max(best[t], n)
    out = []
    for i, x, links, groups in told:
        sha = hashlib.sha256(";".join(groups).encode()).hexdigest() if x else ""
        out.append((i, len(x[0]) if x else 0, len(x[1]) if x else 0, len(groups), len(links), sum(pairs[p] == best[p[1]] for p in links), sum(pairs[p] for p in links), sha))
    return sorted(out, key=repr)


def documents():
    r = random.Random(8)
    bits = ["the", "corpus's", "naïve", "straße", "日本語", "1234", "x  y", "\n\n", "<|endoftext|>", "<s>", "é", "😀", "tokenizer", "\t", " "]
    texts = [" ".join(r.choice(bits) for _ in range(r.choice([1, 5, 60]))) for _ in range(120)]
    texts += [None, "", " ", "  ", "a▁b", "fine ▁", "w" * 4000, "日" * 3000, texts[0], "end ", "\r\n x"]
    return [*enumerate(texts), (0, texts[0]), (None, "null id")]


def test_against_loops(spark, models):
    data = documents()
    d = spark.createDataFrame(data, "doc_id long, text string").withColumn("row", F.lit("clash")).withColumn("common", F.lit(1)).repartition(3)
    want = brute(models, data)
    assert sum(x[-1] == "" for x in want) == 4
    for most in (1 << 20, 0):
        assert sorted((tuple(x) for x in alignment.align(d, most).collect()), key=repr) == want


def test_long_texts_in_parts(spark, models, monkeypatch):
    monkeypatch.setattr(tokens, "PIECE", 50)
    data = [(1, "some words, and more of them.  " * 40), (2, "short"), (3, "ends well " * 30 + "not ▁ here"), (4, "no" * 400)]
    d = spark.createDataFrame(data, "doc_id long, text string")
    parts = alignment.tokenised(d).select(F.explode("texts.doc_id").alias("doc_id")).groupBy("doc_id").count().collect()
    assert {x.doc_id: x["count"] for x in parts}[1] > 10
    assert sorted(tuple(x) for x in alignment.align(d).collect()) == brute(models, data)


def test_empty(spark):
    assert alignment.align(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_ends_that_differ(spark):
    one = ([1, 2, 3, 4, 5], [2, 5, 9, 10, 11], [7, 8, 6, 7], [5, 9, 10, 11], [9, 10, 11])
    texts = [(1, 10, 0, 1, 0, 0, [0, 1, 2, 0]), (2, 11, 0, 1, 0, 0, None), (3, 12, 0, 1, 0, 0, [1])]
    d = spark.createDataFrame([(*one, texts), ([], [], [], [], [], texts[1:2])], f"{alignment.RUNS}, {alignment.TEXTS}")
    got = [(x.links, x.groups) for x in alignment.aligned(d).orderBy("row").collect()]
    link = lambda *pairs: [a * 65536 + b for a, b in pairs]
    assert got[0] == (link((2, 7), (3, 8), (4, 6), (5, 7), (2, 7), (3, 8)), "1,2|7;3|8;4|6;5|7;1,2|7;3|8")
    assert got[1:] == [(None, None), (None, None), (link((4, 6)), "4|6")]


def test_read_in_one_pass(spark):
    d = spark.createDataFrame([*documents(), (7, "bad")], "doc_id long, text string").withColumn("text", F.expr("if(text like 'bad%', cast(x'62616420FF20776F7264' as string), text)")).coalesce(1)
    plan = alignment.read(d)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 1 and "transform(" not in plan
    got = alignment.read(d).orderBy("row", "part").collect()
    assert got == alignment.aligned(alignment.tokenised(d)).orderBy("row", "part").collect()
    assert got[-1].doc_id == 7 and got[-1].links is None


def test_learns_around_bad_runs():
    twice = tokens.Twice(tokens.vocabulary("byte_bpe_50k.json"), tokens.vocabulary("piece_bpe_32k.model"))
    runs = [" fine", " a▁b", " words", "  two", " \u2581"]
    every = twice.learn(runs)
    assert [x is False for x in every] == [False, True, False, False, True]
    assert every == [twice.learn([r])[0] for r in runs]
    assert twice.learn([]) == []
