import hashlib
import random
from collections import Counter

from stresslens.llm.repeats import remove_repeats


def brute(texts, length=200):
    data = [(t or "").encode() for t in texts]
    seen = Counter(b[i : i + length] for b in data for i in range(len(b) - length + 1))
    out = []
    for b in data:
        gone = bytearray(len(b))
        for i in range(len(b) - length + 1):
            if seen[b[i : i + length]] > 1:
                gone[i : i + length] = b"\1" * length
        runs = sum(1 for i, x in enumerate(gone) if x and not (i and gone[i - 1]))
        out.append((len(b), sum(gone), runs, hashlib.sha256(bytes(c for c, x in zip(b, gone, strict=True) if not x)).hexdigest()))
    return out


def corpus(seed):
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdeé ") for _ in range(r.randint(1, 7)))
    prose = lambda n: " ".join(word() for _ in range(n))
    shared, base = [prose(r.randint(20, 120)) for _ in range(6)], prose(300)
    texts = [None, "", "short", "short", "a" * 700, "a" * 199, "ab" * 300, base, base, base + "x"]
    for _ in range(40):
        t = "".join(r.choice([prose(r.randint(5, 60)), r.choice(shared), r.choice(shared)[r.randint(0, 40) :]]) for _ in range(r.randint(1, 6)))
        texts.append(t)
    for _ in range(30):  # near copies: one group with edits at many places
        at = r.randint(0, len(base) - 1)
        texts.append(base[:at] + r.choice(["", "Q", "zz"]) + base[at + r.randint(0, 2) :])
    return texts


def test_against_brute_force(spark):
    for seed in (1, 2):
        texts = corpus(seed)
        df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, core string").repartition(3)
        got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in remove_repeats(df).collect()}
        assert [got[i] for i in range(len(texts))] == brute(texts)


def test_repeated_rows_null_ids_and_empty(spark):
    t = "".join(chr(97 + i * 7 % 26) + str(i) for i in range(150))
    rows = [(1, t), (1, t), (None, "u" * 150), (2, None)]
    got = sorted(map(tuple, remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()), key=str)
    empty = hashlib.sha256(b"").hexdigest()
    assert got == sorted([(1, len(t), len(t), 1, empty)] * 2 + [(None, 150, 0, 0, hashlib.sha256(b"u" * 150).hexdigest()), (2, 0, 0, 0, empty)], key=str)
    assert remove_repeats(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_long_text_in_pieces(spark, monkeypatch):
    from stresslens.llm import repeats

    r = random.Random(5)
    part = "".join(r.choice("abcdefgh") for _ in range(1500))
    texts = [part + "".join(r.choice("abcdefgh") for _ in range(9000)) + part[:700], part[300:900]]
    s = repeats.Scanner(200)
    import numpy as np

    b = np.frombuffer(texts[0].encode(), np.uint8)
    want = s.piece(b, np.array([0]), np.array([len(b)]))
    monkeypatch.setattr(repeats, "CHUNK", 1000)
    got = s.long(b)
    for x, y in zip(got, want, strict=True):
        assert np.array_equal(x, y)
