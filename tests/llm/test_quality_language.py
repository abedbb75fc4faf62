import os
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from stresslens.llm import language, quality
from stresslens.llm import texts as texts_

SF = "/root/testdata/sf0.01"


def prose(r, n):
    return " ".join(r.choice(["word", "other", "Third", "four", "end.", "five,"]) for _ in range(n)) + "."


def test_quality(spark):
    r = random.Random(1)
    junk = lambda n: " ".join(r.choice(["WORD!!", "x$$$", "a | b", "same same same", "y%%%"]) for _ in range(n))
    rows = [(i, prose(r, r.randint(3, 80)) if i % 3 else junk(r.randint(3, 40)), "en") for i in range(600)]
    labels = [(i, int(i % 3 > 0)) for i in range(500)] + [(7, 1), (8, None), (9, 5), (None, 1)]
    rows += [(1000, None, None), (1001, "", None), (None, prose(r, 9), None), (1, rows[1][1], "en")]
    d, y = spark.createDataFrame(rows, "doc_id long, text string, score string"), spark.createDataFrame(labels, "doc_id long, quality int")
    got = quality.classify(d, y, sample=200).collect()
    assert Counter(x.doc_id for x in got) == Counter(x[0] for x in rows)
    assert all(0 <= x.score <= 1 and x.predicted == (x.score >= 0.5) for x in got)
    assert sum(x.predicted == int(x.doc_id % 3 > 0) for x in got if x.doc_id is not None and x.doc_id < 600) >= 595
    assert quality.classify(d.limit(0), y).count() == 0
    for none in (y.limit(0), y.where("quality = 1")):
        assert {x.predicted for x in quality.classify(d, none).collect()} == {1}
    a, b = (quality.Features()(t) for t in (b"the committee reviewed every proposal before the vote", b"buy cheap pills online right now for free"))
    assert len(np.intersect1d(a, b)) < len(a) / 2  # words of the same shapes are different features
    kept = quality.keep(d, quality.train(d, y))
    assert kept.schema == d.schema and kept.where("doc_id between 0 and 599 and doc_id % 3 = 0").count() <= 3


def test_dual_coordinate_descent_reaches_the_optimum():
    r = np.random.Generator(np.random.PCG64(1))
    rows = [np.unique(np.concatenate([[0], r.choice(30, 6) + 1 + 5 * y])).astype(np.int32) for y in (0, 1) for _ in range(60)]
    labels = np.repeat([0, 1], 60)
    m = quality.fit(rows, labels, rounds=2000)
    counts = [np.bincount(np.concatenate([f for f, y in zip(rows, labels, strict=True) if y == k]), minlength=quality.WIDTH) + 1.0 for k in (0, 1)]
    ratio = np.log(counts[1] / counts[1].sum()) - np.log(counts[0] / counts[0].sum())
    x = np.zeros((120, 41))
    for i, f in enumerate(rows):
        x[i, f], x[i, 40] = ratio[f], 1
    y, cost = 2.0 * labels - 1, 1 / np.median((x**2).sum(1))
    value = lambda w: 0.5 * w @ w + cost * np.maximum(0, 1 - y * (x @ w)).sum()
    mine = np.append(np.divide(m.weights[:40], ratio[:40], out=np.zeros(40), where=ratio[:40] != 0), m.bias)
    w = np.zeros(41)
    best = value(w)
    for t in range(1, 20000):  # plain subgradient steps
        w -= (w - cost * x.T @ (y * (y * (x @ w) < 1))) / t
        best = min(best, value(w))
    assert value(mine) <= best * 1.001


def test_features_of_long_texts(monkeypatch):
    text = ("Some words, AND!! others x$$$ x$$$ | end.\n" * 30).encode()
    whole = quality.Features()(text)
    monkeypatch.setattr(texts_, "PIECE", 33)
    assert np.array_equal(np.union1d(whole, quality.Features()(text)), np.union1d(quality.Features()(text), whole))


def plain_normal(t):
    out = ""
    for c in t.lower():
        c = c if c.isalpha() else " "
        if c != " " or not out.endswith(" "):
            out += c
    out = " " + out.lstrip(" ")
    return out if any(c.isalpha() for c in t.lower()) else ""


def test_normal():
    texts = ["Ab,  c!", "", "...", "É1x", "a", "İ.", "  lead", "trail.. ", "日本 語"]
    points, at = language.Normal()(texts)
    for i, t in enumerate(texts):
        want = plain_normal(t)
        s = "".join(map(chr, points[at[i] : at[i + 1]].tolist()))
        assert s.rstrip() == want.rstrip() and len(s) <= len(want) + 1, t


def test_probabilities_add_up_and_entropy_is_theirs():
    counts = {}
    for name, text in (("a", " banana bandana and "), ("b", " kiwi wiki ki ")):
        c = defaultdict(int)
        for k in range(2, 4):
            c[text[:k]] += 1
        for k in range(4, len(text) + 1):
            c[text[k - 4 : k]] += 1
        counts[name] = dict(c)
    m = language.build(counts)
    normal = language.Normal()

    def p(context, ch):
        # the model's own tables, by plain steps
        s, total = context + ch, np.zeros(2)
        for order in range(4, 0, -1):
            g = s[-order:]
            if len(g) < order:
                continue
            at, hit = m.grams[order].find(language.codes(np.array([ord(x) for x in g], np.uint64), order))
            if hit[0]:
                return total + m.grams[order].rows[at[0]]
            if order > 1:
                at, hit = m.contexts[order].find(language.codes(np.array([ord(x) for x in g[:-1]], np.uint64), order - 1))
                total = total + (m.contexts[order].rows[at[0]] if hit[0] else 0)
        return total + m.unseen

    letters = sorted({c for t in counts.values() for g in t for c in g})
    for context in (" ba", "ana", "kiw", "zzz", " k"):
        sums = sum(np.exp(p(context, c)) for c in letters) + np.exp(p(context, "?"))
        assert np.all(np.abs(sums - 1) < 0.05), (context, sums)
    for text in ("banana", "wikiki and", "qqq", "ba"):
        h, ok, n = m.entropies(["kiwi", text, ""], normal)
        s = f" {text} "
        want = -sum(p(s[max(0, i - 3) : i], s[i]) for i in range(1, len(s))) / (len(s) - 1)
        assert ok.tolist() == [True, True, False] and n[2] == 0 and np.allclose(h[1], want, atol=1e-5)
        for i, name in enumerate(("a", "b")):
            assert abs(h[1][i] - kneser_ney(counts, name, s)) < 1e-5, (text, name)
    both = language.Languages([m], np.full(2, np.inf))
    assert [x[0] for x in both.predict(["banana", "kiwi ki", "1 2 3"], normal)] == ["a", "b", "und"]


def kneser_ney(counts, name, text):
    """Cross-entropy of text by the textbook's recursion over the counts of one language."""
    letters = {c for t in counts.values() for g in t for c in g}
    c = {o: Counter({g: n for g, n in counts[name].items() if len(g) == o}) for o in range(1, 5)}
    for o in (4, 3, 2):
        for g in c[o]:
            c[o - 1][g[1:]] += 1

    def discount(o):
        once, twice = list(c[o].values()).count(1), list(c[o].values()).count(2)
        return min(0.95, max(0.1, once / (once + 2 * twice))) if once else 0.5

    def p(context, ch):
        o = len(context) + 1
        lower = p(context[1:], ch) if context else 1 / (len(letters) + 1)
        follow = {g: n for g, n in c[o].items() if g[:-1] == context}
        if not follow:
            return lower
        total = sum(follow.values())
        return max(follow.get(context + ch, 0) - discount(o), 0) / total + discount(o) * len(follow) / total * lower

    return -sum(np.log(p(text[max(0, i - 3) : i], text[i])) for i in range(1, len(text))) / (len(text) - 1)


def test_blocks_and_pieces_change_nothing(spark, monkeypatch):
    rows = [(i, ("the cat and the dog sat " if i % 2 else "der hund und die katze ") * 3, f"{'en' if i % 2 else 'de'}-{i % 5}") for i in range(60)]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    whole = language.train(d, 3)
    monkeypatch.setattr(language, "BLOCK", 3)
    parts = language.train(d, 3)
    assert len(parts.blocks) == 4 and parts.names == whole.names and len(whole.names) == 10
    texts, normal = ["the dog sat", "die katze und", None, "7", "the cat and the dog sat " * 40], language.Normal()
    h, ok = whole.entropies(texts, normal)
    assert np.allclose(h, parts.entropies(texts, normal)[0], atol=1e-5) and ok.tolist() == [True, True, False, False, True]
    monkeypatch.setattr(language, "CHUNK", 100)
    assert np.allclose(h, whole.entropies(texts, normal)[0], atol=0.05)


def test_samples_are_bounded_in_rows(spark):
    """One doc_id with many texts is one document of the sample."""
    d = spark.createDataFrame([(None, f"der hund {i}", "de") for i in range(50)] + [(1, "the cat", "en")], "doc_id long, text string, lang string")
    assert sum(sum(m.grams[4].rows.shape[0] for m in [b]) for b in language.train(d, 5).blocks) < 40
    y = spark.createDataFrame([(1, 1), (2, 0)], "doc_id long, quality int")
    e = spark.createDataFrame([(1, "fine words here")] * 30 + [(2, "JUNK!! $$$")] * 30 + [(1, "other words")], "doc_id long, text string")
    assert quality.train(e, y).weights.any()


def test_languages(spark):
    rows = [(i, ("the cat and the dog sat " if i % 2 else "der hund und die katze ") * (i % 5 + 1), "en" if i % 2 else "de") for i in range(60)]
    rows += [(100, None, "en"), (101, "12 34 !", "de"), (102, "der hund", None), (None, "the dog", "en"), (1, rows[1][1], "en")]
    d = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, lang string, score string")
    got = language.identify(d).collect()
    assert len(got) == len(rows) and all(0 <= x.score <= 1 for x in got)
    by = {x.doc_id: x.lang_pred for x in got}
    assert all(by[i] == ("en" if i % 2 else "de") for i in range(60)) and by[100] == by[101] == "und" and by[102] == "de" and by[None] == "en"
    assert language.identify(d.limit(0)).count() == 0
    assert {x.lang_pred for x in language.identify(d.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}


@pytest.mark.skipif(not os.path.exists(SF), reason="no test data here")
def test_held_out_accuracy(spark):
    d, y = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    q = quality.classify(d, y).join(y, "doc_id").where("held_out").agg(F.avg((F.col("predicted") == F.col("quality")).cast("double")).alias("a")).first().a
    w = language.identify(d).join(d.select("doc_id", "lang"), "doc_id").where("held_out").agg(F.avg((F.col("lang_pred") == F.col("lang")).cast("double")).alias("a")).first().a
    assert q > 0.97 and w > 0.97
