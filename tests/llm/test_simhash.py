import random
import re

import xxhash

from stresslens.llm import simhash
from stresslens.llm import texts as texts_


def plain(text, size=4):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    s = [" ".join(words[i : i + size]) for i in range(len(words) - size + 1)] or ([" ".join(words)] if words else [])
    h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_fingerprint(monkeypatch):
    r = random.Random(3)
    texts = ["", " \t\n", "Ein Wort", "a b c d", "É É x y z  Z\x0b\x0cq"] + [" ".join(r.choice("abÜC") * r.randint(1, 4) for _ in range(n)) for n in (3, 4, 5, 50, 400)]
    for t in texts:
        assert simhash.fingerprint(t.encode(), 4) % (1 << 64) == plain(t)
    monkeypatch.setattr(texts_, "PIECE", 7)
    for t in texts:
        assert simhash.fingerprint(t.encode(), 4) % (1 << 64) == plain(t)


def roots(fps, distance):
    parent = list(range(len(fps)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if bin(fps[i] ^ fps[j]).count("1") <= distance:
                a, b = sorted((find(i), find(j)))
                parent[b] = a
    return [find(i) for i in range(len(fps))]


def test_links_against_brute_force(spark):
    r = random.Random(11)
    fps = [0]
    for _ in range(30):
        x = r.getrandbits(64)
        fps.append(x)
        for _ in range(r.choice([0, 1, 5, 40])):  # chains and dense groups
            x ^= sum(1 << b for b in r.sample(range(64), r.randint(1, 5)))
            fps.append(x)
            if r.random() < 0.5:
                x = fps[r.randint(1, len(fps) - 1)]
    fps = sorted(set(fps))
    same_groups(spark, fps, 4)
    same_groups(spark, fps, 1)
    same_groups(spark, fps, 5)
    same_groups(spark, fps, 4, crowd=3)
    same_groups(spark, fps, 1, crowd=1)


def same_groups(spark, fps, distance, **crowd):
    signed = [x - (1 << 64) if x >> 63 else x for x in fps]
    df = spark.createDataFrame([(x,) for x in signed], "fp long")
    got = {x.fp: x.root for x in simhash.link(df, distance, **crowd).collect()}
    want = roots(fps, distance)
    mine, theirs = {}, {}
    for i, x in enumerate(signed):
        mine.setdefault(got.get(x, x), set()).add(x)
        theirs.setdefault(want[i], set()).add(x)
    assert sorted(map(sorted, mine.values())) == sorted(map(sorted, theirs.values()))


def test_a_segment_that_all_share(spark):
    """1500 fingerprints with one segment in common, hardly any within the distance: neither way may miss or add a link."""
    r = random.Random(5)
    fps = {r.getrandbits(40) << 24 | 0xABCDEF for _ in range(1400)}
    fps |= {x ^ sum(1 << b for b in r.sample(range(64), r.randint(1, 5))) for x in r.sample(sorted(fps), 100)}
    same_groups(spark, sorted(fps), 4)
    same_groups(spark, sorted(fps), 4, crowd=500)


def test_groups(spark):
    rows = [(5, "one two three four five", "x"), (3, "ONE two\tthree four  five", "y"), (None, "one two three four five", None), (9, None, None), (8, " ", None), (7, "else", None), (7, "else", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, root string")
    got = sorted(((x.doc_id, x.component_id) for x in simhash.groups(df).collect()), key=str)
    assert got == sorted([(5, 3), (3, 3), (None, 3), (9, 8), (8, 8), (7, 7), (7, 7)], key=str)
    assert simhash.groups(df.limit(0)).count() == 0
