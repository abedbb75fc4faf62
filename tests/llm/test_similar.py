import random

from pyspark.sql import functions as F

from stresslens.llm import similar
from stresslens.llm import texts as texts_


def plain(text, size=5):
    words = (text or "").lower().split()
    return {tuple(words[i : i + size]) for i in range(len(words) - size + 1)} or ({tuple(words)} if words else set())


def test_shingles_in_pieces(monkeypatch):
    r = random.Random(2)
    texts = ["", " \n", "one", "a b c d", "a b c d e"] + [" ".join(r.choice("abcdefgh") * r.randint(1, 3) for _ in range(n)) for n in (20, 300)]
    for piece in (1 << 22, 9):
        monkeypatch.setattr(texts_, "PIECE", piece)
        for t in texts:
            assert len(similar.shingles(t.encode(), 5)) == len(plain(t))


def test_stage_links_what_is_similar_and_nothing_else(spark):
    import corpus_pipeline as p

    r = random.Random(5)
    data = [(None, "a null id"), (900, None), (901, " "), (902, None), (903, "Few words"), (904, "few  WORDS")]
    for g in range(30):
        words = [f"w{r.randint(0, 5000)}" for _ in range(120)]
        for i in range(4):  # i changes, spread out, take five shingles each: similarities around 0.8
            copy = list(words)
            for k in range(i):
                copy[20 + 40 * k + r.randint(0, 9)] = f"x{g}-{i}-{k}"
            data.append((10 * g + i, " ".join(copy)))
    data.append((800, data[-1][1]))
    docs = spark.createDataFrame(data, "doc_id long, text string")
    kept = {x.doc_id for x in p.dedup_stage(spark, docs, "").collect()}
    sets, parent = [plain(t) for _, t in data], list(range(len(data)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    near = 0
    for i, a in enumerate(sets):
        for j in range(i):
            s = len(a & sets[j]) / len(a | sets[j]) if a | sets[j] else 1.0
            if s >= 0.8:
                near += s < 0.95
                parent[find(i)] = find(j)
    ids = {}
    for i, (d, _) in enumerate(data):
        ids.setdefault(find(i), []).append((d is None, d or 0, d))
    assert near > 50 and kept == {min(x)[2] for x in ids.values()}
    assert p.dedup_stage(spark, docs.limit(0), "").count() == 0
    assert similar.representatives(docs.withColumn("doc_id", F.col("doc_id") + 1)).count() == len(kept)


def test_groups_are_compared_in_place_in_blocks(spark, monkeypatch):
    import numpy as np

    r = random.Random(9)
    sets = {s: np.unique(np.array([r.randint(0, 40) for _ in range(30)], np.uint64)) for s in range(300)}
    near = lambda a, b: len(np.intersect1d(sets[a], sets[b])) / len(np.union1d(sets[a], sets[b])) >= 0.45
    hashes = spark.createDataFrame([(s, bytearray(x.tobytes())) for s, x in sets.items()], "s long, h binary")
    rows = [(k, s, s % 250) for k in range(3) for s in sets if s % 3 == k or s % 7 == k] + [(7, 0, 0), (7, 250, 0)]

    def parts(edges):
        root = {s: s for s in sets}
        for a, b in edges:
            low, high = sorted((root[a], root[b]))
            root = {s: low if x == high else x for s, x in root.items()}
        return root

    given = [(s, t) for s in sets for t in sets if s < t and s % 250 == t % 250]
    want = parts(given + [(s, t) for k in range(3) for i, s, _ in rows for j, t, _ in rows if i == j == k and s < t and near(s, t)])
    assert 1 < len(set(want.values())) < 200
    groups = spark.createDataFrame(rows, "key long, s long, c long")
    for block in (similar.BLOCK, 20):
        monkeypatch.setattr(similar, "BLOCK", block)
        blocks = similar._blocks(groups)
        assert not blocks.where("s in (0, 250) and key = 7").count()  # one component
        found = [tuple(x) for x in similar._linked(blocks, hashes, 0.45).collect()]
        assert all(near(a, b) for a, b in found) and parts(given + found) == want
        if block > 300:  # what leaves a group doesn't grow with its pairs
            assert len(found) < len(rows)
