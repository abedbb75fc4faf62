import random
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import pandas as pd
from pyspark.sql import functions as F

from stresslens.llm import mixing, sharding

SCHEMA = "doc_id long, text string, source string, size string, shard int"


def rows(n=400, seed=1):
    r = random.Random(seed)
    out = [(i, " ".join("w" * r.randint(1, 5) for _ in range(r.choice([0, 1, 5, 60]))), r.choice(["a", "a", "a", "b", "ä", "c", None]), "x", 1) for i in range(n)]
    return out + [(n, None, "only-null", None, None), (None, "x y", "a", None, None), (3, out[3][1], out[3][2], "x", 1)] + [(n + 1 + i, "same text", "a", "x", 1) for i in range(n // 2)]


def test_mix_against_sql_and_its_laws(spark):
    data = rows()
    got = mixing.mix(spark.createDataFrame(data, SCHEMA)).select("doc_id", "size", "source_size", "target", "taken", "source")
    again = sorted(map(tuple, mixing.mix(spark.createDataFrame(data, SCHEMA).repartition(3)).select(*got.columns).collect()), key=str)
    got = sorted(map(tuple, got.collect()), key=str)
    assert got == again and len(got) == len(data)
    documents = pd.DataFrame(data, columns=["doc_id", "text", "source", "size", "shard"]).astype({"doc_id": "Int64"})
    documents = documents.drop(columns=["size", "shard"])
    want = duckdb.sql(mixing.MIX_SQL).fetchall()
    assert sorted(x[:5] for x in got) == sorted(want) if all(x[0] is not None for x in got) else sorted((x[:5] for x in got), key=str) == sorted(want, key=str)
    taken, total = defaultdict(int), 0
    for _, size, _, target, words, source in got:
        assert 0 <= words <= 2 * size
        taken[source, target] += words
        total += size
    assert all(int(t) == n for (_, t), n in taken.items())
    assert abs(sum(t for _, t in taken) - 1.5 * total) < 1e-6
    assert sum(x[1] for x in got) == sum(len(re.findall(r"[^\x20\x09-\x0D]+", x[1] or "")) for x in data)


def test_targets_fill_up_to_the_caps(spark):
    sizes = {"a": 10, "b": 1000, "c": 50, "d": 7, "e": 300, None: 20, "z": 0}
    got = {r.source: r.target for r in mixing.targets(spark.createDataFrame(list(sizes.items()), "source string, source_size long")).collect()}
    order = sorted((s for s in sizes if s is not None)) + [None]
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    left, open_, want = 1.5 * sum(sizes.values()), set(sizes), {}
    while True:
        level = left / sum(weight[s] for s in open_)
        over = [s for s in open_ if level * weight[s] > 2 * sizes[s]]
        if not over:
            break
        for s in over:
            want[s] = 2.0 * sizes[s]
            left -= want[s]
            open_.remove(s)
    want |= {s: level * weight[s] for s in open_}
    assert all(abs(got[s] - want[s]) < 1e-9 for s in sizes)


def test_deal(spark):
    mixed = mixing.mix(spark.createDataFrame(rows(), SCHEMA))
    dealt = mixing.deal(mixed, 4, block_words=200).collect()
    assert len({(x.shard, x.slot) for x in dealt}) == len(dealt)
    by = defaultdict(set)
    for x in dealt:
        by[x.source, x.block].add(x.shard)
    assert all(len(s) == 1 for s in by.values())
    n = Counter(next(iter(s)) for s in by.values())
    assert max(n.values()) - min(n[i] for i in range(4)) <= 1
    assert sorted(x.slot for x in dealt if x.shard == 0) == list(range(sum(x.shard == 0 for x in dealt)))


def test_split_draws_exact_quotas():
    counts = [1000, 0, 37, 3]
    seen = []
    for seed in range(200):
        got = list(mixing.split(counts, 7, seed))
        for s, n in enumerate(counts):
            ranks = sorted(i for x, _, first, end in got if x == s for i in range(first, end))
            assert ranks == list(range(n))
        held = [sum(e - f for _, k, f, e in got if k == j) for j in range(7)]
        assert sum(held) == 1040 and max(held) - min(held) <= 1
        seen.append(sum(e - f for s, k, f, e in got if s == 2 and k == 0))
    # hypergeometric: 148 or 149 of 1040 blocks drawn, 37 of them of this source
    mean = sum(seen) / 200
    assert abs(mean - 37 / 7) < 0.6 and 3 < sum((x - mean) ** 2 for x in seen) / 200 < 5.5
    assert list(mixing.split([], 7, 1)) == [] and list(mixing.split([1], 1, 1)) == [(0, 0, 0, 1)]


def test_shards_hold_the_whole_mix_by_their_quotas(spark):
    mixed = mixing.mix(spark.createDataFrame(rows(), SCHEMA)).cache()
    frame = mixing.deal(mixed, 4, block_words=200)
    dealt = frame.collect()
    blocks = defaultdict(set)
    for x in dealt:
        blocks[x.source].add(x.block)
    order = sorted(blocks, key=lambda s: (s is None, s))
    got = Counter(k for k in {(x.source, x.shard, x.block) for x in dealt})
    per = Counter((s, j) for s, j, _ in got)
    assert per == Counter({(order[s], j): e - f for s, j, f, e in mixing.split([len(blocks[s]) for s in order], 4, 11)})
    again = mixing.drawn(mixed, frame)
    assert sorted(map(tuple, again.collect()), key=str) == sorted(map(tuple, mixed.collect()), key=str)
    copies = Counter((x.doc_id, x.th) for x in dealt if x.whole)
    want = Counter()
    for x in mixed.collect():
        want[x.doc_id, x.th] += x.copies
    assert copies == +want


def test_empty(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert mixing.mix(none).count() == 0
    assert mixing.deal(mixing.mix(none), 4).count() == 0
    assert sharding.shard(none).count() == 0


def test_shards(spark):
    data = rows(300) + [(1000 + i, f"pair {i // 2}", "p", "x", 1) for i in range(200)]
    got = sharding.shard(spark.createDataFrame(data, SCHEMA), 7).collect()
    assert Counter((x.doc_id, x.size, x.text_crc32) for x in got) == Counter((d, 16 + len((t or "").encode()), zlib.crc32((t or "").encode())) for d, t, *_ in data)
    n = Counter(x.shard for x in got)
    assert max(n.values()) - min(n[i] for i in range(7)) <= 1
    for s in range(7):
        assert sorted(x.slot for x in got if x.shard == s) == list(range(n[s]))
    where = defaultdict(set)
    for x in got:
        if x.doc_id and 1000 <= x.doc_id:
            where[x.text_crc32].add(x.shard)
    assert sum(len(s) > 1 for s in where.values()) <= 12
    few = sharding.shard(spark.createDataFrame(data[:3], SCHEMA), 40).collect()
    assert len({x.shard for x in few}) == 3 and {x.slot for x in few} == {0}


def test_links_are_kept_together(spark):
    """Forty circles of ten documents with different texts: dealt at random nine in ten links would be cut."""
    r = random.Random(1)
    ids = list(range(400))
    r.shuffle(ids)
    circles = [ids[i : i + 10] for i in range(0, 400, 10)]
    links = [(c[i], c[j]) for c in circles for i in range(10) for j in range(i)] + [(1, 1), (None, 3), (7, 5000)]
    d = spark.createDataFrame([(i, f"text {i}", "x") for i in ids] + [(None, "no id", "x")], "doc_id long, text string, shard string")
    e = spark.createDataFrame(links, "a long, b long")
    placed = sharding.shard(d, 10, links=e, rounds=6).cache()
    n = [x["count"] for x in placed.groupBy("shard").count().collect()]
    assert placed.count() == 401 and len(n) == 10 and max(n) - min(n) <= 1
    with_, without = sharding.cut_links(placed, e).first(), sharding.cut_links(sharding.shard(d, 10), e).first()
    assert with_.links == without.links == 1800 + 1 and without.cut > 1400 and 2 * with_.cut < without.cut, (with_, without)
