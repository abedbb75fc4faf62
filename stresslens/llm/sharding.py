"""Sharding by balanced label propagation.

Documents that share a hub want to be in one shard: equal texts share one, and so do the two ends of each link given.
In each round a hub counts its documents by shard and names the shards where most are, as many as it needs; a document
goes where most of its hubs want it, as far as the shards' quotas allow. Unlinked documents count as room: at the end they fill what is left, so that the shards'
rows differ by one at most. Hubs of any size are counted before the shuffle and never gathered.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from stresslens.llm.common import cut, running, text_key


def _pick(values: list[int], at: Column) -> Column:
    """The first i for which at < values[i], of rising values, one for each shard."""
    return F.size(F.filter(F.array(*[F.lit(v) for v in values]), lambda v: v <= at)).cast("int")


def _per_shard(df: DataFrame, shards: int) -> list[int]:
    """Rows by shard; at most one row for each shard comes to the driver."""
    n = [0] * shards
    for r in df.groupBy("shard").count().collect():
        n[r["shard"]] = r["count"]
    return n


def _of(values: list[int], shard: Column) -> Column:
    return F.element_at(F.array(*[F.lit(v).cast("long") for v in values]), shard + 1)


def propagate(linked: DataFrame, room: list[int], rounds: int, slack: float, seed: int, members: DataFrame | None = None) -> DataFrame:
    """row, hub, shard after the rounds. linked: row, hub (long), shard; room: the rows that each shard is to hold.

    members: (row, hub, link) where rows may have several hubs; linked's own hub then only orders the rows. A hub that
    is a link has two ends, and each wants to be where the other is.
    """
    shards = len(room)
    for k in range(rounds):
        held = _per_shard(linked, shards)
        of = linked if members is None else cut(members.join(linked.select(F.col("row").alias("r"), "shard"), F.col("row") == F.col("r")).select("row", "hub", "shard", "link"))
        counts = (of if members is None else of.where("not link")).groupBy("hub", "shard").agg(F.count("*").alias("n"))
        # a hub wants its fullest shards, as many as its rows need; ties fall by a hash that differs between hubs
        by_count = W.partitionBy("hub").orderBy(F.desc("n"), F.xxhash64(F.lit(seed), "hub", "shard"))
        need = F.ceil(F.sum("n").over(W.partitionBy("hub")) / F.lit(float(max(1, min(room)))))
        wanted = counts.withColumn("i", F.row_number().over(by_count)).withColumn("need", need).where("i <= need")
        wanted = wanted.groupBy("hub").agg(F.sort_array(F.collect_list(F.struct("i", "shard"))).alias("to"))
        asked = of.join(wanted, "hub").withColumn("goal", F.element_at("to", (F.pmod(F.xxhash64("row"), F.size("to")) + 1).cast("int"))["shard"])
        stays = F.exists("to", lambda x: x["shard"] == F.col("shard"))
        asked = cut(asked.select("row", "hub", "shard", F.when(stays, F.col("shard")).otherwise(F.col("goal")).alias("goal")))
        if members is not None:
            ends = of.where("link").groupBy("hub").agg(F.min("shard").alias("x"), F.max("shard").alias("y"))
            across = of.where("link").join(ends, "hub").select("row", "shard", F.when(F.col("shard") == F.col("x"), F.col("y")).otherwise(F.col("x")).alias("goal"))
            votes = asked.select("row", "shard", "goal").unionByName(across).groupBy("row", "shard", "goal").agg(F.count("*").alias("n"))
            most = F.max_by("goal", F.struct("n", F.col("goal") == F.col("shard"), F.xxhash64(F.lit(seed), "goal")))
            asked = votes.groupBy(F.col("row").alias("r")).agg(most.alias("goal"))
            asked = cut(linked.join(asked, F.col("row") == F.col("r")).select("row", "hub", "shard", "goal"))
        movers = asked.where("goal <> shard")
        out, into = _per_shard(movers, shards), _per_shard(movers.select(F.col("goal").alias("shard")), shards)
        if not any(into):
            break
        quota = [max(0, int(r * (1 + slack)) - h + min(o, i)) for r, h, o, i in zip(room, held, out, into, strict=True)]
        ranked = running(movers, ["goal"], F.xxhash64(F.lit(k), "hub"), ["hub", "row"], F.lit(1), "at")
        moved = ranked.select("row", "hub", F.when(F.col("at") < _of(quota, F.col("goal")), F.col("goal")).otherwise(F.col("shard")).alias("shard"))
        linked = cut(asked.where("goal = shard").select("row", "hub", "shard").unionByName(moved))
    return linked


def cut_links(placed: DataFrame, links: DataFrame) -> DataFrame:
    """links, cut: how many of the links (a, b) have both ends in placed (doc_id, shard), and how many have them in two shards."""
    ends = [placed.where("doc_id is not null").select(F.col("doc_id").alias(c), F.col("shard").alias(f"{c}_shard")).dropDuplicates([c]) for c in "ab"]
    both = links.select("a", "b").join(ends[0], "a").join(ends[1], "b")
    return both.agg(F.count("*").alias("links"), F.coalesce(F.sum((F.col("a_shard") != F.col("b_shard")).cast("long")), F.lit(0)).alias("cut"))


def shard(documents: DataFrame, shards: int = 40, rounds: int = 4, slack: float = 0.02, seed: int = 5, text: str = "text", doc_id: str = "doc_id", links: DataFrame | None = None) -> DataFrame:
    """doc_id, size, text_crc32, shard, slot for every row of documents; the shards' rows differ by one at most.

    Equal texts are linked, null ones too, and documents a and b for every row of links (a, b; ids that no document
    has, and null ones, link nothing). size: the text's UTF-8 bytes (null: none) plus 16; text_crc32: of the same
    bytes. slot numbers a shard's rows from 0 without gaps. A row given twice is two rows; other columns are not looked
    at. Fewer rows than shards leave shards empty.
    """
    d = documents.select(F.col(doc_id).cast("long").alias("doc_id"), (F.coalesce(F.octet_length(text), F.lit(0)) + 16).cast("long").alias("size"), F.crc32(F.coalesce(F.col(text), F.lit(""))).alias("text_crc32"), *text_key(F.col(text)))
    d = d.withColumn("hub", F.xxhash64("k1", "k2", "k3")).drop("k1", "k2", "k3")
    d = cut(running(d, [], F.xxhash64(F.lit(seed), "doc_id", "hub"), ["doc_id", "hub"], F.lit(1), "row"))
    n = d.count()
    # shard i starts at row ceil(i * n / shards) of the hashed order
    edges = [-(-i * n // shards) for i in range(shards + 1)]
    room = [b - a for a, b in zip(edges, edges[1:], strict=False)]
    first = _pick(edges[1:], F.col("row"))
    hubs = d.groupBy("hub").agg(F.count("*").alias("n")).where("n > 1").select("hub")
    same, members = d.select("row", "hub", first.alias("shard")).join(hubs, "hub").select("row", "hub", "shard"), None
    if links is None:
        linked = cut(same)
    else:
        link = F.xxhash64(F.lit("link"), F.least("a", "b"), F.greatest("a", "b")).alias("hub")
        ends = links.where("a <> b").select(link, F.explode(F.array("a", "b")).alias("end")).distinct()
        tied = d.join(ends.withColumnRenamed("hub", "of"), F.col("doc_id") == F.col("end")).select("row", F.col("of").alias("hub"), first.alias("shard"))
        members = cut(same.withColumn("link", F.lit(False)).unionByName(tied.withColumn("link", F.lit(True))))
        linked = cut(members.groupBy("row").agg(F.min("hub").alias("hub"), F.first("shard").alias("shard")))
        members = members.select("row", "hub", "link")
    if n:
        linked = propagate(linked, room, rounds, slack, seed, members)
    # a shard keeps of its linked rows what it has room for, whole hubs while they last
    kept = running(linked, ["shard"], F.xxhash64(F.lit(seed), "hub"), ["hub", "row"], F.lit(1), "at").where(F.col("at") < _of(room, F.col("shard"))).select("row", "shard")
    kept = cut(kept)
    free = [r - k for r, k in zip(room, _per_shard(kept, shards), strict=True)]
    ends = [sum(free[: i + 1]) for i in range(shards)]
    rest = d.join(kept.select("row"), "row", "left_anti").select("row", "hub")
    rest = running(rest, [], F.xxhash64(F.lit(seed), "hub"), ["hub", "row"], F.lit(1), "at").select("row", _pick(ends, F.col("at")).alias("shard"))
    placed = d.join(kept.unionByName(rest), "row")
    return running(placed, ["shard"], F.xxhash64(F.lit(seed + 1), "row"), ["row"], F.lit(1), "slot").select("doc_id", "size", "text_crc32", "shard", "slot")
