"""Exact and perceptual duplicates of 64-bit hashes, clusters, contamination."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from stresslens.functions.scalars import hamming
from stresslens.operators.metrics import r6
from stresslens.operators.shared import cut, ranked


def bands(h: Column, radius: int) -> Column:
    """radius + 1 stretches of the bits: of two hashes within the radius one stretch is equal."""
    n = min(radius + 1, 64)
    edges = [64 * i // n for i in range(n + 1)]
    return F.array(*[F.struct(F.lit(i).alias("band"), F.shiftrightunsigned(h, a).bitwiseAND(F.lit((1 << b - a) - 1 if b - a < 64 else -1)).alias("bits")) for i, (a, b) in enumerate(zip(edges, edges[1:], strict=False))])


def first_band(a: Column, b: Column, radius: int) -> Column:
    """The first stretch that two hashes share: a pair is reported there only, so it needs no second look for repeats."""
    n = min(radius + 1, 64)
    edges = [64 * i // n for i in range(n + 1)]
    x = a.bitwiseXOR(b)
    out = F.lit(n)
    for i in reversed(range(n)):
        mask = ((1 << edges[i + 1] - edges[i]) - 1) << edges[i]
        out = F.when(x.bitwiseAND(F.lit(mask - (1 << 64) if mask >= 1 << 63 else mask)) == 0, i).otherwise(out)
    return out


def classes(radius: int) -> list[int]:
    """Masks of a second cut, each of every radius + 1st bit: of two hashes within the radius one class is equal."""
    n = min(radius + 1, 64)
    masks = [sum(1 << b for b in range(i, 64, n)) for i in range(n)]
    return [m - (1 << 64) if m >> 63 else m for m in masks]


def first_class(a: Column, b: Column, radius: int) -> Column:
    out = F.lit(-1)
    for i, m in reversed(list(enumerate(classes(radius)))):
        out = F.when(a.bitwiseXOR(b).bitwiseAND(F.lit(m)) == 0, i).otherwise(out)
    return out


#: A stretch's value that more hashes than this share is cut a second time.
CROWD = 4096


def near_pairs(left: DataFrame, right: DataFrame | None, radius: int, crowd: int = CROWD) -> DataFrame:
    """id_a, id_b, distance of hashes (id, h) within the radius; with one side only, each pair once, a before b.

    An equality join on stretches instead of a comparison of all with all. Hashes that share a crowded value of a stretch
    are joined on one of the classes of a second cut as well; the crowded values, no more than stretches have, are
    broadcast. A pair is told in its first stretch and class only. Use it on distinct hashes where copies are many,
    as near_classes() does: equal hashes share every key. Null hashes are near to none.
    """

    def side(d: DataFrame, x: str) -> DataFrame:
        k = d.where("h is not null").select(F.col("id").alias(f"id_{x}"), F.col("h").alias(f"h_{x}"), F.explode(bands(F.col("h"), radius)).alias("k"))
        return k.select(f"id_{x}", f"h_{x}", F.col("k.band").alias(f"band_{x}"), F.col("k.bits").alias(f"bits_{x}"))

    a, b = side(left, "a"), side(left if right is None else right, "b")
    keys = b.select(F.col("band_b").alias("band"), F.col("bits_b").alias("bits"))
    keys = keys if right is None else keys.unionByName(a.select(F.col("band_a").alias("band"), F.col("bits_a").alias("bits")))
    full = F.broadcast(keys.groupBy("band", "bits").count().where(F.col("count") > crowd).select(F.col("band").alias("_band"), F.col("bits").alias("_bits")))
    subs = lambda h: F.array(*[F.struct(F.lit(i).alias("sub"), h.bitwiseAND(F.lit(m)).alias("own")) for i, m in enumerate(classes(radius))])
    alone = F.array(F.struct(F.lit(-1).alias("sub"), F.lit(0).cast("long").alias("own")))

    def refined(d: DataFrame, x: str) -> DataFrame:
        j = d.join(full, (F.col(f"band_{x}") == F.col("_band")) & (F.col(f"bits_{x}") == F.col("_bits")), "left")
        each = F.explode(F.when(F.col("_band").isNotNull(), subs(F.col(f"h_{x}"))).otherwise(alone)).alias("s")
        return j.select(f"id_{x}", f"h_{x}", f"band_{x}", f"bits_{x}", each).select(f"id_{x}", f"h_{x}", f"band_{x}", f"bits_{x}", F.col("s.sub").alias(f"sub_{x}"), F.col("s.own").alias(f"own_{x}"))

    on = F.lit(True)
    for c in ("band", "bits", "sub", "own"):
        on &= F.col(f"{c}_a") == F.col(f"{c}_b")
    on &= (hamming(F.col("h_a"), F.col("h_b")) <= radius) & (first_band(F.col("h_a"), F.col("h_b"), radius) == F.col("band_a"))
    on &= (F.col("sub_a") == -1) | (first_class(F.col("h_a"), F.col("h_b"), radius) == F.col("sub_a"))
    if right is None:
        on &= F.col("id_a") < F.col("id_b")
    return refined(a, "a").join(refined(b, "b"), on).select("id_a", "id_b", hamming(F.col("h_a"), F.col("h_b")).alias("distance"))


def near_classes(rows: DataFrame, radius: int, crowd: int = CROWD) -> tuple[DataFrame, DataFrame]:
    """(members, pairs) of hashes (id, h): each id's class, named by its least id of an equal hash, and near pairs between classes.

    Hashes are worked out once and written; classes, both sides of the join and its crowded values read them again.
    """
    rows = cut(rows.select("id", "h"))
    first = rows.where("h is not null").groupBy(F.col("h").alias("_h")).agg(F.min("id").alias("class"))
    members = rows.join(first, F.col("h") == F.col("_h")).select("id", "class")
    return members, near_pairs(first.select(F.col("class").alias("id"), F.col("_h").alias("h")), None, radius, crowd)


def clusters(ids: DataFrame, pairs: DataFrame) -> DataFrame:
    """id, cluster: the smallest id that is reached over pairs; labels are halved along their own chains until they rest."""
    from stresslens.operators.labels import connected

    roots = connected(pairs.select("id_a", "id_b"))
    return ids.join(roots, ids["id"] == roots["node"], "left").select("id", F.coalesce("root", "id").alias("cluster"))


def near_clusters(rows: DataFrame, radius: int) -> DataFrame:
    """id, cluster of hashes (id, h): near ones over any chain, copies through their class; the least id names a cluster."""
    members, pairs = near_classes(rows, radius)
    of = clusters(members.select(F.col("class").alias("id")).distinct(), pairs).select(F.col("id").alias("_c"), "cluster")
    return members.join(of, F.col("class") == F.col("_c")).select("id", "cluster")


def duplicate_summary(members: DataFrame) -> DataFrame:
    """members: id, cluster, label, split. Clusters of several, redundant members, and clusters across labels or splits."""
    c = members.groupBy("cluster").agg(F.count("*").alias("n"), (F.min("label") != F.max("label")).alias("cross_label"), (F.min("split") != F.max("split")).alias("cross_split"))
    several = F.col("n") > 1
    return c.agg(F.count_if(several).alias("clusters"), F.coalesce(F.sum(F.when(several, F.col("n") - 1)), F.lit(0)).alias("redundant"), F.count_if(several & F.col("cross_label")).alias("cross_label"), F.count_if(several & F.col("cross_split")).alias("cross_split"), F.max("n").alias("largest"))


def exact_hits(corpus: DataFrame, deny: DataFrame, key: str = "sha256") -> DataFrame:
    """Rows of a corpus that are on the denylist: any at all stops a job."""
    return corpus.join(deny.select(key).where(F.col(key).isNotNull()).distinct(), key, "left_semi")


def contamination(corpus: DataFrame, sealed: DataFrame, radius: int) -> DataFrame:
    """exact, perceptual hits and the least distance within the radius of a corpus (id, sha256, h) to what is sealed."""
    exact = exact_hits(corpus, sealed).agg(F.count("*").alias("exact"))
    near = near_pairs(corpus.select("id", "h"), sealed.select("id", "h"), radius)
    return near.agg(F.count_distinct("id_a").alias("perceptual"), F.min("distance").alias("least_distance")).crossJoin(exact)


def nearest(pairs: DataFrame) -> DataFrame:
    """For each id_a its nearest id_b, of equal ones the first."""
    return pairs.groupBy("id_a").agg(F.min(F.struct("distance", "id_b")).alias("m")).select("id_a", "m.id_b", "m.distance")


def first_per_key(rows: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """The first row of each key. One comparison for each row, no sorting of groups."""
    rest = [c for c in rows.columns if c not in key]
    return rows.groupBy(*key).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("_r")).select(*key, "_r.*")


def hash_split(rows: DataFrame, by: str, key: str, share: float) -> DataFrame:
    """role: the first floor(n * share) of each stratum by hash are dev, the others train. key should tell rows apart."""
    d = ranked(rows, [F.col(key)], [by], "_i", "_n")
    return d.select(*rows.columns, F.when(F.col("_i") < F.floor(F.col("_n") * F.lit(share)), "dev").otherwise("train").alias("role"))


def folds(rows: DataFrame, key: str, k: int, seed: str) -> DataFrame:
    """fold of each distinct source: near-equal runs of a hashed order, so all views of a source share one."""
    d = rows.select(key).distinct().withColumn("_h", F.md5(F.concat_ws(":", F.lit(seed), F.col(key).cast("string"))))
    d = ranked(d, [F.col("_h"), F.col(key)], name="_i", n="_n")
    long, many = F.expr(f"_n div {k}") + 1, F.col("_n") % k  # the first many folds are one longer
    later = F.expr(f"(_i - (_n % {k}) * (_n div {k} + 1)) div greatest(_n div {k}, 1)") + many
    return d.select(key, F.when(F.col("_i") < many * long, F.floor(F.col("_i") / long)).otherwise(later).cast("int").alias("fold"))


def sample_per_class(rows: DataFrame, by: str, key: str, n: int, seed: str) -> DataFrame:
    """The first n rows of each class in a hashed order."""
    order = [F.md5(F.concat_ws(":", F.lit(seed), F.col(key).cast("string"))), F.col(key)]
    return first_of_each(rows, by, order, n)


def first_of_each(rows: DataFrame, by: str, order: list[Column], n: int) -> DataFrame:
    """The first n rows of each class; what a task can't be among them is dropped before any row moves."""
    own = F.row_number().over(W.partitionBy("_task", by).orderBy(*order))
    few = rows.withColumn("_task", F.spark_partition_id()).withColumn("_i", own).where(F.col("_i") <= n).drop("_i", "_task")
    return few.withColumn("_i", F.row_number().over(W.partitionBy(by).orderBy(*order))).where(F.col("_i") <= n).drop("_i")


def fill(histogram: list[tuple[int, int, int]], quotas: dict[str, dict[int, int]]) -> list[tuple[int, int, str, int, int]]:
    """(label, size, role, first, end): which clusters of a size, by rank, go whole to which role; quotas are filled in order.

    histogram: label, size and how many clusters have it. Taking clusters one by one, largest first, each to the first role
    that it still fits, gives the same: clusters of one size fit a role alike, so it takes as many as its rest allows.
    What fits none is spare.
    """
    left, out = {role: dict(q) for role, q in quotas.items()}, []
    for label, size, n in sorted(histogram, key=lambda x: (-x[1], x[0])):
        at = 0
        for role, q in left.items():
            take = min(n - at, q.get(label, 0) // size)
            if take:
                out.append((label, size, role, at, at + take))
                q[label] -= take * size
                at += take
        if at < n:
            out.append((label, size, "spare", at, n))
    return out


def assign_roles(clusters: DataFrame, quotas: dict[str, dict[int, int]]) -> DataFrame:
    """cluster, label, n, role of clusters (cluster, label, n). The driver sees how many clusters have each size: of N
    members no more than the square root of 2 N sizes, whatever the number of clusters."""
    histogram = [tuple(r) for r in clusters.groupBy("label", "n").count().collect()]
    ranges = clusters.sparkSession.createDataFrame(fill(histogram, quotas) or [(0, 0, "spare", 0, 0)], "_label int, _size long, role string, _first long, _end long")
    d = ranked(clusters, [F.col("cluster")], ["label", "n"], "_i")
    on = (F.col("label") == F.col("_label")) & (F.col("n") == F.col("_size")) & (F.col("_i") >= F.col("_first")) & (F.col("_i") < F.col("_end"))
    return d.join(F.broadcast(ranges), on).select("cluster", "label", "n", "role")


def leaks(members: DataFrame, cluster: str = "cluster", role: str = "role") -> DataFrame:
    """Clusters whose members have several roles, or some none: none may be there."""
    r = F.coalesce(F.col(role), F.lit(""))
    return members.groupBy(cluster).agg(F.min(r).alias("first"), F.max(r).alias("last"), F.count("*").alias("n")).where("first <> last or first = ''")


def role_counts(rows: DataFrame) -> DataFrame:
    """Sources by role and label with subtotals."""
    c = rows.cube("role", "label").agg(F.count_distinct("source_id").alias("sources"), F.grouping_id().alias("g"))
    return c.select(F.when(F.col("g") >= 2, "all").otherwise(F.col("role")).alias("role"), F.when(F.col("g") % 2 == 1, "all").otherwise(F.col("label").cast("string")).alias("label"), "sources")


def class_stats(rows: DataFrame, features: list[str]) -> DataFrame:
    """feature, means and population deviations by class, and their standardised difference, one pass over unpivoted rows."""
    u = rows.select("label", *[F.col(f).cast("double").alias(f) for f in features]).unpivot(["label"], features, "feature", "v")
    of = lambda y, f: f(F.when(F.col("label") == y, F.col("v")))
    s = u.groupBy("feature").agg(of(0, F.avg).alias("m0"), of(1, F.avg).alias("m1"), of(0, F.stddev_pop).alias("s0"), of(1, F.stddev_pop).alias("s1"))
    pooled = F.sqrt((F.col("s0") * F.col("s0") + F.col("s1") * F.col("s1")) / 2)
    smd = (F.col("m1") - F.col("m0")) / F.when(pooled > 0, pooled).otherwise(1.0)
    return s.select("feature", *[r6(F.col(c)).alias(c) for c in ("m0", "m1", "s0", "s1")], r6(smd).alias("smd"))


def largest_first(clusters_: DataFrame) -> DataFrame:
    """cluster, n of (id, cluster), the largest first, equal ones by cluster. A cluster may hold any share of the ids."""
    return clusters_.groupBy("cluster").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "cluster")


def most_telling(stats: DataFrame) -> DataFrame:
    """class_stats() by the size of the difference, the greatest first, equal ones by name; a difference that is null last."""
    return stats.orderBy(F.abs("smd").desc_nulls_last(), "feature")
