"""Nearest-centroid joins and the statistics of clusters.

The Column forms keep the plan in expressions and suit small sets; the Arrow
forms stream rows past broadcast centroids.  In both the size of what is
broadcast is checked, and there is another way beyond it.  Ties go to the smaller
cluster id everywhere.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vectide.functions.vectors import by_batches, l2_sq, norm

#: Bytes of centroids that are broadcast to numpy; beyond it rows are assigned in two levels.
BROADCAST = 256 << 20
#: Bytes of centroids that are broadcast as one array of a row, for expressions.
ARRAY = 32 << 20


def parts_of(vectors: DataFrame, v: str, most: int) -> int:
    """How many parts of at most `most` bytes the vectors make, as doubles."""
    n, width = vectors.agg(F.count("*"), F.max(F.size(v))).first()
    return max(1, -(-n * (8 * max(width or 0, 0) + 32) // most))


def in_parts(vectors: DataFrame, key: str, parts: int) -> list[DataFrame]:
    """The table dealt into parts by a hash of the key."""
    return [vectors.where(F.pmod(F.xxhash64(key), F.lit(parts)) == k) for k in range(parts)] if parts > 1 else [vectors]


def one_row(vectors: DataFrame, key: str, v: str) -> DataFrame:
    """One row, `_set`: the vectors as an array of (id, c)."""
    return vectors.agg(F.collect_list(F.struct(F.col(key).alias("id"), F.col(v).alias("c"))).alias("_set"))


def distances(v: str | Column, ident: str = "cluster_id") -> Column:
    """The array `_set` as (d2, ident) of a row's vector."""
    v = F.col(v) if isinstance(v, str) else v
    return F.transform("_set", lambda s: F.struct(l2_sq(v, s["c"]).alias("d2"), s["id"].alias(ident)))


def nearest(rows: DataFrame, centroids: DataFrame, v: str = "embedding", row_id: str = "vec_id", other: bool = False) -> DataFrame:
    """row_id, cluster_id, d2: the nearest centroid of each row, by expressions and without a shuffle.

    Every row passes the centroids as one broadcast array, or as several, one
    after another, if they are more than ARRAY bytes; without any centroid both
    are null.  other: a row doesn't meet the centroid of its own id.
    """
    best, out = None, rows.select(row_id, v)
    for part in in_parts(centroids.select("cluster_id", "centroid"), "cluster_id", parts_of(centroids, "centroid", ARRAY)):
        d = distances(v)
        d = F.filter(d, lambda x: x["cluster_id"] != F.col(row_id)) if other else d
        now = F.array_min(d) if best is None else F.array_min(F.concat(F.array("_best"), d))
        out = out.crossJoin(F.broadcast(one_row(part, "cluster_id", "centroid"))).select(row_id, v, now.alias("_best"))
        best = True
    return out.select(row_id, F.col("_best.cluster_id").alias("cluster_id"), F.col("_best.d2").alias("d2"))


def nearest_within(rows: DataFrame, groups: DataFrame, members: DataFrame, top: int, v: str, row_id: str) -> DataFrame:
    """row_id, cluster_id, d2: the nearest member of a row's `top` nearest groups, smaller ids first on ties.

    groups: group_id, centroid; members: cluster_id, group_id, centroid.  Small
    sets are broadcast as arrays, and nothing is shuffled; beyond ARRAY bytes the
    groups' nearest are found by a window and the members joined on their group.
    """
    if parts_of(groups, "centroid", ARRAY) == 1:
        near = F.slice(F.array_sort(distances(v, "group_id")), 1, max(top, 1))
        rows = rows.select(row_id, v).crossJoin(F.broadcast(one_row(groups, "group_id", "centroid"))).select(row_id, v, F.transform(near, lambda x: x["group_id"]).alias("_near"))
    else:
        # the groups a part at a time, the best so far beside them
        part_rows = rows.select(row_id, v, F.expr("cast(array() as array<struct<d2:double,group_id:bigint>>)").alias("_best"))
        for part in in_parts(groups.select(F.col("group_id").cast("long").alias("group_id"), "centroid"), "group_id", parts_of(groups, "centroid", ARRAY)):
            both = F.slice(F.array_sort(F.concat("_best", distances(v, "group_id"))), 1, max(top, 1))
            part_rows = part_rows.crossJoin(F.broadcast(one_row(part, "group_id", "centroid"))).select(row_id, v, both.alias("_best"))
        rows = part_rows.select(row_id, v, F.transform("_best", lambda x: x["group_id"]).alias("_near"))
    if parts_of(members, "centroid", ARRAY) == 1:
        held = members.groupBy("group_id").agg(F.collect_list(F.struct(F.col("cluster_id").alias("id"), F.col("centroid").alias("c"))).alias("held"))
        lists = held.agg(F.map_from_entries(F.collect_list(F.struct("group_id", "held"))).alias("_lists"))
        none = F.expr("filter(flatten(map_values(_lists)), x -> false)")
        found = F.flatten(F.transform("_near", lambda g: F.coalesce(F.try_element_at(F.col("_lists"), g), none)))
        best = rows.crossJoin(F.broadcast(lists)).select(row_id, v, found.alias("_set")).select(row_id, F.array_min(distances(v)).alias("b"))
        return best.where("b is not null").select(row_id, "b.cluster_id", "b.d2")
    each = rows.select(row_id, v, F.explode("_near").alias("group_id")).join(members.select("group_id", "cluster_id", "centroid"), "group_id")
    best = each.groupBy(row_id).agg(F.min(F.struct(l2_sq(v, "centroid").alias("d2"), F.col("cluster_id"))).alias("b"))
    return best.select(row_id, "b.cluster_id", "b.d2")


def squared_distances(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """|x|^2 + |c|^2 - 2xc in float64, not below 0: for choosing, not for reporting."""
    x, c = x.astype(np.float64), c.astype(np.float64)
    d, product = (x * x).sum(1)[:, None] + (c * c).sum(1), x @ c.T
    product *= 2
    d -= product
    return np.maximum(d, 0, out=d)


def nearest_rows(x: np.ndarray, c: np.ndarray, block: int = 2048) -> tuple[np.ndarray, np.ndarray]:
    """Of each row the nearest centroid, the first on ties, and the squared distance, free of cancellation.

    The products only find the candidates; those within rounding of the best are measured again.
    Blocks of at most `block` rows are as small as keeps their products in a processor's cache.
    """
    block = max(32, min(block, (1 << 17) // max(1, len(c))))
    index, d2 = np.zeros(len(x), dtype=np.int64), np.zeros(len(x))
    scale = float((c.astype(np.float64) ** 2).sum(1).max(initial=0))
    for lo in range(0, len(x), block):
        own = x[lo : lo + block].astype(np.float64)
        d = squared_distances(own, c)
        slack = 1e-12 * ((own * own).sum(1) + scale)
        best = d.argmin(1)
        near = d <= (np.take_along_axis(d, best[:, None], 1)[:, 0] + slack)[:, None]
        for r in np.flatnonzero(np.count_nonzero(near, axis=1) > 1).tolist():  # so close that the products can't tell
            k = np.flatnonzero(near[r])
            diff = own[r] - c[k].astype(np.float64)
            best[r] = k[(diff * diff).sum(1).argmin()]
        diff = own - c[best].astype(np.float64)
        index[lo : lo + block] = best
        d2[lo : lo + block] = (diff * diff).sum(1)
    return index, d2


def assign(rows: DataFrame, ids: np.ndarray, centroids: np.ndarray, v: str = "embedding") -> DataFrame:
    """rows with cluster_id and d2, in one pass past broadcast centroids, without a shuffle."""
    if centroids.nbytes > BROADCAST:
        raise ValueError(f"{centroids.nbytes} bytes of centroids are too many to broadcast; use assign_two_level")
    order = np.argsort(ids, kind="stable")
    shared = rows.sparkSession.sparkContext.broadcast((np.asarray(ids, dtype=np.int64)[order], np.asarray(centroids)[order]))

    def best(x: np.ndarray) -> dict[str, np.ndarray]:
        names, c = shared.value
        if not len(x):
            return {"cluster_id": np.zeros(0, np.int64), "d2": np.zeros(0)}
        at, d2 = nearest_rows(x, c)
        return {"cluster_id": names[at], "d2": d2}

    rows = rows.drop("cluster_id", "d2")
    return rows.mapInArrow(by_batches(best, v), ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema) + ", cluster_id long, d2 double")


def two_level_assign(rows: DataFrame, coarse: DataFrame, fine: DataFrame, probe: int = 16, v: str = "embedding", row_id: str = "vec_id") -> DataFrame:
    """row_id, cluster_id, d2: nearest fine centroid among those filed under the row's `probe` nearest coarse ones, by expressions.

    A fine centroid is filed under its own nearest coarse one.
    """
    filed = nearest(fine.select(F.col("cluster_id").alias("fine_id"), F.col("centroid").alias("embedding")), coarse, row_id="fine_id").select("fine_id", F.col("cluster_id").alias("group_id"))
    members = fine.join(filed, fine["cluster_id"] == filed["fine_id"]).select("group_id", fine["cluster_id"], "centroid")
    return nearest_within(rows, coarse.select(F.col("cluster_id").alias("group_id"), "centroid"), members, probe, v, row_id)


def file_fine(coarse: np.ndarray, fine: np.ndarray) -> np.ndarray:
    """The coarse centroid that each fine one is filed under."""
    return nearest_rows(fine, coarse)[0]


def _places(at: np.ndarray, k: int) -> list[np.ndarray]:
    """Of each of k numbers the places where it stands, in order."""
    return np.split(np.argsort(at, kind="stable"), np.cumsum(np.bincount(at, minlength=k))[:-1])


def nearest_two_level(x: np.ndarray, coarse: np.ndarray, fine: np.ndarray, filed: np.ndarray, probe: int = 16) -> tuple[np.ndarray, np.ndarray]:
    """The numpy twin of two_level_assign: some 17 * sqrt(k) distances a row instead of k."""
    lists = _places(filed, len(coarse))
    d = squared_distances(x, coarse)
    probe = min(probe, len(coarse))
    near = np.argpartition(d, probe - 1, axis=1)[:, :probe]
    best, at = np.full(len(x), np.inf), np.full(len(x), len(fine), dtype=np.int64)
    probing = _places(near.ravel(), len(coarse))
    for k in range(len(coarse)):
        rows = probing[k] // probe
        if not len(rows) or not len(lists[k]):
            continue
        own, d2 = nearest_rows(x[rows], fine[lists[k]])
        own = lists[k][own]
        better = (d2 < best[rows]) | ((d2 == best[rows]) & (own < at[rows]))
        best[rows[better]], at[rows[better]] = d2[better], own[better]
    lost = np.flatnonzero(at == len(fine))  # all probed lists were empty
    if len(lost):
        at[lost], best[lost] = nearest_rows(x[lost], fine)
    return at, best


def assign_two_level(rows: DataFrame, coarse: np.ndarray, fine: np.ndarray, probe: int = 16, v: str = "embedding") -> DataFrame:
    """rows with cluster_id (place in fine) and d2."""
    if fine.nbytes + coarse.nbytes > BROADCAST:
        return _by_coarse(rows, coarse, fine, probe, v)
    shared = rows.sparkSession.sparkContext.broadcast((coarse, fine, file_fine(coarse, fine)))

    def best(x: np.ndarray) -> dict[str, np.ndarray]:
        if not len(x):
            return {"cluster_id": np.zeros(0, np.int64), "d2": np.zeros(0)}
        at, d2 = nearest_two_level(x, *shared.value, probe)
        return {"cluster_id": at, "d2": d2}

    rows = rows.drop("cluster_id", "d2")
    return rows.mapInArrow(by_batches(best, v), ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema) + ", cluster_id long, d2 double")


def _by_coarse(rows: DataFrame, coarse: np.ndarray, fine: np.ndarray, probe: int, v: str) -> DataFrame:
    """assign_two_level for fine sets too large to broadcast: rows meet the lists of their coarse centroids by a join, list by list.

    Only the coarse set, some square root of the fine one, is broadcast.  Every
    list's best of a row is found in the list's own groups of rows.
    """
    import pyarrow as pa

    spark = rows.sparkSession
    shared = spark.sparkContext.broadcast(coarse)
    probe = min(probe, len(coarse))
    rows = rows.drop("cluster_id", "d2")

    def probes(x: np.ndarray) -> dict[str, list]:
        return {"_near": np.argpartition(squared_distances(x, shared.value), probe - 1, axis=1)[:, :probe].tolist() if len(x) else []}

    own = rows.select(F.struct("*").alias("_row"), F.col(v).alias("_v"), F.monotonically_increasing_id().alias("_at"))
    kind = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in own.schema)
    ends = pa.array(np.arange(len(fine) + 1, dtype=np.int32) * fine.shape[1])
    lists = spark.createDataFrame(pa.table({"group_id": file_fine(coarse, fine), "cluster_id": np.arange(len(fine)), "centroid": pa.ListArray.from_arrays(ends, pa.array(fine.astype(np.float32).ravel()))}))
    held = lists.groupBy("group_id").agg(F.collect_list(F.struct(F.col("cluster_id").alias("id"), F.col("centroid").alias("c"))).alias("_set"))
    each = own.mapInArrow(by_batches(probes, "_v"), f"{kind}, _near array<long>")
    best = each.select("_at", "_v", F.explode("_near").alias("group_id")).join(held, "group_id").groupBy("_at").agg(F.min(F.array_min(distances("_v"))).alias("_b"))
    return each.select("_at", "_row").join(best, "_at", "left").select("_row.*", F.col("_b.cluster_id").alias("cluster_id"), F.col("_b.d2").alias("d2"))


def centroids_of(rows: DataFrame, by: str = "cluster_id", v: str = "embedding", spherical: bool = False) -> DataFrame:
    """by, centroid: element-wise means, partial sums first; rows of another width than the first are for `usable` to drop before."""
    parts = rows.select(by, F.posexplode(v).alias("pos", "x")).groupBy(by, "pos").agg(F.avg(F.col("x").cast("double")).alias("m"))
    whole = parts.groupBy(by).agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "m"))), lambda s: s["m"]).alias("centroid"))
    if not spherical:
        return whole
    n = norm("centroid")
    return whole.withColumn("centroid", F.when(n == 0, F.col("centroid")).otherwise(F.transform("centroid", lambda x: x / n)))


def cluster_stats(rows: DataFrame, centroids: DataFrame, by: str = "cluster_id", v: str = "embedding", hits: DataFrame | None = None) -> DataFrame:
    """by, count, radius (mean distance to the centroid) and, with a query log (by, hits), hits."""
    c = centroids.select(by, F.col("centroid").alias("_c"))
    own = rows.select(by, v).join(c, by).groupBy(by).agg(F.count("*").alias("count"), F.avg(F.sqrt(l2_sq(v, "_c"))).alias("radius"))
    every = centroids.select(by).join(own, by, "left").select(by, F.coalesce("count", F.lit(0)).cast("long").alias("count"), F.coalesce("radius", F.lit(0.0)).alias("radius"))
    return every if hits is None else every.join(hits.groupBy(by).agg(F.sum("hits").cast("long").alias("hits")), by, "left").fillna(0, ["hits"])


def sse(rows: DataFrame, centroids: DataFrame, by: str = "cluster_id", v: str = "embedding") -> DataFrame:
    """One row, `sse`: sum of squared distances to the own centroid."""
    return rows.select(by, v).join(centroids.select(by, F.col("centroid").alias("_c")), by).agg(F.sum(l2_sq(v, "_c")).alias("sse"))


def farthest(rows: DataFrame, centroids: DataFrame, by: str = "cluster_id", v: str = "embedding", row_id: str = "vec_id") -> DataFrame:
    """by, row_id, d2: the row farthest from its centroid in each cluster; the smaller id on ties."""
    d = rows.select(by, row_id, v).join(centroids.select(by, F.col("centroid").alias("_c")), by).select(by, row_id, l2_sq(v, "_c").alias("d2"))
    return d.groupBy(by).agg(F.max_by(F.struct(row_id, "d2"), F.struct("d2", -F.col(row_id))).alias("b")).select(by, f"b.{row_id}", "b.d2")


def nearest_other(clusters: DataFrame, of: DataFrame | None = None) -> DataFrame:
    """cluster_id, other_id, d2: of each centroid, or of those whose ids `of` has, the nearest other one, the smaller id on ties."""
    asked = clusters if of is None else clusters.join(of.select("cluster_id"), "cluster_id", "left_semi")
    found = nearest(asked.select(F.col("cluster_id").alias("_own"), F.col("centroid").alias("_v")), clusters, v="_v", row_id="_own", other=True)
    return found.where("cluster_id is not null").select(F.col("_own").alias("cluster_id"), F.col("cluster_id").alias("other_id"), "d2")


def two_smallest(stats: DataFrame) -> DataFrame:
    """cluster_id, smallest_other: the smallest count among the other clusters."""
    low = [r["count"] for r in stats.orderBy("count", "cluster_id").limit(2).collect()]
    who = stats.orderBy("count", "cluster_id").limit(1).select(F.col("cluster_id").alias("_w"))
    if len(low) < 2:
        return stats.select("cluster_id", F.lit(None).cast("long").alias("smallest_other"))
    return stats.crossJoin(F.broadcast(who)).select("cluster_id", F.when(F.col("cluster_id") == F.col("_w"), F.lit(low[1])).otherwise(F.lit(low[0])).cast("long").alias("smallest_other"))
