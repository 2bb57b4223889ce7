"""When to build, split and merge clusters, from their statistics alone.

`stats` has cluster_id, count, radius and, optionally, hits; a cluster's order is
its id.  No rule reads rows.
"""

from __future__ import annotations

from collections.abc import Callable
from itertools import islice
from typing import Protocol

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vectide.functions import sizing
from vectide.operators.assign import nearest_other, two_smallest


class Policy(Protocol):
    """What an index asks of a policy."""

    def bootstrap(self, rows: int) -> int | None: ...

    def split_target(self, stats: DataFrame) -> int | None: ...


def total_count(stats: DataFrame) -> int:
    return stats.agg(F.sum("count")).first()[0] or 0


class DefaultPolicy:
    """Splits by size first, then by radius; one cluster at a time."""

    max_rows = sizing.MAX_ROWS

    def bootstrap(self, rows: int) -> int | None:
        """Clusters to build with; None while the rows are too few."""
        return sizing.hood_k(rows) if rows >= sizing.MIN_BOOTSTRAP else None

    def split_target(self, stats: DataFrame) -> int | None:
        """The cluster to split now, or None."""
        found = split_target(stats).first()
        return found and found["cluster_id"]


def split_target(stats: DataFrame) -> DataFrame:
    """cluster_id of the cluster to split: no row or one.

    The fullest cluster past the split size, if its rows aren't all one point;
    else the first whose radius exceeds twice the mean radius of clusters with
    rows, and which queries have touched if they have touched any.
    """
    if "hits" not in stats.columns:
        stats = stats.withColumn("hits", F.lit(0).cast("long"))
    whole = stats.agg(
        F.coalesce(F.sum("count"), F.lit(0)).alias("total"),
        F.avg(F.when(F.col("count") > 0, F.col("radius"))).alias("mean"),
        F.coalesce(F.max("hits"), F.lit(0)).alias("hot"),
    )
    every = stats.crossJoin(F.broadcast(whole))
    able = F.col("count") >= sizing.MIN_SPLIT
    big = able & (F.col("radius") > 0) & (F.col("count") > sizing.split_above_col(F.col("total")))
    sick = able & (F.col("mean") > 0) & (F.col("radius") > sizing.RADIUS_FACTOR * F.col("mean")) & ((F.col("hot") == 0) | (F.col("hits") > 0))
    ranked = every.select("cluster_id", F.when(big, 0).when(sick, 1).alias("why"), F.when(big, -F.col("count")).otherwise(0).alias("size"))
    return ranked.where("why is not null").orderBy("why", "size", "cluster_id").limit(1).select("cluster_id")


def _tiny(stats: DataFrame) -> DataFrame:
    """stats with total, smallest_other and tiny: few rows, and room for them somewhere."""
    total = total_count(stats)
    below, above = sizing.merge_below(total), sizing.split_above(total)
    known = stats.join(two_smallest(stats), "cluster_id")
    room: Column = F.coalesce(F.col("count") + F.col("smallest_other") <= above, F.lit(False))
    return known.withColumn("tiny", (F.col("count") <= below) & room)


def merge_owed(stats: DataFrame) -> bool:
    """Whether a cluster is empty, or tiny with room somewhere."""
    return _tiny(stats).where((F.col("count") == 0) | F.col("tiny")).limit(1).count() > 0


def _waiting(stats: DataFrame) -> DataFrame:
    """cluster_id and count of the tiny clusters with rows, in the order they are looked at."""
    return _tiny(stats).where(F.col("tiny") & (F.col("count") >= 1)).select("cluster_id", "count").orderBy("count", "cluster_id")


def _with_hosts(stats: DataFrame, centroids: DataFrame, tiny: DataFrame) -> DataFrame:
    """cluster_id, other_id, count, other_count of these tiny clusters (cluster_id, count); only they meet all centroids."""
    near = nearest_other(centroids, tiny).join(tiny, "cluster_id").select("cluster_id", "other_id", "count")
    other = stats.select(F.col("cluster_id").alias("other_id"), F.col("count").alias("other_count"))
    return near.join(other, "other_id").select("cluster_id", "other_id", "count", "other_count")


def merge_candidates(stats: DataFrame, centroids: DataFrame, most: int) -> DataFrame:
    """cluster_id, other_id, count, other_count, place: the `most` smallest tiny clusters in order, each with its nearest other."""
    place = F.row_number().over(Window.orderBy("count", "cluster_id")).cast("long")  # of `most` rows
    return _with_hosts(stats, centroids, _waiting(stats).limit(most)).select("*", place.alias("place"))


def merge_targets(stats: DataFrame, centroids: DataFrame, pairs: int, busy: Callable[[int], bool] | None = None) -> list[tuple[int, int]]:
    """Up to `pairs` merges (tiny, host), no cluster in two of them and none that is busy.

    A tiny whose nearest other cluster is busy, taken or too full waits; it never
    takes its second nearest.  At most 16 tinies a pair that aren't busy are
    looked at, which bounds what is held here.
    """
    if pairs < 1:
        return []
    busy = busy or (lambda _: False)
    above, most = sizing.split_above(total_count(stats)), sizing.MERGE_TRIES * pairs
    idle = islice(((r["cluster_id"], r["count"]) for r in _waiting(stats).toLocalIterator() if not busy(r["cluster_id"])), most)
    tiny = list(idle)
    if not tiny:
        return []
    found = {r["cluster_id"]: r for r in _with_hosts(stats, centroids, stats.sparkSession.createDataFrame(tiny, "cluster_id long, count long")).collect()}
    out: list[tuple[int, int]] = []
    taken: set[int] = set()
    for own, count in tiny:
        r = found.get(own)
        if r is None or own in taken or r["other_id"] in taken or count + r["other_count"] > above or busy(r["other_id"]):
            continue
        taken |= {own, r["other_id"]}
        out.append((own, r["other_id"]))
        if len(out) == pairs:
            break
    return out
