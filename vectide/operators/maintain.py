"""Keeping an index in band: centroid-set deltas, splits, merges and dropped clusters."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vectide.operators.assign import nearest


def delta(prev: DataFrame, now: DataFrame, limit: int) -> DataFrame | None:
    """seq, slot_id, vec: what turns the centroid set prev into now; None if either is empty or more than `limit` slots differ.

    Sets have slot_id from 0 on and centroid.  Changed and new slots come in
    order; if the set shrinks, a last entry with a null vec gives its new size
    and doesn't count towards the limit.
    """
    sizes = prev.agg(F.count("*")).first()[0], now.agg(F.count("*")).first()[0]
    if not all(sizes):
        return None
    both = prev.select("slot_id", F.col("centroid").alias("_old")).join(now.select("slot_id", F.col("centroid").alias("vec")), "slot_id", "full_outer")
    changed = both.where(F.col("vec").isNotNull() & ~F.col("vec").eqNullSafe(F.col("_old"))).select("slot_id", "vec")
    if changed.limit(limit + 1).count() > limit:
        return None
    out = changed.select(F.row_number().over(Window.orderBy("slot_id")).cast("long").alias("seq"), "slot_id", "vec")
    if sizes[1] < sizes[0]:
        kind = out.schema["vec"].dataType.simpleString()
        n = changed.count()
        out = out.unionByName(prev.sparkSession.range(1).select(F.lit(n + 1).cast("long").alias("seq"), F.lit(sizes[1]).cast("long").alias("slot_id"), F.lit(None).cast(kind).alias("vec")))
    return out


def apply_deltas(base: DataFrame, *deltas: DataFrame) -> DataFrame:
    """base with the deltas, oldest first: the last write of a slot wins unless a later entry truncates below it.

    A delta that leaves a gap or goes beyond the set is an error.
    """
    log = None
    for k, d in enumerate(deltas):
        own = d.select(F.lit(k).alias("batch"), "seq", "slot_id", "vec")
        log = own if log is None else log.unionByName(own)
    if log is None:
        return base
    start = base.agg(F.count("*")).first()[0]
    # the slots are few and the order is what matters: the sizes are checked in sequence, vectors stay distributed
    size = start
    for r in log.select("batch", "seq", "slot_id", F.col("vec").isNull().alias("cut")).orderBy("batch", "seq").toLocalIterator():
        if r["cut"]:
            if r["slot_id"] > size:
                raise ValueError("a truncation beyond the set")
            size = r["slot_id"]
        else:
            if r["slot_id"] > size:
                raise ValueError("a gap in the slots")
            size = max(size, r["slot_id"] + 1)
    every = base.select(F.lit(-1).alias("batch"), F.col("slot_id").alias("seq"), "slot_id", F.col("centroid").alias("vec")).unionByName(log)
    cuts = every.where("vec is null").select("batch", "seq", F.col("slot_id").alias("keep"))
    writes = every.where("vec is not null")
    alive = writes.alias("w").join(F.broadcast(cuts.alias("c")), F.expr("(c.batch > w.batch or (c.batch = w.batch and c.seq > w.seq)) and w.slot_id >= c.keep"), "left_anti")
    last = Window.partitionBy("slot_id").orderBy(F.desc("batch"), F.desc("seq"))
    return alive.withColumn("r", F.row_number().over(last)).where("r = 1").select("slot_id", F.col("vec").alias("centroid"))


def drop_slot(centroids: DataFrame, rows: DataFrame, slot: int) -> tuple[DataFrame, DataFrame]:
    """Both tables without a cluster: the last slot moves into the hole, and the dropped cluster's rows go to their nearest other."""
    last = centroids.agg(F.max("slot_id")).first()[0]
    kept = centroids.where(F.col("slot_id") != slot).withColumn("slot_id", F.when(F.col("slot_id") == last, F.lit(slot)).otherwise(F.col("slot_id")).cast("long"))
    moved = rows.where(F.col("cluster_id") == slot).drop("cluster_id")
    sets = kept.select(F.col("slot_id").alias("cluster_id"), "centroid")
    back = moved.join(nearest(moved, sets).select("vec_id", "cluster_id"), "vec_id").select(rows.columns)
    stay = rows.where(F.col("cluster_id") != slot).withColumn("cluster_id", F.when(F.col("cluster_id") == last, F.lit(slot)).otherwise(F.col("cluster_id")).cast("long"))
    return kept, stay.unionByName(back)


def apply_split(rows: DataFrame, sides: DataFrame, cluster: int, new: int) -> DataFrame:
    """rows whose side 1 of `cluster` has moved to cluster `new`; sides as of split_clusters."""
    side = sides.where(F.col("cluster_id") == cluster).select("vec_id", F.col("side").alias("_side"))
    moved = rows.join(side, "vec_id", "left").withColumn("cluster_id", F.when((F.col("cluster_id") == cluster) & (F.col("_side") == 1), F.lit(new)).otherwise(F.col("cluster_id")).cast("long"))
    return moved.select(rows.columns)


def apply_merges(rows: DataFrame, pairs: list[tuple[int, int]]) -> DataFrame:
    """rows whose tiny clusters have become part of their hosts."""
    if not pairs:
        return rows
    moves = rows.sparkSession.createDataFrame(pairs, "cluster_id long, _host long")
    return rows.join(F.broadcast(moves), "cluster_id", "left").withColumn("cluster_id", F.coalesce("_host", "cluster_id")).select(rows.columns)


def select_rows(codes: DataFrame, wanted: DataFrame) -> DataFrame:
    """Codes in the order of wanted (position, vec_id); a vec_id may come more than once."""
    return wanted.join(codes, "vec_id").select("position", *codes.columns).orderBy("position")
