"""Clustered search: route queries to clusters, scan their rows, exactly or by codes, and keep the top k."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vectide.functions.vectors import np_scores, parse_metric, score
from vectide.operators import rabitq, rank
from vectide.operators.assign import ARRAY, distances, in_parts, one_row, parts_of

#: Bytes of queries that are broadcast at once; more of them go in parts, or are joined by shuffle.
BROADCAST = 64 << 20


def _small(df: DataFrame, v: str | None = None) -> DataFrame:
    """The table with a hint to broadcast it if its size allows; else the planner joins it by shuffle.  v: its column of vectors."""
    rows = df.count() if v is None else 0
    return F.broadcast(df) if (rows * 64 <= BROADCAST if v is None else parts_of(df, v, BROADCAST) == 1) else df


def exact(rows: DataFrame, queries: DataFrame, k: int, metric: str = "l2", v: str = "embedding") -> DataFrame:
    """query_id, rank, id, score: the k best rows of each query among all, by expressions.

    queries (query_id, query) are a stated set; more than BROADCAST bytes of them
    pass the rows in parts.  A query of another width than a row's fails.
    """
    out = None
    for part in in_parts(queries.select("query_id", "query"), "query_id", parts_of(queries, "query", BROADCAST)):
        pairs = rows.select(F.col("vec_id").alias("id"), v).crossJoin(F.broadcast(part))
        own = rank.top_k(pairs.select("query_id", "id", score(metric, "query", v).alias("score")), k, ["query_id"]).select("query_id", "rank", "id", "score")
        out = own if out is None else out.unionByName(own)
    return out


def exact_scan(rows: DataFrame, ids: np.ndarray, queries: np.ndarray, k: int, metric: str = "l2", v: str = "embedding") -> DataFrame:
    """The same past broadcast query vectors: every batch keeps its k best a query, so k rows a batch are shuffled."""
    parse_metric(metric)
    if queries.nbytes > BROADCAST and len(queries) > 1:
        half = len(queries) // 2
        return exact_scan(rows, ids[:half], queries[:half], k, metric, v).unionByName(exact_scan(rows, ids[half:], queries[half:], k, metric, v))
    shared = rows.sparkSession.sparkContext.broadcast((np.asarray(ids, dtype=np.int64), np.asarray(queries, dtype=np.float32)))

    def run(batches):
        from vectide.functions.vectors import matrix

        names, q = shared.value
        for b in batches:
            if not b.num_rows:
                continue
            own, s = b["vec_id"].to_numpy(), np_scores(metric, q, matrix(b[v]))
            n = min(k, len(own))
            order = np.lexsort((np.broadcast_to(own, s.shape), -s, np.isnan(s)), axis=1)[:, :n]
            yield pa.record_batch([pa.array(np.repeat(names, n)), pa.array(own[order].ravel()), pa.array(np.take_along_axis(s, order, 1).ravel())], names=["query_id", "id", "score"])

    hits = rows.select("vec_id", v).mapInArrow(run, "query_id long, id long, score double")
    return rank.top_k(hits, k, ["query_id"]).select("query_id", "rank", "id", "score")


def probes(queries: DataFrame, centroids: DataFrame, nprobe: int) -> DataFrame:
    """query_id, cluster_id, place: the nearest centroids of each query, smaller ids first on ties; past one broadcast array, or several."""
    found = queries.select("query_id", "query", F.lit(None).alias("_best"))
    first = True
    for part in in_parts(centroids.select("cluster_id", "centroid"), "cluster_id", parts_of(centroids, "centroid", ARRAY)):
        d = distances("query") if first else F.concat("_best", distances("query"))
        found = found.crossJoin(F.broadcast(one_row(part, "cluster_id", "centroid"))).select("query_id", "query", F.slice(F.array_sort(d), 1, max(nprobe, 1)).alias("_best"))
        first = False
    each = found.select("query_id", F.posexplode("_best").alias("_place", "_hit")).where(F.col("_place") < nprobe)
    return each.select("query_id", F.col("_hit.cluster_id").alias("cluster_id"), (F.col("_place") + 1).cast("long").alias("place"))


def clustered(rows: DataFrame, centroids: DataFrame, queries: DataFrame, k: int, nprobe: int, metric: str = "l2", v: str = "embedding") -> DataFrame:
    """query_id, rank, id, score: the k best rows of the nprobe nearest clusters.

    rows carry cluster_id.  The probes are an equi-join on it, so rows written
    `partitionBy("cluster_id")` are read from the probed partitions alone.
    """
    chosen = probes(queries, centroids, nprobe).join(queries.select("query_id", "query"), "query_id").select("query_id", "query", "cluster_id")
    pairs = rows.select("cluster_id", F.col("vec_id").alias("id"), v).join(_small(chosen, "query"), "cluster_id")
    return rank.top_k(pairs.select("query_id", "id", score(metric, "query", v).alias("score")), k, ["query_id"]).select("query_id", "rank", "id", "score")


def _coded(c: pa.Table) -> tuple[rabitq.Codes, np.ndarray, int, str]:
    """A group's codes, the ids of its rows, its seed and its metric."""
    f = {n: c[n][0].as_py() for n in ("centroid", "seed", "metric", "ex_bits")}
    seed = f["seed"] % (1 << 64)
    return rabitq.read_codes(c, np.array(f["centroid"]), seed, f["metric"], f["ex_bits"]), c["vec_id"].to_numpy(), seed, f["metric"]


def _by_cluster(codes: DataFrame, frames: DataFrame, asked: DataFrame, run, schema: str) -> DataFrame:
    """Groups of a cluster's codes, with its frame, and of the queries that probe it; raw vectors aren't read.  Clusters are held to a few hundred rows by the policy."""
    right = asked.withColumn("cluster_id", F.col("cluster_id").cast("long")).withColumn("query_id", F.col("query_id").cast("long"))
    return codes.join(frames, "cluster_id").groupBy("cluster_id").cogroup(right.groupBy("cluster_id")).applyInArrow(run, schema)


def estimates(codes: DataFrame, frames: DataFrame, chosen: DataFrame, exact_bounds: bool = False, sigmas: float = 0.0, shared: bool = False, most: int | None = None) -> DataFrame:
    """query_id, id, estimate, bound for the codes of the probed clusters; chosen: query_id, query, cluster_id.

    most: only the `most` best estimates of each query and cluster leave the group.
    """

    def run(key: tuple, c: pa.Table, q: pa.Table) -> pa.Table:
        out = []
        if c.num_rows and q.num_rows:
            own, names, seed, metric = _coded(c)
            for query_id, vector in zip(q["query_id"].to_pylist(), q["query"].to_pylist(), strict=True):
                s, b = rabitq.score(own, rabitq.Query(np.array(vector), metric, seed, exact_bounds, sigmas, shared))
                at = np.arange(len(names)) if most is None else np.lexsort((names, -s))[:most]
                out.append((np.full(len(at), query_id), names[at], s[at], b[at]))
        parts = [np.concatenate(x) for x in zip(*out, strict=True)] if out else [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0), np.zeros(0)]
        return pa.table(dict(zip(("query_id", "id", "estimate", "bound"), parts, strict=True)))

    return _by_cluster(codes, frames, chosen.select("cluster_id", "query_id", "query"), run, "query_id long, id long, estimate double, bound double")


def reaching(codes: DataFrame, frames: DataFrame, chosen: DataFrame, exact_bounds: bool = False, sigmas: float = 0.0, shared: bool = False, sure: bool = False) -> DataFrame:
    """query_id, id: the codes of the probed clusters whose bound is not below the query's cutoff; chosen also has cutoff, null for none.

    sure: by bounds that no score exceeds, so that no row that reaches the cutoff is missed.
    An envelope of the cluster or of the row spares most rows their bound.
    """

    def run(key: tuple, c: pa.Table, q: pa.Table) -> pa.Table:
        out = []
        if c.num_rows and q.num_rows:
            own, names, seed, metric = _coded(c)
            for query_id, vector, cutoff in zip(q["query_id"].to_pylist(), q["query"].to_pylist(), q["cutoff"].to_pylist(), strict=True):
                query = rabitq.Query(np.array(vector), metric, seed, exact_bounds, sigmas, shared, sure)
                at = names if cutoff is None else names[rabitq.may_reach(own, query, cutoff)]
                out.append((np.full(len(at), query_id), at))
        parts = [np.concatenate(x) for x in zip(*out, strict=True)] if out else [np.zeros(0, np.int64), np.zeros(0, np.int64)]
        return pa.table(dict(zip(("query_id", "id"), parts, strict=True)))

    return _by_cluster(codes, frames, chosen.select("cluster_id", "query_id", "query", "cutoff"), run, "query_id long, id long")


def two_pass(rows: DataFrame, codes: DataFrame, frames: DataFrame, centroids: DataFrame, queries: DataFrame, k: int, nprobe: int, metric: str = "l2", wider: int = 2, exact_bounds: bool = False, sigmas: float = 0.0, shared: bool = False, v: str = "embedding") -> DataFrame:
    """query_id, rank, id, score: top k of the probed clusters by codes, exact scores and bounds.

    The wider * k best estimates are scored exactly; the k-th exact score is the
    cutoff; every other row whose bound is not below it is scored exactly too.
    A query with fewer than k shortlisted rows has no cutoff and reads all.
    Without sigmas the bounds are sure, and the answer is exact in the probed
    clusters; sigmas: likely bounds of this width, which may miss rows.
    exact_bounds: infinite bounds, so that every row is scored exactly.

    Groups of a cluster's codes give up their own shortlists first, and rows
    that reach the cutoff second, so that no estimate of any other row is
    shuffled.  codes are read twice: a stored table, not made on the fly, serves.
    """
    q = _small(queries.select("query_id", "query"), "query")
    chosen = probes(queries, centroids, nprobe).join(q, "query_id").select("cluster_id", "query_id", "query")
    short = rank.top_k(estimates(codes, frames, chosen, exact_bounds, sigmas, shared, most=wider * k), wider * k, ["query_id"], score="estimate").select("query_id", "id")
    raw = rows.select(F.col("vec_id").alias("id"), v)
    exactly = lambda found: found.join(raw, "id").join(q, "query_id").select("query_id", "id", score(metric, "query", v).alias("score"))
    first = exactly(short)
    cut = rank.cutoff(first, k, ["query_id"]).select("query_id", F.col("score").alias("cutoff"))
    rest = reaching(codes, frames, chosen.join(cut, "query_id", "left"), exact_bounds, sigmas, shared, sure=not sigmas)
    every = first.unionByName(exactly(rest.join(short, ["query_id", "id"], "left_anti")))
    return rank.top_k(every, k, ["query_id"]).select("query_id", "rank", "id", "score")
