"""k-means: a bounded sample is fitted, every row is assigned in one distributed pass.

Fits are deterministic for a seed, however the table is split: the sample is the
rows with the smallest hashes of their ids, and sums over it are sums of whole
numbers.  Above TWO_LEVEL clusters the fit has two levels and the fine fits run
on the executors, bucket by bucket.  A sample of more than DRIVER bytes never
leaves the executors; only candidates, centroids and counts come to the driver.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vectide.functions import sizing
from vectide.functions.vectors import l2_sq, matrix
from vectide.operators.assign import assign, assign_two_level, file_fine, nearest_rows, nearest_two_level

# fixed values of the fit
TRIALS = 4  # candidates of a greedy seeding step
SPLIT_ITERS = 8
TWO_LEVEL = 512  # clusters above which the fit has two levels
PROBE, REFINE = 16, 3
DRAWS = 3  # passes of a seeding on the executors, each of as many candidates as there are centroids

#: Bytes of a sample, as float32, that the driver fits; a larger one stays on the executors.
DRIVER = 8 << 20


def unit(x: np.ndarray) -> np.ndarray:
    n = np.linalg.norm(x, axis=-1, keepdims=True)
    return np.divide(x, n, out=x.copy(), where=n > 0)


def seed_centroids(x: np.ndarray, k: int, rng: np.random.Generator, weights: np.ndarray | None = None) -> np.ndarray:
    """Greedy k-means++: of a few draws in proportion to squared distance, the one that leaves the least cost.  weights: rows that each row stands for."""
    cost = (lambda d: d) if weights is None else (lambda d: d * weights)
    first = int(rng.integers(len(x))) if weights is None else int(weights.argmax())
    chosen = [first]
    d2 = ((x - x[first]) ** 2).sum(1)
    while len(chosen) < k:
        total = cost(d2).sum()
        if total > 0:
            draws = np.minimum(np.searchsorted(np.cumsum(cost(d2)), rng.random(TRIALS) * total, "right"), len(x) - 1)
        else:  # every row lies on a centroid
            draws = rng.integers(len(x), size=1)
        draws = np.unique(draws)
        options = np.minimum(d2, np.maximum((x[draws] ** 2).sum(1)[:, None] + (x * x).sum(1) - 2 * x[draws] @ x.T, 0))
        best = int(cost(options).sum(1).argmin())
        chosen.append(int(draws[best]))
        d2 = np.minimum(d2, ((x - x[draws[best]]) ** 2).sum(1))
    return x[chosen].copy()


def update(x: np.ndarray, at: np.ndarray, k: int, old: np.ndarray, spherical: bool) -> np.ndarray:
    """Means of the clusters; an empty one moves to the row farthest from its own centroid that no other has claimed."""
    n = np.bincount(at, minlength=k)
    c = np.stack([np.bincount(at, x[:, j], k) for j in range(x.shape[1])], 1)
    c = np.divide(c, n[:, None], out=old.astype(float).copy(), where=n[:, None] > 0)
    if (empty := np.flatnonzero(n == 0)).size:
        far = np.argsort(-((x - old[at]) ** 2).sum(1), kind="stable")
        c[empty[: len(far)]] = x[far[: len(empty)]]
    return unit(c) if spherical else c


def lloyd(x: np.ndarray, c: np.ndarray, iters: int, spherical: bool, nearest=lambda x, c: nearest_rows(x, c)[0]) -> tuple[np.ndarray, np.ndarray]:
    """Centroids and assignment after at most `iters` rounds; stops when nothing moves."""
    at = nearest(x, c)
    for _ in range(iters):
        c = update(x, at, len(c), c, spherical)
        new = nearest(x, c)
        if (new == at).all():
            break
        at = new
    return c, at


def shares(sizes: list[int], k: int) -> list[int]:
    """k centroids over buckets: one each, the rest one by one to the largest rows per centroid, never more than a bucket's rows."""
    import heapq
    from fractions import Fraction

    got = [1] * len(sizes)
    heap = [(-Fraction(s, 2), b) for b, s in enumerate(sizes) if s > 1]
    heapq.heapify(heap)
    for _ in range(k - len(sizes)):
        if not heap:
            break
        _, b = heapq.heappop(heap)
        got[b] += 1
        if got[b] < sizes[b]:
            heapq.heappush(heap, (-Fraction(sizes[b], got[b] + 1), b))
    return got


def balanced_split(x: np.ndarray, iters: int = SPLIT_ITERS, seed: int = 1, spherical: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Two centroids and sides, each side with a quarter of the rows at least, rounded up; the centroids are the sides' means."""
    n = len(x)
    if n < 2:
        raise ValueError("a split needs at least two rows")
    x = x.astype(np.float64)
    c, side = lloyd(x, seed_centroids(x, 2, np.random.default_rng(seed)), iters, spherical)
    least = -(-n // 4)
    means = lambda s: (lambda m: unit(m) if spherical else m)(np.stack([x[s == k].mean(0) for k in (0, 1)]))
    if np.bincount(side, minlength=2).min() >= least:
        return means(side), side
    for _ in range(max(1, iters)):
        pull = ((x - c[0]) ** 2).sum(1) - ((x - c[1]) ** 2).sum(1)
        left = int(np.clip((pull < 0).sum(), least, n - least))
        new = np.ones(n, dtype=np.int64)
        new[np.argsort(pull, kind="stable")[:left]] = 0
        same, side = (new == side).all(), new
        c = means(side)
        if same:
            break
    return c, side


def split_step(rows: DataFrame, halves: DataFrame, by: str = "cluster_id", v: str = "embedding", row_id: str = "vec_id") -> DataFrame:
    """by, row_id, side: one step of a balanced split of every cluster about two given centroids (by, c0, c1), by windows.

    Rows are ranked by how much nearer they are to the first centroid; side 0
    takes those that are nearer, but a quarter of the rows at least, rounded up,
    and leaves as many.  It is the rule of balanced_split as expressions.
    """
    pull = rows.join(halves, by).select(by, row_id, F.round(l2_sq(v, "c0") - l2_sq(v, "c1"), 9).alias("pull"))
    every = Window.partitionBy(by)
    n, left = F.count("*").over(every), F.sum((F.col("pull") < 0).cast("long")).over(every)
    least = F.ceil(n / 4)
    place = F.row_number().over(every.orderBy("pull", row_id))
    return pull.select(by, row_id, F.when(place <= F.least(F.greatest(left, least), n - least), 0).otherwise(1).cast("long").alias("side"))


@dataclass(frozen=True)
class KMeans:
    """A fit's parameters.  max_bytes also bounds the sample, as float32."""

    k: int
    iters: int = 11
    seed: int = 1
    spherical: bool = False
    max_bytes: int = 256 << 20

    def sample(self, rows: DataFrame, n: int, v: str = "embedding", row_id: str = "vec_id") -> np.ndarray:
        """The n rows with the smallest hashes of their ids, in order of id."""
        picked = rows.select(row_id, v).orderBy(F.xxhash64(F.col(row_id), F.lit(self.seed)), row_id).limit(n)
        table = picked.toArrow()
        order = np.argsort(table[row_id].to_numpy(), kind="stable")
        return matrix(table[v])[order]

    def spread_sample(self, rows: DataFrame, n: int, v: str = "embedding", row_id: str = "vec_id") -> DataFrame:
        """row, tie, embedding: the same rows as a table, found by the n-th smallest hash, without a sort; rows with the last one's id come along.

        row and tie, hashes of the id and of the vector, order the rows.
        """
        own = rows.select(F.xxhash64(F.col(row_id), F.lit(self.seed)).alias("row"), F.col(row_id).alias("id"), F.col(v).cast("array<float>").alias("embedding"))
        bins = own.groupBy(F.shiftright("row", 48).alias("bin")).count().toArrow().sort_by("bin")
        upto = np.cumsum(bins["count"].to_numpy())
        at = int(np.searchsorted(upto, n))
        before = int(upto[at - 1]) if at else 0
        h, last = own.where(F.shiftright("row", 48) == bins["bin"][at].as_py()).select("row", "id").orderBy("row", "id").offset(n - before - 1).limit(1).first()
        own = own.where((F.col("row") < h) | ((F.col("row") == h) & (F.col("id").isNull() | (F.col("id") <= F.lit(last)))))
        return own.select("row", F.xxhash64("embedding").alias("tie"), "embedding")

    def fit(self, rows: DataFrame, v: str = "embedding", row_id: str = "vec_id") -> Fitted:
        """Centroids fitted on the sample; `Fitted.assign` places every row."""
        n = rows.count()
        if n == 0:
            return Fitted(np.zeros((0, 0)), None)
        k = min(max(self.k, 1), n)
        head = rows.select(F.size(v)).first()[0]
        n = min(n, sizing.sample_size_for(k, head, self.max_bytes))
        if 4 * n * head > DRIVER:
            sample = self.spread_sample(rows, n, v, row_id).persist()
            try:
                return self._spread(sample, min(k, n))
            finally:
                sample.unpersist()
        x = self.sample(rows, n, v, row_id).astype(np.float64)
        k = min(k, len(x))
        rng = np.random.default_rng(self.seed)
        if k <= TWO_LEVEL:
            c, _ = lloyd(x, seed_centroids(x, k, rng), self.iters, self.spherical)
            return Fitted(c, None)
        coarse, at = lloyd(x, seed_centroids(x, int(np.ceil(np.sqrt(k))), rng), self.iters, self.spherical)
        used = np.unique(at)
        coarse, at = coarse[used], np.searchsorted(used, at)
        sample = rows.sparkSession.createDataFrame(pa.table({"row": np.arange(len(x)), "tie": np.zeros(len(x), np.int64), "bucket": at, "embedding": _list_array(x)}))
        return self._two_levels(sample, sample, coarse, np.bincount(at), k)

    def _spread(self, sample: DataFrame, k: int) -> Fitted:
        """The fit of a sample that stays on the executors."""
        wide = k > TWO_LEVEL
        c = _spread_seeds(sample, int(np.ceil(np.sqrt(k))) if wide else k, self.seed)
        step = _step(sample)
        for _ in range(self.iters):
            new = _lloyd_round(sample, c, (c,), nearest_rows, step, self.spherical)[0]
            if np.array_equal(new, c):
                break
            c = new
        if not wide:
            return Fitted(c, None)
        n = _totals(sample, len(c), (c,), nearest_rows)[0]
        coarse = c[n > 0]
        shared = sample.sparkSession.sparkContext.broadcast(coarse)

        def file(batches):
            for b in batches:
                if b.num_rows:
                    yield pa.record_batch([b["row"], b["tie"], pa.array(nearest_rows(matrix(b["embedding"]), shared.value)[0]), b["embedding"]], names=["row", "tie", "bucket", "embedding"])

        return self._two_levels(sample, sample.mapInArrow(file, "row long, tie long, bucket long, embedding array<float>"), coarse, n[n > 0], k)

    def _two_levels(self, sample: DataFrame, filed: DataFrame, coarse: np.ndarray, sizes: np.ndarray, k: int) -> Fitted:
        """Fine centroids of a sample; filed: its rows with their buckets, of which sizes has the numbers of rows."""
        quota = shares(sizes.tolist(), k)
        iters, seed, spherical = self.iters, self.seed, self.spherical

        def fine(key: tuple, t: pa.Table) -> pa.Table:
            b = key[0].as_py()
            own = matrix(t["embedding"])[np.lexsort((t["tie"].to_numpy(), t["row"].to_numpy()))].astype(np.float64)
            c, _ = lloyd(own, seed_centroids(own, quota[b], np.random.default_rng(seed + b + 1)), iters, spherical)
            return pa.table({"bucket": pa.array([b] * len(c), pa.int64()), "place": pa.array(range(len(c)), pa.int64()), "centroid": pa.array(c.tolist(), pa.list_(pa.float64()))})

        found = filed.groupBy("bucket").applyInArrow(fine, "bucket long, place long, centroid array<double>").toArrow()
        order = np.lexsort((found["place"].to_numpy(), found["bucket"].to_numpy()))
        c = found["centroid"].combine_chunks().flatten().to_numpy().reshape(found.num_rows, -1)[order]
        step = _step(sample)
        for _ in range(min(self.iters, REFINE)):
            new = _lloyd_round(sample, c, (coarse, c, file_fine(coarse, c), PROBE), nearest_two_level, step, spherical)[0]
            if np.array_equal(new, c):
                break
            c = new
        return Fitted(c, coarse)


def _list_array(x: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1]), pa.array(x.astype(np.float32).ravel()))


def _spread_seeds(sample: DataFrame, k: int, seed: int) -> np.ndarray:
    """k-means|| (arXiv:1203.6402): passes draw k rows each in proportion to squared distance, and the drawn, weighted by the rows nearest to each, seed k-means++.

    A draw is a race: the least of -log(u) / d2 win, u a hash of row and pass, so
    that it doesn't matter how the rows are split.
    """
    c = np.zeros((0, 0))
    for turn in range(DRAWS + 1):
        shared, most = sample.sparkSession.sparkContext.broadcast(c), k if turn else 1

        def race(batches, shared=shared, most=most):
            for b in batches:
                if b.num_rows:
                    d2 = nearest_rows(matrix(b["embedding"]), shared.value)[1] if len(shared.value) else np.ones(b.num_rows)
                    late = np.divide(-np.log(b["u"].to_numpy()), d2, out=np.full(len(d2), np.inf), where=d2 > 0)
                    first = np.lexsort((b["tie"].to_numpy(), b["row"].to_numpy(), late))[:most]
                    first = pa.array(first[np.isfinite(late[first])])
                    yield pa.record_batch([pa.array(late).take(first), *(b[n].take(first) for n in ("row", "tie", "embedding"))], names=["late", "row", "tie", "embedding"])

        u = (F.shiftrightunsigned(F.xxhash64("row", "tie", F.lit(turn), F.lit(seed)), 11) + 1) / F.lit(2.0**53)
        run = sample.select("row", "tie", "embedding", u.alias("u")).mapInArrow(race, "late double, row long, tie long, embedding array<float>")
        won = run.orderBy("late", "row", "tie").limit(most).select("embedding").toArrow()
        if not won.num_rows:  # every row lies on a candidate
            break
        new = matrix(won["embedding"]).astype(np.float64)
        new = new[np.sort(np.unique(new, axis=0, return_index=True)[1])]
        c = np.concatenate((c, new)) if len(c) else new
    n = _totals(sample, len(c), (c,), nearest_rows)[0]
    return seed_centroids(c, k, np.random.default_rng(seed), n.astype(np.float64))


def _step(sample: DataFrame) -> float:
    """The grid for sums over the sample: as fine as sums of all rows' places on it fit 64 bits, a power of 2."""
    n, top = sample.agg(F.count("*"), F.max(F.array_max(F.transform("embedding", lambda x: F.abs(x.cast("double")))))).first()
    return 2.0 ** (np.ceil(np.log2(top)) + min(-10, np.ceil(np.log2(n)) - 61)) if top else 1.0


def _totals(sample: DataFrame, k: int, nearest_of: tuple, nearest, step: float | None = None) -> tuple[np.ndarray, np.ndarray | None]:
    """Of each of k clusters the number of rows and, on the grid, their sums; added up on the executors, whole numbers in any order.

    nearest(x, *nearest_of) gives the rows' clusters and squared distances.
    """
    shared = sample.sparkSession.sparkContext.broadcast(nearest_of)

    def added(at: np.ndarray, n: np.ndarray, s: np.ndarray) -> pa.RecordBatch:
        order = np.argsort(at, kind="stable")
        own, start = np.unique(at[order], return_index=True)
        s = np.add.reduceat(s[order], start) if len(own) else s
        ends = pa.array(np.arange(len(own) + 1, dtype=np.int32) * s.shape[1])
        return pa.record_batch([pa.array(own), pa.array(np.add.reduceat(n[order], start) if len(own) else n), pa.ListArray.from_arrays(ends, pa.array(s.ravel()))], names=["cluster", "n", "s"])

    def sums(batches):
        n = s = None
        for b in batches:
            if b.num_rows:
                x = matrix(b["embedding"]).astype(np.float64)
                at = nearest(x, *shared.value)[0]
                own = added(at, np.ones(len(x), np.int64), np.rint(x / step).astype(np.int64) if step else np.zeros((len(x), 0), np.int64))
                if n is None:
                    n, s = np.zeros(k, np.int64), np.zeros((k, x.shape[1] if step else 0), np.int64)
                at = own["cluster"].to_numpy()
                n[at] += own["n"].to_numpy()
                s[at] += own["s"].flatten().to_numpy().reshape(len(at), -1) if step else 0
        if n is not None:
            at = np.flatnonzero(n)
            yield added(at, n[at], s[at])

    def parts(batches):
        got = [b for b in batches if b.num_rows]
        if got:
            t = pa.Table.from_batches(got)
            yield added(t["cluster"].to_numpy(), t["n"].to_numpy(), t["s"].combine_chunks().flatten().to_numpy().reshape(t.num_rows, -1) if step else np.zeros((t.num_rows, 0), np.int64))

    kind = "cluster long, n long, s array<long>"
    t = sample.mapInArrow(sums, kind).repartition("cluster").mapInArrow(parts, kind).toArrow()
    at, n = t["cluster"].to_numpy(), np.zeros(k, dtype=np.int64)
    n[at] = t["n"].to_numpy()
    if not step:
        return n, None
    whole = t["s"].combine_chunks().flatten().to_numpy().reshape(t.num_rows, -1)
    s = np.zeros((k, whole.shape[1]))
    s[at] = whole * step
    return n, s


def _lloyd_round(sample: DataFrame, c: np.ndarray, nearest_of: tuple, nearest, step: float, spherical: bool) -> tuple[np.ndarray, np.ndarray]:
    """One round of Lloyd's algorithm over the sample, on the executors: new centroids, and the sizes that the old ones had.

    An empty cluster moves to the row farthest from its own centroid that no
    other has claimed.
    """
    n, s = _totals(sample, len(c), nearest_of, nearest, step)
    new = np.divide(s, n[:, None], out=c.copy(), where=n[:, None] > 0)
    if (empty := np.flatnonzero(n == 0)).size:
        shared = sample.sparkSession.sparkContext.broadcast(nearest_of)

        def far(batches):
            for b in batches:
                if b.num_rows:
                    yield pa.record_batch([b["row"], b["tie"], b["embedding"], pa.array(nearest(matrix(b["embedding"]).astype(np.float64), *shared.value)[1])], names=["row", "tie", "embedding", "d2"])

        rows = sample.mapInArrow(far, "row long, tie long, embedding array<float>, d2 double").orderBy(F.desc("d2"), "row", "tie").limit(int(empty.size)).toArrow()
        new[empty[: rows.num_rows]] = matrix(rows["embedding"])
    return (unit(new) if spherical else new), n


@dataclass(frozen=True)
class Fitted:
    """Centroids, by cluster id, and the coarse ones of a fit with two levels."""

    centroids: np.ndarray
    coarse: np.ndarray | None

    def assign(self, rows: DataFrame, v: str = "embedding") -> DataFrame:
        """rows with cluster_id and d2; with two levels nearest among the fine centroids of the nearest coarse ones."""
        if not len(self.centroids):
            return rows.select("*", F.lit(None).cast("long").alias("cluster_id"), F.lit(None).cast("double").alias("d2"))
        if self.coarse is None:
            return assign(rows, np.arange(len(self.centroids)), self.centroids, v)
        return assign_two_level(rows, self.coarse.astype(np.float32), self.centroids.astype(np.float32), PROBE, v)

    def table(self, spark) -> DataFrame:
        """cluster_id, centroid."""
        c = [[float(x) for x in row] for row in self.centroids.astype(np.float32)]
        return spark.createDataFrame(list(enumerate(c)), "cluster_id long, centroid array<float>")


def split_clusters(rows: DataFrame, by: str = "cluster_id", v: str = "embedding", row_id: str = "vec_id", iters: int = SPLIT_ITERS, seed: int = 1) -> DataFrame:
    """by, row_id, side (0 or 1): a balanced split of every cluster given; clusters hold a few hundred rows."""

    def split(key: tuple, t: pa.Table) -> pa.Table:
        order = np.argsort(t[row_id].to_numpy(), kind="stable")
        x = matrix(t[v])[order]
        side = balanced_split(x, iters, seed)[1] if len(x) > 1 else np.zeros(len(x), np.int64)
        return pa.table({by: pa.array([key[0].as_py()] * len(x), pa.int64()), row_id: t[row_id].combine_chunks().take(pa.array(order)).cast(pa.int64()), "side": pa.array(side, pa.int64())})

    return rows.select(F.col(by).cast("long").alias(by), F.col(row_id).cast("long").alias(row_id), v).groupBy(by).applyInArrow(split, f"{by} long, {row_id} long, side long")
