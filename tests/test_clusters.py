import numpy as np
import pytest

from vectide.operators import assign, kmeans, policy, search


def centroids(spark, x):
    return spark.createDataFrame([(k, [float(v) for v in row]) for k, row in enumerate(x)], "cluster_id long, centroid array<float>")


def test_nearest_ties_and_forms(spark, vectors):
    x, c = [[1, 0], [9, 1], [5, 0], [0, 7]], [[0, 0], [10, 0], [0, 10], [10, 0]]
    want = [0, 1, 0, 2]
    got = assign.nearest(vectors(x), centroids(spark, c)).orderBy("vec_id").collect()
    assert [r["cluster_id"] for r in got] == want and [r["d2"] for r in got] == [1, 2, 25, 9]
    scan = assign.assign(vectors(x), np.arange(4), np.array(c, dtype=float)).orderBy("vec_id").collect()
    assert [r["cluster_id"] for r in scan] == want and [r["d2"] for r in scan] == [1, 2, 25, 9]


def test_two_levels_agree(spark, vectors):
    rng = np.random.default_rng(4)
    x, coarse, fine = rng.standard_normal((200, 5)), rng.standard_normal((6, 5)), rng.standard_normal((30, 5))
    x, coarse, fine = (a.astype(np.float32) for a in (x, coarse, fine))
    for probe in (2, 6):
        a = assign.two_level_assign(vectors(x), centroids(spark, coarse), centroids(spark, fine), probe).orderBy("vec_id").collect()
        b = assign.assign_two_level(vectors(x), coarse, fine, probe).orderBy("vec_id").collect()
        assert [r["cluster_id"] for r in a] == [r["cluster_id"] for r in b]
    assert [r["cluster_id"] for r in b] == assign.nearest_rows(x, fine)[0].tolist()


def test_sets_that_are_too_large_to_broadcast(spark, vectors, monkeypatch):
    """In parts, or by joins, the answers are the same."""
    rng = np.random.default_rng(7)
    x, coarse, fine = (rng.standard_normal((n, 5)).astype(np.float32) for n in (120, 6, 40))
    rows, c, f = vectors(x), centroids(spark, coarse), centroids(spark, fine)
    key = lambda df: sorted(tuple(r) for r in df.collect())
    at = lambda df: [(r["vec_id"], r["cluster_id"], round(r["d2"], 6)) for r in df.orderBy("vec_id").collect()]
    q = rows.where("vec_id < 7").selectExpr("vec_id as query_id", "embedding as query")
    made = lambda: (key(assign.nearest(rows, f)), key(assign.two_level_assign(rows, c, f, 3)), key(assign.nearest_other(f)), key(search.probes(q, f, 6)), key(search.exact(rows, q, 4)), at(assign.assign_two_level(rows, coarse, fine, 3)))
    want = made()
    for limit in (900, 200):
        monkeypatch.setattr(assign, "ARRAY", limit)
        monkeypatch.setattr(search, "ARRAY", limit)
        monkeypatch.setattr(search, "BROADCAST", limit)
        monkeypatch.setattr(assign, "BROADCAST", 0)
        assert made() == want
    scan = key(search.exact_scan(rows, np.arange(7), x[:7], 4).select("query_id", "rank", "id"))
    assert scan == [(a, b, c) for a, b, c, _ in want[4]]


def test_no_centroids_and_repeated_rows(spark, vectors):
    rows = vectors([[1, 2], [3, 4]])
    none = assign.nearest(rows, centroids(spark, [[0, 0]]).limit(0)).collect()
    assert len(none) == 2 and all(r["cluster_id"] is None for r in none)
    twice = rows.unionByName(rows)
    assert assign.nearest(twice, centroids(spark, [[0, 0], [3, 3]])).count() == 4
    assert assign.nearest_other(centroids(spark, [[0, 0]])).count() == 0


def test_only_the_asked_meet_the_others(spark):
    c = centroids(spark, [[0, 0], [1, 0], [5, 0], [6, 1]])
    of = spark.createDataFrame([(2,)], "cluster_id long")
    assert [tuple(r) for r in assign.nearest_other(c, of).collect()] == [(2, 3, 2.0)]


def test_busy_clusters_wait_and_cost_no_tries(spark):
    n = 60
    stats = spark.createDataFrame([(k, 100 if k >= n else 1 + k % 3, 1.0) for k in range(2 * n)], "cluster_id long, count long, radius double")
    c = centroids(spark, [[k % n, 0.1 * (k >= n)] for k in range(2 * n)])
    plan = policy.merge_targets(stats, c, 1, busy=lambda k: k < 40)
    assert len(plan) == 1 and plan[0][0] >= 40 and plan[0][1] == plan[0][0] + n
    assert policy.merge_targets(stats, c, 1, busy=lambda k: True) == [] == policy.merge_targets(stats, c, 0)
    assert policy.merge_targets(stats, c, 3) == [(0, n), (3, n + 3), (6, n + 6)]


def test_a_step_of_a_split_is_the_librarys(spark, vectors):
    rng = np.random.default_rng(2)
    x = np.concatenate([rng.standard_normal((30, 3)), 9 + 0.1 * rng.standard_normal((4, 3))]).astype(np.float32)
    c0, c1 = x[0], x[-1]
    halves = spark.createDataFrame([(0, [float(v) for v in c0], [float(v) for v in c1])], "cluster_id long, c0 array<double>, c1 array<double>")
    got = {r["vec_id"]: r["side"] for r in kmeans.split_step(vectors(x, cluster_id=[0] * 34), halves).collect()}
    pull = ((x.astype(float) - c0) ** 2).sum(1) - ((x.astype(float) - c1) ** 2).sum(1)
    left = int(np.clip((pull < 0).sum(), 9, 25))
    assert sorted(k for k, s in got.items() if s == 0) == sorted(np.argsort(pull, kind="stable")[:left].tolist())


def test_stats(spark, vectors):
    rows = vectors([[0, 0], [2, 0], [3, 4]], cluster_id=[0, 0, 1])
    c = assign.centroids_of(rows)
    assert {r["cluster_id"]: r["centroid"] for r in c.collect()} == {0: [1, 0], 1: [3, 4]}
    assert {r["cluster_id"]: (r["count"], r["radius"]) for r in assign.cluster_stats(rows, c).collect()} == {0: (2, 1), 1: (1, 0)}
    assert {r["cluster_id"]: r["centroid"] for r in assign.centroids_of(rows, spherical=True).collect()} == {0: [1, 0], 1: [0.6, 0.8]}
    assert assign.sse(rows, c).first()[0] == 2
    assert {r["cluster_id"]: r["vec_id"] for r in assign.farthest(rows, c).collect()} == {0: 0, 1: 2}


def test_blobs(spark, vectors):
    rng = np.random.default_rng(1)
    x = np.concatenate([np.array(m) + 0.05 * rng.standard_normal((50, 2)) for m in ((0, 0), (10, 0), (0, 10))])
    rows = vectors(x)
    fitted = kmeans.KMeans(3).fit(rows)
    again = kmeans.KMeans(3).fit(rows.repartition(7))
    assert np.array_equal(fitted.centroids, again.centroids)
    at = [r["cluster_id"] for r in fitted.assign(rows).orderBy("vec_id").collect()]
    assert all(len(set(at[k : k + 50])) == 1 for k in (0, 50, 100)) and len(set(at)) == 3


def test_degenerate_fits(spark, vectors):
    x = vectors([[0, 0], [0, 0], [100, 100], [100, 100], [50, 0], [0, 50]])
    assert len(np.unique(kmeans.KMeans(4).fit(x).centroids, axis=0)) == 4
    assert len(kmeans.KMeans(9).fit(x).centroids) == 6 and len(kmeans.KMeans(0).fit(x).centroids) == 1
    empty = kmeans.KMeans(3).fit(x.limit(0))
    assert len(empty.centroids) == 0 and empty.assign(x).where("cluster_id is null").count() == 6
    assert len(kmeans.KMeans(3, max_bytes=16).fit(x).centroids) == 2


def test_two_level_fit(spark, vectors):
    rng = np.random.default_rng(5)
    x = (rng.standard_normal((400, 8))[rng.integers(400, size=6000)] + 0.1 * rng.standard_normal((6000, 8))).astype(np.float32)
    rows = vectors(x)
    fitted = kmeans.KMeans(600, iters=4).fit(rows)
    assert fitted.coarse is not None and len(fitted.centroids) == 600
    d2 = [r["d2"] for r in fitted.assign(rows).select("d2").collect()]
    flat = assign.nearest_rows(x, fitted.centroids)[1]
    assert sum(d2) <= 1.05 * flat.sum()


@pytest.mark.parametrize("k", [40, 600])
def test_large_samples_stay_on_the_executors(spark, vectors, monkeypatch, k):
    """The fit is about as good, the same for every split of the table, and no more than candidates and centroids come to the driver."""
    rng = np.random.default_rng(5)
    x = (rng.standard_normal((400, 8))[rng.integers(400, size=5000)] + 0.1 * rng.standard_normal((5000, 8))).astype(np.float32)
    rows = vectors(np.concatenate((x, x[:500])))  # some vectors twice
    model = kmeans.KMeans(k, iters=3)
    cost = lambda c: assign.nearest_rows(x, c)[1].sum()
    plain = cost(model.fit(rows).centroids)
    monkeypatch.setattr(kmeans, "DRIVER", 0, raising=False)
    got, real = [], type(rows).toArrow

    def recorded(self):
        t = real(self)
        got.append(t.num_rows if "embedding" in t.column_names else 0)
        return t

    monkeypatch.setattr(type(rows), "toArrow", recorded)
    a, b = model.fit(rows), model.fit(rows.repartition(7))
    assert max(got) <= k and a.centroids.shape == (k, 8) and (a.coarse is None) == (k == 40)
    assert np.array_equal(a.centroids, b.centroids) and cost(a.centroids) <= 1.1 * plain


def test_the_sample_on_the_executors_is_the_same(spark, vectors):
    x = np.random.default_rng(3).standard_normal((3000, 2)).astype(np.float32)
    rows, model = vectors(x), kmeans.KMeans(3)
    for n in (1, 700, 2999, 3000):
        own = np.array([r["embedding"] for r in model.spread_sample(rows, n).collect()])
        assert sorted(own.tolist()) == sorted(model.sample(rows, n).tolist())


def test_shares():
    assert kmeans.shares([10, 1, 5], 6) == [4, 1, 1] and kmeans.shares([10, 1, 6], 6) == [3, 1, 2]
    assert kmeans.shares([2, 2], 9) == [2, 2]


@pytest.mark.parametrize("x", [np.random.default_rng(6).standard_normal((300, 4)), np.repeat([[0.1], [0.9]], [194, 6], 0).repeat(4, 1), np.ones((200, 4)), np.repeat([[0.0], [1000.0]], [198, 2], 0).repeat(4, 1), np.repeat([[0.0], [10.0]], [140, 60], 0).repeat(4, 1)])
def test_balanced_splits(x):
    c, side = kmeans.balanced_split(x)
    n = np.bincount(side, minlength=2)
    assert n.min() >= -(-len(x) // 4)
    assert np.allclose(c, [x[side == k].mean(0) for k in (0, 1)])


def test_split_needs_two_rows():
    with pytest.raises(ValueError):
        kmeans.balanced_split(np.zeros((1, 3)))


def stats(spark, rows):
    return spark.createDataFrame([(k, *r) for k, r in enumerate(rows)], "cluster_id long, count long, radius double, hits long")


@pytest.mark.parametrize(
    ("rows", "want"),
    [
        ([(196, 1.0, 0)] * 20, None),
        ([(196, 9.0, 0)] + [(196, 1.0, 0)] * 19, 0),  # sick
        ([(196, 9.0, 0), (196, 1.0, 5)] + [(196, 1.0, 0)] * 18, None),  # sick but cold
        ([(196, 9.0, 5), (196, 1.0, 0)] + [(196, 1.0, 0)] * 18, 0),  # sick and hot
        ([(7, 9.0, 0)] + [(196, 1.0, 0)] * 19, None),  # too few rows
        ([(196, 2.0, 0), (196, 0.0, 0)] + [(196, 1.0, 0)] * 18, None),  # twice the mean, not more
        ([(263, 1.0, 0)] + [(194, 1.0, 0)] * 20, None),  # at the split size
        ([(300, 1.0, 0), (400, 1.0, 0), (400, 1.0, 0)] + [(190, 1.0, 0)] * 20, 1),  # the fullest, the first of two
        ([(2000, 0.0, 0), (600, 1.0, 0), (100, 1.0, 0)] + [(100, 1.0, 0)] * 10, 1),  # all one point, so the next
        ([], None),
    ],
)
def test_split_target(spark, rows, want):
    assert policy.DefaultPolicy().split_target(stats(spark, rows)) == want


def test_bootstrap():
    assert policy.DefaultPolicy().bootstrap(63) is None and policy.DefaultPolicy().bootstrap(64) == 8


def test_merges_match_a_plain_plan(spark):
    rng = np.random.default_rng(8)
    n = rng.integers(1, 120, 60)
    c = rng.standard_normal((60, 4)).astype(np.float32)
    s, cs = stats(spark, [(int(k), 1.0, 0) for k in n]), centroids(spark, c)
    from vectide.functions import sizing

    total = int(n.sum())
    below, above = sizing.merge_below(total), sizing.split_above(total)
    busy = lambda k: k % 7 == 0
    want, taken = [], set()
    for t in sorted((k for k in range(60) if n[k] <= below and n[k] + min(np.delete(n, k)) <= above and not busy(k)), key=lambda k: (n[k], k)):
        d = ((c - c[t]).astype(float) ** 2).sum(1)
        d[t] = np.inf
        h = int(d.argmin())
        if t not in taken and h not in taken and not busy(h) and n[t] + n[h] <= above:
            taken |= {t, h}
            want.append((t, h))
    got = policy.merge_targets(s, cs, 100, busy)
    assert got == want and policy.merge_targets(s, cs, 2, busy) == want[:2] and policy.merge_targets(s, cs, 0) == []
    assert policy.merge_owed(s) and not policy.merge_owed(stats(spark, [(100, 1.0, 0)] * 20))
    assert policy.merge_owed(stats(spark, [(100, 1.0, 0), (0, 0.0, 0)]))
