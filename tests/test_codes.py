import numpy as np
import pytest
from pyspark.sql import functions as F

from vectide.functions.vectors import admitted, decode_row
from vectide.operators import assign, rabitq, rank, search


def gaussian(n, d, seed=5):
    return np.random.default_rng(seed).standard_normal((n, d))


@pytest.mark.parametrize("dims", [1, 7, 33, 64, 100, 130])
def test_rotations(dims):
    r = rabitq.Rotation(9, dims)
    x = gaussian(10, dims)
    y = r.apply(x)
    assert np.allclose((y**2).sum(1), (x**2).sum(1)) and np.allclose(r.undo(y), x) and np.array_equal(rabitq.Rotation(9, dims).apply(x), y)
    if dims == 1:
        assert np.array_equal(x, y)


def test_seeds():
    assert rabitq.seed_of("a", "b") == rabitq.seed_of("a/b") != rabitq.seed_of("ab") and rabitq.seed_of("") == 0xCBF29CE484222325


@pytest.mark.parametrize("metric", ["l2", "cosine"])
@pytest.mark.parametrize("shared", [False, True])
@pytest.mark.parametrize("bits", [0, 3])
def test_estimates_and_bounds(metric, shared, bits):
    x = gaussian(2000, 128)
    codes = rabitq.encode(x, 3, metric, bits)
    off, over, errors = [], [], []
    for q in gaussian(20, 128, seed=6):
        est, bound = rabitq.score(codes, rabitq.Query(q, metric, 3, shared=shared))
        true = -((x - q) ** 2).sum(1) if metric == "l2" else x @ q / np.linalg.norm(x, axis=1) / np.linalg.norm(q)
        off.append((est - true).mean())
        over.append((true > bound).mean())
        errors.append(np.abs(est - true).mean())
    spread = np.std([e for e in off]) + 1e-9
    assert abs(np.mean(off)) < 4 * spread + 0.01 * np.mean(errors) and np.mean(over) < 4 * 6.2e-3


def test_extended_codes_are_closer():
    x = gaussian(800, 64)
    q = gaussian(1, 64, seed=8)[0]
    true = -((x - q) ** 2).sum(1)
    error = [np.abs(rabitq.score(rabitq.encode(x, 3, "l2", b), rabitq.Query(q, "l2", 3))[0] - true).mean() for b in (0, 1, 3)]
    assert error[1] < 0.7 * error[0] and error[2] < 0.5 * error[1]


def test_odd_rows():
    x = np.vstack([np.zeros(33), gaussian(40, 33)])
    codes = rabitq.encode(x, 3, "cosine")
    est, bound = rabitq.score(codes, rabitq.Query(x[1], "cosine", 3))
    assert codes.align[0] == -1 and est[0] == 0 == bound[0] and bound[1] >= 1 - 1e-9
    same = rabitq.encode(np.ones((5, 8)), 3)
    assert (same.norm == 0).all() and np.allclose(rabitq.score(same, rabitq.Query(np.zeros(8), "l2", 3))[0], -8)
    assert len(rabitq.encode(np.zeros((0, 8)), 3, dims=8)) == 0
    for q in (rabitq.Query(x[1], "l2", 3), rabitq.Query(x[1][:9], "cosine", 3), rabitq.Query(x[1], "cosine", 4)):
        est, bound = rabitq.score(codes, q)
        assert (est == 0).all() and np.isinf(bound).all()
    assert (rabitq.score(codes, rabitq.Query(np.zeros(33), "cosine", 3))[1] == 0).all()
    assert np.isinf(rabitq.score(codes, rabitq.Query(x[1], "cosine", 3, exact=True))[1]).all()
    for bad in (("ip", 8, 3, 0), ("l2", 8, 0, 0), ("l2", 8, 3, 7), ("l2", 0, 3, 0)):
        with pytest.raises(ValueError):
            rabitq.check_frame(*bad)


@pytest.mark.parametrize("shared", [False, True])
def test_lazy_bounds_decide_alike(shared):
    x = gaussian(600, 48) * np.linspace(0.1, 3, 600)[:, None]
    codes = rabitq.encode(x, 3)
    for q in gaussian(8, 48, seed=2):
        query = rabitq.Query(q, "l2", 3, shared=shared)
        bound = rabitq.score(codes, query)[1]
        for cut in np.quantile(bound, [0.01, 0.5, 0.99, 1]):
            assert np.array_equal(rabitq.may_reach(codes, query, cut), bound >= cut)


@pytest.mark.parametrize("metric", ["l2", "cosine"])
@pytest.mark.parametrize("bits", [0, 3])
def test_sure_bounds_are_never_exceeded(metric, bits):
    x = np.vstack([gaussian(3000, 24) * np.linspace(0.1, 3, 3000)[:, None], np.zeros((1, 24))])
    codes = rabitq.encode(x, 3, metric, bits)
    for q in [*gaussian(30, 24, seed=2), x[5]]:
        query = rabitq.Query(q, metric, 3, sure=True)
        n = np.linalg.norm(x, axis=1)
        true = -((x - q) ** 2).sum(1) if metric == "l2" else np.divide(x @ q, n * np.linalg.norm(q), out=np.zeros(len(x)), where=n > 0)
        bound = rabitq.score(codes, query)[1]
        assert (bound >= true).all() and np.array_equal(rabitq.may_reach(codes, query, np.median(true)), bound >= np.median(true))
        assert (bound < np.sort(true)[-10]).any()


def test_two_passes_miss_no_row(spark, vectors):
    """Queries that lie where the codes of their nearest rows err most: estimates and likely bounds miss these rows, the default doesn't."""
    x = gaussian(600, 64).astype(np.float32)
    rows, mean = vectors(x, cluster_id=[0] * 600), x.astype(float).mean(0)
    turn, queries = rabitq.rotation(11, 64), []
    for k in range(5):
        norm = np.linalg.norm(x[k] - mean)
        u = (x[k] - mean) / norm
        code = turn.undo(np.where(turn.apply(u) >= 0, 1, -1) / 8)
        off = u - (u @ code) * code
        queries.append((k, [float(v) for v in mean + norm * off / np.linalg.norm(off)]))
    queries = spark.createDataFrame(queries, "query_id long, query array<float>")
    frames = rabitq.frames_of(rows, 11)
    key = lambda df: sorted((r["query_id"], r["rank"], r["id"]) for r in df.collect())
    want = key(search.clustered(rows, frames, queries, 3, 1))
    assert {(k, 1, k) for k in range(5)} <= set(want) and key(search.two_pass(rows, rabitq.codes_of(rows, frames), frames, frames, queries, 3, 1)) == want


def test_select_and_append():
    x = gaussian(50, 20)
    codes = rabitq.encode(x[:30], 3, "l2", 2)
    more = codes.append(x[30:])
    q = rabitq.Query(x[0], "l2", 3)
    assert len(more) == 50 and np.array_equal(rabitq.score(more, q)[0][:30], rabitq.score(codes, q)[0])
    again = more.select([4, 4, 40])
    assert np.array_equal(rabitq.score(again, q)[0], rabitq.score(more, q)[0][[4, 4, 40]])
    with pytest.raises(IndexError):
        codes.select([30])


@pytest.mark.parametrize("metric", ["l2", "cosine"])
def test_pipeline(spark, vectors, metric):
    """Rows, clusters, codes, two passes: exact bounds give the exact answer of the probed clusters."""
    rng = np.random.default_rng(1)
    x = (rng.standard_normal((5, 16))[np.arange(200) % 5] + 0.1 * rng.standard_normal((200, 16))).clip(-1, 1).astype(np.float32)
    c = x[:5]
    rows = assign.assign(vectors(x), np.arange(5), c)
    sets = spark.createDataFrame([(k, [float(v) for v in r]) for k, r in enumerate(c)], "cluster_id long, centroid array<float>")
    queries = spark.createDataFrame([(k, [float(v) for v in x[k]]) for k in range(0, 200, 40)], "query_id long, query array<float>")
    frames = rabitq.frames_of(rows, 11, metric, 2)
    codes = rabitq.codes_of(rows, frames).cache()
    key = lambda df: sorted((r["query_id"], r["rank"], r["id"]) for r in df.collect())
    exact = search.exact(rows, queries, 5, metric)
    assert key(search.two_pass(rows, codes, frames, sets, queries, 5, 5, metric, exact_bounds=True)) == key(exact)
    scan = search.exact_scan(rows, np.arange(0, 200, 40), x[::40], 5, metric)
    assert key(scan) == key(exact)
    assert rabitq.checked_codes(codes, frames).select(F.sum("norm")).first()[0] > 0 and rabitq.retained_bytes(codes).first()[0] == 200 * (8 + 16 + 16)
    for bad in ("norm * -1 as norm, align", "norm, align * 3 as align", "float('nan') as norm, align"):
        with pytest.raises(Exception, match="no encoder"):
            rabitq.checked_codes(codes.selectExpr("cluster_id", "bits", *bad.split(", ")), frames).collect()
    with pytest.raises(Exception, match="no encoder"):
        rabitq.checked_codes(codes.withColumn("bits", F.array(F.lit(1 << 20))), frames).collect()
    probed = search.clustered(rows, sets, queries, 5, 2, metric)
    assert key(search.two_pass(rows, codes, frames, sets, queries, 5, 2, metric, exact_bounds=True)) == key(probed)
    got = search.two_pass(rows, codes, frames, sets, queries, 5, 5, metric)
    assert rank.recall_at_k(got, exact, 5).first()[0] >= 0.9


def test_bounds_are_made_for_few_rows():
    x = gaussian(4000, 64) * np.linspace(0.2, 3, 4000)[:, None]
    codes = rabitq.encode(x, 3)
    q = rabitq.Query(x[10], "l2", 3)
    cut = np.sort(rabitq.score(codes, q)[0])[-10]
    work = rabitq.Scoring(codes, q)
    kept = rabitq.may_reach(codes, q, cut, work)
    assert np.array_equal(kept, rabitq.score(codes, q)[1] >= cut) and 0 < work.bounded < 0.6 * len(codes)


@pytest.mark.parametrize(("metric", "bits"), [("l2", 0), ("cosine", 0), ("l2", 3), ("cosine", 2)])
def test_columns_as_bytes(metric, bits):
    x = np.vstack([np.zeros(70), gaussian(20, 70)])
    codes = rabitq.encode(x, 12345, metric, bits)
    data = rabitq.encode_column(codes)
    back = rabitq.decode_column(data)
    q = rabitq.Query(x[3], metric, 12345)
    assert all(np.allclose(a, b) for a, b in zip(rabitq.score(codes, q), rabitq.score(back, q), strict=True)) and rabitq.encode_column(back) == data
    head = 22 + 8 * 70
    broken = [data[:-1], data + b"0", b"XXXX" + data[4:], data[:4] + b"\x07" + data[5:], data[: head + 8] + np.array([-1.0]).tobytes() + data[head + 16 :], data[: head + 8] + np.array([np.nan]).tobytes() + data[head + 16 :]]
    words = head + 16 * 21
    broken.append(data[: words + 31] + b"\xff" + data[words + 32 :])  # bits beyond the 70th
    if bits:
        levels = words + 16 * 21
        broken.append(data[: levels + 70] + b"\x7f" * 70 + data[levels + 140 :])
    for bad in broken:
        with pytest.raises(ValueError):
            rabitq.decode_column(bad)
    assert len(rabitq.decode_column(rabitq.encode_column(rabitq.encode(np.zeros((0, 8)), 3, dims=8)))) == 0


def test_wrong_codes_fail_where_they_are_read(spark, vectors):
    x = gaussian(40, 16).astype(np.float32)
    rows = vectors(x, cluster_id=[k % 2 for k in range(40)])
    frames = rabitq.frames_of(rows, 11, ex_bits=2)
    codes = rabitq.codes_of(rows, frames)
    chosen = spark.createDataFrame([(0, 0, [float(v) for v in x[0]]), (1, 0, [float(v) for v in x[0]])], "cluster_id long, query_id long, query array<float>")
    assert search.estimates(codes, frames, chosen).count() == 40
    assert search.estimates(codes, frames, chosen, most=3).count() == 6
    for bad in (("transform(ex, y -> 100Y) as ex", "ex_norm", "ex_align"), ("ex", "ex_norm * 2 as ex_norm", "ex_align"), ("ex", "ex_norm", "1.5D as ex_align")):
        wrong = codes.selectExpr("cluster_id", "vec_id", "bits", "norm", "align", *bad)
        with pytest.raises(Exception, match="no encoder"):
            search.estimates(wrong, frames, chosen).collect()
    with pytest.raises(Exception, match="no encoder"):
        rabitq.checked_codes(codes.withColumn("ex", F.transform("ex", lambda y: F.lit(100).cast("tinyint"))), frames).collect()
    half = rows.where("vec_id < 20")
    assert rabitq.append_codes(rabitq.codes_of(half, frames), rows.where("vec_id >= 20"), frames).count() == 40


def test_queries_of_another_width_fail(spark, vectors):
    rows = vectors(gaussian(10, 4).astype(np.float32))
    odd = rows.unionByName(spark.createDataFrame([(99, [1.0, 2.0, 3.0])], "vec_id long, embedding array<float>"))
    q = spark.createDataFrame([(0, [1.0, 2.0, 3.0, 4.0])], "query_id long, query array<float>")
    with pytest.raises(Exception, match="different widths"):
        search.exact(odd, q, 3).collect()
    with pytest.raises(Exception, match="bad vector"):
        admitted(q, 5).collect()
    assert decode_row(rows, 3) == pytest.approx(gaussian(10, 4)[3]) and search.exact(rows, admitted(q, 4), 3).count() == 3
    with pytest.raises(IndexError):
        decode_row(rows, 50)
