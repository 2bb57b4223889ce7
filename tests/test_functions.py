import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from vectide.functions import codec, sizing
from vectide.functions import vectors as V


def test_metric_names():
    assert [V.parse_metric(m) for m in ("l2", "cosine", "ip")] == ["l2", "cosine", "ip"]
    for bad in ("", "L2", "dot"):
        with pytest.raises(ValueError):
            V.parse_metric(bad)


def test_scores(spark):
    row = spark.createDataFrame([([1.0, 2.0, 2.0], [2.0, 0.0, 1.0], [0.0, 0.0, 0.0])], "a array<float>, b array<float>, z array<float>")
    got = row.select(V.dot("a", "b"), V.l2_sq("a", "b"), V.cosine("a", "b"), V.cosine("a", "z"), V.norm("a"), V.score("l2", "a", "b"), V.normalize("a"), V.normalize("z"), V.add("a", "b"), V.scale("a", 2)).first()
    assert list(got[:6]) == [4.0, 6.0, 4 / math.sqrt(45), 0.0, 3.0, -6.0]
    assert got[6] == [1 / 3, 2 / 3, 2 / 3] and got[7] == [0.0] * 3 and got[8] == [3.0, 2.0, 3.0] and got[9] == [2.0, 4.0, 4.0]


def test_numpy_twin_agrees(spark, vectors):
    x = np.random.default_rng(1).standard_normal((20, 33)).astype(np.float32)
    for metric in V.METRICS:
        q = F.array(*[F.lit(float(v)) for v in x[0]])
        got = [r[0] for r in vectors(x).orderBy("vec_id").select(V.score(metric, q, "embedding")).collect()]
        assert np.allclose(got, V.np_scores(metric, x[:1], x)[0], atol=1e-9)


def test_bad_vectors(spark):
    rows = [(0, [1.0, 2.0]), (1, [1.0, float("nan")]), (2, [float("inf"), 0.0]), (3, [1.0]), (4, [None, 1.0]), (5, [3e38, 3e38]), (6, None)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = {r[0]: r[1:] for r in df.select("vec_id", V.non_finite("embedding"), V.usable("embedding", 2)).collect()}
    assert [got[k][0] for k in range(5)] == [-1, 1, 0, -1, 0]
    assert [got[k][1] for k in range(7)] == [True, False, False, False, False, False, False]
    assert V.validated(df.where("vec_id = 0"), 2).count() == 1
    with pytest.raises(Exception, match="bad vector"):
        V.validated(df, 2).collect()
    assert V.row_count(df.where("vec_id < 2"), 2) == 2
    with pytest.raises(ValueError):
        V.row_count(df, 2)
    with pytest.raises(ValueError):
        V.matrix(df.where("vec_id in (0, 3)").toArrow()["embedding"])


# fixed values: rows, clusters and probes of the sizing curve
@pytest.mark.parametrize(("rows", "k", "nprobe"), [(64, 8, 8), (256, 16, 16), (20_000, 103, 25), (100_000, 511, 127), (400_000, 2041, 510), (1_000_000, 5103, 511), (10_000_000, 51_021, 1594), (100_000_000, 510_205, 15_943)])
def test_sizing(rows, k, nprobe):
    assert (sizing.hood_k(rows), min(sizing.hood_k(rows), sizing.default_nprobe(k))) == (k, nprobe)


def test_sizing_edges(spark):
    assert sizing.hood_k(0) == 1 and sizing.hood_k(1) == 1 and sizing.split_above(1_000_000) == 273
    assert sizing.sample_size(1) == 4096 and sizing.sample_size(1000) == 32_000 and sizing.sample_size_for(1000, 128, 1) == 1
    n = [0, 1, 3, 63, 272, 3136, 10**6]
    df = spark.createDataFrame([(x,) for x in n], "n long")
    c = F.col("n")
    got = df.select("n", sizing.hood_k_col(c), sizing.split_above_col(c), sizing.merge_below_col(c), sizing.default_nprobe_col(sizing.hood_k_col(c))).collect()
    assert [tuple(r) for r in got] == [(x, sizing.hood_k(x), sizing.split_above(x), sizing.merge_below(x), sizing.default_nprobe(sizing.hood_k(x))) for x in n]


def test_half_floats(spark):
    rng = np.random.default_rng(5)
    x = np.concatenate([rng.standard_normal(300) * 10.0 ** rng.integers(-9, 5, 300), 2.0 ** np.arange(-26, 16), 1 + np.arange(8) / 2048, [0.0, 65519.0, 65520.0, -7e4]]).astype(np.float32)
    df = spark.createDataFrame([(0, x.tolist()), (1, None), (2, []), (3, [7.0])], "vec_id long, embedding array<float>")
    got = {r["vec_id"]: r["decoded"] for r in codec.from_f16(codec.with_f16(df.coalesce(1))).collect()}
    with np.errstate(over="ignore"):
        want = x.astype(np.float16).astype(np.float32)
    assert np.array_equal(got[0], want) and got[1] is None and got[2] == [] and got[3] == [7.0]
    assert np.array_equal(codec.round_f16(x), want)
    assert np.array_equal(df.where("vec_id = 0").select(F.transform("embedding", codec.half_of)).first()[0], want)


def test_float_blocks(vectors):
    x = np.random.default_rng(6).standard_normal((20, 8)).astype(np.float32)
    for scalar in ("f32", "f16"):
        got = codec.dense_blocks(vectors(x, block=[k % 3 for k in range(20)]), "block", scalar).orderBy("vec_id").select("scale", "offset", codec.dense_decode().alias("r")).collect()
        assert np.array_equal([r["r"] for r in got], codec.round_f16(x) if scalar == "f16" else x) and {(r["scale"], r["offset"]) for r in got} == {(1.0, 0.0)}
    assert codec.dense_blocks(vectors([[7e4, 1.0]], block=[0]), "block", "f32").select(codec.dense_decode()).first()[0] == [7e4, 1.0]
    for scalar, bad in (("f16", [[7e4, 1.0]]), ("f16", [[1.0], [1.0, 2.0]]), ("f32", [[1.0, float("inf")]])):
        with pytest.raises(Exception, match="overflow"):
            codec.dense_blocks(vectors(bad, block=[0] * len(bad)), "block", scalar).collect()


def test_widths(spark):
    row = spark.createDataFrame([([1.0, 2.0], [1.0], None)], "a array<float>, b array<float>, n array<float>")
    assert row.select(V.score("l2", "a", "n")).first()[0] is None and row.select(V.l2_sq("a", "b")).first()[0] is None
    with pytest.raises(Exception, match="different widths"):
        row.select(V.score("ip", "a", "b")).collect()
    got = V.float_rows(spark.createDataFrame([(0, [1, -2])], "vec_id long, embedding array<smallint>"), dims=2)
    assert got.schema["embedding"].dataType.simpleString() == "array<float>" and got.first()["embedding"] == [1.0, -2.0]
    with pytest.raises(Exception, match="bad vector"):
        V.float_rows(spark.createDataFrame([(0, [1, -2])], "vec_id long, embedding array<smallint>"), dims=3).collect()


def test_bytes(spark):
    x = [-200.0, 127.4, 127.5, 2.5, -2.5, 0.49, float("nan"), -0.0]
    df = spark.createDataFrame([(x,)], "v array<float>")
    assert df.select(codec.round_i8("v")).first()[0] == [-128, 127, 127, 3, -3, 0, 0, 0]


@pytest.mark.parametrize(("scalar", "low", "high"), [("i8", -128, 127), ("u8", 0, 255)])
def test_affine_blocks(vectors, scalar, low, high):
    """A block that spans the type's range has scale 1 and offset 0, so its codes are the elements, rounded, halves away from zero."""
    rng = np.random.default_rng(11)
    x = np.concatenate([rng.uniform(low, high, (6, 9)), np.floor(rng.uniform(low, high - 1, (3, 9))) + 0.5])
    x[0, 0], x[1, 1] = low, high
    x = x.astype(np.float32)
    got = codec.dense_blocks(vectors(x, block=[0] * 9), "block", scalar).orderBy("vec_id").collect()
    want = np.sign(x) * np.floor(np.abs(x.astype(float)) + 0.5)
    assert np.array_equal([r["codes"] for r in got], np.clip(want, low, high)) and got[0]["scale"] == 1
    # any other span is mapped onto the range
    y = (3 + 0.01 * x).astype(np.float32)
    coded = codec.dense_blocks(vectors(y, block=[0] * 9), "block", scalar).orderBy("vec_id")
    codes = np.array([r["codes"] for r in coded.collect()])
    back = np.array([r[0] for r in coded.select(codec.dense_decode()).collect()])
    assert codes.min() == low and codes.max() == high and np.abs(back - y).max() <= 0.51 * (float(y.max()) - float(y.min())) / 255


def test_affine_edges(vectors):
    flat = codec.dense_blocks(vectors([[5.25] * 8] * 2, block=[0, 0]), "block").select(codec.dense_decode()).collect()
    assert [r[0] for r in flat] == [[5.25] * 8] * 2
    for bad in ([[1.0, float("nan")]], [[1.0], [1.0, 2.0]]):
        with pytest.raises(Exception, match="finite"):
            codec.dense_blocks(vectors(bad, block=[0] * len(bad)), "block").collect()


def test_affine_scores(vectors):
    x = np.random.default_rng(2).standard_normal((30, 16))
    coded = codec.dense_blocks(vectors(x, block=[0] * 30), "block").withColumn("r", codec.dense_decode())
    q = F.array(*[F.lit(float(v)) for v in x[0]])
    for metric in V.METRICS:
        got = coded.orderBy("vec_id").select("r", codec.dense_score(metric, q, "r").alias("s")).collect()
        r = np.array([g["r"] for g in got])
        d = {"l2": -((r - x[0]) ** 2).sum(1), "ip": r @ x[0], "cosine": r @ x[0] / np.linalg.norm(r, axis=1) / np.linalg.norm(x[0])}[metric]
        assert np.allclose([g["s"] for g in got], d, atol=1e-9)
