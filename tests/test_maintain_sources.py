import struct

import numpy as np
import pytest

from vectide.operators import maintain
from vectide.sources import bigann, wire
from vectide.streaming.ingest import ingest


def slots(spark, x):
    return spark.createDataFrame([(k, [float(v) for v in r]) for k, r in enumerate(x)], "slot_id long, centroid array<float>")


def log(spark, entries):
    return spark.createDataFrame([(k + 1, s, v and [float(a) for a in v]) for k, (s, v) in enumerate(entries)], "seq long, slot_id long, vec array<float>")


def rows_of(df):
    return [tuple(r["centroid"]) for r in df.orderBy("slot_id").collect()]


def test_deltas(spark):
    base = slots(spark, [(1, 2), (3, 4), (5, 6)])
    d1, d2 = log(spark, [(1, (30, 40)), (3, (7, 8))]), log(spark, [(4, (9, 10))])
    assert rows_of(maintain.apply_deltas(base, d1, d2)) == [(1, 2), (30, 40), (5, 6), (7, 8), (9, 10)]
    cut = log(spark, [(1, None), (1, (0, 0))])
    assert rows_of(maintain.apply_deltas(base, d1, cut)) == [(1, 2), (0, 0)]
    for bad in (log(spark, [(5, (9, 10))]), log(spark, [(4, None)])):
        with pytest.raises(ValueError):
            maintain.apply_deltas(base, d1 if bad is not d1 else d1, bad) if bad.first()["vec"] else maintain.apply_deltas(base, bad)
    assert rows_of(maintain.apply_deltas(base)) == rows_of(base)


def test_delta_round_trip_and_limits(spark):
    x = np.arange(80, dtype=float).reshape(40, 2)
    prev = slots(spark, x)
    y = np.vstack([x[:5], [[-1, -1]], x[6:], [[7, 7]]])
    d = maintain.delta(prev, slots(spark, y), 2)
    assert d.count() == 2 and rows_of(maintain.apply_deltas(prev, d)) == [tuple(r) for r in y]
    z = np.vstack([[x[39]], x[1:39]])  # the last slot moved into the first
    d = maintain.delta(prev, slots(spark, z), 1)
    assert [r["slot_id"] for r in d.orderBy("seq").collect()] == [0, 39] and rows_of(maintain.apply_deltas(prev, d)) == [tuple(r) for r in z]
    assert maintain.delta(prev, slots(spark, x[1:]), 2) is None and maintain.delta(prev.limit(0), prev, 99) is None


def test_layout_changes(spark, vectors):
    rows = vectors([[0, 0], [1, 0], [9, 0], [10, 0], [5, 5]], cluster_id=[0, 0, 1, 1, 2])
    c = slots(spark, [(0, 0), (10, 0), (5, 5)])
    kept, moved = maintain.drop_slot(c, rows, 0)
    assert rows_of(kept) == [(5, 5), (10, 0)]
    assert {r["vec_id"]: r["cluster_id"] for r in moved.collect()} == {0: 0, 1: 0, 2: 1, 3: 1, 4: 0}
    sides = spark.createDataFrame([(1, 2, 0), (1, 3, 1)], "cluster_id long, vec_id long, side long")
    assert {r["vec_id"]: r["cluster_id"] for r in maintain.apply_split(rows, sides, 1, 3).collect()}[3] == 3
    assert {r["cluster_id"] for r in maintain.apply_merges(rows, [(2, 0)]).collect()} == {0, 1}
    wanted = spark.createDataFrame([(0, 3), (1, 3), (2, 0)], "position long, vec_id long")
    assert [r["vec_id"] for r in maintain.select_rows(rows, wanted).collect()] == [3, 3, 0]


@pytest.mark.parametrize(("suffix", "kind"), [(".u8bin", "u1"), (".i8bin", "i1"), (".fbin", "<f4")])
def test_benchmark_files(spark, tmp_path, suffix, kind):
    bigann.register(spark)
    x = np.arange(8).reshape(4, 2).astype(kind)
    path = str(tmp_path / f"v{suffix}")
    bigann.write(path, x)
    got = spark.read.format("bigann").option("part_bytes", 1).load(path).orderBy("vec_id").collect()
    assert [(r[0], r[1]) for r in got] == [(k, row.astype(float).tolist()) for k, row in enumerate(x)]
    data = open(path, "rb").read()
    for cut in (1, x.itemsize * 2):
        open(path, "wb").write(data[:-cut])
        with pytest.raises(Exception, match="ends within"):
            spark.read.format("bigann").load(path).collect()


def test_benchmark_headers(spark, tmp_path):
    bigann.register(spark)
    for head in (b"", struct.pack("<II", 0, 2), struct.pack("<II", 1 << 31, 2), struct.pack("<II", 4, 0), struct.pack("<II", 4, 5000)):
        p = tmp_path / "h.fbin"
        p.write_bytes(head)
        with pytest.raises(ValueError):
            bigann.read_header(str(p))
    with pytest.raises(ValueError):
        bigann._kind("x.bin")
    p = tmp_path / "t.ibin"
    p.write_bytes(struct.pack("<II6i6f", 2, 3, *range(6), *[0.0] * 6))
    bigann.write_truth(again := str(p.with_name("again.ibin")), np.array([[3 * q + k for k in range(3)] for q in (0, 1)]))
    for path in (again, "file://" + again):
        assert sorted(tuple(r) for r in spark.read.format("bigann").load(path).collect()) == [(q, k + 1, 3 * q + k) for q in (0, 1) for k in range(3)]
    assert sorted(tuple(r) for r in spark.read.format("bigann").load(str(p)).collect()) == [(q, k + 1, 3 * q + k) for q in (0, 1) for k in range(3)]
    p.write_bytes(struct.pack("<II6i", 2, 3, *range(6)))
    with pytest.raises(Exception, match="shorter"):
        spark.read.format("bigann").load(str(p)).collect()


def test_wire_formats():
    x = np.arange(6, dtype=np.float32).reshape(3, 2)
    data = wire.encode_centroids(x)
    assert np.array_equal(wire.decode_centroids(data, 2), x)
    for bad in (data[:-1], data + b"\0", b"\1"):
        with pytest.raises(ValueError):
            wire.decode_centroids(bad, 2)
    with pytest.raises(ValueError):
        wire.decode_centroids(data, 0)
    entries = [(1, x[0]), (3, None)]
    data = wire.encode_delta(entries, 2)
    got = wire.decode_delta(data, 2)
    assert got[0][0] == 1 and np.array_equal(got[0][1], x[0]) and got[1] == (3, None)
    for bad in (data[:-1], data + b"\0", b"XXXX" + data[4:], data[:9]):
        with pytest.raises(ValueError):
            wire.decode_delta(bad, 2)
    with pytest.raises(ValueError):
        wire.decode_delta(data, 3)


def test_stream(spark, vectors, tmp_path):
    vectors([[0, 0], [10, 0], [0, 1]]).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("vec_id long, embedding array<float>").parquet(str(tmp_path / "in"))
    for _ in range(2):  # the second run has nothing new to read
        ingest(stream, np.array([[0.0, 0.0], [10.0, 0.0]]), str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
    got = spark.read.parquet(str(tmp_path / "out"))
    assert sorted((r["vec_id"], r["cluster_id"]) for r in got.collect()) == [(0, 0), (1, 1), (2, 0)]
