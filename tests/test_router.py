import numpy as np
import pytest

from vectide.operators import router
from vectide.sources import wire


def clusters(n, dims=16, seed=7):
    rng = np.random.default_rng(seed)
    return (20 * (np.arange(n) % 64))[:, None] + rng.standard_normal((n, dims))


def brute(q, x, k):
    d = ((x - q) ** 2).sum(1)
    return np.lexsort((np.arange(len(x)), d))[:k].tolist()


def test_example():
    t = router.Tree.build(np.array([[0, 0], [10, 0], [0, 10], [10, 10]]), 2)
    assert t.nearest(np.array([9, 1]), 1) == [1] and t.assign(np.array([9, 1])) == 1


def test_wide_beam_is_exact():
    x = clusters(500)
    t = router.Tree.build(x, 8)
    for q in clusters(20, seed=9):
        assert t.search(q, 10**6, 10) == brute(q, x, 10)


def test_recall_and_copies():
    x = clusters(1000)
    t, u = router.Tree.build(x, 16), router.Tree.build(x, 16).quantise()
    q = clusters(100, seed=9)
    assert sum(t.nearest(v, 8)[:1] == brute(v, x, 1) for v in q) >= 95
    a, b = router.Work(), router.Work()
    assert [t.search(v, 8, 8, a) for v in q] == [u.search(v, 8, 8, b) for v in q]
    assert b.floats < a.floats and b.quantised > 0
    for one in (t, u):
        work, single = router.Work(), router.Work()
        many = one.search_many(q, 8, 8, work)
        assert [[k for k in r if k >= 0] for r in many.tolist()] == [one.search(v, 8, 8, single) for v in q]
        assert work.floats == single.floats or one is u


def test_a_grown_node_is_searched_pair_by_pair():
    x = clusters(200, 8)
    t = router.Tree.build(x, 4)
    for k in range(200, 240):
        t = t.upsert(k, x[3] + 0.001 * k)
    assert max(len(n.leaves) for n in t.nodes) > 32
    for u in (t, t.quantise()):
        q, a, b = clusters(50, 8, seed=5), router.Work(), router.Work()
        many = u.search_many(q, 6, 7, a)
        assert [[k for k in r if k >= 0] for r in many.tolist()] == [u.search(v, 6, 7, b) for v in q]
        assert a.floats == b.floats and a.quantised == b.quantised


def test_grid_ties():
    g = np.random.default_rng(3).integers(0, 4, (300, 3)).astype(float)
    t = router.Tree.build(g, 4)
    for q in g[:20]:
        assert t.search(q, 10**6, 12) == brute(q, g, 12)
        assert t.quantise().search_many(q[None], 1000, 12)[0].tolist() == brute(q, g, 12)


def test_degenerate():
    t = router.Tree.build(np.ones((100, 2)), 4)
    assert len(t.nearest(np.ones(2), 8)) == 8
    assert router.Tree.build(np.zeros((0, 2)), 4).nearest(np.zeros(2), 3) == []
    assert t.nearest(np.ones(3), 3) == [] and t.nearest(np.ones(2), 0) == [] and t.assign(np.ones(3)) == -1
    with pytest.raises(ValueError):
        router.Tree.build(np.array([[np.nan, 1]]), 4)


def test_edits():
    x = clusters(200)
    t = router.Tree.build(x, 8)
    u = t.upsert(5, x[5] + 100).upsert(200, np.full(16, -50.0))
    assert len(t) == 200 and len(u) == 201 and u.height == t.height
    assert u.nearest(np.full(16, -50.0), 1) == [200] and sorted(k for n in u.nodes for k in n.leaves) == list(range(201))
    assert t.search(x[5], 10**6, 1) == [5]
    v = u.truncate(150)
    assert sorted(k for n in v.nodes for k in n.leaves) == list(range(150)) and len(v) == 150
    with pytest.raises(ValueError):
        t.upsert(300, x[0])


def test_two_stage():
    x = clusters(600)
    t = router.Tree.build(x, 16)
    q = clusters(60, seed=11)
    assert sum(t.two_stage(v, 4) == brute(v, x, 1)[0] for v in q) >= 55
    assert all(t.two_stage(v, 10**6) == brute(v, x, 1)[0] for v in q)


def test_tables_and_joins(spark):
    x = clusters(60, 4)
    t = router.Tree.build(x, 4)
    nodes = t.table(spark)
    back = router.Tree.from_table(nodes, 4)
    queries = spark.createDataFrame([(k, [float(v) for v in q]) for k, q in enumerate(clusters(5, 4, seed=2).astype(np.float32))], "query_id long, query array<double>")
    want = {(r["query_id"], k + 1, c) for r in queries.collect() for k, c in enumerate(back.search(np.array(r["query"]), 3, 4))}
    got = {tuple(r) for r in router.beam_search(queries, nodes, 3, 4, t.height).collect()}
    routed = {tuple(r) for r in router.route(queries, t, 4, beam=3).collect()}
    assert got == want == routed
    with pytest.raises(ValueError):
        router.Tree.from_table(nodes.where("leaf_id is null or leaf_id <> 3"), 4)


def test_trees_as_bytes():
    t = router.Tree.build(clusters(100, 4).astype(np.float32), 4).upsert(100, np.full(4, 3.5))
    data = wire.encode_tree(t)
    back = wire.decode_tree(data)
    assert wire.encode_tree(back) == data and back.height == t.height
    for q in clusters(10, 4, seed=3):
        assert back.search(q, 1000, 5) == t.search(q, 1000, 5)
    empty = wire.decode_tree(wire.encode_tree(router.Tree.build(np.zeros((0, 4)), 4)))
    assert len(empty) == 0 and empty.nearest(np.zeros(4), 2) == []
    last = len(data) - 4  # a holder's last cluster
    for bad in (data[:-1], data + b"0", b"DVT\x02" + data[4:], data[:last] + data[last - 4 : last], data[:last] + b"\xff\xff\x00\x00", data[:16] + b"\x01\x00\x00\x00" + data[20:]):
        with pytest.raises(ValueError):
            wire.decode_tree(bad)


def test_work_of_routing(spark):
    x = clusters(400, 8)
    t = router.Tree.build(x, 8)
    q = spark.createDataFrame([(k, [float(v) for v in r]) for k, r in enumerate(clusters(12, 8, seed=4).astype(np.float32))], "query_id long, query array<float>")
    for tree in (t, t.quantise()):
        for r in router.route_work(q, tree, 3, 4).collect():
            work = router.Work()
            own = np.array(q.where(f"query_id = {r['query_id']}").first()["query"])
            assert r["found"] == tree.search(own, 4, 3, work) and (r["floats"], r["quantised"]) == (work.floats, work.quantised)


def test_block_trees():
    x = clusters(300)
    t, b = router.Tree.build(x.astype(np.float32), 8), router.BlockTree(x, 8, router.FloatBlock)
    for q in clusters(20, seed=4):
        assert b.search(q, 10**6, 5) == t.search(q, 10**6, 5)
    with pytest.raises(ValueError):
        b.search(np.zeros(3), 4, 4)
    rng = np.random.default_rng(2)
    leaves = 3 * rng.standard_normal((32, 64))[np.arange(1024) % 32] + rng.standard_normal((1024, 64))
    c = router.BlockTree(leaves, 16, router.CodeBlock)
    q = 3 * rng.standard_normal((40, 64)) / 3 + leaves[:40]
    assert np.mean([len(set(brute(v, leaves, 10)) & set(c.search(v, 64, 40))) / 10 for v in q]) >= 0.9
