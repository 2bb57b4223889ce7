import math
import random

from vectide.operators import rank


def hits(spark, rows):
    return spark.createDataFrame(rows, "query_id long, id long, score double")


def test_ties_go_to_smaller_ids(spark):
    assert [r["id"] for r in rank.select(hits(spark, [(0, 2, 1.0), (0, 1, 1.0), (0, 3, 2.0)]), 2).collect()] == [3, 1]


def test_random_ties_and_nan(spark):
    rng = random.Random(3)
    rows = [(q, rng.randrange(12), math.nan if rng.random() < 1 / 6 else float(rng.randrange(8))) for q in range(40) for _ in range(rng.randrange(40))]
    key = lambda r: (math.isnan(r[2]), 0 if math.isnan(r[2]) else -r[2], r[1])
    for k in (0, 1, 5, 100, -3):
        got: dict = {}
        for r in rank.top_k(hits(spark, rows), k, ["query_id"]).orderBy("query_id", "rank").collect():
            got.setdefault(r["query_id"], []).append((r["id"], str(r["score"])))
        want = {q: [(r[1], str(r[2])) for r in sorted((r for r in rows if r[0] == q), key=key)[: max(k, 0)]] for q in {r[0] for r in rows}}
        assert got == {q: w for q, w in want.items() if w}


def test_cutoff(spark):
    df = hits(spark, [(0, 2, 1.0), (1, 2, 1.0), (1, 1, 1.0)])
    assert [(r["query_id"], r["id"]) for r in rank.cutoff(df, 2, ["query_id"]).collect()] == [(1, 2)]


def test_recall(spark):
    make = lambda rows: spark.createDataFrame([(q, k + 1, i) for q, ids in enumerate(rows) for k, i in enumerate(ids)], "query_id long, rank long, id long")
    truth = make([[1, 2, 3, 4], [5, 6, 7, 8]])
    got = make([[3, 1, 9, 4], [5]])
    value = lambda g, k: rank.recall_at_k(g, truth, k).first()[0]
    assert (value(got, 2), value(got, 4), value(make([[1, 1, 1]]), 3), value(make([]), 3), value(got, 0)) == (0.5, 0.5, 1 / 3, 0, 0)
