"""Every query of the catalog against its SQL."""

import duckdb
import pytest
from conftest import DATA

from vectide.plans import catalog

SMALL = DATA / "sf0.001"
TABLES = ("embeddings", "lineitem", "orders", "customer")
QUERIES, SQL = catalog.queries(), catalog.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SMALL}/{t}.parquet'")
    return con


def canonical(df):
    df = df[sorted(df.columns)]
    return df.sort_values(list(df.columns)).reset_index(drop=True)


def _count(table):
    return duckdb.sql(f"SELECT count(*) FROM '{SMALL}/{table}.parquet'").fetchall()[0][0]


def _each_row_once(got):
    rows = _count("embeddings")
    assert len(got) == rows == got["vec_id"].nunique()


def _codes(got):
    _each_row_once(got)
    assert got["ones"].between(8, 56).all() and got["align"].between(0.6, 1).all() and (got["norm"] > 0).all()


def _sizes(got):
    rows = _count("lineitem")
    assert got["count"].sum() == rows and got["cluster_id"].is_unique and (got["mse"] >= 0).all() and len(got) > 500


def _routed(got):
    rows = _count("lineitem")
    assert len(got) == rows and (got["place"] == 1).all() and got["cluster_id"].nunique() > 10


def _halves(got):
    _each_row_once(got)
    sizes = got.groupby(["cluster_id", "side"]).size().unstack(fill_value=0)
    assert (sizes.min(axis=1) >= -(-sizes.sum(axis=1) // 4)).all()


def _clusters(got):
    _each_row_once(got)
    assert got["cluster_id"].nunique() > 4


#: What holds for the queries that SQL can't express.
BY_PROPERTY = {"rabitq_codes": _codes, "kmeans_fit": _clusters, "kmeans_two_level": _sizes, "tree_route": _routed, "balanced_splits": _halves}


@pytest.mark.skipif(not SMALL.exists(), reason="no test tables here")
@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    from vectide.session import ship

    ship(spark)
    got = canonical(QUERIES[name](spark, str(SMALL)).toPandas())
    if name in SQL:
        want = canonical(duck.sql(SQL[name]).df())
        assert list(got.columns) == list(want.columns)
        assert got.astype(str).equals(want.astype(str))
    else:
        BY_PROPERTY[name](got)


def test_sql_has_queries():
    assert set(SQL) <= set(QUERIES) and set(QUERIES) - set(SQL) == set(BY_PROPERTY)
