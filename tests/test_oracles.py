"""Every query with SQL gives the rows of that SQL."""

import math
import os

import duckdb
import pytest

from riskloom.operators import knn
from riskloom.plans.score import event_index
from riskloom.queries import ORACLES, QUERIES

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for f in os.listdir(SF):
        c.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM read_parquet('{SF}/{f}')")
    return c


def plain(x):
    if isinstance(x, float):
        return None if math.isnan(x) else round(x, 9)
    return x


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query(name, spark, con):
    want = con.sql(ORACLES[name])
    got = QUERIES[name](spark, SF)
    assert sorted(got.columns) == sorted(want.columns)
    names = {"bigint": "BIGINT", "int": "INTEGER", "smallint": "SMALLINT", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN"}
    assert {c: names[t] for c, t in got.dtypes} == dict(zip(want.columns, map(str, want.types), strict=True))
    cols = sorted(got.columns)
    left = sorted(repr([plain(dict(zip(want.columns, r, strict=True))[c]) for c in cols]) for r in want.fetchall())
    right = sorted(repr([plain(r[c]) for c in cols]) for r in got.collect())
    assert left == right
    assert left


def test_every_query_has_sql():
    assert not set(QUERIES) - set(ORACLES)


def test_recall_of_kmeans(spark):
    queries, index = event_index(spark, SF, "kmeans")
    r = knn.recall(knn.search_ivf(queries, *index), knn.search_exact(queries, *index)).first()
    assert r.queries == spark.read.parquet(f"{SF}/events.parquet").filter("event_id % 10 = 0").count() and r.recall > 0.9
