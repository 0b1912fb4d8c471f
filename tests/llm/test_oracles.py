"""Every query of the subpackage that SQL can express gives the rows of its SQL."""

import os

import duckdb
import pytest

from riskloom.llm.queries import ORACLES, QUERIES


@pytest.mark.parametrize("sf_dir", ["/root/testdata/sf0.001", "/root/testdata/sf0.01"])
@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query(name, sf_dir, spark):
    con = duckdb.connect()
    for f in os.listdir(sf_dir):
        con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM read_parquet('{sf_dir}/{f}')")
    want = con.sql(ORACLES[name])
    got = QUERIES[name](spark, sf_dir)
    cols = sorted(got.columns)
    assert cols == sorted(want.columns)
    assert sorted(repr([dict(zip(want.columns, r, strict=True))[c] for c in cols]) for r in want.fetchall()) == sorted(repr([r[c] for c in cols]) for r in got.collect())
