"""Registered queries against their SQL on the smallest tables."""

import os

import duckdb
import pytest

import __spark_entry__ as entry
from cloneweave.plans.queries import ORACLES

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no tables here")


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_oracle(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    cur = con.execute(ORACLES[name])
    names = [d[0] for d in cur.description]
    want = sorted(map(repr, cur.fetchall()))
    got = entry.queries()[name](spark, SF)
    assert sorted(got.columns) == sorted(names)
    assert sorted(repr(tuple(r)) for r in got.select(*names).collect()) == want


def test_entry(spark):
    assert entry.entry(spark).count() > 0
