import os

import duckdb
import pytest

import __spark_entry__ as contract
from workload.queries import ORACLES, QUERIES

DATA = "/root/testdata/sf0.001"


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLES)
    assert set(QUERIES) <= set(contract.queries()) and set(contract.oracle_sql()) <= set(contract.queries())


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables here")
def test_flagship_agrees_with_its_sql(spark):
    got = contract.entry(spark).collect()
    db = duckdb.connect()
    for name in ("orders", "customer"):
        db.execute(f"CREATE VIEW {name} AS SELECT * FROM '{DATA}/{name}.parquet'")
    want = db.sql(contract.oracle_sql()["upcoming_listing"])
    columns = sorted(want.columns)
    key = lambda row: tuple(str(v) for v in row)
    assert sorted((tuple(r[c] for c in columns) for r in got), key=key) == sorted(
        want.select(*columns).fetchall(), key=key)
