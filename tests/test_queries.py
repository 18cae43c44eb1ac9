"""Every registered query with SQL gives the rows that DuckDB gives."""

import glob
import os

import duckdb
import pytest

from spindrift.plans import registry

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def sql():
    con = duckdb.connect()
    for path in glob.glob(f"{SF}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


def plain(v):
    return round(v, 9) if isinstance(v, float) else v


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, sql, name):
    df = registry.QUERIES[name](spark, SF)
    rows = df.collect()
    if name not in registry.ORACLES:
        assert rows
        return
    found = sql.sql(registry.ORACLES[name])
    names = sorted(df.columns)
    assert sorted(found.columns) == names
    order = [found.columns.index(c) for c in names]
    want = sorted((tuple(plain(r[i]) for i in order) for r in found.fetchall()), key=repr)
    assert sorted((tuple(plain(r[c]) for c in names) for r in rows), key=repr) == want
