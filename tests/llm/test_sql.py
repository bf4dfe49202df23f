"""The registered queries against their SQL on the smallest tables."""

import glob
import os

import pytest

from blockloom.llm.catalog import ORACLE_SQL, QUERIES

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
duckdb = pytest.importorskip("duckdb")


@pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no tables")
@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query(spark, name):
    con = duckdb.connect()
    for path in glob.glob(f"{SF_DIR}/*.parquet"):
        table = os.path.basename(path).removesuffix(".parquet")
        con.sql(f"CREATE VIEW {table} AS SELECT * FROM '{path}{'/*.parquet' if os.path.isdir(path) else ''}'")
    want = con.sql(ORACLE_SQL[name])
    got = QUERIES[name](spark, SF_DIR)
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    rows = lambda names, values: sorted((tuple(v[names.index(c)] for c in columns) for v in values), key=repr)
    assert rows(got.columns, map(tuple, got.collect())) == rows(want.columns, want.fetchall())
