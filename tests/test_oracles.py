"""Every query with oracle SQL equals DuckDB's result on the smallest tables."""

import math
import os

import duckdb
import pandas as pd
import pytest

from chronolith.plans import registry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
QUERIES, SQL = registry.queries(), registry.oracle_sql()
#: Short series make some conditions empty at this size; the rest of the registry runs at any size.
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(df):
    def value(v):
        v = v.item() if hasattr(v, "item") else v
        if v is None or v is pd.NA or v != v:
            return None
        return round(v, 4) if isinstance(v, float) else v

    rows = [tuple(value(v) for v in r) for r in df[sorted(df.columns)].astype(object).itertuples(index=False)]
    return sorted(rows, key=lambda r: [(v is None, str(v) if not isinstance(v, (int, float)) else "", v if isinstance(v, (int, float)) else 0) for v in r])


@pytest.mark.parametrize("name", sorted(SQL))
def test_equals_oracle(spark, db, name):
    got, want = QUERIES[name](spark, SF).toPandas(), db.execute(SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    a, b = plain(got), plain(want)
    assert len(a) == len(b)
    for x, y in zip(a, b):
        assert all(u == v or (isinstance(u, (int, float)) and isinstance(v, (int, float)) and math.isclose(u, v, rel_tol=1e-4, abs_tol=2e-4)) for u, v in zip(x, y)), (x, y)
