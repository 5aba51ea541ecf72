"""Hourly queries on prices of 0, and scores at the ends of intervals, equal their SQL."""

import math
import os

import duckdb
import numpy as np
import pandas as pd
import pytest

from chronolith.functions.exprs import libm_ln
from chronolith.operators import features
from chronolith.plans import registry


@pytest.fixture(scope="module")
def tables(tmp_path_factory):
    """Ten days of hours of two symbols; hours whose low, open, close and only price is 0."""
    rng = np.random.default_rng(5)
    path = tmp_path_factory.mktemp("odd")
    minute = np.arange(10 * 24 * 3)
    start = pd.Timestamp("2024-01-01")
    parts = []
    for k, name in enumerate(("click", "view")):
        value = np.exp(rng.normal(3, 1, len(minute))).round(2)
        if k == 0:
            value[[3 * 80 + 1, 3 * 110, 3 * 140 + 2, 3 * 190, 3 * 190 + 1, 3 * 190 + 2]] = 0.0
        parts.append(pd.DataFrame({"event_id": minute + k * 10_000, "ts": start + pd.to_timedelta(minute * 20, "min"), "user_id": 1, "event_type": name, "value": value, "props": "{}"}))
    pd.concat(parts).astype({"ts": "datetime64[us]"}).to_parquet(path / "events.parquet", index=False)
    return str(path)


@pytest.mark.parametrize("name", ["f3_rv_surface_1h", "a9_intraday_rv"])
def test_zero_prices_as_in_sql(spark, tables, name):
    db = duckdb.connect()
    db.execute(f"CREATE VIEW events AS SELECT * FROM '{tables}/events.parquet'")
    want = db.execute(registry.oracle_sql()[name]).df()
    keys = [c for c in ("symbol", "ts_s", "day") if c in want]
    got = registry.queries()[name](spark, tables).toPandas()[want.columns].sort_values(keys)
    want = want.sort_values(keys)
    assert len(got) == len(want) and np.isinf(want.drop(columns=keys).to_numpy(float)).any()
    for c in want.columns.difference(keys):
        assert all(a == b or (a != a and b != b) or math.isclose(a, b, abs_tol=2e-6) for a, b in zip(got[c], want[c])), c


def test_targets_to_the_last_bit(spark):
    """With the C library's logarithm the targets are Python's, bit by bit; a price of 0 makes nulls, not errors."""
    rng = np.random.default_rng(3)
    x = pd.DataFrame({"symbol": "A", "ts": pd.date_range("2024-01-01", periods=400), "open": np.exp(rng.normal(3, 1, 400))})
    x["close"], x["volume"] = np.exp(rng.normal(3, 1, 400)), 1.0
    x["high"], x["low"] = x[["open", "close"]].max(axis=1) * 1.5, x[["open", "close"]].min(axis=1) / 1.7
    targets = lambda bars: features.volatility_targets(spark.createDataFrame(bars), ln=libm_ln).toPandas().sort_values("ts").reset_index(drop=True)
    got = targets(x)
    assert got.up_1d[:-1].tolist() == [math.log(h / o) for h, o in zip(x.high[1:], x.open[1:])] and got.up_1d.isna()[399]
    x.loc[200, ["low", "close"]] = 0.0
    odd = targets(x)
    assert len(odd) == 400 and odd.range_1d.isna().tolist() == [i in (199, 399) for i in range(400)]


def test_scored_targets_as_in_sql(spark):
    """The rows at the ends of an interval are inside or not as in the SQL; the figures are shares of thousands of rows."""
    sf = "/root/testdata/sf0.01"
    if not os.path.isdir(sf):
        pytest.skip("no test tables")
    db = duckdb.connect()
    db.execute(f"CREATE VIEW lineitem AS SELECT * FROM '{sf}/lineitem.parquet'")
    want = db.execute(registry.oracle_sql()["a18_vol_oos_scoring"]).df().sort_values("target").reset_index(drop=True)
    got = registry.queries()["a18_vol_oos_scoring"](spark, sf).toPandas()[want.columns].sort_values("target").reset_index(drop=True)
    assert np.abs(got.picp - want.picp).max() < 2e-6 and (got.n == want.n).all()
