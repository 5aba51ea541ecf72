"""Stored daily bars are the plain ones, and the trades are not sorted for them."""

import datetime as dt
import itertools

import pytest

from chronolith.plans import evaluate, registry
from chronolith.sources import bars

SCHEMA = "l_orderkey long, l_linenumber int, l_quantity double, l_extendedprice double, l_returnflag string, l_shipdate timestamp"
DAYS = [dt.datetime(2024, 1, 1), dt.datetime(2024, 1, 2, 13), None]


def trades(spark, folder) -> str:
    """Keys that repeat, tie in parts or are null, prices of 0, null quantities, symbols and days without a name."""
    rows = []
    for i, (symbol, day) in enumerate(itertools.product(["A", "N", None], DAYS)):
        for j in range(40):
            order = None if (i, j % 9) in ((1, 0), (5, 3)) or i == 7 else (j * 7 + i) % 5
            rows.append((order, None if j % 11 == 5 else j % 2, [0.0, 1.0, 2.0, None][(j + i) % 4], None if j % 13 == 4 else float(j * 3 % 8), symbol, day))
    rows.append((3, 1, 2.0, 9.0, "one", DAYS[0]))
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(f"{folder}/lineitem.parquet")
    return str(folder)


def test_daily_bars_are_the_plain_ones(spark, tmp_path):
    sf = trades(spark, tmp_path / "t")
    want, got = bars.bars_1d(spark, sf), bars.daily(spark, sf)
    assert got.columns == want.columns
    order = lambda df: sorted(map(tuple, df.collect()), key=repr)
    assert len(order(want)) == 10 and order(got) == order(want)


def test_trades_are_added_up_without_a_sort(spark, tmp_path, monkeypatch):
    """No aggregate sorts all trades; what is sorted for a bar's ends comes from the join with its first and last order."""
    sf = trades(spark, tmp_path / "t")
    plans = []
    stored = bars.sinks.stored
    monkeypatch.setattr(bars.sinks, "stored", lambda df, name: (plans.append(df._jdf.queryExecution().sparkPlan().toString()), stored(df, name))[1])
    bars.daily(spark, sf)
    assert len(plans) == 2 and "SortAggregate" not in plans[0]
    assert "BroadcastHashJoin" in plans[1]


class Used(Exception):
    pass


def used(*_):
    raise Used


@pytest.mark.parametrize("read", [evaluate.wide_lane, registry.queries()["m22_policy_application"]])
def test_lanes_read_them(spark, monkeypatch, read):
    monkeypatch.setattr(bars, "daily", used)
    with pytest.raises(Used):
        read(spark, "/nowhere")
