"""Work by slices of time against plain loops: states, numbers, carried values, as-of joins."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from chronolith.operators import core, features, scan

DAY = dt.datetime(2019, 11, 20)


def bars(seed=1):
    g = random.Random(seed)
    rows = []
    for symbol, n in (("A", 900), ("B", 400), ("C", 1), ("D", 15), ("E", 14)):
        for k in range(n):
            o, c = g.uniform(5, 9), g.uniform(5, 9)
            bad = g.random() < 0.03 and k
            rows.append((symbol, DAY + dt.timedelta(hours=9 * k + 3000 * (k > 300)), o, max(o, c) + g.random(), min(o, c) - g.random(), None if bad and k % 2 else float("nan") if bad else c, 1.0))
    g.shuffle(rows)
    return rows


SCHEMA = "symbol string, ts timestamp, open double, high double, low double, close double, volume double"


@pytest.mark.parametrize("unit,chunk", [("year", 8192), ("month", 8192), ("year", 16)])
def test_filter_and_wilder_equal_loops(spark, monkeypatch, unit, chunk):
    monkeypatch.setattr(scan, "CHUNK", chunk)
    rows = bars()
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    got = {(r.symbol, r.ts): r.kalman for r in features.kalman(df, unit=unit).collect()}
    clean = df.where("symbol <> 'A'").fillna(7.0)
    atr = {(r.symbol, r.ts): r.atr_wilder for r in features.wilder(clean, unit=unit).collect()}
    assert len(got) == len(rows)
    for symbol in "ABCDE":
        mine = sorted(r for r in rows if r[0] == symbol)
        state, p, before, seen, trs = None, 1.0, None, [], []
        for k, (_, ts, o, h, lo, c, _) in enumerate(mine):
            m = None if c is None or c != c else (o * h * lo * c) ** 0.25
            if k:
                p += 1e-3
                gain = p / (p + 1)
                p *= 1 - gain
                state = state if m is None else state + gain * (m - state)
            else:
                state = m
            assert got[symbol, ts] == pytest.approx(state, abs=1e-9)
            c = 7.0 if c is None or c != c else c
            trs.append(max(h - lo, abs(h - (c if before is None else before)), abs(lo - (c if before is None else before))))
            before = c
            seen.append(ts)
        if symbol == "A":
            continue
        a = sum(trs[1:15]) / 14 if len(trs) > 14 else 1.0
        for k, ts in enumerate(seen):
            a = (13 * a + trs[k]) / 14 if k > 14 else a
            assert atr[symbol, ts] == pytest.approx(a, abs=1e-9)


def test_numbers_and_carried_values(spark):
    g = random.Random(3)
    rows = [(s, DAY + dt.timedelta(days=11 * k), g.choice([None, None, float(k)]), g.choice([None, f"v{k}"])) for s in "ab" for k in range(120)]
    df = spark.createDataFrame(rows, "symbol string, ts timestamp, x double, y string").repartition(4)
    for unit in ("month", "year"):
        number = {(r.symbol, r.ts): r.i for r in scan.numbered(df, unit).collect()}
        got = {(r.symbol, r.ts): (r.x, r.y) for r in scan.carried(df, ("x", "y"), unit=unit).collect()}
        for s in "ab":
            last = [None, None]
            for k, (_, ts, *values) in enumerate(sorted((r for r in rows if r[0] == s), key=lambda r: r[1])):
                last = [v if v is not None else o for v, o in zip(values, last)]
                assert number[s, ts] == k and got[s, ts] == tuple(last)
    assert scan.carried(df.limit(0), ("x",)).count() == 0


@pytest.mark.parametrize("unit", ["day", "month", "year"])
def test_as_of_by_slices_is_the_same(spark, unit):
    g = random.Random(5)
    when = lambda: DAY + dt.timedelta(hours=g.randrange(20_000))
    left = spark.createDataFrame([(s, t, float(k)) for s in "abc" for k, t in enumerate(sorted({when() for _ in range(200)}))], "symbol string, ts timestamp, v double")
    right = spark.createDataFrame([(s, t, float(k)) for s in "bcd" for k, t in enumerate(sorted({when() for _ in range(9 if s == "b" else 150)}))], "symbol string, close_ts timestamp, w double")
    for tolerance in (None, "interval 20 days"):
        plain = sorted(map(tuple, core.as_of(left, right, tolerance=tolerance).select("symbol", "ts", "v", "r_close_ts", "r_w").collect()), key=str)
        assert sorted(map(tuple, core.as_of(left, right, tolerance=tolerance, unit=unit).select("symbol", "ts", "v", "r_close_ts", "r_w").collect()), key=str) == plain
    assert core.as_of(left, right.limit(0), unit=unit).where(F.col("r_w").isNotNull()).count() == 0
    assert core.as_of(left.limit(0), right, unit=unit).count() == 0
