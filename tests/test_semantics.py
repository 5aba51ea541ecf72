"""Plain restatements and invariants on small hand-made series."""

import datetime as dt
import math

import numpy as np

import pytest
from pyspark.sql import functions as F

from chronolith.functions import symbols
from chronolith.operators import core, evaluate, features, holographic, labels, models, quality, smc
from chronolith.sources import sinks


def series(spark, closes, symbol="S", volume=100.0):
    rows, before = [], closes[0]
    for i, c in enumerate(closes):
        rows.append((symbol, dt.datetime(2020, 1, 1) + dt.timedelta(days=i), float(before), float(max(before, c) + 1), float(min(before, c) - 1), float(c), volume + i % 7))
        before = c
    return spark.createDataFrame(rows, "symbol string, ts timestamp, open double, high double, low double, close double, volume double")


@pytest.fixture(scope="module")
def walk(spark):
    steps = np.random.default_rng(42).normal(0, 1, 300)
    return series(spark, (100 + np.cumsum(steps)).clip(20).tolist()).cache()


def test_atr_is_true_range_until_14_bars(walk):
    x = core.atr(walk).orderBy("ts").toPandas()
    pc = x.close.shift().fillna(x.close)
    tr = np.maximum(x.high - x.low, np.maximum((x.high - pc).abs(), (x.low - pc).abs()))
    want = tr.rolling(14).mean().fillna(tr)
    assert np.allclose(x.atr14, want)


def test_as_of_takes_last_visible_and_equal_times(spark):
    left = spark.createDataFrame([("S", t) for t in (1, 5, 9)], "symbol string, ts long")
    right = spark.createDataFrame([("S", 5, 1.0), ("S", 9, 2.0), ("T", 1, 9.0)], "symbol string, close_ts long, v double")
    got = {r.ts: r.v for r in core.as_of(left, right, prefix="").collect()}
    assert got == {1: None, 5: 1.0, 9: 2.0}


def test_higher_bar_shows_only_from_its_close(walk):
    weekly = core.close_time(core.resample(walk, "1W"), "1W").select("symbol", "close_ts", F.col("ts").alias("origin"))
    got = core.as_of(walk.select("symbol", "ts"), weekly, prefix="").where("origin is not null")
    assert got.where("close_ts > ts").count() == 0


@pytest.mark.parametrize("op", ["surface", "smc", "streaks", "delta"])
def test_no_look_ahead(walk, op):
    """Cutting a series does not change earlier rows (the surface only fills back before its first valid bar)."""
    run = {"surface": features.volatility_surface, "smc": smc.core_columns, "streaks": lambda b: features.regime_streaks(core.atr(features.kalman(b))), "delta": features.candle_delta}[op]
    cut = walk.where("ts < timestamp '2020-08-01'")
    whole, part = run(walk).where("ts < timestamp '2020-08-01'").orderBy("ts").toPandas(), run(cut).orderBy("ts").toPandas()
    numbers = [c for c in part.columns if part[c].dtype == float]
    assert np.allclose(whole[numbers], part[numbers], equal_nan=True)


def test_surface_ranges(walk):
    x = features.volatility_surface(walk).toPandas()
    assert x.yz_pctrank.between(0, 1).all() and x.jump_ratio.between(0, 1).all() and x.yz_z.abs().max() <= 8 and x.range_eff.between(0.2, 5).all()
    assert len(features.RV_KEYS) == 14


def test_constant_prices_have_no_volatility(spark):
    x = features.volatility_surface(series(spark, [50.0] * 80)).toPandas()
    assert x[list(features.RV_KEYS)].notna().all().all()


def test_one_and_no_rows(spark):
    one = series(spark, [10.0])
    for df in (one, one.limit(0)):
        assert features.volatility_surface(df).count() == df.count()
        assert smc.core_columns(df).count() == df.count()
        assert labels.labelled(core.atr(df)).count() == df.count()


def simulate_plain(bars, entry, long, d0, d1, d2, trail, fee):
    """One trade, bar by bar."""
    s = 1 if long else -1
    risk = d0 + 1e-9
    stop, t1, t2 = entry - s * d0, entry + s * d1, entry + s * d2
    parts = {"a": 0.5, "b": 0.25, "c": 0.25}
    r = -entry * fee / risk
    hit1 = hit2 = False

    def sell(names, price):
        nonlocal r
        for n in names:
            f = parts.pop(n, 0)
            r += (s * (price - entry) / risk - price * fee / risk) * f

    def lift(x):
        nonlocal stop
        stop = max(stop, x) if long else min(stop, x)

    for j, (o, h, lo, c) in enumerate(bars, 1):
        best, worst = (h, lo) if long else (lo, h)
        if s * (stop - o) >= 0:
            sell("abc", o)
            return r, 4, j
        if "a" in parts and s * (o - t1) >= 0:
            sell("a", t1); hit1 = True; lift(entry)  # noqa: E702
        if "b" in parts and s * (o - t2) >= 0:
            sell("b", t2); hit2 = True; lift(t1)  # noqa: E702
        favour = ("a" in parts and s * (best - t1) >= 0) or ("b" in parts and s * (best - t2) >= 0)
        if s * (stop - worst) >= 0:
            sell("abc", stop)
            return r, 6 if favour else 7, j
        for part, target, base, code in (("a", t1, entry, 9), ("b", t2, t1, 11)):
            if part in parts and s * (best - target) >= 0:
                sell(part, target)
                hit1, hit2 = hit1 or part == "a", hit2 or part == "b"
                lift(base)
                if s * (stop - worst) >= 0:
                    sell("abc", stop)
                    return r, code, j
        lift(c - s * trail)
        if hit1:
            lift(t1 if hit2 else entry)
    sell("abc", bars[-1][3])
    return r, 2, len(bars)


def test_simulation_equals_plain_loop():
    g = np.random.default_rng(7)
    n, horizon = 400, 10
    close = 100 + np.cumsum(g.normal(0, 1.5, (n, horizon)), axis=1)
    open_ = np.concatenate([np.full((n, 1), 100.0), close[:, :-1]], axis=1) + g.normal(0, 0.7, (n, horizon))
    bars = np.stack([open_, np.maximum(open_, close) + g.random((n, horizon)), np.minimum(open_, close) - g.random((n, horizon)), close], axis=2)
    size = np.full(n, horizon)
    entry, d = bars[:, 0, 0] * 1.0003, g.uniform(0.8, 3, n)
    for long in (True, False):
        got = labels.simulate(bars, size, entry, long, d, d, 2 * d, d, 5e-4)
        for i in range(n):
            r, why, j = simulate_plain([tuple(b) for b in bars[i]], entry[i], long, d[i], d[i], 2 * d[i], d[i], 5e-4)
            assert math.isclose(got["r"][i], r, abs_tol=1e-9) and (got["reason"][i], got["bars"][i]) == (why, j)


def test_replay_does_not_overlap(spark):
    x = spark.createDataFrame([("S", dt.datetime(2020, 1, 1) + dt.timedelta(days=i), i, 0.5, 3.0, 0.9) for i in range(12)], "symbol string, ts timestamp, i long, long_path_r double, long_bars double, p double")
    got = labels.replay(x).orderBy("i").toPandas()
    assert got.i.tolist() == [0, 4, 8] and math.isclose(got.equity.iloc[-1], 10_000 + 3 * 0.5 * 200)


def test_replay_takes_shorts(spark):
    """A sure fall is a short trade, by its own R and bars, and blocks later bars until its exit."""
    p = [0.1, 0.9, 0.9, 0.6, 0.3, 0.95, None, float("nan"), 0.9]
    x = spark.createDataFrame([("S", dt.datetime(2020, 1, 1) + dt.timedelta(days=i), i, 0.5, 1.0, -0.25, 2.0, q) for i, q in enumerate(p)], "symbol string, ts timestamp, i long, long_path_r double, long_bars double, short_path_r double, short_bars double, p double")
    got = labels.replay(x).orderBy("i").toPandas()
    assert list(zip(got.direction, got.i, got.exit_i, got.r)) == [("SHORT", 0, 2, -0.25), ("SHORT", 4, 6, -0.25), ("LONG", 8, 9, 0.5)]
    assert got.equity.tolist() == [9950.0, 9900.0, 10_000.0]


def test_labels_and_surface_hold_both_directions(spark, walk):
    x = core.atr(walk)
    got = labels.labelled(x).toPandas()
    assert (got.short_bars.isna() == got.short_path_r.isna()).all() and (got.short_bars != got.long_bars).any()
    p = walk.selectExpr("symbol", "ts", "(pmod(hash(ts), 1000) + 0.5) / 1000D as p")
    surface = labels.exit_surface(x)
    groups = {(r["group"], r.template): r for r in labels.surface_groups(surface, p).collect()}
    rows = surface.join(p, ["symbol", "ts"]).toPandas()
    assert rows.r.notna().all()
    rows["confidence"] = rows.p.where(rows.p > 0.5, 1 - rows.p)
    rows = rows[(rows.direction == np.where(rows.p > 0.5, "UP", "DOWN")) & (rows.confidence >= 0.55)]
    edges = np.quantile(rows.drop_duplicates("ts").confidence, (0.5, 0.8))
    assert {g for g, _ in groups} == {f"{d}|{b}" for d in ("UP", "DOWN") for b in ("0", "1", "2", "default")}
    for (group, template), r in groups.items():
        d, b = group.split("|")
        mine = rows[(rows.direction == d) & (rows.template == template)]
        mine = mine if b == "default" else mine[np.searchsorted(edges, mine.confidence, side="right") == int(b)]
        assert r.samples == len(mine) and math.isclose(r.avg_r, mine.r.mean(), abs_tol=1e-9) and math.isclose(r.win_rate, (mine.r > 0).mean(), abs_tol=1e-9)


def test_folds_and_purge():
    plan = evaluate.folds(1000, 500)
    assert plan[0] == (0, 500, 650) and all(b - a >= 50 for _, a, b in plan)
    assert evaluate.inner_validation(1000, 24) == (826, 850) and evaluate.inner_validation(100, 24) == (0, 0)


def test_skeleton_and_lags_of_a_window(spark):
    x = holographic.window_columns(series(spark, [10, 12, 11, 15, 9]), "d", 5).where("d_w5_bar1_close is not null").toPandas()
    assert len(x) == 1 and x["d_w5_skel_smc_phase"].iloc[0] in (-2, -1, 0, 1, 2)
    assert x["d_w5_gram_nb_lag0"].iloc[0] == x["d_w5_bar5_norm_bias"].iloc[0]


def test_column_counts():
    def count(windows):
        return sum(9 * n + 2 * n + (5 if n >= 10 else 0) + (5 if n >= 5 else 0) for sizes in windows.values() for n in sizes)

    # Two confluence columns come on top of each lane.
    assert count(holographic.WINDOWS_1D) + 2 == 954 and count(holographic.WINDOWS_1H) + 2 == 1441
    names = [c for tf, sizes in holographic.WINDOWS_1H.items() for n in sizes for c in holographic.block_names(tf, n)]
    assert len(names) == len(set(names)) == 1439


def test_lane_of_blocks(spark):
    """Figures stand under their names, session positions follow their bars, and a window that isn't filled is null."""
    hours = series(spark, [10, 12, 11, 15, 9, 13, 14]).withColumn("session_pos", F.hour("ts") / 24.0)
    x = holographic.blocks(hours, "1h", 3, 5, primary=True)
    got = holographic.spread(x, {"1h": (3, 5)}, "ts", "session_pos", "close").orderBy("ts").toPandas()
    assert got["1h_w5_bar1_close"].isna().sum() == 4 and got["1h_w3_gram_nb_lag0"].isna().sum() == 2
    for k in (1, 2, 3):
        assert (got[f"1h_w3_bar{k}_session_pos"] - got["session_pos"].shift(3 - k))[2:].abs().max() < 1e-12
    assert (got["1h_w5_bar5_norm_bias"] - got["1h_w5_gram_nb_lag0"]).abs().max() == 0
    one = x.select("ts", holographic.figure("1h_w5_bar2_volume_bias").alias("v")).orderBy("ts").toPandas()
    assert (one["v"] - got["1h_w5_bar2_volume_bias"])[4:].abs().max() == 0


def test_quantile_boosting_orders_quantiles():
    g = np.random.default_rng(3)
    x, y = g.normal(size=(600, 2)), g.normal(size=600)
    q = [models.Boost(models.pinball(a), rounds=150).fit(x, y).predict(x).mean() for a in (0.25, 0.5, 0.75)]
    assert q[0] < q[1] < q[2]


def test_symbol_parse(spark):
    rows = [('SYMBOL:{"exchange":"NSE","symbol":"NIFTYJR","type":"index"} ,OPEN:1',), ("SYMBOL:CME:ESZ2025 ,OPEN:1",), ("SYMBOL:BINANCE:BTCUSDT.P ,OPEN:1",), (None,), ("",)]
    got = [tuple(r) for r in symbols.parsed(spark.createDataFrame(rows, "message string")).select("exchange", "kind", "pair", "quote", "canonical").collect()]
    assert got[0] == ("NSE", "SPOT", "NIFTYJR", None, "NIFTYNXT50")
    assert got[1][:2] == ("CME", "DATED_FUTURE") and got[2] == ("BINANCE", "PERPETUAL", "BTC", "USDT", "BTC")


def test_profit_factor_without_losses_is_infinite(spark):
    x = spark.createDataFrame([("S", i, dt.datetime(2020, 1, 1), 1.0) for i in range(3)], "symbol string, event_id long, ts timestamp, pnl_r double")
    assert evaluate.trade_metrics(x).first().profit_factor == math.inf


def test_index_values_are_carried_to_every_symbol(spark):
    bars = spark.createDataFrame([(s, t) for s in "ST" for t in (1, 5, 9)], "symbol string, ts long")
    index = spark.createDataFrame([(2, 1.0, None), (5, 2.0, 7.0), (7, None, 8.0)], "ts long, a double, b double")
    got = {(r.symbol, r.ts): (r.a, r.b) for r in core.on_days(bars, index, "a", "b").collect()}
    assert got == {(s, t): v for s in "ST" for t, v in ((1, (None, None)), (5, (2.0, 7.0)), (9, (2.0, 8.0)))}


def test_suite_masks_the_curve_of_a_missing_index(spark, walk):
    x = features.volatility_surface(walk).withColumns({"vix_index": F.lit(20.0), "vix9d_index": F.lit(25.0), "vix3m_index": F.lit(None).cast("double")})
    r = features.companion_suite(x).first()
    assert (r.vix_available, r.vix9d_available, r.vix3m_available, r.vix_suite_available) == (1.0, 1.0, 0.0, 0.0)
    assert math.isclose(r.vix9d_vix_ratio, 1.25) and r.vix_curve_short_inversion == 1.0
    assert r.vix_vix3m_spread == r.vix9d_vix3m_spread == r.vix_vix3m_ratio == r.vix_curve_back_inversion == 0.0


def test_stale_notes(spark):
    x = spark.createDataFrame([(36 * 3600, "1H"), (36 * 3600 + 60, "1h"), (4 * 86400 + 7260, "1D"), (10**9, "1W")], "age long, timeframe string")
    got = [r[0] for r in x.select(quality.stale_note(F.col("age"), F.col("timeframe"))).collect()]
    assert got == ["", "Stale data: latest 1H bar is 1d 12h old.", "Stale data: latest 1D bar is 4d 2h old.", ""]


def test_modal_takes_the_largest_of_equals(spark):
    x = spark.createDataFrame([("S", 1), ("S", 1), ("S", 3), ("S", 3), ("S", 2), ("T", None)], "symbol string, v int")
    assert [tuple(r) for r in quality.modal(x, "v", "symbol").collect()] == [("S", 3, 2)]


def test_upsert_replaces_equal_keys_only(spark):
    old = spark.createDataFrame([("a", 1, 1.0), ("b", 1, 2.0), ("c", 3, 3.0)], "k string, run int, v double")
    new = spark.createDataFrame([("b", 2, 9.0), ("c", 2, 8.0), ("d", 2, 7.0)], "k string, run int, v double")
    assert {r.k: r.v for r in sinks.upserted(old, new, ("k",), "run").collect()} == {"a": 1.0, "b": 9.0, "c": 3.0, "d": 7.0}
