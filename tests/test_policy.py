"""Policies on hand-made rows: nulls, bounds, lanes that lack a bar."""

import datetime as dt

from pyspark.sql import functions as F

from chronolith.operators import policy

T0 = dt.datetime(2024, 1, 1)


def test_lanes_meet_and_missing_bars_are_zero(spark):
    at = lambda k: T0 + dt.timedelta(days=k)
    p = spark.createDataFrame([("a", at(0), 0.8), ("a", at(1), 0.3), ("b", at(0), None)], "symbol string, ts timestamp, p double")
    kf = spark.createDataFrame([("a", at(0), -2.0, 1.0, float("nan"), 3.0), ("c", at(0), 1.0, 1.0, 1.0, 1.0)], "symbol string, ts timestamp, " + ", ".join(f"{c} double" for c in policy.FILTER.values()))
    nc = spark.createDataFrame([("a", at(1), *[float(k) for k in range(1, 10)])], "symbol string, ts timestamp, " + ", ".join(f"{c} double" for c in policy.STORY.values()))
    rv = spark.createDataFrame([("a", at(0), 0.1, 2.5, 0.3, 0.4, -1.0, float("inf"))], "symbol string, ts timestamp, " + ", ".join(f"{c} double" for c in [f"rv_1d_{c}" for c in policy.SURFACE.values()] + list(policy.TERMS["1D"])))
    got = {r.ts.day: r for r in policy.record(p, kf, nc, rv).collect()}
    assert sorted(got) == [1, 2] and set(got[1].asDict()) == {"symbol", "ts", *policy.RECORD} and len(policy.RECORD) == 31
    one, two = got[1], got[2]
    assert (one.policy_direction_sign, one.policy_signed_kf_regime, one.policy_abs_kf_regime, one.policy_kf_swing_accum, one.policy_term_slow, one.policy_nc_fib_age) == (1.0, -2.0, 2.0, 0.0, 0.0, 0.0)
    assert (two.policy_direction_sign, two.policy_nc_cross_sum, two.policy_signed_nc_cross_sum, two.policy_primary_rv_z) == (-1.0, 8.0, -8.0, 0.0) and abs(two.policy_gate_margin) < 1e-12


def test_verdicts(spark):
    rows = [(None, True), (1.7, True), (0.58, True), (0.5, True), (0.4, True), (0.4, False), (-3.0, False)]
    x = spark.createDataFrame(rows, "s double, strong boolean").select("*", *[c.alias(n) for n, c in policy.verdict(F.col("s"), 0.5, ((0.62, 1.25), (0.55, 1.0), (0.0, 0.65)), F.col("strong")).items()])
    got = [(r.policy_score, r.policy_allowed, r.policy_risk_mult, r.policy_filtered, r.signal_strength) for r in x.collect()]
    assert got == [(None, True, 1.0, False, "STRONG"), (1.0, True, 1.25, False, "STRONG"), (0.58, True, 1.0, False, "STRONG"), (0.5, True, 0.65, False, "STRONG"), (0.4, False, 0.0, True, "NO_TRADE"), (0.4, False, 0.0, False, "NO_TRADE"), (0.0, False, 0.0, False, "NO_TRADE")]


def test_trade_plans_keep_their_bounds(spark):
    rows = [("UP", 2.0, 9.0, None, None, None), ("DOWN", 2.0, None, 0.1, 9.0, 0.2), ("UP", 2.0, None, None, 1.0, 2.0), (None, 2.0, 1.0, 1.0, 1.0, 1.0), ("UP", 0.0, 1.0, 1.0, 1.0, 1.0), ("UP", 2.0, None, 1.4, 1.0, 1.1)]
    x = spark.createDataFrame(rows, "d string, atr double, t double, a double, b double, c double")
    none = F.lit(None).cast("double")
    x = x.select(*[c.alias(n) for n, c in policy.trade_plan(F.col("d"), F.lit(100.0), F.col("atr"), (F.col("t"), none, none, none), (F.col("a"), F.col("b"), F.col("c"))).items()])
    got = [(r.stop_atr, r.tp1_atr, r.tp2_atr, r.trail_r, r.note, r.sl, r.tp1) for r in x.collect()]
    assert got[0] == (2.5, 2.5, 2.5, 2.5, "template", 95.0, 105.0)
    assert got[1] == (0.35, 4.0, 4.25, 0.4, "models", 100.7, 92.0)
    assert got[2] == (1.25, 1.25, 2.5, 1.0, "plain", 97.5, 102.5)
    assert got[3][:5] == (None, None, None, None, "none") and got[4][4] == "none"
    assert got[5][:4] == (1.4, 1.4, 1.65, 1.4)
