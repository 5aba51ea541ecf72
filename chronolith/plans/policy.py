"""Queries of policies, exits, calibrators, remaining lanes and primitives (M7-M8, M12, M19-M23, F24, F29, F33, J7, L4-L5, S5-S6, X5, X7, U)."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chronolith.functions.exprs import clip, r6, seconds, series, upto, w
from chronolith.operators import boosting, core, features, holographic, labels, lanes, models, policy, selection
from chronolith.plans import lanes as lane_plans  # noqa: F401  its SQL is used below
from chronolith.plans.bars import ATR, macro_sql
from chronolith.plans.base import OV, SQL, T, WD, WH, D, H, over, query, r
from chronolith.plans.evaluate import FC, P, SC, VOL, WF, forecasts, scored, volatility_frame, wide_lane
from chronolith.plans.features import SW, WKF, layer_sql, lim, rows
from chronolith.plans.more import _replayed, confluence_sql, skeleton_sql
from chronolith.sources import bars as B
from chronolith.sources import sinks
from chronolith.streaming import bars as X

# ---- selection and calibration -------------------------------------------------------------------------------------


@query("m7_probe_ranking")
def _(spark, sf):
    x, names = wide_lane(spark, sf)
    whole = lambda n: [n]
    every = x.select("symbol").distinct().select("symbol", F.lit(0).alias("fold"), F.lit(list(range(len(names)))).alias("features"))
    rank = selection.ranked(x, names, ("vol_1d",), whole, every)
    return rank.select("symbol", (F.col("position") + 1).alias("rank"), "feature", "importance")


@query("m8_selection_pipeline")
def _(spark, sf):
    """Correlation filter, probe ranking, and a walk-forward on what is left, whose importances cut it to the budget."""
    x, names = wide_lane(spark, sf)
    full = lambda df, allowed: models.walk_forward(df, names, "vol_1d", allowed=allowed)[1]
    return selection.pipeline(x, names, "vol_1d", 500, walk_forward_fn=full)


@query("m12_vol_isotonic")
def _(spark, sf):
    """A calibrator for each of the eight targets, from the HAR ridge's forecasts to the actuals."""
    har = models.har_ridge(volatility_frame(spark, sf), VOL).where("oos")
    actual = volatility_frame(spark, sf).select("symbol", "ts", seconds().alias("ts_s"), F.explode(F.create_map(*[x for t in VOL for x in (F.lit(t), F.col(t))])).alias("target", "y"))
    x = har.join(actual, ["symbol", "ts_s", "target"]).where("y is not null")
    got = models.isotonic(x.select(F.concat_ws("|", "symbol", "target").alias("symbol"), "ts", F.col("har").alias("p"), "y"), least=200, distinct=2, low=-np.inf, high=np.inf)
    return got.select(F.substring_index("symbol", "|", 1).alias("symbol"), F.substring_index("symbol", "|", -1).alias("target"), "ts_s", "calibrated")


# ---- exits and policies --------------------------------------------------------------------------------------------

_PR = f"pr AS (SELECT symbol, ts, {P} AS p FROM d)"


@query("m19_exit_select", f"{WD}, {_PR} SELECT symbol, {T}, CASE WHEN greatest(p, 1 - p) >= 0.8 THEN 'high' WHEN greatest(p, 1 - p) >= 0.65 THEN 'mid' ELSE 'low' END AS bucket, coalesce(a.t, b.t, 'balanced') AS template FROM pr LEFT JOIN (VALUES ('LONG|high', 'trend'), ('SHORT|high', 'defensive')) a(k, t) ON a.k = CASE WHEN p > 0.5 THEN 'LONG' ELSE 'SHORT' END || '|' || CASE WHEN greatest(p, 1 - p) >= 0.8 THEN 'high' WHEN greatest(p, 1 - p) >= 0.65 THEN 'mid' ELSE 'low' END LEFT JOIN (VALUES ('LONG|default', 'compact')) b(k, t) ON b.k = CASE WHEN p > 0.5 THEN 'LONG' ELSE 'SHORT' END || '|default'")
def _(spark, sf):
    table = {"LONG|high": "trend", "SHORT|high": "defensive", "LONG|default": "compact"}
    names = F.create_map(*[F.lit(v) for kv in table.items() for v in kv])
    conf = F.greatest("p", 1 - F.col("p"))
    bucket = F.when(conf >= 0.8, "high").when(conf >= 0.65, "mid").otherwise("low")
    side = F.when(F.col("p") > 0.5, "LONG").otherwise("SHORT")
    found = F.coalesce(F.try_element_at(names, F.concat_ws("|", side, bucket)), F.try_element_at(names, F.concat_ws("|", side, F.lit("default"))), F.lit("balanced"))
    return B.oos(B.bars_1d(spark, sf)).select("symbol", seconds().alias("ts_s"), bucket.alias("bucket"), found.alias("template"))


# The lanes' own SQL as sub-queries, joined by bar.
_TERM = lambda tf, year: f"(SELECT symbol, ts_s, rv_term_{tf.lower()}_1d FROM ({layer_sql(tf, year)}))"
_SIGN = "CASE WHEN p > 0.5 THEN 1.0 ELSE -1.0 END"
_REC = f"""{WD}, {_PR}, st AS (SELECT symbol, ts_s, kf_regime, kf_bar_delta, kf_swing_accum, kf_net_swing_delta FROM ({SQL['f24_kalman_lane']})), nn AS ({SQL['f26_narrative_lane']}), sf AS (SELECT symbol, ts_s, yz_z, vov, jump_ratio, range_eff FROM ({SQL['f3_rv_surface']})),
tw AS {_TERM('1W', 52)}, tm AS {_TERM('1M', 12)}, rec AS (SELECT pr.symbol, pr.ts, epoch(pr.ts)::BIGINT AS ts_s, p, greatest(0, least(1, p)) AS policy_prob_up, greatest(0, least(1, 1 - p)) AS policy_prob_down, greatest(p, 1 - p) AS policy_base_confidence, abs(p - 0.5) * 2 AS policy_base_edge, greatest(p, 1 - p) - 0.7 AS policy_gate_margin,
{_SIGN} AS policy_direction_sign, 0.0 AS policy_basis_z, 0.0 AS policy_basis_z_abs, {', '.join(f'coalesce({c}, 0) AS {n}' for n, c in (policy.FILTER | policy.STORY | policy.SURFACE).items())}, abs(coalesce(kf_regime, 0)) AS policy_abs_kf_regime, {_SIGN} * coalesce(kf_regime, 0) AS policy_signed_kf_regime,
{_SIGN} * coalesce(nc_regime_accel, 0) AS policy_signed_nc_regime_accel, {_SIGN} * coalesce(nc_cross_tf_sum, 0) AS policy_signed_nc_cross_sum, coalesce(rv_term_1w_1d, 0) AS policy_term_fast, coalesce(rv_term_1m_1d, 0) AS policy_term_slow
FROM pr LEFT JOIN st ON st.symbol = pr.symbol AND st.ts_s = epoch(pr.ts)::BIGINT LEFT JOIN nn ON nn.symbol = pr.symbol AND nn.ts_s = epoch(pr.ts)::BIGINT LEFT JOIN sf ON sf.symbol = pr.symbol AND sf.ts_s = epoch(pr.ts)::BIGINT
LEFT JOIN tw ON tw.symbol = pr.symbol AND tw.ts_s = epoch(pr.ts)::BIGINT LEFT JOIN tm ON tm.symbol = pr.symbol AND tm.ts_s = epoch(pr.ts)::BIGINT)"""


def policy_record(d: DataFrame) -> DataFrame:
    """The record of stored daily bars, of the lanes' figures at six decimals, as their own queries give them."""
    shown = lambda x: x.select("symbol", "ts", *[r6(c).alias(c) for c in x.columns if c not in ("symbol", "ts")])
    own = sinks.stored(lanes.state(d), "state")
    filters = own.select("symbol", "ts", *[F.col(c.removeprefix("kf_")).alias(c) for c in policy.FILTER.values()])
    lane = features.volatility_lane(d, "1D", ("1W", "1M"))
    return policy.record(B.oos(d), shown(filters), shown(lanes.narrative_lane(d, own=own)), shown(lane))


@query("m20_policy_features", f"{_REC} SELECT symbol, ts_s, {', '.join(r(c, c) for c in policy.RECORD)} FROM rec")
def _(spark, sf):
    return rows(policy_record(B.daily(spark, sf)), *policy.RECORD)


@query("m21_policy_training")
def _(spark, sf):
    """Grid of thresholds on trades that don't overlap; the best by equity, mean R, drawdown and trades."""
    d = core.numbered(core.atr(B.bars_1d(spark, sf)))
    x = labels.labelled(d).join(d.select("symbol", "ts", "i"), ["symbol", "ts"]).join(B.oos(B.bars_1d(spark, sf)), ["symbol", "ts"])
    o = Window.partitionBy("symbol").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    out = None
    for t in (0.5, 0.55, 0.6, 0.65, 0.7, 0.75, 0.8, 0.85):
        run = labels.replay(x, t).withColumn("peak", F.greatest(F.lit(10_000.0), F.max("equity").over(o)))
        g = run.groupBy("symbol").agg(F.max_by("equity", "i").alias("equity"), F.avg("r").alias("avg_r"), F.max((F.col("peak") - F.col("equity")) / F.col("peak")).alias("mdd"), F.count(F.lit(1)).alias("trades")).withColumn("threshold", F.lit(t))
        out = g if out is None else out.unionByName(g)
    best = out.groupBy("symbol").agg(F.max(F.struct("equity", "avg_r", (-F.col("mdd")).alias("nm"), "trades", "threshold")).alias("b"))
    risk = F.when(F.col("b.avg_r") >= 0.12, 1.25).when(F.col("b.avg_r") >= 0.05, 1.0).otherwise(0.65)
    return best.select("symbol", F.col("b.threshold").alias("threshold"), r6("b.equity").alias("equity"), r6("b.avg_r").alias("avg_r"), risk.alias("risk_multiplier"), F.col("b.trades").alias("trades"))


#: A scorecard and the risk bands of its scores, as a trained policy has them.
CARD = {"policy_gate_margin": 1.2, "policy_signed_nc_cross_sum": 0.02, "policy_primary_rv_vov": -0.05, "policy_term_fast": 0.03}
BANDS = ((0.62, 1.25), (0.55, 1.0), (0.0, 0.65))
_CARD = "0.5" + "".join(f" + {w} * {c}" for c, w in CARD.items())
_NEXT = f"""n0 AS (SELECT *, CASE WHEN abs(policy_primary_rv_vov) > 2 THEN 0.03 ELSE 0 END + CASE WHEN policy_abs_kf_regime < 0.1 THEN 0.02 ELSE 0 END AS penalty, {lim(_CARD, 0, 1)} AS score FROM rec),
n1 AS (SELECT *, greatest(0.5, policy_base_confidence - penalty) AS confidence FROM n0), n2 AS (SELECT *, confidence >= 0.7 AS strong, score >= 0.5 AS allowed FROM n1)"""
_VERDICT = f"{r('score', 'policy_score')}, 0.5::DOUBLE AS policy_threshold, allowed AS policy_allowed, CASE WHEN NOT allowed THEN 0.0 WHEN score >= 0.62 THEN 1.25 WHEN score >= 0.55 THEN 1.0 ELSE 0.65 END::DOUBLE AS policy_risk_mult, strong AND NOT allowed AS policy_filtered, CASE WHEN strong AND allowed THEN 'STRONG' ELSE 'NO_TRADE' END AS signal_strength"


def next_bars(d: DataFrame) -> DataFrame:
    x = policy_record(d)
    x = x.withColumns(policy.next_bar(F.col("policy_prob_up"), None, F.col("policy_primary_rv_vov"), F.col("policy_kf_regime")))
    return x.withColumns(policy.verdict(policy.scorecard(CARD), 0.5, BANDS, F.col("strong")))


@query(
    "m22_policy_application",
    f"""{_REC}, {_NEXT}, {ATR}, m AS (SELECT n2.*, atr.close, atr.atr14, CASE WHEN p > 0.5 THEN 1.0 ELSE -1.0 END AS d, CASE WHEN day(n2.ts) % 3 = 0 THEN 'template' WHEN day(n2.ts) % 3 = 1 THEN 'models' ELSE 'plain' END AS note FROM n2 JOIN atr ON atr.symbol = n2.symbol AND atr.ts = n2.ts),
    v AS (SELECT *, CASE note WHEN 'template' THEN {lim('4 * p', 0.35, 2.5)} WHEN 'models' THEN {lim('2 * p', 0.35, 1.5)} ELSE 1.25 END AS s FROM m), w AS (SELECT *, CASE note WHEN 'template' THEN {lim('9 * p', 0.5, 8)} WHEN 'models' THEN greatest({lim('p', 0.5, 4)}, s) ELSE 1.25 END AS t1 FROM v),
    z AS (SELECT *, CASE note WHEN 'template' THEN {lim('14 * p', 1, 12)} WHEN 'models' THEN greatest({lim('3 * p', 1, 7)}, t1 + 0.25) ELSE 2.5 END AS t2, CASE note WHEN 'template' THEN {lim('s', 0.3, 4)} WHEN 'models' THEN {lim('s', 0.4, 1.5)} ELSE 1.0 END AS tr FROM w)
    SELECT symbol, ts_s, {_VERDICT}, {r('close - d * atr14 * s', 'sl')}, {r('close + d * atr14 * t1', 'tp1')}, {r('close + d * atr14 * t2', 'tp2')}, {r('s', 'stop_atr')}, {r('t1', 'tp1_atr')}, {r('t2', 'tp2_atr')}, {r('tr', 'trail_r')}, note FROM z WHERE atr14 > 0""",
)
def _(spark, sf):
    """Every third day has a template, every third models' levels, the others neither."""
    d = B.daily(spark, sf)
    x = next_bars(d).join(core.atr(d).select("symbol", "ts", "close", "atr14"), ["symbol", "ts"]).where("atr14 > 0")
    on = lambda k, c: F.when(F.day("ts") % 3 == k, c)
    p = F.col("policy_prob_up")
    plan = policy.trade_plan(F.col("direction"), F.col("close"), F.col("atr14"), (on(0, 4 * p), on(0, 9 * p), on(0, 14 * p), F.lit(None).cast("double")), (on(1, 2 * p), on(1, p), on(1, 3 * p)))
    x = x.withColumns(plan)
    return x.select("symbol", seconds().alias("ts_s"), r6("policy_score").alias("policy_score"), "policy_threshold", "policy_allowed", "policy_risk_mult", "policy_filtered", "signal_strength", *[r6(c).alias(c) for c in plan if c != "note"], "note")


@query("m23_next_bar", f"{_REC}, {_NEXT} SELECT symbol, ts_s, CASE WHEN p > 0.5 THEN 'UP' ELSE 'DOWN' END AS direction, {r('confidence', 'confidence')}, {r('policy_prob_up', 'raw_score')}, {r('policy_prob_up', 'calibrated_score')}, {r('penalty', 'regime_penalty')}, {_VERDICT} FROM n2 QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY ts_s DESC) = 1")
def _(spark, sf):
    x = next_bars(B.daily(spark, sf)).withColumn("place", F.row_number().over(Window.partitionBy("symbol").orderBy(F.desc("ts")))).where("place = 1")
    return x.select("symbol", seconds().alias("ts_s"), "direction", *[r6(c).alias(c) for c in ("confidence", "raw_score", "calibrated_score", "regime_penalty", "policy_score")], "policy_threshold", "policy_allowed", "policy_risk_mult", "policy_filtered", "signal_strength")


# ---- lanes ---------------------------------------------------------------------------------------------------------


@query("j7_fib_swing_asof", f"{WKF}, {SW} SELECT kf.symbol, epoch(kf.ts)::BIGINT AS ts_s, {r('last_value(a.price IGNORE NULLS) OVER q', 'swing_high')}, {r('last_value(b.price IGNORE NULLS) OVER q', 'swing_low')} FROM kf LEFT JOIN (SELECT * FROM sw WHERE kind = 1) a ON a.symbol = kf.symbol AND a.confirm = kf.i LEFT JOIN (SELECT * FROM sw WHERE kind = -1) b ON b.symbol = kf.symbol AND b.confirm = kf.i WINDOW q AS (PARTITION BY kf.symbol ORDER BY kf.ts)")
def _(spark, sf):
    x = core.numbered(features.kalman(B.bars_1d(spark, sf)))
    at = features.swings(x).groupBy("symbol", "ts").agg(F.max(F.when(F.col("kind") == 1, F.col("price"))).alias("sh"), F.min(F.when(F.col("kind") == -1, F.col("price"))).alias("sl"))
    y = x.join(at, ["symbol", "ts"], "left")
    return y.select("symbol", seconds().alias("ts_s"), r6(F.last("sh", True).over(upto())).alias("swing_high"), r6(F.last("sl", True).over(upto())).alias("swing_low"))


def hourly_frames(spark, sf) -> dict[str, DataFrame]:
    """Hourly bars with their session position, and the days, weeks and months made of them with their close times."""
    hourly = core.session_position(B.bars_1h(spark, sf))
    day = F.date_trunc("day", "ts").alias("day")
    daily = hourly.groupBy("symbol", day).agg(F.min_by("open", "ts").alias("open"), F.max("high").alias("high"), F.min("low").alias("low"), F.max_by("close", "ts").alias("close"), F.sum("volume").alias("volume")).withColumnRenamed("day", "ts")
    return {"1h": hourly, "1d": core.close_time(daily, "1D")} | {tf.lower(): core.close_time(core.resample(daily, tf), tf) for tf in ("1W", "1M")}


@query("f29_holographic_lane_1h")
def _(spark, sf):
    """All 15 windows; windows that the table's days, weeks or months don't fill are null."""
    x = holographic.lane(hourly_frames(spark, sf), holographic.WINDOWS_1H, "1h", digits=6)
    return x.withColumn("ts", seconds()).withColumnRenamed("ts", "ts_s")


_H_SK = f"""{WH}, hd AS (SELECT symbol, date_trunc('day', ts) AS ts, arg_min(open, ts) AS open, max(high) AS high, min(low) AS low, arg_max(close, ts) AS close, sum(volume) AS volume FROM h GROUP BY 1, 2), d AS (SELECT * FROM hd), {macro_sql('1W')}, {skeleton_sql('h', 'a', 13)}, {skeleton_sql('d', 'b', 13)}, {skeleton_sql('m', 'c', 8)}"""


@query("f28_confluence_1h", f"""{_H_SK}, {confluence_sql('h', '1 day', '7 day', '')} SELECT symbol, {T}, sync AS mtf_conf_smc_sync, {r('zone', 'mtf_conf_pd_zone')} FROM z""")
def _(spark, sf):
    x = holographic.lane_blocks(hourly_frames(spark, sf), {"1h": (13,), "1d": (13,), "1w": (8,)}, "1h")
    got = holographic.confluence("1h")
    return x.select("symbol", seconds().alias("ts_s"), got["mtf_conf_smc_sync"].alias("mtf_conf_smc_sync"), r6(got["mtf_conf_pd_zone"]).alias("mtf_conf_pd_zone"))


# ---- primitives ----------------------------------------------------------------------------------------------------

@query("l4_lane_settings", f"""WITH {D.replace('d AS (', 'dd AS (', 1)}, {H}, d AS (SELECT '1D' AS lane, 1.25 AS stop_atr, 10 AS horizon, 5 AS purge, * FROM dd UNION ALL SELECT '1H', 1.25, 24, 24, * FROM h), {ATR}
    SELECT lane, symbol, {T}, {r('stop_atr * atr14', 'stop')}, epoch(lead(ts, horizon) {OV})::BIGINT AS until_s, lead(ts, purge) {OV} IS NOT NULL AS trains FROM atr""")
def _(spark, sf):
    """Each lane's stop distance, the end of a label's horizon, and whether the purge leaves the bar for training."""
    out = []
    for lane, (stop, horizon, purge) in labels.LANES.items():
        x = core.atr(B.bars_1d(spark, sf) if lane == "1D" else B.bars_1h(spark, sf))
        ahead = lambda n: F.lead("ts", n).over(series())
        out.append(x.select(F.lit(lane).alias("lane"), "symbol", seconds().alias("ts_s"), r6(stop * F.col("atr14")).alias("stop"), F.unix_timestamp(ahead(horizon)).alias("until_s"), ahead(purge).isNotNull().alias("trains")))
    return out[0].unionByName(out[1])


@query("l5_primitives", f"{WD} SELECT symbol, {T}, {r('greatest(low, close)', 'lifted_long')}, {r('least(high, close)', 'lifted_short')}, high >= close * 1.01 AS favourable, low <= close * 0.99 AS adverse, {r('(high - open) / (abs(open - low) + 1e-9) * 0.5', 'realized_r')}, {r('close * 0.0005 / (abs(open - low) + 1e-9)', 'fee_r')} FROM d WHERE abs(open - low) > 1e-3")
def _(spark, sf):
    risk = F.abs(F.col("open") - F.col("low")) + 1e-9
    x = B.bars_1d(spark, sf).where("abs(open - low) > 1e-3")
    return x.select("symbol", seconds().alias("ts_s"), r6(F.greatest("low", "close")).alias("lifted_long"), r6(F.least("high", "close")).alias("lifted_short"), (F.col("high") >= F.col("close") * 1.01).alias("favourable"), (F.col("low") <= F.col("close") * 0.99).alias("adverse"), r6((F.col("high") - F.col("open")) / risk * 0.5).alias("realized_r"), r6(F.col("close") * 0.0005 / risk).alias("fee_r"))


@query("s5_distinct_except", f"{WD} SELECT DISTINCT year(ts)::INT AS y, month(ts)::INT AS m FROM d WHERE symbol = 'A' EXCEPT SELECT year(ts)::INT, month(ts)::INT FROM d WHERE symbol = 'N' AND month(ts) <= 6")
def _(spark, sf):
    d = B.bars_1d(spark, sf)
    part = lambda x: x.select(F.year("ts").alias("y"), F.month("ts").alias("m"))
    return part(d.where("symbol = 'A'")).subtract(part(d.where("symbol = 'N' and month(ts) <= 6")))


@query("s6_frame_specs", f"{WD} SELECT symbol, {T}, row_number() {OV} AS rn, {r(f'lag(close) {OV}', 'before')}, {r(f'lead(close) {OV}', 'after')}, {r(f'first_value(close) {over(5)}', 'first5')}, {r('avg(close) OVER (PARTITION BY symbol ORDER BY ts ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING)', 'centred')}, {r(f'max(close) {OV}', 'peak')} FROM d")
def _(spark, sf):
    o = series()
    x = B.bars_1d(spark, sf)
    return x.select("symbol", seconds().alias("ts_s"), F.row_number().over(o).cast("long").alias("rn"), r6(F.lag("close").over(o)).alias("before"), r6(F.lead("close").over(o)).alias("after"), r6(F.first("close").over(w(5))).alias("first5"), r6(F.avg("close").over(o.rowsBetween(-2, 2))).alias("centred"), r6(F.max("close").over(upto())).alias("peak"))


# ---- streams and callables -----------------------------------------------------------------------------------------


@query("x5_stream_sliding", f"WITH e AS (SELECT event_type AS symbol, unnest([date_trunc('hour', ts), date_trunc('hour', ts) - interval 1 hour]) AS ts, value FROM events) SELECT symbol, {T}, count(*) AS n, {r('max(value)', 'high')} FROM e GROUP BY symbol, ts")
def _(spark, sf):
    g = X.events(spark, sf).withWatermark("ts", "45 days").groupBy(F.col("event_type").alias("symbol"), F.window("ts", "2 hours", "1 hour").alias("win")).agg(F.count(F.lit(1)).alias("n"), F.max("value").alias("high"))
    x = X.latest(X.drained(g.select("symbol", F.col("win.start").alias("ts"), "n", "high"), "update"), "symbol", "ts")
    return x.select("symbol", seconds().alias("ts_s"), "n", r6("high").alias("high"))


@query("x7_completed_bars", f"{WH} SELECT symbol, {T}, {r('close', 'close')} FROM h WHERE ts + interval 1 hour <= (SELECT max(ts) FROM events) - interval 1 day")
def _(spark, sf):
    """Bars closed before the watermark of a day."""
    last = F.broadcast(B.table(spark, sf, "events").agg((F.max(F.col("ts").cast("timestamp")) - F.expr("interval 1 days")).alias("mark")))
    x = B.bars_1h(spark, sf).join(last).where(F.col("ts") + F.expr("interval 1 hours") <= F.col("mark"))
    return x.select("symbol", seconds().alias("ts_s"), r6("close").alias("close"))


@query("u1_walk_forward_callable")
def _(spark, sf):
    """The evaluation takes any function of a forecast frame."""
    run = lambda f: models.linear_walk_forward(f, purge=24)
    return run(forecasts(spark, sf)).groupBy("symbol", "fold").agg(F.count(F.lit(1)).alias("n"))


@query("u3_templates_as_data", f"""{WD}, {ATR}, t AS (FROM (VALUES ('balanced', 1.25::DOUBLE, 2.0::DOUBLE, 3.5::DOUBLE, 1.25::DOUBLE), ('compact', 1, 1.5, 3, 1), ('defensive', 2, 2.5, 5, 1.5), ('trend', 1.5, 2, 4, 1.5), ('wide_runner', 1.5, 2.5, 4.5, 1.25)) v(template, stop, tp1, tp2, trail))
    SELECT symbol, {T}, template, {r('close - stop * atr14', 'stop')}, {r('close + tp1 * atr14', 'tp1')}, {r('close + tp2 * atr14', 'tp2')}, {r('trail * atr14', 'trail')} FROM atr, t""")
def _(spark, sf):
    """Levels of every template on every daily bar."""
    table = F.array(*[F.struct(F.lit(k).alias("template"), *[F.lit(v).alias(n) for n, v in zip(("stop", "tp1", "tp2", "trail"), vs)]) for k, vs in labels.TEMPLATES.items()])
    x = core.atr(B.bars_1d(spark, sf)).select("symbol", "ts", "close", "atr14", F.inline(table))
    at = lambda c: F.col(c) * F.col("atr14")
    return x.select("symbol", seconds().alias("ts_s"), "template", r6(F.col("close") - at("stop")).alias("stop"), r6(F.col("close") + at("tp1")).alias("tp1"), r6(F.col("close") + at("tp2")).alias("tp2"), r6(at("trail")).alias("trail"))
