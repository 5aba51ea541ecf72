"""Queries of structure features with DuckDB oracles (F8-F17)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronolith.functions.exprs import r6, seconds
from chronolith.operators import core, smc
from chronolith.plans.base import OV, T, WD, over, query, r
from chronolith.plans.features import cols, lim, rows
from chronolith.sources import bars as B

_LAGS = ", ".join(f"lag({c}, {k}) {OV} AS {c[0]}{k}" for c in ("open", "high", "low", "close", "volume") for k in (1, 2, 3))
_B = "OVER (PARTITION BY symbol ORDER BY ts ROWS BETWEEN 21 PRECEDING AND 2 PRECEDING)"
_PAST = "OVER (PARTITION BY symbol ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
#: Bars with ATR, earlier prices, displacement and pivots.
X = f"""tr AS (SELECT *, greatest(high - low, abs(high - coalesce(lag(close) {OV}, close)), abs(low - coalesce(lag(close) {OV}, close))) AS tr FROM d), a0 AS (SELECT *, row_number() {OV} AS i, CASE WHEN count(*) {over(14)} = 14 THEN avg(tr) {over(14)} ELSE tr END AS atr14 FROM tr),
x0 AS (SELECT *, {_LAGS}, lag(high, 4) {OV} AS h4, lag(high, 5) {OV} AS h5, lag(low, 4) {OV} AS l4, lag(low, 5) {OV} AS l5, lag(atr14, 3) {OV} AS a3, avg(abs(close - open)) {_B} AS ab, avg(volume) {_B} AS av, i > 32 AS ready FROM a0),
x1 AS (SELECT *, CASE WHEN ready THEN (h1 - l1) / atr14 ELSE 0 END AS disp_magnitude, CASE WHEN ready THEN abs(c1 - o1) / (ab + 1e-9) ELSE 0 END AS disp_body_ratio, CASE WHEN ready THEN v1 / (av + 1e-9) ELSE 0 END AS disp_volume_ratio,
  CASE WHEN i >= 6 AND least(h3 - h1, h3 - h2, h3 - h4, h3 - h5) > 0 AND least(h3 - h1, h3 - h2, h3 - h4, h3 - h5) >= 0.3 * a3 THEN h3 END AS ph, CASE WHEN i >= 6 AND least(l1 - l3, l2 - l3, l4 - l3, l5 - l3) > 0 AND least(l1 - l3, l2 - l3, l4 - l3, l5 - l3) >= 0.3 * a3 THEN l3 END AS pl FROM x0),
x AS (SELECT *, CASE WHEN disp_body_ratio > 1.5 AND disp_magnitude > 1.5 THEN 1.0 ELSE 0 END AS disp_confirmed, last_value(ph IGNORE NULLS) {OV} AS sh, last_value(pl IGNORE NULLS) {OV} AS sl, last_value(ph IGNORE NULLS) {_PAST} AS sh0, last_value(pl IGNORE NULLS) {_PAST} AS sl0,
  list(ph) OVER (PARTITION BY symbol ORDER BY ts ROWS BETWEEN 21 PRECEDING AND CURRENT ROW) AS lph, list(pl) OVER (PARTITION BY symbol ORDER BY ts ROWS BETWEEN 21 PRECEDING AND CURRENT ROW) AS lpl FROM x1)"""


def base(spark, sf) -> DataFrame:
    return smc.pivots(smc.displacement(smc.prepared(B.bars_1d(spark, sf))))


@query("f8_displacement", f"{WD}, {X} SELECT symbol, {T}, {cols('disp_magnitude', 'disp_body_ratio', 'disp_volume_ratio', 'disp_confirmed')} FROM x")
def _(spark, sf):
    return rows(base(spark, sf), "disp_magnitude", "disp_body_ratio", "disp_volume_ratio", "disp_confirmed")


@query("f8_pivots", f"{WD}, {X} SELECT symbol, {T}, {cols('ph', 'pl', 'sh', 'sl')} FROM x")
def _(spark, sf):
    return rows(base(spark, sf), "ph", "pl", "sh", "sl")


@query("f8_liquidity", f"""{WD}, {X} SELECT symbol, {T}, {r('CASE WHEN ready AND sl IS NOT NULL THEN least(abs(c1 - sl) / atr14, 99) ELSE 99 END', 'nearest_ssl_dist')}, {r('CASE WHEN ready AND sh IS NOT NULL THEN least(abs(sh - c1) / atr14, 99) ELSE 99 END', 'nearest_bsl_dist')}, {r('CASE WHEN ready AND sl > l1 THEN (sl - l1) / atr14 ELSE 0 END', 'sweep_bull_mag')}, {r('CASE WHEN ready AND h1 > sh THEN (h1 - sh) / atr14 ELSE 0 END', 'sweep_bear_mag')},
    {r('CASE WHEN ready THEN len(list_filter(lph, lambda p: p IS NOT NULL AND abs(p - c1) <= 5 * atr14)) + len(list_filter(lpl, lambda p: p IS NOT NULL AND abs(p - c1) <= 5 * atr14)) ELSE 0 END', 'pool_density')} FROM x""")
def _(spark, sf):
    return rows(smc.liquidity(base(spark, sf)), "nearest_ssl_dist", "nearest_bsl_dist", "sweep_bull_mag", "sweep_bear_mag", "pool_density")


_EV = f"""ev AS (SELECT symbol, i, 0 AS seq, CASE WHEN ph > sh0 THEN 1 ELSE -1 END AS e FROM x WHERE ph IS NOT NULL AND sh0 IS NOT NULL UNION ALL SELECT symbol, i, 1, CASE WHEN pl < sl0 THEN -1 ELSE 1 END FROM x WHERE pl IS NOT NULL AND sl0 IS NOT NULL),
e2 AS (SELECT *, avg(e) OVER (PARTITION BY symbol ORDER BY i, seq ROWS BETWEEN 23 PRECEDING AND CURRENT ROW) AS trend, lag(e) OVER o AS e1, lag(e, 2) OVER o AS e0 FROM ev WINDOW o AS (PARTITION BY symbol ORDER BY i, seq)), e3 AS (SELECT symbol, i, last(trend ORDER BY seq) AS trend, last((e = 1 AND e1 = -1 AND e0 = -1)::INT ORDER BY seq) AS bull, last((e = -1 AND e1 = 1 AND e0 = 1)::INT ORDER BY seq) AS bear FROM e2 GROUP BY 1, 2),
st AS (SELECT x.symbol, x.ts, ready, c1, sh, sl, disp_magnitude, last_value(e3.trend IGNORE NULLS) OVER q AS trend, coalesce(last_value(coalesce(e3.bull, CASE WHEN e3.trend IS NOT NULL THEN 0 END) IGNORE NULLS) OVER q, 0) AS bull, coalesce(last_value(coalesce(e3.bear, CASE WHEN e3.trend IS NOT NULL THEN 0 END) IGNORE NULLS) OVER q, 0) AS bear FROM x LEFT JOIN e3 ON e3.symbol = x.symbol AND e3.i = x.i WINDOW q AS (PARTITION BY x.symbol ORDER BY x.ts))"""


@query("f12_structure", f"""{WD}, {X}, {_EV} SELECT symbol, {T}, {r('CASE WHEN ready THEN coalesce(trend, 0) ELSE 0 END', 'structure_trend_score')}, {r('CASE WHEN ready THEN bull ELSE 0 END', 'choch_bull_signal')}, {r('CASE WHEN ready THEN bear ELSE 0 END', 'choch_bear_signal')}, {r('CASE WHEN ready AND sh > sl THEN ' + lim('(c1 - sl) / (sh - sl)', 0, 1) + ' ELSE 0.5 END', 'pd_zone')},
    {r('CASE WHEN ready THEN least(1, CASE WHEN bull + bear > 0 THEN 0.4 ELSE 0 END + CASE WHEN disp_magnitude > 1 THEN least(0.3, 0.3 * (disp_magnitude - 1) / 2) ELSE 0 END + CASE WHEN (bull = 1 AND c1 > sh) OR (bull = 0 AND bear = 1 AND c1 < sl) THEN 0.3 ELSE 0 END) ELSE 0 END', 'mss_confirmed')} FROM st""")
def _(spark, sf):
    return rows(smc.structure(base(spark, sf)), "structure_trend_score", "choch_bull_signal", "choch_bear_signal", "pd_zone", "mss_confirmed")


@query("f9_fvg", f"""{WD}, {X}, e AS (SELECT symbol, i AS b, CASE WHEN l1 > h3 THEN l1 ELSE l3 END AS top, CASE WHEN l1 > h3 THEN h3 ELSE h1 END AS bottom, CASE WHEN l1 > h3 THEN 1.0 ELSE -1 END AS dir FROM x WHERE i >= 4 AND (l1 > h3 OR h1 < l3)),
    z AS (SELECT e.*, x.i, x.c1, x.atr14, x.ready, max(greatest(0, CASE WHEN dir > 0 THEN (top - greatest(x.l1, bottom)) / (top - bottom) ELSE (least(x.h1, top) - bottom) / (top - bottom) END)) OVER (PARTITION BY e.symbol, b ORDER BY x.i) AS fill FROM e JOIN x ON x.symbol = e.symbol AND x.i BETWEEN b AND b + 22),
    g AS (SELECT symbol, i, arg_min(dir, (dist, b)) AS dir, arg_min(fill, (dist, b)) AS fill, min(dist) AS dist, count(*) AS n, sum(dir) AS s FROM (SELECT *, abs(c1 - (top + bottom) / 2) / atr14 AS dist FROM z WHERE fill < 0.95 AND ready) GROUP BY 1, 2)
    SELECT x.symbol, epoch(x.ts)::BIGINT AS ts_s, {r('coalesce(least(g.dist, 99), 99)', 'fvg_nearest_dist')}, {r('CASE WHEN g.dist < 99 THEN g.dir ELSE 0 END', 'fvg_direction')}, {r('CASE WHEN g.dist < 99 THEN least(g.fill, 1) ELSE 0.5 END', 'fvg_fill_pct')}, {r('coalesce(g.n, 0)', 'fvg_count_active')}, {r('coalesce(g.s / (g.n + 1), 0)', 'fvg_imbalance_ratio')} FROM x LEFT JOIN g ON g.symbol = x.symbol AND g.i = x.i""")
def _(spark, sf):
    return rows(smc.gaps(base(spark, sf)), "fvg_nearest_dist", "fvg_direction", "fvg_fill_pct", "fvg_count_active", "fvg_imbalance_ratio")


_OB = """e AS (SELECT symbol, i AS b, greatest(o2, c2) AS top, least(o2, c2) AS bottom, CASE WHEN c2 >= o2 THEN -1.0 ELSE 1 END AS dir, disp_body_ratio * abs(c2 - o2) / (atr14 + 1e-9) AS quality FROM x WHERE ready AND disp_confirmed = 1 AND (c2 >= o2) <> (c1 >= o1)),
    z AS (SELECT e.*, x.i, x.i - b + 1 AS age, abs(x.c1 - (top + bottom) / 2) / x.atr14 AS dist, min(CASE WHEN (dir > 0 AND x.l1 < bottom) OR (dir < 0 AND x.h1 > top) THEN x.i END) OVER (PARTITION BY e.symbol, b ORDER BY x.i) AS m FROM e JOIN x ON x.symbol = e.symbol AND x.i BETWEEN b AND b + 23)"""


@query("f10_order_blocks", f"""{WD}, {X}, {_OB}, g AS (SELECT symbol, i, min(dist) AS dist, arg_min(quality * exp(-0.02 * age), (dist, b)) AS q, arg_min(dir, (dist, b)) AS dir, arg_min(age, (dist, b)) AS age FROM z WHERE m IS NULL GROUP BY 1, 2)
    SELECT x.symbol, epoch(x.ts)::BIGINT AS ts_s, {r('CASE WHEN g.dist < 99 THEN g.q ELSE 0 END', 'ob_quality_score')}, {r('CASE WHEN g.dist < 99 THEN g.dir ELSE 0 END', 'ob_direction')}, {r('CASE WHEN g.dist < 99 THEN g.dist ELSE 99 END', 'ob_nearest_dist')}, {r('CASE WHEN g.dist < 99 THEN g.age ELSE 0 END', 'ob_age_bars')} FROM x LEFT JOIN g ON g.symbol = x.symbol AND g.i = x.i""")
def _(spark, sf):
    return rows(smc.blocks(base(spark, sf)), "ob_quality_score", "ob_direction", "ob_nearest_dist", "ob_age_bars")


@query("f11_breakers", f"""{WD}, {X}, {_OB}, g AS (SELECT symbol, i, min(dist) AS dist, arg_min(quality * 0.8 * exp(-0.02 * age), (dist, m, b)) AS q, arg_min(-dir, (dist, m, b)) AS dir FROM z WHERE m IS NOT NULL GROUP BY 1, 2)
    SELECT x.symbol, epoch(x.ts)::BIGINT AS ts_s, {r('coalesce(g.dir, 0)', 'breaker_direction')}, {r('coalesce(least(g.dist, 99), 99)', 'breaker_dist')}, {r('coalesce(g.q, 0)', 'breaker_strength')} FROM x LEFT JOIN g ON g.symbol = x.symbol AND g.i = x.i""")
def _(spark, sf):
    return rows(smc.blocks(base(spark, sf)), "breaker_direction", "breaker_dist", "breaker_strength")


@query("f14_inducement", f"""{WD}, {X}, e AS (SELECT *, CASE WHEN i > 33 AND h2 - sh > 0 AND h2 - sh < 0.5 * atr14 AND c1 < sh THEN -1.0 WHEN i > 33 AND sl - l2 > 0 AND sl - l2 < 0.5 * atr14 AND c1 > sl THEN 1.0 END AS dir FROM x), f AS (SELECT *, CASE WHEN dir < 0 THEN (h2 - sh) / atr14 WHEN dir > 0 THEN (sl - l2) / atr14 END AS mag, CASE WHEN dir IS NOT NULL THEN i END AS ei FROM e),
    g AS (SELECT *, last_value(dir IGNORE NULLS) {OV} AS pd, last_value(mag IGNORE NULLS) {OV} AS pm, last_value(ei IGNORE NULLS) {OV} AS pei FROM f)
    SELECT symbol, {T}, {r('CASE WHEN dir IS NOT NULL THEN 1 ELSE 0 END', 'indu_confirmed')}, {r('CASE WHEN i > 33 THEN coalesce(pd, 0) ELSE 0 END', 'indu_direction')}, {r('CASE WHEN i > 33 THEN coalesce(pm * exp(-0.05 * (i - pei)), 0) ELSE 0 END', 'indu_magnitude')}, {r('CASE WHEN i > 33 THEN CASE WHEN pei IS NULL THEN 0 ELSE least(1, (i - pei) / 20.0) END ELSE 0 END', 'indu_age_bars')} FROM g""")
def _(spark, sf):
    return rows(smc.inducement(base(spark, sf)), "indu_confirmed", "indu_direction", "indu_magnitude", "indu_age_bars")


@query("f13_amd_phases")
def _(spark, sf):
    return rows(smc.phases(smc.liquidity(base(spark, sf))), "amd_phase", "amd_duration", "amd_range_pct", "amd_volume_profile")


@query("f8_smc_core")
def _(spark, sf):
    return rows(smc.core_columns(B.bars_1d(spark, sf), *smc.DAILY), *smc.KEYS)


def _with_higher(spark, sf, x: DataFrame, *frames: tuple[str, str]) -> DataFrame:
    """x with the trend score and phase of each (prefix, timeframe), as of the last closed bar; 0 where there is none."""
    daily = B.bars_1d(spark, sf)
    for prefix, tf in frames:
        x = core.as_of(x, smc.higher(core.close_time(core.resample(daily, tf), tf), prefix), prefix="").drop("close_ts")
    names = [f"{p}_{c}" for p, _ in frames for c in ("structure_trend_score", "amd_phase")]
    return x.fillna(0.0, names)


@query("f16_smc_confluence")
def _(spark, sf):
    x = _with_higher(spark, sf, smc.core_columns(B.bars_1d(spark, sf), *smc.DAILY), ("htf1", "1W"))
    return rows(smc.confluence(x), "sweep_disp_sync", "ob_fvg", "phase_weighted_trend", "full_entry", "pd_ob", "htf_trend_alignment", "htf_phase_cascade")


@query("f15_smc_htf")
def _(spark, sf):
    x = _with_higher(spark, sf, B.bars_1d(spark, sf).select("symbol", "ts"), ("htf1", "1W"), ("htf2", "1M"), ("htf3", "6M"))
    return rows(x, *[f"htf{k}_{c}" for k in (1, 2, 3) for c in ("structure_trend_score", "amd_phase")])


@query("f17_smc_by_lane")
def _(spark, sf):
    """The hourly lane: hourly bars with the hourly settings."""
    return rows(smc.core_columns(B.bars_1h(spark, sf), *smc.HOURLY), *smc.KEYS)
