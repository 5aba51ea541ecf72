"""Queries of the filter and narrative lanes on daily bars (F22-F26)."""

from __future__ import annotations

from chronolith.operators import core, lanes
from chronolith.plans.bars import closed_sql, macro_sql
from chronolith.plans.base import OV, T, WD, over, query, r
from chronolith.plans.features import rows
from chronolith.sources import bars as B

_VALUES = ("v0", "v0 / n", "v0 / greatest(rng, 1e-9)", "v0 / greatest(rng / greatest(med, 1e-9), 1e-9)", "v0 / greatest(n * med, 1e-9)")


def state_sql(src: str, p: str) -> str:
    """Common table expressions that end in {p}t, the state of every bar of ``src``."""
    ev = ", ".join(f"{v} AS v{k}" for k, v in enumerate(_VALUES) if k)
    prev = ", ".join(f"lag(v{k}) OVER (PARTITION BY symbol ORDER BY i) AS p{k}" for k in range(5))
    cols = ", ".join(
        f"coalesce({q}.v{k}, 0) AS {s}_swing_delta{m}, coalesce({q}.p{k}, 0) AS prev_{s}_swing_delta{m}, coalesce({q}.v{k} - {q}.p{k}, 0) AS {s}_swing_delta{m}_div"
        for k, m in enumerate(lanes.MEASURES)
        for s, q in (("bull", "b"), ("bear", "c"))
    )
    return f"""{p}x AS (SELECT *, row_number() {OV} AS i, (open * high * low * close) ** 0.25 AS m FROM {src}),
    {p}k AS (SELECT symbol, 1::BIGINT AS i, m AS x, 1.0::DOUBLE AS p FROM {p}x WHERE i = 1 UNION ALL SELECT k.symbol, x.i, k.x + (k.p + 0.001) / (k.p + 1.001) * (x.m - k.x), (1 - (k.p + 0.001) / (k.p + 1.001)) * (k.p + 0.001) FROM {p}k k JOIN {p}x x ON x.symbol = k.symbol AND x.i = k.i + 1),
    {p}f AS (SELECT *, close - kalman AS regime, lag(high) {OV} AS h1, lag(low) {OV} AS l1, lag(close) {OV} AS pc FROM (SELECT x.*, k.x AS kalman FROM {p}x x JOIN {p}k k ON k.symbol = x.symbol AND k.i = x.i)),
    {p}g AS (SELECT *, i >= 2 AND ((close < kalman AND open > kalman) OR (sqrt(open * close) > kalman AND low <= kalman)) AS up, i >= 2 AND ((close > kalman AND open < kalman) OR (sqrt(open * close) < kalman AND high >= kalman)) AS down,
        greatest(high - low, abs(high - coalesce(pc, close)), abs(low - coalesce(pc, close))) AS tr, greatest(0, greatest(high, pc) - greatest(open, close)) AS tw, greatest(0, least(open, close) - least(low, pc)) AS bw, abs(open - close) AS bd FROM {p}f),
    {p}a AS (SELECT *, CASE WHEN atr0 > 0 THEN atr0 ELSE 1 END AS atr, CASE WHEN pc IS NULL OR tw * tw + bw * bw + bd * bd < 1e-18 THEN 0 WHEN bw + (close - open) - tw >= 0 THEN volume * (bw * bw + bd * bd) / (tw * tw + bw * bw + bd * bd) ELSE -volume * (tw * tw + bd * bd) / (tw * tw + bw * bw + bd * bd) END AS bar_delta
        FROM (SELECT *, CASE WHEN count(*) {over(14)} = 14 THEN avg(tr) {over(14)} ELSE tr END AS atr0, sum((up OR down)::INT) {OV} AS seg FROM {p}g)),
    {p}s AS (SELECT symbol, seg, sum(bar_delta) AS raw, count(*) AS n, max(high) - min(low) AS rng, median(atr) AS med FROM {p}a GROUP BY 1, 2),
    {p}e AS (SELECT symbol, i, kind, price, v0, {ev} FROM (SELECT a.symbol, a.i, v.kind, CASE WHEN v.kind = 1 THEN greatest(high, h1) ELSE least(low, l1) END AS price, CASE WHEN v.kind = 1 OR NOT up THEN raw ELSE 0 END AS v0, n, rng, med
        FROM {p}a a JOIN {p}s s ON s.symbol = a.symbol AND s.seg = a.seg - 1, (VALUES (1), (-1)) v(kind) WHERE (v.kind = 1 AND up) OR (v.kind = -1 AND down))),
    {p}n AS (SELECT symbol, i, coalesce(v0 - lag(v0) OVER (PARTITION BY symbol ORDER BY i, kind DESC), 0) AS net FROM {p}e QUALIFY row_number() OVER (PARTITION BY symbol, i ORDER BY kind) = 1),
    {p}b AS (SELECT *, {prev} FROM {p}e WHERE kind = 1), {p}c AS (SELECT *, {prev} FROM {p}e WHERE kind = -1),
    {p}t AS (SELECT a.*, sum(a.bar_delta) OVER (PARTITION BY a.symbol, a.seg ORDER BY a.ts) AS swing_accum, coalesce(n.net, 0) AS net_swing_delta, {cols}, b.price AS sh, b.i AS shi, c.price AS sl, c.i AS sli
        FROM {p}a a ASOF LEFT JOIN {p}n n ON n.symbol = a.symbol AND a.i >= n.i ASOF LEFT JOIN {p}b b ON b.symbol = a.symbol AND a.i >= b.i ASOF LEFT JOIN {p}c c ON c.symbol = a.symbol AND a.i >= c.i)"""


def narrative_sql(p: str) -> str:
    """Common table expressions that end in {p}z, the narrative of {p}t."""
    z = "OVER (PARTITION BY symbol, isl ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
    return f"""{p}u AS (SELECT *, CASE WHEN atr > 1e-9 THEN atr ELSE 1 END AS scale, sum(flip) {OV} AS isl FROM (SELECT *, CASE WHEN (regime >= 0) <> (lag(regime) {OV} >= 0) THEN 1 ELSE 0 END AS flip FROM {p}t)),
    {p}z AS (SELECT *, (count(*) {z} - CASE WHEN isl = 0 THEN 1 ELSE 0 END)::DOUBLE AS regime_streak, (avg(regime) {over(5)} - avg(regime) {over(20)}) / scale AS regime_accel, sum(coalesce(close - pc, 0) / scale) {z} AS cum_disp_since_flip,
        CASE WHEN i = 1 THEN 0 ELSE (max(close) {z} - close) / scale END AS max_dd_since_flip, sum((up OR down)::INT) {z} AS swing_count_since_flip,
        CASE WHEN sh > sl THEN i - greatest(shi, sli) ELSE 0 END AS fib_range_age, CASE WHEN sh > sl THEN (sh - sl) / scale ELSE 0 END AS fib_range_size FROM {p}u)"""


_BASE = f"WITH RECURSIVE {WD[5:]}, {state_sql('d', 's')}"
_FIELDS = {"o": "open", "h": "high", "l": "low", "c": "close"}


def _fib_sql(slot: str) -> list[str]:
    ok = f"{slot}.sh > {slot}.sl"
    out = []
    for k, ratio in enumerate(lanes.RATIOS, 1):
        out += [r(f"CASE WHEN {ok} THEN (st.{c} - ({slot}.sl + {ratio} * ({slot}.sh - {slot}.sl))) / st.atr ELSE 0 END", f"kf_{slot}_{k}_{o}") for o, c in _FIELDS.items()]
        out.append(r(f"CASE WHEN {ok} THEN st.bar_delta ELSE 0 END", f"kf_{slot}_{k}_delta"))
    return out


def _above_sql(tf: str, p: str) -> str:
    return f"{macro_sql(tf, p + 'm')}, {closed_sql(tf, p + 'm')}, {state_sql(p + 'mc', p)}"


_SLOTS = lanes.SLOTS["1D"]
_ABOVE = ", ".join(_above_sql(tf, f"q{slot}") for slot, tf in _SLOTS.items())
_JOINED = "FROM st " + " ".join(f"ASOF LEFT JOIN q{slot}t {slot} ON {slot}.symbol = st.symbol AND st.ts >= {slot}.close_ts" for slot in _SLOTS)
_FIB = [c for slot in _SLOTS for c in _fib_sql(slot)]
_TS = "epoch(st.ts)::BIGINT AS ts_s"


@query("f22_completed_swings", f"{_BASE} SELECT symbol, {T}, {', '.join(r(c, c) for c in lanes.DIRECTIONAL)} FROM st")
def _(spark, sf):
    return rows(lanes.state(B.bars_1d(spark, sf)), *lanes.DIRECTIONAL)


@query("f23_fib_observation", f"{_BASE}, {_ABOVE} SELECT st.symbol, {_TS}, {', '.join(_FIB)} {_JOINED}")
def _(spark, sf):
    d = B.bars_1d(spark, sf)
    x = lanes.state(d)
    for slot, tf in _SLOTS.items():
        x = lanes.retracements(x, lanes.state(core.close_time(core.resample(d, tf), tf)), slot)
    return rows(x, *[c for slot in _SLOTS for c in lanes.fib_columns(slot)])


@query(
    "f24_kalman_lane",
    f"{_BASE}, {_ABOVE} SELECT st.symbol, {_TS}, {', '.join(r('st.' + c, 'kf_' + c) for c in lanes.STATE)}, {', '.join(_FIB)}, "
    + ", ".join(r(f"coalesce({slot}.{c}, 0)", f"kf_{tf.lower()}_{c}") for slot, tf in _SLOTS.items() for c in lanes.STATE)
    + f" {_JOINED}",
)
def _(spark, sf):
    x = lanes.filter_lane(B.bars_1d(spark, sf))
    return rows(x, *x.columns[2:])


@query("f25_narrative", f"{_BASE}, {narrative_sql('s')} SELECT symbol, {T}, {', '.join(r(c, c) for c in lanes.NARRATIVE)} FROM sz")
def _(spark, sf):
    return rows(lanes.narrative(lanes.state(B.bars_1d(spark, sf))), *lanes.NARRATIVE)


_STORY = {"w": "1W", "m": "1M"}
_SIGNS = "sign(s.regime)" + "".join(f" + coalesce(sign({p}.regime), 0)" for p in _STORY)


@query(
    "f26_narrative_lane",
    f"{_BASE}, {narrative_sql('s')}, "
    + ", ".join(f"{_above_sql(tf, 'q' + p)}, {narrative_sql('q' + p)}, q{p}y AS (SELECT * FROM q{p}z QUALIFY count(*) OVER (PARTITION BY symbol) >= 3)" for p, tf in _STORY.items())
    + f" SELECT s.symbol, epoch(s.ts)::BIGINT AS ts_s, {', '.join(r('s.' + c, 'nc_' + c) for c in lanes.NARRATIVE)}, "
    + ", ".join(r(f"coalesce({p}.{c}, 0)", f"nc_{tf.lower()}_{c}") for p, tf in _STORY.items() for c in lanes.NARRATIVE)
    + f", {r(_SIGNS, 'nc_cross_tf_sum')}, {r(f'abs({_SIGNS})', 'nc_cross_tf_abs')} FROM sz s "
    + " ".join(f"ASOF LEFT JOIN q{p}y {p} ON {p}.symbol = s.symbol AND s.ts >= {p}.close_ts" for p in _STORY),
)
def _(spark, sf):
    x = lanes.narrative_lane(B.bars_1d(spark, sf))
    return rows(x, *x.columns[2:])
