"""Queries of labels, geometry, logs, sinks and streams (L, F27-F29, I, X, R rows)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronolith.functions.exprs import r6, seconds, series, w
from chronolith.operators import core, features, holographic, labels
from chronolith.plans.bars import ATR, closed_sql, macro_sql
from chronolith.plans.base import OV, T, WD, WH, H, fore, over, query, r
from chronolith.plans.features import KF, WKF, cols, lim, rows
from chronolith.sources import artifacts, bars as B
from chronolith.sources import logs, sinks
from chronolith.streaming import bars as X

# ---- labels --------------------------------------------------------------------------------------------------------

_NAMES = ("target", "next_ret_pct", "bars_to_target", "entry_price", "target_distance", "long_path_r", "short_path_r", "target_edge_r", "best_path_r", "long_mfe_atr", "long_mae_atr", "short_mfe_atr", "short_mae_atr")


def labelled(spark, sf) -> DataFrame:
    return labels.labelled(core.atr(B.bars_1d(spark, sf)), horizon=labels.LANES["1D"][1])


@query("l2_labels_1d")
def _(spark, sf):
    return rows(labelled(spark, sf), *_NAMES)


@query("l1_path_sim")
def _(spark, sf):
    x = labelled(spark, sf).where("long_path_r is not null")
    return x.select("symbol", seconds().alias("ts_s"), r6("long_path_r").alias("long_path_r"), F.col("long_reason").cast("int").alias("reason"), F.col("long_bars").cast("int").alias("bars"))


@query("l2_excursions", f"""{WD}, {ATR}, x AS (SELECT *, lead(open) {OV} * 1.0003 AS e, count(*) {fore(1, 10)} = 10 AS ok, max(high) {fore(1, 10)} AS hi, min(low) {fore(1, 10)} AS lo FROM atr)
    SELECT symbol, {T}, {r('CASE WHEN ok THEN e END', 'entry_price')}, {r('CASE WHEN ok THEN greatest(0, (hi - e) / (atr14 + 1e-9)) END', 'long_mfe_atr')}, {r('CASE WHEN ok THEN greatest(0, (e - lo) / (atr14 + 1e-9)) END', 'long_mae_atr')} FROM x""")
def _(spark, sf):
    return rows(labelled(spark, sf), "entry_price", "long_mfe_atr", "long_mae_atr")


@query("l3_label_bridge", None)
def _(spark, sf):
    x = labelled(spark, sf).where("target is not null and target <> 0.5")
    return rows(x, "target", "target_edge_r")


@query("m18_exit_surface")
def _(spark, sf):
    x = labels.exit_surface(core.atr(B.bars_1d(spark, sf)))
    g = labels.surface_groups(x, B.oos(B.bars_1d(spark, sf)))
    best = g.groupBy("group").agg(F.max(F.struct("avg_r", "win_rate", "samples", "template")).alias("b"))
    return best.select("group", F.col("b.template").alias("template"), r6("b.avg_r").alias("avg_r"), r6("b.win_rate").alias("win_rate"), F.col("b.samples").alias("samples"))


def _replayed(spark, sf) -> DataFrame:
    d = core.numbered(core.atr(B.bars_1d(spark, sf)))
    x = labels.labelled(d).join(d.select("symbol", "ts", "i"), ["symbol", "ts"]).join(B.oos(B.bars_1d(spark, sf)), ["symbol", "ts"])
    return labels.replay(x)


@query("r1_event_replay")
def _(spark, sf):
    return _replayed(spark, sf).select("symbol", seconds().alias("ts_s"), "direction", "i", "exit_i", r6("r").alias("r"), r6("equity").alias("equity"))


@query("r2_strategy_zoo")
def _(spark, sf):
    d = core.numbered(core.atr(B.bars_1d(spark, sf)))
    x = labels.labelled(d).join(d.select("symbol", "ts", "i"), ["symbol", "ts"]).join(B.oos(B.bars_1d(spark, sf)), ["symbol", "ts"])
    out = None
    for t in (0.5, 0.6, 0.7, 0.8, 0.9):
        g = labels.replay(x, t).groupBy("symbol").agg(F.count(F.lit(1)).alias("trades"), F.avg("r").alias("avg_r")).withColumn("threshold", F.lit(t))
        out = g if out is None else out.unionByName(g)
    best = out.groupBy("symbol").agg(F.max(F.struct("avg_r", "trades", "threshold")).alias("b"))
    return best.select("symbol", F.col("b.threshold").alias("threshold"), F.col("b.trades").alias("trades"), r6("b.avg_r").alias("avg_r"))


# ---- geometry ------------------------------------------------------------------------------------------------------


def _holo_sql(n: int) -> str:
    lst = lambda c: f"list({c}) {over(n)}"
    parts = {f"d_w{n}_bar1_close": "nc[1]", f"d_w{n}_bar{n}_close": f"nc[{n}]", f"d_w{n}_bar1_norm_bias": "nb[1]", f"d_w{n}_bar{n}_norm_bias": f"nb[{n}]", f"d_w{n}_gram_nb_lag0": f"nb[{n}]", f"d_w{n}_gram_vb_lag0": "vb"}
    return f"""{WD}, h0 AS (SELECT symbol, ts, row_number() {OV} AS i, max(high) {over(n)} AS hi, min(low) {over(n)} AS lo, {lst('close')} AS cl, {lst('open')} AS ol, {lst('volume')} AS vl FROM d), h1 AS (SELECT *, hi - lo AS rng, list_sum(vl) AS tv, list_sum([CASE WHEN 2 * cl[k] - coalesce(cl[k - 1], cl[k]) - ol[k] > 0 THEN vl[k] WHEN 2 * cl[k] - coalesce(cl[k - 1], cl[k]) - ol[k] < 0 THEN -vl[k] ELSE 0 END FOR k IN range(1, {n + 1})]) AS sd FROM h0 WHERE i >= {n} AND hi - lo >= 1e-9),
    h2 AS (SELECT symbol, ts, {lim('sd / (tv + 1e-9)', -1, 1)} AS vb, [{lim('(x - lo) / (rng + 1e-9)', 0, 1)} FOR x IN cl] AS nc, [{lim('(((x - lo) - (hi - x)) / (rng + 1e-9) + 1) / 2', 0, 1)} FOR x IN cl] AS nb FROM h1) SELECT symbol, {T}, {', '.join(r(e, c) for c, e in parts.items())} FROM h2"""


for _n in (3, 5, 8, 13, 21):

    def _holo(spark, sf, n=_n):
        x = holographic.window_columns(B.bars_1d(spark, sf), "d", n)
        names = [f"d_w{n}_bar1_close", f"d_w{n}_bar{n}_close", f"d_w{n}_bar1_norm_bias", f"d_w{n}_bar{n}_norm_bias", f"d_w{n}_gram_nb_lag0", f"d_w{n}_gram_vb_lag0"]
        return rows(x.where(F.col(names[0]).isNotNull()), *names)

    query(f"f27_holographic_w{_n}", _holo_sql(_n))(_holo)


@query("f27_spectral", f"""{WD}, h0 AS (SELECT symbol, ts, row_number() {OV} AS i, max(high) {over(13)} AS hi, min(low) {over(13)} AS lo, list(close) {over(13)} AS cl FROM d), h1 AS (SELECT symbol, ts, [(x - lo) / (hi - lo + 1e-9) FOR x IN cl] AS nc FROM h0 WHERE i >= 13 AND hi - lo >= 1e-9), u AS (SELECT symbol, ts, k, nc[k] AS a, nc[k - 1] AS b, nc[k - 3] AS c FROM h1, range(1, 14) t(k))
    SELECT symbol, {T}, {r('corr(a, b) FILTER (k >= 2)', 'ac1')}, {r('corr(a, c) FILTER (k >= 4)', 'ac3')} FROM u GROUP BY symbol, ts""")
def _(spark, sf):
    x = holographic.window_columns(B.bars_1d(spark, sf), "d", 13).where("d_w13_bar1_close is not null")
    return x.select("symbol", seconds().alias("ts_s"), r6("d_w13_fft_nc_ac1").alias("ac1"), r6("d_w13_fft_nc_ac3").alias("ac3"))


def skeleton_sql(source: str, name: str, n: int) -> str:
    """Common table expressions up to ``name``: the skeleton of each filled window of n bars of a source of bars."""
    lst = lambda c: f"list({c}) {over(n)}"
    inner = f"range(2, {n})"
    return f"""{name}0 AS (SELECT *, row_number() {OV} AS i, max(high) {over(n)} AS hi, min(low) {over(n)} AS lo, {lst('close')} AS cl, {lst('volume')} AS vl FROM {source}),
    {name}1 AS (SELECT *, CASE WHEN hi - lo < 1e-9 THEN greatest(list_median(cl) * 1e-5, 1e-9) ELSE hi - lo END AS rng, list_sum(vl) AS tv FROM {name}0 WHERE i >= {n}),
    {name}2 AS (SELECT *, [{lim('(x - lo) / (rng + 1e-9)', 0, 1)} FOR x IN cl] AS nc, {lim('(((close - lo) - (hi - close)) / (rng + 1e-9) + 1) / 2', 0, 1)} AS bias FROM {name}1),
    {name}3 AS (SELECT *, [k FOR k IN {inner} IF nc[k] > nc[k - 1] AND nc[k] > nc[k + 1] AND nc[k] - greatest(nc[k - 1], nc[k + 1]) >= 0.05] AS pk, [k FOR k IN {inner} IF nc[k] < nc[k - 1] AND nc[k] < nc[k + 1] AND least(nc[k - 1], nc[k + 1]) - nc[k] >= 0.05] AS tr FROM {name}2),
    {name}4 AS (SELECT *, nc[{n}] AS last, CASE WHEN len(pk) > 0 THEN nc[pk[-1]] ELSE 1 END AS top, CASE WHEN len(tr) > 0 THEN nc[tr[-1]] ELSE 0 END AS bottom FROM {name}3),
    {name} AS (SELECT *, CASE WHEN last > top THEN CASE WHEN len(pk) >= 2 AND top < nc[pk[1]] THEN 2.0 ELSE 1.0 END WHEN last < bottom THEN CASE WHEN len(tr) >= 2 AND bottom > nc[tr[1]] THEN -2.0 ELSE -1.0 END ELSE 0.0 END::DOUBLE AS phase,
      CASE WHEN len(pk) > 0 THEN CASE WHEN tv > 1e-9 THEN {lim('vl[pk[-1]] / tv', 0, 1)} ELSE 1.0 / {n} END ELSE 0 END AS held FROM {name}4)"""


def confluence_sql(base: str, second: str, third: str, closed: str) -> str:
    """The lane's agreement z over skeletons a (of the base), b and c of higher bars; ``closed`` is the suffix of frames that hold close_ts."""
    at = lambda n, step: f"{n}x AS (SELECT *, {'close_ts' if closed and n == 'c' else f'ts + interval {step}'} AS seen FROM {n})"
    phases = "(a.phase, bx.phase, cx.phase)"
    same = lambda op: " AND ".join(f"coalesce({p}, 0) {op} 0" for p in phases.strip("()").split(", "))
    return f"""{at('b', second)}, {at('c', third)}, z AS (SELECT q.symbol, q.ts, CASE WHEN {same('>')} THEN 1.0 WHEN {same('<')} THEN -1.0 ELSE 0.0 END::DOUBLE AS sync, (coalesce(a.last, 0) - coalesce(bx.bottom, 0)) / (coalesce(bx.top, 1) - coalesce(bx.bottom, 0) + 1e-9) AS zone
      FROM {base} q LEFT JOIN a ON a.symbol = q.symbol AND a.ts = q.ts ASOF LEFT JOIN bx ON bx.symbol = q.symbol AND q.ts >= bx.seen ASOF LEFT JOIN cx ON cx.symbol = q.symbol AND q.ts >= cx.seen)"""


@query("f27_skeleton", f"""{WD}, {skeleton_sql('d', 'a', 13)} SELECT symbol, {T}, {r('phase', 'd_w13_skel_smc_phase')}, {r('CASE WHEN last < bottom AND bias > 0.7 THEN 1 ELSE 0 END', 'd_w13_skel_liquidity_grab')}, {r('held * abs(phase)', 'd_w13_skel_ob_validity')}, {r('top', 'd_w13_skel_last_swing_high')}, {r('bottom', 'd_w13_skel_last_swing_low')} FROM a""")
def _(spark, sf):
    x = holographic.window_columns(B.bars_1d(spark, sf), "d", 13).where("d_w13_bar1_close is not null")
    return rows(x, *[c for c in x.columns if "_skel_" in c])


def _frames(spark, sf) -> dict[str, DataFrame]:
    daily = B.bars_1d(spark, sf)
    return {"1d": daily} | {tf.lower(): core.close_time(core.resample(daily, tf), tf) for tf in ("1W", "1M", "3M")}


@query("f29_holographic_lane_1d")
def _(spark, sf):
    x = holographic.lane(_frames(spark, sf), holographic.WINDOWS_1D, "1d", digits=6)
    return x.withColumn("ts", seconds()).withColumnRenamed("ts", "ts_s")


_D_SK = f"{WD}, {macro_sql('1W', 'wk')}, {macro_sql('1M')}, {closed_sql('1M')}, {skeleton_sql('d', 'a', 13)}, {skeleton_sql('wk', 'b', 8)}, {skeleton_sql('mc', 'c', 5)}"


@query("f28_confluence", f"{_D_SK}, {confluence_sql('d', '7 day', '1 month', 'mc')} SELECT symbol, {T}, sync AS mtf_conf_smc_sync, {r('zone', 'mtf_conf_pd_zone')} FROM z")
def _(spark, sf):
    x = holographic.lane_blocks(_frames(spark, sf), {"1d": (13,), "1w": (8,), "1m": (5,)}, "1d")
    got = holographic.confluence("1d")
    return x.select("symbol", seconds().alias("ts_s"), got["mtf_conf_smc_sync"].alias("mtf_conf_smc_sync"), r6(got["mtf_conf_pd_zone"]).alias("mtf_conf_pd_zone"))


_TR = lambda n, tf: f"{macro_sql(tf, n)}, {closed_sql(tf, n)}, {n}t AS (SELECT symbol, close_ts, CASE WHEN count(*) {over(3)} = 3 THEN {lim(f'(close - first(close) {over(3)}) / (max(high) {over(3)} - min(low) {over(3)} + 1e-9)', -1, 1)} ELSE 0 END AS trend FROM {n}c)"


@query("f35_daily_confluence", f"{WD}, {skeleton_sql('d', 'a', 13)}, {_TR('half', '6M')}, {_TR('year', '12M')} SELECT d.symbol, epoch(d.ts)::BIGINT AS ts_s, (sign(coalesce(a.phase, 0)) * sign(coalesce(halft.trend, 0) + coalesce(yeart.trend, 0)))::DOUBLE + 0.0 AS confluence FROM d LEFT JOIN a ON a.symbol = d.symbol AND a.ts = d.ts ASOF LEFT JOIN halft ON halft.symbol = d.symbol AND d.ts >= halft.close_ts ASOF LEFT JOIN yeart ON yeart.symbol = d.symbol AND d.ts >= yeart.close_ts")
def _(spark, sf):
    daily = B.bars_1d(spark, sf)
    x = holographic.window_columns(daily, "1d", 13).select("symbol", "ts", F.col("1d_w13_skel_smc_phase").alias("phase"))
    for tf in ("6M", "12M"):
        m = core.close_time(core.macro_regime(core.resample(daily, tf)), tf).select("symbol", "close_ts", F.col("trend").alias(f"trend_{tf.lower()}"))
        x = core.as_of(x, m, prefix="").drop("close_ts")
    trend = F.coalesce("trend_6m", F.lit(0.0)) + F.coalesce("trend_12m", F.lit(0.0))
    return x.select("symbol", seconds().alias("ts_s"), (F.signum(F.coalesce("phase", F.lit(0.0))) * F.signum(trend) + F.lit(0.0)).alias("confluence"))


# ---- logs -------------------------------------------------------------------------------------------------------

@query("i2_log_parse", f"{WH} SELECT upper(symbol) AS symbol, {r('round(open, 2)', 'open')}, {r('round(high, 2)', 'high')}, {r('round(low, 2)', 'low')}, {r('round(close, 2)', 'close')}, {r('volume', 'volume')}, '1H' AS timeframe, {T} FROM h")
def _(spark, sf):
    x = logs.parse(logs.messages(B.bars_1h(spark, sf)))
    return x.select("symbol", *[r6(c).alias(c) for c in ("open", "high", "low", "close", "volume")], "timeframe", "ts_s")


@query("i3_time_column", "SELECT l_returnflag AS symbol, count(*) AS n, min(epoch(l_shipdate)::BIGINT) AS first_s FROM lineitem GROUP BY 1")
def _(spark, sf):
    x = B.table(spark, sf, "lineitem").select(F.col("l_returnflag").alias("symbol"), F.when(F.col("l_linenumber") % 2 == 0, F.date_format("l_shipdate", "yyyy-MM-dd HH:mm:ss")).otherwise("n/a").alias("time"), F.date_format("l_shipdate", "yyyy-MM-dd").alias("date"))
    return x.groupBy("symbol").agg(F.count(logs.first_time("time", "date")).alias("n"), F.min(F.unix_timestamp(logs.first_time("time", "date"))).alias("first_s"))


@query("i4_epoch_units", "SELECT o_orderstatus AS status, o_orderkey, (epoch(o_orderdate)::BIGINT) AS seconds FROM orders")
def _(spark, sf):
    scale = F.when(F.col("o_orderstatus") == "F", 1).when(F.col("o_orderstatus") == "O", 1000).otherwise(1_000_000).cast("double")
    x = B.table(spark, sf, "orders").select(F.col("o_orderstatus").alias("status"), "o_orderkey", (F.unix_timestamp(F.col("o_orderdate").cast("timestamp")) * scale).alias("v"))
    return logs.epoch_seconds(x, "v", "status").select("status", "o_orderkey", "seconds")


# ---- sinks ---------------------------------------------------------------------------------------------------------


@query("i8_parent_quality", f"{WD}, {macro_sql('1M')}, q AS (SELECT symbol, count(*) AS rows FROM d GROUP BY 1) SELECT m.symbol, epoch(m.ts)::BIGINT AS ts_s, q.rows FROM m JOIN q USING (symbol)")
def _(spark, sf):
    d = B.bars_1d(spark, sf)
    return core.resample(d, "1M").join(d.groupBy("symbol").agg(F.count(F.lit(1)).alias("rows")), "symbol").select("symbol", seconds().alias("ts_s"), "rows")


@query("i9_atomic_replace", f"{WD} SELECT symbol, {T}, {r('CASE WHEN symbol = ' + repr('A') + ' THEN close * 2 ELSE close END', 'close')} FROM d WHERE symbol <> 'A' OR year(ts) >= 1998")
def _(spark, sf):
    d = B.bars_1d(spark, sf).select("symbol", "ts", "close")
    x = sinks.replaced(d, d.where("symbol = 'A' and year(ts) >= 1998").withColumn("close", F.col("close") * 2), "symbol")
    return x.select("symbol", seconds().alias("ts_s"), r6("close").alias("close"))


@query("i10_quality_upsert", f"""{WD}, a AS (SELECT symbol, month(ts)::INT AS part, 1 AS run, count(*) AS n, CASE WHEN count(*) FILTER (volume < 30) > 10 THEN 'WARN' ELSE 'PASS' END AS status FROM d WHERE year(ts) < 1998 GROUP BY 1, 2),
    b AS (SELECT symbol, month(ts)::INT AS part, 2 AS run, count(*) AS n, CASE WHEN count(*) FILTER (volume < 30) > 10 THEN 'WARN' ELSE 'PASS' END AS status FROM d WHERE year(ts) >= 1998 GROUP BY 1, 2) SELECT symbol, part, n, status, run FROM (SELECT * FROM a UNION ALL SELECT * FROM b) QUALIFY row_number() OVER (PARTITION BY symbol, part ORDER BY run DESC) = 1""")
def _(spark, sf):
    d = B.bars_1d(spark, sf)
    status = F.when(F.count_if(F.col("volume") < 30) > 10, "WARN").otherwise("PASS")
    run = lambda x, k: x.groupBy("symbol", F.month("ts").alias("part")).agg(F.lit(k).alias("run"), F.count(F.lit(1)).alias("n"), status.alias("status"))
    x = sinks.upserted(run(d.where("year(ts) < 1998"), 1), run(d.where("year(ts) >= 1998"), 2), ("symbol", "part"), "run")
    return x.select("symbol", "part", "n", "status", "run")


@query("i11_schema_widening", f"{WD} SELECT symbol, {T}, {r('close', 'close')}, CASE WHEN year(ts) >= 2000 THEN month(ts) END AS extra FROM d")
def _(spark, sf):
    d = B.bars_1d(spark, sf).select("symbol", "ts", "close")
    x = sinks.widened(d.where("year(ts) < 2000"), d.where("year(ts) >= 2000").withColumn("extra", F.month("ts").cast("long")))
    return x.select("symbol", seconds().alias("ts_s"), r6("close").alias("close"), "extra")


@query("i13_artifacts", f"{WD} SELECT symbol, count(*) AS n, {r('avg(close)', 'mean')}, 2::BIGINT AS version FROM d GROUP BY 1")
def _(spark, sf):
    """Saved twice under an old name, moved to the new one, and the latest version read."""
    g = B.bars_1d(spark, sf).groupBy("symbol").agg(F.count(F.lit(1)).alias("n"), F.avg("close").alias("mean"))
    store = artifacts.Store(spark, sinks.place(spark, "artifacts"))
    store.save(g.limit(1), "old/means")
    version = store.save(g, "old/means", {"unit": "price"})
    store.migrate({"old/means": "daily/means"})
    return store.load("daily/means").select("symbol", "n", r6("mean").alias("mean"), F.lit(version).cast("long").alias("version"))


@query("i14_json_forecast", """SELECT l_returnflag AS symbol, '{' || chr(10) || '  "bars": ' || count(*) || ',' || chr(10) || '  "horizon": null,' || chr(10) || '  "symbol": "' || l_returnflag || '"' || chr(10) || '}' AS payload FROM lineitem GROUP BY 1""")
def _(spark, sf):
    """Forecast files written by symbol and read back."""
    g = B.table(spark, sf, "lineitem").groupBy(F.col("l_returnflag").alias("symbol")).agg(F.count(F.lit(1)).alias("n"))
    path = sinks.place(spark, "forecasts")
    g.select("symbol", artifacts.pretty({"symbol": F.col("symbol"), "bars": F.col("n"), "horizon": F.lit(None).cast("double")}).alias("value")).write.partitionBy("symbol").text(path)
    return spark.read.text(path, wholetext=True).select("symbol", F.rtrim("value", F.lit("\n")).alias("payload"))


# ---- streams -------------------------------------------------------------------------------------------------------

_BAR = f"{WH} SELECT symbol, {T}, {r('open', 'open')}, {r('high', 'high')}, {r('low', 'low')}, {r('close', 'close')}, volume::BIGINT AS volume FROM h"


@query("x3_stream_hourly_bars", _BAR)
def _(spark, sf):
    x = X.latest(X.drained(X.hourly(X.events(spark, sf)), "update"), "symbol", "ts")
    return x.select("symbol", seconds().alias("ts_s"), *[r6(c).alias(c) for c in ("open", "high", "low", "close")], "volume")


@query("x2_stream_revisions", _BAR)
def _(spark, sf):
    stream = X.hourly(X.events(spark, sf), "180 days")
    x = X.latest(X.drained(stream, "update"), "symbol", "ts")
    return x.select("symbol", seconds().alias("ts_s"), *[r6(c).alias(c) for c in ("open", "high", "low", "close")], "volume")


@query("x4_stream_sessions", f"""WITH s AS (SELECT event_type AS symbol, ts, value, CASE WHEN ts - lag(ts) OVER (PARTITION BY event_type ORDER BY ts) < interval 30 minute THEN 0 ELSE 1 END AS b FROM events), g AS (SELECT *, sum(b) OVER (PARTITION BY symbol ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM s) SELECT symbol, floor(epoch(min(ts)))::BIGINT AS ts_s, count(*) AS n, {r('max(value)', 'high')} FROM g GROUP BY symbol, k""")
def _(spark, sf):
    x = X.latest(X.drained_complete(X.sessions(X.events(spark, sf), delay="3650 days")), "symbol", "ts")
    return x.select("symbol", seconds().alias("ts_s"), "n", r6("high").alias("high"))


@query("x6_stream_filter_state", f"""WITH RECURSIVE x AS (SELECT event_type AS symbol, value, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) AS i FROM events), k AS (SELECT symbol, 1::BIGINT AS i, value AS x, 1.0::DOUBLE AS p FROM x WHERE i = 1 UNION ALL SELECT k.symbol, x.i, k.x + (k.p + 0.001) / (k.p + 1.001) * (x.value - k.x), (1 - (k.p + 0.001) / (k.p + 1.001)) * (k.p + 0.001) FROM k JOIN x ON x.symbol = k.symbol AND x.i = k.i + 1)
    SELECT symbol, i AS n, {r('x', 'state')} FROM k QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY i DESC) = 1""")
def _(spark, sf):
    x = X.latest(X.drained(X.filtered(X.events(spark, sf)), "update"), "symbol")
    return x.select("symbol", "n", r6("state").alias("state"))


@query("x1_stream_available_now", f"SELECT event_type AS symbol, count(*) AS n FROM events WHERE value > 100 GROUP BY 1")
def _(spark, sf):
    x = X.drained(X.events(spark, sf).where("value > 100").select("event_id", "event_type"))
    return x.groupBy(F.col("event_type").alias("symbol")).agg(F.count(F.lit(1)).alias("n"))
