"""Queries over bars: sources, resampling, audits, filters, joins (I, A1-A8, P, J, S rows)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from chronolith.functions.exprs import div, finite, r6, seconds, series, upto, w, whole
from chronolith.operators import core, quality
from chronolith.plans.base import OV, SQL, T, WD, WH, D, H, over, query, r
from chronolith.plans.flagship import flagship
from chronolith.sources import bars as B

_OHLCV = ", ".join(r(c, c) for c in ("open", "high", "low", "close", "volume"))


def show(df: DataFrame, *floats: str, keep: tuple[str, ...] = ("symbol",)) -> DataFrame:
    return df.select(*keep, seconds().alias("ts_s"), *[r6(c).alias(c) for c in floats])


def bars_columns(df: DataFrame) -> DataFrame:
    return show(df, "open", "high", "low", "close", "volume")


# ---- sources -------------------------------------------------------------------------------------------------------


@query("i1_bars_1h", f"{WH} SELECT symbol, {T}, {_OHLCV} FROM h")
def _(spark: SparkSession, sf: str) -> DataFrame:
    return bars_columns(B.bars_1h(spark, sf))


@query("i1_bars_1d", f"{WD} SELECT symbol, {T}, {_OHLCV} FROM d")
def _(spark, sf):
    return bars_columns(B.bars_1d(spark, sf))


@query("i7_scan_pushdown", f"{WD} SELECT symbol, {T}, {r('close', 'close')} FROM d WHERE symbol = 'A' AND ts >= TIMESTAMP '1998-01-01'")
def _(spark, sf):
    return show(B.bars_1d(spark, sf).where("symbol = 'A' and ts >= timestamp '1998-01-01'"), "close")


@query("s1_latest_bars", f"{WD} SELECT symbol, {T}, {r('close', 'close')} FROM d QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY ts DESC) <= 150")
def _(spark, sf):
    return show(core_tail(B.bars_1d(spark, sf), 150), "close")


def core_tail(df: DataFrame, n: int) -> DataFrame:
    return df.withColumn("rn", F.row_number().over(Window.partitionBy("symbol").orderBy(F.desc("ts")))).where(F.col("rn") <= n)


@query("s3_last_bar", f"{WD} SELECT symbol, {T}, {r('close', 'close')} FROM d QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY ts DESC) = 1")
def _(spark, sf):
    return show(core_tail(B.bars_1d(spark, sf), 1), "close")


# ---- resampling ----------------------------------------------------------------------------------------------------

_PERIOD = {"1W": "isoyear(ts) * 100 + weekofyear(ts)", "1M": "year(ts) * 100 + month(ts) - 1", "3M": "year(ts) * 100 + (month(ts) - 1) // 3", "6M": "year(ts) * 100 + (month(ts) - 1) // 6", "12M": "year(ts) * 100"}


def macro_sql(tf: str, name: str = "m") -> str:
    return f"{name} AS (SELECT symbol, min(ts) AS ts, arg_min(open, ts) AS open, max(high) AS high, min(low) AS low, arg_max(close, ts) AS close, sum(volume) AS volume, count(*) AS bars FROM d GROUP BY symbol, {_PERIOD[tf]})"


def closed_sql(tf: str, name: str = "m") -> str:
    n = {"1W": "interval 7 day", "1D": "interval 1 day"}.get(tf)
    end = f"ts + {n}" if n else f"coalesce(lead(ts) {OV}, ts + interval {core.MONTHS[tf]} month)"
    return f"{name}c AS (SELECT *, {end} AS close_ts FROM {name})"


for _tf in _PERIOD:
    _sql = f"{WD}, {macro_sql(_tf)} SELECT symbol, {T}, {_OHLCV}, bars FROM m"

    def _macro(spark, sf, tf=_tf):
        return show(core.resample(B.bars_1d(spark, sf), tf), "open", "high", "low", "close", "volume").join(core.resample(B.bars_1d(spark, sf), tf).select("symbol", seconds().alias("ts_s"), "bars"), ["symbol", "ts_s"])

    def _macro(spark, sf, tf=_tf):  # noqa: F811
        return core.resample(B.bars_1d(spark, sf), tf).select("symbol", seconds().alias("ts_s"), *[r6(c).alias(c) for c in ("open", "high", "low", "close", "volume")], "bars")

    query(f"a1_macro_resample_{_tf.lower()}", _sql)(_macro)

    def _closed(spark, sf, tf=_tf):
        return core.close_time(core.resample(B.bars_1d(spark, sf), tf), tf).select("symbol", seconds().alias("ts_s"), seconds("close_ts").alias("close_s"))

    query(f"j1_close_shift_{_tf.lower()}", f"{WD}, {macro_sql(_tf)}, {closed_sql(_tf)} SELECT symbol, {T}, epoch(close_ts)::BIGINT AS close_s FROM mc")(_closed)

    def _mapped(spark, sf, tf=_tf, unit=None):
        daily = B.bars_1d(spark, sf)
        htf = core.close_time(core.resample(daily, tf), tf).select("symbol", "close_ts", F.col("close").alias("htf_close"))
        got = core.as_of(daily, htf, prefix="", unit=unit)
        return got.select("symbol", seconds().alias("ts_s"), r6("close").alias("close"), r6(F.coalesce("htf_close", F.lit(0.0))).alias("htf_close"))

    _J2 = f"{WD}, {macro_sql(_tf)}, {closed_sql(_tf)} SELECT d.symbol, epoch(d.ts)::BIGINT AS ts_s, {r('d.close', 'close')}, {r('coalesce(mc.close, 0)', 'htf_close')} FROM d ASOF LEFT JOIN mc ON d.symbol = mc.symbol AND d.ts >= mc.close_ts"
    query(f"j2_asof_{_tf.lower()}", _J2)(_mapped)
    # The same by slices of a year, which no task exceeds.
    query(f"j2_asof_{_tf.lower()}_by_slice", _J2)(lambda spark, sf, f=_mapped: f(spark, sf, unit="year"))


@query("j3_asof_closed_count", f"{WD}, {macro_sql('1M')}, {closed_sql('1M')}, k AS (SELECT *, row_number() {OV} AS i, avg(close) {over(3)} AS mean3 FROM mc) SELECT d.symbol, epoch(d.ts)::BIGINT AS ts_s, coalesce(k.i, 0)::BIGINT AS closed, {r('k.mean3', 'mean3')} FROM d ASOF LEFT JOIN k ON d.symbol = k.symbol AND d.ts >= k.close_ts")
def _(spark, sf):
    daily = B.bars_1d(spark, sf)
    htf = core.numbered(core.close_time(core.resample(daily, "1M"), "1M")).withColumn("mean3", F.avg("close").over(w(3))).select("symbol", "close_ts", "i", "mean3")
    return core.as_of(daily, htf, prefix="").select("symbol", seconds().alias("ts_s"), F.coalesce("i", F.lit(0)).cast("long").alias("closed"), r6("mean3").alias("mean3"))


@query(
    "j4_asof_tolerance_ffill",
    f"""{WD}, {macro_sql('1W')}, k AS (SELECT symbol, ts + interval 7 day AS close_ts, close FROM m WHERE hash_free(ts)),
    j AS (SELECT d.symbol, d.ts, CASE WHEN d.ts - k.close_ts <= interval 14 day THEN k.close END AS v FROM d ASOF LEFT JOIN k ON d.symbol = k.symbol AND d.ts >= k.close_ts)
    SELECT symbol, {T}, {r('last_value(v IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)', 'week_close')} FROM j""".replace("hash_free(ts)", "month(ts) <> 7"),
)
def _(spark, sf):
    daily = B.bars_1d(spark, sf)
    # July's weeks are left out, so that the tolerance of 14 days is reached and the fill shows.
    weekly = core.resample(daily, "1W").where("month(ts) <> 7").select("symbol", (F.col("ts") + F.expr("interval 7 days")).alias("close_ts"), F.col("close").alias("v"))
    got = core.as_of(daily, weekly, tolerance="interval 14 days", prefix="")
    return got.select("symbol", seconds().alias("ts_s"), r6(F.last("v", True).over(upto())).alias("week_close"))


@query(
    "j5_macro_regime_asof",
    f"""{WD}, {macro_sql('6M')}, g AS (SELECT *, lead(ts) {OV} AS nxt FROM m), med AS (SELECT symbol, quantile_cont(epoch(nxt) - epoch(ts), 0.5) AS gap FROM g WHERE nxt IS NOT NULL GROUP BY 1),
    x AS (SELECT g.symbol, coalesce(epoch(nxt), epoch(ts) + gap)::BIGINT AS close_s, CASE WHEN count(*) {over(3)} = 3 THEN greatest(-1, least(1, (close - first(close) {over(3)}) / (max(high) {over(3)} - min(low) {over(3)} + 1e-9))) ELSE 0 END AS trend,
      CASE WHEN count(*) {over(3)} = 3 THEN greatest(0, least(1, (close - min(low) {over(3)}) / (max(high) {over(3)} - min(low) {over(3)} + 1e-9))) ELSE 0.5 END AS range_pos FROM g JOIN med USING (symbol))
    SELECT dd.symbol, dd.ts_s, {r('coalesce(x.trend, 0)', 'trend')}, {r('coalesce(x.range_pos, 0.5)', 'range_pos')} FROM (SELECT symbol, epoch(ts)::BIGINT AS ts_s FROM d) dd ASOF LEFT JOIN x ON dd.symbol = x.symbol AND dd.ts_s >= x.close_s""",
)
def _(spark, sf):
    daily = B.bars_1d(spark, sf)
    macro = core.macro_regime(core.resample(daily, "6M")).withColumn("s", seconds()).withColumn("nxt", F.lead("s").over(series()))
    gap = F.expr("percentile(nxt - s, 0.5)").over(whole())
    macro = macro.withColumn("close_s", F.coalesce("nxt", (F.col("s") + gap).cast("long"))).select("symbol", "close_s", "trend", "range_pos")
    got = core.as_of(daily.withColumn("ts_s", seconds()), macro, on="ts_s", visible="close_s", prefix="")
    return got.select("symbol", "ts_s", r6(F.coalesce("trend", F.lit(0.0))).alias("trend"), r6(F.coalesce("range_pos", F.lit(0.5))).alias("range_pos"))


_VIX = "v AS (SELECT date_trunc('day', o_orderdate) AS ts, avg(o_totalprice) / 1e4 AS vix FROM orders GROUP BY 1)"


@query("j6_vix_asof", f"{WD}, {_VIX} SELECT d.symbol, epoch(d.ts)::BIGINT AS ts_s, {r('coalesce(v.vix, 0)', 'vix')} FROM d ASOF LEFT JOIN v ON d.ts >= v.ts")
def _(spark, sf):
    daily, v = B.bars_1d(spark, sf), B.vix(spark, sf)
    # One companion series for all symbols: a row a day, spread to the symbols as the as-of key needs.
    v = v.join(F.broadcast(daily.select("symbol").distinct())).withColumnRenamed("ts", "close_ts")
    return core.as_of(daily, v, prefix="").select("symbol", seconds().alias("ts_s"), r6(F.coalesce("vix", F.lit(0.0))).alias("vix"))


@query("j8_latest_quality", "WITH q AS (SELECT l_returnflag AS symbol, l_linestatus AS timeframe, l_orderkey, l_linenumber, l_shipdate, l_extendedprice FROM lineitem) SELECT symbol, timeframe, epoch(l_shipdate)::BIGINT AS ts_s, l_orderkey FROM q QUALIFY row_number() OVER (PARTITION BY symbol, timeframe ORDER BY l_shipdate DESC, l_orderkey DESC, l_linenumber DESC, l_extendedprice DESC) = 1")
def _(spark, sf):
    q = B.table(spark, sf, "lineitem").select(F.col("l_returnflag").alias("symbol"), F.col("l_linestatus").alias("timeframe"), F.struct("l_shipdate", "l_orderkey", "l_linenumber", "l_extendedprice").alias("k"))
    return q.groupBy("symbol", "timeframe").agg(F.max("k").alias("k")).select("symbol", "timeframe", seconds(F.col("k.l_shipdate").cast("timestamp")).alias("ts_s"), F.col("k.l_orderkey").alias("l_orderkey"))


@query("j9_ledger_bars", f"{WH} SELECT e.event_id, h.symbol, epoch(date_trunc('hour', e.ts))::BIGINT AS ts_s, {r('h.close', 'close')} FROM events e LEFT JOIN h ON h.symbol = e.event_type AND h.ts = date_trunc('hour', e.ts) WHERE e.event_type = 'purchase' AND e.ts >= (SELECT max(ts) - interval 10 day FROM events)")
def _(spark, sf):
    led, h = B.ledger(spark, sf), B.bars_1h(spark, sf)
    last = F.broadcast(B.table(spark, sf, "events").agg(F.max(F.col("ts").cast("timestamp")).alias("last")))
    led = led.join(last).where(F.col("ts") >= F.col("last") - F.expr("interval 10 days")).withColumn("hour", F.date_trunc("hour", "ts")).drop("symbol", "ts")
    got = led.join(h.where("symbol = 'purchase'").select("symbol", "ts", "close"), F.col("hour") == F.col("ts"), "left")
    return got.select("event_id", "symbol", seconds("hour").alias("ts_s"), r6("close").alias("close"))


_OOS = "((epoch(ts)::BIGINT // 3600 * 7919 + length(symbol) * 131) % 1000) / 1000.0"


@query("j10_oos_lookup", f"{WD}, o AS (SELECT symbol, ts, {_OOS} AS p FROM d WHERE day(ts) <= 20) SELECT d.symbol, epoch(d.ts)::BIGINT AS ts_s, {r('o.p', 'p')} FROM d LEFT JOIN o ON o.symbol = d.symbol AND o.ts = d.ts")
def _(spark, sf):
    daily = B.bars_1d(spark, sf)
    return daily.join(B.oos(daily.where("day(ts) <= 20")), ["symbol", "ts"], "left").select("symbol", seconds().alias("ts_s"), r6("p").alias("p"))


@query("j11_calendar_lookup", f"{WH}, {D}, x AS (SELECT month(ts) * 100 + day(ts) AS md, avg(close) AS p FROM d WHERE symbol = 'A' AND year(ts) = 1997 GROUP BY 1) SELECT h.symbol, epoch(h.ts)::BIGINT AS ts_s, {r('x.p', 'p')} FROM h LEFT JOIN x ON x.md = month(h.ts) * 100 + day(h.ts)")
def _(spark, sf):
    day = (F.month("ts") * 100 + F.day("ts")).alias("md")
    x = B.bars_1d(spark, sf).where("symbol = 'A' and year(ts) = 1997").groupBy(day).agg(F.avg("close").alias("p"))
    return B.bars_1h(spark, sf).select("symbol", "ts", day).join(F.broadcast(x), "md", "left").select("symbol", seconds().alias("ts_s"), r6("p").alias("p"))


@query("j12_session_day", f"{WH} SELECT symbol, (epoch(ts)::BIGINT // 86400)::BIGINT AS day, count(*) AS bars, {r('max(high)', 'high')}, {r('min(low)', 'low')} FROM h GROUP BY 1, 2")
def _(spark, sf):
    day = F.floor(seconds() / 86400).cast("long").alias("day")
    return B.bars_1h(spark, sf).groupBy("symbol", day).agg(F.count(F.lit(1)).alias("bars"), r6(F.max("high")).alias("high"), r6(F.min("low")).alias("low"))


@query("j13_missing_sessions", f"{WH}, s AS (SELECT symbol, date_trunc('day', ts) AS day, count(*) AS n, max(hour(ts)) AS last FROM h GROUP BY 1, 2), dd AS (SELECT symbol, day FROM s WHERE day(day) % 3 <> 0) SELECT s.symbol, epoch(s.day)::BIGINT AS ts_s, n FROM s ANTI JOIN dd ON dd.symbol = s.symbol AND dd.day = s.day WHERE s.last >= 20")
def _(spark, sf):
    s = B.bars_1h(spark, sf).groupBy("symbol", F.date_trunc("day", "ts").alias("ts")).agg(F.count(F.lit(1)).alias("n"), F.max(F.hour("ts")).alias("last"))
    return s.join(s.where("day(ts) % 3 <> 0").select("symbol", "ts"), ["symbol", "ts"], "left_anti").where("last >= 20").select("symbol", seconds().alias("ts_s"), "n")


@query("j14_identity_ambiguity", "SELECT l_returnflag AS symbol, count(DISTINCT l_linestatus) AS sources, count(DISTINCT l_linestatus) > 1 AS ambiguous FROM lineitem GROUP BY 1")
def _(spark, sf):
    n = F.countDistinct("l_linestatus")
    return B.table(spark, sf, "lineitem").groupBy(F.col("l_returnflag").alias("symbol")).agg(n.alias("sources"), (n > 1).alias("ambiguous"))


@query(
    "j15_reference_coverage",
    f"""{WD}, a AS (SELECT ts FROM d WHERE symbol = 'A'), n AS (SELECT ts FROM d WHERE symbol = 'N'), x AS (SELECT 'only_a' AS side, ts FROM (SELECT ts FROM a EXCEPT SELECT ts FROM n) UNION ALL SELECT 'only_n', ts FROM (SELECT ts FROM n EXCEPT SELECT ts FROM a))
    SELECT side, count(*) AS n, string_agg(epoch(ts)::BIGINT::VARCHAR, ',' ORDER BY ts) FILTER (k <= 5) AS first FROM (SELECT *, row_number() OVER (PARTITION BY side ORDER BY ts) AS k FROM x) GROUP BY side""",
)
def _(spark, sf):
    d = B.bars_1d(spark, sf)
    a, n = d.where("symbol = 'A'").select("ts"), d.where("symbol = 'N'").select("ts")
    x = a.exceptAll(n).withColumn("side", F.lit("only_a")).unionByName(n.exceptAll(a).withColumn("side", F.lit("only_n")))
    k = F.row_number().over(Window.partitionBy("side").orderBy("ts"))
    first = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("k") <= 5, seconds()))), lambda v: v.cast("string")), ",")
    return x.withColumn("k", k).groupBy("side").agg(F.count(F.lit(1)).alias("n"), first.alias("first"))


@query("j16_positional_concat", f"{WD} SELECT symbol, {T}, row_number() {OV} AS i, {r('close', 'close')}, {r('avg(close) ' + over(5), 'mean5')} FROM d")
def _(spark, sf):
    return core.numbered(B.bars_1d(spark, sf)).select("symbol", seconds().alias("ts_s"), "i", r6("close").alias("close"), r6(F.avg("close").over(w(5))).alias("mean5"))


# ---- filters and gates ---------------------------------------------------------------------------------------------

_ODD = "SELECT symbol, ts, CASE WHEN day(ts) = 13 THEN 'NaN'::DOUBLE WHEN day(ts) = 17 THEN NULL ELSE open END AS open, CASE WHEN day(ts) = 19 THEN 'Infinity'::DOUBLE ELSE high END AS high, CASE WHEN day(ts) = 23 THEN high + 1 ELSE low END AS low, CASE WHEN day(ts) = 29 THEN -close ELSE close END AS close, CASE WHEN day(ts) % 4 = 0 THEN 0 ELSE volume END AS volume FROM d"


def odd(spark: SparkSession, sf: str) -> DataFrame:
    """Daily bars with faults by day of month: NaN, null, infinity, crossed and negative prices, no volume."""
    day = F.day("ts")
    return B.bars_1d(spark, sf).select(
        "symbol", "ts", F.when(day == 13, F.lit(float("nan"))).when(day == 17, None).otherwise(F.col("open")).alias("open"), F.when(day == 19, F.lit(float("inf"))).otherwise(F.col("high")).alias("high"),
        F.when(day == 23, F.col("high") + 1).otherwise(F.col("low")).alias("low"), F.when(day == 29, -F.col("close")).otherwise(F.col("close")).alias("close"), F.when(day % 4 == 0, 0.0).otherwise(F.col("volume")).alias("volume"),
    )


_FIN = " AND ".join(f"{c} IS NOT NULL AND NOT isnan({c}) AND NOT isinf({c})" for c in ("open", "high", "low", "close"))


@query("p1_drop_nonfinite", f"{WD}, o AS ({_ODD}) SELECT symbol, count(*) FILTER ({_FIN}) AS kept, count(*) FILTER (NOT ({_FIN})) AS dropped FROM o GROUP BY 1")
def _(spark, sf):
    ok = finite("open") & finite("high") & finite("low") & finite("close")
    return odd(spark, sf).groupBy("symbol").agg(F.count_if(ok).alias("kept"), F.count_if(~ok).alias("dropped"))


@query("p2_enforce_physics", f"{WD}, o AS ({_ODD}) SELECT symbol, {T}, {r('greatest(open, close, high)', 'high')}, {r('least(open, close, low)', 'low')} FROM o WHERE {_FIN}")
def _(spark, sf):
    ok = finite("open") & finite("high") & finite("low") & finite("close")
    return show(core.physics(odd(spark, sf).where(ok)), "high", "low")


_AUDIT = f"""o AS ({_ODD}), a AS (SELECT symbol, count(*) AS rows, count(*) - count(DISTINCT ts) AS duplicates, count(*) FILTER (NOT ({_FIN})) AS nonfinite, count(*) FILTER ({_FIN} AND least(open, high, low, close) <= 0) AS nonpositive, count(*) FILTER (volume = 0) AS zero_volume FROM o GROUP BY 1)"""


@query("a6_frame_audit", f"{WD}, {_AUDIT} SELECT *, {r('zero_volume / rows', 'zero_ratio')} FROM a")
def _(spark, sf):
    return quality.audit(odd(spark, sf)).select("symbol", "rows", "duplicates", "nonfinite", "nonpositive", "zero_volume", r6(div("zero_volume", "rows")).alias("zero_ratio"))


@query("p4_quality_status", f"{WD}, {_AUDIT} SELECT symbol, CASE WHEN rows = 0 OR duplicates > 0 OR nonfinite > 0 OR nonpositive > 0 THEN 'FAIL' WHEN zero_volume / rows >= 0.25 THEN 'WARN' ELSE 'PASS' END AS status FROM a")
def _(spark, sf):
    a = quality.audit(odd(spark, sf))
    return a.select("symbol", quality.status(synthetic_ratio=div("zero_volume", "rows")).alias("status"))


@query("p5_status_floor", f"{WD} SELECT symbol, {T}, CASE greatest(CASE WHEN day(ts) % 7 = 0 THEN 2 WHEN day(ts) % 3 = 0 THEN 1 ELSE 0 END, CASE WHEN month(ts) = 6 THEN 1 ELSE 0 END) WHEN 2 THEN 'FAIL' WHEN 1 THEN 'WARN' ELSE 'PASS' END AS status FROM d")
def _(spark, sf):
    a = F.when(F.day("ts") % 7 == 0, "FAIL").when(F.day("ts") % 3 == 0, "WARN").otherwise("PASS")
    b = F.when(F.month("ts") == 6, "WARN").otherwise("PASS")
    return B.bars_1d(spark, sf).select("symbol", seconds().alias("ts_s"), quality.floor(a, b).alias("status"))


@query("p3_strict_gate", f"{WD}, {_AUDIT} SELECT symbol, rows FROM a WHERE symbol NOT IN (SELECT symbol FROM a WHERE duplicates > 0)")
def _(spark, sf):
    a = quality.audit(odd(spark, sf)).withColumn("status", F.when(F.col("duplicates") > 0, "FAIL").otherwise("PASS"))
    return quality.gated(odd(spark, sf), a).groupBy("symbol").agg(F.count(F.lit(1)).alias("rows"))


@query("p7_volatility_gate", f"{WD}, {{atr}} SELECT symbol, {T}, atr14 > quantile_cont(atr14, 0.5) {over(20)} AS open_gate FROM atr".replace("{atr}", "{ATR}"))
def _(spark, sf):
    x = core.atr(B.bars_1d(spark, sf))
    return x.select("symbol", seconds().alias("ts_s"), (F.col("atr14") > F.expr("percentile(atr14, 0.5)").over(w(20))).alias("open_gate"))


ATR = f"""tr AS (SELECT *, greatest(high - low, abs(high - pc), abs(low - pc)) AS tr FROM (SELECT *, coalesce(lag(close) {OV}, close) AS pc FROM d)), atr AS (SELECT *, CASE WHEN count(*) {over(14)} = 14 THEN avg(tr) {over(14)} ELSE tr END AS atr14 FROM tr)"""
SQL["p7_volatility_gate"] = SQL["p7_volatility_gate"].replace("{ATR}", ATR)


_LANE = "CASE WHEN l_linestatus = 'F' THEN '1D' ELSE '1H' END AS timeframe"
_FAR = "(SELECT max(l_shipdate) - interval 20 day FROM lineitem)"


@query(
    "p15_refresh_decision",
    f"""WITH i AS (SELECT 'S' || s_suppkey AS symbol, timeframe, s_suppkey FROM supplier, (VALUES ('1D'), ('1H')) v(timeframe)), x AS (SELECT 'S' || l_suppkey AS symbol, {_LANE}, * FROM lineitem), b AS (SELECT DISTINCT symbol, timeframe FROM x WHERE l_orderkey % 13 = 0),
    q AS (SELECT symbol, timeframe, max(l_shipdate) AS at, max_by(CASE WHEN l_quantity > 40 THEN 'FAIL' ELSE 'PASS' END, (l_shipdate, l_orderkey, l_linenumber, l_quantity)) AS status FROM x WHERE l_orderkey % 29 = 0 GROUP BY 1, 2),
    d AS (SELECT i.symbol, i.timeframe, CASE WHEN s_suppkey % 17 = 0 THEN 'operator_forced_full_refresh' WHEN b.symbol IS NULL THEN 'bootstrap' WHEN q.at IS NULL THEN 'repair_missing_quality_history' WHEN status = 'FAIL' THEN 'repair_last_quality_fail' WHEN epoch({_FAR}) - epoch(q.at) >= 86400 * CASE WHEN i.timeframe = '1D' THEN 30 ELSE 7 END THEN 'scheduled_full_refresh' ELSE 'incremental_refresh' END AS reason
      FROM i LEFT JOIN b ON b.symbol = i.symbol AND b.timeframe = i.timeframe LEFT JOIN q ON q.symbol = i.symbol AND q.timeframe = i.timeframe) SELECT symbol, timeframe, reason <> 'incremental_refresh' AS "full", reason FROM d""",
)
def _(spark, sf):
    """Suppliers as instruments of two timeframes; some lines are their bars, some their quality rows; the clock stands 20 days before the last line."""
    x = B.table(spark, sf, "lineitem").withColumns({"symbol": F.concat(F.lit("S"), "l_suppkey"), "timeframe": F.when(F.col("l_linestatus") == "F", "1D").otherwise("1H"), "at": F.col("l_shipdate").cast("timestamp")})
    i = B.table(spark, sf, "supplier").select(F.concat(F.lit("S"), "s_suppkey").alias("symbol"), "s_suppkey", F.explode(F.array(F.lit("1D"), F.lit("1H"))).alias("timeframe"))
    last = F.struct("at", "l_orderkey", "l_linenumber", "l_quantity")
    q = x.where("l_orderkey % 29 = 0").groupBy("symbol", "timeframe").agg(F.max(last).alias("z")).select("symbol", "timeframe", F.when(F.col("z.l_quantity") > 40, "FAIL").otherwise("PASS").alias("status"), F.col("z.at").alias("synced_at"))
    clock = x.agg((F.max("at") - F.expr("interval 20 days")).alias("now"))  # one row
    return quality.refresh_decisions(i.join(F.broadcast(clock)), x.where("l_orderkey % 13 = 0"), q, F.col("now"), F.col("s_suppkey") % 17 == 0)


@query("p16_low_water_mark", f"{WD} SELECT symbol, epoch(max(ts) - interval 180 day)::BIGINT AS mark_s, epoch(max(ts) - interval 45 day)::BIGINT AS hourly_s FROM d GROUP BY 1")
def _(spark, sf):
    last = F.max("ts")
    return B.bars_1d(spark, sf).groupBy("symbol").agg(seconds(last - F.expr("interval 180 days")).alias("mark_s"), seconds(last - F.expr("interval 45 days")).alias("hourly_s"))


_NOW = {"1H": "2024-02-01 00:20:00", "1D": "1998-11-01 00:20:00"}
_AGE = f"""SELECT symbol, ts, '1H' AS timeframe, 129600 AS most, epoch(TIMESTAMP '{_NOW['1H']}')::BIGINT - epoch(ts)::BIGINT AS age FROM h UNION ALL SELECT symbol, ts, '1D', 345600, epoch(TIMESTAMP '{_NOW['1D']}')::BIGINT - epoch(ts)::BIGINT FROM d"""


@query("p10_staleness", f"""{WH}, {D}, a AS ({_AGE}) SELECT symbol, timeframe, {T}, CASE WHEN age > most THEN 'NO_TRADE' ELSE 'LIVE' END AS verdict,
    CASE WHEN age > most THEN 'Stale data: latest ' || timeframe || ' bar is ' || concat_ws(' ', CASE WHEN age >= 86400 THEN (age // 86400) || 'd' END, CASE WHEN age // 3600 % 24 > 0 THEN (age // 3600 % 24) || 'h' END, CASE WHEN age < 86400 AND age // 60 % 60 > 0 THEN (age // 60 % 60) || 'm' END) || ' old.' ELSE '' END AS note FROM a""")
def _(spark, sf):
    parts = [x.select("symbol", F.lit(k).alias("timeframe"), seconds().alias("ts_s"), (F.unix_timestamp(F.lit(_NOW[k]).cast("timestamp")) - seconds()).alias("age")) for k, x in (("1H", B.bars_1h(spark, sf)), ("1D", B.bars_1d(spark, sf)))]
    x = parts[0].unionByName(parts[1]).withColumn("note", quality.stale_note(F.col("age"), F.col("timeframe")))
    return x.select("symbol", "timeframe", "ts_s", F.when(F.col("note") != "", "NO_TRADE").otherwise("LIVE").alias("verdict"), "note")


@query("p17_live_eod_gate", f"{WH}, x AS (SELECT *, avg(close) {over(20)} AS m, stddev_pop(close) {over(20)} AS sd FROM h) SELECT symbol, {T}, CASE WHEN abs((close - m) / nullif(sd, 0)) > 2.5 THEN 'SHOCK' WHEN hour(ts + interval 1 hour) >= 14 THEN 'EOD' ELSE 'OPEN' END AS gate FROM x")
def _(spark, sf):
    z = div(F.col("close") - F.avg("close").over(w(20)), F.stddev_pop("close").over(w(20)))
    x = B.bars_1h(spark, sf).withColumn("basis_z", z)
    return x.select("symbol", seconds().alias("ts_s"), quality.live_gate(F.col("ts"), F.col("basis_z")).alias("gate"))


@query("p14_sanitize", f"{WD}, o AS ({_ODD}) SELECT symbol, {T}, {r('CASE WHEN open IS NULL OR isnan(open) OR isinf(open) THEN 0 ELSE open END', 'open')}, {r('CASE WHEN high IS NULL OR isnan(high) OR isinf(high) THEN 0 ELSE high END', 'high')} FROM o WHERE day(ts) <> 17")
def _(spark, sf):
    x = odd(spark, sf).where("day(ts) <> 17")
    return x.select("symbol", seconds().alias("ts_s"), *[r6(F.when(finite(c), F.col(c)).otherwise(0.0)).alias(c) for c in ("open", "high")])


# ---- audits --------------------------------------------------------------------------------------------------------


@query("a3_gap_audit", f"{WH}, g AS (SELECT symbol, ts, (epoch(ts) - epoch(lag(ts) {OV})) / 3600.0 AS gap FROM h) SELECT symbol, count(*) AS rows, ((epoch(max(ts)) - epoch(min(ts))) / 3600)::BIGINT + 1 AS expected, sum(greatest(round_even(gap, 0) - 1, 0))::BIGINT AS missing, {r('max(gap)', 'max_gap')} FROM g GROUP BY 1")
def _(spark, sf):
    return quality.continuous_gaps(B.bars_1h(spark, sf), 3600).select("symbol", "rows", "expected", "missing", r6("max_gap").alias("max_gap"))


@query("a4_session_daily_gaps", f"{WD}, s AS (SELECT DISTINCT symbol, ts::DATE AS day FROM d), g AS (SELECT symbol, day - lag(day) OVER (PARTITION BY symbol ORDER BY day) AS gap FROM s) SELECT symbol, count(*) AS days, sum(greatest(gap - 3, 0))::BIGINT AS excess, max(gap) AS max_gap FROM g GROUP BY 1")
def _(spark, sf):
    return quality.daily_gaps(B.bars_1d(spark, sf))


@query(
    "a5_session_hourly_gaps",
    f"""{WH}, x AS (SELECT symbol, ts::DATE AS day, dayofweek(ts) AS wd, hour(ts) AS slot FROM h), days AS (SELECT DISTINCT symbol, day, wd FROM x), nd AS (SELECT symbol, wd, count(*) AS n FROM days GROUP BY 1, 2),
    slots AS (SELECT x.symbol, x.wd, slot FROM (SELECT symbol, wd, slot, count(DISTINCT day) AS c FROM x GROUP BY 1, 2, 3) x JOIN nd USING (symbol, wd) WHERE c >= greatest(3, ceil(0.4 * n))),
    want AS (SELECT days.symbol, day, slot FROM days JOIN slots USING (symbol, wd)), miss AS (SELECT w.symbol, w.day, w.slot FROM want w ANTI JOIN x ON x.symbol = w.symbol AND x.day = w.day AND x.slot = w.slot),
    isl AS (SELECT symbol, day, slot - row_number() OVER (PARTITION BY symbol, day ORDER BY slot) AS g FROM miss), runs AS (SELECT symbol, count(*) AS len FROM isl GROUP BY symbol, day, g)
    SELECT e.symbol, e.expected, coalesce(m.missing, 0) AS missing, coalesce(rr.longest, 0) AS longest FROM (SELECT symbol, count(*) AS expected FROM want GROUP BY 1) e LEFT JOIN (SELECT symbol, count(*) AS missing FROM miss GROUP BY 1) m USING (symbol) LEFT JOIN (SELECT symbol, max(len) AS longest FROM runs GROUP BY 1) rr USING (symbol)""",
)
def _(spark, sf):
    return quality.hourly_gaps(B.bars_1h(spark, sf))


@query("a7_merge_keep_last", f"{WD}, u AS (SELECT symbol, ts, close, 0 AS prio FROM d WHERE year(ts) <= 1999 UNION ALL SELECT symbol, ts, close * 2, 1 FROM d WHERE year(ts) >= 1999) SELECT symbol, {T}, {r('close', 'close')} FROM u QUALIFY row_number() OVER (PARTITION BY symbol, ts ORDER BY prio DESC) = 1")
def _(spark, sf):
    d = B.bars_1d(spark, sf).select("symbol", "ts", "close")
    return show(quality.merged(d.where("year(ts) <= 1999"), d.where("year(ts) >= 1999").withColumn("close", F.col("close") * 2)), "close")


@query("a8_missing_quality_row", f"{WD}, a AS (SELECT symbol, count(*) AS rows FROM d GROUP BY 1) SELECT w.symbol, coalesce(a.rows, 0) AS rows, CASE WHEN a.rows IS NULL THEN 'FAIL' ELSE 'PASS' END AS status FROM (VALUES ('A'), ('N'), ('R'), ('ZZ')) w(symbol) LEFT JOIN a USING (symbol)")
def _(spark, sf):
    want = spark.createDataFrame([("A",), ("N",), ("R",), ("ZZ",)], "symbol string")
    a = B.bars_1d(spark, sf).groupBy("symbol").agg(F.count(F.lit(1)).alias("rows"))
    return F.broadcast(want).join(a, "symbol", "left").select("symbol", F.coalesce("rows", F.lit(0)).cast("long").alias("rows"), F.when(F.col("rows").isNull(), "FAIL").otherwise("PASS").alias("status"))


@query(
    "a2_session_repair",
    f"""{WH}, s AS (SELECT symbol, date_trunc('day', ts) AS ts, first(open ORDER BY ts) AS open, max(high) AS high, min(low) AS low, last(close ORDER BY ts) AS close, sum(volume) AS volume, max(hour(ts)) AS slot FROM h GROUP BY symbol, date_trunc('day', ts)),
    modal AS (SELECT symbol, slot AS m FROM (SELECT symbol, slot, count(*) AS c FROM s GROUP BY 1, 2) QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY c DESC, slot DESC) = 1)
    SELECT s.symbol, {T}, {_OHLCV} FROM s JOIN modal USING (symbol) WHERE slot >= m""",
)
def _(spark, sf):
    return bars_columns(quality.session_days(B.bars_1h(spark, sf)))


@query("a24_counts_mode_median", f"{WD}, c AS (SELECT symbol, month(ts)::INT AS month, count(*) AS n FROM d GROUP BY 1, 2), m AS (SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY n DESC, month DESC) = 1) SELECT d.symbol, count(DISTINCT month(ts)) AS months, {r('median(close)', 'median_close')}, any_value(m.month) AS modal_month, any_value(m.n) AS modal_count FROM d JOIN m USING (symbol) GROUP BY 1")
def _(spark, sf):
    d = B.bars_1d(spark, sf).withColumn("month", F.month("ts"))
    g = d.groupBy("symbol").agg(F.countDistinct("month").alias("months"), r6(F.expr("percentile(close, 0.5)")).alias("median_close"))
    m = quality.modal(d, "month", "symbol")
    return g.join(m, "symbol").select("symbol", "months", "median_close", F.col("month").alias("modal_month"), F.col("n").alias("modal_count"))


@query("a24_value_counts", f"{WD} SELECT symbol, dayofweek(ts)::INT AS weekday, count(*) AS n FROM d GROUP BY 1, 2")
def _(spark, sf):
    return B.bars_1d(spark, sf).groupBy("symbol", (F.dayofweek("ts") - 1).alias("weekday")).agg(F.count(F.lit(1)).alias("n"))


@query(
    "flagship",
    f"""{WD}, {macro_sql('1W')}, {closed_sql('1W')}, {ATR}, j AS (SELECT atr.symbol, atr.ts, atr.close, atr.atr14, mc.close AS week_close, ln(atr.close / lag(atr.close) OVER (PARTITION BY atr.symbol ORDER BY atr.ts)) AS ret FROM atr ASOF LEFT JOIN mc ON atr.symbol = mc.symbol AND atr.ts >= mc.close_ts),
    v AS (SELECT *, stddev_pop(ret) {over(21)} AS vol FROM j) SELECT symbol, {T}, {r('close', 'close')}, {r('week_close', 'week_close')}, {r('atr14', 'atr14')}, {r('vol', 'vol')}, CASE WHEN week_close IS NULL THEN 1 WHEN atr14 <= 0 THEN 4 WHEN abs(ret) > 2.5 * vol THEN 5 ELSE 0 END AS skip_code FROM v""",
)
def _(spark, sf):
    return flagship(spark, sf)
