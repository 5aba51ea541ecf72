"""Audits of bars: counts, gaps, sessions, statuses and the strict gate."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chronolith.functions.exprs import div, finite, seconds, series
from chronolith.operators.core import status_rank

OHLC = ("open", "high", "low", "close")


#: Age beyond which a forecast of a timeframe is stale (fixed values).
STALE_SECONDS = {"1H": 36 * 3600, "1D": 4 * 86400}


def stale_note(age: Column, timeframe: Column) -> Column:
    """Note on a bar that is ``age`` seconds old, empty where it is fresh or its timeframe has no limit."""
    limit = F.try_element_at(F.create_map(*[F.lit(v) for kv in STALE_SECONDS.items() for v in kv]), F.upper(timeframe))
    days, hours, minutes = F.floor(age / 86400), F.floor(age / 3600) % 24, F.floor(age / 60) % 60
    part = lambda n, unit, on: F.when((n > 0) & on, F.concat(n.cast("string"), F.lit(unit)))
    text = F.concat_ws(" ", part(days, "d", F.lit(True)), part(hours, "h", F.lit(True)), part(minutes, "m", days == 0))
    note = F.concat(F.lit("Stale data: latest "), F.upper(timeframe), F.lit(" bar is "), text, F.lit(" old."))
    return F.when(age > limit, note).otherwise("")


def live_gate(ts: Column, basis_z: Column, shock: float = 2.5, hour: int = 14) -> Column:
    """SHOCK for an extreme basis, else EOD where the next hour is late in the session, else OPEN."""
    return F.when(F.abs(basis_z) > shock, "SHOCK").when(F.hour(ts + F.expr("interval 1 hours")) >= hour, "EOD").otherwise("OPEN")


def modal(df: DataFrame, value: str, *by: str) -> DataFrame:
    """The most frequent value of each group with its count; the largest of equally frequent ones."""
    counts = df.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count(F.lit(1)).alias("__n"))
    return counts.groupBy(*by).agg(F.max(F.struct("__n", value)).alias("__m")).select(*by, F.col(f"__m.{value}").alias(value), F.col("__m.__n").alias("n"))


def audit(bars: DataFrame) -> DataFrame:
    """One quality row a symbol, in one pass."""
    ok = finite("open") & finite("high") & finite("low") & finite("close")
    return bars.groupBy("symbol").agg(
        F.count(F.lit(1)).alias("rows"),
        (F.count(F.lit(1)) - F.countDistinct("ts")).alias("duplicates"),
        F.count_if(~ok).alias("nonfinite"),
        F.count_if(ok & (F.least(*OHLC) <= 0)).alias("nonpositive"),
        F.count_if(F.col("volume") == 0).alias("zero_volume"),
    )


def status(missing_ratio: Column | None = None, synthetic_ratio: Column | None = None, age_hours: Column | None = None, fail_age: float = 336, warn_age: float = 96) -> Column:
    """FAIL, WARN or PASS of an audit row. Ratios and age that are not given don't count."""
    zero = F.lit(0.0)
    missing, synthetic, age = (zero if x is None else F.coalesce(x, zero) for x in (missing_ratio, synthetic_ratio, age_hours))
    fail = (F.col("rows") == 0) | (F.col("duplicates") > 0) | (F.col("nonfinite") > 0) | (F.col("nonpositive") > 0) | (missing >= 0.15) | (age >= fail_age)
    return F.when(fail, "FAIL").when((missing >= 0.02) | (synthetic >= 0.25) | (age >= warn_age), "WARN").otherwise("PASS")


def floor(*statuses: Column) -> Column:
    """The worst of several statuses."""
    worst = F.greatest(*[status_rank(s) for s in statuses])
    return F.when(worst == 2, "FAIL").when(worst == 1, "WARN").otherwise("PASS")


def gated(bars: DataFrame, rows: DataFrame, allowed: tuple[str, ...] = ()) -> DataFrame:
    """Bars of the symbols whose quality is not FAIL, or that are allowed in spite of it."""
    failed = rows.where((F.col("status") == "FAIL") & ~F.col("symbol").isin(*allowed) if allowed else F.col("status") == "FAIL").select("symbol")
    return bars.join(failed, "symbol", "left_anti")


def continuous_gaps(bars: DataFrame, step: int) -> DataFrame:
    gap = div(seconds() - F.lag(seconds()).over(series()), F.lit(step))
    g = bars.select("symbol", "ts", gap.alias("gap"))
    return g.groupBy("symbol").agg(F.count(F.lit(1)).alias("rows"), (F.floor((F.max(seconds()) - F.min(seconds())) / step) + 1).cast("long").alias("expected"), F.sum(F.greatest(F.bround("gap", 0) - 1, F.lit(0.0))).cast("long").alias("missing"), F.max("gap").alias("max_gap"))


def daily_gaps(bars: DataFrame, usual: int = 3) -> DataFrame:
    s = bars.select("symbol", F.to_date("ts").alias("day")).distinct()
    g = s.withColumn("gap", F.datediff("day", F.lag("day").over(Window.partitionBy("symbol").orderBy("day"))).cast("long"))
    return g.groupBy("symbol").agg(F.count(F.lit(1)).alias("days"), F.sum(F.greatest(F.col("gap") - usual, F.lit(0))).cast("long").alias("excess"), F.max("gap").alias("max_gap"))


def hourly_gaps(bars: DataFrame) -> DataFrame:
    """Slots that a weekday usually has, against those that its days have; the longest run of missing ones."""
    x = bars.select("symbol", F.to_date("ts").alias("day"), F.dayofweek("ts").alias("wd"), F.hour("ts").alias("slot"))
    days = x.select("symbol", "day", "wd").distinct()
    n = days.groupBy("symbol", "wd").agg(F.count(F.lit(1)).alias("n"))
    slots = x.groupBy("symbol", "wd", "slot").agg(F.countDistinct("day").alias("c")).join(n, ["symbol", "wd"]).where(F.col("c") >= F.greatest(F.lit(3), F.ceil(F.lit(0.4) * F.col("n")))).select("symbol", "wd", "slot")
    want = days.join(slots, ["symbol", "wd"]).select("symbol", "day", "slot")
    miss = want.join(x, ["symbol", "day", "slot"], "left_anti")
    run = miss.withColumn("g", F.col("slot") - F.row_number().over(Window.partitionBy("symbol", "day").orderBy("slot"))).groupBy("symbol", "day", "g").agg(F.count(F.lit(1)).alias("len"))
    missing = run.groupBy("symbol").agg(F.sum("len").alias("missing"), F.max("len").alias("longest"))
    out = want.groupBy("symbol").agg(F.count(F.lit(1)).alias("expected")).join(missing, "symbol", "left")
    return out.select("symbol", "expected", *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("missing", "longest")])


def merged(old: DataFrame, new: DataFrame) -> DataFrame:
    """The union, where a new bar replaces an old one of its time. One aggregation, no sort."""
    both = old.withColumn("prio", F.lit(0)).unionByName(new.withColumn("prio", F.lit(1)))
    values = [c for c in old.columns if c not in ("symbol", "ts")]
    return both.groupBy("symbol", "ts").agg(F.max_by(F.struct(*values), "prio").alias("v")).select("symbol", "ts", "v.*")


def session_days(bars: DataFrame) -> DataFrame:
    """Daily bars of hourly sessions that reach the usual last slot; ties of usual slots go to the later."""
    s = bars.groupBy("symbol", F.date_trunc("day", "ts").alias("day")).agg(F.min_by("open", "ts").alias("open"), F.max("high").alias("high"), F.min("low").alias("low"), F.max_by("close", "ts").alias("close"), F.sum("volume").alias("volume"), F.max(F.hour("ts")).alias("slot"))
    usual = s.groupBy("symbol", "slot").agg(F.count(F.lit(1)).alias("c")).groupBy("symbol").agg(F.max(F.struct("c", "slot")).alias("m"))
    return s.join(usual, "symbol").where(F.col("slot") >= F.col("m.slot")).drop("m", "slot").withColumnRenamed("day", "ts")


#: Days after which a timeframe is fetched whole again (fixed values).
CADENCE_DAYS = {"1D": 30, "1H": 7}


def refresh_decisions(instruments: DataFrame, bars: DataFrame, quality: DataFrame, now: Column, forced: Column | None = None) -> DataFrame:
    """symbol, timeframe, full, reason for each instrument (symbol, timeframe): the first of forced, without bars, without quality rows,
    with a last quality row that failed, or with one as old as the timeframe's cadence; else incremental.

    bars: symbol, timeframe of any stored bar; quality: symbol, timeframe, status, synced_at. A timeframe without a cadence is never due.
    """
    keys = ["symbol", "timeframe"]
    last = quality.groupBy(*keys).agg(F.max_by("status", "synced_at").alias("status"), F.max("synced_at").alias("synced_at"))
    x = instruments.join(bars.select(*keys).distinct().withColumn("__bars", F.lit(True)), keys, "left").join(last, keys, "left")
    days = F.try_element_at(F.create_map(*[F.lit(v) for kv in CADENCE_DAYS.items() for v in kv]), F.col("timeframe"))
    due = F.unix_timestamp(now) - F.unix_timestamp("synced_at") >= days * 86400
    reason = F.when(forced if forced is not None else F.lit(False), "operator_forced_full_refresh").when(F.col("__bars").isNull(), "bootstrap").when(F.col("synced_at").isNull(), "repair_missing_quality_history")
    reason = reason.when(F.col("status") == "FAIL", "repair_last_quality_fail").when(due, "scheduled_full_refresh").otherwise("incremental_refresh")
    return x.select(*keys, (reason != "incremental_refresh").alias("full"), reason.alias("reason"))
