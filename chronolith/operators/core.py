"""Window, resample and as-of operators. Every operator takes and returns a DataFrame keyed (symbol, ts)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chronolith.functions.exprs import EPS, clip, col, div, series, w, whole
from chronolith.operators import scan

#: Months of the calendar timeframes, and days of the fixed ones.
MONTHS = {"1M": 1, "3M": 3, "6M": 6, "12M": 12}
DAYS = {"1D": 1, "1W": 7}


def true_range(bars: DataFrame) -> DataFrame:
    before = F.coalesce(F.lag("close").over(series()), F.col("close"))
    return bars.withColumn("tr", F.greatest(F.col("high") - F.col("low"), F.abs(F.col("high") - before), F.abs(F.col("low") - before)))


def atr(bars: DataFrame, n: int = 14, name: str = "atr14") -> DataFrame:
    """Mean true range of n bars; the true range itself while there are fewer."""
    out = true_range(bars)
    return out.withColumn(name, F.when(F.count("tr").over(w(n)) == n, F.avg("tr").over(w(n))).otherwise(F.col("tr"))).drop("tr")


def macro_key(timeframe: str) -> Column:
    """What names the calendar period of a bar."""
    ts = F.col("ts")
    if timeframe == "1W":
        return F.extract(F.lit("yearofweek"), ts) * 100 + F.weekofyear(ts)
    year, month = F.year(ts), F.month(ts)
    return year * 100 + F.floor((month - 1) / MONTHS[timeframe]).cast("int")


def resample(bars: DataFrame, timeframe: str) -> DataFrame:
    """Calendar bars; their time is the first bar's. Open and close skip nulls."""
    out = bars.groupBy("symbol", macro_key(timeframe).alias("period")).agg(
        F.min("ts").alias("first_ts"),
        F.min_by("open", F.when(F.col("open").isNotNull(), F.col("ts"))).alias("open"),
        F.max("high").alias("high"),
        F.min("low").alias("low"),
        F.max_by("close", F.when(F.col("close").isNotNull(), F.col("ts"))).alias("close"),
        F.sum("volume").alias("volume"),
        F.count(F.lit(1)).alias("bars"),
    )
    return out.withColumnRenamed("first_ts", "ts").drop("period")


def step(timeframe: str) -> Column:
    if timeframe in DAYS:
        return F.expr(f"interval {DAYS[timeframe]} days")
    if timeframe == "1H":
        return F.expr("interval 1 hours")
    return F.expr(f"make_ym_interval(0, {MONTHS[timeframe]})")


def close_time(bars: DataFrame, timeframe: str) -> DataFrame:
    """Adds ``close_ts``, from which a bar may be seen: fixed steps by length, calendar ones at the next bar's origin."""
    end = F.col("ts") + step(timeframe)
    if timeframe in MONTHS:
        end = F.coalesce(F.lead("ts").over(series()), end)
    return bars.withColumn("close_ts", end)


def as_of(left: DataFrame, right: DataFrame, on: str = "ts", visible: str = "close_ts", keys: tuple[str, ...] = ("symbol",), tolerance: str | None = None, prefix: str = "r_", unit: str | None = None) -> DataFrame:
    """Left rows with the last right row whose ``visible`` time is at most theirs.

    Both sides are dealt once by key and ordered together; right rows stand before
    left rows of equal time, so the match is inclusive. Work is linear in both sides.

    With ``unit`` (year, month, day ...) they are dealt by (key, slice of time): the last right row of
    each slice is carried to the start of the left's later slices, so that no task is longer than a
    slice, at the price of reading both sides twice. The rows are the same.
    """
    values = [c for c in right.columns if c not in keys]
    cut = F.date_trunc(unit, "__t") if unit else F.lit(0)
    r = right.select(*keys, F.col(visible).alias("__t"), F.lit(0).alias("__side"), F.struct(*values).alias("__r")).withColumn("__s", cut)
    lcols = [c for c in left.columns if c not in keys]
    le = left.select(*keys, F.col(on).alias("__t"), F.lit(1).alias("__side"), F.struct(*lcols).alias("__l")).withColumn("__s", cut)
    both = le.unionByName(r, allowMissingColumns=True)
    if unit:
        ends = r.where("__t is not null").groupBy(*keys, "__s").agg(F.max_by("__r", "__t").alias("__r")).withColumn("__side", F.lit(1))
        starts = le.select(*keys, "__s").distinct().withColumn("__side", F.lit(0))
        slices = Window.partitionBy(*keys).orderBy("__s", "__side").rowsBetween(Window.unboundedPreceding, 0)
        entry = starts.unionByName(ends, allowMissingColumns=True).withColumn("__r", F.last("__r", True).over(slices)).where("__side = 0 and __r is not null")
        both = both.unionByName(entry.select(*keys, "__s", F.col("__s").alias("__t"), F.lit(-1).alias("__side"), "__r"), allowMissingColumns=True)
    order = Window.partitionBy(*keys, *(("__s",) if unit else ())).orderBy("__t", "__side").rowsBetween(Window.unboundedPreceding, 0)
    got = both.withColumn("__r", F.last("__r", True).over(order)).where("__side = 1")
    hit = F.col("__r")
    if tolerance:
        hit = F.when(F.col("__t") - F.col(f"__r.{visible}") <= F.expr(tolerance), F.col("__r"))
    got = got.withColumn("__r", hit)
    return got.select(*keys, *[F.col(f"__l.{c}").alias(c) for c in lcols], *[F.col(f"__r.{c}").alias(f"{prefix}{c}") for c in values])


def on_days(bars: DataFrame, index: DataFrame, *names: str) -> DataFrame:
    """Bars with the last known value, at their time or before, of index columns that have no symbol.

    Values are carried over the calendar, a row per distinct time and not per bar, by
    months, and joined by time; no task holds more of the calendar than a month.
    """
    calendar = bars.select("ts").distinct().join(index.select("ts", *names), "ts", "full")
    return bars.join(scan.carried(calendar, names, keys=()), "ts", "left")


def macro_regime(bars: DataFrame, lookback: int = 3) -> DataFrame:
    """Five bounded figures of the last bars: trend, range position, momentum phase, body regime, volume conviction."""
    win, o = w(lookback), series()
    full = F.count(F.lit(1)).over(win) == lookback
    close, volume = F.col("close"), F.coalesce("volume", F.lit(0.0))
    low, span = F.min("low").over(win), F.max("high").over(win) - F.min("low").over(win)
    move = close - F.first("close").over(win)
    recent, prior = close - F.lag("close").over(o), F.lag("close").over(o) - F.lag("close", 2).over(o)
    body = F.abs(close - F.col("open"))
    body1 = F.lag(body).over(o)
    mean, before = F.avg(volume).over(win), F.avg(volume).over(o.rowsBetween(-(lookback - 1), -1))
    return bars.select(
        "*",
        F.when(full, clip(move / (span + EPS), -1, 1)).otherwise(0.0).alias("trend"),
        F.when(full, clip((close - low) / (span + EPS), 0, 1)).otherwise(0.5).alias("range_pos"),
        F.when(full, clip((recent - prior) / (F.abs(recent) + F.abs(prior) + EPS), -1, 1)).otherwise(0.0).alias("momentum"),
        F.when(full & (body1 > EPS), clip((body - body1) / (body1 + EPS), -1, 1)).otherwise(0.0).alias("body_regime"),
        F.when(full, clip(F.signum(move) * (volume - before) / (mean + EPS), -1, 1)).otherwise(0.0).alias("conviction"),
    )


def synthetic_volume(bars: DataFrame) -> DataFrame:
    """Where volume is 0 or null: true range times mean volume over mean range of five bars around, else means, else the next known."""
    out = true_range(bars)
    known = F.when(F.col("volume") > 0, F.col("volume"))
    around = series().rowsBetween(-2, 2)
    ratio = div(F.avg(known).over(around), F.avg(F.when(F.col("tr") != 0, F.col("tr"))).over(around))
    guess = F.when(F.col("tr") > 0, F.col("tr") * ratio).otherwise(F.avg(known).over(around))
    out = out.withColumn("is_synthetic", known.isNull()).withColumn("filled", F.coalesce(known, guess))
    before, after = series().rowsBetween(Window.unboundedPreceding, 0), series().rowsBetween(0, Window.unboundedFollowing)
    return out.withColumn("filled", F.coalesce(F.last("filled", True).over(before), F.first("filled", True).over(after), F.lit(0.0))).drop("tr")


def physics(bars: DataFrame) -> DataFrame:
    """The high is the highest and the low the lowest of open, close and itself."""
    return bars.withColumns({"high": F.greatest("open", "close", "high"), "low": F.least("open", "close", "low")})


def session_position(bars: DataFrame) -> DataFrame:
    minutes = F.hour("ts") * 60 + F.minute("ts")
    low, high = F.min(minutes).over(whole()), F.max(minutes).over(whole())
    return bars.withColumn("session_pos", F.when(high > low, (minutes - low) / (high - low)).otherwise(0.0))


def numbered(bars: DataFrame) -> DataFrame:
    return bars.withColumn("i", F.row_number().over(series()).cast("long"))


def status_rank(c: Column | str) -> Column:
    return F.when(col(c) == "FAIL", 2).when(col(c) == "WARN", 1).otherwise(0)
