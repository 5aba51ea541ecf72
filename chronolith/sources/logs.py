"""A log source: message lines with symbol, prices and times, and helpers for times of unknown form."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronolith.functions.exprs import col

#: Seconds of each timeframe; calendar ones by 30-day months.
SECONDS = {"1H": 3600, "1D": 86400, "1W": 7 * 86400, "1M": 30 * 86400, "3M": 90 * 86400, "6M": 180 * 86400, "12M": 360 * 86400}
_MINUTES = {"60": "1H", "1D": "1D", "D": "1D", "1W": "1W", "W": "1W", "1M": "1M", "M": "1M", "3M": "3M", "6M": "6M", "12M": "12M"}


def messages(bars: DataFrame, timeframe: str = "60") -> DataFrame:
    """Lines as a chart's log prints them, with thousands separators."""
    number = lambda c: F.format_number(c, 2)
    close_ms = F.format_number((F.unix_timestamp("ts") + 3600) * 1000, 0)
    return bars.select("symbol", "ts", F.concat(F.lit("SYMBOL:"), F.upper("symbol"), F.lit(" ,OPEN:"), number("open"), F.lit(" , HIGH:"), number("high"), F.lit(" , LOW:"), number("low"), F.lit(" , CLOSE:"), number("close"), F.lit(" , VOLUME:"), number("volume"), F.lit(" , CLOSE TIME:"), close_ms, F.lit(f" , TIME FRAME:{timeframe}")).alias("message"))


def field(message: Column | str, name: str) -> Column:
    """The number behind a field's name; null where it isn't one."""
    return F.expr(f"try_cast(regexp_replace(regexp_extract({message}, '{name}:\\\\s*([-0-9.,]*[0-9])', 1), ',', '') as double)")


def length(timeframe: Column | str) -> Column:
    """Seconds of a timeframe; null for another name."""
    return F.try_element_at(F.create_map(*[F.lit(v) for kv in SECONDS.items() for v in kv]), col(timeframe))


def parse(lines: DataFrame, message: str = "message") -> DataFrame:
    """Bars of log lines; lines without all four prices are dropped. A bar's time is its close time less its length."""
    names = ("OPEN", "HIGH", "LOW", "CLOSE", "VOLUME")
    tf = F.regexp_extract(message, r"TIME FRAME:\s*(\w+)", 1)
    x = lines.select(F.nullif(F.trim(F.regexp_extract(message, r"SYMBOL:\s*(.*?)\s*,\s*OPEN:", 1)), F.lit("")).alias("symbol"), *[field(message, n).alias(n.lower()) for n in names], field(message, "CLOSE TIME").alias("close_ms"), F.try_element_at(F.create_map(*[F.lit(v) for kv in _MINUTES.items() for v in kv]), tf).alias("timeframe"))
    return x.withColumn("ts_s", (F.col("close_ms") / 1000).cast("long") - length("timeframe")).dropna(subset=["symbol", "open", "high", "low", "close"]).drop("close_ms")


def epoch_seconds(df: DataFrame, value: str, *keys: str) -> DataFrame:
    """Numbers of unknown unit as seconds: the unit of a group is told by its median magnitude."""
    median = df.groupBy(*keys).agg(F.expr(f"percentile(abs({value}), 0.5)").alias("m"))
    unit = F.when(F.col("m") >= 1e17, 1e9).when(F.col("m") >= 1e14, 1e6).when(F.col("m") >= 1e11, 1e3).otherwise(1.0)
    return df.join(median.withColumn("unit", unit), list(keys)).withColumn("seconds", F.floor(F.col(value) / F.col("unit")).cast("long")).drop("m", "unit")


def first_time(*candidates: str) -> Column:
    """The first candidate that is a time."""
    return F.coalesce(*[F.try_to_timestamp(col(c)) for c in candidates])


def from_filename(path: Column | str) -> tuple[Column, Column]:
    """(symbol, timeframe) of names such as NSE_NIFTY, 60.csv or BTCUSD_1D.csv."""
    name = F.regexp_replace(F.element_at(F.split(col(path), "/"), -1), r"\.[A-Za-z0-9]+$", "")
    pattern = r"^(.*?)[,_ ]+(60|1H|1D|D|1W|W|1M|3M|6M|12M)$"
    tf = F.upper(F.regexp_extract(name, pattern, 2))
    return F.upper(F.regexp_replace(F.when(name.rlike(pattern), F.regexp_extract(name, pattern, 1)).otherwise(name), r"^.*_", "")), F.try_element_at(F.create_map(*[F.lit(v) for kv in ({"1H": "1H"} | _MINUTES).items() for v in kv]), tf)
