"""Bars, companions, ledgers and messages from the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronolith.sources import sinks

OHLC = ("open", "high", "low", "close")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bars_1h(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hourly bars of ``events``: one symbol per event type; open and close by (ts, event_id)."""
    e = table(spark, sf_dir, "events").select(F.col("event_type").alias("symbol"), F.date_trunc("hour", F.col("ts").cast("timestamp")).alias("bar"), F.struct("ts", "event_id").alias("k"), "value")
    out = e.groupBy("symbol", "bar").agg(F.min_by("value", "k").alias("open"), F.max("value").alias("high"), F.min("value").alias("low"), F.max_by("value", "k").alias("close"), F.count(F.lit(1)).cast("double").alias("volume"))
    return out.withColumnRenamed("bar", "ts").select("symbol", "ts", *OHLC, "volume")


_KEY = ("l_orderkey", "l_linenumber", "l_extendedprice", "l_quantity")


def trades(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trades of ``lineitem``: their day, price, and the four numbers that are a trade's key; one symbol per return flag."""
    price = F.try_divide("l_extendedprice", "l_quantity")
    return table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("symbol"), F.date_trunc("day", F.col("l_shipdate").cast("timestamp")).alias("ts"), price.alias("p"), *_KEY)


def bars_1d(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily bars of the trades; open and close by their key."""
    t = trades(spark, sf_dir).select("symbol", "ts", "p", F.struct(*_KEY).alias("k"), "l_quantity")
    return t.groupBy("symbol", "ts").agg(F.min_by("p", "k").alias("open"), F.max("p").alias("high"), F.min("p").alias("low"), F.max_by("p", "k").alias("close"), F.sum("l_quantity").alias("volume")).select("symbol", "ts", *OHLC, "volume")


def spans(t: DataFrame) -> DataFrame:
    """What plain numbers tell of each daily bar, without a sort: high, low, volume, its first and last order."""
    return t.groupBy("symbol", "ts").agg(F.max("p").alias("high"), F.min("p").alias("low"), F.sum("l_quantity").alias("volume"), F.min("l_orderkey").alias("first"), F.max("l_orderkey").alias("last"))


def daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The bars of ``bars_1d``, stored, for queries that read them several times.

    The least of keys of four numbers takes a sort of all trades. Here a first pass adds them up by
    hash, and a second one compares the keys of each bar's first and last order only.
    """
    t = trades(spark, sf_dir)
    s = sinks.stored(spans(t), "spans").withColumnsRenamed({"symbol": "__symbol", "ts": "__ts"})
    order = F.col("l_orderkey")
    ends = order.isNull() | (order == F.col("first")) | (order == F.col("last"))
    x = t.join(s, F.col("symbol").eqNullSafe(F.col("__symbol")) & F.col("ts").eqNullSafe(F.col("__ts")) & ends)
    one = lambda c: F.first(c).alias(c)
    g = x.groupBy("symbol", "ts").agg(F.min_by("p", F.struct(*_KEY)).alias("open"), one("high"), one("low"), F.max_by("p", F.struct(*_KEY)).alias("close"), one("volume"))
    return sinks.stored(g, "daily")


def vix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A companion volatility index by day, of the orders' mean price."""
    o = table(spark, sf_dir, "orders")
    return o.groupBy(F.date_trunc("day", F.col("o_orderdate").cast("timestamp")).alias("ts")).agg((F.avg("o_totalprice") / 1e4).alias("vix"))


def ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A trade ledger of the purchases: one trade an event, R and outcome by plain arithmetic."""
    e = table(spark, sf_dir, "events").where("event_type = 'purchase'")
    r = (F.col("event_id") % 41 - 20) / F.lit(10.0)
    return e.select("event_id", F.col("ts").cast("timestamp").alias("ts"), F.col("event_type").alias("symbol"), F.when(F.col("event_id") % 2 == 0, "LONG").otherwise("SHORT").alias("direction"), F.col("value").alias("entry_price"), r.alias("pnl_r"), (r > 0).cast("int").alias("win"))


def oos(bars: DataFrame) -> DataFrame:
    """A stand-in for out-of-sample predictions: a probability in [0, 1) from the bar's time."""
    return bars.select("symbol", "ts", (F.pmod(F.unix_timestamp("ts") / 3600 * 7919 + F.length("symbol") * 131, F.lit(1000)) / 1000).cast("double").alias("p"))
