"""The flagship query: daily bars with the last closed week, ATR, volatility and a gate."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronolith.functions.exprs import r6, seconds, series, w
from chronolith.operators import core
from chronolith.sources import bars as B


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    daily = B.bars_1d(spark, sf_dir)
    weekly = core.close_time(core.resample(daily, "1W"), "1W").select("symbol", "close_ts", F.col("close").alias("week_close"))
    seen = core.as_of(core.atr(daily), weekly, prefix="")
    ret = F.ln(F.col("close") / F.lag("close").over(series()))
    out = seen.withColumn("ret", ret).withColumn("vol", F.stddev_pop("ret").over(w(21)))
    gate = F.when(F.col("week_close").isNull(), 1).when(F.col("atr14") <= 0, 4).when(F.abs(F.col("ret")) > 2.5 * F.col("vol"), 5).otherwise(0)
    return out.select("symbol", seconds().alias("ts_s"), r6("close").alias("close"), r6("week_close").alias("week_close"), r6("atr14").alias("atr14"), r6("vol").alias("vol"), gate.alias("skip_code"))
