"""Structured Streaming twins of the batch operators: bars, sessions, upserts, filters with state, staleness."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronolith.sources.sinks import place


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events table as a stream of files."""
    path = f"{sf_dir}/events.parquet"
    schema = spark.read.parquet(path).schema
    # A file source reads folders; the glob makes a single file one of its folder.
    return spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet").parquet(f"{sf_dir}/events.parque[t]").withColumn("ts", F.col("ts").cast("timestamp"))


def drained(stream: DataFrame, mode: str = "append") -> DataFrame:
    """Run a stream over what is there now, into a table in the shared folder, and read that table."""
    spark = stream.sparkSession
    path, mark = place(spark, "stream"), place(spark, "stream-mark")
    if mode == "append":
        stream.writeStream.format("parquet").option("checkpointLocation", mark).outputMode("append").trigger(availableNow=True).start(path).awaitTermination()
        return spark.read.schema(stream.schema).parquet(path)

    def upsert(batch: DataFrame, number: int) -> None:
        batch.withColumn("batch", F.lit(number)).write.mode("append").parquet(path)

    stream.writeStream.option("checkpointLocation", mark).outputMode("update").trigger(availableNow=True).foreachBatch(upsert).start().awaitTermination()
    return spark.read.parquet(path)


def drained_complete(stream: DataFrame) -> DataFrame:
    """As drained, for windows that merge: every batch holds the whole result, of which the last counts."""
    spark = stream.sparkSession
    path, mark = place(spark, "stream"), place(spark, "stream-mark")

    def replace(batch: DataFrame, number: int) -> None:
        batch.withColumn("batch", F.lit(number)).write.mode("overwrite").option("partitionOverwriteMode", "static").parquet(path)

    stream.writeStream.option("checkpointLocation", mark).outputMode("complete").trigger(availableNow=True).foreachBatch(replace).start().awaitTermination()
    return spark.read.parquet(path)


def hourly(stream: DataFrame, delay: str = "45 days") -> DataFrame:
    """Tumbling hourly bars; the watermark is the time in which late rows may still revise a bar."""
    k = F.struct("ts", "event_id")
    g = stream.withWatermark("ts", delay).groupBy(F.col("event_type").alias("symbol"), F.window("ts", "1 hour").alias("w"))
    return g.agg(F.min_by("value", k).alias("open"), F.max("value").alias("high"), F.min("value").alias("low"), F.max_by("value", k).alias("close"), F.count(F.lit(1)).alias("volume")).select("symbol", F.col("w.start").alias("ts"), "open", "high", "low", "close", "volume")


def sessions(stream: DataFrame, gap: str = "30 minutes", delay: str = "1 day") -> DataFrame:
    """Sessions of a symbol without a pause longer than the gap."""
    g = stream.withWatermark("ts", delay).groupBy(F.col("event_type").alias("symbol"), F.session_window("ts", gap).alias("w"))
    return g.agg(F.count(F.lit(1)).alias("n"), F.max("value").alias("high")).select("symbol", F.col("w.start").alias("ts"), F.col("w.end").alias("end"), "n", "high")


def latest(updates: DataFrame, *keys: str) -> DataFrame:
    """The last update of each key."""
    values = [c for c in updates.columns if c not in (*keys, "batch")]
    return updates.groupBy(*keys).agg(F.max_by(F.struct(*values), "batch").alias("v")).select(*keys, "v.*")


def filtered(stream: DataFrame, q: float = 1e-3, r: float = 1.0) -> DataFrame:
    """The scalar filter over a stream of prices: its state of each symbol lives in the state store."""
    from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        n, x, p = state.get if state.exists else (0, 0.0, 1.0)
        rows = pd.concat(list(batches)).sort_values(["ts", "event_id"])
        for z in rows["value"]:
            if n == 0:
                x = z
            else:
                p += q
                k = p / (p + r)
                x, p = x + k * (z - x), (1 - k) * p
            n += 1
        state.update((n, float(x), float(p)))
        yield pd.DataFrame({"symbol": [key[0]], "n": [n], "state": [float(x)]})

    return stream.groupBy("event_type").applyInPandasWithState(step, "symbol string, n long, state double", "n long, x double, p double", "update", GroupStateTimeout.NoTimeout)


