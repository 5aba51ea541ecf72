"""Ordered work on long series, cut to slices of time so that no task holds a series.

A first pass takes from each (symbol, slice) what later slices need of it; that table has a row per
slice and is ordered by symbol; a second pass works inside slices with what was carried in. Inputs
are read twice: give it stored tables where they are costly.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows of a slice that are scanned together. Products of this many factors of 0.93 and more stay far from underflow.
CHUNK = 8192


def _before(keys: tuple[str, ...]):
    return Window.partitionBy(*(keys or (F.lit(0),))).orderBy("__s").rowsBetween(Window.unboundedPreceding, -1)


def _slice(df: DataFrame, order: str, unit: str) -> Column:
    """The slice of a row; a time may also be given as a number of seconds."""
    known = dict(df.dtypes)[order].startswith(("timestamp", "date"))
    return F.date_trunc(unit, F.col(order) if known else F.timestamp_seconds(order))


def carried(df: DataFrame, names: tuple[str, ...], keys: tuple[str, ...] = ("symbol",), unit: str = "month", order: str = "ts") -> DataFrame:
    """The last known value of each column at every row or before, by slices of ``unit``. Rows without a time keep their own values."""
    x = df.withColumn("__s", _slice(df, order, unit))
    last = x.groupBy(*keys, "__s").agg(*[F.max_by(c, F.when(F.col(c).isNotNull(), F.col(order))).alias(f"__{c}") for c in names])
    entry = last.select(*keys, "__s", *[F.last(f"__{c}", True).over(_before(keys)).alias(f"__{c}") for c in names])
    inside = Window.partitionBy(*keys, "__s").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    got = x.withColumns({c: F.last(c, True).over(inside) for c in names}).join(entry, [*keys, "__s"], "left")
    return got.select(*[F.coalesce(c, f"__{c}").alias(c) if c in names else F.col(c) for c in df.columns])


def numbered(df: DataFrame, unit: str = "year") -> DataFrame:
    """Adds the number i (from 0) of each row of a symbol, its slice __s and chunk __c; rows before are counted by slice."""
    x = df.withColumn("__s", _slice(df, "ts", unit))
    counts = x.groupBy("symbol", "__s").agg(F.count(F.lit(1)).alias("__n"))
    before = counts.select("symbol", "__s", F.coalesce(F.sum("__n").over(_before(("symbol",))), F.lit(0)).alias("__n"))
    at = F.row_number().over(Window.partitionBy("symbol", "__s").orderBy("ts")) - 1
    x = x.withColumn("__k", at).join(before, ["symbol", "__s"])
    return x.withColumn("i", F.col("__k") + F.col("__n")).withColumn("__c", F.floor(F.col("__k") / CHUNK)).drop("__k", "__n")


def affine(df: DataFrame, a: Column, b: Column, entry: DataFrame, name: str) -> DataFrame:
    """Adds the states x_i = a_i x_(i-1) + b_i, 0 < a_i <= 1, of rows that ``numbered`` has cut.

    ``entry`` (symbol, x) is the state before a symbol's first row. Inside a chunk the state is
    P (x + sum of b / P), where P is the running product of a; chunks as wholes are affine too, and are
    composed one after the other in an array of a pair per chunk, which gives each its state at entry.
    """
    chunk = ("symbol", "__s", "__c")
    run = Window.partitionBy(*chunk).orderBy("ts").rowsBetween(Window.unboundedPreceding, 0)
    x = df.withColumns({"__a": a, "__b": b}).withColumn("__p", F.exp(F.sum(F.ln("__a")).over(run)))
    x = x.withColumn("__q", F.sum(F.col("__b") / F.col("__p")).over(run)).drop("__a", "__b")
    ends = x.groupBy(*chunk).agg(F.max_by("__p", "ts").alias("p"), F.max_by("__q", "ts").alias("q"))
    lists = ends.groupBy("symbol").agg(F.array_sort(F.collect_list(F.struct("__s", "__c", "p", "q"))).alias("ends")).join(entry, "symbol")
    start = F.array(F.col("x"))
    states = F.aggregate("ends", start, lambda seen, e: F.concat(seen, F.array(e["p"] * (F.element_at(seen, -1) + e["q"]))))
    at = lists.select("symbol", F.explode(F.arrays_zip("ends", F.slice(states, F.lit(1), F.size("ends")).alias("x"))).alias("z")).select("symbol", "z.ends.__s", "z.ends.__c", F.col("z.x").alias("__x"))
    return x.join(at, list(chunk)).withColumn(name, F.col("__p") * (F.col("__x") + F.col("__q"))).drop("__p", "__q", "__x")
