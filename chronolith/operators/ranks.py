"""Exact weighted and plain quantiles by refinement: no task orders, or holds, the values of a key.

Each pass adds up weights in equal buckets between a key's bounds and descends into the bucket that
holds the rank, whose rows alone go on. After the last pass the few values left in a bucket are
added up by value. Buckets are monotone in the value, and a row is followed by the same arithmetic
in every pass, so rounding at their edges can't lose one. A task holds sums by bucket.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chronolith.functions.exprs import clean

#: Buckets of one pass, and passes.
BUCKETS, PASSES = 256, 3


def _bucket(k: int) -> Column:
    at = F.floor(F.try_divide(F.col("__v") - F.col(f"__lo{k}"), F.col(f"__step{k}")))
    return F.least(F.greatest(F.coalesce(at, F.lit(0)), F.lit(0)), F.lit(BUCKETS - 1))


def _first(df: DataFrame, by: tuple[str, ...], order: str) -> DataFrame:
    """Per key and rank the first bucket or value up to which the sums reach the need, the last one if rounding leaves none; with the sum before it."""
    run = Window.partitionBy(*by, "__tag").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    x = df.withColumn("__sum", F.col("__below") + F.sum("__w").over(run))
    late = F.col("__sum") < F.col("__need")
    found = x.groupBy(*by, "__tag").agg(F.min_by(F.struct(F.col(order).alias("at"), (F.col("__sum") - F.col("__w")).alias("below")), F.when(~late, F.col(order))).alias("hit"), F.max_by(F.struct(F.col(order).alias("at"), (F.col("__sum") - F.col("__w")).alias("below")), order).alias("end"))
    return found.select(*by, "__tag", F.coalesce("hit", "end").alias("__z"))


def at_ranks(rows: DataFrame, needs: DataFrame, *by: str) -> DataFrame:
    """``by``, __tag, q: the least value up to which the weights of a key reach ``__need``. rows: by, __v, __w; needs: by, __tag, __need."""
    bounds = rows.groupBy(*by).agg(F.min("__v").alias("__lo0"), ((F.max("__v") - F.min("__v")) / BUCKETS).alias("__step0"))
    t = needs.join(bounds, list(by)).withColumn("__below", F.lit(0.0))
    for k in range(PASSES + 1):
        x = rows.join(t, list(by))
        for j in range(k):
            x = x.where(_bucket(j) == F.col(f"__at{j}"))
        if k == PASSES:
            left = x.groupBy(*by, "__tag", "__need", "__below", "__v").agg(F.sum("__w").alias("__w"))
            return _first(left, by, "__v").select(*by, "__tag", F.col("__z.at").alias("q"))
        sums = x.groupBy(*by, "__tag", "__need", "__below", _bucket(k).alias("__b")).agg(F.sum("__w").alias("__w"))
        t = t.drop("__below").join(_first(sums, by, "__b"), [*by, "__tag"]).withColumns({f"__at{k}": F.col("__z.at"), "__below": F.col("__z.below")}).drop("__z")
        t = t.withColumns({f"__lo{k + 1}": F.col(f"__lo{k}") + F.col(f"__at{k}") * F.col(f"__step{k}"), f"__step{k + 1}": F.col(f"__step{k}") / BUCKETS})
    raise AssertionError


def _tagged(df: DataFrame, tags: list[tuple[float, Column]]) -> DataFrame:
    return df.withColumn("__t", F.explode(F.array(*[F.struct(F.lit(q).alias("share"), c.alias("need")) for q, c in tags])))


def weighted_quantiles(df: DataFrame, value: str, weight: str, shares: tuple[float, ...], *by: str) -> DataFrame:
    """``by``, share, q: the least value up to which the weights reach each share of their sum. Values that aren't finite and weights of 0 or null take no part."""
    rows = df.select(*by, clean(F.col(value).cast("double")).alias("__v"), F.col(weight).cast("double").alias("__w")).where("__v is not null and __w > 0")
    total = rows.groupBy(*by).agg(F.sum("__w").alias("__total"))
    needs = _tagged(total, [(q, F.col("__total") * q) for q in shares]).select(*by, F.col("__t.share").alias("__tag"), F.col("__t.need").alias("__need"))
    return at_ranks(rows, needs, *by).withColumnRenamed("__tag", "share")


def quantiles(df: DataFrame, value: str, shares: tuple[float, ...], *by: str) -> DataFrame:
    """``by``, share, n, q: quantiles between order statistics, linear, of n finite values."""
    rows = df.select(*by, clean(F.col(value).cast("double")).alias("__v"), F.lit(1.0).alias("__w")).where("__v is not null")
    place = F.col("__t.share") * (F.col("n") - 1)
    ends = _tagged(rows.groupBy(*by).agg(F.count(F.lit(1)).alias("n")), [(q, F.lit(0.0)) for q in shares]).select(*by, "n", F.col("__t.share").alias("share"), place.alias("place"))
    needs = ends.select(*by, F.explode(F.array_distinct(F.array(F.floor("place") + 1, F.ceil("place") + 1))).alias("__tag")).distinct().withColumn("__need", F.col("__tag").cast("double"))
    found = at_ranks(rows, needs, *by)
    low, high = (found.select(*by, F.col("__tag").alias(t), F.col("q").alias(v)) for t, v in (("__l", "low"), ("__h", "high")))
    x = ends.withColumns({"__l": F.floor("place") + 1, "__h": F.ceil("place") + 1}).join(low, [*by, "__l"]).join(high, [*by, "__h"])
    return x.select(*by, "share", "n", (F.col("low") + (F.col("high") - F.col("low")) * (F.col("place") - F.floor("place"))).alias("q"))
