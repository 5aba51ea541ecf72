"""Column helpers shared by all operators. Series are keyed by ``symbol`` and ordered by ``ts``."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F
from pyspark.sql import types as T

EPS = 1e-9


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def series(*keys: str) -> WindowSpec:
    return Window.partitionBy(*(keys or ("symbol",))).orderBy("ts")


def w(n: int, *keys: str) -> WindowSpec:
    """The last n rows, the current one included."""
    return series(*keys).rowsBetween(-(n - 1), 0)


def upto(*keys: str) -> WindowSpec:
    return series(*keys).rowsBetween(Window.unboundedPreceding, 0)


def ahead(a: int, b: int, *keys: str) -> WindowSpec:
    return series(*keys).rowsBetween(a, b)


def whole(*keys: str) -> WindowSpec:
    return Window.partitionBy(*(keys or ("symbol",)))


def clip(c: Column | str, low: float, high: float) -> Column:
    return F.when(col(c).isNotNull(), F.least(F.greatest(col(c), F.lit(float(low))), F.lit(float(high))))


def div(a: Column | str, b: Column | str) -> Column:
    """a / b, null where b is 0 or null."""
    return F.try_divide(col(a).cast("double"), col(b).cast("double"))


def finite(c: Column | str) -> Column:
    c = col(c)
    return c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf")))


@F.pandas_udf(T.DoubleType())
def libm_ln(x: pd.Series) -> pd.Series:
    """ln to the last bit of the C library, null where it isn't known; F.ln is a bit off for one value in 20."""
    return pd.Series([math.log(v) if v > 0 else None for v in x], dtype="float64")


def clean(c: Column | str) -> Column:
    """NaN and infinities become null, so that comparisons with them are not true."""
    return F.when(finite(c), col(c))


def r6(c: Column | str) -> Column:
    """Six decimals, without a negative zero."""
    return F.round(col(c).cast("double"), 6) + F.lit(0.0)


def seconds(c: Column | str = "ts") -> Column:
    return F.unix_timestamp(col(c))


def bound(value: Column, use) -> Column:
    """``use(value)`` with the value computed once: lambdas compute outer expressions again per element."""
    return F.element_at(F.transform(F.array(value), use), 1)


def share_le(c: str, n: int) -> Column:
    """Share of the last n values that are at most the current one."""
    return F.size(F.filter(F.collect_list(c).over(w(n)), lambda v: v <= F.col(c))).cast("double") / F.lit(float(n))


def extended(df: DataFrame, *doubles: str) -> T.StructType:
    """The schema of a frame with more double columns; a frame's own schema object must not be added to."""
    return T.StructType([*df.schema.fields, *[T.StructField(c, T.DoubleType()) for c in doubles]])


def settled(df: DataFrame) -> DataFrame:
    """The same rows behind a generator, which the optimizer doesn't fold later expressions into: each column is computed once."""
    return df.select(F.inline(F.array(F.struct(*df.columns))))
