"""State of the scalar filter by bar: completed swings, retracement levels of higher timeframes, narrative since a flip."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chronolith.functions.exprs import EPS, series, upto, whole
from chronolith.operators import core, features

#: Measures of a completed swing, as endings of their columns.
MEASURES = ("", "_per_bar", "_per_range", "_per_atr_range", "_eff")
SIDES = ("bull", "bear")
DIRECTIONAL = tuple(c for m in MEASURES for s in SIDES for c in (f"{s}_swing_delta{m}", f"prev_{s}_swing_delta{m}", f"{s}_swing_delta{m}_div"))
STATE = ("bar_delta", "regime", "swing_accum", "net_swing_delta", *DIRECTIONAL)
NARRATIVE = ("regime_streak", "regime_accel", "cum_disp_since_flip", "max_dd_since_flip", "swing_count_since_flip", "fib_range_age", "fib_range_size")
#: Retracement ratios (fixed values).
RATIOS = (0.0, 0.236, 0.382, 0.5, 0.618, 0.786, 1.0)
#: Slots of retracements with their timeframes, and timeframes of the narrative, by lane (fixed values).
SLOTS = {"1H": {"a": "1M", "b": "1W", "c": "1D"}, "1D": {"a": "6M", "b": "1M", "c": "1W"}}
NARRATIVE_ABOVE = {"1H": ("1D", "1W"), "1D": ("1W", "1M")}


def state(bars: DataFrame) -> DataFrame:
    """Bars with the 34 columns of STATE, the last confirmed high and low (sh, sl), their bars and the bar number i.

    A bar that confirms a swing ends the segment before it; of two swings on one bar the
    high comes first and the low ends an empty segment. Segments are aggregated once per
    (symbol, segment) and joined back; a range that isn't positive or finite counts as 1.
    """
    x = core.numbered(features.with_crossings(features.candle_delta(core.atr(features.kalman(bars)))))
    x = x.withColumn("atr", F.when((F.col("atr14") > 0) & (F.col("atr14") < float("inf")), F.col("atr14")).otherwise(1.0)).withColumn("hit", (F.col("up") | F.col("down")).cast("int"))
    x = x.withColumnRenamed("delta", "bar_delta").withColumn("seg", F.sum("hit").over(upto()))
    inside = Window.partitionBy("symbol", "seg").orderBy("ts").rowsBetween(Window.unboundedPreceding, 0)
    x = x.withColumn("swing_accum", F.sum("bar_delta").over(inside))
    segments = x.groupBy("symbol", "seg").agg(
        F.sum("bar_delta").alias("raw"), F.count(F.lit(1)).alias("n"), (F.max("high") - F.min("low")).alias("range"), F.expr("percentile(atr, 0.5)").alias("med"),
        F.min_by(F.struct("i", "up", "down", "high_price", "low_price"), "i").alias("e"),
    )
    return x.drop("up", "down", "high_price", "low_price").join(_completed(segments), ["symbol", "seg"]).drop("seg")


def _completed(segments: DataFrame) -> DataFrame:
    """One row per segment: what is known of completed swings from its first bar on."""
    o = Window.partitionBy("symbol").orderBy("seg")
    so_far, earlier = o.rowsBetween(Window.unboundedPreceding, 0), o.rowsBetween(Window.unboundedPreceding, -1)
    x = segments.select("symbol", "seg", "e", *[F.lag(c).over(o).alias(c) for c in ("raw", "n", "range", "med")])
    floor = lambda c: F.greatest(c, F.lit(EPS))
    raw = F.col("raw")
    values = (raw, raw / F.col("n"), raw / floor(F.col("range")), raw / floor(F.col("range") / floor(F.col("med"))), raw / floor(F.col("n") * F.col("med")))
    full, none = F.array(*values), F.array(*[F.lit(0.0)] * len(values))
    known = F.col("seg") > 0
    x = x.withColumns({"bull": F.when(known & F.col("e.up"), full), "bear": F.when(known & F.col("e.down"), F.when(F.col("e.up"), none).otherwise(full))})
    ended = F.when(known, F.when(F.col("e.up") & F.col("e.down"), 0.0).otherwise(raw))
    x = x.withColumn("ended", ended).withColumn("before", F.lag("ended").over(o))
    net = F.when(~known, 0.0).when(F.col("e.up") & F.col("e.down"), -raw).otherwise(F.coalesce(raw - F.col("before"), F.lit(0.0)))
    last = lambda on, c: F.last(F.when(on, c), True).over(so_far)
    up, down = known & F.col("e.up"), known & F.col("e.down")
    x = x.select(
        "symbol", "seg", net.alias("net_swing_delta"), F.last("bull", True).over(so_far).alias("bull"), F.last("bear", True).over(so_far).alias("bear"),
        *[F.when(F.col(s).isNotNull(), F.struct(F.last(s, True).over(earlier).alias("v"))).alias(f"{s}_prev") for s in SIDES],
        last(up, F.col("e.high_price")).alias("sh"), last(up, F.col("e.i")).alias("sh_i"), last(down, F.col("e.low_price")).alias("sl"), last(down, F.col("e.i")).alias("sl_i"),
    )
    x = x.withColumns({f"{s}_prev": F.last(f"{s}_prev", True).over(so_far)["v"] for s in SIDES})
    out = []
    for k, m in enumerate(MEASURES):
        for s in SIDES:
            now, prev = F.get(F.col(s), F.lit(k)), F.get(F.col(f"{s}_prev"), F.lit(k))
            zero = F.lit(0.0)
            out += [F.coalesce(now, zero).alias(f"{s}_swing_delta{m}"), F.coalesce(prev, zero).alias(f"prev_{s}_swing_delta{m}"), F.coalesce(now - prev, zero).alias(f"{s}_swing_delta{m}_div")]
    return x.select("symbol", "seg", "net_swing_delta", *out, "sh", "sh_i", "sl", "sl_i")


def fib_columns(slot: str) -> list[str]:
    return [f"kf_{slot}_{k}_{c}" for k in range(1, len(RATIOS) + 1) for c in ("o", "h", "l", "c", "delta")]


def retracements(base: DataFrame, above: DataFrame, slot: str, carried: dict[str, str] | None = None) -> DataFrame:
    """Base state with 7 ratios x (o, h, l, c, delta) of the range between the last high and low of ``above`` visible by its close.

    (price - level) / range of the base bar, and the bar's delta; all 0 until both swings are known and the high is above the low.
    The one as-of join also brings the columns of ``above`` named in ``carried`` under their new names, 0 before its first close.
    """
    carried = carried or {}
    seen = above.select("symbol", F.col("close_ts").alias("__seen"), F.col("sh").alias("__sh"), F.col("sl").alias("__sl"), *[F.col(c).alias(n) for c, n in carried.items()])
    x = core.as_of(base, seen, visible="__seen", prefix="").fillna(0.0, list(carried.values()))
    ok = F.col("__sh") > F.col("__sl")
    cols = {}
    for k, ratio in enumerate(RATIOS, 1):
        level = F.col("__sl") + ratio * (F.col("__sh") - F.col("__sl"))
        cols |= {f"kf_{slot}_{k}_{c[0]}": F.when(ok, (F.col(c) - level) / F.col("atr")).otherwise(0.0) for c in ("open", "high", "low", "close")}
        cols[f"kf_{slot}_{k}_delta"] = F.when(ok, F.col("bar_delta")).otherwise(0.0)
    return x.withColumns(cols).drop("__seen", "__sh", "__sl")


def filter_lane(bars: DataFrame, lane: str = "1D") -> DataFrame:
    """241 columns: own state, retracements of three slots, and the states of their timeframes as of their closes (0 before)."""
    out = state(bars)
    mapped = []
    for slot, tf in SLOTS[lane].items():
        above = state(core.close_time(core.resample(bars, tf), tf))
        names = [f"kf_{tf.lower()}_{c}" for c in STATE]
        out = retracements(out, above, slot, dict(zip(STATE, names)))
        mapped += names
    fib = [c for slot in SLOTS[lane] for c in fib_columns(slot)]
    return out.select("symbol", "ts", *[F.col(c).alias(f"kf_{c}") for c in STATE], *fib, *mapped)


def narrative(x: DataFrame) -> DataFrame:
    """State with the 7 columns of NARRATIVE: streak, acceleration, move, drawdown and swings since the last flip; age and size of the swing range."""
    x = features.regime_streaks(x, atr="atr")
    inside = Window.partitionBy("symbol", "island").orderBy("ts").rowsBetween(Window.unboundedPreceding, 0)
    ok = F.col("sh") > F.col("sl")
    return x.withColumns(
        {
            "swing_count_since_flip": F.sum("hit").over(inside).cast("double"),
            "fib_range_age": F.when(ok, F.col("i") - F.greatest("sh_i", "sl_i")).otherwise(0).cast("double"),
            "fib_range_size": F.when(ok, (F.col("sh") - F.col("sl")) / F.col("atr")).otherwise(0.0),
        }
    )


def narrative_lane(bars: DataFrame, lane: str = "1D", own: DataFrame | None = None) -> DataFrame:
    """23 columns: own narrative, that of two timeframes as of their closes (0 before, and where they have under 3 bars), and the sum of regime signs. ``own`` is the bars' state if it is known."""
    out = narrative(state(bars) if own is None else own).select("symbol", "ts", *[F.col(c).alias(f"nc_{c}") for c in NARRATIVE], F.signum("regime").alias("__sum"))
    for tf in NARRATIVE_ABOVE[lane]:
        above = narrative(state(core.close_time(core.resample(bars, tf), tf))).withColumn("__n", F.count(F.lit(1)).over(whole())).where("__n >= 3")
        names = [f"nc_{tf.lower()}_{c}" for c in NARRATIVE]
        above = above.select("symbol", F.col("close_ts").alias("__seen"), F.signum("regime").alias("__sign"), *[F.col(c).alias(n) for c, n in zip(NARRATIVE, names)])
        out = core.as_of(out, above, visible="__seen", prefix="").fillna(0.0, ["__sign", *names])
        out = out.withColumn("__sum", F.col("__sum") + F.col("__sign")).drop("__sign", "__seen")
    return out.withColumns({"nc_cross_tf_sum": F.col("__sum"), "nc_cross_tf_abs": F.abs("__sum")}).drop("__sum")
