"""Structure of a series: pivots, displacement, liquidity, gaps, order blocks, breakers, phases and inducement.

Everything at bar i reads prices of bars up to i - 1 and the ATR of bar i, which must be positive.
Zones (gaps, blocks, breakers) are events with a bounded life; an event meets the at most
``age`` bars of its life, so the fan-out is a constant.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chronolith.functions.exprs import EPS, clip, extended, series, upto
from chronolith.operators.core import atr, numbered
from chronolith.operators.features import wilder

KEYS = (
    "sweep_bull_mag", "sweep_bear_mag", "nearest_ssl_dist", "nearest_bsl_dist", "pool_density", "ob_quality_score", "ob_direction", "ob_nearest_dist", "ob_age_bars", "fvg_nearest_dist", "fvg_direction", "fvg_fill_pct",
    "fvg_count_active", "fvg_imbalance_ratio", "disp_magnitude", "disp_body_ratio", "disp_volume_ratio", "disp_confirmed", "structure_trend_score", "choch_bull_signal", "choch_bear_signal", "mss_confirmed", "amd_phase",
    "amd_duration", "amd_range_pct", "amd_volume_profile", "indu_confirmed", "indu_direction", "indu_magnitude", "indu_age_bars", "pd_zone", "breaker_direction", "breaker_dist", "breaker_strength",
)


def _lag(c: str, k: int = 1) -> Column:
    return F.lag(c, k).over(series())


#: Settings of the hourly and the daily lane: bars of warm-up, window of structure, life of zones; and of higher timeframes.
HOURLY, DAILY, HIGHER = (32, 24, 24), (50, 40, 60), (50, 40, 50)


def prepared(bars: DataFrame, warmup: int = 32, measure=atr) -> DataFrame:
    """Bars with number, ATR by ``measure``, the prices of the bars before, and whether the warm-up is over."""
    x = numbered(measure(bars))
    old = {f"{c[0]}{k}": _lag(c, k) for c in ("open", "high", "low", "close", "volume") for k in (1, 2, 3)}
    return x.withColumns(old | {"h4": _lag("high", 4), "h5": _lag("high", 5), "l4": _lag("low", 4), "l5": _lag("low", 5), "a3": _lag("atr14", 3)}).withColumn("ready", F.col("i") > warmup)


def displacement(x: DataFrame, threshold: float = 1.5) -> DataFrame:
    before = series().rowsBetween(-21, -2)
    body = F.avg(F.abs(F.col("close") - F.col("open"))).over(before)
    on = lambda c: F.when(F.col("ready"), c).otherwise(0.0)
    x = x.withColumns(
        {
            "disp_magnitude": on((F.col("h1") - F.col("l1")) / F.col("atr14")),
            "disp_body_ratio": on(F.abs(F.col("c1") - F.col("o1")) / (body + EPS)),
            "disp_volume_ratio": on(F.col("v1") / (F.avg("volume").over(before) + EPS)),
        }
    )
    return x.withColumn("disp_confirmed", ((F.col("disp_body_ratio") > threshold) & (F.col("disp_magnitude") > 1.5)).cast("double"))


def pivots(x: DataFrame, prominence: float = 0.3) -> DataFrame:
    """Five-bar fractals, known three bars later: ph and pl are their prices, sh and sl the latest ones."""
    need = prominence * F.col("a3")
    high = F.least(*[F.col("h3") - F.col(f"h{k}") for k in (1, 2, 4, 5)])
    low = F.least(*[F.col(f"l{k}") - F.col("l3") for k in (1, 2, 4, 5)])
    x = x.withColumn("ph", F.when((F.col("i") >= 6) & (high > 0) & (high >= need), F.col("h3"))).withColumn("pl", F.when((F.col("i") >= 6) & (low > 0) & (low >= need), F.col("l3")))
    past = series().rowsBetween(Window.unboundedPreceding, -1)
    return x.withColumns({"sh": F.last("ph", True).over(upto()), "sl": F.last("pl", True).over(upto()), "sh0": F.last("ph", True).over(past), "sl0": F.last("pl", True).over(past)})


def liquidity(x: DataFrame, window: int = 24) -> DataFrame:
    a, on = F.col("atr14"), F.col("ready")
    near = F.collect_list("ph").over(series().rowsBetween(-(window - 3), 0)), F.collect_list("pl").over(series().rowsBetween(-(window - 3), 0))
    x = x.withColumn("__near", F.concat(*near)).withColumn("__r", 5.0 * a)
    within = F.size(F.filter("__near", lambda p: F.abs(p - F.col("c1")) <= F.col("__r")))
    return x.withColumns(
        {
            "nearest_ssl_dist": F.when(on & F.col("sl").isNotNull(), F.least(F.abs(F.col("c1") - F.col("sl")) / a, F.lit(99.0))).otherwise(99.0),
            "nearest_bsl_dist": F.when(on & F.col("sh").isNotNull(), F.least(F.abs(F.col("sh") - F.col("c1")) / a, F.lit(99.0))).otherwise(99.0),
            "sweep_bull_mag": F.when(on & (F.col("sl") > F.col("l1")), (F.col("sl") - F.col("l1")) / a).otherwise(0.0),
            "sweep_bear_mag": F.when(on & (F.col("h1") > F.col("sh")), (F.col("h1") - F.col("sh")) / a).otherwise(0.0),
            "pool_density": F.when(on, within.cast("double")).otherwise(0.0),
        }
    ).drop("__near", "__r")


def structure(x: DataFrame, window: int = 24) -> DataFrame:
    """Breaks of pivots as events (+1, -1); trend over the last events, change of character, shift score, dealing range."""
    event = lambda on, up: F.when(on, F.when(up, 1).otherwise(-1))
    found = F.array_compact(F.array(event(F.col("ph").isNotNull() & F.col("sh0").isNotNull(), F.col("ph") > F.col("sh0")), event(F.col("pl").isNotNull() & F.col("sl0").isNotNull(), F.col("pl") >= F.col("sl0"))))
    e = x.select("symbol", "i", F.posexplode(found).alias("seq", "ev"))
    o = Window.partitionBy("symbol").orderBy("i", "seq")
    last = o.rowsBetween(-(window - 1), 0)
    e = e.withColumn("trend", F.avg("ev").over(last))
    turned = lambda s: (F.col("ev") == s) & (F.lag("ev").over(o) == -s) & (F.lag("ev", 2).over(o) == -s)
    e = e.withColumns({"bull": F.coalesce(turned(1), F.lit(False)), "bear": F.coalesce(turned(-1), F.lit(False))})
    at = e.groupBy("symbol", "i").agg(F.max_by(F.struct("trend", "bull", "bear"), "seq").alias("s"))
    x = x.join(at, ["symbol", "i"], "left").withColumn("s", F.last("s", True).over(upto()))
    on = F.col("ready")
    x = x.withColumns(
        {
            "structure_trend_score": F.when(on, F.coalesce("s.trend", F.lit(0.0))).otherwise(0.0),
            "choch_bull_signal": F.when(on & F.col("s.bull"), 1.0).otherwise(0.0),
            "choch_bear_signal": F.when(on & F.col("s.bear"), 1.0).otherwise(0.0),
            "pd_zone": F.when(on & (F.col("sh") > F.col("sl")), clip((F.col("c1") - F.col("sl")) / (F.col("sh") - F.col("sl")), 0, 1)).otherwise(0.5),
        }
    )
    turn = (F.col("choch_bull_signal") == 1) | (F.col("choch_bear_signal") == 1)
    beyond = F.when(F.col("choch_bull_signal") == 1, F.col("c1") > F.col("sh")).otherwise((F.col("choch_bear_signal") == 1) & (F.col("c1") < F.col("sl")))
    score = F.when(turn, 0.4).otherwise(0.0) + F.when(F.col("disp_magnitude") > 1, clip(0.3 * (F.col("disp_magnitude") - 1) / 2, 0, 0.3)).otherwise(0.0) + F.when(turn & beyond, 0.3).otherwise(0.0)
    return x.withColumn("mss_confirmed", F.when(on, clip(score, 0, 1)).otherwise(0.0)).drop("s")


def _lived(events: DataFrame, bars: DataFrame, life: int) -> DataFrame:
    """Events (symbol, b, ...) with each bar of their life."""
    rows = events.withColumn("i", F.explode(F.sequence(F.col("b"), F.col("b") + life)))
    return rows.join(bars.select("symbol", "i", "h1", "l1", "c1", "atr14", "ready"), ["symbol", "i"])


def gaps(x: DataFrame, age: int = 24) -> DataFrame:
    """Fair value gaps: nearest live one, its direction and fill, count and imbalance of the live ones."""
    bull, bear = (F.col("i") >= 4) & (F.col("l1") > F.col("h3")), (F.col("i") >= 4) & (F.col("h1") < F.col("l3"))
    e = x.where(bull | bear).select("symbol", F.col("i").alias("b"), F.when(bull, F.col("l1")).otherwise(F.col("l3")).alias("top"), F.when(bull, F.col("h3")).otherwise(F.col("h1")).alias("bottom"), F.when(bull, 1.0).otherwise(-1.0).alias("dir"))
    o = Window.partitionBy("symbol", "b").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    size = F.col("top") - F.col("bottom")
    fill = F.when(F.col("dir") > 0, (F.col("top") - F.greatest("l1", "bottom")) / size).otherwise((F.least("h1", "top") - F.col("bottom")) / size)
    z = _lived(e, x, age - 2).withColumn("fill", F.max(F.greatest(fill, F.lit(0.0))).over(o)).where("fill < 0.95 and ready")
    z = z.withColumn("dist", F.abs(F.col("c1") - (F.col("top") + F.col("bottom")) / 2) / F.col("atr14"))
    g = z.groupBy("symbol", "i").agg(F.min(F.struct("dist", "b", "dir", "fill")).alias("n"), F.count(F.lit(1)).cast("double").alias("count"), F.sum("dir").alias("sum"))
    x = x.join(g, ["symbol", "i"], "left")
    near = F.col("n.dist") < 99
    return x.withColumns(
        {
            "fvg_nearest_dist": F.coalesce(F.least("n.dist", F.lit(99.0)), F.lit(99.0)),
            "fvg_direction": F.when(near, F.col("n.dir")).otherwise(0.0),
            "fvg_fill_pct": F.when(near, clip("n.fill", 0, 1)).otherwise(0.5),
            "fvg_count_active": F.coalesce("count", F.lit(0.0)),
            "fvg_imbalance_ratio": F.coalesce(F.col("sum") / (F.col("count") + 1), F.lit(0.0)),
        }
    ).drop("n", "count", "sum")


def blocks(x: DataFrame, age: int = 24, decay: float = 0.02) -> DataFrame:
    """Order blocks until they are mitigated, and breakers from then on."""
    d2, d1 = F.when(F.col("c2") >= F.col("o2"), 1.0).otherwise(-1.0), F.when(F.col("c1") >= F.col("o1"), 1.0).otherwise(-1.0)
    e = x.where(F.col("ready") & (F.col("disp_confirmed") == 1) & (d2 != d1)).select(
        "symbol", F.col("i").alias("b"), F.greatest("o2", "c2").alias("top"), F.least("o2", "c2").alias("bottom"), (-d2).alias("dir"), (F.col("disp_body_ratio") * F.abs(F.col("c2") - F.col("o2")) / (F.col("atr14") + EPS)).alias("quality")
    )
    life = Window.partitionBy("symbol", "b").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    hit = F.when(F.col("dir") > 0, F.col("l1") < F.col("bottom")).otherwise(F.col("h1") > F.col("top"))
    z = _lived(e, x, age - 1).withColumn("m", F.min(F.when(hit, F.col("i"))).over(life)).withColumn("age", F.col("i") - F.col("b") + 1)
    z = z.withColumns({"dist": F.abs(F.col("c1") - (F.col("top") + F.col("bottom")) / 2) / F.col("atr14"), "fade": F.exp(-decay * F.col("age"))})
    ob = z.where("m is null").groupBy("symbol", "i").agg(F.min(F.struct("dist", "b", (F.col("quality") * F.col("fade")).alias("q"), "dir", "age")).alias("ob"))
    br = z.where("m is not null").groupBy("symbol", "i").agg(F.min(F.struct("dist", "m", "b", (F.col("quality") * 0.8 * F.col("fade")).alias("q"), (-F.col("dir")).alias("dir"))).alias("br"))
    x = x.join(ob, ["symbol", "i"], "left").join(br, ["symbol", "i"], "left")
    near = F.col("ob.dist") < 99
    return x.withColumns(
        {
            "ob_quality_score": F.when(near, F.col("ob.q")).otherwise(0.0),
            "ob_direction": F.when(near, F.col("ob.dir")).otherwise(0.0),
            "ob_nearest_dist": F.when(near, F.col("ob.dist")).otherwise(99.0),
            "ob_age_bars": F.when(near, F.col("ob.age").cast("double")).otherwise(0.0),
            "breaker_direction": F.coalesce("br.dir", F.lit(0.0)),
            "breaker_dist": F.coalesce(F.least("br.dist", F.lit(99.0)), F.lit(99.0)),
            "breaker_strength": F.coalesce("br.q", F.lit(0.0)),
        }
    ).drop("ob", "br")


def inducement(x: DataFrame, warmup: int = 32, threshold: float = 0.5) -> DataFrame:
    a, on = F.col("atr14"), F.col("i") > warmup + 1
    low, high = F.col("sl") - F.col("l2"), F.col("h2") - F.col("sh")
    bull = on & (low > 0) & (low < threshold * a) & (F.col("c1") > F.col("sl"))
    bear = on & (high > 0) & (high < threshold * a) & (F.col("c1") < F.col("sh"))
    x = x.withColumn("e", F.when(bear, F.struct("i", F.lit(-1.0).alias("dir"), (high / a).alias("mag"))).when(bull, F.struct("i", F.lit(1.0).alias("dir"), (low / a).alias("mag"))))
    x = x.withColumn("p", F.last("e", True).over(upto()))
    gone = (F.col("i") - F.col("p.i")).cast("double")
    return x.withColumns(
        {
            "indu_confirmed": F.col("e").isNotNull().cast("double"),
            "indu_direction": F.when(on, F.coalesce("p.dir", F.lit(0.0))).otherwise(0.0),
            "indu_magnitude": F.when(on, F.coalesce(F.col("p.mag") * F.exp(-0.05 * gone), F.lit(0.0))).otherwise(0.0),
            "indu_age_bars": F.when(on, F.coalesce(clip(gone / 20, 0, 1), F.lit(0.0))).otherwise(0.0),
        }
    ).drop("e", "p")


def phases(x: DataFrame) -> DataFrame:
    """Accumulation, manipulation and distribution as a small machine per series; it needs each bar's state of the one before."""
    x = x.withColumn("__v50", F.avg("volume").over(series().rowsBetween(-50, -1)))

    def run(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values("i")
        state, n, high, low, volume = 0, 0, float("-inf"), float("inf"), 0.0
        out = []
        for ready, a, h, lo, v, v50, sweep, disp in zip(g["ready"], g["atr14"], g["h1"], g["l1"], g["v1"], g["__v50"], g[["sweep_bull_mag", "sweep_bear_mag"]].max(axis=1), g["disp_confirmed"]):
            if not ready:
                out.append((0.0, 0.0, 0.0, 0.5))
                continue
            n, high, low, volume = n + 1, max(high, h), min(low, lo), volume + v
            fresh = state == 0
            if fresh:
                state, n, high, low, volume = 1, 1, h, lo, v
            was = state
            if state == 1 and sweep > 0.5:
                state = 2
            elif state == 1 and n > 30:
                was = -1
            elif state == 2 and was == 2 and disp == 1:
                state = 3
            elif state == 3 and was == 3 and n >= 10 and high - low < 0.5 * a and volume / n < 0.7 * v50:
                state = 1
            if state != was:
                n, high, low, volume = 1, h, lo, v
            out.append(({1: 0.33, 2: 0.67, 3: 1.0}[state], min(n / 50, 1.0), (high - low) / a, volume / n / (v50 + EPS)))
        g[["amd_phase", "amd_duration", "amd_range_pct", "amd_volume_profile"]] = out
        return g.drop(columns="__v50")

    schema = extended(x.drop("__v50"), "amd_phase", "amd_duration", "amd_range_pct", "amd_volume_profile")
    return x.groupBy("symbol").applyInPandas(run, schema)


def core_columns(bars: DataFrame, warmup: int = 32, structure_window: int = 24, age: int = 24) -> DataFrame:
    """All 34 columns of KEYS."""
    x = liquidity(pivots(displacement(prepared(bars, warmup))), structure_window)
    x = inducement(structure(x, structure_window), warmup)
    x = phases(x)
    return blocks(gaps(x, age), age).select("symbol", "ts", "i", "close", "atr14", *KEYS)


def higher(htf: DataFrame, prefix: str) -> DataFrame:
    """symbol, close_ts, trend score and phase of bars of a higher timeframe (with close_ts), by Wilder's ATR.

    No sweeps are looked for there, so the phase machine stays in its first phase once the warm-up is over.
    """
    warmup, window, _ = HIGHER
    x = structure(pivots(displacement(prepared(htf, warmup, lambda b: wilder(b).withColumnRenamed("atr_wilder", "atr14")))), window)
    return x.select("symbol", "close_ts", F.col("structure_trend_score").alias(f"{prefix}_structure_trend_score"), F.when(F.col("ready"), 0.33).otherwise(0.0).alias(f"{prefix}_amd_phase"))


def confluence(x: DataFrame) -> DataFrame:
    """Products of the core columns that name a set-up, two of them with the first higher timeframe's columns ``htf1_*``."""
    sweep = ((F.col("sweep_bull_mag") > 0) | (F.col("sweep_bear_mag") > 0)).cast("double")
    side = F.when(F.col("pd_zone") < 0.5, 1 - F.col("pd_zone")).otherwise(F.col("pd_zone"))
    return x.withColumns(
        {
            "sweep_disp_sync": sweep * F.col("disp_confirmed"),
            "ob_fvg": F.when(F.col("fvg_count_active") > 0, F.col("ob_quality_score") * (1 - F.col("fvg_fill_pct"))).otherwise(0.0),
            "phase_weighted_trend": F.col("amd_phase") * F.col("structure_trend_score"),
            "full_entry": F.col("mss_confirmed") * side,
            "htf_trend_alignment": F.signum("structure_trend_score") * F.signum("htf1_structure_trend_score"),
            "htf_phase_cascade": F.col("amd_phase") * F.col("htf1_amd_phase"),
            "pd_ob": F.when(F.col("ob_nearest_dist") < 3, F.abs(F.col("pd_zone") - 0.5) * F.col("ob_quality_score")).otherwise(0.0),
        }
    )
