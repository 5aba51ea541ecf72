"""Feature families of window expressions: volatility surface, companion index, targets, Hurst, swings, narrative."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chronolith.functions.exprs import EPS, ahead, bound, clean, clip, col, series, share_le, upto, w, whole
from chronolith.operators import scan
from chronolith.sources import sinks

#: Bars a year of each timeframe on an equity calendar.
ANNUAL = {"1H": 1512, "1D": 252, "1W": 52, "1M": 12, "3M": 4, "6M": 2, "12M": 1}
RV_KEYS = ("yz_log", "yz_z", "yz_pctrank", "yz_trend", "yz_shock", "vov", "pk_log", "range_eff", "jump_ratio", "rv_asym", "rv_skew", "rs_plus", "rs_minus", "rs_leverage")


def _log_ratio(a: Column | str, b: Column | str) -> Column:
    """ln(a / b) as IEEE has it: a price of 0 makes it infinite, two make it NaN."""
    ratio = F.when(col(b) == 0, col(a) * F.lit(math.inf)).otherwise(F.try_divide(col(a), col(b)))
    return F.when(ratio == 0, F.lit(-math.inf)).otherwise(F.ln(ratio))


def _logs(bars: DataFrame, guard: bool = True) -> DataFrame:
    """Log returns of a bar. Guarded they are 0 where a price is not positive, as no return is known there; else infinite or NaN."""
    before = F.lag("close").over(series())
    if not guard:
        ln = _log_ratio
        first = lambda c: F.coalesce(c, F.lit(0.0))
        return bars.select(
            "*",
            F.row_number().over(series()).alias("i"),
            ln("close", "open").alias("oc"),
            first(ln("open", before)).alias("co"),
            first(ln("close", before)).alias("r"),
            (ln("high", "close") * ln("high", "open") + ln("low", "close") * ln("low", "open")).alias("rs"),
            F.pow(ln("high", "low"), 2).alias("pk"),
        )
    ok = F.least("open", "high", "low", "close") > 0
    good = F.coalesce(ok, F.lit(False))
    ln = lambda a, b: F.ln(col(a) / col(b))
    zero = F.lit(0.0)
    return bars.select(
        "*",
        F.row_number().over(series()).alias("i"),
        F.when(good, ln("close", "open")).otherwise(zero).alias("oc"),
        F.when(good & (before > 0), F.ln(F.col("open") / before)).otherwise(zero).alias("co"),
        F.when(good & (before > 0), F.ln(F.col("close") / before)).otherwise(zero).alias("r"),
        F.when(good, ln("high", "close") * ln("high", "open") + ln("low", "close") * ln("low", "open")).otherwise(zero).alias("rs"),
        F.when(good, F.pow(ln("high", "low"), 2)).otherwise(zero).alias("pk"),
    )


def _yang_zhang(n: int, annual: int) -> Column:
    k = 0.34 / (1.34 + (n + 1) / (n - 1))
    var = F.var_pop("co").over(w(n - 1)) + k * F.avg("rs").over(w(n)) + (1 - k) * F.var_pop("oc").over(w(n))
    return F.when(var > 0, F.sqrt(F.lit(float(annual)) * var)).otherwise(0.0)


def volatility_surface(bars: DataFrame, annual: int = 252, n: int = 21, z: int = 63, short: int = 5, guard: bool = True) -> DataFrame:
    """The 14 volatility columns of RV_KEYS. Bars before the first valid one take its values, as the surface is defined.

    Without ``guard`` prices of 0 count as they are: their windows become infinite.
    """
    x = _logs(bars, guard)
    x = x.withColumn("pair", F.abs("r") * F.abs(F.lag("r").over(series()))).withColumn("r2", F.col("r") * F.col("r"))
    ready = F.col("i") >= n
    var = F.var_pop("r").over(w(n))
    up, down = (F.coalesce(F.avg(F.when(c, F.col("r2"))).over(w(n)), F.lit(0.0)) for c in (F.col("r") > 0, F.col("r") < 0))
    m2, m3 = F.avg("r2").over(w(n)), F.avg(F.col("r2") * F.col("r")).over(w(n))
    x = x.select(
        "*",
        F.when(ready, _yang_zhang(n, annual)).otherwise(0.0).alias("yz"),
        F.when(ready, F.sqrt(F.avg("pk").over(w(n)) / (4 * math.log(2)) * annual)).otherwise(0.0).alias("pkv"),
        F.when(ready, var).alias("var"), F.avg("pair").over(w(n - 1)).alias("bpv"), up.alias("up"), down.alias("down"), m2.alias("m2"), m3.alias("m3"),
    )
    scale = F.pow("m2", F.lit(1.5))
    raw = {
        "yz": F.col("yz"),
        "pkv": F.col("pkv"),
        "jump_ratio": F.when(ready & (F.col("var") > EPS), clip((F.col("var") - math.pi / 2 * F.col("bpv")) / F.col("var"), 0, 1)).otherwise(0.0),
        "rv_asym": F.when(ready & (F.col("up") > EPS), clip(F.col("down") / F.col("up"), 0.1, 10)).otherwise(1.0),
        "rv_skew": F.when(ready & (scale > EPS), clip(F.col("m3") / scale, -5, 5)).otherwise(0.0),
        "rs_plus": F.when(ready, F.log1p(F.sqrt(annual * F.col("up")))).otherwise(0.0),
        "rs_minus": F.when(ready, F.log1p(F.sqrt(annual * F.col("down")))).otherwise(0.0),
        "rs_leverage": F.when(ready & (F.col("up") + F.col("down") > EPS), (F.col("down") - F.col("up")) / (F.col("up") + F.col("down"))).otherwise(0.0),
    }
    x = x.withColumns(raw)
    seen = F.min(F.when(F.col("yz") > 0, F.col("i"))).over(whole())
    x = x.withColumn("seen", seen)
    fill = {c: F.when(F.col("i") < F.col("seen"), F.first(F.when(F.col("i") == F.col("seen"), F.col(c)), True).over(whole())).otherwise(F.col(c)) for c in raw}
    x = x.withColumns(fill)
    before = F.lag("yz").over(series())
    mean, sd = F.avg("yz").over(w(z)), F.stddev_pop("yz").over(w(z))
    mean_n, sd_n = F.avg("yz").over(w(n)), F.stddev_pop("yz").over(w(n))
    x = x.withColumns(
        {
            "yz_log": F.log1p("yz"),
            "pk_log": F.log1p("pkv"),
            "range_eff": F.when(F.col("yz") > EPS, clip(F.col("pkv") / F.col("yz"), 0.2, 5)).otherwise(1.0),
            "yz_shock": F.when(before > EPS, clip(F.col("yz") / before - 1, -5, 5)).otherwise(0.0),
            "yz_z": F.when((F.col("i") >= z) & (sd > EPS), clip((F.col("yz") - mean) / sd, -8, 8)).otherwise(0.0),
            "yz_pctrank": F.when(F.col("i") >= z, share_le("yz", z)).otherwise(0.5),
            "yz_trend": F.when((F.col("i") >= n) & (mean_n > EPS), clip(F.avg("yz").over(w(short)) / mean_n - 1, -5, 5)).otherwise(0.0),
            "vov": F.when((F.col("i") >= n) & (mean_n > EPS), clip(sd_n / mean_n, 0, 5)).otherwise(0.0),
        }
    )
    return x.select(*bars.columns, *RV_KEYS)


def vault_volatility(bars: DataFrame, annual: int = 252, n: int = 21) -> DataFrame:
    """The stored Yang-Zhang volatility: it starts one bar later, clamps prices at 1e-9 and fills back, then 0."""
    safe = bars.withColumns({c: F.greatest(F.col(c), F.lit(EPS)) for c in ("open", "high", "low", "close")})
    x = _logs(safe).withColumn("v", F.when(F.col("i") > n, _yang_zhang(n, annual)))
    after = series().rowsBetween(0, Window.unboundedFollowing)
    return x.select("symbol", "ts", F.coalesce(F.first("v", True).over(after), F.lit(0.0)).alias("realized_volatility"))


def har(surface: DataFrame) -> DataFrame:
    """Daily, weekly and monthly variance with two lags and the jump share of the day."""
    d = F.pow(F.greatest(F.exp("yz_log") - 1, F.lit(0.0)), 2) / 252.0
    x = surface.withColumn("har_d", d)
    lag = lambda k: F.coalesce(F.lag("har_d", k).over(series()), F.lit(0.0))
    return x.withColumns({"har_w": F.avg("har_d").over(w(5)), "har_m": F.avg("har_d").over(w(22)), "har_l1": lag(1), "har_l2": lag(2), "har_jump": F.col("har_d") * clip("jump_ratio", 0, 1)})


def volatility_targets(bars: DataFrame, horizon: int = 5, annual: int = 252, ln: Callable[[Column], Column] = F.ln) -> DataFrame:
    """Targets of the next day and of the next ``horizon`` days; null where the days aren't there or are invalid.

    ``ln`` is the logarithm: ``libm_ln`` where values are compared with sums of themselves to the last bit.
    """
    before = F.lag("close").over(series())
    ok = (F.least("open", "high", "low", "close") > 0) & (before > 0)
    lr = lambda a, b: ln(F.try_divide(col(a), col(b)))
    rs = lr("high", "close") * lr("high", "open") + lr("low", "close") * lr("low", "open")
    day = F.when(ok, F.pow(lr("open", before), 2) + 0.34 * rs + 0.66 * F.pow(lr("close", "open"), 2))
    x = bars.withColumn("day_var", day)
    nxt = lambda c: F.lead(c).over(series())
    log1p = F.log1p if ln is F.ln else (lambda v: ln(1 + v))
    vol = lambda v: log1p(F.sqrt(F.greatest(annual * v, F.lit(1e-6))))
    far = ahead(1, horizon)
    full = F.count("day_var").over(far) == horizon
    top, low = F.max("high").over(far), F.min("low").over(far)
    return x.select(
        "symbol", "ts",
        F.when(nxt("day_var").isNotNull(), vol(nxt("day_var"))).alias("vol_1d"),
        lr(nxt("high"), nxt("low")).alias("range_1d"), lr(nxt("high"), nxt("open")).alias("up_1d"), lr(nxt("open"), nxt("low")).alias("down_1d"),
        F.when(full, vol(F.avg("day_var").over(far))).alias(f"vol_{horizon}d"),
        F.when(full, lr(top, low)).alias(f"range_{horizon}d"), F.when(full, lr(top, nxt("open"))).alias(f"up_{horizon}d"), F.when(full, lr(nxt("open"), low)).alias(f"down_{horizon}d"),
    )


def companion(x: DataFrame, low: float = 15, mid: float = 25, high: float = 35, n: int = 63, rank: int = 252, short: int = 5, long: int = 21) -> DataFrame:
    """17 figures of a companion volatility index ``vix`` beside ``yz_log`` of the same rows."""
    v = F.coalesce("vix", F.lit(0.0))
    x = x.withColumn("vix", v).withColumn("lv", F.when(v > EPS, F.ln(v)).otherwise(0.0)).withColumn("spread", F.col("lv") - F.col("yz_log")).withColumn("i", F.row_number().over(series()))
    o = series()
    sd = lambda c, k: F.sqrt(F.greatest(F.avg(F.col(c) * F.col(c)).over(w(k)) - F.pow(F.avg(c).over(w(k)), 2), F.lit(EPS)))
    mean = lambda c, k: F.avg(c).over(w(k))
    on, at = F.col("vix") > EPS, lambda k: F.col("i") >= k
    ratio = lambda c, a, b, lim: F.when(at(b) & (F.abs(mean(c, b)) > EPS), clip(mean(c, a) / mean(c, b) - 1, -lim, lim)).otherwise(0.0)
    shock = F.when(on & (F.lag("vix").over(o) > EPS), F.col("vix") / F.lag("vix").over(o) - 1)
    x = x.withColumn("shock", shock).withColumn("dist", (F.col("lv") - mean("lv", rank)) / sd("lv", rank))
    change = lambda k, lim: F.when(at(k + 1) & (F.col("lv") != 0) & (F.lag("lv", k).over(o) != 0), clip(F.col("lv") - F.lag("lv", k).over(o), -lim, lim)).otherwise(0.0)
    rv = F.exp("yz_log")
    bottom, span = F.min("lv").over(w(rank)), F.max("lv").over(w(rank)) - F.min("lv").over(w(rank))
    return x.withColumns(
        {
            "vix_level": F.col("lv"),
            "vix_z": F.when(on & at(n), clip((F.col("lv") - mean("lv", n)) / sd("lv", n), -5, 5)).otherwise(0.0),
            "vix_pctrank": F.when(on & at(rank), share_le("lv", rank)).otherwise(0.5),
            "vix_regime": F.when(~on, 1.0).when(F.col("vix") < low, 0.0).when(F.col("vix") < mid, 1.0).when(F.col("vix") < high, 2.0).otherwise(3.0),
            "vix_trend": ratio("lv", short, long, 1),
            "vix_shock": F.coalesce(clip("shock", -2, 2), F.lit(0.0)),
            "vix_accel": F.coalesce(clip(F.col("shock") - F.coalesce(F.lag("shock").over(o), F.lit(0.0)), -2, 2), F.lit(0.0)),
            "vix_5d_change": change(5, 2),
            "vix_21d_change": change(21, 3),
            "vix_rv_spread": clip("spread", -3, 3),
            "vix_rv_ratio": F.when(on & (rv > EPS), clip(F.col("vix") / (rv * 100), 0, 10)).otherwise(1.0),
            "vix_rv_spread_z": F.when(at(n), clip((F.col("spread") - mean("spread", n)) / sd("spread", n), -5, 5)).otherwise(0.0),
            "vix_rv_spread_trend": ratio("spread", short, long, 2),
            "vix_distance_from_mean": F.when(at(rank), clip("dist", -5, 5)).otherwise(0.0),
            "vix_halflife_signal": F.when(at(rank), clip(-F.col("dist") * F.exp(-F.abs("dist") / 2), -3, 3)).otherwise(0.0),
            "vix_floor_distance": F.when(at(rank) & (span > EPS), clip((F.col("lv") - bottom) / span, 0, 1)).otherwise(0.5),
            "vix_contango_proxy": ratio("lv", short, n, 1),
        }
    )


VIX_KEYS = ("vix_level", "vix_z", "vix_pctrank", "vix_regime", "vix_trend", "vix_shock", "vix_accel", "vix_5d_change", "vix_21d_change", "vix_rv_spread", "vix_rv_ratio", "vix_rv_spread_z", "vix_rv_spread_trend", "vix_distance_from_mean", "vix_halflife_signal", "vix_floor_distance", "vix_contango_proxy")


def companion_suite(x: DataFrame, others: tuple[str, str] = ("vix9d", "vix3m")) -> DataFrame:
    """The companion figures of three indices (columns ``vix_index``, ``<other>_index``) and nine of their curve.

    An index is available to a series that has any value of it. Curve figures are 0
    where one of their indices isn't available.
    """
    short, back = others
    for p in (short, back, "vix"):
        x = companion(x.withColumn("vix", F.col(f"{p}_index"))).withColumnsRenamed({k: f"{p}_{k[4:]}" for k in VIX_KEYS})
        x = x.withColumn(f"{p}_available", F.coalesce(F.max((F.col(f"{p}_index") > EPS).cast("double")).over(whole()), F.lit(0.0)))
    on = {p: (F.col("vix_available") > 0) & (F.col(f"{p}_available") > 0) for p in others}
    near, far, span = F.col(f"{short}_level") - F.col("vix_level"), F.col("vix_level") - F.col(f"{back}_level"), F.col(f"{short}_level") - F.col(f"{back}_level")
    both = on[short] & on[back]
    masked = lambda value, mask: F.when(mask, value).otherwise(0.0)
    flag = lambda mask: mask.cast("double")
    return x.withColumns(
        {
            f"{short}_vix_spread": masked(near, on[short]),
            f"vix_{back}_spread": masked(far, on[back]),
            f"{short}_{back}_spread": masked(span, both),
            f"{short}_vix_ratio": masked(F.exp(clip(near, -5, 5)), on[short]),
            f"vix_{back}_ratio": masked(F.exp(clip(far, -5, 5)), on[back]),
            "vix_curve_short_inversion": flag(on[short] & (near > 0)),
            "vix_curve_back_inversion": flag(on[back] & (far > 0)),
            "vix_curve_full_inversion": flag(both & (near > 0) & (far > 0)),
            "vix_suite_available": flag(both),
        }
    )


CURVE_KEYS = ("vix9d_vix_spread", "vix_vix3m_spread", "vix9d_vix3m_spread", "vix9d_vix_ratio", "vix_vix3m_ratio", "vix_curve_short_inversion", "vix_curve_back_inversion", "vix_curve_full_inversion", "vix_suite_available")


def hurst(bars: DataFrame, n: int = 100) -> DataFrame:
    """Rescaled range of the n closes before a bar: ln(range of centred sums / deviation) / ln(n), 0.5 where undefined."""
    closes = F.collect_list("close").over(series().rowsBetween(-n, -1))

    def of(c: Column) -> Column:
        d = F.transform(F.slice(c, 2, n - 1), lambda x, i: x - F.get(c, i))
        return bound(d, lambda d: bound(F.aggregate(d, F.lit(0.0), lambda a, x: a + x) / (n - 1), lambda m: _range(d, m)))

    def _range(d: Column, m: Column) -> Column:
        zero = F.lit(0.0)
        start = F.struct(zero.alias("z"), zero.alias("lo"), zero.alias("hi"), zero.alias("ss"))

        def step(a: Column, x: Column) -> Column:
            z = a["z"] + (x - m)
            return F.struct(z.alias("z"), F.least(a["lo"], z).alias("lo"), F.greatest(a["hi"], z).alias("hi"), (a["ss"] + (x - m) * (x - m)).alias("ss"))

        def end(a: Column) -> Column:
            s, span = F.sqrt(a["ss"] / (n - 1)), a["hi"] - a["lo"]
            return F.when((s > 0) & (span > 0), clip(F.ln(span / s) / math.log(n), 0, 1))

        return F.aggregate(d, start, step, end)

    x = bars.withColumn("__c", closes)
    return x.withColumn("hurst", F.coalesce(F.when(F.size("__c") == n, of(F.col("__c"))), F.lit(0.5))).drop("__c")


def candle_delta(bars: DataFrame) -> DataFrame:
    """Signed share of volume by squared wicks and body; 0 on a series' first bar."""
    before = F.lag("close").over(series())
    top, bottom = F.greatest("open", "close"), F.least("open", "close")
    x = bars.withColumns({"tw": F.greatest(F.greatest(F.col("high"), before) - top, F.lit(0.0)), "bw": F.greatest(bottom - F.least(F.col("low"), before), F.lit(0.0)), "bd": F.abs(F.col("open") - F.col("close")), "prev": before})
    t2, b2, d2 = (F.pow(c, 2) for c in ("tw", "bw", "bd"))
    up = F.col("bw") + (F.col("close") - F.col("open")) - F.col("tw") >= 0
    total = t2 + b2 + d2
    v = F.coalesce("volume", F.lit(0.0))
    delta = F.when(F.col("prev").isNull() | (total < 1e-18), 0.0).when(up, v * (b2 + d2) / total).otherwise(-v * (t2 + d2) / total)
    return x.withColumn("delta", delta).drop("tw", "bw", "bd", "prev")


def _gains(q: float, r: float) -> list[float]:
    """The filter's gains from the second measurement on, which no measurement changes; the last one stays."""
    out, p = [], 1.0
    while len(out) < 2 or out[-1] != out[-2]:
        p += q
        out.append(p / (p + r))
        p *= 1 - out[-1]
        if len(out) > 5000:
            break
    return out


def kalman(bars: DataFrame, q: float = 1e-3, r: float = 1.0, unit: str = "year") -> DataFrame:
    """Adds kalman (state of the scalar filter on (o h l c)^(1/4)) and regime (close - kalman).

    The state starts at the first measurement. The gains don't depend on the measurements, so the
    state is an affine recurrence, which is scanned by slices of ``unit``. A measurement that isn't
    finite repeats the state. The bars are stored first, as the scan reads them more than once.
    """
    gains = _gains(q, r)
    m = clean(F.pow(F.col("open") * F.col("high") * F.col("low") * F.col("close"), F.lit(0.25)))
    x = scan.numbered(sinks.stored(bars.withColumn("__m", m), "bars"), unit)
    gain = F.element_at(F.lit(gains), F.least(F.greatest("i", F.lit(1)), F.lit(len(gains))).cast("int"))
    moved = (F.col("i") > 0) & F.col("__m").isNotNull()
    first = x.where("i = 0").select("symbol", F.col("__m").alias("x"))
    x = x.withColumn("__k", F.when(moved, gain).otherwise(0.0))
    got = scan.affine(x, 1 - F.col("__k"), F.col("__k") * F.coalesce("__m", F.lit(0.0)), first, "kalman")
    return got.select(*bars.columns, "kalman").withColumn("regime", F.col("close") - F.col("kalman"))


def with_crossings(bars: DataFrame) -> DataFrame:
    """Bars with kalman, marked where they confirm a swing high (up) or low (down), with its price; a series' first bar confirms none."""
    o = series()
    k, root = F.col("kalman"), F.sqrt(F.col("open") * F.col("close"))
    up = ((F.col("close") < k) & (F.col("open") > k)) | ((root > k) & (F.col("low") <= k))
    down = ((F.col("close") > k) & (F.col("open") < k)) | ((root < k) & (F.col("high") >= k))
    later, no = F.row_number().over(o) >= 2, F.lit(False)
    return bars.withColumns({"up": later & F.coalesce(up, no), "down": later & F.coalesce(down, no), "high_price": F.greatest("high", F.lag("high").over(o)), "low_price": F.least("low", F.lag("low").over(o))})


def swings(bars: DataFrame) -> DataFrame:
    """Swing events of bars with kalman and number i: high (1) and low (-1), price, bar of the price and bar of the event."""
    event = lambda on, kind, price, own: F.when(F.col(on), F.struct(F.lit(kind).alias("kind"), F.col(price).alias("price"), F.when(F.col(own) == F.col(price), F.col("i")).otherwise(F.col("i") - 1).alias("bar")))
    x = with_crossings(bars).withColumn("__e", F.array_compact(F.array(event("up", 1, "high_price", "high"), event("down", -1, "low_price", "low"))))
    return x.select("symbol", "ts", F.col("i").alias("confirm"), F.posexplode("__e").alias("seq", "e")).select("symbol", "ts", "confirm", "seq", "e.*")


def regime_streaks(bars: DataFrame, regime: str = "regime", atr: str = "atr14") -> DataFrame:
    """Streak, acceleration, displacement and drawdown since the last sign change of the regime."""
    o = series()
    sign = F.col(regime) >= 0
    flip = F.coalesce((sign != F.lag(sign).over(o)).cast("int"), F.lit(0))
    scale = F.when(F.col(atr) > EPS, F.col(atr)).otherwise(1.0)
    x = bars.withColumn("i", F.row_number().over(o)).withColumn("flip", flip).withColumn("move", F.coalesce((F.col("close") - F.lag("close").over(o)) / scale, F.lit(0.0)))
    x = x.withColumn("island", F.sum("flip").over(upto()))
    inside = Window.partitionBy("symbol", "island").orderBy("ts").rowsBetween(Window.unboundedPreceding, 0)
    first = F.col("island") == 0
    streak = F.count(F.lit(1)).over(inside) - F.when(first, 1).otherwise(0)
    return x.withColumns(
        {
            "regime_streak": streak.cast("double"),
            "regime_accel": (F.avg(regime).over(w(5)) - F.avg(regime).over(w(20))) / scale,
            "cum_disp_since_flip": F.sum("move").over(inside),
            "max_dd_since_flip": F.when(F.col("i") == 1, 0.0).otherwise((F.max("close").over(inside) - F.col("close")) / scale),
        }
    )


def intraday_summary(bars: DataFrame, session_minutes: float = 390, guard: bool = True) -> DataFrame:
    """Figures of each UTC day of hourly bars: variance, semivariances, asymmetry, jump, half imbalance, trend efficiency.

    Bars with a price that is not positive are left out; without ``guard`` they count, and make their day infinite or NaN.
    """
    day = Window.partitionBy("symbol", "day").orderBy("ts")
    ln = (lambda a, b: F.ln(col(a) / col(b))) if guard else _log_ratio
    x = (bars.where(F.least("open", "high", "low", "close") > 0) if guard else bars).withColumn("day", F.floor(F.unix_timestamp("ts") / 86400).cast("long"))
    before = F.lag("close").over(day)
    x = x.withColumn("r", ln("close", F.coalesce(before, F.col("open")))).withColumn("pair", F.abs("r") * F.abs(F.lag("r").over(day)))
    x = x.withColumn("half", F.unix_timestamp("ts") < F.first(F.unix_timestamp("ts")).over(day) + session_minutes * 30)
    r2 = F.col("r") * F.col("r")
    eps = 1e-12
    g = x.groupBy("symbol", "day").agg(
        F.count(F.lit(1)).alias("n"), F.sum(r2).alias("rv"), (F.sum(F.pow(ln("high", "low"), 2)) / (4 * math.log(2))).alias("rr"),
        F.sum(F.when(F.col("r") > 0, r2).otherwise(0.0)).alias("up_sv"), F.sum(F.when(F.col("r") < 0, r2).otherwise(0.0)).alias("dn_sv"), F.coalesce(F.avg("pair"), F.lit(0.0)).alias("pair"),
        F.stddev_pop(r2).alias("vov"), F.sum(F.when(F.col("half"), r2).otherwise(0.0)).alias("first"), F.abs(F.sum("r")).alias("net"), F.sum(F.abs("r")).alias("path"),
    )
    bpv = math.pi / 2 * F.col("pair") * F.col("n")
    return g.select(
        "symbol", "day", F.col("rv").alias("intra_rv"), "rr", "up_sv", "dn_sv", F.when(F.col("rv") > eps, (F.col("dn_sv") - F.col("up_sv")) / F.col("rv")).otherwise(0.0).alias("asym"),
        F.when(F.col("rv") > eps, clip((F.col("rv") - bpv) / F.col("rv"), 0, 1)).otherwise(0.0).alias("jump"), "vov",
        F.when(F.col("rv") > eps, (2 * F.col("first") - F.col("rv")) / F.col("rv")).otherwise(0.0).alias("half_imb"), F.when(F.col("path") > eps, F.col("net") / F.col("path")).otherwise(0.0).alias("trend_eff"),
    )


def wilder(bars: DataFrame, n: int = 14, unit: str = "year") -> DataFrame:
    """Wilder's ATR: the mean of true ranges 2 .. n + 1, then a running mean; earlier bars take the first value, short series 1.

    a = ((n - 1) a + tr) / n is an affine recurrence, scanned by slices of ``unit``.
    """
    from chronolith.operators.core import true_range

    x = scan.numbered(sinks.stored(true_range(bars), "bars"), unit)
    head = x.where(F.col("i") <= n).groupBy("symbol").agg(F.count(F.lit(1)).alias("rows"), F.avg(F.when(F.col("i") > 0, F.col("tr"))).alias("mean"))
    first = head.select("symbol", F.when(F.col("rows") > n, F.col("mean")).otherwise(1.0).alias("x"))
    late = F.col("i") > n
    got = scan.affine(x, F.when(late, (n - 1) / n).otherwise(1.0), F.when(late, F.col("tr") / n).otherwise(0.0), first, "atr_wilder")
    return got.select(*bars.columns, "atr_wilder")


def swing_delta(bars: DataFrame) -> DataFrame:
    """Running sum of candle deltas, starting anew at each bar that confirms a swing."""
    x = with_crossings(candle_delta(kalman(bars)))
    x = x.withColumn("seg", F.sum((F.col("up") | F.col("down")).cast("int")).over(upto())).drop("up", "down", "high_price", "low_price")
    inside = Window.partitionBy("symbol", "seg").orderBy("ts").rowsBetween(Window.unboundedPreceding, 0)
    return x.withColumn("swing_delta", F.sum("delta").over(inside))


def volatility_lane(bars: DataFrame, base: str, above: tuple[str, ...]) -> DataFrame:
    """The surface of a lane: own columns, then each higher timeframe's columns as of its last close, with its term spread."""
    from chronolith.operators.core import as_of, close_time, resample

    out = volatility_surface(bars, annual=ANNUAL[base]).select("symbol", "ts", *[F.col(c).alias(f"rv_{base.lower()}_{c}") for c in RV_KEYS])
    for tf in above:
        t = tf.lower()
        htf = volatility_surface(close_time(resample(bars, tf), tf), annual=ANNUAL[tf]).withColumn("n", F.count(F.lit(1)).over(whole())).where("n >= 3")
        htf = htf.select("symbol", "close_ts", *[F.col(c).alias(f"rv_{t}_{c}") for c in RV_KEYS])
        out = as_of(out, htf, prefix="").drop("close_ts").fillna(0.0, [f"rv_{t}_{c}" for c in RV_KEYS])
        out = out.withColumn(f"rv_term_{t}_{base.lower()}", clip(F.col(f"rv_{t}_yz_log") - F.col(f"rv_{base.lower()}_yz_log"), -8, 8))
    return out
