"""Window geometry: each window's bars in its own box, with their lags, autocorrelations and skeleton.

A window's bars come from one ordered frame as an array; everything else is array
functions on it, so all windows of a timeframe share one shuffle and one sort. A
window's figures travel as one array of doubles, a block, whose names follow from
its size; a lane of 1,441 columns is 15 blocks until one last projection spreads them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronolith.functions.exprs import EPS, bound, clip, settled, w

LAGS = (1, 2, 3, 5, 8)
PROMINENCE = 0.05
#: What is told of a window's turns, in order.
SKELETON = ("smc_phase", "liquidity_grab", "ob_validity", "last_swing_high", "last_swing_low")
WINDOWS_1H = {"1h": (3, 5, 8, 13, 21), "1d": (3, 5, 8, 13, 21), "1w": (3, 5, 8), "1m": (3, 5)}
WINDOWS_1D = {"1d": (3, 5, 8, 13, 21), "1w": (3, 5, 8), "1m": (3, 5), "3m": (3, 5)}
#: Columns that are zero outside of the primary timeframe's session position.
THERMO = ("basis_pct", "basis_z", "basis_v5", "basis_v10", "session_pos", "eod_momentum")


def _sum(a: Column, f) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + f(x))


def box(bars: DataFrame, n: int) -> DataFrame:
    """Adds the window's arrays nc, nb, vf, sp and the scalar vb, named with n; null until n bars are there."""
    session = F.col("session_pos") if "session_pos" in bars.columns else F.lit(0.0)
    x = bars.withColumn("a", F.collect_list(F.struct("open", "high", "low", "close", F.coalesce("volume", F.lit(0.0)).alias("volume"), F.coalesce(session, F.lit(0.0)).alias("session"))).over(w(n)))
    x = x.withColumn("a", F.when(F.size("a") == n, F.col("a"))).withColumns({"hi": F.array_max("a.high"), "lo": F.array_min("a.low")})
    mid = F.sort_array("a.close")
    median = (F.get(mid, F.lit((n - 1) // 2)) + F.get(mid, F.lit(n // 2))) / 2
    x = x.withColumn("rng", F.when(F.col("hi") - F.col("lo") < EPS, F.greatest(median * 1e-5, F.lit(EPS))).otherwise(F.col("hi") - F.col("lo"))).withColumn("tv", _sum(F.col("a.volume"), lambda v: v))
    norm = lambda p: clip((p - F.col("lo")) / (F.col("rng") + EPS), 0, 1)
    move = F.transform("a", lambda b, i: F.struct(b["volume"].alias("v"), (2 * b["close"] - F.coalesce(F.get(F.col("a.close"), i - 1), b["close"]) - b["open"]).alias("m")))
    side = bound(move, lambda m: _sum(m, lambda b: F.when(b["m"] > 0, b["v"]).when(b["m"] < 0, -b["v"]).otherwise(0.0)))
    x = x.withColumns(
        {
            f"nc{n}": F.transform("a.close", norm),
            f"nb{n}": F.transform("a.close", lambda c: clip((((c - F.col("lo")) - (F.col("hi") - c)) / (F.col("rng") + EPS) + 1) / 2, 0, 1)),
            f"vf{n}": F.transform("a.volume", lambda v: F.when(F.col("tv") > EPS, clip(v / F.col("tv"), 0, 1)).otherwise(1.0 / n)),
            f"vb{n}": clip(side / (F.col("tv") + EPS), -1, 1),
            f"sp{n}": F.col("a.session"),
        }
    )
    return x.drop("a", "hi", "lo", "rng", "tv")


def _pearson(a: Column, b: Column, n: int) -> Column:
    """Correlation of two arrays of n values, 0 where one is constant."""

    def inner(ma: Column, mb: Column) -> Column:
        z = F.zip_with(a, b, lambda x, y: F.struct((x - ma).alias("x"), (y - mb).alias("y")))
        return bound(z, lambda z: bound(_sum(z, lambda p: p["x"] * p["x"]) * _sum(z, lambda p: p["y"] * p["y"]), lambda d: F.when(d > 1e-18, _sum(z, lambda p: p["x"] * p["y"]) / F.sqrt(d)).otherwise(0.0)))

    return bound(_sum(a, lambda v: v) / n, lambda ma: bound(_sum(b, lambda v: v) / n, lambda mb: inner(ma, mb)))


def spectral(n: int, prefix: str) -> dict[str, Column]:
    """Correlation of the boxed closes with themselves some bars before, from windows of ten bars."""
    if n < 10:
        return {}
    return {f"{prefix}_fft_nc_ac{k}": F.when(F.col(f"nc{n}").isNotNull(), F.coalesce(_pearson(F.slice(f"nc{n}", k + 1, n - k), F.slice(f"nc{n}", 1, n - k), n - k), F.lit(0.0))) for k in LAGS}


def turns(x: DataFrame, n: int) -> DataFrame:
    """Adds the places of the window's peaks and troughs (pk, tr with n)."""
    inner = F.sequence(F.lit(1), F.lit(n - 2))
    v = lambda i: F.get(F.col(f"nc{n}"), i)
    peak = lambda i: (v(i) > v(i - 1)) & (v(i) > v(i + 1)) & (v(i) - F.greatest(v(i - 1), v(i + 1)) >= PROMINENCE)
    trough = lambda i: (v(i) < v(i - 1)) & (v(i) < v(i + 1)) & (F.least(v(i - 1), v(i + 1)) - v(i) >= PROMINENCE)
    return x.withColumns({f"pk{n}": F.filter(inner, peak), f"tr{n}": F.filter(inner, trough)})


def skeleton(n: int, prefix: str) -> dict[str, Column]:
    """The skeleton's columns of a window of five bars or more, after ``turns``."""
    v = lambda i: F.get(F.col(f"nc{n}"), i)
    pk, tr = F.col(f"pk{n}"), F.col(f"tr{n}")
    peaks, troughs = F.size(pk), F.size(tr)
    last, bias = v(F.lit(n - 1)), F.get(F.col(f"nb{n}"), F.lit(n - 1))
    high, low = F.when(peaks > 0, v(F.get(pk, peaks - 1))).otherwise(1.0), F.when(troughs > 0, v(F.get(tr, troughs - 1))).otherwise(0.0)
    rise, fall = high - v(F.get(pk, F.lit(0))), low - v(F.get(tr, F.lit(0)))
    phase = F.when(last > high, F.when((peaks >= 2) & (rise < 0), 2.0).otherwise(1.0)).when(last < low, F.when((troughs >= 2) & (fall > 0), -2.0).otherwise(-1.0)).otherwise(0.0)
    volume = F.when(peaks > 0, F.get(F.col(f"vf{n}"), F.get(pk, peaks - 1))).otherwise(0.0)
    grab = F.when((last < low) & (bias > 0.7), 1.0).otherwise(0.0)
    return {f"{prefix}_skel_{k}": c for k, c in zip(SKELETON, (phase, grab, volume * F.abs(phase), high, low))}


def block_names(tf: str, n: int) -> list[str]:
    """Names of a block's figures in their order: n bars x 9, n lags x 2, autocorrelations from 10 bars, skeleton from five."""
    p = f"{tf}_w{n}"
    bars = [f"{p}_bar{k}_{c}" for k in range(1, n + 1) for c in ("close", "norm_bias", "volume_bias", *THERMO)]
    lags = [f"{p}_gram_{c}_lag{k}" for k in range(n) for c in ("nb", "vb")]
    back = [f"{p}_fft_nc_ac{k}" for k in LAGS] if n >= 10 else []
    return bars + lags + back + ([f"{p}_skel_{c}" for c in SKELETON] if n >= 5 else [])


def blocks(bars: DataFrame, tf: str, *sizes: int, primary: bool = False) -> DataFrame:
    """Adds a block {tf}_w{n} of each window, null until n bars are there."""
    x = bars
    for n in sizes:
        x = box(x, n)
        x = turns(x, n) if n >= 5 else x
    out = {}
    for n in sizes:
        bias, vb, zero = F.col(f"nb{n}"), F.col(f"vb{n}"), F.lit(0.0)
        thermo = lambda i, n=n: [F.get(F.col(f"sp{n}"), i) if primary and t == "session_pos" else F.lit(0.0) for t in THERMO]
        per_bar = F.flatten(F.transform(f"nc{n}", lambda c, i: F.array(c, F.get(bias, i), vb, *thermo(i))))
        lags = F.flatten(F.transform(F.reverse(bias), lambda b: F.array(b, vb)))
        rest = [F.coalesce(c, zero) for c in (spectral(n, "") | (skeleton(n, "") if n >= 5 else {})).values()]
        out[f"{tf}_w{n}"] = F.when(F.col(f"nc{n}").isNotNull(), F.concat(per_bar, lags, *([F.array(*rest)] if rest else [])))
    # Figures are read from a block by place, which the optimizer would answer by making the block once per figure.
    return settled(x.select(*bars.columns, *[c.alias(name) for name, c in out.items()]))


def figure(name: str) -> Column:
    """A block's figure by its name; null while the window isn't filled."""
    tf, size = name.split("_")[:2]
    return F.get(F.col(f"{tf}_{size}"), F.lit(block_names(tf, int(size[1:])).index(name)))


def spread(x: DataFrame, windows: dict[str, tuple[int, ...]], *keep: str) -> DataFrame:
    """``keep`` and all figures of the windows' blocks, one column each."""
    names = {f"{tf}_w{n}": block_names(tf, n) for tf, sizes in windows.items() for n in sizes}
    return x.selectExpr(*[f"`{c}`" for c in keep], *[f"get(`{b}`, {i}) AS `{c}`" for b, of in names.items() for i, c in enumerate(of)])


def window_columns(bars: DataFrame, tf: str, *sizes: int, primary: bool = False) -> DataFrame:
    """The bars with all columns of some windows."""
    return spread(blocks(bars, tf, *sizes, primary=primary), {tf: sizes}, *bars.columns)


#: Windows whose phases have to agree, from the lane's own timeframe up (fixed values).
AGREE = {"1h": ("1h_w13", "1d_w13", "1w_w8"), "1d": ("1d_w13", "1w_w8", "1m_w5")}


def confluence(base: str) -> dict[str, Column]:
    """1 or -1 where all phases of a lane point one way, and the last close's place in the next timeframe's swing."""
    phases = [figure(f"{at}_skel_smc_phase") for at in AGREE[base]]
    every = lambda test: F.coalesce(F.forall(F.array(*phases), test), F.lit(False))
    close, above = f"{base}_w13_bar13_close", AGREE[base][1]
    high, low = F.coalesce(figure(f"{above}_skel_last_swing_high"), F.lit(1.0)), F.coalesce(figure(f"{above}_skel_last_swing_low"), F.lit(0.0))
    return {
        "mtf_conf_smc_sync": F.when(every(lambda p: p > 0), 1.0).when(every(lambda p: p < 0), -1.0).otherwise(0.0),
        "mtf_conf_pd_zone": (F.coalesce(figure(close), F.lit(0.0)) - low) / (high - low + EPS),
    }


def lane_blocks(frames: dict[str, DataFrame], windows: dict[str, tuple[int, ...]], base: str) -> DataFrame:
    """symbol, ts and the blocks of all timeframes on the base bars; a higher bar shows from its close.

    Frames carry close_ts but the base one. Higher blocks come by one as-of step each, the base's own
    are made last, on rows that stand in order already. A frame of under three bars fills no window.
    """
    from chronolith.operators.core import as_of

    x = frames[base]
    for tf in reversed([t for t in windows if t != base]):
        b = blocks(frames[tf], tf, *windows[tf])
        x = as_of(x, b.select("symbol", "close_ts", *[f"{tf}_w{n}" for n in windows[tf]]), prefix="").drop("close_ts")
    x = blocks(x, base, *windows[base], primary=True)
    return x.select("symbol", "ts", *[f"{tf}_w{n}" for tf, sizes in windows.items() for n in sizes])


def lane(frames: dict[str, DataFrame], windows: dict[str, tuple[int, ...]], base: str, digits: int | None = None) -> DataFrame:
    """symbol, ts and all columns of a lane: 1,441 with its confluence on hourly bars, 954 on daily ones; rounded if asked."""
    x = lane_blocks(frames, windows, base).withColumns(confluence(base))
    held = [c for c in x.columns if c not in ("symbol", "ts")]
    if digits is not None:
        near = lambda v: F.round(v, digits) + F.lit(0.0)
        x = settled(x.select("symbol", "ts", *[(near(F.col(c)) if c.startswith("mtf_") else F.transform(c, near)).alias(c) for c in held]))
    return spread(x, windows, "symbol", "ts", *[c for c in held if c.startswith("mtf_")])
