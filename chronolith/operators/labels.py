"""Labels by bounded forward simulation of long and short trades.

A bar's next ``horizon`` bars come from one ordered frame as an array; simulation is
vectorised over all rows of a batch, a step per bar of the horizon, so no row waits for another.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronolith.functions.exprs import EPS, ahead

#: stop, first and second target and trailing distance in ATR by template (fixed values).
TEMPLATES = {
    "compact": (1.0, 1.5, 3.0, 1.0),
    "balanced": (1.25, 2.0, 3.5, 1.25),
    "trend": (1.5, 2.0, 4.0, 1.5),
    "wide_runner": (1.5, 2.5, 4.5, 1.25),
    "defensive": (2.0, 2.5, 5.0, 1.5),
}
FRACTIONS = (0.5, 0.25, 0.25)
#: Stop in ATR, horizon in bars and purge in bars of each lane (fixed values).
LANES = {"1H": (1.25, 24, 24), "1D": (1.25, 10, 5)}


def simulate(bars: np.ndarray, size: np.ndarray, entry: np.ndarray, long: bool, stop0: np.ndarray, d1: np.ndarray, d2: np.ndarray, trail: np.ndarray, fee: float) -> dict[str, np.ndarray]:
    """Trades entered at ``entry`` on the first of each row's ``size`` bars (rows, horizon, OHLC). Adverse wins a bar that touches both sides."""
    n, horizon = bars.shape[:2]
    sign = 1.0 if long else -1.0
    risk = stop0 + EPS
    stop, t1, t2 = entry - sign * stop0, entry + sign * d1, entry + sign * d2
    left = np.tile(np.array(FRACTIONS), (n, 1))
    r, reason, exit_at, live = -entry * fee / risk, np.full(n, 2), size.copy(), size > 0
    hit1, hit2 = np.zeros(n, bool), np.zeros(n, bool)
    bad = ~np.isfinite(entry) | ~np.isfinite(stop0) | (stop0 <= 0) | (size == 0)
    reason[bad], live = 1, live & ~bad
    good = lambda price, level: sign * (price - level) >= 0
    lift = lambda mask, level: np.where(mask, np.where(sign * (level - stop) > 0, level, stop), stop)

    def fill(mask: np.ndarray, price: np.ndarray, parts: tuple[int, ...]) -> None:
        share = np.where(mask, left[:, list(parts)].sum(axis=1), 0.0)
        r[:] += np.where(share > 0, (sign * (price - entry) - price * fee) / risk * share, 0.0)
        for p in parts:
            left[mask, p] = 0

    def end(mask: np.ndarray, why: int, j: int) -> None:
        nonlocal live
        reason[mask], exit_at[mask] = why, j + 1
        live = live & ~mask

    for j in range(horizon):
        on = live & (j < size)
        if not on.any():
            break
        o, h, lo, c = bars[:, j, 0], bars[:, j, 1], bars[:, j, 2], bars[:, j, 3]
        broken = on & ~np.isfinite(bars[:, j]).all(axis=1)
        fill(broken & np.isfinite(c), c, (0, 1, 2))
        end(broken, 3, j)
        on = live & (j < size)
        gap = on & good(stop, o)
        fill(gap, o, (0, 1, 2))
        end(gap, 4, j)
        on = live & (j < size)
        m = on & (left[:, 0] > 0) & good(o, t1)
        fill(m, t1, (0,))
        hit1 |= m
        stop = lift(m, entry)
        m = on & (left[:, 1] > 0) & good(o, t2)
        fill(m, t2, (1,))
        hit2 |= m
        stop = lift(m, t1)
        end(on & (left.sum(axis=1) <= 0), 5, j)
        on = live & (j < size)
        best, worst = (h, lo) if long else (lo, h)
        for_it = ((left[:, 0] > 0) & good(best, t1)) | ((left[:, 1] > 0) & good(best, t2))
        against = on & good(stop, worst)
        fill(against, stop, (0, 1, 2))
        end(against & for_it, 6, j)
        end(against & ~for_it, 7, j)
        for part, target, base, done, stopped in ((0, t1, entry, 8, 9), (1, t2, t1, 10, 11)):
            on = live & (j < size)
            m = on & (left[:, part] > 0) & good(best, target)
            fill(m, target, (part,))
            if part == 0:
                hit1 |= m
            else:
                hit2 |= m
            stop = lift(m, base)
            end(m & (left.sum(axis=1) <= 0), done, j)
            back = m & live & good(stop, worst)
            fill(back, stop, (0, 1, 2))
            end(back, stopped, j)
        on = live & (j < size) & (left[:, 2] > 0) & (trail > 0)
        stop = lift(on, c - sign * trail)
        stop = lift(on & hit1, np.where(hit2, t1, entry))
    last = bars[np.arange(n), np.maximum(size - 1, 0), 3]
    fill(live, last, (0, 1, 2))
    r[bad] = np.nan
    return {"r": r, "bars": exit_at, "reason": reason, "hit1": hit1, "hit2": hit2}


def forward(bars: DataFrame, horizon: int) -> DataFrame:
    """Adds ``path``, the next ``horizon`` bars in order."""
    return bars.withColumn("path", F.collect_list(F.struct("open", "high", "low", "close")).over(ahead(1, horizon)))


def _paths(column: pd.Series, horizon: int) -> tuple[np.ndarray, np.ndarray]:
    size = column.map(len).to_numpy()
    out = np.full((len(column), horizon, 4), np.nan)
    for i, p in enumerate(column):
        for j, b in enumerate(p):
            out[i, j] = (b["open"], b["high"], b["low"], b["close"])
    return out, size


def labelled(bars: DataFrame, horizon: int = 10, stop_atr: float = 1.25, ladder: tuple[float, float, float] = (1.0, 2.0, 1.0), fee: float = 5e-4, slip: float = 3e-4) -> DataFrame:
    """Bars with atr14 -> both trades' R, excursions in ATR, kinetic target, bars to it and the signed return; null at the end of a series."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for g in batches:
            if not len(g):
                continue
            paths, size = _paths(g["path"], horizon)
            atr = g["atr14"].to_numpy(float)
            dist = atr * stop_atr
            open1 = paths[:, 0, 0]
            entry = {True: open1 * (1 + slip), False: open1 * (1 - slip)}
            trade = {s: simulate(paths, size, entry[s], s, dist, dist * ladder[0], dist * ladder[1], dist * ladder[2], fee) for s in (True, False)}
            price = entry[True]
            # In paths that end early, missing bars must not win: they repeat the entry.
            high, low = np.where(np.isnan(paths[:, :, 1]), price[:, None], paths[:, :, 1]), np.where(np.isnan(paths[:, :, 2]), price[:, None], paths[:, :, 2])
            kin = {}
            for s in (True, False):
                alive, up, down = np.ones(len(g), bool), price.copy(), price.copy()
                for j in range(horizon):
                    h, lo = high[:, j], low[:, j]
                    cut = price - 2 * atr if s else price + 2 * atr
                    over = alive & ((lo <= cut) if s else (h >= cut))
                    if s:
                        up = np.where(alive, np.maximum(up, h), up)
                        down = np.where(over, cut, np.where(alive, np.minimum(down, lo), down))
                    else:
                        down = np.where(alive, np.minimum(down, lo), down)
                        up = np.where(over, cut, np.where(alive, np.maximum(up, h), up))
                    alive &= ~over
                gain, loss = ((up - price), (price - down)) if s else ((price - down), (up - price))
                gain, loss = np.maximum(0, gain / (atr + EPS)), np.maximum(0, loss / (atr + EPS))
                kin[s] = gain / (gain + loss + EPS) * np.maximum(0.01, 1 - trade[s]["bars"] / horizon)
            up, down = np.maximum(price, high.max(axis=1)), np.minimum(price, low.min(axis=1))
            full = size == horizon
            win_l, win_s = (kin[True] > kin[False]) & (kin[True] > 0.15), (kin[False] > kin[True]) & (kin[False] > 0.15)
            lr, sr = trade[True]["r"], trade[False]["r"]
            out = pd.DataFrame(
                {
                    "symbol": g["symbol"], "ts": g["ts"],
                    "target": np.where(win_l, 0.5 + kin[True] / 2, np.where(win_s, 0.5 - kin[False] / 2, 0.5)),
                    "next_ret_pct": np.where(win_l, lr * dist / (price + EPS) * 100, np.where(win_s, -sr * dist / (price + EPS) * 100, 0.0)),
                    "bars_to_target": np.where(win_l, trade[True]["bars"], np.where(win_s, trade[False]["bars"], horizon)).astype(float),
                    "entry_price": price, "target_distance": dist, "long_path_r": lr, "short_path_r": sr, "target_edge_r": np.abs(lr - sr), "best_path_r": np.fmax(lr, sr),
                    "long_mfe_atr": np.maximum(0, (up - price) / (atr + EPS)), "long_mae_atr": np.maximum(0, (price - down) / (atr + EPS)), "short_mfe_atr": np.maximum(0, (price - down) / (atr + EPS)), "short_mae_atr": np.maximum(0, (up - price) / (atr + EPS)),
                    "long_reason": trade[True]["reason"], "short_reason": trade[False]["reason"], "long_bars": trade[True]["bars"], "short_bars": trade[False]["bars"],
                }
            )
            values = out.columns[2:]
            out[values] = out[values].astype(float).where(pd.Series(full, index=out.index), np.nan)
            yield out

    names = ("target", "next_ret_pct", "bars_to_target", "entry_price", "target_distance", "long_path_r", "short_path_r", "target_edge_r", "best_path_r", "long_mfe_atr", "long_mae_atr", "short_mfe_atr", "short_mae_atr", "long_reason", "short_reason", "long_bars", "short_bars")
    rows = forward(bars, horizon).select("symbol", "ts", "atr14", "path")
    got = rows.mapInPandas(run, "symbol string, ts timestamp, " + ", ".join(f"{c} double" for c in names))
    return got.select("symbol", "ts", *[F.when(~F.isnan(c), F.col(c)).alias(c) for c in names])


def exit_surface(bars: DataFrame, horizon: int = 10, fee: float = 5e-4, slip: float = 3e-4) -> DataFrame:
    """R of a long (UP) and of a short (DOWN) trade of every bar under every template; the catalogue is five rows."""
    spark = bars.sparkSession
    table = spark.createDataFrame([(k, *v) for k, v in TEMPLATES.items()], "template string, stop double, tp1 double, tp2 double, trail double")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for g in batches:
            if len(g):
                paths, size = _paths(g["path"], horizon)
                a = g["atr14"].to_numpy(float)
                for long in (True, False):
                    t = simulate(paths, size, paths[:, 0, 0] * (1 + slip if long else 1 - slip), long, a * g["stop"].to_numpy(), a * g["tp1"].to_numpy(), a * g["tp2"].to_numpy(), a * g["trail"].to_numpy(), fee)
                    out = g[["symbol", "ts", "template"]].copy()
                    out["direction"] = "UP" if long else "DOWN"
                    out["r"] = np.where(size == horizon, t["r"], np.nan)
                    yield out

    rows = forward(bars, horizon).select("symbol", "ts", "atr14", "path").join(F.broadcast(table))
    return rows.mapInPandas(run, "symbol string, ts timestamp, template string, direction string, r double").where("r is not null and not isnan(r)")


def surface_groups(surface: DataFrame, predictions: DataFrame, collect: float = 0.55) -> DataFrame:
    """Group (direction|bucket and direction|default), template, samples, avg_r, win_rate of the trades the predictions ask for.

    Candidates have confidence ``max(p, 1 - p)`` of at least ``collect``; buckets 0, 1, 2 part at the 50 and 80 % quantiles of their confidence.
    """
    sure = F.greatest("p", 1 - F.col("p"))
    asked = predictions.where("p between 0 and 1").select("symbol", "ts", F.when(F.col("p") > 0.5, "UP").otherwise("DOWN").alias("direction"), sure.alias("confidence")).where(F.col("confidence") >= collect)
    x = surface.join(asked, ["symbol", "ts", "direction"])
    edges = x.select("symbol", "ts", "confidence").distinct().agg(F.percentile("confidence", F.array(F.lit(0.5), F.lit(0.8))).alias("e"))
    x = x.crossJoin(F.broadcast(edges)).withColumn("bucket", F.size(F.filter(F.array_distinct("e"), lambda e: F.col("confidence") >= e)).cast("string"))
    g = x.groupingSets([["direction", "bucket", "template"], ["direction", "template"]], "direction", "bucket", "template").agg(F.count(F.lit(1)).alias("samples"), F.avg("r").alias("avg_r"), F.avg((F.col("r") > 0).cast("double")).alias("win_rate"))
    return g.select(F.concat_ws("|", "direction", F.coalesce("bucket", F.lit("default"))).alias("group"), "template", "samples", "avg_r", "win_rate")


def replay(labels: DataFrame, threshold: float = 0.7, start: float = 10_000.0, risk: float = 0.02) -> DataFrame:
    """Trades that don't overlap, long where p > 0.5 and else short: after a trade the next bar admitted beyond its exit is taken.

    A bar is admitted by its confidence ``max(p, 1 - p)``; one without the R of its direction is passed over. One pass over each series.
    """

    def run(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values("ts")
        free, equity, out = 0, start, []
        for i, d, r, n, ts in zip(g["i"], g["direction"], g["r"], g["bars"], g["ts"]):
            if i < free:
                continue
            equity += r * start * risk
            out.append((g["symbol"].iloc[0], ts, d, int(i), int(i + n), float(r), equity))
            free = i + n + 1
        return pd.DataFrame(out, columns=["symbol", "ts", "direction", "i", "exit_i", "r", "equity"])

    long = F.col("p") > 0.5
    side = lambda of: F.when(long, F.col(f"long_{of}")).otherwise(F.col(f"short_{of}") if f"short_{of}" in labels.columns else F.lit(None))
    rows = labels.where("p between 0 and 1").where(F.greatest("p", 1 - F.col("p")) >= threshold)
    rows = rows.select("symbol", "ts", "i", F.when(long, "LONG").otherwise("SHORT").alias("direction"), side("path_r").alias("r"), side("bars").alias("bars")).where("r is not null")
    return rows.groupBy("symbol").applyInPandas(run, "symbol string, ts timestamp, direction string, i long, exit_i long, r double, equity double")
