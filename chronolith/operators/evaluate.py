"""Evaluation: folds, losses, calibration, conformal widths, coverage, trade metrics, guardrails."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chronolith.functions.exprs import EPS, clip, col, div, series, w, whole
from chronolith.operators import ranks
from chronolith.sources import sinks

FOLD_SCHEMA = "fold int, train_end long, test_end long"
LEVELS = (0.8, 0.9, 0.95)
DECAY = 0.98


def folds(n: int, min_train: int, share: float = 0.15, least: int = 100, most: int = 10, shortest: int = 50) -> list[tuple[int, int, int]]:
    """Expanding folds over n rows: (fold, train end, test end), tests of max(share n, least) rows."""
    out, at, size = [], min_train, max(int(n * share), least)
    while at < n and len(out) < most:
        end = min(at + size, n)
        if end - at < shortest:
            break
        out.append((len(out), at, end))
        at = end
    return out


def assign_folds(numbered: DataFrame, plan: list[tuple[int, int, int]], purge: int) -> DataFrame:
    """Rows (0-based number i) with each fold they belong to, as train or test; rows in the purge gap are in neither."""
    table = F.broadcast(numbered.sparkSession.createDataFrame(plan, FOLD_SCHEMA))  # at most ten rows
    part = F.when(F.col("i") < F.col("train_end") - purge, "train").when((F.col("i") >= F.col("train_end")) & (F.col("i") < F.col("test_end")), "test")
    return numbered.join(table).withColumn("part", part).where("part is not null")


def in_folds(numbered: DataFrame, min_train: int, purge: int, share: float = 0.15, least: int = 100, most: int = 10, shortest: int = 50) -> DataFrame:
    """Rows (0-based number i) of every symbol with the expanding folds of its own length, as train or test."""
    size = numbered.groupBy("symbol").agg(F.count(F.lit(1)).alias("n")).withColumn("size", F.greatest(F.floor(F.col("n") * share), F.lit(least)))
    table = size.select("symbol", "n", "size", F.explode(F.sequence(F.lit(0), F.lit(most - 1))).alias("fold"))
    table = table.select("symbol", "fold", (F.col("fold") * F.col("size") + min_train).alias("train_end"), F.least((F.col("fold") + 1) * F.col("size") + min_train, F.col("n")).alias("test_end")).where(F.col("test_end") - F.col("train_end") >= shortest)
    part = F.when(F.col("i") < F.col("train_end") - purge, "train").when((F.col("i") >= F.col("train_end")) & (F.col("i") < F.col("test_end")), "test")
    return numbered.join(table, "symbol").withColumn("part", part).where("part is not null")


def inner_validation(n: int, gap: int, share: float = 0.15, least: int = 100) -> tuple[int, int]:
    """(end of inner train, start of validation) of n training rows; without the gap if it would leave nothing."""
    valid = max(int(n * share), least)
    train = n - valid - gap
    return (train if train > 0 else max(n - valid, 0)), max(n - valid, 0)


def errors(actual: str, pred: str, *by: str, har: str | None = None) -> list[Column]:
    ok = col(actual).isNotNull() & col(pred).isNotNull()
    e = F.when(ok, col(actual) - col(pred))
    out = [F.count(e).alias("n"), F.avg(F.abs(e)).alias("mae"), F.sqrt(F.avg(e * e)).alias("rmse"), F.avg(-e).alias("bias")]
    if har:
        mae_har = F.avg(F.abs(F.when(ok, col(actual) - col(har))))
        out.append((1 - div(F.avg(F.abs(e)), mae_har)).alias("edge"))
    return out


def qlike(actual: str, pred: str) -> Column:
    x = clip(col(actual) - col(pred), -10, 10)
    return F.avg(F.exp(x) - x - 1)


def vol_scores(df: DataFrame, *by: str, actual: str = "actual", pred: str = "ml", har: str = "har", level: float = 0.9) -> DataFrame:
    """Errors of a volatility forecast, its edge over the plain one, and its interval (``lo``, ``hi``), in one pass."""
    a, p, h, lo, hi = col(actual), col(pred), col(har), F.col("lo"), F.col("hi")
    e, eh = a - p, F.when(p.isNotNull(), a - h)
    loss = lambda x: F.avg(F.exp(clip(x, -10, 10)) - clip(x, -10, 10) - 1)
    mae, mae_h, alpha = F.avg(F.abs(e)), F.avg(F.abs(eh)), 1 - level
    edge = lambda x, y: F.when(y > 0, 1 - x / y)
    known = e.isNotNull() & lo.isNotNull() & hi.isNotNull()
    inside = F.avg(F.when(known, a.between(lo, hi).cast("double")))
    score = hi - lo + 2 / alpha * (F.greatest(lo - a, F.lit(0.0)) + F.greatest(a - hi, F.lit(0.0)))
    return df.groupBy(*by).agg(
        F.count(e).alias("n"), mae.alias("mae"), F.sqrt(F.avg(e * e)).alias("rmse"), F.avg(-e).alias("bias"),
        mae_h.alias("har_mae"), F.sqrt(F.avg(eh * eh)).alias("har_rmse"), edge(mae, mae_h).alias("edge"),
        loss(e).alias("qlike"), loss(eh).alias("har_qlike"), edge(loss(e), loss(eh)).alias("qlike_edge"),
        inside.alias("picp"), F.avg(F.when(known, hi - lo)).alias("mpiw"), F.avg(F.when(known, score)).alias("winkler"), F.abs(inside - level).alias("picp_error"),
    )


def horizon_payload(price: Column, logvol: Column, log_range: Column, up: Column, down: Column, up_width: Column, down_width: Column, suffix: str = "") -> dict[str, Column]:
    """Prices, percents and basis points that the forecasts of one horizon mean; peak and bottom at the upper interval ends."""
    parts = {
        "annualized_vol_pct": F.expm1(logvol) * 100, "range_pct": F.expm1(log_range) * 100, "up_bps": F.expm1(up) * 10000, "dn_bps": F.expm1(down) * 10000,
        "projected_high": price * F.exp(up), "projected_low": price / F.exp(down), "projected_peak": price * F.exp(up + up_width), "projected_bottom": price / F.exp(down + down_width),
    }
    return {f"{k}{suffix}": v for k, v in parts.items()}


def huber(actual: str, pred: str, delta: float = 1.0) -> Column:
    e = F.abs(col(actual) - col(pred))
    return F.avg(F.when(e <= delta, 0.5 * e * e).otherwise(delta * (e - 0.5 * delta)))


def bates_granger(df: DataFrame, actual: str = "actual", ml: str = "ml", har: str = "har") -> DataFrame:
    """Weights of two forecasts from one pass over their errors."""
    ok = col(actual).isNotNull() & col(ml).isNotNull() & col(har).isNotNull()
    a, b = F.when(ok, col(actual) - col(ml)), F.when(ok, col(actual) - col(har))
    g = df.groupBy("symbol").agg(F.count(a).alias("n"), F.avg(a * a).alias("v1"), F.avg(b * b).alias("v2"), F.avg(a * b).alias("c"))
    den = F.col("v1") + F.col("v2") - 2 * F.col("c")
    flat = F.when(F.col("v1") <= F.col("v2"), 1.0).otherwise(0.0)
    weight = F.when(F.col("n") < 25, 1.0).when(F.abs(den) < 1e-12, flat).otherwise(clip((F.col("v2") - F.col("c")) / den, 0, 1))
    return g.select("symbol", weight.alias("w_ml"), (1 - weight).alias("w_har"))


def forecast_confidence(hourly: Column, index: Column, vov: Column, forecast: Column, mean: Column, deviation: Column) -> dict[str, Column]:
    """Least of three factors: inputs at hand, steadiness of volatility, distance of the forecast from past ones."""
    z = F.abs(forecast - mean) / F.greatest(deviation, F.lit(1e-6))
    parts = {
        "availability": F.least(F.when(hourly, 1.0).otherwise(0.8), F.when(index, 1.0).otherwise(0.85)),
        "regime": clip(1 - F.greatest(vov - 1, F.lit(0.0)) / 3, 0.4, 1),
        "extremity": clip(1 - F.greatest(z - 1.5, F.lit(0.0)) / 3, 0.5, 1),
    }
    return parts | {"extremity_z": z, "confidence": F.least(*parts.values())}


def decay_weights(order: str = "ts", decay: float = DECAY) -> Column:
    """decay ^ (rows after this one)."""
    return F.pow(F.lit(decay), F.row_number().over(Window.partitionBy("symbol").orderBy(F.desc(order))) - 1)


def weighted_quantile(df: DataFrame, value: str, weight: str, q: float, *by: str, refined: bool = False) -> DataFrame:
    """Smallest value at which the sorted weights reach q of their sum; ``refined`` finds it without ordering a key in one task."""
    if refined:
        return ranks.weighted_quantiles(df, value, weight, (q,), *by).drop("share")
    up = Window.partitionBy(*by).orderBy(value)
    x = df.where(col(value).isNotNull() & (col(weight) > 0)).withColumn("cum", F.sum(weight).over(up)).withColumn("tot", F.sum(weight).over(Window.partitionBy(*by)))
    return x.where(F.col("cum") >= q * F.col("tot")).groupBy(*by).agg(F.min(value).alias("q"))


def conformal(df: DataFrame, actual: str = "actual", pred: str = "pred", levels: tuple[float, ...] = LEVELS, refined: bool = False) -> DataFrame:
    """Widths below and above the forecast at each level, weighted by decay; a side without residuals takes the symmetric width.

    ``refined`` finds all widths by refinement of stored residuals, for series too long to be ordered in one task.
    """
    x = df.where(col(actual).isNotNull() & col(pred).isNotNull()).withColumn("res", col(actual) - col(pred)).withColumn("wt", decay_weights())
    if refined:
        sides = F.array_compact(F.array(F.when(F.col("res") < 0, F.lit("low")), F.when(F.col("res") > 0, F.lit("high")), F.lit("sym")))
        long = sinks.stored(x.select("symbol", F.abs("res").alias("v"), "wt", F.explode(sides).alias("side")), "residuals")
        got = ranks.weighted_quantiles(long, "v", "wt", levels, "symbol", "side").groupBy("symbol", F.col("share").alias("level"))
        got = got.agg(*[F.max(F.when(F.col("side") == s, F.col("q"))).alias(s) for s in ("low", "high", "sym")])
        return got.select("symbol", "level", *[F.coalesce(c, "sym").alias(c) for c in ("low", "high")])
    sides = {"low": x.where("res < 0").withColumn("v", -F.col("res")), "high": x.where("res > 0").withColumn("v", F.col("res")), "sym": x.withColumn("v", F.abs("res"))}
    out = None
    for level in levels:
        row = x.select("symbol").distinct()
        for name, side in sides.items():
            row = row.join(weighted_quantile(side, "v", "wt", level, "symbol").withColumnRenamed("q", name), "symbol", "left")
        row = row.select("symbol", F.lit(level).alias("level"), F.coalesce("low", "sym").alias("low"), F.coalesce("high", "sym").alias("high"))
        out = row if out is None else out.unionByName(row)
    return out


def coverage(df: DataFrame, widths: DataFrame, actual: str = "actual", pred: str = "pred") -> DataFrame:
    """Share inside, mean width and Winkler score of the intervals of each symbol and level. Widths are a few rows a symbol."""
    x = df.join(widths, "symbol").withColumns({"lo": col(pred) - F.col("low"), "hi": col(pred) + F.col("high")}).where(col(actual).isNotNull() & col(pred).isNotNull())
    alpha = 1 - F.col("level")
    a, lo, hi = col(actual), F.col("lo"), F.col("hi")
    score = hi - lo + F.when(a < lo, 2 / alpha * (lo - a)).otherwise(0.0) + F.when(a > hi, 2 / alpha * (a - hi)).otherwise(0.0)
    return x.groupBy("symbol", "level").agg(F.count(F.lit(1)).alias("n"), F.avg(((a >= lo) & (a <= hi)).cast("double")).alias("picp"), F.avg(hi - lo).alias("mpiw"), F.avg(score).alias("winkler"))


def excursion_coverage(df: DataFrame, qs: tuple[float, ...] = (0.1, 0.25, 0.5, 0.75, 0.9)) -> DataFrame:
    """Scale = quantile of actual / pred (clipped to 10), share of actuals under scale * pred, pinball loss; 20 rows at least."""
    x = df.where("actual is not null and pred > 0").withColumn("ratio", clip(F.col("actual") / F.col("pred"), 0, 10))
    x = sinks.stored(x.select("symbol", "actual", "pred", "ratio"), "ratios")
    scales = ranks.quantiles(x, "ratio", qs, "symbol").where("n >= 20").select("symbol", "n", F.col("share").alias("q"), F.col("q").alias("scale"))
    e = F.col("actual") - F.col("scale") * F.col("pred")
    return x.join(scales.drop("n"), "symbol").groupBy("symbol", "q", "scale").agg(F.count(F.lit(1)).alias("n"), F.avg((e <= 0).cast("double")).alias("coverage"), F.avg(F.greatest(F.col("q") * e, (F.col("q") - 1) * e)).alias("pinball"))


def classification(df: DataFrame, *by: str, threshold: float = 0.7) -> DataFrame:
    """Accuracy, accuracy where confident, share confident, baseline and misses of probabilities p against targets y."""
    hit = ((F.col("p") > 0.5) == (F.col("y") > 0.5)).cast("double")
    sure = (F.col("p") >= threshold) | (F.col("p") <= 1 - threshold)
    up = F.avg((F.col("y") > 0.5).cast("double"))
    return df.groupBy(*by).agg(F.count("p").alias("n"), F.avg(F.when(F.col("p").isNotNull(), hit)).alias("accuracy"), F.avg(F.when(sure, hit)).alias("sure_accuracy"), F.avg(sure.cast("double")).alias("sure_share"), F.greatest(up, 1 - up).alias("baseline"), F.count_if(F.col("p").isNull()).alias("missing"))


def brier(p: str, y: str) -> Column:
    return F.avg(F.pow(col(p) - col(y), 2))


def losing_streak(trades: DataFrame, order: str = "ts") -> DataFrame:
    """Longest run of trades that don't win, by islands."""
    o = Window.partitionBy("symbol").orderBy(order, "event_id")
    x = trades.withColumn("won", F.sum((F.col("pnl_r") > 0).cast("int")).over(o))
    runs = x.where("pnl_r <= 0").groupBy("symbol", "won").agg(F.count(F.lit(1)).alias("n"))
    return runs.groupBy("symbol").agg(F.max("n").alias("max_consec_loss"))


def trade_metrics(trades: DataFrame) -> DataFrame:
    """Win rate, profit factor (infinite without losses), expectancy, ratios of R and the longest losing streak."""
    win, loss = F.when(F.col("pnl_r") > 0, F.col("pnl_r")), F.when(F.col("pnl_r") <= 0, F.col("pnl_r"))
    rate = F.count(win) / F.count(F.lit(1))
    down = F.when(F.col("pnl_r") < 0, F.col("pnl_r"))
    g = trades.groupBy("symbol").agg(
        F.count(F.lit(1)).alias("trades"), rate.alias("win_rate"), F.coalesce(F.sum(win), F.lit(0.0)).alias("gross_profit"), F.abs(F.coalesce(F.sum(loss), F.lit(0.0))).alias("gross_loss"),
        (rate * F.coalesce(F.avg(win), F.lit(0.0)) + (1 - rate) * F.coalesce(F.avg(loss), F.lit(0.0))).alias("expectancy"),
        (F.avg("pnl_r") / (F.stddev_pop("pnl_r") + EPS)).alias("sharpe_r"), (F.avg("pnl_r") / (F.stddev_pop(down) + EPS)).alias("sortino_r"),
    )
    g = g.withColumn("profit_factor", F.when(F.col("gross_loss") > 0, F.col("gross_profit") / F.col("gross_loss")).otherwise(F.lit(float("inf"))))
    return g.join(losing_streak(trades), "symbol", "left").fillna(0, ["max_consec_loss"])


def equity(trades: DataFrame, start: float = 10_000.0, risk: float = 0.02) -> DataFrame:
    """Equity, its peak and drawdown after each trade at a fixed risk of the start."""
    o = Window.partitionBy("symbol").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    x = trades.withColumn("equity", start + F.sum(F.col("pnl_r") * (start * risk)).over(o))
    x = x.withColumn("peak", F.greatest(F.lit(start), F.max("equity").over(o)))
    return x.withColumn("drawdown", (F.col("peak") - F.col("equity")) / F.col("peak"))


def daily_sharpe(curve: DataFrame) -> DataFrame:
    """Sharpe of daily returns: last equity of a day, idle days filled forward, mean / (sd + 1e-9) * sqrt(252)."""
    day = F.to_date("ts").alias("day")
    last = curve.groupBy("symbol", day).agg(F.max_by("equity", F.struct("ts", "event_id")).alias("equity"))
    span = last.groupBy("symbol").agg(F.min("day").alias("a"), F.max("day").alias("b"))
    days = span.select("symbol", F.explode(F.sequence("a", "b")).alias("day"))
    o = Window.partitionBy("symbol").orderBy("day")
    x = days.join(last, ["symbol", "day"], "left").withColumn("e", F.last("equity", True).over(o)).withColumn("ret", F.col("e") / F.lag("e").over(o) - 1)
    return x.groupBy("symbol").agg((F.avg("ret") / (F.stddev_samp("ret") + EPS) * math.sqrt(252)).alias("sharpe"), F.count("ret").alias("days"))


def under_water(curve: DataFrame) -> DataFrame:
    """Longest time in whole days from a peak of equity to a later trade that does not pass it."""
    o = Window.partitionBy("symbol").orderBy("ts", "event_id")
    x = curve.withColumn("before", F.max("equity").over(o.rowsBetween(Window.unboundedPreceding, -1)))
    x = x.withColumn("top", F.when(F.col("before").isNull() | (F.col("equity") > F.col("before")), F.col("ts"))).withColumn("since", F.last("top", True).over(o))
    return x.groupBy("symbol").agg(F.floor(F.max(F.unix_timestamp("ts") - F.unix_timestamp("since")) / 86400).cast("long").alias("tuw_days"))


def guardrail(now: DataFrame, base: DataFrame, tolerance: dict[str, float]) -> DataFrame:
    """Metrics against a baseline: OK, REGRESSED beyond the metric's tolerance, or MISSING."""
    cases = F.lit(0.0)
    for name, t in tolerance.items():
        cases = F.when(F.col("metric") == name, F.lit(t)).otherwise(cases)
    x = base.withColumnRenamed("value", "base").join(now, ["symbol", "metric"], "left")
    return x.withColumn("verdict", F.when(F.col("value").isNull(), "MISSING").when(F.col("value") < F.col("base") - cases, "REGRESSED").otherwise("OK"))


def digests(df: DataFrame, *by: str, digits: int = 6) -> DataFrame:
    """``by``, rows, digest: an identity of the rows of each group that their order doesn't change.

    A row is its columns in order of name as text, floats as integers of so many decimals, null as ~;
    the digest is the sum of the first 60 bits of its MD5, so that tasks add up their rows.
    """
    kinds = dict(df.dtypes)
    scale = 10**digits

    def text(name: str) -> Column:
        c = F.col(name)
        if kinds[name] in ("double", "float"):
            d = c.cast("double")
            number = F.round(d * scale).cast("decimal(38,0)").cast("string")
            c = F.when(F.isnan(d), "nan").when(d == float("inf"), "inf").when(d == float("-inf"), "-inf").otherwise(number)
        return F.coalesce(c.cast("string"), F.lit("~"))

    row = F.concat_ws("|", *[text(c) for c in sorted(df.columns) if c not in by])
    number = F.conv(F.substring(F.md5(row), 1, 15), 16, 10).cast("decimal(38,0)")
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias("rows"), F.sum(number).cast("string").alias("digest"))


def identity(now: DataFrame, base: DataFrame, *by: str) -> DataFrame:
    """Digests against stored ones: SAME RUN, DIFFERENT RUN, or MISSING where one side has no such group."""
    a, b = now.select(*by, F.col("rows").alias("rows_now"), F.col("digest").alias("now")), base.select(*by, F.col("rows").alias("rows_base"), F.col("digest").alias("base"))
    status = F.when(F.col("now").isNull() | F.col("base").isNull(), "MISSING").when((F.col("now") == F.col("base")) & (F.col("rows_now") == F.col("rows_base")), "SAME RUN").otherwise("DIFFERENT RUN")
    return a.join(b, list(by), "full").withColumn("status", status)
