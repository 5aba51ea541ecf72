"""Models: ridge by normal equations, isotonic calibration, boosted ensembles, custom losses, selection, walk-forward, veto."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import replace

import numpy as np
import pandas as pd
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.stat import Correlation
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronolith.functions.exprs import clean, r6, seconds, series, whole
from chronolith.operators import boosting
from chronolith.operators.boosting import Booster, Fold, Member
from chronolith.operators.evaluate import folds, inner_validation

X = ("ml", "har", "lag1", "lag2")


def with_lags(fc: DataFrame) -> DataFrame:
    o = series()
    return fc.withColumns({"lag1": F.coalesce(F.lag("ml").over(o), F.col("ml")), "lag2": F.coalesce(F.lag("har").over(o), F.col("har"))})


#: Columns of the ridge: the six HAR features (``features.har``).
HAR = ("har_d", "har_w", "har_m", "har_l1", "har_l2", "har_jump")


def _fold_size(share: float, least: int) -> Column:
    return F.greatest(F.floor(F.col("n") * share), F.lit(least)).cast("long")


def ridge_folds(df: DataFrame, targets: tuple[str, ...], alpha: float = 1e-4, least: int = 25, min_train: int = 500, gap: int = 5, share: float = 0.1, most: int = 8, shortest: int = 50) -> tuple[DataFrame, DataFrame]:
    """Rows with their number k, their fold and their targets in long form; and the ridge of each (symbol, target, fold): intercept and coefficients.

    Every fold's sums of products come from one aggregation: rows are summed by the stretch between two folds' purged ends,
    and a fold takes the stretches before its own. The last fold (``most``) is fitted on all rows and answers for rows in no test part.
    Under ``least`` rows with finite values the answer is the mean of the target, 0 without any.
    """
    names = [*HAR, "y"]
    x = df.withColumn("k", F.row_number().over(series()) - 1).withColumn("n", F.count(F.lit(1)).over(whole()))
    size = _fold_size(share, 100)
    x = x.withColumn("size", size)
    done = F.floor((F.col("k") - min_train) / F.col("size"))
    end = F.least(F.lit(min_train) + (done + 1) * F.col("size"), F.col("n"))
    tested = (F.col("k") >= min_train) & (done < most) & (end - (F.lit(min_train) + done * F.col("size")) >= shortest)
    x = x.withColumn("fold", F.when(tested, done).otherwise(most).cast("int"))
    x = x.withColumn("part", F.when(F.col("k") < min_train - gap, 0).otherwise(F.least(F.floor((F.col("k") - (min_train - gap)) / F.col("size")) + 1, F.lit(most))).cast("int"))
    long = x.select("symbol", "ts", "k", "fold", "part", *[clean(F.col(c)).alias(c) for c in HAR], F.explode(F.array(*[F.struct(F.lit(t).alias("target"), clean(F.col(t)).alias("y")) for t in targets])).alias("z")).select("*", "z.target", "z.y").drop("z")
    known = long.where(" AND ".join(f"{c} IS NOT NULL" for c in names))
    pairs = [(a, b) for i, a in enumerate(names) for b in names[i:]]
    sums = known.groupBy("symbol", "target", "part").agg(*[F.sum(F.col(a) * F.col(b)).alias(f"{a}__{b}") for a, b in pairs], *[F.sum(a).alias(a) for a in names], F.count(F.lit(1)).alias("m"))
    fold = F.explode(F.sequence(F.lit(0), F.lit(most))).alias("fold")
    every = x.select("symbol").distinct().select("symbol", fold, F.lit(list(targets)).alias("t")).select("symbol", "fold", F.explode("t").alias("target"))
    values = [f"{a}__{b}" for a, b in pairs] + names + ["m"]
    upto = every.join(sums, ["symbol", "target"], "left").groupBy("symbol", "target", "fold").agg(*[F.sum(F.when(F.col("part") <= F.col("fold"), F.col(c))).alias(c) for c in values])

    def solve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for g in batches:
            out = []
            for r in g.to_dict("records"):
                n = 0 if r["m"] is None or r["m"] != r["m"] else int(r["m"])
                mean = {a: r[a] / n if n else 0.0 for a in names}
                cov = lambda a, b: (r[f"{a}__{b}"] if f"{a}__{b}" in r else r[f"{b}__{a}"]) - n * mean[a] * mean[b]  # noqa: B023, E731
                beta = np.linalg.solve(np.array([[cov(a, b) for b in HAR] for a in HAR]) + alpha * np.eye(len(HAR)), np.array([cov(a, "y") for a in HAR])) if n >= least else np.zeros(len(HAR))
                out.append((r["symbol"], r["target"], r["fold"], n, mean["y"], mean["y"] - sum(b * mean[a] for a, b in zip(HAR, beta)), *beta))
            yield pd.DataFrame(out, columns=["symbol", "target", "fold", "rows", "fallback", "intercept", *[f"b_{c}" for c in HAR]])

    return long, upto.mapInPandas(solve, "symbol string, target string, fold int, rows long, fallback double, intercept double, " + ", ".join(f"b_{c} double" for c in HAR))


def har_ridge(df: DataFrame, targets: tuple[str, ...], most: int = 8, **how) -> DataFrame:
    """symbol, ts_s, target, oos, har: each row by the ridge of the fold that tests it, else by the one on all rows; rows with a missing feature get the fallback."""
    long, models = ridge_folds(df, targets, most=most, **how)
    x = long.join(models, ["symbol", "target", "fold"])
    pred = F.col("intercept") + sum(F.col(c) * F.col(f"b_{c}") for c in HAR)
    return x.select("symbol", seconds().alias("ts_s"), "target", (F.col("fold") < most).alias("oos"), F.coalesce(pred, F.col("fallback")).alias("har"))


def isotonic(df: DataFrame, least: int = 100, past: float = 0.7, distinct: int = 1, low: float = 0.01, high: float = 0.99) -> DataFrame:
    """Isotonic calibration of p to y, clipped to [low, high], of the rows after the first ``past`` of each series.

    Each series is fitted on its own earlier rows, which are pooled to blocks of equal p before they meet in
    one task of the series; p stays as it is with under ``least`` rows or ``distinct`` values to fit on.
    """

    def run(g: pd.DataFrame) -> pd.DataFrame:
        fit = g[g["fit"]].sort_values("p")
        new = g[~g["fit"]][["symbol", "ts_s", "p"]].copy()
        p, y, w = (fit[c].to_numpy(float) for c in ("p", "y", "w"))
        if w.sum() >= least and len(p) >= distinct:
            # Pool adjacent violators.
            level: list[list[float]] = []
            for a, v, n in zip(p, y, w):
                level.append([v, n, a, a])
                while len(level) > 1 and level[-2][0] >= level[-1][0]:
                    v1, n1, _, hi = level.pop()
                    v0, n0, lo, _ = level.pop()
                    level.append([(v0 * n0 + v1 * n1) / (n0 + n1), n0 + n1, lo, hi])
            x = [z for _, _, lo, hi in level for z in ((lo, hi) if hi > lo else (lo,))]
            q = [v for v, _, lo, hi in level for _ in range(2 if hi > lo else 1)]
            new["p"] = np.clip(np.interp(new["p"], x, q), low, high)
        return new.rename(columns={"p": "calibrated"})

    x = df.select("symbol", "ts", "p", "y").withColumn("fit", F.percent_rank().over(series()) < past)
    old = x.where("fit").groupBy("symbol", "p").agg(F.avg("y").alias("y"), F.count(F.lit(1)).cast("double").alias("w")).select("symbol", F.lit(0).cast("long").alias("ts_s"), "p", "y", "w", F.lit(True).alias("fit"))
    new = x.where("not fit").select("symbol", seconds().alias("ts_s"), "p", "y", F.lit(1.0).alias("w"), F.lit(False).alias("fit"))
    out = old.unionByName(new).groupBy("symbol").applyInPandas(run, "symbol string, ts_s long, calibrated double")
    return out.select("symbol", "ts_s", r6("calibrated").alias("calibrated"))


class Boost:
    """Boosted stumps on histograms for any loss with gradient and curvature."""

    def __init__(self, grad, rounds: int = 40, rate: float = 0.1, bins: int = 16, least: int = 20):
        self.grad, self.rounds, self.rate, self.bins, self.least = grad, rounds, rate, bins, least

    def fit(self, x: np.ndarray, y: np.ndarray) -> "Boost":
        self.base = float(np.median(y)) if len(y) else 0.0
        self.steps = []
        pred = np.full(len(y), self.base)
        cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, self.bins + 1)[1:-1])) for j in range(x.shape[1])] if len(y) else []
        for _ in range(self.rounds if len(y) else 0):
            g, h = self.grad(y, pred)
            best = None
            for j, edges in enumerate(cuts):
                b = np.searchsorted(edges, x[:, j])
                gs, hs, n = (np.cumsum(np.bincount(b, v, len(edges) + 1)) for v in (g, h, np.ones(len(y))))
                gain = gs[:-1] ** 2 / (hs[:-1] + 1) + (gs[-1] - gs[:-1]) ** 2 / (hs[-1] - hs[:-1] + 1)
                gain[(n[:-1] < self.least) | (n[-1] - n[:-1] < self.least)] = -np.inf
                k = int(gain.argmax()) if len(gain) else -1
                if k >= 0 and np.isfinite(gain[k]) and (best is None or gain[k] > best[0]):
                    best = (gain[k], j, edges[k], -gs[k] / (hs[k] + 1), -(gs[-1] - gs[k]) / (hs[-1] - hs[k] + 1))
            if best is None:
                break
            _, j, edge, low, high = best
            self.steps.append((j, edge, self.rate * low, self.rate * high))
            pred = pred + np.where(x[:, j] <= edge, self.rate * low, self.rate * high)
        return self

    def predict(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        for j, edge, low, high in self.steps:
            out += np.where(x[:, j] <= edge, low, high)
        return out


def pinball(alpha: float):
    return lambda y, p: (np.where(y > p, -alpha, 1 - alpha), np.ones(len(y)))


def qlike_grad(y: np.ndarray, p: np.ndarray):
    e = np.exp(np.clip(y - p, -10, 10))
    return 1 - e, e


def huber_grad(y: np.ndarray, p: np.ndarray, delta: float = 1.0):
    return np.clip(p - y, -delta, delta), np.ones(len(y))


def shortened(members: tuple[Member, ...], rounds: int, depth: int = 3) -> tuple[Member, ...]:
    """The members with at most so many rounds and levels, at a rate that makes up for the rounds (0.3 at most)."""
    return tuple(replace(m, rounds=min(m.rounds, rounds), depth=min(m.depth, depth), rate=min(0.3, m.rate * max(1, m.rounds / rounds))) for m in members)


def split(past: float = 0.7, gap: int = 5):
    """The plan of one fold: the first ``past`` of a series, purged inner validation, applied to the rest."""

    def plan(n: int) -> list[Fold]:
        a = int(n * past)
        train, valid = inner_validation(a, gap)
        return [Fold(train, valid, a, a, n)] if train > 0 else []

    return plan


def ensemble(df: DataFrame, features: list[str], target: str, members: tuple[Member, ...] = boosting.ENSEMBLE, weights: tuple[float, ...] | None = None, patience: int = 60) -> tuple[DataFrame, DataFrame]:
    """(symbol, ts_s, p0, p1, ..., pred), the members' predictions after the first 70 % of each series and their weighted mean; and (symbol, feature, importance), mean split counts."""
    booster = Booster(members, split(), patience)
    rows = boosting.blocks(df, features, target, 500)
    trees = booster.fit(rows)
    weights = weights or (1.0,) * len(members)
    pred = sum(F.col(f"p{k}") * (w / sum(weights)) for k, w in enumerate(weights))
    wide = booster.predict(rows, trees).groupBy("symbol", "ts_s").agg(*[F.max(F.when(F.col("member") == k, F.col("pred"))).alias(f"p{k}") for k in range(len(members))])
    used = booster.importances(trees, features)
    return wide.withColumn("pred", pred), used.select("symbol", "feature", F.col("splits").alias("importance"))


def walk_forward(df: DataFrame, features: list[str], target: str, min_train: int = 500, gap: int = 5, share: float = 0.15, most: int = 10, members: tuple[Member, ...] = boosting.ENSEMBLE, patience: int = 60, allowed: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """The out-of-sample map (symbol, ts_s, fold, pred), the ensemble's mean on each fold's test rows, and importances (symbol, feature, importance) over the folds.

    ``allowed`` (symbol, features) limits a symbol to some features, in all folds.
    """
    booster = Booster(members, boosting.expanding(min_train, gap, share, most), patience)
    rows = boosting.blocks(df, features, target, min_train)
    if allowed is not None:
        allowed = allowed.select("symbol", F.explode(F.sequence(F.lit(0), F.lit(most - 1))).alias("fold"), "features")
    trees = booster.fit(rows, allowed)
    oos = booster.predict(rows, trees).groupBy("symbol", "ts_s", "fold").agg(F.avg("pred").alias("pred"))
    used = booster.importances(trees, features).groupBy("symbol", "feature").agg(F.avg("splits").alias("importance"))
    return oos, used


def objectives(df: DataFrame, features: list[str], target: str, losses: tuple[str, ...] = ("qlike", "huber"), members: tuple[Member, ...] = boosting.ENSEMBLE, patience: int = 60) -> DataFrame:
    """symbol, ts_s and a column for each loss: ensembles whose members all follow that loss, after the first 70 % of each series."""
    every = tuple(replace(m, loss=x) for x in losses for m in members)
    booster = Booster(every, split(), patience)
    rows = boosting.blocks(df, features, target, 500)
    got = booster.predict(rows, booster.fit(rows))
    return got.groupBy("symbol", "ts_s").agg(*[F.avg(F.when(F.floor(F.col("member") / len(members)) == k, F.col("pred"))).alias(x) for k, x in enumerate(losses)])


def trade_plan(df: DataFrame, features: list[str], target: str = "target", spec: Member = boosting.TRADE_PLAN, gap: int = 10, patience: int = 40) -> DataFrame:
    """Six quantiles in ATR for bars after the first 70 % of those with the trade's direction: stop (0.40 of the adverse move) and two targets
    (0.55, 0.75 of the favourable one) up and down. A side with under max(100, min(300, 5 % of the rows)) rows has none; the far target is not below the near one.

    Columns: symbol, ts_s, up_stop_atr, up_tp1_atr, up_tp2_atr, down_stop_atr, down_tp1_atr, down_tp2_atr; those of the other side are null.
    """
    alphas = (0.4, 0.55, 0.75)
    total = df.where(F.col(target).isNotNull()).groupBy("symbol").agg(F.count(F.lit(1)).alias("__n"))
    need = F.greatest(F.lit(100), F.least(F.lit(300), F.floor(F.col("__n") * 0.05)))
    sides = None
    for side, on, moves in (("up", F.col(target) > 0.5, ("long_mae_atr", "long_mfe_atr")), ("down", F.col(target) < 0.5, ("short_mae_atr", "short_mfe_atr"))):
        for kind, column in zip(("mae", "mfe"), moves):
            part = df.where(on).select(F.concat_ws("|", "symbol", F.lit(f"{side}_{kind}")).alias("symbol"), "ts", *features, F.col(column).alias("__y"), F.col("symbol").alias("__own"))
            sides = part if sides is None else sides.unionByName(part)
    sides = sides.where("__y is not null")
    enough = sides.groupBy("symbol", F.col("__own")).agg(F.count(F.lit(1)).alias("__k")).join(total.withColumnRenamed("symbol", "__own"), "__own").where(F.col("__k") >= need).select("symbol")
    rows = boosting.blocks(sides.join(enough, "symbol", "left_semi"), features, "__y", 200)

    def plan(n: int) -> list[Fold]:
        a = int(n * 0.7)
        train, valid = inner_validation(a, gap, least=30)
        return [Fold(train, valid, a, a, n)] if train > 0 else []

    booster = Booster(tuple(replace(spec, alpha=a) for a in alphas), plan, patience)
    got = booster.predict(rows, booster.fit(rows)).withColumn("kind", F.substring_index("symbol", "|", -1)).withColumn("symbol", F.regexp_extract("symbol", r"^(.*)\|[^|]*$", 1))
    one = lambda kind, m: F.max(F.when((F.col("kind") == kind) & (F.col("member") == m), F.greatest("pred", F.lit(0.0))))
    names = {f"{s}_{n}_atr": one(f"{s}_{kind}", m) for s in ("up", "down") for n, kind, m in (("stop", "mae", 0), ("tp1", "mfe", 1), ("tp2", "mfe", 2))}
    wide = got.groupBy("symbol", "ts_s").agg(*[c.alias(n) for n, c in names.items()])
    return wide.withColumns({f"{s}_tp2_atr": F.greatest(f"{s}_tp2_atr", f"{s}_tp1_atr") for s in ("up", "down")})


def correlation_filter(df: DataFrame, names: list[str], most: float = 0.8) -> list[str]:
    """Columns in order, where of each pair that correlates beyond ``most`` one is left out: that of the larger
    ``_w<number>_`` window, the later column at a tie. A column that is out takes none with it. Missing values
    count as 0; the matrix is columns squared."""
    clean = df.select(*[F.when(F.col(c).isNull() | F.isnan(c) | F.abs(c).isin(float("inf")), 0.0).otherwise(F.col(c)).alias(c) for c in names])
    m = np.abs(np.nan_to_num(Correlation.corr(VectorAssembler(inputCols=names, outputCol="v").transform(clean).select("v"), "v").first()[0].toArray()))
    window = [int(found[0]) if (found := re.findall(r"_w(\d+)_", c)) else 0 for c in names]
    out: set[int] = set()
    for j, i in ((j, i) for j in range(len(names)) for i in range(j) if m[i, j] > most):
        if not {i, j} & out:
            out.add(j if window[j] >= window[i] else i)
    return [c for k, c in enumerate(names) if k not in out]


def linear_walk_forward(fc: DataFrame, purge: int = 5) -> DataFrame:
    """Out-of-sample predictions by least squares: every fold's model sees rows before its test and before the purge gap only."""

    def run(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values("ts")
        x, y = g[list(X)].to_numpy(float), g["actual"].to_numpy(float)
        parts = []
        for fold, a, b in folds(len(g), 500):
            t = max(a - purge, 1)
            A = np.column_stack([np.ones(t), x[:t]])
            beta = np.linalg.lstsq(A.T @ A + 1e-8 * np.eye(A.shape[1]), A.T @ y[:t], rcond=None)[0]
            part = g.iloc[a:b][["symbol", "ts"]].copy()
            part["fold"], part["pred"] = fold, (np.column_stack([np.ones(b - a), x[a:b]]) @ beta).round(6)
            parts.append(part)
        return pd.concat(parts) if parts else pd.DataFrame({"symbol": [], "ts": [], "fold": [], "pred": []})

    rows = with_lags(fc).where("actual is not null").select("symbol", "ts", "actual", *X)
    return rows.groupBy("symbol").applyInPandas(run, "symbol string, ts timestamp, fold int, pred double").select("symbol", seconds().alias("ts_s"), "fold", "pred")


def shadow(ledger: DataFrame, bars: DataFrame, veto: float = 0.45) -> DataFrame:
    """Veto of trades whose win probability, by a small weighted forest on their hour's bar, is under ``veto``. Trades without a bar pass."""
    from pyspark.ml.classification import GBTClassifier

    hour = ledger.withColumn("hour", F.date_trunc("hour", "ts"))
    x = hour.join(bars.select("symbol", F.col("ts").alias("hour"), "open", "high", "low", "close", "volume"), ["symbol", "hour"], "left")
    last = x.agg(F.max("ts")).first()[0]
    x = x.withColumn("weight", F.exp(-0.6931471805599453 * F.datediff(F.lit(last), F.col("ts")) / 30)).withColumn("label", F.col("win").cast("double"))
    known = VectorAssembler(inputCols=["open", "high", "low", "close", "volume"], outputCol="v", handleInvalid="skip").transform(x)
    model = GBTClassifier(featuresCol="v", labelCol="label", weightCol="weight", maxDepth=2, maxIter=5, seed=7).fit(known)
    from pyspark.ml.functions import vector_to_array

    got = model.transform(known).select("event_id", vector_to_array("probability")[1].alias("p"))
    return ledger.select("event_id").join(got, "event_id", "left").select("event_id", F.coalesce(F.col("p") < veto, F.lit(False)).alias("vetoed"))
