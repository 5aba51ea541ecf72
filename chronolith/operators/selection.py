"""Feature selection inside the folds of a walk-forward: correlation filter, probe ranking, votes of folds.

Every symbol selects for itself. Correlations of all expanding folds come from one pass: tasks add
up products of columns between fold borders, and the sums of the borders before give each fold's
matrix. Probes of all folds, parts and targets are boosted together (``boosting``); their split
counts are ranked, ranks of several targets are fused, and folds vote.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chronolith.functions.exprs import clean, series
from chronolith.operators import boosting
from chronolith.operators.boosting import Booster, Fold, Member

#: Features that a probe passes on, that a selection keeps, and share of folds that must vote for one (fixed values).
PROBED, BUDGET, CONSENSUS = 100, 40, 0.5
#: Least rows of a fold that takes part, and correlation from which on one of two features goes (fixed values).
LEAST, MOST_ALIKE = 200, 0.8


def uncorrelated(matrix: np.ndarray, names: list[str], most: float = MOST_ALIKE) -> list[int]:
    """Numbers of the columns that stay: of each pair in order of columns beyond ``most``, the one of the larger ``_w<number>_`` window goes, the later one at a tie."""
    window = [int(found[0]) if (found := re.findall(r"_w(\d+)_", c)) else 0 for c in names]
    out: set[int] = set()
    for j, i in np.argwhere(np.tril(np.abs(matrix) > most, -1)).tolist():
        if not {i, j} & out:
            out.add(j if window[j] >= window[i] else i)
    return [k for k in range(len(names)) if k not in out]


def _correlations(total: np.ndarray) -> np.ndarray:
    """Pearson's from sums of products of (1, x); 0 where a column is constant."""
    n, s = total[0, 0], total[0, 1:]
    cov = total[1:, 1:] - np.outer(s, s) / n
    d = np.diag(cov).copy()
    d[d <= 1e-12 * np.maximum(np.diag(total)[1:], 1e-300)] = np.nan
    return np.nan_to_num(cov / np.sqrt(np.outer(d, d)))


def uncorrelated_by_fold(df: DataFrame, features: list[str], target: str, ends: Callable[[int], list[int]], most: float = MOST_ALIKE) -> DataFrame:
    """symbol, fold, features (numbers that stay on the rows before the fold's end). ``ends`` gives the folds' ends for n rows with a target."""
    x = df.where(F.col(target).isNotNull()).select("symbol", "ts", F.array(*[F.coalesce(clean(F.col(c).cast("double")), F.lit(0.0)) for c in features]).alias("x"))
    x = x.withColumn("k", F.row_number().over(series()) - 1).withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("symbol")))
    size = len(features) + 1

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[tuple, np.ndarray] = {}
        for g in batches:
            for (symbol, n), rows in g.groupby(["symbol", "n"]):
                own = np.searchsorted(sorted(ends(int(n))), rows["k"].to_numpy(), side="right")
                v = np.column_stack([np.ones(len(rows)), np.stack(rows["x"].to_numpy())])
                for part in np.unique(own):
                    z = v[own == part]
                    key = (symbol, int(n), int(part))
                    held[key] = held.get(key, 0) + z.T @ z
        yield pd.DataFrame([(*k, m.tobytes()) for k, m in held.items()], columns=["symbol", "n", "part", "sums"])

    def judged(g: pd.DataFrame) -> pd.DataFrame:
        symbol, n = g["symbol"].iloc[0], int(g["n"].iloc[0])
        borders = sorted(ends(n))
        parts = [np.zeros((size, size)) for _ in range(len(borders) + 1)]
        for part, m in zip(g["part"], g["sums"]):
            parts[part] = parts[part] + np.frombuffer(m).reshape(size, size)
        upto = np.cumsum(parts, axis=0)
        rows = [(symbol, f, uncorrelated(_correlations(upto[borders.index(e)]), features, most)) for f, e in enumerate(ends(n)) if e > 0]
        return pd.DataFrame(rows, columns=["symbol", "fold", "features"])

    sums = x.mapInPandas(partial, "symbol string, n long, part int, sums binary")
    return sums.groupBy("symbol").applyInPandas(judged, "symbol string, fold int, features array<int>")


def ranked(df: DataFrame, features: list[str], targets: tuple[str, ...], ends: Callable[[int], list[int]], kept: DataFrame, probe: Member = boosting.PROBE, parts: int = 5, shared: int = 500, top: int = PROBED) -> DataFrame:
    """symbol, fold, target, feature, place, importance, position: features of each fold's rows by the mean split count of probes on expanding parts.

    A fold with too few rows for its probes ranks its features in their own order, importance 0.
    """
    inner = boosting.probes(parts)
    plan = lambda n: [p for e in ends(n) for p in (inner(e) or [Fold(0, 0, 0, n, n)] * parts)]
    melted = None
    for t in targets:
        part = df.select(F.concat_ws("|", "symbol", F.lit(t)).alias("symbol"), "ts", *features, F.col(t).alias("__y"))
        melted = part if melted is None else melted.unionByName(part)
    names = F.explode(F.array(*[F.lit(t) for t in targets])).alias("target")
    allowed = kept.select("symbol", "fold", "features", names).select(F.concat_ws("|", "symbol", "target").alias("symbol"), F.explode(F.sequence(F.col("fold") * parts, F.col("fold") * parts + parts - 1)).alias("fold"), "features")
    rows = boosting.blocks(melted, features, "__y", shared)
    booster = Booster((probe,), plan)
    trees = booster.fit(rows, allowed)
    used = booster.importances(trees, features)
    used = used.groupBy("symbol", F.floor(F.col("fold") / parts).cast("int").alias("fold"), "place").agg(F.avg("splits").alias("importance"))
    used = used.select(F.substring_index("symbol", "|", -1).alias("target"), F.regexp_extract("symbol", r"^(.*)\|[^|]*$", 1).alias("symbol"), "fold", "place", "importance")
    every = kept.select("symbol", "fold", F.explode("features").alias("place"), F.lit(list(targets)).alias("t")).select("symbol", "fold", "place", F.explode("t").alias("target"))
    every = every.join(used, ["symbol", "fold", "target", "place"], "left").withColumn("importance", F.coalesce("importance", F.lit(0.0)))
    order = Window.partitionBy("symbol", "fold", "target").orderBy(F.desc(F.round("importance", 9)), "place")
    name = F.element_at(F.lit(list(features)), F.col("place") + 1)
    return every.withColumn("position", F.row_number().over(order) - 1).where(F.col("position") < top).withColumn("feature", name)


def consensus(rank: DataFrame, ends: DataFrame, budget: int = BUDGET, share: float = CONSENSUS) -> DataFrame:
    """symbol, rank, feature, votes: features that enough folds have among their first ``budget``, by votes, then by the earliest fold and rank there.

    Ranks of several targets are fused: by mean position, number of targets, name. ``ends`` (symbol, folds) tells how many folds a symbol has.
    """
    fused = rank.groupBy("symbol", "fold", "feature").agg(F.avg("position").alias("mean"), F.count(F.lit(1)).alias("times"))
    place = Window.partitionBy("symbol", "fold").orderBy("mean", F.desc("times"), "feature")
    votes = fused.withColumn("place", F.row_number().over(place)).where(F.col("place") <= budget)
    votes = votes.groupBy("symbol", "feature").agg(F.count(F.lit(1)).alias("votes"), F.min(F.struct("fold", "place")).alias("first"))
    votes = votes.join(ends, "symbol").where(F.col("votes") >= F.greatest(F.lit(1), F.floor(F.col("folds") * share)))
    order = Window.partitionBy("symbol").orderBy(F.desc("votes"), "first")
    return votes.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= budget).select("symbol", "rank", "feature", "votes")


def fold_consensus(df: DataFrame, features: list[str], targets: tuple[str, ...], min_train: int, gap: int, share: float = 0.15, most: int = 10, probe: Member = boosting.PROBE, budget: int = BUDGET) -> DataFrame:
    """The features that a symbol's folds agree on; each fold selects on its own purged training rows."""
    outer = boosting.expanding(min_train, gap, share, most)
    ends = lambda n: [f.end for f in outer(n) if f.end >= LEAST]
    known = df.where(" AND ".join(f"{t} IS NOT NULL" for t in targets))
    kept = uncorrelated_by_fold(known, features, targets[0], ends)
    rank = ranked(known, features, targets, ends, kept, probe, shared=min_train)
    return consensus(rank, kept.groupBy("symbol").agg(F.count(F.lit(1)).alias("folds")), budget)


def pipeline(df: DataFrame, features: list[str], target: str, min_train: int, probe: Member = boosting.PROBE, walk_forward_fn: Callable[[DataFrame, DataFrame], DataFrame] | None = None, budget: int = BUDGET) -> DataFrame:
    """Correlation filter, probe ranking, and a full walk-forward on what is left if that is over the budget: symbol, rank, feature, importance.

    ``walk_forward_fn(df, allowed)`` gives (symbol, feature, importance) of the features allowed (symbol, fold, features); without it the probe's ranking is cut.
    """
    whole = lambda n: [n]
    kept = uncorrelated_by_fold(df, features, target, whole)
    rank = ranked(df, features, (target,), whole, kept, probe, shared=min_train).select("symbol", "feature", "place", "importance", "position")
    order = Window.partitionBy("symbol").orderBy("position")
    if walk_forward_fn is not None:
        chosen = rank.groupBy("symbol").agg(F.array_sort(F.collect_list(F.col("place"))).alias("features"))
        full = walk_forward_fn(df, chosen).select("symbol", "feature", F.col("importance").alias("walked"))
        over = F.count(F.lit(1)).over(Window.partitionBy("symbol")) > budget
        rank = rank.join(full, ["symbol", "feature"], "left").withColumn("importance", F.when(over, F.coalesce("walked", F.lit(0.0))).otherwise(F.col("importance")))
        order = Window.partitionBy("symbol").orderBy(F.desc(F.round("importance", 9)), "position")
    return rank.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= budget).select("symbol", "rank", "feature", "importance")
