"""Boosted trees on histograms, for all symbols, folds and members at once.

Rows are packed once to blocks of one symbol (binned features, target, weight) in the shared
folder. Models of series of at most ``WHOLE`` rows are fitted a model to a task's group, all in one
job. Longer series are grown by Spark level by level: a job per level sums gradients by (symbol, fold, member, node, feature, bin): tasks add up
their blocks, Spark adds up the tasks and picks each node's split. Splits are rows of a table,
so nothing but their number of levels passes through the driver, and a series of any length is as
many tasks as it has blocks. Predictions are carried in the blocks and renewed every few rounds.

Members differ in size, rate, sampling of rows and columns, and loss; a leaf of a pinball member
takes the quantile of its rows. Each is stopped early on
the purged validation part of its fold, which no gradient sees. Bins are quantiles of the rows
that every fold trains on.

A node is split by level, best gains first while the member has leaves left. Sums are added in no
fixed order, so gains are compared after rounding to nine digits; ties go to the smaller feature
and bin. Null, NaN and infinite features count as 0; rows without a target take no part.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chronolith.functions.exprs import clean, seconds, series
from chronolith.operators.evaluate import folds, inner_validation
from chronolith.sources import sinks

#: Rows of a block, bins of a feature, and rounds after which the blocks' predictions are renewed.
BLOCK, BINS, RENEW = 4096, 32, 8
#: Rows of the longest series whose models are fitted in one group each.
WHOLE = 50_000
#: The feature of rows that hold the value of a leaf.
LEAF = -9


@dataclass(frozen=True)
class Member:
    """One model of an ensemble. ``loss``: square, qlike, huber or pinball with ``alpha``."""

    rounds: int
    rate: float
    leaves: int
    depth: int
    least: int
    rows: float = 1.0
    columns: float = 1.0
    l1: float = 0.0
    l2: float = 0.0
    seed: int = 0
    loss: str = "square"
    alpha: float = 0.5


@dataclass(frozen=True)
class Fold:
    """Row numbers of a fold: trained on [0, train), stopped early on [valid, end), applied to [test, last)."""

    train: int
    valid: int
    end: int
    test: int
    last: int


# The three members of the direction ensemble, the trade-plan regressor and the shallow probe.
ENSEMBLE = (
    Member(rounds=800, rate=0.02, leaves=31, depth=5, least=40, rows=0.75, columns=0.75, l1=0.15, l2=0.15, seed=42),
    Member(rounds=600, rate=0.03, leaves=15, depth=3, least=60, rows=0.7, columns=0.65, l1=0.3, l2=0.3, seed=123),
    Member(rounds=500, rate=0.015, leaves=63, depth=7, least=30, rows=0.8, columns=0.8, l1=0.1, l2=0.1, seed=7),
)
TRADE_PLAN = Member(rounds=400, rate=0.03, leaves=31, depth=5, least=40, rows=0.75, columns=0.75, l1=0.1, l2=0.1, seed=42, loss="pinball")
PROBE = Member(rounds=150, rate=0.05, leaves=15, depth=3, least=30, rows=0.8, columns=0.8, l1=0.1, l2=0.1, seed=42)


def expanding(min_train: int, gap: int, share: float = 0.15, most: int = 10, final: bool = False) -> Callable[[int], list[Fold]]:
    """The plan of a walk-forward over n rows: purged expanding folds, each with its own purged validation part; ``final`` adds one over all rows."""

    def plan(n: int) -> list[Fold]:
        out = []
        for _, a, b in folds(n, min_train, share, most=most):
            end = max(a - gap, 0)
            train, valid = inner_validation(end, gap)
            out.append(Fold(train, valid, end, a, b))
        if final and out:
            train, valid = inner_validation(n, gap)
            out.append(Fold(train, valid, n, n, n))
        return out

    return plan


def probes(parts: int = 5, least: int = 300, shortest: int = 50) -> Callable[[int], list[Fold]]:
    """The plan of a probe: expanding parts of equal step without validation; none with too few rows."""

    def plan(n: int) -> list[Fold]:
        step = n // (parts + 1)
        return [Fold(step * k, step * k, step * k, n, n) for k in range(1, parts + 1)] if n >= least and step >= shortest else []

    return plan


def gradient(m: Member, y: np.ndarray, p: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if m.loss == "qlike":
        e = np.exp(np.clip(y - p, -10, 10))
        return 1 - e, e
    if m.loss == "huber":
        return np.clip(p - y, -1, 1), np.ones(len(y))
    if m.loss == "pinball":
        return np.where(y > p, -m.alpha, 1 - m.alpha), np.ones(len(y))
    return p - y, np.ones(len(y))


def loss(m: Member, y: np.ndarray, p: np.ndarray) -> np.ndarray:
    """What early stopping watches: absolute error, or the member's own loss."""
    e = y - p
    if m.loss == "qlike":
        x = np.clip(e, -10, 10)
        return np.exp(x) - x - 1
    if m.loss == "huber":
        return np.where(np.abs(e) <= 1, 0.5 * e * e, np.abs(e) - 0.5)
    if m.loss == "pinball":
        return np.where(e > 0, m.alpha * e, (m.alpha - 1) * e)
    return np.abs(e)


def _noise(seed: int, turn: int, at: np.ndarray) -> np.ndarray:
    """A number in [0, 1) for each place, the same wherever it is computed."""
    x = at.astype(np.uint64) + np.uint64((seed * 1_000_003 + turn * 7_919 + 1) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return (x >> np.uint64(11)).astype(np.float64) / float(1 << 53)


def sampled_rows(m: Member, turn: int, k: np.ndarray) -> np.ndarray:
    return _noise(m.seed, turn, k) < m.rows


def sampled_columns(m: Member, turn: int, allowed: np.ndarray) -> np.ndarray:
    """The numbers of the features that a tree may use, out of those allowed."""
    take = max(1, int(len(allowed) * m.columns))
    return np.sort(allowed[np.argsort(_noise(m.seed, turn, allowed + 1_000_000_007), kind="stable")[:take]])


# ---- blocks --------------------------------------------------------------------------------------------------------

_BLOCKS = "symbol string, n long, k binary, ts binary, bins binary, y binary, pred binary"


def blocks(df: DataFrame, features: list[str], target: str, shared: int, weight: Column | None = None) -> DataFrame:
    """Packed rows with a target: numbered by time in their symbol, features binned by quantiles of the first ``shared`` rows."""
    x = df.where(F.col(target).isNotNull()).select("symbol", "ts", F.col(target).cast("double").alias("y"), F.array(*[F.coalesce(clean(F.col(c).cast("double")), F.lit(0.0)) for c in features]).alias("x"))
    x = x.withColumn("k", F.row_number().over(series()) - 1)
    size = x.groupBy("symbol").agg(F.count(F.lit(1)).alias("n"))
    steps = F.array(*[F.lit(i / BINS) for i in range(1, BINS)])
    edges = x.where(F.col("k") < shared).select("symbol", F.posexplode("x").alias("feature", "v")).groupBy("symbol", "feature").agg(F.percentile("v", steps).alias("cuts"))
    edges = edges.groupBy("symbol").agg(F.transform(F.sort_array(F.collect_list(F.struct("feature", "cuts"))), lambda e: e["cuts"]).alias("edges"))
    held = x.groupBy("symbol", F.floor(F.col("k") / BLOCK).alias("block")).agg(F.sort_array(F.collect_list(F.struct("k", seconds().alias("ts"), "y", "x"))).alias("rows")).join(size, "symbol").join(edges, "symbol")

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for g in batches:
            out = []
            for symbol, rows, n, cuts in zip(g["symbol"], g["rows"], g["n"], g["edges"]):
                v = np.array([r["x"] for r in rows], float).reshape(len(rows), -1)
                bins = np.column_stack([np.searchsorted(np.unique(c), v[:, j]) for j, c in enumerate(cuts)]).astype(np.uint8)
                out.append((symbol, n, np.array([r["k"] for r in rows], np.int64).tobytes(), np.array([r["ts"] for r in rows], np.int64).tobytes(), bins.tobytes(), np.array([r["y"] for r in rows], float).tobytes(), b""))
            yield pd.DataFrame(out, columns=[c.split(" ")[0] for c in _BLOCKS.split(", ")])

    return sinks.stored(held.select("symbol", "rows", "n", "edges").mapInPandas(pack, _BLOCKS), "blocks")


class Trees:
    """The trees of one symbol: base and splits by model, and the losses of each round."""

    def __init__(self, rows: list):
        self.base: dict[tuple[int, int], float] = {}
        self.splits: dict[tuple[int, int], dict[int, dict[int, tuple]]] = {}
        self.losses: dict[tuple[int, int], dict[int, float]] = {}
        self.leaves: dict[tuple[int, int], dict[int, dict[int, float]]] = {}
        for fold, member, turn, node, feature, b, left, right in rows:
            if node == -2:
                self.base[fold, member] = left
            elif node == -1:
                self.losses.setdefault((fold, member), {})[turn] = left
            elif feature == LEAF:
                self.leaves.setdefault((fold, member), {}).setdefault(turn, {})[node] = left
            else:
                self.splits.setdefault((fold, member), {}).setdefault(turn, {})[node] = (feature, b, left, right)

    def best(self, model: tuple[int, int]) -> int:
        """Number of rounds after which the validation loss was least."""
        seen = self.losses.get(model)
        return min(seen, key=lambda t: (round(seen[t], 12), t)) if seen else 1 << 30

    def stopped(self, model: tuple[int, int], patience: int) -> bool:
        return model in self.losses and max(self.losses[model]) - self.best(model) >= patience

    def walk(self, model: tuple[int, int], turn: int, bins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(node reached, value there) of one tree; the nodes of its last level have no split yet."""
        node, value = np.zeros(len(bins), np.int64), np.zeros(len(bins))
        tree = self.splits.get(model, {}).get(turn, {})
        for k in sorted(tree):
            feature, b, left, right = tree[k]
            here = np.flatnonzero(node == k)
            low = bins[here, feature] <= b
            value[here] = np.where(low, left, right)
            node[here] = np.where(low, 2 * k + 1, 2 * k + 2)
        for k, v in self.leaves.get(model, {}).get(turn, {}).items():
            value[node == k] = v
        return node, value

    def predict(self, model: tuple[int, int], bins: np.ndarray, turns: range) -> np.ndarray:
        own = self.splits.get(model, {})
        return sum((self.walk(model, t, bins)[1] for t in turns if t in own), np.zeros(len(bins)))


def _fitted(m: Member, fold: Fold, patience: int, k: np.ndarray, y: np.ndarray, bins: np.ndarray, allowed: np.ndarray) -> list[tuple]:
    """The rows (turn, node, feature, bin, gain, left, right) of one model over the rows of its series, in order."""
    train, valid = k < fold.train, (k >= fold.valid) & (k < fold.end)
    if not train.any():
        return []
    base = float(np.quantile(y[train], m.alpha) if m.loss == "pinball" else y[train].mean())
    pred, best, out = np.full(len(y), base), (np.inf, 0), [(0, -2, -1, -1, 0.0, base, 0.0)]
    soft = lambda g: np.sign(g) * np.maximum(np.abs(g) - m.l1, 0)
    over = lambda a, h: np.divide(a, h + m.l2, out=np.full(a.shape, np.nan), where=h + m.l2 != 0)
    for turn in range(m.rounds + 1):  # the last turn only takes the loss
        if valid.any():
            lost = float(loss(m, y[valid], pred[valid]).mean())
            out.append((turn, -1, -1, -1, 0.0, lost, 0.0))
            best = min(best, (round(lost, 12), turn))
            if turn - best[1] >= patience:
                break
        if turn == m.rounds:
            break
        mine, use = np.flatnonzero(train & sampled_rows(m, turn, k)), sampled_columns(m, turn, allowed) if len(allowed) else allowed
        if not len(mine) or not len(use):
            continue
        grad, curve = gradient(m, y[mine], pred[mine])
        grad, curve = np.repeat(grad, len(use)), np.repeat(curve, len(use)) if m.loss == "qlike" else None
        cell = bins[np.ix_(mine, use)] + np.arange(len(use)) * BINS
        node, value, splits = np.zeros(len(y), np.int64), np.zeros(len(y)), 0
        for level in range(m.depth):
            first = (1 << level) - 1
            own = node[mine] - first
            front = own >= 0
            every = front.all()
            at = ((own * (len(use) * BINS))[:, None] + cell if every else (own[front] * (len(use) * BINS))[:, None] + cell[front]).ravel()
            part = slice(None) if every else np.repeat(front, len(use))
            size = 1 << level
            shape = (size, len(use), BINS)
            n = np.bincount(at, minlength=size * len(use) * BINS)
            g = np.bincount(at, grad[part], len(n))
            h = n.astype(float) if curve is None else np.bincount(at, curve[part], len(n))
            n1, g1, h1 = (np.cumsum(v.reshape(shape), axis=2) for v in (n, g, h))
            n0, g0, h0 = (v[:, :, -1:] for v in (n1, g1, h1))
            g2, h2 = g0 - g1, h0 - h1
            gain = np.round(over(soft(g1) ** 2, h1) + over(soft(g2) ** 2, h2) - over(soft(g0) ** 2, h0), 9)
            gain = np.where((n1 >= m.least) & (n0 - n1 >= m.least) & (gain > 0), gain, 0.0).reshape(size, -1)
            top = gain.argmax(axis=1)  # the first of equals: the smaller feature, then the smaller bin
            found = sorted((-gain[q, top[q]], q) for q in range(size) if gain[q, top[q]] > 0)[: m.leaves - 1 - splits]
            for less, q in found:
                j, b = divmod(int(top[q]), BINS)
                left, right = (float(np.nan_to_num(over(-soft(x[q, j, b : b + 1]) * m.rate, z[q, j, b : b + 1]))[0]) for x, z in ((g1, h1), (g2, h2)))
                here = np.flatnonzero(node == q + first)
                low = bins[here, use[j]] <= b
                value[here] = np.where(low, left, right)
                node[here] = 2 * (q + first) + np.where(low, 1, 2)
                out.append((turn, q + first, int(use[j]), b, -float(less), left, right))
            splits += len(found)
            if not found:
                break
        if m.loss == "pinball" and splits:
            for q in np.unique(node[mine]).tolist():
                leaf = float(np.quantile((y - pred)[mine[node[mine] == q]], m.alpha) * m.rate)
                value[node == q] = leaf
                out.append((turn, q, LEAF, -1, 0.0, leaf, 0.0))
        pred = pred + value
    return out


_FIELDS = ("fold", "member", "turn", "node", "feature", "bin", "left", "right")
_TREES = "symbol string, fold int, member int, turn int, node int, feature int, bin int, gain double, left double, right double"
_GROWN = "symbol string, fold int, member int, node int, feature int, bin int, g double, h double, n long"


@dataclass(frozen=True)
class Booster:
    """A fit of some members under a plan of folds. ``patience``: rounds without a better validation loss."""

    members: tuple[Member, ...]
    plan: Callable[[int], list[Fold]]
    patience: int = 60

    def fit(self, rows: DataFrame, allowed: DataFrame | None = None) -> DataFrame:
        """The trees of all models over packed rows; ``allowed`` (symbol, fold, features) limits a fold to some features.

        Rows: node >= 0 splits (bins up to ``bin`` go left; values include the rate), node -1 the validation loss
        before the round, node -2 the base.
        """
        trees, long = self._whole(rows.where(F.col("n") <= WHOLE), allowed), rows.where(F.col("n") > WHOLE)
        return trees if long.isEmpty() else trees.unionByName(self._by_level(long, allowed))

    def _whole(self, rows: DataFrame, allowed: DataFrame | None) -> DataFrame:
        """The trees of series of bounded length, a model to a group."""

        def planned(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for g in batches:
                yield pd.DataFrame([(symbol, f, m) for symbol, n in zip(g["symbol"], g["n"]) for f, m, _, _ in self._models(n)], columns=["symbol", "fold", "member"])

        def run(key: tuple, g: pd.DataFrame) -> pd.DataFrame:
            symbol, f, m = key
            blocks = [(np.frombuffer(r["k"], np.int64), np.frombuffer(r["y"], float), np.frombuffer(r["bins"], np.uint8)) for r in g.to_dict("records")]
            blocks.sort(key=lambda x: x[0][0])
            k, y, bins = np.concatenate([x[0] for x in blocks]), np.concatenate([x[1] for x in blocks]), np.concatenate([x[2].reshape(len(x[0]), -1) for x in blocks])
            limit = g["features"].iloc[0] if "features" in g else None
            fold = self.plan(int(g["n"].iloc[0]))[f]
            found = _fitted(self.members[m], fold, self.patience, k, y, bins, np.asarray(np.arange(bins.shape[1]) if limit is None else limit, np.int64))
            return pd.DataFrame([(symbol, f, m, *r) for r in found], columns=[c.split(" ")[0] for c in _TREES.split(", ")])

        models = rows.select("symbol", "n").distinct().mapInPandas(planned, "symbol string, fold int, member int")
        if allowed is not None:
            models = models.join(allowed.select("symbol", "fold", "features"), ["symbol", "fold"], "left")
        # A number of parts is named, as few bytes are much work here.
        both = rows.select("symbol", "n", "k", "bins", "y").join(models, "symbol")
        parts = 4 * rows.sparkSession.sparkContext.defaultParallelism
        return sinks.stored(both.repartition(parts, "symbol", "fold", "member").groupBy("symbol", "fold", "member").applyInPandas(run, _TREES), "trees")

    def _by_level(self, rows: DataFrame, allowed: DataFrame | None) -> DataFrame:
        """The trees of long series, whose rows no task holds together."""
        if allowed is not None:
            allowed = allowed.groupBy("symbol").agg(F.map_from_entries(F.collect_list(F.struct("fold", "features"))).alias("allowed"))
        done, state, since = [], rows, 0
        grown = self._base(rows)
        rounds = max(m.rounds for m in self.members)
        for turn in range(rounds + 1):  # the last turn only takes the losses
            for level in range(max((m.depth for m in self.members if turn < m.rounds), default=1)):
                grown = sinks.stored(grown.unionByName(self._level(state, grown, allowed, turn, level, since)), "trees")
            if any(m.loss == "pinball" and turn < m.rounds for m in self.members):
                grown = sinks.stored(grown.unionByName(self._refitted(state, grown, turn, since)), "trees")
            if (turn + 1) % RENEW == 0 and turn < rounds:
                if not self._going(grown, turn):
                    break
                done.append(grown.where("node >= 0"))
                state = sinks.stored(self._renewed(state, grown, since, turn + 1), "blocks")
                # What is needed further on: bases and losses, not the splits that the blocks' predictions hold.
                since, grown = turn + 1, sinks.stored(grown.where("node < 0"), "trees")
        for more in done:
            grown = grown.unionByName(more)
        return grown

    def _going(self, trees: DataFrame, turn: int) -> bool:
        """Whether a model is left that has had a best loss within the patience, or has no validation part."""
        models = trees.where("node < 0").groupBy("symbol", "fold", "member").agg(F.min(F.when(F.col("node") == -1, F.struct(F.round("left", 12).alias("l"), "turn")))["turn"].alias("best"))
        return not models.where(F.col("best").isNull() | (F.lit(turn) - F.col("best") < self.patience)).isEmpty()

    def _models(self, n: int) -> list[tuple[int, int, Fold, Member]]:
        return [(f, m, fold, member) for f, fold in enumerate(self.plan(n)) for m, member in enumerate(self.members)]

    def _base(self, rows: DataFrame) -> DataFrame:
        """The mean target of each fold's training part, or its quantile for a pinball loss."""

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for g in batches:
                out = []
                for symbol, n, k, y in zip(g["symbol"], g["n"], g["k"], g["y"]):
                    k, y = np.frombuffer(k, np.int64), np.frombuffer(y, float)
                    for f, fold in enumerate(self.plan(n)):
                        mine = y[k < fold.train]
                        if len(mine):
                            out.append((symbol, f, float(mine.sum()), len(mine), mine.tolist() if alphas else []))
                yield pd.DataFrame(out, columns=["symbol", "fold", "total", "n", "y"])

        alphas = sorted({m.alpha for m in self.members if m.loss == "pinball"})
        sums = rows.select("symbol", "n", "k", "y").mapInPandas(run, "symbol string, fold int, total double, n long, y array<double>")
        found = sums.groupBy("symbol", "fold").agg((F.sum("total") / F.sum("n")).alias("mean"))
        if alphas:
            own = sums.select("symbol", "fold", F.explode("y").alias("y")).groupBy("symbol", "fold").agg(*[F.percentile("y", F.lit(a)).alias(f"q{i}") for i, a in enumerate(alphas)])
            found = found.join(own, ["symbol", "fold"])
        parts = [F.struct(F.lit(m).alias("member"), F.col(f"q{alphas.index(x.alpha)}" if x.loss == "pinball" else "mean").alias("left")) for m, x in enumerate(self.members)]
        found = found.select("symbol", "fold", F.explode(F.array(*parts)).alias("z"))
        fixed = {"turn": 0, "node": -2, "feature": -1, "bin": -1, "gain": 0.0, "right": 0.0}
        columns = {"member": F.col("z.member"), "left": F.col("z.left")} | {c: F.lit(v) for c, v in fixed.items()}
        return sinks.stored(found.select("symbol", "fold", *[columns[c].alias(c) for c in ("member", "turn", "node", "feature", "bin", "gain", "left", "right")]), "trees")

    @staticmethod
    def _met(rows: DataFrame, trees: DataFrame) -> DataFrame:
        return rows.join(trees.groupBy("symbol").agg(F.collect_list(F.struct(*_FIELDS)).alias("trees")), "symbol")

    def _held(self, row: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, Trees]:
        k, y = np.frombuffer(row["k"], np.int64), np.frombuffer(row["y"], float)
        bins = np.frombuffer(row["bins"], np.uint8).reshape(len(k), -1)
        models = self._models(row["n"])
        pred = np.frombuffer(row["pred"], float).reshape(len(models), len(k)) if row["pred"] else np.zeros((len(models), len(k)))
        return k, y, bins, pred, Trees([tuple(t[c] for c in _FIELDS) for t in row["trees"]])

    def _level(self, state: DataFrame, trees: DataFrame, allowed: DataFrame | None, turn: int, level: int, since: int) -> DataFrame:
        """Splits of one level of one round, and at its first level the validation losses before the round."""

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for g in batches:
                found = []
                for row in g.to_dict("records"):
                    k, y, bins, pred, held = self._held(row)
                    limits = dict(row["allowed"]) if row.get("allowed") is not None else {}
                    parts: list[tuple] = []
                    for (f, m, fold, member), base in zip(self._models(row["n"]), pred):
                        if held.stopped((f, m), self.patience) or (f, m) not in held.base:
                            continue
                        now = base + held.base[f, m] + held.predict((f, m), bins, range(since, turn))
                        valid = (k >= fold.valid) & (k < fold.end)
                        if level == 0 and valid.any():
                            parts.append((f, m, [-1], [-1], [-1], [loss(member, y[valid], now[valid]).sum()], [0.0], [int(valid.sum())]))
                        if turn < member.rounds and level < member.depth:
                            mine = np.flatnonzero((k < fold.train) & sampled_rows(member, turn, k))
                            node = held.walk((f, m), turn, bins[mine])[0]
                            first = (1 << level) - 1
                            front = node >= first
                            mine, node = mine[front], node[front] - first
                            use = sampled_columns(member, turn, np.asarray(limits.get(f, np.arange(bins.shape[1])), np.int64))
                            if len(mine) and len(use):
                                grad, curve = gradient(member, y[mine], now[mine])
                                at = ((node[:, None] * len(use) + np.arange(len(use))) * BINS + bins[np.ix_(mine, use)]).ravel()
                                cells = (1 << level) * len(use) * BINS
                                n = np.bincount(at, minlength=cells)
                                some = np.flatnonzero(n)
                                g1, h1 = (np.bincount(at, np.repeat(v, len(use)), cells)[some] for v in (grad, curve))
                                parts.append((f, m, some // (len(use) * BINS) + first, use[some // BINS % len(use)], some % BINS, g1, h1, n[some]))
                    if parts:
                        size = [len(p[2]) for p in parts]
                        columns = {"symbol": row["symbol"], "fold": np.repeat([p[0] for p in parts], size), "member": np.repeat([p[1] for p in parts], size)}
                        found.append(pd.DataFrame(columns | {c: np.concatenate([p[i] for p in parts]) for i, c in enumerate(("node", "feature", "bin", "g", "h", "n"), 2)}))
                if found:  # blocks of a symbol that came together are added up before the shuffle
                    both = pd.concat(found)
                    yield both if len(found) == 1 else both.groupby(["symbol", "fold", "member", "node", "feature", "bin"], as_index=False).sum()

        both = self._met(state, trees)
        if allowed is not None:
            both = both.join(allowed, "symbol", "left")
        # Dealt by model once: sums, running sums and choices of a node are all found there.
        sums = both.mapInPandas(run, _GROWN).repartition("symbol", "fold", "member").groupBy("symbol", "fold", "member", "node", "feature", "bin").agg(F.sum("g").alias("g"), F.sum("h").alias("h"), F.sum("n").alias("n"))
        tight = any(m.leaves < 1 << min(m.depth, level + 1) for m in self.members)
        used = trees.where((F.col("turn") == turn) & (F.col("feature") >= 0)).groupBy("symbol", "fold", "member").agg(F.count(F.lit(1)).alias("used")) if tight else None
        return self._splits(sums, turn, used)

    def _splits(self, sums: DataFrame, turn: int, used: DataFrame | None) -> DataFrame:
        """The best split of each node with both sides large enough; members keep within their number of leaves."""
        own = lambda name: F.element_at(F.array(*[F.lit(float(getattr(m, name))) for m in self.members]), F.col("member") + 1)
        model = ("symbol", "fold", "member")
        feature = Window.partitionBy(*model, "node", "feature")
        run = feature.orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
        x = sums.select("*", *[F.sum(c).over(run).alias(f"{c}1") for c in "ghn"], *[F.sum(c).over(feature).alias(f"{c}0") for c in "ghn"])
        soft = lambda g: F.signum(g) * F.greatest(F.abs(g) - own("l1"), F.lit(0.0))
        score = lambda g, h: F.try_divide(soft(g) * soft(g), h + own("l2"))
        value = lambda g, h: F.coalesce(F.try_divide(-soft(g) * own("rate"), h + own("l2")), F.lit(0.0))
        g1, h1, g2, h2 = F.col("g1"), F.col("h1"), F.col("g0") - F.col("g1"), F.col("h0") - F.col("h1")
        gain = F.round(score(g1, h1) + score(g2, h2) - score(F.col("g0"), F.col("h0")), 9)
        is_loss = F.col("node") < 0
        x = x.withColumn("gain", gain).where(is_loss | ((F.col("n1") >= own("least")) & (F.col("n0") - F.col("n1") >= own("least")) & (F.col("gain") > 0)))
        best = x.groupBy(*model, "node").agg(F.max(F.struct("gain", (-F.col("feature")).alias("f"), (-F.col("bin")).alias("b"), F.when(is_loss, F.col("g") / F.col("n")).otherwise(value(g1, h1)).alias("left"), F.when(is_loss, F.lit(0.0)).otherwise(value(g2, h2)).alias("right"))).alias("z"))
        kept = best
        if used is not None:  # a tree has a leaf more than splits
            room = Window.partitionBy(*model, is_loss).orderBy(F.desc("z.gain"), "node")
            kept = best.join(used, list(model), "left").withColumn("place", F.row_number().over(room))
            kept = kept.where(is_loss | (F.col("place") + F.coalesce("used", F.lit(0)) < own("leaves")))
        return kept.select(*model, F.lit(turn).alias("turn"), "node", (-F.col("z.f")).alias("feature"), (-F.col("z.b")).alias("bin"), F.when(is_loss, F.lit(0.0)).otherwise(F.col("z.gain")).alias("gain"), F.col("z.left").alias("left"), F.col("z.right").alias("right"))

    def _refitted(self, state: DataFrame, trees: DataFrame, turn: int, since: int) -> DataFrame:
        """The leaves of this round's trees of pinball members: their rows' quantile of what is left, at the member's rate."""

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for g in batches:
                for row in g.to_dict("records"):
                    k, y, bins, pred, held = self._held(row)
                    for (f, m, fold, member), base in zip(self._models(row["n"]), pred):
                        if member.loss != "pinball" or turn not in held.splits.get((f, m), {}):
                            continue
                        mine = np.flatnonzero((k < fold.train) & sampled_rows(member, turn, k))
                        node = held.walk((f, m), turn, bins[mine])[0]
                        left = y[mine] - base[mine] - held.base[f, m] - held.predict((f, m), bins[mine], range(since, turn))
                        yield pd.DataFrame({"symbol": row["symbol"], "fold": f, "member": m, "node": node, "left": left})

        found = self._met(state, trees).mapInPandas(run, "symbol string, fold int, member int, node int, left double")
        quantiles = F.array(*[F.lit(float(m.alpha)) for m in self.members])
        rate = F.element_at(F.array(*[F.lit(m.rate) for m in self.members]), F.col("member") + 1)
        alphas = sorted({m.alpha for m in self.members if m.loss == "pinball"})
        values = found.groupBy("symbol", "fold", "member", "node").agg(F.percentile("left", F.array(*[F.lit(a) for a in alphas])).alias("q"))
        at = F.array_position(F.array(*[F.lit(float(a)) for a in alphas]), F.element_at(quantiles, F.col("member") + 1)).cast("int")
        return values.select("symbol", "fold", "member", F.lit(turn).alias("turn"), "node", F.lit(LEAF).alias("feature"), F.lit(-1).alias("bin"), F.lit(0.0).alias("gain"), (F.element_at("q", at) * rate).alias("left"), F.lit(0.0).alias("right"))

    def _renewed(self, state: DataFrame, trees: DataFrame, since: int, until: int) -> DataFrame:
        """Blocks whose predictions hold the rounds up to ``until``."""

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for g in batches:
                out = []
                for row in g.to_dict("records"):
                    _, _, bins, pred, held = self._held(row)
                    new = np.array([base + held.predict((f, m), bins, range(since, until)) for (f, m, _, _), base in zip(self._models(row["n"]), pred)])
                    out.append((row["symbol"], row["n"], row["k"], row["ts"], row["bins"], row["y"], new.tobytes()))
                yield pd.DataFrame(out, columns=[c.split(" ")[0] for c in _BLOCKS.split(", ")])

        return self._met(state, trees).mapInPandas(run, _BLOCKS)

    def predict(self, rows: DataFrame, trees: DataFrame) -> DataFrame:
        """symbol, ts_s, fold, member, pred of each fold's test rows, by the rounds up to the best of each model."""

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for g in batches:
                for row in g.to_dict("records"):
                    k, _, bins, _, held = self._held(row | {"pred": b""})
                    ts = np.frombuffer(row["ts"], np.int64)
                    for f, m, fold, member in self._models(row["n"]):
                        test = (k >= fold.test) & (k < fold.last)
                        if test.any() and (f, m) in held.base:
                            p = held.base[f, m] + held.predict((f, m), bins[test], range(min(member.rounds, held.best((f, m)))))
                            yield pd.DataFrame({"symbol": row["symbol"], "ts_s": ts[test], "fold": f, "member": m, "pred": p})

        return self._met(rows, trees).mapInPandas(run, "symbol string, ts_s long, fold int, member int, pred double")

    def importances(self, trees: DataFrame, features: list[str]) -> DataFrame:
        """symbol, fold, feature, splits: how often a feature splits in the rounds up to each model's best, on the mean of the members; features without a split too."""
        lost = trees.where("node = -1").groupBy("symbol", "fold", "member").agg(F.min(F.struct(F.round("left", 12), "turn"))["turn"].alias("best"))
        used = trees.where("feature >= 0").join(lost, ["symbol", "fold", "member"], "left").where(F.col("turn") < F.coalesce("best", F.lit(1 << 30)))
        counted = used.groupBy("symbol", "fold", "feature").agg((F.count(F.lit(1)) / len(self.members)).alias("splits"))
        names = F.array(*[F.struct(F.lit(i).alias("feature"), F.lit(c).alias("name")) for i, c in enumerate(features)])
        every = trees.where("node = -2").select("symbol", "fold").distinct().select("symbol", "fold", F.explode(names).alias("z")).select("symbol", "fold", "z.feature", "z.name")
        return every.join(counted, ["symbol", "fold", "feature"], "left").select("symbol", "fold", F.col("name").alias("feature"), F.col("feature").alias("place"), F.coalesce("splits", F.lit(0.0)).alias("splits"))
