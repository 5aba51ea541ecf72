"""Boosted trees grown by Spark against a plain booster on the same rows."""

import collections

import numpy as np
import pandas as pd
import pytest

from chronolith.operators import boosting as B

FEATURES = ["a", "b", "c", "d"]


def table(seed=1, sizes=(("X", 420), ("Y", 700), ("Z", 40))):
    g = np.random.default_rng(seed)
    rows = []
    for symbol, n in sizes:
        x = g.normal(size=(n, 4))
        y = np.where(x[:, 0] > 0.3, 0.4, 0.0) + 0.3 * np.sin(2 * x[:, 1]) + 0.1 * g.normal(size=n) + 0.5
        for k in range(n):
            v = [float(z) for z in x[k]]
            if k % 97 == 5:
                v[k % 4] = [None, float("nan"), float("inf")][k % 3]
            rows.append((symbol, pd.Timestamp("2020-01-01") + pd.Timedelta(hours=k), *v, None if k % 101 == 7 else float(y[k])))
    g.shuffle(rows)
    return [(s, t.to_pydatetime(), *r) for s, t, *r in rows]


def clean(v):
    return 0.0 if v is None or not np.isfinite(v) else v


def plain(booster, x, y, shared, allowed=None):
    """One model after the other, one node after the other."""
    cuts = [np.unique(np.quantile(x[:shared, j], np.arange(1, B.BINS) / B.BINS)) for j in range(x.shape[1])]
    bins = np.column_stack([np.searchsorted(c, x[:, j]) for j, c in enumerate(cuts)])
    k = np.arange(len(y))
    out, used = {}, collections.Counter()
    for f, fold in enumerate(booster.plan(len(y))):
        for m, member in enumerate(booster.members):
            train = k < fold.train
            base = np.quantile(y[train], member.alpha) if member.loss == "pinball" else y[train].mean()
            pred, losses, trees, steps = np.full(len(y), base), [], [], []
            soft = lambda s: np.sign(s) * max(abs(s) - member.l1, 0)  # noqa: B023, E731
            for turn in range(member.rounds + 1):
                if fold.end > fold.valid:
                    losses.append(round(float(B.loss(member, y[fold.valid : fold.end], pred[fold.valid : fold.end]).mean()), 12))
                    best = int(np.argmin(losses))
                    if turn - best >= booster.patience:
                        break
                if turn == member.rounds:
                    break
                grad, curve = B.gradient(member, y, pred)
                rows = train & B.sampled_rows(member, turn, k)
                use = B.sampled_columns(member, turn, np.asarray(allowed[f] if allowed else range(x.shape[1]), np.int64))
                node, value, splits = np.zeros(len(y), int), np.zeros(len(y)), []
                for level in range(member.depth):
                    found = []
                    for q in sorted(set(node[rows & (node >= (1 << level) - 1)].tolist())):
                        here = rows & (node == q)
                        best_of = None
                        for j in use.tolist():
                            for b in range(B.BINS):
                                lo, hi = here & (bins[:, j] <= b), here & (bins[:, j] > b)
                                if lo.sum() < member.least or hi.sum() < member.least:
                                    continue
                                s = [(grad[z].sum(), curve[z].sum()) for z in (lo, hi, here)]
                                p = [soft(g) ** 2 / (h + member.l2) for g, h in s]
                                gain = round(p[0] + p[1] - p[2], 9)
                                if gain > 0 and (best_of is None or (gain, -j, -b) > best_of[0]):
                                    best_of = ((gain, -j, -b), q, *[-soft(g) * member.rate / (h + member.l2) for g, h in s[:2]])
                        if best_of:
                            found.append(best_of)
                    found = sorted(found, key=lambda z: (-z[0][0], z[1]))[: member.leaves - 1 - len(splits)]
                    for (_, j, b), q, left, right in found:
                        at, lo = node == q, bins[:, -j] <= -b
                        value[at] = np.where(lo[at], left, right)
                        node[at] = np.where(lo[at], 2 * q + 1, 2 * q + 2)
                        splits.append(-j)
                if member.loss == "pinball" and splits:
                    for q in set(node[rows].tolist()):
                        value[node == q] = member.rate * np.quantile((y - pred)[rows & (node == q)], member.alpha)
                pred = pred + value
                trees.append(value)
                steps.append(splits)
            stop = int(np.argmin(losses)) if losses else len(trees)
            test = (k >= fold.test) & (k < fold.last)
            out.update({(int(i), f, m): base + sum(t[i] for t in trees[:stop]) for i in k[test]})
            used.update((f, j) for s in steps[:stop] for j in s)
    return out, {key: v / len(booster.members) for key, v in used.items()}


def test_equals_plain_booster(spark, monkeypatch):
    allowed = {0: [0, 2], 1: [0, 1, 3]}
    monkeypatch.setattr(B, "BLOCK", 150)
    monkeypatch.setattr(B, "RENEW", 2)
    members = (
        B.Member(4, 0.3, 5, 3, 12, 0.75, 0.75, 0.15, 0.15, 42),
        B.Member(3, 0.2, 4, 2, 20, 0.7, 0.5, 0.3, 0.3, 123, loss="huber"),
        B.Member(3, 0.2, 31, 2, 15, seed=3, loss="pinball", alpha=0.75),
    )
    booster = B.Booster(members, lambda n: B.expanding(250, 5, most=2)(n), patience=2)
    rows = table()
    df = spark.createDataFrame(rows, "symbol string, ts timestamp, a double, b double, c double, d double, y double").repartition(3)
    held = B.blocks(df, FEATURES, "y", 250)
    limits = spark.createDataFrame([(s, f, a) for s in "XYZ" for f, a in allowed.items()], "symbol string, fold int, features array<int>") if allowed else None
    trees = booster.fit(held, limits)
    got = {(r.symbol, r.ts_s, r.fold, r.member): r.pred for r in booster.predict(held, trees).collect()}
    splits = {(r.symbol, r.fold, r.feature): r.splits for r in booster.importances(trees, FEATURES).collect()}
    want, shares = {}, {}
    for symbol in "XYZ":
        mine = sorted((r for r in rows if r[0] == symbol and r[6] is not None), key=lambda r: r[1])
        x, y = np.array([[clean(v) for v in r[2:6]] for r in mine]), np.array([r[6] for r in mine])
        pred, used = plain(booster, x, y, 250, allowed)
        seconds = [int(pd.Timestamp(r[1]).timestamp()) for r in mine]
        want |= {(symbol, seconds[i], f, m): p for (i, f, m), p in pred.items()}
        shares |= {(symbol, f, FEATURES[j]): v for (f, j), v in used.items()}
    assert want and set(got) == set(want) and not any(k[0] == "Z" for k in got)
    assert all(abs(got[k] - want[k]) < 1e-9 for k in want)
    assert {k: v for k, v in splits.items() if v} == pytest.approx(shares)


def test_no_rows(spark):
    df = spark.createDataFrame([], "symbol string, ts timestamp, a double, y double")
    booster = B.Booster((B.Member(2, 0.1, 4, 2, 5),), B.probes())
    held = B.blocks(df, ["a"], "y", 100)
    trees = booster.fit(held)
    assert booster.predict(held, trees).count() == 0 and booster.importances(trees, ["a"]).count() == 0


def test_whole_and_by_level_grow_the_same_trees(spark, monkeypatch):
    monkeypatch.setattr(B, "BLOCK", 150)
    members = (
        B.Member(4, 0.3, 5, 3, 12, 0.75, 0.75, 0.15, 0.15, 42),
        B.Member(3, 0.2, 6, 4, 20, 0.7, 0.5, 0.3, 0.3, 123, loss="qlike"),
        B.Member(2, 0.2, 31, 2, 15, seed=3, loss="pinball", alpha=0.75),
    )
    booster = B.Booster(members, lambda n: B.expanding(250, 5, most=2)(n) + B.probes()(n), patience=9)
    df = spark.createDataFrame(table(), "symbol string, ts timestamp, a double, b double, c double, d double, y double").repartition(3)
    held = B.blocks(df, FEATURES, "y", 250)
    limits = spark.createDataFrame([(s, f, [0, 1, 3]) for s in "XYZ" for f in range(6)], "symbol string, fold int, features array<int>")
    found = []
    for most in (0, 500, 50_000):  # all by level; Y by level; none
        monkeypatch.setattr(B, "WHOLE", most)
        rows = [r for r in booster.fit(held, limits).collect() if r.turn <= members[r.member].rounds]  # by level a loss comes again after a member's own rounds
        found.append({tuple(r[:5]): (r.feature, r.bin, r.gain, r.left, r.right) for r in rows})
        assert len(found[-1]) == len(rows) > 100
    assert {k: v[:2] for k, v in found[0].items() if v[0] != B.LEAF} == {k: v[:2] for k, v in found[2].items() if v[0] != B.LEAF} and set(found[1]) == set(found[0]) == set(found[2])
    for other in found[1:]:
        assert all(other[k] == pytest.approx(v, abs=1e-8) for k, v in found[0].items())


def test_all_rounds_in_a_few_jobs(spark):
    """A full probe: 150 rounds took 450 jobs."""
    df = spark.createDataFrame(table(), "symbol string, ts timestamp, a double, b double, c double, d double, y double")
    held = B.blocks(df, FEATURES, "y", 250)
    spark.sparkContext.setJobGroup("rounds", "rounds")
    trees = B.Booster((B.PROBE,), B.probes()).fit(held)
    jobs = len(spark.sparkContext.statusTracker().getJobIdsForGroup("rounds"))
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    turns = {r[0] for r in trees.where("node >= 0").select("turn").distinct().collect()}
    assert max(turns) > 100 and jobs < 20
