"""Selection inside folds against a plain version: correlations, probe ranks, fused ranks, votes; and the quantile plan."""

import collections

import numpy as np
import pandas as pd
import pytest
from test_boosting import plain

from chronolith.operators import boosting as B
from chronolith.operators import models
from chronolith.operators import selection as S

NAMES = ["a_w3_", "b_w8_", "c", "d_w5_", "e", "flat"]


def rows(symbol, n, seed):
    g = np.random.default_rng(seed)
    x = g.normal(size=(n, 6))
    x[:, 1] = x[:, 0] + 0.1 * g.normal(size=n)  # b goes with a
    x[:, 3] = np.where(np.arange(n) < 230, x[:, 2], x[:, 3])  # d goes with c at first
    x[:, 5] = 4.0
    y = np.where(x[:, 0] > 0, 0.5, 0) + 0.3 * x[:, 4] + 0.05 * g.normal(size=n)
    z = x[:, 2] * 0.4 + np.where(x[:, 4] > 0.5, 0.3, 0)
    return [(symbol, pd.Timestamp("2020-01-01").to_pydatetime() + pd.Timedelta(hours=k), *map(float, x[k]), float(y[k]), float(z[k]) if k else None) for k in range(n)]


SCHEMA = "symbol string, ts timestamp, " + ", ".join(f"{c} double" for c in NAMES) + ", y double, z double"


def plain_ranks(x, y, ends, kept, probe, shared):
    """Position of each feature in each fold."""
    out = {}
    for f, e in enumerate(ends):
        step = e // 6
        score = collections.Counter()
        if e >= 300 and step >= 50:
            folds = [B.Fold(step * k, step * k, step * k, len(y), len(y)) for k in range(1, 6)]
            _, used = plain(B.Booster((probe,), lambda n: folds), x, y, shared, dict.fromkeys(range(5), kept[f]))  # noqa: B023
            for (_, j), v in used.items():
                score[j] += v / 5
        out[f] = {j: k for k, j in enumerate(sorted(kept[f], key=lambda j: (-round(score[j], 9), j)))}  # noqa: B023
    return out


def test_consensus_equals_plain(spark):
    data = rows("X", 480, 1) + rows("Y|1", 460, 2) + rows("Z", 90, 3)
    df = spark.createDataFrame(data, SCHEMA).repartition(3)
    probe = B.Member(2, 0.3, 4, 2, 10, 0.8, 0.8, 0.1, 0.1, 42)
    got = S.fold_consensus(df, NAMES, ("y", "z"), 250, 5, most=2, probe=probe, budget=3).collect()
    want = []
    for symbol in ("X", "Y|1"):
        mine = [r for r in data if r[0] == symbol and r[-1] is not None]
        x = np.array([r[2:8] for r in mine])
        ends = [f.end for f in B.expanding(250, 5, most=2)(len(mine))]
        kept = []
        for e in ends:
            with np.errstate(all="ignore"):
                m = np.abs(np.nan_to_num(np.corrcoef(x[:e].T)))
            gone = set()
            for j in range(6):
                for i in range(j):
                    if m[i, j] > 0.8 and not {i, j} & gone:
                        window = {0: 3, 1: 8, 3: 5}
                        gone.add(j if window.get(j, 0) >= window.get(i, 0) else i)
            kept.append([j for j in range(6) if j not in gone])
        assert kept[0] != kept[1] and 1 not in kept[0]
        votes, first = collections.Counter(), {}
        ranks = [plain_ranks(x, np.array([r[t] for r in mine]), ends, kept, probe, 250) for t in (-2, -1)]
        for f in range(len(ends)):
            fused = sorted(ranks[0][f], key=lambda j: (np.mean([r[f][j] for r in ranks]), NAMES[j]))[:3]  # noqa: B023
            for k, j in enumerate(fused):
                votes[j] += 1
                first.setdefault(j, (f, k))
        chosen = sorted((j for j in votes if votes[j] >= max(1, len(ends) // 2)), key=lambda j: (-votes[j], first[j]))[:3]  # noqa: B023
        want += [(symbol, k + 1, NAMES[j], votes[j]) for k, j in enumerate(chosen)]
    assert sorted(map(tuple, got)) == sorted(want)


def test_pipeline_takes_any_walk_forward(spark):
    df = spark.createDataFrame(rows("X", 330, 4), SCHEMA)
    probe = B.Member(1, 0.3, 4, 2, 10)
    seen = []

    def own(frame, allowed):
        seen.append(sorted(allowed.first().features))
        return spark.createDataFrame([("X", c, float(ord(c[0]))) for c in NAMES], "symbol string, feature string, importance double")

    got = S.pipeline(df, NAMES, "y", 250, probe, own, budget=2).orderBy("rank").collect()
    assert len(seen) == 1 and {0, 2, 4, 5} <= set(seen[0]) and 1 not in seen[0] and [(r.rank, r.feature) for r in got] == [(1, "flat"), (2, "e")]


def test_uncorrelated_names_windows():
    m = np.eye(4)
    m[2, 0] = m[0, 2] = 0.9
    m[3, 2] = m[2, 3] = -0.95
    assert S.uncorrelated(m, ["x_w13_a", "y", "x_w5_a", "z"]) == [1, 3]
    assert S.uncorrelated(np.eye(0), []) == []


@pytest.mark.parametrize("depth", [1, 3])
def test_trade_plan(spark, depth):
    g = np.random.default_rng(5)
    n = 700
    x = g.uniform(-1, 1, size=(n, 2))
    up = g.random(n) < 0.6
    move = 1 + (x[:, 0] > 0) * (x[:, 1] > 0) * 2 + g.exponential(0.3, n)
    table = [("S", pd.Timestamp("2021-01-01").to_pydatetime() + pd.Timedelta(days=k), *map(float, x[k]), 0.8 if up[k] else 0.2, *[float(move[k])] * 4) for k in range(n)]
    table += [("few", pd.Timestamp("2021-01-01").to_pydatetime() + pd.Timedelta(days=k), 0.0, 0.0, 0.8, 1.0, 1.0, 1.0, 1.0) for k in range(60)]
    df = spark.createDataFrame(table, "symbol string, ts timestamp, a double, b double, target double, long_mae_atr double, long_mfe_atr double, short_mae_atr double, short_mfe_atr double")
    got = models.trade_plan(df, ["a", "b"], spec=B.Member(4, 0.3, 8, depth, 15, loss="pinball"), patience=9).toPandas()
    assert set(got.symbol) == {"S"} and got.up_stop_atr.notna().sum() == len(got) - got.down_stop_atr.notna().sum()
    known = got[got.up_tp1_atr.notna()]
    assert (known.up_tp2_atr >= known.up_tp1_atr).all() and len(known) == up.sum() - int(up.sum() * 0.7)
    when = {int(pd.Timestamp(r[1], tz="UTC").timestamp()): r[6] for r in table if r[0] == "S"}
    e = np.array([when[t] for t in known.ts_s]) - known.up_tp2_atr.to_numpy()
    _LOSS[depth] = np.where(e > 0, 0.75 * e, -0.25 * e).mean()
    if len(_LOSS) == 2:
        assert _LOSS[3] < _LOSS[1]


_LOSS: dict[int, float] = {}


@pytest.mark.parametrize("name,members,folds", [("m7_probe_ranking", [(B.PROBE,)], [5]), ("m8_selection_pipeline", [(B.PROBE,), B.ENSEMBLE], [5, 6]), ("m9_consensus_selection", [(B.PROBE,)], [40])])
def test_queries_run_whole_members(spark, monkeypatch, name, members, folds):
    from chronolith.plans import evaluate, policy, registry

    seen, targets = [], []
    none = spark.createDataFrame([], "symbol string, ts timestamp, a double, " + ", ".join(f"{t} double" for t in evaluate.VOL[:4]))
    for module in (evaluate, policy):
        monkeypatch.setattr(module, "wide_lane", lambda *_: (none, ["a"]))
    fit, ranked = B.Booster.fit, S.ranked
    monkeypatch.setattr(B.Booster, "fit", lambda self, *args: seen.append((self.members, len(self.plan(3000)))) or fit(self, *args))
    monkeypatch.setattr(S, "ranked", lambda df, features, t, *args, **how: targets.append(len(t)) or ranked(df, features, t, *args, **how))
    assert registry.queries()[name](spark, "").count() == 0
    assert seen == list(zip(members, folds)) and targets == [4 if name.startswith("m9") else 1]
