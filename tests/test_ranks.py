"""Quantiles by refinement against sorted values."""

import numpy as np
import pytest

from chronolith.operators import ranks

SHARES = (0.0, 0.1, 0.5, 0.9, 1.0)


def groups():
    g = np.random.default_rng(1)
    heavy = np.exp(g.normal(0, 6, 700))  # most values in the first bucket
    ties = np.round(g.normal(size=500), 1)
    return {"heavy": heavy, "ties": ties, "one": np.array([3.0]), "same": np.full(40, -2.5), "two": np.array([1.0, 1e300]), "negative": -heavy[:333]}


@pytest.mark.parametrize("buckets,passes", [(256, 3), (4, 2)])
def test_quantiles_equal_sorted(spark, monkeypatch, buckets, passes):
    monkeypatch.setattr(ranks, "BUCKETS", buckets)
    monkeypatch.setattr(ranks, "PASSES", passes)
    g, parts = np.random.default_rng(2), groups()
    weights = {k: np.round(g.uniform(0, 9, len(v))) for k, v in parts.items()}
    weights["one"][:] = 2
    weights["two"][:] = 1
    rows = [(k, float(x), float(w)) for k, v in parts.items() for x, w in zip(v, weights[k])] + [("ties", None, 1.0), ("ties", float("nan"), 5.0), ("none", None, 1.0)]
    df = spark.createDataFrame(rows, "k string, x double, w double").repartition(3)
    plain = {(r.k, r.share): (r.n, r.q) for r in ranks.quantiles(df, "x", SHARES, "k").collect()}
    weighed = {(r.k, r.share): r.q for r in ranks.weighted_quantiles(df, "x", "w", SHARES[1:], "k").collect()}
    assert set(plain) == {(k, q) for k in parts for q in SHARES}
    for k, v in parts.items():
        order = np.argsort(v, kind="stable")
        x, cum = v[order][weights[k][order] > 0], np.cumsum(weights[k][order][weights[k][order] > 0])
        for q in SHARES:
            assert plain[k, q] == (len(v), pytest.approx(np.quantile(v, q), rel=1e-12))
            if q:
                assert weighed[k, q] == x[np.searchsorted(cum, q * cum[-1], side="left")]
    assert ranks.quantiles(df.limit(0), "x", (0.5,), "k").count() == 0 and ranks.weighted_quantiles(df.limit(0), "x", "w", (0.5,), "k").count() == 0
