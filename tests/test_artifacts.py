"""The artifact store, JSON files and identities of frames."""

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_boosting import FEATURES, table

from chronolith.operators import boosting as B
from chronolith.operators import evaluate
from chronolith.sources import artifacts


def test_half_a_version_is_never_seen(spark, tmp_path):
    store = artifacts.Store(spark, f"file://{tmp_path}/a")
    with pytest.raises(FileNotFoundError):
        store.load("t")
    df = spark.createDataFrame([(1, "x"), (2, None)], "k int, v string")
    assert store.save(df, "t", {"b": 1}) == 1 and store.save(df.limit(1), "t") == 2
    # Writers that died: data without a manifest, and a manifest that was not renamed.
    df.write.parquet(f"file://{tmp_path}/a/t/data-dead")
    (tmp_path / "a" / "t" / ".manifest-dead").write_text("{")
    assert store.versions("t") == [1, 2] and store.load("t").count() == 1
    assert sorted(map(tuple, store.load("t", 1).collect())) == [(1, "x"), (2, None)] and store.manifest("t", 1)["notes"] == {"b": 1}
    with pytest.raises(FileNotFoundError):
        store.load("t", 7)
    # A number that another writer takes meanwhile is passed over.
    own = store.versions
    store.versions = lambda name: [v for v in own(name) if v != 2]
    assert store.save(df, "t") == 3
    store.versions = own
    assert store.load("t").count() == 2
    assert store.migrate({"t": "new/t", "gone": "x"}) == ["t"] and store.load("new/t", 1).count() == 2 and store.versions("t") == []
    store.save(df, "t")
    assert store.migrate({"t": "new/t"}) == [] and store.versions("t") == [1]


def test_models_come_back(spark, tmp_path):
    store = artifacts.Store(spark, f"file://{tmp_path}")
    members = (B.Member(2, 0.3, 4, 2, 12, loss="huber"),)
    rows = B.blocks(spark.createDataFrame(table(sizes=(("X", 300),)), "symbol string, ts timestamp, a double, b double, c double, d double, y double"), FEATURES, "y", 200)
    plan = B.expanding(200, 5)
    trees = B.Booster(members, plan).fit(rows)
    store.save_model(trees, "m", members, FEATURES, target="y")
    back, same, names = store.load_model("m")
    assert same == members and names == FEATURES and store.manifest("m")["notes"]["target"] == "y"
    got, want = ({(r.ts_s, r.fold): r.pred for r in B.Booster(same, plan).predict(rows, t).collect()} for t in (back, trees))
    assert got and got == want


def test_pretty_json(spark):
    row = spark.range(1).select(artifacts.pretty({"b": F.lit(1.5), "a": F.lit('q"\n'), "n": F.lit(None).cast("int"), "c": F.array(F.lit(1))}).alias("j")).first()
    assert row.j == '{\n  "a": "q\\"\\n",\n  "b": 1.5,\n  "c": [1],\n  "n": null\n}'


def test_identity_of_frames(spark):
    g = np.random.default_rng(1)
    rows = [(s, k, float(g.normal()), None if k % 7 == 0 else "v") for s in "ab" for k in range(50)] + [("a", 60, float("nan"), "v"), ("a", 61, float("inf"), "v"), ("a", 62, -0.0, "v"), ("a", 62, -0.0, "v")]
    schema = "s string, k int, x double, v string"
    base = evaluate.digests(spark.createDataFrame(rows, schema), "s")
    other = [rows[i] for i in g.permutation(len(rows))]
    status = lambda now: {r.s: r.status for r in evaluate.identity(evaluate.digests(spark.createDataFrame(now, schema), "s"), base, "s").collect()}
    assert status(other) == {"a": "SAME RUN", "b": "SAME RUN"}
    assert status([(s, k, x + (1e-3 if (s, k) == ("b", 9) else 0), v) for s, k, x, v in other]) == {"a": "SAME RUN", "b": "DIFFERENT RUN"}
    assert status([r for r in other if r[0] == "a"][1:] + [("c", 1, 1.0, "v")]) == {"a": "DIFFERENT RUN", "b": "MISSING", "c": "MISSING"}
