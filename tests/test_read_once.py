"""Queries that use a derived table several times derive it once, on all cores."""

import os

import duckdb
import numpy as np
import pytest

from chronolith.plans import evaluate, instruments, registry

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


def test_symbols_are_parsed_on_all_cores(spark):
    x = instruments.symbols(spark, SF)
    assert x.rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism


@pytest.mark.parametrize("name", ["t13_resolve_instrument", "t14_custom_aliases"])
def test_symbols_are_parsed_once(spark, name):
    read = registry.queries()[name](spark, SF).inputFiles()
    assert read and not any("part.parquet" in f for f in read)


def test_policy_application_reads_trades_once_and_equals_its_sql(spark):
    """Scores of figures at six decimals, to the sixth decimal; trades are read for the bars alone."""
    db = duckdb.connect()
    db.execute(f"CREATE VIEW lineitem AS SELECT * FROM '{SF}/lineitem.parquet'")
    want = db.execute(registry.oracle_sql()["m22_policy_application"]).df().sort_values(["symbol", "ts_s"])
    df = registry.queries()["m22_policy_application"](spark, SF)
    assert not any("lineitem.parquet" in f for f in df.inputFiles())
    got = df.toPandas().sort_values(["symbol", "ts_s"])
    assert np.abs(got.policy_score.to_numpy() - want.policy_score.to_numpy()).max() < 5e-7


def test_wide_lane_is_made_once(spark):
    """Every job of a selection reads the stored lane, not the trades or the bars."""
    x, names = evaluate.wide_lane(spark, SF)
    assert len(names) == 89 and x.inputFiles() and all("/lane-" in f for f in x.inputFiles())
