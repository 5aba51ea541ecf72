"""Custom aliases at the size where pairs repeat and are as short as a letter: equal to their SQL, made of the parts that they need."""

import duckdb

from chronolith.plans import instruments, registry

NAME = "t14_custom_aliases"
#: Numbers of parts whose pairs are one to three letters long.
SHORT = "(chr(CAST(65 + i % 26 AS INT)) || chr(CAST(65 + i // 26 % 26 AS INT)) || chr(CAST(65 + i // 676 % 26 AS INT)) || chr(CAST(65 + i // 17576 % 26 AS INT)))"


def parts(folder) -> duckdb.DuckDBPyConnection:
    db = duckdb.connect()
    found = f"SELECT i AS p_partkey FROM range(4000000) r(i) WHERE {SHORT} IN ('USDT', 'AUSD', 'ZRUB', 'SEUR') OR i < 500"
    db.execute(f"COPY ({found}) TO '{folder}/part.parquet' (FORMAT parquet)")
    db.execute(f"CREATE VIEW part AS SELECT * FROM '{folder}/part.parquet'")
    return db


def test_aliases_of_short_pairs_equal_their_sql(spark, tmp_path):
    db = parts(tmp_path)
    want = sorted(db.execute(f"SELECT alias, ticker, quote, error, source FROM ({registry.oracle_sql()[NAME]})").fetchall(), key=repr)
    got = sorted(map(tuple, registry.queries()[NAME](spark, str(tmp_path)).select("alias", "ticker", "quote", "error", "source").collect()), key=repr)
    assert got == want and any(len(alias) == 1 and ticker.endswith("=X") for alias, ticker, *_ in want)


def test_only_parts_that_name_an_instrument_are_parsed(spark, tmp_path, monkeypatch):
    parts(tmp_path)
    kept = []
    stored = instruments.sinks.stored
    monkeypatch.setattr(instruments.sinks, "stored", lambda df, name: (kept.append((name, stored(df, name))), kept[-1][1])[1])
    registry.queries()[NAME](spark, str(tmp_path))
    symbols = dict(kept)["symbols"]
    assert {k % 7 for (k,) in symbols.select("k").collect()} == {0, 3}
