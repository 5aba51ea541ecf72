"""Instruments: registry lookup, identity, resolution, custom aliases and payloads, as joins to tables.

A registry is a table (pair, asset_class, exchange, source_symbol, kind, quote), unique by
(pair, asset_class) and by (exchange, source_symbol). Known instruments are a table (alias,
ticker, quote), unique by alias. Both are broadcast while they are counted to be small.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronolith.functions import symbols as S
from chronolith.functions.exprs import col, settled

#: Rows up to which a table is broadcast.
SMALL = 200_000


def sized(table: DataFrame) -> DataFrame:
    return F.broadcast(table) if table.limit(SMALL + 1).count() <= SMALL else table


def named(df: DataFrame, raw: str = "raw") -> DataFrame:
    """Adds exchange, source_symbol, kind, quote, pair and asset_class of a symbol such as EXCHANGE:PAIRQUOTE."""
    exchange, rest = S.split_exchange(raw)
    x = settled(df.withColumns({"exchange": exchange, "source_symbol": S.normal(rest, "A-Z0-9!._")}))
    kind, _, root = S.contract(F.col("source_symbol"))
    x = settled(x.withColumns({"kind": kind, "__root": root}))
    pair, quote = S.pair_and_quote(F.col("__root"))
    return settled(x.withColumns({"pair": pair, "quote": quote, "asset_class": S.asset_class(F.col("kind"))}).drop("__root"))


def looked_up(x: DataFrame, registry: DataFrame) -> DataFrame:
    """Adds ``by_pair`` and ``by_source``: the registry's row of the same (pair, asset class), and of the same source.

    A symbol without an exchange has the source's row if only one exchange lists that symbol.
    """
    row = F.struct("pair", "asset_class", "exchange", "source_symbol", "kind", "quote")
    pairs = registry.select("pair", "asset_class", row.alias("by_pair"))
    places = registry.select("exchange", "source_symbol", row.alias("__place"))
    single = registry.groupBy("source_symbol").agg(F.count(F.lit(1)).alias("n"), F.min(row).alias("__only")).where("n = 1").drop("n")
    for table, keys in ((pairs, ["pair", "asset_class"]), (places, ["exchange", "source_symbol"]), (single, ["source_symbol"])):
        x = x.join(sized(table), keys, "left")
    return x.withColumn("by_source", F.coalesce("__place", F.when(F.col("exchange").isNull(), F.col("__only")))).drop("__place", "__only")


def covered(x: DataFrame, registry: DataFrame) -> DataFrame:
    """Registry columns instead of parsed ones where the registry covers a row, ``registry_covered``, and ``error``.

    A pair that the registry covers must come from the registry's own source; the error names both.
    """
    x = looked_up(x, registry)
    same = (F.col("source_symbol") == F.col("by_pair.source_symbol")) & (F.col("exchange").isNull() | (F.col("exchange") == F.col("by_pair.exchange")))
    entry = F.coalesce("by_source", F.when(same, F.col("by_pair")))
    source = lambda e, s: F.concat(F.coalesce(F.concat(e, F.lit(":")), F.lit("")), s)
    wrong = F.concat_ws(" ", F.lit("expected"), source(F.col("by_pair.exchange"), F.col("by_pair.source_symbol")), F.lit("received"), source(F.col("exchange"), F.col("source_symbol")))
    parsed = F.struct("pair", "asset_class", "exchange", "source_symbol", "kind", "quote")
    # One struct for a row's outcome: several aliases of branches over joined columns would multiply the optimizer's constraints.
    row = F.coalesce(entry, parsed)
    row = F.struct(*[row[c].alias(c) for c in ("pair", "asset_class", "exchange", "source_symbol", "kind")], F.coalesce(row["quote"], F.col("quote")).alias("quote"), F.when(F.col("by_pair").isNotNull() & entry.isNull(), wrong).alias("error"), (entry.isNotNull() | F.col("by_pair").isNotNull()).alias("registry_covered"))
    others = [c for c in x.columns if c not in ("pair", "asset_class", "exchange", "source_symbol", "kind", "quote", "by_pair", "by_source")]
    return x.select(*others, row.alias("__row")).select(*others, "__row.*")


def identities(x: DataFrame, alias: str = "raw", pair: str = "pair") -> DataFrame:
    """canonical, aliases (sorted, the canonical one included) and artifact_prefix of each instrument."""
    x = x.select(S.canonical(F.col(pair)).alias("canonical"), F.upper(F.trim(col(alias))).alias("alias"))
    g = x.groupBy("canonical").agg(F.collect_set("alias").alias("a"))
    return g.select("canonical", F.sort_array(F.array_union("a", F.array("canonical"))).alias("aliases"), F.replace(F.lower("canonical"), F.lit(" "), F.lit("_")).alias("artifact_prefix"))


def ticker_of(raw: Column | str) -> Column:
    """The ticker of a request, without a provider's name before a colon."""
    token = F.trim(col(raw))
    return F.when(F.upper(token).startswith("YAHOO:"), F.trim(F.substring(token, F.lit(7), F.length(token)))).otherwise(token)


def quote_of(ticker: Column, shortest: int = 6) -> Column:
    """Quote currency of a ticker: behind the last dash, or the last three letters of a currency pair (of ``shortest`` letters at least) ending in =X."""
    token = F.upper(F.trim(ticker))
    pair = F.substring(token, F.lit(1), F.length(token) - 2)
    dash = F.nullif(F.trim(F.substring_index(token, "-", -1)), F.lit(""))
    return F.when(token.contains("-"), dash).when(token.endswith("=X") & pair.rlike(f"^[A-Z]{{{shortest},}}$"), F.right(pair, F.lit(3)))


def registered(specs: DataFrame, builtin: DataFrame, shortest: int = 6) -> DataFrame:
    """alias, ticker, quote, error of new aliases (alias, ticker): a known alias can't be given another ticker. ``shortest``: see ``quote_of``."""
    known = sized(builtin.select("alias", F.col("ticker").alias("__known")))
    clean = specs.select(F.upper(F.trim("alias")).alias("alias"), ticker_of("ticker").alias("ticker"))
    x = clean.join(known, "alias", "left").withColumn("quote", quote_of(F.col("ticker"), shortest))
    empty = (F.coalesce("alias", F.lit("")) == "") | (F.coalesce("ticker", F.lit("")) == "")
    error = F.when(empty, "empty").when(F.col("__known").isNotNull() & (F.upper("__known") != F.upper("ticker")), F.concat(F.lit("known as "), F.col("__known")))
    return x.withColumn("error", error).drop("__known")


def listed(builtin: DataFrame, custom: DataFrame) -> DataFrame:
    """alias, ticker, source of all instruments; an alias of both is listed as the custom one."""
    own = custom.where("error is null").select("alias", "ticker", F.lit("custom").alias("source"))
    return builtin.select("alias", "ticker", F.lit("builtin").alias("source")).join(own.select("alias"), "alias", "left_anti").unionByName(own)


def resolved(requests: DataFrame, builtin: DataFrame, custom: DataFrame, raw: str = "raw") -> DataFrame:
    """Adds base, ticker, quote and found (builtin, custom, ticker, pair, custom_pair or adhoc), the first that knows the request."""
    own = custom.where("error is null")
    x = named(requests, raw).drop("exchange", "source_symbol", "kind", "quote", "asset_class")
    x = x.withColumns({"__key": F.upper(F.trim(raw)), "__ticker": ticker_of(raw), "pair": S.canonical(F.col("pair"))}).withColumn("__token", F.upper("__ticker"))
    x = settled(x)
    row = F.struct(F.col("alias").alias("base"), "ticker", "quote")
    by_ticker = own.groupBy(F.upper("ticker").alias("__token")).agg(F.min(row).alias("ticker_row"))
    tables = [(builtin.select(F.col("alias").alias("__key"), row.alias("builtin_row")), "__key"), (own.select(F.col("alias").alias("__key"), row.alias("custom_row")), "__key"), (by_ticker, "__token"), (builtin.select(F.col("alias").alias("pair"), row.alias("pair_row")), "pair"), (own.select(F.col("alias").alias("pair"), row.alias("custom_pair_row")), "pair")]
    for table, key in tables:
        x = x.join(sized(table), key, "left")
    adhoc = F.struct(F.coalesce(F.nullif("pair", F.lit("")), "__key").alias("base"), F.col("__ticker").alias("ticker"), quote_of(F.col("__ticker")).alias("quote"))
    kinds = ("builtin", "custom", "ticker", "pair", "custom_pair")
    x = x.withColumn("__row", F.coalesce(*[f"{k}_row" for k in kinds], adhoc)).withColumn("found", F.coalesce(*[F.when(F.col(f"{k}_row").isNotNull(), k) for k in kinds], F.lit("adhoc")))
    return x.select(*requests.columns, "__row.*", "found")


def payload_json(base: Column, ticker: Column, quote: Column, exchange: Column, timeframe: Column, provider: str) -> Column:
    """The payload of an instrument: keys in order of the alphabet, no spaces, nulls kept."""
    fields = {"asset_class": F.lit("SPOT"), "contract_kind": F.lit("SPOT"), "pair_symbol": base, "provider": F.lit(provider), "quote_asset": quote, "source_exchange": exchange, "source_symbol": ticker, "timeframe": timeframe}
    return F.to_json(F.struct(*[v.alias(k) for k, v in sorted(fields.items())]), {"ignoreNullFields": "false"})
