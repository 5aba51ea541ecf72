"""Queries of symbols, file names and timeframes made of the part table (T1-T15, I5, I6)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronolith.functions import symbols as S
from chronolith.operators import instruments as I
from chronolith.plans.base import query
from chronolith.sources import bars as B
from chronolith.sources import logs, sinks

_CORE = "'P' || chr(CAST(65 + p_partkey % 26 AS INT)) || chr(CAST(65 + p_partkey {div} 26 % 26 AS INT)) || chr(CAST(65 + p_partkey {div} 676 % 26 AS INT)) || chr(CAST(65 + p_partkey {div} 17576 % 26 AS INT))"
_SUFFIX = "CASE p_partkey % 6 WHEN 0 THEN 'USDT' WHEN 2 THEN '1!' WHEN 3 THEN 'Z2025' WHEN 4 THEN '.P' WHEN 5 THEN '-EUR' ELSE '' END"
_PLACE = "CASE p_partkey % 3 WHEN 0 THEN 'BINANCE:' WHEN 1 THEN 'NSE:' ELSE 'CME:' END"
#: What a message calls the instrument: its own source, another one, or no exchange.
_SAID = f"CASE WHEN p_partkey % 10 = 0 THEN 'OTHER:' WHEN p_partkey % 10 = 5 THEN '' ELSE {_PLACE} END"
_QUOTES = "|".join(sorted(S.QUOTES, key=len, reverse=True))


#: A symbol's tails and what they tell, in DuckDB SQL: at least one character stands before a tail.
_TAILS = {"rolling": "[0-9]*!", "dated": f"[0-9]{{0,2}}[{S.MONTHS}][0-9]{{2,4}}", "swap": "|".join(m.replace(".", "[.]") for m in S.PERPETUAL)}


def _kinds(symbol: str, source: str, name: str) -> str:
    """Common table expressions that add the tails, kind, expiry and root of a symbol, then its quote and pair."""
    tails = ", ".join(f"nullif(regexp_extract({symbol}, '.({v})$', 1), '') AS {k}" for k, v in _TAILS.items())
    return f"""{name}_t AS (SELECT *, {tails} FROM {source}),
    {name}_k AS (SELECT *, CASE WHEN rolling IS NOT NULL THEN 'CONTINUOUS_FUTURE' WHEN dated IS NOT NULL THEN 'DATED_FUTURE' WHEN swap IS NOT NULL THEN 'PERPETUAL' ELSE 'SPOT' END AS kind, CASE WHEN rolling IS NULL THEN dated END AS expiry, left({symbol}, length({symbol}) - length(coalesce(rolling, dated, swap, ''))) AS root FROM {name}_t),
    {name} AS (SELECT *, nullif(regexp_extract(root, '^(.+?)({_QUOTES})$', 2), '') AS quote, coalesce(regexp_replace(CASE WHEN regexp_matches(root, '^.+?({_QUOTES})$') THEN regexp_extract(root, '^(.+?)({_QUOTES})$', 1) ELSE root END, '[^A-Z0-9]', '', 'g'), '') AS pair FROM {name}_k)"""


def _sql(place: str, name: str) -> str:
    """Symbols of the parts and what they are made of, as common table expressions."""
    return f"""{name}0 AS (SELECT p_partkey AS k, {place} || {_CORE.format(div='//')} || {_SUFFIX} AS raw FROM part),
    {name}1 AS (SELECT *, CASE WHEN contains(raw, ':') THEN split_part(raw, ':', 1) END AS exchange, regexp_replace(CASE WHEN contains(raw, ':') THEN split_part(raw, ':', 2) ELSE raw END, '[^A-Z0-9!._]', '', 'g') AS source_symbol FROM {name}0),
    {_kinds('source_symbol', f'{name}1', f'{name}2')}, {name} AS (SELECT k, raw, exchange, source_symbol, kind, quote, pair, CASE WHEN kind = 'SPOT' THEN 'SPOT' ELSE 'FUT' END AS asset_class FROM {name}2)"""


_REG = f"{_sql(_PLACE, 's')}, reg AS (SELECT pair, asset_class, exchange, source_symbol, kind, quote FROM s WHERE k % 5 = 0)"
_BUILTIN = "b AS (SELECT pair AS alias, source_symbol AS ticker, quote FROM s WHERE k % 7 = 0)"
_CUSTOM = """c0 AS (SELECT pair AS alias, CASE WHEN k % 14 = 0 THEN 'YAHOO:' || pair || '-GBP' WHEN k % 14 = 7 THEN source_symbol ELSE pair || 'EUR=X' END AS spec FROM s WHERE k % 7 = 0 OR k % 7 = 3),
    c1 AS (SELECT alias, regexp_replace(spec, '^YAHOO:', '') AS ticker FROM c0), c AS (SELECT c1.alias, c1.ticker, CASE WHEN contains(c1.ticker, '-') THEN split_part(c1.ticker, '-', -1) WHEN c1.ticker LIKE '%=X' THEN 'EUR' END AS quote, CASE WHEN upper(b.ticker) <> upper(c1.ticker) THEN 'known as ' || b.ticker END AS error FROM c1 LEFT JOIN b USING (alias))"""


#: Parts that name a built-in or a custom instrument.
_LISTED = "{k} % 7 in (0, 3)"


def parts(spark, sf, which: str = "true") -> DataFrame:
    """The part table dealt to all cores: its file is small, and what is done with a row is not."""
    return sinks.spread(B.table(spark, sf, "part").where(which.format(k="p_partkey")))


def symbols(spark, sf, place: str = _PLACE, which: str = "true") -> DataFrame:
    """k and a symbol of each part (of those that ``which`` names), with what it is made of."""
    raw = parts(spark, sf, which).select(F.col("p_partkey").alias("k"), F.expr(f"{place} || {_CORE.format(div='div')} || {_SUFFIX}").alias("raw"))
    return I.named(raw)


def known(spark, sf, which: str = "true") -> DataFrame:
    """The symbols (of the parts that ``which`` names), parsed once and stored, for queries that use them as several tables."""
    return sinks.stored(symbols(spark, sf, which=which), "symbols")


def registry(spark, sf) -> DataFrame:
    return sinks.stored(symbols(spark, sf).where("k % 5 = 0").select("pair", "asset_class", "exchange", "source_symbol", "kind", "quote"), "registry")


def builtin(s: DataFrame) -> DataFrame:
    return s.where("k % 7 = 0").select(F.col("pair").alias("alias"), F.col("source_symbol").alias("ticker"), "quote")


def custom(s: DataFrame) -> DataFrame:
    spec = F.expr("CASE WHEN k % 14 = 0 THEN 'YAHOO:' || pair || '-GBP' WHEN k % 14 = 7 THEN source_symbol ELSE pair || 'EUR=X' END")
    new = s.where(_LISTED.format(k="k")).select(F.col("pair").alias("alias"), spec.alias("ticker"))
    return sinks.stored(I.registered(new, builtin(s), shortest=4), "aliases")  # as its SQL, which has the quote of pairs of a letter and EUR too


@query("t9_registry_override", f"""WITH {_REG}, {_sql(_SAID, 'm')}, one AS (SELECT source_symbol, min(exchange) AS exchange FROM reg GROUP BY 1 HAVING count(*) = 1),
    x AS (SELECT m.*, e.exchange AS e_exchange, e.source_symbol AS e_symbol, coalesce(p.pair, o.pair) AS r_pair FROM m LEFT JOIN reg e ON e.pair = m.pair AND e.asset_class = m.asset_class LEFT JOIN reg p ON p.exchange = m.exchange AND p.source_symbol = m.source_symbol
      LEFT JOIN one ON m.exchange IS NULL AND one.source_symbol = m.source_symbol LEFT JOIN reg o ON o.exchange = one.exchange AND o.source_symbol = one.source_symbol)
    SELECT k, CASE WHEN r_pair IS NOT NULL THEN e_exchange ELSE exchange END AS exchange, source_symbol, pair, asset_class, kind, quote, e_symbol IS NOT NULL AS registry_covered, CASE WHEN e_symbol IS NOT NULL AND r_pair IS NULL THEN 'expected ' || e_exchange || ':' || e_symbol || ' received ' || coalesce(exchange || ':', '') || source_symbol END AS error FROM x""")
def _(spark, sf):
    return I.covered(symbols(spark, sf, _SAID), registry(spark, sf)).select("k", "exchange", "source_symbol", "pair", "asset_class", "kind", "quote", "registry_covered", "error")


@query("t11_registry_lookup", f"WITH {_REG}, {_sql(_SAID, 'm')} SELECT k, e.source_symbol AS pair_source, p.pair AS source_pair FROM m LEFT JOIN reg e ON e.pair = m.pair AND e.asset_class = m.asset_class LEFT JOIN reg p ON p.source_symbol = m.source_symbol AND (m.exchange IS NULL OR p.exchange = m.exchange)")
def _(spark, sf):
    return I.looked_up(symbols(spark, sf, _SAID), registry(spark, sf)).select("k", F.col("by_pair.source_symbol").alias("pair_source"), F.col("by_source.pair").alias("source_pair"))


@query("t12_instrument_identity", f"WITH {_sql(_PLACE, 's')}, {_sql(_SAID, 'm')} SELECT pair AS canonical, array_to_string(list_sort(list(DISTINCT alias)), ',') AS aliases, lower(pair) AS artifact_prefix FROM (SELECT pair, raw AS alias FROM s UNION SELECT pair, raw FROM m UNION SELECT pair, pair FROM s) GROUP BY 1")
def _(spark, sf):
    both = symbols(spark, sf).unionByName(symbols(spark, sf, _SAID))
    return I.identities(both).select("canonical", F.array_join("aliases", ",").alias("aliases"), "artifact_prefix")


@query("t13_resolve_instrument", f"""WITH {_sql(_PLACE, 's')}, {_BUILTIN}, {_CUSTOM}, ok AS (SELECT * FROM c WHERE error IS NULL), a AS (SELECT s.k, s.pair AS p, CASE s.k % 4 WHEN 0 THEN s.pair WHEN 1 THEN s.raw WHEN 2 THEN 'yahoo:' || s.pair || 'EUR=X' ELSE lower(s.pair) || '-gbp' END AS req FROM s),
    t AS (SELECT *, CASE k % 4 WHEN 2 THEN p || 'EUR=X' ELSE req END AS tick, CASE k % 4 WHEN 0 THEN p WHEN 1 THEN p WHEN 2 THEN p || 'EURX' ELSE p END AS pp FROM a)
    SELECT t.k, coalesce(b1.alias, o1.alias, o2.alias, b2.alias, o3.alias, pp) AS base, coalesce(b1.ticker, o1.ticker, o2.ticker, b2.ticker, o3.ticker, tick) AS ticker, CASE WHEN b1.alias IS NOT NULL THEN 'builtin' WHEN o1.alias IS NOT NULL THEN 'custom' WHEN o2.alias IS NOT NULL THEN 'ticker' WHEN b2.alias IS NOT NULL THEN 'pair' WHEN o3.alias IS NOT NULL THEN 'custom_pair' ELSE 'adhoc' END AS found
    FROM t LEFT JOIN b b1 ON b1.alias = upper(req) LEFT JOIN ok o1 ON o1.alias = upper(req) LEFT JOIN ok o2 ON upper(o2.ticker) = upper(tick) LEFT JOIN b b2 ON b2.alias = pp LEFT JOIN ok o3 ON o3.alias = pp""")
def _(spark, sf):
    request = F.expr("CASE k % 4 WHEN 0 THEN pair WHEN 1 THEN raw WHEN 2 THEN 'yahoo:' || pair || 'EUR=X' ELSE lower(pair) || '-gbp' END")
    s = known(spark, sf)
    return I.resolved(s.select("k", request.alias("request")), builtin(s), custom(s), "request").select("k", "base", "ticker", "found")


@query("t14_custom_aliases", f"WITH {_sql(_PLACE, 's')}, {_BUILTIN}, {_CUSTOM} SELECT alias, ticker, quote, error, 'custom' AS source FROM c UNION ALL SELECT alias, ticker, NULL, NULL, 'builtin' FROM b WHERE alias NOT IN (SELECT alias FROM c WHERE error IS NULL)")
def _(spark, sf):
    s = known(spark, sf, _LISTED)
    new = custom(s)
    rest = I.listed(builtin(s), new).where("source = 'builtin'")
    return new.withColumn("source", F.lit("custom")).unionByName(rest, allowMissingColumns=True)


@query("t15_payload_json", f"WITH {_sql(_PLACE, 's')} SELECT k, json_object('asset_class', 'SPOT', 'contract_kind', 'SPOT', 'pair_symbol', pair, 'provider', 'history', 'quote_asset', quote, 'source_exchange', exchange, 'source_symbol', source_symbol, 'timeframe', '1D')::VARCHAR AS payload FROM s")
def _(spark, sf):
    x = symbols(spark, sf)
    return x.select("k", I.payload_json(F.col("pair"), F.col("source_symbol"), F.col("quote"), F.col("exchange"), F.lit("1D"), "history").alias("payload"))


# ---- symbols as they come ------------------------------------------------------------------------------------------

_ODD = ["BINANCE:BTCUSDT", "NSE:NIFTY", "btcusd", "ES1!", "CME:ESZ2025", "BTCUSDT.P", "ETHPERP", "NSE:NIFTYJR", "EURUSD", "USDT", "12H24", "XBTUSDTPERPETUAL", "cnx-finance", "SP500", "A!", "GOLDM5", "1000SHIBUSDC"]


def _case(key: str, values, default: str | None = None) -> str:
    """A CASE over the remainders of a key, in the SQL of both engines."""
    values = list(values)
    return f"CASE {key} % {len(values) + (default is not None)} " + " ".join(f"WHEN {i} THEN '{v}'" for i, v in enumerate(values)) + (f" ELSE '{default}'" if default is not None else "") + " END"


_TAIL = _case("p_partkey", ["USDT", "1!", "Z2025", ".P", "-EUR", "PERP", "12H24", "USDTPERPETUAL", "usdc", " ", "5!"], "")
_ASKED = f"CASE WHEN p_partkey % 3 = 0 THEN {_case('p_partkey', _ODD)} ELSE {_case('p_partkey', ['BINANCE:', 'NSE:', 'cme:'], '')} || {{core}} || {_TAIL} END"
_RAWS = f"raws AS (SELECT p_partkey AS k, {_ASKED.format(core=_CORE.format(div='//'))} AS raw FROM part)"


def raws(spark, sf) -> DataFrame:
    """k and a symbol of each part as users write them: cases, blanks, places and tails of all kinds."""
    return parts(spark, sf).select(F.col("p_partkey").alias("k"), F.expr(_ASKED.format(core=_CORE.format(div="div"))).alias("raw"))


@query("t4_normalize", f"WITH {_RAWS} SELECT k, raw, nullif(regexp_replace(upper(trim(raw)), '[^A-Z0-9]', '', 'g'), '') AS pair, nullif(regexp_replace(upper(trim(raw)), '[^A-Z0-9!._]', '', 'g'), '') AS source FROM raws")
def _(spark, sf):
    return raws(spark, sf).select("k", "raw", S.normal("raw").alias("pair"), S.normal("raw", "A-Z0-9!._").alias("source"))


_SPLIT = "upper(trim(CASE WHEN contains(raw, ':') THEN split_part(raw, ':', 2) ELSE raw END))"


@query("t5_exchange_split", f"WITH {_RAWS} SELECT k, raw, CASE WHEN contains(raw, ':') THEN upper(split_part(raw, ':', 1)) END AS exchange, {_SPLIT} AS symbol FROM raws")
def _(spark, sf):
    exchange, symbol = S.split_exchange("raw")
    return raws(spark, sf).select("k", "raw", exchange.alias("exchange"), symbol.alias("symbol"))


@query("t6_contract_signature", f"WITH {_RAWS}, s AS (SELECT k, raw, {_SPLIT} AS s FROM raws), {_kinds('s', 's', 'x')} SELECT k, raw, kind, expiry, root FROM x")
def _(spark, sf):
    x = raws(spark, sf).withColumn("s", S.split_exchange("raw")[1])
    kind, expiry, root = S.contract(F.col("s"))
    return x.select("k", "raw", kind.alias("kind"), expiry.alias("expiry"), root.alias("root"))


@query("t7_quote_split", f"WITH {_RAWS}, u AS (SELECT k, upper(replace(raw, ':', '')) AS raw FROM raws) SELECT k, raw, nullif(regexp_extract(raw, '^(.+?)({_QUOTES})$', 2), '') AS quote, regexp_replace(CASE WHEN regexp_matches(raw, '^.+?({_QUOTES})$') THEN regexp_extract(raw, '^(.+?)({_QUOTES})$', 1) ELSE raw END, '[^A-Z0-9]', '', 'g') AS pair FROM u")
def _(spark, sf):
    x = raws(spark, sf).select("k", F.upper(F.replace("raw", F.lit(":"), F.lit(""))).alias("raw"))
    pair, quote = S.pair_and_quote(F.col("raw"))
    return x.select("k", "raw", quote.alias("quote"), pair.alias("pair"))


_MARKET = _case("p_size", ["FUTURES", "INDEX", "CRYPTO", "FUTURE", "STOCK"], "OTHER")


@query("t8_asset_class", f"WITH {_RAWS}, s AS (SELECT k, {_SPLIT} AS s, {_MARKET} AS market FROM raws JOIN part ON p_partkey = k), {_kinds('s', 's', 'x')} SELECT k, kind, market, CASE WHEN market IN ('FUTURES', 'FUTURE') THEN 'FUT' WHEN market IN ('CRYPTO', 'INDEX', 'STOCK') THEN 'SPOT' WHEN kind = 'SPOT' THEN 'SPOT' ELSE 'FUT' END AS asset_class FROM x")
def _(spark, sf):
    x = parts(spark, sf).select(F.col("p_partkey").alias("k"), F.expr(_ASKED.format(core=_CORE.format(div="div"))).alias("raw"), F.expr(_MARKET).alias("market"))
    x = x.select("k", "market", S.contract(S.split_exchange("raw")[1])[0].alias("kind"))
    return x.select("k", "kind", "market", S.asset_class(F.col("kind"), F.col("market")).alias("asset_class"))


_NAME = f"CASE WHEN p_partkey % 2 = 0 THEN {_case('p_partkey // 2', ['NIFTYJR', 'SP500', 'INDIAVIX', 'CNXFINANCE', 'GSPC'], 'BTC')} ELSE {_CORE.format(div='//')} END"
_CANON = "canon AS (FROM (VALUES ('NIFTYJR', 'NIFTYNXT50'), ('SP500', 'SPX500'), ('INDIAVIX', 'INDIA_VIX'), ('CNXFINANCE', 'FINNIFTY'), ('GSPC', 'SPX500')) v(name, canonical))"


@query("t10_canonical_pair", f"WITH {_CANON}, p AS (SELECT p_partkey AS k, {_NAME} AS pair FROM part) SELECT k, pair, coalesce(canonical, pair) AS canonical FROM p LEFT JOIN canon ON name = pair")
def _(spark, sf):
    x = parts(spark, sf).select(F.col("p_partkey").alias("k"), F.expr(_NAME.replace("//", "div")).alias("pair"))
    return x.select("k", "pair", S.canonical(F.col("pair")).alias("canonical"))


#: The symbol that a message holds, and the messages: an object, an object as text, a broken object, plain text, none.
_HELD = f"{_NAME} || {_case('p_partkey', ['USDT', '1!', 'Z2025', '.P', '12H24', 'PERP'], '')}"
_BS = "' || chr(92) || '"
_MESSAGE = f"""CASE p_partkey % 5 WHEN 0 THEN 'SYMBOL:{{"exchange":"NSE","symbol":"' || held || '","type":"index"}} ,OPEN:1' WHEN 1 THEN 'SYMBOL:"{{{_BS}"symbol{_BS}":{_BS}"BINANCE:' || held || '{_BS}"}}" ,OPEN:1' WHEN 2 THEN 'SYMBOL:{{"ticker":"' || held || '", bad ,OPEN:1' WHEN 3 THEN 'SYMBOL:CME:' || held || ' ,OPEN:1' ELSE 'no symbol' END"""
_SAYS = f"says AS (SELECT p_partkey AS k, {_MESSAGE} AS message, CASE p_partkey % 5 WHEN 0 THEN 'NSE' WHEN 1 THEN 'BINANCE' WHEN 3 THEN 'CME' END AS exchange, CASE WHEN p_partkey % 5 < 4 THEN held END AS source_symbol FROM (SELECT p_partkey, {_HELD} AS held FROM part))"


def messages(spark, sf) -> DataFrame:
    held = parts(spark, sf).select("p_partkey", F.expr(_HELD.replace("//", "div")).alias("held"))
    return S.parsed(held.select(F.col("p_partkey").alias("k"), F.expr(_MESSAGE).alias("message")))


@query("t1_t2_t3_payload", f"WITH {_SAYS} SELECT k, message, exchange, source_symbol FROM says")
def _(spark, sf):
    return messages(spark, sf).select("k", "message", "exchange", "source_symbol")


@query("t9_full_parse", f"WITH {_SAYS}, {_CANON}, {_kinds('source_symbol', 'says', 'x')} SELECT k, message, exchange, source_symbol, kind, expiry, pair, quote, CASE WHEN k % 5 = 0 OR kind = 'SPOT' THEN 'SPOT' ELSE 'FUT' END AS asset_class, coalesce(canonical, pair) AS canonical FROM x LEFT JOIN canon ON name = pair")
def _(spark, sf):
    return messages(spark, sf).select("k", "message", "exchange", "source_symbol", "kind", "expiry", "pair", "quote", "asset_class", "canonical")


# ---- file names and timeframes -------------------------------------------------------------------------------------

_FILE = f"CASE p_partkey % 4 WHEN 0 THEN '/a/NSE_' || {_CORE} || ', 60.csv' WHEN 1 THEN {_CORE} || '_1D.csv' WHEN 2 THEN 'x/y.z/' || lower({_CORE}) || ' W.parquet' ELSE 'x/' || {_CORE} || '.csv' END"


@query("i5_filename", f"SELECT p_partkey AS k, {_FILE.format(div='//')} AS path, {_CORE.format(div='//')} AS symbol, CASE p_partkey % 4 WHEN 0 THEN '1H' WHEN 1 THEN '1D' WHEN 2 THEN '1W' END AS timeframe FROM part")
def _(spark, sf):
    symbol, tf = logs.from_filename("path")
    return parts(spark, sf).select(F.col("p_partkey").alias("k"), F.expr(_FILE.format(div="div")).alias("path")).select("k", "path", symbol.alias("symbol"), tf.alias("timeframe"))


_FRAME = _case("p_partkey", ["1H", "1D", "1W", "1M", "3M", "6M", "12M"])


@query("i6_timeframe_seconds", f"SELECT p_partkey AS k, {_FRAME} AS timeframe, CASE p_partkey % 7 WHEN 0 THEN 3600 WHEN 1 THEN 86400 WHEN 2 THEN 7 * 86400 WHEN 3 THEN 30 * 86400 WHEN 4 THEN 90 * 86400 WHEN 5 THEN 180 * 86400 ELSE 360 * 86400 END AS seconds FROM part")
def _(spark, sf):
    return parts(spark, sf).select(F.col("p_partkey").alias("k"), F.expr(_FRAME).alias("timeframe")).withColumn("seconds", logs.length("timeframe"))
