"""Queries of folds, losses, calibration, coverage, trades, replay and registry (A11-A24, M, P, R rows)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chronolith.functions.exprs import ahead, clip, libm_ln, r6, seconds, series, upto, w, whole
from chronolith.operators import core, evaluate, features, labels
from chronolith.plans.base import OV, SQL, T, WD, WH, fore, over, query, r
from chronolith.plans.features import _HAR, _TGT, lim, rv
from chronolith.sources import bars as B
from chronolith.sources import sinks


def forecasts(spark, sf) -> DataFrame:
    """Actual next-day log range with two forecasts: its means over 5 and over 22 days."""
    x = core.numbered(B.bars_1d(spark, sf)).withColumn("rng", F.ln(F.col("high") / F.col("low")))
    return x.withColumns({"ml": F.avg("rng").over(w(5)), "har": F.avg("rng").over(w(22)), "actual": F.lead("rng").over(series())}).where("i >= 22").select("symbol", "ts", "i", "actual", "ml", "har")


FC = f"""f0 AS (SELECT *, ln(high / low) AS rng, row_number() {OV} AS i FROM d), fc AS (SELECT symbol, ts, i, lead(rng) {OV} AS actual, avg(rng) {over(5)} AS ml, avg(rng) {over(22)} AS har FROM f0 QUALIFY i >= 22)"""
WF = f"{WD}, {FC}"
P = "((epoch(ts)::BIGINT // 3600 * 7919 + length(symbol) * 131) % 1000) / 1000.0"


@query("a13_mae_rmse_edge", f"{WF} SELECT symbol, count(actual - ml) AS n, {r('avg(abs(actual - ml))', 'mae')}, {r('sqrt(avg((actual - ml) ** 2))', 'rmse')}, {r('avg(ml - actual)', 'bias')}, {r('1 - avg(abs(actual - ml)) / avg(abs(actual - har))', 'edge')} FROM fc GROUP BY 1")
def _(spark, sf):
    g = forecasts(spark, sf).groupBy("symbol").agg(*evaluate.errors("actual", "ml", har="har"))
    return g.select("symbol", "n", *[r6(c).alias(c) for c in ("mae", "rmse", "bias", "edge")])


@query("a14_qlike_huber", f"{WF} SELECT symbol, {r('avg(exp(e) - e - 1)', 'qlike')}, {r('avg(CASE WHEN abs(e) <= 1 THEN 0.5 * e * e ELSE abs(e) - 0.5 END)', 'huber')} FROM (SELECT symbol, {lim('actual - ml', -10, 10)} AS e FROM fc WHERE actual IS NOT NULL) GROUP BY 1")
def _(spark, sf):
    return forecasts(spark, sf).where("actual is not null").groupBy("symbol").agg(r6(evaluate.qlike("actual", "ml")).alias("qlike"), r6(evaluate.huber("actual", "ml")).alias("huber"))


@query("a23_bates_granger", f"{WF}, g AS (SELECT symbol, count(actual) AS n, avg((actual - ml) ** 2) AS v1, avg((actual - har) ** 2) AS v2, avg((actual - ml) * (actual - har)) AS c FROM fc GROUP BY 1), x AS (SELECT symbol, CASE WHEN n < 25 THEN 1 WHEN abs(v1 + v2 - 2 * c) < 1e-12 THEN CASE WHEN v1 <= v2 THEN 1 ELSE 0 END ELSE {lim('(v2 - c) / (v1 + v2 - 2 * c)', 0, 1)} END AS wm FROM g) SELECT symbol, {r('wm', 'w_ml')}, {r('1 - wm', 'w_har')} FROM x")
def _(spark, sf):
    return evaluate.bates_granger(forecasts(spark, sf)).select("symbol", r6("w_ml").alias("w_ml"), r6("w_har").alias("w_har"))


@query("m14_forecast_combination", f"{WF}, g AS (SELECT symbol, avg((actual - ml) ** 2) AS v1, avg((actual - har) ** 2) AS v2, avg((actual - ml) * (actual - har)) AS c FROM fc GROUP BY 1), x AS (SELECT symbol, {lim('(v2 - c) / (v1 + v2 - 2 * c)', 0, 1)} AS wm FROM g) SELECT symbol, {T}, {r('wm * ml + (1 - wm) * har', 'pred')} FROM fc JOIN x USING (symbol)")
def _(spark, sf):
    f = forecasts(spark, sf)
    x = f.join(evaluate.bates_granger(f), "symbol")
    return x.select("symbol", seconds().alias("ts_s"), r6(F.col("w_ml") * F.col("ml") + F.col("w_har") * F.col("har")).alias("pred"))


_WT = f"power(0.98, row_number() OVER (PARTITION BY symbol ORDER BY ts DESC) - 1)"


@query("a22_decay_weights", f"{WD} SELECT symbol, {T}, {r(_WT, 'weight')} FROM d")
def _(spark, sf):
    return B.bars_1d(spark, sf).select("symbol", seconds().alias("ts_s"), r6(evaluate.decay_weights()).alias("weight"))


@query("a21_weighted_quantile", f"{WD}, x AS (SELECT symbol, close, volume, sum(volume) OVER (PARTITION BY symbol ORDER BY close) AS cum, sum(volume) OVER (PARTITION BY symbol) AS tot FROM d) SELECT symbol, {r('min(close)', 'q')} FROM x WHERE cum >= 0.9 * tot GROUP BY 1")
def _(spark, sf):
    return evaluate.weighted_quantile(B.bars_1d(spark, sf), "close", "volume", 0.9, "symbol", refined=True).select("symbol", r6("q").alias("q"))


def _conf_sql(level: float) -> str:
    side = lambda name, cond, v: f"(SELECT symbol, min(v) AS {name} FROM (SELECT symbol, v, sum(wt) OVER (PARTITION BY symbol ORDER BY v) AS cum, sum(wt) OVER (PARTITION BY symbol) AS tot FROM (SELECT symbol, wt, {v} AS v FROM cr WHERE {cond})) WHERE cum >= {level} * tot GROUP BY 1)"
    return f"SELECT s.symbol, {level}::DOUBLE AS level, coalesce(a.low, c.sym) AS low, coalesce(b.high, c.sym) AS high FROM (SELECT DISTINCT symbol FROM cr) s LEFT JOIN {side('low', 'res < 0', '-res')} a USING (symbol) LEFT JOIN {side('high', 'res > 0', 'res')} b USING (symbol) LEFT JOIN {side('sym', 'true', 'abs(res)')} c USING (symbol)"


CW = f"cr AS (SELECT symbol, actual - ml AS res, {_WT} AS wt FROM fc WHERE actual IS NOT NULL), cw AS ({' UNION ALL '.join(_conf_sql(x) for x in evaluate.LEVELS)})"


@query("m15_conformal_widths", f"{WF}, {CW} SELECT symbol, level, {r('low', 'low')}, {r('high', 'high')} FROM cw")
def _(spark, sf):
    return evaluate.conformal(forecasts(spark, sf), pred="ml", refined=True).select("symbol", "level", r6("low").alias("low"), r6("high").alias("high"))


@query("a15_picp_mpiw_winkler", f"""{WF}, {CW}, z AS (SELECT fc.symbol, level, actual, ml - low AS lo, ml + high AS hi FROM fc JOIN cw USING (symbol) WHERE actual IS NOT NULL)
    SELECT symbol, level, count(*) AS n, {r('avg(CASE WHEN actual BETWEEN lo AND hi THEN 1.0 ELSE 0 END)', 'picp')}, {r('avg(hi - lo)', 'mpiw')}, {r('avg(hi - lo + CASE WHEN actual < lo THEN 2 / (1 - level) * (lo - actual) ELSE 0 END + CASE WHEN actual > hi THEN 2 / (1 - level) * (actual - hi) ELSE 0 END)', 'winkler')} FROM z GROUP BY 1, 2""")
def _(spark, sf):
    f = forecasts(spark, sf)
    return evaluate.coverage(f, evaluate.conformal(f, pred="ml"), pred="ml").select("symbol", "level", "n", *[r6(c).alias(c) for c in ("picp", "mpiw", "winkler")])


@query("a16_excursion_coverage", f"""{WF}, x AS (SELECT symbol, actual, ml, {lim('actual / ml', 0, 10)} AS ratio FROM fc WHERE actual IS NOT NULL AND ml > 0), s AS (SELECT symbol, q, quantile_cont(ratio, 0.1) FILTER (q = 0.1) AS a, quantile_cont(ratio, 0.25) FILTER (q = 0.25) AS b, quantile_cont(ratio, 0.5) FILTER (q = 0.5) AS c, quantile_cont(ratio, 0.75) FILTER (q = 0.75) AS dd, quantile_cont(ratio, 0.9) FILTER (q = 0.9) AS e FROM x, (VALUES (0.1::DOUBLE), (0.25), (0.5), (0.75), (0.9)) v(q) GROUP BY 1, 2), t AS (SELECT symbol, q, coalesce(a, b, c, dd, e) AS scale FROM s)
    SELECT symbol, q, {r('scale', 'scale')}, count(*) AS n, {r('avg(CASE WHEN actual - scale * ml <= 0 THEN 1.0 ELSE 0 END)', 'coverage')}, {r('avg(greatest(q * (actual - scale * ml), (q - 1) * (actual - scale * ml)))', 'pinball')} FROM x JOIN t USING (symbol) GROUP BY symbol, q, scale""")
def _(spark, sf):
    return evaluate.excursion_coverage(forecasts(spark, sf).withColumn("pred", F.col("ml"))).select("symbol", "q", r6("scale").alias("scale"), "n", r6("coverage").alias("coverage"), r6("pinball").alias("pinball"))


def scored(spark, sf) -> DataFrame:
    """Probabilities against whether the next close is higher."""
    d = core.numbered(B.bars_1d(spark, sf)).withColumn("y", (F.lead("close").over(series()) > F.col("close")).cast("double"))
    return d.join(B.oos(B.bars_1d(spark, sf).where("day(ts) <= 25")), ["symbol", "ts"], "left").where("y is not null")


SC = f"sc AS (SELECT symbol, ts, i, y, CASE WHEN day(ts) <= 25 THEN {P} END AS p FROM (SELECT *, row_number() {OV} AS i, CASE WHEN lead(close) {OV} > close THEN 1.0 ELSE 0 END AS y, lead(close) {OV} AS nx FROM d) WHERE nx IS NOT NULL)"


@query("a17_oos_scoring", f"{WD}, {SC}, z AS (SELECT *, i // 500 AS split FROM sc) SELECT symbol, split, count(p) AS n, {r('avg(CASE WHEN p IS NULL THEN NULL WHEN (p > 0.5) = (y > 0.5) THEN 1.0 ELSE 0 END)', 'accuracy')}, {r('avg(CASE WHEN p >= 0.7 OR p <= 1 - 0.7::DOUBLE THEN CASE WHEN (p > 0.5) = (y > 0.5) THEN 1.0 ELSE 0 END END)', 'sure_accuracy')}, {r('greatest(avg(y), 1 - avg(y))', 'baseline')}, count(*) FILTER (p IS NULL) AS missing FROM z GROUP BY 1, 2")
def _(spark, sf):
    x = evaluate.classification(scored(spark, sf).withColumn("split", F.floor(F.col("i") / 500)), "symbol", "split")
    return x.select("symbol", "split", "n", *[r6(c).alias(c) for c in ("accuracy", "sure_accuracy", "baseline")], "missing")


#: The next day's and the next five days' targets.
VOL = ("vol_1d", "range_1d", "up_1d", "down_1d", "vol_5d", "range_5d", "up_5d", "down_5d")
#: Targets whose loss is scored by QLIKE too (fixed values).
QLIKE = ("vol_1d", "range_1d", "vol_5d", "range_5d")


def target_forecasts(spark, sf) -> DataFrame:
    """Means of the last 5 and 22 known values of each of the eight targets; ``symbol`` holds symbol and target.

    A target of the next day is known a day later, one of the next five days five days later.
    An interval ends at a residual of its own rows, so whether that row is inside is a matter of the last bit.
    """
    x = features.volatility_targets(B.bars_1d(spark, sf), ln=libm_ln)
    x = x.select("symbol", "ts", F.explode(F.create_map(*[c for k in VOL for c in (F.lit(k), F.col(k))])).alias("target", "actual")).withColumn("symbol", F.concat_ws("|", "symbol", "target"))
    late = F.col("target").endswith("5d")
    mean = lambda n: F.when(late, F.avg("actual").over(ahead(-(n + 4), -5))).otherwise(F.avg("actual").over(ahead(-n, -1)))
    x = x.withColumns({"i": F.row_number().over(series()), "ml": mean(5), "har": mean(22)})
    return x.where(F.col("i") >= F.when(late, 27).otherwise(23)).select("symbol", "target", "ts", "actual", "ml", "har")


_EIGHT = f"""t2 AS (SELECT *, lead(v) {OV} AS v1, lead(high) {OV} AS h1, lead(low) {OV} AS l1, lead(open) {OV} AS o1, count(v) {fore(1, 5)} = 5 AS ok, avg(v) {fore(1, 5)} AS av, max(high) {fore(1, 5)} AS hi, min(low) {fore(1, 5)} AS lo FROM t1),
t3 AS (SELECT symbol, ts, unnest([{', '.join(f"'{t}'" for t in VOL)}]) AS target, unnest([CASE WHEN v1 IS NOT NULL THEN ln(1 + sqrt(greatest(252 * v1, 1e-6))) END, ln(h1 / l1), ln(h1 / o1), ln(o1 / l1), CASE WHEN ok THEN ln(1 + sqrt(greatest(252 * av, 1e-6))) END, CASE WHEN ok THEN ln(hi / lo) END, CASE WHEN ok THEN ln(hi / o1) END, CASE WHEN ok THEN ln(o1 / lo) END]) AS y FROM t2)"""
_PAST = lambda n, g: f"avg(x) OVER (PARTITION BY symbol ORDER BY ts ROWS BETWEEN {n + g - 1} PRECEDING AND {g} PRECEDING)"
WTF = f"{WD}, {_TGT}, {_EIGHT}, t4 AS (SELECT symbol || '|' || target AS symbol, ts, y AS x, target LIKE '%5d' AS late, row_number() OVER (PARTITION BY symbol, target ORDER BY ts) AS i FROM t3), fc AS (SELECT symbol, ts, x AS actual, CASE WHEN late THEN {_PAST(5, 5)} ELSE {_PAST(5, 1)} END AS ml, CASE WHEN late THEN {_PAST(22, 5)} ELSE {_PAST(22, 1)} END AS har FROM t4 QUALIFY i >= CASE WHEN late THEN 27 ELSE 23 END), {CW}"
_QL = lambda x: f"avg(exp({lim(x, -10, 10)}) - {lim(x, -10, 10)} - 1)"
_OF = lambda e: f"CASE WHEN target IN {QLIKE} THEN {e} END"


@query("a18_vol_oos_scoring", f"""{WTF}, z AS (SELECT split_part(symbol, '|', 2) AS target, actual, ml, har, ml - low AS lo, ml + high AS hi FROM fc JOIN cw USING (symbol) WHERE level = 0.9 AND actual IS NOT NULL)
    SELECT target, count(*) AS n, {r('avg(abs(actual - ml))', 'mae')}, {r('sqrt(avg((actual - ml) ** 2))', 'rmse')}, {r('avg(ml - actual)', 'bias')}, {r('avg(abs(actual - har))', 'har_mae')}, {r('sqrt(avg((actual - har) ** 2))', 'har_rmse')}, {r('1 - avg(abs(actual - ml)) / avg(abs(actual - har))', 'edge')},
    {r(_OF(_QL('actual - ml')), 'qlike')}, {r(_OF(_QL('actual - har')), 'har_qlike')}, {r(_OF('1 - ' + _QL('actual - ml') + ' / ' + _QL('actual - har')), 'qlike_edge')}, {r('avg(CASE WHEN actual BETWEEN lo AND hi THEN 1.0 ELSE 0 END)', 'picp')}, {r('avg(hi - lo)', 'mpiw')},
    {r('avg(hi - lo + CASE WHEN actual < lo THEN 2 / 0.1 * (lo - actual) ELSE 0 END + CASE WHEN actual > hi THEN 2 / 0.1 * (actual - hi) ELSE 0 END)', 'winkler')}, {r('abs(avg(CASE WHEN actual BETWEEN lo AND hi THEN 1.0 ELSE 0 END) - 0.9)', 'picp_error')} FROM z GROUP BY 1""")
def _(spark, sf):
    f = sinks.stored(target_forecasts(spark, sf), "forecasts")
    x = f.join(evaluate.conformal(f, pred="ml", levels=(0.9,)), "symbol").withColumns({"lo": F.col("ml") - F.col("low"), "hi": F.col("ml") + F.col("high")})
    g = evaluate.vol_scores(x, "target")
    scored_so = lambda c: F.when(F.col("target").isin(*QLIKE), r6(c)) if "qlike" in c else r6(c)
    return g.select("target", "n", *[scored_so(c).alias(c) for c in g.columns[2:]])


@query("a20_brier", f"{WD}, {SC} SELECT symbol, {r('avg((p - y) ** 2)', 'raw')}, {r('avg((' + lim('p', .01, .99) + ' - y) ** 2)', 'clipped')} FROM sc WHERE p IS NOT NULL GROUP BY 1")
def _(spark, sf):
    x = scored(spark, sf).where("p is not null").withColumn("q", clip("p", 0.01, 0.99))
    return x.groupBy("symbol").agg(r6(evaluate.brier("p", "y")).alias("raw"), r6(evaluate.brier("q", "y")).alias("clipped"))


@query("a20_brier_calibrated")
def _(spark, sf):
    """Brier score of the rows after the first 70 % of a series, raw and by the calibrator of the rows before."""
    from chronolith.operators import models

    x = scored(spark, sf).where("p is not null")
    q = models.isotonic(x).join(x.select("symbol", seconds().alias("ts_s"), "p", "y"), ["symbol", "ts_s"])
    return q.groupBy("symbol").agg(F.count(F.lit(1)).alias("n"), r6(evaluate.brier("p", "y")).alias("raw"), r6(evaluate.brier("calibrated", "y")).alias("calibrated"))


_LED = "l AS (SELECT event_id, ts, event_type AS symbol, CASE WHEN event_id % 2 = 0 THEN 'LONG' ELSE 'SHORT' END AS direction, value AS entry_price, (event_id % 41 - 20) / 10.0 AS pnl_r FROM events WHERE event_type = 'purchase')"
_LO = "(PARTITION BY symbol ORDER BY ts, event_id)"


@query("a11_trade_metrics", f"WITH {_LED}, k AS (SELECT *, sum(CASE WHEN pnl_r > 0 THEN 1 ELSE 0 END) OVER {_LO} AS won FROM l), st AS (SELECT symbol, max(n) AS m FROM (SELECT symbol, won, count(*) AS n FROM k WHERE pnl_r <= 0 GROUP BY 1, 2) GROUP BY 1) SELECT l.symbol, count(*) AS trades, {r('avg(CASE WHEN pnl_r > 0 THEN 1.0 ELSE 0 END)', 'win_rate')}, {r('sum(CASE WHEN pnl_r > 0 THEN pnl_r ELSE 0 END) / abs(sum(CASE WHEN pnl_r <= 0 THEN pnl_r ELSE 0 END))', 'profit_factor')}, {r('avg(pnl_r)', 'expectancy')}, any_value(st.m) AS max_consec_loss FROM l JOIN st USING (symbol) GROUP BY 1")
def _(spark, sf):
    m = evaluate.trade_metrics(B.ledger(spark, sf))
    return m.select("symbol", "trades", *[r6(c).alias(c) for c in ("win_rate", "profit_factor", "expectancy")], "max_consec_loss")


@query("a12_r_ratios", f"WITH {_LED} SELECT symbol, {r('avg(pnl_r) / (stddev_pop(pnl_r) + 1e-9)', 'sharpe_r')}, {r('avg(pnl_r) / (stddev_pop(CASE WHEN pnl_r < 0 THEN pnl_r END) + 1e-9)', 'sortino_r')} FROM l GROUP BY 1")
def _(spark, sf):
    m = evaluate.trade_metrics(B.ledger(spark, sf))
    return m.select("symbol", r6("sharpe_r").alias("sharpe_r"), r6("sortino_r").alias("sortino_r"))


_EQ = f"eq AS (SELECT *, 10000 + sum(pnl_r * 200) OVER {_LO} AS equity FROM l)"


@query("f43_equity_drawdown", f"WITH {_LED}, {_EQ} SELECT event_id, {r('equity', 'equity')}, {r(f'greatest(10000, max(equity) OVER {_LO})', 'peak')}, {r(f'(greatest(10000, max(equity) OVER {_LO}) - equity) / greatest(10000, max(equity) OVER {_LO})', 'drawdown')} FROM eq")
def _(spark, sf):
    return evaluate.equity(B.ledger(spark, sf)).select("event_id", r6("equity").alias("equity"), r6("peak").alias("peak"), r6("drawdown").alias("drawdown"))


@query("a11_daily_sharpe", f"""WITH {_LED}, {_EQ}, dl AS (SELECT symbol, ts::DATE AS day, last(equity ORDER BY ts, event_id) AS equity FROM eq GROUP BY 1, 2), sp AS (SELECT symbol, unnest(generate_series(min(day)::TIMESTAMP, max(day)::TIMESTAMP, interval 1 day))::DATE AS day FROM dl GROUP BY 1),
    ff AS (SELECT sp.symbol, sp.day, last_value(dl.equity IGNORE NULLS) OVER (PARTITION BY sp.symbol ORDER BY sp.day) AS e FROM sp LEFT JOIN dl ON dl.symbol = sp.symbol AND dl.day = sp.day), rt AS (SELECT symbol, e / lag(e) OVER (PARTITION BY symbol ORDER BY day) - 1 AS ret FROM ff) SELECT symbol, {r('avg(ret) / (stddev_samp(ret) + 1e-9) * sqrt(252)', 'sharpe')}, count(ret) AS days FROM rt GROUP BY 1""")
def _(spark, sf):
    return evaluate.daily_sharpe(evaluate.equity(B.ledger(spark, sf))).select("symbol", r6("sharpe").alias("sharpe"), "days")


@query("a11_under_water", f"WITH {_LED}, {_EQ}, x AS (SELECT *, max(equity) OVER (PARTITION BY symbol ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS bf FROM eq), y AS (SELECT *, last_value(CASE WHEN bf IS NULL OR equity > bf THEN ts END IGNORE NULLS) OVER {_LO} AS since FROM x) SELECT symbol, floor(max(floor(epoch(ts)) - floor(epoch(since))) / 86400)::BIGINT AS tuw_days FROM y GROUP BY 1")
def _(spark, sf):
    return evaluate.under_water(evaluate.equity(B.ledger(spark, sf)))


@query("a19_exit_surface_groups", f"WITH {_LED} SELECT direction, coalesce(bucket, 'default') AS bucket, count(*) AS samples, {r('sum(pnl_r)', 'sum_r')}, count(*) FILTER (pnl_r > 0) AS wins FROM (SELECT *, CASE WHEN entry_price < 20 THEN 'low' WHEN entry_price < 80 THEN 'mid' ELSE 'high' END AS bucket FROM l) GROUP BY GROUPING SETS ((direction, bucket), (direction))")
def _(spark, sf):
    l = B.ledger(spark, sf).withColumn("bucket", F.when(F.col("entry_price") < 20, "low").when(F.col("entry_price") < 80, "mid").otherwise("high"))
    g = l.groupingSets([["direction", "bucket"], ["direction"]], "direction", "bucket").agg(F.count(F.lit(1)).alias("samples"), r6(F.sum("pnl_r")).alias("sum_r"), F.count_if(F.col("pnl_r") > 0).alias("wins"))
    return g.withColumn("bucket", F.coalesce("bucket", F.lit("default")))


@query("i12_ledger_append", f"WITH {_LED} SELECT direction, count(*) AS n, {r('sum(pnl_r)', 'sum_r')} FROM l GROUP BY 1")
def _(spark, sf):
    return sinks.appended(B.ledger(spark, sf), "direction").groupBy("direction").agg(F.count(F.lit(1)).alias("n"), r6(F.sum("pnl_r")).alias("sum_r"))


# ---- folds and models ----------------------------------------------------------------------------------------------


@query("m1_expanding_folds", f"""{WD}, x AS (SELECT symbol, row_number() {OV} - 1 AS i, count(*) OVER (PARTITION BY symbol) AS n FROM d), s AS (SELECT DISTINCT symbol, n, greatest(floor(n * 0.15)::BIGINT, 100) AS size FROM x),
    f AS (SELECT symbol, k AS fold, 500 + k * size AS a, least(500 + (k + 1) * size, n) AS b FROM s, range(10) t(k) WHERE least(500 + (k + 1) * size, n) - (500 + k * size) >= 50)
    SELECT symbol, fold::INTEGER AS fold, part, count(*) AS n FROM (SELECT x.symbol, fold, CASE WHEN i < a - 24 THEN 'train' WHEN i >= a AND i < b THEN 'test' END AS part FROM x JOIN f ON f.symbol = x.symbol) WHERE part IS NOT NULL GROUP BY 1, 2, 3""")
def _(spark, sf):
    x = core.numbered(B.bars_1d(spark, sf)).withColumn("i", F.col("i") - 1)
    return evaluate.in_folds(x, 500, 24).groupBy("symbol", "fold", "part").agg(F.count(F.lit(1)).alias("n"))


@query("m2_purged_validation", f"{WD}, n AS (SELECT symbol, count(*) AS n FROM d GROUP BY 1), v AS (SELECT symbol, n, greatest(floor(n * 0.15)::BIGINT, 100) AS v FROM n) SELECT symbol, CASE WHEN n - v - 5 > 0 THEN n - v - 5 ELSE greatest(n - v, 0) END AS inner_train, greatest(n - v, 0) AS start FROM v")
def _(spark, sf):
    g = B.bars_1d(spark, sf).groupBy("symbol").agg(F.count(F.lit(1)).alias("n"))
    v = F.greatest(F.floor(F.col("n") * 0.15), F.lit(100))
    return g.select("symbol", F.when(F.col("n") - v - 5 > 0, F.col("n") - v - 5).otherwise(F.greatest(F.col("n") - v, F.lit(0))).alias("inner_train"), F.greatest(F.col("n") - v, F.lit(0)).alias("start"))


@query("p12_sleeve_admission", f"""WITH {_LED}, e AS (SELECT *, 1 + sum(pnl_r * 0.01) OVER (PARTITION BY direction ORDER BY ts, pnl_r ROWS UNBOUNDED PRECEDING) AS equity FROM l), k AS (SELECT *, greatest(1, max(equity) OVER (PARTITION BY direction ORDER BY ts, pnl_r ROWS UNBOUNDED PRECEDING)) AS peak FROM e),
    m AS (SELECT direction AS sleeve, count(*) AS trades, max((peak - equity) / peak) AS mdd, avg(pnl_r) / (stddev_pop(pnl_r) + 1e-9) AS sharpe, sum(CASE WHEN pnl_r > 0 THEN pnl_r ELSE 0 END) / abs(sum(CASE WHEN pnl_r <= 0 THEN pnl_r ELSE 0 END)) AS pf FROM k GROUP BY 1)
    SELECT sleeve, trades, {r('mdd', 'mdd')}, pf >= 1.25 AND sharpe >= 0.3 AND mdd <= 0.2 AND trades >= 8 AS admitted FROM m""")
def _(spark, sf):
    l = B.ledger(spark, sf)
    past = Window.partitionBy("direction").orderBy("ts", "pnl_r").rowsBetween(Window.unboundedPreceding, 0)
    e = l.withColumn("equity", 1 + F.sum(F.col("pnl_r") * 0.01).over(past)).withColumn("peak", F.greatest(F.lit(1.0), F.max("equity").over(past)))
    mdd = e.groupBy(F.col("direction").alias("symbol")).agg(F.max((F.col("peak") - F.col("equity")) / F.col("peak")).alias("mdd"))
    m = evaluate.trade_metrics(l.withColumn("symbol", F.col("direction"))).join(mdd, "symbol")
    return m.select(F.col("symbol").alias("sleeve"), "trades", r6("mdd").alias("mdd"), ((F.col("profit_factor") >= 1.25) & (F.col("sharpe_r") >= 0.3) & (F.col("mdd") <= 0.2) & (F.col("trades") >= 8)).alias("admitted"))


@query("p13_meta_candidates", f"WITH {_LED}, m AS (SELECT direction AS sleeve, event_id % 41 // 10 AS band, count(*) AS trades, avg(pnl_r) / (stddev_pop(pnl_r) + 1e-9) AS sharpe FROM l GROUP BY 1, 2) SELECT sleeve, band, trades, {r('sharpe', 'sharpe')} FROM m WHERE trades >= 25 AND NOT isnan(sharpe) AND sharpe >= 0.5")
def _(spark, sf):
    """Sleeves by direction and band of outcome, some of which pass."""
    g = B.ledger(spark, sf).groupBy(F.col("direction").alias("sleeve"), F.floor(F.col("event_id") % 41 / 10).cast("long").alias("band")).agg(F.count(F.lit(1)).alias("trades"), (F.avg("pnl_r") / (F.stddev_pop("pnl_r") + 1e-9)).alias("sharpe"))
    return g.where("trades >= 25 and not isnan(sharpe) and sharpe >= 0.5").withColumn("sharpe", r6("sharpe"))


@query("p9_synthetic_gate", f"{WH}, g AS (SELECT symbol, avg(CASE WHEN volume <= 1 THEN 1.0 ELSE 0 END) AS ratio FROM h GROUP BY 1) SELECT h.symbol, count(*) AS bars FROM h JOIN g USING (symbol) WHERE g.ratio <= 0.9 GROUP BY 1")
def _(spark, sf):
    h = B.bars_1h(spark, sf)
    g = h.groupBy("symbol").agg(F.avg((F.col("volume") <= 1).cast("double")).alias("ratio")).where("ratio <= 0.9")
    return h.join(g, "symbol", "left_semi").groupBy("symbol").agg(F.count(F.lit(1)).alias("bars"))


@query("p8_min_edge")
def _(spark, sf):
    """Labels whose long and short paths differ by at least the least edge. The paths are simulated, so there is no SQL."""
    x = labels.labelled(core.atr(B.bars_1d(spark, sf)), horizon=10).where("target_edge_r >= 0.05")
    return x.select("symbol", seconds().alias("ts_s"), r6("target_edge_r").alias("target_edge_r"))


@query("p6_skip_code", f"""{WD}, tr AS (SELECT *, greatest(high - low, abs(high - coalesce(lag(close) {OV}, close)), abs(low - coalesce(lag(close) {OV}, close))) AS tr FROM d), a AS (SELECT *, CASE WHEN count(*) {over(14)} = 14 THEN avg(tr) {over(14)} ELSE tr END AS atr14, CASE WHEN day(ts) <= 25 THEN {P} END AS p, coalesce(lead(day(ts) % 24) {OV}, 24) AS nh, ln(close / lag(close) {OV}) AS ret FROM tr), z AS (SELECT *, (ret - avg(ret) {over(63)}) / nullif(stddev_pop(ret) {over(63)}, 0) AS zz FROM a)
    SELECT z.symbol, {T}, CASE WHEN p IS NULL THEN 1 WHEN nh >= 14 THEN 2 WHEN greatest(p, 1 - p) < 0.7 THEN 3 WHEN atr14 IS NULL OR atr14 <= 0 THEN 4 WHEN abs(zz) > 2.5 THEN 5 WHEN hu.hurst < 0.45 THEN 6 ELSE 0 END AS skip_code FROM z JOIN ({SQL['f36_hurst']}) hu ON hu.symbol = z.symbol AND hu.ts_s = epoch(z.ts)::BIGINT""")
def _(spark, sf):
    x = core.atr(B.bars_1d(spark, sf)).join(B.oos(B.bars_1d(spark, sf).where("day(ts) <= 25")), ["symbol", "ts"], "left")
    x = x.withColumns({"nh": F.lead(F.day("ts") % 24, 1, 24).over(series()), "ret": F.ln(F.col("close") / F.lag("close").over(series()))})
    x = x.withColumn("z", (F.col("ret") - F.avg("ret").over(w(63))) / F.nullif(F.stddev_pop("ret").over(w(63)), F.lit(0.0)))
    return features.hurst(x).select("symbol", seconds().alias("ts_s"), skip_code().alias("skip_code"))


def skip_code(threshold: float = 0.7, gate_hour: int = 14, shock: float = 2.5, hurst: float = 0.45):
    """The first reason not to trade a bar: no prediction, end of day, confidence, ATR, shock, low Hurst figure."""
    return F.when(F.col("p").isNull(), 1).when(F.col("nh") >= gate_hour, 2).when(F.greatest("p", 1 - F.col("p")) < threshold, 3).when(F.col("atr14").isNull() | (F.col("atr14") <= 0), 4).when(F.abs("z") > shock, 5).when(F.col("hurst") < hurst, 6).otherwise(0)


@query("r3_variant_selection", f"WITH {_LED}, m AS (SELECT hour(ts) AS variant, direction AS sleeve, sum(pnl_r) AS total, count(*) AS n FROM l GROUP BY 1, 2) SELECT sleeve, variant, {r('total', 'total')} FROM m QUALIFY row_number() OVER (PARTITION BY sleeve ORDER BY total DESC, n DESC, variant) = 1")
def _(spark, sf):
    m = B.ledger(spark, sf).groupBy(F.hour("ts").cast("long").alias("variant"), F.col("direction").alias("sleeve")).agg(F.sum("pnl_r").alias("total"), F.count(F.lit(1)).alias("n"))
    best = m.groupBy("sleeve").agg(F.max(F.struct(F.round("total", 9).alias("t"), "n", (-F.col("variant")).alias("v"), "total")).alias("b"))
    return best.select("sleeve", (-F.col("b.v")).alias("variant"), r6("b.total").alias("total"))


@query("r4_registry_lookup", f"{WD}, x AS (SELECT DISTINCT symbol FROM d) SELECT symbol, coalesce(variant, 'base') AS variant FROM x LEFT JOIN (VALUES ('A', 'policy'), ('R', 'base')) v(symbol, variant) USING (symbol)")
def _(spark, sf):
    reg = spark.createDataFrame([("A", "policy"), ("R", "base")], "symbol string, variant string")
    return B.bars_1d(spark, sf).select("symbol").distinct().join(F.broadcast(reg), "symbol", "left").fillna("base", ["variant"])


@query("r5_oos_override", f"{WF}, o AS (SELECT symbol, ts, har FROM fc WHERE i % 3 = 0) SELECT fc.symbol, epoch(fc.ts)::BIGINT AS ts_s, {r('coalesce(o.har, fc.ml)', 'pred')}, o.har IS NOT NULL AS is_oos FROM fc LEFT JOIN o ON o.symbol = fc.symbol AND o.ts = fc.ts")
def _(spark, sf):
    f = forecasts(spark, sf)
    o = f.where("i % 3 = 0").select("symbol", "ts", F.col("har").alias("oos"))
    return f.join(o, ["symbol", "ts"], "left").select("symbol", seconds().alias("ts_s"), r6(F.coalesce("oos", "ml")).alias("pred"), F.col("oos").isNotNull().alias("is_oos"))


@query("r6_guardrail_compare", f"{WF}, m AS (SELECT symbol, avg(abs(actual - ml)) AS a, avg(abs(actual - har)) AS b FROM fc GROUP BY 1) SELECT symbol, 'mae' AS metric, CASE WHEN -a < -b - 0.001 THEN 'REGRESSED' ELSE 'OK' END AS verdict FROM m")
def _(spark, sf):
    m = forecasts(spark, sf).groupBy("symbol").agg(F.avg(F.abs(F.col("actual") - F.col("ml"))).alias("a"), F.avg(F.abs(F.col("actual") - F.col("har"))).alias("b"))
    now, base = (m.select("symbol", F.lit("mae").alias("metric"), (-F.col(c)).alias("value")) for c in ("a", "b"))
    return evaluate.guardrail(now, base, {"mae": 0.001}).select("symbol", "metric", "verdict")


_CELL = lambda c: f"coalesce(round({c} * 1e6)::BIGINT::VARCHAR, '~')"


@query(
    "r6_guardrail_identity",
    f"""{WF}, a AS (SELECT symbol, {_CELL('actual')} || '|' || i || '|' || {_CELL('ml')} || '|' || epoch(ts)::BIGINT AS t, 'ml' AS artifact FROM fc UNION ALL SELECT symbol, {_CELL('actual')} || '|' || {_CELL('har')} || '|' || i || '|' || epoch(ts)::BIGINT, 'har' FROM fc)
    SELECT symbol, artifact, count(*) AS rows, sum(('0x' || substr(md5(t), 1, 15))::BIGINT)::VARCHAR AS digest, CASE WHEN artifact = 'har' AND symbol = 'N' THEN 'DIFFERENT RUN' ELSE 'SAME RUN' END AS status FROM a GROUP BY 1, 2""",
)
def _(spark, sf):
    """Stored identities of two artifacts against the frames in another order, one of which has one cell changed."""
    f = forecasts(spark, sf)
    parts = lambda x: [x.select("symbol", F.lit(c).alias("artifact"), "i", seconds().alias("ts_s"), "actual", c) for c in ("ml", "har")]
    base = [evaluate.digests(p, "symbol", "artifact") for p in parts(f)]
    last = f.groupBy("symbol").agg(F.max("i").alias("last"))
    changed = f.join(last, "symbol").withColumn("har", F.when((F.col("symbol") == "N") & (F.col("i") == F.col("last")), F.col("har") + 1e-3).otherwise(F.col("har"))).orderBy(F.desc("ts"))
    now = [evaluate.digests(p, "symbol", "artifact") for p in parts(changed)]
    return evaluate.identity(now[0].unionByName(now[1]), base[0].unionByName(base[1]), "symbol", "artifact").select("symbol", "artifact", F.col("rows_base").alias("rows"), F.col("base").alias("digest"), "status")


@query("s2_top_features", f"{WD}, x AS (SELECT symbol, month(ts) AS feature, sum(volume) AS score FROM d GROUP BY 1, 2) SELECT symbol, feature, {r('score', 'score')} FROM x QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY score DESC, feature) <= 5")
def _(spark, sf):
    x = B.bars_1d(spark, sf).groupBy("symbol", F.month("ts").cast("long").alias("feature")).agg(F.sum("volume").alias("score"))
    k = F.row_number().over(Window.partitionBy("symbol").orderBy(F.desc("score"), "feature"))
    return x.withColumn("k", k).where("k <= 5").select("symbol", "feature", r6("score").alias("score"))


@query("s4_union_macro", f"{WD} SELECT tf, count(*) AS n FROM (SELECT 'W' AS tf, symbol, isoyear(ts) * 100 + weekofyear(ts) AS k FROM d UNION SELECT 'M', symbol, year(ts) * 100 + month(ts) FROM d) GROUP BY 1")
def _(spark, sf):
    d = B.bars_1d(spark, sf)
    both = core.resample(d, "1W").select(F.lit("W").alias("tf")).unionByName(core.resample(d, "1M").select(F.lit("M").alias("tf")))
    return both.groupBy("tf").agg(F.count(F.lit(1)).alias("n"))


@query("m16_forecast_confidence", f"""{WD}, {rv()}, s AS (SELECT symbol, avg(yz_log) AS mean, stddev_pop(yz_log) AS dev FROM rv GROUP BY 1), x AS (SELECT symbol, ts, least(CASE WHEN day(ts) % 2 = 0 THEN 1 ELSE 0.8 END, CASE WHEN day(ts) % 3 = 0 THEN 1 ELSE 0.85 END) AS a, {lim('1 - greatest(vov - 1, 0) / 3', .4, 1)} AS g, abs(yz_log - mean) / greatest(dev, 1e-6) AS z FROM rv JOIN s USING (symbol)), y AS (SELECT *, {lim('1 - greatest(z - 1.5, 0) / 3', .5, 1)} AS e FROM x)
    SELECT symbol, {T}, {r('a', 'availability')}, {r('g', 'regime')}, {r('e', 'extremity')}, {r('z', 'extremity_z')}, {r('least(a, g, e)', 'confidence')} FROM y""")
def _(spark, sf):
    x = features.volatility_surface(B.bars_1d(spark, sf))
    past = x.groupBy("symbol").agg(F.avg("yz_log").alias("mean"), F.stddev_pop("yz_log").alias("sd"))
    parts = evaluate.forecast_confidence(F.day("ts") % 2 == 0, F.day("ts") % 3 == 0, F.col("vov"), F.col("yz_log"), F.col("mean"), F.col("sd"))
    return x.join(past, "symbol").select("symbol", seconds().alias("ts_s"), *[r6(c).alias(n) for n, c in parts.items()])


def _digits(name: str) -> int:
    """Decimals of a payload value: prices and basis points are large."""
    return 6 if "pct" in name or "ratio" in name else 3


def _payload_sql(vol: str, tail: str, suffix: str) -> str:
    up, down, rng = (f"{n}{tail}" for n in ("up", "down", "rng"))
    up_width, down_width = (f"{n}{suffix or '_1d'}_width" for n in ("up", "down"))
    parts = {
        "annualized_vol_pct": f"(exp({vol}) - 1) * 100", "range_pct": f"(exp({rng}) - 1) * 100", "up_bps": f"(exp({up}) - 1) * 10000", "dn_bps": f"(exp({down}) - 1) * 10000",
        "projected_high": f"close * exp({up})", "projected_low": f"close / exp({down})", "projected_peak": f"close * exp({up} + {up_width})", "projected_bottom": f"close / exp({down} + {down_width})",
    }
    return ", ".join(f"round(({v})::DOUBLE, {_digits(k)}) + 0.0 AS {k}{suffix}" for k, v in parts.items())


_MEANS = ", ".join(f"avg(ln({a} / {b})) {over(n)} AS {k}{n}" for k, a, b in (("rng", "high", "low"), ("up", "high", "open"), ("down", "open", "low")) for n in (5, 22))


@query("m17_forecast_payload", f"""{WTF}, {rv()}, wd AS (SELECT split_part(symbol, '|', 1) AS symbol, {', '.join(f"max(high) FILTER (split_part(symbol, '|', 2) = '{k}') AS {k}_width" for k in ('up_1d', 'down_1d', 'up_5d', 'down_5d'))} FROM cw WHERE level = 0.9 GROUP BY 1),
    mv AS (SELECT symbol, ts, close, {_MEANS} FROM d), y AS (SELECT symbol, ts, yz_log AS vol5, avg(yz_log) {over(5)} AS vol22 FROM rv), j AS (SELECT mv.*, y.vol5, y.vol22, wd.* EXCLUDE (symbol) FROM mv JOIN y ON y.symbol = mv.symbol AND y.ts = mv.ts JOIN wd ON wd.symbol = mv.symbol)
    SELECT symbol, {T}, {_payload_sql('vol5', '5', '')}, {_payload_sql('vol22', '22', '_5d')}, {r('(exp(vol22) - 1) / greatest(exp(vol5) - 1, 1e-6)', 'vol_5d_1d_ratio')} FROM j""")
def _(spark, sf):
    x = features.volatility_surface(B.bars_1d(spark, sf)).withColumn("vol_5d", F.avg("yz_log").over(w(5)))
    logs = {"range": ("high", "low"), "up": ("high", "open"), "down": ("open", "low")}
    x = x.withColumns({f"{k}_{n}": F.avg(F.ln(F.col(a) / F.col(b))).over(w(n)) for k, (a, b) in logs.items() for n in (5, 22)})
    widths = evaluate.conformal(target_forecasts(spark, sf), pred="ml", levels=(0.9,)).withColumns({"part": F.element_at(F.split("symbol", r"\|"), -1), "symbol": F.element_at(F.split("symbol", r"\|"), 1)})
    widths = widths.groupBy("symbol").agg(*[F.max(F.when(F.col("part") == k, F.col("high"))).alias(f"{k}_width") for k in ("up_1d", "down_1d", "up_5d", "down_5d")])
    x = x.join(widths, "symbol")
    means = lambda n, days: [F.col(f"{k}_{n}") for k in logs] + [F.col(f"{k}_{days}_width") for k in ("up", "down")]
    parts = evaluate.horizon_payload(F.col("close"), F.col("yz_log"), *means(5, "1d")) | evaluate.horizon_payload(F.col("close"), F.col("vol_5d"), *means(22, "5d"), suffix="_5d")
    parts["vol_5d_1d_ratio"] = F.expm1("vol_5d") / F.greatest(F.expm1("yz_log"), F.lit(1e-6))
    return x.select("symbol", seconds().alias("ts_s"), *[(F.round(c, _digits(n)) + F.lit(0.0)).alias(n) for n, c in parts.items()])


_XY = ["har_d", "har_w", "har_m", "har_l1", "har_l2", "har_jump", "y"]
_AT = "500 + f * size"
# Centred sums of products with the target's as last column; alpha on the diagonal. Rows of lists are eliminated one after the other.
_COV = "[" + ", ".join("[" + ", ".join(f"s{min(i, j)}{max(i, j)} - m * a{i} * a{j}" + (" + 1e-4" if i == j else "") for j in range(7)) + "]" for i in range(6)) + "]"
_HX = f"""{_HAR}, h0 AS (SELECT symbol, ts, jump_ratio, dd AS har_d, avg(dd) {over(5)} AS har_w, avg(dd) {over(22)} AS har_m, coalesce(lag(dd) {OV}, 0) AS har_l1, coalesce(lag(dd, 2) {OV}, 0) AS har_l2, dd * {lim('jump_ratio', 0, 1)} AS har_jump FROM q),
{_TGT}, {_EIGHT},
x0 AS (SELECT h0.*, row_number() {OV} - 1 AS k, count(*) OVER (PARTITION BY symbol) AS n FROM h0),
x AS (SELECT x0.*, target, y, greatest(n // 10, 100) AS size FROM x0 JOIN t3 USING (symbol, ts)),
fs AS (SELECT DISTINCT symbol, n, size, f FROM x, range(9) r(f)),
g AS (SELECT x.symbol, target, f, count(*) AS m, {', '.join(f'avg({c}) AS a{i}' for i, c in enumerate(_XY))}, {', '.join(f'sum({_XY[i]} * {_XY[j]}) AS s{i}{j}' for i in range(7) for j in range(i, 7))} FROM x JOIN fs ON fs.symbol = x.symbol WHERE y IS NOT NULL AND (f = 8 OR k < {_AT.replace('size', 'fs.size')} - 5) GROUP BY 1, 2, 3),
e AS (SELECT symbol, target, f, 0 AS p, {_COV} AS w FROM g WHERE m >= 25 UNION ALL
  SELECT symbol, target, f, p + 1, list_transform(w, lambda q, i: CASE WHEN i = p + 1 THEN list_transform(q, lambda v: v / w[p + 1][p + 1]) ELSE list_transform(q, lambda v, j: v - q[p + 1] * w[p + 1][j] / w[p + 1][p + 1]) END) FROM e WHERE p < 6),
c AS (SELECT symbol, target, f, [q[7] FOR q IN w] AS b FROM e WHERE p = 6),
o AS (SELECT x.*, CASE WHEN k >= 500 AND (k - 500) // size < 8 AND least(500 + ((k - 500) // size + 1) * size, n) - (500 + (k - 500) // size * size) >= 50 THEN (k - 500) // size ELSE 8 END AS f FROM x)"""


def volatility_frame(spark, sf) -> DataFrame:
    """Daily HAR components with the eight volatility targets."""
    d = B.bars_1d(spark, sf)
    return features.har(features.volatility_surface(d)).join(features.volatility_targets(d), ["symbol", "ts"])


@query(
    "m13_har_ridge",
    f"""{WD.replace('WITH', 'WITH RECURSIVE', 1)}, {_HX} SELECT o.symbol, {T.replace('ts)', 'o.ts)')}, o.target, o.f < 8 AS oos, {r('coalesce(a6 - ' + ' - '.join(f'coalesce(b[{i + 1}], 0) * a{i}' for i in range(6)) + ' + ' + ' + '.join(f'coalesce(b[{i + 1}], 0) * o.{c}' for i, c in enumerate(_XY[:6])) + ', 0)', 'har')}
    FROM o LEFT JOIN g ON g.symbol = o.symbol AND g.target = o.target AND g.f = o.f LEFT JOIN c ON c.symbol = o.symbol AND c.target = o.target AND c.f = o.f""",
)
def _(spark, sf):
    from chronolith.operators import models

    x = models.har_ridge(volatility_frame(spark, sf), VOL)
    return x.withColumn("har", r6("har"))


@query("m11_isotonic")
def _(spark, sf):
    from chronolith.operators import models

    return models.isotonic(scored(spark, sf).where("p is not null"))


def labelled_lane(spark, sf) -> tuple[DataFrame, list[str]]:
    """Daily bars with the volatility surface and the direction label, and the names of the features."""
    d = B.bars_1d(spark, sf)
    return features.volatility_surface(d).select("symbol", "ts", *features.RV_KEYS).join(labels.labelled(core.atr(d)), ["symbol", "ts"]), list(features.RV_KEYS)


#: Rounds of the boosted queries, of trees of three levels; their rates rise in turn. The members' own rounds (500 to 800) and levels are the operators' default.
ROUNDS = 4


@query("m3_boosted_ensemble")
def _(spark, sf):
    from chronolith.operators import boosting, models

    x, names = labelled_lane(spark, sf)
    return models.ensemble(x, names, "target", models.shortened(boosting.ENSEMBLE, ROUNDS), patience=3)[0]


@query("m4_quantile_models")
def _(spark, sf):
    from chronolith.operators import boosting, models

    x, names = labelled_lane(spark, sf)
    return models.trade_plan(x, names, spec=models.shortened((boosting.TRADE_PLAN,), ROUNDS)[0], patience=3)


@query("m5_custom_objectives")
def _(spark, sf):
    from chronolith.operators import boosting, models

    return models.objectives(volatility_frame(spark, sf), list(models.HAR), "vol_1d", members=models.shortened(boosting.ENSEMBLE[:2], ROUNDS), patience=3)


@query("m6_correlation_filter")
def _(spark, sf):
    from chronolith.operators import models

    x = features.volatility_surface(B.bars_1d(spark, sf))
    keep = models.correlation_filter(x, list(features.RV_KEYS))
    return spark.createDataFrame([(i, c) for i, c in enumerate(keep)], "place int, feature string")


def wide_lane(spark, sf) -> tuple[DataFrame, list[str]]:
    """The daily volatility lane of 89 columns with the next day's targets, and the names of the features.

    Bars and lane are stored: six timeframes read the bars, and each job of a selection reads the lane.
    """
    d = B.daily(spark, sf)
    x = features.volatility_lane(d, "1D", ("1W", "1M", "3M", "6M", "12M"))
    return sinks.stored(x.join(features.volatility_targets(d), ["symbol", "ts"]), "lane"), x.columns[2:]


@query("m9_consensus_selection")
def _(spark, sf):
    from chronolith.operators import selection

    x, names = wide_lane(spark, sf)
    return selection.fold_consensus(x, names, VOL[:4], 500, 5, 0.1, 8)


@query("m10_walk_forward")
def _(spark, sf):
    from chronolith.operators import boosting, models

    x, names = labelled_lane(spark, sf)
    return models.walk_forward(x, names, "target", members=models.shortened(boosting.ENSEMBLE, ROUNDS), patience=3)[0]


@query("m24_shadow_veto")
def _(spark, sf):
    from chronolith.operators import models

    return models.shadow(B.ledger(spark, sf), B.bars_1h(spark, sf))
