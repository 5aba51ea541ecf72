"""Policies on predictions: the feature record of four lanes, scoring and its effect on a signal, trade plans, the next bar."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronolith.functions.exprs import clean, clip, col

# Lane columns that a record takes over under another name, and its term spreads by lane.
FILTER = {"policy_kf_regime": "kf_regime", "policy_kf_bar_delta": "kf_bar_delta", "policy_kf_swing_accum": "kf_swing_accum", "policy_kf_net_swing_delta": "kf_net_swing_delta"}
STORY = {
    "policy_nc_regime_streak": "nc_regime_streak", "policy_nc_regime_accel": "nc_regime_accel", "policy_nc_cum_disp": "nc_cum_disp_since_flip", "policy_nc_max_dd": "nc_max_dd_since_flip",
    "policy_nc_swing_count": "nc_swing_count_since_flip", "policy_nc_fib_age": "nc_fib_range_age", "policy_nc_fib_size": "nc_fib_range_size", "policy_nc_cross_sum": "nc_cross_tf_sum", "policy_nc_cross_abs": "nc_cross_tf_abs",
}
SURFACE = {"policy_primary_rv_z": "yz_z", "policy_primary_rv_vov": "vov", "policy_primary_rv_jump_ratio": "jump_ratio", "policy_primary_rv_range_eff": "range_eff"}
TERMS = {"1H": ("rv_term_1d_1h", "rv_term_1w_1h"), "1D": ("rv_term_1w_1d", "rv_term_1m_1d")}
RECORD = (
    "policy_prob_up", "policy_prob_down", "policy_base_confidence", "policy_base_edge", "policy_gate_margin", "policy_direction_sign", "policy_basis_z", "policy_basis_z_abs",
    "policy_kf_regime", "policy_abs_kf_regime", "policy_signed_kf_regime", "policy_kf_bar_delta", "policy_kf_swing_accum", "policy_kf_net_swing_delta",
    "policy_nc_regime_streak", "policy_nc_regime_accel", "policy_signed_nc_regime_accel", "policy_nc_cum_disp", "policy_nc_max_dd", "policy_nc_swing_count", "policy_nc_fib_age", "policy_nc_fib_size",
    "policy_nc_cross_sum", "policy_nc_cross_abs", "policy_signed_nc_cross_sum", "policy_primary_rv_z", "policy_primary_rv_vov", "policy_primary_rv_jump_ratio", "policy_primary_rv_range_eff", "policy_term_fast", "policy_term_slow",
)
#: Bounds of a plan's stop, near target, far target and trail, from a template and from models; the plan without either, in ATR.
TEMPLATE_BOUNDS = ((0.35, 2.5), (0.5, 8.0), (1.0, 12.0), (0.3, 4.0))
MODEL_BOUNDS = ((0.35, 1.5), (0.5, 4.0), (1.0, 7.0), (0.4, 1.5))
FALLBACK = (1.25, 1.25, 2.5, 1.0)


def met(*frames: DataFrame) -> DataFrame:
    """Frames of (symbol, ts, columns of their own) side by side, by one exchange on (symbol, ts); rows that only some have keep nulls. At most a row of each frame for a time."""
    both = None
    for k, f in enumerate(frames):
        part = f.select("symbol", "ts", F.struct(*[c for c in f.columns if c not in ("symbol", "ts")]).alias(f"__{k}"))
        both = part if both is None else both.unionByName(part, allowMissingColumns=True)
    rows = both.groupBy("symbol", "ts").agg(*[F.first(f"__{k}", True).alias(f"__{k}") for k in range(len(frames))])
    return rows.select("symbol", "ts", *[f"__{k}.*" for k in range(len(frames))])


def record(predictions: DataFrame, filters: DataFrame, story: DataFrame, surface: DataFrame, lane: str = "1D", threshold: float = 0.7, basis: str | None = None) -> DataFrame:
    """The 31 columns of RECORD for each prediction (symbol, ts, p); what a lane lacks or isn't finite is 0."""
    prefix = f"rv_{lane.lower()}_"
    fast, slow = TERMS[lane]
    x = met(
        predictions.select("symbol", "ts", "p", *([F.col(basis).alias("__basis")] if basis else [])),
        filters.select("symbol", "ts", *FILTER.values()),
        story.select("symbol", "ts", *STORY.values()),
        surface.select("symbol", "ts", *[prefix + c for c in SURFACE.values()], fast, slow),
    ).where("p is not null")
    zero = lambda c: F.coalesce(clean(F.col(c).cast("double")), F.lit(0.0))
    p = F.col("p")
    x = x.withColumns({n: zero(c) for n, c in (FILTER | STORY | {n: prefix + c for n, c in SURFACE.items()}).items()})
    sign = F.when(p > 0.5, 1.0).otherwise(-1.0)
    confidence = F.greatest(p, 1 - p)
    x = x.withColumns(
        {
            "policy_prob_up": clip(p, 0, 1), "policy_prob_down": clip(1 - p, 0, 1), "policy_base_confidence": confidence, "policy_base_edge": F.abs(p - 0.5) * 2, "policy_gate_margin": confidence - threshold,
            "policy_direction_sign": sign, "policy_basis_z": zero("__basis") if basis else F.lit(0.0), "policy_abs_kf_regime": F.abs("policy_kf_regime"), "policy_signed_kf_regime": sign * F.col("policy_kf_regime"),
            "policy_signed_nc_regime_accel": sign * F.col("policy_nc_regime_accel"), "policy_signed_nc_cross_sum": sign * F.col("policy_nc_cross_sum"), "policy_nc_cross_abs": F.abs("policy_nc_cross_abs"),
            "policy_term_fast": zero(fast), "policy_term_slow": zero(slow),
        }
    ).withColumn("policy_basis_z_abs", F.abs("policy_basis_z"))
    return x.select("symbol", "ts", *RECORD)


def scorecard(weights: dict[str, float], base: float = 0.5) -> Column:
    """A linear score of a record; a boosted model's prediction does as well."""
    return sum((F.col(c) * w for c, w in weights.items()), F.lit(base))


def verdict(score: Column, threshold: float, bands: tuple[tuple[float, float], ...], strong: Column) -> dict[str, Column]:
    """What a policy makes of a signal. bands: (least score, risk multiplier), the first that fits counts; a null score lets the signal pass."""
    s = clip(score, 0, 1)
    allowed = F.coalesce(s >= threshold, F.lit(True))
    risk = F.lit(1.0)
    for least, times in reversed(bands):
        risk = F.when(s >= least, times).otherwise(risk)
    return {
        "policy_score": s, "policy_threshold": F.when(s.isNotNull(), F.lit(threshold)), "policy_allowed": allowed, "policy_risk_mult": F.when(s.isNull(), 1.0).when(~allowed, 0.0).otherwise(risk),
        "policy_filtered": strong & ~allowed, "signal_strength": F.when(strong & allowed, "STRONG").otherwise("NO_TRADE"),
    }


def next_bar(raw: Column, calibrated: Column | None = None, vov: Column | None = None, regime: Column | None = None, threshold: float = 0.7) -> dict[str, Column]:
    """Direction, confidence and signal of a score; stirred-up or flat regimes cost confidence, which is 0.5 at least."""
    score = clip(raw, 0, 1)
    p = clip(calibrated, 0, 1) if calibrated is not None else score
    penalty = F.lit(0.0)
    if vov is not None:
        penalty = penalty + F.when(F.abs(clean(vov)) > 2.0, 0.03).otherwise(0.0)
    if regime is not None:
        penalty = penalty + F.when(F.abs(clean(regime)) < 0.1, 0.02).otherwise(0.0)
    confidence = F.greatest(F.lit(0.5), F.greatest(p, 1 - p) - penalty)
    return {"direction": F.when(p > 0.5, "UP").otherwise("DOWN"), "confidence": confidence, "strong": confidence >= threshold, "raw_score": score, "calibrated_score": p, "regime_penalty": penalty}


def trade_plan(direction: Column, close: Column, atr: Column, template: tuple[Column, Column, Column, Column] | None = None, models: tuple[Column, Column, Column] | None = None) -> dict[str, Column]:
    """Levels of a trade: by a template (stop, near, far, trail), by models (stop, near, far), or the plain plan where these are null. Null without a direction or a range."""
    plain = [F.lit(v) for v in FALLBACK]
    sources = []
    if template is not None:
        given = [F.coalesce(template[0], F.lit(FALLBACK[0]))]
        stop = clip(given[0], *TEMPLATE_BOUNDS[0])
        near = clip(F.coalesce(template[1], stop), *TEMPLATE_BOUNDS[1])
        sources.append((template[0].isNotNull(), [stop, near, clip(F.coalesce(template[2], near), *TEMPLATE_BOUNDS[2]), clip(F.coalesce(template[3], stop), *TEMPLATE_BOUNDS[3])], "template"))
    if models is not None:
        stop = clip(models[0], *MODEL_BOUNDS[0])
        near = F.greatest(clip(models[1], *MODEL_BOUNDS[1]), stop)
        sources.append((models[0].isNotNull() & models[1].isNotNull() & models[2].isNotNull(), [stop, near, F.greatest(clip(models[2], *MODEL_BOUNDS[2]), near + 0.25), clip(stop, *MODEL_BOUNDS[3])], "models"))
    chosen, note = plain, F.lit("plain")
    for known, values, name in reversed(sources):
        chosen = [F.when(known, v).otherwise(c) for v, c in zip(values, chosen)]
        note = F.when(known, name).otherwise(note)
    ok = direction.isin("UP", "DOWN") & (atr > 0)
    sign = F.when(direction == "UP", 1.0).otherwise(-1.0)
    stop, near, far, trail = (F.when(ok, c) for c in chosen)
    return {
        "sl": close - sign * atr * stop, "tp1": close + sign * atr * near, "tp2": close + sign * atr * far,
        "stop_atr": stop, "tp1_atr": near, "tp2_atr": far, "trail_r": trail, "note": F.when(ok, note).otherwise("none"),
    }
