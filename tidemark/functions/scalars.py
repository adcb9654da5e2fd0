"""Scalar functions as Column expressions, all inside code generation."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x) -> Column:
    return x if isinstance(x, Column) else F.lit(x)


def z_score(cons, n) -> Column:
    """How far a hit rate is from chance; n <= 0: 0."""
    return F.when(_c(n) > 0, (_c(cons) - 0.5) / F.sqrt(F.lit(0.25) / _c(n))).otherwise(0.0)


def expected_max_z(searched) -> Column:
    return F.sqrt(2 * F.ln(F.greatest(_c(searched), F.lit(2)).cast("double")))


def deflation(cons, n, searched) -> Column:
    z, chance = z_score(cons, n), expected_max_z(searched)
    excess = F.greatest(z - chance, F.lit(0.0))
    return F.when(z > 0, F.try_divide(excess, excess + chance)).otherwise(0.0)


def deflated_confidence(n, cons, depth, decades, searched) -> Column:
    base = F.least(F.lit(1.0), _c(n) / 12.0) * _c(cons) * F.pow(F.lit(0.85), _c(depth)) * F.least(F.lit(1.0), _c(decades) / 4.0)
    return F.bround(100 * base * deflation(cons, n, searched))


def confidence_label(score) -> Column:
    return F.when(_c(score) >= 70, "high").when(_c(score) >= 40, "moderate").otherwise("low / likely mined")


def compute_confidence(n, p_positive, analog_p, regime_p, density, unknown, shift, intraday, concentrated) -> Column:
    """0..1: sample size, consistency, the two models' agreement (0.6 if one is missing) and density, less penalties."""
    agree = F.coalesce(1 - F.abs(_c(analog_p) - _c(regime_p)), F.lit(0.6))
    gain = F.least(F.lit(1.0), _c(n) / 40.0) * F.greatest(_c(p_positive), 1 - _c(p_positive)) * agree * _c(density)
    flag = lambda c, w: F.when(_c(c), w).otherwise(0.0)
    penalty = flag(unknown, 0.10) + flag(shift, 0.15) + flag(intraday, 0.15) + flag(concentrated, 0.20)
    return F.greatest(F.lit(0.0), F.least(F.lit(100.0), F.bround(100 * gain - 100 * penalty))) / 100


def forecast_confidence_label(score, concentrated) -> Column:
    return F.when((_c(score) >= 0.7) & ~_c(concentrated), "high").when(_c(score) >= 0.4, "moderate").otherwise("low")


def is_concentrated(regimes, first, last) -> Column:
    return (_c(regimes) < 2) | (F.datediff(_c(last), _c(first)) < 365)


# Labels of a forecast and the votes they stand for.
LABEL_VOTES = {
    "no_reliable_signal": "WAIT",
    "hold_no_change": "WAIT",
    "watch_for_confirmation": "WAIT",
    "reduce_defensive_candidate": "AVOID",
    "moderate_long_candidate": "BUY",
    "high_conviction_long_candidate": "BUY",
}


def recommendation(n, p_positive, mae, label) -> Column:
    """One of LABEL_VOTES: by sample and confidence first, then by edge, its sign and the expected adverse excursion."""
    edge, p, deep = _c(p_positive) - 0.5, _c(p_positive), F.coalesce(_c(mae), F.lit(0.0))
    weak = (_c(n) < 8) | (_c(label) == "low")
    defensive = (edge < 0) & ((p <= 0.4) | (deep < -0.08))
    strong = (_c(label) == "high") & (p >= 0.62) & (deep > -0.08)
    rules = [(weak, "no_reliable_signal"), (F.abs(edge) < 0.05, "hold_no_change"), (defensive, "reduce_defensive_candidate"), (edge < 0, "watch_for_confirmation"),
             (strong, "high_conviction_long_candidate"), (p >= 0.55, "moderate_long_candidate")]
    out = F.when(*rules[0])
    for rule in rules[1:]:
        out = out.when(*rule)
    return out.otherwise("watch_for_confirmation")


def dip_verdict(n, edge, mae, mined) -> Column:
    return F.when(_c(mined) | (_c(n) < 8), "INSUFFICIENT_EVIDENCE").when((_c(edge) <= -0.08) | (_c(mae) < -0.12), "AVOID").when(_c(edge) >= 0.08, "BUY").otherwise("WAIT")


def percentile_state(pct) -> Column:
    """hot or warm above the middle, cooling below it, else normal; null: insufficient_history."""
    stretch, high = F.abs(_c(pct) - 50) * 2, _c(pct) >= 50
    return F.when(_c(pct).isNull(), "insufficient_history").when(high & (stretch >= 90), "hot").when(high & (stretch >= 60), "warm").when(~high & (stretch >= 60), "cooling").otherwise("normal")


def strength_confidence(n, pr, near_term) -> Column:
    base = F.least(F.lit(1.0), _c(n) / 12.0) * (0.5 + 0.5 * F.abs(_c(pr) - 50) / 50) * 100
    return F.when(_c(near_term), base * 0.7).otherwise(base)


def opportunity_score(excess, mae, q20, q80, drift, conf) -> Column:
    zero = lambda c: F.coalesce(_c(c), F.lit(0.0))
    return zero(excess) - F.abs(zero(mae)) - 0.5 * (zero(q80) - zero(q20)) - 0.0015 - 0.15 * zero(drift) + 0.2 * zero(conf)


def return_per_vol(q50, vol, h) -> Column:
    return F.try_divide(_c(q50), _c(vol) * F.sqrt(_c(h) / 252.0))


def ood(dist, dims: int = 15) -> tuple[Column, Column]:
    """(whether the distance is out of distribution, density)."""
    limit = dims**0.5
    return _c(dist) > limit, F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - _c(dist) / (2 * limit)))


def brier(p, hit) -> Column:
    return F.pow(_c(p) - F.when(_c(hit), 1.0).otherwise(0.0), 2)


def log_loss(p, hit) -> Column:
    clipped = F.greatest(F.lit(1e-6), F.least(F.lit(1 - 1e-6), _c(p)))
    return -F.when(_c(hit), F.ln(clipped)).otherwise(F.ln(1 - clipped))


def interval_covered(ret, q20, q80) -> Column:
    return F.when(_c(q20).isNull() | _c(q80).isNull(), F.lit(None)).otherwise(_c(ret).between(_c(q20), _c(q80)))


def credit_blowout(level, jump) -> Column:
    return F.coalesce((_c(level) >= 8) | (_c(jump) >= 1.5), F.lit(False))


def needs_rebaseline(drift, days) -> Column:
    return (F.abs(_c(drift)) >= 0.10) | (_c(days) >= 63)


def ordinal(n) -> Column:
    suffix = F.when((_c(n) % 100).isin(11, 12, 13), "th").when(_c(n) % 10 == 1, "st").when(_c(n) % 10 == 2, "nd").when(_c(n) % 10 == 3, "rd").otherwise("th")
    return F.concat(_c(n).cast("string"), suffix)


def write_id(op: str, *parts: Column) -> Column:
    """op:first 16 hex digits of a SHA-256 over the parts; nulls are empty, not skipped."""
    joined = F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts])
    return F.concat(F.lit(f"{op}:"), F.substring(F.sha2(joined, 256), 1, 16))


def seed60(*parts: Column) -> Column:
    """A deterministic 60-bit seed of the joined parts."""
    joined = F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts])
    return F.conv(F.substring(F.sha2(joined, 256), 1, 15), 16, 10).cast("bigint")


def positioning_net(long, short, interest) -> Column:
    return F.when(_c(interest) > 0, (_c(long) - _c(short)) / _c(interest))


def missing_fields(row_fields: dict[str, Column]) -> Column:
    """Names of required fields that are null or empty."""
    return F.filter(F.array(*[F.when(c.isNull() | (c.cast("string") == ""), F.lit(n)) for n, c in row_fields.items()]), lambda x: x.isNotNull())


def vote_of_label(label) -> Column:
    return F.coalesce(F.create_map(*[F.lit(x) for kv in LABEL_VOTES.items() for x in kv])[_c(label)], F.lit("WAIT"))


def vote_value(vote) -> Column:
    return F.when(_c(vote) == "BUY", 1.0).when(_c(vote) == "AVOID", -1.0).when(_c(vote) == "WAIT", 0.0)


def trend_vote(trend) -> Column:
    return F.when(_c(trend) == "uptrend", "BUY").when(_c(trend) == "downtrend", "AVOID").otherwise("WAIT")


def trough_vote(likely_trough_pct) -> Column:
    """By the depth still expected, in percent: over 10 AVOID, under 3 BUY, between or unknown WAIT."""
    depth = F.greatest(F.lit(0.0), -_c(likely_trough_pct))
    return F.when(_c(likely_trough_pct).isNull(), "WAIT").when(depth > 10, "AVOID").when(depth < 3, "BUY").otherwise("WAIT")


def strength_vote(flagged, n, pct_reverted, giveback) -> Column:
    sure = (_c(n) > 0) & (_c(pct_reverted) > 50) & (_c(giveback) < 0)
    return F.when(~_c(flagged), "BUY").when(sure, "AVOID").otherwise("WAIT")


def technicals_vote(reclaim, strong, signature, supply_distance) -> Column:
    near = F.coalesce(_c(supply_distance) < 6, F.lit(False))
    buying = _c(signature) == "accumulation"
    return F.when(_c(reclaim) & _c(strong) & buying, "BUY").when(near & ~buying, "WAIT").when(_c(signature) == "distribution", "AVOID").otherwise("WAIT")


def gate_count(signature, reclaim, supply_distance) -> Column:
    """How many of accumulation, reclaim and clear of supply (further than 6%, or none) hold."""
    clear = F.coalesce(_c(supply_distance) > 6, F.lit(True))
    return sum((F.when(g, 1).otherwise(0) for g in (_c(signature) == "accumulation", _c(reclaim), clear)), F.lit(0))


def scenario_confidence(n) -> Column:
    return F.least(F.lit(0.7), 0.7 * _c(n) / 10)


def mix_weight(n) -> Column:
    return 100 * F.least(F.lit(1.0), _c(n) / 10)
