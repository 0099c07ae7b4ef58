"""Normalisers to 0..100, component scores renormalised over what was measured, and the alpha score."""

from __future__ import annotations

import sys

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _clamp(x: Column) -> Column:
    sound = x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    return F.when(sound, F.least(F.greatest(x, F.lit(0.0)), F.lit(100.0)))


def _turned(x: Column, falling: bool) -> Column:
    inside = _clamp(x)
    return 100 - inside if falling else inside


def min_max(x: Column, low: float, high: float, falling: bool = False) -> Column:
    """Position between low and high; null if these don't rise."""
    return _turned((x - low) / (high - low) * 100, falling) if high > low else F.lit(None).cast("double")


def log_scale(x: Column, low: float, high: float, falling: bool = False) -> Column:
    """Position between low and high on a log scale; values are floored at low, high is at least ten times low."""
    low = max(low, sys.float_info.epsilon)
    high = max(high, 10 * low)
    floored = F.when(x.isNotNull(), F.greatest(x, F.lit(low)))
    return _turned((F.log10(floored) - F.log10(F.lit(low))) / (F.log10(F.lit(high)) - F.log10(F.lit(low))) * 100, falling)


def bounded_ratio(x: Column, neutral: float, saturate: float, middle: float = 50.0, falling: bool = False) -> Column:
    """``middle`` at neutral, 0 at 0, 100 at saturate, linear in between; a negative ratio is unmeasurable."""
    if not 0 < neutral < saturate:
        return F.lit(None).cast("double")
    rising = F.when(x >= neutral, middle + (x - neutral) / (saturate - neutral) * (100 - middle)).otherwise(x / neutral * middle)
    return F.when(x >= 0, _turned(rising, falling))


#: Features of each component: weight, normaliser and its bounds (fixed values).
COMPONENTS = {
    "liquidity": {
        "liquidity_usd": (0.4, log_scale, 1_000, 1_000_000),
        "liquidity_growth": (0.2, min_max, -0.5, 1),
        "liquidity_stability": (0.2, min_max, 0, 1),
        "mc_liquidity": (0.2, log_scale, 1, 100, True),
    },
    "momentum": {
        "acceleration": (0.4, bounded_ratio, 1, 5),
        "buy_sell_ratio": (0.3, bounded_ratio, 1, 3),
        "velocity": (0.2, log_scale, 0.1, 50),
        "buyer_growth": (0.1, bounded_ratio, 1, 3),
    },
    "holder": {
        "holder_count": (0.3, log_scale, 10, 2_000),
        "holder_growth": (0.3, min_max, 0, 20),
        "top10_concentration": (0.25, min_max, 0.1, 0.8, True),
        "holder_retention": (0.15, min_max, 0, 1),
    },
    "smart_money": {
        "smart_count": (0.5, min_max, 0, 5),
        "smart_recency": (0.2, min_max, 0, 60, True),
        "smart_quality": (0.3, min_max, 0, 100),
    },
}
#: Weights of the components in the first strategy, and points taken off at most (fixed values).
WEIGHTS = {"liquidity": 0.2, "momentum": 0.3, "holder": 0.2, "smart_money": 0.3}
PENALTIES = {"cluster_concentration": (25, min_max, 0.1, 0.6)}


def component(parts: list[tuple[Column, float]], policy: str = "renormalize") -> tuple[Column, Column]:
    """A component's score and its measured share of weight.

    Nulls are left out of score and weight (renormalize) or count as 50 (neutral) or 0 (zero). Sums are written
    out in the order of the parts, so that doubles add up alike everywhere.
    """
    total, weight, whole = F.lit(0.0), F.lit(0.0), sum(w for _, w in parts)
    for x, w in parts:
        total = total + F.when(x.isNotNull(), x * w).otherwise({"neutral": 50.0 * w}.get(policy, 0.0))
        weight = weight + F.when(x.isNotNull(), F.lit(w)).otherwise(0.0)
    score = F.when(weight > 0, total / weight) if policy == "renormalize" else total / whole
    return score, weight / whole


def penalty(severity: Column, most: float) -> Column:
    return F.coalesce(severity, F.lit(0.0)) / 100 * most


def alpha(components: list[tuple[Column, float]], penalties: Column) -> tuple[Column, Column]:
    """Score in 0..100 and coverage (weight of the components that have a score)."""
    total, coverage = F.lit(0.0), F.lit(0.0)
    for x, w in components:
        total = total + F.when(x.isNotNull(), x * w).otherwise(0.0)
        coverage = coverage + F.when(x.isNotNull(), F.lit(w)).otherwise(0.0)
    base = F.when(coverage > 0, F.try_divide(total, coverage)).otherwise(0.0)
    return F.coalesce(_clamp(base - penalties), F.lit(0.0)), coverage


def strategy(rows: DataFrame, policy: str = "renormalize") -> DataFrame:
    """Rows with the first strategy's components, score and coverage over the sixteen features.

    Each step reads columns of the step before: in one expression, every feature would be written out hundreds of times.
    """
    scaled = {f"_{c}": kind(F.col(c), *bounds) for parts in [*COMPONENTS.values(), PENALTIES] for c, (_, kind, *bounds) in parts.items()}
    found = {name: component([(F.col(f"_{c}"), w) for c, (w, *_) in parts.items()], policy)[0] for name, parts in COMPONENTS.items()}
    off = F.lit(0.0)
    for c, (most, *_) in PENALTIES.items():
        off = off + penalty(F.col(f"_{c}"), most)
    score, coverage = alpha([(F.col(name), w) for name, w in WEIGHTS.items()], off)
    return rows.withColumns(scaled).withColumns(found).withColumns({"score": score, "coverage": coverage}).drop(*scaled)
