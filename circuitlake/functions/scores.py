"""Scores of measured values against bounds. Two scorers are kept apart on purpose:
`partial_credit` is 0 at a bound and 1 at twice the margin, `contract` is 1 once met."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _clip(x: Column) -> Column:
    return F.greatest(F.lit(-1.0), F.least(F.lit(1.0), x))


def log_distance_min(actual: Column, bound: Column) -> Column:
    ratio = F.when((bound > 0) & (actual > 0), actual / bound)
    return F.when((bound <= 0) | (actual <= 0), F.when(actual < bound, -1.0).otherwise(1.0)).otherwise(_clip(F.log2(ratio)))


def log_distance_max(actual: Column, bound: Column) -> Column:
    """A non-positive value always scores 1, a positive one against a non-positive bound -1."""
    ratio = F.when((bound > 0) & (actual > 0), bound / actual)
    return F.when((bound <= 0) | (actual <= 0), F.when(actual <= 0, 1.0).otherwise(-1.0)).otherwise(_clip(F.log2(ratio)))


def log_distance_target(actual: Column, target: Column) -> Column:
    """1 on target, down by the octaves off target in tenths. A negative target against a
    positive value has no logarithm: null."""
    ratio = F.when((target != 0) & (actual > 0) & (actual / F.nullif(target, F.lit(0.0)) > 0), actual / F.nullif(target, F.lit(0.0)))
    return (
        F.when(target == 0, F.when(actual == 0, 1.0).otherwise(-1.0))
        .when(actual <= 0, -1.0)
        .when(ratio.isNotNull(), _clip(1.0 - F.least(F.lit(2.0), F.abs(F.log2(ratio)) / 0.1)))
    )


def partial_credit(actual: Column, low: Column, high: Column, target: Column) -> Column:
    """Precedence: range, minimum, maximum, target; a missing value scores -1, a spec without bounds 0."""
    return (
        F.when(actual.isNull(), -1.0)
        .when(low.isNotNull() & high.isNotNull(), F.least(log_distance_min(actual, low), log_distance_max(actual, high)))
        .when(low.isNotNull(), log_distance_min(actual, low))
        .when(high.isNotNull(), log_distance_max(actual, high))
        .when(target.isNotNull(), log_distance_target(actual, target))
        .otherwise(0.0)
    )


def met(actual: Column, low: Column, high: Column, target: Column, tolerance: float = 0.02) -> Column:
    bounded = F.coalesce(actual >= low, F.lit(True)) & F.coalesce(actual <= high, F.lit(True))
    on_target = F.abs(actual - target) <= F.abs(target * tolerance)
    return F.when(actual.isNull(), False).when(low.isNotNull() | high.isNotNull(), bounded).otherwise(F.coalesce(on_target, F.lit(True)))


def contract(actual: Column, low: Column, high: Column, eps: float = 1e-12) -> Column:
    """1 if met, else max(-1, log2 of the ratio); of both bounds the worse one; missing is -1."""
    e = F.lit(eps)
    low_ratio = F.when(low > 0, F.greatest(actual, e) / F.greatest(low, e)).otherwise(F.greatest(low, e) / F.greatest(actual, e))
    high_ratio = F.when(actual > 0, F.greatest(high, e) / F.greatest(actual, e)).otherwise(F.greatest(actual, e) / F.greatest(high, e))
    s_low = F.when(actual >= low, 1.0).otherwise(F.greatest(F.lit(-1.0), F.log2(low_ratio)))
    s_high = F.when(actual <= high, 1.0).otherwise(F.greatest(F.lit(-1.0), F.log2(high_ratio)))
    return (
        F.when(actual.isNull(), -1.0)
        .when(low.isNotNull() & high.isNotNull(), F.least(s_low, s_high))
        .when(low.isNotNull(), s_low)
        .when(high.isNotNull(), s_high)
        .otherwise(0.0)
    )


def margin_db(actual: Column, low: Column, high: Column) -> Column:
    """Decibels inside a single bound; null for ranges, targets and non-positive numbers."""
    ratio = F.when(low.isNotNull() & high.isNull(), actual / F.nullif(low, F.lit(0.0))).when(high.isNotNull() & low.isNull(), high / F.nullif(actual, F.lit(0.0)))
    return F.when((ratio > 0) & (actual > 0), 20 * F.log10(ratio))


def shortfall_decades(actual: Column, low: Column, high: Column, target: Column) -> Column:
    """Decades missed; linear where no logarithm exists; a target counts beyond 2 percent; null if not missed."""

    def one(x: Column) -> Column:
        return F.when(x == 0, 1.0).otherwise(F.abs(x))

    below = F.when((actual > 0) & (low > 0), F.log10(low / F.nullif(actual, F.lit(0.0)))).otherwise(F.abs(low - actual) / one(low))
    above = F.when((actual > 0) & (high > 0), F.log10(actual / F.nullif(high, F.lit(0.0)))).otherwise(F.abs(actual - high) / one(high))
    off = F.abs(actual - target) / F.nullif(F.abs(target), F.lit(0.0))
    miss = F.when(actual < low, below).when(actual > high, above).when((target != 0) & (off > 0.02), off)
    return F.when(miss > 0, miss)


def weighted_mean(score: Column, weight: Column) -> Column:
    """Aggregate: sum(score * weight) / sum(weight); 0 for no rows or no weight."""
    return F.coalesce(F.try_divide(F.sum(score * weight), F.sum(weight)), F.lit(0.0))
