"""Scalar math with explicit answers for null, NaN, zero and infinity. All stay in codegen."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

INF = float("inf")


def number(x) -> Column:
    return x if isinstance(x, Column) else F.lit(x)


def is_finite(x: Column) -> Column:
    """False for null, NaN and infinities."""
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(INF))


def db20(magnitude: Column, floor: float | None = None) -> Column:
    """20 log10 |m|; exactly zero is -inf, NaN and null pass; an optional floor bounds it below."""
    m = F.abs(magnitude)
    out = F.when(m == 0, F.lit(-INF)).otherwise(20 * F.log10(m))
    return out if floor is None else F.when(F.isnan(out), out).otherwise(F.greatest(out, F.lit(float(floor))))


def significant(x: Column, digits: int = 6) -> Column:
    """Rounded to significant digits; zero stays zero, non-finite gives null (JSON has no such numbers)."""
    text = F.format_string(f"%.{digits - 1}e", x)
    return F.when(is_finite(x), F.when(x == 0, F.lit(0.0)).otherwise(text.try_cast("double")))


def unwrap_step(delta: Column) -> Column:
    """Phase step in degrees brought into [-180, 180]; exactly +-180 stays."""
    return (
        F.when(delta > 180, delta - 360 * F.ceil((delta - 180) / 360))
        .when(delta < -180, delta - 360 * F.floor((delta + 180) / 360))
        .otherwise(delta)
    )


def bode_phase(slope_db_per_decade: Column) -> Column:
    """Phase estimate of a minimum-phase response: 4.5 degrees for each dB per decade."""
    return 4.5 * slope_db_per_decade


def inverse_interpolate(x0: Column, x1: Column, y0: Column, y1: Column, level: Column, log_x: bool = False) -> Column:
    """x where the segment meets the level; a flat segment gives x0. With log_x the
    interpolation runs in log10(x) where both ends are positive."""
    share = (level - y0) / F.nullif(y1 - y0, F.lit(0.0))
    linear = x0 + share * (x1 - x0)
    if log_x:
        bent = F.pow(F.lit(10.0), F.log10(x0) + share * (F.log10(x1) - F.log10(x0)))
        linear = F.when((x0 > 0) & (x1 > 0), bent).otherwise(linear)
    return F.when(y1 == y0, x0).otherwise(linear)


def crosses(y0: Column, y1: Column, level: Column) -> tuple[Column, Column]:
    """(falling, rising): whether a segment reaches the level; NaN, null and flat segments do neither."""
    real = y0.isNotNull() & y1.isNotNull() & ~F.isnan(y0) & ~F.isnan(y1)
    return real & (y0 >= level) & (level >= y1) & (y0 > y1), real & (y0 <= level) & (level <= y1) & (y0 < y1)


def log_encode(x: Column) -> Column:
    return F.log10(F.greatest(x, F.lit(1e-300)))


def log_decode(x: Column) -> Column:
    return F.pow(F.lit(10.0), x)


def token_estimate(chars: Column) -> Column:
    """Characters over four, rounded down."""
    return F.floor(chars / 4).cast("long")


def transconductance(kp: Column, w: Column, length: Column, current: Column) -> Column:
    return F.sqrt(2 * kp * (w / length) * current)


def mismatch_sigma(avt: Column, w_um: Column, l_um: Column) -> Column:
    return avt / F.sqrt(w_um * l_um)
