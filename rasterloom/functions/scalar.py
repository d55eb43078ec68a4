"""Pixel expressions with the engine's invalid-value rules."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

INF = float("inf")


def ln(v: Column) -> Column:
    """Natural logarithm: minus infinity at 0, invalid below."""
    return F.when(v == 0, F.lit(-INF)).when(v > 0, F.log(v))


UNARY = {
    "negate": lambda v: -v,
    "inverse": lambda v: F.try_divide(F.lit(1.0), v),
    "sign": lambda v: F.signum(v),
    "absolute": lambda v: F.abs(v),
    "natural_logarithm": ln,
    "natural_exponential": lambda v: F.exp(v),
    "squared_norm": lambda v: v * v,
    "conjugate": lambda v: v,
    "fill_0": lambda v: F.when(v.isNotNull(), F.lit(0.0)),
    "fill_1": lambda v: F.when(v.isNotNull(), F.lit(1.0)),
    "pass": lambda v: v,
}


def _both(a: Column, b: Column, value: Column) -> Column:
    return F.when(a.isNotNull() & b.isNotNull(), value)


BINARY = {
    "offset": lambda a, b: a + b,
    "scale": lambda a, b: a * b,
    "power": lambda a, b: F.nanvl(F.pow(a, b), F.lit(None).cast("double")),
    "max": lambda a, b: _both(a, b, F.greatest(a, b)),
    "min": lambda a, b: _both(a, b, F.least(a, b)),
    "upper_pass": lambda a, b: F.when(a < b, None).otherwise(a),
    "lower_pass": lambda a, b: F.when(b < a, None).otherwise(a),
}


def complex_product(a: tuple[Column, Column], b: tuple[Column, Column]) -> tuple[Column, Column]:
    return a[0] * b[0] - a[1] * b[1], a[0] * b[1] + a[1] * b[0]


def modulus(re: Column, im: Column) -> Column:
    return F.hypot(re, im)


def lab(r: Column, g: Column, b: Column) -> tuple[Column, Column, Column]:
    """Lightness and two opponent axes of linear colour."""
    return (r + g + b) / 3, (r - g) / F.sqrt(F.lit(2.0)), (r + g - 2 * b) / F.sqrt(F.lit(6.0))


def rgb(light: Column, a: Column, b: Column) -> tuple[Column, Column, Column]:
    """The inverse of lab."""
    p, q = a / F.sqrt(F.lit(2.0)), b / F.sqrt(F.lit(6.0))
    return light + p + q, light - p + q, light - 2 * q


def soft_threshold(c: Column, t: Column | float) -> Column:
    return F.signum(c) * F.greatest(F.abs(c) - t, F.lit(0.0))


def angular_distance(ra1: Column, dec1: Column, ra2: Column, dec2: Column) -> Column:
    """Great-circle distance in degrees (haversine)."""
    half = lambda a, b: F.pow(F.sin(F.radians(a - b) / 2), 2)
    h = half(dec1, dec2) + F.cos(F.radians(dec1)) * F.cos(F.radians(dec2)) * half(ra1, ra2)
    return F.degrees(2 * F.asin(F.sqrt(F.least(F.lit(1.0), h))))


def gnomonic(ra: Column, dec: Column, ra0: Column, dec0: Column) -> tuple[Column, Column, Column]:
    """Tangent-plane coordinates in degrees, and the cosine of the distance (not positive: beyond the horizon)."""
    a, d, d0 = F.radians(ra - ra0), F.radians(dec), F.radians(dec0)
    c = F.sin(d0) * F.sin(d) + F.cos(d0) * F.cos(d) * F.cos(a)
    xi = F.degrees(F.try_divide(F.cos(d) * F.sin(a), c))
    eta = F.degrees(F.try_divide(F.cos(d0) * F.sin(d) - F.sin(d0) * F.cos(d) * F.cos(a), c))
    return xi, eta, c


def gnomonic_inverse(xi: Column, eta: Column, ra0: Column, dec0: Column) -> tuple[Column, Column]:
    """Sky position in degrees of tangent-plane coordinates in degrees."""
    x, y, d0 = F.radians(xi), F.radians(eta), F.radians(dec0)
    down = F.cos(d0) - y * F.sin(d0)
    ra = F.pmod(ra0 + F.degrees(F.atan2(x, down)), F.lit(360.0))
    return ra, F.degrees(F.atan2(F.sin(d0) + y * F.cos(d0), F.hypot(x, down)))


def quantise(v: Column, low: float, end: float, top: int) -> Column:
    """Levels 0 to top of a half-open display range; invalid values become 0."""
    factor = (top + 1) / (end - low) if end != low else float(top + 1)
    return F.least(F.lit(top), F.greatest(F.lit(0), F.bround(F.coalesce((v - low) * factor, F.lit(0.0)), 0).cast("int")))
