"""Directions and scaling as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def uv(deg: Column) -> Column:
    """struct(u, v): sine and cosine of a direction in degrees."""
    return F.struct(F.sin(F.radians(deg)).alias("u"), F.cos(F.radians(deg)).alias("v"))


def degrees_from_uv(u: Column, v: Column) -> Column:
    """Direction in [0, 360)."""
    return F.pmod(F.degrees(F.atan2(u, v)), F.lit(360.0))


def turn_convention(deg: Column) -> Column:
    """Nautical to mathematical degrees and back: the rule is its own inverse."""
    return F.pmod(F.lit(90.0) - deg, F.lit(360.0))


def circular_gap(a: Column, b: Column, period: float = 360.0) -> Column:
    """Least distance on a circle."""
    d = F.pmod(F.abs(a - b), F.lit(period))
    return F.least(d, F.lit(period) - d)


def scale_01(x: Column, low: Column, high: Column) -> Column:
    """(x - low) / (high - low); null where the range is empty."""
    return F.try_divide(x - low, high - low)


def unscale_01(x: Column, low: Column, high: Column) -> Column:
    return x * (high - low) + low


def direction_sector(deg: Column, sectors: int = 16) -> Column:
    """Sector number from 0; sectors start at north."""
    return F.floor(F.pmod(deg, F.lit(360.0)) / (360.0 / sectors)).cast("int")
