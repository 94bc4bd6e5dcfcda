"""The normal distribution as column expressions, by published rational approximations."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Coefficients of Abramowitz and Stegun 26.2.17 (error under 7.5e-8): fixed values.
TAIL = (0.319381530, -0.356563782, 1.781477937, -1.821255978, 1.330274429)
TAIL_T = 0.2316419
#: Coefficients of Acklam's inverse (relative error under 1.2e-9): fixed values.
A = (-3.969683028665376e01, 2.209460984245205e02, -2.759285104469687e02, 1.383577518672690e02, -3.066479806614716e01, 2.506628277459239e00)
B = (-5.447609879822406e01, 1.615858368580409e02, -1.556989798598866e02, 6.680131188771972e01, -1.328068155288572e01)
C = (-7.784894002430293e-03, -3.223964580411365e-01, -2.400758277161838e00, -2.549732539343734e00, 4.374664141464968e00, 2.938163982698783e00)
D = (7.784695709041462e-03, 3.224671290700398e-01, 2.445134137142996e00, 3.754408661907416e00)
LOW = 0.02425


def _horner(x: Column, coefs: tuple) -> Column:
    out = F.lit(coefs[0])
    for c in coefs[1:]:
        out = out * x + c
    return out


def normal_cdf(z: Column) -> Column:
    t = 1 / (1 + TAIL_T * F.abs(z))
    tail = F.exp(-z * z / 2) / math.sqrt(2 * math.pi) * t * _horner(t, TAIL[::-1])
    return F.when(z >= 0, 1 - tail).otherwise(tail)


def normal_quantile(p: Column) -> Column:
    """Null unless 0 < p < 1."""
    q = p - 0.5
    r = q * q
    middle = _horner(r, A) * q / (_horner(r, B) * r + 1)
    side = lambda x: _horner(x, C) / (_horner(x, D) * x + 1)
    inside = F.when((p > 0) & (p < 1), p)
    return (
        F.when(inside < LOW, side(F.sqrt(-2 * F.ln(inside))))
        .when(inside > 1 - LOW, -side(F.sqrt(-2 * F.ln(1 - inside))))
        .otherwise(F.when(inside.isNotNull(), middle))
    )
