"""Closed forms of the GEV, GPD and Poisson-GPD distributions; shape xi > 0 is the heavy tail."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

#: A shape nearer to zero than this is taken as zero.
FLAT = 1e-8


def _power(z: Column, xi: float) -> Column:
    """(1 + xi z)^(-1/xi), its limit exp(-z); null outside the support."""
    if abs(xi) < FLAT:
        return F.exp(-z)
    base = 1 + xi * z
    return F.when(base > 0, F.pow(base, F.lit(-1.0 / xi)))


def gev_cdf(x: Column, loc: float, scale: float, xi: float) -> Column:
    return F.coalesce(F.exp(-_power((x - loc) / scale, xi)), F.lit(0.0 if xi > 0 else 1.0))


def gev_pdf(x: Column, loc: float, scale: float, xi: float) -> Column:
    t = _power((x - loc) / scale, xi)
    return F.coalesce(F.pow(t, F.lit(xi + 1.0)) * F.exp(-t) / scale, F.lit(0.0))


def gev_sf(x: Column, loc: float, scale: float, xi: float) -> Column:
    return F.coalesce(-F.expm1(-_power((x - loc) / scale, xi)), F.lit(1.0 if xi > 0 else 0.0))


def gev_quantile(p: Column, loc: float, scale: float, xi: float) -> Column:
    """Null unless 0 < p < 1."""
    y = -F.ln(F.when((p > 0) & (p < 1), p))
    return loc - scale * F.ln(y) if abs(xi) < FLAT else loc + scale / xi * (F.pow(y, F.lit(-xi)) - 1)


def gev_log_likelihood(x: Column, loc: float, scale: float, xi: float) -> Column:
    """Log density of a value; null outside the support."""
    t = _power((x - loc) / scale, xi)
    return (xi + 1) * F.ln(t) - t - math.log(scale)


def gev_moments(loc: float, scale: float, xi: float) -> dict[str, float]:
    """Mean, median, variance and standard deviation; infinite or not a number where they don't exist."""
    g = lambda k: math.gamma(1 - k * xi)
    if abs(xi) < FLAT:
        mean, var = loc + scale * 0.5772156649015329, scale**2 * math.pi**2 / 6
        median = loc - scale * math.log(math.log(2))
    else:
        mean = loc + scale * (g(1) - 1) / xi if xi < 1 else math.inf
        var = scale**2 * (g(2) - g(1) ** 2) / xi**2 if xi < 0.5 else math.inf
        median = loc + scale * (math.log(2) ** -xi - 1) / xi
    return {"mean": mean, "median": median, "variance": var, "std": math.sqrt(var)}


def gpd_sf(x: Column, threshold: float, scale: float, xi: float) -> Column:
    z = (x - threshold) / scale
    return F.when(z < 0, 1.0).otherwise(F.coalesce(_power(z, xi), F.lit(0.0)))


def gpd_cdf(x: Column, threshold: float, scale: float, xi: float) -> Column:
    return 1 - gpd_sf(x, threshold, scale, xi)


def gpd_pdf(x: Column, threshold: float, scale: float, xi: float) -> Column:
    z = (x - threshold) / scale
    return F.when(z < 0, 0.0).otherwise(F.coalesce(F.pow(_power(z, xi), F.lit(1.0 + xi)) / scale, F.lit(0.0)))


def gpd_quantile(p: Column, threshold: float, scale: float, xi: float) -> Column:
    q = 1 - F.when((p > 0) & (p < 1), p)
    return threshold - scale * F.ln(q) if abs(xi) < FLAT else threshold + scale / xi * (F.pow(q, F.lit(-xi)) - 1)


def gpd_moments(threshold: float, scale: float, xi: float) -> dict[str, float]:
    mean = threshold + scale / (1 - xi) if xi < 1 else math.inf
    var = scale**2 / ((1 - xi) ** 2 * (1 - 2 * xi)) if xi < 0.5 else math.inf
    median = threshold + (scale * math.log(2) if abs(xi) < FLAT else scale * (2**xi - 1) / xi)
    return {"mean": mean, "median": median, "variance": var, "std": math.sqrt(var)}


def gpd_poisson_cdf(x: Column, threshold: float, scale: float, xi: float, rate: float) -> Column:
    """Annual maximum of a Poisson number of exceedances; rate per year."""
    return F.exp(-rate * gpd_sf(x, threshold, scale, xi))


def gpd_poisson_pdf(x: Column, threshold: float, scale: float, xi: float, rate: float) -> Column:
    return rate * gpd_pdf(x, threshold, scale, xi) * gpd_poisson_cdf(x, threshold, scale, xi, rate)


def gpd_poisson_quantile(p: Column, threshold: float, scale: float, xi: float, rate: float) -> Column:
    s = -F.ln(F.when((p > 0) & (p < 1), p)) / rate
    return threshold - scale * F.ln(s) if abs(xi) < FLAT else threshold + scale / xi * (F.pow(s, F.lit(-xi)) - 1)
