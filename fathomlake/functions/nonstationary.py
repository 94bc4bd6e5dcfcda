"""GEV whose parameters change with time and covariates, as column expressions: location, scale and shape are columns."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .extremes import FLAT
from .waves import seasonal_parameter


def gev_parameters(t: Column, location: dict, scale: dict, shape: dict) -> Column:
    """struct(loc, scale, xi) at a time in years. Each dict has base, harmonics and perhaps trend and covariates (pairs of column and
    coefficient); the scale's terms add up in its logarithm."""
    of = lambda d: seasonal_parameter(t, d["base"], d.get("harmonics", []), d.get("trend", 0.0), d.get("covariates", ()))
    return F.struct(of(location).alias("loc"), F.exp(of(scale)).alias("scale"), of(shape).alias("xi"))


def _exceedance(x: Column, p: Column) -> Column:
    """(1 + xi z)^(-1/xi) and its limit; null outside the support."""
    z = (x - p["loc"]) / p["scale"]
    base = 1 + p["xi"] * z
    return F.when(F.abs(p["xi"]) < FLAT, F.exp(-z)).when(base > 0, F.pow(base, -1 / p["xi"]))


def gev_cdf_at(x: Column, p: Column) -> Column:
    return F.coalesce(F.exp(-_exceedance(x, p)), F.when(p["xi"] > 0, 0.0).otherwise(1.0))


def gev_quantile_at(q: Column, p: Column) -> Column:
    """Null unless 0 < q < 1."""
    y = -F.ln(F.when((q > 0) & (q < 1), q))
    return F.when(F.abs(p["xi"]) < FLAT, p["loc"] - p["scale"] * F.ln(y)).otherwise(p["loc"] + p["scale"] / p["xi"] * (F.pow(y, -p["xi"]) - 1))


def gev_log_likelihood_at(x: Column, p: Column) -> Column:
    """Log density of a value; null outside the support."""
    e = _exceedance(x, p)
    return (p["xi"] + 1) * F.ln(e) - e - F.ln(p["scale"])


def standardized_at(x: Column, p: Column) -> Column:
    """The value on the scale of a standard Gumbel distribution; null outside the support."""
    return -F.ln(_exceedance(x, p))


def aggregate_quantile(rows: DataFrame, params: Column, q: float, passes: int = 8, grid: int = 16) -> float:
    """The value that the whole period stays under with probability ``q``: where the mean over rows of -ln F is -ln q.

    Every pass evaluates a grid of values in one aggregation and keeps the cell that holds the answer.
    """
    if not 0 < q < 1:
        raise ValueError("q lies between 0 and 1")
    p = rows.select(params.alias("p"))
    ends = p.agg(F.min(gev_quantile_at(F.lit(min(q, 0.001)), F.col("p"))).alias("a"), F.max(gev_quantile_at(F.lit(max(q, 0.999)), F.col("p"))).alias("b")).first()
    if ends["a"] is None:
        raise ValueError("no rows")
    low, high, want = ends["a"], ends["b"], -math.log(q)
    for _ in range(passes):
        at = [low + (high - low) * i / grid for i in range(grid + 1)]
        rate = [F.avg(F.coalesce(_exceedance(F.lit(x), F.col("p")), F.when(F.col("p.xi") > 0, 1e300).otherwise(0.0))).alias(str(i)) for i, x in enumerate(at)]
        r = p.agg(*rate).first()
        k = max([i for i in range(grid) if r[str(i)] >= want], default=0)  # rates fall with the value
        low, high = at[k], at[k + 1]
    return (low + high) / 2
