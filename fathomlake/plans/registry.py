"""Names of the registered queries and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from fathomlake.plans.inputs import WAVES, rounded, waves

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None, digits: int = 6):
    """Register the function under its name; doubles of the result are rounded to so many digits."""

    def add(f):
        QUERIES[f.__name__] = lambda spark, sf: rounded(f(spark, sf), digits)
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def per_wave(name: str, cols: dict, sql: str, digits: int = 6) -> None:
    """A query of expressions over the waves; ``sql`` selects from w."""
    QUERIES[name] = lambda spark, sf: rounded(waves(spark, sf).select("id", *[(c() if callable(c) else c).alias(k) for k, c in cols.items()]), digits)
    ORACLES[name] = f"WITH {WAVES} SELECT id, {sql} FROM w"
