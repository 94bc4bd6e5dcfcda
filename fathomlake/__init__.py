"""Fathomlake: environmental time-series and field analytics as Spark plans."""

__version__ = "0.1.0"
