"""Streaming forms of the windowed operators: the frame may be a stream or a table."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def window_maxima(events: DataFrame, time: str, value: str, key: str, width: str = "1 day", late: str = "2 hours") -> DataFrame:
    """key, start, peak, n of tumbling windows; rows later than ``late`` are dropped from a stream."""
    w = events.withWatermark(time, late).groupBy(F.window(time, width).alias("w"), key)
    return w.agg(F.max(value).alias("peak"), F.count(F.lit(1)).alias("n")).select(key, F.col("w.start").alias("start"), "peak", "n")


def label_counts(events: DataFrame, time: str, label: str, width: str = "30 days", late: str = "1 day") -> DataFrame:
    """Counts of labels in tumbling windows, from which probabilities follow."""
    return events.withWatermark(time, late).groupBy(F.window(time, width).alias("w"), label).count().select(F.col("w.start").alias("start"), label, "count")


def storm_sessions(events: DataFrame, time: str, value: str, key: str, threshold: float, gap: str = "3 days", late: str = "1 day") -> DataFrame:
    """key, start, end, peak, n: exceedances less than ``gap`` apart are one event."""
    over = events.filter(F.col(value) >= threshold).withWatermark(time, late)
    s = over.groupBy(F.session_window(time, gap).alias("w"), key).agg(F.max(value).alias("peak"), F.count(F.lit(1)).alias("n"))
    return s.select(key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "peak", "n")


def running_transitions(events: DataFrame, key: str, label: str) -> DataFrame:
    """key, prev, cur as rows arrive: the state holds each key's last label, nothing else."""

    def step(name: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last = state.get[0] if state.exists else None
        for p in parts:
            rows = []
            for cur in p[label]:
                if last is not None:
                    rows.append((name[0], last, cur))
                last = cur
            yield pd.DataFrame(rows, columns=["key", "prev", "cur"])
        if last is not None:
            state.update((last,))

    return events.groupBy(key).applyInPandasWithState(step, f"key {dict(events.dtypes)[key]}, prev string, cur string", "last string", "append", GroupStateTimeout.NoTimeout)
