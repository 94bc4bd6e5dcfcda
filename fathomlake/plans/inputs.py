"""Stand-in inputs: waves, positions and pressures derived from the driver's tables, as frames and as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A driver table; times without a zone are read in the session's."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*[F.col(c).cast("timestamp").alias(c) if t == "timestamp_ntz" else F.col(c) for c, t in df.dtypes])


def waves(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, ts, user_id, event_type, hs, tp, dir and two positions."""
    e, i = table(spark, sf_dir, "events"), F.col("event_id")
    turn = lambda k, n, by: (i * k % n) / by
    return e.select(
        i.alias("id"), "ts", "user_id", "event_type", F.col("value").alias("hs"), (turn(7, 200, 10.0) + 1).alias("tp"), turn(137, 3600, 10.0).alias("dir"),
        (turn(31, 17000, 100.0) - 85).alias("lat1"), turn(73, 36000, 100.0).alias("lon1"), (turn(57, 17000, 100.0) - 85).alias("lat2"), turn(91, 36000, 100.0).alias("lon2"),
        (turn(11, 140, 1.0) + 880).alias("pressure"),
    )


WAVES = """w AS (SELECT event_id AS id, ts, user_id, event_type, value AS hs, (event_id*7 % 200)/10.0::DOUBLE + 1 AS tp, (event_id*137 % 3600)/10.0::DOUBLE AS dir,
 (event_id*31 % 17000)/100.0::DOUBLE - 85 AS lat1, (event_id*73 % 36000)/100.0::DOUBLE AS lon1, (event_id*57 % 17000)/100.0::DOUBLE - 85 AS lat2, (event_id*91 % 36000)/100.0::DOUBLE AS lon2,
 (event_id*11 % 140)::DOUBLE + 880 AS pressure FROM events)"""


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles rounded; so that both engines print one number."""
    return df.select(*[F.round(c, digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])
