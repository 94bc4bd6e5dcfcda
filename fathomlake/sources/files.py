"""Readers and writers. Every reader takes Spark paths, so that any store and compressed files will do."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_buoy_table(spark: SparkSession, path: str) -> DataFrame:
    """time and measurement columns of white-space separated buoy files with a heading in #YY or YYYY style; 99-type gaps stay."""
    raw = spark.read.text(path).select(F.split(F.trim(F.regexp_replace("value", r"^#", "")), r"\s+").alias("v"))
    head = raw.filter(F.col("v")[0].isin("YY", "YYYY")).first()
    if head is None:
        raise ValueError(f"no heading in {path}")
    names = ["YYYY" if n == "YY" else n for n in head["v"]]
    at = {n: i for i, n in enumerate(names)}
    rows = raw.filter(F.col("v")[0].rlike(r"^\d+$") & (F.size("v") == len(names)))
    part = lambda n: F.col("v")[at[n]].cast("int") if n in at else F.lit(0)
    time = F.make_timestamp(part("YYYY"), part("MM"), part("DD"), part("hh"), part("mm"), F.lit(0).cast("decimal(16,6)"))
    kept = [n for n in names if n not in ("YYYY", "MM", "DD", "hh", "mm")]
    return rows.select(time.alias("time"), *[F.col("v")[at[n]].try_cast("double").alias(n) for n in kept])


def spectra_long(wide: DataFrame) -> DataFrame:
    """time, freq, efth from a table whose other columns are named by frequency."""
    cols = [c for c in wide.columns if c != "time"]
    return wide.unpivot(["time"], [F.col(f"`{c}`") for c in cols], "freq", "efth").withColumn("freq", F.col("freq").cast("double"))


def read_mesh(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Nodes (node_id, x, y, z) and triangles (cell, a, b, c) of an ASCII mesh: a title, counts, then a line for each."""
    from pyspark.sql import types as T

    lines = spark.read.text(path, wholetext=True).select(F.posexplode(F.split("value", r"\r?\n")).alias("k", "line")).select("k", F.split(F.trim("line"), r"\s+").alias("v"))
    counts = lines.filter("k = 1").first()["v"]
    cells, nodes = int(counts[0]), int(counts[1])
    n = lines.filter((F.col("k") >= 2) & (F.col("k") < 2 + nodes)).select(F.col("v")[0].cast(T.LongType()).alias("node_id"), *[F.col("v")[i].cast("double").alias(c) for i, c in ((1, "x"), (2, "y"), (3, "z"))])
    e = lines.filter((F.col("k") >= 2 + nodes) & (F.col("k") < 2 + nodes + cells)).select(F.col("v")[0].cast(T.LongType()).alias("cell"), *[F.col("v")[i].cast(T.LongType()).alias(c) for i, c in ((2, "a"), (3, "b"), (4, "c"))])
    return n, e


def read_polylines(spark: SparkSession, path: str) -> DataFrame:
    """line, point, x, y: polylines of one CSV file of x,y, parted by rows that aren't numbers."""
    rows = spark.read.text(path, wholetext=True).select(F.posexplode(F.split("value", r"\r?\n")).alias("point", "line")).select("point", F.split("line", ",").alias("v"))
    from pyspark.sql import Window

    x, y = F.col("v")[0].try_cast("double"), F.get("v", F.lit(1)).try_cast("double")
    bad = x.isNull() | y.isNull() | F.isnan(x) | F.isnan(y)
    parted = rows.withColumn("line", F.sum(F.when(bad, 1).otherwise(0)).over(Window.orderBy("point"))).filter(~bad)
    return parted.select("line", "point", x.alias("x"), y.alias("y"))


def grid_box(df: DataFrame, lat: str, lon: str, lat1: float, lat2: float, lon1: float, lon2: float, stride: int = 1) -> DataFrame:
    """Cells of a box, every ``stride``-th of each axis; the box filter reaches the scan."""
    box = df.filter(F.col(lat).between(lat1, lat2) & F.col(lon).between(lon1, lon2))
    if stride == 1:
        return box
    from pyspark.sql import Window

    axis = lambda c: box.select(c).distinct().withColumn("__k", F.row_number().over(Window.orderBy(c)) - 1).filter(F.col("__k") % stride == 0).select(c)
    return box.join(F.broadcast(axis(lat)), lat, "left_semi").join(F.broadcast(axis(lon)), lon, "left_semi")


def save_table(df: DataFrame, path: str, by: list[str] | None = None, units: dict[str, str] | None = None) -> None:
    """Parquet sink, partitioned on demand; units go into the columns' metadata."""
    for c, u in (units or {}).items():
        df = df.withMetadata(c, {"units": u})
    (df.write.partitionBy(*by) if by else df.write).mode("overwrite").parquet(path)


def load_table(spark: SparkSession, path: str, cols: list[str] | None = None) -> DataFrame:
    df = spark.read.parquet(path)
    return df.select(*cols) if cols else df


def transfer_coefficients(inputs: DataFrame, outputs: DataFrame) -> DataFrame:
    """case_num, site, freq, dir, kp: output spectrum over the case's whole input; gaps are 0."""
    total = inputs.groupBy("case_num").agg(F.sum("efth").alias("__in"))
    return outputs.join(total, "case_num").select("case_num", "site", "freq", "dir", F.coalesce(F.try_divide("efth", "__in"), F.lit(0.0)).alias("kp"))


def reconstruct_spectra(offshore: DataFrame, kp: DataFrame) -> DataFrame:
    """time, site, freq, dir, efth: sum over cases of offshore energy by case times coefficient."""
    return offshore.join(kp, "case_num").groupBy("time", "site", "freq", "dir").agg(F.sum(F.col("energy") * F.col("kp")).alias("efth"))
