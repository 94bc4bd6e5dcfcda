"""Principal components of fields: variables stacked over their coordinates, with lags and a policy for gaps."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Most columns of a stacked matrix: their covariances are a table of its square in the driver.
MOST_COLUMNS = 4000


@dataclass
class FieldComponents:
    """A fitted decomposition: names of the stacked columns, their moments, components (one row each) and shares of the variance."""

    names: list[tuple]
    mean: np.ndarray
    std: np.ndarray
    components: np.ndarray
    ratio: np.ndarray

    @property
    def cumulative(self) -> np.ndarray:
        return np.cumsum(self.ratio)


def stacked(df: DataFrame, row: str, coords: list[str], variables: list[str], windows: dict[str, list[int]] | None = None, fills: dict[str, float | str] | None = None, thresholds: dict[str, float] | None = None) -> tuple[list[tuple], DataFrame]:
    """Names of the columns (variable, *coordinates) and the frame (row, x): one array of values for each row.

    ``df`` is long: row, coordinates and variables. ``windows`` adds a variable as it was so many rows before (X_3), in the order of the rows.
    A column stays where more than its threshold (0.9; by variable, a lagged one's own or its variable's) of the rows have a value. Gaps left
    take the variable's fill: a number, or "forward" for the last value before them, which may leave gaps at the start; rows
    with gaps left are dropped.
    """
    windows, fills, thresholds = windows or {}, fills or {}, thresholds or {}
    along = Window.partitionBy(*coords).orderBy(row)
    rows = df.select(row, *coords, *[F.nanvl(F.col(v).cast("double"), F.lit(None).cast("double")).alias(v) for v in variables])
    names, base = list(variables), {v: v for v in variables}
    for v, lags in windows.items():
        for k in lags:
            rows = rows.withColumn(f"{v}_{k}", F.lag(v, k).over(along))
            names.append(f"{v}_{k}")
            base[f"{v}_{k}"] = v
    of = lambda table, n, default: table.get(n, table.get(base[n], default))
    total = rows.select(row).distinct().count()
    shares = rows.groupBy(*coords).agg(*[(F.count(n) / F.lit(max(1, total))).alias(n) for n in names])
    found = shares.limit(MOST_COLUMNS + 1).collect()
    columns = sorted((n, *[r[c] for c in coords]) for r in found for n in names if r[n] > of(thresholds, n, 0.9))
    if len(columns) > MOST_COLUMNS:
        raise ValueError(f"more than {MOST_COLUMNS} columns: coarsen the grid")
    for n in names:
        fill = of(fills, n, None)
        if fill == "forward":
            rows = rows.withColumn(n, F.last(n, ignorenulls=True).over(along.rowsBetween(Window.unboundedPreceding, 0)))
        elif fill is not None:
            rows = rows.withColumn(n, F.coalesce(n, F.lit(float(fill))))
    parts = F.explode(F.array(*[F.struct(F.lit(n).alias("name"), F.col(n).alias("value")) for n in names]))
    cells = rows.select(row, *coords, parts.alias("p")).select(row, F.col("p.name").alias("name"), *coords, F.col("p.value").alias("value")).filter("value is not null")
    spark = df.sparkSession
    place = spark.createDataFrame([(i, *c) for i, c in enumerate(columns)], "place int, name string, " + ", ".join(f"{c} {dict(df.dtypes)[c]}" for c in coords))
    met = cells.join(F.broadcast(place), ["name", *coords]).groupBy(row).agg(F.sort_array(F.collect_list(F.struct("place", "value"))).alias("x"))
    return columns, met.filter(F.size("x") == len(columns)).select(row, F.transform("x", lambda c: c["value"]).alias("x"))


def _sums(rows: DataFrame, width: int) -> tuple[int, np.ndarray, np.ndarray]:
    """Rows, sums and products of the arrays ``x``: one table of the columns' square for each task, added in a tree."""

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, s, q = 0, np.zeros(width), np.zeros((width, width))
        for b in batches:
            m = b.column(0).flatten().to_numpy(zero_copy_only=False).reshape(-1, width)
            n, s, q = n + len(m), s + m.sum(0), q + m.T @ m
        # a row for each line of the table, so that no value is large
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(width + 1)), pa.array([n] * (width + 1)), pa.array([s.tolist(), *q.tolist()], pa.list_(pa.float64()))], names=["line", "n", "v"])

    lines = rows.select("x").mapInArrow(part, "line bigint, n bigint, v array<double>")
    added = lines.groupBy("line").agg(F.sum("n").alias("n"), F.array(*[F.sum(F.get("v", i)) for i in range(width)]).alias("v")) if width <= 64 else None
    if added is None:
        added = lines.select("line", "n", F.posexplode("v").alias("i", "e")).groupBy("line", "i").agg(F.sum("n").alias("n"), F.sum("e").alias("e")).groupBy("line").agg(F.max("n").alias("n"), F.sort_array(F.collect_list(F.struct("i", "e"))).alias("w")).select("line", "n", F.transform("w", lambda c: c["e"]).alias("v"))
    table = {r["line"]: r for r in added.collect()}
    n = table[0]["n"] if table else 0
    return n, np.array(table[0]["v"]) if table else np.zeros(width), np.array([table[i + 1]["v"] for i in range(width)]) if table else np.zeros((width, width))


def fit_components(names: list[tuple], rows: DataFrame, k: int | float, scale: bool = True) -> FieldComponents:
    """Components of the standardised columns: ``k`` of them, or as many as reach a share ``k`` < 1 of the variance. Signs make each one's largest weight positive."""
    width = len(names)
    n, s, q = _sums(rows, width)
    if not n or not width:
        raise ValueError("no whole rows to decompose")
    mean = s / n
    cov = q / n - np.outer(mean, mean)
    std = np.sqrt(np.maximum(np.diag(cov), 0)) if scale else np.ones(width)
    std = np.where(std > 1e-12, std, 1.0)
    values, vectors = np.linalg.eigh(cov / np.outer(std, std))
    values, vectors = np.maximum(values[::-1], 0), vectors[:, ::-1]
    ratio = values / max(values.sum(), 1e-300)
    k = int(np.searchsorted(np.cumsum(ratio), k - 1e-12) + 1) if k < 1 else min(int(k), width)
    top = vectors[:, :k].T
    top = top * np.sign(top[np.arange(k), np.abs(top).argmax(1)])[:, None]
    return FieldComponents(names, mean, std, top, ratio[:k])


def component_scores(model: FieldComponents, rows: DataFrame, row: str) -> DataFrame:
    """row, pc1, ... of each row."""
    kind = dict(rows.dtypes)[row]
    load, k = (model.components / model.std).T, len(model.components)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            m = b.column(1).flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1)
            z = (m - model.mean) @ load
            yield pa.RecordBatch.from_arrays([b.column(0), *[pa.array(z[:, i]) for i in range(k)]], names=[row, *[f"pc{i + 1}" for i in range(k)]])

    return rows.select(row, "x").mapInArrow(run, f"{row} {kind}, " + ", ".join(f"pc{i + 1} double" for i in range(k)))


def from_scores(model: FieldComponents, scores: DataFrame, row: str, coords: list[str], kinds: dict[str, str]) -> DataFrame:
    """row, variable, coordinates and value: what the components give back of every cell."""
    spark = scores.sparkSession
    loads = [(n[0], *n[1:], float(m), *[float(c) for c in model.components[:, i] * model.std[i]]) for i, (n, m) in enumerate(zip(model.names, model.mean))]
    k = len(model.components)
    fields = "variable string, " + ", ".join(f"{c} {kinds[c]}" for c in coords) + ", __mean double, " + ", ".join(f"__l{i + 1} double" for i in range(k))
    cells = spark.createDataFrame(loads, fields)
    value = sum((F.col(f"pc{i + 1}") * F.col(f"__l{i + 1}") for i in range(k)), F.col("__mean"))
    return scores.crossJoin(F.broadcast(cells)).select(row, "variable", *coords, value.alias("value"))  # at most MOST_COLUMNS cells


def eof_table(model: FieldComponents, spark, coords: list[str], kinds: dict[str, str]) -> DataFrame:
    """pc, variable, coordinates, weight, share of the variance."""
    rows = [(j + 1, n[0], *n[1:], float(model.components[j, i]), float(model.ratio[j])) for j in range(len(model.components)) for i, n in enumerate(model.names)]
    return spark.createDataFrame(rows, "pc int, variable string, " + ", ".join(f"{c} {kinds[c]}" for c in coords) + ", weight double, share double")


def sample_field(spark) -> DataFrame:
    """coord3, i, j, X, Y: three standing waves on a grid of 20 by 20 points over 49 rows, and minus their sine."""
    x, y, t = F.radians(-100 + F.col("i") * (200 / 19)), F.radians(-100 + F.col("j") * (200 / 19)), F.col("coord3")
    cells = spark.range(400 * 49).select((F.col("id") % 49 + 1).cast("int").alias("coord3"), F.floor(F.col("id") / 980).cast("int").alias("i"), (F.floor(F.col("id") / 49) % 20).cast("int").alias("j"))
    waves = sum((F.sin(k * x) * F.cos(k * y) * F.sin(k * t) for k in (1, 2, 3)), F.lit(0.0))
    return cells.select("coord3", "i", "j", waves.alias("X"), (-F.sin(waves)).alias("Y"))


def label_probabilities(winners: DataFrame, cell: list[str], label: str) -> DataFrame:
    """cell, label, n, probability: how often the rows that a map's cell has won carry each label."""
    n = winners.groupBy(*cell, label).agg(F.count(F.lit(1)).alias("n"))
    return n.withColumn("probability", F.col("n") / F.sum("n").over(Window.partitionBy(*cell)))


def distance_map(weights: DataFrame, i: str, j: str, dims: list[str]) -> DataFrame:
    """i, j, distance: each cell's summed distance to its up to eight neighbours, over the largest of these. ``weights`` has one row for each cell."""
    around = F.explode(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a in (-1, 0, 1) for b in (-1, 0, 1) if a or b]))
    mine = weights.select(i, j, *dims, around.alias("__o")).select(i, j, *dims, (F.col(i) + F.col("__o.a")).alias("__i"), (F.col(j) + F.col("__o.b")).alias("__j"))
    other = weights.select(F.col(i).alias("__i"), F.col(j).alias("__j"), *[F.col(d).alias(f"__{d}") for d in dims])
    gap = F.sqrt(sum(((F.col(d) - F.col(f"__{d}")) * (F.col(d) - F.col(f"__{d}")) for d in dims), F.lit(0.0)))
    total = mine.join(other, ["__i", "__j"]).groupBy(i, j).agg(F.sum(gap).alias("__d"))
    return total.crossJoin(F.broadcast(total.agg(F.max("__d").alias("__m")))).select(i, j, F.try_divide("__d", "__m").alias("distance"))  # one row
