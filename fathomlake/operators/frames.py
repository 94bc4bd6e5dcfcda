"""Scaling, cleaning, metrics and set operations on frames. Aggregates come as one-row frames and are joined by broadcast."""

from __future__ import annotations

from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fathomlake.functions import angles


def ranges(df: DataFrame, cols: list[str]) -> DataFrame:
    """One row: <col>_min and <col>_max."""
    return df.agg(*[f(c).alias(f"{c}_{n}") for c in cols for n, f in (("min", F.min), ("max", F.max))])


def normalize(df: DataFrame, cols: list[str], scale: dict[str, tuple[float, float]] | None = None) -> DataFrame:
    """Columns to [0, 1] by their own range, or by ``scale`` where it names them (values may then leave [0, 1])."""
    scale = scale or {}
    own = [c for c in cols if c not in scale]
    out = df.join(F.broadcast(ranges(df, own))) if own else df
    lo = lambda c: F.lit(float(scale[c][0])) if c in scale else F.col(f"{c}_min")
    hi = lambda c: F.lit(float(scale[c][1])) if c in scale else F.col(f"{c}_max")
    return out.select(*[angles.scale_01(F.col(c), lo(c), hi(c)).alias(c) if c in cols else F.col(c) for c in df.columns])


def denormalize(df: DataFrame, scale: dict[str, tuple[float, float]]) -> DataFrame:
    return df.select(*[angles.unscale_01(F.col(c), F.lit(float(scale[c][0])), F.lit(float(scale[c][1]))).alias(c) if c in scale else F.col(c) for c in df.columns])


def standardize(df: DataFrame, cols: list[str]) -> DataFrame:
    """(x - mean) / population standard deviation; null where that is 0."""
    moments = df.agg(*[f(c).alias(f"{c}_{n}") for c in cols for n, f in (("mean", F.avg), ("std", F.stddev_pop))])
    out = df.join(F.broadcast(moments))
    return out.select(*[F.try_divide(F.col(c) - F.col(f"{c}_mean"), F.col(f"{c}_std")).alias(c) if c in cols else F.col(c) for c in df.columns])


def destandardize(df: DataFrame, moments: dict[str, tuple[float, float]]) -> DataFrame:
    return df.select(*[(F.col(c) * moments[c][1] + moments[c][0]).alias(c) if c in moments else F.col(c) for c in df.columns])


def check_nulls(df: DataFrame, cols: list[str]) -> DataFrame:
    """One row for each column: column, bad (null or not a number)."""
    bad = lambda c: F.col(c).isNull() | F.isnan(F.col(c).cast("double"))
    counts = df.agg(*[F.count(F.when(bad(c), 1)).alias(c) for c in cols])
    return counts.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("bad")) for c in cols])).alias("x")).select("x.*")


def fill_bad(df: DataFrame, cols: list[str], value: float | Column) -> DataFrame:
    """Null and NaN replaced by a number or an expression."""
    value = value if isinstance(value, Column) else F.lit(float(value))
    return df.select(*[F.coalesce(F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double")), value).alias(c) if c in cols else F.col(c) for c in df.columns])


def metrics(df: DataFrame, true: str, pred: str, by: list[str] | None = None) -> DataFrame:
    """bias, si, mse, mae, rmse, r2 and explained variance of a prediction, by group."""
    t, p = F.col(true).cast("double"), F.col(pred).cast("double")
    d = t - p
    grouped = df.groupBy(*(by or []))
    return grouped.agg(
        F.avg(d).alias("bias"),
        F.sqrt(F.try_divide(F.count(d) * F.var_pop(d), F.sum(t * t))).alias("si"),
        F.avg(d * d).alias("mse"),
        F.avg(F.abs(d)).alias("mae"),
        F.sqrt(F.avg(d * d)).alias("rmse"),
        (1 - F.try_divide(F.sum(d * d), F.count(t) * F.var_pop(t))).alias("r2"),
        (1 - F.try_divide(F.var_pop(d), F.var_pop(t))).alias("explained_variance"),
    )


def correlations(df: DataFrame, a: str, b: str) -> DataFrame:
    """pearson and spearman (average ranks)."""
    both = global_ranks(global_ranks(df.select(a, b).dropna(), a, name="__ra", ties="__ta"), b, name="__rb", ties="__tb")
    mean = lambda r, t: F.col(r) + (F.col(t) - 1) / 2
    return both.agg(F.corr(a, b).alias("pearson"), F.corr(mean("__ra", "__ta"), mean("__rb", "__tb")).alias("spearman"))


def global_ranks(df: DataFrame, value: str, by: list[str] = (), name: str = "rank", total: str | None = None, ties: str | None = None, unique: bool = False, then: list[str] = (), bins: int = 64) -> DataFrame:
    """The frame with each row's rank by ``value`` in its series (``unique``: row numbers, ``then`` settling ties), and if named the series' size and the rank's ties.

    In two steps, so that no series is sorted in one task: rows are cut into bins by approximate quantiles (``bins`` numbers in the
    driver; equal values share a bin), bins are counted, and a row's rank is what lies in the bins before and its rank in its own.
    """
    edges = sorted({float(e) for e in df.approxQuantile(value, [i / bins for i in range(1, bins)], 0.005)})
    edge = F.array(*[F.lit(e) for e in edges]) if edges else F.lit([]).cast("array<double>")
    rows = df.withColumn("__bin", F.size(F.filter(edge, lambda e: e <= F.col(value))))
    counts = rows.groupBy(*by, "__bin").agg(F.count(F.lit(1)).alias("__k"))
    order = Window.partitionBy(*by).orderBy("__bin") if by else Window.orderBy("__bin")  # at most ``bins`` rows of a series
    whole = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(1))
    counts = counts.select(*[F.col(c).alias(f"__by{i}") for i, c in enumerate(by)], F.col("__bin").alias("__of"), (F.sum("__k").over(order) - F.col("__k")).alias("__before"), F.sum("__k").over(whole).alias("__all"))
    on = F.col("__bin") == F.col("__of")
    for i, c in enumerate(by):
        on = on & rows[c].eqNullSafe(F.col(f"__by{i}"))
    inside = Window.partitionBy(*by, "__bin").orderBy(value, *then)
    rank = F.col("__before") + (F.row_number() if unique else F.rank()).over(inside)
    extra = ([F.col("__all").alias(total)] if total else []) + ([F.count(F.lit(1)).over(Window.partitionBy(*by, "__bin", value)).alias(ties)] if ties else [])
    return rows.join(counts, on).select(*[rows[c] for c in df.columns], rank.alias(name), *extra)


def guided_by_regression(df: DataFrame, rid: str, cols: list[str], targets: list[str], weights: list[float]) -> DataFrame:
    """rid, the columns scaled by what the weights leave of 1, and each target's least-squares prediction from them scaled by its weight.

    One pass gives the sums of the normal equations, which are as many as pairs of columns.
    """
    x = [F.lit(1.0), *[F.col(c).cast("double") for c in cols]]
    y = [F.col(t).cast("double") for t in targets]
    n = len(x)
    s = df.agg(*[F.sum(x[i] * x[j]).alias(f"x{i}_{j}") for i in range(n) for j in range(i, n)], *[F.sum(x[i] * v).alias(f"y{i}_{k}") for i in range(n) for k, v in enumerate(y)]).first()
    if s["x0_0"] is None:
        return df.select(rid, *cols, *targets)
    gram = np.array([[s[f"x{min(i, j)}_{max(i, j)}"] for j in range(n)] for i in range(n)])
    beta = np.linalg.lstsq(gram, np.array([[s[f"y{i}_{k}"] for k in range(len(y))] for i in range(n)]), rcond=None)[0]
    left = 1.0 - sum(weights)
    predicted = [(sum((c * float(b) for c, b in zip(x[1:], beta[1:, k])), F.lit(float(beta[0, k]))) * w).alias(t) for k, (t, w) in enumerate(zip(targets, weights))]
    return df.select(rid, *[(F.col(c) * left).alias(c) for c in cols], *predicted)


def regression(df: DataFrame, y: str, x: str, by: list[str] | None = None, weight: str | None = None) -> DataFrame:
    """slope, intercept and n of (weighted) least squares, from sums: one pass, one small row for each group."""
    w = F.col(weight).cast("double") if weight else F.lit(1.0)
    X, Y = F.col(x).cast("double"), F.col(y).cast("double")
    s = df.groupBy(*(by or [])).agg(F.count(F.lit(1)).alias("n"), F.sum(w).alias("sw"), F.sum(w * X).alias("sx"), F.sum(w * Y).alias("sy"), F.sum(w * X * X).alias("sxx"), F.sum(w * X * Y).alias("sxy"))
    slope = F.try_divide(F.col("sw") * F.col("sxy") - F.col("sx") * F.col("sy"), F.col("sw") * F.col("sxx") - F.col("sx") * F.col("sx"))
    s = s.withColumn("slope", slope)
    return s.select(*(by or []), "n", "slope", F.try_divide(F.col("sy") - F.col("slope") * F.col("sx"), F.col("sw")).alias("intercept"))


def unpivot(df: DataFrame, ids: list[str], cols: list[str], name: str = "variable", value: str = "value") -> DataFrame:
    return df.unpivot(ids, cols, name, value)


def common_dates(frames: list[DataFrame], time: str, further: bool = False) -> DataFrame:
    """start, end: the range that all frames share, or (``further``) that they span."""
    spans = reduce(DataFrame.union, [f.agg(F.min(time).alias("a"), F.max(time).alias("b")) for f in frames])
    return spans.agg(*((F.min("a").alias("start"), F.max("b").alias("end")) if further else (F.max("a").alias("start"), F.min("b").alias("end"))))


def unique_rows(df: DataFrame, cols: list[str], order: str) -> DataFrame:
    """Distinct rows with their counts and first place."""
    return df.groupBy(*cols).agg(F.count(F.lit(1)).alias("n"), F.min(order).alias("first"))


def all_combinations(frames: list[DataFrame]) -> DataFrame:
    """Every combination of parameter values, as case tables need: small lists, one column each."""
    return reduce(lambda a, b: a.crossJoin(F.broadcast(b)), frames)


def one_by_one(spark, **lists: list) -> DataFrame:
    """Case table of lists of one length."""
    if len({len(v) for v in lists.values()}) > 1:
        raise ValueError("lists differ in length")
    return spark.createDataFrame([(i, *row) for i, row in enumerate(zip(*lists.values()))], ["case_num", *lists])


def triangle_edges(elements: DataFrame, corners: tuple[str, str, str]) -> DataFrame:
    """Distinct undirected edges a < b of triangles."""
    n = [F.col(c) for c in corners]
    pairs = F.array(*[F.struct(F.least(p, q).alias("a"), F.greatest(p, q).alias("b")) for p, q in ((n[0], n[1]), (n[1], n[2]), (n[2], n[0]))])
    return elements.select(F.explode(pairs).alias("e")).select("e.a", "e.b").distinct()


def edge_cells(elements: DataFrame, cell: str, corners: tuple[str, str, str]) -> DataFrame:
    """a, b, cells: the cells on each edge (two at most in a valid mesh)."""
    n = [F.col(c) for c in corners]
    pairs = F.array(*[F.struct(F.least(p, q).alias("a"), F.greatest(p, q).alias("b")) for p, q in ((n[0], n[1]), (n[1], n[2]), (n[2], n[0]))])
    return elements.select(cell, F.explode(pairs).alias("e")).groupBy("e.a", "e.b").agg(F.sort_array(F.collect_list(cell)).alias("cells")).toDF("a", "b", "cells")
