"""Nearest-neighbour, as-of and bracketing joins."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .boxes import Leaves, Metric, Tree

#: References up to this number are broadcast to a nested loop; the number is checked before.
MOST_REFERENCES = 10_000


def distance_squared(dims: list[str], circular: list[str] = (), weights: dict[str, float] | None = None, left: str = "q", right: str = "r") -> Column:
    """Weighted squared distance; circular dimensions are normalised to [0, 1] and wrap."""
    out = F.lit(0.0)
    for d in dims:
        gap = F.abs(F.col(f"{left}.{d}") - F.col(f"{right}.{d}"))
        gap = F.least(gap, 1 - gap) if d in circular else gap
        w = (weights or {}).get(d, 1.0)
        out = out + w * w * gap * gap
    return out


def nearest(queries: DataFrame, references: DataFrame, qid: str, rid: str, dims: list[str], circular: list[str] = (), weights: dict[str, float] | None = None) -> DataFrame:
    """qid, rid, distance: each query's nearest reference (least id on ties).

    Up to MOST_REFERENCES references (checked) are broadcast, and a partial minimum leaves one row for a query. More of them are cut
    into leaves, each query's nearest in a sample bounds its distance, and it looks into every leaf that isn't farther.
    """
    if references.limit(MOST_REFERENCES + 1).count() > MOST_REFERENCES:
        return nearest_by_leaves(queries, references, qid, rid, dims, circular, weights)
    pairs = queries.alias("q").crossJoin(F.broadcast(references.alias("r")))
    best = F.min(F.struct(distance_squared(dims, circular, weights).alias("d"), F.col(f"r.{rid}").alias("r")))
    out = pairs.groupBy(F.col(f"q.{qid}").alias(qid)).agg(best.alias("b"))
    return out.select(qid, F.col("b.r").alias(rid), F.sqrt("b.d").alias("distance"))


#: Places of references in the sample that cuts space into leaves and bounds each query's distance.
MOST_SAMPLED = 100_000


def nearest_by_leaves(queries: DataFrame, references: DataFrame, qid: str, rid: str, dims: list[str], circular: list[str] = (), weights: dict[str, float] | None = None, held: int = 4096, sampled: int = MOST_SAMPLED) -> DataFrame:
    """``nearest`` for any number of references, exactly.

    Space is cut into leaves of about ``held`` places, where a sample of about ``sampled`` places has its medians. A query's nearest sampled
    place bounds its distance, and it goes to every leaf that isn't farther; there a tree of boxes finds its nearest reference.
    References of one place are one row, and a leaf with very many queries is looked into by several tasks. The sample
    decides about cost only. A reference without a finite place is never nearest; a query without one gets the least id and no distance.
    """
    spark, n = queries.sparkSession, range(len(dims))
    metric = Metric([float((weights or {}).get(d, 1.0)) for d in dims], [d in circular for d in dims])
    x = [f"x{k}" for k in n]
    place = [F.col(d).cast("double").alias(c) for d, c in zip(dims, x, strict=True)]
    placed = " and ".join(f"coalesce(abs({c}) < double('infinity'), false)" for c in x)
    q, r = queries.select(F.col(qid).alias("q"), *place), references.select(F.col(rid).alias("r"), *place)
    usable = r.filter(placed)
    places = usable.agg(F.approx_count_distinct(F.struct(*x)).alias("n")).first()["n"]
    part = usable.select(*x).filter(F.pmod(F.xxhash64(*x), F.lit(max(1, -(-places // sampled)))) == 0).distinct()
    sample = part.toPandas().to_numpy(float)
    lost = (q.filter(f"not ({placed})") if len(sample) else q).select("q").distinct().crossJoin(r.agg(F.min("r").alias("r")).filter("r is not null"))
    lost = lost.select(F.col("q").alias(qid), F.col("r").alias(rid), F.lit(None).cast("double").alias("distance"))
    if not len(sample):
        return lost
    levels = max(0, min(12, math.ceil(math.log2(max(1, places / held))), int(math.log2(max(1, len(sample) / 16)))))
    sample = sample[np.lexsort(sample.T)]
    leaves, tree = Leaves(sample, metric, levels), Tree(sample, metric)
    asked = q.filter(placed)
    total = asked.count()
    tried = asked.select(*x).sample(min(1.0, 20_000 / max(1, total)), seed=1).toPandas().to_numpy(float)
    load = np.bincount(leaves.within(tried, tree.nearest(tried)[0])[1], minlength=2**levels) * (total / max(1, len(tried)))
    shares = np.maximum(1, np.ceil(load / 50_000)).astype(int)  # tasks that look into a leaf
    tasks = int(min(1000, shares.sum()))
    held_by = spark.sparkContext.broadcast((leaves, tree, shares))

    def points(t) -> np.ndarray:
        return np.column_stack([t.column(c).to_numpy(zero_copy_only=False) for c in x]) if t.num_rows else np.zeros((0, len(x)))

    def deal(batches):
        leaves, _, shares = held_by.value
        for t in batches:
            leaf = leaves.of(points(t))
            row = np.repeat(np.arange(len(leaf)), k := shares[leaf])
            share = np.arange(len(row)) - np.repeat(np.cumsum(k) - k, k)
            yield pa.RecordBatch.from_arrays([*t.take(pa.array(row)).columns, pa.array(leaf[row]), pa.array(share)], [*t.schema.names, "leaf", "share"])

    def send(batches):
        leaves, tree, shares = held_by.value
        for t in batches:
            p = points(t)
            row, leaf = leaves.within(p, bound := tree.nearest(p)[0])
            share = t.column("h").to_numpy()[row] % shares[leaf]
            yield pa.RecordBatch.from_arrays([*t.take(pa.array(row)).columns, pa.array(bound[row]), pa.array(leaf), pa.array(share)], [*t.schema.names, "bound", "leaf", "share"])

    def look(a, b):
        if not a.num_rows or not b.num_rows:
            return pa.table([a.column("q").slice(0, 0), pa.array([], pa.float64()), b.column("r").slice(0, 0)], ["q", "d", "r"])
        b = b.sort_by("r")
        d, number = Tree(points(b), metric).nearest(points(a), a.column("bound").to_numpy())
        hit = np.flatnonzero(number >= 0)
        return pa.table([a.column("q").take(pa.array(hit)), pa.array(d[hit]), b.column("r").take(pa.array(number[hit]))], ["q", "d", "r"])

    kinds = {"q": dict(q.dtypes)["q"], "r": dict(r.dtypes)["r"]}
    coordinates = ", ".join(f"{c} double" for c in x)
    dealt = usable.groupBy(*x).agg(F.min("r").alias("r")).select("r", *x).mapInArrow(deal, f"r {kinds['r']}, {coordinates}, leaf long, share long")
    sent = asked.withColumn("h", F.shiftrightunsigned(F.xxhash64("q"), 2)).mapInArrow(send, f"q {kinds['q']}, {coordinates}, h long, bound double, leaf long, share long").drop("h")
    keys = ("leaf", "share")
    met = sent.repartition(tasks, *keys).groupBy(*keys).cogroup(dealt.repartition(tasks, *keys).groupBy(*keys))
    best = met.applyInArrow(look, f"q {kinds['q']}, d double, r {kinds['r']}").groupBy("q").agg(F.min(F.struct("d", "r")).alias("b"))
    return best.select(F.col("q").alias(qid), F.col("b.r").alias(rid), F.sqrt("b.d").alias("distance")).union(lost)


def asof_nearest(left: DataFrame, right: DataFrame, time: str, lid: str, rid: str, seconds: float, by: list[str]) -> DataFrame:
    """lid, rid, gap: the nearest right row in time, strictly within ``seconds``, the earlier on ties.

    Times are cut into bins as long as the tolerance; a left row meets its own and the neighbouring bins by equi-join, so
    pairs grow with density within the tolerance, never with the product of the tables.
    """
    t = lambda c: F.unix_micros(c) / 1e6
    a = left.select(*[F.col(b).alias(f"__{b}") for b in by], F.col(lid).alias("__l"), t(F.col(time)).alias("__ta"))
    a = a.withColumn("__bin", F.explode(F.array(*[F.floor(F.col("__ta") / seconds) + k for k in (-1, 0, 1)])))
    b = right.select(*[F.col(b).alias(f"__r{b}") for b in by], F.col(rid).alias("__r"), t(F.col(time)).alias("__tb"))
    b = b.withColumn("__rbin", F.floor(F.col("__tb") / seconds))
    on = [F.col("__bin") == F.col("__rbin")] + [F.col(f"__{k}") == F.col(f"__r{k}") for k in by]
    gap = F.abs(F.col("__ta") - F.col("__tb"))
    met = a.join(b, on).filter(gap < seconds)
    best = met.groupBy("__l").agg(F.min(F.struct(gap.alias("gap"), F.col("__tb").alias("t"), F.col("__r").alias("r"))).alias("b"))
    return best.select(F.col("__l").alias(lid), F.col("b.r").alias(rid), F.round("b.gap", 6).alias("gap"))


def shifted_accumulation(forcing: DataFrame, response: DataFrame, key: str, step: str, lag: str, amount: str, unit: str, out: list[str]) -> DataFrame:
    """Linear superposition: each forcing step adds its response at step + lag (a convolution as equi-join and sum)."""
    met = forcing.join(response, key)
    return met.groupBy((F.col(step) + F.col(lag)).alias("step"), *out).agg(F.sum(F.col(amount) * F.col(unit)).alias("level"))


#: Knots of a broken line that are broadcast to its points; the number is checked.
MOST_KNOTS = 1_000_000


def interpolate_at(df: DataFrame, x: str, knots: DataFrame, kx: str, ky: str, name: str) -> DataFrame:
    """The frame with the broken line's value at ``x``, flat beyond its ends (of knots with one x, in the order of their values).

    Up to MOST_KNOTS knots are broadcast as sorted arrays, and each batch of rows finds its brackets by binary search.
    """
    held = knots.select(F.col(kx).cast("double").alias("x"), F.col(ky).cast("double").alias("y")).dropna().limit(MOST_KNOTS + 1).toPandas().sort_values(["x", "y"])
    if len(held) > MOST_KNOTS:
        raise ValueError(f"more than {MOST_KNOTS} knots: thin the line first")
    line = df.sparkSession.sparkContext.broadcast((held["x"].to_numpy(), held["y"].to_numpy()))

    @F.pandas_udf("double")
    def at(v: pd.Series) -> pd.Series:
        a, b = line.value
        out = np.interp(v.to_numpy(float), a, b) if len(a) else np.full(len(v), np.nan)
        return pd.Series(out).where(v.notna().to_numpy(), None)

    return df.withColumn(name, at(F.col(x).cast("double")))


def bracket_interpolate(points: DataFrame, knots: DataFrame, x: str, y: str) -> DataFrame:
    """y at each point's x on the line between its knots, flat beyond them."""
    return interpolate_at(points.select(x), x, knots, x, y, y)
