"""Storm tracks, hydrographs, wave families and case-based reconstruction."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fathomlake.functions import geo, waves
from fathomlake.functions.angles import uv


def track_speed(df: DataFrame, storm: str, time: str, lat: str, lon: str) -> DataFrame:
    """The frame with km, hours, speed (km/h) and course since the last fix of the storm."""
    w = Window.partitionBy(storm).orderBy(time)
    prev = lambda c: F.lag(c).over(w)
    out = df.withColumn("km", F.radians(geo.arc_distance(prev(lat), prev(lon), F.col(lat), F.col(lon))) * geo.EARTH_KM)
    out = out.withColumn("hours", (F.unix_micros(time) - F.unix_micros(prev(time))) / 3.6e9)
    return out.withColumn("speed", F.try_divide("km", "hours")).withColumn("course", geo.azimuth(prev(lat), prev(lon), F.col(lat), F.col(lon)))


def circle_passages(df: DataFrame, storm: str, time: str, lat: str, lon: str, pressure: str, at: tuple[float, float], radius: float) -> DataFrame:
    """storm, n, entry, exit, min_pressure, mean_pressure, nearest: fixes within ``radius`` degrees of a point (lat, lon)."""
    near = df.withColumn("__d", geo.arc_distance(F.col(lat), F.col(lon), F.lit(at[0]), F.lit(at[1]))).filter(F.col("__d") < radius)
    return near.groupBy(storm).agg(
        F.count(F.lit(1)).alias("n"), F.min(time).alias("entry"), F.max(time).alias("exit"), F.min(pressure).alias("min_pressure"), F.avg(pressure).alias("mean_pressure"), F.min("__d").alias("nearest")
    )


def trim_to_hits(df: DataFrame, storm: str, time: str, hit) -> DataFrame:
    """Each storm's fixes from its first to its last hit (a boolean column): storms without one are gone."""
    part = Window.partitionBy(storm)
    first, last = F.min(F.when(hit, F.col(time))).over(part), F.max(F.when(hit, F.col(time))).over(part)
    return df.withColumn("__a", first).withColumn("__b", last).filter(F.col(time).between(F.col("__a"), F.col("__b"))).drop("__a", "__b")


def first_basin(df: DataFrame, storm: str, time: str, basin: str, wanted: str) -> DataFrame:
    """Storms whose first fix lies in a basin."""
    w = Window.partitionBy(storm).orderBy(time).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return df.withColumn("__f", F.first(basin).over(w)).filter(F.col("__f") == wanted).drop("__f")


def category_changes(outer: DataFrame, inner: DataFrame, storm: str, category: str, missing: int = 9) -> DataFrame:
    """before, after, n, probability, cumulative: category far from and near a site; storms that don't come near count as ``missing``."""
    both = outer.select(storm, F.col(category).alias("before")).join(inner.select(storm, F.col(category).alias("after")), storm, "left").fillna(missing, ["after"])
    n = both.groupBy("before", "after").agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy("before")
    n = n.withColumn("probability", F.col("n") / F.sum("n").over(w))
    return n.withColumn("cumulative", F.sum("n").over(w.orderBy("after")) / F.sum("n").over(w))


def category_grid(df: DataFrame, a: str, b: str, first: list[int], second: list[int]) -> DataFrame:
    """Counts over fixed category domains, zeros included."""
    spark = df.sparkSession
    domain = spark.createDataFrame([(x, y) for x in first for y in second], f"{a} int, {b} int")
    return domain.join(df.groupBy(a, b).count(), [a, b], "left").fillna(0, ["count"])


def wave_families(df: DataFrame, by: list[str], hs: str, tp: str, direction: str) -> DataFrame:
    """hs, tp, dir of families together: energies add, periods by energy over squared period, directions by energy."""
    e = F.col(hs) * F.col(hs)
    d = uv(F.col(direction))
    s = df.groupBy(*by).agg(F.sum(e).alias("e"), F.sum(e / (F.col(tp) * F.col(tp))).alias("m2"), F.sum(e * d["u"]).alias("u"), F.sum(e * d["v"]).alias("v"))
    return s.select(*by, F.sqrt("e").alias("hs"), F.sqrt(F.try_divide("e", "m2")).alias("tp"), F.pmod(F.degrees(F.atan2("u", "v")) + 360, F.lit(360.0)).alias("dir"))


def sector_families(df: DataFrame, by: list[str], hs: str, tp: str, direction: str, sectors: list[tuple[float, float]]) -> DataFrame:
    """The same within direction sectors [from, to), which may wrap; partitions outside all sectors are no swell."""
    x = F.pmod(F.col(direction), F.lit(360.0))
    name = F.lit(None).cast("int")
    for k, (a, b) in enumerate(sectors):
        name = F.when((x >= a) & (x < b) if a < b else (x >= a) | (x < b), k).otherwise(name)
    return wave_families(df.withColumn("sector", name).filter("sector is not null"), [*by, "sector"], hs, tp, direction)


def presence_patterns(df: DataFrame, group: str, cols: list[str]) -> DataFrame:
    """group, pattern (a bit for each column that has a value), n, probability."""
    bits = sum((F.when(F.col(c).isNotNull(), 1 << i).otherwise(0) for i, c in enumerate(cols)), F.lit(0))
    n = df.groupBy(group, bits.alias("pattern")).agg(F.count(F.lit(1)).alias("n"))
    return n.withColumn("probability", F.col("n") / F.sum("n").over(Window.partitionBy(group)))


def run_maxima(df: DataFrame, label: str, order: list[str], by: list[str], proxy, rid: str) -> DataFrame:
    """by, run, label, rid, proxy: the row with the largest proxy in each stretch of one label (least id on ties)."""
    w = Window.partitionBy(*by).orderBy(*order)
    new = F.when(F.col(label).eqNullSafe(F.lag(label).over(w)) & (F.row_number().over(w) > 1), 0).otherwise(1)
    marked = df.withColumn("__p", proxy).withColumn("__new", new).withColumn("run", F.sum("__new").over(w))
    best = marked.groupBy(*by, "run", label).agg(F.max(F.struct(F.col("__p").alias("p"), (-F.col(rid)).alias("i"))).alias("b"))
    return best.select(*by, "run", label, (-F.col("b.i")).alias(rid), F.col("b.p").alias("proxy"))


def hydrographs(df: DataFrame, label: str, time: str, hs: str, tp: str, by: list[str], days: float = 4.0) -> DataFrame:
    """by, run, label, twl_max, mu, tau of stretches of at most ``days``: area under the level over its peak and length, and when it peaks."""
    w = Window.partitionBy(*by).orderBy(time)
    new = F.when(F.col(label).eqNullSafe(F.lag(label).over(w)) & (F.row_number().over(w) > 1), 0).otherwise(1)
    level = 0.1 * F.sqrt(F.col(hs)) * F.col(tp)
    rows = df.withColumn("twl", level).withColumn("__t", F.unix_micros(time) / 3.6e9).withColumn("__new", new).withColumn("run", F.sum("__new").over(w))
    r = Window.partitionBy(*by, "run").orderBy(time)
    rows = rows.withColumn("__area", (F.col("twl") + F.lag("twl").over(r)) / 2 * (F.col("__t") - F.lag("__t").over(r)))
    s = rows.groupBy(*by, "run", label).agg(F.max(F.struct("twl", (-F.col("__t")).alias("t"))).alias("b"), F.sum("__area").alias("area"), F.min("__t").alias("a"), F.max("__t").alias("z"))
    span = F.col("z") - F.col("a")
    s = s.filter((span > 0) & (span <= 24 * days))
    return s.select(*by, "run", label, F.col("b.twl").alias("twl_max"), F.try_divide(F.col("area"), F.col("b.twl") * span).alias("mu"), F.try_divide(-F.col("b.t") - F.col("a"), span).alias("tau"))


def triangular_hydrograph(df: DataFrame, rid: str, peak: str, hours: str, tau: str) -> DataFrame:
    """rid, hour, level: straight rise to the peak at tau of the duration, straight fall after it."""
    rows = df.select(rid, peak, hours, tau, F.explode(F.sequence(F.lit(0), F.ceil(hours).cast("int"))).alias("hour"))
    x = F.col("hour") / F.col(hours)
    up, down = F.try_divide(x, F.col(tau)), F.try_divide(1 - x, 1 - F.col(tau))
    return rows.select(rid, "hour", (F.col(peak) * F.greatest(F.lit(0.0), F.least(F.coalesce(up, F.lit(1.0)), F.coalesce(down, F.lit(1.0))))).alias("level"))


def interpolate_tracks(df: DataFrame, storm: str, time: str, lat: str, lon: str, values: list[str], minutes: int) -> DataFrame:
    """Positions every ``minutes`` between fixes along great circles, values on straight lines. Fixes of one time have none between them."""
    w = Window.partitionBy(storm).orderBy(time)
    nxt = lambda c: F.lead(c).over(w)
    rows = df.select(storm, time, lat, lon, *values, nxt(time).alias("__t"), nxt(lat).alias("__lat"), nxt(lon).alias("__lon"), *[nxt(v).alias(f"__{v}") for v in values]).filter(F.col("__t") > F.col(time))
    arc, course = geo.arc_distance(F.col(lat), F.col(lon), F.col("__lat"), F.col("__lon")), geo.azimuth(F.col(lat), F.col(lon), F.col("__lat"), F.col("__lon"))
    stop = F.col("__t") - F.expr("interval 1 microsecond")
    steps = rows.select("*", arc.alias("__arc"), course.alias("__course"), F.explode(F.sequence(F.col(time), stop, F.expr(f"interval {minutes} minutes"))).alias("at_time"))
    f = (F.unix_micros("at_time") - F.unix_micros(time)) / (F.unix_micros("__t") - F.unix_micros(time))
    p = geo.shoot(F.col(lat), F.col(lon), F.col("__course"), F.col("__arc") * f)
    return steps.select(storm, F.col("at_time").alias(time), p["lat"].alias(lat), p["lon"].alias(lon), *[(F.col(v) + (F.col(f"__{v}") - F.col(v)) * f).alias(v) for v in values])


def spectrum_cases(spark, freqs: list[float], dirs: list[float], sectors: tuple[float, float] | None = None) -> DataFrame:
    """case_num, freq, dir, hs: a unit case for each bin; 1 m above 5 s, else 0.1 m."""
    bins = spark.createDataFrame([(f, d) for f in freqs for d in dirs if sectors is None or sectors[0] <= d % 360 < sectors[1]], "freq double, dir double")
    return bins.select((F.row_number().over(Window.orderBy("freq", "dir")) - 1).alias("case_num"), "freq", "dir", F.when(1 / F.col("freq") > 5, 1.0).otherwise(0.1).alias("hs"))


def random_phase_series(spark, hs: float, tp: float, seconds: int, dt: float = 1.0, n: int = 60, seed: int = 1) -> DataFrame:
    """t, level: sum of cosines with the spectrum's amplitudes and random phases."""
    f = spark.range(n).select((0.02 + F.col("id") * (0.98 / (n - 1))).alias("f"), (F.rand(seed) * (2 * math.pi)).alias("phase"))
    f = f.withColumn("a", F.sqrt(2 * waves.jonswap(F.col("f"), F.lit(float(hs)), F.lit(float(tp))) * (0.98 / (n - 1))))
    t = spark.range(int(seconds / dt)).select((F.col("id") * dt).alias("t"))
    return t.crossJoin(F.broadcast(f)).groupBy("t").agg(F.sum(F.col("a") * F.cos(2 * math.pi * F.col("f") * F.col("t") + F.col("phase"))).alias("level"))


def regular_series(spark, h1: float, t1: float, h2: float, t2: float, seconds: int) -> DataFrame:
    """t, level of one or two regular waves."""
    t = F.col("id").cast("double")
    return spark.range(seconds).select(t.alias("t"), (h1 / 2 * F.cos(2 * math.pi * t / t1) + h2 / 2 * F.cos(2 * math.pi * t / t2)).alias("level"))


def fit_direction_factors(df: DataFrame, target: str, hs: str, direction: str, bins: int = 16) -> dict[int, float]:
    """Factor for each direction bin: least squares of squared heights. Bins don't overlap, so each is a ratio of two sums; below zero or
    indistinct from it (t under 1.96) the factor is 1."""
    b = F.floor(F.pmod(F.col(direction), F.lit(360.0)) / (360.0 / bins)).cast("int").alias("bin")
    x, y = F.col(hs) * F.col(hs), F.col(target) * F.col(target)
    s = df.groupBy(b).agg(F.count(F.lit(1)).alias("n"), F.sum(x * x).alias("xx"), F.sum(x * y).alias("xy"), F.sum(y * y).alias("yy")).filter("xx > 0")
    out = {}
    for r in s.collect():  # at most ``bins`` rows
        beta = r["xy"] / r["xx"]
        var = max(0.0, r["yy"] - beta * r["xy"]) / max(1, r["n"] - 1) / r["xx"]
        out[r["bin"]] = math.sqrt(beta) if beta > 0 and beta > 1.96 * math.sqrt(var) else 1.0
    return out


def correct_heights(df: DataFrame, hs: str, direction: str, factors: dict[int, float], bins: int = 16) -> DataFrame:
    b = F.floor(F.pmod(F.col(direction), F.lit(360.0)) / (360.0 / bins)).cast("int")
    return df.withColumn("hs_corrected", F.col(hs) * F.coalesce(*[F.when(b == k, float(v)) for k, v in factors.items()], F.lit(1.0)))


def seasonal_gev_fits(df: DataFrame, value: str, year_fraction: str, by: str, least: int = 30) -> DataFrame:
    """by, n, b0, b_cos, b_sin, log_scale, shape, nll, aic: GEV whose location follows the year. A group is one series of maxima."""
    from .extremes import _nll_gev, fit_gev, nelder_mead

    def fit(p: pd.DataFrame) -> pd.DataFrame:
        x, t = p[value].to_numpy(float), 2 * math.pi * p[year_fraction].to_numpy(float)
        names = [by, "n", "b0", "b_cos", "b_sin", "log_scale", "shape", "nll", "aic"]
        if len(x) < least:
            return pd.DataFrame({n: [] for n in names})
        g = fit_gev(x)
        nll = lambda q: _nll_gev(np.array([0.0, math.exp(min(q[3], 50)), q[4]]), x - q[0] - q[1] * np.cos(t) - q[2] * np.sin(t))
        q = nelder_mead(nll, np.array([g[0], 0.0, 0.0, math.log(g[1]), g[2]]), steps=600)
        v = nll(q)
        return pd.DataFrame([[p[by].iloc[0], len(x), *q, v, 2 * v + 10]], columns=names)

    kind = dict(df.dtypes)[by]
    return df.select(by, value, year_fraction).groupBy(by).applyInPandas(fit, f"{by} {kind}, n long, b0 double, b_cos double, b_sin double, log_scale double, shape double, nll double, aic double")


def autologistic_model(df: DataFrame, label: str, time: str, by: list[str]):
    """Fitted multinomial logit of a label on the season and the label before, and the frame of its terms."""
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import OneHotEncoder, StringIndexer, VectorAssembler

    from .series import year_fraction

    w = Window.partitionBy(*by).orderBy(time)
    t = 2 * math.pi * year_fraction(F.col(time))
    terms = df.withColumn("__prev", F.lag(label).over(w)).filter("__prev is not null").withColumn("__cos", F.cos(t)).withColumn("__sin", F.sin(t))
    stages = [
        StringIndexer(inputCol=label, outputCol="__y"), StringIndexer(inputCol="__prev", outputCol="__p"), OneHotEncoder(inputCol="__p", outputCol="__h"),
        VectorAssembler(inputCols=["__cos", "__sin", "__h"], outputCol="__x"), LogisticRegression(featuresCol="__x", labelCol="__y", family="multinomial", regParam=1e-5, predictionCol="__c", probabilityCol="probability"),
    ]
    return Pipeline(stages=stages).fit(terms), terms


def storm_segments(df: DataFrame, storm: str, time: str, lat: str, lon: str, pressure: str, wind: str, radius: str, warm: int = 4) -> DataFrame:
    """Every inner fix of a storm (6 hours apart) as a target segment behind a warm-up of ``warm`` segments.

    Adds warm-up speed (kt) and heading, the last warm-up segment's pressure, wind and radius, the change of all of them
    over the target segment, and the end points (lat_w, lon_w), (lat_i, lon_i), (lat_t, lon_t). Where fewer segments
    precede, the first one is prolonged backwards along its great circle. Turns count to the right in the northern hemisphere.
    """
    w = Window.partitionBy(storm).orderBy(time)
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    rows = df.select("*", (F.row_number().over(w) - 1).alias("__i"), F.count(F.lit(1)).over(whole).alias("__n"))
    for c in (lat, lon, pressure, wind, radius, time):
        rows = rows.withColumn(f"__p_{c}", F.lag(c).over(w)).withColumn(f"__n_{c}", F.lead(c).over(w)).withColumn(f"__w_{c}", F.lag(c, warm).over(w))
    for c in (lat, lon):
        rows = rows.withColumn(f"__0_{c}", F.first(c).over(whole)).withColumn(f"__1_{c}", F.nth_value(c, 2).over(whole))
    back = geo.azimuth(F.col(f"__0_{lat}"), F.col(f"__0_{lon}"), F.col(f"__1_{lat}"), F.col(f"__1_{lon}")) + 180
    arc = geo.arc_distance(F.col(f"__0_{lat}"), F.col(f"__0_{lon}"), F.col(f"__1_{lat}"), F.col(f"__1_{lon}")) * (warm - F.col("__i"))
    shot = geo.shoot(F.col(f"__0_{lat}"), F.col(f"__0_{lon}"), back, arc)
    rows = rows.withColumn("lat_w", F.coalesce(F.col(f"__w_{lat}"), shot["lat"])).withColumn("lon_w", F.coalesce(F.col(f"__w_{lon}"), shot["lon"]))
    rows = rows.withColumn("lat_i", F.col(lat)).withColumn("lon_i", F.col(lon)).withColumn("lat_t", F.col(f"__n_{lat}")).withColumn("lon_t", F.col(f"__n_{lon}"))
    hours = (F.unix_micros(F.col(f"__n_{time}")) - F.unix_micros(time)) / 3.6e9
    v0 = geo.mean_velocity(F.col("lat_w"), F.col("lon_w"), F.col("lat_i"), F.col("lon_i"), F.lit(6.0 * warm))["speed"]
    v1 = geo.mean_velocity(F.col("lat_i"), F.col("lon_i"), F.col("lat_t"), F.col("lon_t"), hours)["speed"]
    a0, a1 = geo.azimuth(F.col("lat_w"), F.col("lon_w"), F.col("lat_i"), F.col("lon_i")), geo.azimuth(F.col("lat_i"), F.col("lon_i"), F.col("lat_t"), F.col("lon_t"))
    turn = a1 - a0
    turn = F.when(turn > 180, turn - 360).when(turn < -180, turn + 360).when(F.abs(turn) != 180, turn)
    changes = [(F.col(c) - F.col(f"__p_{c}")).alias(n) for c, n in ((pressure, "dpseg"), (wind, "dwseg"), (radius, "drseg"))]
    before = [F.col(f"__p_{c}").alias(n) for c, n in ((pressure, "pseg"), (wind, "wseg"), (radius, "rseg"))]
    inner = rows.filter((F.col("__i") >= 1) & (F.col("__i") <= F.col("__n") - 2))
    return inner.select(
        *df.columns, (v0 / 1.852).alias("vseg"), ((v1 - v0) / 1.852).alias("dvseg"), *before, *changes, a0.alias("aseg"), (F.signum(lat) * turn).alias("daseg"),
        F.col(lat).alias("lseg"), F.abs(lat).alias("laseg"), F.abs(F.col("lat_t") - F.col(lat)).alias("dlaseg"), "lat_w", "lon_w", "lat_i", "lon_i", "lat_t", "lon_t",
    )


def trim_segments(df: DataFrame, storm: str, time: str, at: tuple[float, float], radius: float) -> DataFrame:
    """Segments from a storm's first to its last with an end of its target nearer than ``radius`` degrees to a point (lat, lon); a single segment is no storm."""
    d = [geo.arc_distance(F.col(f"lat_{k}"), F.col(f"lon_{k}"), F.lit(float(at[0])), F.lit(float(at[1]))) for k in ("i", "t")]
    many = df.withColumn("__k", F.count(F.lit(1)).over(Window.partitionBy(storm))).filter("__k > 1").drop("__k")
    return trim_to_hits(many, storm, time, F.least(*d) < radius)


def straight_tracks(cases: DataFrame, case: str, hours: int) -> DataFrame:
    """case, hour, lat, lon of storms that move on straight lines from where they enter a box's side.

    ``cases`` has case, pmin, vmean (km/h), delta and gamma (degrees), x0, y0, x1 and r: the storm passes the circle of radius r about
    (x0, y0) at bearing delta, on course gamma, and comes from longitude x1.
    """
    d, g = F.radians("delta"), F.radians("gamma")
    xc, yc = F.col("x0") + F.col("r") * F.sin(d), F.col("y0") + F.col("r") * F.cos(d)
    y1 = yc + (F.col("x1") - xc) / F.sin(g) * F.cos(g)
    step = F.degrees(F.col("vmean") / 6378.135)
    rows = cases.withColumn("__y1", y1).withColumn("hour", F.explode(F.sequence(F.lit(0), F.lit(hours - 1))))
    return rows.select(case, "hour", (F.col("__y1") - step * F.cos(g) * F.col("hour")).alias("lat"), (F.col("x1") - step * F.sin(g) * F.col("hour")).alias("lon"), "pmin")


def extended_track(df: DataFrame, storm: str, time: str, minutes: int, extra_hours: float) -> DataFrame:
    """A storm's rows on a regular time axis that goes on ``extra_hours`` behind its last fix; new rows are null, and level and tide are 0."""
    ends = df.groupBy(storm).agg(F.min(time).alias("a"), F.max(time).alias("b"))
    steps = F.floor(((F.unix_micros("b") - F.unix_micros("a")) / 3.6e9 + extra_hours) * 60 / minutes).cast("long")
    axis = ends.filter(steps > 0).select(storm, F.explode(F.sequence(F.lit(0).cast("long"), steps - 1)).alias("step"), F.col("a"))
    axis = axis.select(storm, F.timestamp_micros(F.unix_micros("a") + F.col("step") * (minutes * 60_000_000)).alias(time))
    return axis.join(df, [storm, time], "left").withColumn("level", F.lit(0.0)).withColumn("tide", F.lit(0.0))


def synthetic_tracks(df: DataFrame, storm: str, time: str, lat: str, lon: str, pressure: str) -> DataFrame:
    """Fixes with a time and a pressure, times rounded to the hour, with basin, speed (kt), course, category, timestep (hours) and the storm's mean speed."""
    hour = F.timestamp_micros(F.floor(F.unix_micros(time) / 3.6e9 + 0.5).cast("long") * 3_600_000_000)
    rows = df.filter(F.col(time).isNotNull() & F.col(pressure).isNotNull() & ~F.isnan(pressure))
    rows = rows.withColumn(time, hour).withColumn(lon, F.when(F.col(lon) < 0, F.col(lon) + 360).otherwise(F.col(lon)))
    w = Window.partitionBy(storm).orderBy(time)
    nxt = lambda c: F.lead(c).over(w)
    step = (F.unix_micros(nxt(time)) - F.unix_micros(time)) / 3.6e9
    rows = rows.withColumn("timestep", step).withColumn("__v", geo.mean_velocity(F.col(lat), F.col(lon), nxt(lat), nxt(lon), F.nullif(step, F.lit(0.0))))
    rows = rows.withColumn("speed", F.col("__v.speed") / 1.852).withColumn("course", F.col("__v.course"))
    rows = rows.withColumn("storm_speed", F.avg("speed").over(Window.partitionBy(storm)))
    return rows.withColumn("basin", geo.ocean_basin(F.col(lat), F.col(lon))).withColumn("category", geo.storm_category(F.col(pressure))).drop("__v")


def spectral_series(spark, systems: list[tuple[float, float, float]], seconds: int, dt: float = 1.0, n: int = 60, depth: float | None = None, seed: str = "1") -> DataFrame:
    """t, level of the sea of several wave systems (hs, tp, gamma): cosines with the spectra's amplitudes and phases drawn from an MD5.

    With a ``depth`` each system's spectrum takes the shape that shallow water leaves, and keeps its energy.
    """
    step = 0.98 / (n - 1)
    f = spark.range(n).select("id", (0.02 + F.col("id") * step).alias("f"))
    spectra = [F.when(F.col("f") > 0, waves.jonswap(F.col("f"), F.lit(float(h)), F.lit(float(t)), g)) for h, t, g in systems]
    f = f.select("id", "f", *[s.alias(f"s{i}") for i, s in enumerate(spectra)], *([waves.shallow_factor(F.col("f"), F.lit(float(depth))).alias("fi")] if depth else []))
    total = F.lit(0.0)
    whole = Window.orderBy("id").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)  # n rows
    area = lambda c: F.sum(F.when((F.col("id") == 0) | (F.col("id") == n - 1), c / 2).otherwise(c)).over(whole)
    for i in range(len(systems)):
        s = F.col(f"s{i}")
        total = total + (s * F.col("fi") * area(s) / area(s * F.col("fi")) if depth else s)
    bits = F.conv(F.substring(F.md5(F.concat(F.lit(seed + ":"), F.col("id").cast("string"))), 1, 13), 16, 10).cast("double")
    f = f.select("f", F.sqrt(2 * total * step).alias("a"), ((bits + 0.5) / float(1 << 52) * (2 * math.pi)).alias("phase"))
    t = spark.range(int(seconds / dt)).select((F.col("id") * dt).alias("t"))
    return t.crossJoin(F.broadcast(f)).groupBy("t").agg(F.sum(F.col("a") * F.cos(2 * math.pi * F.col("f") * F.col("t") + F.col("phase"))).alias("level"))


def superpoint(df: DataFrame, station: str, direction: str, energy: str, by: list[str], sectors: dict[str, tuple[float, float]], overlap: float = 0.0) -> DataFrame:
    """by, direction, energy of stations put together, each with its sector of directions; a sector whose ends fall wraps.

    Without overlap a sector holds its start and not its end. With it, sectors are widened on both sides with their ends, and where
    several hold a direction their energies are averaged.
    """
    x = F.col(direction)
    inside = F.lit(False)
    for name, (a, b) in sectors.items():
        if overlap:
            hit = (x >= a - overlap) | (x <= b + overlap) if b < a else (x >= a - overlap) & (x <= b + overlap)
        else:
            hit = (x >= a) & (x < b) if a < b else (x >= a) | (x < b)
        inside = inside | ((F.col(station) == name) & hit)
    out = df.groupBy(*by, direction).agg(F.coalesce(F.sum(F.when(inside, F.col(energy))), F.lit(0.0)).alias("e"), F.count(F.when(inside, 1)).alias("k"))
    return out.select(*by, direction, (F.col("e") / F.greatest(F.col("k"), F.lit(1)) if overlap else F.col("e")).alias(energy))


def altimeter_heights(df: DataFrame, lat: str, lon: str, depth: str, box: tuple[float, float, float, float], flags: list[str], heights: list[str], deepest: float = -200.0) -> DataFrame:
    """Good altimeter rows inside a box (lat from, to, lon from, to) over deep water, with hs_cal: the bands' heights added, null as 0."""
    total = lambda cols: sum((F.coalesce(F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double")), F.lit(0.0)) for c in cols), F.lit(0.0))
    inside = (F.col(lat) > box[0]) & (F.col(lat) < box[1]) & (F.col(lon) > box[2]) & (F.col(lon) < box[3]) & (F.col(depth) < deepest)
    return df.filter(inside & (total(flags) < 1.5)).withColumn("hs_cal", total(heights))


def runup_heights(df: DataFrame, case: str, order: str, level: str) -> DataFrame:
    """case, ru2: the 98th percentile of a run-up series' local peaks."""
    w = Window.partitionBy(case).orderBy(order)
    peaks = df.withColumn("__a", F.lag(level).over(w)).withColumn("__b", F.lead(level).over(w)).filter((F.col(level) > F.col("__a")) & (F.col(level) > F.col("__b")))
    return peaks.groupBy(case).agg(F.percentile(level, F.lit(0.98)).alias("ru2"))


def level_statistics(df: DataFrame, by: list[str], level: str) -> DataFrame:
    """by, setup (mean level), hrms (2 sqrt 2 standard deviations)."""
    return df.groupBy(*by).agg(F.avg(level).alias("setup"), (2 * math.sqrt(2) * F.stddev_pop(level)).alias("hrms"))


def presence_matrix(spark, names: list[str]) -> DataFrame:
    """pattern and a 0/1 column for each name: every pattern with at least one present, the last being all."""
    if len(names) > 20:
        raise ValueError("at most 20 names: patterns double with each")
    bits = F.col("id") + 1
    return spark.range((1 << len(names)) - 1).select(bits.alias("pattern"), *[F.shiftright(bits, i).bitwiseAND(F.lit(1)).cast("int").alias(n) for i, n in enumerate(names)])
