"""Extremes: block maxima, peaks over threshold, tail statistics, fits and bootstrap."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .frames import global_ranks


def block_maxima(df: DataFrame, value: str, time: str, by: list[str], kind: str = "year") -> DataFrame:
    """Largest value of each series' year or month, with its time (the earliest on ties)."""
    block = F.date_trunc(kind, time).alias("block")
    best = F.max(F.struct(F.col(value).alias("v"), (-F.unix_micros(time)).alias("t")))
    out = df.groupBy(*by, block).agg(best.alias("b"))
    return out.select(*by, "block", F.col("b.v").alias(value), F.timestamp_micros(-F.col("b.t")).alias("peak_ts"))


def fixed_block_maxima(df: DataFrame, value: str, order: list[str], by: list[str], size: float) -> DataFrame:
    """Largest value of every ``size`` rows of a series."""
    k = F.row_number().over(Window.partitionBy(*by).orderBy(*order)) - 1
    return df.withColumn("block", F.floor(k / size)).groupBy(*by, "block").agg(F.max(value).alias(value))


def ecdf(df: DataFrame, value: str, by: list[str]) -> DataFrame:
    """Rank by (n + 1)."""
    ranked = global_ranks(df, value, by, name="__rank", total="__total")
    return ranked.select(*df.columns, (F.col("__rank") / (F.col("__total") + 1)).alias("ecdf"))


def mean_excess(df: DataFrame, value: str, thresholds: list[float]) -> DataFrame:
    """threshold, n, mean_excess, std_excess: one pass with a conditional aggregate for each threshold."""
    over = [F.when(F.col(value) > u, F.col(value) - u) for u in thresholds]
    wide = df.agg(*[F.struct(F.lit(float(u)).alias("threshold"), F.count(x).alias("n"), F.avg(x).alias("mean_excess"), F.stddev_samp(x).alias("std_excess")).alias(f"u{i}") for i, (u, x) in enumerate(zip(thresholds, over))])
    return wide.select(F.explode(F.array(*[F.col(f"u{i}") for i in range(len(thresholds))])).alias("x")).select("x.*")


def peaks_over_threshold(df: DataFrame, value: str, time: str, by: list[str], threshold: float, days: float = 3.0) -> DataFrame:
    """by, event, peak, peak_ts, n, excess: runs at or over the threshold, those whose peaks are less than ``days`` apart taken as one event."""
    w = Window.partitionBy(*by).orderBy(time)
    over = F.col(value) >= threshold
    marked = df.withColumn("__over", over).withColumn("__new", F.when(over & ~F.coalesce(F.lag(over).over(w), F.lit(False)), 1).otherwise(0))
    marked = marked.withColumn("__run", F.sum("__new").over(w)).filter("__over")
    best = F.max(F.struct(F.col(value).alias("v"), (-F.unix_micros(time)).alias("t"))).alias("b")
    runs = marked.groupBy(*by, "__run").agg(best, F.count(F.lit(1)).alias("n"), F.sum(F.col(value) - threshold).alias("excess"))
    runs = runs.select(*by, F.col("b.v").alias("peak"), (-F.col("b.t")).alias("t"), "n", "excess")
    r = Window.partitionBy(*by).orderBy("t")
    apart = F.coalesce(F.col("t") - F.lag("t").over(r) >= days * 86400e6, F.lit(True))
    runs = runs.withColumn("event", F.sum(F.when(apart, 1).otherwise(0)).over(r))
    out = runs.groupBy(*by, "event").agg(F.max(F.struct("peak", (-F.col("t")).alias("t"))).alias("b"), F.sum("n").alias("n"), F.sum("excess").alias("excess"))
    return out.select(*by, "event", F.col("b.peak").alias("peak"), F.timestamp_micros(-F.col("b.t")).alias("peak_ts"), "n", "excess")


def local_peaks(df: DataFrame, value: str, order: list[str], by: list[str]) -> DataFrame:
    """Rows greater than both neighbours."""
    w = Window.partitionBy(*by).orderBy(*order)
    return df.withColumn("__a", F.lag(value).over(w)).withColumn("__b", F.lead(value).over(w)).filter(F.col(value) > F.greatest("__a", "__b")).drop("__a", "__b")


def nelder_mead(f, x0: np.ndarray, steps: int = 400, tol: float = 1e-6) -> np.ndarray:
    """Downhill simplex with the usual coefficients 1, 2, 1/2, 1/2."""
    n = len(x0)
    s = np.vstack([x0, *[x0 + np.eye(n)[i] * (0.1 * abs(x0[i]) or 0.05) for i in range(n)]])
    v = np.array([f(x) for x in s])
    for _ in range(steps * n):
        o = np.argsort(v, kind="stable")
        s, v = s[o], v[o]
        if np.abs(s[1:] - s[0]).max() < tol and np.abs(v[1:] - v[0]).max() < tol:
            break
        mid = s[:-1].mean(0)
        r = 2 * mid - s[-1]
        fr = f(r)
        if fr < v[0]:
            e = 3 * mid - 2 * s[-1]
            fe = f(e)
            s[-1], v[-1] = (e, fe) if fe < fr else (r, fr)
        elif fr < v[-2]:
            s[-1], v[-1] = r, fr
        else:
            c = (mid + (r if fr < v[-1] else s[-1])) / 2
            fc = f(c)
            if fc < min(fr, v[-1]):
                s[-1], v[-1] = c, fc
            else:
                s[1:] = (s[1:] + s[0]) / 2
                v[1:] = [f(x) for x in s[1:]]
    return s[np.argmin(v)]


def _nll_gev(p: np.ndarray, x: np.ndarray) -> float:
    loc, scale, xi = p
    if scale <= 0:
        return math.inf
    z = (x - loc) / scale
    if abs(xi) < 1e-8:
        return float(len(x) * math.log(scale) + z.sum() + np.exp(-z).sum())
    b = 1 + xi * z
    if b.min() <= 0:
        return math.inf
    return float(len(x) * math.log(scale) + (1 + 1 / xi) * np.log(b).sum() + (b ** (-1 / xi)).sum())


def _nll_gpd(p: np.ndarray, y: np.ndarray) -> float:
    scale, xi = p
    if scale <= 0:
        return math.inf
    if abs(xi) < 1e-8:
        return float(len(y) * math.log(scale) + y.sum() / scale)
    b = 1 + xi * y / scale
    return math.inf if b.min() <= 0 else float(len(y) * math.log(scale) + (1 + 1 / xi) * np.log(b).sum())


def fit_gev(x: np.ndarray) -> np.ndarray:
    """loc, scale, shape by maximum likelihood, from the moments of a Gumbel distribution."""
    s = max(float(x.std()), 1e-9) * math.sqrt(6) / math.pi
    return nelder_mead(lambda p: _nll_gev(p, x), np.array([float(x.mean()) - 0.5772 * s, s, 0.1]))


def fit_gpd(x: np.ndarray, threshold: float) -> np.ndarray:
    """scale, shape by maximum likelihood of the strict exceedances."""
    y = x[x > threshold] - threshold
    return nelder_mead(lambda p: _nll_gpd(p, y), np.array([max(float(y.mean()), 1e-9), 0.1]))


def gev_fits(df: DataFrame, value: str, by: str, least: int = 10) -> DataFrame:
    """by, n, loc, scale, shape, nll for each series with enough maxima. Each group is a series of block maxima, small by nature."""

    def fit(p: pd.DataFrame) -> pd.DataFrame:
        x = p[value].dropna().to_numpy(float)
        if len(x) < least:
            return pd.DataFrame({by: [], "n": [], "loc": [], "scale": [], "shape": [], "nll": []})
        q = fit_gev(x)
        return pd.DataFrame({by: [p[by].iloc[0]], "n": [len(x)], "loc": [q[0]], "scale": [q[1]], "shape": [q[2]], "nll": [_nll_gev(q, x)]})

    kind = dict(df.dtypes)[by]
    return df.select(by, value).groupBy(by).applyInPandas(fit, f"{by} {kind}, n long, loc double, scale double, shape double, nll double")


def gpd_fits(df: DataFrame, value: str, by: str, threshold: float, least: int = 10) -> DataFrame:
    """by, n, scale, shape of each series' exceedances; rows under the threshold don't leave the scan."""

    def fit(p: pd.DataFrame) -> pd.DataFrame:
        x = p[value].to_numpy(float)
        if len(x) < least:
            return pd.DataFrame({by: [], "n": [], "scale": [], "shape": []})
        q = fit_gpd(x, threshold)
        return pd.DataFrame({by: [p[by].iloc[0]], "n": [len(x)], "scale": [q[0]], "shape": [q[1]]})

    kind = dict(df.dtypes)[by]
    return df.filter(F.col(value) > threshold).select(by, value).groupBy(by).applyInPandas(fit, f"{by} {kind}, n long, scale double, shape double")


#: Most block maxima that one bootstrap holds in the driver and in each Python worker (8 bytes each, a few copies while fitting).
MOST_MAXIMA = 10_000_000


def gev_return_levels(maxima: DataFrame, value: str, years: list[float], resamples: int = 100, level: float = 0.95, seed: int = 1) -> DataFrame:
    """years, low, middle, high: bootstrap of the GEV's return levels. One series of maxima; resamples are spread over tasks.

    Every maximum is resampled (null and NaN are left out). More than MOST_MAXIMA raise ValueError.
    """
    v = F.col(value).cast("double").alias("v")
    found = maxima.select(v).filter("v is not null and not isnan(v)").limit(MOST_MAXIMA + 1).toArrow()
    if found.num_rows > MOST_MAXIMA:
        raise ValueError(f"more than {MOST_MAXIMA} block maxima: take longer blocks or one series at a time")
    spark = maxima.sparkSession
    held = spark.sparkContext.broadcast(np.sort(found["v"].to_numpy()))

    def resample(parts):
        x = held.value
        for p in parts:
            rows = []
            for i in p["id"]:
                rng = np.random.default_rng([seed, int(i)])
                loc, scale, xi = fit_gev(rng.choice(x, len(x)))
                for t in years:
                    y = -math.log(1 - 1 / t)
                    rows.append((t, loc - scale * math.log(y) if abs(xi) < 1e-8 else loc + scale / xi * (y**-xi - 1)))
            yield pd.DataFrame(rows, columns=["years", "level"])

    a = (1 - level) / 2
    out = spark.range(resamples).mapInPandas(resample, "years double, level double").groupBy("years")
    return out.agg(*[F.percentile("level", F.lit(q)).alias(n) for n, q in (("low", a), ("middle", 0.5), ("high", 1 - a))])


def quantile_map(sim: DataFrame, value: str, by: list[str], loc: float, scale: float, xi: float) -> DataFrame:
    """Simulated maxima corrected by rank: the historical GEV's quantile at rank / (n + 1)."""
    from fathomlake.functions.extremes import gev_quantile

    return ecdf(sim, value, by).withColumn("corrected", gev_quantile(F.col("ecdf"), loc, scale, xi))


def cramer_von_mises(df: DataFrame, value: str, cdf) -> DataFrame:
    """n and the statistic 1/12n + sum ((2i - 1)/2n - F(x_i))^2."""
    ranked = global_ranks(df.select(F.col(value).alias("__v")).dropna(), "__v", name="__i", total="__n", unique=True)
    gap = F.pow((2 * F.col("__i") - 1) / (2 * F.col("__n")) - cdf(F.col("__v")), F.lit(2.0))
    return ranked.select(gap.alias("g")).agg(F.count("g").alias("n"), (1 / (12 * F.count("g")) + F.sum("g")).alias("statistic"))


def cramer_von_mises_p(statistic: float) -> float:
    """Chance of a larger statistic under the hypothesis, from the series of the limiting distribution."""
    if statistic <= 0:
        return 1.0
    t = np.linspace(0, 12, 4001)
    total, factor = 0.0, 1.0
    for k in range(30):
        y = (4 * k + 1) ** 2 / (16 * statistic)
        bessel = np.trapezoid(np.exp(-2 * y - y * (np.cosh(t) - 1)) * np.cosh(t / 4), t)  # exp(-y) K_1/4(y)
        total += factor * math.sqrt(4 * k + 1) * bessel
        factor *= (k + 0.5) / (k + 1)
    return float(min(1.0, max(0.0, 1 - total / (math.pi * math.sqrt(statistic)))))


def fit_distribution(x: np.ndarray, kind: str, fixed: dict[int, float] | None = None) -> np.ndarray:
    """Parameters of a GEV (location, scale, shape) or GPD (threshold, scale, shape) by maximum likelihood; those of ``fixed`` (by place) stay."""
    fixed = fixed or ({0: 0.0} if kind == "gpd" else {})
    start = np.array([float(x.mean()), max(float(x.std()), 1e-9), 0.1])
    free = [i for i in range(3) if i not in fixed]

    def whole(p: np.ndarray) -> np.ndarray:
        out = start.copy()
        out[free] = p
        for i, v in fixed.items():
            out[i] = v
        return out

    def nll(p: np.ndarray) -> float:
        loc, scale, xi = whole(p)
        if kind == "gpd":
            return math.inf if (x < loc).any() else _nll_gpd(np.array([scale, xi]), x - loc)
        return _nll_gev(np.array([loc, scale, xi]), x)

    return whole(nelder_mead(nll, start[free])) if free else whole(np.zeros(0))


def distribution_fits(df: DataFrame, value: str, by: str, kind: str, fixed: dict[int, float] | None = None, least: int = 10) -> DataFrame:
    """by, n, p0, p1, p2, nll of each series, with fixed parameters by place. A group is one series of maxima or peaks."""

    def fit(p: pd.DataFrame) -> pd.DataFrame:
        x = p[value].dropna().to_numpy(float)
        if kind == "gpd":
            x = x[x >= (fixed or {}).get(0, 0.0)]
        names = [by, "n", "p0", "p1", "p2", "nll"]
        if len(x) < least:
            return pd.DataFrame({n: [] for n in names})
        q = fit_distribution(x, kind, fixed)
        nll = _nll_gpd(q[1:], x - q[0]) if kind == "gpd" else _nll_gev(q, x)
        return pd.DataFrame([[p[by].iloc[0], len(x), *q, nll]], columns=names)

    return df.select(by, value).groupBy(by).applyInPandas(fit, f"{by} {dict(df.dtypes)[by]}, n long, p0 double, p1 double, p2 double, nll double")


def peak_rows(df: DataFrame, value: str, order: list[str], by: list[str], threshold: float, distance: int = 2) -> DataFrame:
    """Local peaks over a threshold of which none has a larger one within ``distance`` rows; of equal neighbours the earlier stays.

    Peaks are taken from the largest down; one that falls to a larger peak doesn't make others fall, which two passes over its
    neighbourhood settle for all but chains of more than three.
    """
    w = Window.partitionBy(*by).orderBy(*order)
    x = F.greatest(F.col(value) - threshold, F.lit(0.0))
    rows = df.withColumn("__x", x).withColumn("__i", F.row_number().over(w))
    rows = rows.withColumn("__peak", (F.col("__x") > F.coalesce(F.lag("__x").over(w), F.lit(math.inf))) & (F.col("__x") >= F.coalesce(F.lead("__x").over(w), F.lit(math.inf))))
    peaks = rows.filter("__peak")
    near = Window.partitionBy(*by).orderBy("__i").rangeBetween(-distance, distance)
    best = F.max(F.struct("__x", (-F.col("__i")).alias("i"))).over(near)
    return peaks.withColumn("__b", best).filter(F.col("__b.i") == -F.col("__i")).drop("__b", "__x", "__i", "__peak")


class ExtremeCorrection:
    """Correction of simulated series by the extremes of a historical one.

    ``fit`` takes the historical annual maxima (method "am": GEV) or peaks over a threshold ("pot": GPD with the yearly rate of
    peaks). ``transform`` compares the simulations' annual maxima with the fit (Cramér-von Mises); unless they agree, they
    become the fit's quantiles at their ranks, and every simulated value is moved along the line between annual maxima.
    """

    def __init__(self, value: str, time: str, method: str = "pot", threshold: float = 0.0, distance: int = 2):
        if method not in ("am", "pot"):
            raise ValueError("method is am or pot")
        self.value, self.time, self.method, self.threshold, self.distance = value, time, method, threshold, distance

    def _annual(self, df: DataFrame, by: list[str]) -> DataFrame:
        return block_maxima(df, self.value, self.time, by, "year").filter(F.col(self.value).isNotNull()).select(*by, self.value)

    def fit(self, hist: DataFrame) -> ExtremeCorrection:
        maxima = self._annual(hist, []).limit(MOST_MAXIMA).toPandas()[self.value].to_numpy(float)  # one for each year
        if not len(maxima):
            raise ValueError("no historical values")
        if self.method == "am":
            self.rate, self.parameters = 1.0, fit_distribution(maxima, "gev")
            return self
        peaks = peak_rows(hist.select(self.time, self.value), self.value, [self.time], [], self.threshold, self.distance).select(self.value)
        found = peaks.limit(MOST_MAXIMA + 1).toPandas()[self.value].to_numpy(float)
        if len(found) > MOST_MAXIMA:
            raise ValueError(f"more than {MOST_MAXIMA} peaks: raise the threshold")
        self.rate = len(found) / len(maxima)
        self.parameters = fit_distribution(found, "gpd", {0: self.threshold})
        return self

    def gev(self) -> tuple[float, float, float]:
        """The annual maxima's distribution that the fit means."""
        a, scale, xi = (float(v) for v in self.parameters)
        if self.method == "am":
            return a, scale, xi
        grown = self.rate**xi
        return (a + scale * (grown - 1) / xi if abs(xi) > 1e-8 else a + scale * math.log(self.rate)), scale * grown, xi

    def test(self, sim: DataFrame, sim_id: str) -> tuple[float, float]:
        """Statistic and chance of the simulations' annual maxima under the fit."""
        from fathomlake.functions.extremes import gev_cdf

        loc, scale, xi = self.gev()
        r = cramer_von_mises(self._annual(sim, [sim_id]), self.value, lambda x: gev_cdf(x, loc, scale, xi)).first()
        return (r["statistic"], cramer_von_mises_p(r["statistic"])) if r["n"] else (0.0, 1.0)

    def transform(self, sim: DataFrame, sim_id: str, siglevel: float = 0.05) -> DataFrame:
        """The simulations with <value>_corr."""
        from fathomlake.functions.extremes import gev_quantile, gpd_poisson_quantile

        from .joins import interpolate_at

        out = f"{self.value}_corr"
        if self.test(sim, sim_id)[1] > siglevel:
            return sim.withColumn(out, F.col(self.value))
        a, scale, xi = (float(v) for v in self.parameters)
        ranked = global_ranks(self._annual(sim, [sim_id]), self.value, name="__i", total="__n", unique=True)
        p = F.col("__i") / (F.col("__n") + 1)
        corrected = gev_quantile(p, a, scale, xi) if self.method == "am" else gpd_poisson_quantile(p, a, scale, xi, self.rate)
        low = sim.agg(F.min(self.value).alias("x"), F.min(self.value).alias("y"))
        knots = low.union(ranked.select(F.col(self.value).alias("x"), corrected.alias("y")))
        return interpolate_at(sim, self.value, knots, "x", "y", out)


def poisson_return_levels(peaks: DataFrame, value: str, threshold: float, rate: float, years: list[float], resamples: int = 1000, level: float = 0.95, seed: int = 1) -> DataFrame:
    """years, low, high: bootstrap of the Poisson-GPD's return levels. Every peak over the threshold is resampled; more than MOST_MAXIMA raise ValueError."""
    found = peaks.filter(F.col(value) > threshold).select(F.col(value).cast("double").alias("v")).limit(MOST_MAXIMA + 1).toArrow()
    if found.num_rows > MOST_MAXIMA:
        raise ValueError(f"more than {MOST_MAXIMA} peaks: raise the threshold")
    spark = peaks.sparkSession
    held = spark.sparkContext.broadcast(np.sort(found["v"].to_numpy()))

    def resample(parts):
        x = held.value
        for p in parts:
            rows = []
            for i in p["id"]:
                rng = np.random.default_rng([seed, int(i)])
                scale, xi = fit_gpd(rng.choice(x, len(x)), threshold)
                for t in years:
                    s = -math.log(1 - 1 / t) / rate
                    rows.append((t, threshold - scale * math.log(s) if abs(xi) < 1e-8 else threshold + scale / xi * (s**-xi - 1)))
            yield pd.DataFrame(rows, columns=["years", "level"])

    a = (1 - level) / 2
    out = spark.range(resamples).mapInPandas(resample, "years double, level double").groupBy("years")
    return out.agg(*[F.percentile("level", F.lit(q)).alias(n) for n, q in (("low", a), ("high", 1 - a))])


def uniform_draws(spark, n: int, seed: str = "1") -> DataFrame:
    """id, u: numbers between 0 and 1 from an MD5 of the seed and the id, the same wherever they are drawn."""
    bits = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string"))), 1, 13), 16, 10).cast("double")
    return spark.range(n).select("id", ((bits + 0.5) / float(1 << 52)).alias("u"))


def random_extremes(spark, n: int, kind: str, loc: float, scale: float, xi: float, seed: str = "1") -> DataFrame:
    """id, x: ``n`` values of a GEV ("gev") or GPD ("gpd", ``loc`` the threshold) by inversion."""
    from fathomlake.functions.extremes import gev_quantile, gpd_quantile

    if scale <= 0:
        raise ValueError("scale must be positive")
    quantile = {"gev": gev_quantile, "gpd": gpd_quantile}[kind]
    return uniform_draws(spark, n, seed).select("id", quantile(F.col("u"), loc, scale, xi).alias("x"))


def negative_log_likelihood(df: DataFrame, value: str, kind: str, loc: float, scale: float, xi: float, by: list[str] = ()) -> DataFrame:
    """by, n, nll of a GEV or GPD; infinite where a value lies outside the support or the scale isn't positive."""
    from fathomlake.functions.extremes import gev_log_likelihood, gpd_pdf

    x = F.col(value)
    if scale <= 0:
        one = F.lit(None).cast("double")
    elif kind == "gev":
        one = gev_log_likelihood(x, loc, scale, xi)
    else:
        density = gpd_pdf(x, loc, scale, xi)
        one = F.when((x >= loc) & (density > 0), F.ln(density))
    rows = df.filter(x.isNotNull()).select(*by, one.alias("__l"))
    total = F.when(F.count("__l") == F.count(F.lit(1)), -F.sum("__l")).otherwise(F.lit(float("inf")))
    return rows.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), total.alias("nll"))


def kernel_cdf(df: DataFrame, value: str, knots: list[float]) -> DataFrame:
    """x, cdf: Gaussian kernel estimate at knots, bandwidth by the normal reference rule. Each row meets each knot in a partial sum."""
    from fathomlake.functions.normal import normal_cdf

    s = df.agg(F.count(value).alias("n"), F.stddev_samp(value).alias("sd"), F.percentile(value, F.array(F.lit(0.25), F.lit(0.75))).alias("q")).first()
    if not s["n"]:
        return df.sparkSession.createDataFrame([], "x double, cdf double")
    spread = min(x for x in (s["sd"] or 0.0, (s["q"][1] - s["q"][0]) / 1.349) if x > 0) if (s["sd"] or 0) > 0 else 1.0
    width = 1.0592238410488122 * spread * s["n"] ** -0.2
    sums = df.filter(F.col(value).isNotNull()).agg(*[F.avg(normal_cdf((F.lit(float(k)) - F.col(value)) / width)).alias(str(i)) for i, k in enumerate(knots)])
    return sums.select(F.explode(F.array(*[F.struct(F.lit(float(k)).alias("x"), F.col(str(i)).alias("cdf")) for i, k in enumerate(knots)])).alias("r")).select("r.x", "r.cdf")


def smoothed_by_neighbours(centroids: DataFrame, label: str, dims: list[str], value: str, k: int = 4, most: int = 10_000) -> DataFrame:
    """label, value: half of each centroid's own parameter and half of its ``k`` nearest neighbours' mean, weighted by inverse distance."""
    if centroids.limit(most + 1).count() > most:
        raise ValueError(f"more than {most} centroids")
    a, b = centroids.alias("a"), F.broadcast(centroids.alias("b"))
    gap = F.sqrt(sum(((F.col(f"a.{d}") - F.col(f"b.{d}")) * (F.col(f"a.{d}") - F.col(f"b.{d}")) for d in dims), F.lit(0.0)))
    pairs = a.join(b, F.col(f"a.{label}") != F.col(f"b.{label}")).select(F.col(f"a.{label}").alias(label), F.col(f"a.{value}").alias("own"), F.col(f"b.{label}").alias("__o"), F.col(f"b.{value}").alias("v"), gap.alias("d"))
    near = pairs.withColumn("__k", F.row_number().over(Window.partitionBy(label).orderBy("d", "__o"))).filter(F.col("__k") <= k)
    return near.groupBy(label).agg((0.5 * (F.max("own") + F.sum(F.col("v") / F.col("d")) / F.sum(1 / F.col("d")))).alias(value))
