"""Selection, clustering, reduction, interpolation and simulation."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fathomlake.functions.normal import normal_quantile

from .frames import denormalize, global_ranks, normalize, ranges
from .joins import nearest


def max_dissimilarity(df: DataFrame, rid: str, dims: list[str], k: int, circular: list[str] = ()) -> DataFrame:
    """rid, pick: k rows chosen greedily, each the farthest from those chosen; the first has the largest sum (least id on ties).

    Every pick is one pass that lowers a kept column, the least distance to the picks so far, and finds the next pick; the column is
    persisted (spilling to disk) for the time of a few picks, so the work of a pass doesn't grow with the picks.
    """
    from pyspark import StorageLevel

    now = df.select(rid, *[F.col(d).cast("double").alias(d) for d in dims], F.lit(float("inf")).alias("__near"))
    best = now.agg(F.max(F.struct(sum((F.col(d) for d in dims[1:]), F.col(dims[0])).alias("s"), (-F.col(rid)).alias("i"), *dims)).alias("b")).first()["b"]
    if best is None:
        return df.select(rid, F.lit(0).alias("pick")).limit(0)
    picks, held = [best], None
    while len(picks) < k:
        gap = F.lit(0.0)
        for d in dims:
            g = F.abs(F.col(d) - float(best[d]))
            g = F.least(g, 1 - g) if d in circular else g
            gap = gap + g * g
        now = now.withColumn("__near", F.least("__near", gap))
        if len(picks) % 16 == 0:  # sixteen passes are folded into the column
            now = now.persist(StorageLevel.MEMORY_AND_DISK)
            now.count()
            if held is not None:
                held.unpersist()
            held = now
        best = now.agg(F.max(F.struct(F.col("__near").alias("s"), (-F.col(rid)).alias("i"), *dims)).alias("b")).first()["b"]
        if best["s"] <= 0:
            break
        picks.append(best)
    if held is not None:
        held.unpersist()
    return df.sparkSession.createDataFrame([(-p["i"], n) for n, p in enumerate(picks)], f"{rid} bigint, pick int")


def group_centroids(df: DataFrame, label: str, dims: list[str]) -> DataFrame:
    return df.groupBy(label).agg(*[F.avg(d).alias(d) for d in dims])


def predict_nearest(df: DataFrame, rid: str, centroids: DataFrame, label: str, dims: list[str], circular: list[str] = ()) -> DataFrame:
    """rid, label, distance of each row's nearest centroid."""
    return nearest(df, centroids, rid, label, dims, circular)


def k_means(df: DataFrame, rid: str, dims: list[str], k: int, seed: int = 1, restarts: int = 1) -> DataFrame:
    """rid, label (from 0): the best of some seeded k-means runs."""
    rows = VectorAssembler(inputCols=dims, outputCol="__v").transform(df.select(rid, *dims))
    models = [KMeans(k=k, seed=seed + i, featuresCol="__v", predictionCol="label").fit(rows) for i in range(restarts)]
    best = min(models, key=lambda m: m.summary.trainingCost)
    return best.transform(rows).select(rid, "label")


def directional_clusters(df: DataFrame, rid: str, dims: list[str], directional: list[str], k: int, scale: dict[str, tuple[float, float]] | None = None, seed: int = 1) -> tuple[DataFrame, DataFrame]:
    """(rid and label; label and the centroid in the columns' own units) of k-means with directions taken as sine and cosine.

    Columns are scaled to 0..1 by their ranges or by ``scale``; sines and cosines by -1..1. A direction's centroid comes from the means of both.
    """
    flat = [d for d in dims if d not in directional]
    parts = [(F.sin if t == "u" else F.cos)(F.radians(d)).alias(f"{d}_{t}") for d in directional for t in "uv"]
    names = flat + [f"{d}_{t}" for d in directional for t in "uv"]
    rows = df.select(rid, *[F.col(d).cast("double").alias(d) for d in flat], *parts)
    limits = {n: (-1.0, 1.0) for n in names if n not in flat} | (scale or {})
    open_ = [d for d in flat if d not in limits]
    if open_:
        r = ranges(rows, open_).first()
        limits |= {d: (r[f"{d}_min"], r[f"{d}_max"]) for d in open_}
    scaled = normalize(rows, names, limits)
    labels = k_means(scaled, rid, names, k, seed)
    centres = denormalize(group_centroids(scaled.join(labels.select(rid, "label"), rid), "label", names), limits)
    turned = [F.pmod(F.degrees(F.atan2(F.col(f"{d}_u"), F.col(f"{d}_v"))), F.lit(360.0)).alias(d) for d in directional]
    return labels, centres.select("label", *flat, *turned)


def batch_som(df: DataFrame, rid: str, dims: list[str], width: int, height: int, rounds: int = 5, seed: int = 1) -> DataFrame:
    """rid, neuron: self-organising map trained in batches. Each round sums rows by winning neuron in one aggregation, and the
    neighbourhood mixes those few sums on the driver."""
    n = width * height
    lows = df.agg(*[F.min(d).alias(f"{d}_a") for d in dims], *[F.max(d).alias(f"{d}_b") for d in dims]).first()
    rng = np.random.default_rng(seed)
    weights = np.array([[lows[f"{d}_a"] + rng.random() * (lows[f"{d}_b"] - lows[f"{d}_a"]) for d in dims] for _ in range(n)])
    at = np.array([(i % width, i // width) for i in range(n)], float)
    grid = ((at[:, None] - at[None]) ** 2).sum(-1)

    def winner(w: np.ndarray) -> Column:
        costs = [F.struct(sum(((F.col(d) - float(w[i, j])) * (F.col(d) - float(w[i, j])) for j, d in enumerate(dims)), F.lit(0.0)).alias("c"), F.lit(i).alias("i")) for i in range(n)]
        return F.array_min(F.array(*costs))["i"]

    for r in range(rounds):
        sums = df.select(winner(weights).alias("w"), *dims).groupBy("w").agg(F.count(F.lit(1)).alias("n"), *[F.sum(d).alias(d) for d in dims]).collect()
        count, total = np.zeros(n), np.zeros((n, len(dims)))
        for s in sums:
            count[s["w"]], total[s["w"]] = s["n"], [s[d] for d in dims]
        h = np.exp(-grid / (2 * max(0.5, max(width, height) / 2 * (1 - r / rounds)) ** 2))
        weights = (h @ total) / np.maximum(h @ count, 1e-12)[:, None]
    return df.select(rid, winner(weights).alias("neuron"))


def principal_components(df: DataFrame, rid: str, dims: list[str], k: int) -> tuple[DataFrame, np.ndarray, np.ndarray]:
    """Scores (rid, pc1..), loadings and explained shares of standardised columns.

    The correlation matrix comes from one aggregation of sums, d x d numbers; its eigenvectors (largest loading positive) go
    back as literals, so scores are one projection.
    """
    sums = [F.avg(d).alias(f"m{i}") for i, d in enumerate(dims)] + [F.stddev_pop(d).alias(f"s{i}") for i, d in enumerate(dims)]
    cross = [F.corr(a, b).alias(f"c{i}_{j}") for i, a in enumerate(dims) for j, b in enumerate(dims) if i < j]
    r = df.agg(*sums, *cross).first()
    c = np.array([[1.0 if i == j else r[f"c{min(i, j)}_{max(i, j)}"] for j in range(len(dims))] for i in range(len(dims))], float)
    c[np.isnan(c)] = 0.0
    values, vectors = np.linalg.eigh(c)
    order = np.argsort(-values)[:k]
    load = vectors[:, order]
    load = load * np.sign(load[np.abs(load).argmax(0), np.arange(len(order))])
    score = [sum((F.try_divide(F.col(d) - F.lit(r[f"m{i}"]), F.lit(r[f"s{i}"])) * float(load[i, q]) for i, d in enumerate(dims)), F.lit(0.0)).alias(f"pc{q + 1}") for q in range(len(order))]
    return df.select(rid, *score), load, values[order] / values.sum()


def reconstruct(scores: DataFrame, rid: str, load: np.ndarray, moments: list[tuple[float, float]], dims: list[str]) -> DataFrame:
    """Columns back from scores."""
    cols = [(sum((F.col(f"pc{q + 1}") * float(load[i, q]) for q in range(load.shape[1])), F.lit(0.0)) * moments[i][1] + moments[i][0]).alias(d) for i, d in enumerate(dims)]
    return scores.select(rid, *cols)


def rbf_weights(nodes: np.ndarray, values: np.ndarray, sigma: float) -> np.ndarray:
    """Gaussian weights, then constant and linear terms, of the interpolant through the nodes."""
    n, d = nodes.shape
    r2 = ((nodes[:, None] - nodes[None]) ** 2).sum(-1)
    p = np.hstack([np.ones((n, 1)), nodes])
    a = np.block([[np.exp(-r2 / (2 * sigma**2)), p], [p.T, np.zeros((d + 1, d + 1))]])
    return np.linalg.lstsq(a, np.concatenate([values, np.zeros(d + 1)]), rcond=None)[0]


def best_sigma(nodes: np.ndarray, values: np.ndarray, low: float = 1e-3, high: float = 2.0, steps: int = 40) -> float:
    """Golden-section search on the leave-one-out error by Rippa's formula."""
    r2 = ((nodes[:, None] - nodes[None]) ** 2).sum(-1)

    def cost(s: float) -> float:
        inv = np.linalg.pinv(np.exp(-r2 / (2 * s * s)) + 1e-10 * np.eye(len(nodes)))
        return float(np.linalg.norm(inv @ values / np.diag(inv)))

    g = (math.sqrt(5) - 1) / 2
    a, b = low, high
    c, d = b - g * (b - a), a + g * (b - a)
    for _ in range(steps):
        if cost(c) < cost(d):
            b = d
        else:
            a = c
        c, d = b - g * (b - a), a + g * (b - a)
    return (a + b) / 2


def rbf_predict(df: DataFrame, rid: str, dims: list[str], nodes: np.ndarray, weights: dict[str, np.ndarray], sigma: dict[str, float]) -> DataFrame:
    """rid and a column for each target: batches meet the few nodes in numpy."""
    names = list(weights)

    def run(parts):
        for p in parts:
            x = p[dims].to_numpy(float)
            r2 = ((x[:, None] - nodes[None]) ** 2).sum(-1)
            out = {rid: p[rid]}
            for t in names:
                w, n = weights[t], len(nodes)
                out[t] = np.exp(-r2 / (2 * sigma[t] ** 2)) @ w[:n] + w[n] + x @ w[n + 1 :]
            yield pd.DataFrame(out)

    return df.select(rid, *dims).mapInPandas(run, f"{rid} {dict(df.dtypes)[rid]}, " + ", ".join(f"{t} double" for t in names))


def latin_hypercube(spark: SparkSession, dims: dict[str, tuple[float, float]], n: int, seed: int = 0) -> DataFrame:
    """sample and a column for each dimension: one value in each of n equal slices, in a random order for each dimension."""
    out = spark.range(n).withColumnRenamed("id", "sample")
    for j, (name, (lo, hi)) in enumerate(dims.items()):
        u = spark.range(n).select("id", F.rand(seed + 2 * j).alias("o"), F.rand(seed + 2 * j + 1).alias("u"))
        col = u.select((F.row_number().over(Window.orderBy("o")) - 1).alias("sample"), (lo + (hi - lo) * (F.col("id") + F.col("u")) / n).alias(name))
        out = out.join(col, "sample")
    return out


def gaussian_copula(df: DataFrame, cols: list[str], n: int, seed: int = 1) -> DataFrame:
    """Simulated rows with the columns' ranks' correlation and their own quantiles."""
    from statistics import NormalDist

    ranked = df.select(*cols).dropna()
    for c in cols:
        ranked = global_ranks(ranked, c, name=f"__{c}", total=f"__n_{c}", unique=True)
    ranked = ranked.select(*[((F.col(f"__{c}") - 0.5) / F.col(f"__n_{c}")).alias(c) for c in cols])
    probit = ranked.select(*[normal_quantile(F.col(c)).alias(c) for c in cols])
    r = probit.agg(*[F.corr(a, b).alias(f"{i}_{j}") for i, a in enumerate(cols) for j, b in enumerate(cols) if i < j]).first()
    c = np.array([[1.0 if i == j else r[f"{min(i, j)}_{max(i, j)}"] for j in range(len(cols))] for i in range(len(cols))])
    root = np.linalg.cholesky(c + 1e-9 * np.eye(len(cols)))
    probs = [i / 100 for i in range(101)]
    knots = {x: df.agg(F.percentile(x, F.array(*[F.lit(p) for p in probs])).alias("q")).first()["q"] for x in cols}
    cdf = np.vectorize(NormalDist().cdf)

    def draw(parts):
        for p in parts:
            z = np.stack([np.random.default_rng([seed, int(i)]).standard_normal(len(cols)) for i in p["id"]]) @ root.T if len(p) else np.zeros((0, len(cols)))
            u = cdf(z) if len(z) else z
            yield pd.DataFrame({"sim": p["id"], **{x: np.interp(u[:, j], probs, knots[x]) for j, x in enumerate(cols)}})

    return df.sparkSession.range(n).mapInPandas(draw, "sim long, " + ", ".join(f"{x} double" for x in cols))


def simulate_chain(transition: DataFrame, sims: int, steps: int, start: str, seed: int = 1) -> DataFrame:
    """sim, step, state: Markov chains by inverse CDF over (prev, cur, probability); one task for some of the chains."""
    table: dict[str, tuple[list, np.ndarray]] = {}
    for r in transition.select("prev", "cur", "probability").orderBy("prev", "cur").collect():
        table.setdefault(r["prev"], ([], []))[0].append(r["cur"])
        table[r["prev"]][1].append(r["probability"])
    table = {k: (v, np.cumsum(p)) for k, (v, p) in table.items()}

    def run(parts):
        for p in parts:
            rows = []
            for i in p["id"]:
                rng, state = np.random.default_rng([seed, int(i)]), start
                for t in range(steps):
                    rows.append((i, t, state))
                    names, cum = table[state]
                    state = names[min(int(np.searchsorted(cum, rng.random(), "right")), len(names) - 1)]
            yield pd.DataFrame(rows, columns=["sim", "step", "state"])

    return transition.sparkSession.range(sims).mapInPandas(run, "sim long, step int, state string")


#: Most fixes of a track that are broadcast to a grid; the number is checked.
MOST_FIXES = 100_000


def vortex_field(track: DataFrame, grid: DataFrame) -> DataFrame:
    """step, lat, lon, wind (m/s), direction (degrees), pressure (Pa): a moving Holland vortex at each fix over a regular grid.

    ``track``: step, lon, lat, vfx, vfy (kt, translation), p0, pn (hPa), vmax (kt), rmw (nmile); ``grid``: lat, lon. A cell at the
    eye has no wind, and a fix with a null has none at all (0). Directions follow the pressure's gradient along the grid's rows and
    columns, as a gradient with unit steps. The wind blows the other way round if any fix lies in the south.
    """
    from fathomlake.functions.geo import arc_distance

    if track.limit(MOST_FIXES + 1).count() > MOST_FIXES:
        raise ValueError(f"more than {MOST_FIXES} fixes: take one storm at a time")
    names = ["lon", "lat", "vfx", "vfy", "p0", "pn", "vmax", "rmw"]
    south = bool(track.agg(F.max(F.col("lat") < 0)).first()[0])
    j = grid.select("lat", F.when(F.col("lon") < 0, F.col("lon") + 360).otherwise(F.col("lon")).alias("lon"))
    j = j.crossJoin(F.broadcast(track.select("step", *[F.col(c).cast("double").alias(f"t_{c}") for c in names])))
    c = {n: F.col(f"t_{n}") for n in names}
    known = F.lit(True)
    for x in c.values():
        known = known & x.isNotNull() & ~F.isnan(x)
    r = F.radians(arc_distance(F.col("lat"), F.col("lon"), c["lat"], c["lon"])) * 6378135.0
    theta = F.atan2(F.radians(F.col("lat") - c["lat"]), F.radians((c["lon"] - F.col("lon")) if south else (F.col("lon") - c["lon"])))
    drop = F.greatest((c["pn"] - c["p0"]) * 100, F.lit(100.0))
    spin = 2 * (2 * math.pi / 86184.2) * F.sin(F.radians(F.abs(c["lat"])))
    beta, to_ten_minutes = 0.9, 0.93
    gradient_kt = (c["vmax"] - F.hypot(c["vfx"], c["vfy"])) / beta
    vm = gradient_kt * 0.52
    b = F.least(F.greatest(1.15 * math.e * vm * vm / drop, F.lit(1.0)), F.lit(2.5))
    j = j.select("*", r.alias("r"), theta.alias("theta"), spin.alias("spin"), gradient_kt.alias("kt"), vm.alias("vm"), F.when(r > 0, F.pow(c["rmw"] * 1852 / r, b)).alias("q"), known.alias("known"))
    vg = F.sqrt(F.col("q") * F.exp(1 - F.col("q")) * F.col("vm") * F.col("vm") + F.col("r") * F.col("r") * F.col("spin") * F.col("spin") / 4) - F.col("r") * F.col("spin") / 2
    j = j.withColumn("vg", F.when(F.col("known"), F.coalesce(vg, F.lit(0.0)))).withColumn("pr", F.when(F.col("known"), c["p0"] + (c["pn"] - c["p0"]) * F.coalesce(F.exp(-F.col("q")), F.lit(0.0))))
    move = F.abs(F.col("vg")) / F.col("kt")
    east = (1 if south else -1) * F.col("vg") * beta * F.sin("theta") * to_ten_minutes + move * c["vfx"]
    north = F.col("vg") * beta * F.cos("theta") * to_ten_minutes + move * c["vfy"]

    def slope(across: str, along: str):
        w = Window.partitionBy("step", across).orderBy(along)
        back, on = F.lag("pr").over(w), F.lead("pr").over(w)
        return F.when(back.isNull(), on - F.col("pr")).when(on.isNull(), F.col("pr") - back).otherwise((on - back) / 2)

    j = j.withColumn("py", slope("lon", "lat")).withColumn("px", slope("lat", "lon"))
    angle = F.degrees(F.atan2("py", "px") + F.signum(c["lat"]) * math.pi / 2)
    back = F.when(F.col("lon") > 180, F.col("lon") - 360).otherwise(F.col("lon"))
    return j.select(
        "step", "lat", back.alias("lon"), F.coalesce(F.hypot(east, north), F.lit(0.0)).alias("wind"),
        F.coalesce(F.when(F.col("known"), F.pmod(270 - angle, F.lit(360.0))), F.lit(0.0)).alias("direction"), F.coalesce(F.col("pr") * 100, F.lit(0.0)).alias("pressure"),
    )


def welch_heights(df: DataFrame, series: str, order: str, value: str, dt: float, segment: int = 512) -> DataFrame:
    """series, hs, hs_low: significant height of the whole spectrum and below 0.05 Hz, by averaged periodograms.

    Segments overlap by half; each is one small group, so a long series is spread over tasks. A shorter series is one segment.
    """
    kind = dict(df.dtypes)[series]
    rows = global_ranks(df.select(series, F.col(order).alias("__o"), F.col(value).cast("double").alias("__v")), "__o", [series], name="__i", total="__n", unique=True)
    rows = rows.withColumn("__size", F.least(F.lit(segment), F.col("__n")).cast("int")).withColumn("__half", F.greatest(F.lit(1), F.floor(F.col("__size") / 2)).cast("int"))
    # segments start at multiples of the half; a row lies in those that start at most a size before it
    at = F.col("__i") - 1
    first = F.greatest(F.lit(0), F.ceil((at - F.col("__size") + 1) / F.col("__half")))
    last = F.least(F.floor(at / F.col("__half")), F.floor((F.col("__n") - F.col("__size")) / F.col("__half")))
    cut = rows.withColumn("__k", F.explode(F.when(last >= first, F.sequence(first.cast("int"), last.cast("int"))).otherwise(F.array().cast("array<int>"))))

    def power(p: pd.DataFrame) -> pd.DataFrame:
        x = p.sort_values("__i")["__v"].to_numpy(float)
        win = np.hanning(len(x))
        psd = 2 * np.abs(np.fft.rfft((x - x.mean()) * win)) ** 2 * dt / max((win**2).sum(), 1e-300)
        f = np.fft.rfftfreq(len(x), dt)
        step = f[1] - f[0] if len(f) > 1 else 0
        return pd.DataFrame({series: [p[series].iloc[0]], "m": [psd.sum() * step], "low": [psd[f < 0.05].sum() * step]})

    parts = cut.select(series, "__k", "__i", "__v").groupBy(series, "__k").applyInPandas(power, f"{series} {kind}, m double, low double")
    return parts.groupBy(series).agg((4 * F.sqrt(F.avg("m"))).alias("hs"), (4 * F.sqrt(F.avg("low"))).alias("hs_low"))


#: Most points of a radial model: their distances are a table of its square.
MOST_NODES = 4000


class RadialModel:
    """Radial interpolation of targets known at a bounded set of points; directions enter, and come out, as sine and cosine."""

    def __init__(self, dims: list[str], targets: list[str], directional: list[str] = (), directional_targets: list[str] = ()):
        self.dims, self.targets, self.directional, self.directional_targets = list(dims), list(targets), list(directional), list(directional_targets)
        self.flat = [d for d in self.dims if d not in self.directional]
        self.names = self.flat + [f"{d}_{t}" for d in self.directional for t in "uv"]
        self.outs = [t for t in self.targets if t not in self.directional_targets] + [f"{d}_{t}" for d in self.directional_targets for t in "uv"]

    def _inputs(self, df: DataFrame, *keep: str) -> DataFrame:
        parts = [(F.sin if t == "u" else F.cos)(F.radians(d)).alias(f"{d}_{t}") for d in self.directional for t in "uv"]
        return df.select(*keep, *[F.col(d).cast("double").alias(d) for d in self.flat], *parts)

    def fit(self, subset: DataFrame) -> RadialModel:
        """``subset`` has the dimensions and the targets; rows with a null are left out, and more than MOST_NODES raise ValueError."""
        turned = [(F.sin if t == "u" else F.cos)(F.radians(d)).alias(f"__{d}_{t}") for d in self.directional_targets for t in "uv"]
        plain = [F.col(t).cast("double").alias(f"__{t}") for t in self.targets if t not in self.directional_targets]
        rows = self._inputs(subset.select("*", *plain, *turned), *[f"__{o}" for o in self.outs]).dropna().limit(MOST_NODES + 1).toPandas()
        if len(rows) > MOST_NODES:
            raise ValueError(f"more than {MOST_NODES} points: choose some by maximum dissimilarity")
        if len(rows) < 2:
            raise ValueError("a radial model needs points")
        limits = {n: (-1.0, 1.0) if n not in self.flat else (float(rows[n].min()), float(rows[n].max())) for n in self.names}
        self.limits = {n: (a, b if b > a else a + 1.0) for n, (a, b) in limits.items()}
        self.nodes = np.stack([(rows[n].to_numpy() - a) / (b - a) for n, (a, b) in self.limits.items()], 1)
        self.sigma, self.weights = {}, {}
        for o in self.outs:
            y = rows[f"__{o}"].to_numpy(float)
            self.sigma[o] = best_sigma(self.nodes, y)
            self.weights[o] = rbf_weights(self.nodes, y, self.sigma[o])
        return self

    def predict(self, df: DataFrame, rid: str) -> DataFrame:
        """rid and the targets at each row."""
        scaled = normalize(self._inputs(df, rid), self.names, self.limits)
        found = rbf_predict(scaled, rid, self.names, self.nodes, self.weights, self.sigma)
        turned = [F.pmod(F.degrees(F.atan2(F.col(f"{d}_u"), F.col(f"{d}_v"))), F.lit(360.0)).alias(d) for d in self.directional_targets]
        return found.select(rid, *[t for t in self.outs if t in self.targets], *turned)

    def k_fold(self, df: DataFrame, rid: str, folds: int = 5) -> DataFrame:
        """fold, target, n, rmse, bias: each fold (by a hash of rid) predicted from the others."""
        rows = df.withColumn("__fold", F.pmod(F.xxhash64(rid), F.lit(folds)))
        out = None
        for k in range(folds):
            model = RadialModel(self.dims, self.targets, self.directional, self.directional_targets).fit(rows.filter(F.col("__fold") != k))
            held = rows.filter(F.col("__fold") == k)
            met = model.predict(held, rid).select(rid, *[F.col(t).alias(f"__p_{t}") for t in self.targets]).join(held, rid)
            for t in self.targets:
                gap = F.col(f"__p_{t}") - F.col(t)
                gap = F.pmod(gap + 180, F.lit(360.0)) - 180 if t in self.directional_targets else gap
                one = met.agg(F.lit(k).alias("fold"), F.lit(t).alias("target"), F.count(gap).alias("n"), F.sqrt(F.avg(gap * gap)).alias("rmse"), F.avg(gap).alias("bias"))
                out = one if out is None else out.union(one)
        return out
