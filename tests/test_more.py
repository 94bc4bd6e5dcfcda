"""Operators of fields, tracks, draws and joins against fixed values and brute force."""

import math
import random

import numpy as np
import pytest
from fathomlake.functions import geo, normal, waves
from fathomlake.operators import extremes as ex
from fathomlake.operators import joins as jn
from fathomlake.operators import models as md
from fathomlake.operators import series as se
from fathomlake.operators import storms as st
from pyspark.sql import functions as F

#: Fixed values that the vortex must give: wind (m/s), direction (degrees) and pressure (Pa) by latitude, longitude and step.
WIND = [
    [[17.09417413, 0.82665737], [22.66057334, 1.14495022], [19.54808437, 1.54414607]],
    [[15.94360075, 1.1403561], [0.0, 1.68962993], [20.625051, 2.44988633]],
    [[10.76028132, 1.52098785], [12.98617365, 2.42132863], [14.33530855, 3.80841364]],
]
DIRECTION = [
    [[129.496987, 129.942357], [90.1036600, 119.620263], [50.8422102, 111.400370]],
    [[179.763735, 141.716653], [134.656325, 130.581118], [0.239753156, 119.617666]],
    [[230.162978, 152.609284], [269.894691, 143.594058], [309.495882, 132.127127]],
]
PRESSURE = [
    [[98722.50246466, 97023.7119469], [99257.26417213, 97029.78898728], [98725.18999552, 97036.80829455]],
    [[99371.28980686, 97030.96909655], [100000.0, 97041.30637199], [99378.55955678, 97054.71911504]],
    [[98727.68758907, 97040.02996857], [99264.62166108, 97057.51709726], [98730.39083852, 97083.99580787]],
]


def test_vortex_fixed_values(spark):
    track = spark.createDataFrame(
        [(0, 10.001, 20.001, 10.0, 5.0, 1000.0, 980.0, 50.0, 30.0), (1, 12.001, 22.001, 12.0, 6.0, 990.0, 970.0, 55.0, 35.0)],
        "step int, lon double, lat double, vfx double, vfy double, p0 double, pn double, vmax double, rmw double",
    )
    lons, lats = [9.5, 10.0, 10.5], [19.5, 20.0, 20.5]
    grid = spark.createDataFrame([(a, o) for a in lats for o in lons], "lat double, lon double")
    rows = md.vortex_field(track, grid).collect()
    assert len(rows) == 18
    for r in rows:
        i, j = lats.index(r.lat), lons.index(r.lon)
        assert r.wind == pytest.approx(WIND[i][j][r.step], abs=1e-4)
        assert r.direction == pytest.approx(DIRECTION[i][j][r.step], abs=1e-3)
        assert r.pressure == pytest.approx(PRESSURE[i][j][r.step], abs=1e-2)


def test_vortex_without_a_value_is_still(spark):
    track = spark.createDataFrame([(0, 10.0, 20.0, None, 5.0, 960.0, 1010.0, 50.0, 30.0)], "step int, lon double, lat double, vfx double, vfy double, p0 double, pn double, vmax double, rmw double")
    r = md.vortex_field(track, spark.createDataFrame([(19.0, 9.0), (20.0, 9.0)], "lat double, lon double")).first()
    assert (r.wind, r.direction, r.pressure) == (0, 0, 0)


@pytest.mark.parametrize("circular,weights", [((), None), (("c",), None), (("a",), {"b": 3.0})])
def test_nearest_by_cells_is_nearest(spark, monkeypatch, circular, weights):
    rng = np.random.default_rng(4)
    refs, queries = rng.random((400, 3)) ** 3, rng.random((150, 3))
    monkeypatch.setattr(jn, "MOST_REFERENCES", 100)
    cols = "a double, b double, c double"
    r = spark.createDataFrame([(i, *map(float, x)) for i, x in enumerate(refs)], f"rid int, {cols}")
    q = spark.createDataFrame([(i, *map(float, x)) for i, x in enumerate(queries)], f"qid int, {cols}")
    got = {x.qid: (x.rid, x.distance) for x in jn.nearest(q, r, "qid", "rid", ["a", "b", "c"], circular, weights).collect()}
    w = np.array([(weights or {}).get(d, 1.0) for d in "abc"])
    for i, p in enumerate(queries):
        gap = np.abs(refs - p)
        for k, d in enumerate("abc"):
            if d in circular:
                gap[:, k] = np.minimum(gap[:, k], 1 - gap[:, k])
        dist = np.sqrt((gap**2 * w**2).sum(1))
        assert got[i][0] == int(dist.argmin()) and got[i][1] == pytest.approx(dist.min())


def test_normal_functions(spark):
    from statistics import NormalDist

    ps = [1e-6, 0.001, 0.02, 0.3, 0.5, 0.9, 0.98, 0.9999]
    rows = spark.createDataFrame([(p,) for p in ps], "p double").select("p", normal.normal_quantile(F.col("p")).alias("z"), normal.normal_cdf(F.col("p") * 4 - 2).alias("c")).collect()
    for r in rows:
        assert r.z == pytest.approx(NormalDist().inv_cdf(r.p), rel=1e-8, abs=1e-8)
        assert r.c == pytest.approx(NormalDist().cdf(r.p * 4 - 2), abs=1e-7)
    edge = spark.range(1).select(normal.normal_quantile(F.lit(0.0)).alias("a"), normal.normal_quantile(F.lit(1.0)).alias("b")).first()
    assert edge.a is None and edge.b is None


def test_draws_and_likelihoods(spark):
    x = ex.random_extremes(spark, 20_000, "gpd", 0.5, 1.5, 0.2, seed="a")
    r = x.agg(F.avg("x").alias("m"), F.min("x").alias("low")).first()
    assert r.low >= 0.5 and r.m == pytest.approx(0.5 + 1.5 / 0.8, rel=0.05)
    assert x.orderBy("id").limit(5).collect() == ex.random_extremes(spark, 5, "gpd", 0.5, 1.5, 0.2, seed="a").orderBy("id").collect()
    with pytest.raises(ValueError):
        ex.random_extremes(spark, 5, "gev", 0.0, 0.0, 0.1)
    df = spark.createDataFrame([("a", 1.0), ("a", 2.0), ("b", -1.0), ("b", None)], "g string, x double")
    got = {r.g: (r.n, r.nll) for r in ex.negative_log_likelihood(df, "x", "gpd", 0.0, 1.0, 0.0, ["g"]).collect()}
    assert got["a"] == (2, pytest.approx(3.0)) and got["b"] == (1, math.inf)
    assert {r.nll for r in ex.negative_log_likelihood(df, "x", "gev", 0.0, -1.0, 0.0, ["g"]).collect()} == {math.inf}


def test_kernel_cdf(spark):
    rng = random.Random(2)
    xs = [rng.gauss(10, 3) for _ in range(400)]
    got = [r.cdf for r in ex.kernel_cdf(spark.createDataFrame([(x,) for x in xs], "v double"), "v", [0.0, 10.0, 20.0]).orderBy("x").collect()]
    assert got[0] < 0.01 and got[1] == pytest.approx(0.5, abs=0.06) and got[2] > 0.99
    assert ex.kernel_cdf(spark.createDataFrame([], "v double"), "v", [1.0]).collect() == []


def test_segments_by_hand(spark):
    """A storm that goes north by one degree every 6 hours, and turns east at the end."""
    fixes = [(k, float(k), 20.0) for k in range(7)] + [(7, 6.0, 21.0)]
    df = spark.createDataFrame([("s", k, a, o, 1000.0 - k, 50.0 + k, 30.0) for k, a, o in fixes], "storm string, k int, lat double, lon double, p double, w double, r double")
    df = df.withColumn("t", F.timestamp_seconds(F.col("k") * 21600))
    rows = {r.k: r for r in st.storm_segments(df, "storm", "t", "lat", "lon", "p", "w", "r").collect()}
    assert sorted(rows) == [1, 2, 3, 4, 5, 6]
    degree = math.radians(1) * geo.EARTH_KM
    for r in rows.values():
        assert r.vseg * 1.852 == pytest.approx(degree / 6, rel=1e-6) and r.pseg == 1000.0 - (r.k - 1) and r.dpseg == -1
        assert r.lat_w == pytest.approx(r.lat - 4, abs=1e-9) and r.aseg == pytest.approx(0, abs=1e-9)
    assert rows[6].daseg == pytest.approx(90, abs=0.1) and rows[3].dvseg == pytest.approx(0, abs=1e-9)
    near = st.trim_segments(st.storm_segments(df, "storm", "t", "lat", "lon", "p", "w", "r"), "storm", "t", (3.0, 20.0), 0.5).collect()
    assert sorted(r.k for r in near) == [2, 3]


def test_small_pieces(spark):
    with pytest.raises(ValueError):
        st.presence_matrix(spark, [str(i) for i in range(21)])
    assert st.presence_matrix(spark, ["a", "b"]).collect()[-1].asDict() == {"pattern": 3, "a": 1, "b": 1}
    with pytest.raises(ValueError):
        waves.seasonal_parameter(F.lit(0.5), 1.0, [1.0])
    assert geo.polygon_size([(0, 0), (4, 0), (4, 3)]) == (6, 12)
    r = spark.range(1).select(geo.wind_to_pressure(F.lit(1e9), [-1.0, 1100.0]).alias("low"), geo.wind_to_pressure(F.lit(100.0), [-1.0, 1100.0]).alias("mid")).first()
    assert r.low == pytest.approx(850) and r.mid == pytest.approx(1000)
    line = spark.createDataFrame([("p", 0.0, 1.0), ("p", 2.0, 3.0), ("p", 5.0, 0.0)], "p string, x double, y double")
    assert [(r.x, r.y) for r in se.sampled_line(line, ["p"], "x", "y", 1.5).orderBy("k").collect()] == [(0.0, 1.0), (1.5, 2.5), (3.0, 2.0), (4.5, 0.5)]
    spread = spark.createDataFrame([("n", 10.0, 2.0), ("s", 10.0, 4.0), ("n", 200.0, 1.0)], "st string, d double, e double")
    sectors = {"n": (350.0, 20.0), "s": (20.0, 90.0)}
    assert {r.d: r.e for r in st.superpoint(spread, "st", "d", "e", [], sectors).collect()} == {10.0: 2.0, 200.0: 0.0}
    assert {r.d: r.e for r in st.superpoint(spread, "st", "d", "e", [], sectors, 10.0).collect()} == {10.0: 3.0, 200.0: 0.0}


def test_global_ranks(spark):
    from fathomlake.operators.frames import global_ranks

    rng = random.Random(6)
    rows = [(i, rng.choice(["a", "b", None]), rng.choice([None, 0.5, rng.random(), round(rng.random(), 1)])) for i in range(500)]
    df = spark.createDataFrame(rows, "i int, g string, v double").repartition(4)
    got = {r.i: r for r in global_ranks(df, "v", ["g"], total="n", ties="t", bins=7).collect()}
    for i, g, v in rows:
        mine = [x for _, h, x in rows if h == g]
        low = [x for x in mine if (x is None and v is not None) or (x is not None and v is not None and x < v)]
        assert (got[i]["rank"], got[i]["n"], got[i]["t"]) == (len(low) + 1, len(mine), sum(x == v for x in mine))
    assert sorted(r["rank"] for r in global_ranks(df, "v", unique=True, bins=5).collect()) == list(range(1, 501))
    assert global_ranks(df.limit(0), "v").collect() == []


def test_cramer_von_mises_chances():
    """Published limits: 0.46136 at 5 % and 0.74346 at 1 %."""
    assert ex.cramer_von_mises_p(0.46136) == pytest.approx(0.05, abs=2e-4)
    assert ex.cramer_von_mises_p(0.74346) == pytest.approx(0.01, abs=2e-4)
    assert ex.cramer_von_mises_p(1e-3) > 0.999


def test_fits_recover_parameters():
    rng = np.random.default_rng(42)
    u = rng.random(4000)
    gpd = 0.5 + 1.5 / 0.2 * ((1 - u) ** -0.2 - 1)
    p = ex.fit_distribution(gpd, "gpd", {0: 0.5})
    assert p[0] == 0.5 and p[1] == pytest.approx(1.5, abs=0.2) and p[2] == pytest.approx(0.2, abs=0.1)
    gev = 5 + 2 / 0.1 * ((-np.log(u)) ** -0.1 - 1)
    assert ex.fit_distribution(gev, "gev") == pytest.approx([5, 2, 0.1], abs=0.2)
    assert ex.fit_distribution(gev, "gev", {2: 0.1})[:2] == pytest.approx([5, 2], abs=0.2)
    assert list(ex.fit_distribution(gev, "gev", {0: 1.0, 1: 2.0, 2: 3.0})) == [1.0, 2.0, 3.0]


@pytest.mark.parametrize("method", ["am", "pot"])
def test_extreme_correction(spark, method):
    """Simulated maxima of another distribution are moved to the historical quantiles; values between them keep their order."""
    rng = np.random.default_rng(7)
    q = lambda u, a, b, c: a + b / c * ((-np.log(u)) ** -c - 1)
    day = lambda y, d: f"{1950 + y}-01-01 00:00:00" if d == 0 else f"{1950 + y}-{1 + d:02d}-10 00:00:00"
    hist = [(day(y, d), float(v)) for y in range(60) for d, v in enumerate(q(rng.random(11), 5, 2, 0.1))]
    sim = [(s, day(y, d), float(v)) for s in range(3) for y in range(40) for d, v in enumerate(q(rng.random(11), 3, 1.2, 0.05))]
    h = spark.createDataFrame(hist, "t string, v double").withColumn("t", F.to_timestamp("t"))
    m = spark.createDataFrame(sim, "sim int, t string, v double").withColumn("t", F.to_timestamp("t"))
    c = ex.ExtremeCorrection("v", "t", method, threshold=6.0, distance=0).fit(h)
    assert c.test(m, "sim")[1] < 0.01
    rows = c.transform(m, "sim").collect()
    assert len(rows) == len(sim)
    by = sorted((r.v, r.v_corr) for r in rows)
    assert all(a[1] <= b[1] + 1e-9 for a, b in zip(by, by[1:])) and by[0][0] == by[0][1]
    maxima = {}
    for r in rows:
        k = (r.sim, r.t.year)
        maxima[k] = max(maxima.get(k, -1e9), r.v_corr)
    target = {}
    for t, v in hist:
        target[t[:4]] = max(target.get(t[:4], -1e9), v)
    assert np.median(list(maxima.values())) == pytest.approx(np.median(list(target.values())), rel=0.15)
    same = c.transform(m, "sim", siglevel=-1.0).first()
    assert same.v_corr == same.v


def test_field_components(spark):
    from fathomlake.operators import fields as fl

    rng = np.random.default_rng(1)
    rows = [(t, i, float(np.sin(t * 0.7) * i + 0.01 * rng.random()), float(np.cos(t * 0.3) + i) if (t, i) != (4, 1) else None) for t in range(40) for i in range(3)]
    rows += [(t, 9, None, 1.0) for t in range(40)]
    df = spark.createDataFrame(rows, "t int, i int, a double, b double").repartition(3)
    names, m = fl.stacked(df, "t", ["i"], ["a", "b"], {"a": [2]}, {"a_2": 0.0, "b": "forward"})
    assert names == sorted([("a", 0), ("a", 1), ("a", 2), ("a_2", 0), ("a_2", 1), ("a_2", 2), ("b", 0), ("b", 1), ("b", 2), ("b", 9)])
    got = {r.t: r.x for r in m.collect()}
    assert len(got) == 40 and got[4][names.index(("b", 1))] == got[3][names.index(("b", 1))] and got[1][names.index(("a_2", 1))] == 0.0
    x = np.array([got[t] for t in range(40)])
    std = x.std(0)
    z = (x - x.mean(0)) / np.where(std > 1e-12, std, 1)
    values = np.linalg.svd(z, compute_uv=False) ** 2
    model = fl.fit_components(names, m, 4)
    assert model.ratio == pytest.approx(values[:4] / values.sum(), abs=1e-9) and model.cumulative[-1] <= 1 + 1e-9
    assert len(fl.fit_components(names, m, 0.5).ratio) <= 2
    whole = fl.fit_components(names, m, 10)
    back = {(r.t, r.variable, r.i): r.value for r in fl.from_scores(whole, fl.component_scores(whole, m, "t"), "t", ["i"], {"i": "int"}).collect()}
    for t in range(40):
        for k, n in enumerate(names):
            assert back[(t, *n)] == pytest.approx(got[t][k], abs=1e-6)
    with pytest.raises(ValueError):
        fl.fit_components(names, m.limit(0), 2)


def test_directional_clusters(spark):
    rng = np.random.default_rng(3)
    rows = [(i, float(rng.normal(2 if i % 2 else 8, 0.1)), float((350 + rng.normal(0, 5)) % 360 if i % 2 else 170 + rng.normal(0, 5))) for i in range(200)]
    labels, centres = md.directional_clusters(spark.createDataFrame(rows, "id int, h double, d double"), "id", ["h", "d"], ["d"], 2)
    found = {r.id: r.label for r in labels.collect()}
    assert len({found[i] for i in range(0, 200, 2)}) == len({found[i] for i in range(1, 200, 2)}) == 1 and found[0] != found[1]
    c = {r.label: r for r in centres.collect()}
    assert c[found[1]].h == pytest.approx(2, abs=0.1) and min(abs(c[found[1]].d - 350), 10) < 3
    assert c[found[0]].d == pytest.approx(170, abs=3)


def test_radial_model_with_directions(spark):
    """A quarter of the sea states gives 2 Hs + 3 Tp and the opposite direction at the others."""
    rng = np.random.default_rng(11)
    rows = [(i, float(a * 7), float(b * 20), float(c * 360)) for i, (a, b, c) in enumerate(rng.random((240, 3)))]
    df = spark.createDataFrame(rows, "id int, hs double, tp double, dir double").withColumn("y", 2 * F.col("hs") + 3 * F.col("tp")).withColumn("back", F.pmod(-F.col("dir"), F.lit(360.0)))
    model = md.RadialModel(["hs", "tp", "dir"], ["y", "back"], ["dir"], ["back"]).fit(df.filter("id % 2 = 0"))
    got = model.predict(df, "id").join(df.select("id", F.col("y").alias("wy"), F.col("back").alias("wback")), "id").collect()
    assert len(got) == 240
    assert np.sqrt(np.mean([(r.y - r.wy) ** 2 for r in got])) < 3
    assert np.median([abs((r.back - r.wback + 180) % 360 - 180) for r in got]) < 10
    with pytest.raises(ValueError):
        model.fit(df.limit(1))


def test_nonstationary_gev_is_the_stationary_one_at_rest(spark):
    from fathomlake.functions import extremes as ev
    from fathomlake.functions import nonstationary as ns

    df = spark.createDataFrame([(x, 0.1 * i) for i, x in enumerate([-50.0, 10.0, 45.0, 300.0])], "x double, t double")
    p = ns.gev_parameters(F.col("t"), {"base": 40.0}, {"base": math.log(30.0)}, {"base": 0.1})
    row = df.select(ns.gev_cdf_at(F.col("x"), p).alias("a"), ev.gev_cdf(F.col("x"), 40, 30, 0.1).alias("b"), ns.gev_quantile_at(F.lit(0.9), p).alias("q"), ev.gev_quantile(F.lit(0.9), 40, 30, 0.1).alias("r"), ns.gev_log_likelihood_at(F.col("x"), p).alias("l"), ev.gev_log_likelihood(F.col("x"), 40, 30, 0.1).alias("m")).collect()
    for r in row:
        assert r.a == pytest.approx(r.b, abs=1e-12) and r.q == pytest.approx(r.r) and (r.l == pytest.approx(r.m) if r.m is not None else r.l is None)
    assert ns.aggregate_quantile(df, p, 0.9) == pytest.approx(40 + 300 * ((-math.log(0.9)) ** -0.1 - 1), rel=1e-4)
    with pytest.raises(ValueError):
        ns.aggregate_quantile(df, p, 1.0)
    flat = df.select(ns.gev_cdf_at(F.col("x"), ns.gev_parameters(F.col("t"), {"base": 40.0}, {"base": math.log(30.0)}, {"base": 0.0})).alias("a"), ev.gev_cdf(F.col("x"), 40, 30, 0.0).alias("b")).collect()
    assert all(r.a == pytest.approx(r.b, abs=1e-12) for r in flat)


def test_waves_where_the_mean_meets_a_value_do_not_depend_on_arrival(spark):
    """Added up backwards, the mean of these values has another last bit and one crossing less."""
    values = [9.8, 5.3, 1.7, 1.5, 5.7, 6.9, 5.6, 9.1]
    rows = [(1, t, v) for t, v in enumerate(values)]
    for arrived in (rows, rows[::-1]):
        df = spark.createDataFrame(arrived, "u int, t int, v double").coalesce(1)
        got = sorted((r.wave, round(r.height, 6), r.period) for r in se.upcrossing_waves(df, "v", ["t"], ["u"]).collect())
        assert got == [(1, 0.0, 1), (2, 1.2, 2)]


def most_rows(spark, run):
    """Rows of the largest step of the plans that ``run`` executes."""
    store, jvm = spark._jsparkSession.sharedState().statusStore(), spark._jvm
    bus = spark.sparkContext._jsc.sc().listenerBus()
    listed = lambda seq: jvm.scala.jdk.javaapi.CollectionConverters.asJava(seq)
    bus.waitUntilEmpty(30_000)
    old, most = {x.executionId() for x in listed(store.executionsList())}, 0
    run()
    bus.waitUntilEmpty(30_000)
    for x in listed(store.executionsList()):
        if x.executionId() not in old:
            values = listed(store.executionMetrics(x.executionId()))
            for node in listed(store.planGraph(x.executionId()).allNodes()):
                for m in listed(node.metrics()):
                    if m.name() == "number of output rows" and (v := values.get(m.accumulatorId())):
                        most = max(most, int(v.replace(",", "")))
    return most


def test_nearest_makes_few_rows_where_references_crowd(spark):
    """One reference far away: all others were in one cell, and every query met them all."""
    rng = np.random.default_rng(8)
    refs, queries = rng.random((3000, 3)), rng.random((3000, 3))
    refs[17] = 1e4
    cols = "a double, b double, c double"
    r = spark.createDataFrame([(i, *map(float, x)) for i, x in enumerate(refs)], f"rid int, {cols}")
    q = spark.createDataFrame([(i, *map(float, x)) for i, x in enumerate(queries)], f"qid int, {cols}")
    got = {}
    with pytest.MonkeyPatch.context() as m:
        m.setattr(jn, "MOST_REFERENCES", 100)
        rows = most_rows(spark, lambda: got.update({x.qid: x.rid for x in jn.nearest(q, r, "qid", "rid", ["a", "b", "c"]).collect()}))
    assert got == {i: int(((refs - p) ** 2).sum(1).argmin()) for i, p in enumerate(queries)}
    assert rows < 10 * 3000


@pytest.mark.parametrize("held,sampled", [(20, 60), (7, 1000), (10_000, 5)])
def test_nearest_by_leaves_takes_copies_ties_and_missing_places(spark, held, sampled):
    rng = np.random.default_rng(5)
    refs, queries = rng.integers(0, 5, (300, 2)) / 5, rng.integers(-2, 9, (200, 2)) / 5
    name = lambda i: f"r{i:03d}"
    rows = [(name(i + 1), *map(float, x)) for i, x in enumerate(refs)] + [("r000", None, 0.2), ("r999", 0.2, float("nan"))]
    r = spark.createDataFrame(rows, "rid string, a double, b double")
    q = spark.createDataFrame([(i, *map(float, x)) for i, x in enumerate(queries)] + [(-1, None, 0.5), (-2, 0.5, float("nan"))], "qid long, a double, b double")
    got = {x.qid: (x.rid, x.distance) for x in jn.nearest_by_leaves(q, r, "qid", "rid", ["a", "b"], held=held, sampled=sampled).collect()}
    assert (got.pop(-1), got.pop(-2)) == (("r000", None),) * 2
    d = ((queries[:, None] - refs) ** 2).sum(2)
    assert got == {i: (name(int(d[i].argmin()) + 1), pytest.approx(float(np.sqrt(d[i].min())))) for i in range(200)}
    none = r.filter("rid = 'r000'")
    assert {(x.rid, x.distance) for x in jn.nearest_by_leaves(q, none, "qid", "rid", ["a", "b"]).collect()} == {("r000", None)}
    assert jn.nearest_by_leaves(q, none.filter("false"), "qid", "rid", ["a", "b"]).count() == 0
    assert jn.nearest_by_leaves(q.filter("false"), r, "qid", "rid", ["a", "b"], held=held, sampled=sampled).count() == 0
