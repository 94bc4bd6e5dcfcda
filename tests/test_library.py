"""The library's operators against golden values, brute force and their SQL."""

import math
import os

import duckdb
import numpy as np
import pytest
from fathomlake.functions import extremes as ev
from fathomlake.functions import geo, waves
from fathomlake.operators import extremes as ex
from fathomlake.operators import frames as fr
from fathomlake.operators import joins as jn
from fathomlake.operators import models as md
from fathomlake.operators import series as se
from fathomlake.operators import storms as st
from fathomlake.plans import catalog, more  # noqa: F401  more registers queries
from fathomlake.sources import files
from fathomlake.streaming import windows
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("set TimeZone='UTC'")
    for f in os.listdir(SF):
        con.execute(f"create view {f[:-8]} as select * from '{SF}/{f}'")
    return con


def same(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return "~"
    return f"{float(v):.5g}" if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_query_equals_sql(spark, duck, name):
    df = catalog.QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    got = sorted(tuple(same(v) for v in r) for r in df.select(*[f"`{c}`" for c in cols]).collect())
    res = duck.execute(catalog.ORACLES[name])
    names = [d[0] for d in res.description]
    assert sorted(names) == cols
    assert got == sorted(tuple(same(r[names.index(c)]) for c in cols) for r in res.fetchall())


def one(spark, *cols):
    return spark.range(1).select(*cols).first()


def test_geodesy_golden(spark):
    L = lambda x: F.lit(float(x))
    r = one(spark, *[geo.arc_distance(*map(L, p)).alias(f"d{i}") for i, p in enumerate([(0, 0, 0, 90), (45, -90, -45, 90), (3, 4, 3, 4), (0, 0, 0, 180)])], geo.azimuth(*map(L, (0, 0, 0, 90))).alias("a"))
    assert (r.d0, r.d1, r.d2, r.d3, r.a) == pytest.approx((90, 180, 0, 180, 90))
    p = one(spark, geo.azimuth(L(-90), L(0), L(10), L(0)).alias("s"), geo.azimuth(L(10), L(0), L(-90), L(0)).alias("n"))
    assert (p.s, p.n) == pytest.approx((0, 180))
    u = one(spark, geo.utm(L(3), L(0), 31).alias("a"), geo.utm(L(2.2945), L(48.8584), 31).alias("b"))
    assert u.a.easting == pytest.approx(500000) and u.a.northing == pytest.approx(0, abs=1e-6)
    assert u.b.easting == pytest.approx(448252, abs=2) and u.b.northing == pytest.approx(5411955, abs=15)
    b = spark.createDataFrame([(1.0, 50.0), (5.9, -20.0)], "lon double, lat double").withColumn("u", geo.utm(F.col("lon"), F.col("lat"), 31))
    for r in b.select("lon", "lat", geo.from_utm(F.col("u.easting"), F.col("u.northing"), 31).alias("g")).collect():
        assert (r.g.lon, r.g.lat) == pytest.approx((r.lon, r.lat), abs=1e-7)


def test_dispersion_and_spectrum(spark):
    r = one(spark, waves.wavelength(F.lit(10.0), F.lit(5000.0)).alias("deep"), waves.wavelength(F.lit(10.0), F.lit(10.0), tolerance=1e-9, steps=400).alias("l"))
    assert r.deep == pytest.approx(156.13, abs=0.1)
    k = 2 * math.pi / r.l
    assert (2 * math.pi / 10) ** 2 == pytest.approx(9.81 * k * math.tanh(10 * k), rel=1e-6)
    f = np.linspace(0.02, 1, 3000)
    s = [r[0] for r in spark.createDataFrame([(float(x),) for x in f], "f double").select(waves.jonswap(F.col("f"), F.lit(2.0), F.lit(8.0))).collect()]
    assert 4 * math.sqrt(np.trapezoid(s, f)) == pytest.approx(2, rel=0.06)


def test_distributions(spark):
    x = spark.range(1, 100).select((F.col("id") / 100).alias("p"))
    for xi in (0.0, 0.2, -0.2):
        r = x.select(F.max(F.abs(ev.gev_cdf(ev.gev_quantile(F.col("p"), 3, 2, xi), 3, 2, xi) - F.col("p"))), F.max(F.abs(ev.gpd_cdf(ev.gpd_quantile(F.col("p"), 3, 2, xi), 3, 2, xi) - F.col("p"))), F.max(F.abs(ev.gpd_poisson_cdf(ev.gpd_poisson_quantile(F.col("p"), 3, 2, xi, 1), 3, 2, xi, 1) - F.greatest("p", F.lit(math.exp(-1)))))).first()
        assert r[0] < 1e-9 and r[1] < 1e-9
    assert ev.gev_moments(0, 1, 0)["mean"] == pytest.approx(0.5772, abs=1e-4)
    assert ev.gpd_moments(0, 2, 0.2)["mean"] == pytest.approx(2.5)


def test_fits_recover_parameters(spark):
    rng = np.random.default_rng(42)
    u = rng.random(1000)
    gev = 5 + 2 / 0.1 * ((-np.log(u)) ** -0.1 - 1)
    gpd = 0.5 + 1.5 / 0.2 * ((1 - u) ** -0.2 - 1)
    df = spark.createDataFrame([("a", float(g), float(p)) for g, p in zip(gev, gpd)], "k string, g double, p double")
    r = ex.gev_fits(df, "g", "k").first()
    assert (r["loc"], r["scale"], r["shape"]) == pytest.approx((5, 2, 0.1), abs=0.2)
    r = ex.gpd_fits(df, "p", "k", 0.5).first()
    assert (r["scale"], r["shape"]) == pytest.approx((1.5, 0.2), abs=0.15)
    assert ex.gpd_fits(df.limit(0), "p", "k", 0.5).count() == 0
    levels = {r["years"]: r for r in ex.gev_return_levels(df, "g", [10.0, 100.0], resamples=8).collect()}
    assert levels[10.0]["low"] < levels[10.0]["middle"] < levels[100.0]["middle"]


def test_farthest_point_selection(spark):
    rng = np.random.default_rng(1)
    x = rng.random((200, 2))
    df = spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(x)], "id long, a double, b double")
    got = [r.id for r in md.max_dissimilarity(df, "id", ["a", "b"], 6).orderBy("pick").collect()]
    want = [int(x.sum(1).argmax())]
    while len(want) < 6:
        d = ((x[:, None] - x[want][None]) ** 2).sum(-1).min(1)
        want.append(int(d.argmax()))
    assert got == want


def test_models(spark):
    rng = np.random.default_rng(2)
    a = rng.standard_normal(500)
    df = spark.createDataFrame([(i, float(v), float(2 * v + 1), float(rng.standard_normal())) for i, v in enumerate(a)], "id long, x double, y double, z double")
    scores, load, share = md.principal_components(df, "id", ["x", "y", "z"], 3)
    assert share[0] == pytest.approx(2 / 3, abs=0.05) and share[2] == pytest.approx(0, abs=1e-6)
    m = df.agg(*[f(c) for c in "xyz" for f in (F.avg, F.stddev_pop)]).first()
    back = md.reconstruct(scores, "id", load, [(m[2 * i], m[2 * i + 1]) for i in range(3)], ["x", "y", "z"]).orderBy("id").first()
    assert back.x == pytest.approx(a[0], abs=1e-6)
    nodes = rng.random((60, 2))
    y = 2 * nodes[:, 0] + 3 * nodes[:, 1]
    q = spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(rng.random((50, 2)))], "id long, a double, b double")
    p = {r.id: r.t for r in md.rbf_predict(q, "id", ["a", "b"], nodes, {"t": md.rbf_weights(nodes, y, 0.5)}, {"t": 0.5}).collect()}
    assert all(p[r.id] == pytest.approx(2 * r.a + 3 * r.b, abs=1e-3) for r in q.collect())
    lhs = md.latin_hypercube(spark, {"u": (0, 10)}, 10).collect()
    assert sorted(int(r.u) for r in lhs) == list(range(10))
    assert md.batch_som(df, "id", ["x", "y"], 2, 2).select("neuron").distinct().count() > 1
    assert md.k_means(df, "id", ["x", "y"], 3).count() == 500


def test_series_edge_cases(spark):
    empty = spark.createDataFrame([], "k int, t int, v double, l string")
    assert se.runs(empty, "l", ["t"], ["k"]).count() == 0
    df = spark.createDataFrame([(1, i, float(i), "a" if i < 3 else "b") for i in range(6)], "k int, t int, v double, l string")
    assert [r.length for r in se.runs(df, "l", ["t"], ["k"]).orderBy("run").collect()] == [3, 3]
    assert se.persistences(df, "l", ["t"], ["k"]).count() == 1
    got = [r.running_mean for r in se.running_mean(df, "v", ["t"], ["k"], 1).orderBy("t").collect()]
    assert got == pytest.approx([1 / 3, 1, 2, 3, 4, 14 / 3])
    assert fr.metrics(df.limit(0), "v", "v").first().bias is None
    with pytest.raises(ValueError):
        fr.one_by_one(spark, a=[1, 2], b=[1])
    assert fr.one_by_one(spark, a=[1, 2], b=["x", "y"]).count() == 2


def test_superposition(spark):
    f = spark.createDataFrame([(0, "c", 2.0), (1, "c", 1.0)], "step int, cell string, amount double")
    r = spark.createDataFrame([("c", 0, 1.0), ("c", 1, 10.0)], "cell string, lag int, unit double")
    got = {x.step: x.level for x in jn.shifted_accumulation(f, r, "cell", "step", "lag", "amount", "unit", []).collect()}
    assert got == {0: 2.0, 1: 21.0, 2: 10.0}


def test_readers(spark, tmp_path):
    (tmp_path / "b.txt").write_text("#YY MM DD hh mm WVHT DPD\n#yr mo dy hr mn m sec\n2020 01 02 03 04 1.5 MM\n2020 01 02 04 04 2.5 8\n")
    rows = files.read_buoy_table(spark, str(tmp_path / "b.txt")).orderBy("time").collect()
    assert [(r.time.hour, r.WVHT, r.DPD) for r in rows] == [(3, 1.5, None), (4, 2.5, 8.0)]
    (tmp_path / "m.grd").write_text("t\n1 3\n1 0 0 5\n2 1 0 6\n3 0 1 7\n1 3 1 2 3\n0\n")
    nodes, cells = files.read_mesh(spark, str(tmp_path / "m.grd"))
    assert nodes.count() == 3 and [(r.a, r.b, r.c) for r in cells.collect()] == [(1, 2, 3)]
    (tmp_path / "l.csv").write_text("0,0\n1,1\nNaN,NaN\n5,5\n")
    assert files.read_polylines(spark, str(tmp_path / "l.csv")).select("line").distinct().count() == 2
    g = spark.range(10).select((F.col("id") % 5).cast("double").alias("lat"), F.col("id").cast("double").alias("lon"))
    files.save_table(g, str(tmp_path / "g"), units={"lat": "deg"})
    assert files.grid_box(files.load_table(spark, str(tmp_path / "g")), "lat", "lon", 0, 4, 0, 9, 2).count() > 0


def test_streams_equal_tables(spark, tmp_path):
    rows = spark.read.parquet(f"{SF}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    rows.repartition(1).write.parquet(str(tmp_path / "in"))
    for name, f in {"maxima": lambda d: windows.window_maxima(d, "ts", "value", "user_id"), "labels": lambda d: windows.label_counts(d, "ts", "event_type"), "storms": lambda d: windows.storm_sessions(d, "ts", "value", "user_id", 50)}.items():
        stream = f(spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in")))
        q = stream.writeStream.outputMode("complete" if name != "storms" else "append").format("memory").queryName(f"s_{name}").trigger(availableNow=True).start()
        q.awaitTermination(120)
        if name != "storms":
            assert sorted(map(str, spark.table(f"s_{name}").collect())) == sorted(map(str, f(rows).collect()))
    t = windows.running_transitions(spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in")), "user_id", "event_type")
    q = t.writeStream.outputMode("append").format("memory").queryName("s_t").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert spark.table("s_t").count() == rows.count() - rows.select("user_id").distinct().count()


def test_return_levels_use_every_maximum(spark, monkeypatch):
    n = 12_000
    x = 5 + 2 / 0.1 * ((-np.log((np.arange(n) + 0.5) / n)) ** -0.1 - 1)
    df = spark.createDataFrame([(float(v),) for v in x] + [(None,)], "g double")
    levels = {r["years"]: r for r in ex.gev_return_levels(df, "g", [10.0, 100.0], resamples=8).collect()}
    for t, r in levels.items():
        assert r["middle"] == pytest.approx(5 + 2 / 0.1 * ((-math.log(1 - 1 / t)) ** -0.1 - 1), rel=0.02)
    monkeypatch.setattr(ex, "MOST_MAXIMA", n - 1)
    with pytest.raises(ValueError):
        ex.gev_return_levels(df, "g", [10.0], resamples=2)


def test_forward_fill_fills_every_series(spark):
    hours = {}
    for r in spark.read.parquet(f"{SF}/events.parquet").select("user_id", (F.unix_timestamp(F.col("ts").cast("timestamp")) / 3600).cast("long").alias("h"), "value").collect():
        hours.setdefault(r.user_id, {}).setdefault(r.h, []).append(r.value)
    want = {}
    for user, at in hours.items():
        known = sorted(at)
        for a, b in zip(known, known[1:] + [known[-1] + 1]):
            want |= {(user, h): max(at[a]) for h in range(a, b)}
    rows = catalog.QUERIES["forward_fill_hourly"](spark, SF).select("user_id", (F.unix_timestamp("ts") / 3600).cast("long").alias("h"), "v").collect()
    got = {(r.user_id, r.h): r.v for r in rows}
    assert len(rows) == len(got) and got.keys() == want.keys()
    assert all(got[k] == pytest.approx(want[k], abs=1e-4) for k in want)


def brute_track(fixes, minutes):
    """(second, lat, lon, pressure) every ``minutes`` from each fix to the next, on the chord's great circle."""
    vec = lambda la, lo: np.array([math.cos(math.radians(la)) * math.cos(math.radians(lo)), math.cos(math.radians(la)) * math.sin(math.radians(lo)), math.sin(math.radians(la))])
    out = []
    for (ta, la, lo, pa), (tb, lb, lob, pb) in zip(fixes, fixes[1:]):
        a, b = vec(la, lo), vec(lb, lob)
        d = math.atan2(np.linalg.norm(np.cross(a, b)), float(a @ b))
        t = ta
        while t < tb:
            f = (t - ta) / (tb - ta)
            v = (math.sin((1 - f) * d) * a + math.sin(f * d) * b) / math.sin(d) if d > 1e-12 else a
            out.append((t, math.degrees(math.asin(v[2])), math.degrees(math.atan2(v[1], v[0])), pa + (pb - pa) * f))
            t += 60 * minutes
    return out


def assert_tracks(got, fixes, minutes):
    assert {s for s, f in fixes.items() if len({t for t, *_ in f}) > 1} == {s for s, *_ in got}
    for storm, points in fixes.items():
        rows = sorted(x[1:] for x in got if x[0] == storm)
        want = brute_track(sorted(points), minutes)
        assert len(rows) == len(want)
        for g, w in zip(rows, want):
            assert g[0] == pytest.approx(w[0]) and g[1] == pytest.approx(w[1], abs=1e-4) and g[3] == pytest.approx(w[3], abs=1e-4)
            assert abs((g[2] - w[2] + 180) % 360 - 180) * math.cos(math.radians(w[1])) < 1e-4


def seconds(df, storm="storm"):
    return [tuple(r) for r in df.select(storm, F.unix_micros("ts") / 1e6, "lat", "lon", "pressure").collect()]


def test_interpolated_tracks_by_brute_force(spark):
    rng = np.random.default_rng(4)
    fixes = {k: [(float(t), float(rng.uniform(-60, 60)), float(rng.uniform(-180, 180)), float(rng.uniform(900, 1000))) for t in sorted(rng.choice(90_000, 5, replace=False))] for k in (3, 20, 21)}
    fixes[4] = [(0.0, 10.0, 20.0, 990.0)]
    fixes[5] = [(0.0, 10.0, 20.0, 990.0), (0.0, 10.0, 20.0, 990.0), (7200.0, 12.0, 22.0, 980.0)]
    rows = [(k, *x) for k, f in fixes.items() for x in f]
    df = spark.createDataFrame(rows, "storm int, s double, lat double, lon double, pressure double").withColumn("ts", F.timestamp_micros((F.col("s") * 1e6).cast("long")))
    assert_tracks(seconds(st.interpolate_tracks(df, "storm", "ts", "lat", "lon", ["pressure"], 60)), fixes, 60)


def test_interpolate_tracks_query_takes_every_storm(spark):
    fixes = {}
    for s, *x in seconds(catalog._tracks(spark, SF)):
        fixes.setdefault(s, []).append(tuple(x))
    assert_tracks(seconds(catalog.QUERIES["interpolate_tracks"](spark, SF)), fixes, 60)


def test_triangular_hydrograph_takes_every_event(spark):
    want = {}
    for r in spark.read.parquet(f"{SF}/events.parquet").select("event_id", "value").collect():
        for hour in range(11):
            want[r.event_id, hour] = r.value * (hour / 3 if hour <= 3 else (10 - hour) / 7)
    rows = catalog.QUERIES["triangular_hydrograph"](spark, SF).collect()
    got = {(r.event_id, r.hour): r.level for r in rows}
    assert len(rows) == len(got) and got.keys() == want.keys()
    assert all(got[k] == pytest.approx(want[k], abs=1e-6) for k in want)


def test_no_depth_has_no_wavelength(spark):
    r = one(spark, waves.wavelength(F.lit(10.0), F.lit(0.0)).alias("l"), waves.celerity(waves.wavelength(F.lit(10.0), F.lit(0.0)), F.lit(0.0)).alias("c"), waves.wavelength(F.lit(0.0), F.lit(5.0)).alias("still"))
    assert math.isnan(r.l) and math.isnan(r.c) and r.still == 0


def test_thin_plate_at_zero(spark):
    d = spark.createDataFrame([(0.0,), (None,), (1.0,)], "r double").select(waves.radial_kernel(F.col("r"), 0.5, "thin_plate").alias("v"))
    zero, null, one_ = [r.v for r in d.collect()]
    assert math.isnan(zero) and null is None and one_ == pytest.approx(math.log(2))
