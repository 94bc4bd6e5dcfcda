"""More registered queries: projections, tracks, series, distributions and fields, each with its SQL where SQL can express it."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from fathomlake.functions import geo, normal
from fathomlake.functions import nonstationary as ns
from fathomlake.functions import waves as wv
from fathomlake.operators import extremes as ex
from fathomlake.operators import fields as fl
from fathomlake.operators import frames as fr
from fathomlake.operators import joins as jn
from fathomlake.operators import models as md
from fathomlake.operators import series as se
from fathomlake.operators import storms as st
from fathomlake.plans.catalog import TRACKS, _arc, _tracks
from fathomlake.plans.inputs import WAVES, table, waves
from fathomlake.plans.registry import per_wave, query

C = F.col
L = F.lit


def arc(a: str, b: str, c: str, d: str) -> str:
    """SQL for the arc in degrees between two places (lat, lon, lat, lon)."""
    h = f"(sin(radians(({c})-({a}))/2)*sin(radians(({c})-({a}))/2)+cos(radians({a}))*cos(radians({c}))*sin(radians(({d})-({b}))/2)*sin(radians(({d})-({b}))/2))"
    h = f"least(1.0,greatest(0.0,{h}))"
    return f"degrees(2*atan2(sqrt({h}), sqrt(1-{h})))"


def bearing(a: str, b: str, c: str, d: str) -> str:
    """SQL for the initial bearing; no place is a pole."""
    return f"fmod(degrees(atan2(cos(radians({c}))*sin(radians(({d})-({b}))), cos(radians({a}))*sin(radians({c}))-sin(radians({a}))*cos(radians({c}))*cos(radians(({d})-({b})))))+360, 360)"


def shot(lat: str, lon: str, course: str, angle: str) -> tuple[str, str]:
    """SQL for the place reached on the sphere: latitude, longitude in [-180, 180)."""
    a = f"asin(least(1.0,greatest(-1.0,sin(radians({lat}))*cos(radians({angle}))+cos(radians({lat}))*sin(radians({angle}))*cos(radians({course})))))"
    b = f"fmod(fmod(degrees(radians({lon})+atan2(sin(radians({course}))*sin(radians({angle}))*cos(radians({lat})), cos(radians({angle}))-sin(radians({lat}))*sin({a})))+180, 360)+360, 360)-180"
    return f"degrees({a})", b


# --- places
MERC_Y = "6378137.0::DOUBLE*ln(tan(pi()/4+radians({0})/2))"
TILE_LAT = "degrees(atan(sinh(pi()*(1-2*({0})/256.0::DOUBLE))))"
per_wave("tile_bounds", {k: (lambda k=k: geo.tile_bounds((C("id") % 200).cast("double"), (C("id") % 190).cast("double"), (C("id") % 200 + 3).cast("double"), (C("id") % 190 + 2).cast("double"), 8)[k]) for k in ("x_min", "y_min", "x_max", "y_max")},
         f"round(6378137.0::DOUBLE*radians((id%200)/256.0::DOUBLE*360-180),3)+0 AS x_min, round({MERC_Y.format(TILE_LAT.format('id%190+3'))},3)+0 AS y_min, round(6378137.0::DOUBLE*radians((id%200+4)/256.0::DOUBLE*360-180),3)+0 AS x_max, round({MERC_Y.format(TILE_LAT.format('id%190'))},3)+0 AS y_max", 3)
per_wave("tile_corner", {k: (lambda k=k: geo.tile_corner((C("id") % 256).cast("double"), (C("id") % 250).cast("double"), 8)[k]) for k in ("lat", "lon")}, f"round({TILE_LAT.format('id%250')},6) AS lat, round((id%256)/256.0::DOUBLE*360-180,6) AS lon")
per_wave("raster_step", {"metres": lambda: geo.raster_step(C("lon1") - 180, C("lat1") / 2, 0.01)},
         f"round((abs(6378137.0::DOUBLE*radians(0.01/sqrt(2.0::DOUBLE)))+abs({MERC_Y.format('lat1/2+0.01/sqrt(2.0::DOUBLE)')}-{MERC_Y.format('lat1/2')}))/2,4) AS metres", 4)
per_wave("mean_velocity", {k: (lambda k=k: geo.mean_velocity(C("lat1"), C("lon1"), C("lat2"), C("lon2"), C("tp"))[k]) for k in ("course", "speed", "vx", "vy")},
         "round(course,4) AS course, round(v,4) AS speed, round(v*sin(radians(course+180)),4)+0 AS vx, round(v*cos(radians(course+180)),4)+0 AS vy", 4)
per_wave("polar_place", {k: (lambda k=k: geo.polar_place(C("lat1"), C("lon1"), C("lat2"), C("lon2"), C("dir"), C("id") % 2 == 1)[k]) for k in ("km", "angle")}, "round(km,4) AS km, round(CASE WHEN id%2=0 THEN g WHEN g>=0 AND g<=180 THEN 180-g WHEN g>=180 AND g<=360 THEN 540-g ELSE g END,4) AS angle", 4)
per_wave("ocean_basin", {"basin": lambda: geo.ocean_basin(C("lat1"), C("lon1"))},
         "CASE WHEN lat1<0 AND lon1<135 AND lon1>20 THEN 'SI' WHEN lat1<0 AND lon1>135 AND lon1<290 THEN 'SP' WHEN lat1>0 AND lon1>20 AND lon1<100 THEN 'NI' WHEN lat1>0 AND lon1>100 AND lon1<180 THEN 'WP' WHEN lat1>0 AND lon1>180 AND lon1<260 THEN 'EP' WHEN lat1>0 AND lat1<15 AND lon1>260 AND lon1<275 THEN 'EP' ELSE 'NA' END AS basin")
per_wave("wind_to_pressure", {"pressure": lambda: geo.wind_to_pressure(geo.polynomial(C("pressure"), [-2e-6, 0.0, 0.0, 2100.0]), [-2e-6, 0.0, 0.0, 2100.0])}, "round(pressure,6) AS pressure")
per_wave("seasonal_parameter", {"y": lambda: wv.seasonal_parameter(C("tp") / 10, 2.0, [0.5, -0.25, 0.125, 0.75], 0.3, [(C("hs"), 0.01)])},
         "round(2+0.3*tp/10+0.5*cos(2*pi()*tp/10)-0.25*sin(2*pi()*tp/10)+0.125*cos(4*pi()*tp/10)+0.75*sin(4*pi()*tp/10)+0.01*hs,6) AS y")
_SQUARE = [(40.0, -40.0), (160.0, -40.0), (160.0, 40.0), (40.0, 40.0)]
per_wave("polygon_buffer", {"near": lambda: geo.in_buffer(C("lon1"), C("lat1"), _SQUARE, 0.5)}, "(pow(greatest(0, 40-lon1, lon1-160),2)+pow(greatest(0, -40-lat1, lat1-40),2) <= 12.0*12.0) AS near")


@query(f"WITH {WAVES} SELECT id, round(tp/4-10,6) AS lon, round(lat1*0.9,6) AS lat FROM w")
def utm_inverse(spark, sf):
    """To a zone and back gives the place again, south of the equator too."""
    w = waves(spark, sf).withColumn("u", geo.utm(C("tp") / 4 - 10, C("lat1") * 0.9, 29))
    return w.select("id", geo.from_utm(C("u.easting"), C("u.northing"), 29).alias("p")).select("id", "p.lon", "p.lat")


def _fix(name: str, sql_from: str) -> None:
    """Give a per-wave SQL its own source."""
    from fathomlake.plans.registry import ORACLES

    ORACLES[name] = ORACLES[name].replace(" FROM w", sql_from) if ORACLES[name].endswith(" FROM w") else ORACLES[name]


_fix("mean_velocity", f" FROM (SELECT id, {bearing('lat2', 'lon2', 'lat1', 'lon1')} AS course, radians({arc('lat1', 'lon1', 'lat2', 'lon2')})*6371/tp AS v FROM w)")
_fix("polar_place", f" FROM (SELECT id, km, CASE WHEN t<0 THEN fmod(t+720,360) ELSE t END AS g FROM (SELECT id, radians({arc('lat1', 'lon1', 'lat2', 'lon2')})*6371 AS km, {bearing('lat1', 'lon1', 'lat2', 'lon2')}-(dir-90) AS t FROM w))")

# --- waves by recursion: the wavelength's fixed point


@query(f"WITH RECURSIVE {WAVES}, p AS (SELECT DISTINCT tp AS t, 10.0::DOUBLE AS d FROM w UNION SELECT DISTINCT tp, 50.0 FROM w), l AS (SELECT t, d, 1.0::DOUBLE AS now, false AS done, 0 AS k FROM p UNION ALL SELECT t, d, CASE WHEN done THEN now ELSE new END, done OR abs(new-now)<=0.1, k+1 FROM (SELECT *, 9.81::DOUBLE*t*t/(2*pi())*(1-2/(exp(least(600.0, 4*pi()*d/now))+1)) AS new FROM l WHERE k<40) x), e AS (SELECT t, d, now AS len FROM l WHERE k=40), j AS (SELECT w.*, a.len AS l1, b.len AS l2, least(90.0, greatest(-90.0, fmod(dir-270+180+360, 360)-180)) AS inc FROM w JOIN e a ON a.t=w.tp AND a.d=50 JOIN e b ON b.t=w.tp AND b.d=10), o AS (SELECT *, asin(least(1.0, greatest(-1.0, sin(radians(inc))*l2/l1))) AS out, l1/tp/2*(1+4*pi()*50/l1/sinh(least(600.0, 4*pi()*50/l1))) AS g1, l2/tp/2*(1+4*pi()*10/l2/sinh(least(600.0, 4*pi()*10/l2))) AS g2 FROM j) SELECT id, round(hs/50*sqrt(greatest(0.0, cos(radians(inc)))/cos(out))*sqrt(g1/g2),4) AS height, round(fmod(degrees(out)+270+360, 360),4) AS direction FROM o", 4)
def snell_to_shore(spark, sf):
    return waves(spark, sf).select("id", wv.snell(C("tp"), C("hs") / 50, C("dir"), L(50.0), L(10.0), L(270.0)).alias("s")).select("id", "s.height", "s.direction")


@query(f"WITH {WAVES} SELECT id, 0.0::DOUBLE AS off FROM w")
def dispersion_relation(spark, sf):
    """The wavelength solves the dispersion relation: what it is off, in steps of 2 % of the length."""
    w = waves(spark, sf).withColumn("l", wv.wavelength(C("tp"), C("hs") + 40, 400, 1e-4))
    back = 9.81 * C("tp") * C("tp") / (2 * math.pi) * F.tanh(2 * math.pi * (C("hs") + 40) / C("l"))
    return w.select("id", (F.floor(F.abs(back / C("l") - 1) / 0.02)).cast("double").alias("off"))


def _series_sql(systems: list, seconds: int, n: int = 60, depth: float | None = None) -> str:
    def s(h, t, g):
        beta = 0.06238 / (0.23 + 0.0336 * g - 0.185 / (1.9 + g)) * (1.094 - 0.01915 * math.log(g))
        return f"({beta!r}::DOUBLE*{h}*{h}*pow({t}::DOUBLE,-4)*pow(f,-5)*exp(-1.25*pow({t}*f,-4))*pow({g}::DOUBLE,exp(-({t}*f-1)*({t}*f-1)/(2*pow(CASE WHEN f*{t}<=1 THEN 0.07 ELSE 0.09 END,2)))))"

    step = 0.98 / (n - 1)
    cols = ", ".join(f"{s(h, t, g)} AS s{i}" for i, (h, t, g) in enumerate(systems))
    head = f"f AS (SELECT k AS id, 0.02+k*{step!r}::DOUBLE AS f, ((('0x' || substr(md5('1:' || k::VARCHAR), 1, 13))::BIGINT::DOUBLE+0.5)/4503599627370496.0)*2*pi() AS phase FROM (SELECT unnest(range({n})) AS k))"
    if not depth:
        total = "+".join(f"s{i}" for i in range(len(systems)))
        return f"WITH {head}, a AS (SELECT f, phase, sqrt(2*({total})*{step!r}) AS a FROM (SELECT *, {cols} FROM f)) SELECT t::DOUBLE AS t, round(sum(a*cos(2*pi()*f*t+phase)),4)+0 AS level FROM (SELECT unnest(range({seconds})) AS t) CROSS JOIN a GROUP BY 1"
    edge = f"CASE WHEN id IN (0,{n - 1}) THEN 0.5 ELSE 1.0 END"
    rec = f"l AS (SELECT id, f, phase, 1.0::DOUBLE AS now, false AS done, 0 AS k FROM f UNION ALL SELECT id, f, phase, CASE WHEN done THEN now ELSE new END, done OR abs(new-now)<=0.1, k+1 FROM (SELECT *, 9.81::DOUBLE/(f*f)/(2*pi())*(1-2/(exp(least(600.0, 4*pi()*{depth}/now))+1)) AS new FROM l WHERE k<40) x)"
    fi = f"(SELECT id, f, phase, (1-2/(exp(least(600.0, 2*q))+1))/(1+2*q/sinh(least(600.0, 2*q))) AS fi FROM (SELECT id, f, phase, 2*pi()/now*{depth} AS q FROM l WHERE k=40))"
    total = "+".join(f"s{i}*fi*(sum(s{i}*{edge}) OVER ())/(sum(s{i}*fi*{edge}) OVER ())" for i in range(len(systems)))
    return f"WITH RECURSIVE {head}, {rec}, a AS (SELECT f, phase, sqrt(2*({total})*{step!r}) AS a FROM (SELECT *, {cols} FROM {fi})) SELECT t::DOUBLE AS t, round(sum(a*cos(2*pi()*f*t+phase)),4)+0 AS level FROM (SELECT unnest(range({seconds})) AS t) CROSS JOIN a GROUP BY 1"


@query(_series_sql([(2.0, 8.0, 3.3), (1.0, 14.0, 7.0)], 600), 4)
def bimodal_series(spark, sf):
    return st.spectral_series(spark, [(2.0, 8.0, 3.3), (1.0, 14.0, 7.0)], 600)


@query(_series_sql([(2.0, 8.0, 3.3)], 600, depth=6.0), 4)
def shallow_series(spark, sf):
    return st.spectral_series(spark, [(2.0, 8.0, 3.3)], 600, depth=6.0)


@query(_series_sql([(2.0, 8.0, 3.3), (1.0, 14.0, 7.0)], 600, depth=6.0), 4)
def shallow_bimodal_series(spark, sf):
    return st.spectral_series(spark, [(2.0, 8.0, 3.3), (1.0, 14.0, 7.0)], 600, depth=6.0)


SECTORS = {"click": (300.0, 60.0), "view": (50.0, 180.0), "error": (170.0, 310.0)}
_IN = {"click": "(d>=300 OR d<60)", "view": "(d>=50 AND d<180)", "error": "(d>=170 AND d<310)"}
_WIDE = {"click": "(d>=290 OR d<=70)", "view": "(d>=40 AND d<=190)", "error": "(d>=160 AND d<=320)"}


def _spectra(spark, sf):
    return waves(spark, sf).select("user_id", C("event_type").alias("station"), (F.floor(C("dir") / 10) * 10).cast("double").alias("d"), "hs")


@query(f"WITH {WAVES}, s AS (SELECT user_id, event_type, floor(dir/10)*10 AS d, hs FROM w) SELECT user_id, d::DOUBLE AS d, round(coalesce(sum(hs) FILTER (" + " OR ".join(f"(event_type='{k}' AND {v})" for k, v in _IN.items()) + "),0),6) AS hs FROM s GROUP BY 1,2")
def superpoint(spark, sf):
    return st.superpoint(_spectra(spark, sf), "station", "d", "hs", ["user_id"], SECTORS)


_HIT = " OR ".join(f"(event_type='{k}' AND {v})" for k, v in _WIDE.items())


@query(f"WITH {WAVES}, s AS (SELECT user_id, event_type, floor(dir/10)*10 AS d, hs FROM w) SELECT user_id, d::DOUBLE AS d, round(coalesce(sum(hs) FILTER ({_HIT}),0)/greatest(1,count(*) FILTER ({_HIT})),6) AS hs FROM s GROUP BY 1,2")
def superpoint_overlap(spark, sf):
    return st.superpoint(_spectra(spark, sf), "station", "d", "hs", ["user_id"], SECTORS, 10.0)


@query(f"WITH {WAVES} SELECT id, round(coalesce(CASE WHEN id%5>0 THEN hs END,0)+coalesce(CASE WHEN id%3>0 THEN tp END,0),6) AS hs_cal FROM w WHERE lat1>-60 AND lat1<60 AND lon1>20 AND lon1<300 AND -pressure<-900 AND (id%2)+(id%3)*0.5<1.5")
def altimeter_heights(spark, sf):
    w = waves(spark, sf).withColumns({"ku": F.when(C("id") % 5 > 0, C("hs")), "ka": F.when(C("id") % 3 > 0, C("tp")), "q1": C("id") % 2, "q2": (C("id") % 3) * 0.5, "depth": -C("pressure")})
    return st.altimeter_heights(w, "lat1", "lon1", "depth", (-60, 60, 20, 300), ["q1", "q2"], ["ku", "ka"], -900.0).select("id", "hs_cal")


@query(f"WITH {WAVES}, p AS (SELECT user_id, hs, lag(hs) OVER o AS a, lead(hs) OVER o AS b FROM w WINDOW o AS (PARTITION BY user_id ORDER BY ts, id)) SELECT user_id, round(quantile_cont(hs,0.98),6) AS ru2 FROM p WHERE hs>a AND hs>b GROUP BY 1")
def runup_heights(spark, sf):
    w = waves(spark, sf).select("user_id", F.struct("ts", "id").alias("at"), "hs")
    return st.runup_heights(w, "user_id", "at", "hs")


@query(f"WITH {WAVES} SELECT user_id, round(avg(hs),6) AS setup, round(2*sqrt(2.0::DOUBLE)*stddev_pop(hs),6) AS hrms FROM w GROUP BY 1")
def level_statistics(spark, sf):
    return st.level_statistics(waves(spark, sf), ["user_id"], "hs")


@query("SELECT p::BIGINT AS pattern, (p&1)::INT AS sea, ((p>>1)&1)::INT AS swell_1, ((p>>2)&1)::INT AS swell_2 FROM (SELECT unnest(range(1,8)) AS p)")
def presence_matrix(spark, sf):
    return st.presence_matrix(spark, ["sea", "swell_1", "swell_2"])


# --- storms
_LAT, _LON = shot("lat", "lon", "course", "arc*f")


@query(f"WITH {TRACKS}, n AS (SELECT storm, ts, lat, lon, pressure, lead(ts) OVER o AS nt, lead(lat) OVER o AS nlat, lead(lon) OVER o AS nlon, lead(pressure) OVER o AS np FROM k WINDOW o AS (PARTITION BY storm ORDER BY ts)), g AS (SELECT *, {arc('lat', 'lon', 'nlat', 'nlon')} AS arc, {bearing('lat', 'lon', 'nlat', 'nlon')} AS course, unnest(generate_series(ts::TIMESTAMP, nt::TIMESTAMP - INTERVAL 1 MICROSECOND, INTERVAL 1 HOUR)) AS moment FROM n WHERE nt>ts), x AS (SELECT *, (epoch_us(moment)-epoch_us(ts))::DOUBLE/(epoch_us(nt)-epoch_us(ts)) AS f FROM g) SELECT storm, moment AS ts, round({_LAT},4) AS lat, round({_LON},4) AS lon, round(pressure+(np-pressure)*f,4) AS pressure FROM x", 4)
def great_circle_tracks(spark, sf):
    return st.interpolate_tracks(_tracks(spark, sf), "storm", "ts", "lat", "lon", ["pressure"], 60)


@query(f"WITH {TRACKS}, h AS (SELECT id, storm, make_timestamp(floor(epoch_us(ts)/3.6e9+0.5)::BIGINT*3600000000) AS ts, lat, lon, pressure FROM k), n AS (SELECT *, (lead(epoch_us(ts)) OVER o-epoch_us(ts))/3.6e9 AS timestep, lead(lat) OVER o AS nlat, lead(lon) OVER o AS nlon FROM (SELECT * FROM h QUALIFY row_number() OVER (PARTITION BY storm, ts ORDER BY id)=1) WINDOW o AS (PARTITION BY storm ORDER BY ts)), v AS (SELECT *, radians({arc('lat', 'lon', 'nlat', 'nlon')})*6371/timestep/1.852 AS speed FROM n) SELECT id, storm, ts, round(timestep,4) AS timestep, round(speed,4) AS speed, round(avg(speed) OVER (PARTITION BY storm),4) AS storm_speed, CASE WHEN lat>0 AND lon>100 THEN 'WP' WHEN lat<0 AND lon<135 THEN 'SI' WHEN lat<0 AND lon>135 THEN 'SP' ELSE 'NA' END AS basin, CASE WHEN pressure<920 THEN 5 WHEN pressure<944 THEN 4 WHEN pressure<964 THEN 3 WHEN pressure<979 THEN 2 WHEN pressure<1000 THEN 1 ELSE 0 END AS category FROM v", 4)
def synthetic_tracks(spark, sf):
    k = se.hourly_unique(_tracks(spark, sf).select("id", "storm", "ts", "lat", "lon", "pressure"), "ts", ["storm"], ["id"])
    return st.synthetic_tracks(k, "storm", "ts", "lat", "lon", "pressure").select("id", "storm", "ts", "timestep", "speed", "storm_speed", "basin", "category")


SEG = TRACKS + ", o AS (SELECT *, row_number() OVER w0-1 AS i, count(*) OVER (PARTITION BY storm) AS n, lag(pressure) OVER w0 AS pp, lead(lat) OVER w0 AS nlat, lead(lon) OVER w0 AS nlon, lag(lat,4) OVER w0 AS wlat, lag(lon,4) OVER w0 AS wlon, first_value(lat) OVER w1 AS lat0, first_value(lon) OVER w1 AS lon0, nth_value(lat,2) OVER w1 AS la1, nth_value(lon,2) OVER w1 AS lo1, (lead(epoch_us(ts)) OVER w0-epoch_us(ts))/3.6e9 AS hours FROM k WINDOW w0 AS (PARTITION BY storm ORDER BY ts), w1 AS (PARTITION BY storm ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING))"
_SLAT, _SLON = shot("lat0", "lon0", "bk", "ar")
SEG += f", b AS (SELECT *, {bearing('lat0', 'lon0', 'la1', 'lo1')}+180 AS bk, {arc('lat0', 'lon0', 'la1', 'lo1')}*(4-i) AS ar FROM o WHERE i>=1 AND i<=n-2), c AS (SELECT *, coalesce(wlat, {_SLAT}) AS lat_w, coalesce(wlon, {_SLON}) AS lon_w FROM b)"
SEG += f", d AS (SELECT *, radians({arc('lat_w', 'lon_w', 'lat', 'lon')})*6371/24 AS v0, radians({arc('lat', 'lon', 'nlat', 'nlon')})*6371/hours AS v1, {bearing('lat_w', 'lon_w', 'lat', 'lon')} AS a0, {bearing('lat', 'lon', 'nlat', 'nlon')} AS a1 FROM c)"


@query(f"WITH {SEG} SELECT id, round(v0/1.852,3) AS vseg, round((v1-v0)/1.852,3) AS dvseg, round(pp,3) AS pseg, round(pressure-pp,3) AS dpseg, round(a0,3) AS aseg, round(sign(lat)*CASE WHEN a1-a0>180 THEN a1-a0-360 WHEN a1-a0<-180 THEN a1-a0+360 ELSE a1-a0 END,3)+0 AS daseg, round(lat_w,3) AS lat_w, round(lon_w,3) AS lon_w, round(nlat,3) AS lat_t, round(nlon,3) AS lon_t FROM d", 3)
def storm_segments(spark, sf):
    s = st.storm_segments(_tracks(spark, sf), "storm", "ts", "lat", "lon", "pressure", "hs", "tp")
    return s.select("id", "vseg", "dvseg", "pseg", "dpseg", "aseg", "daseg", "lat_w", "lon_w", "lat_t", "lon_t")


@query(f"WITH {SEG}, m AS (SELECT *, least({arc('lat', 'lon', '5.0', '130.0')}, {arc('nlat', 'nlon', '5.0', '130.0')})<6 AS hit, count(*) OVER (PARTITION BY storm) AS many FROM d), r AS (SELECT *, min(CASE WHEN hit THEN ts END) OVER (PARTITION BY storm) AS a, max(CASE WHEN hit THEN ts END) OVER (PARTITION BY storm) AS z FROM m WHERE many>1) SELECT id, storm FROM r WHERE ts BETWEEN a AND z")
def trim_segments(spark, sf):
    s = st.storm_segments(_tracks(spark, sf), "storm", "ts", "lat", "lon", "pressure", "hs", "tp")
    return st.trim_segments(s, "storm", "ts", (5.0, 130.0), 6.0).select("id", "storm")


@query(f"WITH {WAVES}, t AS (SELECT id, 10+sin(radians(dir))*4 AS xc, 5+cos(radians(dir))*4 AS yc, radians(200+tp) AS g, degrees((hs+10)/6378.135) AS step, pressure FROM w), h AS (SELECT *, unnest(range(12)) AS hour, yc+(20-xc)/sin(g)*cos(g) AS y1 FROM t) SELECT id, hour::INT AS hour, round(y1-step*cos(g)*hour,6) AS lat, round(20-step*sin(g)*hour,6) AS lon, round(pressure,6) AS pmin FROM h")
def straight_tracks(spark, sf):
    w = waves(spark, sf).select("id", C("pressure").alias("pmin"), (C("hs") + 10).alias("vmean"), C("dir").alias("delta"), (C("tp") + 200).alias("gamma"), L(10.0).alias("x0"), L(5.0).alias("y0"), L(20.0).alias("x1"), L(4.0).alias("r"))
    return st.straight_tracks(w, "id", 12)


@query("WITH h AS (SELECT user_id, date_trunc('hour', ts)::TIMESTAMP AS ts, round(max(value),4) AS v FROM events GROUP BY 1,2), e AS (SELECT user_id, min(ts) AS a, max(ts) AS b FROM h GROUP BY 1), x AS (SELECT user_id, unnest(generate_series(a, a+to_hours((epoch(b)-epoch(a))::BIGINT//3600+47), INTERVAL 1 HOUR)) AS ts FROM e) SELECT x.user_id, x.ts, h.v, 0.0::DOUBLE AS level, 0.0::DOUBLE AS tide FROM x LEFT JOIN h USING (user_id, ts)")
def extended_track(spark, sf):
    h = table(spark, sf, "events").groupBy("user_id", F.date_trunc("hour", "ts").alias("ts")).agg(F.round(F.max("value"), 4).alias("v"))
    return st.extended_track(h, "user_id", "ts", 60, 48.0)


# --- series
@query("WITH l AS (SELECT lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS prev, event_type AS cur FROM events), n AS (SELECT prev, cur, count(*) AS n FROM l WHERE prev IS NOT NULL GROUP BY 1,2), p AS (SELECT prev, cur, n::DOUBLE/(sum(n) OVER (PARTITION BY prev))::DOUBLE AS p FROM n) SELECT t.prev, " + ", ".join(f"round(coalesce(max(p) FILTER (cur='{x}'),0),6) AS p_{x}" for x in ("click", "error", "never", "view")) + " FROM (VALUES ('click'),('error'),('never'),('view')) t(prev) LEFT JOIN p USING (prev) GROUP BY 1")
def transition_table(spark, sf):
    return se.transition_table(table(spark, sf, "events"), "event_type", ["ts", "event_id"], ["click", "error", "never", "view"], ["user_id"])


@query("SELECT event_id, user_id, make_timestamp(floor(epoch_us(ts)/3.6e9+0.5)::BIGINT*3600000000) AS ts FROM events QUALIFY row_number() OVER (PARTITION BY user_id, floor(epoch_us(ts)/3.6e9+0.5) ORDER BY event_id)=1")
def hourly_unique(spark, sf):
    return se.hourly_unique(table(spark, sf, "events").select("event_id", "user_id", "ts"), "ts", ["user_id"], ["event_id"])


@query("WITH h AS (SELECT DISTINCT date_trunc('hour', ts)::TIMESTAMP AS ts FROM events) SELECT ts, ts IN (SELECT date_trunc('hour', ts)::TIMESTAMP FROM events WHERE value>150) AS max_storms FROM h")
def marked_times(spark, sf):
    e = table(spark, sf, "events")
    return se.marked_times(e.select(F.date_trunc("hour", "ts").alias("ts")).distinct(), "ts", e.filter("value > 150"), "ts")


@query("WITH d AS (SELECT o_orderdate::TIMESTAMP AS ts, max(o_totalprice)::DOUBLE AS v FROM orders GROUP BY 1), e AS (SELECT min(ts) AS a, max(ts) AS b FROM d), m AS (SELECT a+to_months(k::INT) AS moment FROM (SELECT a, unnest(range((year(b)-year(a))*12+month(b)-month(a))) AS k FROM e)) SELECT moment AS ts, round((SELECT arg_max(v, ts) FROM d WHERE d.ts=m.moment OR d.ts<date_trunc('month', m.moment)),6) AS v FROM m")
def pad_monthly(spark, sf):
    d = table(spark, sf, "orders").groupBy(C("o_orderdate").cast("timestamp").alias("ts")).agg(F.max("o_totalprice").cast("double").alias("v"))
    return se.pad_monthly(d, "ts", ["v"])


@query("WITH e AS (SELECT min(o_orderdate)::DATE AS a, max(o_orderdate)::DATE AS b FROM orders) SELECT day::DATE AS day, round(datediff('day', date_trunc('year', a)::DATE, day::DATE)/365.25::DOUBLE,6) AS fraction FROM (SELECT a, unnest(generate_series(a::TIMESTAMP, b::TIMESTAMP, INTERVAL 1 DAY)) AS day FROM e)")
def year_cycle(spark, sf):
    return se.year_cycle(table(spark, sf, "orders"), "o_orderdate")


@query("SELECT (DATE '1981-06-01' + k::INT)::DATE AS day FROM (SELECT unnest(range(365)) AS k)")
def generic_year(spark, sf):
    return se.generic_year(spark, 1981, 6)


@query("WITH k AS (SELECT user_id, epoch(date_trunc('day', ts)) AS x, max(value) AS y FROM events GROUP BY 1,2), n AS (SELECT user_id, x AS a, y AS ya, lead(x) OVER o AS b, lead(y) OVER o AS yb, first_value(x) OVER o AS x0 FROM k WINDOW o AS (PARTITION BY user_id ORDER BY x)), g AS (SELECT *, unnest(generate_series(ceil((a-x0)/50000)::BIGINT, ceil((b-x0)/50000)::BIGINT-1)) AS k FROM n WHERE b>a AND ceil((b-x0)/50000)-1>=ceil((a-x0)/50000)) SELECT user_id, k, x0+k*50000.0 AS x, round(ya+(yb-ya)*(x0+k*50000-a)/(b-a),6) AS y FROM g")
def sampled_line(spark, sf):
    d = table(spark, sf, "events").groupBy("user_id", F.unix_timestamp(F.date_trunc("day", "ts")).cast("double").alias("x")).agg(F.max("value").alias("y"))
    return se.sampled_line(d, ["user_id"], "x", "y", 50000.0)


# --- distributions
U = "((('0x' || substr(md5('1:' || k::VARCHAR), 1, 13))::BIGINT::DOUBLE+0.5)/4503599627370496.0)"


@query(f"SELECT k AS id, round(10+2/0.1*(pow(-ln({U}),-0.1)-1),6) AS x FROM (SELECT unnest(range(5000)) AS k)")
def random_gev(spark, sf):
    return ex.random_extremes(spark, 5000, "gev", 10.0, 2.0, 0.1)


@query(f"SELECT k AS id, round(0.5+1.5/0.2*(pow(1-{U},-0.2)-1),6) AS x FROM (SELECT unnest(range(5000)) AS k)")
def random_gpd(spark, sf):
    return ex.random_extremes(spark, 5000, "gpd", 0.5, 1.5, 0.2)


@query("SELECT event_type, count(*) AS n, round(-sum(-(1+1/0.1)*ln(1+0.1*(value-40)/30)-pow(1+0.1*(value-40)/30,-10)-ln(30.0::DOUBLE)),3) AS nll FROM events GROUP BY 1", 3)
def gev_nll(spark, sf):
    return ex.negative_log_likelihood(table(spark, sf, "events"), "value", "gev", 40.0, 30.0, 0.1, ["event_type"])


@query("SELECT event_type, count(*) AS n, round(sum((1+1/0.2)*ln(1+0.2*value/30)+ln(30.0::DOUBLE)),3) AS nll FROM events GROUP BY 1", 3)
def gpd_nll(spark, sf):
    return ex.negative_log_likelihood(table(spark, sf, "events"), "value", "gpd", 0.0, 30.0, 0.2, ["event_type"])


@query("WITH s AS (SELECT count(*) AS n, stddev_samp(value) AS sd, (quantile_cont(value,0.75)-quantile_cont(value,0.25))/1.349 AS q FROM events), b AS (SELECT 1.0592238410488122*least(sd,q)*pow(n,-0.2) AS h FROM s), k AS (SELECT unnest(range(0,310,10))::DOUBLE AS x), z AS (SELECT x, (x-value)/h AS z FROM events, b, k), t AS (SELECT x, z, 1/(1+0.2316419*abs(z)) AS t FROM z), p AS (SELECT x, z, exp(-z*z/2)/sqrt(2*pi())*t*(0.319381530+t*(-0.356563782+t*(1.781477937+t*(-1.821255978+t*1.330274429)))) AS tail FROM t) SELECT x, round(avg(CASE WHEN z>=0 THEN 1-tail ELSE tail END),5) AS cdf FROM p GROUP BY 1", 5)
def kernel_cdf(spark, sf):
    return ex.kernel_cdf(table(spark, sf, "events"), "value", [float(x) for x in range(0, 310, 10)])


per_wave("normal_round_trip", {"p": lambda: normal.normal_cdf(normal.normal_quantile((C("id") % 997 + 1) / 1000.0))}, "round((id%997+1)/1000.0::DOUBLE,5) AS p", 5)


@query("WITH c AS (SELECT user_id%20 AS label, avg(value) AS a, avg(event_id%97)::DOUBLE AS b, max(value) AS v FROM events GROUP BY 1), p AS (SELECT x.label, x.v AS own, y.v, y.label AS o, sqrt((x.a-y.a)*(x.a-y.a)+(x.b-y.b)*(x.b-y.b)) AS d FROM c x JOIN c y ON x.label<>y.label) SELECT label, round(0.5*(max(own)+sum(v/d)/sum(1/d)),4) AS v FROM (SELECT * FROM p QUALIFY row_number() OVER (PARTITION BY label ORDER BY d, o)<=4) GROUP BY 1", 4)
def smoothed_shape(spark, sf):
    c = table(spark, sf, "events").groupBy((C("user_id") % 20).alias("label")).agg(F.avg("value").alias("a"), F.avg(C("event_id") % 97).alias("b"), F.max("value").alias("v"))
    return ex.smoothed_by_neighbours(c, "label", ["a", "b"], "v")


# --- fields, sets and joins
@query("WITH d AS (SELECT (epoch(date_trunc('day', ts))/86400)::BIGINT AS step, avg(value) AS m, count(*)::DOUBLE AS n, max(value) AS v FROM events GROUP BY 1), t AS (SELECT step, 10.001::DOUBLE+step%7*0.11 AS lo, 20.001::DOUBLE+step%5*0.13 AS la, 10.0::DOUBLE AS vfx, 5.0::DOUBLE AS vfy, 960-m/10 AS p0, 1010.0::DOUBLE AS pn, 60+v/10 AS vmax, 25.0::DOUBLE AS rmw FROM d), g AS (SELECT 9+a*0.07::DOUBLE AS lon, 19+b*0.07::DOUBLE AS lat FROM (SELECT unnest(range(40)) AS a) CROSS JOIN (SELECT unnest(range(40)) AS b)), j AS (SELECT *, radians(" + arc("lat", "lon", "la", "lo") + ")*6378135.0 AS r, atan2(radians(lat-la), radians(lon-lo)) AS theta, 2*(2*pi()/86184.2)*sin(radians(la)) AS spin, (vmax-sqrt(vfx*vfx+vfy*vfy))/0.9 AS kt FROM g CROSS JOIN t), b AS (SELECT *, kt*0.52 AS vm, least(greatest(1.15*2.718281828459045*kt*0.52*kt*0.52/greatest((pn-p0)*100,100),1.0),2.5) AS b FROM j), q AS (SELECT *, pow(rmw*1852/r, b) AS q FROM b), v AS (SELECT *, sqrt(q*exp(1-q)*vm*vm+r*r*spin*spin/4)-r*spin/2 AS vg, p0+(pn-p0)*exp(-q) AS pr FROM q), s AS (SELECT *, CASE WHEN lag(pr) OVER y IS NULL THEN lead(pr) OVER y-pr WHEN lead(pr) OVER y IS NULL THEN pr-lag(pr) OVER y ELSE (lead(pr) OVER y-lag(pr) OVER y)/2 END AS py, CASE WHEN lag(pr) OVER x IS NULL THEN lead(pr) OVER x-pr WHEN lead(pr) OVER x IS NULL THEN pr-lag(pr) OVER x ELSE (lead(pr) OVER x-lag(pr) OVER x)/2 END AS px FROM v WINDOW y AS (PARTITION BY step, lon ORDER BY lat), x AS (PARTITION BY step, lat ORDER BY lon)) SELECT step, round(lat,3) AS lat, round(lon,3) AS lon, round(sqrt(pow(-vg*0.9*sin(theta)*0.93+abs(vg)/kt*vfx,2)+pow(vg*0.9*cos(theta)*0.93+abs(vg)/kt*vfy,2)),3) AS wind, round(fmod(270-degrees(atan2(py,px)+pi()/2)+720,360),3) AS direction, round(pr*100,3) AS pressure FROM s", 3)
def vortex_field(spark, sf):
    d = table(spark, sf, "events").groupBy((F.unix_timestamp(F.date_trunc("day", "ts")) / 86400).cast("long").alias("step")).agg(F.avg("value").alias("m"), F.max("value").alias("v"))
    track = d.select("step", (10.001 + C("step") % 7 * 0.11).alias("lon"), (20.001 + C("step") % 5 * 0.13).alias("lat"), L(10.0).alias("vfx"), L(5.0).alias("vfy"), (960 - C("m") / 10).alias("p0"), L(1010.0).alias("pn"), (60 + C("v") / 10).alias("vmax"), L(25.0).alias("rmw"))
    grid = spark.range(1600).select((9 + F.floor(C("id") / 40) * 0.07).alias("lon"), (19 + C("id") % 40 * 0.07).alias("lat"))
    return md.vortex_field(track, grid)


@query(f"WITH {WAVES}, r AS (SELECT id AS rid, hs/350 AS hs, tp/21 AS tp, dir/360 AS dir FROM w WHERE id%3=0), q AS (SELECT id, hs/350+0.001 AS hs, (tp+0.013)/21 AS tp, dir/360 AS dir FROM w WHERE id%3=1), d AS (SELECT id, rid, (q.hs-r.hs)*(q.hs-r.hs)+(q.tp-r.tp)*(q.tp-r.tp)+pow(least(abs(q.dir-r.dir),1-abs(q.dir-r.dir)),2) AS d FROM q CROSS JOIN r) SELECT id, rid, round(sqrt(d),6) AS distance FROM d QUALIFY row_number() OVER (PARTITION BY id ORDER BY d, rid)=1")
def nearest_of_many(spark, sf):
    """A third of the sea states against another third, by leaves."""
    w = waves(spark, sf)
    q = w.filter("id % 3 = 1").select("id", (C("hs") / 350 + 0.001).alias("hs"), ((C("tp") + 0.013) / 21).alias("tp"), (C("dir") / 360).alias("dir"))
    r = w.filter("id % 3 = 0").select(C("id").alias("rid"), (C("hs") / 350).alias("hs"), (C("tp") / 21).alias("tp"), (C("dir") / 360).alias("dir"))
    return jn.nearest_by_leaves(q, r, "id", "rid", ["hs", "tp", "dir"], ["dir"])


@query("SELECT min(a)::DATE AS start, max(b)::DATE AS \"end\" FROM (SELECT min(o_orderdate) AS a, max(o_orderdate) AS b FROM orders UNION ALL SELECT min(l_shipdate), max(l_shipdate) FROM lineitem)")
def further_dates(spark, sf):
    o, li = table(spark, sf, "orders").select(C("o_orderdate").alias("d")), table(spark, sf, "lineitem").select(C("l_shipdate").alias("d"))
    return fr.common_dates([o, li], "d", further=True).select(C("start").cast("date"), C("end").cast("date"))


# --- models
@query(f"WITH {WAVES}, m AS (SELECT avg(hs) AS a, avg(tp) AS b, avg(pressure) AS y, var_pop(hs) AS saa, var_pop(tp) AS sbb, covar_pop(hs,tp) AS sab, covar_pop(hs,pressure) AS say, covar_pop(tp,pressure) AS sby FROM w), c AS (SELECT *, (say*sbb-sby*sab)/(saa*sbb-sab*sab) AS b1, (sby*saa-say*sab)/(saa*sbb-sab*sab) AS b2 FROM m) SELECT id, round(hs*0.4,4) AS hs, round(tp*0.4,4) AS tp, round(0.6*(y+b1*(hs-a)+b2*(tp-b)),4) AS pressure FROM w, c", 4)
def guided_by_regression(spark, sf):
    return fr.guided_by_regression(waves(spark, sf), "id", ["hs", "tp"], ["pressure"], [0.6])


def _annual(spark, sf):
    """Historical and simulated series: order prices by year, and lines' prices by year and line number."""
    hist = table(spark, sf, "orders").groupBy(C("o_orderdate").cast("timestamp").alias("t")).agg((F.max("o_totalprice").cast("double") / 10000).alias("v"))
    sim = table(spark, sf, "lineitem").groupBy((C("l_linenumber") % 4).alias("sim"), C("l_shipdate").cast("timestamp").alias("t")).agg((F.max("l_extendedprice").cast("double") / 3000).alias("v"))
    return hist, sim


@query()
def extreme_correction(spark, sf):
    hist, sim = _annual(spark, sf)
    return ex.ExtremeCorrection("v", "t", "am").fit(hist).transform(sim, "sim", siglevel=1.0)


@query()
def extreme_correction_pot(spark, sf):
    hist, sim = _annual(spark, sf)
    return ex.ExtremeCorrection("v", "t", "pot", threshold=35.0).fit(hist).transform(sim, "sim", siglevel=1.0)


@query("WITH p AS (SELECT *, row_number() OVER o AS i, greatest(value-50,0) AS x, lag(greatest(value-50,0)) OVER o AS a, lead(greatest(value-50,0)) OVER o AS b FROM events WINDOW o AS (PARTITION BY user_id ORDER BY ts, event_id)), k AS (SELECT * FROM p WHERE x>a AND x>=b) SELECT event_id, round(value,6) AS value FROM k WHERE NOT EXISTS (SELECT 1 FROM k o WHERE o.user_id=k.user_id AND o.i<>k.i AND abs(o.i-k.i)<=2 AND (o.x>k.x OR (o.x=k.x AND o.i<k.i)))")
def peak_rows(spark, sf):
    return ex.peak_rows(table(spark, sf, "events"), "value", ["ts", "event_id"], ["user_id"], 50.0).select("event_id", "value")


@query()
def distribution_fits(spark, sf):
    m = ex.fixed_block_maxima(table(spark, sf, "events"), "value", ["ts", "event_id"], ["event_type"], 20)
    return ex.distribution_fits(m, "value", "event_type", "gev", {2: 0.0})


@query()
def poisson_return_levels(spark, sf):
    p = ex.peak_rows(table(spark, sf, "events"), "value", ["ts", "event_id"], ["user_id"], 100.0)
    return ex.poisson_return_levels(p, "value", 100.0, 12.0, [10.0, 100.0])


@query()
def directional_clusters(spark, sf):
    return md.directional_clusters(waves(spark, sf), "id", ["hs", "tp", "dir"], ["dir"], 6)[0].select("id", "label")


def _field(spark, sf):
    """Mean quantity and price by month, on a grid of suppliers and parts."""
    li = table(spark, sf, "lineitem")
    return li.groupBy(F.date_trunc("month", "l_shipdate").alias("month"), (C("l_suppkey") % 3).alias("y"), (C("l_partkey") % 4).alias("x")).agg(F.avg(C("l_quantity").cast("double")).alias("q"), F.avg(C("l_extendedprice").cast("double") / 1000).alias("p"))


def _components(spark, sf, k):
    names, rows = fl.stacked(_field(spark, sf), "month", ["y", "x"], ["q", "p"], {"q": [3]}, {"q": 25.0, "q_3": 25.0, "p": "forward"}, {"q": 0.5, "p": 0.5})
    return fl.fit_components(names, rows, k), rows


@query()
def field_components(spark, sf):
    model, _ = _components(spark, sf, 5)
    return fl.eof_table(model, spark, ["y", "x"], {"y": "bigint", "x": "bigint"})


@query()
def field_scores(spark, sf):
    model, rows = _components(spark, sf, 0.9)
    return fl.component_scores(model, rows, "month")


_CELL = "SELECT date_trunc('month', l_shipdate)::TIMESTAMP AS month, l_suppkey%3 AS y, l_partkey%4 AS x, avg(l_quantity::DOUBLE) AS q, avg(l_extendedprice::DOUBLE/1000) AS p FROM lineitem GROUP BY 1,2,3"


@query(f"WITH c AS ({_CELL}), l AS (SELECT *, lag(q,3) OVER (PARTITION BY y, x ORDER BY month) AS q_3 FROM c), m AS (SELECT month, count(*) AS k FROM l GROUP BY 1 HAVING count(*)=12) SELECT month, variable, y, x, round(value*pi(),4) AS value FROM (SELECT month, y, x, 'q' AS variable, q AS value FROM l UNION ALL SELECT month, y, x, 'p', p FROM l UNION ALL SELECT month, y, x, 'q_3', coalesce(q_3,25) FROM l) JOIN m USING (month)", 4)
def field_round_trip(spark, sf):
    """All components give every cell back."""
    model, rows = _components(spark, sf, 36)
    return fl.from_scores(model, fl.component_scores(model, rows, "month"), "month", ["y", "x"], {"y": "bigint", "x": "bigint"}).withColumn("month", C("month").cast("timestamp")).withColumn("value", C("value") * math.pi)


# --- parameters that change with time
_PARAMS = lambda: ({"base": 40.0, "harmonics": [5.0, -2.0], "trend": 0.5, "covariates": [(C("tp"), 0.1)]}, {"base": 3.0, "harmonics": [0.2, 0.1]}, {"base": 0.1, "harmonics": [0.02, 0.0]})
_NS = f"WITH {WAVES}, t AS (SELECT id, hs, tp, dayofyear(ts)/366.0::DOUBLE AS t FROM w), p AS (SELECT id, hs, 40+0.5*t+5*cos(2*pi()*t)-2*sin(2*pi()*t)+0.1*tp AS m, exp(3+0.2*cos(2*pi()*t)+0.1*sin(2*pi()*t)) AS s, 0.1+0.02*cos(2*pi()*t) AS x FROM t), e AS (SELECT *, CASE WHEN 1+x*(hs-m)/s>0 THEN pow(1+x*(hs-m)/s, -1/x) END AS e FROM p)"


def _moving(spark, sf):
    return waves(spark, sf).withColumn("p", ns.gev_parameters(se.year_fraction(C("ts")), *_PARAMS()))


@query(f"{_NS} SELECT id, round(m,4) AS loc, round(s,4) AS scale, round(x,4) AS xi, round(coalesce(exp(-e),0),4) AS cdf, round(m+s/x*(pow(-ln((id%99+1)/100.0::DOUBLE),-x)-1),4) AS q, round((x+1)*ln(e)-e-ln(s),4) AS log_likelihood, round(-ln(e),4) AS z FROM e", 4)
def nonstationary_gev(spark, sf):
    w, p = _moving(spark, sf), C("p")
    return w.select("id", p["loc"].alias("loc"), p["scale"].alias("scale"), p["xi"].alias("xi"), ns.gev_cdf_at(C("hs"), p).alias("cdf"), ns.gev_quantile_at((C("id") % 99 + 1) / 100, p).alias("q"), ns.gev_log_likelihood_at(C("hs"), p).alias("log_likelihood"), ns.standardized_at(C("hs"), p).alias("z"))


@query(f"{_NS}, v AS (SELECT unnest([150.0, 200.0, 250.0]) AS v), r AS (SELECT v, avg(pow(1+x*(v-m)/s, -1/x)) AS r FROM p, v GROUP BY 1) SELECT v::DOUBLE AS v, round(v,2)::DOUBLE AS back FROM r", 2)
def aggregate_quantiles(spark, sf):
    """A value's chance over the period, and the value that has this chance."""
    w = _moving(spark, sf)
    rate = w.agg(*[F.avg(ns._exceedance(L(v), C("p"))).alias(str(int(v))) for v in (150.0, 200.0, 250.0)]).first()
    return spark.createDataFrame([(v, ns.aggregate_quantile(w, C("p"), math.exp(-rate[str(int(v))]))) for v in (150.0, 200.0, 250.0)], "v double, back double")


@query(digits=3)
def radial_model(spark, sf):
    w = waves(spark, sf).withColumn("y", 2 * C("hs") + 3 * C("tp")).withColumn("back", F.pmod(C("dir") + 180, L(360.0)))
    chosen = md.max_dissimilarity(fr.normalize(w.select("id", "hs", "tp"), ["hs", "tp"]), "id", ["hs", "tp"], 30)
    model = md.RadialModel(["hs", "tp", "dir"], ["y", "back"], ["dir"], ["back"]).fit(w.join(F.broadcast(chosen.select("id")), "id"))
    return model.predict(w, "id")


@query("SELECT t::INT AS coord3, a::INT AS i, b::INT AS j, round(sin(x)*cos(y)*sin(t)+sin(2*x)*cos(2*y)*sin(2*t)+sin(3*x)*cos(3*y)*sin(3*t),6)+0 AS X, round(-sin(sin(x)*cos(y)*sin(t)+sin(2*x)*cos(2*y)*sin(2*t)+sin(3*x)*cos(3*y)*sin(3*t)),6)+0 AS Y FROM (SELECT a, b, t, radians(-100+a*200/19.0::DOUBLE) AS x, radians(-100+b*200/19.0::DOUBLE) AS y FROM (SELECT unnest(range(20)) AS a) CROSS JOIN (SELECT unnest(range(20)) AS b) CROSS JOIN (SELECT unnest(range(1,50)) AS t))")
def sample_field(spark, sf):
    return fl.sample_field(spark)


@query(f"WITH {WAVES}, k AS (SELECT floor(hs/60)::INT AS i, floor(tp/6)::INT AS j, event_type FROM w WHERE hs<240) SELECT i, j, event_type, count(*) AS n, round(count(*)::DOUBLE/(sum(count(*)) OVER (PARTITION BY i, j))::DOUBLE,6) AS probability FROM k GROUP BY 1,2,3")
def label_probabilities(spark, sf):
    """How the winners of each cell of a map are labelled."""
    w = waves(spark, sf).filter("hs < 240").select(F.floor(C("hs") / 60).cast("int").alias("i"), F.floor(C("tp") / 6).cast("int").alias("j"), "event_type")
    return fl.label_probabilities(w, ["i", "j"], "event_type")


@query("WITH m AS (SELECT (c_custkey%4)::INT AS i, (c_nationkey%5)::INT AS j, avg(c_acctbal::DOUBLE) AS a FROM customer GROUP BY 1,2), d AS (SELECT x.i, x.j, sum(abs(x.a-y.a)) AS d FROM m x JOIN m y ON abs(x.i-y.i)<=1 AND abs(x.j-y.j)<=1 AND (x.i<>y.i OR x.j<>y.j) GROUP BY 1,2) SELECT i, j, round(d/max(d) OVER (),6) AS distance FROM d")
def distance_map(spark, sf):
    m = table(spark, sf, "customer").groupBy((C("c_custkey") % 4).cast("int").alias("i"), (C("c_nationkey") % 5).cast("int").alias("j")).agg(F.avg(C("c_acctbal").cast("double")).alias("a"))
    return fl.distance_map(m, "i", "j", ["a"])
