"""Registered queries of the library's operators, each with its SQL where SQL can express it."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from fathomlake.functions import angles, extremes as ev, geo, waves as wv
from fathomlake.operators import extremes as ex
from fathomlake.operators import frames as fr
from fathomlake.operators import joins as jn
from fathomlake.operators import models as md
from fathomlake.operators import series as se
from fathomlake.operators import storms as st
from fathomlake.sources import files
from fathomlake.plans.inputs import WAVES, rounded, table, waves
from fathomlake.plans.registry import ORACLES, QUERIES, per_wave, query

ENTRY = "event_type_probabilities"
C = F.col
HPOS = "(sin(radians(lat2-lat1)/2)*sin(radians(lat2-lat1)/2) + cos(radians(lat1))*cos(radians(lat2))*sin(radians(lon2-lon1)/2)*sin(radians(lon2-lon1)/2))"
TYPES = ["click", "error", "purchase", "signup", "view"]


# --- scaling and cleaning
@query("SELECT l_orderkey, l_linenumber, round((l_quantity-min(l_quantity) OVER ())/(max(l_quantity) OVER ()-min(l_quantity) OVER ()),6)::DOUBLE AS l_quantity, round(l_extendedprice::DOUBLE/262144,6) AS l_extendedprice FROM lineitem")
def normalize(spark, sf):
    rows = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", C("l_quantity").cast("double"), C("l_extendedprice").cast("double"))
    return fr.normalize(rows, ["l_quantity", "l_extendedprice"], {"l_extendedprice": (0, 262144)})


@query("SELECT event_id, round(value*90+10,6) AS value FROM events")
def denormalize(spark, sf):
    return fr.denormalize(table(spark, sf, "events").select("event_id", "value"), {"value": (10, 100)})


@query("SELECT event_id, round((value-avg(value) OVER ())/stddev_pop(value) OVER (),6) AS value FROM events")
def standardize(spark, sf):
    return fr.standardize(table(spark, sf, "events").select("event_id", "value"), ["value"])


@query("SELECT event_id, round(value*2.5+7,6) AS value FROM events")
def destandardize(spark, sf):
    return fr.destandardize(table(spark, sf, "events").select("event_id", "value"), {"value": (7, 2.5)})


@query("SELECT 'hs' AS \"column\", count(*) FILTER (value IS NULL OR value>100)::BIGINT AS bad FROM events UNION ALL SELECT 'event_id', 0")
def check_nulls(spark, sf):
    rows = table(spark, sf, "events").select("event_id", F.when(C("value") <= 100, C("value")).alias("hs"))
    return fr.check_nulls(rows, ["hs", "event_id"])


@query("SELECT event_id, CASE WHEN value<=100 THEN round(value,6) ELSE -1 END::DOUBLE AS hs FROM events")
def fill_bad_values(spark, sf):
    return fr.fill_bad(table(spark, sf, "events").select("event_id", F.when(C("value") <= 100, C("value")).alias("hs")), ["hs"], -1)


# --- row expressions
per_wave("uv_components", {"u": lambda: angles.uv(C("dir"))["u"], "v": lambda: angles.uv(C("dir"))["v"]}, "round(sin(radians(dir)),6)+0 AS u, round(cos(radians(dir)),6)+0 AS v")
per_wave("degrees_from_uv", {"deg": lambda: angles.degrees_from_uv(C("lat1"), C("lat2") + 0.5)}, "round(fmod(degrees(atan2(lat1, lat2+0.5))+360, 360),6) AS deg")
per_wave("nautical_to_mathematical", {"deg": lambda: angles.turn_convention(C("dir"))}, "round(fmod(450-dir,360),6) AS deg")
per_wave("circular_gap", {"gap": lambda: angles.circular_gap(C("lon1"), C("lon2"))}, "round(least(abs(lon1-lon2), 360-abs(lon1-lon2)),6) AS gap")
per_wave("direction_sector", {"sector": lambda: angles.direction_sector(C("dir"))}, "floor(dir/22.5)::INT AS sector")
per_wave("geodesic_distance", {"arc": lambda: geo.arc_distance(C("lat1"), C("lon1"), C("lat2"), C("lon2"))}, f"round(degrees(2*atan2(sqrt(least(1.0,greatest(0.0,{HPOS}))), sqrt(1-least(1.0,greatest(0.0,{HPOS}))))),6) AS arc")
per_wave("geodesic_azimuth", {"azimuth": lambda: geo.azimuth(C("lat1"), C("lon1"), C("lat2"), C("lon2"))}, "round(fmod(degrees(atan2(cos(radians(lat2))*sin(radians(lon2-lon1)), cos(radians(lat1))*sin(radians(lat2))-sin(radians(lat1))*cos(radians(lat2))*cos(radians(lon2-lon1))))+360,360),6) AS azimuth")
per_wave("planar_distance", {"d": lambda: F.hypot(C("lon1") - C("lon2"), C("lat1") - C("lat2"))}, "round(sqrt((lon1-lon2)*(lon1-lon2)+(lat1-lat2)*(lat1-lat2)),6) AS d")
per_wave("shoot", {"lat": lambda: geo.shoot(C("lat1"), C("lon1"), C("dir"), C("tp"))["lat"]}, "round(degrees(asin(least(1.0,greatest(-1.0,sin(radians(lat1))*cos(radians(tp))+cos(radians(lat1))*sin(radians(tp))*cos(radians(dir)))))),6) AS lat")
per_wave("map_tile", {"x": lambda: geo.tile(C("lat1"), C("lon1") - 180, 8)["x"], "y": lambda: geo.tile(C("lat1"), C("lon1") - 180, 8)["y"]}, "floor(lon1/360*256)::BIGINT AS x, floor((1-ln(tan(radians(lat1))+1/cos(radians(lat1)))/pi())/2*256)::BIGINT AS y")
per_wave("web_mercator", {"x": lambda: geo.web_mercator(C("lon1") - 180, C("lat1"))["x"], "y": lambda: geo.web_mercator(C("lon1") - 180, C("lat1"))["y"]}, "round(6378137.0::DOUBLE*radians(lon1-180),6) AS x, round(6378137.0::DOUBLE*ln(tan(pi()/4+radians(lat1)/2)),6)+0 AS y")
per_wave("map_zoom", {"zoom": lambda: geo.zoom_for(C("lon1"), C("lon1") + C("tp"))}, "round(log2(360.0*1024/256/abs(lon1+tp-lon1)))::INT AS zoom")
per_wave("storm_category", {"cat": lambda: geo.storm_category(C("pressure")), "cat_closed": lambda: geo.storm_category(C("pressure"), True)}, ", ".join(f"CASE WHEN pressure{o}920 THEN 5 WHEN pressure{o}944 THEN 4 WHEN pressure{o}964 THEN 3 WHEN pressure{o}979 THEN 2 WHEN pressure{o}1000 THEN 1 ELSE 0 END AS {n}" for o, n in (("<", "cat"), ("<=", "cat_closed"))))
per_wave("radius_of_max_wind", {"rmw": lambda: geo.radius_of_max_wind(C("hs"), C("tp"), C("lat1"))}, "round(218.3784-1.2014*((hs-tp)/0.9)+pow((hs-tp)/0.9/10.9844,2)-pow((hs-tp)/0.9/35.3052,3)-145.509*cos(radians(lat1)),6) AS rmw")
per_wave("inverse_barometer", {"ib": lambda: wv.inverse_barometer(C("pressure") * 100)}, "round((101325.0-pressure*100)/10000.0,6)::DOUBLE AS ib")
per_wave("drag_coefficient", {"cd": lambda: F.round(wv.drag_coefficient(C("hs")) * 1000, 5)}, "round((CASE WHEN hs<=0 THEN 0.00063 WHEN hs<=30 THEN 0.00063+(0.00723-0.00063)*hs/30 ELSE 0.00723 END)::DOUBLE*1000,5) AS cd")
per_wave("extreme_level", {"awl": lambda: wv.extreme_level(C("hs"), C("tp")), "twl": lambda: wv.total_level(wv.extreme_level(C("hs"), C("tp")), F.lit(0.1), F.lit(0.5), F.lit(0.02))}, "round(0.043*sqrt(hs*1.56*tp/1.25*tp/1.25),6) AS awl, round(0.043*sqrt(hs*1.56*tp/1.25*tp/1.25)+0.62,6) AS twl")
per_wave("mjo_phase", {"phase": lambda: wv.mjo_phase(C("lat1") / 30, C("lat2") / 30), "category": lambda: wv.mjo_category(C("lat1") / 30, C("lat2") / 30, wv.mjo_phase(C("lat1") / 30, C("lat2") / 30)).cast("int")},
         "CASE WHEN d>0 THEN (ceil(d/45)::INT+3)%8+1 END AS phase, CASE WHEN d>0 THEN CASE WHEN r>2.5 THEN (ceil(d/45)::INT+3)%8+1 WHEN r>1.5 THEN (ceil(d/45)::INT+3)%8+9 WHEN r>1 THEN (ceil(d/45)::INT+3)%8+17 ELSE 25 END END AS category")
ORACLES["mjo_phase"] = ORACLES["mjo_phase"].replace("FROM w", "FROM (SELECT *, fmod(degrees(atan2(lat2/30, lat1/30))+360,360) AS d, sqrt(lat1*lat1/900+lat2*lat2/900) AS r FROM w)")
per_wave("jonswap_density", {"s": lambda: F.round(wv.jonswap(F.lit(0.1), C("hs") / 50, C("tp")), 5)}, f"round({0.06238 / (0.23 + 0.0336 * 3.3 - 0.185 / 5.2) * (1.094 - 0.01915 * math.log(3.3))!r}::DOUBLE*(hs/50)*(hs/50)*pow(tp,-4)*pow(0.1::DOUBLE,-5)*exp(-1.25*pow(tp*0.1,-4))*pow(3.3::DOUBLE,exp(-(tp*0.1-1)*(tp*0.1-1)/(2*pow(CASE WHEN 0.1*tp<=1 THEN 0.07 ELSE 0.09 END,2)))),5) AS s")
per_wave("dean_profile", {"depth": lambda: wv.dean_depth(C("hs"), 0.1), "linear": lambda: wv.linear_depth(C("hs"), 10, 0.05, 50, 2), "reef": lambda: wv.reef_depth(C("hs"), 6, 0.2, 0.1, 60, 20, 3, 0.5)},
         "round(0.1*pow(hs,2.0/3.0),6) AS depth, round(greatest(-2.0, CASE WHEN hs<=50 THEN 10 ELSE 10-(hs-50)*0.05 END),6)::DOUBLE AS linear, round(CASE WHEN hs<=20 THEN 6 WHEN hs<=52.5 THEN 6-(hs-20)*0.2 WHEN hs<=112.5 THEN -0.5 ELSE greatest(-3.0, -0.5-(hs-112.5)*0.1) END,6)::DOUBLE AS reef")
per_wave("radial_kernels", {k: (lambda k=k: wv.radial_kernel(C("hs") / 100, 0.5, k)) for k in ("gaussian", "multiquadratic", "inverse", "cubic", "thin_plate")},
         "round(exp(-(hs/50)*(hs/50)/2),6) AS gaussian, round(sqrt(1+(hs/50)*(hs/50)),6) AS multiquadratic, round(1/sqrt(1+(hs/50)*(hs/50)),6) AS inverse, round(pow(hs/100,3),6) AS cubic, round(pow(hs/100,2)*ln(hs/50),6)+0 AS thin_plate")
per_wave("point_in_polygon", {"inside": lambda: geo.in_polygon(C("lon1"), C("lat1"), [(10, -50), (200, -60), (150, 70), (40, 40)]), "in_triangle": lambda: geo.in_triangle(C("lon1"), C("lat1"), [(0, 0), (300, 0), (150, 80)])},
         "(" + "+".join(f"CASE WHEN (({y1}>lat1)<>({y2}>lat1)) AND lon1<({x2}-({x1}))*(lat1-({y1}))/({y2}-({y1}))::DOUBLE+{x1} THEN 1 ELSE 0 END" for (x1, y1), (x2, y2) in zip([(10, -50), (200, -60), (150, 70), (40, 40)], [(200, -60), (150, 70), (40, 40), (10, -50)])) + ")%2=1 AS inside, (lat1>=0 AND lat1<=80*lon1/150 AND lat1<=80*(300-lon1)/150) AS in_triangle")
per_wave("circumcenter", {"x": lambda: geo.circumcenter(F.lit(0.0), F.lit(0.0), C("tp"), F.lit(0.0), F.lit(0.0), C("tp") + 1)["x"], "y": lambda: geo.circumcenter(F.lit(0.0), F.lit(0.0), C("tp"), F.lit(0.0), F.lit(0.0), C("tp") + 1)["y"]}, "round(tp/2,6) AS x, round((tp+1)/2,6) AS y")
per_wave("gev_functions", {"cdf": lambda: ev.gev_cdf(C("hs"), 40, 30, 0.1), "pdf": lambda: ev.gev_pdf(C("hs"), 40, 30, 0.1), "sf": lambda: ev.gev_sf(C("hs"), 40, 30, 0.1), "gumbel": lambda: ev.gev_cdf(C("hs"), 40, 30, 0), "q": lambda: ev.gev_quantile((C("id") % 99 + 1) / 100, 40, 30, 0.1)},
         "round(exp(-pow(1+0.1*(hs-40)/30,-10)),6) AS cdf, round(pow(1+0.1*(hs-40)/30,-11)*exp(-pow(1+0.1*(hs-40)/30,-10))/30,6) AS pdf, round(1-exp(-pow(1+0.1*(hs-40)/30,-10)),6) AS sf, round(exp(-exp(-(hs-40)/30)),6) AS gumbel, round(40+300*(pow(-ln((id%99+1)/100.0::DOUBLE),-0.1)-1),6) AS q")
per_wave("gpd_functions", {"cdf": lambda: ev.gpd_cdf(C("hs"), 20, 30, 0.2), "pdf": lambda: ev.gpd_pdf(C("hs"), 20, 30, 0.2), "sf": lambda: ev.gpd_sf(C("hs"), 20, 30, 0.2), "q": lambda: ev.gpd_quantile((C("id") % 99 + 1) / 100, 20, 30, 0.2)},
         "round(CASE WHEN hs<20 THEN 0 ELSE 1-pow(1+0.2*(hs-20)/30,-5) END,6)::DOUBLE AS cdf, round(CASE WHEN hs<20 THEN 0 ELSE pow(1+0.2*(hs-20)/30,-6)/30 END,6)::DOUBLE AS pdf, round(CASE WHEN hs<20 THEN 1 ELSE pow(1+0.2*(hs-20)/30,-5) END,6)::DOUBLE AS sf, round(20+150*(pow(1-(id%99+1)/100.0::DOUBLE,-0.2)-1),6) AS q")
per_wave("gpd_poisson_functions", {"cdf": lambda: ev.gpd_poisson_cdf(C("hs"), 20, 30, 0.2, 4), "pdf": lambda: ev.gpd_poisson_pdf(C("hs"), 20, 30, 0.2, 4), "q": lambda: ev.gpd_poisson_quantile((C("id") % 99 + 1) / 100, 20, 30, 0.2, 4)},
         "round(exp(-4*CASE WHEN hs<20 THEN 1 ELSE pow(1+0.2*(hs-20)/30,-5) END),6) AS cdf, round(CASE WHEN hs<20 THEN 0 ELSE 4*pow(1+0.2*(hs-20)/30,-6)/30*exp(-4*pow(1+0.2*(hs-20)/30,-5)) END,6)::DOUBLE AS pdf, round(20+150*(pow(-ln((id%99+1)/100.0::DOUBLE)/4,-0.2)-1),6) AS q")


@query()
def utm_round_trip(spark, sf):
    w = waves(spark, sf).filter(F.abs("lat1") < 80).withColumn("lon", C("tp") / 4)
    u = w.withColumn("u", geo.utm(C("lon"), C("lat1"), 31))
    return u.select("id", C("u.easting"), C("u.northing"), geo.from_utm(C("u.easting"), C("u.northing"), 31)["lat"].alias("lat"))


@query()
def wave_dispersion(spark, sf):
    w = waves(spark, sf).withColumn("length", wv.wavelength(C("tp"), C("hs")))
    return w.select("id", "length", wv.celerity(C("length"), C("hs")).alias("celerity"))


@query()
def snell_propagation(spark, sf):
    return waves(spark, sf).select("id", wv.snell(C("tp"), C("hs") / 50, C("dir"), F.lit(50.0), F.lit(10.0), F.lit(270.0)).alias("s")).select("id", "s.height", "s.direction")


@query()
def box_entry(spark, sf):
    return waves(spark, sf).select("id", geo.box_entry(C("dir") / 4, C("lon1"), 0, 0, 1, -5, 5, -5, 5).alias("p")).select("id", "p.x", "p.y")


# --- aggregates
@query("SELECT l_returnflag, round(avg(d),6) AS bias, round(sqrt(count(*)*var_pop(d)/sum(t*t)),6) AS si, round(avg(d*d),6) AS mse, round(avg(abs(d)),6) AS mae, round(sqrt(avg(d*d)),6) AS rmse, round(1-sum(d*d)/(count(*)*var_pop(t)),6) AS r2, round(1-var_pop(d)/var_pop(t),6) AS explained_variance FROM (SELECT l_returnflag, l_extendedprice::DOUBLE/1000 AS t, l_extendedprice::DOUBLE/1000-1.5*l_quantity::DOUBLE AS d FROM lineitem) GROUP BY 1")
def metrics(spark, sf):
    rows = table(spark, sf, "lineitem").select("l_returnflag", (C("l_extendedprice").cast("double") / 1000).alias("t"), (1.5 * C("l_quantity").cast("double")).alias("p"))
    return fr.metrics(rows, "t", "p", ["l_returnflag"])


@query("WITH r AS (SELECT l_quantity::DOUBLE AS a, l_extendedprice::DOUBLE AS b FROM lineitem), k AS (SELECT a, b, rank() OVER (ORDER BY a)+(count(*) OVER (PARTITION BY a)-1)/2.0 AS ra, rank() OVER (ORDER BY b)+(count(*) OVER (PARTITION BY b)-1)/2.0 AS rb FROM r) SELECT round(corr(a,b),6) AS pearson, round(corr(ra,rb),6) AS spearman FROM k")
def correlations(spark, sf):
    rows = table(spark, sf, "lineitem").select(C("l_quantity").cast("double").alias("a"), C("l_extendedprice").cast("double").alias("b"))
    return fr.correlations(rows, "a", "b")


@query("SELECT l_returnflag, count(*) AS n, round(regr_slope(l_extendedprice::DOUBLE, l_quantity::DOUBLE),4) AS slope, round(regr_intercept(l_extendedprice::DOUBLE, l_quantity::DOUBLE),4) AS intercept FROM lineitem GROUP BY 1")
def regression(spark, sf):
    return rounded(fr.regression(table(spark, sf, "lineitem"), "l_extendedprice", "l_quantity", ["l_returnflag"]), 4)


@query("SELECT event_id, 'a' AS variable, round(value,6) AS value FROM events UNION ALL SELECT event_id, 'b', round(value*2,6) FROM events")
def unpivot(spark, sf):
    return fr.unpivot(table(spark, sf, "events").select("event_id", C("value").alias("a"), (C("value") * 2).alias("b")), ["event_id"], ["a", "b"])


@query("SELECT event_type, round(count(*)::DOUBLE/(sum(count(*)) OVER ())::DOUBLE,6) AS probability FROM events GROUP BY 1")
def event_type_probabilities(spark, sf):
    return se.probabilities(table(spark, sf, "events"), "event_type")


def _period_query(name: str, kind: str, expr: str) -> None:
    QUERIES[name] = lambda spark, sf: rounded(se.probabilities(table(spark, sf, "orders"), "o_orderpriority", "o_orderdate", kind))
    ORACLES[name] = f"SELECT {kind}, o_orderpriority, round(count(*)::DOUBLE/(sum(count(*)) OVER (PARTITION BY {kind}))::DOUBLE,6) AS probability FROM (SELECT {expr} AS {kind}, o_orderpriority FROM orders) GROUP BY 1,2"


_period_query("monthly_probabilities", "month", "month(o_orderdate)::INT")
_period_query("annual_probabilities", "year", "year(o_orderdate)::INT")
_period_query("day_of_year_probabilities", "doy", "dayofyear(o_orderdate)::INT")
_period_query("seasonal_probabilities", "season", "CASE WHEN month(o_orderdate) IN (12,1,2) THEN 'DJF' WHEN month(o_orderdate) IN (3,4,5) THEN 'MAM' WHEN month(o_orderdate) IN (6,7,8) THEN 'JJA' ELSE 'SON' END")


@query("SELECT month(ts)::INT AS month, " + ", ".join(f"round(count(*) FILTER (event_type='{t}')::DOUBLE/count(*),6) AS p_{t}" for t in TYPES) + " FROM events GROUP BY 1")
def probability_table(spark, sf):
    return se.probability_table(table(spark, sf, "events"), "event_type", TYPES, "ts", "month")


@query("SELECT t.event_type, round(coalesce(n,0)::DOUBLE/(SELECT count(*) FROM events WHERE month(ts) IN (1,2) AND event_type IN ('click','view')),6) AS probability FROM (VALUES ('click'),('view'),('never')) t(event_type) LEFT JOIN (SELECT event_type, count(*) AS n FROM events WHERE month(ts) IN (1,2) AND event_type IN ('click','view') GROUP BY 1) USING (event_type)")
def fixed_set_probabilities(spark, sf):
    return se.fixed_set_probabilities(table(spark, sf, "events"), "event_type", ["click", "view", "never"], [1, 2], "ts")


@query("WITH l AS (SELECT lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS prev, event_type AS cur FROM events), n AS (SELECT prev, cur, count(*) AS n FROM l WHERE prev IS NOT NULL GROUP BY 1,2) SELECT prev, cur, n, round(n::DOUBLE/(sum(n) OVER (PARTITION BY prev))::DOUBLE,6) AS probability FROM n")
def transition_matrix(spark, sf):
    return se.transitions(table(spark, sf, "events"), "event_type", ["ts", "event_id"], ["user_id"])


RUNS = "WITH c AS (SELECT *, CASE WHEN event_type=lag(event_type) OVER w THEN 0 ELSE 1 END AS ch FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)), r AS (SELECT *, sum(ch) OVER (PARTITION BY user_id ORDER BY ts, event_id)::BIGINT AS run FROM c), g AS (SELECT user_id, run, any_value(event_type) AS event_type, min(ts) AS start, max(ts) AS \"end\", count(*) AS length FROM r GROUP BY 1,2) "


@query(RUNS + "SELECT user_id, run, event_type, length FROM (SELECT *, max(run) OVER (PARTITION BY user_id) AS m FROM g) WHERE run<m")
def persistences(spark, sf):
    return se.persistences(table(spark, sf, "events"), "event_type", ["ts", "event_id"], ["user_id"]).select("user_id", "run", "event_type", "length")


@query(RUNS + "SELECT user_id, run, start, \"end\", length FROM g WHERE length>=2")
def repeated_values(spark, sf):
    return se.repeated_values(table(spark, sf, "events"), "event_type", ["ts", "event_id"], ["user_id"]).select("user_id", "run", "start", "end", "length")


@query("SELECT event_id, round((sum(value) OVER n + greatest(0,3-row_number() OVER o)*first_value(value) OVER f + greatest(0,row_number() OVER o+2-count(*) OVER p)*last_value(value) OVER f)/5,6) AS running_mean FROM events WINDOW p AS (PARTITION BY user_id), o AS (PARTITION BY user_id ORDER BY ts, event_id), n AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING), f AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)")
def running_mean(spark, sf):
    return se.running_mean(table(spark, sf, "events"), "value", ["ts", "event_id"], ["user_id"], 2).select("event_id", "running_mean")


@query("WITH d AS (SELECT o_orderdate AS day, sum(o_totalprice)::DOUBLE/1000 AS v FROM orders GROUP BY 1) SELECT day, round(avg(v) OVER (PARTITION BY month(day) ORDER BY day ROWS BETWEEN 5 PRECEDING AND 5 FOLLOWING),4) AS running_mean FROM d")
def monthly_running_mean(spark, sf):
    d = table(spark, sf, "orders").groupBy(C("o_orderdate").alias("day")).agg((F.sum("o_totalprice").cast("double") / 1000).alias("v"))
    return rounded(se.monthly_running_mean(d, "v", "day", [], 5).select("day", "running_mean"), 4)


@query("SELECT date_trunc('month', ts)::TIMESTAMP AS month, round(avg(value),6) AS mean, round(quantile_cont(value,0.5),6) AS median, count(*) AS n FROM events GROUP BY 1 HAVING count(*)>=300")
def monthly_mean_level(spark, sf):
    return se.block_means(table(spark, sf, "events"), "value", "ts", 300).withColumn("month", C("month").cast("timestamp"))


HOURS = "h AS (SELECT user_id, date_trunc('hour', ts)::TIMESTAMP AS ts, round(max(value),4) AS v FROM events GROUP BY 1,2)"


def _hours(spark, sf):
    return table(spark, sf, "events").groupBy("user_id", F.date_trunc("hour", "ts").alias("ts")).agg(F.round(F.max("value"), 4).alias("v"))


@query(f"WITH {HOURS}, n AS (SELECT *, lead(ts) OVER (PARTITION BY user_id ORDER BY ts) AS nx FROM h) SELECT user_id, unnest(generate_series(ts, coalesce(nx - INTERVAL 1 MICROSECOND, ts), INTERVAL 1 HOUR)) AS ts, v FROM n")
def forward_fill_hourly(spark, sf):
    return se.forward_fill(_hours(spark, sf), "ts", ["v"], "1 hour", ["user_id"])


@query("WITH d AS (SELECT o_orderdate::TIMESTAMP AS ts, max(o_totalprice)::DOUBLE AS v FROM orders GROUP BY 1), s AS (SELECT unnest(generate_series(min(ts), max(ts), INTERVAL 1 DAY)) AS ts FROM d) SELECT s.ts, round(last_value(d.v IGNORE NULLS) OVER (ORDER BY s.ts),6) AS v FROM s LEFT JOIN d ON s.ts=d.ts")
def pad_daily(spark, sf):
    d = table(spark, sf, "orders").groupBy(C("o_orderdate").cast("timestamp").alias("ts")).agg(F.max("o_totalprice").cast("double").alias("v"))
    return se.pad_to_spine(d, "ts", ["v"], "1 day")


@query(f"WITH {HOURS}, n AS (SELECT user_id, epoch(ts) AS a, v AS va, lead(epoch(ts)) OVER w AS b, lead(v) OVER w AS vb FROM h WINDOW w AS (PARTITION BY user_id ORDER BY ts)), g AS (SELECT *, unnest(generate_series(ceil(a/21600)::BIGINT, ceil(b/21600)::BIGINT-1)) AS k FROM n WHERE b>a AND ceil(b/21600)-1>=ceil(a/21600)) SELECT user_id, make_timestamp(k*21600*1000000) AS ts, round(va+(vb-va)*(k*21600-a)/(b-a),6) AS v FROM g")
def linear_resample_6h(spark, sf):
    return se.linear_resample(_hours(spark, sf), "ts", "v", 21600, ["user_id"])


@query("SELECT o_orderkey, round(dayofyear(o_orderdate)::DOUBLE/CASE WHEN (year(o_orderdate)%4=0 AND year(o_orderdate)%100<>0) OR year(o_orderdate)%400=0 THEN 366 ELSE 365 END,6) AS f, floor(epoch(o_orderdate::TIMESTAMP - TIMESTAMP '1990-01-01')/3600)::BIGINT AS h FROM orders")
def year_fractions(spark, sf):
    t = C("o_orderdate").cast("timestamp")
    return table(spark, sf, "orders").select("o_orderkey", se.year_fraction(C("o_orderdate")).alias("f"), se.hours_since(F.lit("1990-01-01").cast("timestamp"), t).alias("h"))


@query("WITH z AS (SELECT user_id, ts, event_id, value-avg(value) OVER (PARTITION BY user_id) AS z FROM events), u AS (SELECT *, CASE WHEN sign(lead(z) OVER w)-sign(z)>0 THEN 1 ELSE 0 END AS up FROM z WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)), k AS (SELECT *, sum(up) OVER (PARTITION BY user_id ORDER BY ts, event_id)::BIGINT AS wave, sum(up) OVER (PARTITION BY user_id)::BIGINT AS m FROM u) SELECT user_id, wave, round(max(z)-min(z),6) AS height, count(*) AS period FROM k WHERE wave>0 AND wave<m GROUP BY 1,2")
def upcrossing_waves(spark, sf):
    return se.upcrossing_waves(table(spark, sf, "events"), "value", ["ts", "event_id"], ["user_id"])


GRID = "g AS (SELECT l_linenumber AS t, (l_orderkey%40)::DOUBLE AS lon, (l_partkey%30)::DOUBLE AS lat, avg(l_quantity::DOUBLE) AS v FROM lineitem GROUP BY 1,2,3)"


@query(f"WITH {GRID}, s AS (SELECT *, v-lag(v) OVER x AS l, lead(v) OVER x-v AS r, v-lag(v) OVER y AS d, lead(v) OVER y-v AS u, cos(radians(abs(lat))) AS c FROM g WINDOW x AS (PARTITION BY t, lat ORDER BY lon), y AS (PARTITION BY t, lon ORDER BY lat)) SELECT t, lon, lat, round(coalesce((l/c*l/c+r/c*r/c)/2+(d*d+u*u)/2,0),4) AS gradient FROM s")
def spatial_gradient(spark, sf):
    li = table(spark, sf, "lineitem")
    g = li.groupBy(C("l_linenumber").alias("t"), (C("l_orderkey") % 40).cast("double").alias("lon"), (C("l_partkey") % 30).cast("double").alias("lat")).agg(F.avg(C("l_quantity").cast("double")).alias("v"))
    return rounded(se.squared_gradient(g, "v", "lat", "lon", ["t"]).select("t", "lon", "lat", "gradient"), 4)


@query("SELECT event_id, round(CASE event_type WHEN 'click' THEN lag(value,1) OVER w WHEN 'view' THEN lag(value,3) OVER w END,6) AS lagged FROM events WINDOW w AS (PARTITION BY event_type ORDER BY ts, event_id)")
def travel_time_lags(spark, sf):
    return se.lagged(table(spark, sf, "events"), "value", {"click": 1, "view": 3}, "event_type", ["ts", "event_id"]).select("event_id", "lagged")


# --- joins and sets
@query("WITH a AS (SELECT event_id, user_id, ts FROM events WHERE event_type='click'), b AS (SELECT event_id AS other, user_id, ts FROM events WHERE event_type='view'), p AS (SELECT a.event_id, b.other, abs(epoch_us(a.ts)-epoch_us(b.ts))/1e6 AS gap, b.ts AS bt FROM a JOIN b ON a.user_id=b.user_id AND abs(epoch_us(a.ts)-epoch_us(b.ts))/1e6<7200) SELECT event_id, other, round(gap,6) AS gap FROM (SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY gap, bt, other) AS k FROM p) WHERE k=1")
def asof_nearest(spark, sf):
    e = table(spark, sf, "events")
    a, b = e.filter("event_type = 'click'"), e.filter("event_type = 'view'").withColumnRenamed("event_id", "other")
    return jn.asof_nearest(a, b, "ts", "event_id", "other", 7200, ["user_id"])


CENTRES = "c AS (SELECT event_type AS label, round(avg(hs),6) AS hs, round(avg(tp),6) AS tp FROM w GROUP BY 1)"


@query(f"WITH {WAVES}, {CENTRES}, d AS (SELECT w.id, c.label, (w.hs-c.hs)*(w.hs-c.hs)+(w.tp-c.tp)*(w.tp-c.tp) AS d FROM w CROSS JOIN c) SELECT id, label, round(sqrt(d),6) AS distance FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY d, label) AS k FROM d) WHERE k=1")
def nearest_centroid(spark, sf):
    w = waves(spark, sf)
    return md.predict_nearest(w, "id", rounded(md.group_centroids(w.withColumnRenamed("event_type", "label"), "label", ["hs", "tp"])), "label", ["hs", "tp"])


@query("WITH f AS (SELECT (o_orderkey%50)::BIGINT AS step, (o_custkey%7)::BIGINT AS cell, o_totalprice::DOUBLE/1000 AS amount FROM orders), r AS (SELECT (l_linenumber%7)::BIGINT AS cell, l_linenumber::BIGINT AS lag, round(avg(l_discount::DOUBLE),4) AS unit FROM lineitem GROUP BY 1,2) SELECT step+lag AS step, round(sum(amount*unit),4) AS level FROM f JOIN r USING (cell) GROUP BY 1")
def shifted_accumulation(spark, sf):
    f = table(spark, sf, "orders").select((C("o_orderkey") % 50).cast("long").alias("step"), (C("o_custkey") % 7).cast("long").alias("cell"), (C("o_totalprice").cast("double") / 1000).alias("amount"))
    r = table(spark, sf, "lineitem").groupBy((C("l_linenumber") % 7).cast("long").alias("cell"), C("l_linenumber").cast("long").alias("lag")).agg(F.round(F.avg(C("l_discount").cast("double")), 4).alias("unit"))
    return rounded(jn.shifted_accumulation(f, r, "cell", "step", "lag", "amount", "unit", []), 4)


@query("WITH k AS (SELECT 0.0::DOUBLE AS x, 1.0::DOUBLE AS y UNION ALL SELECT 50,3 UNION ALL SELECT 120,-2) SELECT event_id, round(CASE WHEN value<=0 THEN 1 WHEN value<50 THEN 1+2*value/50 WHEN value<120 THEN 3-5*(value-50)/70 ELSE -2 END,6)::DOUBLE AS y FROM events")
def bracket_interpolate(spark, sf):
    e = table(spark, sf, "events").select("event_id", C("value").alias("x"))
    at = jn.bracket_interpolate(e.select("x").distinct(), spark.createDataFrame([(0.0, 1.0), (50.0, 3.0), (120.0, -2.0)], "x double, y double"), "x", "y")
    return e.join(at, "x").select("event_id", "y")


@query("SELECT max(a)::DATE AS start, min(b)::DATE AS \"end\" FROM (SELECT min(o_orderdate) AS a, max(o_orderdate) AS b FROM orders UNION ALL SELECT min(l_shipdate), max(l_shipdate) FROM lineitem)")
def common_dates(spark, sf):
    o, li = table(spark, sf, "orders").select(C("o_orderdate").alias("d")), table(spark, sf, "lineitem").select(C("l_shipdate").alias("d"))
    return fr.common_dates([o, li], "d").select(C("start").cast("date"), C("end").cast("date"))


@query("SELECT event_type, user_id, count(*) AS n, min(event_id) AS first FROM events GROUP BY 1,2")
def unique_rows(spark, sf):
    return fr.unique_rows(table(spark, sf, "events"), ["event_type", "user_id"], "event_id")


@query("SELECT r_name, n_name, tp FROM region CROSS JOIN nation CROSS JOIN (VALUES (5),(10),(15)) t(tp)")
def all_combinations(spark, sf):
    return fr.all_combinations([table(spark, sf, "region").select("r_name"), table(spark, sf, "nation").select("n_name"), spark.createDataFrame([(5,), (10,), (15,)], "tp int")])


@query("WITH e AS (SELECT l_orderkey%500 AS x, l_partkey%500 AS y, l_suppkey%500 AS z FROM lineitem) SELECT DISTINCT least(p,q) AS a, greatest(p,q) AS b FROM (SELECT x AS p, y AS q FROM e UNION ALL SELECT y, z FROM e UNION ALL SELECT z, x FROM e)")
def triangle_edges(spark, sf):
    e = table(spark, sf, "lineitem").select((C("l_orderkey") % 500).alias("x"), (C("l_partkey") % 500).alias("y"), (C("l_suppkey") % 500).alias("z"))
    return fr.triangle_edges(e, ("x", "y", "z"))


# --- extremes
@query("SELECT user_id, block, value, peak_ts FROM (SELECT user_id, date_trunc('month', ts)::TIMESTAMP AS block, round(value,6) AS value, ts::TIMESTAMP AS peak_ts, row_number() OVER (PARTITION BY user_id, date_trunc('month', ts) ORDER BY value DESC, ts) AS k FROM events) WHERE k=1")
def monthly_maxima(spark, sf):
    return ex.block_maxima(table(spark, sf, "events"), "value", "ts", ["user_id"], "month")


@query("SELECT user_id, floor(k/20.5)::BIGINT AS block, round(max(value),6) AS value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id)-1 AS k FROM events) GROUP BY 1,2")
def fixed_block_maxima(spark, sf):
    return ex.fixed_block_maxima(table(spark, sf, "events"), "value", ["ts", "event_id"], ["user_id"], 20.5)


@query("SELECT event_id, round(rank() OVER (PARTITION BY event_type ORDER BY value)::DOUBLE/(count(*) OVER (PARTITION BY event_type)+1),6) AS ecdf FROM events")
def ecdf(spark, sf):
    return ex.ecdf(table(spark, sf, "events"), "value", ["event_type"]).select("event_id", "ecdf")


@query(" UNION ALL ".join(f"SELECT {u}::DOUBLE AS threshold, count(*) AS n, round(avg(value-{u}),6) AS mean_excess, round(stddev_samp(value-{u}),6) AS std_excess FROM events WHERE value>{u}" for u in (10, 50, 100)))
def mean_residual_life(spark, sf):
    return ex.mean_excess(table(spark, sf, "events"), "value", [10, 50, 100])


POT = "WITH o AS (SELECT *, value>=100 AS ov FROM events), n AS (SELECT *, CASE WHEN ov AND NOT coalesce(lag(ov) OVER (PARTITION BY user_id ORDER BY ts), false) THEN 1 ELSE 0 END AS nw FROM o), r AS (SELECT *, sum(nw) OVER (PARTITION BY user_id ORDER BY ts) AS run FROM n), g AS (SELECT user_id, run, max(value) AS peak, arg_max(ts, value) AS t, count(*) AS n, sum(value-100) AS excess FROM r WHERE ov GROUP BY 1,2), e AS (SELECT *, sum(CASE WHEN epoch_us(t)-epoch_us(pt)>=3*86400e6 OR pt IS NULL THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY t)::BIGINT AS event FROM (SELECT *, lag(t) OVER (PARTITION BY user_id ORDER BY t) AS pt FROM g)) SELECT user_id, event, round(max(peak),6) AS peak, arg_max(t, peak)::TIMESTAMP AS peak_ts, sum(n)::BIGINT AS n, round(sum(excess),4) AS excess FROM e GROUP BY 1,2"


@query(POT)
def peaks_over_threshold(spark, sf):
    return ex.peaks_over_threshold(table(spark, sf, "events"), "value", "ts", ["user_id"], 100).withColumn("excess", F.round("excess", 4))


@query("SELECT event_id, round(value,6) AS value FROM (SELECT event_id, value, lag(value) OVER w AS a, lead(value) OVER w AS b FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)) WHERE value>greatest(a,b)")
def local_peaks(spark, sf):
    return ex.local_peaks(table(spark, sf, "events"), "value", ["ts", "event_id"], ["user_id"]).select("event_id", "value")


@query("SELECT event_id, round(40+300*(pow(-ln(rank() OVER (PARTITION BY event_type ORDER BY value)::DOUBLE/(count(*) OVER (PARTITION BY event_type)+1)),-0.1)-1),6) AS corrected FROM events")
def quantile_map(spark, sf):
    return ex.quantile_map(table(spark, sf, "events"), "value", ["event_type"], 40, 30, 0.1).select("event_id", "corrected")


@query("SELECT count(*) AS n, round(1/(12.0::DOUBLE*count(*))+sum(g*g),6) AS statistic FROM (SELECT (2*row_number() OVER (ORDER BY value)-1)/(2.0::DOUBLE*count(*) OVER ())-exp(-exp(-(value-30)/25)) AS g FROM events)")
def cramer_von_mises(spark, sf):
    return ex.cramer_von_mises(table(spark, sf, "events"), "value", lambda x: ev.gev_cdf(x, 30, 25, 0))


@query()
def gev_fits(spark, sf):
    m = ex.fixed_block_maxima(table(spark, sf, "events"), "value", ["ts", "event_id"], ["event_type"], 20)
    return rounded(ex.gev_fits(m, "value", "event_type"), 3)


@query()
def gpd_fits(spark, sf):
    return rounded(ex.gpd_fits(table(spark, sf, "events"), "value", "event_type", 30), 3)


@query()
def gev_return_levels(spark, sf):
    m = ex.fixed_block_maxima(table(spark, sf, "events"), "value", ["ts", "event_id"], ["event_type"], 20)
    return rounded(ex.gev_return_levels(m, "value", [10.0, 100.0], resamples=1000), 3)


# --- models
@query()
def max_dissimilarity(spark, sf):
    return md.max_dissimilarity(fr.normalize(waves(spark, sf).select("id", "hs", "tp"), ["hs", "tp"]), "id", ["hs", "tp"], 8)


@query()
def k_means(spark, sf):
    return md.k_means(fr.normalize(waves(spark, sf).select("id", "hs", "tp"), ["hs", "tp"]), "id", ["hs", "tp"], 5)


@query()
def self_organising_map(spark, sf):
    return md.batch_som(fr.normalize(waves(spark, sf).select("id", "hs", "tp"), ["hs", "tp"]), "id", ["hs", "tp"], 3, 3)


@query()
def principal_components(spark, sf):
    return md.principal_components(waves(spark, sf), "id", ["hs", "tp", "dir", "pressure"], 2)[0]


@query(digits=3)
def rbf_interpolation(spark, sf):
    """A target known at 25 chosen sea states, at all of them."""
    w = fr.normalize(waves(spark, sf).select("id", "hs", "tp"), ["hs", "tp"])
    chosen = w.join(F.broadcast(md.max_dissimilarity(w, "id", ["hs", "tp"], 25)), "id").orderBy("pick").toPandas()
    nodes, values = chosen[["hs", "tp"]].to_numpy(), (2 * chosen["hs"] + 3 * chosen["tp"]).to_numpy()
    s = md.best_sigma(nodes, values)
    return md.rbf_predict(w, "id", ["hs", "tp"], nodes, {"y": md.rbf_weights(nodes, values, s)}, {"y": s})


@query()
def latin_hypercube(spark, sf):
    return md.latin_hypercube(spark, {"hs": (0.5, 5.3), "tp": (-0.2, 1.5), "dir": (1, 200)}, 100)


@query()
def gaussian_copula(spark, sf):
    return md.gaussian_copula(waves(spark, sf), ["hs", "tp"], 200)


@query()
def weather_type_simulation(spark, sf):
    t = se.transitions(table(spark, sf, "events"), "event_type", ["ts", "event_id"], ["user_id"])
    return md.simulate_chain(t, 8, 100, "view")


@query()
def spectral_heights(spark, sf):
    return rounded(md.welch_heights(waves(spark, sf), "event_type", "id", "hs", 1.0), 4)


# --- storms and wave families
def _tracks(spark, sf):
    return waves(spark, sf).select("id", C("user_id").alias("storm"), "ts", (C("lat1") / 3).alias("lat"), (C("lon1") / 6 + 100).alias("lon"), "pressure", "event_type", "hs", "tp", "dir")


TRACKS = WAVES + ", k AS (SELECT id, user_id AS storm, ts, lat1/3 AS lat, lon1/6+100 AS lon, pressure, event_type, hs, tp, dir FROM w)"
ARC = lambda a, b, c, d: f"degrees(2*atan2(sqrt(h({a},{b},{c},{d})), sqrt(1-h({a},{b},{c},{d}))))"


def _arc(sql: str) -> str:
    """h(lat1,lon1,lat2,lon2) written out."""
    import re

    one = r"sin(radians((\3)-(\1))/2)*sin(radians((\3)-(\1))/2)+cos(radians(\1))*cos(radians(\3))*sin(radians((\4)-(\2))/2)*sin(radians((\4)-(\2))/2)"
    return re.sub(r"\bh\(([^,()]+),([^,()]+),([^,()]+),([^,()]+)\)", "least(1.0,greatest(0.0," + one + "))", sql)


@query(_arc(f"WITH {TRACKS}, p AS (SELECT *, lag(lat) OVER o AS la, lag(lon) OVER o AS lo, (epoch_us(ts)-lag(epoch_us(ts)) OVER o)/3.6e9 AS hours FROM k WINDOW o AS (PARTITION BY storm ORDER BY ts)) SELECT id, round(radians({ARC('la', 'lo', 'lat', 'lon')})*6371,4) AS km, round(hours,4) AS hours FROM p"))
def track_speed(spark, sf):
    return rounded(st.track_speed(_tracks(spark, sf), "storm", "ts", "lat", "lon").select("id", "km", "hours"), 4)


@query(_arc(f"WITH {TRACKS}, d AS (SELECT *, {ARC('lat', 'lon', '5.0', '130.0')} AS d FROM k) SELECT storm, count(*) AS n, min(ts)::TIMESTAMP AS entry, max(ts)::TIMESTAMP AS exit, round(min(pressure),6) AS min_pressure, round(avg(pressure),6) AS mean_pressure, round(min(d),6) AS nearest FROM d WHERE d<14 GROUP BY 1"))
def circle_passages(spark, sf):
    return st.circle_passages(_tracks(spark, sf), "storm", "ts", "lat", "lon", "pressure", (5.0, 130.0), 14)


@query(f"WITH {TRACKS}, m AS (SELECT *, min(CASE WHEN lat BETWEEN 0 AND 10 AND lon BETWEEN 110 AND 125 THEN ts END) OVER (PARTITION BY storm) AS a, max(CASE WHEN lat BETWEEN 0 AND 10 AND lon BETWEEN 110 AND 125 THEN ts END) OVER (PARTITION BY storm) AS b FROM k) SELECT id, storm FROM m WHERE ts BETWEEN a AND b")
def trim_to_box(spark, sf):
    return st.trim_to_hits(_tracks(spark, sf), "storm", "ts", C("lat").between(0, 10) & C("lon").between(110, 125)).select("id", "storm")


@query(f"WITH {TRACKS}, f AS (SELECT *, first_value(event_type) OVER (PARTITION BY storm ORDER BY ts) AS b FROM k) SELECT id FROM f WHERE b='view'")
def first_basin(spark, sf):
    return st.first_basin(_tracks(spark, sf), "storm", "ts", "event_type", "view").select("id")


CATS = "CASE WHEN p<920 THEN 5 WHEN p<944 THEN 4 WHEN p<964 THEN 3 WHEN p<979 THEN 2 WHEN p<1000 THEN 1 ELSE 0 END"


@query(f"WITH {TRACKS}, a AS (SELECT storm, {CATS} AS c FROM (SELECT storm, avg(pressure) AS p FROM k GROUP BY 1)), b AS (SELECT storm, {CATS} AS c FROM (SELECT storm, avg(pressure) AS p FROM k WHERE lat>20 AND lon<110 GROUP BY 1)), n AS (SELECT a.c AS before, coalesce(b.c,9) AS after, count(*) AS n FROM a LEFT JOIN b USING (storm) GROUP BY 1,2) SELECT before, after, n, round(n::DOUBLE/sum(n) OVER (PARTITION BY before)::DOUBLE,6) AS probability, round((sum(n) OVER (PARTITION BY before ORDER BY after))::DOUBLE/(sum(n) OVER (PARTITION BY before))::DOUBLE,6) AS cumulative FROM n")
def category_changes(spark, sf):
    k = _tracks(spark, sf)
    cat = lambda d: d.groupBy("storm").agg(geo.storm_category(F.avg("pressure")).alias("c"))
    return st.category_changes(cat(k), cat(k.filter("lat > 20 and lon < 110")), "storm", "c")


@query("SELECT a, b, (SELECT count(*) FROM events WHERE user_id%6=a AND event_id%7=b) AS count FROM (SELECT unnest(range(6))::INT AS a) CROSS JOIN (SELECT unnest(range(8))::INT AS b)")
def category_grid(spark, sf):
    e = table(spark, sf, "events").select((C("user_id") % 6).cast("int").alias("a"), (C("event_id") % 7).cast("int").alias("b"))
    return st.category_grid(e, "a", "b", list(range(6)), list(range(8)))


FAM = "round(sqrt(sum(hs*hs)),6) AS hs, round(sqrt(sum(hs*hs)/sum(hs*hs/(tp*tp))),6) AS tp, round(fmod(degrees(atan2(sum(hs*hs*sin(radians(dir))),sum(hs*hs*cos(radians(dir)))))+360,360),6) AS dir"


@query(f"WITH {WAVES} SELECT user_id, {FAM} FROM w GROUP BY 1")
def wave_families(spark, sf):
    return st.wave_families(waves(spark, sf), ["user_id"], "hs", "tp", "dir")


@query(f"WITH {WAVES} SELECT user_id, CASE WHEN dir>=300 OR dir<60 THEN 0 WHEN dir>=60 AND dir<200 THEN 1 END AS sector, {FAM} FROM w WHERE dir>=300 OR dir<200 GROUP BY 1,2")
def sector_families(spark, sf):
    return st.sector_families(waves(spark, sf), ["user_id"], "hs", "tp", "dir", [(300, 60), (60, 200)])


@query(f"WITH {WAVES}, p AS (SELECT event_type, (CASE WHEN hs>20 THEN 1 ELSE 0 END+CASE WHEN tp>10 THEN 2 ELSE 0 END)::INT AS pattern FROM w) SELECT event_type, pattern, count(*) AS n, round(count(*)::DOUBLE/(sum(count(*)) OVER (PARTITION BY event_type))::DOUBLE,6) AS probability FROM p GROUP BY 1,2")
def presence_patterns(spark, sf):
    w = waves(spark, sf).select("event_type", F.when(C("hs") > 20, C("hs")).alias("a"), F.when(C("tp") > 10, C("tp")).alias("b"))
    return st.presence_patterns(w, "event_type", ["a", "b"])


@query(RUNS.replace("g AS (SELECT user_id, run, any_value(event_type) AS event_type, min(ts) AS start, max(ts) AS \"end\", count(*) AS length FROM r GROUP BY 1,2) ", "g AS (SELECT user_id, run, event_type, event_id, value, row_number() OVER (PARTITION BY user_id, run ORDER BY value DESC, event_id) AS nth FROM r) ") + "SELECT user_id, run, event_type, event_id, round(value,6) AS proxy FROM g WHERE nth=1")
def run_maxima(spark, sf):
    return st.run_maxima(table(spark, sf, "events"), "event_type", ["ts", "event_id"], ["user_id"], C("value"), "event_id")


@query()
def hydrographs(spark, sf):
    return st.hydrographs(waves(spark, sf), "event_type", "ts", "hs", "tp", ["user_id"])


@query("SELECT event_id, hour::INT AS hour, round(value*greatest(0,least(hour/10.0::DOUBLE/0.3, (1-hour/10.0::DOUBLE)/0.7)),6) AS level FROM events CROSS JOIN (SELECT unnest(range(11)) AS hour)")
def triangular_hydrograph(spark, sf):
    e = table(spark, sf, "events").select("event_id", "value", F.lit(10.0).alias("h"), F.lit(0.3).alias("tau"))
    return st.triangular_hydrograph(e, "event_id", "value", "h", "tau")


@query()
def interpolate_tracks(spark, sf):
    return st.interpolate_tracks(_tracks(spark, sf), "storm", "ts", "lat", "lon", ["pressure"], 60)


@query("SELECT (row_number() OVER (ORDER BY f, d)-1)::INT AS case_num, f::DOUBLE AS freq, d::DOUBLE AS dir, CASE WHEN 1/f>5 THEN 1.0 ELSE 0.1 END::DOUBLE AS hs FROM (VALUES (0.05),(0.1),(0.25)) a(f) CROSS JOIN (VALUES (0),(90),(180)) b(d)")
def spectrum_cases(spark, sf):
    return st.spectrum_cases(spark, [0.05, 0.1, 0.25], [0.0, 90.0, 180.0, 270.0], (0, 270))


@query("SELECT t::DOUBLE AS t, round(cos(2*pi()*t/8)+0.25*cos(2*pi()*t/5),6)+0 AS level FROM (SELECT unnest(range(600)) AS t)")
def regular_series(spark, sf):
    return st.regular_series(spark, 2.0, 8.0, 0.5, 5.0, 600)


@query()
def random_phase_series(spark, sf):
    return st.random_phase_series(spark, 2.0, 8.0, 600)


@query("WITH k AS (SELECT l_linenumber%3 AS case_num, l_suppkey%5 AS site, 1 AS freq, 2 AS dir, avg(l_discount::DOUBLE) AS kp FROM lineitem GROUP BY 1,2), o AS (SELECT o_orderdate AS time, o_custkey%3 AS case_num, sum(o_totalprice)::DOUBLE/100000 AS energy FROM orders GROUP BY 1,2) SELECT time, site, freq, dir, round(sum(energy*kp),6) AS efth FROM o JOIN k USING (case_num) GROUP BY 1,2,3,4")
def reconstruct_spectra(spark, sf):
    k = table(spark, sf, "lineitem").groupBy((C("l_linenumber") % 3).alias("case_num"), (C("l_suppkey") % 5).alias("site"), F.lit(1).alias("freq"), F.lit(2).alias("dir")).agg(F.avg(C("l_discount").cast("double")).alias("kp"))
    o = table(spark, sf, "orders").groupBy(C("o_orderdate").alias("time"), (C("o_custkey") % 3).alias("case_num")).agg((F.sum("o_totalprice").cast("double") / 100000).alias("energy"))
    return files.reconstruct_spectra(o, k)


@query()
def direction_calibration(spark, sf):
    w = waves(spark, sf).withColumn("sat", C("hs") * (1 + C("dir") / 3600))
    return st.correct_heights(w, "hs", "dir", st.fit_direction_factors(w, "sat", "hs", "dir")).select("id", "hs_corrected")


@query()
def seasonal_gev_fits(spark, sf):
    w = waves(spark, sf).withColumn("yf", se.year_fraction(C("ts")))
    m = w.groupBy("user_id", F.date_trunc("day", "ts").alias("d"), "event_type").agg(F.max("hs").alias("hs"), F.first("yf").alias("yf"))
    return rounded(st.seasonal_gev_fits(m, "hs", "yf", "event_type"), 3)


@query()
def autologistic_probabilities(spark, sf):
    model, terms = st.autologistic_model(table(spark, sf, "events"), "event_type", "ts", ["user_id"])
    from pyspark.ml.functions import vector_to_array

    return model.transform(terms).select("event_id", vector_to_array("probability")[0].alias("p_first"))
