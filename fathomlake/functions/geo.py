"""Geodesy, map tiles and cyclone formulas as column expressions (degrees unless said otherwise)."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_KM = 6371.0
EARTH_M = 6378137.0
FLATTENING = 1 / 298.257223563
#: Scale on the central meridian and false easting of UTM.
UTM_SCALE, UTM_EAST = 0.9996, 500000.0
#: False northing of the southern zones.
SOUTH_NORTH = 10_000_000.0


def arc_distance(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Haversine distance in degrees of arc."""
    a = F.pow(F.sin(F.radians(lat2 - lat1) / 2), F.lit(2.0)) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), F.lit(2.0))
    a = F.least(F.greatest(a, F.lit(0.0)), F.lit(1.0))
    return F.degrees(2 * F.atan2(F.sqrt(a), F.sqrt(1 - a)))


def azimuth(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Initial bearing in [0, 360). At a pole the later rule wins: from the south 0, to the north 0, to the south 180, from the north 180."""
    a1, a2, d = F.radians(lat1), F.radians(lat2), F.radians(lon2 - lon1)
    raw = F.degrees(F.atan2(F.cos(a2) * F.sin(d), F.cos(a1) * F.sin(a2) - F.sin(a1) * F.cos(a2) * F.cos(d)))
    return F.pmod(F.when(lat1 >= 90, 180.0).when(lat2 <= -90, 180.0).when(lat2 >= 90, 0.0).when(lat1 <= -90, 0.0).otherwise(raw), F.lit(360.0))


def shoot(lat: Column, lon: Column, bearing: Column, arc: Column) -> Column:
    """struct(lat, lon) reached on the sphere after ``arc`` degrees on ``bearing``."""
    a, d, b = F.radians(lat), F.radians(arc), F.radians(bearing)
    lat2 = F.asin(F.least(F.lit(1.0), F.greatest(F.lit(-1.0), F.sin(a) * F.cos(d) + F.cos(a) * F.sin(d) * F.cos(b))))
    lon2 = F.radians(lon) + F.atan2(F.sin(b) * F.sin(d) * F.cos(a), F.cos(d) - F.sin(a) * F.sin(lat2))
    return F.struct(F.degrees(lat2).alias("lat"), (F.pmod(F.degrees(lon2) + 180, F.lit(360.0)) - 180).alias("lon"))


def tile(lat: Column, lon: Column, zoom: int) -> Column:
    """struct(x, y): slippy-map tile."""
    n, a = float(2**zoom), F.radians(lat)
    x = F.floor((lon + 180.0) / 360.0 * n).cast("long")
    return F.struct(x.alias("x"), F.floor((1.0 - F.ln(F.tan(a) + 1 / F.cos(a)) / math.pi) / 2.0 * n).cast("long").alias("y"))


def tile_corner(x: Column, y: Column, zoom: int) -> Column:
    """struct(lat, lon) of a tile's upper left corner."""
    n = float(2**zoom)
    return F.struct(F.degrees(F.atan(F.sinh(math.pi * (1 - 2 * y / n)))).alias("lat"), (x / n * 360.0 - 180.0).alias("lon"))


def web_mercator(lon: Column, lat: Column) -> Column:
    return F.struct((EARTH_M * F.radians(lon)).alias("x"), (EARTH_M * F.ln(F.tan(math.pi / 4 + F.radians(lat) / 2))).alias("y"))


def zoom_for(lon_min: Column, lon_max: Column, width_px: int = 1024, tile_px: int = 256) -> Column:
    """Zoom at which the span fills the display."""
    return F.round(F.log2(F.lit(360.0 * width_px / tile_px) / F.abs(lon_max - lon_min))).cast("int")


def tile_bounds(x0: Column, y0: Column, x1: Column, y1: Column, zoom: int) -> Column:
    """struct(x_min, y_min, x_max, y_max) in Web Mercator metres of a block of tiles, ends included."""
    upper, lower = tile_corner(x0, y0, zoom), tile_corner(x1 + 1, y1 + 1, zoom)
    low, high = web_mercator(upper["lon"], lower["lat"]), web_mercator(lower["lon"], upper["lat"])
    return F.struct(low["x"].alias("x_min"), low["y"].alias("y_min"), high["x"].alias("x_max"), high["y"].alias("y_max"))


def raster_step(lon: Column, lat: Column, step: float) -> Column:
    """Mean Web Mercator metres of a diagonal raster step of ``step`` degrees."""
    a, b = web_mercator(lon, lat), web_mercator(lon + step / math.sqrt(2), lat + step / math.sqrt(2))
    return (F.abs(a["x"] - b["x"]) + F.abs(a["y"] - b["y"])) / 2


def mean_velocity(lat1: Column, lon1: Column, lat2: Column, lon2: Column, hours: Column) -> Column:
    """struct(course, speed, vx, vy): bearing back to the first point, and km/h towards the second."""
    course = azimuth(lat2, lon2, lat1, lon1)
    speed = F.radians(arc_distance(lat1, lon1, lat2, lon2)) * EARTH_KM / hours
    ahead = F.radians(course + 180)
    return F.struct(course.alias("course"), speed.alias("speed"), (speed * F.sin(ahead)).alias("vx"), (speed * F.cos(ahead)).alias("vy"))


def polar_place(lat0: Column, lon0: Column, lat: Column, lon: Column, heading: Column, south: Column) -> Column:
    """struct(km, angle): a point seen from a storm, angles from the right of its heading; mirrored in the southern hemisphere."""
    km = F.radians(arc_distance(lat0, lon0, lat, lon)) * EARTH_KM
    turned = azimuth(lat0, lon0, lat, lon) - (heading - 90)
    angle = F.when(turned < 0, F.pmod(turned, F.lit(360.0))).otherwise(turned)
    mirrored = F.when((angle >= 0) & (angle <= 180), 180 - angle).when((angle >= 180) & (angle <= 360), 540 - angle).otherwise(angle)
    return F.struct(km.alias("km"), F.when(south, mirrored).otherwise(angle).alias("angle"))


#: Basins (fixed values): name, sign of the latitude, and open limits of the longitude (0 to 360) and of the absolute latitude.
BASINS = (("SI", -1, 20, 135, 90), ("SP", -1, 135, 290, 90), ("NI", 1, 20, 100, 90), ("WP", 1, 100, 180, 90), ("EP", 1, 180, 260, 90), ("EP", 1, 260, 275, 15))


def ocean_basin(lat: Column, lon: Column) -> Column:
    """Cyclone basin of a place; "NA" where no other holds it."""
    x = F.when(lon < 0, lon + 360).otherwise(lon)
    out = F.lit("NA")
    for name, sign, west, east, most in reversed(BASINS):
        side = (lat < 0) if sign < 0 else (lat > 0) & (lat < most)
        out = F.when(side & (x > west) & (x < east), name).otherwise(out)
    return out


def polygon_size(vertices: list[tuple[float, float]]) -> tuple[float, float]:
    """Area and length of a polygon's border."""
    edges = list(zip(vertices, vertices[1:] + vertices[:1]))
    return abs(sum(a[0] * b[1] - b[0] * a[1] for a, b in edges)) / 2, sum(math.dist(a, b) for a, b in edges)


def in_buffer(x: Column, y: Column, vertices: list[tuple[float, float]], factor: float) -> Column:
    """Inside a polygon or within ``factor`` times its area over its border's length of it."""
    area, length = polygon_size(vertices)
    near = []
    for (x1, y1), (x2, y2) in zip(vertices, vertices[1:] + vertices[:1]):
        dx, dy = float(x2 - x1), float(y2 - y1)
        t = F.least(F.lit(1.0), F.greatest(F.lit(0.0), ((x - x1) * dx + (y - y1) * dy) / (dx * dx + dy * dy)))
        near.append(F.hypot(x - (x1 + t * dx), y - (y1 + t * dy)))
    return in_polygon(x, y, vertices) | (F.least(*near) <= factor * area / length)


def utm(lon: Column, lat: Column, zone: int) -> Column:
    """struct(easting, northing), northern zone (southern ones add SOUTH_NORTH to the northing): transverse Mercator by the third-order series in the third flattening."""
    n = FLATTENING / (2 - FLATTENING)
    radius = EARTH_M / (1 + n) * (1 + n**2 / 4 + n**4 / 64)
    alpha = (n / 2 - 2 * n**2 / 3 + 5 * n**3 / 16, 13 * n**2 / 48 - 3 * n**3 / 5, 61 * n**3 / 240)
    e, s, d = 2 * math.sqrt(n) / (1 + n), F.sin(F.radians(lat)), F.radians(lon - (6 * zone - 183))
    t = F.sinh(F.atanh(s) - e * F.atanh(e * s))
    xi, eta = F.atan2(t, F.cos(d)), F.atanh(F.sin(d) / F.sqrt(1 + t * t))
    east, north = eta, xi
    for j, a in enumerate(alpha, 1):
        east = east + a * F.cos(2 * j * xi) * F.sinh(2 * j * eta)
        north = north + a * F.sin(2 * j * xi) * F.cosh(2 * j * eta)
    return F.struct((UTM_EAST + UTM_SCALE * radius * east).alias("easting"), (UTM_SCALE * radius * north).alias("northing"))


def from_utm(easting: Column, northing: Column, zone: int) -> Column:
    """struct(lon, lat): inverse of ``utm``."""
    n = FLATTENING / (2 - FLATTENING)
    radius = EARTH_M / (1 + n) * (1 + n**2 / 4 + n**4 / 64)
    beta = (n / 2 - 2 * n**2 / 3 + 37 * n**3 / 96, n**2 / 48 + n**3 / 15, 17 * n**3 / 480)
    delta = (2 * n - 2 * n**2 / 3 - 2 * n**3, 7 * n**2 / 3 - 8 * n**3 / 5, 56 * n**3 / 15)
    xi, eta = northing / (UTM_SCALE * radius), (easting - UTM_EAST) / (UTM_SCALE * radius)
    x, y = xi, eta
    for j, b in enumerate(beta, 1):
        x = x - b * F.sin(2 * j * xi) * F.cosh(2 * j * eta)
        y = y - b * F.cos(2 * j * xi) * F.sinh(2 * j * eta)
    chi = F.asin(F.sin(x) / F.cosh(y))
    lat = chi
    for j, d in enumerate(delta, 1):
        lat = lat + d * F.sin(2 * j * chi)
    return F.struct((6 * zone - 183 + F.degrees(F.atan2(F.sinh(y), F.cos(x)))).alias("lon"), F.degrees(lat).alias("lat"))


def in_polygon(x: Column, y: Column, vertices: list[tuple[float, float]]) -> Column:
    """Even-odd rule; a point on the upper or right edge is outside."""
    inside = F.lit(0)
    for (x1, y1), (x2, y2) in zip(vertices, vertices[1:] + vertices[:1]):
        if y1 != y2:
            crosses = ((F.lit(float(y1)) > y) != (F.lit(float(y2)) > y)) & (x < (x2 - x1) * (y - y1) / (y2 - y1) + x1)
            inside = inside + F.when(crosses, 1).otherwise(0)
    return inside % 2 == 1


def in_triangle(x: Column, y: Column, t: list[tuple[float, float]]) -> Column:
    """Inside or on the border: the three barycentric signs agree."""
    side = lambda a, b: (x - b[0]) * (a[1] - b[1]) - (a[0] - b[0]) * (y - b[1])
    s = [side(t[0], t[1]), side(t[1], t[2]), side(t[2], t[0])]
    return ~(((s[0] < 0) | (s[1] < 0) | (s[2] < 0)) & ((s[0] > 0) | (s[1] > 0) | (s[2] > 0)))


def circumcenter(x1: Column, y1: Column, x2: Column, y2: Column, x3: Column, y3: Column) -> Column:
    """struct(x, y); the centroid where the three points lie on a line."""
    d = 2 * (x1 * (y2 - y3) + x2 * (y3 - y1) + x3 * (y1 - y2))
    q1, q2, q3 = x1 * x1 + y1 * y1, x2 * x2 + y2 * y2, x3 * x3 + y3 * y3
    ux = F.try_divide(q1 * (y2 - y3) + q2 * (y3 - y1) + q3 * (y1 - y2), d)
    uy = F.try_divide(q1 * (x3 - x2) + q2 * (x1 - x3) + q3 * (x2 - x1), d)
    return F.struct(F.coalesce(ux, (x1 + x2 + x3) / 3).alias("x"), F.coalesce(uy, (y1 + y2 + y3) / 3).alias("y"))


#: Pressure limits (hPa) of the storm categories 5 to 1.
SAFFIR = ((5, 920), (4, 944), (3, 964), (2, 979), (1, 1000))


def storm_category(pressure: Column, closed: bool = False) -> Column:
    """Saffir-Simpson category by central pressure; 6 without one. ``closed``: limits belong to the stronger category."""
    out = F.when(pressure.isNull() | F.isnan(pressure) | (pressure == 0), 6)
    for c, p in SAFFIR:
        out = out.when(pressure <= p if closed else pressure < p, c)
    return out.otherwise(0)


def radius_of_max_wind(wind: Column, speed: Column, lat: Column) -> Column:
    """Nautical miles, by the polynomial of Knaff et al. (2016), from knots."""
    g = (wind - speed) / 0.9
    return 218.3784 - 1.2014 * g + F.pow(g / 10.9844, F.lit(2.0)) - F.pow(g / 35.3052, F.lit(3.0)) - 145.509 * F.cos(F.radians(lat))


def box_entry(delta: Column, gamma: Column, x0: float, y0: float, r: float, lon0: float, lon1: float, lat0: float, lat1: float) -> Column:
    """struct(x, y): where the ray of bearing gamma from the circle's point at bearing delta meets the box."""
    xc, yc = x0 + r * F.sin(F.radians(delta)), y0 + r * F.cos(F.radians(delta))
    s, c = F.sin(F.radians(gamma)), F.cos(F.radians(gamma))
    corner = lambda x, y, turn: F.degrees(F.atan((x - xc) / (y - yc))) + turn
    ur, lr, ll, ul = corner(lon1, lat1, 0), corner(lon1, lat0, 180), corner(lon0, lat0, 180), corner(lon0, lat1, 360)
    at_x = lambda x: F.struct(F.lit(float(x)).alias("x"), (yc + (x - xc) / s * c).alias("y"))
    at_y = lambda y: F.struct((xc + (y - yc) / c * s).alias("x"), F.lit(float(y)).alias("y"))
    return (
        F.when((gamma > ur) & (gamma < lr), at_x(lon1)).when((gamma > lr) & (gamma < ll), at_y(lat0)).when((gamma > ll) & (gamma < ul), at_x(lon0)).when((gamma > ul) | (gamma < ur), at_y(lat1))
    )


def polynomial(x: Column, coefs: list[float]) -> Column:
    """Value of a polynomial, the highest power's coefficient first."""
    out = F.lit(0.0)
    for c in coefs:
        out = out * x + c
    return out


def wind_to_pressure(wind: Column, coefs: list[float], low: float = 850.0, high: float = 1030.0, steps: int = 60) -> Column:
    """Pressure (hPa) at which a falling wind polynomial gives ``wind``, by bisection; the nearer end beyond the range."""
    def half(a, _):
        mid = (a["lo"] + a["hi"]) / 2
        more = polynomial(mid, coefs) > wind
        return F.struct(F.when(more, mid).otherwise(a["lo"]).alias("lo"), F.when(more, a["hi"]).otherwise(mid).alias("hi"))

    start = F.struct(F.lit(low).alias("lo"), F.lit(high).alias("hi"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(steps)), start, half, lambda a: (a["lo"] + a["hi"]) / 2)
