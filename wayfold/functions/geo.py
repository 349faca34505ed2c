"""Geography and street-time arithmetic as columns; degrees in, metres or seconds out."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Two radii are in use, for streets and for rails; metres in a degree; the damping of straight distances.
STREET_RADIUS, RAIL_RADIUS, DEGREE_M, DAMPING = 6365396.0, 6371000.0, 111320.0, 0.99
#: Belgian Lambert 2008 on GRS 80.
LAMBERT_2008 = {"a": 6378137.0, "inv_f": 298.257222101, "lat0": 50.797815, "lon0": 4.359215833333333, "lat1": 49.833333333333336, "lat2": 51.166666666666664, "east": 649328.0, "north": 665262.0}
#: How street times spread.
PERCENTILE, SIGMA_ALPHA, SIGMA_FLOOR, SIGMA_CAP = 0.85, 3.8, 0.12, 0.5


def haversine(lat1: Column, lon1: Column, lat2: Column, lon2: Column, radius: float = STREET_RADIUS) -> Column:
    s = lambda d: F.pow(F.sin(F.radians(d) / 2), 2)
    return 2 * radius * F.asin(F.sqrt(s(lat1 - lat2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * s(lon1 - lon2)))


def squared_degrees(metres: Column) -> Column:
    return F.pow(metres / DEGREE_M, 2)


def metres_of(squared: Column, lat: Column) -> Column:
    return F.sqrt(squared) * DEGREE_M * F.greatest(F.cos(F.radians(lat)), F.lit(0.5))


def damped(metres: Column) -> Column:
    return F.floor(metres * DAMPING)


def project(lat: Column, lon: Column, lat_a: Column, lon_a: Column, lat_b: Column, lon_b: Column) -> Column:
    """(metres, t): distance from a point to a segment, and where on it, from 0 to 1, the nearest place is."""
    east, north = DEGREE_M * F.cos(F.radians(lat)), F.lit(DEGREE_M)
    ax, ay, bx, by = (lon_a - lon) * east, (lat_a - lat) * north, (lon_b - lon) * east, (lat_b - lat) * north
    dx, dy = bx - ax, by - ay
    square = dx * dx + dy * dy
    t = F.when(square == 0, F.lit(0.0)).otherwise(F.least(F.greatest(-(ax * dx + ay * dy) / square, F.lit(0.0)), F.lit(1.0)))
    return F.struct(F.sqrt(F.pow(ax + t * dx, 2) + F.pow(ay + t * dy, 2)).alias("metres"), t.alias("t"))


def lambert_2008(lat: Column, lon: Column) -> Column:
    """(east, north) by the conformal conic with two standard parallels; what doesn't depend on the point is folded here."""
    c = LAMBERT_2008
    f = 1 / c["inv_f"]
    e = math.sqrt(2 * f - f * f)
    rad = math.pi / 180
    scale = lambda p: math.cos(p) / math.sqrt(1 - (e * math.sin(p)) ** 2)
    colat = lambda p: math.tan(math.pi / 4 - p / 2) / ((1 - e * math.sin(p)) / (1 + e * math.sin(p))) ** (e / 2)
    p1, p2 = c["lat1"] * rad, c["lat2"] * rad
    n = math.log(scale(p1) / scale(p2)) / math.log(colat(p1) / colat(p2))
    big = c["a"] * scale(p1) / (n * colat(p1) ** n)
    r0 = big * colat(c["lat0"] * rad) ** n
    phi = F.radians(lat)
    here = F.tan(math.pi / 4 - phi / 2) / F.pow((1 - e * F.sin(phi)) / (1 + e * F.sin(phi)), F.lit(e / 2))
    r, theta = big * F.pow(here, F.lit(n)), n * (F.radians(lon) - c["lon0"] * rad)
    return F.struct((c["east"] + r * F.sin(theta)).alias("east"), (c["north"] + r0 - r * F.cos(theta)).alias("north"))


def inside(lat: Column, lon: Column, ring: Column) -> Column:
    """Even-odd test against a ring of (lat, lon); fewer than three corners hold nothing."""
    after = F.concat(F.slice(ring, 2, F.size(ring)), F.slice(ring, 1, 1))
    crossed = F.zip_with(ring, after, lambda a, b: ((a["lat"] > lat) != (b["lat"] > lat)) & (lon < (b["lon"] - a["lon"]) * (lat - a["lat"]) / (b["lat"] - a["lat"]) + a["lon"]))
    return (F.size(ring) >= 3) & (F.size(F.filter(crossed, lambda x: x)) % 2 == 1)


def centroid(ring: Column) -> Column:
    """(lat, lon) by the shoelace formula; the mean of the corners where the ring has no area."""
    after = F.concat(F.slice(ring, 2, F.size(ring)), F.slice(ring, 1, 1))
    parts = F.zip_with(ring, after, lambda a, b: F.struct((a["lon"] * b["lat"] - b["lon"] * a["lat"]).alias("w"), (a["lat"] + b["lat"]).alias("lat"), (a["lon"] + b["lon"]).alias("lon")))
    total = lambda x: F.aggregate(parts, F.lit(0.0), lambda acc, p: acc + x(p))
    area = total(lambda p: p["w"])
    mean = lambda k: F.aggregate(ring, F.lit(0.0), lambda acc, p: acc + p[k]) / F.size(ring)
    one = lambda k: F.when(F.abs(area) > 1e-12, total(lambda p: p[k] * p["w"]) / (3 * area)).otherwise(mean(k))
    return F.struct(one("lat").alias("lat"), one("lon").alias("lon"))


def advance(points: Column, metres: Column) -> Column:
    """(lat, lon) so many metres along a line of points, held at its ends."""
    rest = F.slice(points, 2, F.size(points))
    zero = F.struct(F.greatest(metres, F.lit(0.0)).alias("left"), points[0].alias("at"), F.lit(False).alias("done"))

    def step(acc: Column, p: Column) -> Column:
        length = haversine(acc["at"]["lat"], acc["at"]["lon"], p["lat"], p["lon"])
        share = F.when(length > 0, acc["left"] / length).otherwise(0.0)
        between = F.struct((acc["at"]["lat"] + (p["lat"] - acc["at"]["lat"]) * share).alias("lat"), (acc["at"]["lon"] + (p["lon"] - acc["at"]["lon"]) * share).alias("lon"))
        ends = acc["left"] <= length
        return F.when(acc["done"], acc).otherwise(F.struct(F.when(ends, F.lit(0.0)).otherwise(acc["left"] - length).alias("left"), F.when(ends, between).otherwise(F.struct(p["lat"].alias("lat"), p["lon"].alias("lon"))).alias("at"), ends.alias("done")))

    return F.aggregate(rest, zero, step, lambda acc: acc["at"])


def quantise(lat: Column, lon: Column) -> Column:
    """A whole-number key of about a tenth of a metre."""
    return F.struct(F.floor(lat * 1e6 + 0.5).alias("lat"), F.floor(lon * 1e6 + 0.5).alias("lon"))


#: Coefficients of the rational approximation of the inverse normal distribution.
_MIDDLE = ((-3.969683028665376e01, 2.209460984245205e02, -2.759285104469687e02, 1.383577518672690e02, -3.066479806614716e01, 2.506628277459239e00), (-5.447609879822406e01, 1.615858368580409e02, -1.556989798598866e02, 6.680131188771972e01, -1.328068155288572e01, 1.0))
_TAIL = ((-7.784894002430293e-03, -3.223964580411365e-01, -2.400758277161838e00, -2.549732539343734e00, 4.374664141464968e00, 2.938163982698783e00), (7.784695709041462e-03, 3.224671290700398e-01, 2.445134137142996e00, 3.754408661907416e00, 1.0))
_TAIL_FROM = 0.02425


def inverse_normal(p: Column) -> Column:
    p = F.least(F.greatest(p, F.lit(1e-12)), F.lit(1 - 1e-12))

    def ratio(pair, x):
        top = bottom = F.lit(0.0)
        for c in pair[0]:
            top = top * x + c
        for c in pair[1]:
            bottom = bottom * x + c
        return top / bottom

    tail = lambda q: ratio(_TAIL, F.sqrt(-2 * F.log(q)))
    middle = (p - 0.5) * ratio(_MIDDLE, F.pow(p - 0.5, 2))
    return F.when(p < _TAIL_FROM, tail(p)).when(p > 1 - _TAIL_FROM, -tail(1 - p)).otherwise(middle)


def sigma(seconds: Column) -> Column:
    return F.when(seconds == 0, 0.0).otherwise(F.least(F.greatest(SIGMA_ALPHA / F.sqrt(seconds), F.lit(SIGMA_FLOOR)), F.lit(SIGMA_CAP)))


def access_seconds(seconds: Column, percentile: float = PERCENTILE) -> Column:
    return F.floor(seconds * F.exp(sigma(seconds) * inverse_normal(F.lit(percentile))) + 0.5)


def egress_seconds(seconds: Column) -> Column:
    return F.floor(seconds * F.exp(F.pow(sigma(seconds), 2) / 2) + 0.5)


def bracket(mean: Column, variance: Column) -> Column:
    """(p50, p95)."""
    return F.struct(mean.alias("p50"), (mean + 1.645 * F.sqrt(variance)).alias("p95"))
