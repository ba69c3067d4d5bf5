"""Geometry and coordinates as Column expressions."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructType

# Fixed values of the shifted national frame: the ellipsoid, the frame's window, and of each offset (longitude, latitude)
# the polynomial in 1, x, y, x², xy, √|x| and the waves as (amplitude, what they run along, turns of π per degree).
SHIFT_A, SHIFT_E2 = 6378245.0, 0.00669342162296594323
FRAME = (72.004, 137.8347, 0.8293, 55.8271)
LNG_TERMS, LAT_TERMS = (300.0, 1.0, 2.0, 0.1, 0.1, 0.1), (-100.0, 2.0, 3.0, 0.0, 0.1, 0.2)
LAT_Y2 = 0.2
COMMON_WAVES = ((20.0, "x", 6.0), (20.0, "x", 2.0))
LNG_WAVES = ((20.0, "x", 1.0), (40.0, "x", 1 / 3), (150.0, "x", 1 / 12), (300.0, "x", 1 / 30))
LAT_WAVES = ((20.0, "y", 1.0), (40.0, "y", 1 / 3), (160.0, "y", 1 / 12), (320.0, "y", 1 / 30))
EARTH_M = 6371008.8
METRES_A_DEGREE = EARTH_M * math.pi / 180


def planar(ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    """straight distance in metres."""
    return F.sqrt((ax - bx) * (ax - bx) + (ay - by) * (ay - by))


def haversine(lng1: Column, lat1: Column, lng2: Column, lat2: Column) -> Column:
    """great-circle metres."""
    a = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lng2 - lng1) / 2), 2)
    return 2 * EARTH_M * F.asin(F.least(F.lit(1.0), F.sqrt(a)))


def to_local(lng: Column, lat: Column, lng0: Column, lat0: Column) -> tuple[Column, Column]:
    """metres east and north of an origin in an equirectangular frame."""
    return (lng - lng0) * METRES_A_DEGREE * F.cos(F.radians(lat0)), (lat - lat0) * METRES_A_DEGREE


def from_local(x: Column, y: Column, lng0: Column, lat0: Column) -> tuple[Column, Column]:
    """back to degrees, six decimals."""
    return F.round(lng0 + x / (METRES_A_DEGREE * F.cos(F.radians(lat0))), 6), F.round(lat0 + y / METRES_A_DEGREE, 6)


def _offset(terms: tuple, waves: tuple, y2: float, x, y, sin, root):
    """One offset of the shifted frame at (x, y) degrees from its origin, for Columns and arrays alike."""
    one, ax, ay, axx, axy, ar = terms
    out = one + ax * x + ay * y + axx * x * x + axy * x * y + ar * root + y2 * y * y
    for height, along, turns in (*COMMON_WAVES, *waves):
        out = out + height * 2.0 / 3.0 * sin((x if along == "x" else y) * (turns * math.pi))
    return out


def _shift(lng, lat, sin, cos, sqrt, absolute):
    """Degrees by which the shifted frame lies off at a place."""
    x, y, rad = lng - 105.0, lat - 35.0, lat * (math.pi / 180)
    root = sqrt(absolute(x))
    east = _offset(LNG_TERMS, LNG_WAVES, 0.0, x, y, sin, root)
    north = _offset(LAT_TERMS, LAT_WAVES, LAT_Y2, x, y, sin, root)
    w2 = 1 - SHIFT_E2 * sin(rad) * sin(rad)  # squared scale of the ellipsoid at this latitude
    degree = 180 / math.pi
    return east * degree * sqrt(w2) / (SHIFT_A * cos(rad)), north * degree * w2 * sqrt(w2) / (SHIFT_A * (1 - SHIFT_E2))


def valid_place(lng: Column, lat: Column) -> Column:
    """finite degrees of a place on Earth."""
    return F.coalesce(lng.between(-180, 180) & lat.between(-90, 90), F.lit(False))  # NaN is beyond every bound


def in_frame(lng: Column, lat: Column) -> Column:
    """inside the window in which the frame is shifted."""
    return lng.between(FRAME[0], FRAME[1]) & lat.between(FRAME[2], FRAME[3])


def wgs84_to_gcj02(lng: Column, lat: Column) -> tuple[Column, Column]:
    """the shifted frame; places outside its window pass through, invalid ones become null."""
    dx, dy = _shift(lng, lat, F.sin, F.cos, F.sqrt, F.abs)
    ok, inside = valid_place(lng, lat), in_frame(lng, lat)
    return F.when(ok, F.when(inside, lng + dx).otherwise(lng)), F.when(ok, F.when(inside, lat + dy).otherwise(lat))


@F.pandas_udf(StructType().add("lng", DoubleType()).add("lat", DoubleType()))
def _unshifted(lng: pd.Series, lat: pd.Series) -> pd.DataFrame:
    x0, y0 = lng.to_numpy(float), lat.to_numpy(float)
    x, y = x0.copy(), y0.copy()
    for _ in range(10):
        inside = (x >= FRAME[0]) & (x <= FRAME[1]) & (y >= FRAME[2]) & (y <= FRAME[3])
        dx, dy = _shift(x, y, np.sin, np.cos, np.sqrt, np.abs)
        off_x, off_y = x + np.where(inside, dx, 0) - x0, y + np.where(inside, dy, 0) - y0
        x, y = x - off_x, y - off_y
        if np.nanmax(np.abs(np.r_[off_x, off_y, 0.0])) < 1e-10:
            break
    return pd.DataFrame({"lng": x, "lat": y})


def gcj02_to_wgs84(lng: Column, lat: Column) -> tuple[Column, Column]:
    """Back from the shifted frame by ten steps at most, in Arrow batches (as an expression each step would multiply the last)."""
    ok = valid_place(lng, lat)
    place = _unshifted(F.when(ok, lng), F.when(ok, lat))
    return F.when(ok, place["lng"]), F.when(ok, place["lat"])


def bd09_to_wgs84(lng: Column, lat: Column) -> tuple[Column, Column]:
    """F1."""
    return gcj02_to_wgs84(*bd09_to_gcj02(lng, lat))


def gcj02_to_bd09(lng: Column, lat: Column) -> tuple[Column, Column]:
    """F1."""
    k = 3.14159265358979324 * 3000.0 / 180.0
    z = F.sqrt(lng * lng + lat * lat) + 0.00002 * F.sin(lat * k)
    t = F.atan2(lat, lng) + 0.000003 * F.cos(lng * k)
    return z * F.cos(t) + 0.0065, z * F.sin(t) + 0.006


def bd09_to_gcj02(lng: Column, lat: Column) -> tuple[Column, Column]:
    """F1."""
    k = 3.14159265358979324 * 3000.0 / 180.0
    x, y = lng - 0.0065, lat - 0.006
    z = F.sqrt(x * x + y * y) - 0.00002 * F.sin(y * k)
    t = F.atan2(y, x) - 0.000003 * F.cos(x * k)
    return z * F.cos(t), z * F.sin(t)


def wgs84_to_bd09(lng: Column, lat: Column) -> tuple[Column, Column]:
    """F1."""
    return gcj02_to_bd09(*wgs84_to_gcj02(lng, lat))


def along_segment(px: Column, py: Column, ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    """where on a segment (0 to 1) a point projects; 0 for a segment without length."""
    long2 = (bx - ax) * (bx - ax) + (by - ay) * (by - ay)
    t = ((px - ax) * (bx - ax) + (py - ay) * (by - ay)) / long2
    return F.when(long2 == 0, 0.0).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), t)))


def segment_distance(px: Column, py: Column, ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    """metres from a point to a segment."""
    t = along_segment(px, py, ax, ay, bx, by)
    return planar(px, py, ax + t * (bx - ax), ay + t * (by - ay))


def crossing(r1: Column, v1: Column, r2: Column, v2: Column, level: float) -> Column:
    """F16: where a value that runs straight from (r1, v1) to (r2, v2) meets a level; the middle where it is level."""
    return F.when(v1 == v2, (r1 + r2) / 2).otherwise(r1 + (level - v1) * (r2 - r1) / (v2 - v1))


def area2(ax: Column, ay: Column, bx: Column, by: Column, cx: Column, cy: Column) -> Column:
    """twice the signed area of a triangle."""
    return (bx - ax) * (cy - ay) - (cx - ax) * (by - ay)


def barycentric(px: Column, py: Column, ax: Column, ay: Column, bx: Column, by: Column, cx: Column, cy: Column) -> tuple[Column, Column, Column]:
    """the weights of a triangle's corners at a point; null for a flat triangle."""
    whole = F.nullif(area2(ax, ay, bx, by, cx, cy), F.lit(0))
    return area2(px, py, bx, by, cx, cy) / whole, area2(ax, ay, px, py, cx, cy) / whole, area2(ax, ay, bx, by, px, py) / whole


def positive_share(a: Column, b: Column, c: Column) -> Column:
    """share of a triangle on the positive side of a linear field that is 0 or 2 at its corners, cut at 1."""
    n = a.cast("int") + b.cast("int") + c.cast("int")
    return F.when(n == 0, 0.0).when(n == 1, 0.25).when(n == 2, 0.75).when(n == 3, 1.0)


def share_below(a: Column, b: Column, c: Column, level: Column) -> Column:
    """share of a triangle where the plane through its corners' values is at or below a level."""
    lo, hi = F.least(a, b, c), F.greatest(a, b, c)
    mid = a + b + c - lo - hi
    under = (level - lo) * (level - lo) / ((mid - lo) * (hi - lo))
    over = 1 - (hi - level) * (hi - level) / ((hi - lo) * (hi - mid))
    return F.when(level >= hi, 1.0).when(level <= lo, 0.0).when(level < mid, under).otherwise(over)


def biweight(d: Column, reach: float = 120.0) -> Column:
    """kernel weight of a distance, per hectare."""
    u = 1 - (d * d) / (reach * reach)
    return F.when(d < reach, 3 / (3.141592653589793 * reach * reach) * u * u * 10_000).otherwise(0.0)


def smoothstep(x: Column, lo: float, hi: float) -> Column:
    """F19."""
    t = F.least(F.lit(1.0), F.greatest(F.lit(0.0), (x - lo) / (hi - lo)))
    return t * t * (3 - 2 * t)


def in_ring(px: Column, py: Column, ring: Column, boundary: bool = True, slack: float = 1e-9) -> Column:
    """Is a point in a closed ring (array of struct x, y; first corner not repeated)?

    Half-open ray cast; with ``boundary``, points on an edge are inside.
    """
    edges = F.transform(ring, lambda p, i: F.struct(p["x"].cast("double").alias("ax"), p["y"].cast("double").alias("ay"), F.get(ring, (i + 1) % F.size(ring))["x"].cast("double").alias("bx"), F.get(ring, (i + 1) % F.size(ring))["y"].cast("double").alias("by")))
    crosses = F.size(F.filter(edges, lambda e: ((e["ay"] > py) != (e["by"] > py)) & (px < (e["bx"] - e["ax"]) * (py - e["ay"]) / (e["by"] - e["ay"]) + e["ax"])))
    inside = crosses % 2 == 1
    if not boundary:
        return inside
    # A cheap look at the edge's box first: few points need their distance.
    beside = lambda v, a, b: (v >= F.least(a, b) - slack) & (v <= F.greatest(a, b) + slack)
    return inside | F.exists(edges, lambda e: beside(px, e["ax"], e["bx"]) & beside(py, e["ay"], e["by"]) & (segment_distance(px, py, e["ax"], e["ay"], e["bx"], e["by"]) <= slack))


def ring_area(ring: Column) -> Column:
    """signed area of a ring."""
    each = F.transform(ring, lambda p, i: p["x"] * F.get(ring, (i + 1) % F.size(ring))["y"] - F.get(ring, (i + 1) % F.size(ring))["x"] * p["y"])
    return F.aggregate(each, F.lit(0.0), lambda s, v: s + v) / 2


def clipped_ring(ring: Column, x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    """the part of a ring within a box: its corners are folded over the box's four sides, one after the other.

    Exact for convex rings; where a box cuts a hollow ring in two, the parts hang together by a seam along the box's
    side, which has no area. Rings that miss the box come out empty.
    """

    def inside(p: Column, side: Column) -> Column:
        return F.when(side == 0, p["x"] - x0).when(side == 1, x1 - p["x"]).when(side == 2, p["y"] - y0).otherwise(y1 - p["y"])

    def cut(acc: Column, side: Column) -> Column:
        def corner(p: Column, i: Column) -> Column:
            before = F.element_at(acc, F.when(i == 0, F.lit(-1)).otherwise(i))
            d0, d1 = inside(before, side), inside(p, side)
            t = d0 / (d0 - d1)
            met = F.struct((before["x"] + t * (p["x"] - before["x"])).alias("x"), (before["y"] + t * (p["y"] - before["y"])).alias("y"))
            return F.when((d0 >= 0) & (d1 >= 0), F.array(p)).when(d1 >= 0, F.array(met, p)).when(d0 >= 0, F.array(met)).otherwise(F.array().cast("array<struct<x:double,y:double>>"))

        return F.flatten(F.transform(acc, corner))

    start = F.transform(ring, lambda p: F.struct(p["x"].cast("double").alias("x"), p["y"].cast("double").alias("y")))
    return F.aggregate(F.array(*[F.lit(k) for k in range(4)]), start, cut)


def turn(ax: Column, ay: Column, bx: Column, by: Column, cx: Column, cy: Column) -> Column:
    """Which way a path a, b, c turns: 1 left, -1 right, 0 straight on."""
    return F.signum(area2(ax, ay, bx, by, cx, cy))


def segments_meet(a: tuple[Column, ...], b: tuple[Column, ...], slack: float = 1e-9) -> Column:
    """Do two closed segments (ax, ay, bx, by) share a point? By orientations, and by distance where an end lies on the other."""
    p, q, r, s = a[:2], a[2:], b[:2], b[2:]
    across = (turn(*p, *q, *r) * turn(*p, *q, *s) < 0) & (turn(*r, *s, *p) * turn(*r, *s, *q) < 0)
    touch = [segment_distance(*e, *f) <= slack for e, f in ((r, a), (s, a), (p, b), (q, b))]
    return across | touch[0] | touch[1] | touch[2] | touch[3]


def segment_gap(a: tuple[Column, ...], b: tuple[Column, ...]) -> Column:
    """Metres between two segments: 0 where they meet, else from the nearest end."""
    ends = [segment_distance(*e, *f) for e, f in ((b[:2], a), (b[2:], a), (a[:2], b), (a[2:], b))]
    return F.when(segments_meet(a, b), 0.0).otherwise(F.least(*ends))


def halton(index: Column, base: int, digits: int = 20) -> Column:
    """the radical inverse of an index, digit by digit."""
    return F.aggregate(F.sequence(F.lit(0), F.lit(digits - 1)), F.lit(0.0), lambda s, k: s + F.floor(index / F.pow(F.lit(float(base)), k)) % base / F.pow(F.lit(float(base)), k + 1))


def with_corners(points: Column, x0: float, y0: float, x1: float, y1: float) -> Column:
    """points of the unit square (struct u, v) laid over a box, after its four corners."""
    corners = F.array(*[F.struct(F.lit(float(x)).alias("x"), F.lit(float(y)).alias("y")) for x in (x0, x1) for y in (y0, y1)])
    return F.concat(corners, F.transform(points, lambda p: F.struct((x0 + p["u"] * (x1 - x0)).alias("x"), (y0 + p["v"] * (y1 - y0)).alias("y"))))


def radial_points(rays: int, radii: list[float]) -> Column:
    """points on evenly spaced rays around an origin."""
    each = [(k * 2 * math.pi / rays, r) for k in range(rays) for r in radii]
    return F.array(*[F.struct(F.lit(r * math.cos(a)).alias("x"), F.lit(r * math.sin(a)).alias("y")) for a, r in each])


def ramp(share: Column, stops: list[tuple[float, tuple[int, int, int]]]) -> Column:
    """the colour of a share as ``#rrggbb``, straight between stops and even beyond them."""
    out = None
    for (a, one), (b, two) in zip(stops, stops[1:], strict=False):
        t = F.least(F.lit(1.0), F.greatest(F.lit(0.0), (share - a) / (b - a)))
        text = F.concat(F.lit("#"), *[F.lpad(F.lower(F.hex(F.round(x + t * (y - x)).cast("long"))), 2, "0") for x, y in zip(one, two, strict=True)])
        out = F.when(share <= b, text) if out is None else out.when(share <= b, text)
    return out.otherwise(F.lit("#" + "".join(f"{v:02x}" for v in stops[-1][1])))


def oriented(points: Column, ux: Column, uy: Column, vx: Column, vy: Column) -> Column:
    """an edge's geometry (array of struct x, y) from its start to its end: reversed where it runs the other way."""
    first, last = F.get(points, F.lit(0)), F.element_at(points, -1)
    own = planar(first["x"], first["y"], ux, uy) + planar(last["x"], last["y"], vx, vy)
    other = planar(first["x"], first["y"], vx, vy) + planar(last["x"], last["y"], ux, uy)
    return F.when(other < own, F.reverse(points)).otherwise(points)


def path_length(points: Column) -> Column:
    """metres along an array of struct x, y."""
    steps = F.transform(points, lambda p, i: F.when(i > 0, planar(p["x"], p["y"], F.get(points, i - 1)["x"], F.get(points, i - 1)["y"])).otherwise(0.0))
    return F.aggregate(steps, F.lit(0.0), lambda s, v: s + v)
