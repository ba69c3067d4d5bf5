"""Counts and maxima over places without pairs, against plain Python, and the plans that use them."""

import math
import random

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from footfall.operators import obstacles, sweeps
from footfall.plans import assessment, barriers, spatial
from tests.test_agreement import _beside
from tests.test_barriers import _inside
from tests.test_growth import plan

SF = "/root/testdata/sf0.001"


def test_counts_within_crowded_and_odd_places(spark):
    rng = random.Random(4)
    spot = lambda n: [(i, *(float(rng.randint(-40, 40)) if rng.random() < 0.5 else rng.uniform(-40, 40) for _ in "xy")) for i in range(n)]
    # Copies, a place on the very edge, and rows without a place.
    points, features = [*spot(150), (900, 0.0, 0.0), (901, 0.0, 0.0), (902, None, 1.0), (903, math.nan, 1.0), (904, 5e6, 5e6)], [*spot(150), *[(901 + i, 12.0, 16.0) for i in range(3)], (905, 0.0, None), (906, math.inf, 0.0)]
    want = {}
    for i, x, y in points:
        d = [math.sqrt((x - u) ** 2 + (y - v) ** 2) for _, u, v in features if None not in (x, y, u, v)]
        if any(m <= 20 for m in d):
            want[i] = sum(m <= 7.5 for m in d), sum(m <= 20 for m in d)
    p, f = (spark.createDataFrame(rows, "id long, x double, y double") for rows in (points, features))
    kept = sweeps.SHARE
    try:
        for sweeps.SHARE in (kept, 16):  # a square in one part, and in several
            got = sweeps.counts_within(p, f, {"a": 7.5, "b": 20.0})
            assert {r.id: (r.a, r.b) for r in got.collect()} == want and want[900][1] >= 3
            assert got.count() == len(want)
    finally:
        sweeps.SHARE = kept


def test_last_triangle_of_any_shape(spark):
    rng = random.Random(5)
    shapes = [(i, *(float(rng.randint(-30, 30)) if rng.random() < 0.7 else rng.uniform(-30, 30) for _ in range(6))) for i in range(60)] + [(60, 1.0, 1.0, 1.0, 1.0, 5.0, 5.0)]
    points = [(i, float(rng.randint(-30, 30)), float(rng.randint(-30, 30)) if i % 2 else rng.uniform(-30, 30)) for i in range(300)] + [(300 + n, *shapes[n][1:3]) for n in range(20)]
    want = {}
    for i, x, y in points:
        for o, ax, ay, bx, by, cx, cy in shapes:
            area = lambda px, py, qx, qy, rx, ry: (qx - px) * (ry - py) - (rx - px) * (qy - py)
            w = area(ax, ay, bx, by, cx, cy)
            if w and all(v / w >= 0 for v in (area(x, y, bx, by, cx, cy), area(ax, ay, x, y, cx, cy), area(ax, ay, bx, by, x, y))):
                want[i] = o
    p = spark.createDataFrame(points, "id long, x double, y double")
    t = spark.createDataFrame(shapes, "ord long, ax double, ay double, bx double, by_ double, cx double, cy double")
    kept = sweeps.SHARE
    try:
        for sweeps.SHARE in (kept, 16):
            assert {r.id: r.triangle for r in sweeps.last_triangle(p, t, 25.0).collect()} == want and want
    finally:
        sweeps.SHARE = kept


def test_no_pairs_are_made(spark):
    """The joins left are those of squares and of places, on keys that one row of a side holds."""
    for query in (spatial.QUERIES["risk_proximity"], assessment.QUERIES["point_triangles"]):
        assert "FlatMapCoGroupsInPandas" in plan(query(spark, SF))


def test_counts_of_one_place(spark):
    one = spark.range(1).select(F.lit(1.0).alias("x"), F.lit(2.0).alias("y"))
    assert [tuple(r) for r in sweeps.counts_within(one, one, {"n": 1.0}).collect()] == [(1.0, 2.0, 1)]


def _segments(rng, n):
    """Segments of few vectors, of any, without length, and long ones; half on a raster, so they share lines."""
    at = lambda: (float(rng.randint(0, 90)), float(rng.randint(0, 90))) if rng.random() < 0.5 else (rng.uniform(0, 90), rng.uniform(0, 90))
    vectors = [(12.0, 8.0), (-9.0, 15.0), (0.0, 10.0), (20.0, 0.0), (0.0, 0.0), (170.0, -60.0), (3.5, 0.25)]
    rows = []
    for i in range(n):
        (x, y), (u, v) = at(), rng.choice(vectors) if rng.random() < 0.8 else (rng.uniform(-30, 30), rng.uniform(-30, 30))
        rows.append((i, x, y, x + u, y + v))
    return rows + [(n, *rows[0][1:]), (n + 1, None, 1.0, 2.0, 3.0)]


def test_walls_are_counted_as_pairs_are(spark):
    rng = random.Random(11)
    links = spark.createDataFrame(_segments(rng, 150), "id long, ax double, ay double, bx double, by_ double")
    lines = [[(rng.uniform(0, 90), rng.uniform(0, 90)) for _ in range(rng.randint(2, 4))] for _ in range(25)] + [[(10.0, 10.0), (10.0, 10.0)], [(40.0, 0.0), (40.0, 300.0)], [(0.0, 30.0), (300.0, 30.0), (0.0, 30.0)]]
    rows = [(n, w, *a, *b) for n, line in enumerate(lines) for w in (rng.choice([0.0, 3.0, 14.0, 60.0]),) for a, b in zip(line, line[1:], strict=False)]
    walls = spark.createDataFrame([*rows, (90, None, 0.0, 0.0, 90.0, 90.0), (91, -1.0, 0.0, 0.0, 90.0, 90.0)], "wall long, width double, ax double, ay double, bx double, by_ double")
    pairs = {}
    for r in obstacles.crossed_lines(links, walls, "id", "wall", "width", 20.0).collect():
        pairs[r.id] = pairs.get(r.id, 0) + 1
    pairs.pop(151, None)  # it has but one end
    kept = sweeps.SHARE, sweeps.CHUNK
    try:
        for sweeps.SHARE, sweeps.CHUNK in (kept, (8, 5)):  # a square in one part, and in several
            got = {r.id: r.walls for r in obstacles.crossed_counts(links, walls, "id", "wall", "width", 10.0).collect()}
            assert got == {i: pairs.get(i, 0) for i in range(152)} and max(got.values()) > 8
    finally:
        sweeps.SHARE, sweeps.CHUNK = kept


def test_water_on_a_line_is_met_once(spark):
    rng = random.Random(12)
    rows = _segments(rng, 120)
    rings = []
    for n in range(14):
        x, y, flat = rng.randint(0, 90), rng.randint(0, 90), n % 2 == 0
        corners = [(x + rng.randint(4, 25) * math.cos(a), y + rng.randint(4, 25) * math.sin(a)) for a in sorted(rng.uniform(0, 6.28) for _ in range(rng.randint(3, 6)))]
        rings.append([(float(round(a)), float(round(b))) for a, b in corners] if flat else corners[::-1])
    rings += [rings[0], [(20.0, 20.0), (60.0, 20.0), (60.0, 50.0), (20.0, 50.0)]]  # a copy, and sides that segments run along
    areas = spark.createDataFrame([(n, [{"x": x, "y": y} for x, y in ring]) for n, ring in enumerate(rings)], "area long, ring array<struct<x:double,y:double>>")
    links = spark.createDataFrame(rows, "id long, ax double, ay double, bx double, by_ double")
    want = {121: None}
    for i, ax, ay, bx, by in rows[:-1]:
        cuts = {0.0, 1.0}
        for ring in rings:
            for (px, py), (qx, qy) in zip(ring, ring[1:] + ring[:1], strict=True):
                cross = (bx - ax) * (qy - py) - (by - ay) * (qx - px)
                if cross and 0 < (t := ((px - ax) * (qy - py) - (py - ay) * (qx - px)) / cross) < 1:
                    cuts.add(t)
        cuts, middle = sorted(cuts), lambda s, t: (ax + (s + t) / 2 * (bx - ax), ay + (s + t) / 2 * (by - ay))  # noqa: B023
        want[i] = round(math.dist((ax, ay), (bx, by)) * sum(t - s for s, t in zip(cuts, cuts[1:], strict=False) if t - s > 1e-12 and any(_inside(middle(s, t), ring) for ring in rings)), 6)
    kept = sweeps.SHARE, sweeps.CHUNK
    try:
        for sweeps.SHARE, sweeps.CHUNK in (kept, (8, 5)):
            got = {r.id: r.covered_m if r.covered_m is None else round(r.covered_m, 6) for r in obstacles.covered_lengths(links, areas, ["id"], "area", 10.0).collect()}
            assert got.keys() == want.keys() and all(got[i] == m or abs(got[i] - m) < 2e-6 for i, m in want.items())
    finally:
        sweeps.SHARE, sweeps.CHUNK = kept


def test_connectors_meet_no_obstacles_in_pairs(spark, monkeypatch):
    assert plan(barriers.QUERIES["blocked_connectors"](spark, SF)).count("FlatMapCoGroupsInPandas") >= 2
    # A hundred connectors on one line are one line for an area, and in one column of starts one run for a wall.
    made, plain = [], sweeps._expanded
    monkeypatch.setattr(sweeps, "_expanded", lambda first, many: made.append(int(many.sum())) or plain(first, many))
    links = pd.DataFrame([(float(i), 2.0 * i, i + 3.0, 2.0 * i + 6.0) for i in range(100)], columns=sweeps.SEGMENT)
    areas = pd.DataFrame([(np.array([0.0, 100.0, 100.0, 0.0]), np.array([0.0, 0.0, 100.0, 100.0]))] * 50, columns=["xs", "ys"])
    walls = pd.DataFrame([(n, 2.0, 0.0, 90.0, 40.0, 90.0) for n in range(30)], columns=["line", "half", *sweeps.SEGMENT])
    assert len(sweeps.shares_held(links, areas)) == 50
    assert set(sweeps.lines_met(links.assign(ax=5.0, bx=8.0), walls)["n"]) == {30}
    assert made == [100, 30]  # pairs: 5000 and 3000


def test_a_connector_given_twice_is_two_rows(spark, tmp_path):
    twice = spark.read.parquet(f"{SF}/customer.parquet").filter("c_custkey < 60")
    assert len(_beside(spark, tmp_path, {"customer": twice.union(twice)}, barriers, "blocked_connectors")) == 120
