"""Queries that once read a part of their tables, against plain Python over all rows."""

from collections import Counter
from fractions import Fraction
from math import comb, hypot

from pyspark.sql import functions as F

from footfall.functions import stats
from footfall.plans import accuracy, assessment, spatial
from footfall.plans.demo import demo

SF = "/root/testdata/sf0.001"


def test_point_triangles(spark):
    corners = [(r.id, r.x, r.y) for r in demo(spark, SF, "facilities").collect()]
    want = {}
    for p in demo(spark, SF, "demand").select("id", "x", "y").collect():
        held = [t for t, x, y in corners if p.x >= x and p.y >= y and (p.x - x) + (p.y - y) <= 90]
        if held:
            want[p.id] = max(held)
    assert {r.id: r.triangle for r in assessment.QUERIES["point_triangles"](spark, SF).collect()} == want
    assert any(p % 10 for p in want)


def exact(wins, losses):
    n, low = wins + losses, min(wins, losses)
    return float(min(Fraction(1), Fraction(2 * sum(comb(n, i) for i in range(low + 1)), 2**n)))


def test_sign_test_of_large_counts(spark):
    pairs = [(0, 0), (0, 3), (1, 0), (5, 9), (40, 70), (900, 1000), (4000, 4100), (9000, 9000)]
    df = spark.createDataFrame(pairs, "w long, l long").select("w", "l", stats.sign_test(F.col("w"), F.col("l")).alias("p"))
    assert all(abs(r.p - exact(r.w, r.l)) < 1e-8 for r in df.collect())


def test_paired_sign_test(spark):
    split = {}
    for r in demo(spark, SF, "cases").collect():
        c = split.setdefault(r.stratum, Counter())
        if r.truth is not None:
            c[r.truth == r.prediction, r.truth == (r.duration <= 850)] += 1
    want = {s: (c[True, False], c[False, True]) for s, c in split.items()}
    got = {r.stratum: r for r in accuracy.QUERIES["paired_sign_test"](spark, SF).collect()}
    assert {s: (r.wins, r.losses) for s, r in got.items()} == want
    assert all(abs(r.p_value - exact(*want[s])) <= 1e-6 for s, r in got.items())


def test_edge_attachment(spark):
    nodes = {(r.gx, r.gy): r for r in demo(spark, SF, "nodes").collect()}
    edges = []
    for (gx, gy), a in nodes.items():
        for b in (nodes.get((gx + 1, gy)), nodes.get((gx, gy + 1))):
            # Motorways, foot=no and private ways, and walls and fences at an end, are no place to attach to.
            if b and a.size % 9 not in (5, 7, 8) and not {a.barrier, b.barrier} & {"wall", "fence"}:
                edges.append((a.id, b.id, a.x, a.y, b.x, b.y))
    want = {}
    for p in demo(spark, SF, "facilities").filter("x BETWEEN -100 AND 3100 AND y >= -100").collect():
        met = []
        for u, v, ax, ay, bx, by in edges:
            t = max(0, min(1, ((p.x - ax) * (bx - ax) + (p.y - ay) * (by - ay)) / 3600))
            m = round(hypot(p.x - ax - t * (bx - ax), p.y - ay - t * (by - ay)), 6)
            if m <= 50:
                met.append((m, u, v))
        if met:
            want[p.id] = min(met)
    assert {r.id: (r.m, r.u, r.v) for r in spatial.QUERIES["edge_attachment"](spark, SF).collect()} == want and want
