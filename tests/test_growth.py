"""Work that must not grow faster than the input: plans, and operators against plain Python on crowded tables."""

import math
import random

import math
import random

from pyspark.sql import functions as F

from footfall.operators import graph, grid, nearby, obstacles, rasters
from footfall.plans import assessment, fields

SF = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_rings_are_not_broadcast(spark):
    ring = lambda r: F.array(*[F.struct((F.col("id") * 0.0 + dx * r).alias("x"), F.lit(float(dy * r)).alias("y")) for dx, dy in ((1, 0), (0, 1), (-1, 0), (0, -1))])
    a, b = (spark.range(40).select(F.col("id").alias("k"), ring(r).alias("ring")) for r in (100, 120))
    out = rasters.boundary_distances(a, b, "k", 20.0)
    assert "Broadcast" not in plan(out)
    per = {r.k: (r.n, r.m) for r in out.groupBy("k").agg(F.count("*").alias("n"), F.max("m").alias("m")).collect()}
    assert per == {k: (4 * (8 + 9), 20.0) for k in range(40)}


def test_cells_of_areas_are_dealt_over_tasks(spark):
    assert "REPARTITION_BY_NUM" in plan(assessment.QUERIES["cells_of_areas"](spark, SF))


def test_nearest_meets_few_rows(spark, monkeypatch):
    rng = random.Random(3)
    spots = [(i, rng.choice("ab"), rng.randrange(60), rng.randrange(60)) for i in range(1500)] + [(1500, "a", 390, 40), (1501, "b", 30, 30), (1502, "b", 30, 30)]
    keys = [(k, rng.choice("ab"), rng.randrange(-30, 90), rng.randrange(-30, 90)) for k in range(200)] + [(200, "a", 400, 40), (201, "b", 330, 40), (202, "a", 100000, 0), (203, "b", 30, 30)]
    left, right = spark.createDataFrame(keys, "k long, c string, x long, y long"), spark.createDataFrame(spots, "id long, c string, x long, y long")
    met = []
    plain = nearby.within_radius

    def counted(*args, **more):
        pairs = plain(*args, **more)
        met.append(pairs.count())
        return pairs

    monkeypatch.setattr(nearby, "within_radius", counted)
    for n in (1, 3):
        met.clear()
        got = {(r.k, r["rank"]): (r.r_id, r.distance_m) for r in nearby.nearest(left, right, ["k"], 120.0, "id", on=("c",), n=n).collect()}
        want = {}
        for k, c, x, y in keys:
            near = sorted((math.sqrt((x - a) ** 2 + (y - b) ** 2), i) for i, kind, a, b in spots if kind == c)
            want.update({(k, place + 1): (i, d) for place, (d, i) in enumerate(near[:n]) if d <= 120})
        assert got == want
        assert sum(met) < 25_000  # of some 125,000 within 120 m


def test_areas_are_dealt_over_tasks(spark):
    ring = F.array(*[F.struct((F.col("id") + dx).cast("double").alias("x"), F.lit(float(dy)).alias("y")) for dx, dy in ((0, 0), (30, 0), (30, 30), (0, 30))])
    areas = spark.range(3, numPartitions=1).select("id", ring.alias("ring"))
    for step in (grid.cell_parts, grid.blocks_meeting):
        assert "REPARTITION_BY_NUM" in plan(step(areas, "ring", 10.0))


def test_parts_of_a_segment_are_not_gathered(spark):
    ring = F.array(*[F.struct((F.col("id") + dx).cast("double").alias("x"), F.lit(float(dy)).alias("y")) for dx, dy in ((0, -5), (30, -5), (30, 5), (0, 5))])
    areas = spark.range(0, 60, 20).union(spark.range(0, 60, 20)).union(spark.range(200, 201)).select("id", ring.alias("ring"))
    line = spark.createDataFrame([(1, -10.0, 0.0, 290.0, 0.0), (2, 0.0, 90.0, 9.0, 90.0)], "k long, ax double, ay double, bx double, by_ double")
    out = obstacles.covered_lengths(line, areas, ["k"], "id", 25.0)
    assert "collect_list" not in plan(out) and "REPARTITION_BY_NUM" in plan(out)
    assert {r.k: round(r.covered_m, 6) for r in out.collect()} == {1: 100.0, 2: 0.0}


def test_graph_is_read_once_and_not_broadcast(spark):
    nodes = spark.range(20).select("id", F.lit(None).cast("string").alias("barrier"))
    edges = spark.range(19).select(F.col("id").alias("u"), (F.col("id") + 1).alias("v"), F.lit(1.0).alias("length"), *[F.lit(t).alias(n) for n, t in (("highway", "path"), ("foot", "yes"), ("access", "yes"))])
    seen = graph.views(nodes, edges)
    assert "Broadcast" not in plan(seen)
    assert seen.count() == 38


def test_leaves_and_samples_read_the_demand_once(spark, monkeypatch):
    read, demo = [], fields.demo
    monkeypatch.setattr(fields, "demo", lambda *args: read.append(args[2]) or demo(*args))
    for name in ("cell_priorities", "side_candidates"):
        read.clear()
        out = fields.QUERIES[name](spark, SF)
        assert read == ["demand"] and "FileScan" not in plan(out)
