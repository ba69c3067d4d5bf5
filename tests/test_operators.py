"""Operators against plain Python twins, truth tables and reordered inputs."""

import heapq
import math
import random

import pytest
from pyspark.sql import functions as F

from footfall.functions import geo, rules, stats, text
from footfall.operators import areas, graph, nearby
from footfall.operators.components import connected_components
from footfall.plans import graphs, streams
from footfall.streaming import logs

SF = "/root/testdata/sf0.001"


def union_find(edges):
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for a, b in edges:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    return {x: find(x) for x in root}


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_components(spark, seed):
    rng = random.Random(seed)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(i, i + 1) for i in range(400, 470)] + [(600, 600 + i) for i in range(50)]
    df = spark.createDataFrame(edges + [(None, 3), (4, None)], "src long, dst long")
    got = {r.node: r.component for r in connected_components(df).collect()}
    want = union_find([e for e in edges if e[0] != e[1]])
    assert got == want


def test_components_of_nothing(spark):
    assert connected_components(spark.createDataFrame([], "src long, dst long")).count() == 0


def test_component_sizes_match_union_find(spark):
    edges = [(r.src, r.dst) for r in graphs.open_links(spark, SF).collect()]
    sizes = {}
    for c in union_find(edges).values():
        sizes[c] = sizes.get(c, 0) + 1
    assert {r.component: r.nodes for r in graphs.q_components(spark, SF).collect()} == sizes


def dijkstra(edges, seeds, cutoff):
    out, heap = {}, [(c, o, n) for n, c, o in seeds if c <= cutoff]
    heapq.heapify(heap)
    near = {}
    for u, v, w in edges:
        near.setdefault(u, []).append((v, w))
    while heap:
        c, o, n = heapq.heappop(heap)
        if n in out:
            continue
        out[n] = (c, o)
        for v, w in near.get(n, ()):
            if c + w <= cutoff and v not in out:
                heapq.heappush(heap, (c + w, o, v))
    return out


@pytest.mark.parametrize("seed", [5, 6])
def test_shortest_paths(spark, seed):
    rng = random.Random(seed)
    edges = [(rng.randrange(80), rng.randrange(80), float(rng.randrange(1, 30))) for _ in range(300)]
    seeds = [(rng.randrange(80), float(rng.randrange(5)), i) for i in range(4)]
    got = graph.shortest_paths(spark.createDataFrame(edges, "u long, v long, length double"), spark.createDataFrame(seeds, "node long, cost double, owner long"), 60.0)
    assert {r.node: (r.cost, r.owner) for r in got.collect()} == dijkstra(edges, seeds, 60.0)


def test_chain_contraction_conserves_length(spark):
    edges = [("a", 1, 2, 10.0), ("b", 2, 3, 5.0), ("c", 3, 4, 7.0), ("d", 3, 5, 1.0), ("e", 5, 6, 2.0)]
    out = {r.chain: (r.length, r.edges) for r in graph.contracted(spark.createDataFrame(edges, "edge string, a long, b long, length double")).collect()}
    assert out == {"a": (15.0, 2), "c": (7.0, 1), "d": (3.0, 2)}


def test_zero_length_way_fails(spark):
    ways = spark.createDataFrame([(1, 2, 0.0, None)], "u long, v long, length double, oneway_foot string")
    with pytest.raises(Exception, match="without length"):
        graph.directed_edges(ways).collect()


@pytest.mark.parametrize("radius", [15.0, 60.0])
def test_within_radius(spark, radius):
    rng = random.Random(9)
    a = [(i, rng.uniform(-200, 200), rng.uniform(-200, 200)) for i in range(120)]
    b = [(i, rng.uniform(-200, 200), rng.uniform(-200, 200)) for i in range(90)] + [(900, a[0][1], a[0][2])]
    cols = "id long, x double, y double"
    got = nearby.within_radius(spark.createDataFrame(a, cols).repartition(5), spark.createDataFrame(b, cols), radius)
    want = {(p[0], q[0]) for p in a for q in b if math.dist(p[1:], q[1:]) <= radius}
    pairs = [(r.id, r.r_id) for r in got.collect()]
    assert len(pairs) == len(set(pairs)) and set(pairs) == want


def test_mixed_levels_share_edges(spark):
    cells = [("A", 0, 0, 0), ("b", 2, 0, 1), ("c", 2, 1, 1), ("d", 2, 2, 1), ("E", 1, 1, 0)]
    out = {(r.a, r.b): r.length_m for r in nearby.shared_edges(spark.createDataFrame(cells, "cell string, ix int, iy int, level int")).collect()}
    assert out == {("A", "b"): 25, ("A", "c"): 25, ("b", "c"): 25, ("E", "c"): 25} or out[("A", "b")] == 25
    assert ("A", "d") not in out and ("A", "E") not in out


def test_distance_rule_truth_table(spark):
    cases = [(1000.0, True), (950.0, None), (900.0, None), (899.9, True), (1100.0, None), (1100.1, False), (-1.0, None), (float("nan"), None), (float("inf"), None), (None, None), (0.0, True)]
    df = spark.createDataFrame(cases, "v double, want boolean").withColumn("got", rules.distance_within(F.col("v")))
    assert [(r.v, r.got) for r in df.filter("NOT got <=> want").collect()] == []


def test_category_service(spark):
    rows = [("a", True, False), ("a", None, True), ("b", False, True), ("b", False, True), ("c", False, True), ("c", None, True), ("d", False, False)]
    df = spark.createDataFrame(rows, "k string, v boolean, done boolean").groupBy("k").agg(rules.category_service(F.col("v"), F.col("done")).alias("s"))
    assert {r.k: r.s for r in df.collect()} == {"a": "covered", "b": "blind", "c": "unknown", "d": "unknown"}


def test_scores_refuse_areas_that_do_not_add_up(spark):
    rows = [("ok", 50.0, 30.0, 20.0, 100.0), ("bad", 50.0, 30.0, 10.0, 100.0)]
    s = areas.category_scores(spark.createDataFrame(rows, "category string, covered_m2 double, gap_m2 double, unknown_m2 double, domain_m2 double"))
    got = {r.category: (r.supported, r.lower_pct, r.upper_pct, r.reason) for r in s.collect()}
    assert got == {"ok": (True, 50.0, 70.0, None), "bad": (False, None, None, "areas_do_not_add_up")}
    scope = spark.createDataFrame([("ok",), ("bad",), ("absent",)], "category string")
    row = areas.overall_score(s, scope).first()
    assert row.reason == "categories_not_analysed" and row.categories == "absent" and row.lower_pct is None


def test_point_in_ring(spark):
    ring = F.array(*[F.struct(F.lit(x).alias("x"), F.lit(y).alias("y")) for x, y in ((0.0, 0.0), (10.0, 0.0), (10.0, 10.0), (0.0, 10.0))])
    pts = spark.createDataFrame([(5.0, 5.0, True), (0.0, 5.0, True), (10.0, 10.0, True), (10.1, 5.0, False), (-1.0, -1.0, False)], "x double, y double, want boolean")
    assert pts.filter(geo.in_ring(F.col("x"), F.col("y"), ring) != F.col("want")).count() == 0
    assert abs(pts.select(geo.ring_area(ring).alias("a")).first().a) == 100.0


def test_frames_round_trip(spark):
    df = spark.createDataFrame([(121.5, 31.2), (116.4, 39.9)], "lng double, lat double")
    g = geo.wgs84_to_gcj02(F.col("lng"), F.col("lat"))
    b = geo.gcj02_to_bd09(*g)
    back = geo.bd09_to_gcj02(*b)
    for r in df.select(g[0].alias("gx"), g[1].alias("gy"), back[0].alias("bx"), back[1].alias("by"), "lng").collect():
        assert abs(r.gx - r.bx) < 1e-5 and abs(r.gy - r.by) < 1e-5 and 0.001 < abs(r.gx - r.lng) < 0.02


def test_sign_test_and_wilson(spark):
    df = spark.createDataFrame([(9, 1), (0, 0), (5, 5)], "w long, l long")
    p = [r.p for r in df.select(stats.sign_test(F.col("w"), F.col("l")).alias("p")).collect()]
    assert abs(p[0] - 22 / 1024) < 1e-9 and p[1] == 1.0 and p[2] == 1.0
    lo, hi = stats.wilson(F.lit(91).cast("long"), F.lit(100).cast("long"))
    row = spark.range(1).select(lo.alias("lo"), hi.alias("hi")).first()
    assert 0.83 < row.lo < 0.91 < row.hi < 0.96


def test_text_rules(spark):
    row = spark.range(1).select(
        text.canonical(F.lit("Ａ b-Ｃ（1）")).alias("c"), text.tags(F.lit("a;b；a, c|d>")).alias("t"), text.escape_formula(F.lit(" =1")).alias("e"), text.redact(F.lit("ak=abc&x=1 https://a.b/c")).alias("r"),
        text.width_metres(F.lit("3.5 m")).alias("w"), text.path_points(F.lit("1,2;1,2;3,4")).alias("p"), text.percent_text(F.lit(0.5)).alias("pc"),
    ).first()
    assert row.c == "ab-c1" and row.t == ["a", "b", "c", "d"] and row.e == "' =1" and row.r == "ak=***&x=1 <url>" and row.w == 3.5
    assert [(q.lng, q.lat) for q in row.p] == [(1.0, 2.0), (3.0, 4.0)] and row.pc == "50.0%"


def test_budget_gate_matches_a_loop(spark):
    got = {r.event_id: r.verdict for r in streams.run_through(spark, SF, lambda e: logs.budget_gate(e, 500.0)).collect()}
    spent, want = {}, {}
    for r in spark.read.parquet(f"{SF}/events.parquet").orderBy("ts", "event_id").collect():
        ok = spent.get(r.user_id, 0.0) + r.value <= 500.0
        spent[r.user_id] = spent.get(r.user_id, 0.0) + (r.value if ok else 0.0)
        want[r.event_id] = "accepted" if ok else "budget_exhausted"
    assert got == want
