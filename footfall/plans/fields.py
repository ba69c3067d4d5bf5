"""Time fields over rasters, quadtree refinement, and parts of areas within cells."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from footfall.functions import geo
from footfall.operators import accuracy, field, grid, quadtree, rasters
from footfall.plans.demo import Registry, demo
from footfall.session import checkpointed, table

R = Registry()
QUERIES, SQL = R.queries, R.sql

#: The raster of the demonstration town: nodes every 25 m over its 4 km.
X0, STEP, NODES = -2000.0, 25.0, 161

TRIANGLES = """
tri AS (SELECT id AS ord, x AS ax, y AS ay, (id * 37) % 1200 AS ta, x + 140 AS bx, y + 40 AS by_, (id * 91) % 1200 AS tb, x + 50 AS cx, y + 130 AS cy, CASE WHEN id % 19 <> 0 THEN (id * 53) % 1200 END AS tc FROM facilities),
held AS (
  SELECT t.*, i, j, (bx - (i * 25.0 - 2000)) * (cy - (j * 25.0 - 2000)) - (cx - (i * 25.0 - 2000)) * (by_ - (j * 25.0 - 2000)) AS u,
    ((i * 25.0 - 2000) - ax) * (cy - ay) - (cx - ax) * ((j * 25.0 - 2000) - ay) AS v, (bx - ax) * ((j * 25.0 - 2000) - ay) - ((i * 25.0 - 2000) - ax) * (by_ - ay) AS w
  FROM (SELECT *, unnest(range(greatest(0, CAST(floor((ax + 2000) / 25.0) AS BIGINT)), least(160, CAST(ceil((bx + 2000) / 25.0) AS BIGINT)) + 1)) AS i FROM tri WHERE tc IS NOT NULL) t,
    unnest(range(greatest(0, CAST(floor((ay + 2000) / 25.0) AS BIGINT)), least(160, CAST(ceil((cy + 2000) / 25.0) AS BIGINT)) + 1)) AS r(j)
),
node AS (
  SELECT i, j, arg_max(CAST(u AS DOUBLE) / (u + v + w) * ta + CAST(v AS DOUBLE) / (u + v + w) * tb + CAST(w AS DOUBLE) / (u + v + w) * tc, ord) AS seconds
  FROM held WHERE u >= 0 AND v >= 0 AND w >= 0 GROUP BY i, j
)"""
CELLS = (
    TRIANGLES
    + """,
cell AS (
  SELECT c.i, c.j, a.seconds AS t00, b.seconds AS t10, d.seconds AS t01, e.seconds AS t11
  FROM (SELECT DISTINCT i - di AS i, j - dj AS j FROM node, (VALUES (0), (1)) x(di), (VALUES (0), (1)) y(dj) WHERE i - di BETWEEN 0 AND 159 AND j - dj BETWEEN 0 AND 159) c
  LEFT JOIN node a ON a.i = c.i AND a.j = c.j LEFT JOIN node b ON b.i = c.i + 1 AND b.j = c.j
  LEFT JOIN node d ON d.i = c.i AND d.j = c.j + 1 LEFT JOIN node e ON e.i = c.i + 1 AND e.j = c.j + 1
),
mid AS (SELECT *, (t00 + t10 + t01 + t11) / 4 AS m FROM cell)"""
)


def triangles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One slanted triangle per facility, a time at each corner; every nineteenth has an unknown one."""
    f = demo(spark, sf_dir, "facilities")
    i, x, y = F.col("id"), F.col("x"), F.col("y")
    corners = {"ax": x, "ay": y, "at": i * 37 % 1200, "bx": x + 140, "by": y + 40, "bt": i * 91 % 1200, "cx": x + 50, "cy": y + 130, "ct": F.when(i % 19 != 0, i * 53 % 1200)}
    return f.select(i.alias("ord"), *[c.alias(n) for n, c in corners.items()])


def cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return field.field_cells(field.node_times(triangles(spark, sf_dir), X0, X0, STEP, NODES, NODES), NODES, NODES)


@R.add("time_field", f"WITH {TRIANGLES} SELECT i, j, round(seconds, 6) AS seconds FROM node", ("facilities",))
def q_time_field(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The time at every raster node that a triangle holds, the last of several."""
    nodes = field.node_times(triangles(spark, sf_dir), X0, X0, STEP, NODES, NODES)
    return nodes.select("i", "j", F.round("seconds", 6).alias("seconds"))


@R.add(
    "field_bands",
    f"""WITH {CELLS}
SELECT i, j, CASE WHEN m IS NULL THEN 'halo' ELSE 'known' END AS state, round(m, 6) AS seconds, CASE WHEN m <= 300 THEN 5 WHEN m <= 600 THEN 10 WHEN m <= 900 THEN 15 END AS band FROM mid""",
    ("facilities",),
)
def q_field_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells of the field by band of 5, 10 and 15 minutes, and the halo of cells that touch an unknown node."""
    return field.field_bands(cells(spark, sf_dir), [5, 10, 15]).withColumn("seconds", F.round("seconds", 6))


@R.add(
    "reached_areas",
    f"""WITH {CELLS},
part AS (SELECT i, j, greatest(t00, t10, t01, t11) AS top, least(t00, t10, t01, t11) AS bottom, unnest([[t00, t10, m], [t10, t11, m], [t11, t01, m], [t01, t00, m]]) AS t FROM mid WHERE m IS NOT NULL),
s AS (SELECT i, j, top, bottom, minutes, minutes * 60e0 AS z, list_sort(t) AS t FROM part, (VALUES (5), (10), (15)) v(minutes)),
a AS (SELECT minutes, i, j, top <= z AS whole, bottom <= z AND top > z AS cut,
  CASE WHEN z >= t[3] THEN 1e0 WHEN z <= t[1] THEN 0e0 WHEN z < t[2] THEN (z - t[1]) ** 2 / ((t[2] - t[1]) * (t[3] - t[1])) ELSE 1 - (t[3] - z) ** 2 / ((t[3] - t[1]) * (t[3] - t[2])) END / 4 AS share FROM s)
SELECT minutes, count(*) FILTER (WHERE whole) // 4 AS whole, count(*) FILTER (WHERE cut) // 4 AS cut, round(sum(share * 625), 3) AS area_m2 FROM a GROUP BY minutes""",
    ("facilities",),
)
def q_reached_areas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Area within 5, 10 and 15 minutes, cut along the line of equal time."""
    return field.reached_areas(cells(spark, sf_dir), [5, 10, 15], STEP * STEP).withColumn("area_m2", F.round("area_m2", 3))


@R.add(
    "contour_segments",
    f"""WITH {TRIANGLES},
side AS (SELECT ord, k, px + s * (qx - px) AS x, py + s * (qy - py) AS y FROM (
  SELECT ord, k, px, py, qx, qy, pt, qt, (900 - pt) / CAST(nullif(qt - pt, 0) AS DOUBLE) AS s FROM (
    SELECT ord, 1 AS k, ax AS px, ay AS py, ta AS pt, bx AS qx, by_ AS qy, tb AS qt FROM tri WHERE tc IS NOT NULL UNION ALL SELECT ord, 2, bx, by_, tb, cx, cy, tc FROM tri WHERE tc IS NOT NULL UNION ALL SELECT ord, 3, cx, cy, tc, ax, ay, ta FROM tri WHERE tc IS NOT NULL) e)
  WHERE (pt <= 900) <> (qt <= 900))
SELECT a.ord, round(a.x, 6) AS x1, round(a.y, 6) AS y1, round(b.x, 6) AS x2, round(b.y, 6) AS y2 FROM side a JOIN side b ON a.ord = b.ord AND a.k < b.k""",
    ("facilities",),
)
def q_contours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """the line of 900 seconds through every triangle that it crosses."""
    return field.contour_segments(triangles(spark, sf_dir), 900.0).select("ord", *[F.round(c, 6).alias(c) for c in ("x1", "y1", "x2", "y2")])


#: Samples on a grid of 50 m, some unknown, some active; leaves of 400 m, halved where the demand in them says so.
LEAVES = """
smp AS (SELECT sx AS x, sy AS y, CASE WHEN min(owner) % 11 <> 0 THEN min(CAST(floor(price) AS BIGINT)) % 1800 END AS t, min(owner) % 13 = 0 AS active
  FROM (SELECT *, CAST(floor((x + 25) / 50.0) AS BIGINT) * 50 AS sx, CAST(floor((y + 25) / 50.0) AS BIGINT) * 50 AS sy FROM demand) d GROUP BY sx, sy),
c0 AS (SELECT CAST(floor((x + 2000) / 400.0) AS BIGINT) AS ix, CAST(floor((y + 2000) / 400.0) AS BIGINT) AS iy, min(id) % 3 = 0 AS split FROM demand WHERE x < 2000 GROUP BY ALL),
c1 AS (SELECT CAST(floor((x + 2000) / 200.0) AS BIGINT) AS ix, CAST(floor((y + 2000) / 200.0) AS BIGINT) AS iy, min(id) % 2 = 0 AS split FROM demand WHERE x < 2000 GROUP BY ALL),
leaf AS (
  SELECT 0 AS level, ix, iy FROM c0 WHERE NOT split
  UNION ALL SELECT 1, c1.ix, c1.iy FROM c1 JOIN c0 ON c0.ix = c1.ix // 2 AND c0.iy = c1.iy // 2 WHERE c0.split AND NOT c1.split
  UNION ALL SELECT 2, c1.ix * 2 + a, c1.iy * 2 + b FROM c1 JOIN c0 ON c0.ix = c1.ix // 2 AND c0.iy = c1.iy // 2, (VALUES (0), (1)) u(a), (VALUES (0), (1)) v(b) WHERE c0.split AND c1.split
),
box AS (SELECT *, 400 // (1 << level) AS size, -2000 + ix * (400 // (1 << level)) AS x0, -2000 + iy * (400 // (1 << level)) AS y0 FROM leaf),
met AS (
  SELECT b.*, s.x, s.y, s.t, s.active, s.x = x0 AS l, s.x = x0 + size AS r, s.y = y0 AS d, s.y = y0 + size AS u, s.x * 2 = 2 * x0 + size AND s.y * 2 = 2 * y0 + size AS mid
  FROM box b JOIN smp s ON s.x BETWEEN x0 AND x0 + size AND s.y BETWEEN y0 AND y0 + size
  WHERE s.x = x0 OR s.x = x0 + size OR s.y = y0 OR s.y = y0 + size OR (s.x * 2 = 2 * x0 + size AND s.y * 2 = 2 * y0 + size)
)"""


def squares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The demand in squares of 25 m, of which both the cells and the samples' squares are made: one pass over the table for all of them."""
    at = lambda c: F.floor((F.col(c) + 2000) / 25.0).cast("long").alias(f"q{c}")
    per = demo(spark, sf_dir, "demand").groupBy(at("x"), at("y"))
    return checkpointed(per.agg(F.min("id").alias("id"), F.min("owner").alias("owner"), F.min(F.floor("price").cast("long")).alias("price")))


def samples(squares: DataFrame) -> DataFrame:
    snap = lambda c: (F.floor((F.col(f"q{c}") + 1) / 2) * 50 - 2000).cast("long").alias(c)
    per = squares.groupBy(snap("x"), snap("y")).agg(F.min("owner").alias("o"), F.min("price").alias("p"))
    return per.select("x", "y", F.when(F.col("o") % 11 != 0, F.col("p") % 1800).alias("t"), (F.col("o") % 13 == 0).alias("active"))


def leaves(squares: DataFrame) -> DataFrame:
    d = squares.filter("qx < 160")  # x < 2000
    at = lambda c, size: F.floor(F.col(f"q{c}") / (size / 25)).cast("long").alias(f"i{c}")
    c0 = d.groupBy(at("x", 400), at("y", 400)).agg((F.min("id") % 3 == 0).alias("split"))
    c1 = d.groupBy(at("x", 200), at("y", 200)).agg((F.min("id") % 2 == 0).alias("split"))
    open_ = c0.filter("split").select(quadtree.morton(F.col("ix"), F.col("iy")).alias("up"))
    c1 = c1.withColumn("up", quadtree.parent(quadtree.morton(F.col("ix"), F.col("iy")))).join(open_, "up", "left_semi").withColumn("level", F.lit(1))
    halves = grid.children(c1.filter("split").select("ix", "iy", "level"))
    first = c0.filter("NOT split").select(F.lit(0).alias("level"), "ix", "iy")
    return first.unionByName(c1.filter("NOT split").select("level", "ix", "iy")).unionByName(halves.select("level", "ix", "iy"))


def leaf_samples(squares: DataFrame) -> DataFrame:
    return quadtree.cell_samples(leaves(squares), samples(squares), X0, X0, 400.0, 3)


@R.add(
    "cell_priorities",
    f"""WITH {LEAVES},
per AS (SELECT b.level, b.ix, b.iy, b.size, min(t) AS lo, max(t) AS hi, min(abs(t - 900)) AS near, max(CASE WHEN mid THEN t END) AS m,
  avg(CASE WHEN (l OR r) AND (d OR u) THEN t END) AS mean, count(CASE WHEN (l OR r) AND (d OR u) THEN t END) AS corners FROM box b LEFT JOIN met USING (level, ix, iy) GROUP BY ALL),
f AS (SELECT *, CASE WHEN corners = 4 AND m IS NOT NULL THEN abs(m - mean) ELSE 0e0 END AS residual FROM per)
SELECT level, ix, iy, round(CASE WHEN lo IS NULL THEN 0e0 ELSE size / 400e0 * (4 * CAST(lo <= 900 AND hi > 900 AS INT) + 2 * greatest(0e0, 1 - near / 120e0) + 2 * least(residual / 120e0, 1e0) + least((hi - lo) / 300e0, 1e0)) END, 6) AS score,
  coalesce(lo IS NOT NULL AND ((lo <= 900 AND hi > 900) OR near <= 120 OR residual > 60 OR hi - lo > 300), FALSE) AS candidate, round(CASE WHEN lo IS NULL THEN 0e0 ELSE residual END, 6) AS residual FROM f""",
    ("demand",),
)
def q_priorities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How much every leaf of the quadtree asks to be halved: crossing, near, residual of its middle, span."""
    d = squares(spark, sf_dir)
    out = quadtree.priorities(leaves(d), leaf_samples(d), 400.0, 900.0, 120.0)
    return out.select("level", "ix", "iy", F.round("score", 6).alias("score"), "candidate", F.round("residual", 6).alias("residual"))


@R.add(
    "side_candidates",
    f"""WITH {LEAVES},
side AS (
  SELECT level, ix, iy, 'l' AS s, y AS along, x, y, t, active FROM met WHERE l UNION ALL SELECT level, ix, iy, 'r', y, x, y, t, active FROM met WHERE r
  UNION ALL SELECT level, ix, iy, 'd', x, x, y, t, active FROM met WHERE d UNION ALL SELECT level, ix, iy, 'u', x, x, y, t, active FROM met WHERE u),
pair AS (SELECT x, y, t, lead(x) OVER w AS bx, lead(y) OVER w AS by_, lead(t) OVER w AS tb, count(*) FILTER (WHERE active) OVER (PARTITION BY level, ix, iy, s) AS settled FROM side WINDOW w AS (PARTITION BY level, ix, iy, s ORDER BY along)),
c AS (SELECT *, greatest(1e-1, least(9e-1, (900 - t) / CAST(tb - t AS DOUBLE))) AS a FROM pair WHERE settled < 2 AND (t <= 900) <> (tb <= 900)),
p AS (SELECT DISTINCT round(x + a * (bx - x), 8) AS x, round(y + a * (by_ - y), 8) AS y FROM c)
SELECT p.x, p.y FROM p WHERE NOT EXISTS (SELECT 1 FROM smp s WHERE abs(s.x - p.x) < 12 AND abs(s.y - p.y) < 12 AND sqrt((s.x - p.x) ** 2 + (s.y - p.y) ** 2) < 12 - 1e-8)""",
    ("demand",),
)
def q_side_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Interpolated crossings on the sides of leaves, 12 m from every sample at least."""
    d = squares(spark, sf_dir)
    return quadtree.edge_candidates(leaf_samples(d), samples(d), 900.0, 12.0)


def domains(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One slanted four-cornered area per supplier."""
    s = table(spark, sf_dir, "supplier")
    k, x, y = F.col("s_suppkey"), F.col("s_suppkey") * 7919 % 3001 - 1500, F.col("s_suppkey") * 104729 % 2999 - 1500
    ring = F.array(*[F.struct((x + dx).alias("x"), (y + dy).alias("y")) for dx, dy in ((0, 0), (230, 45), (190, 170), (-35, 120))])
    return s.select(k.alias("id"), x.alias("x"), y.alias("y"), ring.alias("ring"))


@R.add(
    "domain_parts",
    """
WITH d AS (SELECT s_suppkey AS id, s_suppkey * 7919 % 3001 - 1500 AS x, s_suppkey * 104729 % 2999 - 1500 AS y FROM supplier),
e AS (SELECT id, unnest([{ax: x, ay: y, bx: x + 230, by_: y + 45}, {ax: x + 230, ay: y + 45, bx: x + 190, by_: y + 170}, {ax: x + 190, ay: y + 170, bx: x - 35, by_: y + 120}, {ax: x - 35, ay: y + 120, bx: x, by_: y}], recursive := true) FROM d),
b AS (SELECT id, 100 * CAST(floor((x - 35) / 100.0) AS BIGINT) + 100 * i AS x0, 100 * CAST(floor(y / 100.0) AS BIGINT) + 100 * j AS y0 FROM d, range(0, 4) r(i), range(0, 3) s(j)),
-- The area under each side within the box, by the box's own limits: pieces between the places where the side meets them.
k AS (SELECT b.id, x0, y0, ax, ay, bx, by_, list_sort(list_distinct(list_concat([0e0, 1e0], list_filter([(x0 - ax) / CAST(nullif(bx - ax, 0) AS DOUBLE), (x0 + 100 - ax) / CAST(nullif(bx - ax, 0) AS DOUBLE), (y0 - ay) / CAST(nullif(by_ - ay, 0) AS DOUBLE), (y0 + 100 - ay) / CAST(nullif(by_ - ay, 0) AS DOUBLE)], lambda t: t > 0 AND t < 1)))) AS ts FROM b JOIN e USING (id)),
p AS (SELECT *, unnest(range(1, len(ts))) AS n FROM k),
q AS (SELECT id, x0, y0, (greatest(x0, least(x0 + 100, ax + ts[n + 1] * (bx - ax))) - greatest(x0, least(x0 + 100, ax + ts[n] * (bx - ax)))) * (greatest(y0, least(y0 + 100, ay + ts[n] * (by_ - ay))) + greatest(y0, least(y0 + 100, ay + ts[n + 1] * (by_ - ay))) - 2 * y0) / 2 AS piece FROM p),
a AS (SELECT id, CAST(floor(x0 / 100) AS BIGINT) AS cx, CAST(floor(y0 / 100) AS BIGINT) AS cy, -sum(piece) AS area FROM q GROUP BY ALL)
SELECT id, cx, cy, round(area, 4) AS area_m2 FROM a WHERE area > 1e-6""",
)
def q_domain_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The area of every domain within each cell that it meets, cut along the cell's sides."""
    d = domains(spark, sf_dir)
    covered = grid.cell_parts(d, "ring", 100.0)
    return covered.filter("area_m2 > 1e-6").select("id", "cx", "cy", F.round("area_m2", 4).alias("area_m2"))


@R.add(
    "first_round_blocks",
    """
WITH d AS (SELECT s_suppkey AS id, s_suppkey * 7919 % 3001 - 1500 AS x, s_suppkey * 104729 % 2999 - 1500 AS y FROM supplier),
c AS (SELECT id, unnest([[x, y], [x + 230, y + 45], [x + 190, y + 170], [x - 35, y + 120]]) AS p, x, y FROM d),
b AS (SELECT id, x, y, 100 * CAST(floor((x - 35) / 100.0) AS BIGINT) + 100 * i AS x0, 100 * CAST(floor(y / 100.0) AS BIGINT) + 100 * j AS y0 FROM d, range(0, 4) r(i), range(0, 3) s(j)),
-- Two convex shapes are apart where a side of either has all of the other on its far side.
t AS (SELECT id, x0, y0, x0 <= x + 230 AND x0 + 100 >= x - 35 AND y0 <= y + 170 AND y0 + 100 >= y
  AND NOT list_bool_or([list_max(list_transform([[x0, y0], [x0 + 100, y0], [x0 + 100, y0 + 100], [x0, y0 + 100]], lambda q: s.dx * (q[2] - s.ay) - s.dy * (q[1] - s.ax))) < 0
    for s in [{ax: x, ay: y, dx: 230, dy: 45}, {ax: x + 230, ay: y + 45, dx: -40, dy: 125}, {ax: x + 190, ay: y + 170, dx: -225, dy: -50}, {ax: x - 35, ay: y + 120, dx: 35, dy: -120}]]) AS meets FROM b)
SELECT id, CAST(count(*) AS BIGINT) AS blocks FROM t WHERE meets GROUP BY id""",
)
def q_first_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many square blocks meet each domain's true outline (sides and corners count)."""
    d = domains(spark, sf_dir)
    met = grid.blocks_meeting(d, "ring", 100.0)
    return met.groupBy("id").agg(F.count("*").alias("blocks"))


@R.add(
    "shape_topology",
    f"""WITH RECURSIVE {CELLS},
s AS (SELECT CAST(floor(x / 200.0) AS BIGINT) AS ix, CAST(floor(y / 200.0) AS BIGINT) AS iy FROM demand GROUP BY ALL HAVING min(owner) % 5 <> 0),
lim AS (SELECT min(ix) - 1 AS x0, max(ix) + 1 AS x1, min(iy) - 1 AS y0, max(iy) + 1 AS y1 FROM s),
r AS (SELECT ix, iy FROM lim, unnest(range(x0, x1 + 1)) a(ix), unnest(range(y0, y1 + 1)) b(iy) EXCEPT SELECT ix, iy FROM s),
w AS (SELECT ix AS a, iy AS b, ix, iy FROM s UNION SELECT w.a, w.b, s.ix, s.iy FROM w JOIN s ON abs(s.ix - w.ix) + abs(s.iy - w.iy) = 1),
part AS (SELECT ix, iy, min(a * 1000 + b) AS label FROM w GROUP BY ix, iy),
f AS (SELECT x0 AS ix, y0 AS iy FROM lim UNION SELECT r.ix, r.iy FROM f JOIN r ON abs(r.ix - f.ix) <= 1 AND abs(r.iy - f.iy) <= 1),
c AS (SELECT * FROM r EXCEPT SELECT * FROM f),
v AS (SELECT ix AS a, iy AS b, ix, iy FROM c UNION SELECT v.a, v.b, c.ix, c.iy FROM v JOIN c ON abs(c.ix - v.ix) <= 1 AND abs(c.iy - v.iy) <= 1),
hole AS (SELECT ix, iy, min(a * 1000 + b) AS label FROM v GROUP BY ix, iy)
SELECT (SELECT count(DISTINCT label) FROM part) AS components, (SELECT count(DISTINCT label) FROM hole) AS holes, round(1 - (SELECT count(*) FROM mid WHERE m IS NOT NULL) / 25600e0, 9) AS unknown_share""",
    ("facilities", "demand"),
)
def q_topology(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components and holes of a shape of cells, and the share of the field that is unknown."""
    at = [F.floor(F.col(c) / 200.0).cast("long").alias(f"i{c}") for c in "xy"]
    shape = demo(spark, sf_dir, "demand").groupBy(*at).agg(F.min("owner").alias("n")).filter("n % 5 <> 0")
    unknown = cells(spark, sf_dir).agg(F.round(1 - F.count_if(F.col("known") == 4) / float((NODES - 1) ** 2), 9).alias("unknown_share"))
    return rasters.shape_topology(shape).crossJoin(unknown)  # one row each


@R.add(
    "spaced_sample",
    """
WITH RECURSIVE p AS (SELECT id, x, y, CASE WHEN category IN ('BUILDING', 'MACHINERY') THEN 'inner' WHEN category = 'FURNITURE' THEN 'edge' ELSE 'outer' END AS stratum, sha256('e:' || CAST(id AS VARCHAR)) AS d FROM facilities WHERE id % 61 <= 50 AND id % 17 <> 0),
o AS (SELECT *, row_number() OVER (ORDER BY CASE stratum WHEN 'inner' THEN 1 WHEN 'edge' THEN 2 ELSE 3 END, d, id) AS n, CASE stratum WHEN 'inner' THEN 8 WHEN 'edge' THEN 5 ELSE 10 END AS quota FROM p),
w AS (SELECT CAST(0 AS BIGINT) AS n, CAST([] AS STRUCT(x BIGINT, y BIGINT)[]) AS taken, CAST([] AS BIGINT[]) AS ids, 0 AS k, '' AS stratum
  UNION ALL SELECT o.n, CASE WHEN ok THEN list_append(taken, {x: o.x, y: o.y}) ELSE taken END, CASE WHEN ok THEN list_append(ids, o.id) ELSE ids END, CASE WHEN ok THEN had + 1 ELSE had END, o.stratum FROM (
    SELECT w.*, o, CASE WHEN o.stratum = w.stratum THEN k ELSE 0 END AS had, (CASE WHEN o.stratum = w.stratum THEN k ELSE 0 END) < o.quota AND len(list_filter(taken, lambda t: (t.x - o.x) ** 2 + (t.y - o.y) ** 2 < 22500)) = 0 AS ok FROM w JOIN o ON o.n = w.n + 1) s),
f AS (SELECT unnest(ids) AS id FROM (SELECT ids FROM w ORDER BY n DESC LIMIT 1))
SELECT o.id, o.stratum, CAST(row_number() OVER (PARTITION BY o.stratum ORDER BY d, o.id) AS INTEGER) AS place FROM f JOIN o USING (id)""",
    ("facilities",),
)
def q_spaced(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A seeded sample over strata, 150 m apart, of points near a road."""
    stratum = F.when(F.col("category").isin("BUILDING", "MACHINERY"), "inner").when(F.col("category") == "FURNITURE", "edge").otherwise("outer")
    road = F.when(F.col("id") % 17 != 0, (F.col("id") % 61).cast("double"))
    points = demo(spark, sf_dir, "facilities").select("id", "x", "y", stratum.alias("stratum"), road.alias("road_m"))
    out = accuracy.spaced_sample(points, "id", "stratum", {"inner": 8, "edge": 5, "outer": 10}, 150.0, F.col("road_m"), 50.0, "e")
    return out.select("id", "stratum", "place")
