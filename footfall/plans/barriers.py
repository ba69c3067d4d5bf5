"""Obstacles as lines and areas, edges behind water, and verdicts after what lies near by."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from footfall.operators import nearby, obstacles
from footfall.operators.components import connected_components
from footfall.plans.demo import Registry, demo
from footfall.plans.fields import domains
from footfall.plans.scoring import CELLS, cell_verdicts

R = Registry()
QUERIES, SQL = R.queries, R.sql

WATER = """
con AS (SELECT id, CAST(x AS DOUBLE) AS ax, CAST(y AS DOUBLE) AS ay, x + 60e0 AS bx, y + 40e0 AS by_ FROM facilities),
pool AS (SELECT id AS pool, x, y, unnest([{px: x, py: y, qx: x + 160, qy: y + 30, k: 1}, {px: x + 160, py: y + 30, qx: x + 150, qy: y + 70, k: 2}, {px: x + 150, py: y + 70, qx: x - 10, qy: y + 40, k: 3}, {px: x - 10, py: y + 40, qx: x, qy: y, k: 4}], recursive := true) FROM facilities WHERE id % 40 = 0),
wall AS (SELECT id AS wall, 6 + id % 9 AS width, unnest([{cx: x - 80, cy: y - 60, dx: x, dy: y + 10}, {cx: x, cy: y + 10, dx: x + 90, dy: y - 20}, {cx: x + 100, cy: y, dx: x + 150, dy: y + 90}], recursive := true) FROM facilities WHERE id % 40 = 20),
-- A segment within a convex outline: behind the last side that it enters and before the first that it leaves. All sides of an outline or none are asked.
cut AS (SELECT c.id, pool, (qx - px) * (ay - py) - (qy - py) * (ax - px) AS f0, (qx - px) * (by_ - py) - (qy - py) * (bx - px) AS f1 FROM con c JOIN pool p ON ax <= p.x + 160 AND bx >= p.x - 10 AND ay <= p.y + 70 AND by_ >= p.y),
span AS (SELECT id, pool, greatest(0e0, max(CASE WHEN f0 < 0 AND f1 > 0 THEN f0 / (f0 - f1) END)) AS t0, least(1e0, min(CASE WHEN f0 > 0 AND f1 < 0 THEN f0 / (f0 - f1) END)) AS t1, bool_or(f0 <= 0 AND f1 <= 0) AS off FROM cut GROUP BY id, pool),
held AS (SELECT id, coalesce(t0, 0e0) AS t0, coalesce(t1, 1e0) AS t1 FROM span WHERE NOT off AND coalesce(t0, 0e0) < coalesce(t1, 1e0)),
step AS (SELECT id, t0, t1, max(t1) OVER (PARTITION BY id ORDER BY t0, t1 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM held),
wet AS (SELECT id, sum(greatest(0e0, t1 - greatest(t0, coalesce(before, 0e0)))) AS share FROM step GROUP BY id)"""
POINT = "sqrt(({px} - ({ax} + {t} * ({bx} - {ax}))) ** 2 + ({py} - ({ay} + {t} * ({by} - {ay}))) ** 2)"


def _to_segment(px: str, py: str, ax: str, ay: str, bx: str, by: str) -> str:
    t = f"greatest(0e0, least(1e0, (({px} - {ax}) * ({bx} - {ax}) + ({py} - {ay}) * ({by} - {ay})) / CAST(({bx} - {ax}) ** 2 + ({by} - {ay}) ** 2 AS DOUBLE)))"
    return POINT.format(px=px, py=py, ax=ax, ay=ay, bx=bx, by=by, t=t)


A, B = ("ax", "ay", "bx", "by_"), ("cx", "cy", "dx", "dy")
GAP = (
    "CASE WHEN ((bx - ax) * (cy - ay) - (by_ - ay) * (cx - ax)) * ((bx - ax) * (dy - ay) - (by_ - ay) * (dx - ax)) < 0 AND ((dx - cx) * (ay - cy) - (dy - cy) * (ax - cx)) * ((dx - cx) * (by_ - cy) - (dy - cy) * (bx - cx)) < 0 THEN 0e0 "
    f"ELSE least({', '.join([_to_segment(*B[:2], *A), _to_segment(*B[2:], *A), _to_segment(*A[:2], *B), _to_segment(*A[2:], *B)])}) END"
)


def connectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    x, y = F.col("x").cast("double"), F.col("y").cast("double")
    return demo(spark, sf_dir, "facilities").select("id", x.alias("ax"), y.alias("ay"), (x + 60).alias("bx"), (y + 40).alias("by_"))


def pools(spark: SparkSession, sf_dir: str) -> DataFrame:
    ring = F.array(*[F.struct((F.col("x") + dx).alias("x"), (F.col("y") + dy).alias("y")) for dx, dy in ((0, 0), (160, 30), (150, 70), (-10, 40))])
    return demo(spark, sf_dir, "facilities").filter("id % 40 = 0").select(F.col("id").alias("pool"), ring.alias("ring"))


def walls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of two parts with a width, as segments."""
    at = lambda *ps: F.array(*[F.struct((F.col("x") + dx).alias("x"), (F.col("y") + dy).alias("y")) for dx, dy in ps])
    rows = demo(spark, sf_dir, "facilities").filter("id % 40 = 20").select(F.col("id").alias("wall"), (6 + F.col("id") % 9).alias("width"), F.array(at((-80, -60), (0, 10), (90, -20)), at((100, 0), (150, 90))).alias("parts"))
    return obstacles.polyline_segments(rows, ["wall", "width"])


@R.add(
    "blocked_connectors",
    f"""WITH {WATER},
hit AS (SELECT id, count(DISTINCT wall) AS walls FROM (SELECT id, wall, width, {GAP} AS gap FROM con JOIN wall ON ax <= greatest(cx, dx) + 10 AND bx >= least(cx, dx) - 10 AND ay <= greatest(cy, dy) + 10 AND by_ >= least(cy, dy) - 10) WHERE gap <= width / 2.0 GROUP BY id)
SELECT c.id, round(coalesce(share, 0) * sqrt(5200e0), 6) AS wet_m, coalesce(walls, 0) AS walls, coalesce(share, 0) * sqrt(5200e0) > 1e-1 OR walls IS NOT NULL AS blocked FROM con c LEFT JOIN wet USING (id) LEFT JOIN hit USING (id)""",
    ("facilities",),
)
def q_blocked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Connectors from a place to its way, the metres of them in water and the walls that they come too near."""
    c = connectors(spark, sf_dir)
    wet = obstacles.covered_lengths(c, pools(spark, sf_dir), ["id"], "pool", 100.0)
    hit = obstacles.crossed_counts(c, walls(spark, sf_dir), "id", "wall", "width", 100.0).groupBy("id").agg(F.max("walls").alias("walls"))
    return wet.join(hit, "id", "left").select("id", F.round("covered_m", 6).alias("wet_m"), F.coalesce("walls", F.lit(0).cast("long")).alias("walls"), ((F.col("covered_m") > obstacles.TOUCH) | (F.coalesce("walls", F.lit(0)) > 0)).alias("blocked"))


#: Shared sides of the cells of cheap demand, and what the suppliers' areas leave of them.
SIDES = """
c AS (SELECT DISTINCT ix, iy FROM demand WHERE price < 200000),
e AS (
  SELECT a.ix AS ax, a.iy AS ay, b.ix AS bx, b.iy AS by_, b.ix * 50e0 AS x0, b.iy * 50e0 AS y0, b.ix * 50e0 + CASE WHEN a.ix < b.ix THEN 0 ELSE 50 END AS x1, b.iy * 50e0 + CASE WHEN a.ix < b.ix THEN 50 ELSE 0 END AS y1
  FROM c a JOIN c b ON (b.ix = a.ix + 1 AND b.iy = a.iy) OR (b.ix = a.ix AND b.iy = a.iy + 1)),
dom AS (SELECT s_suppkey AS id, s_suppkey * 7919 % 3001 - 1500 AS x, s_suppkey * 104729 % 2999 - 1500 AS y FROM supplier),
side AS (SELECT id, x, y, unnest([{px: x, py: y, qx: x + 230, qy: y + 45}, {px: x + 230, py: y + 45, qx: x + 190, qy: y + 170}, {px: x + 190, py: y + 170, qx: x - 35, qy: y + 120}, {px: x - 35, py: y + 120, qx: x, qy: y}], recursive := true) FROM dom),
cut AS (SELECT e.*, s.id, (qx - px) * (y0 - py) - (qy - py) * (x0 - px) AS f0, (qx - px) * (y1 - py) - (qy - py) * (x1 - px) AS f1 FROM e JOIN side s ON x0 <= s.x + 231 AND x1 >= s.x - 36 AND y0 <= s.y + 171 AND y1 >= s.y - 1),
span AS (SELECT ax, ay, bx, by_, id, greatest(0e0, max(CASE WHEN f0 < 0 AND f1 > 0 THEN f0 / (f0 - f1) END)) AS t0, least(1e0, min(CASE WHEN f0 > 0 AND f1 < 0 THEN f0 / (f0 - f1) END)) AS t1, bool_or(f0 <= 0 AND f1 <= 0) AS off FROM cut GROUP BY ALL),
held AS (SELECT ax, ay, bx, by_, coalesce(t0, 0e0) AS t0, coalesce(t1, 1e0) AS t1 FROM span WHERE NOT off AND coalesce(t0, 0e0) < coalesce(t1, 1e0)),
step AS (SELECT *, max(t1) OVER (PARTITION BY ax, ay, bx, by_ ORDER BY t0, t1 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM held),
wet AS (SELECT ax, ay, bx, by_, 50 * sum(greatest(0e0, t1 - greatest(t0, coalesce(before, 0e0)))) AS m FROM step GROUP BY ALL),
free AS (SELECT e.ax, e.ay, e.bx, e.by_, 50 - coalesce(m, 0) AS free_m FROM e LEFT JOIN wet USING (ax, ay, bx, by_))"""


def _cheap_cells(spark: SparkSession, sf_dir: str, most: int) -> DataFrame:
    cells = demo(spark, sf_dir, "demand").filter(F.col("price") < most).select("ix", "iy").distinct()
    return cells.withColumn("level", F.lit(0)).withColumn("cell", (F.col("ix") + 1000) * 10_000 + F.col("iy") + 1000)


@R.add("edges_behind_water", f"WITH {SIDES} SELECT ax, ay, bx, by_, round(free_m, 6) AS free_m, free_m <= 1e-1 AS separated FROM free", ("demand",))
def q_behind(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells that share an edge, what of it lies on land, and the pairs that water parts altogether."""
    out = obstacles.separations(_cheap_cells(spark, sf_dir, 200_000), domains(spark, sf_dir), "id", 100.0)
    place = [((F.floor(F.col(k) / 10_000) - 1000) if first else (F.col(k) % 10_000 - 1000)).cast("long").alias(n) for k, first, n in (("a", True, "ax"), ("a", False, "ay"), ("b", True, "bx"), ("b", False, "by_"))]
    return out.select(*place, F.round("free_m", 6).alias("free_m"), "separated")


@R.add(
    "zones_across_water",
    f"""WITH RECURSIVE {SIDES.replace('200000', '70000')},
n AS (SELECT (ax + 1000) * 10000 + ay + 1000 AS a, (bx + 1000) * 10000 + by_ + 1000 AS b FROM free WHERE free_m > 1e-1),
pair AS (SELECT a, b FROM n UNION SELECT b, a FROM n),
w AS (SELECT (ix + 1000) * 10000 + iy + 1000 AS s, (ix + 1000) * 10000 + iy + 1000 AS t FROM c UNION SELECT w.s, pair.b FROM w JOIN pair ON pair.a = w.t),
l AS (SELECT t, min(s) AS zone FROM w GROUP BY t)
SELECT zone, count(*) AS cells FROM l GROUP BY zone""",
    ("demand",),
)
def q_across(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Zones of cells that share dry edges; the two sides of a water are two zones."""
    cells = _cheap_cells(spark, sf_dir, 70_000)
    dry = obstacles.separations(cells, domains(spark, sf_dir), "id", 100.0).filter("NOT separated")
    zones = cells.select(F.col("cell").alias("node")).join(connected_components(dry, "a", "b"), "node", "left")
    return zones.groupBy(F.coalesce("component", "node").alias("zone")).agg(F.count("*").alias("cells"))


@R.add(
    "obstacle_shares",
    f"""WITH {WATER},
ring AS (SELECT DISTINCT pool, px AS x, py AS y FROM pool WHERE k = 1),
b AS (SELECT pool, 100 * CAST(floor((x - 10) / 100.0) AS BIGINT) + 100 * i AS x0, 100 * CAST(floor(y / 100.0) AS BIGINT) + 100 * j AS y0 FROM ring, range(0, 3) r(i), range(0, 2) s(j)),
k AS (SELECT b.pool, x0, y0, px, py, qx, qy, list_sort(list_distinct(list_concat([0e0, 1e0], list_filter([(x0 - px) / CAST(nullif(qx - px, 0) AS DOUBLE), (x0 + 100 - px) / CAST(nullif(qx - px, 0) AS DOUBLE), (y0 - py) / CAST(nullif(qy - py, 0) AS DOUBLE), (y0 + 100 - py) / CAST(nullif(qy - py, 0) AS DOUBLE)], lambda t: t > 0 AND t < 1)))) AS ts FROM b JOIN pool USING (pool)),
p AS (SELECT *, unnest(range(1, len(ts))) AS n FROM k),
q AS (SELECT pool, x0, y0, (greatest(x0, least(x0 + 100, px + ts[n + 1] * (qx - px))) - greatest(x0, least(x0 + 100, px + ts[n] * (qx - px)))) * (greatest(y0, least(y0 + 100, py + ts[n] * (qy - py))) + greatest(y0, least(y0 + 100, py + ts[n + 1] * (qy - py))) - 2 * y0) / 2 AS piece FROM p),
area AS (SELECT CAST(floor(x0 / 100) AS BIGINT) AS cx, CAST(floor(y0 / 100) AS BIGINT) AS cy, -sum(piece) AS water FROM q GROUP BY ALL),
-- Lines cut where they meet the grid; a piece lies in the cell of its middle.
lk AS (SELECT wall, width, cx AS ax, cy AS ay, dx AS bx, dy AS by_, list_sort(list_distinct(list_concat([0e0, 1e0], list_filter(list_concat(
  list_transform(range(CAST(floor(least(cx, dx) / 100.0) AS BIGINT), CAST(ceil(greatest(cx, dx) / 100.0) AS BIGINT) + 1), lambda g: (g * 100 - cx) / CAST(nullif(dx - cx, 0) AS DOUBLE)),
  list_transform(range(CAST(floor(least(cy, dy) / 100.0) AS BIGINT), CAST(ceil(greatest(cy, dy) / 100.0) AS BIGINT) + 1), lambda g: (g * 100 - cy) / CAST(nullif(dy - cy, 0) AS DOUBLE))), lambda t: t > 0 AND t < 1)))) AS ts FROM wall),
lp AS (SELECT *, unnest(range(1, len(ts))) AS n FROM lk),
lq AS (SELECT CAST(floor((ax + (ts[n] + ts[n + 1]) / 2 * (bx - ax)) / 100) AS BIGINT) AS cx, CAST(floor((ay + (ts[n] + ts[n + 1]) / 2 * (by_ - ay)) / 100) AS BIGINT) AS cy, width, (ts[n + 1] - ts[n]) * sqrt(CAST((bx - ax) ** 2 + (by_ - ay) ** 2 AS DOUBLE)) AS m FROM lp),
line AS (SELECT cx, cy, sum(m) AS m, sum(m * width) AS m2 FROM lq GROUP BY ALL)
SELECT coalesce(a.cx, l.cx) AS cx, coalesce(a.cy, l.cy) AS cy, round(coalesce(water, 0e0), 4) AS water_m2, round(coalesce(m, 0e0), 4) AS line_m, round(least(1e0, (coalesce(water, 0e0) + coalesce(m2, 0e0)) / 10000), 8) AS share
FROM (SELECT * FROM area WHERE water > 1e-6) a FULL JOIN line l ON a.cx = l.cx AND a.cy = l.cy""",
    ("facilities",),
)
def q_obstacle_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Square metres of water, metres of walls and the share taken of every cell of 100 m."""
    out = obstacles.obstacle_cells(pools(spark, sf_dir), walls(spark, sf_dir), 100.0, "width").filter("water_m2 > 1e-6 OR line_m > 0")
    return out.select("cx", "cy", F.round("water_m2", 4).alias("water_m2"), F.round("line_m", 4).alias("line_m"), F.round("share", 8).alias("share"))


UNFINISHED = """
blk AS (SELECT category, 400 * CAST(floor(x / 400.0) AS BIGINT) AS x0, 400 * CAST(floor(y / 400.0) AS BIGINT) AS y0, 400 AS size FROM facilities GROUP BY ALL HAVING min(id) % 37 = 0
  UNION ALL SELECT category, 200 * CAST(floor(x / 200.0) AS BIGINT), 200 * CAST(floor(y / 200.0) AS BIGINT), 200 FROM facilities GROUP BY ALL HAVING min(id) % 41 = 0),
near AS (SELECT DISTINCT c.ix, c.iy, b.category FROM (SELECT DISTINCT ix, iy FROM demand) c JOIN blk b ON greatest(0, b.x0 - c.ix * 50 - 50, c.ix * 50 - b.x0 - b.size) ** 2 + greatest(0, b.y0 - c.iy * 50 - 50, c.iy * 50 - b.y0 - b.size) ** 2 <= 150 ** 2)"""


def unfinished_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``ix, iy, category`` of the cells within 150 m of an unfinished block of the category; blocks of two sizes."""
    f = demo(spark, sf_dir, "facilities")

    def blocks(size: int, each: int) -> DataFrame:
        corner = [(F.floor(F.col(c) / float(size)) * size).cast("long").alias(f"{c}0") for c in "xy"]
        open_ = f.groupBy("category", *corner).agg(F.min("id").alias("m")).filter(F.col("m") % each == 0)
        return open_.select("category", "x0", "y0", (F.col("x0") + size).alias("x1"), (F.col("y0") + size).alias("y1"))

    cells = demo(spark, sf_dir, "demand").select("ix", "iy").distinct()
    categories = f.agg(F.array_sort(F.collect_set("category")).alias("cs"))  # a dictionary of a few words
    each = cells.crossJoin(F.broadcast(categories)).select("ix", "iy", F.explode("cs").alias("category"), (F.col("ix") * 50).alias("x0"), (F.col("iy") * 50).alias("y0"))
    return obstacles.near_blocks(each, blocks(400, 37).unionByName(blocks(200, 41)), ["category"], 150.0, 50.0).select("ix", "iy", "category")


@R.add("unfinished_influence", f"WITH {UNFINISHED} SELECT ix, iy, category FROM near", ("facilities", "demand"))
def q_unfinished(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells within reach of a block of their category whose search was not finished."""
    return unfinished_cells(spark, sf_dir)


@R.add(
    "influenced_verdicts",
    f"""WITH {CELLS}, {UNFINISHED},
odd AS (SELECT DISTINCT d.ix, d.iy, f.category FROM (SELECT DISTINCT ix, iy FROM demand) d JOIN facilities f ON f.id % 50 = 0 AND sqrt((d.ix * 50 + 25 - f.x) ** 2 + (d.iy * 50 + 25 - f.y) ** 2) <= 300)
SELECT v.cell, v.category, CASE WHEN verdict = 'gap' AND (n.ix IS NOT NULL OR o.ix IS NOT NULL) THEN 'unknown' ELSE verdict END AS verdict,
  CASE WHEN verdict = 'gap' AND n.ix IS NOT NULL THEN 'query_incomplete_nearby' WHEN verdict = 'gap' AND o.ix IS NOT NULL THEN 'entrance_unresolved_nearby' END AS reason
FROM v LEFT JOIN near n ON n.ix = v.ix AND n.iy = v.iy AND n.category = v.category LEFT JOIN odd o ON o.ix = v.ix AND o.iy = v.iy AND o.category = v.category""",
    ("demand", "facilities"),
)
def q_influenced(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdicts of cells by category, gaps near unfinished blocks or unresolved entrances of their category unknown, with the reason."""
    cells = cell_verdicts(spark, sf_dir)
    odd = demo(spark, sf_dir, "facilities").filter("id % 50 = 0").select("id", "category", "x", "y")
    near = nearby.within_radius(cells.select("ix", "iy", "category", "x", "y"), odd, 300.0, on=("category",))
    return obstacles.influenced(cells, ["ix", "iy", "category"], unfinished_cells(spark, sf_dir), near).select("cell", "category", "verdict", "reason")
