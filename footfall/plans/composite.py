"""End-to-end jobs that chain several operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from footfall.functions import geo, rules, stats
from footfall.operators import areas, entity, rasters, verification
from footfall.plans.cleaning import DICTIONARY
from footfall.plans.demo import Registry, demo
from footfall.plans.scoring import BASE, CELLS, cell_verdicts
from footfall.plans.spatial import catchments

R = Registry()
QUERIES, SQL = R.queries, R.sql


@R.add(
    "facility_pipeline",
    """
WITH t AS (SELECT *, tag IN ('LARGE', 'PROMO') AND NOT contains(name, 'small') AS t3, contains(name, 'gear') AND NOT contains(name, 'small') AS n3, tag IN ('ECONOMY', 'STANDARD') AND NOT contains(name, 'hot') AS t1,
  (contains(name, 'widget') OR contains(name, 'gizmo')) AND NOT contains(name, 'hot') AS n1, tag = 'MEDIUM' AS t2, contains(name, 'bolt') OR contains(name, 'ring') AS n2 FROM poi_rows),
c AS (SELECT *, CASE WHEN contains(name, 'cold ring') THEN 'excluded' WHEN NOT (n3 OR t3) AND (n1 OR t1) AND (n2 OR t2) THEN 'needs_review' WHEN n3 OR t3 THEN CASE WHEN t3 THEN 'accepted' ELSE 'needs_review' END
  WHEN t1 OR t2 THEN 'accepted' ELSE 'needs_review' END AS status FROM t),
d AS (SELECT *, row_number() OVER (PARTITION BY uid ORDER BY CASE WHEN status = 'accepted' THEN 1 ELSE 0 END DESC, seq, page, ord, name) AS n FROM c),
v AS (SELECT CASE WHEN status <> 'accepted' THEN status WHEN abs(x) + abs(y) > 2500 THEN 'outside' ELSE 'counted' END AS state, CASE WHEN status = 'accepted' THEN CASE WHEN n3 OR t3 THEN 'machines' WHEN n2 OR t2 THEN 'hardware' ELSE 'tools' END END AS category FROM d WHERE n = 1)
SELECT state, category, count(*) AS n FROM v GROUP BY state, category""",
    ("poi_rows",),
)
def q_pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Classify, deduplicate, fence by a polygon, and count with a named state for every record."""
    rows = entity.rule_classifier(demo(spark, sf_dir, "poi_rows").withColumn("tags", F.array("tag")), DICTIONARY, [], [], [])
    best = entity.keep_best(rows, F.col("uid"), F.when(F.col("status") == "accepted", 1).otherwise(0), ["seq", "page", "ord", "name"])
    fence = F.array(*[F.struct(F.lit(float(x)).alias("x"), F.lit(float(y)).alias("y")) for x, y in ((2500, 0), (0, 2500), (-2500, 0), (0, -2500))])
    inside = geo.in_ring(F.col("x").cast("double"), F.col("y").cast("double"), fence)
    state = F.when(F.col("status") != "accepted", F.col("status")).when(~inside, "outside").otherwise("counted")
    return best.groupBy(state.alias("state"), "category").agg(F.count("*").alias("n"))


@R.add(
    "local_recompute",
    f"""WITH {CELLS},
o AS (SELECT d.ix, d.iy, d.id, bool_or(r.duration <= 900) AS y, bool_or(r.duration > 900) AS n FROM demand d JOIN routes r ON r.origin = d.id AND r.endpoint_verified AND r.reason = 'ok' GROUP BY ALL),
p AS (SELECT ix, iy, bool_or(y AND NOT n) AS yes, bool_or(n AND NOT y) AS no_, bool_or(y AND n) AS both_ FROM o GROUP BY ix, iy),
w AS (SELECT v.category, v.verdict AS before, CASE WHEN p.yes IS NULL THEN v.verdict WHEN both_ OR (yes AND no_) THEN 'unknown' WHEN yes THEN 'covered' ELSE 'gap' END AS verdict FROM v LEFT JOIN p ON p.ix = v.ix AND p.iy = v.iy)
SELECT category, before, verdict, count(*) AS cells FROM w GROUP BY ALL""",
    (*BASE, "routes"),
)
def q_recompute(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Planned points get the outcome of their observations, and cells the verdict that these give."""
    usable = F.col("endpoint_verified") & (F.col("reason") == "ok")
    plan = demo(spark, sf_dir, "demand").select("id", "ix", "iy")
    outcomes = verification.verified_outcomes(plan, demo(spark, sf_dir, "routes"), "id", "origin", "duration", usable)
    cells = verification.with_overrides(cell_verdicts(spark, sf_dir), outcomes, ["ix", "iy"])
    return cells.groupBy("category", "before", "verdict").agg(F.count("*").alias("cells"))


@R.add(
    "verification_outcomes",
    """
WITH o AS (SELECT d.id, count(r.line) AS n, bool_or(r.endpoint_verified AND r.reason = 'ok' AND r.duration <= 900) AS y, bool_or(r.endpoint_verified AND r.reason = 'ok' AND r.duration > 900) AS m FROM demand d LEFT JOIN routes r ON r.origin = d.id GROUP BY d.id)
SELECT CASE WHEN n = 0 THEN 'not_observed' WHEN y AND m THEN 'contradicted' WHEN y THEN 'verified_true' WHEN m THEN 'verified_false' ELSE 'unusable' END AS outcome, count(*) AS points FROM o GROUP BY 1""",
    ("demand", "routes"),
)
def q_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M9: the outcome of every planned point."""
    usable = F.col("endpoint_verified") & (F.col("reason") == "ok")
    done = verification.verified_outcomes(demo(spark, sf_dir, "demand").select("id"), demo(spark, sf_dir, "routes"), "id", "origin", "duration", usable)
    return done.groupBy("outcome").agg(F.count("*").alias("points"))


@R.add(
    "refinement_triggers",
    """
WITH c AS (SELECT ix, iy, count(*) AS n, min(price) AS lo, max(price) AS hi, avg(price) AS mean FROM demand GROUP BY ix, iy)
SELECT trigger_, count(*) AS cells FROM (SELECT CASE WHEN lo < 50000 AND hi > 450000 THEN 'data_conflict' WHEN lo < 250000 AND hi >= 250000 THEN 'disagreement' WHEN abs(mean - 250000) <= 40000 THEN 'near_threshold' WHEN n = 1 THEN 'single_sample' END AS trigger_ FROM c) GROUP BY trigger_""",
    ("demand",),
)
def q_triggers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M3: why a cell is refined, the first reason in order, or not at all."""
    c = demo(spark, sf_dir, "demand").groupBy("ix", "iy").agg(F.count("*").alias("n"), F.min("price").alias("lo"), F.max("price").alias("hi"), F.avg("price").alias("mean"))
    why = verification.refinement_trigger(
        data_conflict=(F.col("lo") < 50_000) & (F.col("hi") > 450_000), disagreement=(F.col("lo") < 250_000) & (F.col("hi") >= 250_000), near_threshold=F.abs(F.col("mean") - 250_000) <= 40_000, single_sample=F.col("n") == 1
    )
    return c.groupBy(why.alias("trigger_")).agg(F.count("*").alias("cells"))


@R.add(
    "support_points",
    """
WITH p AS (SELECT id, x + dx AS px, y + dy AS py, x, y FROM facilities, (SELECT unnest([25, 25, 50, 25, 0]) AS dx, unnest([25, 0, 25, 50, 25]) AS dy))
SELECT count(*) FILTER (WHERE n = 5) AS whole, count(*) FILTER (WHERE n BETWEEN 1 AND 4) AS part, count(*) FILTER (WHERE n = 0) AS outside, CAST(sum(n) AS BIGINT) AS points FROM (SELECT id, count(*) FILTER (WHERE abs(px) + abs(py) <= 2500) AS n FROM p GROUP BY id)""",
    ("facilities",),
)
def q_support(spark: SparkSession, sf_dir: str) -> DataFrame:
    """the points that a 50 m cell at each facility is judged by, and how many lie in the domain."""
    fence = F.array(*[F.struct(F.lit(float(x)).alias("x"), F.lit(float(y)).alias("y")) for x, y in ((2500, 0), (0, 2500), (-2500, 0), (0, -2500))])
    points = verification.support_points(F.col("x"), F.col("y"), 50.0)
    n = demo(spark, sf_dir, "facilities").select(F.size(F.filter(points, lambda p: geo.in_ring(p["x"], p["y"], fence))).alias("n"))
    return n.agg(F.count_if(F.col("n") == 5).alias("whole"), F.count_if(F.col("n").between(1, 4)).alias("part"), F.count_if(F.col("n") == 0).alias("outside"), F.sum("n").alias("points"))


@R.add(
    "validation_plan",
    """
WITH g AS (SELECT stratum, count(*) AS w, CASE WHEN stratum = 'N' THEN 0 ELSE least(count(*), 4000) END AS s FROM cases GROUP BY stratum), f AS (SELECT *, least(30, s) AS lo FROM g),
q AS (SELECT *, CASE WHEN s > 0 THEN (400 - sum(lo) OVER ()) * w * 1e0 / sum(CASE WHEN s > 0 THEN w END) OVER () ELSE 0e0 END AS q, 400 - sum(lo) OVER () AS rest FROM f),
r AS (SELECT *, floor(q) AS base, rest - sum(floor(q)) OVER () AS over_, row_number() OVER (ORDER BY q - floor(q) DESC, stratum) AS n FROM q)
SELECT stratum, CAST(least(s, lo + base + CASE WHEN n <= over_ AND s > 0 THEN 1 ELSE 0 END) AS BIGINT) AS share FROM r""",
    ("cases",),
)
def q_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A validation budget over strata, one of which is empty."""
    g = demo(spark, sf_dir, "cases").groupBy("stratum").agg(F.count("*").alias("w")).withColumn("s", F.when(F.col("stratum") == "N", 0).otherwise(F.least("w", F.lit(4000))))
    return stats.validation_plan(g, "stratum", "w", "s", 400, 30)


@R.add(
    "spatial_thinning",
    """
WITH b AS (SELECT id, CAST(floor(x / 150.0) AS BIGINT) AS bx, CAST(floor(y / 150.0) AS BIGINT) AS by_, price, row_number() OVER (PARTITION BY floor(x / 150.0), floor(y / 150.0) ORDER BY price DESC, id) AS n FROM demand)
SELECT id, bx, by_, price FROM b WHERE n = 1 ORDER BY price DESC, id LIMIT 60""",
    ("demand",),
)
def q_thinning(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One proposal a bin of 150 m, then the sixty riskiest."""
    return rasters.thinned(demo(spark, sf_dir, "demand"), 150.0, "price", "id", 60)


@R.add(
    "boundary_distances",
    """
WITH c AS (SELECT id, x, y, 100 + (id % 3) * 25 AS r, 120 + (id % 5) * 10 AS q FROM facilities),
side AS (SELECT id, k, who, x + CASE k WHEN 0 THEN rr WHEN 1 THEN 0 WHEN 2 THEN -rr ELSE 0 END AS ax, y + CASE k WHEN 0 THEN 0 WHEN 1 THEN rr WHEN 2 THEN 0 ELSE -rr END AS ay, x + CASE k WHEN 0 THEN 0 WHEN 1 THEN -rr WHEN 2 THEN 0 ELSE rr END AS bx, y + CASE k WHEN 0 THEN rr WHEN 1 THEN 0 WHEN 2 THEN -rr ELSE 0 END AS by_, rr
  FROM (SELECT id, x, y, r AS rr, 0 AS who FROM c UNION ALL SELECT id, x, y, q, 1 FROM c), (SELECT unnest([0, 1, 2, 3]) AS k)),
n AS (SELECT *, CAST(ceil(sqrt((bx - ax) ** 2 + (by_ - ay) ** 2) / 20) AS BIGINT) AS n FROM side),
s AS (SELECT id, who, ax + i * 1e0 / n * (bx - ax) AS px, ay + i * 1e0 / n * (by_ - ay) AS py FROM n, unnest(range(n)) AS t(i)),
d AS (SELECT s.id, s.px, s.py, s.who, min(sqrt((px - (o.ax + greatest(0e0, least(1e0, ((px - o.ax) * (o.bx - o.ax) + (py - o.ay) * (o.by_ - o.ay)) / ((o.bx - o.ax) ** 2 + (o.by_ - o.ay) ** 2))) * (o.bx - o.ax))) ** 2
  + (py - (o.ay + greatest(0e0, least(1e0, ((px - o.ax) * (o.bx - o.ax) + (py - o.ay) * (o.by_ - o.ay)) / ((o.bx - o.ax) ** 2 + (o.by_ - o.ay) ** 2))) * (o.by_ - o.ay))) ** 2)) AS m FROM s JOIN side o ON o.id = s.id AND o.who <> s.who GROUP BY ALL)
SELECT id AS area_id, count(*) AS samples, round(quantile_cont(m, 0.95), 6) AS p95_m, round(max(m), 6) AS worst_m FROM d GROUP BY id""",
    ("facilities",),
)
def q_distances(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Symmetric distances of boundary samples (20 m apart here) of two outlines of every area: their 95th percentile and the worst."""
    a = catchments(spark, sf_dir).select("area_id", "ring")
    q = 120 + (F.col("area_id") % 5) * 10
    corners = F.array(*[F.struct((F.col("x") + dx * q).cast("double").alias("x"), (F.col("y") + dy * q).cast("double").alias("y")) for dx, dy in ((1, 0), (0, 1), (-1, 0), (0, -1))])
    b = catchments(spark, sf_dir).select("area_id", corners.alias("ring"))
    d = rasters.boundary_distances(a, b, "area_id", 20.0)
    return d.groupBy("area_id").agg(F.count("*").alias("samples"), F.round(F.percentile("m", 0.95), 6).alias("p95_m"), F.round(F.max("m"), 6).alias("worst_m"))


@R.add(
    "walkable_bridges",
    """
WITH t AS (SELECT id, CASE size % 4 WHEN 0 THEN 'no' WHEN 1 THEN 'viaduct' ELSE 'yes' END AS bridge, CASE WHEN size % 11 = 0 THEN 'yes' END AS tunnel, CASE size % 6 WHEN 0 THEN 'private' WHEN 1 THEN 'designated' WHEN 2 THEN 'use_sidepath' END AS foot,
  CASE size % 5 WHEN 0 THEN 'no' END AS access, CASE size % 3 WHEN 0 THEN 'motorway' WHEN 1 THEN 'footway' ELSE 'primary' END AS highway FROM nodes)
SELECT id FROM t WHERE bridge <> 'no' AND tunnel IS NULL AND coalesce(foot, '') <> 'private' AND NOT (access IS NOT NULL AND coalesce(foot, '') <> 'designated') AND (coalesce(foot, '') = 'designated' OR (highway <> 'motorway' AND coalesce(foot, '') <> 'use_sidepath'))""",
    ("nodes",),
)
def q_bridges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bridges that people may walk."""
    return bridges(spark, sf_dir).select("id")


def bridges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes that stand for walkable bridges, by tags derived from their size."""
    s = F.col("size")
    bridge, tunnel = F.when(s % 4 == 0, "no").when(s % 4 == 1, "viaduct").otherwise("yes"), F.when(s % 11 == 0, "yes")
    foot, access = F.when(s % 6 == 0, "private").when(s % 6 == 1, "designated").when(s % 6 == 2, "use_sidepath"), F.when(s % 5 == 0, "no")
    highway = F.when(s % 3 == 0, "motorway").when(s % 3 == 1, "footway").otherwise("primary")
    return demo(spark, sf_dir, "nodes").filter(rules.walkable_bridge(bridge, tunnel, foot, access, highway))


@R.add(
    "bridged_crossings",
    """
WITH seg AS (SELECT id, x AS ax, x + 60 AS bx, y FROM facilities), w AS (SELECT DISTINCT CAST(floor(x / 400.0) AS BIGINT) * 400 + 200 AS wx FROM facilities),
b AS (SELECT id, CAST(floor(x / 400.0) AS BIGINT) * 400 + 200 AS wx, y FROM nodes WHERE size % 4 <> 0 AND size % 11 <> 0 AND size % 6 <> 0 AND NOT (size % 5 = 0 AND size % 6 <> 1) AND (size % 6 = 1 OR (size % 3 <> 0 AND size % 6 <> 2))),
h AS (SELECT seg.id, w.wx, bool_or(coalesce(abs(seg.y - b.y) <= 30, false)) AS ok FROM seg JOIN w ON ax < wx AND wx < bx LEFT JOIN b ON b.wx = w.wx GROUP BY seg.id, w.wx)
SELECT count(*) AS crossing, count(*) FILTER (WHERE ok) AS bridged FROM (SELECT id, bool_and(ok) AS ok FROM h GROUP BY id)""",
    ("facilities", "nodes"),
)
def q_crossings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Connectors across a wall that an evidenced bridge corridor opens."""
    f = demo(spark, sf_dir, "facilities")
    seg = f.select("id", F.col("x").alias("ax"), (F.col("x") + 60).alias("bx"), "y")
    keyed = seg.withColumn("cell", F.explode(F.array_distinct(F.array(F.floor(F.col("ax") / 400), F.floor(F.col("bx") / 400)))))
    walls = f.select((F.floor(F.col("x") / 400) * 400 + 200).alias("wx")).distinct()
    over = bridges(spark, sf_dir).select((F.floor(F.col("x") / 400) * 400 + 200).alias("wx"), "y")
    done = rasters.open_crossings(keyed, walls, over, 30.0)
    return done.agg(F.count("*").alias("crossing"), F.count_if("bridged").alias("bridged"))


@R.add(
    "oriented_edges",
    """
WITH e AS (SELECT a.id AS u, a.x AS ux, a.y AS uy, b.x AS vx, b.y AS vy, a.size % 2 = 0 AS turned FROM nodes a JOIN nodes b ON b.gx = a.gx + 1 AND b.gy = a.gy)
SELECT turned, count(*) AS n, CAST(sum(ux) AS DOUBLE) AS first_x, CAST(sum(vx) AS DOUBLE) AS last_x, round(sum(2 * sqrt(30 ** 2 + 10 ** 2)), 3) AS metres FROM e GROUP BY turned""",
    ("nodes",),
)
def q_oriented(spark: SparkSession, sf_dir: str) -> DataFrame:
    """geometries of edges from start to end, every second one of which runs the other way."""
    n = demo(spark, sf_dir, "nodes")
    a = n.select("gx", "gy", F.col("x").alias("ux"), F.col("y").alias("uy"), (F.col("size") % 2 == 0).alias("turned"))
    b = n.select((F.col("gx") - 1).alias("gx"), "gy", F.col("x").alias("vx"), F.col("y").alias("vy"))
    point = lambda x, y: F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))
    path = F.array(point(F.col("ux"), F.col("uy")), point((F.col("ux") + F.col("vx")) / 2, F.col("uy") + 10), point(F.col("vx"), F.col("vy")))
    edges = a.join(b, ["gx", "gy"]).withColumn("path", F.when(F.col("turned"), F.reverse(path)).otherwise(path))
    right = edges.withColumn("path", geo.oriented(F.col("path"), F.col("ux"), F.col("uy"), F.col("vx"), F.col("vy")))
    return right.groupBy("turned").agg(F.count("*").alias("n"), F.sum(F.get("path", F.lit(0))["x"]).alias("first_x"), F.sum(F.element_at("path", -1)["x"]).alias("last_x"), F.round(F.sum(geo.path_length(F.col("path"))), 3).alias("metres"))


@R.add(
    "density_colours",
    """
WITH s AS (SELECT id, least(1e0, greatest(0e0, (balance + 1000) / 11000e0)) AS t FROM facilities), k AS (SELECT id, t * t * (3 - 2 * t) AS v FROM s)
SELECT id, round(v, 9) AS share, '#' || lpad(lower(hex(CAST(round(CASE WHEN v <= 0.5 THEN 255 + greatest(0e0, v / 0.5e0) * -55 ELSE 200 + least(1e0, (v - 0.5e0) / 0.5e0) * -200 END) AS BIGINT))), 2, '0') || lpad(lower(hex(CAST(round(CASE WHEN v <= 0.5 THEN 255 + v / 0.5e0 * -155 ELSE 100 + (v - 0.5e0) / 0.5e0 * -60 END) AS BIGINT))), 2, '0')
  || lpad(lower(hex(CAST(round(CASE WHEN v <= 0.5 THEN 240 + v / 0.5e0 * -240 ELSE 0 + (v - 0.5e0) / 0.5e0 * 90 END) AS BIGINT))), 2, '0') AS colour FROM k""",
    ("facilities",),
)
def q_colours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """smoothed shares and their colours on a ramp."""
    f = demo(spark, sf_dir, "facilities").select("id", geo.smoothstep(F.col("balance"), -1000.0, 10_000.0).alias("v"))
    return f.select("id", F.round("v", 9).alias("share"), geo.ramp(F.col("v"), [(0.0, (255, 255, 240)), (0.5, (200, 100, 0)), (1.0, (0, 40, 90))]).alias("colour"))


@R.add(
    "sample_layout",
    """
WITH c AS (SELECT id, x, y, 100 + (id % 3) * 25 AS r FROM facilities)
SELECT id AS area_id, 24 AS points, round(sqrt(2e0) * r, 6) AS corner_m, CAST(r AS DOUBLE) AS ray_m FROM c""",
    ("facilities",),
)
def q_layout(spark: SparkSession, sf_dir: str) -> DataFrame:
    """the samples of an area: four corners of its box, twelve low-discrepancy points in it, and eight on rays."""
    from pyspark.sql import Column

    def point(i: Column) -> Column:
        return F.struct(geo.halton(i, 2, 8).alias("u"), geo.halton(i, 3, 8).alias("v"))

    box = geo.with_corners(F.transform(F.sequence(F.lit(1), F.lit(12)), point), -1.0, -1.0, 1.0, 1.0)
    rays = geo.radial_points(4, [0.5, 1.0])
    c = catchments(spark, sf_dir).withColumn("box", box).withColumn("rays", rays)
    far = lambda name: F.array_max(F.transform(name, lambda p: F.sqrt(p["x"] * p["x"] + p["y"] * p["y"]) * F.col("r")))
    return c.select("area_id", (F.size("box") + F.size("rays")).alias("points"), F.round(far("box"), 6).alias("corner_m"), F.round(far("rays"), 6).alias("ray_m"))


@R.add(
    "full_assessment",
    f"""WITH {CELLS},
s AS (SELECT category, count(*) FILTER (WHERE verdict = 'covered') AS covered, count(*) FILTER (WHERE verdict = 'gap') AS gap, count(*) FILTER (WHERE verdict = 'unknown') AS unknown FROM v GROUP BY category)
SELECT category, covered, gap, unknown, CASE WHEN unknown > 0.3 * (covered + gap + unknown) THEN 'limited' WHEN gap = 0 THEN 'complete' ELSE 'usable' END AS status FROM s""",
    BASE,
)
def q_assessment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M5: all categories assessed in one job keyed by category, with a status each."""
    a = areas.verdict_areas(cell_verdicts(spark, sf_dir))
    every = F.col("covered_cells") + F.col("gap_cells") + F.col("unknown_cells")
    status = F.when(F.col("unknown_cells") > 0.3 * every, "limited").when(F.col("gap_cells") == 0, "complete").otherwise("usable")
    return a.select("category", F.col("covered_cells").alias("covered"), F.col("gap_cells").alias("gap"), F.col("unknown_cells").alias("unknown"), status.alias("status"))


@R.twin(
    "service_sources", ("facilities",),
    """SELECT source, category, count(*) AS n FROM (SELECT 'counted' AS source, category FROM {facilities} WHERE x * x + y * y <= 1000000 UNION ALL SELECT 'nearby', category FROM {facilities} WHERE x * x + y * y > 1000000 AND x * x + y * y <= 1440000) u GROUP BY source, category""",
)
def q_service_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """U8: counted and nearby facilities that may serve."""
    square = F.expr("x * x + y * y")
    return rasters.service_sources(demo(spark, sf_dir, "facilities"), "category", square <= 1_000_000, square <= 1_440_000)


@R.twin(
    "refinement_priority", ("demand",),
    """
SELECT id, class, CAST(place AS BIGINT) AS place FROM (SELECT id, class, row_number() OVER (ORDER BY class, price DESC, id) AS place FROM (
  SELECT id, price, CASE WHEN price > 490000 THEN 0 WHEN price > 470000 THEN 1 ELSE 2 END AS class FROM {demand}) c) t WHERE place <= 200""",
)
def q_refinement_priority(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T5: refinement by class, size and point."""
    class_ = F.when(F.col("price") > 490_000, 0).when(F.col("price") > 470_000, 1).otherwise(2)
    return rasters.refinement_order(demo(spark, sf_dir, "demand"), class_, "price", "id", 200)


@R.add(
    "edge_travel_times",
    """SELECT facility, round(sum(distance_m / 1.3), 3) AS walk_s, count(*) FILTER (WHERE duration < distance_m / 1.3) AS faster FROM routes GROUP BY facility""",
    ("routes",),
)
def q_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Walking time of every edge at 1.3 m/s."""
    ok, _ = rules.sane_duration(F.col("duration"))
    walk = F.col("distance_m") / 1.3
    return demo(spark, sf_dir, "routes").groupBy("facility").agg(F.round(F.sum(walk), 3).alias("walk_s"), F.count_if(ok < walk).alias("faster"))
