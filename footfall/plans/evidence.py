"""Boundary evidence: brackets along rays, angular neighbours, observations, triangles, probes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from footfall.functions import geo
from footfall.operators import evidence
from footfall.plans.demo import Registry, demo

R = Registry()
QUERIES, SQL = R.queries, R.sql
RAYS = ("ray_samples",)
#: One row per (angle, radius): agreeing samples keep their label, conflicting ones have none.
SAMPLES = "SELECT angle, radius, CASE WHEN bool_and(label) THEN true WHEN NOT bool_or(label) THEN false END AS label FROM {ray_samples} GROUP BY angle, radius"

@R.twin(
    "ray_brackets", RAYS,
    f"""
SELECT angle, before_r, radius, radius - before_r AS width FROM (
  SELECT angle, radius, label, lag(label) OVER (PARTITION BY angle ORDER BY radius) AS before_l, lag(radius) OVER (PARTITION BY angle ORDER BY radius) AS before_r FROM ({SAMPLES}) s WHERE label IS NOT NULL
) t WHERE label <> before_l""",
)
def q_ray_brackets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Neighbouring samples of opposite label along every ray."""
    return evidence.ray_brackets(evidence.agreed_samples(demo(spark, sf_dir, "ray_samples")))


@R.twin(
    "ray_scan", RAYS,
    f"""
SELECT angle, count_if(label <> before_l) AS crossings, count_if(label IS NULL) AS failed, count_if(label IS NOT NULL AND before_l IS NOT NULL) AS adjacent FROM (
  SELECT angle, radius, label, lag(label) OVER (PARTITION BY angle ORDER BY radius) AS before_l FROM ({SAMPLES}) s
) t GROUP BY angle""",
)
def q_ray_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Crossings where a failed sample breaks adjacency."""
    return evidence.ray_scan(evidence.agreed_samples(demo(spark, sf_dir, "ray_samples")))


@R.twin(
    "angular_neighbours", RAYS,
    """
SELECT angle, edge_r, coalesce(lead(edge_r) OVER (ORDER BY angle), first_value(edge_r) OVER (ORDER BY angle)) AS next_r, abs(edge_r - coalesce(lead(edge_r) OVER (ORDER BY angle), first_value(edge_r) OVER (ORDER BY angle))) > 50 AS jump FROM (
  SELECT angle, max(CASE WHEN label THEN radius END) AS edge_r FROM {ray_samples} GROUP BY angle
) t""",
)
def q_angular_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Radial jumps between angular neighbours, wrapping around."""
    return evidence.angular_neighbours(demo(spark, sf_dir, "ray_samples"))


@R.twin(
    "radial_boundary", RAYS,
    f"""
SELECT angle, last_in, first_out, CASE WHEN last_in IS NULL THEN 'unknown' WHEN first_out IS NULL THEN 'truncated' ELSE 'closed' END AS state, CASE WHEN first_out IS NOT NULL THEN (last_in + first_out) / 2.0 ELSE last_in END AS boundary_r,
  0.5 * last_in * last_in * 0.392699 AS sector_m2
FROM (
  SELECT angle, max(CASE WHEN label THEN radius END) AS last_in, min(CASE WHEN NOT label AND radius > top THEN radius END) AS first_out FROM (
    SELECT angle, radius, label, max(CASE WHEN label THEN radius END) OVER (PARTITION BY angle) AS top FROM ({SAMPLES}) s) a GROUP BY angle
) t""",
)
def q_radial_boundary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Last reachable sample, boundary radius, sector area and state of every ray."""
    return evidence.radial_boundary(evidence.agreed_samples(demo(spark, sf_dir, "ray_samples")), 0.392699)


@R.twin(
    "polar_nodes", RAYS,
    f"""
SELECT angle, mid, width FROM (
  SELECT angle, mid, width, row_number() OVER (PARTITION BY angle ORDER BY width, mid) AS n FROM (
    SELECT angle, CAST(floor((radius + before_r) / 2.0) AS BIGINT) AS mid, radius - before_r AS width, label, before_l FROM (
      SELECT angle, radius, label, lag(label) OVER (PARTITION BY angle ORDER BY radius) AS before_l, lag(radius) OVER (PARTITION BY angle ORDER BY radius) AS before_r FROM ({SAMPLES}) s WHERE label IS NOT NULL) b
  ) c WHERE label <> before_l
) t WHERE n = 1""",
)
def q_polar_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best bracket of every angle."""
    return evidence.polar_nodes(evidence.agreed_samples(demo(spark, sf_dir, "ray_samples")))


@R.twin(
    "next_direction", RAYS,
    """
SELECT angle, chord FROM (
  SELECT angle, CASE WHEN nxt > angle THEN nxt - angle ELSE nxt + 16 - angle END AS chord, row_number() OVER (ORDER BY CASE WHEN nxt > angle THEN nxt - angle ELSE nxt + 16 - angle END DESC, angle) AS n FROM (
    SELECT angle, coalesce(lead(angle) OVER (ORDER BY angle), first_value(angle) OVER (ORDER BY angle)) AS nxt FROM (SELECT DISTINCT angle FROM {ray_samples} WHERE label) d) e
) t WHERE n <= 3""",
)
def q_next_direction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Widest gaps between attempted directions."""
    return evidence.next_directions(demo(spark, sf_dir, "ray_samples").filter("label"), 16)


@R.twin(
    "novelty_pauses", ("dispatch_log",),
    """
SELECT cell, CAST(max(fails) AS BIGINT) AS most_in_a_row, max(fails) >= 2 AS paused, count(*) AS n FROM (
  SELECT cell, sum(CASE WHEN fresh = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY cell, run ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS fails FROM (
    SELECT cell, event_id, fresh, sum(fresh) OVER (PARTITION BY cell ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS run FROM (
      SELECT user_id AS cell, event_id, CASE WHEN row_number() OVER (PARTITION BY user_id, CAST(floor(value / 10.0) AS BIGINT) ORDER BY event_id) = 1 THEN 1 ELSE 0 END AS fresh FROM {dispatch_log}) a) b
) t GROUP BY cell""",
)
def q_novelty_pauses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repeats count as failures until something new comes; two in a row pause a cell."""
    return evidence.novelty_pauses(demo(spark, sf_dir, "dispatch_log"), "user_id", F.floor(F.col("value") / 10.0), "event_id")


@R.twin(
    "edge_per_cell", ("demand",),
    """
SELECT ix, iy, id, width FROM (
  SELECT ix, iy, id, price AS width, row_number() OVER (PARTITION BY ix, iy ORDER BY price DESC, id) AS n FROM {demand}
) t WHERE n = 1 AND width > 200000""",
)
def q_edge_per_cell(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The widest edge of every cell."""
    return evidence.widest_per_cell(demo(spark, sf_dir, "demand"), ["ix", "iy"], "id", "price", 200_000)


@R.twin(
    "probe_selection", ("demand",),
    """
SELECT verdict, count(*) AS n, min(id) AS first_id FROM (
  SELECT id, CASE WHEN price < 20000 THEN 'invalid' WHEN id % 4 = 0 THEN 'cached' WHEN row_number() OVER (PARTITION BY price >= 20000 AND id % 4 <> 0 ORDER BY price DESC, id) <= 100 THEN 'selected' ELSE 'over_quota' END AS verdict FROM {demand}
) t GROUP BY verdict""",
)
def q_probe_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Probes within quota, with a named reason for the others."""
    done = evidence.select_probes(demo(spark, sf_dir, "demand"), "id", "price", F.col("price") < 20_000, F.col("id") % 4 == 0, 100)
    return done.groupBy("verdict").agg(F.count("*").alias("n"), F.min("id").alias("first_id"))


@R.twin(
    "observation_layer", ("routes",),
    """
SELECT origin, facility, count(*) AS n, count(DISTINCT duration) AS durations, count(DISTINCT duration) > 1 AS conflict, bool_or(duration <= 900) AND bool_or(duration > 900) AS crosses, CASE WHEN count(DISTINCT duration) = 1 THEN min(duration) END AS consensus
FROM {routes} WHERE endpoint_verified AND reason = 'ok' GROUP BY origin, facility""",
)
def q_observation_layer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Usable observations by endpoint, with conflicts, crossings and consensus."""
    usable = F.col("endpoint_verified") & (F.col("reason") == "ok")
    return evidence.observation_layer(demo(spark, sf_dir, "routes"), usable, "origin", "facility", "duration")


@R.twin(
    "event_issues", ("routes",),
    """
SELECT issue, count(*) AS n FROM (
  SELECT 'endpoint_unverified' AS issue FROM {routes} WHERE NOT endpoint_verified UNION ALL SELECT 'upstream_' || reason FROM {routes} WHERE reason <> 'ok' UNION ALL SELECT 'origin_offset' FROM {routes} WHERE origin_offset > 20 UNION ALL SELECT 'zero_duration' FROM {routes} WHERE duration = 0
) t GROUP BY issue""",
)
def q_event_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often each issue makes an event unusable."""
    r = F.col("reason")
    return evidence.issue_counts(
        demo(spark, sf_dir, "routes"), endpoint=F.when(~F.col("endpoint_verified"), "endpoint_unverified"), upstream=F.when(r != "ok", F.concat(F.lit("upstream_"), r)),
        offset=F.when(F.col("origin_offset") > 20, "origin_offset"), zero=F.when(F.col("duration") == 0, "zero_duration"),
    )


@R.twin(
    "exact_lookup", ("demand", "routes"),
    """
SELECT d.id, count(r.line) AS observations, CASE WHEN count(r.line) = 0 THEN 'unknown' WHEN bool_or(r.duration <= 900) AND bool_or(r.duration > 900) THEN 'conflict' WHEN bool_or(r.duration <= 900) THEN 'reachable' ELSE 'unreachable' END AS state
FROM {demand} d LEFT JOIN {routes} r ON r.origin = d.id AND r.reason = 'ok' GROUP BY d.id""",
)
def q_exact_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact observations of a point, conflicts first, none as unknown."""
    return evidence.exact_lookup(demo(spark, sf_dir, "demand"), demo(spark, sf_dir, "routes").filter("reason = 'ok'"), "id", "origin", "duration")


@R.twin(
    "contradictions", ("demand", "routes"),
    """
SELECT kind, count(*) AS n FROM (
  SELECT CASE WHEN abs(d.ix) + abs(d.iy) <= 30 AND r.duration > 900 THEN 'negative_inside' WHEN abs(d.ix) + abs(d.iy) > 34 AND r.duration <= 900 THEN 'positive_outside' ELSE 'consistent' END AS kind FROM {demand} d JOIN {routes} r ON r.origin = d.id WHERE r.endpoint_verified
) t GROUP BY kind""",
)
def q_contradictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Evidence that contradicts an estimate."""
    reach = F.abs("ix") + F.abs("iy")
    observed = demo(spark, sf_dir, "demand").join(demo(spark, sf_dir, "routes").filter("endpoint_verified").withColumnRenamed("origin", "id"), "id")
    return evidence.contradictions(observed, reach <= 30, reach > 34, "duration")


@R.add(
    "triangle_surface",
    """
WITH t AS (SELECT a.id, a.price < 250000 AS la, b.price < 250000 AS lb, c.price < 250000 AS lc, abs((b.x - a.x) * (c.y - a.y) - (c.x - a.x) * (b.y - a.y)) / 2.0 AS area
  FROM demand a JOIN demand b ON b.id = a.id + 1 JOIN demand c ON c.id = a.id + 2 WHERE a.id % 3 = 0)
SELECT CASE WHEN la AND lb AND lc THEN 'support' WHEN NOT (la OR lb OR lc) THEN 'outside' ELSE 'mixed' END AS class, count(*) AS n, round(sum(CASE CAST(la AS INT) + CAST(lb AS INT) + CAST(lc AS INT) WHEN 0 THEN 0 WHEN 1 THEN 0.25 WHEN 2 THEN 0.75 ELSE 1 END * CAST(area AS DOUBLE)), 3) AS positive_m2 FROM t GROUP BY 1""",
    ("demand",),
)
def q_triangles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Triangles by class and the area on their positive side."""
    d = demo(spark, sf_dir, "demand").select("id", "x", "y", (F.col("price") < 250000).alias("l"))
    a = d.filter("id % 3 = 0").select("id", F.col("x").alias("ax"), F.col("y").alias("ay"), F.col("l").alias("la"))
    b = d.filter("id % 3 = 1").select((F.col("id") - 1).alias("id"), F.col("x").alias("bx"), F.col("y").alias("by"), F.col("l").alias("lb"))
    c = d.filter("id % 3 = 2").select((F.col("id") - 2).alias("id"), F.col("x").alias("cx"), F.col("y").alias("cy"), F.col("l").alias("lc"))
    t = a.join(b, "id").join(c, "id")
    area = F.abs(geo.area2(*[F.col(n) for n in ("ax", "ay", "bx", "by", "cx", "cy")])) / 2.0
    kind = F.when(F.expr("la AND lb AND lc"), "support").when(F.expr("NOT (la OR lb OR lc)"), "outside").otherwise("mixed")
    share = geo.positive_share(F.col("la"), F.col("lb"), F.col("lc"))
    return t.groupBy(kind.alias("class")).agg(F.count("*").alias("n"), F.round(F.sum(share * area), 3).alias("positive_m2"))


@R.add(
    "triangle_orientation",
    """
WITH t AS (SELECT a.id, (b.x - a.x) * (c.y - a.y) - (c.x - a.x) * (b.y - a.y) AS asked, (b.x + 40 - a.x) * (c.y - 40 - a.y) - (c.x - a.x) * (b.y - a.y) AS got
  FROM demand a JOIN demand b ON b.id = a.id + 1 JOIN demand c ON c.id = a.id + 2 WHERE a.id % 3 = 0)
SELECT count(*) AS n, count(*) FILTER (WHERE sign(asked) * sign(got) < 0) AS turned, count(*) FILTER (WHERE asked = 0) AS flat FROM t""",
    ("demand",),
)
def q_orientation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """triangles whose orientation changes between requested and actual points."""
    d = demo(spark, sf_dir, "demand").select("id", "x", "y")
    a = d.filter("id % 3 = 0").select("id", F.col("x").alias("ax"), F.col("y").alias("ay"))
    b = d.filter("id % 3 = 1").select((F.col("id") - 1).alias("id"), F.col("x").alias("bx"), F.col("y").alias("by"))
    c = d.filter("id % 3 = 2").select((F.col("id") - 2).alias("id"), F.col("x").alias("cx"), F.col("y").alias("cy"))
    t = a.join(b, "id").join(c, "id")
    asked = geo.area2(*[F.col(n) for n in ("ax", "ay", "bx", "by", "cx", "cy")])
    got = (F.col("bx") + 40 - F.col("ax")) * (F.col("cy") - 40 - F.col("ay")) - (F.col("cx") - F.col("ax")) * (F.col("by") - F.col("ay"))
    return t.agg(F.count("*").alias("n"), F.count_if(F.signum(asked) * F.signum(got) < 0).alias("turned"), F.count_if(asked == 0).alias("flat"))


@R.add(
    "halton_points",
    "SELECT CAST(i AS INTEGER) AS i, round(list_sum(list_transform(range(16), lambda k: (floor(i / 2.0 ** k) % 2) / 2.0 ** (k + 1))), 9) AS u, round(list_sum(list_transform(range(16), lambda k: (floor(i / 3.0 ** k) % 3) / 3.0 ** (k + 1))), 9) AS v FROM (SELECT p_partkey AS i FROM part)",
)
def q_halton(spark: SparkSession, sf_dir: str) -> DataFrame:
    """low-discrepancy points, one for every node."""
    i = demo(spark, sf_dir, "nodes").select(F.col("id").cast("int").alias("i"))
    return i.select("i", F.round(geo.halton(F.col("i"), 2, 16), 9).alias("u"), F.round(geo.halton(F.col("i"), 3, 16), 9).alias("v"))


@R.add(
    "threshold_crossings",
    """
WITH s AS (SELECT origin, distance_m AS r, duration AS v, line FROM routes), g AS (SELECT origin, line, avg(r) AS r, CAST(avg(v) AS DOUBLE) AS v FROM s GROUP BY origin, line),
l AS (SELECT origin, line, r, v, lag(r) OVER w AS r0, lag(v) OVER w AS v0 FROM g WINDOW w AS (PARTITION BY origin ORDER BY line))
SELECT origin, line, round(CASE WHEN v = v0 THEN (r + r0) / 2 ELSE r0 + (900 - v0) * (r - r0) / (v - v0) END, 6) AS crossing FROM l WHERE (v0 <= 900) <> (v <= 900)""",
    ("routes",),
)
def q_crossings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F16: where the duration along a route's samples crosses 900 s."""
    g = demo(spark, sf_dir, "routes").groupBy("origin", "line").agg(F.avg("distance_m").alias("r"), F.avg("duration").alias("v"))
    w = Window.partitionBy("origin").orderBy("line")
    pairs = g.select("origin", "line", "r", "v", F.lag("r").over(w).alias("r0"), F.lag("v").over(w).alias("v0")).filter("(v0 <= 900) <> (v <= 900)")
    return pairs.select("origin", "line", F.round(geo.crossing(F.col("r0"), F.col("v0"), F.col("r"), F.col("v"), 900.0), 6).alias("crossing"))
