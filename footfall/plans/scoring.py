"""Coverage of a grid by facilities: verdicts, areas, interval scores, gap zones."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from footfall.functions.rules import category_service, distance_within
from footfall.operators import areas, nearby, recompute
from footfall.plans.demo import Registry, demo
from footfall.session import checkpointed, shared_dir

R = Registry()
QUERIES, SQL = R.queries, R.sql
#: The demonstration town is dense, so its queries pass a tighter rule than the default 1000 +- 100 m.
NEAR_M, BAND_M, LOOK_M = 150.0, 15.0, 400.0


def cells_and_categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every occupied 50 m cell with every category: ``cell, ix, iy, level, category, x, y`` (its centre)."""
    cells = demo(spark, sf_dir, "demand").select("ix", "iy").distinct()
    categories = demo(spark, sf_dir, "facilities").agg(F.array_sort(F.collect_set("category")).alias("cs"))  # a dictionary of a few words
    out = cells.crossJoin(F.broadcast(categories)).select("ix", "iy", F.explode("cs").alias("category"))
    return out.select(F.concat_ws(":", F.lit("0"), "ix", "iy").alias("cell"), "ix", "iy", F.lit(0).alias("level"), "category", (F.col("ix") * 50 + 25).alias("x"), (F.col("iy") * 50 + 25).alias("y"))


def judged_cells(cells: DataFrame, shops: DataFrame) -> DataFrame:
    """``cells`` with the nearest of ``shops`` in their category and the three-valued verdict."""
    cells = checkpointed(cells)
    near = nearby.nearest(cells, shops, ["cell", "category"], LOOK_M, "id", on=("category",)).select("cell", "category", F.col("r_id").alias("nearest_id"), F.col("distance_m").alias("nearest_m"))
    out = cells.join(near, ["cell", "category"], "left")
    # Nothing within the search radius is farther than the rule asks, so the verdict is FALSE, not unknown.
    within = distance_within(F.coalesce("nearest_m", F.lit(LOOK_M + 1)), NEAR_M, BAND_M)
    return out.withColumn("within", within).withColumn("verdict", F.when(F.col("within"), "covered").when(~F.col("within"), "gap").otherwise("unknown")).withColumn("area_m2", F.lit(2500.0))


def cell_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``cells_and_categories`` with the nearest facility and the three-valued verdict."""
    return judged_cells(cells_and_categories(spark, sf_dir), demo(spark, sf_dir, "facilities").select("id", "category", "x", "y"))


CELLS = """
c AS (SELECT DISTINCT ix, iy FROM demand),
k AS (SELECT DISTINCT category FROM facilities),
n AS (
  SELECT c.ix, c.iy, k.category, f.id, sqrt((c.ix * 50 + 25 - f.x) ** 2 + (c.iy * 50 + 25 - f.y) ** 2) AS d
  FROM c CROSS JOIN k LEFT JOIN facilities f ON f.category = k.category AND abs(c.ix * 50 + 25 - f.x) <= 400 AND abs(c.iy * 50 + 25 - f.y) <= 400
    AND sqrt((c.ix * 50 + 25 - f.x) ** 2 + (c.iy * 50 + 25 - f.y) ** 2) <= 400
),
b AS (SELECT ix, iy, category, min(d) AS nearest_m FROM n GROUP BY ix, iy, category),
nn AS (SELECT b.ix, b.iy, b.category, b.nearest_m, min(n.id) AS nearest_id FROM b LEFT JOIN n ON n.ix = b.ix AND n.iy = b.iy AND n.category = b.category AND n.d = b.nearest_m GROUP BY ALL),
v AS (
  SELECT '0:' || ix || ':' || iy AS cell, ix, iy, category, nearest_id, nearest_m,
    CASE WHEN abs(coalesce(nearest_m, 401.0) - 150) <= 15 AND coalesce(nearest_m, 401.0) <> 150 THEN 'unknown' WHEN coalesce(nearest_m, 401.0) <= 150 THEN 'covered' ELSE 'gap' END AS verdict
  FROM nn
)"""
BASE = ("demand", "facilities")


@R.add("cell_verdicts", f"WITH {CELLS} SELECT cell, category, nearest_id, round(nearest_m, 6) AS nearest_m, verdict FROM v", BASE)
def q_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdict and nearest facility of every cell and category."""
    return cell_verdicts(spark, sf_dir).select("cell", "category", "nearest_id", F.round("nearest_m", 6).alias("nearest_m"), "verdict")


SCORES = """
a AS (SELECT category, sum(2500.0) FILTER (verdict = 'covered') AS c, sum(2500.0) FILTER (verdict = 'gap') AS g, sum(2500.0) FILTER (verdict = 'unknown') AS u, CAST(count(*) * 2500 AS DOUBLE) AS d FROM v GROUP BY category),
s AS (SELECT category, CAST(coalesce(c, 0) AS DOUBLE) AS covered_m2, CAST(coalesce(g, 0) AS DOUBLE) AS gap_m2, CAST(coalesce(u, 0) AS DOUBLE) AS unknown_m2, d FROM a)"""


@R.add(
    "coverage_score",
    f"""WITH {CELLS}, {SCORES}
SELECT category, covered_m2, gap_m2, unknown_m2, round(100 * covered_m2 / d, 6) AS lower_pct, round(100 * (covered_m2 + unknown_m2) / d, 6) AS upper_pct,
  round(100 * (covered_m2 + gap_m2) / d, 6) AS assessable_pct, round(100 * unknown_m2 / d, 6) AS unknown_pct FROM s""",
    BASE,
)
def q_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdict areas and interval score of every category."""
    cells = cell_verdicts(spark, sf_dir)
    per = areas.verdict_areas(cells).join(cells.groupBy("category").agg(F.sum("area_m2").alias("domain_m2")), "category")
    scored = areas.category_scores(per)
    return scored.select("category", "covered_m2", "gap_m2", "unknown_m2", *[F.round(c, 6).alias(c) for c in ("lower_pct", "upper_pct", "assessable_pct", "unknown_pct")])


@R.add(
    "overall_score",
    f"""WITH {CELLS}, {SCORES}
SELECT round(avg(100 * covered_m2 / d), 6) AS lower_pct, round(avg(100 * (covered_m2 + unknown_m2) / d), 6) AS upper_pct, round(avg(100 * (covered_m2 + gap_m2) / d), 6) AS assessable_pct,
  round(avg(100 * unknown_m2 / d), 6) AS unknown_pct, CAST(NULL AS VARCHAR) AS reason, '' AS categories FROM s""",
    BASE,
)
def q_overall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Overall equal-weight score over the fixed scope of categories."""
    cells = cell_verdicts(spark, sf_dir)
    per = areas.verdict_areas(cells).join(cells.groupBy("category").agg(F.sum("area_m2").alias("domain_m2")), "category")
    out = areas.overall_score(areas.category_scores(per), demo(spark, sf_dir, "facilities").select("category"))
    return out.select(*[F.round(c, 6).alias(c) for c in ("lower_pct", "upper_pct", "assessable_pct", "unknown_pct")], "reason", "categories")


@R.add("composite_gap_cells", f"WITH {CELLS} SELECT ix, iy, count(DISTINCT category) AS categories FROM v WHERE verdict = 'gap' GROUP BY ix, iy HAVING count(DISTINCT category) >= 2", BASE)
def q_composite(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells that are a gap for two categories or more."""
    return areas.composite_gaps(cell_verdicts(spark, sf_dir).filter("verdict = 'gap'")).select("ix", "iy", "categories")


@R.add("union_gap_area", f"WITH {CELLS} SELECT count(*) * 2500.0::DOUBLE AS gap_m2, count(*) AS cells FROM (SELECT DISTINCT ix, iy FROM v WHERE verdict = 'gap')", BASE)
def q_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gap area over all categories, each cell once."""
    return areas.union_gap_area(cell_verdicts(spark, sf_dir).filter("verdict = 'gap'"))


@R.add(
    "gap_zones",
    f"""WITH RECURSIVE {CELLS},
g AS (SELECT category, ix, iy, cell, nearest_id, nearest_m FROM v WHERE verdict = 'gap'),
walk AS (
  SELECT category, ix AS sx, iy AS sy, ix, iy FROM g
  UNION
  SELECT w.category, w.sx, w.sy, g.ix, g.iy FROM walk w JOIN g ON g.category = w.category AND abs(g.ix - w.ix) + abs(g.iy - w.iy) = 1
),
comp AS (SELECT category, ix, iy, min(category || '|0:' || sx || ':' || sy) AS component FROM walk GROUP BY category, ix, iy),
z AS (
  SELECT g.category, component, count(*) AS cells, min(cell) AS first_cell, min(nearest_m) AS nearest_m FROM g JOIN comp USING (category, ix, iy) GROUP BY g.category, component
)
SELECT category, CAST(row_number() OVER (PARTITION BY category ORDER BY cells DESC, component) AS INTEGER) AS rank, cells * 2500.0::DOUBLE AS area_m2, cells, first_cell, round(nearest_m, 6) AS nearest_m, cells >= 1 AS labelled FROM z""",
    BASE,
)
def q_zones(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Connected gap zones per category, ranked by area."""
    gaps = cell_verdicts(spark, sf_dir).filter("verdict = 'gap'")
    return areas.gap_zones(gaps).select("category", "rank", "area_m2", "cells", "first_cell", F.round("nearest_m", 6).alias("nearest_m"), "labelled")


@R.add(
    "category_service",
    """SELECT facility, CASE WHEN bool_or(w) THEN 'covered' WHEN count(*) = count(w) AND bool_and(endpoint_verified) THEN 'blind' ELSE 'unknown' END AS service, count(*) AS samples
FROM (SELECT facility, endpoint_verified, CASE WHEN abs(distance_m - 1000) <= 100 AND distance_m <> 1000 THEN NULL ELSE distance_m <= 1000 END AS w FROM routes) GROUP BY facility""",
    ("routes",),
)
def q_service(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three-valued service of each facility over its route samples."""
    routes = demo(spark, sf_dir, "routes").withColumn("w", distance_within(F.col("distance_m")))
    return routes.groupBy("facility").agg(category_service(F.col("w"), F.col("endpoint_verified")).alias("service"), F.count("*").alias("samples"))


#: Facilities after a change: some gone, some moved, some of another category, some new.
CHANGED = """
fac2 AS (SELECT id, CASE WHEN id % 79 = 0 THEN 'BUILDING' ELSE category END AS category, CASE WHEN id % 89 = 0 THEN x + 130 ELSE x END AS x, y FROM facilities WHERE id % 97 <> 0
  UNION ALL SELECT -id, category, x + 55, y - 35 FROM facilities WHERE id % 83 = 0)"""


def changed_facilities(spark: SparkSession, sf_dir: str) -> DataFrame:
    f, i = demo(spark, sf_dir, "facilities").select("id", "category", "x", "y"), F.col("id")
    kept = f.filter("id % 97 <> 0").select("id", F.when(i % 79 == 0, "BUILDING").otherwise(F.col("category")).alias("category"), F.when(i % 89 == 0, F.col("x") + 130).otherwise(F.col("x")).alias("x"), "y")
    return kept.unionByName(f.filter("id % 83 = 0").select((-i).alias("id"), "category", (F.col("x") + 55).alias("x"), (F.col("y") - 35).alias("y")))


@R.add(
    "recomputed_verdicts",
    f"""WITH {CHANGED},
{CELLS.strip().replace("facilities", "fac2").replace("k AS (SELECT DISTINCT category FROM fac2)", "k AS (SELECT DISTINCT category FROM facilities)")},
diff AS (SELECT category, x, y FROM (SELECT id, category, x, y FROM facilities EXCEPT SELECT * FROM fac2) UNION SELECT category, x, y FROM (SELECT * FROM fac2 EXCEPT SELECT id, category, x, y FROM facilities)),
hit AS (SELECT DISTINCT v.cell, v.category FROM v JOIN diff d ON d.category = v.category AND abs(v.ix * 50 + 25 - d.x) <= 400 AND abs(v.iy * 50 + 25 - d.y) <= 400 AND sqrt((v.ix * 50 + 25 - d.x) ** 2 + (v.iy * 50 + 25 - d.y) ** 2) <= 400)
SELECT v.cell, v.category, v.nearest_id, round(v.nearest_m, 6) AS nearest_m, v.verdict, CASE WHEN h.cell IS NULL THEN 1 ELSE 2 END AS revision FROM v LEFT JOIN hit h ON h.cell = v.cell AND h.category = v.category""",
    BASE,
)
def q_recomputed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdicts after facilities changed: the cells in reach of a change judged again and published as a revision on the first."""
    base = f"{shared_dir(spark)}/verdicts-{uuid.uuid4().hex}"
    columns = ["cell", "category", "nearest_id", "nearest_m", "verdict"]
    cells, old = checkpointed(cells_and_categories(spark, sf_dir)), demo(spark, sf_dir, "facilities").select("id", "category", "x", "y")
    n = cells.count()
    first = recompute.publish(spark, base, judged_cells(cells, old).select(*columns), n)
    changes, again = recompute.recomputed(cells, old, changed_facilities(spark, sf_dir), judged_cells, "id", ["category", "x", "y"], ["cell", "category"], LOOK_M, ("category",))
    second = recompute.publish(spark, base, again.select(*columns), n, changes.select("id").distinct().count(), first)
    return recompute.read_revision(spark, base, second, ["cell", "category"]).withColumn("nearest_m", F.round("nearest_m", 6))
