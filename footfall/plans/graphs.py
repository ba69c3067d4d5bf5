"""Walking graphs: components, views, multi-source searches, isochrones."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from footfall.functions.rules import barrier_class, edge_class
from footfall.operators import graph
from footfall.operators.components import connected_components
from footfall.plans.demo import Registry, demo

R = Registry()
QUERIES, SQL = R.queries, R.sql
NODES = ("nodes",)
CUTOFF = 400.0


def ways(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Undirected ways between grid neighbours: ``u, v, length, highway, foot, access, oneway_foot``."""
    n = demo(spark, sf_dir, "nodes")
    ends = n.select(F.col("gx").alias("bx"), F.col("gy").alias("by"), F.col("id").alias("v"))
    side = F.explode(F.array(F.struct(F.lit(1).alias("dx"), F.lit(0).alias("dy")), F.struct(F.lit(0).alias("dx"), F.lit(1).alias("dy"))))
    out = n.select("id", "gx", "gy", "size", "brand", side.alias("s"))
    pairs = out.join(ends.hint("merge"), (F.col("bx") == F.col("gx") + F.col("s.dx")) & (F.col("by") == F.col("gy") + F.col("s.dy")))
    k = F.col("size") % 9
    return pairs.select(
        F.col("id").alias("u"), "v", F.lit(60.0).alias("length"), (F.lit(60.0) / 1.3).alias("travel_time_s"),
        F.when(k == 8, "motorway").otherwise("residential").alias("highway"), F.when(k == 7, "no").when(k == 6, "yes").alias("foot"),
        F.when(k == 5, "private").when(k == 4, "customers").alias("access"), F.when(F.col("size") % 7 == 0, "yes").alias("oneway_foot"),
    )


WAYS = """
ways AS (
  SELECT a.id AS u, b.id AS v, 60.0::DOUBLE AS length, CASE WHEN a.size % 9 = 8 THEN 'motorway' ELSE 'residential' END AS highway, CASE a.size % 9 WHEN 7 THEN 'no' WHEN 6 THEN 'yes' END AS foot,
    CASE a.size % 9 WHEN 5 THEN 'private' WHEN 4 THEN 'customers' END AS access, CASE WHEN a.size % 7 = 0 THEN 'yes' END AS oneway_foot
  FROM nodes a JOIN nodes b ON (b.gx = a.gx + 1 AND b.gy = a.gy) OR (b.gx = a.gx AND b.gy = a.gy + 1)
),
edges AS (SELECT u, v, length, highway, foot, access FROM ways UNION ALL SELECT v, u, length, highway, foot, access FROM ways WHERE oneway_foot IS NULL),
kinds AS (SELECT id, CASE WHEN barrier IS NULL THEN NULL WHEN barrier IN ('wall', 'fence') THEN 'denied' WHEN barrier = 'bollard' THEN 'allowed' ELSE 'possible' END AS kind FROM nodes),
graded AS (
  SELECT e.u, e.v, e.length, CASE WHEN highway = 'motorway' OR foot = 'no' THEN 'denied' WHEN foot = 'yes' THEN 'allowed' WHEN access = 'private' THEN 'denied' WHEN access = 'customers' THEN 'possible' ELSE 'allowed' END AS k, a.kind AS ka, b.kind AS kb
  FROM edges e JOIN kinds a ON a.id = e.u JOIN kinds b ON b.id = e.v
),
kept AS (SELECT * FROM graded WHERE k <> 'denied' AND coalesce(ka, '') <> 'denied' AND coalesce(kb, '') <> 'denied'),
views AS (SELECT 'possible' AS view, u, v, length FROM kept UNION ALL SELECT 'allowed', u, v, length FROM kept WHERE k = 'allowed' AND coalesce(ka, '') <> 'possible' AND coalesce(kb, '') <> 'possible')"""


@R.add("edge_classes", f"WITH {WAYS} SELECT k AS class, ka AS u_class, count(*) AS n, sum(length) AS length FROM graded GROUP BY k, ka", NODES)
def q_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Walkability of directed edges by class and by the barrier at their start."""
    edges = graph.directed_edges(ways(spark, sf_dir))
    kinds = demo(spark, sf_dir, "nodes").select(F.col("id").alias("u"), barrier_class(F.col("barrier")).alias("u_class"))
    graded = edges.join(kinds, "u").withColumn("class", edge_class(F.col("highway"), F.col("foot"), F.col("access")))
    return graded.groupBy("class", "u_class").agg(F.count("*").alias("n"), F.sum("length").alias("length"))


@R.add("graph_views", f"WITH {WAYS} SELECT view, count(*) AS edges, count(DISTINCT u) AS sources, sum(length) AS length FROM views GROUP BY view", NODES)
def q_views(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The allowed and the possible view."""
    v = graph.views(demo(spark, sf_dir, "nodes"), graph.directed_edges(ways(spark, sf_dir)))
    return v.groupBy("view").agg(F.count("*").alias("edges"), F.countDistinct("u").alias("sources"), F.sum("length").alias("length"))


@R.add(
    "graph_audit",
    f"""WITH {WAYS},
d AS (SELECT CASE WHEN u % 101 = 3 THEN u + 1000000 ELSE u END AS u, v, CASE WHEN v % 97 = 5 THEN length + 3 ELSE length END AS length, u % 89 = 7 AS slow FROM edges)
SELECT count(*) AS edges, count(*) FILTER (WHERE u >= 1000000) AS missing_ends, count(*) FILTER (WHERE u < 1000000 AND v % 97 = 5) AS length_mismatch, count(*) FILTER (WHERE v % 97 = 5 OR slow) AS cost_mismatch FROM d""",
    NODES,
)
def q_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Integrity counts of a graph with planted defects: lost ends, wrong lengths, wrong costs."""
    edges = graph.directed_edges(ways(spark, sf_dir))
    cost = F.when(F.col("u") % 89 == 7, F.col("travel_time_s") + 9).otherwise(F.col("travel_time_s"))
    bad = edges.withColumn("travel_time_s", cost).withColumn("length", F.when(F.col("v") % 97 == 5, F.col("length") + 3).otherwise(F.col("length")))
    return graph.audit(demo(spark, sf_dir, "nodes"), bad.withColumn("u", F.when(F.col("u") % 101 == 3, F.col("u") + 1_000_000).otherwise(F.col("u"))))


def open_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Grid neighbours neither of which is blocked, as ``src, dst``."""
    n = demo(spark, sf_dir, "nodes").filter("size % 10 > 2").select("id")
    w = ways(spark, sf_dir)
    return w.join(n.withColumnRenamed("id", "u"), "u", "left_semi").join(n.withColumnRenamed("id", "v"), "v", "left_semi").select(F.col("u").alias("src"), F.col("v").alias("dst"))


LINKS = """links AS (SELECT a.id AS src, b.id AS dst FROM nodes a JOIN nodes b ON (b.gx = a.gx + 1 AND b.gy = a.gy) OR (b.gx = a.gx AND b.gy = a.gy + 1) WHERE a.size % 10 > 2 AND b.size % 10 > 2),
both_ AS (SELECT src, dst FROM links UNION ALL SELECT dst, src FROM links)"""


@R.add(
    "component_sizes",
    f"""WITH RECURSIVE {LINKS},
lab(r, node, label) AS (
  SELECT 0, src, least(src, min(dst)) FROM both_ GROUP BY src
  UNION ALL
  SELECT r, node, label FROM (
    SELECT l.r + 1 AS r, l.node, least(l.label, min(m.label)) AS label, bool_or(m.label < l.label) AS moved FROM lab l JOIN both_ e ON e.src = l.node JOIN lab m ON m.node = e.dst GROUP BY l.r, l.node, l.label) t
  WHERE (SELECT count(*) FROM lab x JOIN both_ e ON e.src = x.node JOIN lab y ON y.node = e.dst WHERE y.label < x.label) > 0
)
SELECT label AS component, count(*) AS nodes FROM lab WHERE r = (SELECT max(r) FROM lab) GROUP BY label""",
    NODES,
)
def q_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Connected components of the open grid and their sizes."""
    return connected_components(open_links(spark, sf_dir)).groupBy("component").agg(F.count("*").alias("nodes"))


SEEDS = "seeds AS (SELECT id AS node, CAST(id % 30 AS DOUBLE) AS cost, id AS owner FROM nodes WHERE id % 37 = 5)"


def seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return demo(spark, sf_dir, "nodes").filter("id % 37 = 5").select(F.col("id").alias("node"), (F.col("id") % 30).cast("double").alias("cost"), F.col("id").alias("owner"))


@R.add(
    "service_field",
    f"""WITH RECURSIVE {WAYS}, {SEEDS},
walk AS (
  SELECT view, node, cost, owner FROM seeds, (SELECT DISTINCT view FROM views)
  UNION
  SELECT w.view, e.u, w.cost + e.length, w.owner FROM walk w JOIN views e ON e.view = w.view AND e.v = w.node WHERE w.cost + e.length <= 400
), best AS (SELECT view, node, min(cost) AS cost FROM walk GROUP BY view, node)
SELECT b.view, b.node, b.cost, min(w.owner) AS owner FROM best b JOIN walk w ON w.view = b.view AND w.node = b.node AND w.cost = b.cost GROUP BY b.view, b.node, b.cost""",
    NODES,
)
def q_field(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cost to the nearest of many facilities on both views, with its owner."""
    edges = graph.views(demo(spark, sf_dir, "nodes"), graph.directed_edges(ways(spark, sf_dir)))
    return graph.reverse_field(edges, seeds(spark, sf_dir), CUTOFF)


@R.add(
    "offline_isochrone",
    f"""WITH RECURSIVE {WAYS}, {SEEDS},
walk AS (
  SELECT node, cost FROM seeds UNION SELECT e.v, w.cost + e.length FROM walk w JOIN kept e ON e.u = w.node WHERE w.cost + e.length <= 400
), best AS (SELECT node, min(cost) AS cost FROM walk GROUP BY node),
r AS (SELECT least(length, greatest(0.0, 400.0 - cost)) AS reach, length FROM kept JOIN best ON node = u WHERE 400.0 - cost > 0)
SELECT count(*) AS edges, count(*) FILTER (WHERE reach >= length) AS whole, sum(reach) AS reach_m FROM r""",
    NODES,
)
def q_isochrone(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reachable network from many origins: whole and partial edges, total length."""
    edges = graph.views(demo(spark, sf_dir, "nodes"), graph.directed_edges(ways(spark, sf_dir))).filter("view = 'possible'")
    field = graph.shortest_paths(edges, seeds(spark, sf_dir), CUTOFF)
    r = graph.reachable_intervals(edges, field, CUTOFF)
    return r.agg(F.count("*").alias("edges"), F.count_if("whole").alias("whole"), F.sum("reach_m").alias("reach_m"))


@R.add(
    "isochrones",
    f"""WITH RECURSIVE {WAYS},
seg AS (SELECT u, v, a.x AS ax, a.y AS ay, b.x AS bx, b.y AS by_ FROM (SELECT DISTINCT least(u, v) AS u, greatest(u, v) AS v FROM kept) k JOIN nodes a ON a.id = u JOIN nodes b ON b.id = v),
near AS (SELECT f.id, u, v, greatest(0.0, least(1.0, ((f.x - ax) * (bx - ax) + (f.y - ay) * (by_ - ay)) / 3600.0)) AS t, f.x, f.y, ax, ay, bx, by_ FROM facilities f JOIN seg ON abs(f.x - (ax + bx) / 2.0) <= 90 AND abs(f.y - (ay + by_) / 2.0) <= 90),
dist AS (SELECT *, round(sqrt((x - (ax + t * (bx - ax))) ** 2 + (y - (ay + t * (by_ - ay))) ** 2), 6) AS m FROM near),
snap AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY m, u, v) AS n FROM dist WHERE m <= 50) WHERE n = 1),
ends AS (SELECT id AS origin, u AS node, m + 60 * t AS cost FROM snap UNION ALL SELECT id, v, m + 60 - 60 * t FROM snap),
walk AS (SELECT origin, node, cost FROM ends WHERE cost <= 250 UNION SELECT w.origin, e.v, w.cost + e.length FROM walk w JOIN kept e ON e.u = w.node WHERE w.cost + e.length <= 250),
best AS (SELECT origin, node, min(cost) AS cost FROM walk GROUP BY origin, node),
part AS (SELECT origin, least(u, v) AS a, greatest(u, v) AS b, length, max(CASE WHEN u < v THEN least(length, 250.0 - cost) END) AS x, max(CASE WHEN u > v THEN least(length, 250.0 - cost) END) AS y FROM best JOIN kept ON u = node WHERE cost < 250 GROUP BY 1, 2, 3, 4)
SELECT origin, count(*) AS ways, count(*) FILTER (WHERE coalesce(x, 0) + coalesce(y, 0) >= length - 1e-9) AS whole, round(sum(least(length, coalesce(x, 0) + coalesce(y, 0))), 3) AS reach_m FROM part GROUP BY origin""",
    ("nodes", "facilities"),
)
def q_isochrones(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per origin its edge, the seeds at both ends, the search, and the merged stretches within reach."""
    from footfall.plans.spatial import attached

    snapped = attached(spark, sf_dir).select(F.col("id").alias("origin"), F.col("id").alias("owner"), "u", "v", (60 * F.col("t")).alias("along_m"), F.lit(60.0).alias("length"), F.col("m").alias("off_m"))
    edges = graph.views(demo(spark, sf_dir, "nodes"), graph.directed_edges(ways(spark, sf_dir))).filter("view = 'possible'").drop("view")
    field = graph.shortest_paths(edges, graph.entrance_seeds(snapped, ("origin",)), 250.0, ("origin",))
    net = graph.reachable_network(edges, field, 250.0, ("origin",))
    return net.groupBy("origin").agg(F.count("*").alias("ways"), F.count_if(F.col("reach_m") >= F.col("length") - 1e-9).alias("whole"), F.round(F.sum("reach_m"), 3).alias("reach_m"))


@R.add(
    "chain_contraction",
    f"""WITH RECURSIVE {LINKS},
e AS (SELECT src || '-' || dst AS edge, src AS a, dst AS b FROM links WHERE (src + dst) % 4 <> 1),
n AS (SELECT edge, a AS node FROM e UNION ALL SELECT edge, b FROM e), i AS (SELECT node, min(edge) AS e1, max(edge) AS e2 FROM n GROUP BY node HAVING count(*) = 2),
t AS (SELECT e1 AS s, e2 AS d FROM i UNION SELECT e2, e1 FROM i),
w AS (SELECT edge AS s, edge AS d FROM e UNION SELECT w.s, t.d FROM w JOIN t ON t.s = w.d),
c AS (SELECT s AS edge, min(d) AS chain FROM w GROUP BY s), k AS (SELECT chain, count(*) AS edges FROM c GROUP BY chain)
SELECT edges, count(*) AS chains, CAST(sum(edges * 60) AS DOUBLE) AS length FROM k GROUP BY edges""",
    NODES,
)
def q_chains(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chains of degree-2 nodes contracted, with conserved length."""
    links = open_links(spark, sf_dir).filter("(src + dst) % 4 <> 1")
    edges = links.select(F.concat_ws("-", "src", "dst").alias("edge"), F.col("src").alias("a"), F.col("dst").alias("b"), F.lit(60.0).alias("length"))
    return graph.contracted(edges).groupBy("edges").agg(F.count("*").alias("chains"), F.sum("length").alias("length"))


CHAIN_EDGES = """
e AS (SELECT src || '-' || dst AS edge, src AS a, dst AS b, 60 AS length, (src // 7) % 3 = 0 AS kind FROM links WHERE (src + dst) % 4 <> 1)"""


@R.add(
    "ordered_chains",
    f"""WITH RECURSIVE {LINKS}, {CHAIN_EDGES},
n AS (SELECT edge, kind, a AS node FROM e UNION ALL SELECT edge, kind, b FROM e),
i AS (SELECT node, min(edge) AS e1, max(edge) AS e2 FROM n GROUP BY node HAVING count(*) = 2 AND count(DISTINCT kind) = 1 AND min(edge) <> max(edge)),
t AS (SELECT e1 AS s, e2 AS d FROM i UNION SELECT e2, e1 FROM i),
c AS (SELECT edge AS s, edge AS d FROM e UNION SELECT c.s, t.d FROM c JOIN t ON t.s = c.d),
ch AS (SELECT s AS edge, min(d) AS chain FROM c GROUP BY s),
ring AS (SELECT chain, min(node) AS cut FROM i JOIN ch ON ch.edge = i.e1 GROUP BY chain HAVING count(*) = (SELECT count(*) FROM ch x WHERE x.chain = ch.chain)),
j AS (SELECT node FROM i WHERE node NOT IN (SELECT cut FROM ring)),
dart AS (SELECT edge, a AS tail, b AS head FROM e UNION ALL SELECT edge, b, a FROM e),
w AS (
  SELECT chain, tail AS start, edge AS last, head AS stop, [edge] AS edges, [tail, head] AS path FROM dart JOIN ch USING (edge) WHERE tail NOT IN (SELECT node FROM j)
  UNION ALL SELECT w.chain, w.start, d.edge, d.head, list_append(w.edges, d.edge), list_append(w.path, d.head) FROM w JOIN dart d ON d.tail = w.stop AND d.edge <> w.last WHERE w.stop IN (SELECT node FROM j)),
f AS (SELECT *, row_number() OVER (PARTITION BY chain ORDER BY start, edges) AS k FROM w WHERE stop NOT IN (SELECT node FROM j))
SELECT f.chain, start, stop AS "end", ring.cut IS NOT NULL AS ring, CAST(60 * len(edges) AS DOUBLE) AS length, array_to_string(edges, ' ') AS edges, array_to_string(path, ' ') AS path FROM f LEFT JOIN ring ON ring.chain = f.chain WHERE k = 1""",
    NODES,
)
def q_ordered_chains(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chains of equal attributes with their edges and nodes in order, rings opened at their least node."""
    links = open_links(spark, sf_dir).filter("(src + dst) % 4 <> 1")
    edges = links.select(F.concat_ws("-", "src", "dst").alias("edge"), F.col("src").alias("a"), F.col("dst").alias("b"), F.lit(60.0).alias("length"), (F.floor(F.col("src") / 7) % 3 == 0).alias("kind"))
    out = graph.ordered_chains(edges, ["kind"])
    return out.select("chain", "start", "end", "ring", "length", F.concat_ws(" ", "edges").alias("edges"), F.concat_ws(" ", F.col("path").cast("array<string>")).alias("path"))


@R.add(
    "point_times",
    f"""WITH RECURSIVE {WAYS},
ok AS (SELECT u, v FROM kept), src AS (SELECT min(u) AS u, min(v) FILTER (WHERE u = m) AS v FROM ok, (SELECT min(u) AS m FROM ok)),
seed AS (SELECT v AS node, 45e0 AS cost FROM src UNION ALL SELECT s.u, 25e0 FROM src s JOIN ok ON ok.u = s.v AND ok.v = s.u),
walk AS (SELECT node, cost FROM seed UNION SELECT k.v, w.cost + k.length FROM walk w JOIN kept k ON k.u = w.node WHERE w.cost + k.length <= 600),
best AS (SELECT node, min(cost) AS cost FROM walk GROUP BY node),
pt AS (SELECT u || '-' || v AS id, u, v, (u * 7 + v) % 60 AS along FROM ways),
dir AS (SELECT id, p.u, p.v, along FROM pt p JOIN ok ON ok.u = p.u AND ok.v = p.v UNION ALL SELECT id, p.v, p.u, 60 - along FROM pt p JOIN ok ON ok.u = p.v AND ok.v = p.u),
cand AS (SELECT id, cost + along AS cost FROM dir JOIN best ON node = dir.u
  UNION ALL SELECT id, along - 20 + 5 FROM dir JOIN src ON src.u = dir.u AND src.v = dir.v WHERE along >= 20
  UNION ALL SELECT id, along - 40 + 5 FROM dir JOIN src ON src.v = dir.u AND src.u = dir.v WHERE along >= 40),
m AS (SELECT id, min(cost) AS cost FROM cand GROUP BY id)
SELECT pt.id, CAST(m.cost AS DOUBLE) AS cost FROM pt LEFT JOIN m USING (id)""",
    NODES,
)
def q_point_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cost from one place on a way to a point of every way, by its ends or straight along the way they share."""
    edges = graph.views(demo(spark, sf_dir, "nodes"), graph.directed_edges(ways(spark, sf_dir))).filter("view = 'possible'").select("u", "v", "length")
    first = edges.agg(F.min(F.struct("u", "v")).alias("e")).select("e.u", "e.v", F.lit(20.0).alias("along_m"), F.lit(5.0).alias("off_m"), F.lit(60.0).alias("length"))
    ahead = first.select(F.col("v").alias("node"), (F.col("length") - F.col("along_m") + F.col("off_m")).alias("cost"), F.lit(0).alias("owner"))
    back = first.join(edges.select(F.col("v").alias("u"), F.col("u").alias("v")), ["u", "v"], "left_semi").select(F.col("u").alias("node"), (F.col("along_m") + F.col("off_m")).alias("cost"), F.lit(0).alias("owner"))
    field = graph.shortest_paths(edges, ahead.unionByName(back), 600.0)
    points = ways(spark, sf_dir).select(F.concat_ws("-", "u", "v").alias("id"), "u", "v", ((F.col("u") * 7 + F.col("v")) % 60).cast("double").alias("along_m"))
    return graph.point_times(points, field, first, edges)
