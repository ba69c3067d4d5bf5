"""Walking graphs as node and edge DataFrames; searches are iterative joins."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from footfall.functions.rules import barrier_class, edge_class
from footfall.operators.components import connected_components
from footfall.session import checkpointed


def directed_edges(ways: DataFrame) -> DataFrame:
    """G1: both directions of every way unless its tags forbid one; a way without length fails the job.

    ``ways`` has ``u, v, length, oneway_foot`` and may have ``foot_forward, foot_backward``; other columns are passed on. Forwards
    is closed by oneway ``-1`` or ``reverse`` or a forward tag ``no``, backwards by oneway ``yes``, ``1`` or ``true`` or a backward tag ``no``.
    """
    checked = ways.filter(F.assert_true(F.col("length") > 0, "edge without length").isNull())
    tag = lambda c: F.coalesce(F.col(c), F.lit("")) if c in ways.columns else F.lit("")
    rest = [c for c in ways.columns if c not in ("u", "v")]
    there = checked.filter(~tag("oneway_foot").isin("-1", "reverse") & (tag("foot_forward") != "no"))
    back = checked.filter(~tag("oneway_foot").isin("yes", "1", "true") & (tag("foot_backward") != "no")).select(F.col("v").alias("u"), F.col("u").alias("v"), *rest)
    return there.select("u", "v", *rest).unionByName(back).drop("oneway_foot", "foot_forward", "foot_backward")


def views(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``view, u, v, length``: edges of the allowed and of the possible view.

    Denied edges and edges at denied nodes are in neither; conditional ones only in the possible view.
    """
    kinds = nodes.select(F.col("id"), barrier_class(F.col("barrier")).alias("kind"))
    for end in ("u", "v"):
        edges = edges.join(kinds.select(F.col("id").alias(end), F.col("kind").alias(f"{end}_kind")).hint("merge"), end)  # as large as the graph: never broadcast
    worst = F.array_max(F.transform(F.array(edge_class(F.col("highway"), F.col("foot"), F.col("access")), "u_kind", "v_kind"), lambda k: F.when(k == "denied", 2).when(k == "possible", 1).otherwise(0)))
    graded = edges.withColumn("w_", worst).filter("w_ < 2")
    each = F.explode(F.when(F.col("w_") == 0, F.array(F.lit("allowed"), F.lit("possible"))).otherwise(F.array(F.lit("possible"))))
    return graded.select(each.alias("view"), "u", "v", "length")


def audit(nodes: DataFrame, edges: DataFrame, speed: float = 1.3) -> DataFrame:
    """Counts of edges with missing ends, differing lengths and differing costs."""
    ends = nodes.select("id", "x", "y")
    a, b = ends.withColumnsRenamed({"id": "u", "x": "ux", "y": "uy"}), ends.withColumnsRenamed({"id": "v", "x": "vx", "y": "vy"})
    both = edges.join(a, "u", "left").join(b, "v", "left")
    straight = F.sqrt(F.pow(F.col("ux") - F.col("vx"), 2) + F.pow(F.col("uy") - F.col("vy"), 2))
    return both.agg(
        F.count("*").alias("edges"), F.count_if(F.col("ux").isNull() | F.col("vx").isNull()).alias("missing_ends"),
        F.count_if(F.abs(straight - F.col("length")) > 1e-6).alias("length_mismatch"), F.count_if(F.abs(F.col("length") / speed - F.col("travel_time_s")) > 1e-6).alias("cost_mismatch"),
    )


#: Nodes of a frontier (some 40 bytes each) up to which it is broadcast to what is known already.
FEW = 200_000


def _least(rows: DataFrame, on: list[str]) -> DataFrame:
    return rows.groupBy(*on, "node").agg(F.min(F.struct("cost", "owner")).alias("b")).select(*on, "node", "b.cost", "b.owner")


def shortest_paths(edges: DataFrame, seeds: DataFrame, cutoff: float, keys: tuple[str, ...] = ()) -> DataFrame:
    """``keys, node, cost, owner``: least cost from any seed up to ``cutoff``, and the seed's owner.

    ``edges`` has ``keys, u, v, length`` (keys that it lacks are the seeds' alone: one graph for all of them),
    ``seeds`` has ``keys, node, cost, owner``. Every round extends the nodes that improved over their edges and keeps
    of what they reach the nodes that improve in turn, so ties go to the lesser owner. Only these are written: what is
    known is a list of such rounds, looked up by the frontier and folded now and then. The cutoff bounds the rounds,
    however many seeds and graphs there are.
    """
    on = list(keys)
    shared = [k for k in on if k in edges.columns]
    edges = checkpointed(edges.select(*shared, "u", "v", "length"))  # every round reads them
    front = checkpointed(_least(seeds.filter(F.col("cost") <= cutoff), on))
    known = [front]
    while not front.isEmpty():
        step = front.withColumnRenamed("node", "u").join(edges, [*shared, "u"])
        found = checkpointed(_least(step.select(*on, F.col("v").alias("node"), (F.col("cost") + F.col("length")).alias("cost"), "owner").filter(F.col("cost") <= cutoff), on))
        wanted = found.select(*on, "node")
        wanted = F.broadcast(wanted) if found.count() <= FEW else wanted
        whole = reduce(DataFrame.unionByName, known)
        had = whole.join(wanted, [*on, "node"], "left_semi").groupBy(*on, "node").agg(F.min(F.struct("cost", "owner")).alias("had"))
        better = F.col("had").isNull() | (F.struct("cost", "owner") < F.col("had"))
        front = checkpointed(found.join(had, [*on, "node"], "left").filter(better).drop("had"))
        known.append(front)
        if len(known) > 8:
            known = [checkpointed(_least(reduce(DataFrame.unionByName, known), on))]
    return checkpointed(_least(reduce(DataFrame.unionByName, known), on))


def entrance_seeds(entrances: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """Least cost and its owner at each end of the edges that entrances stand on.

    ``entrances`` has ``keys, owner, u, v, along_m, length, off_m`` (metres from the entrance to its edge).
    """
    off = F.col("off_m") if "off_m" in entrances.columns else F.lit(0.0)
    ends = F.explode(F.array(F.struct(F.col("u").alias("node"), (off + F.col("along_m")).alias("cost")), F.struct(F.col("v").alias("node"), (off + F.col("length") - F.col("along_m")).alias("cost"))))
    return _least(entrances.select(*keys, "owner", ends.alias("e")).select(*keys, "owner", "e.node", "e.cost"), list(keys))


def reverse_field(view_edges: DataFrame, seeds: DataFrame, cutoff: float) -> DataFrame:
    """Cost from every node to its nearest seed, per view: the search on turned edges."""
    turned = view_edges.select("view", F.col("v").alias("u"), F.col("u").alias("v"), "length")
    names = view_edges.select("view").distinct()
    return shortest_paths(turned, seeds.crossJoin(F.broadcast(names)), cutoff, ("view",))


def sample_distance(samples: DataFrame, field: DataFrame) -> DataFrame:
    """``id, cost, owner`` of each sample through the better end of its edge.

    ``samples`` has ``id, u, v, to_u, to_v``.
    """
    ends = F.explode(F.array(F.struct(F.col("u").alias("node"), F.col("to_u").alias("d")), F.struct(F.col("v").alias("node"), F.col("to_v").alias("d"))))
    met = samples.select("id", ends.alias("e")).select("id", "e.node", "e.d").join(field, "node", "left")
    return met.groupBy("id").agg(F.min(F.when(F.col("cost").isNotNull(), F.struct((F.col("cost") + F.col("d")).alias("cost"), "owner"))).alias("b")).select("id", "b.cost", "b.owner")


def reachable_intervals(edges: DataFrame, field: DataFrame, cutoff: float) -> DataFrame:
    """Reachable stretch of every edge from its start, and whether it is whole."""
    starts = field.select(F.col("node").alias("u"), F.col("cost").alias("c_"))
    reach = F.least(F.col("length"), F.greatest(F.lit(0.0), F.lit(float(cutoff)) - F.col("c_")))
    return edges.join(starts, "u").select("u", "v", "length", reach.alias("reach_m")).withColumn("whole", F.col("reach_m") >= F.col("length")).filter("reach_m > 0")


def reachable_network(edges: DataFrame, field: DataFrame, cutoff: float, keys: tuple[str, ...] = ()) -> DataFrame:
    """``keys, a, b, length, reach_m, whole``: what of every way is within reach of each key's origin.

    A directed edge is covered from its start; the opposite edge's stretch is mirrored onto the same way (a < b), and the
    stretches from the two ends are merged: they touch in the middle or leave a gap there, so their union is told by sums.
    """
    on = list(keys)
    starts = field.select(*on, F.col("node").alias("u"), F.col("cost").alias("c_"))
    reach = F.least(F.col("length"), F.lit(float(cutoff)) - F.col("c_"))
    met = edges.join(starts, "u").withColumn("reach", reach).filter("reach > 0")
    low = F.col("u") < F.col("v")
    ways = met.groupBy(*on, F.least("u", "v").alias("a"), F.greatest("u", "v").alias("b"), "length").agg(F.max(F.when(low, F.col("reach"))).alias("from_a"), F.max(F.when(~low, F.col("reach"))).alias("from_b"))
    both = F.coalesce("from_a", F.lit(0.0)) + F.coalesce("from_b", F.lit(0.0))
    return ways.select(*on, "a", "b", "length", F.least("length", both).alias("reach_m"), (both >= F.col("length")).alias("whole"))


def contracted(edges: DataFrame) -> DataFrame:
    """Undirected chains of nodes of degree 2 joined to one edge each: ``chain, length, edges``.

    ``edges`` has ``edge, a, b, length``. Total length is conserved.
    """
    ends = edges.select("edge", F.explode(F.array("a", "b")).alias("node"))
    inner = ends.groupBy("node").agg(F.count("*").alias("n"), F.min("edge").alias("e1"), F.max("edge").alias("e2")).filter("n = 2")
    comps = connected_components(inner.select(F.col("e1").alias("src"), F.col("e2").alias("dst")))
    joined = edges.join(comps.withColumnRenamed("node", "edge"), "edge", "left").withColumn("chain", F.coalesce("component", "edge"))
    return joined.groupBy("chain").agg(F.sum("length").alias("length"), F.count("*").alias("edges"))


def _darts(edges: DataFrame, inner: DataFrame) -> DataFrame:
    """``dart, edge, tail, head, next``: each edge in both directions and the dart that goes on from its head, if that is an inner node."""
    ways = F.explode(F.array(F.struct(F.lit(0).alias("turned"), F.col("a").alias("tail"), F.col("b").alias("head")), F.struct(F.lit(1).alias("turned"), F.col("b").alias("tail"), F.col("a").alias("head"))))
    darts = edges.select("edge", ways.alias("w")).select(F.struct("edge", "w.turned").alias("dart"), "edge", "w.tail", "w.head")
    leave = darts.join(inner.select(F.col("node").alias("tail")), "tail").select(F.col("tail").alias("head"), F.col("dart").alias("next"), F.col("edge").alias("next_edge"))
    on = darts.join(leave, "head", "left").withColumn("own", F.col("edge") == F.col("next_edge"))
    # An inner node has two edges: the one come by, and the one to go on with.
    return on.groupBy("dart", "edge", "tail", "head").agg(F.min(F.when(~F.col("own"), F.col("next"))).alias("next"))


def ordered_chains(edges: DataFrame, attributes: list[str], keep: DataFrame | None = None) -> DataFrame:
    """Chains of edges through nodes of degree 2, in order: ``chain, start, end, ring, length, edges, path``.

    ``edges`` has ``edge, a, b, length`` and the attributes; a node joins two edges only if all attributes are equal (null
    equals null) and it is not in ``keep`` (column ``node``). ``edges`` and ``path`` (the nodes) run from ``start`` to ``end``,
    the lesser of the two ends first; a ring starts and ends in its least node, and runs by its lesser edge first.

    Places along a chain are found by doubling: each edge, seen in both directions, knows how many edges lie before it
    and where that row begins, and looks up twice as far each round, so rounds grow with the logarithm of the longest chain.
    """
    kind = F.struct(*[F.col(c) for c in attributes]) if attributes else F.lit(0)
    slim = checkpointed(edges.select("edge", "a", "b", "length", F.to_json(F.struct(kind.alias("k")), {"ignoreNullFields": "false"}).alias("kind")))
    ends = slim.select("edge", "kind", F.explode(F.array("a", "b")).alias("node"))
    inner = ends.groupBy("node").agg(F.count("*").alias("n"), F.min("edge").alias("e1"), F.max("edge").alias("e2"), F.min("kind").alias("k1"), F.max("kind").alias("k2")).filter("n = 2 AND e1 <> e2 AND k1 = k2")
    inner = checkpointed(inner.join(keep.select("node").distinct(), "node", "left_anti") if keep is not None else inner)
    comps = connected_components(inner.select(F.col("e1").alias("src"), F.col("e2").alias("dst"))).withColumnRenamed("node", "edge")
    named = checkpointed(slim.join(comps, "edge", "left").select("edge", "a", "b", "length", F.coalesce("component", "edge").alias("chain")))
    # A chain with as many inner nodes as edges is a ring: it is opened at its least node.
    joints = inner.join(named.select(F.col("edge").alias("e1"), "chain"), "e1").groupBy("chain").agg(F.count("*").alias("inner_"), F.min("node").alias("cut"))
    sizes = named.groupBy("chain").agg(F.count("*").alias("size_"))
    rings = checkpointed(joints.join(sizes, "chain").filter("inner_ = size_").select("chain", "cut"))
    inside = inner.join(rings.select(F.col("cut").alias("node")), "node", "left_anti")
    darts = checkpointed(_darts(named, inside))
    # Backwards: what comes before each dart. A dart that nothing leads to points at itself.
    before = darts.filter("next IS NOT NULL").select(F.col("next").alias("dart"), F.col("dart").alias("from"))
    ptr = checkpointed(darts.select("dart").join(before, "dart", "left").select("dart", F.coalesce("from", "dart").alias("to"), F.when(F.col("from").isNull(), 0).otherwise(1).cast("long").alias("rank")))
    while True:
        ahead = ptr.select(F.col("dart").alias("to"), F.col("to").alias("far"), F.col("rank").alias("more"))
        step = checkpointed(ptr.join(ahead, "to").select("dart", F.col("far").alias("to"), (F.col("rank") + F.col("more")).alias("rank"), (F.col("far") != F.col("to")).alias("moved")))
        ptr = step.drop("moved")
        if step.filter("moved").isEmpty():
            break
    placed = darts.join(ptr, "dart").join(named.select("edge", "chain", "length"), "edge")
    row = placed.groupBy("chain", "to").agg(
        F.min_by("tail", "rank").alias("start"), F.max_by("head", "rank").alias("end"), F.sum("length").alias("length"),
        F.array_sort(F.collect_list(F.struct("rank", "edge", "head"))).alias("steps"),
    )
    row = row.select("chain", "start", "end", "length", F.transform("steps", lambda s: s["edge"]).alias("edges"), F.concat(F.array("start"), F.transform("steps", lambda s: s["head"])).alias("path"))
    # Of the two directions: from the lesser end, or by the lesser edge where both ends are one.
    one = row.groupBy("chain").agg(F.min(F.struct("start", "edges", "end", "length", "path")).alias("r"))
    return one.join(rings, "chain", "left").select("chain", "r.start", "r.end", F.col("cut").isNotNull().alias("ring"), "r.length", "r.edges", "r.path")


def point_times(points: DataFrame, field: DataFrame, source: DataFrame, ways: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """``keys, id, cost``: least cost from a source to points on ways: by either end, or straight along the source's own way.

    ``points`` have ``id, u, v, along_m``, ``source`` has ``keys, u, v, along_m, off_m`` (the stretch that it starts on), ``ways``
    have the directions in which they may be walked: ``u, v, length``. A point that nothing reaches has a null cost.
    """
    on = list(keys)
    there = points.select("id", "u", "v", "along_m").join(ways.select("u", "v", "length"), ["u", "v"])
    turned = ways.select(F.col("v").alias("u"), F.col("u").alias("v"), "length")
    back = points.select("id", "u", "v", "along_m").join(turned, ["u", "v"]).select("id", F.col("v").alias("u"), F.col("u").alias("v"), (F.col("length") - F.col("along_m")).alias("along_m"), "length")
    both = there.select("id", "u", "v", "along_m").unionByName(back.select("id", "u", "v", "along_m"))
    by_end = both.join(field.select(*on, F.col("node").alias("u"), "cost"), "u").select(*on, "id", (F.col("cost") + F.col("along_m")).alias("cost"))
    start = source.select(*on, "u", "v", F.col("along_m").alias("s_"), "off_m")
    flipped = source.select(*on, "u", "v", "along_m", "off_m").join(ways.select("u", "v", "length"), ["u", "v"]).select(*on, F.col("v").alias("u"), F.col("u").alias("v"), (F.col("length") - F.col("along_m")).alias("s_"), "off_m")
    same = both.join(start.unionByName(flipped), ["u", "v"]).filter("along_m >= s_").select(*on, "id", (F.col("along_m") - F.col("s_") + F.col("off_m")).alias("cost"))
    least = by_end.unionByName(same).groupBy(*on, "id").agg(F.min("cost").alias("cost"))
    every = points.select("id").distinct()
    if on:
        every = every.crossJoin(F.broadcast(source.select(*on).distinct()))
    return every.join(least, [*on, "id"], "left").select(*on, "id", "cost")
