"""Evidence about a boundary: samples along rays, observations of points, probes and their selection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def agreed_samples(samples: DataFrame, angle: str = "angle", radius: str = "radius", label: str = "label") -> DataFrame:
    """One row per place on a ray: agreeing samples keep their label, conflicting or failed ones have none."""
    one = F.when(F.bool_and(label), True).when(~F.bool_or(label), False)
    return samples.groupBy(F.col(angle).alias("angle"), F.col(radius).alias("radius")).agg(one.alias("label"))


def ray_brackets(samples: DataFrame) -> DataFrame:
    """Neighbouring known samples of opposite label along a ray: ``angle, before_r, radius, width``."""
    w = Window.partitionBy("angle").orderBy("radius")
    known = samples.filter(F.col("label").isNotNull()).select("angle", "radius", "label", F.lag("label").over(w).alias("before_l"), F.lag("radius").over(w).alias("before_r"))
    return known.filter(F.col("label") != F.col("before_l")).select("angle", "before_r", "radius", (F.col("radius") - F.col("before_r")).alias("width"))


def ray_scan(samples: DataFrame) -> DataFrame:
    """Crossings of a ray between samples side by side; a failed sample (null) breaks the row."""
    rows = samples.withColumn("before", F.lag("label").over(Window.partitionBy("angle").orderBy("radius")))
    known = F.col("label").isNotNull() & F.col("before").isNotNull()
    return rows.groupBy("angle").agg(F.count_if(F.col("label") != F.col("before")).alias("crossings"), F.count_if(F.col("label").isNull()).alias("failed"), F.count_if(known).alias("adjacent"))


def _next_around(rows: DataFrame, value: str, name: str) -> DataFrame:
    """Rows of one per angle with the ``value`` of the next angle, around the circle (some hundreds of angles at most)."""
    order = Window.orderBy("angle")
    return rows.withColumn(name, F.coalesce(F.lead(value).over(order), F.first(value).over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))))


def angular_neighbours(samples: DataFrame, jump_m: float = 50.0) -> DataFrame:
    """The outermost positive sample of each angle beside that of the next, and whether they lie a jump apart."""
    edges = samples.groupBy("angle").agg(F.max(F.when(F.col("label"), F.col("radius"))).alias("edge_r"))
    return _next_around(edges, "edge_r", "next_r").withColumn("jump", F.abs(F.col("edge_r") - F.col("next_r")) > jump_m)


def radial_boundary(samples: DataFrame, sector_rad: float) -> DataFrame:
    """Per ray the last positive sample, the first negative one beyond it, the boundary between, its sector's area and state."""
    last = samples.groupBy("angle").agg(F.max(F.when(F.col("label"), F.col("radius"))).alias("last_in"))
    beyond = samples.join(last, "angle").filter(~F.col("label") & (F.col("radius") > F.col("last_in")))
    rows = last.join(beyond.groupBy("angle").agg(F.min("radius").alias("first_out")), "angle", "left")
    state = F.when(F.col("last_in").isNull(), "unknown").when(F.col("first_out").isNull(), "truncated").otherwise("closed")
    boundary = F.when(F.col("first_out").isNotNull(), (F.col("last_in") + F.col("first_out")) / 2.0).otherwise(F.col("last_in").cast("double"))
    return rows.select("angle", "last_in", "first_out", state.alias("state"), boundary.alias("boundary_r"), (0.5 * F.col("last_in") * F.col("last_in") * sector_rad).alias("sector_m2"))


def polar_nodes(samples: DataFrame) -> DataFrame:
    """The narrowest bracket of every angle, by its midpoint in whole metres."""
    mids = ray_brackets(samples).select("angle", F.struct("width", F.floor((F.col("radius") + F.col("before_r")) / 2).alias("mid")).alias("b"))
    return mids.groupBy("angle").agg(F.min("b").alias("b")).select("angle", "b.mid", "b.width")


def next_directions(tried: DataFrame, turn: int, most: int = 3) -> DataFrame:
    """The angles after which the widest gaps between tried directions open."""
    gaps = _next_around(tried.select("angle").distinct(), "angle", "nxt")
    chord = F.when(F.col("nxt") > F.col("angle"), F.col("nxt") - F.col("angle")).otherwise(F.col("nxt") + turn - F.col("angle"))
    return gaps.select("angle", chord.alias("chord")).orderBy(F.desc("chord"), "angle").limit(most)


def novelty_pauses(tries: DataFrame, cell: str, endpoint: Column, order: str, pause_after: int = 2) -> DataFrame:
    """A try that ends where an earlier one of its cell did is a failure; so many in a row pause the cell."""
    rows = tries.select(F.col(cell).alias("cell"), endpoint.alias("e"), order)
    firsts = rows.groupBy("cell", "e").agg(F.min(order).alias("first"))
    fresh = rows.join(firsts, ["cell", "e"]).withColumn("fresh", F.when(F.col(order) == F.col("first"), 1).otherwise(0))
    upto = Window.partitionBy("cell").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    runs = fresh.withColumn("run", F.sum("fresh").over(upto)).groupBy("cell", "run").agg(F.sum(1 - F.col("fresh")).alias("fails"), F.count("*").alias("n"))
    return runs.groupBy("cell").agg(F.max("fails").alias("most_in_a_row"), (F.max("fails") >= pause_after).alias("paused"), F.sum("n").alias("n"))


def widest_per_cell(edges: DataFrame, cell: list[str], edge: str, width: str, least: float) -> DataFrame:
    """The widest edge of every cell (the lesser id of equal ones), where it is wider than ``least``."""
    best = edges.groupBy(*cell).agg(F.max(F.struct(F.col(width).alias("w"), (-F.col(edge)).alias("e"))).alias("b"))
    return best.select(*cell, (-F.col("b.e")).alias(edge), F.col("b.w").alias("width")).filter(F.col("width") > least)


def select_probes(probes: DataFrame, probe: str, size: str, invalid: Column, cached: Column, quota: int) -> DataFrame:
    """``probes`` with ``verdict``: invalid, cached, selected (the ``quota`` largest of the rest) or over_quota.

    The quota's last probe is found by a distributed sort with a limit; all others are told by comparing with it.
    """
    place = F.struct(F.col(size).alias("s"), (-F.col(probe)).alias("p"))
    free = probes.filter(~invalid & ~cached).select(place.alias("place"))
    last = free.orderBy(F.desc("place")).limit(quota).agg(F.min("place").alias("last_"), F.count("*").alias("taken_"))
    rows = probes.crossJoin(F.broadcast(last))  # one row
    chosen = (F.col("taken_") < quota) | (place >= F.col("last_"))
    verdict = F.when(invalid, "invalid").when(cached, "cached").when(chosen, "selected").otherwise("over_quota")
    return rows.withColumn("verdict", verdict).drop("last_", "taken_")


def observation_layer(events: DataFrame, usable: Column, origin: str, destination: str, duration: str, reach_s: float = 900.0) -> DataFrame:
    """Usable observations of an endpoint pair: conflicts, whether they cross the reach, and their consensus."""
    per = events.filter(usable).groupBy(origin, destination, duration).agg(F.count("*").alias("n"))  # distinct durations, map-side
    within = F.col(duration) <= reach_s
    return per.groupBy(origin, destination).agg(
        F.sum("n").alias("n"), F.count("*").alias("durations"), (F.count("*") > 1).alias("conflict"), (F.bool_or(within) & F.bool_or(~within)).alias("crosses"), F.when(F.count("*") == 1, F.min(duration)).alias("consensus")
    )


def issue_counts(events: DataFrame, **tests: Column) -> DataFrame:
    """How often each named test (or a test's own text, where it gives one) makes an event unusable."""
    return events.select(F.explode(F.array_compact(F.array(*tests.values()))).alias("issue")).groupBy("issue").agg(F.count("*").alias("n"))


def exact_lookup(points: DataFrame, observations: DataFrame, point: str, origin: str, duration: str, reach_s: float = 900.0) -> DataFrame:
    """What exact observations say of a point: conflict before reachable before unreachable; unknown without any."""
    within = F.col(duration) <= reach_s
    per = observations.groupBy(F.col(origin).alias(point)).agg(F.count("*").alias("n"), F.bool_or(within).alias("yes"), F.bool_or(~within).alias("no"))
    state = F.when(F.col("n").isNull(), "unknown").when(F.col("yes") & F.col("no"), "conflict").when(F.col("yes"), "reachable").otherwise("unreachable")
    return points.select(point).join(per, point, "left").select(point, F.coalesce("n", F.lit(0)).alias("observations"), state.alias("state"))


def contradictions(observed: DataFrame, inside: Column, outside: Column, duration: str, reach_s: float = 900.0) -> DataFrame:
    """Negatives inside an estimate, positives clearly outside it, and what agrees."""
    far = F.col(duration) > reach_s
    kind = F.when(inside & far, "negative_inside").when(outside & ~far, "positive_outside").otherwise("consistent")
    return observed.groupBy(kind.alias("kind")).agg(F.count("*").alias("n"))


def spaced_candidates(samples: DataFrame, least_step: float = 25.0) -> DataFrame:
    """Per ray the positive places at least ``least_step`` from the one before, and the first of them."""
    places = samples.filter("label").select("angle", "radius").distinct()
    step = F.col("radius") - F.lag("radius").over(Window.partitionBy("angle").orderBy("radius"))
    kept = places.withColumn("step", step).filter(F.col("step").isNull() | (F.col("step") >= least_step))
    return kept.groupBy("angle").agg(F.count("*").alias("candidates"), F.min("radius").alias("first_r"))
