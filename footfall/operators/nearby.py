"""Distance joins as equi-joins on grid buckets.

Both sides are keyed by the square of side ``radius`` that they stand in. The smaller ("probe") side is
written to its square and the eight around it, so each pair within the radius meets exactly once on an
equal key, and an exact distance test follows. Nothing is compared across squares, no side has to fit in
memory, and adaptive execution splits crowded squares.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from footfall.functions.geo import planar, segment_distance
from footfall.session import checkpointed


def bucket(c: Column, size: float) -> Column:
    return F.floor(c / F.lit(float(size))).cast("long")


def within_radius(left: DataFrame, right: DataFrame, radius: float, on: tuple[str, ...] = (), metric: str = "distance_m", probe: str = "right") -> DataFrame:
    """Pairs of rows within ``radius`` metres: the columns of both, ``right``'s prefixed ``r_``, and the distance.

    Both sides have ``x`` and ``y``; ``on`` names columns that must be equal too; ``probe`` is the side that is written to nine
    squares. J5, J6, J11, J15, J17.
    """

    def keys(df: DataFrame, x: str, y: str, each: bool) -> DataFrame:
        if not each:
            return df.withColumn("bx_", bucket(F.col(x), radius)).withColumn("by_", bucket(F.col(y), radius))
        near = F.explode(F.array(*[F.lit(d) for d in (-1, 0, 1)]))
        df = df.withColumn("dx_", near).withColumn("dy_", near)
        return df.withColumn("bx_", bucket(F.col(x), radius) + F.col("dx_")).withColumn("by_", bucket(F.col(y), radius) + F.col("dy_")).drop("dx_", "dy_")

    r = keys(right.select(*[F.col(c).alias(f"r_{c}") for c in right.columns]), "r_x", "r_y", probe == "right")
    keyed = keys(left, "x", "y", probe == "left")
    test = (keyed["bx_"] == r["bx_"]) & (keyed["by_"] == r["by_"])
    for c in on:
        test = test & (keyed[c] == r[f"r_{c}"])
    both = keyed.join(r, test).drop("bx_", "by_")
    return both.withColumn(metric, planar(F.col("x"), F.col("y"), F.col("r_x"), F.col("r_y"))).filter(F.col(metric) <= radius)


#: Rows that a key meets in the first circle of a search, on average and for each one wanted, at most.
MEET = 8


def nearest(left: DataFrame, right: DataFrame, key: list[str], radius: float, tie: str, on: tuple[str, ...] = (), n: int = 1) -> DataFrame:
    """The ``n`` nearest ``right`` rows of each ``left`` key within ``radius``, ranked by distance, then ``tie``.

    The search starts in a circle that holds few rows of ``right`` on average, and is doubled up to ``radius`` for the keys that
    have not met ``n`` yet: the nearest within a circle are the nearest at all. So a key meets some few rows, however dense
    they stand, and the widest circle is left to keys with hardly anything near by.
    """

    def ranked(pairs: DataFrame) -> DataFrame:
        order = F.row_number().over(Window.partitionBy(*key).orderBy("distance_m", f"r_{tie}"))
        return pairs.withColumn("rank", order).filter(F.col("rank") <= n)

    per = right.groupBy(bucket(F.col("x"), radius), bucket(F.col("y"), radius), *on).agg(F.count("*").cast("double").alias("m"))
    crowd = per.agg((F.sum(F.col("m") * F.col("m")) / F.sum("m")).alias("m")).first()["m"] or 0.0  # rows in a row's square, on average
    halvings = 0
    while halvings < LEVELS and crowd * math.pi > MEET * n * 4.0**halvings:
        halvings += 1
    open_, found = checkpointed(left) if halvings else left, []
    for step in range(halvings, 0, -1):
        met = checkpointed(ranked(within_radius(open_, right, radius / 2.0**step, on, probe="left")))
        done = met.filter(F.col("rank") == n).select(*key)
        found.append(met.join(done, key, "left_semi").select(*met.columns))
        open_ = checkpointed(open_.join(done, key, "left_anti").select(*left.columns))
        if open_.isEmpty():
            return reduce(DataFrame.unionByName, found)
    return reduce(DataFrame.unionByName, [*found, ranked(within_radius(open_, right, radius, on, probe="left" if halvings else "right"))])


def shared_edges(cells: DataFrame, key: str = "cell") -> DataFrame:
    """``a, b, length_m``: pairs of cells that share an edge of positive length, levels mixed.

    Every side is cut into 25 m unit edges; equal unit edges of two cells are shared length, and cells
    that touch in a corner alone share none. ``cells`` has ``key, ix, iy, level`` (level 0: 50 m, 1: 25 m).
    """
    span = F.when(F.col("level") == 0, 2).otherwise(1)
    base = cells.select(F.col(key).alias("c"), (F.col("ix") * span).alias("u"), (F.col("iy") * span).alias("v"), span.alias("s"))
    step = base.select("c", "u", "v", "s", F.explode(F.sequence(F.lit(0), F.col("s") - 1)).alias("k"))
    sides = F.array(
        F.struct(F.lit("h").alias("o"), (F.col("u") + F.col("k")).alias("p"), F.col("v").alias("q")),
        F.struct(F.lit("h").alias("o"), (F.col("u") + F.col("k")).alias("p"), (F.col("v") + F.col("s")).alias("q")),
        F.struct(F.lit("v").alias("o"), F.col("u").alias("p"), (F.col("v") + F.col("k")).alias("q")),
        F.struct(F.lit("v").alias("o"), (F.col("u") + F.col("s")).alias("p"), (F.col("v") + F.col("k")).alias("q")),
    )
    units = step.select("c", F.explode(sides).alias("e")).select("c", "e.*")
    # A unit edge belongs to two cells at most, so the group of each is at most two rows.
    met = units.groupBy("o", "p", "q").agg(F.min("c").alias("a"), F.max("c").alias("b")).filter("a <> b")
    return met.groupBy("a", "b").agg((F.count("*") * 25).alias("length_m"))


#: Levels of a pyramid: squares of the coarsest are 2^40 times as wide as those of the finest.
LEVELS = 40


def nearest_unbounded(points: DataFrame, shapes: DataFrame, key: str, measure: Callable[[], Column], reach: float, start: float, tie: list[str] | None = None, limit: float | None = None) -> DataFrame:
    """``key, m, status`` and the shape's ``tie`` columns: every point's nearest shape, however far.

    ``shapes`` have ``x, y`` in their middle and reach ``reach`` around it; ``measure`` gives the true distance over the columns
    of both; of equally near shapes the one with the least ``tie`` counts. ``status`` is ``attached``, ``too_far`` beyond ``limit``,
    ``no_shape``, or ``no_place`` for a point without coordinates; of the last two ``m`` is null.

    Squares that shapes stand in are kept at every size, from ``start`` doubling. A point climbs until a square about it is
    taken, which bounds its distance; then it descends, keeping the squares that may hold something nearer than the
    farthest corner of the best one. So a point meets the shapes of few squares whatever lies between.
    """
    tie = tie or []
    placed = F.coalesce(~F.isnan(F.col("x").cast("double")) & ~F.isnan(F.col("y").cast("double")) & (F.abs(F.col("x")) < float("inf")) & (F.abs(F.col("y")) < float("inf")), F.lit(False))
    own = checkpointed(points.filter(placed).select(key, F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y")))
    stand = checkpointed(shapes.filter(placed).withColumn("qx_", bucket(F.col("x"), start)).withColumn("qy_", bucket(F.col("y"), start)))
    taken = [checkpointed(stand.select("qx_", "qy_").distinct())]
    left, found = own, []
    around = F.explode(F.sequence(F.lit(-1).cast("long"), F.lit(1).cast("long")))
    for level in range(LEVELS if not taken[0].isEmpty() else 0):
        side = start * 2.0**level
        if level:
            half = lambda c: F.shiftright(c, 1).alias(c)
            taken.append(checkpointed(taken[-1].select(half("qx_"), half("qy_")).distinct()))
        cells = left.withColumn("i_", around).withColumn("j_", around).select(key, "x", "y", (bucket(F.col("x"), side) + F.col("i_")).alias("qx_"), (bucket(F.col("y"), side) + F.col("j_")).alias("qy_"))
        first = checkpointed(cells.join(taken[level], ["qx_", "qy_"], "left_semi").select(key, "x", "y").distinct())
        # Nothing farther than the far corner of a square next but one can be the nearest.
        wide = int(3 + reach // side + 1)
        more = F.explode(F.sequence(F.lit(-wide).cast("long"), F.lit(wide).cast("long")))
        found.append(first.withColumn("i_", more).withColumn("j_", more).select(key, "x", "y", (bucket(F.col("x"), side) + F.col("i_")).alias("qx_"), (bucket(F.col("y"), side) + F.col("j_")).alias("qy_")).join(taken[level], ["qx_", "qy_"], "left_semi"))
        left = checkpointed(left.join(first.select(key), key, "left_anti"))
        if left.isEmpty():
            break
    front = None
    for level in range(len(found) - 1, -1, -1):
        side = start * 2.0**level
        if front is not None:
            half = lambda c: F.shiftright(c, 1)
            down = taken[level].select("qx_", "qy_", half("qx_").alias("ux_"), half("qy_").alias("uy_"))
            front = front.withColumnsRenamed({"qx_": "ux_", "qy_": "uy_"}).join(down, ["ux_", "uy_"]).select(key, "x", "y", "qx_", "qy_").unionByName(found[level])
        else:
            front = found[level]
        x0, y0 = F.col("qx_") * side, F.col("qy_") * side
        off = lambda v, lo: F.greatest(F.lit(0.0), lo - v, v - lo - side)
        far = lambda v, lo: F.greatest(F.abs(v - lo), F.abs(lo + side - v))
        x, y = F.col("x"), F.col("y")
        held = front.withColumns({"lb_": F.sqrt(F.pow(off(x, x0), 2) + F.pow(off(y, y0), 2)) - reach, "ub_": F.sqrt(F.pow(far(x, x0), 2) + F.pow(far(y, y0), 2))})
        bound = held.groupBy(key).agg(F.min("ub_").alias("best_"))
        front = checkpointed(held.join(bound, key).filter(F.col("lb_") <= F.col("best_") + 1e-6).select(key, "x", "y", "qx_", "qy_"))
    every = points.select(key, placed.alias("placed_"))
    schema = [F.lit(None).cast(dict(shapes.dtypes)[c]).alias(c) for c in tie]
    if front is None:
        return every.select(key, F.lit(None).cast("double").alias("m"), F.when(F.col("placed_"), "no_shape").otherwise("no_place").alias("status"), *schema)
    right = stand.select("qx_", "qy_", *[F.col(c).alias(f"r_{c}") for c in shapes.columns])
    best = front.join(right, ["qx_", "qy_"]).withColumn("m", measure()).groupBy(key).agg(F.min(F.struct("m", *[F.col(f"r_{c}").alias(c) for c in tie])).alias("b"))
    status = F.when(~F.col("placed_"), "no_place")
    status = (status.when(F.col("b.m") > limit, "too_far") if limit is not None else status).otherwise("attached")
    return every.join(best, key, "left").select(key, F.col("b.m").alias("m"), status.alias("status"), *[F.col(f"b.{c}").alias(c) for c in tie])


def resolve_entrances(facilities: DataFrame, candidates: DataFrame, segments: DataFrame, limit_m: float, reach: float, ambiguous_m: float) -> DataFrame:
    """``id, entrance``: which of two candidates (``id, k, x, y``; k 0 the place, 1 the navigation point) a facility is entered by.

    Each candidate is attached to its nearest segment within the limit. One alone wins; two on one segment agree; two that
    are about as near are ambiguous; else the nearer wins.
    """
    at = [F.col(c) for c in ("x", "y", "r_ax", "r_ay", "r_bx", "r_by")]
    edge = F.struct(F.round(segment_distance(*at), 6).alias("m"), F.col("r_u").alias("u"), F.col("r_v").alias("v"))
    met = within_radius(candidates, segments, limit_m + reach).select("id", "k", edge.alias("e")).filter(F.col("e.m") <= limit_m)
    best = met.groupBy("id", "k").agg(F.min("e").alias("e")).groupBy("id").agg(F.max(F.when(F.col("k") == 0, F.col("e"))).alias("a"), F.max(F.when(F.col("k") == 1, F.col("e"))).alias("b"))
    a, b = F.col("a.m"), F.col("b.m")
    same = (F.col("a.u") == F.col("b.u")) & (F.col("a.v") == F.col("b.v"))
    entrance = (
        F.when(a.isNull() & b.isNull(), "no_edge").when(b.isNull(), "place").when(a.isNull(), "navigation").when(same, "agree").when(F.abs(a - b) <= ambiguous_m, "ambiguous").when(b < a, "navigation").otherwise("place")
    )
    return facilities.join(best, "id", "left").select("id", entrance.alias("entrance"))
