"""Raster time fields: triangles with a time at each corner laid over a grid of nodes.

A triangle is scan-converted where it lies: each line of nodes that it meets gets the nodes between its sides,
so a large triangle costs the nodes it covers and no more, and nothing is compared across triangles. Nodes and
cells are then plain groups with map-side combine.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from footfall.functions.geo import barycentric, share_below

#: How far outside a triangle, in weights and metres, a node still counts as on its side.
SLACK, EDGE = 1e-9, 1e-8


def _crossing_x(y: Column, px: Column, py: Column, qx: Column, qy: Column) -> Column:
    """Where a side meets the line at ``y``: struct of the least and greatest x; null where it does not."""
    x = px + (y - py) * (qx - px) / F.nullif(qy - py, F.lit(0.0))
    level = F.struct(F.least(px, qx).alias("lo"), F.greatest(px, qx).alias("hi"))
    meets = (y >= F.least(py, qy) - EDGE) & (y <= F.greatest(py, qy) + EDGE)
    return F.when(meets & (py == qy), level).when(meets, F.struct(x.alias("lo"), x.alias("hi")))


def node_times(triangles: DataFrame, x0: float, y0: float, step: float, nx: int, ny: int, order: str = "ord") -> DataFrame:
    """``i, j, seconds``: the time at every node that a triangle holds; of several triangles the last in ``order`` has it.

    ``triangles`` have ``order`` and ``ax, ay, at, bx, by, bt, cx, cy, ct``. One with an unknown time, or without area,
    says nothing. Nodes stand at (x0 + i * step, y0 + j * step), 0 <= i < nx, 0 <= j < ny. M17.
    """
    corner = {c: F.col(c).cast("double") for p in "abc" for c in (f"{p}x", f"{p}y", f"{p}t")}
    known = triangles.filter(" AND ".join(f"{p}t IS NOT NULL" for p in "abc")).select(order, *[v.alias(c) for c, v in corner.items()])
    ys = [F.col(f"{p}y") for p in "abc"]
    low, high = F.ceil((F.least(*ys) - EDGE - y0) / step), F.floor((F.greatest(*ys) + EDGE - y0) / step)
    low, high = F.greatest(F.lit(0).cast("long"), low), F.least(F.lit(ny - 1).cast("long"), high)
    lines = known.filter(low <= high).withColumn("j", F.explode(F.sequence(low, high)))
    y = F.col("j") * step + y0
    spans = [_crossing_x(y, *[F.col(c) for c in (f"{p}x", f"{p}y", f"{q}x", f"{q}y")]) for p, q in ("ab", "bc", "ca")]
    lines = lines.withColumns({f"s{k}": s for k, s in enumerate(spans)})
    left, right = F.least(*[F.col(f"s{k}.lo") for k in range(3)]), F.greatest(*[F.col(f"s{k}.hi") for k in range(3)])
    # A node more on either side: the weights decide.
    left, right = F.greatest(F.lit(0).cast("long"), F.floor((left - x0) / step)), F.least(F.lit(nx - 1).cast("long"), F.ceil((right - x0) / step))
    nodes = lines.withColumns({"left": left, "right": right}).filter("left <= right").withColumn("i", F.explode(F.sequence("left", "right")))
    w = barycentric(F.col("i") * step + x0, y, *[F.col(c) for c in ("ax", "ay", "bx", "by", "cx", "cy")])
    held = nodes.filter((w[0] >= -SLACK) & (w[1] >= -SLACK) & (w[2] >= -SLACK))
    seconds = w[0] * F.col("at") + w[1] * F.col("bt") + w[2] * F.col("ct")
    return held.select("i", "j", order, seconds.alias("s")).groupBy("i", "j").agg(F.max_by("s", order).alias("seconds"))


def field_cells(nodes: DataFrame, nx: int, ny: int) -> DataFrame:
    """``i, j, known, t00, t10, t01, t11``: the cells that touch a known node, with how many of their nodes are known.

    A cell with all four is known; one with fewer is the halo about the unknown, which is never taken for unreachable. M17.
    """
    around = F.explode(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a in (0, 1) for b in (0, 1)]))
    met = nodes.withColumn("d", around).select((F.col("i") - F.col("d.a")).alias("i"), (F.col("j") - F.col("d.b")).alias("j"), "d", "seconds")
    met = met.filter((F.col("i") >= 0) & (F.col("j") >= 0) & (F.col("i") < nx - 1) & (F.col("j") < ny - 1))
    corner = lambda a, b: F.max(F.when((F.col("d.a") == a) & (F.col("d.b") == b), F.col("seconds"))).alias(f"t{a}{b}")
    return met.groupBy("i", "j").agg(F.count("*").alias("known"), corner(0, 0), corner(1, 0), corner(0, 1), corner(1, 1))


def field_bands(cells: DataFrame, minutes: list[int]) -> DataFrame:
    """``i, j, state, seconds, band``: known cells with the time in their middle and the first band (in minutes) that holds it, and the halo."""
    whole = F.col("known") == 4
    middle = (F.col("t00") + F.col("t10") + F.col("t01") + F.col("t11")) / 4
    band = None
    for m in sorted(minutes):
        band = F.when(middle <= 60 * m, m) if band is None else band.when(middle <= 60 * m, m)
    state = F.when(whole, "known").otherwise("halo")
    return cells.select("i", "j", state.alias("state"), F.when(whole, middle).alias("seconds"), F.when(whole, band).alias("band"))


def reached_areas(cells: DataFrame, minutes: list[int], cell_m2: float) -> DataFrame:
    """``minutes, whole, cut, area_m2``: known cells within a time, those its line cuts, and the area within, each cell as four triangles about its middle."""
    known = cells.filter("known = 4").withColumn("m", (F.col("t00") + F.col("t10") + F.col("t01") + F.col("t11")) / 4)
    each = known.withColumn("minutes", F.explode(F.array(*[F.lit(m) for m in minutes])))
    level = F.col("minutes") * 60.0
    turn = ["t00", "t10", "t11", "t01"]
    share = sum(share_below(F.col(a), F.col(b), F.col("m"), level) for a, b in zip(turn, turn[1:] + turn[:1], strict=True)) / 4
    top, bottom = F.greatest(*turn), F.least(*turn)
    whole, cut = top <= level, (bottom <= level) & (top > level)
    return each.groupBy("minutes").agg(F.count_if(whole).alias("whole"), F.count_if(cut).alias("cut"), F.sum(share * cell_m2).alias("area_m2"))


def contour_segments(triangles: DataFrame, level: float, order: str = "ord") -> DataFrame:
    """``order, x1, y1, x2, y2``: where each triangle's plane meets a level: the ends on its sides ab, bc, ca in turn. F18.

    A corner at the level counts as below it; a triangle with an unknown time has no line.
    """

    def cut(p: str, q: str) -> Column:
        a, b = F.col(f"{p}t").cast("double"), F.col(f"{q}t").cast("double")
        s = (level - a) / F.nullif(b - a, F.lit(0.0))
        at = [F.col(f"{p}{c}") + s * (F.col(f"{q}{c}") - F.col(f"{p}{c}")) for c in "xy"]
        return F.when((a <= level) != (b <= level), F.struct(at[0].alias("x"), at[1].alias("y")))

    known = triangles.filter(" AND ".join(f"{p}t IS NOT NULL" for p in "abc"))
    ends = known.select(order, F.array_compact(F.array(cut("a", "b"), cut("b", "c"), cut("c", "a"))).alias("e")).filter(F.size("e") == 2)
    return ends.select(order, *[F.col("e")[k][c].alias(f"{c}{k + 1}") for k in (0, 1) for c in "xy"])
