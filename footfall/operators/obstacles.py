"""Obstacles as lines and areas: crossings, covered parts, edges behind water, shares of cells.

Lines are keyed by the squares that they run through (their supercover), areas by the squares of their bounding box, so
what may meet has an equal key; an exact test by orientations, or the exact parts of a segment within a ring, follows.
Where only numbers are asked, segments are dealt by the squares of their starts and no pairs are made (``sweeps``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from footfall.functions.geo import planar, segment_gap
from footfall.operators import sweeps
from footfall.operators.grid import cell_parts

#: Metres of contact that are still a touch and no crossing.
TOUCH = 0.1
SEGMENT = ("ax", "ay", "bx", "by_")


def _ends(prefix: str = "") -> tuple[Column, ...]:
    return tuple(F.col(f"{prefix}{c}").cast("double") for c in SEGMENT)


def polyline_segments(lines: DataFrame, key: list[str], parts: str = "parts") -> DataFrame:
    """``key, ax, ay, bx, by_``: the steps of lines of several parts (array of arrays of struct x, y); nothing joins two parts."""
    part = lines.select(*key, F.explode(parts).alias("p"))
    steps = F.transform(F.sequence(F.lit(1), F.size("p") - 1), lambda i: F.struct(F.get("p", i - 1).alias("a"), F.get("p", i).alias("b")))
    each = part.filter(F.size("p") > 1).select(*key, F.explode(steps).alias("s"))
    return each.select(*key, *[F.col(f"s.{e}.{c}").cast("double").alias(n) for n, (e, c) in zip(SEGMENT, (("a", "x"), ("a", "y"), ("b", "x"), ("b", "y")), strict=True)])


def supercover(segments: DataFrame, size: Column | float, margin: Column | float = 0.0) -> DataFrame:
    """``segments`` with every square ``cx, cy`` that they come within ``margin`` of (and a few more at its corners).

    Column by column of squares: what the segment spans there in y is written, not its whole box.
    """
    ax, ay, bx, by = _ends()
    m = (F.lit(margin) if isinstance(margin, float) else margin) + 1e-6
    columns = F.sequence(F.floor((F.least(ax, bx) - m) / size), F.floor((F.greatest(ax, bx) + m) / size))
    rows = segments.withColumn("cx", F.explode(columns))

    def y_at(x: Column, upright: Column) -> Column:
        t = F.greatest(F.lit(0.0), F.least(F.lit(1.0), (x - ax) / (bx - ax)))
        return F.when(ax == bx, upright).otherwise(ay + t * (by - ay))

    y0, y1 = y_at(F.col("cx") * size - m, ay), y_at((F.col("cx") + 1) * size + m, by)
    return rows.withColumn("cy", F.explode(F.sequence(F.floor((F.least(y0, y1) - m) / size), F.floor((F.greatest(y0, y1) + m) / size))))


def crossed_lines(connectors: DataFrame, walls: DataFrame, key: str, wall: str, width: str, size: float) -> DataFrame:
    """``key, wall``: the walls (segments with a ``width``) that each connector comes within half their width of. J10."""
    own = supercover(connectors.select(key, *SEGMENT), size)
    other = supercover(walls.select(wall, width, *SEGMENT), size, F.col(width) / 2.0)
    other = other.select("cx", "cy", wall, width, *[F.col(c).alias(f"w{c}") for c in SEGMENT])
    met = own.join(other, ["cx", "cy"]).filter(segment_gap(_ends(), _ends("w")) <= F.col(width) / 2.0)
    return met.select(key, wall).distinct()


def _by_start(segments: DataFrame, size: float) -> tuple[DataFrame, DataFrame]:
    """Distinct ``segments`` by the square ``tx_, ty_`` of their start, twice ``size`` wide on ``level_`` 0 and doubled with each, and the levels.

    A segment is on the first level whose squares are as wide as it reaches; levels have that side ``side_`` and the longest ``reach_``.
    """
    ax, ay, bx, by = _ends()
    whole = F.lit(True)
    for c in _ends():
        whole = whole & (F.abs(c) < float("inf"))
    reach = F.greatest(F.abs(bx - ax), F.abs(by - ay))
    level = F.greatest(F.lit(0), F.ceil(F.log2(reach / (2.0 * size)))).cast("int")
    side = F.pow(F.lit(2.0), F.col("level_")) * (2.0 * size)
    each = segments.select(*[c.alias(n) for c, n in zip(_ends(), SEGMENT, strict=True)]).filter(whole).distinct().withColumn("level_", level)
    at = each.withColumns({f"t{c}_": F.floor(F.col(f"a{c}") / side).cast("long") for c in "xy"})
    levels = at.groupBy("level_").agg(F.max(reach).alias("reach_"))
    return at, levels.select(F.col("level_").alias("level_"), "reach_", side.alias("side_"))


def _with_numbers(segments: DataFrame, key: list[str], numbers: DataFrame) -> DataFrame:
    """``key`` of every segment, its ends as doubles, and the columns of ``numbers`` for its place (null where it has none)."""
    return segments.select(*key, *[c.alias(n) for c, n in zip(_ends(), SEGMENT, strict=True)]).join(numbers, list(SEGMENT), "left")


def crossed_counts(connectors: DataFrame, walls: DataFrame, key: str, wall: str, width: str, size: float) -> DataFrame:
    """``key, walls``: of how many walls (segments with a ``width``) each connector comes within half their width; none: 0. J10.

    The numbers of :func:`crossed_lines` without its pairs. ``size`` is the side of squares, at best about as long as connectors.
    """
    at, levels = _by_start(connectors, size)
    half = F.col(width).cast("double") / 2.0
    lines = walls.select(F.col(wall).alias("line"), half.alias("half"), *[c.alias(n) for c, n in zip(_ends(), SEGMENT, strict=True)]).filter("line IS NOT NULL AND half >= 0")
    near = supercover(lines.crossJoin(F.broadcast(levels)), F.col("side_"), F.col("half") + F.col("reach_"))
    held = near.select("line", "half", *SEGMENT, "level_", F.col("cx").alias("tx_"), F.col("cy").alias("ty_"))
    met = sweeps.dealt(at, held, ["level_", "tx_", "ty_"], sweeps.lines_met, "ax double, ay double, bx double, by_ double, n long", ["line"])
    whole = met.groupBy(*SEGMENT).agg(F.sum("n").alias("n"))  # a crowded square's walls come in several parts
    return _with_numbers(connectors, [key], whole).select(key, F.coalesce("n", F.lit(0).cast("long")).alias("walls"))


def covered_lengths(segments: DataFrame, areas: DataFrame, key: list[str], area: str, size: float, ring: str = "ring") -> DataFrame:
    """``key, length_m, covered_m``: metres of every segment, and those within any of the areas, overlaps counted once. J10, J14.

    Segments are dealt by the square of their start, areas to the squares of the starts that may reach their box. There an area
    meets the lines on which segments lie, each once for all of its segments, and a segment takes its share of what is covered of its line.
    """
    at, levels = _by_start(segments, size)
    xs, ys = F.transform(ring, lambda p: p["x"].cast("double")), F.transform(ring, lambda p: p["y"].cast("double"))
    sound = lambda v: F.forall(v, lambda c: F.coalesce(F.abs(c) < float("inf"), F.lit(False)))
    whole = areas.select(xs.alias("xs"), ys.alias("ys")).filter((F.size("xs") > 0) & sound("xs") & sound("ys"))
    span = lambda v: F.explode(F.sequence(F.floor((F.array_min(v) - F.col("reach_")) / F.col("side_")), F.floor((F.array_max(v) + F.col("reach_")) / F.col("side_"))))
    held = whole.crossJoin(F.broadcast(levels)).withColumn("tx_", span("xs")).withColumn("ty_", span("ys")).drop("reach_", "side_")
    shares = sweeps.dealt(at, held, ["level_", "tx_", "ty_"], sweeps.shares_held, "ax double, ay double, bx double, by_ double, share double", [])
    own = _with_numbers(segments, key, shares).withColumn("length_m", planar(*_ends()))
    return own.select(*key, "length_m", (F.coalesce("share", F.lit(0.0)) * F.col("length_m")).alias("covered_m"))


def shared_segments(cells: DataFrame, key: str = "cell", unit: float = 25.0) -> DataFrame:
    """``a, b, n, ax, ay, bx, by_``: the unit edges that two cells share, levels mixed (level 0: two units wide, 1: one). J14."""
    span = F.when(F.col("level") == 0, 2).otherwise(1)
    base = cells.select(F.col(key).alias("c"), (F.col("ix") * span).alias("u"), (F.col("iy") * span).alias("v"), span.alias("s"))
    step = base.withColumn("k", F.explode(F.sequence(F.lit(0), F.col("s") - 1)))
    ends = [(0, "u + k", "v"), (0, "u + k", "v + s"), (1, "u", "v + k"), (1, "u + s", "v + k")]
    sides = F.array(*[F.struct(F.lit(o).alias("o"), F.expr(p).alias("p"), F.expr(q).alias("q")) for o, p, q in ends])
    units = step.select("c", F.explode(sides).alias("e")).select("c", "e.*").groupBy("o", "p", "q").agg(F.min("c").alias("a"), F.max("c").alias("b")).filter("a <> b")
    x, y = F.col("p") * unit, F.col("q") * unit
    upright = F.col("o") == 1
    return units.select("a", "b", F.concat_ws(":", "o", "p", "q").alias("n"), x.alias("ax"), y.alias("ay"), F.when(upright, x).otherwise(x + unit).alias("bx"), F.when(upright, y + unit).otherwise(y).alias("by_"))


def separations(cells: DataFrame, areas: DataFrame, area: str, size: float, key: str = "cell", touch: float = TOUCH) -> DataFrame:
    """``a, b, length_m, free_m, separated``: cells that share an edge, what of it no area covers, and whether nothing is left. J14."""
    edges = shared_segments(cells, key)
    per = covered_lengths(edges, areas, ["a", "b", "n"], area, size).groupBy("a", "b").agg(F.sum("length_m").alias("length_m"), F.sum(F.col("length_m") - F.col("covered_m")).alias("free_m"))
    return per.withColumn("separated", F.col("free_m") <= touch)


def line_parts(segments: DataFrame, size: float) -> DataFrame:
    """``segments`` with each square ``cx, cy`` that they run through and the metres ``line_m`` within it. M22."""
    ax, ay, bx, by = _ends()

    def reach(a: Column, b: Column, lo: Column, hi: Column) -> tuple[Column, Column]:
        d = F.nullif(b - a, F.lit(0.0))
        t0, t1 = (lo - a) / d, (hi - a) / d
        inside = (a >= lo) & (a < hi)
        return F.coalesce(F.least(t0, t1), F.when(inside, 0.0).otherwise(2.0)), F.coalesce(F.greatest(t0, t1), F.when(inside, 1.0).otherwise(-1.0))

    at = supercover(segments, size)
    (u0, u1), (v0, v1) = reach(ax, bx, F.col("cx") * size, (F.col("cx") + 1) * size), reach(ay, by, F.col("cy") * size, (F.col("cy") + 1) * size)
    share = F.least(F.lit(1.0), u1, v1) - F.greatest(F.lit(0.0), u0, v0)
    return at.withColumn("line_m", share * planar(ax, ay, bx, by)).filter("line_m > 0")


def obstacle_cells(areas: DataFrame, segments: DataFrame, size: float, width: str, ring: str = "ring") -> DataFrame:
    """``cx, cy, water_m2, line_m, line_m2, share``: what obstacles take of each cell: areas by their true parts, lines by length and by width. J18, M22.

    Overlapping obstacles add up; a cell's share stops at 1.
    """
    water = cell_parts(areas, ring, size).groupBy("cx", "cy").agg(F.sum("area_m2").alias("water_m2")).filter("water_m2 > 0")
    lines = line_parts(segments, size).groupBy("cx", "cy").agg(F.sum("line_m").alias("line_m"), F.sum(F.col("line_m") * F.col(width)).alias("line_m2"))
    both = water.join(lines, ["cx", "cy"], "full").na.fill(0.0, ["water_m2", "line_m", "line_m2"])
    return both.withColumn("share", F.least(F.lit(1.0), (F.col("water_m2") + F.col("line_m2")) / float(size * size)))


def near_blocks(cells: DataFrame, blocks: DataFrame, on: list[str], reach: float, cell_m: float) -> DataFrame:
    """Cells (``x0, y0`` of squares of ``cell_m``) whose box lies within ``reach`` of the box (``x0, y0, x1, y1``) of a block with equal ``on``. J12.

    A block of any size is written to the buckets (of side ``reach``) of the corners that cells near it can have.
    """
    far = reach + cell_m
    span = lambda lo, hi: F.explode(F.sequence(F.floor((F.col(lo) - far) / reach), F.floor((F.col(hi) + reach) / reach)))
    b = blocks.select(*on, *[F.col(c).cast("double").alias(f"b{c}") for c in ("x0", "y0", "x1", "y1")]).withColumn("kx_", span("bx0", "bx1")).withColumn("ky_", span("by0", "by1"))
    keyed = cells.withColumn("kx_", F.floor(F.col("x0") / reach)).withColumn("ky_", F.floor(F.col("y0") / reach))
    dx = F.greatest(F.lit(0.0), b["bx0"] - keyed["x0"] - cell_m, keyed["x0"] - b["bx1"])
    dy = F.greatest(F.lit(0.0), b["by0"] - keyed["y0"] - cell_m, keyed["y0"] - b["by1"])
    test = (keyed["kx_"] == b["kx_"]) & (keyed["ky_"] == b["ky_"]) & (dx * dx + dy * dy <= reach * reach)
    for c in on:
        test = test & (keyed[c] == b[c])
    return keyed.join(b, test, "left_semi").drop("kx_", "ky_")


def influenced(verdicts: DataFrame, key: list[str], unfinished: DataFrame, unresolved: DataFrame, verdict: str = "verdict") -> DataFrame:
    """Verdicts after what may lie near by: a gap near an unfinished block, or else near an unresolved entrance, is unknown. M2.

    ``unfinished`` and ``unresolved`` hold the keys of the cells concerned; ``reason`` says which of them it was.
    """
    a = unfinished.select(*key).distinct().withColumn("a_", F.lit(True))
    b = unresolved.select(*key).distinct().withColumn("b_", F.lit(True))
    gap = F.col(verdict) == "gap"
    reason = F.when(gap & F.col("a_"), "query_incomplete_nearby").when(gap & F.col("b_"), "entrance_unresolved_nearby")
    rows = verdicts.join(a, key, "left").join(b, key, "left").withColumn("reason", reason)
    return rows.withColumn(verdict, F.when(F.col("reason").isNotNull(), "unknown").otherwise(F.col(verdict))).drop("a_", "b_")
