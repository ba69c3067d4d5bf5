"""Cells, blocks and levels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from footfall.functions.geo import clipped_ring, in_ring, ring_area, segments_meet
from footfall.session import spread

def cell_id(level: Column, ix: Column, iy: Column) -> Column:
    """``level:ix:iy``."""
    return F.concat_ws(":", level, ix, iy)


def cell_bounds(ix: Column, iy: Column, size: Column) -> tuple[Column, Column, Column, Column]:
    """x0, y0, x1, y1."""
    return ix * size, iy * size, (ix + 1) * size, (iy + 1) * size


def children(cells: DataFrame) -> DataFrame:
    """F8: the four halves of every cell, one level down."""
    d = F.explode(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a in (0, 1) for b in (0, 1)]))
    rest = [c for c in cells.columns if c not in ("ix", "iy", "level")]
    return cells.withColumn("d_", d).select(*rest, (F.col("ix") * 2 + F.col("d_.a")).alias("ix"), (F.col("iy") * 2 + F.col("d_.b")).alias("iy"), (F.col("level") + 1).alias("level"))


def cells_covering(areas: DataFrame, size: float, box: list[Column]) -> DataFrame:
    """every area with each cell ``cx, cy`` of its bounding box (x0, y0, x1, y1)."""
    lo_x, lo_y, hi_x, hi_y = [F.floor(b / size).cast("long") for b in box]
    return areas.withColumn("cx", F.explode(F.sequence(lo_x, hi_x))).withColumn("cy", F.explode(F.sequence(lo_y, hi_y)))


def ring_cells(areas: DataFrame, ring: str, size: float) -> DataFrame:
    """areas with each cell ``cx, cy`` of their rings' bounding boxes."""
    xs, ys = F.transform(ring, lambda p: p["x"].cast("double")), F.transform(ring, lambda p: p["y"].cast("double"))
    return cells_covering(areas, size, [F.array_min(xs), F.array_min(ys), F.array_max(xs), F.array_max(ys)])


def cell_parts(areas: DataFrame, ring: str, size: float) -> DataFrame:
    """``areas`` with each cell ``cx, cy`` of their bounding boxes and the ``part`` and ``area_m2`` of their ring within it.

    The parts of all cells add up to the ring's area; a cell that the ring misses has part [] and area 0.
    """
    at = ring_cells(spread(areas), ring, size)
    part = clipped_ring(F.col(ring), F.col("cx") * size, F.col("cy") * size, (F.col("cx") + 1) * size, (F.col("cy") + 1) * size)
    return at.withColumn("part", part).withColumn("area_m2", F.when(F.size("part") > 2, F.abs(ring_area(F.col("part")))).otherwise(0.0))


def blocks_meeting(areas: DataFrame, ring: str, size: float) -> DataFrame:
    """``areas`` with each square block ``cx, cy`` that shares a point with their ring: a corner within the other, or sides that meet."""
    at = ring_cells(spread(areas), ring, size)
    x0, y0 = F.col("cx") * float(size), F.col("cy") * float(size)
    x1, y1 = x0 + size, y0 + size
    corner = in_ring(x0, y0, F.col(ring))
    first = F.get(F.col(ring), F.lit(0))
    held = (first["x"] >= x0) & (first["x"] <= x1) & (first["y"] >= y0) & (first["y"] <= y1)

    def met(p: Column, i: Column) -> Column:
        q = F.get(F.col(ring), (i + 1) % F.size(ring))
        side = (p["x"], p["y"], q["x"], q["y"])
        return segments_meet(side, (x0, y0, x1, y0)) | segments_meet(side, (x1, y0, x1, y1)) | segments_meet(side, (x1, y1, x0, y1)) | segments_meet(side, (x0, y1, x0, y0))

    crossed = F.exists(F.transform(ring, met), lambda b: b)
    return at.filter(corner | held | crossed)


def cells_of_boxes(boxes: DataFrame, size: int) -> DataFrame:
    """The distinct cells of a set of aligned boxes: their union, without double counting."""
    u = F.explode(F.sequence(F.floor(F.col("x0") / size), F.floor((F.col("x1") - 1) / size)))
    v = F.explode(F.sequence(F.floor(F.col("y0") / size), F.floor((F.col("y1") - 1) / size)))
    return boxes.select("y0", "y1", u.alias("u")).select("u", v.alias("v")).distinct()


def complete_upwards(leaves: DataFrame, levels: int, itself: Column) -> DataFrame:
    """``level, bx, by_, done``: a block is done if all four of its children are, or ``itself`` (an aggregate) says so."""
    level = leaves.select(F.lit(0).alias("level"), "bx", "by_", "done")
    out = level
    for n in range(1, levels + 1):
        up = level.groupBy(F.floor(F.col("bx") / 2).alias("px"), F.floor(F.col("by_") / 2).alias("py")).agg(((F.bool_and("done") & (F.count("*") == 4)) | itself).alias("done"))
        level = up.select(F.lit(n).alias("level"), F.col("px").cast("long").alias("bx"), F.col("py").cast("long").alias("by_"), "done")
        out = out.unionByName(level)
    return out


def two_levels(samples: DataFrame, ok: str, size: float = 50.0) -> DataFrame:
    """M4: ``level, ix, iy, verdict``: cells that their samples decide, and the halves of those they do not.

    ``samples`` has ``x, y`` and a boolean ``ok``. Half cells that stay undecided are unknown.
    """
    def verdicts(df: DataFrame, edge: float) -> DataFrame:
        cell = [F.floor(F.col(c) / edge).cast("long").alias(f"i{c}") for c in ("x", "y")]
        all_, any_ = F.bool_and(ok), F.bool_or(ok)
        return df.groupBy(*cell).agg(F.when(all_, "covered").when(~any_, "gap").alias("verdict"))

    first = verdicts(samples, size)
    open_ = first.filter("verdict IS NULL").select("ix", "iy")
    own = samples.withColumn("cx_", F.floor(F.col("x") / size).cast("long")).withColumn("cy_", F.floor(F.col("y") / size).cast("long"))
    left = own.join(open_.withColumnsRenamed({"ix": "cx_", "iy": "cy_"}), ["cx_", "cy_"], "left_semi")
    second = verdicts(left, size / 2).withColumn("verdict", F.coalesce("verdict", F.lit("unknown")))
    return first.filter("verdict IS NOT NULL").withColumn("level", F.lit(0)).unionByName(second.withColumn("level", F.lit(1)))
