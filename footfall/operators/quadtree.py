"""Quadtree cells over samples: refinement scores and where to look next.

A cell is (level, ix, iy); its key at its level interleaves ix and iy, so a cell's parent is its key without the
last two bits and cells of all levels lie along one curve. A sample stands on the sides of few cells of a level,
found from its place alone, so samples meet cells of every level by key and a cell's side sees the samples of
finer neighbours on it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from footfall.operators.nearby import within_radius

#: How far from a grid line, in shares of a cell, a sample is still on it.
ON_LINE = 1e-9


def morton(ix: Column, iy: Column) -> Column:
    """Interleaved bits of two numbers from 0 to 2^31 - 1 (ix in the even ones)."""

    def spread(v: Column) -> Column:
        out = v.cast("long")
        for shift, mask in ((16, 0x0000FFFF0000FFFF), (8, 0x00FF00FF00FF00FF), (4, 0x0F0F0F0F0F0F0F0F), (2, 0x3333333333333333), (1, 0x5555555555555555)):
            out = out.bitwiseOR(F.shiftleft(out, shift)).bitwiseAND(F.lit(mask))
        return out

    return spread(ix).bitwiseOR(F.shiftleft(spread(iy), 1))


def parent(key: Column) -> Column:
    """The key, a level up, of the cell that holds a cell."""
    return F.shiftright(key, 2)


def cell_samples(leaves: DataFrame, samples: DataFrame, x0: float, y0: float, size: float, levels: int) -> DataFrame:
    """Every sample with each leaf on whose sides or in whose middle it stands: the samples' columns, ``level, ix, iy`` and
    ``on_left, on_right, on_bottom, on_top, middle``.

    Leaves of level n have side ``size / 2^n`` and are counted from (x0, y0), levels from 0 to ``levels - 1``. A sample is
    written to at most four cells a level; one inside a cell, off its middle, to none.
    """
    at = samples.withColumn("level", F.explode(F.sequence(F.lit(0), F.lit(levels - 1))))
    side = F.lit(float(size)) / F.pow(F.lit(2.0), F.col("level"))
    at = at.withColumns({"qx_": (F.col("x") - x0) / side, "qy_": (F.col("y") - y0) / side})
    for c in ("x", "y"):
        near = F.round(F.col(f"q{c}_"))
        line = F.abs(F.col(f"q{c}_") - near) < ON_LINE
        first = F.floor(F.col(f"q{c}_")).cast("int")
        at = at.withColumns({f"line_{c}": line, f"i{c}_": F.when(line, F.array(near.cast("int") - 1, near.cast("int"))).otherwise(F.array(first)), f"n{c}_": near.cast("int"), f"h{c}_": F.abs(F.col(f"q{c}_") - F.floor(F.col(f"q{c}_")) - 0.5) < ON_LINE})
    at = at.withColumn("middle", F.col("hx_") & F.col("hy_")).filter("line_x OR line_y OR middle")
    at = at.withColumn("ix", F.explode("ix_")).withColumn("iy", F.explode("iy_")).filter("ix >= 0 AND iy >= 0")
    flags = {
        "on_left": F.col("line_x") & (F.col("ix") == F.col("nx_")), "on_right": F.col("line_x") & (F.col("ix") == F.col("nx_") - 1),
        "on_bottom": F.col("line_y") & (F.col("iy") == F.col("ny_")), "on_top": F.col("line_y") & (F.col("iy") == F.col("ny_") - 1),
    }
    at = at.withColumns(flags).withColumn("cell_", morton(F.col("ix"), F.col("iy")))
    keyed = leaves.select(F.col("level").cast("int").alias("level"), morton(F.col("ix"), F.col("iy")).alias("cell_"))
    return at.join(keyed, ["level", "cell_"], "left_semi").select(*samples.columns, "level", "ix", "iy", *flags, "middle")


def priorities(leaves: DataFrame, met: DataFrame, size: float, limit: float, band: float, time: str = "t") -> DataFrame:
    """``level, ix, iy, score, candidate, residual`` of every leaf; ``met`` are its samples from `cell_samples`. M15.

    Four for a limit that runs through the cell, up to two for a time near it, for a middle that its corners do not foretell,
    and up to one for a wide range, all by the cell's size; a candidate is a cell with any of these.
    """
    t = F.col(time)
    corner = (F.col("on_left") | F.col("on_right")) & (F.col("on_bottom") | F.col("on_top"))
    per = met.groupBy("level", "ix", "iy").agg(
        F.min(t).alias("lo"), F.max(t).alias("hi"), F.min(F.abs(t - limit)).alias("near"),
        F.max(F.when(F.col("middle"), t)).alias("mid"), F.avg(F.when(corner, t)).alias("mean"), F.count(F.when(corner, t)).alias("corners"),
    )
    rows = leaves.select(F.col("level").cast("int").alias("level"), "ix", "iy").join(per, ["level", "ix", "iy"], "left")
    crossing = (F.col("lo") <= limit) & (F.col("hi") > limit)
    near = F.greatest(F.lit(0.0), 1 - F.col("near") / band)
    residual = F.coalesce(F.when(F.col("corners") == 4, F.abs(F.col("mid") - F.col("mean"))), F.lit(0.0))
    span = F.col("hi") - F.col("lo")
    wide = F.lit(float(size)) / F.pow(F.lit(2.0), F.col("level")) / 400
    score = wide * (4 * crossing.cast("int") + 2 * near + 2 * F.least(residual / 120, F.lit(1.0)) + F.least(span / 300, F.lit(1.0)))
    candidate = crossing | (F.col("near") <= band) | (residual > 60) | (span > 300)
    some = F.col("lo").isNotNull()
    return rows.select("level", "ix", "iy", F.when(some, score).otherwise(0.0).alias("score"), F.when(some, candidate).otherwise(False).alias("candidate"), F.when(some, residual).otherwise(0.0).alias("residual"))


def edge_candidates(met: DataFrame, samples: DataFrame, limit: float, spacing: float, time: str = "t", active: str = "active") -> DataFrame:
    """``x, y``: where the limit is expected on the sides of leaves: between neighbouring samples of opposite labels. M16.

    The place is interpolated, a tenth of the way from either at least. A side with two active samples is settled, and a
    place nearer than ``spacing`` to any sample is left out.
    """
    side = F.explode(F.array_compact(F.array(*[F.when(F.col(f), F.lit(f)) for f in ("on_left", "on_right", "on_bottom", "on_top")])))
    rows = met.withColumn("side", side).withColumn("along", F.when(F.col("side").isin("on_left", "on_right"), F.col("y")).otherwise(F.col("x")))
    # A side holds the samples of finer neighbours on it and no others: some dozens.
    one = Window.partitionBy("level", "ix", "iy", "side")
    nxt = lambda c: F.lead(c).over(one.orderBy("along"))
    pairs = rows.select("side", "x", "y", F.col(time).alias("ta"), nxt("x").alias("bx"), nxt("y").alias("by_"), nxt(time).alias("tb"), F.count_if(F.coalesce(F.col(active), F.lit(False))).over(one).alias("settled"))
    opposite = pairs.filter((F.col("settled") < 2) & ((F.col("ta") <= limit) != (F.col("tb") <= limit)))
    alpha = F.greatest(F.lit(0.1), F.least(F.lit(0.9), (limit - F.col("ta")) / (F.col("tb") - F.col("ta"))))
    place = [F.round(F.col(a) + alpha * (F.col(b) - F.col(a)), 8).alias(a) for a, b in (("x", "bx"), ("y", "by_"))]
    found = opposite.select(*place).distinct()
    close = within_radius(found, samples.select("x", "y"), spacing).filter(F.col("distance_m") < spacing - 1e-8).select("x", "y")
    return found.join(close, ["x", "y"], "left_anti")
