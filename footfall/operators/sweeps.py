"""What holds a point, told without pairs: counts within circles, the last of the triangles over a place, lines near segments.

Places are dealt by squares, shapes to every square that their box meets, and crowded squares over several tasks. Within a
square the places of one x are a column in order of y, and a convex shape holds a run of it. Runs are added up by their ends, or
their maxima taken by doubling, so a column costs one step for each shape and place, not for each pair. Where places share
their coordinates, as on a raster, this grows with the shapes and the raster; where none does, it is no worse than pairs.

Segments alike but for their place are points too: what comes near one of them is a convex shape over its starts. Those on one
straight line share what areas hold of that line.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from footfall.operators.nearby import bucket
from footfall.session import spread

#: Places, and shapes, of one square that one task takes at once.
SHARE = 1 << 17
#: How far beyond a computed end of a run its places are still tested.
SLACK = 1e-4
LEAST = np.iinfo(np.int64).min
#: Runs, or places where lines meet rings, that are held at once.
CHUNK = 1 << 17
SEGMENT = ["ax", "ay", "bx", "by_"]


def _finite(*columns: str) -> Column:
    """Whether all of the (double) columns are numbers."""
    test = F.lit(True)
    for c in columns:
        test = test & (F.abs(F.col(c)) < float("inf"))
    return test


def _swept(places: DataFrame, shapes: DataFrame, size: float, sweep: Callable[[pd.DataFrame, pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    """``sweep`` over the distinct ``places`` (``x, y``) of each square of side ``size`` and the shapes whose box ``x0_, x1_, y0_, y1_`` meets it."""
    at = places.withColumns({"tx_": bucket(F.col("x"), size), "ty_": bucket(F.col("y"), size)})
    over = lambda c: F.explode(F.sequence(bucket(F.col(f"{c}0_"), size), bucket(F.col(f"{c}1_"), size)))
    held = shapes.withColumn("tx_", over("x")).withColumn("ty_", over("y"))
    return dealt(at, held, ["tx_", "ty_"], sweep, schema)


def dealt(places: DataFrame, shapes: DataFrame, tile: list[str], sweep: Callable[[pd.DataFrame, pd.DataFrame], pd.DataFrame], schema: str, together: list[str] | None = None) -> DataFrame:
    """``sweep`` over the places and the shapes of each ``tile``, either side of a crowded one in parts that all meet.

    Shapes equal in ``together`` stay in one part; all of a tile's do where it is empty.
    """
    key = [*tile, "part_", "among_"]
    parts = F.ceil(F.count("*") / SHARE)
    among = parts if together is None or together else F.lit(1).cast("long")
    tiles = places.groupBy(*tile).agg(parts.alias("part_")).join(shapes.groupBy(*tile).agg(among.alias("among_")), tile)

    def split(df: DataFrame, own: str, other: str, by: list[str]) -> DataFrame:
        own_part = F.pmod(F.xxhash64(*by) if by else F.lit(0).cast("long"), F.col(own)).alias(own)
        every = F.explode(F.sequence(F.lit(0).cast("long"), F.col(other) - 1)).alias(other)
        return spread(df.join(tiles, tile).select(*df.columns, own_part, every), *key)

    own, other = split(places, "part_", "among_", places.columns), split(shapes, "among_", "part_", shapes.columns if together is None else together)
    return own.groupBy(*key).cogroup(other.groupBy(*key)).applyInPandas(sweep, schema)


def _columns(p: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """x and y of places in order, and where each column begins and the last ends."""
    x, y = p["x"].to_numpy(), p["y"].to_numpy()
    order = np.lexsort((y, x))
    x, y = x[order], y[order]
    return x, y, np.flatnonzero(np.r_[True, x[1:] != x[:-1], True]) if len(x) else np.zeros(1, np.int64)


def _runs(ys: np.ndarray, low: np.ndarray, high: np.ndarray, inside: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """First and end of the places that each shape holds, from bounds of its run; ``inside(shapes, y)`` has the last word."""
    a, b = np.searchsorted(ys, low - SLACK), np.searchsorted(ys, high + SLACK, "right")
    return _trimmed(a, b, lambda rows, at: inside(rows, ys[at]))


def _trimmed(a: np.ndarray, b: np.ndarray, inside: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Runs of places from ``a`` to ``b`` without those at their ends that are not ``inside(runs, places)``."""
    b = np.maximum(a, b)
    rows = np.flatnonzero(a < b)
    while len(rows):
        rows = rows[~inside(rows, a[rows])]
        a[rows] += 1
        rows = rows[a[rows] < b[rows]]
    rows = np.flatnonzero(a < b)
    while len(rows):
        rows = rows[~inside(rows, b[rows] - 1)]
        b[rows] -= 1
    return a, b


def counts_within(points: DataFrame, features: DataFrame, radii: dict[str, float]) -> DataFrame:
    """The points (any columns, ``x, y``) with the number of features (``x, y``) within each of the named radii, none left out. J17.

    Points without a feature within the widest are not returned.
    """
    names, widest = list(radii), float(max(radii.values()))

    def sweep(p: pd.DataFrame, s: pd.DataFrame) -> pd.DataFrame:
        x, y, edge = _columns(p)
        s = s.sort_values("fx")
        fx, fy, w = s["fx"].to_numpy(), s["fy"].to_numpy(), s["w"].to_numpy(np.float64)
        out = np.zeros((len(names), len(x)), np.int64)
        for begin, end in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True):
            here, ys = x[begin], y[begin:end]
            for k, r in enumerate(radii.values()):
                i, j = np.searchsorted(fx, [here - r - SLACK, here + r + SLACK])
                if i == j:
                    continue
                dx2, cy = np.square(fx[i:j] - here), fy[i:j]
                half = np.sqrt(np.maximum(r * r - dx2, 0))
                a, b = _runs(ys, cy - half, cy + half, lambda rows, at, dx2=dx2, cy=cy, r=r: np.sqrt(dx2[rows] + np.square(cy[rows] - at)) <= r)
                n = end - begin + 1
                out[k, begin:end] = np.cumsum(np.bincount(a, w[i:j], n) - np.bincount(b, w[i:j], n))[:-1]
        return pd.DataFrame({"x": x, "y": y, **dict(zip(names, out, strict=True))})

    xy = lambda df: df.select(F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y")).filter(_finite("x", "y"))
    spots = xy(features).groupBy(F.col("x").alias("fx"), F.col("y").alias("fy")).agg(F.count("*").alias("w"))
    box = {f"{c}{k}_": F.col(f"f{c}") + d * (widest + SLACK) for c in "xy" for k, d in ((0, -1), (1, 1))}
    counted = _swept(xy(points).distinct(), spots.withColumns(box), 2 * widest, sweep, "x double, y double, " + ", ".join(f"`{c}` long" for c in names))
    # A crowded square's features come in several parts.
    whole = counted.groupBy(F.col("x").alias("x_"), F.col("y").alias("y_")).agg(*[F.sum(c).alias(c) for c in names]).filter(F.greatest(F.lit(0), *names) > 0)
    return points.join(whole, (points["x"].cast("double") == whole["x_"]) & (points["y"].cast("double") == whole["y_"])).drop("x_", "y_")


def _last(n: int, a: np.ndarray, b: np.ndarray, ord_: np.ndarray) -> np.ndarray:
    """The greatest ``ord_`` of the runs ``a`` to ``b`` over each of ``n`` places: a run is two that overlap, as long as a power of two."""
    some = a < b
    a, b, ord_ = a[some], b[some], ord_[some]
    power = np.frexp(b - a)[1] - 1
    best = np.full((int(power.max(initial=0)) + 1, n), LEAST)
    flat = best.reshape(-1)
    np.maximum.at(flat, power * n + a, ord_)
    np.maximum.at(flat, power * n + b - (1 << power), ord_)
    for k in range(len(best) - 1, 0, -1):
        half = 1 << (k - 1)
        np.maximum(best[k - 1], best[k], out=best[k - 1])
        np.maximum(best[k - 1][half:], best[k][:-half], out=best[k - 1][half:])
    return best[0]


def last_triangle(points: DataFrame, triangles: DataFrame, size: float) -> DataFrame:
    """The points (any columns, ``x, y``) in a triangle (``ord, ax, ay, bx, by_, cx, cy``), with the greatest ``ord`` of those that hold it as ``triangle``. J26, F17.

    A triangle holds the points whose three barycentric weights are not negative; a flat one holds none. ``size`` is
    the side of the squares that work is dealt by: about twice that of a triangle.
    """
    corners = ["ax", "ay", "bx", "by_", "cx", "cy"]

    def sweep(p: pd.DataFrame, s: pd.DataFrame) -> pd.DataFrame:
        x, y, edge = _columns(p)
        s = s.sort_values("x0_")
        ax, ay, bx, by, cx, cy, left, right = (s[c].to_numpy() for c in [*corners, "x0_", "x1_"])
        ord_, wide = s["ord"].to_numpy(np.int64), float((right - left).max()) if len(s) else 0.0
        area = lambda px, py, qx, qy, rx, ry: (qx - px) * (ry - py) - (qy - py) * (rx - px)
        out = np.full(len(x), LEAST)
        for begin, end in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True):
            here, ys = x[begin], y[begin:end]
            i, j = np.searchsorted(left, [here - wide - SLACK, here + SLACK])
            at = i + np.flatnonzero(right[i:j] >= here - SLACK)
            if not len(at):
                continue
            a_x, a_y, b_x, b_y, c_x, c_y = (v[at] for v in (ax, ay, bx, by, cx, cy))
            low, high = np.full(len(at), np.inf), np.full(len(at), -np.inf)
            for px, py, qx, qy in ((a_x, a_y, b_x, b_y), (b_x, b_y, c_x, c_y), (c_x, c_y, a_x, a_y)):
                met = (np.minimum(px, qx) <= here + SLACK) & (np.maximum(px, qx) >= here - SLACK)
                steep = np.abs(qx - px) < 1  # its whole height is a bound
                share = np.clip((here - px) / np.where(steep, 1.0, qx - px), 0, 1)
                one, two = np.where(steep, py, py + share * (qy - py)), np.where(steep, qy, py + share * (qy - py))
                low = np.where(met, np.minimum(low, np.minimum(one, two)), low)
                high = np.where(met, np.maximum(high, np.maximum(one, two)), high)
            whole = area(a_x, a_y, b_x, b_y, c_x, c_y)

            def inside(rows: np.ndarray, v: np.ndarray) -> np.ndarray:
                a0, a1, b0, b1, c0, c1, w = (z[rows] for z in (a_x, a_y, b_x, b_y, c_x, c_y, whole))  # noqa: B023
                with np.errstate(divide="ignore", invalid="ignore"):
                    weights = area(here, v, b0, b1, c0, c1) / w, area(a0, a1, here, v, c0, c1) / w, area(a0, a1, b0, b1, here, v) / w  # noqa: B023
                return (w != 0) & (weights[0] >= 0) & (weights[1] >= 0) & (weights[2] >= 0)

            out[begin:end] = _last(end - begin, *_runs(ys, low, high, inside), ord_[at])
        some = out != LEAST
        return pd.DataFrame({"x": x[some], "y": y[some], "triangle": out[some]})

    rows = triangles.select(F.col("ord").cast("long").alias("ord"), *[F.col(c).cast("double").alias(c) for c in corners]).filter(F.col("ord").isNotNull() & _finite(*corners))
    box = {f"{c}{k}_": f(*[F.col(v) for v in corners[n::2]]) for n, c in enumerate("xy") for k, f in ((0, F.least), (1, F.greatest))}
    places = points.select(F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y")).filter(_finite("x", "y")).distinct()
    found = _swept(places, rows.withColumns(box), size, sweep, "x double, y double, triangle long")
    best = found.groupBy(F.col("x").alias("x_"), F.col("y").alias("y_")).agg(F.max("triangle").alias("triangle"))
    return points.join(best, (points["x"].cast("double") == best["x_"]) & (points["y"].cast("double") == best["y_"])).drop("x_", "y_")


def _alike(p: pd.DataFrame) -> tuple[tuple[np.ndarray, ...], list[tuple[int, int]]]:
    """``ax, ay, bx, by`` of segments in order of their vector, then of ax and ay, and where those of each vector begin and end."""
    ax, ay, bx, by = (p[c].to_numpy() for c in SEGMENT)
    ux, uy = bx - ax, by - ay
    order = np.lexsort((ay, ax, uy, ux))
    ux, uy = ux[order], uy[order]
    edge = np.flatnonzero(np.r_[True, (ux[1:] != ux[:-1]) | (uy[1:] != uy[:-1]), True])
    return tuple(v[order] for v in (ax, ay, bx, by)), list(zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True))


def _chunks(many: np.ndarray, most: int, last: np.ndarray | None = None) -> list[slice]:
    """Slices of rows that make ``many`` each and some ``most`` together; a slice ends where ``last``, if given, is true."""
    total = np.cumsum(many)
    out, begin = [], 0
    while begin < len(many):
        done = int(total[begin - 1]) if begin else 0
        end = max(begin + 1, int(np.searchsorted(total, done + most, "right")))
        if last is not None:
            end += int(np.argmax(last[end - 1 :]))
        out.append(slice(begin, end))
        begin = end
    return out


def _expanded(first: np.ndarray, many: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers, each as often as ``many`` says, and numbers that count on from ``first`` of the row."""
    rows = np.repeat(np.arange(len(many)), many)
    return rows, np.arange(len(rows)) + np.repeat(first - (np.cumsum(many) - many), many)


def _near(a: tuple[np.ndarray, ...], w: tuple[np.ndarray, ...], reach: np.ndarray) -> np.ndarray:
    """``geo.segment_gap(a, w) <= reach`` for arrays."""
    ax, ay, bx, by = a
    cx, cy, dx, dy = w
    area = lambda px, py, qx, qy, rx, ry: (qx - px) * (ry - py) - (rx - px) * (qy - py)

    def gap(px, py, x0, y0, x1, y1):
        long2 = (x1 - x0) * (x1 - x0) + (y1 - y0) * (y1 - y0)
        t = ((px - x0) * (x1 - x0) + (py - y0) * (y1 - y0)) / np.where(long2 == 0, 1.0, long2)
        t = np.clip(np.where(long2 == 0, 0.0, t), 0, 1)
        x, y = x0 + t * (x1 - x0), y0 + t * (y1 - y0)
        return np.sqrt((px - x) * (px - x) + (py - y) * (py - y))

    turns = lambda *v: np.sign(area(*v))
    across = (turns(ax, ay, bx, by, cx, cy) * turns(ax, ay, bx, by, dx, dy) < 0) & (turns(cx, cy, dx, dy, ax, ay) * turns(cx, cy, dx, dy, bx, by) < 0)
    least = np.minimum(np.minimum(gap(cx, cy, *a), gap(dx, dy, *a)), np.minimum(gap(ax, ay, *w), gap(bx, by, *w)))
    return np.where(across | (least <= 1e-9), 0.0, least) <= reach


def _starts_near(x: np.ndarray, w: tuple[np.ndarray, ...], ux: float, uy: float, r: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least and greatest y at which a segment by (ux, uy) that starts at ``x`` comes within ``r`` of a segment; none: low above high.

    These starts are the parallelogram of one segment drawn back along the other, ``r`` wider on every side.
    """
    cx, cy, dx, dy = w
    corners = [(cx, cy), (dx, dy), (dx - ux, dy - uy), (cx - ux, cy - uy)]
    low, high = np.full(len(x), np.inf), np.full(len(x), -np.inf)
    outward = np.where((dy - cy) * ux - (dx - cx) * uy >= 0, r, -r)  # a flat one runs there and back, so both sides are drawn
    for n, (px, py) in enumerate(corners):
        qx, qy = corners[(n + 1) % 4]
        near = np.abs(x - px) <= r + SLACK
        half = np.sqrt(np.maximum(r * r - np.square(x - px), 0))
        low, high = np.where(near, np.minimum(low, py - half), low), np.where(near, np.maximum(high, py + half), high)
        ex, ey = qx - px, qy - py
        length = np.hypot(ex, ey)
        out = outward / np.where(length == 0, 1.0, length)
        sx, sy = px + out * ey, py - out * ex
        met = (np.minimum(sx, sx + ex) <= x + SLACK) & (np.maximum(sx, sx + ex) >= x - SLACK)
        steep = np.abs(ex) < 1e-2  # its whole height is a bound
        t = np.clip((x - sx) / np.where(steep, 1.0, ex), 0, 1) * ey
        one, two = np.where(steep, sy, sy + t), np.where(steep, sy + ey, sy + t)
        low, high = np.where(met, np.minimum(low, np.minimum(one, two)), low), np.where(met, np.maximum(high, np.maximum(one, two)), high)
    return low, high


def _merged(key: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of each key without what earlier ones of the key hold."""
    order = np.lexsort((a, key))
    key, a, b = key[order], a[order], b[order]
    base = key * (int(b.max(initial=0)) + 1)
    a = np.maximum(a, np.r_[0, np.maximum.accumulate(base + b)[:-1] - base[1:]]) if len(key) else a
    some = a < b
    return key[some], a[some], b[some]


def lines_met(p: pd.DataFrame, s: pd.DataFrame) -> pd.DataFrame:
    """Segments ``p`` with the number ``n`` of different lines (``line``) in ``s`` (segments with a ``half`` width) that each comes within that of."""
    (ax, ay, bx, by), groups = _alike(p)
    line = pd.factorize(s["line"])[0]
    order = np.argsort(line, kind="stable")
    line, r = line[order], s["half"].to_numpy()[order]
    w = tuple(s[c].to_numpy()[order] for c in SEGMENT)
    left, right, below, above = (f(w[k], w[k + 2]) + d * (r + SLACK) for k in (0, 1) for f, d in ((np.minimum, -1), (np.maximum, 1)))
    new = np.r_[True, ax[1:] != ax[:-1]]
    new[[g for g, _ in groups]] = True
    column, edge = np.cumsum(new) - 1, np.flatnonzero(new)
    lowest, highest = ay[edge], ay[np.r_[edge[1:], len(ay)] - 1]
    levels, rank = np.unique(ay, return_inverse=True)
    steps = len(levels) + 1
    key = column * steps + rank
    total = np.zeros(len(ax) + 1, np.int64)

    def add(a: np.ndarray, b: np.ndarray) -> None:
        total[:] += np.bincount(a, minlength=len(total)) - np.bincount(b, minlength=len(total))

    for begin, end in groups:
        ux, uy = bx[begin] - ax[begin], by[begin] - ay[begin]
        first = int(column[begin])
        xs = ax[edge[first : int(column[end - 1]) + 1]]
        i, j = np.searchsorted(xs, left - max(ux, 0.0)), np.searchsorted(xs, right - min(ux, 0.0), "right")
        held = tuple(np.zeros(0, np.int64) for _ in range(3))
        for some in _chunks(j - i, CHUNK):
            rows, at = _expanded(i[some], (j - i)[some])
            rows += some.start
            beside = (lowest[at + first] <= above[rows] - min(uy, 0.0)) & (highest[at + first] >= below[rows] - max(uy, 0.0))
            rows, at = rows[beside], at[beside]
            own, reach = tuple(v[rows] for v in w), r[rows]
            low, high = _starts_near(xs[at], own, ux, uy, reach)
            base = (at + first) * steps
            a, b = np.searchsorted(key, base + np.searchsorted(levels, low - SLACK)), np.searchsorted(key, base + np.searchsorted(levels, high + SLACK, "right"))
            a, b = _trimmed(a, b, lambda k, v: _near((ax[v], ay[v], bx[v], by[v]), tuple(c[k] for c in own), reach[k]))  # noqa: B023
            met = a < b
            runs = _merged(*(np.r_[old, v[met]] for old, v in zip(held, (line[rows], a, b), strict=True)))
            goes_on = runs[0] == line[some.stop - 1]  # the next chunk may hold more of this line
            held = tuple(v[goes_on] for v in runs)
            add(*(v[~goes_on] for v in runs[1:]))
        add(*held[1:])
    n = np.cumsum(total)[:-1]
    some = n > 0
    return pd.DataFrame({"ax": ax[some], "ay": ay[some], "bx": bx[some], "by_": by[some], "n": n[some]})


def _stretches(line: np.ndarray, at: np.ndarray, kind: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Where lines enter (1) and leave (-1) what covers them, of entries and exits of parts that may overlap."""
    order = np.lexsort((-kind, at, line))
    line, at, kind = line[order], at[order], kind[order]
    depth = np.cumsum(kind)
    some = ((kind == 1) & (depth == 1)) | ((kind == -1) & (depth == 0))
    return line[some], at[some], kind[some]


def shares_held(p: pd.DataFrame, s: pd.DataFrame) -> pd.DataFrame:
    """Segments ``p`` with the ``share`` of each that lies within any of the rings in ``s`` (arrays ``xs, ys``), overlaps once.

    A line that runs along a side counts as a little to the right of it, a level one as a little above.
    """
    (ax, ay, bx, by), groups = _alike(p)
    many = s["xs"].map(len).to_numpy(np.int64)
    ring = np.repeat(np.arange(len(s)), many)
    after = np.arange(len(ring)) + 1
    last = np.zeros(len(ring), bool)
    last[np.cumsum(many) - 1] = True
    after[last] = np.flatnonzero(last) - many + 1
    ox, oy = np.floor(ax.min()), np.floor(ay.min())
    px, py = np.concatenate(list(s["xs"])) - ox, np.concatenate(list(s["ys"])) - oy
    share = np.zeros(len(ax))
    for begin, end in groups:
        ux, uy = bx[begin] - ax[begin], by[begin] - ay[begin]
        long2 = ux * ux + uy * uy
        if long2 == 0:
            continue
        x, y = ax[begin:end] - ox, ay[begin:end] - oy
        lines, own = np.unique(ux * y - uy * x, return_inverse=True)
        v, along = ux * py - uy * px, (ux * px + uy * py) / long2
        w, further = v[after], along[after]
        side = "right" if uy > 0 or (uy == 0 and ux < 0) else "left"
        i, j = np.searchsorted(lines, np.minimum(v, w), side), np.searchsorted(lines, np.maximum(v, w), side)
        held = np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.int64)
        for some in _chunks(j - i, CHUNK, last):
            rows, line = _expanded(i[some], (j - i)[some])
            rows += some.start
            t = (v[rows] - lines[line]) / (v[rows] - w[rows])
            at = along[rows] + t * (further[rows] - along[rows])
            # A ring is met an even number of times: in and out by turns.
            order = np.lexsort((at, line + len(lines) * ring[rows]))
            kind = np.where(np.arange(len(order)) % 2 == 0, 1, -1)
            held = _stretches(*(np.r_[old, new] for old, new in zip(held, (line[order], at[order], kind), strict=True)))
        line, at, _ = held
        line, enters, leaves = line[::2], at[::2], at[1::2]
        if not len(line):
            continue
        # Before each end of a segment: what was covered until the last stretch that begins before it, and its part of that.
        start = (ux * x + uy * y) / long2
        until = np.r_[0, np.cumsum(leaves - enters, dtype=np.longdouble)]
        ends, where = np.r_[start, start + 1], np.r_[own, own]
        order = np.lexsort((np.r_[np.zeros(len(line), np.int8), np.ones(len(ends), np.int8)], np.r_[enters, ends], np.r_[line, where]))
        k = np.empty(len(order), np.int64)
        k[order] = np.cumsum(order < len(line)) - 1
        k = k[len(line) :]
        past = np.where(line[k] == where, np.minimum(ends, leaves[k]) - enters[k], leaves[k] - enters[k])
        covered = np.where(k < 0, 0, until[k] + past)
        share[begin:end] = covered[len(x) :] - covered[: len(x)]
    some = share > 0
    return pd.DataFrame({"ax": ax[some], "ay": ay[some], "bx": bx[some], "by_": by[some], "share": share[some]})
