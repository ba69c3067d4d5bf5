"""Obstacles, influences, recomputation and timed streams against plain Python."""

import math
import random
from collections import OrderedDict
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from footfall.operators import obstacles, recompute
from footfall.session import shared_dir
from footfall.streaming import timed


def _orient(a, b, c):
    return (b[0] - a[0]) * (c[1] - a[1]) - (b[1] - a[1]) * (c[0] - a[0])


def _to_segment(p, a, b):
    d2 = (b[0] - a[0]) ** 2 + (b[1] - a[1]) ** 2
    t = 0 if d2 == 0 else max(0, min(1, ((p[0] - a[0]) * (b[0] - a[0]) + (p[1] - a[1]) * (b[1] - a[1])) / d2))
    return math.dist(p, (a[0] + t * (b[0] - a[0]), a[1] + t * (b[1] - a[1])))


def _gap(a, b, c, d):
    if _orient(a, b, c) * _orient(a, b, d) < 0 and _orient(c, d, a) * _orient(c, d, b) < 0:
        return 0.0
    return min(_to_segment(c, a, b), _to_segment(d, a, b), _to_segment(a, c, d), _to_segment(b, c, d))


def _inside(p, ring):
    odd = False
    for (ax, ay), (bx, by) in zip(ring, ring[1:] + ring[:1], strict=True):
        if (ay > p[1]) != (by > p[1]) and p[0] < (bx - ax) * (p[1] - ay) / (by - ay) + ax:
            odd = not odd
    return odd


def test_slanted_walls_with_widths_and_parts(spark):
    rng = random.Random(2)
    at = lambda: (rng.uniform(0, 300), rng.uniform(0, 300))
    lines = [[[at() for _ in range(rng.randint(1, 4))] for _ in range(rng.randint(1, 3))] for _ in range(12)] + [[[(50.0, 0.0), (50.0, 300.0)]], [[(0.0, 100.0), (300.0, 100.0)]]]
    widths = [rng.choice([0.0, 4.0, 30.0]) for _ in lines]
    walls = spark.createDataFrame([(n, w, [[{"x": x, "y": y} for x, y in part] for part in line]) for n, (w, line) in enumerate(zip(widths, lines, strict=True))], "wall long, width double, parts array<array<struct<x:double,y:double>>>")
    links = [(i, *a, a[0] + rng.uniform(-60, 60), a[1] + rng.uniform(-60, 60)) for i in range(120) for a in (at(),)] + [(500, 50.0, 10.0, 50.0, 20.0), (501, 60.0, 100.0, 80.0, 100.0), (502, 50.0, 50.0, 50.0, 50.0)]
    df = spark.createDataFrame(links, "id long, ax double, ay double, bx double, by_ double")
    got = {(r.id, r.wall) for r in obstacles.crossed_lines(df, obstacles.polyline_segments(walls, ["wall", "width"]), "id", "wall", "width", 40.0).collect()}
    want = {(i, n) for i, ax, ay, bx, by in links for n, line in enumerate(lines) for part in line for c, d in zip(part, part[1:], strict=False) if _gap((ax, ay), (bx, by), c, d) <= widths[n] / 2 + 1e-9}
    assert got == want and len(want) > 40


def test_what_lies_in_water_is_counted_once(spark):
    rings = [[(0, 0), (100, 0), (100, 100), (50, 30), (0, 100)], [(80, -20), (200, -20), (200, 60), (80, 60)], [(300, 300), (310, 300), (305, 310)]]
    areas = spark.createDataFrame([(n, [{"x": float(x), "y": float(y)} for x, y in r]) for n, r in enumerate(rings)], "area int, ring array<struct<x:double,y:double>>")
    rng = random.Random(4)
    links = [(i, rng.uniform(-50, 220), rng.uniform(-50, 130), rng.uniform(-50, 220), rng.uniform(-50, 130)) for i in range(60)] + [(90, 10.0, 50.0, 95.0, 50.0), (91, 0.0, 0.0, 100.0, 0.0), (92, 400.0, 400.0, 401.0, 400.0)]
    df = spark.createDataFrame(links, "id int, ax double, ay double, bx double, by_ double")
    got = {r.id: (r.length_m, r.covered_m) for r in obstacles.covered_lengths(df, areas, ["id"], "area", 50.0).collect()}
    for i, ax, ay, bx, by in links:
        if i == 91:  # along a side: on neither side of it
            continue
        steps = 4000
        hit = sum(any(_inside((ax + (k + 0.5) / steps * (bx - ax), ay + (k + 0.5) / steps * (by - ay)), r) for r in rings) for k in range(steps)) / steps
        assert abs(got[i][1] - hit * got[i][0]) < got[i][0] * 2e-3 + 1e-9
    cells = spark.createDataFrame([(1, 0, 0, 0), (2, 0, 1, 0), (3, 1, 4, 0), (4, 1, 4, 1)], "cell int, level int, ix int, iy int")
    part = {(r.a, r.b): (r.length_m, r.separated) for r in obstacles.separations(cells, areas.filter("area = 1").withColumn("ring", F.expr("transform(ring, p -> struct(p.x - 90 as x, p.y as y))")), "area", 50.0).collect()}
    assert part == {(1, 2): (50.0, True), (2, 3): (25.0, True), (2, 4): (25.0, True), (3, 4): (25.0, False)}


def test_lines_in_cells_keep_their_length(spark):
    rng = random.Random(6)
    rows = [(i, rng.uniform(-200, 200), rng.uniform(-200, 200), rng.uniform(-200, 200), rng.uniform(-200, 200)) for i in range(50)] + [(90, 50.0, -70.0, 50.0, 130.0), (91, -30.0, 100.0, 170.0, 100.0)]
    df = spark.createDataFrame(rows, "id int, ax double, ay double, bx double, by_ double")
    got = {r.id: r.m for r in obstacles.line_parts(df, 50.0).groupBy("id").agg(F.sum("line_m").alias("m")).collect()}
    assert all(abs(got[i] - math.dist((a, b), (c, d))) < 1e-6 for i, a, b, c, d in rows)


def test_blocks_near_by(spark):
    rng = random.Random(8)
    cells = [(i, rng.choice("ab"), 50 * rng.randint(-30, 30), 50 * rng.randint(-30, 30)) for i in range(200)]
    blocks = [(rng.choice("ab"), x, y, x + s, y + s) for x, y, s in ((100 * rng.randint(-12, 12), 100 * rng.randint(-12, 12), rng.choice([50, 100, 400])) for _ in range(12))]
    got = obstacles.near_blocks(spark.createDataFrame(cells, "id int, kind string, x0 long, y0 long"), spark.createDataFrame(blocks, "kind string, x0 long, y0 long, x1 long, y1 long"), ["kind"], 130.0, 50.0)
    gap = lambda lo, hi, a, b: max(0, a - hi, lo - b)
    want = {i for i, k, x, y in cells if any(k == b[0] and math.hypot(gap(x, x + 50, b[1], b[3]), gap(y, y + 50, b[2], b[4])) <= 130 for b in blocks)}
    assert {r.id for r in got.collect()} == want and 0 < len(want) < 200


def test_only_cells_in_reach_are_judged_again(spark):
    cells = spark.createDataFrame([(i, float(i * 10), 0.0) for i in range(100)], "cell int, x double, y double")
    old = spark.createDataFrame([(1, "a", 100.0, 0.0), (2, "a", 500.0, 0.0), (3, "a", 900.0, None)], "id int, kind string, x double, y double")
    new = spark.createDataFrame([(1, "a", 100.0, 0.0), (2, "a", 520.0, 0.0), (3, "a", 900.0, None), (4, "a", 955.0, 0.0)], "id int, kind string, x double, y double")
    seen = []

    def judge(some, inputs):
        seen.append(({r.cell for r in some.collect()}, {r.id for r in inputs.collect()}))
        near = some.join(inputs.filter("y IS NOT NULL").select(F.col("x").alias("fx")), F.abs(F.col("x") - F.col("fx")) <= 30, "left")
        return near.groupBy("cell").agg(F.count("fx").alias("n"))

    base = f"{shared_dir(spark)}/rec-{random.random()}"
    first = recompute.publish(spark, base, judge(cells, old), 100)
    changes, again = recompute.recomputed(cells, old, new, judge, "id", ["x", "y"], ["cell"], 30.0)
    assert sorted((r.id, r.x) for r in changes.collect()) == [(2, 500.0), (2, 520.0), (4, 955.0)]
    second = recompute.publish(spark, base, again, 100, 2, first)
    assert seen[1][0] == {*range(47, 56), *range(93, 99)} and seen[1][1] == {2, 4}
    got = {r.cell: (r.n, r.revision) for r in recompute.read_revision(spark, base, second, ["cell"]).collect()}
    full = {r.cell: r.n for r in judge(cells, new).collect()}
    assert {c: n for c, (n, _) in got.items()} == full and {c for c, (_, r) in got.items() if r == 2} == seen[1][0]
    assert {r.revision for r in recompute.read_revision(spark, base, first, ["cell"]).collect()} == {1}
    line = spark.read.parquet(f"{base}/lineage/2").first()
    assert (line.parent, line.changed, line.recomputed, line.kept) == (1, 2, 15, 85)


SCHEMA = "event_id long, ts timestamp, user_id long, event_type string, value double"
BASE = datetime(2024, 1, 1)


def _turns(spark, batches, build, name):
    path = f"{shared_dir(spark)}/{name}-{random.random()}"
    for n, rows in enumerate(batches):  # files come in one by one
        spark.createDataFrame([(i, BASE + timedelta(minutes=m), u, k, float(v)) for i, m, u, k, v in rows], SCHEMA).coalesce(1).write.json(f"{path}/in/{n}")
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).json(f"{path}/in/*")
    query = build(stream).writeStream.format("parquet").option("path", f"{path}/out").option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.parquet(f"{path}/out").collect()


def test_a_silent_task_is_interrupted_by_a_timer(spark):
    batches = [
        [(1, 0, 1, "queued", 0), (2, 5, 2, "queued", 0), (3, 6, 3, "queued", 0)],
        [(5, 30, 1, "running", 0), (4, 20, 1, "queued", 0), (6, 35, 3, "done", 0)],  # out of order within a batch
        [(7, 300, 4, "queued", 0)],
        [(8, 310, 2, "running", 0), (9, 600, 4, "queued", 0)],
        [(10, 1200, 5, "queued", 0)],
    ]
    got = sorted((r.task, r.since_ms // 60_000 - int(BASE.timestamp()) // 60, r.stage) for r in _turns(spark, batches, lambda e: timed.interruptions(e, 3_600_000, ["done"]), "watch"))
    assert [g for g in got if g[0] == 1] == [(1, 0, "queued"), (1, 30, "running"), (1, 90, "interrupted")]
    assert [g for g in got if g[0] == 2] == [(2, 5, "queued"), (2, 65, "interrupted"), (2, 310, "running"), (2, 370, "interrupted")]
    assert [g for g in got if g[0] == 3] == [(3, 6, "queued"), (3, 35, "done")]
    assert [g for g in got if g[0] == 4] == [(4, 300, "queued"), (4, 360, "interrupted"), (4, 600, "queued"), (4, 660, "interrupted")]


def test_a_second_fingerprint_is_a_conflict_until_the_first_is_forgotten(spark):
    batches = [[(1, 0, 1, "a", 5), (2, 1, 1, "a", 5)], [(3, 10, 1, "a", 6), (4, 11, 1, "b", 6)], [(5, 40, 1, "a", 5)], [(6, 400, 1, "a", 7), (7, 401, 1, "a", 7)]]
    ids = lambda e: e.withColumn("rid", F.concat_ws(":", "user_id", "event_type"))
    got = {r.event_id: (r.verdict, r.original) for r in _turns(spark, batches, lambda e: timed.submissions(ids(e), "rid", "value", 3_600_000), "submit")}
    assert got == {1: ("created", 1), 2: ("same", 1), 3: ("conflict", 1), 4: ("created", 4), 5: ("same", 1), 6: ("created", 6), 7: ("same", 6)}


def test_a_bounded_cache_drops_the_least_recently_written(spark):
    rng = random.Random(9)
    rows = [(i, 3 * i, rng.randint(0, 5), "close" if rng.random() < 0.06 else "read", rng.randint(0, 9)) for i in range(240)]
    held, want = OrderedDict(), {}
    for i, m, user, kind, entry in rows:
        if kind == "close":
            gone = [e for e, v in held.items() if v[1] == user]
            for e in gone:
                del held[e]
            want[i] = ("closed", len(gone))
            continue
        was = held.get(entry)
        verdict = "miss" if was is None else "own" if was[1] == user else "hit" if m - was[0] <= 12 else "stale"
        dropped = 0
        if verdict in ("miss", "stale"):
            held.pop(entry, None)
            held[entry] = (m, user)
            while len(held) > 4:
                held.popitem(last=False)
                dropped += 1
        want[i] = (verdict, dropped)
    cols = lambda e: e.withColumns({"s": F.lit(0), "c": F.col("event_type") == "close"})
    build = lambda e: timed.bounded_cache(cols(e), "s", "value", "user_id", "c", 12 * 60_000, 4)
    cut = [rows[:50], rows[50:51], rows[51:170], rows[170:]]
    assert {r.event_id: (r.verdict, r.dropped) for r in _turns(spark, cut, build, "cache")} == want
    assert {v for v, _ in want.values()} == {"miss", "own", "hit", "stale", "closed"} and any(d for _, d in want.values())
