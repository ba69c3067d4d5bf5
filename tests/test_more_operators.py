"""Operators on small hand-made tables, against plain Python."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from footfall.functions import geo, rules, stats, text
from footfall.operators import accuracy, entity, evidence, graph, history, logs, nearby, ordered, rasters, verification
from footfall.session import shared_dir
from footfall.sources import files
from footfall.streaming import logs as streams


@pytest.fixture(scope="module")
def log(spark):
    rng = random.Random(8)
    rows = [(i, rng.choice("ab"), rng.randrange(40_000), rng.randrange(1, 9000), rng.choice(["ok", "error"]), rng.randrange(5), float(rng.randrange(1, 60))) for i in range(400)]
    rows += [(400 + i, "a", 7000, 500, "ok", 1, 3.0) for i in range(30)]  # many at one moment
    return rows, spark.createDataFrame(rows, "id long, service string, start_ms long, took long, outcome string, user long, cost double").withColumn("end_ms", F.col("start_ms") + F.col("took")).cache()


def by_service(rows):
    for s in "ab":
        yield s, sorted((r for r in rows if r[1] == s), key=lambda r: (r[2], r[0]))


@pytest.mark.parametrize("bucket", [500, 5000, 10**9])
def test_windows_by_bucket(log, bucket):
    rows, df = log
    lag = {r.id: r.prev.id if r.prev else None for r in ordered.lagged(df, "service", ["start_ms", "id"], ["id"], F.floor(F.col("start_ms") / bucket)).collect()}
    sums = {r.id: r.s for r in ordered.running(df, "service", ["start_ms", "id"], F.col("took"), "s", F.floor(F.col("start_ms") / bucket)).collect()}
    most = {r.id: r.s for r in ordered.running(df, "service", ["start_ms", "id"], F.col("took"), "s", F.floor(F.col("start_ms") / bucket), "max", own=False).collect()}
    ahead = {r.id: r.n for r in ordered.within_ahead(df, "service", "start_ms", bucket, "n").collect()}
    for _, own in by_service(rows):
        for i, r in enumerate(own):
            assert lag[r[0]] == (own[i - 1][0] if i else None)
            assert sums[r[0]] == sum(x[3] for x in own[: i + 1])
            assert most[r[0]] == (max(x[3] for x in own[:i]) if i else None)
            assert ahead[r[0]] == sum(r[2] <= x[2] < r[2] + bucket for x in own)


def test_log_audits(log):
    rows, df = log
    flight = {r.service: r.most_in_flight for r in logs.most_in_flight(df, "service", "start_ms", "end_ms", "id", 2000).collect()}
    rate = {r.service: r.most_in_window for r in logs.rolling_rate(df, "service", "start_ms", 1000).collect()}
    cool = {r.service: (r.held_back, r.free) for r in logs.cooldowns(df, "service", "start_ms", "id", F.col("outcome") == "error", 300, 700).collect()}
    gate = {r.id: r.verdict for r in logs.budget_gate(df, "service", F.lit(0), ["start_ms", "id"], "cost", 2000.0).collect()}
    merged = history.merge_intervals(df, "service", "start_ms", "end_ms", 1000).collect()
    for s, own in by_service(rows):
        moments = {r[2] for r in own}
        assert flight[s] == max(sum(x[2] <= m < x[2] + x[3] for x in own) for m in moments)
        assert rate[s] == max(sum(m <= x[2] < m + 1000 for x in own) for m in moments)
        held = sum(any(x[4] == "error" and r[2] - x[2] <= 300 for x in own[:i]) for i, r in enumerate(own))
        assert cool[s] == (held, len(own) - held)
        spent = 0.0
        for r in own:
            fits = spent + r[6] <= 2000
            spent += r[6] if fits else 0
            assert gate[r[0]] == ("accepted" if fits else "daily_budget_exhausted")
        assert "daily_budget_exhausted" in {gate[r[0]] for r in own}
        islands = []
        for a, b in sorted((r[2], r[2] + r[3]) for r in own):
            if islands and a <= islands[-1][1]:
                islands[-1][1] = max(b, islands[-1][1])
            else:
                islands.append([a, b])
        assert sorted([r.start_ms, r.end_ms] for r in merged if r.service == s) == islands
    p = {r.service: r for r in accuracy.nearest_rank(df, "service", "took", p50=0.5, p95=0.95).collect()}
    for s, own in by_service(rows):
        took = sorted(r[3] for r in own)
        assert (p[s].p50, p[s].p95, p[s].most) == (took[-(-len(took) // 2) - 1], took[-(-95 * len(took) // 100) - 1], took[-1])


def test_pagination_by_reported_totals(spark):
    pages = {("done", 1): (5, 2, "ab"), ("done", 2): (5, 3, "cde"), ("cut", 1): (180, 2, "ab"), ("cut", 2): (180, 1, "c"), ("moved", 1): (9, 1, "a"), ("moved", 2): (7, 1, "b"), ("again", 1): (9, 2, "ab"), ("again", 2): (9, 2, "ab"), ("part", 1): (9, 1, "a"), ("part", 2): (9, 2, "ab"), ("null", 1): (None, 1, "a"), ("short", 1): (9, 1, "a"), ("short", 2): (2, 1, "b")}
    rows = spark.createDataFrame([(s, p, u) for (s, p), (_, _, us) in pages.items() for u in us], "seq string, page int, uid string")
    totals = spark.createDataFrame([(s, p, t) for (s, p), (t, _, _) in pages.items()], "seq string, page int, total long")
    got = {(r.seq, r.page): r.stop_reason for r in history.pagination(rows, totals, last_page=2).collect()}
    assert got["done", 1] is None and got["done", 2] == "completed" and got["cut", 1] is None and got["cut", 2] == "possible_truncation" and got["moved", 2] == "page_limit"
    assert got["again", 2] == got["part", 2] == "pagination_anomaly" and got["null", 1] is None and got["short", 2] == "pagination_uncertain"


def test_frames_there_and_back(spark):
    rng = random.Random(1)
    rows = [(rng.uniform(73, 135), rng.uniform(3, 53)) for _ in range(200)] + [(-70.0, 10.0), (200.0, 10.0), (float("nan"), 1.0), (116.4, 39.9)]
    lng, lat = F.col("lng"), F.col("lat")
    g = geo.wgs84_to_gcj02(lng, lat)
    df = spark.createDataFrame(rows, "lng double, lat double").select("lng", "lat", g[0].alias("gx"), g[1].alias("gy"))
    back = geo.gcj02_to_wgs84(F.col("gx"), F.col("gy"))
    for r in df.select("*", back[0].alias("bx"), back[1].alias("by")).collect():
        if not -180 <= r.lng <= 180:
            assert r.gx is None and r.bx is None
        elif r.lng < 72:
            assert (r.gx, r.gy) == (r.lng, r.lat)
        else:
            assert abs(r.bx - r.lng) < 2e-6 and abs(r.by - r.lat) < 2e-6 and abs(r.gx - r.lng) > 1e-4


def test_names_bridges_and_answers(spark):
    one = spark.range(1)
    names = one.select(text.canonical(F.lit("ＡＢ·Ｃ (1)，x")).alias("a"), text.canonical(F.lit("Straße ﬁn")).alias("b"), text.canonical(F.lit(None).cast("string")).alias("c"), text.canonical(F.lit("a-b & c")).alias("d")).first()
    assert (names.a, names.b, names.c, names.d) == ("abc1x", "strassefin", None, "a-b&c")
    tags = [("yes", None, None, None, "footway", True), ("no", None, "yes", None, "footway", False), ("yes", "yes", "yes", None, "path", False), ("yes", None, "no", None, "path", False), ("viaduct", None, None, "private", "path", False), ("yes", None, "designated", "private", "motorway", True), ("yes", None, "use_sidepath", None, "primary", False), ("yes", None, None, None, "motorway", False)]
    df = spark.createDataFrame(tags, "bridge string, tunnel string, foot string, access string, highway string, want boolean")
    assert all(r.got == r.want for r in df.withColumn("got", rules.walkable_bridge(*[F.col(c) for c in ("bridge", "tunnel", "foot", "access", "highway")])).collect())
    answers = [(200, 0, None), (429, 0, "rate_limit"), (401, None, "permission"), (500, None, "upstream_error"), (302, 0, "http_error"), (200, None, "invalid_response"), (200, 402, "rate_limit"), (200, 4, "quota"), (200, 261, "permission"), (200, 2, "parameter_error"), (200, 1, "upstream_error"), (200, 9, "source_error"), (None, 0, "http_error")]
    df = spark.createDataFrame(answers, "http int, status int, want string")
    assert all(r.got == r.want for r in df.withColumn("got", text.upstream_reason(F.col("http"), F.col("status"))).collect())
    widths = spark.createDataFrame([("3", 3.0), ("3.5 m", 3.5), ("0", None), ("1001", None), ("3 ft", None), (None, None)], "w string, want double")
    assert all(r.got == r.want for r in widths.withColumn("got", text.width_metres(F.col("w"))).collect())


def test_classifiers(spark):
    words = [{"key": "clinic", "include": ["clinic"], "priority": 1}, {"key": "pharmacy", "include": ["pharmacy"], "priority": 1}, {"key": "hospital_pharmacy", "include": ["hospital pharmacy"], "priority": 1}, {"key": "school", "include": ["school"], "exclude": ["driving"], "priority": 2}, {"key": "gate", "include": ["gate"], "priority": 9, "negative": True}, {"key": "late", "include": ["late"], "gated": True}]
    rows = [(1, "old clinic", "clinic"), (2, "hospital pharmacy", "hospital_pharmacy"), (3, "driving school", None), (4, "school clinic", "school"), (5, "school gate", None), (6, "late", None), (7, "clinic closed", None), (8, "clinic and pharmacy", "pharmacy")]
    df = spark.createDataFrame([r[:2] for r in rows], "id long, name string")
    got = {r.id: r for r in entity.keyword_classifier(df, "id", "name", words, ["closed"], {"pharmacy": "hospital_pharmacy"}).collect()}
    assert {i: got[i].category for i, *_ in rows} == {i: want for i, _, want in rows} and got[5].negative and got[1].confidence == 1.0 and got[7].confidence == 0.0
    table = [{"key": "food", "names": ["cafe"], "tags": ["cafe"], "excludes": ["internet"], "priority": 1, "negative": False}]
    df = spark.createDataFrame([(1, "my cafe", ["eat;cafe"]), (2, "my cafe", ["cafe>closed mall"]), (3, "my cafe", ["closed；cafe"]), (4, "cafe 3号门", ["cafe"]), (5, "internet cafe", ["cafe"]), (6, "my cafe", None)], "id long, name string, tags array<string>")
    got = {r.id: r.status for r in entity.rule_classifier(df, table, ["closed"], [], [], parents=["closed mall"]).collect()}
    assert got == {1: "accepted", 2: "accepted", 3: "excluded", 4: "excluded", 5: "needs_review", 6: "needs_review"}
    spots = [(i, "Same name", "Road （1）" if i % 3 else "road1", float(i % 2 * 15), 0.0) for i in range(50)]
    spots += [(90, "same-name", "road1", 0.0, 0.0), (91, "Same Name", "road1", 100.0, 0.0), (92, "Same name", "road2", 7.0, 0.0), (93, "Same name", None, 0.0, 0.0), (94, "Same name", " ", 0.0, 0.0), (95, None, "road1", 0.0, 0.0)]
    df = spark.createDataFrame(spots, "id long, name string, address string, x double, y double")
    assert {r.id: r.group_id for r in entity.possible_duplicates(df).collect()} == {i: 0 for i in range(50)}


def test_evidence_and_rasters(spark):
    samples = spark.createDataFrame([(0, 10, True), (0, 20, True), (0, 20, False), (0, 30, False), (0, 35, True), (0, 50, False), (1, 10, False)], "angle long, radius long, label boolean")
    agreed = evidence.agreed_samples(samples)
    assert {(r.before_r, r.radius) for r in evidence.ray_brackets(agreed).collect()} == {(10, 30), (30, 35), (35, 50)}
    assert {r.angle: (r.crossings, r.failed, r.adjacent) for r in evidence.ray_scan(agreed).collect()} == {0: (2, 1, 2), 1: (0, 0, 0)}
    assert {r.angle: (r.state, r.boundary_r) for r in evidence.radial_boundary(agreed, 0.4).collect()} == {0: ("closed", 42.5), 1: ("unknown", None)}
    square = lambda d: [(x * 1.0, y * 1.0) for x, y in ((-d, -d), (d, -d), (d, d), (-d, d))]
    rings = lambda d: spark.createDataFrame([(1, square(d))], "k long, ring array<struct<x: double, y: double>>")
    d = [r.m for r in rasters.boundary_distances(rings(10), rings(13), "k", 1.0).collect()]
    assert len(d) == 80 + 104 and min(d) == 3 and abs(max(d) - 3 * 2**0.5) < 1e-9
    g = spark.createDataFrame([("a", 5, 5), ("b", 0, 0), ("c", 95, 1)], "k string, w long, n long")
    assert {r.k: r.share for r in stats.validation_plan(g, "k", "w", "n", 6, 2).collect()} == {"a": 2, "b": 0, "c": 1}
    cells = spark.createDataFrame([(0, "gap"), (1, "gap"), (2, "covered"), (3, "covered")], "cell long, verdict string")
    seen = spark.createDataFrame([(0, "verified_true"), (1, "verified_true"), (1, "verified_false"), (2, "unusable"), (3, "contradicted")], "cell long, outcome string")
    assert {r.cell: r.verdict for r in verification.with_overrides(cells, seen, ["cell"]).collect()} == {0: "covered", 1: "unknown", 2: "covered", 3: "unknown"}


def test_searches(spark, monkeypatch):
    rng = random.Random(5)
    ways = {(rng.randrange(40), rng.randrange(40)): float(rng.randrange(1, 20)) for _ in range(120)}
    edges = spark.createDataFrame([(a, b, c) for (a, b), c in ways.items()], "u long, v long, length double")
    seeds = spark.createDataFrame([(o, o * 3, float(o)) for o in range(6)], "owner long, node long, cost double").withColumn("origin", F.col("owner"))
    monkeypatch.setattr(graph, "FEW", 3)  # frontiers are joined by shuffle

    def dijkstra(starts):
        best = {}
        todo = sorted((c, o, n) for o, n, c in starts)
        while todo:
            c, o, n = todo.pop(0)
            if n in best or c > 45:
                continue
            best[n] = (c, o)
            todo = sorted([*todo, *((c + d, o, b) for (a, b), d in ways.items() if a == n)])
        return best

    starts = [(o, o * 3, float(o)) for o in range(6)]
    assert {r.node: (r.cost, r.owner) for r in graph.shortest_paths(edges, seeds, 45.0).collect()} == dijkstra(starts)
    got = {(r.origin, r.node): r.cost for r in graph.shortest_paths(edges, seeds, 45.0, ("origin",)).collect()}
    assert got == {(s[0], n): c for s in starts for n, (c, _) in dijkstra([s]).items()}
    points = spark.createDataFrame([(i, rng.uniform(-3000, 3000), rng.uniform(-3000, 3000)) for i in range(40)], "id long, x double, y double")
    bars = spark.createDataFrame([(i, x - 20.0, y, x + 20.0, y, x, y) for i, (x, y) in enumerate((rng.uniform(-500, 500), rng.uniform(-500, 500)) for _ in range(15))], "e long, ax double, ay double, bx double, by double, x double, y double")
    far = {r.id: r.m for r in nearby.nearest_unbounded(points, bars, "id", lambda: geo.segment_distance(*[F.col(c) for c in ("x", "y", "r_ax", "r_ay", "r_bx", "r_by")]), 20.0, 100.0).collect()}
    odd = spark.createDataFrame([(100, None, 1.0), (101, 5.0, None), (102, float("nan"), 0.0), (103, 1e7, -1e7), (104, 0.0, 0.0)], "id long, x double, y double")
    distance = lambda: geo.segment_distance(*[F.col(c) for c in ("x", "y", "r_ax", "r_ay", "r_bx", "r_by")])
    got = {r.id: r for r in nearby.nearest_unbounded(points.unionByName(odd), bars, "id", distance, 20.0, 100.0, ["e"], 5000.0).collect()}
    assert [got[i].status for i in range(100, 105)] == ["no_place"] * 3 + ["too_far", "attached"] and got[103].m > 1e7 and got[100].m is None
    assert {i: got[i].m for i in far} == far
    assert {r.status for r in nearby.nearest_unbounded(odd, bars.limit(0), "id", distance, 20.0, 100.0).collect()} == {"no_place", "no_shape"}
    shapes = bars.collect()
    for p in points.collect():
        want = min((max(b.ax, min(b.bx, p.x)) - p.x) ** 2 + (b.ay - p.y) ** 2 for b in shapes) ** 0.5
        assert abs(far[p.id] - want) < 1e-9


def test_a_late_heartbeat_revives_no_session_and_state_expires(spark):
    base = datetime(2024, 1, 1)

    def event(i, user, hours, kind="ok"):
        return (i, base + timedelta(hours=hours), user, kind, 1.0)

    path = f"{shared_dir(spark)}/late-{random.random()}"
    schema = "event_id long, ts timestamp, user_id long, event_type string, value double"
    batches = [[event(1, 1, 0, "error"), event(2, 2, 0)], [event(3, 2, 300)], [event(8, 2, 300.2)], [event(4, 1, 0.5, "error"), event(5, 2, 301)], [event(6, 1, 302, "error"), event(7, 2, 302)]]
    for n, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.json(f"{path}/in/{n}")

    def run(build, name):
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(f"{path}/in/*")
        q = build(stream).writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", f"{path}/{name}").trigger(availableNow=True).start()
        q.awaitTermination()
        return spark.table(name).collect()

    leases = run(lambda e: streams.session_leases(e, "1 hour"), "leases")
    # The heartbeat at half an hour comes after the watermark has passed the lease: it neither joins it nor opens one.
    assert [r.beats for r in leases if r.user_id == 1] == [1]
    streaks = {r.event_id: r.streak for r in run(lambda e: streams.circuit_breaker(e), "streaks")}
    assert streaks[1] == 1 and streaks[6] == 1  # the state of user 1 was given up in between


def test_readers(spark):
    base = f"{shared_dir(spark)}/files-{random.random()}"
    df = spark.createDataFrame([(i, f"t{i % 3}") for i in range(30)], "task long, note string")
    files.append_revision(df, f"{base}/r", buckets=4)
    some = files.read_revisions(spark, f"{base}/r", [3, 17], buckets=4)
    assert sorted(r.task for r in some.collect()) == [3, 17]
    spark.createDataFrame([("area\n1\n 0 0\n 1 0\n 1 1\nEND\n!2\n 0 0\n 1e-1 0\n 0 1\nEND\nEND\n",)], "value string").coalesce(1).write.text(f"{base}/poly")
    rings = sorted((r.hole, len(r.points)) for r in files.read_coverage(spark, f"{base}/poly").collect())
    assert rings == [(False, 3), (True, 3)]
    with pytest.raises(Exception, match="secret"):
        files.write_results({"x": spark.createDataFrame([("has abc123",)], "v string")}, f"{base}/s", ("abc123",))
    spark.createDataFrame([("x",)], "type string").select(F.lit("FeatureCollection").alias("type"), F.lit("v2").alias("version"), F.array(F.struct(F.lit("Feature").alias("type"))).alias("features")).write.json(f"{base}/f")
    with pytest.raises(Exception, match="unexpected version"):
        files.read_features(spark, f"{base}/f", "v1", one_file=False).collect()
