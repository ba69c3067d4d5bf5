"""Readers and writers exercised on files that Spark derives from the given tables."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from footfall.plans.demo import Registry, demo
from footfall.session import shared_dir
from footfall.sources import files

R = Registry()
QUERIES, SQL = R.queries, R.sql


def _folder(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


@R.add(
    "page_scan",
    """
SELECT CASE WHEN seq % 10 = 9 THEN 'upstream_status' WHEN seq % 10 = 8 THEN 'wrong_result_type' WHEN seq % 10 = 7 THEN 'unreadable' ELSE 'accepted' END AS outcome, count(*) FILTER (WHERE seq % 10 < 7) AS facilities, count(DISTINCT seq * 100 + page) AS pages FROM poi_rows GROUP BY 1""",
    ("poi_rows",),
)
def q_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw pages written as JSON text, read back, and split into rows and named rejects."""
    rows = demo(spark, sf_dir, "poi_rows")
    result = F.struct("uid", "name", F.lit("x").alias("address"), F.struct(F.col("x").cast("string").alias("lng"), F.col("y").cast("string").alias("lat")).alias("location"), F.struct(F.col("tag").alias("classified_poi_tag")).alias("detail_info"))
    pages = rows.groupBy("seq", "page").agg(F.collect_list(result).alias("results"))  # a page holds some ten rows
    kind = F.when(F.col("seq") % 10 == 8, "hotel").otherwise("poi_type")
    text = F.to_json(F.struct(F.when(F.col("seq") % 10 == 9, 302).otherwise(0).alias("status"), F.size("results").alias("total"), kind.alias("result_type"), "results"))
    path = _folder(spark, "pages")
    pages.select("seq", "page", F.when(F.col("seq") % 10 == 7, "not json").otherwise(text).alias("payload")).write.json(path)
    good, bad = files.scan_pages(spark.read.schema("seq LONG, page INT, payload STRING").json(path))
    accepted = good.groupBy(F.lit("accepted").alias("outcome")).agg(F.count("uid").alias("facilities"), F.countDistinct("seq", "page").alias("pages"))
    rejected = bad.groupBy(F.col("reason").alias("outcome")).agg(F.lit(0).cast("long").alias("facilities"), F.countDistinct("seq", "page").alias("pages"))
    return accepted.unionByName(rejected)


@R.add("csv_sink", "SELECT id, CASE WHEN id % 2 = 0 THEN '''=' || name ELSE name END AS name, '[' || x || ',' || y || ']' AS place FROM facilities", ("facilities",))
def q_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A CSV sink with defused cells and nested values, read back."""
    f = demo(spark, sf_dir, "facilities").select("id", F.when(F.col("id") % 2 == 0, F.concat(F.lit("="), "name")).otherwise(F.col("name")).alias("name"), F.array("x", "y").alias("place"))
    path = _folder(spark, "csv")
    files.write_csv(f, path)
    return spark.read.schema("id LONG, name STRING, place STRING").csv(path, header=True, escape='"')


@R.add(
    "feature_layer",
    """SELECT category, count(*) AS features, CAST(sum(x) AS DOUBLE) AS sum_x FROM facilities GROUP BY category""",
    ("facilities",),
)
def q_layer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Facilities written as GeoJSON features and read back."""
    path = _folder(spark, "layer")
    files.features(demo(spark, sf_dir, "facilities"), "x", "y", ["id", "category"]).write.text(path)
    back = spark.read.text(path).select(F.from_json("value", "geometry STRUCT<coordinates: ARRAY<DOUBLE>>, properties STRUCT<category: STRING>").alias("f"))
    return back.groupBy("f.properties.category").agg(F.count("*").alias("features"), F.sum(F.col("f.geometry.coordinates")[0]).alias("sum_x"))


@R.add("revision_sink", "SELECT status, count(*) AS snapshots, count(DISTINCT task) AS hashes FROM tasks GROUP BY status", ("tasks",))
def q_revisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Snapshots appended with their payload hash, twice, and read back."""
    path = _folder(spark, "revisions")
    tasks = demo(spark, sf_dir, "tasks").select("task", "session", "status")
    files.append_revision(tasks.filter("task % 2 = 0"), path)
    files.append_revision(tasks.filter("task % 2 = 1"), path)
    return files.read_revisions(spark, path).groupBy("status").agg(F.count("*").alias("snapshots"), F.countDistinct("payload_hash").alias("hashes"))


@R.add(
    "replay_scan",
    """
SELECT 'q' || seq AS query, page AS page_no, count(*) AS facilities, CAST(sum(ord) AS BIGINT) AS checksum FROM poi_rows WHERE seq % 10 <> 9 GROUP BY seq, page""",
    ("poi_rows",),
)
def q_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Replay documents keyed query:page, written, read back and scanned; a tenth answers with an error status."""
    rows = demo(spark, sf_dir, "poi_rows")
    result = F.struct("uid", F.col("ord").cast("string").alias("name"), F.struct(F.col("tag").alias("classified_poi_tag")).alias("detail_info"))
    pages = rows.groupBy("seq", "page").agg(F.collect_list(result).alias("results"))  # a page holds some ten rows
    page = F.struct(F.when(F.col("seq") % 10 == 9, 302).otherwise(0).alias("status"), F.size("results").alias("total"), F.lit("poi_type").alias("result_type"), "results")
    docs = pages.select("seq", F.concat(F.lit("q"), "seq", F.lit(":"), "page").alias("k"), page.alias("v")).groupBy("seq").agg(F.map_from_entries(F.collect_list(F.struct("k", "v"))).alias("pages"))
    path = _folder(spark, "replay")
    docs.select(F.lit("demo").alias("source"), F.lit("a replay").alias("description"), "pages").write.json(path)
    good, _ = files.scan_pages(files.read_replay(spark, path, one_file=False))
    return good.groupBy("query", "page_no").agg(F.count("uid").alias("facilities"), F.sum(F.col("name").cast("long")).alias("checksum"))


@R.add(
    "event_log_scan",
    """
SELECT outcome, count(*) AS n, count(*) FILTER (WHERE event_id % 13 = 0) AS unverified, round(sum(CASE WHEN event_id % 7 <> 0 THEN (end_ms - start_ms) / 1000.0 END), 3) AS seconds FROM dispatch_log GROUP BY outcome""",
    ("dispatch_log",),
)
def q_event_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S3: dispatch events as JSON lines with missing fields, read back with the explicit schema."""
    log = demo(spark, sf_dir, "dispatch_log")
    line = F.struct(
        F.concat(F.lit("p"), F.col("user_id") % 5).alias("phase"), F.lit(200).alias("http_status"), "outcome", (F.col("start_ms") / 1000.0).alias("dispatchPerf"),
        F.when(F.col("event_id") % 7 != 0, F.col("end_ms") / 1000.0).alias("responsePerf"), F.when(F.col("event_id") % 13 != 0, F.lit(True)).alias("endpoint_verified"), F.lit("x").alias("unknown_field"),
    )
    path = _folder(spark, "events")
    log.select(F.to_json(line).alias("value")).write.text(path)
    back = files.read_events(spark, path)
    return back.groupBy("outcome").agg(F.count("*").alias("n"), F.count_if(F.col("endpoint_verified").isNull()).alias("unverified"), F.round(F.sum(F.col("responsePerf") - F.col("dispatchPerf")), 3).alias("seconds"))


@R.add(
    "case_table_scan",
    """
SELECT stratum AS "group", count(*) AS n, count(truth) AS decided, count(*) FILTER (WHERE prediction) AS inside, CAST(sum(duration) AS DOUBLE) AS seconds FROM cases GROUP BY stratum""",
    ("cases",),
)
def q_case_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The case table as CSV with a byte-order mark and blanks for null, read back with the explicit schema."""
    cases = demo(spark, sf_dir, "cases")
    columns = [F.concat_ws("-", "ord", "line").alias("\ufeffid"), F.col("stratum").alias("group"), F.lit(116.3).alias("lng_bd09"), F.lit(39.9).alias("lat_bd09"), F.col("truth").alias("polygon_inside"), "prediction", F.col("duration").cast("double").alias("duration_s")]
    rest = [F.lit(None).cast("string").alias(c) for c in ("strict_classification", "tolerant_classification", "reason", "origin_offset_m", "destination_offset_m")]
    path = _folder(spark, "cases")
    cases.select(*columns, *rest).write.csv(path, header=True, nullValue="")
    back = files.read_cases(spark, path)
    return back.groupBy("group").agg(F.count("id").alias("n"), F.count("polygon_inside").alias("decided"), F.count_if("prediction").alias("inside"), F.sum("duration_s").alias("seconds"))


@R.add(
    "tagged_features",
    """
WITH k AS (SELECT category, CASE id % 7 WHEN 0 THEN 'water' WHEN 1 THEN 'railway' WHEN 2 THEN 'bridge' WHEN 3 THEN 'barrier' WHEN 4 THEN 'major_road' END AS kind, CAST(x AS DOUBLE) AS x FROM facilities)
SELECT category, kind, count(*) AS n, sum(x) AS sum_x FROM k GROUP BY category, kind""",
    ("facilities",),
)
def q_tagged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Feature collections of one version, written and read back, and what each tagged way is to a walker."""
    k = F.col("id") % 7
    tag = lambda name, value: F.map_from_arrays(F.array(F.lit(name), F.lit("category")), F.array(F.lit(value), F.col("category")))
    tags = F.when(k == 0, tag("waterway", "river")).when(k == 1, tag("railway", "rail")).when(k == 2, tag("bridge", "yes")).when(k == 3, tag("barrier", "wall")).when(k == 4, tag("highway", "trunk")).otherwise(tag("highway", "footway"))
    feature = F.struct(F.lit("Feature").alias("type"), F.struct(F.lit("LineString").alias("type"), F.array(F.array(F.col("x").cast("double"), F.col("y").cast("double"))).alias("coordinates")).alias("geometry"), tags.alias("properties"))
    path = _folder(spark, "features")
    some = demo(spark, sf_dir, "facilities").withColumn("file", F.floor(F.col("id") / 50)).groupBy("file").agg(F.collect_list(feature).alias("features"))  # fifty a collection
    some.select(F.lit("FeatureCollection").alias("type"), F.lit("v1").alias("version"), "features").write.json(path)
    back = files.read_features(spark, path, "v1", one_file=False)
    kind = files.feature_kind(F.col("properties"))
    return back.groupBy(F.element_at("properties", "category").alias("category"), kind.alias("kind")).agg(F.count("*").alias("n"), F.sum(F.col("geometry.coordinates")[0][0]).alias("sum_x"))


@R.add(
    "dictionary_scan",
    """SELECT tag AS minor, count(DISTINCT name) AS hints, count(DISTINCT name) FILTER (WHERE name LIKE '%gear%') AS excluded, max(page) AS priority FROM poi_rows GROUP BY tag""",
    ("poi_rows",),
)
def q_dictionary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A category dictionary (minor categories with their name hints), written and read back, with its derived counts."""
    rows = demo(spark, sf_dir, "poi_rows").groupBy("tag").agg(F.collect_set("name").alias("names"), F.max("page").alias("priority"))  # some sixty names
    entry = rows.select(F.col("tag").alias("key"), F.lit("daily").alias("major"), F.col("names").alias("nameHints"), F.filter("names", lambda n: F.contains(n, F.lit("gear"))).alias("excludeHints"), "priority", F.lit(False).alias("negative"))
    path = _folder(spark, "dictionary")
    entry.write.json(path)
    back = files.read_dictionary(spark, path, one_file=False)
    return back.select(F.col("key").alias("minor"), F.size("nameHints").cast("long").alias("hints"), F.size("excludeHints").cast("long").alias("excluded"), "priority")


@R.add(
    "result_set_sink",
    """SELECT 'plan' AS part, count(*) AS n FROM demand UNION ALL SELECT 'result', count(*) FROM routes UNION ALL SELECT 'review', count(*) FROM facilities WHERE balance < 0""",
    ("demand", "routes", "facilities"),
)
def q_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A result set of several tables written after a search for secrets in every text cell, and read back."""
    path = _folder(spark, "results")
    frames = {"plan": demo(spark, sf_dir, "demand"), "result": demo(spark, sf_dir, "routes"), "review": demo(spark, sf_dir, "facilities").filter("balance < 0")}
    files.write_results(frames, path, ("super-secret-key",))
    parts = [spark.read.parquet(f"{path}/{name}").agg(F.count("*").alias("n")).select(F.lit(name).alias("part"), "n") for name in frames]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@R.add(
    "outline_layer",
    """SELECT id % 3 AS kind, count(*) AS features, 5 * count(*) AS corners, CAST(sum(x + 100 + (id % 3) * 25) AS DOUBLE) AS first_x FROM facilities GROUP BY 1""",
    ("facilities",),
)
def q_outlines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Areas written as closed GeoJSON polygons and read back."""
    from footfall.plans.spatial import catchments

    path = _folder(spark, "outlines")
    files.outlines(catchments(spark, sf_dir).withColumn("kind", F.col("area_id") % 3), "ring", ["kind"]).write.text(path)
    back = spark.read.text(path).select(F.from_json("value", "geometry STRUCT<coordinates: ARRAY<ARRAY<ARRAY<DOUBLE>>>>, properties STRUCT<kind: LONG>").alias("f"))
    ring = F.col("f.geometry.coordinates")[0]
    return back.groupBy("f.properties.kind").agg(F.count("*").alias("features"), F.sum(F.size(ring)).alias("corners"), F.sum(ring[0][0]).alias("first_x"))


@R.add(
    "review_scan",
    """
WITH p AS (SELECT id, seq AS x, id AS y FROM (SELECT id, unnest(range(1, 4)) AS seq FROM facilities))
SELECT id AS review_id, CASE WHEN id % 5 = 0 THEN 'schema' WHEN id % 7 = 0 THEN 'version_mismatch' END AS reason, 1::DOUBLE AS min_x, CAST(id AS DOUBLE) AS min_y, 3::DOUBLE AS max_x, CAST(id AS DOUBLE) AS max_y FROM p GROUP BY id""",
    ("facilities",),
)
def q_reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reviews with the reason they do not apply, and their bounding boxes."""
    f = demo(spark, sf_dir, "facilities")
    point = F.transform(F.sequence(F.lit(1), F.lit(3)), lambda i: F.struct(i.cast("double").alias("x"), F.col("id").cast("double").alias("y")))
    rows = f.select(F.col("id").alias("review_id"), F.when(F.col("id") % 5 != 0, 2).alias("schema_version"), F.when(F.col("id") % 7 == 0, "old").otherwise("new").alias("data_version"), point.alias("points"))
    return files.scan_reviews(rows, 2, "new")


@R.add(
    "coverage_polygons",
    """SELECT id AS area_id, 1 + CASE WHEN id % 3 = 0 THEN 1 ELSE 0 END AS rings, CASE WHEN id % 3 = 0 THEN 1 ELSE 0 END AS holes, 4 + CASE WHEN id % 3 = 0 THEN 3 ELSE 0 END AS points, CAST(4 * x + 2 + CASE WHEN id % 3 = 0 THEN 3 * x + 1 ELSE 0 END AS DOUBLE) AS sum_x FROM facilities""",
    ("facilities",),
)
def q_polygons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Polygon texts with a shell, and a hole in every third, written and parsed file by file."""
    f = demo(spark, sf_dir, "facilities")
    corner = lambda dx, dy: F.concat_ws("   ", (F.col("x") + dx).cast("string"), (F.col("y") + dy).cast("string"))
    shell = [F.lit("1"), corner(0, 0), corner(1, 0), corner(1, 1), corner(0, 1), F.lit("END")]
    hole = F.when(F.col("id") % 3 == 0, F.concat_ws("\n", F.lit("!2"), corner(0, 0), corner(1, 0), corner(0, 1), F.lit("END")))
    text = F.concat_ws("\n", F.concat(F.lit("area"), "id"), *shell, hole, F.lit("END"))
    path = _folder(spark, "poly")
    f.select(F.col("id").alias("file"), text.alias("text")).write.json(path)
    lines = spark.read.schema("file LONG, text STRING").json(path).select("file", F.posexplode(F.split("text", "\n")).alias("no", "value"))
    rings = files.parse_coverage(lines)
    return rings.groupBy(F.col("file").alias("area_id")).agg(F.count("*").alias("rings"), F.count_if("hole").alias("holes"), F.sum(F.size("points")).alias("points"), F.sum(F.aggregate("points", F.lit(0.0), lambda s, p: s + p["x"])).alias("sum_x"))
