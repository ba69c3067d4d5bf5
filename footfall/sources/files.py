"""Readers and writers of the domain's files (S1 to S14). Schemas are explicit; rejects keep a reason."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from footfall.functions.text import escape_formula

PAGE = """status INT, total INT, result_type STRING, results ARRAY<STRUCT<uid: STRING, name: STRING, address: STRING, location: STRUCT<lng: STRING, lat: STRING>,
  detail_info: STRUCT<classified_poi_tag: STRING, parent_id: STRING, navi_location: STRUCT<lng: STRING, lat: STRING>>>>"""
FEATURE = "type STRING, version STRING, features ARRAY<STRUCT<type: STRING, geometry: STRUCT<type: STRING, coordinates: ARRAY<ARRAY<DOUBLE>>>, properties: MAP<STRING, STRING>>>"
EVENT = "phase STRING, path STRING, http_status INT, outcome STRING, attempt INT, batch STRING, dispatchPerf DOUBLE, responsePerf DOUBLE, endpoint_verified BOOLEAN"
CASE = "id STRING, `group` STRING, lng_bd09 DOUBLE, lat_bd09 DOUBLE, polygon_inside BOOLEAN, prediction BOOLEAN, duration_s DOUBLE, strict_classification STRING, tolerant_classification STRING, reason STRING, origin_offset_m DOUBLE, destination_offset_m DOUBLE"


def scan_pages(payloads: DataFrame, payload: str = "payload") -> tuple[DataFrame, DataFrame]:
    """(rows of good pages, bad pages with a reason). Only allow-listed fields survive the schema."""
    parsed = payloads.withColumn("p_", F.from_json(payload, PAGE))
    reason = F.when(F.col("p_").isNull() | (F.col("p_.status").isNull() & F.col("p_.results").isNull()), "unreadable").when(F.col("p_.status") != 0, "upstream_status").when(F.coalesce(F.col("p_.result_type"), F.lit("")) != "poi_type", "wrong_result_type")
    marked = parsed.withColumn("reason", reason)
    keep = [c for c in payloads.columns if c != payload]
    good = marked.filter("reason IS NULL").select(*keep, F.explode_outer("p_.results").alias("r")).select(*keep, "r.uid", "r.name", "r.address", "r.location", F.col("r.detail_info.classified_poi_tag").alias("tag"), F.col("r.detail_info.parent_id").alias("parent_uid"), F.col("r.detail_info.navi_location").alias("navi_location"))
    return good, marked.filter("reason IS NOT NULL").select(*keep, "reason")


def read_replay(spark: SparkSession, path: str, one_file: bool = True) -> DataFrame:
    """Pages of a replay file keyed ``query:page`` (``one_file``: the file is one document, else one on each line)."""
    raw = spark.read.schema(f"source STRING, description STRING, pages MAP<STRING, STRUCT<{PAGE}>>").json(path, multiLine=one_file)
    return raw.select(F.explode("pages").alias("k", "page")).select(F.substring_index("k", ":", 1).alias("query"), F.substring_index("k", ":", -1).cast("int").alias("page_no"), F.to_json("page").alias("payload"))


def read_events(spark: SparkSession, path: str) -> DataFrame:
    """S3: JSON lines of dispatch events."""
    return spark.read.schema(EVENT).json(path)


def read_cases(spark: SparkSession, path: str) -> DataFrame:
    """The case table with a byte-order mark and blanks for null (Spark's CSV reader drops the mark)."""
    return spark.read.schema(CASE).csv(path, header=True, nullValue="", encoding="UTF-8")


def read_features(spark: SparkSession, path: str, version: str, one_file: bool = True) -> DataFrame:
    """One row per feature; another version than asked for fails the job."""
    raw = spark.read.schema(FEATURE).json(path, multiLine=one_file)
    checked = raw.filter(F.assert_true(F.col("version") == version, "unexpected version").isNull())
    return checked.select(F.explode("features").alias("f")).select("f.geometry", "f.properties")


def parse_coverage(lines: DataFrame) -> DataFrame:
    """Rings of polygon texts: ``file, ring, hole, points``.

    ``lines`` has ``file``, ``no`` (line number from 0) and ``value``. The first line names the file; a ring is a
    heading (``!`` for a hole), lines of two numbers, and END. Lines are numbered within their file, never across files.
    """
    own = lines.filter("no > 0 AND trim(value) <> ''").withColumn("value", F.trim("value"))
    ended = F.sum(F.when(F.col("value") == "END", 1).otherwise(0)).over(Window.partitionBy("file").orderBy("no").rowsBetween(Window.unboundedPreceding, -1))
    marked = own.withColumn("ring", F.coalesce(ended, F.lit(0)))
    xy = F.split("value", r"\s+")
    point = F.when((F.size(xy) == 2) & F.col("value").rlike(r"^[-+0-9.eE]+\s+[-+0-9.eE]+$"), F.struct("no", xy[0].cast("double").alias("x"), xy[1].cast("double").alias("y")))
    rings = marked.groupBy("file", "ring").agg(F.max(F.col("value").startswith("!")).alias("hole"), F.sort_array(F.collect_list(point)).alias("points"))
    return rings.filter(F.size("points") > 0).withColumn("points", F.transform("points", lambda p: F.struct(p["x"].alias("x"), p["y"].alias("y"))))


def read_coverage(spark: SparkSession, path: str) -> DataFrame:
    """S6 from files (a polygon file is one small file, read as a whole)."""
    text = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), F.posexplode(F.split("value", r"\r?\n")).alias("no", "value"))
    return parse_coverage(text)


def outlines(df: DataFrame, ring: str, properties: list[str]) -> DataFrame:
    """One GeoJSON polygon per row, as text; the ring is closed."""
    corners = F.transform(F.concat(F.col(ring), F.slice(ring, 1, 1)), lambda p: F.array(p["x"].cast("double"), p["y"].cast("double")))
    geometry = F.struct(F.lit("Polygon").alias("type"), F.array(corners).alias("coordinates"))
    return df.select(F.to_json(F.struct(F.lit("Feature").alias("type"), geometry.alias("geometry"), F.struct(*properties).alias("properties"))).alias("feature"))


def read_dictionary(spark: SparkSession, path: str, one_file: bool = True) -> DataFrame:
    """The category dictionary with its hint arrays."""
    schema = "key STRING, major STRING, displayGroup STRING, label STRING, poiRuntime BOOLEAN, query STRING, extraQueries ARRAY<STRING>, nameHints ARRAY<STRING>, tagHints ARRAY<STRING>, excludeHints ARRAY<STRING>, priority INT, negative BOOLEAN"
    return spark.read.schema(schema).json(path, multiLine=one_file)


def feature_kind(tags: Column) -> Column:
    """What a tagged way is to a walker: water, railway, barrier, bridge or major road; else null."""
    road = F.element_at(tags, "highway")
    return (
        F.when(F.element_at(tags, "bridge").isNotNull() & (F.element_at(tags, "bridge") != "no"), "bridge")
        .when((F.element_at(tags, "natural") == "water") | F.element_at(tags, "waterway").isNotNull(), "water").when(F.element_at(tags, "railway").isNotNull(), "railway")
        .when(F.element_at(tags, "barrier").isNotNull(), "barrier").when(road.isin("motorway", "trunk", "primary"), "major_road")
    )


def csv_cells(df: DataFrame) -> DataFrame:
    """Nested cells as JSON, text cells defused against spreadsheet formulas."""
    nested = ("array", "map", "struct")
    return df.select(*[F.to_json(c).alias(c) if t.startswith(nested) else escape_formula(F.col(c)).alias(c) if t == "string" else F.col(c) for c, t in df.dtypes])


def write_csv(df: DataFrame, path: str) -> None:
    """S10."""
    csv_cells(df).write.mode("errorifexists").csv(path, header=True, escape='"')


def write_results(frames: dict[str, DataFrame], path: str, secrets: tuple[str, ...] = ()) -> None:
    """One folder per frame; a secret in any text cell fails the job before anything is kept."""
    for name, df in frames.items():
        for secret in secrets:
            texts = [F.coalesce(F.contains(F.col(c), F.lit(secret)), F.lit(False)) for c, t in df.dtypes if t == "string"]
            for leak in texts:
                df = df.filter(F.assert_true(~leak, "a secret would be written").isNull())
        df.write.mode("errorifexists").parquet(f"{path}/{name}")


def features(df: DataFrame, x: str, y: str, properties: list[str]) -> DataFrame:
    """One GeoJSON feature per row, as text."""
    geometry = F.struct(F.lit("Point").alias("type"), F.array(F.col(x).cast("double"), F.col(y).cast("double")).alias("coordinates"))
    return df.select(F.to_json(F.struct(F.lit("Feature").alias("type"), geometry.alias("geometry"), F.struct(*properties).alias("properties"))).alias("feature"))


def append_revision(df: DataFrame, path: str, key: str = "task", buckets: int = 64) -> None:
    """Appends snapshots with the hash of their payload, in so many folders by a hash of the key."""
    payload = F.to_json(F.struct(*sorted(df.columns)))
    rows = df.withColumn("payload_hash", F.sha2(payload, 256)).withColumn("bucket", F.pmod(F.xxhash64(key), F.lit(buckets)))
    rows.repartition("bucket").write.mode("append").partitionBy("bucket").parquet(path)


def read_revisions(spark: SparkSession, path: str, tasks: list | None = None, key: str = "task", buckets: int = 64) -> DataFrame:
    """The snapshots of a folder; those of some ``tasks`` read their buckets alone."""
    rows = spark.read.parquet(path)
    if tasks is not None:
        wanted = F.array(*[F.pmod(F.xxhash64(F.lit(t).cast(rows.schema[key].dataType)), F.lit(buckets)) for t in tasks])
        rows = rows.filter(F.array_contains(wanted, F.col("bucket").cast("long")) & F.col(key).isin(*tasks))
    return rows.drop("bucket")


def scan_reviews(rows: DataFrame, schema_version: int, data_version: str) -> DataFrame:
    """Reviews with the reason they do not apply (null if they do) and their bounding box.

    ``rows`` has ``review_id, schema_version, data_version, points`` (array of struct x, y).
    """
    reason = F.when(F.col("schema_version").isNull() | (F.col("schema_version") != schema_version), "schema").when(F.col("data_version") != data_version, "version_mismatch").when(F.size("points") == 0, "empty")
    def xs(c: str) -> Column:
        return F.transform("points", lambda p: p[c])

    return rows.select("review_id", reason.alias("reason"), F.array_min(xs("x")).alias("min_x"), F.array_min(xs("y")).alias("min_y"), F.array_max(xs("x")).alias("max_x"), F.array_max(xs("y")).alias("max_y"))
