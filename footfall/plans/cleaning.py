"""Facility records from raw pages: normalising, classifying, deduplicating, merging, planning, sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from footfall.functions import geo, rules, text
from footfall.operators import entity
from footfall.plans.demo import Registry, demo
from footfall.session import table

R = Registry()
QUERIES, SQL = R.queries, R.sql
POI = ("poi_rows",)

#: A small dictionary in the form that the classifiers take, for the demonstration names and tags.
DICTIONARY = [
    {"key": "tools", "names": ["widget", "gizmo"], "tags": ["ECONOMY", "STANDARD"], "excludes": ["hot"], "priority": 2, "negative": False},
    {"key": "hardware", "names": ["bolt", "ring"], "tags": ["MEDIUM"], "excludes": [], "priority": 2, "negative": False},
    {"key": "machines", "names": ["gear"], "tags": ["LARGE", "PROMO"], "excludes": ["small"], "priority": 5, "negative": False},
    {"key": "waste", "names": ["cold ring"], "tags": [], "excludes": [], "priority": 9, "negative": True},
]

#: Words of the keyword classifier, and the lookup of minor categories.
WORDS = [
    {"key": "tool", "include": ["widget", "gizmo"], "exclude": ["hot"], "priority": 1},
    {"key": "ring", "include": ["ring"], "priority": 1},
    {"key": "gear", "include": ["gear", "small gear"], "priority": 1},
    {"key": "bolt", "include": ["bolt"], "priority": 3},
    {"key": "waste", "include": ["red"], "priority": 9, "negative": True},
    {"key": "later", "include": ["blue"], "priority": 9, "gated": True},
]
LOOKUP = [
    ("ECONOMY", "daily", "living"), ("STANDARD", "daily", "living"), ("MEDIUM", "health", "care"), ("LARGE", "culture", "leisure"), ("PROMO", "sport", "leisure"),
    ("SMALL", "school", "learning"), ("NONE", "none", "none"),
]


@R.add(
    "rule_classifier",
    """
WITH p AS (SELECT p_partkey AS id, CASE WHEN p_partkey % 29 = 0 THEN p_name || ' 3号门' ELSE p_name END AS n, CASE p_partkey % 3 WHEN 0 THEN p_type || '；steelworks' WHEN 1 THEN p_type || ' | OTHER' ELSE p_type END AS g FROM part),
q AS (SELECT *, list_distinct(list_filter(list_transform(string_split_regex(g, '[;；,，|>]'), lambda v: trim(v)), lambda v: v <> '')) AS t FROM p),
h AS (
  SELECT *, (contains(n, 'widget') OR contains(n, 'gizmo')) AND NOT contains(n, 'hot') AS n1, list_has_any(t, ['ECONOMY', 'STANDARD']) AND NOT contains(n, 'hot') AS t1,
    contains(n, 'bolt') OR contains(n, 'ring') AS n2, list_has_any(t, ['MEDIUM']) AS t2, contains(n, 'gear') AND NOT contains(n, 'small') AS n3, list_has_any(t, ['LARGE', 'PROMO']) AND NOT contains(n, 'small') AS t3, contains(n, 'cold ring') AS n4 FROM q
), s AS (
  SELECT *, CASE WHEN contains(n, 'steel') OR regexp_matches(n, '\\d+号门') THEN 'excluded' WHEN contains(n || ' ' || g, 'green') THEN 'needs_review' WHEN n4 THEN 'excluded'
    WHEN NOT (n3 OR t3) AND (n1 OR t1) AND (n2 OR t2) THEN 'needs_review'
    WHEN (n3 OR t3) THEN CASE WHEN t3 THEN 'accepted' ELSE 'needs_review' END WHEN t1 OR t2 THEN 'accepted' ELSE 'needs_review' END AS status FROM h
)
SELECT id, status, CASE WHEN status = 'accepted' THEN CASE WHEN n3 OR t3 THEN 'machines' WHEN n2 OR t2 THEN 'hardware' ELSE 'tools' END END AS category FROM s""",
)
def q_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dictionary classification with excludes, review words, gates, tags of several parts, parent tags and priorities."""
    gate = F.when(F.col("p_partkey") % 29 == 0, F.concat("p_name", F.lit(" 3号门"))).otherwise(F.col("p_name"))
    tag = F.when(F.col("p_partkey") % 3 == 0, F.concat("p_type", F.lit("；steelworks"))).when(F.col("p_partkey") % 3 == 1, F.concat("p_type", F.lit(" | OTHER"))).otherwise(F.col("p_type"))
    rows = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), gate.alias("name"), F.array(tag).alias("tags"))
    return entity.rule_classifier(rows, DICTIONARY, ["steel"], ["green"], ["CONFLICT"], parents=["steelworks"]).select("id", "status", "category")


@R.twin(
    "keyword_classifier", POI,
    """
WITH p AS (SELECT DISTINCT uid, name FROM {poi_rows}),
k AS (SELECT 'tool' AS key, 'widget' AS word, 1 AS prio, false AS neg UNION ALL SELECT 'tool', 'gizmo', 1, false UNION ALL SELECT 'ring', 'ring', 1, false UNION ALL SELECT 'gear', 'gear', 1, false UNION ALL SELECT 'gear', 'small gear', 1, false
  UNION ALL SELECT 'bolt', 'bolt', 3, false UNION ALL SELECT 'waste', 'red', 9, true),
h AS (SELECT p.uid, k.* FROM p JOIN k ON contains(p.name, k.word) WHERE NOT contains(p.name, 'cold') AND NOT (k.key = 'tool' AND contains(p.name, 'hot')) AND NOT (k.key = 'ring' AND contains(p.name, 'gear'))),
r AS (SELECT *, row_number() OVER (PARTITION BY uid ORDER BY prio DESC, length(word) DESC, key, word) AS n FROM h)
SELECT p.uid, CASE WHEN NOT r.neg THEN r.key END AS category, r.word AS keyword, coalesce(r.neg, false) AS negative, CASE WHEN r.word IS NULL THEN 0e0 ELSE least(1e0, length(r.word) / 4e0) END AS confidence FROM p LEFT JOIN r ON r.uid = p.uid AND r.n = 1""",
)
def q_keyword_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keywords by priority and length, with excludes, shadowing, gates and negative categories."""
    rows = demo(spark, sf_dir, "poi_rows").select("uid", "name").distinct()
    return entity.keyword_classifier(rows, "uid", "name", WORDS, ["cold"], {"ring": "gear"})


@R.twin(
    "category_lookup", POI,
    """
SELECT d.major, d.display, count(DISTINCT p.uid) AS facilities FROM (
  SELECT 'ECONOMY' AS minor, 'daily' AS major, 'living' AS display UNION ALL SELECT 'STANDARD', 'daily', 'living' UNION ALL SELECT 'MEDIUM', 'health', 'care' UNION ALL SELECT 'LARGE', 'culture', 'leisure' UNION ALL SELECT 'PROMO', 'sport', 'leisure' UNION ALL SELECT 'SMALL', 'school', 'learning' UNION ALL SELECT 'NONE', 'none', 'none'
) d LEFT JOIN {poi_rows} p ON p.tag = d.minor GROUP BY d.major, d.display""",
)
def q_category_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """C4, A2: majors and display groups by lookup, with zero counts."""
    lookup = spark.createDataFrame(LOOKUP, "minor string, major string, display string")
    return entity.display_counts(lookup, demo(spark, sf_dir, "poi_rows"), "minor", "tag", "uid")


@R.add(
    "dedupe_keep_best",
    """
SELECT uid, name, seq, page, copies FROM (SELECT uid, name, seq, page, count(*) OVER (PARTITION BY uid) AS copies, row_number() OVER (PARTITION BY uid ORDER BY (CASE WHEN tag <> 'SMALL' THEN 2 ELSE 0 END + CASE WHEN seq % 3 = 0 THEN 1 ELSE 0 END) DESC, seq, page, ord, name) AS n FROM poi_rows) WHERE n = 1""",
    POI,
)
def q_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The most complete row of every facility, and how many it stands for."""
    score = F.when(F.col("tag") != "SMALL", 2).otherwise(0) + F.when(F.col("seq") % 3 == 0, 1).otherwise(0)
    return entity.keep_best(demo(spark, sf_dir, "poi_rows"), F.col("uid"), score, ["seq", "page", "ord", "name"]).select("uid", "name", "seq", "page", "copies")


def _classified_sql(source: str, name: str) -> str:
    """CTEs ``name`` of the demonstration dictionary over ``source`` (n: name, t: tags): status and category."""
    return f"""{name}_h AS (
  SELECT *, (contains(n, 'widget') OR contains(n, 'gizmo')) AND NOT contains(n, 'hot') AS n1, list_has_any(t, ['ECONOMY', 'STANDARD']) AND NOT contains(n, 'hot') AS t1, contains(n, 'bolt') OR contains(n, 'ring') AS n2, list_has_any(t, ['MEDIUM']) AS t2,
    contains(n, 'gear') AND NOT contains(n, 'small') AS n3, list_has_any(t, ['LARGE', 'PROMO']) AND NOT contains(n, 'small') AS t3, contains(n, 'cold ring') AS n4 FROM {source}),
{name} AS (SELECT * EXCLUDE (n1, t1, n2, t2, n3, t3, n4), CASE WHEN contains(n, 'blue') THEN 'excluded' WHEN contains(n, 'green') THEN 'needs_review' WHEN n4 THEN 'excluded' WHEN NOT (n3 OR t3) AND (n1 OR t1) AND (n2 OR t2) THEN 'needs_review'
  WHEN n3 OR t3 THEN CASE WHEN t3 THEN 'accepted' ELSE 'needs_review' END WHEN t1 OR t2 THEN 'accepted' ELSE 'needs_review' END AS status, CASE WHEN n3 OR t3 THEN 'machines' WHEN n2 OR t2 THEN 'hardware' ELSE 'tools' END AS category FROM {name}_h)"""


_KEY = r"regexp_replace(lower({}), '[\s()]+', '', 'g')"


@R.add(
    "entity_merge",
    f"""
WITH o AS (SELECT uid, CASE WHEN ord % 97 = 0 THEN upper(name) || ' (1)' WHEN ord % 389 = 0 THEN name || ' x' ELSE name END AS name, CASE ord % 2 WHEN 0 THEN '' ELSE CASE WHEN ord % 383 = 0 THEN 'Else' ELSE 'At  ' || uid END END AS address,
  CASE WHEN ord % 379 = 0 THEN 'P' WHEN ord % 3 = 0 THEN 'p ' END AS parent, tag, CASE WHEN ord % 373 = 0 THEN x + 1 ELSE x END AS x, y, seq FROM poi_rows),
r AS (SELECT *, name AS n, [tag] AS t FROM o),
{_classified_sql('r', 'c')},
g AS (SELECT uid, count(*) AS observations, list_sort(list(DISTINCT name)) AS names, list_sort(list(DISTINCT tag)) AS t, min(seq) AS first_seq, NOT bool_or(x * x + y * y <= 2250000) AS outside,
  min(x) <> max(x) OR min(y) <> max(y) AS k1, count(DISTINCT {_KEY.format('name')}) > 1 AS k2, count(DISTINCT CASE WHEN address <> '' THEN {_KEY.format('address')} END) > 1 AS k3, count(DISTINCT {_KEY.format('parent')}) > 1 AS k4, bool_or(status = 'excluded') AND bool_or(status <> 'excluded') AS k5 FROM c GROUP BY uid),
w AS (SELECT *, array_to_string(names, ' / ') AS n FROM g),
{_classified_sql('w', 'd')},
f AS (SELECT *, list_filter([CASE WHEN k1 THEN 'uid_location_conflict' END, CASE WHEN k2 THEN 'uid_name_conflict' END, CASE WHEN k3 THEN 'uid_address_conflict' END, CASE WHEN k4 THEN 'uid_parent_conflict' END, CASE WHEN k5 THEN 'uid_classification_conflict' END], lambda v: v IS NOT NULL) AS conflicts FROM d)
SELECT uid, observations, array_to_string(names, '|') AS names, array_to_string(t, '|') AS tags, array_to_string(conflicts, '|') AS conflicts,
  CASE WHEN len(conflicts) = 0 AND status = 'accepted' AND category IN ('tools', 'machines') THEN category END AS category,
  CASE WHEN len(conflicts) > 0 THEN 'needs_review' WHEN status = 'accepted' AND category NOT IN ('tools', 'machines') THEN 'excluded' ELSE status END AS status, outside, first_seq FROM f""",
    POI,
)
def q_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entities by uid with every kind of conflict, judged again as a whole, in three parts, and those outside the region told apart."""
    o = F.col("ord")
    name = F.when(o % 97 == 0, F.concat(F.upper("name"), F.lit(" (1)"))).when(o % 389 == 0, F.concat("name", F.lit(" x"))).otherwise(F.col("name"))
    address = F.when(o % 2 == 0, "").when(o % 383 == 0, "Else").otherwise(F.concat(F.lit("At  "), "uid"))
    parent = F.when(o % 379 == 0, "P").when(o % 3 == 0, "p ")
    rows = demo(spark, sf_dir, "poi_rows").select("uid", name.alias("name"), address.alias("address"), parent.alias("parent"), "tag", F.when(o % 373 == 0, F.col("x") + 1).otherwise(F.col("x")).alias("x"), "y", "seq")
    judge = lambda df: entity.rule_classifier(df, DICTIONARY, ["blue"], ["green"], ["CONFLICT"])
    out = entity.merge_entities(rows, judge, ["tools", "machines"], F.expr("x * x + y * y <= 2250000"))
    return out.select("uid", "observations", *[F.concat_ws("|", c).alias(c) for c in ("names", "tags", "conflicts")], "category", "status", "outside", "first_seq")


@R.add(
    "possible_duplicates",
    r"""
WITH RECURSIVE f AS (SELECT p_partkey AS id, lower(p_name) AS name, CASE p_partkey % 5 WHEN 0 THEN NULL WHEN 1 THEN '  ' WHEN 2 THEN p_brand || ', 1' ELSE lower(p_brand) || ' (1)' END AS address, (p_partkey * 7919) % 401 AS x, (p_partkey * 104729) % 397 AS y FROM part),
k AS (SELECT id, x, y, address AS raw, regexp_replace(name, '[\s(),.]+', '', 'g') AS name, regexp_replace(lower(address), '[\s(),.]+', '', 'g') AS address FROM f),
e AS (SELECT a.id AS s, b.id AS d FROM k a JOIN k b ON a.name = b.name AND a.address = b.address AND trim(a.raw) <> '' AND a.id <> b.id AND sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2) <= 60),
w AS (SELECT s AS id, s AS r FROM e UNION SELECT w.id, e.d FROM w JOIN e ON e.s = w.r)
SELECT id, min(r) AS group_id FROM w GROUP BY id""",
)
def q_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Equal names at equal addresses within 60 m, grouped transitively; records without an address are left out."""
    k, b = F.col("p_partkey"), F.col("p_brand")
    address = F.when(k % 5 == 0, F.lit(None).cast("string")).when(k % 5 == 1, "  ").when(k % 5 == 2, F.concat(b, F.lit(", 1"))).otherwise(F.concat(F.lower(b), F.lit(" (1)")))
    rows = table(spark, sf_dir, "part").select(k.alias("id"), F.upper("p_name").alias("name"), address.alias("address"), ((k * 7919) % 401).alias("x"), ((k * 104729) % 397).alias("y"))
    return entity.possible_duplicates(rows, 60.0)


@R.twin(
    "retrieval_statistics", POI,
    """
SELECT count(*) AS raw_rows, count(DISTINCT uid) AS merged, count_if(x * x + y * y > 4000000) AS outside, count_if(tag = 'SMALL') AS invalid, count(DISTINCT CASE WHEN x * x + y * y <= 4000000 AND tag <> 'SMALL' THEN uid END) AS accepted, count(DISTINCT seq * 100 + page) AS pages FROM {poi_rows}""",
)
def q_retrieval_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The retrieval statistics block."""
    return entity.retrieval_statistics(demo(spark, sf_dir, "poi_rows"), "uid", F.expr("x * x + y * y > 4000000"), F.col("tag") == "SMALL", ["seq", "page"])


@R.twin("source_attribution", POI, "SELECT seq AS source, count(DISTINCT page) AS pages, count_if(page = 1) AS live, min(ord) AS first_seen FROM {poi_rows} GROUP BY seq",
)
def q_source_attribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A4: pages, live pages and first sight per source."""
    return entity.source_attribution(demo(spark, sf_dir, "poi_rows"), "seq", "page", F.col("page") == 1, "ord")


@R.twin(
    "quarantine_split", POI,
    """
SELECT reason, count(*) AS n, min(ord) AS first_ord FROM (
  SELECT ord, CASE WHEN tag = 'SMALL' THEN 'invalid_category' WHEN x * x + y * y > 6000000 THEN 'outside_window' WHEN name LIKE 'cold%' THEN 'needs_review' ELSE 'accepted' END AS reason FROM {poi_rows}
) t GROUP BY reason""",
)
def q_quarantine_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row kept under a named reason."""
    split = entity.split_by_reason(demo(spark, sf_dir, "poi_rows"), invalid_category=F.col("tag") == "SMALL", outside_window=F.expr("x * x + y * y > 6000000"), needs_review=F.col("name").startswith("cold"))
    return split.groupBy("reason").agg(F.count("*").alias("n"), F.min("ord").alias("first_ord"))


@R.twin(
    "review_sample", ("facilities",),
    """
SELECT category, id, CAST(n AS BIGINT) AS n FROM (SELECT category, id, row_number() OVER (PARTITION BY category ORDER BY sha256(CAST(id AS VARCHAR(20))), id) AS n, balance FROM {facilities}) t WHERE n <= 15 OR balance < -990""",
)
def q_review_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fifteen per category in a stable pseudo-random order, and the disputed ones."""
    return entity.review_sample(demo(spark, sf_dir, "facilities"), "category", "id", 15, F.col("balance") < -990).select("category", "id", "n")


@R.twin(
    "search_plan", ("facilities", "demand"),
    """
SELECT t.tx, t.ty, c.category, k.keyword, t.n FROM (SELECT CAST(floor(ix / 20e0) AS BIGINT) AS tx, CAST(floor(iy / 20e0) AS BIGINT) AS ty, count(*) AS n FROM {demand} GROUP BY 1, 2) t CROSS JOIN (SELECT DISTINCT category FROM {facilities}) c CROSS JOIN (SELECT 'primary' AS keyword UNION ALL SELECT 'secondary') k""",
)
def q_search_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tiles x categories x keywords (dimension tables of bounded size)."""
    return entity.search_plan(demo(spark, sf_dir, "demand"), "ix", "iy", 20.0, demo(spark, sf_dir, "facilities").select("category"), ["primary", "secondary"])


@R.twin(
    "coarse_plan", ("facilities", "demand"),
    """
SELECT b.bx, b.by_ AS by_, c.category FROM (SELECT 0 AS bx, 0 AS by_ UNION ALL SELECT 0, 1 UNION ALL SELECT 1, 0 UNION ALL SELECT 1, 1) b CROSS JOIN (SELECT category, count(*) AS n FROM {facilities} GROUP BY category) c
WHERE EXISTS (SELECT 1 FROM {demand} d WHERE CASE WHEN d.ix >= 0 THEN 1 ELSE 0 END = b.bx AND CASE WHEN d.iy >= 0 THEN 1 ELSE 0 END = b.by_)""",
)
def q_coarse_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First-round blocks that meet the domain."""
    return entity.coarse_plan(demo(spark, sf_dir, "demand"), "ix", "iy", demo(spark, sf_dir, "facilities").select("category"))


@R.twin(
    "arm_comparison", POI,
    """
SELECT coalesce(b.tag, a.tag) AS category, count_if(a.uid IS NULL) AS missing, count_if(b.uid IS NULL) AS added, count_if(a.uid IS NOT NULL AND b.uid IS NOT NULL) AS both_, round(count_if(a.uid IS NOT NULL AND b.uid IS NOT NULL) / CAST(nullif(count(b.uid), 0) AS DOUBLE), 9) AS recall
FROM (SELECT DISTINCT uid, tag FROM {poi_rows} WHERE seq % 2 = 0) b FULL OUTER JOIN (SELECT DISTINCT uid, tag FROM {poi_rows} WHERE seq % 3 = 0) a ON a.uid = b.uid AND a.tag = b.tag GROUP BY 1""",
)
def q_arm_comparison(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Missing, added and shared entities of an arm."""
    rows = demo(spark, sf_dir, "poi_rows")
    return entity.compare_arms(rows.filter("seq % 2 = 0"), rows.filter("seq % 3 = 0"), "uid", "tag")


@R.twin(
    "set_differences", ("facilities",),
    """
SELECT 'requested_only' AS side, category FROM (SELECT category FROM {facilities} WHERE id % 2 = 0 EXCEPT SELECT category FROM {facilities} WHERE category < 'F') a
UNION ALL SELECT 'both', category FROM (SELECT category FROM {facilities} INTERSECT SELECT category FROM {facilities} WHERE category < 'F') b""",
)
def q_set_differences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requested minus core, and both."""
    rows = demo(spark, sf_dir, "facilities")
    return entity.requested_categories(rows.filter("id % 2 = 0"), rows.filter("category < 'F'"), "category")


@R.add(
    "canonical_names",
    r"""SELECT regexp_replace(lower(nfc_normalize(v)), '[\s()（）,，.。·]+', '', 'g') AS canonical, count(*) AS n FROM (SELECT CASE p_partkey % 4 WHEN 0 THEN upper(p_name) || ' (2)' WHEN 1 THEN p_name || '·Ä' ELSE replace(p_name, ' ', '-') || '.' END AS v FROM part) GROUP BY 1""",
)
def q_canonical(spark: SparkSession, sf_dir: str) -> DataFrame:
    """names by canonical form; hyphens and signs stay, spaces, brackets and stops go."""
    k, name = F.col("p_partkey") % 4, F.col("p_name")
    v = F.when(k == 0, F.concat(F.upper(name), F.lit(" (2)"))).when(k == 1, F.concat(name, F.lit("·Ä"))).otherwise(F.concat(F.replace(name, F.lit(" "), F.lit("-")), F.lit(".")))
    return text.canonicalised(table(spark, sf_dir, "part").select(v.alias("v")), "v", "canonical").groupBy("canonical").agg(F.count("*").alias("n"))


@R.add(
    "text_rules",
    r"""
WITH e AS (SELECT event_id, event_id % 11 AS k, value, user_id FROM events),
w AS (SELECT *, CASE k WHEN 0 THEN '' WHEN 1 THEN CAST(value AS VARCHAR) || ' ft' WHEN 2 THEN '0' WHEN 3 THEN ' 1200 m' WHEN 4 THEN NULL ELSE CAST(CAST(round(value * 4) AS BIGINT) AS VARCHAR) || CASE WHEN k % 2 = 0 THEN ' m' ELSE '' END END AS v,
  CASE k WHEN 0 THEN 429 WHEN 1 THEN 403 WHEN 2 THEN 503 WHEN 3 THEN 404 ELSE 200 END AS http, CASE user_id % 9 WHEN 0 THEN 0 WHEN 1 THEN 1 WHEN 2 THEN 2 WHEN 3 THEN 3 WHEN 4 THEN 4 WHEN 5 THEN 401 WHEN 6 THEN 402 WHEN 7 THEN 240 ELSE 77 END AS code FROM e)
SELECT event_id, CASE WHEN regexp_full_match(v, '\s*\d+\s*m?\s*') AND CAST(regexp_extract(v, '\d+') AS DOUBLE) BETWEEN 0.001 AND 1000 THEN CAST(regexp_extract(v, '\d+') AS DOUBLE) END AS width_m,
  CASE WHEN http = 429 THEN 'rate_limit' WHEN http = 403 THEN 'permission' WHEN http = 503 THEN 'upstream_error' WHEN http = 404 THEN 'http_error' WHEN code IN (401, 402) THEN 'rate_limit' WHEN code = 4 THEN 'quota' WHEN code IN (3, 240) THEN 'permission'
    WHEN code = 2 THEN 'parameter_error' WHEN code = 1 THEN 'upstream_error' WHEN code = 77 THEN 'source_error' END AS reason,
  printf('%.1f', round(round(value) / 200 * 100, 1)) || '%' AS share, CASE WHEN round(value) * 400 < 10000 THEN printf('%.0f', round(value) * 400) || ' m²' ELSE printf('%.1f', round(round(value) * 400 / 10000, 1)) || ' ha' END AS area FROM w""",
)
def q_text_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """widths within bounds, reasons behind answers, shares and areas as text."""
    e = table(spark, sf_dir, "events").withColumn("k", F.col("event_id") % 11)
    k, value, u = F.col("k"), F.col("value"), F.col("user_id") % 9
    whole = F.concat(F.round(value * 4).cast("long").cast("string"), F.when(k % 2 == 0, " m").otherwise(""))
    v = F.when(k == 0, "").when(k == 1, F.concat(value.cast("string"), F.lit(" ft"))).when(k == 2, "0").when(k == 3, " 1200 m").when(k == 4, None).otherwise(whole)
    http = F.when(k == 0, 429).when(k == 1, 403).when(k == 2, 503).when(k == 3, 404).otherwise(200)
    code = F.element_at(F.array(*[F.lit(c) for c in (0, 1, 2, 3, 4, 401, 402, 240, 77)]), (u + 1).cast("int"))
    return e.select("event_id", text.width_metres(v).alias("width_m"), text.upstream_reason(http, code).alias("reason"), text.percent_text(F.round(value) / 200).alias("share"), text.area_text(F.round(value) * 400).alias("area"))


@R.add(
    "route_paths",
    """
WITH p AS (SELECT o_orderkey AS id, [o_custkey % 90, o_custkey % 90, o_orderkey % 80, o_orderkey % 80, o_custkey % 90] AS xs FROM orders),
k AS (SELECT id, list_filter(range(1, 6), lambda i: i = 1 OR xs[i] <> xs[i - 1]) AS places, xs FROM p)
SELECT id, len(places) AS points, CAST(list_sum(list_transform(places, lambda i: xs[i])) AS DOUBLE) AS lng_sum, CAST(xs[places[len(places)]] AS DOUBLE) / 2 AS last_lat FROM k""",
)
def q_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """points of a route's path, consecutive repeats left out."""
    o = table(spark, sf_dir, "orders")
    xs = [F.col("o_custkey") % 90, F.col("o_custkey") % 90, F.col("o_orderkey") % 80, F.col("o_orderkey") % 80, F.col("o_custkey") % 90]
    path = F.concat_ws(";", *[F.concat(x.cast("string"), F.lit(","), (x / 2).cast("string")) for x in xs])
    points = o.select(F.col("o_orderkey").alias("id"), text.path_points(path).alias("p"))
    total = F.aggregate("p", F.lit(0.0), lambda s, q: s + q["lng"])
    return points.select("id", F.size("p").cast("long").alias("points"), total.alias("lng_sum"), F.element_at("p", -1)["lat"].alias("last_lat"))


@R.add(
    "frame_shift",
    """
WITH p AS (SELECT id, CASE WHEN id % 10 = 0 THEN -70 ELSE 116 END + x / 100000.0 AS lng, 39 + y / 100000.0 AS lat FROM facilities),
s AS (SELECT *, lng - 105 AS a, lat - 35 AS b, radians(lat) AS r, lng BETWEEN 72.004 AND 137.8347 AS shifted FROM p),
w AS (SELECT *, (20 * sin(6 * a * pi()) + 20 * sin(2 * a * pi())) * 2 / 3 AS both_, 1 - 0.00669342162296594323 * sin(r) ** 2 AS m FROM s),
o AS (SELECT *,
  300 + a + 2 * b + 0.1 * a * a + 0.1 * a * b + 0.1 * sqrt(abs(a)) + both_ + (20 * sin(a * pi()) + 40 * sin(a * pi() / 3)) * 2 / 3 + (150 * sin(a * pi() / 12) + 300 * sin(a * pi() / 30)) * 2 / 3 AS east,
  -100 + 2 * a + 3 * b + 0.2 * b * b + 0.1 * a * b + 0.2 * sqrt(abs(a)) + both_ + (20 * sin(b * pi()) + 40 * sin(b * pi() / 3)) * 2 / 3 + (160 * sin(b * pi() / 12) + 320 * sin(b * pi() / 30)) * 2 / 3 AS north FROM w)
SELECT id, round(CASE WHEN shifted THEN lng + east * 180 / (6378245.0 / sqrt(m) * cos(r) * pi()) ELSE lng END, 7) AS lng, round(CASE WHEN shifted THEN lat + north * 180 / (6378245.0 * (1 - 0.00669342162296594323) / (m * sqrt(m)) * pi()) ELSE lat END, 7) AS lat,
  round(lng, 5) AS back_lng, round(lat, 5) AS back_lat, true AS near_again FROM o""",
    ("facilities",),
)
def q_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Into the shifted frame and back, through the offset frame too; places outside the window pass through."""
    c = F.col
    p = demo(spark, sf_dir, "facilities").select("id", (F.when(c("id") % 10 == 0, -70).otherwise(116) + c("x") / 100000.0).alias("lng"), (39 + c("y") / 100000.0).alias("lat"))
    lng, lat = geo.wgs84_to_gcj02(c("lng"), c("lat"))
    g = p.select("id", "lng", "lat", lng.alias("gx"), lat.alias("gy"))
    back, twice = geo.gcj02_to_wgs84(c("gx"), c("gy")), geo.bd09_to_wgs84(*geo.gcj02_to_bd09(c("gx"), c("gy")))
    # The offset frame and its inverse are each other's to some metres at most (their correction terms do not cancel).
    near = (F.abs(twice[0] - c("lng")) < 2e-5) & (F.abs(twice[1] - c("lat")) < 2e-5)
    return g.select("id", F.round("gx", 7).alias("lng"), F.round("gy", 7).alias("lat"), F.round(back[0], 5).alias("back_lng"), F.round(back[1], 5).alias("back_lat"), near.alias("near_again"))


@R.add(
    "redacted_urls",
    r"""SELECT page_id, regexp_replace(regexp_replace(url || ' key=' || page_id, '(?i)\b(ak|sn|key|token|password|secret)=[^&\s]+', '\1=***', 'g'), '(?i)\bhttps?://[^\s"''<>]+', '<url>', 'g') AS clean FROM pages""",
)
def q_redacted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P5: addresses and keys blanked."""
    pages = table(spark, sf_dir, "pages")
    return pages.select("page_id", text.redact(F.concat("url", F.lit(" key="), F.col("page_id").cast("string"))).alias("clean"))


@R.add(
    "coordinate_validation",
    r"""
WITH e AS (SELECT event_id, CASE event_id % 6 WHEN 0 THEN 'n/a' WHEN 1 THEN CAST(CAST(floor(value) AS BIGINT) AS VARCHAR) || '.' WHEN 2 THEN ' +' || CAST(value AS VARCHAR) WHEN 3 THEN CAST(CAST(floor(value) AS BIGINT) AS VARCHAR) || 'e0' WHEN 4 THEN '.5e2' ELSE CAST(value AS VARCHAR) END AS v FROM events),
f AS (SELECT event_id, trim(v) AS v, regexp_full_match(trim(v), '[+-]?(\d+(\.\d*)?|\.\d+)') AS plain, regexp_full_match(trim(v), '[+-]?(\d+(\.\d*)?|\.\d+)([eE][+-]?\d+)?') AS sci FROM e)
SELECT event_id, CASE WHEN plain AND TRY_CAST(v AS DOUBLE) BETWEEN 5 AND 60 THEN TRY_CAST(v AS DOUBLE) END AS lng, CASE WHEN sci AND TRY_CAST(v AS DOUBLE) BETWEEN 5 AND 60 THEN TRY_CAST(v AS DOUBLE) END AS endpoint FROM f""",
)
def q_coordinates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Decimal (and, for endpoints, scientific) strings inside a range as numbers, all others null."""
    k, value = F.col("event_id") % 6, F.col("value")
    whole = F.floor(value).cast("string")
    v = F.when(k == 0, "n/a").when(k == 1, F.concat(whole, F.lit("."))).when(k == 2, F.concat(F.lit(" +"), value.cast("string"))).when(k == 3, F.concat(whole, F.lit("e0"))).when(k == 4, ".5e2").otherwise(value.cast("string"))
    e = table(spark, sf_dir, "events").select("event_id", v.alias("v"))
    return e.select("event_id", rules.number_text(F.col("v"), 5, 60).alias("lng"), rules.number_text(F.col("v"), 5, 60, scientific=True).alias("endpoint"))


@R.add(
    "formula_escape",
    r"""SELECT event_id, CASE WHEN regexp_matches(c, '^\s*[=+\-@]') THEN '''' || c ELSE c END AS cell FROM (SELECT event_id, CASE event_id % 3 WHEN 0 THEN '=' WHEN 1 THEN ' -' ELSE '' END || props AS c FROM events)""",
)
def q_escape(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells that a spreadsheet would run are defused."""
    lead = F.when(F.col("event_id") % 3 == 0, "=").when(F.col("event_id") % 3 == 1, " -").otherwise("")
    return table(spark, sf_dir, "events").select("event_id", text.escape_formula(F.concat(lead, "props")).alias("cell"))


@R.add(
    "geo_round_trip",
    """SELECT id, round(120 + x / ((6371008.8 * pi() / 180) * cos(radians(30.0))), 6) AS lng, round(30 + y / (6371008.8 * pi() / 180), 6) AS lat FROM (SELECT id, CAST(x AS DOUBLE) AS x, CAST(y AS DOUBLE) AS y FROM facilities)""",
    ("facilities",),
)
def q_geo(spark: SparkSession, sf_dir: str) -> DataFrame:
    """local metres to degrees."""
    lng, lat = geo.from_local(F.col("x"), F.col("y"), F.lit(120.0), F.lit(30.0))
    return demo(spark, sf_dir, "facilities").select("id", lng.alias("lng"), lat.alias("lat"))


@R.add(
    "nearest_by_haversine",
    """
WITH p AS (SELECT id, category, 120 + x / 100000.0 AS lng, 30 + y / 100000.0 AS lat FROM facilities),
d AS (SELECT id, category, 2 * 6371008.8 * asin(least(1.0, sqrt(pow(sin(radians(lat - 30.0) / 2), 2) + cos(radians(30.0)) * cos(radians(lat)) * pow(sin(radians(lng - 120.0) / 2), 2)))) AS m FROM p),
r AS (SELECT *, row_number() OVER (PARTITION BY category ORDER BY m, id) AS n FROM d)
SELECT category, CAST(n AS INTEGER) AS n, id, round(m, 3) AS m FROM r WHERE n <= 5""",
    ("facilities",),
)
def q_haversine(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five nearest facilities of each category from a centre."""
    from pyspark.sql import Window

    p = demo(spark, sf_dir, "facilities").select("id", "category", (120 + F.col("x") / 100000.0).alias("lng"), (30 + F.col("y") / 100000.0).alias("lat"))
    d = p.withColumn("m", geo.haversine(F.lit(120.0), F.lit(30.0), F.col("lng"), F.col("lat")))
    return d.withColumn("n", F.row_number().over(Window.partitionBy("category").orderBy("m", "id"))).filter("n <= 5").select("category", "n", "id", F.round("m", 3).alias("m"))
