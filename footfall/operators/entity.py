"""Facility records: classification, deduplication, merging, possible duplicates."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from footfall.functions.text import canonicalised, numbered_gate
from footfall.functions.text import tags as split_tags
from footfall.operators.components import connected_components
from footfall.operators.nearby import within_radius


def rule_classifier(rows: DataFrame, rules: list[dict], excluded: list[str], review: list[str], conflicting: list[str], parents: list[str] = [], name: str = "name", tags: str = "tags") -> DataFrame:  # noqa: B006
    """``rows`` with ``category, status, evidence``.

    Steps in order: excluded words, words under review, name hits and tag hits less each category's own
    excludes, negative categories, conflicting tags, priority between several hits, and acceptance only
    with tag evidence. ``rules`` is a dictionary of a fixed size (``key, names, tags, excludes, priority,
    negative``) that becomes literals, so the classification is one projection without a join. A tag may name
    several parts; tags in ``parents`` say nothing of the business, so excluded words in them are passed over.
    """
    rows = rows.withColumn("p_", F.array_distinct(F.flatten(F.transform(F.coalesce(F.col(tags), F.array().cast("array<string>")), split_tags))))
    n, t, given = F.col(name), F.col("p_"), F.col(tags)

    def any_in(text: Column, words: list[str]) -> Column:
        out = F.lit(False)
        for w in words:
            out = out | F.contains(text, F.lit(w))
        return out

    def lit_array(words: list[str]) -> Column:
        return F.array(*[F.lit(w) for w in words]).cast("array<string>")

    by_name, by_tag = [], []
    for r in rules:
        barred = any_in(n, r["excludes"]) | F.arrays_overlap(t, lit_array(r["excludes"])) if r["excludes"] else F.lit(False)
        by_name.append(F.when(any_in(n, r["names"]) & ~barred, r["key"]))
        by_tag.append(F.when(F.arrays_overlap(t, lit_array(r["tags"])) & ~barred, r["key"]))
    named, tagged = F.array_compact(F.array(*by_name)), F.array_compact(F.array(*by_tag))
    out = rows.withColumn("n_", named).withColumn("t_", tagged).withColumn("m_", F.array_sort(F.array_union("n_", "t_")))
    rank = F.create_map(*[x for r in rules for x in (F.lit(r["key"]), F.lit(r["priority"]))])
    tops = F.filter("m_", lambda k: F.element_at(rank, k) == F.array_max(F.transform("m_", lambda j: F.element_at(rank, j))))
    out = out.withColumn("top_", tops)
    negative = F.arrays_overlap("m_", lit_array([r["key"] for r in rules if r["negative"]]))
    full = F.concat_ws(" ", n, F.concat_ws(" ", given))
    business = F.array_except(t, lit_array(parents)) if parents else t
    bad = any_in(n, excluded) | F.exists(business, lambda x: any_in(x, excluded)) | numbered_gate(n)
    status = (
        F.when(bad, "excluded").when(any_in(full, review), "needs_review").when(negative, "excluded")
        .when(F.arrays_overlap(t, lit_array(conflicting)) | (F.size("top_") > 1), "needs_review")
        .when((F.size("top_") == 1) & F.array_contains("t_", F.get("top_", F.lit(0))), "accepted").otherwise("needs_review")
    )
    out = out.withColumn("status", status)
    evidence = F.concat(F.transform(F.array_sort("n_"), lambda k: F.concat(F.lit("name:"), k)), F.transform(F.array_sort("t_"), lambda k: F.concat(F.lit("tag:"), k)))
    return out.withColumn("category", F.when(F.col("status") == "accepted", F.get("top_", F.lit(0)))).withColumn("evidence", evidence).drop("n_", "t_", "m_", "top_", "p_")


def keyword_classifier(rows: DataFrame, id_: str, text: str, words: list[dict], exclusions: list[str] = [], shadowed: dict[str, str] = {}) -> DataFrame:  # noqa: B006
    """``id, category, keyword, negative, confidence`` of every row by the words of its text.

    ``words`` is a dictionary of a fixed size (``key, include, exclude, priority, negative, gated``), so each category
    becomes one expression. Gated ones are passed over; a category's own ``exclude`` words bar it; a ``shadowed``
    category gives way to its winner. Priority decides, then the longer keyword, then the key; confidence grows with
    the keyword's length up to four signs. ``exclusions`` rule a row out altogether.
    """
    t = F.col(text)

    def any_in(many: list[str]) -> Column:
        out = F.lit(False)
        for w in many:
            out = out | F.contains(t, F.lit(w))
        return out

    hits = []
    for c in (c for c in words if not c.get("gated")):
        ordered = sorted(c["include"], key=lambda w: (-len(w), w))
        best = F.coalesce(*[F.when(F.contains(t, F.lit(w)), w) for w in ordered])
        barred = any_in(c.get("exclude", [])) | any_in([w for x in words if x["key"] == shadowed.get(c["key"]) for w in x["include"]])
        place = F.struct(F.lit(-c.get("priority", 0)).alias("p"), (-F.length(best)).alias("l"), F.lit(c["key"]).alias("key"), best.alias("word"), F.lit(bool(c.get("negative"))).alias("negative"))
        hits.append(F.when(best.isNotNull() & ~barred, place))
    found = F.array_compact(F.array(*hits))
    out = rows.select(id_, F.when(~any_in(exclusions), F.array_min(found)).alias("b"))
    category = F.when(~F.col("b.negative"), F.col("b.key"))
    return out.select(id_, category.alias("category"), F.col("b.word").alias("keyword"), F.coalesce("b.negative", F.lit(False)).alias("negative"), F.when(F.col("b.word").isNull(), 0.0).otherwise(F.least(F.lit(1.0), F.length("b.word") / 4.0)).alias("confidence"))


def display_counts(lookup: DataFrame, facilities: DataFrame, minor: str, category: str, id_: str) -> DataFrame:
    """C4, A2: distinct facilities by major and display group of the ``lookup`` (``minor, major, display``), zeros included."""
    per = facilities.select(F.col(category).alias(minor), id_).distinct()
    return lookup.join(per, minor, "left").select("major", "display", id_).distinct().groupBy("major", "display").agg(F.count(id_).alias("facilities"))


def retrieval_statistics(rows: DataFrame, id_: str, outside: Column, invalid: Column, page: list[str]) -> DataFrame:
    """One row: raw, merged, outside, invalid and accepted records, and the pages they came on."""
    marks = rows.select(id_, *page, outside.alias("outside"), invalid.alias("invalid"))
    per = marks.groupBy(id_).agg(F.count("*").alias("n"), F.count_if("outside").alias("out"), F.count_if("invalid").alias("bad"), F.bool_or(~F.col("outside") & ~F.col("invalid")).alias("ok"))
    sums = per.agg(F.sum("n").alias("raw_rows"), F.count("*").alias("merged"), F.sum("out").alias("outside"), F.sum("bad").alias("invalid"), F.count_if("ok").alias("accepted"))
    return sums.crossJoin(marks.select(*page).distinct().agg(F.count("*").alias("pages")))  # one row each


def source_attribution(rows: DataFrame, source: str, page: str, live: Column, obtained: str) -> DataFrame:
    """A4: pages, live pages and the first sight of every source."""
    per = rows.groupBy(source, page).agg(F.count_if(live).alias("live"), F.min(obtained).alias("first"))
    return per.groupBy(F.col(source).alias("source")).agg(F.count("*").alias("pages"), F.sum("live").alias("live"), F.min("first").alias("first_seen"))


def split_by_reason(rows: DataFrame, **tests: Column) -> DataFrame:
    """``rows`` with ``reason``, the first test that holds; ``accepted`` if none does. Nothing is left out."""
    reason = None
    for name, test in tests.items():
        hit = F.coalesce(test, F.lit(False))
        reason = F.when(hit, name) if reason is None else reason.when(hit, name)
    return rows.withColumn("reason", reason.otherwise("accepted"))


def review_sample(rows: DataFrame, category: str, id_: str, per_category: int = 15, always: Column | None = None) -> DataFrame:
    """The first so many of every category by the sha256 of their id, and all rows that ``always`` names, once each."""
    draw = F.sha2(F.col(id_).cast("string"), 256)
    ranked = rows.withColumn("n", F.row_number().over(Window.partitionBy(category).orderBy(draw, id_)).cast("long"))
    return ranked.filter((F.col("n") <= per_category) | F.coalesce(always, F.lit(False)) if always is not None else F.col("n") <= per_category)


def search_plan(domain: DataFrame, x: str, y: str, tile: float, categories: DataFrame, keywords: list[str]) -> DataFrame:
    """Tiles of the domain x categories x keywords. Tiles and categories are counted first; the plan is their product by design."""
    tiles = domain.groupBy(F.floor(F.col(x) / tile).alias("tx"), F.floor(F.col(y) / tile).alias("ty")).agg(F.count("*").alias("n"))
    terms = categories.distinct().withColumn("keyword", F.explode(F.array(*[F.lit(k) for k in keywords])))
    per = terms.agg(F.collect_list(F.struct(*terms.columns)).alias("terms"))  # the dictionary: some dozens of rows
    return tiles.crossJoin(F.broadcast(per)).select("tx", "ty", F.explode("terms").alias("t"), "n").select("tx", "ty", "t.*", "n")


def coarse_plan(domain: DataFrame, x: str, y: str, categories: DataFrame) -> DataFrame:
    """The quarters (around the centre) that meet the domain, each with every category."""
    met = domain.select(F.when(F.col(x) >= 0, 1).otherwise(0).alias("bx"), F.when(F.col(y) >= 0, 1).otherwise(0).alias("by_")).distinct()  # four rows at most
    return categories.distinct().crossJoin(F.broadcast(met)).select("bx", "by_", *categories.columns)


def compare_arms(baseline: DataFrame, arm: DataFrame, id_: str, category: str) -> DataFrame:
    """Entities of a category that an arm misses, adds and shares, and its recall."""
    one = lambda df, flag: df.select(id_, category).distinct().withColumn(flag, F.lit(1))
    both = one(baseline, "b_").join(one(arm, "a_"), [id_, category], "full")
    shared = F.count_if(F.col("a_").isNotNull() & F.col("b_").isNotNull())
    return both.groupBy(category).agg(
        F.count_if(F.col("a_").isNull()).alias("missing"), F.count_if(F.col("b_").isNull()).alias("added"), shared.alias("both_"), F.round(shared / F.nullif(F.count("b_"), F.lit(0)).cast("double"), 9).alias("recall")
    ).withColumnRenamed(category, "category")


def requested_categories(requested: DataFrame, core: DataFrame, category: str) -> DataFrame:
    """Distinct categories by side: requested alone, or core as well."""
    marks = requested.select(category).distinct().join(core.select(category).distinct().withColumn("c_", F.lit(1)), category, "left")
    return marks.select(F.when(F.col("c_").isNull(), "requested_only").otherwise("both").alias("side"), F.col(category).alias("category"))


def keep_best(rows: DataFrame, key: Column, completeness: Column, ties: list[str]) -> DataFrame:
    """The most complete row of every key, with the number of rows it stands for."""
    w = Window.partitionBy("key_")
    order = w.orderBy(F.desc("score_"), *ties)
    keyed = rows.withColumn("key_", key).withColumn("score_", completeness)
    return keyed.withColumn("n_", F.row_number().over(order)).withColumn("copies", F.count("*").over(w)).filter("n_ = 1").drop("n_", "key_", "score_")


def merge_entities(rows: DataFrame, classify: Callable[[DataFrame], DataFrame], requested: list[str], counted: Column, uid: str = "uid") -> DataFrame:
    """A1: one row per uid: ``observations, names, tags, conflicts, category, status, evidence, outside, first_seq``.

    ``rows`` has ``uid, name, address, parent, tag, x, y, seq``; null and empty fields say nothing. ``classify`` adds ``category,
    status, evidence`` to rows of ``name, tags`` (as `rule_classifier` does): it judges every record, and once more the entity
    by all its names and tags. Two places, or two canonical names, addresses or parents of one uid are a conflict, and so
    is a record that is excluded beside one that is not; an entity with a conflict needs review. One that is accepted
    in a category that was not requested is excluded. ``outside`` says that no record is ``counted``.

    Conflicts are told by least and greatest values, so a uid with very many records is combined on the map side.
    """
    fields = ("name", "address", "parent")
    slim = rows.groupBy(uid, *fields, "tag", "x", "y").agg(F.count("*").alias("n"), F.min("seq").alias("seq"), F.bool_or(counted).alias("in_"))
    judged = classify(slim.select(uid, *fields, "x", "y", "n", "seq", "in_", "tag", F.when(F.col("tag") != "", F.array("tag")).otherwise(F.array().cast("array<string>")).alias("tags")))
    excluded = F.col("status") == "excluded"
    per = judged.groupBy(uid).agg(
        F.sum("n").alias("observations"), F.array_sort(F.collect_set("name")).alias("names"), F.array_sort(F.collect_set(F.when(F.col("tag") != "", F.col("tag")))).alias("tags"),
        F.min("seq").alias("first_seq"), (~F.bool_or(F.coalesce("in_", F.lit(False)))).alias("outside"),
        ((F.min("x") != F.max("x")) | (F.min("y") != F.max("y"))).alias("location"), (F.bool_or(excluded) & F.bool_or(~excluded)).alias("classification"),
    )
    long = slim.select(uid, F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).alias("value")) for f in fields])).alias("v")).select(uid, "v.field", "v.value").filter("value <> ''").distinct()
    differ = canonicalised(long, "value", "c_").groupBy(uid, "field").agg((F.min("c_") != F.max("c_")).alias("differ")).filter("differ").groupBy(uid).agg(F.collect_set("field").alias("fields"))
    both = per.join(differ, uid, "left")
    named = [F.when(F.array_contains("fields", f), f"uid_{f}_conflict") for f in fields]
    conflicts = F.array_compact(F.array(F.when(F.col("location"), "uid_location_conflict"), *named, F.when(F.col("classification"), "uid_classification_conflict")))
    whole = classify(both.withColumn("conflicts", conflicts).drop("location", "classification", "fields").withColumn("name", F.concat_ws(" / ", "names")))
    odd = F.size("conflicts") > 0
    unasked = ~odd & (F.col("status") == "accepted") & ~F.coalesce(F.col("category").isin(*requested), F.lit(False))
    status = F.when(odd, "needs_review").when(unasked, "excluded").otherwise(F.col("status"))
    evidence = F.when(unasked, F.array(F.lit("category_not_requested"))).otherwise(F.array_sort(F.array_distinct(F.concat("evidence", "conflicts"))))
    return whole.select(uid, "observations", "names", "tags", "conflicts", F.when(~odd & ~unasked, F.col("category")).alias("category"), status.alias("status"), evidence.alias("evidence"), "outside", "first_seq")


def possible_duplicates(rows: DataFrame, radius: float = 20.0, id_: str = "id", name: str = "name", address: str = "address") -> DataFrame:
    """``id, group_id``: records with one canonical name and one canonical address within ``radius`` of each other, transitively.

    A record without an address (null or white space) is in no group: a chain has branches everywhere. Records
    of one name and address on one spot hang on the least of them, so only spots are compared with each other.
    """
    slim = canonicalised(canonicalised(rows.select(id_, "x", "y", name, address), name, "name_"), address, "address_")
    named = slim.filter(F.col("name_").isNotNull() & F.col(address).rlike(r"\S")).select(id_, "x", "y", "name_", "address_")
    same = ["name_", "address_"]
    spots = named.groupBy(*same, "x", "y").agg(F.min(id_).alias("spot"))
    own = named.join(spots, [*same, "x", "y"]).filter(F.col(id_) != F.col("spot")).select(F.col(id_).alias("src"), F.col("spot").alias("dst"))
    pairs = within_radius(spots, spots, radius, on=tuple(same)).filter(F.col("spot") < F.col("r_spot")).select(F.col("spot").alias("src"), F.col("r_spot").alias("dst"))
    return connected_components(own.unionByName(pairs)).select(F.col("node").alias(id_), F.col("component").alias("group_id"))
