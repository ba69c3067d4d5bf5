"""Operator 4: mixing sources to target weights by Pareto order sampling.

A source that is to supply ``target`` words from a stock of ``source_size`` wants each document
``target / source_size`` times: the whole part is taken for certain, and the fraction is the
document's inclusion probability. Documents are ranked by the odds of a uniform number over the
odds of that probability (Pareto order sampling) and taken in that order until the source's words
are reached; the one on the border is taken if more than half of it fits.

The ranking never gathers a source: documents are counted into buckets of their rank, the bucket in
which the border lies is split once more, and only the documents of that last sliver are sorted.

Cases: a null text has size 0, and a document without words is only copied for certain; a null source
is a source of its own, last in order; every row draws for itself, by its doc_id and text, and rows that
are equal in both by their number among their like in the source too; an empty table gives an empty mix;
extra columns pass through whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from footfall.session import checkpointed, table

WEIGHTS, CAP, SEED = (5.0, 2.0, 1.0), 3.0, "mix-1"
#: Buckets of each of the two counting passes.
SLICES = 1024


def word_count(text: Column) -> Column:
    """Number of ``[^\\x20\\x09-\\x0D]+`` in the text; 0 for null."""
    blank = ["\t", "\n", "\x0b", "\x0c", "\r", " "]
    ends = F.substring(text, 1, 1).isin(blank).cast("int") + F.substring(text, -1, 1).isin(blank).cast("int")
    parts = F.size(F.split(text, r"[\x20\x09-\x0D]+")) - ends
    return F.when(F.coalesce(text, F.lit("")) == "", 0).otherwise(parts).cast("long")


def targets(sized: DataFrame, weights: tuple[float, ...] = WEIGHTS, cap: float = CAP) -> DataFrame:
    """``source, source_size, target``: all words shared by the repeating weights, none above ``cap`` times its stock.

    Sharing the excess again and again ends where every source gets the least of its cap and one
    common level times its weight; that level is found from running sums in the order of cap / weight,
    as the greatest that leaves its source within the cap.
    There is one row per source here, so the windows over all of them are small.
    """
    per = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (place % len(weights) + 1).cast("int"))
    per = per.select("*", weight.alias("w"), (F.lit(float(cap)) * F.col("source_size")).alias("most"))
    every = Window.partitionBy()
    order = Window.orderBy(F.col("most") / F.col("w"), F.col("source").asc_nulls_last())
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    per = per.select(
        "*",
        F.sum("source_size").over(every).alias("total"),
        F.coalesce(F.sum("most").over(before), F.lit(0.0)).alias("full"),
        (F.sum("w").over(every) - F.coalesce(F.sum("w").over(before), F.lit(0.0))).alias("open_w"),
    ).withColumn("level", (F.col("total") - F.col("full")) / F.col("open_w"))
    per = per.withColumn("level", F.max(F.when(F.col("level") * F.col("w") <= F.col("most"), F.col("level"))).over(every))
    fair = F.col("level") * F.col("w")
    return per.select("source", "source_size", F.when(fair < F.col("most"), fair).otherwise(F.col("most")).alias("target"))


def _bits(key: Column) -> Column:
    """52 bits of the md5 of a text: the same on every run."""
    return F.conv(F.substring(F.md5(key), 1, 13), 16, 10).cast("long")


def _number(bits: Column) -> Column:
    """52 bits as a number in (0, 1)."""
    return (bits.cast("double") + 0.5) / float(2**52)


#: Sources up to which the table with a row for each is broadcast (some 100 bytes a row); beyond, it is joined by shuffle.
FEW_SOURCES = 100_000


def _by_source(rows: DataFrame, per: DataFrame, few: bool) -> DataFrame:
    """``rows`` with the columns that ``per`` has for their source."""
    per = per.withColumnRenamed("source", "s_")
    return rows.join(F.broadcast(per) if few else per, F.col("source").eqNullSafe(F.col("s_"))).drop("s_")


def _twins(slim: DataFrame) -> DataFrame | None:
    """``place, draw, number`` of the rows that are equal in source, doc_id and text; None if there are none.

    They are numbered within their partition first, so that very many of them gather nowhere. `mixed` reads the
    documents twice: where they do not come in one order both times (as files do), such rows share one draw there.
    """
    like = ["source", "draw"]
    many = checkpointed(slim.groupBy(*like).agg(F.count("*").alias("n_")).filter("n_ > 1"))
    if many.isEmpty():
        return None
    many = many.select(F.col("source").alias("s_"), F.col("draw").alias("d_"))
    some = slim.join(F.broadcast(many) if many.count() <= FEW_SOURCES else many, F.col("source").eqNullSafe(F.col("s_")) & (F.col("draw") == F.col("d_")))
    some = checkpointed(some.select(*like, "place", F.shiftright("place", 33).alias("part")))
    per = some.groupBy(*like, "part").agg(F.count("*").alias("n"))
    before = per.select(*[F.col(c).alias(c + "_") for c in (*like, "part")], (F.sum("n").over(Window.partitionBy(*like).orderBy("part")) - F.col("n")).alias("before"))
    local = some.withColumn("number", F.row_number().over(Window.partitionBy(*like, "part").orderBy("place")))
    on = F.col("source").eqNullSafe(F.col("source_")) & (F.col("draw") == F.col("draw_")) & (F.col("part") == F.col("part_"))
    return checkpointed(local.join(before, on).select("place", "draw", (F.col("before") + F.col("number")).alias("number")))


def _ranked(rows: DataFrame, goal: DataFrame, twins: DataFrame | None, few: bool, cap: float, seed: str, slices: int) -> DataFrame:
    """``rows`` with ``source_size, target``, the certain copies ``base``, and ``b1, b2, key`` that order the sampled ones.

    ``key`` is null where nothing is left to sample.
    """
    out = _by_source(rows, goal.select("source", "source_size", "target", "imp_size"), few)
    bits = F.col("draw")
    if twins is not None:
        out = out.join(twins, ["place", "draw"], "left")
        bits = F.when(F.col("number").isNull(), bits).otherwise(_bits(F.concat(F.lit(seed + ":"), bits.cast("string"), F.lit(":"), F.col("number").cast("string"))))
    out = out.withColumn("want", F.least(F.lit(float(cap)), F.coalesce(F.try_divide(F.col("target") * F.col("imp"), F.col("imp_size")), F.lit(0.0))))
    out = out.withColumn("base", F.floor("want")).withColumn("pi", F.col("want") - F.col("base")).withColumn("u", _number(bits))
    odds = (F.col("u") / (1 - F.col("u"))) / (F.col("pi") / (1 - F.col("pi")))
    out = out.withColumn("key", F.when((F.col("pi") > 0) & (F.col("size") > 0), odds)).withColumn("at", F.col("key") / (1 + F.col("key")) * slices)
    out = out.withColumn("b1", F.floor("at")).withColumn("b2", F.floor((F.col("at") - F.col("b1")) * slices))
    return out.drop("u", "pi", "want", "at", "imp", "imp_size", "draw", "place", "number")


def _border(hist: DataFrame, bucket: str) -> DataFrame:
    """``source, <bucket>_, room_``: the bucket in which the words wanted run out, and what is wanted of it.

    ``hist`` has ``source, <bucket>, size, room``: a fixed number of rows a source at most.
    """
    order = Window.partitionBy("source").orderBy(bucket)
    run = hist.withColumn("upto", F.sum("size").over(order))
    inside = (F.col("upto") > F.col("room")) & (F.col("upto") - F.col("size") <= F.greatest("room", F.lit(0.0)))
    return run.filter(inside).groupBy("source").agg(F.min(bucket).alias(bucket + "_"), F.min_by(F.col("room") - (F.col("upto") - F.col("size")), bucket).alias("room_"))


def plan(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, cap: float = CAP, seed: str = SEED, importance: str | None = None, slices: int = SLICES) -> tuple[DataFrame, DataFrame, DataFrame | None]:
    """(every row's size and rank without its text, per source its target and the place of its border, and `_twins`)."""
    slim = checkpointed(_sized(docs, importance, seed).drop("row"))
    goal = targets(slim, weights, cap).withColumnRenamed("source", "g_")
    per = slim.groupBy("source").agg(F.sum(F.col("imp") * F.col("size")).alias("imp_size"))
    goal = checkpointed(per.join(goal, F.col("source").eqNullSafe(F.col("g_"))).drop("g_"))
    few = goal.count() <= FEW_SOURCES
    twins = _twins(slim)
    ranked = checkpointed(_ranked(slim, goal, twins, few, cap, seed, slices))

    sums = ranked.groupBy("source", "b1").agg(F.sum("size").alias("size"), F.sum(F.col("base") * F.col("size")).alias("sure"), F.max("target").alias("target"))
    room = F.col("target") - F.sum("sure").over(Window.partitionBy("source"))
    first = checkpointed(_border(sums.withColumn("room", room).filter("b1 IS NOT NULL"), "b1"))

    inner = _by_source(ranked.select("source", "doc_id", "size", "key", "b1", "b2"), first, few).filter("b1 = b1_")
    hist = inner.groupBy("source", "b2").agg(F.sum("size").alias("size"), F.first("room_").alias("room"))
    second = checkpointed(_border(hist, "b2"))

    sliver = _by_source(inner.drop("room_"), second, few).filter("b2 = b2_").groupBy("source", "key", "doc_id").agg(F.sum("size").alias("size"), F.first("room_").alias("room"))
    upto = F.sum("size").over(Window.partitionBy("source").orderBy("key", "doc_id").rowsBetween(Window.unboundedPreceding, 0))
    taken = sliver.withColumn("upto", upto).filter(2 * F.col("upto") - F.col("size") <= 2 * F.col("room"))
    last = taken.groupBy("source").agg(F.max(F.struct("key", "doc_id")).alias("last"))
    for part in (first.select("source", "b1_"), second.select("source", "b2_"), last):
        part = part.withColumnRenamed("source", "s_")
        goal = goal.join(part, F.col("source").eqNullSafe(F.col("s_")), "left").drop("s_")
    return ranked, checkpointed(goal), twins


def _sized(docs: DataFrame, importance: str | None, seed: str) -> DataFrame:
    """``row, doc_id, source, size, imp, draw, place``: the whole row beside what the mix goes by."""
    rate = F.coalesce(F.greatest(F.col(importance).cast("double"), F.lit(0.0)), F.lit(0.0)) if importance else F.lit(1.0)
    text, doc_id = F.col("text").cast("string"), F.col("doc_id").cast("long")
    own = F.concat(F.lit(seed + ":"), F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"), F.md5(F.coalesce(text, F.lit(""))))
    return docs.select(F.struct("*").alias("row"), doc_id.alias("doc_id"), F.col("source").cast("string").alias("source"), word_count(text).alias("size"), rate.alias("imp"), _bits(own).alias("draw"), F.monotonically_increasing_id().alias("place"))


def decide(ranked: DataFrame, goal: DataFrame, slices: int = SLICES) -> DataFrame:
    """Ranked rows with ``copies``, by the border of their source alone."""
    place = F.struct(F.col("b1"), F.col("b2"), F.col("key"), F.col("doc_id"))
    border = F.struct(
        # No border: everything that can be sampled fits.
        F.coalesce("b1_", F.lit(slices + 1)).cast("long").alias("b1"),
        F.coalesce("b2_", F.lit(-1)).cast("long").alias("b2"),
        F.coalesce("last.key", F.lit(-1.0)).alias("key"),
        F.col("last.doc_id").alias("doc_id"),
    )
    out = _by_source(ranked, goal.select("source", border.alias("border")), goal.count() <= FEW_SOURCES)
    extra = F.when(F.col("key").isNotNull() & (place <= F.col("border")), 1).otherwise(0)
    return out.withColumn("copies", (F.col("base") + extra).cast("long")).drop("base", "key", "b1", "b2", "border")


def mixed(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, cap: float = CAP, seed: str = SEED, importance: str | None = None, slices: int = SLICES) -> DataFrame:
    """The mix itself: the rows of ``docs``, each as often as it is taken."""
    _, goal, twins = plan(docs, weights, cap, seed, importance, slices)
    ranked = _ranked(_sized(docs, importance, seed), goal, twins, goal.count() <= FEW_SOURCES, cap, seed, slices)
    chosen = decide(ranked, goal, slices).filter("copies > 0")
    return chosen.select("row", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies")))).select("row.*")


def op4_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many words the mix takes of every document."""
    ranked, goal, _ = plan(table(spark, sf_dir, "documents"))
    return decide(ranked, goal).select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


QUERIES = {"op4_mix_sources": op4_mix_sources}
SQL = {
    "op4_mix_sources": r"""
WITH s AS (
  SELECT doc_id, source, md5(coalesce(text, '')) AS h, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size FROM documents
), p AS (
  SELECT source, CAST(sum(size) AS DOUBLE) AS source_size, 3.0 * CAST(sum(size) AS DOUBLE) AS most FROM s GROUP BY source
), w AS (
  SELECT *, CAST([5, 2, 1][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3] AS DOUBLE) AS w FROM p
), l AS (
  SELECT *, (sum(source_size) OVER () - coalesce(sum(most) OVER b, 0.0)) / (sum(w) OVER () - coalesce(sum(w) OVER b, 0.0)) AS lvl FROM w
  WINDOW b AS (ORDER BY most / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), t AS (
  SELECT source, source_size, most, least(most, w * (SELECT max(lvl) FROM l WHERE lvl * w <= most)) AS target FROM l
), e AS (
  SELECT s.doc_id, s.source, s.size, s.h, t.source_size, t.target, t.target * 1.0 / t.source_size AS want,
    (CAST(('0x' || substr(md5('mix-1:' || coalesce(CAST(doc_id AS VARCHAR), '') || ':' || h), 1, 13)) AS BIGINT) + 0.5::DOUBLE) / 4503599627370496.0::DOUBLE AS u
  FROM s JOIN t ON s.source IS NOT DISTINCT FROM t.source
), f AS (
  SELECT *, coalesce(floor(want), 0) AS base, want - floor(want) AS pi FROM e
), o AS (
  SELECT *, CASE WHEN pi > 0 AND size > 0 THEN (u / (1 - u)) / (pi / (1 - pi)) END AS k,
    target - sum(base * size) OVER (PARTITION BY source) AS room FROM f
), c AS (
  SELECT *, sum(CASE WHEN k IS NOT NULL THEN size ELSE 0 END) OVER (PARTITION BY source ORDER BY k NULLS LAST, doc_id ROWS UNBOUNDED PRECEDING) AS upto FROM o
)
SELECT doc_id, CAST(size AS BIGINT) AS size, CAST(source_size AS BIGINT) AS source_size, target,
  CAST((base + CASE WHEN k IS NOT NULL AND 2 * upto - size <= 2 * room THEN 1 ELSE 0 END) * size AS BIGINT) AS taken
FROM c"""
}
