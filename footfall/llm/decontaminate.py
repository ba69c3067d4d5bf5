"""Operator 2: benchmark decontamination by size-partitioned MinHash containment search.

Words are runs of letters and digits in lower case; a shingle is five of them in a row, and an item of
fewer words is one shingle, its whole word sequence. A document is contaminated by an item if it holds at
least ``threshold`` of the item's distinct shingles.

Items are partitioned by size (classes of doubling shingle counts). An item's sketch is its bottom MinHash
values, ``floor((1 - threshold) * u) + 1`` of them for a class of sizes up to ``u``: a document with the
threshold's share of an item misses at most the others, so it holds at least one value of the sketch, and
the search loses nothing. It is the items that are sketched, since an item is a short passage inside a long
document whose own least hashes would tell nothing of it: every shingle hash of a document is looked up
in the sketches, and those that meet one are verified on the shingles' words. Items with equal words
count as one, under the least item_id.

Only DataFrame operations are used. Sketches and item shingles are broadcast while they are few
(``FEW`` rows, counted first), else joined by shuffle.

Cases: an item without a word matches nothing; null texts hold no shingle; every distinct text under a
doc_id (or under none) is judged by itself, so shingles of several rows never add up to a hit; repeated
items and documents change nothing; empty tables give an empty result; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from footfall.session import checkpointed, table

SHINGLE, THRESHOLD = 5, 0.8
#: Rows of (hash, item) or of (shingle, item) up to which a side is broadcast: about 100 bytes each.
FEW = 200_000


def words(text: Column) -> Column:
    """Lower-case runs of letters and digits."""
    return F.filter(F.split(F.lower(F.coalesce(text.cast("string"), F.lit(""))), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def _few(df: DataFrame, limit: int) -> DataFrame:
    return F.broadcast(df) if df.count() <= limit else df


def _shingled(df: DataFrame, keep: list[str], width: int) -> DataFrame:
    """``keep`` and ``w, p``: one row per position at which a shingle of ``width`` words starts."""
    split = df.select(*keep, words(F.col("text")).alias("w")).withColumn("n", F.size("w") - (width - 1))
    return split.filter("n > 0").select(*keep, "w", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("p"))


def _hash(width: int) -> Column:
    return F.xxhash64(*[F.get("w", F.col("p") + i) for i in range(width)])


def _text(width: int) -> Column:
    return F.concat_ws(" ", *[F.get("w", F.col("p") + i) for i in range(width)])


def _of_widths(df: DataFrame, keep: list[str], widths: list[int], *more) -> DataFrame:
    """``keep`` and a column of each of ``more`` (functions of a width) for the shingles of all ``widths``."""
    parts = [_shingled(df, keep, n).select(*keep, F.lit(n).alias("width"), *[f(n).alias(name) for name, f in more]) for n in widths]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def item_shingles(items: DataFrame, width: int = SHINGLE) -> DataFrame:
    """``item_id, width, h, shingle, q``: the distinct shingles of each class of equal items and their number."""
    named = items.select(F.col("item_id").cast("long").alias("item_id"), words(F.col("text")).alias("w")).filter(F.size("w") > 0)
    one = named.groupBy(F.concat_ws(" ", "w").alias("text")).agg(F.min("item_id").alias("item_id"))
    sized = one.select("item_id", "text", F.least(F.size(F.split("text", " ")), F.lit(width)).alias("own"))
    rows = _of_widths(sized, ["item_id", "own"], list(range(1, width + 1)), ("h", _hash), ("shingle", _text)).filter("width = own").drop("own").distinct()
    size = rows.groupBy("item_id").agg(F.count("*").alias("q"))
    return rows.join(size, "item_id")


def sketches(shingles: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``h, item_id``: the least hashes of each item, as many as its size class asks for."""
    upper = F.pow(F.lit(2.0), F.floor(F.log2("q")) + 1) - 1
    least = F.floor((1 - threshold) * upper + 1e-9) + 1
    per = shingles.groupBy("item_id").agg(F.sort_array(F.collect_set("h")).alias("hs"), F.first("q").alias("q"))
    return per.select("item_id", F.explode(F.slice("hs", F.lit(1), least.cast("int"))).alias("h"))


def _hits(docs: DataFrame, items: DataFrame, width: int, threshold: float, few: int) -> DataFrame:
    """``rid, item_id, shared, q`` over rows of ``rid, text``."""
    shingles = checkpointed(item_shingles(items, width))
    widths = sorted(r.width for r in shingles.select("width").distinct().collect()) or [width]  # five at most
    sketch = _few(sketches(shingles, threshold).select("h").distinct(), few)
    met = checkpointed(_of_widths(docs, ["rid"], widths, ("h", _hash)).join(sketch, "h").select("rid").distinct())
    suspects = docs.join(_few(met, 10 * few), "rid", "left_semi").dropDuplicates(["rid"])
    held = _of_widths(suspects, ["rid"], widths, ("shingle", _text)).drop("width")
    pairs = held.join(_few(shingles.select("item_id", "shingle", "q"), few), "shingle").groupBy("rid", "item_id", "q").agg(F.countDistinct("shingle").alias("shared"))
    return pairs.filter(F.col("shared") >= F.ceil(threshold * F.col("q") - 1e-9))


def _row_id(doc_id: str = "doc_id", text: str = "text") -> Column:
    """The identity of a text under its doc_id."""
    return F.struct(F.col(doc_id).cast("long").alias("d"), F.xxhash64(F.col(text).cast("string")).alias("t"))


def contaminated(docs: DataFrame, items: DataFrame, width: int = SHINGLE, threshold: float = THRESHOLD, few: int = FEW) -> DataFrame:
    """``doc_id, item_id, shared, item_size, containment`` for every document and class of equal items at the threshold.

    Of several texts under one doc_id the one that holds most of an item speaks for it.
    """
    rows = docs.select(_row_id().alias("rid"), F.col("text").cast("string").alias("text"))
    best = _hits(rows, items, width, threshold, few).groupBy(F.col("rid.d").alias("doc_id"), "item_id", "q").agg(F.max("shared").alias("shared"))
    return best.select("doc_id", "item_id", "shared", F.col("q").alias("item_size"), (F.col("shared") / F.col("q")).alias("containment"))


def clean(docs: DataFrame, items: DataFrame, width: int = SHINGLE, threshold: float = THRESHOLD, few: int = FEW) -> DataFrame:
    """The rows of ``docs`` whose own text holds no item at the threshold."""
    rows = docs.select(_row_id().alias("rid"), F.col("text").cast("string").alias("text"))
    hits = checkpointed(_hits(rows, items, width, threshold, few).select(F.col("rid.t").alias("t"), F.lit(True).alias("hit")).distinct())
    # A text is contaminated whatever row it stands in, so its hash alone decides.
    packed = docs.select(F.struct(*[f"`{c}`" for c in docs.columns]).alias("row"), F.xxhash64(F.col("text").cast("string")).alias("t"))
    return packed.join(_few(hits.select("t"), 10 * few), "t", "left_anti").select("row.*")


def op2_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold at least 0.8 of the five-word shingles of a benchmark item."""
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES = {"op2_benchmark_decontamination": op2_benchmark_decontamination}
SQL = {
    "op2_benchmark_decontamination": r"""
WITH i AS (
  SELECT min(item_id) AS item_id, w, least(len(w), 5) AS k FROM (
    SELECT item_id, regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}]+') AS w FROM benchmark) WHERE len(w) > 0 GROUP BY w
), si AS (
  SELECT DISTINCT item_id, k, array_to_string(w[p:p + k - 1], ' ') AS shingle FROM i, unnest(range(1, len(w) - k + 2)) AS r(p)
), q AS (
  SELECT item_id, count(*) AS q FROM si GROUP BY item_id
), d AS (
  SELECT doc_id, text, regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}]+') AS w FROM documents
), sd AS (
  SELECT DISTINCT doc_id, text, array_to_string(w[p:p + k - 1], ' ') AS shingle FROM d, (SELECT DISTINCT k FROM si), unnest(range(1, len(w) - k + 2)) AS r(p)
), m AS (
  SELECT doc_id, item_id, max(shared) AS shared FROM (
    SELECT doc_id, text, item_id, count(*) AS shared FROM sd JOIN si USING (shingle) GROUP BY doc_id, text, item_id) GROUP BY doc_id, item_id
)
SELECT doc_id, item_id, shared, q AS item_size, shared / q AS containment
FROM m JOIN q USING (item_id) WHERE shared >= ceil(0.8 * q - 1e-9)"""
}
