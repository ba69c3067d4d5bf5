"""Operator 12: spelling variants through a relational trie frontier.

The words are a trie kept as a table: a row per node with its parent, the letter between them, whether a
word ends in it, and a bit mask of the letters that go on from it. A search state is (word, position,
node, edits). States of one depth are joined with the edges of that depth, and depth follows depth: a
state without an edit takes the word's own letter, or spends its edit on another letter (read in place of
the word's, or before it); a state with an edit takes the word's letters alone. The mask drops a state
whose next letter leads nowhere before it is written. A state with one edit that has read its word in a
node where a word ends names a neighbour.

A pair differs in one place, so one half of the shorter word is the same in both. Searches therefore
start in the node of a word's first half, in the trie of words and in the trie of reversed words, and the
words from which a letter is struck are found from the shorter side; no pair is lost. Words of over
``LONGEST`` letters would make deep tries, so their pairs are met by the hashes of the words without one
letter and compared letter by letter; a key holds no more words than there are letters.

Cases: null and empty texts hold no words; a null doc_id counts as empty text before the colon; rows that
repeat an id and a text count again; words of any length are taken; a table without words gives no rows;
of several near words with the largest count the least by code point is the form; extra columns are
ignored.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from footfall.session import checkpointed, delete_path, shared_dir, table

LEAST_LETTERS, LEAST_COUNT, RATIO, TYPO = 7, 2, 10, 31
#: Words of more letters meet by hashes instead of in the trie.
LONGEST = 64
RUN = "[A-Za-zÀ-ÿ]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_BASE, _PRIME = 1_000_003, 2**61 - 1


def word_counts(docs: DataFrame, least_letters: int = LEAST_LETTERS, least_count: int = LEAST_COUNT, typo: int = TYPO) -> DataFrame:
    """``word, n``: the letter runs of all texts, lower-cased, every ``typo``-th (by crc32) short of a letter."""
    runs = F.filter(F.regexp_extract_all(F.col("text").cast("string"), F.lit(RUN), 0), lambda w: F.length(w) >= least_letters)
    low = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("d"), F.explode(runs).alias("w")).select("d", F.translate("w", UPPER, LOWER).alias("w"))
    hashed = low.select("w", F.crc32(F.concat("d", F.lit(":"), "w").cast("binary")).alias("h"))
    at = F.pmod("h", F.length("w")).cast("int")
    struck = F.concat(F.substring("w", F.lit(1), at), F.substring("w", at + 2, F.length("w")))
    words = hashed.select(F.when(F.col("h") % typo == 0, struck).otherwise(F.col("w")).alias("word")).filter(F.length("word") >= least_letters)
    return words.groupBy("word").agg(F.count("*").alias("n")).filter(F.col("n") >= least_count)


def _letter(word: Column, at: Column) -> Column:
    """Number of the letter at a position (from 0): a to z, then U+00C0 to U+00FF."""
    code = F.ascii(F.substring(word, at + 1, F.lit(1)))
    return F.when(code < 128, code - 97).otherwise(code - 166)


#: Bit of the high mask for "a word ends here"; letters 0 to 44 are in the low mask, the rest in the high one.
HALF, ENDS = 45, 1 << 45


def _bits(letter: Column) -> tuple[Column, Column]:
    """The letter's bit in the low and in the high mask."""
    one, none = F.lit(1).cast("long"), F.lit(0).cast("long")
    low = F.when(letter < HALF, F.call_function("shiftleft", one, letter)).otherwise(none)
    return low, F.when(letter >= HALF, F.call_function("shiftleft", one, letter - HALF)).otherwise(none)


def _both_ways(words: DataFrame) -> DataFrame:
    """``way, word, m``: each word as it is read forwards and backwards."""
    ways = F.explode(F.array(F.struct(F.lit(0).alias("way"), F.col("word").alias("word")), F.struct(F.lit(1).alias("way"), F.reverse("word").alias("word"))))
    return words.select(ways.alias("r")).select("r.*", F.length("r.word").alias("m"))


def _edges(read: DataFrame) -> DataFrame:
    """``depth, way, node, letter, child, low, high``: the part of both tries that searches can reach."""
    steps = F.sequence(F.floor((F.col("m") - 1) / 2).cast("int") + 1, F.col("m"))
    rows = read.select("way", "word", "m", F.explode(steps).alias("d"))
    low, high = _bits(_letter(F.col("word"), F.col("d")))
    on = F.col("d") < F.col("m")
    rows = rows.select(
        "way", "d", F.substring("word", F.lit(1), F.col("d")).alias("child"),
        F.when(on, low).otherwise(F.lit(0).cast("long")).alias("low"), F.when(on, high).otherwise(F.lit(ENDS)).alias("high"),
    )
    nodes = rows.groupBy("way", "d", "child").agg(F.bit_or("low").alias("low"), F.bit_or("high").alias("high"))
    depth = F.col("d") - 1
    return nodes.select(depth.alias("depth"), "way", F.substring("child", F.lit(1), depth).alias("node"), _letter(F.col("child"), depth).alias("letter"), "child", "low", "high")


def _step(states: DataFrame, edges: DataFrame) -> DataFrame:
    """States one level deeper: ``way, word, m, pos, node``, all with one edit. ``states`` has ``edits`` too.

    What a state asks of a node is worked out once, before the join: bits of the letter at its position
    (-1 and the end of a word behind the last) and of the one after.
    """
    pos, m = F.col("pos"), F.col("m")
    here, after = _letter(F.col("word"), pos), _letter(F.col("word"), pos + 1)
    none = F.lit(0).cast("long")
    asked = {"wanted": F.when(pos < m, here).otherwise(-1)}
    for k, (letter, at) in enumerate(((here, pos), (after, pos + 1))):
        low, high = _bits(letter)
        asked |= {f"low{k}": F.when(at < m, low).otherwise(none), f"high{k}": F.when(at < m, high).when(at == m, F.lit(ENDS)).otherwise(none)}
    leads = [(F.col(f"low{k}").bitwiseAND(F.col("low")).bitwiseOR(F.col(f"high{k}").bitwiseAND(F.col("high")))) != 0 for k in (0, 1)]
    letter, wanted, fresh = F.col("letter"), F.col("wanted"), F.col("edits") == 0
    # Of two words that differ in one letter, the one with the lesser letter finds the other.
    forward = leads[1] & F.when(fresh, letter > wanted).otherwise(letter == wanted)
    insert = fresh & (letter != wanted) & leads[0]
    met = states.withColumns(asked).join(edges.drop("depth").hint("shuffle_hash"), ["way", "node"]).filter(forward | insert)
    moved = F.array_compact(F.array(F.when(forward, pos + 1), F.when(insert, pos)))
    return met.select("way", "word", "m", F.explode(moved).alias("pos"), F.col("child").alias("node"))


def _trie_pairs(words: DataFrame) -> DataFrame:
    """``a, b``: pairs of words of up to ``LONGEST`` letters, the shorter (or either) first."""
    spark = words.sparkSession
    read = checkpointed(_both_ways(words))
    first, last = read.agg(F.min("m"), F.max("m")).first()
    folder = f"{shared_dir(spark)}/trie-{uuid.uuid4().hex}"
    if first is None:
        return words.sparkSession.createDataFrame([], "a string, b string")
    _edges(read).write.partitionBy("depth").parquet(folder)
    edges, found, frontier = spark.read.parquet(folder), [], None
    for depth in range(first // 2, last + 1):
        # States without an edit are the words' own prefixes of this depth, from the half on.
        fresh = read.filter((F.floor(F.col("m") / 2) <= depth) & (F.col("m") >= depth)).select(
            "way", "word", "m", F.lit(depth).alias("pos"), F.substring("word", F.lit(1), F.lit(depth)).alias("node"), F.lit(0).alias("edits")
        )
        states = fresh if frontier is None else fresh.unionByName(frontier.filter("pos < m").withColumn("edits", F.lit(1)))
        frontier = checkpointed(_step(states, edges.filter(F.col("depth") == depth)))
        found.append(frontier.filter("pos = m").select("way", "word", "node"))
    out = found[0]
    for f in found[1:]:
        out = out.unionByName(f)
    straight = [F.when(F.col("way") == 0, F.col(c)).otherwise(F.reverse(c)).alias(to) for c, to in (("word", "a"), ("node", "b"))]
    out = checkpointed(out.select(*straight))
    delete_path(spark, folder)
    return out


def _struck_hashes(words: DataFrame) -> DataFrame:
    """``whole, m, at, key``: hash and length of each word, and its hash without the letter ``at``."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for w in pdf["word"]:
                heads = [0]
                for c in map(ord, w):
                    heads.append((heads[-1] * _BASE + c) % _PRIME)
                keys, power, at = [], 1, len(w)
                while at:
                    at -= 1
                    keys.append((heads[at] * power + heads[-1] - heads[at + 1] * power) % _PRIME)
                    power = power * _BASE % _PRIME
                    if len(keys) == 100_000 or not at:
                        yield pd.DataFrame({"whole": heads[-1], "m": len(w), "at": range(at + len(keys) - 1, at - 1, -1), "key": keys})
                        keys = []

    return words.select("word").mapInPandas(run, "whole long, m int, at int, key long")


def _whole_hashes(words: DataFrame) -> DataFrame:
    """``word, whole``: the hash of each word with all its letters."""

    def hashed(word: str) -> int:
        h = 0
        for c in map(ord, word):
            h = (h * _BASE + c) % _PRIME
        return h

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({"word": pdf["word"], "whole": pd.Series([hashed(w) for w in pdf["word"]], dtype="int64")})

    return words.select("word").mapInPandas(run, "word string, whole long")


def _long_pairs(words: DataFrame) -> DataFrame:
    """``a, b``: pairs of words of ``longest`` letters or more, by the hashes of what they share."""
    named, keys = checkpointed(_whole_hashes(words)), checkpointed(_struck_hashes(words))
    # Where a letter repeats, several places give one key; one of them does.
    once = keys.groupBy("whole", "m", "key").agg(F.min("at").alias("at"))
    less = named.select(F.col("whole").alias("key"), (F.length("word") + 1).alias("m"))
    struck = once.join(less, ["key", "m"]).select(F.col("key").alias("x"), F.col("whole").alias("y"), "at", F.lit(1).alias("more"))
    left, right = keys.withColumnRenamed("whole", "x"), keys.withColumnRenamed("whole", "y")
    other = left.join(right, ["key", "m", "at"]).filter("x < y").select("x", "y", "at", F.lit(0).alias("more"))
    met = struck.unionByName(other).join(named.select(F.col("whole").alias("x"), F.col("word").alias("a")), "x")
    met = met.join(named.select(F.col("whole").alias("y"), F.col("word").alias("b")), "y")
    at, more, size = F.col("at"), F.col("more"), F.length("b")
    head = F.substring("a", F.lit(1), at) == F.substring("b", F.lit(1), at)
    tail = F.substring("a", at + 2 - more, size) == F.substring("b", at + 2, size)
    return met.filter(head & tail & (F.length("a") + more == size)).select("a", "b")


def near_words(words: DataFrame, longest: int = LONGEST) -> DataFrame:
    """``word, near``: all pairs of distinct rows of ``word`` that differ by one letter inserted, deleted or replaced, both ways round.

    Words are letters of ``RUN`` without A to Z, of four letters at least.
    """
    size = F.length("word")
    pairs = _trie_pairs(words.filter(size <= longest).select("word"))
    long = checkpointed(words.filter(size >= longest).select("word"))
    if not long.isEmpty():
        pairs = pairs.unionByName(_long_pairs(long))
    both = pairs.select(F.explode(F.array(F.struct(F.col("a").alias("word"), F.col("b").alias("near")), F.struct(F.col("b").alias("word"), F.col("a").alias("near")))).alias("p")).select("p.*")
    return both.filter("word <> near").distinct()


def variant_forms(words: DataFrame, near: DataFrame, ratio: int = RATIO) -> DataFrame:
    """``word, form, root, n, n_near, form_n`` of every word of ``words`` (word, n)."""
    counted = near.join(words.select(F.col("word").alias("near"), F.col("n").alias("k")), "near")
    per = counted.groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("k")).alias("k"), "near")).alias("best"))
    best = words.join(per, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.col("best.near").alias("near"), (-F.col("best.k")).alias("k"))
    taken = F.col("k") >= ratio * F.col("n")
    rows = checkpointed(best.select("word", "n", "n_near", F.when(taken, F.col("near")).alias("form"), F.when(taken, F.col("k")).alias("form_n")))
    # Forms of forms, doubling the way each round; counts rise along it, so it ends.
    way = rows.filter("form IS NOT NULL").select("word", F.col("form").alias("root"))
    while True:
        on = way.select(F.col("word").alias("root"), F.col("root").alias("far"))
        further = checkpointed(way.join(on, "root", "left").select("word", F.coalesce("far", "root").alias("root"), F.col("far").isNotNull().alias("moved")))
        way = further.select("word", "root")
        if further.filter("moved").isEmpty():
            break
    return rows.join(way, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every word of the documents with its form, its root and its number of near words."""
    words = checkpointed(word_counts(table(spark, sf_dir, "documents")))
    return variant_forms(words, near_words(words))


QUERIES = {"op12_spelling_variants": op12_spelling_variants}
SQL = {
    "op12_spelling_variants": """
WITH RECURSIVE step AS (
  SELECT list(list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY i) AS t
  FROM (SELECT unnest(range(256)) AS i)
), runs AS (
  SELECT coalesce(CAST(doc_id AS VARCHAR), '') AS d, unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]+')) AS r FROM documents
), low AS (
  SELECT d, translate(r, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS w FROM runs WHERE length(r) >= 7
), raw AS (
  SELECT w, hex(encode(d || ':' || w)) AS x FROM low
), bytes AS (
  SELECT w, list_transform(range(1, length(x), 2), lambda i: CAST('0x' || substr(x, i, 2) AS BIGINT)) AS b FROM raw
), crc AS (
  SELECT w, xor(4294967295, list_reduce(list_prepend(4294967295, b), lambda c, k: xor(c >> 8, t[(xor(c, k) & 255) + 1]))) AS h FROM bytes, step
), typed AS (
  SELECT CASE WHEN h % 31 = 0 THEN substr(w, 1, CAST(h % length(w) AS INT)) || substr(w, CAST(h % length(w) AS INT) + 2) ELSE w END AS word FROM crc
), words AS (
  SELECT word, count(*) AS n FROM typed WHERE length(word) >= 7 GROUP BY word HAVING count(*) >= 2
), struck AS (
  SELECT word, i, substr(word, 1, i) || substr(word, i + 2) AS s FROM (SELECT word, unnest(range(length(word))) AS i FROM words)
), pairs AS (
  SELECT a.word, b.word AS near FROM struck a JOIN struck b ON a.i = b.i AND a.s = b.s AND a.word <> b.word
  UNION SELECT a.word, b.word FROM struck a JOIN words b ON a.s = b.word
  UNION SELECT b.word, a.word FROM struck a JOIN words b ON a.s = b.word
), ranked AS (
  SELECT p.word, p.near, w.n AS k, row_number() OVER (PARTITION BY p.word ORDER BY w.n DESC, p.near) AS r, count(*) OVER (PARTITION BY p.word) AS n_near
  FROM pairs p JOIN words w ON w.word = p.near
), formed AS (
  SELECT w.word, w.n, coalesce(r.n_near, 0) AS n_near, CASE WHEN r.k >= 10 * w.n THEN r.near END AS form, CASE WHEN r.k >= 10 * w.n THEN r.k END AS form_n
  FROM words w LEFT JOIN ranked r ON r.word = w.word AND r.r = 1
), way AS (
  SELECT word, word AS root, form FROM formed
  UNION ALL SELECT way.word, f.word, f.form FROM way JOIN formed f ON f.word = way.form
)
SELECT f.word, f.form, w.root, f.n, f.n_near, f.form_n FROM formed f JOIN way w ON w.word = f.word AND w.form IS NULL"""
}
