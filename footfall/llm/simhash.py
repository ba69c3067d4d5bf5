"""Operator 9: SimHash near-duplicates through deletion-variant signatures.

A 64-bit fingerprint is cut into two halves. If two fingerprints differ in at most two bits, one
half differs in at most one, so the two share a *variant*: that half with one bit position struck
out. Every distinct fingerprint is indexed under its 64 variants, equal variants meet by key, and
each meeting is verified on the whole fingerprint.

Texts of a looser likeness (0.8 of their five-word shingles, some seven to ten bits in 64) are found
with a signature of several such fingerprints: each has its own variants, so a pair has several
chances to meet, and a meeting is verified on the bits of the whole signature.

Cases: a null text counts as an empty one; texts without words share fingerprint zero; rows with
a null ``doc_id`` are kept, linked like others and never name a component unless all its ids are
null; repeated rows come out as often as they come in; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from footfall.operators.components import connected_components
from footfall.session import checkpointed, table

#: Members of one variant that are compared directly; larger ones take the exact paths of `_dense_links` and `_crowded_links`.
BUCKET = 2048
DISTANCE = 2


def signature(text: str | None, width: int = 3, count: int = 1) -> np.ndarray:
    """``count`` SimHashes of the word shingles of ``text`` (ASCII lower case, ASCII white space), as signed 64-bit integers.

    The first is built from the shingles' hashes themselves, each other one from a mix of them.
    """
    import xxhash

    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(count, np.int64)
    joined = b" ".join(words)
    if len(words) <= width:
        hashes = [xxhash.xxh64_intdigest(joined, 42)]
    else:
        gaps = np.flatnonzero(np.frombuffer(joined, np.uint8) == 32)
        starts, ends = [0, *(gaps + 1).tolist()], [*gaps.tolist(), len(joined)]
        digest = xxhash.xxh64_intdigest
        hashes = [digest(joined[a:b], 42) for a, b in zip(starts, ends[width - 1 :], strict=False)]
    values = np.array(hashes, np.uint64)
    ones = np.zeros((count, 64), np.int64)
    for at in range(0, len(values), 4096):
        part = values[at : at + 4096]
        for n in range(count):
            bits = part if n == 0 else _mixed(part, n)
            ones[n] += np.unpackbits(bits.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return np.packbits(2 * ones > len(values), axis=1, bitorder="little").view(np.int64)[:, 0]


def _mixed(x: np.ndarray, n: int) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64((0x9E3779B97F4A7C15 * (2 * n + 1)) % 2**64)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def fingerprint(text: str | None, width: int = 3) -> int:
    """SimHash of the word shingles of ``text``, as a signed 64-bit integer."""
    return int(signature(text, width)[0])


def _names(count: int) -> list[str]:
    return [f"f{n}" for n in range(count)]


def fingerprints(docs: DataFrame, width: int = 3, count: int = 1) -> DataFrame:
    """``doc_id, fp, f0 ...``: the fingerprints of each row's whole text, and a name ``fp`` for all of them (the one itself, if one)."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            # One text at a time is a Python object.
            found = np.array([signature(t.as_py(), width, count) for t in batch.column(1)], np.int64).reshape(batch.num_rows, count)
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(found[:, n]) for n in range(count)]], names=["doc_id", *_names(count)])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    out = rows.mapInArrow(run, "doc_id long, " + ", ".join(f"{c} long" for c in _names(count)))
    return out.withColumn("fp", F.col("f0") if count == 1 else F.xxhash64(*_names(count)))


def _roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Least index connected to each of ``n`` by the pairs (a, b), a < b."""
    root = np.arange(n)
    while len(a):
        ra, rb = root[a], root[b]
        low = np.minimum(ra, rb)
        before = root.copy()
        np.minimum.at(root, np.maximum(ra, rb), low)
        np.minimum.at(root, b, low)
        np.minimum.at(root, a, low)
        root = root[root]
        if np.array_equal(root, before):
            break
    return root


def _meet(keys: np.ndarray, ids: np.ndarray, words: np.ndarray, distance: int, bucket: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Verified links (a forest) among rows sorted by key, and the ids of keys with over ``bucket`` rows."""
    edge = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1], True])
    size = np.diff(edge)
    group = np.repeat(np.arange(len(size)), size)
    large = size[group] > bucket
    dense = np.unique(ids[large])
    rows = np.flatnonzero(~large & (size[group] > 1))
    a, b, step = [], [], 1
    while len(rows):
        rows = rows[rows + step < len(keys)]
        rows = rows[group[rows] == group[rows + step]]
        near = np.bitwise_count((words[rows] ^ words[rows + step]).view(np.uint64)).sum(axis=1, dtype=np.int64) <= distance
        a.append(rows[near])
        b.append(rows[near] + step)
        step += 1
    if not a:
        return ids[:0], ids[:0], dense
    values, at = np.unique(ids, return_inverse=True)
    x, y = at[np.concatenate(a)], at[np.concatenate(b)]
    root = _roots(len(values), np.minimum(x, y), np.maximum(x, y))
    hung = np.flatnonzero(root != np.arange(len(values)))
    return values[hung], values[root[hung]], dense


def variants(fps: DataFrame, count: int = 1) -> DataFrame:
    """``key`` and the columns of ``fps``: each row under the 64 one-wildcard half signatures of each fingerprint."""
    word = F.element_at(F.array(*_names(count)), (F.col("v") / 64).cast("int") + 1)
    half = F.when(F.col("v") % 64 < 32, word.bitwiseAND(F.lit(0xFFFFFFFF))).otherwise(F.shiftrightunsigned(word, 32))
    bit = F.expr("shiftleft(1L, CAST(v % 32 AS INT))")
    key = half.bitwiseAND(F.bitwise_not(bit)).bitwiseOR(F.expr("shiftleft(CAST(v AS BIGINT), 32)"))
    return fps.select("fp", *_names(count), F.explode(F.sequence(F.lit(0), F.lit(64 * count - 1))).alias("v")).select(key.alias("key"), "fp", *_names(count))


def links(fps: DataFrame, distance: int = DISTANCE, bucket: int = BUCKET, count: int = 1) -> DataFrame:
    """``src, dst``: links between distinct rows of ``fp, f0 ...`` within ``distance`` bits of the whole signature.

    Not every pair is returned, but every pair that meets is connected: each task returns a forest of the
    links it has verified. With one fingerprint and up to two bits, all pairs meet. A variant with over
    ``bucket`` members is settled by `_dense_links` for one fingerprint and by `_crowded_links` for several.
    """
    if count == 1 and not 0 <= distance <= 2:
        raise ValueError("links of one fingerprint are complete up to a distance of 2")
    names = _names(count)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rest = np.zeros((0, 2 + count), np.int64)

        def out(rows: np.ndarray) -> pd.DataFrame:
            a, b, dense = _meet(rows[:, 0], rows[:, 1], np.ascontiguousarray(rows[:, 2:]), distance, bucket)
            return pd.DataFrame({"src": np.r_[a, dense], "dst": np.r_[b, dense]})

        for pdf in batches:
            rows = np.concatenate([rest, pdf[["key", "fp", *names]].to_numpy(np.int64)])
            if not len(rows):
                continue
            cut = np.searchsorted(rows[:, 0], rows[-1, 0])  # the last key may go on in the next batch
            if cut:
                yield out(rows[:cut])
            rest = rows[cut:]
            if len(rest) > 4 * max(bucket, 1):  # a dense key: hand on all but enough rows to know it by
                keep = bucket + 1
                yield pd.DataFrame({"src": rest[keep:, 1], "dst": rest[keep:, 1]})
                rest = rest[:keep]
        if len(rest):
            yield out(rest)

    met = variants(fps, count).repartition("key").sortWithinPartitions("key").mapInPandas(run, "src long, dst long").distinct()
    met = checkpointed(met)
    found = met.filter("src <> dst")
    dense = met.filter("src = dst").select(F.col("src").alias("fp"))
    if dense.isEmpty():
        return found
    crowded = fps.join(dense, "fp", "left_semi")
    return found.unionByName(_dense_links(crowded.select("fp", F.col("f0").alias("w")), distance) if count == 1 else _crowded_links(crowded, distance, bucket, count))


def _crowded_links(fps: DataFrame, distance: int, bucket: int, count: int) -> DataFrame:
    """Links that connect all members of a variant with over ``bucket`` of them within ``distance`` bits of the whole signature.

    Those near the variant's least member are hung on it. Each of the rest, in shares of ``bucket``, is
    compared with every member: with the hung ones for one link, with the rest for all.
    """
    names = _names(count)
    rows = variants(fps, count)
    per = rows.groupBy("key").agg(F.count("*").alias("n"), F.min(F.struct("fp", *names)).alias("hub")).filter(F.col("n") > bucket)
    near = F.expr(" + ".join(f"bit_count({c} ^ hub.{c})" for c in names)) <= distance
    rows = checkpointed(rows.join(per, "key").withColumn("near", near))
    hung = rows.filter("near AND fp <> hub.fp").select(F.col("fp").alias("src"), F.col("hub.fp").alias("dst"))
    rest = rows.filter("NOT near").select("key", "fp", *names)
    shares = checkpointed(rest.groupBy("key").agg(F.ceil(F.count("*") / max(bucket, 1)).alias("shares")))
    share = rest.join(shares, "key").withColumn("share", F.pmod(F.xxhash64("fp"), F.col("shares"))).drop("shares")
    whole = rows.join(shares, "key").select("key", F.explode(F.sequence(F.lit(0).cast("long"), F.col("shares") - 1)).alias("share"), F.col("fp").alias("o"), "near", *[F.col(c).alias(f"o{c}") for c in names])
    bits = F.expr(" + ".join(f"bit_count({c} ^ o{c})" for c in names))
    met = share.join(whole, ["key", "share"]).filter((bits <= distance) & (F.col("near") | (F.col("fp") < F.col("o"))))
    one = met.filter("near").groupBy("key", "fp").agg(F.min("o").alias("dst")).select(F.col("fp").alias("src"), "dst")
    return hung.unionByName(one).unionByName(met.filter("NOT near").select(F.col("fp").alias("src"), F.col("o").alias("dst"))).distinct()


def _dense_links(fps: DataFrame, distance: int) -> DataFrame:
    """Exact links within ``distance`` bits of ``w`` among rows that share a crowded variant, without comparing them.

    Each is written once per way to strike out that many bits of the whole fingerprint. Two within the
    distance share such a key, and those that share one are within it, so each is hung on the key's
    least member: a number of rows in proportion to the members.
    """
    if distance == 2:
        bits = fps.select("fp", "w", F.explode(F.sequence(F.lit(0), F.lit(62))).alias("i")).select("fp", "w", "i", F.explode(F.sequence(F.col("i") + 1, F.lit(63))).alias("j"))
        mask = F.expr("shiftleft(1L, i) | shiftleft(1L, j)")
    else:
        bits = fps.select("fp", "w", F.explode(F.sequence(F.lit(0), F.lit(63 if distance else 0))).alias("i")).withColumn("j", F.lit(0))
        mask = F.expr("shiftleft(1L, i)") if distance else F.lit(0).cast("long")
    keyed = bits.select("fp", (F.col("i") * 64 + F.col("j")).alias("ij"), F.col("w").bitwiseAND(F.bitwise_not(mask)).alias("rest"))
    least = keyed.groupBy("ij", "rest").agg(F.min("fp").alias("dst"), F.count("*").alias("n")).filter("n > 1").drop("n")
    return keyed.join(least, ["ij", "rest"]).filter("fp <> dst").select(F.col("fp").alias("src"), "dst").distinct()


def near_duplicates(docs: DataFrame, width: int = 3, distance: int = DISTANCE, bucket: int = BUCKET, count: int = 1) -> DataFrame:
    """One row per row of ``docs``: ``doc_id, fp, component_id`` (the least doc_id that links reach)."""
    marked = checkpointed(fingerprints(docs, width, count))
    distinct = marked.groupBy("fp").agg(F.min("doc_id").alias("least"), *[F.first(c).alias(c) for c in _names(count)])
    comps = connected_components(links(distinct.select("fp", *_names(count)), distance, bucket, count))
    member = distinct.join(comps.withColumnRenamed("node", "fp"), "fp", "left").withColumn("component", F.coalesce("component", "fp"))
    named = member.groupBy("component").agg(F.min("least").alias("component_id"))
    of = member.join(named, "component").select("fp", "component_id")
    return marked.join(of, "fp").select("doc_id", "fp", "component_id")


def op9_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its fingerprint and component."""
    out = near_duplicates(table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


QUERIES = {"op9_simhash_near_dedup": op9_simhash_near_dedup}
#: XXH64 has no SQL form; tests/llm/test_simhash.py holds the query against all pairs.
SQL: dict[str, str] = {}
