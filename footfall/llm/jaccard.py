"""Near-duplicates at a Jaccard likeness of word shingles, without loss: what the pipeline's stage asks of operator 9.

Texts that share 0.8 of their five-word shingles differ in some four to fourteen bits of a 64-bit fingerprint,
which no bit segment search reaches at a bearable number of variants; none of them at sf0.1 differ in two or fewer.
So fingerprints that operator 9 links are one source of candidates, and *meetings* are the other: each text is the set of its
distinct shingles' hashes in one order for all texts (those that a sample shows often come last, the others by
hash). If two sets of sizes n and m reach the threshold t, they share at least ``ceil(t n)`` of the one's shingles,
so they share one of its first ``n - ceil(t n) + 1``, and likewise of the other's: equal shingles among the first
ones meet by key. A candidate is given up where the sizes, or the parities of the shingles in classes of their hashes
(of which no more can differ than there are shingles in one set alone), rule the threshold out: in 256 classes at
first, then in as many as a text has shingles and more. All others are verified on the shingles of their texts.

Texts of a key are held against hubs of it, as long as they are in different components: one hub in the first
round, twice as many in each round after it, so rounds are logarithmic in the largest key. They end when pairs of one
key across components no longer outnumber its rows ``CROSS`` times, or as many times as the next round has hubs;
then those that are still apart meet each other, each pair in its first key and, in a crowded key, only if the parities in
many classes leave it open. A key whose texts all share another one near it is left out before, and sizes
and parities are asked where two texts meet, so few pairs are written. So groups of copies are not compared in full, and what is connected
is the same as if all pairs had been. Keys of over ``SHARE`` members are dealt over several tasks. What a round writes
is deleted after the next one, but for the links, which are only added to.

Texts are told apart by 64-bit hashes. Cases: null texts and texts without words are one set; a text of
up to ``width`` words is one shingle; rows without a ``doc_id`` are linked like others and name a component
only if all its ids are null; repeated rows come out as often as they come in; extra columns are ignored.
"""

from __future__ import annotations

import gc
import sys
import uuid
from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from footfall.llm import simhash
from footfall.operators.components import connected_components
from footfall.session import checkpointed, delete_path, shared_dir

WIDTH, THRESHOLD = 5, 0.8
#: Texts by which common shingles are told, and the number of those: they order the shingles and change no result.
SAMPLE, COMMON = 4000, 100_000
#: Members of a key that one task compares with the whole key.
SHARE = 1024
#: Rows of a side (16 to 40 bytes each) up to which it is broadcast, after they were counted.
FEW = 200_000
#: Pairs of one key across components, as a multiple of all rows of keys, below which they are compared outright.
CROSS = 10
#: Bytes of text that are hashed at once.
PIECE = 1 << 18
#: Texts of a key beyond which it is crowded, and how many keys on either side of it in a text may stand for it.
CROWD, NEAR = 8, 8
#: Words of 64 parities, and keys, that a text carries at most into its crowded keys when all of these are compared.
FINE, FIRST = 128, 32
PARITIES = ["b0", "b1", "b2", "b3"]

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_WHITE = np.zeros(256, bool)
_WHITE[[9, 10, 11, 12, 13, 32]] = True


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _word_hashes(raw: np.ndarray, starts_text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash and first byte of every word of ``raw``; no word goes on across the positions ``starts_text``."""
    white = _WHITE[raw]
    first = ~white
    first[1:] &= white[:-1]
    inner = starts_text[(starts_text > 0) & (starts_text < len(raw))]
    first[inner] = ~white[inner]
    held = np.flatnonzero(~white)
    starts = np.flatnonzero(first)
    if not len(starts):
        return np.zeros(0, np.uint64), starts
    at = np.searchsorted(held, starts)
    size = np.diff(np.r_[at, len(held)])
    power = np.multiply.accumulate(np.r_[np.uint64(1), np.full(int(size.max()), np.uint64(0x9E3779B97F4A7C15))])
    place = np.arange(len(held)) - np.repeat(at, size)
    value = np.add.reduceat((_LOWER[raw[held]].astype(np.uint64) + np.uint64(1)) * power[place], at)
    return _mix(value ^ (size.astype(np.uint64) << np.uint64(40))), starts


def _pieces(texts: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(word hashes, text of each word) of consecutive texts, hashed in pieces of bounded size."""
    at = 0
    while at < len(texts):
        end, size = at, 0
        while end < len(texts) and (end == at or size + len(texts[end]) <= PIECE):
            size += len(texts[end])
            end += 1
        if size <= 2 * PIECE:
            raw = np.frombuffer(b"".join(texts[at:end]), np.uint8)
            begin = np.cumsum([0, *map(len, texts[at:end])])[:-1]
            words, starts = _word_hashes(raw, begin)
            # Of texts that begin at one place all but the last are empty.
            yield words, at + np.searchsorted(begin, starts, "right") - 1
        else:  # one long text, cut at white space
            raw, a, parts = np.frombuffer(texts[at], np.uint8), 0, []
            while a < len(raw):
                b = min(len(raw), a + PIECE)
                while b < len(raw) and not _WHITE[raw[b]]:
                    b += 1
                parts.append(_word_hashes(raw[a:b], np.zeros(0, np.int64))[0])
                a = b
            words = np.concatenate(parts)
            yield words, np.full(len(words), at)
        at = end


def _shingle_rows(texts: list[bytes], width: int) -> tuple[np.ndarray, np.ndarray]:
    """(text, shingle hash) of every position of every text, texts in order; texts of few words have one."""
    found = list(_pieces(texts))
    words = np.concatenate([w for w, _ in found]) if found else np.zeros(0, np.uint64)
    text = np.concatenate([t for _, t in found]) if found else np.zeros(0, np.int64)
    many = np.bincount(text, minlength=len(texts)) if len(text) else np.zeros(len(texts), np.int64)
    with np.errstate(over="ignore"):
        full = max(0, len(words) - width + 1)
        value = np.zeros(full, np.uint64)
        for i in range(width):
            value = value * np.uint64(0xD6E8FEB86659FD93) + words[i : i + full]
        inside = text[:full] == text[width - 1 :][:full] if full else np.zeros(0, bool)
        short = np.flatnonzero(many < width)
        begin = np.cumsum(many) - many
        few = np.array([sum((int(words[begin[t] + i]) * (2 * i + 3) for i in range(many[t])), int(many[t])) % 2**64 for t in short.tolist()], np.uint64)
        owner, hashes = np.r_[text[:full][inside], short], np.r_[_mix(value[inside]), _mix(few)]
    return owner.astype(np.int64), hashes


def shingle_sets(texts: list[bytes], width: int = WIDTH) -> list[np.ndarray]:
    """The distinct hashes of each text's word shingles (ASCII lower case, ASCII white space), ascending."""
    owner, hashes = _shingle_rows(texts, width)
    order = np.lexsort((hashes, owner))
    owner, hashes = owner[order], hashes[order]
    new = np.r_[True, (owner[1:] != owner[:-1]) | (hashes[1:] != hashes[:-1])] if len(owner) else np.zeros(0, bool)
    owner, hashes = owner[new], hashes[new]
    return np.split(hashes, np.searchsorted(owner, np.arange(1, len(texts)))) if texts else []


def _slices(column, most: int = PIECE) -> Iterator[tuple[int, list[bytes]]]:
    """(first row, texts) of slices of an Arrow column of bounded size; a longer text is a slice of its own."""
    at, texts, size = 0, [], 0
    for i, value in enumerate(column):
        text = value.as_buffer() if value.is_valid else b""
        if texts and size + len(text) > most:
            yield at, texts
            at, texts, size = i, [], 0
        texts.append(bytes(text) if text is not None else b"")
        size += len(text)
    if texts:
        yield at, texts


def _common(rows: DataFrame, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes, ascending, that more than two texts of a bounded sample hold, and how many do."""
    rate = max(1, rows.count() // SAMPLE)

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            for _, texts in _slices(batch.column(0)):
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(shingle_sets(texts, width)).view(np.int64))], names=["h"])

    held = rows.filter(F.pmod(F.xxhash64("tid"), F.lit(rate)) == 0).dropDuplicates(["tid"]).select(F.encode("text", "UTF-8").alias("text")).mapInArrow(run, "h long")
    top = held.groupBy("h").agg(F.count("*").alias("n")).filter("n > 2").orderBy(F.desc("n"), "h").limit(COMMON).collect()
    hashes, counts = np.array([r.h for r in top], np.int64).view(np.uint64), np.array([r.n for r in top], np.int64)
    at = np.argsort(hashes)
    return hashes[at], counts[at]


def _parities(hashes: np.ndarray) -> np.ndarray:
    """Whether each class of hashes holds an odd number, in the power of two of classes that is at least twice as many as the hashes."""
    classes = max(256, 1 << (2 * len(hashes) - 1).bit_length())
    held = np.bincount((hashes & np.uint64(classes - 1)).astype(np.int64), minlength=classes) & 1
    return np.packbits(held.astype(np.uint8), bitorder="little").view(np.int64)


def _differ(x: np.ndarray, y: np.ndarray) -> int:
    """Classes that differ, in as many classes as both have (half of the classes fold onto the other half)."""
    while len(x) > len(y):
        x = x[: len(x) // 2] ^ x[len(x) // 2 :]
    while len(y) > len(x):
        y = y[: len(y) // 2] ^ y[len(y) // 2 :]
    return int(np.bitwise_count(x ^ y).sum())


def _bit_counts(owner: np.ndarray, hashes: np.ndarray, texts: int, at_once: int = 1 << 16) -> np.ndarray:
    """How many hashes of each text have each of the 64 bits set."""
    ones = np.zeros((texts, 64), np.int64)
    for at in range(0, len(hashes), at_once):
        own, bits = owner[at : at + at_once], np.unpackbits(hashes[at : at + at_once].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        starts = np.flatnonzero(np.r_[True, own[1:] != own[:-1]])
        ones[own[starts]] += np.add.reduceat(bits, starts, axis=0, dtype=np.int64)
    return ones


def sketches(rows: DataFrame, width: int = WIDTH, threshold: float = THRESHOLD) -> DataFrame:
    """``tid, n, fp, b0 .. b3, odd, hs``: of each distinct text the size of its set, its SimHash, its parities (in 256 classes and in many) and its first shingles."""
    known = rows.sparkSession.sparkContext.broadcast(_common(rows, width))
    schema = "tid long, n int, fp long, " + ", ".join(f"{b} long" for b in PARITIES) + ", odd array<long>, hs array<long>"

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        hashes, counts = known.value
        sys.__dict__.pop("_footfall_encoders", None)  # a worker that goes on with other work gives up its encoders
        for batch in batches:
            for first, texts in _slices(batch.column(1)):
                owner, h = _shingle_rows(texts, width)
                often = np.zeros(len(h), np.int64)
                if len(hashes):
                    at = np.minimum(np.searchsorted(hashes, h), len(hashes) - 1)
                    often = np.where(hashes[at] == h, counts[at], 0)
                order = np.lexsort((h, often, owner))
                owner, h = owner[order], h[order]
                new = np.r_[True, (owner[1:] != owner[:-1]) | (h[1:] != h[:-1])]
                owner, h, place = owner[new], h[new], order[new]
                n = np.bincount(owner, minlength=len(texts))
                begin = np.cumsum(n) - n
                ends = np.cumsum(n)
                words = [_parities(h[a:b]) for a, b in zip((ends - n).tolist(), ends.tolist(), strict=True)]
                many = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum([len(w) for w in words])].astype(np.int32)), pa.array(np.concatenate(words)))
                odd = np.bincount(owner * 256 + (h & np.uint64(255)).astype(np.int64), minlength=256 * len(texts)).reshape(-1, 256) & 1
                odd = np.packbits(odd.astype(np.uint8), axis=1, bitorder="little").view(np.int64)
                ones = _bit_counts(owner, h, len(texts))
                fp = np.packbits(2 * ones > n[:, None], axis=1, bitorder="little").view(np.int64)[:, 0]
                most = n - np.ceil(threshold * n - 1e-9).astype(np.int64) + 1
                lead = np.arange(len(h)) - np.repeat(begin, n) < np.repeat(most, n)
                first_ones = h[lead][np.lexsort((place[lead], owner[lead]))]  # as they stand in the text
                lists = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(most)].astype(np.int32)), pa.array(first_ones.view(np.int64)))
                tid = batch.column(0).slice(first, len(texts))
                yield pa.RecordBatch.from_arrays([tid, pa.array(n.astype(np.int32)), pa.array(fp), *[pa.array(np.ascontiguousarray(odd[:, i])) for i in range(4)], many, lists], names=["tid", "n", "fp", *PARITIES, "odd", "hs"])

    return rows.select("tid", F.encode("text", "UTF-8").alias("text")).mapInArrow(run, schema).dropDuplicates(["tid"])


def _possible(a: str, b: str, threshold: float) -> Column:
    """Whether the sizes and parities with the name prefixes ``a`` and ``b`` leave the threshold open."""
    total = F.col(f"{a}n") + F.col(f"{b}n")
    shared = F.ceil(threshold / (1 + threshold) * total - 1e-9)
    differ = F.expr(" + ".join(f"bit_count({a}{c} ^ {b}{c})" for c in PARITIES))
    return (F.least(f"{a}n", f"{b}n") >= shared) & (differ <= total - 2 * shared)


def _folded(odd: str) -> Column:
    """The parities of a long text in the classes of `FINE` words, onto which the others fold."""
    word = lambda i: F.aggregate(F.sequence(i, F.size(odd), F.lit(FINE)), F.lit(0).cast("long"), lambda s, j: s.bitwiseXOR(F.get(odd, j - 1)))
    return F.when(F.size(odd) > FINE, F.transform(F.sequence(F.lit(1), F.lit(FINE)), word)).otherwise(F.col(odd))


def _possible_in_many(a: str, b: str, threshold: float) -> Column:
    """The same by the parities in many classes, as `_differ` counts them; where their numbers differ more than twofold, the threshold is left open."""
    total, x, y = F.col(f"{a}n") + F.col(f"{b}n"), F.col(f"{a}odd"), F.col(f"{b}odd")
    words = F.least(F.size(x), F.size(y))
    fold = lambda o: F.when(F.size(o) > words, F.zip_with(F.slice(o, F.lit(1), words), F.slice(o, words + 1, words), lambda p, q: p.bitwiseXOR(q))).otherwise(o)
    differ = F.aggregate(F.zip_with(fold(x), fold(y), lambda p, q: F.bit_count(p.bitwiseXOR(q))), F.lit(0), lambda s, v: s + v)
    return (F.greatest(F.size(x), F.size(y)) > 2 * words) | (differ <= total - 2 * F.ceil(threshold / (1 + threshold) * total - 1e-9))


def _written(df: DataFrame, folder: str) -> DataFrame:
    """``df`` as a compressed table in the shared folder, for what is large and read several times."""
    path = f"{folder}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _released(spark: SparkSession) -> None:
    """Lets go of the shuffles and checkpoints that nothing refers to any more: a loop would keep them on disk until the driver's heap fills."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def _few(df: DataFrame, limit: int = FEW) -> DataFrame:
    return F.broadcast(df) if df.count() <= limit else df


def _open(pairs: DataFrame, whole: DataFrame, threshold: float) -> DataFrame:
    """Pairs ``src, dst`` (src > dst) that sizes and parities leave open."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            keep = []
            for x, y, most in zip(batch.column(2), batch.column(3), batch.column(4).to_pylist(), strict=True):
                keep.append(_differ(x.values.to_numpy().view(np.uint64), y.values.to_numpy().view(np.uint64)) <= most)
            yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    columns = ("n", "odd", *PARITIES)
    x = whole.select(F.col("tid").alias("src"), *[F.col(c).alias(f"x{c}") for c in columns])
    y = whole.select(F.col("tid").alias("dst"), *[F.col(c).alias(f"y{c}") for c in columns])
    left = pairs.join(x, "src").join(y, "dst").filter(_possible("x", "y", threshold))
    total = F.col("xn") + F.col("yn")
    most = (total - 2 * F.ceil(threshold / (1 + threshold) * total - 1e-9)).cast("int")
    return left.select("src", "dst", "xodd", "yodd", most.alias("most")).mapInArrow(run, "src long, dst long")


def verified(pairs: DataFrame, rows: DataFrame, folder: str, width: int = WIDTH, threshold: float = THRESHOLD) -> DataFrame:
    """Those of the (written) pairs ``src, dst`` whose texts reach the threshold; ``folder`` takes what is counted on the way."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            keep, hub, last = [], None, None
            for row in range(batch.num_rows):
                key = batch.column(1)[row].as_py()
                texts = [batch.column(2)[row].as_py()] if key == last else [batch.column(i)[row].as_py() for i in (2, 3)]
                own, *other = shingle_sets(texts, width)
                last, hub = key, other[0] if other else hub
                shared = len(np.intersect1d(own, hub, assume_unique=True))
                keep.append(shared >= threshold * (len(own) + len(hub) - shared) - 1e-9)
            yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    ends = _written(pairs.select(F.explode(F.array("src", "dst")).alias("tid")).distinct(), folder)
    texts = rows.join(_few(ends), "tid", "left_semi").select("tid", F.encode("text", "UTF-8").alias("text")).dropDuplicates(["tid"])
    x = texts.select(F.col("tid").alias("src"), F.col("text").alias("x"))
    y = texts.select(F.col("tid").alias("dst"), F.col("text").alias("y"))
    return pairs.join(x, "src").join(y, "dst").select("src", "dst", "x", "y").mapInArrow(run, "src long, dst long")


def _by_fingerprint(marks: DataFrame) -> DataFrame:
    """``src, dst``: texts of one fingerprint on the least of them, and those on each other whose fingerprints operator 9 links.

    Its search by one-wildcard halves finds the fingerprints within `simhash.DISTANCE` bits; each of its links is a candidate.
    """
    least = _few(checkpointed(marks.groupBy("fp").agg(F.min("tid").alias("hub"), F.count("*").alias("n"))))
    same = marks.select("tid", "fp").join(least.filter("n > 1"), "fp").filter("tid <> hub").select(F.col("tid").alias("src"), F.col("hub").alias("dst"))
    near = simhash.links(least.select("fp", F.col("fp").alias("f0")))
    hub = lambda end: least.select(F.col("fp").alias(end), F.col("hub").alias(f"{end}_"))
    return same.unionByName(near.join(hub("src"), "src").join(hub("dst"), "dst").select(F.greatest("src_", "dst_").alias("src"), F.least("src_", "dst_").alias("dst")))


def _needed(met: DataFrame, folder: str) -> DataFrame:
    """The rows ``h, k, tid, at`` of the keys that tell of all pairs that meet: keys whose texts all share another one are left out.

    Of keys with the same texts one stays. A passage that texts have in common gives many keys with nearly the same texts, which stand
    together: a crowded key whose texts all hold one of those about it, of more texts (ties: the later key), is left out too.
    What it is left out for comes after it in that order, so a key that stays has all texts of both.
    """
    keys = met.groupBy("h", "k").agg(F.bit_xor(F.xxhash64("tid")).alias("a"), F.bit_xor(F.xxhash64(F.lit(1), "tid")).alias("b"))
    one = met.join(keys.groupBy("k", "a", "b").agg(F.max("h").alias("h")).select("h"), "h", "left_semi")
    one = _written(one.select("h", "k", "tid", "at"), folder)
    row, own = Window.partitionBy("tid").orderBy("at", "h").rowsBetween(-NEAR, NEAR), F.struct("k", "h")
    beside = one.filter(F.col("k") > CROWD).select("h", "k", F.collect_list(own).over(row).alias("near"))
    about = beside.select("h", "k", F.explode(F.filter("near", lambda o: o > own)).alias("o"))
    told = about.groupBy("h", "k", F.col("o.h").alias("other")).agg(F.count("*").alias("n")).filter(F.col("n") == F.col("k")).select("h").distinct()
    return one.join(_few(checkpointed(told)), "h", "left_anti")


def _named(rows: DataFrame, comps: DataFrame | None) -> DataFrame:
    """``rows`` with the component of their text, which is the text itself where none is linked."""
    if comps is None:
        return rows.withColumn("component", F.col("tid"))
    return rows.join(comps, "tid", "left").withColumn("component", F.coalesce("component", "tid"))


def _shares() -> Column:
    """Tasks over which a key of ``k`` members is dealt."""
    return F.ceil(F.col("k") / SHARE)


def _held_against_hubs(named: DataFrame, whole: DataFrame, threshold: float, turn: int) -> DataFrame:
    """``src, dst``: each text with hubs of its keys that are in other components and left open.

    A key has a hub in each of ``2 ** turn`` classes of texts, the first of its class in an order common to all keys;
    a text is held against one hub of a class.
    """
    order = lambda tid: F.xxhash64(tid, F.lit(turn))
    way = lambda tid: F.pmod(order(tid), F.lit(1 << turn)).alias("way")
    columns = ("n", *PARITIES)
    hub = F.min(F.struct(order("tid").alias("by"), "tid", "component", *columns)).alias("hub")
    hubs = named.groupBy("h", way("tid")).agg(hub, F.max("k").alias("k")).withColumn("share", F.explode(F.sequence(F.lit(0).cast("long"), _shares() - 1)))
    dealt = named.select("h", F.pmod(F.xxhash64("tid"), _shares()).alias("share"), "tid", "component", *[F.col(c).alias(f"x{c}") for c in columns])
    hubs = hubs.select("h", "share", F.col("hub.tid").alias("dst"), F.col("hub.component").alias("other"), *[F.col(f"hub.{c}").alias(f"y{c}") for c in columns])
    apart = dealt.join(hubs, ["h", "share"]).filter((F.col("component") != F.col("other")) & _possible("x", "y", threshold))
    pairs = apart.select(F.col("tid").alias("src"), "dst").distinct()
    return _open(pairs, whole, threshold).groupBy("src", way("dst")).agg(F.min("dst").alias("dst")).select("src", "dst")


def _met_across(named: DataFrame, whole: DataFrame, threshold: float) -> DataFrame:
    """``src, dst``: texts of one key in different components that sizes and parities leave open.

    In keys of over ``CROWD`` texts the parities in many classes are asked as two texts meet, and a pair is made in the first of
    its keys alone, as far as the first keys of both tell: what is made there are pairs that are nearly all alike, once each.
    """
    split = named.groupBy("h").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).filter("lo <> hi").select("h")
    mixed = named.join(split, "h", "left_semi")
    columns = ("tid", "n", "component", *PARITIES, "odd", "first")
    apart = (F.col("xtid") > F.col("ytid")) & (F.col("xcomponent") != F.col("ycomponent")) & _possible("x", "y", threshold)

    def side(rows: DataFrame, letter: str, *more: Column) -> DataFrame:
        return rows.select("h", *more, *[F.col(c).alias(letter + c) for c in columns if c in rows.columns])

    few, crowd = mixed.filter(F.col("k") <= CROWD), mixed.filter(F.col("k") > CROWD)
    rank = F.row_number().over(Window.partitionBy("tid").orderBy("h"))
    first = crowd.select("tid", "h", rank.alias("rank")).filter(F.col("rank") <= FIRST).groupBy("tid").agg(F.collect_list("h").alias("first"))
    crowd = crowd.join(whole.select("tid", _folded("odd").alias("odd")).join(first, "tid"), "tid")
    small, large = crowd.filter(F.col("k") <= SHARE), crowd.filter(F.col("k") > SHARE)
    share, every = F.pmod(F.xxhash64("tid"), _shares()).alias("share"), F.explode(F.sequence(F.lit(0).cast("long"), _shares() - 1)).alias("share")
    both = side(few, "x").join(side(few, "y"), "h").filter(apart).select("xtid", "ytid")
    apart &= _possible_in_many("x", "y", threshold)
    apart &= F.coalesce(F.array_min(F.array_intersect("xfirst", "yfirst")) >= F.col("h"), F.lit(True))
    both = both.unionByName(side(small, "x").join(side(small, "y"), "h").filter(apart).select("xtid", "ytid"))
    both = both.unionByName(side(large, "x", share).join(side(large, "y", every), ["h", "share"]).filter(apart).select("xtid", "ytid"))
    return both.select(F.col("xtid").alias("src"), F.col("ytid").alias("dst")).distinct()


def _near_labels(found: DataFrame, folder: str) -> DataFrame:
    """``tid, component``: the least text within two links of each linked one.

    Hubs make stars, of which this tells nearly all that their components would, at a few small shuffles; where it tells
    less, some texts are held against each other that are linked already. Labels of the round before count as links, so
    what was told stays told and reaches on.
    """
    both = found.select(F.col("src").alias("tid"), F.col("dst").alias("o")).unionByName(found.select(F.col("dst").alias("tid"), F.col("src").alias("o")))
    one = _written(both.groupBy("tid").agg(F.least("tid", F.min("o")).alias("l")), folder)
    two = both.join(_few(one.withColumnRenamed("tid", "o")), "o").groupBy("tid").agg(F.min("l").alias("component"))
    return _written(two.select("tid", F.least("tid", "component").alias("component")), folder)


def links(rows: DataFrame, width: int = WIDTH, threshold: float = THRESHOLD) -> DataFrame:
    """``src, dst``: verified pairs of the ``tid`` of rows of ``tid, text`` that connect all pairs at the threshold."""
    folder = f"{shared_dir(rows.sparkSession)}/near-{uuid.uuid4().hex}"
    full = _written(sketches(rows, width, threshold), folder)
    marks, whole = full.drop("hs", "odd"), full.drop("hs")
    led = full.select("tid", F.posexplode("hs").alias("at", "h"))
    keys = checkpointed(led.groupBy("h").agg(F.count("*").alias("k")).filter("k > 1"))
    crowded = _few(checkpointed(keys.filter(F.col("k") > SHARE)))
    alone = F.coalesce(_shares(), F.lit(1).cast("long"))
    laid = keys.withColumn("share", F.explode(F.sequence(F.lit(0).cast("long"), _shares() - 1)))
    met = led.join(crowded, "h", "left").select("h", "tid", "at", F.pmod(F.xxhash64("tid"), alone).alias("share")).join(laid, ["h", "share"])
    met = _written(met.select("h", F.col("k").cast("int").alias("k"), "tid", "at"), folder)
    met = _written(_needed(met, folder).drop("at").join(marks.drop("fp"), "tid"), folder)
    members = met.count()

    spark, kept = rows.sparkSession, f"{folder}/links"
    named, labels, turn = met.withColumn("component", F.col("tid")), None, 0
    while True:
        now = f"{folder}/turn-{turn}"
        tried = _held_against_hubs(named, whole, threshold, turn)
        if turn == 0:
            tried = tried.unionByName(_open(_by_fingerprint(marks), whole, threshold)).distinct()
        part = f"{kept}/turn={turn}"
        verified(_written(tried, now), rows, now, width, threshold).write.parquet(part)
        if turn and spark.read.schema("src long, dst long").parquet(part).isEmpty():
            break
        found = spark.read.schema("src long, dst long, turn int").parquet(kept).select("src", "dst")
        told = found if labels is None else found.unionByName(labels.select(F.col("tid").alias("src"), F.col("component").alias("dst")))
        labels = _near_labels(told, now)
        named = _named(met, _few(labels))
        per = named.groupBy("h", "component").agg(F.count("*").alias("n")).groupBy("h").agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("n")).alias("own"))
        apart = per.agg(F.sum((F.col("n") * F.col("n") - F.col("own")) / 2)).first()[0] or 0
        if turn:
            delete_path(spark, f"{folder}/turn-{turn - 1}")
        turn += 1
        if apart <= max(CROSS, 1 << turn) * members:
            break
        del tried, told, per
        _released(spark)

    found = checkpointed(spark.read.schema("src long, dst long, turn int").parquet(kept).select("src", "dst"))
    named = _named(met, _few(checkpointed(connected_components(found)).select(F.col("node").alias("tid"), "component")))
    left = _written(_open(_met_across(named, whole, threshold), whole, threshold), folder)
    found = found.unionByName(checkpointed(verified(left, rows, folder, width, threshold)))
    delete_path(spark, folder)  # both parts of the result are written by now
    return found


def components(docs: DataFrame, width: int = WIDTH, threshold: float = THRESHOLD) -> DataFrame:
    """``tid, component`` of every text (by its hash) that is linked to another one."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return checkpointed(connected_components(links(docs.select(F.xxhash64(text).alias("tid"), text.alias("text")), width, threshold))).withColumnRenamed("node", "tid")


def near_duplicates(docs: DataFrame, width: int = WIDTH, threshold: float = THRESHOLD) -> DataFrame:
    """One row per row of ``docs``: ``doc_id, component_id`` (the least doc_id that links reach)."""
    comps = components(docs, width, threshold)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit(""))).alias("tid"))
    texts = _named(rows.groupBy("tid").agg(F.min("doc_id").alias("least")), comps)
    named = texts.groupBy("component").agg(F.min("least").alias("component_id"))
    return rows.join(texts.join(named, "component").select("tid", "component_id"), "tid").select("doc_id", "component_id")


def representatives(docs: DataFrame, width: int = WIDTH, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` that stand for their group of near-duplicates: one of each, with the least doc_id.

    Rows without a doc_id stand for a group only if all its ids are null. Rows that share an id but not a
    text are rows of their own; of those equal in id and text, the one whose other columns hash least stays.
    """
    comps = components(docs, width, threshold)
    others = [F.col(f"`{c}`") for c, kind in docs.dtypes if c not in ("doc_id", "text") and not kind.startswith(("map", "variant"))]
    marked = docs.withColumn("tid_", F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit(""))))
    marked = marked.withColumn("rid_", F.xxhash64("tid_", F.col("doc_id").isNull(), "doc_id", *others))
    slim = marked.select(F.col("tid_").alias("tid"), F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", F.col("tid_").alias("t"), F.col("rid_").alias("rid")).alias("row"))
    best = _named(slim.groupBy("tid").agg(F.min("row").alias("row")), comps).groupBy("component").agg(F.min("row").alias("row"))
    keep = checkpointed(best.select(F.col("row.rid").alias("rid_")))
    return marked.join(keep, "rid_", "left_semi").dropDuplicates(["rid_"]).select(*[f"`{c}`" for c in docs.columns])
