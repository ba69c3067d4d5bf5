"""Operator 5: token ids in binary shards with a minimal perfect hash index.

Layout of a folder: a shard's ``.bin`` holds nothing but ids (little-endian, 16 bits where the vocabulary
allows, else 32), document after document in ascending doc_id order, shard after shard; its ``.key`` holds
the documents' ids in that order, for readers that go through all of them; its ``.idx`` maps a doc_id to
its payload by a minimal perfect hash: levels of bits in records of 512 with the rank of the first, slots
with a fingerprint of the key and the document's number, and the documents' offsets. A key costs a record
or few of 72 bytes, a slot of 8 and two offsets of 8, whatever the shard holds. ``manifest`` is a Parquet
table with a row per shard, its number of ids and its least and greatest doc_id, by which `lookup` finds a
key's shard. `read_shards` fetches every document by its key in this way, a shard at a time.

Rows are range-partitioned by (doc_id, text hash), encoded in that order where they land, and a task
closes a shard once it holds ``shard_chars`` bytes of text: shards are cut by size, not by rows, whatever
runs of long documents there are, and a partition holds up to ``SHARDS_A_PART`` of them. They are written under a task's own name and moved into place, and the
manifest is written last, so lost or repeated tasks leave the same files and a broken run no manifest.
Paths may be of any scheme pyarrow opens.

Cases: a null text is encoded as an empty one (its end id alone); rows without a doc_id come first and
are not in the index; rows that repeat a doc_id are all written, and the index leads to the first of
them; an empty table gives no shard; extra columns are ignored; texts are never cut.
"""

from __future__ import annotations

import json
import os
import re
import sys
import uuid
import zlib
from array import array
from collections.abc import Callable, Iterator

import numpy as np
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from footfall.session import shared_dir, table

TOKENIZER, END_ID = "byte_bpe_50k.json", 2
#: Bytes of text after which a shard is closed.
SHARD_CHARS = 16_000_000
#: Shards of a partition where there are more than the session's shuffle partitions.
SHARDS_A_PART = 64
#: Rows of a batch between the JVM and Python: a batch of long texts is held on both sides.
BATCH_ROWS = 500
#: Pieces of text in each of the two generations that an encoder remembers, and the longest of them.
MEMO, LONGEST = 250_000, 48
MAGIC = b"FFTB0003"
#: Bits of a record of the hash, and its 64-bit words: the bits and the rank.
RECORD, WORDS = 512, 9

# --------------------------------------------------------------------------- encoding

# Letters and digits below U+0250, and the byte-level splitting rule for texts of such signs alone.
_L, _N = "A-Za-zªµºÀ-ÖØ-öø-ɏ", "0-9²³¹¼½¾"
_PIECE = re.compile(rf"'(?:[stmd]|re|ve|ll)| ?[{_L}]+| ?[{_N}]+| ?[^\s{_L}{_N}]+|\s+(?!\S)|\s+")
_ODD = re.compile(r"[^\t\n\r\x20-\x7e\xa1-ɏ]")
#: Places where a text may be cut in two without a change of its ids: before one space between letters.
_CUT = re.compile(r"(?<=[A-Za-z])(?= [A-Za-z])")


def _byte_signs() -> dict[int, str]:
    """The sign that stands for each byte in a byte-level vocabulary: itself if it prints, else the next one from U+0100 on."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    hidden = sorted(set(range(256)) - set(shown))
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}


class Encoder:
    """Whole texts to packed ids with the tokenizers library, remembering the pieces it has met.

    A byte-level tokenizer first splits a text into pieces and encodes each by itself. Texts of common
    signs are split here by the same rule, and each new piece goes to the library's model; texts with other
    signs or special tokens, and tokenizers of other kinds, are encoded as they are. Pieces are remembered
    in two generations: when the younger is full it becomes the older, so those in use are never forgotten.
    """

    def __init__(self, tokenizer: str = TOKENIZER):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        if not os.path.exists(tokenizer):
            import public_tokenizers

            tokenizer = public_tokenizers.path(tokenizer)
        self.tok = Tokenizer.from_file(tokenizer)
        kind = json.loads(self.tok.to_str())
        pre = kind.get("pre_tokenizer") or {}
        self.by_piece = kind.get("normalizer") is None and kind.get("post_processor") is None and pre.get("type") == "ByteLevel" and bool(pre.get("use_regex")) and not pre.get("add_prefix_space")
        self.dtype = np.dtype("<u2") if max(self.tok.get_vocab(with_added_tokens=True).values(), default=0) < 65536 else np.dtype("<u4")
        self.special = [t["content"] for t in kind.get("added_tokens", [])]
        self.signs, self.model = _byte_signs(), self.tok.model
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    @classmethod
    def of_worker(cls, tokenizer: str = TOKENIZER) -> Encoder:
        """The one encoder that a Python process keeps for a tokenizer, with what it has learned."""
        kept = sys.__dict__.setdefault("_footfall_encoders", {})
        if tokenizer not in kept:
            kept[tokenizer] = cls(tokenizer)
        return kept[tokenizer]

    def _learn(self, pieces: list[str]) -> None:
        for piece in pieces:
            ids = self.old.get(piece)
            if ids is None:
                found = self.model.tokenize(piece.encode().decode("latin-1").translate(self.signs))
                ids = array("H" if self.dtype.itemsize == 2 else "I", [t.id for t in found]).tobytes()
            self.young[piece] = ids

    def _pieces(self, text: str) -> bytes:
        pieces = _PIECE.findall(text)
        try:
            return b"".join(map(self.young.__getitem__, pieces))
        except KeyError:
            pass
        self._learn([p for p in set(pieces) if p not in self.young])
        out = b"".join(map(self.young.__getitem__, pieces))
        if len(self.young) > MEMO:
            self.old, self.young = {p: v for p, v in self.young.items() if len(p) <= LONGEST}, {}
        return out

    def encode(self, text: str, at_once: int = 500_000) -> bytes:
        """Packed ids of the whole text."""
        if not self.by_piece or _ODD.search(text) or any(s in text for s in self.special):
            return np.array(self.tok.encode_batch_fast([text], add_special_tokens=False)[0].ids, self.dtype).tobytes()
        parts, at = [], 0
        while len(text) - at > at_once:
            cut = _CUT.search(text, at + at_once)
            if not cut:
                break
            parts.append(self._pieces(text[at : cut.start()]))
            at = cut.start()
        return b"".join([*parts, self._pieces(text[at:])])


# --------------------------------------------------------------------------- index


def _mix(keys: np.ndarray, seed: int) -> np.ndarray:
    """64-bit finaliser of each key under a seed."""
    x = keys.astype(np.int64).view(np.uint64) + np.uint64((seed * 0x9E3779B97F4A7C15 + 0x632BE59BD9B4E019) % 2**64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class PerfectHash:
    """Minimal perfect hash of distinct int64 keys by bit levels: a key sits on the first level where it is alone."""

    def __init__(self, levels: list[np.ndarray]):
        self.levels = levels  # arrays of bool
        sizes = [int(x.sum()) for x in levels]
        self.before = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
        self.ranks = [np.cumsum(x) - x for x in levels]

    @classmethod
    def build(cls, keys: np.ndarray, gamma: float = 2.0, most: int = 64) -> PerfectHash:
        levels, left = [], keys
        while len(left):
            if len(levels) == most:
                raise ValueError("keys are not distinct")
            size = max(64, int(gamma * len(left)))
            at = (_mix(left, len(levels)) % np.uint64(size)).astype(np.int64)
            alone = np.bincount(at, minlength=size) == 1
            levels.append(alone)
            left = left[~alone[at]]
        return cls(levels)

    def slots(self, keys: np.ndarray) -> np.ndarray:
        """Slot of each key; -1 where no level holds it."""
        out, open_ = np.full(len(keys), -1, np.int64), np.arange(len(keys))
        for n, (bits, rank) in enumerate(zip(self.levels, self.ranks, strict=True)):
            if not len(open_):
                break
            at = (_mix(keys[open_], n) % np.uint64(len(bits))).astype(np.int64)
            hit = bits[at]
            out[open_[hit]] = self.before[n] + rank[at[hit]]
            open_ = open_[~hit]
        return out


def _fingerprint(keys: np.ndarray) -> np.ndarray:
    return (_mix(keys, 1_000_003) >> np.uint64(32)).astype("<u4")


def _records(levels: list[np.ndarray]) -> list[np.ndarray]:
    """Each level's bits in rows of 8 words, with the number of bits set before the row (in levels before, too) as the ninth."""
    out, before = [], 0
    for bits in levels:
        rows = -(-len(bits) // RECORD)
        words = np.packbits(np.r_[bits, np.zeros(rows * RECORD - len(bits), bool)], bitorder="little").view("<u8").reshape(rows, WORDS - 1)
        held = np.bitwise_count(words).sum(1, dtype=np.int64)
        rank = before + np.cumsum(held) - held
        out.append(np.c_[words, rank.astype("<u8")])
        before += int(held.sum())
    return out


def index_bytes(keys: np.ndarray, nulls: int, offsets: np.ndarray, dtype: np.dtype) -> bytes:
    """The index file of a shard whose documents have ``keys`` in order, after ``nulls`` documents without one."""
    distinct, first = np.unique(keys, return_index=True)
    mph = PerfectHash.build(distinct)
    slot = mph.slots(distinct)
    slots = np.zeros((len(distinct), 2), "<u4")
    slots[slot, 0], slots[slot, 1] = first + nulls, _fingerprint(distinct)
    parts = [r.astype("<u8").tobytes() for r in _records(mph.levels)] + [slots.tobytes(), offsets.astype("<u8").tobytes()]
    head = {"levels": [len(x) for x in mph.levels], "keys": len(distinct), "docs": len(keys) + nulls, "nulls": nulls, "dtype": dtype.str}
    text = json.dumps(head).encode()
    return MAGIC + len(text).to_bytes(4, "little") + text + b"".join(parts)


class Index:
    """A shard's index, read where it lies: ``read(at, size)`` gives bytes of its file.

    A key that the shard does not hold passes for one it does with a chance of 2 ** -32.
    """

    def __init__(self, read: Callable[[int, int], bytes] | bytes):
        if isinstance(read, bytes):
            raw = read
            read = lambda at, size: raw[at : at + size]
        self.read = read
        first = read(0, 12)
        if first[:8] != MAGIC:
            raise ValueError("not an index file")
        n = int.from_bytes(first[8:12], "little")
        self.head = json.loads(read(12, n))
        self.dtype = np.dtype(self.head["dtype"])
        self.levels, at = [], 12 + n
        for bits in self.head["levels"]:
            self.levels.append((bits, at))
            at += -(-bits // RECORD) * WORDS * 8
        self.slots_at, self.offsets_at = at, at + 8 * self.head["keys"]

    def payload(self, key: int) -> tuple[int, int] | None:
        """Where the ids of a key's document begin and end (in ids); None if the shard does not hold it."""
        one = np.array([key], np.int64)
        for n, (bits, at) in enumerate(self.levels):
            place = int(_mix(one, n)[0] % np.uint64(bits))
            row = np.frombuffer(self.read(at + place // RECORD * WORDS * 8, WORDS * 8), "<u8")
            word, bit = divmod(place % RECORD, 64)
            if not int(row[word]) >> bit & 1:
                continue
            slot = int(row[-1]) + int(np.bitwise_count(row[:word]).sum()) + (int(row[word]) & ((1 << bit) - 1)).bit_count()
            number, mark = np.frombuffer(self.read(self.slots_at + 8 * slot, 8), "<u4")
            if mark != _fingerprint(one)[0]:
                return None
            a, b = np.frombuffer(self.read(self.offsets_at + 8 * int(number), 16), "<u8")
            return int(a), int(b)
        return None

    def find(self, keys: np.ndarray) -> np.ndarray:
        """`payload` for many keys at once, by the whole index: the number in the shard of each key's document, -1 where it holds none."""
        keys = np.asarray(keys, np.int64)
        slot, open_ = np.full(len(keys), -1, np.int64), np.arange(len(keys))
        for n, (bits, at) in enumerate(self.levels):
            if not len(open_):
                break
            rows = np.frombuffer(self.read(at, -(-bits // RECORD) * WORDS * 8), "<u8").reshape(-1, WORDS)
            place = (_mix(keys[open_], n) % np.uint64(bits)).astype(np.int64)
            row, word, bit = rows[place // RECORD], place % RECORD // 64, (place % 64).astype(np.uint64)
            mine = row[np.arange(len(row)), word]
            hit = (mine >> bit) & np.uint64(1) == 1
            before = np.where(np.arange(WORDS - 1) < word[:, None], np.bitwise_count(row[:, :-1]), 0).sum(1, dtype=np.int64)
            rank = row[:, -1].astype(np.int64) + before + np.bitwise_count(mine & ((np.uint64(1) << bit) - np.uint64(1)))
            slot[open_[hit]] = rank[hit]
            open_ = open_[~hit]
        slots = np.frombuffer(self.read(self.slots_at, 8 * self.head["keys"]), "<u4").reshape(-1, 2)
        ok = slot >= 0
        ok[ok] = slots[slot[ok], 1] == _fingerprint(keys[ok])
        out = np.full(len(keys), -1, np.int64)
        out[ok] = slots[slot[ok], 0]
        return out

    def offsets(self) -> np.ndarray:
        """Where each document's ids begin, and the end of the last."""
        return np.frombuffer(self.read(self.offsets_at, 8 * (self.head["docs"] + 1)), "<u8").astype(np.int64)


# --------------------------------------------------------------------------- shards


def _place(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


class _ShardWriter:
    """Writes one shard under a name of its own and moves it into place when it is whole."""

    KINDS = (".bin", ".key", ".idx")

    def __init__(self, out: str, part: int, number: int, dtype: np.dtype):
        self.fs, base = _place(out)
        self.part, self.number, self.dtype, self.name = part, number, dtype, f"shard-{part:06d}-{number:06d}"
        self.path, self.tmp = f"{base}/{self.name}", f"{base}/.{self.name}.{uuid.uuid4().hex}"
        self.fs.create_dir(base, recursive=True)
        self.bin = self.fs.open_output_stream(self.tmp + ".bin")
        self.keys, self.ends = array("q"), array("q", [0])
        self.nulls, self.ids, self.bytes = 0, 0, 0

    def add(self, key: int | None, body: bytes, size: int) -> None:
        self.bin.write(body)
        self.ids += len(body) // self.dtype.itemsize
        self.bytes += size
        self.ends.append(self.ids)
        if key is None:
            self.nulls += 1
        else:
            self.keys.append(key)

    def close(self) -> dict:
        self.bin.close()
        keys = np.array(self.keys, np.int64)
        with self.fs.open_output_stream(self.tmp + ".key") as f:
            f.write(keys.astype("<i8").tobytes())
        with self.fs.open_output_stream(self.tmp + ".idx") as f:
            f.write(index_bytes(keys, self.nulls, np.array(self.ends, np.int64), self.dtype))
        for kind in self.KINDS:
            self.fs.move(self.tmp + kind, self.path + kind)
        low, high = (int(keys[0]), int(keys[-1])) if len(keys) else (None, None)
        return {"part": self.part, "number": self.number, "shard": self.name, "docs": len(self.ends) - 1, "ids": self.ids, "low": low, "high": high}

    def discard(self) -> None:
        """Takes away what a broken task has left under its own name."""
        self.bin.close()
        for kind in self.KINDS:
            try:
                self.fs.delete_file(self.tmp + kind)
            except FileNotFoundError:
                pass


def _parts(spark: SparkSession, shards: int) -> int:
    """A partition a shard up to the session's shuffle partitions, and beyond that of ``SHARDS_A_PART`` shards at most."""
    return max(1, min(shards, max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-shards // SHARDS_A_PART))))


MANIFEST = "part int, number int, shard string, docs long, ids long, low long, high long"


def write_shards(docs: DataFrame, out: str, tokenizer: str = TOKENIZER, end_id: int = END_ID, shard_chars: int = SHARD_CHARS) -> DataFrame:
    """Encodes ``docs`` into shards under ``out`` and returns the manifest, a row per shard in the order (part, number)."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    shards = -(-(rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // shard_chars)
    # Copies of one row may be a large share of all: their order is free, so their places in the input deal them out.
    order = [F.col("doc_id").asc_nulls_first(), F.col("h"), F.col("m")]
    placed = rows.withColumn("h", F.xxhash64("text")).withColumn("m", F.monotonically_increasing_id()).repartitionByRange(_parts(docs.sparkSession, shards), *order)
    ordered = placed.sortWithinPartitions(*order).select("doc_id", "text")

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        enc, part, number, writer = Encoder.of_worker(tokenizer), TaskContext.get().partitionId(), 0, None
        end, schema = np.array([end_id], enc.dtype).tobytes(), pa.schema([("part", pa.int32()), ("number", pa.int32()), ("shard", pa.string()), *[(c, pa.int64()) for c in ("docs", "ids", "low", "high")]])

        def closed() -> pa.RecordBatch:
            return pa.RecordBatch.from_pylist([writer.close()], schema)

        try:
            for batch in batches:
                for key, value in zip(batch.column(0), batch.column(1), strict=True):
                    text = value.as_py() or ""  # one text at a time is a Python object
                    if writer is not None and writer.bytes >= shard_chars:
                        done, writer, number = closed(), None, number + 1
                        yield done
                    if writer is None:
                        writer = _ShardWriter(out, part, number, enc.dtype)
                    writer.add(key.as_py(), enc.encode(text) + end, value.as_buffer().size if text else 0)
            if writer is not None:
                done, writer = closed(), None
                yield done
        finally:
            if writer is not None:
                writer.discard()

    spark, name = docs.sparkSession, "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, BATCH_ROWS)
    try:
        ordered.mapInArrow(run, MANIFEST).write.mode("overwrite").parquet(f"{out}/manifest")
    finally:
        spark.conf.set(name, before)
    return docs.sparkSession.read.schema(MANIFEST).parquet(f"{out}/manifest")


def read_shards(spark: SparkSession, out: str, at_once: int = 4_000_000) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32, found`` of every document, fetched by its key.

    The index tells where the ids of a doc_id lie; ``found`` is false, and the figures null, where it does not hold the
    doc_id. Rows that repeat a doc_id, and rows without one, are none of the index's: they are the ones that follow.
    """
    order = Window.orderBy("part", "number")  # one row per shard
    manifest = spark.read.schema(MANIFEST).parquet(f"{out}/manifest").withColumn("base", F.sum("ids").over(order) - F.col("ids"))
    n = _parts(spark, manifest.count())

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        fs, folder = _place(out)
        for batch in batches:
            for name, base in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                path = f"{folder}/{name}"
                with fs.open_input_stream(path + ".idx") as f:
                    index = Index(f.read())
                with fs.open_input_stream(path + ".key") as f:
                    keys = np.frombuffer(f.read(), "<i8")
                nulls, offsets, width = index.head["nulls"], index.offsets(), index.dtype.itemsize
                repeats = np.r_[False, keys[1:] == keys[:-1]] if len(keys) else np.zeros(0, bool)
                place = np.r_[np.arange(nulls), np.where(repeats, np.arange(nulls, nulls + len(keys)), index.find(keys))].astype(np.int64)
                found, docs = place >= 0, len(place)
                begin, end = offsets[np.maximum(place, 0)], offsets[np.maximum(place, 0) + 1]
                ids = pa.array(np.r_[np.zeros(nulls, np.int64), keys], mask=np.arange(docs) < nulls)
                with fs.open_input_file(path + ".bin") as f:
                    at, ends = 0, np.maximum.accumulate(end) if docs else end
                    while at < docs:
                        low = int(begin[at])
                        to = max(at + 1, int(np.searchsorted(ends, low + at_once, "right")))
                        low, high = int(begin[at:to].min()), int(end[at:to].max())
                        wide = np.frombuffer(f.read_at((high - low) * width, low * width), index.dtype).astype("<u4")
                        raw = memoryview(wide).cast("B")
                        crc = [zlib.crc32(raw[4 * (a - low) : 4 * (b - low)]) for a, b in zip(begin[at:to].tolist(), end[at:to].tolist(), strict=True)]
                        lost = ~found[at:to]
                        columns = [ids[at:to], pa.array(begin[at:to] + base, mask=lost), pa.array(end[at:to] - begin[at:to], mask=lost), pa.array(np.array(crc, np.int64), mask=lost), pa.array(found[at:to])]
                        yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "start", "n_tokens", "ids_crc32", "found"])
                        at = to

    return manifest.select("shard", "base").repartition(n).mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long, found boolean")


def lookup(spark: SparkSession, out: str, keys: list[int]) -> list[np.ndarray | None]:
    """The ids of each key's document, found over all shards: the manifest's key ranges name its shard, a seek its payload.

    None for a key that no shard has. For some keys at a time; join with `read_shards` for many.
    """
    fs, folder = _place(out)
    wanted = spark.createDataFrame([(int(k),) for k in dict.fromkeys(keys)], "key long")  # the caller's few
    ranges = spark.read.schema(MANIFEST).parquet(f"{out}/manifest").filter("low IS NOT NULL")
    met = ranges.join(F.broadcast(wanted), F.col("key").between(F.col("low"), F.col("high"))).select("key", "part", "number", "shard").orderBy("part", "number").collect()
    found: dict[int, np.ndarray] = {}
    for key, _, _, name in met:
        if key in found:
            continue  # an earlier shard has it
        with fs.open_input_file(f"{folder}/{name}.idx") as f:
            index = Index(lambda at, size: f.read_at(size, at))  # noqa: B023  used within this turn alone
            place = index.payload(key)
        if place is not None:
            a, b = (x * index.dtype.itemsize for x in place)
            with fs.open_input_file(f"{folder}/{name}.bin") as f:
                found[key] = np.frombuffer(f.read_at(b - a, a), index.dtype)
    return [found.get(int(k)) for k in keys]


def op5_token_binary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Writes the ids of all documents and returns the digest of each, read back from the files."""
    out = f"{shared_dir(spark)}/tokens-{uuid.uuid4().hex}"
    write_shards(table(spark, sf_dir, "documents"), out)
    return read_shards(spark, out)


QUERIES = {"op5_token_binary": op5_token_binary}
#: The encoding has no SQL form; tests/llm/test_tokenbin.py compares with the library's own ids.
SQL: dict[str, str] = {}
