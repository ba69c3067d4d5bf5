import random
import tempfile
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from footfall.llm import tokenbin as T

TOK = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def want(rows):
    start, out = 0, []
    for key, text in rows:
        ids = [*TOK.encode(text or "", add_special_tokens=False).ids, 2]
        out.append((key, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


def test_encoder_is_the_library(monkeypatch):
    texts = [
        "Plain words, with. marks!\nAnd lines.\n", "", " ", "  two  spaces", "tab\there", "a\n\nb", "x \n y", "don't we'll I'm", "<|endoftext|> inside", "ünï çödé ñ ß", "日本語 text 12 34.5",
        "ered*** reed*** ndsh*** &&& $$", "nul\0byte", "é combining", "nbsp x", "...,,, .a ,b", " lead", "trail ", "\n", "x×y ÷z", "line sep", "١٢٣ ٤", "_under_ score_", "\x1cfs",
    ]
    enc = T.Encoder()
    for _ in range(2):
        assert [np.frombuffer(enc.encode(t), enc.dtype).tolist() for t in texts] == [TOK.encode(t, add_special_tokens=False).ids for t in texts]
    monkeypatch.setattr(T, "MEMO", 10)  # the generations change all the time
    small = T.Encoder()
    assert [small.encode(t) for t in texts * 3] == [enc.encode(t) for t in texts * 3]


def test_long_texts_and_random_signs():
    rng = random.Random(5)
    signs = "aB \n.,'\t-9²É÷ßz  \r  "
    enc = T.Encoder()
    for n in (3, 30, 300, 3000):
        for _ in range(20):
            text = "".join(rng.choice(signs) for _ in range(n))
            want_ids = TOK.encode(text, add_special_tokens=False).ids
            assert np.frombuffer(enc.encode(text), enc.dtype).tolist() == want_ids
            assert np.frombuffer(enc.encode(text, at_once=50), enc.dtype).tolist() == want_ids  # cut in many parts
    text = "x" * 30_000 + " some words" * 5000
    assert np.frombuffer(enc.encode(text, at_once=1000), enc.dtype).tolist() == TOK.encode(text, add_special_tokens=False).ids


def test_round_trip(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    out = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    manifest = T.write_shards(docs, out, shard_chars=100_000)
    assert manifest.count() > 2
    got = T.read_shards(spark, out, at_once=5000).toPandas().sort_values("doc_id")
    rows = sorted((r.doc_id, r.text) for r in docs.collect())
    assert list(got[["doc_id", "start", "n_tokens", "ids_crc32"]].itertuples(index=False, name=None)) == want(rows)
    assert got["found"].all()
    some = [k for k, _ in rows][::17]
    *ids, none = T.lookup(spark, out, [*some, -5])  # over all shards, without being told which
    assert none is None and [i.tolist()[:-1] for i in ids] == [TOK.encode(dict(rows)[k], add_special_tokens=False).ids for k in some]


def test_one_huge_text_and_very_many_equal_ids(spark):
    huge = " ".join(f"word{i}" for i in range(60_000))
    rows = [(i, f"text {i}") for i in range(300)] + [(150, huge)] + [(7, f"copy {i % 3}") for i in range(10_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    out = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    manifest = T.write_shards(docs, out, shard_chars=10_000).collect()
    assert max(m.docs for m in manifest) < 3000  # neither the copies of one id nor the long text gather what is beside them
    got = sorted((r.start, r.n_tokens, r.doc_id) for r in T.read_shards(spark, out).collect())
    assert [d for *_, d in got] == sorted(k for k, _ in rows) and all(a + n == b for (a, n, _), (b, _, _) in zip(got, got[1:]))
    ids, small, none = T.lookup(spark, out, [299, 7, 12_345])
    assert none is None and small.tolist()[:-1] in [TOK.encode(f"{t}", add_special_tokens=False).ids for t in ("text 7", "copy 0", "copy 1", "copy 2")]
    assert ids.tolist()[:-1] == TOK.encode("text 299", add_special_tokens=False).ids


@pytest.mark.parametrize("n", [0, 1, 2, 1000, 50_000])
def test_perfect_hash(n):
    keys = np.zeros(0, np.int64) if n == 0 else np.unique(np.random.default_rng(n).integers(-(2**62), 2**62, n))
    mph = T.PerfectHash.build(keys)
    assert sorted(mph.slots(keys).tolist()) == list(range(len(keys)))
    raw = T.index_bytes(keys, 0, np.arange(len(keys) + 1), np.dtype("<u2"))
    index = T.Index(raw)
    assert index.find(keys).tolist() == list(range(len(keys)))
    reads = []
    seeking = T.Index(lambda at, size: reads.append(size) or raw[at : at + size])
    some = keys[:: max(1, n // 50)]
    reads.clear()
    assert [seeking.payload(int(k)) for k in some] == [(i, i + 1) for i in range(0, len(keys), max(1, n // 50))]
    assert sum(reads) <= 72 * 12 * max(1, len(some))  # some records a key, whatever the shard holds
    strange = np.random.default_rng(1).integers(2**62, 2**63 - 1, 2000)
    assert (index.find(strange) >= 0).sum() <= 1  # fingerprints of 32 bits


def test_odd_input(spark, odd_docs, no_docs):
    out = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    T.write_shards(odd_docs, out, shard_chars=50_000)
    got = T.read_shards(spark, out).collect()
    assert len(got) == odd_docs.count() and sum(r.doc_id is None for r in got) == 2
    starts = sorted((r.start, r.n_tokens) for r in got)
    assert starts[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(starts, starts[1:]))
    assert {r.doc_id: r.n_tokens for r in got}[1] == 1
    empty = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    assert T.write_shards(no_docs, empty).count() == 0 and T.read_shards(spark, empty).count() == 0


def test_other_tokenizers_are_encoded_as_they_are():
    enc = T.Encoder("word_bpe_49k.json")
    lib = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    text = "Some Words, here.\nAnd there"
    assert list(np.frombuffer(enc.encode(text), enc.dtype)) == lib.encode(text, add_special_tokens=False).ids


def test_results_hang_on_the_hash(spark, monkeypatch):
    """Without the hash nothing is found: the rows come from the places that it gives."""
    out = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    T.write_shards(spark.createDataFrame([(i, f"text {i}") for i in range(200)], "doc_id long, text string"), out)
    with_hash = {r.doc_id: r for r in T.read_shards(spark, out).collect()}
    assert all(r.found for r in with_hash.values())
    (idx,) = __import__("glob").glob(f"{out}/*.idx")
    raw = bytearray(open(idx, "rb").read())
    index = T.Index(bytes(raw))
    slots = np.frombuffer(bytes(raw[index.slots_at : index.offsets_at]), "<u4").reshape(-1, 2).copy()
    slots[:, 0] = slots[::-1, 0]  # every key leads to another's document
    raw[index.slots_at : index.offsets_at] = slots.tobytes()
    open(idx, "wb").write(bytes(raw))
    changed = {r.doc_id: r for r in T.read_shards(spark, out).collect()}
    assert sum(changed[i].start != with_hash[i].start for i in with_hash) > 190
    slots[:, 1] ^= 1  # no fingerprint fits
    raw[index.slots_at : index.offsets_at] = slots.tobytes()
    open(idx, "wb").write(bytes(raw))
    assert not any(r.found or r.start is not None for r in T.read_shards(spark, out).collect())
    assert T.lookup(spark, out, [5]) == [None]


def test_a_partition_holds_many_shards(spark):
    out = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    docs = spark.createDataFrame([(i, "слово " * 50) for i in range(400)], "doc_id long, text string")
    manifest = T.write_shards(docs, out, shard_chars=5_000).collect()
    assert len(manifest) >= 40 and len({m.part for m in manifest}) <= 4
    assert max(m.docs for m in manifest) <= 10  # bytes are counted, not characters
    assert sorted(r.doc_id for r in T.read_shards(spark, out).collect() if r.found) == list(range(400))
