import random

import numpy as np
import pytest
import xxhash

from footfall.llm import simhash as S
from tests.test_operators import union_find


def plain_fingerprint(text):
    words = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").replace("\t", " ").replace("\n", " ").replace("\x0b", " ").replace("\x0c", " ").replace("\r", " ").split(" ")
    words = [w for w in words if w]
    grams = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] if len(words) > 3 else [" ".join(words)] if words else []
    h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_fingerprint():
    for text in (None, "", " \n", "One", "one two", "One TWO three", "a b c d", "É à b c\td\x0be f", "x " * 5000, "nb sp is one word here"):
        assert S.fingerprint(text) % 2**64 == plain_fingerprint(text)


def clusters(seed):
    rng = random.Random(seed)
    out = set()
    for _ in range(6):
        base = rng.getrandbits(64)
        out.add(base)
        for _ in range(40):
            x = base
            for b in rng.sample(range(64), rng.choice([1, 1, 2, 2, 3, 5])):
                x ^= 1 << b
            out.add(x)
            if rng.random() < 0.3:
                base = x
    return sorted(out | {rng.getrandbits(64) for _ in range(200)} | {0})


@pytest.mark.parametrize("bucket", [2048, 3, 0])
@pytest.mark.parametrize("distance", [2, 1, 0])
def test_links_connect_all_pairs(spark, bucket, distance):
    values = np.array(clusters(distance), np.uint64).view(np.int64).tolist()
    got = [(r.src, r.dst) for r in S.links(spark.createDataFrame([(v, v) for v in values], "fp long, f0 long"), distance, bucket).collect()]
    assert all(0 < (a ^ b & (2**64 - 1)).bit_count() or a != b for a, b in got)
    near = [(a, b) for i, a in enumerate(values) for b in values[:i] if ((a ^ b) & (2**64 - 1)).bit_count() <= distance]

    def classes(pairs):
        out = {}
        for x, r in union_find(pairs).items():
            out.setdefault(r, set()).add(x)
        return sorted(map(sorted, out.values()))

    assert classes(got) == classes(near)


def test_crowded_variants_follow_the_same_rule(spark):
    rng = random.Random(5)

    def flipped(words, n):
        x = list(words)
        for b in rng.sample(range(192), n):
            x[b // 64] ^= 1 << b % 64
        return tuple(x)

    half, rows = rng.getrandbits(32), set()
    for _ in range(4):
        base = (half | rng.getrandbits(32) << 32, rng.getrandbits(64), rng.getrandbits(64))
        rows |= {base} | {flipped(base, n) for n in (1, 2, 5, 9, 14, 20, 24, 25, 30) for _ in range(4)}
    # Two within two bits of one fingerprint, far apart in the others.
    rows |= {(half, 1, 2), (half ^ 3, 2**64 - 1, 2**63 - 1)}
    words = np.array(sorted(rows), np.uint64).view(np.int64).tolist()
    df = spark.createDataFrame([(i, *w) for i, w in enumerate(words)], "fp long, f0 long, f1 long, f2 long")
    signs = sorted(rows)

    def linked(a, b):
        x = [p ^ q for p, q in zip(a, b, strict=True)]
        return any(min((w & 0xFFFFFFFF).bit_count(), (w >> 32).bit_count()) <= 1 for w in x) and sum(w.bit_count() for w in x) <= 24

    ids = [(i, i) for i in range(len(signs))]
    want = union_find(ids + [(i, j) for i, a in enumerate(signs) for j in range(i) if linked(a, signs[j])])
    assert len(set(want.values())) > 4
    for bucket in (2048, 3):
        assert union_find(ids + [(r.src, r.dst) for r in S.links(df, 24, bucket, 3).collect()]) == want


def test_query_against_all_pairs(spark):
    sf = "/root/testdata/sf0.01"
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    fps = {d: plain_fingerprint(t) for d, t in docs}
    ids = sorted(fps)
    root = union_find([(a, a) for a in ids] + [(a, b) for i, a in enumerate(ids) for b in ids[:i] if (fps[a] ^ fps[b]).bit_count() <= 2])
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in S.op9_simhash_near_dedup(spark, sf).collect()}
    assert got == {d: (f"{fps[d]:016x}", root[d]) for d in ids}


def test_odd_input(spark, odd_docs, no_docs):
    got = S.near_duplicates(odd_docs).collect()
    assert len(got) == odd_docs.count()
    comp = {r.doc_id: r.component_id for r in got}
    assert comp[5] == comp[0] == 0 and comp[1] == comp[2] == comp[3] == 1 and comp[4] == 4
    assert sum(r.doc_id == 5 for r in got) == 2
    assert S.near_duplicates(no_docs).count() == 0
