"""Candidates of the pipeline's near-dedup: fingerprints a few bits apart, keys that may be left out, and pairs that are ruled out as they meet."""

import itertools
import random

import pytest

from footfall.llm import jaccard
from tests.llm.test_jaccard import by_hand, plain_set


def test_fingerprints_two_bits_apart_are_candidates(spark):
    rows = [(1, 0b1111 << 20), (2, 0b1111 << 20), (3, (0b1111 << 20) | 1 | (1 << 40)), (4, -1), (5, 0b11)]
    got = {tuple(r) for r in jaccard._by_fingerprint(spark.createDataFrame(rows, "tid long, fp long")).collect()}
    assert got == {(2, 1), (3, 1)}


def test_keys_left_out_lose_no_meeting(spark, tmp_path):
    rng = random.Random(7)
    texts = {t: rng.sample(range(1000, 1040), 6) for t in range(120)}
    for t in range(60):  # a passage of which some texts lack a key, among keys of their own
        texts[t][3:3] = [h for h in range(20) if h % 7 or rng.random() < 0.9]
    held = {}
    for t, keys in texts.items():
        for h in keys:
            held.setdefault(h, set()).add(t)
    rows = [(h, len(held[h]), t, at) for t, keys in texts.items() for at, h in enumerate(keys) if len(held[h]) > 1]
    got = jaccard._needed(spark.createDataFrame(rows, "h long, k int, tid long, at int"), str(tmp_path)).collect()
    kept = {}
    for r in got:
        kept.setdefault(r.h, set()).add(r.tid)
    pairs = lambda keys: {p for ts in keys.values() for p in itertools.combinations(sorted(ts), 2)}
    assert pairs(kept) == pairs(held) and all(kept[h] == held[h] for h in kept)
    assert sum(h < 20 for h in kept) <= 4


def test_pairs_ruled_out_by_size_are_not_made(spark):
    """Texts that share a key but cannot be alike: before, each was paired with a hub and written."""
    rows = [(7, 64, t, t, 10 * 2**t if t < 12 else 1 << 24, 0, 0, 0, 0) for t in range(64)]
    schema = "h long, k int, tid long, component long, n int, b0 long, b1 long, b2 long, b3 long"
    seen, real = [], jaccard._open
    try:
        jaccard._open = lambda pairs, whole, threshold: seen.append(pairs.count()) or pairs
        jaccard._held_against_hubs(spark.createDataFrame(rows, schema).filter("tid < 12"), None, 0.8, 0).count()
    finally:
        jaccard._open = real
    assert seen == [0]


@pytest.mark.parametrize(("fine", "first"), [(128, 32), (2, 3)])
def test_texts_apart_are_not_paired_in_every_key(spark, monkeypatch, fine, first):
    """Copies of one text with some words changed: before, each two of them were made once for each key that they share."""
    monkeypatch.setattr(jaccard, "CROSS", 1e9)  # no further hubs: all that the first ones leave is compared
    monkeypatch.setattr(jaccard, "FINE", fine, raising=False)
    monkeypatch.setattr(jaccard, "FIRST", first, raising=False)
    rng, docs = random.Random(5), {}
    for t in range(60):
        words = [f"w{i}" for i in range(400)]
        for i in rng.sample(range(400), rng.randrange(3, 18)):
            words[i] = f"own{t}x{i}"
        docs[t] = " ".join(words)
    sets = {t: plain_set(text) for t, text in docs.items()}
    near = sum(5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]) for a, b in itertools.combinations(docs, 2))
    made, real = [], jaccard._met_across

    def counted(*args):
        kind = type(args[0])
        with monkeypatch.context() as m:
            m.setattr(kind, "distinct", lambda df: df)
            made.append(real(*args).count())
        return real(*args)

    monkeypatch.setattr(jaccard, "_met_across", counted)
    got = {r.doc_id: r.component_id for r in jaccard.near_duplicates(spark.createDataFrame(list(docs.items()), "doc_id long, text string")).collect()}
    assert got == by_hand(docs) and 10 < near < 600
    print("MADE", made, near)
    assert fine < 128 or made[0] <= near


def test_parities_of_long_texts_fold(spark):
    rng = random.Random(11)
    odd = {n: [rng.getrandbits(64) - (1 << 63) for _ in range(n)] for n in (4, 128, 512)}
    got = spark.createDataFrame([(n, w) for n, w in odd.items()], "n int, odd array<long>").select("n", jaccard._folded("odd").alias("odd")).collect()
    fold = lambda w: [w[i] ^ w[i + 128] ^ w[i + 256] ^ w[i + 384] for i in range(128)] if len(w) == 512 else w
    assert {r.n: r.odd for r in got} == {n: fold(w) for n, w in odd.items()}
