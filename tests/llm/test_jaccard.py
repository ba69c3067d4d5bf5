import random

import numpy as np

import corpus_pipeline as C
from footfall.llm import jaccard as J
from tests.test_operators import union_find


def plain_set(text):
    words = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").encode().split()
    return {b" ".join(words[i : i + 5]) for i in range(max(1, len(words) - 4))}


def by_hand(docs):
    """The least id that pairs of Jaccard 0.8 or more reach, by all pairs that share a shingle."""
    sets, held, shared = {d: plain_set(t) for d, t in docs.items()}, {}, {}
    for d in sorted(sets):
        for s in sets[d]:
            for e in held.setdefault(s, []):
                shared[d, e] = shared.get((d, e), 0) + 1
            held[s].append(d)
    near = [(a, b) for (a, b), n in shared.items() if 5 * n >= 4 * (len(sets[a]) + len(sets[b]) - n)]
    return union_find([(d, d) for d in sets] + near)


def test_stage_against_all_pairs(spark):
    for sf in ("sf0.001", "sf0.01"):
        docs = spark.read.parquet(f"/root/testdata/{sf}/documents.parquet")
        want = by_hand({r.doc_id: r.text for r in docs.collect()})
        got = dict(C.STAGES)["near_dedup"](spark, docs, f"/root/testdata/{sf}")
        assert got.columns == docs.columns and sorted(r.doc_id for r in got.collect()) == sorted(set(want.values()))


def test_shingle_sets_are_those_of_the_words(monkeypatch):
    rng = random.Random(1)
    texts = ["", " ", "one", "One", "a b c d", "a b c d e", "a  b\nc\td e f", "d c b a", "x" * 300 + " y", "é b c d e"]
    texts += [" ".join(rng.choice("ab cd e Ef gh".split()) for _ in range(rng.randrange(60))) for _ in range(60)]
    want = [plain_set(t) for t in texts]
    for piece in (1 << 20, 64, 7):  # long texts are cut at white space
        monkeypatch.setattr(J, "PIECE", piece)
        got = J.shingle_sets([t.encode() for t in texts])
        assert [len(g) for g in got] == [len(w) for w in want]
        for a in range(len(texts)):
            assert all(len(np.intersect1d(got[a], got[b])) == len(want[a] & want[b]) for b in range(a))


def test_rows_that_stand_for_their_group(spark):
    text = " ".join(f"w{i}" for i in range(60))
    rows = [(3, text, "a"), (None, text, "b"), (2, text + " more", "c"), (2, "quite another text of its own here", "d"), (2, "quite another text of its own here", "d"),
            (None, "no id but words that nobody else has", "e"), (None, "no id and other words than the one above", "f"), (None, None, "g"), (9, "", "h")]
    got = J.representatives(spark.createDataFrame(rows, "doc_id long, text string, extra string")).collect()
    assert sorted(r.extra for r in got) == ["c", "d", "e", "f", "h"]


def test_chains_copies_and_passages(spark, monkeypatch):
    monkeypatch.setattr(J, "SHARE", 3)  # crowded keys are compared in shares
    monkeypatch.setattr(J, "CROSS", 0.2)  # hubs take several turns
    rng = random.Random(3)
    passage = [f"p{i}" for i in range(30)]
    docs = {}
    for g in range(12):
        words = [f"w{rng.randrange(400)}" for _ in range(rng.choice([3, 5, 6, 9, 40, 90]))]
        if g % 3 == 0:
            words = passage + words
        for _ in range(12):
            docs[len(docs)] = " ".join(words)
            words = list(words)
            for _ in range(rng.randrange(4)):
                words[rng.randrange(len(words))] = f"w{rng.randrange(400)}"
    docs |= {1000 + i: docs[40] for i in range(20)} | {2000: None, 2001: "", 2002: " \n"}
    want = by_hand(docs)
    assert 30 < len(set(want.values())) < len(docs) - 30
    df = spark.createDataFrame(list(docs.items()), "doc_id long, text string")
    for common in (0, 100_000):
        monkeypatch.setattr(J, "COMMON", common)
        assert {r.doc_id: r.component_id for r in J.near_duplicates(df).collect()} == want


def test_odd_input(spark, odd_docs, no_docs):
    got = J.near_duplicates(odd_docs).collect()
    comp = {r.doc_id: r.component_id for r in got}
    assert len(got) == odd_docs.count() and comp[5] == comp[0] == 0 and comp[1] == comp[2] == comp[3] == 1 and comp[4] == 4
    assert J.near_duplicates(no_docs).count() == 0
