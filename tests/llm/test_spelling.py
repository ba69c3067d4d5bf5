import random
import zlib
from collections import Counter

import pytest
import regex
from pyspark.sql import functions as F

from footfall.llm import spelling as S
from tests.compare import assert_same, connect

COLUMNS = ["word", "form", "root", "n", "n_near", "form_n"]


def _near(a, b):
    """One letter inserted, deleted or replaced, by trying all places."""
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    return len(b) - len(a) == 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def _counts(docs):
    out = Counter()
    for doc_id, text in docs:
        for run in regex.findall("[A-Za-zÀ-ÿ]+", text or ""):
            w = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{w}".encode())
            if h % 31 == 0:
                w = w[: h % len(w)] + w[h % len(w) + 1 :]
            out[w] += len(w) >= 7
    return {w: n for w, n in out.items() if n >= 2}


def _all_pairs(counts):
    near = {a: [b for b in counts if _near(a, b)] for a in counts}
    best = {a: min(bs, key=lambda b: (-counts[b], b)) for a, bs in near.items() if bs}
    form = {a: b for a, b in best.items() if counts[b] >= 10 * counts[a]}
    rows = set()
    for w, n in counts.items():
        root = w
        while root in form:
            root = form[root]
        rows.add((w, form.get(w), root, n, len(near[w]), counts[form[w]] if w in form else None))
    return rows


def _rows(df):
    return [tuple(r[c] for c in COLUMNS) for r in df.collect()]


@pytest.mark.parametrize("longest", [64, 9, 6])
def test_near_words_against_all_pairs(spark, longest):
    rng = random.Random(longest)
    words = {"".join(rng.choice("abcé") for _ in range(rng.randint(5, 12))) for _ in range(500)}
    words |= {"a" * n for n in range(5, 14)} | {"ab" * n for n in range(3, 7)} | {"abab" + "c" * n for n in range(3, 8)} | {"zzzzzÿz", "àzzzzzz", "÷×÷×÷×÷"}
    df = spark.createDataFrame([(w,) for w in words], "word string")
    got = [tuple(r) for r in S.near_words(df, longest).select("word", "near").collect()]
    assert len(got) == len(set(got))
    assert set(got) == {(a, b) for a in words for b in words if _near(a, b)}


def test_forms_and_roots_follow_chains(spark):
    counts = {"aaaaaaa": 2, "aaaaaab": 20, "aaaaabb": 200, "aaaabbb": 2000, "aaaabbbb": 2000, "zzzzzzz": 5, "zzzzzzy": 49, "zzzzzzx": 50}
    words = spark.createDataFrame(list(counts.items()), "word string, n long")
    assert set(_rows(S.variant_forms(words, S.near_words(words)))) == _all_pairs(counts)


def test_query_against_all_pairs_and_sql(spark, tmp_path):
    rng = random.Random(5)
    base = ["".join(rng.choice("etaonéü") for _ in range(rng.randint(6, 10))) for _ in range(60)]
    docs = [(i, " ".join(rng.choices(base, weights=range(1, 61), k=rng.randint(0, 300))).title()) for i in range(200)]
    docs += [(7, docs[7][1]), (None, "Repeated"), (None, None), (300, None), (301, ""), (302, "x" * 200_000 + " " + "y" * 70), (303, "x" * 199_999 + "! " + "y" * 71 + " " + "y" * 69 + "z")]
    docs += [(304, "x" * 200_000 + " " + "x" * 199_999 + " " + "y" * 70 + " " + "y" * 71 + " " + "y" * 69 + "z")]
    extra = spark.createDataFrame(docs, "doc_id long, text string").withColumn("word", F.lit("clash")).withColumn("n", F.lit(1))
    extra.write.parquet(str(tmp_path / "documents.parquet"))
    for t in "region nation customer supplier part orders lineitem events embeddings pages benchmark labels conversations".split():
        (tmp_path / f"{t}.parquet").symlink_to(f"/root/testdata/sf0.001/{t}.parquet")
    got = _rows(S.op12_spelling_variants(spark, str(tmp_path)))
    assert len(got) == len(set(got)) and set(got) == _all_pairs(_counts(docs)) and len(got) > 100


def test_query_against_sql(spark):
    sf = "/root/testdata/sf0.001"
    ours = S.op12_spelling_variants(spark, sf).toPandas()
    assert_same(ours, connect(sf).execute(S.SQL["op12_spelling_variants"]).df())
    assert len(ours) > 500 and ours.form.notna().sum() >= 10


def test_odd_input(spark, odd_docs, no_docs):
    words = S.word_counts(odd_docs, 2)
    assert S.variant_forms(words, S.near_words(words.filter("length(word) > 3"))).count() == words.count()
    none = S.word_counts(no_docs)
    assert S.variant_forms(none, S.near_words(none)).count() == 0
