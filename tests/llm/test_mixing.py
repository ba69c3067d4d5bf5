import hashlib
import re

import pytest
from pyspark.sql import functions as F

from footfall.llm import mixing as M
from tests.compare import assert_same, connect


def waterfill(sizes, weights=(5, 2, 1), cap=3):
    """Sharing the excess again and again, source by source."""
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    total, full = sum(sizes.values()), {}
    while True:
        rest = [s for s in names if s not in full]
        left, sum_w = total - sum(full.values()), sum(w[s] for s in rest)
        over = [s for s in rest if left * w[s] / sum_w > cap * sizes[s]]
        if not over:
            return full | {s: left * w[s] / sum_w for s in rest}
        full |= {s: cap * sizes[s] for s in over}


@pytest.mark.parametrize("sizes", [{"a": 100, "b": 100, "c": 100}, {"a": 1, "b": 2, "c": 1000, None: 3}, {"a": 1, "b": 1, "c": 1, "d": 500, "e": 1, "é": 9}, {"z": 5}, {"a": 0, "b": 10}])
def test_targets(spark, sizes):
    df = spark.createDataFrame(list(sizes.items()), "source string, size long")
    got = {r.source: r.target for r in M.targets(df).collect()}
    assert got == pytest.approx(waterfill(sizes))


def test_query_matches_sql(spark):
    sf = "/root/testdata/sf0.01"
    assert_same(M.op4_mix_sources(spark, sf).toPandas(), connect(sf).execute(M.SQL["op4_mix_sources"]).df())


def by_hand(docs, seed=M.SEED):
    """Copies of each (doc_id, source, size, text) by sorting every source whole."""
    sizes = {}
    for _, s, n, _ in docs:
        sizes[s] = sizes.get(s, 0) + n
    target, out = waterfill(sizes), {}
    for s in sizes:
        want = min(3.0, target[s] / sizes[s]) if sizes[s] else 0.0
        base, pi, order = int(want), want - int(want), []
        for d, src, n, text in docs:
            if src == s:
                out[d] = base
                u = (int(hashlib.md5(f"{seed}:{d}:{hashlib.md5((text or str()).encode()).hexdigest()}".encode()).hexdigest()[:13], 16) + 0.5) / 2**52
                if pi > 0 and n:
                    order.append(((u / (1 - u)) / (pi / (1 - pi)), d, n))
        room, upto = target[s] - base * sizes[s], 0
        for _, d, n in sorted(order):
            if 2 * upto + n > 2 * room:
                break
            upto += n
            out[d] += 1
    return out


@pytest.mark.parametrize("slices", [1024, 2])
def test_border_is_found_without_sorting_a_source(spark, slices):
    docs = [(i, "abc"[i % 7 % 3], (i * 37) % 50, " ".join(["w"] * ((i * 37) % 50))) for i in range(400)]
    df = spark.createDataFrame([(d, text, s) for d, s, _, text in docs], "doc_id long, text string, source string")
    ranked, goal, _ = M.plan(df, slices=slices)
    got = {r.doc_id: r.copies for r in M.decide(ranked, goal, slices).collect()}
    assert got == by_hand(docs)


def test_importance_makes_documents_likelier(spark):
    df = spark.range(2000).select(F.col("id").alias("doc_id"), F.lit("a b c d").alias("text"), F.when(F.col("id") % 4 == 0, "s").otherwise("t").alias("source"), F.when(F.col("id") % 3 == 0, 9.0).otherwise(1.0).alias("w"))
    out = M.mixed(df, importance="w").groupBy((F.col("doc_id") % 3 == 0).alias("heavy"), "source").count().collect()
    n = {(r.heavy, r.source): r["count"] for r in out}
    assert n[True, "t"] > 2 * n[False, "t"] and max(r["count"] for r in M.mixed(df, importance="w").groupBy("doc_id").count().collect()) <= 3


def test_rows_without_an_id_draw_for_themselves(spark):
    """Half of a source is one row many times over, without an id: the source still meets its target."""
    rows = [(None, "a b c d", "s")] * 500 + [(i, f"a b c {i}", "s") for i in range(500)] + [(1000 + i, f"x y {i}", "t") for i in range(400)] + [(None, f"only {i}", "t") for i in range(100)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(5)
    df = M.checkpointed(df)
    ranked, goal, _ = M.plan(df)
    target = {r.source: r.target for r in goal.collect()}
    taken = {r.source: r.n for r in M.decide(ranked, goal).groupBy("source").agg(F.sum(F.col("copies") * F.col("size")).alias("n")).collect()}
    assert all(abs(taken[s] - target[s]) <= 4 for s in "st")
    got = sorted(str(r) for r in M.mixed(df).collect())
    assert got == sorted(str(r) for r in M.mixed(M.checkpointed(df.repartition(3))).collect()) and len(got) > 900


def test_odd_input(spark, odd_docs, no_docs):
    ranked, goal, _ = M.plan(odd_docs)
    rows = M.decide(ranked, goal).collect()
    assert len(rows) == odd_docs.count() and all(0 <= r.copies <= 3 for r in rows)
    words = {r.doc_id: r.size for r in rows}
    assert words[1] == words[2] == words[3] == 0 and words[0] == 16 and words[4] == 60_000
    assert M.mixed(odd_docs).columns == odd_docs.columns
    again = M.mixed(odd_docs).select("doc_id", "source").collect()
    assert sorted(map(str, again)) == sorted(map(str, M.mixed(odd_docs.repartition(7)).select("doc_id", "source").collect()))
    assert M.mixed(no_docs).count() == 0


def test_word_count(spark):
    texts = ["", " ", "a", " a  b\n", "\x0b\x0ca b c", None, "\t\n\r"]
    got = [r[0] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(M.word_count(F.col("t"))).collect()]
    assert got == [len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for t in texts]
