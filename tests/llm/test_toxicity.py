import math
import pickle

import numpy as np
from pyspark.sql import functions as F

from footfall.llm import toxicity as T


def test_sentences_cover_all_words():
    text = "One two. Three!\nFour five" + " six" * 200 + "? 7."
    got = list(T.sentences(text))
    assert [text[a:b] for a, b, _ in got[:2]] == ["One two", "Three"] and len(got) == 2 + 4 + 1
    assert {w for _, _, ws in got for w in ws} == {"one", "two", "three", "four", "five", "six", "7"}
    assert all(a <= b and text[a:b].lower().split()[0] in ws for a, b, ws in got)
    assert list(T.sentences(None)) == list(T.sentences("")) == list(T.sentences("... !?\n\n")) == []


def test_noisy_or_by_hand():
    model = T.NoisyOr({"=bad": 2.0, "^badl": 1.5}, -1.0)
    text = "bad bad badly. Good."
    places, p = model.spans(text)
    want = [1 / (1 + math.exp(-(-1 + 2 + 1.5))), 1 / (1 + math.exp(1))]
    assert np.allclose(p, want) and [text[a:b] for a, b in places] == ["bad bad badly", "Good"]
    assert abs(model.combined(p) - (1 - (1 - want[0]) * (1 - want[1]))) < 1e-12
    assert model.combined(np.zeros(0)) == 0 and 1 - 1e-9 < model.combined(np.ones(5000)) <= 1
    assert pickle.loads(pickle.dumps(model)).memo == {}


def test_gradient_lowers_the_loss_of_bags():
    """Fitted weights against a numerical gradient: at the end no single weight can be moved to a lower loss."""
    rng = np.random.default_rng(0)
    words = [f"w{i}" for i in range(6)]
    bags = [[np.flatnonzero(rng.random(6) < 0.3) for _ in range(rng.integers(1, 6))] for _ in range(300)]
    y = np.array([float(any(0 in s for s in b)) for b in bags])
    y[:6] = 1 - y[:6]
    lists = [s for b in bags for s in b]
    flat = np.concatenate(lists), np.array([len(s) for s in lists]), np.array([len(b) for b in bags])
    model = T.NoisyOr.fit([f"={w}" for w in words], *flat, y, np.ones(len(y)), rounds=3000, rate=0.02)

    def loss(w, bias):
        total = 0.0
        for b, t in zip(bags, y, strict=True):
            clean = math.prod(1 - 1 / (1 + math.exp(-(bias + sum(w[i] for i in s)))) for s in b)
            total += -T.LEAN * math.log(max(1 - clean, 1e-9)) if t else -math.log(clean)
        return total / (T.LEAN * y.sum() + (1 - y).sum()) + T.L2 / 2 * sum(x * x for x in w)

    w = [model.weights.get(f"={x}", 0.0) for x in words]
    here = loss(w, model.bias)
    for i in range(6):
        for step in (-0.3, 0.3):
            assert loss([x + step * (i == k) for k, x in enumerate(w)], model.bias) > here - 1e-4
    assert w[0] == max(w) and w[0] > 2


def test_held_out_accuracy_and_places(spark):
    sf = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    got = T.op11_toxicity(spark, sf).toPandas()
    assert len(got) == docs.count() and got.score.between(0, 1).all() and ((got.score >= 0.5) == (got.predicted == 1)).all()
    assert ((got.n_offending > 0) == (got.predicted == 1)).all()
    known = got.merge(labels.toPandas(), on="doc_id")
    out = known[known.held_out]
    caught, clean = out[out.toxic == 1], out[out.toxic == 0]
    assert len(caught) > 80 and caught.predicted.mean() > 0.85 and clean.predicted.mean() < 0.01
    texts = docs.join(spark.createDataFrame(caught[caught.predicted == 1][["doc_id"]]), "doc_id")
    model = T.train(docs, labels)
    spans = T.offending(texts, model).toPandas()
    assert set(spans.doc_id) == set(caught[caught.predicted == 1].doc_id)
    whole = {r.doc_id: r.text for r in texts.collect()}
    assert all(whole[r.doc_id][r.start : r.end] == r.sentence for r in spans.itertuples())
    english = spans[spans.sentence.str.contains("trash|pathetic|idiot|worthless|disgusting|stupid|clown|loser|scum|moron", case=False)]
    assert len(english) > 0.5 * len(spans)  # the sentences located are those with the words that toxic documents share


def test_odd_input(spark, odd_docs, no_docs):
    labels = spark.createDataFrame([(0, 0, 1), (1, 0, 0), (4, 1, 0), (4, 0, 1), (None, 1, 0), (99, 1, 0), (2, None, None), (7, 1, 0)], "doc_id long, quality int, toxic int")
    model = T.train(odd_docs.unionByName(odd_docs), labels, least_docs=1)
    renamed = odd_docs.withColumn("judged2", F.lit(1)).withColumn("t", F.col("size")).withColumn("c0", F.lit("x"))
    got = T.judged(renamed, model, ["doc_id", "score", "t", "c0", "text"])
    assert got.columns == ["doc_id", "score", "t", "c0", "text", "judged"] and got.count() == odd_docs.count()
    assert {r.judged.score for r in got.collect() if not (r.text or "").strip()} == {0.0}
    assert T.judged(no_docs, T.train(no_docs, labels.limit(0)), []).count() == 0
    one = T.train(odd_docs, labels.filter("toxic = 0"))
    assert {r.judged.score for r in T.judged(odd_docs, one, ["doc_id"]).collect()} == {0.0}
    none = T.train(odd_docs, labels.limit(0))
    assert {r.judged.score for r in T.judged(odd_docs, none, ["doc_id"]).collect()} == {0.5}
