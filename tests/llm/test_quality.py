import numpy as np

from footfall.llm import quality as Q


def test_trees_learn_and_flatten():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(4000, 6))
    y = ((x[:, 0] > 0.3) ^ (x[:, 1] * x[:, 2] > 0)).astype(float)
    model = Q.BoostedTrees.fit(x[:3000], y[:3000])
    p = model.probability(x[3000:])
    assert ((p > 0.5) == y[3000:]).mean() > 0.9 and (p >= 0).all() and (p <= 1).all()
    # The flattened walk equals a walk of one row through one tree at a time.
    b = model.bins(x[3000:3020])
    for row, got in zip(b, p[:20], strict=True):
        margin = model.base
        for f, c, v in zip(model.feature, model.cut, model.value, strict=True):
            at = 0
            while at < len(f):
                at = 2 * at + 1 + (row[f[at]] > c[at])
            margin += v[at - len(f)]
        assert abs(1 / (1 + np.exp(-margin)) - got) < 1e-12


def test_degenerate_labels():
    x = np.zeros((5, 3))
    assert np.allclose(Q.BoostedTrees.fit(x, np.ones(5)).probability(x), 0.999)
    assert np.allclose(Q.BoostedTrees.fit(x[:0], np.ones(0)).probability(x), 0.5)


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.1"
    got = Q.op7_quality_classifier(spark, sf).toPandas().merge(spark.read.parquet(f"{sf}/labels.parquet").toPandas(), on="doc_id")
    out = got[got.held_out]
    assert len(out) > 500 and (out.predicted == out.quality).mean() > 0.97
    assert ((got.score >= 0.3).astype(int) == got.predicted).all()


def test_odd_input(spark, odd_docs, no_docs):
    labels = spark.createDataFrame([(0, 1, 0), (1, 0, 0), (4, 1, 0), (4, 0, 1), (None, 1, 0), (99, 1, 0), (2, None, None)], "doc_id long, quality int, toxic int")
    model = Q.train(odd_docs, labels)
    got = Q.score(odd_docs, model, ["doc_id", "source"]).collect()
    assert len(got) == odd_docs.count() and all(0 <= r.score <= 1 for r in got)
    assert len({r.score for r in got if r.doc_id in (1, 2)}) == 1
    assert Q.score(no_docs, Q.train(no_docs, labels.limit(0)), ["doc_id"]).count() == 0


def test_statistics_have_names():
    for text in (None, "", "a", "x" * 100_000, "One two.\nOne two.\n"):
        assert len(Q.statistics(text)) == len(Q.STATISTICS) and np.isfinite(Q.statistics(text)).all()


def test_splits_against_a_slow_search():
    rng = np.random.default_rng(3)
    x = rng.normal(size=(300, 5))
    y = ((x[:, 1] > 0.3) ^ (rng.random(300) < 0.1)).astype(float)
    model = Q.BoostedTrees.fit(x, y, trees=1, depth=1, bins=16)
    b, p = model.bins(x), y.mean()
    g, h = p - y, np.full(300, p * (1 - p))
    best = {}
    for f in range(5):
        for cut in range(16):
            low = b[:, f] <= cut
            if min(low.sum(), (~low).sum()) >= Q.LEAST:
                best[f, cut] = sum(g[s].sum() ** 2 / (h[s].sum() + Q.L2) for s in (low, ~low)) - g.sum() ** 2 / (h.sum() + Q.L2)
    chosen = (int(model.feature[0, 0]), int(model.cut[0, 0]))
    assert chosen[0] == 1 and abs(best[chosen] - max(best.values())) < 1e-9


def test_trees_walked_one_row_at_a_time():
    rng = np.random.default_rng(4)
    x = rng.normal(size=(120, 4))
    model = Q.BoostedTrees.fit(x, (x[:, 0] + x[:, 2] > 0).astype(float), trees=7, depth=3, bins=8)
    for row, got in zip(model.bins(x), model.probability(x), strict=True):
        margin = model.base
        for feature, cut, value in zip(model.feature, model.cut, model.value, strict=True):
            at = 0
            for _ in range(3):
                at = 2 * at + 1 + int(row[feature[at]] > cut[at])
            margin += value[at - 7]
        assert abs(got - 1 / (1 + np.exp(-margin))) < 1e-12
