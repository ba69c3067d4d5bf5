import numpy as np

from footfall.llm import langid as L


def test_gradients():
    """Analytic gradients against differences."""
    rng = np.random.default_rng(1)
    net = L.ByteConvNet(["a", "b", "c"])
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    rows, target = rng.integers(1, 256, (4, L.WINDOW)).astype(np.uint8), np.array([0, 1, 2, 1])

    def loss():
        return -np.log(net.probabilities(rows)[np.arange(4), target]).mean()

    g = net.gradients(rows, target)
    for name in net.p:
        for _ in range(6):
            at = tuple(rng.integers(0, s) for s in net.p[name].shape)
            if name == "conv" and not net.mask[at]:
                continue
            old = net.p[name][at]
            net.p[name][at] = old + 1e-6
            up = loss()
            net.p[name][at] = old - 1e-6
            down = loss()
            net.p[name][at] = old
            assert abs((up - down) / 2e-6 - g[name][at]) < 1e-5


def test_windows_hold_every_byte():
    for text in ("", "a", "é" * 1000, "x" * L.WINDOW, "y" * (L.WINDOW + 1)):
        w, held = L.windows(text)
        assert held.sum() == len(text.encode()) and b"".join(bytes(r[:h]) for r, h in zip(w, held, strict=True)) == text.encode()


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    got = L.op8_language_id(spark, sf).toPandas().merge(spark.read.parquet(f"{sf}/documents.parquet").toPandas(), on="doc_id")
    out = got[got.held_out & got.lang.notna()]
    assert len(out) > 100 and (out.lang == out.lang_pred).mean() > 0.95
    assert got.score.between(0, 1).all()


def test_one_text_scores_alike_in_any_company():
    net = L.ByteConvNet(["a", "b"])
    texts = ["short", "long " * 500, None, "12 34", "é"]
    together = L.classify(net, texts, at_once=3)
    for i, t in enumerate(texts):
        lang, score = L.classify(net, [t])
        assert lang[0] == together[0][i] and abs(score[0] - together[1][i]) < 1e-5
    assert together[0][2] == together[0][3] == "und"


def test_odd_input(spark, odd_docs, no_docs):
    net = L.train(odd_docs)
    got = L.predict(odd_docs, net, ["doc_id", "source"]).collect()
    assert len(got) == odd_docs.count()
    assert {r.lang_pred for r in got if r.doc_id in (1, 2, 3, 7)} == {"und"}
    assert {r.lang_pred for r in got} <= {"und", "en", "de"}
    assert L.train(no_docs) is None
    assert {r.lang_pred for r in L.predict(odd_docs, None, ["doc_id"]).collect()} == {"und"}


def test_signs_that_are_no_letters(spark):
    net = L.ByteConvNet(["a", "b"])
    langs, scores = L.classify(net, ["½ ² Ⅷ", "123 _ !", "", None, "x", "é", "字"])
    assert langs[:4] == ["und"] * 4 and all(x in ("a", "b") for x in langs[4:]) and scores[:4].tolist() == [0] * 4


def test_forward_pass_against_plain_loops():
    """One text at a time, one filter at one place at a time."""
    import math

    net = L.ByteConvNet(["a", "b", "c"], seed=3)
    net.p["shift"] += [0.1, -0.2, 0.3]
    texts = ["Some words, Ünd mehr.", "x" * 300 + " long enough for two windows " * 3]
    for text, lang, score in zip(texts, *L.classify(net, texts), strict=True):
        rows, held = L.windows(text)
        logs, means = [0.0] * 3, [0.0] * 3
        for row, n in zip(rows.tolist(), held.tolist(), strict=True):
            act = []
            for f in range(net.p["conv"].shape[1]):
                best = max(
                    sum(float(net.p["embed"][row[at + k], e]) * float(net.p["conv"][k * L.EMBED + e, f]) for k in range(max(L.WIDTHS)) for e in range(L.EMBED)) for at in range(L.WINDOW - max(L.WIDTHS) + 1)
                )
                act.append(max(0.0, best + float(net.p["bias"][f])))
            z = [sum(a * float(net.p["out"][f, c]) for f, a in enumerate(act)) + float(net.p["shift"][c]) for c in range(3)]
            p = [math.exp(v - max(z)) for v in z]
            p = [v / sum(p) for v in p]
            for c in range(3):
                logs[c] += n * math.log(p[c] + 1e-9)
                means[c] += n * p[c] / int(held.sum())
        assert lang == "abc"[logs.index(max(logs))] and abs(score - means["abc".index(lang)]) < 1e-4
