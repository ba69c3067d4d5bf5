import random

from footfall.llm import linededup as L


def by_hand(docs, min_words):
    """Every pair of documents, in plain Python: what lies in a run of equal lines with enough words goes from the later one."""
    lines = {d: [(i, x.strip()) for i, x in enumerate(t.split("\n")) if x.strip()] for d, t in docs.items() if t}
    out = {}
    for d, text in docs.items():
        own, gone = lines.get(d, []), set()
        for p in (p for p in lines if p < d):
            other = [x for _, x in lines[p]]
            for i in range(len(own)):
                for j in range(len(other)):
                    if own[i][1] == other[j] and not (i and j and own[i - 1][1] == other[j - 1]):
                        n = 0
                        while i + n < len(own) and j + n < len(other) and own[i + n][1] == other[j + n]:
                            n += 1
                        if sum(len(x.split()) for _, x in own[i : i + n]) >= min_words:
                            gone |= {own[k][0] for k in range(i, i + n)}
        if not gone:
            out[d] = text
            continue
        kept = []
        for i, x in enumerate(text.split("\n")):
            beside = [max((k for k, _ in own if k < i), default=None), min((k for k, _ in own if k > i), default=None)]
            if i in gone or not x.strip() and all(k in gone for k in beside if k is not None):
                continue
            kept.append(x)
        out[d] = "\n".join(kept)
    return out


def test_patience():
    assert L.patience([0, 1, 2]) == [0, 1, 2] and L.patience([]) == [] and L.patience([3, 3, 1]) == [0, 1]
    rng = random.Random(0)
    for _ in range(200):
        a = [rng.randrange(9) for _ in range(rng.randrange(12))]
        got = [a[i] for i in L.patience(a)]
        best = [1] * len(a)
        for i in range(len(a)):
            best[i] = 1 + max((best[k] for k in range(i) if a[k] <= a[i]), default=0)
        assert got == sorted(got) and len(got) == max(best, default=0)


def test_blocks_go_by_alignments(monkeypatch):
    in_order = [(0, 2, 5), (3, 4, 9), (6, 7, 9)]
    assert L.aligned(in_order) == [0, 1, 3, 6]
    passes = []
    own = L.patience
    monkeypatch.setattr(L, "patience", lambda places: passes.append(len(places)) or own(places))
    assert L.aligned([(0, 1, 7), (1, 2, 8), (2, 3, 1), (3, 4, 2)]) == [0, 1, 2, 3] and passes[0] == 4 and len(passes) <= 3  # two blocks that changed places
    passes.clear()
    n = 20_000
    assert len(L.aligned([(i, i + 1, n - i) for i in range(n)])) == n and len(passes) <= 3  # all lines in falling order
    assert len(L.aligned([(i, i + 1, 0) for i in range(n)])) == n


def test_without_the_alignment_nothing_goes(spark, monkeypatch):
    docs = {1: "one two three four five\nown", 2: "x\none two three four five"}
    df = spark.createDataFrame(list(docs.items()), "doc_id long, text string")
    assert {r.doc_id: r.text for r in L.deduplicated(df).collect()} == {1: docs[1], 2: "x"}
    monkeypatch.setattr(L, "aligned", lambda spans: [])
    assert {r.doc_id: r.text for r in L.deduplicated(df).collect()} == docs


def test_many_partners_of_a_long_document(spark):
    """A document whose lines come from very many others meets each by its own windows alone."""
    rows = [(i, "\n".join(f"line {i * 50 + k} has just these six" for k in range(50))) for i in range(400)]
    whole = [x for _, t in rows for x in t.split("\n")]
    random.Random(3).shuffle(whole)
    df = spark.createDataFrame([*rows, (1000, "\n".join([*whole, "its own"]))], "doc_id long, text string")
    got = L.deduplicated(df).filter("doc_id = 1000").first()
    assert got.text == "its own" and got.removed == 20_000


def test_a_block_of_lines_first_seen_apart(spark):
    docs = {1: "aa bb cc\nx1", 2: "dd ee ff\nx2", 3: "aa bb cc\ndd ee ff", 4: "aa bb cc\n\ndd ee ff\nown", 5: "dd ee ff\naa bb cc\nx1 x2\ndd ee ff"}
    df = spark.createDataFrame(list(docs.items()), "doc_id long, text string")
    got = {r.doc_id: r.text for r in L.deduplicated(df).collect()}
    assert got == by_hand(docs, 5) and got[4] == "own" and got[5] == docs[5]


def test_against_plain_python(spark, monkeypatch):
    monkeypatch.setattr(L, "PAIRS_A_COPY", 3)  # crowded partners are laid out several times
    rng = random.Random(2)
    pool = [f"line number {i} has seven words here" for i in range(40)] + ["", " ", "Les.", "short one", "three words here", "and two"] * 3
    docs = {i: "\n".join(rng.choice(pool) for _ in range(rng.randrange(1, 12))) for i in range(80)}
    docs |= {100 + i: docs[3] for i in range(40)}  # a group of copies
    df = spark.createDataFrame(list(docs.items()), "doc_id long, text string")
    assert {r.doc_id: r.text for r in L.deduplicated(df).collect()} == by_hand(docs, L.MIN_WORDS)


def test_a_line_survives_somewhere(spark):
    sf = "/root/testdata/sf0.001"
    before = [r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    after = L.op10_line_dedup(spark, sf).collect()

    def lines(texts):
        return {x.strip() for t in texts for x in (t or "").split("\n")} - {""}

    assert lines(before) == lines(r.text for r in after)
    assert sum(r.removed for r in after) > 5


def test_query_against_plain_python(spark):
    sf = "/root/testdata/sf0.001"
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    assert {r.doc_id: r.text for r in L.op10_line_dedup(spark, sf).collect()} == by_hand(docs, L.MIN_WORDS)


def test_odd_input(spark, odd_docs, no_docs):
    got = L.deduplicated(odd_docs).collect()
    assert len(got) == odd_docs.count()
    text = {r.doc_id: r.text for r in got if r.doc_id is not None}
    twins = spark.createDataFrame([(None, "one two three four five"), (1, "one two three four five"), (None, "six seven eight nine ten"), (None, "x\nsix seven eight nine ten")], "doc_id long, text string")
    assert sorted(r.text for r in L.deduplicated(twins).collect())[:1] == [""] and sum(r.removed for r in L.deduplicated(twins).collect()) == 2
    assert text[5] == "" and text[1] is None and text[2] == "" and text[0].startswith("The cat") and text[3] == "   \n\t "
    assert L.deduplicated(no_docs).count() == 0
