import pytest

from footfall.llm import decontaminate as D
from tests.compare import assert_same, connect

ITEM = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron"


def test_query_matches_sql(spark):
    sf = "/root/testdata/sf0.01"
    assert_same(D.op2_benchmark_decontamination(spark, sf).toPandas(), connect(sf).execute(D.SQL["op2_benchmark_decontamination"]).df())


@pytest.mark.parametrize("few", [200_000, 0])
def test_threshold_is_exact(spark, few):
    items = spark.createDataFrame([(1, ITEM), (2, ITEM.upper() + "!"), (3, "too short"), (None, "x"), (4, None)], "item_id long, text string")
    filler = " ".join(f"w{i}" for i in range(3000))
    words = ITEM.split()
    docs = [(10, f"{filler} {ITEM} {filler}"), (11, " ".join([*words[:13], "CHANGED", words[14]])), (12, " ".join([*words[:7], "changed", *words[8:]])), (13, None), (14, ""), (None, ITEM), (10, ITEM), (15, ITEM.replace(" ", ",\n"))]
    got = D.contaminated(spark.createDataFrame(docs, "doc_id long, text string"), items, few=few).collect()
    # 11 shingles; 9 are needed. 13 words in a row hold 9 of them; one change in the middle leaves 6.
    assert {(r.doc_id, r.item_id): r.shared for r in got} == {(10, 1): 11, (11, 1): 9, (None, 1): 11, (15, 1): 11}


def test_short_items_and_shared_ids(spark):
    items = spark.createDataFrame([(1, "Too short!"), (2, "one"), (3, ITEM)], "item_id long, text string")
    half = ITEM.split()
    docs = [(1, "this is too short, they say"), (2, "short too"), (3, "and one more"), (4, " ".join(half[:9])), (4, " ".join(half[5:])), (4, ITEM), (5, "ones")]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = D.contaminated(df, items).collect()
    assert {(r.doc_id, r.item_id): r.shared for r in got} == {(1, 1): 1, (3, 2): 1, (4, 3): 11}
    assert sorted(r.text for r in D.clean(df, items).collect()) == sorted([docs[1][1], docs[3][1], docs[4][1], docs[6][1]])


def test_sketches_lose_nothing(spark):
    """A sketch meets every set that holds the threshold's share of the item."""
    items = spark.createDataFrame([(i, " ".join(f"t{i}x{j}" for j in range(5 + 3 * i))) for i in range(1, 30)], "item_id long, text string")
    shingles = D.item_shingles(items).collect()
    sketch = {}
    for r in D.sketches(D.item_shingles(items)).collect():
        sketch.setdefault(r.item_id, set()).add(r.h)
    for item in range(1, 30):
        own = {r.h for r in shingles if r.item_id == item}
        need = -(-8 * len(own) // 10)
        assert len(sketch[item]) >= min(len(own), len(own) - need + 1)


def test_odd_input(spark, odd_docs, no_docs):
    items = spark.createDataFrame([(1, "the cat sat on the mat and looked at the dog"), (None, None)], "item_id long, text string")
    assert {r.doc_id for r in D.contaminated(odd_docs, items).collect()} == {0, 5}
    assert D.contaminated(no_docs, items).count() == 0
    assert D.contaminated(odd_docs, items.limit(0)).count() == 0
