from pyspark.sql import functions as F

import __spark_entry__ as entry
import corpus_pipeline as C
from footfall.llm import decontaminate, langid, mixing
from footfall.llm import pipeline as P
from tests.llm.test_jaccard import by_hand as groups
from tests.llm.test_mixing import by_hand
from tests.llm.test_tokenbin import want

SF = "/root/testdata/sf0.001"


def test_stages_against_plain_python(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, names = docs.columns, [n for n, _ in C.STAGES]
    assert names == ["language_id", "near_dedup", "decontamination", "mixing", "token_binary"]
    stage = dict(C.STAGES)

    one = stage["language_id"](spark, docs, SF).cache()
    assert one.columns == columns
    net = langid.train(docs)
    rows = {r.doc_id: r for r in docs.collect()}
    langs, scores = langid.classify(net, [r.text for r in rows.values()])
    assert {r.doc_id for r in one.collect()} == {d for d, lang, s in zip(rows, langs, scores, strict=True) if lang != "und" and s >= P.LEAST_SCORE}

    two = stage["near_dedup"](spark, one, SF).cache()
    kept = set(groups({r.doc_id: r.text for r in one.collect()}).values())
    assert two.columns == columns and sorted(r.doc_id for r in two.collect()) == sorted(kept)

    three = stage["decontamination"](spark, two, SF).cache()
    hits = {r.doc_id for r in decontaminate.contaminated(two, spark.read.parquet(f"{SF}/benchmark.parquet")).collect()}
    assert three.columns == columns and {r.doc_id for r in three.collect()} == {r.doc_id for r in two.collect()} - hits

    four = stage["mixing"](spark, three, SF).cache()
    copies = by_hand([(r.doc_id, r.source, len(r.text.split()), r.text) for r in three.collect()])
    assert four.columns == columns and {r.doc_id: r["count"] for r in four.groupBy("doc_id").count().collect()} == {d: n for d, n in copies.items() if n}

    five = stage["token_binary"](spark, four, SF).collect()
    got = sorted((r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in five)
    assert got == want(sorted((r.doc_id, r.text) for r in four.collect()))
    assert len(C.run(spark, SF).collect()) == len(five)


def test_odd_input(spark, odd_docs, no_docs):
    for docs in (odd_docs, no_docs):
        for name, f in C.STAGES:
            out = f(spark, docs, SF)
            if name != "token_binary":
                assert out.columns == docs.columns  # columns named score, size and key among them
            out.count()


def test_rows_without_an_id_or_with_one_id_are_judged_by_themselves(spark):
    item = spark.read.parquet(f"{SF}/benchmark.parquet").select("text").first().text
    words = item.split()
    rows = [(None, f"before {item} after"), (None, "a clean text without any id at all"), (4, " ".join(words[: len(words) // 2 + 2])), (4, " ".join(words[len(words) // 2 - 2 :])), (4, "clean words under a shared id")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("lang", F.lit("en"))
    got = dict(C.STAGES)["decontamination"](spark, docs, SF).collect()
    assert sorted(r.text for r in got) == sorted(t for _, t in rows[1:])


def test_registered():
    names = entry.queries()
    assert "pipeline" in names and all(any(n.startswith(f"op{i}_") for n in names) for i in range(1, 11))
    assert C.ORACLE_SQL is None and mixing.CAP == 3.0
