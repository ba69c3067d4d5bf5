import uuid

from pyspark.sql import functions as F

from footfall.llm import rollups as R
from footfall.session import shared_dir
from tests.compare import assert_same, connect


def totals(r):
    return {(x.source, x.lang, x.version): (x.docs, x.tokens) for x in r.totals().collect()}


def test_query_matches_sql(spark):
    sf = "/root/testdata/sf0.01"
    assert_same(R.op3_token_counts(spark, sf).toPandas(), connect(sf).execute(R.SQL["op3_token_counts"]).df())


def test_batches(spark):
    roll = R.Rollup(spark, f"{shared_dir(spark)}/r-{uuid.uuid4().hex}")
    assert totals(roll) == {}
    cols = "source string, lang string, version string, tokens long, after long"
    first = spark.createDataFrame([("a", "en", "v", 5, 7), ("a", "en", "v", 3, 3), (None, None, "v", 0, 2)], cols)
    assert roll.commit("1", R.inserts(first))
    assert totals(roll) == {("a", "en", "v"): (2, 8), (None, None, "v"): (1, 0)}
    assert not roll.commit("1", R.inserts(first))
    assert roll.commit("2", R.revisions(first, "tokens", "after"))
    assert totals(roll) == {("a", "en", "v"): (2, 10), (None, None, "v"): (1, 2)}
    assert roll.commit("empty", R.inserts(first.limit(0)))
    # A batch that broke off has left a draft: it does not count, and the next try writes it anew.
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{roll.root}/.batch=3.draft/junk")
    path.getFileSystem(spark._jsc.hadoopConfiguration()).create(path).close()
    assert totals(roll)[("a", "en", "v")] == (2, 10)
    assert roll.compact() == 3 and roll.compact() == 0
    assert totals(roll)[("a", "en", "v")] == (2, 10) and not roll.commit("1", R.inserts(first))  # folded batches stay known
    assert roll.commit("3", R.deletes(first, "after"))
    assert totals(roll) == {}
    assert roll.compact() == 1 and totals(roll) == {} and not roll.commit("3", R.inserts(first))


def test_two_writers_of_one_batch_and_odd_names(spark):
    roll = R.Rollup(spark, f"{shared_dir(spark)}/r-{uuid.uuid4().hex}")
    one = R.inserts(spark.createDataFrame([("a", "en", "v", 5)], "source string, lang string, version string, tokens long"))
    assert roll.commit("2024/01 = ü", one) and not roll.commit("2024/01 = ü", one)
    roll._summed(one).write.parquet(f"{roll.root}/.late")  # a second writer that passed the test before the first was done
    assert not roll._put(".late", roll._folders("batch")[0])
    assert totals(roll) == {("a", "en", "v"): (1, 5)} and len(roll._folders("batch")) == 1


def test_no_documents_ties_and_long_texts(spark, no_docs, odd_docs):
    assert R.inserts(R.counted(no_docs, {"tokens": F.col("text")})).count() == 0
    counts = R.counted(odd_docs, {"tokens": F.col("text")})
    assert counts.filter("doc_id = 5 AND version = 'words-1'").select("tokens").distinct().count() == 1
    assert counts.filter("doc_id = 4 AND version = 'words-1'").first().tokens == 60_000


def test_real_tokenizer_as_a_version(spark, odd_docs):
    bpe = R.library_count("byte_bpe_50k.json")
    counts = R.counted(odd_docs, {"tokens": F.col("text")}, {"bpe": bpe, "words-1": R.word_count})
    got = {(r.doc_id, r.version): r.tokens for r in counts.filter("doc_id < 5").collect()}
    assert got[0, "words-1"] == 16 and got[0, "bpe"] >= 17 and got[1, "bpe"] == got[2, "bpe"] == got[3, "words-1"] == got[1, "words-1"] == 0
    assert R.inserts(counts).agg(F.sum("docs")).first()[0] == 2 * odd_docs.count()


def test_piece_count(spark):
    df = spark.createDataFrame([("Don't stop, 42nd!",), (None,), ("",)], "t string")
    assert [r[0] for r in df.select(R.piece_count(F.col("t"))).collect()] == [8, 0, 0]
