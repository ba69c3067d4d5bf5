"""A training corpus from raw documents: five stages, each on all that the one before has kept.

Every stage takes ``(spark, docs, sf_dir)`` and returns the columns of ``documents``, but for the last,
which returns the digest of the binary shards it wrote. ``run`` writes each stage's result as Parquet in
the shared folder and reads it back as the next one's input.

Cases, in every stage: a null text counts as an empty one; very long texts are read whole; rows without a
doc_id, and rows that share one, are judged each by its own text; repeated rows are copies of each other
for near-dedup and rows of their own elsewhere; ties go to the least doc_id, then by a hash of the row;
an empty table gives an empty one; extra columns pass through under any name but ``tid_``, ``rid_``.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from footfall.llm import decontaminate, jaccard, langid, mixing, tokenbin
from footfall.session import shared_dir, table

#: A text whose best language is less likely than this is taken for none.
LEAST_SCORE = 0.3
#: Near-duplicates: Jaccard likeness of their sets of five-word shingles.
WIDTH, LIKENESS = 5, 0.8


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without a recognised language; ``lang`` stays as it is given, or is filled in where null.

    Whole texts go to Python: the session's batches are made small, so that a few of them fit beside each other.
    """
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", tokenbin.BATCH_ROWS)
    net, columns = langid.train(docs), docs.columns
    # Columns go under names of their own, so that they clash with nothing.
    named = docs.select(*[F.col(f"`{c}`").alias(f"c{i}_") for i, c in enumerate(columns)])
    marked = langid.predict(named, net, named.columns, f"c{columns.index('text')}_").filter((F.col("lang_pred") != "und") & (F.col("score") >= LEAST_SCORE))
    return marked.select(*[(F.coalesce(f"c{i}_", "lang_pred") if c == "lang" else F.col(f"c{i}_")).alias(c) for i, c in enumerate(columns)])


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near-duplicates: the row with the least doc_id."""
    return jaccard.representatives(docs, WIDTH, LIKENESS)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops every row whose own text holds a benchmark item."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix of sources takes it."""
    return mixing.mixed(docs)


def token_shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Writes the ids of all documents as binary shards and returns each one's digest, read back."""
    out = f"{shared_dir(spark)}/corpus-{uuid.uuid4().hex}"
    tokenbin.write_shards(docs, out)
    return tokenbin.read_shards(spark, out)


STAGES = [
    ("language_id", language),
    ("near_dedup", near_duplicates),
    ("decontamination", decontamination),
    ("mixing", mixture),
    ("token_binary", token_shards),
]

#: A network and hashes of shingles are not SQL; tests/llm/test_pipeline.py holds the stages against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; the last one's rows."""
    docs, base = table(spark, sf_dir, "documents"), f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{base}/{name}")
        docs = spark.read.parquet(f"{base}/{name}")
    return docs


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in turn, as `corpus_pipeline.py` names them."""
    return run(spark, sf_dir)


QUERIES = {"pipeline": pipeline}
SQL: dict[str, str] = {}
