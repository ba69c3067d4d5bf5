"""Operator 3: token counts in delta-maintained rollups.

A batch of changes is a table with the counts before and after: an insert has no before, a delete no
after, a revised count both. It is reduced to signed sums of documents and tokens by source, language
and tokenizer version, written to a folder of its own and renamed into place, which either happens whole or
not at all. Totals are the sum of all committed batches, so they cost no look at the documents. A batch that
is committed already is left alone however often it is sent, also where two send it at once; one that broke
off is written anew. `Rollup.compact` folds batches into one table and keeps their names, so they stay known.

Cases: null and empty texts count 0 tokens and one document; a null source or language is a group of its
own; rows without a doc_id and repeated rows are documents of their own in an insert; groups whose
documents and tokens have all gone are left out of the totals; an empty batch commits and changes nothing;
a batch's name may hold any signs.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from urllib.parse import quote

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from footfall.llm.mixing import word_count
from footfall.session import checkpointed, shared_dir, table

GROUP = ("source", "lang", "version")


def piece_count(text: Column) -> Column:
    """Number of letter runs, digit runs and single other signs; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(r"\p{L}+|\p{N}+|[^\s\p{L}\p{N}]")), F.lit(0)).cast("long")


def library_count(tokenizer: str) -> Callable[[Column], Column]:
    """A version that counts the ids of a file of the tokenizers library; one encoder a Python process."""
    from footfall.llm.tokenbin import Encoder

    @F.pandas_udf("long")
    def count(texts: pd.Series) -> pd.Series:
        enc = Encoder.of_worker(tokenizer)
        return pd.Series([len(enc.encode(t)) // enc.dtype.itemsize if t else 0 for t in texts], dtype="int64")

    return lambda text: count(text.cast("string"))


#: Tokenizer versions that columns can express; any Column from text to a count can be added.
VERSIONS = {"words-1": word_count, "pieces-1": piece_count}


def changes(before: Column, after: Column) -> tuple[Column, Column]:
    """(documents, tokens) that a change adds to its group: counts before and after, null where there is none."""
    docs = F.when(after.isNotNull(), 1).otherwise(0) - F.when(before.isNotNull(), 1).otherwise(0)
    return docs.cast("long"), (F.coalesce(after, F.lit(0)) - F.coalesce(before, F.lit(0))).cast("long")


def inserts(counts: DataFrame, tokens: str = "tokens") -> DataFrame:
    return _signed(counts, F.lit(None), F.col(tokens))


def deletes(counts: DataFrame, tokens: str = "tokens") -> DataFrame:
    return _signed(counts, F.col(tokens), F.lit(None))


def revisions(counts: DataFrame, before: str, after: str) -> DataFrame:
    return _signed(counts, F.col(before), F.col(after))


def _signed(counts: DataFrame, before: Column, after: Column) -> DataFrame:
    docs, tokens = changes(before.cast("long"), after.cast("long"))
    return counts.select(*GROUP, docs.alias("docs"), tokens.alias("tokens"))


class Rollup:
    """Additive totals in a folder that driver and executors share.

    ``batch=<name>`` holds a committed batch, ``base=<n>`` the sums of those that compaction has folded, and
    ``base=<n>/names`` their names; of several bases the last counts. Folders that begin with a dot are drafts.
    """

    SCHEMA = "source string, lang string, version string, docs long, tokens long"

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self.jvm = spark._jvm.org.apache.hadoop.fs

    def _path(self, name: str):
        return self.jvm.Path(f"{self.root}/{name}")

    def _folders(self, kind: str) -> list[str]:
        """Names of the committed folders of one kind, in order."""
        root = self.jvm.Path(self.root)
        fs = root.getFileSystem(self.spark._jsc.hadoopConfiguration())
        names = [s.getPath().getName() for s in fs.listStatus(root)] if fs.exists(root) else []
        return sorted(n for n in names if n.startswith(kind + "="))

    def _put(self, draft: str, name: str) -> bool:
        """Renames a draft into place; False, and the draft gone, where that place is taken."""
        context = self.jvm.FileContext.getFileContext(self._path(draft).toUri(), self.spark._jsc.hadoopConfiguration())
        options = self.spark.sparkContext._gateway.new_array(self.jvm.Options.Rename, 0)
        try:
            context.rename(self._path(draft), self._path(name), options)
            return True
        except Exception as e:
            if "FileAlreadyExists" not in str(e):
                raise
            context.delete(self._path(draft), True)
            return False

    def _folded(self) -> tuple[str | None, set[str]]:
        """The base that counts, and the names of the batches in it."""
        bases = self._folders("base")
        if not bases:
            return None, set()
        return bases[-1], {r.name for r in self.spark.read.parquet(f"{self.root}/{bases[-1]}/names").collect()}

    @staticmethod
    def _summed(signed: DataFrame) -> DataFrame:
        return signed.groupBy(*GROUP).agg(F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens")).filter("docs <> 0 OR tokens <> 0")

    def commit(self, batch: str, signed: DataFrame) -> bool:
        """Adds a batch of signed changes; False, and nothing done, if it is committed already."""
        name = f"batch={quote(batch, safe='')}"
        if name in self._folders("batch") or name in self._folded()[1]:
            return False
        draft = f".{name}.{uuid.uuid4().hex}"
        self._summed(signed).write.parquet(f"{self.root}/{draft}")
        return self._put(draft, name)

    def _deltas(self) -> tuple[DataFrame, str | None, set[str], list[str]]:
        base, folded = self._folded()
        fresh = [n for n in self._folders("batch") if n not in folded]
        paths = [f"{self.root}/{n}" for n in fresh] + ([f"{self.root}/{base}/sums"] if base else [])
        rows = self.spark.read.schema(self.SCHEMA).parquet(*paths).select(*GROUP, "docs", "tokens") if paths else self.spark.createDataFrame([], self.SCHEMA)
        return rows, base, folded, fresh

    def totals(self) -> DataFrame:
        """Current ``source, lang, version, docs, tokens`` over all committed batches."""
        return self._summed(self._deltas()[0])

    def compact(self) -> int:
        """Folds all committed batches into one base; the number of batches newly folded."""
        rows, base, folded, fresh = self._deltas()
        if not fresh:
            return 0
        number = int(base.split("=")[1]) + 1 if base else 1
        draft = f".base.{uuid.uuid4().hex}"
        self._summed(rows).write.parquet(f"{self.root}/{draft}/sums")
        self.spark.createDataFrame([(n,) for n in sorted(folded | set(fresh))], "name string").write.parquet(f"{self.root}/{draft}/names")
        if not self._put(draft, f"base={number:09d}"):
            return 0  # another compaction was first
        context = self.jvm.FileContext.getFileContext(self._path("").toUri(), self.spark._jsc.hadoopConfiguration())
        for name in fresh:  # they are in the base by now, whether or not they go
            context.delete(self._path(name), True)
        return len(fresh)


def counted(docs: DataFrame, texts: dict[str, Column], versions: dict | None = None) -> DataFrame:
    """``doc_id, source, lang, version`` and a count for each named text: one row per document and version."""
    versions = versions or VERSIONS
    rows = [F.struct(F.lit(v).alias("version"), *[count(t).alias(n) for n, t in texts.items()]) for v, count in versions.items()]
    own = [F.col(c).cast("string").alias(c) for c in ("source", "lang")]
    return docs.select("doc_id", *own, F.explode(F.array(*rows)).alias("c")).select("doc_id", "source", "lang", "c.*")


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals after all documents came in, e-mail addresses were taken out of their texts, and toxic documents left.

    The first batch is sent twice; the second time changes nothing.
    """
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    text = F.col("text").cast("string")
    scrubbed = F.when(F.contains(text, F.lit("@")), F.regexp_replace(text, r"[^\s@]+@[^\s@]+", "")).otherwise(text)
    counts = checkpointed(counted(docs, {"tokens": text, "revised": scrubbed}))
    toxic = labels.filter("toxic = 1").select("doc_id").distinct()
    rollup = Rollup(spark, f"{shared_dir(spark)}/rollup-{uuid.uuid4().hex}")
    rollup.commit("load", inserts(counts))
    rollup.commit("scrub", revisions(counts.filter("tokens <> revised"), "tokens", "revised"))
    rollup.commit("takedown", deletes(counts.join(toxic, "doc_id", "left_semi"), "revised"))
    rollup.commit("load", inserts(counts))
    return rollup.totals()


QUERIES = {"op3_token_counts": op3_token_counts}
SQL = {
    "op3_token_counts": r"""
WITH d AS (
  SELECT source, lang, regexp_replace(coalesce(text, ''), '[^\s@]+@[^\s@]+', '', 'g') AS t FROM documents
  WHERE doc_id IS NULL OR doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1 AND doc_id IS NOT NULL)
), c AS (
  SELECT source, lang, 'words-1' AS version, len(regexp_extract_all(t, '[^\x20\x09-\x0D]+')) AS n FROM d
  UNION ALL
  SELECT source, lang, 'pieces-1', len(regexp_extract_all(t, '\p{L}+|\p{N}+|[^\s\p{L}\p{N}]')) FROM d
)
SELECT source, lang, version, count(*) AS docs, CAST(sum(n) AS BIGINT) AS tokens FROM c GROUP BY source, lang, version"""
}
