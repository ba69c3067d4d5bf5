"""Operator 7: quality classification by histogram gradient-boosted trees over document statistics.

A text is reduced to some thirty statistics. Trees are grown level by level on binned statistics of a
bounded sample of labelled documents outside the held-out fold, then flattened into arrays: node i of a
tree has its children at 2i + 1 and 2i + 2, so all rows walk all trees in as many numpy steps as the
trees are deep. The score is the probability of label 1; statistics are taken over whole texts.

Cases: null and empty texts are scored by the statistics of an empty one; a document with several
labels counts by the highest; without labels of both kinds the score is the mean label (0.5 if none);
rows without a doc_id are scored but never learned from; repeated rows come out as often as they come
in; extra columns are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from footfall.llm.sampling import bounded_sample, held_out
from footfall.session import checkpointed, table

#: Bound of the training sample: labelled documents of each label.
PER_LABEL = 8_000
TREES, DEPTH, BINS, RATE, L2, LEAST = 80, 4, 64, 0.12, 2.0, 8
CUT = 0.3

_KIND = np.zeros(256, np.int64)  # 0 other, 1 lower, 2 upper, 3 digit, 4 white, 5 sentence mark, 6 symbol, 7 above ASCII
for _i in range(256):
    _c = chr(_i)
    _KIND[_i] = 7 if _i > 127 else 1 if _c.islower() else 2 if _c.isupper() else 3 if _c.isdigit() else 4 if _c in " \t\n\r\x0b\x0c" else 5 if _c in ".,;:!?'\"()-" else 6 if _i > 32 else 0
STATISTICS = (
    "log_bytes log_words log_lines lower upper digit white mark symbol high other word_mean word_sd distinct top_word symbol_words short_words long_words "
    "line_mean repeated_lines repeated_line_bytes ended_lines entropy top_byte next_same distinct_pairs exclaim pipe hash upper_words digit_words words_a_mark"
).split()


def statistics(text: str | None) -> list[float]:
    """The statistics of a whole text, in the order of ``STATISTICS``."""
    raw = (text or "").encode("utf-8", "replace")
    n = max(1, len(raw))
    hist = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    kind = np.bincount(_KIND, weights=hist, minlength=8) / n
    words = raw.split()
    m = max(1, len(words))
    size = np.fromiter(map(len, words), np.int64, len(words))
    seen = Counter(words)
    lines = [x for x in raw.split(b"\n") if x.strip()]
    k, met = max(1, len(lines)), Counter(lines)
    p = hist[hist > 0] / n
    symbolic = sum(c for w, c in seen.items() if not w.isalnum() and _KIND[w[-1]] == 6)
    uppers = sum(c for w, c in seen.items() if len(w) > 1 and w.isupper())
    digits = sum(c for w, c in seen.items() if any(48 <= b <= 57 for b in w[:4]))
    return [
        np.log1p(len(raw)), np.log1p(len(words)), np.log1p(len(lines)),
        kind[1], kind[2], kind[3], kind[4], kind[5], kind[6], kind[7], kind[0],
        size.sum() / m, float(size.std()) if len(size) else 0.0, len(seen) / m, max(seen.values(), default=0) / m,
        symbolic / m, int((size <= 3).sum()) / m, int((size >= 12).sum()) / m,
        np.log1p(n / k), sum(c for c in met.values() if c > 1) / k, sum(len(x) * (c - 1) for x, c in met.items()) / n,
        sum(x.rstrip()[-1:] in b".!?" for x in lines) / k, float(-(p * np.log2(p)).sum()) if len(p) else 0.0, hist.max() / n,
        sum(a == b for a, b in zip(words, words[1:], strict=False)) / m, len(set(zip(words, words[1:], strict=False))) / m,
        hist[33] / n, hist[124] / n, hist[35] / n, uppers / m, digits / m, np.log1p(m / (1 + hist[46])),
    ]


class BoostedTrees:
    """Flat arrays of trees of equal depth over binned statistics."""

    def __init__(self, edges: list[np.ndarray], base: float):
        self.edges, self.base = edges, base
        self.feature, self.cut, self.value = np.zeros((0, 0), np.int64), np.zeros((0, 0), np.int64), np.zeros((0, 0))

    def bins(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, i], "left") for i, e in enumerate(self.edges)], 1) if len(self.edges) else np.zeros((len(x), 0), np.int64)

    @classmethod
    def fit(cls, x: np.ndarray, y: np.ndarray, trees: int = TREES, depth: int = DEPTH, bins: int = BINS, rate: float = RATE) -> BoostedTrees:
        mean = float(np.clip(y.mean(), 1e-3, 1 - 1e-3)) if len(y) else 0.5
        model = cls([np.unique(np.quantile(x[:, i], np.linspace(0, 1, bins + 1)[1:-1])) for i in range(x.shape[1])] if len(y) else [], float(np.log(mean / (1 - mean))))
        if not len(y) or y.min() == y.max():
            return model
        b, f = model.bins(x), x.shape[1]
        flat = b + np.arange(f) * bins
        margin = np.full(len(y), model.base)
        inner, leaves = 2**depth - 1, 2**depth
        features, cuts, values = [], [], []
        for _ in range(trees):
            prob = 1 / (1 + np.exp(-margin))
            g, h = prob - y, prob * (1 - prob)
            feature, cut, at = np.zeros(inner, np.int64), np.full(inner, bins, np.int64), np.zeros(len(y), np.int64)
            for level in range(depth):
                first, width = 2**level - 1, 2**level
                slot = ((at - first)[:, None] * (f * bins) + flat).ravel()
                shape = (width, f, bins)
                hist = [np.bincount(slot, weights=np.repeat(w, f), minlength=width * f * bins).reshape(shape).cumsum(2) for w in (g, h, np.ones(len(y)))]
                total = [t[:, :1, -1:] for t in hist]
                gain = sum(
                    gg**2 / (hh + L2) for gg, hh in ((hist[0], hist[1]), (total[0] - hist[0], total[1] - hist[1]))
                ) - total[0] ** 2 / (total[1] + L2)
                gain[(hist[2] < LEAST) | (total[2] - hist[2] < LEAST)] = 0
                best = gain.reshape(width, -1).argmax(1)
                split = gain.reshape(width, -1)[np.arange(width), best] > 1e-9
                feature[first : first + width] = best // bins
                cut[first : first + width] = np.where(split, best % bins, bins)
                at = 2 * at + 1 + (b[np.arange(len(y)), feature[at]] > cut[at])
            leaf = at - inner
            value = -rate * np.bincount(leaf, weights=g, minlength=leaves) / (np.bincount(leaf, weights=h, minlength=leaves) + L2)
            margin = margin + value[leaf]
            features.append(feature)
            cuts.append(cut)
            values.append(value)
        model.feature, model.cut, model.value = np.array(features), np.array(cuts), np.array(values)
        return model

    def probability(self, x: np.ndarray) -> np.ndarray:
        """All rows through all trees at once."""
        margin = np.full(len(x), self.base)
        if len(self.feature) and len(x):
            b, trees = self.bins(x), np.arange(len(self.feature))
            at = np.zeros((len(x), len(trees)), np.int64)
            for _ in range(int(np.log2(self.value.shape[1]))):
                at = 2 * at + 1 + (np.take_along_axis(b, self.feature[trees, at], 1) > self.cut[trees, at])
            margin = margin + self.value[trees, at - self.feature.shape[1]].sum(1)
        return 1 / (1 + np.exp(-margin))


def measured(docs: DataFrame, keep: list[str]) -> DataFrame:
    """``keep`` and ``stats``, an array of the statistics of each whole text."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            texts = pdf["text_"].astype(object).where(pdf["text_"].notna(), None)
            yield pdf.drop(columns="text_").assign(stats=[statistics(t) for t in texts])

    rows = docs.select(*keep, F.col("text").cast("string").alias("text_"))
    return rows.mapInPandas(run, ", ".join(f"`{n}` {t}" for n, t in rows.drop("text_").dtypes) + ", stats array<double>")


def train(docs: DataFrame, labels: DataFrame, per_label: int = PER_LABEL) -> BoostedTrees:
    """Trees fitted on a bounded sample of labelled documents outside the held-out fold."""
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("y")).filter(~held_out() & F.col("y").isin(0, 1))
    chosen = checkpointed(bounded_sample(known.groupBy("doc_id").agg(F.max("y").alias("y")), "doc_id", "y", per_label))
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    # Bounded: at most per_label rows of each label.
    sample = measured(slim.join(F.broadcast(chosen), "doc_id"), ["doc_id", "y"]).toPandas().sort_values("doc_id")
    x = np.array(sample["stats"].tolist(), np.float64).reshape(len(sample), len(STATISTICS))
    return BoostedTrees.fit(x, sample["y"].to_numpy(np.float64))


def score(docs: DataFrame, model: BoostedTrees, keep: list[str]) -> DataFrame:
    """``keep`` (columns of ``docs``, none named score) with the quality ``score`` of each whole text."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            texts = pdf["text_"].astype(object).where(pdf["text_"].notna(), None)
            x = np.array([statistics(t) for t in texts], np.float64).reshape(len(pdf), len(STATISTICS))
            yield pdf.drop(columns="text_").assign(score=model.probability(x))

    rows = docs.select(*keep, F.col("text").cast("string").alias("text_"))
    return rows.mapInPandas(run, ", ".join(f"`{n}` {t}" for n, t in rows.drop("text_").dtypes) + ", score double")


def op7_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality score of every document."""
    docs = table(spark, sf_dir, "documents")
    out = score(docs.withColumn("doc_id", F.col("doc_id").cast("long")), train(docs, table(spark, sf_dir, "labels")), ["doc_id"])
    return out.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= CUT).cast("int").alias("predicted"))


QUERIES = {"op7_quality_classifier": op7_quality_classifier}
#: Trees have no SQL form; tests/llm/test_quality.py measures held-out accuracy.
SQL: dict[str, str] = {}
