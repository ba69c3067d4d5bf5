"""Operator 11: toxicity by multiple-instance learning over sentences.

A document is a bag of sentences, and only the bag has a label. A sentence's score p is a logistic
function of the words and word beginnings that it holds; a document's is the noisy-or of its sentences,
1 - product(1 - p): toxic if one of them is. Both are learned from document labels alone: the gradient of
the bag's likelihood falls on the sentences in proportion to their p, so what toxic bags have in common
and clean bags lack is found out. The same p then locates the sentences that offend.

The training sample is bounded (``PER_LABEL`` documents a label, of ``MOST_CHARS`` characters at most) and
lies outside the held-out fold; its features are counted, chosen and read on the executors. Scoring reads
whole texts.

Cases: a null or empty text has no sentence and scores 0; a document with several labels counts as toxic
if one of them says so; without labels of both kinds every text scores the mean label (0.5 if none); rows
without a doc_id are scored but never learned from; repeated rows come out as often as they come in; kept
columns keep their names, whatever they are; a sentence of over ``PIECE`` words is scored in pieces.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from footfall.llm.sampling import bounded_sample, held_out
from footfall.session import checkpointed, table

#: Bounds of the training sample: documents a label, characters a document.
PER_LABEL, MOST_CHARS = 3_000, 100_000
#: Features of the model, the ones that tell the labels apart best; documents that must hold one.
FEATURES, LEAST_DOCS = 1_000, 12
#: Word beginnings that are features, where the word goes on, in letters; words of a piece of a long sentence.
HEADS, PIECE = (4, 5, 6, 7, 8), 64
#: Adam's rounds and rate, ridge, first bias, and how much more a toxic document weighs than a clean one.
ROUNDS, RATE, L2, BIAS, LEAN = 400, 0.05, 1e-5, -6.0, 2.0
CUT = 0.5
#: Words whose weights a task remembers at a time.
MEMO = 200_000

_SENTENCE = re.compile(r"[^.!?\n]+[.!?]*")
_WORD = re.compile(r"\w+")


def sentences(text: str | None) -> Iterator[tuple[int, int, set[str]]]:
    """(start, end, distinct lower-cased words) of each sentence that holds a word, long ones in pieces."""
    for found in _SENTENCE.finditer(text or ""):
        spans = [(m.start(), m.end()) for m in _WORD.finditer(text, found.start(), found.end())]
        for at in range(0, len(spans), PIECE):
            part = spans[at : at + PIECE]
            yield part[0][0], part[-1][1], {text[a:b].lower() for a, b in part}


def features(word: str) -> list[str]:
    """The word itself and its beginnings."""
    return [f"={word}", *(f"^{word[:n]}" for n in HEADS if len(word) > n)]


class NoisyOr:
    """Weights of features; a sentence's logit is the bias and the weights of its distinct words' features."""

    def __init__(self, weights: dict[str, float], bias: float, mean: float | None = None):
        self.weights, self.bias, self.mean = weights, bias, mean
        self.memo: dict[str, float] = {}

    def __getstate__(self) -> dict:
        return {"weights": self.weights, "bias": self.bias, "mean": self.mean, "memo": {}}

    def _weight(self, word: str) -> float:
        found = self.memo.get(word)
        if found is None:
            if len(self.memo) >= MEMO:
                self.memo.clear()
            get = self.weights.get
            found = self.memo[word] = sum(get(f, 0.0) for f in features(word))
        return found

    def spans(self, text: str | None) -> tuple[list[tuple[int, int]], np.ndarray]:
        """Sentences and the p of each."""
        places, logits = [], []
        for start, end, words in sentences(text):
            places.append((start, end))
            logits.append(self.bias + sum(map(self._weight, words)))
        return places, 1 / (1 + np.exp(-np.clip(np.array(logits, np.float64), -500, 500)))

    def combined(self, p: np.ndarray) -> float:
        """Noisy-or of sentence scores."""
        if self.mean is not None:
            return self.mean
        return float(-np.expm1(np.log1p(-np.minimum(p, 1 - 1e-12)).sum()))

    @classmethod
    def fit(cls, vocabulary: list[str], held: np.ndarray, sizes: np.ndarray, bags: np.ndarray, y: np.ndarray, weight: np.ndarray, rounds: int = ROUNDS, rate: float = RATE) -> NoisyOr:
        """Adam on the weighted likelihood of the bags.

        ``held`` are the numbers of the features of one sentence after the other, ``sizes`` how many each sentence holds,
        ``bags`` how many sentences each document has.
        """
        if not len(y) or y.min() == y.max():
            return cls({}, 0.0, float(y.mean()) if len(y) else 0.5)
        bag_of, row = np.repeat(np.arange(len(bags)), bags), np.repeat(np.arange(len(sizes)), sizes)
        w, bias = np.zeros(len(vocabulary)), BIAS
        m, v = np.zeros(len(w) + 1), np.zeros(len(w) + 1)
        scale = weight * np.where(y == 1, LEAN, 1.0)
        scale = scale / scale.sum()
        for step in range(1, rounds + 1):
            p = 1 / (1 + np.exp(-(bias + np.bincount(row, weights=w[held], minlength=len(sizes)))))
            clean = np.exp(np.bincount(bag_of, weights=np.log1p(-np.minimum(p, 1 - 1e-12)), minlength=len(bags)))
            # Of -log(1 - P) for a clean bag, of -log P for a toxic one, by the logits of its sentences.
            pull = scale * np.where(y == 1, -clean / np.maximum(1 - clean, 1e-9), 1.0)
            g = pull[bag_of] * p
            grad = np.r_[np.bincount(held, weights=g[row], minlength=len(w)) + L2 * w, g.sum()]
            m = 0.9 * m + 0.1 * grad
            v = 0.999 * v + 0.001 * grad * grad
            move = rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-10)
            w, bias = w - move[:-1], bias - move[-1]
        return cls({f: float(x) for f, x in zip(vocabulary, w, strict=True) if x}, float(bias))


def _held(text: str | None) -> list[list[str]]:
    """The features of each sentence."""
    return [sorted({f for w in words for f in features(w)}) for _, _, words in sentences(text)]


def _document_features(rows: DataFrame) -> DataFrame:
    """``y, f``: the distinct features of each document."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for y, text in zip(pdf["y"].tolist(), pdf["text"], strict=True):
                yield pd.DataFrame({"f": sorted({f for s in _held(text) for f in s})}, dtype="object").assign(y=y)

    return rows.select("y", "text").mapInPandas(run, "f string, y int")


def _numbered_bags(rows: DataFrame, vocabulary: list[str]) -> pd.DataFrame:
    """``doc_id, y, sizes, held`` of each sampled document: its sentences' features as packed numbers. Bounded by the sample."""
    number = {f: i for i, f in enumerate(vocabulary)}

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for text in pdf["text"]:
                held = [[number[f] for f in s if f in number] for s in _held(text)]
                out.append((np.array([len(s) for s in held], np.int32).tobytes(), np.array([i for s in held for i in s], np.int32).tobytes()))
            yield pdf[["doc_id", "y"]].assign(sizes=[a for a, _ in out], held=[b for _, b in out])

    return rows.mapInPandas(run, "doc_id long, y int, sizes binary, held binary").toPandas().sort_values("doc_id")


def train(docs: DataFrame, labels: DataFrame, per_label: int = PER_LABEL, most_chars: int = MOST_CHARS, most_features: int = FEATURES, least_docs: int = LEAST_DOCS) -> NoisyOr:
    """A model fitted on a bounded sample of labelled documents outside the held-out fold."""
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("y")).filter(~held_out() & F.col("y").isin(0, 1))
    known = checkpointed(known.groupBy("doc_id").agg(F.max("y").alias("y")))
    chosen = checkpointed(bounded_sample(known, "doc_id", "y", per_label))
    # Bounded: at most per_label documents of each label, one text of each, and equal texts once.
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).filter(F.length("text") <= most_chars)
    sample = texts.join(F.broadcast(chosen), "doc_id").groupBy("text").agg(F.min("doc_id").alias("doc_id"), F.max("y").alias("y"))
    sample = sample.groupBy("doc_id").agg(F.max("y").alias("y"), F.min("text").alias("text"))
    sample = checkpointed(sample)
    sizes = {r["y"]: r["n"] for r in sample.groupBy("y").agg(F.count("*").alias("n")).collect()}
    real = {r["y"]: r["n"] for r in known.groupBy("y").agg(F.count("*").alias("n")).collect()}
    none = np.zeros(0, np.int64)
    if len(sizes) < 2:
        return NoisyOr.fit([], none, none, none, np.array([y for y in sizes], np.float64), np.ones(len(sizes)))
    # The features whose share of toxic documents is farthest from that of clean ones, in deviations.
    held = _document_features(sample).groupBy("f").agg(F.sum("y").alias("a"), F.sum(1 - F.col("y")).alias("b"))
    share = (F.col("a") + F.col("b")) / float(sum(sizes.values()))
    gap = F.abs(F.col("a") / float(sizes[1]) - F.col("b") / float(sizes[0])) / F.sqrt(share * (1 - share) + 1e-4)
    best = held.filter(F.col("a") + F.col("b") >= least_docs).select("f", gap.alias("gap")).orderBy(F.desc("gap"), "f").limit(most_features)
    vocabulary = sorted(r["f"] for r in best.collect())
    bags = _numbered_bags(sample, vocabulary)
    packed = lambda c: [np.frombuffer(b, np.int32) for b in bags[c]]
    y, lines = bags["y"].to_numpy(np.float64), packed("sizes")
    weight = np.where(y == 1, real[1] / sizes[1], real[0] / sizes[0])
    return NoisyOr.fit(vocabulary, np.concatenate(packed("held")), np.concatenate(lines), np.array([len(x) for x in lines]), y, weight)


def _schema(df: DataFrame) -> str:
    return ", ".join(f"c{i} {kind}" for i, (_, kind) in enumerate(df.dtypes))


def judged(docs: DataFrame, model: NoisyOr, keep: list[str], text: str = "text") -> DataFrame:
    """``keep`` (columns of ``docs``) and ``judged``: a struct of the ``score`` of the whole text and its ``offending`` spans.

    ``offending`` is an array of ``start, end, p`` for the sentences with p of ``CUT`` or more, and for the
    worst one of a text whose score comes to ``CUT`` by several that do not.
    """

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("p", pa.float64())]))
        for batch in batches:
            scores, found = [], []
            for text in batch.column(batch.num_columns - 1):
                places, p = model.spans(text.as_py())
                scores.append(model.combined(p))
                bad = np.flatnonzero(p >= CUT) if len(p) and (p >= CUT).any() else [int(p.argmax())] if len(p) and scores[-1] >= CUT else []
                found.append([{"start": places[i][0], "end": places[i][1], "p": float(p[i])} for i in bad])
            out = pa.StructArray.from_arrays([pa.array(scores, pa.float64()), pa.array(found, span)], ["score", "offending"])
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], out], names=[*batch.schema.names[:-1], "judged"])

    kept = docs.select(*[F.col(f"`{c}`") for c in keep])
    rows = docs.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(keep)], F.col(f"`{text}`").cast("string").alias("t"))
    schema = ", ".join(filter(None, [_schema(kept), "judged struct<score: double, offending: array<struct<start: bigint, end: bigint, p: double>>>"]))
    return rows.mapInArrow(run, schema).toDF(*keep, "judged")


def offending(docs: DataFrame, model: NoisyOr) -> DataFrame:
    """``doc_id, start, end, p, sentence``: the sentences that offend, by the places of their characters."""
    rows = judged(docs, model, ["doc_id", "text"]).select("doc_id", "text", F.explode("judged.offending").alias("s"))
    return rows.select("doc_id", "s.start", "s.end", "s.p", F.substring("text", F.col("s.start").cast("int") + 1, (F.col("s.end") - F.col("s.start")).cast("int")).alias("sentence"))


def op11_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document, with the number of its offending sentences and the place of the worst."""
    docs = table(spark, sf_dir, "documents")
    out = judged(docs.withColumn("doc_id", F.col("doc_id").cast("long")), train(docs, table(spark, sf_dir, "labels")), ["doc_id"])
    score, bad = F.col("judged.score"), F.col("judged.offending")
    worst = F.array_max(F.transform(bad, lambda s: F.struct(s["p"].alias("p"), (-s["start"]).alias("at"), s["end"].alias("end"))))
    return out.select(
        "doc_id",
        held_out().alias("held_out"),
        score.alias("score"),
        (score >= CUT).cast("int").alias("predicted"),
        F.size(bad).alias("n_offending"),
        (-worst["at"]).alias("worst_start"),
        worst["end"].alias("worst_end"),
    )


QUERIES = {"op11_toxicity": op11_toxicity}
#: A learned model has no SQL form; tests/llm/test_toxicity.py measures held-out accuracy and located sentences.
SQL: dict[str, str] = {}
