"""Operator 8: language identification by a byte convolutional network, trained in numpy.

Bytes of the lower-cased text are embedded and convolved with filters of several widths; each filter's
greatest response in a window of fixed length feeds a softmax over languages. Every window of a text is
scored, and a text's language is the one with the greatest mean log-probability over its windows, each
weighed by its bytes. The score is that language's mean probability.

Training uses at most ``PER_LANGUAGE`` documents a language outside the held-out fold and a bounded
number of windows of each, and is repeatable (fixed seeds). Prediction reads every byte of every text.

Cases: a null text, or one without a letter, is ``und`` with score 0, as is every text if there is
nothing to learn from; rows without a doc_id are predicted but never learned from; repeated rows come
out as often as they come in; extra columns are ignored.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from footfall.llm.sampling import bounded_sample, held_out
from footfall.session import checkpointed, table

WINDOW, WIDTHS, FILTERS, EMBED = 256, (2, 3, 4), 16, 8
#: Bounds of the training sample: documents a language, windows a document.
PER_LANGUAGE, WINDOWS = 800, 4
#: Rows of a batch whose texts are Python objects at one time.
ROWS_AT_ONCE = 500
EPOCHS, BATCH, RATE, SEED = 4, 64, 0.004, 7


def has_letter(text: str | None) -> bool:
    """Whether the text holds a letter (a sign of Unicode's categories L)."""
    return bool(text) and any(map(str.isalpha, text))


def windows(text: str) -> tuple[np.ndarray, np.ndarray]:
    """The lower-cased bytes in rows of ``WINDOW`` (zero-padded), and how many bytes each row holds."""
    raw = np.frombuffer(text.lower().encode("utf-8", "replace"), np.uint8)
    rows = max(1, -(-len(raw) // WINDOW))
    out = np.zeros(rows * WINDOW, np.uint8)
    out[: len(raw)] = raw
    held = np.full(rows, WINDOW, np.int64)
    held[-1] = len(raw) - WINDOW * (rows - 1)
    return out.reshape(rows, WINDOW), held


class ByteConvNet:
    """Embedding, filters of several widths side by side, max pooling and softmax."""

    def __init__(self, labels: list[str], seed: int = SEED):
        rng = np.random.default_rng(seed)
        reach, n = max(WIDTHS), len(WIDTHS) * FILTERS
        self.labels = labels
        self.mask = np.zeros((reach * EMBED, n), np.float32)  # a narrow filter sees its own first bytes alone
        for i, w in enumerate(WIDTHS):
            self.mask[: w * EMBED, i * FILTERS : (i + 1) * FILTERS] = 1
        self.p = {
            "embed": rng.normal(0, 0.5, (256, EMBED)).astype(np.float32),
            "conv": (rng.normal(0, 0.25, (reach * EMBED, n)) * self.mask).astype(np.float32),
            "bias": np.zeros(n, np.float32),
            "out": rng.normal(0, 0.1, (n, len(labels))).astype(np.float32),
            "shift": np.zeros(len(labels), np.float32),
        }

    def _spread(self, rows: np.ndarray) -> np.ndarray:
        """Each position's embedded bytes, for all filters at once: (rows, positions, reach * EMBED)."""
        e = self.p["embed"][rows].reshape(len(rows), -1)
        reach = max(WIDTHS)
        wide = np.lib.stride_tricks.sliding_window_view(e, reach * EMBED, axis=1)[:, ::EMBED]
        return np.ascontiguousarray(wide)

    def _softmax(self, z: np.ndarray) -> np.ndarray:
        z = z - z.max(1, keepdims=True)
        e = np.exp(z)
        return e / e.sum(1, keepdims=True)

    def probabilities(self, rows: np.ndarray, at_once: int = 128) -> np.ndarray:
        out = []
        for at in range(0, len(rows), at_once):
            x = self._spread(rows[at : at + at_once])
            top = (x.reshape(-1, x.shape[2]) @ self.p["conv"]).reshape(len(x), x.shape[1], -1).max(1)
            out.append(self._softmax(np.maximum(top + self.p["bias"], 0) @ self.p["out"] + self.p["shift"]))
        return np.concatenate(out) if out else np.zeros((0, len(self.labels)), np.float32)

    def gradients(self, rows: np.ndarray, target: np.ndarray) -> dict[str, np.ndarray]:
        n, reach = len(rows), max(WIDTHS)
        x = self._spread(rows)
        z = (x.reshape(-1, x.shape[2]) @ self.p["conv"]).reshape(n, x.shape[1], -1)
        where = z.argmax(1)
        act = np.maximum(np.take_along_axis(z, where[:, None], 1)[:, 0] + self.p["bias"], 0)
        d = self._softmax(act @ self.p["out"] + self.p["shift"])
        d[np.arange(n), target] -= 1
        d /= n
        da = (d @ self.p["out"].T) * (act > 0)
        held = x[np.arange(n)[:, None], where]  # (n, filters, reach * EMBED): what each filter saw at its maximum
        g = {"out": act.T @ d, "shift": d.sum(0), "bias": da.sum(0), "conv": np.einsum("nf,nfk->kf", da, held) * self.mask}
        back = (da[:, :, None] * self.p["conv"].T[None]).reshape(n, -1, reach, EMBED)
        seen = rows[np.arange(n)[:, None, None], where[:, :, None] + np.arange(reach)]
        g["embed"] = np.zeros_like(self.p["embed"])
        np.add.at(g["embed"], seen.reshape(-1), back.reshape(-1, EMBED))
        return g

    def fit(self, rows: np.ndarray, target: np.ndarray, epochs: int = EPOCHS, batch: int = BATCH, rate: float = RATE, seed: int = SEED) -> ByteConvNet:
        """Adam over shuffled batches; a third of the windows are cut short, as short texts are."""
        rng = np.random.default_rng(seed)
        m = {k: np.zeros_like(v) for k, v in self.p.items()}
        v2 = {k: np.zeros_like(v) for k, v in self.p.items()}
        # Small samples are gone through more often, so that there are enough steps.
        step, rounds = 0, max(epochs, -(-400 * batch // max(1, len(rows))))
        for _ in range(rounds):
            order = rng.permutation(len(rows))
            for at in range(0, len(order), batch):
                pick = order[at : at + batch]
                x = rows[pick].copy()
                cut = np.where(rng.random(len(pick)) < 1 / 3, rng.integers(12, WINDOW, len(pick)), WINDOW)
                x[np.arange(WINDOW)[None] >= cut[:, None]] = 0
                step += 1
                for k, g in self.gradients(x, target[pick]).items():
                    m[k] = 0.9 * m[k] + 0.1 * g
                    v2[k] = 0.999 * v2[k] + 0.001 * g * g
                    self.p[k] -= (rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v2[k] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
        return self


def training_windows(docs: DataFrame, per_language: int = PER_LANGUAGE, most: int = WINDOWS) -> pd.DataFrame:
    """``lang, w``: windows of a bounded sample of documents outside the held-out fold."""
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "lang").filter(~held_out() & F.col("lang").isNotNull()).groupBy("doc_id").agg(F.min("lang").alias("lang"))
    chosen = checkpointed(bounded_sample(slim, "doc_id", "lang", per_language))
    # Bounded: at most per_language rows of a language.
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(F.broadcast(chosen), "doc_id")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            langs, rows = [], []
            for key, text, lang in zip(pdf["doc_id"].tolist(), pdf["text"], pdf["lang"], strict=True):
                if not has_letter(text):
                    continue
                w = windows(text)[0]
                for i in sorted(np.random.default_rng(key % 2**32).permutation(len(w))[:most].tolist()):
                    langs.append(lang)
                    rows.append(w[i].tobytes())
            yield pd.DataFrame({"lang": pd.Series(langs, dtype="object"), "w": pd.Series(rows, dtype="object")})

    return texts.mapInPandas(run, "lang string, w binary").toPandas()


def train(docs: DataFrame, per_language: int = PER_LANGUAGE, most: int = WINDOWS) -> ByteConvNet | None:
    """A network fitted on `training_windows`; None if they hold nothing."""
    sample = training_windows(docs, per_language, most).sort_values(["lang", "w"])
    if sample.empty:
        return None
    labels = sorted(sample["lang"].unique())
    rows = np.frombuffer(b"".join(map(bytes, sample["w"])), np.uint8).reshape(-1, WINDOW)
    return ByteConvNet(labels).fit(rows, np.searchsorted(labels, sample["lang"].to_numpy()))


def classify(net: ByteConvNet | None, texts: list[str | None], at_once: int = 4096) -> tuple[list[str], np.ndarray]:
    """Language and score of each text."""
    langs, scores = ["und"] * len(texts), np.zeros(len(texts))
    todo = [i for i, t in enumerate(texts) if net is not None and has_letter(t)]
    at = 0
    while at < len(todo):
        some, rows, held, count = [], [], [], 0
        while at < len(todo) and (count < at_once or not some):
            w, h = windows(texts[todo[at]])
            some.append(todo[at])
            rows.append(w)
            held.append(h)
            count += len(w)
            at += 1
        p = net.probabilities(np.concatenate(rows))
        weight = np.concatenate(held).astype(np.float64)[:, None]
        starts = np.cumsum([0, *map(len, held)])[:-1]
        total = np.add.reduceat(weight, starts)
        best = (np.add.reduceat(np.log(p + 1e-9) * weight, starts) / total).argmax(1)
        mean = np.add.reduceat(p * weight, starts) / total
        for i, b, s in zip(some, best.tolist(), mean[np.arange(len(best)), best].tolist(), strict=True):
            langs[i], scores[i] = net.labels[b], min(1.0, max(0.0, s))
    return langs, scores


def predict(docs: DataFrame, net: ByteConvNet | None, keep: list[str], text: str = "text") -> DataFrame:
    """``keep`` (columns of ``docs``) with ``lang_pred, score``; keep holds neither name.

    A text that is kept goes to Python and back once, like all kept columns as it came.
    """
    own = text in keep and dict(docs.dtypes)[text] == "string"
    at = keep.index(text) if own else len(keep)

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        sys.__dict__.pop("_footfall_encoders", None)  # a worker that goes on with other work gives up its encoders
        for whole in batches:
            for first in range(0, whole.num_rows, ROWS_AT_ONCE):
                batch = whole.slice(first, ROWS_AT_ONCE)
                langs, scores = classify(net, batch.column(at).to_pylist())
                kept = [batch.column(i) for i in range(len(keep))]
                yield pa.RecordBatch.from_arrays([*kept, pa.array(langs, pa.string()), pa.array(scores, pa.float64())], names=[*batch.schema.names[: len(keep)], "lang_pred", "score"])

    rows = docs.select(*[F.col(f"`{c}`") for c in keep], *([] if own else [F.col(f"`{text}`").cast("string").alias("text_")]))
    schema = ", ".join(f"`{n}` {t}" for n, t in rows.dtypes[: len(keep)]) + ", lang_pred string, score double"
    return rows.mapInArrow(run, schema)


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predicted language of every document."""
    docs = table(spark, sf_dir, "documents")
    out = predict(docs.withColumn("doc_id", F.col("doc_id").cast("long")), train(docs), ["doc_id"])
    return out.select("doc_id", held_out().alias("held_out"), "lang_pred", "score")


QUERIES = {"op8_language_id": op8_language_id}
#: A network has no SQL form; tests/llm/test_langid.py measures held-out accuracy.
SQL: dict[str, str] = {}
