"""Quality classifier: supervised subword embeddings.

A document is the average of learned vectors of its hashed features: words, pairs of neighbouring words, whether a word
repeats the one before it, and byte 3- to 4-grams.  A softmax over two labels sits on top; vectors and output layer
are trained together by stochastic gradient descent in numpy, on at most about ``max_train`` labelled documents picked by
a hash of doc_id (all, if there are fewer).  As output and average are linear, prediction needs one number a bucket
and one pass over the text.

Defined cases: null text is empty; an empty text has no features and gets the score of the bias alone; labels other than
0 and 1 or null teach nothing; several labels of one document all count; texts longer than ``max_train_chars`` are scored
whole but not sampled for the fit; repeated documents give a row each; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialize, text_parts
from .langid import held_out, softmax

_P = 0x5851_F42D_4C95_7F2D
_P_INV = pow(_P, -1, 1 << 64)


class Subwords:
    """Hashed features of a run of texts: (text of each, bucket of each), a group of features at a time."""

    def __init__(self, bits: int = 16, orders: tuple[int, ...] = (3, 4)):
        self.bits, self.orders, self.powers, self.inverse = bits, orders, np.ones(1, np.uint64), np.ones(1, np.uint64)

    def _power(self, n: int) -> None:
        if len(self.powers) < n:
            with np.errstate(over="ignore"):
                self.powers = np.concatenate(([np.uint64(1)], np.cumprod(np.full(n, _P, np.uint64), dtype=np.uint64)))
                self.inverse = np.concatenate(([np.uint64(1)], np.cumprod(np.full(n, _P_INV, np.uint64), dtype=np.uint64)))

    def _bucket(self, h: np.ndarray, salt: int) -> np.ndarray:
        h = (h + np.uint64(salt)) * np.uint64(0x9E37_79B9_7F4A_7C15)
        h ^= h >> np.uint64(29)
        return ((h * np.uint64(0xBF58_476D_1CE4_E5B9)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def features(self, data: np.ndarray, offs: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        if not len(data):
            return
        owner = np.repeat(np.arange(len(offs) - 1, dtype=np.int32), np.diff(offs))
        x = data.astype(np.uint64)
        for n in self.orders:
            if len(x) >= n:
                h = x[: len(x) - n + 1].copy()
                for k in range(1, n):
                    h |= x[k : len(x) - n + 1 + k] << np.uint64(8 * k)
                whole = owner[: len(owner) - n + 1] == owner[n - 1 :]
                yield owner[: len(owner) - n + 1][whole], self._bucket(h, n)[whole]
        space = (data == 32) | ((data >= 9) & (data <= 13))
        edge = np.zeros(len(data) + 1, bool)
        edge[offs] = True
        first = np.flatnonzero(~space & (np.concatenate(([True], space[:-1])) | edge[:-1]))
        last = np.flatnonzero(~space & (np.concatenate((space[1:], [True])) | edge[1:])) + 1
        if not len(first):
            return
        self._power(len(data) + 1)
        total = np.concatenate(([np.uint64(0)], np.cumsum((x + np.uint64(1)) * self.powers[: len(x)], dtype=np.uint64)))
        word = (total[last] - total[first]) * self.inverse[first]
        of = owner[first]
        yield of, self._bucket(word, 11)
        same = of[1:] == of[:-1]
        yield of[1:][same], self._bucket(word[1:] * np.uint64(0x2545_F491_4F6C_DD1D) + word[:-1], 12)[same]
        # a pair of one word and itself, whatever the word
        yield of[1:][same], self._bucket((word[1:] == word[:-1]).astype(np.uint64), 13)[same]


@dataclass
class Model:
    logit: np.ndarray  # by bucket
    bias: float
    bits: int


def fit_sgd(rows: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, bits: int, dim: int = 8, epochs: int = 12, rate: float = 0.8) -> Model:
    """rows: (buckets, their shares of the document's features)."""
    rng = np.random.default_rng(11)
    emb = (rng.random((1 << bits, dim)) - 0.5) / dim
    out = np.zeros((dim, 2))
    bias = np.zeros(2)
    steps, total = 0, max(1, epochs * len(rows))
    for _ in range(epochs):
        for i in rng.permutation(len(rows)):
            lr = rate * (1 - steps / total)
            steps += 1
            f, v = rows[i]
            h = v @ emb[f] if len(f) else np.zeros(dim)
            g = softmax((h @ out + bias)[None])[0]
            g[y[i]] -= 1
            back = out @ g
            out -= lr * np.outer(h, g)
            bias -= lr * 0.1 * g
            if len(f):
                emb[f] -= (lr * 10) * v[:, None] * back[None]
    return Model((emb @ (out[:, 1] - out[:, 0])).astype(np.float32), float(bias[1] - bias[0]), bits)


def train(docs: DataFrame, labels: DataFrame, max_train: int = 6000, bits: int = 16, max_train_chars: int = 50_000, max_train_bytes: int = 128 << 20) -> Model:
    """Fit on the rows of ``labels`` (doc_id, quality) with the texts of their documents: about ``max_train`` rows and at most about
    ``max_train_bytes`` bytes, of texts of at most ``max_train_chars`` characters."""
    marks = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("y")).where("doc_id is not null and y in (0, 1)")
    n = marks.count()
    share = min(1.0, max_train / max(1, n))
    marks = marks.where(F.pmod(F.xxhash64("doc_id", F.lit(7)), F.lit(1 << 30)) < share * (1 << 30)).limit(2 * max_train)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).where(F.length("text") <= max_train_chars)
    # marks: at most 2 * max_train rows of two numbers
    sample = materialize(texts.join(F.broadcast(marks), "doc_id").select("doc_id", "y", "text").limit(2 * max_train), "quality-sample")
    size = sample.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    if size > max_train_bytes:
        sample = sample.where(F.pmod(F.xxhash64("doc_id", F.lit(8)), F.lit(1 << 30)) < max_train_bytes / size * (1 << 30))
    got = sample.toArrow().combine_chunks()
    discard(sample)
    got = got.sort_by([("doc_id", "ascending"), ("y", "ascending")])
    y = np.array(got.column("y").to_pylist(), np.int64)
    rows: list[tuple[np.ndarray, np.ndarray]] = []
    sub = Subwords(bits)
    for batch in got.select(["text"]).combine_chunks().to_batches():
        for _, _, data, offs in text_parts(batch, "text", 1):
            f, c = np.unique(np.concatenate([np.zeros(0, np.int64), *(h for _, h in sub.features(data, offs))]), return_counts=True)
            rows.append((f, c / max(1, c.sum())))
    return fit_sgd(rows, y, bits)


def predict(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """(doc_id, score) for every row of ``docs``: the probability of label 1."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sub = Subwords(model.bits)
        for batch in batches:
            for a, b, data, offs in text_parts(batch, "text", 1 << 20):
                total, n = np.zeros(b - a), np.zeros(b - a)
                for owner, h in sub.features(data, offs):
                    total += np.bincount(owner, model.logit[h], b - a)
                    n += np.bincount(owner, minlength=b - a)
                score = 1 / (1 + np.exp(-np.clip(total / np.maximum(n, 1) + model.bias, -60, 60)))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(score)], ["doc_id", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, score double")


def classify(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, **options) -> DataFrame:
    """Learn from labels that aren't held out, score all documents: (doc_id, held_out, score, predicted)."""
    model = train(docs, labels.where(~held_out(0, 5)), **options)
    return predict(docs, model).withColumn("held_out", held_out(0, 5)).withColumn("predicted", (F.col("score") >= threshold).cast("int")).select("doc_id", "held_out", "score", "predicted")
