"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams.

Features are character 1- to 3-grams of the case-folded text, everything but letters read as one kind of gap,
hashed to ``1 << bucket_bits`` buckets; weights log(1 + tf) * idf, L2-normalised.  Inverse document frequencies are
counted over *all* documents that may be learned from.  The weights are fitted by FTRL-proximal (elastic net: l1, l2)
on at most about ``max_train`` of these documents, dealt evenly over the languages by a hash of doc_id; a fifth of the
sample is kept out of the fit to calibrate a softmax temperature.  Prediction is one pass over the texts, in
Arrow batches cut into pieces of a few MB, so memory doesn't grow with the table.

Defined cases: null text or text without a letter is ``und`` with score 0; with nothing to learn from every text with a
letter is ``und`` too; texts longer than ``max_train_chars`` are predicted whole but not sampled for the fit;
repeated rows give a row each; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import text_parts

SMALL = 0x250  # code points up to Latin Extended-B go by a table, others are looked at one by one
UND = "und"


def fold_table() -> np.ndarray:
    """Code point -> lower-case code point, or a blank for what isn't a letter."""
    return np.array([ord(low) if chr(c).isalpha() and len(low := chr(c).lower()) == 1 else (c if chr(c).isalpha() else 32) for c in range(SMALL)], np.uint32)


class NGrams:
    """Hashed character n-grams of a run of texts."""

    def __init__(self, bits: int = 14, orders: tuple[int, ...] = (1, 2, 3)):
        self.bits, self.orders, self.fold, self.seen = bits, orders, fold_table(), {}

    def chars(self, data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Folded code points, their offsets, and whether each text has a letter."""
        cps = np.frombuffer(data.tobytes().decode("utf-8", "replace").encode("utf-32-le", "replace"), np.uint32)
        lead = np.concatenate(([0], np.cumsum((data & 0xC0) != 0x80)))
        at = lead[offs]
        out = self.fold[np.minimum(cps, SMALL - 1)]
        for i in np.flatnonzero(cps >= SMALL) if (cps >= SMALL).any() else ():
            c = int(cps[i])
            if c not in self.seen:
                low = chr(c).lower()
                self.seen[c] = (ord(low) if len(low) == 1 else c) if chr(c).isalpha() else 32
            out[i] = self.seen[c]
        letters = np.concatenate(([0], np.cumsum(out != 32)))
        return out, at, letters[at[1:]] > letters[at[:-1]]

    def hashed(self, cps: np.ndarray, at: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """For each order: the text of every n-gram, and its bucket; gaps among gaps don't count."""
        owner = np.repeat(np.arange(len(at) - 1), np.diff(at))
        x = cps.astype(np.uint64)
        for n in self.orders:
            if len(x) < n:
                continue
            h = x[: len(x) - n + 1].copy()
            for k in range(1, n):
                h = h * np.uint64(0x1_0000_01B3) + x[k : len(x) - n + 1 + k]
            h = ((h + np.uint64(n)) * np.uint64(0x9E37_79B9_7F4A_7C15)) >> np.uint64(64 - self.bits)
            whole = owner[: len(owner) - n + 1] == owner[n - 1 :]
            whole &= ~((cps[: len(cps) - n + 1] == 32) & (cps[n - 1 :] == 32)) if n > 1 else cps != 32
            yield owner[: len(owner) - n + 1][whole], h[whole].astype(np.int64)

    def counts(self, data: np.ndarray, offs: np.ndarray, rows: int = 64) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(first text, has a letter, texts x buckets counts), a bounded number of texts at a time."""
        cps, at, letter = self.chars(data, offs)
        size = 1 << self.bits
        for i in range(0, len(offs) - 1, rows):
            j = min(i + rows, len(offs) - 1)
            total = np.zeros((j - i) * size, np.int64)
            for owner, h in self.hashed(cps[at[i] : at[j]], at[i : j + 1] - at[i]):
                total += np.bincount(owner * size + h, minlength=len(total))
            yield i, letter[i:j], total.reshape(j - i, size)


def tfidf(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    x = np.log1p(counts, dtype=np.float32) * idf
    return x / np.maximum(np.sqrt((x * x).sum(1, keepdims=True)), 1e-9)


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


@dataclass
class Model:
    labels: list[str]
    weights: np.ndarray  # buckets x labels
    bias: np.ndarray
    idf: np.ndarray
    temperature: float
    bits: int


Sparse = tuple[np.ndarray, np.ndarray]  # buckets of a document and their weights


def sparse_rows(x: np.ndarray) -> list[Sparse]:
    return [(f.astype(np.int32), row[f].copy()) for row in x for f in [np.flatnonzero(row)]]


def fit_ftrl(rows: list[Sparse], y: np.ndarray, size: int, k: int, alpha: float = 2.0, beta: float = 1.0, l1: float = 1e-4, l2: float = 1e-4, epochs: int = 4) -> tuple[np.ndarray, np.ndarray]:
    """FTRL-proximal, one document at a time, over the buckets that it has; the last coordinate is the bias."""
    d = size + 1
    z, n = np.zeros((d, k)), np.zeros((d, k))
    rng = np.random.default_rng(7)

    def weights(at) -> np.ndarray:
        zr, nr = z[at], n[at]
        w = -(zr - np.sign(zr) * l1) / ((beta + np.sqrt(nr)) / alpha + l2)
        return np.where(np.abs(zr) <= l1, 0.0, w)

    for _ in range(epochs):
        for i in rng.permutation(len(rows)):
            f, v = np.append(rows[i][0], d - 1), np.append(rows[i][1], 1.0)
            w = weights(f)
            p = softmax((v @ w)[None])[0]
            p[y[i]] -= 1
            g = v[:, None] * p[None]
            sigma = (np.sqrt(n[f] + g * g) - np.sqrt(n[f])) / alpha
            z[f] += g - sigma * w
            n[f] += g * g
    w = weights(np.arange(d))
    return w[:-1], w[-1]


def calibrate(logits: np.ndarray, y: np.ndarray) -> float:
    """The temperature with the least cross-entropy, from a fine grid."""
    grid = np.exp(np.linspace(np.log(0.05), np.log(5), 120))
    loss = [-np.log(np.maximum(softmax(logits / t)[np.arange(len(y)), y], 1e-12)).mean() for t in grid]
    return float(grid[int(np.argmin(loss))])


def train(docs: DataFrame, max_train: int = 3000, bits: int = 14, max_train_chars: int = 50_000, max_train_bytes: int = 64 << 20) -> Model | None:
    """Fit on rows of (doc_id, text, lang); rows with a null text or lang teach nothing.

    The sample is of about ``max_train`` rows and ``max_train_bytes`` bytes, of texts of at most ``max_train_chars`` characters; a language that has
    none so short is learned from longer ones, within its share of the bytes, its shortest text at least.
    """
    docs = docs.select("doc_id", "text", "lang").where("text is not null and lang is not null")
    size = 1 << bits

    def document_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams, df = NGrams(bits), np.zeros(size + 1, np.int64)
        for batch in batches:
            for _, _, data, offs in text_parts(batch, "text", 1 << 20):
                for _, letter, c in grams.counts(data, offs):
                    df[:size] += (c > 0).sum(0)
                    df[size] += len(letter)
        if df[size]:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(size + 1, dtype=np.int32)), pa.array(df)], ["bucket", "n"])

    rows = docs.select("text").mapInArrow(document_counts, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()  # a row a bucket
    if not len(rows):
        return None
    df = np.zeros(size + 1)
    df[rows["bucket"].to_numpy()] = rows["n"].to_numpy()
    idf = (np.log((1 + df[size]) / (1 + df[:size])) + 1).astype(np.float32)
    # as many documents of each language, picked by a hash, so that the sample is the same however rows are dealt
    short = F.length("text") <= max_train_chars
    stats = docs.groupBy("lang").agg(
        F.count_if(short).alias("n"), F.sum(F.when(short, F.octet_length("text")).otherwise(0)).alias("bytes"), F.count(F.lit(1)).alias("n_all"), F.sum(F.octet_length("text")).alias("bytes_all"), F.min(F.length("text")).alias("least")
    )
    per = {r["lang"]: r for r in stats.collect()}  # a row a language
    if not per:
        return None
    quota, room = max(1, max_train // len(per)), max_train_bytes / len(per)
    wanted = F.lit(False)
    for k, r in per.items():
        n, held = (r["n"], r["bytes"]) if r["n"] else (r["n_all"], r["bytes_all"])
        share = min(1.0, quota / n, room / max(1, held))
        hit = F.pmod(F.xxhash64("doc_id", F.lit(9)), F.lit(1 << 30)) < share * (1 << 30)
        wanted = wanted | (F.col("lang") == k) & (short & hit if r["n"] else hit | (F.length("text") == r["least"]))
    picked = docs.where(wanted)
    got = picked.select("doc_id", "text", "lang").limit(2 * max_train).toArrow().combine_chunks().sort_by([("doc_id", "ascending"), ("lang", "ascending")])
    labels = sorted(per)
    y = np.array([labels.index(v) for v in got.column("lang").to_pylist()])
    rows_: list[Sparse] = []
    grams = NGrams(bits)
    for batch in got.select(["text"]).combine_chunks().to_batches():
        for _, _, data, offs in text_parts(batch, "text", 1 << 19):
            for _, _, c in grams.counts(data, offs):
                rows_ += sparse_rows(tfidf(c, idf))
    held = np.arange(len(y)) % 5 == 4
    fit = np.flatnonzero(~held if held.any() else np.ones(len(y), bool))
    w, b = fit_ftrl([rows_[i] for i in fit], y[fit], size, len(labels))
    t = calibrate(np.array([rows_[i][1] @ w[rows_[i][0]] + b for i in np.flatnonzero(held)]), y[held]) if held.any() else 1.0
    return Model(labels, w.astype(np.float32), b.astype(np.float32), idf, t, bits)


def annotate(docs: DataFrame, model: Model | None, back: tuple[str, ...] | None = None) -> DataFrame:
    """The columns ``back`` of ``docs`` (all, if not given) with lang_pred and score."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams = NGrams(model.bits if model else 4)
        names = np.array([*(model.labels if model else []), UND], object)
        for batch in batches:
            for a, b, data, offs in text_parts(batch, "text", 1 << 20):
                best, score = np.full(b - a, len(names) - 1), np.zeros(b - a)
                if model:
                    for i, letter, c in grams.counts(data, offs):
                        p = softmax((tfidf(c, model.idf) @ model.weights + model.bias).astype(np.float64) / model.temperature)
                        best[i : i + len(c)] = np.where(letter, p.argmax(1), len(names) - 1)
                        score[i : i + len(c)] = np.where(letter, p.max(1), 0.0)
                part = batch.slice(a, b - a)
                kept = [c for c, n in zip(part.columns, part.schema.names) if n in columns]
                yield pa.RecordBatch.from_arrays([*kept, pa.array(names[best], pa.string()), pa.array(np.clip(score, 0, 1))], [*columns, "lang_pred", "score"])

    docs = docs.drop("lang_pred", "score")
    columns = [c for c in docs.columns if back is None or c in back]
    return docs.mapInArrow(run, docs.select(*columns).schema.add("lang_pred", "string").add("score", "double"))


def predict(docs: DataFrame, model: Model | None) -> DataFrame:
    """(doc_id, lang_pred, score) for every row of ``docs``."""
    return annotate(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), model, back=("doc_id",))


def held_out(residue: int, of: int):
    """Rows whose crc32 of doc_id as text leaves ``residue``."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % of == residue, F.lit(False))


def identify(docs: DataFrame, **options) -> DataFrame:
    """Learn from the rows that aren't held out, predict all: (doc_id, held_out, lang_pred, score)."""
    model = train(docs.where(~held_out(2, 4)), **options)
    return predict(docs, model).withColumn("held_out", held_out(2, 4)).select("doc_id", "held_out", "lang_pred", "score")
