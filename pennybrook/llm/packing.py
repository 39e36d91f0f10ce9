"""Best-fit packing of token sequences by length patterns.

1.  One pass over the texts tokenizes whole documents, appends the end id and cuts those over the capacity into
    pieces; a row a piece goes to the scratch folder, so that no text is tokenized twice.
2.  The histogram of piece lengths (at most ``capacity`` numbers at any corpus size) goes to the driver.  There,
    patterns of up to three documents over coarse length classes are enumerated, their repeat counts fitted to the histogram
    by non-negative least squares and rounded down, and the residual is packed best-fit-decreasing, on counts,
    into what space the patterns leave and into new sequences.
3.  The recipe (a few thousand rows, bounded by the capacity) says for every length which sequence and offset its
    k-th piece gets.  k is counted by (length, bucket of a hash), so a length that a third of all pieces share is
    spread over many tasks, plus the running total of the buckets before.

Defined cases: null text is empty and gives one piece, the end id; a null doc_id and repeated rows are documents like
any other; very long texts are tokenized whole; other columns are ignored.
The string of a special token in a text is that token, as in the published tokenizer's own defaults; ``special_as_text`` makes it ordinary text.
"""

from __future__ import annotations

import base64
import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
_encoders: dict = {}


def byte_bpe(path: str, pattern: str, special: dict[str, int]):
    """An encoder from a file of ranks (base64 token, rank a line) with special tokens; built once a process."""
    if path not in _encoders:
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        _encoders[path] = tiktoken.Encoding("corpus", pat_str=pattern, mergeable_ranks=ranks, special_tokens=special)
    return _encoders[path]


def public_bpe():
    """The published byte-level BPE of 50k tokens, by the tokenizer library that is fastest on it; tests hold its ids against those of byte_bpe_50k.json."""
    import public_tokenizers

    return byte_bpe(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, {"<|endoftext|>": 50256})


def encode(encoder, text: str, chunk: int = 1 << 17, special_as_text: bool = False) -> np.ndarray:
    """Ids of a whole text.  A very long text is cut where a letter meets a single blank before a letter, which no token spans, so time
    and memory stay in proportion."""
    if not special_as_text and any(x in text for x in encoder.special_tokens_set):
        ids = (encoder.encode(part, allowed_special="all") for part in cuts(text, chunk))
    else:
        ids = map(encoder.encode_ordinary, cuts(text, chunk))
    return np.concatenate([np.asarray(x, np.uint32) for x in ids])


def cuts(text: str, chunk: int) -> Iterator[str]:
    """A text in parts of at least ``chunk`` characters."""
    if len(text) <= 2 * chunk:
        yield text
        return
    at = 0
    while at < len(text):
        end = at + chunk
        while end < len(text) and not (text[end] == " " and text[end - 1].isalpha() and text[end + 1 : end + 2].isalpha()):
            end += 1
        yield text[at:end]
        at = end


def pieces(docs: DataFrame, capacity: int = 2048, end_id: int = 0, encoder=public_bpe) -> DataFrame:
    """A row for each piece of each document; a cut document's first piece may be shorter than the others."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = encoder()
        for batch in batches:
            ids, out = batch.column(0), []
            for row in range(batch.num_rows):
                text = batch.column(1)[row].as_py()
                tokens = np.append(encode(bpe, text or ""), np.uint32(end_id)).astype("<u4")
                doc, n = ids[row].as_py(), len(tokens)
                cuts = [0, *range(n % capacity or capacity, n + 1, capacity)] if n > capacity else [0, n]
                for k, (a, b) in enumerate(zip(cuts, cuts[1:])):
                    out.append((doc, k, a, b - a, zlib.crc32(tokens[a:b].tobytes())))
            cols = list(zip(*out)) if out else [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()))], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, PIECES)


def nnls(a: np.ndarray, b: np.ndarray, steps: int = 400) -> np.ndarray:
    """min |a x - b| over x >= 0: Lawson and Hanson's active sets."""
    x, passive = np.zeros(a.shape[1]), np.zeros(a.shape[1], bool)
    w = a.T @ b
    for _ in range(steps):
        w[passive] = -np.inf
        j = int(np.argmax(w))
        if passive.all() or w[j] <= 1e-9 * max(1.0, np.abs(b).max()):
            break
        passive[j] = True
        while True:
            s = np.zeros_like(x)
            s[passive] = np.linalg.lstsq(a[:, passive], b, rcond=None)[0]
            if not passive.any() or s[passive].min() > 0:
                break
            bad = passive & (s <= 0)
            ratio = x[bad] / np.maximum(x[bad] - s[bad], 1e-300)
            x = x + ratio.min() * (s - x)
            passive &= x > 1e-12
            x[~passive] = 0
        x = s
        w = a.T @ (b - a @ x)
    return x


def patterns(classes: int) -> list[tuple[int, ...]]:
    """Up to three length classes that fill ``classes`` units."""
    two = [(classes - j, j) for j in range(1, classes // 2 + 1)]
    three = [(classes - j - k, j, k) for k in range(1, classes // 3 + 1) for j in range(k, (classes - k) // 2 + 1)]
    return [(classes,), *two, *three]


def recipe(histogram: dict[int, int], capacity: int = 2048, unit: int | None = None, least: float = 1 / 5) -> list[tuple[tuple[int, ...], int]]:
    """[(lengths in a sequence, number of such sequences)] for all pieces of the histogram."""
    left = {k: v for k, v in histogram.items() if v > 0}
    unit = unit or max(1, -(-capacity // 128))
    units = capacity // unit
    done: list[tuple[tuple[int, ...], int]] = []
    if left.get(capacity):
        done.append(((capacity,), left.pop(capacity)))
    if units >= 2 and capacity % unit == 0 and left:
        target = np.zeros(units + 1)
        for length, n in left.items():
            target[-(-length // unit)] += n
        # short pieces stay for the rooms that patterns leave
        forms = [p for p in patterns(units) if p[-1] >= least * units and all(target[c] for c in p)]
        if forms:
            a = np.zeros((units + 1, len(forms)))
            for j, p in enumerate(forms):
                for c in p:
                    a[c, j] += 1
            fitted = nnls(a, target)
            for j in np.argsort(-fitted, kind="stable"):
                repeats = int(fitted[j] + 1e-6)
                while repeats > 0:
                    # the longest pieces left in each class, the last slot by what room is left; as many times as all slots last
                    need: dict[int, int] = defaultdict(int)
                    chosen: list[int] = []
                    for c in forms[j]:
                        room = capacity - sum(chosen) if len(chosen) == len(forms[j]) - 1 else unit * c
                        length = next((x for x in range(room, unit * (c - 1), -1) if left.get(x, 0) > need.get(x, 0)), None)
                        if length is None:
                            break
                        need[length] += 1
                        chosen.append(length)
                    if len(chosen) < len(forms[j]):
                        break
                    times = min(repeats, *(left[x] // k for x, k in need.items()))
                    done.append((tuple(chosen), times))
                    for x, k in need.items():
                        left[x] -= k * times
                    repeats -= times
    # the residual, longest first, each into the fullest sequences that have room
    open_: dict[int, list[list]] = defaultdict(list)
    closed: list[tuple[tuple[int, ...], int]] = []
    for lengths, times in done:
        room = capacity - sum(lengths)
        (open_[room].append([lengths, times]) if room else closed.append((lengths, times)))
    for length in sorted((x for x, v in left.items() if v > 0), reverse=True):
        count = left[length]
        while count:
            room = next((r for r in range(length, capacity) if open_.get(r)), None)
            if room is None:
                fit = min(capacity // length, count)
                lengths, times = (length,) * fit, count // fit
                count -= fit * times
            else:
                # one more piece in as many of these sequences as the pieces last; as many a sequence as fit
                old, have = open_[room].pop()
                fit = min(room // length, count)
                times = min(have, count // fit)
                if times < have:
                    open_[room].append([old, have - times])
                lengths = old + (length,) * fit
                count -= fit * times
            rest = capacity - sum(lengths)
            (open_[rest].append([lengths, times]) if rest else closed.append((lengths, times)))
    return closed + [(lengths, times) for room in sorted(open_) for lengths, times in open_[room]]


def slots(plan: list[tuple[tuple[int, ...], int]]) -> dict[int, np.ndarray]:
    """By length: rows (rank of the first piece, its sequence, offset) of each run of pieces that go to consecutive sequences."""
    taken: dict[int, int] = defaultdict(int)
    out: dict[int, list] = defaultdict(list)
    base = 0
    for lengths, times in plan:
        at = 0
        for length in lengths:
            out[length].append((taken[length], base, at))
            taken[length] += times
            at += length
        base += times
    return {k: np.array(v, np.int64) for k, v in out.items()}


def pack(docs: DataFrame, capacity: int = 2048, end_id: int = 0, encoder=public_bpe, buckets: int = 256) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset) for every piece."""
    cut = materialize(pieces(docs, capacity, end_id, encoder), "pieces")
    histogram = {r["length"]: r["n"] for r in cut.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}  # at most `capacity` rows
    total = sum(histogram.values())
    places = slots(recipe(histogram, capacity))
    buckets = max(buckets, total // 50_000)
    keyed = cut.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(buckets)).cast("int"))
    sizes = keyed.groupBy("length", "bucket").agg(F.count(F.lit(1)).alias("n"))
    before = sizes.withColumn("before", F.sum("n").over(Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)))
    before = before.select("length", "bucket", F.coalesce("before", F.lit(0)).alias("before"))
    k = F.row_number().over(Window.partitionBy("length", "bucket").orderBy("doc_id", "piece", "start", "ids_crc32")) - 1
    ranked = keyed.withColumn("k", k).join(before, ["length", "bucket"]).withColumn("rank", F.col("k") + F.col("before"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = (batch.column(batch.schema.get_field_index(c)).to_numpy(zero_copy_only=False) for c in ("length", "rank"))
            seq, off = np.zeros(len(rank), np.int64), np.zeros(len(rank), np.int64)
            order = np.argsort(length, kind="stable")
            cuts = np.flatnonzero(np.diff(length[order])) + 1
            for rows in np.split(order, cuts) if len(order) else ():
                place = places[int(length[rows[0]])]
                at = np.searchsorted(place[:, 0], rank[rows], side="right") - 1
                seq[rows] = place[at, 1] + rank[rows] - place[at, 0]
                off[rows] = place[at, 2]
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(seq), pa.array(off)], ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    return ranked.select("doc_id", "piece", "start", "length", "ids_crc32", "rank").mapInArrow(run, PIECES + ", sequence_id long, offset long")
