"""SimHash near-duplicates by the generalised pigeonhole principle.

Fingerprint: 64 bits, bit b set when more than half of a text's word-shingle hashes (XXH64, seed 42) have it.
Two fingerprints link when at most ``tau`` bits differ.  Search over the *distinct* fingerprints, so groups of
exact copies weigh as one:

1.  Counts of bits and of pairs of bits over all distinct fingerprints give correlations; correlated bits are
    gathered into the same partition, for each of several numbers m of partitions.
2.  If thresholds t_1..t_m (each from -1, "not probed", to tau) sum to tau - m + 1, every linked pair is within
    t_i in some partition i.  A dynamic programme picks the thresholds with the lowest cost: estimated candidate
    pairs plus rows to shuffle.  The estimates rest on the exact histogram of every partition's values, so a
    partition on which many fingerprints agree is probed with a lower threshold or not at all.
3.  Each fingerprint is indexed by its value in partition i and probed by all values within t_i; the Hamming
    distance is verified inside the join, so only links leave it.
4.  Distributed union-find; a document's component is the smallest doc_id it reaches.

Defined cases: null text is empty; no words give fingerprint zero, linked like any other; fewer words than a
shingle give one shingle; rows repeated with one doc_id give one row each; rows with a null doc_id take no part; other columns
are ignored, whatever their names.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, connected_components, materialize, text_parts

BITS = 64


def shingle_hashes(data: np.ndarray, offs: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """XXH64 (seed 42) of the ``width``-word shingles of each text, and how many each text has."""
    n = len(offs) - 1
    low = ascii_lower(data)
    space = (low == 32) | ((low >= 9) & (low <= 13))
    start = np.zeros(len(low) + 1, bool)
    start[offs[:-1]] = True
    start = start[: len(low)]
    before = np.empty_like(space)
    if len(low):
        before[0] = True
        before[1:] = space[:-1]
    before |= start
    firsts = np.flatnonzero(~space & before)
    after = np.ones(len(low), bool)
    after[:-1] = before[1:]
    # `before` also marks the byte that follows a text's end, so a word ends where the next byte is white or another text
    if len(low):
        after[:-1] = space[1:] | start[1:]
    lasts = np.flatnonzero(~space & after) + 1
    owner = np.searchsorted(offs, firsts, side="right") - 1
    words = np.bincount(owner, minlength=n) if len(firsts) else np.zeros(n, np.int64)
    # the words once more, one space apart: a shingle is a slice of that
    lengths = lasts - firsts
    begins = np.zeros(len(firsts) + 1, np.int64)
    np.cumsum(lengths + 1, out=begins[1:])
    flat = np.full(int(begins[-1]), 32, np.uint8)
    if len(firsts):
        keep = ~space
        where = np.arange(int(lengths.sum())) + np.repeat(np.arange(len(firsts)), lengths)
        flat[where] = low[keep]
    joined = flat.tobytes()
    counts = np.where(words >= width, words - width + 1, (words > 0).astype(np.int64))
    first_word = np.concatenate(([0], np.cumsum(words)))[:-1]
    lead = np.repeat(first_word, counts) + (np.arange(int(counts.sum())) - np.repeat(np.concatenate(([0], np.cumsum(counts)))[:-1], counts))
    span = np.repeat(np.minimum(words, width), counts)
    lo = begins[lead].tolist() if len(lead) else []
    hi = (begins[lead + span] - 1).tolist() if len(lead) else []
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(joined[a:b], 42) for a, b in zip(lo, hi)), np.uint64, len(lo))
    return hashes, counts


def fold(hashes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """One fingerprint a text: a bit is set when more than half of the text's hashes have it."""
    out = np.zeros(len(counts), np.uint64)
    ends = np.cumsum(counts)
    step = 1 << 17
    some = np.flatnonzero(counts)
    weights = np.uint64(1) << np.arange(BITS, dtype=np.uint64)
    i = 0
    while i < len(some):
        j = max(i + 1, int(np.searchsorted(ends[some], (ends[some[i]] - counts[some[i]]) + step)))
        rows = some[i:j]
        lo, hi = ends[rows[0]] - counts[rows[0]], ends[rows[-1]]
        total = np.zeros((len(rows), BITS), np.int64)
        if len(rows) == 1:  # a very long text, in pieces
            for k in range(lo, hi, step):
                part = np.ascontiguousarray(hashes[k : min(hi, k + step)])
                total[0] += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
        else:
            bits = np.unpackbits(np.ascontiguousarray(hashes[lo:hi]).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            total = np.add.reduceat(bits, (ends[rows] - counts[rows] - lo), axis=0, dtype=np.int32)
        out[rows] = ((total * 2 > counts[rows][:, None]).astype(np.uint64) * weights).sum(1, dtype=np.uint64)
        i = j
    return out


def fingerprints(docs: DataFrame, width: int = 3, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """(doc_id, fp): fp is the fingerprint's 64 bits as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0)
            for a, b, data, offs in text_parts(batch, "text"):
                fp = fold(*shingle_hashes(data, offs, width))
                yield pa.RecordBatch.from_arrays([ids.slice(a, b - a), pa.array(fp.view(np.int64))], ["doc_id", "fp"])

    picked = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).where("doc_id is not null")
    return picked.mapInArrow(run, "doc_id long, fp long")


def bit_statistics(distinct: DataFrame) -> tuple[int, np.ndarray]:
    """(number of fingerprints, 64 x 64 counts of both bits set), over all of them: one small matrix leaves each task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros((BITS, BITS)), 0
        for batch in batches:
            fp = batch.column(0).to_numpy(zero_copy_only=False)
            for k in range(0, len(fp), 1 << 15):
                x = np.unpackbits(np.ascontiguousarray(fp[k : k + (1 << 15)]).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(np.float32)
                total += x.T @ x
                n += len(x)
        if n:
            cell = np.arange(BITS * BITS + 1, dtype=np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(cell), pa.array(np.append(total.ravel(), n).astype(np.int64))], ["cell", "n"])

    rows = distinct.select("fp").mapInArrow(run, "cell int, n long").groupBy("cell").agg(F.sum("n").alias("n")).collect()  # 4,097 rows at any size
    both = np.zeros(BITS * BITS + 1)
    for r in rows:
        both[r["cell"]] = r["n"]
    return int(both[-1]), both[:-1].reshape(BITS, BITS)


def correlated_partitions(n: int, both: np.ndarray, m: int) -> list[list[int]]:
    """``m`` partitions of 64 bits, correlated bits together: each partition grows from a seed by the bit most correlated with it."""
    p = np.diag(both) / max(n, 1)
    cov = both / max(n, 1) - np.outer(p, p)
    sd = np.sqrt(np.maximum(p * (1 - p), 1e-12))
    corr = np.abs(cov / np.outer(sd, sd))
    np.fill_diagonal(corr, 0)
    left, parts = set(range(BITS)), []
    for i in range(m):
        room = len(left) // (m - i)
        at = max(left, key=lambda j: (corr[j, sorted(left)].sum(), -j))
        part = [at]
        left.discard(at)
        while len(part) < room:
            at = max(left, key=lambda j: (corr[j, part].sum(), -j))
            part.append(at)
            left.discard(at)
        parts.append(sorted(part))
    return parts


def part_value(bits: list[int]):
    """The bits of a partition, gathered into the low bits of a long (runs of neighbouring bits move together)."""
    out, low, k = F.lit(0).cast("long"), 0, 0
    while k < len(bits):
        j = k
        while j + 1 < len(bits) and bits[j + 1] == bits[j] + 1:
            j += 1
        run = j - k + 1
        moved = F.shiftrightunsigned(F.col("fp"), bits[k]).bitwiseAND(F.lit((1 << run) - 1 if run < 64 else -1))
        out = out.bitwiseOR(F.shiftleft(moved, low))
        low, k = low + run, j + 1
    return out


def neighbourhood(width: int, t: int) -> list[int]:
    """All XOR masks of at most ``t`` of ``width`` bits."""
    masks = [0]
    for k in range(1, t + 1):
        masks += [sum(1 << b for b in c) for c in itertools.combinations(range(width), k)]
    return [x - (1 << 64) if x >= 1 << 63 else x for x in masks]


def allocate(cost: list[list[float]], total: int) -> tuple[float, list[int]]:
    """Thresholds from -1 up with the given sum and the least total cost; cost[i][t + 1] is that of threshold t in partition i."""
    best: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
    for row in cost:
        new: dict[int, tuple[float, list[int]]] = {}
        for s, (c, ts) in best.items():
            for k, x in enumerate(row):
                key = s + k - 1
                if key not in new or c + x < new[key][0]:
                    new[key] = (c + x, [*ts, k - 1])
        best = new
    return best[total]


def plan(distinct: DataFrame, tau: int, sizes: tuple[int, ...] = (2, 3, 4)) -> list[tuple[list[int], int]]:
    """[(bits of a partition, its threshold)], the cheapest over several numbers of partitions."""
    n, both = bit_statistics(distinct)
    if n < 2:
        return []
    p = np.diag(both) / n
    differ = np.clip(2 * p * (1 - p), 1e-9, 1 - 1e-9)
    layouts = {m: correlated_partitions(n, both, m) for m in sizes if m <= tau + 1}
    # exact numbers of pairs that agree on a partition, from the histograms of its values
    tagged = F.explode(F.array(*[F.struct(F.lit(m * 100 + i).alias("part"), part_value(bits).alias("v")) for m, parts in layouts.items() for i, bits in enumerate(parts)]))
    squares = {
        r["part"]: float(r["pairs"])
        for r in distinct.select(tagged.alias("x")).select("x.part", "x.v").groupBy("part", "v").agg(F.count(F.lit(1)).alias("c")).groupBy("part").agg(F.sum(F.expr("cast(c as double) * (c - 1) / 2")).alias("pairs")).collect()
    }  # a row for each partition
    best: tuple[float, list] | None = None
    for m, parts in layouts.items():
        cost = []
        for i, bits in enumerate(parts):
            pairs = max(squares.get(m * 100 + i, 0.0), n * n / 2 * float(np.prod(1 - differ[bits])))
            odds = differ[bits] / (1 - differ[bits])
            ways = np.zeros(tau + 1)
            ways[0] = 1
            for o in odds:
                ways[1:] += o * ways[:-1]
            row = [0.0]
            for t in range(tau + 1):
                probes = sum(math.comb(len(bits), k) for k in range(t + 1))
                # a candidate costs a comparison in the join, a probe a shuffled row
                row.append(pairs * float(ways[: t + 1].sum()) * 1.0 + n * (probes + 1) * 4.0)
            cost.append(row)
        found = allocate(cost, tau - m + 1)
        if best is None or found[0] < best[0]:
            best = (found[0], [(bits, t) for bits, t in zip(parts, found[1]) if t >= 0])
    return best[1]


def links(distinct: DataFrame, tau: int = 3, chosen: list[tuple[list[int], int]] | None = None) -> DataFrame:
    """(a, b), a < b: all pairs of distinct fingerprints with at most ``tau`` differing bits."""
    chosen = plan(distinct, tau) if chosen is None else chosen
    if not chosen:
        return distinct.sparkSession.createDataFrame([], "a long, b long")
    index = F.explode(F.array(*[F.struct(F.lit(i).alias("part"), part_value(bits).alias("key")) for i, (bits, _) in enumerate(chosen)]))
    probe = None
    for i, (bits, t) in enumerate(chosen):
        masks = F.array(*[F.lit(x).cast("long") for x in neighbourhood(len(bits), t)])
        one = distinct.select("fp", part_value(bits).alias("v"), F.explode(masks).alias("mask"))
        one = one.select(F.col("fp").alias("b"), F.lit(i).alias("part"), F.col("v").bitwiseXOR(F.col("mask")).alias("key"))
        probe = one if probe is None else probe.unionByName(one)
    indexed = distinct.select(F.col("fp").alias("a"), index.alias("x")).select("a", "x.part", "x.key")
    near = F.expr(f"a < b and bit_count(a ^ b) <= {int(tau)}")
    left, right = indexed.alias("l"), probe.alias("r")
    same = (F.col("l.part") == F.col("r.part")) & (F.col("l.key") == F.col("r.key"))
    return left.join(right.hint("merge"), same & near).select("a", "b").distinct()


def near_duplicates(docs: DataFrame, width: int = 3, tau: int = 3, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """(doc_id, fp, component_id) for every document."""
    held = materialize(fingerprints(docs, width, text_col, id_col), "simhash")
    distinct = materialize(held.groupBy("fp").agg(F.min("doc_id").alias("least")), "simhash-fp")
    comp = connected_components(links(distinct, tau), "simhash")
    of_fp = distinct.join(comp.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "least", F.coalesce("component", "fp").alias("component"))
    names = of_fp.groupBy("component").agg(F.min("least").alias("component_id"))
    of_fp = materialize(of_fp.join(names, "component").select("fp", "component_id"), "simhash-c")
    return held.join(of_fp, "fp").select("doc_id", "fp", "component_id")
