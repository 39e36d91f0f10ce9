"""Exact Jaccard join of documents on word shingles, by adaptive multi-match prefixes.

A document's set: its distinct shingles of ``width`` words.  Two sets link when |A & B| >= similarity * |A | B|.  Sets that are equal are one from
the start, so that a group of copies weighs as one document.

1.  All sets share one order of their shingles: those that many sets hold come last (frequencies of the ``frequent`` most frequent ones are
    counted block by block over the whole corpus; the order decides the cost alone, never the result), all others by their hash.
2.  If two sets link, they share at least t = ceil(similarity * n) shingles, n the size of either.  The first n - t + l shingles of both then have at least l in
    common (l <= t).  An index holds these for l up to ``longest``.
3.  Each document picks its own l: the sizes of the index lists along its prefix bound the candidates with l matches by (sum of the lists) / l, and
    the l with the least cost of lists plus verifications is taken.  A longer prefix makes more list entries, and asks for as many more matches.
    Two documents are candidates if they share as many prefix shingles as the smaller l of both; list entries that can't be part of so many are dropped.
4.  Components need no pair within a group of near copies that is joined already.  First each document meets one hub, the document with the largest
    lists of those it shares its lists with.  After a union-find only pairs of different components meet, whose sizes and parities
    (an odd difference in one of ``64 * WORDS`` buckets is a shingle of one set only) allow a link, and only those with enough matches are verified.
5.  Verification is exact on the whole sets; distributed union-find; a document's component is the smallest doc_id it reaches.

Tables that are joined to all documents (two longs a row) are broadcast up to ``broadcast_rows`` rows, counted first, and sort-merge joined otherwise.

Defined cases: A-Z are lower-cased and no others; fewer words than a shingle make the whole sequence one shingle; without words or text a set is
empty and linked with nothing; rows repeated with one doc_id give one row each; rows with a null doc_id take no part; other columns are
ignored, whatever their names; shingles and sets are told apart by 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, connected_components, discard, materialize, text_parts

#: Longs of a set's parities.
WORDS = 16

_rng = np.random.default_rng(29)
#: An odd base and its inverse modulo 2 ** 64, random numbers for bytes, places of a shingle and numbers of words.
BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)
BYTES, PLACES, COUNTS = (_rng.integers(1, 1 << 63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1) for n in (256, 64, 64))


def mixed(x: np.ndarray) -> np.ndarray:
    """The finalizer of splitmix64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    if n:
        out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


def word_hashes(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(a hash of each word, the number of words of each text).  Polynomials of the words' bytes come from one running sum."""
    low = ascii_lower(data)
    inside = np.zeros(len(low) + 2, bool)
    inside[1:-1] = (low != 32) & ((low < 9) | (low > 13))
    cut = np.zeros(len(low) + 1, bool)  # a text ends before this byte
    cut[offs] = True
    firsts = np.flatnonzero(inside[1:-1] & (~inside[:-2] | cut[:-1]))
    ends = np.flatnonzero(inside[1:-1] & (~inside[2:] | cut[1:])) + 1
    total = np.zeros(len(low) + 1, np.uint64)
    np.cumsum(BYTES[low] * powers(BASE, len(low)), out=total[1:])
    # the base to the minus first power, by the words' places
    back = powers(INVERSE, len(low) + 1)[firsts]
    words = mixed((total[ends] - total[firsts]) * back + (ends - firsts).astype(np.uint64))
    return words, np.diff(np.searchsorted(firsts, offs))


def sets_of(data: np.ndarray, offs: np.ndarray, width: int) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    words, counts = word_hashes(data, offs)
    each = max(0, len(words) - width + 1)
    shingles = np.zeros(each, np.uint64)
    for k in range(width):
        shingles += words[k : k + each] * PLACES[k]
    shingles = mixed(shingles)
    at = 0
    for n in counts.tolist():
        if n >= width:
            yield np.unique(shingles[at : at + n - width + 1])
        elif n:
            yield mixed((words[at : at + n] * PLACES[:n]).sum(keepdims=True, dtype=np.uint64) + COUNTS[n])
        else:
            yield shingles[:0]
        at += n


def set_id(shingles: np.ndarray) -> int:
    return int(np.int64(np.uint64(xxhash.xxh3_64_intdigest(shingles.tobytes()))))


#: Shingles that a task holds before it counts them.
BLOCK = 1 << 21


def documents_and_counts(docs: DataFrame, width: int, text_col: str, id_col: str) -> DataFrame:
    """Rows (doc_id, n, sid) of all documents, and rows (token, c): shingles that c > 3 different sets of one block hold."""

    def counted(held: list[np.ndarray]) -> pa.RecordBatch:
        tokens, c = np.unique(np.concatenate(held), return_counts=True)
        tokens, c = tokens[c > 3], c[c > 3]
        none = pa.nulls(len(tokens), pa.int64())
        return pa.RecordBatch.from_arrays([none, pa.nulls(len(tokens), pa.int32()), none, pa.array(tokens.view(np.int64)), pa.array(c.astype(np.int32))], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, held, size = set(), [], 0
        for batch in batches:
            ids = batch.column(0)
            for a, b, data, offs in text_parts(batch, "text"):
                n, sid = [], []
                for s in sets_of(data, offs, width):
                    n.append(len(s))
                    sid.append(set_id(s))
                    if sid[-1] not in seen:
                        seen.add(sid[-1])
                        held.append(s)
                        size += len(s)
                    if size > BLOCK:
                        yield counted(held)
                        seen, held, size = set(), [], 0
                none = pa.nulls(b - a, pa.int64())
                yield pa.RecordBatch.from_arrays([ids.slice(a, b - a), pa.array(n, pa.int32()), pa.array(sid, pa.int64()), none, pa.nulls(b - a, pa.int32())], names)
        if held:
            yield counted(held)

    names = ["doc_id", "n", "sid", "token", "c"]
    picked = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).where("doc_id is not null")
    return picked.mapInArrow(run, "doc_id long, n int, sid long, token long, c int")


def frequencies(counted: DataFrame, most: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``most`` most frequent shingles, sorted by hash, and their counts."""
    rows = counted.where("token is not null").groupBy("token").agg(F.sum("c").alias("c")).orderBy(F.desc("c"), "token").limit(most).collect()
    tokens = np.array([r["token"] for r in rows], np.int64).view(np.uint64)
    order = np.argsort(tokens)
    return tokens[order], np.array([r["c"] for r in rows], np.int64)[order]


def least_overlap(n: int, percent: int) -> int:
    return -(-n * percent // 100)


def prefix_index(chosen: DataFrame, tokens: np.ndarray, counts: np.ndarray, width: int, percent: int, longest: int) -> DataFrame:
    """(token, sid, level, n) for the prefixes of the documents (text, sid): a shingle is in the prefix for every l from its level on."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sids = batch.column(1).to_pylist()
            for a, b, data, offs in text_parts(batch, "text"):
                out, who, level, size = [], [], [], []
                for sid, s in zip(sids[a:b], sets_of(data, offs, width)):
                    if not len(s) or set_id(s) != sid:  # another text of a repeated doc_id
                        continue
                    n = len(s)
                    t = least_overlap(n, percent)
                    if len(tokens):
                        at = np.minimum(np.searchsorted(tokens, s), len(tokens) - 1)
                        held = np.where(tokens[at] == s, counts[at], 0)
                        if held.any():
                            s = s[np.argsort(held, kind="stable")]
                    k = min(n - t + min(longest, t), n)
                    out.append(s[:k])
                    who.append(np.full(k, sid, np.int64))
                    level.append(np.maximum(1, np.arange(1, k + 1) - (n - t)).astype(np.int32))
                    size.append(np.full(k, n, np.int32))
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(out).view(np.int64)), pa.array(np.concatenate(who)), pa.array(np.concatenate(level)), pa.array(np.concatenate(size))], ["token", "sid", "level", "n"])

    return chosen.select("text", "sid").mapInArrow(run, "token long, sid long, level int, n int")


def own_sets(batch: pa.RecordBatch, width: int) -> Iterator[list[tuple[int, np.ndarray]]]:
    """[(sid, set)] of a batch (text, sid), a few documents at a time; other texts of a repeated doc_id are left out."""
    sids = batch.column(1).to_pylist()
    for a, b, data, offs in text_parts(batch, "text"):
        kept = [(sid, s) for sid, s in zip(sids[a:b], sets_of(data, offs, width)) if set_id(s) == sid]
        if kept:
            yield kept


def parities(chosen: DataFrame, width: int) -> DataFrame:
    """(sid, n, w0, w1, ...) of the documents (text, sid): whether an odd number of a set's shingles falls in each bucket."""
    bits = 64 * WORDS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for kept in own_sets(batch, width):
                odd = np.array([np.packbits((np.bincount((s % np.uint64(bits)).astype(np.int64), minlength=bits) & 1).astype(np.uint8)) for _, s in kept]).view(np.int64)
                columns = [pa.array([sid for sid, _ in kept], pa.int64()), pa.array([len(s) for _, s in kept], pa.int32()), *(pa.array(odd[:, w]) for w in range(WORDS))]
                yield pa.RecordBatch.from_arrays(columns, ["sid", "n", *(f"w{w}" for w in range(WORDS))])

    return chosen.select("text", "sid").mapInArrow(run, "sid long, n int, " + ", ".join(f"w{w} long" for w in range(WORDS)))


def whole_sets(chosen: DataFrame, width: int) -> DataFrame:
    """(sid, shingles) of the documents (text, sid)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for kept in own_sets(batch, width):
                offsets = pa.array(np.cumsum([0, *(len(s) for _, s in kept)]).astype(np.int32))
                lists = pa.ListArray.from_arrays(offsets, pa.array(np.concatenate([s for _, s in kept]).view(np.int64)))
                yield pa.RecordBatch.from_arrays([pa.array([sid for sid, _ in kept], pa.int64()), lists], ["sid", "shingles"])

    return chosen.select("text", "sid").mapInArrow(run, "sid long, shingles array<bigint>")


def possible(x: str, y: str, percent: int) -> str:
    """Whether two sets can link, by sizes and parities: of n + m shingles at most (100 - percent) / (100 + percent) are in one set only."""
    odd = " + ".join(f"bit_count({x}.w{w} ^ {y}.w{w})" for w in range(WORDS))
    return f"100 * least({x}.n, {y}.n) >= {percent} * greatest({x}.n, {y}.n) AND {100 + percent}L * ({odd}) <= {100 - percent}L * ({x}.n + {y}.n)"


def linked(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) that link, by their whole sets (sid, shingles)."""
    left = sets.select(F.col("sid").alias("a"), F.col("shingles").alias("sa"))
    right = sets.select(F.col("sid").alias("b"), F.col("shingles").alias("sb"))
    met = pairs.join(left, "a").join(right, "b").select("a", "b", F.expr("size(sa) + size(sb)").alias("s"), F.expr("size(array_intersect(sa, sb))").alias("c"))
    return met.where(f"100L * c >= {percent}L * (s - c)").select("a", "b").distinct()


def bounded(df: DataFrame, n: int, limit: int) -> DataFrame:
    """Broadcast a table whose n rows (two longs each) were counted, if they are few enough."""
    return F.broadcast(df) if n <= limit else df


def near(index: DataFrame, longest: int, percent: int) -> DataFrame:
    """(token, sid, n, l, weight): the prefix shingles that at least two sets hold, up to the l that each set picks, but for those that make no candidates; weight: the
    sum of a set's lists."""
    lists = index.groupBy("token").agg(F.count(F.lit(1)).alias("f")).where("f > 1")
    shared = materialize(index.join(lists, "token"), "jaccard-shared")
    sums = [F.sum(F.when(F.col("level") <= k, F.col("f") - 1).otherwise(0)).alias(f"s{k}") for k in range(1, longest + 1)]
    held = [F.count_if(F.col("level") <= k).alias(f"m{k}") for k in range(1, longest + 1)]
    # a list entry costs 1, a candidate's verification its set's shingles to move and compare; l above the least overlap is no choice
    cost = [F.expr(f"CASE WHEN {k} = 1 OR 100 * {k} <= {percent} * n THEN struct(s{k} * (1D + (16 + n / 16D) / {k}) AS cost, {k} AS l, m{k} AS m) END") for k in range(1, longest + 1)]
    best = F.array_min(F.array_compact(F.array(*cost)))
    picked = shared.groupBy("sid").agg(F.first("n").alias("n"), *sums, *held).select("sid", best["l"].alias("l"), best["m"].alias("m"), F.col("s1").alias("weight"))
    cut = materialize(shared.join(picked, "sid").where("level <= l").select("token", "sid", "n", "l", "m", "weight"), "jaccard-cut")
    # of two candidates, the one with the smaller l has at least l shingles in lists at all (m), and the other has as many: a list without such a
    # member makes no candidates, nor does a member with fewer than the least l of those
    least = cut.where("m >= l").groupBy("token").agg(F.min("l").alias("needed"))
    out = materialize(cut.join(least, "token").where("m >= needed").select("token", "sid", "n", "l", "weight"), "jaccard-near")
    discard(shared, cut)
    return out


def components(docs: DataFrame, width: int = 5, percent: int = 80, longest: int = 6, frequent: int = 1 << 16, broadcast_rows: int = 2_000_000, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """(doc_id, n_shingles, component_id) for every document; two link when 100 * |A & B| >= percent * |A | B|."""
    first = materialize(documents_and_counts(docs, width, text_col, id_col), "jaccard-docs")
    tokens, counts = frequencies(first, frequent)
    rows = first.where("token is null").select("doc_id", "n", "sid")
    classes = materialize(rows.where("n > 0").groupBy("sid").agg(F.min("doc_id").alias("least")), "jaccard-classes")

    def texts_of(holders: DataFrame) -> DataFrame:
        """(text, sid) of (doc_id, sid)."""
        texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
        return texts.join(bounded(holders, holders.count(), broadcast_rows), "doc_id").select("text", "sid")

    index = materialize(prefix_index(texts_of(classes.select(F.col("least").alias("doc_id"), "sid")), tokens, counts, width, percent, longest), "jaccard-index")
    close = near(index, longest, percent)
    discard(index)

    def holders(sids: DataFrame) -> DataFrame:
        return materialize(classes.join(sids.distinct(), "sid").select(F.col("least").alias("doc_id"), "sid"), "jaccard-holders")

    def verified(pairs: DataFrame) -> DataFrame:
        """The links among pairs; only the sets that stand in a pair are made and moved."""
        pairs = materialize(pairs, "jaccard-pairs")
        asked = holders(pairs.select(F.explode(F.array("a", "b")).alias("sid")))
        # rows repeated with one doc_id give a set each: its pairs come twice then, which changes no component
        sets = materialize(whole_sets(texts_of(asked), width), "jaccard-sets")
        out = materialize(linked(pairs, sets, percent), "jaccard-links")
        discard(pairs, asked, sets)
        return out

    asked = holders(close.select("sid"))
    prints = materialize(parities(texts_of(asked), width), "jaccard-parities")
    discard(asked)

    # each set meets the hub that it shares the most lists with
    hubs = close.groupBy("token").agg(F.max(F.struct("weight", "sid")).alias("top")).select("token", F.col("top.sid").alias("hub"))
    spokes = close.join(hubs, "token").where("sid <> hub").groupBy("sid", "hub").agg(F.count(F.lit(1)).alias("c"))
    spokes = spokes.groupBy("sid").agg(F.max(F.struct("c", "hub"))["hub"].alias("hub")).select(F.least("sid", "hub").alias("a"), F.greatest("sid", "hub").alias("b")).distinct()
    spokes = spokes.join(prints.alias("x"), F.expr("a = x.sid")).join(prints.alias("y"), F.expr(f"b = y.sid AND {possible('x', 'y', percent)}")).select("a", "b").distinct()
    links = verified(spokes)
    joined = materialize(connected_components(links, "jaccard"), "jaccard-joined")

    # lists whose sets aren't in one component yet
    left = close.drop("weight").join(joined.withColumnRenamed("node", "sid"), "sid", "left").withColumn("component", F.coalesce("component", "sid"))
    parts = left.groupBy("token", "component").agg(F.count(F.lit(1)).alias("c")).groupBy("token").agg(F.max(F.struct("c", "component"))["component"].alias("main"), F.count(F.lit(1)).alias("parts"))
    left = left.join(parts.where("parts > 1").select("token", "main"), "token").join(prints.drop("n"), "sid")
    left = materialize(left, "jaccard-left")
    minor = left.where("component <> main").alias("x")
    met = minor.join(left.alias("y"), F.expr(f"x.token = y.token AND x.component <> y.component AND (y.component = y.main OR x.sid < y.sid) AND {possible('x', 'y', percent)}"))
    met = met.groupBy(F.least("x.sid", "y.sid").alias("a"), F.greatest("x.sid", "y.sid").alias("b")).agg(F.count(F.lit(1)).alias("c"), F.min(F.least("x.l", "y.l")).alias("l"))
    more = verified(met.where("c >= l").select("a", "b"))
    discard(close, prints, left)

    known = joined.where("node <> component").select(F.col("node").alias("a"), F.col("component").alias("b"))
    final = connected_components(known.unionByName(more), "jaccard")
    of_set = materialize(classes.join(final.withColumnRenamed("node", "sid"), "sid", "left").withColumn("component", F.coalesce("component", "sid")), "jaccard-final")
    names = of_set.groupBy("component").agg(F.min("least").alias("component_id"))
    of_set = materialize(of_set.join(names, "component").select("sid", "component_id"), "jaccard-names")
    out = rows.where("n > 0").join(of_set, "sid").select("doc_id", F.col("n").cast("long").alias("n_shingles"), "component_id")
    return out.unionByName(rows.where("n = 0").select("doc_id", F.lit(0).cast("long").alias("n_shingles"), F.col("doc_id").alias("component_id")))
