"""Removal of repeated substrings across documents, by a Burrows-Wheeler transform expanded up to the minimum length.

Every byte goes that is covered by a ``length``-byte string which also starts in a document of smaller doc_id.

1.  Texts are gathered into blocks of some MB, written once to a table bucketed by block.
2.  Every window of ``length`` bytes belongs to the least hash among the ``GRAM``-byte strings in it, so equal windows
    belong to equal hashes wherever they stand (winnowing).  Neighbouring windows with one least hash form a segment.  A
    block sends each distinct segment once: (least hash, hash of the segment, smallest doc_id); copies inside a block are
    combined before anything is shuffled, so a passage that a third of all documents share costs a row a block.
3.  Segments that meet under one least hash: if all are the same, their windows are repeated as a whole.  If they
    differ (the ends of a shared passage), the blocks send their bytes.  A least hash with very many different segments
    is split by the content of its windows.
4.  Over such segments, a Burrows-Wheeler transform is expanded breadth-first: the intervals of all strings of 0, 1, 2, ...
    bytes follow from each other by backward extension, and each new interval border has a common prefix as long as the
    step says.  At ``length`` the expansion stops; borders not found by then lie inside groups of windows equal on
    ``length`` bytes, and the smallest doc_id of each group is returned to the blocks.
5.  Blocks mark the windows that start in a smaller document too, and cut the bytes that these cover.

Defined cases: null text is empty; texts shorter than ``length`` lose nothing; rows with a null doc_id take no part;
rows repeated with one doc_id don't count against each other and give a row each; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, scratch_dir, text_parts

GRAM = 24
U = np.uint64
RESULT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"
ANSWER = "block long, kind int, segs binary, sizes binary, docs binary"
RESOLVED, WANTED, SPLIT = 0, 1, 2


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> U(31))) * U(0x7FB5_D329_728E_A185)
    x = (x ^ (x >> U(27))) * U(0x81DA_DEF4_BC2D_D44D)
    return x ^ (x >> U(33))


def words8(data: np.ndarray) -> np.ndarray:
    """The 8 bytes from every position on, as numbers (the end padded)."""
    padded = np.concatenate((data, np.zeros(8, np.uint8)))
    return np.ndarray((len(data),), "<u8", padded.data, 0, (1,))


def ramp(counts: np.ndarray) -> np.ndarray:
    """0, 1, ... within each of runs of the given lengths."""
    return np.arange(int(counts.sum())) - np.repeat(np.cumsum(counts) - counts, counts)


def window_hash(w8: np.ndarray, at: np.ndarray, length: int) -> np.ndarray:
    """A 64-bit hash of the ``length`` bytes at each position."""
    h = np.full(len(at), length, U)
    for k in [*range(0, length - 8, 8), length - 8]:
        h = mix(h + w8[at + k] * U(0x9E37_79B9_7F4A_7C15))
    return h


def least_hashes(w8: np.ndarray, n: int, gram: int, span: int) -> np.ndarray:
    """For each of n windows: the least hash of the ``span`` grams that begin in it at its first ``span`` bytes."""
    m = n + span - 1
    h = w8[:m] * U(0x9E37_79B9_7F4A_7C15)
    for k in [*range(8, gram - 8, 8), gram - 8]:
        h ^= h >> U(29)
        h += w8[k : k + m] * U(0xC2B2_AE3D_27D4_EB4F)
        h *= U(0x1656_67B1_9E37_79F9)
    h ^= h >> U(32)
    h *= U(0xD6E8_FEB8_6659_FD93)
    h ^= h >> U(32)
    width = 1
    while width * 2 <= span:
        h = np.minimum(h[: len(h) - width], h[width:])
        width *= 2
    return np.minimum(h[:n], h[span - width : span - width + n])


class Segments:
    """The segments of a run of documents: first byte, windows, least hash, hash of the bytes, document."""

    def __init__(self, data: np.ndarray, offs: np.ndarray, length: int, gram: int = GRAM):
        self.length, self.data = length, data
        gram = min(gram, length)
        sizes = np.diff(offs)
        windows = np.maximum(sizes - length + 1, 0)
        total = int(windows.sum())
        if not total:
            self.first = self.count = self.owner = np.zeros(0, np.int64)
            self.least = self.hash = np.zeros(0, U)
            self.w8 = words8(data)
            return
        self.w8 = w8 = words8(data)
        least = least_hashes(w8, len(data) - length + 1, gram, length - gram + 1)
        before = np.cumsum(windows) - windows
        shift = offs[:-1] - before
        value = np.concatenate([least[a : a + n] for a, n in zip(offs.tolist(), windows.tolist()) if n])
        new = np.ones(total, bool)
        new[1:] = value[1:] != value[:-1]
        new[before[windows > 0]] = True
        starts = np.flatnonzero(new)
        runs = np.diff(np.append(starts, total))
        if runs.max() > length:  # periodic text: cut, so that first and last window hold all bytes of a segment
            new |= ramp(runs) % length == 0
            starts = np.flatnonzero(new)
            runs = np.diff(np.append(starts, total))
        some = np.flatnonzero(windows)
        owner = some[np.searchsorted(before[some], starts, side="right") - 1]
        self.first, self.count, self.owner, self.least = starts + shift[owner], runs, owner, value[starts]
        a, b = window_hash(w8, self.first, length), window_hash(w8, self.first + runs - 1, length)
        self.hash = mix(a + mix(b + runs.astype(U)))


def shortest_rotation_keys(data: np.ndarray, order: int) -> tuple[np.ndarray, np.ndarray]:
    """(suffix order, rank) by the first ``order`` bytes or more: 8-byte keys, doubled."""
    n = len(data)
    key = words8(data).byteswap()
    sa = np.argsort(key)  # rows of equal keys may stand in any order, here and below
    rank = np.empty(n, np.int64)
    rank[sa] = np.cumsum(np.concatenate(([0], (key[sa][1:] != key[sa][:-1]).astype(np.int64))))
    done = 8
    while done < order and rank[sa[-1]] < n - 1:
        later = np.zeros(n, np.int64)
        if done < n:
            later[: n - done] = rank[done:] + 1
        pair = rank * (n + 1) + later
        sa = np.argsort(pair)
        p = pair[sa]
        rank[sa] = np.cumsum(np.concatenate(([0], (p[1:] != p[:-1]).astype(np.int64))))
        done *= 2
    return sa, rank


def bounded_prefixes(bwt: np.ndarray, limit: int) -> np.ndarray:
    """By border between neighbours in suffix order (border k lies before row k): True if their common prefix is shorter than ``limit``.

    Breadth-first: step s holds the intervals of strings of s bytes.  Extending an interval backwards by a byte gives
    that byte's rows, moved by the last-to-first mapping; they are adjacent there.  An interval is extended
    further only if its right border was new, so all steps together extend at most as many intervals as there are rows.
    """
    n = len(bwt)
    order = np.argsort(bwt, kind="stable")
    lf = np.empty(n, np.int64)
    lf[order] = np.arange(n)
    first_of = bwt[order]
    found = np.zeros(n + 1, bool)
    found[0] = found[n] = True
    lo, hi = np.array([0]), np.array([n])
    for _ in range(limit):
        if not len(lo):
            break
        size = hi - lo
        rows = np.repeat(lo, size) + ramp(size)
        to = lf[rows]
        of = np.repeat(np.arange(len(lo)), size)
        if len(rows) * 8 > n:
            line = np.full(n, -1, np.int64)
            line[to] = of
            to = np.flatnonzero(line >= 0)
            of = line[to]
        else:
            by = np.argsort(to, kind="stable")
            to, of = to[by], of[by]
        cut = np.ones(len(to), bool)
        cut[1:] = (to[1:] != to[:-1] + 1) | (of[1:] != of[:-1]) | (first_of[to[1:]] != first_of[to[:-1]])
        begin = np.flatnonzero(cut)
        lo2, hi2 = to[begin], to[np.append(begin[1:], len(to)) - 1] + 1
        new = ~found[hi2]
        found[hi2] = True
        lo, hi = lo2[new], hi2[new]
    return found


def equal_windows(data: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """(suffix order, group of each row): rows of one group agree on ``length`` bytes."""
    sa, _ = shortest_rotation_keys(data, length)
    borders = bounded_prefixes(data[sa - 1], length)
    return sa, np.cumsum(borders[:-1]) - 1


def smallest_documents(data: np.ndarray, begin: np.ndarray, size: np.ndarray, docs: np.ndarray, length: int) -> np.ndarray:
    """For each window of each text (``size`` bytes of ``data`` from ``begin`` on), the smallest of the documents whose texts hold it, one text after the other."""
    flat = np.full(int(size.sum()) + len(size), 255, np.uint8)
    to = np.cumsum(size + 1) - size - 1
    within = ramp(size)
    flat[np.repeat(to, size) + within] = data[np.repeat(begin, size) + within]
    del within
    of = np.full(len(flat), np.iinfo(np.int64).max)
    windows = size - length + 1
    at = np.repeat(to, windows) + ramp(windows)
    of[at] = np.repeat(docs, windows)
    sa, group = equal_windows(flat, length)
    least = np.minimum.reduceat(of[sa], np.flatnonzero(np.diff(group, prepend=-1)))
    out = np.empty(len(flat), np.int64)
    out[sa] = least[group]
    return out[at]


def _blob(x: np.ndarray) -> bytes:
    return np.ascontiguousarray(x).tobytes()


def _cells(t: pa.Table, name: str) -> list:
    return t.column(name).to_pylist()


def blocks_of(docs: DataFrame, block_bytes: int, buckets: int) -> DataFrame:
    """Rows (block, ids, offs, data) in a table bucketed by block: later steps meet their answers without moving text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, k = TaskContext.get().partitionId(), 0
        ids, datas, sizes, held = [], [], [], 0

        def row() -> pa.RecordBatch:
            offs = np.concatenate(([0], np.cumsum(np.concatenate(sizes))))
            return pa.RecordBatch.from_arrays([pa.array([part * (1 << 24) + k]), pa.array([_blob(np.concatenate(ids))], pa.binary()), pa.array([_blob(offs)], pa.binary()), pa.array([_blob(np.concatenate(datas))], pa.binary())], ["block", "ids", "offs", "data"])

        for batch in batches:
            doc = batch.column(0).to_numpy(zero_copy_only=False)
            for a, b, data, offs in text_parts(batch, "text", block_bytes // 4):
                ids.append(doc[a:b])
                datas.append(data.copy())
                sizes.append(np.diff(offs))
                held += len(data) + 64 * (b - a)
                if held >= block_bytes:
                    yield row()
                    k += 1
                    ids, datas, sizes, held = [], [], [], 0
        if ids:
            yield row()

    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("doc_id is not null").mapInArrow(run, "block long, ids binary, offs binary, data binary")
    name = f"blocks_{uuid.uuid4().hex}"
    rows.write.bucketBy(buckets, "block").option("path", f"{scratch_dir(spark)}/pennybrook/{name}").option("compression", "zstd").format("parquet").saveAsTable(name)
    held = spark.table(name)
    spark.sql(f"DROP TABLE {name}")  # the catalog forgets it; the files stay, as the table is external
    return held


def _pieces(row_ids: bytes, row_offs: bytes, row_data: bytes, piece: int = 1 << 21) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """A block a few documents at a time: (doc_ids, offsets, bytes)."""
    ids, offs, data = np.frombuffer(row_ids, np.int64), np.frombuffer(row_offs, np.int64), np.frombuffer(row_data, np.uint8)
    i = 0
    while i < len(ids):
        j = min(len(ids), max(i + 1, int(np.searchsorted(offs, offs[i] + piece, side="right")) - 1))
        yield ids[i:j], offs[i : j + 1] - offs[i], data[offs[i] : offs[j]]
        i = j


def _groups(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order by key, starts of the groups of equal keys in it); rows of a group stand in any order."""
    order = np.argsort(keys)
    k = keys[order]
    new = np.ones(len(k), bool)
    new[1:] = k[1:] != k[:-1]
    return order, np.flatnonzero(new)


def _send(block: int, bucket: np.ndarray, **columns: np.ndarray) -> Iterator[pa.RecordBatch]:
    order = np.argsort(bucket, kind="stable")
    cuts = np.flatnonzero(np.diff(bucket[order])) + 1
    groups = [g for g in np.split(order, cuts) if len(g)]
    if groups:
        yield pa.RecordBatch.from_arrays([pa.array([int(bucket[g[0]]) for g in groups]), pa.array([block] * len(groups)), *(pa.array([_blob(v[g]) for g in groups], pa.binary()) for v in columns.values())], ["bucket", "block", *columns])


def segment_keys(blocks: DataFrame, length: int, buckets: int, most: int) -> DataFrame:
    """(bucket, block, least, seg, doc, many): each block's distinct segments; many: 1 if two documents of the block have it, 2 if
    the block has more than ``most`` different ones under the least hash (then only the first are sent)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                block, ids, offs, data = (batch.column(c)[r].as_py() for c in range(4))
                least, seg, doc = [], [], []
                for d, o, x in _pieces(ids, offs, data):
                    s = Segments(x, o, length)
                    least.append(s.least)
                    seg.append(s.hash)
                    doc.append(d[s.owner])
                least, seg, doc = map(np.concatenate, (least, seg, doc))
                if not len(least):
                    continue
                order, starts = _groups(seg)  # a segment's hash tells its least hash as well
                held = doc[order]
                low, high = np.minimum.reduceat(held, starts), np.maximum.reduceat(held, starts)
                least, seg = least[order[starts]], seg[order[starts]]
                by = np.argsort(least, kind="stable")  # so that a retry keeps the same segments
                least, seg, low, many = least[by], seg[by], low[by], (low != high)[by].astype(np.int8)
                head = np.flatnonzero(np.concatenate(([True], least[1:] != least[:-1])))
                runs = np.diff(np.append(head, len(least)))
                if runs.max() > most:
                    nth = np.arange(len(least)) - np.repeat(head, runs)
                    many[np.repeat(runs > most, runs)] |= 2
                    keep = nth < most
                    least, seg, low, many = least[keep], seg[keep], low[keep], many[keep]
                yield from _send(block, (mix(least) % U(buckets)).astype(np.int64), least=least, seg=seg, doc=low, many=many)

    return blocks.mapInArrow(run, "bucket long, block long, least binary, seg binary, doc binary, many binary")


def meet(keys: DataFrame, split_over: int) -> DataFrame:
    """What each block is told of its segments: RESOLVED (seg, smallest doc_id), WANTED (seg) or SPLIT (least hash)."""

    def run(t: pa.Table) -> pa.Table:
        gather = lambda c, kind: [np.frombuffer(x, kind) for x in _cells(t, c)]
        least, seg, doc, many = gather("least", U), gather("seg", U), gather("doc", np.int64), gather("many", np.int8)
        block = np.repeat(np.array(_cells(t, "block"), np.int64), [len(x) for x in least])
        least, seg, doc, many = map(np.concatenate, (least, seg, doc, many))
        order, starts = _groups(seg)
        sizes = np.diff(np.append(starts, len(order)))
        doc, many, block = doc[order], many[order], block[order]
        low, marks = np.minimum.reduceat(doc, starts), np.bitwise_or.reduceat(many, starts)
        # how many kinds of segment meet under a least hash
        by, heads = _groups(least[order[starts]])
        span = np.diff(np.append(heads, len(by)))
        kinds, cut = np.empty(len(by), np.int64), np.empty(len(by), bool)
        kinds[by] = np.repeat(span, span)
        cut[by] = np.repeat((np.bitwise_or.reduceat(marks[by], heads) & 2 > 0) | (span > split_over), span)
        least, seg, low, distinct, split = (np.repeat(x, sizes) for x in (least[order[starts]], seg[order[starts]], low, kinds, cut))
        wanted = ~split & (distinct > 1)
        # one kind of segment: blocks with a document after the smallest want to know
        resolved = ~split & (distinct == 1) & ((low < doc) | (many & 1 > 0))
        out = []
        for kind, rows in ((RESOLVED, resolved), (WANTED, wanted), (SPLIT, split)):
            at = np.flatnonzero(rows)
            if not len(at):
                continue
            by = at[np.argsort(block[at], kind="stable")]
            for g in np.split(by, np.flatnonzero(np.diff(block[by])) + 1):
                what = np.unique(least[g]) if kind == SPLIT else seg[g]
                out.append((int(block[g[0]]), kind, _blob(what), b"", _blob(low[g]) if kind == RESOLVED else b""))
        return pa.Table.from_arrays([pa.array([r[i] for r in out], k) for i, k in enumerate((pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.binary()))], ["block", "kind", "segs", "sizes", "docs"])

    return keys.groupBy("bucket").applyInArrow(run, ANSWER)


def _told(answers: pa.Table, kind: int) -> np.ndarray:
    parts = [np.frombuffer(s, U) for s, k in zip(_cells(answers, "segs"), _cells(answers, "kind")) if k == kind]
    return np.unique(np.concatenate(parts)) if parts else np.zeros(0, U)


def _member(x: np.ndarray, of: np.ndarray) -> np.ndarray:
    """Whether each x is in the sorted array ``of``."""
    if not len(of):
        return np.zeros(len(x), bool)
    at = np.minimum(np.searchsorted(of, x), len(of) - 1)
    return of[at] == x


def _split_windows(s: Segments, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(segment, first byte, hash) of the single windows of some segments."""
    of = np.repeat(rows, s.count[rows])
    at = s.first[of] + ramp(s.count[rows])
    h = window_hash(s.w8, at, s.length)
    return of, at, mix(h + mix(h + U(1)))


def wanted_bytes(blocks: DataFrame, answers: DataFrame, length: int, buckets: int) -> DataFrame:
    """(bucket, block, seg, doc, size, bytes): the segments asked for, once a block, with their smallest doc_id there."""

    def run(rows: pa.Table, told: pa.Table) -> pa.Table:
        names = ["bucket", "block", "seg", "doc", "size", "data"]
        out: list[pa.RecordBatch] = []
        want, hot = _told(told, WANTED), _told(told, SPLIT)
        if rows.num_rows and (len(want) or len(hot)):
            block, ids, offs, data = (rows.column(c)[0].as_py() for c in ("block", "ids", "offs", "data"))
            held: list[list[np.ndarray]] = [[], [], [], [], []]
            for d, o, x in _pieces(ids, offs, data):
                s = Segments(x, o, length)
                split = _member(s.least, hot)
                asked = np.flatnonzero(_member(s.hash, want) & ~split)
                of, at, h = _split_windows(s, np.flatnonzero(split))
                seg = np.concatenate((s.hash[asked], h))
                first, size = np.concatenate((s.first[asked], at)), np.concatenate((s.count[asked] + length - 1, np.full(len(at), length)))
                doc = d[np.concatenate((s.owner[asked], s.owner[of]))]
                place = np.concatenate((mix(s.least[asked]), h))
                if not len(seg):
                    continue
                order, starts = _groups(seg)
                keep = order[starts]
                size = size[keep]
                texts = x[np.repeat(first[keep], size) + ramp(size)]
                for list_, v in zip(held, (seg[keep], np.minimum.reduceat(doc[order], starts), size, place[keep], texts)):
                    list_.append(v)
            if held[0]:
                seg, doc, size, place, texts = map(np.concatenate, held)
                order, starts = _groups(seg)
                keep, doc = order[starts], np.minimum.reduceat(doc[order], starts)
                begin = np.cumsum(size) - size
                bucket = (place[keep] % U(buckets)).astype(np.int64)
                by, heads = _groups(bucket)
                for g in np.split(by, heads[1:]):
                    rows_ = keep[g]
                    data_ = texts[np.repeat(begin[rows_], size[rows_]) + ramp(size[rows_])]
                    out.append(pa.RecordBatch.from_arrays([pa.array([int(bucket[g[0]])]), pa.array([block]), *(pa.array([_blob(v)], pa.binary()) for v in (seg[rows_], doc[g], size[rows_], data_))], names))
        schema = pa.schema([("bucket", pa.int64()), ("block", pa.int64()), *((c, pa.binary()) for c in names[2:])])
        return pa.Table.from_batches(out, schema)

    return blocks.groupBy("block").cogroup(answers.where(F.col("kind") != RESOLVED).groupBy("block")).applyInArrow(run, "bucket long, block long, seg binary, doc binary, size binary, data binary")


def expand(wanted: DataFrame, length: int) -> DataFrame:
    """(block, RESOLVED, segments, windows of each, smallest doc_id of each window), for segments of which a window is repeated."""

    def run(t: pa.Table) -> pa.Table:
        seg = [np.frombuffer(x, U) for x in _cells(t, "seg")]
        doc = np.concatenate([np.frombuffer(x, np.int64) for x in _cells(t, "doc")])
        size = np.concatenate([np.frombuffer(x, np.int64) for x in _cells(t, "size")])
        data = np.concatenate([np.frombuffer(x, np.uint8) for x in _cells(t, "data")])
        block = np.repeat(np.array(_cells(t, "block"), np.int64), [len(x) for x in seg])
        seg = np.concatenate(seg)
        begin = np.cumsum(size) - size
        order, starts = _groups(seg)
        heads = order[starts]
        least = smallest_documents(data, begin[heads], size[heads], np.minimum.reduceat(doc[order], starts), length)
        windows = size[heads] - length + 1
        where = np.cumsum(windows) - windows
        which = np.empty(len(seg), np.int64)
        which[order] = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(order))))
        out = []
        by, cuts = _groups(block)
        for g in np.split(by, cuts[1:]):
            n = windows[which[g]]
            out.append((int(block[g[0]]), RESOLVED, _blob(seg[g]), _blob(n), _blob(least[np.repeat(where[which[g]], n) + ramp(n)])))
        return pa.Table.from_arrays([pa.array([r[i] for r in out], k) for i, k in enumerate((pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.binary()))], ["block", "kind", "segs", "sizes", "docs"])

    return wanted.groupBy("bucket").applyInArrow(run, ANSWER)


def removed_windows(d: np.ndarray, s: Segments, told: tuple[np.ndarray, np.ndarray, np.ndarray], hot: np.ndarray) -> np.ndarray:
    """First bytes of the windows that start in a smaller document too.  told: sorted segments, where their windows' documents begin, documents
    (a segment with one document for all windows counts negative)."""
    segs, begins, docs = told
    out = []
    if not len(segs) or not len(s.hash):
        return np.zeros(0, np.int64)

    def look(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.minimum(np.searchsorted(segs, keys), len(segs) - 1)
        hit = segs[at] == keys
        return hit, begins[at]

    split = _member(s.least, hot)
    if split.any():
        of, at, h = _split_windows(s, np.flatnonzero(split))
        hit, begin = look(h)
        own = d[s.owner[of]]
        out.append(at[hit][docs[begin[hit]] < own[hit]])
    hit, begin = look(s.hash)
    rows = np.flatnonzero(hit & ~split)
    of = np.repeat(rows, s.count[rows])
    nth = ramp(s.count[rows])
    where = begin[of]
    low = docs[np.where(where < 0, -where - 1, where + nth)]
    out.append((s.first[of] + nth)[low < d[s.owner[of]]])
    return np.concatenate(out)


def cut(blocks: DataFrame, answers: DataFrame, length: int, texts: bool = False) -> DataFrame:
    """The result's row for each document; with ``texts``, the bytes that are left as well."""

    def run(rows: pa.Table, told: pa.Table) -> pa.Table:
        names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", *["kept"] * texts]
        out: list[tuple] = []
        if rows.num_rows:
            hot = _told(told, SPLIT)
            segs, begins, docs, at = [], [], [], 0
            for kind, s, z, d in zip(_cells(told, "kind"), _cells(told, "segs"), _cells(told, "sizes"), _cells(told, "docs")):
                if kind != RESOLVED:
                    continue
                s, z, d = np.frombuffer(s, U), np.frombuffer(z, np.int64), np.frombuffer(d, np.int64)
                segs.append(s)
                docs.append(d)
                begins.append(at + np.concatenate(([0], np.cumsum(z)[:-1])) if len(z) else -(at + np.arange(len(s))) - 1)
                at += len(d)
            segs, begins, docs = (np.concatenate(x) if x else np.zeros(0, k) for x, k in ((segs, U), (begins, np.int64), (docs, np.int64)))
            order = np.argsort(segs, kind="stable")
            known = segs[order], begins[order].astype(np.int64), docs
            for d, o, x in _pieces(*(rows.column(c)[0].as_py() for c in ("ids", "offs", "data"))):
                at = removed_windows(d, Segments(x, o, length), known, hot)
                depth = np.bincount(at, minlength=len(x) + 1) - np.bincount(at + length, minlength=len(x) + 1)
                gone = np.cumsum(depth[: len(x)]) > 0
                for i, doc in enumerate(d.tolist()):
                    g = gone[o[i] : o[i + 1]]
                    left = x[o[i] : o[i + 1]][~g].tobytes()
                    out.append((doc, len(g), int(g.sum()), int((g & ~np.concatenate(([False], g[:-1]))).sum()), hashlib.sha256(left).hexdigest(), *[left] * texts))
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), *[pa.binary()] * texts)
        return pa.Table.from_arrays([pa.array([r[i] for r in out], k) for i, k in enumerate(kinds)], names)

    return blocks.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(run, RESULT + ", kept binary" * texts)


def remove_repeats(docs: DataFrame, length: int = 50, block_bytes: int = 6 << 20, bucket_bytes: int = 6 << 20, most: int = 256, split_over: int = 20_000, texts: bool = False) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256[, kept]) for every document."""
    if length < 8:
        raise ValueError("length is 8 bytes at least")
    spark = docs.sparkSession
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    wide = int(spark.conf.get("spark.sql.shuffle.partitions"))
    blocks = blocks_of(docs, block_bytes, max(wide, math.ceil(total / block_bytes)))
    buckets = max(wide, math.ceil(total / bucket_bytes))
    answers = materialize(meet(segment_keys(blocks, length, buckets, most), split_over), "substrings-a")
    more = materialize(expand(wanted_bytes(blocks, answers, length, buckets), length), "substrings-b")
    return cut(blocks, answers.where(F.col("kind") != WANTED).unionByName(more), length, texts)
