"""Exact top-k inner products by columnar branch and bound.

Vectors become integers, floor(scale * x).  Queries and candidates are dealt by hash into blocks of bounded size,
stored dimension by dimension.  Each candidate block meets every query block (a stated query set against
all rows, in blocks): for each query, products are added up a group of dimensions at a time, and after each group
the candidates are compacted to those that can still be among the k best.  What dimensions remain can change a score by at
most the product of the remaining masses (Cauchy-Schwarz), so a candidate goes when its sum plus that bound is below the k-th
largest sum minus bound, or below the k-th score that this query has in earlier blocks of the same task.  Groups
are taken in the order of the queries' mass.  k rows a query leave each block, and the k best of these are the result.

Ties go to the smaller id: a candidate that can still *equal* the k-th score stays.

Defined cases: a vector that is null or holds null, NaN or infinity takes no part; rows repeated with the same id and vector count
once; a row is never a candidate for a query of its own id; vectors of different length are not compared; a query
without candidates has no rows; other columns are ignored.  Scores are exact while they fit 53 bits, and by 64-bit arithmetic
beyond that (as far as a long holds them).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize

EXACT = 2.0**53


def pack_blocks(rows: DataFrame, blocks: int, salt: int) -> DataFrame:
    """(dim, block, ids, values): ids and the integer components, dimension by dimension, of each block."""

    def run(t: pa.Table) -> pa.Table:
        ids = t.column("id").to_numpy()
        values = t.column("v").combine_chunks()
        dim = t.column("dim")[0].as_py()
        flat = values.flatten().to_numpy(zero_copy_only=False).reshape(len(ids), dim)
        order = np.argsort(ids, kind="stable")
        return pa.table({"dim": pa.array([dim], pa.int32()), "block": pa.array([t.column("block")[0].as_py()], pa.int32()), "ids": pa.array([ids[order].astype("<i8").tobytes()], pa.binary()), "columns": pa.array([np.ascontiguousarray(flat[order].T).astype("<i8").tobytes()], pa.binary())})

    dealt = rows.withColumn("block", F.pmod(F.xxhash64("id", F.lit(salt)), F.lit(blocks)).cast("int"))
    return dealt.groupBy("dim", "block").applyInArrow(run, "dim int, block int, ids binary, columns binary")


def best_of_block(q_ids: np.ndarray, q: np.ndarray, c_ids: np.ndarray, c: np.ndarray, k: int, group: int = 16, floors: dict[int, float] | None = None) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(query id, ids, scores) of the k best candidates for each column of ``q``; q and c are dims x vectors."""
    dims = len(q)
    if not q.size or not c.size:
        top = c_ids if dims == 0 else c_ids[:0]
        for i in q_ids.tolist():
            ids = np.sort(top[top != i])[:k]
            yield i, ids, np.zeros(len(ids), np.int64)
        return
    peak = float(np.abs(q).max(initial=0)) * float(np.abs(c).max(initial=0)) * dims
    kind = np.float64 if peak < EXACT else np.int64
    order = np.argsort(-(q.astype(np.float64) ** 2).sum(1), kind="stable")
    q, c = q[order].astype(kind), np.ascontiguousarray(c[order].astype(kind))
    starts = list(range(0, dims, group))

    def masses(x: np.ndarray) -> np.ndarray:
        """By group: the norm of the dimensions from it on."""
        squares = np.add.reduceat(x.astype(np.float64) ** 2, starts, axis=0)
        return np.sqrt(np.cumsum(squares[::-1], axis=0)[::-1])

    q_mass, c_mass = masses(q), masses(c)
    for col, qid in enumerate(q_ids.tolist()):
        alive = np.flatnonzero(c_ids != qid)
        floor = (floors or {}).get(qid, -np.inf)
        sums, values = np.zeros(len(alive), kind), None
        for g, a in enumerate(starts):
            part = q[a : a + group, col]
            # as long as nearly all are alive the columns are read where they lie
            values = part @ c[a : a + group] if len(alive) > 0.7 * c.shape[1] else part @ c[a : a + group, alive]
            sums = sums + (values[alive] if len(values) != len(alive) else values)
            if g + 1 == len(starts) or len(alive) <= k:
                continue
            if kind is np.float64 and len(alive) > 4 * k:
                rest = q_mass[g + 1, col] * c_mass[g + 1][alive]
                rest = rest * (1 + 1e-9) + 1e-6
                least = max(floor, float(np.partition(sums - rest, len(sums) - k)[len(sums) - k]))
                stay = sums + rest >= least
                if not stay.all():
                    alive, sums = alive[stay], sums[stay]
        scores, ids = sums.astype(np.int64), c_ids[alive]
        if len(scores) > 4 * k:
            some = scores >= np.partition(scores, len(scores) - k)[len(scores) - k]
            scores, ids = scores[some], ids[some]
        top = np.lexsort((ids, -scores))[:k]
        if floors is not None and len(top) == k:
            floors[qid] = max(floor, float(scores[top[-1]]))
        yield qid, ids[top], scores[top]


def top_k(vectors: DataFrame, is_query, k: int = 5, scale: float = 256.0, id_col: str = "vec_id", vector_col: str = "embedding", query_block: int = 1024, block_values: int = 1 << 21) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row for which the column ``is_query`` holds, the k largest scores over all other rows."""
    x = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("e"), is_query.alias("is_query")).where("id is not null and e is not null")
    x = x.where(F.expr("forall(e, x -> x is not null and not isnan(cast(x as double)) and abs(cast(x as double)) < double('infinity'))"))
    x = x.select("id", "is_query", F.size("e").alias("dim"), F.expr(f"transform(e, x -> floor({float(scale)}D * cast(x as double)))").alias("v")).distinct()
    x = materialize(x, "topk")
    n, nq, values = x.agg(F.count(F.lit(1)), F.count_if("is_query"), F.sum("dim")).first()
    cores = x.sparkSession.sparkContext.defaultParallelism
    blocks = max(1, min(-(-n // 256), 4 * cores), -(-int(values or 0) // block_values))
    queries = pack_blocks(x.where("is_query"), max(1, -(-nq // query_block)), 1).select("dim", F.col("block").alias("q_block"), F.col("ids").alias("q_ids"), F.col("columns").alias("q_columns"))
    candidates = pack_blocks(x, blocks, 2)
    # every query block goes to every candidate block
    pairs = candidates.join(queries.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))), ["dim", "block"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        floors: dict[int, float] = {}
        for batch in batches:
            for r in range(batch.num_rows):
                dim, c_ids, c, q_ids, q = (batch.column(i)[r].as_py() for i in range(5))
                c_ids, q_ids = np.frombuffer(c_ids, "<i8"), np.frombuffer(q_ids, "<i8")
                out = list(best_of_block(q_ids, np.frombuffer(q, "<i8").reshape(dim, len(q_ids)), c_ids, np.frombuffer(c, "<i8").reshape(dim, len(c_ids)), k, floors=floors))
                if len(floors) > 1 << 20:
                    floors.clear()
                sizes = [len(i) for _, i, _ in out]
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(np.array([i for i, _, _ in out], np.int64), sizes)), pa.array(np.concatenate([i for _, i, _ in out])), pa.array(np.concatenate([s for _, _, s in out]))], ["query_id", "vec_id", "score"])

    found = pairs.select("dim", "ids", "columns", "q_ids", "q_columns").mapInArrow(run, "query_id long, vec_id long, score long")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
