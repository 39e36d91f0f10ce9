"""Whitening of embeddings by merged partial covariances.

1.  Every entry c becomes the long x = floor(256 * c).  Each distinct x vector stands in the fit list once (a grouped aggregate with map-side
    combining, so that a vector which a third of all rows hold is one row of each task).
2.  Each partition of the fit list computes its count, exact sums, local mean and centred scatter, batch by batch; two such states merge
    by the pairwise formula of Chan, Golub and LeVeque: scatter = A + B + (mean_b - mean_a)(mean_b - mean_a)' * n_a * n_b / n.  Partitions
    merge in a treeReduce, so that the driver meets a few states of d * d numbers, however many partitions there are.
3.  The covariance is decomposed on the driver (``eigh``; d * d numbers).
4.  A second pass projects the fit list and merges the covariance of the whitened values in the same way; its largest difference from the
    identity is the proof that every row of the result carries.

Memory: d * d doubles a task and on the driver, whatever the number of rows.

Defined cases: vectors that are null, empty or hold null or non-finite entries take no part; if lengths differ, vectors of the commonest length
(of two equally common ones, the longer) take part and no others; 256 * c beyond a long saturates, as Spark's floor does; rows with a null or
repeated vec_id are rows like any other; other columns are ignored, whatever their names; no rows give no rows.  A component without variance
(eigenvalue of at most 1e-12 of the largest) has whitened and explained 0 and takes no part in identity_error.  A deviation beyond a
long is null; it is exact otherwise.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize



def exact_sums(x: np.ndarray) -> list[int]:
    """Sums of the columns of a matrix of longs, exact beyond 64 bits."""
    top = max(abs(int(x.max())), abs(int(x.min()))) if x.size else 0
    if top * len(x) < 1 << 62:
        return [int(v) for v in x.sum(0, dtype=np.int64)]
    return [int(v) for v in x.astype(object).sum(0)]


State = tuple[int, list, np.ndarray, np.ndarray]


def state_of(x: np.ndarray) -> State:
    """(count, exact sums of longs or [], mean, centred scatter) of the rows of a matrix."""
    sums = exact_sums(x) if x.dtype == np.int64 else []
    mean = np.array([s / len(x) for s in sums]) if sums else x.mean(0)
    centred = x - mean
    return len(x), sums, mean, centred.T @ centred


def merge(a: State | None, b: State) -> State:
    """Chan's pairwise formula."""
    if a is None:
        return b
    n = a[0] + b[0]
    delta = b[2] - a[2]
    scatter = a[3] + b[3] + np.outer(delta, delta) * (a[0] * b[0] / n)
    return n, [p + q for p, q in zip(a[1], b[1])], a[2] + delta * (b[0] / n), scatter


def matrix(batch: pa.RecordBatch, column: str, d: int) -> np.ndarray:
    """The lists of a column, all of length d, as rows."""
    return batch.column(batch.schema.get_field_index(column)).flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, d)


def merged(fit: DataFrame, d: int, weights: np.ndarray | None = None, centre: np.ndarray | None = None) -> State:
    """The state of the fit list (not empty), or of its projection on ``weights``; each partition sends one state."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = None
        for batch in batches:
            if batch.num_rows:
                x = matrix(batch, "x", d)
                state = merge(state, state_of(x if weights is None else (x - centre) @ weights))
        if state is not None:
            n, sums, mean, scatter = state
            yield pa.RecordBatch.from_pydict({"n": pa.array([n], pa.int64()), "sums": pa.array([[str(s) for s in sums]], pa.list_(pa.string())), "mean": [mean.tobytes()], "scatter": [scatter.tobytes()]})

    def read(row) -> State:
        mean = np.frombuffer(row["mean"])
        return row["n"], [int(s) for s in row["sums"]], mean, np.frombuffer(row["scatter"]).reshape(len(mean), -1)

    states = fit.select("x").mapInArrow(run, "n long, sums array<string>, mean binary, scatter binary").rdd.map(read)
    return states.treeReduce(merge)


def components(state: State, count: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(weights d x k, explained, whether a component has variance) of the first k components: a weight is an eigenvector over the root of its eigenvalue."""
    values, vectors = np.linalg.eigh(state[3] / state[0])
    values, vectors = values[::-1][:count], vectors[:, ::-1][:, :count]
    trace = float(np.trace(state[3])) / state[0]
    alive = values > 1e-12 * max(values[0], 0.0)
    scale = np.where(alive, 1 / np.sqrt(np.where(alive, values, 1.0)), 0.0)
    return vectors * scale, np.where(alive, values, 0.0) / (trace or 1.0), alive


def deviations(x: np.ndarray, n: int, sums: list[int]) -> pa.Array:
    """Exact sums over the dimensions of (n * x - S) ** 2; null where one doesn't fit a long."""
    top = n * max(abs(int(x.max())), abs(int(x.min()))) + max(map(abs, sums))
    if top * top * len(sums) < 1 << 63:
        off = n * x - np.array(sums, np.int64)
        return pa.array((off * off).sum(1))
    off = n * x.astype(object) - np.array(sums, object)
    return pa.array([int(v) if v < 1 << 63 else None for v in (off * off).sum(1)], pa.int64())


def whiten(rows: DataFrame, count: int = 4, vector_col: str = "embedding", id_col: str = "vec_id") -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error) for each row that takes part and each of the first ``count`` components."""
    spark = rows.sparkSession
    schema = f"{id_col} long, component int, n long, deviation long, whitened double, explained double, identity_error double"
    vector = F.col(vector_col)
    usable = rows.select(F.col(id_col).cast("long").alias(id_col), vector.alias("v")).where("size(v) > 0 and forall(v, c -> c is not null and not isnan(c) and abs(cast(c as double)) < double('infinity'))")
    usable = usable.select(id_col, F.expr("transform(v, c -> floor(256D * cast(c as double)))").alias("x"))
    lengths = usable.groupBy(F.size("x").alias("d")).agg(F.count(F.lit(1)).alias("c")).orderBy(F.desc("c"), F.desc("d")).first()
    if lengths is None:
        return spark.createDataFrame([], schema)
    d = lengths["d"]
    usable = usable.where(F.size("x") == d)
    fit = materialize(usable.select("x").distinct(), "whitening-fit")
    state = merged(fit, d)
    n, sums = state[0], state[1]
    centre = np.array([s / n for s in sums])
    weights, explained, alive = components(state, count)
    error = 0.0
    if alive.any():
        proof = merged(fit, d, weights[:, alive], centre)
        error = float(np.abs(proof[3] / n - np.eye(int(alive.sum()))).max())
    k = weights.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x = matrix(batch, "x", d)
            m = len(x)
            each = np.repeat(np.arange(m), k)
            yield pa.RecordBatch.from_pydict(
                {
                    id_col: batch.column(0).take(pa.array(each)),
                    "component": pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)),
                    "n": pa.array(np.full(m * k, n, np.int64)),
                    "deviation": deviations(x, n, sums).take(pa.array(each)),
                    "whitened": pa.array(((x - centre) @ weights).ravel()),
                    "explained": pa.array(np.tile(explained, m)),
                    "identity_error": pa.array(np.full(m * k, error)),
                }
            )

    return usable.mapInArrow(run, schema)
