"""Helpers shared by the corpus operators: scratch tables, Arrow text chunks, connected components."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder of spark.checkpoint.dir; a temporary one only on a local master where that is unset."""
    sc = spark.sparkContext
    path = sc.getConf().get("spark.checkpoint.dir", "")
    if path:
        return path.rstrip("/")
    held = sc._jsc.sc().getCheckpointDir()
    if held.isDefined():
        return held.get().rstrip("/")
    if not re.fullmatch(r"local(\[.*\])?", sc.master):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    path = "file://" + tempfile.mkdtemp(prefix="pennybrook-scratch-")
    sc.setCheckpointDir(path)
    return path


def materialize(df: DataFrame, label: str, dictionary: bool = True) -> DataFrame:
    """Cut lineage: write ``df`` as Parquet in the shared scratch folder and read it again.

    The table outlives any executor, so a lost executor costs a retry of single tasks only.  Columns of hashes are written faster without a dictionary.
    """
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/pennybrook/{label}-{uuid.uuid4().hex}"
    df.write.mode("error").option("compression", "zstd").option("parquet.enable.dictionary", str(dictionary).lower()).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._scratch_path = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete scratch tables that no later plan reads."""
    for df in tables:
        path = getattr(df, "_scratch_path", None)
        if path:
            spark = df.sparkSession
            jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
            jpath.getFileSystem(spark._jsc.hadoopConfiguration()).delete(jpath, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_parts(batch: pa.RecordBatch, column: str, max_bytes: int = 1 << 22) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Split a batch into runs of rows of about ``max_bytes`` bytes of text (one longer row stays whole).

    Yields (first row, end row, bytes as uint8, offsets as int64 relative to these bytes); null text is empty.
    """
    arr = batch.column(batch.schema.get_field_index(column))
    if arr.null_count:
        arr = arr.fill_null("" if pa.types.is_string(arr.type) or pa.types.is_large_string(arr.type) else b"")
    n = len(arr)
    if not n:
        return
    kind = np.int64 if pa.types.is_large_string(arr.type) or pa.types.is_large_binary(arr.type) else np.int32
    _, off_buf, data_buf = arr.buffers()
    offs = np.frombuffer(off_buf, dtype=kind)[arr.offset : arr.offset + n + 1].astype(np.int64)
    data = np.frombuffer(data_buf, dtype=np.uint8) if data_buf is not None and data_buf.size else np.zeros(0, np.uint8)
    first = 0
    while first < n:
        end = max(first + 1, int(np.searchsorted(offs, offs[first] + max_bytes, side="right")) - 1)
        end = min(end, n)
        yield first, end, data[offs[first] : offs[end]], offs[first : end + 1] - offs[first]
        first = end


def ascii_lower(data: np.ndarray) -> np.ndarray:
    """Lower-case the bytes A-Z and no others."""
    return data + ((data >= 65) & (data <= 90)).astype(np.uint8) * np.uint8(32)


def connected_components(edges: DataFrame, label: str = "cc", max_rounds: int = 60) -> DataFrame:
    """(node, component) for every node of ``edges`` (columns a, b of one orderable type); component = least node reachable.

    Alternating large-star and small-star rounds.  Minima come from a grouped aggregate with map-side
    combining, are written to the scratch folder and joined back as a plain sort-merge join, so that AQE
    can split the rows of a hub node over many tasks.  Nothing is collected but two numbers a round.
    """

    def measure(df: DataFrame) -> tuple:
        # unlike a sum of 64-bit hashes, a sum of 32-bit ones can't overflow
        return tuple(df.agg(F.count(F.lit(1)), F.sum(F.hash("a", "b").cast("decimal(38,0)"))).first())

    edges = materialize(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), f"{label}-e")
    seen = measure(edges)
    for _ in range(max_rounds):
        if not seen[0]:
            break
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = materialize(both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m")), f"{label}-m")
        large = both.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        large = materialize(large, f"{label}-l")
        low2 = materialize(large.groupBy("a").agg(F.min("b").alias("m")), f"{label}-n")
        small = large.join(low2, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").unionByName(low2.withColumnRenamed("m", "b")).distinct()
        new = materialize(small, f"{label}-e")
        now = measure(new)
        for x in (edges, low, large, low2):
            discard(x)
        edges = new
        if now == seen:
            break
        seen = now
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    # stars now: (leaf, centre); centres are their own component
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
