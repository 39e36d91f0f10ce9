"""A session with the settings the ledger relies on."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Needed for right results: instants in UTC, later duplicates of a header name win, statement files in GBK.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.mapKeyDedupPolicy": "LAST_WIN",
    "spark.sql.legacy.javaCharsets": "true",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
}


def builder(app: str = "pennybrook") -> SparkSession.Builder:
    b = SparkSession.builder.appName(app)
    for k, v in SETTINGS.items():
        b = b.config(k, v)
    return b


def prepare(spark: SparkSession) -> SparkSession:
    """Put the settings on a session that someone else made."""
    for k, v in SETTINGS.items():
        spark.conf.set(k, v)
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; a temporary one only on a local master where that is unset."""
    sc = spark.sparkContext
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        shared = sc.getConf().get("spark.checkpoint.dir", "")
        if not shared and not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(shared or "file://" + tempfile.mkdtemp(prefix="pennybrook-"))
    return sc._jsc.sc().getCheckpointDir().get()


#: Bytes of Parquet behind one task of a shuffle, at most, where ``cut`` is told what it reads.
SHARE = 8 << 20


def shuffle_tasks(df: DataFrame) -> int:
    """Partitions that a shuffle over the files behind ``df`` needs so that a task's share doesn't grow with them: what the session says, or more."""
    spark = df.sparkSession
    path, conf = spark._jvm.org.apache.hadoop.fs.Path, spark._jsc.hadoopConfiguration()
    size = sum(x.getFileSystem(conf).getFileStatus(x).getLen() for x in map(path, df.inputFiles()))
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // SHARE))


def cut(df: DataFrame, over: DataFrame | None = None) -> DataFrame:
    """The rows written as Parquet in the shared folder and read again.

    Tables that several later steps read are cut, not persisted: nested caches repeat each other's plans, whose text alone can fill the
    driver's memory, and a written table survives the loss of executors.  Parquet is smaller than the rows of a checkpoint, later steps read only the columns that they
    use, and joins know its size.  The order of rows and partitions isn't kept.  ``over`` is the table that the work goes over: its shuffles then have partitions in
    proportion to that table's files, and small ones aren't joined to large ones, so that a task's memory doesn't grow with them.
    """
    spark = df.sparkSession
    where, names = f"{shared_folder(spark)}/cut-{uuid.uuid4().hex}", ("spark.sql.shuffle.partitions", "spark.sql.adaptive.advisoryPartitionSizeInBytes")
    held = {k: spark.conf.get(k) for k in names}
    try:
        if over is not None:
            for k, v in zip(names, (shuffle_tasks(over), 2 * SHARE)):
                spark.conf.set(k, str(v))
        df.write.parquet(where)
    finally:
        for k, v in held.items():
            spark.conf.set(k, v)
    return spark.read.schema(df.schema).parquet(where)


def cut_in_order(df: DataFrame) -> DataFrame:
    """A reliable checkpoint in the shared folder, which keeps partitions and the order of rows within them."""
    shared_folder(df.sparkSession)
    return df.checkpoint()
