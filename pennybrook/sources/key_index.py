"""A key-only index of a ledger: where the record of a fingerprint, or of an id, lies.

The index is a list of folders: a base, and a delta for each commit since.  Each is bucketed by key, so a join with a table of wanted keys shuffles the
wanted keys alone.  A few wanted keys are looked up as literals instead: Spark reads only their buckets, and Parquet's Bloom filters skip the files
that don't hold them.  A key's newest entry counts; an entry that isn't alive says that the record is gone.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ENTRY = "key string, id string, fingerprint string, month string, alive boolean, version long"
#: Up to so many wanted keys are looked up as literals.
FEW = 200


def fingerprint_key(c: str = "fingerprint"):
    return F.concat(F.lit("f:"), F.col(c))


def id_key(c: str = "id"):
    return F.concat(F.lit("i:"), F.col(c))


def entries(rows: DataFrame, alive: bool, version: int) -> DataFrame:
    """Two entries for each row (id, fingerprint, month): one by fingerprint, one by id."""
    keys = F.explode(F.array_compact(F.array(fingerprint_key(), id_key())))
    return rows.select(keys.alias("key"), "id", "fingerprint", "month", F.lit(alive).alias("alive"), F.lit(version).cast("long").alias("version"))


def newest(found: DataFrame) -> DataFrame:
    """The newest entry of each key; within a version, one that is alive outranks one that isn't."""
    last = F.max(F.struct("version", "alive", "id", "fingerprint", "month"))
    return found.groupBy("key").agg(last.alias("e")).select("key", "e.id", "e.fingerprint", "e.month", "e.alive", "e.version")


def write(rows: DataFrame, where: str, buckets: int) -> None:
    """Entries as one file a bucket, sorted by key, with Bloom filters."""
    spark, name = rows.sparkSession, f"keys_{uuid.uuid4().hex}"
    out = rows.repartition(buckets, "key").write.format("parquet").option("path", where).option("parquet.bloom.filter.enabled#key", "true")
    out.bucketBy(buckets, "key").sortBy("key").saveAsTable(name)
    spark.sql(f"DROP TABLE {name}")  # the catalog forgets it; its files stay, as the table is external


def read(spark: SparkSession, where: str, buckets: int) -> DataFrame:
    name = f"keys_{uuid.uuid4().hex}"
    spark.sql(f"CREATE TABLE {name} ({ENTRY}) USING parquet CLUSTERED BY (key) INTO {int(buckets)} BUCKETS LOCATION '{where}'")
    out = spark.table(name)
    spark.sql(f"DROP TABLE {name}")
    return out


def folded(spark: SparkSession, folders: list[str], where: str, buckets: int) -> None:
    """Write a new base: the entries of all folders that are alive."""
    write(newest(spark.read.schema(ENTRY).parquet(*folders)).where("alive"), where, buckets)


def lookup(wanted: DataFrame, folders: list[str], buckets: int) -> DataFrame:
    """The entries that are alive of the wanted keys (key)."""
    spark = wanted.sparkSession
    wanted = wanted.where("key is not null").select("key").distinct()
    some = [r["key"] for r in wanted.limit(FEW + 1).collect()]
    if len(some) <= FEW:
        parts = [read(spark, where, buckets).where(F.col("key").isin(some)) for where in folders] if some else []
    else:
        dealt = wanted.repartition(buckets, "key")
        parts = [dealt.hint("merge").join(read(spark, where, buckets), "key") for where in folders]
    found = spark.createDataFrame([], ENTRY)
    for part in parts:
        found = found.unionByName(part)
    # dealt anew (a few rows): a union of bucketed scans may claim a partitioning that it no longer has once Spark drops bucketing from a scan
    return newest(found.repartition("key")).where("alive")
