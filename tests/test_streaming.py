"""Statements as a stream: micro-batches upserted into a store, and counts by bucket with late rows."""

from pyspark.sql import functions as F

from pennybrook.schema import DRAFT
from pennybrook.sources.store import LedgerStore
from pennybrook.streaming import ingest


def write(spark, path, rows, first=0):
    df = spark.createDataFrame([(first + i, *r) for i, r in enumerate(rows)], "row int, order_id string, amount_minor long, at string").withColumn("occurred_at", F.to_timestamp("at"))
    made = {"seq": F.struct(F.lit(0).alias("file"), "row", F.lit(0).alias("part")), "source": F.lit("s"), "account_id": F.lit("a"), "direction": F.lit("out"), "currency": F.lit("CNY"), "description": F.lit("午餐"), "excluded_from_cashflow": F.lit(False)}
    df.select(*[made.get(f.name, F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in DRAFT.fields]).coalesce(1).write.mode("append").parquet(path)


def test_micro_batches_are_upserts(spark, tmp_path):
    source, store = f"file://{tmp_path}/in", LedgerStore(spark, f"file://{tmp_path}/ledger")

    def step(rows, first):
        write(spark, source, rows, first)
        drafts = spark.readStream.schema(DRAFT).parquet(source)
        query = drafts.writeStream.foreachBatch(ingest.upsert_batch(store)).option("checkpointLocation", f"file://{tmp_path}/state").trigger(availableNow=True).start()
        query.awaitTermination(120)
        assert query.exception() is None
        return sorted((r["source_order_id"], r["amount_minor"], r["month"]) for r in store.transactions().collect())

    one = step([("a1", 100, "2026-01-02"), ("a2", 200, "2026-02-02")], 0)
    assert one == [("a1", 100, "2026-01"), ("a2", 200, "2026-02")]
    two = step([("a2", 200, "2026-02-02"), ("a3", 300, "2026-02-03")], 10)  # one is known
    assert two == [*one, ("a3", 300, "2026-02")]
    three = step([("a1", 100, "2026-01-05")], 20)  # the same fingerprint at another time: a correction
    assert three == two and store.transactions().where("source_order_id = 'a1'").first()["occurred_at"].day == 5
    counts = {r["id"]: (r["inserted"], r["updated"], r["duplicates"]) for r in store.batches().collect()}
    assert counts == {"stream-0": (2, 0, 0), "stream-1": (1, 0, 1), "stream-2": (0, 1, 0)}
    again = spark.read.schema(DRAFT).parquet(source).where("seq.row >= 20")
    before = store.versions()
    ingest.upsert_batch(store)(again, 2)  # played again
    assert store.versions() == before


def test_bucketed_counts(spark, tmp_path):
    source = f"file://{tmp_path}/in"
    write(spark, source, [("a", 5, "2026-01-10 00:00:30"), ("b", 6, "2026-01-10 00:01:59"), ("c", 7, "2026-01-10 00:02:00")])
    counts = ingest.bucketed_counts(spark.readStream.schema(DRAFT).parquet(source))
    query = counts.writeStream.format("memory").queryName("buckets").outputMode("complete").option("checkpointLocation", f"file://{tmp_path}/state").trigger(availableNow=True).start()
    query.awaitTermination(120)
    assert sorted((r["window"]["start"].minute, r["n"], r["amount_minor"]) for r in spark.table("buckets").collect()) == [(0, 2, 11), (2, 1, 7)]
