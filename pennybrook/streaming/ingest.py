"""Optional: statements as a stream.  Re-imports are idempotent by fingerprint, so each micro-batch is an upsert."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.reconcile import Overlap
from ..plans.build import build_transactions, saved_rows
from ..session import cut
from ..sources.store import LedgerStore


def upsert_batch(store: LedgerStore, rules=None, scope: Sequence[str] = ()) -> Callable[[DataFrame, int], None]:
    """For ``writeStream.foreachBatch``: drafts of a micro-batch become an import that corrects what is stored; the store's key index tells which months it meets.

    A micro-batch that is played again after a failure finds its rows stored and changes none of them.
    """

    def run(drafts: DataFrame, epoch: int) -> None:
        batch_id = f"stream-{epoch}"
        out = build_transactions(cut(drafts), batch_id, rules, existing_records=store.records, scope=scope)
        saved = cut(saved_rows(Overlap(out.transactions, out.duplicates, out.updated), batch_id))
        if saved.isEmpty():
            return
        n = {"inserted": out.transactions.count(), "updated": out.updated.count(), "duplicates": out.duplicates.count(), "dropped": out.dropped.count()}
        batch = drafts.sparkSession.range(1).select(F.lit(batch_id).alias("id"), F.lit("stream").alias("file_name"), F.lit("stream").alias("source_label"), F.current_timestamp().alias("imported_at"), *[F.lit(v).cast("long").alias(k) for k, v in n.items()], F.array().cast("array<string>").alias("notes"))
        store.save_import(batch, saved)

    return run


def bucketed_counts(drafts: DataFrame, late: str = "3 days", size: str = "2 minutes") -> DataFrame:
    """Rows and money by tumbling bucket, with a watermark as wide as the pairing window."""
    return drafts.withWatermark("occurred_at", late).groupBy(F.window("occurred_at", size), "direction").agg(F.count(F.lit(1)).alias("n"), F.sum("amount_minor").alias("amount_minor"))
