"""The import pipeline: drafts to transactions, in six stages of fixed order.

Refunds come before hashing, pairing before categories, deduplication last (duplicates do take part in pairing).  Shared tables
are checkpointed once, so preview and commit see the same rows.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.fingerprints import VERSION, fnv1a64, preimage
from ..functions.text import blank_to_null, nfkc, text
from ..operators import categories, refunds, transfers
from ..operators.classify import is_closed, is_refund, kind
from ..operators.reconcile import Known, Overlap, reconcile
from ..schema import TRANSACTION
from ..session import cut


@dataclass
class Outcome:
    transactions: DataFrame
    duplicates: DataFrame
    updated: DataFrame
    dropped: DataFrame  # scope, seq, reason
    pairs: DataFrame
    warnings: DataFrame  # scope, seq, code


def meta_of(columns: dict[str, Column]) -> Column:
    """A map of the values that aren't blank."""
    whole = F.create_map(*[x for k, v in columns.items() for x in (F.lit(k), v)])
    return F.map_filter(whole, lambda _, v: v.isNotNull() & (v != ""))


def to_transactions(drafts: DataFrame, batch_id: Column, strict_netting: bool = False, fold=nfkc, extra: Sequence[str] = ()) -> DataFrame:
    """Drafts as transactions.  The fingerprint is of the stated amount, before refunds were netted.

    Whether a row is a refund is decided on the stated amount as well; ``strict_netting`` decides it on the netted one, which turns a
    purchase that discloses a refund of half its price or more into a refund.
    """
    netted = F.coalesce("refund_netted_minor", F.lit(0).cast("long"))
    d = drafts.withColumn("_stated", F.col("amount_minor") + netted)
    d = d.withColumn("_pre", preimage(F.col("occurred_at"), F.col("_stated"), F.col("direction"), F.col("counterparty"), F.col("balance_after_minor"), F.col("order_id"), F.col("description"), fold))
    d = d.withColumn("fingerprint", fnv1a64(F.col("_pre")))
    refund = is_refund(F.col("amount_minor") if strict_netting else F.col("_stated"))
    meta = meta_of(
        {
            "txType": F.col("tx_type"),
            "method": F.col("method"),
            "status": F.col("status"),
            "orderId": F.col("order_id"),
            "merchantOrderId": F.col("merchant_order_id"),
            "refundNettedMinor": F.when(netted > 0, netted.cast("string")),
            "statedAmountMinor": F.when(netted > 0, F.col("_stated").cast("string")),
            "preimage": F.col("_pre"),
        }
    )
    made = {
        "id": F.concat(F.lit("tx_"), F.col("fingerprint")),
        "fingerprint_version": F.lit(VERSION),
        "raw_description": F.col("description"),
        "category": F.lit(None).cast("string"),
        "category_source": F.lit("none"),
        "kind": F.when(refund, "refund").otherwise(kind()),
        "imported_batch_id": batch_id,
        "source_order_id": blank_to_null(text("order_id")),
        "meta": meta,
    }
    return d.select(*extra, *[made[n].alias(n) if n in made else F.col(n) for n in TRANSACTION.fieldNames()])


def build_transactions(drafts: DataFrame, batch_id: str, rules: Iterable[categories.Rule] | None = None, window_days: int = transfers.WINDOW_DAYS, max_group: int = transfers.MAX_GROUP, existing_fingerprints: Known = None, existing_records: Known = None, strict_netting: bool = False, scope: Sequence[str] = (), fold=nfkc) -> Outcome:
    """All six outputs of one import, or of many at once: ``scope`` names the columns of a transaction (``account_id``, ``source``) within which rows may meet, so that
    refunds, transfers and repeated fingerprints are found within each scope alone.  Tables that several outputs read are checkpointed, so all outputs see one
    evaluation.  Stored records are met by fingerprint, whatever the scope."""
    drafts = cut(drafts)
    closed = drafts.where(is_closed())
    live = cut(drafts.where(~is_closed()))
    closed_ids = closed.where(text("order_id") != "").select(*scope, "order_id").distinct()
    paired = refunds.pair_refunds(live, closed_ids, scope)
    txs = cut(to_transactions(paired.kept, F.lit(batch_id), strict_netting, fold))
    pairs = cut(transfers.pair_transfers(txs, window_days, max_group, scope))
    txs = cut(categories.categorised(transfers.apply_pairs(txs, pairs, scope), rules))
    overlap = reconcile(txs, existing_records, existing_fingerprints, scope)
    dropped = closed.select(*scope, "seq", F.lit("closed-or-failed").alias("reason")).unionByName(paired.dropped).unionByName(overlap.duplicates.select(*scope, "seq", F.lit("duplicate").alias("reason")))
    return Outcome(overlap.fresh, overlap.duplicates, overlap.updated, dropped, pairs, paired.warnings)


def saved_rows(overlap: Overlap, batch_id: str) -> DataFrame:
    """What an import saves: fresh rows, and corrected ones under the ids that they had, all stamped with its batch."""
    return overlap.fresh.unionByName(overlap.updated.select("after.*")).withColumn("imported_batch_id", F.lit(batch_id))
