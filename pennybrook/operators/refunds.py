"""Refund pairing: a greedy prefix join in input order, cut into exact independent parts.

The purchases that a refund can meet have order ids that are prefixes of its own, so they form a chain, and the shortest of them, the
root, is the same for all refunds and purchases that compete.  Prefixes are found on the sorted ids: an id covers the interval of ids that it begins, such
intervals are nested or disjoint, and a stack carried along the sorted ids holds those that are open.
A root with one purchase is decided by a running sum; only roots with several purchases run a kernel in ``seq`` order.
``scope`` names the columns within which rows may meet (an import), so that a ledger of many imports spreads over them.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import reduce

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StringType, StructField, StructType

from ..functions.text import blank_to_null, text
from ..session import cut, cut_in_order
from .classify import disclosed_refund, is_refund

DECISION = "seq struct<file:int,row:int,part:int>, what string, minor long, other struct<file:int,row:int,part:int>"


@dataclass
class Refunds:
    kept: DataFrame  # drafts with amounts netted
    dropped: DataFrame  # seq, reason
    warnings: DataFrame  # seq, code


def nested_prefixes(longer: DataFrame, shorter: DataFrame, scope: Sequence[str] = ()) -> DataFrame:
    """(scope, order_id, prefix): for each different order id of ``longer`` those of ``shorter`` that it begins with, itself included.

    The different ids of both are range-partitioned and sorted, a row each; a stack of the open ids of ``shorter`` runs along each partition.  A partition
    starts with the ids that are open at its first row: the prefixes of that one id, looked up by a join, so that no partition waits for another.
    """
    keys = list(scope)
    some = F.col("order_id").isNotNull() & (F.col("order_id") != "")
    whole = longer.where(some).select(*keys, "order_id", F.lit(1).alias("sought"), F.lit(0).alias("opens")).unionByName(shorter.where(some).select(*keys, "order_id", F.lit(0).alias("sought"), F.lit(1).alias("opens")))
    ids = whole.groupBy(*keys, "order_id").agg(F.max("sought").alias("sought"), F.max("opens").alias("opens"))
    order = [*keys, "order_id"]
    ids = cut_in_order(ids.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("part", F.spark_partition_id()))
    first = ids.groupBy("part").agg(F.min(F.struct(*order)).alias("at")).select("part", "at.*")
    heads = first.select("part", *keys, F.explode(F.expr("transform(sequence(1, length(order_id)), i -> substring(order_id, 1, i))")).alias("order_id"))
    same = [F.col(f"h.{k}").eqNullSafe(F.col(f"i.{k}")) for k in order]
    open_at = heads.alias("h").join(ids.where("opens = 1").alias("i"), reduce(Column.__and__, same)).select("h.part", "h.order_id").collect()  # a partition's first id has few prefixes
    starts: dict[int, list[str]] = {}
    for row in sorted(open_at, key=lambda r: len(r["order_id"])):
        starts.setdefault(row["part"], []).append(row["order_id"])
    schema = StructType([*[ids.schema[k] for k in order], StructField("prefix", StringType())])
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, group, stack = None, None, []
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                here = tuple(row[k] for k in keys)
                if row["part"] != part:
                    part, group, stack = row["part"], here, list(starts.get(row["part"], ()))
                elif here != group:
                    group, stack = here, []
                while stack and not row["order_id"].startswith(stack[-1]):
                    stack.pop()
                if row["opens"] and not (stack and stack[-1] == row["order_id"]):
                    stack.append(row["order_id"])
                if row["sought"]:
                    out += [{**{k: row[k] for k in order}, "prefix": x} for x in stack]
            yield pa.RecordBatch.from_pylist(out, schema=arrow)

    return ids.mapInArrow(run, schema)


def prefix_matches(refunds: DataFrame, purchases: DataFrame, scope: Sequence[str] = ()) -> DataFrame:
    """(scope, refund_seq, refund_id, refund_minor, purchase_seq, order_id, purchase_minor): every purchase whose order id is a prefix of a refund's."""
    keys = list(scope)
    pairs = nested_prefixes(refunds, purchases, keys).select(*keys, F.col("order_id").alias("refund_id"), F.col("prefix").alias("order_id"))
    r = refunds.select(*keys, F.col("seq").alias("refund_seq"), F.col("order_id").alias("refund_id"), F.col("amount_minor").alias("refund_minor"))
    p = purchases.select(*keys, F.col("seq").alias("purchase_seq"), "order_id", F.col("amount_minor").alias("purchase_minor"))
    return r.join(pairs, [*keys, "refund_id"]).join(p, [*keys, "order_id"])


def greedy(rows: pd.DataFrame) -> list[tuple]:
    """Decisions for one root: rows (is_refund, seq, order_id, minor) in seq order."""
    key = lambda s: (s["file"], s["row"], s["part"])
    rows = sorted(rows.to_dict("records"), key=lambda r: key(r["seq"]))
    left = {i: r["minor"] for i, r in enumerate(rows) if not r["is_refund"]}
    out = []
    for r in rows:
        if not r["is_refund"]:
            continue
        at = next((i for i, v in left.items() if v > 0 and r["order_id"].startswith(rows[i]["order_id"])), None)
        if at is None:
            out.append((r["seq"], "unmatched", 0, None))
            continue
        over = r["minor"] - left[at]
        out.append((r["seq"], "paired" if over == 0 else "partial" if over < 0 else "exceeds", r["minor"], rows[at]["seq"]))
        if over < 0:
            left[at] -= r["minor"]
        else:
            del left[at]
    return out


def decisions(drafts: DataFrame, scope: Sequence[str] = ()) -> DataFrame:
    """(scope, seq, what, minor, other) for each refund with an order id: paired, partial, exceeds or unmatched, and the purchase."""
    keys = list(scope)
    with_id = drafts.withColumn("order_id", blank_to_null(text("order_id"))).where("order_id is not null").select(*keys, "seq", "order_id", "amount_minor", is_refund().alias("is_refund"))
    with_id = cut(with_id)
    refunds, purchases = with_id.where("is_refund"), with_id.where("not is_refund")
    pairs = cut(prefix_matches(refunds, purchases, keys), with_id)
    of_refund = pairs.groupBy(*keys, "refund_seq").agg(F.min_by("order_id", F.length("order_id")).alias("root"))
    rooted = pairs.join(of_refund, [*keys, "refund_seq"])
    r = rooted.select(*keys, "root", F.col("refund_seq").alias("seq"), F.col("refund_id").alias("order_id"), F.col("refund_minor").alias("minor"), F.lit(True).alias("is_refund")).distinct()
    p = rooted.select(*keys, "root", F.col("purchase_seq").alias("seq"), "order_id", F.col("purchase_minor").alias("minor"), F.lit(False).alias("is_refund")).distinct()
    both = cut(r.unionByName(p), pairs)
    group = Window.partitionBy(*keys, "root")
    both = both.withColumn("n", F.sum(F.when(F.col("is_refund"), 0).otherwise(1)).over(group))

    # one purchase: what earlier refunds took is a running sum
    lone = both.where("n = 1").withColumn("have", F.max(F.when(~F.col("is_refund"), F.col("minor"))).over(group)).withColumn("other", F.max(F.when(~F.col("is_refund"), F.col("seq"))).over(group)).where("is_refund")
    before = F.coalesce(F.sum("minor").over(group.orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    left = F.col("have") - before
    lone = lone.withColumn("left", left).withColumn("what", F.when(F.col("left") <= 0, "unmatched").when(F.col("minor") == F.col("left"), "paired").when(F.col("minor") < F.col("left"), "partial").otherwise("exceeds"))
    lone = lone.select(*keys, "seq", "what", F.when(F.col("what") != "unmatched", F.col("minor")).otherwise(0).alias("minor"), F.when(F.col("what") != "unmatched", F.col("other")).alias("other"))

    def kernel(rows: pd.DataFrame) -> pd.DataFrame:
        out = pd.DataFrame(greedy(rows), columns=["seq", "what", "minor", "other"])
        for k in keys:
            out.insert(0, k, rows[k].iloc[0] if len(rows) else None)
        return out[[*keys, "seq", "what", "minor", "other"]]

    schema = lone.schema
    many = both.where("n > 1").select(*keys, "root", "seq", "order_id", "minor", "is_refund").groupBy(*keys, "root").applyInPandas(kernel, schema)
    alone = refunds.join(of_refund.withColumnRenamed("refund_seq", "seq"), [*keys, "seq"], "left_anti")
    alone = alone.select(*keys, "seq", F.lit("unmatched").alias("what"), F.lit(0).cast("long").alias("minor"), F.lit(None).cast("struct<file:int,row:int,part:int>").alias("other"))
    return cut(lone.unionByName(many).unionByName(alone), with_id)


def orphans(refunds: DataFrame, closed_ids: DataFrame, scope: Sequence[str] = ()) -> DataFrame:
    """Refunds (seq, order_id) none of whose prefixes is the order id of a closed row."""
    keys = list(scope)
    explained = nested_prefixes(refunds, closed_ids, keys).select(*keys, "order_id").distinct()
    return refunds.join(explained, [*keys, "order_id"], "left_anti")


def pair_refunds(drafts: DataFrame, closed_ids: DataFrame, scope: Sequence[str] = ()) -> Refunds:
    """Cancel refunds against purchases, then net what rows disclose of themselves."""
    keys = list(scope)
    decided = decisions(drafts, keys)
    gone = decided.where("what in ('paired', 'partial')").select(*keys, "seq", F.when(F.col("what") == "paired", "refund-paired").otherwise("refund-partial").alias("reason"))
    cancelled = decided.where("what in ('paired', 'exceeds')").select(*keys, F.col("other").alias("seq"), F.lit("refund-paired").alias("reason"))
    dropped = gone.unionByName(cancelled)
    netted = decided.where("what = 'partial'").groupBy(*keys, F.col("other").alias("seq")).agg(F.sum("minor").alias("paired_minor"))

    kept = drafts.join(dropped.select(*keys, "seq"), [*keys, "seq"], "left_anti").join(netted, [*keys, "seq"], "left")
    disclosed = F.when(F.col("paired_minor").isNull(), disclosed_refund())
    netting = F.coalesce("paired_minor", disclosed)
    kept = kept.withColumn("_cut", netting).withColumns({"refund_netted_minor": F.col("_cut"), "amount_minor": F.col("amount_minor") - F.coalesce("_cut", F.lit(0))}).drop("_cut", "paired_minor")

    no_id = drafts.where(is_refund() & (text("order_id") == "")).select(*keys, "seq", F.lit("refund-without-order-id").alias("code"))
    over = decided.where("what = 'exceeds'").select(*keys, "seq", F.lit("refund-exceeds-purchase").alias("code"))
    lost = drafts.select(*keys, "seq", "order_id").join(decided.where("what = 'unmatched'").select(*keys, "seq"), [*keys, "seq"], "left_semi")
    lost = orphans(lost, closed_ids, keys).select(*keys, "seq", F.lit("refund-unmatched").alias("code"))
    return Refunds(kept.select(*drafts.columns), dropped, no_id.unionByName(over).unionByName(lost))
