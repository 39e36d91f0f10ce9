"""Upsert by fingerprint: what an import adds, corrects or repeats."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.money import format_minor
from ..functions.text import text
from ..session import cut

#: What makes two records the same; batch, fingerprint and its version are provenance.
CONTENT = ("source", "account_id", "direction", "amount_minor", "currency", "occurred_at", "counterparty", "balance_after_minor", "raw_description", "category", "category_source", "kind", "source_order_id")
NOT_CONTENT = ("preimage",)


def entries(meta: Column) -> Column:
    """A map's entries by key: maps themselves can't be compared."""
    return F.array_sort(F.map_entries(meta))


def content(prefix: str = "") -> Column:
    return F.struct(*[F.col(prefix + c).alias(c) for c in CONTENT], entries(F.col(prefix + "meta")).alias("meta"))


def first_in_batch(txs: DataFrame, scope: Sequence[str] = ()) -> DataFrame:
    """With ``first``: whether a row is the first of its fingerprint, in ``seq`` order.

    The least seq comes from an aggregate that combines before the shuffle and is joined back, so a fingerprint that many rows share
    isn't sorted in one task.
    """
    keys = [*scope, "fingerprint"]
    least = txs.groupBy(*keys).agg(F.min("seq").alias("_least"))
    return txs.join(least, keys).withColumn("first", F.col("seq") == F.col("_least")).drop("_least")


def changes(b: str = "b.", a: str = "a.") -> Column:
    """What differs between a stored and a corrected record, in words."""

    def show(c: Column) -> Column:
        return F.when(text(c.cast("string")) == "", F.lit("(none)")).otherwise(c.cast("string"))

    def line(label: str, before: Column, after: Column) -> Column:
        return F.concat(F.lit(label + " "), before, F.lit(" -> "), after)

    def differs(name: str, loose: bool = False) -> Column:
        x, y = F.col(b + name), F.col(a + name)
        return text(x) != text(y) if loose else ~x.eqNullSafe(y)

    iso = lambda c: F.concat(F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss.SSS"), F.lit("Z"))
    plain = [
        F.when(differs("amount_minor"), line("amount", format_minor(F.col(b + "amount_minor")), format_minor(F.col(a + "amount_minor")))),
        F.when(differs("kind"), line("kind", F.col(b + "kind"), F.col(a + "kind"))),
        F.when(differs("direction"), line("direction", F.col(b + "direction"), F.col(a + "direction"))),
        F.when(differs("category", True), line("category", show(F.col(b + "category")), show(F.col(a + "category")))),
        F.when(differs("occurred_at"), line("time", iso(F.col(b + "occurred_at")), iso(F.col(a + "occurred_at")))),
        F.when(differs("counterparty", True), line("counterparty", show(F.col(b + "counterparty")), show(F.col(a + "counterparty")))),
        F.when(differs("raw_description"), line("description", show(F.col(b + "raw_description")), show(F.col(a + "raw_description")))),
    ]
    empty = F.create_map().cast("map<string,string>")
    mb, ma = F.coalesce(F.col(b + "meta"), empty), F.coalesce(F.col(a + "meta"), empty)
    keys = F.array_except(F.array_sort(F.array_union(F.map_keys(mb), F.map_keys(ma))), F.array(*[F.lit(x) for x in NOT_CONTENT]))
    other = F.transform(keys, lambda k: F.when(~F.try_element_at(mb, k).eqNullSafe(F.try_element_at(ma, k)), F.concat(k, F.lit(" "), show(F.try_element_at(mb, k)), F.lit(" -> "), show(F.try_element_at(ma, k)))))
    return F.filter(F.concat(F.array(*plain), other), lambda x: x.isNotNull())


@dataclass
class Overlap:
    fresh: DataFrame
    duplicates: DataFrame
    updated: DataFrame  # fingerprint, before, after, changes


#: Rows, or a function of the import's fingerprints (fingerprint) that finds the rows among them, as a store's key index does.
Known = DataFrame | Callable[[DataFrame], DataFrame] | None


def reconcile(txs: DataFrame, stored: Known = None, skip: Known = None, scope: Sequence[str] = ()) -> Overlap:
    """Fresh rows, duplicates and corrections.  A user's category outranks the import's, and a stored id stays.

    One left join tells what becomes of each row; its result is checkpointed, so the three outputs see one evaluation.
    """
    columns = txs.columns
    pack = lambda prefix, fixed={}: F.struct(*[fixed.get(c, F.col(f"{prefix}.{c}")).alias(c) for c in columns])
    txs = cut(txs)
    stored, skip = (x(txs.select("fingerprint")) if callable(x) else x for x in (stored, skip))
    rows = first_in_batch(txs, scope).select(F.struct(*columns).alias("n"), "first")
    stored = txs.limit(0) if stored is None else stored
    rows = rows.join(stored.select(F.struct(*columns).alias("b")), F.expr("first AND n.fingerprint = b.fingerprint"), "left")
    user = F.col("b.category_source") == "user"
    fixed = {"id": F.col("b.id"), "category": F.when(user, F.col("b.category")).otherwise(F.col("n.category")), "category_source": F.when(user, F.lit("user")).otherwise(F.col("n.category_source"))}
    rows = rows.withColumn("a", F.when(F.col("b").isNotNull(), pack("n", fixed)))
    known = F.lit(False)
    if skip is not None:
        rows = rows.join(skip.select(F.col("fingerprint").alias("_skip")).distinct(), F.expr("first AND n.fingerprint = _skip"), "left")
        known = F.col("_skip").isNotNull()
    same = content("a.").eqNullSafe(content("b."))
    what = F.when(~F.col("first"), "duplicate").when(F.col("b").isNotNull(), F.when(same, "duplicate").otherwise("updated")).when(known, "duplicate").otherwise("fresh")
    rows = cut(rows.select("n", "b", "a", what.alias("what")))
    updated = rows.where("what = 'updated'").select(F.col("b.fingerprint").alias("fingerprint"), F.col("b").alias("before"), F.col("a").alias("after"), changes().alias("changes"))
    return Overlap(rows.where("what = 'fresh'").select("n.*"), rows.where("what = 'duplicate'").select("n.*"), updated)
