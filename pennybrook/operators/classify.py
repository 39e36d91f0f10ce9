"""Row predicates and the ordered classification of drafts, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.money import parse_minor
from ..functions.text import let, nfkc_native, text
from . import lexicon as L


def joined(*names: str) -> Column:
    return F.lower(F.concat_ws(" ", *[text(n) for n in names]))


def raw_type() -> Column:
    """The transaction type as the statement prints it."""
    return F.coalesce(F.try_element_at("raw", F.lit("交易类型")), F.lit(""))


def haystack(with_raw: bool = True) -> Column:
    parts = [text("counterparty"), text("description"), text("tx_type"), *([raw_type()] if with_raw else []), text("method")]
    return F.lower(F.concat_ws(" ", *parts))


def is_closed() -> Column:
    return text("status").rlike(L.CLOSED_STATUS) | text("description").rlike(L.CLOSED_TEXT)


def infer_direction(c: Column) -> Column:
    low = F.lower(c)
    return F.when(low.rlike(L.OUT_HINTS), F.lit("out")).when(low.rlike(L.IN_HINTS), F.lit("in")).otherwise(F.lit("out"))


def disclosed_refund(amount: Column | None = None) -> Column:
    """The partial refund a status states, if it is more than nothing and less than the amount."""
    amount = F.col("amount_minor") if amount is None else amount
    status = text("status")
    figure = F.concat(F.regexp_extract(status, L.DISCLOSED, 1), F.regexp_extract(status, L.DISCLOSED, 2))
    return F.when(status.contains("退"), let(parse_minor(figure, fold=nfkc_native), lambda minor: F.when((minor > 0) & (minor < amount), minor)))


def is_refund(amount: Column | None = None) -> Column:
    refund = text("status").rlike(L.REFUND_STATUS) | (text("tx_type") == "退款")
    return disclosed_refund(amount).isNull() & refund


def kind(with_raw: bool = True) -> Column:
    """The first rule that holds, fees before all others."""
    excluded, out = F.coalesce(F.col("excluded_from_cashflow"), F.lit(False)), F.col("direction") == "out"

    def first(x: Column) -> Column:
        hay, described = x["hay"], x["described"]
        return (
            F.when(out & hay.rlike(L.FEE), "expense")
            .when(~out & described.rlike(L.INTEREST_INCOME) & ~described.rlike(L.FEE_CONTEXT), "income")
            .when(hay.rlike(L.REPAYMENT), "transfer-repayment")
            .when(hay.rlike(L.INVESTMENT), "transfer-investment")
            .when(excluded & hay.rlike(L.INVESTMENT_BY_FLAG), "transfer-investment")
            .when(excluded, "transfer-internal")
            .when(out, "expense")
            .otherwise("income")
        )

    return let(F.struct(haystack(with_raw).alias("hay"), F.lower(text("description")).alias("described")), first)


def looks_like_transfer() -> Column:
    return F.coalesce(F.col("excluded_from_cashflow"), F.lit(False)) | haystack().rlike(L.TRANSFER_HINT_DRAFT)


def is_pairing_candidate() -> Column:
    """Over transactions: what may be a leg of an internal transfer."""
    words = F.concat_ws(" ", text("counterparty"), text("raw_description"), F.coalesce(F.try_element_at("meta", F.lit("txType")), F.lit("")), F.coalesce(F.try_element_at("meta", F.lit("method")), F.lit("")))
    other = F.col("kind").isin("transfer-investment", "transfer-repayment", "refund")
    return ~other & ((F.col("kind") == "transfer-internal") | words.rlike(L.TRANSFER_HINT))


def is_cashflow() -> Column:
    return F.col("kind").isin("expense", "income")
