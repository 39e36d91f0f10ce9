"""Reports over a ledger (amount_minor, kind, category, occurred_at, ...): plain aggregates that prune columns and push filters down."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.dates import local_month
from ..functions.money import format_minor, sum_minor
from ..functions.text import text
from ..operators.classify import is_cashflow
from ..operators import lexicon as L

NO_CATEGORY = "__uncategorised"
LIST_LIMIT, PREVIEW_LIMIT, WARNING_LIMIT, UPDATE_LIMIT, DROP_LIMIT, TREND_MONTHS = 1000, 200, 8, 20, 20, 12


def month() -> Column:
    return local_month(F.col("occurred_at"))


def amount_of(kind: str) -> Column:
    return sum_minor(F.when(F.col("kind") == kind, F.col("amount_minor")).otherwise(F.lit(0).cast("long")))


def month_totals(ledger: DataFrame) -> DataFrame:
    """(month, expense_minor, income_minor, net_minor, expense_count) of cash flow."""
    out = ledger.where(is_cashflow()).groupBy(month().alias("month")).agg(amount_of("expense").alias("expense_minor"), amount_of("income").alias("income_minor"), F.count_if(F.col("kind") == "expense").alias("expense_count"))
    return out.withColumn("net_minor", F.col("income_minor") - F.col("expense_minor"))


def spend_by_category(ledger: DataFrame, *extra: Column) -> DataFrame:
    """(category, amount_minor, n) of expenses, uncategorised ones under one name."""
    return ledger.where(F.col("kind") == "expense").groupBy(*extra, F.coalesce("category", F.lit(NO_CATEGORY)).alias("category")).agg(sum_minor("amount_minor").alias("amount_minor"), F.count(F.lit(1)).alias("n"))


def category_share(spend: DataFrame, *within: str) -> DataFrame:
    """Percentages of the total and of the largest category, rounded half up; the windows run over a row a category."""
    total, most = Window.partitionBy(*within), Window.partitionBy(*within)
    x, t, m = F.col("amount_minor"), F.sum("amount_minor").over(total), F.max("amount_minor").over(most)
    return spend.withColumn("share_pct", F.when(t == 0, F.lit(0)).otherwise(F.floor(x * 100 / t + 0.5)).cast("long")).withColumn("bar_pct", F.floor(x * 100 / F.greatest(m, F.lit(1)) + 0.5).cast("long"))


def trend(ledger: DataFrame, months: int = TREND_MONTHS) -> DataFrame:
    """The newest months with expenses and all other cash flow as income."""
    flow = ledger.where(is_cashflow()).groupBy(month().alias("month"))
    out = flow.agg(amount_of("expense").alias("expense_minor"), sum_minor(F.when(F.col("kind") != "expense", F.col("amount_minor")).otherwise(F.lit(0).cast("long"))).alias("income_minor"))
    return out.orderBy(F.desc("month")).limit(months)


def distinct_months(ledger: DataFrame) -> DataFrame:
    return ledger.select(month().alias("month")).distinct().orderBy(F.desc("month"))


def listed(ledger: DataFrame, in_month: str | None = None, kind: str | None = None, search: str | None = None) -> DataFrame:
    """Rows of a month and kind that hold a text in description, counterparty or category."""
    out = ledger
    if in_month:
        out = out.where(month() == in_month)
    if kind:
        out = out.where(F.col("kind") == kind)
    if search:
        out = out.where(F.lower(F.concat_ws(" ", text("raw_description"), text("counterparty"), text("category"))).contains(search.lower()))
    return out


def newest(ledger: DataFrame, n: int = LIST_LIMIT) -> DataFrame:
    """The n newest rows, ids breaking ties: a top-k, without a full sort."""
    return ledger.orderBy(F.desc("occurred_at"), F.asc("id")).limit(n)


def totals(ledger: DataFrame) -> DataFrame:
    """One row: rows, expense, income, net, and rows that aren't cash flow."""
    out = ledger.agg(F.count(F.lit(1)).alias("n"), amount_of("expense").alias("expense_minor"), amount_of("income").alias("income_minor"), F.count_if(~is_cashflow()).alias("non_cashflow"))
    return out.withColumn("net_minor", F.col("income_minor") - F.col("expense_minor"))


def printed_totals(drafts: DataFrame, printed: DataFrame, *by: str) -> DataFrame:
    """Rows rebuilt from a statement against the totals that it prints itself: (by, debit_minor, credit_minor, printed_debit_minor,
    printed_credit_minor, agrees).  ``printed`` has the last two by ``by``; a statement without rows has sums of zero."""
    side = lambda d: sum_minor(F.when(F.col("direction") == d, F.col("amount_minor")).otherwise(F.lit(0).cast("long")))
    sums = drafts.groupBy(*by).agg(side("out").alias("debit_minor"), side("in").alias("credit_minor"))
    out = printed.select(*by, "printed_debit_minor", "printed_credit_minor").join(sums, list(by), "left")
    out = out.withColumns({c: F.coalesce(c, F.lit(0).cast("long")) for c in ("debit_minor", "credit_minor")})
    return out.withColumn("agrees", F.expr("debit_minor <=> printed_debit_minor AND credit_minor <=> printed_credit_minor"))


def kind_label() -> Column:
    out = F.col("kind")
    for k, v in L.KIND_LABELS.items():
        out = F.when(F.col("kind") == k, F.lit(v)).otherwise(out)
    return out


def signed_amount() -> Column:
    return F.concat(F.when(F.col("direction") == "in", F.lit("+")).otherwise(F.lit("-")), format_minor(F.col("amount_minor")))


def netted_note() -> Column:
    """What is said of a purchase that a refund reduced."""
    cut = F.try_element_at("meta", F.lit("refundNettedMinor")).try_cast("long")
    stated = F.try_element_at("meta", F.lit("statedAmountMinor")).try_cast("long")
    source = F.when(stated > 0, F.concat(F.lit("，原 "), format_minor(stated))).otherwise(F.lit(""))
    return F.when(cut > 0, F.concat(F.lit("已抵扣部分退款 "), format_minor(cut), source))
