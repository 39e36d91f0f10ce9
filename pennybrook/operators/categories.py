"""Category assignment by rules: priority first, then the order of declaration."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterable
from dataclasses import dataclass
from itertools import groupby

import ahocorasick
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import let, text
from . import lexicon as L


@dataclass(frozen=True)
class Rule:
    category: str
    pattern: str
    priority: int = 10
    field: str = "any"  # any, counterparty, description, txType or method
    is_regex: bool = False
    flags: str = "i"
    id: str = ""


FIELDS = {"counterparty": "counterparty", "description": "description", "txType": "tx_type", "method": "method"}
#: Stands between fields that are searched in one go; no rule can hold it.
GAP = "\x01"


def default_rules() -> list[Rule]:
    """The built-in rules; their ids count within a category, or within the categories that are numbered together."""
    out, counts = [], Counter()
    for category, priority, words in L.RULES:
        group = L.RULE_NUMBERING.get(category, category)
        for word in words:
            counts[group] += 1
            out.append(Rule(category, word, priority, id=f"r-{group}-{counts[group]}"))
    return out


def ordered(rules: Iterable[Rule]) -> list[Rule]:
    """By priority, ties in the given order; rules that can't match are left out."""

    def usable(r: Rule) -> bool:
        if not r.pattern:
            return False
        try:
            return not r.is_regex or bool(re.compile(r.pattern))
        except re.error:
            return False

    return sorted((r for r in rules if usable(r)), key=lambda r: -r.priority)


#: More literal rules than this are matched by an automaton: a chain of them would outgrow what Spark compiles.
CHAINED = 400


def category(rules: Iterable[Rule] | None = None, description: str = "description", chained: int = CHAINED) -> Column:
    """The category of the first rule that matches, or null.

    A rule set of usual size is compiled to one ``when`` chain: neighbouring literal rules of one field and category become one alternation, searched in the
    fields joined by a character that no rule holds.  Of more literal rules than ``chained`` all are sought in one pass over a row's text
    (``automaton``), and only patterns stay in the chain; the rule of the least rank counts.
    """
    columns = FIELDS | {"description": description}
    ranked = list(enumerate(ordered(default_rules() if rules is None else rules)))
    literal = [(rank, r) for rank, r in ranked if not r.is_regex]
    if len(literal) > chained:
        found = automaton(literal)(*[F.lower(text(c)) for c in columns.values()])
        chain = _chain([(rank, r) for rank, r in ranked if r.is_regex], columns, lambda rank, name: F.struct(F.lit(rank).alias("rank"), F.lit(name).alias("category")))
        return F.least(found, chain)["category"] if chain is not None else found["category"]
    out = _chain(ranked, columns, lambda _, name: F.lit(name))
    return F.lit(None).cast("string") if out is None else out


def _chain(ranked: list[tuple[int, Rule]], columns: dict[str, str], value: Callable[[int, str], Column]) -> Column | None:
    """The value of the first rule that matches, or null; None without rules."""
    if not ranked:
        return None
    groups = [(k, list(g)) for k, g in groupby(ranked, lambda x: (x[1].priority, not x[1].is_regex, x[1].field, x[1].category))]

    def chain(whole: Column) -> Column:
        out = None
        for (_, literal, field, name), group in groups:
            if literal:
                where = whole if field == "any" else F.lower(text(columns[field]))
                found = where.rlike("|".join(re.escape(r.pattern.lower()) for _, r in group))
            else:
                found = F.lit(False)
                for _, r in group:
                    for c in columns.values() if field == "any" else [columns[field]]:
                        found = found | ((text(c) != "") & text(c).rlike(f"(?{r.flags})" + r.pattern if set(r.flags) <= set("ims") and r.flags else r.pattern))
            then = value(group[0][0], name)
            out = F.when(found, then) if out is None else out.when(found, then)
        return out

    return let(F.lower(F.concat_ws(GAP, *[text(c) for c in columns.values()])), chain)


def automaton(literal: Iterable[tuple[int, Rule]]) -> Callable[..., Column]:
    """A function of the lower-cased fields (in the order of ``FIELDS``) that gives the least (rank, category) of the literal rules (rank, rule) that they
    hold: one pass over each text by an automaton of all patterns, whatever their number.  Rules are data of the job, a pattern and a rank each."""
    fields = list(FIELDS)
    least: dict[str, dict[str, tuple[int, str]]] = {}
    for rank, r in literal:
        of = least.setdefault(r.pattern.lower(), {})
        for field in fields if r.field == "any" else [r.field]:
            of[field] = min(of.get(field, (rank, r.category)), (rank, r.category))
    made = ahocorasick.Automaton()
    for pattern, of in least.items():
        made.add_word(pattern, tuple(of.get(f) for f in fields))
    made.make_automaton()

    @F.pandas_udf("rank int, category string")
    def first(counterparty: pd.Series, description: pd.Series, tx_type: pd.Series, method: pd.Series) -> pd.DataFrame:
        out = []
        for row in zip(counterparty, description, tx_type, method):
            best = None
            for i, value in enumerate(row):
                for _, of in made.iter(value):
                    if of[i] is not None and (best is None or of[i] < best):
                        best = of[i]
            out.append(best or (None, None))
        return pd.DataFrame(out, columns=["rank", "category"]).astype({"rank": "Int32"})

    def ranked(*columns: Column) -> Column:
        hit = first(*columns)
        return F.when(hit["rank"].isNotNull(), hit)

    return ranked


def categorised(txs: DataFrame, rules: Iterable[Rule] | None = None) -> DataFrame:
    """Transactions with category and category_source: income, expenses and refunds by rule, the others without; a user's choice stays."""
    found = category(rules, "raw_description")
    by_user = F.coalesce(F.col("category_source") == "user", F.lit(False))
    able = F.col("kind").isin("expense", "income", "refund")
    out = txs.withColumns({"tx_type": F.try_element_at("meta", F.lit("txType")), "method": F.try_element_at("meta", F.lit("method"))}).withColumn("_found", F.when(able, found))
    out = out.withColumn("category", F.when(by_user & able, F.col("category")).when(able, F.col("_found")).otherwise(F.col("category")))
    source = F.when(~able, "none").when(by_user, "user").when(F.col("_found").isNotNull(), "rule").otherwise("none")
    return out.withColumn("category_source", source).drop("_found", "tx_type", "method")


def recategorised(txs: DataFrame, rules: Iterable[Rule] | None = None) -> DataFrame:
    """Rules applied again to stored rows, by counterparty and description only; what a user set stays."""
    found = category(rules, "raw_description")
    by_user = F.coalesce(F.col("category_source") == "user", F.lit(False))
    out = txs.withColumns({"tx_type": F.lit(""), "method": F.lit("")}).withColumn("_found", found)
    return out.withColumns({"category": F.when(by_user, F.col("category")).otherwise(F.col("_found")), "category_source": F.when(by_user, "user").when(F.col("_found").isNotNull(), "rule").otherwise("none")}).drop("_found", "tx_type", "method")


def dimension(spark: SparkSession) -> DataFrame:
    """(id, label, applies_to): the category table, a few rows at any size of ledger."""
    return spark.createDataFrame([(k, *v) for k, v in L.CATEGORIES.items()], "id string, label string, applies_to string")


def with_label(df: DataFrame, column: str = "category") -> DataFrame:
    """The label of a category: its id if unknown, the label for none if missing."""
    names = dimension(df.sparkSession).select(F.col("id").alias("_id"), F.col("label").alias("_label"))
    out = df.join(F.broadcast(names), F.col(column) == F.col("_id"), "left")
    return out.withColumn("category_label", F.when(F.col(column).isNull(), F.lit(L.UNCATEGORISED)).otherwise(F.coalesce("_label", column))).drop("_id", "_label")
