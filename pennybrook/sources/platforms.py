"""Grids to drafts: two payment platforms and template-mapped statements, as projections over (file, row, cells, header, header_row).

Every parser returns (drafts, warnings).  A bad row is a warning, never a failed job; which checks come first is part of the result.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.dates import combine_date_time, to_instant
from ..functions.money import parse_minor
from ..functions.text import blank_to_null, text, trim_all
from ..operators import lexicon as L
from ..operators.classify import infer_direction
from ..schema import DRAFT
from .containers import ImportProblem, cell, header_named

ALIPAY, WECHAT, GENERIC = "alipay", "wechat", "generic:"
EXCLUDED_MARKERS = ("不计收支", "/", "其他")


@dataclass(frozen=True)
class Template:
    """A versioned mapping of columns to fields."""

    id: str
    label: str
    columns: dict[str, str]
    amount_mode: str = "signed"  # signed, positive-is-expense, positive-is-income
    note: str = ""
    direction_values: dict[str, list[str]] | None = None
    encoding: str | None = None
    delimiter: str | None = None
    strip_tabs: bool = False
    extra: dict = field(default_factory=dict)


STARTER_TEMPLATES = (
    Template("boc-debit-pdf@2026-09", "中国银行：借记卡交易流水明细清单（PDF）", {"date": "记账日期", "time": "记账时间", "amount": "金额", "balance": "余额", "txType": "交易名称", "method": "渠道", "description": "附言", "counterparty": "对方账户名"}),
    Template("demo-bank@2026-09", "示例：借记卡（收入/支出分列）", {"date": "交易日期", "income": "收入", "expense": "支出", "balance": "余额", "counterparty": "对方户名", "description": "摘要", "status": "交易状态"}, "positive-is-expense"),
    Template("demo-credit@2026-09", "示例：信用卡（单金额列 + 借贷标志）", {"date": "交易日期", "amount": "交易金额", "direction": "借/贷", "counterparty": "交易描述", "description": "交易描述"}),
)


def required_columns(t: Template) -> list[str]:
    return list(dict.fromkeys(v for v in t.columns.values() if v))


def validate(t: Template, header: list[str]) -> None:
    missing = [c for c in required_columns(t) if c not in header]
    if missing:
        raise ImportProblem(f"{t.label}: missing columns {', '.join(missing)}; found {' | '.join(c for c in header if c)}")
    if not any(t.columns.get(k) for k in ("amount", "income", "expense")):
        raise ImportProblem(f"{t.label}: no amount column is mapped")


def pick_template(header: list[str], templates=STARTER_TEMPLATES) -> Template | None:
    """The first template all of whose columns the header has."""
    return next((t for t in templates if set(required_columns(t)) <= set(header)), None)


def merge_templates(saved, starters=STARTER_TEMPLATES) -> list[Template]:
    """Saved templates first; a saved one outranks a starter of its id."""
    out = {t.id: t for t in starters}
    out.update({t.id: t for t in saved})
    return [*(out[t.id] for t in saved), *(t for t in starters if t.id not in {s.id for s in saved})]


def data_rows(grid: DataFrame, header_name: str) -> DataFrame:
    """Rows below each file's header that aren't blank, with the header; a header row a file joins by broadcast or by file."""
    heads = header_named(grid, header_name)
    out = grid.select("file", "row", "cells").join(heads, "file").where("row > header_row")
    return out.where(F.exists("cells", lambda c: c != ""))


def raw_map() -> Column:
    """header -> cell; blank names are left out, of a name that occurs twice the last cell counts (spark.sql.mapKeyDedupPolicy)."""
    names = F.col("header")
    pairs = F.filter(F.transform(names, lambda n, i: F.struct(n.alias("k"), F.coalesce(F.get("cells", i), F.lit("")).alias("v"))), lambda p: p["k"] != "")
    last = F.filter(pairs, lambda p, i: ~F.exists(F.slice(F.transform(pairs, lambda q: q["k"]), i + 2, F.size(pairs)), lambda k: k == p["k"]))
    return F.map_from_entries(last)


def seq(part: int | Column = 0) -> Column:
    return F.struct(F.col("file").cast("int").alias("file"), F.col("row").cast("int").alias("row"), (F.lit(part) if isinstance(part, int) else part).cast("int").alias("part"))


def _drafts(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    return df.select(*[columns.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in DRAFT.fields])


def _warnings(df: DataFrame) -> DataFrame:
    return df.where("warning is not null").select("file", F.col("warning").alias("code"), (F.col("row") + 1).alias("row"))


def parse_alipay(grid: DataFrame, account_id: str) -> tuple[DataFrame, DataFrame]:
    d = data_rows(grid, "交易时间")
    get = lambda n: cell(F.col("header"), F.col("cells"), n)
    names = {"t": "交易时间", "category": "交易分类", "counterparty": "交易对方", "item": "商品说明", "printed": "收/支", "money": "金额", "method": "收/付款方式", "status": "交易状态", "order": "交易订单号", "merchant": "商家订单号"}
    d = d.select("file", "row", raw_map().alias("raw"), *[get(v).alias(k) for k, v in names.items()])
    hints = F.concat_ws(" ", "category", "item", "counterparty")
    printed = F.col("printed")
    excluded = printed.isin("不计收支", "")
    d = d.withColumns({"at": to_instant(F.col("t")), "minor": parse_minor(F.col("money"))})
    direction = F.when(printed == "收入", "in").when(printed == "支出", "out").when(excluded, infer_direction(hints))
    d = d.withColumns({"direction": F.when(F.col("minor") < 0, "out").otherwise(direction), "excluded": excluded})
    d = d.withColumn("warning", F.when(F.col("at").isNull(), "unparsable-date").when(F.col("minor").isNull(), "unparsable-amount").when(F.col("minor") == 0, "zero-amount").when(direction.isNull(), "unknown-direction-value"))
    described = F.coalesce(*[blank_to_null(F.col(c)) for c in ("item", "category", "counterparty")], F.lit("Alipay transaction"))
    made = {"seq": seq(), "source": F.lit(ALIPAY), "account_id": F.lit(account_id), "direction": F.col("direction"), "amount_minor": F.abs("minor"), "currency": F.lit("CNY"), "occurred_at": F.col("at"), "counterparty": blank_to_null(F.col("counterparty")), "description": described, "status": blank_to_null(F.col("status")), "order_id": blank_to_null(F.col("order")), "merchant_order_id": blank_to_null(F.col("merchant")), "method": blank_to_null(F.col("method")), "tx_type": blank_to_null(F.col("category")), "excluded_from_cashflow": F.col("excluded"), "raw": F.col("raw")}
    return _drafts(d.where("warning is null"), made), _warnings(d)


def service_fee(note: Column) -> tuple[Column, Column]:
    """(minor units of a fee that a note states, or null; the note without it)."""
    found = F.regexp_extract(note, L.SERVICE_FEE, 1)
    minor = F.when(~note.isin("", "/") & (found != ""), parse_minor(found))
    edges = r"[\s,，;；、]+"
    rest = trim_all(F.regexp_replace(F.regexp_replace(note, f"(?s)^(.*?){L.SERVICE_FEE}(.*)$", "$1$3"), f"^{edges}|{edges}$", ""))
    return F.when(minor > 0, minor), rest


def parse_wechat(grid: DataFrame, account_id: str) -> tuple[DataFrame, DataFrame]:
    """As the other platform, but a fee that the note states is split off as a row of its own, with the same order id."""
    d = data_rows(grid, "交易时间")
    get = lambda n: cell(F.col("header"), F.col("cells"), n)
    unit = F.get(F.filter("header", lambda h: h.rlike(r"^金额\s*[（(][^)）]*[)）]$")), F.lit(0))
    money_name = F.when(F.array_contains("header", "金额"), F.lit("金额")).otherwise(unit)
    names = {"t": "交易时间", "type": "交易类型", "counterparty": "交易对方", "item": "商品", "printed": "收/支", "method": "支付方式", "status": "当前状态", "order": "交易单号", "merchant": "商户单号", "note": "备注"}
    d = d.select("file", "row", raw_map().alias("raw"), cell(F.col("header"), F.col("cells"), money_name).alias("money"), *[get(v).alias(k) for k, v in names.items()])
    printed = F.col("printed")
    excluded = printed.isin("/", "")
    d = d.withColumns({"at": to_instant(F.col("t")), "minor": parse_minor(F.col("money"))})
    direction = F.when(printed == "收入", "in").when(printed == "支出", "out").when(excluded, infer_direction(F.concat_ws(" ", "type", "item", "note", "counterparty")))
    d = d.withColumns({"direction": F.when(F.col("minor") < 0, "out").otherwise(direction), "excluded": excluded})
    d = d.withColumn("warning", F.when(F.col("at").isNull(), "unparsable-date").when(F.coalesce(F.col("minor"), F.lit(0)) == 0, "unparsable-amount").when(direction.isNull(), "unknown-direction-value"))
    good = d.where("warning is null").withColumn("minor", F.abs("minor"))
    fee, rest = service_fee(F.col("note"))
    good = good.withColumns({"fee": F.when(F.col("direction") == "out", fee), "rest": rest}).withColumn("split", F.coalesce(F.col("fee") < F.col("minor"), F.lit(False)))

    def described(note: Column) -> Column:
        parts = F.filter(F.array(F.col("item"), note), lambda x: ~x.isin("", "/"))
        return F.coalesce(blank_to_null(F.array_join(parts, " / ")), blank_to_null(F.col("type")), blank_to_null(F.col("counterparty")), F.lit("WeChat transaction"))

    def half(part: int, amount: Column, who: Column, what: Column, kind: Column, out: Column) -> Column:
        return F.struct(F.lit(part).alias("part"), amount.alias("amount"), who.alias("who"), what.alias("what"), kind.alias("kind"), out.alias("out"))

    who, kind = blank_to_null(F.col("counterparty")), blank_to_null(F.col("type"))
    principal = half(0, F.col("minor") - F.col("fee"), who, described(F.col("rest")), kind, F.col("excluded"))
    cost = half(1, F.col("fee"), F.concat(F.coalesce(who, F.lit("WeChat")), F.lit(" (服务费)")), F.concat(F.lit("服务费 / "), F.col("note")), F.lit("服务费"), F.lit(False))
    whole = half(0, F.col("minor"), who, described(F.col("note")), kind, F.col("excluded"))
    good = good.withColumn("x", F.explode(F.when(F.col("split"), F.array(principal, cost)).otherwise(F.array(whole))))
    made = {"seq": seq(F.col("x.part")), "source": F.lit(WECHAT), "account_id": F.lit(account_id), "direction": F.col("direction"), "amount_minor": F.col("x.amount"), "currency": F.lit("CNY"), "occurred_at": F.col("at"), "counterparty": F.col("x.who"), "description": F.col("x.what"), "status": blank_to_null(F.col("status")), "order_id": blank_to_null(F.col("order")), "merchant_order_id": blank_to_null(F.col("merchant")), "method": blank_to_null(F.col("method")), "tx_type": F.col("x.kind"), "excluded_from_cashflow": F.col("x.out"), "raw": F.col("raw")}
    return _drafts(good, made), _warnings(d)


def parse_generic(grid: DataFrame, template: Template, account_id: str) -> tuple[DataFrame, DataFrame]:
    """Statements mapped by a template: income and expense columns, or one signed column with or without a direction column."""
    c = template.columns
    d = data_rows(grid, c["date"])
    names = ("date", "time", "income", "expense", "amount", "direction", "counterparty", "description", "txType", "method", "status", "orderId", "balance")
    d = d.select("file", "row", raw_map().alias("raw"), *[(cell(F.col("header"), F.col("cells"), c[k]) if c.get(k) else F.lit("")).alias(k) for k in names])
    d = d.withColumns({"at": to_instant(combine_date_time(F.col("date"), F.col("time"))), "i": parse_minor(F.col("income")), "e": parse_minor(F.col("expense")), "s": parse_minor(F.col("amount")), "flag": trim_all(F.col("direction"))})
    blank = lambda n: trim_all(F.col(n)).isin("", "/")
    gain, cost = F.abs(F.coalesce("i", F.lit(0).cast("long"))), F.abs(F.coalesce("e", F.lit(0).cast("long")))
    if c.get("income") or c.get("expense"):
        unread = (F.col("i").isNull() & ~blank("income")) | (F.col("e").isNull() & ~blank("expense"))
        nothing = (gain == 0) & (cost == 0)
        trouble = F.when(unread, "unparsable-amount").when((gain > 0) & (cost > 0), "ambiguous-both-sides")
        silent = ~unread & nothing
        minor, side = F.greatest(gain, cost), F.when(gain > 0, "in").otherwise("out")
    else:
        silent = (F.col("s") == 0) & (F.col("amount") != "")
        trouble = F.when(F.coalesce("s", F.lit(0).cast("long")) == 0, "unparsable-amount")
        minor, side = F.abs("s"), F.when(F.col("s") < 0, "out")
    words = template.direction_values or L.DIRECTION_WORDS
    flag = F.col("flag")
    excluded = flag.isin(*EXCLUDED_MARKERS)
    told = F.when(excluded, infer_direction(F.concat_ws(" ", "description", "counterparty", "txType"))).when(flag.isin(*words["in"]), "in").when(flag.isin(*words["out"]), "out")
    fallback = F.lit({"signed": "in", "positive-is-expense": "out", "positive-is-income": "in"}[template.amount_mode])
    d = d.withColumns({"minor": minor, "to": F.coalesce(told, side, fallback), "excluded": excluded, "silent": F.coalesce(silent, F.lit(False)), "strange": (flag != "") & told.isNull()})
    d = d.withColumn("warning", F.when(F.col("at").isNull(), "unparsable-date").when(F.col("silent"), None).otherwise(trouble))
    good = d.where("warning is null and not silent and at is not null")
    described = F.coalesce(*[blank_to_null(F.col(x)) for x in ("description", "txType", "counterparty")], F.lit(f"{template.label} transaction"))
    made = {"seq": seq(), "source": F.lit(GENERIC + template.id), "account_id": F.lit(account_id), "direction": F.col("to"), "amount_minor": F.col("minor"), "currency": F.lit("CNY"), "occurred_at": F.col("at"), "counterparty": blank_to_null(F.col("counterparty")), "description": described, "balance_after_minor": parse_minor(F.col("balance")), "status": blank_to_null(F.col("status")), "order_id": blank_to_null(F.col("orderId")), "method": blank_to_null(F.col("method")), "tx_type": blank_to_null(F.col("txType")), "excluded_from_cashflow": F.col("excluded"), "raw": F.col("raw")}
    kept = good.where("strange").select("file", F.lit("unknown-direction-value").alias("code"), (F.col("row") + 1).alias("row"))
    return _drafts(good, made), _warnings(d).unionByName(kept)


def parse(grid: DataFrame, platform: str | None, account_id: str, template: Template | None = None) -> tuple[DataFrame, DataFrame]:
    """Dispatch: a forced or detected platform, else a template."""
    if platform == ALIPAY:
        return parse_alipay(grid, account_id)
    if platform == WECHAT:
        return parse_wechat(grid, account_id)
    if template is None:
        raise ImportProblem("a template is needed for a statement of no known platform")
    return parse_generic(grid, template, account_id)


def check_platform_header(header: list[str], platform: str) -> None:
    """Refuse layouts without the columns a platform's parser needs, the old ones among them."""
    money = any(h == "金额" for h in header) or platform == WECHAT and any(h.startswith("金额") for h in header)
    missing = [n for n in ("交易时间", "收/支") if n not in header] + ([] if money else ["金额"])
    if missing:
        raise ImportProblem(f"{platform}: missing columns {', '.join(missing)}")
