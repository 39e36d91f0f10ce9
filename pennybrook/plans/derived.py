"""Deterministic ledger rows derived from the supplied star-schema tables, as SQL that Spark and DuckDB both run.

``EPOCH(x)`` stands for the epoch second of a timestamp without zone and is written out for either engine.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schema import DRAFT

DESCRIPTIONS = ["午餐美团外卖", "地铁充值", "工资发放", "花呗还款", "基金定投", "转账到余额宝", "酒店预订", "分期手续费", "账户结息", "超市购物", "Steam 游戏", "水费缴纳", "黄金积存", "普通消费"]
TYPES = ["消费", "转账", "餐饮美食", "投资理财", "退款", "缴费", "转账", "购物", "其他"]


def _pick(key: str, values: list[str]) -> str:
    return f"CASE {key} % {len(values)} " + " ".join(f"WHEN {i} THEN '{v}'" for i, v in enumerate(values)) + " END"


ORDERS = f"""
SELECT o_orderkey AS k, CASE WHEN o_orderkey % 3 = 0 THEN 'in' ELSE 'out' END AS direction,
       CAST(round(o_totalprice * 100) AS BIGINT) AS amount_minor,
       EPOCH(o_orderdate) + (o_orderkey * 7919) % 86400 AS epoch,
       n_name AS counterparty, {_pick('o_orderkey', DESCRIPTIONS)} AS description,
       CASE WHEN o_orderkey % 5 = 0 AND o_orderkey % 2 = 0 THEN CAST(round(o_totalprice * 200) AS BIGINT) + o_orderkey END AS balance_after_minor,
       CASE WHEN o_orderstatus = 'P' THEN '交易关闭' WHEN o_orderkey % 13 = 0 THEN '已退款(¥1.00)' WHEN o_orderkey % 17 = 0 THEN '退款成功' ELSE '交易成功' END AS status,
       CASE WHEN o_orderkey % 5 <> 0 THEN lpad(CAST(o_orderkey AS VARCHAR(20)), 8, '0') END AS order_id,
       c_mktsegment AS method, {_pick('o_orderkey', TYPES)} AS tx_type, o_orderkey % 7 = 0 AS excluded, o_custkey AS account
FROM {{orders}} JOIN {{customer}} ON o_custkey = c_custkey JOIN {{nation}} ON c_nationkey = n_nationkey
"""

#: Refunds of orders: part numbers the line items of an order by their whole content, as their keys repeat.
REFUNDS = """
SELECT l_orderkey AS k, lpad(CAST(l_orderkey AS VARCHAR(20)), 8, '0') || 'R' || CAST(l_linenumber AS VARCHAR(9)) AS order_id,
       CAST(round(l_extendedprice * 100) AS BIGINT) AS amount_minor,
       CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, l_shipdate) AS INT) AS part
FROM {lineitem} WHERE l_returnflag = 'R'
"""

LEGS = """
SELECT l_suppkey AS account, CAST(round(l_quantity * 100) AS BIGINT) AS amount_minor, CASE WHEN l_linenumber % 2 = 0 THEN 'in' ELSE 'out' END AS direction,
       EPOCH(l_shipdate) + (l_partkey * 3571) % 86400 AS epoch, l_orderkey AS k,
       CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, l_shipdate) AS INT) AS part
FROM {lineitem}
"""

TABLES = ("orders", "customer", "nation", "lineitem", "events", "documents", "pages", "supplier", "part", "region")


def duck(text: str) -> str:
    return re.sub(r"EPOCH\(([^()]*)\)", r"CAST(epoch(\1) AS BIGINT)", text.format(**{t: t for t in TABLES}))


def frame(spark: SparkSession, sf_dir: str, text: str) -> DataFrame:
    text = re.sub(r"EPOCH\(([^()]*)\)", r"timestampdiff(SECOND, TIMESTAMP_NTZ '1970-01-01 00:00:00', \1)", text)
    used = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in TABLES if "{" + t + "}" in text}
    return spark.sql(text, **used)


def _drafts(df: DataFrame, columns: dict) -> DataFrame:
    return df.select(*[columns.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in DRAFT.fields])


def order_drafts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Drafts from orders: seq is (0, order key, 0)."""
    d = frame(spark, sf_dir, ORDERS)
    same = {c: F.col(c) for c in ("direction", "amount_minor", "counterparty", "description", "balance_after_minor", "status", "order_id", "method", "tx_type")}
    return _drafts(d, same | {"seq": F.struct(F.lit(0).alias("file"), F.col("k").cast("int").alias("row"), F.lit(0).alias("part")), "source": F.lit("orders"), "account_id": F.col("account").cast("string"), "currency": F.lit("CNY"), "occurred_at": F.timestamp_seconds("epoch"), "excluded_from_cashflow": F.col("excluded")})


def refund_drafts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Purchases (orders without status or type) and their refunds, for pairing."""
    o = frame(spark, sf_dir, ORDERS).where("order_id is not null and k % 4 <> 1")
    r = frame(spark, sf_dir, REFUNDS)
    seq = lambda part: F.struct(F.lit(0).alias("file"), F.col("k").cast("int").alias("row"), part.cast("int").alias("part"))
    common = {"source": F.lit("orders"), "account_id": F.lit("a"), "currency": F.lit("CNY"), "order_id": F.col("order_id"), "amount_minor": F.col("amount_minor"), "excluded_from_cashflow": F.lit(False)}
    bought = _drafts(o, common | {"seq": seq(F.lit(0)), "direction": F.lit("out"), "description": F.lit("x"), "status": F.lit("交易成功")})
    back = _drafts(r, common | {"seq": seq(F.col("part")), "direction": F.lit("in"), "description": F.lit("x"), "status": F.lit("退款成功")})
    return bought.unionByName(back)


def leg_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Legs of transfers: (account, id, direction, amount_minor, epoch, seq)."""
    d = frame(spark, sf_dir, LEGS)
    return d.select("account", F.concat_ws("-", "k", "part").alias("id"), "direction", "amount_minor", "epoch", F.struct(F.lit(0).alias("file"), F.col("k").cast("int").alias("row"), F.col("part").alias("part")).alias("seq"))
