"""Schemas and value sets of the ledger.

Money is a long of minor units, never a double; direction carries the sign.  Absent values are null, never ''.
Rows have no order in Spark, so every draft carries ``seq`` = (file, row, part), which the greedy operators follow.
"""

from __future__ import annotations

from pyspark.sql import types as T

# fixed values: enumerations of the transaction model
DIRECTIONS = ("in", "out")
KINDS = ("expense", "income", "transfer-internal", "transfer-investment", "transfer-repayment", "refund", "unknown")
CASHFLOW_KINDS = ("expense", "income")
TRANSFER_KINDS = ("transfer-internal", "transfer-investment", "transfer-repayment")
CATEGORY_SOURCES = ("rule", "user", "none")
DROP_REASONS = ("closed-or-failed", "refund-paired", "refund-partial", "duplicate")
SUPPORTED_EXTENSIONS = ("csv", "tsv", "txt", "xls", "xlsx", "pdf", "zip")
MAX_SAFE_MINOR = 9007199254740991

SEQ = T.StructType([T.StructField("file", T.IntegerType()), T.StructField("row", T.IntegerType()), T.StructField("part", T.IntegerType())])
TEXT_MAP = T.MapType(T.StringType(), T.StringType())


def _fields(spec: str) -> list[T.StructField]:
    kinds = {"s": T.StringType(), "l": T.LongType(), "t": T.TimestampType(), "b": T.BooleanType(), "m": TEXT_MAP, "i": T.IntegerType()}
    return [T.StructField(name, kinds[kind]) for name, kind in (x.split(":") for x in spec.split())]


DRAFT = T.StructType([T.StructField("seq", SEQ), *_fields("source:s account_id:s direction:s amount_minor:l currency:s occurred_at:t counterparty:s description:s balance_after_minor:l status:s order_id:s merchant_order_id:s method:s tx_type:s excluded_from_cashflow:b raw:m refund_netted_minor:l")])
TRANSACTION = T.StructType([T.StructField("seq", SEQ), *_fields("id:s fingerprint:s fingerprint_version:i source:s account_id:s direction:s amount_minor:l currency:s occurred_at:t counterparty:s balance_after_minor:l raw_description:s category:s category_source:s kind:s imported_batch_id:s source_order_id:s meta:m")])
WARNING = T.StructType(_fields("code:s row:i message:s"))
BATCH = T.StructType(_fields("id:s file_name:s source_label:s imported_at:t inserted:l updated:l duplicates:l dropped:l") + [T.StructField("notes", T.ArrayType(T.StringType()))])
GLYPHS = T.StructType([T.StructField("page", T.IntegerType()), T.StructField("text", T.StringType()), T.StructField("x", T.DoubleType()), T.StructField("y", T.DoubleType()), T.StructField("width", T.DoubleType())])
GRID = T.StructType([T.StructField("file", T.IntegerType()), T.StructField("row", T.IntegerType()), T.StructField("cells", T.ArrayType(T.StringType()))])
