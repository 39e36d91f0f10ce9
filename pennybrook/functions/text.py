"""String functions as column expressions."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: White space as statement files hold it: Unicode spaces, NBSP, ideographic space, BOM.
SPACE = r"[\s\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000\ufeff]"
CJK = r"[\u2e80-\u9fff\uf900-\ufaff\uff00-\uffef]"
# fixed values: named entities
ENTITIES = {"amp": "&", "lt": "<", "gt": ">", "quot": '"', "apos": "'", "nbsp": " ", "#39": "'"}


def let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once.  Column expressions are inlined wherever they occur, inside lambdas once an element."""
    return F.transform(F.array(value), body)[0]


def text(c: Column | str) -> Column:
    """'' for null."""
    return F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(""))


def blank_to_null(c: Column) -> Column:
    return F.nullif(c, F.lit(""))


def trim_cell(c: Column) -> Column:
    """Null is '', NBSP a blank, white space of any kind trimmed."""
    return F.regexp_replace(F.translate(text(c), "\u00a0", " "), f"^{SPACE}+|{SPACE}+$", "")


def trim_all(c: Column) -> Column:
    return F.regexp_replace(c, f"^{SPACE}+|{SPACE}+$", "")


@F.pandas_udf(T.StringType())
def _nfkc(s: pd.Series) -> pd.Series:
    return s.map(lambda x: None if x is None else unicodedata.normalize("NFKC", x))


def nfkc(c: Column) -> Column:
    """NFKC.  ASCII takes no detour; the rest goes through one Arrow-batched function, as Spark has none."""
    c = c if isinstance(c, Column) else F.col(c)
    return F.when(c.rlike(r"^[\x00-\x7f]*$"), c).otherwise(_nfkc(F.when(c.rlike(r"[^\x00-\x7f]"), c)))


def nfkc_native(c: Column) -> Column:
    """NFKC for what statement files hold: full-width ASCII, the ideographic blank and the full-width yen sign, without leaving the JVM."""
    wide = "".join(chr(x) for x in range(0xFF01, 0xFF5F)) + "\u3000\u00a0\uffe5"
    plain = "".join(chr(x) for x in range(0x21, 0x7F)) + "  \u00a5"
    return F.when(c.rlike(r"[\uff01-\uff5e\u3000\u00a0\uffe5]"), F.translate(c, wide, plain)).otherwise(c)


def normalize_counterparty(c: Column, fold=nfkc) -> Column:
    """NFKC, lower case, no white space, no brackets."""
    return F.regexp_replace(F.lower(fold(text(c))), rf"{SPACE}|[（）()【】\[\]]", "")


def normalize_description(c: Column, fold=nfkc) -> Column:
    return F.regexp_replace(F.lower(fold(text(c))), SPACE, "")


def is_cjk(c: Column) -> Column:
    return c.rlike(f"^{CJK}")


def join_text(left: Column, right: Column) -> Column:
    """Two pieces of one cell: no blank where either side is CJK."""
    glue = F.when(F.substring(left, -1, 1).rlike(CJK) | F.substring(right, 1, 1).rlike(CJK), F.lit("")).otherwise(F.lit(" "))
    return F.when(left == "", right).when(right == "", left).otherwise(F.concat(left, glue, right))


def strip_tags(c: Column) -> Column:
    """Line breaks and tags become blanks."""
    return F.regexp_replace(F.regexp_replace(c, r"(?i)<br\s*/?>", " "), r"<[^>]*>", " ")


def decode_entities(c: Column) -> Column:
    """Named entities of the table, and decimal and hexadecimal ones; others stay as they are.

    The text is cut at the entities once, each is decoded on its own, and the parts are joined again, so a decoded '&'
    is never read as the start of another.
    """
    found = F.regexp_extract_all(c, F.lit(r"&(#[xX][0-9a-fA-F]+|#\d+|\w+);"), F.lit(0))
    parts = F.split(c, r"&(?:#[xX][0-9a-fA-F]+|#\d+|\w+);")

    def decoded(e: Column) -> Column:
        body = F.substring(e, F.lit(2), F.length(e) - 2)
        low = F.lower(body)
        digits = F.when(low.startswith("#x"), F.conv(F.substring(low, F.lit(3), F.length(low) - 2), 16, 10)).when(low.startswith("#"), F.substring(low, F.lit(2), F.length(low) - 1))
        code = digits.try_cast("int")
        # a code point as UTF-16BE: one unit, or a surrogate pair above U+FFFF
        high, lowu = F.lit(0xD800) + F.floor((code - 0x10000) / 1024), F.lit(0xDC00) + (code - 0x10000) % 1024
        units = F.when(code < 0x10000, F.lpad(F.hex(code), 4, "0")).otherwise(F.concat(F.lpad(F.hex(high), 4, "0"), F.lpad(F.hex(lowu.cast("long")), 4, "0")))
        numeric = F.decode(F.unhex(units), "UTF-16BE")
        out = e
        for name, value in ENTITIES.items():
            out = F.when(low == name, F.lit(value)).otherwise(out)
        return F.when(code.isNotNull() & code.between(1, 0x10FFFF) & ~code.between(0xD800, 0xDFFF), numeric).otherwise(out)

    whole = F.zip_with(parts, found, lambda p, e: F.concat(text(p), F.coalesce(decoded(e), F.lit(""))))
    return F.array_join(whole, "")


def cell_text(html: Column) -> Column:
    return trim_cell(decode_entities(strip_tags(html)))
