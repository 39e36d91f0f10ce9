"""Delimited text, HTML tables, header rows and platforms in plain Python: what the expressions of ``pennybrook.sources.containers`` are held against."""

from __future__ import annotations

import csv
import html
import io
import re
from statistics import pvariance

from pennybrook.operators.lexicon import HEADER_KEYWORDS
from pennybrook.sources.containers import ALIPAY_MARKS, DELIMITER_LINES, HEADER_ROWS, WECHAT_MARKS, ImportProblem


def clean(value: str | None) -> str:
    return (value or "").replace("\u00a0", " ").strip().strip("\ufeff")


def likely_delimiter(text: str) -> str:
    """The delimiter whose number of fields varies least over the first lines, with two fields a line or more."""
    lines = [x for x in text.split("\n") if x.strip()][:DELIMITER_LINES]
    best, least = ",", None
    for d in (",", "\t", "|", ";"):
        fields = [len(r) for r in csv.reader(lines, delimiter=d)]
        if fields and sum(fields) / len(fields) > 1.99:
            spread = pvariance(fields) / (sum(fields) / len(fields))
            if least is None or spread < least:
                best, least = d, spread
    return best


def delimited(text: str, delimiter: str | None = None, strip_tabs: bool = False) -> tuple[list[list[str]], str]:
    """Rows of a delimited text with mixed line ends; blank lines vanish, cells are trimmed."""
    if strip_tabs:
        if delimiter == "\t":
            raise ImportProblem("tabs can't be stripped from a tab-separated file")
        text = text.replace("\t", "")
    text = re.sub(r"\r\n?", "\n", text)
    delimiter = delimiter or likely_delimiter(text)
    rows = [[clean(c) for c in r] for r in csv.reader(io.StringIO(text), delimiter=delimiter)]
    return [r for r in rows if any(r)], delimiter


def table_of_text(text: str) -> tuple[list[list[str]], str]:
    """Read once; if tabs aren't the delimiter but occur, read again without them."""
    rows, delimiter = delimited(text)
    return (rows, delimiter) if delimiter == "\t" or "\t" not in text else delimited(text, strip_tabs=True)


def table_of_html(page: str) -> list[list[str]]:
    known = {"amp", "lt", "gt", "quot", "apos", "nbsp"}
    entity = lambda m: html.unescape(m[0]) if m[1].startswith("#") or m[1].lower() in known else m[0]
    plain = lambda x: clean(re.sub(r"&(#[xX][0-9a-fA-F]+|#\d+|\w+);", entity, re.sub(r"<[^>]*>", " ", re.sub(r"(?i)<br\s*/?>", " ", x))))
    rows = [[plain(c) for c in re.findall(r"(?is)<t[dh]\b[^>]*>(.*?)</t[dh]>", r)] for r in re.findall(r"(?is)<tr\b[^>]*>(.*?)</tr>", page)]
    return [r for r in rows if r]


def find_header(rows: list[list[str]]) -> int:
    best, top = -1, 0
    for i, r in enumerate(rows[:HEADER_ROWS]):
        filled = [c for c in r if c.strip()]
        score = 10 * sum(any(w in c for w in HEADER_KEYWORDS) for c in filled) + len(filled)
        if len(filled) >= 2 and score > top:
            best, top = i, score
    return best


def platform_of(header: list[str]) -> str | None:
    h = {c.strip() for c in header}
    if h & set(ALIPAY_MARKS):
        return "alipay"
    if h & set(WECHAT_MARKS):
        return "wechat"
    if {"交易时间", "收/支"} <= h:
        return "alipay" if h & {"商品说明", "对方账号"} else "wechat" if h & {"商品", "商户单号"} else None
    return None
