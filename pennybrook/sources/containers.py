"""Files to grids: containers by magic bytes, archives, delimited text, HTML tables and workbooks.

A grid is (file, row, cells): ragged rows in file order.  Files are read by Spark as (path, content).  A small Python step opens what only bytes can tell
(archives, workbooks, encodings); delimiters, records, cells, header rows and platforms are column expressions over the texts.
A file that can't be read becomes a row of the error output, never a failed job.
"""

from __future__ import annotations

import datetime as dt
import io
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import cell_text, let, trim_cell
from ..operators.lexicon import HEADER_KEYWORDS

# fixed values: signatures, limits and preferences
MAGIC = {"pdf": b"%PDF", "ole-xls": bytes.fromhex("D0CF11E0A1B11AE1"), "zip": b"PK\x03\x04", "zip-empty": b"PK\x05\x06"}
OOXML_MARK, OOXML_PROBE, HTML_PROBE = b"[Content_Types].xml", 8192, 4096
HEADER_ROWS, DELIMITER_LINES, MAX_ARCHIVE_ENTRIES = 40, 20, 500
PREFERRED = ("csv", "xlsx", "xls", "txt", "tsv", "pdf")
ALIPAY_MARKS, WECHAT_MARKS = ("交易分类", "收/付款方式"), ("交易类型", "当前状态", "支付方式")


class ImportProblem(Exception):
    """A file that is refused, with the reason."""


# ---- column forms, for tables of (path, content)


def sniff(content: Column) -> Column:
    """empty, pdf, ole-xls, zip-ooxml, zip, html or text, by the first bytes."""
    head = F.hex(F.substring(content, 1, 8))
    probe = F.decode(F.substring(content, 1, OOXML_PROBE), "ISO-8859-1")
    low = F.lower(F.decode(F.substring(content, 1, HTML_PROBE * 4), "ISO-8859-1"))
    table = F.substring(low, 1, HTML_PROBE).rlike(r"<table[\s>]") | (low.rlike(r"^(?:ï»¿)?\s*<(!doctype|html)") & F.substring(low, 1, HTML_PROBE).rlike(r"</t[dh]>"))
    is_zip = head.startswith(MAGIC["zip"].hex().upper()) | head.startswith(MAGIC["zip-empty"].hex().upper())
    return (
        F.when(F.coalesce(F.octet_length(content), F.lit(0)) == 0, "empty")
        .when(head.startswith(MAGIC["pdf"].hex().upper()), "pdf")
        .when(head == MAGIC["ole-xls"].hex().upper(), "ole-xls")
        .when(is_zip & probe.contains(OOXML_MARK.decode()), "zip-ooxml")
        .when(is_zip, "zip")
        .when(table, "html")
        .otherwise("text")
    )


def decode_text(content: Column) -> Column:
    """UTF-8 if valid, else GBK (needs spark.sql.legacy.javaCharsets), without a byte order mark."""
    s = F.when(F.is_valid_utf8(content.cast("string")), F.decode(content, "UTF-8")).otherwise(F.decode(content, "GBK"))
    return F.regexp_replace(s, "^\\ufeff", "")


#: In the order in which ties are decided.
DELIMITERS = (",", "\t", "|", ";")


def _field(d: str) -> str:
    """A field up to a delimiter or line end: quoted (quotes inside doubled, line ends kept, what follows the closing quote kept too) or not."""
    return rf'(?:"[^"]*+(?:""[^"]*+)*+(?:"[^{d}\n]*+)?|[^{d}\n]*+)'


def records(text: Column, d: str) -> Column:
    """The records of a text with line ends \\n, each with the cells as they stand there."""
    e = "\\|" if d == "|" else d
    whole = F.regexp_extract_all(text, F.lit(rf"({_field(d)}(?:{e}{_field(d)})*+)(?:\n|\z)"), F.lit(1))
    # a delimiter before each cell, so that an empty one isn't an empty match
    return F.transform(F.filter(whole, lambda r: r != ""), lambda r: F.regexp_extract_all(F.concat(F.lit(d), r), F.lit(rf"{e}({_field(d)})"), F.lit(1)))


def unquoted(cell: Column) -> Column:
    body = F.regexp_extract(cell, r'^"([^"]*+(?:""[^"]*+)*+)"?', 1)
    rest = F.regexp_extract(cell, r'^"[^"]*+(?:""[^"]*+)*+"([\s\S]*)$', 1)
    return trim_cell(F.when(cell.startswith('"'), F.concat(F.replace(body, F.lit('""'), F.lit('"')), rest)).otherwise(cell))


def guess_delimiter(text: Column) -> Column:
    """The delimiter whose number of fields varies least, for its mean, over the first lines, with two fields a line or more."""
    first = F.array_join(F.slice(F.filter(F.split(text, "\n"), lambda x: trim_cell(x) != ""), 1, DELIMITER_LINES), "\n")

    def spread(lines: Column, d: str) -> Column:
        # each sum by one fold, bound before it is used: written out at each use, the records would be found a dozen times over
        sums = F.aggregate(records(lines, d), F.struct(*[F.lit(0).cast("long").alias(x) for x in ("n", "total", "squares")]), lambda a, r: F.struct((a["n"] + 1).alias("n"), (a["total"] + F.size(r)).alias("total"), (a["squares"] + F.size(r).cast("long") * F.size(r)).alias("squares")))
        # of whole numbers, so equal spreads are equal
        return let(sums, lambda a: F.when((a["n"] > 0) & (a["total"] > 1.99 * a["n"]), (a["n"] * a["squares"] - a["total"] * a["total"]) / (a["n"] * a["total"])))

    def least(spreads: Column) -> Column:
        # get, as element_at takes the element of a null place for one that can't be null
        return F.coalesce(F.get(F.array(*[F.lit(d) for d in DELIMITERS]), (F.nullif(F.array_position(spreads, F.array_min(spreads)), F.lit(0)) - 1).cast("int")), F.lit(","))

    return let(let(first, lambda lines: F.array(*[spread(lines, d) for d in DELIMITERS])), least)


def text_rows(text: Column) -> Column:
    """The rows of a delimited text: blank ones vanish, cells are trimmed.  Tabs that aren't the delimiter are no part of a cell."""

    def told(t: Column) -> Column:
        return F.struct(t.alias("t"), guess_delimiter(t).alias("d"))

    def once_more(x: Column) -> Column:
        return F.when((x["d"] == "\t") | ~x["t"].contains("\t"), x).otherwise(told(F.translate(x["t"], "\t", "")))

    def rows(x: Column) -> Column:
        out = None
        for d in DELIMITERS:
            found = records(x["t"], d)
            out = F.when(x["d"] == d, found) if out is None else out.when(x["d"] == d, found)
        return out

    cells = let(let(told(F.regexp_replace(text, r"\r\n?", "\n")), once_more), rows)
    return F.filter(F.transform(cells, lambda r: F.transform(r, unquoted)), lambda r: F.exists(r, lambda c: c != ""))


def html_rows(page: Column) -> Column:
    """The rows of an HTML table, each an array of cell texts, in regular expressions the JVM runs."""
    rows = F.regexp_extract_all(page, F.lit(r"(?is)<tr\b[^>]*>(.*?)</tr>"), F.lit(1))
    cells = F.transform(rows, lambda r: F.regexp_extract_all(r, F.lit(r"(?is)<t[dh]\b[^>]*>(.*?)</t[dh]>"), F.lit(1)))
    return F.transform(F.filter(cells, lambda r: F.size(r) > 0), lambda r: F.transform(r, cell_text))


def header_score(cells: Column) -> Column:
    """Ten for each cell with a header word, one for each that isn't blank; null under two filled cells."""
    words = lambda filled: F.filter(filled, lambda c: c.rlike("|".join(re.escape(w) for w in HEADER_KEYWORDS)))
    return let(F.filter(cells, lambda c: F.trim(c) != ""), lambda filled: F.when(F.size(filled) >= 2, F.size(words(filled)) * 10 + F.size(filled)))


def header_row(rows: Column) -> Column:
    """The number of the best-scoring of the first rows, the first on ties; -1 if none scores."""
    scores = F.transform(F.slice(rows, 1, HEADER_ROWS), header_score)
    return let(scores, lambda s: F.coalesce(F.array_position(s, F.array_max(s)), F.lit(0)) - 1).cast("int")


def detect_header(grid: DataFrame) -> DataFrame:
    """(file, header_row, header): the best-scoring of each file's first rows, the first on ties."""
    scored = grid.where(F.col("row") < HEADER_ROWS).withColumn("score", header_score(F.col("cells"))).where("score is not null")
    return scored.groupBy("file").agg(F.max_by(F.struct("row", "cells"), F.struct("score", -F.col("row"))).alias("h")).select("file", F.col("h.row").alias("header_row"), F.col("h.cells").alias("header"))


def header_named(grid: DataFrame, name: str) -> DataFrame:
    """(file, header_row, header): each file's first row with a cell that is exactly ``name``."""
    hit = grid.where(F.array_contains("cells", name))
    return hit.groupBy("file").agg(F.min_by(F.struct("row", "cells"), "row").alias("h")).select("file", F.col("h.row").alias("header_row"), F.col("h.cells").alias("header"))


def cell(header: Column, cells: Column, name: str | Column) -> Column:
    """The cell under a header name: the first column of that name, '' where the row is short or there is none."""
    at = F.array_position(header, F.lit(name) if isinstance(name, str) else name)
    return F.coalesce(F.when(at > 0, F.get(cells, (at - 1).cast("int"))), F.lit(""))


def detect_platform(header: Column) -> Column:
    h = F.transform(header, lambda c: F.trim(c))
    has = lambda *names: F.arrays_overlap(h, F.array(*[F.lit(n) for n in names]))
    skeleton = has("交易时间") & has("收/支")
    return F.when(has(*ALIPAY_MARKS), "alipay").when(has(*WECHAT_MARKS), "wechat").when(skeleton & has("商品说明", "对方账号"), "alipay").when(skeleton & has("商品", "商户单号"), "wechat")


def archive_score(name: Column) -> Column:
    """How likely an archive's entry is the statement; null for what is never one."""
    base = F.lower(F.element_at(F.split(name, "/"), -1))
    junk = name.startswith("__MACOSX/") | base.startswith("._") | name.endswith("/") | (base == "")
    place = F.array_position(F.array(*[F.lit(x) for x in PREFERRED]), F.regexp_extract(F.lower(name), r"\.([^.]*)$", 1))
    bonus = sum((F.when(base.contains(a) | base.contains(b), v).otherwise(0) for a, b, v in (("alipay", "支付宝", 5), ("wechat", "微信", 5), ("readme", "说明", -4))), F.lit(0))
    return F.when(~junk & (place > 0), (len(PREFERRED) + 1 - place) * 10 + bonus)


# ---- one file at a time, in Python


def kind_of(data: bytes) -> str:
    if not data:
        return "empty"
    for name in ("pdf", "ole-xls"):
        if data.startswith(MAGIC[name]):
            return name
    if data.startswith((MAGIC["zip"], MAGIC["zip-empty"])):
        return "zip-ooxml" if OOXML_MARK in data[:OOXML_PROBE] else "zip"
    head = text_of(data)[0][:HTML_PROBE].lower()
    return "html" if re.search(r"<table[\s>]", head) or re.match(r"\s*<(!doctype|html)", head) and re.search(r"</t[dh]>", head) else "text"


def text_of(data: bytes) -> tuple[str, str]:
    try:
        return data.decode("utf-8").removeprefix("\ufeff"), "utf-8"
    except UnicodeDecodeError:
        return data.decode("gb18030", "replace").removeprefix("\ufeff"), "gbk"


def excel_wall_clock(serial: float, date1904: bool = False) -> str:
    """A date serial as printed: the time only when it isn't midnight."""
    at = (dt.datetime(1904, 1, 1) if date1904 else dt.datetime(1899, 12, 30)) + dt.timedelta(seconds=round(serial * 86_400))
    return at.strftime("%Y-%m-%d %H:%M:%S" if (at.hour, at.minute, at.second) != (0, 0, 0) else "%Y-%m-%d")


def number_text(value: str) -> str:
    x = float(value)
    return str(int(x)) if x.is_integer() and abs(x) < 1e21 else repr(x)


def table_of_workbook(data: bytes, sheet: int = 0) -> tuple[list[list[str]], list[str]]:
    """(rows, sheet names) of one sheet, the first if there is no such one; cells as text, not trimmed."""
    local = lambda e: e.tag.rpartition("}")[2]
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        names = set(z.namelist())
        tree = lambda name: ElementTree.fromstring(z.read(name)) if name in names else None
        book, rels = tree("xl/workbook.xml"), tree("xl/_rels/workbook.xml.rels")
        if book is None:
            raise ImportProblem("the workbook contains no sheets")
        target = {r.get("Id"): r.get("Target") for r in rels} if rels is not None else {}
        sheets = [(e.get("name"), next((v for k, v in e.attrib.items() if k.endswith("}id")), None)) for e in book.iter() if local(e) == "sheet"]
        if not sheets:
            raise ImportProblem("the workbook contains no sheets")
        date1904 = any(local(e) == "workbookPr" and e.get("date1904") in ("1", "true") for e in book.iter())
        shared, styles = tree("xl/sharedStrings.xml"), tree("xl/styles.xml")
        strings = ["".join(t.text or "" for t in si.iter() if local(t) == "t") for si in shared if local(si) == "si"] if shared is not None else []
        dated: list[bool] = []
        if styles is not None:
            formats = {e.get("numFmtId"): e.get("formatCode", "") for e in styles.iter() if local(e) == "numFmt"}
            for group in (e for e in styles if local(e) == "cellXfs"):
                for xf in group:
                    code = xf.get("numFmtId", "0")
                    pattern = re.sub(r'"[^"]*"|\[[^\]]*\]|\\.', "", formats.get(code, ""))
                    dated.append(code.isdigit() and (14 <= int(code) <= 22 or 45 <= int(code) <= 47) or bool(re.search(r"[ymdhs]", pattern, re.I)))
        name, rid = sheets[sheet] if 0 <= sheet < len(sheets) else sheets[0]
        path = (target.get(rid) or f"worksheets/sheet{sheets.index((name, rid)) + 1}.xml").lstrip("/")
        root = tree(path if path.startswith("xl/") else f"xl/{path}")
        rows: list[list[str]] = []
        for r in (e for e in root.iter() if local(e) == "row"):
            at = int(r.get("r", len(rows) + 1))
            rows += [[] for _ in range(at - 1 - len(rows))]
            cells: list[str] = []
            for c in (e for e in r if local(e) == "c"):
                letters = re.match(r"[A-Z]+", c.get("r", ""))
                col = 0
                for ch in letters[0] if letters else "":
                    col = col * 26 + ord(ch) - 64
                cells += [""] * max(0, (col or len(cells) + 1) - 1 - len(cells))
                kind, v = c.get("t", "n"), next((e.text or "" for e in c if local(e) == "v"), "")
                if kind == "s":
                    v = strings[int(v)] if v else ""
                elif kind == "inlineStr":
                    v = "".join(t.text or "" for t in c.iter() if local(t) == "t")
                elif kind == "b":
                    v = "true" if v == "1" else "false"
                elif kind == "n" and v:
                    style = int(c.get("s", "0"))
                    v = excel_wall_clock(float(v), date1904) if style < len(dated) and dated[style] else number_text(v)
                cells.append(v)
            rows.append(cells)
    width = max(map(len, rows), default=0)
    return [r + [""] * (width - len(r)) for r in rows], [n for n, _ in sheets]


def entry_score(name: str) -> int:
    base = name.split("/")[-1].lower()
    ext = name.rpartition(".")[2].lower() if "." in name else ""
    if name.startswith("__MACOSX/") or base.startswith("._") or name.endswith("/") or not base or ext not in PREFERRED:
        return -1
    return (len(PREFERRED) - PREFERRED.index(ext)) * 10 + 5 * ("alipay" in base or "支付宝" in base) + 5 * ("wechat" in base or "微信" in base) - 4 * ("readme" in base or "说明" in base)


def unwrap(data: bytes) -> tuple[str, bytes]:
    """(name, bytes) of an archive's likeliest statement."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        names = z.namelist()
        if len(names) > MAX_ARCHIVE_ENTRIES:
            raise ImportProblem(f"archive contains {len(names)} entries, more than the {MAX_ARCHIVE_ENTRIES} allowed")
        best = max(names, key=lambda n: (entry_score(n), -names.index(n)), default="")
        if not best or entry_score(best) < 0:
            raise ImportProblem("archive holds no statement")
        return best, z.read(best)


OPENED = "file int, path string, container string, text string, rows array<array<string>>, message string"


def opened(data: bytes, name: str = "") -> tuple[str, str | None, list[list[str]] | None]:
    """(container, text or None, rows or None): archives unwrapped, workbooks read, bytes decoded.  PDF bytes are refused: their glyph runs are a source of their own."""
    kind = kind_of(data)
    if kind == "zip":
        name, data = unwrap(data)
        kind = kind_of(data)
        if kind in ("zip", "empty"):
            raise ImportProblem("archive holds no statement")
    if kind == "empty":
        raise ImportProblem("file is empty")
    if kind == "ole-xls":
        raise ImportProblem("legacy workbooks can't be read; save the file as xlsx or csv")
    if kind == "pdf":
        raise ImportProblem("positioned text must be extracted first; see sources.glyphs")
    return (kind, None, table_of_workbook(data)[0]) if kind == "zip-ooxml" else (kind, text_of(data)[0], None)


def open_files(files: DataFrame) -> DataFrame:
    """``OPENED`` rows of (file, path, content), one a file: what only bytes can tell."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            out = []
            for file, path, data in zip(part["file"], part["path"], part["content"]):
                try:
                    out.append((file, path, *opened(bytes(data) if data is not None else b"", path or ""), None))
                except (ImportProblem, zipfile.BadZipFile, ElementTree.ParseError, KeyError, ValueError) as problem:
                    out.append((file, path, None, None, None, str(problem)))
            yield pd.DataFrame(out, columns=["file", "path", "container", "text", "rows", "message"])

    return files.select("file", "path", "content").mapInPandas(run, OPENED)


def read_files(spark: SparkSession, path: str, recursive: bool = True) -> DataFrame:
    """(path, content) of the files below a folder."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).load(path).select("path", "content")


def parsed(files: DataFrame) -> DataFrame:
    """(file, path, row, cells, header_row, platform, container, message) of (file, path, content): the rows of each file, or one row with what is wrong with it.

    Bytes are opened a file at a time; delimiters, records, cells, header rows and platforms are expressions over the texts.
    """
    files = open_files(files)
    rows = F.when(F.col("container") == "html", html_rows(F.col("text"))).when(F.col("container") == "text", text_rows(F.col("text"))).otherwise(F.col("rows"))
    files = files.select("file", "path", "container", "message", let(rows, lambda r: F.struct(r.alias("rows"), header_row(r).alias("header_row"))).alias("t"))
    # what follows reads the parsed rows, so they are computed once below this
    files = files.select("file", "path", "container", "message", "t.rows", "t.header_row")
    shown = F.array_join(F.transform(F.slice("rows", 1, 3), lambda r: F.array_join(r, " | ")), " / ")
    problem = F.when((F.col("container") == "html") & (F.size("rows") == 0), "no table rows in the page").when((F.col("container") == "text") & (F.col("header_row") < 0), F.concat(F.lit("no header row found; first rows: "), shown))
    files = files.withColumn("message", F.coalesce("message", problem)).withColumn("platform", detect_platform(F.get("rows", F.col("header_row"))))
    row = F.posexplode_outer(F.when(F.col("message").isNull(), F.col("rows"))).alias("row", "cells")
    out = files.select("file", "path", row, "header_row", "platform", "container", "message")
    return out.where("cells is not null or message is not null").select("file", "path", "row", "cells", "header_row", "platform", "container", "message")


def grids_of(whole: DataFrame) -> DataFrame:
    """(file, row, cells, header_row, platform, container) of what ``parsed`` gives."""
    return whole.where("message is null").select("file", "row", "cells", "header_row", "platform", "container")


def errors_of(whole: DataFrame) -> DataFrame:
    """(file, path, message) of the files that no parser took."""
    return whole.where("message is not null").select("file", "path", "message")
