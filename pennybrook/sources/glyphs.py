"""Tables from positioned text: glyph runs (file, page, text, x, y, width) to rows, by geometry alone, as joins, aggregates and windows over the runs of all files at once.

Per page: runs cluster into lines; the line with the most header words gives the columns (or a page before it did); runs are dealt to columns by overlap;
wrapped lines are joined to the row above; what follows a gap of 1.5 row pitches is not the table any more.  The largest group is a page's runs, and a
file's pages where they inherit columns and number their rows.  All pages are read with ``max_pages=None``, as the query does; a caller who says nothing gets a
file's first ``MAX_PAGES``, the source's limit for one document.

Defined cases: runs without text are left out, null positions are 0; runs without a file or a page are a file or a page of their own, before the others; runs of one
place are taken in the order of their text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import CJK, join_text
from ..operators.lexicon import HEADER_KEYWORDS
from ..session import cut
from . import containers

# fixed values: geometry in points
ROW_TOLERANCE, COLUMN_GAP, MIN_HEADER_WORDS, TABLE_GAP, MAX_PAGES = 3.0, 12.0, 2, 1.5, 200

BLANK = r"\s\x1c-\x1f\x85\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
PAGE = ["file", "page"]


def strip(c: Column) -> Column:
    return F.regexp_replace(c, f"^[{BLANK}]+|[{BLANK}]+$", "")


def lines_of(runs: DataFrame, tolerance: float = ROW_TOLERANCE) -> DataFrame:
    """Runs with their visual line, counted from the top, and its baseline, that of its first run: a page's distinct heights are walked from the top."""
    heights = runs.groupBy(*PAGE).agg(F.sort_array(F.collect_set("y"), asc=False).alias("ys"))
    anchors = F.aggregate("ys", F.array().cast("array<double>"), lambda a, y: F.when((F.size(a) == 0) | (F.element_at(a, -1) - y > tolerance), F.concat(a, F.array(y))).otherwise(a))
    out = runs.join(heights.select(*PAGE, anchors.alias("anchors")), PAGE).withColumn("line", F.size(F.filter("anchors", lambda a: a >= F.col("y"))) - 1)
    return out.withColumn("line_y", F.get("anchors", F.col("line"))).drop("anchors")


def in_order(*columns: str) -> Column:
    """Runs of a group from the left, as structs of x, -y and text, and what is named besides."""
    return F.sort_array(F.collect_list(F.struct("x", (-F.col("y")).alias("up"), "text", *columns)))


def header_lines(runs: DataFrame) -> DataFrame:
    """(file, page, header): the line with the most header words, the topmost of equals, if it has enough of them."""
    lines = runs.groupBy(*PAGE, "line").agg(F.array_join(in_order()["text"], " ").alias("whole"))
    hits = sum((F.col("whole").contains(w).cast("int") for w in HEADER_KEYWORDS), F.lit(0))
    return lines.withColumn("hits", hits).where(F.col("hits") >= MIN_HEADER_WORDS).groupBy(*PAGE).agg(F.max_by("line", F.struct("hits", -F.col("line"))).alias("header"))


def spans_of(runs: DataFrame, headers: DataFrame, gap: float = COLUMN_GAP) -> DataFrame:
    """(file, page, spans): a partition of the page at the middles between header cells, where there are two cells or more."""
    line = runs.join(headers, PAGE).where("line = header").withColumn("right", F.col("x") + F.greatest("width", F.lit(0.0)))
    order = Window.partitionBy(*PAGE).orderBy("x", "right")
    before = F.max("right").over(order.rowsBetween(Window.unboundedPreceding, -1))
    line = line.withColumn("new", F.when(F.col("x") - before <= gap, 0).otherwise(1)).withColumn("cell", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    cells = line.groupBy(*PAGE, "cell").agg(F.min("x").alias("x"), F.max("right").alias("right")).groupBy(*PAGE).agg(F.sort_array(F.collect_list(F.struct("cell", "x", "right"))).alias("c")).where("size(c) > 1")
    cuts = F.expr("transform(sequence(1, size(c) - 1), i -> (c[i - 1].right + c[i].x) / 2)")
    ends = lambda v: F.array(F.lit(v).cast("double"))
    return cells.withColumn("cuts", cuts).select(*PAGE, F.arrays_zip(F.concat(ends("-inf"), "cuts").alias("lo"), F.concat("cuts", ends("inf")).alias("hi")).alias("spans"))


def overlap(x: Column, width: Column, span: Column) -> Column:
    return F.least(x + F.greatest(width, F.lit(0.0)), span["hi"]) - F.greatest(x, span["lo"])


def column_of(x: Column, width: Column, spans: Column) -> Column:
    """The number of the column that a run overlaps most, the leftmost on ties."""
    return -F.array_max(F.transform(spans, lambda s, i: F.struct(overlap(x, width, s).alias("o"), (-i).alias("i"))))["i"]


def weight(c: Column) -> Column:
    """Width of a text in characters: those of CJK, and those beyond the basic plane, count double."""
    return F.length(c) + F.length(F.regexp_replace(c, f"[^{CJK[1:-1]}\\x{{10000}}-\\x{{10ffff}}]", ""))


def split_runs(runs: DataFrame) -> DataFrame:
    """A run across several columns cut at its blanks, with ``col``; a word's place and width follow from its characters."""
    word = F.regexp_extract_all("text", F.lit(f"[{BLANK}]*[^{BLANK}]+"), F.lit(0))
    wide = (F.col("width") > 0) & (F.size("words") > 1) & (F.size(F.filter("spans", lambda s: overlap(F.col("x"), F.col("width"), s) > 0)) > 1)
    lead = lambda w: F.regexp_extract(w, f"^[{BLANK}]*", 0)

    def place(w: Column, i: Column) -> Column:
        before = F.concat(F.array_join(F.slice("words", F.lit(1), i), ""), lead(w))
        return F.struct(strip(w).alias("text"), (F.col("x") + weight(before) * F.col("unit")).alias("x"), (weight(strip(w)) * F.col("unit")).alias("width"))

    whole = F.array(F.struct(F.col("text"), F.col("x"), F.col("width")))
    parts = runs.withColumn("words", word).withColumn("unit", F.col("width") / weight(F.col("text"))).withColumn("p", F.explode(F.when(wide, F.transform("words", place)).otherwise(whole)))
    return parts.drop("text", "x", "width", "words", "unit").select("*", "p.*").drop("p").withColumn("col", column_of(F.col("x"), F.col("width"), F.col("spans")))


def joined(pieces: Column) -> Column:
    return F.aggregate(pieces, F.lit(""), lambda a, t: join_text(a, t))


def cells_of(runs: DataFrame) -> DataFrame:
    """(file, page, line, line_y, cells) of runs with line and spans; dashes alone stand for nothing."""
    placed = split_runs(runs).withColumn("text", strip(F.col("text")))
    cells = placed.groupBy(*PAGE, "line", "line_y", "col").agg(joined(in_order()["text"]).alias("text"), F.first(F.size("spans")).alias("n"))
    shown = strip(F.col("text"))
    cells = cells.withColumn("text", F.when(shown.rlike("^[-\u2010-\u2015\u2212]+$"), "").otherwise(shown))
    lines = cells.groupBy(*PAGE, "line", "line_y").agg(F.map_from_entries(F.collect_list(F.struct("col", "text"))).alias("m"), F.first("n").alias("n"))
    return lines.select(*PAGE, "line", "line_y", F.expr("transform(sequence(0, n - 1), i -> coalesce(try_element_at(m, i), ''))").alias("cells"))


def pitch(lines: DataFrame, *page: str) -> DataFrame:
    """(page, pitch): the median gap between row-like lines (page, y, rowlike)."""
    gap = F.lag("y").over(Window.partitionBy(*page).orderBy(F.desc("y"))) - F.col("y")
    return lines.where("rowlike").withColumn("gap", gap).groupBy(*page).agg(F.median("gap").alias("pitch"))


def rows_by_columns(lines: DataFrame) -> DataFrame:
    """(file, page, at, cells): lines from the header on, up to the first wide gap, wrapped ones joined to the row above."""
    rowlike = (F.col("cells")[0] != "") & (F.size(F.filter("cells", lambda c: c != "")) >= 2)
    lines = cut(lines.withColumnRenamed("line_y", "y").withColumn("rowlike", rowlike))
    page, order = Window.partitionBy(*PAGE), Window.partitionBy(*PAGE).orderBy("line")
    lines = lines.join(pitch(lines, *PAGE), PAGE, "left").withColumns({"nth": F.row_number().over(order), "gap": F.lag("y").over(order) - F.col("y")})
    far = F.min(F.when(F.col("gap") > TABLE_GAP * F.col("pitch"), F.col("nth"))).over(page)
    lines = lines.withColumn("far", far).where("far is null or far < 3 or nth < far")  # a gap right below the header says nothing
    starts = (F.col("cells")[0] != "") | (F.col("nth") == 1)
    lines = lines.withColumn("at", F.sum(starts.cast("int")).over(order.rowsBetween(Window.unboundedPreceding, 0))).where(starts | F.col("pitch").isNull() | (F.col("gap") < F.col("pitch")))
    rows = lines.groupBy(*PAGE, "at").agg(F.sort_array(F.collect_list(F.struct("line", "cells")))["cells"].alias("parts"))
    return rows.select(*PAGE, "at", F.aggregate(F.slice("parts", F.lit(2), F.size("parts")), F.col("parts")[0], lambda a, b: F.zip_with(a, b, join_text)).alias("cells"))


def rows_by_gaps(runs: DataFrame, gap: float = COLUMN_GAP) -> DataFrame:
    """(file, page, at, cells): a row for each line, cut where a run begins more than a gap after the one before it ends."""
    order = Window.partitionBy(*PAGE, "line").orderBy("x", F.desc("y"), "text")
    new = F.when(F.col("x") - F.lag(F.col("x") + F.greatest("width", F.lit(0.0))).over(order) <= gap, 0).otherwise(1)
    runs = runs.withColumn("new", new).withColumn("cell", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    cells = runs.groupBy(*PAGE, "line", "cell").agg(strip(joined(in_order()["text"])).alias("text"))
    rows = cells.groupBy(*PAGE, "line").agg(F.sort_array(F.collect_list(F.struct("cell", "text")))["text"].alias("cells"))
    return rows.where(F.exists("cells", lambda c: c != "")).select(*PAGE, F.col("line").alias("at"), "cells")


def without_repeated_headers(grid: DataFrame) -> DataFrame:
    """A grid (file, row, cells) without the rows that repeat its header row, numbered anew."""
    same = lambda a: F.transform(a, lambda c: strip(c))
    grid = grid.join(containers.detect_header(grid), "file", "left").where(F.col("header").isNull() | (F.col("row") == F.col("header_row")) | (same(F.col("cells")) != same(F.col("header"))))
    return grid.select("file", (F.row_number().over(Window.partitionBy("file").orderBy("row")) - 1).alias("row"), "cells")


def read_glyphs(glyphs: DataFrame, max_pages: int | None = MAX_PAGES) -> DataFrame:
    """(file, row, cells) from (file, page, text, x, y, width); of a file's first ``max_pages`` pages, or of all with None."""
    at = {c: F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in ("x", "y", "width")}
    keys = [F.struct(c).alias(c) for c in PAGE]  # joins drop null keys, but not structs of them
    runs = cut(glyphs.where("text <> ''").select(*keys, "text", *[v.alias(c) for c, v in at.items()]))  # pages, runs and places each read them
    pages = runs.select(*PAGE).distinct()
    if max_pages is not None:
        pages = pages.withColumn("nth", F.row_number().over(Window.partitionBy("file").orderBy("page"))).where(F.col("nth") <= max_pages).drop("nth")
        runs = runs.join(pages, PAGE, "left_semi")
    runs = cut(lines_of(runs.where(strip(F.col("text")) != "")))
    headers = header_lines(runs)
    own = pages.join(headers, PAGE, "left").join(spans_of(runs, headers), PAGE, "left")
    # a page without columns of its own has those of the last page before it that has some
    held = cut(own).withColumn("spans", F.last("spans", ignorenulls=True).over(Window.partitionBy("file").orderBy("page")))
    placed = runs.join(held, PAGE)
    band = placed.where(F.col("spans").isNotNull() & (F.col("line") >= F.coalesce("header", F.lit(0))))
    rows = rows_by_columns(cells_of(band)).unionByName(rows_by_gaps(placed.where("spans is null")))
    grid = rows.select("file", (F.row_number().over(Window.partitionBy("file").orderBy("page", "at")) - 1).alias("row"), "cells")
    return without_repeated_headers(cut(grid)).select("file.file", "row", "cells")


def modal_width(grid: DataFrame) -> DataFrame:
    """(file, width, ratio): the commonest number of cells and its share."""
    n = grid.groupBy("file", F.size("cells").alias("width")).agg(F.count(F.lit(1)).alias("c"), F.min("row").alias("at"))
    return n.groupBy("file").agg(F.max_by("width", F.struct("c", -F.col("at"))).alias("width"), (F.max("c") / F.sum("c")).alias("ratio"))
