"""Scan of files or texts for personal data and for what looks like a statement."""

from __future__ import annotations

import os
import subprocess

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# fixed values: what is looked for and where not
RESIDENT_ID = r"(?<!\d)\d{17}[\dXx](?!\d)"
CARD_NUMBER = r"(?<![\d.])\d{16,19}(?![\d.])"
DATED = r"20\d{2}\s*[-/年]\s*\d{1,2}\s*[-/月]\s*\d{1,2}"
AMOUNT = r"\d+\.\d{2}"
STATEMENT_ROWS = 3
FORBIDDEN = ("csv", "tsv", "txt", "xls", "xlsx", "zip", "pdf", "eml", "enc", "jsonl", "sqlite", "db")
CODE = ("ts", "tsx", "js", "jsx", "mjs", "cjs", "css")
MAX_BYTES, BINARY_PROBE = 5 * 1024 * 1024, 8000


def statement_lines(text: Column) -> Column:
    """How many lines hold a date and an amount."""
    return F.size(F.filter(F.split(text, r"\r?\n"), lambda x: x.rlike(DATED) & x.rlike(AMOUNT)))


def masked(found: Column) -> Column:
    return F.concat(F.substring(found, 1, 6), F.repeat(F.lit("*"), F.greatest(F.length(found) - 6, F.lit(0))))


def scan_texts(df: DataFrame, key: str, text: str = "text") -> DataFrame:
    """(key, rule, detail) for each text with personal numbers or three statement-like lines: a projection, no shuffle."""
    t = F.coalesce(F.col(text), F.lit(""))
    hit = lambda pattern: F.regexp_extract(t, f"({pattern})", 1)
    rules = [F.when(hit(p) != "", F.struct(F.lit(name).alias("rule"), masked(hit(p)).alias("detail"))) for name, p in (("resident-id", RESIDENT_ID), ("card-number", CARD_NUMBER))]
    n = statement_lines(t)
    rules.append(F.when(n >= STATEMENT_ROWS, F.struct(F.lit("statement-like").alias("rule"), n.cast("string").alias("detail"))))
    return df.select(key, F.explode(F.filter(F.array(*rules), lambda r: r.isNotNull())).alias("r")).select(key, "r.rule", "r.detail")


def scan_files(files: DataFrame, allowed: str = r"^$", skipped: str = r"^$") -> DataFrame:
    """(path, rule, detail) over (path, content): forbidden kinds of file, then what texts of at most 5 MiB hold."""
    ext = F.lower(F.regexp_extract("path", r"\.([^./]*)$", 1))
    f = files.where(~F.col("path").rlike(skipped)).withColumns({"ext": ext, "ok": F.col("path").rlike(allowed)})
    banned = f.where(F.col("ext").isin(*FORBIDDEN) & ~F.col("ok")).select("path", F.lit("forbidden-extension").alias("rule"), F.col("ext").alias("detail"))
    binary = F.hex(F.substring("content", 1, BINARY_PROBE)).rlike("^(..)*?00")
    rest = f.where((~F.col("ext").isin(*FORBIDDEN) | F.col("ok")) & (F.octet_length("content") <= MAX_BYTES) & ~binary).withColumn("text", F.decode("content", "UTF-8"))
    found = scan_texts(rest.select("path", "text", "ext", "ok"), "path").join(rest.select("path", F.col("ok"), F.col("ext")), "path")
    return banned.unionByName(found.where("rule <> 'statement-like' or not ok").where((F.col("rule") != "statement-like") | ~F.col("ext").isin(*CODE)).select("path", "rule", "detail"))


def git_listing(spark: SparkSession, root: str) -> DataFrame | None:
    """(path) of the files that git tracks or has staged below a local folder, each once; None where it is no repository.  Ignored files are in neither list."""
    lists = []
    for args in (["diff", "--cached", "--name-only", "-z"], ["ls-files", "-z"]):
        got = subprocess.run(["git", "-C", root, *args], capture_output=True, check=False)
        if got.returncode == 0:
            lists.append(spark.createDataFrame([(x,) for x in got.stdout.decode("utf-8", "surrogateescape").split("\0") if x], "path string"))
    if not lists:
        return None
    return (lists[0].unionByName(lists[1]) if len(lists) > 1 else lists[0]).distinct()


def guarded_files(spark: SparkSession, root: str) -> DataFrame:
    """(path, content) of what a guard looks at below a local folder, paths relative to it: git's own view if there is one, else all files."""
    root = os.path.realpath(root)
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(f"file://{root}").select(F.expr(f"substring(regexp_replace(path, '^file:/+', '/'), {len(root) + 2})").alias("path"), "content")
    named = git_listing(spark, root)
    return files if named is None else files.join(named, "path", "left_semi")
