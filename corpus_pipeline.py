"""A corpus pipeline: language ID, line dedup, SimHash near-dedup, benchmark decontamination, best-fit packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read again as the next one's docs.  All but the last
return the columns of ``documents``; n_chars follows the text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pennybrook.llm import decontaminate, langid, lines, packing, simhash
from pennybrook.llm.common import materialize, table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language the model knows stay; those without text or without a letter go.  ``lang`` is the predicted language where none is given."""
    docs = docs.select(*COLUMNS)
    model = langid.train(docs.where(~langid.held_out(2, 4)))
    return langid.annotate(docs, model).where(F.col("lang_pred") != langid.UND).withColumn("lang", F.coalesce("lang", "lang_pred")).select(*COLUMNS)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of equal or similar lines one stays; documents left without a line go.  Rows with a null doc_id keep all their lines."""
    out = lines.dedup(docs.select(*COLUMNS))
    return out.where("n_lines > n_removed").withColumn("n_chars", F.char_length("text").cast("long")).select(*COLUMNS)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each SimHash component stays, that of the smallest doc_id.  Rows are numbered, so a null doc_id (last in order) or a repeated one is a document like any other."""
    rows = materialize(docs.select(*COLUMNS).withColumn("row", F.monotonically_increasing_id()), "pipeline-rows")
    found = simhash.near_duplicates(rows.select(F.col("row").alias("doc_id"), "text")).select(F.col("doc_id").alias("row"), "component_id")
    order = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "row")
    kept = rows.select("row", "doc_id").join(found, "row").groupBy("component_id").agg(F.min(order).alias("first")).select("first.row")
    return rows.join(kept, "row", "left_semi").select(*COLUMNS)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of a benchmark item go.  Rows are told apart by id and text, so a null or repeated doc_id is a document like any other."""
    found = decontaminate.find(docs, table(spark, sf_dir, "benchmark")).where("contaminated").select(F.col("doc_id").alias("id"), F.col("key").alias("at")).distinct()
    keyed = docs.select(*COLUMNS).withColumn("key", F.xxhash64("text"))
    return keyed.join(found, F.expr("key = at AND doc_id <=> id"), "left_anti").select(*COLUMNS)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents that are left, packed into sequences of 2048 tokens; null ids and repeated rows are documents like any other."""
    return packing.pack(docs)


STAGES = [
    ("language_id", language_id),
    ("line_dedup", line_dedup),
    ("simhash_near_dedup", near_dedup),
    ("benchmark_decontamination", decontamination),
    ("best_fit_packing", best_fit_packing),
]

#: SQL can't express the learned, MinHash and packing stages. tests/llm/test_pipeline.py holds run() against plain-Python stages on a small fixture.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
