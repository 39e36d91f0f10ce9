"""From a folder of statements of any supported shape to one outcome."""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from dataclasses import dataclass
from itertools import accumulate

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import categories
from ..operators.reconcile import Known
from ..session import cut
from ..sources import containers, platforms
from . import build, reports


@dataclass
class ImportRun:
    outcome: build.Outcome
    errors: DataFrame  # file, path, message: files that no parser took
    warnings: DataFrame  # file, code, row
    layouts: DataFrame  # file, path, platform, template


def numbered_paths(found: DataFrame) -> DataFrame:
    """(path, file): paths numbered from 1 in their order, by a range-partitioned sort and the counts of its partitions."""
    dealt = cut(found.select("path").repartitionByRange("path").sortWithinPartitions("path").select("path", F.monotonically_increasing_id().alias("at")))
    part, place = F.shiftright("at", 33), F.col("at").bitwiseAND(F.lit((1 << 33) - 1))
    counts = dealt.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("c")).orderBy("part").collect()  # a row for each partition
    starts = dealt.sparkSession.createDataFrame([(r["part"], s) for r, s in zip(counts, [0, *accumulate(r["c"] for r in counts)])], "part long, start long")
    return dealt.withColumn("part", part).join(F.broadcast(starts), "part").select("path", (F.col("start") + place + 1).cast("int").alias("file"))


def import_folder(spark: SparkSession, path: str, account_id: str, batch_id: str, saved: Iterable[platforms.Template] = (), rules: Iterable[categories.Rule] | None = None, existing_records: Known = None, existing_fingerprints: Known = None, scope: Sequence[str] = ()) -> ImportRun:
    """Files are numbered by path; each goes to the parser of its platform, else to the first template (saved ones first) whose columns its header has.

    Layouts are decided once for each different header, not for each file: the distinct headers of a folder (a few kinds of statement, however many
    files) come to the driver.  A file whose header lacks what its platform's parser needs, or that fits no template, is an error and gives no rows.
    ``scope`` is that of ``build_transactions``.
    """
    found = containers.read_files(spark, path)
    numbers = numbered_paths(found)
    files = found.join(numbers, "path")
    whole = cut(containers.parsed(files.select("file", "path", "content")))  # each file is read and parsed once
    grids, errors = containers.grids_of(whole), containers.errors_of(whole)
    heads = grids.where("row = header_row").select("file", "platform", F.transform("cells", lambda c: F.trim(c)).alias("header"))
    templates = {t.id: t for t in platforms.merge_templates(list(saved))}
    chosen = []
    for row in heads.select("platform", "header").distinct().collect():
        template, problem = None, None
        try:
            if row["platform"] is not None:
                platforms.check_platform_header(row["header"], row["platform"])
            else:
                template = platforms.pick_template(row["header"], templates.values())
                problem = None if template else "no template has the columns of this header: " + " | ".join(row["header"])
        except containers.ImportProblem as e:
            problem = str(e)
        chosen.append((row["platform"], row["header"], template.id if template else None, problem))
    layouts = spark.createDataFrame(chosen, "platform string, header array<string>, template string, problem string")
    each = cut(heads.join(layouts, heads["header"].eqNullSafe(layouts["header"]) & heads["platform"].eqNullSafe(layouts["platform"])).select("file", heads["platform"], "template", "problem").join(numbers, "file"))
    headless = grids.select("file").distinct().join(heads.select("file"), "file", "left_anti").join(numbers, "file").select("file", "path", F.lit("no header row found").alias("message"))
    errors = errors.unionByName(each.where("problem is not null").select("file", "path", F.col("problem").alias("message"))).unionByName(headless)

    def rows_of(which: Column) -> DataFrame:
        return grids.join(each.where(which & F.col("problem").isNull()).select("file"), "file", "left_semi")

    used = {(p, t) for p, _, t, problem in chosen if problem is None}
    parsed = [platforms.parse(rows_of(F.col("platform") == p), p, account_id) for p in sorted({p for p, _ in used if p})]
    parsed += [platforms.parse(rows_of(F.col("template") == t), None, account_id, templates[t]) for t in sorted({t for _, t in used if t})]
    if not parsed:
        parsed = [platforms.parse(grids.limit(0), platforms.ALIPAY, account_id)]
    drafts, warnings = parsed[0]
    for more, said in parsed[1:]:
        drafts, warnings = drafts.unionByName(more), warnings.unionByName(said)
    outcome = build.build_transactions(drafts, batch_id, rules, existing_records=existing_records, existing_fingerprints=existing_fingerprints, scope=scope)
    return ImportRun(outcome, errors, warnings, each.select("file", "path", "platform", "template"))


def preview(run: ImportRun) -> dict[str, DataFrame]:
    """What a user sees before saving: the newest rows, and the first warnings, corrections and dropped rows, each up to its limit."""
    return {
        "transactions": reports.newest(run.outcome.transactions, reports.PREVIEW_LIMIT),
        "warnings": run.warnings.orderBy("file", "row", "code").limit(reports.WARNING_LIMIT),
        "updated": run.outcome.updated.orderBy("fingerprint").limit(reports.UPDATE_LIMIT),
        "dropped": run.outcome.dropped.orderBy("seq", "reason").limit(reports.DROP_LIMIT),
    }
