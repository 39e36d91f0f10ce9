"""Greedy work in time order, cut into parts that many tasks do at once, with the same result as one pass over all rows.

A greedy rule takes its targets in time order and uses up rows at most a window away, so what it does at a time depends on earlier decisions only
through the rows used up within a window of it.  Rows are cut in two steps:

* islands: times are put in bins as wide as the window.  An empty bin is a gap that no decision crosses.  Bins are counted by an aggregate, so no
  task ever sorts the rows of a key to find the gaps.
* slabs: a long island is cut every ``SLAB`` bins.  Each slab is worked on at once, starting a slab earlier from nothing used.  Where the rows
  used around its own start are those that the slab before it really leaves, its decisions are right; a slab for which they differ is done again from the state that
  the slab before it left, and so on until all agree.  Decisions seldom depend on what happened a whole slab earlier, so a round or two
  do; at the worst, each round settles one more slab of an island.

A part is one task's work and memory: the rows of at most two slabs and three windows.
"""

from __future__ import annotations

import itertools
from collections.abc import Callable, Iterable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from ..session import cut

#: Bins (of one window each) in a slab; at least 2.
SLAB = 8

#: (rows in time order, first target's epoch, end of targets' epochs, ids used before) -> (target's epoch, out ids, in ids, amount) in time order
Kernel = Callable[[list[dict], int, int, set], list[tuple[int, list[str], list[str], int]]]


def with_islands(rows: DataFrame, keys: Sequence[str], window: int) -> DataFrame:
    """``rows`` with bin, island (its first bin), last_bin, and the island's n_out and n_in."""
    rows = rows.withColumn("bin", F.floor(F.col("epoch") / window))
    bins = rows.groupBy(*keys, "bin").agg(F.count_if(F.col("direction") == "out").alias("n_out"), F.count_if(F.col("direction") == "in").alias("n_in"))
    order = Window.partitionBy(*keys).orderBy("bin")
    starts = F.coalesce(F.col("bin") - F.lag("bin").over(order) > 1, F.lit(True))
    bins = bins.withColumn("_start", F.when(starts, F.col("bin"))).withColumn("island", F.last("_start", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    sums = bins.groupBy(*keys, "island").agg(F.max("bin").alias("last_bin"), F.sum("n_out").alias("n_out"), F.sum("n_in").alias("n_in"))
    return rows.join(bins.select(*keys, "bin", "island").join(sums, [*keys, "island"]), [*keys, "bin"])


def _parts(rows: Iterable[dict], names: Sequence[str]) -> Iterator[tuple[tuple, list[dict]]]:
    for key, group in itertools.groupby(rows, key=lambda r: tuple(r[n] for n in names)):
        yield key, list(group)


def over_parts(df: DataFrame, names: Sequence[str], work: Callable[[tuple, list[dict]], Iterable[dict]], schema: StructType) -> DataFrame:
    """Rows that ``work`` makes of each part: a part is held in memory, a partition's parts are streamed."""
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = []
        for key, rows in _parts((r for b in batches for r in b.to_pylist()), names):
            out.extend(work(key, rows))
            if len(out) >= 4096:
                yield pa.RecordBatch.from_pylist(out, schema=arrow)
                out = []
        if out:
            yield pa.RecordBatch.from_pylist(out, schema=arrow)

    order = [*names, F.asc_nulls_first("epoch"), "seq"]
    return df.repartition(*names).sortWithinPartitions(*order).mapInArrow(run, schema)


def in_time_order(rows: DataFrame, keys: Sequence[str], window: int, kernel: Kernel, slab: int = SLAB) -> DataFrame:
    """(keys, out_ids, in_ids, amount_minor): what the kernel decides.  ``rows`` (of ``with_islands``) has keys, id, direction, amount_minor, epoch, seq, bin, island and last_bin."""
    keys, length = list(keys), slab * window
    at = F.floor((F.col("bin") - F.col("island")) / slab)
    rows = rows.withColumns({"_at": at, "_last": F.floor((F.col("last_bin") - F.col("island")) / slab), "_offset": F.col("epoch") - (F.col("island") + at * slab) * window})
    # a slab's work needs the slab before it whole, a window more on that side and one on the other
    near = F.array_compact(
        F.array(
            F.col("_at"),
            F.when(F.col("_at") < F.col("_last"), F.col("_at") + 1),
            F.when((F.col("_at") + 1 < F.col("_last")) & (F.col("_offset") >= length - window), F.col("_at") + 2),
            F.when((F.col("_at") > 0) & (F.col("_offset") < window), F.col("_at") - 1),
        )
    )
    names = [*keys, "island", "slab"]
    columns = [c for c in ("_last", "id", "direction", "amount_minor", "epoch", "seq") if c not in keys]
    dealt = rows.select(*keys, "island", *columns, F.lit(None).cast("array<string>").alias("given"), F.explode(near).alias("slab"))
    schema = StructType([*[dealt.schema[k] for k in names], *StructType.fromDDL("what string, out_ids array<string>, in_ids array<string>, minor long").fields])

    def work(key: tuple, part: list[dict]) -> Iterable[dict]:
        given = part.pop(0)["given"] if part[0]["epoch"] is None else None
        island, number = key[-2:]
        start = (island + number * slab) * window
        first = start if given is not None or number == 0 else start - length
        found = kernel(part, first, start + length, set(given or ()))

        def row(what: str, outs: list[str], ins: list[str] | None = None, amount: int | None = None) -> dict:
            return dict(zip(names, key)) | {"what": what, "out_ids": outs, "in_ids": ins, "minor": amount}

        def state(time: int) -> list[str]:
            used = {x for t, outs, ins, _ in found if t < time for x in (*outs, *ins)} | set(given or ())
            return sorted({r["id"] for r in part if time - window <= r["epoch"] < time + window and r["id"] in used})

        for t, outs, ins, amount in found:
            if t >= start:
                yield row("pair", outs, ins, amount)
        last = part[0]["_last"] if part else 0
        if number:
            yield row("begin", state(start) if given is None else sorted(given))
        if number < last:
            yield row("end", state(start + length))

    done = cut(over_parts(dealt, names, work, schema))
    while True:
        begin = done.where("what = 'begin'").select(*names, F.col("out_ids").alias("begin"))
        end = done.where("what = 'end'").select(*keys, "island", (F.col("slab") + 1).alias("slab"), F.col("out_ids").alias("given"))
        wrong = cut(begin.join(end, names).where("not (begin <=> given)").select(*names, "given"))
        if wrong.isEmpty():
            break
        marks = wrong.select(*names, "given", *[F.lit(None).cast(dealt.schema[c].dataType).alias(c) for c in columns])
        again = dealt.join(wrong.select(*names), names, "left_semi").unionByName(marks)
        done = cut(done.join(wrong.select(*names), names, "left_anti").unionByName(over_parts(again, names, work, schema)))
    return done.where("what = 'pair'").select(*[k for k in keys if k != "amount_minor"], "out_ids", "in_ids", F.col("minor").alias("amount_minor"))
