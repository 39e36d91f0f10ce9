"""Work that grew faster than the input, or was done several times over: plans and results of the steps that were mended."""

import contextlib
import io

from pyspark.sql import functions as F

from pennybrook import session
from pennybrook.functions import fingerprints
from pennybrook.operators import refunds, transfers
from pennybrook.plans import derived
from pennybrook.session import cut
from pennybrook.sources import containers

SMALL = "/root/testdata/sf0.001"


def plan(df) -> str:
    shown = io.StringIO()
    with contextlib.redirect_stdout(shown):
        df.explain()
    return shown.getvalue()


def test_cut_tables_are_columnar(spark):
    df = spark.createDataFrame([(1, "a", [1]), (2, None, None)], "k int, t string, a array<int>")
    out = cut(df)
    assert out.inputFiles() and out.schema == df.schema
    assert sorted(tuple(r) for r in out.collect()) == [(1, "a", [1]), (2, None, None)]
    assert "ReadSchema: struct<k:int>" in plan(out.select("k"))


def test_delimiters_split_records_once_each(spark):
    texts = ["a,b\nc,d", "a;b;c\nd;e;f", "a|b\n\nc|d", "a\tb\nc\td", "x", "", None, 'a,"b\nc"\nd,e']
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", containers.guess_delimiter(F.col("t")).alias("d"))
    assert [r["d"] for r in df.orderBy("i").collect()] == [",", ";", "|", "\t", ",", ",", ",", ","]
    assert plan(df).count("regexp_extract_all") <= 2 * len(containers.DELIMITERS)


def test_fingerprints_of_a_batch(spark):
    def plain(text: str) -> str:
        h, raw = 0xCBF29CE484222325, text.encode("utf-16-le")
        for i in range(0, len(raw), 2):
            h = ((h ^ int.from_bytes(raw[i : i + 2], "little")) * 0x100000001B3) % 2**64
        return f"{h:016x}"

    texts = ["", None, "a", "\U0001f600午餐", "x" * 500, "ab", None, "v2|ord|1|2|in"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", fingerprints.fnv1a64(F.col("t")).alias("h"))
    assert [r["h"] for r in df.orderBy("i").collect()] == [None if t is None else plain(t) for t in texts]
    assert df.where("i < 0").collect() == [] and "ArrowEvalPython" in plan(df)
    assert [r["h"] for r in spark.createDataFrame([(None,)], "t string").select(fingerprints.fnv1a64(F.col("t")).alias("h")).collect()] == [None]


def test_legs_meet_their_sums_in_few_joins(spark):
    rows = spark.createDataFrame([("out", 7, 0, 1), ("in", 3, 10, 2), ("in", 4, 20, 3), ("out", 8, 0, 4), ("out", 6, 5, 5)], "direction string, amount_minor long, epoch long, seq int")
    got = transfers.feasible(rows, "out", 100, [], 3, 24)
    assert plan(got).count("Join") <= 3
    assert [r["seq"] for r in got.collect()] == [1]  # 6 is twice 3, but a leg counts once


def test_shared_tables_are_made_once(spark):
    legs = cut(derived.leg_rows(spark, SMALL))
    assert "Window" not in plan(transfers.exact_pairs(legs, scope=("account",)))
    assert "MapInArrow" not in plan(refunds.decisions(derived.refund_drafts(spark, SMALL)))


def test_shuffles_widen_with_what_they_read(spark, monkeypatch):
    held = spark.conf.get("spark.sql.shuffle.partitions")
    legs = cut(derived.leg_rows(spark, SMALL))
    assert session.shuffle_tasks(legs) == int(held)
    monkeypatch.setattr(session, "SHARE", 1024)
    assert session.shuffle_tasks(legs) > 20
    assert cut(legs.groupBy("id").count(), legs).count() == legs.select("id").distinct().count()
    assert spark.conf.get("spark.sql.shuffle.partitions") == held
