"""Tables from positioned text: joins and windows against plain Python, on random pages."""

import random
from datetime import datetime

import pytest

from pennybrook import queries
from pennybrook.sources import glyphs

from . import plain_glyphs as plain

SCHEMA = "file int, page int, text string, x double, y double, width double"


def rebuilt(spark, rows):
    out = {}
    for r in sorted(glyphs.read_glyphs(spark.createDataFrame(rows, SCHEMA).repartition(4)).collect(), key=lambda r: (r["file"], r["row"])):
        assert r["row"] == len(out.setdefault(r["file"], []))
        out[r["file"]].append(r["cells"])
    return out


def expected(rows):
    files = {}
    for file, page, text, x, y, width in sorted(rows, key=lambda r: (r[0], r[1], r[2] or "")):
        if text:
            files.setdefault(file, {}).setdefault(page, []).append(plain.Run(text, x or 0.0, y or 0.0, width or 0.0))
    return {f: rows for f, pages in files.items() if (rows := plain.rebuild(pages).rows)}


def test_a_statement_of_two_pages(spark):
    heads = [("交易日期", 40.0), ("金额", 150.0), ("附言", 250.0)]
    runs = [(t, x, 400.0, 36.0) for t, x in heads]
    for k, (day, amount, note) in enumerate([("2026-05-01", "-5.00", "午餐"), ("2026-05-02", "7.00", "----")]):
        y = 380.0 - 18 * k
        runs += [(day, 40.0, y, 50.0), (amount, 150.0, y, 30.0), (note, 250.0, y, 30.0)]
    runs += [("外卖", 250.0, 372.0, 20.0), ("第1页", 40.0, 200.0, 30.0)]
    rows = [(1, p, *r) for p in (1, 2) for r in runs]
    want = [["交易日期", "金额", "附言"], *[["2026-05-01", "-5.00", "午餐外卖"], ["2026-05-02", "7.00", ""]] * 2]
    assert rebuilt(spark, rows) == expected(rows) == {1: want}


def test_random_pages(spark):
    rng = random.Random(6)
    words = ["午餐", "2026-05-01", "12.50", "coffee", "a b", "  wide   text 费用", "----", "—", "合计", "𠮷", "x"]
    heads = ["交易日期", "金额", "附言", "余额", "交易对方"]
    rows = []
    for file in range(60):
        columns = sorted(rng.sample(range(20, 560, 60), rng.randint(1, 5)))
        for page in range(rng.randint(1, 4)):
            y = 800.0
            if rng.random() < 0.6:
                rows += [(file, page, rng.choice(heads), x + rng.random(), y + rng.choice([0, 1.5]), rng.uniform(10, 40)) for x in columns]
            for _ in range(rng.randint(0, 8)):
                y -= rng.choice([18.0, 18.0, 18.5, 8.0, 40.0, 2.0])
                for x in columns:
                    if rng.random() < 0.8:
                        rows.append((file, page, rng.choice(words), x + rng.uniform(-8, 8), y + rng.choice([0, 0, 1.0, -1.25]), rng.choice([0.0, 30.0, 50.0, 200.0, -3.0])))
    rows += [(70, 1, None, 1.0, 1.0, 1.0), (71, 1, "  ", 1.0, 1.0, 1.0), (72, 1, "alone", None, None, None), (73, 5, "", 1.0, 1.0, 1.0)]
    assert rebuilt(spark, rows) == expected(rows)


def test_page_limit(spark):
    rows = [(1, p, f"line {p}", 40.0, 700.0, 30.0) for p in range(250)] + [(2, 0, "交易日期", 40.0, 700.0, 30.0), (2, 0, "金额", 150.0, 700.0, 30.0)]
    got = rebuilt(spark, rows)
    assert len(got[1]) == 200 and got == expected(rows)


def test_query_reads_all_pages_and_files(spark, tmp_path):
    orders = [(k, {0: 5, 1: 6}.get(k % 2) if k < 8400 else None, k + 0.25, datetime(2026, 1, 1 + k % 28)) for k in range(8430)]  # two files of 210 pages
    spark.createDataFrame(orders, "o_orderkey long, o_custkey long, o_totalprice double, o_orderdate timestamp").write.parquet(f"{tmp_path}/orders.parquet")
    want = {f: ["交易日期|金额|附言"] for f in (5, 6, None)}
    for k, file, _, day in orders:
        note = ["午餐", "bus fare", ""][k % 3]
        more = "" if k % 5 or not note else " home" if k % 3 else "外卖"
        want[file].append(f"{day:%Y-%m-%d}|{k}25|{note}{more}" if k else f"{day:%Y-%m-%d}|25|{note}{more}")
    got = {f: {} for f in want}
    for r in queries.queries()["glyph_tables"](spark, str(tmp_path)).collect():
        assert got[r["file"]].setdefault(r["row"], r["cells"]) is r["cells"]
    assert {f: [rows[i] for i in sorted(rows)] for f, rows in got.items()} == want and all(max(rows) == len(rows) - 1 for rows in got.values())


def test_runs_without_file_or_page(spark):
    rows = [(f, p, f"line {f} {p}", 40.0, 700.0, 30.0) for f in (None, 1) for p in (None, 0, 3)]
    got = glyphs.read_glyphs(spark.createDataFrame(rows, SCHEMA)).collect()
    assert {(r["file"], r["row"]): r["cells"] for r in got} == {(f, i): [f"line {f} {p}"] for f in (None, 1) for i, p in enumerate((None, 0, 3))} and len(got) == 6


@pytest.mark.parametrize(("text", "want"), [("abc", 3), ("午餐", 4), ("a午", 3), ("𠮷", 2), ("", 0)])
def test_weight(spark, text, want):
    from pyspark.sql import functions as F

    assert spark.range(1).select(glyphs.weight(F.lit(text))).first()[0] == want == sum((2 if plain.is_cjk(c) else 1) * (2 if ord(c) > 0xFFFF else 1) for c in text)
