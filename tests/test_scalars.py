from pyspark.sql import functions as F

from pennybrook.functions import dates, fingerprints, money, text
from pennybrook.functions.text import nfkc_native


def column(spark, values, kind, f):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, x {kind}")
    return [r[0] for r in rows.select(f(F.col("x")).alias("y"), "i").orderBy("i").collect()]


def test_money(spark):
    cases = {"28.50": 2850, "¥1,234.50": 123450, "￥12": 1200, "１２３．４５": 12345, "(12.30)": -1230, "-5": -500, "+5": 500, "(-5)": 500, "1.005": 101, "1.115": 112, "0.999": 100, ".5": 50, "5.": 500, "1e5": 1500, "": None, "-": None, "/": None, "—": None, "abc": None, "1-2": None, "1.2.3": None, ".": None, "90071992547409.91": 9007199254740991, "90071992547409.92": None, "99999999999999999999": None, "1 234.5 元": 123450, "0": 0}
    assert column(spark, list(cases), "string", money.parse_minor) == list(cases.values())
    assert column(spark, list(cases), "string", lambda c: money.parse_minor(c, fold=nfkc_native)) == list(cases.values())
    assert column(spark, [None], "string", money.parse_minor) == [None]
    assert column(spark, [2850, -5, 123456789, 0], "bigint", money.format_minor) == ["¥28.50", "-¥0.05", "¥1,234,567.89", "¥0.00"]
    assert column(spark, [2850, -5, 0], "bigint", money.decimal_string) == ["28.50", "-0.05", "0.00"]
    assert spark.range(0).agg(money.sum_minor("id")).first()[0] == 0


def test_dates(spark):
    cases = {"2026-09-01 08:12:33": "2026-09-01 00:12:33", "2026/9/1": "2026-08-31 16:00:00", "2026年09月01日 10:00": "2026-09-01 02:00:00", "20260901": "2026-08-31 16:00:00", "20260901235959": "2026-09-01 15:59:59", "2026-02-31": None, "": None, "x": None, "2026-13-01": None, "2026-09-01 25:00": None, "2026-09-01T00:00:00Z": "2026-09-01 00:00:00", "1990-07-01 00:00:00": "1990-06-30 16:00:00"}
    got = column(spark, list(cases), "string", lambda c: F.date_format(dates.to_instant(c), "yyyy-MM-dd HH:mm:ss"))
    assert got == list(cases.values())
    assert column(spark, [119, 120, -1], "bigint", dates.bucket_seconds) == [0, 120, -120]
    at = F.to_timestamp(F.lit("2026-08-31 16:30:00"))
    assert spark.range(1).select(dates.local_month(at), dates.local_text(at), F.date_format(dates.local_day_start(at), "yyyy-MM-dd HH")).first()[:] == ("2026-09", "2026-09-01 00:30", "2026-08-31 16")
    assert spark.range(1).select(dates.combine_date_time(F.lit("2026-01-01"), F.lit("10:00")), dates.combine_date_time(F.lit("2026-01-01 09:00"), F.lit("10:00"))).first()[:] == ("2026-01-01 10:00", "2026-01-01 09:00")


def fnv(s):
    h, data = 14695981039346656037, s.encode("utf-16-be")
    for i in range(0, len(data), 2):
        h = ((h ^ int.from_bytes(data[i : i + 2], "big")) * 1099511628211) % 2**64
    return f"{h:016x}"


def test_fingerprint(spark):
    words = ["hello", "v2|ord|2026090100001|2850|out", "示例餐厅", "😀a", ""]
    assert column(spark, words, "string", fingerprints.fnv1a64) == [fnv(w) for w in words]
    assert fnv("hello") == "a430d84680aabd0b" and fnv(words[1]) == "ce3ccc5ec70d5ad2"


def test_text(spark):
    assert column(spark, [" a　", None, "　x"], "string", text.trim_cell) == ["a", "", "x"]
    assert column(spark, ["a&amp;b &#65; &#x4e2d; &bogus; &amp;lt;", "x"], "string", text.decode_entities) == ["a&b A 中 &bogus; &lt;", "x"]
    assert column(spark, ["Ｆｏｏ （Bar）", None], "string", text.normalize_counterparty) == ["foobar", ""]
    pairs = spark.createDataFrame([("中", "国"), ("ab", "cd"), ("", "x")], "a string, b string")
    assert [r[0] for r in pairs.select(text.join_text(F.col("a"), F.col("b"))).collect()] == ["中国", "ab cd", "x"]
