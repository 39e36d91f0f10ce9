"""Statements from bytes to outcome, on invented rows."""

import io
import random
import zipfile

import pytest
from pyspark.sql import functions as F

from pennybrook.plans import build, imports, reports
from pennybrook.sources import containers as C
from pennybrook.sources import platforms as P

from . import plain_containers as plain

HEAD = "交易时间,交易分类,交易对方,对方账号,商品说明,收/支,金额,收/付款方式,交易状态,交易订单号,商家订单号"
ROWS = [
    "2026-05-01 08:12:33,餐饮美食,小店,a@x.test,午餐,支出,28.50,余额,交易成功,70001,",
    "2026-05-02 09:00:00,交通出行,车队,b@x.test,打车,支出,45.00,花呗,交易成功,70002,",
    "2026-05-03 10:00:00,转账,某人,c@x.test,转账,不计收支,200.00,余额,交易成功,70003,",
    "2026-05-04 10:00:00,转账,银行,d@x.test,转出到银行卡,不计收支,300.00,余额,交易成功,70004,",
    "2026-05-04 11:00:00,转账,银行,d@x.test,转入,不计收支,300.00,余额,交易成功,70005,",
    "2026-05-05 10:00:00,信用借还,花呗,,花呗还款,不计收支,1500.00,余额,还款成功,70006,",
    "2026-05-06 10:00:00,信用借还,花呗,,分期手续费,支出,12.00,余额,交易成功,70007,",
    "2026-05-07 10:00:00,投资理财,券商,,银证转账,不计收支,5000.00,余额,交易成功,70008,",
    "2026-05-08 10:00:00,购物,商店,,物品,支出,88.00,余额,交易成功,70009,",
    "2026-05-09 10:00:00,退款,商店,,退款-物品,不计收支,88.00,余额,退款成功,70009R001,",
    "2026-05-10 10:00:00,购物,商店,,未付,支出,66.00,余额,交易关闭,70011,",
    "2026-05-11 10:00:00,转账,公司,,工资,收入,12000.00,银行卡,交易成功,70012,",
    "bad,购物,商店,,x,支出,1.00,余额,交易成功,1,",
    "2026-05-12 10:00:00,购物,商店,,x,支出,0.00,余额,交易成功,2,",
    "2026-05-12 10:00:00,购物,商店,,x,怪,1.00,余额,交易成功,3,",
]
CSV = "明细查询\r\n账号:[x@x.test]\n\n" + HEAD + "\n" + "\n".join(ROWS) + "\n"


def grid(spark, data, name="f.csv"):
    files = spark.createDataFrame([(1, name, bytearray(data))], "file int, path string, content binary")
    whole = C.parsed(files)
    return C.grids_of(whole), C.errors_of(whole)


def counts(df, column):
    return {r[0]: r[1] for r in df.groupBy(column).count().collect()}


def test_alipay_pipeline(spark):
    rows, errors = grid(spark, CSV.encode("gbk"))
    assert errors.count() == 0 and rows.select("platform").first()[0] == "alipay"
    drafts, warnings = P.parse_alipay(rows, "acc")
    drafts = drafts.persist()
    assert counts(warnings, "code") == {"unparsable-date": 1, "zero-amount": 1, "unknown-direction-value": 1}
    assert drafts.count() == 12
    out = build.build_transactions(drafts, "b1")
    txs = out.transactions.persist()
    assert counts(txs, "kind") == {"expense": 3, "income": 1, "transfer-internal": 3, "transfer-repayment": 1, "transfer-investment": 1}
    assert counts(out.dropped, "reason") == {"closed-or-failed": 1, "refund-paired": 2}
    assert out.pairs.count() == 1 and out.warnings.count() == 0
    t = reports.totals(txs).first()
    assert (t["expense_minor"], t["income_minor"], t["n"]) == (8550, 1_200_000, 9)
    assert {r[0]: r[1] for r in txs.select("raw_description", "category").collect()}["打车"] == "transport"
    # importing again changes nothing
    again = build.build_transactions(drafts, "b2", existing_records=txs)
    assert (again.transactions.count(), again.updated.count(), again.duplicates.count()) == (0, 0, 9)
    # a correction keeps a category set by hand
    stored = txs.withColumn("amount_minor", F.when(F.col("raw_description") == "午餐", 1).otherwise(F.col("amount_minor"))).withColumns({"category": F.lit("pet"), "category_source": F.lit("user")})
    fixed = build.build_transactions(drafts, "b3", existing_records=stored).updated.collect()
    lunch = [r for r in fixed if r["after"]["raw_description"] == "午餐"]
    assert lunch[0]["after"]["category"] == "pet" and lunch[0]["changes"][0] == "amount ¥0.01 -> ¥28.50"


def test_refunds(spark):
    body = [
        "2026-05-02 12:00:00,餐饮美食,店,a,单,支出,43.19,余额,交易成功,80100,",
        "2026-05-02 12:05:00,退款,店,a,退,不计收支,0.30,余额,退款成功,80100R001,",
        "2026-05-03 10:00:00,交通出行,铁路,a,票,支出,159.50,余额,交易关闭,80200,",
        "2026-05-05 10:00:00,退款,铁路,a,退票,不计收支,159.50,余额,退款成功,80200M001,",
        "2026-05-06 10:00:00,购物,店,a,物,支出,10.00,余额,交易成功,80300,",
        "2026-05-07 10:00:00,退款,店,a,退物,不计收支,12.00,余额,退款成功,80300R001,",
        "2026-05-08 10:00:00,退款,店,a,退外,不计收支,5.00,余额,退款成功,80400,",
    ]
    rows, _ = grid(spark, ("x\n" + HEAD + "\n" + "\n".join(body)).encode())
    out = build.build_transactions(P.parse_alipay(rows, "acc")[0], "b")
    txs = out.transactions.collect()
    assert sorted(t["amount_minor"] for t in txs if t["kind"] == "refund") == [500, 1200, 15950]
    kept = [t for t in txs if t["kind"] == "expense"]
    assert [t["amount_minor"] for t in kept] == [4289] and kept[0]["meta"]["refundNettedMinor"] == "30" and kept[0]["meta"]["statedAmountMinor"] == "4319"
    assert counts(out.warnings, "code") == {"refund-unmatched": 1, "refund-exceeds-purchase": 1}


def test_disclosed_refund_keeps_purchase(spark):
    head = "交易时间,交易类型,交易对方,商品,收/支,金额(元),支付方式,当前状态,交易单号,商户单号,备注"
    body = ['2026-05-01 10:00:00,商户消费,店,物,支出,¥154.00,零钱,已退款(¥9.00),\t1,2,/', '2026-05-02 10:00:00,商户消费,店,物,支出,¥10.00,零钱,已退款(¥6.00),\t3,4,/', '2026-05-03 10:00:00,零钱提现,银行,/,/,¥500.00,银行,提现已到账,\t5,6,服务费 ¥0.50']
    rows, errors = grid(spark, ("标题\n" + head + "\n" + "\n".join(body)).encode())
    assert errors.count() == 0
    drafts, warnings = P.parse_wechat(rows, "w")
    assert warnings.count() == 0
    txs = build.build_transactions(drafts, "b").transactions.collect()
    assert sorted((t["kind"], t["amount_minor"]) for t in txs) == [("expense", 50), ("expense", 400), ("expense", 14500), ("transfer-internal", 49950)]
    strict = build.build_transactions(drafts, "b", strict_netting=True).transactions
    assert ("refund", 400) in [(t["kind"], t["amount_minor"]) for t in strict.collect()]


def test_generic_and_templates(spark):
    text = "交易日期,摘要,对方户名,收入,支出,余额\n2026-05-01,工资,公司,12000.00,,12000.00\n2026-05-02,午餐,店,,28.50,11971.50\n2026-05-03,转账,本人,,500.00,1\n2026-05-04,转账,本人,500.00,,2\n2026-05-05,x,y,1,1,3\n2026-05-06,x,y,-,5,3\n2026-05-07,x,y,0,0,3\n"
    rows, _ = grid(spark, text.encode())
    template = P.pick_template(text.split("\n")[0].split(",") + ["交易状态"])
    assert template.id == "demo-bank@2026-09"
    with pytest.raises(C.ImportProblem):
        P.validate(template, ["交易日期"])
    drafts, warnings = P.parse_generic(rows, template, "bank")
    assert counts(warnings, "code") == {"ambiguous-both-sides": 1, "unparsable-amount": 1}
    out = build.build_transactions(drafts, "b")
    t = reports.totals(out.transactions).first()
    assert (t["income_minor"], t["expense_minor"], t["n"]) == (1_200_000, 2850, 4) and out.pairs.count() == 1


def workbook():
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w") as z:
        z.writestr("[Content_Types].xml", "<Types/>")
        z.writestr("xl/workbook.xml", '<workbook xmlns:r="r"><sheets><sheet name="S" sheetId="1" r:id="rId1"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships><Relationship Id="rId1" Target="worksheets/sheet1.xml"/></Relationships>')
        z.writestr("xl/styles.xml", '<styleSheet><cellXfs><xf numFmtId="0"/><xf numFmtId="22"/></cellXfs></styleSheet>')
        z.writestr("xl/sharedStrings.xml", "<sst><si><t>交易时间</t></si><si><t>金额</t></si></sst>")
        z.writestr("xl/worksheets/sheet1.xml", '<worksheet><sheetData><row r="1"><c r="A1" t="s"><v>0</v></c><c r="B1" t="s"><v>1</v></c></row><row r="2"><c r="A2" s="1"><v>46143.5</v></c><c r="B2"><v>12345678901234567890</v></c></row></sheetData></worksheet>')
    return buffer.getvalue()


def test_containers(spark):
    kinds = {b"": "empty", b"%PDF-1.7": "pdf", bytes.fromhex("D0CF11E0A1B11AE1") + b"x": "ole-xls", workbook(): "zip-ooxml", b"a,b": "text", b"<html><table><tr><td>1</td></tr></table>": "html"}
    df = spark.createDataFrame([(bytearray(k),) for k in kinds], "c binary")
    assert [r[0] for r in df.select(C.sniff(F.col("c"))).collect()] == list(kinds.values()) == [C.kind_of(k) for k in kinds]
    rows, _ = C.table_of_workbook(workbook())
    assert rows == [["交易时间", "金额"], ["2026-05-01 12:00:00", "12345678901234567168"]]
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w") as z:
        z.writestr("readme.txt", "hello")
        z.writestr("__MACOSX/a.csv", "junk")
        z.writestr("out/alipay.csv", CSV)
    got, _ = grid(spark, buffer.getvalue())
    assert (got.first()["platform"], got.first()["header_row"]) == ("alipay", 2)
    assert grid(spark, workbook())[0].where("row = 0").first()["cells"] == ["交易时间", "金额"]
    _, errors = grid(spark, b"just words")
    assert errors.count() == 1
    page = spark.createDataFrame([("<table><tr><th>A&amp;B</th><td>1<br>2</td></tr><tr></tr></table>",)], "h string")
    assert page.select(C.html_rows(F.col("h"))).first()[0] == [["A&B", "1 2"]]


def test_texts_are_parsed_as_plain_python_does(spark):
    rng = random.Random(7)
    bits = ["a", "b c", "1.5", '"', '""', ",", ",", ";", "|", "\t", "\n", "\n", "\r\n", "\r", " ", "é", "交易时间", "金额", "\u00a0", '"x, y"', '"l1\nl2"', "收/支"]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randint(0, 40))) for _ in range(1500)]
    texts += ["a,b\rc,d\r\n\n e ,f", CSV, "a;b;c\n1;2;3\n", "a\tb\n1\t2", "x|y\n1|2", '"open to the end, and\nmore', "", "\n", "one", "a,\tb\n\t1,2", "," * 50, 'q,"' + "long " * 20_000 + '",z\n' * 2, '"' * 5001]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string").repartition(4)
    got = {r["i"]: r["rows"] for r in df.select("i", C.text_rows(F.col("t")).alias("rows")).collect()}
    for i, t in enumerate(texts):
        assert got[i] == plain.table_of_text(t)[0], t[:200]
    heads = {r["i"]: (r["h"], r["p"]) for r in df.select("i", C.text_rows(F.col("t")).alias("rows")).select("i", C.header_row(F.col("rows")).alias("h"), "rows").select("i", "h", C.detect_platform(F.get("rows", F.col("h"))).alias("p")).collect()}
    for i in got:
        h = plain.find_header(got[i])
        assert heads[i] == (h, plain.platform_of(got[i][h]) if h >= 0 else None)


def test_html_tables_are_parsed_as_plain_python_does(spark):
    rng = random.Random(8)
    bits = ["<tr>", "</tr>", "<td>", "</td>", "<th class=x>", "</th>", "x", " &amp; ", "&#65;", "<br>", "<b>y</b>", "&nbsp;", "&unknown;", "\n"]
    pages = ["<table>" + "".join(rng.choice(bits) for _ in range(rng.randint(0, 30))) + "</table>" for _ in range(500)]
    df = spark.createDataFrame(list(enumerate(pages)), "i int, t string")
    got = {r["i"]: r["rows"] for r in df.select("i", C.html_rows(F.col("t")).alias("rows")).collect()}
    assert got == {i: plain.table_of_html(t) for i, t in enumerate(pages)}


def test_folder(spark, tmp_path):
    bank = "交易日期,摘要,对方户名,收入,支出,余额,交易状态\n2026-05-01,工资,公司,12000.00,,12000.00,成功\n2026-05-02,午餐,店,,28.50,11971.50,成功\n"
    wechat = "标题\n交易时间,交易类型,交易对方,商品,收/支,金额(元),支付方式,当前状态,交易单号,商户单号,备注\n2026-05-03 10:00:00,零钱提现,银行,/,/,¥500.00,银行,提现已到账,\t5,6,服务费 ¥0.50\n"
    (tmp_path / "in" / "deep").mkdir(parents=True)
    for name, text in (("a.csv", CSV), ("deep/b.csv", bank), ("c.csv", wechat), ("d.csv", "交易时间,收/支,商品说明\n2026-05-01,支出,x\n"), ("e.csv", "just words"), ("f.csv", "colour,size\nred,3\n"), ("g.pdf", "%PDF-1.7")):
        (tmp_path / "in" / name).write_text(text, encoding="utf-8")
    run = imports.import_folder(spark, f"file://{tmp_path}/in", "acc", "b1")
    assert sorted((r["path"].rpartition("/")[2], r["platform"], r["template"]) for r in run.layouts.where("platform is not null or template is not null").collect() if r["path"][-5] in "abc") == [("a.csv", "alipay", None), ("b.csv", None, "demo-bank@2026-09"), ("c.csv", "wechat", None)]
    assert sorted(r["path"].rpartition("/")[2] for r in run.errors.collect()) == ["d.csv", "e.csv", "f.csv", "g.pdf"]
    assert counts(run.outcome.transactions, "source") == {"alipay": 9, "wechat": 2, "generic:demo-bank@2026-09": 2}
    shown = imports.preview(run)
    assert shown["transactions"].count() == 13 and shown["dropped"].count() == 3 and shown["warnings"].count() == 3 and shown["updated"].count() == 0


def test_printed_totals(spark):
    rows = spark.createDataFrame([(1, "out", 250), (1, "in", 100), (1, "out", 50), (2, "out", 70)], "file int, direction string, amount_minor long")
    printed = spark.createDataFrame([(1, 300, 100), (2, 71, 0), (3, 0, 0)], "file int, printed_debit_minor long, printed_credit_minor long")
    assert sorted((r["file"], r["debit_minor"], r["credit_minor"], r["agrees"]) for r in reports.printed_totals(rows, printed, "file").collect()) == [(1, 300, 100, True), (2, 70, 0, False), (3, 0, 0, True)]


def test_archive_scores_agree(spark):
    names = ["a.csv", "x/alipay.csv", "__MACOSX/a.csv", "._a.csv", "dir/", "支付宝.xlsx", "readme.txt", "微信说明.csv", "note.md", "wechat.PDF", ""]
    df = spark.createDataFrame(list(enumerate(names)), "i int, n string")
    assert {r["i"]: -1 if r["s"] is None else r["s"] for r in df.select("i", C.archive_score(F.col("n")).alias("s")).collect()} == {i: C.entry_score(n) for i, n in enumerate(names)}
