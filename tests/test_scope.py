"""Many imports at once, each within its scope, against one import at a time."""

import random
from datetime import datetime, timedelta, timezone

from pyspark.sql import functions as F

from pennybrook.plans import build
from pennybrook.schema import DRAFT


def drafts_of(spark, rng, accounts, n):
    start, rows = datetime(2026, 1, 1, tzinfo=timezone.utc), []
    for account in accounts:
        for i in range(n):
            amount = rng.choice([500, 1000, 1500, 2500])
            order = rng.choice([None, "", f"70{rng.randint(0, 40)}", f"70{rng.randint(0, 40)}R1"])
            back = bool(order) and order.endswith("R1")
            what = rng.choice(["转账", "转出到银行卡", "午餐美团", "工资", "花呗还款"])
            status = "退款成功" if back else rng.choice(["交易成功"] * 6 + ["交易关闭", "已退款(¥3.00)"])
            rows.append((account, i, rng.choice(["in", "out"]), amount, start + timedelta(hours=rng.randint(0, 400)), what, order, status))
        rows += [(account, n + k, *rows[-1 - k][2:]) for k in range(6)]  # the same rows twice
    df = spark.createDataFrame(rows, "account_id string, row int, direction string, amount_minor long, occurred_at timestamp, description string, order_id string, status string").repartition(5)
    made = {"seq": F.struct(F.lit(0).alias("file"), "row", F.lit(0).alias("part")), "source": F.lit("s"), "currency": F.lit("CNY"), "counterparty": F.lit("shop"), "tx_type": F.when(F.col("description").startswith("转"), "转账"), "excluded_from_cashflow": F.col("description").startswith("转")}
    return df.select(*[made.get(f.name, F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in DRAFT.fields])


def shown(out, account=None):
    """Rows of all outputs; of an import without a scope, under the account that it was made for."""
    key = lambda r: account if account is not None else r["account_id"]
    return {
        "transactions": sorted((key(r), r["seq"]["row"], r["kind"], r["amount_minor"], r["category"] or "") for r in out.transactions.collect()),
        "duplicates": sorted((key(r), r["seq"]["row"], r["fingerprint"]) for r in out.duplicates.collect()),
        "dropped": sorted((key(r), r["seq"]["row"], r["reason"]) for r in out.dropped.collect()),
        "pairs": sorted((key(r), sorted(r["out_ids"]), sorted(r["in_ids"]), r["amount_minor"], r["mode"]) for r in out.pairs.collect()),
        "warnings": sorted((key(r), r["seq"]["row"], r["code"]) for r in out.warnings.collect()),
    }


def test_scoped_imports_are_what_single_ones_are(spark):
    accounts = ["a", "b", "c"]
    drafts = drafts_of(spark, random.Random(21), accounts, 50)
    drafts.persist()
    got = shown(build.build_transactions(drafts, "b1", scope=("account_id",)))
    want = {k: [] for k in got}
    for account in accounts:
        for k, v in shown(build.build_transactions(drafts.where(F.col("account_id") == account), "b1"), account).items():
            want[k] += v
    assert got == {k: sorted(v) for k, v in want.items()}
    assert all(got.values()) and {r[2] for r in got["dropped"]} >= {"closed-or-failed", "duplicate", "refund-paired"}
