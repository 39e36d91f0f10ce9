"""Greedy pairings through Spark against plain loops over all rows."""

import itertools
import random
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from pennybrook.operators import refunds, transfers
from pennybrook.schema import DRAFT, TRANSACTION


def plain_subset(amounts, total, most):
    def go(start, left, chosen):
        if left == 0 and len(chosen) >= 2:
            return chosen
        if len(chosen) == most:
            return None
        for i in range(start, len(amounts)):
            if amounts[i] <= left and (got := go(i + 1, left - amounts[i], [*chosen, i])):
                return got
        return None

    return go(0, total, [])


def test_first_subset():
    rng = random.Random(2)
    for _ in range(500):
        amounts = [rng.randint(1, 9) for _ in range(rng.randint(0, 9))]
        total, most = rng.randint(1, 25), rng.randint(2, 4)
        assert transfers.first_subset(amounts, total, most) == plain_subset(amounts, total, most)


def plain_pairs(rows, window, most, pool):
    """Every out takes the nearest free in of its amount; then rows left over are settled by two or more of the other side."""
    rows = sorted(rows, key=lambda r: (r["epoch"], r["row"]))
    used, found = set(), []
    for o in (r for r in rows if r["direction"] == "out"):
        near = [(abs(o["epoch"] - i["epoch"]), k, i["id"]) for k, i in enumerate(rows) if i["direction"] == "in" and i["id"] not in used and i["amount"] == o["amount"] and abs(o["epoch"] - i["epoch"]) <= window]
        if near:
            used |= {o["id"], min(near)[2]}
            found.append(((o["id"],), (min(near)[2],), o["amount"], "exact"))
    for side, other in (("out", "in"), ("in", "out")):
        for r in (r for r in rows if r["direction"] == side):
            near = [x for x in rows if x["direction"] == other and x["id"] not in used and abs(x["epoch"] - r["epoch"]) <= window][:pool]
            if r["id"] not in used and (got := plain_subset([x["amount"] for x in near], r["amount"], most)):
                ids = tuple(near[i]["id"] for i in got)
                used |= {r["id"], *ids}
                found.append((((r["id"],), ids) if side == "out" else (ids, (r["id"],))) + (r["amount"], "grouped"))
    return found


def as_transactions(spark, rows):
    start = datetime(2026, 1, 1, tzinfo=timezone.utc)
    data = [(r["id"], r["direction"], r["amount"], start + timedelta(seconds=r["epoch"]), r.get("account"), r["row"]) for r in rows]
    df = spark.createDataFrame(data, "id string, direction string, amount_minor long, occurred_at timestamp, account string, row int").repartition(5)
    made = {"kind": F.lit("transfer-internal"), "raw_description": F.lit("x")}
    return df.select("account", F.struct(F.lit(0).alias("file"), "row", F.lit(0).alias("part")).alias("seq"), *[made.get(f.name, F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in TRANSACTION.fields if f.name != "seq"])


def found(pairs):
    return sorted((tuple(r["out_ids"]), tuple(r["in_ids"]), r["amount_minor"], r["mode"]) for r in pairs.collect())


def test_transfer_pairs(spark):
    rng = random.Random(3)
    data, want = [], []
    for account in ("a", "b"):
        rows = []
        for i in range(220):
            rows.append({"id": f"{account}{i}", "direction": rng.choice(["out", "in"]), "amount": rng.choice([5, 10, 15, 20, 35]), "epoch": rng.randint(0, 400) * 21_600, "row": i, "account": account})
        want += plain_pairs(rows, 3 * 86_400, 3, 24)
        data += rows
    got = found(transfers.pair_transfers(as_transactions(spark, data), scope=["account"]))
    assert got == sorted(want) and {w[3] for w in want} == {"exact", "grouped"} and max(len(w[0]) + len(w[1]) for w in want) == 4


@pytest.mark.parametrize(("slab", "seed", "dense"), [(2, 1, 3600), (2, 2, 43_200), (3, 3, 9_000)])
def test_one_busy_ledger_without_a_scope(spark, slab, seed, dense):
    """An amount that half of the legs share, over many windows without a gap: slabs give what one pass gives."""
    rng = random.Random(seed)
    rows = [{"id": f"x{i}", "direction": "out" if rng.random() < 0.55 else "in", "amount": 500 if rng.random() < 0.5 else rng.randint(1, 60) * 25, "epoch": i * dense + rng.randint(0, dense), "row": i} for i in range(500)]
    rows += [{"id": f"far{i}", "direction": ("out", "in")[i % 2], "amount": 75, "epoch": 10**8 + i, "row": 1000 + i} for i in range(2)]
    want = plain_pairs(rows, 3 * 86_400, 3, 24)
    got = found(transfers.pair_transfers(as_transactions(spark, rows), slab=slab))
    assert got == sorted(want) and sum(w[3] == "grouped" for w in want) > 5


def test_slabs_that_assumed_wrong_are_done_again(spark):
    """A chain in which every decision depends on the one before: what a slab assumes of the one before it is wrong, and it is done again until all agree."""
    rows, w = [], 3 * 86_400
    for i in range(40):  # each out could take the in before it or, were that used, the one after it, a little further away
        rows += [{"id": f"o{i}", "direction": "out", "amount": 9, "epoch": i * w, "row": 2 * i}, {"id": f"i{i}", "direction": "in", "amount": 9, "epoch": i * w + w // 2 + 1, "row": 2 * i + 1}]
    rows.append({"id": "first", "direction": "out", "amount": 9, "epoch": -w // 2, "row": 999})
    rows.append({"id": "i-1", "direction": "in", "amount": 9, "epoch": -w // 2 + 1, "row": 1000})
    want = plain_pairs(rows, w, 3, 24)
    assert found(transfers.pair_transfers(as_transactions(spark, rows), slab=2)) == sorted(want)
    del rows[-1]
    other = plain_pairs(rows, w, 3, 24)
    assert found(transfers.pair_transfers(as_transactions(spark, rows), slab=2)) == sorted(other) != sorted(want)


def test_feasible_is_what_subsets_say(spark):
    rng = random.Random(8)
    rows = [{"id": f"f{i}", "direction": rng.choice(["out", "in"]), "amount": rng.randint(0, 40), "epoch": rng.randint(0, 60) * 43_200, "row": i} for i in range(90)]
    legs = transfers.legs(as_transactions(spark, rows))
    for most, pool in ((2, 24), (3, 24), (4, 24), (3, 5)):
        got = {r["seq"]["row"] for r in transfers.feasible(legs, "out", 3 * 86_400, [], most, pool).collect()}
        for r in (r for r in rows if r["direction"] == "out"):
            near = [x["amount"] for x in rows if x["direction"] == "in" and abs(x["epoch"] - r["epoch"]) <= 3 * 86_400]
            sums = {sum(c) for n in range(2, most + 1) for c in itertools.combinations(near, n)}
            assert r["amount"] not in sums or r["row"] in got  # none is missed
            assert pool < 24 or r["amount"] in sums or r["row"] not in got or len(near) > 12


def test_candidate_edges(spark):
    rng = random.Random(4)
    rows = [(str(i), rng.choice(["out", "in"]), rng.choice([5, 6]), rng.randint(-900_000, 900_000)) for i in range(150)]
    df = spark.createDataFrame(rows, "id string, direction string, amount_minor long, epoch long")
    want = sorted((o[2], o[0], i[0], abs(o[3] - i[3])) for o in rows for i in rows if o[1] == "out" and i[1] == "in" and o[2] == i[2] and abs(o[3] - i[3]) <= 3 * 86_400)
    assert sorted(tuple(r) for r in transfers.candidate_edges(df).collect()) == want


def test_refunds_with_several_purchases_a_root(spark):
    rng = random.Random(5)
    rows = []
    for i in range(240):
        root = rng.choice(["7001", "70012", "800", "9005", "90051"])
        back = rng.random() < 0.5
        rows.append((i, root + (rng.choice(["", "R1", "5R002", "2"]) if back else ""), back, rng.randint(1, 6) * 10))
    # each refund takes from the first purchase in order that has something left and whose id begins the refund's
    left, want = {i: m for i, _, back, m in rows if not back}, []
    for i, order, back, minor in rows:
        if back:
            at = next((j for j, o, b, _ in rows if not b and j in left and order.startswith(o)), None)
            if at is None:
                want.append((i, "unmatched", 0, None))
                continue
            over = minor - left[at]
            want.append((i, "paired" if not over else "partial" if over < 0 else "exceeds", minor, at))
            if over < 0:
                left[at] -= minor
            else:
                del left[at]
    data = [(i, o, m, "退款成功" if b else "交易成功", "in" if b else "out") for i, o, b, m in rows]
    df = spark.createDataFrame(data, "row int, order_id string, amount_minor long, status string, direction string").repartition(4)
    seq = F.struct(F.lit(0).alias("file"), "row", F.lit(0).alias("part"))
    drafts = df.select(*[(seq if f.name == "seq" else F.lit("x") if f.name == "description" else F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in DRAFT.fields])
    got = [(r["seq"]["row"], r["what"], r["minor"], r["other"] and r["other"]["row"]) for r in refunds.decisions(drafts).collect()]
    assert sorted(got, key=str) == sorted(want, key=str) and {w[1] for w in want} == {"paired", "partial", "exceeds", "unmatched"}


@pytest.mark.parametrize("scope", [[], ["account"]])
def test_nested_prefixes(spark, scope):
    rng = random.Random(9)
    ids = lambda n: [("".join(rng.choice("12é") for _ in range(rng.randint(0, 7))), rng.choice(["a", "b", None])) for _ in range(n)] + [(None, "a")]
    longer, shorter = ids(300), ids(60)
    frame = lambda rows: spark.createDataFrame(rows, "order_id string, account string").repartition(6)
    want = {(s, x, p) if scope else (x, p) for x, s in longer for p, t in shorter if x and p and x.startswith(p) and (not scope or s == t)}
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = [tuple(r) for r in refunds.nested_prefixes(frame(longer), frame(shorter), scope).collect()]
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert set(got) == want and len(got) == len(want)
