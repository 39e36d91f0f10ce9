import os
import random
import re

import pytest
from pyspark.sql import functions as F

from pennybrook.operators import guard, reconcile, transfers
from pennybrook.plans import reports
from pennybrook.schema import BATCH, TRANSACTION
from pennybrook.sources import key_index, snapshot
from pennybrook.sources import store as store_module
from pennybrook.sources.store import Conflict, LedgerStore, UniqueViolation


def tx(spark, rows):
    base = spark.createDataFrame(rows, "id string, fingerprint string, amount_minor long, imported_batch_id string, at string").withColumn("occurred_at", F.to_timestamp("at"))
    return base.select(*[(F.col(f.name) if f.name in base.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in TRANSACTION.fields])


def batch(spark, name):
    return spark.createDataFrame([(name,)], "id string").select(*[(F.col("id") if f.name == "id" else F.lit(None)).cast(f.dataType).alias(f.name) for f in BATCH.fields])


def test_store(spark, tmp_path):
    store = LedgerStore(spark, f"file://{tmp_path}/ledger")
    store.save_import(batch(spark, "b1"), tx(spark, [("1", "f1", 5, "b1", "2026-05-01"), ("2", "f2", 6, "b1", "2026-06-01")]))
    store.save_import(batch(spark, "b2"), tx(spark, [("2", "f2", 7, "b2", "2026-06-01"), ("3", "f3", 8, "b2", "2026-06-30 17:00:00")]))
    assert [(r["id"], r["amount_minor"], r["month"]) for r in store.newest().collect()] == [("3", 8, "2026-07"), ("2", 7, "2026-06"), ("1", 5, "2026-05")]
    with pytest.raises(UniqueViolation):
        store.save_import(batch(spark, "b3"), tx(spark, [("9", "f1", 5, "b3", "2026-05-01")]))
    store.set_category("1", "food")
    assert store.of_batch("b1").first()["category_source"] == "user"
    store.delete_batch("b2")
    assert [r["id"] for r in store.transactions().collect()] == ["1"] and [r["id"] for r in store.batches().collect()] == ["b1"]
    store.set_setting("x", {"a": 1})
    assert store.setting("x") == {"a": 1} and store.setting("y", 3) == 3
    base, pointer = store._pointer()
    with pytest.raises(Conflict):  # settings were touched since
        store.commit(base - 1, settings=store.read("settings"))
    with pytest.raises(Conflict):  # another writer took the number in between
        store._swap(base - 1, pointer)
    assert store._pointer() == (base, pointer) and store.transactions().count() == 1
    store.clear()
    assert store.transactions().count() == 0 and store.months() == [] and store.setting("x") is None


def months_of(store):
    return {m: x["path"] for m, x in store._pointer()[1]["months"].items()}


def test_commits_rewrite_touched_months_only(spark, tmp_path):
    store = LedgerStore(spark, f"file://{tmp_path}/ledger")
    store.save_import(batch(spark, "b1"), tx(spark, [("1", "f1", 5, "b1", "2026-05-01"), ("2", "f2", 6, "b1", "2026-06-01"), ("3", "f3", 6, "b1", "2026-07-01")]))
    before = months_of(store)
    assert sorted(before) == ["2026-05", "2026-06", "2026-07"]
    store.set_category("2", "food")
    after = months_of(store)
    assert [m for m in before if before[m] != after[m]] == ["2026-06"]
    store.save_import(batch(spark, "b2"), tx(spark, [("3", "f3", 9, "b2", "2026-05-02")]))  # a row that moves to another month
    assert sorted(months_of(store)) == ["2026-05", "2026-06"] and months_of(store)["2026-06"] == after["2026-06"]
    assert sorted((r["id"], r["amount_minor"]) for r in store.transactions().collect()) == [("1", 5), ("2", 6), ("3", 9)]
    assert sorted(r["id"] for r in store.read("transactions", ["2026-05"]).collect()) == ["1", "3"]


def test_rows_without_a_time(spark, tmp_path):
    store = LedgerStore(spark, f"file://{tmp_path}/ledger")
    store.save_import(batch(spark, "b1"), tx(spark, [("1", "f1", 5, "b1", None), ("2", "f2", 6, "b1", "2026-06-01")]))
    store.save_import(batch(spark, "b2"), tx(spark, [("1", "f1", 8, "b2", None), ("3", "f3", 6, "b1", None)]))
    assert sorted((r["id"], r["amount_minor"]) for r in store.transactions().collect()) == [("1", 8), ("2", 6), ("3", 6)]
    store.set_category("3", "pet")
    assert store.months() == ["2026-06", None] and [r["id"] for r in store.newest(1).collect()] == ["2"]
    store.delete_batch("b2")
    assert sorted((r["id"], r["category"]) for r in store.transactions().collect()) == [("2", None), ("3", "pet")]


def test_two_writers(spark, tmp_path):
    """What one writer does between another's reading and its commit survives, or the other gets Conflict."""
    ours, theirs = (LedgerStore(spark, f"file://{tmp_path}/ledger") for _ in range(2))
    ours.save_import(batch(spark, "b1"), tx(spark, [("1", "f1", 5, "b1", "2026-05-01"), ("2", "f2", 6, "b1", "2026-06-01")]))
    ours.put("settings", [{"key": "a", "value": "1"}])

    def between(store, what):
        publish = store._publish

        def slow(*args):
            store._publish = publish
            what()
            publish(*args)

        store._publish = slow

    between(ours, lambda: theirs.put("settings", [{"key": "b", "value": "2"}]))
    ours.put("settings", [{"key": "c", "value": "3"}])  # made again on top of theirs
    assert sorted(r["key"] for r in ours.read("settings").collect()) == ["a", "b", "c"]
    between(ours, lambda: theirs.set_setting("d", 4))
    ours.put("accounts", [{"id": "x", "label": "y"}])  # another table: both survive
    assert ours.read("accounts").count() == 1 and ours.setting("d") == 4
    between(ours, lambda: theirs.set_category("2", "food"))
    ours.set_category("1", "pet")  # another month: both survive
    assert sorted((r["id"], r["category"]) for r in ours.transactions().collect()) == [("1", "pet"), ("2", "food")]
    between(ours, lambda: theirs.set_category("1", "travel"))
    with pytest.raises(Conflict):
        ours.set_category("1", "food")
    between(ours, lambda: theirs.save_import(batch(spark, "b2"), tx(spark, [("8", "f8", 1, "b2", "2026-01-01")])))
    with pytest.raises(Conflict):  # both might bring the same fingerprint
        ours.save_import(batch(spark, "b3"), tx(spark, [("9", "f8", 1, "b3", "2026-02-01")]))
    between(ours, lambda: theirs.put("accounts", [{"id": "z", "label": "z"}]))
    with pytest.raises(Conflict):
        ours.clear()
    assert ours.transactions().count() == 3
    log = ours.history()
    assert [n for n, _ in log] == list(range(1, len(log) + 1)) and log[-1][1] == ["accounts"]


def test_expiry(spark, tmp_path):
    store = LedgerStore(spark, f"file://{tmp_path}/ledger")
    store.save_import(batch(spark, "b1"), tx(spark, [("1", "f1", 5, "b1", "2026-05-01"), ("2", "f2", 6, "b1", "2026-06-01")]))
    first = months_of(store)
    store.set_category("2", "food")
    store.set_category("2", "pet")
    store.put("settings", [{"key": "a", "value": "1"}])
    assert store.expire(keep=2) == []  # all is younger than the grace time
    gone = store.expire(keep=1, grace_seconds=-5)
    assert first["2026-06"] in gone and first["2026-05"] not in gone and len(store.versions()) == 1
    assert sorted((r["id"], r["category"]) for r in store.transactions().collect()) == [("1", None), ("2", "pet")]
    assert store.search("pet").count() == 1 and store.setting("a") == 1
    store.save_import(batch(spark, "b2"), tx(spark, [("2", "f2", 7, "b2", "2026-06-01")]))
    assert sorted(r["amount_minor"] for r in store.transactions().collect()) == [5, 7]


def ledger_of(spark, store, n=60):
    rows = [(str(i), f"f{i}", i, "b1", f"2026-{i % 6 + 1:02d}-{i % 28 + 1:02d} 08:00:00") for i in range(n)]
    made = tx(spark, rows).withColumns({"kind": F.when(F.col("amount_minor") % 3 == 0, "income").when(F.col("amount_minor") % 7 == 0, "transfer-internal").otherwise("expense"), "raw_description": F.when(F.col("id") == "17", "A rare Wörd").when(F.col("id") == "18", "月饼礼盒").otherwise("coffee"), "counterparty": F.lit("Shop")})
    store.save_import(batch(spark, "b1"), made)


def files_read(df):
    return {re.search(r"month=([^/]*)", f)[1] for f in df.inputFiles()}


def test_metadata_and_early_stop(spark, tmp_path):
    store = LedgerStore(spark, f"file://{tmp_path}/ledger")
    ledger_of(spark, store)
    store.delete_batch("no such batch")
    assert store.months() == [r["month"] for r in reports.distinct_months(store.transactions()).collect()]
    assert sorted(map(tuple, store.month_totals().select("month", "expense_minor", "income_minor", "net_minor", "expense_count").collect())) == sorted(map(tuple, reports.month_totals(store.transactions()).select("month", "expense_minor", "income_minor", "net_minor", "expense_count").collect()))
    for n in (1, 10, 11, 1000):
        assert [r["id"] for r in store.newest(n).collect()] == [r["id"] for r in reports.newest(store.transactions(), n).collect()]
    assert files_read(store.newest(10)) == {"2026-06"} and files_read(store.newest(11)) == {"2026-05", "2026-06"}


def test_search_reads_months_that_hold_the_word(spark, tmp_path):
    store = LedgerStore(spark, f"file://{tmp_path}/ledger")
    ledger_of(spark, store)
    for word in ("rare wörd", "月饼礼盒", "coffee shop", "COFFEE", "no such word", "饼", "e s", ""):
        assert sorted(r["id"] for r in store.search(word).collect()) == sorted(r["id"] for r in reports.listed(store.transactions(), search=word).collect())
    assert files_read(store.search("Rare")) == {"2026-06"} and files_read(store.search("月饼礼")) == {"2026-01"}
    assert store.search("zzz").count() == 0 and len(files_read(store.search("coffee", kind="income"))) == 6
    store.set_category("3", "Museum")
    assert [r["id"] for r in store.search("museum").collect()] == ["3"] and files_read(store.search("museum")) == {"2026-04"}


@pytest.mark.parametrize("few", [0, 200])
def test_key_index(spark, tmp_path, monkeypatch, few):
    monkeypatch.setattr(key_index, "FEW", few)
    monkeypatch.setattr(store_module, "DELTAS", 2)
    store, rng, model = LedgerStore(spark, f"file://{tmp_path}/ledger", buckets=4), random.Random(few), {}
    for step in range(6):
        rows = [(str(i), f"f{i}", rng.randint(1, 99), f"b{step}", f"2026-{rng.randint(1, 4):02d}-10") for i in rng.sample(range(30), 8)]
        store.save_import(batch(spark, f"b{step}"), tx(spark, rows))
        model |= {r[0]: r for r in rows}
        if step == 3:
            store.delete_batch("b1")
            model = {k: r for k, r in model.items() if r[3] != "b1"}
        assert len(store._pointer()[1]["keys"]) <= 3
    assert sorted((r["id"], r["amount_minor"], r["month"]) for r in store.transactions().collect()) == sorted((r[0], r[2], r[4][:7]) for r in model.values())
    wanted = spark.createDataFrame([(f"f{i}",) for i in range(40)], "fingerprint string")
    assert sorted(r["fingerprint"] for r in store.known_fingerprints(wanted).collect()) == sorted(r[1] for r in model.values())
    one = next(iter(model.values()))
    got = store.records(spark.createDataFrame([(one[1],), ("none",)], "fingerprint string"))
    assert [(r["id"], r["amount_minor"]) for r in got.collect()] == [(one[0], one[2])] and files_read(got) == {one[4][:7]}
    with pytest.raises(UniqueViolation):
        store.save_import(batch(spark, "bad"), tx(spark, [("other id", one[1], 1, "bad", "2026-01-01")]))
    moved = tx(spark, [(one[0], "new print", 1, "b9", "2026-04-01")])
    store.save_import(batch(spark, "b9"), moved)  # the id keeps its row, the old fingerprint is free again
    store.save_import(batch(spark, "b10"), tx(spark, [("later", one[1], 1, "b10", "2026-04-01")]))


def test_index_joins_without_a_shuffle_of_the_stored_side(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(key_index, "FEW", 0)
    store = LedgerStore(spark, f"file://{tmp_path}/ledger", buckets=4)
    ledger_of(spark, store)
    folders = store._pointer()[1]["keys"]
    wanted = spark.range(20).select(F.concat(F.lit("f:f"), "id").alias("key"))
    plan = key_index.read(spark, folders[0], 4).join(wanted.repartition(4, "key").hint("merge"), "key")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "SortMergeJoin" in plan
    assert key_index.lookup(wanted, folders, 4).count() == 20
    one = key_index.read(spark, folders[0], 4).where(F.col("key").isin("f:f3"))
    (home,) = {r[0] for r in one.select(F.input_file_name()).collect()}
    for f in one.inputFiles():  # the files of the other buckets may be gone, as they aren't read
        if f != home:
            os.remove(f.removeprefix("file://"))
    assert [r["id"] for r in one.collect()] == ["3"]


def test_reconcile_through_the_store(spark, tmp_path):
    store = LedgerStore(spark, f"file://{tmp_path}/ledger")
    ledger_of(spark, store)
    new = store.transactions().drop("month").where("id in ('3', '4')").withColumn("amount_minor", F.col("amount_minor") + F.when(F.col("id") == "3", 5).otherwise(0))
    new = new.unionByName(tx(spark, [("x", "fx", 1, "b2", "2026-01-01")]).withColumn("raw_description", F.lit("x"))).withColumn("seq", F.struct(F.lit(0).alias("file"), F.col("amount_minor").cast("int").alias("row"), F.lit(0).alias("part")))
    got = reconcile.reconcile(new, store.records)
    assert [r["id"] for r in got.fresh.collect()] == ["x"] and [r["id"] for r in got.duplicates.collect()] == ["4"] and [r["changes"] for r in got.updated.collect()] == [["amount ¥0.03 -> ¥0.08"]]
    skipped = reconcile.reconcile(new, skip=store.known_fingerprints)
    assert [r["id"] for r in skipped.fresh.collect()] == ["x"]


def test_snapshot(spark):
    doc = {"schemaVersion": 1, "transactions": [{"id": "é"}]}
    blob = snapshot.encrypt(spark, doc, "twelve chars!", iterations=1000)
    assert (len(blob) - snapshot.HEADER - snapshot.TAG) % snapshot.BLOCK == 0
    assert snapshot.decrypt(spark, blob, "twelve chars!") == doc
    for bad, word in ((blob[:-1] + bytes([blob[-1] ^ 1]), "twelve chars!"), (blob, "another word"), (b"x" + blob[1:], "twelve chars!"), (blob[:20], "twelve chars!")):
        with pytest.raises(snapshot.SnapshotError):
            snapshot.decrypt(spark, bad, word)
    with pytest.raises(ValueError):
        snapshot.encrypt(spark, doc, "short")


def test_guard(spark):
    # seventeen digits and an X are a card number's length as well
    lines = "\n".join(["2026-01-02 paid 12.50"] * 3)
    df = spark.createDataFrame([(1, "id 12345678901234567X."), (2, "card 1234567890123456 x"), (3, lines), (4, None), (5, "0.1234567890123456")], "k int, text string")
    assert sorted((r["k"], r["rule"]) for r in guard.scan_texts(df, "k").collect()) == [(1, "card-number"), (1, "resident-id"), (2, "card-number"), (3, "statement-like")]


def test_exact_pairs_model():
    rng = random.Random(1)
    for _ in range(300):
        rows = [{"id": str(i), "direction": rng.choice(["out", "in"]), "amount_minor": 5, "epoch": rng.randint(0, 40), "seq": {"file": 0, "row": i, "part": 0}} for i in range(rng.randint(0, 12))]
        ordered = sorted(rows, key=lambda r: (r["epoch"], r["seq"]["row"]))
        used, want = set(), []
        for o in (r for r in ordered if r["direction"] == "out"):
            near = [(abs(o["epoch"] - i["epoch"]), k, i["id"]) for k, i in enumerate(ordered) if i["direction"] == "in" and i["id"] not in used and abs(o["epoch"] - i["epoch"]) <= 6]
            if near:
                used.add(min(near)[2])
                want.append((o["id"], min(near)[2], 5))
        assert [(*o, *i, m) for _, o, i, m in transfers.nearest_pairs(rows, 6)] == want
