"""A ledger on Parquet: versions of tables behind numbered pointers, so that a commit is all or nothing.

A pointer names the folders of a version and what that version touched; the pointers together are a log of changes.  A commit writes its data, then a pointer under
another name, and renames that to the next number, which fails if it is taken: a reader sees the old version or the new one.  If others have committed since
a change was made, it goes on top of theirs where none of them touched what it read or writes; else it gets ``Conflict``.  This rests on a rename that is
atomic and fails where the target exists: HDFS and local file systems give that, object stores do not without a committer of their own.

Transactions lie in a folder for each local month (``none`` for rows without a time).  A commit rewrites only the months and tables that it touches; all
else keeps its folder.  Beside each month its pointer keeps counts and sums, so that months, totals and the newest rows need no scan
or the last months only, and a folder of the trigrams of its texts, so that a search reads only months that can hold the word.  A bucketed index of keys
(``key_index``) tells where the record of a fingerprint or an id lies, so that an import reads only the months that it meets.
"""

from __future__ import annotations

import json
import re
import time
import uuid
from collections.abc import Callable, Iterable

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.dates import local_month
from ..functions.text import text
from ..plans import reports
from ..schema import BATCH, TRANSACTION
from ..session import cut
from . import key_index

TABLES = {
    "transactions": TRANSACTION,
    "batches": BATCH,
    "accounts": T.StructType([T.StructField("id", T.StringType()), T.StructField("label", T.StringType())]),
    "templates": T.StructType([T.StructField("id", T.StringType()), T.StructField("value", T.StringType())]),
    "rules": T.StructType([T.StructField("id", T.StringType()), T.StructField("value", T.StringType())]),
    "settings": T.StructType([T.StructField("key", T.StringType()), T.StructField("value", T.StringType())]),
}
NO_MONTH = "none"
KEYS = ["id", "fingerprint", "month"]
GRAM = 3
#: More deltas of the key index than this are folded into its base by the next commit.
DELTAS = 8


class UniqueViolation(Exception):
    """Two records of one fingerprint: nothing was written."""


class Conflict(Exception):
    """Another writer has touched what this change read or writes: nothing was written."""


def month_of() -> Column:
    return F.coalesce(local_month(F.col("occurred_at")), F.lit(NO_MONTH))


def overlap(ours: Iterable[str], theirs: Iterable[str]) -> bool:
    """Whether two sets of touched things meet; ``transactions`` stands for all its months."""
    return any(a == b or a.startswith(b + ":") or b.startswith(a + ":") for a in ours for b in theirs)


def searched() -> Column:
    """The text that a search looks at, as ``reports.listed`` does."""
    return F.lower(F.concat_ws(" ", text("raw_description"), text("counterparty"), text("category")))


class LedgerStore:
    def __init__(self, spark: SparkSession, root: str, buckets: int = 16):
        self.spark, self.root, self.buckets = spark, root.rstrip("/"), buckets
        self._fs = self._path(self.root).getFileSystem(spark._jsc.hadoopConfiguration())

    # ---- the log

    def _path(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(name)

    def versions(self) -> list[int]:
        """Numbers of the versions that are kept, oldest first."""
        names = [x.getPath().getName() for x in self._fs.listStatus(self._path(self.root))] if self._fs.exists(self._path(self.root)) else []
        return sorted(int(x.removeprefix("POINTER-")) for x in names if re.fullmatch(r"POINTER-\d+", x))

    def _load(self, n: int) -> dict:
        stream = self._fs.open(self._path(f"{self.root}/POINTER-{n:012d}"))
        try:
            return json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def _pointer(self) -> tuple[int, dict]:
        """The live version's number, and what it names."""
        n = max(self.versions(), default=0)
        return n, self._load(n) if n else {"touched": [], "tables": {}, "months": {}, "keys": [], "buckets": self.buckets}

    def history(self) -> list[tuple[int, list[str]]]:
        """(version, what it touched) of the versions that are kept."""
        return [(n, self._load(n)["touched"]) for n in self.versions()]

    def _swap(self, base: int, pointer: dict) -> None:
        jvm = self.spark._jvm
        new, live = (self._path(f"{self.root}/{name}") for name in (f"NEW-{uuid.uuid4().hex}", f"POINTER-{base + 1:012d}"))
        out = self._fs.create(new, True)
        out.write(json.dumps(pointer).encode())
        out.close()
        files = jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._fs.getUri(), self.spark._jsc.hadoopConfiguration())
        try:
            files.rename(new, live, self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0))
        except Py4JJavaError as e:
            self._fs.delete(new, False)
            if self._fs.exists(live):
                raise Conflict(f"version {base + 1} exists already") from e
            raise

    def _publish(self, base: int, touched: Iterable[str], reads: Iterable[str], change: Callable[[dict], dict]) -> None:
        """Put a change on top of the live version, if nothing that it read or writes was touched since ``base``."""
        touched, checked = sorted(touched), base
        while True:
            now, live = self._pointer()
            for n in range(checked + 1, now + 1):
                try:
                    theirs = self._load(n)["touched"]
                except Py4JJavaError as e:
                    raise Conflict(f"version {n} isn't kept any more") from e
                if overlap([*touched, *reads], theirs):
                    raise Conflict(f"made from version {base}, but version {n} touched {', '.join(theirs)}")
            if now < checked:
                raise Conflict(f"made from version {base}, but {now} is live")
            checked = now
            try:
                return self._swap(now, change(json.loads(json.dumps(live))) | {"touched": touched})
            except Conflict:
                continue  # somebody was faster; look at what they touched

    def expire(self, keep: int = 10, grace_seconds: float = 86_400) -> list[str]:
        """Forget all but the newest ``keep`` versions and delete the folders that none of these names.  Folders younger than the grace time stay: a
        writer may be about to name them.  Readers of a version that goes have to read again.  The deleted folders."""
        kept = self.versions()[-max(keep, 1) :]
        named = set()
        for n in kept:
            p = self._load(n)
            named |= {*p["tables"].values(), *p["keys"], *(m[k] for m in p["months"].values() for k in ("path", "grams"))}
        for n in self.versions():
            if n < kept[0]:
                self._fs.delete(self._path(f"{self.root}/POINTER-{n:012d}"), False)
        gone, young = [], (time.time() - grace_seconds) * 1000
        for top in (*TABLES, "keys", "grams"):
            for x in self._fs.listStatus(self._path(f"{self.root}/{top}")) if self._fs.exists(self._path(f"{self.root}/{top}")) else []:
                whole = f"{self.root}/{top}/{x.getPath().getName()}"
                used = {p for p in named if p == whole or p.startswith(whole + "/")}
                parts = [] if whole in used else [f"{whole}/{y.getPath().getName()}" for y in self._fs.listStatus(x.getPath()) if y.isDirectory()] if used else [whole]
                for path in parts:
                    if path not in used and x.getModificationTime() <= young:
                        self._fs.delete(self._path(path), True)
                        gone.append(path)
        return gone

    def drop(self) -> None:
        """Delete the store."""
        self._fs.delete(self._path(self.root), True)

    # ---- reading

    def read(self, table: str, months: Iterable[str] | None = None) -> DataFrame:
        """A table; of transactions only some months, if wanted."""
        return self._read(self._pointer()[1], table, months)

    def _read(self, pointer: dict, table: str, months: Iterable[str] | None = None) -> DataFrame:
        if table == "transactions":
            wanted = None if months is None else set(months)
            where = [m["path"] for month, m in sorted(pointer["months"].items()) if wanted is None or month in wanted]
            df = self.spark.read.schema(TRANSACTION).parquet(*where) if where else self.spark.createDataFrame([], TRANSACTION)
            return df.withColumn("month", month_of())
        where = pointer["tables"].get(table)
        return self.spark.read.schema(TABLES[table]).parquet(where) if where else self.spark.createDataFrame([], TABLES[table])

    def transactions(self) -> DataFrame:
        return self.read("transactions")

    def newest(self, n: int | None = None) -> DataFrame:
        """Newest first, ids breaking ties; of the n newest only the last months that hold so many rows are read, as their counts are known."""
        pointer = self._pointer()[1]
        months = None
        if n is not None:
            months, held = [], 0
            for month in sorted(pointer["months"], key=lambda m: (m != NO_MONTH, m), reverse=True):
                if held >= n:
                    break
                months.append(month)
                held += pointer["months"][month]["rows"]
        out = self._read(pointer, "transactions", months).orderBy(F.desc("occurred_at"), F.asc("id"))
        return out if n is None else out.limit(n)

    def search(self, words: str, **filters) -> DataFrame:
        """``reports.listed`` over the months whose texts hold every trigram of the words; shorter words are sought in all months."""
        pointer, low = self._pointer()[1], words.lower()
        grams = {low[i : i + GRAM] for i in range(len(low) - GRAM + 1)}
        months = None
        if grams:
            paths = [m["grams"] for m in pointer["months"].values()]
            held = self.spark.read.schema("gram string, of string").parquet(*paths).where(F.col("gram").isin(sorted(grams))) if paths else None
            months = [r["of"] for r in held.groupBy("of").agg(F.count_distinct("gram").alias("c")).where(F.col("c") == len(grams)).collect()] if held is not None else []
        return reports.listed(self._read(pointer, "transactions", months), search=words, **filters)

    def months(self) -> list[str | None]:
        """The months that hold rows, newest first, from the pointer alone; None for rows without a time."""
        held = [m for m, x in self._pointer()[1]["months"].items() if x["rows"]]
        return [*sorted((m for m in held if m != NO_MONTH), reverse=True), *([None] if NO_MONTH in held else [])]

    def month_totals(self) -> DataFrame:
        """``reports.month_totals`` from the pointer alone."""
        rows = [(None if m == NO_MONTH else m, *x["totals"]) for m, x in self._pointer()[1]["months"].items() if x["totals"]]
        return self.spark.createDataFrame(rows, "month string, expense_minor long, income_minor long, expense_count long, net_minor long")

    def of_batch(self, batch_id: str) -> DataFrame:
        return self.transactions().where(F.col("imported_batch_id") == batch_id)

    def fingerprints(self) -> DataFrame:
        """Only the key column is read."""
        return self.transactions().select("fingerprint")

    def _lookup(self, pointer: dict, keys: DataFrame) -> DataFrame:
        return key_index.lookup(keys, pointer["keys"], pointer["buckets"])

    def known_fingerprints(self, wanted: DataFrame) -> DataFrame:
        """Those of the fingerprints (fingerprint) that are stored, by the key index."""
        return self._lookup(self._pointer()[1], wanted.select(key_index.fingerprint_key().alias("key"))).select("fingerprint")

    def records(self, wanted: DataFrame) -> DataFrame:
        """The stored records of the fingerprints (fingerprint): only the months that hold one are read."""
        pointer = self._pointer()[1]
        found = cut(self._lookup(pointer, wanted.select(key_index.fingerprint_key().alias("key"))).select("fingerprint", "month"))
        months = [r["month"] for r in found.select("month").distinct().collect()]
        return self._read(pointer, "transactions", months).join(found.select("fingerprint"), "fingerprint", "left_semi").select(*TRANSACTION.fieldNames())

    def batches(self) -> DataFrame:
        return self.read("batches").orderBy(F.desc("imported_at"), "id")

    def setting(self, key: str, default=None):
        row = self.read("settings").where(F.col("key") == key).select("value").first()
        return default if row is None else json.loads(row["value"])

    # ---- writing

    def _write_months(self, rows: DataFrame) -> dict[str, dict]:
        """Write transactions by month, with their counts, sums and trigrams: what the pointer keeps of each month."""
        version = uuid.uuid4().hex
        where, grams = f"{self.root}/transactions/{version}", f"{self.root}/grams/{version}"
        # a month's rows go to few files, and a month of many rows to as many tasks as it needs
        rows.select(*TRANSACTION.fieldNames(), month_of().alias("month")).hint("rebalance", "month").write.partitionBy("month").parquet(where)
        written = self.spark.read.schema(TRANSACTION).parquet(where).withColumn("of", month_of())
        each = F.explode(F.transform(F.sequence(F.lit(1), F.length("s") - (GRAM - 1)), lambda i: F.substring(F.col("s"), i, F.lit(GRAM))))
        texts = written.select("of", searched().alias("s")).distinct().where(F.length("s") >= GRAM)
        held = texts.select("of", each.alias("gram")).distinct().unionByName(written.select("of", F.lit("").alias("gram")).distinct())
        held.withColumn("month", F.col("of")).repartition("month").sortWithinPartitions("month", "gram").write.partitionBy("month").parquet(grams)
        rows_of = {r["of"]: r["c"] for r in written.groupBy("of").agg(F.count(F.lit(1)).alias("c")).collect()}  # a ledger has a few hundred months at most
        totals = {r["month"] or NO_MONTH: [r["expense_minor"], r["income_minor"], r["expense_count"], r["net_minor"]] for r in reports.month_totals(written).collect()}
        return {m: {"path": f"{where}/month={m}", "grams": f"{grams}/month={m}", "rows": c, "totals": totals.get(m)} for m, c in rows_of.items()}

    def commit(self, base: int | None = None, months: Iterable[str] | None = None, reads: Iterable[str] = (), added: DataFrame | None = None, removed: DataFrame | None = None, **tables: DataFrame) -> None:
        """Write new versions of some tables, then the next pointer.  ``base`` is the version that they were made from; ``months`` are those that the
        transactions replace, by default all; ``reads`` what the change rests on besides.  ``added`` and ``removed`` (id, fingerprint, month) tell how keys
        change; by default they are found by comparing the months before and after."""
        now, pointer = self._pointer()
        if base is None:
            base = now
        elif base != now:
            pointer = self._load(base) if base else {"touched": [], "tables": {}, "months": {}, "keys": [], "buckets": self.buckets}
        version, touched, paths, made, folders, whole = uuid.uuid4().hex, set(), {}, {}, [], months is None
        for name, df in tables.items():
            if name != "transactions":
                paths[name] = f"{self.root}/{name}/{version}"
                df.select(*TABLES[name].fieldNames()).write.parquet(paths[name])
                touched.add(name)
                continue
            months = None if whole else set(months)
            made = self._write_months(df)
            touched |= {"transactions", "keys"} if whole else {f"transactions:{m}" for m in {*months, *made}}
            now_there = self._read({"months": made}, "transactions").select(*KEYS)
            if whole:
                added, removed = now_there, None
            elif added is None and removed is None:
                before = self._read(pointer, "transactions", months).select(*KEYS)
                added, removed = now_there.join(before, KEYS, "left_anti"), before.join(now_there, KEYS, "left_anti")
            entries = [key_index.entries(rows, alive, base + 1) for rows, alive in ((added, True), (removed, False)) if rows is not None]
            entries = cut(entries[0].unionByName(entries[1]) if len(entries) > 1 else entries[0])
            if whole or not entries.isEmpty():
                touched.add("keys")
                folders = [f"{self.root}/keys/{version}"]
                key_index.write(entries, folders[0], pointer["buckets"])

        def change(live: dict) -> dict:
            live["tables"] |= paths
            if "transactions" in tables:
                live["months"] = made if whole else {k: v for k, v in live["months"].items() if k not in months} | made
                live["keys"] = folders if whole else live["keys"] + folders
                if len(live["keys"]) > DELTAS + 1:
                    live["keys"] = [self._folded(live)]
            return live

        self._publish(base, touched, reads, change)

    def _folded(self, pointer: dict) -> str:
        """A new base of the key index: the entries of all its folders that are alive."""
        where = f"{self.root}/keys/{uuid.uuid4().hex}"
        key_index.folded(self.spark, pointer["keys"], where, pointer["buckets"])
        return where

    # ---- changes

    def _upsert(self, pointer: dict, table: str, rows: DataFrame, key: str) -> DataFrame:
        old = self._read(pointer, table)
        return old.select(*TABLES[table].fieldNames()).join(rows.select(key), key, "left_anti").unionByName(rows.select(*TABLES[table].fieldNames()))

    def _months(self, rows: DataFrame) -> list[str]:
        return [r["month"] for r in rows.select("month").distinct().collect()]  # a ledger has a few hundred at most

    def save_import(self, batch: DataFrame, txs: DataFrame) -> None:
        """A batch and its rows, upserted by id; two rows of one fingerprint abort all.  Only the months of these rows, and of those that they
        replace, are read and rewritten; the key index tells which."""
        base, pointer = self._pointer()
        txs = cut(txs.select(*TRANSACTION.fieldNames()).withColumn("month", month_of()))
        ids = txs.select("id")
        wanted = txs.select(F.explode(F.array_compact(F.array(key_index.fingerprint_key(), key_index.id_key()))).alias("key"))
        found = cut(self._lookup(pointer, wanted))
        clash = found.where("key like 'f:%'").join(ids, "id", "left_anti").select("fingerprint")
        twice = txs.groupBy("fingerprint").count().where("fingerprint is not null and count > 1").select("fingerprint")
        if not clash.unionByName(twice).isEmpty():
            raise UniqueViolation("fingerprint is not unique")
        replaced = found.where("key like 'i:%'").select(*KEYS)
        months = self._months(txs.select("month").unionByName(replaced.select("month")))
        merged = self._read(pointer, "transactions", months).join(ids, "id", "left_anti").unionByName(txs)
        new = txs.select(*KEYS)
        self.commit(base, months, {"keys"}, new.join(replaced, KEYS, "left_anti"), replaced.join(new, KEYS, "left_anti"), transactions=merged, batches=self._upsert(pointer, "batches", batch, "id"))

    def delete_batch(self, batch_id: str) -> None:
        base, pointer = self._pointer()
        gone = F.col("imported_batch_id").eqNullSafe(batch_id)
        removed = cut(self._read(pointer, "transactions").where(gone).select(*KEYS))
        months = self._months(removed)
        self.commit(base, months, {"keys"}, None, removed, transactions=self._read(pointer, "transactions", months).where(~gone), batches=self._read(pointer, "batches").where(F.col("id") != batch_id))

    def set_category(self, tx_id: str, category: str | None) -> None:
        """The user's choice, also when it clears the category."""
        self.set_categories(self.spark.createDataFrame([(tx_id, category)], "id string, category string"))

    def set_categories(self, choices: DataFrame) -> None:
        """Many choices (id, category) at once; unknown ids change nothing."""
        base, pointer = self._pointer()
        chosen = choices.select("id", F.col("category").alias("_category"), F.lit(True).alias("_hit"))
        months = self._months(self._lookup(pointer, choices.select(key_index.id_key().alias("key"))))
        if not months:
            return
        rows = self._read(pointer, "transactions", months).join(chosen, "id", "left")
        hit = F.col("_hit").isNotNull()
        none = self.spark.createDataFrame([], "id string, fingerprint string, month string")
        self.commit(base, months, (), none, None, transactions=rows.withColumn("category", F.when(hit, F.col("_category")).otherwise(F.col("category"))).withColumn("category_source", F.when(hit, "user").otherwise(F.col("category_source"))))

    def _change_table(self, table: str, make: Callable[[dict], DataFrame], tries: int = 5) -> None:
        """A change of a small table, made again from the newest version if another writer has touched that table meanwhile."""
        for left in range(tries, 0, -1):
            base, pointer = self._pointer()
            try:
                return self.commit(base, **{table: make(pointer)})
            except Conflict:
                if left == 1:
                    raise

    def put(self, table: str, rows: Iterable[dict]) -> None:
        """Upsert into a small table (accounts, templates, settings)."""
        key = "key" if table == "settings" else "id"
        rows = [{k: v if isinstance(v, str) or v is None else json.dumps(v, ensure_ascii=False) for k, v in r.items()} for r in rows]
        new = self.spark.createDataFrame(rows, TABLES[table])
        self._change_table(table, lambda pointer: self._upsert(pointer, table, new, key))

    def set_setting(self, key: str, value) -> None:
        self.put("settings", [{"key": key, "value": json.dumps(value, ensure_ascii=False)}])

    def delete_template(self, template_id: str) -> None:
        self._change_table("templates", lambda pointer: self._read(pointer, "templates").where(F.col("id") != template_id))

    def replace_rules(self, rows: Iterable[dict]) -> None:
        rows = [{k: v if isinstance(v, str) else json.dumps(v, ensure_ascii=False) for k, v in r.items()} for r in rows]
        self.commit(rules=self.spark.createDataFrame(rows, TABLES["rules"]))

    def restore(self, transactions: DataFrame, batches: DataFrame, templates: DataFrame) -> None:
        """Replace these three, as of the version that is live now; accounts, rules and settings stay."""
        self.commit(transactions=transactions, batches=batches, templates=templates)

    def clear(self) -> None:
        """Empty all tables, as of the version that is live now; a writer that commits meanwhile makes it a ``Conflict``."""
        empty = {"tables": {}, "months": {}, "keys": [], "buckets": self.buckets}
        self._publish(self._pointer()[0], [*TABLES, "keys"], (), lambda live: empty)
