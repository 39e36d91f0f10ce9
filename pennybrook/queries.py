"""Registered ledger queries and the DuckDB SQL that each is checked against."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import dates, fingerprints, money, text
from .operators import categories, classify, guard, lexicon as L, reconcile as rec, refunds, transfers
from .plans import build, derived, reports
from .schema import BATCH
from .session import cut, shared_folder
from .sources import containers, glyphs, platforms, snapshot
from .sources.store import LedgerStore

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return register


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)


# ---- SQL parts for the oracles

D = f"d AS ({derived.duck(derived.ORDERS)})"
R = f"r AS ({derived.duck(derived.REFUNDS)})"
has = lambda column, pattern: f"regexp_matches({column}, '{pattern}')"
DISCLOSED = "(CASE WHEN status LIKE '%退%' AND regexp_extract(status, '[¥￥](\\d+\\.\\d\\d)', 1) <> '' AND CAST(regexp_extract(status, '[¥￥](\\d+)', 1) AS BIGINT) * 100 < amount_minor THEN CAST(regexp_extract(status, '[¥￥](\\d+)', 1) AS BIGINT) * 100 END)"
KIND = f"""CASE WHEN {DISCLOSED} IS NULL AND ({has('status', L.REFUND_STATUS)} OR tx_type = '退款') THEN 'refund'
 WHEN direction = 'out' AND {has('hay', L.FEE)} THEN 'expense'
 WHEN direction = 'in' AND {has('lower(description)', L.INTEREST_INCOME)} AND NOT {has('lower(description)', L.FEE_CONTEXT)} THEN 'income'
 WHEN {has('hay', L.REPAYMENT)} THEN 'transfer-repayment'
 WHEN {has('hay', L.INVESTMENT)} THEN 'transfer-investment'
 WHEN excluded AND {has('hay', L.INVESTMENT_BY_FLAG)} THEN 'transfer-investment'
 WHEN excluded THEN 'transfer-internal' WHEN direction = 'in' THEN 'income' ELSE 'expense' END"""
CLOSED = f"({has('status', L.CLOSED_STATUS)} OR {has('description', L.CLOSED_TEXT)})"
CATEGORY = "CASE " + " ".join(f"WHEN {has('fields', '|'.join(w.lower() for w in words))} THEN '{name}'" for name, _, words in sorted(L.RULES, key=lambda r: -r[1])) + " END"
K = f"""h AS (SELECT *, lower(counterparty || ' ' || description || ' ' || tx_type || '  ' || method) AS hay, lower(counterparty || '|' || description || '|' || tx_type || '|' || method) AS fields FROM d WHERE NOT {CLOSED}),
 k AS (SELECT *, {KIND} AS kind, {DISCLOSED} AS netted FROM h),
 led AS (SELECT * REPLACE (amount_minor - coalesce(netted, 0) AS amount_minor), CASE WHEN kind IN ('expense', 'income', 'refund') THEN {CATEGORY} END AS category, strftime(make_timestamp((epoch + 28800) * 1000000), '%Y-%m') AS month FROM k)"""
PRE = """CASE WHEN order_id IS NOT NULL THEN 'v2|ord|' || order_id || '|' || amount_minor || '|' || direction
 WHEN balance_after_minor IS NOT NULL THEN 'v2|bal|' || balance_after_minor || '|' || epoch || '|' || amount_minor || '|' || direction
 ELSE 'v2|win|' || (epoch - epoch % 120) || '|' || amount_minor || '|' || direction || '|' || replace(lower(counterparty), ' ', '') || '|' || replace(lower(description), ' ', '') END"""
FNV = "lower(lpad(to_hex(CAST(list_reduce(list_prepend(CAST(14695981039346656037 AS UHUGEINT), list_transform(string_split(pre, ''), lambda c: CAST(unicode(c) AS UHUGEINT))), lambda a, x: (xor(a, x) * CAST(1099511628211 AS UHUGEINT)) % CAST(18446744073709551616 AS UHUGEINT)) AS UBIGINT)), 16, '0'))"


def ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Open orders as transactions with kinds, disclosed refunds netted, and categories; month is the local one."""
    d = derived.order_drafts(spark, sf_dir)
    d = d.where(~classify.is_closed()).withColumn("refund_netted_minor", classify.disclosed_refund())
    d = d.withColumn("amount_minor", F.col("amount_minor") - F.coalesce("refund_netted_minor", F.lit(0)))
    txs = build.to_transactions(d, F.concat(F.lit("b"), F.col("seq.row") % 4), fold=text.nfkc_native)
    return categories.categorised(txs)


# ---- scalars

MONEY = """SELECT o_orderkey AS k, CASE o_orderkey % 8 WHEN 0 THEN '¥' || s WHEN 1 THEN '(' || s || ')' WHEN 2 THEN '-' || s WHEN 3 THEN s || '5' WHEN 4 THEN '' WHEN 5 THEN '/' WHEN 6 THEN 'CNY 1,' || s ELSE '+' || s || ' 元' END AS t
FROM (SELECT o_orderkey, CAST(CAST(round(o_totalprice * 100) AS BIGINT) {div} 100 AS VARCHAR(20)) || '.' || lpad(CAST(CAST(round(o_totalprice * 100) AS BIGINT) % 100 AS VARCHAR(2)), 2, '0') AS s FROM {orders})"""


@query(f"""WITH m AS ({MONEY.format(div='//', orders='orders')}), c AS (SELECT *, regexp_replace(t, '[^0-9.]', '', 'g') AS n FROM m)
SELECT k, CASE WHEN n = '' THEN NULL ELSE CAST(round(CAST(n AS DECIMAL(18, 3)) * 100) AS BIGINT) * CASE WHEN t LIKE '(%' OR t LIKE '-%' THEN -1 ELSE 1 END END AS minor FROM c""")
def money_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = spark.sql(MONEY.replace("{div}", "div"), orders=spark.read.parquet(f"{sf_dir}/orders.parquet"))
    return d.select("k", money.parse_minor(F.col("t"), fold=text.nfkc_native).alias("minor"))


@query(f"""WITH {D} SELECT k, (CASE WHEN direction = 'in' THEN '' ELSE '-' END) || '¥' || format('{{:,}}', amount_minor // 100) || '.' || lpad(CAST(amount_minor % 100 AS VARCHAR), 2, '0') AS shown,
(CASE WHEN direction = 'in' THEN '' ELSE '-' END) || (amount_minor // 100) || '.' || lpad(CAST(amount_minor % 100 AS VARCHAR), 2, '0') AS plain FROM d""")
def money_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    signed = F.when(F.col("direction") == "in", F.col("amount_minor")).otherwise(-F.col("amount_minor"))
    return derived.frame(spark, sf_dir, derived.ORDERS).select("k", money.format_minor(signed).alias("shown"), money.decimal_string(signed).alias("plain"))


@query("SELECT event_id, CAST(floor(epoch(ts)) AS BIGINT) - CAST(floor(epoch(ts)) AS BIGINT) % 120 AS bucket FROM events")
def date_bucket_2min(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = derived.frame(spark, sf_dir, "SELECT event_id, EPOCH(ts) AS epoch FROM {events}")
    return e.select("event_id", dates.bucket_seconds(F.col("epoch"), 2).alias("bucket"))


@query(f"WITH {D} SELECT k, strftime(make_timestamp((epoch + 28800) * 1000000), '%Y-%m') AS month, strftime(make_timestamp((epoch + 28800) * 1000000), '%Y-%m-%d %H:%M') AS shown FROM d")
def shanghai_month(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = F.timestamp_seconds("epoch")
    return derived.frame(spark, sf_dir, derived.ORDERS).select("k", dates.local_month(at).alias("month"), dates.local_text(at).alias("shown"))


STAMPS = """SELECT o_orderkey AS k, CASE o_orderkey % 4 WHEN 0 THEN y || '-' || m || '-' || d || ' 08:09:10' WHEN 1 THEN y || '年' || m || '月' || d || '日' WHEN 2 THEN y || m || d || '235959' ELSE y || '/02/31' END AS t
FROM (SELECT o_orderkey, CAST(year(o_orderdate) AS VARCHAR(4)) AS y, lpad(CAST(month(o_orderdate) AS VARCHAR(2)), 2, '0') AS m, lpad(CAST(day(o_orderdate) AS VARCHAR(2)), 2, '0') AS d FROM {orders})"""


@query(f"""WITH s AS ({STAMPS.format(orders='orders')}) SELECT k, CAST(CASE k % 4 WHEN 0 THEN epoch(strptime(t, '%Y-%m-%d %H:%M:%S')) WHEN 1 THEN epoch(strptime(t, '%Y年%m月%d日')) WHEN 2 THEN epoch(strptime(t, '%Y%m%d%H%M%S')) END AS BIGINT) - 28800 AS epoch FROM s""")
def wall_clock_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = spark.sql(STAMPS, orders=spark.read.parquet(f"{sf_dir}/orders.parquet"))
    return d.select("k", F.unix_seconds(dates.to_instant(F.col("t"), fold=text.nfkc_native)).alias("epoch"))


def _prints(spark: SparkSession, sf_dir: str, where: str) -> DataFrame:
    d = derived.order_drafts(spark, sf_dir).where(where)
    pre = fingerprints.preimage(*[F.col(c) for c in ("occurred_at", "amount_minor", "direction", "counterparty", "balance_after_minor", "order_id", "description")], fold=text.nfkc_native)
    d = d.select(F.col("seq.row").cast("long").alias("k"), pre.alias("pre"))
    return d.select("k", "pre", fingerprints.fnv1a64(F.col("pre")).alias("fingerprint"))


def _prints_sql(where: str) -> str:
    return f"WITH {D}, p AS (SELECT k, {PRE} AS pre FROM d WHERE {where}) SELECT k, pre, {FNV} AS fingerprint FROM p"


@query(_prints_sql("order_id IS NOT NULL"))
def fingerprint_ord(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _prints(spark, sf_dir, "order_id is not null")


@query(_prints_sql("order_id IS NULL AND balance_after_minor IS NOT NULL"))
def fingerprint_bal(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _prints(spark, sf_dir, "order_id is null and balance_after_minor is not null")


@query(_prints_sql("order_id IS NULL AND balance_after_minor IS NULL"))
def fingerprint_win(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _prints(spark, sf_dir, "order_id is null and balance_after_minor is null")


PARTS = """SELECT o_orderkey AS k, CASE o_orderkey % 4 WHEN 0 THEN day WHEN 1 THEN day || ' 07:08' WHEN 2 THEN '' ELSE ' ' || day || ' ' END AS d, CASE o_orderkey % 3 WHEN 0 THEN '09:10:11' WHEN 1 THEN '' ELSE ' 21:00 ' END AS t,
 EPOCH(o_orderdate) + (o_orderkey * 7919) % 86400 AS epoch FROM (SELECT *, substring(CAST(o_orderdate AS VARCHAR(10)), 1, 10) AS day FROM {orders})"""


@query(f"WITH p AS ({derived.duck(PARTS)}) SELECT k, CASE WHEN trim(t) = '' OR k % 4 = 1 THEN trim(d) WHEN d = '' THEN trim(t) ELSE trim(d) || ' ' || trim(t) END AS whole, (epoch + 28800) // 86400 * 86400 - 28800 AS day_start FROM p")
def date_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = derived.frame(spark, sf_dir, PARTS)
    return d.select("k", dates.combine_date_time(F.col("d"), F.col("t")).alias("whole"), F.unix_seconds(dates.local_day_start(F.timestamp_seconds("epoch"))).alias("day_start"))


PIECES = "SELECT o_orderkey AS k, CASE o_orderkey % 4 WHEN 0 THEN '午餐' WHEN 1 THEN 'bus' WHEN 2 THEN '' ELSE 'a费' END AS a, CASE o_orderkey % 3 WHEN 0 THEN 'home' WHEN 1 THEN '外卖' ELSE '' END AS b FROM {orders}"


@query(f"WITH p AS ({derived.duck(PIECES)}) SELECT k, CASE WHEN a = '' THEN b WHEN b = '' THEN a WHEN k % 4 = 1 AND k % 3 = 0 THEN a || ' ' || b ELSE a || b END AS whole, k % 4 = 0 AS cjk FROM p")
def join_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derived.frame(spark, sf_dir, PIECES).select("k", text.join_text(F.col("a"), F.col("b")).alias("whole"), text.is_cjk(F.col("a")).alias("cjk"))


# ---- predicates and classification


@query(f"WITH {D} SELECT k, status FROM d WHERE NOT {CLOSED}")
def closed_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derived.order_drafts(spark, sf_dir).where(~classify.is_closed()).select(F.col("seq.row").cast("long").alias("k"), "status")


@query(f"WITH {D}, {K} SELECT k, kind, coalesce(netted, 0) AS disclosed FROM k")
def classify_kind(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = derived.order_drafts(spark, sf_dir).where(~classify.is_closed())
    kind = F.when(classify.is_refund(), "refund").otherwise(classify.kind())
    return d.select(F.col("seq.row").cast("long").alias("k"), kind.alias("kind"), F.coalesce(classify.disclosed_refund(), F.lit(0)).alias("disclosed"))


@query(f"WITH {D} SELECT k, CASE WHEN {has('lower(t)', L.OUT_HINTS)} THEN 'out' WHEN {has('lower(t)', L.IN_HINTS)} THEN 'in' ELSE 'out' END AS inferred FROM (SELECT k, tx_type || ' ' || description || ' ' || counterparty AS t FROM d)")
def direction_infer(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = derived.frame(spark, sf_dir, derived.ORDERS)
    return d.select("k", classify.infer_direction(F.concat_ws(" ", "tx_type", "description", "counterparty")).alias("inferred"))


@query(f"WITH {D}, {K} SELECT k, category, CASE WHEN category IS NULL THEN 'none' ELSE 'rule' END AS category_source FROM led")
def category_first_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ledger(spark, sf_dir).select(F.col("seq.row").cast("long").alias("k"), "category", "category_source")


@query(f"WITH {D}, {K} SELECT k, CASE {' '.join(f'''WHEN category = '{k}' THEN '{v[0]}' ''' for k, v in L.CATEGORIES.items())} ELSE '{L.UNCATEGORISED}' END AS label FROM led")
def category_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    return categories.with_label(ledger(spark, sf_dir)).select(F.col("seq.row").cast("long").alias("k"), F.col("category_label").alias("label"))


# ---- refunds

P = "p AS (SELECT k, order_id, amount_minor FROM d WHERE order_id IS NOT NULL AND k % 4 <> 1)"


@query(f"WITH {D}, {R}, {P} SELECT r.k, r.part, p.order_id AS purchase, r.amount_minor AS refund_minor, p.amount_minor AS purchase_minor FROM r JOIN p ON starts_with(r.order_id, p.order_id)")
def refund_prefix_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = derived.refund_drafts(spark, sf_dir)
    m = refunds.prefix_matches(d.where(classify.is_refund()), d.where(~classify.is_refund()))
    return m.select(F.col("refund_seq.row").cast("long").alias("k"), F.col("refund_seq.part").alias("part"), F.col("order_id").alias("purchase"), "refund_minor", "purchase_minor")


@query(f"WITH {D}, {R}, {P} SELECT r.k, r.part FROM r WHERE NOT EXISTS (SELECT 1 FROM d WHERE d.order_id = left(r.order_id, 8) AND d.k % 4 = 1 AND {CLOSED})")
def refund_orphans_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    back = derived.refund_drafts(spark, sf_dir).where(classify.is_refund())
    closed = derived.order_drafts(spark, sf_dir).where(classify.is_closed() & (F.col("seq.row") % 4 == 1) & F.col("order_id").isNotNull())
    return refunds.orphans(back, closed).select(F.col("seq.row").cast("long").alias("k"), F.col("seq.part").alias("part"))


@query(f"""WITH {D}, {R}, {P}, x AS (SELECT r.k, r.part, r.amount_minor AS minor, p.amount_minor AS have, coalesce(sum(r.amount_minor) OVER (PARTITION BY r.k ORDER BY r.part ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
 FROM r LEFT JOIN p ON p.k = r.k)
SELECT k, part, CASE WHEN have IS NULL OR have <= before THEN 'unmatched' WHEN minor = have - before THEN 'paired' WHEN minor < have - before THEN 'partial' ELSE 'exceeds' END AS what FROM x""")
def refund_netting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return refunds.decisions(derived.refund_drafts(spark, sf_dir)).select(F.col("seq.row").cast("long").alias("k"), F.col("seq.part").alias("part"), "what")


# ---- transfers


@query(f"WITH l AS ({derived.duck(derived.LEGS)}) SELECT o.amount_minor, o.k || '-' || o.part AS out_id, i.k || '-' || i.part AS in_id, abs(o.epoch - i.epoch) AS distance FROM l o JOIN l i ON o.account = i.account AND o.amount_minor = i.amount_minor AND o.direction = 'out' AND i.direction = 'in' AND abs(o.epoch - i.epoch) <= 259200")
def transfer_candidates_interval(spark: SparkSession, sf_dir: str) -> DataFrame:
    return transfers.candidate_edges(derived.leg_rows(spark, sf_dir), scope=("account",)).drop("account")


@query()
def transfer_pairs_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = derived.leg_rows(spark, sf_dir)
    return transfers.exact_pairs(cut(rows, rows), scope=("account",))


@query()
def transfer_pairs_grouped(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = derived.leg_rows(spark, sf_dir)
    txs = rows.select("account", "id", "direction", "amount_minor", F.timestamp_seconds("epoch").alias("occurred_at"), "seq", F.lit("transfer-internal").alias("kind"), F.lit("x").alias("counterparty"), F.lit("x").alias("raw_description"), F.create_map().cast("map<string,string>").alias("meta"))
    return transfers.pair_transfers(txs, scope=("account",))


# ---- identity across imports

DEDUP = "n AS (SELECT *, row_number() OVER (PARTITION BY account, direction, amount_minor // 1000000 ORDER BY k) AS nth FROM d)"


def _prints_like(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders under a coarse key that repeats, in place of a fingerprint."""
    d = derived.frame(spark, sf_dir, derived.ORDERS)
    return d.withColumns({"fingerprint": F.concat_ws("|", "account", "direction", F.floor(F.col("amount_minor") / 1000000).cast("string")), "seq": F.struct(F.lit(0).alias("file"), F.col("k").cast("int").alias("row"), F.lit(0).alias("part"))})


@query(f"WITH {D}, {DEDUP} SELECT k, nth = 1 AS first FROM n")
def dedupe_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rec.first_in_batch(_prints_like(spark, sf_dir)).select("k", "first")


def _two_imports(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """A stored ledger without every third row, some categories set by hand and some amounts off; and the same rows imported again."""
    new = cut(ledger(spark, sf_dir))
    k = F.col("seq.row")
    old = new.where(k % 3 != 1).withColumn("amount_minor", F.when(k % 11 == 0, F.col("amount_minor") + 5).otherwise(F.col("amount_minor")))
    hand = k % 6 == 0
    return old.withColumns({"category": F.when(hand, "pet").otherwise(F.col("category")), "category_source": F.when(hand, "user").otherwise(F.col("category_source"))}), new


@query(f"WITH {D}, {K} SELECT k, CASE WHEN k % 3 = 1 THEN 'fresh' WHEN k % 11 = 0 THEN 'updated' ELSE 'duplicate' END AS what, CASE WHEN k % 3 <> 1 AND k % 11 = 0 AND k % 6 = 0 THEN 'pet' WHEN k % 3 <> 1 AND k % 11 <> 0 THEN NULL ELSE category END AS category FROM led")
def reconcile_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    old, new = _two_imports(spark, sf_dir)
    out = rec.reconcile(new, old)
    row = lambda df, what, cat: df.select(F.col("seq.row").cast("long").alias("k"), F.lit(what).alias("what"), cat.alias("category"))
    changed = out.updated.select("after.*")
    return row(out.fresh, "fresh", F.col("category")).unionByName(row(changed, "updated", F.col("category"))).unionByName(row(out.duplicates, "duplicate", F.lit(None).cast("string")))


@query(f"WITH {D}, {K} SELECT k FROM led WHERE k % 3 = 1")
def skip_existing_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    old, new = _two_imports(spark, sf_dir)
    return rec.reconcile(new, skip=old.select("fingerprint")).fresh.select(F.col("seq.row").cast("long").alias("k"))


@query(f"WITH {D}, {K} SELECT CAST(count_if(k % 3 = 1) AS BIGINT) AS inserted, CAST(count_if(k % 3 <> 1 AND k % 11 = 0) AS BIGINT) AS updated, CAST(count_if(k % 3 <> 1 AND k % 11 <> 0) AS BIGINT) AS duplicates FROM led")
def batch_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    old, new = _two_imports(spark, sf_dir)
    out = rec.reconcile(new, old)
    what = out.fresh.select(F.lit("i").alias("w")).unionByName(out.updated.select(F.lit("u").alias("w"))).unionByName(out.duplicates.select(F.lit("d").alias("w")))
    return what.agg(*[F.count_if(F.col("w") == v).alias(n) for v, n in (("i", "inserted"), ("u", "updated"), ("d", "duplicates"))])


@query(f"WITH {D}, {K} SELECT k, 'b-new' AS batch FROM led WHERE k % 3 = 1 OR k % 11 = 0")
def union_stamp(spark: SparkSession, sf_dir: str) -> DataFrame:
    old, new = _two_imports(spark, sf_dir)
    out = rec.reconcile(new, old)
    return build.saved_rows(out, "b-new").select(F.col("seq.row").cast("long").alias("k"), F.col("imported_batch_id").alias("batch"))


@query(f"WITH {D}, {K} SELECT k, 'amount ¥' || format('{{:,}}', (amount_minor + 5) // 100) || '.' || lpad(CAST((amount_minor + 5) % 100 AS VARCHAR), 2, '0') || ' -> ¥' || format('{{:,}}', amount_minor // 100) || '.' || lpad(CAST(amount_minor % 100 AS VARCHAR), 2, '0') AS changes FROM led WHERE k % 3 <> 1 AND k % 11 = 0")
def correction_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What corrections change, in words; a category set by hand is no change."""
    old, new = _two_imports(spark, sf_dir)
    out = rec.reconcile(new, old).updated
    return out.select(F.col("after.seq.row").cast("long").alias("k"), F.array_join("changes", "; ").alias("changes"))


def _stored(spark: SparkSession, rows: DataFrame) -> LedgerStore:
    """A store that holds the rows."""
    store = LedgerStore(spark, f"{shared_folder(spark)}/store-{uuid.uuid4().hex}")
    store.commit(transactions=rows)
    return store


def _out_of(store: LedgerStore, out: DataFrame) -> DataFrame:
    """The rows read out of a store that isn't needed any more."""
    out = cut(out)
    store.drop()
    return out


def _with_k(df: DataFrame, rows: DataFrame, *columns: str) -> DataFrame:
    return df.select("id", *columns).join(rows.select("id", F.col("seq.row").cast("long").alias("k")), "id").select("k", *columns)


@query(f"WITH {D}, {K} SELECT k FROM led WHERE k % 4 <> 2")
def undo_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = cut(ledger(spark, sf_dir))
    store = _stored(spark, rows)
    store.delete_batch("b2")
    return _out_of(store, _with_k(store.transactions(), rows))


@query(f"WITH {D}, {K} SELECT k, CASE WHEN k % 100 = 0 THEN 'travel' ELSE category END AS category, CASE WHEN k % 100 = 0 THEN 'user' WHEN category IS NULL THEN 'none' ELSE 'rule' END AS category_source FROM led")
def set_category(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = cut(ledger(spark, sf_dir))
    store = _stored(spark, rows)
    store.set_categories(rows.where(F.col("seq.row") % 100 == 0).select("id", F.lit("travel").alias("category")))
    return _out_of(store, _with_k(store.transactions(), rows, "category", "category_source"))


@query(f"WITH {D}, {K} SELECT k, CASE WHEN k % 3 = 1 OR k % 11 = 0 THEN 'b-new' ELSE 'b' || k % 4 END AS batch, amount_minor, CASE WHEN k % 3 <> 1 AND k % 6 = 0 THEN 'pet' ELSE category END AS category FROM led")
def store_import(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A second import into a store: what is known comes through its key index, fresh and corrected rows are saved under a new batch."""
    old, new = _two_imports(spark, sf_dir)
    store = _stored(spark, old)
    found = rec.reconcile(new, store.records)
    saved = build.saved_rows(found, "b-new")
    batch = spark.createDataFrame([("b-new",)], "id string").select(*[(F.col("id") if f.name == "id" else F.lit(None)).cast(f.dataType).alias(f.name) for f in BATCH.fields])
    store.save_import(batch, saved)
    return _out_of(store, _with_k(store.transactions().withColumnRenamed("imported_batch_id", "batch"), new, "batch", "amount_minor", "category"))


@query(f"WITH {D}, {K} SELECT k FROM led ORDER BY epoch DESC, k LIMIT 1000")
def store_newest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest rows of a store: its last months alone are read."""
    rows = cut(ledger(spark, sf_dir))
    rows = cut(rows.withColumn("id", F.format_string("%012d", F.col("seq.row"))))  # ids that break ties as the SQL does
    store = _stored(spark, rows)
    return _out_of(store, store.newest(reports.LIST_LIMIT).select(F.col("id").cast("long").alias("k")))


@query(f"WITH {D}, {K} SELECT k FROM led WHERE contains(lower(description || ' ' || counterparty || ' ' || coalesce(category, '')), 'team 游')")
def store_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A search in a store: only months whose texts hold all trigrams of the words are read."""
    rows = cut(ledger(spark, sf_dir))
    store = _stored(spark, rows)
    return _out_of(store, _with_k(store.search("Team 游"), rows))


@query(f"WITH {D}, {K} SELECT month, CAST(sum(CASE WHEN kind = 'expense' THEN amount_minor ELSE 0 END) AS BIGINT) AS expense_minor, CAST(sum(CASE WHEN kind = 'income' THEN amount_minor ELSE 0 END) AS BIGINT) AS income_minor, count_if(kind = 'expense') AS expense_count, CAST(sum(CASE WHEN kind = 'income' THEN amount_minor ELSE -amount_minor END) AS BIGINT) AS net_minor FROM led WHERE kind IN ('expense', 'income') AND k % 4 <> 2 GROUP BY month")
def store_month_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Month totals out of a store's pointer, after a batch was undone: no rows are read."""
    rows = ledger(spark, sf_dir)
    store = _stored(spark, rows)
    store.delete_batch("b2")
    return _out_of(store, store.month_totals())


@query(f"WITH {D}, {K}, w AS (SELECT k, lower(counterparty || '|' || description) AS fields FROM led), c AS (SELECT k, {CATEGORY} AS found FROM w) SELECT k, CASE WHEN k % 100 = 0 THEN 'travel' ELSE found END AS category, CASE WHEN k % 100 = 0 THEN 'user' WHEN found IS NULL THEN 'none' ELSE 'rule' END AS category_source FROM c")
def recategorise(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Categories decided anew over rows whose categories are stale: a user's choice stays, all else follows the rules."""
    k = F.col("seq.row")
    stale = ledger(spark, sf_dir).withColumns({"category": F.when(k % 100 == 0, "travel").otherwise(F.lit("pet")), "category_source": F.when(k % 100 == 0, "user").otherwise(F.lit("rule"))})
    return categories.recategorised(stale).select(k.cast("long").alias("k"), "category", "category_source")


# ---- reports


@query(f"WITH {D}, {K} SELECT month, CAST(sum(CASE WHEN kind = 'expense' THEN amount_minor ELSE 0 END) AS BIGINT) AS expense_minor, CAST(sum(CASE WHEN kind = 'income' THEN amount_minor ELSE 0 END) AS BIGINT) AS income_minor, count_if(kind = 'expense') AS expense_count, CAST(sum(CASE WHEN kind = 'income' THEN amount_minor ELSE -amount_minor END) AS BIGINT) AS net_minor FROM led WHERE kind IN ('expense', 'income') GROUP BY month")
def month_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.month_totals(ledger(spark, sf_dir))


SPEND = "sp AS (SELECT month, coalesce(category, '__uncategorised') AS category, CAST(sum(amount_minor) AS BIGINT) AS amount_minor, count(*) AS n FROM led WHERE kind = 'expense' GROUP BY ALL)"


@query(f"WITH {D}, {K}, {SPEND} SELECT * FROM sp")
def spend_by_category(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.spend_by_category(ledger(spark, sf_dir), reports.month().alias("month"))


@query(f"WITH {D}, {K}, {SPEND} SELECT month, category, amount_minor, n, CAST(floor(amount_minor * 100 / sum(amount_minor) OVER (PARTITION BY month) + 0.5) AS BIGINT) AS share_pct, CAST(floor(amount_minor * 100 / max(amount_minor) OVER (PARTITION BY month) + 0.5) AS BIGINT) AS bar_pct FROM sp")
def category_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.category_share(spend_by_category(spark, sf_dir), "month")


@query(f"WITH {D}, {K} SELECT month, CAST(sum(CASE WHEN kind = 'expense' THEN amount_minor ELSE 0 END) AS BIGINT) AS expense_minor, CAST(sum(CASE WHEN kind = 'expense' THEN 0 ELSE amount_minor END) AS BIGINT) AS income_minor FROM led WHERE kind IN ('expense', 'income') GROUP BY month ORDER BY month DESC LIMIT 12")
def trend_12_months(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.trend(ledger(spark, sf_dir))


@query(f"WITH {D}, {K} SELECT k FROM led WHERE kind = 'expense' AND contains(lower(description || ' ' || counterparty || ' ' || coalesce(category, '')), 'steam') ORDER BY epoch DESC, k LIMIT 1000")
def list_filter_top1000(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = reports.listed(ledger(spark, sf_dir), kind="expense", search="Steam")
    return found.orderBy(F.desc("occurred_at"), "seq").limit(reports.LIST_LIMIT).select(F.col("seq.row").cast("long").alias("k"))


@query(f"WITH {D}, {K} SELECT DISTINCT month FROM led")
def distinct_months(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.distinct_months(ledger(spark, sf_dir))


@query(f"WITH {D}, {K} SELECT count(*) AS n, CAST(sum(CASE WHEN kind = 'expense' THEN amount_minor ELSE 0 END) AS BIGINT) AS expense_minor, CAST(sum(CASE WHEN kind = 'income' THEN amount_minor ELSE 0 END) AS BIGINT) AS income_minor, count_if(kind NOT IN ('expense', 'income')) AS non_cashflow, CAST(sum(CASE WHEN kind = 'income' THEN amount_minor WHEN kind = 'expense' THEN -amount_minor ELSE 0 END) AS BIGINT) AS net_minor FROM led")
def totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.totals(ledger(spark, sf_dir))


@query(f"WITH {D}, {K} SELECT k, CASE WHEN direction = 'in' THEN '+' ELSE '-' END || '¥' || format('{{:,}}', amount_minor // 100) || '.' || lpad(CAST(amount_minor % 100 AS VARCHAR), 2, '0') AS shown, CASE kind {' '.join(f'''WHEN '{k}' THEN '{v}' ''' for k, v in L.KIND_LABELS.items())} END AS kind_label, CASE WHEN netted IS NOT NULL THEN '已抵扣部分退款 ¥1.00，原 ¥' || format('{{:,}}', (amount_minor + netted) // 100) || '.' || lpad(CAST((amount_minor + netted) % 100 AS VARCHAR), 2, '0') END AS note FROM led")
def display_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ledger(spark, sf_dir).select(F.col("seq.row").cast("long").alias("k"), reports.signed_amount().alias("shown"), reports.kind_label().alias("kind_label"), reports.netted_note().alias("note"))


# ---- grids and texts

GRID = """SELECT CAST(o_orderkey AS INT) AS file, r.i AS row FROM {orders} CROSS JOIN (SELECT 0 AS i UNION ALL SELECT 1 UNION ALL SELECT 2 UNION ALL SELECT 3) r"""


def _grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A grid of four rows an order: a title, a header at one of two places, and data."""
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    head = F.array(*[F.lit(x) for x in ("交易时间", "收/支", "金额", "备注", "金额")])
    title = F.array(F.lit("title"), F.col("o_orderpriority"))
    data = F.array(F.col("o_orderstatus"), F.lit("支出"), F.col("o_custkey").cast("string"), F.col("o_orderpriority"))
    rows = F.when(F.col("o_orderkey") % 2 == 0, F.array(title, head, data, data)).otherwise(F.array(title, title, head, data))
    return o.select(F.col("o_orderkey").alias("file"), F.posexplode(rows).alias("row", "cells"))


@query("SELECT o_orderkey AS file, CASE WHEN o_orderkey % 2 = 0 THEN 1 ELSE 2 END AS header_row FROM orders")
def header_detect(spark: SparkSession, sf_dir: str) -> DataFrame:
    return containers.detect_header(_grid(spark, sf_dir)).select("file", "header_row")


@query("SELECT o_orderkey AS file, CASE WHEN o_orderkey % 2 = 0 THEN n + 2 ELSE 3 END AS row, CAST(o_custkey AS VARCHAR) AS amount, '' AS missing FROM orders, (SELECT unnest([0, 1]) AS n) WHERE o_orderkey % 2 = 0 OR n = 0")
def column_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = platforms.data_rows(_grid(spark, sf_dir), "交易时间")
    get = lambda n: containers.cell(F.col("header"), F.col("cells"), n)
    return d.select("file", "row", get("金额").alias("amount"), get("商户").alias("missing"))


@query("""SELECT page_id, length(t) AS n_chars, md5(t) AS digest FROM (SELECT page_id, replace(replace(replace(replace(replace(replace(regexp_replace(regexp_replace(html, '<(?i:br)\\s*/?>', ' ', 'g'), '<[^>]*>', ' ', 'g'), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&nbsp;', chr(160)), '&apos;', ''''), '&amp;', '&') AS t FROM pages)""")
def html_strip_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = spark.read.parquet(f"{sf_dir}/pages.parquet")
    p = p.select("page_id", text.decode_entities(text.strip_tags(F.col("html"))).alias("t"))
    return p.select("page_id", F.length("t").cast("long").alias("n_chars"), F.md5("t").alias("digest"))


@query(r"SELECT doc_id, regexp_matches(text, '(^|[^\d.])\d{16,19}($|[^\d.])') AS card, regexp_matches(text, '(^|[^\d])\d{17}[\dXx]($|[^\d])') AS resident FROM documents")
def pii_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return d.select("doc_id", F.col("text").rlike(guard.CARD_NUMBER).alias("card"), F.col("text").rlike(guard.RESIDENT_ID).alias("resident"))


@query(r"SELECT doc_id, CAST(len(list_filter(regexp_split_to_array(text, '\r?\n'), lambda x: regexp_matches(x, '20\d{2}\s*[-/年]\s*\d{1,2}\s*[-/月]\s*\d{1,2}') AND regexp_matches(x, '\d+\.\d{2}'))) AS INTEGER) AS n FROM documents")
def statement_line_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", guard.statement_lines(F.col("text")).alias("n"))


@query("""WITH e AS (SELECT o_custkey AS archive, o_orderkey AS no, CASE o_orderkey % 5 WHEN 0 THEN 'readme.txt' WHEN 1 THEN 'data/alipay.csv' WHEN 2 THEN '__MACOSX/x.csv' WHEN 3 THEN 'a.xlsx' ELSE 'note.md' END AS name FROM orders),
s AS (SELECT *, CASE no % 5 WHEN 0 THEN 26 WHEN 1 THEN 65 WHEN 3 THEN 50 END AS score FROM e)
SELECT archive, arg_max(name, CAST(score AS BIGINT) * 1000000000 - no) AS name, CAST(max(score) AS INTEGER) AS score FROM s WHERE score IS NOT NULL GROUP BY archive""")
def archive_top1(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    name = F.element_at(F.array(*[F.lit(x) for x in ("readme.txt", "data/alipay.csv", "__MACOSX/x.csv", "a.xlsx", "note.md")]), (F.col("o_orderkey") % 5 + 1).cast("int"))
    e = o.select(F.col("o_custkey").alias("archive"), F.col("o_orderkey").alias("no"), name.alias("name")).withColumn("score", containers.archive_score(F.col("name"))).where("score is not null")
    return e.groupBy("archive").agg(F.max_by("name", F.struct("score", -F.col("no"))).alias("name"), F.max("score").cast("int").alias("score"))


@query("WITH g AS (SELECT o_custkey AS page, y - lead(y) OVER (PARTITION BY o_custkey ORDER BY y DESC) AS gap FROM (SELECT DISTINCT o_custkey, CAST(o_orderkey AS DOUBLE) AS y FROM orders)) SELECT page, median(gap) AS pitch FROM g GROUP BY page")
def pdf_median_pitch(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.col("o_custkey").alias("page"), F.col("o_orderkey").cast("double").alias("y"), F.lit(True).alias("rowlike")).distinct()
    return glyphs.pitch(o, "page")


@query("WITH s AS (SELECT * FROM (VALUES (0, -1e308, 3000.0), (1, 3000.0, 9000.0), (2, 9000.0, 1e308)) t(col, lo, hi)), r AS (SELECT o_orderkey AS k, CAST(o_orderkey % 12000 AS DOUBLE) AS x, CAST(o_custkey AS DOUBLE) AS width FROM orders) SELECT k, x, width, arg_max(col, least(x + width, hi) - greatest(x, lo) - col * 1e-9) AS col FROM r, s GROUP BY k, x, width")
def pdf_column_assign(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.col("o_orderkey").alias("k"), (F.col("o_orderkey") % 12000).cast("double").alias("x"), F.col("o_custkey").cast("double").alias("width"))
    spans = F.array(*[F.struct(F.lit(lo).alias("lo"), F.lit(hi).alias("hi")) for lo, hi in ((-1e308, 3000.0), (3000.0, 9000.0), (9000.0, 1e308))])
    return o.distinct().withColumn("col", glyphs.column_of(F.col("x"), F.col("width"), spans))


#: Statements as positioned text: a file a customer, twenty orders a page.  r: an order's place in its file.
SHEET = """SELECT o_custkey AS file, CAST((r - 1) {div} 20 AS INT) AS page, CAST((r - 1) % 20 AS INT) AS line, r, k, day, amount, note FROM (
 SELECT o_custkey, o_orderkey AS k, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey, o_orderdate, o_totalprice) AS r, substring(CAST(o_orderdate AS VARCHAR(10)), 1, 10) AS day,
 CAST(CAST(round(o_totalprice * 100) AS BIGINT) AS VARCHAR(20)) AS amount, CASE o_orderkey % 3 WHEN 0 THEN '午餐' WHEN 1 THEN 'bus fare' ELSE '' END AS note FROM {orders})"""


@query(f"""WITH s AS ({SHEET.format(div='//', orders='orders')})
SELECT file, CAST(0 AS INTEGER) AS row, '交易日期|金额|附言' AS cells FROM (SELECT DISTINCT file FROM s)
UNION ALL SELECT file, CAST(r AS INTEGER), day || '|' || amount || '|' || CASE WHEN k % 5 = 0 AND note <> '' THEN note || CASE WHEN k % 3 = 0 THEN '外卖' ELSE ' home' END ELSE note END FROM s""")
def glyph_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statements laid out as positioned text and rebuilt: notes that wrap, dashes for nothing, a run across two columns, page numbers, headers on each page
    of every other file and on the first page only of the others."""
    s = spark.sql(SHEET.replace("{div}", "div"), orders=spark.read.parquet(f"{sf_dir}/orders.parquet"))
    k, top = F.col("k"), F.lit(700.0) - 18.0 * (F.col("line") + 1)
    run = lambda t, x, y, w, when=F.lit(True): F.when(when, F.struct(t.alias("text"), F.lit(x).alias("x"), y.alias("y"), F.lit(w).alias("width")))
    wide, wraps = k % 7 == 0, (k % 5 == 0) & (F.col("note") != "")
    rows = s.select("file", "page", F.explode(F.array_compact(F.array(
        run(F.col("day"), 40.0, top + k % 3 - 1, 50.0, ~wide),
        run(F.col("amount"), 150.0, top, 30.0, ~wide),
        run(F.concat_ws("    ", "day", "amount"), 40.0, top, 170.0, wide),
        run(F.when(F.col("note") == "", "----").otherwise(F.col("note")), 250.0, top, 40.0),
        run(F.when(k % 3 == 0, "外卖").otherwise("home"), 250.0, top - 8, 20.0, wraps),
    ))).alias("g"))
    heads = s.groupBy("file", "page").agg(F.max("line").alias("last")).where("page = 0 or file % 2 = 0")
    heads = heads.select("file", "page", F.explode(F.array(*[run(F.lit(t), x, F.lit(700.0), 36.0) for t, x in (("交易日期", 40.0), ("金额", 150.0), ("附言", 250.0))])).alias("g"))
    feet = s.groupBy("file", "page").agg(F.max("line").alias("line")).where("line > 1").select("file", "page", run(F.lit("第1页"), 40.0, top - 60.0, 30.0).alias("g"))
    grid = glyphs.read_glyphs(rows.unionByName(heads).unionByName(feet).select("file", "page", "g.*"), max_pages=None)
    return grid.select("file", "row", F.array_join("cells", "|").alias("cells"))


FEE_NOTES = "SELECT o_orderkey AS k, CASE o_orderkey % 4 WHEN 0 THEN '服务费 ¥0.50，已扣' WHEN 1 THEN '备注；手续费：12.3' WHEN 2 THEN '/' ELSE '利息' END AS note FROM {orders}"


@query("SELECT o_orderkey AS k, CASE o_orderkey % 4 WHEN 0 THEN 50 WHEN 1 THEN 1230 END AS fee, CASE o_orderkey % 4 WHEN 0 THEN '已扣' WHEN 1 THEN '备注' END AS rest FROM orders")
def service_fee(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = spark.sql(FEE_NOTES, orders=spark.read.parquet(f"{sf_dir}/orders.parquet"))
    fee, rest = platforms.service_fee(F.col("note"))
    return d.select("k", fee.cast("int").alias("fee"), F.when(fee.isNotNull(), rest).alias("rest"))


#: Statements of four layouts, a file a customer: what stands in each line, and what it says.
LINES = """SELECT o_custkey AS file, o_orderkey AS k, CAST(o_custkey % 4 AS INT) AS layout, CASE WHEN o_orderkey % 3 = 0 THEN 'in' ELSE 'out' END AS direction, CAST(round(o_totalprice * 100) AS BIGINT) AS minor,
 substring(CAST(o_orderdate AS VARCHAR(10)), 1, 10) AS day, EPOCH(o_orderdate) AS epoch, CASE WHEN o_custkey % 4 < 2 AND o_orderkey % 5 = 0 THEN 'a, "b" ' WHEN o_custkey % 4 = 3 AND o_orderkey % 5 = 0 THEN 'x & y ' ELSE 'item ' END || CAST(o_orderkey AS VARCHAR(20)) AS what FROM {orders}"""


@query(f"""WITH l AS ({derived.duck(LINES)}) SELECT CAST(file AS INTEGER) AS file, CASE layout WHEN 1 THEN 'wechat' WHEN 2 THEN 'generic:demo-bank@2026-09' ELSE 'alipay' END AS source, what AS description, direction, minor AS amount_minor,
epoch + CASE layout WHEN 1 THEN 5400 WHEN 2 THEN -28800 ELSE 0 END AS epoch, 'shop' AS counterparty, CASE WHEN layout <> 2 THEN CAST(k AS VARCHAR) END AS order_id FROM l""")
def import_statements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statement files of four layouts (two platforms' delimited text, a bank's with semicolons, an HTML table) from bytes to drafts: containers, delimiters,
    quotes, tabs, header rows, platforms and templates."""
    d = derived.frame(spark, sf_dir, LINES)
    money_ = money.decimal_string(F.col("minor"))
    side = F.when(F.col("direction") == "in", "收入").otherwise("支出")
    quoted = F.when(F.col("what").contains('"'), F.concat(F.lit('"'), F.replace(F.col("what"), F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(F.col("what"))
    cells = [F.concat(F.col("day"), F.lit(" 08:00:00")), F.lit("消费"), F.lit("shop"), F.lit("a@x.test"), F.replace(F.col("what"), F.lit("&"), F.lit("&amp;")), side, money_, F.lit("余额"), F.lit("交易成功"), F.col("k").cast("string"), F.lit("")]
    head = ["交易时间", "交易分类", "交易对方", "对方账号", "商品说明", "收/支", "金额", "收/付款方式", "交易状态", "交易订单号", "商家订单号"]
    line = (
        F.when(F.col("layout") == 0, F.concat_ws(",", *cells[:4], quoted, *cells[5:]))
        .when(F.col("layout") == 1, F.concat_ws(",", F.concat(F.col("day"), F.lit(" 09:30:00")), F.lit("商户消费"), F.lit("shop"), quoted, side, F.concat(F.lit("¥"), money_), F.lit("零钱"), F.lit("支付成功"), F.concat(F.lit("\t"), F.col("k")), F.lit("m"), F.lit("/")))
        .when(F.col("layout") == 2, F.concat_ws(";", "day", "what", F.lit("shop"), F.when(F.col("direction") == "in", money_).otherwise(""), F.when(F.col("direction") == "in", "").otherwise(money_), F.lit(""), F.lit("成功")))
        .otherwise(F.concat(F.lit("<tr><td>"), F.concat_ws("</td><td>", *cells), F.lit("</td></tr>")))
    )
    body = F.array_join(F.sort_array(F.collect_list(F.struct("k", line.alias("line"))))["line"], "\n")
    files = d.groupBy("file", "layout").agg(body.alias("body"))
    lead = F.when(F.col("layout") == 0, "明细查询\r\n账号:[x]\n\n" + ",".join(head) + "\r\n").when(F.col("layout") == 1, "标题\n交易时间,交易类型,交易对方,商品,收/支,金额(元),支付方式,当前状态,交易单号,商户单号,备注\n").when(F.col("layout") == 2, "交易日期;摘要;对方户名;收入;支出;余额;交易状态\n").otherwise("<html><table><tr><th>" + "</th><th>".join(head) + "</th></tr>")
    content = F.encode(F.concat(lead, "body", F.when(F.col("layout") == 3, "</table></html>").otherwise("")), "UTF-8")
    whole = cut(containers.parsed(files.select(F.col("file").cast("int").alias("file"), F.concat_ws("/", F.lit("in"), "file").alias("path"), content.alias("content"))))
    grid = containers.grids_of(whole)
    bank = next(t for t in platforms.STARTER_TEMPLATES if t.id == "demo-bank@2026-09")
    drafts = platforms.parse(grid.where("platform = 'alipay'"), "alipay", "acc")[0].unionByName(platforms.parse(grid.where("platform = 'wechat'"), "wechat", "acc")[0]).unionByName(platforms.parse(grid.where("platform is null"), None, "acc", bank)[0])
    return drafts.select(F.col("seq.file").alias("file"), "source", "description", "direction", "amount_minor", dates.epoch_seconds(F.col("occurred_at")).alias("epoch"), "counterparty", "order_id")


# ---- whole operators that SQL can't express


@query()
def import_pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over all drafts, an import a customer: pairing, refunds, subset sums and repeated fingerprints stay inside it."""
    done = build.build_transactions(derived.order_drafts(spark, sf_dir), "b1", scope=("account_id",), fold=text.nfkc_native)
    return done.transactions.select("id", "account_id", "kind", "category", "amount_minor", "direction")


@query()
def snapshot_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nation table sealed and opened again."""
    doc = snapshot.payload(spark.read.parquet(f"{sf_dir}/nation.parquet"))
    back = snapshot.decrypt(spark, snapshot.encrypt(spark, doc, "a long enough passphrase"), "a long enough passphrase")
    return spark.createDataFrame([(r["n_nationkey"], r["n_name"]) for r in back["transactions"]], "n_nationkey long, n_name string")
