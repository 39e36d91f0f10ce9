"""Benchmark decontamination by winnowing, in DataFrame functions only.

A window is ``window`` consecutive words of a benchmark item (a shorter item is one window).  Texts are cut into
overlapping runs of words, so that long texts cost as much a word as short ones.  In each run the hashes of ``gram``-word grams are
winnowed: of every window's grams the least hash is kept, so any shared window has the same fingerprint on both
sides (a guarantee, not a chance).  Fingerprints of the corpus meet those of the benchmark; hits are extended to the windows they stand
for, which are compared word by word in an equi-join, so that no pairs of positions arise.  Only runs with a hit leave
their task.

The benchmark side is broadcast up to ``broadcast_rows`` windows (counted first); beyond that only keys are shuffled to find the runs.

Defined cases: null or word-less texts have no words, hits or items; null or word-less items have no window; items with one
id count as one; a null item_id takes no part; repeated rows and null doc_ids give a row each; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize

BREAKS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z only; pure ASCII takes the fast way."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(ascii_lower(F.coalesce(text, F.lit(""))), BREAKS), "")


def _grams(words: str, n: int) -> str:
    """Hashes of the n-word grams of an array of at least n words."""
    return f"transform(sequence(1, size({words}) - {n - 1}), i -> xxhash64(slice({words}, i, {n})))"


def _winnowed(words: str, window: int, gram: int) -> str:
    # transform(array(x), h -> ...)[0] binds h once; a column for it would be inlined into the inner function and computed for every i
    inner = f"transform(sequence(1, size({words}) - {window - 1}), i -> array_min(slice(h, i, {window - gram + 1})))"
    return f"CASE WHEN size({words}) >= {window} THEN transform(array({_grams(words, gram)}), h -> {inner})[0] END"


def _joined(words: str, at: str, n: str) -> str:
    return f"array_join(slice({words}, {at}, {n}), ' ')"


def benchmark_windows(benchmark: DataFrame, window: int, gram: int, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """(item_id as text, len, win, fp): the distinct windows of each item with their fingerprints."""
    items = benchmark.select(F.col(id_col).cast("string").alias("item"), words_of(F.col(text_col)).alias("w")).where("item is not null and size(w) > 0")
    each = f"transform(sequence(1, size(w) - {window - 1}), i -> struct({_joined('w', 'i', str(window))} AS win, array_min(slice(h, i, {window - gram + 1})) AS fp))"
    long = items.where(f"size(w) >= {window}").select("item", F.lit(window).alias("len"), F.explode(F.expr(f"transform(array({_grams('w', gram)}), h -> {each})[0]")).alias("x"))
    short = items.where(f"size(w) < {window}").select("item", F.expr("size(w)").alias("len"), F.expr("struct(array_join(w, ' ') AS win, xxhash64(w) AS fp)").alias("x"))
    return long.unionByName(short).select("item", "len", "x.win", "x.fp").distinct()


def find(docs: DataFrame, benchmark: DataFrame, window: int = 10, gram: int = 5, run: int = 64, broadcast_rows: int = 500_000, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """(doc_id, key, n_words, n_hit, n_items, items_sha256, contaminated) for each document; key: a hash of the text that tells documents of one id apart."""
    bench = materialize(benchmark_windows(benchmark, window, gram), "bench")
    n_bench = bench.count()
    lengths = sorted(r["len"] for r in bench.select("len").distinct().collect())  # at most `window` numbers
    small = n_bench <= broadcast_rows
    held = (lambda df: F.broadcast(df)) if small else (lambda df: df)  # a proven bound: n_bench rows of one window each

    base = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).withColumn("key", F.xxhash64("text"))
    # no filter on the words: it would be pushed below and split the text a second time
    runs = base.select("doc_id", "key", words_of(F.col("text")).alias("w"))
    cut = f"CASE WHEN size(w) > 0 THEN transform(sequence(0, (size(w) - 1) div {run}), c -> struct(c * {run} AS at, slice(w, c * {run} + 1, {run + window - 1}) AS w)) END"
    runs = runs.select("doc_id", "key", F.explode(F.expr(cut)).alias("r")).select("doc_id", "key", "r.at", "r.w")

    marks = []
    for n in lengths:
        if n == window:
            marks.append(f"CASE WHEN size(w) >= {n} THEN transform(array_distinct(m), x -> struct({n} AS len, x AS fp)) ELSE array() END")
        else:
            marks.append(f"CASE WHEN size(w) >= {n} THEN transform(array_distinct({_grams('w', n)}), x -> struct({n} AS len, x AS fp)) ELSE array() END")
    if not marks:
        hits = base.where(F.lit(False)).select("doc_id", "key", F.lit(0).cast("long").alias("start"), F.lit(0).alias("len"), F.lit("").alias("win"))
    else:
        hashed = runs.withColumn("m", F.expr(_winnowed("w", window, gram))) if window in lengths else runs
        marked = hashed.select("doc_id", "key", "at", "w", F.explode(F.expr(f"concat({', '.join(marks)})")).alias("x")).select("doc_id", "key", "at", "w", "x.len", "x.fp")
        wanted = bench.select("len", "fp").distinct()
        if small:
            met = marked.join(held(wanted), ["len", "fp"], "left_semi")
        else:
            # keys first; the words follow only for the runs that were hit
            pairs = marked.select("doc_id", "key", "at", "len", "fp").join(wanted, ["len", "fp"], "left_semi").distinct()
            met = runs.alias("r").join(pairs.alias("p"), F.expr("r.doc_id <=> p.doc_id AND r.key = p.key AND r.at = p.at")).select("r.doc_id", "r.key", "r.at", "r.w", "p.len", "p.fp")
        # a hit is extended to the windows whose fingerprint it is, each of which has one fingerprint
        own = f"CASE WHEN len = {window} THEN array_min(transform(sequence(i, i + {window - gram}), j -> xxhash64(slice(w, j, {gram})))) ELSE xxhash64(slice(w, i, len)) END"
        spots = f"filter(sequence(1, size(w) - len + 1), i -> fp = {own})"
        found = met.select("doc_id", "key", "at", "w", "len", F.explode(F.expr(spots)).alias("i")).select("doc_id", "key", F.expr("CAST(at + i - 1 AS bigint)").alias("start"), "len", F.expr(_joined("w", "i", "len")).alias("win"))
        hits = found.join(held(bench.select("len", "win").distinct()), ["len", "win"], "left_semi").select("doc_id", "key", "start", "len", "win")
    hits = materialize(hits, "hits")

    spots = hits.select("doc_id", "key", F.explode(F.sequence("start", F.col("start") + F.col("len") - 1)).alias("word")).distinct()
    n_hit = spots.groupBy("doc_id", "key").agg(F.count(F.lit(1)).alias("n_hit"))
    items = hits.select("doc_id", "key", "len", "win").distinct().join(held(bench.select("item", "len", "win")), ["len", "win"]).select("doc_id", "key", "item").distinct()
    items = items.groupBy("doc_id", "key").agg(F.count(F.lit(1)).alias("n_items"), F.sha2(F.array_join(F.array_sort(F.collect_list("item")), ","), 256).alias("items_sha256"))
    per_doc = materialize(n_hit.alias("h").join(items.alias("i"), F.expr("h.doc_id <=> i.doc_id AND h.key = i.key")).select("h.doc_id", "h.key", "n_hit", "n_items", "items_sha256"), "hit-docs")
    counted = base.select("doc_id", "key", F.size(words_of(F.col("text"))).cast("long").alias("n_words"))
    out = counted.alias("d").join(per_doc.alias("p"), F.expr("d.doc_id <=> p.doc_id AND d.key = p.key"), "left")
    zero = F.lit(0).cast("long")
    return out.select("d.doc_id", "d.key", "n_words", F.coalesce("n_hit", zero).alias("n_hit"), F.coalesce("n_items", zero).alias("n_items"), F.coalesce("items_sha256", F.sha2(F.lit(""), 256)).alias("items_sha256"), F.col("n_hit").isNotNull().alias("contaminated"))
