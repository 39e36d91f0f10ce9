"""The registered queries of the corpus operators, and DuckDB SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table


OP1 = """
WITH v AS (
  SELECT DISTINCT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS DOUBLE)) AS e
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_inner_product(q.e, c.e) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.e) = len(c.e)
  WHERE q.vec_id % 50 = 0
), r AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS n FROM s
)
SELECT query_id, CAST(n AS INTEGER) AS rank, vec_id, score FROM r WHERE n <= 5
"""


def op1_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import topk

    return topk.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


OP2 = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents
), b AS (
  SELECT CAST(item_id AS VARCHAR) AS item,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark WHERE item_id IS NOT NULL
), bl AS (
  SELECT item, w, least(len(w), 10) AS n FROM b WHERE len(w) > 0
), bw AS (
  SELECT DISTINCT item, n, array_to_string(list_slice(w, i, i + n - 1), ' ') AS win
  FROM (SELECT item, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM bl)
), dw AS (
  SELECT r, n, i, array_to_string(list_slice(w, i, i + n - 1), ' ') AS win
  FROM (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM bl) WHERE len(w) >= n)
), hit AS (
  SELECT r, n, i, win FROM dw SEMI JOIN bw USING (n, win)
), h AS (
  SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(i, i + n)) AS p FROM hit) GROUP BY r
), it AS (
  SELECT r, count(*) AS n_items, sha256(string_agg(item, ',' ORDER BY item COLLATE "C")) AS items_sha256
  FROM (SELECT DISTINCT r, item FROM hit JOIN bw USING (n, win)) GROUP BY r
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       coalesce(items_sha256, sha256('')) AS items_sha256, n_hit IS NOT NULL AS contaminated
FROM d LEFT JOIN h USING (r) LEFT JOIN it USING (r)
"""


def op2_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import decontaminate

    return decontaminate.find(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("key")


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import lines

    out = lines.dedup(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_lines", "n_removed", F.char_length("text").cast("long").alias("n_chars"), F.sha2("text", 256).alias("text_sha256"))


def op4_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import secrets_scan

    return secrets_scan.scan(table(spark, sf_dir, "documents"), path_col="source")


def op5_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import simhash

    out = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op6_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import html_text

    return html_text.extract(table(spark, sf_dir, "pages"))


def op7_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import quality

    return quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import packing

    return packing.pack(table(spark, sf_dir, "documents"))


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import langid

    return langid.identify(table(spark, sf_dir, "documents"))


def op10_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import substrings

    return substrings.remove_repeats(table(spark, sf_dir, "documents"))


OP11 = r"""
WITH o AS (
  SELECT conv_id AS c, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, sha256(CAST(strlen(coalesce(role, '')) AS VARCHAR) || ' ' || coalesce(role, '') || coalesce(text, ''))) - 1 AS pos,
         coalesce(role, '') AS role, coalesce(text, '') AS text
  FROM conversations WHERE conv_id IS NOT NULL
), s AS (
  SELECT c, count(*) AS own, c - c % 20 AS base,
         xor(list_reduce(list_prepend(4294967295::UBIGINT, flatten(list_transform(string_split(CAST(c AS VARCHAR), ''), lambda x: [ascii(x)::UBIGINT, 256, 256, 256, 256, 256, 256, 256, 256]))),
             lambda a, x: CASE WHEN x < 256 THEN xor(a, x) ELSE xor(a >> 1, 3988292384::UBIGINT * (a & 1)) END), 4294967295::UBIGINT) % 4 AS h
  FROM o GROUP BY c
), v AS (
  SELECT s.c, s.base, s.h, s.own, least(s.h, coalesce(b.own, 0)) AS taken, least(s.h, coalesce(b.own, 0)) + greatest(s.own - CAST(s.h AS BIGINT), 0) AS n FROM s LEFT JOIN s b ON b.c = s.base
), r AS (
  SELECT v.c, o.pos, o.role, o.text, v.n FROM v JOIN o ON o.c = v.base AND o.pos < v.h
  UNION ALL SELECT v.c, o.pos - v.h + v.taken, o.role, o.text, v.n FROM v JOIN o ON o.c = v.c AND o.pos >= v.h
), p AS (
  SELECT c, pos + 1 AS depth, list({'r': role, 't': text}) OVER (PARTITION BY c ORDER BY pos) AS k, len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) AS words, n FROM r
  UNION ALL SELECT c, 0, [], 0, n FROM v
), m AS (
  SELECT c, depth, words, n, min(c) OVER (PARTITION BY depth, k) AS node FROM p
), g AS (
  SELECT node, depth, count(*) AS n_convs, max(words) AS words,
         sha256(coalesce(string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) FILTER (WHERE n = depth), '')) AS ends
  FROM m GROUP BY node, depth
), e AS (
  SELECT g.*, m.node AS parent FROM g LEFT JOIN m ON m.c = g.node AND m.depth = g.depth - 1
), f AS (
  SELECT e.*, coalesce(k.n_children, 0) AS n_children
  FROM e LEFT JOIN (SELECT parent AS node, depth - 1 AS depth, count(*) AS n_children FROM e WHERE depth > 0 GROUP BY ALL) k USING (node, depth)
), t AS (
  SELECT m.node, m.depth, count(*) FILTER (WHERE f.n_children = 0) AS n_leaves, sum((f.n_convs - 1) * f.words) AS saved
  FROM f JOIN m ON m.c = f.node AND m.depth <= f.depth GROUP BY m.node, m.depth
)
SELECT CAST(node AS BIGINT) AS conv_id, CAST(depth AS BIGINT) AS depth, CAST(parent AS BIGINT) AS parent_conv_id, CAST(n_convs AS BIGINT) AS n_convs, CAST(n_children AS BIGINT) AS n_children,
       CAST(n_leaves AS BIGINT) AS n_leaves, CAST(saved AS BIGINT) AS saved_tokens, ends AS ends_sha256
FROM f JOIN t USING (node, depth)
"""


def op11_conversation_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import prefix_trie

    return prefix_trie.conversation_trie(table(spark, sf_dir, "conversations"), branch=True)


def op12_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import jaccard

    return jaccard.components(table(spark, sf_dir, "documents"))


def op13_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import whitening

    return whitening.whiten(table(spark, sf_dir, "embeddings"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_exact_topk, op2_benchmark_decontamination, op3_line_dedup, op4_secret_scan, op5_simhash_near_dedup, op6_html_extraction, op7_quality_classifier, op8_best_fit_packing, op9_language_id, op10_suffix_array_dedup, op11_conversation_prefix_trie, op12_ngram_jaccard_join, op13_embedding_whitening)}


def oracle_sql() -> dict[str, str]:
    return {"op1_exact_topk": OP1, "op2_benchmark_decontamination": OP2, "op11_conversation_prefix_trie": OP11}
