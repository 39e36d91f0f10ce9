"""The prefix trie of conversations, by prefix doubling.

1.  Turns are put in order and numbered.  A conversation is never gathered in a row: the numbers come from one range-partitioned sort of all turns
    and the counts of its partitions, so that a conversation of any length is sorted by many tasks.
2.  Naming: every different turn (role, text) gets a dense number.  Blocks of 2, 4, 8, ... turns at multiples of their length get dense numbers from
    the pairs of their halves' numbers, a round of joins for each doubling: two blocks have one name if and only if their turns are equal.
3.  The prefix of d turns is made of one block for each binary digit 1 of d; their names, longest block first, are its key.  A block is handed to
    the prefixes that use it by an explode, without a join.
4.  A node is a group of equal keys.  Its name is (least member, depth), so any ancestor is found by an equi-join on (conversation, depth), keys
    that no two rows share.
5.  Sums over subtrees double their reach: after k rounds a node holds the sums over its descendants nearer than 2 ** k, and the next
    round adds those of the descendants at exactly that distance, grouped by the ancestor with map-side combining.
6.  The ids of the conversations that end at a node are sorted over all tasks, written as chunks of text, and the chunks of a node are streamed
    through SHA-256 in order: memory is one chunk, however many conversations end there.

Rounds: the binary logarithm of the longest conversation.  Every table is written to the shared scratch folder before a later step reads it.

Defined cases: rows with a null conv_id take no part; a null turn comes first; turns of one number are ordered by the SHA-256 of role and text; a null role
or text is empty; repeated rows are turns like any other; turns are told apart by SHA-256; a conversation without turns is a member of the root; no
conversations give no rows, not even a root; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialize

#: Bits of a row's place in monotonically_increasing_id, below those of its partition.
PLACE = 33

WORD = r"[^\x20\x09-\x0D]+"


def numbered(df: DataFrame, name: str, label: str) -> DataFrame:
    """``df``, written to the scratch folder, with dense numbers from 0 in the order of its partitions and their rows; a count of each partition meets the driver."""
    spark = df.sparkSession
    held = materialize(df.withColumn("_at", F.monotonically_increasing_id()), label)
    counts = held.groupBy(F.shiftright("_at", PLACE).alias("_part")).agg(F.count(F.lit(1)).alias("c")).orderBy("_part").collect()
    starts = [0, *accumulate(r["c"] for r in counts)]
    parts = spark.createDataFrame([(r["_part"], s) for r, s in zip(counts, starts)], "_part long, _start long")
    place = F.col("_at").bitwiseAND(F.lit((1 << PLACE) - 1))
    out = held.withColumn("_part", F.shiftright("_at", PLACE)).join(F.broadcast(parts), "_part").withColumn(name, F.col("_start") + place).drop("_at", "_part", "_start")
    out._scratch_path = held._scratch_path
    return out


def ordered_turns(turns: DataFrame, conv_col: str = "conv_id") -> DataFrame:
    """(conv_id, pos, digest, words): the turns of each conversation, numbered from 0."""
    role, text = F.coalesce(F.col("role"), F.lit("")), F.coalesce(F.col("text"), F.lit(""))
    digest = F.unhex(F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(" "), role, text), 256))
    picked = turns.where(F.col(conv_col).isNotNull()).select(F.col(conv_col).cast("long").alias("conv_id"), "turn", digest.alias("digest"), F.regexp_count(text, F.lit(WORD)).cast("long").alias("words"))
    picked = materialize(picked, "trie-turns")  # a range partition reads its input twice
    order = ["conv_id", F.asc_nulls_first("turn"), "digest"]
    dealt = numbered(picked.repartitionByRange(*order).sortWithinPartitions(*order), "at", "trie-order")
    first = dealt.groupBy("conv_id").agg(F.min("at").alias("first"))
    out = materialize(dealt.join(first, "conv_id").select("conv_id", (F.col("at") - F.col("first")).alias("pos"), "digest", "words"), "trie-ordered")
    discard(picked, dealt)
    return out


def named_turns(turns: DataFrame) -> DataFrame:
    """(conv_id, pos, name, words) of (conv_id, pos, digest, words)."""
    names = numbered(turns.select("digest").distinct(), "name", "trie-names")
    out = materialize(turns.join(names, "digest").select("conv_id", "pos", "name", "words"), "trie-named")
    discard(names)
    return out


def with_lengths(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(turns with n, the number of turns of their conversation; (conv_id, n) of all conversations)."""
    convs = materialize(turns.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n")), "trie-convs")
    return turns.join(convs, "conv_id"), convs


def branched(turns: DataFrame, block: int = 20, most: int = 4) -> tuple[DataFrame, DataFrame]:
    """Conversations that share beginnings: c starts with the first h turns of conversation c - c % block and goes on with its own after its first h,
    h = crc32 of the decimal c, modulo ``most``.  (turns with n, all conversations with n)."""
    convs = turns.groupBy("conv_id").agg(F.count(F.lit(1)).alias("own"))
    convs = materialize(convs.withColumn("base", F.expr(f"conv_id - conv_id % {block}")).withColumn("h", F.crc32(F.col("conv_id").cast("string").cast("binary")) % most), "trie-own")
    sizes = convs.select(F.col("conv_id").alias("base"), F.col("own").alias("of_base"))
    taken = F.least("h", F.coalesce("of_base", F.lit(0)))
    convs = materialize(convs.join(sizes, "base", "left").select("conv_id", "base", "h", taken.alias("taken"), (taken + F.greatest(F.col("own") - F.col("h"), F.lit(0))).alias("n")), "trie-convs")
    start = turns.where(F.col("pos") < most).withColumnRenamed("conv_id", "base").join(convs, "base").where("pos < h").select("conv_id", "pos", "name", "words", "n")
    rest = turns.join(convs, "conv_id").where("pos >= h").select("conv_id", (F.col("pos") - F.col("h") + F.col("taken")).alias("pos"), "name", "words", "n")
    return materialize(start.unionByName(rest), "trie-branched"), convs.select("conv_id", "n")


def blocks_of(turns: DataFrame, longest: int) -> list[DataFrame]:
    """For each k with 2 ** k <= longest: (conv_id, j, name, n) of the blocks of turns j * 2 ** k to (j + 1) * 2 ** k - 1."""
    out = [turns.select("conv_id", F.col("pos").alias("j"), "name", "n")]
    for k in range(1, longest.bit_length()):
        halves = out[-1].where(F.col("n") >= 1 << k)
        pairs = halves.groupBy("conv_id", F.expr("j div 2").alias("half")).agg(F.max(F.expr("CASE WHEN j % 2 = 0 THEN name END")).alias("a"), F.max(F.expr("CASE WHEN j % 2 = 1 THEN name END")).alias("b"), F.first("n").alias("n"))
        pairs = materialize(pairs.where("a is not null and b is not null"), "trie-pairs")
        names = numbered(pairs.select("a", "b").distinct(), "name", "trie-names")
        out.append(materialize(pairs.join(names, ["a", "b"]).select("conv_id", F.col("half").alias("j"), "name", "n"), "trie-blocks"))
        discard(pairs, names)
    return out


def prefixes(turns: DataFrame, blocks: list[DataFrame]) -> DataFrame:
    """(conv_id, depth, key, words, ends): each prefix of at least one turn; words of its last turn; whether it is the whole conversation."""
    parts = turns.select("conv_id", (F.col("pos") + 1).alias("depth"), F.lit(None).cast("struct<k:int,name:long>").alias("part"), "words", "n")
    for k, block in enumerate(blocks):
        # the prefixes whose binary digit k is 1 and whose higher digits are those of j
        used = block.where(f"j % 2 = 0 and (j + 1) * {1 << k}L <= n")
        depths = F.explode(F.expr(f"sequence((j + 1) * {1 << k}L, least((j + 2) * {1 << k}L - 1, n))"))
        used = used.select("conv_id", depths.alias("depth"), F.struct(F.lit(k).alias("k"), "name").alias("part"), F.lit(None).cast("long").alias("words"), "n")
        parts = parts.unionByName(used)
    whole = parts.groupBy("conv_id", "depth").agg(F.sort_array(F.collect_list("part"), asc=False).alias("key"), F.max("words").alias("words"), F.first("n").alias("n"))
    return materialize(whole.select("conv_id", "depth", "key", "words", (F.col("n") == F.col("depth")).alias("ends")), "trie-prefixes")


#: Ids of one chunk of text.
CHUNK = 4096


def ends_digests(ends: DataFrame) -> DataFrame:
    """(node_id, depth, ends_sha256) of (node_id, depth, conv_id): SHA-256 of the ids in numerical order, comma-joined."""

    def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, ids = None, []

        def flush() -> pa.RecordBatch:
            return pa.RecordBatch.from_pydict({"node_id": pa.array([at[0]], pa.int64()), "depth": pa.array([at[1]], pa.int64()), "first": pa.array([ids[0]], pa.int64()), "text": [",".join(map(str, ids))]})

        for batch in batches:
            for node, depth, conv in zip(*(c.to_pylist() for c in batch.columns)):
                if ids and ((node, depth) != at or len(ids) == CHUNK):
                    yield flush()
                    ids = []
                at = node, depth
                ids.append(conv)
        if ids:
            yield flush()

    def hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held = None, None

        def flush() -> pa.RecordBatch:
            return pa.RecordBatch.from_pydict({"node_id": pa.array([at[0]], pa.int64()), "depth": pa.array([at[1]], pa.int64()), "ends_sha256": [held.hexdigest()]})

        for batch in batches:
            for node, depth, _, text in zip(*(c.to_pylist() for c in batch.columns)):
                if (node, depth) == at:
                    held.update(b",")
                else:
                    if at:
                        yield flush()
                    at, held = (node, depth), hashlib.sha256()
                held.update(text.encode())
        if at:
            yield flush()

    order = ["node_id", "depth", "conv_id"]
    cut = ends.select(*order).repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(chunks, "node_id long, depth long, first long, text string")
    cut = materialize(cut, "trie-chunks")
    return cut.repartition("node_id", "depth").sortWithinPartitions("node_id", "depth", "first").mapInArrow(hashes, "node_id long, depth long, ends_sha256 string")


def subtree_sums(nodes: DataFrame, names: DataFrame, root: int, deepest: int, columns: list[str]) -> DataFrame:
    """(conv_id, depth, columns): the columns of nodes (conv_id, depth, columns), summed over each node's subtree; names has (conv_id, depth, node_id) of all prefixes of at least one turn."""
    held = nodes.select("conv_id", "depth", *columns)
    for k in range(deepest.bit_length()):
        step = 1 << k
        below = held.where(F.col("depth") >= step).withColumn("depth", F.col("depth") - step)
        high = below.where("depth > 0").join(names.select("conv_id", "depth", "node_id"), ["conv_id", "depth"]).select(F.col("node_id").alias("conv_id"), "depth", *columns)
        top = below.where("depth = 0").withColumn("conv_id", F.lit(root).cast("long")).select("conv_id", "depth", *columns)
        new = held.unionByName(high).unionByName(top).groupBy("conv_id", "depth").agg(*[F.sum(c).alias(c) for c in columns])
        new = materialize(new, "trie-sums")
        discard(held)
        held = new
    return held


def trie(turns: DataFrame, convs: DataFrame) -> DataFrame:
    """The nodes of the trie of turns (conv_id, pos, name, words, n); convs has (conv_id, n) of all conversations, those without turns too."""
    spark = turns.sparkSession
    schema = "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string"
    root, total, longest = convs.agg(F.min("conv_id"), F.count(F.lit(1)), F.max("n")).first()
    if not total:
        return spark.createDataFrame([], schema)
    blocks = blocks_of(turns, longest)
    prefix = prefixes(turns, blocks)
    groups = prefix.groupBy("key").agg(F.min("conv_id").alias("node_id"), F.max("depth").alias("depth"), F.count(F.lit(1)).alias("n_convs"), F.max("words").alias("words"))
    groups = materialize(groups, "trie-nodes")
    names = materialize(prefix.join(groups.select("key", "node_id"), "key").select("conv_id", "depth", "node_id", "ends"), "trie-members")
    discard(prefix, *blocks[1:])

    parents = names.select(F.col("conv_id").alias("node_id"), (F.col("depth") + 1).alias("depth"), F.col("node_id").alias("parent_conv_id"))
    nodes = groups.drop("key").join(parents, ["node_id", "depth"], "left").withColumn("parent_conv_id", F.coalesce("parent_conv_id", F.lit(root).cast("long")))
    top = spark.createDataFrame([(root, 0, total, 0, None)], "node_id long, depth long, n_convs long, words long, parent_conv_id long")
    nodes = materialize(nodes.unionByName(top), "trie-parents")
    children = nodes.where("depth > 0").groupBy(F.col("parent_conv_id").alias("node_id"), (F.col("depth") - 1).alias("depth")).agg(F.count(F.lit(1)).alias("n_children"))
    nodes = nodes.join(children, ["node_id", "depth"], "left").withColumn("n_children", F.coalesce("n_children", F.lit(0).cast("long")))
    nodes = nodes.withColumn("n_leaves", (F.col("n_children") == 0).cast("long")).withColumn("saved_tokens", (F.col("n_convs") - 1) * F.col("words"))
    nodes = materialize(nodes.withColumnRenamed("node_id", "conv_id"), "trie-children")
    discard(groups)

    sums = subtree_sums(nodes, names, root, longest, ["n_leaves", "saved_tokens"])
    ended = names.where("ends").select("node_id", "depth", "conv_id").unionByName(convs.where("n = 0").select(F.lit(root).cast("long").alias("node_id"), F.lit(0).cast("long").alias("depth"), "conv_id"))
    ended = ends_digests(ended).withColumnRenamed("node_id", "conv_id")
    out = nodes.drop("n_leaves", "saved_tokens").join(sums, ["conv_id", "depth"]).join(ended, ["conv_id", "depth"], "left")
    return out.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(hashlib.sha256().hexdigest())).alias("ends_sha256"))


def conversation_trie(conversations: DataFrame, branch: bool = False) -> DataFrame:
    """One row for each node of the trie of ``conversations`` (conv_id, turn, role, text), or of what ``branched`` makes of them."""
    turns = named_turns(ordered_turns(conversations))
    return trie(*(branched(turns) if branch else with_lengths(turns)))
