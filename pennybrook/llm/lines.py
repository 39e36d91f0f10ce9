"""Fuzzy line deduplication by MinHash, in DataFrame functions only.

Lines are compared trimmed and lower-cased; blank ones are always kept.  Equal lines are one line from the first aggregate on.

1.  Every line's shingles of ``size`` bytes are hashed and folded to minima under ``hashes`` permutations (XOR by constants with
    different leading bits), in one map-side-combined aggregate by line: text itself isn't shuffled.  A row holds ``UNROLL`` shingles.
2.  Bands of ``rows`` minima (bands share minima, so that few hashes give a high recall) key the candidates.  Two lines of a key are
    candidates if at least ``agreeing`` of their minima agree too, by their low bytes.  A semi join leaves the lines of each key that have
    such a partner in it; it makes no pairs.
3.  The exact Jaccard similarity of the character shingles is computed for candidates.  Pairs that can't reach it, by the sizes of their
    lists and the ``64 * WORDS`` buckets that their shingles fill, are left out before: a bucket that one line alone fills is a shingle of that line only.
    First every line of a key meets the key's hub, the line with the most partners over all keys.  Then all candidates of a key that these
    links don't join yet meet, whatever the key's size; a pair is made in the first key that both have.  Of these pairs many are near misses, so
    buckets are compared once more, by the parities of distinct shingles, which only the lines still in question get.
4.  Distributed union-find; of each component the first line of its smallest doc_id is kept.

Only the banding and ``agreeing`` can miss a link: with the defaults a pair of similarity 0.80 is a candidate with probability 0.989, of 0.85
with 0.998, of 0.90 with 0.9998.  Tables that are joined to all lines are broadcast up to ``broadcast_rows`` rows (counted first; keys, the most
by far, in packs up to eight times as many) and otherwise sort-merge joined, where AQE splits what a frequent line brings together.

Defined cases: null text stays null and has no lines; blank lines stay; rows with a null doc_id take no part and are kept as they are; equal
rows of one doc_id lose the same lines each, rows of one doc_id with different texts each their own; a line and a shingle are identified by 64-bit
hashes; lines shorter than a shingle are one shingle; other columns pass through.
"""

from __future__ import annotations

import random

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import connected_components, discard, materialize


def normal(line: Column) -> Column:
    return F.lower(F.trim(line))


def split_lines(docs: DataFrame, *more: Column) -> DataFrame:
    """(doc_id, more, no, line) of the lines that aren't blank."""
    out = docs.where("doc_id is not null and text is not null").select("doc_id", *more, F.posexplode(F.split("text", "\n")).alias("no", "raw"))
    # a line that is blank before it is lower-cased is one afterwards, so the filter needn't lower-case it again
    return out.where("trim(raw) <> ''").withColumn("line", normal(F.col("raw"))).drop("raw")


def constants(n: int) -> list[int]:
    """Constants whose leading bits differ as evenly as n allows."""
    rng = random.Random(17)
    out = [(i * (1 << 64) // n + rng.getrandbits(56)) % (1 << 64) for i in range(n)]
    return [x - (1 << 64) if x >= 1 << 63 else x for x in out]


def band_plan(hashes: int, rows: int, bands: int) -> list[list[int]]:
    """Bands that share no more minima than they must."""
    rng = random.Random(23)
    out: list[list[int]] = []
    pool: list[int] = []
    while len(out) < bands:
        if len(pool) < rows:
            pool = rng.sample(range(hashes), hashes)
        out.append(sorted(pool[:rows]))
        pool = pool[rows:]
    return out


#: Shingles that one row folds before it reaches the aggregate.
UNROLL = 4


def shingled(once: DataFrame, width: int, *more: str) -> DataFrame:
    """``once`` (b, bytes; last, where its last shingle of ``width`` bytes starts) as rows of ``UNROLL`` shingles' hashes x0, x1, ...; ``step`` bytes
    lie between their starts and i is the first one's."""
    each = once.select("b", "last", "step", *more, F.explode(F.expr(f"sequence(1, last, {UNROLL} * step)")).alias("i"))
    return each.select("i", *more, *[F.xxhash64(F.expr(f"substring(b, least(i + {t} * step, last), {width})")).alias(f"x{t}") for t in range(UNROLL)])


def smallest(values: list[Column]) -> Column:
    """The least of some values that aren't null, as a tournament of ifs: their code keeps it in registers, where that of ``least`` has a field of the task for each."""
    while len(values) > 1:
        values = [F.call_function("if", x < y, x, y) for x, y in zip(values[::2], values[1::2])] + values[len(values) & ~1 :]
    return values[0]


def signatures(lines: DataFrame, size: int, hashes: int, rows: int, bands: int) -> DataFrame:
    """(h, doc, n, k0, k1, ..., q0, q1, ...): a row for each different line with its smallest doc_id, its number of occurrences, its band keys
    and the low bytes of its minima, eight to a long."""
    # hash and bytes of a line are computed once below the explode, not for each of its shingles above it
    once = lines.select(F.xxhash64("line").alias("h"), "doc_id", F.encode("line", "UTF-8").alias("b"), F.expr(f"greatest(octet_length(line) - {size - 1}, 1)").alias("last"), F.lit(1).alias("step"))
    each = shingled(once, size, "h", "doc_id").withColumn("one", F.when(F.col("i") == 1, 1).otherwise(0))
    minima = [F.min(smallest([F.col(f"x{t}").bitwiseXOR(F.lit(c).cast("long")) for t in range(UNROLL)])).alias(f"m{j}") for j, c in enumerate(constants(hashes))]
    folded = each.groupBy("h").agg(F.min("doc_id").alias("doc"), F.sum("one").alias("n"), *minima)
    keys = [F.xxhash64(F.lit(j), *[f"m{i}" for i in plan]).alias(f"k{j}") for j, plan in enumerate(band_plan(hashes, rows, bands))]
    low = [F.expr(" | ".join(f"shiftleft(m{8 * w + t} & 255L, {8 * t})" for t in range(8))).alias(f"q{w}") for w in range(hashes // 8)]
    return folded.select("h", "doc", "n", *keys, *low)


def agree(x: str, y: str, hashes: int, least: int) -> str:
    """Whether at least so many minima of two rows agree: a byte's lowest bit gathers whether any bit of it differs."""

    def differ(w: int) -> str:
        z = f"({x}.q{w} ^ {y}.q{w})"
        for shift in (4, 2, 1):
            z = f"({z} | shiftrightunsigned({z}, {shift}))"
        return f"bit_count({z} & {0x0101010101010101}L)"

    return f"{' + '.join(differ(w) for w in range(hashes // 8))} <= {hashes - least}"


def bounded(df: DataFrame, n: int, limit: int) -> DataFrame:
    """Broadcast a table whose n rows (a few numbers each) were counted, if they are few enough."""
    return F.broadcast(df) if n <= limit else df


#: Keys that one row of a broadcast table of keys holds, about: 10 bytes of the driver's memory a key, not 100.
PACK = 32


def with_keys(keyed: DataFrame, keys: DataFrame, n: int, limit: int) -> DataFrame:
    """The rows of ``keyed`` whose key is one of the n different ``keys``.  These are broadcast in packs by remainder, if the packs take no more room
    than ``limit`` rows would, and otherwise joined by a shuffle."""
    if n > limit * 8:
        return keyed.join(keys, "key")
    packs = n // PACK + 1
    packed = keys.groupBy(F.expr(f"pmod(key, {packs}L)").alias("pack")).agg(F.collect_list("key").alias("pack_keys"))
    return keyed.join(F.broadcast(packed), F.expr(f"pmod(key, {packs}L) = pack AND array_contains(pack_keys, key)")).drop("pack", "pack_keys")


def shingle_hashes(line: str, size: int) -> str:
    """Hashes of a line's character shingles, four bytes a character, so that any shingle of a long line is found at once."""
    each = f"transform(sequence(1, greatest(octet_length(b) - {4 * size - 1}, 1), 4), i -> xxhash64(substring(b, i, {4 * size})))"
    return f"transform(array(encode({line}, 'UTF-32')), b -> {each})[0]"


#: Longs of a line's bitmap or parities.
WORDS = 16


def parities(texts: DataFrame, size: int) -> DataFrame:
    """As ``bitmaps``, for distinct shingles, with bits for the buckets that an odd number of them falls in: dearer, but long lines don't fill them."""
    each = texts.select("h", F.explode(F.expr(f"array_distinct({shingle_hashes('line', size)})")).alias("x")).select("h", F.expr(f"CAST(pmod(x, {64 * WORDS}) AS INT)").alias("v"))
    each = each.select("h", F.expr("v div 64").alias("at"), F.expr("shiftleft(1L, v % 64)").alias("bit"))
    return each.groupBy("h").agg(F.count(F.lit(1)).alias("n"), *[F.expr(f"bit_xor(CASE WHEN at = {w} THEN bit ELSE 0L END)").alias(f"w{w}") for w in range(WORDS)])


def bitmaps(texts: DataFrame, size: int) -> DataFrame:
    """(h, n, w0, w1, ...): the number of a line's character shingles, repeats included, and bits for the buckets that they fall in."""
    once = texts.select("h", F.encode("line", "UTF-32").alias("b"), F.lit(4).alias("step"))
    once = once.withColumn("last", F.expr(f"greatest(octet_length(b) - {4 * size - 1}, 1)"))
    each = shingled(once.withColumn("n", F.expr("(last + 3) div 4")), 4 * size, "h", "n")
    each = each.select("h", "n", *[F.expr(f"CAST(shiftright(x{t}, 6) & {WORDS - 1} AS INT)").alias(f"at{t}") for t in range(UNROLL)], *[F.expr(f"shiftleft(1L, CAST(x{t} & 63 AS INT))").alias(f"bit{t}") for t in range(UNROLL)])
    words = [F.expr("bit_or(" + " | ".join(f"if(at{t} = {w}, bit{t}, 0L)" for t in range(UNROLL)) + ")").alias(f"w{w}") for w in range(WORDS)]
    return each.groupBy("h").agg(F.max("n").alias("n"), *words)


def possible(x: str, y: str, similarity: float) -> str:
    """Whether two rows of bitmaps, or of parities, can be so similar: of sets of s and t shingles, at most (1 - similarity) / (1 + similarity) * (s + t) may
    be in one only, and a bucket whose bits differ holds such a shingle."""
    odd = " + ".join(f"bit_count({x}.w{w} ^ {y}.w{w})" for w in range(WORDS))
    return f"{odd} <= {(1 - similarity) / (1 + similarity)!r}D * ({x}.n + {y}.n) + 1e-6D"


def verified(pairs: DataFrame, texts: DataFrame, similarity: float, size: int) -> DataFrame:
    """The pairs (a, b) whose sets of character shingles are at least so similar."""
    left = texts.select(F.col("h").alias("a"), F.col("line").alias("la"))
    right = texts.select(F.col("h").alias("b"), F.col("line").alias("lb"))
    # the lists are rows of a generator: a filter on columns might make them again for each use
    lists = f"inline(array(struct({shingle_hashes('la', size)} AS sa, {shingle_hashes('lb', size)} AS sb)))"
    met = pairs.join(left, "a").join(right, "b").select("a", "b", F.expr(lists))
    return met.where(f"size(array_intersect(sa, sb)) >= {float(similarity)}D * size(array_union(sa, sb))").select("a", "b")


def promising(pairs: DataFrame, prints: DataFrame, similarity: float) -> DataFrame:
    """The distinct pairs (a, b) that can be similar."""
    return pairs.distinct().join(prints.alias("x"), F.expr("a = x.h")).join(prints.alias("y"), F.expr(f"b = y.h AND {possible('x', 'y', similarity)}")).select("a", "b")


def open_pairs(left: DataFrame, hashes: int, agreeing: int) -> DataFrame:
    """The candidates of each key whose lines are in different components, but for those with its hub: one of the two isn't in the key's largest component.
    Bitmaps are compared by a join of their own, of the pairs that agree: with 16 longs more of each line this one took some 5 microseconds a comparison."""
    minor = left.where("component <> main").alias("x")
    once = "(y.component = y.main OR x.h < y.h) AND NOT x.is_hub AND NOT y.is_hub AND x.component <> y.component"
    met = minor.join(left.alias("y"), F.expr(f"x.key = y.key AND {once} AND {agree('x', 'y', hashes, agreeing)} AND x.key = array_min(array_intersect(x.keys, y.keys))"))
    return met.select(F.expr("x.h").alias("a"), F.expr("y.h").alias("b"))


def fuzzy_lines(docs: DataFrame, size: int = 5, similarity: float = 0.8, hashes: int = 24, rows: int = 4, bands: int = 12, agreeing: int = 12, broadcast_rows: int = 1_000_000) -> DataFrame:
    """(h, component, keep): the different lines that occur more than once, or are similar to another, with the smallest doc_id of their component.  ``hashes`` is a multiple of 8."""
    lines = split_lines(docs)
    low = [f"q{w}" for w in range(hashes // 8)]
    sig = materialize(signatures(lines, size, hashes, rows, bands), "line-sig", dictionary=False)
    keyed = sig.select("h", *low, F.explode(F.array(*[f"k{j}" for j in range(bands)])).alias("key"))
    shared = materialize(keyed.groupBy("key").agg(F.count(F.lit(1)).alias("c")).where("c > 1").select("key"), "line-keys")
    members = materialize(with_keys(keyed, shared, shared.count(), broadcast_rows), "line-members", dictionary=False)
    first = materialize(sig.select("h", "doc", "n"), "line-first")
    discard(sig, shared)

    near = members.alias("x").join(members.alias("y"), F.expr(f"x.key = y.key AND x.h <> y.h AND {agree('x', 'y', hashes, agreeing)}"), "left_semi")
    near = materialize(near, "line-near", dictionary=False)
    discard(members)

    sizes = near.groupBy("key").agg(F.count(F.lit(1)).alias("c"))
    nodes = near.select("key", "h").join(sizes, "key").groupBy("h").agg(F.sum(F.col("c") - 1).alias("partners"), F.sort_array(F.collect_list("key")).alias("keys"))
    nodes = materialize(nodes.join(first.select("h", "doc"), "h"), "line-nodes")
    n_nodes = nodes.count()
    # the text of each line in question, from the document it first stands in
    holders = bounded(nodes.select(F.col("doc").alias("doc_id")).distinct(), n_nodes, broadcast_rows)
    hashed = split_lines(docs.join(holders, "doc_id", "left_semi")).select("doc_id", F.xxhash64("line").alias("h"), "line")
    texts = hashed.join(bounded(nodes.select("h", F.col("doc").alias("doc_id")), n_nodes, broadcast_rows), ["h", "doc_id"]).dropDuplicates(["h"])
    texts = materialize(texts.select("h", "line"), "line-texts")
    prints = materialize(bitmaps(texts, size), "line-bitmaps", dictionary=False)

    ranked = near.select("key", "h").join(nodes.select("h", "partners"), "h")
    hubs = materialize(ranked.groupBy("key").agg(F.max(F.struct("partners", "h")).alias("top"), F.count(F.lit(1)).alias("c")).select("key", F.col("top.h").alias("hub"), "c"), "line-hubs")
    spokes = near.select("key", "h").join(hubs, "key").where("h <> hub").select(F.least("h", "hub").alias("a"), F.greatest("h", "hub").alias("b"))
    links = materialize(verified(promising(spokes, prints, similarity), texts, similarity, size), "line-links")
    comp = materialize(connected_components(links, "lines"), "line-components")

    # lines of one component needn't meet any more; a key of a single one is done, and so is a pair
    left = near.join(comp.withColumnRenamed("node", "h"), "h", "left").withColumn("component", F.coalesce("component", "h")).join(hubs.where("c > 2"), "key").withColumn("is_hub", F.expr("h = hub"))
    parts = left.groupBy("key", "component").agg(F.count(F.lit(1)).alias("n")).groupBy("key").agg(F.max(F.struct("n", "component")).alias("top"), F.count(F.lit(1)).alias("parts"))
    left = left.join(parts.where("parts > 1").select("key", F.col("top.component").alias("main")), "key").join(nodes.select("h", "keys"), "h")
    left = materialize(left.drop("hub", "c"), "line-left")
    likely = materialize(promising(open_pairs(left, hashes, agreeing), prints, similarity), "line-likely")
    lines_left = texts.join(likely.select(F.explode(F.array("a", "b")).alias("h")).distinct(), "h", "left_semi")
    odd = materialize(parities(lines_left, size), "line-parities")
    more = materialize(verified(promising(likely, odd, similarity), texts, similarity, size), "line-links")
    discard(near, hubs, left, texts, prints, nodes, likely, odd)

    known = comp.where("node <> component").select(F.col("node").alias("a"), F.col("component").alias("b"))
    final = materialize(connected_components(known.unionByName(more), "lines"), "line-components")
    out = first.join(final.withColumnRenamed("node", "h"), "h", "left").where("n > 1 or component is not null").select("h", F.coalesce("component", "h").alias("component"), "doc")
    least = out.groupBy("component").agg(F.min("doc").alias("keep"))
    out = materialize(out.join(least, "component").select("h", "component", "keep"), "line-classes")
    discard(links, comp, more, final, first)
    return out


def dedup(docs: DataFrame, broadcast_rows: int = 1_000_000, **options) -> DataFrame:
    """``docs`` with the lines left in ``text``, and n_lines and n_removed (lines that aren't blank)."""
    classes = fuzzy_lines(docs, broadcast_rows=broadcast_rows, **options)
    n = classes.count()
    lines = split_lines(docs, F.xxhash64("text").alias("text_key")).select("doc_id", "text_key", "no", F.xxhash64("line").alias("h"))
    known = materialize(lines.join(bounded(classes, n, broadcast_rows), "h").select("doc_id", "text_key", "no", "component", "keep"), "line-known")
    # of the texts of the document that keeps a component's line, one keeps its first one
    first = known.where("doc_id = keep").groupBy("component").agg(F.min(F.struct("doc_id", "text_key", "no")).alias("at")).select("at.*")
    marks = known.groupBy("doc_id", "text_key").agg(F.collect_set("no").alias("known"))
    stays = first.groupBy("doc_id", "text_key").agg(F.collect_set("no").alias("stays"))
    gone = marks.join(stays, ["doc_id", "text_key"], "left").select(F.col("doc_id").alias("_id"), F.col("text_key").alias("_key"), F.array_except("known", F.coalesce("stays", F.array().cast("array<int>"))).alias("_gone"))
    gone = materialize(gone.where("size(_gone) > 0"), "line-gone")
    discard(classes, known)
    rows, numbers = gone.agg(F.count(F.lit(1)), F.sum(F.size("_gone"))).first()
    gone = bounded(gone, rows + (numbers or 0), broadcast_rows)
    out = docs.join(gone, (docs["doc_id"] == gone["_id"]) & (F.xxhash64(docs["text"]) == gone["_key"]), "left")
    # array_except and access by number take time in proportion, however many lines go
    kept = "transform(array(split(text, '\\n')), p -> array_join(transform(array_except(sequence(0, size(p) - 1), _gone), i -> p[i]), '\\n'))[0]"
    n_lines = F.expr("coalesce(size(filter(split(text, '\\n'), x -> trim(x) <> '')), 0)")
    out = out.withColumn("n_lines", n_lines).withColumn("n_removed", F.coalesce(F.array_size("_gone"), F.lit(0)))
    return out.withColumn("text", F.when(F.col("_gone").isNull(), F.col("text")).otherwise(F.expr(kept))).drop("_id", "_key", "_gone")
