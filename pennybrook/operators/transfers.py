"""Pairing of internal transfers: nearest exact match, then small subset sums, both greedy in time order.

Exact matches interact only within one amount, subset sums mix amounts.  ``scope`` names the columns within which legs may meet; an import only ever
pairs its own rows.  Both are cut in time by ``intime``: islands that no decision crosses, and slabs of long islands, so that neither a common amount nor a ledger
without a scope is one task.  An island with one leg of each side is decided without a kernel.

Subset sums look at a leg only if a sum can settle it.  Legs of the other side are brought together for each bin of time, where they are at most ``POOL``, and each
leg of the bin is held against them.  A leg with more than ``POOL`` legs around it counts as possible without a look.  Legs without a possible sum settle nothing; they stay only where a leg with one can use them.
Rows that share an id are used up together within one part.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.dates import epoch_seconds
from ..session import cut
from .classify import is_pairing_candidate
from .intime import SLAB, in_time_order, with_islands

WINDOW_DAYS, MAX_GROUP, POOL = 3, 3, 24


def legs(txs: DataFrame, scope: Sequence[str] = ()) -> DataFrame:
    """(scope, id, direction, amount_minor, epoch, seq) of the rows that may be legs."""
    return txs.where(is_pairing_candidate()).select(*scope, "id", "direction", "amount_minor", epoch_seconds(F.col("occurred_at")).alias("epoch"), "seq")


def in_window(left: DataFrame, right: DataFrame, keys: Sequence[str], window: int) -> DataFrame:
    """Rows of ``left`` and ``right`` (both with keys and epoch, no other common column) at most a window apart: an equi-join on bins as wide as the window,
    each left row on the at most three bins that its window touches, so that common keys meet only the rows of their time."""
    bins = F.sequence(F.floor((F.col("epoch") - window) / window), F.floor((F.col("epoch") + window) / window))
    left = left.withColumn("bin", F.explode(bins)).withColumnRenamed("epoch", "left_epoch")
    right = right.withColumn("bin", F.floor(F.col("epoch") / window)).withColumnRenamed("epoch", "right_epoch")
    return left.join(right, [*keys, "bin"]).withColumn("distance", F.abs(F.col("left_epoch") - F.col("right_epoch"))).where(F.col("distance") <= window).drop("bin", "left_epoch", "right_epoch")


def candidate_edges(rows: DataFrame, window_days: int = WINDOW_DAYS, scope: Sequence[str] = ()) -> DataFrame:
    """Every out with every in of its amount within the window."""
    keys = [*scope, "amount_minor"]
    out = rows.where("direction = 'out'").select(*keys, F.col("id").alias("out_id"), "epoch")
    into = rows.where("direction = 'in'").select(*keys, F.col("id").alias("in_id"), "epoch")
    return in_window(out, into, keys, window_days * 86_400).select(*keys, "out_id", "in_id", "distance")


class Free:
    """Positions still free, with the next free one on either side in almost constant time."""

    def __init__(self, n: int):
        self.up, self.down = list(range(n + 2)), list(range(n + 2))  # shifted by one

    def _find(self, to: list[int], i: int) -> int:
        while to[i] != i:
            to[i] = to[to[i]]
            i = to[i]
        return i

    def at_or_after(self, i: int) -> int:
        return self._find(self.up, i + 1) - 1

    def at_or_before(self, i: int) -> int:
        return self._find(self.down, i + 1) - 1

    def take(self, i: int) -> None:
        self.up[i + 1], self.down[i + 1] = i + 2, i


def in_order(rows: list[dict]) -> list[dict]:
    return sorted(rows, key=lambda r: (r["epoch"], r["seq"]["file"], r["seq"]["row"], r["seq"]["part"]))


def nearest_pairs(rows: list[dict], window: int, first: float = float("-inf"), end: float = float("inf"), before: set[str] = frozenset()) -> list[tuple[int, list[str], list[str], int]]:
    """(epoch of the out, [out id], [in id], amount) for legs of one amount: the outs from ``first`` to before ``end`` take, in time order, the nearest in that is free, the
    earlier one on ties.  Ids in ``before`` are used already."""
    rows = in_order(rows)
    outs, ins = [r for r in rows if r["direction"] == "out"], [r for r in rows if r["direction"] == "in"]
    times, free, found, used = [r["epoch"] for r in ins], Free(len(ins)), [], set(before)
    same: dict[str, list[int]] = {}
    for i, r in enumerate(ins):
        same.setdefault(r["id"], []).append(i)
        if r["id"] in used:
            free.take(i)
    for out in outs:
        if out["id"] in used or not first <= out["epoch"] < end:
            continue
        at, best = bisect_left(times, out["epoch"]), None
        left = free.at_or_before(at - 1)
        if left >= 0 and out["epoch"] - times[left] <= window:
            best = free.at_or_after(bisect_left(times, times[left]))
        right = free.at_or_after(at)
        if right < len(ins) and times[right] - out["epoch"] <= window and (best is None or times[right] - out["epoch"] < out["epoch"] - times[best]):
            best = right
        if best is not None:
            used.add(out["id"])
            for i in same[ins[best]["id"]]:
                free.take(i)
            found.append((out["epoch"], [out["id"]], [ins[best]["id"]], int(out["amount_minor"])))
    return found


def first_subset(amounts: list[int], total: int, most: int) -> list[int] | None:
    """Positions of the first subset of 2 to ``most`` amounts with the total, in depth-first order (positions ascending, a shorter one first).

    The last position comes from a table of positions by amount, so a subset of three costs a look at each pair.
    """
    where: dict[int, list[int]] = {}
    for i, a in enumerate(amounts):
        where.setdefault(a, []).append(i)

    def search(start: int, left: int, size: int) -> list[int] | None:
        for i in range(start, len(amounts)):
            rest = left - amounts[i]
            if rest == 0 and size >= 1:
                return [i]
            if rest <= 0 or size + 1 >= most:
                continue
            if size + 2 >= most:  # one more fits: it must be the rest itself
                at = where.get(rest, [])
                k = bisect_left(at, i + 1)
                found = [at[k]] if k < len(at) else None
            else:
                found = search(i + 1, rest, size + 1)
            if found:
                return [i, *found]
        return None

    return search(0, total, 0) if most >= 2 else None


def grouped_pairs(rows: list[dict], side: str, window: int, most: int = MAX_GROUP, pool: int = POOL, first: float = float("-inf"), end: float = float("inf"), before: set[str] = frozenset()) -> list[tuple[int, list[str], list[str], int]]:
    """(epoch of the target, out ids, in ids, amount): the targets of a side from ``first`` to before ``end``, in time order, are settled by two or more legs of the other
    side, out of the first ``pool`` unused ones within the window.  A row may say in ``target`` that it is none."""
    rows = in_order(rows)
    others = [r for r in rows if r["direction"] != side]
    times, used, found = [r["epoch"] for r in others], set(before), []
    for r in rows:
        if r["direction"] != side or not r.get("target", True) or r["id"] in used or not first <= r["epoch"] < end:
            continue
        near, i = [], bisect_left(times, r["epoch"] - window)
        while i < len(times) and times[i] <= r["epoch"] + window and len(near) < pool:
            if others[i]["id"] not in used:
                near.append(others[i])
            i += 1
        got = first_subset([int(x["amount_minor"]) for x in near], int(r["amount_minor"]), most) if len(near) >= 2 else None
        if got:
            ids = [near[i]["id"] for i in got]
            used.update([r["id"], *ids])
            found.append((r["epoch"], *(([r["id"]], ids) if side == "out" else (ids, [r["id"]])), int(r["amount_minor"])))
    return found


def exact_pairs(rows: DataFrame, window_days: int = WINDOW_DAYS, scope: Sequence[str] = (), slab: int = SLAB) -> DataFrame:
    """(scope, out_id, in_id, amount_minor)."""
    keys, window = [*scope, "amount_minor"], window_days * 86_400
    parts = cut(with_islands(rows, keys, window).where("n_out > 0 and n_in > 0"), rows)  # few rows of all, and read twice below
    of = lambda side, what: F.max(F.when(F.col("direction") == side, F.col(what)))
    lone = parts.where("n_out = 1 and n_in = 1").groupBy(*keys, "island").agg(of("out", "id").alias("out_id"), of("in", "id").alias("in_id"), F.max("epoch").alias("_to"), F.min("epoch").alias("_from"))
    lone = lone.where(F.col("_to") - F.col("_from") <= window).select(*scope, "out_id", "in_id", "amount_minor")

    def kernel(part: list[dict], first: int, end: int, before: set) -> list[tuple]:
        return nearest_pairs(part, window, first, end, before)

    many = in_time_order(parts.where("n_out > 1 or n_in > 1"), keys, window, kernel, slab)
    return lone.unionByName(many.select(*scope, F.col("out_ids")[0].alias("out_id"), F.col("in_ids")[0].alias("in_id"), "amount_minor"))


def sums_to(legs: Column, total: Column, most: int) -> Column:
    """Whether two to ``most`` of the legs, structs of minor and place, add up to the total."""

    def more(rest: Column, size: int, at: Column | None) -> Column:
        def fits(leg: Column) -> Column:
            after = leg["place"] > at if at is not None else F.lit(True)
            left = rest - leg["minor"]
            done = left == 0 if size else F.lit(False)
            return after & (leg["minor"] <= rest) & (done | more(left, size + 1, leg["place"]) if size + 1 < most else done)

        return F.exists(legs, fits)

    return more(total, 0, None) if most >= 2 else F.lit(False)


def feasible(rows: DataFrame, side: str, window: int, scope: Sequence[str], most: int, pool: int) -> DataFrame:
    """The legs of a side that two to ``most`` legs of the other side can settle, and those with more than ``pool`` legs of it around, in the bins of their window."""
    keys = list(scope)
    at = [*keys, "bin"]
    rows = rows.withColumn("bin", F.floor(F.col("epoch") / window))
    around = F.explode(F.expr("array(bin - 1, bin, bin + 1)")).alias("bin")  # the bins whose windows reach this one
    others = rows.where(F.col("direction") != side).select(*at, F.struct(F.col("amount_minor").alias("minor"), "epoch").alias("leg"))
    # legs around, from counts of bins: what stands around a busy bin is never brought together
    counts = others.groupBy(*at).agg(F.count(F.lit(1)).alias("c")).select(*keys, "c", around).groupBy(*at).agg(F.sum("c").alias("c")).where("c > 1")
    counts = cut(counts.join(rows.where(F.col("direction") == side).select(*at).distinct(), at, "left_semi"), rows)
    targets = rows.where(F.col("direction") == side).join(counts, at)
    legs = others.select(*keys, "leg", around).join(counts.where(F.col("c") <= pool).select(*at), at, "left_semi").groupBy(*at).agg(F.collect_list("leg").alias("legs"))
    near = F.filter("legs", lambda x: (F.abs(x["epoch"] - F.col("epoch")) <= window) & (x["minor"] <= F.col("amount_minor")))
    targets = targets.join(legs, at, "left").withColumn("near", F.transform(near, lambda x, i: F.struct(x["minor"].alias("minor"), i.alias("place"))))
    return targets.where((F.col("c") > pool) | sums_to(F.col("near"), F.col("amount_minor"), most)).select(*[c for c in rows.columns if c != "bin"])


def settled(rows: DataFrame, side: str, window_days: int, most: int, scope: Sequence[str], slab: int = SLAB) -> DataFrame:
    """(scope, out_ids, in_ids, amount_minor): legs of a side settled by two or more of the other."""
    keys, window = list(scope), window_days * 86_400
    targets = cut(feasible(rows, side, window, keys, most, POOL), rows)
    others = rows.where(F.col("direction") != side)
    # of the other side, only what is in the bins of a target's window can be used
    reach = targets.select(*keys, F.explode(F.expr(f"sequence(floor((epoch - {window}) / {window}), floor((epoch + {window}) / {window}))")).alias("bin")).distinct()
    others = others.withColumn("bin", F.floor(F.col("epoch") / window)).join(reach, [*keys, "bin"], "left_semi").drop("bin")
    spare = [] if keys else ["_all"]
    both = targets.unionByName(others).withColumns({c: F.lit(0) for c in spare})

    def kernel(part: list[dict], first: int, end: int, before: set) -> list[tuple]:
        return grouped_pairs(part, side, window, most, POOL, first, end, before)

    return in_time_order(with_islands(both, keys or spare, window).where("n_out > 0 and n_in > 0 and n_out + n_in > 2"), keys or spare, window, kernel, slab).drop(*spare)


def pair_transfers(txs: DataFrame, window_days: int = WINDOW_DAYS, max_group: int = MAX_GROUP, scope: Sequence[str] = (), slab: int = SLAB) -> DataFrame:
    """(scope, out_ids, in_ids, amount_minor, mode) of all pairs."""
    keys = list(scope)
    rows = cut(legs(txs, scope))
    exact = cut(exact_pairs(rows, window_days, scope, slab))
    left = cut(rows.join(exact.select(*keys, F.explode(F.array("out_id", "in_id")).alias("id")), [*keys, "id"], "left_anti"))
    by_ins = settled(left, "out", window_days, max_group, scope, slab)
    left = cut(left.join(by_ins.select(*keys, F.explode(F.concat("out_ids", "in_ids")).alias("id")), [*keys, "id"], "left_anti"))
    by_outs = settled(left, "in", window_days, max_group, scope, slab)
    exact = exact.select(*keys, F.array("out_id").alias("out_ids"), F.array("in_id").alias("in_ids"), "amount_minor", F.lit("exact").alias("mode"))
    return exact.unionByName(by_ins.unionByName(by_outs).withColumn("mode", F.lit("grouped")))


def apply_pairs(txs: DataFrame, pairs: DataFrame, scope: Sequence[str] = ()) -> DataFrame:
    """Paired rows become internal transfers."""
    ids = pairs.select(*scope, F.explode(F.concat("out_ids", "in_ids")).alias("id")).distinct().withColumn("_paired", F.lit(True))
    out = txs.join(ids, [*scope, "id"], "left")
    return out.withColumn("kind", F.when(F.col("_paired") & is_pairing_candidate(), "transfer-internal").otherwise(F.col("kind"))).drop("_paired").select(*txs.columns)
