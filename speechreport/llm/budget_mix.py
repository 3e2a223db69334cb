"""Mixing sources to target weights by fitting word budgets exactly.

Targets share the corpus by weight, capped at a number of passes over each source. A source gives as
many whole passes as its target holds; the rest of the budget is filled from counts of documents by
exact length: first the same share of every length, then a bounded-knapsack program that takes back and
adds documents until no sum is nearer to the budget.
The counts chosen for each length are turned into documents by seeded order.
"""

from __future__ import annotations

import math
import random

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from speechreport.llm.common import materialize, words

WEIGHTS = (5, 2, 1)
PASSES = 3
#: Words that the exact program takes back in its first try; sums are bits of one integer of about twice that length.
PROGRAM = 1 << 16
#: Choices of all lengths but the commonest that are tried one by one, in 8-byte numbers, where the first try doesn't meet the budget.
FEW = 1 << 21
#: High bits of the seeded order that tell its bucket, so 1024 buckets.
BUCKET_SHIFT = 54


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, passes: int = PASSES) -> DataFrame:
    """(source, source_size, target) for rows (source, source_size).

    Weights repeat along the sources by code point, null last. The level at which targets stand in
    proportion to weights follows from the sources in order of passes * size / weight: those below
    the level get their cap, the rest share what is left. As many rows as there are sources meet in
    one task.
    """
    named = Window.orderBy(F.col("source").asc_nulls_last())
    cycle = F.array(*[F.lit(w) for w in weights])
    found = sizes.withColumn("weight", F.get(cycle, (F.row_number().over(named) - 1) % len(weights)))
    order = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    all_rows, after, before = Window.partitionBy(), order.rowsBetween(0, Window.unboundedFollowing), order.rowsBetween(Window.unboundedPreceding, -1)
    found = found.withColumn("cap", passes * F.col("source_size"))
    found = found.withColumns({"total": F.sum("source_size").over(all_rows), "open": F.sum("weight").over(after), "capped": F.coalesce(F.sum("cap").over(before), F.lit(0))})
    left = F.col("total") - F.col("capped")
    found = found.withColumn("free", left * F.col("weight") <= F.col("cap") * F.col("open"))
    # the first free source in this order sets the level for itself and all after it
    at = F.min(F.when(F.col("free"), F.struct(F.col("cap") / F.col("weight"), left.alias("left"), F.col("open").alias("open")))).over(all_rows)
    found = found.withColumn("level", at)
    share = F.col("weight") * F.col("level.left") / F.col("level.open")
    return found.select("source", "source_size", F.when(F.col("source_size") == 0, F.lit(0.0)).otherwise(F.least(share, F.col("cap").cast("double"))).alias("target"))


def fill(counts: dict[int, int], budget: int, seed: int, program: int = PROGRAM) -> dict[int, int]:
    """How many documents of each length to take: their sum is the largest up to ``budget``.

    counts: documents by length, lengths over 0. The same share of every length is taken first, short
    of the budget by less than the longest length m; documents are then taken back and added. Ordered
    to stay within m of the start, 2m exchanges would repeat a sum, and what lies between could be left
    out: so some best choice takes back at most m * m words. ``program`` words are tried first and more
    only while the budget isn't met. Lengths count in units of their common divisor. A histogram of a few lengths, of which
    most budgets can't be met, is searched whole by choices(), in memory that doesn't grow with the lengths.
    """
    total = sum(n * c for n, c in counts.items())
    if budget >= total:
        return dict(counts)
    taken = {n: c * budget // total for n, c in counts.items()}
    rest = budget - sum(n * c for n, c in taken.items())
    order = sorted(counts)
    random.Random(seed).shuffle(order)
    for n in order:  # each length has a document left
        if n <= rest:
            taken[n] += 1
            rest -= n
    unit = math.gcd(*order)
    rest //= unit
    most = min((max(order) // unit) ** 2, sum(n * c for n, c in taken.items()) // unit, sum(n * (counts[n] - c) for n, c in taken.items()) // unit)
    back = min(max(1, program), most)
    while True:
        changes, left = exchange({n: (n // unit, taken[n], counts[n] - taken[n]) for n in order}, back, rest)
        if left == 0 or back == most:
            return {n: c + changes.get(n, 0) for n, c in taken.items()}
        if (found := choices(counts, taken, budget)) is not None:
            return found
        back = min(8 * back, most)


def choices(counts: dict[int, int], taken: dict[int, int], budget: int) -> dict[int, int] | None:
    """A choice of the largest sum up to the budget, of such the one with most nearly ``taken`` of the commonest length.

    Each choice of the other lengths leaves one best number of the commonest. None if there are more than FEW of them.
    """
    *others, common = sorted(counts, key=lambda n: (counts[n], n))
    if math.prod(counts[n] + 1 for n in others) > FEW:
        return None
    sums = np.zeros(1, np.int64)
    for n in others:
        sums = (sums[:, None] + n * np.arange(counts[n] + 1)).ravel()
    docs = np.clip((budget - sums) // common, 0, counts[common])
    sums += docs * common
    sums[sums > budget] = -1
    best = np.flatnonzero(sums == sums.max())
    at = int(best[np.argmin(np.abs(docs[best] - taken[common]))])
    found = {common: int(docs[at])}
    for n in reversed(others):
        at, found[n] = divmod(at, counts[n] + 1)
    return found


def exchange(lengths: dict[int, tuple[int, int, int]], back: int, rest: int) -> tuple[dict[int, int], int]:
    """(changes by key, what is left of rest) of the best choice that takes back at most ``back``.

    lengths: key to (size, documents taken, documents that can be added).
    """
    # bounded knapsack: reach has bit back + s if some choice changes the sum by s; each step keeps
    # the bits it adds
    goal = back + rest
    mask, reach, steps = (1 << (goal + back + 1)) - 1, 1 << back, []
    for key, (size, taken, free) in lengths.items():
        for sign, docs in ((1, free), (-1, taken)):
            left, k = min(docs, (goal + back) // size), 1
            while left and not reach >> goal & 1:
                k = min(k, left)
                new = (reach << (size * k) & mask if sign > 0 else reach >> (size * k)) & ~reach
                if new:
                    steps.append((key, sign * k, sign * k * size, new))
                    reach |= new
                left -= k
                k *= 2
        if reach >> goal & 1:
            break
    at = (reach & ((1 << (goal + 1)) - 1)).bit_length() - 1
    changes, left = {}, goal - at
    for key, k, moved, new in reversed(steps):
        if new >> at & 1:
            changes[key] = changes.get(key, 0) + k
            at -= moved
    return changes, left


def mix(df: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", weights: tuple[int, ...] = WEIGHTS, passes: int = PASSES, seed: int = 17, keep: list[str] | None = None) -> DataFrame:
    """One row for each row of df: its key, source (or ``keep``), size, source_size, target, taken.

    taken is size times the passes over the document, at most ``passes``. Null and empty texts have
    size 0 and take 0; null is a source of its own, the last. Documents are chosen in the order of a hash of
    their ids and texts, so rows without ids or with shared ones are told apart by their texts; rows that share both are told
    apart only by chance, which leaves equal results. Very long texts are counted whole, an empty table gives no rows, other
    columns of df are not read. The same input gives the same result in every run, however it is partitioned.
    """
    keep = [c for c in ([key, source] if keep is None else keep) if c not in ("size", "source_size", "target", "taken") and not c.startswith("_")]
    name = F.struct(F.col(source).isNull().alias("none"), F.coalesce(F.col(source), F.lit("")).alias("name"))
    order = F.xxhash64(F.lit(seed), *([F.col(key).cast("string")] if key in keep else []), F.col(text))
    sized = df.select(*keep, F.size(words(F.col(text))).cast("long").alias("size"), name.alias("_key"), order.alias("_order"))
    sized = materialize(sized)
    lengths = materialize(sized.groupBy("_key", "size").agg(F.count(F.lit(1)).alias("docs")))
    sizes = lengths.groupBy("_key").agg(F.sum(F.col("size") * F.col("docs")).alias("source_size"))
    sizes = sizes.select(F.when(~F.col("_key.none"), F.col("_key.name")).alias("source"), "source_size")
    aims = materialize(targets(sizes, weights, passes).withColumn("_key", F.struct(F.col("source").isNull().alias("none"), F.coalesce("source", F.lit("")).alias("name"))).drop("source"))
    whole = F.least(F.floor(F.col("target") / F.greatest("source_size", F.lit(1))), F.lit(passes))
    budgets = aims.select("_key", whole.alias("whole"), F.round(F.col("target") - whole * F.col("source_size")).cast("long").alias("budget"))

    def choose(group: pd.DataFrame) -> pd.DataFrame:
        counts = {int(n): int(c) for n, c in zip(group["size"], group["docs"], strict=True) if n > 0}
        got = fill(counts, int(group["budget"].iloc[0]), seed)
        return pd.DataFrame({"none": group["none"].iloc[0], "name": group["name"].iloc[0], "size": group["size"], "extra": [got.get(int(n), 0) for n in group["size"]], "whole": group["whole"], "docs": group["docs"]})

    flat = lengths.join(budgets, "_key").select("_key.none", "_key.name", "size", "docs", "whole", "budget")
    chosen = flat.groupBy("none", "name").applyInPandas(choose, "none boolean, name string, size long, extra long, whole long, docs long")
    chosen = materialize(chosen.select(F.struct("none", "name").alias("_key"), "size", "extra", "whole", "docs").join(aims, "_key"))
    # the first `extra` documents of a length in seeded order, ranked by buckets of the order so that
    # many documents of one length and source don't meet in one task
    placed = sized.withColumn("_bucket", F.shiftrightunsigned("_order", BUCKET_SHIFT).cast("int"))
    filled = placed.groupBy("_key", "size", "_bucket").agg(F.count(F.lit(1)).alias("_n"))
    upto = Window.partitionBy("_key", "size").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    filled = filled.withColumn("_before", F.coalesce(F.sum("_n").over(upto), F.lit(0)))
    ranked = materialize(filled.join(chosen, ["_key", "size"]))
    within = Window.partitionBy("_key", "size", "_bucket").orderBy("_order")
    found = placed.withColumn("_rank", F.row_number().over(within)).join(ranked, ["_key", "size", "_bucket"])
    taken = F.col("size") * (F.col("whole") + F.when(F.col("_before") + F.col("_rank") <= F.col("extra"), 1).otherwise(0))
    return found.select(*keep, "size", "source_size", "target", taken.cast("long").alias("taken"))
