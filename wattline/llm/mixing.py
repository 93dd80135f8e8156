"""Mixing sources to target weights by subset-sum budget fitting.

1. *Targets.*  Sources share a total of words by weight; a target stops at
   ``max_epochs`` times its source's size and the excess is shared again by weight
   until none is above.  In closed form: with sources in ascending order of
   cap / weight, the capped ones are a prefix, found by prefix sums over one row
   a source.
2. *Whole epochs.*  floor(target / size) copies of every document.
3. *Rest of the budget.*  Documents are counted by exact length within a source.
   Each length gives its proportional share, rounded down; a bounded-knapsack
   dynamic program over the lengths' remaining counts then fills what is left of
   the budget exactly, or comes as near as a subset sum can, below or above.  It sees
   (length, count) rows, at most one a distinct length, never documents.
4. *Selection.*  Of each (source, length) the planned number of documents is taken
   in the order of a seeded hash.  Ranks are an offset by hash bucket plus a rank
   inside the bucket, so one (source, length) with a third of all rows is still
   ranked in many tasks.

Defined results
* Size is the number of words; null or blank texts have size 0, and take 0 words.
* Sources are ordered by code point, null (a source of its own) last; the i-th
  has weight i mod 3 + 1 unless weights are given.
* A source whose documents are all empty has target 0.
* Equal seeds give equal results; equal hashes are ordered by id, and rows equal
  in id and size are interchangeable.  So are null ids of one source and size, which
  are dealt over all buckets.
* No document is taken more than ``max_epochs`` times.  Empty table: no rows.
* Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wattline.llm.text import count_words, free, settle

SEED = 17
BUCKETS = 256
CYCLE = (1, 2, 3)
#: Words of remaining budget that the dynamic program sees at most (8 bytes each).  A
#: remainder above it is left only where every other document is longer than it.
ROOM = 1 << 20
#: Sources of so few documents take the best of all subsets.
FEW = 16


def targets(sizes: DataFrame, cycle: tuple[int, ...] = CYCLE, max_epochs: int = 3) -> DataFrame:
    """source, source_size -> source, source_size, weight, target (one row a source)."""
    order = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*[F.lit(w) for w in cycle]), ((F.row_number().over(order) - 1) % len(cycle) + 1).cast("int"))
    ranked = sizes.select("source", "source_size", weight.cast("double").alias("weight"))
    ranked = ranked.withColumn("cap", (F.lit(max_epochs) * F.col("source_size")).cast("double"))
    by_ratio = Window.orderBy((F.col("cap") / F.col("weight")), F.col("source").asc_nulls_last())
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    everything = by_ratio.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    # The level if exactly the sources before this one were capped.
    level = (F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / (
        F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    )
    levelled = ranked.withColumn("level", level)
    # The first source, in this order, whose cap is above the level sets it for all after.
    first = F.min(F.when(F.col("cap") >= F.col("level") * F.col("weight"), F.struct((F.col("cap") / F.col("weight")).alias("r"), "level"))).over(Window.partitionBy())
    share = F.when(first.isNull(), F.col("cap")).otherwise(F.least("cap", first["level"] * F.col("weight")))
    return levelled.select("source", "source_size", "weight", share.alias("target"))


def fill(lengths: list[int], counts: list[int], budget: int) -> list[int]:
    """How many of each length to add so that the sum is nearest to ``budget``.

    Of two sums equally near, the smaller.  Bounded knapsack by binary splitting over
    sums of up to one document above the budget, as a higher one comes nearer without
    one of its documents, and of up to twice the budget, as a higher one is further off
    than nothing.  ``first`` keeps, for every sum, the step that first reached it, so
    memory is eight bytes a unit of the budget at most.  Lengths are positive.
    """
    take = [0] * len(lengths)
    if budget <= 0 or not lengths:
        return take
    top = budget + min(budget, max(lengths))
    first = np.full(top + 1, -1, dtype=np.int32)
    first[0] = 0
    steps: list[tuple[int, int]] = [(0, 0)]
    for i, (length, count) in enumerate(zip(lengths, counts, strict=True)):
        step, left = 1, min(count, top // length)
        while left > 0:
            step = min(step, left)
            weight = length * step
            fresh = np.flatnonzero((first[:-weight] >= 0) & (first[weight:] < 0)) + weight
            first[fresh] = len(steps)
            steps.append((i, step))
            left -= step
            step *= 2
        if first[budget] >= 0:
            break
    reached = np.flatnonzero(first >= 0)
    at = int(reached[np.abs(reached - budget).argmin()])
    while at > 0:
        i, step = steps[first[at]]
        take[i] += step
        at -= lengths[i] * step
    return take


def fill_few(lengths: list[int], counts: list[int], budget: int) -> list[int]:
    """``fill`` for at most ``FEW`` documents of any length: every subset is summed."""
    each = [i for i, n in enumerate(counts) for _ in range(n)]
    sums = np.zeros(1, dtype=np.int64)
    for i in each:
        sums = np.concatenate([sums, sums + lengths[i]])
    off = np.abs(sums - budget)
    best = min(np.flatnonzero(off == off.min()), key=lambda j: sums[j])
    take = [0] * len(lengths)
    for place, i in enumerate(each):
        take[i] += int(best) >> place & 1
    return take


def plan_source(rows: pd.DataFrame) -> pd.DataFrame:
    """One source's (length, n) rows with its size and target -> copies and picks.

    ``copies`` is the number of whole epochs, ``picks`` how many documents of the
    length are taken once more.
    """
    rows = rows.sort_values("length").reset_index(drop=True)
    size, target = int(rows["source_size"].iloc[0]), float(rows["target"].iloc[0])
    copies = min(int(target // size), int(rows["max_epochs"].iloc[0])) if size else 0
    budget = round(target - copies * size) if size else 0
    budget = 0 if copies == int(rows["max_epochs"].iloc[0]) else budget
    picks = [0] * len(rows)
    length, n = rows["length"].tolist(), rows["n"].tolist()
    some = [i for i, x in enumerate(length) if x]
    if 0 < budget and sum(n[i] for i in some) <= FEW:
        for i, a in zip(some, fill_few([length[i] for i in some], [n[i] for i in some], budget), strict=True):
            picks[i] = a
    elif 0 < budget:
        picks = [c * budget // size if x else 0 for x, c in zip(length, n, strict=True)]
        left = budget - sum(x * p for x, p in zip(length, picks, strict=True))
        # Largest rests first, down to a remainder that a few documents fill.
        room = min(ROOM, 4 * max(length))
        for i in sorted(some, key=lambda i: (-(n[i] * budget % size), -length[i])):
            if left <= room:
                break
            more = min(n[i] - picks[i], left // length[i], -(-(left - room) // length[i]))
            picks[i] += more
            left -= more * length[i]
        order = [i for i in some if picks[i] < n[i] and length[i] < 2 * left]
        if left <= ROOM:
            added = fill([length[i] for i in order], [n[i] - picks[i] for i in order], left)
            for i, a in zip(order, added, strict=True):
                picks[i] += a
        elif order:
            # All that is left is longer than the remainder: the shortest one more comes nearer.
            picks[min(order, key=lambda i: length[i])] += 1
    return rows.assign(copies=copies, picks=picks)[["source", "length", "copies", "picks"]]


_PLAN = "source string, length long, copies long, picks long"


def mix(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    cycle: tuple[int, ...] = CYCLE,
    max_epochs: int = 3,
    seed: int = SEED,
    buckets: int = BUCKETS,
) -> DataFrame:
    """One row per input row: doc_id, text_key, source, size, source_size, target, copies."""
    sized = settle(
        docs.select(
            F.col(id_col).alias("doc_id"),
            F.col(source_col).cast("string").alias("source"),
            count_words(F.col(text_col)).alias("size"),
            F.xxhash64(F.lit(seed), F.col(id_col)).alias("h"),
            F.xxhash64(F.col(text_col)).alias("text_key"),
            F.monotonically_increasing_id().alias("row"),
        )
    )
    # Written above, so that a row's number does not change between the steps below.
    own = F.when(F.col("doc_id").isNull(), F.col("row")).otherwise(F.shiftright("h", 20))
    placed = sized.withColumn("bucket", F.pmod(own, F.lit(buckets)))
    counted = sized.groupBy("source", F.col("size").alias("length")).agg(F.count(F.lit(1)).alias("n"))
    per_source = settle(targets(sized.groupBy("source").agg(F.sum("size").alias("source_size")), cycle, max_epochs))
    with_target = counted.join(per_source.select(F.col("source").alias("s"), "source_size", "target"), F.col("source").eqNullSafe(F.col("s"))).drop("s")
    plan = with_target.withColumn("max_epochs", F.lit(max_epochs)).groupBy("source").applyInPandas(plan_source, _PLAN)

    cell = ["source", "size", "bucket"]
    in_cell = placed.groupBy(*cell).agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("source", "size").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = in_cell.select(*cell, F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    planned = offsets.join(plan.select(F.col("source").alias("s"), F.col("length").alias("l"), "copies", "picks"), F.col("source").eqNullSafe(F.col("s")) & (F.col("size") == F.col("l")))
    planned = planned.join(per_source.select(F.col("source").alias("t"), "source_size", "target"), F.col("source").eqNullSafe(F.col("t")))
    planned = planned.select(*[F.col(c).alias(f"p_{c}") for c in cell], "offset", "copies", "picks", "source_size", "target")

    rank = F.row_number().over(Window.partitionBy(*cell).orderBy("h", F.col("doc_id").asc_nulls_first()))
    ranked = placed.withColumn("rank", rank)
    joined = ranked.join(planned, F.col("source").eqNullSafe(F.col("p_source")) & (F.col("size") == F.col("p_size")) & (F.col("bucket") == F.col("p_bucket")))
    picked = (F.col("offset") + F.col("rank") <= F.col("picks")).cast("long")
    return joined.select("doc_id", "text_key", "source", "size", "source_size", "target", (F.col("copies") + picked).alias("copies"))


def take_mix(docs: DataFrame, **options) -> DataFrame:
    """The mixed documents with all columns of ``docs``: each as often as it is taken.

    Rows with equal id, source and text are interchangeable, and the plan's copies of
    them differ by one at most: each takes the mean rounded down, and the rest goes
    one each to as many of them.  Only such repeated rows are ranked together.
    """
    names = [free(c, docs) for c in ("_key", "_all", "_rows", "_rank", "_copy")]
    key, every, rows, rank, copy = names
    id_col, text_col, source_col = (options.get(k, v) for k, v in (("id_col", "doc_id"), ("text_col", "text"), ("source_col", "source")))

    def keyed(i, source, text_key):
        return F.struct(F.col(i).alias("i"), F.col(source).cast("string").alias("s"), text_key.alias("t")).alias(key)

    drawn = mix(docs, **options).groupBy(keyed("doc_id", "source", F.col("text_key"))).agg(F.sum("copies").alias(every), F.count(F.lit(1)).alias(rows))
    mine = docs.withColumn(key, keyed(id_col, source_col, F.xxhash64(text_col)))
    joined = mine.join(settle(drawn.where(F.col(every) > 0)), key)
    ranked = joined.withColumn(rank, F.row_number().over(Window.partitionBy(key).orderBy(key)))
    whole = joined.where(F.col(rows) == 1).withColumn(rank, F.lit(1)).unionByName(ranked.where(F.col(rows) > 1))
    copies = F.floor(F.col(every) / F.col(rows)) + (F.col(rank) <= F.col(every) % F.col(rows)).cast("long")
    return whole.withColumn(copy, F.explode(F.sequence(F.lit(1).cast("long"), copies))).where(copies > 0).select(*docs.columns)
