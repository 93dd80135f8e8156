"""One long series in many tasks: blocks of neighbouring rows with a halo.

A window over a series without a key is one task.  Here rows get their place in the series
from a dealing by ranges (an offset a range and a rank inside it), and places are cut into
blocks of ``BLOCK`` rows, each a task of its own:

* *Rolling* windows see the ``halo`` rows before their block too, so a window of n rows is
  exact with a halo of n - 1.  A lag of k counts as a window of k + 1.
* *Exponential* means without adjustment forget: after enough rows, a weight is below what
  a double can hold of the sum, and a halo of so many rows gives the whole mean.
* *Carried* values and *running* sums are what a block has, put on top of what the blocks
  before it come to: a second window over one row a block.
* *Expanding ranks* count the earlier rows that are smaller: by ranges of values, the
  lower ranges of earlier blocks from a table of counts, the lower ranges of the same
  block inside the block, and the own range inside the range.

The order column must tell the rows of a key apart.  Names that begin with ``_`` and are used
here (_i, _block, _halo, _part) must not be columns of the frame.
"""

from __future__ import annotations

import bisect
import math
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wattline.functions.quantiles import quantiles
from wattline.functions.tables import settle
from wattline.functions.ts import Series

BLOCK = 20_000
#: Value ranges of an expanding rank at most.
MOST_RANGES = 64


def numbered(df: DataFrame, on: str = "date", keys: tuple[str, ...] = ()) -> DataFrame:
    """``df`` with ``_i``, the place in the series (of a key), from 0; written once."""
    dealt = settle(df.repartitionByRange(*keys, on).withColumn("_part", F.spark_partition_id()))
    sizes = dealt.groupBy(*keys, "_part").agg(F.count(F.lit(1)).alias("_m"))
    before = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select(*[F.col(c).alias(f"_g_{c}") for c in keys], F.col("_part").alias("_p"), F.coalesce(F.sum("_m").over(before), F.lit(0)).alias("_start"))
    same = F.col("_part") == F.col("_p")
    for c in keys:
        same = same & F.col(c).eqNullSafe(F.col(f"_g_{c}"))
    place = F.row_number().over(Window.partitionBy(*keys, "_part").orderBy(on)) - 1
    ranked = dealt.withColumn("_i", place).join(starts, same)
    return settle(ranked.withColumn("_i", (F.col("_i") + F.col("_start")).cast("long")).drop("_part", "_p", "_start", *[f"_g_{c}" for c in keys]))


def rolling(df: DataFrame, build: Callable[[Series, DataFrame], DataFrame], halo: int, keys: tuple[str, ...] = (), block: int | None = None) -> DataFrame:
    """``build(series, rows)`` block by block, each with the ``halo`` rows before it.

    ``df`` is ``numbered``; ``series`` is keyed by block, so whatever is built with it is
    one task a block.  ``build`` must keep the rows and the columns it got.
    """
    size = block or BLOCK
    own = F.floor(F.col("_i") / size)
    reach = F.floor((F.col("_i") + halo) / size)
    spread = df.withColumn("_block", F.explode(F.sequence(own, reach))).withColumn("_halo", F.col("_block") != own)
    return build(Series([*keys, "_block"], ["_i"]), spread).where("not _halo").drop("_block", "_halo")


def ewm_halo(alpha: float) -> int:
    """Rows after which the weight of the past is below 2^-60."""
    return 1 if alpha >= 1 else math.ceil(-60 * math.log(2) / math.log1p(-alpha))


def _by_block(df: DataFrame, totals: list[Column], keys: tuple[str, ...], block: int | None) -> tuple[DataFrame, DataFrame]:
    """(df with _block, one row a block with the given aggregates)."""
    rows = df.withColumn("_block", F.floor(F.col("_i") / (block or BLOCK)))
    return rows, rows.groupBy(*keys, "_block").agg(*totals)


def _on_block(rows: DataFrame, blocks: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    named = blocks.select(*[F.col(c).alias(f"_g_{c}") for c in keys], F.col("_block").alias("_b"), *[c for c in blocks.columns if c not in (*keys, "_block")])
    same = F.col("_block") == F.col("_b")
    for c in keys:
        same = same & F.col(c).eqNullSafe(F.col(f"_g_{c}"))
    return rows.join(named, same).drop("_b", *[f"_g_{c}" for c in keys])


def carried(df: DataFrame, column: str, name: str, backward: bool = False, keys: tuple[str, ...] = (), block: int | None = None) -> DataFrame:
    """Adds ``name``: the latest value at or before a row, or with ``backward`` the next one."""
    known = F.col(column).isNotNull()
    edge = F.min_by(column, F.when(known, F.col("_i"))) if backward else F.max_by(column, F.when(known, F.col("_i")))
    rows, blocks = _by_block(df, [edge.alias("_edge")], keys, block)
    across, inside = Window.partitionBy(*keys).orderBy("_block"), Window.partitionBy(*keys, "_block").orderBy("_i")
    if backward:
        beyond = F.first("_edge", ignorenulls=True).over(across.rowsBetween(1, Window.unboundedFollowing))
        near = F.first(column, ignorenulls=True).over(inside.rowsBetween(0, Window.unboundedFollowing))
    else:
        beyond = F.last("_edge", ignorenulls=True).over(across.rowsBetween(Window.unboundedPreceding, -1))
        near = F.last(column, ignorenulls=True).over(inside.rowsBetween(Window.unboundedPreceding, 0))
    out = _on_block(rows.withColumn("_near", near), blocks.withColumn("_edge", beyond), keys)
    return out.withColumn(name, F.coalesce("_near", "_edge")).drop("_near", "_edge", "_block")


def running(df: DataFrame, sums: dict[str, str], keys: tuple[str, ...] = (), block: int | None = None) -> DataFrame:
    """Adds name -> the sum of a column up to each row."""
    rows, blocks = _by_block(df, [F.sum(c).alias(f"_s_{n}") for n, c in sums.items()], keys, block)
    before = Window.partitionBy(*keys).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    upto = Window.partitionBy(*keys, "_block").orderBy("_i").rowsBetween(Window.unboundedPreceding, 0)
    near = rows.withColumns({f"_n_{n}": F.sum(c).over(upto) for n, c in sums.items()})
    out = _on_block(near, blocks.withColumns({f"_s_{n}": F.sum(f"_s_{n}").over(before) for n in sums}), keys)
    both = {n: F.when(F.col(f"_n_{n}").isNotNull() | F.col(f"_s_{n}").isNotNull(), F.coalesce(f"_n_{n}", F.lit(0)) + F.coalesce(f"_s_{n}", F.lit(0))) for n in sums}
    return out.withColumns(both).drop("_block", *[f"_{x}_{n}" for n in sums for x in "sn"])


def expanding_rank(df: DataFrame, column: str, name: str, min_periods: int = 1, block: int | None = None) -> DataFrame:
    """Adds the share of the history up to a row that is below it, ties averaged.

    For one series.  A kernel holds one block or one value range, and between them go
    counts by (block, range), ``MOST_RANGES`` a block.
    """
    size = block or BLOCK
    rows = df.withColumn("_block", F.floor(F.col("_i") / size))
    top = df.agg(F.max("_i").alias("m")).first()["m"]
    ranges = min(MOST_RANGES, max(1, -(-((top or 0) + 1) // size)))
    edges = quantiles(df, column, [k / ranges for k in range(1, ranges)], name="_q").first() if ranges > 1 else None
    edges = sorted(set(edges["_q"])) if edges else []
    which = sum((F.when(F.col(column) > e, 1).otherwise(0) for e in edges), F.lit(0))
    rows = settle(rows.withColumn("_range", F.when(F.col(column).isNotNull(), which)))
    k = len(edges) + 1
    counts = rows.groupBy("_block").agg(*[F.count_if(F.col("_range") == j).alias(f"_c{j}") for j in range(k)])
    before = Window.orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    earlier = counts.select("_block", F.array(*[F.coalesce(F.sum(f"_c{j}").over(before), F.lit(0)) for j in range(k)]).alias("_earlier"))

    def in_block(part: pd.DataFrame) -> pd.DataFrame:
        """Rows of the block before each one: those in lower ranges, and all of them."""
        part = part.sort_values("_i")
        seen, low, known = [0] * k, [], []
        for r in part["_range"]:
            low.append(0 if pd.isna(r) else sum(seen[: int(r)]))
            if not pd.isna(r):
                seen[int(r)] += 1
            known.append(sum(seen))
        return pd.DataFrame({"_j": part["_i"], "_low": low, "_known": known})

    def in_range(part: pd.DataFrame) -> pd.DataFrame:
        """Earlier rows of the range: those below each one, and those equal to it."""
        part = part.sort_values("_i")
        seen, below, equal = [], [], []
        for x in part[column]:
            a, b = bisect.bisect_left(seen, x), bisect.bisect_right(seen, x)
            seen.insert(b, x)
            below.append(a)
            equal.append(b - a)
        return pd.DataFrame({"_k": part["_i"], "_below": below, "_equal": equal})

    lower = rows.groupBy("_block").applyInPandas(in_block, "_j long, _low long, _known long")
    own = rows.where("_range is not null").select("_i", "_range", column).groupBy("_range").applyInPandas(in_range, "_k long, _below long, _equal long")
    out = _on_block(rows, earlier, ()).join(lower, F.col("_i") == F.col("_j")).join(own, F.col("_i") == F.col("_k"), "left")
    prior = F.aggregate(F.slice("_earlier", 1, F.col("_range")), F.lit(0).cast("long"), lambda a, x: a + x)
    n = F.col("_known") + F.aggregate("_earlier", F.lit(0).cast("long"), lambda a, x: a + x)
    share = (prior + F.col("_low") + F.col("_below") + (F.col("_equal") + 2) / 2) / n
    named = out.withColumn(name, F.when(F.col("_range").isNotNull() & (n >= min_periods), share))
    return named.drop("_block", "_range", "_earlier", "_j", "_low", "_known", "_k", "_below", "_equal")
