"""Exact order statistics of groups of any size, without one task a group.

``percentile`` gathers every distinct value of a group in one task.  Here equal values are
counted first, with a map-side combine, and the counts are dealt out by ranges of (group,
value).  The sum of each range, a row a range and group, says which range holds a rank,
and only inside the ranges is anything ordered: the largest task is one range, whatever
the size of the group, and a value that a third of all rows share is one row.

Nulls do not count.  A group without a value has no row.  Null keys are a group.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wattline.functions.tables import settle


class Ranges:
    """The values of ``df`` by group, counted and dealt out by ranges; written once."""

    def __init__(self, df: DataFrame, value: str, by: tuple[str, ...] = ()):
        self.by = list(by)
        keyed = df.select(*by, F.col(value).alias("_v")).where("_v is not null")
        counted = keyed.groupBy(*by, "_v").agg(F.count(F.lit(1)).alias("_n"))
        # Part numbers come from the dealing itself and are kept with the rows.
        self.rows = settle(counted.repartitionByRange(*by, "_v").withColumn("_part", F.spark_partition_id()))
        self.value_type = self.rows.schema["_v"].dataType.simpleString()
        parts = self.rows.groupBy(*by, "_part").agg(F.sum("_n").alias("_m"))
        ends = F.sort_array(F.collect_list(F.struct("_part", "_m")))
        #: One row a group: its parts in order with their sizes, and the number of its values.
        self.groups = parts.groupBy(*by).agg(ends.alias("_parts"), F.sum("_m").alias("_count"))

    def _match(self, targets: DataFrame) -> DataFrame:
        """``targets`` (by, rank, ...) with the part that holds the rank and the rank in it."""
        named = self.groups.select(*[F.col(c).alias(f"_g_{c}") for c in self.by], "_parts")
        same = F.lit(True)
        for c in self.by:
            same = same & F.col(c).eqNullSafe(F.col(f"_g_{c}"))
        joined = targets.join(named, same) if self.by else targets.join(F.broadcast(named))
        start = F.struct(F.lit(None).cast("int").alias("part"), F.col("rank").cast("long").alias("left"))

        def walk(acc, p):
            """The first part whose end is beyond the rank, and what is left of the rank there."""
            here = acc["part"].isNull() & (acc["left"] < p["_m"])
            past = acc["part"].isNull() & ~here
            return F.struct(F.when(here, p["_part"]).otherwise(acc["part"]).alias("part"), F.when(past, acc["left"] - p["_m"]).otherwise(acc["left"]).alias("left"))

        found = joined.withColumn("_at", F.aggregate("_parts", start, walk))
        return found.withColumns({"_part": F.col("_at.part"), "_pos": F.col("_at.left")}).where("_part is not null").drop("_at", "_parts", *[f"_g_{c}" for c in self.by])

    def at(self, targets: DataFrame) -> DataFrame:
        """``targets`` with ``value``: that of the given rank, from 0, in its group.

        Rows and targets of a part are merged in one sorted pass, so there may be many
        targets.  Ranks beyond a group have no row.
        """
        others = [c for c in targets.columns if c not in self.by]
        inside = Window.partitionBy(*self.by, "_part")
        begin = F.sum("_n").over(inside.orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)) - F.col("_n")
        wanted = self._match(targets).select(*self.by, "_part", "_pos", F.struct(*others).alias("_target"))
        held = self.rows.join(F.broadcast(wanted.select("_part").distinct()), "_part", "left_semi") if not self.by else self.rows
        steps = held.select(*self.by, "_part", begin.alias("_pos"), F.col("_v"))
        merged = steps.withColumn("_target", F.lit(None).cast(wanted.schema["_target"].dataType)).unionByName(wanted.withColumn("_v", F.lit(None).cast(self.value_type)))
        upto = inside.orderBy("_pos", F.col("_target").isNotNull()).rowsBetween(Window.unboundedPreceding, 0)
        last = merged.withColumn("value", F.last("_v", ignorenulls=True).over(upto)).where("_target is not null")
        return last.select(*self.by, *[F.col(f"_target.{c}").alias(c) for c in others], "value")


def quantiles(df: DataFrame, value: str, probabilities: list[float], by: tuple[str, ...] = (), name: str = "q") -> DataFrame:
    """by, ``name``: array of linearly interpolated quantiles, exact for any group size."""
    ranges = Ranges(df, value, by)
    p = F.posexplode(F.array(*[F.lit(float(x)) for x in probabilities])).alias("_i", "_p")
    places = ranges.groups.select(*by, "_count", p).withColumn("_h", F.col("_p") * (F.col("_count") - 1))
    low, high = F.floor("_h"), F.ceil("_h")
    side = F.explode(F.array(F.struct(low.alias("rank"), (1 - (F.col("_h") - low)).alias("_w")), F.struct(high.alias("rank"), (F.col("_h") - low).alias("_w")))).alias("_s")
    targets = places.select(*by, "_i", side).select(*by, "_i", F.col("_s.rank").alias("rank"), F.col("_s._w").alias("_w"))
    # The upper neighbour of a whole position has no weight.
    each = ranges.at(targets).groupBy(*by, "_i").agg(F.sum(F.when(F.col("_w") > 0, F.col("_w") * F.col("value")).otherwise(0.0)).alias("_x"))
    out = each.groupBy(*by).agg(F.transform(F.sort_array(F.collect_list(F.struct("_i", "_x"))), lambda s: s["_x"]).alias(name))
    # Without keys an empty table would still make a row.
    return out.where(F.size(name) > 0)
