"""Time alignment: as-of joins, calendar spines, resampling, dedup."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wattline.functions.quantiles import quantiles
from wattline.functions.ts import Series


def asof_join(left: DataFrame, right: DataFrame, on: str = "date", by: tuple[str, ...] = (), values: tuple[str, ...] = ()) -> DataFrame:
    """Adds to each left row the latest right values at or before its time.

    One union and one window: a single shuffle by ``by``, no range explosion.  A
    null right value never hides an older one.
    """
    values = values or tuple(c for c in right.columns if c != on and c not in by)
    keys = [*by, on]
    l = left.select(*[F.col(k).alias(f"_{k}") for k in keys], F.struct(*left.columns).alias("_row"), *[F.lit(None).cast(right.schema[v].dataType).alias(f"_v_{v}") for v in values], F.lit(1).alias("_side"))
    r = right.select(*[F.col(k).alias(f"_{k}") for k in keys], F.lit(None).cast(l.schema["_row"].dataType).alias("_row"), *[F.col(v).alias(f"_v_{v}") for v in values], F.lit(0).alias("_side"))
    w = Window.partitionBy(*[f"_{b}" for b in by]).orderBy(f"_{on}", "_side").rowsBetween(Window.unboundedPreceding, 0)
    both = l.unionByName(r)
    filled = both.select("_row", "_side", *[F.last(f"_v_{v}", ignorenulls=True).over(w).alias(v) for v in values])
    return filled.where("_side = 1").select("_row.*", *values)


def spine(df: DataFrame, on: str = "date", by: tuple[str, ...] = (), step: str = "1 day") -> DataFrame:
    """Every date between the first and last of each key."""
    ends = df.groupBy(*by).agg(F.min(on).alias("_a"), F.max(on).alias("_b"))
    days = ends.select(*by, F.explode(F.sequence("_a", "_b", F.expr(f"interval {step}"))).alias(on))
    return days.select(*by, F.col(on).cast(df.schema[on].dataType).alias(on))


def upsample_ffill(df: DataFrame, on: str = "date", by: tuple[str, ...] = (), values: tuple[str, ...] = ()) -> DataFrame:
    """Daily rows with the last known values carried forward."""
    values = values or tuple(c for c in df.columns if c != on and c not in by)
    s = Series(by, [on])
    full = spine(df, on, by).join(df, [*by, on], "left")
    return full.select(*by, on, *[s.ffill(v).alias(v) for v in values])


def reindex_ffill(left: DataFrame, right: DataFrame, on: str = "date", by: tuple[str, ...] = (), values: tuple[str, ...] = ()) -> DataFrame:
    """Exact match on the date, then carry forward on the left's dates (not as-of)."""
    values = values or tuple(c for c in right.columns if c != on and c not in by)
    s = Series(by, [on])
    joined = left.join(right, [*by, on], "left")
    return joined.select(*left.columns, *[s.ffill(v).alias(v) for v in values])


def resample_daily(df: DataFrame, value: str, ts: str = "ts", by: tuple[str, ...] = ()) -> DataFrame:
    """total, peak, least, mean, spread and number of readings by day."""
    day = F.to_date(ts).alias("date")
    v = F.col(value)
    return df.groupBy(*by, day).agg(
        F.sum(v).alias("total"), F.max(v).alias("peak"), F.min(v).alias("low"), F.avg(v).alias("mean"), F.stddev_samp(v).alias("std"), F.count(v).alias("n")
    )


def resample(df: DataFrame, unit: str, aggs: dict[str, Column], on: str = "date", by: tuple[str, ...] = ()) -> DataFrame:
    """Totals by calendar unit (week, month, quarter, year)."""
    return df.groupBy(*by, F.trunc(on, unit).alias(on)).agg(*[a.alias(n) for n, a in aggs.items()])


def daily_ramp(df: DataFrame, value: str, ts: str = "ts", by: tuple[str, ...] = ()) -> DataFrame:
    """Largest hour-to-hour change of a day; the change into a day counts for it."""
    s = Series(by, [ts])
    moved = df.withColumn("_step", F.abs(s.diff(value)))
    return moved.groupBy(*by, F.to_date(ts).alias("date")).agg(F.max("_step").alias("ramp"))


def peak_offpeak(df: DataFrame, value: str, ts: str = "ts", by: tuple[str, ...] = (), first: int = 7, last: int = 22) -> DataFrame:
    peak = F.hour(ts).between(first, last)
    return df.groupBy(*by, F.to_date(ts).alias("date")).agg(F.avg(F.when(peak, F.col(value))).alias("peak_mean"), F.avg(F.when(~peak, F.col(value))).alias("offpeak_mean"))


def stride(df: DataFrame, step: int, on: str = "date", by: tuple[str, ...] = ()) -> DataFrame:
    s = Series(by, [on])
    return df.withColumn("_i", s.rank()).where((F.col("_i") - 1) % step == 0).drop("_i")


def latest(df: DataFrame, n: int, on: str = "date", by: tuple[str, ...] = ()) -> DataFrame:
    w = Window.partitionBy(*by).orderBy(F.col(on).desc())
    return df.withColumn("_i", F.row_number().over(w)).where(F.col("_i") <= n).drop("_i")


def lookback(df: DataFrame, days: int, on: str = "date") -> DataFrame:
    """Rows of the last ``days`` days of the table."""
    end = df.agg(F.date_sub(F.max(on), days).alias("_from"))
    return df.join(F.broadcast(end), F.col(on) >= F.col("_from")).drop("_from")


def dedup_last(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """One row a key, the last in ``order``."""
    w = Window.partitionBy(*keys).orderBy(*[c.desc() for c in order])
    return df.withColumn("_i", F.row_number().over(w)).where("_i = 1").drop("_i")


def every_key(df: DataFrame, key: str, on: str = "date") -> DataFrame:
    """Only the dates that every value of ``key`` has."""
    n = df.agg(F.count_distinct(key).alias("_n"))
    full = df.groupBy(on).agg(F.count_distinct(key).alias("_m")).join(F.broadcast(n), F.col("_m") == F.col("_n")).select(on)
    return df.join(full, on, "left_semi")


def outliers_removed(df: DataFrame, value: str, by: tuple[str, ...] = (), reach: float = 2.0) -> DataFrame:
    """Keeps p01 - reach * (p99 - p01) <= value <= p99 + reach * (p99 - p01)."""
    q = quantiles(df, value, [0.01, 0.99], by, "_q").select(*by, F.col("_q")[0].alias("_l"), F.col("_q")[1].alias("_h"))
    wide = (F.col("_h") - F.col("_l")) * reach
    inside = F.col(value).between(F.col("_l") - wide, F.col("_h") + wide)
    joined = df.join(q, list(by)) if by else df.join(F.broadcast(q))
    return joined.where(inside).drop("_l", "_h")


def streaks(df: DataFrame, cond: Column, on: str = "date", by: tuple[str, ...] = ()) -> DataFrame:
    """Adds ``streak``: how many rows in a row, up to this one, the condition holds."""
    s = Series(by, [on])
    marked = df.withColumn("_ok", F.coalesce(cond, F.lit(False))).withColumn("_g", s.island(F.col("_ok")))
    run = Series([*by, "_g"], [on])
    return marked.withColumn("streak", F.sum(F.col("_ok").cast("int")).over(run.so_far)).drop("_ok", "_g")
