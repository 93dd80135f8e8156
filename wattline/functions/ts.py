"""Ordered-series expressions over an explicit key and order column.

Each builds a Column, so that everything a caller asks for on one key and order
shares one exchange and one sort.  Missing values are null, never NaN; a rolling
statistic needs ``min_periods`` non-null values, by default the whole window.
"""

from __future__ import annotations

import bisect
from collections.abc import Iterable

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType


def col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


class Series:
    """A keyed, ordered series: ``Series(["symbol"], ["date"])``."""

    def __init__(self, keys: Iterable[str] = (), order: Iterable[str] = ("date",)):
        self.keys, self.order = list(keys), list(order)

    @property
    def w(self) -> WindowSpec:
        base = Window.partitionBy(*self.keys) if self.keys else Window.partitionBy()
        return base.orderBy(*self.order)

    def last(self, n: int) -> WindowSpec:
        return self.w.rowsBetween(-(n - 1), 0)

    @property
    def so_far(self) -> WindowSpec:
        return self.w.rowsBetween(Window.unboundedPreceding, 0)

    @property
    def before(self) -> WindowSpec:
        return self.w.rowsBetween(Window.unboundedPreceding, -1)

    @property
    def whole(self) -> WindowSpec:
        return Window.partitionBy(*self.keys) if self.keys else Window.partitionBy()

    # positions
    def rank(self) -> Column:
        return F.row_number().over(self.w)

    def lag(self, x, k: int = 1) -> Column:
        return F.lag(col(x), k).over(self.w) if k >= 0 else F.lead(col(x), -k).over(self.w)

    def diff(self, x, k: int = 1) -> Column:
        return col(x) - self.lag(x, k)

    def pct(self, x, k: int = 1) -> Column:
        return F.try_divide(col(x), self.lag(x, k)) - 1

    def log_return(self, x, k: int = 1) -> Column:
        return F.ln(F.try_divide(col(x), self.lag(x, k)))

    # rolling windows
    def roll(self, agg: Column, x, n: int, min_periods: int | None = None) -> Column:
        need = n if min_periods is None else min_periods
        return F.when(F.count(col(x)).over(self.last(n)) >= need, agg.over(self.last(n)))

    def mean(self, x, n, min_periods=None):
        return self.roll(F.avg(col(x)), x, n, min_periods)

    def std(self, x, n, min_periods=None, ddof: int = 1):
        return self.roll((F.stddev_samp if ddof else F.stddev_pop)(col(x)), x, n, min_periods)

    def min(self, x, n, min_periods=None):
        return self.roll(F.min(col(x)), x, n, min_periods)

    def max(self, x, n, min_periods=None):
        return self.roll(F.max(col(x)), x, n, min_periods)

    def sum(self, x, n, min_periods=None):
        return self.roll(F.sum(col(x)), x, n, min_periods)

    def quantile(self, x, p, n, min_periods=None):
        """Linearly interpolated."""
        return self.roll(F.percentile(col(x), p), x, n, min_periods)

    def corr(self, x, y, n, min_periods=None):
        """Null where either side is constant."""
        both = col(x).isNotNull() & col(y).isNotNull()
        a, b, w = F.when(both, col(x)), F.when(both, col(y)), self.last(n)
        bottom = F.stddev_samp(a).over(w) * F.stddev_samp(b).over(w)
        need = n if min_periods is None else min_periods
        return F.when(F.count(a).over(w) >= need, F.try_divide(F.covar_samp(a, b).over(w), bottom))

    def zscore(self, x, n, min_periods=None):
        return F.try_divide(col(x) - self.mean(x, n, min_periods), self.std(x, n, min_periods))

    def position(self, x, n, min_periods=None):
        """Where x lies between the window's least and greatest value, 0 to 1."""
        low, high = self.min(x, n, min_periods), self.max(x, n, min_periods)
        return F.try_divide(col(x) - low, high - low)

    def pct_rank(self, x, n, min_periods=None):
        """Share of the window below x; ties count by their average rank."""
        values = F.filter(F.collect_list(col(x)).over(self.last(n)), lambda v: v.isNotNull())
        below = F.size(F.filter(values, lambda v: v < col(x)))
        equal = F.size(F.filter(values, lambda v: v == col(x)))
        need = n if min_periods is None else min_periods
        return F.when(col(x).isNotNull() & (F.size(values) >= need), (below + (equal + 1) / 2) / F.size(values))

    # carrying
    def ffill(self, x, limit: int | None = None) -> Column:
        w = self.so_far if limit is None else self.w.rowsBetween(-limit, 0)
        return F.last(col(x), ignorenulls=True).over(w)

    def bfill(self, x) -> Column:
        return F.first(col(x), ignorenulls=True).over(self.w.rowsBetween(0, Window.unboundedFollowing))

    # cumulative
    def cumsum(self, x):
        return F.sum(col(x)).over(self.so_far)

    def cumprod(self, x):
        return F.product(col(x)).over(self.so_far)

    def cummax(self, x):
        return F.max(col(x)).over(self.so_far)

    def island(self, cond: Column) -> Column:
        """Number of the run of equal truth a row lies in, by rows where it is false."""
        return F.sum(F.when(cond, 0).otherwise(1)).over(self.so_far)


def flag(cond: Column) -> Column:
    """1 or 0; a comparison with a missing value is 0."""
    return F.coalesce(cond, F.lit(False)).cast("int")


def clip(x, low=None, high=None) -> Column:
    x = out = col(x)
    if low is not None:
        out = F.greatest(out, low if isinstance(low, Column) else F.lit(low))
    if high is not None:
        out = F.least(out, high if isinstance(high, Column) else F.lit(high))
    return F.when(x.isNotNull(), out)


def finite(x) -> Column:
    """Null for NaN and infinities."""
    x = col(x)
    return F.when(~F.isnan(x) & (F.abs(x) != float("inf")), x)


def cyclical(x, period: float, k: int = 1) -> tuple[Column, Column]:
    turn = 2 * F.pi() * k * col(x) / period
    return F.sin(turn), F.cos(turn)


def number(x) -> Column:
    """Numeric coercion: null where the text is no number."""
    return col(x).try_cast("double")


#: US holidays on a fixed day of the year (month-day).
HOLIDAYS = ("01-01", "01-15", "02-19", "05-27", "06-19", "07-04", "09-02", "10-14", "11-11", "11-28", "12-25")


def is_holiday(d) -> Column:
    return flag(F.date_format(col(d), "MM-dd").isin(*HOLIDAYS))


def ewm(df: DataFrame, keys: list[str], order: list[str], specs: dict[str, tuple[str, float, bool]]) -> DataFrame:
    """Adds exponentially weighted means: name -> (column, alpha, adjust).

    Path dependent over the whole history, so each key is one Arrow group kernel,
    linear in its rows; a later spec may use an earlier one's result.
    """
    schema = StructType([*df.schema.fields, *(StructField(name, DoubleType()) for name in specs)])

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(order).reset_index(drop=True)
        for name, (source, alpha, adjust) in specs.items():
            rows[name] = rows[source].astype("float64").ewm(alpha=alpha, adjust=adjust).mean()
        return rows[[f.name for f in schema.fields]]

    grouped = df.groupBy(*keys) if keys else df.groupBy(F.lit("all"))
    return grouped.applyInPandas(run, schema)


def expanding_rank(df: DataFrame, keys: list[str], order: list[str], column: str, name: str, min_periods: int = 1) -> DataFrame:
    """Adds the share of the history up to a row that is below it, ties averaged.

    A frame expression would read the whole history at every row; the kernel keeps
    a sorted history, so a row costs one binary search and one insertion.
    """
    schema = StructType([*df.schema.fields, StructField(name, DoubleType())])

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(order).reset_index(drop=True)
        seen, out = [], []
        for x in rows[column]:
            if x is None or x != x:
                out.append(None)
                continue
            below, upto = bisect.bisect_left(seen, x), bisect.bisect_right(seen, x)
            seen.insert(upto, x)
            out.append((below + (upto - below + 2) / 2) / len(seen) if len(seen) >= min_periods else None)
        return rows.assign(**{name: pd.Series(out, dtype="float64")})

    grouped = df.groupBy(*keys) if keys else df.groupBy(F.lit("all"))
    return grouped.applyInPandas(run, schema)


def span(n: float) -> float:
    return 2.0 / (n + 1.0)
