"""Report frames: KPI rows, snapshots, outlooks, chart frames, text sections."""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wattline.functions.quantiles import quantiles
from wattline.functions.ts import Series
from wattline.operators.align import latest


def kpis(bars: DataFrame, keys: tuple[str, ...] = ("symbol",)) -> DataFrame:
    """Last close, 1-bar and 30-bar change, mean range of 14, volatility of 20."""
    s = Series(keys)
    out = bars.withColumn("_r", s.pct("close")).withColumn("_range", F.col("high") - F.col("low"))
    out = out.withColumns({"change_1": s.pct("close"), "change_30": s.pct("close", 30), "range_14": s.mean("_range", 14), "vol_20": s.std("_r", 20) * F.sqrt(F.lit(252.0))})
    return latest(out, 1, by=keys).select(*keys, "date", "close", "change_1", "change_30", "range_14", "vol_20")


def snapshot(bars: DataFrame, keys: tuple[str, ...] = ("symbol",)) -> DataFrame:
    two = latest(bars.select(*keys, "date", "close"), 2, by=keys)
    return two.groupBy(*keys).agg(F.max("date").alias("date"), F.max_by("close", "date").alias("close"), (F.try_divide(F.max_by("close", "date"), F.min_by("close", "date")) - 1).alias("change"))


def outlook(days: DataFrame, value: str, n: int = 7) -> DataFrame:
    """Mean and sum of the last rows; trend by the sign of the mean of the last 3 steps."""
    s = Series()
    stepped = days.withColumn("_d", s.diff(value))
    last = latest(stepped, n).withColumn("_k", F.row_number().over(Window.orderBy(F.col("date").desc())))
    out = last.agg(F.avg(value).alias("mean"), F.sum(value).alias("total"), F.avg(F.when(F.col("_k") <= 3, F.col("_d"))).alias("_t"))
    return out.select("mean", "total", F.when(F.col("_t") > 0, "rising").when(F.col("_t") < 0, "falling").otherwise("flat").alias("trend"))


def forecast_delta(df: DataFrame, actual: str, predicted: str) -> DataFrame:
    """Last prediction against the last actual, with a 2 percent band."""
    d = df.agg(F.max_by(actual, "date").alias("actual"), F.max_by(predicted, "date").alias("predicted")).withColumn("delta", F.try_divide(F.col("predicted"), F.col("actual")) - 1)
    return d.withColumn("view", F.when(F.col("delta") > 0.02, "higher").when(F.col("delta") < -0.02, "lower").otherwise("steady"))


QUESTIONS = {"supply": "always", "demand": "always", "storage outlook": "always", "price drivers": "always", "storage level": "level is not null", "extreme weather": "tavg < 25 or tavg > 90"}


def questions(state: DataFrame, rules: dict[str, str] = QUESTIONS) -> DataFrame:
    """The questions whose rule holds for a one-row state (level, tavg)."""
    each = [F.when(F.lit(True) if r == "always" else F.expr(r), F.lit(q)) for q, r in rules.items()]
    return state.select(F.explode(F.filter(F.array(*each), lambda q: q.isNotNull())).alias("question"))


def sentiment_summary(df: DataFrame, score: str = "net", n: int = 20) -> DataFrame:
    last = df.orderBy(F.col("date").desc(), "article_id").limit(n)
    rows = F.array_sort(F.collect_list(F.struct((-F.abs(score)).alias("k"), "article_id", "title")))
    out = last.agg(F.avg(score).alias("mean"), F.slice(F.transform(rows, lambda r: r["title"]), 1, 5).alias("headlines"))
    return out.withColumn("regime", F.when(F.col("mean") > 0.1, "positive").when(F.col("mean") < -0.1, "negative").otherwise("neutral"))


def rebased(df: DataFrame, value: str = "value", keys: tuple[str, ...] = (), base: float = 100.0) -> DataFrame:
    """Chart frame: value over its first, times ``base``, and drawdown in percent."""
    s = Series(keys)
    first = F.first(value).over(s.so_far)
    return df.withColumns({"rebased": F.try_divide(F.col(value), first) * base, "drawdown_pct": (F.try_divide(F.col(value), s.cummax(value)) - 1) * 100})


def markers(df: DataFrame, signal: str = "signal", keys: tuple[str, ...] = ()) -> DataFrame:
    """Rows where the signal changes."""
    s = Series(keys)
    return df.withColumn("_p", s.lag(signal)).where(F.col("_p").isNull() | (F.col("_p") != F.col(signal))).drop("_p")


def ladder(df: DataFrame, ret: str = "ret", by: tuple[str, ...] = (), levels: tuple[float, ...] = (0.90, 0.95, 0.975, 0.99, 0.995)) -> DataFrame:
    """Value at risk at several confidence levels in one pass."""
    q = quantiles(df, ret, [1 - c for c in levels], by)
    pair = F.explode(F.arrays_zip(F.array(*[F.lit(c) for c in levels]).alias("c"), F.col("q"))).alias("p")
    return q.select(*by, pair).select(*by, F.col("p.c").alias("confidence"), (-F.col("p.q")).alias("var"))


def percent(x: Column, places: int = 2) -> Column:
    return F.format_string(f"%.{places}f%%", x * 100)


def section(df: DataFrame, line: Column) -> str:
    """Text of a small, already reduced frame."""
    return "\n".join(r[0] for r in df.select(line).collect())


def overlay(prices: DataFrame, scores: DataFrame, price: str = "close", score: str = "net") -> DataFrame:
    """Chart frame: date, price, score on every date that either has."""
    a, b = prices.select("date", F.col(price).alias("price")), scores.select("date", F.col(score).alias("score"))
    return a.join(b, "date", "full")


def heat_cells(monthly: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """keys, year, month, pct, text of a year by month table of returns ("" for no value)."""
    cell = F.explode(F.array(*[F.struct(F.lit(m).alias("month"), F.col(str(m)).alias("x")) for m in range(1, 13)])).alias("c")
    return monthly.select(*keys, "year", cell).select(*keys, "year", "c.month", (F.col("c.x") * 100).alias("pct"), F.coalesce(percent(F.col("c.x"), 1), F.lit("")).alias("text"))


def note_lines(sections: dict[str, tuple[DataFrame, Column]]) -> DataFrame:
    """section_no, section, line: every section's rows as text, in one frame; a section
    without rows says "not available".  Sections are small, already reduced frames."""
    out = None
    for i, (name, (df, line)) in enumerate(sections.items(), 1):
        spoken = df.agg(F.collect_list(line).alias("l")).select(F.lit(i).alias("section_no"), F.lit(name).alias("section"), F.explode(F.when(F.size("l") > 0, F.col("l")).otherwise(F.array(F.lit("not available")))).alias("line"))
        out = spoken if out is None else out.unionByName(spoken)
    return out


def briefing(steps: dict[str, Callable[[], str]]) -> dict[str, Any]:
    """Runs the sections in order; a failing one is noted and the rest go on."""
    text, errors = [], {}
    for name, step in steps.items():
        try:
            text.append(f"## {name}\n{step()}")
        except Exception as e:  # the briefing must come out whatever fails
            errors[name] = str(e)
            text.append(f"## {name}\nnot available")
    return {"text": "\n\n".join(text), "errors": errors}


def annual_signal(df: DataFrame, signal: str = "signal", keys: tuple[str, ...] = ()) -> DataFrame:
    """Mean signal by calendar year, and the days long, short and flat."""
    x = F.col(signal)
    return df.groupBy(*keys, F.year("date").alias("year")).agg(F.avg(x.cast("double")).alias("mean_signal"), F.count_if(x > 0).alias("n_long"), F.count_if(x < 0).alias("n_short"), F.count_if(x == 0).alias("n_flat"))
