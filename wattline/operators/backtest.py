"""Backtest, performance report and analysis as window plans over (keys, date)."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wattline.functions.ts import Series


@dataclass(frozen=True)
class Config:
    capital: float = 1_000_000.0
    cost_bps: float = 5.0
    slippage_bps: float = 2.0
    max_drawdown: float = 0.15


def run(df: DataFrame, config: Config = Config(), keys: tuple[str, ...] = (), price: str = "close", signal: str = "signal", size: str | None = None, halt: bool = True) -> DataFrame:
    """Adds position, price_returns, gross_returns, costs, net, value, drawdown.

    Positions take effect one bar late.  After the first bar whose drawdown passes
    the limit, later bars have no position, returns or costs; the halt is a running
    maximum of the breach, lagged by one, so no loop is needed.
    """
    s = Series(keys, ["date"])
    target = F.col(signal) * (F.col(size) if size else F.lit(1.0))
    out = df.withColumn("position", F.coalesce(s.lag(target), F.lit(0.0)))
    out = out.withColumn("price_returns", F.coalesce(s.pct(price), F.lit(0.0)))
    rate = (config.cost_bps + config.slippage_bps) / 10_000
    out = out.withColumns({"gross_returns": F.col("position") * F.col("price_returns"), "costs": F.abs(F.col("position") - F.coalesce(s.lag("position"), F.lit(0.0))) * rate})
    out = out.withColumn("net", F.col("gross_returns") - F.col("costs")).withColumn("n_changes", (F.abs(F.col("position") - s.lag("position")) > 0).cast("int"))

    def equity(frame):
        frame = frame.withColumn("value", config.capital * s.cumprod(1 + F.col("net")))
        return frame.withColumn("drawdown", F.col("value") / s.cummax("value") - 1)

    out = equity(out)
    if halt:
        floor = F.greatest(s.cummax("value"), F.lit(config.capital))
        out = out.withColumn("_breach", ((F.col("value") - floor) / floor < -config.max_drawdown).cast("int"))
        out = out.withColumn("halted", F.coalesce(F.max("_breach").over(s.before), F.lit(0)) == 1).drop("_breach")
        zero = {c: F.when(F.col("halted"), 0.0).otherwise(F.col(c)) for c in ("position", "costs", "net")}
        out = equity(out.withColumns(zero))
    return out


def report(result: DataFrame, keys: tuple[str, ...] = (), risk_free: float = 0.05, days: int = 252) -> DataFrame:
    """One row a key: returns, volatility, Sharpe, Sortino, drawdowns, VaR, trades."""
    s = Series(keys, ["date"])
    daily = risk_free / days
    under = F.col("value") < s.cummax("value")
    marked = result.withColumn("_u", under).withColumn("_g", s.island(under))
    run_length = F.sum(F.col("_u").cast("int")).over(Window.partitionBy(*keys, "_g"))
    marked = marked.withColumn("_len", run_length).withColumn("_x", F.col("net") - daily)
    n = F.count(F.lit(1))
    growth = F.try_divide(F.max_by("value", "date"), F.min_by("value", "date"))
    root = F.sqrt(F.lit(float(days)))
    sd, down = F.stddev_samp("_x"), F.stddev_samp(F.when(F.col("_x") < 0, F.col("_x")))
    base = marked.groupBy(*keys).agg(
        (growth - 1).alias("total_return"),
        (F.pow(growth, days / n) - 1).alias("annualised_return"),
        (F.stddev_samp("net") * root).alias("annualised_volatility"),
        F.coalesce(F.try_divide(F.avg("_x"), F.when(sd != 0, sd)) * root, F.lit(0.0)).alias("sharpe"),
        F.coalesce(F.try_divide(F.avg("_x"), F.when(down != 0, down)) * root, F.lit(0.0)).alias("sortino"),
        F.min("drawdown").alias("max_drawdown"),
        F.max("_len").alias("max_drawdown_days"),
        F.percentile("net", 0.05).alias("var_95"),
        F.percentile("net", 0.01).alias("var_99"),
        F.sum(F.coalesce("n_changes", F.lit(0))).alias("total_trades"),
    )
    return base.withColumn("calmar", F.coalesce(F.abs(F.try_divide(F.col("annualised_return"), F.col("max_drawdown"))), F.lit(0.0)))


def rolling_sharpe(result: DataFrame, keys: tuple[str, ...] = (), window: int = 252, risk_free: float = 0.05, days: int = 252) -> DataFrame:
    s = Series(keys, ["date"])
    x = F.col("net") - risk_free / days
    sd = s.std(x, window)
    # Constant returns, as after a halt, have a deviation of rounding errors only.
    return result.withColumn("rolling_sharpe", F.try_divide(s.mean(x, window), F.when(sd > 1e-12, sd)) * F.sqrt(F.lit(float(days))))


def monthly_returns(result: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """Year by month table of compounded returns."""
    monthly = result.groupBy(*keys, F.year("date").alias("year"), F.month("date").alias("month")).agg((F.product(1 + F.col("net")) - 1).alias("ret"))
    return monthly.groupBy(*keys, "year").pivot("month", list(range(1, 13))).agg(F.first("ret"))


def drawdown_periods(result: DataFrame, keys: tuple[str, ...] = (), min_days: int = 5) -> DataFrame:
    """Closed drawdowns: start, end (first recovered date), trough date, depth, days."""
    s = Series(keys, ["date"])
    under = F.coalesce(F.col("drawdown") < -1e-9, F.lit(False))  # a running product is not exact
    marked = result.withColumn("_u", under).withColumn("_g", s.island(F.col("_u"))).withColumn("_next", s.lag("date", -1))
    runs = marked.where("_u").groupBy(*keys, "_g").agg(
        F.min("date").alias("start"), F.max_by("_next", "date").alias("end"), F.min_by("date", F.struct("drawdown", "date")).alias("trough"), F.min("drawdown").alias("depth")
    )
    return runs.where(F.col("end").isNotNull()).withColumn("days", F.date_diff("end", "start")).where(F.col("days") >= min_days).drop("_g")


def trade_statistics(trades: DataFrame, keys: tuple[str, ...] = (), pnl: str = "pnl_pct") -> DataFrame:
    """Number of trades, win rate, profit factor (null without a loss), mean, best, worst."""
    x = F.col(pnl)
    loss = F.abs(F.sum(F.when(x < 0, x)))
    return trades.where(x.isNotNull()).groupBy(*keys).agg(
        F.count(x).alias("total_trades"), F.avg((x > 0).cast("double")).alias("win_rate"), F.try_divide(F.coalesce(F.sum(F.when(x > 0, x)), F.lit(0.0)), F.when(loss > 0, loss)).alias("profit_factor"),
        F.avg(x).alias("avg_trade_return"), F.max(x).alias("best_trade"), F.min(x).alias("worst_trade"),
    )


def compare(result: DataFrame, benchmark: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """Reports of a strategy and a benchmark, stacked."""
    return report(result, keys).withColumn("name", F.lit("strategy")).unionByName(report(benchmark, keys).withColumn("name", F.lit("benchmark")))
