"""Value at risk, stress, coverage tests and limits over (asset, date, ret)."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wattline.functions.quantiles import Ranges, quantiles
from wattline.functions.ts import Series, clip, col
from wattline.operators.stats import NORMAL, jarque_bera, sample_kurtosis, sample_skew

#: Stress scenarios, price move by risk factor.
SCENARIOS = {
    "polar_vortex": {"natural_gas": 0.40, "power": 0.60, "crude_oil": 0.05, "renewables": -0.15},
    "hurricane_gulf": {"natural_gas": 0.25, "power": 0.10, "crude_oil": 0.15, "renewables": -0.05},
    "pipeline_outage": {"natural_gas": 0.15, "power": 0.35, "crude_oil": 0.02, "renewables": 0.0},
    "demand_collapse": {"natural_gas": -0.30, "power": -0.25, "crude_oil": -0.35, "renewables": 0.05},
    "lng_export_surge": {"natural_gas": 0.50, "power": 0.20, "crude_oil": 0.10, "renewables": 0.0},
    "renewables_intermittency": {"natural_gas": 0.10, "power": 0.30, "crude_oil": 0.0, "renewables": -0.40},
}


def portfolio_returns(returns: DataFrame) -> DataFrame:
    """Unweighted sum over assets by date, as multi-asset inputs are taken."""
    return returns.groupBy("date").agg(F.sum("ret").alias("ret"))


def historical(df: DataFrame, confidence: float = 0.95, horizon: int = 1, by: tuple[str, ...] = ()) -> DataFrame:
    s = Series(by, ["date"])
    moves = df.select(*by, s.sum("ret", horizon).alias("m")) if horizon > 1 else df.select(*by, F.col("ret").alias("m"))
    moves = moves.where("m is not null")
    q = quantiles(moves, "m", [1 - confidence], by).select(*by, (-F.col("q")[0]).alias("var"))
    joined = moves.join(q, list(by)) if by else moves.join(F.broadcast(q))
    return joined.groupBy(*by, "var").agg((-F.avg(F.when(F.col("m") <= -F.col("var"), F.col("m")))).alias("cvar"))


def _moments(df, by):
    return df.groupBy(*by).agg(F.avg("ret").alias("mu"), F.stddev_pop("ret").alias("sd"), sample_skew("ret").alias("skew"), sample_kurtosis("ret").alias("kurt"))


def normal(df: DataFrame, confidence: float = 0.95, horizon: int = 1, by: tuple[str, ...] = ()) -> DataFrame:
    z, root = NORMAL.inv_cdf(1 - confidence), math.sqrt(horizon)
    mu, sd = F.col("mu") * horizon, F.col("sd") * root
    return _moments(df, by).select(*by, (-(mu + z * sd)).alias("var"), (-(mu - sd * NORMAL.pdf(z) / (1 - confidence))).alias("cvar"))


def cornish_fisher(df: DataFrame, confidence: float = 0.95, horizon: int = 1, by: tuple[str, ...] = ()) -> DataFrame:
    z = NORMAL.inv_cdf(1 - confidence)
    zc = z + (z**2 - 1) / 6 * F.col("skew") + (z**3 - 3 * z) / 24 * F.col("kurt") - (2 * z**3 - 5 * z) / 36 * F.col("skew") * F.col("skew")
    out = _moments(df, by).select(*by, (-(F.col("mu") * horizon + zc * F.col("sd") * math.sqrt(horizon))).alias("var"))
    return out.withColumn("cvar", F.col("var") * (1 + 0.3 * (1 - confidence)))


def ewma(df: DataFrame, confidence: float = 0.95, horizon: int = 1, decay: float = 0.94, by: tuple[str, ...] = ()) -> DataFrame:
    """Only the last variance is needed, so the recursion is a weighted sum:
    weights (1 - d) d^k by rank from the end, d^(n-1) on the first row."""
    w = Window.partitionBy(*by)
    k = F.row_number().over(w.orderBy(F.col("date").desc())) - 1
    n = F.count(F.lit(1)).over(w)
    weight = F.when(k == n - 1, F.pow(F.lit(decay), k)).otherwise((1 - decay) * F.pow(F.lit(decay), k))
    ranked = df.select(*by, "ret", weight.alias("weight"))
    z = NORMAL.inv_cdf(1 - confidence)
    sd = F.sqrt(F.sum(F.col("weight") * F.col("ret") * F.col("ret"))) * math.sqrt(horizon)
    return ranked.groupBy(*by).agg((-z * sd).alias("var"), (sd * (NORMAL.pdf(z) / (1 - confidence))).alias("cvar"))


def fit_t(values: np.ndarray) -> tuple[float, float, float]:
    """(degrees of freedom, location, scale) by profile likelihood: for each dof on
    a refined grid, location and scale by the usual reweighting iteration."""

    def profile(dof):
        loc, scale = float(np.median(values)), float(values.std()) or 1e-12
        for _ in range(100):
            w = (dof + 1) / (dof + ((values - loc) / scale) ** 2)
            new = float((w * values).sum() / w.sum())
            size = math.sqrt(float((w * (values - new) ** 2).mean())) or 1e-12
            done = abs(new - loc) + abs(size - scale) < 1e-12
            loc, scale = new, size
            if done:
                break
        z = (values - loc) / scale
        like = len(values) * (math.lgamma((dof + 1) / 2) - math.lgamma(dof / 2) - 0.5 * math.log(dof * math.pi) - math.log(scale)) - (dof + 1) / 2 * np.log1p(z**2 / dof).sum()
        return float(like), loc, scale

    low, high = 0.0, 6.0  # dof = exp
    for _ in range(6):
        grid = np.linspace(low, high, 13)
        best = max(grid, key=lambda g: profile(math.exp(g))[0])
        step = (high - low) / 12
        low, high = best - step, best + step
    return math.exp(best), *profile(math.exp(best))[1:]


def student_quantile(p: float, dof: float) -> float:
    from wattline.operators.stats import student_cdf

    low, high = -1e3, 1e3
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if student_cdf(mid, dof) < p else (low, mid)
    return (low + high) / 2


def student_t(df: DataFrame, confidence: float = 0.95, horizon: int = 1, by: tuple[str, ...] = ()) -> DataFrame:
    """Heavy tails by maximum likelihood, one Arrow group kernel a key."""
    alpha = 1 - confidence

    def fit(rows: pd.DataFrame) -> pd.DataFrame:
        dof, loc, scale = fit_t(rows["ret"].dropna().to_numpy())
        x = student_quantile(alpha, dof)
        pdf = math.exp(math.lgamma((dof + 1) / 2) - math.lgamma(dof / 2)) / math.sqrt(dof * math.pi) * (1 + x * x / dof) ** (-(dof + 1) / 2)
        root = math.sqrt(horizon)
        var = -(loc * horizon + x * scale * root)
        cvar = -loc * horizon + pdf / alpha * (dof + x * x) / (dof - 1) * scale * root
        return pd.DataFrame([{**{k: rows[k].iloc[0] for k in by}, "dof": dof, "var": var, "cvar": cvar}])

    keys = ", ".join(f"{k} {df.schema[k].dataType.simpleString()}" for k in by)
    grouped = df.groupBy(*by) if by else df.groupBy(F.lit("all"))
    return grouped.applyInPandas(fit, (keys + ", " if keys else "") + "dof double, var double, cvar double")


def bootstrap(df: DataFrame, confidence: float = 0.95, horizon: int = 10, sims: int = 10_000, seed: int = 42) -> DataFrame:
    """Sums of ``horizon`` returns drawn with replacement, ``sims`` times.

    A draw is a rank among the sorted returns, from a hash of its number and the seed, so
    reruns agree; the ranks are looked up in ranges of the returns, many at a time, and
    the returns are nowhere in one task.
    """
    ranges = Ranges(df, "ret")
    uniform = F.pmod(F.xxhash64(F.lit(seed), "id"), F.lit(1 << 52)) / float(1 << 52)
    draws = df.sparkSession.range(sims * horizon).select((F.col("id") % sims).alias("sim"), uniform.alias("u"))
    ranks = draws.join(F.broadcast(ranges.groups.select("_count"))).select("sim", F.floor(F.col("u") * F.col("_count")).alias("rank"))
    return historical(ranges.at(ranks).groupBy("sim").agg(F.sum("value").alias("ret")), confidence)


def component(returns: DataFrame, weights: dict[str, float], confidence: float = 0.95) -> DataFrame:
    """Share of each asset in the normal VaR: weight * beta * VaR; shares add up."""
    w = F.create_map(*[x for k, v in weights.items() for x in (F.lit(k), F.lit(float(v)))])
    held = returns.withColumn("w", F.coalesce(F.try_element_at(w, F.col("asset")), F.lit(0.0)))
    complete = held.groupBy("date").agg(F.sum(F.col("w") * F.col("ret")).alias("p"), F.count(F.lit(1)).alias("k")).where(F.col("k") == len(weights))
    joined = held.join(complete, "date")
    total = complete.agg(F.stddev_samp("p").alias("sd"))
    z = -NORMAL.inv_cdf(1 - confidence)
    each = joined.groupBy("asset", "w").agg(F.covar_samp("ret", "p").alias("cov")).join(F.broadcast(total))
    return each.select("asset", "w", F.try_divide(F.col("cov"), F.col("sd") * F.col("sd")).alias("beta"), (F.col("w") * F.try_divide(F.col("cov"), F.col("sd")) * z).alias("component_var"), (F.col("sd") * z).alias("portfolio_var"))


def tail_statistics(df: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    s = Series(by, ["date"])
    worth = df.withColumn("_v", s.cumprod(1 + F.col("ret"))).withColumn("_dd", F.col("_v") / s.cummax("_v") - 1)
    worth = worth.withColumn("_r", F.row_number().over(Window.partitionBy(*by).orderBy("ret")))
    return worth.groupBy(*by).agg(
        F.avg("ret").alias("mean_daily"),
        F.stddev_pop("ret").alias("std_daily"),
        (F.stddev_pop("ret") * math.sqrt(252)).alias("annualized_vol"),
        sample_skew("ret").alias("skewness"),
        sample_kurtosis("ret").alias("excess_kurtosis"),
        F.min("ret").alias("min_daily_return"),
        F.max("ret").alias("max_daily_return"),
        F.avg(F.when(F.col("_r") <= 5, F.col("ret"))).alias("worst_5_avg"),
        jarque_bera("ret").alias("jarque_bera_stat"),
        F.exp(-jarque_bera("ret") / 2).alias("jarque_bera_pval"),
        (F.avg((F.col("ret") < 0).cast("double")) * 100).alias("pct_negative_days"),
        F.min("_dd").alias("max_drawdown"),
    )


def stress(positions: DataFrame, shocks: DataFrame, default_factor: str = "natural_gas") -> DataFrame:
    """P&L by scenario, worst first: notional * shock of the position's factor; an
    unknown factor takes the default factor's shock, or none."""
    names = shocks.select("scenario").distinct()
    own = shocks.select("scenario", F.col("factor").alias("_f"), F.col("shock").alias("_own"))
    usual = shocks.where(F.col("factor") == default_factor).select("scenario", F.col("shock").alias("_usual"))
    p = positions.join(F.broadcast(names)).withColumn("_factor", F.coalesce("factor", F.lit(default_factor)))
    p = p.join(own, (p["scenario"] == own["scenario"]) & (F.col("_factor") == F.col("_f")), "left").drop(own["scenario"])
    hit = p.join(usual, "scenario", "left").withColumn("pnl", F.col("notional") * F.coalesce("_own", F.when(F.col("factor").isNull(), F.col("_usual")), F.lit(0.0)))
    by = hit.groupBy("scenario").agg(F.sum("pnl").alias("pnl"), F.try_divide(F.sum("pnl"), F.sum(F.abs("notional"))).alias("pnl_pct"), F.min_by("asset", F.struct("pnl", "asset")).alias("worst_asset"))
    return by


def reverse_stress(positions: DataFrame, loss: float, default_factor: str = "natural_gas") -> DataFrame:
    """factor, exposure, shock: the move of each factor alone that loses ``loss``.

    A position without a factor takes the default one; factors without exposure have no
    such move and are left out.
    """
    by = positions.groupBy(F.coalesce("factor", F.lit(default_factor)).alias("factor")).agg(F.sum("notional").alias("exposure"))
    return by.where(F.abs("exposure") > 1e-6).withColumn("shock", F.lit(-float(loss)) / F.col("exposure"))


def dashboard(returns: DataFrame, weights: dict[str, float], positions: DataFrame, shocks: DataFrame, value: float = 1e6) -> DataFrame:
    """section, item, value: every VaR of the portfolio, each asset's part of it, the loss by
    scenario and the tail statistics, in one long table."""
    book = portfolio_returns(returns)
    parts = [
        full_analysis(book).select(F.lit("var").alias("section"), F.col("method").alias("item"), (F.col("var") * value).alias("value")),
        component(returns, weights).select(F.lit("component"), F.col("asset"), F.col("component_var") * value),
        stress(positions, shocks).select(F.lit("stress"), F.col("scenario"), F.col("pnl")),
    ]
    tails = tail_statistics(book.withColumn("asset", F.lit("portfolio")), ("asset",)).drop("asset")
    names = [f.name for f in tails.schema.fields]
    parts.append(tails.select(F.explode(F.array(*[F.struct(F.lit(n).alias("item"), F.col(n).cast("double").alias("value")) for n in names])).alias("x")).select(F.lit("tail"), "x.item", "x.value"))
    out = parts[0]
    for more in parts[1:]:
        out = out.union(more)
    return out


def scenario_table(spark, scenarios: dict = SCENARIOS) -> DataFrame:
    return spark.createDataFrame([(s, f, float(x)) for s, m in scenarios.items() for f, x in m.items()], "scenario string, factor string, shock double")


def rolling_var(df: DataFrame, window: int = 252, confidence: float = 0.99, min_periods: int = 60, by: tuple[str, ...] = ()) -> DataFrame:
    s = Series(by, ["date"])
    return df.withColumn("var", -s.quantile("ret", 1 - confidence, window, min_periods))


def kupiec(df: DataFrame, confidence: float = 0.99, by: tuple[str, ...] = ()) -> DataFrame:
    """Proportion-of-failures test on rows with ret and var."""
    p = 1 - confidence
    base = df.where("ret is not null and var is not null").groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("ret") < -F.col("var")).alias("exceeded"))
    rate = F.col("exceeded") / F.col("n")
    inside = (rate > 0) & (rate < 1)
    lr = -2 * (F.col("exceeded") * F.ln(p / rate) + (F.col("n") - F.col("exceeded")) * F.ln((1 - p) / (1 - rate)))
    out = base.select(*by, "n", "exceeded", rate.alias("rate"), F.when(inside, lr).otherwise(0.0).alias("lr"))
    return out.withColumns({"p_value": chi2_tail(F.col("lr")), "accepted": F.col("lr") < 3.841458820694124})


def chi2_tail(x: Column) -> Column:
    """Upper tail of chi-squared with one degree of freedom: 1 - erf(sqrt(x / 2)).

    erf(z) = exp(-z^2) * sum of z^(2n+1) / gamma(n + 3/2), all terms positive, so nothing
    cancels; 200 terms reach double precision up to x = 100, beyond which the tail is below
    1e-22 and given as 0.
    """
    half = F.greatest(x, F.lit(0.0)) / 2
    z = F.sqrt(half)
    first = 2 * z / F.sqrt(F.pi())
    start = F.struct(first.alias("term"), first.alias("total"))

    def step(acc, n):
        term = acc["term"] * half / (n + 0.5)
        return F.struct(term.alias("term"), (acc["total"] + term).alias("total"))

    total = F.aggregate(F.sequence(F.lit(1), F.lit(200)), start, step, lambda acc: acc["total"])
    return F.when(x > 100, 0.0).otherwise(F.greatest(1 - F.exp(-half) * total, F.lit(0.0)))


def kupiec_p_value(lr: float) -> float:
    """Upper tail of chi-squared with one degree of freedom."""
    return 2 * (1 - NORMAL.cdf(math.sqrt(max(lr, 0.0))))


def full_analysis(df: DataFrame, confidence: float = 0.95) -> DataFrame:
    """Six methods on one return series, stacked."""
    methods = {"historical": historical, "normal": normal, "cornish_fisher": cornish_fisher, "ewma": ewma}
    out = None
    for name, f in methods.items():
        one = f(df, confidence).select(F.lit(name).alias("method"), "var", "cvar")
        out = one if out is None else out.unionByName(one)
    out = out.unionByName(student_t(df, confidence).select(F.lit("student_t").alias("method"), "var", "cvar"))
    return out.unionByName(bootstrap(df, confidence, 1).select(F.lit("bootstrap").alias("method"), "var", "cvar"))


class Limits:
    """Position and loss limits as expressions."""

    def __init__(self, max_position: float = 0.20, max_drawdown: float = 0.15, stop_atr: float = 2.0, target_atr: float = 4.0):
        self.max_position, self.max_drawdown, self.stop_atr, self.target_atr = max_position, max_drawdown, stop_atr, target_atr

    def cap(self, size) -> Column:
        return clip(size, -self.max_position, self.max_position)

    def stop(self, entry, atr, direction) -> Column:
        return col(entry) - col(direction) * self.stop_atr * col(atr)

    def target(self, entry, atr, direction) -> Column:
        return col(entry) + col(direction) * self.target_atr * col(atr)

    def halted(self, df: DataFrame, value: str = "value", by: tuple[str, ...] = (), start: float = 1.0) -> DataFrame:
        """Adds drawdown from the peak (never under ``start``) and the latched halt."""
        s = Series(by, ["date"])
        peak = F.greatest(s.cummax(value), F.lit(start))
        out = df.withColumn("drawdown", (F.col(value) - peak) / peak)
        return out.withColumn("halted", F.max((F.col("drawdown") < -self.max_drawdown).cast("int")).over(s.so_far) == 1)

    def var(self, df: DataFrame, confidence: float = 0.95, lookback: int = 252) -> DataFrame:
        """Loss at a quantile of the last rows; 0 with fewer than 30."""
        last = df.where("ret is not null").orderBy(F.col("date").desc()).limit(lookback)
        return last.agg(F.when(F.count("ret") >= 30, F.abs(F.percentile("ret", 1 - confidence))).otherwise(0.0).alias("var"))
