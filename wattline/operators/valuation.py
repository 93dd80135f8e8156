"""Gas storage: forward curve, mean reversion, intrinsic and simulated value."""

from __future__ import annotations

import itertools
import math
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wattline.functions.ts import Series, col


@dataclass(frozen=True)
class Asset:
    capacity: float = 10.0
    floor: float = 0.5
    inject_day: float = 0.2
    withdraw_day: float = 0.4
    inject_cost: float = 0.03
    withdraw_cost: float = 0.02
    fuel_loss: float = 0.02
    ratchets: bool = False

    @staticmethod
    def salt_cavern() -> Asset:
        return Asset()

    @staticmethod
    def depleted_reservoir() -> Asset:
        return Asset(50.0, 5.0, 0.3, 0.5, 0.05, 0.04, 0.03, True)


def ratchet(fill, inject: bool) -> Column:
    """Rate factor by fill: injection slows when full, withdrawal when empty."""
    f = col(fill)
    if inject:
        return F.when(f > 0.9, 0.5).when(f > 0.7, 0.8).otherwise(1.0)
    return F.when(f < 0.15, 0.5).when(f < 0.30, 0.8).otherwise(1.0)


def seasonal_factors(prices: DataFrame, price: str = "close") -> DataFrame:
    """Mean of monthly means by calendar month over the overall mean, averaging 1."""
    monthly = prices.groupBy(F.trunc("date", "month").alias("m")).agg(F.avg(price).alias("p"))
    by = monthly.groupBy(F.month("m").alias("month")).agg(F.avg("p").alias("p"))
    norm = by.agg(F.avg("p").alias("_a"))
    return by.join(F.broadcast(norm)).select("month", F.try_divide(F.col("p"), F.col("_a")).alias("factor"))


def forward_curve(prices: DataFrame, start_month: int, months: int = 12, spot: float | None = None, price: str = "close") -> DataFrame:
    """step, month, forward: the last price (or ``spot``) times the month's factor."""
    spark = prices.sparkSession
    steps = spark.range(months).select(F.col("id").alias("step"), ((F.lit(start_month - 1) + F.col("id")) % 12 + 1).cast("int").alias("month"))
    base = prices.agg(F.max_by(price, "date").alias("base")) if spot is None else spark.range(1).select(F.lit(float(spot)).alias("base"))
    return steps.join(F.broadcast(seasonal_factors(prices, price)), "month").join(F.broadcast(base)).select("step", "month", (F.col("base") * F.col("factor")).alias("forward"))


def ou_calibrate(prices: DataFrame, by: tuple[str, ...] = (), price: str = "close", days: int = 252) -> DataFrame:
    """Least squares of the daily change on the level, by closed-form aggregates."""
    s = Series(by)
    x, y = F.col("_x"), F.col("_y")
    pairs = prices.select(*by, F.col(price).alias("_p"), s.lag(price).alias("_x"), s.diff(price).alias("_y")).where("_x is not null")
    fit = pairs.groupBy(*by).agg(
        F.regr_slope(y, x).alias("b"), F.regr_intercept(y, x).alias("a"), F.avg("_p").alias("mean"),
        F.sqrt(F.greatest(F.try_divide(F.regr_syy(y, x) - F.try_divide(F.regr_sxy(y, x) * F.regr_sxy(y, x), F.regr_sxx(y, x)), F.regr_count(y, x)), F.lit(0.0))).alias("eps"),
    )
    kappa = F.greatest(-F.col("b") * days, F.lit(0.01))
    return fit.select(*by, kappa.alias("kappa"), F.when(F.abs("b") > 1e-10, -F.col("a") / F.col("b")).otherwise(F.col("mean")).alias("theta"), (F.col("eps") * math.sqrt(days)).alias("sigma"), (math.log(2) / kappa * days).alias("half_life"))


def simulate(spark, s0: float, kappa: float, theta: float, sigma: float, months: int = 12, paths: int = 5000, steps: int = 21, seed: int = 42) -> DataFrame:
    """path, month, price: monthly mean prices of mean-reverting paths.

    Paths are dealt over tasks; each path has its own generator, so the result does
    not depend on how they are dealt.
    """
    dt = 1.0 / 252

    def run(batches):
        for batch in batches:
            out = []
            for path in batch["id"]:
                noise = np.random.default_rng([seed, int(path)]).normal(0, math.sqrt(dt), months * steps)
                p, values = s0, np.empty(months * steps)
                for t, e in enumerate(noise):
                    p = max(p + kappa * (theta - p) * dt + sigma * e, 0.01)
                    values[t] = p
                out.append(pd.DataFrame({"path": path, "month": np.arange(months), "price": values.reshape(months, steps).mean(1)}))
            yield pd.concat(out) if out else pd.DataFrame({"path": [], "month": [], "price": []})

    return spark.range(paths).mapInPandas(run, "path long, month int, price double")


def greedy_value(paths: DataFrame, asset: Asset, inventory: float, base: float, seasonal: tuple[float, ...] = (), rate: float = 0.05) -> DataFrame:
    """Discounted value of each path when every month takes its best immediate cash
    flow against the forward pass's inventory.

    This is the rule that a regression whose continuation is the same for every
    action reduces to.  The forward pass fills under 95 percent and empties over 105
    percent of the ``base`` price.  Paths are independent, so it distributes by path.
    """
    a = asset

    def rates(held: float) -> tuple[float, float]:
        fill = held / a.capacity
        up = (0.5 if fill > 0.9 else 0.8 if fill > 0.7 else 1.0) if a.ratchets else 1.0
        down = (0.5 if fill < 0.15 else 0.8 if fill < 0.30 else 1.0) if a.ratchets else 1.0
        return max(min(a.inject_day * 30 * up, a.capacity - held), 0.0), max(min(a.withdraw_day * 30 * down, held - a.floor), 0.0)

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        held, value = inventory, 0.0
        for t, x in enumerate(rows.sort_values("month")["price"]):
            x *= seasonal[t] if seasonal else 1.0
            room, stock = rates(held)
            value += max((x * (1 - a.fuel_loss) - a.withdraw_cost) * stock, 0.0) * math.exp(-rate * t / 12)
            if x < 0.95 * base:
                held += room
            elif x > 1.05 * base:
                held -= stock
        return pd.DataFrame({"path": [rows["path"].iloc[0]], "value": [value]})

    return paths.groupBy("path").applyInPandas(run, "path long, value double")


#: Bumps of the sensitivities: level and long-run level, and volatility.
BUMP, VOL_BUMP = 0.1, 0.05
CASES = {"base": {}, "up": {"s0": BUMP, "theta": BUMP}, "down": {"s0": -BUMP, "theta": -BUMP}, "vol": {"sigma": VOL_BUMP}, "time": {"months": -1}}


def _walk(noise: np.ndarray, s0: np.ndarray, kappa: np.ndarray, theta: np.ndarray, sigma: np.ndarray, steps: int) -> np.ndarray:
    """Monthly mean prices (paths x months) of mean-reverting paths, never under 0.01."""
    p, out = s0.astype(float), np.empty(noise.shape)
    for t in range(noise.shape[1]):
        p = np.maximum(p + kappa * (theta - p) / 252 + sigma * noise[:, t], 0.01)
        out[:, t] = p
    return out.reshape(len(out), -1, steps).mean(2)


def _greedy(prices: np.ndarray, asset: Asset, inventory: float, base: np.ndarray, months: np.ndarray, rate: float) -> np.ndarray:
    """``greedy_value`` of many paths at once; path i ends after months[i]."""
    a, held, value = asset, np.full(len(prices), float(inventory)), np.zeros(len(prices))
    for t in range(prices.shape[1]):
        x, live, fill = prices[:, t], t < months, held / a.capacity
        up = np.where(fill > 0.9, 0.5, np.where(fill > 0.7, 0.8, 1.0)) if a.ratchets else 1.0
        down = np.where(fill < 0.15, 0.5, np.where(fill < 0.30, 0.8, 1.0)) if a.ratchets else 1.0
        room = np.maximum(np.minimum(a.inject_day * 30 * up, a.capacity - held), 0.0)
        stock = np.maximum(np.minimum(a.withdraw_day * 30 * down, held - a.floor), 0.0)
        value += np.where(live, np.maximum((x * (1 - a.fuel_loss) - a.withdraw_cost) * stock, 0.0) * math.exp(-rate * t / 12), 0.0)
        held += np.where(live & (x < 0.95 * base), room, 0.0) - np.where(live & (x > 1.05 * base), stock, 0.0)
    return value


def simulated_values(params: DataFrame, asset: Asset, inventory: float, by: str = "symbol", months: int = 12, paths: int = 5000, steps: int = 21, seed: int = 42, rate: float = 0.05, cases: tuple[str, ...] = ("base",)) -> DataFrame:
    """by, case, path, value: ``greedy_value`` of ``simulate`` for each row of ``params``.

    ``params`` has ``by``, s0, kappa, theta and sigma, one row a market, as ``ou_calibrate`` of a
    price table gives them with its last price; rows with a null parameter are left out.
    Paths are dealt over tasks by market and path.  A path's noise depends on its number and
    the seed alone, so cases and markets share it and results do not depend on partitions.
    """
    fields = ("s0", "kappa", "theta", "sigma")
    known = params.dropna(subset=list(fields))
    case = F.explode(F.array(*[F.struct(F.lit(c).alias("case"), *[(F.col(f) + F.lit(float(CASES[c].get(f, 0.0)))).alias(f) for f in fields], F.lit(months + CASES[c].get("months", 0)).alias("months")) for c in cases])).alias("c")
    rows = known.select(by, *fields, F.explode(F.sequence(F.lit(0), F.lit(paths - 1))).alias("path")).repartition(by, "path").select(by, "path", case).select(by, "path", "c.*")

    def run(batches):
        for b in batches:
            if len(b):
                # Cases of a path draw the same noise.
                numbers, at = np.unique(b["path"].to_numpy(), return_inverse=True)
                noise = np.array([np.random.default_rng([seed, int(i)]).normal(0, math.sqrt(1 / 252), months * steps) for i in numbers])[at]
                prices = _walk(noise, *[b[f].to_numpy() for f in fields], steps)
                yield pd.DataFrame({by: b[by], "case": b["case"], "path": b["path"], "value": _greedy(prices, asset, inventory, b["s0"].to_numpy(), b["months"].to_numpy(), rate)})

    return rows.mapInPandas(run, f"{by} {params.schema[by].dataType.simpleString()}, case string, path int, value double")


def simulated_greeks(params: DataFrame, asset: Asset, inventory: float, by: str = "symbol", **options) -> DataFrame:
    """by, value, delta, gamma, vega, theta: ``greeks`` of each market, all cases in one pass."""
    each = simulated_values(params, asset, inventory, by, cases=tuple(CASES), **options)
    v = {c: F.avg(F.when(F.col("case") == c, F.col("value"))) for c in CASES}
    return each.groupBy(by).agg(
        v["base"].alias("value"), ((v["up"] - v["down"]) / (2 * BUMP)).alias("delta"), ((v["up"] - 2 * v["base"] + v["down"]) / BUMP**2).alias("gamma"),
        ((v["vol"] - v["base"]) / VOL_BUMP).alias("vega"), (v["time"] - v["base"]).alias("theta"),
    )


def longstaff_schwartz(prices: np.ndarray, asset: Asset, inventory: float, rate: float = 0.05, levels: int = 11) -> float:
    """Textbook least-squares value on an inventory grid (paths x months of prices)."""
    grid = np.linspace(asset.floor, asset.capacity, levels)
    n, months = prices.shape
    value = np.zeros((n, levels))
    for t in range(months - 1, -1, -1):
        x = prices[:, t]
        basis = np.column_stack([np.ones(n), x, x * x])
        keep = value * math.exp(-rate / 12)
        expected = basis @ np.linalg.lstsq(basis, keep, rcond=None)[0] if t < months - 1 else np.zeros_like(keep)
        new = np.full((n, levels), -np.inf)
        best = np.full((n, levels), -np.inf)
        for i, j in itertools.product(range(levels), range(levels)):
            flow = grid[j] - grid[i]
            if flow > asset.inject_day * 30 + 1e-9 or -flow > asset.withdraw_day * 30 + 1e-9:
                continue
            cash = -(x + asset.inject_cost) * flow if flow > 0 else (x * (1 - asset.fuel_loss) - asset.withdraw_cost) * -flow
            better = cash + expected[:, j] > best[:, i]
            best[better, i] = (cash + expected[:, j])[better]
            new[better, i] = (cash + keep[:, j])[better]
        value = new
    return float(np.mean([np.interp(inventory, grid, row) for row in value]))


def intrinsic(forward: list[float], asset: Asset, inventory: float, days: list[int] | None = None, rate: float = 0.0) -> tuple[float, list[float]]:
    """(value, net flow by month) of the best schedule against a known curve.

    The linear program has bounded monthly rates and inventory only, so its optimum
    is found by successive pairing: the value is concave piecewise linear in the
    inventory, and is carried back through the months as breakpoints.
    """
    days = days or [30] * len(forward)
    # V(x): maximum value from month t on with inventory x, concave on [floor, cap].
    points = [(asset.floor, 0.0), (asset.capacity, 0.0)]
    stages = []
    for t in range(len(forward) - 1, -1, -1):
        buy, sell = forward[t] + asset.inject_cost, forward[t] * (1 - asset.fuel_loss) - asset.withdraw_cost
        if rate:
            f = math.exp(-rate * t / 12)
            buy, sell = buy * f, sell * f
        up, down = asset.inject_day * days[t], asset.withdraw_day * days[t]
        stages.append((points, buy, sell, up, down))
        knots = sorted({min(max(k + d, asset.floor), asset.capacity) for k, _ in points for d in (0.0, -up, down)} | {asset.floor, asset.capacity})
        points = [(x, _best(x, points, buy, sell, up, down, asset)[0]) for x in knots]
    value = float(np.interp(inventory, *zip(*points, strict=True)))
    flows, held = [], inventory
    for nxt, buy, sell, up, down in reversed(stages):
        _, flow = _best(held, nxt, buy, sell, up, down, asset)
        flows.append(flow)
        held += flow
    return value, flows


def _best(x, nxt, buy, sell, up, down, asset):
    xs, vs = zip(*nxt, strict=True)
    low, high = max(asset.floor, x - down), min(asset.capacity, x + up)
    ends = {low, high, x, *(k for k in xs if low <= k <= high)}
    return max(((float(np.interp(y, xs, vs)) + ((x - y) * sell if y < x else (x - y) * buy), y - x) for y in ends), key=lambda p: (p[0], -abs(p[1])))


def intrinsic_by_date(curves: DataFrame, asset: Asset, inventory: float, by: str = "facility") -> DataFrame:
    """(by, step, forward) -> value, cycles and the schedule, one kernel a facility."""
    kind = curves.schema[by].dataType.simpleString()

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("step")
        value, flows = intrinsic(rows["forward"].tolist(), asset, inventory)
        put, taken = sum(max(f, 0) for f in flows), sum(max(-f, 0) for f in flows)
        return pd.DataFrame({by: [rows[by].iloc[0]], "value": [value], "cycles": [min(put, taken) / asset.capacity], "flows": [flows]})

    return curves.groupBy(by).applyInPandas(run, f"{by} {kind}, value double, cycles double, flows array<double>")


def rolling_intrinsic(prices: DataFrame, asset: Asset, inventory: float, by: str, every: int = 5, months: int = 12, price: str = "close") -> DataFrame:
    """Re-optimises every few rows; the tenor shrinks by a month each 21 rows.

    Inventory is carried from one decision to the next, so a facility is one kernel.
    """
    kind = prices.schema[by].dataType.simpleString()

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("date").reset_index(drop=True)
        month = pd.to_datetime(rows["date"]).dt.month
        factor = rows.groupby(month)[price].mean()
        factor = (factor / factor.mean()).reindex(range(1, 13), fill_value=1.0)
        held, cash, out = inventory, 0.0, []
        for i in range(0, len(rows), every):
            left = max(1, months - i // 21)
            x, m = float(rows[price][i]), int(month[i])
            curve = [x * factor[(m - 1 + k) % 12 + 1] / factor[m] for k in range(left)]
            value, flows = intrinsic(curve, asset, held)
            step = flows[0] * every / 21
            cash += -(x + asset.inject_cost) * step if step > 0 else (x * (1 - asset.fuel_loss) - asset.withdraw_cost) * -step
            held = min(max(held + step, asset.floor), asset.capacity)
            out.append((rows[by][0], rows["date"][i], value, held, cash))
        return pd.DataFrame(out, columns=[by, "date", "value", "inventory", "cash"])

    return prices.select(by, "date", price).groupBy(by).applyInPandas(run, f"{by} {kind}, date date, value double, inventory double, cash double")


def greeks(spark, asset: Asset, inventory: float, s0: float, kappa: float, theta: float, sigma: float, months: int = 12, paths: int = 1000, seed: int = 42) -> DataFrame:
    """Bumped values with common random numbers: delta, gamma, vega, theta."""
    cases = {"base": {}, "up": {"s0": s0 + 0.1, "theta": theta + 0.1}, "down": {"s0": s0 - 0.1, "theta": theta - 0.1}, "vol": {"sigma": sigma + 0.05}, "time": {"months": months - 1}}
    rows = None
    for name, bump in cases.items():
        args = {"s0": s0, "kappa": kappa, "theta": theta, "sigma": sigma, "months": months, "paths": paths, "seed": seed} | bump
        one = greedy_value(simulate(spark, **args), asset, inventory, args["s0"]).agg(F.avg("value").alias("v")).select(F.lit(name).alias("case"), "v")
        rows = one if rows is None else rows.union(one)
    v = {k: F.max(F.when(F.col("case") == k, F.col("v"))) for k in cases}
    return rows.agg(v["base"].alias("value"), ((v["up"] - v["down"]) / 0.2).alias("delta"), ((v["up"] - 2 * v["base"] + v["down"]) / 0.01).alias("gamma"), ((v["vol"] - v["base"]) / 0.05).alias("vega"), (v["time"] - v["base"]).alias("theta"))


def with_rates(asset: Asset, **changes) -> Asset:
    return replace(asset, **changes)
