"""Demand and generation panels, heat rates, spark spreads, merit order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wattline.functions.tables import settle
from wattline.functions.ts import Series, clip, flag
from wattline.operators.align import daily_ramp, outliers_removed

#: MMBtu per MWh, $ per MWh and tons of CO2 per MWh by plant type.
HEAT_RATES = {"combined_cycle": 6.6, "combustion_turbine": 10.0, "steam_turbine": 9.5, "average_gas": 7.5}
VOM_COSTS = {"combined_cycle": 2.50, "combustion_turbine": 5.00, "steam_turbine": 4.00, "nuclear": 2.50, "coal": 3.50, "wind": 0.00, "solar": 0.00}
EMISSION_RATES = {"combined_cycle": 0.40, "combustion_turbine": 0.60, "coal": 0.95}
#: Seasonal premium in $ per MWh by month, January first.
SEASONAL_PREMIUM = (1.8, 1.5, 0.6, 0.3, 0.5, 1.2, 2.0, 1.8, 0.8, 0.4, 0.7, 1.4)


def demand_panel(hourly: DataFrame, value: str = "mw", min_hours: int = 20, by: tuple[str, ...] = ("region",)) -> DataFrame:
    """Daily totals of days with enough hours, and the load factor."""
    v = F.col(value)
    daily = hourly.groupBy(*by, F.to_date("ts").alias("date")).agg(F.sum(v).alias("total_mwh"), F.max(v).alias("peak_mw"), F.min(v).alias("min_mw"), F.avg(v).alias("avg_mw"), F.count(v).alias("hours"))
    return daily.where(F.col("hours") >= min_hours).withColumn("load_factor", F.try_divide(F.col("avg_mw"), F.col("peak_mw")))


def generation_panel(hourly: DataFrame, value: str = "mw", min_hours: int = 20, by: tuple[str, ...] = ("region",)) -> DataFrame:
    """Adds capacity factor, variability and the day's largest hourly ramp."""
    v = F.col(value)
    spread = hourly.groupBy(*by, F.to_date("ts").alias("date")).agg(F.stddev_samp(v).alias("_sd"))
    daily = demand_panel(hourly, value, min_hours, by).join(spread, [*by, "date"]).join(daily_ramp(hourly, value, by=by), [*by, "date"])
    return daily.withColumns({"cf": clip(F.try_divide(F.col("avg_mw"), F.col("peak_mw")), 0.0, 1.0), "variability": clip(F.try_divide(F.col("_sd"), F.col("avg_mw")), 0.0, 10.0)}).drop("_sd", "load_factor")


def weather_panel(cities: DataFrame, weights: DataFrame, values: tuple[str, ...]) -> DataFrame:
    """Population-weighted means by date, weights renormalised over what is there."""
    j = cities.join(F.broadcast(weights), "city")
    return j.groupBy("date").agg(*[F.try_divide(F.sum(F.col(v) * F.col("weight")), F.sum(F.when(F.col(v).isNotNull(), F.col("weight")))).alias(v) for v in values])


def east_demand(daily: DataFrame, regions: tuple[str, ...], reach: float = 2.0) -> DataFrame:
    """One row a day that every region has: each region's columns, the total of all and the
    sum of their peaks, without days whose total lies far out (``outliers_removed``).

    ``daily`` has the columns of ``demand_panel``; of repeated rows of a region and day
    the larger values are shown and all count in the totals.
    """
    columns = ("total_mwh", "peak_mw", "min_mw", "avg_mw", "load_factor")
    own = [F.max(F.when(F.col("region") == r, F.col(c))).alias(f"{r.lower()}_{c}") for r in regions for c in columns]
    every = daily.where(F.col("region").isin(*regions)).groupBy("date").agg(
        *own, F.sum("total_mwh").alias("east_total_mwh"), F.sum("peak_mw").alias("east_peak_mw"), F.count_distinct("region").alias("_n")
    )
    return outliers_removed(settle(every.where(F.col("_n") == len(regions)).drop("_n")), "east_total_mwh", reach=reach)


def east_generation(daily: DataFrame, series: tuple[tuple[str, str], ...], totals: dict[str, str], limit: int = 2) -> DataFrame:
    """One row a day that any (region, fuel) of ``series`` has: the columns of each, and
    for each fuel of ``totals`` the sum over regions under the name given, 0 without a
    value.  Gaps of up to ``limit`` rows are then carried forward.

    ``daily`` has region, fuel and the columns of ``generation_panel``.
    """
    columns = ("total_mwh", "peak_mw", "min_mw", "avg_mw", "cf", "variability", "ramp")
    own = {f"{r.lower()}_{f.lower()}_{c}": F.max(F.when((F.col("region") == r) & (F.col("fuel") == f), F.col(c))) for r, f in series for c in columns}
    sums = {name: F.coalesce(F.sum(F.when(F.col("fuel") == f, F.col("total_mwh"))), F.lit(0.0)) for f, name in totals.items()}
    wanted = F.struct("region", "fuel").isin(*[F.struct(F.lit(r).alias("region"), F.lit(f).alias("fuel")) for r, f in series])
    out = daily.where(wanted).groupBy("date").agg(*[c.alias(n) for n, c in (own | sums).items()])
    s = Series()
    return out.select("date", *[s.ffill(c, limit).alias(c) for c in (*own, *sums)])


#: Values of a city's day that are weighted by population.
WEATHER = ("tavg", "tmax", "tmin", "wind_speed_max", "wind_gusts_max", "shortwave_rad", "cloud_cover", "precipitation", "sunshine_hours")


def weather_days(cities: DataFrame, weights: DataFrame, base: float = 65.0, by_city: tuple[str, ...] = ()) -> DataFrame:
    """The wind and solar weather panel: weighted values by date and what is made of them.

    Weights are renormalised over the cities that have any day.  On a day a city without
    a value adds nothing, so that the day's weights sum to less than 1; a value that no city
    has is null, and days without any value go.  The wind's direction is that of the city
    of the largest weight (the first by name of equals), as directions have no mean.
    ``by_city`` names cities whose wind speed is kept as ``wind_<city>``.
    Columns of ``WEATHER`` that ``cities`` lacks are left out with all that needs them.
    """
    have = [c for c in WEATHER if c in cities.columns]
    there = weights.join(cities.select("city").distinct(), "city", "left_semi")
    whole = there.agg(F.sum("weight").alias("_all"), F.min_by("city", F.struct(-F.col("weight"), "city")).alias("_top"))
    rows = cities.join(there.select("city", "weight"), "city").join(F.broadcast(whole)).withColumn("_w", F.col("weight") / F.col("_all"))
    aggs = [F.sum(F.col(c) * F.col("_w")).alias(c) for c in have]
    if "wind_dir_dominant" in cities.columns:
        aggs.append(F.max(F.when(F.col("city") == F.col("_top"), F.col("wind_dir_dominant"))).alias("wind_dir_dominant"))
    if "wind_speed_max" in have:
        aggs += [F.max(F.when(F.col("city") == c, F.col("wind_speed_max"))).alias(f"wind_{c}") for c in by_city]
    days = rows.groupBy("date").agg(*aggs).where(F.coalesce(*have).isNotNull())
    s, made = Series(), {}
    if "tavg" in have:
        days = days.withColumns({"hdd": clip(base - F.col("tavg"), 0.0), "cdd": clip(F.col("tavg") - base, 0.0)})
        made |= {"hdd_7d": s.mean("hdd", 7), "cdd_7d": s.mean("cdd", 7), "temp_change_1d": s.diff("tavg")}
    if {"tmax", "tmin"} <= set(have):
        made["temp_range"] = F.col("tmax") - F.col("tmin")
    if "wind_speed_max" in have:
        v = "wind_speed_max"
        made |= {"wind_speed_7d": s.mean(v, 7), "wind_speed_14d": s.mean(v, 14), "wind_speed_change_1d": s.diff(v), "wind_speed_change_7d": s.diff(v, 7), "wind_volatility_7d": s.std(v, 7)}
        if "wind_gusts_max" in have:
            made["gust_ratio"] = F.col("wind_gusts_max") / clip(v, 0.1)
    if "shortwave_rad" in have:
        v = "shortwave_rad"
        made |= {"solar_rad_7d": s.mean(v, 7), "solar_rad_14d": s.mean(v, 14), "solar_change_1d": s.diff(v)}
        if "cloud_cover" in have:
            made["clear_sky_index"] = clip(1 - F.col("cloud_cover") / 100, 0.0, 1.0)
        if "precipitation" in have:
            made["rain_flag"] = flag(F.col("precipitation") > 1.0)
    return days.withColumns(made)


def implied_heat_rate(df: DataFrame, by: tuple[str, ...] = ("region",), gas: str = "gas_mwh", total: str = "total_mwh", price: str = "ng_price") -> DataFrame:
    """Heat rate of the marginal plant from the gas share and its price response."""
    share = F.try_divide(F.col(gas), F.when(F.col(total) != 0, F.col(total)))
    fit = df.withColumn("_s", share).where(f"_s is not null and {price} is not null").groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.avg("_s").alias("share"), F.regr_slope("_s", price).alias("slope"))
    base = 6.6 + clip((F.col("share") - 0.15) / 0.5, 0.0, 1.0) * 3.4 * 0.5
    steep = base + F.when(F.col("slope") < -0.005, F.least(F.abs(F.col("slope")) * 10, F.lit(1.0))).otherwise(0.0)
    return fit.select(*by, "n", "share", "slope", F.when(F.col("n") < 30, 7.5).otherwise(clip(steep, 6.4, 10.5)).alias("heat_rate"))


def spark_spreads(df: DataFrame, heat_rate: float | str = 7.5, by: tuple[str, ...] = ("region",), carbon: float = 0.0, premium: float = 5.0, gas: str = "gas_mwh", total: str = "total_mwh", price: str = "ng_price", demand: str | None = None) -> DataFrame:
    """Daily estimated power price and spreads by plant type, all regions at once.

    The clean spread takes off variable cost and carbon a second time, as the
    figures it is compared with do.
    """
    s, w = Series(by), Window.partitionBy(*by)
    hr: Column = F.lit(heat_rate) if isinstance(heat_rate, float) else F.col(heat_rate)
    rows = df.where(F.col(price).isNotNull())
    rows = rows.withColumns({"gas_share": F.try_divide(F.col(gas), F.when(F.col(total) != 0, F.col(total))), "_ret": s.pct(price)})
    rows = rows.withColumn("_vol", s.std("_ret", 20, 5) * F.sqrt(F.lit(252.0)))
    z = (F.col("gas_share") - F.avg("gas_share").over(w)) / F.greatest(F.stddev_samp("gas_share").over(w), F.lit(0.01))
    seasonal = F.element_at(F.array(*[F.lit(x) for x in SEASONAL_PREMIUM]), F.month("date"))
    vol = clip(F.col("_vol") / F.greatest(F.percentile("_vol", 0.5).over(w), F.lit(0.01)) - 1, -1.0, 3.0) * 2
    pull = F.lit(0.0)
    if demand is not None:
        pull = clip((F.col(demand) - F.percentile(demand, 0.5).over(w)) / F.greatest(F.stddev_samp(demand).over(w), F.lit(1.0)), -2.0, 3.0) * 2.0
    ng = F.col(price)
    floor = ng * HEAT_RATES["combined_cycle"] + VOM_COSTS["combined_cycle"]
    power = ng * hr + premium + z * 3.0 + seasonal + vol + pull
    rows = rows.withColumn("power_price", F.when(power.isNotNull(), F.greatest(power, floor))).drop("_ret", "_vol")
    out = {f"spark_{p}": F.col("power_price") - h * ng - VOM_COSTS.get(p, 3.0) - EMISSION_RATES.get(p, 0.5) * carbon for p, h in HEAT_RATES.items()}
    cc = "combined_cycle"
    out |= {"gas_cost_mwh": ng * HEAT_RATES[cc], "spark_spread": out[f"spark_{cc}"], "clean_spark_spread": out[f"spark_{cc}"] - VOM_COSTS[cc] - EMISSION_RATES[cc] * carbon}
    return rows.withColumns(out | {"spark_ratio": F.try_divide(F.col("power_price"), F.when(ng * hr != 0, ng * hr))})


def merit_order(panel: DataFrame, fuels: tuple[str, ...], total: str = "total_mwh", by: tuple[str, ...] = ("region",), quantile: float = 0.9) -> DataFrame:
    """Share of each fuel at all loads and in the hours or days of highest load."""
    top = panel.groupBy(*by).agg(F.percentile(total, quantile).alias("_q"))
    j = panel.join(top, list(by))
    high = F.col(total) > F.col("_q")
    aggs = []
    for f in fuels:
        aggs += [F.try_divide(F.avg(f), F.avg(total)).alias(f"{f}_share"), F.try_divide(F.avg(F.when(high, F.col(f))), F.avg(F.when(high, F.col(total)))).alias(f"{f}_peak_share")]
    return j.groupBy(*by).agg(*aggs)


#: Load quantiles of the supply stack, days above one that it needs,
#: marginal cost of coal.
STACK_QUANTILES, STACK_DAYS, COAL_COST = (0.1, 0.25, 0.5, 0.75, 0.9, 0.95), 5, 25.0


def supply_stack(panel: DataFrame, fuels: tuple[str, ...], by: tuple[str, ...] = ("region",)) -> DataFrame:
    """Rows (region, load_quantile, fuel): share of the fuel and its mean output on the days
    whose total is above the quantile.  Days with a missing value are left out."""
    days = panel.dropna(subset=list(fuels)).withColumn("_total", sum((F.col(f) for f in fuels), F.lit(0.0)))
    edges = days.groupBy(*by).agg(F.percentile("_total", list(STACK_QUANTILES)).alias("_q"))
    level = F.posexplode(F.array(*[F.lit(q) for q in STACK_QUANTILES])).alias("_i", "load_quantile")
    edges = edges.select(*by, "_q", level).select(*by, "load_quantile", F.element_at("_q", F.col("_i") + 1).alias("_edge"))
    high = days.join(F.broadcast(edges), list(by)).where(F.col("_total") > F.col("_edge"))
    each = F.explode(F.array(*[F.struct(F.lit(f).alias("fuel"), F.col(f).alias("x")) for f in fuels])).alias("f")
    long = high.select(*by, "load_quantile", "_total", each)
    out = long.groupBy(*by, "load_quantile", F.col("f.fuel").alias("fuel")).agg(F.avg("f.x").alias("avg_gen_mwh"), F.avg("_total").alias("_mean"), F.count(F.lit(1)).alias("_n"))
    return out.where(F.col("_n") > STACK_DAYS).withColumn("share_pct", F.try_divide(F.col("avg_gen_mwh"), F.col("_mean")) * 100).drop("_mean", "_n")


def marginal_supply(panel: DataFrame, fuels: tuple[str, ...], price: str = "ng_price", by: tuple[str, ...] = ("region",)) -> DataFrame:
    """One row a region: baseload (median nuclear and hydro), marginal fuel (gas, unless
    coal has the larger output at high load), its cost, and gas's share of all output."""
    days = panel.dropna(subset=[*fuels, price]).withColumn("_total", sum((F.col(f) for f in fuels), F.lit(0.0)))
    base = sum((F.percentile(f, 0.5) for f in fuels if f in ("nuclear", "hydro")), F.lit(0.0))
    coal = F.percentile("coal", 0.9) >= F.percentile("gas", 0.9) if {"gas", "coal"} <= set(fuels) else F.lit(False)
    cost = F.when(coal, F.lit(COAL_COST)).otherwise(F.avg(price) * HEAT_RATES["combined_cycle"] + VOM_COSTS["combined_cycle"])
    share = F.try_divide(F.sum("gas"), F.sum("_total")) if "gas" in fuels else F.lit(0.0)
    return days.groupBy(*by).agg(base.alias("base_load_mwh"), F.when(coal, "coal").otherwise("gas").alias("marginal_fuel"), cost.alias("marginal_cost"), share.alias("gas_share"))


def region_report(spreads: DataFrame, by: tuple[str, ...] = ("region",)) -> DataFrame:
    """Mean and spread of the margin, share of profitable days, best month."""
    month = spreads.groupBy(*by, F.month("date").alias("month")).agg(F.avg("spark_spread").alias("m"))
    best = month.groupBy(*by).agg(F.max_by("month", F.struct("m", "month")).alias("best_month"))
    base = spreads.groupBy(*by).agg(F.avg("spark_spread").alias("mean_spread"), F.stddev_samp("spark_spread").alias("std_spread"), F.avg((F.col("spark_spread") > 0).cast("double")).alias("profitable"), F.avg("clean_spark_spread").alias("mean_clean"))
    return base.join(best, list(by))


def spread_heatmap(spreads: DataFrame, by: tuple[str, ...] = ("region",)) -> DataFrame:
    """Regions by months "1" to "12": mean margin of the month, 0 where there is none."""
    months = spreads.select(*by, F.month("date").alias("month"), "spark_spread").groupBy(*by).pivot("month", list(range(1, 13)))
    return months.agg(F.avg("spark_spread")).fillna(0.0, [str(m) for m in range(1, 13)])


def rolling_spread(spreads: DataFrame, by: tuple[str, ...] = ("region",), n: int = 21, least: int = 5) -> DataFrame:
    """Mean margin of the last ``n`` days, from ``least`` days on."""
    return spreads.select(*by, "date", Series(by).mean("spark_spread", n, least).alias("spark_spread"))


def plant_profitability(spreads: DataFrame, by: tuple[str, ...] = ("region",)) -> DataFrame:
    """Region and plant type: mean margin, percent of all days with a margin over 0, and the
    plant's heat rate and variable cost (0 where none is known)."""
    kinds = [k for k in HEAT_RATES if f"spark_{k}" in spreads.columns]
    each = F.explode(F.array(*[F.struct(F.lit(k).alias("plant_type"), F.col(f"spark_{k}").alias("x"), F.lit(HEAT_RATES[k]).alias("heat_rate"), F.lit(VOM_COSTS.get(k, 0.0)).alias("vom")) for k in kinds])).alias("p")
    over = F.coalesce((F.col("p.x") > 0).cast("double"), F.lit(0.0))
    return spreads.select(*by, each).groupBy(*by, F.col("p.plant_type").alias("plant_type"), F.col("p.heat_rate").alias("heat_rate"), F.col("p.vom").alias("vom")).agg(
        F.avg("p.x").alias("avg_spark"), (F.avg(over) * 100).alias("profitable_pct")
    )


def spread_correlation(spreads: DataFrame, regions: tuple[str, ...], least: int = 30) -> DataFrame:
    """a, b, corr of the margins of two regions over the days that all regions have; no rows
    for ``least`` days or fewer.  One row a day moves: regions are columns."""
    wide = spreads.where(F.col("region").isin(*regions)).groupBy("date").agg(*[F.max(F.when(F.col("region") == r, F.col("spark_spread"))).alias(f"_{i}") for i, r in enumerate(regions)])
    full = wide.dropna(subset=[f"_{i}" for i in range(len(regions))])
    pairs = [(i, j) for i in range(len(regions)) for j in range(len(regions))]
    one = full.agg(F.count(F.lit(1)).alias("n"), *[F.corr(f"_{i}", f"_{j}").alias(f"c_{i}_{j}") for i, j in pairs]).where(F.col("n") > least)
    cells = F.explode(F.array(*[F.struct(F.lit(regions[i]).alias("a"), F.lit(regions[j]).alias("b"), F.col(f"c_{i}_{j}").alias("corr")) for i, j in pairs])).alias("c")
    return one.select(cells).select("c.a", "c.b", "c.corr")
