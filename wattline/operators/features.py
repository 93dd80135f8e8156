"""Feature builders: storage, curve, rigs, macro, seasonal, load, wind, solar,
production, price, sentiment.  Each returns a dict of columns or a frame; blocks
whose inputs a table lacks are left out when the plan is made.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wattline.functions.ts import Series, clip, col, cyclical, ewm, flag, is_holiday, span
from wattline.operators.align import asof_join, reindex_ffill, upsample_ffill


def _divide(a, b) -> Column:
    return F.try_divide(col(a), col(b))


# --- fundamentals ---------------------------------------------------------------


def storage(weekly: DataFrame, level: str = "level", window: int = 4) -> DataFrame:
    """change, expected, surprise, surprise_norm, yoy of a weekly level."""
    s = Series()
    w = weekly.withColumn("storage_change", s.diff(level))
    w = w.withColumn("storage_expected", s.mean("storage_change", window))
    size = s.mean(F.abs(F.col("storage_change")), 260)
    surprise = F.col("storage_change") - F.col("storage_expected")
    return w.withColumns({"storage_surprise": surprise, "storage_surprise_norm": _divide(surprise, F.when(size != 0, size)), "storage_yoy": s.diff(level, 52)})


def with_storage(prices: DataFrame, weekly: DataFrame, level: str = "level") -> DataFrame:
    """Storage features carried to every price date."""
    names = ("storage_change", "storage_surprise", "storage_surprise_norm", "storage_yoy")
    daily = upsample_ffill(storage(weekly, level).select("date", *names))
    return reindex_ffill(prices, daily, values=names)


def futures_curve(spot, first, second) -> dict[str, Column]:
    m1, m2 = col(first) - col(spot), col(second) - col(spot)
    return {"spread_m1": m1, "spread_m2": m2, "backwardation": flag(m1 < 0), "contango": flag(m1 > 0)}


def rig_count(weekly: DataFrame, rigs: str = "rigs", lag: int = 1) -> DataFrame:
    s = Series()
    out = weekly.select("date", col(rigs).alias("rig_count"), *[s.diff(rigs, k).alias(f"rig_change_{k}w") for k in (1, 4, 52)], s.lag(rigs, lag).alias(f"rig_count_lag_{lag}w"))
    return upsample_ffill(out)


def supply_balance(production, imports, exports) -> Column:
    return F.coalesce(col(production), F.lit(0.0)) + F.coalesce(col(imports), F.lit(0.0)) - F.coalesce(col(exports), F.lit(0.0))


# --- macro ----------------------------------------------------------------------

YIELD_SPREAD = "yield_spread_10y2y"


def with_macro(df: DataFrame, target: str, dollar: str | None = None, equity: str | None = None, vix: str | None = None, rates: tuple[str, ...] = (), keys: tuple[str, ...] = (), window: int = 60) -> DataFrame:
    """Adds moves of the dollar and of equities and their correlation with the target, by
    log returns; volatility flags; 20-day moves of rates, and the inverted curve."""
    s = Series(keys)
    sides = {name: x for name, x in (("usd", dollar), ("equity", equity)) if x is not None}
    df = df.withColumns({"_target": s.log_return(target), **{f"_{name}": s.log_return(x) for name, x in sides.items()}})
    out: dict[str, Column] = {}
    for name, x in sides.items():
        out |= {f"{name}_ret_5d": s.pct(x, 5), f"{name}_ret_20d": s.pct(x, 20), f"{name}_corr_60d": s.corr(f"_{name}", "_target", window)}
    if dollar is not None:
        out["usd_z60"] = s.zscore(dollar, 60)
    if vix is not None:
        out |= {"vix_change_5d": s.diff(vix, 5), "vix_high": flag(col(vix) > 25), "vix_extreme": flag(col(vix) > 35), "regime": macro_regime(vix)}
    for rate in rates:
        out[f"{rate}_change_20d"] = s.diff(rate, 20)
    if YIELD_SPREAD in rates:
        out["yield_curve_inverted"] = flag(col(YIELD_SPREAD) < 0)
    return df.withColumns(out).drop("_target", *[f"_{name}" for name in sides])


def macro_regime(vix) -> Column:
    v = col(vix)
    return F.when(v <= 20, 0).when(v <= 30, 1).when(v <= 40, 2).otherwise(3)


# --- calendar -------------------------------------------------------------------


def calendar(d: str | Column = "date", harmonics: int = 3) -> dict[str, Column]:
    d = col(d)
    month = F.month(d)
    out = {
        "day_of_week": F.weekday(d), "day_of_year": F.dayofyear(d), "month": month, "week_of_year": F.weekofyear(d), "quarter": F.quarter(d),
        "is_weekend": flag(F.weekday(d) >= 5), "is_monday": flag(F.weekday(d) == 0), "is_friday": flag(F.weekday(d) == 4), "is_holiday": is_holiday(d),
        "season_winter": flag(month.isin(12, 1, 2)), "season_spring": flag(month.isin(3, 4, 5)), "season_summer": flag(month.isin(6, 7, 8)), "season_fall": flag(month.isin(9, 10, 11)),
    }
    for k in range(1, harmonics + 1):
        out[f"doy_sin_{k}"], out[f"doy_cos_{k}"] = cyclical(F.dayofyear(d), 365.25, k)
    out["dow_sin"], out["dow_cos"] = cyclical(F.weekday(d), 7)
    return out


#: Months of the energy seasons.
SEASONS = {
    "heating_season": (10, 11, 12, 1, 2, 3),
    "cooling_season": (6, 7, 8, 9),
    "driving_season": (5, 6, 7, 8, 9),
    "hurricane_season": (6, 7, 8, 9, 10, 11),
    "refinery_maintenance": (3, 4, 9, 10),
}
#: Fixed value: the weekly storage report comes on Thursdays (Monday is 0).
REPORT_DAY = 3


def seasonal(d: str | Column = "date") -> dict[str, Column]:
    """Calendar position, cycles of 12 months, 7 days, 365 days and 52 weeks, seasons."""
    d = col(d)
    month, dow, doy, week = F.month(d), F.weekday(d), F.dayofyear(d), F.weekofyear(d)
    ends = d == F.last_day(d)
    out = {
        "month": month, "day_of_week": dow, "day_of_year": doy, "quarter": F.quarter(d), "year": F.year(d), "week_of_year": week,
        "is_month_end": flag(ends), "is_quarter_end": flag(ends & (month % 3 == 0)), "eia_report_day": flag(dow == REPORT_DAY),
    }
    for name, x, period in (("month", month, 12), ("dow", dow, 7), ("doy", doy, 365), ("woy", week, 52)):
        out[f"{name}_sin"], out[f"{name}_cos"] = cyclical(x, period)
    return out | {name: flag(month.isin(*months)) for name, months in SEASONS.items()}


# --- load, wind and solar -------------------------------------------------------


#: Days back and window lengths of load and generation.
LAGS, WINDOWS = (1, 2, 3, 7, 14, 28), (3, 7, 14, 30)


def lags(s: Series, x: str, name: str, points=LAGS, windows=WINDOWS) -> dict[str, Column]:
    out = {f"{name}_lag_{k}d": s.lag(x, k) for k in points}
    for n in windows:
        out |= {f"{name}_roll_{n}d": s.mean(x, n), f"{name}_roll_{n}d_std": s.std(x, n)}
    return out | {f"{name}_pct_change_{k}d": s.pct(x, k) for k in (1, 7)} | {f"{name}_same_dow_{k}w": s.lag(x, 7 * k) for k in (1, 2)}


def weather(s: Series, columns: list[str]) -> dict[str, Column]:
    if "tavg" not in columns:
        return {}
    t = F.col("tavg")
    out = {
        "tavg_sq": t * t, "tavg_cube": t * t * t, "extreme_cold": flag(t < 20), "extreme_heat": flag(t > 90), "moderate_temp": flag((t >= 55) & (t <= 75)),
        "temp_volatility_7d": s.std("tavg", 7), "temp_volatility_14d": s.std("tavg", 14), "temp_wow_change": s.diff("tavg", 7),
    }
    for x in ("hdd", "cdd"):
        if x in columns:
            out[f"{x}_sq"] = F.col(x) * F.col(x)
    for k in (1, 2, 3):
        out |= {f"{x}_lag_{k}d": s.lag(x, k) for x in ("tavg", "hdd", "cdd") if x in columns}
    return out


def load(demand: DataFrame, weather_table: DataFrame, target: str = "total_mwh", peak: str = "peak_mw") -> DataFrame:
    """Day-ahead load features with tomorrow's load as ``target``; lags of the daily peak
    if the table has it."""
    if target not in demand.columns:
        raise ValueError(f"target column {target!r} is not among {demand.columns}")
    s = Series()
    df = demand.join(weather_table, "date")
    peaks = {f"peak_lag_{k}d": s.lag(peak, k) for k in (1, 7)} if peak in df.columns else {}
    df = df.withColumns({**calendar(), **weather(s, df.columns), **lags(s, target, "load"), **peaks})
    if "hdd" in df.columns:
        week, jul_aug = 1 - F.col("is_weekend"), flag(F.col("month").isin(7, 8))
        extra = {f"{x}_x_weekday": F.col(x) * week for x in ("hdd", "cdd")} | {f"{x}_x_weekend": F.col(x) * F.col("is_weekend") for x in ("hdd", "cdd")}
        extra |= {"hdd_x_winter": F.col("hdd") * F.col("season_winter"), "cdd_x_summer": F.col("cdd") * F.col("season_summer"), "temp_x_jul_aug": F.col("tavg") * jul_aug}
        extra |= {"temp_x_jan_feb": F.col("tavg") * flag(F.col("month").isin(1, 2)), "hdd_x_holiday": F.col("hdd") * F.col("is_holiday"), "cdd_x_holiday": F.col("cdd") * F.col("is_holiday")}
        df = df.withColumns(extra)
    return df.withColumn("target", s.lag(target, -1)).where("target is not null")


#: Turbine power curve, km/h: cut-in, rated and cut-out speed.
CUT_IN, RATED, CUT_OUT = 11, 43, 90
#: Longest day in hours, freezing point in F, mm of a rainy day.
LONGEST_DAY, FREEZING, RAINY = 14.0, 32, 1.0


def wind(s: Series, columns: list[str], speed: str = "wind_speed_max") -> dict[str, Column]:
    """Power-curve regimes, gusts, direction and lags of the wind."""
    v = F.col(speed)
    productive = flag((v >= CUT_IN) & (v < CUT_OUT))
    out = {
        "wind_speed_sq": v * v, "wind_speed_cube": v * v * v, "wind_speed_log": F.log1p(v), "wind_below_cutin": flag(v < CUT_IN), "wind_rated": flag((v >= RATED) & (v < CUT_OUT)),
        "wind_above_cutout": flag(v >= CUT_OUT), "wind_productive": productive, "wind_effective": clip(v, float(CUT_IN), float(CUT_OUT)), "power_signal": v * v * v * productive,
        "wind_change_1d": s.diff(speed), "wind_change_3d": s.diff(speed, 3),
    }
    if "wind_gusts_max" in columns:
        gap = F.col("wind_gusts_max") - v
        out |= {"gust_speed": F.col("wind_gusts_max"), "gust_diff": gap, "turbulence_proxy": clip(gap / F.greatest(v, F.lit(1.0)), 0.0, 5.0)}
    if "wind_dir_dominant" in columns:
        a = F.radians("wind_dir_dominant")
        out |= {"wind_dir_sin": F.sin(a), "wind_dir_cos": F.cos(a), "wind_u": v * F.sin(a), "wind_v": v * F.cos(a)}
    return out | {f"wind_lag_{k}d": s.lag(speed, k) for k in (1, 2, 3, 7)}


def wind_crosses(columns: list[str], speed: str = "wind_speed_max") -> dict[str, Column]:
    """Wind by season, temperature and frost."""
    v, month = F.col(speed), F.month("date")
    parts = {"winter": (12, 1, 2), "spring": (3, 4, 5), "summer": (6, 7, 8), "fall": (9, 10, 11)}
    out = {f"wind_x_{name}": v * flag(month.isin(*months)) for name, months in parts.items()}
    if "tavg" in columns:
        out |= {"wind_x_temp": v * F.col("tavg"), "wind_x_cold": v * flag(F.col("tavg") < FREEZING)}
    return out


def generation_lags(s: Series, x: str, prefix: str, points=LAGS, windows=WINDOWS) -> dict[str, Column]:
    """Past generation: lags, rolling mean and deviation, changes over a day and a week."""
    out = {f"{prefix}_lag_{k}d": s.lag(x, k) for k in points}
    for n in windows:
        out |= {f"{prefix}_roll_{n}d": s.mean(x, n), f"{prefix}_roll_{n}d_std": s.std(x, n)}
    return out | {f"{prefix}_pct_{k}d": s.pct(x, k) for k in (1, 7)}


def wind_generation(daily: DataFrame, target: str, keys: tuple[str, ...] = ()) -> DataFrame:
    """All features of daily wind generation, with tomorrow's as ``target``.

    ``daily`` has the generation, the weather and, if known, capacity factors (columns
    that end in ``_cf`` and hold ``wnd``).
    """
    s, have = Series(keys), daily.columns
    blocks = calendar() | wind(s, have) | wind_crosses(have) | generation_lags(s, target, "gen")
    blocks |= {f"gen_same_dow_{k}w": s.lag(target, 7 * k) for k in (1, 2)}
    for c in (c for c in have if c.endswith("_cf") and "wnd" in c):
        blocks |= {f"cf_lag_{k}d_{c}": s.lag(c, k) for k in (1, 7)}
    if "shortwave_rad" in have:
        blocks |= solar(s, have)
    return daily.withColumns(blocks | {"target": s.lag(target, -1)}).where("target is not null")


def solar(s: Series, columns: list[str], radiation: str = "shortwave_rad") -> dict[str, Column]:
    """Radiation beside the wind: square, anomalies, share of the longest day."""
    x = F.col(radiation)
    out = {"solar_rad_sq": x * x, "solar_rad_anomaly_7d": x - s.mean(radiation, 7), "solar_rad_anomaly_30d": x - s.mean(radiation, 30)}
    if "sunshine_hours" in columns:
        out["sunshine_frac"] = clip(F.col("sunshine_hours") / LONGEST_DAY, 0.0, 1.0)
    return out


def solar_power(s: Series, columns: list[str], radiation: str = "shortwave_rad") -> dict[str, Column]:
    """Radiation for solar plants: clear sky (given, or from cloud cover), rain, sunshine."""
    x = F.col(radiation)
    out = {"solar_rad_sq": x * x, "solar_rad_log": F.log1p(x), "solar_anomaly_7d": x - s.mean(radiation, 7), "solar_anomaly_30d": x - s.mean(radiation, 30)}
    if "clear_sky_index" in columns:
        out["clear_sky"] = F.col("clear_sky_index")
    elif "cloud_cover" in columns:
        out["clear_sky"] = clip(1 - F.col("cloud_cover") / 100, 0.0, 1.0)
    if "precipitation" in columns:
        out["rain_flag"] = flag(F.col("precipitation") > RAINY)
    if "sunshine_hours" in columns:
        out["sunshine_norm"] = clip("sunshine_hours", 0.0) / LONGEST_DAY
    return out | {f"solar_rad_lag_{k}d": s.lag(radiation, k) for k in (1, 2, 3, 7)}


def solar_generation(daily: DataFrame, target: str, keys: tuple[str, ...] = ()) -> DataFrame:
    """All features of daily solar generation, with tomorrow's as ``target``."""
    s = Series(keys)
    month = F.month("date")
    blocks = {"day_of_year": F.dayofyear("date"), "month": month, "season_summer": flag(month.isin(6, 7, 8)), "season_winter": flag(month.isin(12, 1, 2))}
    for k in (1, 2):
        blocks[f"doy_sin_{k}"], blocks[f"doy_cos_{k}"] = cyclical(F.dayofyear("date"), 365.25, k)
    blocks |= solar_power(s, daily.columns) | generation_lags(s, target, "solar_gen")
    return daily.withColumns(blocks | {"target": s.lag(target, -1)}).where("target is not null")


# --- production and price -------------------------------------------------------


#: Months of freeze-offs and of Gulf storms, breakeven price.
FREEZE_MONTHS, STORM_MONTHS, BREAKEVEN = (12, 1, 2), (6, 7, 8, 9, 10), 2.50


def _score(s: Series, x: str, n: int, need: int, least: float) -> Column:
    """Deviation from the rolling mean over the rolling deviation, which is ``least`` at least."""
    return (F.col(x) - s.mean(x, n, need)) / clip(s.std(x, n, need), least)


def production(s: Series, price: str | None, drilling: str, output: str, horizon: int = 90) -> dict[str, Column]:
    """Gas production features and the direction ``horizon`` rows ahead.

    Rows are days; a month is 30 rows.  Price features are left out without a price.
    """
    month, drill = F.month("date"), F.col(drilling)
    out: dict[str, Column] = {"month": month, "quarter": F.quarter("date"), "day_of_year": F.dayofyear("date")}
    for k in (1, 2):
        out[f"doy_sin_{k}"], out[f"doy_cos_{k}"] = cyclical(F.dayofyear("date"), 365.25, k)
    winter, storms = flag(month.isin(*FREEZE_MONTHS)), flag(month.isin(*STORM_MONTHS))
    out |= {"freeze_off_risk": winter, "hurricane_season": storms, "drill_zscore": _score(s, drilling, 730, 90, 1.0)}
    out |= {f"drill_roc_{m}m": s.pct(drilling, 30 * m) * 100 for m in (1, 3, 6, 12)}
    out |= {f"drill_rising_{m}m": flag(drill > s.lag(drilling, 30 * m)) for m in (3, 6)}
    for name, edge in (("high", s.max), ("low", s.min)):
        out[f"drill_vs_5yr_{name}"] = drill / clip(edge(drilling, 365 * 5, 365), 0.01)
    out["prod_zscore"] = _score(s, output, 365, 60, 0.001)
    out |= {f"prod_mom_{m}m": s.pct(output, 30 * m) for m in (1, 3, 6)}
    out |= {f"prod_smooth_{m}m": s.mean(output, 30 * m) for m in (3, 6)}
    quarter_ago = F.try_divide(s.lag(output, 90), s.lag(output, 180)) - 1
    out |= {"prod_yoy_growth": s.pct(output, 365), "prod_accel_3m": out["prod_mom_3m"] - quarter_ago}
    if price is not None:
        out |= {
            "price_zscore": _score(s, price, 365, 60, 0.01), "price_mom_1m": s.pct(price, 30), "price_mom_3m": s.pct(price, 90),
            "price_above_breakeven": flag(F.col(price) > BREAKEVEN), "price_high_regime": flag(F.col(price) > s.quantile(price, 0.75, 365)),
        }
        out["drill_x_price_high"] = out["drill_zscore"] * out["price_high_regime"]
    up, pace = out["drill_rising_3m"], out["prod_mom_3m"]
    out |= {"drill_up_prod_up": up * flag(pace > 0), "drill_down_prod_down": (1 - up) * flag(pace < 0), "drill_x_winter": drill * winter, "drill_x_hurricane": drill * storms}
    return out | {"target": flag(s.lag(output, -horizon) > F.col(output))}


def price_baseline(s: Series, price: str = "close", horizons: tuple[int, ...] = (1, 5)) -> dict[str, Column]:
    """Price-direction features by this model's own conventions, without exponential means.

    Needs open, high, low, volume and the columns of ``with_price_means``.
    """
    x = F.col(price)
    mean, sd = s.mean(price, 20), s.std(price, 20)
    out: dict[str, Column] = {"log_ret": s.log_return(price)}
    out |= {f"ret_{k}d": s.pct(price, k) for k in (1, 2, 3, 5, 10, 20)} | {f"momentum_{k}d": s.pct(price, k) for k in (5, 10, 20)}
    for n in (5, 10, 20, 50):
        out |= {f"sma_{n}": s.mean(price, n), f"sma_ratio_{n}": _divide(x, s.mean(price, n))}
    out |= {f"volatility_{n}d": s.std("_log_ret", n) * F.sqrt(F.lit(252.0)) for n in (5, 10, 20)}
    span_, volume = F.col("high") - F.col("low"), s.mean("volume", 20)
    out |= {
        "bb_upper": mean + 2 * sd, "bb_lower": mean - 2 * sd, "bb_pct": _divide(x - mean, 2 * sd), "ema_cross_12_26": F.col("ema_12") - F.col("ema_26"), "macd_hist": F.col("macd") - F.col("macd_signal"),
        "volume_sma_20": volume, "volume_ratio": F.col("volume") / (volume + 1), "volume_change": s.pct("volume"), "daily_range": span_ / x, "body_pct": (x - F.col("open")) / (span_ + 1e-10),
        "day_of_week": F.weekday("date"), "month": F.month("date"), "quarter": F.quarter("date"), "is_monday": flag(F.weekday("date") == 0), "is_friday": flag(F.weekday("date") == 4),
    }
    out["doy_sin"], out["doy_cos"] = cyclical(F.dayofyear("date"), 365.25)
    for h in horizons:
        later = _divide(s.lag(price, -h), x) - 1
        out |= {f"target_ret_{h}d": later, f"target_dir_{h}d": flag(later > 0)}
    return out | gas_seasons()


def with_price_means(df: DataFrame, price: str = "close", keys: tuple[str, ...] = ()) -> DataFrame:
    """Adds ema_5, ema_12, ema_26 (recursive), macd and its signal (weighted), _log_ret."""
    out = ewm(df.withColumn("_log_ret", Series(keys).log_return(price)), list(keys), ["date"], {
        **{f"ema_{n}": (price, span(n), False) for n in (5, 12, 26)}, "_fast": (price, span(12), True), "_slow": (price, span(26), True),
    })
    out = out.withColumn("macd", F.col("_fast") - F.col("_slow")).drop("_fast", "_slow")
    return ewm(out, list(keys), ["date"], {"macd_signal": ("macd", span(9), True)})


def rsi_smoothed(s: Series, df: DataFrame, price: str = "close", n: int = 14) -> DataFrame:
    """RSI with losses offset by 1e-10 and the first change counted as zero."""
    change = F.coalesce(s.diff(price), F.lit(0.0))
    out = df.withColumns({"_g": F.greatest(change, F.lit(0.0)), "_l": F.greatest(-change, F.lit(0.0))})
    return out.withColumn("rsi_14", 100 - 100 / (1 + s.mean("_g", n) / (s.mean("_l", n) + 1e-10))).drop("_g", "_l")


def demand_features(prices: DataFrame, demand: DataFrame, value: str = "demand", forecast: str | None = None) -> DataFrame:
    """As-of demand (or its forecast) with lag-1 actual, surprise, changes, deviation,
    volatility and rank, and crosses with what ``prices`` has: storage (``ng_storage``,
    ``ng_storage_surprise``), seasons (``heating_season``, ``is_winter``), ``wx_hdd``."""
    s, have = Series(), prices.columns
    df = asof_join(prices, demand, values=(value,) if forecast is None else (value, forecast))
    x = forecast or value
    actual = s.lag(value)
    df = df.withColumns({"demand_lag1": actual, "demand_surprise": F.col(x) - actual, "demand_surprise_pct": (F.col(x) - actual) / (actual + 1)})
    mean = s.mean(x, 30)
    df = df.withColumns({
        **{f"demand_mom_{k}d": s.pct(x, k) for k in (1, 5, 20)}, "demand_roll_30d": mean, "demand_dev30": (F.col(x) - mean) / (mean + 1), "demand_vol_7": s.std(x, 7), "demand_vol_20": s.std(x, 20),
        "demand_pctile_252": s.pct_rank(x, 252),
    })
    out: dict[str, Column] = {}
    if "ng_storage" in have:

        def z(name):
            return (F.col(name) - s.mean(name, 60)) / (s.std(name, 60) + 1)

        out |= {"demand_x_storage": -F.col("demand_dev30") * F.coalesce("ng_storage_surprise", F.lit(0.0)), "demand_storage_ratio": _divide(z(x), z("ng_storage") + 0.01)}
    if "heating_season" in have:
        out |= {"demand_x_heating": F.col(x) * F.col("heating_season"), "demand_surprise_x_winter": F.coalesce("demand_surprise", F.lit(0.0)) * F.col("is_winter")}
    if "wx_hdd" in have:
        out["demand_x_hdd"] = F.col("demand_dev30") * F.col("wx_hdd")
    return df.withColumns(out)


# --- sentiment and panels -------------------------------------------------------


def tone(daily: DataFrame, x: str = "tone_mean", volume: str = "n") -> DataFrame:
    s = Series()
    out = daily.withColumns({"tone_ma7": s.mean(x, 7, 1), "tone_ma30": s.mean(x, 30, 1), "tone_z60": s.zscore(x, 60, 10), "volume_log": F.log1p(volume)})
    return out.withColumn("tone_momentum", F.col("tone_ma7") - F.col("tone_ma30"))


def daily_tone(obs: DataFrame, ts: str = "ts", x: str = "tone") -> DataFrame:
    v = F.col(x)
    out = obs.groupBy(F.to_date(ts).alias("date")).agg(F.avg(v).alias("tone_mean"), F.stddev_samp(v).alias("tone_std"), F.min(v).alias("tone_min"), F.max(v).alias("tone_max"), F.count(v).alias("n"))
    return out.withColumn("tone_range", F.col("tone_max") - F.col("tone_min"))


def geopolitical(s: Series, x: str = "gpr") -> dict[str, Column]:
    z = s.zscore(x, 60, 10)
    return {"gpr_ma7": s.mean(x, 7, 1), "gpr_ma30": s.mean(x, 30, 1), "gpr_z60": z, "gpr_high": flag(F.col(x) > F.percentile(x, 0.75).over(s.so_far)), "gpr_spike": flag(z > 2), "gpr_change_5d": s.diff(x, 5)}


def macro_panel(series: DataFrame, names: list[str], spread: tuple[str, str] | None = None) -> DataFrame:
    """Long (series, date, value) to one carried-forward column a series, by day.

    ``spread`` names a long and a short rate; their difference, on the days that have
    both, is carried forward as ``yield_spread_10y2y``.
    """
    wide = series.groupBy("date").pivot("series", names).agg(F.first("value"))
    if spread is None:
        return upsample_ffill(wide, values=tuple(names))
    return upsample_ffill(wide.withColumn("yield_spread_10y2y", F.col(spread[0]) - F.col(spread[1])), values=(*names, "yield_spread_10y2y"))


def degree_days(temps: DataFrame, by: tuple[str, ...] = (), base: float = 65.0, weight: str | None = None, t: str = "tavg") -> DataFrame:
    """Heating and cooling degree days by date, station mean or weighted."""
    hot, cold = clip(F.lit(base) - F.col(t), 0.0), clip(F.col(t) - base, 0.0)

    def mean(x):
        return F.avg(x) if weight is None else F.try_divide(F.sum(x * F.col(weight)), F.sum(F.when(x.isNotNull(), F.col(weight))))

    daily = temps.groupBy(*by, "date").agg(mean(hot).alias("hdd"), mean(cold).alias("cdd"), mean(F.col(t)).alias("tavg"))
    s = Series(by)
    return daily.withColumns({f"{x}_{n}d": s.sum(x, n, 1) for x in ("hdd", "cdd") for n in (7, 30)})


def drilling(s: Series, x: str = "drilling") -> dict[str, Column]:
    """Trend, change, place in the year's range and acceleration of daily drilling."""
    v = F.col(x)
    weeks = {f"drill_{n}w": s.mean(x, 7 * n) for n in (4, 13, 26, 52)}
    low, high = s.min(x, 364), s.max(x, 364)
    quarter_ago = s.lag(x, 90) - s.lag(x, 180)
    return weeks | {
        "drill_change_3m": s.diff(x, 90), "drill_change_6m": s.diff(x, 182), "drill_pct_3m": s.pct(x, 90), "drill_pct_6m": s.pct(x, 182),
        "drill_52w_percentile": clip((v - low) / (high - low + 1e-6), 0.0, 1.0), "drill_acceleration": s.diff(x, 90) - quarter_ago, "drill_uptrend": flag(weeks["drill_4w"] > weeks["drill_26w"]),
    }


def output_trend(s: Series, x: str = "production") -> dict[str, Column]:
    """Rolling means, changes and regime of daily production."""
    means = {f"prod_{m}m": s.mean(x, n) for m, n in ((3, 90), (6, 180), (12, 365))}
    return means | {
        "prod_change_3m": s.diff(x, 90), "prod_change_6m": s.diff(x, 180), "prod_pct_3m": s.pct(x, 90), "prod_pct_6m": s.pct(x, 180), "prod_uptrend": flag(means["prod_3m"] > means["prod_12m"]),
    }


# --- pipeline -------------------------------------------------------------------


def clean(df: DataFrame, share: float = 0.5, keys: tuple[str, ...] = ()) -> DataFrame:
    """Drops rows mostly empty, then fills forward and back by key."""
    s = Series(keys)
    kept = df.dropna(thresh=int(len(df.columns) * share))
    rest = [c for c in df.columns if c not in (*keys, "date")]
    return kept.withColumns({c: F.coalesce(s.ffill(c), s.bfill(c)) for c in rest})


def without_empty_columns(df: DataFrame) -> DataFrame:
    """Drops columns that are null in every row (all of them for an empty table); one
    aggregate counts the values of every column."""
    counts = df.agg(*[F.count(F.col(f"`{c}`")).alias(str(i)) for i, c in enumerate(df.columns)]).first()
    return df.select(*[f"`{c}`" for i, c in enumerate(df.columns) if counts[str(i)]])


def dense_rows(df: DataFrame, columns: list[str], share: float = 0.3) -> DataFrame:
    """Rows in which fewer than ``share`` of ``columns`` are null."""
    empty = sum((F.col(c).isNull().cast("int") for c in columns), F.lit(0))
    return df.where(empty < len(columns) * share)


def targets(s: Series, price: str = "close", horizon: int = 1, kind: str = "log_return") -> Column:
    later = s.lag(price, -horizon)
    return {"log_return": F.ln(_divide(later, price)), "pct_change": _divide(later, price) - 1, "direction": flag(later > col(price))}[kind]


def split(df: DataFrame, keys: tuple[str, ...] = (), train: float = 0.7, valid: float = 0.15) -> DataFrame:
    """Adds ``part``: train, valid or test by position in time."""
    s = Series(keys)
    n, i = F.count(F.lit(1)).over(s.whole), s.rank()
    a, b = F.floor(n * train), F.floor(n * train) + F.floor(n * valid)
    return df.withColumn("part", F.when(i <= a, "train").when(i <= b, "valid").otherwise("test"))


def standardise(df: DataFrame, columns: list[str], fit: Column | None = None) -> DataFrame:
    """(x - mean) / population deviation, both from the rows where ``fit`` holds."""
    stats = (df if fit is None else df.where(fit)).agg(*[F.avg(c).alias(f"_m_{c}") for c in columns], *[F.stddev_pop(c).alias(f"_s_{c}") for c in columns])
    joined = df.join(F.broadcast(stats))
    return joined.withColumns({c: (F.col(c) - F.col(f"_m_{c}")) / F.when(F.col(f"_s_{c}") == 0, 1.0).otherwise(F.col(f"_s_{c}")) for c in columns}).drop(*[f"_m_{c}" for c in columns], *[f"_s_{c}" for c in columns])


# --- storage, weather and cross-asset blocks of the price models ------------------


def storage_for_price(prices: DataFrame, weekly: DataFrame, level: str = "level") -> DataFrame:
    """Level, changes over 1 and 4 weeks, 4-week surprise and yearly growth, daily."""
    s = Series()
    w = weekly.select("date", col(level).alias("ng_storage")).withColumns({"ng_storage_change": s.diff("ng_storage"), "ng_storage_change_4w": s.diff("ng_storage", 4), "ng_storage_yoy": s.pct("ng_storage", 52)})
    w = w.withColumn("ng_storage_surprise", F.col("ng_storage_change") - s.mean("ng_storage_change", 4))
    return reindex_ffill(prices, upsample_ffill(w))


def weather_extremes(s: Series, names: tuple[str, ...] = ("hdd", "cdd")) -> dict[str, Column]:
    return {f"{x}_extreme": flag(F.col(x) > s.quantile(x, 0.9, 90)) for x in names}


def gas_seasons(d: str | Column = "date") -> dict[str, Column]:
    m = F.month(col(d))
    return {"is_winter": flag(m.isin(12, 1, 2)), "is_summer": flag(m.isin(6, 7, 8)), "heating_season": flag(m.isin(11, 12, 1, 2, 3)), "injection_season": flag(m.between(4, 10))}


def cross_asset(s: Series, x: str, name: str, volatility: bool = False) -> dict[str, Column]:
    """Moves, z and average ratio of another market's close; levels if a volatility."""
    move = {f"{name}_change_{k}d": s.diff(x, k) for k in (5, 20)} if volatility else {f"{name}_return_{k}d": s.pct(x, k) for k in (5, 20)}
    out = move | {f"{name}_zscore": s.zscore(x, 60, 10), f"{name}_ma_ratio": _divide(x, s.mean(x, 20, 1))}
    if volatility:
        out |= {f"{name}_high": flag(F.col(x) > 40), f"{name}_extreme": flag(F.col(x) > 60)}
    return out


def ratio_zscore(df: DataFrame, a: str, b: str, name: str) -> DataFrame:
    return df.withColumn(name, _divide(a, b)).withColumn(f"{name}_zscore", Series().zscore(name, 60, 10))


def stress_proxies(daily: DataFrame) -> DataFrame:
    """Policy uncertainty, credit spread, consumer and stress flags, of what is there.

    The high-uncertainty flag compares with the quantile of the whole table.
    """
    s, have, out = Series(), set(daily.columns), daily
    if "epu_index" in have:
        q = daily.agg(F.percentile("epu_index", 0.75).alias("_q"))
        out = out.join(F.broadcast(q)).withColumns({"epu_zscore": s.zscore("epu_index", 60, 10), "epu_ma30": s.mean("epu_index", 30, 1), "epu_high": flag(F.col("epu_index") > F.col("_q"))}).drop("_q")
    if "hy_spread" in have:
        out = out.withColumns({"hy_spread_change_5d": s.diff("hy_spread", 5), "hy_spread_change_20d": s.diff("hy_spread", 20), "hy_spread_zscore": s.zscore("hy_spread", 60, 10), "credit_stress_high": flag(F.col("hy_spread") > 5.0)})
    if "consumer_sentiment" in have:
        out = out.withColumn("consumer_sent_change", s.diff("consumer_sentiment", 30))
    if "financial_stress" in have:
        out = out.withColumn("fin_stress_elevated", flag(F.col("financial_stress") > 0))
    return out


def build(
    prices: DataFrame, storage_table: DataFrame | None = None, extra: tuple[DataFrame, ...] = (), horizon: int = 1, kind: str = "log_return",
    macro: DataFrame | None = None, sentiment: DataFrame | None = None,
) -> DataFrame:
    """The whole matrix: indicators, calendar, storage, macro, sentiment, other tables,
    cleaning, target.

    All tables are joined on the date and add only columns that are not there yet.  Macro and
    sentiment columns are carried forward over the price dates, by exact date (a value of a
    day without a price is not seen).
    """
    from wattline.operators.technical import Technical

    out = Technical(keys=()).all(prices).withColumns({**calendar(), **gas_seasons()})
    if storage_table is not None:
        out = with_storage(out, storage_table)
    for t in (macro, sentiment):
        new = [] if t is None else [c for c in t.columns if c not in out.columns]
        if new:
            out = reindex_ffill(out, t.select("date", *new))
    for t in extra:
        new = [c for c in t.columns if c == "date" or c not in out.columns]
        out = out.join(t.select(*new), "date", "left")
    out = clean(out)
    return out.withColumn("target", targets(Series(), horizon=horizon, kind=kind)).where("target is not null")
