"""Feature and energy queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from wattline.functions.ts import HOLIDAYS, Series
from wattline.operators import energy, features, ml
from wattline.plans import frames as fr
from wattline.plans.frames import ctes, r, rounded
from wattline.plans.registry import query

G = "over (order by date)"


def w(n: int, by: str = "") -> str:
    return f"over ({by and f'partition by {by} '}order by date rows {n - 1} preceding)"


def lag(x: str, k: int) -> str:
    return f"lag({x}, {k}) {G}"


def pct(x: str, k: int) -> str:
    return f"({x} / nullif({lag(x, k)}, 0) - 1)"


def avg(x: str, n: int, need: int | None = None) -> str:
    return f"({roll(f'avg({x})', x, n, need)})"


def std(x: str, n: int, need: int | None = None) -> str:
    return f"({roll(f'stddev_samp({x})', x, n, need)})"


def columns(doubles: dict[str, str], ints: dict[str, str], places: int = 6, own: dict[str, int] | None = None) -> str:
    """A select list of rounded doubles and of integers; missing truths are 0."""
    out = [r(e, n, (own or {}).get(n, places)) for n, e in doubles.items()]
    return ", ".join(out + [f"cast(coalesce({e}, false) as integer) as {n}" if any(c in e for c in "<>=") or " in (" in e else f"cast({e} as integer) as {n}" for n, e in ints.items()])


def waves(name: str, x: str, period: float, ks: tuple[int, ...] = ()) -> dict[str, str]:
    if not ks:
        return {f"{name}_{f}": f"{f}(2 * pi() * {x} / {period})" for f in ("sin", "cos")}
    return {f"{name}_{f}_{k}": f"{f}(2 * pi() * {k} * {x} / {period})" for k in ks for f in ("sin", "cos")}


def roll(agg: str, x: str, n: int, need: int | None = None, by: str = "") -> str:
    return f"case when count({x}) {w(n, by)} >= {need or n} then {agg} {w(n, by)} end"


_STORAGE = f"""c as (select *, level - lag(level) {G} as chg, level - lag(level, 52) {G} as yoy from weekly),
e as (select *, {roll('avg(chg)', 'chg', 4)} as expd, {roll('avg(abs(chg))', 'chg', 260)} as sz from c)"""


@query("storage_surprise", ctes("weekly") + f", {_STORAGE} select date, level, {r('chg', 'storage_change')}, {r('expd', 'storage_expected')}, {r('chg - expd', 'storage_surprise')}, {r('(chg - expd) / nullif(sz, 0)', 'storage_surprise_norm')}, {r('yoy', 'storage_yoy')} from e")
def storage_surprise(spark, sf):
    return rounded(features.storage(fr.weekly(spark, sf)))


@query("storage_on_prices", ctes("market", "weekly") + f""", {_STORAGE}, d as (select unnest(generate_series((select min(date) from e), (select max(date) from e), interval 1 day))::date as date),
f as (select d.date, last_value(chg ignore nulls) over k as chg, last_value(chg - expd ignore nulls) over k as sur, last_value(yoy ignore nulls) over k as yoy from d left join e on d.date = e.date window k as (order by d.date rows unbounded preceding))
select m.date, m.close, {r('last_value(chg ignore nulls) over j', 'storage_change')}, {r('last_value(sur ignore nulls) over j', 'storage_surprise')}, {r('last_value(f.yoy ignore nulls) over j', 'storage_yoy')} from market m left join f on m.date = f.date window j as (order by m.date rows unbounded preceding)""")
def storage_on_prices(spark, sf):
    out = features.with_storage(fr.market(spark, sf).select("date", "close"), fr.weekly(spark, sf))
    return rounded(out.drop("storage_surprise_norm"))


@query("futures_curve_flags", ctes("bars") + """, p as (select date, max(close) filter (where symbol = '1-URGENT') as a, max(close) filter (where symbol = '2-HIGH') as b, max(close) filter (where symbol = '3-MEDIUM') as c from bars group by date)
select date, round(b - a, 4) + 0.0 as spread_m1, round(c - a, 4) + 0.0 as spread_m2, coalesce(b - a < 0, false)::int as backwardation, coalesce(b - a > 0, false)::int as contango from p""")
def futures_curve_flags(spark, sf):
    p = fr.bars(spark, sf).groupBy("date").pivot("symbol", ["1-URGENT", "2-HIGH", "3-MEDIUM"]).agg(F.max("close"))
    p = p.toDF("date", "a", "b", "c")
    return rounded(p.select("date", *[c.alias(n) for n, c in features.futures_curve("a", "b", "c").items()]), 4)


@query("rig_count_features", ctes("weekly") + f""", c as (select date, level as rig_count, level - lag(level) {G} as a, level - lag(level, 4) {G} as b, lag(level) {G} as l from weekly),
d as (select unnest(generate_series((select min(date) from c), (select max(date) from c), interval 1 day))::date as date)
select d.date, last_value(rig_count ignore nulls) over k as rig_count, last_value(a ignore nulls) over k as rig_change_1w, last_value(b ignore nulls) over k as rig_change_4w, last_value(l ignore nulls) over k as rig_count_lag_1w from d left join c on d.date = c.date window k as (order by d.date rows unbounded preceding)""")
def rig_count_features(spark, sf):
    return features.rig_count(fr.weekly(spark, sf), "level").drop("rig_change_52w")


@query("supply_balance", "select event_id, coalesce(value, 0) + coalesce(case when event_id % 3 = 0 then value end, 0) - coalesce(case when event_id % 2 = 0 then 1.0 end, 0) as balance from events")
def supply_balance(spark, sf):
    e = fr.read(spark, sf, "events")
    i = F.col("event_id")
    return e.select("event_id", features.supply_balance("value", F.when(i % 3 == 0, F.col("value")), F.when(i % 2 == 0, F.lit(1.0))).alias("balance"))


_MACRO = {
    "usd_ret_5d": pct("usd", 5), "usd_ret_20d": pct("usd", 20), "usd_z60": f"(usd - {avg('usd', 60)}) / nullif({std('usd', 60)}, 0)", "equity_ret_5d": pct("eq", 5), "equity_ret_20d": pct("eq", 20),
    **{f"{n}_corr_60d": f"case when count({x}) {w(60)} >= 60 then covar_samp({x}, t) {w(60)} / nullif(stddev_samp({x}) {w(60)} * stddev_samp(t) {w(60)}, 0) end" for n, x in (("usd", "ur"), ("equity", "er"))},
    "vix_change_5d": f"vix - {lag('vix', 5)}", "yield_spread_10y2y_change_20d": f"spread - {lag('spread', 20)}", "fed_funds_change_20d": f"usd - {lag('usd', 20)}",
}


@query("macro_features", ctes("market") + f""", x as (select date, close as usd, open as eq, high as px, volume as vix, volume - 3 as spread from market),
l as (select *, ln(usd / {lag('usd', 1)}) as ur, ln(eq / {lag('eq', 1)}) as er, ln(px / {lag('px', 1)}) as t from x)
select date, {columns(_MACRO, {'vix_high': 'vix > 25', 'vix_extreme': 'vix > 35', 'yield_curve_inverted': 'spread < 0', 'regime': 'case when vix <= 20 then 0 when vix <= 30 then 1 when vix <= 40 then 2 else 3 end'.replace('<=', 'between -1e9 and')}, own={'fed_funds_change_20d': 4})} from l""")
def macro_features(spark, sf):
    x = fr.market(spark, sf).select("date", F.col("close").alias("usd"), F.col("open").alias("eq"), F.col("high").alias("px"), F.col("volume").alias("vix"), (F.col("volume") - 3).alias("yield_spread_10y2y"), F.col("close").alias("fed_funds"))
    out = features.with_macro(x, "px", dollar="usd", equity="eq", vix="vix", rates=("yield_spread_10y2y", "fed_funds"))
    return rounded(out.drop("usd", "eq", "px", "vix", "yield_spread_10y2y", "fed_funds"), fed_funds_change_20d=4)


_SEASONS = {"heating_season": "10, 11, 12, 1, 2, 3", "cooling_season": "6, 7, 8, 9", "driving_season": "5, 6, 7, 8, 9", "hurricane_season": "6, 7, 8, 9, 10, 11", "refinery_maintenance": "3, 4, 9, 10"}
_SEASONAL_INTS = {
    "month": "month(date)", "day_of_week": "isodow(date) - 1", "day_of_year": "dayofyear(date)", "quarter": "quarter(date)", "year": "year(date)", "week_of_year": "weekofyear(date)",
    "is_month_end": "date = last_day(date)", "is_quarter_end": "date = last_day(date) and month(date) in (3, 6, 9, 12)", "eia_report_day": "isodow(date) = 4", **{k: f"month(date) in ({v})" for k, v in _SEASONS.items()},
}


@query("seasonal_features", ctes("market") + f" select date, {columns(waves('month', 'month(date)', 12) | waves('dow', '(isodow(date) - 1)', 7) | waves('doy', 'dayofyear(date)', 365) | waves('woy', 'weekofyear(date)', 52), _SEASONAL_INTS)} from market")
def seasonal_features(spark, sf):
    m = fr.market(spark, sf).select("date")
    return rounded(m.select("date", *[c.alias(n) for n, c in features.seasonal().items()]))


_DAILY = """daily as (select region, cast(ts as date) as date, sum(mw) as total_mwh, max(mw) as peak_mw, min(mw) as min_mw, avg(mw) as avg_mw, count(mw) as hours from hourly group by region, cast(ts as date) having count(mw) >= 20)"""


@query("demand_panel", ctes("hourly") + f", {_DAILY} select region, date, {r('total_mwh', 'total_mwh', 4)}, peak_mw, min_mw, {r('avg_mw', 'avg_mw', 8)}, hours, {r('avg_mw / nullif(peak_mw, 0)', 'load_factor', 8)} from daily")
def demand_panel(spark, sf):
    return rounded(energy.demand_panel(fr.hourly(spark, sf)), total_mwh=4, avg_mw=8, load_factor=8, peak_mw=9, min_mw=9)


@query("generation_panel", ctes("hourly") + f""", {_DAILY}, s as (select region, cast(ts as date) as date, stddev_samp(mw) as sd, max(step) as ramp from (select *, abs(mw - lag(mw) over (partition by region order by ts)) as step from hourly) group by region, cast(ts as date))
select d.region, d.date, {r('total_mwh', 'total_mwh', 4)}, {r('ramp', 'ramp', 4)}, {r('least(1.0, greatest(0.0, avg_mw / nullif(peak_mw, 0)))', 'cf', 8)}, {r('least(10.0, greatest(0.0, sd / nullif(avg_mw, 0)))', 'variability', 8)} from daily d join s on s.region = d.region and s.date = d.date""")
def generation_panel(spark, sf):
    p = energy.generation_panel(fr.hourly(spark, sf)).select("region", "date", "total_mwh", "ramp", "cf", "variability")
    return rounded(p, total_mwh=4, ramp=4, cf=8, variability=8)


@query("degree_days", ctes("hourly") + f""", t as (select region, cast(ts as date) as date, avg(mw) / 2 as tavg from hourly group by region, cast(ts as date)),
d as (select date, avg(greatest(65 - tavg, 0)) as hdd, avg(greatest(tavg - 65, 0)) as cdd, avg(tavg) as tavg from t group by date)
select date, {r('hdd', 'hdd')}, {r('cdd', 'cdd')}, {r('tavg', 'tavg')}, {r(f'sum(hdd) {w(7)}', 'hdd_7d')}, {r(f'sum(hdd) {w(30)}', 'hdd_30d')}, {r(f'sum(cdd) {w(7)}', 'cdd_7d')}, {r(f'sum(cdd) {w(30)}', 'cdd_30d')} from d""")
def degree_days(spark, sf):
    t = fr.hourly(spark, sf).groupBy("region", F.to_date("ts").alias("date")).agg((F.avg("mw") / 2).alias("tavg"))
    return rounded(features.degree_days(t))


_DOY = waves("doy", "dayofyear(date)", 365.25, (1, 2, 3))
_PARTS = {"winter": "12, 1, 2", "spring": "3, 4, 5", "summer": "6, 7, 8", "fall": "9, 10, 11"}
_CALENDAR = {
    "day_of_week": "isodow(date) - 1", "day_of_year": "dayofyear(date)", "month": "month(date)", "week_of_year": "weekofyear(date)", "quarter": "quarter(date)", "is_weekend": "isodow(date) >= 6", "is_monday": "isodow(date) = 1",
    "is_friday": "isodow(date) = 5", "is_holiday": f"strftime(date, '%m-%d') in {HOLIDAYS}", **{f"season_{k}": f"month(date) in ({v})" for k, v in _PARTS.items()},
}


def _past(x: str, name: str, change: str = "pct_change") -> dict[str, str]:
    out = {f"{name}_lag_{k}d": lag(x, k) for k in (1, 2, 3, 7, 14, 28)}
    for n in (3, 7, 14, 30):
        out |= {f"{name}_roll_{n}d": avg(x, n), f"{name}_roll_{n}d_std": std(x, n)}
    return out | {f"{name}_{change}_{k}d": pct(x, k) for k in (1, 7)}


def _int(cond: str) -> str:
    return f"cast({cond} as integer)"


_WEEKEND, _WINTER, _SUMMER, _HOLIDAY = _int("isodow(date) >= 6"), _int("month(date) in (12, 1, 2)"), _int("month(date) in (6, 7, 8)"), _int(f"strftime(date, '%m-%d') in {HOLIDAYS}")
_LOAD = _DOY | waves("dow", "(isodow(date) - 1)", 7) | _past("load", "load") | {
    "load_same_dow_1w": lag("load", 7), "load_same_dow_2w": lag("load", 14), "peak_lag_1d": lag("peak", 1), "peak_lag_7d": lag("peak", 7),
    "tavg_sq": "tavg * tavg", "tavg_cube": "tavg * tavg * tavg", "hdd_sq": "hdd * hdd", "cdd_sq": "cdd * cdd", "temp_volatility_7d": std("tavg", 7), "temp_volatility_14d": std("tavg", 14), "temp_wow_change": f"tavg - {lag('tavg', 7)}",
    **{f"{x}_lag_{k}d": lag(x, k) for k in (1, 2, 3) for x in ("tavg", "hdd", "cdd")},
    **{f"{x}_x_weekday": f"{x} * (1 - {_WEEKEND})" for x in ("hdd", "cdd")}, **{f"{x}_x_weekend": f"{x} * {_WEEKEND}" for x in ("hdd", "cdd")}, "hdd_x_winter": f"hdd * {_WINTER}", "cdd_x_summer": f"cdd * {_SUMMER}",
    "temp_x_jul_aug": f"tavg * {_int('month(date) in (7, 8)')}", "temp_x_jan_feb": f"tavg * {_int('month(date) in (1, 2)')}", "hdd_x_holiday": f"hdd * {_HOLIDAY}", "cdd_x_holiday": f"cdd * {_HOLIDAY}", "target": "target",
}
_LOAD_PLACES = {n: 3 for n in _LOAD if n.endswith(("_sq", "_cube"))}


@query("load_features", ctes("market") + f""", x as (select date, volume as load, volume + 2 as peak, close / 5000 as tavg, greatest(65 - close / 5000, 0) as hdd, greatest(close / 5000 - 65, 0) as cdd, lead(volume) {G} as target from market),
f as (select date, {columns(_LOAD, _CALENDAR | {'extreme_cold': 'tavg < 20', 'extreme_heat': 'tavg > 90', 'moderate_temp': 'tavg >= 55 and tavg <= 75'}, own=_LOAD_PLACES)} from x) select * from f where target is not null""")
def load_features(spark, sf):
    m = fr.market(spark, sf)
    t = F.col("close") / 5000
    weather = m.select("date", t.alias("tavg"), F.greatest(65 - t, F.lit(0.0)).alias("hdd"), F.greatest(t - 65, F.lit(0.0)).alias("cdd"))
    out = features.load(m.select("date", F.col("volume").alias("total_mwh"), (F.col("volume") + 2).alias("peak_mw")), weather)
    return rounded(out.drop("total_mwh", "peak_mw", "tavg", "hdd", "cdd"), **_LOAD_PLACES)


@query("wind_features", ctes("market") + f""", x as (select date, close / 5000 as v, close / 4000 as g, cast(volume * 40 as double) as dir from market)
select date, {r('v * v * v', 'wind_speed_cube', 3)}, {r('ln(1 + v)', 'wind_speed_log')}, (v >= 43 and v < 90)::int as wind_rated, {r('least(90.0, greatest(11.0, v))', 'wind_effective')}, {r('least(5.0, greatest(0.0, (g - v) / greatest(v, 1.0)))', 'turbulence_proxy')},
{r('v * sin(radians(dir))', 'wind_u')}, {r('v * cos(radians(dir))', 'wind_v')}, {r(f'v - lag(v, 3) {G}', 'wind_change_3d')}, {r('v * v * v * (v >= 11 and v < 90)::int', 'power_signal', 3)} from x""")
def wind_features(spark, sf):
    x = fr.market(spark, sf).select("date", (F.col("close") / 5000).alias("wind_speed_max"), (F.col("close") / 4000).alias("wind_gusts_max"), (F.col("volume") * 40).alias("wind_dir_dominant"))
    out = features.wind(Series(), x.columns)
    names = ["wind_speed_cube", "wind_speed_log", "wind_rated", "wind_effective", "turbulence_proxy", "wind_u", "wind_v", "wind_change_3d", "power_signal"]
    return rounded(x.select("date", *[out[n].alias(n) for n in names]), wind_speed_cube=3, power_signal=3)


@query("solar_features", ctes("market") + f""" select date, {r('volume * volume', 'solar_rad_sq')}, {r(f'volume - ({roll("avg(volume)", "volume", 7)})', 'solar_rad_anomaly_7d', 8)}, {r(f'volume - ({roll("avg(volume)", "volume", 30)})', 'solar_rad_anomaly_30d')} from market""")
def solar_features(spark, sf):
    x = fr.market(spark, sf)
    return rounded(x.select("date", *[c.alias(n) for n, c in features.solar(Series(), x.columns, "volume").items()]), solar_rad_anomaly_7d=8)


_WIND = {
    "wind_speed_sq": "v * v", "wind_speed_cube": "v * v * v", "wind_speed_log": "ln(1 + v)", "wind_effective": "least(90.0, greatest(11.0, v))", "power_signal": f"v * v * v * {_int('v >= 11 and v < 90')}",
    "wind_change_1d": f"v - {lag('v', 1)}", "wind_change_3d": f"v - {lag('v', 3)}", "gust_speed": "g", "gust_diff": "g - v", "turbulence_proxy": "least(5.0, greatest(0.0, (g - v) / greatest(v, 1.0)))",
    "wind_dir_sin": "sin(radians(dir))", "wind_dir_cos": "cos(radians(dir))", "wind_u": "v * sin(radians(dir))", "wind_v": "v * cos(radians(dir))", **{f"wind_lag_{k}d": lag("v", k) for k in (1, 2, 3, 7)},
    **{f"wind_x_{k}": f"v * {_int(f'month(date) in ({m})')}" for k, m in _PARTS.items()}, "wind_x_temp": "v * t", "wind_x_cold": f"v * {_int('t < 32')}",
    "solar_rad_sq": "s * s", "solar_rad_anomaly_7d": f"s - {avg('s', 7)}", "solar_rad_anomaly_30d": f"s - {avg('s', 30)}", "sunshine_frac": "least(1.0, greatest(0.0, sun / 14))",
    "cf_lag_1d_east_wnd_cf": lag("cf", 1), "cf_lag_7d_east_wnd_cf": lag("cf", 7), "gen_same_dow_1w": lag("gen", 7), "gen_same_dow_2w": lag("gen", 14), "target": "target",
}
_WIND_PLACES = {n: 3 for n in ("wind_speed_sq", "wind_speed_cube", "power_signal", "wind_x_temp", "solar_rad_sq")} | {"gust_speed": 7, "gust_diff": 7}
_WEATHER = "select date, volume as gen, close / 5000 as v, close / 4000 as g, volume * 40 as dir, open / 1000 as s, volume * 3 as sun, low / 4000 as t, volume / 10 as cf, lead(volume) over (order by date) as target from market"


@query("wind_generation", ctes("market") + f""", x as ({_WEATHER}), f as (select date, {columns(_WIND | _DOY | waves('dow', '(isodow(date) - 1)', 7) | _past('gen', 'gen', 'pct'), _CALENDAR | {'wind_below_cutin': 'v < 11', 'wind_rated': 'v >= 43 and v < 90', 'wind_above_cutout': 'v >= 90', 'wind_productive': 'v >= 11 and v < 90'}, own=_WIND_PLACES)} from x) select * from f where target is not null""")
def wind_generation(spark, sf):
    c = F.col
    raw = {"gen": c("volume"), "wind_speed_max": c("close") / 5000, "wind_gusts_max": c("close") / 4000, "wind_dir_dominant": c("volume") * 40, "shortwave_rad": c("open") / 1000, "sunshine_hours": c("volume") * 3, "tavg": c("low") / 4000, "east_wnd_cf": c("volume") / 10}
    out = features.wind_generation(fr.market(spark, sf).select("date", *[e.alias(n) for n, e in raw.items()]), "gen")
    return rounded(out.drop(*raw), **_WIND_PLACES)


_SOLAR = waves("doy", "dayofyear(date)", 365.25, (1, 2)) | {
    "solar_rad_sq": "s * s", "solar_rad_log": "ln(1 + s)", "solar_anomaly_7d": f"s - {avg('s', 7)}", "solar_anomaly_30d": f"s - {avg('s', 30)}", "clear_sky": "least(1.0, greatest(0.0, 1 - cloud / 100))", "sunshine_norm": "greatest(sun, 0) / 14",
    **{f"solar_rad_lag_{k}d": lag("s", k) for k in (1, 2, 3, 7)}, **_past("gen", "solar_gen", "pct"), "target": "target",
}


@query("solar_generation", ctes("market") + f""", x as (select date, volume as gen, open / 1000 as s, volume * 12 as cloud, volume / 3 as rain, volume * 2 as sun, lead(volume) {G} as target from market),
f as (select date, {columns(_SOLAR, {'day_of_year': 'dayofyear(date)', 'month': 'month(date)', 'season_summer': 'month(date) in (6, 7, 8)', 'season_winter': 'month(date) in (12, 1, 2)', 'rain_flag': 'rain > 1'}, own={'solar_rad_sq': 3})} from x) select * from f where target is not null""")
def solar_generation(spark, sf):
    c = F.col
    raw = {"gen": c("volume"), "shortwave_rad": c("open") / 1000, "cloud_cover": c("volume") * 12, "precipitation": c("volume") / 3, "sunshine_hours": c("volume") * 2}
    out = features.solar_generation(fr.market(spark, sf).select("date", *[e.alias(n) for n, e in raw.items()]), "gen")
    return rounded(out.drop(*raw), solar_rad_sq=3)


def _score(x: str, n: int, need: int, least: float) -> str:
    return f"({x} - {avg(x, n, need)}) / greatest({std(x, n, need)}, {least})"


_HIGH_PRICE = f"price > ({roll('quantile_cont(price, 0.75)', 'price', 365)})"
_PRODUCTION = waves("doy", "dayofyear(date)", 365.25, (1, 2)) | {
    "drill_zscore": _score("drill", 730, 90, 1.0), **{f"drill_roc_{m}m": f"{pct('drill', 30 * m)} * 100" for m in (1, 3, 6, 12)},
    "drill_vs_5yr_high": f"case when count(drill) {w(1825)} >= 365 then drill / greatest(max(drill) {w(1825)}, 0.01) end",
    "drill_vs_5yr_low": f"case when count(drill) {w(1825)} >= 365 then drill / greatest(min(drill) {w(1825)}, 0.01) end",
    "prod_zscore": _score("prod", 365, 60, 0.001), **{f"prod_mom_{m}m": pct("prod", 30 * m) for m in (1, 3, 6)}, "prod_smooth_3m": avg("prod", 90), "prod_smooth_6m": avg("prod", 180), "prod_yoy_growth": pct("prod", 365),
    "prod_accel_3m": f"{pct('prod', 90)} - ({lag('prod', 90)} / {lag('prod', 180)} - 1)", "price_zscore": _score("price", 365, 60, 0.01), "price_mom_1m": pct("price", 30), "price_mom_3m": pct("price", 90),
    "drill_x_price_high": f"({_score('drill', 730, 90, 1.0)}) * coalesce({_int(_HIGH_PRICE)}, 0)", "drill_x_winter": f"drill * {_WINTER}", "drill_x_hurricane": f"drill * {_int('month(date) in (6, 7, 8, 9, 10)')}",
}
_RISING = f"drill > {lag('drill', 90)}"
_PRODUCTION_INTS = {
    "month": "month(date)", "quarter": "quarter(date)", "day_of_year": "dayofyear(date)", "freeze_off_risk": "month(date) in (12, 1, 2)", "hurricane_season": "month(date) in (6, 7, 8, 9, 10)", "drill_rising_3m": _RISING,
    "drill_rising_6m": f"drill > {lag('drill', 180)}", "price_above_breakeven": "price > 2.5", "price_high_regime": _HIGH_PRICE, "drill_up_prod_up": f"{_RISING} and {pct('prod', 90)} > 0",
    "drill_down_prod_down": f"not coalesce({_RISING}, false) and {pct('prod', 90)} < 0", "target": f"lead(prod, 90) {G} > prod",
}


@query("production_features", ctes("market") + f", x as (select date, close / 60000 as price, volume as drill, high as prod from market) select date, {columns(_PRODUCTION, _PRODUCTION_INTS, own={'prod_smooth_3m': 4, 'prod_smooth_6m': 4})} from x")
def production_features(spark, sf):
    x = fr.market(spark, sf).select("date", (F.col("close") / 60000).alias("price"), F.col("volume").alias("drill"), F.col("high").alias("prod"))
    return rounded(x.select("date", *[c.alias(n) for n, c in features.production(Series(), "price", "drill", "prod").items()]), prod_smooth_3m=4, prod_smooth_6m=4)


_TREND = {**{f"prod_{m}m": avg("close", n) for m, n in ((3, 90), (6, 180), (12, 365))}, "prod_change_3m": f"close - {lag('close', 90)}", "prod_change_6m": f"close - {lag('close', 180)}", "prod_pct_3m": pct("close", 90), "prod_pct_6m": pct("close", 180)}


@query("production_trend", ctes("market") + f" select date, {columns(_TREND, {'prod_uptrend': f'{avg("close", 90)} > {avg("close", 365)}'}, own=dict.fromkeys(_TREND, 4))} from market")
def production_trend(spark, sf):
    out = fr.market(spark, sf).select("date", *[c.alias(n) for n, c in features.output_trend(Series(), "close").items()])
    return rounded(out, **dict.fromkeys(_TREND, 4))


_BASE_DOUBLES = {
    "log_ret": "lr", **{f"ret_{k}d": pct("close", k) for k in (1, 2, 3, 5, 10, 20)}, **{f"momentum_{k}d": pct("close", k) for k in (5, 10, 20)}, **{f"sma_{n}": avg("close", n) for n in (5, 10, 20, 50)}, **{f"sma_ratio_{n}": f"close / {avg('close', n)}" for n in (5, 10, 20, 50)},
    **{f"volatility_{n}d": f"{std('lr', n)} * sqrt(252.0)" for n in (5, 10, 20)}, "bb_upper": f"{avg('close', 20)} + 2 * {std('close', 20)}", "bb_lower": f"{avg('close', 20)} - 2 * {std('close', 20)}", "bb_pct": f"(close - {avg('close', 20)}) / (2 * {std('close', 20)})",
    "ema_5": "ema_5", "ema_12": "ema_12", "ema_26": "ema_26", "ema_cross_12_26": "ema_12 - ema_26", "macd": "macd", "macd_signal": "macd_signal", "macd_hist": "macd - macd_signal", "volume_sma_20": avg("volume", 20), "volume_ratio": f"volume / ({avg('volume', 20)} + 1)", "volume_change": pct("volume", 1),
    "daily_range": "(high - low) / close", "body_pct": "(close - open) / (high - low + 1e-10)", **waves("doy", "dayofyear(date)", 365.25), **{f"target_ret_{h}d": f"lead(close, {h}) {G} / close - 1" for h in (1, 5)},
}
_BASE_INTS = {
    **{k: _CALENDAR[k] for k in ("day_of_week", "month", "quarter", "is_monday", "is_friday")}, "is_winter": "month(date) in (12, 1, 2)", "is_summer": "month(date) in (6, 7, 8)", "heating_season": "month(date) in (11, 12, 1, 2, 3)", "injection_season": "month(date) in (4, 5, 6, 7, 8, 9, 10)",
    **{f"target_dir_{h}d": f"lead(close, {h}) {G} / close - 1 > 0" for h in (1, 5)},
}
_BASE_PLACES = {n: 3 for n in _BASE_DOUBLES if n.startswith(("sma_", "ema_", "bb_upper", "bb_lower", "macd")) and "ratio" not in n} | {f"sma_{n}": 5 for n in (5, 10, 20, 50)} | {"body_pct": 4}


def _weighted(x: str, n: int, seen: str) -> str:
    """Exponential mean with all weights, over the list ``seen``."""
    b = 1 - 2 / (n + 1)
    return f"list_sum(list_transform({seen}, lambda v, i: v * pow({b!r}, len({seen}) - i))) / list_sum(list_transform({seen}, lambda v, i: pow({b!r}, len({seen}) - i)))"


@query("price_baseline_features", ctes("market") + f""", l as (select *, ln(close / {lag('close', 1)}) as lr, list(close) over (order by date rows unbounded preceding) as seen from market),
e as (select * exclude (seen), {', '.join(f"list_reduce(seen, lambda p, q: {2 / (n + 1)!r} * q + {1 - 2 / (n + 1)!r} * p) as ema_{n}" for n in (5, 12, 26))}, {_weighted('close', 12, 'seen')} - ({_weighted('close', 26, 'seen')}) as macd from l),
m as (select *, list(macd) over (order by date rows unbounded preceding) as seen from e), x as (select * exclude (seen), {_weighted('macd', 9, 'seen')} as macd_signal from m)
select date, {columns(_BASE_DOUBLES, _BASE_INTS, own=_BASE_PLACES)} from x""")
def price_baseline_features(spark, sf):
    df = features.with_price_means(fr.market(spark, sf))
    out = df.select("date", "ema_5", "ema_12", "ema_26", "macd", "macd_signal", *[c.alias(n) for n, c in features.price_baseline(Series()).items()])
    return rounded(out, **_BASE_PLACES)


@query("rsi_smoothed", ctes("market") + f", d as (select date, coalesce(close - lag(close) {G}, 0) as d from market), g as (select date, greatest(d, 0) as g, greatest(-d, 0) as l from d) select date, {r(f'100 - 100 / (1 + ({roll("avg(g)", "g", 14)}) / (({roll("avg(l)", "l", 14)}) + 1e-10))', 'rsi_14')} from g")
def rsi_smoothed(spark, sf):
    return rounded(features.rsi_smoothed(Series(), fr.market(spark, sf)).select("date", "rsi_14"))


_Z = "({0} - {1}) / ({2} + 1)"
_DEMAND = {
    "demand": "demand", "demand_lag1": lag("demand", 1), "demand_surprise": f"forecast - {lag('demand', 1)}", "demand_surprise_pct": f"(forecast - {lag('demand', 1)}) / ({lag('demand', 1)} + 1)", **{f"demand_mom_{k}d": pct("forecast", k) for k in (1, 5, 20)},
    "demand_roll_30d": avg("forecast", 30), "demand_dev30": "dev", "demand_vol_7": std("forecast", 7), "demand_vol_20": std("forecast", 20), "demand_x_storage": "-dev * coalesce(ng_storage_surprise, 0)",
    "demand_storage_ratio": f"(forecast - {avg('forecast', 60)}) / ({std('forecast', 60)} + 1) / nullif((ng_storage - {avg('ng_storage', 60)}) / ({std('ng_storage', 60)} + 1) + 0.01, 0)",
    "demand_x_heating": f"forecast * {_int('month(date) in (11, 12, 1, 2, 3)')}", "demand_surprise_x_winter": f"coalesce(forecast - {lag('demand', 1)}, 0) * {_int('month(date) in (12, 1, 2)')}", "demand_x_hdd": "dev * wx_hdd",
    "demand_pctile_252": "case when len(seen) >= 252 then (len(list_filter(seen, lambda v: v < forecast)) + (len(list_filter(seen, lambda v: v = forecast)) + 1) / 2.0) / len(seen) end",
}


@query("demand_on_prices", ctes("market", "weekly") + f""", a as (select m.date, k.level as demand, k.level * 1.5 as forecast, m.close as ng_storage, m.open - m.close as ng_storage_surprise, m.volume as wx_hdd from market m asof left join weekly k on m.date >= k.date),
x as (select *, (forecast - {avg('forecast', 30)}) / ({avg('forecast', 30)} + 1) as dev, list(forecast) filter (where forecast is not null) over (order by date rows 251 preceding) as seen from a) select date, {columns(_DEMAND, {}, own={'demand_x_storage': 3})} from x""")
def demand_on_prices(spark, sf):
    c = F.col
    prices = fr.market(spark, sf).select("date", c("close").alias("ng_storage"), (c("open") - c("close")).alias("ng_storage_surprise"), c("volume").alias("wx_hdd"), *[e.alias(n) for n, e in features.gas_seasons().items()])
    demand = fr.weekly(spark, sf).select("date", c("level").alias("demand"), (c("level") * 1.5).alias("forecast"))
    return rounded(features.demand_features(prices, demand, forecast="forecast").select("date", *_DEMAND), demand_x_storage=3)


@query("daily_tone", f"""with d as (select cast(ts as date) as date, avg(value) as m, stddev_samp(value) as s, max(value) - min(value) as rng, count(value) as n from events group by all)
select date, {r('m', 'tone_mean')}, {r('s', 'tone_std')}, {r('rng', 'tone_range')}, n, {r(f'avg(m) {w(7)}', 'tone_ma7')}, {r(f'avg(m) {w(7)} - avg(m) {w(30)}', 'tone_momentum')}, {r('ln(1 + n)', 'volume_log')},
{r(f"(m - ({roll('avg(m)', 'm', 60, 10)})) / nullif({roll('stddev_samp(m)', 'm', 60, 10)}, 0)", 'tone_z60')} from d""")
def daily_tone(spark, sf):
    d = features.tone(features.daily_tone(fr.read(spark, sf, "events").withColumnRenamed("value", "tone")))
    return rounded(d.select("date", "tone_mean", "tone_std", "tone_range", "n", "tone_ma7", "tone_momentum", "volume_log", "tone_z60"))


@query("geopolitical_risk", ctes("market") + f""", z as (select *, (volume - ({roll('avg(volume)', 'volume', 60, 10)})) / nullif({roll('stddev_samp(volume)', 'volume', 60, 10)}, 0) as z from market)
select date, {r(f'avg(volume) {w(7)}', 'gpr_ma7', 8)}, {r('z', 'gpr_z60')}, (volume > quantile_cont(volume, 0.75) over (order by date rows unbounded preceding))::int as gpr_high, coalesce(z > 2, false)::int as gpr_spike, volume - lag(volume, 5) {G} as gpr_change_5d from z""")
def geopolitical_risk(spark, sf):
    out = features.geopolitical(Series(), "volume")
    return rounded(fr.market(spark, sf).select("date", *[out[n].alias(n) for n in ("gpr_ma7", "gpr_z60", "gpr_high", "gpr_spike", "gpr_change_5d")]), gpr_ma7=8)


_PANEL = """p as (select date, max(px) filter (where asset = 'A') as a, max(px) filter (where asset = 'N') as n, max(px) filter (where asset = 'R') as r from assets group by date), d as (select unnest(generate_series((select min(date) from p), (select max(date) from p), interval 1 day))::date as date)"""


@query("macro_panel", ctes("assets") + f""", {_PANEL}
select d.date, round(last_value(a ignore nulls) over k, 6) + 0.0 as "A", round(last_value(n ignore nulls) over k, 6) + 0.0 as "N", round(last_value(r ignore nulls) over k, 6) + 0.0 as "R", round(last_value(a - r ignore nulls) over k, 6) + 0.0 as yield_spread_10y2y from d left join p on d.date = p.date window k as (order by d.date rows unbounded preceding)""")
def macro_panel(spark, sf):
    long = fr.assets(spark, sf).select(F.col("asset").alias("series"), "date", F.col("px").alias("value"))
    return rounded(features.macro_panel(long, ["A", "N", "R"], spread=("A", "R")))


_DRILL = {
    **{f"drill_{n}w": avg("volume", 7 * n) for n in (4, 13, 26, 52)}, "drill_change_3m": f"volume - {lag('volume', 90)}", "drill_change_6m": f"volume - {lag('volume', 182)}", "drill_pct_3m": pct("volume", 90), "drill_pct_6m": pct("volume", 182),
    "drill_52w_percentile": f"case when count(volume) {w(364)} >= 364 then least(1.0, greatest(0.0, (volume - min(volume) {w(364)}) / (max(volume) {w(364)} - min(volume) {w(364)} + 1e-6))) end",
    "drill_acceleration": f"(volume - {lag('volume', 90)}) - ({lag('volume', 90)} - {lag('volume', 180)})",
}


@query("drilling_features", ctes("market") + f" select date, {columns(_DRILL, {'drill_uptrend': f'{avg("volume", 28)} > {avg("volume", 182)}'})} from market")
def drilling_features(spark, sf):
    return rounded(fr.market(spark, sf).select("date", *[c.alias(n) for n, c in features.drilling(Series(), "volume").items()]))


@query("target_and_split", ctes("bars") + f""", t as (select symbol, date, ln(lead(close) over (partition by symbol order by date) / close) as y, row_number() over (partition by symbol order by date) as i, count(*) over (partition by symbol) as n from bars)
select symbol, date, {r('y', 'target')}, case when i <= floor(n * 0.7) then 'train' when i <= floor(n * 0.7) + floor(n * 0.15) then 'valid' else 'test' end as part from t""")
def target_and_split(spark, sf):
    s = Series(["symbol"])
    b = fr.bars(spark, sf).select("symbol", "date", features.targets(s).alias("target"))
    return rounded(features.split(b, ("symbol",)))


@query("standardised", ctes("bars") + f" select symbol, date, {r('(close - (select avg(close) from bars where year(date) < 1998)) / (select stddev_pop(close) from bars where year(date) < 1998)', 'close')} from bars")
def standardised(spark, sf):
    return rounded(features.standardise(fr.bars(spark, sf), ["close"], F.year("date") < 1998).select("symbol", "date", "close"))


@query("feature_cleaning", ctes("bars") + f""", x as (select symbol, date, close, case when volume > 1 then volume end as v, lag(close, 3) over (partition by symbol order by date) as l from bars)
select symbol, date, close, coalesce(last_value(v ignore nulls) over k, first_value(v ignore nulls) over j) as v, coalesce(last_value(l ignore nulls) over k, first_value(l ignore nulls) over j) as l from x
window k as (partition by symbol order by date rows unbounded preceding), j as (partition by symbol order by date rows between current row and unbounded following)""")
def feature_cleaning(spark, sf):
    s = Series(["symbol"])
    x = fr.bars(spark, sf).select("symbol", "date", "close", F.when(F.col("volume") > 1, F.col("volume")).alias("v"), s.lag("close", 3).alias("l"))
    return features.clean(x, 0.5, ("symbol",))


_GEN = """g as (select l_returnflag as region, cast(l_shipdate as date) as date, sum(case when l_linestatus = 'O' then l_quantity else 0 end) as gas_mwh, sum(l_quantity) as total_mwh, 2 + avg(l_discount) * 40 as ng_price from lineitem group by all)"""


def _generation(spark, sf):
    l = fr.read(spark, sf, "lineitem")
    return l.groupBy(F.col("l_returnflag").alias("region"), F.col("l_shipdate").cast("date").alias("date")).agg(
        F.sum(F.when(F.col("l_linestatus") == "O", F.col("l_quantity")).otherwise(0.0)).alias("gas_mwh"), F.sum("l_quantity").alias("total_mwh"), (2 + F.avg("l_discount") * 40).alias("ng_price"))


@query("implied_heat_rate", f"""with {_GEN}, f as (select region, count(*) as n, avg(gas_mwh / total_mwh) as share, regr_slope(gas_mwh / total_mwh, ng_price) as slope from g group by region)
select region, n, {r('share', 'share')}, {r('slope', 'slope')}, {r("case when n < 30 then 7.5 else least(10.5, greatest(6.4, 6.6 + least(1.0, greatest(0.0, (share - 0.15) / 0.5)) * 1.7 + case when slope < -0.005 then least(abs(slope) * 10, 1.0) else 0 end)) end", 'heat_rate')} from f""")
def implied_heat_rate(spark, sf):
    return rounded(energy.implied_heat_rate(_generation(spark, sf)))


_SPREAD = f"""{_GEN}, a as (select *, gas_mwh / nullif(total_mwh, 0) as gas_share, ng_price / nullif(lag(ng_price) over (partition by region order by date), 0) - 1 as ret from g),
b as (select *, {roll('stddev_samp(ret)', 'ret', 20, 5, 'region')} * sqrt(252.0) as vol from a),
q as (select region, avg(gas_share) as gm, greatest(stddev_samp(gas_share), 0.01) as gs, greatest(quantile_cont(vol, 0.5), 0.01) as vm from b group by region),
p as (select b.*, greatest(ng_price * 7.5 + 5 + (gas_share - gm) / gs * 3 + [1.8, 1.5, 0.6, 0.3, 0.5, 1.2, 2.0, 1.8, 0.8, 0.4, 0.7, 1.4][month(date)] + least(3.0, greatest(-1.0, vol / vm - 1)) * 2, ng_price * 6.6 + 2.5) as pp
  from b join q on q.region = b.region),
s as (select region, date, case when vol is null then null else pp end as power_price, ng_price from p)"""


@query("spark_spreads", f"with {_SPREAD} select region, date, {r('power_price', 'power_price')}, {r('power_price - 6.6 * ng_price - 2.5', 'spark_spread')}, {r('power_price - 6.6 * ng_price - 5.0', 'clean_spark_spread')}, {r('power_price - 10.0 * ng_price - 5.0', 'spark_combustion_turbine')}, {r('power_price / (ng_price * 7.5)', 'spark_ratio')} from s")
def spark_spreads(spark, sf):
    out = energy.spark_spreads(_generation(spark, sf))
    return rounded(out.select("region", "date", "power_price", "spark_spread", "clean_spark_spread", "spark_combustion_turbine", "spark_ratio"))


@query("region_report", f"""with {_SPREAD}, k as (select *, power_price - 6.6 * ng_price - 2.5 as ss from s), m as (select region, month(date) as month, avg(ss) as m from k group by all), x as (select region, max_by(month, {{'a': m, 'b': month}}) as best_month from m group by region)
select k.region, {r('avg(ss)', 'mean_spread')}, {r('stddev_samp(ss)', 'std_spread')}, {r('avg((ss > 0)::int)', 'profitable')}, {r('avg(ss - 2.5)', 'mean_clean')}, cast(any_value(best_month) as int) as best_month from k join x on x.region = k.region group by k.region""")
def region_report(spark, sf):
    return rounded(energy.region_report(energy.spark_spreads(_generation(spark, sf))))


@query("merit_order", f"""with {_GEN}, q as (select region, quantile_cont(total_mwh, 0.9) as q from g group by region)
select g.region, {r('avg(gas_mwh) / avg(total_mwh)', 'gas_mwh_share')}, {r('avg(gas_mwh) filter (where total_mwh > q) / avg(total_mwh) filter (where total_mwh > q)', 'gas_mwh_peak_share')} from g join q on q.region = g.region group by g.region""")
def merit_order(spark, sf):
    return rounded(energy.merit_order(_generation(spark, sf), ("gas_mwh",)))


_FUELS = ("gas", "coal", "nuclear", "hydro")
_MIX = """g as (select l_returnflag as region, cast(l_shipdate as date) as date, sum(case when l_linestatus = 'O' then l_quantity else 0 end) as gas, sum(case when l_linestatus <> 'O' then l_quantity else 0 end) as coal,
  sum(l_tax) * 100 as nuclear, sum(l_discount) * 50 as hydro, 2 + avg(l_discount) * 40 as ng_price from lineitem group by all), t as (select *, gas + coal + nuclear + hydro as total from g)"""


def _mix(spark, sf):
    q, old = F.col("l_quantity"), F.col("l_linestatus") == "O"
    return fr.read(spark, sf, "lineitem").groupBy(F.col("l_returnflag").alias("region"), F.col("l_shipdate").cast("date").alias("date")).agg(
        F.sum(F.when(old, q).otherwise(0.0)).alias("gas"), F.sum(F.when(~old, q).otherwise(0.0)).alias("coal"), (F.sum("l_tax") * 100).alias("nuclear"), (F.sum("l_discount") * 50).alias("hydro"), (2 + F.avg("l_discount") * 40).alias("ng_price"))


@query("supply_stack", f"""with {_MIX}, l as (select unnest([0.1, 0.25, 0.5, 0.75, 0.9, 0.95]) as lq), e as (select region, cast(lq as double) as lq, quantile_cont(total, [0.1, 0.25, 0.5, 0.75, 0.9, 0.95])[list_position([0.1, 0.25, 0.5, 0.75, 0.9, 0.95], lq)] as edge from t, l group by region, lq),
h as (select t.region, lq, total, unnest(['gas', 'coal', 'nuclear', 'hydro']) as fuel, unnest([gas, coal, nuclear, hydro]) as x from t join e on e.region = t.region and total > edge)
select region, lq as load_quantile, fuel, {r('avg(x)', 'avg_gen_mwh', 4)}, {r('avg(x) / avg(total) * 100', 'share_pct', 4)} from h group by all having count(*) > 5""")
def supply_stack(spark, sf):
    return rounded(energy.supply_stack(_mix(spark, sf), _FUELS), avg_gen_mwh=4, share_pct=4, load_quantile=9)


@query("marginal_supply", f"""with {_MIX}, m as (select region, median(nuclear) + median(hydro) as base, quantile_cont(coal, 0.9) >= quantile_cont(gas, 0.9) as coal, avg(ng_price) * {energy.HEAT_RATES['combined_cycle']} + {energy.VOM_COSTS['combined_cycle']} as gas_cost, sum(gas) / sum(total) as share from t group by region)
select region, {r('base', 'base_load_mwh')}, case when coal then 'coal' else 'gas' end as marginal_fuel, {r('case when coal then 25.0 else gas_cost end', 'marginal_cost')}, {r('share', 'gas_share')} from m""")
def marginal_supply(spark, sf):
    return rounded(energy.marginal_supply(_mix(spark, sf), _FUELS))


def dispatch_features(spark, sf):
    """Generation by region and day with what a dispatch model sees, and the names of those columns."""
    g = _generation(spark, sf)
    sin, cos = F.sin(2 * F.pi() * F.month("date") / 12), F.cos(2 * F.pi() * F.month("date") / 12)
    g = g.withColumns({"price_sq": F.col("ng_price") * F.col("ng_price"), "month_sin": sin, "month_cos": cos, "total_x_price": F.col("total_mwh") * F.col("ng_price")})
    return g, ("ng_price", "price_sq", "total_mwh", "month_sin", "month_cos", "total_x_price")


@query("dispatch_forecast")
def dispatch_forecast(spark, sf):
    g, names = dispatch_features(spark, sf)
    out = ml.dispatch(g, list(names), "gas_mwh")
    return out.select("region", "date", "gas_mwh", "prediction", (F.col("gas_mwh") - F.col("prediction")).alias("residual"))


@query("demand_backcast")
def demand_backcast(spark, sf):
    m = fr.market(spark, sf)
    t = F.col("close") / 5000
    weather = m.select("date", t.alias("tavg"), F.greatest(65 - t, F.lit(0.0)).alias("hdd"), F.greatest(t - 65, F.lit(0.0)).alias("cdd"))
    df = features.load(m.select("date", F.col("volume").alias("total_mwh")), weather)
    return ml.backcast(df, ["load_lag_1d", "load_lag_7d", "load_roll_7d", "hdd", "cdd", "is_weekend", "doy_sin_1", "doy_cos_1"]).select("date", "target", "prediction")


@query("weather_panel", """with c as (select l_shipmode_k as city, date, v from (select 'c' || cast(l_linenumber as varchar) as l_shipmode_k, cast(l_shipdate as date) as date, avg(l_quantity) as v from lineitem group by all)),
w as (select 'c' || cast(n_nationkey as varchar) as city, cast(n_nationkey as double) as weight from nation)
select date, round(sum(v * weight) / sum(weight), 6) + 0.0 as v from c join w on w.city = c.city group by date""")
def weather_panel(spark, sf):
    l, n = fr.read(spark, sf, "lineitem"), fr.read(spark, sf, "nation")
    c = l.groupBy(F.concat(F.lit("c"), F.col("l_linenumber").cast("string")).alias("city"), F.col("l_shipdate").cast("date").alias("date")).agg(F.avg("l_quantity").alias("v"))
    weights = n.select(F.concat(F.lit("c"), F.col("n_nationkey").cast("string")).alias("city"), F.col("n_nationkey").cast("double").alias("weight"))
    return rounded(energy.weather_panel(c, weights, ("v",)))


@query("storage_for_price", ctes("market", "weekly") + f""", c as (select date, level as ng_storage, level - lag(level) {G} as a, level - lag(level, 4) {G} as b, level / nullif(lag(level, 52) {G}, 0) - 1 as y from weekly), e as (select *, a - ({roll('avg(a)', 'a', 4)}) as s from c),
d as (select unnest(generate_series((select min(date) from e), (select max(date) from e), interval 1 day))::date as date),
f as (select d.date, last_value(ng_storage ignore nulls) over k as ng_storage, last_value(a ignore nulls) over k as a, last_value(b ignore nulls) over k as b, last_value(y ignore nulls) over k as y, last_value(s ignore nulls) over k as s from d left join e on d.date = e.date window k as (order by d.date rows unbounded preceding))
select m.date, last_value(f.ng_storage ignore nulls) over j as ng_storage, last_value(f.a ignore nulls) over j as ng_storage_change, last_value(f.b ignore nulls) over j as ng_storage_change_4w, {r('last_value(f.y ignore nulls) over j', 'ng_storage_yoy')}, {r('last_value(f.s ignore nulls) over j', 'ng_storage_surprise')} from market m left join f on m.date = f.date window j as (order by m.date rows unbounded preceding)""")
def storage_for_price(spark, sf):
    return rounded(features.storage_for_price(fr.market(spark, sf).select("date"), fr.weekly(spark, sf)))


@query("weather_extremes", ctes("market") + f" select date, coalesce(volume > ({roll('quantile_cont(volume, 0.9)', 'volume', 90)}), false)::int as volume_extreme, (month(date) in (11, 12, 1, 2, 3))::int as heating_season, (month(date) between 4 and 10)::int as injection_season from market")
def weather_extremes(spark, sf):
    m = fr.market(spark, sf)
    s = features.gas_seasons()
    return m.select("date", features.weather_extremes(Series(), ("volume",))["volume_extreme"].alias("volume_extreme"), s["heating_season"].alias("heating_season"), s["injection_season"].alias("injection_season"))


def _z(x: str) -> str:
    return f"({x} - ({roll(f'avg({x})', x, 60, 10)})) / nullif({roll(f'stddev_samp({x})', x, 60, 10)}, 0)"


@query("cross_asset_features", ctes("market") + f" select date, {r(f'close / nullif(lag(close, 20) {G}, 0) - 1', 'gold_return_20d')}, {r(_z('close'), 'gold_zscore')}, {r(f'close / nullif(avg(close) {w(20)}, 0)', 'gold_ma_ratio')}, {r(f'volume - lag(volume, 5) {G}', 'ovx_change_5d')}, (volume > 40)::int as ovx_high from market")
def cross_asset_features(spark, sf):
    s = Series()
    gold, ovx = features.cross_asset(s, "close", "gold"), features.cross_asset(s, "volume", "ovx", volatility=True)
    both = {**gold, **ovx}
    return rounded(fr.market(spark, sf).select("date", *[both[n].alias(n) for n in ("gold_return_20d", "gold_zscore", "gold_ma_ratio", "ovx_change_5d", "ovx_high")]))


@query("stress_proxies", ctes("market") + f", x as (select date, volume as epu_index, close / 40000 as hy_spread from market) select date, {r(_z('epu_index'), 'epu_zscore')}, (epu_index > (select quantile_cont(epu_index, 0.75) from x))::int as epu_high, {r(f'hy_spread - lag(hy_spread, 20) {G}', 'hy_spread_change_20d', 9)}, (hy_spread > 5)::int as credit_stress_high from x")
def stress_proxies(spark, sf):
    x = fr.market(spark, sf).select("date", F.col("volume").alias("epu_index"), (F.col("close") / 40000).alias("hy_spread"))
    return rounded(features.stress_proxies(x).select("date", "epu_zscore", "epu_high", "hy_spread_change_20d", "credit_stress_high"), hy_spread_change_20d=9)


def _tone(spark, sf):
    """Daily sentiment of the articles, on days of the market's years."""
    from wattline.operators import news

    a = fr.articles(spark, sf).withColumn("date", F.add_months("date", -12 * 28))
    return news.daily_sentiment(a).select("date", "index_7d", "momentum_14d", F.col("regime").alias("sentiment_regime"))


@query("feature_matrix")
def feature_matrix(spark, sf):
    """All blocks: indicators, calendar, storage, macro panel, sentiment index."""
    long = fr.assets(spark, sf).select(F.col("asset").alias("series"), "date", F.col("px").alias("value"))
    macro = features.macro_panel(long, ["A", "N", "R"], spread=("A", "R"))
    return features.build(fr.market(spark, sf), fr.weekly(spark, sf), macro=macro, sentiment=_tone(spark, sf))
