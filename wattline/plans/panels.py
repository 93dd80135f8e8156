"""Whole panels, report frames of spreads, slices of calls, sizes of positions."""

from __future__ import annotations

from pyspark.sql import functions as F

from wattline.functions.ts import Series, finite
from wattline.operators import backtest, energy, features, ml, report, signals
from wattline.plans import frames as fr
from wattline.plans.energy import _DAILY, _SPREAD, _generation
from wattline.plans.frames import ctes, r, rounded
from wattline.plans.registry import query
from wattline.plans.risk import _SIGNALS, _result

REGIONS = ("click", "error", "purchase", "signup", "view")
_OWN = ("total_mwh", "peak_mw", "min_mw", "avg_mw", "load_factor")
_EAST = ", ".join(f"max({c}) filter (where region = '{g}') as {g}_{c}" for g in REGIONS for c in _OWN)


@query("east_demand", ctes("hourly") + f""", {_DAILY}, f as (select *, avg_mw / nullif(peak_mw, 0) as load_factor from daily),
e as (select date, {_EAST}, sum(total_mwh) as east_total_mwh, sum(peak_mw) as east_peak_mw from f group by date having count(distinct region) = {len(REGIONS)}),
q as (select quantile_cont(east_total_mwh, 0.01) as a, quantile_cont(east_total_mwh, 0.99) as b from e)
select date, {", ".join(r(f"{g}_{c}", f"{g}_{c}", 5) for g in REGIONS for c in _OWN)}, {r('east_total_mwh', 'east_total_mwh', 4)}, {r('east_peak_mw', 'east_peak_mw', 4)}
from e, q where east_total_mwh between a - 2 * (b - a) and b + 2 * (b - a)""")
def east_demand(spark, sf):
    out = energy.east_demand(energy.demand_panel(fr.hourly(spark, sf)), REGIONS)
    return rounded(out, 5, east_total_mwh=4, east_peak_mw=4)


_PLANTS = tuple((g, f) for g in REGIONS for f in ("ng", "wnd"))
_TOTALS = {"ng": "east_gas_gen_total_mwh", "wnd": "east_wind_total_mwh"}
_GEN = ("total_mwh", "peak_mw", "min_mw", "avg_mw", "cf", "variability", "ramp")
_GEN_OWN = [(f"{g}_{f}_{c}", f"max({c}) filter (where region = '{g}' and fuel = '{f}')") for g, f in _PLANTS for c in _GEN]


@query("east_generation", f"""with h as (select event_type as region, case when user_id % 2 = 0 then 'ng' else 'wnd' end as fuel, date_trunc('hour', ts) as ts, sum(value) as mw from events group by all),
s as (select *, abs(mw - lag(mw) over (partition by region, fuel order by ts)) as step from h),
daily as (select region, fuel, cast(ts as date) as date, sum(mw) as total_mwh, max(mw) as peak_mw, min(mw) as min_mw, avg(mw) as avg_mw, stddev_samp(mw) as sd, max(step) as ramp from s group by all having count(mw) >= 20),
c as (select *, least(1.0, greatest(0.0, avg_mw / nullif(peak_mw, 0))) as cf, least(10.0, greatest(0.0, sd / nullif(avg_mw, 0))) as variability from daily),
e as (select date, {", ".join(f"{x} as {n}" for n, x in _GEN_OWN)}, {", ".join(f"coalesce(sum(total_mwh) filter (where fuel = '{f}'), 0) as {n}" for f, n in _TOTALS.items())} from c group by date)
select date, {", ".join(r(f"last_value({n} ignore nulls) over k", n, 5) for n in [*[n for n, _ in _GEN_OWN], *_TOTALS.values()])} from e window k as (order by date rows 2 preceding)""")
def east_generation(spark, sf):
    fuel = F.when(F.col("user_id") % 2 == 0, "ng").otherwise("wnd").alias("fuel")
    ts = F.date_trunc("hour", F.col("ts").cast("timestamp")).cast("timestamp_ntz").alias("ts")
    hourly = fr.read(spark, sf, "events").groupBy(F.col("event_type").alias("region"), fuel, ts).agg(F.sum("value").alias("mw"))
    daily = energy.generation_panel(hourly, by=("region", "fuel"))
    return rounded(energy.east_generation(daily, _PLANTS, _TOTALS), 5)


_CITY = """c as (select 'c' || cast(l_linenumber as varchar) as city, cast(l_shipdate as date) as date, avg(l_quantity) * 2 as tavg, max(l_quantity) * 2 as tmax, min(l_quantity) * 2 as tmin,
  avg(l_discount) * 200 as wind_speed_max, max(l_discount) * 400 as wind_gusts_max, avg(l_extendedprice) / 1000 as shortwave_rad, avg(l_tax) * 1250 as cloud_cover, avg(l_discount) * 25 as precipitation, min(l_tax) * 4500 as wind_dir_dominant
from lineitem group by all), w as (select 'c' || cast(n_nationkey as varchar) as city, cast(n_nationkey + 1 as double) as weight from nation),
t as (select * from w where city in (select city from c)), v as (select c.*, weight / (select sum(weight) from t) as p, c.city = (select max_by(city, weight) from t) as top from c join t on t.city = c.city)"""
_CITY_VALUES = ("tavg", "tmax", "tmin", "wind_speed_max", "wind_gusts_max", "shortwave_rad", "cloud_cover", "precipitation")


def _roll(agg: str, x: str, n: int) -> str:
    return f"case when count({x}) over (order by date rows {n - 1} preceding) >= {n} then {agg}({x}) over (order by date rows {n - 1} preceding) end"


def _change(x: str, n: int = 1) -> str:
    return f"{x} - lag({x}, {n}) over (order by date)"


_CITY_MADE = {
    "hdd_7d": _roll("avg", "hdd", 7), "cdd_7d": _roll("avg", "cdd", 7), "temp_change_1d": _change("tavg"), "temp_range": "tmax - tmin",
    "wind_speed_7d": _roll("avg", "wind_speed_max", 7), "wind_speed_14d": _roll("avg", "wind_speed_max", 14), "wind_speed_change_1d": _change("wind_speed_max"), "wind_speed_change_7d": _change("wind_speed_max", 7),
    "wind_volatility_7d": _roll("stddev_samp", "wind_speed_max", 7), "gust_ratio": "wind_gusts_max / greatest(wind_speed_max, 0.1)",
    "solar_rad_7d": _roll("avg", "shortwave_rad", 7), "solar_rad_14d": _roll("avg", "shortwave_rad", 14), "solar_change_1d": _change("shortwave_rad"), "clear_sky_index": "least(1.0, greatest(0.0, 1 - cloud_cover / 100))",
}


@query("weather_days", f"""with {_CITY}, d as (select date, {", ".join(f"sum({x} * p) as {x}" for x in _CITY_VALUES)}, max(wind_dir_dominant) filter (where top) as wind_dir_dominant, max(wind_speed_max) filter (where city = 'c1') as wind_c1 from v group by date),
h as (select *, greatest(65 - tavg, 0) as hdd, greatest(tavg - 65, 0) as cdd from d)
select date, {", ".join(r(x, x, 8) for x in (*_CITY_VALUES, "wind_dir_dominant", "wind_c1", "hdd", "cdd"))}, {", ".join(r(x, n, 8) for n, x in _CITY_MADE.items())}, (precipitation > 1)::int as rain_flag from h""")
def weather_days(spark, sf):
    l, n = fr.read(spark, sf, "lineitem"), fr.read(spark, sf, "nation")
    cities = l.groupBy(F.concat(F.lit("c"), F.col("l_linenumber").cast("string")).alias("city"), F.col("l_shipdate").cast("date").alias("date")).agg(
        (F.avg("l_quantity") * 2).alias("tavg"), (F.max("l_quantity") * 2).alias("tmax"), (F.min("l_quantity") * 2).alias("tmin"), (F.avg("l_discount") * 200).alias("wind_speed_max"), (F.max("l_discount") * 400).alias("wind_gusts_max"),
        (F.avg("l_extendedprice") / 1000).alias("shortwave_rad"), (F.avg("l_tax") * 1250).alias("cloud_cover"), (F.avg("l_discount") * 25).alias("precipitation"), (F.min("l_tax") * 4500).alias("wind_dir_dominant"))
    weights = n.select(F.concat(F.lit("c"), F.col("n_nationkey").cast("string")).alias("city"), (F.col("n_nationkey") + 1).cast("double").alias("weight"))
    return rounded(energy.weather_days(cities, weights, by_city=("c1",)), 8)


def _spreads(spark, sf):
    return energy.spark_spreads(_generation(spark, sf))


_MARGIN = f"{_SPREAD}, k as (select region, date, power_price, ng_price, power_price - 6.6 * ng_price - 2.5 as ss from s)"


@query("spread_heatmap", f"with {_MARGIN} select region, " + ", ".join(f'round(coalesce(avg(ss) filter (where month(date) = {m}), 0), 6) + 0.0 as "{m}"' for m in range(1, 13)) + " from k group by region")
def spread_heatmap(spark, sf):
    return rounded(energy.spread_heatmap(_spreads(spark, sf)))


@query("spread_rolling", f"with {_MARGIN} select region, date, {r('case when count(ss) over w >= 5 then avg(ss) over w end', 'spark_spread')} from k window w as (partition by region order by date rows 20 preceding)")
def spread_rolling(spark, sf):
    return rounded(energy.rolling_spread(_spreads(spark, sf)))


@query("plant_profitability", f"with {_MARGIN}, pl as (" + " union all ".join(f"select region, '{k}' as plant_type, cast({h} as double) as heat_rate, cast({energy.VOM_COSTS.get(k, 0.0)} as double) as vom, power_price - {h} * ng_price - {energy.VOM_COSTS.get(k, 3.0)} as x from k" for k, h in energy.HEAT_RATES.items()) + f") select region, plant_type, heat_rate, vom, {r('avg(x)', 'avg_spark')}, {r('avg(coalesce(x > 0, false)::int) * 100', 'profitable_pct')} from pl group by all")
def plant_profitability(spark, sf):
    return rounded(energy.plant_profitability(_spreads(spark, sf)))


@query("spread_correlation", f"""with {_MARGIN}, f as (select date, max(ss) filter (where region = 'A') as a, max(ss) filter (where region = 'N') as n, max(ss) filter (where region = 'R') as r from k group by date), fu as (select * from f where a is not null and n is not null and r is not null)
""" + " union all ".join(f"select '{a}' as a, '{b}' as b, {r(f'corr({a.lower()}, {b.lower()})', 'corr')} from fu having count(*) > 30" for a in "ANR" for b in "ANR"))
def spread_correlation(spark, sf):
    return rounded(energy.spread_correlation(_spreads(spark, sf), ("A", "N", "R")))


_CALLS = """c as (select symbol, date, close, close / lag(close) over k - 1 as actual, i from (select *, row_number() over (partition by symbol order by date) as i from bars) window k as (partition by symbol order by date)),
d as (select *, -lag(actual) over (partition by symbol order by date) as pred, cast((i - 1) // 200 as int) as fold from c),
calls as (select symbol, date, close, actual, pred, fold, ((pred > 0) = (actual > 0))::int as hit from d where actual is not null and pred is not null)"""


def _calls(spark, sf):
    """Calls that yesterday's move turns, with what came."""
    s = Series(["symbol"])
    c = fr.bars(spark, sf).select("symbol", "date", "close", s.pct("close").alias("actual"), F.floor((s.rank() - 1) / 200).cast("int").alias("fold"))
    d = c.withColumn("pred", -s.lag("actual")).dropna(subset=["actual", "pred"])
    return d.withColumn("hit", ((F.col("pred") > 0) == (F.col("actual") > 0)).cast("int"))


@query("fold_slices", ctes("bars") + f", {_CALLS} select fold, min(date) as first, max(date) as last, count(*) as n, {r('avg(hit)', 'accuracy')}, {r('avg(abs(actual))', 'mean_size')}, {r('avg((actual > 0)::int) * 100', 'up_pct')} from calls group by fold")
def fold_slices(spark, sf):
    return rounded(ml.fold_slices(_calls(spark, sf)))


@query("year_slices", ctes("bars") + f", {_CALLS} select cast(year(date) as int) as year, count(*) as n, {r('avg(hit)', 'accuracy')}, {r('avg((actual > 0)::int) * 100', 'up_pct')}, {r('avg(actual)', 'mean_return')}, case when avg(actual) > 0.03 then 'strong bull' when avg(actual) > 0.005 then 'bull' when avg(actual) > -0.005 then 'sideways' when avg(actual) > -0.03 then 'bear' else 'strong bear' end as regime from calls group by 1")
def year_slices(spark, sf):
    return rounded(ml.year_slices(_calls(spark, sf)))


_KINDS = {"all": "true", "high volatility": "abs(actual) > s2", "low volatility": "abs(actual) <= s2", "big moves": "abs(actual) > s3", "small moves": "abs(actual) <= s1", "up": "actual > 0", "down": "actual <= 0", "extreme up": "actual > t9", "extreme down": "actual < t1"}


@query("regime_slices", ctes("bars") + f""", {_CALLS}, q as (select quantile_cont(abs(actual), 0.25) as s1, quantile_cont(abs(actual), 0.5) as s2, quantile_cont(abs(actual), 0.75) as s3, quantile_cont(actual, 0.1) as t1, quantile_cont(actual, 0.9) as t9, avg(hit) as o from calls)
""" + " union all ".join(f"select '{k}' as slice, count(*) as n, {r('avg(hit)', 'accuracy')}, {r('avg(hit) - any_value(o)', 'edge')} from calls, q where {c} having count(*) > 0" for k, c in _KINDS.items()))
def regime_slices(spark, sf):
    return rounded(ml.regime_slices(_calls(spark, sf)))


@query("magnitude_slices", ctes("bars") + f""", {_CALLS}, q as (select quantile_cont(abs(pred), [0.0, 0.25, 0.5, 0.75, 0.9, 1.0]) as q from calls), s as (select *, unnest(range(1, 6)) as i from calls, q),
p as (select * from s where abs(pred) >= q[i] and (i = 5 or abs(pred) < q[i + 1]))
select {r('any_value(q[i])', 'low', 8)}, {r('any_value(q[i + 1])', 'high', 8)}, count(*) as n, {r('avg(hit)', 'accuracy')}, {r('avg(abs(actual))', 'mean_size')} from p group by i""")
def magnitude_slices(spark, sf):
    return rounded(ml.magnitude_slices(_calls(spark, sf)), low=8, high=8)


@query("worst_misses", ctes("bars") + f", {_CALLS} select symbol, date, close, fold, hit, {r('actual', 'actual')}, {r('pred', 'pred')}, {r('abs(actual)', 'miss_size')} from calls where hit = 0 order by abs(actual) desc, symbol, date limit 15")
def worst_misses(spark, sf):
    return rounded(ml.worst_misses(_calls(spark, sf), ["symbol", "date"]))


_SIZES = {"by_volatility": "0.15 / coalesce(nullif(v, 0), 0.30)", "by_kelly": "greatest(0.0, 0.25 * (0.55 - 0.45 / 1.5))", "by_kelly_measured": "greatest(0.0, 0.25 * (win - (1 - win) / 1.5))", "by_fixed": "0.02"}


@query("position_sizes", ctes("bars") + f""", x as (select symbol, date, close / nullif(lag(close) over k, 0) - 1 as ret from bars window k as (partition by symbol order by date)),
y as (select symbol, date, case when coalesce(ret, 0) > 0 then 1 when coalesce(ret, 0) < 0 then -1 else 0 end as signal, case when count(ret) over w >= 20 then stddev_samp(ret) over w * sqrt(252.0) end as v, case when count(ret) over l >= 60 then avg((ret > 0)::int) over l end as win0 from x
  window w as (partition by symbol order by date rows 19 preceding), l as (partition by symbol order by date rows 59 preceding)), z as (select *, coalesce(win0, 0.55) as win from y)
select symbol, date, {", ".join(r(f"case when signal = 0 then 0 else least(0.2, greatest(-0.2, signal * ({x}))) end", n) for n, x in _SIZES.items())} from z""")
def position_sizes(spark, sf):
    s = Series(["symbol"])
    x = fr.bars(spark, sf).select("symbol", "date", s.pct("close").alias("ret"))
    y = x.select("symbol", "date", F.signum(F.coalesce("ret", F.lit(0.0))).alias("signal"), (s.std("ret", 20) * F.sqrt(F.lit(252.0))).alias("v"), s.mean((F.col("ret") > 0).cast("int"), 60).alias("win"))
    size = signals.position_size
    return rounded(y.select(
        "symbol", "date", size("signal", "v").alias("by_volatility"), size("signal", "v", "kelly").alias("by_kelly"),
        size("signal", "v", "kelly", win=F.col("win")).alias("by_kelly_measured"), size("signal", "v", "fixed").alias("by_fixed")))


def _one(table: str, name: str) -> str:
    sharpe = "coalesce(avg(x) / nullif(stddev_samp(x), 0) * sqrt(252.0), 0)"
    return f"""select asset, '{name}' as name, {r('max_by(value, date) / min_by(value, date) - 1', 'total_return')}, {r('stddev_samp(net) * sqrt(252.0)', 'annualised_volatility')}, {r(sharpe, 'sharpe')}, {r('min(drawdown)', 'max_drawdown')}
from (select *, net - 0.05 / 252 as x from {table}) group by asset"""


_HOLD = """hold as (select asset, date, net, value, value / max(value) over (partition by asset order by date rows unbounded preceding) - 1 as drawdown from (
  select asset, date, pr as net, 1e6 * product(1 + pr) over (partition by asset order by date rows unbounded preceding) as value from t0))"""


@query("strategy_vs_benchmark", ctes("returns") + f", {_SIGNALS}, t0 as (select asset, date, coalesce(close / lag(close) over (partition by asset order by date) - 1, 0.0) as pr from s), {_HOLD} {_one('res', 'strategy')} union all {_one('hold', 'benchmark')}")
def strategy_vs_benchmark(spark, sf):
    """A strategy's report beside that of holding each asset without cost."""
    result = _result(spark, sf)
    free = backtest.Config(cost_bps=0.0, slippage_bps=0.0)
    bars = result.select("asset", "date", "close")
    s = Series(["asset"])
    held = bars.withColumns({"net": F.coalesce(s.pct("close"), F.lit(0.0)), "n_changes": F.lit(0)}).withColumn("value", free.capital * s.cumprod(1 + F.col("net")))
    held = held.withColumn("drawdown", F.col("value") / s.cummax("value") - 1)
    out = backtest.compare(result, held, ("asset",))
    return rounded(out.select("asset", "name", "total_return", "annualised_volatility", "sharpe", "max_drawdown"))


@query("finite_values", "select event_id, cast(case when value > 50 and event_id % 3 <> 0 then value end as double) as known, cast(coalesce(case when value > 50 and event_id % 3 <> 0 then value end, 0) as double) as filled from events")
def finite_values(spark, sf):
    """Infinities and NaN become null, then 0."""
    e, i, v = fr.read(spark, sf, "events"), F.col("event_id"), F.col("value")
    x = F.when(i % 3 == 0, F.lit(float("inf")) * F.when(i % 2 == 0, 1).otherwise(-1)).when(v <= 50, F.lit(float("nan"))).otherwise(v)
    return e.select("event_id", finite(x).alias("known"), F.coalesce(finite(x), F.lit(0.0)).alias("filled"))


@query("dense_rows", ctes("bars") + """, x as (select symbol, date, close, lag(close) over k as l1, lag(close, 7) over k as l7, lag(close, 30) over k as l30, lag(close, 60) over k as l60 from bars window k as (partition by symbol order by date))
select symbol, date, close, l1, l7, l30, l60 from x where ((l1 is null)::int + (l7 is null)::int + (l30 is null)::int + (l60 is null)::int) < 4 * 0.3""")
def dense_rows(spark, sf):
    """Days with fewer than three in ten lags missing; a lag that no day has goes first."""
    s, names = Series(["symbol"]), ["l1", "l7", "l30", "l60"]
    x = fr.bars(spark, sf).select("symbol", "date", "close", *[s.lag("close", int(n[1:])).alias(n) for n in names], F.lit(None).cast("double").alias("never"))
    return features.dense_rows(features.without_empty_columns(x), names)


@query("sentiment_overlay", ctes("market", "articles") + f""", a as (select cast(date - interval 28 year as date) as date, avg(net) as score from articles group by 1)
select coalesce(m.date, a.date) as date, {r('m.close', 'price')}, {r('a.score', 'score')} from market m full join a on a.date = m.date""")
def sentiment_overlay(spark, sf):
    a = fr.articles(spark, sf).groupBy(F.add_months("date", -12 * 28).alias("date")).agg(F.avg("net").alias("net"))
    return rounded(report.overlay(fr.market(spark, sf), a))


@query("return_heatmap", ctes("returns") + f", {_SIGNALS}, m as (select asset, year(date) as year, month(date) as month, product(1 + net) - 1 as ret from res group by all), y as (select distinct asset, year from m), g as (select *, unnest(range(1, 13)) as month from y) select g.asset, g.year, cast(g.month as int) as month, {r('m.ret * 100', 'pct', 4)} from g left join m on m.asset = g.asset and m.year = g.year and m.month = g.month")
def return_heatmap(spark, sf):
    monthly = backtest.monthly_returns(_result(spark, sf), ("asset",)).withColumn("year", F.col("year").cast("long"))
    return rounded(report.heat_cells(monthly, ("asset",)).drop("text"), 4)


@query("briefing_lines", ctes("bars", "articles") + """, l as (select *, row_number() over (partition by symbol order by date desc) as i from bars), m as (select symbol, max_by(close, date) as close, max_by(close, date) / min_by(close, date) - 1 as change from l where i <= 2 group by symbol)
select 1 as section_no, 'market' as section, printf('%s: %.0f (%.1f%%)', symbol, round(close), round(change * 100, 1)) as line from m
union all select 2, 'sentiment', printf('%d articles, mean %.2f', count(*), round(avg(net), 2)) from articles union all select 3, 'storage', 'not available'""")
def briefing_lines(spark, sf):
    """The sections of a briefing, of which one has no data."""
    market = report.snapshot(fr.bars(spark, sf))
    tone = fr.articles(spark, sf).agg(F.count(F.lit(1)).alias("n"), F.avg("net").alias("m"))
    return report.note_lines({
        "market": (market, F.format_string("%s: %.0f (%.1f%%)", "symbol", F.round("close"), F.round(F.col("change") * 100, 1))),
        "sentiment": (tone, F.format_string("%d articles, mean %.2f", "n", F.round("m", 2))),
        "storage": (fr.weekly(spark, sf).where("level is null"), F.col("level").cast("string")),
    })
