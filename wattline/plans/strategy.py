"""Signal, valuation, validation and report queries."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from wattline.functions.ts import Series, clip, flag
from wattline.operators import backtest, ml, report, signals, valuation
from wattline.plans import frames as fr
from wattline.plans.frames import ctes, r, rounded
from wattline.plans.registry import query

W = "over (partition by symbol order by date)"


def w(n: int) -> str:
    return f"over (partition by symbol order by date rows {n - 1} preceding)"


def roll(agg: str, x: str, n: int, need: int | None = None) -> str:
    return f"case when count({x}) {w(n)} >= {need or n} then {agg} {w(n)} end"


_RAW = f"x as (select symbol, date, case when close > lag(close) {W} then 1 when close < lag(close) {W} then -1 else 0 end as raw, row_number() {W} as i from bars)"


@query("signal_confirm", ctes("bars") + f", {_RAW} select symbol, date, raw, case when i > 2 and min(raw) {w(3)} = 1 then 1 when i > 2 and max(raw) {w(3)} = -1 then -1 else 0 end as signal from x")
def signal_confirm(spark, sf):
    s = Series(["symbol"])
    d = s.diff("close")
    x = fr.bars(spark, sf).select("symbol", "date", F.when(d > 0, 1).when(d < 0, -1).otherwise(0).alias("raw"))
    return x.withColumn("signal", signals.confirm(s, "raw", 2))


@query("threshold_signal", ctes("bars") + f""", f as (select symbol, date, least(greatest(coalesce(close / lag(close) {W} - 1, 0), -0.05), 0.05) as f from bars),
e as (select *, list_reduce(list(f) over (partition by symbol order by date rows unbounded preceding), lambda a, b: 0.5 * b + 0.5 * a) as s, row_number() {W} as i from f),
g as (select *, case when s > 0.015 then 1 when s < -0.015 then -1 else 0 end as raw from e)
select symbol, date, {r('s', 'smoothed')}, raw, case when i > 2 and min(raw) {w(3)} = 1 then 1 when i > 2 and max(raw) {w(3)} = -1 then -1 else 0 end as signal from g""")
def threshold_signal(spark, sf):
    s = Series(["symbol"])
    f = fr.bars(spark, sf).select("symbol", "date", clip(F.coalesce(s.pct("close"), F.lit(0.0)), -0.05, 0.05).alias("f"))
    return rounded(signals.threshold_signal(f, ["symbol"], "f").select("symbol", "date", "smoothed", "raw", "signal"))


@query("vol_target_size", ctes("bars") + f", x as (select symbol, date, close / nullif(lag(close) {W}, 0) - 1 as ret from bars), v as (select *, {roll('stddev_samp(ret)', 'ret', 20)} * sqrt(252.0) as v from x) select symbol, date, {r('least(0.2, greatest(-0.2, 0.15 / coalesce(nullif(v, 0), 0.30)))', 'size')} from v")
def vol_target_size(spark, sf):
    s = Series(["symbol"])
    x = fr.bars(spark, sf).select("symbol", "date", s.pct("close").alias("ret"))
    return rounded(x.select("symbol", "date", signals.size_series(s, "ret").alias("size")))


_STORAGE_Z = """sx as (select date, level, weekofyear(date) as wk, year(date) as yr from weekly),
sz as (select date, coalesce(case when count(level) over h >= 3 and stddev_samp(level) over h > 0 then (level - avg(level) over h) / stddev_samp(level) over h end, 0) as z from sx window h as (partition by wk order by yr range between 5 preceding and 1 preceding)),
storage as (select m.date, coalesce(z, 0) as z, cast(case when coalesce(z, 0) <= -1 then 1 when coalesce(z, 0) >= 1 then -1 else 0 end as double) as storage_signal from market m asof left join sz on m.date >= sz.date)"""
_SEASONAL_T = """md as (select date, year(date) as y, month(date) as mo, ln(close / lag(close) over (order by date)) as lr from market), mm as (select y, mo, sum(lr) as ret from md group by all),
mt as (select y, mo, case when count(ret) over h >= 3 and stddev_samp(ret) over h > 0 then avg(ret) over h / (stddev_samp(ret) over h / sqrt(count(ret) over h)) end as t from mm window h as (partition by mo order by y rows between unbounded preceding and 1 preceding)),
ms as (select date, case when md.y - (select min(y) from md) >= 5 then t end as t from md join mt on mt.y = md.y and mt.mo = md.mo),
seasonal as (select date, t, cast(case when t > 1 then 1 when t < -1 then -1 else 0 end as double) as seasonal_signal from ms)"""
_WEATHER_Z = """wd as (select date, greatest(65 - t, 0) as hdd, greatest(t - 65, 0) as cdd, row_number() over (order by date) as i from (select date, avg(px) / 600 as t from assets group by date)),
wz as (select *, case when count(hdd) over h >= 3 and stddev_samp(hdd) over h > 0 then (hdd - avg(hdd) over h) / stddev_samp(hdd) over h end as zh, case when count(cdd) over h >= 3 and stddev_samp(cdd) over h > 0 then (cdd - avg(cdd) over h) / stddev_samp(cdd) over h end as zc from wd window h as (partition by weekofyear(date) order by date rows between unbounded preceding and 1 preceding)),
wk as (select date, avg(case when i > 60 then least(2.0, greatest(-2.0, 0.75 * coalesce(zh, 0) + 0.25 * coalesce(zc, 0))) / 2 else 0 end) over (order by date rows 6 preceding) as s from wz),
weather as (select m.date, coalesce(s, 0) as weather_signal from market m asof left join wk on m.date >= wk.date)"""
_SENTIMENT = """tn as (select date, level / 400 - 2 as tz from weekly), gp as (select date, avg(px) / 10000 - 3 as gz from assets group by date), st as (select m.date, tz from market m asof left join tn on m.date >= tn.date), sg as (select st.date, tz, gz from st asof left join gp on st.date >= gp.date),
sentiment as (select date, least(1.0, greatest(-1.0, 0.6 * least(1.0, greatest(-1.0, -coalesce(tz, 0) / 2)) + 0.4 * least(1.0, greatest(-0.5, coalesce(gz, 0) / 3)))) as sentiment_signal from sg)"""


def _days(spark, sf):
    t = fr.assets(spark, sf).groupBy("date").agg((F.avg("px") / 600).alias("t"))
    return t.select("date", F.greatest(65 - F.col("t"), F.lit(0.0)).alias("hdd"), F.greatest(F.col("t") - 65, F.lit(0.0)).alias("cdd"))


def _tone(spark, sf):
    return fr.weekly(spark, sf).select("date", (F.col("level") / 400 - 2).alias("tone_z60"))


def _gpr(spark, sf):
    return fr.assets(spark, sf).groupBy("date").agg((F.avg("px") / 10000 - 3).alias("gpr_z60"))


@query("storage_anomaly", ctes("market", "weekly") + f", {_STORAGE_Z} select date, {r('z', 'storage_z')}, storage_signal from storage")
def storage_anomaly(spark, sf):
    return rounded(signals.storage_anomaly(fr.weekly(spark, sf), fr.market(spark, sf)))


@query("seasonal_tstat", ctes("market") + f", {_SEASONAL_T} select date, {r('t', 't')}, seasonal_signal from seasonal")
def seasonal_tstat(spark, sf):
    return rounded(signals.seasonal_t(fr.market(spark, sf)))


@query("technical_signal", ctes("bars") + f""", d as (select *, close - lag(close) {W} as d, {roll('avg(close)', 'close', 20)} as a, {roll('avg(close)', 'close', 60)} as b, close / nullif(lag(close, 20) {W}, 0) - 1 as mom from bars),
u as (select *, {roll('avg(greatest(d, 0.0))', 'd', 14)} as up, {roll('avg(greatest(-d, 0.0))', 'd', 14)} as dn from d), k as (select *, 100 - 100 / (1 + up / nullif(dn, 0)) as rsi from u)
select symbol, date, {r('0.5 * case when a > b then 1 when a < b then -1 else 0 end + 0.3 * case when mom > 0.02 then 0.5 when mom < -0.02 then -0.5 else 0 end + 0.2 * case when rsi > 70 then -0.5 when rsi < 30 then 0.5 else 0 end', 'technical_signal')} from k""")
def technical_signal(spark, sf):
    out = signals.technical(Series(["symbol"]), fr.bars(spark, sf))
    return rounded(out.select("symbol", "date", "technical_signal"))


@query("mean_reversion_signal", ctes("bars") + f", z as (select symbol, date, (close - ({roll('avg(close)', 'close', 200)})) / nullif({roll('stddev_samp(close)', 'close', 200)}, 0) as z from bars) select symbol, date, {r('case when z is null then 0 else least(1.0, greatest(-1.0, -z / 2)) end', 'signal')} from z")
def mean_reversion_signal(spark, sf):
    return rounded(fr.bars(spark, sf).select("symbol", "date", signals.mean_reversion(Series(["symbol"])).alias("signal")))


@query("weather_signal", ctes("market", "assets") + f", {_WEATHER_Z} select date, {r('weather_signal', 'weather_signal')} from weather")
def weather_signal(spark, sf):
    return rounded(signals.weather(_days(spark, sf), fr.market(spark, sf)))


@query("sentiment_signal", ctes("market", "assets", "weekly") + f", {_SENTIMENT} select date, {r('sentiment_signal', 'sentiment_signal', 8)} from sentiment")
def sentiment_signal(spark, sf):
    return rounded(signals.sentiment_on(fr.market(spark, sf), _tone(spark, sf), _gpr(spark, sf)), 8)


_O = "over (order by date)"
_TECHNICAL = f"""td as (select date, close, close - lag(close) {_O} as d, close / nullif(lag(close, 20) {_O}, 0) - 1 as mom, avg(close) over (order by date rows 19 preceding) as a0, avg(close) over (order by date rows 59 preceding) as b0, row_number() {_O} as i from market),
tu as (select *, case when i >= 20 then a0 end as a, case when i >= 60 then b0 end as b, case when count(d) over k >= 14 then avg(greatest(d, 0.0)) over k end as up, case when count(d) over k >= 14 then avg(case when d is not null then greatest(-d, 0.0) end) over k end as dn from td window k as (order by date rows 13 preceding)),
technical as (select date, least(1.0, greatest(-1.0, 0.5 * case when a > b then 1 when a < b then -1 else 0 end + 0.3 * case when mom > 0.02 then 0.5 when mom < -0.02 then -0.5 else 0 end + 0.2 * case when 100 - 100 / (1 + up / nullif(dn, 0)) > 70 then -0.5 when 100 - 100 / (1 + up / nullif(dn, 0)) < 30 then 0.5 else 0 end)) as technical_signal from tu),
reversion as (select date, coalesce(least(1.0, greatest(-1.0, case when count(close) over k >= 200 then -(close - avg(close) over k) / nullif(stddev_samp(close) over k, 0) / 2 end)), 0) * cast(count(close) over k >= 200 as integer) as mean_reversion_signal from market window k as (order by date rows 199 preceding))"""
_COMP = ctes("market", "assets", "weekly") + f""", {_STORAGE_Z}, {_SEASONAL_T}, {_WEATHER_Z}, {_SENTIMENT}, {_TECHNICAL},
x as (select m.date, close, ln(close / lag(close) over (order by m.date)) as lr, (0.1 * storage_signal + 0.1 * seasonal_signal + 0.25 * technical_signal + 0.2 * mean_reversion_signal + 0.1 * weather_signal + 0.15 * sentiment_signal) / 0.9 as composite
  from market m join storage s on s.date = m.date join seasonal e on e.date = m.date join technical t on t.date = m.date join reversion v on v.date = m.date join weather w on w.date = m.date join sentiment z on z.date = m.date),
v as (select *, case when count(lr) over k >= 63 then stddev_samp(lr) over k end * sqrt(252.0) as v0 from x window k as (order by date rows 62 preceding)),
f as (select *, greatest(0.05, coalesce(v0, first_value(v0 ignore nulls) over (order by date rows between current row and unbounded following))) as v from v),
k as (select *, list(v) over (order by date rows unbounded preceding) as l from f),
q as (select *, case when len(l) >= 252 then (len(list_filter(l, lambda y: y < v)) + (len(list_filter(l, lambda y: y = v)) + 1) / 2.0) / len(l) end as rk from k),
s as (select *, case when rk > 0.93 then 0 when composite >= 0.05 then 1 when composite <= -0.15 then -1 else 0 end as signal from q)"""


def _composite(spark, sf):
    df, parts = signals.composite_parts(fr.market(spark, sf).select("date", "close"), fr.weekly(spark, sf), _days(spark, sf), _tone(spark, sf), _gpr(spark, sf))
    return signals.Composite().apply(df, parts)


@query("composite_signal", _COMP + f" select date, {r('composite', 'composite')}, signal, {r('least(1.0, greatest(-0.5, signal * (0.4 + 0.6 * least(abs(composite), 0.8) / 0.8) * least(0.4 / v, 1.5)))', 'position_size')} from s")
def composite_signal(spark, sf):
    return rounded(_composite(spark, sf).select("date", "composite", "signal", "position_size"))


@query("annual_signal", _COMP + f" select year(date) as year, {r('avg(signal)', 'mean_signal')}, count(*) filter (where signal > 0) as n_long, count(*) filter (where signal < 0) as n_short, count(*) filter (where signal = 0) as n_flat from s group by year(date)")
def annual_signal(spark, sf):
    return rounded(report.annual_signal(_composite(spark, sf)).withColumn("year", F.col("year").cast("long")))


@query("strategy_walk_forward")
def strategy_walk_forward(spark, sf):
    folds = signals.walk_forward(_composite(spark, sf).select("date", "close", "signal", "position_size"))
    return backtest.report(backtest.run(folds, backtest.Config(), ("fold",), size="position_size"), ("fold",), risk_free=0.03)


@query("regime_hmm")
def regime_hmm(spark, sf):
    b = fr.bars(spark, sf).select("symbol", "date", "close")
    return signals.regime(b, ["symbol"]).select("symbol", "date", "regime_signal")


@query("trailing_stop")
def trailing_stop(spark, sf):
    s = Series(["symbol"])
    b = fr.bars(spark, sf).select("symbol", "date", "close", (2 * flag(F.col("close") > s.mean("close", 20, 1)) - 1).alias("signal"))
    return signals.trailing_stop(b, ["symbol"])


@query("position_book")
def position_book(spark, sf):
    e = fr.read(spark, sf, "events")
    action = F.when(F.col("event_type") == "purchase", "open").when(F.col("event_type") == "view", "mark").otherwise("close")
    rows = e.select(F.col("user_id").alias("account"), F.col("event_id").alias("seq"), F.concat(F.lit("i"), (F.col("event_id") % 7).cast("string")).alias("instrument"), action.alias("action"), F.lit(0.1).alias("size"), (F.col("value") + 1).alias("price"))
    return signals.run_book(rows, "account")


@query("ou_calibrate", ctes("bars") + f""", p as (select symbol, close as p, lag(close) {W} as x, close - lag(close) {W} as y from bars), f as (select symbol, regr_slope(y, x) as b, regr_intercept(y, x) as a, sqrt((regr_syy(y, x) - regr_sxy(y, x) * regr_sxy(y, x) / regr_sxx(y, x)) / regr_count(y, x)) as eps from p where x is not null group by symbol)
select symbol, {r('greatest(-b * 252, 0.01)', 'kappa')}, {r('-a / b', 'theta', 4)}, {r('eps * sqrt(252.0)', 'sigma', 3)}, {r(f'{math.log(2)!r} / greatest(-b * 252, 0.01) * 252', 'half_life')} from f""")
def ou_calibrate(spark, sf):
    return rounded(valuation.ou_calibrate(fr.bars(spark, sf), ("symbol",)), theta=4, sigma=3)


@query("forward_curve", ctes("market") + f""", m as (select date_trunc('month', date) as m, avg(close) as p from market group by 1), f as (select month(m) as month, avg(p) as p from m group by 1), n as (select month, p / (select avg(p) from f) as factor from f)
select i as step, cast((3 + i) % 12 + 1 as int) as month, {r("factor * (select max_by(close, date) from market)", 'forward', 4)} from range(12) t(i) join n on n.month = (3 + i) % 12 + 1""")
def forward_curve(spark, sf):
    return rounded(valuation.forward_curve(fr.market(spark, sf), 4), 4)


@query("ratchet_factors", f"select event_id, cast(case when value / 100 > 0.9 then 0.5 when value / 100 > 0.7 then 0.8 else 1 end as double) as inject, cast(case when value / 100 < 0.15 then 0.5 when value / 100 < 0.3 then 0.8 else 1 end as double) as withdraw from events")
def ratchet_factors(spark, sf):
    fill = F.col("value") / 100
    return fr.read(spark, sf, "events").select("event_id", valuation.ratchet(fill, True).alias("inject"), valuation.ratchet(fill, False).alias("withdraw"))


@query("storage_intrinsic")
def storage_intrinsic(spark, sf):
    curve = valuation.forward_curve(fr.market(spark, sf), 4, spot=3.0).withColumn("facility", F.lit("cavern"))
    return valuation.intrinsic_by_date(curve, valuation.Asset.salt_cavern(), 1.0)


def _markets(spark, sf):
    """symbol, s0, kappa, theta, sigma fitted to each symbol's closes in units of 50,000."""
    b = fr.bars(spark, sf).withColumn("close", F.col("close") / 50_000)
    last = b.groupBy("symbol").agg(F.max_by("close", "date").alias("s0"))
    return valuation.ou_calibrate(b, ("symbol",)).join(last, "symbol").select("symbol", "s0", "kappa", "theta", "sigma")


@query("storage_simulated")
def storage_simulated(spark, sf):
    """Value of a store on every simulated path of every symbol's calibrated price."""
    return valuation.simulated_values(_markets(spark, sf), valuation.Asset.salt_cavern(), 5.0)


@query("storage_greeks")
def storage_greeks(spark, sf):
    return valuation.simulated_greeks(_markets(spark, sf), valuation.Asset.salt_cavern(), 5.0, paths=3000)


@query("rolling_intrinsic")
def rolling_intrinsic(spark, sf):
    b = fr.bars(spark, sf).withColumn("close", F.col("close") / 50_000)
    return valuation.rolling_intrinsic(b, valuation.Asset.salt_cavern(), 5.0, "symbol")


def _folds(train: str) -> str:
    return ctes("bars") + f""", n as (select symbol, date, row_number() {W} - 1 as i, count(*) over (partition by symbol) as n from bars), f as (select *, unnest(range(0, 5)) as fold from n)
select symbol, date, cast(fold as int) as fold, case when i >= (n // 6) * (fold + 1) then 'test' else 'train' end as role from f where i < {train} or (i >= (n // 6) * (fold + 1) and i < (n // 6) * (fold + 2))"""


@query("walk_forward_folds", _folds("(n // 6) * (fold + 1)"))
def walk_forward_folds(spark, sf):
    return ml.walk_forward(fr.bars(spark, sf).select("symbol", "date"), 5, ("symbol",))


@query("purged_folds", _folds("(n // 6) * (fold + 1) - 5"))
def purged_folds(spark, sf):
    return ml.purged(fr.bars(spark, sf).select("symbol", "date"), 5, 5, keys=("symbol",))


@query("expanding_folds", ctes("market") + """, n as (select date, row_number() over (order by date) - 1 as i, count(*) over () as n from market), f as (select *, unnest(range(0, 1 + (n - 731) // 90)) as fold from n where n > 730)
select date, fold, case when i >= 730 + 90 * fold then 'test' else 'train' end as role from f where i < 730 + 90 * (fold + 1)""")
def expanding_folds(spark, sf):
    return ml.expanding(fr.market(spark, sf).select("date"), 730, 90)


@query("betting_thresholds", f"with b as (select value / 100 as p, event_id % 2 as a from events), t as (select cast(unnest([0.5, 0.6, 0.7, 0.8, 0.9]) as double) as threshold) select threshold, count(*) filter (where greatest(p, 1 - p) >= threshold) as n_bets, {r('avg((greatest(p, 1 - p) >= threshold)::int)', 'coverage')}, {r('avg(((p >= 0.5)::int = a)::int) filter (where greatest(p, 1 - p) >= threshold)', 'hit_rate')} from b, t group by threshold")
def betting_thresholds(spark, sf):
    e = fr.read(spark, sf, "events").select((F.col("value") / 100).alias("p"), (F.col("event_id") % 2).cast("int").alias("a"))
    return rounded(ml.betting(e, "p", "a", [0.5, 0.6, 0.7, 0.8, 0.9]))


@query("edge_slices", ctes("bars") + f", h as (select symbol, cast(year(date) as varchar) as year, (close > lag(close) {W})::int as hit from bars) select symbol, year, count(*) as n, {r('avg(coalesce(hit, 0))', 'accuracy')} from h group by rollup (symbol, year)")
def edge_slices(spark, sf):
    s = Series(["symbol"])
    h = fr.bars(spark, sf).select("symbol", F.year("date").cast("string").alias("year"), flag(s.diff("close") > 0).alias("hit"))
    return rounded(ml.slices(h, ["symbol", "year"]))


_HITS = "h as (select event_type, event_id, ts, value / 100 as p, case when (value >= 50) = (event_id % 2 = 1) then 1 else 0 end as hit from events)"


def _hits(spark, sf):
    v, i = F.col("value"), F.col("event_id")
    return fr.read(spark, sf, "events").select("event_type", "event_id", F.col("ts").alias("date"), (v / 100).alias("p"), flag((v >= 50) == (i % 2 == 1)).alias("hit"), flag(v >= 50).alias("direction"), flag(i % 3 == 0).alias("other"))


@query("confidence_slices", f"with {_HITS}, c as (select hit, case when greatest(p, 1 - p) < 0.55 then 0.5 when greatest(p, 1 - p) < 0.6 then 0.55 when greatest(p, 1 - p) < 0.7 then 0.6 when greatest(p, 1 - p) < 1.01 then 0.7 end as low from h) select cast(low as double) as low, count(*) as n, {r('avg(hit)', 'accuracy')} from c where low is not null group by low")
def confidence_slices(spark, sf):
    return rounded(ml.confidence_slices(_hits(spark, sf), "p", "hit"))


@query("model_agreement", f"""with h as (select value >= 50 as d, event_id % 3 = 0 as e, event_id % 2 = 1 as up from events), k as (select d = e as same, d = up as x, e = up as y from h)
select count(*) as n, count(*) filter (where same) as agree, count(*) filter (where x and y) as both_right, count(*) filter (where not x and not y) as both_wrong, {r('avg(x::int) filter (where same)', 'accuracy_when_agree')} from k""")
def model_agreement(spark, sf):
    h = _hits(spark, sf)
    other = h.select("event_id", F.col("other").alias("direction"), flag(F.col("other") == (F.col("event_id") % 2)).alias("hit"))
    return rounded(ml.agreement(h, other, ("event_id",)))


@query("rolling_accuracy", f"with {_HITS} select event_type, event_id, {r('case when count(*) over k >= 60 then avg(hit) over k end', 'rolling_acc')} from h window k as (partition by event_type order by ts rows 59 preceding)")
def rolling_accuracy(spark, sf):
    return rounded(ml.rolling_accuracy(_hits(spark, sf), ("event_type",)).select("event_type", "event_id", "rolling_acc"))


@query("permutation_test")
def permutation_test(spark, sf):
    e = fr.read(spark, sf, "events")
    return ml.class_permutation_test(e.select("event_id", (F.col("value") > 50).cast("int").alias("a"), (F.col("event_id") % 2).cast("int").alias("p")), "a", "p", on="event_id")


@query("feature_importance")
def feature_importance(spark, sf):
    """What a forest of generation rests on, measured on all days; fitted on the first 2,000 days by region and date."""
    from wattline.operators import boosting
    from wattline.plans.energy import dispatch_features

    g, names = dispatch_features(spark, sf)
    # The bound on what is fitted; the importance is taken over every row.
    first = g.dropna(subset=[*names, "gas_mwh"]).orderBy("region", "date").limit(2000).toPandas()
    forest = boosting.fit(first[list(names)].to_numpy(float), first["gas_mwh"].to_numpy(float), boosting.Boost())
    return ml.permutation_importance(g, list(names), "gas_mwh", forest.predict)


@query("gbt_forecast")
def gbt_forecast(spark, sf):
    s = Series(["symbol"])
    b = fr.bars(spark, sf).select("symbol", "date", s.lag("volume").alias("v1"), s.lag("volume", 2).alias("v2"), F.month("date").cast("double").alias("m"), F.col("volume").alias("target")).dropna()
    parts = ml.validation_tail(b, 0.15, ("symbol",))
    model = ml.boosted_trees("volume", ["v1", "v2", "m"]).train(parts.where("not is_validation"))
    return model.predict(parts.where("is_validation")).select("symbol", "date", "target", "prediction")


@query("experiments")
def experiments(spark, sf):
    s = Series(())
    b = fr.market(spark, sf)
    names = {"r1": s.log_return("close"), "r5": s.log_return("close", 5), "m20": s.mean("close", 20) / F.col("close"), "v20": s.std(F.col("volume"), 20)}
    return rounded(ml.experiments(b.withColumns(names), list(names), "close", ml.linear_models()))


@query("kpi_row", ctes("bars") + f""", x as (select *, close / nullif(lag(close) {W}, 0) - 1 as rt, high - low as rg from bars), y as (select symbol, date, close, rt as c1, close / nullif(lag(close, 30) {W}, 0) - 1 as c30, {roll('avg(rg)', 'rg', 14)} as r14, {roll('stddev_samp(rt)', 'rt', 20)} * sqrt(252.0) as v20 from x)
select symbol, date, close, {r('c1', 'change_1')}, {r('c30', 'change_30')}, {r('r14', 'range_14', 5)}, {r('v20', 'vol_20')} from y qualify row_number() over (partition by symbol order by date desc) = 1""")
def kpi_row(spark, sf):
    return rounded(report.kpis(fr.bars(spark, sf)), range_14=5)


@query("market_snapshot", ctes("bars") + f", l as (select *, row_number() over (partition by symbol order by date desc) as i from bars) select symbol, max(date) as date, max_by(close, date) as close, {r('max_by(close, date) / min_by(close, date) - 1', 'change')} from l where i <= 2 group by symbol")
def market_snapshot(spark, sf):
    return rounded(report.snapshot(fr.bars(spark, sf)))


@query("weather_outlook", ctes("market") + f", l as (select date, close, close - lag(close) over (order by date) as d, row_number() over (order by date desc) as k from market) select {r('avg(close)', 'mean', 5)}, {r('sum(close)', 'total', 4)}, case when avg(d) filter (where k <= 3) > 0 then 'rising' when avg(d) filter (where k <= 3) < 0 then 'falling' else 'flat' end as trend from l where k <= 7")
def weather_outlook(spark, sf):
    return rounded(report.outlook(fr.market(spark, sf), "close"), mean=5, total=4)


@query("forecast_delta", ctes("market") + f", p as (select date, close as a, lag(close) over (order by date) as f from market), l as (select max_by(a, date) as actual, max_by(f, date) as predicted from p) select actual, predicted, {r('predicted / actual - 1', 'delta')}, case when predicted / actual - 1 > 0.02 then 'higher' when predicted / actual - 1 < -0.02 then 'lower' else 'steady' end as view from l")
def forecast_delta(spark, sf):
    m = fr.market(spark, sf).select("date", F.col("close").alias("a"), Series().lag("close").alias("f"))
    return rounded(report.forecast_delta(m, "a", "f"))


@query("briefing_questions", ctes("weekly", "hourly") + """, s as (select (select max_by(level, date) from weekly) as level, (select max_by(m, d) from (select cast(ts as date) as d, avg(mw) as m from hourly group by 1)) as tavg)
select unnest(['supply', 'demand', 'storage outlook', 'price drivers']) as question union all select 'storage level' from s where level is not null union all select 'extreme weather' from s where tavg < 25 or tavg > 90""")
def briefing_questions(spark, sf):
    """Questions by the last storage level and the last day's mean of the hourly readings."""
    level = fr.weekly(spark, sf).agg(F.max_by("level", "date").alias("level"))
    day = fr.hourly(spark, sf).groupBy(F.to_date("ts").alias("d")).agg(F.avg("mw").alias("m")).agg(F.max_by("m", "d").alias("tavg"))
    # Two frames of one row each.
    return report.questions(level.join(F.broadcast(day)))


@query("var_ladder", ctes("returns") + f", l as (select unnest([0.9, 0.95, 0.975, 0.99, 0.995]) as c), q as (select asset, quantile_cont(ret, [{', '.join(repr(1 - c) for c in (0.9, 0.95, 0.975, 0.99, 0.995))}]) as q from returns group by asset) select asset, cast(c as double) as confidence, {r('-q[list_position([0.9, 0.95, 0.975, 0.99, 0.995], c)]', 'var')} from q, l")
def var_ladder(spark, sf):
    return rounded(report.ladder(fr.returns(spark, sf), by=("asset",)))


@query("signal_markers", ctes("bars") + f", s as (select symbol, date, case when close > 200000 then 1 else -1 end as signal from bars) select symbol, date, signal from (select *, lag(signal) {W} as p from s) where p is null or p <> signal")
def signal_markers(spark, sf):
    b = fr.bars(spark, sf).select("symbol", "date", F.when(F.col("close") > 200000, 1).otherwise(-1).alias("signal"))
    return report.markers(b, keys=("symbol",))


@query("rebased_equity", ctes("bars") + f" select symbol, date, {r(f'close / first_value(close) {W} * 100', 'rebased')}, {r(f'(close / max(close) over (partition by symbol order by date rows unbounded preceding) - 1) * 100', 'drawdown_pct')} from bars")
def rebased_equity(spark, sf):
    return rounded(report.rebased(fr.bars(spark, sf), "close", ("symbol",)).select("symbol", "date", "rebased", "drawdown_pct"))
