"""Market queries: bars, indicators, rolling windows, alignment."""

from __future__ import annotations

from pyspark.sql import functions as F

from wattline.functions.ts import HOLIDAYS, Series, clip, cyclical, ewm, finite, flag, is_holiday, number, span
from wattline.operators import align
from wattline.operators.technical import Technical
from wattline.plans import frames as fr
from wattline.plans.frames import ctes, r, rounded
from wattline.plans.registry import query

W = "over (partition by symbol order by date)"


def w(n: int, by: str = "symbol") -> str:
    return f"over (partition by {by} order by date rows between {n - 1} preceding and current row)"


def roll(agg: str, x: str, n: int, by: str = "symbol", need: int | None = None) -> str:
    return f"case when count({x}) {w(n, by)} >= {need or n} then {agg} {w(n, by)} end"


@query("bars_daily", ctes("bars") + " select * from bars")
def bars_daily(spark, sf):
    return fr.bars(spark, sf)


@query("sma_indicators", ctes("bars") + f""", s as (select *, {", ".join(f"{roll('avg(close)', 'close', n)} as m{n}" for n in (10, 20, 50))} from bars)
select symbol, date, {", ".join(f"{r(f'm{n}', f'sma_{n}', 4)}, {r(f'(close - m{n}) / nullif(m{n}, 0)', f'sma_{n}_dist')}" for n in (10, 20, 50))} from s""")
def sma_indicators(spark, sf):
    t = Technical()
    return rounded(fr.bars(spark, sf).select("symbol", "date", *[c.alias(n) for n, c in t.sma().items()]), sma_10=4, sma_20=4, sma_50=4)


@query("return_features", ctes("bars") + f""" select symbol, date, {", ".join(r(f'close / nullif(lag(close, {n}) {W}, 0) - 1', f'return_{n}d') for n in (1, 2, 5, 10, 20))},
{r(f'ln(close / nullif(lag(close) {W}, 0))', 'log_return_1d')} from bars""")
def return_features(spark, sf):
    t = Technical()
    return rounded(fr.bars(spark, sf).select("symbol", "date", *[c.alias(n) for n, c in t.returns().items()]))


_TECH = ["rsi", "bb_middle", "bb_upper", "bb_lower", "bb_pct", "bb_width", "atr", "atr_pct", "stoch_k", "stoch_d", "realized_vol_20d", "volume_sma_20", "volume_ratio", "obv"]


@query("technical_windows", ctes("bars") + f""", a as (select *, close - lag(close) {W} as d, lag(close) {W} as pc,
  ln(close / nullif(lag(close) {W}, 0)) as lr,
  {roll('avg(close)', 'close', 20)} as mid, {roll('stddev_samp(close)', 'close', 20)} as sd,
  {roll('min(low)', 'low', 14)} as lo14, {roll('max(high)', 'high', 14)} as hi14 from bars),
b as (select *, greatest(d, 0.0) as gain, greatest(-d, 0.0) as loss, greatest(high - low, coalesce(abs(high - pc), 0), coalesce(abs(low - pc), 0)) as tr,
  100 * (close - lo14) / nullif(hi14 - lo14, 0) as k, coalesce(sign(d) * volume, 0) as flow from a),
c as (select *, {roll('avg(gain)', 'd', 14)} as ag, {roll('avg(loss)', 'd', 14)} as al, {roll('avg(tr)', 'tr', 14)} as atr0, {roll('avg(k)', 'k', 3)} as kd,
  {roll('stddev_samp(lr)', 'lr', 20)} * sqrt(252.0) as rv, {roll('avg(volume)', 'volume', 20)} as vs, sum(flow) over (partition by symbol order by date rows unbounded preceding) as ob from b)
select symbol, date, {r('100 - 100 / (1 + ag / nullif(al, 0))', 'rsi')}, {r('mid', 'bb_middle', 4)}, {r('mid + 2 * sd', 'bb_upper', 4)}, {r('mid - 2 * sd', 'bb_lower', 4)},
{r('(close - (mid - 2 * sd)) / nullif(4 * sd, 0)', 'bb_pct')}, {r('4 * sd / nullif(mid, 0)', 'bb_width')}, {r('atr0', 'atr', 4)}, {r('atr0 / nullif(close, 0)', 'atr_pct')},
{r('k', 'stoch_k')}, {r('kd', 'stoch_d')}, {r('rv', 'realized_vol_20d')}, {r('vs', 'volume_sma_20')}, {r('volume / nullif(vs, 0)', 'volume_ratio')}, {r('ob', 'obv')} from c""")
def technical_windows(spark, sf):
    return rounded(Technical().windows(fr.bars(spark, sf)).select("symbol", "date", *_TECH), bb_middle=4, bb_upper=4, bb_lower=4, atr=4)


def _ew(x: str, alpha: float, by: str = "symbol", src: str = "") -> str:
    return f"list_reduce(list({x}) over (partition by {by} order by date rows unbounded preceding), lambda a, b: {alpha!r} * b + {1 - alpha!r} * a)"


@query("ema_macd", ctes("bars") + f""", e as (select *, {_ew('close', span(8))} as e8, {_ew('close', span(200))} as e200, {_ew('close', span(12))} as f, {_ew('close', span(26))} as g from bars),
m as (select *, f - g as macd0 from e), n as (select *, {_ew('macd0', span(9))} as sig from m)
select symbol, date, {r('e8', 'ema_8', 4)}, {r('(close - e200) / nullif(e200, 0)', 'ema_200_dist')}, {r('macd0', 'macd', 4)}, {r('sig', 'macd_signal_line', 4)}, {r('macd0 - sig', 'macd_hist', 4)} from n""")
def ema_macd(spark, sf):
    out = Technical(ema=(8, 200)).with_ema(fr.bars(spark, sf))
    return rounded(out.select("symbol", "date", "ema_8", "ema_200_dist", "macd", "macd_signal_line", "macd_hist"), ema_8=4, macd=4, macd_signal_line=4, macd_hist=4)


@query("ewm_adjusted", ctes("bars") + f""", e as (select *, list(close) over (partition by symbol order by date rows unbounded preceding) as l from bars)
select symbol, date, {r("list_sum(list_transform(l, lambda x, i: x * pow(0.9, len(l) - i))) / list_sum(list_transform(l, lambda x, i: pow(0.9, len(l) - i)))", 'ewm', 4)} from e""")
def ewm_adjusted(spark, sf):
    out = ewm(fr.bars(spark, sf), ["symbol"], ["date"], {"ewm": ("close", 0.1, True)})
    return rounded(out.select("symbol", "date", "ewm"), 4)


@query("rolling_stats", ctes("bars") + f""" select symbol, date, {r(roll('stddev_samp(close)', 'close', 21), 'std_21', 4)}, {r(roll('stddev_pop(close)', 'close', 21), 'pop_21', 4)},
{r(roll('sum(volume)', 'volume', 7), 'sum_7')}, {r(roll('max(close)', 'close', 252, need=60), 'max_252', 4)}, {r(roll('quantile_cont(close, 0.9)', 'close', 60), 'q90_60', 4)},
{r(f'(close - ({roll("avg(close)", "close", 60)})) / nullif({roll("stddev_samp(close)", "close", 60)}, 0)', 'z_60')},
{r(f'(close - ({roll("min(close)", "close", 52)})) / nullif(({roll("max(close)", "close", 52)}) - ({roll("min(close)", "close", 52)}), 0)', 'pos_52')} from bars""")
def rolling_stats(spark, sf):
    s = Series(["symbol"])
    return rounded(fr.bars(spark, sf).select("symbol", "date", s.std("close", 21).alias("std_21"), s.std("close", 21, ddof=0).alias("pop_21"), s.sum("volume", 7).alias("sum_7"), s.max("close", 252, 60).alias("max_252"), s.quantile("close", 0.9, 60).alias("q90_60"), s.zscore("close", 60).alias("z_60"), s.position("close", 52).alias("pos_52")), std_21=4, pop_21=4, max_252=4, q90_60=4)


@query("rolling_corr", ctes("bars") + f""" select symbol, date, {r(f"case when count(close) {w(60)} >= 60 then covar_samp(close, volume) {w(60)} / nullif(stddev_samp(close) {w(60)} * stddev_samp(volume) {w(60)}, 0) end", 'corr_60')} from bars""")
def rolling_corr(spark, sf):
    return rounded(fr.bars(spark, sf).select("symbol", "date", Series(["symbol"]).corr("close", "volume", 60).alias("corr_60")))


@query("pct_rank_252", ctes("bars") + f""", l as (select symbol, date, close, list(close) {w(252)} as v from bars)
select symbol, date, case when len(v) >= 252 then {r('(len(list_filter(v, lambda x: x < close)) + (len(list_filter(v, lambda x: x = close)) + 1) / 2.0) / len(v)', 'x')[:-len(' as x')]} end as pct_rank from l""")
def pct_rank_252(spark, sf):
    return rounded(fr.bars(spark, sf).select("symbol", "date", Series(["symbol"]).pct_rank("close", 252).alias("pct_rank")))


@query("expanding_stats", ctes("bars") + f""" select symbol, date, {r('quantile_cont(close, 0.75) over (partition by symbol order by date rows unbounded preceding)', 'q75', 4)},
{r("max(close) over (partition by symbol order by date rows unbounded preceding)", 'peak', 4)}, {r("close / max(close) over (partition by symbol order by date rows unbounded preceding) - 1", 'drawdown')},
{r("sum(volume) over (partition by symbol order by date rows unbounded preceding)", 'cum_volume')} from bars""")
def expanding_stats(spark, sf):
    s = Series(["symbol"])
    return rounded(fr.bars(spark, sf).select("symbol", "date", F.percentile("close", 0.75).over(s.so_far).alias("q75"), s.cummax("close").alias("peak"), (F.col("close") / s.cummax("close") - 1).alias("drawdown"), s.cumsum("volume").alias("cum_volume")), q75=4, peak=4)


@query("shift_diff", ctes("bars") + f""" select symbol, date, {r(f'lag(close, 2) {W}', 'lag_2', 4)}, {r(f'lead(close) {W}', 'lead_1', 4)}, {r(f'close - lag(close, 5) {W}', 'diff_5', 4)} from bars""")
def shift_diff(spark, sf):
    s = Series(["symbol"])
    return rounded(fr.bars(spark, sf).select("symbol", "date", s.lag("close", 2).alias("lag_2"), s.lag("close", -1).alias("lead_1"), s.diff("close", 5).alias("diff_5")), 4)


@query("asof_weekly_to_daily", ctes("market", "weekly") + " select m.date, m.close, k.level from market m asof left join weekly k on m.date >= k.date")
def asof_weekly_to_daily(spark, sf):
    return align.asof_join(fr.market(spark, sf).select("date", "close"), fr.weekly(spark, sf))


@query("gap_fill_daily", ctes("market") + """, d as (select unnest(generate_series((select min(date) from market), (select max(date) from market), interval 1 day))::date as date)
select d.date, last_value(close ignore nulls) over (order by d.date rows unbounded preceding) as close from d left join market m on d.date = m.date""")
def gap_fill_daily(spark, sf):
    return align.upsample_ffill(fr.market(spark, sf).select("date", "close"))


@query("ffill_limit_bfill", ctes("market") + """, d as (select unnest(generate_series((select min(date) from market), (select max(date) from market), interval 1 day))::date as date),
j as (select d.date, close from d left join market m on d.date = m.date)
select date, last_value(close ignore nulls) over (order by date rows between 2 preceding and current row) as ffill_2, first_value(close ignore nulls) over (order by date rows between current row and unbounded following) as bfill from j""")
def ffill_limit_bfill(spark, sf):
    m, s = fr.market(spark, sf).select("date", "close"), Series()
    j = align.spine(m).join(m, "date", "left")
    return j.select("date", s.ffill("close", 2).alias("ffill_2"), s.bfill("close").alias("bfill"))


@query("reindex_ffill", ctes("market", "weekly") + " select m.date, m.close, last_value(k.level ignore nulls) over (order by m.date rows unbounded preceding) as level from market m left join weekly k on m.date = k.date")
def reindex_ffill(spark, sf):
    return align.reindex_ffill(fr.market(spark, sf).select("date", "close"), fr.weekly(spark, sf))


@query("resample_hourly_daily", ctes("hourly") + f""" select region, cast(ts as date) as date, {r('sum(mw)', 'total', 4)}, {r('max(mw)', 'peak', 4)}, {r('min(mw)', 'low', 4)}, {r('avg(mw)', 'mean', 8)}, {r('stddev_samp(mw)', 'std', 8)}, count(*) as n from hourly group by region, cast(ts as date)""")
def resample_hourly_daily(spark, sf):
    return rounded(align.resample_daily(fr.hourly(spark, sf), "mw", by=("region",)), 4, mean=8, std=8)


@query("resample_monthly", ctes("bars") + f""" select symbol, cast(date_trunc('month', date) as date) as date, {r('sum(volume)', 'volume')}, {r('avg(close)', 'mean')} from bars group by all""")
def resample_monthly(spark, sf):
    return rounded(align.resample(fr.bars(spark, sf), "month", {"volume": F.sum("volume"), "mean": F.avg("close")}, by=("symbol",)))


@query("daily_ramp", ctes("hourly") + f""" select region, cast(ts as date) as date, {r('max(step)', 'ramp', 4)} from (select *, abs(mw - lag(mw) over (partition by region order by ts)) as step from hourly) group by region, cast(ts as date)""")
def daily_ramp(spark, sf):
    return rounded(align.daily_ramp(fr.hourly(spark, sf), "mw", by=("region",)), 4)


@query("peak_offpeak", ctes("hourly") + f""" select region, cast(ts as date) as date, {r('avg(mw) filter (where hour(ts) between 7 and 22)', 'peak_mean', 8)}, {r('avg(mw) filter (where hour(ts) not between 7 and 22)', 'offpeak_mean', 8)} from hourly group by region, cast(ts as date)""")
def peak_offpeak(spark, sf):
    return rounded(align.peak_offpeak(fr.hourly(spark, sf), "mw", by=("region",)), 8)


@query("stride_rows", ctes("bars") + f" select symbol, date, close from (select *, row_number() {W} as i from bars) where (i - 1) % 5 = 0")
def stride_rows(spark, sf):
    return align.stride(fr.bars(spark, sf).select("symbol", "date", "close"), 5, by=("symbol",))


@query("latest_rows", ctes("bars") + " select symbol, date, close from bars qualify row_number() over (partition by symbol order by date desc) <= 10")
def latest_rows(spark, sf):
    return align.latest(fr.bars(spark, sf).select("symbol", "date", "close"), 10, by=("symbol",))


@query("lookback_90d", ctes("market") + " select date, close from market where date >= (select max(date) from market) - 90")
def lookback_90d(spark, sf):
    return align.lookback(fr.market(spark, sf).select("date", "close"), 90)


@query("dedup_keep_last", "select user_id, event_type, event_id, value from events qualify row_number() over (partition by user_id, event_type order by ts desc, event_id desc) = 1")
def dedup_keep_last(spark, sf):
    return align.dedup_last(fr.read(spark, sf, "events"), ["user_id", "event_type"], [F.col("ts"), F.col("event_id")]).select("user_id", "event_type", "event_id", "value")


@query("days_with_every_symbol", ctes("bars") + " select symbol, date, close from bars where date in (select date from bars group by date having count(distinct symbol) = (select count(distinct symbol) from bars))")
def days_with_every_symbol(spark, sf):
    return align.every_key(fr.bars(spark, sf).select("symbol", "date", "close"), "symbol")


@query("outlier_filter", ctes("hourly") + """, q as (select region, quantile_cont(mw, 0.01) as l, quantile_cont(mw, 0.99) as h from hourly group by region)
select h0.region, ts, round(mw, 4) + 0.0 as mw from hourly h0 join q on q.region = h0.region where mw between l - 0.1 * (h - l) and h + 0.1 * (h - l)""")
def outlier_filter(spark, sf):
    return rounded(align.outliers_removed(fr.hourly(spark, sf), "mw", ("region",), 0.1).select("region", "ts", "mw"), 4)


@query("streaks", ctes("bars") + f""", a as (select symbol, date, coalesce(close > lag(close) {W}, false) as up from bars),
g as (select *, sum(case when up then 0 else 1 end) over (partition by symbol order by date rows unbounded preceding) as g from a)
select symbol, date, cast(sum(up::int) over (partition by symbol, g order by date rows unbounded preceding) as bigint) as streak from g""")
def streaks(spark, sf):
    s = Series(["symbol"])
    b = fr.bars(spark, sf).select("symbol", "date", (s.diff("close") > 0).alias("up"))
    return align.streaks(b, F.col("up"), by=("symbol",)).select("symbol", "date", "streak")


@query("exact_duplicates", "select any_value(lang) as lang, count(*) as n, min(doc_id) as first_id from documents group by text having count(*) > 1")
def exact_duplicates(spark, sf):
    """``lang`` is that of the first document with one, which ``any_value`` meets first."""
    d = fr.read(spark, sf, "documents")
    lang = F.min_by("lang", F.when(F.col("lang").isNotNull(), F.col("doc_id")))
    return d.groupBy(F.sha2("text", 256).alias("h")).agg(lang.alias("lang"), F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("first_id")).where("n > 1").drop("h")


@query("seasonal_calendar", ctes("market") + f""" select date, isodow(date) - 1 as dow, dayofyear(date) as doy, month(date) as month, quarter(date) as quarter, weekofyear(date) as week,
cast(last_day(date) = date as int) as month_end, cast(strftime(date, '%m-%d') in {HOLIDAYS} as int) as holiday,
cast(month(date) in (11, 12, 1, 2, 3) as int) as winter, cast(isodow(date) = 4 as int) as storage_day,
{r('sin(2 * pi() * month(date) / 12)', 'month_sin')}, {r('cos(2 * pi() * dayofyear(date) / 365.25)', 'doy_cos')}, {r('sin(2 * pi() * 2 * dayofyear(date) / 365.25)', 'doy_sin_2')} from market""")
def seasonal_calendar(spark, sf):
    d = F.col("date")
    m = fr.market(spark, sf).select("date")
    out = m.select(
        "date", F.weekday(d).cast("long").alias("dow"), F.dayofyear(d).cast("long").alias("doy"), F.month(d).cast("long").alias("month"), F.quarter(d).cast("long").alias("quarter"), F.weekofyear(d).cast("long").alias("week"),
        flag(F.last_day(d) == d).alias("month_end"), is_holiday(d).alias("holiday"), flag(F.month(d).isin(11, 12, 1, 2, 3)).alias("winter"), flag(F.weekday(d) == 3).alias("storage_day"),
        cyclical(F.month(d), 12)[0].alias("month_sin"), cyclical(F.dayofyear(d), 365.25)[1].alias("doy_cos"), cyclical(F.dayofyear(d), 365.25, 2)[0].alias("doy_sin_2"),
    )
    return rounded(out)


@query("clip_coerce_flags", "select event_id, greatest(least(value, 80.0), 20.0) as clipped, cast(value > 50 as int) as high, try_cast(json_extract_string(props, '$.k') as double) as k from events")
def clip_coerce_flags(spark, sf):
    e = fr.read(spark, sf, "events")
    return e.select("event_id", clip("value", 20.0, 80.0).alias("clipped"), flag(F.col("value") > 50).alias("high"), finite(number(F.get_json_object("props", "$.k"))).alias("k"))


_CROSS = ctes("bars") + f""", s as (select symbol, date, close, {roll('avg(close)', 'close', 20)} as a, {roll('avg(close)', 'close', 50)} as b from bars),
g as (select *, case when coalesce(a > b, false) then 1 else -1 end as signal, least(greatest(coalesce(close / nullif(lag(close) {W}, 0) - 1, 0), -0.05), 0.05) as ret from s),
p as (select *, coalesce(lag(signal) {W}, 0) as position from g),
c as (select *, abs(position - coalesce(lag(position) {W}, 0)) * 0.0007 as cost from p),
e as (select *, position * ret - cost as net from c),
q as (select *, product(1 + net) over (partition by symbol order by date rows unbounded preceding) as equity from e)
select symbol, date, cast(signal as int) as signal, cast(position as int) as position, {r('net', 'net')}, {r('equity', 'equity')},
{r('equity / greatest(1.0, max(equity) over (partition by symbol order by date rows unbounded preceding)) - 1', 'drawdown')} from q"""


@query("sma_cross_backtest", _CROSS)
def sma_cross_backtest(spark, sf):
    """Moving-average cross, one-bar lag, 7 bps a unit of turnover, equity and drawdown.

    Daily moves are limited to 5 percent, since the bars are synthetic."""
    s = Series(["symbol"])
    b = fr.bars(spark, sf).select("symbol", "date", "close", s.mean("close", 20).alias("a"), s.mean("close", 50).alias("b"), clip(F.coalesce(s.pct("close"), F.lit(0.0)), -0.05, 0.05).alias("ret"))
    b = b.withColumn("signal", 2 * flag(F.col("a") > F.col("b")) - 1)
    b = b.withColumn("position", F.coalesce(s.lag("signal"), F.lit(0)))
    cost = F.abs(F.col("position") - F.coalesce(s.lag("position"), F.lit(0))) * 0.0007
    b = b.withColumn("net", F.col("position") * F.col("ret") - cost)
    b = b.withColumn("equity", s.cumprod(1 + F.col("net")))
    b = b.withColumn("drawdown", F.col("equity") / F.greatest(F.lit(1.0), s.cummax("equity")) - 1)
    return rounded(b.select("symbol", "date", "signal", "position", "net", "equity", "drawdown"))
