"""Backtest, risk and statistics queries."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from wattline.functions.ts import Series, clip, flag
from wattline.operators import backtest, risk, stats
from wattline.operators.stats import NORMAL
from wattline.plans import frames as fr
from wattline.plans.frames import ctes, r, rounded
from wattline.plans.registry import query

Z95 = NORMAL.inv_cdf(0.05)
A = "over (partition by asset order by date)"
UP = "over (partition by asset order by date rows unbounded preceding)"

#: Moves are limited so that compounded values stay readable on synthetic data.
_SIGNALS = f"""s as (select asset, date, 100.0 * product(1 + least(greatest(ret, -0.03), 0.03)) {UP} as close from returns),
t as (select *, case when close > avg(close) over (partition by asset order by date rows 19 preceding) then 1 else -1 end as signal from s),
p as (select *, coalesce(lag(signal) {A}, 0.0) as position0, coalesce(close / lag(close) {A} - 1, 0.0) as pr from t),
c as (select *, position0 * pr as gross, abs(position0 - coalesce(lag(position0) {A}, 0)) * 0.0007 as cost0, case when abs(position0 - lag(position0) {A}) > 0 then 1 else 0 end as chg from p),
v as (select *, 1e6 * product(1 + gross - cost0) {UP} as v0 from c),
b as (select *, case when (v0 - greatest(1e6, max(v0) {UP})) / greatest(1e6, max(v0) {UP}) < -0.15 then 1 else 0 end as breach from v),
h as (select *, coalesce(max(breach) over (partition by asset order by date rows between unbounded preceding and 1 preceding), 0) = 1 as halted from b),
n as (select *, case when halted then 0.0 else position0 end as position, case when halted then 0.0 else gross - cost0 end as net from h),
e as (select *, 1e6 * product(1 + net) {UP} as value from n),
res as (select *, value / max(value) {UP} - 1 as drawdown from e)"""


def _result(spark, sf):
    s = Series(["asset"])
    base = fr.returns(spark, sf).withColumn("close", 100.0 * s.cumprod(1 + clip("ret", -0.03, 0.03)))
    signal = F.when(F.col("close") > s.mean("close", 20, 1), 1).otherwise(-1)
    return backtest.run(base.withColumn("signal", signal), keys=("asset",))


@query("backtest_engine", ctes("returns") + f", {_SIGNALS} select asset, date, {r('position', 'position')}, {r('net', 'net', 8)}, {r('value', 'value', 3)}, {r('drawdown', 'drawdown')}, halted from res")
def backtest_engine(spark, sf):
    return rounded(_result(spark, sf).select("asset", "date", "position", "net", "value", "drawdown", "halted"), net=8, value=3)


@query("performance_report", ctes("returns") + f""", {_SIGNALS},
u as (select *, value < max(value) {UP} as under, net - 0.05 / 252 as x from res),
g as (select *, sum(case when under then 0 else 1 end) {UP} as g from u),
l as (select asset, max(n) as days from (select asset, g, sum(under::int) as n from g group by all) group by asset)
select g.asset, {r('max_by(value, date) / min_by(value, date) - 1', 'total_return')}, {r('pow(max_by(value, date) / min_by(value, date), 252.0 / count(*)) - 1', 'annualised_return')},
{r('stddev_samp(net) * sqrt(252.0)', 'annualised_volatility')}, {r('avg(x) / stddev_samp(x) * sqrt(252.0)', 'sharpe')}, {r('avg(x) / stddev_samp(x) filter (where x < 0) * sqrt(252.0)', 'sortino')},
{r('min(drawdown)', 'max_drawdown')}, cast(any_value(days) as bigint) as max_drawdown_days, {r('quantile_cont(net, 0.05)', 'var_95')}, {r('quantile_cont(net, 0.01)', 'var_99')}, cast(sum(chg) as bigint) as total_trades,
{r('abs((pow(max_by(value, date) / min_by(value, date), 252.0 / count(*)) - 1) / min(drawdown))', 'calmar')} from g join l on l.asset = g.asset group by g.asset""")
def performance_report(spark, sf):
    return rounded(backtest.report(_result(spark, sf), ("asset",)))


@query("rolling_sharpe", ctes("returns") + f""", {_SIGNALS}, w as (select *, net - 0.05 / 252 as x from res)
select asset, date, {r("case when count(x) over k >= 252 then avg(x) over k / (case when stddev_samp(x) over k > 1e-12 then stddev_samp(x) over k end) * sqrt(252.0) end", 'rolling_sharpe', 5)} from w window k as (partition by asset order by date rows 251 preceding)""")
def rolling_sharpe(spark, sf):
    out = backtest.rolling_sharpe(_result(spark, sf), ("asset",))
    return rounded(out.select("asset", "date", "rolling_sharpe"), 5)


@query("monthly_returns", ctes("returns") + f", {_SIGNALS}, m as (select asset, year(date) as year, month(date) as month, product(1 + net) - 1 as ret from res group by all) select asset, year, " + ", ".join(f'round(any_value(ret) filter (where month = {k}), 6) + 0.0 as "{k}"' for k in range(1, 13)) + " from m group by asset, year")
def monthly_returns(spark, sf):
    return rounded(backtest.monthly_returns(_result(spark, sf), ("asset",)).withColumn("year", F.col("year").cast("long")))


_HOLD = f"""v as (select asset, date, product(1 + least(greatest(ret, -0.03), 0.03)) {UP} as value from returns),
res as (select *, value / max(value) {UP} - 1 as drawdown from v)"""


@query("drawdown_periods", ctes("returns") + f""", {_HOLD}, u as (select *, drawdown < -1e-9 as under, lead(date) {A} as nxt from res),
g as (select *, sum(case when under then 0 else 1 end) {UP} as g from u),
k as (select asset, g, min(date) as start, last(nxt order by date) as "end", min_by(date, {{'a': drawdown, 'b': date}}) as trough, min(drawdown) as d from g where under group by asset, g)
select asset, start, "end", trough, {r('d', 'depth')}, cast("end" - start as int) as days from k where "end" is not null and "end" - start >= 5""")
def drawdown_periods(spark, sf):
    s = Series(["asset"])
    held = fr.returns(spark, sf).withColumn("value", s.cumprod(1 + clip("ret", -0.03, 0.03)))
    held = held.withColumn("drawdown", F.col("value") / s.cummax("value") - 1)
    return rounded(backtest.drawdown_periods(held, ("asset",)))


@query("historical_var", ctes("returns") + f""", q as (select asset, -quantile_cont(ret, 0.05) as v from returns group by asset)
select x.asset, {r('v', 'var')}, {r('-avg(ret) filter (where ret <= -v)', 'cvar')} from returns x join q on q.asset = x.asset group by x.asset, v""")
def historical_var(spark, sf):
    return rounded(risk.historical(fr.returns(spark, sf), 0.95, by=("asset",)))


@query("historical_var_10d", ctes("returns") + f""", m as (select asset, case when count(ret) over w >= 10 then sum(ret) over w end as m from returns window w as (partition by asset order by date rows 9 preceding)),
q as (select asset, -quantile_cont(m, 0.05) as v from m group by asset)
select m.asset, {r('v', 'var')}, {r('-avg(m) filter (where m <= -v)', 'cvar')} from m join q on q.asset = m.asset group by m.asset, v""")
def historical_var_10d(spark, sf):
    return rounded(risk.historical(fr.returns(spark, sf), 0.95, 10, ("asset",)))


@query("normal_var", ctes("returns") + f" select asset, {r(f'-(avg(ret) + {Z95!r} * stddev_pop(ret))', 'var')}, {r(f'-(avg(ret) - stddev_pop(ret) * {NORMAL.pdf(Z95) / 0.05!r})', 'cvar')} from returns group by asset")
def normal_var(spark, sf):
    return rounded(risk.normal(fr.returns(spark, sf), 0.95, by=("asset",)))


@query("cornish_fisher_var", ctes("returns") + f""", m as (select asset, avg(ret) as mu, stddev_pop(ret) as sd, skewness(ret) as s, kurtosis(ret) as k from returns group by asset),
v as (select asset, -(mu + ({Z95!r} + {(Z95**2 - 1) / 6!r} * s + {(Z95**3 - 3 * Z95) / 24!r} * k - {(2 * Z95**3 - 5 * Z95) / 36!r} * s * s) * sd) as v from m)
select asset, {r('v', 'var')}, {r('v * 1.015', 'cvar')} from v""")
def cornish_fisher_var(spark, sf):
    return rounded(risk.cornish_fisher(fr.returns(spark, sf), 0.95, by=("asset",)))


@query("ewma_var", ctes("returns") + f""", k as (select asset, ret, row_number() over (partition by asset order by date desc) - 1 as k, count(*) over (partition by asset) as n from returns),
s as (select asset, sqrt(sum(ret * ret * pow(0.94, k) * case when k = n - 1 then 1 else 0.06 end)) as sd from k group by asset)
select asset, {r(f'{-Z95!r} * sd', 'var')}, {r(f'sd * {NORMAL.pdf(Z95) / 0.05!r}', 'cvar')} from s""")
def ewma_var(spark, sf):
    return rounded(risk.ewma(fr.returns(spark, sf), 0.95, by=("asset",)))


_W = {"A": 0.5, "N": 0.3, "R": 0.2}


@query("component_var", ctes("returns") + f""", h as (select *, cast(case asset when 'A' then 0.5 when 'N' then 0.3 when 'R' then 0.2 end as double) as w from returns),
p as (select date, sum(w * ret) as p from h group by date having count(*) = 3), t as (select stddev_samp(p) as sd from p)
select asset, w, {r('covar_samp(ret, p) / (any_value(sd) * any_value(sd))', 'beta')}, {r(f'w * covar_samp(ret, p) / any_value(sd) * {-Z95!r}', 'component_var')}, {r(f'any_value(sd) * {-Z95!r}', 'portfolio_var')}
from h join p on p.date = h.date, t group by asset, w""")
def component_var(spark, sf):
    return rounded(risk.component(fr.returns(spark, sf), _W))


@query("tail_statistics", ctes("returns") + f""", v as (select *, product(1 + ret) {UP} as v, row_number() over (partition by asset order by ret) as k from returns), d as (select *, v / max(v) {UP} - 1 as dd from v),
m as (select asset, count(*) as n, avg(ret) as mu from returns group by asset),
g as (select x.asset, any_value(n) as n, avg(pow(ret - mu, 3)) / pow(avg(pow(ret - mu, 2)), 1.5) as g1, avg(pow(ret - mu, 4)) / pow(avg(pow(ret - mu, 2)), 2) - 3 as g2 from returns x join m on m.asset = x.asset group by x.asset)
select d.asset, {r('avg(ret)', 'mean_daily')}, {r('stddev_pop(ret)', 'std_daily')}, {r('stddev_pop(ret) * sqrt(252.0)', 'annualized_vol')}, {r('skewness(ret)', 'skewness')}, {r('kurtosis(ret)', 'excess_kurtosis')},
{r('min(ret)', 'min_daily_return')}, {r('max(ret)', 'max_daily_return')}, {r('avg(ret) filter (where k <= 5)', 'worst_5_avg')},
{r('any_value(n / 6.0 * (g1 * g1 + g2 * g2 / 4))', 'jarque_bera_stat', 4)}, {r('any_value(exp(-n / 12.0 * (g1 * g1 + g2 * g2 / 4)))', 'jarque_bera_pval')}, {r('avg((ret < 0)::int) * 100', 'pct_negative_days')}, {r('min(dd)', 'max_drawdown')}
from d join g on g.asset = d.asset group by d.asset""")
def tail_statistics(spark, sf):
    return rounded(risk.tail_statistics(fr.returns(spark, sf), ("asset",)), jarque_bera_stat=4)


@query("rolling_var", ctes("returns") + f" select asset, date, {r('case when count(ret) over w >= 60 then -quantile_cont(ret, 0.05) over w end', 'var')} from returns window w as (partition by asset order by date rows 251 preceding)")
def rolling_var(spark, sf):
    return rounded(risk.rolling_var(fr.returns(spark, sf), 252, 0.95, 60, ("asset",)).select("asset", "date", "var"))


@query("kupiec_test", ctes("returns") + f""", v as (select asset, date, ret, case when count(ret) over w >= 60 then -quantile_cont(ret, 0.05) over w end as var from returns window w as (partition by asset order by date rows 251 preceding)),
k as (select asset, count(*) as n, count(*) filter (where ret < -var) as exceeded from v where var is not null group by asset), x as (select *, exceeded / n as rate from k),
y as (select *, case when rate > 0 and rate < 1 then -2 * (exceeded * ln({1 - 0.95!r} / rate) + (n - exceeded) * ln({1 - (1 - 0.95)!r} / (1 - rate))) else 0 end as lr from x)
select asset, n, exceeded, {r('rate', 'rate')}, {r('lr', 'lr')}, {r('case when lr <= 0 then 1.0 else greatest(0.0, 1 - exp(-lr / 2) * list_sum(list_transform(range(0, 201), lambda k: exp((2 * k + 1) * ln(sqrt(lr / 2)) - lgamma(k + 1.5))))) end', 'p_value')}, lr < 3.841458820694124 as accepted from y""")
def kupiec_test(spark, sf):
    return rounded(risk.kupiec(risk.rolling_var(fr.returns(spark, sf), 252, 0.95, 60, ("asset",)), 0.95, ("asset",)))


_POS = "select 'b' || cast(n_nationkey as varchar) as asset, cast(1000 * (n_nationkey - 10) as double) as notional, case n_regionkey when 0 then 'natural_gas' when 1 then 'power' when 2 then 'crude_oil' when 3 then 'renewables' end as factor from nation"
_SHOCKS = " union all ".join(f"select '{s}' as scenario, '{f}' as factor, {x} as shock" for s, m in risk.SCENARIOS.items() for f, x in m.items())


def _positions(spark, sf):
    n = fr.read(spark, sf, "nation")
    key = F.col("n_regionkey")
    factor = F.when(key == 0, "natural_gas").when(key == 1, "power").when(key == 2, "crude_oil").when(key == 3, "renewables")
    return n.select(F.concat(F.lit("b"), F.col("n_nationkey").cast("string")).alias("asset"), (1000.0 * (F.col("n_nationkey") - 10)).alias("notional"), factor.alias("factor"))


@query("stress_scenarios", f"""with p as ({_POS}), s as ({_SHOCKS}),
j as (select sc.scenario, asset, notional, notional * coalesce(s.shock, case when p.factor is null then (select any_value(shock) from s g where g.scenario = sc.scenario and g.factor = 'natural_gas') end, 0.0) as pnl
  from p cross join (select distinct scenario from s) sc left join s on s.scenario = sc.scenario and s.factor = coalesce(p.factor, 'natural_gas'))
select scenario, {r('sum(pnl)', 'pnl', 4)}, {r('sum(pnl) / sum(abs(notional))', 'pnl_pct')}, min_by(asset, {{'a': pnl, 'b': asset}}) as worst_asset from j group by scenario""")
def stress_scenarios(spark, sf):
    return rounded(risk.stress(_positions(spark, sf), risk.scenario_table(spark)), pnl=4)


@query("reverse_stress", f"select coalesce(factor, 'natural_gas') as factor, {r('sum(notional)', 'exposure')}, {r('-50000.0 / sum(notional)', 'shock')} from ({_POS}) group by 1 having abs(sum(notional)) > 1e-6")
def reverse_stress(spark, sf):
    return rounded(risk.reverse_stress(_positions(spark, sf), 50_000))


@query("risk_dashboard")
def risk_dashboard(spark, sf):
    return risk.dashboard(fr.returns(spark, sf), _W, _positions(spark, sf), risk.scenario_table(spark))


_PNL = "x as (select asset, ret as pnl from returns)"


@query("trade_statistics", ctes("returns") + f""", {_PNL} select asset, count(*) as total_trades, {r('avg((pnl > 0)::int)', 'win_rate')}, {r('sum(pnl) filter (where pnl > 0) / -sum(pnl) filter (where pnl < 0)', 'profit_factor')},
{r('avg(pnl)', 'avg_trade_return', 9)}, {r('max(pnl)', 'best_trade')}, {r('min(pnl)', 'worst_trade')} from x group by asset""")
def trade_statistics(spark, sf):
    return rounded(backtest.trade_statistics(fr.returns(spark, sf), ("asset",), "ret"), avg_trade_return=9)


@query("probability_scores", f"""with e as (select event_type, value / 100 as p, event_id % 2 as a from events), k as (select *, rank() over (partition by event_type order by p) + (count(*) over (partition by event_type, p) - 1) / 2.0 as rk from e),
n as (select event_type, count(*) filter (where a = 1) as up, count(*) filter (where a = 0) as down, sum(rk) filter (where a = 1) as s, avg(-ln(case when a = 1 then least(greatest(p, 1e-15), 1 - 1e-15) else 1 - least(greatest(p, 1e-15), 1 - 1e-15) end)) as ll from k group by event_type)
select event_type, {r('(s - up * (up + 1) / 2.0) / (up * down)', 'auc')}, {r('ll', 'log_loss')} from n""")
def probability_scores(spark, sf):
    e = fr.read(spark, sf, "events").select("event_type", (F.col("value") / 100).alias("p"), (F.col("event_id") % 2).alias("a"))
    return rounded(stats.probability_scores(e, "a", "p", ("event_type",)))


@query("var_full_analysis")
def var_full_analysis(spark, sf):
    return risk.full_analysis(risk.portfolio_returns(fr.returns(spark, sf)))


@query("student_t_var")
def student_t_var(spark, sf):
    return risk.student_t(fr.returns(spark, sf), by=("asset",))


@query("limits", ctes("bars") + f""" select symbol, date, {r('greatest(-0.2, least(0.2, close / 1e6))', 'capped')}, {r('close - 2 * 100', 'stop', 4)}, {r('close + 4 * 100', 'target', 4)},
max(case when close / greatest(1.0, max_close) - 1 < -0.15 then 1 else 0 end) over (partition by symbol order by date rows unbounded preceding) = 1 as halted
from (select *, max(close) over (partition by symbol order by date rows unbounded preceding) as max_close from bars)""")
def limits(spark, sf):
    l = risk.Limits()
    b = l.halted(fr.bars(spark, sf), "close", ("symbol",))
    one, atr = F.lit(1), F.lit(100.0)
    return rounded(b.select("symbol", "date", l.cap(F.col("close") / 1e6).alias("capped"), l.stop("close", atr, one).alias("stop"), l.target("close", atr, one).alias("target"), "halted"), stop=4, target=4)


@query("covariance_matrix", ctes("returns") + f" select x.asset as a, y.asset as b, {r('covar_samp(x.ret, y.ret)', 'cov', 8)}, {r('covar_samp(x.ret, y.ret) / nullif(stddev_samp(x.ret) * stddev_samp(y.ret), 0)', 'corr')}, count(*) as n from returns x join returns y on x.date = y.date group by all")
def covariance_matrix(spark, sf):
    return rounded(stats.pairwise(fr.returns(spark, sf), "asset", "date", "ret"), cov=8)


@query("spearman_corr", ctes("bars") + f""", k as (select symbol, rank() over (partition by symbol order by close) + (count(*) over (partition by symbol, close) - 1) / 2.0 as a, rank() over (partition by symbol order by volume) + (count(*) over (partition by symbol, volume) - 1) / 2.0 as b from bars)
select symbol, {r('corr(a, b)', 'spearman')} from k group by symbol""")
def spearman_corr(spark, sf):
    return rounded(stats.spearman(fr.bars(spark, sf), "close", "volume", ("symbol",)))


@query("welch_t_test", ctes("returns") + f""", g as (select avg(ret) filter (where month(date) in (12,1,2)) as ma, var_samp(ret) filter (where month(date) in (12,1,2)) / count(ret) filter (where month(date) in (12,1,2)) as va, count(ret) filter (where month(date) in (12,1,2)) as na,
avg(ret) filter (where month(date) not in (12,1,2)) as mb, var_samp(ret) filter (where month(date) not in (12,1,2)) / count(ret) filter (where month(date) not in (12,1,2)) as vb, count(ret) filter (where month(date) not in (12,1,2)) as nb from returns)
select {r('ma', 'mean_a')}, {r('mb', 'mean_b')}, {r('(ma - mb) / sqrt(va + vb)', 't')}, {r('(va + vb) * (va + vb) / (va * va / (na - 1) + vb * vb / (nb - 1))', 'dof', 4)} from g""")
def welch_t_test(spark, sf):
    return rounded(stats.welch(fr.returns(spark, sf), "ret", F.month("date").isin(12, 1, 2)), dof=4)


@query("mutual_information", f"""with j as (select event_type as x, hour(ts) // 6 as y, count(*) as n from events group by all), p as (select n / sum(n) over () as p, sum(n) over (partition by x) / sum(n) over () as px, sum(n) over (partition by y) / sum(n) over () as py from j)
select {r('sum(p * log2(p / (px * py)))', 'mutual_information')} from p""")
def mutual_information(spark, sf):
    return rounded(stats.mutual_information(fr.read(spark, sf, "events"), F.col("event_type"), F.floor(F.hour("ts") / 6)))


@query("quantile_buckets", ctes("bars") + """, q as (select quantile_cont(close, [0.2, 0.4, 0.6, 0.8]) as q from bars)
select bucket, count(*) as n, min(close) as low, max(close) as high from (select close, (close > q[1])::int + (close > q[2])::int + (close > q[3])::int + (close > q[4])::int as bucket from bars, q) group by bucket""")
def quantile_buckets(spark, sf):
    return stats.quantile_bucket(fr.bars(spark, sf), "close").groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), F.min("close").alias("low"), F.max("close").alias("high"))


@query("autocorrelation", ctes("returns") + f", l as (select asset, ret, lag(ret) {A} as p from returns) select asset, {r('covar_samp(ret, p) / (stddev_samp(case when p is not null then ret end) * stddev_samp(p))', 'autocorr')} from l group by asset")
def autocorrelation(spark, sf):
    s = Series(["asset"])
    l = fr.returns(spark, sf).select("asset", "ret", s.lag("ret").alias("p")).where("p is not null")
    return rounded(l.groupBy("asset").agg(F.try_divide(F.covar_samp("ret", "p"), F.stddev_samp("ret") * F.stddev_samp("p")).alias("autocorr")))


@query("ols_by_symbol", ctes("bars") + f" select symbol, {r('regr_slope(close, volume)', 'slope', 4)}, {r('regr_intercept(close, volume)', 'intercept', 4)}, {r('regr_r2(close, volume)', 'r2')} from bars group by symbol")
def ols_by_symbol(spark, sf):
    return rounded(fr.bars(spark, sf).groupBy("symbol").agg(F.regr_slope("close", "volume").alias("slope"), F.regr_intercept("close", "volume").alias("intercept"), F.regr_r2("close", "volume").alias("r2")), slope=4, intercept=4)


@query("forecast_scores", ctes("bars") + f""", p as (select symbol, close as a, lag(close) over (partition by symbol order by date) as f from bars), e as (select *, a - f as e from p where f is not null)
select symbol, {r('avg(abs(e))', 'mae', 4)}, {r('sqrt(avg(e * e))', 'rmse', 4)}, {r('1 - sum(e * e) / (var_pop(a) * count(a))', 'r2')}, {r('avg(abs(e / a))', 'mape')} from e group by symbol""")
def forecast_scores(spark, sf):
    s = Series(["symbol"])
    p = fr.bars(spark, sf).select("symbol", F.col("close").alias("a"), s.lag("close").alias("f")).where("f is not null")
    return rounded(stats.scores(p, "a", "f", ("symbol",)), mae=4, rmse=4)


@query("direction_scores", ctes("bars") + f""", p as (select symbol, coalesce(close > lag(close) over w, false)::int as a, coalesce(volume > lag(volume) over w, false)::int as p from bars window w as (partition by symbol order by date))
select symbol, {r('avg((a = p)::int)', 'accuracy')}, {r('sum(a * p) / nullif(sum(p), 0)', 'precision')}, {r('sum(a * p) / nullif(sum(a), 0)', 'recall')}, {r('2 * sum(a * p) / nullif(sum(a) + sum(p), 0)', 'f1')}, {r('avg((a = p)::int) - greatest(avg(a), 1 - avg(a))', 'edge')} from p group by symbol""")
def direction_scores(spark, sf):
    s = Series(["symbol"])
    p = fr.bars(spark, sf).select("symbol", flag(s.diff("close") > 0).alias("a"), flag(s.diff("volume") > 0).alias("p"))
    return rounded(stats.direction_scores(p, "a", "p", ("symbol",)))


@query("rollup_events", "select event_type, cast(ts as date) as date, count(*) as n, round(sum(value), 4) + 0.0 as total from events group by rollup (event_type, cast(ts as date))")
def rollup_events(spark, sf):
    e = fr.read(spark, sf, "events").withColumn("date", F.to_date("ts"))
    return rounded(e.rollup("event_type", "date").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")), 4)


@query("pivot_monthly", ctes("bars") + " select symbol, " + ", ".join(f'round(avg(close) filter (where month(date) = {k}), 6) + 0.0 as "{k}"' for k in range(1, 13)) + " from bars group by symbol")
def pivot_monthly(spark, sf):
    return rounded(fr.bars(spark, sf).withColumn("m", F.month("date")).groupBy("symbol").pivot("m", list(range(1, 13))).agg(F.avg("close")))


@query("histogram", ctes("returns") + " select asset, least(20, greatest(1, floor((ret + 0.5) / 0.05)::int + 1)) as bucket, count(*) as n from returns group by all")
def histogram(spark, sf):
    bucket = clip(F.floor((F.col("ret") + 0.5) / 0.05).cast("int") + 1, 1, 20)
    return fr.returns(spark, sf).groupBy("asset", bucket.alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


@query("set_operations", "select 'both' as side, count(*) as n from (select c_nationkey from customer intersect select s_nationkey from supplier) union all select 'only_customer', count(*) from (select c_nationkey from customer except select s_nationkey from supplier) union all select 'anti', count(*) from customer where c_custkey not in (select o_custkey from orders) union all select 'semi', count(*) from customer where c_custkey in (select o_custkey from orders)")
def set_operations(spark, sf):
    c, s, o = (fr.read(spark, sf, t) for t in ("customer", "supplier", "orders"))
    ck, sk, ok = c.select(F.col("c_nationkey").alias("k")), s.select(F.col("s_nationkey").alias("k")), o.select(F.col("o_custkey").alias("c_custkey"))

    def count(df, name):
        return df.agg(F.lit(name).alias("side"), F.count(F.lit(1)).alias("n"))

    return count(ck.intersect(sk), "both").union(count(ck.exceptAll(sk).distinct().join(sk, "k", "left_anti"), "only_customer")).union(count(c.join(ok, "c_custkey", "left_anti"), "anti")).union(count(c.join(ok, "c_custkey", "left_semi"), "semi"))


@query("last_n_mape", ctes("bars") + f", l as (select *, row_number() over (partition by symbol order by date desc) as i, lag(close) over (partition by symbol order by date) as f from bars) select symbol, {r('avg(abs(close - f) / close)', 'mape_7')} from l where i <= 7 group by symbol")
def last_n_mape(spark, sf):
    from wattline.operators import align

    s = Series(["symbol"])
    p = fr.bars(spark, sf).withColumn("f", s.lag("close"))
    return rounded(align.latest(p, 7, by=("symbol",)).groupBy("symbol").agg(F.avg(F.abs(F.col("close") - F.col("f")) / F.col("close")).alias("mape_7")))
