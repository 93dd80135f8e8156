"""Trading signals: threshold, composite and its parts, sizing, stops."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wattline.functions import blocks
from wattline.functions.ts import Series, clip, col, ewm, expanding_rank, flag, span
from wattline.operators.align import asof_join


def _ladder(x: Column, low, high, below, above) -> Column:
    """``below`` at or under low, ``above`` at or over high, else 0."""
    return F.when(x <= low, float(below)).when(x >= high, float(above)).otherwise(0.0)


def confirm(s: Series, signal, bars: int = 2) -> Column:
    """A side counts only after ``bars`` further bars of it; the first bars are flat."""
    w = s.last(bars + 1)
    least, most = F.min(col(signal)).over(w), F.max(col(signal)).over(w)
    ready = s.rank() > bars
    return F.when(ready & (least == 1), 1).when(ready & (most == -1), -1).otherwise(0)


def threshold_signal(df: DataFrame, keys: list[str], forecast: str, opinion: str | None = None, low: float = -0.015, high: float = 0.015, weight: float = 0.2, smooth: int = 3, bars: int = 2) -> DataFrame:
    """Smoothed forecast, blended with an outside opinion, cut at thresholds, confirmed."""
    s = Series(keys)
    out = ewm(df, keys, ["date"], {"smoothed": (forecast, span(smooth), False)})
    score = F.col("smoothed") if opinion is None else (1 - weight) * F.col("smoothed") + weight * F.coalesce(F.col(opinion), F.lit(0.0))
    out = out.withColumn("score", score).withColumn("raw", F.when(F.col("score") > high, 1).when(F.col("score") < low, -1).otherwise(0))
    return out.withColumn("signal", confirm(s, "raw", bars))


def vol_target_size(vol, target: float = 0.15, fallback: float = 0.30, cap: float = 0.20) -> Column:
    return clip(target / F.coalesce(F.when(col(vol) > 0, col(vol)), F.lit(fallback)), -cap, cap)


def kelly_size(win: float = 0.55, ratio: float = 1.5, share: float = 0.25, cap: float = 0.20) -> float:
    """Share of the Kelly fraction, never under 0: without an edge there is no trade."""
    return min(cap, max(0.0, share * (win - (1 - win) / ratio)))


def fixed_size(share: float = 0.02, cap: float = 0.20) -> float:
    return max(-cap, min(cap, share))


def position_size(signal, vol, method: str = "volatility", win=0.55, ratio=1.5, share: float = 0.25, cap: float = 0.20) -> Column:
    """Signed size of a position: 0 without a signal, else the side of the signal times the
    size of the method (volatility, kelly or fixed), within the cap.  A null win rate or ratio is
    the usual one; a ratio of 0 or less, or no edge, gives 0."""
    s = F.coalesce(col(signal), F.lit(0)).cast("double")
    w = F.coalesce(win if isinstance(win, Column) else F.lit(win), F.lit(0.55))
    b = F.coalesce(ratio if isinstance(ratio, Column) else F.lit(ratio), F.lit(1.5))
    kelly = F.when(b <= 0, 0.0).otherwise(F.greatest(F.lit(0.0), share * (w - (1 - w) / F.when(b > 0, b))))
    size = {"volatility": vol_target_size(vol, cap=cap), "kelly": kelly, "fixed": F.lit(fixed_size(cap=cap))}[method]
    return F.when(s == 0, 0.0).otherwise(clip(F.signum(s) * size, -cap, cap))


def size_series(s: Series, ret, n: int = 20, **options) -> Column:
    return vol_target_size(s.std(ret, n) * F.sqrt(F.lit(252.0)), **options)


#: Rows that the longest window of the composite's parts looks back to.
LONGEST = 200


# --- parts of the composite -----------------------------------------------------


def storage_anomaly(weekly: DataFrame, prices: DataFrame, level: str = "level", years: int = 5, least: int = 3) -> DataFrame:
    """date, storage_z, storage_signal on the price dates; a deficit is bullish.

    z is against the same ISO week of the prior calendar years, 0 with too little
    history, and holds until the next report.  The history is a range frame inside the
    week's partition, not a self join.
    """
    w = weekly.select("date", col(level).alias("level"), F.weekofyear("date").alias("week"), F.year("date").alias("year"))
    h = Window.partitionBy("week").orderBy("year").rangeBetween(-years, -1)
    n, mean, sd = F.count("level").over(h), F.avg("level").over(h), F.stddev_samp("level").over(h)
    z = F.when((n >= least) & (sd > 0), (F.col("level") - mean) / sd).otherwise(0.0)
    daily = asof_join(prices.select("date"), w.select("date", z.alias("storage_z"))).withColumn("storage_z", F.coalesce("storage_z", F.lit(0.0)))
    return daily.withColumn("storage_signal", _ladder(F.col("storage_z"), -1.0, 1.0, 1, -1))


def seasonal_t(prices: DataFrame, price: str = "close", warmup_years: int = 5, least: int = 3) -> DataFrame:
    """date, t, seasonal_signal: side of the t statistic of the calendar month's returns in
    earlier years, if over 1; a month's return is the sum of its daily log returns.

    The first ``warmup_years`` calendar years have no signal.
    """
    s = Series()
    daily = prices.select("date", F.year("date").alias("year"), F.month("date").alias("month"), s.log_return(price).alias("_r"), F.year(F.min("date").over(s.whole)).alias("_first"))
    months = daily.groupBy("year", "month").agg(F.sum("_r").alias("ret"))
    w = Window.partitionBy("month").orderBy("year").rowsBetween(Window.unboundedPreceding, -1)
    n, mean, sd = F.count("ret").over(w), F.avg("ret").over(w), F.stddev_samp("ret").over(w)
    known = months.select("year", "month", F.when((n >= least) & (sd > 0), mean / (sd / F.sqrt(n))).alias("t"))
    out = daily.join(known, ["year", "month"], "left")
    out = out.withColumn("t", F.when(F.col("year") - F.col("_first") >= warmup_years, F.col("t")))
    side = F.when(F.col("t") > 1, 1.0).when(F.col("t") < -1, -1.0).otherwise(0.0)
    return out.select("date", "t", side.alias("seasonal_signal"))


def technical(s: Series, df: DataFrame, price: str = "close", fast: int = 20, slow: int = 60, rsi: int = 14) -> DataFrame:
    """Half average cross, three tenths momentum, a fifth RSI brake."""
    d = s.diff(price)
    out = df.withColumns({"_up": F.when(d.isNotNull(), F.greatest(d, F.lit(0.0))), "_dn": F.when(d.isNotNull(), F.greatest(-d, F.lit(0.0)))})
    a, b, mom = s.mean(price, fast), s.mean(price, slow), s.pct(price, 20)
    loss = s.mean("_dn", rsi)
    index = 100 - F.try_divide(F.lit(100.0), 1 + F.try_divide(s.mean("_up", rsi), F.when(loss != 0, loss)))
    cross = F.when(a > b, 1.0).when(a < b, -1.0).otherwise(0.0)
    pace = F.when(mom > 0.02, 0.5).when(mom < -0.02, -0.5).otherwise(0.0)
    brake = F.when(index > 70, -0.5).when(index < 30, 0.5).otherwise(0.0)
    return out.withColumn("technical_signal", clip(0.5 * cross + 0.3 * pace + 0.2 * brake, -1.0, 1.0)).drop("_up", "_dn")


def mean_reversion(s: Series, price: str = "close", n: int = 200) -> Column:
    return F.coalesce(clip(-s.zscore(price, n) / 2, -1.0, 1.0), F.lit(0.0))


def weather(days: DataFrame, prices: DataFrame | None = None, warmup: int = 60) -> DataFrame:
    """Degree days against all earlier days of the ISO week, three quarters heating; on
    the dates of ``prices``, if given, the latest value at each."""
    s = Series()
    w = Window.partitionBy(F.weekofyear("date")).orderBy("date").rowsBetween(Window.unboundedPreceding, -1)

    def z(x):
        n, sd = F.count(x).over(w), F.stddev_samp(x).over(w)
        return F.when((n >= 3) & (sd > 0), (F.col(x) - F.avg(x).over(w)) / sd)

    ranked = days.withColumns({"_i": s.rank(), "_h": z("hdd"), "_c": z("cdd")})
    raw = clip(0.75 * F.coalesce("_h", F.lit(0.0)) + 0.25 * F.coalesce("_c", F.lit(0.0)), -2.0, 2.0) / 2
    ranked = ranked.withColumn("_raw", F.when(F.col("_i") > warmup, raw).otherwise(0.0))
    out = ranked.select("date", s.mean("_raw", 7, 1).alias("weather_signal"))
    if prices is None:
        return out
    return asof_join(prices.select("date"), out).withColumn("weather_signal", F.coalesce("weather_signal", F.lit(0.0)))


def sentiment(tone_z, gpr_z) -> Column:
    a = clip(-F.coalesce(col(tone_z), F.lit(0.0)) / 2, -1.0, 1.0)
    b = clip(F.coalesce(col(gpr_z), F.lit(0.0)) / 3, -0.5, 1.0)
    return 0.6 * a + 0.4 * b


def sentiment_on(prices: DataFrame, tone: DataFrame | None = None, gpr: DataFrame | None = None) -> DataFrame:
    """date, sentiment_signal: the latest tone (``tone_z60``, or ``tone_momentum`` where a
    table lacks it) and ``gpr_z60`` at each price date; an absent table counts as 0."""
    out, tone_z, gpr_z = prices.select("date"), F.lit(0.0), F.lit(0.0)
    if tone is not None:
        name = "tone_z60" if "tone_z60" in tone.columns else "tone_momentum"
        out, tone_z = asof_join(out, tone.select("date", F.col(name).alias("_tone"))), F.col("_tone")
    if gpr is not None:
        out, gpr_z = asof_join(out, gpr.select("date", F.col("gpr_z60").alias("_gpr"))), F.col("_gpr")
    return out.select("date", clip(sentiment(tone_z, gpr_z), -1.0, 1.0).alias("sentiment_signal"))


def composite_parts(prices: DataFrame, weekly: DataFrame, days: DataFrame, tone: DataFrame, gpr: DataFrame) -> tuple[DataFrame, dict[str, Column]]:
    """``prices`` (one series) with every part of the composite but the regime, and the
    parts by their weights' names."""
    # One series: its windows run in blocks, each with the rows that they look back to.
    both = blocks.rolling(blocks.numbered(prices), lambda s, rows: technical(s, rows).withColumn("mean_reversion_signal", mean_reversion(s)), LONGEST)
    out = both.drop("_i")
    for part in (storage_anomaly(weekly, prices).drop("storage_z"), seasonal_t(prices).drop("t"), weather(days, prices), sentiment_on(prices, tone, gpr)):
        out = out.join(part, "date", "left")
    return out, {name: F.col(f"{name}_signal") for name in ("storage", "seasonal", "technical", "mean_reversion", "weather", "sentiment")}


def walk_forward(signals: DataFrame, years: int = 5, months: int = 6, price: str = "close", least: int = 10) -> DataFrame:
    """The out-of-sample folds of a strategy: rows of ``signals`` with their ``fold``.

    The first fold starts ``years`` after the first date; a fold has ``months`` and both
    of its ends.  Signals are causal, so they are computed once and cut.
    """
    ends = signals.agg(F.min("date").alias("_a"), F.max("date").alias("_b"))
    start = F.add_months("_a", 12 * years)
    count = F.greatest(F.ceil(F.months_between("_b", start) / months).cast("int"), F.lit(0))
    folds = ends.select("_b", F.posexplode(F.transform(F.sequence(F.lit(0), F.greatest(count - 1, F.lit(0))), lambda i: F.add_months(start, months * i))).alias("fold", "_from"), count.alias("_n")).where(F.col("fold") < F.col("_n"))
    folds = folds.select("fold", "_from", F.least(F.add_months("_from", months), "_b").alias("_to"))
    cut = signals.join(F.broadcast(folds), (F.col("date") >= F.col("_from")) & (F.col("date") <= F.col("_to"))).drop("_from", "_to")
    size = F.count(F.lit(1)).over(Window.partitionBy("fold"))
    return cut.withColumn("_size", size).where(F.col("_size") >= least).drop("_size")


def fit_hmm(x: np.ndarray, steps: int = 60) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Two-state full-covariance Gaussian HMM by scaled Baum-Welch."""
    n, d = x.shape
    low = x[:, -1] <= np.median(x[:, -1])
    means = np.array([x[low].mean(0), x[~low].mean(0)])
    covs = np.array([np.cov(x[m].T) + 1e-8 * np.eye(d) for m in (low, ~low)])
    trans, start = np.array([[0.95, 0.05], [0.05, 0.95]]), np.array([0.5, 0.5])
    was = -np.inf
    for _ in range(steps):
        dens = np.column_stack([_density(x, means[k], covs[k]) for k in range(2)])
        alpha, scale = np.zeros((n, 2)), np.zeros(n)
        for t in range(n):
            a = (start if t == 0 else alpha[t - 1] @ trans) * dens[t]
            scale[t] = max(a.sum(), 1e-300)
            alpha[t] = a / scale[t]
        beta = np.ones((n, 2))
        for t in range(n - 2, -1, -1):
            beta[t] = trans @ (dens[t + 1] * beta[t + 1]) / scale[t + 1]
        gamma = alpha * beta
        gamma /= gamma.sum(1, keepdims=True)
        pair = (alpha[:-1, :, None] * trans[None] * (dens[1:] * beta[1:] / scale[1:, None])[:, None, :]).sum(0)
        trans, start = pair / pair.sum(1, keepdims=True), gamma[0]
        for k in range(2):
            w = gamma[:, k] / max(gamma[:, k].sum(), 1e-12)
            means[k] = w @ x
            covs[k] = (w[:, None] * (x - means[k])).T @ (x - means[k]) + 1e-8 * np.eye(d)
    return means, covs, trans, gamma


def _density(x, mean, cov):
    d = x - mean
    return np.exp(-0.5 * np.einsum("ij,jk,ik->i", d, np.linalg.inv(cov), d)) / np.sqrt((2 * np.pi) ** len(mean) * np.linalg.det(cov)) + 1e-300


def decode(x: np.ndarray, means: np.ndarray, covs: np.ndarray, trans: np.ndarray, start: np.ndarray) -> np.ndarray:
    """The likeliest sequence of states (Viterbi, in logarithms)."""
    dens = np.log(np.column_stack([_density(x, m, c) for m, c in zip(means, covs, strict=True)]))
    steps, best = np.log(trans + 1e-300), np.log(start + 1e-300) + dens[0]
    back = np.zeros(dens.shape, dtype=int)
    for t in range(1, len(x)):
        ways = best[:, None] + steps
        back[t] = ways.argmax(0)
        best = ways.max(0) + dens[t]
    path = np.zeros(len(x), dtype=int)
    path[-1] = best.argmax()
    for t in range(len(x) - 1, 0, -1):
        path[t - 1] = back[t, path[t]]
    return path


def regime(df: DataFrame, keys: list[str], price: str = "close", window: int = 21, lookback: int = 504, refit: int = 63, steps: int = 100) -> DataFrame:
    """+0.5 in the calm state, -0.5 in the other; fitted on past rows only.

    States are decoded as a sequence, over the rows that the model was fitted on and
    those up to the next fit.

    Baum-Welch is path dependent, so each key is one Arrow group kernel.
    """
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in df.schema.fields) + ", regime_signal double"

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("date").reset_index(drop=True)
        r = np.log(rows[price] / rows[price].shift(1))
        x = np.column_stack([r, r.rolling(window).std()])
        out, ok = np.zeros(len(rows)), np.isfinite(x).all(1)
        for a in range(lookback + window, len(rows), refit):
            past = x[max(0, a - lookback) : a]
            past = past[np.isfinite(past).all(1)]
            if len(past) < 50 or past[:, 1].std() == 0:
                continue
            means, covs, trans, gamma = fit_hmm(past, steps)
            calm = int(np.argmin(means[:, 1]))
            b = min(a + refit, len(rows))
            state = decode(np.vstack([past, np.nan_to_num(x[a:b])]), means, covs, trans, gamma[0])[len(past) :]
            out[a:b] = np.where(ok[a:b], np.where(state == calm, 0.5, -0.5), 0.0)
        return rows.assign(regime_signal=out)

    return df.groupBy(*keys).applyInPandas(run, schema)


# --- composite ------------------------------------------------------------------


@dataclass(frozen=True)
class Composite:
    #: Weights of the parts, thresholds of the score, sizing.
    weights: dict[str, float] = field(default_factory=lambda: {"regime": 0.10, "storage": 0.10, "seasonal": 0.10, "technical": 0.25, "mean_reversion": 0.20, "weather": 0.10, "sentiment": 0.15})
    long_threshold: float = 0.05
    short_threshold: float = -0.15
    vol_target: float = 0.40
    vol_lookback: int = 63
    max_short: float = 0.50
    risk_off: float = 0.93
    floor: float = 0.40

    def score(self, present: dict[str, Column]) -> Column:
        """Weights of absent parts are shared among those present."""
        total = sum(self.weights[p] for p in present)
        return sum((F.coalesce(c, F.lit(0.0)) * (self.weights[p] / total) for p, c in present.items()), F.lit(0.0))

    def apply(self, df: DataFrame, present: dict[str, Column], keys: tuple[str, ...] = (), price: str = "close") -> DataFrame:
        """Adds composite, signal and position_size.

        Keyed series are a task each; one series without keys runs in blocks.
        """
        out = df.withColumn("composite", self.score(present))

        def risk(s: Series, rows: DataFrame) -> DataFrame:
            rows = rows.withColumn("_r", s.log_return(price))
            return rows.withColumn("_v", s.std("_r", self.vol_lookback) * F.sqrt(F.lit(252.0)))

        if keys:
            s = Series(keys)
            out = risk(s, out)
            out = out.withColumn("_v", clip(F.coalesce("_v", s.bfill("_v")), 0.05))
            out = expanding_rank(out, list(keys), ["date"], "_v", "_rank", 252)
        else:
            out = blocks.carried(blocks.rolling(blocks.numbered(out), risk, self.vol_lookback), "_v", "_v", backward=True)
            out = blocks.expanding_rank(out.withColumn("_v", clip("_v", 0.05)), "_v", "_rank", 252).drop("_i")
        side = F.when(F.col("_rank") > self.risk_off, 0).when(F.col("composite") >= self.long_threshold, 1).when(F.col("composite") <= self.short_threshold, -1).otherwise(0)
        belief = self.floor + (1 - self.floor) * F.least(F.abs("composite"), F.lit(0.8)) / 0.8
        scale = F.least(self.vol_target / F.col("_v"), F.lit(1.5))
        out = out.withColumn("signal", side)
        return out.withColumn("position_size", clip(F.col("signal") * belief * scale, -self.max_short, 1.0)).drop("_r", "_v", "_rank")


class StopState:
    """Trailing stop with cooldown, one bar at a time; shared by batch and stream."""

    def __init__(self, long_stop: float, short_stop: float, cooldown: int, state=(0, 0.0, 0.0, 0)):
        self.long_stop, self.short_stop, self.cooldown = long_stop, short_stop, cooldown
        self.side, self.high, self.low, self.wait = state

    def step(self, price: float, signal: int) -> int:
        if self.wait > 0:
            self.wait -= 1
            if self.wait == 0:
                self.side = 0
            return 0
        self.high, self.low = max(self.high, price), min(self.low, price)
        hit = (self.side == 1 and price / self.high - 1 < -self.long_stop) or (self.side == -1 and self.low > 0 and price / self.low - 1 > self.short_stop)
        if hit:
            self.side, self.wait = 0, self.cooldown
            return 0
        if signal != self.side:
            self.side, self.high, self.low = signal, price, price
        return signal

    @property
    def state(self) -> tuple[int, float, float, int]:
        return self.side, self.high, self.low, self.wait


def trailing_stop(df: DataFrame, keys: list[str], price: str = "close", signal: str = "signal", long_stop: float = 0.1, short_stop: float = 0.1, cooldown: int = 10) -> DataFrame:
    """Adds ``stopped_signal``: a path-dependent fold, one Arrow kernel a key."""
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in df.schema.fields) + ", stopped_signal int"

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("date")
        machine = StopState(long_stop, short_stop, cooldown)
        return rows.assign(stopped_signal=[machine.step(p, int(x)) for p, x in zip(rows[price], rows[signal], strict=True)])

    return df.groupBy(*keys).applyInPandas(run, schema)


class Book:
    """Positions by instrument, closed trades and cash, fed by open/close/mark events."""

    def __init__(self, max_positions: int = 5):
        self.max_positions, self.open, self.trades = max_positions, {}, []

    def on(self, instrument: str, action: str, size: float, price: float, at) -> float:
        """The realised return of a close (0 otherwise); a full book refuses to open,
        even an instrument it already holds."""
        if action == "open":
            if len(self.open) < self.max_positions:
                if instrument in self.open:
                    self.on(instrument, "close", 0.0, price, at)
                self.open[instrument] = [size, price, price, at]
            return 0.0
        if instrument not in self.open:
            return 0.0
        held = self.open[instrument]
        held[2] = price
        if action != "close":
            return 0.0
        del self.open[instrument]
        gain = held[0] * (price / held[1] - 1)
        self.trades.append((instrument, held[0], held[1], price, gain, held[3], at))
        return gain

    @property
    def unrealised(self) -> float:
        return sum(size * (last / entry - 1) for size, entry, last, _ in self.open.values())

    @property
    def gross(self) -> float:
        return sum(abs(p[0]) for p in self.open.values())


def run_book(events: DataFrame, account: str = "account", max_positions: int = 5) -> DataFrame:
    """(account, seq, instrument, action, size, price) -> realised, unrealised, gross."""
    kind = events.schema[account].dataType.simpleString()

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows, book, out = rows.sort_values("seq"), Book(max_positions), []
        for r in rows.itertuples():
            gain = book.on(r.instrument, r.action, r.size, r.price, r.seq)
            out.append((getattr(r, account), r.seq, gain, book.unrealised, book.gross, len(book.open)))
        return pd.DataFrame(out, columns=[account, "seq", "realised", "unrealised", "gross", "n_open"])

    return events.select(account, "seq", "instrument", "action", "size", "price").groupBy(account).applyInPandas(run, f"{account} {kind}, seq long, realised double, unrealised double, gross double, n_open long")
