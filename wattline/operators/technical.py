"""Technical indicators on bars (symbol, date, open, high, low, close, volume)."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wattline.functions.ts import Series, ewm, span


class Technical:
    """Indicators by ``keys`` in ``date`` order.

    Window-only indicators return dicts of columns, so that any number of them goes
    into one select with one exchange and one sort; exponential means need a
    recurrence and are added by ``with_ema``.
    """

    def __init__(self, keys: Iterable[str] = ("symbol",), ema=(8, 21, 50, 200), sma=(10, 20, 50), rsi: int = 14, macd=(12, 26, 9), bollinger=(20, 2.0), atr: int = 14, stochastic=(14, 3)):
        self.keys = list(keys)
        self.s = Series(keys, ["date"])
        self.ema_spans, self.sma_spans, self.rsi_n, self.macd_spans = ema, sma, rsi, macd
        self.boll, self.atr_n, self.stoch = bollinger, atr, stochastic

    def sma(self) -> dict[str, Column]:
        out = {}
        for n in self.sma_spans:
            m = self.s.mean("close", n)
            out[f"sma_{n}"] = m
            out[f"sma_{n}_dist"] = F.try_divide(F.col("close") - m, m)
        return out

    def returns(self) -> dict[str, Column]:
        out = {f"return_{n}d": self.s.pct("close", n) for n in (1, 2, 5, 10, 20)}
        return out | {"log_return_1d": self.s.log_return("close")}

    def bollinger(self) -> dict[str, Column]:
        n, k = self.boll
        mid, sd = self.s.mean("close", n), self.s.std("close", n)
        up, low = mid + k * sd, mid - k * sd
        return {"bb_middle": mid, "bb_upper": up, "bb_lower": low, "bb_pct": F.try_divide(F.col("close") - low, up - low), "bb_width": F.try_divide(up - low, mid)}

    def stochastic_k(self) -> Column:
        n = self.stoch[0]
        low, high = self.s.min("low", n), self.s.max("high", n)
        return F.try_divide(100 * (F.col("close") - low), high - low)

    def steps(self) -> dict[str, Column]:
        """Row-by-row quantities that the second pass rolls over."""
        delta, last = self.s.diff("close"), self.s.lag("close")
        return {
            "_gain": F.when(delta.isNotNull(), F.greatest(delta, F.lit(0.0))),
            "_loss": F.when(delta.isNotNull(), F.greatest(-delta, F.lit(0.0))),
            "_tr": F.greatest(F.col("high") - F.col("low"), F.abs(F.col("high") - last), F.abs(F.col("low") - last)),
            "_ret": F.coalesce(self.s.log_return("close")),
            "_flow": F.coalesce(F.signum(delta) * F.col("volume"), F.lit(0.0)),
            "stoch_k": self.stochastic_k(),
        }

    def rolled(self) -> dict[str, Column]:
        loss = self.s.mean("_loss", self.rsi_n)
        rs = F.try_divide(self.s.mean("_gain", self.rsi_n), F.when(loss != 0, loss))
        atr, volume = self.s.mean("_tr", self.atr_n), self.s.mean("volume", 20)
        return {
            "rsi": 100 - F.try_divide(F.lit(100.0), 1 + rs),
            "atr": atr,
            "atr_pct": F.try_divide(atr, F.col("close")),
            "stoch_d": self.s.mean("stoch_k", self.stoch[1]),
            "realized_vol_20d": self.s.std("_ret", 20) * F.sqrt(F.lit(252.0)),
            "volume_sma_20": volume,
            "volume_ratio": F.try_divide(F.col("volume"), F.when(volume != 0, volume)),
            "obv": self.s.cumsum("_flow"),
        }

    def windows(self, bars: DataFrame) -> DataFrame:
        """Every indicator but the exponential ones; two window passes, one sort."""
        first = bars.withColumns({**self.sma(), **self.returns(), **self.bollinger(), **self.steps()})
        return first.withColumns(self.rolled()).drop("_gain", "_loss", "_tr", "_ret", "_flow")

    def with_ema(self, bars: DataFrame) -> DataFrame:
        """ema_n, ema_n_dist, macd, macd_signal_line, macd_hist."""
        fast, slow, signal = self.macd_spans
        specs = {f"ema_{n}": ("close", span(n), False) for n in self.ema_spans}
        out = ewm(bars, self.keys, ["date"], {**specs, "_fast": ("close", span(fast), False), "_slow": ("close", span(slow), False)})
        out = out.withColumns({f"ema_{n}_dist": F.try_divide(F.col("close") - F.col(f"ema_{n}"), F.col(f"ema_{n}")) for n in self.ema_spans})
        out = out.withColumn("macd", F.col("_fast") - F.col("_slow")).drop("_fast", "_slow")
        out = ewm(out, self.keys, ["date"], {"macd_signal_line": ("macd", span(signal), False)})
        return out.withColumn("macd_hist", F.col("macd") - F.col("macd_signal_line"))

    def all(self, bars: DataFrame) -> DataFrame:
        return self.windows(self.with_ema(bars))
