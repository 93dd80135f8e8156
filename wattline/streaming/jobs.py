"""Structured Streaming forms of the ordered operators, each with a batch twin."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from wattline.operators.signals import Book, StopState


def event_time(df: DataFrame, ts: str = "ts") -> DataFrame:
    """Watermarks need a zoned timestamp; the session zone is taken as UTC."""
    return df.withColumn(ts, F.col(ts).cast("timestamp"))


def tumbling_daily(df: DataFrame, value: str, by: str, ts: str = "ts", late: str = "1 hour", watermark: bool = True) -> DataFrame:
    """Daily totals; with ``watermark`` off it is the batch twin."""
    rows = df.withWatermark(ts, late) if watermark else df
    return rows.groupBy(F.window(ts, "1 day").alias("w"), by).agg(F.sum(value).alias("total"), F.max(value).alias("peak"), F.count(value).alias("n")).select(by, F.col("w.start").alias("day"), "total", "peak", "n")


def late_rows(df: DataFrame, batch: str, ts: str = "ts", width: str = "1 day", late: str = "1 hour") -> DataFrame:
    """The batch model of a watermark: ``df`` with its day-like window ``w`` and ``dropped``.

    ``batch`` numbers the micro-batches in which rows arrive.  A batch's watermark is the
    latest event time of all batches before it less ``late``.  Windows are closed by it at
    the end of the batch, so the next batch's rows are dropped where their window had ended
    by then: a row is late by the watermark of the batch before its own.
    """
    of_batch = df.groupBy(F.col(batch).alias("_b")).agg(F.max(ts).alias("_m"))
    order = Window.orderBy("_b")
    # One row a micro-batch; a watermark never goes back.
    seen = of_batch.withColumn("_seen", F.max("_m").over(order.rowsBetween(Window.unboundedPreceding, -1)))
    marks = seen.select("_b", (F.lag("_seen").over(order) - F.expr(f"interval {late}")).alias("_mark"))
    rows = df.withColumn("w", F.window(ts, width)).join(F.broadcast(marks), F.col(batch) == F.col("_b"))
    return rows.withColumn("dropped", F.coalesce(F.col("w.end") <= F.col("_mark"), F.lit(False))).drop("_b", "_mark")


def replay(df: DataFrame, batch: str, value: str, by: str, ts: str = "ts", width: str = "1 day", late: str = "1 hour", closed_only: bool = False) -> DataFrame:
    """by, start, total, n, n_dropped: what a stream of the batches holds at its end.

    With ``closed_only`` only the windows that the last watermark has closed, as append
    mode emits them; otherwise every window's last state, as update mode does.  A window
    that only dropped rows fell into has n = 0.
    """
    rows = late_rows(df, batch, ts, width, late)
    kept = F.when(~F.col("dropped"), F.col(value))
    out = rows.groupBy(by, F.col("w.start").alias("start"), F.col("w.end").alias("_end")).agg(F.sum(kept).alias("total"), F.count_if(~F.col("dropped")).alias("n"), F.count_if("dropped").alias("n_dropped"))
    if closed_only:
        end = df.agg((F.max(ts) - F.expr(f"interval {late}")).alias("_last"))
        out = out.join(F.broadcast(end)).where(F.col("_end") <= F.col("_last")).drop("_last")
    return out.drop("_end")


def sliding_index(df: DataFrame, value: str, ts: str = "ts", width: str = "7 days", step: str = "1 day", late: str = "1 day", watermark: bool = True) -> DataFrame:
    rows = df.withWatermark(ts, late) if watermark else df
    return rows.groupBy(F.window(ts, width, step).alias("w")).agg(F.avg(value).alias("index"), F.count(value).alias("n")).select(F.col("w.end").alias("at"), "index", "n")


def dedup(df: DataFrame, keys: list[str], ts: str = "ts", late: str = "1 day") -> DataFrame:
    return df.withWatermark(ts, late).dropDuplicatesWithinWatermark(keys)


def sessions(df: DataFrame, by: str, ts: str = "ts", gap: str = "30 minutes", late: str = "1 hour", watermark: bool = True) -> DataFrame:
    rows = df.withWatermark(ts, late) if watermark else df
    s = rows.groupBy(F.session_window(ts, gap).alias("s"), by).agg(F.count(F.lit(1)).alias("n"))
    return s.select(by, F.col("s.start").alias("start"), F.col("s.end").alias("end"), "n")


class Ewma(StatefulProcessor):
    """Running exponential mean by key; rows of a batch are taken in time order."""

    def __init__(self, alpha: float):
        self.alpha = alpha

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.mean = handle.getValueState("mean", "mean double")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        data = pd.concat(list(rows)).sort_values("ts")
        now, out = self.mean.get()[0] if self.mean.exists() else None, []
        for x in data["value"]:
            now = x if now is None else self.alpha * x + (1 - self.alpha) * now
            out.append(now)
        self.mean.update((now,))
        yield pd.DataFrame({"key": key[0], "ts": data["ts"], "ewma": out})

    def close(self) -> None:
        pass


class Stops(StatefulProcessor):
    """Trailing stop and cooldown by key."""

    def __init__(self, long_stop: float = 0.1, short_stop: float = 0.1, cooldown: int = 10):
        self.args = (long_stop, short_stop, cooldown)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.held = handle.getValueState("stop", "side int, high double, low double, wait int")

    def handleInputRows(self, key, rows, timerValues):
        machine = StopState(*self.args, *([tuple(self.held.get())] if self.held.exists() else []))
        data = pd.concat(list(rows)).sort_values("ts")
        signals = [machine.step(p, int(s)) for p, s in zip(data["price"], data["signal"], strict=True)]
        self.held.update(machine.state)
        yield pd.DataFrame({"key": key[0], "ts": data["ts"], "signal": signals})

    def close(self) -> None:
        pass


class Halt(StatefulProcessor):
    """Latched drawdown halt by key."""

    def __init__(self, limit: float = 0.15):
        self.limit = limit

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.held = handle.getValueState("halt", "peak double, halted boolean")

    def handleInputRows(self, key, rows, timerValues):
        peak, halted = self.held.get() if self.held.exists() else (1.0, False)
        data, out = pd.concat(list(rows)).sort_values("ts"), []
        for v in data["value"]:
            peak = max(peak, v)
            halted = halted or v / peak - 1 < -self.limit
            out.append((v / peak - 1, halted))
        self.held.update((peak, halted))
        yield pd.DataFrame({"key": key[0], "ts": data["ts"], "drawdown": [d for d, _ in out], "halted": [h for _, h in out]})

    def close(self) -> None:
        pass


class Positions(StatefulProcessor):
    """The position book by account, kept as one map of open positions."""

    def __init__(self, max_positions: int = 5):
        self.max_positions = max_positions

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.held = handle.getMapState("open", "instrument string", "size double, entry double, last double, seq long")

    def handleInputRows(self, key, rows, timerValues):
        book = Book(self.max_positions)
        book.open = {k[0]: list(v) for k, v in self.held.iterator()}
        before, out = set(book.open), []
        for r in pd.concat(list(rows)).sort_values("seq").itertuples():
            gain = book.on(r.instrument, r.action, r.size, r.price, int(r.seq))
            out.append((key[0], r.seq, gain, book.unrealised, book.gross))
        for name in before - set(book.open):
            self.held.removeKey((name,))
        for name, v in book.open.items():
            self.held.updateValue((name,), tuple(v))
        yield pd.DataFrame(out, columns=["key", "seq", "realised", "unrealised", "gross"])

    def close(self) -> None:
        pass


SCHEMAS = {
    Ewma: "key string, ts timestamp, ewma double",
    Stops: "key string, ts timestamp, signal int",
    Halt: "key string, ts timestamp, drawdown double, halted boolean",
    Positions: "key string, seq long, realised double, unrealised double, gross double",
}


def stateful(df: DataFrame, key: str, processor: StatefulProcessor) -> DataFrame:
    """Needs the RocksDB state store provider in the session."""
    return df.groupBy(key).transformWithStateInPandas(processor, outputStructType=SCHEMAS[type(processor)], outputMode="Update", timeMode="None")


ROCKSDB = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
