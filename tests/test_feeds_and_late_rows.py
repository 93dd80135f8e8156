"""Chunked feeds with failures, and streams of out-of-order batches against their batch model."""

import datetime as dt
import os
import time

import pytest
from pyspark.sql import functions as F

from tests.oracle import SF
from wattline.plans import text
from wattline.sources import feeds
from wattline.streaming import jobs


def test_chunks_cover_the_range_once():
    day = dt.date
    got = feeds.chunks(day(2023, 11, 15), day(2024, 5, 2))
    assert got == [(day(2023, 11, 15), day(2024, 2, 1)), (day(2024, 2, 1), day(2024, 5, 1)), (day(2024, 5, 1), day(2024, 5, 3))]
    assert feeds.chunks(day(2024, 1, 1), day(2024, 1, 1)) == [(day(2024, 1, 1), day(2024, 1, 2))]
    assert feeds.chunks(day(2024, 1, 2), day(2024, 1, 1)) == []


def test_timeline_lines():
    text = "Date,Series,Value\n20240102T030405Z,tone,-1.5\n2024-01-03 7\n2024-01-04,x,not\n\nrubbish\n20240105 , 2.25"
    assert list(feeds.timeline_rows(text)) == [(dt.datetime(2024, 1, 2, 3, 4, 5), -1.5), (dt.datetime(2024, 1, 3), 7.0), (dt.datetime(2024, 1, 5), 2.25)]


def test_a_feed_resumes_after_a_failed_chunk(spark, tmp_path):
    log, broken = tmp_path / "asked", tmp_path / "broken"
    log.mkdir()
    broken.touch()

    def fetch(key, begin, end):
        (log / f"{key}-{begin}-{time.time_ns()}").touch()
        if key == "gas" and begin.month == 4 and broken.exists():
            raise OSError("429")
        if key == "wind":
            return []
        days = range((end - begin).days)
        return feeds.timeline_rows("\n".join(f"{begin + dt.timedelta(days=i):%Y%m%d},{key},{i}" for i in days))

    source = feeds.feed("timeline_test", "ts timestamp, value double", fetch, tries=2, sleep=lambda s: None)
    ask = lambda: feeds.land(spark, source, str(tmp_path / "landed"), ["gas", "power", "wind"], dt.date(2024, 1, 1), dt.date(2024, 9, 30))
    rows, failed = ask()
    assert [(k, b) for k, b, _ in failed] == [("gas", dt.date(2024, 4, 1))] and "429" in failed[0][2]
    assert rows.where("key = 'gas'").count() == 274 - 91 and rows.where("key = 'power'").count() == 274
    assert len(list(log.iterdir())) == 9 + 1
    broken.unlink()
    rows, failed = ask()
    assert failed == [] and rows.where("key = 'gas'").select(F.to_date("ts")).distinct().count() == 274
    assert len(list(log.iterdir())) == 11 and rows.where("key = 'wind'").count() == 0
    assert ask()[0].count() == 548 and len(list(log.iterdir())) == 11


def test_a_strict_feed_fails_the_job(spark):
    def fetch(key, begin, end):
        raise OSError("down")

    spark.dataSource.register(feeds.feed("strict_test", "x double", fetch, tries=1))
    with pytest.raises(Exception, match="down"):
        spark.read.format("strict_test").options(keys='["a"]', start="2024-01-01", end="2024-01-02", strict="true").load().collect()


@pytest.mark.parametrize("mode", ["append", "update"])
def test_out_of_order_batches_give_what_the_model_says(spark, tmp_path, mode):
    """Six batches through a real stream; late windows are dropped, closed ones leave the state."""
    t = lambda h: dt.datetime(2024, 1, 1) + dt.timedelta(hours=h)
    batches = [[1, 5, 30], [2, 60, 61], [3, 49, 70, 100], [4, 26, 98, 150], [99, 27, 149, 151], [200, 50, 130, 148]]
    folder = tmp_path / "in"
    for i, hours in enumerate(batches):
        df = spark.createDataFrame([(t(h), "k" if h % 2 else "m", float(h)) for h in hours], "ts timestamp, k string, v double")
        df.coalesce(1).write.parquet(str(tmp_path / f"b{i}"))
        folder.mkdir(exist_ok=True)
        part = next((tmp_path / f"b{i}").glob("part-*.parquet"))
        os.rename(part, folder / f"{i}.parquet")
        os.utime(folder / f"{i}.parquet", (1_700_000_000 + 100 * i,) * 2)
    live = spark.readStream.schema("ts timestamp, k string, v double").option("maxFilesPerTrigger", 1).parquet(str(folder))
    name = f"late_{mode}"
    agg = jobs.tumbling_daily(live, "v", "k", late="24 hours")
    q = agg.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination()
    dropped = sum(s["numRowsDroppedByWatermark"] for p in q.recentProgress for s in p["stateOperators"])
    out = spark.table(name).groupBy("k", "day").agg(F.max("n").alias("n")) if mode == "update" else spark.table(name)
    got = {(r.k, r.day): r.n for r in out.collect()}
    rows = spark.createDataFrame([(i, t(h), "k" if h % 2 else "m", float(h)) for i, b in enumerate(batches) for h in b], "batch int, ts timestamp, k string, v double")
    model = jobs.replay(rows, "batch", "v", "k", late="24 hours", closed_only=mode == "append").collect()
    assert got == {(r.k, r.start): r.n for r in model if r.n}
    lost = jobs.late_rows(rows, "batch", late="24 hours").where("dropped")
    assert lost.count() >= 3
    # The stream counts dropped rows after a first aggregation inside each batch.
    assert dropped == lost.select("batch", "k", "w").distinct().count()


def test_late_rows_are_counted_in_the_query(spark):
    e = text.late_events(spark, SF)
    out = jobs.replay(e, "batch", "value", "event_type", late="2 days").agg(F.sum("n").alias("n"), F.sum("n_dropped").alias("d")).first()
    assert out.n + out.d == e.count() and out.d > 0


def test_stop_and_halt_processors_equal_their_batch_forms(spark, tmp_path):
    """A stream of small batches keeps the stop's and the halt's state between them."""
    from wattline.operators.signals import StopState

    prices = [10, 12, 11, 9, 8, 9, 13, 12, 14, 10, 9, 8, 15, 16, 12, 11]
    rows = [(k, i, dt.datetime(2024, 1, 1) + dt.timedelta(days=i), float(p) + j, 1) for j, k in enumerate("ab") for i, p in enumerate(prices)]
    df = spark.createDataFrame(rows, "key string, i int, ts timestamp, price double, signal int")
    for b in range(4):
        df.where(F.floor(F.col("i") / 4) == b).coalesce(1).write.parquet(str(tmp_path / f"p{b}"))
        part = next((tmp_path / f"p{b}").glob("part-*.parquet"))
        (tmp_path / "in").mkdir(exist_ok=True)
        os.rename(part, tmp_path / "in" / f"{b}.parquet")
        os.utime(tmp_path / "in" / f"{b}.parquet", (1_700_000_000 + 100 * b,) * 2)
    for name, processor, value in (("stops", jobs.Stops(0.1, 0.1, 2), "price"), ("halts", jobs.Halt(0.3), "value")):
        live = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in")).withColumnRenamed("price", value)
        q = jobs.stateful(live, "key", processor).writeStream.format("memory").queryName(name).outputMode("update").option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
        q.awaitTermination()
        got = {(r.key, r.ts): r for r in spark.table(name).collect()}
        assert len(got) == len(rows)
        for key in "ab":
            machine, peak, halted = StopState(0.1, 0.1, 2), 1.0, False
            for _, _, ts, p, s in [r for r in rows if r[0] == key]:
                if name == "stops":
                    assert got[key, ts].signal == machine.step(p, s)
                else:
                    peak = max(peak, p)
                    halted = halted or p / peak - 1 < -0.3
                    assert got[key, ts].halted == halted and abs(got[key, ts].drawdown - (p / peak - 1)) < 1e-12
