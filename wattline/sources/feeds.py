"""A service that is asked for ranges of dates, as a Spark data source.

``feed`` makes a data source of a function ``fetch(key, begin, end)``.  Its partitions are
planned from the date range: one for each key (a symbol, a search query) and chunk of
``months`` months, so chunks are asked for in parallel, each in its own task, with
retries.  ``land`` keeps what came: a chunk that fails lands nothing but its error, the others
are kept, and the next call asks only for the chunks that are missing.
"""

from __future__ import annotations

import datetime as dt
import json
import time
from collections.abc import Callable, Iterable, Iterator

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from wattline.sources.landing import retried

Fetch = Callable[[str, dt.date, dt.date], Iterable[tuple]]


def month_later(day: dt.date, months: int) -> dt.date:
    """The first of the month that is ``months`` on."""
    at = day.year * 12 + day.month - 1 + months
    return dt.date(at // 12, at % 12 + 1, 1)


def chunks(start: dt.date, end: dt.date, months: int = 3) -> list[tuple[dt.date, dt.date]]:
    """[begin, end) ranges that cover ``start`` to ``end``, both included; the first chunk ends
    where a calendar month does."""
    out, last = [], end + dt.timedelta(days=1)
    while start < last:
        stop = min(month_later(start, months), last)
        out.append((start, stop))
        start = stop
    return out


def timeline_rows(text: str) -> Iterator[tuple[dt.datetime, float]]:
    """(time, value) of the lines of a timeline: by commas or else white space, the time's
    digits first and the value last; lines that are neither are left out."""
    for line in text.splitlines():
        parts = [p.strip() for p in (line.split(",") if "," in line else line.split())]
        digits = "".join(c for c in parts[0] if c.isdigit()) if len(parts) > 1 else ""
        try:
            day = dt.datetime.strptime(digits[:14], "%Y%m%d%H%M%S") if len(digits) >= 14 else dt.datetime.strptime(digits[:8], "%Y%m%d")
            yield day, float(parts[-1])
        except ValueError:
            continue


class Chunk(InputPartition):
    def __init__(self, key: str, begin: dt.date, end: dt.date):
        self.key, self.begin, self.end = key, begin, end


def feed(name: str, columns: str, fetch: Fetch, **retry) -> type[DataSource]:
    """A data source ``name`` with the rows (key, begin, error, *columns).

    Options: ``keys`` and ``done`` (JSON lists; done has [key, begin] of chunks to leave
    out), ``start``, ``end`` (dates), ``months`` and ``strict``.  A chunk whose calls fail is
    one row with ``error`` set, or with ``strict`` fails the job.  A chunk without rows
    is one row of nulls, so that it counts as asked for.
    """

    class Reader(DataSourceReader):
        def __init__(self, options):
            self.options = options

        def partitions(self):
            day = lambda k: dt.date.fromisoformat(self.options[k])
            done = {tuple(d) for d in json.loads(self.options.get("done", "[]"))}
            planned = chunks(day("start"), day("end"), int(self.options.get("months", "3")))
            return [Chunk(k, a, b) for k in json.loads(self.options["keys"]) for a, b in planned if (k, a.isoformat()) not in done]

        def read(self, partition):
            width = len(columns.split(","))
            if partition is None:  # nothing was planned
                return
            try:
                rows = retried(lambda: list(fetch(partition.key, partition.begin, partition.end)), **retry)
            except Exception as e:
                if self.options.get("strict", "false") == "true":
                    raise
                yield (partition.key, partition.begin, f"{type(e).__name__}: {e}", *[None] * width)
                return
            for row in rows or [(None,) * width]:
                yield (partition.key, partition.begin, None, *row)

    class Feed(DataSource):
        @classmethod
        def name(cls):
            return name

        def schema(self):
            return f"key string, begin date, error string, {columns}"

        def reader(self, schema):
            return Reader(self.options)

    return Feed


def _landed(spark: SparkSession, path: str, schema) -> DataFrame:
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException:
        return spark.createDataFrame([], schema)


def land(spark: SparkSession, source: type[DataSource], path: str, keys: list[str], start: dt.date, end: dt.date, months: int = 3) -> tuple[DataFrame, list[tuple[str, dt.date, str]]]:
    """(all rows landed under ``path``, the chunks that failed this time with their errors).

    Chunks that are there already are not asked for again.  A chunk's rows appear as one
    file in one commit, so a lost task or a stopped job leaves no half of it.  Chunks are few
    (keys * months), so which of them are there is known on the driver.
    """
    spark.dataSource.register(source)
    reader = spark.read.format(source.name()).options(keys=json.dumps(keys), start=start.isoformat(), end=end.isoformat(), months=months)
    schema = reader.load().schema
    done = [(r["key"], r["begin"].isoformat()) for r in _landed(spark, path, schema).select("key", "begin").distinct().collect()]
    asked = reader.option("done", json.dumps(done)).load()
    # One pass over the service: what failed is landed apart, under a name of this call.
    failed_at = f"{path.rstrip('/')}_failed/{time.time_ns()}"
    staged = f"{path.rstrip('/')}_staged/{time.time_ns()}"
    asked.write.parquet(staged)
    came = spark.read.schema(schema).parquet(staged)
    came.where("error is null").write.mode("append").parquet(path)
    came.where("error is not null").select("key", "begin", "error").write.parquet(failed_at)
    failed = spark.read.schema("key string, begin date, error string").parquet(failed_at).orderBy("key", "begin").collect()
    rows = _landed(spark, path, schema).drop("error")
    values = [F.col(c).isNotNull() for c in rows.columns[2:]]
    some = values[0]
    for v in values[1:]:
        some = some | v
    return rows.where(some), [tuple(r) for r in failed]
