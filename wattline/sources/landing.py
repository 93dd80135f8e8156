"""Sources and sinks: landed files of the market feeds, caches, sinks.

Feeds are mostly landed as files; each reader here turns one feed's layout into a
typed frame.  ``paged`` asks a service page by page through a function it is given.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

OHLCV = "symbol string, date date, open double, high double, low double, close double, volume double"
#: Named weekly and monthly series of the energy statistics feed.
NAMED_SERIES = ("crude_storage", "gas_storage", "gasoline_storage", "distillate_storage", "crude_production", "gas_production", "crude_imports", "refinery_utilisation")


def prices(spark: SparkSession, path: str, symbols: list[str] | None = None, start: str | None = None, end: str | None = None, known: tuple[str, ...] = ()) -> DataFrame:
    """Bars from Parquet partitioned by symbol; both filters reach the scan."""
    unknown = [s for s in symbols or () if known and s not in known]
    if unknown:
        raise ValueError(f"unknown symbols {unknown}; known: {sorted(known)}")
    df = spark.read.parquet(path)
    if symbols:
        df = df.where(F.col("symbol").isin(symbols))
    if start:
        df = df.where(F.col("date") >= F.lit(start).cast("date"))
    return df.where(F.col("date") <= F.lit(end).cast("date")) if end else df


def latest_prices(df: DataFrame, symbol: str, days: int = 5) -> DataFrame:
    return df.where(F.col("symbol") == symbol).where(F.col("date") >= F.date_sub(F.current_date(), days))


def csv_table(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).option("header", True).csv(path)


def paged_json(spark: SparkSession, path: str, period: str = "period", value: str = "value", extra: tuple[str, ...] = ()) -> DataFrame:
    """{"response": {"data": [...]}} pages, one file a page: period, value, extras."""
    fields = ", ".join(f"{c}: string" for c in (period, value, *extra))
    pages = spark.read.schema(f"response struct<data: array<struct<{fields}>>>").option("multiLine", True).json(path)
    rows = pages.select(F.explode("response.data").alias("d"))
    return rows.select(F.col(f"d.{period}").alias("period"), F.col(f"d.{value}").try_cast("double").alias("value"), *[F.col(f"d.{c}").alias(c) for c in extra]).where("value is not null")


def retried(call: Callable[[], dict], tries: int = 3, shortest: float = 2.0, longest: float = 30.0, sleep: Callable[[float], None] = time.sleep) -> dict:
    """What ``call`` gives; after a failure it waits 1, 2, 4 ... seconds within the bounds
    and calls again, and the last failure is raised."""
    for i in range(tries):
        try:
            return call()
        except Exception:
            if i + 1 == tries:
                raise
            sleep(min(longest, max(shortest, 2.0**i)))
    raise ValueError("tries must be 1 or more")


def paged(spark: SparkSession, keys: list[dict[str, str]], fetch: Callable[[dict[str, str], int, int], dict], page: int = 5000, strict: bool = False, **retry) -> DataFrame:
    """Rows of a paginated service: the key's columns, period, value.

    ``fetch(key, offset, length)`` gives {"response": {"total", "data": [{"period",
    "value"}]}}.  Each key (a region, or a region and a fuel) is a partition that asks
    for page after page until the offset reaches the total or a page is empty, and
    hands each page on at once.  Calls are retried; a series whose call still fails
    ends there with the rows it has (none at first), or with ``strict`` fails the job.
    Values that are no numbers are left out.  No keys: no rows.
    """
    names = list(keys[0]) if keys else []
    schema = ", ".join([*(f"`{n}` string" for n in names), "period string", "value string"])

    def series(key: dict[str, str]) -> Iterator:
        import pandas as pd

        offset, total = 0, 1
        while offset < total:
            try:
                answer = retried(lambda at=offset: fetch(key, at, page), **retry)["response"]
            except Exception:
                if strict:
                    raise
                return
            rows, total = answer.get("data") or [], int(answer.get("total") or 0)
            if not rows:
                return
            texts = [[None if r.get(c) is None else str(r[c]) for r in rows] for c in ("period", "value")]
            yield pd.DataFrame({**{n: [key[n]] * len(rows) for n in names}, "period": texts[0], "value": texts[1]})
            offset += page

    def run(batches):
        for rows in batches:
            for i in rows["id"]:
                yield from series(keys[i])

    out = spark.range(0, len(keys), 1, max(1, len(keys))).mapInPandas(run, schema)
    return out.withColumn("value", F.col("value").try_cast("double")).where("value is not null")


#: Fuel codes of the generation feed for the two weather-driven fuels.
WIND, SOLAR = "WND", "SUN"


def paged_generation(spark: SparkSession, regions: list[str], fetch, fuels: tuple[str, ...] = (WIND, SOLAR), **options) -> DataFrame:
    """region, fuel, period, value; a partition for each region and fuel."""
    return paged(spark, [{"region": r, "fuel": f} for r in regions for f in fuels], fetch, **options)


def hourly(pages: DataFrame, name: str = "mw") -> DataFrame:
    return pages.withColumn("ts", F.try_to_timestamp("period", F.lit("yyyy-MM-dd'T'HH")).cast("timestamp_ntz")).withColumnRenamed("value", name).drop("period")


def observations(spark: SparkSession, path: str) -> DataFrame:
    """{"observations": [{"date", "value"}]}; "." is missing."""
    raw = spark.read.schema("observations array<struct<date: string, value: string>>").option("multiLine", True).json(path)
    o = raw.select(F.explode("observations").alias("o"))
    return o.select(F.col("o.date").try_cast("date").alias("date"), F.nullif(F.col("o.value"), F.lit(".")).try_cast("double").alias("value"))


def station_temperatures(spark: SparkSession, path: str) -> DataFrame:
    """{"results": [{"station", "date", "datatype", "value"}]}; TAVG in tenths."""
    raw = spark.read.schema("results array<struct<station: string, date: string, datatype: string, value: double>>").option("multiLine", True).json(path)
    r = raw.select(F.explode("results").alias("r")).where("r.datatype = 'TAVG'")
    return r.select("r.station", F.to_date(F.substring("r.date", 1, 10)).alias("date"), (F.col("r.value") / 10).alias("tavg_f"))


def column_arrays(spark: SparkSession, path: str, columns: tuple[str, ...]) -> DataFrame:
    """{"city", "daily": {"time": [...], col: [...]}} -> one row a day."""
    fields = ", ".join(["time: array<string>", *(f"{c}: array<double>" for c in columns)])
    raw = spark.read.schema(f"city string, daily struct<{fields}>").option("multiLine", True).json(path)
    z = raw.select("city", F.explode(F.arrays_zip("daily.time", *[f"daily.{c}" for c in columns])).alias("d"))
    return z.select("city", F.col("d.time").try_cast("date").alias("date"), *[F.col(f"d.{c}").alias(c) for c in columns])


def timeline(spark: SparkSession, path: str, value: str = "tone") -> DataFrame:
    """Time, value lines, by comma or, where there is none, by white space."""
    t = spark.read.text(path)
    parts = F.when(F.contains("value", F.lit(",")), F.split("value", r"\s*,\s*")).otherwise(F.split(F.trim("value"), r"\s+"))
    p = t.select(parts.alias("p"))
    digits = F.regexp_replace(F.get("p", 0), "[^0-9]", "")
    ts = F.coalesce(F.try_to_timestamp(F.substring(digits, 1, 14), F.lit("yyyyMMddHHmmss")), F.try_to_timestamp(F.substring(digits, 1, 8), F.lit("yyyyMMdd")))
    return p.select(ts.alias("ts"), F.element_at("p", -1).try_cast("double").alias(value)).where(f"ts is not null and {value} is not null")


def risk_index(pages, spark: SparkSession) -> DataFrame:
    """A spreadsheet read on the driver by pandas: first date-like and index-like
    column (spreadsheet readers are optional and not shipped here)."""
    names = list(pages.columns)
    date = next(c for c in names if str(c).lower() in ("date", "day", "month"))
    value = next(c for c in names if str(c).upper().startswith("GPR"))
    return spark.createDataFrame(pages[[date, value]].rename(columns={date: "date", value: "gpr"}))


def articles_json(spark: SparkSession, path: str) -> DataFrame:
    raw = spark.read.schema("query string, articles array<struct<title: string, description: string, content: string, url: string, publishedAt: string, source: struct<name: string>>>").option("multiLine", True).json(path)
    a = raw.select("query", F.explode("articles").alias("a"))
    return a.select(F.md5("a.url").alias("article_id"), "a.title", "a.description", "a.content", "a.url", F.col("a.source.name").alias("source"), "query", F.try_to_timestamp("a.publishedAt").alias("published_at"))


def articles_rss(spark: SparkSession, path: str) -> DataFrame:
    """RSS items by Spark's XML reader."""
    raw = spark.read.format("xml").option("rowTag", "item").schema("title string, description string, link string, pubDate string").load(path)
    at = F.try_to_timestamp(F.regexp_replace("pubDate", r"^[A-Za-z]{3}, ", ""), F.lit("d MMM yyyy HH:mm:ss Z"))
    return raw.select(F.md5("link").alias("article_id"), "title", "description", F.col("description").alias("content"), F.col("link").alias("url"), F.lit("rss").alias("source"), F.lit(None).cast("string").alias("query"), at.alias("published_at"))


def all_articles(*parts: DataFrame) -> DataFrame:
    """Union, the first of each id, newest first."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    w = Window.partitionBy("article_id").orderBy("published_at", "source")
    return out.withColumn("_i", F.row_number().over(w)).where("_i = 1").drop("_i").orderBy(F.col("published_at").desc())


def documents(spark: SparkSession, path: str, parsers: dict[str, Callable[[bytes], list[str]]] | None = None) -> DataFrame:
    """Files under a folder to pages by extension; unknown extensions are skipped.

    Text and CSV are built in; parsers for other kinds (PDF, spreadsheets, images)
    are passed in.
    """
    handlers = {"txt": lambda b: [b.decode("utf-8", "replace")], "md": lambda b: [b.decode("utf-8", "replace")], "csv": lambda b: [b.decode("utf-8", "replace")], **(parsers or {})}
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)

    def run(batches):
        import pandas as pd

        for rows in batches:
            out = []
            for r in rows.itertuples():
                name = r.path.rsplit("/", 1)[-1]
                pages = handlers.get(name.rsplit(".", 1)[-1].lower(), lambda b: [])(r.content)
                out += [(p, i + 1, r.path, name, len(pages)) for i, p in enumerate(pages)]
            yield pd.DataFrame(out, columns=["text", "page_number", "source", "filename", "total_pages"])

    return files.mapInPandas(run, "text string, page_number int, source string, filename string, total_pages int")


def cached(spark: SparkSession, path: str, fetch: Callable[[], DataFrame]) -> DataFrame:
    """The landed table if it is there, else what ``fetch`` gives, landed first."""
    jpath = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    if not jpath.getFileSystem(spark._jsc.hadoopConfiguration()).exists(jpath):
        fetch().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def refreshed(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Old and new rows, the new one where both have a key."""
    both = old.withColumn("_v", F.lit(0)).unionByName(new.withColumn("_v", F.lit(1)), allowMissingColumns=True)
    w = Window.partitionBy(*keys).orderBy(F.col("_v").desc())
    return both.withColumn("_i", F.row_number().over(w)).where("_i = 1").drop("_i", "_v")


def write_table(df: DataFrame, path: str, by: tuple[str, ...] = ()) -> None:
    w = df.write.mode("overwrite")
    (w.partitionBy(*by) if by else w).parquet(path)


def upsert_vectors(chunks: DataFrame, path: str) -> None:
    """Appends (id, embedding, metadata) with ids file_page_chunk."""
    key = F.concat_ws("_", "filename", F.concat(F.lit("p"), F.col("page_number").cast("string")), F.concat(F.lit("c"), F.col("chunk_index").cast("string")))
    meta: Column = F.create_map(F.lit("source"), F.col("source"), F.lit("filename"), F.col("filename"), F.lit("page_number"), F.col("page_number").cast("string"))
    chunks.select(key.alias("id"), "text", "embedding", meta.alias("metadata")).write.mode("append").parquet(path)
