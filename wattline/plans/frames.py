"""Base tables of the queries, on Spark and, as CTEs, on DuckDB."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SQL = {
    "bars": """select o_orderpriority as symbol, cast(o_orderdate as date) as date,
  min_by(o_totalprice, o_orderkey) as open, max(o_totalprice) as high, min(o_totalprice) as low,
  max_by(o_totalprice, o_orderkey) as close, cast(count(*) as double) as volume
from orders group by o_orderpriority, cast(o_orderdate as date)""",
    "market": """select cast(o_orderdate as date) as date,
  min_by(o_totalprice, o_orderkey) as open, max(o_totalprice) as high, min(o_totalprice) as low,
  max_by(o_totalprice, o_orderkey) as close, cast(count(*) as double) as volume
from orders group by cast(o_orderdate as date)""",
    "hourly": """select event_type as region, date_trunc('hour', ts) as ts, sum(value) as mw
from events group by event_type, date_trunc('hour', ts)""",
    "weekly": """select cast(date_trunc('week', l_shipdate) as date) as date, sum(l_quantity) as level
from lineitem group by cast(date_trunc('week', l_shipdate) as date)""",
    "assets": """select l_returnflag as asset, cast(l_shipdate as date) as date, avg(l_extendedprice) as px
from lineitem group by l_returnflag, cast(l_shipdate as date)""",
    "returns": """select asset, date, ret from (
  select asset, date, px / lag(px) over (partition by asset order by date) - 1 as ret from assets) where ret is not null""",
    "articles": """select d.doc_id as article_id, split_part(d.text, chr(10), 1) as title, d.text as content, d.source, d.lang,
  date '2024-01-01' + cast(d.doc_id % 365 as int) as date,
  cast(coalesce(l.quality, 0) - coalesce(l.toxic, 0) as double) as net
from documents d left join labels l on d.doc_id = l.doc_id""",
}
NEEDS = {"returns": ("assets",)}


def ctes(*names: str) -> str:
    """``with a as (...), b as (...)`` for the named base tables."""
    wanted: list[str] = []
    for name in names:
        for n in (*NEEDS.get(name, ()), name):
            if n not in wanted:
                wanted.append(n)
    return "with " + ",\n".join(f"{n} as ({SQL[n]})" for n in wanted)


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _ohlcv(df: DataFrame, *keys) -> DataFrame:
    return df.groupBy(*keys, F.col("o_orderdate").cast("date").alias("date")).agg(
        F.min_by("o_totalprice", "o_orderkey").alias("open"),
        F.max("o_totalprice").alias("high"),
        F.min("o_totalprice").alias("low"),
        F.max_by("o_totalprice", "o_orderkey").alias("close"),
        F.count(F.lit(1)).cast("double").alias("volume"),
    )


def bars(spark, sf_dir) -> DataFrame:
    return _ohlcv(read(spark, sf_dir, "orders"), F.col("o_orderpriority").alias("symbol"))


def market(spark, sf_dir) -> DataFrame:
    return _ohlcv(read(spark, sf_dir, "orders"))


def hourly(spark, sf_dir) -> DataFrame:
    ts = F.date_trunc("hour", F.col("ts").cast("timestamp")).cast("timestamp_ntz")
    return read(spark, sf_dir, "events").groupBy(F.col("event_type").alias("region"), ts.alias("ts")).agg(F.sum("value").alias("mw"))


def weekly(spark, sf_dir) -> DataFrame:
    week = F.date_trunc("week", F.col("l_shipdate").cast("timestamp")).cast("date")
    return read(spark, sf_dir, "lineitem").groupBy(week.alias("date")).agg(F.sum("l_quantity").alias("level"))


def assets(spark, sf_dir) -> DataFrame:
    return read(spark, sf_dir, "lineitem").groupBy(F.col("l_returnflag").alias("asset"), F.col("l_shipdate").cast("date").alias("date")).agg(F.avg("l_extendedprice").alias("px"))


def returns(spark, sf_dir) -> DataFrame:
    from wattline.functions.ts import Series

    s = Series(["asset"], ["date"])
    return assets(spark, sf_dir).select("asset", "date", s.pct("px").alias("ret")).where("ret is not null")


def articles(spark, sf_dir) -> DataFrame:
    d, l = read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels").withColumnRenamed("doc_id", "_id")
    net = (F.coalesce("quality", F.lit(0)) - F.coalesce("toxic", F.lit(0))).cast("double")
    return d.join(l, F.col("doc_id") == F.col("_id"), "left").select(
        F.col("doc_id").alias("article_id"), F.substring_index("text", "\n", 1).alias("title"), F.col("text").alias("content"), "source", "lang",
        F.date_add(F.lit("2024-01-01").cast("date"), (F.col("doc_id") % 365).cast("int")).alias("date"), net.alias("net"),
    )


def rounded(df: DataFrame, places: int = 6, **own: int) -> DataFrame:
    """Doubles rounded for comparison across engines; -0.0 becomes 0.0."""
    out = []
    for f in df.schema.fields:
        c = F.col(f.name)
        out.append((F.round(c, own.get(f.name, places)) + 0.0).alias(f.name) if f.dataType.simpleString() == "double" else c)
    return df.select(*out)


def r(expr: str, name: str, places: int = 6) -> str:
    """The same rounding in DuckDB."""
    return f"round(cast({expr} as double), {places}) + 0e0 as {name}"
