"""Shared column expressions and session helpers of the training-data operators."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a longest run of characters other than blank, tab, \n, \v, \f and \r.
SPACE = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"
#: The same characters as bytes, for the numpy kernels.
SPACE_BYTES = (0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D)


def words(text: Column) -> Column:
    """Array of the words of a text; empty for null or blank texts."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACE), "")


def count_words(text: Column) -> Column:
    """Number of words, as long; 0 for null."""
    return F.size(words(text)).cast("long")


def let(value: Column, body) -> Column:
    """``body(v)`` with ``value`` evaluated once a row.

    A lambda variable is the one place where Catalyst will not inline an
    expression again at each use, which matters inside higher-order functions.
    """
    return F.element_at(F.transform(F.array(value), body), 1)


def free(name: str, *frames: DataFrame) -> str:
    """``name``, with underscores before it until no column of ``frames`` is called so."""
    taken = {c.lower() for f in frames for c in f.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def shared_dir(spark: SparkSession) -> str:
    """A new folder name under the shared folder that the cluster names.

    Reads ``spark.checkpoint.dir``.  Where it is unset, a local session (tests, one
    machine) uses a folder under the warehouse; on a cluster that is an error, as
    the driver's and the executors' own folders are not shared.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.conf.get("spark.master", "local").startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_wattline"
    return f"{root.rstrip('/')}/{uuid.uuid4().hex}"


def settle(df: DataFrame) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back.

    Cuts the lineage so that later steps neither recompute the input nor depend
    on the executors that made it.
    """
    spark = df.sparkSession
    path = shared_dir(spark)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_rows(docs: DataFrame, key: dict[str, Column], gone: DataFrame, twice: DataFrame) -> DataFrame:
    """``docs`` without the rows whose key is in ``gone``, and one of those with each
    key in ``twice``.

    ``key`` maps the key's names in ``gone`` and ``twice`` to expressions over
    ``docs``; nulls are equal.  The rare repeated rows are combined on the map side,
    so a row that is read very many times costs one row a task.
    """

    def meet(rows: DataFrame, other: DataFrame, how: str) -> DataFrame:
        named = other.select(*[F.col(k).alias(free(f"_{k}", docs)) for k in key])
        same = None
        for k, value in key.items():
            equal = value.eqNullSafe(F.col(free(f"_{k}", docs)))
            same = equal if same is None else same & equal
        return rows.join(named, same, how)

    if twice.isEmpty():
        return meet(docs, gone, "left_anti")
    rest = meet(docs, gone.select(*key).union(twice.select(*key)), "left_anti")
    names = {k: free(f"_{k}", docs) for k in key}
    once = meet(docs, twice, "left_semi").withColumns({names[k]: value for k, value in key.items()}).dropDuplicates(list(names.values()))
    return rest.unionByName(once.drop(*names.values()))


def small_batches(spark: SparkSession, limit: int = 8 << 20) -> None:
    """Bounds the bytes of an Arrow batch in this session, if the bound is larger.

    Texts may be long, and a batch is in memory on both sides of the pipe.
    """
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if int(spark.conf.get(key).rstrip("b")) > limit:
        spark.conf.set(key, f"{limit}b")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
