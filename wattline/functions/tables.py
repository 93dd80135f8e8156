"""Tables written between steps."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame


def settle(df: DataFrame) -> DataFrame:
    """Write ``df`` under ``spark.checkpoint.dir`` and read it back, which cuts the lineage.

    Where that is unset, a local session uses a folder under the warehouse; on a cluster that
    is an error, as the driver's and the executors' own folders are not shared.
    """
    spark = df.sparkSession
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.conf.get("spark.master", "local").startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_wattline"
    path = f"{root.rstrip('/')}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
