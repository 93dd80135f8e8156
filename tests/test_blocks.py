"""Blocks with a halo against one window over the whole series."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from tests.oracle import SF, compare
from wattline.functions import blocks
from wattline.functions.ts import Series
from wattline.functions.ts import expanding_rank as rank_in_one_task
from wattline.plans import registry


def series(spark, n=331, seed=2):
    rng = np.random.default_rng(seed)
    rows = [(i * 3 + 5, None if rng.random() < 0.3 else float(rng.integers(0, 40))) for i in range(n)]
    return spark.createDataFrame(rows, "date long, x double").repartition(7)


def values(df, name):
    return [r[name] for r in sorted(df.collect(), key=lambda r: r["date"])]


def same(a, b):
    assert len(a) == len(b)
    assert all((x is None) == (y is None) and (x is None or abs(x - y) < 1e-12) for x, y in zip(a, b, strict=True))


@pytest.mark.parametrize("block", [7, 50, 1000])
def test_blocks_give_what_one_window_gives(spark, block):
    df = series(spark)
    n = blocks.numbered(df)
    assert values(n, "_i") == list(range(331))
    s = Series((), ["date"])
    build = lambda s, rows: rows.withColumn("m", s.mean("x", 30, 10)).withColumn("d", s.diff("m", 4))
    for name in ("m", "d"):
        same(values(blocks.rolling(n, build, 33, block=block), name), values(build(s, df), name))
    same(values(blocks.carried(n, "x", "f", block=block), "f"), values(df.withColumn("f", s.ffill("x")), "f"))
    same(values(blocks.carried(n, "x", "b", True, block=block), "b"), values(df.withColumn("b", s.bfill("x")), "b"))
    same(values(blocks.running(n, {"t": "x"}, block=block), "t"), values(df.withColumn("t", s.cumsum("x")), "t"))
    same(values(blocks.expanding_rank(n, "x", "r", 20, block=block), "r"), values(rank_in_one_task(df, [], ["date"], "x", "r", 20), "r"))


def test_keys_and_exponential_means(spark):
    rng = np.random.default_rng(4)
    frame = pd.DataFrame({"k": ["a"] * 200 + ["b"] * 90, "date": [*range(200), *range(90)], "x": rng.normal(size=290)})
    n = blocks.numbered(spark.createDataFrame(frame), keys=("k",))
    out = blocks.running(blocks.carried(n, "x", "f", keys=("k",), block=40), {"t": "x"}, keys=("k",), block=40).toPandas().sort_values(["k", "date"])
    assert np.allclose(out["t"], frame.groupby("k")["x"].cumsum()) and (out["f"] == out["x"]).all()
    alpha, halo = 0.4, blocks.ewm_halo(0.4)
    weights = F.transform(F.collect_list("x").over(Window.partitionBy("k", "_block").orderBy("_i").rowsBetween(-halo, 0)), lambda v: v)

    def build(s, rows):
        return rows.withColumn("e", F.aggregate(weights, F.lit(None).cast("double"), lambda a, v: F.coalesce(a * (1 - alpha) + v * alpha, v)))

    got = blocks.rolling(n, build, halo, ("k",), block=30).toPandas().sort_values(["k", "date"])
    want = frame.groupby("k")["x"].transform(lambda v: v.ewm(alpha=alpha, adjust=False).mean())
    assert np.allclose(got["e"], want, atol=1e-12)
    assert blocks.ewm_halo(1.0) == 1


def test_composite_runs_in_many_tasks_with_the_same_result(spark, monkeypatch):
    monkeypatch.setattr(blocks, "BLOCK", 300)
    df = registry.queries()["composite_signal"](spark, SF)
    compare(df, registry.oracle_sql()["composite_signal"])


def test_an_empty_series(spark):
    n = blocks.numbered(series(spark).limit(0))
    assert blocks.rolling(n, lambda s, rows: rows.withColumn("m", s.mean("x", 3)), 2).count() == 0
    assert blocks.expanding_rank(n, "x", "r").count() == blocks.carried(n, "x", "f").count() == 0
