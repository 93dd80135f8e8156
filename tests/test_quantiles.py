"""Order statistics by ranges against sorted lists."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from wattline.functions import quantiles as qs
from wattline.operators import risk

PROBS = [0.0, 0.01, 0.25, 0.5, 0.333, 0.99, 1.0]


def frame(spark, groups):
    return spark.createDataFrame([(k, None if v is None else float(v)) for k, vs in groups.items() for v in vs], "k string, x double")


@pytest.mark.parametrize("parts", [1, 5])
def test_quantiles_are_those_of_the_sorted_values(spark, parts):
    rng = np.random.default_rng(1)
    groups = {"a": rng.normal(size=501), "b": rng.integers(0, 4, 300), "c": [3.0], None: rng.normal(size=40), "hot": np.r_[np.full(900, 7.0), rng.normal(size=30)]}
    df = frame(spark, {k: [*v, None] for k, v in groups.items()} | {"none": [None]}).repartition(parts)
    got = {r.k: r.q for r in qs.quantiles(df, "x", PROBS, ("k",)).collect()}
    assert got.keys() == groups.keys()
    for k, v in groups.items():
        assert np.allclose(got[k], np.quantile(np.array(v, float), PROBS), atol=1e-12), k
    whole = qs.quantiles(df, "x", PROBS).first().q
    assert np.allclose(whole, np.quantile(np.concatenate([np.array(v, float) for v in groups.values()]), PROBS), atol=1e-12)
    assert qs.quantiles(df.limit(0), "x", PROBS, ("k",)).count() == 0


def test_many_ranks_of_one_group(spark):
    values = sorted([float(x % 700) for x in range(2000)])
    ranges = qs.Ranges(spark.createDataFrame([(v,) for v in values], "x double"), "x")
    asked = spark.range(2500).select(F.col("id").alias("rank"), (F.col("id") * 2).alias("tag"))
    got = {(r["rank"], r.tag): r.value for r in ranges.at(asked).collect()}
    assert got == {(i, 2 * i): values[i] for i in range(2000)}


def test_a_group_is_dealt_over_many_tasks(spark):
    """No part holds more than a share of a group's values, however large the group."""
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        ranges = qs.Ranges(spark.range(40_000).select((F.col("id") * 7919 % 40_000).cast("double").alias("x")), "x")
        sizes = [r.n for r in ranges.rows.groupBy("_part").agg(F.sum("_n").alias("n")).collect()]
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    assert len(sizes) >= 4 and max(sizes) < 2 * 40_000 / len(sizes)


def test_bootstrap_draws_from_the_returns(spark):
    """Against resampling in numpy; and the draws are spread over the sorted returns."""
    rng = np.random.default_rng(3)
    returns = rng.standard_t(4, size=400) * 0.01
    df = spark.createDataFrame([(i, float(r)) for i, r in enumerate(returns)], "date int, ret double")
    for horizon in (1, 10):
        got = risk.bootstrap(df, 0.95, horizon, sims=4000)
        again = risk.bootstrap(df.repartition(3), 0.95, horizon, sims=4000)
        draws = rng.choice(returns, size=(200_000, horizon)).sum(axis=1)
        var = -np.quantile(draws, 0.05)
        cvar = -draws[draws <= -var].mean()
        row, same = got.first(), again.first()
        assert abs(row["var"] / var - 1) < 0.08 and abs(row.cvar / cvar - 1) < 0.08
        assert abs(row["var"] - same["var"]) < 1e-12
