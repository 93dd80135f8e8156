"""Panels, slices and report frames on small frames with gaps, ties and nothing in them."""

import datetime as dt
import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from wattline.operators import energy, features, ml, report, retrieval, risk, signals
from wattline.plans import frames as fr
from wattline.plans.energy import _tone

DAY = dt.date(2024, 1, 1)


def days(n):
    return [DAY + dt.timedelta(days=i) for i in range(n)]


def test_weather_matches_pandas(spark):
    rng = np.random.default_rng(3)
    rows, weights = [], {"x": 3.0, "y": 1.0, "z": 2.0, "none": 50.0}
    for city in "xyz":
        for d in days(40):
            if rng.random() < 0.85:
                rows.append((city, d, *(None if rng.random() < 0.1 else float(v) for v in rng.uniform(0, 100, 3)), float(rng.integers(0, 360))))
    df = spark.createDataFrame(rows, "city string, date date, tavg double, wind_speed_max double, wind_gusts_max double, wind_dir_dominant double")
    w = spark.createDataFrame(list(weights.items()), "city string, weight double")
    got = energy.weather_days(df, w, by_city=("y",)).toPandas().sort_values("date").set_index("date")
    pdf = pd.DataFrame(rows, columns=df.columns)
    values, total = ["tavg", "wind_speed_max", "wind_gusts_max"], 6.0
    combined = None
    for city in "xyz":
        part = pdf[pdf["city"] == city].set_index("date")[values].astype(float) * weights[city] / total
        combined = part if combined is None else combined.add(part, fill_value=0)
    combined = combined.dropna(how="all").sort_index()
    for c in values:
        assert np.allclose(got[c].astype(float), combined[c], equal_nan=True)
    assert np.allclose(got["hdd"].astype(float), (65 - combined["tavg"]).clip(lower=0), equal_nan=True)
    assert np.allclose(got["cdd_7d"].astype(float), (combined["tavg"] - 65).clip(lower=0).rolling(7).mean(), equal_nan=True)
    assert np.allclose(got["gust_ratio"].astype(float), combined["wind_gusts_max"] / combined["wind_speed_max"].clip(lower=0.1), equal_nan=True)
    top = pdf[pdf["city"] == "x"].set_index("date")["wind_dir_dominant"].reindex(combined.index)
    assert np.allclose(got["wind_dir_dominant"].astype(float), top, equal_nan=True)
    assert "rain_flag" not in got.columns and energy.weather_days(df.limit(0), w).count() == 0


def test_east_demand_needs_every_region_and_drops_what_lies_far_out(spark):
    rows = [(g, d, 100.0 + i % 5, 10.0, 1.0, 5.0, 0.5) for i, d in enumerate(days(200)) for g in ("A", "B")]
    rows = [r for r in rows if not (r[0] == "B" and r[1] == DAY)]
    rows = [(r[0], r[1], 1e9 if r[1] == days(200)[50] else r[2], *r[3:]) for r in rows]
    daily = spark.createDataFrame(rows, "region string, date date, total_mwh double, peak_mw double, min_mw double, avg_mw double, load_factor double")
    got = energy.east_demand(daily, ("A", "B")).toPandas()
    assert len(got) == 198 and DAY not in set(got["date"]) and got["east_total_mwh"].max() < 300
    assert (got["east_peak_mw"] == 20).all() and {"a_total_mwh", "b_load_factor"} <= set(got.columns)
    assert energy.east_demand(daily.limit(0), ("A", "B")).count() == 0


def test_east_generation_carries_two_rows(spark):
    columns = "total_mwh peak_mw min_mw avg_mw cf variability ramp".split()
    rows = [("A", "wnd", DAY, *[1.0] * 7)] + [("B", "sun", d, *[2.0] * 7) for d in days(5)]
    daily = spark.createDataFrame(rows, "region string, fuel string, date date, " + ", ".join(f"{c} double" for c in columns))
    got = energy.east_generation(daily, (("A", "wnd"), ("B", "sun")), {"wnd": "east_wind_total_mwh", "sun": "east_solar_total_mwh"}).toPandas().sort_values("date")
    assert got["a_wnd_cf"].fillna(-1).tolist() == [1.0, 1.0, 1.0, -1.0, -1.0]
    assert got["east_wind_total_mwh"].tolist() == [1.0, 0.0, 0.0, 0.0, 0.0] and got["east_solar_total_mwh"].tolist() == [2.0] * 5


def test_spread_is_of_days_with_both_rates(spark):
    rows = [("ten", days(3)[0], 4.0), ("two", days(3)[0], 3.0), ("two", days(3)[2], 1.0)]
    got = features.macro_panel(spark.createDataFrame(rows, "series string, date date, value double"), ["ten", "two"], spread=("ten", "two")).orderBy("date").collect()
    assert [(r["ten"], r["two"], r["yield_spread_10y2y"]) for r in got] == [(4.0, 3.0, 1.0), (4.0, 3.0, 1.0), (4.0, 1.0, 1.0)]


def test_feature_matrix_carries_macro_and_sentiment(spark):
    sf = "/root/testdata/sf0.001"
    prices = fr.market(spark, sf)
    macro = spark.createDataFrame([(dt.date(1994, 3, 1), 7.0, 1.0), (dt.date(1995, 5, 5), None, 2.0)], "date date, rate double, close double")
    got = features.build(prices, macro=macro, sentiment=_tone(spark, sf)).toPandas().sort_values("date").reset_index(drop=True)
    index = pd.Index(prices.toPandas()["date"].sort_values())
    for table, columns in ((macro, ["rate"]), (_tone(spark, sf), ["index_7d", "momentum_14d", "sentiment_regime"])):
        want = table.toPandas().set_index("date")[columns].astype(float).reindex(index).ffill().reindex(pd.Index(got["date"])).bfill()
        for c in columns:
            assert np.allclose(got[c].astype(float), want[c], equal_nan=True), c
    assert got["close"].nunique() > 2  # a column that is there already is not replaced


def test_rows_and_columns_without_values(spark):
    df = spark.createDataFrame([(1, None, 1.0, None), (2, None, None, 3.0), (3, None, 1.0, 1.0)], "i int, a double, b double, `c.d` double")
    kept = features.without_empty_columns(df)
    assert kept.columns == ["i", "b", "c.d"] and kept.count() == 3
    x = df.toDF("i", "a", "b", "c")
    assert [r["i"] for r in features.dense_rows(x, ["b", "c"], 0.5).collect()] == [3]
    assert features.dense_rows(x, ["b", "c"], 0.6).count() == 3


@pytest.mark.parametrize("x", [0.0, 1e-9, 0.3, 3.841458820694124, 12.5, 60.0, 500.0])
def test_chi_squared_tail(spark, x):
    got = spark.range(1).select(risk.chi2_tail(F.lit(x)).alias("p")).first()["p"]
    assert got == pytest.approx(math.erfc(math.sqrt(x / 2)), abs=2e-15)


def test_slices_of_nothing_and_of_ties(spark):
    schema = "date date, actual double, pred double, hit int"
    none = spark.createDataFrame([], schema)
    assert ml.regime_slices(none).count() == ml.magnitude_slices(none).count() == ml.worst_misses(none, ["date"]).count() == 0
    same = spark.createDataFrame([(d, 0.01, 0.5, i % 2) for i, d in enumerate(days(8))], schema)
    assert {r["slice"]: r["n"] for r in ml.regime_slices(same).collect()} == {"all": 8, "low volatility": 8, "small moves": 8, "up": 8}
    assert [(r["low"], r["high"], r["n"]) for r in ml.magnitude_slices(same).collect()] == [(0.5, 0.5, 8)]
    assert [r["date"] for r in ml.worst_misses(same, ["date"], n=2).collect()] == [days(8)[0], days(8)[2]]


def test_sizes(spark):
    rows = [(1.0, 0.5, 0.6, 2.0), (-0.3, None, None, None), (0.0, 0.1, 0.9, 2.0), (1.0, 0.0, 0.1, 1.0), (1.0, 0.01, 0.5, 0.0)]
    df = spark.createDataFrame(rows, "s double, v double, w double, b double")
    size = signals.position_size
    got = df.select(size("s", "v").alias("a"), size("s", "v", "kelly", F.col("w"), F.col("b")).alias("k"), size("s", "v", "fixed").alias("f")).collect()
    assert [round(r["a"], 9) for r in got] == [0.2, -0.2, 0.0, 0.2, 0.2]
    assert [round(r["k"], 9) for r in got] == [0.1, -0.0625, 0.0, 0.0, 0.0]
    assert [r["f"] for r in got] == [0.02, -0.02, 0.0, 0.02, 0.02] and signals.kelly_size(0.1) == 0.0


@pytest.mark.parametrize("n, want", [(0, []), (5, list(range(1, 6))), (60, list(range(1, 61))), (75, [*range(1, 31), *range(66, 76)])])
def test_rendered_rows(spark, n, want):
    df = spark.range(n).select(F.col("id").alias("k"), F.when(F.col("id") % 2 == 0, F.col("id")).alias("v"))
    got = retrieval.render_table(df, "k").orderBy("row").collect()
    assert [r["row"] for r in got] == want and all(r["line"].split(" | ")[0] == str(r["row"] - 1) for r in got)


def test_statistics_match_pandas(spark):
    rows = [(float(i % 7), None if i % 3 else float(i)) for i in range(50)]
    got = {(r["column"], r["statistic"]): r["value"] for r in retrieval.describe_table(spark.createDataFrame(rows, "a double, b double"), ["a", "b"]).collect()}
    want = pd.DataFrame(rows, columns=["a", "b"]).describe()
    assert len(got) == 16 and all(got[c, s] == pytest.approx(want[c][s]) for c in "ab" for s in want.index)


def test_a_section_without_rows_says_so(spark):
    df = spark.createDataFrame([("x",)], "t string")
    got = report.note_lines({"one": (df, F.col("t")), "two": (df.limit(0), F.col("t"))}).orderBy("section_no").collect()
    assert [tuple(r) for r in got] == [(1, "one", "x"), (2, "two", "not available")]
