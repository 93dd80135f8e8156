"""Models, folds and composite parts against plain numpy and pandas."""

import itertools

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from tests.oracle import SF
from wattline.operators import backtest, ml, risk, signals
from wattline.plans import registry


def frame(spark, **columns):
    return spark.createDataFrame(pd.DataFrame(columns))


def series(n, seed=1):
    rng = np.random.default_rng(seed)
    return pd.DataFrame({"date": pd.date_range("2015-01-01", periods=n).date, "x": rng.normal(size=n), "z": rng.normal(size=n), "y": rng.normal(size=n)})


def test_expanding_forecast_is_least_squares_on_the_rows_before(spark):
    df = pd.concat([series(90, i).assign(k=k) for i, k in enumerate("ab")])
    df["y"] += 3 * df["x"] - 2 * df["z"] + 1
    got = ml.expanding_forecast(spark.createDataFrame(df), ["x", "z"], "y", 40, 7, ("k",)).toPandas().sort_values(["k", "date"])
    want = []
    for _, g in df.sort_values(["k", "date"]).groupby("k"):
        a, y = np.column_stack([np.ones(len(g)), g["x"], g["z"]]), g["y"].to_numpy()
        for i in range(40, len(g)):
            cut = 40 + (i - 40) // 7 * 7
            want.append(a[i] @ np.linalg.lstsq(a[:cut], y[:cut], rcond=None)[0])
    assert len(got) == len(want) and np.allclose(got["prediction"], want, atol=1e-5)


def test_forecast_queries_cover_every_later_row(spark):
    for name, first in (("dispatch_forecast", 252), ("demand_backcast", 365)):
        got = registry.queries()[name](spark, SF).toPandas()
        assert len(got) and got["prediction"].notna().all(), name
    regions = registry.queries()["region_report"](spark, SF).count()
    dispatch = registry.queries()["dispatch_forecast"](spark, SF).groupBy("region").count().count()
    assert dispatch == regions


def test_decoded_states_are_the_likeliest_sequence():
    rng = np.random.default_rng(3)
    x = rng.normal(size=(7, 2)) + np.array([0, 1])
    means, covs = np.array([[0.0, 0.5], [0.3, 1.5]]), np.array([np.eye(2), 2 * np.eye(2)])
    trans, start = np.array([[0.9, 0.1], [0.3, 0.7]]), np.array([0.6, 0.4])
    dens = np.log(np.column_stack([signals._density(x, means[k], covs[k]) for k in range(2)]))

    def score(path):
        return np.log(start[path[0]]) + dens[0, path[0]] + sum(np.log(trans[a, b]) + dens[t + 1, b] for t, (a, b) in enumerate(itertools.pairwise(path)))

    best = max(itertools.product(range(2), repeat=7), key=score)
    assert tuple(signals.decode(x, means, covs, trans, start)) == best


def test_regime_follows_calm_and_stormy_years(spark):
    rng = np.random.default_rng(5)
    vol = np.where((np.arange(1100) // 130) % 2 == 0, 0.002, 0.03)
    df = pd.DataFrame({"symbol": "a", "date": pd.date_range("2015-01-01", periods=1100).date, "close": 100 * np.exp(np.cumsum(rng.normal(size=1100) * vol))})
    got = signals.regime(spark.createDataFrame(df), ["symbol"]).toPandas().sort_values("date")
    late = got["regime_signal"].to_numpy()[560:]
    calm = vol[560:] < 0.01
    assert (late[calm] > 0).mean() > 0.8 and (late[~calm] < 0).mean() > 0.8 and set(got["regime_signal"][:525]) == {0.0}


def test_strategy_folds(spark):
    n = 365 * 7
    df = pd.DataFrame({"date": pd.date_range("2010-01-01", periods=n).date, "close": np.linspace(50, 90, n), "signal": 1, "position_size": 0.5})
    got = signals.walk_forward(spark.createDataFrame(df)).groupBy("fold").agg(F.min("date").alias("a"), F.max("date").alias("b")).toPandas().sort_values("fold")
    first, last = df["date"].iloc[0], df["date"].iloc[-1]
    start, want = pd.Timestamp(first) + pd.DateOffset(years=5), []
    while start < pd.Timestamp(last):
        end = min(start + pd.DateOffset(months=6), pd.Timestamp(last))
        want.append((start.date(), end.date()))
        start = end
    want = [w for w in want if (w[1] - w[0]).days + 1 >= 10]
    assert list(zip(got["a"], got["b"], strict=True)) == want
    report = registry.queries()["strategy_walk_forward"](spark, SF).toPandas()
    assert len(report) >= 2 and report["sharpe"].notna().all() and (report["max_drawdown"] <= 0).all()
    assert signals.walk_forward(spark.createDataFrame(df[:400])).count() == 0


def test_dashboard_agrees_with_its_parts(spark):
    got = registry.queries()["risk_dashboard"](spark, SF).toPandas()
    assert set(got["section"]) == {"var", "component", "stress", "tail"}
    assert len(got[got["section"] == "stress"]) == len(risk.SCENARIOS)
    again = registry.queries()["stress_scenarios"](spark, SF).toPandas().set_index("scenario")["pnl"]
    for row in got[got["section"] == "stress"].itertuples():
        assert abs(row.value - again[row.item]) < 1e-3


def test_reverse_stress_by_factor(spark):
    df = spark.createDataFrame([("a", 100.0, "power"), ("b", -40.0, None), ("c", 5.0, "oil"), ("d", -5.0, "oil")], "asset string, notional double, factor string")
    got = {r.factor: r.shock for r in risk.reverse_stress(df, 10).collect()}
    assert got == {"power": -0.1, "natural_gas": 0.25}


def test_trade_statistics(spark):
    df = spark.createDataFrame([("a", 0.1), ("a", -0.05), ("a", 0.0), ("b", 0.2), ("b", None)], "k string, pnl_pct double")
    got = {r.k: r for r in backtest.trade_statistics(df, ("k",)).collect()}
    assert got["a"].win_rate == 1 / 3 and abs(got["a"].profit_factor - 2) < 1e-12 and got["a"].worst_trade == -0.05
    assert got["b"].profit_factor is None and got["b"].total_trades == 1
    assert backtest.trade_statistics(df.limit(0), ("k",)).count() == 0


def test_sentiment_uses_momentum_where_there_is_no_z(spark):
    p = frame(spark, date=pd.date_range("2020-01-01", periods=3).date)
    tone = frame(spark, date=pd.date_range("2020-01-02", periods=1).date, tone_momentum=[-1.0])
    got = [r.sentiment_signal for r in signals.sentiment_on(p, tone).orderBy("date").collect()]
    assert np.allclose(got, [0.0, 0.3, 0.3])
    assert [r.sentiment_signal for r in signals.sentiment_on(p).collect()] == [0.0] * 3


def test_columns_by_name_and_by_nulls(spark):
    names = ["target", "gen_lag_1d", "east_total_mwh", "east_avg_mw", "gen_total_mwh", "month"]
    assert ml.feature_columns(names, ("target",), ("_total_mwh", "_avg_mw"), ("gen",)) == ["gen_lag_1d", "gen_total_mwh", "month"]
    df = spark.createDataFrame([(1, None, None), (2, 3.0, None), (3, 4.0, None), (4, 5.0, None)], "a long, b double, c double")
    assert ml.sparse_columns(df).columns == ["a", "b"] and ml.sparse_columns(df, 0.2).columns == ["a"]
    assert ml.sparse_columns(df.limit(0)).columns == []


def test_permutation_does_not_depend_on_partitions(spark):
    df = spark.range(500).selectExpr("id", "cast(id % 3 = 0 as int) as a", "cast(id % 2 = 0 as int) as p")
    one, two = (ml.permutation_test(d, "a", "p", rounds=20, on="id").first() for d in (df.repartition(1), df.repartition(5)))
    assert np.allclose(list(one), list(two)) and 0 <= one.p_value <= 1


def test_position_book_covers_every_account(spark):
    got = registry.queries()["position_book"](spark, SF)
    accounts = spark.read.parquet(f"{SF}/events.parquet").select("user_id").distinct().count()
    assert got.select("account").distinct().count() == accounts


def _logistic(x, y, at, penalty=1.0):
    """Probability at ``at`` by the penalised likelihood, found by Newton steps."""
    a, w = np.column_stack([np.ones(len(x)), x]), np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-a @ w))
        grad = a.T @ (p - y) / len(x) + penalty * np.array([0, w[1]])
        w -= np.linalg.solve((a * (p * (1 - p))[:, None]).T @ a / len(x) + penalty * np.diag([0, 1.0]), grad)
    return 1 / (1 + np.exp(-(w[0] + w[1] * at)))


def test_experiments_match_ridge_on_each_fold(spark):
    n = 120
    rng = np.random.default_rng(9)
    x = rng.normal(size=n)
    price = np.exp(np.cumsum(np.r_[0, 0.01 * x[:-1] + 0.001 * rng.normal(size=n - 1)]))
    df = pd.DataFrame({"date": pd.date_range("2020-01-01", periods=n).date, "x": x, "close": price})
    df.loc[4, "x"] = None
    got = ml.experiments(spark.createDataFrame(df), ["x"], "close", ml.linear_models(), horizons=(1, 5), folds=3).toPandas()
    assert {(r.horizon, r.kind, r.model) for r in got.itertuples()} == {(h, k, m) for h in (1, 5) for k, m in (("regression", "ridge"), ("classification", "logistic"))}
    for h in (1, 5):
        y = np.log(price[h:] / price[:-h])[::h]
        f = np.nan_to_num(df["x"].to_numpy(dtype=float)[: n - h][::h])
        size, mae, hits = len(y) // 4, [], []
        for k in range(3):
            a, b = size * (k + 1), size * (k + 2)
            # Spark penalises standardised slopes of a standardised label.
            sx, sy = f[:a].std(ddof=1), y[:a].std(ddof=1)
            u, v = (f[:a] - f[:a].mean()) / sx, (y[:a] - y[:a].mean()) / sy
            slope = (u @ v / a) / (u @ u / a + 1.0 / sy) * sy / sx
            hits.append(((_logistic(u, y[:a] > 0, (f[a:b] - f[:a].mean()) / sx) > 0.5) == (y[a:b] > 0)).mean())
            mae.append(np.abs(y[a:b] - (y[:a].mean() + slope * (f[a:b] - f[:a].mean()))).mean())
        mine = got[(got.horizon == h) & (got.kind == "regression")].set_index("metric")
        assert mine.samples.iloc[0] == len(y)
        assert np.isclose(mine.loc["mae", "mean"], np.mean(mae), rtol=0.05)
        accuracy = got[(got.horizon == h) & (got.metric == "accuracy")]["mean"].iloc[0]
        assert np.isclose(accuracy, np.mean(hits)), h


def test_class_scores(spark):
    df = spark.createDataFrame([(1.0, 1.0), (1.0, 0.0), (0.0, 1.0), (0.0, 0.0), (1.0, 1.0)], "target double, prediction double")
    s = ml.class_scores(df)
    assert s == {"accuracy": 0.6, "precision": 2 / 3, "f1": 4 / 6}
    assert ml.class_scores(df.where("false")) == {"accuracy": 0.0, "precision": 0.0, "f1": 0.0}
