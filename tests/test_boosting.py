"""Boosted trees against an exact greedy version, fit by fit."""

import numpy as np
import pandas as pd
import pytest

from tests.oracle import SF
from wattline.operators import boosting
from wattline.operators.boosting import Boost
from wattline.plans import registry


def greedy_boost(x, y, x_new, trees, depth, rate):
    """Exact splits, one node at a time, from the definition."""
    base = y.mean()
    rest, said = y - base, np.full(len(x_new), base)

    def grow(rows, new, level):
        value = rest[rows].mean()
        best = (1e-9, None, None)
        if level < depth:
            for f in range(x.shape[1]):
                values = np.unique(x[:, f])
                for cut in (values[1:] + values[:-1]) / 2:
                    left = rows[x[rows, f] <= cut]
                    right = rows[x[rows, f] > cut]
                    if len(left) and len(right):
                        gain = rest[left].sum() ** 2 / len(left) + rest[right].sum() ** 2 / len(right) - rest[rows].sum() ** 2 / len(rows)
                        if gain > best[0] + 1e-9:
                            best = (gain, f, cut)
        if best[1] is None:
            said[new] += rate * value
            steps[rows] = rate * value
            return
        _, f, cut = best
        grow(rows[x[rows, f] <= cut], new[x_new[new, f] <= cut], level + 1)
        grow(rows[x[rows, f] > cut], new[x_new[new, f] > cut], level + 1)

    for _ in range(trees):
        steps = np.zeros(len(y))
        grow(np.arange(len(y)), np.arange(len(x_new)), 0)
        rest = rest - steps
    return said


def history(n, seed):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, 3))
    return pd.DataFrame({"date": pd.date_range("2015-01-01", periods=n).date, "a": x[:, 0], "b": x[:, 1].round(1), "c": x[:, 2], "y": np.sin(2 * x[:, 0]) + (x[:, 1] > 0) + 0.1 * rng.normal(size=n)})


def test_a_fit_is_the_exact_greedy_one():
    df = history(90, 1)
    x, y = df[["a", "b", "c"]].to_numpy(), df["y"].to_numpy()
    got = boosting.fit(x[:70], y[:70], Boost(trees=12, depth=3)).predict(x[70:])
    assert np.allclose(got, greedy_boost(x[:70], y[:70], x[70:], 12, 3, 0.1), atol=1e-9)


@pytest.mark.parametrize("per_task", [1, 3, 50])
def test_expanding_trees_equal_one_fit_a_refit(spark, per_task):
    how = Boost(trees=8, depth=2)
    frames = [history(n, n).assign(k=k) for k, n in (("p", 75), ("q", 61), (None, 50), ("short", 40))]
    df = pd.concat(frames)
    df.loc[df.index == 5, "a"] = np.nan
    df = df.astype(object).where(df.notna(), None)
    sdf = spark.createDataFrame(df.to_dict("records"), "date date, a double, b double, c double, y double, k string")
    got = {(r.k, r.date): r.prediction for r in boosting.expanding_trees(sdf, ["a", "b", "c"], "y", 40, 7, ("k",), how=how, refits_per_task=per_task).collect()}
    want = {}
    for frame, k in zip(frames, ("p", "q", None, "short"), strict=True):
        g = frame.drop(index=5).reset_index(drop=True)
        x, y = g[["a", "b", "c"]].to_numpy(), g["y"].to_numpy()
        for i in range(40, len(g)):
            cut = 40 + (i - 40) // 7 * 7
            want[k, g["date"][i]] = greedy_boost(x[:cut], y[:cut], x[i : i + 1], 8, 2, 0.1)[0]
    assert got.keys() == want.keys()
    assert all(abs(got[j] - want[j]) < 1e-9 for j in want)


def test_later_rows_have_no_say(spark):
    df = history(80, 4)
    changed = df.copy()
    changed.loc[60:, ["a", "b", "c", "y"]] = 1e6
    runs = [boosting.expanding_trees(spark.createDataFrame(d), ["a", "b", "c"], "y", 40, 10, how=Boost(trees=5)).toPandas().sort_values("date") for d in (df, changed)]
    assert np.array_equal(runs[0]["prediction"][:20], runs[1]["prediction"][:20])


def test_stopping_by_the_last_rows_and_many_distinct_values():
    df = history(900, 7)
    x, y = df[["a", "b", "c"]].to_numpy(), df["y"].to_numpy()
    stopped = boosting.fit(x, np.random.default_rng(0).normal(size=900), Boost(trees=200, validation=0.1, patience=10))
    assert len(stopped.leaves) < 100
    few = boosting.fit(x[:800], y[:800], Boost(bins=32))
    assert 1 - ((few.predict(x[800:]) - y[800:]) ** 2).mean() / y[800:].var() > 0.9
    assert few.gains.argmax() == 0 and boosting.fit(np.ones((5, 2)), np.arange(5.0), Boost()).predict(np.ones((1, 2)))[0] == 2.0


def test_dispatch_query_has_residuals(spark):
    got = registry.queries()["dispatch_forecast"](spark, SF).toPandas()
    assert len(got) and got["prediction"].notna().all()
    assert np.allclose(got["residual"], got["gas_mwh"] - got["prediction"])
