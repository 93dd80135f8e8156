"""Unit checks of operators on small hand-made inputs."""

import collections
import datetime as dt
import itertools
import math
import re

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from wattline.functions.ts import Series, clip, ewm, expanding_rank, flag, span
from wattline.operators import align, backtest, ml, news, retrieval, risk, signals, stats, valuation
from wattline.operators.technical import Technical
from wattline.plans import frames, strategy, text
from wattline.sources import landing
from wattline.streaming import jobs

D0 = dt.date(2020, 1, 1)


def day(i):
    return D0 + dt.timedelta(days=i)


@pytest.fixture(scope="module")
def ohlcv(spark):
    rng = np.random.default_rng(42)
    n = 120
    close = np.maximum(70 + np.cumsum(rng.normal(size=n)), 10)
    high, low = close * (1 + rng.uniform(0, 0.02, n)), close * (1 - rng.uniform(0, 0.02, n))
    rows = [("X", day(i), float(close[i]), float(high[i]), float(low[i]), float(close[i]), float(rng.integers(1000, 9999))) for i in range(n)]
    return spark.createDataFrame(rows, "symbol string, date date, open double, high double, low double, close double, volume double")


def series(spark, values, name="x"):
    return spark.createDataFrame([("k", day(i), v) for i, v in enumerate(values)], f"key string, date date, {name} double")


def test_technical_bounds_and_names(ohlcv):
    out = Technical().all(ohlcv)
    p = out.toPandas()
    rsi = p["rsi"].dropna()
    assert ((rsi >= 0) & (rsi <= 100)).all() and len(rsi)
    ok = p.dropna(subset=["bb_upper"])
    assert (ok["bb_upper"] >= ok["bb_middle"]).all() and (ok["bb_middle"] >= ok["bb_lower"]).all()
    assert (p["atr"].dropna() > 0).all()
    assert {"open", "close", "ema_8", "sma_50", "macd_hist", "obv", "stoch_d"} <= set(p.columns)
    custom = Technical(ema=(5,)).with_ema(ohlcv)
    assert "ema_5" in custom.columns and "ema_8" not in custom.columns


def test_technical_matches_pandas(ohlcv):
    p = Technical().all(ohlcv).toPandas().sort_values("date").reset_index(drop=True)
    c = p["close"]
    assert np.allclose(p["sma_20"], c.rolling(20).mean(), equal_nan=True)
    assert np.allclose(p["bb_width"], 4 * c.rolling(20).std() / c.rolling(20).mean(), equal_nan=True)
    assert np.allclose(p["ema_21"], c.ewm(span=21, adjust=False).mean())
    tr = pd.concat([p.high - p.low, (p.high - c.shift()).abs(), (p.low - c.shift()).abs()], axis=1).max(axis=1)
    assert np.allclose(p["atr"], tr.rolling(14).mean(), equal_nan=True)


def test_returns(spark):
    s = Series(["key"])
    got = series(spark, [100.0, 110.0, 105.0, 115.0]).select("date", s.log_return("x").alias("l"), s.pct("x").alias("p")).orderBy("date").collect()
    assert got[0].l is None and got[1].l == pytest.approx(math.log(1.1)) and got[1].p == pytest.approx(0.1)


def test_nulls_never_become_flags(spark):
    df = spark.createDataFrame([(None,), (1.0,)], "x double")
    assert sorted(r[0] for r in df.select(flag(F.col("x") > 0)).collect()) == [0, 1]
    assert {r[0] for r in df.select(clip("x", 2.0, 3.0)).collect()} == {None, 2.0}


def test_ewm_and_rank_match_pandas(spark):
    x = np.random.default_rng(1).normal(size=60).tolist()
    df = series(spark, x)
    got = ewm(df, ["key"], ["date"], {"a": ("x", span(10), False), "b": ("x", 0.3, True)}).toPandas().sort_values("date")
    p = pd.Series(x)
    assert np.allclose(got["a"], p.ewm(span=10, adjust=False).mean()) and np.allclose(got["b"], p.ewm(alpha=0.3).mean())
    rank = df.select("date", Series(["key"]).pct_rank("x", 20).alias("r")).toPandas().sort_values("date")["r"]
    assert np.allclose(rank, p.rolling(20).rank(pct=True), equal_nan=True)
    tied = series(spark, [round(v) * 1.0 for v in x])
    mine = expanding_rank(tied, ["key"], ["date"], "x", "r", 5).toPandas().sort_values("date")["r"]
    assert np.allclose(mine, p.round().expanding(5).rank(pct=True), equal_nan=True)


def test_asof_keeps_old_value_over_null_and_carries_keys(spark):
    left = spark.createDataFrame([("a", day(i)) for i in range(6)], "k string, date date")
    right = spark.createDataFrame([("a", day(1), 1.0), ("a", day(3), None), ("b", day(0), 9.0)], "k string, date date, v double")
    got = {r.date: r.v for r in align.asof_join(left, right, by=("k",)).collect()}
    assert [got[day(i)] for i in range(6)] == [None, 1.0, 1.0, 1.0, 1.0, 1.0]


def test_sample_moments_match_pandas(spark):
    x = np.random.default_rng(3).gamma(2.0, size=200).tolist()
    row = series(spark, x).agg(stats.sample_skew("x").alias("s"), stats.sample_kurtosis("x").alias("k")).first()
    assert row.s == pytest.approx(pd.Series(x).skew()) and row.k == pytest.approx(pd.Series(x).kurtosis())


def test_student_distribution():
    assert stats.student_cdf(0.0, 5) == pytest.approx(0.5)
    assert stats.student_cdf(2.015048, 5) == pytest.approx(0.95, abs=1e-6)
    assert risk.student_quantile(0.05, 1e6) == pytest.approx(-1.6449, abs=1e-3)


def test_limits(spark):
    l = risk.Limits()
    df = spark.createDataFrame([(0.15,), (0.35,), (-0.30,), (0.0,)], "x double")
    assert [r[0] for r in df.select(l.cap("x")).collect()] == [0.15, 0.20, -0.20, 0.0]
    e = spark.range(1).select(F.lit(80.0).alias("p"), F.lit(2.0).alias("a"), F.lit(1).alias("up"), F.lit(-1).alias("dn"))
    assert e.select(l.stop("p", "a", "up"), l.stop("p", "a", "dn"), l.target("p", "a", "up")).first()[:] == (76.0, 84.0, 88.0)
    v = spark.createDataFrame([(day(0), 1.0), (day(1), 0.9), (day(2), 0.8), (day(3), 1.0)], "date date, value double")
    got = l.halted(v).orderBy("date").collect()
    assert [r.halted for r in got] == [False, False, True, True] and got[1].drawdown == pytest.approx(-0.1)


def test_var_methods_order_and_components(spark):
    rng = np.random.default_rng(42)
    rows = [(a, day(i), float(rng.normal(0, 0.01))) for a in "AB" for i in range(500)]
    df = spark.createDataFrame(rows, "asset string, date date, ret double")
    one = df.where("asset = 'A'")
    low, high = risk.Limits().var(one, 0.95).first()[0], risk.Limits().var(one, 0.99).first()[0]
    assert 0 < low <= high
    assert risk.Limits().var(one.limit(10)).first()[0] == 0.0
    c = risk.component(df, {"A": 0.6, "B": 0.4}).collect()
    assert sum(r.component_var for r in c) == pytest.approx(c[0].portfolio_var)
    values = {r.method: r["var"] for r in risk.full_analysis(one).collect()}
    assert len(values) == 6 and all(0.012 < v < 0.022 for v in values.values())


def test_kupiec(spark):
    df = spark.createDataFrame([(-1.0 if i < 5 else 1.0, 0.5) for i in range(100)], "ret double, var double")
    row = risk.kupiec(df, 0.95).first()
    assert row.exceeded == 5 and row.lr == pytest.approx(0.0, abs=1e-9) and row.accepted


def test_backtest_halts_after_the_breach(spark):
    prices = [100.0, 101.0, 80.0, 60.0, 120.0, 130.0]
    df = spark.createDataFrame([(day(i), p, 1) for i, p in enumerate(prices)], "date date, close double, signal int")
    got = backtest.run(df).orderBy("date").collect()
    assert got[0].position == 0 and got[2].position == 1
    assert not got[2].halted and all(r.halted and r.net == 0 for r in got[3:])


def test_drawdown_periods_leave_out_the_open_one(spark):
    v = [1.0, 0.9, 0.8, 0.9, 0.95, 0.99, 0.99, 1.1, 1.0]
    df = spark.createDataFrame([(day(i), x) for i, x in enumerate(v)], "date date, value double")
    df = df.withColumn("drawdown", F.col("value") / Series().cummax("value") - 1)
    got = backtest.drawdown_periods(df).collect()
    assert len(got) == 1 and got[0].start == day(1) and got[0].end == day(7) and got[0].trough == day(2)


def test_intrinsic_matches_grid_search():
    asset = valuation.Asset(capacity=3.0, floor=0.0, inject_day=1 / 30, withdraw_day=2 / 30)
    curve = [2.0, 1.5, 3.0, 2.5, 4.0]
    value, flows = valuation.intrinsic(curve, asset, 1.0)
    best = -1e9
    for plan in itertools.product((-2.0, -1.0, 0.0, 1.0), repeat=len(curve)):
        held, cash, ok = 1.0, 0.0, True
        for x, f in zip(curve, plan, strict=True):
            held += f
            ok &= -1e-9 <= held <= 3.0 + 1e-9
            cash += -(x + asset.inject_cost) * f if f > 0 else (x * (1 - asset.fuel_loss) - asset.withdraw_cost) * -f
        best = max(best, cash) if ok else best
    assert value == pytest.approx(best)
    held = 1.0 + np.cumsum(flows)
    assert (held >= -1e-9).all() and (held <= 3.0 + 1e-9).all()


def test_rolling_intrinsic_covers_all_dates(spark):
    o = spark.read.parquet("/root/testdata/sf0.001/orders.parquet").toPandas()
    o["date"] = pd.to_datetime(o["o_orderdate"]).dt.date
    closes = o.sort_values("o_orderkey").groupby(["o_orderpriority", "date"])["o_totalprice"].last() / 50_000
    got = {(r.symbol, r.date): r for r in strategy.rolling_intrinsic(spark, "/root/testdata/sf0.001").collect()}
    decided = {s: c.droplevel(0).sort_index().iloc[::5] for s, c in closes.groupby(level=0)}
    assert got.keys() == {(s, d) for s, c in decided.items() for d in c.index} and max(d for _, d in got).year > 1995
    a = valuation.Asset.salt_cavern()
    for s, c in decided.items():
        for i in range(1, len(c)):
            before, now, x = got[s, c.index[i - 1]], got[s, c.index[i]], c.iloc[i]
            if i * 5 // 21 < 11:
                continue
            # One month is left: all that can be withdrawn is sold, a step at a time.
            stock = min(a.withdraw_day * 30, before.inventory - a.floor)
            unit = x * (1 - a.fuel_loss) - a.withdraw_cost
            flow = stock if unit > 0 else 0.0
            assert now.value == pytest.approx(unit * flow, abs=1e-9)
            assert now.inventory == pytest.approx(max(before.inventory - flow * 5 / 21, a.floor), abs=1e-9)
            assert now.cash == pytest.approx(before.cash + unit * flow * 5 / 21, abs=1e-9)


def test_simulation_is_independent_of_partitioning(spark):
    a = valuation.simulate(spark, 3.0, 1.0, 3.0, 0.5, paths=20, months=3).toPandas().sort_values(["path", "month"])
    assert len(a) == 60 and (a["price"] > 0).all()
    b = valuation.simulate(spark, 3.0, 1.0, 3.0, 0.5, paths=5, months=3).toPandas().sort_values(["path", "month"])
    assert np.allclose(a["price"].to_numpy()[:15], b["price"].to_numpy())
    paths = np.full((50, 4), 3.0)
    assert valuation.longstaff_schwartz(paths, valuation.Asset.salt_cavern(), 5.0) > 0


def test_values_by_market_are_those_of_each_path(spark):
    asset = valuation.Asset.salt_cavern()
    markets = {"a": (3.0, 1.0, 4.0, 0.5), "b": (2.0, 0.2, 2.0, 3.0)}
    params = spark.createDataFrame([(k, *v) for k, v in markets.items()] + [("none", None, 1.0, 1.0, 1.0)], "symbol string, s0 double, kappa double, theta double, sigma double")
    got = valuation.simulated_values(params, asset, 5.0, months=6, paths=30)
    assert {r["symbol"] for r in got.collect()} == set(markets)
    for name, (s0, kappa, theta, sigma) in markets.items():
        one = valuation.greedy_value(valuation.simulate(spark, s0, kappa, theta, sigma, months=6, paths=30), asset, 5.0, s0).toPandas().sort_values("path")
        mine = got.where(F.col("symbol") == name).toPandas().sort_values("path")
        assert np.allclose(mine["value"], one["value"], rtol=1e-12)
    g = valuation.simulated_greeks(params, asset, 5.0, months=6, paths=30).where("symbol = 'a'").first()
    want = valuation.greeks(spark, asset, 5.0, *markets["a"], months=6, paths=30).first()
    assert all(abs(g[k] - want[k]) < 1e-6 * max(1, abs(want[k])) for k in ("value", "delta", "gamma", "vega", "theta"))


def test_storage_and_trees_run_at_full_size(spark, monkeypatch):
    sf = "/root/testdata/sf0.001"
    assert strategy.storage_simulated(spark, sf).count() == 5 * 5000
    rows = strategy.storage_greeks(spark, sf).collect()
    assert len(rows) == 5 and all(None not in r for r in rows)
    models, make = [], ml.boosted_trees
    monkeypatch.setattr(ml, "boosted_trees", lambda *a, **k: models.append(make(*a, **k)) or models[-1])
    strategy.gbt_forecast(spark, "/root/testdata/sf0.001")
    assert models[0].fitted.getNumTrees == 20 and models[0].fitted.getOrDefault("maxDepth") == 4


def test_stop_machine():
    m = signals.StopState(0.1, 0.1, 2)
    assert [m.step(p, 1) for p in (100, 110, 98, 97, 96, 95)] == [1, 1, 0, 0, 0, 1]


def test_book_refuses_when_full():
    b = signals.Book(1)
    b.on("a", "open", 0.5, 100.0, 1)
    b.on("b", "open", 0.5, 100.0, 2)
    assert set(b.open) == {"a"} and b.gross == 0.5
    b.on("a", "mark", 0, 110.0, 3)
    assert b.unrealised == pytest.approx(0.05)
    assert b.on("a", "close", 0, 120.0, 4) == pytest.approx(0.1) and not b.open


def test_position_book_folds_every_account(spark, tmp_path):
    spark.read.parquet("/root/testdata/sf0.001/events.parquet").withColumn("user_id", F.col("user_id") * 7).write.parquet(str(tmp_path / "events.parquet"))
    e = spark.read.parquet(str(tmp_path / "events.parquet")).toPandas().sort_values("event_id")
    want = {}
    for user, rows in e.groupby("user_id"):
        held = {}
        for r in rows.itertuples():
            i, price, gain = r.event_id % 7, r.value + 1, 0.0
            if r.event_type == "purchase":
                if len(held) < 5:
                    held[i] = (price, price)
            elif i in held:
                entry = held[i][0]
                held[i] = (entry, price)
                if r.event_type != "view":
                    gain = 0.1 * (price / entry - 1)
                    del held[i]
            want[user, r.event_id] = (gain, sum(0.1 * (last / entry - 1) for entry, last in held.values()), 0.1 * len(held), len(held))
    got = {(r.account, r.seq): (r.realised, r.unrealised, r.gross, r.n_open) for r in strategy.position_book(spark, str(tmp_path)).collect()}
    assert got.keys() == want.keys() and any(user >= 40 for user, _ in want)
    for k, row in want.items():
        assert got[k] == pytest.approx(row, abs=1e-9), k


def test_composite_is_causal(spark, ohlcv):
    full = signals.technical(Series(["symbol"]), ohlcv).orderBy("date").toPandas()["technical_signal"]
    part = signals.technical(Series(["symbol"]), ohlcv.where(F.col("date") < F.lit(day(90)))).orderBy("date").toPandas()["technical_signal"]
    assert np.allclose(full[:90], part)


def test_near_duplicates_keep_first_and_do_not_chain(spark):
    base = "gas storage levels fell again this week as cold weather pushed demand higher across the region".split()
    texts = [base, [*base[:-1], "area"], [*base[:-2], "whole", "area"], "an unrelated story about solar panels and batteries in another country".split(), base[::-1], ["the"], []]
    df = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "article_id long, title string")
    for threshold, limit in ((0.5, 5000), (0.85, 5000), (0.5, 8)):
        pairs = {(r.a, r.b) for r in news.similar_pairs(df, threshold, limit=limit).collect()}
        v = _vectors([" ".join(t) for t in texts], limit)
        first = [v.index(x) for x in v]
        want = {(i, j) for i, j in itertools.combinations(range(5), 2) if first[i] == i and first[j] == j and _cosine(v[i], v[j]) >= threshold}
        want |= {(first[i], i) for i in range(5) if first[i] < i}
        assert pairs == want, (threshold, limit)
    p = spark.createDataFrame([(0, 1), (1, 2), (3, 4)], "a long, b long")
    assert sorted(r[0] for r in news.greedy_drop(p).collect()) == [1, 4]


def test_many_titles_with_one_bag_of_terms_make_no_pairs_among_themselves(spark):
    df = spark.range(3000).select(F.col("id").alias("article_id"), F.concat(F.lit("Gas prices rise, storage falls"), F.repeat(F.lit("!"), (F.col("id") % 9).cast("int"))).alias("title"))
    pairs = news.similar_pairs(df)
    assert pairs.count() == 2999 and news.greedy_drop(pairs).count() == 2999


def _clean(t):
    t = re.sub(r"<[^>]+>", " ", t or "")
    return re.sub(r"[^\w .,!?;:'\"()%$-]", "", re.sub(r"\s+", " ", t).strip(" "))


def _vectors(titles, limit=5000):
    counts = [collections.Counter(w for w in re.split(r"\W+", t.lower()) if len(w) >= 2 and w not in news.STOP_WORDS) for t in titles]
    total = sum(counts, collections.Counter())
    known = sorted(total, key=lambda w: (-total[w], w))[:limit]
    found = {w: sum(w in c for c in counts) for w in known}
    return [{w: n * (math.log((1 + len(titles)) / (1 + found[w])) + 1) for w, n in c.items() if w in found} for c in counts]


def _cosine(x, y):
    norm = math.sqrt(sum(v * v for v in x.values()) * sum(v * v for v in y.values()))
    return sum(v * y.get(w, 0.0) for w, v in x.items()) / norm if norm else 0.0


def test_news_query_matches_brute_force(spark):
    a = pd.DataFrame([r.asDict() for r in frames.articles(spark, "/root/testdata/sf0.001").collect()])
    a["title"], a["content"] = a["title"].map(_clean), a["content"].map(_clean)
    both = (a["title"] + " " + a["content"]).str.lower()
    a = a[(a["title"].str.len() >= 20) & both.map(lambda t: any(k in t for k in ("en", "de", "la")))]
    a["key"] = a["title"].str.strip(" ").str.lower()
    a = a.sort_values(["date", "article_id"]).drop_duplicates("key").sort_values("article_id").reset_index(drop=True)
    v = _vectors(a["title"])
    kept = []
    for i in range(len(a)):
        if all(_cosine(v[i], v[j]) < 0.85 for j in kept):
            kept.append(i)
    assert 0 < len(kept) < len(a)
    got = [(r.article_id, r.date, r.title) for r in text.news_process(spark, "/root/testdata/sf0.001").collect()]
    want = a.loc[kept].assign(day=lambda x: -pd.to_datetime(x["date"]).astype("int64")).sort_values(["day", "article_id"])
    assert got == list(zip(want["article_id"], want["date"], want["title"], strict=True))


def test_news_process_edges(spark):
    schema = "article_id long, title string, description string, date date"
    rows = [(1, "Gas storage falls <b>sharply</b> this week", None, D0), (2, "short gas", "x", D0), (3, None, "gas", D0), (4, "Gas storage falls sharply this week too", "y", None), (5, "An unrelated tale of gardens", "roses", D0), (6, "GAS STORAGE falls sharply this week", "z", day(1))]
    got = news.process(spark.createDataFrame(rows, schema), ["gas"]).collect()
    assert [(r.article_id, r.full_text) for r in got] == [(1, "Gas storage falls sharply this week. ")]
    assert news.process(spark.createDataFrame([], schema), ["gas"]).collect() == []


def test_splitter():
    text = "\n\n".join("word " * 60 for _ in range(5)).strip()
    assert retrieval.split_text("") == [] and retrieval.split_text(" \n") == [] and retrieval.split_text("ab") == ["ab"]
    # Lines fit: packed by blank lines, each led by the tail of the one before and the separator.
    assert retrieval.split_text("aaaa\n\nbbbb\n\ncc", 6, 2) == ["aaaa", "aa\n\nbbbb", "bb\n\ncc"]
    # A lead that makes a chunk longer than one and a half sizes is left out.
    assert retrieval.split_text("aaaa\n\nbbbbbb", 6, 2) == ["aaaa", "bbbbbb"]
    # Characters, where no separator helps; the levels above lead again with their separator where it fits.
    assert retrieval.split_text("abcdefgh", 4, 1, ("",)) == ["abcd", "defgh"]
    assert retrieval.split_text("abcdefgh", 4, 1, (" ", "")) == ["abcd", "defgh"]
    assert retrieval.split_text("abcdefgh", 4, 0) == ["abcd", "efgh"]
    assert all(len(c) <= 600 for c in retrieval.split_text(text, 400, 50))


def test_chunks_keep_their_place(spark):
    pages = spark.createDataFrame([("f", "aaaa" + " " * 9 + "\n\nbbbb"), ("g", None), ("h", "  ")], "filename string, text string")
    got = [(r.filename, r.text, r.chunk_index, r.char_count) for r in retrieval.chunk_pages(pages, size=4, overlap=0).collect()]
    parts = retrieval.split_text("aaaa" + " " * 9 + "\n\nbbbb", 4, 0)
    assert got == [("f", c.strip(), i, len(c)) for i, c in enumerate(parts) if c.strip()] and {"aaaa", "bbbb"} <= {g[1] for g in got}


def test_questions_are_answered_from_their_chunks(spark):
    corpus = spark.createDataFrame([(1, [1.0, 0.0], "one", "a.txt"), (2, [0.9, 0.1], "two\nlines", "b.txt"), (3, [0.0, 1.0], None, None)], "vec_id long, embedding array<double>, text string, source string")
    q = spark.createDataFrame([(7, [1.0, 0.0], "which?"), (8, [0.0, 1.0], None)], "query_id long, embedding array<double>, question string")
    got = {r.query_id: r for r in retrieval.ask(q, corpus, lambda p: p, k=2, keep=2).collect()}
    assert got[7].answer == "Context:\n[1] Source: a.txt\none\n\n---\n\n[2] Source: b.txt\ntwo\nlines\n\nQuestion: which?\n\nAnswer:"
    assert got[7].sources == ["1", "2"] and got[8].sources == ["3", "2"]
    assert got[8].answer.startswith("Context:\n[1] Source: Unknown\n\n\n---")
    assert {r.query_id: r.answer for r in retrieval.ask(q, corpus).collect()} == {7: "one", 8: ""}
    small = {r.query_id: r.answer for r in retrieval.ask(q, corpus, lambda p: p, max_tokens=6).collect()}
    assert "[1]" in small[7] and "[2]" not in small[7]

    def fails(prompts):
        raise RuntimeError("no model")

    assert {r.answer for r in retrieval.ask(q, corpus, fails).collect()} == {"Error generating answer: no model"}
    none = retrieval.ask(q, corpus.where("false"), lambda p: p).collect()
    assert len(none) == 2 and all(retrieval.NO_CONTEXT in r.answer and r.sources == [] for r in none)


def test_model_contract(spark, tmp_path):
    df = spark.createDataFrame([(float(i % 7), float(i % 3), float(i % 7) * 2) for i in range(60)], "a double, b double, target double")
    m = ml.boosted_trees("m", ["a", "b"], maxIter=3)
    with pytest.raises(RuntimeError):
        m.predict(df)
    got = m.train(df).evaluate(df)
    assert set(got) == {"mae", "rmse", "r2", "directional_accuracy"} and got["r2"] > 0.5
    assert m.importance()[0][0] == "a" and "fitted=True" in repr(m)
    from pyspark.ml.regression import GBTRegressionModel

    m.save(str(tmp_path / "m"))
    again = ml.boosted_trees("m", ["a", "b"]).load(GBTRegressionModel, str(tmp_path / "m"))
    assert again.evaluate(df)["mae"] == pytest.approx(got["mae"])


def test_permutation_test_matches_brute_force(spark):
    a, p = [0, 1, None, 2, 1, 0, 1, 1, 0, 3] * 4, [1, 1, 0, None, 1, 0, 2, 1, 0, 0] * 4
    df = spark.createDataFrame(list(zip(a, p, strict=True)), "a int, p int").coalesce(1)
    key = {(r.round, r.i): r.h for r in spark.range(20).toDF("round").join(spark.range(len(a)).toDF("i")).select("round", "i", F.xxhash64(F.lit(42), "round", "i").alias("h")).collect()}
    mean = lambda pairs: np.mean([x == y for x, y in pairs if x is not None and y is not None])
    ordered = sorted(p, key=lambda y: (y is None, y or 0))
    null = [mean(zip([a[i] for i in sorted(range(len(a)), key=lambda i: key[n, i])], ordered, strict=True)) for n in range(20)]
    for buckets in (1, 7):
        got = ml.permutation_test(df, "a", "p", 20, buckets=buckets).collect()
        real = mean(zip(a, p, strict=True))
        assert len(got) == 1 and got[0].real == pytest.approx(real) and got[0].null_mean == pytest.approx(np.mean(null))
        assert got[0].p_value == pytest.approx(np.mean([s >= real for s in null]))


def test_permutation_query_takes_all_events(spark):
    e = spark.read.parquet("/root/testdata/sf0.001/events.parquet").toPandas()
    got = strategy.permutation_test(spark, "/root/testdata/sf0.001").collect()
    hits = (e["value"] > 50).astype(int) == e["event_id"] % 2
    assert len(got) == 1 and got[0].real == pytest.approx(hits.mean()) and got[0].p_value * 200 == pytest.approx(round(got[0].p_value * 200))


def test_sources(spark, tmp_path):
    (tmp_path / "p.json").write_text('{"response": {"total": 2, "data": [{"period": "2024-01-01T05", "value": "7.5", "r": "E"}, {"period": "2024-01-01T06", "value": "x", "r": "E"}]}}')
    got = landing.hourly(landing.paged_json(spark, str(tmp_path / "p.json"), extra=("r",))).collect()
    assert len(got) == 1 and got[0].mw == 7.5 and got[0].ts.hour == 5
    (tmp_path / "o.json").write_text('{"observations": [{"date": "2024-01-01", "value": "."}, {"date": "2024-01-02", "value": "3"}]}')
    assert [r.value for r in landing.observations(spark, str(tmp_path / "o.json")).orderBy("date").collect()] == [None, 3.0]
    (tmp_path / "t.csv").write_text("Date,Tone\n20240101T000000Z,-1.5\n20240102 2.5\n")
    assert sorted(r.tone for r in landing.timeline(spark, str(tmp_path / "t.csv")).collect()) == [-1.5, 2.5]
    (tmp_path / "c.json").write_text('{"city": "NYC", "daily": {"time": ["2024-01-01"], "tavg": [30.5]}}')
    assert landing.column_arrays(spark, str(tmp_path / "c.json"), ("tavg",)).first().tavg == 30.5
    docs = tmp_path / "docs" / "deep"
    docs.mkdir(parents=True)
    (docs / "a.txt").write_text("hello")
    (docs / "b.bin").write_bytes(b"\x00")
    assert [r.text for r in landing.documents(spark, str(tmp_path / "docs")).collect()] == ["hello"]
    with pytest.raises(ValueError):
        landing.prices(spark, "nowhere", ["ZZ"], known=("CL",))
    old = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    new = spark.createDataFrame([(2, "c")], "k int, v string")
    assert sorted(map(tuple, landing.refreshed(old, new, ["k"]).collect())) == [(1, "a"), (2, "c")]
    path = str(tmp_path / "cache")
    assert landing.cached(spark, path, lambda: old).count() == 2
    assert landing.cached(spark, path, lambda: new).count() == 2


def test_paged_reader_retries_and_ends_where_a_series_fails(spark, tmp_path):
    folder = str(tmp_path)

    def fetch(key, offset, length):
        import pathlib

        region = key["region"]
        if region == "flaky":
            mark = pathlib.Path(folder) / f"{region}{key['fuel']}{offset}"
            if not mark.exists():
                mark.write_text("")
                raise OSError("busy")
        if region == "broken" and offset:
            raise OSError("gone")
        n = 7
        data = [{"period": f"2024-01-01T{i:02d}", "value": "x" if i == 5 else i} for i in range(offset, min(n, offset + length))]
        return {"response": {"total": str(n), "data": data if region != "empty" else []}}

    waits = dict(shortest=0.0, longest=0.0)
    got = landing.paged_generation(spark, ["flaky", "broken", "empty"], fetch, page=3, **waits)
    assert got.columns == ["region", "fuel", "period", "value"]
    seen = collections.Counter((r.region, r.fuel) for r in got.collect())
    # Seven rows less the one that is no number; the first page alone where the second fails.
    assert seen == {("flaky", "WND"): 6, ("flaky", "SUN"): 6, ("broken", "WND"): 3, ("broken", "SUN"): 3}
    assert landing.hourly(landing.paged(spark, [{"region": "ok"}], fetch, page=3)).agg(F.sum("mw"), F.count("ts")).first()[:] == (16.0, 6)
    with pytest.raises(Exception, match="gone"):
        landing.paged(spark, [{"region": "broken"}], fetch, page=3, strict=True, **waits).collect()
    assert landing.paged(spark, [], fetch).collect() == []


def test_retry_waits_grow_within_bounds():
    waits, calls = [], []

    def fails():
        calls.append(1)
        raise OSError("down")

    with pytest.raises(OSError, match="down"):
        landing.retried(fails, tries=7, sleep=waits.append)
    assert len(calls) == 7 and waits == [2, 2, 4, 8, 16, 30]


def _drain(spark, df, tmp_path, mode="append"):
    out, where = str(tmp_path / "out"), str(tmp_path / "ck")
    if mode == "append":
        df.writeStream.format("parquet").option("path", out).option("checkpointLocation", where).trigger(availableNow=True).start().awaitTermination()
        return spark.read.schema(df.schema).parquet(out)
    rows = []
    df.writeStream.foreachBatch(lambda b, _: rows.extend(b.collect())).option("checkpointLocation", where).outputMode(mode).trigger(availableNow=True).start().awaitTermination()
    return rows


@pytest.fixture()
def stream(spark, tmp_path):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    jobs.event_time(events).repartition(3).write.parquet(str(tmp_path / "in"))
    batch = spark.read.parquet(str(tmp_path / "in"))
    return batch, spark.readStream.schema(batch.schema).parquet(str(tmp_path / "in"))


def test_streaming_daily_equals_batch_for_closed_days(spark, stream, tmp_path):
    batch, live = stream
    got = _drain(spark, jobs.tumbling_daily(live, "value", "event_type"), tmp_path).collect()
    want = {(r.event_type, r.day): r.n for r in jobs.tumbling_daily(batch, "value", "event_type", watermark=False).collect()}
    end = batch.agg(F.max("ts")).first()[0] - dt.timedelta(hours=1)
    closed = {k: v for k, v in want.items() if k[1] + dt.timedelta(days=1) <= end}
    assert {(r.event_type, r.day): r.n for r in got} == closed and closed


def test_streaming_ewma_equals_pandas(spark, stream, tmp_path):
    batch, live = stream
    rows = live.select(F.col("event_type").alias("key"), "ts", "value")
    got = _drain(spark, jobs.stateful(rows, "key", jobs.Ewma(0.2)), tmp_path, "update")
    p = batch.toPandas().sort_values("ts")
    for k, g in p.groupby("event_type"):
        want = g["value"].ewm(alpha=0.2, adjust=False).mean().to_numpy()
        mine = [r.ewma for r in sorted((r for r in got if r.key == k), key=lambda r: r.ts)]
        assert len(mine) == len(want) and mine[-1] == pytest.approx(want[-1])


def test_streaming_dedup_and_book(spark, stream, tmp_path):
    batch, live = stream
    doubled = live.union(live)
    assert _drain(spark, jobs.dedup(doubled, ["event_id"]), tmp_path / "a").count() == batch.count()
    rows = live.select(F.col("user_id").cast("string").alias("key"), F.col("event_id").alias("seq"), F.lit("i").alias("instrument"), F.when(F.col("event_type") == "view", "open").otherwise("close").alias("action"), F.lit(0.1).alias("size"), (F.col("value") + 1).alias("price"))
    got = _drain(spark, jobs.stateful(rows, "key", jobs.Positions()), tmp_path / "b", "update")
    assert len(got) == batch.count() and all(r.gross <= 0.1 + 1e-9 for r in got)
