"""Validation folds, model wrapper, permutation tests, edge slices."""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wattline.functions.quantiles import quantiles
from wattline.functions.tables import settle
from wattline.functions.ts import Series
from wattline.operators import boosting


def _numbered(df: DataFrame, keys, on) -> DataFrame:
    s = Series(keys, [on])
    return df.withColumns({"_i": s.rank() - 1, "_n": F.count(F.lit(1)).over(s.whole)})


def _roles(df: DataFrame, folds: Column, train: Column, test: Column, extra: Column | None = None) -> DataFrame:
    e = df.withColumn("fold", F.explode(folds))
    role = F.when(test, "test").when(train, "train")
    return e.withColumn("role", role).where("role is not null").drop("_i", "_n")


def walk_forward(df: DataFrame, k: int = 5, keys: tuple[str, ...] = (), on: str = "date", embargo: int = 0) -> DataFrame:
    """Rows by fold with role train or test: fold size n // (k + 1), train on all
    before it less an embargo.  One explode; no fold is looped over."""
    size = F.floor(F.col("_n") / (k + 1))
    start = size * (F.col("fold") + 1)
    return _roles(_numbered(df, keys, on), F.sequence(F.lit(0), F.lit(k - 1)), F.col("_i") < start - embargo, (F.col("_i") >= start) & (F.col("_i") < start + size))


def purged(df: DataFrame, k: int = 5, embargo: int = 5, **options) -> DataFrame:
    return walk_forward(df, k, embargo=embargo, **options)


def expanding(df: DataFrame, first: int = 365, step: int = 30, keys: tuple[str, ...] = (), on: str = "date") -> DataFrame:
    n = _numbered(df, keys, on)
    last = F.floor((F.col("_n") - first - 1) / step)
    folds = F.when(F.col("_n") > first, F.sequence(F.lit(0).cast("long"), last)).otherwise(F.array().cast("array<bigint>"))
    start = first + step * F.col("fold")
    return _roles(n, folds, F.col("_i") < start, (F.col("_i") >= start) & (F.col("_i") < start + step))


def validation_tail(df: DataFrame, share: float = 0.15, keys: tuple[str, ...] = (), on: str = "date") -> DataFrame:
    return _numbered(df, keys, on).withColumn("is_validation", F.col("_i") >= F.floor(F.col("_n") * (1 - share))).drop("_i", "_n")


def permutation_test(df: DataFrame, actual: str, predicted: str, rounds: int = 200, seed: int = 42, buckets: int = 64, on: str | None = None) -> DataFrame:
    """real score, mean null score, p = share of shuffles at least as good.

    A shuffle gives the rows' actual values the ranks of a seeded hash, round by
    round, and pairs them with the predictions in ascending order, nulls last.  Equal
    predictions are one range of ranks, so a row needs only the range of its own
    actual value.  Ranks are an offset by hash range plus a rank inside the range, so
    a round is ranked in many tasks.  ``on`` names a column that tells rows apart; with
    it a result does not depend on how the rows are dealt.
    """
    order = Window.orderBy(F.col("v").asc_nulls_last())
    counts = df.groupBy(F.col(predicted).alias("v")).agg(F.count(F.lit(1)).alias("n"))
    ranges = counts.select("v", (F.sum("n").over(order) - F.col("n")).alias("lo"), F.sum("n").over(order).alias("hi")).where("v is not null")
    ids = df.select(F.monotonically_increasing_id().alias("i") if on is None else F.col(on).alias("i"), F.col(actual).alias("a"))
    # Written once, as ids depend on how rows are dealt and are read twice below.
    rows = settle(ids.join(ranges, F.col("a") == F.col("v"), "left").select("i", F.col("a").isNotNull().alias("known"), F.coalesce("lo", F.lit(0)).alias("lo"), F.coalesce("hi", F.lit(0)).alias("hi")))
    spread = rows.join(F.broadcast(df.sparkSession.range(rounds).withColumnRenamed("id", "round"))).withColumn("h", F.xxhash64(F.lit(seed), "round", "i"))
    # Buckets ascend with the hash.
    placed = spread.withColumn("bucket", F.floor((F.col("h") / 2.0**63 + 1) / 2 * buckets))
    cells = placed.groupBy("round", "bucket").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("round").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = cells.select("round", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    rank = F.row_number().over(Window.partitionBy("round", "bucket").orderBy("h", "i"))
    ranked = placed.withColumn("k", rank).join(offsets, ["round", "bucket"]).withColumn("k", F.col("k") + F.col("offset"))
    paired = df.agg(F.count(predicted).alias("m"), F.avg((F.col(actual) == F.col(predicted)).cast("double")).alias("real"))
    hit = (F.col("k") > F.col("lo")) & (F.col("k") <= F.col("hi"))
    scored = ranked.join(F.broadcast(paired)).where(F.col("known") & (F.col("k") <= F.col("m")))
    null = scored.groupBy("real", "round").agg(F.avg(hit.cast("double")).alias("s"))
    return null.groupBy("real").agg(F.avg("s").alias("null_mean"), F.avg((F.col("s") >= F.col("real")).cast("double")).alias("p_value"))


def _hypergeometric(rng: np.random.Generator, good: int, bad: int, n: int) -> int:
    """How many of ``n`` draws without replacement are good; beyond 10^9 things, where the
    library's own draws end, by the normal law with the exact mean and variance."""
    if not good or not n:
        return 0
    if good + bad < 1_000_000_000:
        return int(rng.hypergeometric(good, bad, n))
    total = good + bad
    mean = n * good / total
    spread = (mean * (bad / total) * ((total - n) / (total - 1))) ** 0.5
    return int(min(max(round(rng.normal(mean, spread)), 0, n - bad), n, good))


def shuffled_hits(rng: np.random.Generator, actual: dict, predicted: dict) -> tuple[int, int]:
    """(hits, pairs of known values) when the actual values are dealt at random to the
    predictions; both are given as value -> count, None for a missing one.

    A deal fixes a table of counts with the given margins, and only the table matters:
    each predicted value draws its share of what is left of the actual ones.
    """
    left, hits, pairs = dict(actual), 0, 0
    for value, n in predicted.items():
        rest = sum(left.values())
        for a in left:
            rest -= left[a]
            got = _hypergeometric(rng, left[a], rest, n)
            left[a] -= got
            n -= got
            if value is not None and a is not None:
                pairs += got
                hits += got if a == value else 0
    return hits, pairs


def class_permutation_test(df: DataFrame, actual: str, predicted: str, rounds: int = 200, seed: int = 42, most_classes: int = 200, on: str | None = None) -> DataFrame:
    """``permutation_test`` for labels of few kinds, from the counts of labels alone.

    One aggregate counts the labels; a round then draws its number of hits from the
    hypergeometric law of a random pairing, so no row is shuffled once a round.  More than
    ``most_classes`` kinds of labels are paired row by row (``permutation_test``).
    """
    table = df.groupBy(F.col(actual).alias("a"), F.col(predicted).alias("p")).agg(F.count(F.lit(1)).alias("n"))
    cells = table.limit(most_classes**2 + 1).collect()
    kinds = {r["a"] for r in cells} | {r["p"] for r in cells}
    if len(cells) > most_classes**2 or len(kinds) > most_classes:
        return permutation_test(df, actual, predicted, rounds, seed, on=on)
    key = lambda v: (v is None, v if v is not None else 0)
    counts = {side: {k: sum(r["n"] for r in cells if r[side] == k) for k in sorted({r[side] for r in cells}, key=key)} for side in "ap"}
    known = [r for r in cells if r["a"] is not None and r["p"] is not None]
    total = sum(r["n"] for r in known)
    real = sum(r["n"] for r in known if r["a"] == r["p"]) / total if total else None

    def draw(batches):
        for rows in batches:
            made = [shuffled_hits(np.random.default_rng([seed, int(i)]), counts["a"], counts["p"]) for i in rows["id"]]
            yield pd.DataFrame({"s": [h / p if p else None for h, p in made]}, dtype="float64")

    null = df.sparkSession.range(rounds).mapInPandas(draw, "s double").where("s is not null and not isnan(s)")
    score = F.lit(real).cast("double")
    out = null.agg(F.avg("s").alias("null_mean"), F.avg((F.col("s") >= score).cast("double")).alias("p_value"))
    return out.select(score.alias("real"), "null_mean", "p_value").where("real is not null")


def permutation_importance(df: DataFrame, features: list[str], label: str, predict: Callable[[np.ndarray], np.ndarray], repeats: int = 5, seed: int = 42, block: int = 4096) -> DataFrame:
    """feature, importance, std, rank: how much the squared error of ``predict`` grows when a
    feature's values are dealt anew among the rows, over ``repeats`` deals.

    Rows are cut into blocks by a hash of their values, alike for any partitioning; a
    feature is dealt anew inside its block, by a seed of block, feature and repeat.
    All (feature, repeat) pairs are scored from one pass, whose errors are sums.
    ``predict`` takes a matrix (rows, features) and is sent to the tasks.
    """
    rows = df.dropna(subset=[*features, label]).select(F.array(*[F.col(f).cast("double") for f in features]).alias("x"), F.col(label).cast("double").alias("y"))
    cuts = max(1, -(-rows.count() // block))
    placed = rows.withColumn("b", F.pmod(F.xxhash64(F.lit(seed), "x", "y"), F.lit(cuts)))

    def score(part: pd.DataFrame) -> pd.DataFrame:
        part = part.assign(key=[tuple(v) for v in part["x"]]).sort_values(["key", "y"])
        x, y, b = np.array(part["x"].tolist(), dtype=float), part["y"].to_numpy(), int(part["b"].iloc[0])
        base, out = float(((predict(x) - y) ** 2).sum()), []
        for f in range(len(features)):
            for r in range(repeats):
                dealt = x.copy()
                dealt[:, f] = np.random.default_rng([seed, b, f, r]).permutation(x[:, f])
                out.append((f, r, float(((predict(dealt) - y) ** 2).sum()) - base, len(y)))
        return pd.DataFrame(out, columns=["f", "r", "more", "n"])

    each = placed.groupBy("b").applyInPandas(score, "f int, r int, more double, n long")
    by_repeat = each.groupBy("f", "r").agg((F.sum("more") / F.sum("n")).alias("d"))
    out = by_repeat.groupBy("f").agg(F.avg("d").alias("importance"), F.stddev_pop("d").alias("std"))
    name = F.element_at(F.array(*[F.lit(f) for f in features]), F.col("f") + 1).alias("feature")
    # One row a feature.
    return out.select(name, "importance", "std", F.row_number().over(Window.orderBy(F.desc("importance"), name)).alias("rank"))


def betting(df: DataFrame, probability: str, actual: str, thresholds: list[float]) -> DataFrame:
    """Hit rate and coverage of bets surer than each threshold."""
    t = F.explode(F.array(*[F.lit(x) for x in thresholds])).alias("threshold")
    b = df.select(F.col(probability).alias("p"), F.col(actual).alias("a"), t)
    sure = F.greatest("p", 1 - F.col("p")) >= F.col("threshold")
    hit = (F.col("p") >= 0.5).cast("int") == F.col("a")
    return b.groupBy("threshold").agg(F.count_if(sure).alias("n_bets"), F.avg(sure.cast("double")).alias("coverage"), F.avg(F.when(sure, hit.cast("double"))).alias("hit_rate"))


def slices(df: DataFrame, by: list[str], hit: str = "hit") -> DataFrame:
    """Accuracy by each grouping and in total."""
    return df.rollup(*by).agg(F.count(F.lit(1)).alias("n"), F.avg(F.col(hit).cast("double")).alias("accuracy"))


def confidence_slices(df: DataFrame, probability: str, hit: str, edges: tuple[float, ...] = (0.5, 0.55, 0.6, 0.7, 1.01)) -> DataFrame:
    """low, n, accuracy by how sure the prediction is."""
    sure = F.greatest(probability, 1 - F.col(probability))
    low = F.lit(None).cast("double")
    for a, b in zip(edges[:-1], edges[1:], strict=True):
        low = F.coalesce(low, F.when((sure >= a) & (sure < b), F.lit(a)))
    return df.withColumn("low", low).where("low is not null").groupBy("low").agg(F.count(F.lit(1)).alias("n"), F.avg(F.col(hit).cast("double")).alias("accuracy"))


#: Mean return above which a year is named so, from the best on.
REGIMES = ((0.03, "strong bull"), (0.005, "bull"), (-0.005, "sideways"), (-0.03, "bear"))


def fold_slices(df: DataFrame, fold: str = "fold", ret: str = "actual", hit: str = "hit", date: str = "date") -> DataFrame:
    """fold, first and last date, n, accuracy, mean size of the return, percent of rises."""
    x = F.col(ret)
    return df.groupBy(fold).agg(
        F.min(date).alias("first"), F.max(date).alias("last"), F.count(F.lit(1)).alias("n"), F.avg(F.col(hit).cast("double")).alias("accuracy"),
        F.avg(F.abs(x)).alias("mean_size"), (F.avg((x > 0).cast("double")) * 100).alias("up_pct"),
    )


def year_slices(df: DataFrame, ret: str = "actual", hit: str = "hit", date: str = "date") -> DataFrame:
    """year, n, accuracy, percent of rises, mean return and the regime it makes."""
    x = F.col(ret)
    out = df.groupBy(F.year(date).alias("year")).agg(F.count(F.lit(1)).alias("n"), F.avg(F.col(hit).cast("double")).alias("accuracy"), (F.avg((x > 0).cast("double")) * 100).alias("up_pct"), F.avg(x).alias("mean_return"))
    regime = F.lit("strong bear")
    for least, name in reversed(REGIMES):
        regime = F.when(F.col("mean_return") > least, name).otherwise(regime)
    return out.withColumn("regime", regime)


def regime_slices(df: DataFrame, ret: str = "actual", hit: str = "hit") -> DataFrame:
    """slice, n, accuracy, edge over all: by the size and side of the actual return.

    Edges are exact quantiles over all rows with a return; slices without rows are left out.
    """
    rows = settle(df.select(F.col(ret).cast("double").alias("r"), F.col(hit).cast("double").alias("hit")).where("r is not null and hit is not null").withColumn("size", F.abs("r")))
    sizes, sides = quantiles(rows, "size", [0.25, 0.5, 0.75], name="s"), quantiles(rows, "r", [0.1, 0.9], name="t")
    j = rows.join(F.broadcast(sizes)).join(F.broadcast(sides))
    r, size, s, t = F.col("r"), F.col("size"), F.col("s"), F.col("t")
    kinds = {
        "all": F.lit(True), "high volatility": size > s[1], "low volatility": size <= s[1], "big moves": size > s[2], "small moves": size <= s[0],
        "up": r > 0, "down": r <= 0, "extreme up": r > t[1], "extreme down": r < t[0],
    }
    named = F.explode(F.filter(F.array(*[F.when(c, F.lit(k)) for k, c in kinds.items()]), lambda k: k.isNotNull())).alias("slice")
    by = j.select(named, "hit").groupBy("slice").agg(F.count(F.lit(1)).alias("n"), F.avg("hit").alias("accuracy"))
    overall = rows.agg(F.avg("hit").alias("_all"))
    return by.join(F.broadcast(overall)).select("slice", "n", "accuracy", (F.col("accuracy") - F.col("_all")).alias("edge"))


def magnitude_slices(df: DataFrame, predicted: str = "pred", ret: str = "actual", hit: str = "hit", cuts: tuple[float, ...] = (0.0, 0.25, 0.5, 0.75, 0.9, 1.0)) -> DataFrame:
    """low, high, n, accuracy, mean size of the return by how large the prediction is.

    Cuts are exact quantiles of the size of the prediction; the last slice holds its end.
    """
    rows = settle(df.select(F.abs(predicted).cast("double").alias("p"), F.abs(ret).cast("double").alias("size"), F.col(hit).cast("double").alias("hit")).where("p is not null"))
    q = quantiles(rows, "p", list(cuts), name="q")
    last = len(cuts) - 2
    inside = [(F.col("p") >= F.col("q")[i]) & (F.lit(True) if i == last else F.col("p") < F.col("q")[i + 1]) for i in range(last + 1)]
    slot = F.explode(F.filter(F.array(*[F.when(c, F.lit(i)) for i, c in enumerate(inside)]), lambda i: i.isNotNull())).alias("i")
    placed = rows.join(F.broadcast(q)).select("p", "size", "hit", "q", slot)
    out = placed.groupBy("i").agg(F.first("q").alias("q"), F.count(F.lit(1)).alias("n"), F.avg("hit").alias("accuracy"), F.avg("size").alias("mean_size"))
    return out.select(F.element_at("q", F.col("i") + 1).alias("low"), F.element_at("q", F.col("i") + 2).alias("high"), "n", "accuracy", "mean_size")


def worst_misses(df: DataFrame, keys: list[str], ret: str = "actual", hit: str = "hit", n: int = 15) -> DataFrame:
    """The ``n`` wrong calls with the largest actual moves; ties in the order of ``keys``."""
    wrong = df.where(~F.col(hit).cast("boolean")).withColumn("miss_size", F.abs(ret))
    return wrong.orderBy(F.col("miss_size").desc(), *keys).limit(n)


def agreement(a: DataFrame, b: DataFrame, on: tuple[str, ...] = ("date",), direction: str = "direction", hit: str = "hit") -> DataFrame:
    """n, both_right, both_wrong, agree, and accuracy where both models agree."""
    other = b.select(*on, F.col(direction).alias("_d"), F.col(hit).alias("_h"))
    both = a.join(other, list(on))
    same, x, y = F.col(direction) == F.col("_d"), F.col(hit) == 1, F.col("_h") == 1
    return both.agg(
        F.count(F.lit(1)).alias("n"), F.count_if(same).alias("agree"), F.count_if(x & y).alias("both_right"), F.count_if(~x & ~y).alias("both_wrong"), F.avg(F.when(same, F.col(hit).cast("double"))).alias("accuracy_when_agree"),
    )


def rolling_accuracy(df: DataFrame, keys: tuple[str, ...] = (), hit: str = "hit", n: int = 60) -> DataFrame:
    """Adds rolling_acc: the share of hits in the last ``n`` rows, null before that many."""
    return df.withColumn("rolling_acc", Series(keys).mean(F.col(hit).cast("double"), n))


def feature_columns(columns: list[str], exclude: tuple[str, ...] = (), suffixes: tuple[str, ...] = (), keep: tuple[str, ...] = ()) -> list[str]:
    """Names that are not excluded by name or suffix, and those with a kept prefix, sorted."""
    return sorted(c for c in columns if c not in exclude and (c.startswith(keep) if keep and c.endswith(suffixes) else not (suffixes and c.endswith(suffixes))))


def sparse_columns(df: DataFrame, most: float = 0.3) -> DataFrame:
    """``df`` without the columns whose share of nulls is ``most`` or more (all nulls too);
    one aggregate over all columns, whose single row of counts decides."""
    row = df.agg(F.count(F.lit(1)).alias("_n"), *[F.count(F.col(c)).alias(c) for c in df.columns]).first()
    return df.select(*[c for c in df.columns if row["_n"] and 1 - row[c] / row["_n"] < most])


def expanding_forecast(df: DataFrame, features: list[str], label: str, first: int = 252, step: int = 21, keys: tuple[str, ...] = (), ridge: float = 1e-9) -> DataFrame:
    """Rows from the ``first`` on with ``prediction`` by a linear model that is fitted anew
    every ``step`` rows on all rows before.

    What a fit needs are sums of products, so each block of rows is summed once and the
    sums are added up along the blocks: no row is read once a fit.
    """
    x = [F.lit(1.0), *[F.col(f).cast("double") for f in features]]
    y = F.col(label).cast("double")
    i = Series(keys).rank() - 1
    rows = df.dropna(subset=[*features, label]).withColumn("_i", i)
    rows = rows.withColumn("_block", F.when(F.col("_i") < first, 0).otherwise(1 + F.floor((F.col("_i") - first) / step)).cast("long"))
    k = len(x)
    products = [F.sum(x[a] * x[b]).alias(f"_xx{a * k + b}") for a in range(k) for b in range(k)] + [F.sum(x[a] * y).alias(f"_xy{a}") for a in range(k)]
    sums = rows.groupBy(*keys, "_block").agg(*products)
    before = Window.partitionBy(*keys).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    names = [f"_xx{i}" for i in range(k * k)] + [f"_xy{a}" for a in range(k)]
    moments = sums.select(*keys, "_block", F.array(*[F.sum(n).over(before) for n in names]).alias("_m")).where("_block > 0")

    @F.pandas_udf("array<double>")
    def solve(m: pd.Series) -> pd.Series:
        def one(v):
            xx, xy = np.array(v[: k * k]).reshape(k, k), np.array(v[k * k :])
            return np.linalg.lstsq(xx + ridge * np.diag(np.diag(xx)), xy, rcond=None)[0].tolist()

        return m.map(one)

    fits = moments.select(*[F.col(c).alias(f"_k_{c}") for c in keys], F.col("_block").alias("_b"), solve("_m").alias("_beta"))
    same = F.col("_block") == F.col("_b")
    for c in keys:
        same = same & (F.col(c) == F.col(f"_k_{c}"))
    prediction = sum((F.element_at("_beta", a + 1) * x[a] for a in range(k)), F.lit(0.0))
    return rows.join(fits, same).withColumn("prediction", prediction).drop("_i", "_block", "_b", "_beta", *[f"_k_{c}" for c in keys])


def backcast(df: DataFrame, features: list[str], label: str = "target", keys: tuple[str, ...] = ()) -> DataFrame:
    """What a demand model would have said each day: a year first, boosted trees fitted anew
    every 30 days, the last tenth of the rows before deciding how many trees."""
    return boosting.expanding_trees(df, features, label, 365, 30, keys, how=boosting.Boost(validation=0.1))


def dispatch(df: DataFrame, features: list[str], label: str, keys: tuple[str, ...] = ("region",)) -> DataFrame:
    """What trees say of generation: 252 rows first, 100 trees of depth 3 anew every 21 rows."""
    return boosting.expanding_trees(df, features, label, 252, 21, keys)


class Model:
    """Thin contract over a Spark ML regressor or classifier."""

    default_config: dict[str, Any] = {}

    def __init__(self, name: str, estimator, features: list[str], label: str = "target", config: dict[str, Any] | None = None):
        self.name, self.features, self.label = name, features, label
        self.config = {**self.default_config, **(config or {})}
        self.estimator, self.fitted = estimator, None

    def _vector(self, df: DataFrame) -> DataFrame:
        from pyspark.ml.feature import VectorAssembler

        return VectorAssembler(inputCols=self.features, outputCol="_features", handleInvalid="skip").transform(df)

    def train(self, df: DataFrame) -> Model:
        self.fitted = self.estimator.setParams(featuresCol="_features", labelCol=self.label, **self.config).fit(self._vector(df))
        return self

    def predict(self, df: DataFrame) -> DataFrame:
        if self.fitted is None:
            raise RuntimeError(f"{self.name} is not fitted")
        return self.fitted.transform(self._vector(df)).drop("_features")

    def evaluate(self, df: DataFrame) -> dict[str, float]:
        e = F.col(self.label) - F.col("prediction")
        row = self.predict(df).agg(
            F.avg(F.abs(e)).alias("mae"), F.sqrt(F.avg(e * e)).alias("rmse"), (1 - F.try_divide(F.sum(e * e), F.var_pop(self.label) * F.count(F.lit(1)))).alias("r2"),
            F.avg((F.signum(F.col(self.label)) == F.signum("prediction")).cast("double")).alias("directional_accuracy"),
        ).first()
        return row.asDict()

    def importance(self, top: int = 20) -> list[tuple[str, float]]:
        values = self.fitted.featureImportances.toArray()
        return sorted(zip(self.features, map(float, values), strict=True), key=lambda p: (-p[1], p[0]))[:top]

    def save(self, path: str) -> None:
        self.fitted.write().overwrite().save(path)

    def load(self, model_class, path: str) -> Model:
        self.fitted = model_class.load(path)
        return self

    def __repr__(self) -> str:
        return f"Model({self.name!r}, fitted={self.fitted is not None})"


def boosted_trees(name: str, features: list[str], label: str = "target", classify: bool = False, **config) -> Model:
    if classify:
        from pyspark.ml.classification import GBTClassifier as Trees
    else:
        from pyspark.ml.regression import GBTRegressor as Trees
    return Model(name, Trees(seed=42), features, label, {"maxIter": 20, "maxDepth": 4, **config})


def cross_validate(model_of, folds: DataFrame, label: str = "target") -> list[dict]:
    """Fits one model a fold; the folds are few, the rows stay distributed."""
    out = []
    for row in folds.select("fold").distinct().orderBy("fold").collect():
        part = folds.where(F.col("fold") == row["fold"])
        model = model_of().train(part.where("role = 'train'"))
        out.append({"fold": row["fold"], **model.evaluate(part.where("role = 'test'"))})
    return out


def class_scores(df: DataFrame, label: str = "target") -> dict[str, float]:
    """accuracy, precision, f1 of 0/1 predictions; 0 where nothing is predicted or true."""
    y, p = F.col(label) == 1, F.col("prediction") == 1
    row = df.agg(F.count(F.lit(1)).alias("n"), F.count_if(y == p).alias("ok"), F.count_if(y & p).alias("tp"), F.count_if(p).alias("said"), F.count_if(y).alias("true")).first()
    return {"accuracy": row.ok / row.n if row.n else 0.0, "precision": row.tp / row.said if row.said else 0.0, "f1": 2 * row.tp / (row.said + row.true) if row.said + row.true else 0.0}


def linear_models() -> dict[str, Any]:
    """kind -> (name, estimator): ridge and logistic regression."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.regression import LinearRegression

    return {"regression": [("ridge", lambda: LinearRegression(regParam=1.0))], "classification": [("logistic", lambda: LogisticRegression(regParam=1.0))]}


def all_models() -> dict[str, Any]:
    """The linear models and boosted trees."""
    from pyspark.ml.classification import GBTClassifier
    from pyspark.ml.regression import GBTRegressor

    out = linear_models()
    out["regression"].append(("trees", lambda: GBTRegressor(seed=42, maxIter=20, maxDepth=4)))
    out["classification"].append(("trees", lambda: GBTClassifier(seed=42, maxIter=20, maxDepth=4)))
    return out


def horizon_target(df: DataFrame, price: str, horizon: int, on: str = "date") -> DataFrame:
    """Every ``horizon``-th row, so that targets do not overlap, with ``target``: the log
    return over the next ``horizon`` rows."""
    s = Series((), [on])
    ahead = F.lead(price, horizon).over(s.w)
    rows = df.withColumn("target", F.ln(F.try_divide(ahead, F.col(price)))).where("target is not null")
    return rows.withColumn("_i", s.rank() - 1).where(F.col("_i") % horizon == 0).drop("_i")


def experiments(df: DataFrame, features: list[str], price: str, models: dict[str, Any] | None = None, horizons: tuple[int, ...] = (1, 5, 20), folds: int = 5, on: str = "date") -> DataFrame:
    """horizon, kind, model, samples, metric, mean, std over walk-forward folds.

    Features without a value count as 0.  ``classification`` predicts whether the
    return is above 0.  Fits are few (horizons * models * folds); their rows are
    written once a horizon and stay distributed.
    """
    out = []
    for horizon in horizons:
        rows = horizon_target(df, price, horizon, on).fillna(0.0, subset=features)
        parts = settle(walk_forward(rows, folds, on=on).select(on, "fold", "role", *features, "target"))
        samples = rows.count()
        for kind, choices in (models or all_models()).items():
            y = parts if kind == "regression" else parts.withColumn("target", (F.col("target") > 0).cast("double"))
            for name, estimator in choices:
                scores = []
                for fold in range(folds):
                    part = y.where(F.col("fold") == fold)
                    model = Model(name, estimator(), features).train(part.where("role = 'train'"))
                    test = part.where("role = 'test'")
                    scores.append(model.evaluate(test) if kind == "regression" else class_scores(model.predict(test)))
                for metric in scores[0]:
                    values = np.array([s[metric] for s in scores], dtype=float)
                    out.append((horizon, kind, name, samples, metric, float(values.mean()), float(values.std())))
    return df.sparkSession.createDataFrame(out, "horizon int, kind string, model string, samples long, metric string, mean double, std double")
