"""Aggregates that SQL dialects lack or define otherwise."""

from __future__ import annotations

import math
from statistics import NormalDist

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wattline.functions.quantiles import quantiles
from wattline.functions.ts import col

NORMAL = NormalDist()


def sample_skew(x) -> Column:
    """Bias-corrected skewness."""
    n, g1 = F.count(col(x)), F.skewness(col(x))
    return F.when(n > 2, F.sqrt(n * (n - 1)) / (n - 2) * g1)


def sample_kurtosis(x) -> Column:
    """Bias-corrected excess kurtosis."""
    n, g2 = F.count(col(x)), F.kurtosis(col(x))
    return F.when(n > 3, (n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * g2 + 6))


def jarque_bera(x) -> Column:
    g1, g2 = F.skewness(col(x)), F.kurtosis(col(x))
    return F.count(col(x)) / 6 * (g1 * g1 + g2 * g2 / 4)


def spearman(df: DataFrame, x: str, y: str, by: tuple[str, ...] = ()) -> DataFrame:
    """Rank correlation with average ranks for ties."""
    both = df.where(F.col(x).isNotNull() & F.col(y).isNotNull())

    def average_rank(c):
        w = Window.partitionBy(*by).orderBy(c)
        return F.rank().over(w) + (F.count(F.lit(1)).over(Window.partitionBy(*by, c)) - 1) / 2

    ranks = both.select(*by, average_rank(x).alias("a"), average_rank(y).alias("b"))
    return ranks.groupBy(*by).agg(F.try_divide(F.covar_samp("a", "b"), F.stddev_samp("a") * F.stddev_samp("b")).alias("spearman"))


def welch(df: DataFrame, value: str, group: Column) -> DataFrame:
    """One row: means, t statistic and degrees of freedom of two groups."""
    a, b = F.when(group, F.col(value)), F.when(~group, F.col(value))
    m = df.agg(*[f(x).alias(f"{n}_{s}") for s, x in (("a", a), ("b", b)) for n, f in (("mean", F.avg), ("var", F.var_samp), ("n", F.count))])
    va, vb = F.col("var_a") / F.col("n_a"), F.col("var_b") / F.col("n_b")
    t = (F.col("mean_a") - F.col("mean_b")) / F.sqrt(va + vb)
    dof = (va + vb) * (va + vb) / (va * va / (F.col("n_a") - 1) + vb * vb / (F.col("n_b") - 1))
    return m.select("mean_a", "mean_b", t.alias("t"), dof.alias("dof"))


def student_cdf(t: float, dof: float) -> float:
    """By the continued fraction of the incomplete beta function."""
    x = dof / (dof + t * t)
    tail = 0.5 * _beta_inc(dof / 2, 0.5, x)
    return 1 - tail if t > 0 else tail


def _beta_inc(a: float, b: float, x: float) -> float:
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - _beta_inc(b, a, 1 - x)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    f, c, d = 1.0, 1.0, 0.0
    for i in range(500):
        m = i // 2
        if i == 0:
            num = 1.0
        elif i % 2 == 0:
            num = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        else:
            num = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        d = 1 / (1 + num * d or 1e-300)
        c = 1 + num / c or 1e-300
        f *= c * d
        if abs(1 - c * d) < 1e-14:
            break
    return front * (f - 1)


def mutual_information(df: DataFrame, x: Column, y: Column) -> DataFrame:
    """In bits, over the joint counts of two discrete columns."""
    joint = df.select(x.alias("x"), y.alias("y")).dropna().groupBy("x", "y").agg(F.count(F.lit(1)).alias("n"))
    total = Window.partitionBy()
    p = F.col("n") / F.sum("n").over(total)
    px, py = F.sum("n").over(Window.partitionBy("x")) / F.sum("n").over(total), F.sum("n").over(Window.partitionBy("y")) / F.sum("n").over(total)
    return joint.select((p * F.log2(p / (px * py))).alias("t")).agg(F.sum("t").alias("mutual_information"))


def quantile_bucket(df: DataFrame, value: str, edges: tuple[float, ...] = (0.2, 0.4, 0.6, 0.8)) -> DataFrame:
    """Adds ``bucket`` 0..n by quantile edges; a value on an edge is in the lower one."""
    q = quantiles(df, value, list(edges), name="_q")
    bucket = sum((F.when(F.col(value) > F.col("_q")[i], 1).otherwise(0) for i in range(len(edges))), F.lit(0))
    return df.join(F.broadcast(q)).withColumn("bucket", bucket).drop("_q")


def pairwise(df: DataFrame, key: str, on: str, value: str) -> DataFrame:
    """Covariance and correlation of every pair of keys over their common dates."""
    a = df.select(F.col(key).alias("a"), on, F.col(value).alias("x"))
    b = df.select(F.col(key).alias("b"), on, F.col(value).alias("y"))
    return a.join(b, on).groupBy("a", "b").agg(F.covar_samp("x", "y").alias("cov"), F.try_divide(F.covar_samp("x", "y"), F.stddev_samp("x") * F.stddev_samp("y")).alias("corr"), F.count(F.lit(1)).alias("n"))


def scores(df: DataFrame, actual: str, predicted: str, by: tuple[str, ...] = ()) -> DataFrame:
    """MAE, RMSE, R2 and MAPE of a regression."""
    e = F.col(actual) - F.col(predicted)
    return df.groupBy(*by).agg(
        F.avg(F.abs(e)).alias("mae"),
        F.sqrt(F.avg(e * e)).alias("rmse"),
        (1 - F.try_divide(F.sum(e * e), F.var_pop(actual) * F.count(actual))).alias("r2"),
        F.avg(F.abs(F.try_divide(e, F.col(actual)))).alias("mape"),
    )


def direction_scores(df: DataFrame, actual: str, predicted: str, by: tuple[str, ...] = ()) -> DataFrame:
    """Accuracy, precision, recall, F1 and edge over the base rate of 0/1 columns."""
    a, p = F.col(actual) == 1, F.col(predicted) == 1
    hit, tp = F.avg((a == p).cast("double")), F.count_if(a & p)
    base = F.avg(a.cast("double"))
    return df.groupBy(*by).agg(
        hit.alias("accuracy"), F.try_divide(tp, F.count_if(p)).alias("precision"), F.try_divide(tp, F.count_if(a)).alias("recall"),
        F.try_divide(2 * tp, F.count_if(p) + F.count_if(a)).alias("f1"), (hit - F.greatest(base, 1 - base)).alias("edge"),
    )


def probability_scores(df: DataFrame, actual: str, probability: str, by: tuple[str, ...] = (), floor: float = 1e-15) -> DataFrame:
    """auc and log_loss of a probability against a 0/1 column, by key.

    The area comes from counts by distinct probability (ties count half), so a key's rows
    are aggregated before they are ranked.
    """
    p, a = F.col(probability), F.col(actual)
    safe = F.least(F.greatest(p, F.lit(floor)), F.lit(1 - floor))
    loss = df.groupBy(*by).agg(F.avg(-F.when(a == 1, F.ln(safe)).otherwise(F.ln(1 - safe))).alias("log_loss"))
    steps = df.groupBy(*by, p.alias("_p")).agg(F.count_if(a == 1).alias("_up"), F.count_if(a == 0).alias("_down"))
    below = F.coalesce(F.sum("_down").over(Window.partitionBy(*by).orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    area = steps.withColumn("_won", F.col("_up") * (below + F.col("_down") / 2)).groupBy(*by).agg(F.try_divide(F.sum("_won"), F.sum("_up") * F.sum("_down")).alias("auc"))
    return area.join(loss, list(by)) if by else area.join(F.broadcast(loss))
