"""Boosted regression trees that are fitted anew as history grows, many fits at once.

A forecast by expanding refits needs one model a (key, refit).  The fits depend on
nothing but the rows before them, so they are dealt out: a task gets the rows of one key
up to the last of ``refits_per_task`` neighbouring refits, and fits those.  No fit is
made on the driver and none waits for another.

A fit is least-squares gradient boosting over histograms: each feature is cut at the
midpoints of its distinct training values, or, if it has more than ``bins``, at that
many quantiles of them.  Cuts come from the training rows alone, so no later row has
a say in a forecast.  With ``bins`` distinct values or fewer the splits are the exact ones.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wattline.functions.tables import settle
from wattline.functions.ts import Series


@dataclass(frozen=True)
class Boost:
    """``validation``: share of the last training rows that are not learnt from but decide
    after how many trees to stop (none for ``patience`` trees better than the best)."""

    trees: int = 100
    depth: int = 3
    rate: float = 0.1
    bins: int = 256
    validation: float = 0.0
    patience: int = 20


@dataclass
class Forest:
    """``features`` and ``cuts`` by (tree, node) of complete trees, ``leaves`` by (tree, leaf)."""

    base: float
    features: np.ndarray
    cuts: np.ndarray
    leaves: np.ndarray
    gains: np.ndarray

    def predict(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        for features, cuts, leaves in zip(self.features, self.cuts, self.leaves, strict=True):
            out += leaves[_leaf(x, features, cuts)]
        return out


def _leaf(x: np.ndarray, features: np.ndarray, cuts: np.ndarray) -> np.ndarray:
    node, rows = np.zeros(len(x), dtype=np.int64), np.arange(len(x))
    for _ in range((len(cuts) + 1).bit_length() - 1):
        node = 2 * node + 1 + (x[rows, features[node]] > cuts[node])
    return node - len(cuts)


def cut_points(values: np.ndarray, bins: int) -> np.ndarray:
    distinct = np.unique(values)
    if len(distinct) > bins:
        distinct = np.unique(np.quantile(values, np.linspace(0, 1, bins), method="inverted_cdf"))
    return (distinct[1:] + distinct[:-1]) / 2


def fit(x: np.ndarray, y: np.ndarray, how: Boost) -> Forest:
    """Boosted trees of (rows, features) and labels; no missing values."""
    held = min(len(y) - 1, max(1, int(len(y) * how.validation))) if how.validation else 0
    x, y, later, truth = x[: len(y) - held], y[: len(y) - held], x[len(y) - held :], y[len(y) - held :]
    k, cuts = x.shape[1], [cut_points(x[:, f], how.bins) for f in range(x.shape[1])]
    width = max(len(c) for c in cuts) + 1
    codes = np.column_stack([np.searchsorted(c, x[:, f], "left") for f, c in enumerate(cuts)]) + np.arange(k) * width
    table = np.full((k, width), np.inf)
    for f, c in enumerate(cuts):
        table[f, : len(c)] = c
    inner, base = 2**how.depth - 1, float(y.mean())
    features, levels = np.zeros((how.trees, inner), dtype=np.int64), np.full((how.trees, inner), np.inf)
    leaves, gains = np.zeros((how.trees, inner + 1)), np.zeros(k)
    rest, said = y - base, np.full(held, base)
    best, best_at = np.inf, 0
    for t in range(how.trees):
        node = np.zeros(len(y), dtype=np.int64)
        for level in range(how.depth):
            first, nodes = 2**level - 1, 2**level
            place = (codes + (node * k * width)[:, None]).ravel()
            shape = (nodes, k, width)
            sums = np.bincount(place, np.repeat(rest, k), nodes * k * width).reshape(shape).cumsum(axis=2)
            counts = np.bincount(place, minlength=nodes * k * width).reshape(shape).cumsum(axis=2)
            total, n = sums[:, :1, -1:], counts[:, :1, -1:]
            with np.errstate(divide="ignore", invalid="ignore"):
                gain = sums**2 / counts + (total - sums) ** 2 / (n - counts) - total**2 / n
            gain[(counts == 0) | (counts == n)] = -np.inf
            flat = gain.reshape(nodes, -1)
            at = flat.argmax(axis=1)
            won = flat[np.arange(nodes), at]
            # A gain of nothing but rounding is no split: all rows go left.
            splits = won > 1e-12 * (1e-300 + (rest @ rest))
            f, b = np.where(splits, at // width, 0), at % width
            features[t, first : first + nodes] = f
            levels[t, first : first + nodes] = np.where(splits, table[f, b], np.inf)
            np.add.at(gains, f[splits], won[splits])
            node = 2 * node + (splits[node] & (codes[np.arange(len(y)), f[node]] - f[node] * width > b[node]))
        n = np.bincount(node, minlength=inner + 1)
        leaves[t] = how.rate * np.bincount(node, rest, inner + 1) / np.maximum(n, 1)
        rest = rest - leaves[t][node]
        if held:
            said += leaves[t][_leaf(later, features[t], levels[t])]
            error = float(((truth - said) ** 2).mean())
            if error < best:
                best, best_at = error, t + 1
            elif t + 1 - best_at >= how.patience:
                break
    kept = best_at if held else how.trees
    return Forest(base, features[:kept], levels[:kept], leaves[:kept], gains)


def expanding_trees(df: DataFrame, features: list[str], label: str, first: int = 252, step: int = 21, keys: tuple[str, ...] = (), on: str = "date", how: Boost = Boost(), refits_per_task: int = 8) -> DataFrame:
    """Rows from the ``first`` on, by key, with ``prediction`` by trees that are fitted anew every
    ``step`` rows on all rows before.

    Rows with a missing feature or label are left out.  A task holds the rows of one key
    (numbers only).  Equal values of ``on`` are put in an order that holds for all fits.
    """
    whole = df.dropna(subset=[*features, label])
    s = Series(keys, [on])
    rows = settle(whole.withColumns({"_i": s.rank() - 1, "_n": F.count(F.lit(1)).over(s.whole)}).withColumn("_row", F.monotonically_increasing_id()))
    refit = F.greatest(F.lit(0), F.floor((F.col("_i") - first) / step))
    last = F.floor((F.col("_n") - 1 - first) / step)
    tasks = F.sequence(F.floor(refit / refits_per_task), F.floor(last / refits_per_task))
    needed = rows.where(F.col("_n") > first).select(*keys, "_row", "_i", F.array(*[F.col(f).cast("double") for f in features]).alias("_x"), F.col(label).cast("double").alias("_y"), F.explode(tasks).alias("_task"))

    def fit_task(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("_i")
        x, y, row = np.array(part["_x"].tolist(), dtype=float), part["_y"].to_numpy(float), part["_row"].to_numpy()
        begin, out = int(part["_task"].iloc[0]) * refits_per_task, []
        for r in range(begin, begin + refits_per_task):
            cut = first + r * step
            if cut >= len(y):
                break
            out.append(pd.DataFrame({"_of": row[cut : cut + step], "prediction": fit(x[:cut], y[:cut], how).predict(x[cut : cut + step])}))
        return pd.concat(out) if out else pd.DataFrame({"_of": [], "prediction": []})

    said = needed.groupBy(*keys, "_task").applyInPandas(fit_task, "_of long, prediction double")
    return rows.join(said, F.col("_row") == F.col("_of")).drop("_i", "_n", "_row", "_of")
