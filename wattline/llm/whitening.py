"""Embedding whitening by hierarchical SVD merging.

1. *Partitions.*  Each task reads its vectors in blocks.  The state of a set of
   vectors is its count, its exact integer sums, its mean, and all singular values
   and right vectors of its centred rows.  A block is centred by its own mean.
2. *Merges.*  Two states become one by stacking ``values * vectors`` of both and one
   row more, sqrt(n1 n2 / (n1 + n2)) (mean1 - mean2), and taking the SVD again.
   That row is all that two separate centrings leave out, and no direction is cut
   off, so the state has the squared singular values n * eigenvalues of the
   covariance of all rows, with the accuracy of an SVD of the rows themselves.
3. *Levels.*  Task states (d * d numbers each) are merged ``FAN_IN`` at a time, level
   by level, each level written to the shared folder; what a task holds, and the
   one state that reaches the driver, depend on the dimension alone.
4. *Whitening* is one pass without a shuffle.  The covariance of the whitened
   vectors is measured by the same states over the whitened rows.

Entries are turned into longs first (``floor(scale * c) + shift``), so sums and
deviations are exact and do not depend on the order of the rows.

Defined results
* Rows whose vector is null, or holds null or non-finite entries, are dropped; so are
  rows whose dimension is not that of most rows (the larger, if two are as frequent),
  and rows with an entry beyond 2^50 after scaling.
* Null ids and repeated rows are rows like any other.
* Components are numbered from 1 by falling eigenvalue; the entry of largest size is
  positive.  There are as many as the dimension has, ``components`` at most.
* A component without variance (equal rows, fewer rows than dimensions) has whitened
  null, and explained 0 or, if nothing varies, null.  The error is then taken over the
  others, and is null if there is none.
* deviation is null where it does not fit into a long.
* Empty table: no rows.  Other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wattline.llm.text import settle, small_batches

SCALE, SHIFT = 1024, 100_000
COMPONENTS = 8
FAN_IN = 16
#: Rows of a block that is centred and decomposed at once.
BLOCK = 4096
_STATE = "place long, n long, sums array<decimal(38,0)>, mean array<double>, s array<double>, vt array<double>"


@dataclass
class State:
    """Count, exact sums (Python ints) or None, mean, singular values and right vectors."""

    n: int
    sums: list[int]
    mean: np.ndarray
    s: np.ndarray
    vt: np.ndarray

    @classmethod
    def of(cls, rows: np.ndarray) -> State:
        """State of a block; ``rows`` may be longs or doubles."""
        exact = rows.dtype.kind == "i"
        sums = [int(x) for x in rows.sum(axis=0)] if exact else [0] * rows.shape[1]
        if exact:
            # Subtract a whole number first, so that what is rounded is small.
            base = np.array([t // len(rows) for t in sums], dtype=np.int64)
            rest = np.array([t - int(b) * len(rows) for t, b in zip(sums, base, strict=True)], dtype=np.float64) / len(rows)
            centred, mean = (rows - base) - rest, base + rest
        else:
            mean = rows.mean(axis=0)
            centred = rows - mean
        return cls(len(rows), sums, mean, *full_rank(centred))

    def merge(self, other: State) -> State:
        n = self.n + other.n
        gap = np.sqrt(self.n * (other.n / n)) * (self.mean - other.mean)
        stacked = np.vstack([self.s[:, None] * self.vt, other.s[:, None] * other.vt, gap[None]])
        mean = self.mean + (other.mean - self.mean) * (other.n / n)
        return State(n, [a + b for a, b in zip(self.sums, other.sums, strict=True)], mean, *full_rank(stacked))


def full_rank(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All singular values and right vectors of ``rows``, d of them, zeros included."""
    d = rows.shape[1]
    if len(rows) > d:
        rows = np.linalg.qr(rows, mode="r")
    s, vt = np.linalg.svd(rows, full_matrices=True)[1:]
    return np.concatenate([s, np.zeros(d - len(s))]), vt


def to_longs(rows: np.ndarray, scale: int, shift: int) -> np.ndarray:
    return np.floor(rows * float(scale)).astype(np.int64) + shift


def _matrix(column: pa.Array, d: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64, copy=False).reshape(-1, d)


def _states(vectors: DataFrame, d: int, longs: tuple[int, int] | None) -> DataFrame:
    """One state a task with rows, of ``vec`` as it is or turned into longs."""

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = None
        for batch in batches:
            rows = _matrix(batch.column(0), d)
            for a in range(0, len(rows), BLOCK):
                block = rows[a : a + BLOCK]
                new = State.of(to_longs(block, *longs) if longs else block)
                state = new if state is None else state.merge(new)
        if state is not None:
            yield _batch(state, TaskContext.get().partitionId())

    return vectors.select("vec").mapInArrow(gather, _STATE)


def _row(state: State, place: int) -> dict:
    return {"place": place, "n": state.n, "sums": [Decimal(x) for x in state.sums], "mean": state.mean.tolist(), "s": state.s.tolist(), "vt": state.vt.ravel().tolist()}


def _batch(state: State, place: int) -> pa.RecordBatch:
    kinds = {"place": pa.int64(), "n": pa.int64(), "sums": pa.list_(pa.decimal128(38, 0)), "mean": pa.list_(pa.float64()), "s": pa.list_(pa.float64()), "vt": pa.list_(pa.float64())}
    return pa.RecordBatch.from_pydict({k: pa.array([v], type=kinds[k]) for k, v in _row(state, place).items()})


def _state(row) -> State:
    d = len(row["mean"])
    return State(int(row["n"]), [int(x) for x in row["sums"]], np.array(row["mean"], dtype=float), np.array(row["s"], dtype=float), np.array(row["vt"], dtype=float).reshape(d, d))


def _merge_group(states: pd.DataFrame) -> pd.DataFrame:
    state = None
    # In the order of their numbers, so that a rerun merges alike.
    for row in states.sort_values("place").to_dict("records"):
        new = _state(row)
        state = new if state is None else state.merge(new)
    return pd.DataFrame([_row(state, int(states["place"].min()) // FAN_IN)])


def merged(states: DataFrame) -> State | None:
    """One state of all, merged ``FAN_IN`` at a time; None if there is none.

    ``place`` is the task's number; the tasks of a level that merge are neighbours.
    """
    level = settle(states)
    while level.count() > FAN_IN:
        level = settle(level.groupBy(F.expr(f"place div {FAN_IN}").alias("group")).applyInPandas(_merge_group, _STATE))
    state = None
    for row in sorted(level.collect(), key=lambda r: r["place"]):
        new = _state(row)
        state = new if state is None else state.merge(new)
    return state


@dataclass
class Whitening:
    """What whitens: the fitted rows' count and exact sums, components as rows of
    ``vectors`` with their eigenvalues, and the trace of the covariance."""

    n: int
    sums: list[int]
    vectors: np.ndarray
    values: np.ndarray
    trace: float
    scale: int
    shift: int

    @classmethod
    def of(cls, state: State, components: int, scale: int, shift: int) -> Whitening:
        k = min(components, len(state.s))
        vectors = state.vt[:k]
        vectors = vectors * np.where(vectors[np.arange(k), np.abs(vectors).argmax(axis=1)] < 0, -1.0, 1.0)[:, None]
        values = state.s[:k] ** 2 / state.n
        # Singular values of this size are what rounding leaves of zero.
        values[state.s[:k] <= state.s[:1].max(initial=0.0) * 1e-14 * len(state.s)] = 0.0
        return cls(state.n, state.sums, vectors, values, float((state.s**2).sum() / state.n), scale, shift)

    def apply(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(whitened rows, nan for components without variance; deviations, -1 if too large)."""
        x = to_longs(rows, self.scale, self.shift)
        base = np.array([t // self.n for t in self.sums], dtype=np.int64)
        odd = np.array([t - int(b) * self.n for t, b in zip(self.sums, base, strict=True)], dtype=np.int64)
        moved = x - base
        with np.errstate(divide="ignore", invalid="ignore", over="ignore"):
            white = ((moved - odd / self.n) @ self.vectors.T) / np.sqrt(self.values)
            about = ((moved.astype(float) * self.n - odd) ** 2).sum(axis=1)
            exact = ((moved * self.n - odd) ** 2).sum(axis=1)
        white[:, self.values == 0] = np.nan
        return white, np.where(about < 2.0**63 * (1 - 1e-9), exact, -1)


def finite_vectors(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = SCALE, shift: int = SHIFT) -> tuple[DataFrame, int]:
    """(vec_id, vec of the rows that can be fitted; their dimension)."""
    rows = df.select(F.col(id_col).alias("vec_id"), F.col(vector_col).cast("array<double>").alias("vec"))
    limit = float(1 << 50)
    fine = rows.where(F.col("vec").isNotNull() & F.forall("vec", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) * scale + abs(shift) < limit)))
    sizes = fine.groupBy(F.size("vec").alias("d")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), F.desc("d")).head(1)
    d = int(sizes[0]["d"]) if sizes else 0
    return fine.where(F.size("vec") == d), d


def fit(vectors: DataFrame, d: int, components: int = COMPONENTS, scale: int = SCALE, shift: int = SHIFT) -> Whitening | None:
    """The whitening of (vec_id, vec) rows of dimension ``d``; None without rows."""
    small_batches(vectors.sparkSession)
    state = merged(_states(vectors, d, (scale, shift))) if d else None
    return None if state is None else Whitening.of(state, components, scale, shift)


def whiten(vectors: DataFrame, model: Whitening) -> DataFrame:
    """vec_id, deviation, whitened (an entry a component) for every row of (vec_id, vec)."""
    d, id_type = len(model.sums), vectors.schema["vec_id"].dataType.simpleString()

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, BLOCK):
                part = batch.slice(a, BLOCK)
                white, deviation = model.apply(_matrix(part.column(1), d))
                flat = pa.array(white.ravel(), from_pandas=True)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, white.size + 1, white.shape[1]), pa.int32()), flat)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(deviation, mask=deviation < 0), lists], ["vec_id", "deviation", "whitened"])

    return vectors.select("vec_id", "vec").mapInArrow(apply, f"vec_id {id_type}, deviation long, whitened array<double>")


def identity_error(white: DataFrame, k: int) -> float | None:
    """Largest absolute entry of the covariance of ``whitened``, less the identity."""
    state = merged(_states(white.select(F.col("whitened").alias("vec")), k, None)) if k else None
    if state is None:
        return None
    scaled = state.s[:, None] * state.vt
    return float(np.abs(scaled.T @ scaled / state.n - np.eye(k)).max())


def whiten_embeddings(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", components: int = COMPONENTS, scale: int = SCALE, shift: int = SHIFT) -> DataFrame:
    """One row per fitted row and component: vec_id, component, n, deviation, whitened,
    explained, identity_error."""
    vectors, d = finite_vectors(df, id_col, vector_col, scale, shift)
    model = fit(vectors, d, components, scale, shift)
    names = "vec_id component n deviation whitened explained identity_error".split()
    if model is None:
        id_type = vectors.schema["vec_id"].dataType.simpleString()
        kinds = (id_type, "int", "long", "long", "double", "double", "double")
        return df.sparkSession.createDataFrame([], ", ".join(f"{a} {b}" for a, b in zip(names, kinds, strict=True)))
    white = settle(whiten(vectors, model))
    varied = [i for i, e in enumerate(model.values) if e > 0]
    error = identity_error(white.select(F.array(*[F.col("whitened")[i] for i in varied]).alias("whitened")) if varied else white, len(varied))
    shares = F.array(*[F.lit(float(e / model.trace) if model.trace else None).cast("double") for e in model.values])
    each = white.select("vec_id", "deviation", F.posexplode("whitened").alias("at", "whitened"))
    return each.select(
        "vec_id", (F.col("at") + 1).alias("component"), F.lit(model.n).cast("long").alias("n"), "deviation", "whitened",
        F.get(shares, F.col("at")).alias("explained"), F.lit(error).cast("double").alias("identity_error"),
    )
