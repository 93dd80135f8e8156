"""Inverted-file index over vectors, and block-wise cosine search in it.

* *Fit.*  Centroids by spherical k-means on at most ``SAMPLE`` rows, those with the
  smallest hash of their id (a documented bound; the rows of the sample, not the
  table, reach the driver).
  On the same sample the number of cells to probe is measured: as many as the neighbours
  of its rows among the sample need for a recall of ``RECALL``.
* *Assign.*  Every row of the table goes to its nearest centroid, in one pass, as a unit
  vector.  The index is a table in the shared folder.
* *Search.*  Queries go to the cells they probe.  Rows and queries of a cell meet in blocks
  of at most about ``ROWS`` and ``QUERIES`` (cells are cut by a hash of the ids, so a cell
  with a third of all rows is many tasks); a block is one matrix product, of which each
  query keeps its k best.  What moves then is k rows a query and block.
* *Exact search* probes the nearest cells first.  A cell whose members lie within an angle
  r of its centroid holds nothing nearer to a query at angle t than t - r, so only the
  cells where that could beat the k-th best so far are visited in a second step.

Scores are cosines rounded to 12 places, ties by id.  Vectors that are null, of length
zero, of another dimension than most of the sample, or that hold null or non-finite
entries are neither found nor searched for.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wattline.functions.tables import settle

SAMPLE = 16_384
MOST_CELLS = 4096
ROWS, QUERIES = 20_000, 2_000
#: Share of the neighbours in the sample that lie in the cells a query probes by default.
RECALL = 0.95


def _matrix(column: pa.Array, d: int) -> tuple[np.ndarray, np.ndarray]:
    """(places, unit vectors) of the usable vectors of a column."""
    sizes = np.diff(column.offsets.to_numpy()) if len(column) else np.zeros(0, dtype=int)
    whole = np.flatnonzero((sizes == d) & ~column.is_null().to_numpy(zero_copy_only=False))
    flat = column.take(pa.array(whole)).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, d)
    with np.errstate(all="ignore"):
        # Scaled by the largest entry first, so that squares neither overflow nor vanish.
        flat = flat / np.abs(flat).max(axis=1, initial=0.0)[:, None]
        unit = flat / np.linalg.norm(flat, axis=1)[:, None]
    fine = np.isfinite(unit).all(axis=1)
    return whole[fine], unit[fine]


def _lists(rows: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.arange(0, rows.size + 1, rows.shape[1]), pa.int32()), pa.array(rows.ravel()))


def centroids_of(unit: np.ndarray, cells: int, rounds: int = 12, seed: int = 7) -> np.ndarray:
    """Spherical k-means; cells that run empty restart at the row furthest from its own."""
    rng = np.random.default_rng(seed)
    centres = unit[rng.choice(len(unit), size=min(cells, len(unit)), replace=False)]
    for _ in range(rounds):
        near = unit @ centres.T
        own, score = near.argmax(axis=1), near.max(axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, own, unit)
        empty = np.flatnonzero(np.bincount(own, minlength=len(centres)) == 0)
        sums[empty] = unit[np.argsort(score, kind="stable")[: len(empty)]]
        norms = np.linalg.norm(sums, axis=1, keepdims=True)
        centres = np.where(norms > 0, sums / np.maximum(norms, 1e-300), centres)
    return centres


def probes_needed(unit: np.ndarray, centres: np.ndarray, k: int = 10, asks: int = 256, share: float = RECALL) -> int:
    """Cells that the first ``asks`` rows must visit to meet ``share`` of their k nearest others."""
    asks = min(asks, len(unit))
    near = unit[:asks] @ unit.T
    near[np.arange(asks), np.arange(asks)] = -2.0
    best = np.argsort(-near, axis=1, kind="stable")[:, : min(k, len(unit) - 1)]
    place = np.argsort(np.argsort(-(unit[:asks] @ centres.T), axis=1, kind="stable"), axis=1)
    ranks = np.sort(place[np.arange(asks)[:, None], (unit @ centres.T).argmax(axis=1)[best]].ravel())
    return int(ranks[min(len(ranks) - 1, int(np.ceil(share * len(ranks))) - 1)]) + 1 if len(ranks) else 1


@dataclass
class Index:
    """``rows``: (cell, doc_id, unit); ``reach`` and ``sizes`` by cell: least cosine of a
    member to its centroid, and the number of members; ``probes``: cells to visit."""

    rows: DataFrame
    probes: int
    centroids: np.ndarray
    reach: np.ndarray
    sizes: np.ndarray


def build(corpus: DataFrame, doc_id: str = "vec_id", vector: str = "embedding", cells: int | None = None, sample: int = SAMPLE) -> Index | None:
    """The index of every usable row; None if there is none."""
    source = corpus.select(F.col(doc_id).alias("doc_id"), F.col(vector).cast("array<double>").alias("v"))
    some = source.where("v is not null").orderBy(F.xxhash64("doc_id", "v")).limit(sample).select("v").toArrow()["v"].combine_chunks()
    sizes = np.array([len(v) for v in some if v.is_valid], dtype=int)
    if not len(sizes):
        return None
    d = int(np.bincount(sizes).argmax())
    unit = _matrix(some, d)[1] if d else np.zeros((0, 0))
    if not len(unit):
        return None
    wanted = cells or min(MOST_CELLS, max(1, round(np.sqrt(source.count()) / 2)), max(1, len(unit) // 4))
    centres = centroids_of(unit, wanted)
    id_type = source.schema["doc_id"].dataType.simpleString()

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, units = _matrix(batch.column(1), d)
            near = units @ centres.T
            cell = near.argmax(axis=1) if len(at) else np.zeros(0, dtype=int)
            columns = [pa.array(cell.astype(np.int32)), batch.column(0).take(pa.array(at)), _lists(units), pa.array(near.max(axis=1) if len(at) else np.zeros(0))]
            yield pa.RecordBatch.from_arrays(columns, ["cell", "doc_id", "unit", "near"])

    rows = settle(source.mapInArrow(assign, f"cell int, doc_id {id_type}, unit array<double>, near double"))
    stats = {r["cell"]: r for r in rows.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.min("near").alias("reach")).collect()}
    reach = np.array([stats[c]["reach"] if c in stats else 1.0 for c in range(len(centres))])
    return Index(rows.select("cell", "doc_id", "unit"), probes_needed(unit, centres), centres, reach, np.array([stats[c]["n"] if c in stats else 0 for c in range(len(centres))]))


def _visits(queries: DataFrame, index: Index, probes: int, beyond: bool) -> DataFrame:
    """(cell, query_id, unit): the ``probes`` nearest cells, or, with ``beyond``, the others
    that could hold a member nearer than the query's ``least``."""
    centres, d, filled = index.centroids, index.centroids.shape[1], index.sizes > 0
    angle = np.arccos(np.clip(index.reach, -1, 1))
    id_type = queries.schema["query_id"].dataType.simpleString()

    def visit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, units = _matrix(batch.column(1), d)
            near = np.where(filled, units @ centres.T, -2.0)
            rank = np.argsort(np.argsort(-near, axis=1, kind="stable"), axis=1)
            chosen = (rank < probes) & filled
            if beyond:
                least = batch.column(2).take(pa.array(at)).to_numpy(zero_copy_only=False)
                bound = np.cos(np.maximum(0.0, np.arccos(np.clip(near, -1, 1)) - angle))
                chosen = ~chosen & filled & ~(bound < least[:, None] - 1e-9)
            q, cell = np.nonzero(chosen)
            for a in range(0, len(q), 10_000):
                part = q[a : a + 10_000]
                yield pa.RecordBatch.from_arrays([pa.array(cell[a : a + 10_000].astype(np.int32)), batch.column(0).take(pa.array(at[part])), _lists(units[part])], ["cell", "query_id", "unit"])

    return queries.mapInArrow(visit, f"cell int, query_id {id_type}, unit array<double>")


def _meet(visits: DataFrame, index: Index, k: int) -> DataFrame:
    """(query_id, doc_id, score): the k best of each query in each block."""
    spark = visits.sparkSession
    asked = {r["cell"]: r["n"] for r in visits.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).collect()}
    # At most one row a cell.
    cuts = [(c, -(-int(index.sizes[c]) // ROWS), -(-n // QUERIES)) for c, n in asked.items()]
    cuts = F.broadcast(spark.createDataFrame(cuts, "cell int, row_cuts int, query_cuts int"))

    def part(own, of):
        return F.pmod(F.xxhash64(own), F.col(of)).cast("int")

    def every(of):
        return F.explode(F.sequence(F.lit(0), F.col(of) - 1))

    members = index.rows.join(cuts, "cell").select("cell", part("doc_id", "row_cuts").alias("r"), every("query_cuts").alias("q"), "doc_id", "unit")
    searched = visits.join(cuts, "cell").select("cell", every("row_cuts").alias("r"), part("query_id", "query_cuts").alias("q"), "query_id", "unit")
    types = f"query_id {visits.schema['query_id'].dataType.simpleString()}, doc_id {members.schema['doc_id'].dataType.simpleString()}, score double"
    d = index.centroids.shape[1]

    def block(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return pa.table({"query_id": right["query_id"][:0], "doc_id": left["doc_id"][:0], "score": pa.array([], pa.float64())})
        left = left.sort_by("doc_id")
        rows, asks = (t["unit"].combine_chunks().flatten().to_numpy().reshape(-1, d) for t in (left, right))
        who, found, scores = [], [], []
        for a in range(0, len(asks), 256):
            s = np.round(asks[a : a + 256] @ rows.T, 12)
            best = np.argsort(-s, axis=1, kind="stable")[:, :k] if s.shape[1] <= 4 * k else None
            for i, line in enumerate(s):
                if best is not None:
                    at = best[i]
                else:
                    at = np.flatnonzero(line >= np.partition(line, -k)[-k])
                    at = at[np.argsort(-line[at], kind="stable")[:k]]
                who.append(np.full(len(at), a + i))
                found.append(at)
                scores.append(line[at])
        return pa.table({"query_id": right["query_id"].take(pa.array(np.concatenate(who))), "doc_id": left["doc_id"].take(pa.array(np.concatenate(found))), "score": pa.array(np.concatenate(scores))})

    return members.groupBy("cell", "r", "q").cogroup(searched.groupBy("cell", "r", "q")).applyInArrow(block, types)


def _best(found: DataFrame, k: int) -> DataFrame:
    w = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "doc_id")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def search(queries: DataFrame, index: Index | None, k: int = 10, probes: int | None = None, exact: bool = False, query_id: str = "query_id", vector: str = "embedding") -> DataFrame:
    """query_id, doc_id, score, rank: the k nearest by cosine, for any number of queries.

    ``probes`` is the number of cells a query visits, by default what the index measured,
    or, for an exact search, an eighth of the cells before the bounds decide.
    """
    asks = queries.select(F.col(query_id).alias("query_id"), F.col(vector).cast("array<double>").alias("v"))
    if index is None:
        none = asks.limit(0).select("query_id", F.col("query_id").alias("doc_id"), F.lit(0.0).alias("score"), F.lit(0).alias("rank"))
        return none.where("false")
    probes = probes or (-(-len(index.centroids) // 8) if exact else index.probes)
    asks = settle(asks)
    first = _meet(settle(_visits(asks, index, probes, False)), index, k)
    if not exact:
        return _best(first, k)
    first = settle(_best(first, k))
    least = first.groupBy("query_id").agg(F.max(F.when(F.col("rank") == k, F.col("score"))).alias("least"))
    more = settle(_visits(asks.join(least, "query_id", "left").select("query_id", "v", "least"), index, probes, True))
    return _best(first.drop("rank").union(_meet(more, index, k)), k)


def recall(found: DataFrame, truth: DataFrame) -> float:
    """Share of the true (query_id, doc_id) that were found."""
    row = truth.join(found.select("query_id", "doc_id", F.lit(1).alias("hit")), ["query_id", "doc_id"], "left").agg(F.avg(F.coalesce("hit", F.lit(0))).alias("r")).first()
    return float(row["r"] or 0.0)
