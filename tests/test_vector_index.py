"""The vector index against all pairs in numpy."""

import numpy as np
import pytest

from tests.oracle import SF
from wattline.operators import retrieval, vector_index
from wattline.plans import registry


def frame(spark, rows, name="vec_id"):
    return spark.createDataFrame([(i, None if v is None else [None if x is None else float(x) for x in v]) for i, v in rows], f"{name} long, embedding array<float>")


def brute(queries, rows, k):
    def unit(v):
        v = np.array(v, dtype=np.float32).astype(float)
        return v / np.linalg.norm(v)

    ids, m = np.array([i for i, _ in rows]), np.array([unit(v) for _, v in rows])
    out = {}
    for q, v in queries:
        s = np.round(m @ unit(v), 12)
        out[q] = [int(ids[j]) for j in np.lexsort((ids, -s))[:k]]
    return out


def found(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r.query_id, r.rank)):
        out.setdefault(r.query_id, []).append(r.doc_id)
    return out


def clustered(n, d=16, groups=8, seed=3):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(groups, d))
    return [(i, centres[rng.integers(groups)] + 0.6 * rng.normal(size=d)) for i in range(n)]


@pytest.mark.parametrize("rows_of_a_block", [20_000, 40])
def test_exact_search_is_that_of_all_pairs(spark, monkeypatch, rows_of_a_block):
    monkeypatch.setattr(vector_index, "ROWS", rows_of_a_block)
    monkeypatch.setattr(vector_index, "QUERIES", 7)
    rows = clustered(600)
    rows += [(1000 + i, rows[0][1]) for i in range(300)]
    queries = [*rows[::9], (5000, -rows[0][1])]
    index = vector_index.build(frame(spark, rows), cells=9)
    assert index.sizes.sum() == 900
    got = found(vector_index.search(frame(spark, queries, "query_id"), index, 7, probes=2, exact=True))
    assert got == brute(queries, rows, 7)


def test_recall_of_the_query_and_of_clustered_rows(spark):
    found_by_index, truth = (registry.queries()[n](spark, SF) for n in ("vector_index_topk", "vector_topk"))
    assert vector_index.recall(found_by_index, truth) >= 0.9
    rows = clustered(3000, d=24, groups=40)
    index = vector_index.build(frame(spark, rows))
    got = found(vector_index.search(frame(spark, rows[::30], "query_id"), index, 10))
    want = brute(rows[::30], rows, 10)
    assert sum(len(set(got[q]) & set(want[q])) for q in want) >= 0.9 * 10 * len(want)


def test_many_queries_go_through_the_index(spark):
    rows = clustered(200)
    few = retrieval.top_k(frame(spark, rows, "query_id"), frame(spark, rows), 4)
    many = retrieval.top_k(frame(spark, rows, "query_id"), frame(spark, rows), 4, max_queries=50)
    assert found(few) == found(many) == brute(rows, rows, 4)


def test_rows_that_cannot_be_compared(spark):
    nan = float("nan")
    bad = [(90, None), (91, [0.0, 0.0]), (92, [nan, 1.0]), (93, [1.0, None]), (94, [1.0]), (95, [])]
    rows = [(1, [1.0, 0.0]), (2, [0.0, 2.0]), (3, [3.0, 3.0])]
    index = vector_index.build(frame(spark, rows + bad))
    got = found(vector_index.search(frame(spark, rows[:1] + bad, "query_id"), index, 5, exact=True))
    assert got == {1: [1, 3, 2]}
    for none in ([], bad[:2]):
        assert vector_index.search(frame(spark, rows, "query_id"), vector_index.build(frame(spark, none)), 5).count() == 0
    assert vector_index.search(frame(spark, [], "query_id"), index, 5).count() == 0
