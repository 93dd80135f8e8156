"""Text and vector queries on small tables that the test data lacks, against DuckDB."""

import numpy as np
import pytest

from tests.oracle import compare
from wattline.operators import retrieval
from wattline.plans import registry
from wattline.plans.frames import rounded


def test_language_of_copies_is_that_of_the_first_with_one(spark, tmp_path):
    rows = [(0, "La de en.", "fr"), (1, "La de en.", "es"), (2, "x", None), (3, "x", "fr"), (4, "x", "de"), (5, None, "fr"), (6, None, "en"), (7, "y", None), (8, "y", None), (9, "z", "en")]
    spark.createDataFrame(rows, "doc_id long, text string, lang string").coalesce(1).write.parquet(str(tmp_path / "whole"))
    (part,) = (tmp_path / "whole").glob("*.parquet")
    part.rename(tmp_path / "documents.parquet")
    got = registry.queries()["exact_duplicates"](spark, str(tmp_path))
    assert {(r.first_id, r.lang, r.n) for r in got.collect()} == {(0, "fr", 2), (2, "fr", 3), (5, "fr", 2), (7, None, 2)}
    compare(got, registry.oracle_sql()["exact_duplicates"], str(tmp_path))


def vectors(spark, tmp_path, rows):
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").coalesce(1).write.parquet(str(tmp_path / "whole"))
    (part,) = (tmp_path / "whole").glob("*.parquet")
    part.rename(tmp_path / "embeddings.parquet")
    return str(tmp_path)


def some_vectors(n, d=8, seed=5):
    """With copies, rows of one direction and, for ids over 200, few directions at all."""
    rng = np.random.default_rng(seed)
    v = rng.normal(size=(n, d)).astype(np.float32)
    v[::7] = v[0]
    v[3::11] = 2 * v[1]
    v[200:400] = np.eye(d, dtype=np.float32)[rng.integers(d, size=200)]
    return v


@pytest.mark.parametrize(("rows_of_a_block", "queries_of_a_block"), [(8_192, 10_000), (50, 3)])
def test_nearest_vectors_meet_in_blocks(spark, tmp_path, monkeypatch, rows_of_a_block, queries_of_a_block):
    monkeypatch.setattr(retrieval, "ROWS", rows_of_a_block)
    sf = vectors(spark, tmp_path, [(i, [float(x) for x in v], i % 10) for i, v in enumerate(some_vectors(900))])
    e = spark.read.parquet(f"{sf}/embeddings.parquet")
    got = retrieval.top_k(e.where("vec_id % 100 = 0").withColumnRenamed("vec_id", "query_id"), e, max_queries=queries_of_a_block)
    # No row is made for a pair.
    assert "NestedLoop" not in got._jdf.queryExecution().toString()
    compare(rounded(got), registry.oracle_sql()["vector_topk"], sf)


def test_queries_of_a_block_go_in_slices(monkeypatch):
    v = some_vectors(500)
    unit = v.astype(float) / np.linalg.norm(v.astype(float), axis=1)[:, None]
    want = [[int(i) for i in np.lexsort((np.arange(500), -np.round(unit @ u, 9)))[:10]] for u in unit]
    for most in (7, 256):
        monkeypatch.setattr(retrieval, "SLICE", most)
        got = [[] for _ in v]
        for q, r, _ in retrieval._nearest(v, v, 10):
            for i, j in zip(q, r, strict=True):
                got[i].append(int(j))
        assert got == want


def test_vectors_without_a_direction_rank_as_in_sql(spark, tmp_path):
    nan = float("nan")
    odd = {0: None, 5: [0.0] * 8, 17: [nan] + [1.0] * 7, 100: [0.0] * 8, 101: None, 200: [float("inf")] + [1.0] * 7}
    rows = [(i, odd.get(i, [float(x) for x in v]), i % 10) for i, v in enumerate(some_vectors(420))]
    sf = vectors(spark, tmp_path, rows)
    for name in ("vector_topk", "qa_answers"):
        compare(registry.queries()[name](spark, sf), registry.oracle_sql()[name], sf)


def test_few_rows_are_filled_with_those_that_cannot_be_compared(spark):
    rows = [(1, [1.0, 0.0]), (2, [1.0]), (3, None), (4, [0.0, 1.0]), (5, [None, 1.0]), (6, [])]
    asks = [(7, [3.0, 0.0]), (8, None), (9, [2.0])]
    corpus, queries = (spark.createDataFrame(t, f"{n} long, embedding array<double>") for n, t in (("vec_id", rows), ("query_id", asks)))
    got = {}
    for r in retrieval.top_k(queries, corpus, 4).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.doc_id, r.score))
    assert got == {7: [(1, 1.0), (4, 0.0), (2, None), (3, None)], 8: [(1, None), (2, None), (3, None), (4, None)], 9: [(2, 1.0), (1, None), (3, None), (4, None)]}
    assert retrieval.top_k(queries, corpus.where("false"), 4).count() == retrieval.top_k(queries.where("false"), corpus, 4).count() == 0


def test_questions_meet_the_corpus_in_blocks(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(retrieval, "ROWS", 64)
    sf = vectors(spark, tmp_path, [(i, [float(x) for x in v], i % 10) for i, v in enumerate(some_vectors(700))])
    got = registry.queries()["qa_answers"](spark, sf)
    assert "NestedLoop" not in got._jdf.queryExecution().toString()
    compare(got, registry.oracle_sql()["qa_answers"], sf)


def test_filter_comes_after_the_search(spark, tmp_path):
    v = some_vectors(700)
    sf = vectors(spark, tmp_path, [(i, [float(x) for x in e], i % 10) for i, e in enumerate(v)])
    unit = v.astype(float) / np.linalg.norm(v.astype(float), axis=1)[:, None]
    want = set()
    for q in range(0, 700, 100):
        s = np.round(unit @ unit[q], 9)
        found = [int(i) for i in np.lexsort((np.arange(700), -s))[:10] if i % 10 < 5]
        want |= {(q, i, rank) for rank, i in enumerate(found[:5], 1)}
    got = registry.queries()["retrieve_filtered"](spark, sf)
    assert "NestedLoop" not in got._jdf.queryExecution().toString()
    assert {(r.query_id, r.doc_id, r.rank) for r in got.collect()} == want
