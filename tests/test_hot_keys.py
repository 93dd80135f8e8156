"""Shuffles by margins, hot terms and importance against plain versions."""

import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.oracle import SF
from wattline.operators import ml, news
from wattline.plans import registry


def titles(spark, texts):
    return spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "article_id long, title string")


def all_pairs(spark, df, threshold):
    """Every pair by its cosine, from the weights of all terms."""
    vectors, bags = {}, {}
    for r in news.tf_idf(df).collect():
        vectors.setdefault(r.article_id, {})[r.term] = r.weight
        bags.setdefault(r.article_id, set()).add((r.term, r.tf))
    out = {}
    for a, b in itertools.combinations(sorted(vectors), 2):
        s = sum(w * vectors[b].get(t, 0.0) for t, w in vectors[a].items())
        if s >= threshold:
            out[a, b] = s
    return out, bags


@pytest.mark.parametrize("small", [1, 2, 5, 1000])
@pytest.mark.parametrize("threshold", [0.85, 0.6])
def test_split_terms_lose_no_pair(spark, monkeypatch, small, threshold):
    rng = random.Random(small)
    monkeypatch.setattr(news, "SMALL_CELL", small)
    words = [f"w{i}" for i in range(14)]
    df = titles(spark, [" ".join(rng.choices(words, [2.0**-i for i in range(14)], k=rng.randrange(1, 7))) for _ in range(120)])
    want, bags = all_pairs(spark, df, threshold)
    got = {(r.a, r.b) for r in news.similar_pairs(df, threshold).collect()}
    bag = lambda i: frozenset(bags[i])
    first = {}
    for i in sorted(bags):
        first.setdefault(bag(i), i)
    # Of articles with one bag of terms, the first meets the others and all the rest.
    assert got == {p for p in want if bag(p[0]) == bag(p[1]) and p[0] == first[bag(p[0])] or bag(p[0]) != bag(p[1]) and all(first[bag(i)] == i for i in p)}


def test_a_term_in_thousands_of_titles_makes_few_pairs(spark):
    """Each title is a common term with one of 2,500 others, twice in other order and once more."""
    texts = [f"storage x{i}" for i in range(2500)] + [f"y{i} storage x{i}" for i in range(2500)]
    v = news.vectors(news.tf_idf(titles(spark, texts)))
    cells = news.meeting_cells(v.withColumn("mass", F.lit(1.0)), 0.85)  # every term starts cells, the common one too
    sizes = [r["count"] for r in cells.groupBy("cell").count().collect()]
    assert sum(n * (n - 1) // 2 for n in sizes) < 3 * 2500
    a, b = (cells.select("cell", F.col("article_id").alias(x)) for x in "ab")
    assert {r.b for r in a.join(b, "cell").where("a = 7 and b > 7").collect()} <= {2507}


def test_large_cells_meet_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(news, "BLOCK", 7)
    df = titles(spark, [f"one two three four five six seven eight u{i % 40} z{i // 40}" for i in range(150)])
    want, bags = all_pairs(spark, df, 0.6)
    got = {(r.a, r.b): r.cosine for r in news.similar_pairs(df, 0.6).collect()}
    assert len(want) > 200 and got.keys() == want.keys() and all(abs(got[p] - want[p]) < 1e-9 for p in want)


def kept_in_order(ids, pairs):
    """Ids to drop: each kept article drops its later near copies."""
    gone = set()
    for i in ids:
        if i not in gone:
            gone |= {b for a, b in pairs if a == i}
    return gone


@pytest.mark.parametrize(("small", "block", "step", "threshold"), [(2, 5, 10, 0.6), (1000, 1000, 20_000, 0.85), (1000, 6, 9, 0.6)])
def test_near_copies_match_a_loop_over_all_pairs(spark, monkeypatch, small, block, step, threshold):
    rng = random.Random(step)
    monkeypatch.setattr(news, "BLOCK", block)
    words = [f"w{i}" for i in range(14)]
    texts = [" ".join(rng.choices(words, [2.0**-i for i in range(14)], k=rng.randrange(0, 7))) for _ in range(120)]
    df = titles(spark, texts).withColumn("article_id", (F.col("article_id") * 37) % 120)
    pairs, bags = all_pairs(spark, df, threshold)
    got = [r.article_id for r in news.near_copies(df, threshold, step=step, small=small).collect()]
    assert len(got) == len(set(got)) and set(got) == kept_in_order(sorted(bags), pairs) and got


def test_copies_of_a_dropped_article_go_too(spark):
    """The second title is a near copy of the first, the third has the second's terms in other order."""
    base = "gas storage levels fell week cold weather pushed demand higher across region".split()
    df = titles(spark, [" ".join(base), " ".join([*base, "area"]), " ".join(["area", *base]), "solar panels"])
    assert sorted(r.article_id for r in news.near_copies(df).collect()) == [1, 2]


def test_no_article_has_near_copies_or_terms(spark):
    assert news.near_copies(titles(spark, ["the", "", None, "solar panels", "wind farm"])).collect() == []
    assert news.near_copies(titles(spark, ["x"]).limit(0)).collect() == []


def test_a_group_of_near_copies_meets_what_stays_of_it(spark, monkeypatch):
    """2,000 titles, each a near copy of all others: what meets grows with the group, not with its square."""
    monkeypatch.setattr(news, "BLOCK", 50)
    met, plain = [], news._compare
    monkeypatch.setattr(news, "_compare", lambda dealt, whole, t: met.append(dealt.count()) or plain(dealt, whole, t))
    df = titles(spark, [f"one two three four five six seven eight nine ten eleven twelve u{i}" for i in range(2000)])
    assert sorted(r.article_id for r in news.near_copies(df, 0.1, step=50).collect()) == list(range(1, 2000))
    assert sum(met) < 4 * 2000 * 14


def test_shuffles_by_margins_follow_a_random_pairing():
    rng = np.random.default_rng(0)
    a = [0, 1, None, 2, 1, 0, 1, 1, 0, 3] * 6
    p = [1, 1, 0, None, 1, 0, 2, 1, 0, 0] * 6
    count = lambda values: {k: values.count(k) for k in dict.fromkeys(values)}
    drawn = [ml.shuffled_hits(np.random.default_rng(i), count(a), count(p)) for i in range(6000)]
    dealt = []
    for _ in range(6000):
        order = rng.permutation(len(a))
        pairs = [(a[i], y) for i, y in zip(order, p, strict=True) if a[i] is not None and y is not None]
        dealt.append((sum(x == y for x, y in pairs), len(pairs)))
    for side in (0, 1):
        x, y = np.array([d[side] for d in drawn]), np.array([d[side] for d in dealt])
        assert abs(x.mean() - y.mean()) < 0.15 and abs(x.std() / y.std() - 1) < 0.06
        edges = np.unique(np.quantile(y, np.linspace(0, 1, 9)))
        assert np.abs(np.histogram(x, edges)[0] - np.histogram(y, edges)[0]).max() < 250
    big = ml._hypergeometric(np.random.default_rng(1), 3 * 10**9, 7 * 10**9, 10**9)
    assert abs(big - 3 * 10**8) < 10**5


def test_permutation_by_class_counts(spark):
    rng = np.random.default_rng(2)
    a = rng.integers(0, 2, 400)
    p = np.where(rng.random(400) < 0.1, a, rng.integers(0, 2, 400))
    df = spark.createDataFrame([(i, int(x), int(y)) for i, (x, y) in enumerate(zip(a, p, strict=True))], "id long, a int, p int")
    got = ml.class_permutation_test(df, "a", "p", rounds=4000).first()
    null = np.array([(rng.permutation(a) == p).mean() for _ in range(4000)])
    assert got.real == pytest.approx((a == p).mean()) and abs(got.null_mean - null.mean()) < 0.003
    assert abs(got.p_value - (null >= got.real).mean()) < 0.03
    assert ml.class_permutation_test(df.repartition(5), "a", "p", rounds=100).first() == ml.class_permutation_test(df, "a", "p", rounds=100).first()
    assert ml.class_permutation_test(df.limit(0), "a", "p").count() == 0
    many = ml.class_permutation_test(df.withColumn("a", F.col("id").cast("int")), "a", "p", rounds=20, most_classes=50, on="id").first()
    assert 0 <= many.p_value <= 1


def test_importance_is_what_dealing_a_feature_anew_costs(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(900, 3))
    y = 3 * x[:, 0] - x[:, 1] + 0.1 * rng.normal(size=900)
    df = spark.createDataFrame([(*map(float, r), float(v)) for r, v in zip(x, y, strict=True)], "a double, b double, c double, y double")
    model = lambda m: 3 * m[:, 0] - m[:, 1]
    got = ml.permutation_importance(df, ["a", "b", "c"], "y", model, repeats=8, block=300).collect()
    want = {}
    for f, name in enumerate("abc"):
        more = []
        for _ in range(40):
            z = x.copy()
            z[:, f] = rng.permutation(z[:, f])
            more.append(((model(z) - y) ** 2).mean() - ((model(x) - y) ** 2).mean())
        want[name] = np.mean(more)
    assert [r.feature for r in sorted(got, key=lambda r: r["rank"])] == ["a", "b", "c"]
    assert all(abs(r.importance - want[r.feature]) < 0.08 * (want[r.feature] + 1e-3) + 1e-9 for r in got)
    again = ml.permutation_importance(df.repartition(6), ["a", "b", "c"], "y", model, repeats=8, block=300).collect()
    assert np.allclose(sorted(r.importance for r in got), sorted(r.importance for r in again))


def test_importance_query_ranks_all_features(spark):
    got = registry.queries()["feature_importance"](spark, SF).collect()
    assert sorted(r["rank"] for r in got) == [1, 2, 3, 4, 5, 6] and max(got, key=lambda r: r.importance).importance > 0
