"""WARC, n-gram join, toxicity, mixing, packing and the pipeline."""

import gzip
import random
import tracemalloc
import zlib
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tests.llm import brute
from tests.oracle import SF
from wattline.llm import components, kernels, mixing, ngram_join, packing, queries, toxicity, warc

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, None, s, None) for i, t, s in rows], DOCS)


# --- warc -----------------------------------------------------------------------

PAGES = "page_id long, url string, html string, payload string"


def test_warc_round_trip_at_every_split(spark, tmp_path):
    rng = random.Random(5)
    noise = "".join(chr(rng.randrange(32, 0x2FF)) for _ in range(5000))
    texts = ["<p>a</p>", "<p>a</p>", None, "", "WARC/1.1\r\n\r\n" * 3, noise, noise, "\x1f\x8b\x08"]
    rows = [(i, f"http://x/{i}\r\nEvil: 1", t, "clash") for i, t in enumerate(texts)] + [(None, None, "<p>a</p>", "clash")]
    warc.write_archives(spark.createDataFrame(rows, PAGES), str(tmp_path / "w"))
    files = [p for p in Path(tmp_path / "w").iterdir()]
    assert files and all(p.name.endswith(".warc.gz") and p.name[0] != "_" for p in files)
    assert all(gzip.decompress(p.read_bytes()).startswith(b"WARC/1.1") for p in files)
    for split in (7, 64, 1000, 1 << 25):
        got = warc.read_archives(spark, str(tmp_path / "w"), split_bytes=split).collect()
        by_id = {r.record_id: r for r in got}
        assert len(got) == len(rows) == len(by_id)
        for i, t in enumerate(texts):
            r, raw = by_id[f"urn:page:{i}"], (t or "").encode()
            first = min(j for j, x in enumerate(texts) if (x or "") == (t or ""))
            assert r.payload_bytes == len(raw) and r.payload_digest == warc.digest(raw)
            assert (r.record_type, r.refers_to) == (("response", None) if first == i else ("revisit", f"urn:page:{first}"))
            assert (r.payload == raw) if first == i else r.payload is None
        assert by_id["urn:page:"].record_type == "response" and "\n" not in by_id["urn:page:0"].target_uri


def test_warc_skips_damage_and_false_magic(tmp_path):
    import pyarrow.fs as pafs

    good = [warc.member(warc.record(f"r{i}", None, bytes([i]) * 300, None)) for i in range(3)]
    blob = good[0] + warc.MAGIC + b"junk" + good[1][:60] + good[2] + gzip.compress(b"not a record")
    (tmp_path / "a.warc.gz").write_bytes(blob)
    found = [h["warc-record-id"] for _, h, _ in warc.records(pafs.LocalFileSystem(), str(tmp_path / "a.warc.gz"), 0, len(blob))]
    assert found == ["<r0>", "<r2>"]


def _ids(path, split):
    import pyarrow.fs as pafs

    fs, size = pafs.LocalFileSystem(), path.stat().st_size
    return [h["warc-record-id"] for a in range(0, size, split) for _, h, _ in warc.records(fs, str(path), a, min(size, a + split))]


def test_warc_nested_members_are_no_records_at_any_split(tmp_path):
    rng = random.Random(7)
    noise = lambda n: rng.randbytes(n)
    inner = b"".join(warc.member(warc.record(f"urn:page:{900 + i}", None, noise(700), None)) for i in range(6))
    huge = b"".join(warc.member(warc.record(f"urn:page:{2000 + i}", None, noise(3000), None)) for i in range(120))
    payloads = [noise(30_000) + inner + noise(40_000), b"plain", inner, huge, noise(10) + warc.member(b"WARC/1.1\r\nno record")]
    blob = b"".join(warc.member(warc.record(f"urn:page:{i}", None, p, None)) for i, p in enumerate(payloads))
    path = tmp_path / "nested.warc.gz"
    path.write_bytes(blob)
    want = [f"<urn:page:{i}>" for i in range(len(payloads))]
    for split in (977, 5000, 20_000, 65_536, 150_000, len(blob)):
        assert _ids(path, split) == want, split


def test_warc_damage_gives_the_same_records_at_any_split(tmp_path):
    rng = random.Random(3)
    good = [warc.member(warc.record(f"r{i}", None, rng.randbytes(rng.randrange(50, 30_000)), None)) for i in range(12)]
    blob = b"".join(good[:3]) + warc.MAGIC + b"junk" + good[3][:60] + b"".join(good[4:9]) + good[9][:-5] + b"".join(good[10:])
    path = tmp_path / "damaged.warc.gz"
    path.write_bytes(blob)
    whole = _ids(path, len(blob))
    assert {"<r0>", "<r1>", "<r2>", "<r4>", "<r10>", "<r11>"} <= set(whole) and "<r3>" not in whole
    for split in (501, 4000, 33_333):
        assert _ids(path, split) == whole, split


def test_warc_clashing_columns_and_repeated_rows(spark, tmp_path):
    df = spark.createDataFrame([(1, "u", "<p>x</p>", "p"), (1, "u", "<p>x</p>", "p"), (2, None, "<p>x</p>", "p")], PAGES).withColumns({c: F.lit(1) for c in ("_key", "_first", "refers_to", "record_id")})
    assert warc.with_revisits(df).count() == 3
    warc.write_archives(df, str(tmp_path / "w"))
    got = sorted((r.record_id, r.record_type) for r in warc.read_archives(spark, str(tmp_path / "w")).collect())
    assert got == [("urn:page:1", "response")] * 2 + [("urn:page:2", "revisit")]


def test_warc_empty(spark, tmp_path):
    warc.write_archives(spark.createDataFrame([], PAGES), str(tmp_path / "w"))
    assert warc.read_archives(spark, str(tmp_path / "w")).count() == 0


# --- kernels --------------------------------------------------------------------


def test_word_hashes_follow_words(monkeypatch):
    monkeypatch.setattr(kernels, "BLOCK", 64)
    rng = random.Random(1)
    texts = ["".join(rng.choice("abc  \n\té\x0b") for _ in range(rng.randrange(0, 400))) for _ in range(60)] + [None, "", " ", "x" * 500]
    hashes, counts = kernels.word_hashes(*kernels.buffers(pa.array(texts)), lower=False)
    words = [w for t in texts for w in brute.words(t)]
    assert counts.tolist() == [len(brute.words(t)) for t in texts]
    table = {}
    for w, h in zip(words, hashes.tolist(), strict=True):
        assert table.setdefault(w, h) == h
    assert len(set(table.values())) == len(table)


# --- n-gram join ----------------------------------------------------------------


def _family(rng, n, words, edits):
    base = [f"w{rng.randrange(400)}" for _ in range(words)]
    for _ in range(n):
        w = list(base)
        for _ in range(rng.randrange(edits + 1)):
            w[rng.randrange(len(w))] = f"e{rng.randrange(10**6)}"
        yield " ".join(w)


@pytest.mark.parametrize(("size", "num"), [(3, 90), (5, 80)])
def test_components_match_all_pairs(spark, size, num):
    rng = random.Random(num)
    texts = [t for n, words, edits in ((40, 120, 4), (25, 40, 2), (10, 12, 1), (6, 300, 9)) for t in _family(rng, n, words, edits)]
    texts += ["same text here twice"] * 3 + ["A b", "a B", "a", "", "  \n", None, "One two three FOUR five six", "one TWO three four five six"]
    rng.shuffle(texts)
    rows = list(enumerate(texts))
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.similar_components(docs(spark, [(i, t, "s") for i, t in rows]), size, (num, 100)).collect()}
    assert got == brute.components(rows, size, num, 100)


def test_components_without_hub_luck(spark):
    """A chain: each text is near only to the next, so no single hub connects them."""
    words = [f"w{i}" for i in range(100)]
    chain = []
    for i in range(12):
        chain.append(" ".join(words))
        words[8 * i] = f"x{i}"
    rows = list(enumerate(chain))
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.similar_components(docs(spark, [(i, t, "s") for i, t in rows]), 3, (90, 100)).collect()}
    assert got == brute.components(rows, 3, 90, 100) and set(c for _, c in got.values()) == {0}


def test_ngram_edge_cases(spark):
    df = docs(spark, [(None, "a b c d", "s"), (1, "a b c d", "s"), (1, "a b c d", "s"), (2, "a b c d", "s")])
    got = sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in ngram_join.similar_components(df, 3, (90, 100)).collect())
    assert got == [("1", 2, "1"), ("1", 2, "1"), ("2", 2, "1"), ("None", 2, "None")]
    assert ngram_join.similar_components(docs(spark, []), 3, (90, 100)).count() == 0
    left = ngram_join.keep_one(df, 3, (90, 100))
    assert sorted(str(r.doc_id) for r in left.collect()) == ["1", "None"] and left.columns == df.columns
    clash = df.withColumns({c: F.lit(1) for c in ("_gone", "_doc_id", "_text_key", "node", "component_id", "n_shingles")})
    left = ngram_join.keep_one(clash, 3, (90, 100))
    assert sorted(str(r.doc_id) for r in left.collect()) == ["1", "None"] and left.columns == clash.columns


def test_sets_that_collide_on_the_node_hash_stay_apart(spark):
    rng = random.Random(8)
    rows = list(enumerate(t for n in (5, 4, 3) for t in _family(rng, n, 60, 2)))
    df = docs(spark, [(i, t, "s") for i, t in rows])
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join._members(df, 3, (80, 100), "doc_id", "text", node_bits=1).collect()}
    assert got == brute.components(rows, 3, 80, 100)


@pytest.mark.parametrize("num", [90, 40, 30])
def test_low_thresholds_and_tiny_sets(spark, num):
    rng = random.Random(num)
    rows = list(enumerate(" ".join(rng.choice("abc") for _ in range(rng.randrange(1, 6))) for _ in range(40)))
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.similar_components(docs(spark, [(i, t, "s") for i, t in rows]), 2, (num, 100)).collect()}
    assert got == brute.components(rows, 2, num, 100)


def test_one_shingle_in_thousands_of_unlike_texts_makes_no_quadratic_join(spark):
    j = ngram_join._Join(None, None, None, None, 3, 80, 100, 64)
    rooted = spark.range(5000).selectExpr("7L as key", "id as node", "30 as n", "0 as pos", "id as root")
    firsts = spark.range(5000).selectExpr("id as node", "array(7L, 1000 + id * 3, 1001 + id * 3, 1002 + if(id < 4, 0, id) * 3) as first")
    joined = ngram_join._still_apart(rooted, firsts, j).select("x_node", "y_node").collect()
    assert {tuple(sorted(r)) for r in joined} <= {(a, b) for a in range(4) for b in range(a)} | {(a, b) for b in range(4) for a in range(b)}
    assert {(0, 1), (0, 2), (0, 3)} <= {tuple(sorted(r)) for r in joined} and len(joined) < 20


@pytest.mark.parametrize("few", [1, 4])
def test_split_groups_lose_no_link(spark, monkeypatch, few):
    monkeypatch.setattr(ngram_join, "FEW", few)
    rng = random.Random(few)
    rows = list(enumerate(t for n, words, edits in ((30, 60, 4), (20, 25, 2), (12, 9, 1)) for t in _family(rng, n, words, edits)))
    for bits, num in ((6, 80), (22, 70), (6, 40)):
        got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join._members(docs(spark, [(i, t, "s") for i, t in rows]), 2, (num, 100), "doc_id", "text", bits=bits).collect()}
        assert got == brute.components(rows, 2, num, 100), (bits, num)


def test_sketch_grows_with_the_input():
    assert [ngram_join.sketch_bits(n) for n in (0, 10, 10**6, 10**12)] == [22, 22, 24, 26]


def test_star_contraction(spark):
    rng = random.Random(3)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(260)]
    parent = list(range(300))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = sorted((find(a), find(b)))
        parent[b] = a
    got = {r.node: r.root for r in components.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {x: find(x) for e in edges for x in e if e[0] != e[1] or any(x in f and f[0] != f[1] for f in edges)}


# --- toxicity -------------------------------------------------------------------


def test_toxicity_held_out(spark):
    rng = random.Random(9)
    syllables = ["na", "to", "ri", "ve", "lo", "ka", "mi", "su"]
    word = lambda: "".join(rng.choice(syllables) for _ in range(rng.randrange(1, 4)))
    rows, labels = [], []
    for i in range(1200):
        bad = rng.random() < 0.15
        w = [word() for _ in range(rng.randrange(10, 60))]
        if bad:
            w[rng.randrange(len(w))] = rng.choice(["grumpf", "zonk" + rng.choice(syllables), "Zonk" + word()])
        rows.append((i, " ".join(w), "s"))
        labels.append((i, 1, int(bad)))
    rows += [(5000, None, "s"), (5001, "", "s"), (None, "grumpf", "s")]
    lab = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = toxicity.scores(docs(spark, rows), lab).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 for r in got)
    truth = {i: t for i, _, t in labels}
    held = [(r.score, truth[r.doc_id], r.predicted) for r in got if r.held_out and r.doc_id in truth]
    assert all(r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in got)
    pos, neg = [s for s, t, _ in held if t], [s for s, t, _ in held if not t]
    assert np.mean([[(p > n) + 0.5 * (p == n) for n in neg] for p in pos]) > 0.95
    assert sum(p for _, t, p in held if t) / len(pos) > 0.9
    again = toxicity.scores(docs(spark, rows), lab).collect()
    assert sorted((str(r.doc_id), r.score) for r in got) == sorted((str(r.doc_id), r.score) for r in again)
    none = toxicity.scores(docs(spark, rows[:5]), lab.where("toxic = 0")).collect()
    assert len({r.score for r in none}) == 1


def test_toxicity_models_match_the_definition(spark):
    rng = random.Random(6)
    words = ["".join(rng.choice("abc") for _ in range(rng.randrange(1, 8))) for _ in range(60)]
    bad, good, rest = ([rng.choice(words) for _ in range(n)] for n in (60, 150, 300))
    rows = [(1, " ".join(bad), "s"), (2, " ".join(good).upper(), "s"), (3, " ".join(rest), "s"), (4, None, "s")]
    learnt = spark.createDataFrame([(rows[0][1], 1), (rows[1][1], 0)], "text string, toxic int")
    model = toxicity.fit_model(docs(spark, rows), learnt)
    count = lambda ws: {w: ws.count(w) for w in ws}
    said = [*words, "zzz", "abz", "cabbac"]
    want = brute.kneser_ney_ratios(count(bad + good + rest), count(bad), count(good), said)
    data, offsets = kernels.buffers(pa.array(said))
    got = toxicity.word_ratios(model, data, offsets[:-1], offsets[1:])
    assert np.allclose(got, [want[w] for w in said], atol=1e-4)
    found = toxicity.features(model, pa.array(["abz " + words[0], "", None]))
    each = [want[w] / (len(w) + 1) for w in ("abz", words[0])]
    assert np.allclose(found, [[max(each), np.mean(each), np.mean(each), np.log(2)], [0] * 4, [0] * 4], atol=1e-4)


def _made_words(n):
    rng = np.random.default_rng(5)
    said = sorted({bytes(rng.integers(97, 123, rng.integers(4, 12), dtype=np.uint8)) for _ in range(n)})
    return pa.RecordBatch.from_arrays([pa.array(said, pa.binary())], ["word"])


def _peak_mb(run):
    tracemalloc.start()
    try:
        out = run()
        return out, tracemalloc.get_traced_memory()[1] / 1e6
    finally:
        tracemalloc.stop()


def test_toxicity_steps_take_words_in_slices(monkeypatch):
    """The scratch memory of the steps over class words does not grow with all their letters."""
    few, many = _made_words(2_000), _made_words(120_000)
    _, peak = _peak_mb(lambda: sum(b.num_rows for b in toxicity._needs(iter([many]))))
    assert peak < 120

    def fit(words):
        said, n = toxicity._words_of(pa.Table.from_batches([words])), words.num_rows
        rows = [(g, c, w) for _, _, g, c, w in toxicity.gram_rows(*said, np.ones(n))]
        gram, context, weight = (np.concatenate(x) for x in zip(*rows, strict=True))
        grams, first = np.unique(gram, return_index=True)
        contexts, at = np.unique(context[first], return_inverse=True)
        counts = weight[first]
        shared = toxicity.Shared(grams, counts, contexts, np.bincount(at, weights=counts), np.bincount(at))
        toxic = np.arange(n) % 3
        return _peak_mb(lambda: toxicity.train(*said, toxic, 2 - toxic, shared))

    whole, _ = fit(few)
    assert fit(many)[1] < 150
    monkeypatch.setattr(toxicity, "WORDS", 150)
    sliced, _ = fit(few)
    for name in ("grams", "gram_ratio", "contexts", "context_ratio"):
        assert np.array_equal(getattr(whole, name), getattr(sliced, name))
    found = [np.unique(np.concatenate([b.column(1).to_numpy() for b in toxicity._needs(iter([few])) if b.column(0)[0].as_py() is k])) for k in (True, False)]
    monkeypatch.setattr(toxicity, "WORDS", 2_000)
    for k, values in zip((True, False), found, strict=True):
        assert np.array_equal(values, np.unique(np.concatenate([b.column(1).to_numpy() for b in toxicity._needs(iter([few])) if b.column(0)[0].as_py() is k])))


def test_toxicity_edges(spark):
    lab = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    long = "word " * 300_000
    df = docs(spark, [(1, long, "s"), (1, long, "s"), (2, None, "s"), (None, "x", "s")]).withColumns({c: F.lit(1) for c in ("toxic", "role", "h", "word", "score")})
    assert len({r.score for r in toxicity.scores(df, lab).collect()}) == 1
    assert toxicity.scores(df.limit(0), lab).count() == 0
    lab = spark.createDataFrame([(i, None, i % 2) for i in range(200)] + [(3, None, None), (5, None, 0), (None, None, 1)], "doc_id long, quality int, toxic int")
    many = docs(spark, [(i, f"plain text {i} " + "bad " * (i % 2) * 5, "s") for i in range(200)] + [(3, "again", "s")])
    assert toxicity.scores(many, lab).count() == 201
    some = toxicity.labelled(many, lab, max_bytes=1000)
    assert 0 < some.agg(F.sum(F.octet_length("text"))).first()[0] <= 1000
    assert toxicity.labelled(many, lab, max_rows=10).count() <= 11


# --- mixing ---------------------------------------------------------------------


def _water(sizes, weights, cap=3):
    """Targets by repeated resharing."""
    total, target, capped = sum(sizes), [0.0] * len(sizes), set()
    while True:
        left = total - sum(cap * sizes[i] for i in capped)
        w = sum(weights[i] for i in range(len(sizes)) if i not in capped)
        target = [cap * sizes[i] if i in capped else left * weights[i] / w for i in range(len(sizes))]
        over = {i for i in range(len(sizes)) if i not in capped and target[i] > cap * sizes[i] + 1e-9}
        if not over:
            return target
        capped |= over


def test_mix_targets_and_budgets(spark):
    rng = random.Random(11)
    names = ["a", "b", "c", "d", "é", "Z", None]
    rows = [(i, " ".join(["w"] * max(0, int(rng.gauss(40, 25)))), s) for i, s in enumerate(rng.choices(names, [50, 1, 5, 20, 10, 2, 5], k=1500))]
    got = mixing.mix(docs(spark, rows)).collect()
    assert len(got) == len(rows)
    order = sorted((n for n in names if n is not None)) + [None]
    size = {n: sum(len(brute.words(t)) for _, t, s in rows if s == n) for n in order}
    want = dict(zip(order, _water([size[n] for n in order], [i % 3 + 1 for i in range(len(order))]), strict=True))
    for n in order:
        mine = [r for r in got if r.source == n]
        assert all(r.source_size == size[n] and abs(r.target - want[n]) < 1e-6 for r in mine)
        assert abs(sum(r.copies * r.size for r in mine) - want[n]) <= 1
        assert all(0 <= r.copies <= 3 for r in mine)
    again = mixing.mix(docs(spark, rows).repartition(7)).collect()
    assert sorted((r.doc_id, r.copies) for r in got) == sorted((r.doc_id, r.copies) for r in again)


def test_mix_edge_cases(spark):
    df = docs(spark, [(1, None, "a"), (2, "", "a"), (None, "x y z", "b"), (4, "x y z", "b"), (4, "x y z", "b")])
    got = mixing.mix(df).collect()
    assert len(got) == 5 and all(r.target == 0 for r in got if r.source == "a")
    assert sum(r.copies * r.size for r in got) == 9
    taken = mixing.take_mix(df)
    assert taken.columns == df.columns and taken.count() == 3
    assert mixing.mix(docs(spark, [])).count() == 0


def test_mix_edges(spark):
    df = docs(spark, [(None, "x y z", "b")] * 40 + [(i, "x y z w", "a") for i in range(9)])
    clash = df.withColumns({c: F.lit(1) for c in ("_key", "_all", "_size", "_copies", "_rank", "size", "copies", "bucket", "h")})
    taken = mixing.take_mix(clash)
    plan = mixing.mix(clash).groupBy("source").agg(F.sum("copies").alias("n")).collect()
    assert {r.source: r.n for r in plan} == {r.source: r["count"] for r in taken.groupBy("source").count().collect()}
    assert taken.columns == clash.columns and mixing.take_mix(clash.limit(0)).count() == 0
    buckets = mixing.mix(df).where("source = 'b'").groupBy("copies").count().collect()
    assert sum(r.copies * r["count"] for r in buckets) * 3 == 104 // 3 * 3 or len(buckets) <= 2


def test_fill_memory_is_one_array_and_one_long_text_does_not_size_it():
    import tracemalloc

    import pandas as pd

    tracemalloc.start()
    take = mixing.fill(list(range(2, 4000, 2)), [50] * 1999, 1_000_001)
    assert sum(x * t for x, t in zip(range(2, 4000, 2), take, strict=True)) == 1_000_000
    assert tracemalloc.get_traced_memory()[1] < 40e6
    rows = pd.DataFrame({"source": "s", "length": [3, 7, 50_000_000], "n": [900_000, 900_000, 3], "source_size": 900_000 * 10 + 150_000_000, "target": 57_000_001.0, "max_epochs": 3})
    got = mixing.plan_source(rows)
    assert abs((got.picks * got.length).sum() - 57_000_001) <= 1
    assert tracemalloc.get_traced_memory()[1] < 60e6
    tracemalloc.stop()


def test_fill_is_the_best_subset_sum():
    rng = random.Random(2)
    for _ in range(60):
        lengths = rng.sample(range(1, 30), 5)
        counts, budget = [rng.randrange(4) for _ in lengths], rng.randrange(80)
        reach = {0}
        for x, c in zip(lengths, counts, strict=True):
            reach = {r + x * k for r in reach for k in range(c + 1)}
        take = mixing.fill(lengths, counts, budget)
        assert all(t <= c for t, c in zip(take, counts, strict=True))
        assert sum(x * t for x, t in zip(lengths, take, strict=True)) == min(reach, key=lambda r: (abs(r - budget), r))


def test_sources_of_a_few_long_documents_land_on_the_nearest_sum():
    import itertools

    import pandas as pd

    rng = random.Random(4)
    cases = [([3_000_000], 2_999_188.0), ([3_000_000], 1_000.0), ([3_000_000], 8_999_188.0), ([2_000_000, 1_500_000], 1_900_000.0), ([5, 5], 9.0), ([7], 21.0)]
    cases += [([rng.randrange(1, 4_000_000) for _ in range(rng.randrange(1, 6))], None) for _ in range(30)]
    for sizes, target in cases:
        size = sum(sizes)
        target = float(rng.randrange(3 * size + 1)) if target is None else target
        counts = {x: sizes.count(x) for x in sizes}
        rows = pd.DataFrame({"source": "s", "length": list(counts), "n": list(counts.values()), "source_size": size, "target": target, "max_epochs": 3})
        got = mixing.plan_source(rows)
        taken = sum(x * (c * counts[x] + p) for x, c, p in zip(got.length, got.copies, got.picks, strict=True))
        # All ways to take each document as often as whole epochs say, or once more.
        whole = min(int(target // size), 3)
        sums = [whole * size + sum(s) for k in range(len(sizes) + 1) for s in itertools.combinations(sizes, k if whole < 3 else 0)]
        assert abs(taken - target) == min(abs(x - target) for x in sums), (sizes, target, taken)
        assert all(0 <= p <= counts[x] and c + (p > 0) <= 3 for x, c, p in zip(got.length, got.copies, got.picks, strict=True))


def test_remainders_beyond_the_program_come_as_near_as_one_document(monkeypatch):
    import pandas as pd

    monkeypatch.setattr(mixing, "ROOM", 100)
    rows = pd.DataFrame({"source": "s", "length": [1000, 3000], "n": [30, 30], "source_size": 120_000, "target": 59_700.0, "max_epochs": 3})
    got = mixing.plan_source(rows)
    assert abs((got.picks * got.length).sum() - 59_700) <= 500


# --- packing --------------------------------------------------------------------


def test_hilbert_curve_visits_every_cell_by_unit_steps():
    points = np.array([(x, y, z) for x in range(8) for y in range(8) for z in range(8)])
    keys = packing.hilbert(points, 3)
    assert sorted(keys.tolist()) == list(range(512))
    path = points[np.argsort(keys)]
    assert (np.abs(np.diff(path, axis=0)).sum(1) == 1).all()


def reference_ids(text):
    from tokenizers import Tokenizer

    if not hasattr(reference_ids, "t"):
        reference_ids.t = Tokenizer.from_file(packing.vocabulary())
    return np.array([*reference_ids.t.encode(text or "", add_special_tokens=False).ids, 1], dtype="<u4")


def check_pieces(rows, texts, copies=None):
    """Every id of every document in exactly one piece; sequences gapless and full."""
    by_doc, by_seq = {}, {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_seq.setdefault(r.sequence_id, []).append(r)
    assert set(by_doc) == set(texts)
    for i, pieces in by_doc.items():
        ids, n = reference_ids(texts[i]), (copies or {}).get(i, 1)
        assert sum(p.length for p in pieces) == n * len(ids)
        covered = np.zeros(len(ids), dtype=int)
        for p in pieces:
            assert p.doc_tokens == len(ids) and zlib.crc32(ids[p.start : p.start + p.length].tobytes()) == p.ids_crc32
            covered[p.start : p.start + p.length] += 1
        assert (covered == n).all()
    padding = total = 0
    for pieces in by_seq.values():
        at = 0
        for p in sorted(pieces, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert 0 < at <= 2048
        total += at
        padding += 0 if at & (at - 1) == 0 else 2048 - at
    assert padding <= 0.01 * total + 2048


def test_packing_covers_every_token(spark):
    df = spark.read.parquet(f"{SF}/documents.parquet").limit(120)
    texts = {r.doc_id: r.text for r in df.collect()}
    texts |= {-1: None, -2: "", -3: "<|endoftext|> Ünïcödé 漢字 \u0000 \t", -4: "long " * 9000}
    extra = docs(spark, [(i, texts[i], "s") for i in (-1, -2, -3, -4)])
    check_pieces(packing.pack(df.unionByName(extra, allowMissingColumns=True).withColumn("ids", F.lit("clash"))).collect(), texts)
    assert packing.pack(docs(spark, [])).count() == 0


def test_encoder_gives_the_tokenizers_own_ids():
    rng = random.Random(1)
    alphabet = [*"ab 1.'\n\t \u00e9\u6f22\u3000\u00a0\u001c\u0085\u200b\u180e\ufeff\u2019s\U0001f600", "<|endoftext|>", " <|endoftext|>", "'re", "  ", "ing", " the"]
    odd = ["".join(rng.choice(alphabet) for _ in range(rng.randrange(40))) for _ in range(5000)]
    long = [" " * 2_000_000, "\n" * 2_000_000, "x" * 10_000_000, "hello <|endoftext|> x", "a\n\n\n b" * 50_000]
    encode = packing.encoder(packing.vocabulary(), np.uint32)
    for texts in (odd, odd[::-1], long):
        for text, raw in zip(texts, encode(texts), strict=True):
            assert np.array_equal(np.frombuffer(raw, "<u4"), reference_ids(text)[:-1]), text[:80]
    assert np.frombuffer(encode(["hello <|endoftext|> x"])[0], "<u4").tolist() == [31373, 220, 50256, 2124]
    plain = packing.encoder(packing.vocabulary(), np.uint32, special_as_text=True)
    assert 50256 not in np.frombuffer(plain(["<|endoftext|>"])[0], "<u4")


def test_neighbours_on_the_curve_are_alike():
    rng = random.Random(4)
    topics = [[f"t{k}w{i}" for i in range(40)] for k in range(30)]
    texts = [(k, " ".join(rng.choice(topics[k]) for _ in range(200))) for k in range(30) for _ in range(10)]
    rng.shuffle(texts)
    keys = packing.curve_keys(pa.array([t for _, t in texts]))
    along = [texts[i][0] for i in np.argsort(keys, kind="stable")]
    assert np.mean([a == b for a, b in zip(along, along[1:], strict=False)]) > 0.3  # 1 in 30 by chance


def test_ranges_are_of_equal_bytes_and_grow_with_the_input(spark, monkeypatch):
    keys = spark.range(20_000).select(F.expr("xxhash64(id) & 4611686018427387903").alias("key"), F.expr("if(id % 100 = 0, 5000L, 50L)").alias("bytes"))
    cuts = packing._ranges(keys, 8)
    held = keys.withColumn("part", F.size(F.filter(F.array(*[F.lit(c) for c in cuts]), lambda c: c <= F.col("key")))).groupBy("part").agg(F.sum("bytes").alias("b")).collect()
    assert len(held) == 8 and max(r.b for r in held) < 1.3 * min(r.b for r in held)
    monkeypatch.setattr(packing, "RANGE_BYTES", 100_000)
    assert len(packing._ranges(keys, None)) == -(-(200 * 5000 + 19_800 * 50) // 100_000) - 1
    assert packing._ranges(keys.limit(0), None) == []


def test_packing_repeats_and_one_part(spark):
    rows = packing.pack(docs(spark, [(1, "a b c", "s")] * 3 + [(None, "x", "s")]), parts=1).collect()
    check_pieces(rows, {1: "a b c", None: "x"}, {1: 3})
    assert [p for n in range(1, 2048) for p in [packing._tail(n, 2048)] if sum(p) != n] == []


def test_take_mix_emits_every_planned_copy_of_repeated_rows(spark):
    rows = [(None, " ".join(f"{x}{i}" for x in "abcde"), "s") for i in range(10)] + [(1, "a b c", "s"), (1, "d e f", "s"), (2, "a b", None), (2, "a b", None), (3, "x " * 9, "t")]
    df = docs(spark, rows)
    plan, got = {}, {}
    for r in mixing.mix(df).collect():
        plan[r.doc_id, r.source, r.size] = plan.get((r.doc_id, r.source, r.size), 0) + r.copies
    for r in mixing.take_mix(df).collect():
        k = (r.doc_id, r.source, len(r.text.split()))
        got[k] = got.get(k, 0) + 1
    assert got == {k: n for k, n in plan.items() if n} and any(0 < n % 10 for k, n in plan.items() if k[0] is None)


# --- pipeline -------------------------------------------------------------------


def test_pipeline_stages_on_their_own_input(spark):
    import corpus_pipeline as cp
    from wattline.llm import quality

    source = spark.read.parquet(f"{SF}/documents.parquet")
    at = {}
    now = source
    for name, stage in cp.STAGES:
        now = cp.settle(stage(spark, now, SF))
        at[name] = now
    rows = {n: d.collect() for n, d in at.items()}
    assert all(at[n].columns == source.columns for n, _ in cp.STAGES[:-1])
    judged = {r.doc_id for r in quality.judge(quality.ledger(source)).where("kept").collect()}
    assert {r.doc_id for r in rows["quality rules"]} == judged
    first = {}
    for r in sorted(rows["quality rules"], key=lambda r: r.doc_id):
        first.setdefault(r.text, r.doc_id)
    assert {r.doc_id for r in rows["exact dedup"]} == set(first.values())
    kept = brute.components([(r.doc_id, r.text) for r in rows["exact dedup"]], 5, 80, 100)
    assert {r.doc_id for r in rows["near dedup"]} == {i for i, (_, c) in kept.items() if c == i}
    plan = {r.doc_id: r.copies for r in mixing.mix(at["near dedup"]).collect()}
    copies = {}
    for r in rows["mix sources"]:
        copies[r.doc_id] = copies.get(r.doc_id, 0) + 1
    assert copies == {i: n for i, n in plan.items() if n}
    check_pieces(rows["pack sequences"], {r.doc_id: r.text for r in rows["mix sources"]}, copies)
    assert cp.ORACLE_SQL is None and set(queries.oracle_sql()) <= set(queries.queries())
