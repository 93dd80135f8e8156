"""Toxicity by class-conditional Kneser-Ney models of expressions.

Two character models, one for toxic and one for ordinary words, share their
backoff: at the longest context each class discounts its own counts and gives the
freed mass to one interpolated Kneser-Ney model over the counts of *all* documents.
Where a class has seen a context rarely or never, the two models agree, so rare but
harmless words carry no evidence, while a rare form of a toxic root does.

1. *Class counts* of the words of labelled documents (bounded, see below).
2. *Shared counts.*  The distinct words of the whole corpus, with their counts, by
   a distributed aggregate; from them the counts and continuation counts of all
   grams that follow a context the class counts know.
3. *Scores.*  The log-likelihood difference of each word is divided by its length
   in characters.  Three spans give the features: the highest word, the highest mean
   of five words, and the mean of the text.  The two maxima rise with the number of
   words by chance alone, so its logarithm is the fourth.  A logistic fit on labelled
   documents that the models have not seen puts them on a scale of 0 to 1.

What is bounded: ``max_rows`` labelled ids, and ``max_bytes`` of their texts, taken
in the order of a hash of their ids, are learnt from (documented bounds, 16,000 and
32 MB by default); so the class counts, the models (a few MB, broadcast) and the
calibration rows are bounded too.  Everything else - shared counts, every document,
every word - covers all texts; scoring is one pass with no shuffle.

Defined results
* Null or empty text: four zero features, hence the score of no evidence.
* Null ids: held_out is false; they are never labelled.
* Conflicting labels of an id: toxic if any says so.  Null labels are ignored.
* No toxic or no ordinary label to learn from: every score is the smoothed share.
* Repeated rows get equal rows.  Empty tables: no rows, or no evidence without labels.
  Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wattline.llm import kernels
from wattline.llm.text import settle, small_batches

MAX_ROWS = 16_000
MAX_BYTES = 32 << 20
FEATURES = 4
ORDER = 6
#: Lengths of the shorter contexts, each the backoff of the one before.
LENGTHS = (3, 1, 0)
DISCOUNT = 2.0
SHARED_DISCOUNT = 0.75
SPAN = 5
THRESHOLD = 0.3
#: Distinct words whose letters are in memory at once (some 300 bytes a letter).
WORDS = 20_000
FOLD, HELD_OUT = 4, 2
BEGIN, END = 0x01, 0x02


@dataclass
class Model:
    """Log ratios toxic / ordinary of known grams and of gaps after known contexts."""

    grams: np.ndarray
    gram_ratio: np.ndarray
    contexts: np.ndarray
    context_ratio: np.ndarray


def _frame(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The words between BEGIN and END marks: (bytes, place in word, word number)."""
    sizes = ends - starts + 2
    total, first = int(sizes.sum()), np.cumsum(sizes) - sizes
    word = np.repeat(np.arange(len(sizes)), sizes)
    place = np.arange(total) - first[word]
    out = kernels.lowered(data[np.clip(starts[word] + place - 1, 0, max(0, len(data) - 1))])
    out[place == 0] = BEGIN
    out[place == sizes[word] - 1] = END
    return out, place, word


class _Windows:
    """Hashes of the bytes before each place, up to any context length."""

    def __init__(self, data: np.ndarray, place: np.ndarray):
        self.at = np.flatnonzero(place)
        self.context = np.minimum(place[self.at], ORDER - 1)
        up, self.down = kernels.power_tables(len(data) + 1)
        self.sums = kernels.byte_sums(data, up)

    def hashes(self, rows: np.ndarray, dropped: int) -> tuple[np.ndarray, np.ndarray]:
        """(gram, context) of ``rows`` with the first ``dropped`` bytes left out."""
        at = self.at[rows]
        start = at - self.context[rows] + dropped
        size = (self.context[rows] - dropped).astype(np.uint64)
        gram = kernels.mix((self.sums[at + 1] - self.sums[start]) * self.down[start] + size)
        context = kernels.mix((self.sums[at] - self.sums[start]) * self.down[start] + size)
        return gram, context


def gram_rows(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, counts: np.ndarray, wanted: np.ndarray | None = None) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """For each level: (level, unit, gram, context, weight) of distinct words.

    Level 0 has the longest contexts; its units are the grams themselves, weighing their
    words' counts.  The others have contexts of LENGTHS letters; their units are the
    distinct grams of one letter more, so that their number is the continuation count.
    ``wanted`` (sorted) limits the contexts.
    """
    framed, place, word = _frame(data, starts, ends)
    windows = _Windows(framed, place)
    for level, length in enumerate((None, *LENGTHS)):
        rows = np.arange(len(windows.at)) if length is None else np.flatnonzero(windows.context > length)
        dropped = 0 if length is None else windows.context[rows] - length
        gram, context = windows.hashes(rows, dropped)
        unit = gram if level == 0 else windows.hashes(rows, dropped - 1)[0]
        known = np.ones(len(rows), dtype=bool) if wanted is None else _is_in(context, wanted)
        unit, first, inverse = np.unique(unit[known], return_index=True, return_inverse=True)
        weight = np.bincount(inverse, weights=counts[word[windows.at[rows[known]]]], minlength=len(unit)) if level == 0 else np.ones(len(unit))
        yield level, unit, gram[known][first], context[known][first], weight.astype(np.int64)


def _is_in(values: np.ndarray, sorted_values: np.ndarray) -> np.ndarray:
    if not len(sorted_values):
        return np.zeros(len(values), dtype=bool)
    return sorted_values[np.minimum(np.searchsorted(sorted_values, values), len(sorted_values) - 1)] == values


@dataclass
class Shared:
    """Counts over all documents, sorted by hash: of grams, and by context."""

    grams: np.ndarray
    gram_counts: np.ndarray
    contexts: np.ndarray
    totals: np.ndarray
    kinds: np.ndarray

    def gram(self, keys: np.ndarray) -> np.ndarray:
        return self.gram_counts[np.searchsorted(self.grams, keys)]

    def context(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.searchsorted(self.contexts, keys)
        return self.totals[at], self.kinds[at]


def _class_grams(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, toxic: np.ndarray, ordinary: np.ndarray, shared: Shared) -> tuple[np.ndarray, ...]:
    """(gram, context, toxic, ordinary, backoff) of the distinct longest grams of some words."""
    framed, place, word = _frame(data, starts, ends)
    windows = _Windows(framed, place)
    gram, context = windows.hashes(np.arange(len(windows.at)), 0)
    _, rows, inverse = np.unique(gram, return_index=True, return_inverse=True)
    owner = word[windows.at]
    by_class = [np.bincount(inverse, weights=n[owner], minlength=len(rows)) for n in (toxic, ordinary)]

    backoff = np.full(len(rows), 1 / 256)
    for length in (*reversed(LENGTHS), None):
        mine = np.ones(len(rows), dtype=bool) if length is None else windows.context[rows] > length
        lower, before = windows.hashes(rows[mine], 0 if length is None else windows.context[rows[mine]] - length)
        total, kinds = shared.context(before)
        backoff[mine] = (np.maximum(shared.gram(lower) - SHARED_DISCOUNT, 0) + SHARED_DISCOUNT * kinds * backoff[mine]) / total
    return gram[rows], context[rows], *by_class, backoff


def train(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, toxic: np.ndarray, ordinary: np.ndarray, shared: Shared) -> Model:
    """Model from distinct words with their counts by class, and the shared counts."""
    cuts = [slice(a, a + WORDS) for a in range(0, len(starts), WORDS)]
    parts = [_class_grams(data, starts[c], ends[c], toxic[c], ordinary[c], shared) for c in cuts]
    gram, context, *by_class, backoff = (np.concatenate(x) for x in zip(*parts, strict=True))
    del parts
    # Counts of one gram add up; its backoff depends on its letters alone.
    gram, rows, inverse = np.unique(gram, return_index=True, return_inverse=True)
    by_class = [np.bincount(inverse, weights=n, minlength=len(rows)) for n in by_class]
    context, backoff = context[rows], backoff[rows]

    _, first, inverse = np.unique(context, return_index=True, return_inverse=True)
    total = [np.bincount(inverse, weights=n)[inverse] for n in by_class]
    freed = [np.bincount(inverse, weights=np.minimum(n, DISCOUNT))[inverse] for n in by_class]
    held = [np.maximum(n - DISCOUNT, 0) / np.maximum(t, 1) for n, t in zip(by_class, total, strict=True)]
    gap = [np.where(t > 0, f / np.maximum(t, 1), 1.0) for f, t in zip(freed, total, strict=True)]
    ratio = np.log((held[0] + gap[0] * backoff) / (held[1] + gap[1] * backoff))
    return Model(gram, ratio.astype(np.float32), context[first], np.log(gap[0] / gap[1])[first].astype(np.float32))


def _look_up(keys: np.ndarray, values: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    at = np.minimum(np.searchsorted(keys, wanted), max(0, len(keys) - 1))
    hit = keys[at] == wanted if len(keys) else np.zeros(len(wanted), dtype=bool)
    return hit, np.where(hit, values[at], 0) if len(keys) else np.zeros(len(wanted), np.float32)


def word_ratios(model: Model, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Log-likelihood difference of each word."""
    out = np.zeros(len(starts))
    sizes, a = np.cumsum(ends - starts + 2), 0
    while a < len(starts):
        b = max(a + 1, int(np.searchsorted(sizes, (sizes[a - 1] if a else 0) + kernels.BLOCK)))
        framed, place, word = _frame(data, starts[a:b], ends[a:b])
        windows = _Windows(framed, place)
        gram, context = windows.hashes(np.arange(len(windows.at)), 0)
        after, gap = _look_up(model.contexts, model.context_ratio, context)
        seen, value = np.zeros(len(gram), dtype=bool), np.zeros(len(gram))
        seen[after], value[after] = _look_up(model.grams, model.gram_ratio, gram[after])
        out[a:b] = np.bincount(word[windows.at], weights=np.where(seen, value, gap), minlength=b - a)
        a = b
    return out


def features(model: Model, texts: pa.Array) -> np.ndarray:
    """Per text: highest word, highest mean of SPAN words, mean of all words (each word's
    log-likelihood difference over its length), logarithm of the number of words."""
    data, offsets = kernels.buffers(texts)
    spans = list(kernels.word_spans(data, offsets))
    out = np.zeros((len(texts), FEATURES))
    if not spans:
        return out
    starts, ends, hashes = (np.concatenate(x) for x in zip(*spans, strict=True))
    _, first, inverse = np.unique(hashes, return_index=True, return_inverse=True)
    value = (word_ratios(model, data, starts[first], ends[first]) / (ends[first] - starts[first] + 1))[inverse]
    text = np.searchsorted(offsets, starts, "right") - 1
    counts = np.bincount(text, minlength=len(texts))
    full = np.flatnonzero(counts)
    begin = (np.cumsum(counts) - counts)[full]
    out[full, 0] = np.maximum.reduceat(value, begin)
    sums = np.concatenate(([0.0], np.cumsum(value)))
    stop = np.repeat(begin + counts[full], counts[full])
    last = np.minimum(np.arange(len(value)) + SPAN, stop)
    size = np.minimum(np.repeat(counts[full], counts[full]), SPAN)
    out[full, 1] = np.maximum.reduceat((sums[last] - sums[last - size]) / size, begin)
    out[full, 2] = np.add.reduceat(value, begin) / counts[full]
    out[full, 3] = np.log(counts[full])
    return out


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """text, toxic -> distinct words of a batch with their counts by class."""
    for batch in kernels.slices(batches, 5000):
        data, offsets = kernels.buffers(batch.column(0))
        toxic = batch.column(1).to_numpy(zero_copy_only=False)
        for starts, ends, hashes in kernels.word_spans(data, offsets):
            _, first, inverse = np.unique(hashes, return_index=True, return_inverse=True)
            bad = toxic[np.searchsorted(offsets, starts, "right") - 1] == 1
            t = np.bincount(inverse[bad], minlength=len(first))
            o = np.bincount(inverse[~bad], minlength=len(first))
            said = [kernels.lowered(data[a:b]).tobytes() for a, b in zip(starts[first], ends[first], strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(said, pa.binary()), pa.array(t, pa.int64()), pa.array(o, pa.int64())], ["word", "t", "o"])


def _words_of(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bytes, starts, ends) of a binary column ``word``."""
    words = table.column("word").combine_chunks().cast(pa.large_binary())
    words = words.chunk(0) if isinstance(words, pa.ChunkedArray) else words
    offsets = np.frombuffer(words.buffers()[1], dtype=np.int64)[words.offset : words.offset + len(words) + 1]
    raw = words.buffers()[2]
    return np.frombuffer(raw, dtype=np.uint8) if raw is not None else np.zeros(0, np.uint8), offsets[:-1], offsets[1:]


def _vocabulary(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """text -> distinct words of a batch with their counts."""
    for batch in kernels.slices(batches, 5000):
        data, offsets = kernels.buffers(batch.column(0))
        for starts, ends, hashes in kernels.word_spans(data, offsets):
            _, first, counts = np.unique(hashes, return_index=True, return_counts=True)
            at, end = int(starts[0]) if len(starts) else 0, int(ends[-1]) if len(ends) else 0
            low = kernels.lowered(data[at:end]).tobytes()
            said = [low[a - at : b - at] for a, b in zip(starts[first].tolist(), ends[first].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(said, pa.binary()), pa.array(counts.astype(np.int64))], ["word", "n"])


def _needs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Class words -> the hashes of their grams and contexts, once a slice of words."""
    for batch in kernels.slices(batches, WORDS):
        table = pa.Table.from_batches([batch])
        said, count = _words_of(table), np.ones(table.num_rows)
        for _, _, gram, context, _ in gram_rows(*said, count):
            for is_gram, found in ((True, np.unique(gram)), (False, np.unique(context))):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(found), is_gram)), pa.array(kernels.as_long(found))], ["is_gram", "hash"])


def _shared_counts(words: DataFrame, needs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(gram, n) of the wanted grams and (context, total, kinds) of the wanted contexts over
    the corpus words (word, n).

    Units are counted by gram and grams by context in distributed aggregates.  Broadcast
    are the contexts of the bounded class words.
    """
    contexts = needs.where("not is_gram").select("hash").toArrow().column("hash").to_numpy().view(np.uint64)
    wanted = words.sparkSession.sparkContext.broadcast(np.sort(contexts))

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in (batch.slice(a, 50_000) for a in range(0, batch.num_rows, 50_000)):
                table = pa.Table.from_batches([part])
                for level, unit, gram, context, weight in gram_rows(*_words_of(table), table.column("n").to_numpy(), wanted.value):
                    # Above the longest context a gram's units are counted, else their words.
                    of = pa.array(kernels.as_long(unit), mask=np.full(len(unit), level == 0))
                    yield pa.RecordBatch.from_arrays([of, *(pa.array(kernels.as_long(x)) for x in (gram, context)), pa.array(weight)], ["unit", "gram", "context", "weight"])

    units = words.mapInArrow(spread, "unit long, gram long, context long, weight long")
    # A unit counts once, however many tasks have seen it.
    units = units.groupBy("unit", "gram", "context").agg(F.sum("weight").alias("weight"))
    count = F.sum(F.when(F.col("unit").isNull(), F.col("weight")).otherwise(F.lit(1).cast("long")))
    grams = settle(units.groupBy("gram", "context").agg(count.alias("n")))
    totals = grams.groupBy("context").agg(F.sum("n").alias("total"), F.count(F.lit(1)).alias("kinds"))
    return grams.select("gram", "n").join(needs.where("is_gram").select(F.col("hash").alias("gram")), "gram", "left_semi"), totals


def _train_on(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Class words, wanted grams and contexts of the bounded sample, in one task -> one model."""
    parts: dict[int, list] = {0: [], 1: [], 2: []}
    for batch in batches:
        kinds = batch.column(0).to_numpy()
        for kind in np.unique(kinds).tolist():
            rows = batch.filter(pa.array(kinds == kind))
            parts[kind].append((rows.select(["word"]) if kind == 0 else None, *(rows.column(i).to_numpy() for i in (2, 3, 4))))
    if not parts[0]:
        return

    def column(kind: int, i: int) -> np.ndarray:
        return np.concatenate([row[i] for row in parts[kind]])

    gram, context = column(1, 1).view(np.uint64), column(2, 1).view(np.uint64)
    g, c = np.argsort(gram), np.argsort(context)
    shared = Shared(gram[g], column(1, 2)[g], context[c], column(2, 2)[c], column(2, 3)[c])
    said = pa.Table.from_batches([row[0] for row in parts[0]])
    toxic, ordinary = column(0, 2), column(0, 3)
    del parts
    model = train(*_words_of(said), toxic, ordinary, shared)
    made = [model.grams, model.gram_ratio, model.contexts, model.context_ratio]
    yield pa.RecordBatch.from_arrays([pa.array([x.tobytes()], pa.binary()) for x in made], ["g", "gr", "c", "cr"])


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, steps: int = 50) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(weights with the intercept last, mean, scale) by Newton's method."""
    mean, scale = x.mean(0), np.maximum(x.std(0), 1e-9)
    z = np.column_stack([(x - mean) / scale, np.ones(len(x))])
    w = np.zeros(z.shape[1])
    pull = np.full(len(w), ridge)
    pull[-1] = 1e-6
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + np.diag(pull), z.T @ (y - p) - pull * w)
        w += step
        if np.abs(step).max() < 1e-9:
            break
    return w, mean, scale


def _remainder(ids: Column) -> Column:
    return F.crc32(ids.cast("string").cast("binary")) % FOLD


def fit_model(texts: DataFrame, learnt: DataFrame) -> Model:
    """The model from all ``texts`` and the bounded labelled rows ``learnt`` (text, toxic).

    The one-task step sees what the bounded sample holds, whatever the corpus, and its
    words in slices.
    """
    words = learnt.select("text", "toxic").mapInArrow(_count_words, "word binary, t long, o long")
    words = settle(words.groupBy("word").agg(F.sum("t").alias("t"), F.sum("o").alias("o")))
    needs = settle(words.mapInArrow(_needs, "is_gram boolean, hash long").distinct())
    corpus = texts.select("text").mapInArrow(_vocabulary, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))
    grams, totals = _shared_counts(corpus, needs)
    none = F.lit(0).cast("long")
    rows = words.select(F.lit(0).alias("kind"), "word", none.alias("a"), F.col("t").alias("b"), F.col("o").alias("c"))
    rows = rows.union(grams.select(F.lit(1), F.lit(None).cast("binary"), "gram", "n", none))
    rows = rows.union(totals.select(F.lit(2), F.lit(None).cast("binary"), "context", "total", "kinds"))
    made = settle(rows).coalesce(1).mapInArrow(_train_on, "g binary, gr binary, c binary, cr binary").collect()
    kinds = (np.uint64, np.float32, np.uint64, np.float32)
    return Model(*(np.frombuffer(b, k) for b, k in zip(made[0], kinds, strict=True))) if made else Model(*(np.zeros(0, k) for k in kinds))


def labelled(texts: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS, max_bytes: int = MAX_BYTES) -> DataFrame:
    """(text, toxic, role): the labelled rows to learn from; role 0 calibrates."""
    usable = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & (_remainder(F.col("doc_id")) != HELD_OUT))
    by_hash = F.xxhash64(F.lit("toxicity"), F.col("doc_id"))
    sample = usable.groupBy("doc_id").agg(F.max("toxic").alias("toxic")).orderBy(by_hash, "doc_id").limit(max_rows)
    # At most max_rows ids, so the broadcast is bounded; a third of them calibrates.
    role = F.pmod(F.xxhash64(F.lit("calibrate"), F.col("doc_id")), F.lit(3))
    held = texts.join(F.broadcast(sample), "doc_id").select("text", F.col("toxic").cast("int").alias("toxic"), role.alias("role"), by_hash.alias("h"))
    held = settle(held)
    size = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long")
    by_id = held.groupBy("h").agg(F.sum(size).alias("bytes"))
    over = by_id.select("h", F.sum("bytes").over(Window.orderBy("h")).alias("sum")).where(F.col("sum") > max_bytes).agg(F.min("h")).first()[0]
    return (held if over is None else held.where(F.col("h") < over)).drop("h")


def scores(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS, threshold: float = THRESHOLD, max_bytes: int = MAX_BYTES) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted."""
    spark = docs.sparkSession
    small_batches(spark)
    texts = docs.select("doc_id", "text")
    kind = texts.schema["doc_id"].dataType.simpleString()
    learnt = labelled(texts, labels, max_rows, max_bytes)
    shared = spark.sparkContext.broadcast(fit_model(texts, learnt.where("role > 0")))

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in kernels.slices(batches, 5000):
            found = features(shared.value, batch.column(0))
            yield pa.RecordBatch.from_arrays([batch.column(1), *(pa.array(found[:, i]) for i in range(FEATURES))], ["toxic", *"abcd"])

    seen = learnt.where("role = 0").select("text", "toxic").mapInArrow(measure, "toxic int, a double, b double, c double, d double").collect()
    y = np.array([r["toxic"] for r in seen], dtype=float)
    x = np.array([[r[c] for c in "abcd"] for r in seen], dtype=float).reshape(-1, FEATURES)
    if 0 < y.sum() < len(y):
        order = np.lexsort((*x.T, y))
        fit = logistic(x[order], y[order])
    else:
        share = (y.sum() + 0.5) / (len(y) + 1)
        fit = (np.array([*np.zeros(FEATURES), np.log(share / (1 - share))]), np.zeros(FEATURES), np.ones(FEATURES))

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w, mean, scale = fit
        for batch in kernels.slices(batches, 5000):
            z = (features(shared.value, batch.column(1)) - mean) / scale @ w[:-1] + w[-1]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(1 / (1 + np.exp(-np.clip(z, -40, 40))))], ["doc_id", "score"])

    scored = texts.mapInArrow(judge, f"doc_id {kind}, score double")
    return scored.select(
        "doc_id",
        F.coalesce(_remainder(F.col("doc_id")) == HELD_OUT, F.lit(False)).alias("held_out"),
        "score",
        (F.col("score") >= threshold).cast("int").alias("predicted"),
    )
