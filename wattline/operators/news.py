"""News: cleaning, relevance, near-duplicate filter, sentiment and daily indices."""

from __future__ import annotations

import functools
import itertools
import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from wattline.functions.tables import settle
from wattline.functions.ts import Series

#: A small local lexicon; stands in for a classifier's weights, which are not here.
POSITIVE = ("gain", "rise", "strong", "growth", "surge", "record", "improve", "bullish")
NEGATIVE = ("loss", "fall", "weak", "decline", "drop", "risk", "shortage", "bearish")


#: Words that titles are not compared by; callers may pass their own.
STOP_WORDS = tuple(
    "a about above after again against all also am an and any are as at be because been before being below between both but by can could did do "
    "does doing down during each few for from further had has have having he her here hers him his how i if in into is it its itself just me "
    "more most my no nor not now of off on once only or other our out over own same she should so some such than that the their them then "
    "there these they this those through to too under until up us very was we were what when where which while who whom why will with would "
    "you your".split()
)
#: White space and word characters by class, so that every engine reads them alike.
BLANKS = r"[\s\p{Z}\x0B\x1C-\x1F\x{85}]+"
NO_WORD = r"[^\p{L}\p{N}_]+"


def clean_text(text: Column) -> Column:
    """Tags out, white space collapsed, then unusual characters out."""
    t = F.regexp_replace(F.coalesce(text, F.lit("")), r"<[^>]+>", " ")
    t = F.trim(F.regexp_replace(t, BLANKS, " "))
    return F.regexp_replace(t, r"[^\p{L}\p{N}_ .,!?;:'\"()%$-]", "")


def relevant(text: Column, keywords: list[str]) -> Column:
    """True if any keyword is a substring, whatever the case."""
    low = F.lower(text)
    found = F.lit(False)
    for k in keywords:
        found = found | F.contains(low, F.lit(k.lower()))
    return found


def exact_titles(df: DataFrame) -> DataFrame:
    """The earliest article of each title."""
    w = Window.partitionBy(F.lower(F.trim("title"))).orderBy("date", "article_id")
    return df.withColumn("_i", F.row_number().over(w)).where("_i = 1").drop("_i")


def tf_idf(df: DataFrame, text: str = "title", limit: int = 5000, stop: tuple[str, ...] = STOP_WORDS) -> DataFrame:
    """article_id, term, tf, df, weight: tf * (ln((1 + n) / (1 + df)) + 1), length 1.

    Terms are words of two characters or more that are not in ``stop``; the ``limit``
    most frequent ones count, which bounds what is broadcast.  A text without such a
    term has no rows.
    """
    term = F.explode(F.filter(F.split(F.lower(F.col(text)), NO_WORD), lambda t: F.length(t) >= 2)).alias("term")
    words = df.select("article_id", term).where(~F.col("term").isin(*stop)) if stop else df.select("article_id", term)
    tf = words.groupBy("article_id", "term").agg(F.count(F.lit(1)).alias("tf"))
    totals = tf.groupBy("term").agg(F.sum("tf").alias("total"), F.count(F.lit(1)).alias("df"))
    known = totals.orderBy(F.col("total").desc(), "term").limit(limit).select("term", "df")
    n = df.agg(F.count(F.lit(1)).alias("n"))
    raw = tf.join(F.broadcast(known), "term").join(F.broadcast(n)).withColumn("w", F.col("tf") * (F.ln((1 + F.col("n")) / (1 + F.col("df"))) + 1))
    norm = raw.groupBy("article_id").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    return raw.join(norm, "article_id").select("article_id", "term", "tf", "df", (F.col("w") / F.col("norm")).alias("weight"))


def same_bags(v: DataFrame) -> DataFrame:
    """article_id, first: the smallest id with the same terms as often.  Of many articles
    with one bag of terms only the first meets others, so none are paired up."""
    text = F.array_join(F.array_sort(F.collect_list(F.concat_ws(":", "term", "tf"))), " ")
    bags = v.groupBy("article_id").agg(F.sha2(text, 256).alias("bag"))
    return bags.join(bags.groupBy("bag").agg(F.min("article_id").alias("first")), "bag").select("article_id", "first")


#: Members of a cell up to which all of them meet.
SMALL_CELL = 64
#: Members of one side of a block of a large cell.
BLOCK = 1000


def vectors(every: DataFrame) -> DataFrame:
    """article_id, rank, weight, mass: terms by rarity (1 is the rarest) in place of their
    names, and the squared length of an article's terms from each one to the most common."""
    # At most as many terms as the limit of ``tf_idf``.
    ranks = every.select("term", "df").distinct().select("term", F.row_number().over(Window.orderBy("df", "term")).alias("rank"))
    upto = Window.partitionBy("article_id").orderBy(F.desc("rank")).rowsBetween(Window.unboundedPreceding, 0)
    v = every.join(F.broadcast(ranks), "term").select("article_id", "rank", "weight")
    return v.withColumn("mass", F.sum(F.col("weight") * F.col("weight")).over(upto))


def meeting_cells(v: DataFrame, threshold: float, small: int | None = None) -> DataFrame:
    """(cell, article_id, n): cells of n articles whose members meet, so that all pairs of
    (article_id, rank, weight, mass) that could reach the threshold meet somewhere.

    The terms that two articles share, from the rarest on, are a path, and a cell is the
    articles that share the start of one.  What those terms can give an article x with
    any other member is at most b = sum of its weights times the cell's largest ones.
    x is in the cells that its path leads to by a term from which on its terms are as long as
    threshold - b at least: where two articles first share a shorter rest, they cannot reach
    the threshold.  Members of small cells all meet; large cells are cut by the next term.
    Articles of a large cell that may reach the threshold by the path alone (b >= threshold)
    meet each other at once: such pairs share nearly all of their weight.  A cell is cut
    only if that at least halves the pairs that would meet, so groups of titles that are
    alike, whose pairs are the result, are not cut into all the paths that they share.

    Cells are known by a hash of their path; if two paths met in it, articles would meet
    that need not, no pair would be lost.
    """
    limit = small or SMALL_CELL
    start = v.where(F.sqrt("mass") >= threshold - 1e-9)
    cells = start.select(F.col("rank").cast("long").alias("cell"), F.col("rank").alias("last"), "article_id", F.lit(0.0).alias("b"), "weight")
    met = None
    while True:
        stats = cells.groupBy("cell").agg(F.max("weight").alias("most"), F.count(F.lit(1)).alias("n")).where("n > 1")
        bound = F.col("b") + F.col("weight") * F.col("most")
        sized = settle(cells.join(stats, "cell").select("cell", "last", "article_id", bound.alias("b"), "n"))
        further = sized.where(F.col("n") > limit).join(v, "article_id").where((F.col("rank") > F.col("last")) & (F.sqrt("mass") >= threshold - F.col("b") - 1e-9))
        taken = settle(further.select("cell", "rank", "article_id", "b", "weight", "n"))
        sure = F.col("b") >= threshold - 1e-9
        parts = taken.groupBy("cell", "rank").agg(F.count(F.lit(1)).alias("m")).groupBy("cell").agg(F.sum(F.col("m") * F.col("m")).alias("after"))
        known = sized.where(F.col("n") > limit).groupBy("cell").agg(F.max("n").alias("n"), F.count_if(sure).alias("s")).join(parts, "cell", "left")
        cut = settle(known.where(2 * (F.coalesce("after", F.lit(0)) + F.col("s") * F.col("s")) <= F.col("n") * F.col("n")).select("cell", F.lit(True).alias("cut")))
        meet = sized.join(cut, "cell", "left").where(F.col("cut").isNull() | sure).select("cell", "article_id", "n")
        met = meet if met is None else met.union(meet)
        cells = taken.join(cut, "cell").select(F.xxhash64("cell", "rank").alias("cell"), F.col("rank").alias("last"), "article_id", "b", "weight")
        if cells.isEmpty():
            return met


def _cell_pairs(ids: list[int], side: np.ndarray, ranks: list, weights: list, threshold: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(a, b, cosine) of the pairs of a cell's block; with two sides, of those across."""
    terms, at = np.unique(np.concatenate(ranks), return_inverse=True)
    dense = np.zeros((len(ids), len(terms)))
    dense[np.repeat(np.arange(len(ids)), [len(r) for r in ranks]), at] = np.concatenate(weights)
    cosine = dense @ dense.T
    fine = np.triu(cosine >= threshold, 1)
    if side.any() and not side.all():
        fine &= side[:, None] != side[None]
    i, j = np.nonzero(fine)
    ids = np.array(ids)
    return np.minimum(ids[i], ids[j]), np.maximum(ids[i], ids[j]), cosine[i, j]


def meet(cells: DataFrame, v: DataFrame, threshold: float) -> DataFrame:
    """a < b, cosine of the pairs that meet in a cell and reach the threshold, each once.

    What moves are members with their terms, not pairs.  Cells of more than ``BLOCK`` members
    are cut into blocks by a hash, and each two blocks of a cell meet on their own.
    """
    terms = v.groupBy("article_id").agg(F.sort_array(F.collect_list(F.struct("rank", "weight"))).alias("t"))
    whole = terms.select("article_id", F.col("t.rank").alias("ranks"), F.col("t.weight").alias("weights"))
    blocks = F.ceil(F.col("n") / BLOCK).cast("int")
    own = F.pmod(F.xxhash64("article_id"), blocks).cast("int")
    dealt = cells.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
    dealt = dealt.select("cell", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), (F.col("own") > F.col("other")).alias("side"), "article_id")
    rows = dealt.join(whole, "article_id").repartition("cell", "i", "j").sortWithinPartitions("cell", "i", "j")

    def score(batches):
        key, held, found = None, ([], [], [], []), []

        def done():
            if len(held[0]) > 1:
                found.append(_cell_pairs(held[0], np.array(held[1]), held[2], held[3], threshold))

        for batch in batches:
            keys = list(zip(*(batch.column(c).to_pylist() for c in ("cell", "i", "j")), strict=True))
            columns = [batch.column(c).to_pylist() for c in ("article_id", "side", "ranks", "weights")]
            for n, k in enumerate(keys):
                if k != key:
                    done()
                    key, held = k, ([], [], [], [])
                for part, column in zip(held, columns, strict=True):
                    part.append(column[n])
            if found:
                yield _pairs_batch(found)
                found = []
        done()
        if found:
            yield _pairs_batch(found)

    id_type = v.schema["article_id"].dataType.simpleString()
    pairs = rows.mapInArrow(score, f"a {id_type}, b {id_type}, cosine double")
    return pairs.groupBy("a", "b").agg(F.max("cosine").alias("cosine"))


def _pairs_batch(found: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*found, strict=True)], ["a", "b", "cosine"])


def similar_pairs(df: DataFrame, threshold: float = 0.85, text: str = "title", **options) -> DataFrame:
    """a < b, cosine: every pair of articles with different bags of terms, each bag by its
    first article, and (first, article, 1.0) for the others of a bag.

    Exact: an inverted index on the rarest terms of each article that together could
    still reach the threshold; terms that many articles share are cut (``meeting_cells``).
    """
    every = settle(tf_idf(df, text, **options))
    bags = settle(same_bags(every))
    v = settle(vectors(every.join(bags.where("article_id = first").select("article_id"), "article_id", "left_semi")))
    scored = meet(meeting_cells(v, threshold), v, threshold)
    alike = bags.where("article_id > first").select(F.col("first").alias("a"), F.col("article_id").alias("b"), F.lit(1.0).alias("cosine"))
    return scored.unionByName(alike)


def greedy_drop(pairs: DataFrame) -> DataFrame:
    """Ids to drop when articles are kept in order and each kept one drops its later
    neighbours.  Each round settles the pairs whose first article has no earlier
    undecided neighbour; pairs stay distributed and shrink every round."""
    left, dropped = settle(pairs.select("a", "b")), None
    while True:
        blocked = left.select(F.col("b").alias("a")).distinct()
        sure = left.join(blocked, "a", "left_anti").select("a").distinct()
        out = left.join(sure, "a").select("b").distinct()
        if out.isEmpty():
            break
        dropped = out if dropped is None else dropped.union(out)
        gone = out.select(F.col("b").alias("x"))
        left = settle(left.join(sure, "a", "left_anti").join(gone, F.col("a") == F.col("x"), "left_anti").join(gone, F.col("b") == F.col("x"), "left_anti"))
    return (dropped if dropped is not None else pairs.select("b").limit(0)).select(F.col("b").alias("article_id")).distinct()


#: Articles of the first step of ``near_copies``; each further one has about as many as all before it.
FIRST_STEP = 20_000


def _earlier(side: np.ndarray, across: bool, ranks: list, weights: list, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Of a block's members in the order of their ids: the place of the first earlier one that each
    is a near copy of, -1 if none, and whether it has any near copy here."""
    sizes = [len(r) for r in ranks]
    terms, at = np.unique(np.concatenate(ranks), return_inverse=True)
    dense = np.zeros((len(sizes), len(terms)))
    dense[np.repeat(np.arange(len(sizes)), sizes), at] = np.concatenate(weights)
    near = dense @ dense.T >= threshold
    if across:
        near &= side[:, None] != side[None]
    np.fill_diagonal(near, False)
    before = np.triu(near)
    return np.where(before.any(0), before.argmax(0), -1), near.any(0)


def _compare(dealt: DataFrame, whole: DataFrame, threshold: float) -> DataFrame:
    """cell, article_id, first: members of blocks that have a near copy in theirs, with the
    first of the earlier ones (null if all are later).

    ``dealt`` has cell, i, j, side, across and article_id.  Members move with their terms;
    what comes back are members, not pairs.
    """
    rows = dealt.join(whole, "article_id").repartition("cell", "i", "j").sortWithinPartitions("cell", "i", "j", "article_id")

    def floats(column):
        flat, ends = column.flatten().to_numpy(zero_copy_only=False), np.cumsum(column.value_lengths().to_numpy(zero_copy_only=False))
        return np.split(flat, ends[:-1])

    def score(batches):
        key, held = None, ([], [], [], [], [])

        def done():
            cells, ids, first = [], [], []
            if len(held[0]) > 1:
                place, near = _earlier(np.array(held[1]), held[2][0], held[3], held[4], threshold)
                cells = [key[0]] * int(near.sum())
                ids = [held[0][n] for n in np.flatnonzero(near)]
                first = [held[0][at] if at >= 0 else None for at in place[near]]
            return cells, ids, first

        for batch in batches:
            keys = list(zip(*(batch.column(c).to_pylist() for c in ("cell", "i", "j")), strict=True))
            columns = [batch.column(c).to_pylist() for c in ("article_id", "side", "across")] + [floats(batch.column(c)) for c in ("ranks", "weights")]
            found = ([], [], [])
            for n, k in enumerate(keys):
                if k != key:
                    for part, more in zip(found, done(), strict=True):
                        part += more
                    key, held = k, ([], [], [], [], [])
                for part, column in zip(held, columns, strict=True):
                    part.append(column[n])
            yield batch_of(found)
        yield batch_of(done())

    def batch_of(found):
        kinds = (pa.int64(), id_arrow, id_arrow)
        return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(found, kinds, strict=True)], ["cell", "article_id", "first"])

    id_type = dealt.schema["article_id"].dataType
    id_arrow = to_arrow_type(id_type)
    return rows.mapInArrow(score, f"cell long, article_id {id_type.simpleString()}, first {id_type.simpleString()}")


def _blocks(n: Column) -> Column:
    return F.ceil(n / BLOCK).cast("int")


def _own(blocks: Column) -> Column:
    return F.pmod(F.xxhash64("article_id"), blocks).cast("int")


def _within(members: DataFrame, ids: DataFrame) -> DataFrame:
    """Blocks in which those of a cell that are in ``ids`` all meet."""
    mine = members.join(ids, "article_id", "left_semi")
    n = mine.groupBy("cell").agg(_blocks(F.count(F.lit(1))).alias("blocks"), F.count(F.lit(1)).alias("n")).where("n > 1")
    own = mine.join(n, "cell").withColumn("own", _own(F.col("blocks"))).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    return own.select("cell", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), (F.col("own") > F.col("other")).alias("side"), (F.col("own") != F.col("other")).alias("across"), "article_id")


def _across(members: DataFrame, stay: DataFrame, ids: DataFrame) -> DataFrame:
    """Blocks in which those of a cell that are in ``stay`` meet those that are in ``ids``."""
    mine = members.join(stay.select("article_id", F.lit(False).alias("side")).unionByName(ids.select("article_id", F.lit(True).alias("side"))), "article_id")
    n = mine.groupBy("cell").agg(F.count_if(~F.col("side")).alias("s"), F.count_if("side").alias("t")).where("s > 0 and t > 0")
    sized = mine.join(n.select("cell", _blocks(F.col("s")).alias("s"), _blocks(F.col("t")).alias("t")), "cell")
    own = sized.withColumn("own", _own(F.when(F.col("side"), F.col("t")).otherwise(F.col("s"))))
    other = own.withColumn("other", F.explode(F.sequence(F.lit(0), F.when(F.col("side"), F.col("s")).otherwise(F.col("t")) - 1)))
    i, j = F.when(F.col("side"), F.col("other")).otherwise(F.col("own")), F.when(F.col("side"), F.col("own")).otherwise(F.col("other"))
    return other.select("cell", i.alias("i"), j.alias("j"), "side", F.lit(True).alias("across"), "article_id")


def near_copies(df: DataFrame, threshold: float = 0.85, text: str = "title", step: int | None = None, small: int | None = None, **options) -> DataFrame:
    """article_id of the articles to drop when they are kept in the order of their ids (numbers)
    and each one that stays drops its later near copies.

    The first article of each bag of terms stands for the others, which always go.  Ids are taken
    in steps, each as large as all before it: its articles first meet those that stayed so far, and
    those that are left meet each other.  There, who has no earlier near copy stays, whose first
    one stays goes, and the rest waits for the next round, with those that just stayed.  So the
    members of a large group of near copies meet the few that stay of it, not one another, and no
    pairs are written: a round writes each cell's members that have a near copy in it.  Cells of up
    to ``small`` members (a block) are not cut: more members would move than compares are saved.
    """
    every = settle(tf_idf(df, text, **options))
    bags = settle(same_bags(every))
    v = settle(vectors(every.join(bags.where("article_id = first").select("article_id"), "article_id", "left_semi")))
    cells = settle(meeting_cells(v, threshold, small or BLOCK).select("cell", "article_id"))
    terms = v.groupBy("article_id").agg(F.sort_array(F.collect_list(F.struct("rank", "weight"))).alias("t"))
    whole = settle(terms.select("article_id", F.col("t.rank").alias("ranks"), F.col("t.weight").alias("weights")))
    ids = settle(cells.select("article_id").distinct())
    dropped, stayed = [bags.where("article_id > first").select("article_id")], []
    size = ids.count()
    steps = max(0, math.ceil(math.log2(size / (step or FIRST_STEP)))) if size else 0
    bounds = sorted(set(ids.agg(F.percentile_approx("article_id", [2.0**-k for k in range(steps, 0, -1)])).first()[0])) if steps else []
    for low, high in itertools.pairwise([None, *bounds, None]):
        left = ids
        if low is not None:
            left = left.where(F.col("article_id") > low)
        if high is not None:
            left = left.where(F.col("article_id") <= high)
        members, fresh = cells, stayed
        while True:
            if fresh:
                meet_stayed = _across(members, functools.reduce(DataFrame.unionByName, fresh), left)
                out = settle(_compare(meet_stayed, whole, threshold).where(F.col("first").isNotNull()).select("article_id").distinct())
                dropped.append(out)
                left = settle(left.join(out, "article_id", "left_anti"))
            found = settle(_compare(_within(members, left), whole, threshold))
            waits = settle(found.where(F.col("first").isNotNull()).groupBy("article_id").agg(F.min("first").alias("first")))
            stays = settle(left.join(waits.select("article_id"), "article_id", "left_anti"))
            out = settle(waits.join(stays.select(F.col("article_id").alias("first")), "first", "left_semi").select("article_id"))
            stayed, fresh = [*stayed, stays], [stays]
            dropped.append(out)
            left = settle(waits.select("article_id").join(out, "article_id", "left_anti"))
            if left.isEmpty():
                break
            members = settle(found.select("cell", "article_id").distinct())
        stayed = [settle(functools.reduce(DataFrame.unionByName, stayed))] if high is not None else stayed
    return functools.reduce(DataFrame.unionByName, dropped)


def process(df: DataFrame, keywords: list[str], threshold: float = 0.85, near: bool = True, body: str = "description", shortest: int = 20) -> DataFrame:
    """clean, title length, date, relevance, titles, near copies of titles, full text;
    newest first.  Of near copies the smallest article_id stays, and only articles that
    stay drop others."""
    out = df.withColumns({c: clean_text(F.col(c)) for c in ("title", body)})
    out = out.where((F.length("title") >= shortest) & F.col("date").isNotNull())
    out = exact_titles(out.where(relevant(F.concat_ws(" ", "title", body), keywords)))
    if near and threshold < 1:
        out = settle(out)
        out = out.join(near_copies(out, threshold), "article_id", "left_anti")
    return out.withColumn("full_text", F.concat("title", F.lit(". "), body)).orderBy(F.col("date").desc(), "article_id")


def daily_articles(df: DataFrame) -> DataFrame:
    """Articles, joined titles and mean score by day, in id order."""
    rows = F.array_sort(F.collect_list(F.struct("article_id", "title")))
    return df.groupBy("date").agg(F.count(F.lit(1)).alias("n"), F.array_join(F.transform(rows, lambda r: r["title"]), " | ").alias("titles"))


def lexicon(texts: pd.Series) -> pd.DataFrame:
    words = texts.fillna("").str.lower().str.findall(r"\w+")
    p = words.map(lambda w: sum(x in POSITIVE for x in w))
    n = words.map(lambda w: sum(x in NEGATIVE for x in w))
    total = (p + n).clip(lower=1)
    return pd.DataFrame({"positive": p / total, "negative": n / total})


def score_sentiment(df: DataFrame, text: str = "full_text", scorer: Callable[[pd.Series], pd.DataFrame] = lexicon, batch: int = 32) -> DataFrame:
    """Adds positive, negative, neutral, net and label by a batch scorer; an empty
    text is neutral."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            parts = [scorer(rows[text][a : a + batch]) for a in range(0, len(rows), batch)]
            s = pd.concat(parts) if parts else pd.DataFrame({"positive": [], "negative": []})
            rows = rows.assign(positive=s["positive"], negative=s["negative"])
            blank = rows[text].fillna("").str.strip() == ""
            rows.loc[blank, ["positive", "negative"]] = 0.0
            yield rows.assign(neutral=1 - rows["positive"] - rows["negative"], net=rows["positive"] - rows["negative"])

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in df.schema.fields if f.name != "net") + ", positive double, negative double, neutral double, net double"
    scored = df.drop("net").mapInPandas(run, schema)
    label = F.when((F.col("positive") > F.col("negative")) & (F.col("positive") > F.col("neutral")), "positive").when(F.col("negative") > F.greatest("positive", "neutral"), "negative").otherwise("neutral")
    return scored.withColumn("label", label)


def daily_sentiment(df: DataFrame, score: str = "net", least: int = 3) -> DataFrame:
    """Mean, spread and share positive by day (null under ``least`` articles), then a
    7-day index, momentum, regime and z."""
    s = Series()
    x = F.col(score)
    d = df.groupBy("date").agg(F.count(x).alias("n"), F.avg(x).alias("_m"), F.stddev_samp(x).alias("_s"), F.avg((x > 0).cast("double")).alias("_p"))
    enough = F.col("n") >= least
    d = d.select("date", "n", F.when(enough, F.col("_m")).alias("mean"), F.when(enough, F.col("_s")).alias("std"), F.when(enough, F.col("_p")).alias("positive_share"))
    d = d.withColumn("index_7d", s.mean("mean", 7, 1))
    regime = F.when(F.col("index_7d") > 0.1, 1).when(F.col("index_7d") < -0.1, -1).otherwise(0)
    return d.withColumns({"momentum_14d": s.diff("index_7d", 14), "regime": regime, "z_60d": s.zscore("index_7d", 60, 10)})
