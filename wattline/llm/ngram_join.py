"""N-gram Jaccard join by vertical partitioning of the global n-gram order.

Exact for any threshold num/den: two documents link when
den * |A and B| >= num * |A or B| over their sets of distinct word shingles.

1. *Global order.*  A sketch of hashed counters over all shingles, 16 a document
   (2^22 at least, 2^26 at most: 64 MB), gives each shingle a frequency level;
   shingles are ordered by (level, 56 bits of hash), rare first.  The order only
   steers how many candidates arise, never which links are found.
2. *Classes.*  Documents with equal sets are one node, known by a 64-bit set hash;
   sets that differ in a second 64-bit hash get new numbers.  Only the document with
   the least id stands for a node further on.
3. *Candidates.*  A similar pair shares a shingle among the first
   n - ceil(t n) + 1 of each set in the global order.  Those (shingle, node,
   size, place) rows are the one large shuffle; shingles of a single node go at
   once.  Size and place bounds prune the rest, then a bound from per-node counts
   of shingles in HISTOGRAM hash buckets: the overlap is at most the sum of the
   lesser counts.
4. *No quadratic groups.*  In each shingle's group all members first meet only
   one hub, the member with the fewest rarer shingles.  Links found there are
   contracted.  A pair that is still apart must share a second shingle among the
   first n - ceil(t n) + 2, so large groups with members apart are split by each
   member's later first shingles, and only members that share both meet.  So every
   pair that may link is either tested or already known to be connected, and many
   unlike texts that have one shingle in common do not meet at all.
5. *Vertical counting.*  The order is cut at pivots into fragments.  For each
   candidate pair the overlap is counted in every fragment separately and the
   partial counts are summed by pair, so no task needs whole sets.
6. *Components* by star contraction; results carry the least document id.

Defined results
* Words are split at blank, tab, \\n, \\v, \\f, \\r; A-Z are lower-cased.
* A text of 1 to size - 1 words has one shingle, its whole sequence.  Null or
  blank texts have none, n_shingles 0, and link with nothing.
* Rows with a null id get their n_shingles, link with nothing, and have a null
  component_id.  Repeated rows are equal documents.  Empty table: no rows.
* Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wattline.llm import kernels
from wattline.llm.components import components
from wattline.llm.text import drop_rows, settle, small_batches

LEAST_BITS, MOST_BITS, COUNTERS = 22, 26, 16
SLICES = 64
FRAGMENTS = 8
HISTOGRAM = 32
#: Members of a group that may all meet; larger groups are split first.
FEW = 32
#: Candidate pairs up to this many are broadcast (some 60 bytes each).
BROADCAST_PAIRS = 500_000
#: Candidate ids up to this many are broadcast to the scan (8 bytes each, so at
#: most some 50 MB); beyond it the texts are shuffled to them.
BROADCAST_IDS = 1_000_000


def _sketch_part(size: int, bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << bits, dtype=np.uint32)
        for batch in kernels.slices(batches):
            words, counts = kernels.word_hashes(*kernels.buffers(batch.column(0)))
            grams, _ = kernels.gram_hashes(words, counts, size)
            np.add.at(total, (grams >> np.uint64(64 - bits)).view(np.int64), np.uint32(1))
        if total.any():
            parts = [zlib.compress(x.tobytes(), 1) for x in total.reshape(SLICES, -1)]
            yield pa.RecordBatch.from_arrays([pa.array(range(SLICES), pa.int32()), pa.array(parts, pa.binary())], ["slice", "counts"])

    return run


def _sum_slice(bits: int):
    def run(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((1 << bits) // SLICES, dtype=np.uint64)
        for batch in batches:
            for part in batch.column("counts"):
                total += np.frombuffer(zlib.decompress(part.as_py()), dtype=np.uint32)
        level = np.minimum(255, np.floor(8 * np.log2(1 + total.astype(np.float64)))).astype(np.uint8)
        mass = np.bincount(level, weights=total, minlength=256)
        yield pa.RecordBatch.from_arrays(
            [pa.array([key[0].as_py()], pa.int32()), pa.array([zlib.compress(level.tobytes(), 1)], pa.binary()), pa.array([mass.tolist()])],
            ["slice", "levels", "mass"],
        )

    return run


class Order:
    """The global n-gram order: frequency level of a hashed counter, then hash."""

    def __init__(self, levels: np.ndarray, pivots: np.ndarray):
        self.levels, self.pivots = levels, pivots
        self.shift = np.uint64(64 - (len(levels).bit_length() - 1))

    def keys(self, grams: np.ndarray) -> np.ndarray:
        level = self.levels[(grams >> self.shift).view(np.int64)].astype(np.uint64)
        return (level << np.uint64(56)) | (grams >> np.uint64(8))


def sketch_bits(n_docs: int) -> int:
    """log2 of the number of counters for so many documents."""
    return min(MOST_BITS, max(LEAST_BITS, (COUNTERS * n_docs - 1).bit_length() if n_docs else 0))


def global_order(texts: DataFrame, size: int, fragments: int = FRAGMENTS, bits: int | None = None) -> Order:
    """``texts`` has one string column.  What comes to the driver is 2^bits bytes."""
    bits = bits or sketch_bits(texts.count())
    parts = texts.mapInArrow(_sketch_part(size, bits), "slice int, counts binary")
    rows = parts.groupBy("slice").applyInArrow(_sum_slice(bits), "slice int, levels binary, mass array<double>").toLocalIterator()
    levels, mass = np.zeros((SLICES, (1 << bits) // SLICES), dtype=np.uint8), np.zeros(256)
    for row in rows:
        levels[row["slice"]] = np.frombuffer(zlib.decompress(row["levels"]), dtype=np.uint8)
        mass += np.array(row["mass"])
    # Pivots at equal shares of the occurrences; inside a level hashes are uniform.
    shares, ends = np.arange(1, fragments) * mass.sum() / fragments, np.cumsum(mass)
    level = np.minimum(np.searchsorted(ends, shares, "right"), 255)
    inside = np.clip((shares - (ends - mass)[level]) / np.maximum(mass[level], 1), 0, 1 - 2**-40)
    pivots = (level.astype(np.uint64) << np.uint64(56)) | (inside * 2.0**56).astype(np.uint64)
    return Order(levels.reshape(-1), np.sort(pivots))


def _sets(batch_texts: pa.Array, size: int, order: Order) -> Iterator[np.ndarray]:
    words, counts = kernels.word_hashes(*kernels.buffers(batch_texts))
    grams, n = kernels.gram_hashes(words, counts, size)
    keys = order.keys(grams)
    ends = np.cumsum(n)
    for a, b in zip(ends - n, ends, strict=True):
        yield np.unique(keys[a:b])


def _node(keys: np.ndarray, bits: int) -> tuple[np.uint64, np.uint64]:
    """Two independent hashes of a set; the first is cut to ``bits`` (64 but in tests)."""
    with np.errstate(over="ignore"):
        mixed, n = kernels.mix(keys), np.uint64(len(keys))
        totals = [mixed.sum(dtype=np.uint64) + n * np.uint64(0xA24BAED4963EE407), kernels.mix(mixed ^ np.uint64(0x9FB21C651E98DF25)).sum(dtype=np.uint64) ^ n]
        node, check = kernels.mix(np.array(totals))
        return node >> np.uint64(64 - bits), check


def _describe(size: int, num: int, den: int, shared, bits: int):
    """id, text key, text -> id, text key, n, node, check, first shingles, histogram.

    The first shingles are one more than a pair must share one of, so that a pair
    must share two of them if it needs an overlap of two.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in kernels.slices(batches):
            n, nodes, firsts, counts = [], [], [], []
            for keys in _sets(batch.column(2), size, shared.value):
                n.append(len(keys))
                nodes.append(_node(keys, bits))
                counts.append(np.bincount((keys & np.uint64(HISTOGRAM - 1)).view(np.int64), minlength=HISTOGRAM))
                firsts.append(keys[: len(keys) - -(-num * len(keys) // den) + 2])
            hashes = np.array(nodes, dtype=np.uint64).reshape(-1, 2)
            node, check = (pa.array(kernels.as_long(np.ascontiguousarray(h)), mask=np.array(n) == 0) for h in hashes.T)
            first = kernels.lists_of(np.concatenate(firsts) if firsts else np.zeros(0, np.uint64), np.array([len(x) for x in firsts], dtype=np.int64))
            flat = pa.array(np.concatenate(counts).astype(np.int32)) if counts else pa.array([], pa.int32())
            histogram = pa.ListArray.from_arrays(pa.array(np.arange(len(n) + 1, dtype=np.int32) * HISTOGRAM), flat)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n, pa.int64()), node, check, first, histogram], ["doc_id", "text_key", "n", "node", "check", "first", "histogram"])

    return run


def _fragments(size: int, shared, bits: int):
    """text -> node, check, fragment, the set's shingles in that fragment."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in kernels.slices(batches):
            nodes, ids, lengths, values = [], [], [], []
            for keys in _sets(batch.column(0), size, shared.value):
                cuts = np.concatenate(([0], np.searchsorted(keys, shared.value.pivots), [len(keys)]))
                full = np.flatnonzero(np.diff(cuts))
                nodes.extend([_node(keys, bits)] * len(full))
                ids.extend(full.tolist())
                lengths.extend(np.diff(cuts)[full].tolist())
                values.append(keys)
            node, check = (pa.array(kernels.as_long(np.ascontiguousarray(h))) for h in np.array(nodes, dtype=np.uint64).reshape(-1, 2).T)
            yield pa.RecordBatch.from_arrays(
                [node, check, pa.array(ids, pa.int32()), kernels.lists_of(np.concatenate(values) if values else np.zeros(0, np.uint64), np.array(lengths, dtype=np.int64))],
                ["node", "check", "fragment", "keys"],
            )

    return run


def _apart(rows: DataFrame, clash: DataFrame | None) -> DataFrame:
    """New node numbers for sets that share ``node`` but not ``check``; drops ``check``."""
    if clash is None:
        return rows.drop("check")
    hit = clash.withColumn("hit", F.lit(True))
    moved = F.when(F.col("hit"), F.xxhash64("node", "check")).otherwise(F.col("node"))
    return rows.join(hit, "node", "left").withColumn("node", moved).drop("hit", "check")


def _may_link(a: str, b: str, num: int, den: int):
    """Bound on the overlap at a shared shingle: it and what follows it in both."""
    most = F.least(F.col(f"{a}_n") - F.col(f"{a}_pos"), F.col(f"{b}_n") - F.col(f"{b}_pos"))
    sizes = F.col(f"{a}_n") + F.col(f"{b}_n")
    return (num + den) * most >= num * sizes


@dataclass
class _Join:
    """What all steps of one join need."""

    docs: DataFrame
    nodes: DataFrame
    order: Broadcast
    clash: DataFrame | None
    size: int
    num: int
    den: int
    bits: int


def _verify(pairs: DataFrame, j: _Join) -> DataFrame:
    """Pairs (u, v) whose overlap, summed over fragments, reaches the bound.

    Only the texts of nodes in a pair are read into sets again.
    """
    n_pairs = pairs.count()
    if n_pairs == 0:
        return pairs.select("u", "v")
    pairs = F.broadcast(pairs) if n_pairs <= BROADCAST_PAIRS else pairs
    ends = pairs.select(F.col("u").alias("node")).union(pairs.select(F.col("v").alias("node"))).distinct()
    wanted = settle(ends.join(j.nodes, "node").select(F.col("rep").alias("_rep")))
    near = F.broadcast(wanted) if wanted.count() <= BROADCAST_IDS else wanted
    texts = j.docs.join(near, F.col("doc_id") == F.col("_rep"), "left_semi").select("text")
    parts = texts.mapInArrow(_fragments(j.size, j.order, j.bits), "node long, check long, fragment int, keys array<long>")
    parts = settle(_apart(parts, j.clash))
    left = parts.select(F.col("node").alias("u"), "fragment", F.col("keys").alias("u_keys"))
    right = parts.select(F.col("node").alias("v"), "fragment", F.col("keys").alias("v_keys"))
    partial = pairs.join(left, "u").join(right, ["v", "fragment"])
    # Written before it is summed: the sums would want the join's own partitioning,
    # and a hub's fragments could then not be split.  A document that is read twice
    # gives its fragments twice, hence the maximum.
    counted = settle(partial.select("u", "v", "sizes", "fragment", F.size(F.array_intersect("u_keys", "v_keys")).alias("part")))
    partial = counted.groupBy("u", "v", "sizes", "fragment").agg(F.max("part").alias("part"))
    total = partial.groupBy("u", "v", "sizes").agg(F.sum("part").alias("overlap"))
    return settle(total.where((j.num + j.den) * F.col("overlap") >= j.num * F.col("sizes")).select("u", "v"))


def _pairs(joined: DataFrame, a: str, b: str, j: _Join) -> DataFrame:
    """Distinct pairs (u, v, sizes) whose histograms leave enough room to overlap."""
    pairs = joined.select(
        F.least(f"{a}_node", f"{b}_node").alias("u"), F.greatest(f"{a}_node", f"{b}_node").alias("v"), (F.col(f"{a}_n") + F.col(f"{b}_n")).alias("sizes")
    ).distinct()
    left, right = (j.nodes.select(F.col("node").alias(e), F.col("histogram").alias(f"{e}_h")) for e in ("u", "v"))
    most = F.aggregate(F.zip_with("u_h", "v_h", lambda x, y: F.least(x, y)), F.lit(0), lambda t, x: t + x)
    roomy = pairs.join(left, "u").join(right, "v").where((j.num + j.den) * most >= j.num * F.col("sizes"))
    return settle(roomy.select("u", "v", "sizes"))


def _side(df: DataFrame, name: str) -> DataFrame:
    return df.select("cell", *[F.col(c).alias(f"{name}_{c}") for c in ("node", "n", "pos", "root")])


def _still_apart(rooted: DataFrame, firsts: DataFrame, j: _Join) -> DataFrame:
    """Pairs of members of one group that no link found so far connects.

    In a group of more than FEW members, only those meet that share a second one of
    their first shingles, further on in the order; a pair whose second shared one comes
    before meets in that one's group.  A set that could link with an overlap of one
    keeps its whole group as well; from a threshold of one half on that is no set of two
    shingles or more.
    """
    least = F.min(F.struct("pos", "node", "root"))["root"].alias("h_root")
    state = rooted.groupBy("key").agg(least, F.min("root").alias("a"), F.max("root").alias("b"), F.count(F.lit(1)).alias("members"))
    state = settle(state.where("a <> b").select("key", "h_root", "members"))
    open_keys = settle(rooted.join(state, "key"))
    few = open_keys.where(F.col("members") <= FEW).select(F.col("key").alias("cell"), "node", "n", "pos", "root", "h_root")

    later = F.slice("first", F.col("pos") + 2, F.size("first"))
    whole = F.when(-F.floor(-j.num * F.col("n") / j.den) <= 1, F.array(F.lit(None).cast("long"))).otherwise(F.array().cast("array<long>"))
    many = open_keys.where(F.col("members") > FEW).drop("h_root").join(firsts, "node")
    cells = many.select(F.explode(F.concat(later, whole)).alias("second"), "key", "node", "n", "pos", "root")
    cells = cells.select(F.xxhash64("key", "second").alias("cell"), "node", "n", "pos", "root")
    ends = cells.groupBy("cell").agg(least, F.min("root").alias("a"), F.max("root").alias("b"))
    shared = settle(cells.join(settle(ends.where("a <> b").select("cell", "h_root")), "cell"))

    def meet(rows: DataFrame) -> DataFrame:
        apart, every = _side(rows.where("root <> h_root"), "x"), _side(rows, "y")
        return apart.join(every, "cell").where((F.col("x_root") != F.col("y_root")) & _may_link("x", "y", j.num, j.den)).drop("cell")

    return meet(few).unionByName(meet(shared))


def _links(sets: DataFrame, j: _Join) -> DataFrame:
    """Links (u, v) between nodes that together connect all that are similar."""
    alone = sets.join(j.nodes.select("node", F.col("rep").alias("doc_id")), ["node", "doc_id"])
    firsts = settle(alone.select("node", F.col("n").cast("int").alias("n"), "first").dropDuplicates(["node"]))
    rows = firsts.select("node", "n", F.posexplode("first").alias("pos", "key")).where(j.num * F.col("n") <= j.den * (F.col("n") - F.col("pos")))
    common = settle(rows.groupBy("key").agg(F.min("node").alias("a"), F.max("node").alias("b")).where("a <> b").select("key"))
    members = settle(rows.join(common, "key").select("key", "node", "n", "pos"))

    hubs = members.groupBy("key").agg(F.min(F.struct("pos", "node", "n")).alias("hub"))
    hubs = settle(hubs.select("key", F.col("hub.node").alias("h_node"), F.col("hub.n").alias("h_n"), F.col("hub.pos").alias("h_pos")))
    star = members.select("key", *[F.col(c).alias(f"m_{c}") for c in ("node", "n", "pos")]).join(hubs, "key")
    star = star.where((F.col("m_node") != F.col("h_node")) & _may_link("m", "h", j.num, j.den))
    roots = components(_verify(_pairs(star, "m", "h", j), j))

    rooted = members.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    rooted = settle(rooted.select("key", "node", "n", "pos", "root"))
    second = _verify(_pairs(_still_apart(rooted, firsts.select("node", "first"), j), "x", "y", j), j)
    return roots.select(F.col("node").alias("u"), F.col("root").alias("v")).union(second.select("u", "v"))


def _members(docs: DataFrame, size: int, threshold: tuple[int, int], id_col: str, text_col: str, bits: int | None = None, node_bits: int = 64) -> DataFrame:
    """One row per input row: doc_id, text_key, n_shingles, component_id."""
    num, den = threshold
    spark = docs.sparkSession
    small_batches(spark)
    docs = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(text_col).alias("text_key"), F.col(text_col).alias("text"))
    kind = docs.schema["doc_id"].dataType.simpleString()
    order = spark.sparkContext.broadcast(global_order(docs.select("text"), size, bits=bits))
    sets = settle(docs.mapInArrow(_describe(size, num, den, order, node_bits), f"doc_id {kind}, text_key long, n long, node long, check long, first array<long>, histogram array<int>"))
    clash = settle(sets.groupBy("node").agg(F.min("check").alias("a"), F.max("check").alias("b")).where("a <> b").select("node"))
    clash = None if clash.isEmpty() else clash
    sets = _apart(sets, clash)
    nodes = settle(sets.where("node is not null and doc_id is not null").groupBy("node").agg(F.min("doc_id").alias("rep"), F.first("histogram").alias("histogram")))
    roots = components(_links(sets, _Join(docs, nodes, order, clash, size, num, den, node_bits))).join(nodes, "node")
    least = roots.groupBy("root").agg(F.min("rep").alias("least"))
    moved = roots.join(least, "root").select("node", "least")
    known = settle(nodes.join(moved, "node", "left").select("node", F.coalesce("least", "rep").alias("rep")))
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("rep", "doc_id"))
    return sets.join(known, "node", "left").select("doc_id", "text_key", F.col("n").alias("n_shingles"), component.alias("component_id"))


def similar_components(docs: DataFrame, size: int = 5, threshold: tuple[int, int] = (80, 100), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, n_shingles, component_id (least id reachable)."""
    return _members(docs, size, threshold, id_col, text_col).drop("text_key")


def keep_one(docs: DataFrame, size: int = 5, threshold: tuple[int, int] = (80, 100)) -> DataFrame:
    """One document of each component, that with the least id, with all columns of ``docs``.

    Of rows with that id in the component the one with the least text hash stays, once
    however often it is repeated.  Rows with a null id have no component and stay.
    """
    found = settle(_members(docs, size, threshold, "doc_id", "text").where("doc_id is not null"))
    key = {"doc_id": F.col("doc_id"), "text_key": F.xxhash64("text")}
    mine = found.where("component_id = doc_id")
    best = settle(mine.groupBy("component_id").agg(F.min("text_key").alias("best")))
    kept = mine.join(best, "component_id").where("text_key = best").groupBy(*key).agg(F.count(F.lit(1)).alias("n"))
    kept = settle(kept)
    gone = found.select(*key).distinct().join(kept.select(*key), list(key), "left_anti")
    return drop_rows(docs, key, gone, kept.where("n > 1"))
