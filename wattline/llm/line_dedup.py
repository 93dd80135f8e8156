"""Line dedup by a deletion-neighbourhood join.

A line is dropped if an earlier line, in the order (document id, line number), is
equal to it or within the edit bound.  Lines are compared as word sequences, so
white space does not matter.  The bound is one unit in ten at most, and one unit:

* if either line has UNITS = 10 words or more, one word (replaced, put in, left out);
* else, if the longer of the two has UNITS characters or more, one character;
* shorter lines have equal copies only.

1. *Exact.*  Lines are counted by hash with a map-side combine, so the line that a
   third of all rows hold costs one row a task.
2. *Survivors.*  Two lines one unit apart share either their first or their second
   half (pigeonhole; four half keys a line, for the line as the longer and as the
   shorter one).  Only lines that share a half with another go on.
3. *Variants.*  Each survivor emits, for every unit, the 128-bit hash of the line
   without it, and the hash of the whole line.  The hash of a sequence is the
   exclusive or of its units hashed with their places, so running values by a
   window over (line, place) rows give all variants of a line in linear work.  Equal
   (variant, place) means one unit replaced; a variant equal to a whole line means
   one left out.
4. *Earliest.*  Within either kind of group all members are one edit from each
   other, or from the whole line, so the least (document, line) by group is enough;
   pairs are never listed.
5. *Verified.*  Each line is compared with every earlier line found, and the
   earliest that is within the bound counts.

Aggregates combine map-side and are written before they are joined back, so those
joins are plain shuffles on both sides, which adaptive execution can split when a
key is hot.

Defined results
* Lines are split at \\n.  Lines without a word are kept and never compared.
* Null text: no lines.  Null document ids order first.  Rows that repeat an id
  and its text are one document; rows that share only an id are told apart by
  their text.
* A line may be dropped for the sake of a line that is itself dropped.
* The numbers of a document's dropped lines are gathered, four bytes each; the text
  that stays is put together from the slices between them, in linear time.
* A line of n units that survives step 2 costs n rows of 40 bytes in step 3.
* Empty table: no rows.  Other columns are kept, whatever their names; columns called
  n_lines, n_copies or n_near are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wattline.llm.text import free, let, settle, words

UNITS = 10
WORDS, CHARS = 0, 1
#: Survivor lines up to this many are broadcast to the text scan (some 200 bytes
#: each, so at most 50 MB); beyond it the lines are shuffled to them.
BROADCAST_LINES = 250_000


def _lines(docs: DataFrame) -> DataFrame:
    """doc_id, text_key, line_no, line for every line."""
    keyed = docs.select("doc_id", "text", F.xxhash64("text").alias("text_key"))
    return keyed.select("doc_id", "text_key", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))


def _half_keys(ws: Column) -> Column:
    """Hashes of both halves, with the line as the longer and as the shorter one."""

    def keys(kind, sequence, size, part):
        out = []
        for longer in (size, size + 1):
            half = F.floor(longer / 2).cast("int")
            rest = longer - half
            ends = [(F.lit(0), F.lit(1), half), (F.lit(1), size - rest + 1, rest)]
            out += [F.when(longer >= UNITS, F.xxhash64(F.lit(kind), longer, end, part(sequence, start, n))) for end, start, n in ends]
        return F.array_compact(F.array(*out))

    line = F.array_join(ws, " ")
    by_word = keys(WORDS, ws, F.size(ws), F.slice)
    by_char = keys(CHARS, line, F.length(line), F.substring)
    return F.when(F.size(ws) >= UNITS, by_word).when(F.size(ws) == UNITS - 1, F.concat(by_word, by_char)).otherwise(by_char)


def _characters(ws: Column) -> Column:
    return F.regexp_extract_all(F.array_join(ws, " "), F.lit("(?s)."), F.lit(0))


def _within_one(a: Column, b: Column) -> Column:
    """True if two arrays are at most one replaced, added or missing unit apart."""
    short, long = F.when(F.size(a) <= F.size(b), a).otherwise(b), F.when(F.size(a) <= F.size(b), b).otherwise(a)
    differ = F.size(F.filter(F.zip_with(a, b, lambda x, y: ~x.eqNullSafe(y)), lambda d: d))
    first = F.array_position(F.zip_with(short, long, lambda x, y: ~x.eqNullSafe(y)), True).cast("int")
    without = F.concat(F.slice(long, 1, first - 1), F.slice(long, first + 1, F.size(long)))
    return F.when(F.size(a) == F.size(b), differ <= 1).when(F.size(long) - F.size(short) == 1, without == short).otherwise(False)


def _variants(held: DataFrame) -> DataFrame:
    """(h, place, v, w) of lines (h, ws): place 0 is the whole line, p its rest without unit p.

    Lines of UNITS - 1 units are only whole, for the sake of those one unit longer.
    """
    n = F.size("ws")
    empty = F.array().cast("array<string>")
    forms = F.array(
        F.struct(F.lit(WORDS).alias("kind"), F.when(n >= UNITS - 1, F.col("ws")).otherwise(empty).alias("units")),
        F.struct(F.lit(CHARS).alias("kind"), F.when(n < UNITS, _characters(F.col("ws"))).otherwise(empty).alias("units")),
    )
    each = held.select("h", F.explode(forms).alias("form")).select("h", "form.kind", "form.units").where(F.size("units") >= UNITS - 1)
    rows = each.select("h", "kind", F.size("units").alias("size"), F.posexplode("units").alias("at", "unit"))
    # ``moved`` is a unit one place further left, as after one left out before it.
    hashes = {f"{name}{seed}": F.xxhash64(F.lit(seed), "kind", "unit", F.col("at") - back) for seed in (0, 1) for name, back in (("here", 0), ("moved", 1))}
    rows = rows.select("h", "kind", "size", "at", *[c.alias(k) for k, c in hashes.items()])
    line = Window.partitionBy("h", "kind")
    before = line.orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    after = line.orderBy("at").rowsBetween(1, Window.unboundedFollowing)
    zero = F.lit(0).cast("long")

    def xor(name, frame):
        return F.coalesce(F.bit_xor(name).over(frame), zero)

    front = {f"front{s}": xor(f"here{s}", before) for s in (0, 1)}
    # What follows is the whole less what came before and the unit itself.
    total = {f"{k}{s}": F.bit_xor(f"{k}{s}").over(line) for s in (0, 1) for k in ("here", "moved")}
    passed = {f"passed{s}": xor(f"moved{s}", before) for s in (0, 1)}
    values = rows.select("h", "size", "at", *[f"moved{s}" for s in (0, 1)], *[c.alias(k) for k, c in (front | passed).items()], *[c.alias(f"all_{k}") for k, c in total.items()])
    without = [F.col(f"front{s}").bitwiseXOR(F.col(f"all_moved{s}")).bitwiseXOR(F.col(f"passed{s}")).bitwiseXOR(F.col(f"moved{s}")) for s in (0, 1)]
    removed = F.when(F.col("size") >= UNITS, F.struct((F.col("at") + 1).alias("place"), without[0].alias("v"), without[1].alias("w")))
    whole = F.when(F.col("at") == 0, F.struct(F.lit(0).alias("place"), F.col("all_here0").alias("v"), F.col("all_here1").alias("w")))
    return values.select("h", F.explode(F.array_compact(F.array(removed, whole))).alias("x")).select("h", "x.*")


def _near(lines: DataFrame, narrow: DataFrame) -> DataFrame:
    """(h, near_h): lines with an earlier line within the bound."""
    first = narrow.groupBy("h").agg(F.min(F.struct("doc_id", "text_key", "line_no")).alias("ord"))
    halves = narrow.where(F.size("halves") > 0).select("h", F.explode("halves").alias("half"))
    shared = settle(halves.groupBy("half").agg(F.min("h").alias("a"), F.max("h").alias("b")).where("a <> b").select("half"))
    survivors = settle(halves.join(shared, "half").select("h").distinct().join(first, "h"))
    ids = survivors.select(F.col("h").alias("_h"), F.col("ord").alias("_ord"))
    ids = F.broadcast(ids) if survivors.count() <= BROADCAST_LINES else ids
    here = F.struct("doc_id", "text_key", "line_no")
    held = lines.join(ids, here.eqNullSafe(F.col("_ord"))).select(F.col("_h").alias("h"), F.col("_ord").alias("ord"), words(F.col("line")).alias("ws"))
    held = settle(held.dropDuplicates(["h"]))
    variants = settle(_variants(held))
    common = settle(variants.groupBy("v").agg(F.min("h").alias("a"), F.max("h").alias("b")).where("a <> b").select("v"))
    kept = settle(variants.join(common, "v").join(held.select("h", "ord"), "h"))

    def best(df, *by):
        return settle(df.groupBy(*by).agg(F.min(F.struct("ord", "h")).alias("best")))

    removed, whole = kept.where("place > 0"), kept.where("place = 0")
    replaced = removed.join(best(removed, "v", "w", "place"), ["v", "w", "place"])
    added = whole.join(best(removed, "v", "w"), ["v", "w"])
    missing = removed.join(best(whole, "v", "w"), ["v", "w"])
    links = None
    for found in (replaced, added, missing):
        found = found.where(F.col("best.ord") < F.col("ord")).select("h", F.col("best.h").alias("near_h"), F.col("best.ord").alias("near_ord"))
        links = found if links is None else links.union(found)
    mine, other = held.select("h", "ws"), held.select(F.col("h").alias("near_h"), F.col("ws").alias("near_ws"))
    both = links.distinct().join(mine, "h").join(other, "near_h")
    by_word = F.greatest(F.size("ws"), F.size("near_ws")) >= UNITS
    close = F.when(by_word, _within_one(F.col("ws"), F.col("near_ws"))).otherwise(_within_one(_characters(F.col("ws")), _characters(F.col("near_ws"))))
    return both.where(close).groupBy("h").agg(F.min(F.struct("near_ord", "near_h"))["near_h"].alias("near_h"))


def line_verdicts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per line with a word: doc_id, text_key, line_no, copy, near.

    ``copy`` is true if an equal line comes earlier, ``near`` if one within the bound does.
    """
    texts = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    lines = _lines(texts)
    split = lines.withColumn("ws", words(F.col("line"))).where(F.size("ws") > 0)
    narrow = settle(split.select("doc_id", "text_key", "line_no", F.xxhash64("ws").alias("h"), _half_keys(F.col("ws")).alias("halves")))
    near = settle(_near(lines, narrow))
    first = narrow.groupBy("h").agg(F.min(F.struct("doc_id", "text_key", "line_no")).alias("first"))
    decided = settle(first.join(near, "h", "left").select("h", "first", F.col("near_h").isNotNull().alias("near")))
    here = F.struct("doc_id", "text_key", "line_no")
    return narrow.join(decided, "h").select("doc_id", "text_key", "line_no", (~here.eqNullSafe(F.col("first"))).alias("copy"), "near")


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """All columns of ``docs`` with the text of the lines that stay, and the counts
    n_lines, n_copies and n_near (lines dropped as copies, else as near copies)."""
    drop = line_verdicts(docs, id_col, text_col).where("copy or near").distinct()
    by_doc = drop.groupBy("doc_id", "text_key").agg(F.sort_array(F.collect_list("line_no")).alias("gone"), F.count_if("copy").alias("copies"), F.count_if(~F.col("copy")).alias("near"))
    mine, key, gone, copies, near = (free(c, docs) for c in ("_id", "_key", "_gone", "_copies", "_near"))
    by_doc = by_doc.toDF(mine, key, gone, copies, near)
    same = docs[id_col].eqNullSafe(F.col(mine)) & (F.xxhash64(docs[text_col]) == F.col(key))
    joined = docs.join(by_doc, same, "left")
    lines = F.split(docs[text_col], "\n")

    def stay(every):
        """The slices between the dropped lines: each line is copied once."""

        def between(end, i):
            start = F.coalesce(F.get(F.col(gone), i - 1), F.lit(-1)) + 1
            return F.slice(every, start + 1, end - start)

        return F.flatten(F.transform(F.concat(F.col(gone), F.array(F.size(every))), between))

    counts = {
        "n_lines": F.size(F.filter(lines, lambda x: x.rlike(r"[^\x20\x09-\x0D]"))).cast("long"),
        "n_copies": F.col(copies),
        "n_near": F.col(near),
    }
    kept = [F.when(F.col(gone).isNull(), docs[c]).otherwise(let(lines, lambda every: F.array_join(stay(every), "\n"))).alias(c) if c == text_col else docs[c] for c in docs.columns if c.lower() not in counts]
    return joined.select(*kept, *[F.coalesce(c, F.lit(0).cast("long")).alias(k) for k, c in counts.items()])
