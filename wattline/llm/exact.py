"""Exact dedup: group by a 128-bit content hash, then compare bytes.

1. Narrow rows (id, hash) are grouped by hash, with a map-side combine, so a text
   that a third of all rows share costs one row a task.
2. Only the texts whose hash has two rows or more are read again and grouped by
   hash *and* text, so Spark compares the bytes and two texts that collide on the
   hash come out as two groups.  The hashes are broadcast up to a checked number;
   beyond it the join is shuffled.
3. Every row gets its group, if it has more than one row, by a join of narrow
   rows on (hash, SHA-256); a hot hash is on the probe side of a shuffled join,
   which adaptive execution can split.

Defined results
* Null text counts as the empty text; all empty texts are one group.
* Null ids order after all others: they are kept only where a group has no id,
  and then keep_id is null.  Rows that repeat the kept id with the same text are
  one document read twice; ``kept`` is true on each, and ``drop_copies`` keeps one.
* Empty table: no rows.  Other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wattline.llm.text import drop_rows, settle

#: Hashes of repeated texts up to this many are broadcast (16 bytes each, some 100 MB
#: as a hash table).
BROADCAST_HASHES = 500_000


def exact_groups(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    keep: str = "smallest",
    normalise: Callable[[Column], Column] | None = None,
    hash128: Callable[[Column], Column] = F.md5,
) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256.

    ``keep`` is "smallest" or "largest" id.  ``hash128`` may be replaced, for
    instance by a weak hash in tests of the byte comparison.
    """
    best = {"smallest": F.min, "largest": F.max}[keep]
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("doc_id"), (normalise(text) if normalise else text).alias("t"))
    keyed = rows.withColumn("h", F.unhex(hash128(F.col("t").cast("binary"))))
    narrow = settle(keyed.select("doc_id", "h", F.sha2(F.col("t").cast("binary"), 256).alias("text_sha256")))
    again = settle(narrow.groupBy("h").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("h"))
    again = F.broadcast(again) if again.count() <= BROADCAST_HASHES else again
    groups = (
        keyed.join(again, "h", "left_semi")
        .groupBy("h", "t")
        .agg(best("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
        .where("group_size > 1")
        .select("h", F.sha2(F.col("t").cast("binary"), 256).alias("text_sha256"), "keep_id", "group_size")
    )
    out = narrow.join(settle(groups), ["h", "text_sha256"], "left")
    alone = F.col("group_size").isNull()
    keep_id = F.when(alone, F.col("doc_id")).otherwise(F.col("keep_id"))
    return out.select(
        "doc_id",
        keep_id.alias("keep_id"),
        F.coalesce("group_size", F.lit(1).cast("long")).alias("group_size"),
        F.col("doc_id").eqNullSafe(keep_id).alias("kept"),
        "text_sha256",
    )


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "smallest") -> DataFrame:
    """One row of each distinct text, with all columns of ``docs``.

    Only ids and digests of the dropped rows meet the documents again.  Of rows that
    repeat a kept id and its text, one stays; which one is not defined.
    """
    groups = settle(exact_groups(docs, id_col, text_col, keep))
    key = {"doc_id": F.col(id_col), "text_sha256": F.sha2(F.coalesce(F.col(text_col), F.lit("")).cast("binary"), 256)}
    twice = groups.where("kept and group_size > 1").groupBy(*key).agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    return drop_rows(docs, key, groups.where("not kept").select(*key).distinct(), settle(twice.select(*key)))
