"""Quality rules as a bitmask ledger.

Every rule is evaluated once; the ledger stores the measurements and one failure
bit a rule.  A policy is a named, versioned mask over those bits: applying one,
or asking what would change without a rule (``ablation``), reads the ledger and
never the texts again.

All measures are built-in expressions inside the row, so a text never leaves its
task and there is no shuffle.  The repeated 5-word windows are found by hashing
each window and, only in texts where a hash recurs, sorting (hash, position).

Defined results
* Null and blank texts: all measures 0, ``too_few_words`` fails.
* A document with null id is judged like any other.  Repeated rows give repeated
  rows.  Empty table: no rows.  Other columns are ignored, whatever their names.
* Texts of any length: time grows as n log n in the words of a text.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wattline.llm.text import let, words

WINDOW = 5
SYMBOLS = r"[#*$%&|<>]"
HAS_WORD = r"[^\x20\x09-\x0D]"

#: Rule name to failure condition over the measures; the order fixes the bits.
RULES: dict[str, Callable[[Column], Column]] = {
    "too_few_words": lambda m: m["n_words"] < 10,
    "repeated_windows": lambda m: 100 * m["n_repeat_words"] > 20 * m["n_words"],
    "many_symbols": lambda m: 10 * m["n_symbols"] > m["n_words"],
    "short_words": lambda m: m["word_chars"] < 2 * m["n_words"],
    "long_words": lambda m: m["word_chars"] > 20 * m["n_words"],
    "repeated_lines": lambda m: (m["n_lines"] >= 4) & (10 * m["n_dup_lines"] > 3 * m["n_lines"]),
}
#: Policy name to the rules that reject.  New versions are added, old ones stay.
POLICIES: dict[str, tuple[str, ...]] = {
    "base": ("too_few_words", "repeated_windows"),
    "v1": tuple(RULES),
}


def bit(rule: str) -> int:
    return 1 << list(RULES).index(rule)


def mask(policy: str) -> int:
    return sum(bit(r) for r in POLICIES[policy])


def repeated_window_words(ws: Column, size: int = WINDOW) -> Column:
    """Words that lie in a ``size``-word window found twice or more, first included."""

    def window(i):
        return F.xxhash64(*[F.get(ws, i + k) for k in range(size)])

    def covered(starts):
        def add(acc, p):
            fresh = p + size - F.greatest(p, acc["end"])
            return F.struct((acc["n"] + fresh).alias("n"), (p + size).alias("end"))

        zero = F.struct(F.lit(0).alias("n"), F.lit(0).alias("end"))
        return F.aggregate(starts, zero, add, lambda acc: acc["n"])

    def recurring(pairs):
        def same(i, j):
            return F.coalesce(F.get(pairs, i)["h"] == F.get(pairs, j)["h"], F.lit(False))

        at = F.filter(F.sequence(F.lit(0), F.size(pairs) - 1), lambda i: same(i, i - 1) | same(i, i + 1))
        return F.sort_array(F.transform(at, lambda i: F.get(pairs, i)["p"]))

    def count(hashes):
        pairs = F.sort_array(F.transform(hashes, lambda h, p: F.struct(h.alias("h"), p.alias("p"))))
        found = let(pairs, lambda s: let(recurring(s), covered))
        return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0)).otherwise(found)

    hashes = F.transform(F.sequence(F.lit(0), F.size(ws) - size), window)
    return F.when(F.size(ws) > size, let(hashes, count)).otherwise(F.lit(0)).cast("long")


def measures(text: Column) -> Column:
    """Struct of the measurements that the rules read, from one pass over a text."""
    text = F.coalesce(text, F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(HAS_WORD))
    parts = F.struct(words(text).alias("ws"), lines.alias("lines"))

    def measure(p):
        values = {
            "n_words": F.size(p["ws"]),
            "word_chars": F.length(F.array_join(p["ws"], "")),
            "n_symbols": F.regexp_count(text, F.lit(SYMBOLS)),
            "n_lines": F.size(p["lines"]),
            "n_dup_lines": F.size(p["lines"]) - F.size(F.array_distinct(p["lines"])),
            "n_repeat_words": repeated_window_words(p["ws"]),
        }
        return F.struct(*[v.cast("long").alias(k) for k, v in values.items()])

    return let(parts, measure)


def fail_bits(m: Column) -> Column:
    """Bit i is set where rule i fails."""
    bits = F.lit(0)
    for rule, fails in RULES.items():
        bits = bits.bitwiseOR(F.when(fails(m), F.lit(bit(rule))).otherwise(F.lit(0)))
    return bits.cast("long")


def ledger(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, the measures and ``fail_bits``."""
    measured = docs.select(F.col(id_col).alias("doc_id"), measures(F.col(text_col)).alias("m"))
    return measured.select("doc_id", "m.*", fail_bits(F.col("m")).alias("fail_bits"))


def judge(book: DataFrame, policy: str = "v1", base: str = "base") -> DataFrame:
    """Adds base_failed and kept under a policy; the base rules always count."""
    failed = F.col("fail_bits").bitwiseAND(F.lit(mask(base))) != 0
    rejected = F.col("fail_bits").bitwiseAND(F.lit(mask(policy) | mask(base))) != 0
    return book.withColumn("base_failed", failed).withColumn("kept", ~rejected)


def keep_good(docs: DataFrame, policy: str = "v1", text_col: str = "text") -> DataFrame:
    """The documents a policy keeps, with all their columns; no shuffle.

    The verdict is one expression, so that pushing the filter to the scan cannot
    make the measures be taken more than once.
    """
    rejects = F.lit(mask(policy) | mask("base"))
    return docs.where(let(measures(F.col(text_col)), lambda m: fail_bits(m).bitwiseAND(rejects) == 0))


def ablation(book: DataFrame, policy: str = "v1") -> DataFrame:
    """For each rule of a policy: rows it fails, and rows only it rejects.

    Rows are first counted by bit pattern (at most 2^rules groups).
    """
    own = F.col("fail_bits").bitwiseAND(F.lit(mask(policy)))
    patterns = book.groupBy(own.alias("bits")).agg(F.count(F.lit(1)).alias("n"))
    rules = F.explode(F.array(*[F.struct(F.lit(r).alias("rule"), F.lit(bit(r)).cast("long").alias("bit")) for r in POLICIES[policy]])).alias("r")
    each = patterns.select("bits", "n", rules)
    fails = F.col("bits").bitwiseAND(F.col("r.bit")) != 0
    return each.groupBy(F.col("r.rule").alias("rule")).agg(
        F.coalesce(F.sum(F.when(fails, F.col("n"))), F.lit(0)).alias("n_failed"),
        F.coalesce(F.sum(F.when(F.col("bits") == F.col("r.bit"), F.col("n"))), F.lit(0)).alias("n_failed_alone"),
    )
