"""Secret scans: base patterns, and character Markov models of random strings.

*Base spans* come from three patterns, matched leftmost and without overlap per
kind; matches that are too short are dropped.

*Markov spans* are runs of key characters that look drawn at random.  Two first-order
Markov models over characters, one of random strings and one of ordinary identifiers,
give each run a log-likelihood ratio, summed over its characters and their
transitions from one to the next.  A run is a span where the ratio is above the log of
the odds against a random run (``ODDS``) and its mean above ``LEAST_MEAN``; a run
that ends where a base span ends is that span's own value and is not added again.

The models are trained from labelled samples (``labelled_samples``):

* ordinary: every distinct run of ``LEAST_TRAIN`` characters or more in the texts of the
  corpus that is not in a base span and too short to be judged itself, as it is, in upper case, as constants are
  written, and in one of the ways that names, paths, rulers and settings are put together
  of words (``JOINS``), so that those are ordinary in a corpus of prose too.  Distinct runs are found by an aggregate
  with a map-side combine, so a run, however frequent, costs one row a task, and what is
  counted grows with the corpus;
* random: the values of the access and hex spans of the corpus, and strings made from
  hashes in the alphabets that keys come in (``MADE`` ids, six forms each).

Counts are smoothed towards the single-character shares.  A model has at most
(|alphabet| + 1) * |alphabet| ratios whatever the corpus, and is a literal in the plan:
scoring is one pass over the texts, inside the row, with no shuffle.

All steps are built-in functions.  Positions come from the lengths of the matches
and of the pieces between them, whose running sums are taken in blocks of about the
square root of their number, so a text with very many matches stays cheap.

Defined results
* Null text: empty; no spans.  Null ids and repeated rows are rows like any other.
* Spans are code points, end exclusive, of the whole match.
* Without any sample of one kind, its shares are equal for all characters.
* Empty table: no rows.  Other columns are ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wattline.llm.text import let

#: The base patterns with the least length of the checked group.
ASSIGN = r"([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
BASE: dict[str, tuple[str, int, int]] = {
    "assign": (ASSIGN, 2, 6),
    "access": (r"AKIA[A-Z0-9]{16,}", 0, 20),
    "hex": (r"[0-9a-f]{24,}", 0, 24),
}
KINDS = (*BASE, "markov")
#: Characters of runs; a model's states are these and the start of a run.
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_.=-"
RUN = "[A-Za-z0-9+/_.=-]"
LEAST_TRAIN, LEAST_RUN = 4, 20
#: Ids that random strings are made of; a bound on what is learnt from made samples.
MADE = 4000
#: A run must be this many times likelier random than ordinary, and so by this much a character.
ODDS, LEAST_MEAN = 1e6, 1.0
#: Ordinary ways to put words together; ``{}`` is the word, ``{^}`` the word capitalised.
JOINS = ("{}_{}", "{}-{}", "/{}/{}.{}", "{}.{}={}", "{^}{^}", "{}--------", "{}========", "{}........")
#: Weight of the single-character shares in a row of transitions.
BACKOFF = 20.0


def running_sums(lengths: Column) -> Column:
    """Array of the sums of the first 0, 1, ... entries of an array of longs.

    A fold that appends copies what it has at each step; blocks of the square root
    of the size keep those copies short.
    """

    def fold(values, start):
        return F.aggregate(values, F.array(start), lambda acc, x: F.concat(acc, F.array(F.get(acc, F.size(acc) - 1) + x)))

    def total(values):
        return F.aggregate(values, F.lit(0).cast("long"), lambda acc, x: acc + x)

    def by_block(parts):
        offsets = fold(F.transform(parts, total), F.lit(0).cast("long"))
        each = F.zip_with(parts, offsets, lambda p, o: F.when(p.isNotNull(), F.slice(fold(p, o), 1, F.size(p))))
        return F.concat(F.flatten(F.array_compact(each)), F.slice(offsets, -1, 1))

    def blocks(values):
        width = F.greatest(F.lit(1), F.ceil(F.sqrt(F.size(values))).cast("int"))
        starts = F.sequence(F.lit(1), F.greatest(F.lit(1), F.size(values)), width)
        return F.transform(starts, lambda a: F.slice(values, a, width))

    return let(lengths, lambda v: let(blocks(v), by_block))


def matches(text: Column, pattern: str, group: int = 0) -> Column:
    """Array of (start, end, value) of the matches of a pattern, left to right.

    ``value`` is the given group.  Patterns that match the empty string are not supported.
    """
    pieces = F.transform(F.split(text, pattern), lambda x: F.length(x).cast("long"))
    whole = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    values = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else whole

    def place(found):
        gaps = F.zip_with(pieces, found, lambda p, m: F.coalesce(p, F.lit(0).cast("long")) + F.coalesce(F.length(m), F.lit(0)))
        ends = F.slice(running_sums(gaps), 2, F.size(found))
        placed = F.zip_with(ends, found, lambda e, m: F.struct((e - F.length(m)).alias("start"), e.alias("end")))
        return F.zip_with(placed, values, lambda s, v: F.struct(s["start"].alias("start"), s["end"].alias("end"), v.alias("value")))

    return F.when(text.rlike(pattern), let(whole, place))


def _as_spans(found: Column, kind: int) -> Column:
    """Array of (start, kind, end, value); empty for null."""
    spans = F.transform(found, lambda m: F.struct(m["start"].alias("start"), F.lit(kind).alias("kind"), m["end"].alias("end"), m["value"].alias("value")))
    return F.coalesce(spans, F.array().cast("array<struct<start:bigint,kind:int,end:bigint,value:string>>"))


def base_spans(text: Column) -> Column:
    """Array of (start, kind as a number, end, value), in the order of kinds."""

    def of_kind(i, pattern, group, least):
        return _as_spans(F.filter(matches(text, pattern, group), lambda m: F.length(m["value"]) >= least), i)

    return F.concat(*[of_kind(i, *rule) for i, rule in enumerate(BASE.values())])


def made_strings(spark, n: int = MADE) -> DataFrame:
    """Random strings in the alphabets of keys, from hashes of 0 to n - 1."""
    raw = F.base64(F.unhex(F.sha2(F.concat(F.lit("key:"), F.col("id").cast("string")).cast("binary"), 256)))
    plain = F.translate(raw, "+/=", "")
    forms = F.array(raw, plain, F.upper(plain), F.lower(plain), F.translate(raw, "+/=", "-_"), F.substring(F.sha2(F.concat(F.lit("hex:"), F.col("id").cast("string")).cast("binary"), 256), 1, 40))
    return spark.range(n).select(F.explode(forms).alias("value"))


def labelled_samples(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """(value, random): distinct strings with their label, from all of ``docs``."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    # The values of base spans are cut out, so that no part of them counts as ordinary.
    rest = text
    for pattern, _, _ in BASE.values():
        rest = F.regexp_replace(rest, pattern, " ")
    runs = F.regexp_extract_all(rest, F.lit(f"{RUN}{{{LEAST_TRAIN},}}"), F.lit(0))
    short = F.filter(F.array_distinct(runs), lambda r: F.length(r) < LEAST_RUN)
    ordinary = docs.select(F.explode(short).alias("value")).distinct()
    keys = F.array_distinct(F.concat(*[F.regexp_extract_all(text, F.lit(BASE[k][0]), F.lit(0)) for k in ("access", "hex")]))
    random = docs.select(F.explode(keys).alias("value")).union(made_strings(docs.sparkSession)).distinct()
    return ordinary.select("value", F.lit(False).alias("random")).union(random.select("value", F.lit(True).alias("random")))


def joined(word: Column) -> Column:
    """The word in the one of ``JOINS`` that its length and first character choose."""
    which = (F.length(word) + F.ascii(word)) % len(JOINS)
    capital = F.concat(F.upper(F.substring(word, 1, 1)), F.substr(word, F.lit(2)))
    return F.replace(F.replace(F.get(F.array(*[F.lit(j) for j in JOINS]), which), F.lit("{^}"), capital), F.lit("{}"), word)


def train(samples: DataFrame) -> DataFrame:
    """(at, ratio) for every transition: log of random over ordinary probability.

    ``at`` is (state before) * |alphabet| + (character), both as places in the alphabet,
    with |alphabet| for the start of a run.
    """
    k = len(ALPHABET)
    chars = F.transform(F.split("value", ""), lambda c: F.instr(F.lit(ALPHABET), c) - 1)
    steps = F.zip_with(F.concat(F.array(F.lit(k)), chars), F.concat(chars, F.array(F.lit(None).cast("int"))), lambda a, b: a * k + b)
    forms = F.when(F.col("random"), F.array("value")).otherwise(F.array_distinct(F.array("value", F.upper("value"), joined(F.col("value")))))
    forms = samples.select("random", F.explode(forms).alias("value"))
    counted = forms.select("random", F.explode(F.array_compact(steps)).alias("at")).groupBy("random", "at").agg(F.count(F.lit(1)).alias("n"))
    grid = samples.sparkSession.range(2 * (k + 1) * k).select((F.col("id") % 2 == 1).alias("random"), F.floor(F.col("id") / 2).cast("int").alias("at"))
    full = grid.join(F.broadcast(counted), ["random", "at"], "left").select("random", "at", F.coalesce("n", F.lit(0)).alias("n"), F.floor(F.col("at") / k).alias("a"), (F.col("at") % k).alias("b"))
    # At most 2 * (|alphabet| + 1) * |alphabet| rows from here on.
    row, column, every = Window.partitionBy("random", "a"), Window.partitionBy("random", "b"), Window.partitionBy("random")
    share = (F.sum("n").over(column) + 1) / (F.sum("n").over(every) + k)
    logs = full.select("random", "at", F.log((F.col("n") + BACKOFF * share) / (F.sum("n").over(row) + BACKOFF)).alias("log"))
    return logs.groupBy("at").agg(F.sum(F.when(F.col("random"), F.col("log")).otherwise(-F.col("log"))).alias("ratio"))


def ratio_table(model: DataFrame) -> list[float]:
    """The model's ratios by ``at``; their number is fixed by the alphabet."""
    ratios = {r["at"]: r["ratio"] for r in model.collect()}
    return [ratios[i] for i in range((len(ALPHABET) + 1) * len(ALPHABET))]


def log_ratio(run: Column, table: list[float]) -> Column:
    """Sum of the ratios along a run of alphabet characters."""
    k = len(ALPHABET)
    ratios = F.split(F.lit(",".join(map(repr, table))), ",").cast("array<double>")
    zero = F.struct(F.lit(k).alias("state"), F.lit(0.0).alias("sum"))

    def step(acc, c):
        return let(F.instr(F.lit(ALPHABET), c) - 1, lambda i: F.struct(i.alias("state"), (acc["sum"] + F.get(ratios, acc["state"] * k + i)).alias("sum")))

    return F.aggregate(F.split(run, ""), zero, step, lambda acc: acc["sum"])


def markov_spans(text: Column, table: list[float]) -> Column:
    """Array of (start, kind, end, value) of the runs that look random."""
    runs = matches(text, f"{RUN}{{{LEAST_RUN},}}")
    floor = F.lit(float(ODDS))

    def looks_random(m):
        return let(log_ratio(m["value"], table), lambda r: (r > F.log(floor)) & (r > LEAST_MEAN * F.length(m["value"])))

    return _as_spans(F.filter(runs, looks_random), len(BASE))


def _new_only(spans: Column) -> Column:
    """Without markov spans that end where a base span ends; in linear time after a sort."""

    def by_end(s):
        return F.sort_array(F.transform(s, lambda m: F.struct(m["end"].alias("end"), m["kind"].alias("kind"), m["start"].alias("start"), m["value"].alias("value"))))

    def keep(s):
        return F.filter(s, lambda m, i: (m["kind"] < len(BASE)) | ~F.coalesce(F.get(s, i - 1)["end"] == m["end"], F.lit(False)))

    return let(by_end(spans), keep)


def find_secrets(docs: DataFrame, table: list[float], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """All columns of ``docs`` and ``secrets``: array of (start, kind, end, value), by start and kind."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    spans = let(text, lambda t: F.concat(base_spans(t), markov_spans(t, table)))
    names = F.array(*[F.lit(k) for k in KINDS])
    ordered = F.sort_array(F.transform(_new_only(spans), lambda m: F.struct(m["start"].alias("start"), m["kind"].alias("kind"), m["end"].alias("end"), m["value"].alias("value"))))
    named = F.transform(ordered, lambda m: F.struct(F.get(names, m["kind"]).alias("kind"), m["start"].alias("start"), m["end"].alias("end"), m["value"].alias("value")))
    return docs.select(*[docs[c] for c in docs.columns if c.lower() != "secrets"], named.alias("secrets"))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans of every document."""
    table = ratio_table(train(labelled_samples(docs, text_col)))
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    found = find_secrets(rows, table).select("doc_id", "secrets")

    def joined(spans):
        return F.array_join(F.transform(spans, lambda m: F.concat_ws(":", m["kind"], m["start"], m["end"])), ",")

    base = F.filter("secrets", lambda m: m["kind"] != "markov")

    def count(kind):
        return F.size(F.filter("secrets", lambda m: m["kind"] == kind)).cast("long").alias(f"n_{kind}")

    counts = [count(kind) for kind in KINDS]
    return found.select("doc_id", *counts, F.sha2(joined(base).cast("binary"), 256).alias("base_sha256"), joined(F.col("secrets")).alias("spans"))
