"""Fill-in-middle transformation of documents.

A text is cut into units by a pattern, left to right; two seeded draws choose where
the prefix and the middle end, and the parts are written in one of two orders:

* psm: <P> prefix <S> suffix <M> middle
* spm: <S> suffix <P> prefix <M> middle
* plain: the text as it is

An Arrow-batched pandas UDF does this row by row: ``finditer`` of the regex library
puts the end of each unit into a compact array (four bytes a unit), two lookups in
it slice the text, and hashlib gives the seeds and the digests.  No mark can start
inside the text and end in a mark that was put in, since a mark begins with a
character that no mark ends with or holds inside; so a text without marks is read
back exactly from its output and form.

The draws depend on the seed and the document id alone, so a rerun on other
machines, or of a lost task, writes the same output.  There is no shuffle, and
memory is one Arrow batch (bounded by bytes) and the unit ends of one text.

Defined results
* Null text: empty.  Empty texts, and texts that hold a mark, stay plain.
* Characters that the unit pattern leaves out belong to the unit after them, or to
  the suffix after the last unit; no character is lost.
* A null id is drawn as the word null.  Repeated rows get equal rows.
* prefix_chars and middle_chars are null where the form is plain.
* Empty table: no rows.  Other columns are kept, whatever their names; columns with
  the names of the results are replaced.
"""

from __future__ import annotations

import hashlib
from array import array
from dataclasses import dataclass

import pandas as pd
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wattline.llm.text import free, small_batches

#: One code point, line breaks included.
CODE_POINT = r"(?s)."
WORD_UNIT = r"[^\x20\x09-\x0D]+[\x20\x09-\x0D]*"


@dataclass(frozen=True)
class Plan:
    """What to cut, the marks, and how often (percent) a text is cut and put in spm order."""

    unit: str = CODE_POINT
    seed: int = 1
    cut_percent: int = 90
    spm_percent: int = 20
    prefix: str = "<P>"
    suffix: str = "<S>"
    middle: str = "<M>"

    def __post_init__(self):
        marks = (self.prefix, self.suffix, self.middle)
        if len(set(marks)) < 3 or not all(marks):
            raise ValueError("the three marks must differ and not be empty")
        if any(a != b and a in b for a in marks for b in marks):
            raise ValueError("no mark may hold another")
        if any(a[:i] == b[-i:] for a in marks for b in marks for i in range(1, min(len(a), len(b)) + (a != b))):
            raise ValueError("no mark may begin with what a mark ends with")


def draws(plan: Plan, doc_id) -> tuple[int, int, int, int]:
    """Four numbers of 32 bits from the seed and an id."""
    name = "null" if doc_id is None else str(doc_id)
    digest = hashlib.sha256(f"{plan.seed}:{name}".encode()).hexdigest()
    return tuple(int(digest[i : i + 8], 16) for i in (0, 8, 16, 24))


def unit_ends(pattern: regex.Pattern, text: str) -> array:
    """End of each unit, in code points, left to right."""
    return array("I" if len(text) < 1 << 32 else "Q", (m.end() for m in pattern.finditer(text)))


def cut(plan: Plan, pattern: regex.Pattern, doc_id, text: str) -> tuple[int, str, int | None, int | None, str]:
    """(units, form, characters of the prefix, of the middle, output)."""
    ends = unit_ends(pattern, text)
    n = len(ends)
    h1, h2, h3, h4 = draws(plan, doc_id)
    if not text or h3 % 100 >= plan.cut_percent or any(m in text for m in (plan.prefix, plan.suffix, plan.middle)):
        return n, "plain", None, None, text
    first, last = sorted((h1 % (n + 1), h2 % (n + 1)))
    a, b = ends[first - 1] if first else 0, ends[last - 1] if last else 0
    prefix, middle, suffix = text[:a], text[a:b], text[b:]
    if h4 % 100 < plan.spm_percent:
        return n, "spm", a, b - a, f"{plan.suffix}{suffix}{plan.prefix}{prefix}{plan.middle}{middle}"
    return n, "psm", a, b - a, f"{plan.prefix}{prefix}{plan.suffix}{suffix}{plan.middle}{middle}"


def restore(plan: Plan, output: str, form: str) -> str:
    """The text, from output and form alone."""
    if form == "plain":
        return output
    lead, inner = (plan.prefix, plan.suffix) if form == "psm" else (plan.suffix, plan.prefix)
    one, _, rest = output.removeprefix(lead).partition(inner)
    two, _, middle = rest.partition(plan.middle)
    prefix, suffix = (one, two) if form == "psm" else (two, one)
    return prefix + middle + suffix


def _sha256(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


_FIELDS = "n long, form string, prefix_chars long, middle_chars long, output_sha256 string, restored_sha256 string"


def _cutter(plan: Plan, with_output: bool):
    fields = _FIELDS + (", output string" if with_output else "")
    names = [f.split()[0] for f in fields.split(", ")]

    @F.pandas_udf(fields)
    def cut_batch(ids: pd.Series, texts: pd.Series) -> pd.DataFrame:
        pattern = regex.compile(plan.unit)
        rows = []
        for i, t in zip(ids, texts, strict=True):
            n, form, prefix, middle, output = cut(plan, pattern, i, t)
            back = restore(plan, output, form)
            row = (n, form, prefix, middle, _sha256(output), _sha256(back))
            rows.append((*row, output) if with_output else row)
        frame = pd.DataFrame(rows, columns=names)
        return frame.astype({"prefix_chars": "Int64", "middle_chars": "Int64"})

    return cut_batch


def fill_in_middle(docs: DataFrame, plan: Plan | None = None, id_col: str = "doc_id", text_col: str = "text", with_output: bool = True) -> DataFrame:
    """All columns of ``docs`` and n, form, prefix_chars, middle_chars, output_sha256,
    restored_sha256 and, unless switched off, output."""
    plan = plan or Plan()
    small_batches(docs.sparkSession)
    made = free("_fim", docs)
    cut_batch = _cutter(plan, with_output)
    out = docs.withColumn(made, cut_batch(F.col(id_col).cast("string"), F.coalesce(F.col(text_col), F.lit(""))))
    names = [f.split()[0] for f in _FIELDS.split(", ")] + ["output"] * with_output
    kept = [c for c in docs.columns if c.lower() not in names]
    return out.select(*kept, *[F.col(made)[x].alias(x) for x in names])


def restored(output: Column, form: Column, plan: Plan | None = None) -> Column:
    """``restore`` as a column of built-in functions."""
    plan = plan or Plan()

    def parts(lead: str, inner: str) -> tuple[Column, Column, Column]:
        rest = F.substr(output, F.lit(len(lead) + 1))
        one = F.substring_index(rest, inner, 1)
        after = F.substr(rest, F.length(one) + len(inner) + 1)
        two = F.substring_index(after, plan.middle, 1)
        return one, two, F.substr(after, F.length(two) + len(plan.middle) + 1)

    p, s, m = parts(plan.prefix, plan.suffix)
    s2, p2, m2 = parts(plan.suffix, plan.prefix)
    return F.when(form == "psm", F.concat(p, m, s)).when(form == "spm", F.concat(p2, m2, s2)).otherwise(output)
