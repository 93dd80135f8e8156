"""Chat formatting: a role state machine and a declarative template.

``format_chats`` turns rows (conversation, turn, role, text) into one row per
conversation with text segments, a loss flag on each segment, and the verdict of
a finite-state machine over the roles.  Control strings of the template that
occur inside a text or a role name are escaped, and ``read_chats`` recovers every
turn from the formatted string alone.

Everything is built-in expressions: one hash aggregate with map-side combine by
conversation, then higher-order functions inside the row.

Defined results
* Order: by turn (null first), then role, then text.  Repeated rows are kept.
* Null or empty text: an empty turn.  Null role: the role with the empty name.
* A role the template does not know is written between the marks of ``other``.
* Null conversation id: those rows are one conversation of their own.
* A turn order that the machine rejects keeps all its text; ``valid`` is false
  and ``error_turn`` is the position (from 0) of the first turn it refuses, or
  the number of turns when only the end is refused.
* Empty table: no rows.  Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Marks around each turn, roles under loss, and the machine's transitions.
TEMPLATE = {
    "turns": {
        "system": {"open": "<<SYS>>", "close": "<</SYS>>", "loss": False},
        "user": {"open": "[INST]", "close": "[/INST]", "loss": False},
        "assistant": {"open": "<s>", "close": "</s>", "loss": True},
    },
    "other": {"open": "[ROLE]", "name_end": "[TEXT]", "close": "[/ROLE]"},
    "start": "start",
    "next": {
        "start": ["system", "user"],
        "system": ["user"],
        "user": ["assistant"],
        "assistant": ["user"],
    },
    "final": ["user", "assistant"],
}
ESCAPE = "\\"


def control_strings(template: dict) -> list[str]:
    marks = [m for t in template["turns"].values() for m in (t["open"], t["close"])]
    return marks + [template["other"][k] for k in ("open", "name_end", "close")]


def check_template(template: dict) -> None:
    """Raises ValueError for marks that could not be told apart or escaped.

    A mark has two characters or more and no escape sign, and does not occur inside
    another; only then is every formatted conversation read back as it was.
    """
    marks = control_strings(template)
    for i, mark in enumerate(marks):
        if len(mark) < 2 or ESCAPE in mark:
            raise ValueError(f"template: mark {mark!r} needs two characters and no {ESCAPE!r}")
        if any(mark in other for j, other in enumerate(marks) if j != i):
            raise ValueError(f"template: mark {mark!r} occurs in another mark")
    if missing := {r for roles in template["next"].values() for r in roles} - set(template["turns"]):
        raise ValueError(f"template: no marks for the roles {sorted(missing)}")


def _after_first(template: dict) -> dict[str, str]:
    """Alternation of the rests of the control strings by their first character."""
    rests: dict[str, list[str]] = {}
    for mark in control_strings(template):
        rests.setdefault(mark[0], []).append(re.escape(mark[1:]))
    return {first: "|".join(sorted(set(r))) for first, r in rests.items()}


def escape(text: Column, template: dict = TEMPLATE) -> Column:
    """Put one more escape sign after the first character of each control string.

    A control string with k escape signs in that place gets k + 1, so the map is
    one to one, and no control string is left.
    """
    pattern = "|".join(f"(?<={re.escape(c)})(?=\\\\*(?:{rest}))" for c, rest in _after_first(template).items())
    return F.regexp_replace(text, pattern, r"\\")


def unescape(text: Column, template: dict = TEMPLATE) -> Column:
    pattern = "|".join(f"(?<={re.escape(c)})\\\\(?=\\\\*(?:{rest}))" for c, rest in _after_first(template).items())
    return F.regexp_replace(text, pattern, "")


def _by_role(role: Column, values: dict, default: Column) -> Column:
    out = None
    for name, value in values.items():
        out = F.when(role == name, value) if out is None else out.when(role == name, value)
    return out.otherwise(default)


def _verdict(turns: Column, template: dict) -> Column:
    """Fold the machine over the roles: struct(state, at, bad)."""
    steps = [(s, r) for s, roles in template["next"].items() for r in roles]

    def step(acc, turn):
        allowed = F.lit(False)
        for state, role in steps:
            allowed = allowed | ((acc["state"] == state) & (turn["role"] == role))
        bad = F.when(acc["bad"] >= 0, acc["bad"]).when(allowed, F.lit(-1)).otherwise(acc["at"])
        return F.struct(turn["role"].alias("state"), (acc["at"] + 1).alias("at"), bad.alias("bad"))

    def end(acc):
        ends_well = acc["state"].isin(template["final"])
        return F.when((acc["bad"] < 0) & ~ends_well, acc["at"]).when(acc["bad"] >= 0, acc["bad"])

    zero = F.struct(F.lit(template["start"]).alias("state"), F.lit(0).alias("at"), F.lit(-1).alias("bad"))
    return F.aggregate(turns, zero, step, end)


def format_chats(
    rows: DataFrame,
    template: dict = TEMPLATE,
    conv_col: str = "conv_id",
    turn_col: str = "turn",
    role_col: str = "role",
    text_col: str = "text",
) -> DataFrame:
    """conv_id, n_turns, valid, error_turn, segments array<struct<text, loss>>, formatted."""
    check_template(template)
    turn = F.struct(
        F.col(turn_col).alias("turn"),
        F.coalesce(F.col(role_col), F.lit("")).alias("role"),
        F.coalesce(F.col(text_col), F.lit("")).alias("text"),
    )
    grouped = rows.select(F.col(conv_col).alias("conv_id"), turn.alias("t")).groupBy("conv_id")
    turns = grouped.agg(F.sort_array(F.collect_list("t")).alias("turns"))
    known, other = template["turns"], template["other"]

    def segment(text, loss):
        return F.struct(text.alias("text"), loss.alias("loss"))

    def segments(t):
        opened = F.concat(F.lit(other["open"]), escape(t["role"], template), F.lit(other["name_end"]))
        loss = _by_role(t["role"], {r: F.lit(m["loss"]) for r, m in known.items()}, F.lit(False))
        return F.array(
            segment(_by_role(t["role"], {r: F.lit(m["open"]) for r, m in known.items()}, opened), F.lit(False)),
            segment(escape(t["text"], template), loss),
            segment(_by_role(t["role"], {r: F.lit(m["close"]) for r, m in known.items()}, F.lit(other["close"])), F.lit(False)),
        )

    return turns.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        _verdict(F.col("turns"), template).alias("error_turn"),
        F.flatten(F.transform("turns", segments)).alias("segments"),
    ).select(
        "conv_id",
        "n_turns",
        F.col("error_turn").isNull().alias("valid"),
        "error_turn",
        "segments",
        F.array_join(F.transform("segments", lambda s: s["text"]), "").alias("formatted"),
    )


def read_turns(formatted: Column, template: dict = TEMPLATE) -> Column:
    """array<struct<role, text>> recovered from a formatted conversation."""
    known, other = template["turns"], template["other"]
    pairs = [(m["open"], m["close"]) for m in known.values()] + [(other["open"], other["close"])]
    pattern = "(?s)" + "|".join(f"{re.escape(a)}.*?{re.escape(b)}" for a, b in pairs)

    def inner(piece, start, end):
        return F.substring(piece, F.lit(len(start) + 1), F.length(piece) - len(start) - len(end))

    def turn(piece):
        body = inner(piece, other["open"], other["close"])
        role, text = F.substring_index(body, other["name_end"], 1), None
        text = F.substring(body, F.length(role) + len(other["name_end"]) + 1, F.length(body))
        roles, texts = unescape(role, template), unescape(text, template)
        for name, m in known.items():
            starts = piece.startswith(m["open"])
            roles = F.when(starts, F.lit(name)).otherwise(roles)
            texts = F.when(starts, unescape(inner(piece, m["open"], m["close"]), template)).otherwise(texts)
        return F.struct(roles.alias("role"), texts.alias("text"))

    return F.transform(F.regexp_extract_all(formatted, F.lit(pattern), F.lit(0)), turn)


def loss_text(segments: Column, template: dict = TEMPLATE) -> Column:
    """All text under the loss mask, unescaped, in order, nothing between."""
    under = F.filter(segments, lambda s: s["loss"])
    return F.array_join(F.transform(under, lambda s: unescape(s["text"], template)), "")


def chat_digests(chats: DataFrame, template: dict = TEMPLATE) -> DataFrame:
    """The digest columns of formatted conversations, read back from the output."""
    nl = F.lit("\n")
    back = chats.select("conv_id", read_turns(F.col("formatted"), template).alias("back"), loss_text(F.col("segments"), template).alias("loss"), F.length("formatted").cast("long").alias("formatted_chars"), "valid", "error_turn")
    said = F.array_join(F.transform("back", lambda t: F.concat(t["role"], nl, t["text"], nl)), "")
    return back.select(
        "conv_id",
        F.size("back").cast("long").alias("n_turns"),
        F.sha2(said.cast("binary"), 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2(F.col("loss").cast("binary"), 256).alias("loss_sha256"),
        "formatted_chars",
        "valid",
        "error_turn",
    )
