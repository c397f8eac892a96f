"""Chat formatting: a finite-state machine over roles and a declarative template, as DataFrame expressions.

The template names a mark for each role's opening and closing.  Texts may hold anything, marks too: the ESCAPE character in a text
is followed by a letter, and every control string of the template is broken behind its first character by the ESCAPE character and
another letter.  So a control string only stands where the formatter put it, and unescaping is exact.  A turn gives
three segments (opening, text, closing), each with a loss flag; the mask covers the text of roles listed in ``loss``.

Work on texts happens row by row before conversations are gathered; a conversation is one output row, so its
turns meet once, already escaped, in one aggregate.  Turn order: ascending turn, then role, then text, nulls first.

The machine reads roles in order from START by TRANSITIONS; a missing step is an error, and ``valid`` says whether all
steps exist and the last state is accepted.  Invalid conversations are formatted all the same.

Null texts and null roles are empty; an unknown role is written with the generic marks, its name escaped;
null ids form a conversation of their own; repeated rows are turns of their own; extra columns are ignored; an
empty table gives an empty result.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The declarative template.  In texts the escape character is always followed by one of the three letters: its own, the
#: break's within a control string, or that of the character which ends a generic role's name.
TEMPLATE = {
    "escape": "\u001b",
    "escaped": "e",
    "broken": "x",
    "ended": "g",
    "open": {"system": "<<SYS>>", "user": "[INST]", "assistant": "<s>"},
    "close": {"system": "<</SYS>>", "user": "[/INST]", "assistant": "</s>"},
    "generic_open": ("<role ", ">"),
    "generic_close": "</role>",
    "loss": ("assistant",),
}
#: state -> role -> state
TRANSITIONS = {
    "start": {"system": "told", "user": "asked"},
    "told": {"user": "asked"},
    "asked": {"assistant": "answered"},
    "answered": {"user": "asked"},
}
START, ACCEPTED = "start", ("asked", "answered")


def _plain_replace(text: Column, old: str, new: str) -> Column:
    return F.replace(text, F.lit(old), F.lit(new))


def controls(t=TEMPLATE) -> list[str]:
    """All that a text must not hold as it is."""
    return [*t["open"].values(), *t["close"].values(), t["generic_open"][0], t["generic_close"]]


def escape(text: Column, t=TEMPLATE) -> Column:
    out = _plain_replace(text, t["escape"], t["escape"] + t["escaped"])
    for c in controls(t):
        out = _plain_replace(out, c, c[0] + t["escape"] + t["broken"] + c[1:])
    return out


def unescape(text: Column, t=TEMPLATE) -> Column:
    out = _plain_replace(text, t["escape"] + t["broken"], "")
    out = _plain_replace(out, t["escape"] + t["ended"], t["generic_open"][1])
    return _plain_replace(out, t["escape"] + t["escaped"], t["escape"])


def marks(role: Column, t=TEMPLATE) -> tuple[Column, Column]:
    before, after = t["generic_open"]
    opened = F.concat(F.lit(before), _plain_replace(escape(role, t), after, t["escape"] + t["ended"]), F.lit(after))
    closed = F.lit(t["generic_close"])
    for name in t["open"]:
        opened = F.when(role == name, F.lit(t["open"][name])).otherwise(opened)
        closed = F.when(role == name, F.lit(t["close"][name])).otherwise(closed)
    return opened, closed


def state_after(roles: Column) -> Column:
    """The machine's last state; 'error' once a step is missing."""
    table = {f"{s}>{r}": to for s, step in TRANSITIONS.items() for r, to in step.items()}
    steps = F.create_map(*(F.lit(x) for kv in table.items() for x in kv))
    return F.aggregate(roles, F.lit(START), lambda s, r: F.coalesce(F.try_element_at(steps, F.concat(s, F.lit(">"), r)), F.lit("error")))


def formatted(conversations: DataFrame, t=TEMPLATE) -> DataFrame:
    """conv_id, segments (text, loss), formatted, valid of every conversation."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    opened, closed = marks(role, t)
    turn = F.struct(
        F.col("turn"), role.alias("role"), escape(text, t).alias("text"), opened.alias("opened"), closed.alias("closed"), role.isin(*t["loss"]).alias("loss")
    )
    gathered = conversations.select("conv_id", turn.alias("x")).groupBy("conv_id").agg(F.array_sort(F.collect_list("x")).alias("turns"))

    def segment(value: Column, loss: Column) -> Column:
        return F.struct(value.alias("text"), loss.alias("loss"))

    no = F.lit(False)
    segments = F.flatten(F.transform("turns", lambda x: F.array(segment(x.opened, no), segment(x.text, x.loss), segment(x.closed, no))))
    out = gathered.select("conv_id", segments.alias("segments"), state_after(F.transform("turns", lambda x: x.role)).alias("state"))
    return out.select(
        "conv_id", "segments", F.array_join(F.transform("segments", lambda s: s.text), "").alias("formatted"), F.col("state").isin(*ACCEPTED).alias("valid")
    )


def loss_spans(segments: Column) -> Column:
    """(start, length) in code points, from 0, of the segments under the mask."""
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,length:int>>").alias("spans"))

    def step(a: Column, s: Column) -> Column:
        n = F.char_length(s.text)
        here = F.array(F.struct(a.at.alias("start"), n.alias("length")))
        return F.struct((a.at + n).alias("at"), F.when(s.loss, F.concat(a.spans, here)).otherwise(a.spans).alias("spans"))

    return F.aggregate(segments, start, step).spans


def read_back(formatted_text: Column, t=TEMPLATE) -> Column:
    """Turns (role, text) from a formatted string alone: it is cut before opening marks, which no text can hold."""
    before, after = t["generic_open"]
    quoted = "|".join(re.sub(r"([^\w ])", r"\\\1", m) for m in [*t["open"].values(), before])
    pieces = F.filter(F.split(formatted_text, f"(?={quoted})"), lambda p: p != "")

    def between(piece: Column, mark: Column, closing: str) -> Column:
        return unescape(F.substring(piece, mark + 1, F.char_length(piece) - mark - len(closing)), t)

    def turn(piece: Column) -> Column:
        named = F.instr(piece, after)  # where the generic mark ends: a role's name has no such character
        role = unescape(F.substring(piece, F.lit(len(before) + 1), named - len(before) - 1), t)
        out = F.struct(role.alias("role"), between(piece, named, t["generic_close"]).alias("text"))
        for role, mark in t["open"].items():
            own = F.struct(F.lit(role).alias("role"), between(piece, F.lit(len(mark)), t["close"][role]).alias("text"))
            out = F.when(F.startswith(piece, F.lit(mark)), own).otherwise(out)
        return out

    return F.transform(pieces, turn)


def digest(out: DataFrame, t=TEMPLATE) -> DataFrame:
    """Counts and digests read back from formatted()'s output: turns from the string, the loss from the string under the mask."""
    read = out.select("conv_id", "formatted", "valid", loss_spans(F.col("segments")).alias("spans"), read_back(F.col("formatted"), t).alias("turns"))
    said = F.array_join(F.transform("turns", lambda x: F.concat(x.role, F.lit("\n"), x.text, F.lit("\n"))), "")
    masked = unescape(F.array_join(F.transform("spans", lambda s: F.substring(F.col("formatted"), s.start + 1, s.length)), ""), t)
    read = read.select("conv_id", "formatted", "valid", F.size("turns").cast("bigint").alias("n_turns"), said.alias("said"), masked.alias("masked"))
    return read.select(
        "conv_id",
        "n_turns",
        F.sha2("said", 256).alias("turns_sha256"),
        F.char_length("masked").cast("bigint").alias("loss_chars"),
        F.sha2("masked", 256).alias("loss_sha256"),
        F.char_length("formatted").cast("bigint").alias("formatted_chars"),
        "valid",
    )
