"""Conversations as training text, driven by a declarative template.

A ``Template`` says how a turn of each role is written, which roles carry the loss, and
which role may follow which. A finite-state machine runs over the roles of a conversation:
its state is the last role, its transitions are the template's, and the first turn that has
none is reported. Every conversation is formatted, valid or not; the caller decides.

Output of a conversation is a list of segments (text, loss), whose concatenation is the
formatted text. Control strings of a template begin with ``<`` or ``#``; inside roles and
texts these two, the backslash and (for roles) the colon are written as ``\\l``, ``\\h``,
``\\b`` and ``\\c``, so nothing a user writes looks like a turn, and reading back restores
it exactly.

One shuffle brings the turns of a conversation together: the unit of the output is one
training text per conversation, so a conversation has to fit into a row, as a document
does; conversations themselves are spread by their id.

Defined cases: turns are ordered by turn, role and text, with missing values first;
repeated turns are formatted each; a missing text or role is an empty one; a role that the
template does not know is written without loss and makes the conversation invalid;
a turn without a conversation id is a conversation of its own; a very long conversation is
one row, as long as its texts; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

START = "<start>"


@dataclass(frozen=True)
class Template:
    """What opens a turn (before its role), stands between role and text and closes it;
    roles whose text carries the loss; and for each state the roles that may come next."""

    open: str = "<turn>### "
    middle: str = ": "
    close: str = "</turn>\n"
    loss: tuple[str, ...] = ("assistant",)
    follows: dict[str, tuple[str, ...]] = field(
        default_factory=lambda: {
            START: ("system", "user"),
            "system": ("user",),
            "user": ("assistant",),
            "assistant": ("user", "tool"),
            "tool": ("assistant", "tool"),
        }
    )


    def __post_init__(self) -> None:
        if self.open[:1] not in ("<", "#") or self.close[:1] not in ("<", "#") or self.middle[:1] != ":":
            raise ValueError("turns open and close with < or #, and a role ends with a colon")
        if self.open.startswith(self.close) or self.close.startswith(self.open):
            raise ValueError("a turn must not close as it opens")


DEFAULT = Template()


def escaped(text: Column) -> Column:
    """``text`` without the characters that begin a control string."""
    for plain, code in (("\\", "\\b"), ("<", "\\l"), ("#", "\\h")):
        text = F.replace(text, F.lit(plain), F.lit(code))
    return text


def unescaped(text: Column) -> Column:
    """Inverse of ``escaped``: every backslash begins a code, and its own code comes last."""
    for plain, code in (("<", "\\l"), ("#", "\\h"), (":", "\\c"), ("\\", "\\b")):
        text = F.replace(text, F.lit(code), F.lit(plain))
    return text


def _segments(role: Column, text: Column, template: Template) -> Column:
    head = F.concat(
        F.lit(template.open), F.replace(escaped(role), F.lit(":"), F.lit("\\c")), F.lit(template.middle)
    )

    def segment(value: Column, loss: Column) -> Column:
        return F.struct(value.alias("text"), loss.alias("loss"))

    return F.array(
        segment(head, F.lit(False)),
        segment(escaped(text), role.isin(*template.loss)),
        segment(F.lit(template.close), F.lit(False)),
    )


def _walk(turns: Column, template: Template) -> Column:
    """Number of the first turn (from 0) whose role may not stand there, or null.

    The state is the last role; once a turn is refused the machine stays where it is.
    """

    def allowed(state: Column, role: Column) -> Column:
        result = F.lit(False)
        for before, after in template.follows.items():
            result = F.when(state == before, role.isin(*after)).otherwise(result)
        return result

    def step(acc: Column, turn: Column) -> Column:
        ok = acc["bad"].isNull() & allowed(acc["state"], turn["role"])
        return F.struct(
            F.when(ok, turn["role"]).otherwise(acc["state"]).alias("state"),
            F.when(acc["bad"].isNull() & ~ok, acc["at"]).otherwise(acc["bad"]).alias("bad"),
            (acc["at"] + 1).alias("at"),
        )

    start = F.struct(
        F.lit(START).alias("state"), F.lit(None).cast("int").alias("bad"), F.lit(0).alias("at")
    )
    return F.aggregate(turns, start, step, lambda acc: acc["bad"])


def format_chats(
    turns: DataFrame,
    conv_col: str = "conv_id",
    turn_col: str = "turn",
    role_col: str = "role",
    text_col: str = "text",
    template: Template = DEFAULT,
) -> DataFrame:
    """One row per conversation: id, ``segments`` (text, loss), ``n_turns``, ``first_bad``
    (number of the first turn out of order, or null) and ``valid``."""
    rows = turns.select(
        F.col(conv_col).alias("conv"),
        F.struct(
            F.col(turn_col).alias("turn"),
            F.coalesce(F.col(role_col), F.lit("")).alias("role"),
            F.coalesce(F.col(text_col), F.lit("")).alias("text"),
        ).alias("item"),
    )
    # Turns without a conversation are not gathered: each has a number of its own.
    alone = F.when(F.col("conv").isNull(), F.monotonically_increasing_id()).alias("alone")
    chats = rows.select("*", alone).groupBy("conv", "alone").agg(F.array_sort(F.collect_list("item")).alias("items"))
    return chats.select(
        F.col("conv").alias(conv_col),
        F.flatten(F.transform("items", lambda t: _segments(t["role"], t["text"], template))).alias("segments"),
        F.size("items").cast("long").alias("n_turns"),
        _walk(F.col("items"), template).alias("first_bad"),
    ).withColumn("valid", F.col("first_bad").isNull())


def formatted(segments: Column) -> Column:
    return F.array_join(F.transform(segments, lambda s: s["text"]), "")


def loss_text(segments: Column) -> Column:
    """All text under the loss mask, as it was written by its authors."""
    return F.array_join(F.transform(F.filter(segments, lambda s: s["loss"]), lambda s: unescaped(s["text"])), "")


def parsed(text: Column, template: Template = DEFAULT) -> Column:
    """Turns (role, text) read back from a formatted text."""
    pieces = F.filter(F.split(text, re.escape(template.close)), lambda p: p != "")

    def turn(piece: Column) -> Column:
        body = F.substring(piece, F.lit(len(template.open) + 1), F.length(piece))
        role = F.substring_index(body, template.middle, 1)
        rest = F.substring(body, F.length(role) + len(template.middle) + 1, F.length(body))
        return F.struct(unescaped(role).alias("role"), unescaped(rest).alias("text"))

    return F.transform(pieces, turn)
