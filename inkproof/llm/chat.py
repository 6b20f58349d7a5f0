"""Chat formatting: each conversation as one marked training text with a loss mask, by Spark's array functions alone.

Turns are collected as structs and sorted; runs of adjacent turns of one role are merged into one
turn of several texts; the text is joined from segments, each of which tells whether it is learnt
from. A merged turn is a role between ``role_open`` and ``role_close``, then each text, ended by ``end``:

    <s>[INST]user[/INST]a question</s>[INST]assistant[/INST]an answer</s>one more</s>

A control string inside a text or a role gets a backslash after its first character, one more than
it has there already, so that no text can mark a turn and :func:`read_back` gives each text as it was.

Null texts and roles are empty ones. Turns of the same number are ordered by role, then text (nulls
first), repeated rows stay; turns without a number come first. Rows without a conversation's id are
one conversation. An empty table gives no rows. Only the named columns are read. A conversation is
one text, which a task holds whole.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, fields

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.shape import settled


@dataclass(frozen=True)
class Template:
    """The control strings. No control's first character may occur in the rest of any, nor a backslash in one."""

    begin: str = "<s>"
    role_open: str = "[INST]"
    role_close: str = "[/INST]"
    end: str = "</s>"

    def controls(self) -> list[str]:
        return [getattr(self, f.name) for f in fields(self)]

    def __post_init__(self) -> None:
        firsts, rests = {c[:1] for c in self.controls()}, "".join(c[1:] for c in self.controls())
        if any(len(c) < 2 for c in self.controls()) or len(set(self.controls())) < 4 or "\\" in firsts or set(rests) & (firsts | {"\\"}):
            raise ValueError("control strings must differ, have two characters or more, no backslash, and no control's first character after the first")

    def places(self) -> list[tuple[str, str]]:
        """For each first character, quoted: what can follow it in a control string, as a pattern."""
        tails: dict[str, list[str]] = {}
        for c in self.controls():
            tails.setdefault(c[0], []).append(re.escape(c[1:]))
        return [(re.escape(first), "|".join(rest)) for first, rest in tails.items()]


def escape(text: Column, template: Template = Template()) -> Column:
    places = "|".join(rf"(?<={first})(?=\\*(?:{rest}))" for first, rest in template.places())
    return F.regexp_replace(text, places, r"\\")


def unescape(text: Column, template: Template = Template()) -> Column:
    places = "|".join(rf"(?<={first})\\(?=\\*(?:{rest}))" for first, rest in template.places())
    return F.regexp_replace(text, places, "")


def merged(rows: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """``id, runs``: for each conversation its turns, adjacent ones of a role merged: ``role`` and ``texts``."""
    turn = F.struct(F.col(turn_col).alias("turn"), F.coalesce(F.col(role_col).cast("string"), F.lit("")).alias("role"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    out = rows.select(F.col(conv_col).alias("id"), turn.alias("t")).groupBy("id").agg(F.array_sort(F.collect_list("t")).alias("turns"))
    turns = F.col("turns")
    out = settled(out, "turns").select("id", "turns", F.filter(F.sequence(F.lit(0), F.size(turns) - 1), lambda i: (i == 0) | (turns[i]["role"] != F.get(turns, i - 1)["role"])).alias("starts"))
    starts = F.col("starts")

    def run(first: Column, k: Column) -> Column:
        length = F.coalesce(F.get(starts, k + 1), F.size(turns)) - first
        return F.struct(turns[first]["role"].alias("role"), F.transform(F.slice(turns, first + 1, length), lambda t: t["text"]).alias("texts"))

    return settled(out, "turns", "starts").select("id", F.transform(starts, run).alias("runs"))


def format_chats(rows: DataFrame, template: Template = Template(), learn: tuple[str, ...] = ("assistant",), conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """``id, formatted, segments``: the text, and the loss mask as its consecutive segments (``text, learn``).

    Texts of the roles in ``learn`` are learnt from; control strings and other turns aren't.
    """
    segment = lambda text, learnt: F.struct(text.alias("text"), learnt.alias("learn"))
    no = F.lit(False)

    def marked(run: Column) -> Column:
        head = segment(F.concat(F.lit(template.role_open), escape(run["role"], template), F.lit(template.role_close)), no)
        learnt = run["role"].isin(*learn)
        texts = F.transform(run["texts"], lambda t: F.array(segment(escape(t, template), learnt), segment(F.lit(template.end), no)))
        return F.concat(F.array(head), F.flatten(texts))

    begin = F.array(segment(F.lit(template.begin), no))
    out = settled(merged(rows, conv_col, turn_col, role_col, text_col), "runs")
    out = settled(out.select("id", F.concat(begin, F.flatten(F.transform("runs", marked))).alias("segments")), "segments")
    return out.select("id", F.array_join(F.transform("segments", lambda s: s["text"]), "").alias("formatted"), "segments")


def read_back(formatted: Column, template: Template = Template()) -> Column:
    """The turns of a formatted text as they were before it: an array of ``role, text``, one for each row."""
    quoted = lambda c: re.escape(c)
    parts = F.split(F.substr(formatted, F.lit(len(template.begin) + 1)), quoted(template.role_open))

    def turns(part: Column) -> Column:
        role = unescape(F.substring_index(part, template.role_close, 1), template)
        texts = F.split(F.substring_index(part, template.role_close, -1), quoted(template.end))
        return F.transform(F.slice(texts, 1, F.size(texts) - 1), lambda t: F.struct(role.alias("role"), unescape(t, template).alias("text")))

    return F.flatten(F.transform(F.slice(parts, 2, F.size(parts)), turns))


def learnt(segments: Column, template: Template = Template()) -> Column:
    """All text under the loss mask, as it was before formatting."""
    return F.array_join(F.transform(F.filter(segments, lambda s: s["learn"]), lambda s: unescape(s["text"], template)), "")
