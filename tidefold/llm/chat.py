"""Chat formatting with Spark expressions only.

A conversation's rows are collected as (turn, role, text) structs, sorted, adjacent turns of one
role merged by an array aggregation, and written as

    <|im_start|>ROLE\\nTEXT<|im_end|>\\n

with ``<|im_next|>`` between the texts of merged turns, so that reading back gives every turn.
Texts and roles may hold control strings.  They are escaped reversibly: in ``<`` + n backslashes
+ ``|`` one more backslash is put before the bar, so an escaped text never holds ``<|``; reading
back takes one away.  A line feed in a role becomes ``<|nl|>``.

The loss mask is a list of segments (text, in_loss) whose texts, in order, make the formatted
string; exactly the assistant's texts (escaped) are in the loss, without marks around them.

A null text or role counts as empty, a null turn sorts first, and ties of a turn are ordered by
role and text.  Rows with a null conv_id make one conversation of their own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

START, END, NEXT, LINE = "<|im_start|>", "<|im_end|>", "<|im_next|>", "<|nl|>"


def escaped(c: Column) -> Column:
    return F.regexp_replace(c, r"<(\\*)\|", r"<$1\\|")


def unescaped(c: Column) -> Column:
    return F.regexp_replace(c, r"<(\\*)\\\|", r"<$1|")


def format_chats(conversations: DataFrame, loss_role: str = "assistant") -> DataFrame:
    """conv_id, formatted, segments: one row per conversation."""
    turn = F.struct(
        F.col("turn").alias("turn"),
        F.coalesce("role", F.lit("")).alias("role"),
        F.coalesce("text", F.lit("")).alias("text"),
    )
    turns = F.array_sort(F.collect_list(turn))
    segment = lambda text, loss: F.struct(text.alias("text"), F.lit(loss).alias("in_loss"))
    rows = conversations.groupBy("conv_id").agg(turns.alias("turns")).where(F.size("turns") > 0)
    n = F.size("turns")
    # a turn's own segments: its mark (a start, or a seam within a merged run), its text, and the end of its run
    each = F.transform(
        "turns",
        lambda t, i: F.struct(
            F.when((i > 0) & (F.get("turns", i - 1)["role"] == t["role"]), F.lit(NEXT)).otherwise(F.concat(F.lit(START), F.replace(escaped(t["role"]), F.lit("\n"), F.lit(LINE)), F.lit("\n"))).alias("mark"),
            escaped(t["text"]).alias("text"),
            F.when((i < n - 1) & (F.get("turns", i + 1)["role"] == t["role"]), F.lit("")).otherwise(F.lit(END + "\n")).alias("end"),
            (t["role"] == loss_role).alias("in_loss"),
        ),
    )
    rows = rows.select("conv_id", each.alias("each"))
    segments = F.flatten(F.transform("each", lambda t: F.array(segment(t["mark"], False), F.struct(t["text"].alias("text"), t["in_loss"].alias("in_loss")), segment(t["end"], False))))
    segments = F.filter(segments, lambda s: (s["text"] != "") | s["in_loss"])
    return rows.select("conv_id", segments.alias("segments")).select("conv_id", F.array_join(F.transform("segments", lambda s: s["text"]), "").alias("formatted"), "segments")


def read_back(formatted: Column) -> Column:
    """array<struct<role, text>> of every turn, from the formatted string alone."""
    runs = F.slice(F.split(formatted, r"<\|im_start\|>"), 2, 1 << 30)

    def turns(run: Column) -> Column:
        at = F.instr(run, "\n")
        role = unescaped(F.replace(F.substring(run, F.lit(1), at - 1), F.lit(LINE), F.lit("\n")))
        body = F.substring(run, at + 1, F.length(run))
        body = F.regexp_replace(body, r"<\|im_end\|>\n\z", "")
        return F.transform(F.split(body, r"<\|im_next\|>"), lambda text: F.struct(role.alias("role"), unescaped(text).alias("text")))

    return F.flatten(F.transform(runs, turns))


def loss_text(segments: Column) -> Column:
    """All text under the loss mask, unescaped."""
    return F.array_join(F.transform(F.filter(segments, lambda s: s["in_loss"]), lambda s: unescaped(s["text"])), "")
