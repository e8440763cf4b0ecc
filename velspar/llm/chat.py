"""Chat formatting with Spark expressions only: collect turns, sort, merge neighbours of one role, concatenate."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

START, END, SEP = "<|im_start|>", "<|im_end|>\n", "<|im_sep|>"


def escaped(text: Column) -> Column:
    """No escaped text holds a control string: between < and | stands one backslash more than before."""
    return F.regexp_replace(text, r"<(\\*)\|", r"<\\$1|")


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, r"<\\(\\*)\|", "<$1|")


def _role(role: Column) -> Column:
    """A role stands on one line: backslash, line feed and then control strings are escaped."""
    return escaped(F.replace(F.replace(role, F.lit("\\"), F.lit("\\\\")), F.lit("\n"), F.lit("\\n")))


def _plain_role(role: Column) -> Column:
    parts = F.transform(F.split(unescaped(role), r"\\\\", -1), lambda x: F.replace(x, F.lit("\\n"), F.lit("\n")))
    return F.array_join(parts, "\\")


def format_chats(turns: DataFrame, loss_role: str = "assistant") -> DataFrame:
    """(conv_id, n_turns, segments, formatted): one row per conversation of turns (conv_id, turn, role, text).

    formatted is the concatenation of segments (text, loss); loss marks what a model learns: the texts of loss_role,
    each once, without marks. Neighbouring turns of one role share one block, a separator between their texts, so
    every row can be read back. Turns are ordered by turn, then role and text, which also settles ties; null turns come
    first; a null role or text is empty; rows of a null conv_id are one conversation; repeated rows stay; other columns
    are ignored; an empty table gives no rows. A conversation is one row, so its own length bounds a task.
    """
    blank = F.lit("")
    rows = turns.select(
        "conv_id",
        F.struct(F.col("turn"), F.coalesce(F.col("role"), blank).alias("role"), F.coalesce(F.col("text"), blank).alias("text")).alias("t"),
    )
    got = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns"))
    n = F.size("turns")
    same = lambda i: (i > 0) & (F.get(F.col("turns"), i - 1)["role"] == F.get(F.col("turns"), i)["role"])

    def pieces(x: Column, i: Column) -> Column:
        head = F.when(same(i), F.lit(SEP)).otherwise(F.concat(F.when(i > 0, F.lit(END)).otherwise(blank), F.lit(START), _role(x["role"]), F.lit("\n")))
        return F.array(F.struct(head.alias("text"), F.lit(False).alias("loss")), F.struct(escaped(x["text"]).alias("text"), (x["role"] == loss_role).alias("loss")))

    close = F.array(F.struct(F.lit(END).alias("text"), F.lit(False).alias("loss")))
    got = got.select("conv_id", n.alias("n_turns"), F.concat(F.flatten(F.transform("turns", pieces)), close).alias("segments"))
    return got.withColumn("formatted", F.array_join(F.transform("segments", lambda x: x["text"]), ""))


def read_back(formatted: Column) -> Column:
    """The turns (role, text) of a formatted conversation, parsed from its marks."""
    blocks = F.transform(F.filter(F.split(formatted, r"<\|im_start\|>", -1), lambda x: x != ""), lambda x: F.regexp_replace(x, r"<\|im_end\|>\n\z", ""))

    def turns(block: Column) -> Column:
        cut = F.locate("\n", block)
        role = F.substring(block, F.lit(1), cut - 1)
        return F.transform(
            F.split(F.substring(block, cut + 1, F.length(block)), r"<\|im_sep\|>", -1),
            lambda x: F.struct(_plain_role(role).alias("role"), unescaped(x).alias("text")),
        )

    return F.flatten(F.transform(blocks, turns))


def masked_text(segments: Column) -> Column:
    """What stands under the loss mask, unescaped."""
    return F.array_join(F.transform(F.filter(segments, lambda x: x["loss"]), lambda x: unescaped(x["text"])), "")
