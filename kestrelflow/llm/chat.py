r"""Chat formatting with Spark expressions only.

The rows of a conversation are collected, sorted and cut into blocks of adjacent rows of one role.
A block is written as

    <|im_start|>ROLE\nTEXT<|im_end|>\n

with <|im_sep|> between the texts of rows it has merged, so that reading back gives every row.
Inside texts and roles a backslash is doubled and <| becomes <\|, so no text holds a control string;
in roles a line feed becomes <\!. Both can be undone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

START, SEPARATOR, END = "<|im_start|>", "<|im_sep|>", "<|im_end|>\n"


def escaped(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("<|"), F.lit("<\\|"))


def unescaped(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("<\\|"), F.lit("<|")), F.lit("\\\\"), F.lit("\\"))


def _role(role: Column) -> Column:
    return F.replace(escaped(role), F.lit("\n"), F.lit("<\\!"))


def format_conversations(rows: DataFrame, trained_role: str = "assistant") -> DataFrame:
    """(conv_id, segments, formatted): one row per conversation.

    `segments` is an array of (text, loss); the texts one after another are `formatted`, and `loss`
    marks those a model is trained on: the texts of `trained_role`, without any marks. Rows go by
    turn, ties by role and text, nulls first; repeated rows stay. Null texts and roles are empty; a
    null conv_id is a conversation of its own. Other columns are ignored; no rows give no rows.
    One conversation's text is one value, so its rows have to meet in one task.
    """
    row = F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    turns = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list(row)).alias("turns"))
    heads = F.filter(
        F.sequence(F.lit(1), F.size("turns")),
        lambda i: (i == 1) | (F.get("turns", i - 1)["role"] != F.get("turns", F.greatest(i - 2, F.lit(0)))["role"]),
    )
    turns = turns.withColumn("heads", heads)
    blocks = F.transform(
        "heads",
        lambda h, k: F.slice("turns", h, F.coalesce(F.get("heads", k + 1), F.size("turns") + 1) - h),
    )
    segment = lambda text, loss: F.struct(text.alias("text"), loss.alias("loss"))
    no = F.lit(False)
    pieces = lambda b: F.concat(
        F.array(segment(F.concat(F.lit(START), _role(b[0]["role"]), F.lit("\n")), no)),
        F.flatten(
            F.transform(
                b,
                lambda t, k: F.concat(
                    F.when(k > 0, F.array(segment(F.lit(SEPARATOR), no))).otherwise(F.array().cast("array<struct<text:string,loss:boolean>>")),
                    F.array(segment(escaped(t["text"]), t["role"] == trained_role)),
                ),
            )
        ),
        F.array(segment(F.lit(END), no)),
    )
    out = turns.select("conv_id", blocks.alias("blocks"))
    out = out.select("conv_id", F.flatten(F.transform("blocks", pieces)).alias("segments"))
    return out.withColumn("formatted", F.array_join(F.col("segments.text"), ""))


def parsed(formatted: Column) -> Column:
    """The turns, an array of (role, text), that a formatted conversation was made of."""
    blocks = F.transform(
        F.slice(F.split(formatted, r"<\|im_end\|>\n"), 1, F.size(F.split(formatted, r"<\|im_end\|>\n")) - 1),
        lambda b: F.substring(b, F.lit(len(START) + 1), F.length(b)),
    )

    def turns(block: Column) -> Column:
        role = unescaped(F.replace(F.substring_index(block, "\n", 1), F.lit("<\\!"), F.lit("\n")))
        body = F.substring(block, F.instr(block, "\n") + 1, F.length(block))
        return F.transform(
            F.split(body, r"<\|im_sep\|>", -1), lambda t: F.struct(role.alias("role"), unescaped(t).alias("text"))
        )

    return F.flatten(F.transform(blocks, turns))


def trained_text(segments: Column) -> Column:
    """All text under the loss mask as it was before escaping."""
    return F.array_join(F.transform(F.filter(segments, lambda s: s["loss"]), lambda s: unescaped(s["text"])), "")
