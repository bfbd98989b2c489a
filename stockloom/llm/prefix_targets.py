"""Chat formatting: every assistant turn becomes an example of its own.

The template marks a turn as ``<|im_start|>role`` newline ``text<|im_end|>`` newline. Control strings inside
texts are broken by an escape character after their first character, and an escape
character of the text itself is doubled, so nothing in a text can open or close a turn and
unescaping restores the text exactly. Roles are URL-encoded for the same reason.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

OPEN, CLOSE = "<|im_start|>", "<|im_end|>"
ESCAPE = "␛"

# Control strings of common chat templates; fixed values.
CONTROL = (
    "<|", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<unk>", "<pad>", "<bos>", "<eos>",
    "<start_of_turn>", "<end_of_turn>",
)


def escape(text: Column, control: tuple[str, ...] = CONTROL) -> Column:
    """Breaks every control string of a text; null becomes empty."""
    openers = [f"{re.escape(c[0])}(?={re.escape(c[1:])})" for c in control]
    return F.regexp_replace(F.coalesce(text, F.lit("")), "|".join([ESCAPE, *openers]), "$0" + ESCAPE)


def unescape(text: Column) -> Column:
    """The text that :func:`escape` was given."""
    return F.regexp_replace(text, f"{ESCAPE}({ESCAPE}?)", "$1")


def expand(conversations: DataFrame, target_role: str = "assistant") -> DataFrame:
    """One row per assistant turn, holding all turns before it and that reply.

    Takes ``conv_id, turn, role, text``; other columns are ignored. Turns are ordered by turn, role
    and text with nulls first, so ties and repeated rows have one order; repeated rows stay.
    A null text or role counts as empty. Turns after the last assistant turn (or all turns
    where there is none) form a last row without a target, so every turn is in the output; an
    empty table gives no rows.

    Returns ``conv_id, example, examples`` (position and number of the conversation's rows),
    ``formatted``, and the code-point span ``loss_start``..``loss_end`` of the only trainable text,
    empty in a row without a target. A row is as long as its conversation up to the target:
    that is the feature, and conversations are the unit that must fit a row.
    """
    turns = conversations.select(
        "conv_id",
        F.struct(
            F.col("turn").alias("turn"),
            F.coalesce(F.col("role"), F.lit("")).alias("role"),
            F.coalesce(F.col("text"), F.lit("")).alias("text"),
        ).alias("item"),
    )
    whole = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list("item")).alias("items"))
    pieces = whole.select(
        "conv_id",
        F.transform(
            "items",
            lambda t: F.struct(
                (t["role"] == target_role).alias("trained"),
                F.concat(F.lit(OPEN), F.url_encode(t["role"]), F.lit("\n")).alias("head"),
                escape(t["text"]).alias("body"),
            ),
        ).alias("pieces"),
    )
    n = F.size("pieces")
    wanted = F.filter(
        F.transform("pieces", lambda p, i: F.when(p["trained"] | (i == n - 1), i)), lambda i: i.isNotNull()
    )
    ends = pieces.withColumns({
        "examples": F.size(wanted).cast("long"),
        "marked": F.transform("pieces", lambda p: F.concat(p["head"], p["body"], F.lit(CLOSE + "\n"))),
    }).select("*", F.posexplode(wanted).alias("example", "upto"))
    last = F.col("pieces")[F.col("upto")]
    context = F.concat(F.array_join(F.slice("marked", F.lit(1), F.col("upto")), ""), last["head"])
    return (
        ends.select("conv_id", F.col("example").cast("long").alias("example"), "examples", last.alias("last"),
                    context.alias("context"))
        .select(
            "conv_id", "example", "examples",
            F.concat("context", F.col("last.body"), F.lit(CLOSE + "\n")).alias("formatted"),
            F.char_length("context").cast("long").alias("loss_start"),
            (F.char_length("context") + F.when(F.col("last.trained"), F.char_length("last.body")).otherwise(0))
            .cast("long").alias("loss_end"),
        )
    )


def read_turns(formatted: Column) -> Column:
    """The turns of a formatted text as an array of ``role, text``, unescaped."""
    parts = F.split(formatted, re.escape(CLOSE) + r"\n", -1)
    line = lambda p: F.instr(p, "\n")
    return F.transform(
        F.slice(parts, F.lit(1), F.size(parts) - 1),
        lambda p: F.struct(
            F.url_decode(F.substr(p, F.lit(len(OPEN) + 1), line(p) - 1 - len(OPEN))).alias("role"),
            unescape(F.substr(p, line(p) + 1, F.char_length(p))).alias("text"),
        ),
    )


def read_loss(formatted: Column, start: Column, end: Column) -> Column:
    """The trainable text of a row, unescaped."""
    return unescape(F.substr(formatted, (start + 1).cast("int"), (end - start).cast("int")))


def digest(examples: DataFrame) -> DataFrame:
    """Per conversation, what its rows say when they are read back.

    The last row holds all turns; the trainable texts come from each row in turn. The rows of a
    conversation are still together after :func:`expand`, so this adds no shuffle.
    """
    final = F.col("example") == F.col("examples") - 1
    turns = F.when(final, read_turns(F.col("formatted")))
    read = examples.select(
        "conv_id", "example", F.char_length("formatted").cast("long").alias("chars"),
        read_loss(F.col("formatted"), F.col("loss_start"), F.col("loss_end")).alias("loss"),
        F.size(turns).cast("long").alias("turns"),
        F.sha2(
            F.array_join(F.transform(turns, lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), ""), 256
        ).alias("sha"),
    )
    loss = F.array_join(F.transform("losses", lambda x: x["loss"]), "")
    return (
        read.groupBy("conv_id")
        .agg(F.max("turns").alias("n_turns"), F.max("sha").alias("turns_sha256"),
             F.sort_array(F.collect_list(F.struct("example", "loss"))).alias("losses"),
             F.sum("chars").alias("formatted_chars"), F.count(F.lit(1)).alias("n_examples"))
        .select(
            "conv_id", "n_turns", "turns_sha256", F.char_length(loss).cast("long").alias("loss_chars"),
            F.sha2(loss, 256).alias("loss_sha256"), "formatted_chars", "n_examples",
        )
    )
