"""Chat formatting by prefix-target expansion.

Every assistant turn becomes an example of its own: all turns before it as context, and only that reply trainable.  A
conversation that doesn't end with a reply also gives one context-only example, so no turn is lost to readers.

Template: ``<|im_start|>role\\ntext<|im_end|>\\n`` per turn.  Control strings inside texts and roles are escaped by
one more backslash in ``<\\...|``, which ``unescape`` takes out again; other texts stay as they are.  The loss span is
given in code points of the formatted text and covers the reply alone.

Everything is built-in expressions.  Turns are escaped before the one shuffle (by conversation); examples are built
row by row, so a task holds a conversation and one example.  Prefix-target output is quadratic in the turns of a
conversation by its nature.

Defined cases: null text and null role are empty; turns order by (turn, role, text), nulls first, repeated rows all
kept; a null conv_id is one conversation; an empty table gives no examples; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

START, END = "<|im_start|>", "<|im_end|>\n"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, r"<(\\*)\|", r"<$1\\|")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"<(\\*)\\\|", r"<$1|")


def _escape_role(role: Column) -> Column:
    return F.replace(F.replace(escape(role), F.lit("%"), F.lit("%25")), F.lit("\n"), F.lit("%0A"))


def _unescape_role(role: Column) -> Column:
    return unescape(F.replace(F.replace(role, F.lit("%0A"), F.lit("\n")), F.lit("%25"), F.lit("%")))


def format_examples(turns: DataFrame, trainable: str = "assistant") -> DataFrame:
    """(conv_id, turn, role, text) to (conv_id, example, n_turns, text, loss_start, loss_end); no span: no reply."""
    role, body = F.coalesce(F.col("role"), F.lit("")), escape(F.coalesce(F.col("text"), F.lit("")))
    segments = turns.select(
        "conv_id",
        F.struct(
            F.col("turn").alias("turn"),
            role.alias("role"),
            F.concat(F.lit(START), _escape_role(role), F.lit("\n"), body, F.lit(END)).alias("segment"),
            F.char_length(body).alias("chars"),
        ).alias("_t"),
    )
    whole = segments.groupBy("conv_id").agg(F.sort_array(F.collect_list("_t")).alias("_t"))
    ends = F.filter(F.sequence(F.lit(1), F.size("_t")), lambda i: (F.get(F.col("_t"), i - 1)["role"] == trainable) | (i == F.size("_t")))
    examples = whole.select("conv_id", "_t", F.posexplode(ends).alias("example", "_end"))
    built = examples.select(
        "conv_id",
        "example",
        F.col("_end").alias("n_turns"),
        F.array_join(F.slice(F.col("_t")["segment"], F.lit(1), F.col("_end")), "").alias("text"),
        F.get("_t", F.col("_end") - 1)["role"].alias("_role"),
        F.get("_t", F.col("_end") - 1)["chars"].alias("_chars"),
    )
    stop = F.char_length("text") - len(END)
    reply = F.col("_role") == trainable
    return built.select(
        "conv_id",
        "example",
        "n_turns",
        "text",
        F.when(reply, stop - F.col("_chars")).alias("loss_start"),
        F.when(reply, stop).alias("loss_end"),
    )


def read_turns(text: Column) -> Column:
    """Formatted text back to array<struct<role, text>>."""
    parts = F.filter(F.split(text, r"<\|im_end\|>\n", -1), lambda s, i: s.startswith(START))
    at = lambda s: F.instr(s, "\n")
    return F.transform(
        parts,
        lambda s: F.struct(
            _unescape_role(F.substring(s, F.lit(len(START) + 1), at(s) - 1 - len(START))).alias("role"),
            unescape(F.substring(s, at(s) + 1, F.char_length(s))).alias("text"),
        ),
    )


def digest(examples: DataFrame) -> DataFrame:
    """Per conversation, read back from the formatted examples alone."""
    loss = unescape(F.expr("substring(text, loss_start + 1, loss_end - loss_start)"))
    read = examples.select(
        "conv_id",
        F.struct("example", "text").alias("_whole"),
        F.when(F.col("loss_start").isNotNull(), F.struct("example", loss.alias("loss"))).alias("_loss"),
        F.char_length("text").cast("long").alias("_chars"),
    )
    per = read.groupBy("conv_id").agg(
        F.max("_whole")["text"].alias("_text"),
        F.array_join(F.sort_array(F.collect_list("_loss"))["loss"], "").alias("_loss"),
        F.sum("_chars").alias("formatted_chars"),
    )
    turns = per.select("conv_id", read_turns(F.col("_text")).alias("_turns"), "_loss", "formatted_chars")
    lines = F.transform("_turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    return turns.select(
        "conv_id",
        F.size("_turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(lines, ""), 256).alias("turns_sha256"),
        F.char_length("_loss").cast("long").alias("loss_chars"),
        F.sha2("_loss", 256).alias("loss_sha256"),
        "formatted_chars",
    )
