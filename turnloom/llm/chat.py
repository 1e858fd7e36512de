"""Operator 4: chat formatting with Spark expressions only.

A window over a conversation's rows gives each turn the place that its text takes in the output. The turns are collected as structs and
sorted, adjacent turns of one role are merged by array functions into runs, and the runs are concatenated. Every step is linear in the number of
turns; nothing is appended to a growing array or string.

The loss mask lists runs of characters: each text of a loss role is one, and separators, roles and control strings are outside it.

Template: `<|im_start|>` role `<|im_body|>` text (`<|im_sep|>` text)* `<|im_end|>`, one after another. Inside roles and texts a
backslash is doubled, and a backslash is put after the first character of `<|`, `<s>`, `</s>`, `[INST]` and `[/INST]`, so no control
string of this or of the bracketed family is left in them, and the change can be undone: `read_back` does so.

Defined cases: a null text or role is empty; a null conv_id is a conversation like others; turns with equal numbers are ordered by
role, then text; a null turn number comes first; repeated rows are repeated turns; an empty table gives no rows. One conversation is
one output value and so has to fit in one row; a row is never built from more than one conversation.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

START, BODY, SEP, END = "<|im_start|>", "<|im_body|>", "<|im_sep|>", "<|im_end|>"


def escape(text: Column) -> Column:
    doubled = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    return F.regexp_replace(doubled, r"<(?=\||/?s>)|\[(?=/?INST\])", r"$0\\")


def unescape(text: Column) -> Column:
    bare = F.regexp_replace(text, r"(<)\\(?=\||/?s>)|(\[)\\(?=/?INST\])", "$1$2")
    return F.replace(bare, F.lit("\\\\"), F.lit("\\"))


def format_conversations(turns: DataFrame, loss_roles: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """(conv_id, formatted, loss_mask): loss_mask lists runs of characters in order as (start, chars, in_loss), without gaps; a text is a run of its own."""
    cells = turns.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    by_turn = Window.partitionBy("conv_id").orderBy(F.asc_nulls_first("turn"), "role", "text")
    size = lambda c: F.char_length(c).cast("long")
    before, chars = F.lag("role").over(by_turn), size(escape(F.col("text")))
    # what stands between a text and the one before it
    head = F.lit(len(START) + len(BODY)) + size(escape(F.col("role")))
    gap = F.when(before.isNull(), head).when(before != F.col("role"), head + len(END)).otherwise(len(SEP))
    sized = cells.withColumns({"chars": chars, "gap": gap})
    # spelled out, as rows of equal turn, role and text have places of their own
    upto = F.sum(F.col("gap") + F.col("chars")).over(by_turn.rowsBetween(Window.unboundedPreceding, 0))
    placed = sized.select("conv_id", F.struct("turn", "role", "text", (upto - F.col("chars")).alias("start"), "chars").alias("cell"))
    sorted_turns = placed.groupBy("conv_id").agg(F.sort_array(F.collect_list("cell")).alias("turns"))
    starts = F.filter(
        F.sequence(F.lit(1), F.size("turns")),
        lambda i: (i == 1) | (F.element_at("turns", i)["role"] != F.element_at("turns", F.greatest(i - 1, F.lit(1)))["role"]),
    )
    bounded = sorted_turns.select("conv_id", "turns", starts.alias("starts"))

    def run(first: Column, k: Column) -> Column:
        after = F.coalesce(F.get("starts", k + 1), F.size("turns") + 1)
        own = F.slice("turns", first, after - first)
        return F.concat(F.lit(START), escape(F.element_at("turns", first)["role"]), F.lit(BODY), F.array_join(F.transform(own, lambda t: escape(t["text"])), SEP), F.lit(END))

    span = lambda start, chars, inside: F.struct(start.alias("start"), chars.alias("chars"), inside.alias("in_loss"))
    end_of = lambda i: F.coalesce(F.get("turns", i)["start"] + F.get("turns", i)["chars"], F.lit(0).cast("long"))
    pairs = F.transform("turns", lambda t, i: F.array(span(end_of(i - 1), t["start"] - end_of(i - 1), F.lit(False)), span(t["start"], t["chars"], t["role"].isin(*loss_roles))))
    tail = F.array(span(end_of(F.size("turns") - 1), F.lit(len(END)).cast("long"), F.lit(False)))
    return bounded.select("conv_id", F.array_join(F.transform("starts", run), "").alias("formatted"), F.concat(F.flatten(pairs), tail).alias("loss_mask"))


def read_back(formatted: DataFrame) -> DataFrame:
    """(conv_id, formatted, loss_mask, turns): turns as array<struct<role, text>>, parsed from the formatted text alone."""
    pieces = F.split("formatted", r"<\|im_end\|>")
    parsed = formatted.select("conv_id", "formatted", "loss_mask", F.slice(pieces, 1, F.size(pieces) - 1).alias("pieces"))
    turns = F.flatten(
        F.transform(
            "pieces",
            lambda p: F.transform(
                F.split(F.substring_index(p, BODY, -1), r"<\|im_sep\|>"),
                lambda t: F.struct(unescape(F.replace(F.substring_index(p, BODY, 1), F.lit(START), F.lit(""))).alias("role"), unescape(t).alias("text")),
            ),
        )
    )
    return parsed.select("conv_id", "formatted", "loss_mask", turns.alias("turns"))


def loss_texts() -> Column:
    """The texts under the loss mask, cut out of the formatted text by its places and unescaped."""
    own = F.filter("loss_mask", lambda m: m["in_loss"])
    return F.transform(own, lambda m: unescape(F.substring(F.col("formatted"), (m["start"] + 1).cast("int"), m["chars"].cast("int"))))


def digests(formatted: DataFrame) -> DataFrame:
    """The digest columns of each conversation, from its formatted text."""
    turns = read_back(formatted)
    texts = turns.select(
        "conv_id",
        F.char_length("formatted").cast("long").alias("formatted_chars"),
        F.size("turns").cast("long").alias("n_turns"),
        F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "").alias("all_text"),
        F.array_join(loss_texts(), "").alias("loss_text"),
    )
    return texts.select(
        "conv_id", "n_turns", F.sha2("all_text", 256).alias("turns_sha256"), F.char_length("loss_text").cast("long").alias("loss_chars"), F.sha2("loss_text", 256).alias("loss_sha256"), "formatted_chars"
    )
