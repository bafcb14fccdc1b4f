"""Relational chat formatting with Spark expressions only.

Each conversation's turns are collected as structs and sorted by (turn, role, text); neighbouring turns
of one role share one block; the pieces are concatenated with array functions. The template is

    <|im_start|>ROLE NEWLINE TEXT [<|part|>TEXT ...]<|im_end|> NEWLINE

where <|part|> keeps merged turns apart. Inside roles and texts "&" is written "&amp;" and "<|" is
written "&lt;|" (and a line feed in a role "&#10;"), so every "<|" of the output is the template's and
reading back restores every turn. loss_spans are (start, length) in code points of `formatted`, one
for each assistant turn's text and nothing else.

Definitions: null texts and roles are empty; null turn numbers come first; repeated rows are turns of
their own; ties in the turn number are ordered by role, then text; a null conv_id is a conversation;
an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

START, END, PART = "<|im_start|>", "<|im_end|>\n", "<|part|>"


def escape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("&"), F.lit("&amp;")), F.lit("<|"), F.lit("&lt;|"))


def unescape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("&lt;|"), F.lit("<|")), F.lit("&amp;"), F.lit("&"))


def _escape_role(role: Column) -> Column:
    return F.replace(escape(role), F.lit("\n"), F.lit("&#10;"))


def _unescape_role(role: Column) -> Column:
    return unescape(F.replace(role, F.lit("&#10;"), F.lit("\n")))


def format_chat(df: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", loss_role: str = "assistant") -> DataFrame:
    """One row for each conversation: conv_id, formatted, loss_spans array<struct<start, length>>."""
    rows = df.select(
        F.col(conv_id).alias("conv_id"),
        F.struct(F.col(turn).alias("turn"), F.coalesce(F.col(role), F.lit("")).alias("role"), F.coalesce(F.col(text), F.lit("")).alias("text")).alias("one"),
    )
    turns = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("one")).alias("turns"))

    def piece(x: Column, i: Column) -> Column:
        """Head, body and tail of a turn; i counts from 0."""
        before, after = F.get(F.col("turns"), i - 1)["role"], F.get(F.col("turns"), i + 1)["role"]
        head = F.when((i > 0) & (before == x["role"]), F.lit(PART)).otherwise(F.concat(F.lit(START), _escape_role(x["role"]), F.lit("\n")))
        tail = F.when((i < F.size("turns") - 1) & (after == x["role"]), F.lit("")).otherwise(F.lit(END))
        return F.struct(head.alias("head"), escape(x["text"]).alias("body"), tail.alias("tail"), (x["role"] == loss_role).alias("loss"))

    pieces = turns.select("conv_id", F.transform("turns", piece).alias("pieces"))
    none = F.expr("CAST(array() AS array<struct<start:bigint,length:bigint>>)")

    def span(state: Column, x: Column) -> Column:
        at = state["at"] + F.length(x["head"])
        one = F.struct(at.alias("start"), F.length(x["body"]).cast("bigint").alias("length"))
        return F.struct(
            (at + F.length(x["body"]) + F.length(x["tail"])).alias("at"),
            F.when(x["loss"], F.concat(state["spans"], F.array(one))).otherwise(state["spans"]).alias("spans"),
        )

    return pieces.select(
        "conv_id",
        F.array_join(F.transform("pieces", lambda x: F.concat(x["head"], x["body"], x["tail"])), "").alias("formatted"),
        F.aggregate("pieces", F.struct(F.lit(0).cast("bigint").alias("at"), none.alias("spans")), span, lambda s: s["spans"]).alias("loss_spans"),
    )


def parse_chat(df: DataFrame) -> DataFrame:
    """Reads format_chat's output back: conv_id, turns array<struct<role, text>>, loss_text."""
    split = F.split("formatted", r"<\|im_start\|>")
    blocks = F.slice(split, F.lit(2), F.size(split))

    def turns(block: Column) -> Column:
        role = F.substring_index(block, "\n", 1)
        body = F.substring(block, F.length(role) + 2, F.length(block) - F.length(role) - 1 - len(END))
        return F.transform(F.split(body, r"<\|part\|>"), lambda t: F.struct(_unescape_role(role).alias("role"), unescape(t).alias("text")))

    masked = F.transform("loss_spans", lambda s: unescape(F.substring(F.col("formatted"), (s["start"] + 1).cast("int"), s["length"].cast("int"))))
    return df.select("conv_id", "formatted", F.flatten(F.transform(blocks, turns)).alias("turns"), F.array_join(masked, "").alias("loss_text"))
