"""Chat formatting of typed content parts, with DataFrame functions only.

A visitor flattens each turn's parts in order: text parts are escaped, image,
audio and document parts become placeholders whose references and token counts
are recorded beside the text. Control strings inside texts, the template's own
and those of other templates, get a backslash after their first character; one
that has backslashes there already gets one more, so unescaping is exact.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

#: Fixed strings of the template.
TURN, BODY, END = "<|turn|>", "<|body|>", "<|end|>"
PLACEHOLDERS = {"image": "<|image|>", "audio": "<|audio|>", "document": "<|document|>"}
#: How control strings begin and go on, here and in other templates.
HEADS, TAILS = r"([<\[])", r"(\||/?s>|/?INST\]|</?SYS>>)"

PART = "struct<kind:string,text:string,ref:string,tokens:int>"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, rf"{HEADS}(\\*){TAILS}", r"$1\\$2$3")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, rf"{HEADS}\\(\\*){TAILS}", "$1$2$3")


def text_parts(text: Column) -> Column:
    """A plain text as its one part."""
    return F.array(F.struct(F.lit("text").alias("kind"), text.alias("text"), F.lit(None).cast("string").alias("ref"), F.lit(None).cast("int").alias("tokens")))


def visit(parts: Column) -> Column:
    """What parts are in the output; those of unknown kinds count as documents, null texts as empty.

    Neighbouring texts are one text before they are escaped, as a control string may begin in one and end in another.
    """
    start = F.struct(F.lit("").alias("done"), F.lit("").alias("text"))

    def step(acc: Column, part: Column) -> Column:
        mark = F.lit(PLACEHOLDERS["document"])
        for kind, own in PLACEHOLDERS.items():
            mark = F.when(part["kind"] == kind, F.lit(own)).otherwise(mark)
        more = F.struct(acc["done"].alias("done"), F.concat(acc["text"], F.coalesce(part["text"], F.lit(""))).alias("text"))
        other = F.struct(F.concat(acc["done"], escape(acc["text"]), mark).alias("done"), F.lit("").alias("text"))
        return F.when(part["kind"] == "text", more).otherwise(other)

    return F.aggregate(parts, start, step, lambda acc: F.concat(acc["done"], escape(acc["text"])))


def format_turns(turns: DataFrame, learn: str = "assistant", text_tokens=None) -> DataFrame:
    """conv_id, formatted, loss, attachments, tokens for each conversation.

    ``turns`` has conv_id, turn, role and parts (an array of kind, text, ref,
    tokens). Turns stand by turn, nulls first, ties by role and content; a null
    role is empty, null or no parts an empty body, a null conv_id a conversation
    of its own. ``loss`` lists the places (start, length, in code points) of the
    bodies of role ``learn``. ``attachments`` lists every placeholder with its
    turn, place among the turn's attachments, kind, reference and token count
    (null: 0); ``tokens`` is their sum and, if ``text_tokens`` maps a text column
    to a count, that of the bodies. An empty table gives no rows; other columns
    are ignored.
    """
    parts = F.coalesce(F.col("parts"), F.array().cast(f"array<{PART}>"))
    body = visit(parts)
    held = F.filter(parts, lambda p: F.coalesce(p["kind"], F.lit("")) != "text")
    rows = turns.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), body.alias("body"), held.alias("held"))
    count = F.lit(0).cast("long") if text_tokens is None else text_tokens(F.col("body")).cast("long")
    head = F.concat(F.lit(TURN), escape(F.col("role")), F.lit(BODY))
    rows = rows.select("conv_id", "turn", "role", "body", "held", head.alias("head"), F.concat(head, "body", F.lit(END)).alias("whole"), count.alias("count"))
    order = W.partitionBy("conv_id").orderBy("turn", "role", "body")
    rows = rows.withColumns({"place": F.row_number().over(order), "past": F.sum(F.length("whole")).over(order.rowsBetween(W.unboundedPreceding, -1))})
    span = F.struct((F.coalesce("past", F.lit(0)) + F.length("head")).alias("start"), F.length("body").cast("long").alias("length"))
    found = F.transform(
        "held", lambda p, i: F.struct(F.col("turn").alias("turn"), i.alias("index"), F.coalesce(p["kind"], F.lit("document")).alias("kind"), p["ref"].alias("ref"), F.coalesce(p["tokens"], F.lit(0)).alias("tokens"))
    )
    one = F.struct("place", "whole", F.when(F.col("role") == learn, span).alias("span"), found.alias("found"), "count")
    rows = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list(one)).alias("all"))
    rows = rows.select(
        "conv_id", F.array_join("all.whole", "").alias("formatted"), F.array_compact("all.span").alias("loss"), F.flatten("all.found").alias("attachments"), "all.count",
    )
    tokens = F.aggregate("count", F.lit(0).cast("long"), lambda a, x: a + x) + F.aggregate("attachments", F.lit(0).cast("long"), lambda a, x: a + x["tokens"])
    return rows.select("conv_id", "formatted", "loss", "attachments", tokens.alias("tokens"))


def parse(formatted: Column) -> Column:
    """The turns of a formatted conversation: array of role and body, unescaped."""
    pieces = F.split(formatted, r"<\|end\|>", -1)
    pieces = F.slice(pieces, 1, F.size(pieces) - 1)

    def turn(x: Column) -> Column:
        halves = F.split(F.substr(x, F.lit(len(TURN) + 1)), r"<\|body\|>", 2)
        return F.struct(unescape(F.get(halves, 0)).alias("role"), unescape(F.get(halves, 1)).alias("body"))

    return F.transform(pieces, turn)


def learned_text(formatted: Column, loss: Column) -> Column:
    """All text under the loss mask, unescaped, in order."""
    return F.array_join(F.transform(loss, lambda s: unescape(F.substr(formatted, (s["start"] + 1).cast("int"), s["length"].cast("int")))), "")
