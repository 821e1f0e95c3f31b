"""Chat formatting: conversations to one marked string each, and back.

Turns of a conversation are collected as structs and sorted, adjacent turns of
one role are merged into a block, and the blocks are concatenated; places of
the learned texts are running sums by array aggregation. Spark expressions
only, each in proportion to the turns.

Format of a block: ``[INST]role[/INST]`` then every text of the block, each
closed by ``</s>``. A control string inside a role or text gets a backslash
after its first character (``[\\INST]``); one that already has backslashes
there gets one more, so that escaping is reversible and no mark can appear in
escaped text. No mark starts inside another, so a text that ends with a part
of a mark stays readable too.

Defined cases: NULL role or text is empty; turns sort by (turn, role, text)
with NULL turns first, so ties and repeated rows have one order and all are
kept; rows with a NULL conversation id form one conversation; further input
columns are ignored; an empty table gives an empty result.

Size: the output is one string per conversation, so one conversation must fit
in one row. Conversations are grouped by id; the group is the product itself.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from retailcast.llm.common import quoted

OPEN, HEAD_END, CLOSE = "[INST]", "[/INST]", "</s>"
CHUNK = 128      # numbers that are summed by copying a growing array
WIDE = "UTF-32"  # four bytes to a code point

#: A control string with any number of escape backslashes after its first character.
ESCAPE_FROM, ESCAPE_TO = r"([\[<])(\\*)(/?INST\]|/s>)", r"$1\\$2$3"
UNESCAPE_FROM, UNESCAPE_TO = r"([\[<])\\(\\*)(/?INST\]|/s>)", "$1$2$3"


def escape(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), F.lit(ESCAPE_FROM), F.lit(ESCAPE_TO))


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, F.lit(UNESCAPE_FROM), F.lit(UNESCAPE_TO))


def format_conversations(rows: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role",
                         text: str = "text", learn_role: str = "assistant") -> DataFrame:
    """One row per conversation: conv_id, formatted, loss_spans.

    ``loss_spans`` lists (begin, length) in code points of ``formatted``, one
    for each text of ``learn_role``, marks excluded.
    """
    turns = (rows.select(quoted(conv_id).alias("conv_id"),
                         F.struct(quoted(turn).alias("turn"),
                                  F.coalesce(quoted(role), F.lit("")).alias("role"),
                                  F.coalesce(quoted(text), F.lit("")).alias("text")).alias("t"))
             .groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns")))
    # merge: a turn opens a block unless the turn before it has the same role; a block is a slice of the turns
    n = F.size("turns")
    opens = F.filter(F.sequence(F.lit(0), n - 1), lambda i: (i == 0) | (
        F.get("turns", i - 1)["role"] != F.get("turns", i)["role"]))
    blocks = let(opens, lambda at: F.transform(at, lambda b, k: F.struct(
        F.get("turns", b)["role"].alias("role"),
        F.transform(F.slice("turns", b + 1, F.coalesce(F.get(at, k + 1), n) - b),
                    lambda t: escape(t["text"])).alias("texts"))))
    merged = turns.select("conv_id", blocks.alias("blocks"))

    def head(block: Column) -> Column:
        return F.concat(F.lit(OPEN), escape(block["role"]), F.lit(HEAD_END))

    formatted = F.array_join(F.transform("blocks", lambda b: F.concat(head(b), F.array_join(
        F.transform(b["texts"], lambda x: F.concat(x, F.lit(CLOSE))), ""))), "")
    texts = F.flatten(F.transform("blocks", lambda b: F.transform(b["texts"], lambda x, k: F.struct(
        F.when(k == 0, F.length(head(b))).otherwise(0).cast("long").alias("head"),
        F.length(x).cast("long").alias("length"), (b["role"] == learn_role).alias("learn")))))
    spans = let(texts, lambda ts: F.transform(
        F.filter(F.arrays_zip(ts.alias("t"), running_sums(F.transform(
            ts, lambda t: t["head"] + t["length"] + len(CLOSE))).alias("at")), lambda x: x["t"]["learn"]),
        lambda x: F.struct((x["at"] + x["t"]["head"]).alias("begin"), x["t"]["length"].alias("length"))))
    return merged.select("conv_id", formatted.alias("formatted"), spans.alias("loss_spans"))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, not wherever it is used."""
    return F.transform(F.array(value), body)[0]


def running_sums(numbers: Column) -> Column:
    """For each number the sum of those before it.

    An array grows by copying, so sums run inside chunks of ``CHUNK`` numbers
    and then over the chunks: the cost is in proportion to the numbers.
    """
    none = F.array().cast("array<bigint>")
    zero = F.lit(0).cast("long")

    def chunk(part: Column) -> Column:
        return F.aggregate(part, F.struct(zero.alias("sum"), none.alias("before")), lambda s, x: F.struct(
            (s["sum"] + x).alias("sum"), F.concat(s["before"], F.array(s["sum"])).alias("before")))

    def join(state: Column, part: Column) -> Column:
        shifted = F.transform(part["before"], lambda x: x + state["sum"])
        return F.struct((state["sum"] + part["sum"]).alias("sum"), F.concat(state["parts"], F.array(shifted)).alias("parts"))

    def of(xs: Column) -> Column:
        parts = F.transform(F.sequence(F.lit(0), F.floor((F.size(xs) - 1) / CHUNK).cast("int")),
                            lambda k: chunk(F.slice(xs, k * CHUNK + 1, CHUNK)))
        start = F.struct(zero.alias("sum"), F.array().cast("array<array<bigint>>").alias("parts"))
        return F.when(F.size(xs) > 0, F.aggregate(parts, start, join, lambda s: F.flatten(s["parts"]))).otherwise(none)

    return let(numbers, of)


def read_turns(formatted: Column) -> Column:
    """Turns back from a formatted string: array of (role, text), merged blocks taken apart again."""
    parts = F.split(formatted, r"\[INST\]", -1)
    blocks = F.slice(parts, F.lit(2), F.size(parts) - 1)

    def turns(block: Column) -> Column:
        head = F.split(block, r"\[/INST\]", 2)
        bodies = F.split(head[1], "</s>", -1)
        return F.transform(F.slice(bodies, F.lit(1), F.size(bodies) - 1), lambda x: F.struct(
            unescape(head[0]).alias("role"), unescape(x).alias("text")))

    return F.flatten(F.transform(blocks, turns))


def read_loss_text(formatted: Column, loss_spans: Column) -> Column:
    """The texts under the loss mask, unescaped, in order, nothing between them.

    Spans count code points; four bytes each, a span is cut out without
    walking the string. A leading letter keeps U+FEFF at a span's start from
    being read as a byte order mark.
    """
    def cut(wide: Column, span: Column) -> Column:
        own = F.substring(wide, (span["begin"] * 4 + 1).cast("int"), (span["length"] * 4).cast("int"))
        return unescape(F.substring(F.decode(F.concat(F.encode(F.lit("x"), WIDE), own), WIDE), F.lit(2), span["length"].cast("int")))

    return let(F.encode(formatted, WIDE), lambda wide: F.array_join(F.transform(loss_spans, lambda s: cut(wide, s)), ""))
