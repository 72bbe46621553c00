r"""Chat formatting with relational operators and Spark expressions only.

Turns are collected as structs and sorted by turn; adjacent turns of one role form one block with a single header; blocks
are joined to one string. The template of a block is

    ### <role>: <text></turn><text></turn>\n

A backslash before each of the characters \\ # / : in roles and \\ # / in texts keeps the marks "### " and "</turn>" out of
both, so the output reads back to exactly the turns it was made from. The loss mask lists the spans of assistant texts.

Turns first meet in chunks of TURNS_TOGETHER rows, so what is shuffled and merged for a conversation is a few ordered
lists; the conversation's one output string is the only thing that has all of its turns.

Defined results: a null text or role is the empty one; a null turn sorts first, and ties by role, then text; repeated rows
are repeated turns; a null conversation is a conversation; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from catalens.llm.runtime import let

HEAD, END = "### ", "</turn>"
ASSISTANT = "assistant"
TURNS_TOGETHER = 64


def escaped(text: Column, marks: str = "\\\\#/") -> Column:
    return F.regexp_replace(text, f"([{marks}])", "\\\\$1")


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, "(?s)\\\\(.)", "$1")


def _role_at(turns: Column, i: Column) -> Column:
    return F.get(turns, i)["role"]


def _blocks(turns: Column) -> Column:
    """Where each run of adjacent turns of one role starts, and the end of the last."""
    n = F.size(turns)
    starts = F.filter(F.sequence(F.lit(0), n - 1), lambda i: (i == 0) | (_role_at(turns, i) != _role_at(turns, i - 1)))
    return F.concat(starts, F.array(n))


def _formatted(turns: Column) -> Column:
    def joined(cuts: Column) -> Column:
        def block(start: Column, k: Column) -> Column:
            texts = F.transform(F.slice(turns, start + 1, F.get(cuts, k + 1) - start), lambda t: F.concat(escaped(t["text"]), F.lit(END)))
            return F.concat(F.lit(HEAD), escaped(_role_at(turns, start), "\\\\#/:"), F.lit(": "), F.array_join(texts, ""), F.lit("\n"))

        return F.array_join(F.transform(F.slice(cuts, F.lit(1), F.size(cuts) - 1), block), "")

    return let(_blocks(turns), joined)


def parsed(formatted: Column) -> Column:
    """The turns that a formatted conversation has: array of struct<role, text, lead, tail>, as they stand there, escaped.

    lead and tail count the template's code points right before and after the text.
    """

    def turns_of(block: Column) -> Column:
        role = F.regexp_extract(block, "(?s)\\A((?:[^\\\\:]++|\\\\.)*+): ", 1)

        def turn(texts: Column) -> Column:
            own = F.slice(texts, F.lit(1), F.size(texts) - 1)
            lead = len(HEAD) + F.length(role) + 2
            return F.transform(own, lambda t, k: F.struct(role.alias("role"), t.alias("text"), F.when(k == 0, lead).otherwise(0).alias("lead"), F.when(k == F.size(own) - 1, len(END) + 1).otherwise(len(END)).alias("tail")))

        return let(F.split(F.substr(block, F.length(role) + 3), END), turn)

    return F.flatten(F.transform(F.filter(F.split(formatted, HEAD), lambda b: b != ""), turns_of))


def _sums_before(values: Column) -> Column:
    """For each value the sum of those before it, by sums of steps, so that long arrays stay cheap."""

    step = 64

    def total(part: Column) -> Column:
        return F.aggregate(part, F.lit(0), lambda a, x: a + x)

    def places(bases: Column) -> Column:
        return F.transform(values, lambda _, i: F.get(bases, F.floor(i / step).cast("int")) + total(F.slice(values, F.floor(i / step).cast("int") * step + 1, i % step)))

    blocks = F.transform(F.sequence(F.lit(0), F.floor(F.size(values) / step).cast("int")), lambda c: total(F.slice(values, c * step + 1, F.lit(step))))
    return let(blocks, lambda b: let(F.transform(b, lambda _, c: total(F.slice(b, F.lit(1), c))), places))


def loss_spans(formatted: Column) -> Column:
    """array of struct<start, stop>: the code points of each assistant text in the output, found by reading it back."""

    def spans(turns: Column) -> Column:
        sizes = F.transform(turns, lambda t: t["lead"] + F.length(t["text"]) + t["tail"])
        starts = let(sizes, lambda s: _sums_before(s))
        placed = F.zip_with(turns, starts, lambda t, at: F.struct(t["role"].alias("role"), (at + t["lead"]).alias("start"), (at + t["lead"] + F.length(t["text"])).alias("stop")))
        return F.transform(F.filter(placed, lambda p: p["role"] == ASSISTANT), lambda p: F.struct(p["start"].alias("start"), p["stop"].alias("stop")))

    return let(parsed(formatted), spans)


def under(formatted: Column, spans: Column) -> Column:
    """The texts under a mask, unescaped, nothing between them."""
    return F.array_join(F.transform(spans, lambda s: unescaped(F.substr(formatted, s["start"] + 1, s["stop"] - s["start"]))), "")


def format_conversations(rows: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv_id, formatted, loss_spans) of every conversation."""
    turns = rows.select(
        F.col(conv_id).alias("conv_id"),
        F.struct(F.col(turn).alias("turn"), F.coalesce(F.col(role).cast("string"), F.lit("")).alias("role"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text")).alias("t"),
        F.floor(F.coalesce(F.col(turn).cast("bigint"), F.lit(0)) / TURNS_TOGETHER).alias("chunk"),
    )
    chunks = turns.groupBy("conv_id", "chunk").agg(F.sort_array(F.collect_list("t")).alias("turns"))
    whole = chunks.groupBy("conv_id").agg(F.sort_array(F.collect_list("turns")).alias("chunks"))
    whole = whole.select("conv_id", let(F.sort_array(F.flatten("chunks")), _formatted).alias("formatted"))
    return whole.select("conv_id", "formatted", loss_spans(F.col("formatted")).alias("loss_spans"))


def read_back(conversations: DataFrame) -> DataFrame:
    """Digests of what a formatted table says, from its strings and masks alone."""
    turns = F.transform(parsed(F.col("formatted")), lambda t: F.concat(unescaped(t["role"]), F.lit("\n"), unescaped(t["text"]), F.lit("\n")))
    read = conversations.select("conv_id", "formatted", turns.alias("turns"), under(F.col("formatted"), F.col("loss_spans")).alias("loss"))
    return read.select(
        "conv_id",
        F.size("turns").cast("bigint").alias("n_turns"),
        F.sha2(F.array_join("turns", ""), 256).alias("turns_sha256"),
        F.length("loss").cast("bigint").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        F.length("formatted").cast("bigint").alias("formatted_chars"),
    )
