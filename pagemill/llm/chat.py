"""Chat formatting: relational, Spark expressions only.

A conversation's rows become one string.  Turn structs are collected and sorted,
adjacent turns of one role are merged into a block, and blocks are concatenated:

    <s>[INST]role[/INST]text<sep>text</s>

``<sep>`` stands between the turns merged into a block.  Control strings within
roles and texts get a backslash after their first character, and backslashes are
doubled, so that ``parse`` gives back every turn exactly.

Defined cases: a null role or text counts as empty; rows with equal turn are
ordered by role and text; repeated rows stay; a null turn sorts first; a row with a
null id is a conversation of its own (they are never gathered); an empty table gives an empty one; other columns are ignored.  The output is one string a
conversation, so one conversation has to fit a row (2 GB): rows are collected map
side first, and nothing wider than a conversation meets in a task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagemill.llm.common import let, prefix

OPEN, ROLE_END, SEP, CLOSE = "<s>[INST]", "[/INST]", "<sep>", "</s>"


def escape(text: Column) -> Column:
    doubled = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    return F.regexp_replace(doubled, r"([<\[])(/?(?:s>|sep>|INST\]))", "$1\\\\$2")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def format_conversations(df: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", loss_roles: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """(conv_id, formatted, loss_spans): loss_spans are [start, end) code points of the formatted string,
    one for each turn of a role in loss_roles."""
    turns = df.select(
        F.col(conv_id).alias("conv_id"),
        F.when(F.col(conv_id).isNull(), F.monotonically_increasing_id()).alias("alone"),
        F.struct(F.col(turn).alias("turn"), F.coalesce(F.col(role), F.lit("")).alias("role"), F.coalesce(F.col(text), F.lit("")).alias("text")).alias("t"),
    )
    got = turns.groupBy("conv_id", "alone").agg(F.array_sort(F.collect_list("t")).alias("ts"))
    n = F.size("ts")
    # The first turn of each block of one role, then the blocks as slices of the sorted turns.
    begins = F.filter(F.sequence(F.lit(0), n - 1), lambda i: (i == 0) | (F.get("ts", i)["role"] != F.get("ts", i - 1)["role"]))
    got = got.withColumn("begins", begins)
    blocks = F.transform(
        "begins",
        lambda i, k: F.struct(
            escape(F.get("ts", i)["role"]).alias("role"),
            F.get("ts", i)["role"].isin(*loss_roles).alias("loss"),
            F.transform(F.slice("ts", i + 1, F.coalesce(F.get("begins", k + 1), n) - i), lambda x: escape(x["text"])).alias("texts"),
        ),
    )
    got = got.withColumn("blocks", blocks)
    # Every text behind what precedes it in the string; lengths of these pieces place the spans.
    pieces = F.flatten(
        F.transform(
            "blocks",
            lambda b, k: F.transform(
                b["texts"],
                lambda t, j: F.struct(
                    F.concat(
                        F.when((j == 0) & (k > 0), F.lit(CLOSE)).otherwise(F.lit("")),
                        F.when(j == 0, F.concat(F.lit(OPEN), b["role"], F.lit(ROLE_END))).otherwise(F.lit(SEP)),
                    ).alias("mark"),
                    t.alias("text"),
                    b["loss"].alias("loss"),
                ),
            ),
        )
    )
    got = got.withColumn("pieces", pieces)
    formatted = F.concat(F.array_join(F.transform("pieces", lambda p: F.concat(p["mark"], p["text"])), ""), F.lit(CLOSE))
    long = lambda x: x.cast("long")

    def placed(sizes):
        before = prefix(F.transform(sizes, lambda x: x["mark"] + x["text"]), lambda a, b: a + b)
        spans = F.zip_with(sizes, before, lambda x, at: F.struct(long(at + x["mark"]).alias("start"), long(at + x["mark"] + x["text"]).alias("end"), x["loss"].alias("loss")))
        return F.transform(F.filter(spans, lambda x: x["loss"]), lambda x: F.struct(x["start"], x["end"]))

    sizes = F.transform("pieces", lambda p: F.struct(F.length(p["mark"]).alias("mark"), F.length(p["text"]).alias("text"), p["loss"].alias("loss")))
    return got.select("conv_id", formatted.alias("formatted"), let(sizes, placed).alias("loss_spans"))


def parse(formatted: Column) -> Column:
    """The turns, as array<struct<role,text>>, of a formatted string."""
    # What follows the last CLOSE is empty.
    blocks = F.filter(F.split(formatted, F.lit(r"</s>")), lambda b: b != "")

    def turns(b: Column) -> Column:
        role = F.substring_index(b, ROLE_END, 1)
        body = F.substr(b, F.length(role) + len(ROLE_END) + 1)
        plain = unescape(F.substr(role, F.lit(len(OPEN) + 1)))
        return F.transform(F.split(body, F.lit(SEP)), lambda t: F.struct(plain.alias("role"), unescape(t).alias("text")))

    return F.flatten(F.transform(blocks, turns))
