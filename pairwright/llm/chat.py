"""Chat formatting by prefix-target expansion, with DataFrame functions only.

Every assistant turn becomes an example of its own: all turns before it are context, and only its text is under the loss mask.
Turns that no example would hold, behind the last assistant turn, go into one more example with an empty mask, so a conversation can
be read back from its output. Marks of the template cannot appear in a role or text: ``&`` becomes ``&amp;`` and ``<|``
becomes ``&lt;|`` (and a line break in a role ``&#10;``), which :func:`unescaped` undoes.

An example is one string, so a conversation has to fit into a row; the expansion itself grows with the square of the turns.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

OPEN, CLOSE = "<|im_start|>", "<|im_end|>"
ANSWERS = "assistant"


def _swap(column: Column, old: str, new: str) -> Column:
    return F.replace(column, F.lit(old), F.lit(new))


def escaped(text: Column) -> Column:
    return _swap(_swap(text, "&", "&amp;"), "<|", "&lt;|")


def escaped_role(role: Column) -> Column:
    return _swap(escaped(role), "\n", "&#10;")


def unescaped(text: Column) -> Column:
    return _swap(_swap(_swap(text, "&#10;", "\n"), "&lt;|", "<|"), "&amp;", "&")


def examples(conversations: DataFrame, *, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """``(conv_id, example, is_last, text, loss_start, loss_end)``, offsets in code points with an exclusive end.

    Turns are ordered by number, then role, then text; repeated rows are turns of their own. Null roles and texts are empty, a null
    number comes first, and rows with a null id are one conversation. Extra columns are not read.
    """
    empty = lambda c: F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(""))
    rows = conversations.select(F.col(f"`{conv_id}`").alias("conv_id"), F.struct(F.col(f"`{turn}`").alias("turn"), empty(role).alias("role"), empty(text).alias("text")).alias("t"))
    whole = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("turns"))
    shown = F.transform("turns", lambda t: F.concat(F.lit(OPEN), escaped_role(t["role"]), F.lit("\n"), escaped(t["text"]), F.lit(CLOSE + "\n")))
    whole = whole.select("conv_id", shown.alias("shown"), F.transform("turns", lambda t: t["role"]).alias("roles"))
    each = whole.select("conv_id", "shown", F.posexplode("roles").alias("at", "role"), F.size("roles").alias("n"))
    each = each.where((F.col("role") == ANSWERS) | (F.col("at") == F.col("n") - 1))
    each = each.withColumn("context", F.array_join(F.slice("shown", F.lit(1), F.col("at")), "")).withColumn("own", F.element_at("shown", F.col("at") + 1))
    answer = F.col("role") == ANSWERS
    head, tail = len(OPEN) + len(ANSWERS) + 1, len(CLOSE) + 1
    context, own = F.length("context"), F.length("own")
    return each.select(
        "conv_id",
        F.col("at").alias("example"),
        (F.col("at") == F.col("n") - 1).alias("is_last"),
        F.concat("context", "own").alias("text"),
        F.when(answer, context + head).otherwise(context + own).alias("loss_start"),
        F.when(answer, context + own - tail).otherwise(context + own).alias("loss_end"),
    )


def masked_text(text: Column, start: Column, end: Column) -> Column:
    """The text under the loss mask, as it was before formatting."""
    return unescaped(F.substring(text, start + 1, end - start))


def turns_of(text: Column) -> Column:
    """``(role, text)`` of all turns of a formatted example."""
    pieces = F.filter(F.split(text, r"<\|im_end\|>\n"), lambda p: p != "")
    body = F.transform(pieces, lambda p: F.substring(p, len(OPEN) + 1, F.length(p)))
    return F.transform(
        body,
        lambda p: F.struct(
            unescaped(F.substring_index(p, "\n", 1)).alias("role"),
            unescaped(F.substring(p, F.instr(p, "\n") + 1, F.length(p))).alias("text"),
        ),
    )
