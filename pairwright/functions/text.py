"""Prompt text: blanks, prefixes, separators, templates and whitespace tokens."""

from __future__ import annotations

import string
import textwrap
from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from pairwright.functions.labels import ColumnOrName, as_col
from pairwright.schema import TEXTS

# --- Fixed values: prompt formats, which trained models expect character for character. -----------

SEPARATOR = "[SEP]"

JUDGE_TEMPLATE = textwrap.dedent("""\
    <|im_start|>system
    You are a helpful assistant acting as a judge. Please evaluate which response is better.<|im_end|>
    <|im_start|>user
    Evaluate the two responses to the user question.

    Question:
    {p}

    Candidate Response A:
    {a}

    Candidate Response B:
    {b}

    You must choose the preferred answer.
    Respond strictly with one of: A, B, Tie.
    Do not provide any explanation.<|im_end|>
    <|im_start|>assistant
""")

SHORT_JUDGE_TEMPLATE = textwrap.dedent("""\
    <|im_start|>system
    You are a helpful assistant acting as a judge.<|im_end|>
    <|im_start|>user
    Question: {p}
    Response A: {a}
    Response B: {b}
    Which response is better?<|im_end|>
    <|im_start|>assistant
""")

FIELD_CAP = 1200

# --------------------------------------------------------------------------------------------------

#: The same characters in Java regular expressions and in RE2.
WHITESPACE = "[ \\t\\n\\r\\f]+"


def blank(c: ColumnOrName) -> Column:
    """NULL text becomes the empty string."""
    return F.coalesce(as_col(c), F.lit(""))


def prefix(c: ColumnOrName, n: int, ellipsis: str = "") -> Column:
    """The first ``n`` code points, for display fields and length caps."""
    cut = F.substring(blank(c), 1, n)
    return F.concat(cut, F.lit(ellipsis)) if ellipsis else cut


def join_with_separator(texts: Sequence[ColumnOrName] = TEXTS, separator: str = SEPARATOR) -> Column:
    """``prompt [SEP] a [SEP] b``. Blanks first: ``concat_ws`` would drop NULLs and lose a field."""
    return F.concat_ws(f" {separator} ", *[blank(t) for t in texts])


def render(template: str, fields: Mapping[str, Column]) -> Column:
    """Fill ``{name}`` places of a template.

    The template is cut at its places on the driver and becomes one ``concat``, so braces and percent
    signs in the data are plain text.
    """
    parts: list[Column] = []
    for literal, name, _, _ in string.Formatter().parse(template):
        if literal:
            parts.append(F.lit(literal))
        if name is not None:
            parts.append(fields[name])
    return F.concat(*parts)


def judge_prompt(texts: Sequence[ColumnOrName] = TEXTS, template: str = JUDGE_TEMPLATE) -> Column:
    p, a, b = (blank(t) for t in texts)
    return render(template, {"p": p, "a": a, "b": b})


def short_judge_prompt(texts: Sequence[ColumnOrName] = TEXTS, cap: int = FIELD_CAP) -> Column:
    p, a, b = (prefix(t, cap) for t in texts)
    return render(SHORT_JUDGE_TEMPLATE, {"p": p, "a": a, "b": b})


def whitespace_tokens(c: ColumnOrName) -> Column:
    return F.array_remove(F.split(blank(c), WHITESPACE), "")


def token_count(c: ColumnOrName) -> Column:
    """Number of whitespace tokens, without building the array of them."""
    return F.regexp_count(blank(c), F.lit("[^ \\t\\n\\r\\f]+"))
