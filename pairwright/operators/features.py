"""Features of a pair, derived from its texts.

Features come in two layers. *Measures* belong to one text (length, style flags) and can be taken where
the text is stored. *Pair features* combine the measures of prompt, response A and response B, so a
table of pairs can be built from narrow measures without moving any text.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairwright.functions.labels import ColumnOrName
from pairwright.functions.text import blank, token_count
from pairwright.operators.rows import row_chunks
from pairwright.schema import ID, TEXTS, columns_like, require

# --- Fixed values: words and patterns of the style flags, valid as Java regular expressions and in RE2. ---

STYLE_WORDS = {
    "is_polite": ("please", "thank", "thanks", "welcome", "happy to help", "glad"),
    "has_disclaimer": ("as an ai", "i am not a", "not legal advice", "not medical advice", "consult a professional"),
    "is_refusal": ("i cannot", "i can't", "i am unable", "i'm unable", "i won't", "sorry, but"),
    "is_code_task": ("python", "java", "javascript", "sql", "code", "function", "algorithm", "script", "```"),
}
CODE_WORDS = ("def ", "class ", "import ", "return ", "function ", "var ", "const ")
LIST_PATTERN = r"\n[ ]*([-*]|[0-9]+[.)])[ ]"
CODE_PATTERN = "```|\n[ ]*(" + "|".join(CODE_WORDS) + ")"
EMOJI_PATTERN = r"[\x{1F300}-\x{1FAFF}\x{2600}-\x{27BF}]"

# --------------------------------------------------------------------------------------------------


def word_pattern(words: Sequence[str]) -> str:
    """Any of the words, in any case, with no letter before or after it."""
    return f"(?i)[^A-Za-z]({'|'.join(words)})([^A-Za-z]|$)"


#: Searched in the text after a line break, so that its start looks like any other start of a line or word.
FLAG_PATTERNS = {
    "has_list": LIST_PATTERN,
    "has_code": CODE_PATTERN,
    "has_emoji": EMOJI_PATTERN,
    **{name: word_pattern(words) for name, words in STYLE_WORDS.items()},
}
#: Flags reported for both responses; the code-task flag belongs to the prompt.
RESPONSE_FLAGS = tuple(name for name in FLAG_PATTERNS if name != "is_code_task")
MEASURES = ("len", "word_len", *FLAG_PATTERNS)
SIDES = ("p", "a", "b")


def text_measures(text: ColumnOrName) -> dict[str, Column]:
    """Measures of one text: length, mean word length, style flags, code-task flag.

    A regular expression runs only on texts that pass a plain substring test it implies.
    """
    t = blank(text)
    words = token_count(t)
    letters = F.length(F.translate(t, " \t\n\r\f", ""))
    lowered, searched = F.lower(t), F.concat(F.lit("\n"), t)
    may_match = {
        "has_list": F.lit(True),
        "has_code": _contains_any(t, ("```", *CODE_WORDS)),
        "has_emoji": F.octet_length(t) > F.length(t),
        **{name: _contains_any(lowered, words) for name, words in STYLE_WORDS.items()},
    }
    flags = {
        name: F.when(may_match[name] & F.regexp_like(searched, F.lit(pattern)), 1).otherwise(0)
        for name, pattern in FLAG_PATTERNS.items()
    }
    return {"len": F.length(t), "word_len": letters / F.greatest(words, F.lit(1)), **flags}


def _contains_any(text: Column, words: Sequence[str]) -> Column:
    out = F.contains(text, F.lit(words[0]))
    for w in words[1:]:
        out = out | F.contains(text, F.lit(w))
    return out


def combine_measures(df: DataFrame, keep: Sequence[str] = (ID,)) -> DataFrame:
    """Pair features from columns ``<side>_<measure>`` with side p, a or b.

    Lengths, ratios, expansions and differences; flags of both responses; the code-task flag of the prompt; and two
    interactions, named ``<left>_x_<right>``.
    """
    require(df, [f"{s}_len" for s in SIDES], "measure table")
    ratio, task = "a_len / (b_len + 1)", "p_is_code_task"
    expansion = {s: f"{s}_len / (p_len + 1)" for s in ("a", "b")}
    out = {
        "len_p": "CAST(p_len AS DOUBLE)",
        "len_a": "CAST(a_len AS DOUBLE)",
        "len_b": "CAST(b_len AS DOUBLE)",
        "len_diff": "CAST(a_len - b_len AS DOUBLE)",
        "len_ratio": ratio,
        "expansion_a": expansion["a"],
        "expansion_b": expansion["b"],
        "expansion_diff": f"{expansion['a']} - {expansion['b']}",
        "read_diff": "a_word_len - b_word_len",
        **{f"{flag}_{s}": f"{s}_{flag}" for flag in RESPONSE_FLAGS for s in ("a", "b")},
        "is_code_task": task,
        "len_diff_x_is_code_task": f"CAST((a_len - b_len) * {task} AS DOUBLE)",
        "len_ratio_x_read_diff": f"{ratio} * (a_word_len - b_word_len)",
    }
    return df.selectExpr(*keep, *[f"{expression} AS {name}" for name, expression in out.items()])


def pair_features(pairs: DataFrame, keep: Sequence[str] = (ID,), texts: Sequence[str] = TEXTS) -> DataFrame:
    """Features of a table that already holds the three texts."""
    columns = [c.alias(f"{s}_{m}") for s, t in zip(SIDES, texts) for m, c in text_measures(t).items()]
    return combine_measures(pairs.select(*keep, *columns), keep)


def token_cosine(texts: Sequence[ColumnOrName] = TEXTS[1:]) -> Column:
    """Cosine of the token-count vectors of the two responses; 0 when one of them has no tokens.

    Pairs are compared by array operations, chunk by chunk of an Arrow batch, so that a task's memory does not follow the number of its
    tokens. Exploding tokens and grouping them again would shuffle every token of every pair to reach the same number.
    """
    a, b = (blank(t) for t in texts)
    return _count_cosine()(a, b)


#: Bytes of texts whose tokens are held at a time, unless one pair alone has more.
CHUNK_BYTES = 1 << 20


def _count_cosine():
    @F.arrow_udf("double")
    def cosine(a: pa.Array, b: pa.Array) -> pa.Array:
        return chunked_cosines(a, b)

    return cosine


def chunked_cosines(a: pa.Array, b: pa.Array, chunk_bytes: int = CHUNK_BYTES) -> pa.Array:
    """Cosine of the token counts of two texts, row by row."""
    sizes = sum(pc.binary_length(t).to_numpy().astype(np.int64) for t in (a, b))
    found = [_cosines(*(t.slice(lo, hi - lo).to_pandas() for t in (a, b))) for lo, hi in row_chunks(sizes, chunk_bytes)]
    return pa.array(np.concatenate(found) if found else [], pa.float64())


def _cosines(a: pd.Series, b: pd.Series) -> np.ndarray:
    def tokens(texts: pd.Series) -> tuple[np.ndarray, np.ndarray]:
        each = texts.str.findall("[^ \t\n\r\f]+").explode().dropna()
        return each.index.to_numpy(), each.to_numpy()

    (row_a, token_a), (row_b, token_b) = tokens(a), tokens(b)
    codes = pd.factorize(np.concatenate([token_a, token_b]))[0].astype(np.int64)
    width = int(codes.max(initial=0)) + 1
    left, n_left = np.unique(row_a * width + codes[: len(token_a)], return_counts=True)
    right, n_right = np.unique(row_b * width + codes[len(token_a) :], return_counts=True)
    both, i, j = np.intersect1d(left, right, assume_unique=True, return_indices=True)

    def per_row(keys: np.ndarray, values: np.ndarray) -> np.ndarray:
        return np.bincount(keys // width, weights=values, minlength=len(a))

    dot = per_row(both, n_left[i] * n_right[j])
    norms = np.sqrt(per_row(left, n_left * n_left)) * np.sqrt(per_row(right, n_right * n_right))
    return np.divide(dot, norms, out=np.zeros(len(a)), where=norms > 0)


# Names of the report groups, of their members and of the parts members' names hold.
LENGTHS = ("len_p", "len_a", "len_b", "len_diff", "len_ratio", "expansion_a", "expansion_b", "expansion_diff")
STYLES = (
    "cosine_sim", "sentiment_gap", "read_diff", "has_emoji_a", "has_emoji_b", "is_polite_a", "is_polite_b",
    "has_disclaimer_a", "has_disclaimer_b", "is_refusal_a", "is_refusal_b",
)
FORMAT_PART, TOPIC_PARTS, PRODUCT_PART = "has_", ("cluster_id", "is_code_task"), "_x_"


def feature_groups(df: DataFrame) -> dict[str, list[str]]:
    """Report groups of a feature table, each limited to the columns that exist; groups without one are left out."""
    groups = {
        "Length & Ratio": [c for c in LENGTHS if c in df.columns],
        "Formatting": columns_like(df, contains=(FORMAT_PART,), exclude=STYLES),
        "Style & Semantic": [c for c in STYLES if c in df.columns],
        "Topic & Task": columns_like(df, contains=TOPIC_PARTS),
        "Interaction": columns_like(df, contains=(PRODUCT_PART,)),
    }
    return {name: columns for name, columns in groups.items() if columns}
