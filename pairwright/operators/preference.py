"""Training tables derived from pairs: preference triples, rendered prompts, tokens."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairwright.functions.labels import ColumnOrName, winners_valid
from pairwright.functions.text import blank, join_with_separator, judge_prompt, short_judge_prompt, whitespace_tokens
from pairwright.operators.rows import unpivot
from pairwright.schema import ID, TEXTS, WINNERS

#: Length caps of the models whose prompts are prepared.
TOKEN_CAPS = (1024, 1536, 1800, 2048, 3072)

#: Size of the id space of the default, hashing vocabulary.
HASH_VOCABULARY = 50_000

Encoder = Callable[[list[str]], list[list[int]]]


def preference_triples(df: DataFrame, keep: Sequence[str] = (), texts: Sequence[str] = TEXTS, winners: Sequence[str] = WINNERS) -> DataFrame:
    """(prompt, chosen, rejected) of every decided pair. Ties and rows without one clear winner are left out."""
    p, a, b = (blank(t) for t in texts)
    a_won = F.col(winners[0]) == 1
    decided = df.filter(winners_valid(winners) & (F.col(winners[2]) == 0))
    return decided.select(
        *keep,
        p.alias("prompt"),
        F.when(a_won, a).otherwise(b).alias("chosen"),
        F.when(a_won, b).otherwise(a).alias("rejected"),
    )


def triple_audit(df: DataFrame, winners: Sequence[str] = WINNERS) -> DataFrame:
    """How many rows become triples, are ties, or are invalid."""
    valid, tie = winners_valid(winners), F.coalesce(F.col(winners[2]), F.lit(0)) == 1
    return df.agg(
        F.count_if(valid & ~tie).alias("n_triples"), F.count_if(valid & tie).alias("n_ties"), F.count_if(~valid).alias("n_invalid")
    )


def rendered(df: DataFrame, style: str = "judge", keep: Sequence[str] = (ID,), name: str = "text") -> DataFrame:
    """Pairs as one text each. Styles: ``concat``, ``judge``, ``judge_short``."""
    styles = {"concat": join_with_separator, "judge": judge_prompt, "judge_short": short_judge_prompt}
    return df.select(*keep, styles[style]().alias(name))


def hash_ids(tokens: ColumnOrName, vocabulary: int = HASH_VOCABULARY) -> Column:
    """Token ids without a vocabulary file: the first seven hex digits of the token's md5, modulo the size."""
    tokens = F.col(tokens) if isinstance(tokens, str) else tokens
    return F.transform(
        tokens, lambda t: (F.conv(F.substring(F.md5(t), 1, 7), 16, 10).cast("long") % vocabulary).cast("int")
    )


def tokenize(df: DataFrame, text: str = "text", max_len: int = 2048, keep: Sequence[str] = (ID,)) -> DataFrame:
    """Whitespace tokens cut to ``max_len`` and hashed to ids; the source columns are dropped."""
    tokens = df.select(*keep, whitespace_tokens(text).alias("_tokens"))
    kept = F.slice("_tokens", 1, max_len)
    return tokens.select(*keep, hash_ids(kept).alias("input_ids"), F.size("_tokens").alias("n_tokens"))


def tokenize_with(
    df: DataFrame, load_encoder: Callable[[], Encoder], text: str = "text", max_len: int = 2048, keep: Sequence[str] = (ID,)
) -> DataFrame:
    """Like :func:`tokenize` with any tokenizer: ``load_encoder`` runs once per task and returns
    a function from a list of texts to lists of ids."""
    narrow = df.select(*keep, blank(text).alias("_text"))
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in narrow.schema.fields if f.name != "_text")
    schema = f"{fields}{', ' if fields else ''}input_ids array<int>, n_tokens int"
    names = list(keep)

    def encode(batches):
        encoder = None
        for batch in batches:
            encoder = encoder or load_encoder()
            ids = encoder(batch["_text"].tolist())
            out = batch[names].copy()
            out["n_tokens"] = [len(i) for i in ids]
            out["input_ids"] = [list(i[:max_len]) for i in ids]
            yield out[[*names, "input_ids", "n_tokens"]]

    return narrow.mapInPandas(encode, schema)


def vocabulary_encoder(path: str) -> Callable[[], Encoder]:
    """A loader for a tokenizer file every executor can read; needs the ``tokenizers`` package there."""

    def load() -> Encoder:
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        return lambda texts: [e.ids for e in tokenizer.encode_batch(texts, add_special_tokens=False)]

    return load


def truncation_report(df: DataFrame, n_tokens: str = "n_tokens", caps: Sequence[int] = TOKEN_CAPS) -> DataFrame:
    """Per length cap: rows, rows cut, share cut, mean tokens kept. All caps in one pass."""
    n = F.col(n_tokens)
    aggs = [F.count(n).alias("_n")]
    for cap in caps:
        aggs += [F.count_if(n > cap).alias(f"_cut{cap}"), F.avg(F.least(n, F.lit(cap))).alias(f"_kept{cap}")]
    rows = [
        {
            "max_len": F.lit(cap),
            "n_rows": F.col("_n"),
            "n_cut": F.col(f"_cut{cap}"),
            "share_cut": F.when(F.col("_n") > 0, F.col(f"_cut{cap}") / F.col("_n")),
            "mean_kept": F.col(f"_kept{cap}"),
        }
        for cap in caps
    ]
    return unpivot(df.agg(*aggs), [], rows)
