"""Toxicity by weak supervision: many noisy voters, a generative label model, a linear classifier on its posteriors.

Voters say "toxic" when a text holds at least c words with a given beginning (or a given whole word), shouts, or stacks marks; one more
voter says "clean" when none of them speaks, and the given labels are a voter like the others. Which beginnings make voters is mined
from a bounded sample of labelled rows. The label model estimates the prior, every voter's accuracies and the correlation of voters
within a class by expectation maximization; correlated voters share their weight. A logistic regression on the voters and a few counts
is fitted to the posteriors and scores every text.

Only the fitting reads a sample, of at most ``sample_rows`` labelled rows; scoring reads every text in whole. What goes to the driver
is bounded by the sample and by the number of voters.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from pairwright.llm.store import written
from pairwright.llm.texts import LOWER_VALUE, byte_sums, hashes_from, map_texts, per_text, word_spans

SAMPLE_ROWS = 8000
CANDIDATES = 20_000
VOTERS = 160
#: Bytes of a word's beginning; 0 is the whole word.
BEGINNINGS = (4, 5, 6, 7, 8, 0)
COUNTS = (1, 2, 3)
LEAST_TOXIC = 4
FOLDS, HELD_OUT = 5, 0


def held_out(id_column: Column, folds: int = FOLDS, fold: int = HELD_OUT) -> Column:
    return F.coalesce(F.crc32(id_column.cast("string")) % folds == fold, F.lit(False))


def pattern_counts(buf: np.ndarray, offs: np.ndarray, wanted: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(text number, pattern, count)``: how many words of a text have each beginning, for ``wanted`` patterns (sorted) or all."""
    starts, ends, first = word_spans(buf, offs)
    doc = np.repeat(np.arange(len(offs) - 1), np.diff(first))
    docs, patterns, sums = [], [], byte_sums(buf, LOWER_VALUE)
    for n in BEGINNINGS:
        some = np.flatnonzero(ends - starts >= n)
        a = starts[some]
        h = hashes_from(sums, a, a + n if n else ends[some]) ^ np.uint64(n)
        d = doc[some]
        if wanted is not None:
            h, d = _only(h, d, wanted)
        docs.append(d)
        patterns.append(h)
    d, h = np.concatenate(docs), np.concatenate(patterns)
    order = np.lexsort((h, d))
    d, h = d[order], h[order]
    if not len(d):
        return d, h, np.zeros(0, np.int64)
    new = np.flatnonzero(np.concatenate([[True], (d[1:] != d[:-1]) | (h[1:] != h[:-1])]))
    return d[new], h[new], np.diff(np.append(new, len(d)))


def _only(h: np.ndarray, d: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not len(wanted):
        return h[:0], d[:0]
    table = np.zeros(1 << 18, bool)
    table[(wanted >> np.uint64(46)).astype(np.int64)] = True
    maybe = np.flatnonzero(table[(h >> np.uint64(46)).astype(np.int64)])
    at = np.minimum(np.searchsorted(wanted, h[maybe]), len(wanted) - 1)
    hit = maybe[wanted[at] == h[maybe]]
    return h[hit], d[hit]


def style(buf: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """Per text: mostly capitals, stacked exclamation marks, masked words, and the logarithm of the length."""
    upper = per_text((buf >= 0x41) & (buf <= 0x5A), offs)
    lower = per_text((buf >= 0x61) & (buf <= 0x7A), offs)
    bangs = per_text(buf == 0x21, offs)
    masks = per_text(buf == 0x2A, offs)
    size = np.diff(offs)
    return np.stack([upper > lower, bangs * 50 > size, masks * 50 > size, np.log1p(size) / 10], axis=1).astype(np.float64)


STYLES = 4


def features(buf: np.ndarray, offs: np.ndarray, patterns: np.ndarray, least: np.ndarray) -> np.ndarray:
    """Votes of the voters (pattern, least count), then the style of each text."""
    distinct, code = np.unique(patterns, return_inverse=True)
    d, h, n = pattern_counts(buf, offs, distinct)
    counts = np.zeros((len(offs) - 1, max(1, len(distinct))), np.int64)
    counts[d, np.searchsorted(distinct, h)] = n
    return np.hstack([counts[:, code] >= least, style(buf, offs)])


def label_model(votes: np.ndarray, labels: np.ndarray, rounds: int = 20) -> tuple[np.ndarray, dict]:
    """Posterior of "toxic" for each row from 0/1 votes and 0/1 labels; accuracies, prior and voters' weights.

    Silence of a voter says nothing. The voter that says "clean" speaks when all others are silent.
    """
    n, m = votes.shape
    silent = ~votes.any(axis=1)
    speak = np.hstack([votes, silent[:, None], (labels == 1)[:, None], (labels == 0)[:, None]]).astype(np.float64)
    p = np.clip(labels.astype(np.float64), 0.05, 0.95)
    for _ in range(rounds):
        prior = np.clip(p.mean(), 1e-3, 1 - 1e-3)
        hit = np.stack([((1 - p) @ speak + 0.5) / ((1 - p).sum() + 1), (p @ speak + 0.5) / (p.sum() + 1)])
        shared = np.zeros((speak.shape[1], speak.shape[1]))
        for weight, mean in ((1 - p, hit[0]), (p, hit[1])):
            centred = speak - mean
            cov = (centred * weight[:, None]).T @ centred / max(weight.sum(), 1e-9)
            scale = np.sqrt(np.maximum(np.diag(cov), 1e-9))
            shared += (cov / scale / scale[:, None]) * weight.sum() / n
        np.fill_diagonal(shared, 0)
        weights = 1 / (1 + np.where(shared > 0.1, shared, 0).sum(axis=1))
        logit = np.log(prior / (1 - prior)) + speak @ (weights * np.log(hit[1] / hit[0]))
        new = 1 / (1 + np.exp(-np.clip(logit, -30, 30)))
        if np.abs(new - p).max() < 1e-6:
            p = new
            break
        p = new
    return p, {"prior": float(prior), "toxic": hit[1][:m], "clean": hit[0][:m], "weights": weights[:m]}


def fit_linear(x: np.ndarray, p: np.ndarray, ridge: float = 1.0, rounds: int = 25) -> np.ndarray:
    """Ridge logistic regression on soft labels by Newton steps; the last coefficient is the intercept."""
    x = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros(x.shape[1])
    penalty = np.full(x.shape[1], ridge)
    penalty[-1] = 1e-6
    for _ in range(rounds):
        q = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (q * (1 - q))[:, None]).T @ x + np.diag(penalty), x.T @ (q - p) + penalty * w)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w


def training_rows(docs: DataFrame, labels: DataFrame, id_column: str, text: str, label: str, rows: int) -> DataFrame:
    """At most ``rows`` labelled documents outside the held-out fold, chosen by a hash of the id: ``(doc_id, text, toxic)``.

    An id with several labels has the largest, one with several texts the smallest of them; labels other than 0 and 1, and null ids, are not used.
    """
    key = F.col(f"`{id_column}`")
    given = labels.select(key.alias("doc_id"), F.col(f"`{label}`").alias("toxic")).where(F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1))
    given = given.where(~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    chosen = given.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    texts = docs.select(key.alias("doc_id"), F.col(f"`{text}`").alias("text"))
    return texts.join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "toxic").agg(F.min("text").alias("text"))  # bounded by ``rows``


def mine_voters(sample: DataFrame, candidates: int, voters: int) -> tuple[np.ndarray, np.ndarray]:
    """Patterns and least counts of the voters that tell toxic rows of the sample from clean ones best."""

    def counted(rows: DataFrame, wanted: np.ndarray | None) -> DataFrame:
        def make():
            def compute(buf, offs):
                d, h, n = pattern_counts(buf, offs, wanted)
                per = np.bincount(d, minlength=len(offs) - 1)
                ends = np.concatenate([[0], np.cumsum(per)])
                h, n = h.view(np.int64), np.minimum(n, COUNTS[-1]).astype(np.int32)
                lists = [pa.array([x[a:b] for a, b in zip(ends[:-1], ends[1:])]) for x in (h, n)]
                return lists

            return compute

        made = map_texts(rows, "text", make, StructType.fromDDL("h array<bigint>, n array<int>"), ("toxic",))
        return made.select("toxic", F.explode(F.arrays_zip("h", "n")).alias("x")).select("toxic", "x.h", "x.n")

    often = counted(sample.where("toxic = 1"), None).groupBy("h").agg(F.count("*").alias("n")).where(F.col("n") >= LEAST_TOXIC)
    names = np.array([r["h"] for r in often.orderBy(F.desc("n"), "h").limit(candidates).collect()], np.int64).view(np.uint64)
    sums = [F.sum(F.when((F.col("toxic") == y) & (F.col("n") >= c), 1).otherwise(0)).alias(f"y{y}c{c}") for y in (0, 1) for c in COUNTS]
    rows = counted(sample, np.sort(names)).groupBy("h").agg(*sums).collect()
    total = {r["toxic"]: r["n"] for r in sample.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    n1, n0 = total.get(1, 0), total.get(0, 0)
    scored = []
    for r in rows:
        for c in COUNTS:
            a, b = r[f"y1c{c}"], r[f"y0c{c}"]
            if a < LEAST_TOXIC:
                continue
            rate = (a + b) / (n1 + n0)
            z = (a - rate * n1) / np.sqrt(max(rate * n1 * (1 - rate), 1e-9))
            lift = ((a + 0.5) / (n1 + 1)) / ((b + 0.5) / (n0 + 1))
            if z > 4 and lift > 3:
                scored.append((-z, r["h"], c))
    scored = sorted(scored)[:voters]
    return np.array([h for _, h, _ in scored], np.int64).view(np.uint64), np.array([c for _, _, c in scored], np.int64)


class Model:
    """Patterns, least counts and coefficients; small enough to travel with the tasks."""

    def __init__(self, patterns: np.ndarray, least: np.ndarray, weights: np.ndarray):
        self.patterns, self.least, self.weights = patterns, least, weights

    def scores(self, buf: np.ndarray, offs: np.ndarray) -> np.ndarray:
        x = features(buf, offs, self.patterns, self.least)
        return 1 / (1 + np.exp(-np.clip(x @ self.weights[:-1] + self.weights[-1], -30, 30)))


def fit(
    docs: DataFrame,
    labels: DataFrame,
    *,
    id_column: str = "doc_id",
    text: str = "text",
    label: str = "toxic",
    sample_rows: int = SAMPLE_ROWS,
    candidates: int = CANDIDATES,
    voters: int = VOTERS,
) -> Model:
    """Fit on at most ``sample_rows`` labelled rows. Without any, every text scores 0."""
    sample = written(training_rows(docs, labels, id_column, text, label, sample_rows), "toxic-sample")
    patterns, least = mine_voters(sample, candidates, voters)

    def make():
        def compute(buf, offs):
            return [[row.tobytes() for row in features(buf, offs, patterns, least)]]

        return compute

    rows = map_texts(sample, "text", make, StructType.fromDDL("x binary"), ("doc_id", "toxic")).orderBy("doc_id").collect()
    if not rows:
        return Model(patterns, least, np.concatenate([np.zeros(len(patterns) + STYLES), [-30.0]]))
    x = np.stack([np.frombuffer(r["x"]) for r in rows])
    y = np.array([r["toxic"] for r in rows])
    posterior, _ = label_model(np.hstack([x[:, : len(patterns)], x[:, len(patterns) : -1]]) > 0, y)
    return Model(patterns, least, fit_linear(x, posterior))


def scored(docs: DataFrame, model: Model, *, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns ``keep`` and ``score double``, from 0 to 1; a null text is scored as an empty one. Repeated rows get the same score."""
    return map_texts(docs, text, lambda: lambda buf, offs: [model.scores(buf, offs)], StructType.fromDDL("score double"), keep)


def without_toxic(docs: DataFrame, labels: DataFrame, *, text: str = "text", id_column: str = "doc_id", threshold: float = 0.5, **options) -> DataFrame:
    """The documents that score below ``threshold``, with the columns they came with."""
    model = fit(docs, labels, id_column=id_column, text=text, **options)
    names = docs.columns
    inner = docs.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(names)])
    found = scored(inner, model, text=f"c{names.index(text)}", keep=tuple(inner.columns))
    return found.where(F.col("score") < threshold).select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(names)])
