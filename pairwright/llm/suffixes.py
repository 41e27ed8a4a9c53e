"""Benchmark decontamination by suffix arrays over the training texts.

Training texts are indexed shard by shard: a shard is a run of whole texts inside a task. Its words become numbers of the
benchmark's vocabulary. Only stretches of benchmark words as long as the shortest window can hold a match, so the suffix array covers
those and nothing else; this loses no match. Benchmark suffixes whose first window a shard holds, found by a hash of each window
in the shard, are binary-searched in its array, so the work follows the shard and not the benchmark; each occurrence of at least a
window is extended to the longest verbatim match, with its place in both texts.

The benchmark travels to the tasks in blocks of bounded size: a small one in one block, a larger one in as many
passes over the documents as it has blocks. Nothing is shuffled, so common passages and hot sources cost no more than other rows.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from pairwright.llm.buckets import runs
from pairwright.llm.store import dropped, written
from pairwright.llm.texts import chunks, list_array, map_texts, window_hashes, word_hashes

WINDOW = 10
#: Text of one benchmark block that is sent to the tasks.
BLOCK_BYTES = 16 << 20
#: Occurrences of benchmark suffixes that a shard looks at together.
STEP = 1 << 20
MATCH = "item_id string, item_start int, doc_start int, n_words int"


class Probe:
    """The suffixes of some benchmark items as numbers of their vocabulary."""

    def __init__(self, items: list[tuple[str, str]], window: int):
        self.names = [name for name, _ in items]
        words, first = [], [0]
        for _, _, buf, offs in chunks(pa.array([text for _, text in items], pa.string())):
            hashes, ends = word_hashes(buf, offs)
            words.append(hashes)
            first.extend((ends[1:] + first[-1]).tolist())
        flat = np.concatenate(words) if words else np.zeros(0, np.uint64)
        self.vocabulary, codes = np.unique(flat, return_inverse=True)
        self.filter = np.zeros(1 << 20, bool)
        self.filter[(self.vocabulary >> np.uint64(44)).astype(np.int64)] = True
        counts = np.diff(first)
        self.item = np.repeat(np.arange(len(counts)), counts)
        self.start = np.arange(len(flat)) - np.repeat(np.asarray(first[:-1], np.int64), counts)
        left = np.repeat(counts, counts) - self.start  # words from here to the item's end
        self.need = np.minimum(window, np.repeat(counts, counts))
        self.tokens = np.append(codes.astype(np.int64) + 1, 0)
        self.left = left
        self.suffixes = np.flatnonzero(left >= self.need)
        self.shortest = int(self.need.min()) if len(flat) else 0
        self.heads = {}
        for n in np.unique(self.need[self.suffixes]).tolist():
            q = self.suffixes[self.need[self.suffixes] == n]
            h = window_hashes(self.tokens.astype(np.uint64), n)[q]
            order = np.argsort(h, kind="stable")
            self.heads[n] = h[order], q[order]

    def encode(self, words: np.ndarray) -> np.ndarray:
        """Vocabulary numbers from 1; 0 for every other word."""
        out = np.zeros(len(words), np.int64)
        maybe = np.flatnonzero(self.filter[(words >> np.uint64(44)).astype(np.int64)])
        at = np.searchsorted(self.vocabulary, words[maybe])
        at[at == len(self.vocabulary)] = 0
        known = self.vocabulary[at] == words[maybe]
        out[maybe[known]] = at[known] + 1
        return out

    def present(self, tokens: np.ndarray) -> np.ndarray:
        """The suffixes whose first window occurs in ``tokens``; equal hashes of other windows may add some."""
        found = [np.zeros(0, np.int64)]
        for n, (heads, q) in self.heads.items():
            here = np.sort(window_hashes(tokens.astype(np.uint64), n))
            here = here[np.append(True, here[1:] != here[:-1])[: len(here)]]
            low, high = np.searchsorted(heads, here, "left"), np.searchsorted(heads, here, "right")
            found.append(q[_ranges(low, high - low)])
        return np.sort(np.concatenate(found))


def _ranges(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The numbers ``start .. start + size - 1`` of every pair, one after another."""
    return np.arange(size.sum()) + np.repeat(start - (np.cumsum(size) - size), size)


def suffix_array(tokens: np.ndarray, depth: int) -> np.ndarray:
    """Suffixes in order of their first ``depth`` tokens at least, by prefix doubling."""
    n = len(tokens)
    _, rank = np.unique(tokens, return_inverse=True)
    order, covered = np.argsort(rank, kind="stable"), 1
    while covered < depth and n:
        behind = np.zeros(n, np.int64)
        if covered < n:
            behind[:-covered] = rank[covered:] + 1
        key = rank * (n + 1) + behind
        order = np.argsort(key, kind="stable")
        ranked = key[order]
        rank = np.empty(n, np.int64)
        rank[order] = np.cumsum(np.concatenate([[0], ranked[1:] != ranked[:-1]]))
        covered *= 2
        if rank[order[-1]] == n - 1:
            break
    return order


def _bound(tokens: np.ndarray, order: np.ndarray, probe: Probe, q: np.ndarray, above: bool) -> np.ndarray:
    """For each of the benchmark suffixes ``q``, how many training suffixes come before it (or, ``above``, not after it)."""
    need = probe.need[q]
    lo, hi = np.zeros(len(q), np.int64), np.full(len(q), len(order), np.int64)
    deepest = int(need.max())
    for _ in range(int(math.log2(len(order))) + 1):
        mid = np.minimum((lo + hi) >> 1, len(order) - 1)
        sign = np.zeros(len(q), np.int8)
        for k in range(deepest):
            at = np.flatnonzero((sign == 0) & (k < need))
            if not len(at):
                break
            place = np.minimum(order[mid[at]] + k, len(tokens) - 1)
            sign[at] = np.sign(tokens[place] - probe.tokens[q[at] + k])
        forward = (lo < hi) & ((sign <= 0) if above else (sign < 0))
        lo, hi = np.where(forward, mid + 1, lo), np.where((lo < hi) & ~forward, mid, hi)
    return lo


def shard_matches(probe: Probe, words: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, ...]:
    """Longest verbatim matches of one shard: text number, word in the text, benchmark suffix and length, by place."""
    none = tuple(np.zeros(0, np.int64) for _ in range(4))
    if not probe.shortest or not len(words):
        return none
    codes = probe.encode(words)
    known = np.append(codes > 0, False)
    doc = np.repeat(np.arange(len(first) - 1), np.diff(first))
    begins = np.flatnonzero(known[:-1] & (np.concatenate([[True], ~known[:-2]]) | np.concatenate([[True], doc[1:] != doc[:-1]])))
    stops = np.flatnonzero(known[:-1] & (~known[1:] | np.concatenate([doc[1:] != doc[:-1], [True]]))) + 1
    long = stops - begins >= probe.shortest
    begins, stops = begins[long], stops[long]
    if not len(begins):
        return none
    lengths = stops - begins + 1  # each stretch with a 0 behind it
    offsets = np.cumsum(lengths) - lengths
    places = np.arange(lengths.sum()) - np.repeat(offsets, lengths) + np.repeat(begins, lengths)
    tokens = codes[np.minimum(places, len(codes) - 1)]
    tokens[offsets + lengths - 1] = 0
    known = probe.present(tokens)
    if not len(known):
        return none
    order = suffix_array(tokens, int(min(lengths.max(), probe.need.max())))
    low, high = _bound(tokens, order, probe, known, False), _bound(tokens, order, probe, known, True)
    found = np.maximum(high - low, 0)
    parts, part = [], np.cumsum(found) // STEP
    for lo, hi in zip(*(x.tolist() for x in runs(part))):
        q, at = np.repeat(known[lo:hi], found[lo:hi]), order[_ranges(low[lo:hi], found[lo:hi])]
        begun = (probe.start[q] > 0) & (at > 0) & (tokens[np.maximum(at - 1, 0)] == probe.tokens[np.maximum(q - 1, 0)])
        parts.append((q[~begun], at[~begun]))
    q, at = (np.concatenate(x) for x in zip(*parts))
    size = probe.need[q].copy()
    going = np.arange(len(q))
    while len(going):
        going = going[size[going] < probe.left[q[going]]]
        going = going[tokens[at[going] + size[going]] == probe.tokens[q[going] + size[going]]]
        size[going] += 1
    place = places[at]
    by = np.lexsort((size, q, place))
    place, q, size = place[by], q[by], size[by]
    return doc[place], place - first[doc[place]], q, size


def benchmark_blocks(items: DataFrame, item_id: str, text: str, block_bytes: int = BLOCK_BYTES) -> tuple[int, Iterator[list[tuple[str | None, str]]]]:
    """How many blocks of about ``block_bytes`` the benchmark has, and the blocks, each collected when it is asked for. Items without a text
    are none; those without an id are items whose name is null."""
    items = items.select(F.col(f"`{item_id}`").cast("string").alias("i"), F.col(f"`{text}`").alias("t")).where("t IS NOT NULL")
    total = items.agg(F.sum(F.octet_length("t"))).first()[0] or 0
    n = max(1, math.ceil(total / block_bytes))

    def blocks():
        for k in range(n):
            part = items if n == 1 else items.where(F.pmod(F.xxhash64("i", "t"), F.lit(n)) == k)
            yield sorted(((r["i"], r["t"]) for r in part.distinct().collect()), key=lambda x: (x[0] is None, x[0] or "", x[1]))

    return n, blocks()


@functools.lru_cache(maxsize=2)
def _probe(items: tuple[tuple[str, str], ...], window: int) -> Probe:
    return Probe(list(items), window)


def benchmark_matches(
    docs: DataFrame,
    items: DataFrame,
    *,
    text: str = "text",
    keep: tuple[str, ...] = ("doc_id",),
    item_id: str = "item_id",
    item_text: str = "text",
    window: int = WINDOW,
    block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """One row per document row: the columns ``keep``, ``n_words long`` and ``matches``, an array of
    ``(item_id, item_start, doc_start, n_words)`` in words.

    A match is a longest run of equal words, of at least ``window`` words or of the whole item if that has fewer. Null and empty texts
    have no words and no matches; repeated rows and ids give a row each; a benchmark without words matches nothing; kept columns named
    like a result column give way to it. Matches of an item without an id have a null ``item_id``. Matches are sorted by their fields.

    A benchmark of several blocks takes a pass over the documents for each: one block at a time is collected and sent, and its matches are
    written with the columns still needed before the next.
    """
    spark = docs.sparkSession
    out, columns = docs, list(dict.fromkeys(keep))
    n_blocks, blocks = benchmark_blocks(items, item_id, item_text, block_bytes)
    for k, block in enumerate(blocks):
        sent = spark.sparkContext.broadcast(tuple(block))

        def make(sent=sent):
            probe = _probe(sent.value, window)

            def compute(buf, offs):
                words, first = word_hashes(buf, offs)
                doc, place, q, size = shard_matches(probe, words, first)
                names = np.array(probe.names or [""], object)[probe.item[q]]
                flat = pa.StructArray.from_arrays(
                    [pa.array(names, pa.string()), *(pa.array(x.astype(np.int32)) for x in (probe.start[q], place, size))],
                    names=["item_id", "item_start", "doc_start", "n_words"],
                )
                return np.diff(first), list_array(flat, np.bincount(doc, minlength=len(offs) - 1))

            return compute

        if n_blocks == 1:
            found = map_texts(out, text, make, StructType.fromDDL(f"n_words bigint, matches array<struct<{MATCH}>>"), columns)
            return found.withColumn("matches", F.array_sort("matches"))
        earlier, before = out, ["__m__"] if k else []
        passing = columns if k == n_blocks - 1 else list(dict.fromkeys([*columns, text]))
        out = map_texts(out, text, make, StructType.fromDDL(f"__n__ bigint, __new__ array<struct<{MATCH}>>"), passing + before)
        out = written(out.withColumn("__m__", F.concat(*before, "__new__")).drop("__new__"), "matches")
        sent.unpersist()
        if k:
            dropped(earlier)
    kept = [F.col(f"`{c}`") for c in columns if c not in ("n_words", "matches")]
    return out.select(*kept, F.col("__n__").alias("n_words"), F.array_sort("__m__").alias("matches"))


def hit_words(matches: Column) -> Column:
    """How many words of a document lie inside its matches."""
    spans = F.array_sort(F.transform(matches, lambda m: F.struct(m["doc_start"].alias("a"), (m["doc_start"] + m["n_words"]).alias("b"))))
    start = F.struct(F.lit(0).cast("bigint").alias("n"), F.lit(0).alias("e"))
    step = lambda s, m: F.struct(
        (s["n"] + F.greatest(m["b"] - F.greatest(m["a"], s["e"]), F.lit(0))).alias("n"), F.greatest(m["b"], s["e"]).alias("e")
    )
    return F.aggregate(spans, start, step, lambda s: s["n"])


def item_ids(matches: Column) -> Column:
    """The distinct items of the matches, sorted as strings."""
    return F.array_sort(F.array_distinct(F.transform(matches, lambda m: m["item_id"])))


def without_contaminated(docs: DataFrame, items: DataFrame, *, text: str = "text", **options) -> DataFrame:
    """The documents without a match, with the columns they came with. Documents without words stay."""
    names = docs.columns
    inner = docs.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(names)])
    found = benchmark_matches(inner, items, text=f"c{names.index(text)}", keep=tuple(inner.columns), **options)
    return found.where(F.size("matches") == 0).select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(names)])


