"""Self-join of documents by the Jaccard similarity of their word n-grams with chosen paths (Christiani and Pagh, 2017).

Each document is the set of its runs of five words (one run if it has fewer words), kept as sorted 64-bit hashes. Documents with the
same set are one node from the start. A node's set is embedded into a fixed number of min-hash coordinates. A run starts with all
nodes in one bucket; every bucket is split on sampled shared tokens: a coordinate with its value is taken as a token of the bucket with
probability 1 / (threshold x coordinates), by a hash that all members share, and nodes with that token meet in a child bucket. Buckets
of at most ``limit`` nodes are compared by brute force; larger ones are split again, at most ``depth`` times, and what is still
large then (copies that no token can part) is compared block by block. Two sets above the threshold share a child with probability of
at least 1 - 1/e per split; ``runs`` independent runs bring the recall to the target.

Candidates are compared by their coordinates first, with a margin that drops a pair at the threshold with a chance below ``FILTER_LOSS``, and then exactly, by whole sets.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from pairwright.llm.buckets import blocks, grouped, memberships, owned, padded, roots, runs, sized, whole_groups
from pairwright.llm.components import components
from pairwright.llm.store import written
from pairwright.llm.texts import map_texts, mix, window_hashes, word_hashes

WORDS = 5
THRESHOLD = 0.8
COORDINATES = 64
#: A pair at the threshold is missed with a chance of 1e-7 where one split was enough, 4e-5 after two and 6e-4 after three.
RUNS = 16
LIMIT = 64
DEPTH = 3
#: Chance of a pair at the threshold to be thrown away by its coordinates. All runs share them, so no other run brings it back.
FILTER_LOSS = 1e-7

_rng = np.random.default_rng(20240229)
_FACTORS = _rng.integers(1, 1 << 63, COORDINATES, np.uint64) * np.uint64(2) + np.uint64(1)
_SHIFTS = _rng.integers(0, 1 << 63, COORDINATES, np.uint64)


def shingles(words: np.ndarray, first: np.ndarray, width: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of ``width`` words inside a text, and where each text's runs begin."""
    count = np.diff(first)
    runs_of = np.where(count >= width, count - width + 1, np.minimum(count, 1))
    begin = np.concatenate([[0], np.cumsum(runs_of)])
    long = window_hashes(words, width)
    at = np.arange(begin[-1]) - np.repeat(begin[:-1], runs_of) + np.repeat(first[:-1], runs_of)
    out = np.zeros(len(at), np.uint64)
    whole = np.repeat(count >= width, runs_of)
    out[whole] = long[at[whole]]
    for k in np.flatnonzero((count > 0) & (count < width)):  # short texts: all their words are one run
        out[begin[k]] = mix(window_hashes(words[first[k] : first[k + 1]], int(count[k])) + np.uint64(count[k]))[0]
    return out, begin


def set_digest(values: np.ndarray) -> int:
    return int.from_bytes(hashlib.blake2b(values.tobytes(), digest_size=8).digest(), "little", signed=True)


def _sketch(width: int):
    def compute(buf, offs):
        words, first = word_hashes(buf, offs)
        flat, begin = shingles(words, first, width)
        n = len(begin) - 1
        some = np.flatnonzero(np.diff(begin))
        node, size = np.zeros(n, np.int64), np.diff(begin)
        for k in some.tolist():
            node[k] = set_digest(np.unique(flat[begin[k] : begin[k + 1]]))
        signature = np.zeros((n, COORDINATES), np.uint32)
        if len(some):
            for c in range(COORDINATES):
                signature[some, c] = np.minimum.reduceat((flat * _FACTORS[c] + _SHIFTS[c]) >> np.uint64(32), begin[some]).astype(np.uint32)
        return [pa.array(node, mask=size == 0), [row.tobytes() for row in signature]]

    return compute


def sketches(docs: DataFrame, id_column: str, text: str, width: int) -> DataFrame:
    """``(doc_id, node, signature)``; node, the hash of the set, is null for texts without words and rows without an id."""
    inner = docs.select(F.col(f"`{id_column}`").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    made = map_texts(inner, "text", lambda: _sketch(width), StructType.fromDDL("node bigint, signature binary"), ("doc_id",))
    return made.withColumn("node", F.when(F.col("doc_id").isNotNull(), F.col("node")))


def _children(rows: DataFrame, starts: list[int] | None, chance: float) -> DataFrame:
    """Child buckets ``(bucket, node)`` of rows ``(node, signature[, bucket])``, or of the root buckets ``starts``."""
    bound = np.uint64(int(chance * 2**64))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tag = mix(np.arange(1, COORDINATES + 1, dtype=np.uint64) * np.uint64(0xA0761D6478BD642F))
        for batch in batches:
            if not batch.num_rows:
                continue
            values = np.frombuffer(b"".join(batch.column("signature").to_pylist()), np.uint32).reshape(-1, COORDINATES).astype(np.uint64)
            token = mix(values + tag)
            names = batch.column("node").to_numpy()
            above = [np.array([[s]], np.uint64) for s in starts] if starts else [batch.column("bucket").to_numpy().view(np.uint64)[:, None]]
            for parent in above:
                draw = mix(token ^ mix(parent + np.uint64(0x632BE59BD9B4E019)))
                row, coordinate = np.nonzero(draw < bound)
                if len(row):
                    child = mix(draw[row, coordinate] ^ np.uint64(0x2545F4914F6CDD1D)).view(np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array(child), pa.array(names[row])], names=["bucket", "node"])

    return rows.mapInArrow(run, "bucket bigint, node bigint")


def leaves(nodes: DataFrame, threshold: float, n_runs: int, limit: int, depth: int) -> DataFrame:
    """``(bucket, node, n)``: the buckets left to compare, after all runs."""
    chance = 1 / (threshold * COORDINATES)
    level = written(_children(nodes.select("node", "signature"), [int(x) for x in _rng_starts(n_runs)], chance), "paths")
    done = None
    for k in range(depth):
        here = sized(level)
        last = k == depth - 1
        leaf = here if last else here.where(F.col("n") <= limit)
        done = leaf if done is None else done.unionByName(leaf)
        if not last:
            big = here.where(F.col("n") > limit).select("bucket", "node").join(nodes.select("node", "signature"), "node")
            level = written(_children(big, None, chance), "paths", narrow=True)
    return done


def _rng_starts(n: int) -> np.ndarray:
    return np.random.default_rng(77).integers(1, 1 << 62, n)


def _alike(least: int):
    """Members of a group that own a pair whose coordinates agree in at least ``least`` places."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_groups(batches):
            key, side, bucket = (table.column(c).to_numpy() for c in ("group_id", "side", "bucket"))
            values = np.frombuffer(b"".join(table.column("signature").to_pylist()), np.uint32).reshape(-1, COORDINATES)
            lists = padded(table.column("buckets"))
            wanted = np.zeros(len(key), bool)
            for d in range(1, len(key)):
                i = np.flatnonzero(key[d:] == key[:-d])
                if not len(i):
                    break
                i = i[(side[i] == 0) | (side[i] != side[i + d])]
                i = i[np.count_nonzero(values[i] == values[i + d], axis=1) >= least]
                i = i[owned(lists, bucket, i, i + d)]
                wanted[i] = wanted[i + d] = True
            if wanted.any():
                yield from table.select(["group_id", "side", "bucket", "node"]).filter(pa.array(wanted)).to_batches()

    return run


def overlaps(sets: list[np.ndarray], step: int = 8192) -> np.ndarray:
    """How many hashes each two sets share."""
    n = len(sets)
    if n == 2:
        both = len(np.intersect1d(*sets, assume_unique=True))
        return np.array([[len(sets[0]), both], [both, len(sets[1])]], np.int64)
    sizes = [len(s) for s in sets]
    values, code, often = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    row = np.repeat(np.arange(n), sizes)
    dense = np.cumsum(often > 1) - 1  # hashes of one set alone cannot be shared
    some = often[code] > 1
    row, code = row[some], dense[code[some]]
    order = np.argsort(code, kind="stable")
    row, code = row[order], code[order]
    out = np.zeros((n, n), np.float64)
    for at in range(0, int(code[-1]) + 1 if len(code) else 0, step):
        lo, hi = np.searchsorted(code, [at, at + step])
        block = np.zeros((n, min(step, int(code[-1]) + 1 - at)), np.float32)
        block[row[lo:hi], code[lo:hi] - at] = 1
        out += block @ block.T
    out = np.rint(out).astype(np.int64)
    out[np.arange(n), np.arange(n)] = sizes
    return out


def _exact(threshold: float):
    """Links of the members of each group: ``(node, links, root)`` with the copies of their partners counted."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_groups(batches):
            key, side, bucket, node, copies = (table.column(c).to_numpy() for c in ("group_id", "side", "bucket", "node", "copies"))
            raw, lists = table.column("shingles").combine_chunks(), padded(table.column("buckets"))
            found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
            for lo, hi in zip(*(x.tolist() for x in runs(key))):
                at = np.arange(lo, hi)
                at = at[np.concatenate([[True], node[at[1:]] != node[at[:-1]]])]  # rows that repeat a document
                if len(at) < 2:
                    continue
                i, j = np.triu_indices(len(at), 1)
                fits = (side[at[i]] == 0) | (side[at[i]] != side[at[j]])
                i, j = i[fits], j[fits]
                mine = owned(lists, bucket, at[i], at[j])
                i, j = i[mine], j[mine]
                if not len(i):
                    continue
                shared = overlaps([np.frombuffer(raw[k].as_py(), np.uint64) for k in at.tolist()])
                sizes = np.diag(shared)
                both = shared[i, j]
                near = both >= threshold * (sizes[i] + sizes[j] - both) - 1e-9
                linked = np.zeros(shared.shape, bool)
                linked[i[near], j[near]] = linked[j[near], i[near]] = True
                some = linked.any(axis=1)
                if some.any():
                    found.append((node[at][some], (linked @ copies[at])[some], roots(linked, node[at])[some]))
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x).astype(np.int64)) for x in zip(*found)], names=["node", "links", "root"])

    return run


def least_alike(threshold: float, loss: float = FILTER_LOSS) -> int:
    """The most coordinates that may be asked to agree so that a pair at the threshold agrees in fewer with a chance of at most ``loss``."""
    fewer = 0.0
    for k in range(COORDINATES + 1):
        fewer += comb(COORDINATES, k) * threshold**k * (1 - threshold) ** (COORDINATES - k)
        if fewer > loss:
            return k
    return COORDINATES


def jaccard_classes(
    docs: DataFrame,
    *,
    id_column: str = "doc_id",
    text: str = "text",
    words: int = WORDS,
    threshold: float = THRESHOLD,
    n_runs: int = RUNS,
    limit: int = LIMIT,
    depth: int = DEPTH,
) -> DataFrame:
    """One row per document row: ``doc_id, class_id`` (smallest id reachable by links, itself included), ``n_links`` (other document
    rows with a Jaccard similarity of at least ``threshold``) and ``kept`` (doc_id = class_id).

    Documents with the same set of n-grams are linked. A text that is null, empty or has no words links with nothing. A row without
    an id gets a null class, no links, and is kept. A repeated row counts as one more copy. Extra columns are not read.
    """
    found = _classes(docs, id_column, text, words, threshold, n_runs, limit, depth).drop("node", "component")
    return found.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("class_id"), F.lit(True)))


def _classes(docs: DataFrame, id_column: str, text: str, words: int, threshold: float, n_runs: int, limit: int, depth: int) -> DataFrame:
    """``(doc_id, node, component, class_id, n_links)``: one row per document row, with its set and the component that holds it."""
    sketch = written(sketches(docs, id_column, text, words), "sketches")
    nodes = sketch.where("node IS NOT NULL").groupBy("node").agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies"), F.first("signature").alias("signature"))
    nodes = written(nodes, "sets", narrow=True)
    leaf = written(leaves(nodes, threshold, n_runs, limit, depth), "leaves", narrow=True)
    lists = memberships(leaf)
    met = blocks(leaf).join(nodes.select("node", "signature").join(lists, "node"), "node")
    alike = written(grouped(met).mapInArrow(_alike(least_alike(threshold)), "group_id bigint, side int, bucket bigint, node bigint"), "alike", narrow=True)

    wanted = alike.select("node").distinct().join(nodes.select("node", "rep", "copies"), "node").withColumnRenamed("node", "of")
    whole = docs.select(F.col(f"`{id_column}`").alias("rep"), F.col(f"`{text}`").alias("text")).join(wanted, "rep")

    def make():
        def compute(buf, offs):
            flat, begin = shingles(*word_hashes(buf, offs), words)
            sets = [np.unique(flat[a:b]) for a, b in zip(begin[:-1], begin[1:])]
            return [[set_digest(s) for s in sets], [s.tobytes() for s in sets]]

        return compute

    sets = map_texts(whole, "text", make, StructType.fromDDL("node bigint, shingles binary"), ("of", "copies")).where("node = of")
    judged = alike.join(sets.select("node", "copies", "shingles").join(lists, "node"), "node")
    links = written(grouped(judged).mapInArrow(_exact(threshold), "node bigint, links bigint, root bigint"), "links", narrow=True)

    component = components(links.select(F.col("node").alias("a"), F.col("root").alias("b")))
    counted = links.groupBy("node").agg(F.sum("links").alias("links"))
    state = nodes.select("node", "rep", "copies").join(counted, "node", "left").join(component, "node", "left")
    state = state.withColumn("component", F.coalesce("component", "node"))
    smallest = state.groupBy("component").agg(F.min("rep").alias("class_id"))
    state = state.join(smallest, "component").select("node", "component", "class_id", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    joined = sketch.select("doc_id", "node").join(state, "node", "left")
    return joined.select(
        "doc_id",
        "node",
        "component",
        F.coalesce("class_id", "doc_id").alias("class_id"),
        F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"),
    )


def _set_of(width: int):
    """The node of each text: the hash of its set, or null."""

    def compute(buf, offs):
        flat, begin = shingles(*word_hashes(buf, offs), width)
        return [pa.array([set_digest(np.unique(flat[a:b])) if b > a else None for a, b in zip(begin[:-1], begin[1:])], pa.int64())]

    return compute


def one_per_class(
    docs: DataFrame,
    *,
    id_column: str = "doc_id",
    text: str = "text",
    words: int = WORDS,
    threshold: float = THRESHOLD,
    n_runs: int = RUNS,
    limit: int = LIMIT,
    depth: int = DEPTH,
) -> DataFrame:
    """One document of each class, the one with the smallest id, with the columns it came with.

    Rows are told apart by id and set, so rows that repeat an id with unrelated texts are judged one by one. Where several rows of a class
    have its smallest id, the one with the smallest set hash stays, and of rows with the same set the one whose hash over all columns is smallest. Rows without an id and texts without words
    link with nothing and all stay. The result does not depend on partitioning.
    """
    from pyspark.sql import Window

    found = _classes(docs, id_column, text, words, threshold, n_runs, limit, depth).where("node IS NOT NULL AND doc_id = class_id")
    chosen = found.groupBy("component").agg(F.min("node").alias("chosen"), F.first("class_id").alias("smallest")).drop("component")
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(f"`{id_column}`").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    marked = map_texts(packed, "text", lambda: _set_of(words), StructType.fromDDL("node bigint"), ("row", "doc_id"))
    linked = F.col("node").isNotNull() & F.col("doc_id").isNotNull()
    same = Window.partitionBy("chosen", "smallest").orderBy(F.xxhash64("row"))
    stay = marked.where(linked).join(chosen, (F.col("node") == F.col("chosen")) & (F.col("doc_id") == F.col("smallest")))
    stay = stay.withColumn("place", F.row_number().over(same)).where("place = 1")
    return stay.select("row").unionByName(marked.where(~linked).select("row")).select("row.*")
