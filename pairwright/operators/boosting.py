"""Multi-class gradient boosting by histograms: one ensemble with a softmax over all classes.

Features are binned once; bin 0 holds missing values. Many models (one per fold, preset or trial) grow in step: a wave is one Spark job
that sums gradients, hessians and rows by bin for the leaves that all models ask about, and returns the best split of each leaf. The driver holds
only trees. Leaves are split best first up to ``num_leaves``; a wave asks about all leaves that are still in the running, so a tree takes
about as many waves as it is deep, not as it has leaves. Up to ``PARTITION_ROWS`` rows a task holds all binned rows, needs no other and grows whole
models one after the other; the trees are the same. There, features are counted together by joint keys, and before the first tree counts are all it takes. Each split learns on which side missing values go. The loss on the held-out fold is taken after
every round, and a model stops when it has not improved for ``patience`` rounds.

Gradients are rounded to 2^-30 and summed as whole numbers, so trees do not depend on how rows are partitioned. Rows lie in
blocks of binned features. Waves keep the margins of the models that still grow beside them, written anew every ``REFRESH`` rounds, and add up the few
trees since; a task that grows whole models adds up all trees once and stores no margins.
"""

from __future__ import annotations

import heapq
import json
import math
import pickle
import random
from collections.abc import Iterator, Mapping, Sequence
from dataclasses import asdict, dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from pairwright.functions.labels import winner_class
from pairwright.functions.probs import is_number
from pairwright.schema import CLASSES, FOLD, ID, N_FOLDS, PREDS, WINNERS, require
from pairwright.session import new_path
from pairwright.sources.writers import write_parquet

K = len(CLASSES)
#: Bins of a feature besides that of missing values.
MAX_BINS = 63
BLOCK_ROWS = 1 << 13
CHUNK_ROWS = 1 << 13
#: Bins of features that are counted together, at most: few enough for a core's cache.
JOINT_BINS = 1 << 12
JOINT_CHUNK = 1 << 14
#: Nodes of fewer rows are summed feature by feature, in chunks that hold several of them.
JOINT_ROWS = 1 << 12
#: Rows of a partition, about. Models whose rows all lie in one task grow there; others in waves, with a shuffle of their histograms. Sums of this many
#: gradients are exact as doubles; a row of 37 features takes some 260 bytes of a task.
PARTITION_ROWS = 1 << 22
REFRESH = 12
#: Rows times rounds that a task grows a model by before the driver takes its trees.
STEP_ROWS = 1 << 28
#: Nodes that all models grow by, at most, before the driver takes their trees; a node takes some 41 bytes.
STEP_NODES = 1 << 20
PATIENCE = 50
SCALE = float(1 << 30)
LEAST_GAIN = 1e-9
_SPLIT = np.dtype([("node", "<i4"), ("feature", "<i4"), ("bin", "<i4"), ("missing_left", "?"), ("gain", "<f8"), ("whole", "<f8", 3), ("left", "<f8", 3)])


@dataclass(frozen=True)
class Boost:
    """How a model grows. ``num_leaves`` None lets every leaf above ``max_depth`` split that gains by it."""

    learning_rate: float = 0.1
    max_depth: int = 6
    num_leaves: int | None = None
    feature_fraction: float = 1.0
    bagging_fraction: float = 1.0
    bagging_freq: int = 1
    min_child_samples: int = 1
    min_child_weight: float = 1e-3
    lambda_l1: float = 0.0
    lambda_l2: float = 0.0
    #: factor of p (1 - p) in the hessian
    hessian: float = 1.5


# --- Fixed values: parameters found by earlier searches, and the ranges those searches drew from. ---

PRESETS = {
    "leafwise": Boost(
        learning_rate=0.0169,
        num_leaves=32,
        max_depth=9,
        feature_fraction=0.67,
        bagging_fraction=0.88,
        bagging_freq=6,
        min_child_samples=16,
        lambda_l1=0.0001,
        lambda_l2=0.006,
    ),
    "depthwise": Boost(
        learning_rate=0.015,
        max_depth=6,
        bagging_fraction=0.625,
        feature_fraction=0.867,
        min_child_weight=4,
        lambda_l2=9e-8,
        lambda_l1=2e-6,
        hessian=2.0,
    ),
}

#: name -> (kind, low, high); kinds: float, int, log (log-uniform).
SEARCH_SPACES = {
    "leafwise": {
        "learning_rate": ("float", 0.01, 0.1),
        "num_leaves": ("int", 20, 100),
        "max_depth": ("int", 4, 10),
        "feature_fraction": ("float", 0.6, 1.0),
        "bagging_fraction": ("float", 0.6, 1.0),
        "bagging_freq": ("int", 1, 7),
        "min_child_samples": ("int", 10, 100),
        "lambda_l1": ("log", 1e-8, 10.0),
        "lambda_l2": ("log", 1e-8, 10.0),
    },
    "depthwise": {
        "learning_rate": ("float", 0.01, 0.1),
        "max_depth": ("int", 3, 10),
        "bagging_fraction": ("float", 0.6, 1.0),
        "feature_fraction": ("float", 0.6, 1.0),
        "min_child_weight": ("int", 1, 10),
        "lambda_l2": ("log", 1e-8, 10.0),
        "lambda_l1": ("log", 1e-8, 10.0),
    },
}

# --------------------------------------------------------------------------------------------------


@dataclass(frozen=True)
class Member:
    """One model of a fleet: it learns from all folds but ``fold``."""

    name: str
    fold: int
    params: Boost


@dataclass(frozen=True)
class Binned:
    """A training table in blocks of binned rows."""

    path: str
    features: tuple[str, ...]
    edges: tuple[tuple[float, ...], ...]
    parts: int
    #: rows with a label, by fold and class
    counts: tuple[tuple[int, ...], ...]

    @property
    def widths(self) -> tuple[int, ...]:
        """Bins of every feature, that of missing values included."""
        return tuple(len(e) + 2 for e in self.edges)

    @property
    def width(self) -> int:
        """Bins of the widest feature."""
        return max(self.widths, default=2)


def bin_edges(df: DataFrame, features: Sequence[str], max_bins: int = MAX_BINS) -> tuple[tuple[float, ...], ...]:
    """Upper bounds of all bins but the last, from quantile sketches of the usable values; one aggregation for all features."""
    steps = [i / max_bins for i in range(1, max_bins)]
    usable = lambda c: F.when(is_number(F.col(f"`{c}`")), F.col(f"`{c}`").cast("double"))
    found = df.agg(*[F.percentile_approx(usable(c), steps, 1000).alias(f"q{i}") for i, c in enumerate(features)]).first()
    return tuple(tuple(sorted(set(q or []))) for q in found)


def bin_table(
    df: DataFrame,
    features: Sequence[str],
    k: int = N_FOLDS,
    key: str = ID,
    fold: str = FOLD,
    winners: Sequence[str] = WINNERS,
    edges: Sequence[Sequence[float]] | None = None,
    partition_rows: int = PARTITION_ROWS,
) -> Binned:
    """Bin the features and write the rows with a label and a fold in 0..k-1 in blocks; no other row teaches a model.

    NULL, NaN and infinite values are missing. The table is read for its counts, for the edges and for the blocks, so give one that is stored.
    """
    require(df, [key, fold, *features, *winners], "training table")
    label = winner_class(winners)
    rows = df.where(F.col(fold).between(0, k - 1) & label.isNotNull())
    edges = tuple(tuple(map(float, e)) for e in edges) if edges is not None else bin_edges(rows, features)
    seen = {(r["f"], r["y"]): r["count"] for r in rows.groupBy(F.col(fold).cast("int").alias("f"), label.cast("int").alias("y")).count().collect()}
    counts = tuple(tuple(seen.get((f, y), 0) for y in CLASSES) for f in range(k))
    parts = max(1, -(-sum(map(sum, counts)) // partition_rows))
    values = F.array(*[F.when(is_number(F.col(f"`{c}`")), F.col(f"`{c}`").cast("double")).otherwise(float("nan")) for c in features])
    plain = rows.select(F.xxhash64(key).alias("row"), F.col(fold).cast("tinyint").alias("fold"), label.cast("tinyint").alias("label"), values.alias("values"))

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, BLOCK_ROWS):
                part = batch.slice(lo, BLOCK_ROWS)
                n = part.num_rows
                x = part.column(3).flatten().to_numpy(zero_copy_only=False).reshape(n, len(edges))
                bins = np.zeros(x.shape, np.uint8)
                for i, edge in enumerate(edges):
                    usable = ~np.isnan(x[:, i])
                    bins[usable, i] = 1 + np.searchsorted(edge, x[usable, i], "left")
                parts = [part.column(i).to_numpy(zero_copy_only=False).tobytes() for i in range(3)]
                yield pa.RecordBatch.from_arrays([pa.array([n], pa.int32()), *[pa.array([p], pa.binary()) for p in (*parts, bins.tobytes())]], names=["n", "row", "fold", "label", "bins"])

    spread = plain if parts == 1 else plain.repartition(parts, "row")  # rows of a single part are binned where they lie
    made = spread.mapInArrow(blocks, "n int, row binary, fold binary, label binary, bins binary")
    path = write_parquet(made.withColumn("part", F.lit(0) if parts == 1 else F.spark_partition_id()), new_path(df.sparkSession, "binned"))
    return Binned(path, tuple(features), edges, parts, counts)


# ---------------------------------------------------------------- trees


@dataclass
class Tree:
    """Nodes as arrays; a leaf has feature -1. Its values hold the learning rate."""

    feature: np.ndarray
    bin: np.ndarray
    missing_left: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    gain: np.ndarray
    n: np.ndarray

    def leaves(self, bins: np.ndarray) -> np.ndarray:
        """The leaf of every row."""
        at = np.zeros(len(bins), np.int32)
        rows = np.arange(len(bins))
        while True:
            f = self.feature[at[rows]]
            rows = rows[f >= 0]
            if not len(rows):
                return at
            here = at[rows]
            b = bins[rows, self.feature[here]]
            left = np.where(b == 0, self.missing_left[here], b <= self.bin[here])
            at[rows] = np.where(left, self.left[here], self.right[here])

    def add_to(self, margin: np.ndarray, columns: np.ndarray) -> None:
        """Add every row's value; ``columns`` are bins by feature. Rows are dealt from node to node, a node at a time."""
        todo: list[tuple[int, np.ndarray | None]] = [(0, None)]
        while todo:
            k, rows = todo.pop()
            if self.feature[k] < 0:
                margin[slice(None) if rows is None else rows] += self.value[k]
                continue
            sides = _dealt(columns[self.feature[k]], rows, self.bin[k], self.missing_left[k])
            todo += zip((int(self.left[k]), int(self.right[k])), sides)


def _dealt(column: np.ndarray, rows: np.ndarray | None, at: int, missing_left: bool) -> tuple[np.ndarray, np.ndarray]:
    """The rows (None: all) left and right of a split."""
    bins = column if rows is None else column.take(rows)
    left = bins <= at
    if not missing_left:
        left &= bins != 0
    sides = np.flatnonzero(left), np.flatnonzero(~left)
    return sides if rows is None else tuple(rows.take(side) for side in sides)


def _shrunk(g, l1: float):
    return np.sign(g) * np.maximum(np.abs(g) - l1, 0.0)


def _score(g, h, p: Boost):
    return _shrunk(g, p.lambda_l1) ** 2 / (h + p.lambda_l2 + 1e-300)


def leaf_value(g: float, h: float, p: Boost) -> float:
    return float(-_shrunk(g, p.lambda_l1) / (h + p.lambda_l2)) if h + p.lambda_l2 > 0 else 0.0


def best_splits(hist: np.ndarray, nodes: Sequence[int], features: np.ndarray, p: Boost) -> np.ndarray:
    """The best split of each node from its sums ``[gradient, hessian, rows] x node x feature x bin``; equal gains go to the first feature and
    bin, missing values to the right."""
    sums = hist.astype(np.float64)
    sums[:2] /= SCALE
    whole = sums[:, :, 0, :].sum(-1)
    upto = np.cumsum(sums[..., 1:], axis=-1)
    left = np.stack([upto, upto + sums[..., :1]], axis=-1)
    g, h, c = left
    all_g, all_h, all_c = (w[:, None, None, None] for w in whole)
    ok = (c >= p.min_child_samples) & (all_c - c >= p.min_child_samples) & (h >= p.min_child_weight) & (all_h - h >= p.min_child_weight)
    with np.errstate(divide="ignore", invalid="ignore"):
        gain = _score(g, h, p) + _score(all_g - g, all_h - h, p) - _score(all_g, all_h, p)
    gain = np.where(ok, gain, -np.inf).reshape(len(nodes), -1)
    best = gain.argmax(1)
    out = np.zeros(len(nodes), _SPLIT)
    f, b, side = np.unravel_index(best, left.shape[2:])
    out["node"], out["feature"], out["bin"], out["missing_left"] = nodes, features[f], b + 1, side == 1
    out["gain"] = gain[np.arange(len(nodes)), best]
    out["whole"], out["left"] = whole.T, left[:, np.arange(len(nodes)), f, b, side].T
    return out


@dataclass
class Grower:
    """A tree while it grows: nodes that were asked about, and those that may still be split."""

    params: Boost
    nodes: list[dict] = field(default_factory=lambda: [{"depth": 0, "sums": None, "split": None, "kids": None}])

    def learn(self, found: np.ndarray) -> None:
        for s in found:
            node = self.nodes[s["node"]]
            node["sums"], node["split"] = tuple(s["whole"]), s if s["gain"] > LEAST_GAIN else False

    def _chosen(self) -> tuple[list[int], bool]:
        """Nodes that best-first growth splits as far as is known, and whether nothing unknown could change that."""
        limit = self.params.num_leaves or 1 << self.params.max_depth
        heap, chosen, sure = [], [], True

        def push(k: int) -> None:
            nonlocal sure
            split = self.nodes[k]["split"]
            if split is None:
                sure = False
            elif split is not False:
                heapq.heappush(heap, (-float(split["gain"]), k))

        push(0)
        while heap and len(chosen) < limit - 1:
            k = heapq.heappop(heap)[1]
            chosen.append(k)
            for kid in self.nodes[k]["kids"] or ():
                push(kid)
            sure &= self.nodes[k]["kids"] is not None
        return chosen, sure

    def wanted(self) -> list[int]:
        """Nodes whose best split has to be known before growth can go on; none when the tree is done."""
        if self.nodes[0]["sums"] is None:
            return [0]
        while True:
            chosen, sure = self._chosen()
            if sure:
                return []
            for k in chosen:
                node = self.nodes[k]
                if node["kids"] is None:
                    left = np.array(node["split"]["left"])
                    node["kids"] = tuple(len(self.nodes) + i for i in range(2))
                    for sums in (left, np.array(node["sums"]) - left):
                        open_ = node["depth"] + 1 < self.params.max_depth and sums[2] >= 2 * self.params.min_child_samples
                        self.nodes.append({"depth": node["depth"] + 1, "sums": tuple(sums), "split": None if open_ else False, "kids": None})
            unknown = [k for k, node in enumerate(self.nodes) if node["split"] is None]
            if unknown:
                return unknown

    def tree(self, chosen: Sequence[int] | None = None) -> Tree:
        """The tree made of the chosen splits, by default of all asked for so far; values are those of its leaves."""
        partial = chosen is None
        split = {k for k, n in enumerate(self.nodes) if n["kids"]} if partial else set(chosen)
        order, place = [0], {0: 0}
        if partial:  # node numbers stay
            order, place = list(range(len(self.nodes))), {k: k for k in range(len(self.nodes))}
        else:
            for k in order:
                for kid in self.nodes[k]["kids"] if k in split else ():
                    place[kid] = len(order)
                    order.append(kid)
        p = self.params
        picked = [(self.nodes[k], k in split) for k in order]
        s = lambda name, missing: [n["split"][name] if inner else missing for n, inner in picked]
        kids = [[place[x] for x in n["kids"]] if inner else [-1, -1] for n, inner in picked]
        return Tree(
            np.array(s("feature", -1), np.int32),
            np.array(s("bin", 0), np.int32),
            np.array(s("missing_left", False), bool),
            np.array([x[0] for x in kids], np.int32),
            np.array([x[1] for x in kids], np.int32),
            np.array([0.0 if inner or n["sums"] is None else p.learning_rate * leaf_value(n["sums"][0], n["sums"][1], p) for n, inner in picked]),
            np.array(s("gain", 0.0), np.float64),
            np.array([0 if n["sums"] is None else int(n["sums"][2]) for n, _ in picked], np.int64),
        )

    def finished(self) -> Tree:
        return self.tree(self._chosen()[0])


# ---------------------------------------------------------------- sampling


def sampled_features(n: int, fraction: float, seed: int, name: str, fold: int, at: int, cls: int) -> np.ndarray:
    """The features a tree may use, ascending."""
    size = min(n, max(1, math.ceil(n * fraction)))
    return np.array(sorted(random.Random(f"{seed}/{name}/{fold}/{at}/{cls}").sample(range(n), size)), np.int64)


def in_bag(row: np.ndarray, p: Boost, seed: int, at: int) -> np.ndarray:
    """Which rows a round draws, by a hash of the row's key: the same in any partitioning. A draw holds for ``bagging_freq`` rounds."""
    if p.bagging_fraction >= 1:
        return np.ones(len(row), bool)
    x = row.view(np.uint64) ^ np.uint64((seed * 0x9E3779B97F4A7C15 + (at // max(1, p.bagging_freq)) * 0xBF58476D1CE4E5B9) % (1 << 64))
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x94D049BB133111EB)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xD6E8FEB86659FD93)
    return (x >> np.uint64(11)).astype(np.float64) / float(1 << 53) < p.bagging_fraction


def softmax_columns(margin: np.ndarray) -> np.ndarray:
    """Probabilities of margins by class; a class is a row of the array."""
    p = margin - margin.max(0)
    np.exp(p, out=p)
    p /= p.sum(0)
    return p


def softmax_rows(margin: np.ndarray) -> np.ndarray:
    return softmax_columns(np.ascontiguousarray(margin.T)).T


def class_gradients(p: np.ndarray, hit: np.ndarray, factor: float) -> tuple[np.ndarray, np.ndarray]:
    """Gradients and hessians of the log loss by the margin of one class, as whole multiples of 1 / SCALE; ``hit`` marks the rows of the class."""
    return np.rint((p - hit) * SCALE), np.rint(np.maximum(factor * p * (1 - p), 1e-9) * SCALE)


# ---------------------------------------------------------------- fitting


def _block(n: int, row: bytes, fold: bytes, label: bytes, bins: bytes, n_features: int) -> dict[str, np.ndarray]:
    return {"row": np.frombuffer(row, np.int64), "fold": np.frombuffer(fold, np.int8), "label": np.frombuffer(label, np.int8), "bins": np.frombuffer(bins, np.uint8).reshape(n, n_features)}


def _blocks(batch: pa.RecordBatch, plan: tuple, active: frozenset[int]) -> Iterator[tuple[int, dict[str, np.ndarray], np.ndarray]]:
    """Each active model of each block in a batch, with the block's arrays and the model's margins."""
    priors, groups, n_features, kept, trees = plan
    for n, row, fold, label, bins, grp, margins in zip(*(batch.column(i).to_pylist() for i in range(7))):
        stored = [m for m in kept if m % groups == grp]
        held = dict(zip(stored, np.frombuffer(margins, np.float64).reshape(len(stored), n, K))) if margins else {}
        block = _block(n, row, fold, label, bins, n_features)
        for m in range(grp, len(priors), groups):
            if m in active:
                margin = held[m].copy() if m in held else np.tile(priors[m], (n, 1))
                for found in trees[m]:
                    for c, tree in enumerate(found):
                        margin[:, c] += tree.value[tree.leaves(block["bins"])]
                yield m, block, margin


def _held_loss(label: np.ndarray, p: np.ndarray) -> int:
    """The log losses of held-out rows, summed as whole multiples of 1 / SCALE."""
    return int(np.rint(-np.log(np.maximum(p[np.arange(len(label)), label], 1e-15)) * SCALE).astype(np.int64).sum())


def _sums(columns: np.ndarray, rows: np.ndarray | None, slot: np.ndarray | None, n: int, g: np.ndarray, h: np.ndarray, cols: np.ndarray, width: int) -> np.ndarray:
    """Gradients, hessians and rows of ``n`` nodes by feature and bin; ``columns`` are bins by feature, ``slot`` the node of every one of the
    ``rows``. None stands for all rows, and for a single node."""
    size = len(g) if rows is None else len(rows)
    out = np.zeros((3, len(cols), n * width))
    for lo in range(0, size, CHUNK_ROWS):  # few enough rows for a core's cache; those of a node lie together or in few chunks
        some = slice(lo, lo + CHUNK_ROWS) if rows is None else rows[lo : lo + CHUNK_ROWS]
        weights = g[some], h[some], None
        here = None if slot is None else slot[lo : lo + CHUNK_ROWS]
        first, last = (0, 0) if here is None else (int(here.min()), int(here.max()))
        base = None if first == last else (here - first) * width
        at = slice(first * width, (last + 1) * width)
        for i, f in enumerate(cols):
            keys = columns[f][some]
            keys = keys.astype(np.int64) if base is None else base + keys
            for j in range(3):
                out[j, i, at] += np.bincount(keys, weights[j], at.stop - at.start)
    return out.astype(np.int64).reshape(3, len(cols), n, width).swapaxes(1, 2)


@dataclass(frozen=True)
class Joint:
    """Features counted together: the bin of each is a digit of one key. Their own sums are those of the joint bins, added up."""

    features: tuple[int, ...]
    widths: tuple[int, ...]

    def keys(self, columns: np.ndarray) -> np.ndarray:
        out = np.zeros(columns.shape[1], np.uint16)
        for f, w in zip(self.features, self.widths):
            out *= np.uint16(w)
            out += columns[f]
        return out


def joints(widths: Sequence[int], most: int = JOINT_BINS) -> list[Joint]:
    """All features, dealt over as few joint keys as first fit finds, the widest first."""
    found: list[list[int]] = []
    for f in sorted(range(len(widths)), key=lambda f: (-widths[f], f)):
        for other in found:
            if math.prod(widths[o] for o in other) * widths[f] <= most:
                other.append(f)
                break
        else:
            found.append([f])
    return [Joint(tuple(fs), tuple(widths[f] for f in fs)) for fs in found]


@dataclass(frozen=True)
class Flat:
    """Gradients of one class before the first tree: all rows have the same margin."""

    hit: np.ndarray
    g_hit: float
    g_miss: float
    h: float

    @classmethod
    def of(cls, g: np.ndarray, h: np.ndarray, hit: np.ndarray) -> Flat:
        first = lambda rows, x: float(x[rows.argmax()]) if rows.any() else 0.0
        return cls(hit.astype(np.uint16), first(hit, g), first(~hit, g), float(h[0]) if len(h) else 0.0)


def _joined(columns: np.ndarray, widths: Sequence[int]) -> np.ndarray:
    """The joint keys of all rows, a row of the result for each of :func:`joints`."""
    return np.stack([j.keys(columns) for j in joints(widths)])


def _joint_sums(joint: Sequence[Joint], keys: np.ndarray, rows: np.ndarray | None, g: np.ndarray, h: np.ndarray, cols: np.ndarray, width: int, flat: Flat | None) -> np.ndarray:
    """What :func:`_sums` gives for one node, from joint keys. Where all rows have one margin, counts say all: gradients take two values, hessians one."""
    size = len(g) if rows is None else len(rows)
    place = {int(f): i for i, f in enumerate(cols)}
    used = [(j, k) for j, k in zip(joint, keys) if not place.keys().isdisjoint(j.features)]
    total = [np.zeros((3, math.prod(j.widths))) if flat is None else np.zeros(2 * math.prod(j.widths), np.int64) for j, _ in used]
    for lo in range(0, size, JOINT_CHUNK):
        some = slice(lo, lo + JOINT_CHUNK)
        mine = (lambda x: x[some]) if rows is None else (lambda x, some=rows[some]: x.take(some))
        if flat is None:
            weights = mine(g), mine(h), None
        else:
            hit = mine(flat.hit)
        for (_, key), out in zip(used, total):
            if flat is None:
                here = mine(key).astype(np.int64)
                for sums, w in zip(out, weights):
                    sums += np.bincount(here, w, len(sums))
            else:
                out += np.bincount(mine(key) * np.uint16(2) + hit, None, len(out))
    out = np.zeros((3, len(cols), width))
    for (j, _), found in zip(used, total):
        if flat is not None:
            misses, hits = found.reshape(-1, 2).T.astype(np.float64)
            found = np.stack([hits * flat.g_hit + misses * flat.g_miss, (hits + misses) * flat.h, hits + misses])
        found = found.reshape(3, *j.widths)
        for at, f in enumerate(j.features):
            if f in place:
                out[:, place[f], : j.widths[at]] = found.sum(tuple(i + 1 for i in range(len(j.widths)) if i != at))
    return out.astype(np.int64)


def _grown(who: Member, columns: np.ndarray, g: np.ndarray, h: np.ndarray, cols: np.ndarray, width: int, joint: Sequence[Joint] = (), keys: np.ndarray | None = None, flat: Flat | None = None) -> Tree:
    """A whole tree, where all rows of the model are at hand, each with the open node it lies in. Of two siblings the smaller is summed, the other is
    what their parent leaves."""
    grower, known = Grower(who.params), {}
    rows: dict[int, np.ndarray | None] = {0: None}
    while nodes := grower.wanted():
        derived: dict[int, tuple[int, int]] = {}
        for k in [k for k in rows if grower.nodes[k]["kids"]]:
            kids, split = grower.nodes[k]["kids"], grower.nodes[k]["split"]
            rows.update(zip(kids, _dealt(columns[split["feature"]], rows.pop(k), split["bin"], split["missing_left"])))
            small, large = sorted(kids, key=lambda x: (grower.nodes[x]["sums"][2], x))
            derived[large] = (k, small)
        wanted = set(nodes)
        direct = sorted({derived[k][1] if k in derived else k for k in wanted})
        size = lambda k: len(g) if rows[k] is None else len(rows[k])
        large = [k for k in direct if joint and size(k) >= JOINT_ROWS]
        known.update({k: _joint_sums(joint, keys, rows[k], g, h, cols, width, flat) for k in large})
        direct = [k for k in direct if k not in known]
        if direct == [0]:
            known[0] = _sums(columns, None, None, 1, g, h, cols, width)[:, 0]
        elif direct:
            slot = np.repeat(np.arange(len(direct)), [len(rows[k]) for k in direct])
            total = _sums(columns, np.concatenate([rows[k] for k in direct]), slot, len(direct), g, h, cols, width)
            known.update({k: total[:, i] for i, k in enumerate(direct)})
        known.update({k: known[parent] - known[small] for k, (parent, small) in derived.items() if k in wanted})
        grower.learn(best_splits(np.stack([known[k] for k in nodes], axis=1), nodes, cols, who.params))
    return grower.finished()


def _most_leaves(p: Boost) -> int:
    return min(p.num_leaves or math.inf, 1 << p.max_depth)


def _best(losses: Sequence[float]) -> int:
    """Rounds up to the one of the smallest loss."""
    return 1 + min(range(len(losses)), key=losses.__getitem__)


def _grow_model(who: Member, rows: Mapping[str, np.ndarray], prior: np.ndarray, trees: Sequence, losses: Sequence[float], steps: range, seed: int, patience: int, features: int, widths: Sequence[int]) -> list[tuple[list[Tree], int]]:
    """The next rounds of a model whose rows all lie here, with the held-out loss of each, until it stops. It has the trees given."""
    columns, label, fold = rows["columns"], rows["label"], rows["fold"]
    margin, joint, width = np.repeat(prior[:, None], len(label), axis=1), joints(widths), max(widths)
    for found in trees:
        for c, tree in enumerate(found):
            tree.add_to(margin[c], columns)
    learns, held = fold != who.fold, np.flatnonzero(fold == who.fold)
    seen, out, drawn = list(losses), [], None
    for at in steps:
        draw_no = at // max(1, who.params.bagging_freq) if who.params.bagging_fraction < 1 else 0
        if draw_no != drawn:
            use, drawn = np.flatnonzero(learns & in_bag(rows["row"], who.params, seed, at)), draw_no
            mine, keys = columns.take(use, axis=1), rows["joint"].take(use, axis=1)
        p, y = softmax_columns(margin.take(use, axis=1)), label[use]
        found = []
        for c in CLASSES:
            cols = sampled_features(features, who.params.feature_fraction, seed, who.name, who.fold, at, c)
            g, h = class_gradients(p[c], y == c, who.params.hessian)
            found.append(_grown(who, mine, g, h, cols, width, joint, keys, None if at else Flat.of(g, h, y == c)))
        for c, tree in enumerate(found):
            tree.add_to(margin[c], columns)
        loss = _held_loss(label[held], softmax_columns(margin.take(held, axis=1)).T)
        out.append((found, loss))
        if len(held):
            seen.append(loss / SCALE / len(held))
            if len(seen) - _best(seen) >= patience:
                break
    return out


class Fleet:
    """Models that grow in step over one binned table. ``run`` may be called again to go on, with fewer models."""

    def __init__(self, spark: SparkSession, table: Binned, members: Sequence[Member], seed: int = 42, patience: int = PATIENCE):
        self.spark, self.table, self.members, self.seed, self.patience = spark, table, list(members), seed, patience
        self.groups = max(1, min(len(self.members), spark.sparkContext.defaultParallelism // table.parts))
        self.trees: list[list[list[Tree]]] = [[] for _ in self.members]
        self.losses: list[list[float]] = [[] for _ in self.members]
        self.kept_rounds = 0  # rounds whose trees are in the stored margins
        self.rounds = 0
        self.stopped = [False] * len(self.members)
        self.held = [sum(table.counts[m.fold]) if 0 <= m.fold < len(table.counts) else 0 for m in self.members]
        self.priors = []
        for m in self.members:
            n = np.array([sum(c[y] for f, c in enumerate(table.counts) if f != m.fold) for y in CLASSES], float)
            self.priors.append(np.log(np.maximum(n, 1e-6) / max(n.sum(), 1.0)))
        self.kept: list[int] = []  # models whose margins are stored, with the trees of the kept rounds
        start = spark.read.parquet(table.path).select("*", F.explode(F.sequence(F.lit(0), F.lit(self.groups - 1))).alias("grp"), F.lit(None).cast("binary").alias("margins"))
        self.state = self._stored(start)

    def _stored(self, df: DataFrame) -> DataFrame:
        """All blocks of a partition and group in one task, in memory."""
        at = F.col("part") * self.groups + F.col("grp")
        return df.repartitionById(self.table.parts * self.groups, at.cast("int")).persist(StorageLevel.MEMORY_AND_DISK)

    def _plan(self, active: Sequence[int]) -> tuple:
        """What a task needs to know the margins of its blocks."""
        trees = {m: self.trees[m][self.kept_rounds :] if m in self.kept else self.trees[m] for m in active}
        return self.priors, self.groups, len(self.table.features), self.kept, trees

    _COLUMNS = ("n", "row", "fold", "label", "bins", "grp", "margins")

    def _wave(self, asked: Mapping[tuple[int, int], tuple[Tree, list[int]]], active: Sequence[int], with_loss: bool) -> list:
        """Best splits of the nodes asked about, by model and class, and with class -1 the summed loss of the held-out rows."""
        shared = self.spark.sparkContext.broadcast((self._plan(active), dict(asked), frozenset(active), self.members, self.rounds, self.seed, self.table, with_loss))

        def sums(batches: Iterator[pa.RecordBatch]) -> dict[tuple[int, int], np.ndarray]:
            plan, asked, active, members, at, seed, table, with_loss = shared.value
            width = table.width
            total: dict[tuple[int, int], np.ndarray] = {}
            for batch in batches:
                for m, block, margin in _blocks(batch, plan, active):
                    who = members[m]
                    p = softmax_rows(margin)
                    if with_loss:
                        out_of = np.flatnonzero(block["fold"] == who.fold)
                        total[m, -1] = total.get((m, -1), 0) + np.array([_held_loss(block["label"][out_of], p[out_of])], np.int64)
                    use = np.flatnonzero((block["fold"] != who.fold) & in_bag(block["row"], who.params, seed, at))
                    bins, y = block["bins"][use], block["label"][use]
                    columns = np.ascontiguousarray(bins.T)
                    for c in CLASSES:
                        if (m, c) not in asked:
                            continue
                        tree, nodes = asked[m, c]
                        cols = sampled_features(len(table.features), who.params.feature_fraction, seed, who.name, who.fold, at, c)
                        slot = np.full(len(tree.feature), -1)
                        slot[nodes] = np.arange(len(nodes))
                        slot = slot[tree.leaves(bins)]
                        some = np.flatnonzero(slot >= 0)
                        g, h = class_gradients(p[use, c], y == c, who.params.hessian)
                        found = _sums(columns, some, slot[some], len(nodes), g, h, cols, width)
                        total[m, c] = total[m, c] + found if (m, c) in total else found
            return total

        def answer(m: int, c: int, found: np.ndarray) -> bytes:
            _, asked, _, members, at, seed, table, _ = shared.value
            if c < 0:
                return found.astype("<i8").tobytes()
            who, nodes = members[m], asked[m, c][1]
            cols = sampled_features(len(table.features), who.params.feature_fraction, seed, who.name, who.fold, at, c)
            width = found.size // (3 * len(nodes) * len(cols))
            return best_splits(found.reshape(3, len(nodes), len(cols), width), nodes, cols, who.params).tobytes()

        def rows(made: Iterator[tuple[int, int, bytes]]) -> Iterator[pa.RecordBatch]:
            for m, c, data in made:
                yield pa.RecordBatch.from_arrays([pa.array([m], pa.int32()), pa.array([c], pa.int32()), pa.array([data], pa.binary())], names=["m", "c", "data"])

        def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            yield from rows((m, c, found.tobytes()) for (m, c), found in sums(batches).items())

        def combined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            at, held = None, None
            for batch in batches:
                for m, c, data in zip(*(x.to_pylist() for x in batch.columns)):
                    more = np.frombuffer(data, np.int64)
                    if at == (m, c):
                        held = held + more
                        continue
                    if at:
                        yield from rows([(*at, answer(*at, held))])
                    at, held = (m, c), more
            if at:
                yield from rows([(*at, answer(*at, held))])

        fields = "m int, c int, data binary"
        made = self.state.select(*self._COLUMNS).mapInArrow(partial, fields)
        made = made.repartition(max(1, len(asked)), "m", "c").sortWithinPartitions("m", "c").mapInArrow(combined, fields)
        found = made.collect()  # a split for each open leaf of each model
        shared.destroy()
        return found

    def _rounds(self, active: Sequence[int], n: int) -> None:
        """The next ``n`` rounds of models whose rows all lie in one task: trees need no shuffle there, and come out as in :meth:`_wave`.

        The models are dealt anew over the groups, those of many leaves first, so that the ones still growing keep all tasks busy.
        """
        dealt = [sorted(active, key=lambda m: -_most_leaves(self.members[m].params))[i :: self.groups] for i in range(self.groups)]
        models = {m: (self.members[m], self.priors[m], self.trees[m], self.losses[m]) for m in active}
        shared = self.spark.sparkContext.broadcast((dealt, models, range(self.rounds, self.rounds + n), self.seed, self.patience, self.table))

        def grow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            dealt, models, steps, seed, patience, table = shared.value
            blocks, group = [], 0
            for batch in batches:
                for *data, grp, _ in zip(*(batch.column(i).to_pylist() for i in range(7))):
                    block, group = _block(*data, len(table.features)), grp
                    blocks.append({**{k: block[k] for k in ("row", "fold", "label")}, "columns": block["bins"].T})
            if not blocks:
                return
            rows = {name: np.concatenate([b[name] for b in blocks], axis=-1) for name in ("row", "fold", "label")}
            rows["columns"] = np.ascontiguousarray(np.concatenate([b["columns"] for b in blocks], axis=-1))
            rows["joint"] = _joined(rows["columns"], table.widths)
            blocks.clear()
            for m in dealt[group]:
                out = _grow_model(models[m][0], rows, *models[m][1:], steps, seed, patience, len(table.features), table.widths)
                yield pa.RecordBatch.from_arrays([pa.array([m], pa.int32()), pa.array([pickle.dumps(out)], pa.binary())], names=["m", "data"])

        found = {r["m"]: pickle.loads(r["data"]) for r in self.state.select(*self._COLUMNS).mapInArrow(grow, "m int, data binary").collect()}
        shared.destroy()
        for m in active:
            for trees, loss in found.get(m, []):
                self.trees[m].append(trees)
                self._take(m, loss)
        self.rounds += max(map(len, found.values()), default=n)

    def _take(self, m: int, loss: int) -> None:
        """A model without held-out rows has no losses and never stops."""
        if self.held[m]:
            self.losses[m].append(loss / SCALE / self.held[m])
            self.stopped[m] = len(self.losses[m]) - self.best(m) >= self.patience

    def _refresh(self, active: Sequence[int]) -> None:
        """Store the margins of the models that still grow, with all their trees so far."""
        shared, names = self.spark.sparkContext.broadcast((self._plan(active), frozenset(active))), [*self._COLUMNS, "part"]

        def stored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for k in range(batch.num_rows):
                    one = batch.slice(k, 1)
                    margins = b"".join(margin.tobytes() for _, _, margin in _blocks(one, *shared.value))
                    yield pa.RecordBatch.from_arrays([*one.columns[:6], pa.array([margins], pa.binary()), one.column(7)], names=names)

        fields = StructType([self.state.schema[c] for c in (*self._COLUMNS, "part")])
        made = self.state.select(*self._COLUMNS, "part").mapInArrow(stored, fields)
        path = write_parquet(made, new_path(self.spark, "margins"))
        before, self.state = self.state, self._stored(self.spark.read.parquet(path))
        before.unpersist()
        self.kept, self.kept_rounds = sorted(active), self.rounds

    def _note(self, found: list, active: Sequence[int]) -> None:
        """Take the held-out losses after the last round."""
        losses = {r["m"]: int(np.frombuffer(r["data"], "<i8")[0]) for r in found if r["c"] < 0}
        for m in active:
            if len(self.losses[m]) < len(self.trees[m]):
                self._take(m, losses.get(m, 0))

    def best(self, m: int) -> int:
        """Rounds up to the one of the smallest held-out loss."""
        return _best(self.losses[m]) if self.losses[m] else len(self.trees[m])

    def run(self, rounds: int, members: Sequence[int] | None = None) -> Fleet:
        """Go on until the given number of rounds, or until every model has stopped."""
        chosen = list(range(len(self.members)) if members is None else members)
        while self.rounds < rounds:
            active = [m for m in chosen if not self.stopped[m]]
            if self.table.parts == 1 and active:
                nodes = K * sum(2 * _most_leaves(self.members[m].params) for m in active)
                step = max(REFRESH, min(STEP_ROWS // max(1, sum(map(sum, self.table.counts))), STEP_NODES // nodes))
                self._rounds(active, min(step, rounds - self.rounds))
                continue
            growers = {(m, c): Grower(self.members[m].params) for m in active for c in CLASSES}
            first = self.rounds > 0
            while active:
                wanted = {key: (g.tree(), nodes) for key, g in growers.items() if (nodes := g.wanted())}
                if not wanted:
                    break
                found = self._wave(wanted, sorted({m for m, _ in wanted}), first)
                for r in found:
                    if r["c"] >= 0:
                        growers[r["m"], r["c"]].learn(np.frombuffer(r["data"], _SPLIT))
                if first:
                    self._note(found, active)
                    active = [m for m in active if not self.stopped[m]]
                    growers = {key: g for key, g in growers.items() if key[0] in set(active)}
                    first = False
            if not active:
                break
            for m in active:
                self.trees[m].append([growers[m, c].finished() for c in CLASSES])
            self.rounds += 1
            if self.rounds - self.kept_rounds >= REFRESH:
                self._refresh(active)
        active = [m for m in chosen if not self.stopped[m] and len(self.losses[m]) < len(self.trees[m])]
        if active:
            self._note(self._wave({}, active, True), active)
        return self

    def forget(self, members: Sequence[int]) -> None:
        """Drop the trees of models that will not go on; their losses stay."""
        for m in members:
            self.trees[m], self.stopped[m] = [], True

    def close(self) -> None:
        self.state.unpersist()

    def nodes(self, members: Sequence[int] | None = None) -> DataFrame:
        """``(model, fold, round, class, node, feature, threshold, missing_left, left, right, value, gain, n)`` of the trees up to each model's best
        round. Values above the threshold go right; round 0 holds the margins that a model starts with. Models are written one by one."""
        path = new_path(self.spark, "nodes")
        for m in range(len(self.members)) if members is None else members:
            self.spark.createDataFrame(self._nodes_of(m)).coalesce(1).write.mode("append").parquet(path)
        return self.spark.read.parquet(path)

    def _nodes_of(self, m: int) -> pa.Table:
        start = [Tree(*(np.array([x]) for x in (-1, 0, False, -1, -1, float(prior), 0.0, sum(map(sum, self.table.counts))))) for prior in self.priors[m]]
        found = [(at, c, t) for at, trees in enumerate([start, *self.trees[m][: self.best(m)]]) for c, t in enumerate(trees)]
        sizes = np.array([len(t.feature) for _, _, t in found])
        spread = lambda values: pa.array(np.repeat(np.array(values, np.int32), sizes))
        joined = lambda name, kind: np.concatenate([getattr(t, name) for _, _, t in found], dtype=kind)
        feature = joined("feature", np.int32)
        leaf = feature < 0
        bounds = np.full((len(self.table.features), self.table.width), math.inf)
        for f, edges in enumerate(self.table.edges):
            bounds[f, 1 : len(edges) + 1] = edges
        node = np.arange(len(feature)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        columns = {
            "model": pa.repeat(self.members[m].name, len(feature)),
            "fold": spread([self.members[m].fold] * len(found)),
            "round": spread([at for at, _, _ in found]),
            "class": spread([c for _, c, _ in found]),
            "node": pa.array(node.astype(np.int32)),
            "feature": pa.array(self.table.features, pa.string()).take(pa.array(feature, mask=leaf)),
            "threshold": pa.array(bounds[feature, joined("bin", np.int32)], mask=leaf),
            **{name: pa.array(joined(name, kind), mask=leaf) for name, kind in (("missing_left", bool), ("left", np.int32), ("right", np.int32))},
            "value": pa.array(joined("value", np.float64), mask=~leaf),
            "gain": pa.array(joined("gain", np.float64)),
            "n": pa.array(joined("n", np.int64)),
        }
        return pa.table(columns)


def fold_members(params: Mapping[str, Boost], k: int = N_FOLDS) -> list[Member]:
    """A model for each name and fold."""
    return [Member(name, fold, p) for name, p in params.items() for fold in range(k)]


# ---------------------------------------------------------------- saved models


def predict(df: DataFrame, models: DataFrame, model: str, features: Sequence[str], key: str = ID, fold: str = FOLD) -> DataFrame:
    """``(key, pred_a, pred_b, pred_tie)``: every row by the saved model of its fold; rows of no such fold have NULLs.

    ``models`` is a table of nodes as :meth:`Fleet.nodes` gives it; its trees, bounded by rounds and leaves, go to every task.
    """
    require(df, [key, fold, *features], "rows to score")
    table = models.where(F.col("model") == model).orderBy("fold", "round", "class", "node").toArrow()
    place = pc.index_in(table["feature"], pa.array(features, pa.string()))
    if place.null_count > table["feature"].null_count:
        raise ValueError("the models split on a feature that the rows do not have")
    filled = lambda c, value: pc.fill_null(c, value).to_numpy()
    nodes = [filled(place, -1), *(filled(table[c], value) for c, value in (("threshold", 0.0), ("missing_left", False), ("left", 0), ("right", 0), ("value", 0.0)))]
    starts = np.flatnonzero(table["node"].to_numpy() == 0)
    arrays: dict[int, list[tuple]] = {}
    for lo, hi, f, c in zip(starts, [*starts[1:], len(table)], table["fold"].to_numpy()[starts].tolist(), table["class"].to_numpy()[starts].tolist()):
        arrays.setdefault(f, []).append((c, *(x[lo:hi] for x in nodes)))
    shared = df.sparkSession.sparkContext.broadcast(arrays)
    values = F.array(*[F.when(is_number(F.col(f"`{c}`")), F.col(f"`{c}`").cast("double")).otherwise(float("nan")) for c in features])
    width = len(features)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            folds = batch.column(1).to_pylist()
            x = batch.column(2).flatten().to_numpy(zero_copy_only=False).reshape(n, width)
            out = np.full((n, K), np.nan)
            for f, found in shared.value.items():
                rows = np.flatnonzero([v == f for v in folds])
                margin = np.zeros((len(rows), K))
                for c, feature, threshold, missing, left, right, value in found:
                    at = np.zeros(len(rows), np.int64)
                    live = np.arange(len(rows))
                    while len(live := live[feature[at[live]] >= 0]):
                        here = at[live]
                        v = x[rows[live], feature[here]]
                        goes = np.where(np.isnan(v), missing[here], v <= threshold[here])
                        at[live] = np.where(goes, left[here], right[here])
                    margin[:, c] += value[at]
                if len(rows):
                    out[rows] = softmax_rows(margin)
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(out[:, c], from_pandas=True) for c in range(K)]], names=[key, *PREDS])

    schema = StructType([df.schema[key], *StructType.fromDDL(", ".join(f"{p} double" for p in PREDS))])
    return df.select(key, F.col(fold).cast("int"), values.alias("values")).mapInArrow(score, schema)


def gain_importance(models: DataFrame, features: Sequence[str], missing: str = "zero") -> DataFrame:
    """``(model, fold, feature, importance)``: the gain of all splits on a feature, summed over the trees of a fold's model.

    A feature without splits has 0; ``missing='skip'`` leaves it out.
    """
    if missing not in ("zero", "skip"):
        raise ValueError("missing is 'zero' or 'skip'")
    split = models.where("feature IS NOT NULL").groupBy("model", "fold", "feature").agg(F.sum("gain").alias("importance"))
    if missing == "skip":
        return split
    every = models.select("model", "fold").distinct().select("*", F.explode(F.array(*map(F.lit, features))).alias("feature"))
    return every.join(split, ["model", "fold", "feature"], "left").fillna(0.0, ["importance"])


def mean_gain(per_fold: DataFrame, n: int | None = None) -> DataFrame:
    """``(model, rank, feature, importance)``: gains averaged over the folds that list a feature, the first ``n`` of each model."""
    mean = per_fold.groupBy("model", "feature").agg(F.avg("importance").alias("importance"))
    ranked = mean.withColumn("rank", F.row_number().over(Window.partitionBy("model").orderBy(F.desc("importance"), "feature")))
    return (ranked.where(F.col("rank") <= n) if n else ranked).select("model", "rank", "feature", "importance")


# ---------------------------------------------------------------- search


def draw(space: Mapping[str, tuple], n: int, seed: int = 42) -> list[dict]:
    """``n`` random parameter sets."""
    rng = random.Random(seed)
    kinds = {"float": rng.uniform, "int": rng.randint, "log": lambda lo, hi: math.exp(rng.uniform(math.log(lo), math.log(hi)))}
    return [{name: kinds[kind](lo, hi) for name, (kind, lo, hi) in space.items()} for _ in range(n)]


def halving(
    spark: SparkSession,
    table: Binned,
    spaces: Mapping[str, Mapping[str, tuple]],
    bases: Mapping[str, Boost],
    trials: int = 50,
    rungs: Sequence[int] = (10, 30, 90, 270, 1000),
    keep: float = 1 / 3,
    seed: int = 42,
    patience: int = PATIENCE,
) -> DataFrame:
    """Successive halving: ``(space, trial, rung, rounds, mean_log_loss, promoted, parameters)``.

    All trials of all spaces grow to the first rung; the better ones of each space, a share ``keep`` of them by the mean over folds of
    the best held-out loss so far, go on from where they stand to the next. Losses never rise from rung to rung.
    """
    k = len(table.counts)
    drawn = {name: draw(space, trials, seed) for name, space in spaces.items()}
    members = [Member(f"{name}/{t}", f, Boost(**{**asdict(bases[name]), **p})) for name, found in drawn.items() for t, p in enumerate(found) for f in range(k)]
    place: dict[tuple[str, int], list[int]] = {}
    for i, m in enumerate(members):
        name, t = m.name.rsplit("/", 1)
        place.setdefault((name, int(t)), []).append(i)
    fleet = Fleet(spark, table, members, seed, patience)
    rows, alive = [], {name: list(range(trials)) for name in spaces}
    try:
        for rung, rounds in enumerate(rungs):
            fleet.run(rounds, [i for name, ts in alive.items() for t in ts for i in place[name, t]])
            for name, ts in alive.items():
                loss = {t: float(np.mean([min(fleet.losses[i]) for i in place[name, t] if fleet.losses[i]] or [math.inf])) for t in ts}
                order = sorted(ts, key=lambda t: (loss[t], t))
                go = set(order[: max(1, round(len(ts) * keep))]) if rung + 1 < len(rungs) else set()
                for t in order:
                    rows.append((name, t, rung, max(len(fleet.losses[i]) for i in place[name, t]), loss[t], t in go, json.dumps(drawn[name][t], sort_keys=True)))
                alive[name] = sorted(go)
                fleet.forget([i for t in ts if t not in go for i in place[name, t]])
    finally:
        fleet.close()
    return spark.createDataFrame(rows, "space string, trial int, rung int, rounds int, mean_log_loss double, promoted boolean, parameters string")


def best_trial(found: DataFrame, space: str) -> dict:
    """The parameters of the best trial that reached the last rung."""
    return json.loads(found.where(F.col("space") == space).orderBy(F.desc("rung"), "mean_log_loss", "trial").first()["parameters"])
