"""Embedding near-duplicates by lattice hashing.

Vectors of length one are projected at random to blocks of eight dimensions in several tables, and every block is decoded to its
nearest point of the lattice E8. A vector belongs to the cell of its point and probes the neighbouring cells that come nearest to it;
two vectors that share a cell of any table are compared by cosine in double precision. Equal vectors are one node from the start.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairwright.llm.buckets import blocks, grouped, memberships, owned, padded, roots, runs, sized, whole_groups
from pairwright.llm.components import components
from pairwright.llm.store import written
from pairwright.llm.texts import mix

THRESHOLD = 0.95
TABLES = 10
BLOCKS = 2
PROBES = 2
#: Recall at these values, measured on pairs of random directions: 0.999 at a cosine of 0.95, above 0.9999 from 0.97. A cell of the default
#: blocks holds few strangers up to some millions of vectors; take three blocks and more tables for billions.
#: Length of a unit vector after projection, per block, in lattice units.
SCALE = 1.5


def minimal_vectors() -> np.ndarray:
    """The 240 shortest vectors of E8: two entries of +-1, or eight of +-1/2 with an even number of minus signs."""
    out = []
    for i, j in itertools.combinations(range(8), 2):
        for a, b in itertools.product((1, -1), repeat=2):
            v = [0.0] * 8
            v[i], v[j] = a, b
            out.append(v)
    out += [v for v in itertools.product((0.5, -0.5), repeat=8) if sum(x < 0 for x in v) % 2 == 0]
    return np.array(out)


NEIGHBOURS = minimal_vectors()


def _even(x: np.ndarray) -> np.ndarray:
    """Nearest point with integer entries and an even sum."""
    near = np.rint(x)
    odd = np.flatnonzero(near.sum(axis=-1) % 2 != 0)
    gap = x[odd] - near[odd]
    worst = np.abs(gap).argmax(axis=-1)
    at = np.arange(len(odd))
    near[odd, worst] += np.where(gap[at, worst] >= 0, 1, -1)
    return near


def decode(x: np.ndarray) -> np.ndarray:
    """Nearest points of E8: the better of the nearest even point and the nearest even point moved by one half."""
    whole, half = _even(x), _even(x - 0.5) + 0.5
    return np.where((((x - whole) ** 2).sum(-1) <= ((x - half) ** 2).sum(-1))[:, None], whole, half)


def projections(dims: int, tables: int, n_blocks: int, scale: float) -> np.ndarray:
    """Random directions, ``(tables, dims, 8 x blocks)``, that depend on these numbers alone."""
    rng = np.random.default_rng([20240131, dims, tables, n_blocks])
    return rng.standard_normal((tables, dims, 8 * n_blocks)) * (scale / np.sqrt(8))


def cells(unit: np.ndarray, tables: int, n_blocks: int, probes: int, scale: float) -> np.ndarray:
    """Names of the own and the probed cells of every vector, ``(vectors, tables x (1 + probes))``."""
    n = len(unit)
    out = np.zeros((n, tables, 1 + probes), np.uint64)
    factors = np.random.default_rng(11).integers(1, 1 << 62, 8 * n_blocks, np.uint64) * np.uint64(2) + np.uint64(1)
    for t, directions in enumerate(projections(unit.shape[1], tables, n_blocks, scale)):
        x = (unit @ directions).reshape(n * n_blocks, 8)
        point = decode(x)
        gain = ((x - point) @ NEIGHBOURS.T).reshape(n, n_blocks * len(NEIGHBOURS))
        code = np.rint(2 * point).astype(np.int64).reshape(n, 8 * n_blocks).view(np.uint64)
        sums = (code * factors).sum(axis=1, dtype=np.uint64)
        out[:, t, 0] = sums
        if probes:
            best = np.argpartition(-gain, probes, axis=1)[:, :probes]
            step = np.zeros((n_blocks * len(NEIGHBOURS), 8 * n_blocks), np.int64)
            for b in range(n_blocks):
                step[b * 240 : (b + 1) * 240, 8 * b : 8 * b + 8] = np.rint(2 * NEIGHBOURS)
            moves = (step.view(np.uint64) * factors).sum(axis=1, dtype=np.uint64)
            out[:, t, 1:] = sums[:, None] + moves[best]
        out[:, t] = mix(out[:, t] + factors[0] * np.arange(t + 1, t + 2, dtype=np.uint64))
    return out.reshape(n, -1)


def unit_vectors(column: pa.Array) -> np.ndarray:
    """Rows of one length as doubles of length one; the lists have equal sizes, finite components and one that is not zero.

    Rows are first scaled by a power of two, which is exact, so that no square leaves the range of doubles.
    """
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)
    flat = np.ldexp(flat, -np.frexp(np.abs(flat).max(axis=1, keepdims=True))[1])
    return flat / np.sqrt((flat * flat).sum(axis=1, keepdims=True))


def _hashed(tables: int, n_blocks: int, probes: int, scale: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = np.asarray(batch.column("v").value_lengths())
            for size in np.unique(sizes):
                part = batch.filter(pa.array(sizes == size))
                names = part.column("node").to_numpy()
                for at in range(0, len(names), 2000):
                    found = cells(unit_vectors(part.column("v").slice(at, 2000)), tables, n_blocks, probes, scale)
                    rows = pa.RecordBatch.from_arrays([pa.array(found.reshape(-1).view(np.int64)), pa.array(np.repeat(names[at : at + 2000], found.shape[1]))], names=["bucket", "node"])
                    yield rows

    return run


def _verified(threshold: float):
    """Links inside each group: ``(node, links, root)`` with the copies of the partners counted."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_groups(batches):
            key, side, bucket, node, copies = (table.column(c).to_numpy() for c in ("group_id", "side", "bucket", "node", "copies"))
            vectors, lists = table.column("v").combine_chunks(), padded(table.column("buckets"))
            sizes = np.asarray(vectors.value_lengths())
            found = []
            for lo, hi in zip(*(x.tolist() for x in runs(key))):
                for size in np.unique(sizes[lo:hi]):  # vectors of different lengths have no cosine
                    at = lo + np.flatnonzero(sizes[lo:hi] == size)
                    if len(at) < 2:
                        continue
                    unit = unit_vectors(vectors.take(pa.array(at)))
                    i, j = np.nonzero(np.triu(unit @ unit.T >= threshold - 1e-9, 1))
                    if not len(i):
                        continue
                    i, j = (x[(side[at[i]] == 0) | (side[at[i]] != side[at[j]])] for x in (i, j))
                    exact = (unit[i] * unit[j]).sum(axis=1) >= threshold
                    i, j = i[exact], j[exact]
                    mine = owned(lists, bucket, at[i], at[j])
                    linked = np.zeros((len(at), len(at)), bool)
                    linked[i[mine], j[mine]] = linked[j[mine], i[mine]] = True
                    some = linked.any(axis=1)
                    if some.any():
                        found.append((node[at][some], (linked @ copies[at])[some], roots(linked, node[at])[some]))
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x).astype(np.int64)) for x in zip(*found)], names=["node", "links", "root"])

    return run


def near_duplicates(
    vectors: DataFrame,
    *,
    id_column: str = "vec_id",
    vector: str = "embedding",
    threshold: float = THRESHOLD,
    tables: int = TABLES,
    n_blocks: int = BLOCKS,
    probes: int = PROBES,
    scale: float = SCALE,
) -> DataFrame:
    """One row per vector row: ``vec_id, n_links`` (other rows with a cosine of at least ``threshold``), ``component_id`` (smallest id
    reachable by links, itself included) and ``kept`` (vec_id = component_id).

    A vector that is null, empty, zero or holds null or non-finite components links with nothing, nor does one without an id, which gets a null
    component and is kept. A repeated row counts as one more copy. Extra columns are not read.
    """
    rows = vectors.select(F.col(f"`{id_column}`").alias("vec_id"), F.col(f"`{vector}`").cast("array<double>").alias("v"))
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    usable = F.col("vec_id").isNotNull() & F.coalesce((F.size("v") > 0) & finite & F.exists("v", lambda x: x != 0), F.lit(False))
    rows = rows.withColumn("v", F.when(usable, F.col("v")))
    nodes = rows.where("v IS NOT NULL").groupBy("v").agg(F.min("vec_id").alias("node"), F.count("*").alias("copies"))
    nodes = written(nodes, "vectors")
    members = sized(nodes.select("node", "v").mapInArrow(_hashed(tables, n_blocks, probes, scale), "bucket bigint, node bigint").distinct())
    members = written(members, "cells", narrow=True)
    payload = nodes.select("node", "copies", "v").join(memberships(members), "node")
    met = grouped(blocks(members).join(payload, "node"))
    links = written(met.mapInArrow(_verified(threshold), "node bigint, links bigint, root bigint"), "cosines", narrow=True)
    component = components(links.select(F.col("node").alias("a"), F.col("root").alias("b")))
    counted = links.groupBy("node").agg(F.sum("links").alias("links"))
    state = nodes.select("v", "node", "copies").join(counted, "node", "left").join(component, "node", "left")
    state = state.select(F.col("v").alias("w"), F.coalesce("component", "node").alias("c"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n"))
    joined = rows.join(state, F.col("v") == F.col("w"), "left")
    return joined.select(
        "vec_id", F.coalesce("n", F.lit(0)).cast("bigint").alias("n_links"), F.coalesce("c", "vec_id").alias("component_id")
    ).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))
