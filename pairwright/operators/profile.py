"""Column profiles: count, mean, standard deviation, minimum, quartiles, maximum."""

from __future__ import annotations

import math
from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairwright.operators.rows import round_columns

QUARTILES = (0.25, 0.5, 0.75)
_ACCURACY = 10_000


def column_profile(
    df: DataFrame,
    groups: Mapping[str, Sequence[str]],
    quantiles: str = "exact",
    digits: int = 2,
    accuracy: int = _ACCURACY,
) -> DataFrame:
    """(feature_group, feature, count, mean, std, min, q25, q50, q75, max), one row per group and column.

    ``approximate`` takes the quartiles from a mergeable sketch, in one pass; ``exact`` interpolates between
    neighbours like a sorted array would, see :func:`exact_quantiles`. NULL and NaN are not counted. The
    passes run when the function is called, and what reaches the driver depends on the number of columns only.
    """
    if quantiles not in ("exact", "approximate"):
        raise ValueError("quantiles is 'exact' or 'approximate'")
    columns = list(dict.fromkeys(c for members in groups.values() for c in members))
    values = df.select(*[_usable(c).alias(c) for c in columns])
    aggs = [
        F.expr(f"{function}(`{c}`) AS `{c}|{name}`")
        for c in columns
        for name, function in (("count", "count"), ("mean", "avg"), ("std", "stddev"), ("min", "min"), ("max", "max"))
    ]
    if quantiles == "approximate":
        aggs += [F.percentile_approx(c, list(QUARTILES), accuracy).alias(f"{c}|sketch") for c in columns]
    stats = values.agg(*aggs).first()
    if quantiles == "exact":
        quartile = exact_quantiles(values, columns)
    else:
        quartile = {c: stats[f"{c}|sketch"] or [None] * len(QUARTILES) for c in columns}
    rows = [
        (group, c, stats[f"{c}|count"], stats[f"{c}|mean"], stats[f"{c}|std"], stats[f"{c}|min"], *quartile[c], stats[f"{c}|max"])
        for group, members in groups.items()
        for c in members
    ]
    names = ("mean", "std", "min", "q25", "q50", "q75", "max")
    schema = "feature_group string, feature string, count long, " + ", ".join(f"{n} double" for n in names)
    return round_columns(df.sparkSession.createDataFrame(rows, schema), names, digits)


def _usable(c: str) -> Column:
    value = F.col(c).cast("double")
    return F.when(~F.isnan(value), value)


def exact_quantiles(df: DataFrame, columns: Sequence[str], probabilities: Sequence[float] = QUARTILES) -> dict[str, list[float | None]]:
    """Exact quantiles of many columns with linear interpolation, by radix selection.

    A double's bits, with the sign folded in, sort as unsigned numbers. Four passes fix 16 of the 64 bits each: a pass counts, for every
    prefix that a wanted rank has led to, the values by their next 16 bits, and the rank falls into one of at most 65,536 counts.
    Counts are combined by task before they are shuffled, no value is sorted or gathered, and the driver gets a bucket for each rank.
    NULL and NaN are not counted.
    """
    out: dict[str, list[float | None]] = {c: [None] * len(probabilities) for c in columns}
    values = df.select(*[F.col(f"`{c}`").cast("double") for c in columns])
    sizes = values.agg(*[F.count(F.when(~F.isnan(v := F.col(f"`{c}`")), v)).alias(f"n{i}") for i, c in enumerate(columns)]).first() if columns else []
    wanted: list[list[int]] = []  # [column, rank, bits so far, rank among the values with these bits]
    for i, n in enumerate(sizes):
        ranks = {math.floor(p * (n - 1)) for p in probabilities} | {math.ceil(p * (n - 1)) for p in probabilities} if n else set()
        wanted += [[i, r, 0, r] for r in sorted(ranks)]
    for shift in (48, 32, 16, 0):
        if wanted:
            found = {(r["column"], int(r["prefix"]), r["rank"]): r for r in _radix_pass(values, wanted, shift).collect()}  # a row per rank
            for w in wanted:
                hit = found[w[0], w[2], w[3]]
                w[2:] = [w[2] << 16 | hit["bucket"], w[3] - hit["before"]]
    at = {(i, r): _from_bits(bits) for i, r, bits, _ in wanted}
    for i, n in enumerate(sizes):
        for j, p in enumerate(probabilities if n else ()):
            position = p * (n - 1)
            low, high = at[i, math.floor(position)], at[i, math.ceil(position)]
            out[columns[i]][j] = low if low == high else low + (high - low) * (position - math.floor(position))
    return out


def _to_bits(x: np.ndarray) -> np.ndarray:
    """Unsigned numbers in the order of the doubles; both zeros are one."""
    bits = (x + 0.0).view(np.uint64)
    return np.where(bits >> np.uint64(63) == 1, ~bits, bits | np.uint64(1 << 63))


def _from_bits(bits: int) -> float:
    plain = bits & (1 << 63) - 1 if bits >> 63 else ~bits & (1 << 64) - 1
    return float(np.array([plain], np.uint64).view(np.float64)[0])


def _radix_pass(values: DataFrame, wanted: Sequence[Sequence[int]], shift: int) -> DataFrame:
    """``(column, prefix, rank, bucket, before)``: the next 16 bits of the value at each rank, and how many with the same prefix are smaller."""
    prefixes: dict[int, set[int]] = {}
    ranks: dict[tuple[int, int], set[int]] = {}
    for column, _, prefix, rank in wanted:
        prefixes.setdefault(column, set()).add(prefix)
        ranks.setdefault((column, prefix), set()).add(rank)

    def merged(buckets: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        one, back = np.unique(buckets, return_inverse=True)
        return one, np.bincount(back, weights=n, minlength=len(one)).astype(np.int64)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[tuple[int, int], tuple[np.ndarray, np.ndarray]] = {}
        for batch in batches:
            for column, some in prefixes.items():
                x = batch.column(column).drop_null().to_numpy(zero_copy_only=False)
                bits = _to_bits(x[~np.isnan(x)])
                head = bits >> np.uint64(shift + 16) if shift < 48 else np.zeros(len(bits), np.uint64)
                for prefix in some:
                    buckets = ((bits[head == np.uint64(prefix)] >> np.uint64(shift)) & np.uint64(0xFFFF)).astype(np.int64)
                    held = total.get((column, prefix), (np.zeros(0, np.int64), np.zeros(0, np.int64)))
                    total[column, prefix] = merged(np.concatenate([held[0], buckets]), np.concatenate([held[1], np.ones(len(buckets), np.int64)]))
        for (column, prefix), (buckets, n) in total.items():
            if len(buckets):
                yield pa.RecordBatch.from_arrays([pa.array([column], pa.int32()), pa.array([str(prefix)]), pa.array([buckets]), pa.array([n])], names=["column", "prefix", "buckets", "ns"])

    def select(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held = None, None

        def done() -> Iterator[pa.RecordBatch]:
            if at:
                upto = np.cumsum(held[1])
                mine = sorted(ranks[at])
                place = np.searchsorted(upto, mine, "right")
                columns = [pa.array([at[0]] * len(mine), pa.int32()), pa.array([str(at[1])] * len(mine)), pa.array(mine, pa.int64()), pa.array(held[0][place].astype(np.int32)), pa.array(upto[place] - held[1][place])]
                yield pa.RecordBatch.from_arrays(columns, names=["column", "prefix", "rank", "bucket", "before"])

        for batch in batches:
            for column, prefix, buckets, n in zip(*(c.to_pylist() for c in batch.columns)):
                if at != (column, int(prefix)):
                    yield from done()
                    at, held = (column, int(prefix)), (np.zeros(0, np.int64), np.zeros(0, np.int64))
                held = merged(np.concatenate([held[0], buckets]), np.concatenate([held[1], n]))
        yield from done()

    sums = values.mapInArrow(count, "column int, prefix string, buckets array<bigint>, ns array<bigint>")
    dealt = sums.repartition("column", "prefix").sortWithinPartitions("column", "prefix")
    return dealt.mapInArrow(select, "column int, prefix string, rank bigint, bucket int, before bigint")
