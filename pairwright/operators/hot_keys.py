"""Joins that find their own hot keys and split them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Keys a sketch tracks; a key on more than about 1 / TRACKED of the rows is always among them.
TRACKED = 4096
#: Parts that a hot key is split into at most.
MOST_PARTS = 256


def hot_keys(df: DataFrame, key: str, share: float) -> dict:
    """Keys on at least about ``share`` of the rows, with upper bounds of their counts: one pass, a sketch of fixed size, at most 1 / share keys."""
    seen = df.where(F.col(key).isNotNull()).agg(F.count("*").alias("n"), F.expr(f"approx_top_k(`{key}`, {min(1000, int(2 / share) + 1)}, {TRACKED})").alias("top")).first()
    return {t["item"]: t["count"] for t in seen["top"] or () if t["count"] >= share * seen["n"]}


def _parts(key: Column, hot: dict, parts: dict) -> Column:
    """The number of parts of a key, 1 unless it is hot."""
    if not hot:
        return F.lit(1)
    return F.coalesce(F.element_at(F.create_map(*[x for k in hot for x in (F.lit(k), F.lit(parts[k]))]), key), F.lit(1))


def hot_join(left: DataFrame, right: DataFrame, key: str, how: str = "inner", share: float | None = None) -> DataFrame:
    """``left.join(right, key, how)`` for inner and left joins, with hot keys split.

    The keys of both sides are sketched. Rows of a hot key are dealt over parts on the side that has more of them and repeated for every part on
    the other; all other rows have one part, so that one plain join on key and part does it. A key that is hot on the right only is
    there for certain, so its rows join inner also where ``how`` is left. ``share`` is the part of a side's rows that makes a key hot, by default a quarter of a
    shuffle partition; a key gets a part for every such share of the rows, ``MOST_PARTS`` at most.
    """
    if how not in ("inner", "left"):
        raise ValueError("how is 'inner' or 'left'")
    partitions = int(left.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    share = share or 1.0 / (4 * max(4, partitions))
    on_left, on_right = hot_keys(left, key, share), hot_keys(right, key, share)
    sizes = {k: max(on_left.get(k, 0), on_right.get(k, 0)) for k in {*on_left, *on_right}}
    if not sizes:
        return left.join(right, key, how)
    least = {True: share * max(1, sum(on_left.values())), False: share * max(1, sum(on_right.values()))}
    by_left = {k: n for k, n in sizes.items() if on_left.get(k, 0) >= on_right.get(k, 0)}
    by_right = {k: n for k, n in sizes.items() if k not in by_left}
    parts = {k: int(min(MOST_PARTS, max(2, -(-n // max(1.0, least[k in by_left]))))) for k, n in sizes.items()}
    row = F.monotonically_increasing_id()
    dealt = lambda hot: F.pmod(row, _parts(F.col(key), hot, parts).cast("bigint")).cast("int")
    copies = lambda hot: F.explode(F.sequence(F.lit(0), _parts(F.col(key), hot, parts) - 1))
    is_hot = F.coalesce(F.col(key).isin(list(by_right)), F.lit(False)) if by_right else F.lit(False)
    cold = left.where(~is_hot).select("*", dealt(by_left).alias("_part"))
    out = cold.join(right.where(~is_hot).select("*", copies(by_left).alias("_part")), [key, "_part"], how)
    if by_right:
        many = right.where(is_hot).select("*", dealt(by_right).alias("_part"))
        out = out.unionByName(left.where(is_hot).select("*", copies(by_right).alias("_part")).join(many, [key, "_part"]))
    return out.drop("_part")
