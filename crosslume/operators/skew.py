"""Equi-joins that stay balanced when one key holds a large share of the rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# A key with more rows than this is hot and is cut into pieces of about this size.
HOT_ROWS = 200_000
# Keys are counted by so many shares first, and one by one only in shares that have more rows than a hot key.
SHARES = 1 << 16
# Beyond so many such shares all keys are counted.
LISTED_SHARES = 1000


def key_counts(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows ``n`` of every key, summed up before the shuffle."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))


def hot_keys(counts: DataFrame, keys: Sequence[str], rows: int = HOT_ROWS) -> DataFrame:
    """Every key of ``counts`` with more than ``rows`` rows, and in ``ways`` n / rows, rounded up."""
    ways = F.ceil(F.col("n") / F.lit(float(rows))).cast("long")
    return counts.where(F.col("n") > rows).select(*keys, ways.alias("ways"))


def crowded_keys(df: DataFrame, keys: Sequence[str], rows: int = HOT_ROWS) -> DataFrame | None:
    """As ``hot_keys`` of ``df``, or None where no key can be hot; runs a job.

    The shares are counted before anything is shuffled. A share has no fewer rows than any of its keys, so none is missed.
    """
    share = F.pmod(F.xxhash64(*keys), F.lit(SHARES))
    full = key_counts(df.select(share.alias("share")), ["share"]).where(F.col("n") > rows).select("share")
    found = [row["share"] for row in full.collect()]
    if not found:
        return None
    within = df.where(share.isin(found)) if len(found) <= LISTED_SHARES else df
    return hot_keys(key_counts(within, keys), keys, rows)


def gathered(df: DataFrame, keys: Sequence[str], rows: int = HOT_ROWS) -> DataFrame:
    """``df`` with all rows of a key in one partition, or ``df`` itself where a key is hot; runs a job.

    What groups or joins by these keys, or groups by these and more, then needs no shuffle of its own.
    """
    return df.repartition(*keys) if crowded_keys(df, keys, rows) is None else df


def piece_of(spread: Sequence[str], ways: Column) -> Column:
    """Piece of a hot key a row belongs to, from a hash of ``spread``; 0 for other keys."""
    piece = F.when(ways.isNotNull(), F.pmod(F.xxhash64(*spread), ways)).otherwise(F.lit(0))
    return F.coalesce(piece, F.lit(0)).cast("long")


def split_join(
    left: DataFrame,
    right: DataFrame,
    keys: Sequence[str],
    how: str = "inner",
    *,
    split_left: Sequence[str] = (),
    split_right: Sequence[str] = (),
    left_counts: DataFrame | None = None,
    right_counts: DataFrame | None = None,
    left_rows: DataFrame | None = None,
    right_rows: DataFrame | None = None,
    hot_rows: int = HOT_ROWS,
    hint: str | None = None,
) -> DataFrame:
    """Join on ``keys`` with the hot keys of either side cut into pieces.

    ``split_left`` and ``split_right`` name the columns that spread a side's rows of one key; a side
    without them is not split. Every left piece meets every right piece exactly once, so the result
    is that of the plain join. Only an inner join may split the right side.

    Keys are counted at once, by a job over each side that is split: over ``left_rows`` and ``right_rows`` if
    given, which have no fewer rows of any key than the side and cost less to read. ``left_counts`` and
    ``right_counts`` (the keys and ``n``) take the place of that, as a part of the join. There may be
    any number of hot keys and pieces; how their list is joined is left to adaptive execution. Copies
    are made after the join with the list; without hot keys there is no list.

    ``hint`` is a join strategy; a side that grows by exploding should give "merge", as Spark may
    judge it by the size of its files and broadcast it.

    A copied row costs one more row to shuffle and meets ``hot_rows`` candidates in return, so the
    copies never weigh much against the join itself.
    """
    if how not in ("inner", "left"):
        raise ValueError(f"split_join does not support a {how!r} join")
    if how == "left" and split_right:
        raise ValueError("a left join keeps its right side whole")
    one = F.lit(1).cast("long")

    def listed(counts: DataFrame | None, rows: DataFrame) -> DataFrame | None:
        return crowded_keys(rows, keys, hot_rows) if counts is None else hot_keys(counts, keys, hot_rows)

    hot = []
    if split_left:
        found = listed(left_counts, left if left_rows is None else left_rows)
        if found is not None:
            hot.append(found.select(*keys, F.col("ways").alias("_kl"), one.alias("_kr")))
    if split_right:
        found = listed(right_counts, right if right_rows is None else right_rows)
        if found is not None:
            hot.append(found.select(*keys, one.alias("_kl"), F.col("ways").alias("_kr")))
    if not hot:
        return left.join(right.hint(hint) if hint else right, list(keys), how)
    splits = hot[0]
    if len(hot) == 2:
        splits = (
            hot[0]
            .unionByName(hot[1])
            .groupBy(*keys)
            .agg(F.max("_kl").alias("_kl"), F.max("_kr").alias("_kr"))
        )

    def cut(df: DataFrame, spread: Sequence[str], own: str, other: str, i: str, j: str) -> DataFrame:
        """Tag rows with their piece ``i``, one copy for each piece ``j`` of the other side."""
        ways = splits.select(*keys, F.col(own).alias("_ways"), F.col(other).alias("_copies"))
        copies = F.sequence(F.lit(0).cast("long"), F.coalesce("_copies", one) - 1)
        piece = piece_of(spread, F.col("_ways")) if spread else F.lit(0).cast("long")
        return (
            df.join(ways, list(keys), "left")
            .withColumn(i, piece)
            .withColumn(j, F.explode_outer(copies))
            .drop("_ways", "_copies")
        )

    cut_left = cut(left, split_left, "_kl", "_kr", "_i", "_j")
    cut_right = cut(right, split_right, "_kr", "_kl", "_j", "_i")
    if hint:
        cut_right = cut_right.hint(hint)
    return cut_left.join(cut_right, [*keys, "_i", "_j"], how).drop("_i", "_j")
