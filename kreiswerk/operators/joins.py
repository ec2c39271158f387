"""Equi joins that stay balanced when one key holds a large share of the rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, DataType, MapType, StringType, StructType, VariantType

from ..session import write_through

# A side is broadcast only after it was counted and found within both bounds.
BROADCAST_ROWS = 200_000
BROADCAST_BYTES = 64 * 1024 * 1024

# Rows of one key that a single task may receive. Every key above it is cut, and there are at most
# 1/ROWS_PER_TASK as many such keys as rows: 50 000 in a table of 10^11.
ROWS_PER_TASK = 2_000_000

# Row pairs of one key that a single task may build in a many-to-many join, and the side length of
# the blocks a heavier key is cut into.
PAIRS_PER_TASK = 16_000_000
BLOCK_ROWS = 4000


def fits_broadcast(df: DataFrame, max_rows: int = BROADCAST_ROWS, max_bytes: int = BROADCAST_BYTES) -> bool:
    """Measure ``df`` in one pass; every task sends no more than its count and its bytes."""
    width = sum((_width(df[f.name], f.dataType) for f in df.schema), F.lit(0))
    size = df.agg(F.count(F.lit(1)).alias("n"), F.sum(width).alias("bytes")).first()
    return size["n"] <= max_rows and (size["bytes"] or 0) <= max_bytes


def _width(value: Column, kind: DataType) -> Column:
    if isinstance(kind, (StringType, BinaryType)):
        return F.coalesce(F.octet_length(value), F.lit(0)) + 8
    if isinstance(kind, (ArrayType, MapType, StructType, VariantType)):
        return F.length(F.to_json(F.struct(value)))
    return F.lit(8)


def lookup_join(
    rows: DataFrame,
    lookup: DataFrame,
    on: Sequence[str],
    how: str = "left",
    spread_by: Sequence[str] | None = None,
) -> DataFrame:
    """Join ``rows`` to a lookup table on equal keys.

    A lookup that was measured to be small is broadcast, so ``rows`` are not moved at all. A larger
    one is joined by shuffle with its hot keys split.
    """
    if fits_broadcast(lookup):
        return rows.join(F.broadcast(lookup), list(on), how)
    return salted_join(rows, lookup, on, how, spread_by)


def salted_join(
    rows: DataFrame,
    other: DataFrame,
    on: Sequence[str],
    how: str = "inner",
    spread_by: Sequence[str] | None = None,
    rows_per_task: int = ROWS_PER_TASK,
    counts: DataFrame | None = None,
) -> DataFrame:
    """Shuffle join whose hot keys, nulls included, are split over several tasks.

    Keys with more than ``rows_per_task`` rows in ``rows`` are cut into that many pieces by a hash
    of ``spread_by`` (columns that tell the rows apart); the matching rows of ``other`` are
    repeated once per piece. All other keys join as usual. ``how`` must keep only rows of the left
    side: inner, left, left_semi or left_anti. ``counts`` (the keys and ``_rows``) may hand in a
    count the caller has already planned, so that its shuffle is shared.
    """
    on = list(on)
    _check_types(rows, other, on)
    hot = F.broadcast(hot_keys(rows, on, rows_per_task, counts))
    piece = F.pmod(F.xxhash64(*(spread_by or rows.columns)), F.coalesce("_pieces", F.lit(1)))
    left = _with_hot(rows, hot, on).withColumn("_piece", piece.cast("int")).drop("_pieces")
    pieces = F.sequence(F.lit(0), (F.coalesce("_pieces", F.lit(1)) - 1).cast("int"))
    right = _with_hot(other, hot, on).withColumn("_piece", F.explode(pieces)).drop("_pieces")
    return left.join(right, [*on, "_piece"], how).drop("_piece")


def balanced_join(
    left: DataFrame,
    right: DataFrame,
    on: Sequence[str],
    left_by: Sequence[str],
    right_by: Sequence[str],
    left_bound: Column | None = None,
    pairs_per_task: int = PAIRS_PER_TASK,
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """Inner many-to-many join whose heavy keys are cut on both sides.

    A key that would build more than ``pairs_per_task`` pairs is laid out as a grid: the rows of
    either side are hashed (by ``left_by`` and ``right_by``) into blocks of about ``block_rows``
    and every block meets every block of the other side in its own task. A side that fits one block
    stays whole, and the other is cut by pairs, as each cut repeats the rows of the side across. All such keys are written
    once, as a hash and two numbers each, and broadcast if there are few enough. ``left_bound``, a
    number no key has more left rows than, spares counting a left side that is expensive to compute.
    """
    on = list(on)
    _check_types(left, right, on)
    count = lambda df, name: df.groupBy(_key_hash(on)).agg(F.count(F.lit(1)).alias(name))
    load = count(right, "_r")
    load = load.withColumn("_l", left_bound) if left_bound is not None else load.join(count(left, "_l"), "_hot")
    load = load.withColumn("_pairs", F.col("_l") * F.col("_r"))
    by_pairs = F.col("_pairs") / pairs_per_task
    blocks = lambda n, across: F.ceil(
        F.when(F.col(across) <= block_rows, F.least(by_pairs, F.col(n))).otherwise(F.col(n) / block_rows)
    ).cast("int")
    heavy = load.filter(F.col("_pairs") > pairs_per_task)
    hot = write_through(heavy.select("_hot", blocks("_l", "_r").alias("_lb"), blocks("_r", "_l").alias("_rb")), "heavy")
    if fits_broadcast(hot):
        hot = F.broadcast(hot)
    one = F.lit(1)
    own = lambda by, n: F.pmod(F.xxhash64(*by), F.coalesce(n, one)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.coalesce(n, one) - 1))
    a = _with_hot(left, hot, on).withColumn("_i", own(left_by, "_lb")).withColumn("_j", every("_rb")).drop("_lb", "_rb")
    b = _with_hot(right, hot, on).withColumn("_j", own(right_by, "_rb")).withColumn("_i", every("_lb")).drop("_lb", "_rb")
    return a.join(b, [*on, "_i", "_j"]).drop("_i", "_j")


def hot_keys(
    rows: DataFrame, on: Sequence[str], rows_per_task: int = ROWS_PER_TASK, counts: DataFrame | None = None
) -> DataFrame:
    """Hashes of all keys with more than ``rows_per_task`` rows and the number of pieces to cut each into.

    Two numbers a key, however long the keys are. Keys with the same hash are cut alike, which both
    sides of a join see in the same way.
    """
    counts = (
        rows.groupBy(_key_hash(on)).agg(F.count(F.lit(1)).alias("_rows"))
        if counts is None
        else counts.select(_key_hash(on), "_rows")
    )
    pieces = F.ceil(F.max("_rows") / rows_per_task).cast("int").alias("_pieces")
    return counts.filter(F.col("_rows") > rows_per_task).groupBy("_hot").agg(pieces)


def in_pieces(
    rows: DataFrame, on: Sequence[str], by: Sequence[str], rows_per_piece: int, counts: DataFrame | None = None
) -> DataFrame:
    """``rows`` with ``_piece``: every key, nulls included, is cut into pieces of about ``rows_per_piece`` rows.

    ``by`` tells the rows of a key apart; ``counts`` is as in :func:`salted_join`.
    """
    hot = write_through(hot_keys(rows, on, rows_per_piece, counts), "hot")
    if fits_broadcast(hot):
        hot = F.broadcast(hot)
    piece = F.pmod(F.xxhash64(*by), F.coalesce("_pieces", F.lit(1)))
    return _with_hot(rows, hot, on).withColumn("_piece", piece.cast("int")).drop("_pieces")


def key_counts(rows: DataFrame, on: Sequence[str]) -> DataFrame:
    return rows.groupBy(*on).agg(F.count(F.lit(1)).alias("_rows"))


def _key_hash(on: Sequence[str]) -> Column:
    return F.xxhash64(*on).alias("_hot")


def _with_hot(df: DataFrame, hot: DataFrame, on: Sequence[str]) -> DataFrame:
    return df.withColumn("_hot", _key_hash(on)).join(hot, "_hot", "left").drop("_hot")


def _check_types(left: DataFrame, right: DataFrame, on: Sequence[str]) -> None:
    """Key hashes agree only between columns of the same type."""
    unlike = [c for c in on if left.schema[c].dataType.simpleString() != right.schema[c].dataType.simpleString()]
    if unlike:
        raise TypeError(f"join keys of different types: {', '.join(unlike)}")
