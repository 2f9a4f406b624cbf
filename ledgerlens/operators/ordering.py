"""Global ranks and dense numbers without a window over all rows in one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerlens.functions.identifiers import padded
from ledgerlens.session import checkpointed

# monotonically_increasing_id keeps the partition number above the row number.
_ROW_BITS = 33


def _sorted_ranges(df: DataFrame, order: Sequence[Column]) -> DataFrame:
    """``df`` range-partitioned and sorted, each row with its range and place in it.

    Range bounds come from a sample, so the numbered rows are checkpointed: both
    passes over them must see the same ranges.
    """
    place = F.monotonically_increasing_id()
    return checkpointed(df.orderBy(*order).withColumn("_place", place)).select(
        *df.columns,
        F.shiftright("_place", _ROW_BITS).alias("_range"),
        F.col("_place").bitwiseAND(F.lit((1 << _ROW_BITS) - 1)).alias("_offset"),
    )


def _range_starts(ranges: DataFrame, size: Column) -> DataFrame:
    """Rows before each range. One row per range, a few thousand at most, which is
    what makes both the plain window and the broadcast of it safe."""
    sizes = ranges.groupBy("_range").agg(size.alias("_size"))
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("_range", F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_start"))
    return F.broadcast(starts)


def dense_numbers(df: DataFrame, order: Sequence[Column], name: str = "sequence") -> DataFrame:
    """Numbers 1, 2, 3, ... in ``order``, which must be total."""
    ranges = _sorted_ranges(df, order)
    starts = _range_starts(ranges, F.count(F.lit(1)))
    number = (F.col("_start") + F.col("_offset") + 1).cast("bigint")
    return ranges.join(starts, "_range").select(*df.columns, number.alias(name))


def dense_ids(df: DataFrame, order: Sequence[Column], prefix: str, name: str, width: int = 4) -> DataFrame:
    """Dense numbers as text ids, ``INV0001``, beside the number itself."""
    numbered = dense_numbers(df, order)
    return numbered.withColumn(name, padded(prefix, F.col("sequence"), width))


def exact_rank(df: DataFrame, column: str, ascending: bool = False, name: str = "rank") -> DataFrame:
    """SQL ``rank()`` over the whole table; null values get no rank.

    Ranks are worked out over the distinct values with their counts, so a value that
    many rows share is one row here, and joined back to the rows, where adaptive
    execution splits it.
    """
    order = F.col(column).asc() if ascending else F.col(column).desc()
    values = df.filter(F.col(column).isNotNull()).groupBy(column).agg(F.count(F.lit(1)).alias("_n"))
    ranges = _sorted_ranges(values, [order])
    starts = _range_starts(ranges, F.sum("_n"))
    within = Window.partitionBy("_range").orderBy("_offset").rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.sum("_n").over(within), F.lit(0))
    ranks = (
        ranges.withColumn("_before", before)
        .join(starts, "_range")
        .select(column, (F.col("_start") + F.col("_before") + 1).cast("bigint").alias(name))
    )
    return df.join(ranks, column, "left").select(*df.columns, name)


def extreme_rows(df: DataFrame, column: str, key: str, k: int = 3, ascending: bool = True) -> DataFrame:
    """The ``k`` rows with the smallest (or largest) value, ties by key, nulls last."""
    order = F.col(column).asc_nulls_last() if ascending else F.col(column).desc_nulls_last()
    return df.orderBy(order, F.col(key).asc()).limit(k)
