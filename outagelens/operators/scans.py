"""Running sums over groups of any size: a prefix scan over ranges whose borders are sampled from the rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from outagelens.sources.checkpoints import stored


def ranged(df: DataFrame, keys: list[Column], parts: int | None = None) -> DataFrame:
    """The rows dealt over ranges of `keys`, numbered in key order by `_range`.

    Spark samples the borders from the rows, so ranges hold about as many rows each, whatever the values look like.
    Rows equal in all keys share a range: end the keys with a unique column. The rows are stored, so that a range
    stays the same however often it is read.
    """
    dealt = df.repartitionByRange(parts, *keys) if parts else df.repartitionByRange(*keys)
    return stored(dealt.withColumn("_range", F.spark_partition_id()), "ranges")


def range_starts(placed: DataFrame, by: list[str], amounts: list[str]) -> DataFrame:
    """(_range, by, _start_<amount>, _sum_<amount>): what a group's earlier ranges add up to, and its own range."""
    sums = placed.groupBy("_range", *by).agg(*[F.sum(amount).alias(f"_sum_{amount}") for amount in amounts])
    before = Window.partitionBy(*by).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    return sums.withColumns(
        {f"_start_{amount}": F.coalesce(F.sum(f"_sum_{amount}").over(before), F.lit(0)) for amount in amounts}
    )


def running_sums(
    df: DataFrame, by: list[str], order: list[Column], amounts: dict[str, str], parts: int | None = None
) -> DataFrame:
    """df with running sums inside each group in the order given; `amounts` maps a number column to its running column.

    1. Rows are dealt over ranges of (by, order).
    2. Sums per range and group are added up to where each range begins: at most one row per range and group.
    3. A window adds up the rows of one range and group.

    No task sees more than about one range, however large a group or a tie is. Rows of a group whose key is missing
    are left out. End the order with a unique column; rows equal in all of it come in any order.
    """
    present = df.dropna(subset=by) if by else df
    placed = ranged(present, [*[F.col(key) for key in by], *order], parts)
    starts = range_starts(placed, by, list(amounts)).drop(*[f"_sum_{amount}" for amount in amounts])
    inside = Window.partitionBy("_range", *by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    summed = placed.withColumns({into: F.sum(amount).over(inside) for amount, into in amounts.items()})
    return (
        summed.join(starts, ["_range", *by])
        .withColumns({into: F.col(into) + F.col(f"_start_{amount}") for amount, into in amounts.items()})
        .drop("_range", *[f"_start_{amount}" for amount in amounts])
    )
