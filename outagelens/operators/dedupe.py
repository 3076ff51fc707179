"""Keep one row per key, and the per-step row counts of a cleaning funnel."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from outagelens.functions.nulls import present_and


DUPLICATE_STEP = "Drop duplicate TICKETID"


def keep_first(df: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """The first row of every key in the declared order.

    Spark turns the rank filter into a per-task group limit in front of the
    shuffle, so a key that fills a third of the table arrives as one row per task.
    """
    place = F.row_number().over(Window.partitionBy(*key).orderBy(*order))
    return df.withColumn("_place", place).where("_place = 1").drop("_place")


def first_failed_step(steps: list[tuple[str, Column]]) -> Column:
    """Number (from 1) of the first step whose keep-condition a row misses."""
    failed = F.lit(None).cast("int")
    for number, (_, keep) in reversed(list(enumerate(steps, start=1))):
        failed = F.when(~present_and(keep), F.lit(number)).otherwise(failed)
    return failed


def cleaning_funnel(
    df: DataFrame, key: list[str], order: list[str], steps: list[tuple[str, Column]]
) -> DataFrame:
    """Rows dropped and left per step; step 0 removes repeated keys.

    One aggregation by key (combined before the shuffle) yields the number of
    copies and the fate of the first copy; no row-level window is needed.
    """
    per_key = (
        df.select(*key, F.struct(*order).alias("_order"), first_failed_step(steps).alias("_failed"))
        .groupBy(*key)
        .agg(F.count("*").alias("_copies"), F.min_by("_failed", "_order").alias("_failed"))
    )
    counted = per_key.agg(
        F.coalesce(F.sum("_copies"), F.lit(0)).alias("_rows"),
        F.coalesce(F.sum(F.col("_copies") - 1), F.lit(0)).alias("_dropped_0"),
        *[F.count_if(F.col("_failed") == number).alias(f"_dropped_{number}") for number in range(1, len(steps) + 1)],
    )
    names = [DUPLICATE_STEP] + [name for name, _ in steps]
    entries, left = [], F.col("_rows")
    for number, name in enumerate(names):
        dropped = F.col(f"_dropped_{number}")
        left = left - dropped
        entries.append(
            F.struct(
                F.lit(number).alias("step"),
                F.lit(name).alias("rule"),
                dropped.alias("dropped"),
                left.alias("remaining"),
            )
        )
    return counted.select(F.inline(F.array(*entries)))
