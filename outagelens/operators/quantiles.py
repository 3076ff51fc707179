"""Exact interpolated quantiles per group that never gather a group in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from outagelens.operators.scans import range_starts, ranged

#: The key of a table that is one group.
EVERYTHING = "_all"


def value_table(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """How often each value of a number column occurs per group: columns `by`, _value, _n."""
    return (
        df.where(F.col(value).isNotNull())
        .dropna(subset=by)
        .groupBy(*by, F.col(value).cast("double").alias("_value"))
        .agg(F.count("*").alias("_n"))
    )


def grouped_quantiles(df: DataFrame, by: list[str], value: str, quantiles: dict[str, float]) -> DataFrame:
    """One row per group with one column per requested quantile (linear interpolation)."""
    keys = by or [EVERYTHING]
    source = df if by else df.withColumn(EVERYTHING, F.lit(1))
    result = quantiles_of(value_table(source, keys, value), keys, quantiles)
    return result if by else result.drop(EVERYTHING)


def quantiles_of(counted: DataFrame, keys: list[str], quantiles: dict[str, float]) -> DataFrame:
    """Quantiles of a value table; infinities are values like others, and NaN is one value above them.

    1. Equal values have been counted (combined before the shuffle).
    2. They are dealt over ranges of (group, value) whose borders Spark samples, so no range is much larger than
       another, however the values are spread; counts per range say which range holds each wanted rank.
    3. Only those ranges are ranked value by value.
    """
    placed = ranged(counted, [*[F.col(key) for key in keys], F.col("_value")])
    ranges = range_starts(placed, keys, ["_n"])
    sizes = ranges.groupBy(*keys).agg(F.sum("_sum__n").alias("_total"))
    wanted = F.array(
        *[F.struct(F.lit(name).alias("name"), F.lit(float(share)).alias("share")) for name, share in quantiles.items()]
    )
    position = (F.col("_total") - 1) * F.col("_want.share")
    located = (
        ranges.join(sizes, keys)
        .withColumn("_want", F.explode(wanted))
        .withColumn("_position", position)
        .withColumn("_side", F.explode(F.array(F.lit("low"), F.lit("high"))))
        .withColumn(
            "_rank",
            F.when(F.col("_side") == "low", F.floor("_position")).otherwise(F.ceil("_position")),
        )
        .where((F.col("_rank") >= F.col("_start__n")) & (F.col("_rank") < F.col("_start__n") + F.col("_sum__n")))
        .select(
            "_range", *keys, "_side",
            F.col("_want.name").alias("_name"),
            (F.col("_position") - F.floor("_position")).alias("_fraction"),
            (F.col("_rank") - F.col("_start__n")).alias("_rank"),
        )
    )
    # One running count for all ranks wanted of a range; a row is kept where it holds one.
    searched = placed.join(located.select("_range", *keys).distinct(), ["_range", *keys], "left_semi")
    within = Window.partitionBy("_range", *keys).orderBy("_value").rowsBetween(Window.unboundedPreceding, 0)
    counts = searched.withColumn("_upto", F.sum("_n").over(within))
    wants = located.groupBy("_range", *keys).agg(F.collect_list(F.struct("_name", "_side", "_fraction", "_rank")).alias("_wants"))
    held = F.filter("_wants", lambda w: (w["_rank"] >= F.col("_upto") - F.col("_n")) & (w["_rank"] < F.col("_upto")))
    picked = counts.join(wants, ["_range", *keys]).select(*keys, "_value", F.inline(held))
    columns = []
    for name in quantiles:
        low = F.max(F.when((F.col("_name") == name) & (F.col("_side") == "low"), F.col("_value")))
        high = F.max(F.when((F.col("_name") == name) & (F.col("_side") == "high"), F.col("_value")))
        fraction = F.max(F.when(F.col("_name") == name, F.col("_fraction")))
        # Between a value and itself there is nothing to interpolate, whether it is a number, infinite or NaN.
        columns.append(F.when((low == high) | (fraction == 0), low).otherwise(low + (high - low) * fraction).alias(name))
    return picked.groupBy(*keys).agg(*columns)
