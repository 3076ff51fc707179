"""Named extreme rows of report tables, as (metric, group, value) lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def extreme_rows(df: DataFrame, group: str, group_name: str, metrics: list[tuple[str, str, bool]]) -> DataFrame:
    """For each (metric, column, largest) the group that holds the extreme and its value.

    Among equals the largest side takes the last group name, the smallest side the first.
    """
    def entry(column: str) -> Column:
        return F.struct(F.col(column).cast("double").alias("value"), F.col(group).alias("name"))

    found = df.agg(
        *[
            (F.max if largest else F.min)(F.when(F.col(column).isNotNull(), entry(column))).alias(f"m{i}")
            for i, (_, column, largest) in enumerate(metrics)
        ]
    )
    rows = [
        F.struct(F.lit(metric).alias("metric"), F.col(f"m{i}.name").alias(group_name), F.col(f"m{i}.value").alias("value"))
        for i, (metric, _, _) in enumerate(metrics)
    ]
    return found.select(F.inline(F.array(*rows)))
