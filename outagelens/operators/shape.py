"""Pivots, shares and comparisons of aggregated tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from outagelens.functions.rules import order_in


def share_of_parent(df: DataFrame, parent: list[str], child: str) -> DataFrame:
    """Rows per (parent, child) with the percentage of the parent's rows."""
    counted = df.dropna(subset=[*parent, child]).groupBy(*parent, child).agg(F.count("*").alias("Count"))
    total = F.sum("Count").over(Window.partitionBy(*parent))
    return counted.withColumn("Parent_Total", total).withColumn("Pct", F.col("Count") / total * 100)


def pivot(df: DataFrame, by: list[str], column: str, values: list, cell: Column, fill=None) -> DataFrame:
    """Long to wide over a stated list of column values."""
    wide = df.dropna(subset=by).groupBy(*by).pivot(column, values).agg(cell)
    return wide if fill is None else wide.fillna(fill, subset=[str(value) for value in values])


def row_percentages(wide: DataFrame, columns: list[str]) -> DataFrame:
    """Each cell as a percentage of its row."""
    total = sum((F.col(f"`{c}`") for c in columns), F.lit(0))
    return wide.withColumns({c: F.col(f"`{c}`") / total * 100 for c in columns})


def reindexed(df: DataFrame, column: str, values: list[str], position: str = "ord") -> DataFrame:
    """One row per canonical value, in canonical order, missing where the table has none."""
    dimension = df.sparkSession.range(len(values)).select(
        F.element_at(F.array(*[F.lit(v) for v in values]), (F.col("id") + 1).cast("int")).alias(column),
        (F.col("id") + 1).cast("int").alias(position),
    )
    return dimension.join(df, column, "left")


def canonical_order(df: DataFrame, column: str, values: list[str], position: str = "ord") -> DataFrame:
    """Sort in canonical order; foreign values become missing and come last."""
    place = order_in(values, column)
    return (
        df.withColumn(position, place)
        .withColumn(column, F.when(place.isNotNull(), F.col(column)))
        .orderBy(F.col(position).asc_nulls_last())
    )


def compared(df: DataFrame, cohort: Column, names: dict, category: str) -> DataFrame:
    """Percentage of each category inside each cohort, side by side; absent is 0.

    `names` maps a cohort value to its output column; one pass over the rows.
    """
    counted = df.where(F.col(category).isNotNull()).groupBy(category).agg(
        *[F.count_if(cohort == value).alias(name) for value, name in names.items()]
    )
    totals = counted.agg(*[F.sum(name).alias(name) for name in names.values()])
    columns = []
    for name in names.values():
        total = totals.select(name).scalar()
        columns.append(F.coalesce(F.col(name) / F.nullif(total, F.lit(0)) * 100, F.lit(0.0)).alias(name))
    return counted.select(category, *columns)


def with_percentage(df: DataFrame, count: str, total: float | None = None, decimals: int = 1) -> DataFrame:
    """Count as a rounded percentage of the given total or of the column sum; 0 without a total."""
    whole = F.lit(float(total)) if total is not None else df.agg(F.sum(count).cast("double")).scalar()
    share = F.when(whole > 0, F.col(count) / whole * 100).otherwise(F.lit(0.0))
    return df.withColumn("Percentage", F.bround(share, decimals))


def mean_of_columns(columns: list[Column]) -> Column:
    """Row mean that skips missing cells."""
    present = sum((F.when(c.isNotNull(), 1).otherwise(0) for c in columns), F.lit(0))
    total = sum((F.coalesce(c.cast("double"), F.lit(0.0)) for c in columns), F.lit(0.0))
    return F.when(present > 0, total / present)
