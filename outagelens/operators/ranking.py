"""Ranks, running shares, equality measures and top-n, laid out for large groups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from outagelens.operators.scans import running_sums

EVERYTHING_BEFORE = (Window.unboundedPreceding, 0)


# --- ranks of small aggregated tables (zones, cities, tiers) ----------------------

def average_rank(order: Column, value: Column, by: list[str] | None = None) -> Column:
    """Mean of the positions that equal values share."""
    window = Window.partitionBy(*(by or []))
    ties = F.count("*").over(Window.partitionBy(*(by or []), value))
    return F.rank().over(window.orderBy(order)) + (ties - 1) / F.lit(2.0)


def min_rank(order: Column, by: list[str] | None = None) -> Column:
    return F.rank().over(Window.partitionBy(*(by or [])).orderBy(order))


def min_max(value: Column, by: list[str] | None = None, invert: bool = False) -> Column:
    """Rescale to 0..100 over the rows at hand, optionally turned around."""
    window = Window.partitionBy(*(by or []))
    low, high = F.min(value).over(window), F.max(value).over(window)
    scaled = (value - low) / (high - low + F.lit(1e-9)) * 100
    return 100 - scaled if invert else scaled


# --- first rows ---------------------------------------------------------------------

def top_n(df: DataFrame, order: list[Column], n: int) -> DataFrame:
    """The first n rows; end the order with a unique column."""
    return df.orderBy(*order).limit(n)


def top_n_per_group(df: DataFrame, by: list[str], order: list[Column], n: int, rank: str = "Rank") -> DataFrame:
    """The first n rows of every group, limited per task before the shuffle."""
    place = F.row_number().over(Window.partitionBy(*by).orderBy(*order))
    return df.withColumn(rank, place).where(F.col(rank) <= n)


def value_counts(df: DataFrame, column: str, keep_missing: bool = False) -> DataFrame:
    """Rows per value with the share of all counted rows."""
    source = df if keep_missing else df.where(F.col(column).isNotNull())
    counted = source.groupBy(column).agg(F.count("*").alias("Count"))
    total = counted.agg(F.sum("Count")).scalar()
    return counted.withColumn("Pct", F.col("Count") / total * 100)


# --- running sums over many rows -------------------------------------------------------

def pareto(df: DataFrame, by: list[str], name: str, count: str) -> DataFrame:
    """Rank, running count and running share, largest first.

    Equal counts follow the name, as in every top-n.
    """
    summed = running_sums(
        df.withColumn("_one", F.lit(1)), by, [F.desc(count), F.col(name)], {"_one": "Rank", count: "Running_Count"}
    )
    if by:
        summed = summed.join(df.groupBy(*by).agg(F.sum(count).alias("_total")), by)
        total = F.col("_total")
    else:
        total = df.agg(F.sum(count)).scalar()
    return summed.withColumn("Cumulative_Pct", F.col("Running_Count") / total * 100).drop("_one", "_total")


def value_ranks(df: DataFrame, by: list[str], row: list[str], ranks: dict[str, str]) -> DataFrame:
    """Percentile ranks (0..100) of every row inside its group, for several measures at once.

    `row` names the columns that identify a row, and `ranks` maps a measure to
    its rank column.  Equal values share the mean position; NaN is one value,
    above infinity; missing values come last as one tie and count in the
    denominator.
    """
    measures = F.array(
        *[F.struct(F.lit(name).alias("_measure"), F.col(name).cast("double").alias("_value")) for name in ranks]
    )
    long = df.select(*dict.fromkeys([*by, *row]), F.inline(measures))
    group = [*by, "_measure"]
    counted = long.groupBy(*group, "_value").agg(F.count("*").alias("_n"))
    placed = running_sums(counted, group, [F.col("_value").asc_nulls_last()], {"_n": "_upto"})
    sizes = placed.groupBy(*group).agg(F.max("_upto").alias("_size"))
    mean_place = F.col("_upto") - F.col("_n") + (F.col("_n") + 1) / F.lit(2.0)
    positions = placed.join(sizes, group).select(
        *[F.col(key).alias(f"_of_{key}") for key in [*group, "_value"]],
        (mean_place / F.col("_size") * 100).alias("_rank"),
    )
    same = long["_value"].eqNullSafe(positions["_of__value"])
    for key in group:
        same = same & (long[key] == positions[f"_of_{key}"])
    ranked = long.join(positions, same)
    wide = ranked.groupBy(*row).agg(
        *[F.max(F.when(F.col("_measure") == name, F.col("_rank"))).alias(into) for name, into in ranks.items()]
    )
    return df.join(wide, row)


# --- equality of load ---------------------------------------------------------------------

def gini(df: DataFrame, by: list[str], count: str, into: str = "Gini") -> DataFrame:
    """Gini coefficient of a count column per group; 0 for one member or no load.

    Works on distinct counts: n rows can hold at most about sqrt(2n) of them.
    """
    distinct = df.groupBy(*by, F.col(count).alias("_x")).agg(F.count("*").alias("_n"))
    upto = F.sum("_n").over(Window.partitionBy(*by).orderBy("_x").rowsBetween(*EVERYTHING_BEFORE))
    n, x = F.col("_n"), F.col("_x").cast("double")
    placed = distinct.withColumn("_before", upto - n)
    positions = n * F.col("_before") + n * (n + 1) / F.lit(2.0)
    summed = placed.groupBy(*by).agg(
        F.sum("_n").alias("_members"),
        F.sum(x * n).alias("_load"),
        F.sum(x * positions).alias("_weighted"),
    )
    members, load = F.col("_members"), F.col("_load")
    value = 2 * F.col("_weighted") / (members * load) - (members + 1) / members
    return summed.select(*by, F.when((members < 2) | (load == 0), F.lit(0.0)).otherwise(value).alias(into))


def lorenz(df: DataFrame, by: list[str], name: str, count: str) -> DataFrame:
    """Cumulative share of members and of load, smallest load first, equal loads by name."""
    summed = running_sums(df.withColumn("_one", F.lit(1)), by, [F.col(count), F.col(name)], {"_one": "_place", count: "_load"})
    totals = df.groupBy(*by).agg(F.count("*").alias("_members"), F.sum(count).alias("_total"))
    return summed.join(totals, by).select(
        *by, name, count,
        (F.col("_place") / F.col("_members")).alias("Pop_Share"),
        (F.col("_load") / F.col("_total")).alias("Cum_Share"),
    )


def load_bands(df: DataFrame, by: list[str], count: str, into: str = "Load_Group") -> DataFrame:
    """High from the upper quartile on, Low up to the lower one, else Mid; High is tested first."""
    quartiles = df.groupBy(*by).agg(F.percentile(count, F.array(F.lit(0.25), F.lit(0.75))).alias("_q"))
    band = (
        F.when(F.col(count) >= F.col("_q")[1], "High load")
        .when(F.col(count) <= F.col("_q")[0], "Low load")
        .otherwise("Mid load")
    )
    return df.join(quartiles, by).withColumn(into, band).drop("_q")


def above_group_median(df: DataFrame, by: list[str], count: str, factor: float = 2.0) -> DataFrame:
    """Rows whose count exceeds a multiple of their group's median count."""
    medians = df.groupBy(*by).agg(F.median(count).alias("Group_Median"))
    return df.join(medians, by).where(F.col(count) > F.col("Group_Median") * factor)
