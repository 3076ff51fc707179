"""Resolution paths and fault causes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from outagelens import fixed_values as fixed
from outagelens.operators.quantiles import grouped_quantiles
from outagelens.operators.shape import compared, reindexed, share_of_parent
from outagelens.plans import kpis

CAUSE = "Standardized RFO"


def path_table(df: DataFrame) -> DataFrame:
    """Share, mean repair time and compliance per path, one row per canonical zone."""
    short = {"Auto_Self_Restored": "Auto", "NOC_Remote_Restored": "NOC", "Field_Dispatch_Restored": "Field"}
    wide = df.groupBy("ZONE").pivot("Resolution_Path", fixed.PATH_ORDER).agg(
        F.count(F.lit(1)).alias("n"),
        F.avg("OUTAGEDURATION").alias("mttr"),
        (F.avg("SLA_Compliant") * 100).alias("sla"),
    )
    total = sum((F.coalesce(F.col(f"{path}_n"), F.lit(0)) for path in fixed.PATH_ORDER), F.lit(0))
    columns = []
    for path, name in short.items():
        columns += [
            (F.coalesce(F.col(f"{path}_n"), F.lit(0)) / total * 100).alias(f"{name}_Pct"),
            F.coalesce(F.col(f"{path}_mttr"), F.lit(0.0)).alias(f"{name}_MTTR"),
            F.coalesce(F.col(f"{path}_sla"), F.lit(0.0)).alias(f"{name}_SLA"),
        ]
    return reindexed(wide.select("ZONE", total.alias("Total_Tickets"), *columns), "ZONE", fixed.ZONE_ORDER)


def path_split(df: DataFrame) -> DataFrame:
    """Tickets and share per path; a path without tickets shows 0."""
    counted = df.groupBy("Resolution_Path").agg(F.count("*").alias("Tickets"))
    total = counted.agg(F.sum("Tickets")).scalar()
    return reindexed(counted, "Resolution_Path", fixed.PATH_ORDER).fillna(0, ["Tickets"]).withColumn(
        "Pct", F.col("Tickets") / total * 100
    )


def field_time_distribution(df: DataFrame, by: list[str]) -> DataFrame:
    """Median, mean, spread and upper quartile of the field time of dispatched sound tickets."""
    rows = kpis.sound(kpis.dispatched(df))
    moments = rows.groupBy(*by).agg(
        F.avg("FIELD_TIME_HOURS").alias("Mean"), F.stddev_samp("FIELD_TIME_HOURS").alias("Std")
    )
    exact = grouped_quantiles(rows, by, "FIELD_TIME_HOURS", {"Median": 0.5, "P75": 0.75})
    return moments.join(exact, by)


def _timed(rows: DataFrame, by: str, hours: str, mean_name: str, minimum: int) -> DataFrame:
    return (
        rows.where(F.col(by).isNotNull())
        .groupBy(by)
        .agg(
            F.avg(hours).alias(mean_name),
            F.count(hours).alias("Ticket_Count"),
            (F.avg("SLA_Compliant") * 100).alias("SLA_Rate"),
        )
        .where(F.col("Ticket_Count") >= minimum)
    )


def cause_field_time(df: DataFrame, minimum: int = 30) -> DataFrame:
    return _timed(kpis.sound(kpis.dispatched(df)), CAUSE, "FIELD_TIME_HOURS", "Avg_Field_Time", minimum)


def cause_triage_time(df: DataFrame, minimum: int = 30) -> DataFrame:
    return _timed(kpis.sound(df), CAUSE, "DISPATCH_DELAY_HOURS", "Avg_NOC_Time", minimum)


def category_field_time(df: DataFrame) -> DataFrame:
    return _timed(kpis.sound(kpis.dispatched(df)), "NE_Category", "FIELD_TIME_HOURS", "Avg_Field_Time", 0)


def cause_by_zone(df: DataFrame, n: int = 12) -> DataFrame:
    """Percentage of the zone's tickets for the n most frequent causes, one column per zone."""
    shares = share_of_parent(df, ["ZONE"], CAUSE)
    top = (
        shares.groupBy(CAUSE).agg(F.sum("Count").alias("Total")).orderBy(F.desc("Total"), F.asc(CAUSE)).limit(n)
    )
    wide = shares.join(top, CAUSE).groupBy(CAUSE, "Total").pivot("ZONE", fixed.ZONE_ORDER).agg(F.first("Pct"))
    return wide.fillna(0.0, fixed.ZONE_ORDER)


def category_by_zone(df: DataFrame) -> DataFrame:
    """Percentage of the zone's tickets per equipment category, with the row total that orders them."""
    shares = share_of_parent(df, ["ZONE"], "NE_Category")
    wide = shares.groupBy("NE_Category").pivot("ZONE", fixed.ZONE_ORDER).agg(F.first("Pct"))
    filled = wide.fillna(0.0, fixed.ZONE_ORDER)
    total = sum((F.col(f"`{zone}`") for zone in fixed.ZONE_ORDER), F.lit(0.0))
    return filled.withColumn("Row_Total", total).orderBy(F.desc("Row_Total"), "NE_Category")


def cause_fingerprint(df: DataFrame, zones: tuple[str, str] = ("ZONE 5", "ZONE 6"), n: int = 10) -> DataFrame:
    """Cause shares of two zones side by side, for the causes most frequent in both together."""
    rows = df.where(F.col("ZONE").isin(list(zones)))
    top = rows.groupBy(CAUSE).agg(F.count("*").alias("Count")).orderBy(F.desc("Count"), F.asc(CAUSE)).limit(n)
    both = compared(rows, F.col("ZONE"), {zones[0]: "First_Pct", zones[1]: "Second_Pct"}, CAUSE)
    return both.join(top.select(CAUSE), CAUSE, "left_semi")


def shared_causes(fingerprint: DataFrame, floor: float = 5.0) -> DataFrame:
    """Causes above the floor in both zones."""
    first = fingerprint.where(F.col("First_Pct") > floor).select(CAUSE)
    second = fingerprint.where(F.col("Second_Pct") > floor).select(CAUSE)
    return first.intersect(second)


def slow_causes(df: DataFrame, zones: list[str], minimum: int = 20) -> DataFrame:
    """Mean field time per zone and cause with enough tickets, slowest first inside a zone."""
    rows = kpis.sound(kpis.dispatched(df)).where(F.col("ZONE").isin(zones))
    return (
        rows.groupBy("ZONE", CAUSE)
        .agg(F.avg("FIELD_TIME_HOURS").alias("Avg_Field_Time"), F.count("FIELD_TIME_HOURS").alias("Tickets"))
        .where(F.col("Tickets") >= minimum)
        .orderBy("ZONE", F.desc("Avg_Field_Time"), CAUSE)
    )


def top_causes(df: DataFrame, by: str, n: int = 5) -> DataFrame:
    """The n most frequent causes per group; equal counts in label order."""
    from outagelens.operators.ranking import top_n_per_group

    counted = df.dropna(subset=[by, CAUSE]).groupBy(by, CAUSE).agg(F.count("*").alias("Count"))
    return top_n_per_group(counted, [by], [F.desc("Count"), F.asc(CAUSE)], n)
