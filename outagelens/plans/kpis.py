"""Service KPIs: every grouped report is one scan with conditional averages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from outagelens import fixed_values as fixed
from outagelens.functions.rules import case_when, is_any, literal, named
from outagelens.functions.moments import inferred_moment
from outagelens.functions.service import hours_between, sla_hours
from outagelens.functions.text import month_label
from outagelens.operators.quantiles import grouped_quantiles
from outagelens.operators.shape import canonical_order

MEAN_NAMES = {"mean": F.avg, "sum": F.sum, "count": F.count, "min": F.min, "max": F.max,
              "std": F.stddev_samp, "nunique": F.count_distinct}


# --- subsets ---------------------------------------------------------------------

def reactive(clean: DataFrame, zones: list[str] = fixed.ZONE_ORDER) -> DataFrame:
    """Tickets of the canonical zones below priority 4."""
    return clean.where(F.expr(is_any("ZONE", zones)) & (F.col("Priority") < 4))


def sound(df: DataFrame) -> DataFrame:
    """Tickets whose timestamps hold."""
    return df.where("Timestamp_Integrity") if "Timestamp_Integrity" in df.columns else df


def dispatched(df: DataFrame) -> DataFrame:
    return df.where(F.col("Resolution_Path") == "Field_Dispatch_Restored")


def is_sound(df: DataFrame) -> Column:
    return F.col("Timestamp_Integrity") if "Timestamp_Integrity" in df.columns else F.lit(True)


def _grouped(df: DataFrame, by: str | None):
    return df.where(F.col(by).isNotNull()).groupBy(by) if by else df


# --- single KPIs -------------------------------------------------------------------

def mean_repair_time(df: DataFrame, by: str | None = None) -> DataFrame:
    return _grouped(df, by).agg(F.avg("OUTAGEDURATION").alias("MTTR"))


def sla_compliance(df: DataFrame, by: str | None = None) -> DataFrame:
    """Compliance in percent; groups count tickets with a verdict, the total counts all."""
    counted = F.count("SLA_Compliant") if by else F.count("*")
    return _grouped(df, by).agg(
        (F.avg("SLA_Compliant") * 100).alias("SLA_Compliance_Rate"), counted.alias("Ticket_Count")
    )


def fault_density(df: DataFrame, by: str) -> DataFrame:
    return _grouped(df, by).agg(
        F.count("TICKETID").alias("Total_Faults"),
        F.count_distinct("Area").alias("Unique_Sites"),
        (F.count("TICKETID") / F.count_distinct("Area")).alias("Fault_Density"),
    )


def _zero_per_group(df: DataFrame, by: str | None, name: str) -> DataFrame:
    groups = df.select(by).distinct() if by else df.sparkSession.range(1).select()
    return groups.withColumn(name, F.lit(0.0))


def _moment(df: DataFrame, name: str) -> Column:
    return inferred_moment(df, name) if dict(df.dtypes)[name] == "string" else F.col(name)


def triage_time(df: DataFrame, by: str | None = None) -> DataFrame:
    """Mean hours from report to dispatch on sound tickets; 0 when no column tells."""
    name, rows = "Avg_NOC_Time", sound(df)
    if "DISPATCH_DELAY_HOURS" in df.columns:
        hours = F.col("DISPATCH_DELAY_HOURS")
    elif {"DISPATCHDATE", "REPORTDATE"} <= set(df.columns):
        hours = hours_between(_moment(df, "REPORTDATE"), _moment(df, "DISPATCHDATE"))
    else:
        return _zero_per_group(rows, by, name)
    return _grouped(rows, by).agg(F.avg(hours).alias(name))


def field_time(df: DataFrame, by: str | None = None) -> DataFrame:
    """Mean hours from dispatch to resolution on sound tickets; 0 when no column tells."""
    name, rows, columns = "Avg_Field_Time", sound(df), set(df.columns)
    if "FIELD_TIME_HOURS" in columns:
        hours = F.col("FIELD_TIME_HOURS")
    elif {"RESOLVEDDATE", "DISPATCHDATE"} <= columns:
        hours = hours_between(_moment(df, "DISPATCHDATE"), _moment(df, "RESOLVEDDATE"))
    elif {"OUTAGEDURATION", "DISPATCH_DELAY_HOURS"} <= columns:
        hours = F.col("OUTAGEDURATION") - F.col("DISPATCH_DELAY_HOURS")
    else:
        return _zero_per_group(rows, by, name)
    return _grouped(rows, by).agg(F.avg(hours).alias(name))


def ticket_volume(df: DataFrame, by: str) -> DataFrame:
    return _grouped(df, by).agg(F.count("*").alias("Ticket_Count"))


def kpi_tables(df: DataFrame, by: str = "ZONE") -> dict[str, DataFrame]:
    """The six KPI tables as separate lazy results."""
    return {
        "mttr": mean_repair_time(df, by),
        "sla": sla_compliance(df, by),
        "volume": ticket_volume(df, by),
        "fault_density": fault_density(df, by),
        "noc_time": triage_time(df, by),
        "field_time": field_time(df, by),
    }


# --- fused summaries -------------------------------------------------------------------

def kpi_summary(df: DataFrame, by: list[str]) -> DataFrame:
    """All KPIs of a grouping in one aggregation; groups without a sound ticket are left out."""
    held = is_sound(df)
    return (
        df.dropna(subset=by)
        .groupBy(*by)
        .agg(
            F.count("*").alias("Ticket_Count"),
            F.avg("OUTAGEDURATION").alias("MTTR"),
            (F.avg("SLA_Compliant") * 100).alias("SLA_Compliance_Rate"),
            F.count("TICKETID").alias("Total_Faults"),
            F.count_distinct("Area").alias("Unique_Sites"),
            (F.count("TICKETID") / F.count_distinct("Area")).alias("Fault_Density"),
            F.avg(F.when(held, F.col("DISPATCH_DELAY_HOURS"))).alias("Avg_NOC_Time"),
            F.avg(F.when(held, F.col("FIELD_TIME_HOURS"))).alias("Avg_Field_Time"),
            F.count_if(held).alias("_sound"),
        )
        .where("_sound > 0")
        .drop("_sound")
    )


def zone_summary(df: DataFrame, exclude_unknown: bool = True) -> DataFrame:
    """KPIs per zone, largest zone first."""
    rows = df.where(F.col("ZONE") != "Unknown") if exclude_unknown else df
    return kpi_summary(rows, ["ZONE"]).orderBy(F.desc("Ticket_Count"), F.asc("ZONE"))


def executive_summary(df: DataFrame) -> DataFrame:
    """Unweighted means of the zone KPIs, their totals and the period."""
    period = df.agg(F.min("REPORTDATE").alias("first"), F.max("REPORTDATE").alias("last"))
    means = zone_summary(df).agg(
        F.sum("Ticket_Count").alias("total_tickets"),
        F.avg("SLA_Compliance_Rate").alias("avg_sla"),
        F.avg("MTTR").alias("avg_mttr"),
        F.avg("Avg_NOC_Time").alias("avg_noc"),
        F.avg("Avg_Field_Time").alias("avg_field"),
        F.sum("Unique_Sites").alias("total_sites"),
        F.avg("Fault_Density").alias("avg_density"),
    )
    return means.select(
        "*",
        month_label(period.select("first").scalar()).alias("first_month"),
        month_label(period.select("last").scalar()).alias("last_month"),
    )


def overview(df: DataFrame) -> DataFrame:
    """One row: volume, distinct sites, period, mean duration, compliance, sound phase means."""
    held = is_sound(df)
    return df.agg(
        F.count("*").alias("tickets"),
        F.count_distinct("SiteName").alias("sites"),
        F.min("REPORTDATE").alias("first_report"),
        F.max("REPORTDATE").alias("last_report"),
        F.avg("OUTAGEDURATION").alias("mttr"),
        (F.avg("SLA_Compliant") * 100).alias("sla_rate"),
        F.avg(F.when(held, F.col("DISPATCH_DELAY_HOURS"))).alias("noc_time"),
        F.avg(F.when(held, F.col("FIELD_TIME_HOURS"))).alias("field_time"),
        *[share_where(F.col("Resolution_Path") == path, path) for path in fixed.PATH_ORDER],
    )


def share_where(condition: Column, name: str) -> Column:
    """Percentage of rows that meet a condition."""
    return (F.avg(condition.cast("int")) * 100).alias(name)


def integrity_report(df: DataFrame, by: str = "ZONE") -> DataFrame:
    """Tickets with bad timestamps per group, and phase means before and after leaving them out."""
    held = F.col("Timestamp_Integrity")
    corrupt = F.count_if(~held)
    delay, field = F.col("DISPATCH_DELAY_HOURS"), F.col("FIELD_TIME_HOURS")
    return _grouped(df, by).agg(
        F.count("*").alias("Total"),
        corrupt.alias("Corrupt"),
        (corrupt / F.count("*") * 100).alias("Pct"),
        F.when(corrupt > 0, F.avg(F.when(~held, delay))).otherwise(F.lit(0.0)).alias("Avg_Dispatch_Corrupt"),
        F.avg(delay).alias("NOC_All"),
        F.avg(F.when(held, delay)).alias("NOC_Sound"),
        F.avg(field).alias("Field_All"),
        F.avg(F.when(held, field)).alias("Field_Sound"),
    )


def phase_shares(df: DataFrame, by: str = "ZONE") -> DataFrame:
    """Share of the mean repair time spent in triage and in the field, on sound tickets."""
    return (
        _grouped(sound(df), by)
        .agg(
            F.avg("OUTAGEDURATION").alias("MTTR"),
            F.avg("DISPATCH_DELAY_HOURS").alias("Avg_NOC_Time"),
            F.avg("FIELD_TIME_HOURS").alias("Avg_Field_Time"),
        )
        .withColumn("NOC_Share", F.bround(F.col("Avg_NOC_Time") / F.col("MTTR") * 100, 1))
        .withColumn("Field_Share", F.bround(F.col("Avg_Field_Time") / F.col("MTTR") * 100, 1))
    )


def breach_rate() -> Column:
    return (1 - F.avg("SLA_Compliant")) * 100


def zone_priority_table(df: DataFrame, minimum: int = 20) -> DataFrame:
    """Volume, target, compliance, repair time and breaches per zone and priority."""
    labels = [(f"Priority = {number}", literal(label)) for number, label in fixed.PRIORITY_LABELS.items()]
    return (
        df.groupBy("ZONE", "Priority")
        .agg(
            F.count("*").alias("Tickets"),
            (F.avg("SLA_Compliant") * 100).alias("SLA_Rate"),
            F.avg("OUTAGEDURATION").alias("Avg_MTTR"),
            F.count_if(F.col("SLA_Compliant") == 0).alias("Breach_Count"),
        )
        .where(F.col("Tickets") >= minimum)
        .withColumn("Priority_Label", F.expr(case_when(labels)))
        .withColumn("_tier", F.concat(F.col("Priority").cast("string"), F.lit(".1")))
        .withColumn("SLA_Target_U1", sla_hours("_tier"))
        .drop("_tier")
    )


def tier_matrix(df: DataFrame) -> DataFrame:
    """Tickets and compliance per tier and zone, with the tier totals (zone missing), in one pass."""
    tiers = df.where(F.col("ZONE").isNotNull() & (F.col("ZONE") != "Unknown")).withColumn(
        "Tier", F.concat(F.lit("P"), F.col("Priority_Urgency"))
    )
    listed = tiers.where(F.expr(is_any(named("Tier"), fixed.TIER_ORDER)))
    return listed.groupingSets([["Tier", "ZONE"], ["Tier"]], "Tier", "ZONE").agg(
        F.count("SLA_Compliant").alias("Tickets"), F.avg("SLA_Compliant").alias("SLA_Rate")
    )


def aggregate_by_region(
    df: DataFrame, metric: str, how: str = "mean", region: str = "Region", titled: bool = False
) -> DataFrame:
    """One named aggregate per region in canonical order, under either naming style."""
    if how not in (*MEAN_NAMES, "median"):
        raise ValueError(f"Unknown aggregate: {how}")
    name = f"{metric.title()} ({how.title()})" if titled else f"{metric}_{how}"
    if how == "median":
        grouped = grouped_quantiles(df, [region], metric, {name: 0.5})
    else:
        grouped = _grouped(df, region).agg(MEAN_NAMES[how](metric).alias(name))
    return canonical_order(grouped, region, fixed.REGION_ORDER)


def outlier_groups(df: DataFrame, metric: str, by: str, threshold: float = 1.5) -> DataFrame:
    """Groups whose mean lies outside the quartiles by more than threshold times their distance."""
    means = _grouped(df, by).agg(F.avg(metric).alias(metric))
    quartiles = means.agg(F.percentile(metric, F.array(F.lit(0.25), F.lit(0.75))).alias("q")).scalar()
    low, high = quartiles[0], quartiles[1]
    margin = (high - low) * threshold
    value = F.col(metric)
    return (
        means.withColumns({"_low": low - margin, "_high": high + margin})
        .where((value < F.col("_low")) | (value > F.col("_high")))
        .withColumn("Outlier_Type", F.when(value < F.col("_low"), "Low").otherwise("High"))
        .drop("_low", "_high")
    )
