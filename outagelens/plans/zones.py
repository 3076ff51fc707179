"""Zone reports: priority mix, mix-adjusted times, scorecard, ranks, targets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from outagelens import fixed_values as fixed
from outagelens.functions.rules import case_when, literal, lookup, named
from outagelens.functions.service import rating, zone_exposure
from outagelens.operators.ranking import average_rank, min_max, min_rank
from outagelens.operators.shape import mean_of_columns, pivot, reindexed, row_percentages
from outagelens.plans import kpis

PRIORITIES = list(fixed.PRIORITY_LABELS)


def priority_mix(df: DataFrame) -> DataFrame:
    """Percentage of each priority in a zone's tickets, one column per priority."""
    wide = pivot(df, ["ZONE"], "Priority", PRIORITIES, F.count(F.lit(1)), fill=0)
    named_columns = wide.select("ZONE", *[F.col(f"`{p}`").alias(f"P{p}") for p in PRIORITIES])
    return row_percentages(named_columns, [f"P{p}" for p in PRIORITIES])


def _mix_and_times(df: DataFrame) -> DataFrame:
    """Per (zone, priority): ticket share in the zone, mean repair time and mean field time."""
    in_field = (F.col("Resolution_Path") == "Field_Dispatch_Restored") & kpis.is_sound(df)
    cells = df.groupBy("ZONE", "Priority").agg(
        F.count("*").alias("tickets"),
        F.avg("OUTAGEDURATION").alias("repair"),
        F.avg(F.when(in_field, F.col("FIELD_TIME_HOURS"))).alias("field"),
    )
    share = F.col("tickets") / F.sum("tickets").over(Window.partitionBy("ZONE"))
    return cells.withColumn("share", share)


def mix_adjusted(df: DataFrame) -> DataFrame:
    """Tier means weighted by the plain average, over zones, of the zones' tier shares.

    A tier that a zone lacks adds nothing; the weights are not rescaled.
    """
    cells = _mix_and_times(df)
    zones = cells.select("ZONE").distinct().agg(F.count("*")).scalar()
    weights = cells.groupBy("Priority").agg(F.sum("share").alias("share_sum"))
    weighted = cells.join(weights, "Priority").withColumn("weight", F.col("share_sum") / zones)

    def adjusted(mean: str) -> Column:
        return F.sum(F.coalesce(F.col(mean) * F.col("weight"), F.lit(0.0)))

    return weighted.groupBy("ZONE").agg(
        (F.sum(F.col("repair") * F.col("tickets")) / F.sum("tickets")).alias("Raw_MTTR"),
        adjusted("repair").alias("Adjusted_MTTR"),
        adjusted("field").alias("Adjusted_Field"),
    )


def scorecard(df: DataFrame) -> DataFrame:
    """Five dimensions rescaled to 0..100 over the zones, their weighted sum and its rank.

    Scores are rounded after the sum is formed.
    """
    high = F.col("Priority").isin(1, 2)
    base = df.groupBy("ZONE").agg(
        (F.avg("SLA_Compliant") * 100).alias("sla"),
        (F.avg(F.when(high, F.col("SLA_Compliant"))) * 100).alias("high_sla"),
        (F.count("TICKETID") / F.count_distinct("Area")).alias("density"),
    )
    measures = base.join(mix_adjusted(df), "ZONE")
    scores = measures.select(
        "ZONE",
        min_max(F.col("sla")).alias("SLA_Score"),
        min_max(F.col("high_sla")).alias("HighPrio_Score"),
        min_max(F.col("Adjusted_Field"), invert=True).alias("Field_Score"),
        min_max(F.col("density"), invert=True).alias("Density_Score"),
        min_max(F.col("Adjusted_MTTR"), invert=True).alias("MTTR_Score"),
    )
    weighted = [F.col(name) * weight for name, weight in fixed.SCORECARD_WEIGHTS.items()]
    total = weighted[0]
    for part in weighted[1:]:
        total = total + part
    names = [*fixed.SCORECARD_WEIGHTS, "Composite"]
    rounded = scores.withColumn("Composite", total).withColumns({n: F.bround(n, 1) for n in names})
    rank = average_rank(F.desc("Composite"), F.col("Composite")).cast("int")
    return rounded.withColumn("Rank", rank)


def composite_rank(df: DataFrame) -> DataFrame:
    """Mean of five KPI ranks (1 is best) and the rating it earns."""
    summary = kpis.zone_summary(df)
    ranks = {
        "R_SLA": F.desc("SLA_Compliance_Rate"),
        "R_MTTR": F.asc("MTTR"),
        "R_NOC": F.asc("Avg_NOC_Time"),
        "R_Field": F.asc("Avg_Field_Time"),
        "R_Density": F.asc("Fault_Density"),
    }
    ranked = summary.withColumns({name: min_rank(order) for name, order in ranks.items()})
    zones = F.count("*").over(Window.partitionBy())
    return (
        ranked.withColumn("Composite", mean_of_columns([F.col(name) for name in ranks]))
        .withColumn("_share", F.col("Composite") / zones)
        .withColumn("Rating", rating("_share"))
        .select("ZONE", *ranks, "Composite", "Rating")
    )


def kpi_rankings(df: DataFrame) -> DataFrame:
    """Zones ranked per KPI, each KPI in its own direction."""
    lower_is_better = {
        "MTTR": True, "SLA_Compliance_Rate": False, "Avg_NOC_Time": True,
        "Avg_Field_Time": True, "Fault_Density": True,
    }
    entries = [F.struct(F.lit(name).alias("KPI"), F.col(name).alias("Value")) for name in lower_is_better]
    long = kpis.zone_summary(df).select("ZONE", F.inline(F.array(*entries)))
    falling = [name for name, lower in lower_is_better.items() if not lower]
    signed = F.when(F.col("KPI").isin(falling), -F.col("Value")).otherwise(F.col("Value"))
    place = F.row_number().over(Window.partitionBy("KPI").orderBy(signed.asc_nulls_last(), "ZONE"))
    return long.withColumn("Rank", place)


def below_average_cells(df: DataFrame) -> DataFrame:
    """Zone and priority cells whose compliance is below the overall rate, with the gap."""
    cells = df.groupBy("ZONE", "Priority").agg((F.avg("SLA_Compliant") * 100).alias("SLA"))
    overall = df.agg((F.avg("SLA_Compliant") * 100)).scalar()
    return (
        cells.withColumn("Overall", overall)
        .where(F.col("SLA") < F.col("Overall"))
        .withColumn("Gap", F.col("Overall") - F.col("SLA"))
    )


def tier_breach(df: DataFrame, minimum: int = 50) -> DataFrame:
    """Breach rate per zone and tier with enough tickets."""
    return (
        df.groupBy("ZONE", "Priority_Urgency")
        .agg(F.count("SLA_Compliant").alias("Tickets"), kpis.breach_rate().alias("Breach_Rate"))
        .where(F.col("Tickets") >= minimum)
    )


def masked_zones(df: DataFrame, overall_floor: float = 0.80, top_floor: float = 0.75) -> DataFrame:
    """Zones that look fine overall while their top-priority tiers do not."""
    cells = kpis.tier_matrix(df).where(F.col("ZONE").isNotNull())
    top = (
        cells.where(F.col("Tier").startswith("P1"))
        .groupBy("ZONE")
        .agg(F.avg("SLA_Rate").alias("Top_Tier_SLA"))
    )
    overall = (
        df.where(F.col("ZONE").isNotNull() & (F.col("ZONE") != "Unknown"))
        .groupBy("ZONE")
        .agg(F.avg("SLA_Compliant").alias("Overall_SLA"))
    )
    return overall.join(top, "ZONE").where(
        (F.col("Overall_SLA") >= overall_floor) & (F.col("Top_Tier_SLA") < top_floor)
    )


def tier_summary(df: DataFrame) -> DataFrame:
    """Per tier: budget, volume, compliance and the worst zone (the first among equals)."""
    cells = kpis.tier_matrix(df)
    totals = cells.where(F.col("ZONE").isNull()).select(
        "Tier", F.col("Tickets").alias("Total_Tickets"), F.col("SLA_Rate").alias("Total_SLA")
    )
    worst = (
        cells.where(F.col("ZONE").isNotNull() & F.col("SLA_Rate").isNotNull())
        .groupBy("Tier")
        .agg(F.min(F.struct("SLA_Rate", "ZONE")).alias("worst"))
    )
    budgets = {f"P{tier}": hours for tier, hours in fixed.SLA_HOURS.items()}
    return totals.join(worst, "Tier", "left").select(
        "Tier",
        F.expr(lookup(named("Tier"), budgets)).alias("SLA_Budget"),
        "Total_Tickets", "Total_SLA",
        F.col("worst.ZONE").alias("Worst_Zone"),
        F.col("worst.SLA_Rate").alias("Worst_SLA"),
    )


def tier_breach_by_zone(df: DataFrame, tier: str = "3.2") -> DataFrame:
    """Breach share of one tier per zone in canonical order; 0 where a zone has none."""
    rows = df.where(F.col("Priority_Urgency") == tier).groupBy("ZONE").agg(
        F.count("SLA_Compliant").alias("Tickets"), (1 - F.avg("SLA_Compliant")).alias("Breach")
    )
    return reindexed(rows, "ZONE", fixed.ZONE_ORDER).fillna(0, ["Tickets", "Breach"])


def targets(df: DataFrame) -> DataFrame:
    """Current KPIs per zone with the targets that follow from them."""
    def of_zone(position: int) -> Column:
        table = {zone: values[position] for zone, values in fixed.ZONE_TARGETS.items() if values[position] is not None}
        return F.expr(lookup(named("ZONE"), table)).cast("double")

    return kpis.zone_summary(df).select(
        "ZONE",
        zone_exposure("ZONE").alias("Exposure"),
        F.col("SLA_Compliance_Rate").alias("SLA_Now"),
        (F.col("SLA_Compliance_Rate") + of_zone(0)).alias("SLA_Target"),
        F.col("MTTR").alias("MTTR_Now"),
        (F.col("MTTR") * of_zone(1)).alias("MTTR_Target"),
        F.col("Avg_Field_Time").alias("Field_Now"),
        (F.col("Avg_Field_Time") * of_zone(2)).alias("Field_Target"),
    )


def zone_shares(df: DataFrame) -> DataFrame:
    """Tickets per canonical zone and their share of all zoned tickets."""
    counted = df.groupBy("ZONE").agg(F.count("*").alias("Tickets"))
    total = counted.agg(F.sum("Tickets")).scalar()
    shares = counted.withColumn("Share", F.col("Tickets") / total * 100)
    return reindexed(shares, "ZONE", fixed.ZONE_ORDER).fillna(0, ["Tickets", "Share"])


def phase_extremes(df: DataFrame) -> DataFrame:
    """The zones with the largest triage share and the largest field share."""
    shares = kpis.phase_shares(df)
    return shares.agg(
        F.max(F.struct(F.col("NOC_Share").alias("value"), F.col("ZONE").alias("zone"))).alias("noc"),
        F.max(F.struct(F.col("Field_Share").alias("value"), F.col("ZONE").alias("zone"))).alias("field"),
    ).select(
        F.inline(
            F.array(
                F.struct(F.lit("largest triage share").alias("metric"), F.col("noc.zone"), F.col("noc.value")),
                F.struct(F.lit("largest field share").alias("metric"), F.col("field.zone"), F.col("field.value")),
            )
        )
    )


def priority_label(column: str = "Priority") -> Column:
    labels = [(f"{named(column)} = {number}", literal(label)) for number, label in fixed.PRIORITY_LABELS.items()]
    return F.expr(case_when(labels))
