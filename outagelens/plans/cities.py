"""City reports: summary against the zone, risk, quadrants, class split, delays."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from outagelens import fixed_values as fixed
from outagelens.functions.service import city_class, delta_verdict, deviation_flag, ratio_flag
from outagelens.functions.text import without_prefix
from outagelens.operators.lookups import rows_of_large_groups
from outagelens.operators.quantiles import grouped_quantiles, quantiles_of, value_table
from outagelens.operators.ranking import min_max, top_n_per_group
from outagelens.plans import kpis

CITY = ["ZONE", "CITY"]
CAUSE = "Standardized RFO"
MIN_CITY_TICKETS = 50


def large_cities(df: DataFrame, minimum: int = MIN_CITY_TICKETS) -> DataFrame:
    return rows_of_large_groups(df, CITY, minimum)


def _city_measures(df: DataFrame) -> DataFrame:
    """Every city measure the reports need, in one aggregation."""
    held = kpis.is_sound(df)
    degraded = F.col("Priority_Urgency") == "3.2"
    return df.dropna(subset=CITY).groupBy(*CITY).agg(
        F.count("*").alias("Rows"),
        F.count("SLA_Compliant").alias("Tickets"),
        (F.avg("SLA_Compliant") * 100).alias("SLA_pct"),
        F.avg("OUTAGEDURATION").alias("Avg_MTTR"),
        F.count_distinct("SiteName").alias("Unique_Sites"),
        F.avg(F.when(held, F.col("DISPATCH_DELAY_HOURS"))).alias("Avg_NOC_Time"),
        F.avg(F.when(held, F.col("FIELD_TIME_HOURS"))).alias("Avg_Field_Time"),
        F.count(F.when(degraded, F.col("SLA_Compliant"))).alias("P32_Tickets"),
        ((1 - F.avg(F.when(degraded, F.col("SLA_Compliant")))) * 100).alias("P32_Breach"),
        F.avg(F.when(degraded, F.col("OUTAGEDURATION"))).alias("P32_MTTR"),
        F.count_if(F.col(CAUSE) == fixed.UNKNOWN_CAUSE).alias("Unknown_Tickets"),
        F.sum("SLA_Compliant").alias("_met"),
        F.sum(F.when(degraded, F.col("SLA_Compliant"))).alias("_p32_met"),
        F.count(F.when(held, F.col("DISPATCH_DELAY_HOURS"))).alias("_delays"),
        F.count(F.when(held, F.col("FIELD_TIME_HOURS"))).alias("_fields"),
        F.sum(F.when(held, F.col("FIELD_TIME_HOURS"))).alias("_field_hours"),
        F.count_if(held).alias("_sound_rows"),
        F.count(F.when(held, F.col("SLA_Compliant"))).alias("_sound_judged"),
        F.sum(F.when(held, F.col("SLA_Compliant"))).alias("_sound_met"),
    )


def city_summary(df: DataFrame, minimum: int = MIN_CITY_TICKETS) -> DataFrame:
    """KPIs per city with enough tickets and the distance to the zone's own rate."""
    cities = _city_measures(df)
    zone = Window.partitionBy("ZONE")
    with_zone = cities.withColumn("Zone_SLA", F.sum("_met").over(zone) / F.sum("Tickets").over(zone) * 100)
    return (
        with_zone.where(F.col("Rows") >= minimum)
        .withColumn("Fault_Density", F.col("Tickets") / F.col("Unique_Sites"))
        .withColumn("SLA_vs_Zone", F.col("SLA_pct") - F.col("Zone_SLA"))
        .select(
            *CITY, "Tickets", "SLA_pct", "Avg_MTTR", "Unique_Sites", "Fault_Density",
            "Avg_NOC_Time", "Avg_Field_Time", "Zone_SLA", "SLA_vs_Zone",
        )
        .orderBy(F.asc("ZONE"), F.desc("Tickets"), F.asc("CITY"))
    )


def city_flags(df: DataFrame, minimum: int = MIN_CITY_TICKETS) -> DataFrame:
    """Where a city stands against its zone on compliance, repair time and density."""
    zones = df.groupBy("ZONE").agg(
        F.avg("OUTAGEDURATION").alias("Zone_MTTR"),
        (F.count("TICKETID") / F.count_distinct("SiteName")).alias("Zone_Density"),
    )
    density, zone_density = F.col("Fault_Density"), F.col("Zone_Density")
    return (
        city_summary(df, minimum)
        .join(zones, "ZONE")
        .select(
            *CITY,
            deviation_flag(F.col("SLA_pct"), F.col("Zone_SLA"), 3).alias("SLA_Status"),
            ratio_flag(F.col("Avg_MTTR"), F.col("Zone_MTTR"), 0.75, 1.25).alias("MTTR_Status"),
            F.when(density > zone_density * 1.25, "high")
            .when(density > zone_density, "raised")
            .otherwise("normal")
            .alias("Density_Status"),
        )
    )


def city_volumes(df: DataFrame, minimum: int = MIN_CITY_TICKETS) -> DataFrame:
    """All cities with their low-volume flag."""
    return df.dropna(subset=CITY).groupBy(*CITY).agg(
        F.count("SLA_Compliant").alias("Tickets"),
        (F.avg("SLA_Compliant") * 100).alias("SLA_pct"),
        F.avg("OUTAGEDURATION").alias("Avg_MTTR"),
        (F.count("SLA_Compliant") < minimum).alias("Low_Vol"),
    )


def degradation_breach(df: DataFrame, minimum: int = 20, city_minimum: int = MIN_CITY_TICKETS) -> DataFrame:
    """Breach rate of the degradation tier per city, with the rate of its zone's large cities."""
    large = _city_measures(df).where((F.col("Rows") >= city_minimum) & (F.col("P32_Tickets") > 0))
    zone = Window.partitionBy("ZONE")
    zone_met = F.sum("_p32_met").over(zone) / F.sum("P32_Tickets").over(zone)
    return (
        large.withColumn("Zone_Breach", (1 - zone_met) * 100)
        .where(F.col("P32_Tickets") >= minimum)
        .select(*CITY, "P32_Tickets", "P32_Breach", "P32_MTTR", "Zone_Breach")
    )


def endorsement_delay(
    df: DataFrame, minimum: int = 30, cap: float = 40, city_minimum: int = MIN_CITY_TICKETS
) -> DataFrame:
    """Mean and median dispatch delay per city on sound tickets; the mean also capped for display."""
    means = (
        _city_measures(df)
        .where((F.col("Rows") >= city_minimum) & (F.col("_delays") >= minimum))
        .select(*CITY, F.col("_delays").alias("Tickets"), "Avg_NOC_Time")
    )
    medians = grouped_quantiles(kpis.sound(df), CITY, "DISPATCH_DELAY_HOURS", {"Med_NOC_Time": 0.5})
    return (
        means.join(medians, CITY)
        .withColumn("Avg_NOC_Time_Capped", F.least(F.col("Avg_NOC_Time"), F.lit(float(cap))))
        .withColumn("CITY", without_prefix(F.col("CITY"), "CITY OF "))
    )


def unknown_rate(df: DataFrame, minimum: int = MIN_CITY_TICKETS) -> DataFrame:
    """Share of tickets whose cause stayed unknown, per city."""
    cities = _city_measures(df).where((F.col("Rows") >= minimum) & (F.col("Tickets") >= minimum))
    return cities.select(
        *CITY, F.col("Tickets").alias("Total_Tickets"), "Unknown_Tickets",
        (F.col("Unknown_Tickets") / F.col("Tickets") * 100).alias("Unknown_Rate"),
    )


def class_split(df: DataFrame, zone: str, business_cities: list[str], minimum: int = MIN_CITY_TICKETS) -> DataFrame:
    """Field time and compliance of business-district cities against the rest of a zone."""
    rows = df.where(F.col("ZONE") == zone)
    large = (
        _city_measures(rows)
        .where(F.col("Rows") >= minimum)
        .withColumn("City_Type", city_class(F.col("CITY"), business_cities))
    )
    means = large.groupBy("City_Type").agg(
        F.sum("_fields").alias("Tickets"),
        (F.sum("_field_hours") / F.sum("_fields")).alias("Avg_Field_Time"),
        (F.sum("_sound_met") / F.sum("_sound_judged") * 100).alias("SLA_pct"),
    )
    # Values are counted per city first; only those counts meet the list of large cities.
    counted = value_table(kpis.sound(rows), CITY, "FIELD_TIME_HOURS").join(large.select(*CITY, "City_Type"), CITY)
    merged = counted.groupBy("City_Type", "_value").agg(F.sum("_n").alias("_n"))
    return means.join(quantiles_of(merged, ["City_Type"], {"Med_Field_Time": 0.5}), "City_Type")


def class_by_city(df: DataFrame, zone: str, business_cities: list[str], minimum: int = MIN_CITY_TICKETS) -> DataFrame:
    large = _city_measures(df.where(F.col("ZONE") == zone)).where(F.col("Rows") >= minimum)
    return large.where(F.col("_sound_rows") > 0).select(
        "CITY", city_class(F.col("CITY"), business_cities).alias("City_Type"),
        F.col("_fields").alias("Tickets"), "Avg_Field_Time", "Avg_NOC_Time",
        (F.col("_sound_met") / F.col("_sound_judged") * 100).alias("SLA_pct"),
    )


def class_verdict(split: DataFrame) -> DataFrame:
    """Difference of the class means and what it means."""
    def mean_of(name: str) -> Column:
        return F.max(F.when(F.col("City_Type") == name, F.col("Avg_Field_Time")))

    return (
        split.agg(mean_of("CBD").alias("CBD"), mean_of("Non-CBD").alias("Non_CBD"))
        .where(F.col("CBD").isNotNull() & F.col("Non_CBD").isNotNull())
        .withColumn("Delta", F.col("CBD") - F.col("Non_CBD"))
        .withColumn("Verdict", delta_verdict(F.col("Delta")))
    )


def city_quadrants(df: DataFrame, minimum: int = MIN_CITY_TICKETS) -> DataFrame:
    """Cities split at the median breach rate and the median fault density."""
    cities = (
        _city_measures(df)
        .where((F.col("Rows") >= minimum) & (F.col("Tickets") >= minimum))
        .select(
            *CITY, "Tickets",
            (100 - F.col("SLA_pct")).alias("Breach_Rate"),
            (F.col("Rows") / F.col("Unique_Sites")).alias("Fault_Density"),
        )
    )
    breach, density = cities.agg(F.median("Breach_Rate")).scalar(), cities.agg(F.median("Fault_Density")).scalar()
    often, dense = F.col("Breach_Rate") > F.col("_breach"), F.col("Fault_Density") > F.col("_density")
    return (
        cities.withColumns({"_breach": breach, "_density": density})
        .withColumn(
            "Quadrant",
            F.when(often & dense, "priority target").when(dense, "recurrence").when(often, "slow service").otherwise("fine"),
        )
        .drop("_breach", "_density")
    )


def city_risk(df: DataFrame, minimum: int = MIN_CITY_TICKETS, tier_minimum: int = 20) -> DataFrame:
    """Weighted risk score over measures rescaled across cities.

    A city without enough degradation tickets has no score and comes last.
    """
    cities = (
        _city_measures(df)
        .where(F.col("Rows") >= minimum)
        .select(
            *CITY, "Tickets",
            (100 - F.col("SLA_pct")).alias("Breach_Rate"),
            F.when(F.col("P32_Tickets") >= tier_minimum, F.col("P32_Breach")).alias("P32_Breach"),
            (F.col("Tickets") / F.col("Unique_Sites")).alias("Fault_Density"),
            (F.col("Unknown_Tickets") / F.col("Tickets") * 100).alias("Unknown_Rate"),
        )
    )
    scaled = cities.withColumns({f"{name}_norm": min_max(F.col(name)) for name in fixed.CITY_RISK_WEIGHTS})
    score = F.lit(0.0)
    for name, weight in fixed.CITY_RISK_WEIGHTS.items():
        score = score + F.col(f"{name}_norm") * weight
    place = F.row_number().over(
        Window.partitionBy().orderBy(F.round("Risk_Score", 9).desc_nulls_last(), F.asc("ZONE"), F.asc("CITY"))
    )
    return scaled.withColumn("Risk_Score", score).withColumn("Rank", place)


def metric_panel(cities: DataFrame, value: str, sort: str, n: int = 15) -> DataFrame:
    """The first n cities per zone by a column, with the value shown."""
    ranked = top_n_per_group(cities, ["ZONE"], [F.desc_nulls_last(sort), F.asc("CITY")], n)
    return ranked.select("ZONE", "CITY", F.col(value).alias("Value"), "Rank")
