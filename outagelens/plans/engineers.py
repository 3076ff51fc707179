"""Field engineers and operator accounts: load, equality, quality."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from outagelens import fixed_values as fixed
from outagelens.operators.lookups import modal_value, rows_of_large_groups
from outagelens.operators.ranking import gini, load_bands, lorenz
from outagelens.plans import kpis

CAUSE = "Standardized RFO"
MIN_LEAD_TICKETS = 100
LEAD = ["ZONE", "Field_Lead_ID"]


def attributed(df: DataFrame) -> DataFrame:
    """Dispatched tickets with a known field lead."""
    return kpis.dispatched(df).where(F.col("Field_Lead_ID") != "Unknown")


def home_zones(df: DataFrame) -> DataFrame:
    """The zone each lead works in most; the first zone among equals."""
    return modal_value(df, ["Field_Lead_ID"], "ZONE", "Home_Zone")


def own_team(df: DataFrame, group: str) -> DataFrame:
    rows = attributed(df)
    return rows.where(F.col("WOOwnerGroup") == group) if "WOOwnerGroup" in df.columns else rows


def active_pool(df: DataFrame, minimum: int = MIN_LEAD_TICKETS, group: str = "Field Operations") -> DataFrame:
    """Tickets of the own team, in the lead's home zone, of leads with enough tickets there."""
    own = own_team(df, group)
    aligned = own.join(home_zones(own), "Field_Lead_ID", "left").where(F.col("ZONE") == F.col("Home_Zone"))
    return rows_of_large_groups(aligned, LEAD, minimum)


def lead_stats(df: DataFrame, minimum: int = MIN_LEAD_TICKETS, group: str = "Field Operations") -> DataFrame:
    """Load and performance per lead of the active pool.

    The pool is chosen on the aggregated table, so the tickets are read once and
    never joined.
    """
    per_zone = own_team(df, group).dropna(subset=LEAD).groupBy(*LEAD).agg(
        F.count("*").alias("_rows"),
        F.count("SLA_Compliant").alias("Tickets"),
        (F.avg("SLA_Compliant") * 100).alias("SLA_pct"),
        F.avg("OUTAGEDURATION").alias("Avg_MTTR"),
        F.count_distinct("SiteName").alias("Unique_Sites"),
    )
    home = F.row_number().over(Window.partitionBy("Field_Lead_ID").orderBy(F.desc("_rows"), F.asc("ZONE")))
    return (
        per_zone.withColumn("_home", home)
        .where((F.col("_home") == 1) & (F.col("_rows") >= minimum))
        .drop("_home", "_rows")
    )


def load_table(stats: DataFrame) -> DataFrame:
    """Engineers, median and largest load, equality and coverage per zone."""
    spread = stats.groupBy("ZONE").agg(
        F.count("*").alias("Engineers"),
        F.median("Tickets").alias("Median_Tickets"),
        F.max("Tickets").alias("Max_Tickets"),
        F.median("Unique_Sites").alias("Median_Sites"),
        F.avg("SLA_pct").alias("Avg_SLA"),
    )
    return spread.join(gini(stats, ["ZONE"], "Tickets"), "ZONE")


def coverage_table(stats: DataFrame) -> DataFrame:
    """Sites per engineer: median, largest, 90 % point, and mean tickets per site."""
    return stats.groupBy("ZONE").agg(
        F.count("*").alias("Engineers"),
        F.median("Unique_Sites").alias("Median_Sites"),
        F.max("Unique_Sites").alias("Max_Sites"),
        F.percentile("Unique_Sites", 0.9).alias("P90_Sites"),
        F.avg(F.col("Tickets") / F.col("Unique_Sites")).alias("Avg_Tickets_per_Site"),
    )


def band_performance(stats: DataFrame) -> DataFrame:
    """Performance of the load bands over all zones."""
    return (
        load_bands(stats, ["ZONE"], "Tickets")
        .groupBy("Load_Group")
        .agg(
            F.count("*").alias("Engineers"),
            F.median("Tickets").alias("Median_Tickets"),
            F.avg("SLA_pct").alias("Avg_SLA"),
            F.avg("Avg_MTTR").alias("Avg_MTTR"),
            F.avg("Unique_Sites").alias("Avg_Sites"),
        )
    )


def lorenz_points(stats: DataFrame) -> DataFrame:
    return lorenz(stats, ["ZONE"], "Field_Lead_ID", "Tickets")


def outside_groups(df: DataFrame, group: str = "Field Operations") -> DataFrame:
    """Dispatched tickets of other teams, per team."""
    return (
        attributed(df)
        .where(F.col("WOOwnerGroup") != group)
        .groupBy("WOOwnerGroup")
        .agg(
            F.count("SLA_Compliant").alias("Tickets"),
            (F.avg("SLA_Compliant") * 100).alias("SLA_pct"),
            F.avg("OUTAGEDURATION").alias("Avg_MTTR"),
        )
    )


def outside_by_zone(df: DataFrame, group: str = "Field Operations") -> DataFrame:
    """Own-team and other-team tickets per zone with the other teams' share."""
    own = F.col("WOOwnerGroup") == group
    return attributed(df).groupBy("ZONE").agg(
        F.count_if(own).alias("Own_Team"),
        F.count_if(~own).alias("Other_Teams"),
        (F.count_if(~own) / F.count("*") * 100).alias("Other_Pct"),
    )


def account_stats(df: DataFrame, shared_account: str) -> DataFrame:
    """Load, compliance, unresolved share, zones and modal team per operator account.

    Rows are counted once per account, zone and team; all else reads those counts.
    """
    counts = df.where(F.col("Engineer_ID") != "Unknown").groupBy("Engineer_ID", "ZONE", "Issuer_Team").agg(
        F.count("*").alias("_rows"),
        F.count("SLA_Compliant").alias("_judged"),
        F.sum("SLA_Compliant").alias("_met"),
        F.count_if(F.col(CAUSE) == fixed.UNKNOWN_CAUSE).alias("_unresolved"),
    )
    stats = counts.groupBy("Engineer_ID").agg(
        F.sum("_judged").alias("Tickets"),
        (F.try_divide(F.sum("_met"), F.sum("_judged")) * 100).alias("SLA_pct"),
        (F.sum("_unresolved") / F.sum("_rows") * 100).alias("Unknown_pct"),
        F.array_join(F.sort_array(F.collect_set("ZONE")), ", ").alias("Zones"),
    )
    modal = modal_value(counts, ["Engineer_ID"], "Issuer_Team", "Team", weight="_rows")
    return stats.join(modal, "Engineer_ID").withColumn(
        "Is_Shared", F.col("Engineer_ID") == shared_account
    )


def account_kinds(df: DataFrame, shared_account: str) -> DataFrame:
    """Unresolved share of all tickets, of individual accounts and of the shared account."""
    unresolved = (F.col(CAUSE) == fixed.UNKNOWN_CAUSE).cast("int")
    shared = F.col("Engineer_ID") == shared_account
    individual = (F.col("Engineer_ID") != "Unknown") & ~shared
    return df.agg(
        (F.avg(unresolved) * 100).alias("All_Tickets"),
        (F.avg(F.when(individual, unresolved)) * 100).alias("Individual"),
        (F.avg(F.when(shared, unresolved)) * 100).alias("Shared"),
        F.count_if(shared).alias("Shared_Tickets"),
        F.count_if(individual).alias("Individual_Tickets"),
    )


def city_accounts(df: DataFrame, city: str) -> DataFrame:
    """Tickets and unresolved tickets per team in one city."""
    return df.where(F.col("CITY") == city).groupBy("Issuer_Team").agg(
        F.count("*").alias("Tickets"), F.count_if(F.col(CAUSE) == fixed.UNKNOWN_CAUSE).alias("Unknown")
    )
