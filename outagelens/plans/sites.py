"""Site reports: complexity, risk score, fault concentration, maintenance list."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from outagelens import fixed_values as fixed
from outagelens.functions.rules import lookup, named
from outagelens.functions.service import site_complexity
from outagelens.operators.lookups import cohort_of_top, modal_value, with_cohort_flag
from outagelens.operators.ranking import min_max, pareto, top_n_per_group, value_ranks
from outagelens.operators.shape import compared, share_of_parent
from outagelens.plans import kpis

CAUSE = "Standardized RFO"
MIN_SITE_TICKETS = 10


def site_attributes(df: DataFrame) -> DataFrame:
    """Equipment variety, core presence, complexity and modal place of every site."""
    core = F.coalesce(F.col("NE_Category").isin(fixed.CORE_CATEGORIES), F.lit(False))
    # One pass over the tickets; the three summaries below read this small table.
    cells = (
        df.where(F.col("SiteName").isNotNull())
        .groupBy("SiteName", "ZONE", "CITY", "NEType", core.alias("core"))
        .agg(F.count("*").alias("tickets"))
    )
    variety = cells.groupBy("SiteName").agg(
        F.count_distinct("NEType").alias("NE_Count"), F.bool_or("core").alias("Has_Core_IP")
    )
    classed = variety.withColumn("Complexity", site_complexity(F.col("NE_Count"), F.col("Has_Core_IP")))
    zone = modal_value(cells, ["SiteName"], "ZONE", "ZONE", "tickets")
    city = modal_value(cells, ["SiteName"], "CITY", "CITY", "tickets")
    return classed.join(zone, "SiteName", "left").join(city, "SiteName", "left")


def months_spanned(df: DataFrame, moment: str = "REPORTDATE") -> Column:
    """Whole days between the first and the last moment, in months."""
    micros = F.unix_micros(F.max(moment)) - F.unix_micros(F.min(moment))
    return df.agg(F.floor(micros / F.lit(86_400_000_000)) / F.lit(fixed.DAYS_PER_MONTH)).scalar()


def site_risk(df: DataFrame, minimum: int = MIN_SITE_TICKETS) -> DataFrame:
    """Weighted percentile ranks inside the zone of frequency, repair time and breach, plus complexity.

    Frequency counts all tickets; repair time and breach count dispatched ones.
    """
    out = F.col("Resolution_Path") == "Field_Dispatch_Restored"
    volumes = df.dropna(subset=["ZONE", "SiteName"]).groupBy("ZONE", "SiteName").agg(
        F.count("SLA_Compliant").alias("All_Tickets"),
        F.count(F.when(out, F.col("SLA_Compliant"))).alias("FD_Tickets"),
        (F.avg(F.when(out, F.col("SLA_Compliant"))) * 100).alias("SLA_pct"),
        F.avg(F.when(out, F.col("OUTAGEDURATION"))).alias("Avg_MTTR"),
    )
    attributes = site_attributes(df).select("SiteName", "Complexity", "NE_Count", "Has_Core_IP", "CITY")
    measured = (
        volumes.join(attributes, "SiteName", "left")
        .withColumn("Breach_Rate", 100 - F.col("SLA_pct"))
        .withColumn("Fault_per_Month", F.col("All_Tickets") / months_spanned(df))
        .withColumn("Low_Vol", F.col("All_Tickets") < minimum)
        .withColumn("Complexity_Score", F.expr(lookup(named("Complexity"), fixed.COMPLEXITY_SCORES)))
    )
    ranked = value_ranks(
        measured, ["ZONE"], ["ZONE", "SiteName"],
        {"All_Tickets": "Freq_Rank", "Avg_MTTR": "MTTR_Rank", "Breach_Rate": "Breach_Rank"},
    )
    score = F.lit(0.0)
    for name, weight in fixed.SITE_RISK_WEIGHTS.items():
        score = score + F.col(name) * weight
    return ranked.withColumn("Risk_Score", score)


def top_risk_sites(risk: DataFrame, n: int = 20) -> DataFrame:
    """The n riskiest sites per zone among those with enough tickets."""
    reliable = risk.where(~F.col("Low_Vol"))
    order = [F.round("Risk_Score", 9).desc(), F.asc("SiteName")]
    return top_n_per_group(reliable, ["ZONE"], order, n)


def maintenance_targets(risk: DataFrame, cut_off: float = 80) -> DataFrame:
    """Sites with enough tickets whose score reaches the cut-off."""
    return risk.where(~F.col("Low_Vol") & (F.round("Risk_Score", 9) >= cut_off))


def slowest_sites(risk: DataFrame, zone: str, n: int) -> DataFrame:
    """The n sites of a zone with the longest mean repair time."""
    rows = risk.where(F.col("ZONE") == zone)
    return rows.orderBy(F.desc_nulls_last("Avg_MTTR"), F.asc("SiteName")).limit(n)


def site_drill(df: DataFrame, sites: DataFrame) -> DataFrame:
    """Volume and duration per cause of the given sites, with the range over the whole site."""
    rows = df.join(sites.select("SiteName"), "SiteName", "left_semi")
    per_cause = rows.groupBy("SiteName", CAUSE).agg(
        F.count("*").alias("Tickets"),
        F.avg("OUTAGEDURATION").alias("Avg_MTTR"),
        F.min("OUTAGEDURATION").alias("low"),
        F.max("OUTAGEDURATION").alias("high"),
    )
    spans = per_cause.groupBy("SiteName").agg(
        F.min("low").alias("Site_Min"), F.max("high").alias("Site_Max"), F.sum("Tickets").alias("Site_Tickets")
    )
    return per_cause.drop("low", "high").join(spans, "SiteName")


def complexity_table(df: DataFrame) -> DataFrame:
    """Sites, tickets, compliance, repair time and density per complexity tier."""
    tiers = site_attributes(df).select("SiteName", "Complexity")
    per_site = df.groupBy("SiteName").agg(
        F.count("*").alias("rows"),
        F.count("SLA_Compliant").alias("judged"),
        F.sum("SLA_Compliant").alias("met"),
        F.count("OUTAGEDURATION").alias("timed"),
        F.sum("OUTAGEDURATION").alias("hours"),
    )
    return per_site.join(tiers, "SiteName").groupBy("Complexity").agg(
        F.count("*").alias("Sites"),
        F.sum("judged").alias("Tickets"),
        (F.sum("met") / F.sum("judged") * 100).alias("SLA"),
        (F.sum("hours") / F.sum("timed")).alias("MTTR"),
        (F.sum("rows") / F.count("*")).alias("Density"),
    )


def site_profile(df: DataFrame, zone: str) -> DataFrame:
    """Volume, repair time, compliance and variety per site of a zone."""
    return df.where(F.col("ZONE") == zone).groupBy("SiteName").agg(
        F.count("TICKETID").alias("Total_Tickets"),
        F.avg("OUTAGEDURATION").alias("Avg_MTTR"),
        (F.avg("SLA_Compliant") * 100).alias("SLA_Rate"),
        F.count_distinct(CAUSE).alias("Unique_RFOs"),
        F.count_distinct("NE_Category").alias("Unique_NE"),
    )


def site_pareto(df: DataFrame, zone: str) -> DataFrame:
    """Sites of a zone by volume with the running share of its tickets."""
    return pareto(site_profile(df, zone), [], "SiteName", "Total_Tickets")


def pareto_marks(ranked: DataFrame, marks: tuple[int, ...] = (20, 50, 80)) -> DataFrame:
    """How many sites it takes to reach each share."""
    reached = ranked.agg(
        *[F.min(F.when(F.col("Cumulative_Pct") >= mark, F.col("Rank"))).alias(f"m{mark}") for mark in marks]
    )
    entries = [F.struct(F.lit(mark).alias("threshold"), F.col(f"m{mark}").alias("sites")) for mark in marks]
    return reached.select(F.inline(F.array(*entries)))


def concentration(ranked: DataFrame, tops: tuple[int, ...] = (10, 20)) -> DataFrame:
    """Tickets of the first sites and their share."""
    sums = ranked.agg(
        F.sum("Total_Tickets").alias("total"),
        *[F.sum(F.when(F.col("Rank") <= n, F.col("Total_Tickets"))).alias(f"top{n}") for n in tops],
    )
    entries = [
        F.struct(
            F.lit(n).alias("top"), F.col(f"top{n}").alias("tickets"), (F.col(f"top{n}") / F.col("total") * 100).alias("pct")
        )
        for n in tops
    ]
    return sums.select(F.inline(F.array(*entries)))


def cohort_causes(df: DataFrame, zone: str, n: int = 20, causes: int = 10) -> DataFrame:
    """Cause shares of the n busiest sites against the rest of the zone."""
    rows = df.where(F.col("ZONE") == zone)
    flagged = with_cohort_flag(rows, cohort_of_top(rows, "SiteName", n), "SiteName", "In_Top")
    both = compared(flagged, F.col("In_Top"), {True: "Top_Pct", False: "Rest_Pct"}, CAUSE)
    frequent = rows.groupBy(CAUSE).agg(F.count("*").alias("_n")).orderBy(F.desc("_n"), F.asc(CAUSE)).limit(causes)
    return both.join(frequent.select(CAUSE), CAUSE, "left_semi")


def cohort_categories(df: DataFrame, zone: str, n: int = 20) -> DataFrame:
    """Equipment mix of the n busiest sites."""
    rows = df.where(F.col("ZONE") == zone)
    top = rows.join(cohort_of_top(rows, "SiteName", n).select("SiteName"), "SiteName", "left_semi")
    return share_of_parent(top, ["SiteName"], "NE_Category")


def maintenance_list(df: DataFrame, zone: str, n: int = 20) -> DataFrame:
    """The n busiest sites of a zone by volume, repair time and breach, rescaled among themselves."""
    top = site_profile(df, zone).orderBy(F.desc("Total_Tickets"), F.asc("SiteName")).limit(n)
    scaled = top.withColumns(
        {
            "Score_Volume": min_max(F.col("Total_Tickets")),
            "Score_MTTR": min_max(F.col("Avg_MTTR")),
            "Score_SLA": min_max(100 - F.col("SLA_Rate")),
        }
    )
    score = F.lit(0.0)
    for name, weight in fixed.MAINTENANCE_WEIGHTS.items():
        score = score + F.col(name) * weight
    scored = scaled.withColumn("Risk_Score", F.bround(F.round(score, 9), 1)).withColumn("_all", F.lit(1))
    order = [F.desc("Risk_Score"), F.desc("Total_Tickets"), F.asc("SiteName")]
    return top_n_per_group(scored, ["_all"], order, n, "PM_Priority").select(
        "PM_Priority", "SiteName", "Total_Tickets", "Avg_MTTR", "SLA_Rate", "Risk_Score"
    )
