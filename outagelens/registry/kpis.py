"""Queries over the service KPIs."""

from __future__ import annotations

from pyspark.sql import functions as F

from outagelens import fixed_values as fixed
from outagelens.operators import quality
from outagelens.operators.lookups import with_group_average
from outagelens.operators.shape import canonical_order, mean_of_columns, reindexed, with_percentage
from outagelens.plans import kpis, zones
from outagelens.registry.base_sql import q, r, values
from outagelens.registry.core import query
from outagelens.sources.regions import regions_with_volume
from outagelens.sources.star_tickets import clean_table, table


def zoned(spark, folder):
    return kpis.reactive(clean_table(spark, folder))


@query("mean_repair_time", f"""
SELECT "ZONE", {r('avg("OUTAGEDURATION")')} AS "MTTR" FROM clean GROUP BY "ZONE" """)
def mean_repair_time(spark, folder):
    return kpis.mean_repair_time(clean_table(spark, folder), "ZONE")


@query("mean_repair_time_total", f"""SELECT {r('avg("OUTAGEDURATION")')} AS "MTTR" FROM clean""")
def mean_repair_time_total(spark, folder):
    return kpis.mean_repair_time(clean_table(spark, folder))


@query("sla_compliance", f"""
SELECT "ZONE", {r('avg("SLA_Compliant") * 100')} AS "SLA_Compliance_Rate", count("SLA_Compliant") AS "Ticket_Count"
FROM clean GROUP BY "ZONE" """)
def sla_compliance(spark, folder):
    return kpis.sla_compliance(clean_table(spark, folder), "ZONE")


@query("sla_compliance_total", f"""
SELECT {r('avg("SLA_Compliant") * 100')} AS "SLA_Compliance_Rate", count(*) AS "Ticket_Count" FROM clean""")
def sla_compliance_total(spark, folder):
    return kpis.sla_compliance(clean_table(spark, folder))


@query("fault_density", f"""
SELECT "ZONE", count("TICKETID") AS "Total_Faults", count(DISTINCT "Area") AS "Unique_Sites",
       {r('count("TICKETID") / count(DISTINCT "Area")')} AS "Fault_Density"
FROM clean GROUP BY "ZONE" """)
def fault_density(spark, folder):
    return kpis.fault_density(clean_table(spark, folder), "ZONE")


@query("triage_time", f"""
SELECT "ZONE", {r('avg("DISPATCH_DELAY_HOURS")')} AS "Avg_NOC_Time"
FROM clean WHERE "Timestamp_Integrity" GROUP BY "ZONE" """)
def triage_time(spark, folder):
    return kpis.triage_time(clean_table(spark, folder), "ZONE")


@query("triage_time_from_timestamps", f"""
SELECT "ZONE", {r('avg("DISPATCH_DELAY_HOURS")')} AS "Avg_NOC_Time"
FROM clean WHERE "Timestamp_Integrity" GROUP BY "ZONE" """)
def triage_time_from_timestamps(spark, folder):
    return kpis.triage_time(clean_table(spark, folder).drop("DISPATCH_DELAY_HOURS"), "ZONE")


@query("field_time", f"""
SELECT "ZONE", {r('avg("FIELD_TIME_HOURS")')} AS "Avg_Field_Time"
FROM clean WHERE "Timestamp_Integrity" GROUP BY "ZONE" """)
def field_time(spark, folder):
    return kpis.field_time(clean_table(spark, folder), "ZONE")


@query("field_time_from_timestamps", f"""
SELECT "ZONE", {r('avg("FIELD_TIME_HOURS")')} AS "Avg_Field_Time"
FROM clean WHERE "Timestamp_Integrity" GROUP BY "ZONE" """)
def field_time_from_timestamps(spark, folder):
    return kpis.field_time(clean_table(spark, folder).drop("FIELD_TIME_HOURS"), "ZONE")


SUMMARY = f"""
SELECT "ZONE", count(*) AS "Ticket_Count", {r('avg("OUTAGEDURATION")')} AS "MTTR",
       {r('avg("SLA_Compliant") * 100')} AS "SLA_Compliance_Rate", count("TICKETID") AS "Total_Faults",
       count(DISTINCT "Area") AS "Unique_Sites", {r('count("TICKETID") / count(DISTINCT "Area")')} AS "Fault_Density",
       {r('avg("DISPATCH_DELAY_HOURS") FILTER ("Timestamp_Integrity")')} AS "Avg_NOC_Time",
       {r('avg("FIELD_TIME_HOURS") FILTER ("Timestamp_Integrity")')} AS "Avg_Field_Time"
FROM clean WHERE "ZONE" <> 'Unknown' GROUP BY "ZONE" HAVING bool_or("Timestamp_Integrity")"""


@query("zone_summary", SUMMARY)
def zone_summary(spark, folder):
    return kpis.zone_summary(clean_table(spark, folder))


@query("kpi_tables_joined", f"""
, m AS (SELECT "ZONE", avg("OUTAGEDURATION") AS "MTTR" FROM clean GROUP BY 1),
s AS (SELECT "ZONE", avg("SLA_Compliant") * 100 AS "SLA_Compliance_Rate" FROM clean GROUP BY 1),
n AS (SELECT "ZONE", avg("DISPATCH_DELAY_HOURS") AS "Avg_NOC_Time" FROM clean WHERE "Timestamp_Integrity" GROUP BY 1)
SELECT "ZONE", {r('"MTTR"')} AS "MTTR", {r('"SLA_Compliance_Rate"')} AS "SLA_Compliance_Rate",
       {r('"Avg_NOC_Time"')} AS "Avg_NOC_Time"
FROM m JOIN s USING ("ZONE") JOIN n USING ("ZONE")""")
def kpi_tables_joined(spark, folder):
    tables = kpis.kpi_tables(clean_table(spark, folder))
    return (
        tables["mttr"]
        .join(tables["sla"].drop("Ticket_Count"), "ZONE")
        .join(tables["noc_time"], "ZONE")
    )


@query("executive_summary", f"""
, z AS ({SUMMARY})
SELECT sum("Ticket_Count")::BIGINT AS total_tickets, {r('avg("SLA_Compliance_Rate")')} AS avg_sla,
       {r('avg("MTTR")')} AS avg_mttr, {r('avg("Avg_NOC_Time")')} AS avg_noc,
       {r('avg("Avg_Field_Time")')} AS avg_field, sum("Unique_Sites")::BIGINT AS total_sites,
       {r('avg("Fault_Density")')} AS avg_density,
       strftime((SELECT min("REPORTDATE") FROM clean), '%b %Y') AS first_month,
       strftime((SELECT max("REPORTDATE") FROM clean), '%b %Y') AS last_month
FROM z""")
def executive_summary(spark, folder):
    return kpis.executive_summary(clean_table(spark, folder))


@query("overview", f"""
SELECT count(*) AS tickets, count(DISTINCT "SiteName") AS sites, min("REPORTDATE") AS first_report,
       max("REPORTDATE") AS last_report, {r('avg("OUTAGEDURATION")')} AS mttr,
       {r('avg("SLA_Compliant") * 100')} AS sla_rate,
       {r('avg("DISPATCH_DELAY_HOURS") FILTER ("Timestamp_Integrity")')} AS noc_time,
       {r('avg("FIELD_TIME_HOURS") FILTER ("Timestamp_Integrity")')} AS field_time,
       {", ".join(r(f'''count(*) FILTER ("Resolution_Path" = {q(p)}) / count(*) * 100''') + f' AS "{p}"'
                  for p in fixed.PATH_ORDER)}
FROM clean""")
def overview(spark, folder):
    return kpis.overview(clean_table(spark, folder))


@query("integrity_report", f"""
SELECT "ZONE", count(*) AS "Total", count(*) FILTER (NOT "Timestamp_Integrity") AS "Corrupt",
       {r('count(*) FILTER (NOT "Timestamp_Integrity") / count(*) * 100')} AS "Pct",
       {r('coalesce(avg("DISPATCH_DELAY_HOURS") FILTER (NOT "Timestamp_Integrity"), 0)')} AS "Avg_Dispatch_Corrupt",
       {r('avg("DISPATCH_DELAY_HOURS")')} AS "NOC_All",
       {r('avg("DISPATCH_DELAY_HOURS") FILTER ("Timestamp_Integrity")')} AS "NOC_Sound",
       {r('avg("FIELD_TIME_HOURS")')} AS "Field_All",
       {r('avg("FIELD_TIME_HOURS") FILTER ("Timestamp_Integrity")')} AS "Field_Sound"
FROM clean GROUP BY "ZONE" """)
def integrity_report(spark, folder):
    return kpis.integrity_report(clean_table(spark, folder))


PHASES = f"""
SELECT "ZONE", {r('avg("OUTAGEDURATION")')} AS "MTTR", {r('avg("DISPATCH_DELAY_HOURS")')} AS "Avg_NOC_Time",
       {r('avg("FIELD_TIME_HOURS")')} AS "Avg_Field_Time",
       round_even(avg("DISPATCH_DELAY_HOURS") / avg("OUTAGEDURATION") * 100, 1) AS "NOC_Share",
       round_even(avg("FIELD_TIME_HOURS") / avg("OUTAGEDURATION") * 100, 1) AS "Field_Share"
FROM zoned WHERE "Timestamp_Integrity" GROUP BY "ZONE" """


@query("phase_shares", PHASES)
def phase_shares(spark, folder):
    return kpis.phase_shares(zoned(spark, folder))


@query("phase_extremes", f"""
, p AS ({PHASES})
(SELECT 'largest triage share' AS metric, "ZONE" AS zone, "NOC_Share" AS value FROM p
 ORDER BY "NOC_Share" DESC, "ZONE" DESC LIMIT 1)
UNION ALL
(SELECT 'largest field share', "ZONE", "Field_Share" FROM p ORDER BY "Field_Share" DESC, "ZONE" DESC LIMIT 1)""")
def phase_extremes(spark, folder):
    return zones.phase_extremes(zoned(spark, folder))


@query("zone_priority_table", f"""
SELECT "ZONE", "Priority", count(*) AS "Tickets", {r('avg("SLA_Compliant") * 100')} AS "SLA_Rate",
       {r('avg("OUTAGEDURATION")')} AS "Avg_MTTR", count(*) FILTER ("SLA_Compliant" = 0) AS "Breach_Count",
       CASE "Priority" WHEN 1 THEN {q(fixed.PRIORITY_LABELS[1])} WHEN 2 THEN {q(fixed.PRIORITY_LABELS[2])}
            WHEN 3 THEN {q(fixed.PRIORITY_LABELS[3])} END AS "Priority_Label",
       CASE "Priority" WHEN 1 THEN 3 WHEN 2 THEN 6 WHEN 3 THEN 9 END AS "SLA_Target_U1"
FROM zoned GROUP BY "ZONE", "Priority" HAVING count(*) >= 20""")
def zone_priority_table(spark, folder):
    return kpis.zone_priority_table(zoned(spark, folder))


TIERS = f"""
, tiers AS (
  SELECT 'P' || "Priority_Urgency" AS "Tier", "ZONE", "SLA_Compliant" FROM clean
  WHERE "ZONE" <> 'Unknown' AND 'P' || "Priority_Urgency" IN ({values(fixed.TIER_ORDER)}))"""


@query("tier_matrix", f"""{TIERS}
SELECT "Tier", "ZONE", count("SLA_Compliant") AS "Tickets", {r('avg("SLA_Compliant")')} AS "SLA_Rate"
FROM tiers GROUP BY GROUPING SETS (("Tier", "ZONE"), ("Tier"))""")
def tier_matrix(spark, folder):
    return kpis.tier_matrix(clean_table(spark, folder))


@query("tier_summary", f"""{TIERS}
, cells AS (SELECT "Tier", "ZONE", avg("SLA_Compliant") AS rate FROM tiers GROUP BY ALL),
worst AS (SELECT * FROM cells QUALIFY row_number() OVER (PARTITION BY "Tier" ORDER BY rate, "ZONE") = 1)
SELECT "Tier", CASE WHEN "Tier" LIKE 'P1%' THEN 3 WHEN "Tier" LIKE 'P2%' THEN 6 WHEN "Tier" = 'P3.1' THEN 9
       WHEN "Tier" = 'P3.2' THEN 12 WHEN "Tier" = 'P3.3' THEN 24 END AS "SLA_Budget",
       count("SLA_Compliant") AS "Total_Tickets", {r('avg("SLA_Compliant")')} AS "Total_SLA",
       any_value(worst."ZONE") AS "Worst_Zone", {r('any_value(worst.rate)')} AS "Worst_SLA"
FROM tiers JOIN worst USING ("Tier") GROUP BY "Tier" """)
def tier_summary(spark, folder):
    return zones.tier_summary(clean_table(spark, folder))


@query("masked_zones", f"""{TIERS}
, cells AS (SELECT "Tier", "ZONE", avg("SLA_Compliant") AS rate FROM tiers GROUP BY ALL),
top AS (SELECT "ZONE", avg(rate) AS top_rate FROM cells WHERE "Tier" LIKE 'P1%' GROUP BY 1),
total AS (SELECT "ZONE", avg("SLA_Compliant") AS rate FROM clean WHERE "ZONE" <> 'Unknown' GROUP BY 1)
SELECT "ZONE", {r('rate')} AS "Overall_SLA", {r('top_rate')} AS "Top_Tier_SLA"
FROM total JOIN top USING ("ZONE") WHERE rate >= 0.2 AND top_rate < 0.061""")
def masked_zones(spark, folder):
    return zones.masked_zones(clean_table(spark, folder), overall_floor=0.2, top_floor=0.061)


@query("tier_breach", f"""
SELECT "ZONE", "Priority_Urgency", count("SLA_Compliant") AS "Tickets",
       {r('(1 - avg("SLA_Compliant")) * 100')} AS "Breach_Rate"
FROM zoned GROUP BY 1, 2 HAVING count("SLA_Compliant") >= 50""")
def tier_breach(spark, folder):
    return zones.tier_breach(zoned(spark, folder))


@query("tier_breach_by_zone", f"""
, order_of AS (SELECT unnest([{values(fixed.ZONE_ORDER)}]) AS "ZONE", unnest(range(1, 7))::INT AS ord)
SELECT "ZONE", ord, count("SLA_Compliant") AS "Tickets",
       {r('coalesce(1 - avg("SLA_Compliant"), 0)')} AS "Breach"
FROM order_of LEFT JOIN (SELECT * FROM zoned WHERE "Priority_Urgency" = '3.2') USING ("ZONE") GROUP BY 1, 2""")
def tier_breach_by_zone(spark, folder):
    return zones.tier_breach_by_zone(zoned(spark, folder))


@query("below_average_cells", f"""
, cells AS (SELECT "ZONE", "Priority", avg("SLA_Compliant") * 100 AS sla FROM zoned GROUP BY 1, 2),
total AS (SELECT avg("SLA_Compliant") * 100 AS overall FROM zoned)
SELECT "ZONE", "Priority", {r('sla')} AS "SLA", {r('overall')} AS "Overall", {r('overall - sla')} AS "Gap"
FROM cells, total WHERE sla < overall""")
def below_average_cells(spark, folder):
    return zones.below_average_cells(zoned(spark, folder))


@query("priority_mix", f"""
SELECT "ZONE", {", ".join(r(f'count(*) FILTER ("Priority" = {p}) / count(*) * 100') + f' AS "P{p}"' for p in (1, 2, 3))}
FROM zoned GROUP BY "ZONE" """)
def priority_mix(spark, folder):
    return zones.priority_mix(zoned(spark, folder))


MIX = """
, cells AS (
  SELECT "ZONE", "Priority", count(*) AS tickets, avg("OUTAGEDURATION") AS repair,
         avg("FIELD_TIME_HOURS") FILTER ("Resolution_Path" = 'Field_Dispatch_Restored' AND "Timestamp_Integrity") AS field
  FROM zoned GROUP BY 1, 2),
shares AS (SELECT *, tickets / sum(tickets) OVER (PARTITION BY "ZONE") AS share FROM cells),
weights AS (SELECT "Priority", sum(share) / (SELECT count(DISTINCT "ZONE") FROM cells) AS weight FROM shares GROUP BY 1),
adjusted AS (
  SELECT "ZONE", sum(coalesce(repair * weight, 0)) AS adj_mttr, sum(coalesce(field * weight, 0)) AS adj_field
  FROM cells JOIN weights USING ("Priority") GROUP BY 1)"""


@query("mix_adjusted", f"""{MIX}
SELECT "ZONE", {r('raw_mttr')} AS "Raw_MTTR", {r('adj_mttr')} AS "Adjusted_MTTR", {r('adj_field')} AS "Adjusted_Field"
FROM adjusted JOIN (SELECT "ZONE", avg("OUTAGEDURATION") AS raw_mttr FROM zoned GROUP BY 1) USING ("ZONE")""")
def mix_adjusted(spark, folder):
    return zones.mix_adjusted(zoned(spark, folder))


def scaled(name: str, invert: bool = False) -> str:
    text = f"({name} - min({name}) OVER ()) / (max({name}) OVER () - min({name}) OVER () + 1e-9) * 100"
    return f"(100 - {text})" if invert else f"({text})"


SCORECARD = f"""{MIX}
, base AS (
  SELECT "ZONE", avg("SLA_Compliant") * 100 AS sla, avg("SLA_Compliant") FILTER ("Priority" IN (1, 2)) * 100 AS high,
         count("TICKETID") / count(DISTINCT "Area") AS density
  FROM zoned GROUP BY 1),
scores AS (
  SELECT "ZONE", {scaled('sla')} AS a, {scaled('high')} AS b, {scaled('adj_field', True)} AS c,
         {scaled('density', True)} AS d, {scaled('adj_mttr', True)} AS e
  FROM base JOIN adjusted USING ("ZONE")),
shown AS (
  SELECT "ZONE", round_even(a, 1) AS "SLA_Score", round_even(b, 1) AS "HighPrio_Score",
         round_even(c, 1) AS "Field_Score", round_even(d, 1) AS "Density_Score", round_even(e, 1) AS "MTTR_Score",
         round_even(a * 0.30::DOUBLE + b * 0.25::DOUBLE + c * 0.20::DOUBLE + d * 0.15::DOUBLE + e * 0.10::DOUBLE, 1)
           AS "Composite"
  FROM scores)"""


@query("zone_scorecard", f"""{SCORECARD}
SELECT *, CAST(floor(rank() OVER (ORDER BY "Composite" DESC)
          + (count(*) OVER (PARTITION BY "Composite") - 1) / 2.0) AS INT) AS "Rank"
FROM shown""")
def zone_scorecard(spark, folder):
    return zones.scorecard(zoned(spark, folder))


@query("zone_composite_rank", f"""
, z AS ({SUMMARY}),
ranks AS (
  SELECT "ZONE", rank() OVER (ORDER BY "SLA_Compliance_Rate" DESC)::INT AS "R_SLA",
         rank() OVER (ORDER BY "MTTR")::INT AS "R_MTTR", rank() OVER (ORDER BY "Avg_NOC_Time")::INT AS "R_NOC",
         rank() OVER (ORDER BY "Avg_Field_Time")::INT AS "R_Field",
         rank() OVER (ORDER BY "Fault_Density")::INT AS "R_Density", count(*) OVER () AS n
  FROM z),
mean AS (SELECT *, ("R_SLA" + "R_MTTR" + "R_NOC" + "R_Field" + "R_Density") / 5.0::DOUBLE AS mean FROM ranks)
SELECT "ZONE", "R_SLA", "R_MTTR", "R_NOC", "R_Field", "R_Density", {r('mean')} AS "Composite",
       CASE WHEN mean / n <= 0.25 THEN 'Excellent' WHEN mean / n <= 0.5 THEN 'Good'
            WHEN mean / n <= 0.75 THEN 'Needs Attention' ELSE 'Critical' END AS "Rating"
FROM mean""")
def zone_composite_rank(spark, folder):
    return zones.composite_rank(clean_table(spark, folder))


@query("zone_kpi_rankings", f"""
, z AS ({SUMMARY}),
long AS (
  SELECT "ZONE", 'MTTR' AS "KPI", "MTTR" AS "Value", "MTTR" AS signed FROM z
  UNION ALL SELECT "ZONE", 'SLA_Compliance_Rate', "SLA_Compliance_Rate", -"SLA_Compliance_Rate" FROM z
  UNION ALL SELECT "ZONE", 'Avg_NOC_Time', "Avg_NOC_Time", "Avg_NOC_Time" FROM z
  UNION ALL SELECT "ZONE", 'Avg_Field_Time', "Avg_Field_Time", "Avg_Field_Time" FROM z
  UNION ALL SELECT "ZONE", 'Fault_Density', "Fault_Density", "Fault_Density" FROM z)
SELECT "ZONE", "KPI", "Value", row_number() OVER (PARTITION BY "KPI" ORDER BY signed, "ZONE")::INT AS "Rank"
FROM long""")
def zone_kpi_rankings(spark, folder):
    return zones.kpi_rankings(clean_table(spark, folder))


@query("zone_targets", f"""
, z AS ({SUMMARY}),
t AS (SELECT * FROM (VALUES ('ZONE 1', 2, 0.88, 0.85, 'Low'), ('ZONE 2', 2, 0.88, 0.86, 'Moderate'),
      ('ZONE 3', 2, 0.87, NULL, 'Low'), ('ZONE 4', 2, 0.89, NULL, 'High'), ('ZONE 5', 3, 0.73, NULL, 'High'),
      ('ZONE 6', 3, 0.82, NULL, 'Moderate')) AS v("ZONE", margin, repair, field, exposure)),
exact AS (
  SELECT "ZONE", avg("SLA_Compliant") * 100 AS sla, avg("OUTAGEDURATION") AS mttr,
         avg("FIELD_TIME_HOURS") FILTER ("Timestamp_Integrity") AS field_now FROM clean GROUP BY 1)
SELECT "ZONE", exposure AS "Exposure", {r('sla')} AS "SLA_Now", {r('sla + margin')} AS "SLA_Target",
       {r('exact.mttr')} AS "MTTR_Now", {r('exact.mttr * repair')} AS "MTTR_Target",
       {r('field_now')} AS "Field_Now", {r('field_now * field')} AS "Field_Target"
FROM z JOIN t USING ("ZONE") JOIN exact USING ("ZONE")""")
def zone_targets(spark, folder):
    return zones.targets(clean_table(spark, folder))


@query("zone_shares", f"""
, order_of AS (SELECT unnest([{values(fixed.ZONE_ORDER)}]) AS "ZONE", unnest(range(1, 7))::INT AS ord),
counted AS (SELECT "ZONE", count(*) AS n FROM zoned GROUP BY 1)
SELECT "ZONE", ord, coalesce(n, 0) AS "Tickets",
       {r('coalesce(n, 0) / (SELECT sum(n) FROM counted) * 100')} AS "Share"
FROM order_of LEFT JOIN counted USING ("ZONE")""")
def zone_shares(spark, folder):
    return zones.zone_shares(zoned(spark, folder))


@query("region_aggregates", f"""
SELECT "Region", CAST(right("Region", 1) AS INT) AS ord, {r('median("OUTAGEDURATION")')} AS "OUTAGEDURATION_median"
FROM clean GROUP BY "Region" """)
def region_aggregates(spark, folder):
    return kpis.aggregate_by_region(clean_table(spark, folder), "OUTAGEDURATION", "median")


@query("region_aggregates_titled", f"""
SELECT "Region", CAST(right("Region", 1) AS INT) AS ord, {r('avg("OUTAGEDURATION")')} AS "Outageduration (Mean)"
FROM clean GROUP BY "Region" """)
def region_aggregates_titled(spark, folder):
    return kpis.aggregate_by_region(clean_table(spark, folder), "OUTAGEDURATION", "mean", titled=True)


@query("outlier_groups", f"""
, means AS (SELECT "CITY", avg("OUTAGEDURATION") AS v FROM zoned GROUP BY 1),
bounds AS (SELECT quantile_cont(v, 0.25) AS lo, quantile_cont(v, 0.75) AS hi FROM means)
SELECT "CITY", {r('v')} AS "OUTAGEDURATION",
       CASE WHEN v < lo - 0.5 * (hi - lo) THEN 'Low' ELSE 'High' END AS "Outlier_Type"
FROM means, bounds WHERE v < lo - 0.5 * (hi - lo) OR v > hi + 0.5 * (hi - lo)""")
def outlier_groups(spark, folder):
    return kpis.outlier_groups(zoned(spark, folder), "OUTAGEDURATION", "CITY", threshold=0.5)


@query("canonical_zone_order", f"""
SELECT CASE WHEN "ZONE" = 'Unknown' THEN NULL ELSE "ZONE" END AS "ZONE",
       CASE WHEN "ZONE" = 'Unknown' THEN 0 ELSE CAST(right("ZONE", 1) AS INT) END AS ord, count(*) AS tickets
FROM clean GROUP BY "ZONE" """)
def canonical_zone_order(spark, folder):
    counted = clean_table(spark, folder).groupBy("ZONE").agg(F.count("*").alias("tickets"))
    return canonical_order(counted, "ZONE", fixed.ZONE_ORDER).fillna(0, ["ord"])


@query("reindexed_zones", f"""
, order_of AS (SELECT unnest([{values(fixed.ZONE_ORDER)}]) AS "ZONE", unnest(range(1, 7))::INT AS ord)
SELECT "ZONE", ord, {r('avg("OUTAGEDURATION")')} AS mttr FROM order_of LEFT JOIN zoned USING ("ZONE") GROUP BY 1, 2""")
def reindexed_zones(spark, folder):
    means = zoned(spark, folder).groupBy("ZONE").agg(F.avg("OUTAGEDURATION").alias("mttr"))
    return reindexed(means, "ZONE", fixed.ZONE_ORDER)


@query("percentage_column", """
, counted AS (SELECT "ZONE", count(*) AS tickets FROM clean GROUP BY 1)
SELECT *, round_even(tickets / (SELECT sum(tickets) FROM counted) * 100, 1) AS "Percentage" FROM counted""")
def percentage_column(spark, folder):
    counted = clean_table(spark, folder).groupBy("ZONE").agg(F.count("*").alias("tickets"))
    return with_percentage(counted, "tickets")


@query("row_mean", f"""
SELECT "ZONE", {r('''(coalesce(avg("SLA_Compliant") FILTER ("Priority_Urgency" = '1.1'), 0)
    + coalesce(avg("SLA_Compliant") FILTER ("Priority_Urgency" = '2.0'), 0)
    + coalesce(avg("SLA_Compliant") FILTER ("Priority_Urgency" = '9.9'), 0))
  / ((count(*) FILTER ("Priority_Urgency" = '1.1') > 0)::INT + (count(*) FILTER ("Priority_Urgency" = '2.0') > 0)::INT)''')}
  AS mean_rate
FROM zoned GROUP BY "ZONE" """)
def row_mean(spark, folder):
    rates = zoned(spark, folder).groupBy("ZONE").agg(
        *[
            F.avg(F.when(F.col("Priority_Urgency") == tier, F.col("SLA_Compliant"))).alias(f"t{i}")
            for i, tier in enumerate(("1.1", "2.0", "9.9"))
        ]
    )
    return rates.select("ZONE", mean_of_columns([F.col(f"t{i}") for i in range(3)]).alias("mean_rate"))


@query("group_average", f"""
SELECT "TICKETID", {r('avg("OUTAGEDURATION") OVER (PARTITION BY "ZONE")')} AS zone_mttr FROM zoned""")
def group_average(spark, folder):
    rows = zoned(spark, folder).select("TICKETID", "ZONE", "OUTAGEDURATION")
    return with_group_average(rows, ["ZONE"], "OUTAGEDURATION", "zone_mttr").select("TICKETID", "zone_mttr")


@query("target_reconciliation", f"""
, z AS ({SUMMARY}),
want AS (SELECT * FROM (VALUES ('ZONE 1', 30.0, 25.0), ('ZONE 2', 25.0, 25.0), ('ZONE 6', 80.0, 70.0))
         AS v("ZONE", sla, mttr))
SELECT "ZONE", 'SLA_Compliance_Rate' AS metric, "SLA_Compliance_Rate" AS actual, sla::DOUBLE AS expected,
       coalesce(abs("SLA_Compliance_Rate" - sla) <= 5, false) AS "within" FROM want LEFT JOIN z USING ("ZONE")
UNION ALL
SELECT "ZONE", 'MTTR', z."MTTR", want.mttr::DOUBLE, coalesce(abs(z."MTTR" - want.mttr) <= 15, false)
FROM want LEFT JOIN z USING ("ZONE")""")
def target_reconciliation(spark, folder):
    expected = spark.sql(
        "SELECT * FROM VALUES ('ZONE 1', 30D, 25D), ('ZONE 2', 25D, 25D), ('ZONE 6', 80D, 70D) "
        "AS v(ZONE, SLA_Compliance_Rate, MTTR)"
    )
    summary = kpis.zone_summary(clean_table(spark, folder))
    return quality.reconciled(summary, expected, "ZONE", {"SLA_Compliance_Rate": 5, "MTTR": 15})


@query("region_volumes", f"""
, areas AS (
  SELECT n_nationkey, CASE n_nationkey WHEN 1 THEN 1 WHEN 2 THEN 2 WHEN 3 THEN 3 WHEN 4 THEN 4 WHEN 5 THEN 5
         WHEN 6 THEN 6 WHEN 7 THEN 7 WHEN 8 THEN 8 WHEN 9 THEN 9 WHEN 10 THEN 10 WHEN 11 THEN 11 WHEN 12 THEN 12
         WHEN 13 THEN 13 WHEN 14 THEN 14 WHEN 16 THEN 15 WHEN 17 THEN 16 WHEN 19 THEN 17
         ELSE n_regionkey END AS number FROM nation),
named AS (
  SELECT CASE WHEN number IN (1, 2, 14, 3) THEN 'Region 1' WHEN number IN (4, 5, 16) THEN 'Region 2'
         WHEN number = 13 THEN 'Region 3' WHEN number IN (6, 7, 8) THEN 'Region 4'
         WHEN number IN (9, 10, 11, 12, 15, 17) THEN 'Region 5' END AS region FROM areas),
volume AS (SELECT "Region" AS region, count(*) AS n FROM clean GROUP BY 1)
SELECT region AS "Region Name", count(*) AS "Areas", coalesce(any_value(n), 0) AS "Ticket Volume"
FROM named LEFT JOIN volume USING (region) WHERE region IS NOT NULL GROUP BY region""")
def region_volumes(spark, folder):
    areas = table(spark, folder, "nation").selectExpr(
        "concat(n_nationkey, '00000000') AS adm1_psgc", "n_regionkey AS file_number"
    )
    return regions_with_volume(areas, clean_table(spark, folder))
