"""Queries over paths, causes, cities, sites and engineers."""

from __future__ import annotations

from pyspark.sql import functions as F

from outagelens import fixed_values as fixed
from outagelens.operators.ranking import above_group_median, gini, load_bands
from outagelens.plans import cities, engineers, kpis, paths, sites, zones
from outagelens.registry.base_sql import q, r, values
from outagelens.registry.core import query
from outagelens.sources.star_tickets import clean_table

ZONE_ORDER_CTE = f"""
, order_of AS (SELECT unnest([{values(fixed.ZONE_ORDER)}]) AS "ZONE", unnest(range(1, 7))::INT AS ord)"""
FIELD = """ "Resolution_Path" = 'Field_Dispatch_Restored' """
CITY_MIN = 20
BUSINESS = ["NATION_4", "NATION_8", "NATION_18", "CITY OF NATION_9", "CITY OF NATION_24"]


def zoned(spark, folder):
    return kpis.reactive(clean_table(spark, folder))


# --- paths and causes ------------------------------------------------------------------

_PATHS = {"Auto": "Auto_Self_Restored", "NOC": "NOC_Remote_Restored", "Field": "Field_Dispatch_Restored"}


@query("path_table", f"""{ZONE_ORDER_CTE}
, counted AS (
  SELECT "ZONE", count(*) AS n,
         {", ".join(f'''count(*) FILTER ("Resolution_Path" = {q(p)}) / count(*) * 100 AS {s}_pct,
         coalesce(avg("OUTAGEDURATION") FILTER ("Resolution_Path" = {q(p)}), 0) AS {s}_mttr,
         coalesce(avg("SLA_Compliant") FILTER ("Resolution_Path" = {q(p)}), 0) * 100 AS {s}_sla'''
         for s, p in _PATHS.items())}
  FROM zoned GROUP BY "ZONE")
SELECT "ZONE", ord, n AS "Total_Tickets", {", ".join(
    f'''{r(f"{s}_pct")} AS "{s}_Pct", {r(f"{s}_mttr")} AS "{s}_MTTR", {r(f"{s}_sla")} AS "{s}_SLA" ''' for s in _PATHS)}
FROM order_of JOIN counted USING ("ZONE")""")
def path_table(spark, folder):
    return paths.path_table(zoned(spark, folder)).where(F.col("Total_Tickets").isNotNull())


@query("path_split", f"""
, order_of AS (SELECT unnest([{values(fixed.PATH_ORDER)}]) AS "Resolution_Path", unnest(range(1, 4))::INT AS ord),
counted AS (SELECT "Resolution_Path", count(*) AS n FROM clean GROUP BY 1)
SELECT "Resolution_Path", ord, n AS "Tickets", {r('n / (SELECT count(*) FROM clean) * 100')} AS "Pct"
FROM order_of JOIN counted USING ("Resolution_Path")""")
def path_split(spark, folder):
    return paths.path_split(clean_table(spark, folder))


@query("field_time_distribution", f"""
SELECT "ZONE", {r('avg("FIELD_TIME_HOURS")')} AS "Mean", {r('stddev_samp("FIELD_TIME_HOURS")')} AS "Std",
       {r('median("FIELD_TIME_HOURS")')} AS "Median", {r('quantile_cont("FIELD_TIME_HOURS", 0.75)')} AS "P75"
FROM zoned WHERE {FIELD} AND "Timestamp_Integrity" GROUP BY "ZONE" """)
def field_time_distribution(spark, folder):
    return paths.field_time_distribution(zoned(spark, folder), ["ZONE"])


def _cause_sql(where: str, hours: str, mean: str, by: str, minimum: int) -> str:
    return f"""
SELECT "{by}", {r(f'avg("{hours}")')} AS "{mean}", count("{hours}") AS "Ticket_Count",
       {r('avg("SLA_Compliant") * 100')} AS "SLA_Rate"
FROM zoned WHERE {where} GROUP BY "{by}" HAVING count("{hours}") >= {minimum}"""


@query("cause_field_time", _cause_sql(
    FIELD + 'AND "Timestamp_Integrity"', "FIELD_TIME_HOURS", "Avg_Field_Time", "Standardized RFO", 30))
def cause_field_time(spark, folder):
    return paths.cause_field_time(zoned(spark, folder))


@query("cause_triage_time", _cause_sql(
    '"Timestamp_Integrity"', "DISPATCH_DELAY_HOURS", "Avg_NOC_Time", "Standardized RFO", 30))
def cause_triage_time(spark, folder):
    return paths.cause_triage_time(zoned(spark, folder))


@query("category_field_time", _cause_sql(
    FIELD + 'AND "Timestamp_Integrity"', "FIELD_TIME_HOURS", "Avg_Field_Time", "NE_Category", 0))
def category_field_time(spark, folder):
    return paths.category_field_time(zoned(spark, folder))


def _zone_columns(key: str) -> str:
    return ", ".join(
        r(f'coalesce(max(pct) FILTER ("ZONE" = {q(z)}), 0)') + f' AS "{z}"' for z in fixed.ZONE_ORDER
    )


@query("cause_by_zone", f"""
, counted AS (SELECT "ZONE", "Standardized RFO", count(*) AS n FROM zoned GROUP BY 1, 2),
shares AS (SELECT *, n / sum(n) OVER (PARTITION BY "ZONE") * 100 AS pct FROM counted)
SELECT "Standardized RFO", sum(n)::BIGINT AS "Total", {_zone_columns('Standardized RFO')}
FROM shares GROUP BY 1 ORDER BY sum(n) DESC, 1 LIMIT 12""")
def cause_by_zone(spark, folder):
    return paths.cause_by_zone(zoned(spark, folder))


@query("category_by_zone", f"""
, counted AS (SELECT "ZONE", "NE_Category", count(*) AS n FROM zoned GROUP BY 1, 2),
shares AS (SELECT *, n / sum(n) OVER (PARTITION BY "ZONE") * 100 AS pct FROM counted)
SELECT "NE_Category", {_zone_columns('NE_Category')}, {r('sum(pct)')} AS "Row_Total" FROM shares GROUP BY 1""")
def category_by_zone(spark, folder):
    return paths.category_by_zone(zoned(spark, folder))


FINGERPRINT = """
, rows56 AS (SELECT * FROM zoned WHERE "ZONE" IN ('ZONE 4', 'ZONE 5')),
top AS (SELECT "Standardized RFO", count(*) AS n FROM rows56 GROUP BY 1 ORDER BY n DESC, 1 LIMIT 10),
sides AS (
  SELECT "Standardized RFO", coalesce(count(*) FILTER ("ZONE" = 'ZONE 4')
           / nullif((SELECT count(*) FROM rows56 WHERE "ZONE" = 'ZONE 4'), 0) * 100, 0) AS one,
         coalesce(count(*) FILTER ("ZONE" = 'ZONE 5')
           / nullif((SELECT count(*) FROM rows56 WHERE "ZONE" = 'ZONE 5'), 0) * 100, 0) AS two
  FROM rows56 WHERE "Standardized RFO" IN (SELECT "Standardized RFO" FROM top) GROUP BY 1)"""


@query("cause_fingerprint", f"""{FINGERPRINT}
SELECT "Standardized RFO", {r('one')} AS "First_Pct", {r('two')} AS "Second_Pct" FROM sides""")
def cause_fingerprint(spark, folder):
    return paths.cause_fingerprint(zoned(spark, folder), ("ZONE 4", "ZONE 5"))


@query("shared_causes", f"""{FINGERPRINT}
SELECT "Standardized RFO" FROM sides WHERE one > 5 AND two > 5""")
def shared_causes(spark, folder):
    return paths.shared_causes(paths.cause_fingerprint(zoned(spark, folder), ("ZONE 4", "ZONE 5")))


@query("slow_causes", f"""
SELECT "ZONE", "Standardized RFO", {r('avg("FIELD_TIME_HOURS")')} AS "Avg_Field_Time",
       count("FIELD_TIME_HOURS") AS "Tickets"
FROM zoned WHERE {FIELD} AND "Timestamp_Integrity" AND "ZONE" IN ('ZONE 4', 'ZONE 5')
GROUP BY 1, 2 HAVING count("FIELD_TIME_HOURS") >= 20""")
def slow_causes(spark, folder):
    return paths.slow_causes(zoned(spark, folder), ["ZONE 4", "ZONE 5"])


@query("top_causes", """
, counted AS (SELECT "Region", "Standardized RFO", count(*) AS "Count" FROM clean GROUP BY 1, 2)
SELECT *, row_number() OVER (PARTITION BY "Region" ORDER BY "Count" DESC, "Standardized RFO")::INT AS "Rank"
FROM counted QUALIFY "Rank" <= 5""")
def top_causes(spark, folder):
    return paths.top_causes(clean_table(spark, folder), "Region")


# --- cities -----------------------------------------------------------------------------------

CITIES = f"""
, city AS (
  SELECT "ZONE", "CITY", count(*) AS n, avg("SLA_Compliant") * 100 AS sla, avg("OUTAGEDURATION") AS mttr,
         count(DISTINCT "SiteName") AS sites,
         avg("DISPATCH_DELAY_HOURS") FILTER ("Timestamp_Integrity") AS noc,
         avg("FIELD_TIME_HOURS") FILTER ("Timestamp_Integrity") AS field,
         count(*) FILTER ("Priority_Urgency" = '3.2') AS p32,
         (1 - avg("SLA_Compliant") FILTER ("Priority_Urgency" = '3.2')) * 100 AS p32_breach,
         avg("OUTAGEDURATION") FILTER ("Priority_Urgency" = '3.2') AS p32_mttr,
         count(*) FILTER ("Standardized RFO" = 'UNKNOWN-Under Investigation') AS unknown
  FROM zoned GROUP BY 1, 2),
big AS (SELECT * FROM city WHERE n >= {CITY_MIN}),
zone AS (
  SELECT "ZONE", avg("SLA_Compliant") * 100 AS zone_sla, avg("OUTAGEDURATION") AS zone_mttr,
         count("TICKETID") / count(DISTINCT "SiteName") AS zone_density
  FROM zoned GROUP BY 1),
big_rows AS (SELECT zoned.* FROM zoned JOIN big USING ("ZONE", "CITY"))"""


@query("large_cities", f"""{CITIES}
SELECT "TICKETID", "ZONE", "CITY" FROM big_rows""")
def large_cities(spark, folder):
    return cities.large_cities(zoned(spark, folder), CITY_MIN).select("TICKETID", "ZONE", "CITY")


@query("city_summary", f"""{CITIES}
SELECT "ZONE", "CITY", n AS "Tickets", {r('sla')} AS "SLA_pct", {r('mttr')} AS "Avg_MTTR", sites AS "Unique_Sites",
       {r('n / sites')} AS "Fault_Density", {r('noc')} AS "Avg_NOC_Time", {r('field')} AS "Avg_Field_Time",
       {r('zone_sla')} AS "Zone_SLA", {r('sla - zone_sla')} AS "SLA_vs_Zone"
FROM big JOIN zone USING ("ZONE")""")
def city_summary(spark, folder):
    return cities.city_summary(zoned(spark, folder), CITY_MIN)


@query("city_flags", f"""{CITIES}
SELECT "ZONE", "CITY",
       CASE WHEN sla < zone_sla - 3 THEN 'below' WHEN sla > zone_sla + 3 THEN 'above' ELSE 'within' END AS "SLA_Status",
       CASE WHEN mttr > zone_mttr * 1.25 THEN 'above' WHEN mttr < zone_mttr * 0.75 THEN 'below'
            ELSE 'within' END AS "MTTR_Status",
       CASE WHEN n / sites > zone_density * 1.25 THEN 'high' WHEN n / sites > zone_density THEN 'raised'
            ELSE 'normal' END AS "Density_Status"
FROM big JOIN zone USING ("ZONE")""")
def city_flags(spark, folder):
    return cities.city_flags(zoned(spark, folder), CITY_MIN)


@query("city_volumes", f"""{CITIES}
SELECT "ZONE", "CITY", n AS "Tickets", {r('sla')} AS "SLA_pct", {r('mttr')} AS "Avg_MTTR", n < 300 AS "Low_Vol"
FROM city""")
def city_volumes(spark, folder):
    return cities.city_volumes(zoned(spark, folder), 300)


@query("degradation_breach", f"""{CITIES}
, zone32 AS (
  SELECT "ZONE", (1 - avg("SLA_Compliant")) * 100 AS b FROM big_rows WHERE "Priority_Urgency" = '3.2' GROUP BY 1)
SELECT "ZONE", "CITY", p32 AS "P32_Tickets", {r('p32_breach')} AS "P32_Breach", {r('p32_mttr')} AS "P32_MTTR",
       {r('b')} AS "Zone_Breach"
FROM big JOIN zone32 USING ("ZONE") WHERE p32 >= 20""")
def degradation_breach(spark, folder):
    return cities.degradation_breach(zoned(spark, folder), 20, CITY_MIN)


@query("endorsement_delay", f"""{CITIES}
SELECT "ZONE", replace("CITY", 'CITY OF ', '') AS "CITY", count("DISPATCH_DELAY_HOURS") AS "Tickets",
       {r('avg("DISPATCH_DELAY_HOURS")')} AS "Avg_NOC_Time", {r('median("DISPATCH_DELAY_HOURS")')} AS "Med_NOC_Time",
       {r('least(avg("DISPATCH_DELAY_HOURS"), 5.5)')} AS "Avg_NOC_Time_Capped"
FROM big_rows WHERE "Timestamp_Integrity" GROUP BY "ZONE", big_rows."CITY"
HAVING count("DISPATCH_DELAY_HOURS") >= 30""")
def endorsement_delay(spark, folder):
    return cities.endorsement_delay(zoned(spark, folder), 30, 5.5, CITY_MIN)


@query("unknown_rate", f"""{CITIES}
SELECT "ZONE", "CITY", n AS "Total_Tickets", unknown AS "Unknown_Tickets", {r('unknown / n * 100')} AS "Unknown_Rate"
FROM big""")
def unknown_rate(spark, folder):
    return cities.unknown_rate(zoned(spark, folder), CITY_MIN)


CLASSES = f"""{CITIES}
, classed AS (
  SELECT *, CASE WHEN "CITY" IN ({values(BUSINESS)}) THEN 'CBD' ELSE 'Non-CBD' END AS "City_Type"
  FROM big_rows WHERE "ZONE" = 'ZONE 5' AND "Timestamp_Integrity")"""


@query("city_class_split", f"""{CLASSES}
SELECT "City_Type", count("FIELD_TIME_HOURS") AS "Tickets", {r('avg("FIELD_TIME_HOURS")')} AS "Avg_Field_Time",
       {r('median("FIELD_TIME_HOURS")')} AS "Med_Field_Time", {r('avg("SLA_Compliant") * 100')} AS "SLA_pct"
FROM classed GROUP BY 1""")
def city_class_split(spark, folder):
    return cities.class_split(zoned(spark, folder), "ZONE 5", BUSINESS, CITY_MIN)


@query("city_class_detail", f"""{CLASSES}
SELECT "CITY", "City_Type", count("FIELD_TIME_HOURS") AS "Tickets", {r('avg("FIELD_TIME_HOURS")')} AS "Avg_Field_Time",
       {r('avg("DISPATCH_DELAY_HOURS")')} AS "Avg_NOC_Time", {r('avg("SLA_Compliant") * 100')} AS "SLA_pct"
FROM classed GROUP BY 1, 2""")
def city_class_detail(spark, folder):
    return cities.class_by_city(zoned(spark, folder), "ZONE 5", BUSINESS, CITY_MIN)


@query("city_class_verdict", f"""{CLASSES}
, means AS (SELECT avg("FIELD_TIME_HOURS") FILTER ("City_Type" = 'CBD') AS a,
                   avg("FIELD_TIME_HOURS") FILTER ("City_Type" = 'Non-CBD') AS b FROM classed)
SELECT {r('a')} AS "CBD", {r('b')} AS "Non_CBD", {r('a - b')} AS "Delta",
       CASE WHEN a - b > 20 THEN 'material' WHEN a - b > 5 THEN 'contributing' ELSE 'small' END AS "Verdict"
FROM means WHERE a IS NOT NULL AND b IS NOT NULL""")
def city_class_verdict(spark, folder):
    return cities.class_verdict(cities.class_split(zoned(spark, folder), "ZONE 5", BUSINESS, CITY_MIN))


@query("city_quadrants", f"""{CITIES}
, m AS (SELECT median(100 - sla) AS mb, median(n / sites) AS md FROM big)
SELECT "ZONE", "CITY", n AS "Tickets", {r('100 - sla')} AS "Breach_Rate", {r('n / sites')} AS "Fault_Density",
       CASE WHEN 100 - sla > mb AND n / sites > md THEN 'priority target' WHEN n / sites > md THEN 'recurrence'
            WHEN 100 - sla > mb THEN 'slow service' ELSE 'fine' END AS "Quadrant"
FROM big, m""")
def city_quadrants(spark, folder):
    return cities.city_quadrants(zoned(spark, folder), CITY_MIN)


_NORM = "({0} - min({0}) OVER ()) / (max({0}) OVER () - min({0}) OVER () + 1e-9) * 100"


@query("city_risk", f"""{CITIES}
, measured AS (
  SELECT "ZONE", "CITY", n, 100 - sla AS b, CASE WHEN p32 >= 20 THEN p32_breach END AS p, n / sites AS d,
         unknown / n * 100 AS u FROM big),
scaled AS (
  SELECT *, {_NORM.format('b')} AS nb, {_NORM.format('p')} AS np, {_NORM.format('d')} AS nd, {_NORM.format('u')} AS nu
  FROM measured),
scored AS (SELECT *, nb * 0.35::DOUBLE + np * 0.30::DOUBLE + nd * 0.20::DOUBLE + nu * 0.15::DOUBLE AS score FROM scaled)
SELECT "ZONE", "CITY", n AS "Tickets", {r('b')} AS "Breach_Rate", {r('p')} AS "P32_Breach", {r('d')} AS "Fault_Density",
       {r('u')} AS "Unknown_Rate", {r('nb')} AS "Breach_Rate_norm", {r('np')} AS "P32_Breach_norm",
       {r('nd')} AS "Fault_Density_norm", {r('nu')} AS "Unknown_Rate_norm", {r('score')} AS "Risk_Score",
       row_number() OVER (ORDER BY round(score, 9) DESC NULLS LAST, "ZONE", "CITY")::INT AS "Rank"
FROM scored""")
def city_risk(spark, folder):
    return cities.city_risk(zoned(spark, folder), CITY_MIN)


@query("city_panel", f"""{CITIES}
SELECT "ZONE", "CITY", {r('sla')} AS "Value",
       row_number() OVER (PARTITION BY "ZONE" ORDER BY n DESC, "CITY")::INT AS "Rank"
FROM big QUALIFY "Rank" <= 3""")
def city_panel(spark, folder):
    return cities.metric_panel(cities.city_summary(zoned(spark, folder), CITY_MIN), "SLA_pct", "Tickets", 3)


@query("city_extremes", f"""{CITIES}
(SELECT 'worst compliance' AS metric, "CITY" AS city, {r('sla')} AS value FROM big ORDER BY sla, "CITY" LIMIT 1)
UNION ALL (SELECT 'best compliance', "CITY", {r('sla')} FROM big ORDER BY sla DESC, "CITY" DESC LIMIT 1)
UNION ALL (SELECT 'longest repair', "CITY", {r('mttr')} FROM big ORDER BY mttr DESC, "CITY" DESC LIMIT 1)
UNION ALL (SELECT 'densest', "CITY", {r('n / sites')} FROM big ORDER BY n / sites DESC, "CITY" DESC LIMIT 1)""")
def city_extremes(spark, folder):
    from outagelens.plans.snapshots import extreme_rows

    summary = cities.city_summary(zoned(spark, folder), CITY_MIN)
    return extreme_rows(summary, "CITY", "city", [
        ("worst compliance", "SLA_pct", False), ("best compliance", "SLA_pct", True),
        ("longest repair", "Avg_MTTR", True), ("densest", "Fault_Density", True),
    ])


# --- sites ------------------------------------------------------------------------------------------

SITES = """
, ne AS (
  SELECT "SiteName", count(DISTINCT "NEType") AS types,
         coalesce(bool_or("NE_Category" IN ('Core Network', 'IP/Network Infra', 'IP Network Infra')), false) AS core
  FROM zoned GROUP BY 1),
zone_mode AS (
  SELECT "SiteName", "ZONE" FROM (SELECT "SiteName", "ZONE", count(*) AS n FROM zoned GROUP BY 1, 2)
  QUALIFY row_number() OVER (PARTITION BY "SiteName" ORDER BY n DESC, "ZONE") = 1),
city_mode AS (
  SELECT "SiteName", "CITY" FROM (SELECT "SiteName", "CITY", count(*) AS n FROM zoned GROUP BY 1, 2)
  QUALIFY row_number() OVER (PARTITION BY "SiteName" ORDER BY n DESC, "CITY") = 1),
attributes AS (
  SELECT "SiteName", types, core, CASE WHEN core OR types >= 6 THEN 'High' WHEN types >= 3 THEN 'Medium'
         ELSE 'Low' END AS complexity, zone_mode."ZONE" AS home_zone, city_mode."CITY" AS home_city
  FROM ne JOIN zone_mode USING ("SiteName") JOIN city_mode USING ("SiteName"))"""


@query("site_attributes", f"""{SITES}
SELECT "SiteName", types AS "NE_Count", core AS "Has_Core_IP", complexity AS "Complexity", home_zone AS "ZONE",
       home_city AS "CITY"
FROM attributes""")
def site_attributes(spark, folder):
    return sites.site_attributes(zoned(spark, folder))


def _pct(column: str) -> str:
    return (
        f"(rank() OVER (PARTITION BY \"ZONE\" ORDER BY {column} ASC NULLS LAST)"
        f" + (count(*) OVER (PARTITION BY \"ZONE\", {column}) - 1) / 2.0::DOUBLE)"
        f" / count(*) OVER (PARTITION BY \"ZONE\") * 100"
    )


RISK = f"""{SITES}
, span AS (SELECT floor(epoch_us(max("REPORTDATE") - min("REPORTDATE")) / 86400000000) / 30.44::DOUBLE AS months FROM zoned),
volume AS (
  SELECT "ZONE", "SiteName", count(*) AS n, count(*) FILTER ({FIELD}) AS fd,
         avg("SLA_Compliant") FILTER ({FIELD}) * 100 AS sla, avg("OUTAGEDURATION") FILTER ({FIELD}) AS mttr
  FROM zoned GROUP BY 1, 2),
ranked AS (
  SELECT volume.*, types, core, complexity, home_city, months, 100 - sla AS breach,
         {_pct('n')} AS f, {_pct('mttr')} AS m, {_pct('(100 - sla)')} AS b,
         CASE complexity WHEN 'Low' THEN 0 WHEN 'Medium' THEN 50 ELSE 100 END AS c
  FROM volume JOIN attributes USING ("SiteName"), span),
risk AS (SELECT *, f * 0.30::DOUBLE + m * 0.30::DOUBLE + b * 0.25::DOUBLE + c * 0.15::DOUBLE AS score FROM ranked)"""


@query("site_risk", f"""{RISK}
SELECT "ZONE", "SiteName", n AS "All_Tickets", fd AS "FD_Tickets", {r('sla')} AS "SLA_pct", {r('mttr')} AS "Avg_MTTR",
       complexity AS "Complexity", types AS "NE_Count", core AS "Has_Core_IP", home_city AS "CITY",
       {r('breach')} AS "Breach_Rate", {r('n / months')} AS "Fault_per_Month", n < 10 AS "Low_Vol",
       c AS "Complexity_Score", {r('f')} AS "Freq_Rank", {r('m')} AS "MTTR_Rank", {r('b')} AS "Breach_Rank",
       {r('score')} AS "Risk_Score"
FROM risk""")
def site_risk(spark, folder):
    return sites.site_risk(zoned(spark, folder))


@query("top_risk_sites", f"""{RISK}
SELECT "ZONE", "SiteName", {r('score')} AS "Risk_Score",
       row_number() OVER (PARTITION BY "ZONE" ORDER BY round(score, 9) DESC, "SiteName")::INT AS "Rank"
FROM risk WHERE n >= 10 QUALIFY "Rank" <= 5""")
def top_risk_sites(spark, folder):
    top = sites.top_risk_sites(sites.site_risk(zoned(spark, folder)), 5)
    return top.select("ZONE", "SiteName", "Risk_Score", "Rank")


@query("maintenance_targets", f"""{RISK}
SELECT "ZONE", "SiteName", {r('score')} AS "Risk_Score" FROM risk WHERE n >= 10 AND round(score, 9) >= 70""")
def maintenance_targets(spark, folder):
    targets = sites.maintenance_targets(sites.site_risk(zoned(spark, folder)), 70)
    return targets.select("ZONE", "SiteName", "Risk_Score")


@query("slow_site_drill", f"""{RISK}
, worst AS (SELECT "SiteName" FROM risk WHERE "ZONE" = 'ZONE 1' ORDER BY mttr DESC NULLS LAST, "SiteName" LIMIT 2),
rows AS (SELECT * FROM zoned WHERE "SiteName" IN (SELECT "SiteName" FROM worst)),
spans AS (SELECT "SiteName", min("OUTAGEDURATION") AS lo, max("OUTAGEDURATION") AS hi, count(*) AS n FROM rows GROUP BY 1)
SELECT "SiteName", "Standardized RFO", count(*) AS "Tickets", {r('avg("OUTAGEDURATION")')} AS "Avg_MTTR",
       any_value(lo) AS "Site_Min", any_value(hi) AS "Site_Max", any_value(n) AS "Site_Tickets"
FROM rows JOIN spans USING ("SiteName") GROUP BY 1, 2""")
def slow_site_drill(spark, folder):
    rows = zoned(spark, folder)
    return sites.site_drill(rows, sites.slowest_sites(sites.site_risk(rows), "ZONE 1", 2))


@query("complexity_table", f"""{SITES}
SELECT complexity AS "Complexity", count(DISTINCT "SiteName") AS "Sites", count("SLA_Compliant") AS "Tickets",
       {r('avg("SLA_Compliant") * 100')} AS "SLA", {r('avg("OUTAGEDURATION")')} AS "MTTR",
       {r('count(*) / count(DISTINCT "SiteName")')} AS "Density"
FROM zoned JOIN attributes USING ("SiteName") GROUP BY 1""")
def complexity_table(spark, folder):
    return sites.complexity_table(zoned(spark, folder))


PROFILE = """
, profile AS (
  SELECT "SiteName", count("TICKETID") AS n, avg("OUTAGEDURATION") AS mttr, avg("SLA_Compliant") * 100 AS sla,
         count(DISTINCT "Standardized RFO") AS causes, count(DISTINCT "NE_Category") AS types
  FROM zoned WHERE "ZONE" = 'ZONE 1' GROUP BY 1),
placed_sites AS (
  SELECT *, row_number() OVER w AS place, sum(n) OVER (w ROWS UNBOUNDED PRECEDING) AS running,
         sum(n) OVER () AS total
  FROM profile WINDOW w AS (ORDER BY n DESC, "SiteName"))"""


@query("site_pareto", f"""{PROFILE}
SELECT "SiteName", n AS "Total_Tickets", {r('mttr')} AS "Avg_MTTR", {r('sla')} AS "SLA_Rate", causes AS "Unique_RFOs",
       types AS "Unique_NE", place::BIGINT AS "Rank", running::BIGINT AS "Running_Count",
       {r('running / total * 100')} AS "Cumulative_Pct"
FROM placed_sites""")
def site_pareto(spark, folder):
    return sites.site_pareto(zoned(spark, folder), "ZONE 1")


@query("site_pareto_marks", f"""{PROFILE}
SELECT mark::INT AS threshold, min(place)::BIGINT AS sites
FROM placed_sites, (SELECT unnest([20, 50, 80]) AS mark) WHERE running / total * 100 >= mark GROUP BY mark""")
def site_pareto_marks(spark, folder):
    return sites.pareto_marks(sites.site_pareto(zoned(spark, folder), "ZONE 1"))


@query("site_concentration", f"""{PROFILE}
SELECT mark::INT AS top, sum(n)::BIGINT AS tickets, {r('sum(n) / any_value(total) * 100')} AS pct
FROM placed_sites, (SELECT unnest([10, 20]) AS mark) WHERE place <= mark GROUP BY mark""")
def site_concentration(spark, folder):
    return sites.concentration(sites.site_pareto(zoned(spark, folder), "ZONE 1"))


COHORT = """
, z1 AS (SELECT * FROM zoned WHERE "ZONE" = 'ZONE 1'),
busy AS (SELECT "SiteName", count(*) AS n FROM z1 GROUP BY 1 ORDER BY n DESC, "SiteName" LIMIT 5),
flagged AS (SELECT *, "SiteName" IN (SELECT "SiteName" FROM busy) AS in_top FROM z1),
frequent AS (SELECT "Standardized RFO", count(*) AS n FROM z1 GROUP BY 1 ORDER BY n DESC, 1 LIMIT 6)"""


@query("cohort_causes", f"""{COHORT}
SELECT "Standardized RFO",
       {r('coalesce(count(*) FILTER (in_top) / nullif((SELECT count(*) FROM flagged WHERE in_top), 0) * 100, 0)')} AS "Top_Pct",
       {r('coalesce(count(*) FILTER (NOT in_top) / nullif((SELECT count(*) FROM flagged WHERE NOT in_top), 0) * 100, 0)')}
         AS "Rest_Pct"
FROM flagged WHERE "Standardized RFO" IN (SELECT "Standardized RFO" FROM frequent) GROUP BY 1""")
def cohort_causes(spark, folder):
    return sites.cohort_causes(zoned(spark, folder), "ZONE 1", 5, 6)


@query("cohort_categories", f"""{COHORT}
, counted AS (SELECT "SiteName", "NE_Category", count(*) AS n FROM flagged WHERE in_top GROUP BY 1, 2)
SELECT "SiteName", "NE_Category", n AS "Count", (sum(n) OVER (PARTITION BY "SiteName"))::BIGINT AS "Parent_Total",
       {r('n / sum(n) OVER (PARTITION BY "SiteName") * 100')} AS "Pct" FROM counted""")
def cohort_categories(spark, folder):
    return sites.cohort_categories(zoned(spark, folder), "ZONE 1", 5)


@query("maintenance_list", f"""{PROFILE}
, busy AS (SELECT * FROM profile ORDER BY n DESC, "SiteName" LIMIT 10),
scaled AS (SELECT *, {_NORM.format('n')} AS v, {_NORM.format('mttr')} AS m, {_NORM.format('(100 - sla)')} AS s FROM busy),
scored AS (
  SELECT *, round_even(round(v * 0.5::DOUBLE + m * 0.3::DOUBLE + s * 0.2::DOUBLE, 9), 1) AS score FROM scaled)
SELECT row_number() OVER (ORDER BY score DESC, n DESC, "SiteName")::INT AS "PM_Priority", "SiteName",
       n AS "Total_Tickets", {r('mttr')} AS "Avg_MTTR", {r('sla')} AS "SLA_Rate", score AS "Risk_Score"
FROM scored""")
def maintenance_list(spark, folder):
    return sites.maintenance_list(zoned(spark, folder), "ZONE 1", 10)


# --- engineers -----------------------------------------------------------------------------------------

LEAD_MIN = 20
SHARED = "ENG_" + __import__("hashlib").sha256(b"SHARED DESK").hexdigest()[:8]
POOL = f"""
, fd AS (SELECT * FROM zoned WHERE {FIELD} AND "Field_Lead_ID" <> 'Unknown'),
own AS (SELECT * FROM fd WHERE "WOOwnerGroup" = 'Field Operations'),
home AS (
  SELECT "Field_Lead_ID", "ZONE" AS home FROM (SELECT "Field_Lead_ID", "ZONE", count(*) AS n FROM own GROUP BY 1, 2)
  QUALIFY row_number() OVER (PARTITION BY "Field_Lead_ID" ORDER BY n DESC, "ZONE") = 1),
aligned AS (SELECT own.* FROM own JOIN home USING ("Field_Lead_ID") WHERE "ZONE" = home),
pool AS (SELECT * FROM aligned QUALIFY count(*) OVER (PARTITION BY "ZONE", "Field_Lead_ID") >= {LEAD_MIN}),
stats AS (
  SELECT "ZONE", "Field_Lead_ID", count("SLA_Compliant") AS n, avg("SLA_Compliant") * 100 AS sla,
         avg("OUTAGEDURATION") AS mttr, count(DISTINCT "SiteName") AS sites
  FROM pool GROUP BY 1, 2)"""


def lead_stats(spark, folder):
    return engineers.lead_stats(zoned(spark, folder), LEAD_MIN)


@query("home_zones", f"""{POOL}
SELECT "Field_Lead_ID", home AS "Home_Zone" FROM home""")
def home_zones(spark, folder):
    own = engineers.attributed(zoned(spark, folder)).where(F.col("WOOwnerGroup") == "Field Operations")
    return engineers.home_zones(own)


@query("active_engineers", f"""{POOL}
SELECT "TICKETID", "ZONE", "Field_Lead_ID" FROM pool""")
def active_engineers(spark, folder):
    return engineers.active_pool(zoned(spark, folder), LEAD_MIN).select("TICKETID", "ZONE", "Field_Lead_ID")


@query("engineer_stats", f"""{POOL}
SELECT "ZONE", "Field_Lead_ID", n AS "Tickets", {r('sla')} AS "SLA_pct", {r('mttr')} AS "Avg_MTTR",
       sites AS "Unique_Sites" FROM stats""")
def engineer_stats(spark, folder):
    return lead_stats(spark, folder)


GINI = f"""{POOL}
, placed_leads AS (SELECT *, row_number() OVER (PARTITION BY "ZONE" ORDER BY n, "Field_Lead_ID") AS i FROM stats),
gini AS (
  SELECT "ZONE", CASE WHEN count(*) < 2 OR sum(n) = 0 THEN 0 ELSE
         2 * sum(i * n) / (count(*) * sum(n))::DOUBLE - (count(*) + 1) / count(*)::DOUBLE END AS g
  FROM placed_leads GROUP BY 1)"""


@query("engineer_gini", f"""{GINI}
SELECT "ZONE", {r('g')} AS "Gini" FROM gini""")
def engineer_gini(spark, folder):
    return gini(lead_stats(spark, folder), ["ZONE"], "Tickets")


@query("engineer_load", f"""{GINI}
SELECT "ZONE", count(*) AS "Engineers", {r('median(n)')} AS "Median_Tickets", max(n) AS "Max_Tickets",
       {r('median(sites)')} AS "Median_Sites", {r('avg(sla)')} AS "Avg_SLA", {r('any_value(g)')} AS "Gini"
FROM stats JOIN gini USING ("ZONE") GROUP BY 1""")
def engineer_load(spark, folder):
    return engineers.load_table(lead_stats(spark, folder))


@query("engineer_coverage", f"""{POOL}
SELECT "ZONE", count(*) AS "Engineers", {r('median(sites)')} AS "Median_Sites", max(sites) AS "Max_Sites",
       {r('quantile_cont(sites::DOUBLE, 0.9)')} AS "P90_Sites", {r('avg(n / sites)')} AS "Avg_Tickets_per_Site"
FROM stats GROUP BY 1""")
def engineer_coverage(spark, folder):
    return engineers.coverage_table(lead_stats(spark, folder))


BANDS = f"""{POOL}
, quartiles AS (
  SELECT "ZONE", quantile_cont(n::DOUBLE, 0.25) AS lo, quantile_cont(n::DOUBLE, 0.75) AS hi FROM stats GROUP BY 1),
bands AS (
  SELECT stats.*, CASE WHEN n >= hi THEN 'High load' WHEN n <= lo THEN 'Low load' ELSE 'Mid load' END AS band
  FROM stats JOIN quartiles USING ("ZONE"))"""


@query("engineer_bands", f"""{BANDS}
SELECT "ZONE", "Field_Lead_ID", n AS "Tickets", band AS "Load_Group" FROM bands""")
def engineer_bands(spark, folder):
    banded = load_bands(lead_stats(spark, folder), ["ZONE"], "Tickets")
    return banded.select("ZONE", "Field_Lead_ID", "Tickets", "Load_Group")


@query("engineer_band_performance", f"""{BANDS}
SELECT band AS "Load_Group", count(*) AS "Engineers", {r('median(n)')} AS "Median_Tickets", {r('avg(sla)')} AS "Avg_SLA",
       {r('avg(mttr)')} AS "Avg_MTTR", {r('avg(sites)')} AS "Avg_Sites"
FROM bands GROUP BY 1""")
def engineer_band_performance(spark, folder):
    return engineers.band_performance(lead_stats(spark, folder))


@query("engineer_lorenz", f"""{POOL}
SELECT "ZONE", "Field_Lead_ID", n AS "Tickets",
       {r('row_number() OVER w / count(*) OVER (PARTITION BY "ZONE")')} AS "Pop_Share",
       {r('sum(n) OVER (w ROWS UNBOUNDED PRECEDING) / sum(n) OVER (PARTITION BY "ZONE")')} AS "Cum_Share"
FROM stats WINDOW w AS (PARTITION BY "ZONE" ORDER BY n, "Field_Lead_ID")""")
def engineer_lorenz(spark, folder):
    return engineers.lorenz_points(lead_stats(spark, folder))


@query("engineers_above_median", f"""{POOL}
, medians AS (SELECT "ZONE", median(sites) AS m FROM stats GROUP BY 1)
SELECT "ZONE", "Field_Lead_ID", sites AS "Unique_Sites", {r('m')} AS "Group_Median"
FROM stats JOIN medians USING ("ZONE") WHERE sites > m * 1.2""")
def engineers_above_median(spark, folder):
    high = above_group_median(lead_stats(spark, folder), ["ZONE"], "Unique_Sites", 1.2)
    return high.select("ZONE", "Field_Lead_ID", "Unique_Sites", "Group_Median")


@query("outside_groups", f"""{POOL}
SELECT "WOOwnerGroup", count("SLA_Compliant") AS "Tickets", {r('avg("SLA_Compliant") * 100')} AS "SLA_pct",
       {r('avg("OUTAGEDURATION")')} AS "Avg_MTTR"
FROM fd WHERE "WOOwnerGroup" <> 'Field Operations' GROUP BY 1""")
def outside_groups(spark, folder):
    return engineers.outside_groups(zoned(spark, folder))


@query("outside_groups_by_zone", f"""{POOL}
SELECT "ZONE", count(*) FILTER ("WOOwnerGroup" = 'Field Operations') AS "Own_Team",
       count(*) FILTER ("WOOwnerGroup" <> 'Field Operations') AS "Other_Teams",
       {r('''count(*) FILTER ("WOOwnerGroup" <> 'Field Operations') / count(*) * 100''')} AS "Other_Pct"
FROM fd GROUP BY 1""")
def outside_groups_by_zone(spark, folder):
    return engineers.outside_by_zone(zoned(spark, folder))


@query("account_quality", f"""
, known AS (SELECT * FROM zoned WHERE "Engineer_ID" <> 'Unknown'),
team AS (
  SELECT "Engineer_ID", "Issuer_Team" FROM (SELECT "Engineer_ID", "Issuer_Team", count(*) AS n FROM known GROUP BY 1, 2)
  QUALIFY row_number() OVER (PARTITION BY "Engineer_ID" ORDER BY n DESC, "Issuer_Team") = 1)
SELECT "Engineer_ID", count("SLA_Compliant") AS "Tickets", {r('avg("SLA_Compliant") * 100')} AS "SLA_pct",
       {r('''count(*) FILTER ("Standardized RFO" = 'UNKNOWN-Under Investigation') / count(*) * 100''')} AS "Unknown_pct",
       array_to_string(list_sort(list(DISTINCT "ZONE")), ', ') AS "Zones", any_value(team."Issuer_Team") AS "Team",
       "Engineer_ID" = {q(SHARED)} AS "Is_Shared"
FROM known JOIN team USING ("Engineer_ID") GROUP BY "Engineer_ID" """)
def account_quality(spark, folder):
    return engineers.account_stats(zoned(spark, folder), SHARED)


_UNRESOLVED = """("Standardized RFO" = 'UNKNOWN-Under Investigation')::INT"""
_IND = f""" "Engineer_ID" NOT IN ('Unknown', {q(SHARED)}) """
_SHA = f""" "Engineer_ID" = {q(SHARED)} """


@query("account_kinds", f"""
SELECT {r(f'avg({_UNRESOLVED}) * 100')} AS "All_Tickets",
       {r(f'avg({_UNRESOLVED}) FILTER ({_IND}) * 100')} AS "Individual",
       {r(f'avg({_UNRESOLVED}) FILTER ({_SHA}) * 100')} AS "Shared",
       count(*) FILTER ({_SHA}) AS "Shared_Tickets", count(*) FILTER ({_IND}) AS "Individual_Tickets"
FROM zoned""")
def account_kinds(spark, folder):
    return engineers.account_kinds(zoned(spark, folder), SHARED)


@query("city_accounts", f"""
SELECT "Issuer_Team", count(*) AS "Tickets", sum({_UNRESOLVED})::BIGINT AS "Unknown"
FROM zoned WHERE "CITY" = 'NATION_3' GROUP BY 1""")
def city_accounts(spark, folder):
    return engineers.city_accounts(zoned(spark, folder), "NATION_3")
