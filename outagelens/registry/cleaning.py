"""Queries over raw tickets, the cleaning plan and its audit extracts."""

from __future__ import annotations

from pyspark.sql import functions as F

from outagelens import fixed_values as fixed
from outagelens.functions import service
from outagelens.functions import moments
from outagelens.functions.text import clean_text, prepared_text
from outagelens.operators import quality
from outagelens.operators.dedupe import cleaning_funnel, keep_first
from outagelens.operators.fuzzy import with_closest_label
from outagelens.operators.lookups import unmatched
from outagelens.operators.quantiles import grouped_quantiles
from outagelens.plans import cleaning
from outagelens.registry.base_sql import q, r, values
from outagelens.registry.core import query
from outagelens.sources.star_tickets import (
    ARRIVAL_ORDER, DEALT, clean_view, cleaning_of, cleaning_view, raw_tickets, sites, table, written_clean,
)

# A stated list, so that both engines drop the same words.
STOP_WORDS = (
    "and are but for from had has have her his not our out she that the their them then there they this was were "
    "which who will with you your des die der das und les est une del los las por para que pour dans sur"
).split()


@query("clean_tickets", f"""
SELECT * REPLACE ({r('"DISPATCH_DELAY_HOURS"')} AS "DISPATCH_DELAY_HOURS",
                  {r('"FIELD_TIME_HOURS"')} AS "FIELD_TIME_HOURS")
FROM clean""")
def clean_tickets(spark, folder):
    return clean_view(spark, folder)


@query("dedupe_first", """
SELECT "TICKETID", "Priority", "Urgency", "FT Status", l_partkey FROM first_copy""")
def dedupe_first(spark, folder):
    return keep_first(raw_tickets(spark, folder), ["TICKETID"], ARRIVAL_ORDER).select(
        "TICKETID", "Priority", "Urgency", "FT Status", "l_partkey"
    )


FUNNEL = """
, failing AS (
  SELECT CASE WHEN "Priority" IS NULL THEN 1 WHEN "Priority" NOT IN (1, 2, 3) THEN 2
              WHEN "Urgency" IS NULL OR "Urgency" NOT IN (0, 1, 2, 3) THEN 3
              WHEN "FT Status" IS NULL OR "FT Status" NOT IN ('CLOSED', 'RESOLVED', 'PENRESOLVE') THEN 4
              WHEN "Fault Type" = 'INVALID' THEN 5 END AS failed
  FROM first_copy),
drops AS (
  SELECT 0 AS step, 'Drop duplicate TICKETID' AS rule,
         (SELECT count(*) FROM raw) - (SELECT count(*) FROM first_copy) AS dropped
  UNION ALL SELECT 1, 'Drop blank Priority', count(*) FROM failing WHERE failed = 1
  UNION ALL SELECT 2, 'Keep Priority 1-3', count(*) FROM failing WHERE failed = 2
  UNION ALL SELECT 3, 'Keep Urgency 0-3', count(*) FROM failing WHERE failed = 3
  UNION ALL SELECT 4, 'Keep closing FT Status', count(*) FROM failing WHERE failed = 4
  UNION ALL SELECT 5, 'Drop Fault Type INVALID', count(*) FROM failing WHERE failed = 5)
SELECT CAST(step AS INT) AS step, rule, CAST(dropped AS BIGINT) AS dropped,
       CAST((SELECT count(*) FROM raw) - sum(dropped) OVER (ORDER BY step) AS BIGINT) AS remaining
FROM drops"""


@query("cleaning_funnel", FUNNEL)
def funnel(spark, folder):
    """Recorded while the clean table was written."""
    return cleaning.recorded_funnel(spark, written_clean(spark, folder)[1])


@query("cleaning_funnel_counted", FUNNEL)
def counted_funnel(spark, folder):
    return cleaning_funnel(raw_tickets(spark, folder), ["TICKETID"], ARRIVAL_ORDER, cleaning.structural_steps())


@query("retention", f"""
SELECT (SELECT count(*) FROM raw) AS initial_rows, count(*) AS final_rows,
       {r('count(*) / (SELECT count(*) FROM raw) * 100')} AS retained_pct
FROM clean""")
def retention(spark, folder):
    """Recorded while the clean table was written."""
    return cleaning.recorded_retention(spark, written_clean(spark, folder)[1])


@query("raw_snapshot", """
SELECT "TICKETID", "Priority", "Urgency", "FT Status", "Fault Type", "NEType", "RFODescription",
       l_shipdate, l_partkey, l_suppkey, l_extendedprice, l_discount, l_tax
FROM raw ORDER BY l_shipdate, l_partkey, l_suppkey, l_extendedprice, l_discount, l_tax, "TICKETID" LIMIT 1000""")
def raw_snapshot(spark, folder):
    return cleaning.snapshot(raw_tickets(spark, folder), [*ARRIVAL_ORDER, "TICKETID"])


@query("raw_quality", f"""
, counted AS (
  SELECT count(*) AS total_records, count(*) - count(DISTINCT "TICKETID") AS duplicate_tickets,
         count(*) FILTER ("Priority" IS NULL) AS blank_priority,
         count(*) FILTER ("Priority" IS NULL OR "Priority" NOT IN (1, 2, 3, 4)) AS invalid_priority,
         count(*) FILTER ("Urgency" IS NULL OR "Urgency" NOT IN (0, 1, 2, 3)) AS invalid_urgency,
         count(*) FILTER ("FT Status" IS NULL OR "FT Status" NOT IN
                          ('CLOSED', 'RESOLVED', 'PENRESOLVE', 'CANCELLED', 'INPROG')) AS invalid_status,
         count(*) FILTER ("Fault Type" = 'INVALID') AS invalid_fault_types
  FROM raw)
SELECT *, round_even(100 - (duplicate_tickets + blank_priority + invalid_priority + invalid_urgency + invalid_status
       + invalid_fault_types) / total_records::DOUBLE * 100, 2) AS quality_score
FROM counted""")
def raw_quality(spark, folder):
    return quality.initial_quality(raw_tickets(spark, folder), dealt=[DEALT])


@query("clean_validation", f"""
SELECT unnest([{values(fixed.VALIDATION_CHECKS)}]) AS "check",
       unnest([true, count(*) = count(DISTINCT "TICKETID"),
               bool_and("Region" IN ({values(fixed.REGION_ORDER)})),
               bool_and("SLA_Compliant" IS NULL OR "SLA_Compliant" IN (0, 1)),
               bool_and("OUTAGEDURATION" >= 0),
               bool_and("Priority_Urgency" IN ({values(fixed.SLA_HOURS)})),
               bool_and("Resolution_Path" IN ({values(fixed.PATH_ORDER)}))]) AS passed
FROM clean""")
def clean_validation(spark, folder):
    return quality.validation_report(clean_view(spark, folder))


RAW_COLUMNS = {
    "TICKETID": "string", "FT Status": "string", "Priority": "double", "Urgency": "double", "OUTAGEDURATION": "double",
    "RFODescription": "string", "ContactGroup": "string", "Area": "string", "Fault Type": "string",
    "DESCRIPTION": "string", "RootCause": "string", "NEType": "string", "ActionTaken": "string",
    "FT_Owner": "string", "WOLeadName": "string",
}


@query("table_profile", "\nUNION ALL\n".join(
    f"""SELECT {q(name)} AS "Column", {q(kind)} AS "DataType", count(*) - count("{name}") AS "MissingCount",
       {r(f'(count(*) - count("{name}")) / count(*)::DOUBLE * 100')} AS "MissingPercent",
       count(DISTINCT "{name}") AS "UniqueValues" FROM raw"""
    for name, kind in RAW_COLUMNS.items()
))
def table_profile(spark, folder):
    return quality.table_profile(raw_tickets(spark, folder).select(*RAW_COLUMNS))


@query("category_counts", "\nUNION ALL\n".join(
    f"""SELECT {q(name)} AS "Column", "{name}" AS "Value", count(*) AS "Count"
       FROM raw WHERE "{name}" IS NOT NULL GROUP BY ALL"""
    for name in ("FT Status", "Fault Type", "NEType", "RootCause")
))
def category_counts(spark, folder):
    return quality.category_counts(raw_tickets(spark, folder), ["FT Status", "Fault Type", "NEType", "RootCause"])


@query("number_profile", "\nUNION ALL\n".join(
    f"""SELECT {q(name)} AS "Column", count("{name}") AS n, {r(f'avg("{name}")')} AS mean,
       {r(f'stddev_samp("{name}")')} AS std, min("{name}") AS low, max("{name}") AS high FROM raw"""
    for name in ("Priority", "Urgency", "OUTAGEDURATION")
))
def number_profile(spark, folder):
    return quality.number_profile(raw_tickets(spark, folder), ["Priority", "Urgency", "OUTAGEDURATION"])


@query("duration_outliers", """
SELECT "TICKETID", "OUTAGEDURATION" FROM raw
WHERE "OUTAGEDURATION" > (SELECT quantile_cont("OUTAGEDURATION", 0.95) FROM raw)""")
def duration_outliers(spark, folder):
    rows = raw_tickets(spark, folder)
    limit = grouped_quantiles(rows, [], "OUTAGEDURATION", {"limit": 0.95}).scalar()
    return rows.where(F.col("OUTAGEDURATION") > limit).select("TICKETID", "OUTAGEDURATION")


@query("text_clean", """
SELECT "TICKETID", "RFODescription", "RootCause", "ActionTaken" FROM texts""")
def text_clean(spark, folder):
    rows = cleaning_view(spark, folder).stages["filtered"]
    return rows.select(
        "TICKETID", *[clean_text(F.col(c)).alias(c) for c in ("RFODescription", "RootCause", "ActionTaken")]
    )


@query("document_tokens", f"""
SELECT doc_id, array_to_string(list_filter(string_split(regexp_replace(lower(text), '[^a-z0-9]+', ' ', 'g'), ' '),
       lambda w: length(w) > 2 AND NOT list_contains([{values(STOP_WORDS)}], w)), ' ') AS prepared
FROM documents""", base=False)
def document_tokens(spark, folder):
    documents = table(spark, folder, "documents")
    return documents.select("doc_id", prepared_text(F.col("text"), STOP_WORDS).alias("prepared"))


@query("equipment_category", """
SELECT "NEType", "NE_Category", count(*) AS tickets FROM texts GROUP BY ALL""")
def equipment_category(spark, folder):
    rows = cleaning_view(spark, folder).stages["repaired"]
    return rows.groupBy("NEType", "NE_Category").agg(F.count("*").alias("tickets"))


@query("cause_backfill", """
SELECT "RFODescription", count(*) AS tickets FROM repaired GROUP BY ALL""")
def cause_backfill(spark, folder):
    rows = cleaning_view(spark, folder).stages["repaired"]
    return rows.groupBy("RFODescription").agg(F.count("*").alias("tickets"))


@query("cause_standard", """
SELECT "TICKETID", "Original_RFO", "Standardized RFO" FROM standard""")
def cause_standard(spark, folder):
    return cleaning_view(spark, folder).stages["standard"].select("TICKETID", "Original_RFO", "Standardized RFO")


@query("vocabulary_guard", f"""
SELECT "Standardized RFO", "Standardized RFO" IN ({values(fixed.CAUSE_LABELS)}) AS listed, count(*) AS tickets
FROM standard GROUP BY ALL""")
def vocabulary_guard(spark, folder):
    rows = cleaning_view(spark, folder).stages["standard"]
    return rows.groupBy(
        "Standardized RFO", F.col("Standardized RFO").isin(fixed.CAUSE_LABELS).alias("listed")
    ).agg(F.count("*").alias("tickets"))


@query("reclassified_unknowns", """
SELECT "Original_RFO", "Standardized RFO", "NEType", count(*) AS tickets FROM standard
WHERE lower("Original_RFO") = 'unknown under investigation'
  AND "Standardized RFO" IS DISTINCT FROM 'UNKNOWN-Under Investigation' GROUP BY ALL""")
def reclassified_unknowns(spark, folder):
    rows = cleaning.reclassified(cleaning_view(spark, folder).stages["standard"])
    return rows.groupBy("Original_RFO", "Standardized RFO", "NEType").agg(F.count("*").alias("tickets"))


@query("reclassified_labels", """
SELECT "Standardized RFO", count(*) AS tickets FROM standard
WHERE "Urgency" = 1 AND "Standardized RFO" IS DISTINCT FROM 'UNKNOWN-Under Investigation' GROUP BY ALL""")
def reclassified_labels(spark, folder):
    """The audit on tickets whose recorded cause was unknown, in one spelling or another, before the standard gave it a label."""
    rows = cleaning_view(spark, folder).stages["standard"]
    recorded = F.when(F.col("Urgency") == 1, F.when(F.col("Priority") == 1, "UNKNOWN Under Investigation").otherwise("unknown under investigation"))
    found = cleaning.reclassified(rows.withColumn("Original_RFO", F.coalesce(recorded, F.lit("power"))))
    return found.groupBy("Standardized RFO").agg(F.count("*").alias("tickets"))


@query("given_verdicts", """
SELECT verdicts, "Priority_Urgency", count(*) AS tickets,
       CAST(sum(CASE verdicts WHEN 'complete' THEN CAST("OUTAGEDURATION" AS BIGINT) % 2 ELSE "SLA_Compliant" END) AS BIGINT) AS compliant
FROM clean CROSS JOIN (VALUES ('complete'), ('incomplete')) AS given(verdicts) GROUP BY ALL""")
def given_verdicts(spark, folder):
    """Verdicts that the raw table brings, as text, count where every row has one; else all are worked out."""
    odd = F.col("OUTAGEDURATION").cast("long") % 2
    given = {"complete": odd.cast("double").cast("string"), "incomplete": F.when(odd == 1, "1")}
    every = None
    for name, verdict in given.items():
        run = cleaning_of(raw_tickets(spark, folder).withColumn("SLA_Compliant", verdict), spark, folder, infer=False)
        one = run.stages["modelled"].groupBy(F.lit(name).alias("verdicts"), "Priority_Urgency").agg(
            F.count("*").alias("tickets"), F.sum("SLA_Compliant").alias("compliant"))
        every = one if every is None else every.unionByName(one)
    return every


@query("fibre_audit", f"""
SELECT "TICKETID", "RFODescription", "Urgency", "Standardized RFO" FROM standard
WHERE "Standardized RFO" IN ({values(fixed.FIBRE_CAUSES)})""")
def fibre_audit(spark, folder):
    return cleaning.audit_extracts(cleaning_view(spark, folder))["foc_categorization_log"]


@query("region_cascade", """
SELECT "TICKETID", "Region" FROM placed""")
def region_cascade(spark, folder):
    return cleaning_view(spark, folder).stages["placed"].select("TICKETID", "Region")


SEGMENTS = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]


@query("closest_label", f"""
WITH texts AS (
  SELECT c_custkey, lower(substr(c_mktsegment, 1, length(c_mktsegment) - CAST(c_custkey % 4 AS INT))) AS text
  FROM customer),
labels AS (SELECT unnest([{values(SEGMENTS)}]) AS label, unnest(range(5)) AS place),
scored AS (
  SELECT c_custkey, label, place,
         100 * (1 - levenshtein(text, lower(label)) / greatest(length(text), length(label))) AS score
  FROM texts CROSS JOIN labels),
best AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY c_custkey ORDER BY score DESC, place) = 1)
SELECT c_custkey, CASE WHEN score >= 85 THEN label ELSE 'Uncategorized' END AS label FROM best""", base=False)
def closest(spark, folder):
    text = "lower(substring(c_mktsegment, 1, length(c_mktsegment) - cast(c_custkey % 4 AS int)))"
    customers = table(spark, folder, "customer").selectExpr("c_custkey", f"{text} AS text")
    return with_closest_label(customers, "text", SEGMENTS, 85, "Uncategorized", "label").select("c_custkey", "label")


@query("site_lookup", """
SELECT "TICKETID", "Region", "Area", "AssignArea", "AssignCity" FROM sited""")
def site_lookup(spark, folder):
    rows = cleaning_view(spark, folder).stages["sited"]
    return rows.select("TICKETID", "Region", "Area", "AssignArea", "AssignCity")


@query("site_dimension", """
SELECT "PLAID", "AssignArea", "AssignCity" FROM sites""")
def site_dimension(spark, folder):
    return sites(spark, folder)


@query("unmatched_sites", """
SELECT DISTINCT "Area", "Region" FROM placed
WHERE "Region" = 'Region 3' AND "Area" NOT IN (SELECT "PLAID" FROM sites)""")
def unmatched_sites(spark, folder):
    view = cleaning_view(spark, folder)
    zoned = view.stages["placed"].where(F.col("Region") == fixed.ZONED_REGION)
    return unmatched(zoned, view.sites, zoned["Area"] == view.sites["PLAID"], ["Area", "Region"])


@query("sla_verdicts", f"""
SELECT "Priority_Urgency", count(*) AS tickets, sum("SLA_Compliant")::BIGINT AS met,
       {r('max("OUTAGEDURATION") FILTER ("SLA_Compliant" = 1)')} AS longest_met,
       {r('min("OUTAGEDURATION") FILTER ("SLA_Compliant" = 0)')} AS shortest_missed
FROM clean GROUP BY ALL""")
def sla_verdicts(spark, folder):
    met = F.col("SLA_Compliant") == 1
    return clean_view(spark, folder).groupBy("Priority_Urgency").agg(
        F.count("*").alias("tickets"),
        F.sum("SLA_Compliant").alias("met"),
        F.max(F.when(met, F.col("OUTAGEDURATION"))).alias("longest_met"),
        F.min(F.when(~met, F.col("OUTAGEDURATION"))).alias("shortest_missed"),
    )


@query("phase_times", f"""
SELECT "TICKETID", "REPORTDATE", "DISPATCHDATE", "RESOLVEDDATE", {r('"DISPATCH_DELAY_HOURS"')} AS delay,
       {r('"FIELD_TIME_HOURS"')} AS field, "Timestamp_Integrity"
FROM clean""")
def phase_times(spark, folder):
    return clean_view(spark, folder).select(
        "TICKETID", "REPORTDATE", "DISPATCHDATE", "RESOLVEDDATE",
        F.col("DISPATCH_DELAY_HOURS").alias("delay"), F.col("FIELD_TIME_HOURS").alias("field"), "Timestamp_Integrity",
    )


#: Spellings of a moment, and down to what they tell it.
SPELLED = {
    "'yyyy-MM-dd HH:mm:ss'": "second", "concat('yyyy-MM-dd', chr(39), 'T', chr(39), 'HH:mm:ss')": "second", "'yyyy-MM-dd HH:mm:ssXXX'": "second",
    "'yyyy-MM-dd HH:mm'": "minute", "'yyyy-MM-dd HH:mm:ss.0'": "second", "'M/d/yyyy H:mm'": "minute", "'M/d/yyyy'": "day",
    "'yyyy/MM/dd HH:mm'": "minute", "'dd-MMM-yyyy HH:mm'": "minute", "'MMM d, yyyy'": "day", "'yyyyMMdd'": "day", "'M/d/yy H:mm'": "minute",
    "'M/d/yyyy h:mm:ss a'": "second", "'d MMMM yyyy HH:mm'": "minute",
}
_TOLD = " ".join(f"WHEN {form} THEN date_trunc('{unit}', ts)" for form, unit in enumerate(SPELLED.values()))


@query("lenient_parsing", f"""
SELECT event_id, CASE WHEN event_type = 'error' THEN NULL ELSE CASE event_id % {len(SPELLED)} {_TOLD} END END AS moment,
       date_trunc('minute', ts) AS day_first, try_cast(number AS DOUBLE) AS number
FROM (SELECT event_id, event_type, ts,
             CASE WHEN event_type = 'view' THEN 'broken' ELSE CAST(user_id AS VARCHAR) END AS number FROM events)""",
       base=False)
def lenient_parsing(spark, folder):
    """The same moments in many spellings, and in a column whose values show that the day comes first."""
    events = spelled_events(spark, folder)
    return events.select(
        "event_id",
        moments.inferred_moment(events, "text").alias("moment"),
        moments.inferred_moment(events, "european").alias("day_first"),
        service.number_or_missing(F.col("number")).alias("number"),
    )


def spelled_events(spark, folder):
    spelled = " ".join(f"WHEN {form} THEN date_format(ts, {pattern})" for form, pattern in enumerate(SPELLED))
    return table(spark, folder, "events").selectExpr(
        "event_id",
        f"if(event_type = 'error', 'n/a', CASE event_id % {len(SPELLED)} {spelled} END) AS text",
        "date_format(ts, 'd/M/yyyy H:mm') AS european",
        "if(event_type = 'view', 'broken', cast(user_id AS string)) AS number",
    )


@query("moment_spellings", f"""
SELECT CASE WHEN event_type = 'error' THEN 'unread' WHEN form IN (0, 1, 2, 3, 4, 7) THEN 'year first' WHEN form IN (5, 6, 11, 12) THEN 'numbers'
            WHEN form IN (8, 13) THEN 'day and month name' WHEN form = 9 THEN 'month name and day' ELSE 'compact' END AS spelling, count(*) AS rows
FROM (SELECT event_type, event_id % {len(SPELLED)} AS form FROM events) GROUP BY 1""", base=False)
def moment_spellings(spark, folder):
    """How many values of a text column have each spelling, and how many none reads."""
    return moments.spellings(spelled_events(spark, folder), "text")


@query("path_summary", """
SELECT "Resolution_Path", count("TICKETID") AS "Count",
       round_even(avg("OUTAGEDURATION"), 2) AS "Avg_Duration",
       round_even(avg("SLA_Compliant"), 2) AS "SLA_Rate",
       round_even(avg("DISPATCH_DELAY_HOURS"), 2) AS "Avg_Dispatch"
FROM clean GROUP BY ALL""")
def path_summary(spark, folder):
    return cleaning.path_summary(clean_view(spark, folder))


@query("top_sites", """
SELECT "SiteName", count("TICKETID") AS "Tickets", round_even(avg("SLA_Compliant"), 2) AS "SLA_Rate",
       round_even(avg("OUTAGEDURATION"), 2) AS "Avg_Duration", min("Region") AS "Region", min("CITY") AS "City"
FROM clean GROUP BY "SiteName" ORDER BY "Tickets" DESC, "SiteName" LIMIT 100""")
def top_sites(spark, folder):
    return cleaning.top_sites(clean_view(spark, folder), "CITY")


@query("team_names", """
SELECT raw."Issuer Team" AS issuer, raw."WOOwnerGroup" AS owner_group, clean."Issuer_Team" AS issuer_team,
       clean."WOOwnerGroup" AS owner_team, count(*) AS tickets
FROM clean JOIN first_copy AS raw USING ("TICKETID") GROUP BY ALL""")
def team_names(spark, folder):
    rows = cleaning_view(spark, folder).stages["modelled"]
    return rows.groupBy(
        F.col("Issuer Team").alias("issuer"),
        F.col("WOOwnerGroup").alias("owner_group"),
        F.col("Issuer_Team_Normalized").alias("issuer_team"),
        F.col("WOOwnerGroup_Category").alias("owner_team"),
    ).agg(F.count("*").alias("tickets"))


@query("pseudonyms", """
SELECT DISTINCT lead AS "WOLeadName",
       CASE WHEN lead IS NULL THEN 'Unknown' ELSE 'ENG_' || substr(sha256(lead), 1, 8) END AS "WOLeadName_Anonymized"
FROM timed""")
def pseudonyms(spark, folder):
    return cleaning.pseudonym_map(cleaning_view(spark, folder).stages["modelled"], "WOLeadName")


@query("site_names", """
SELECT "SiteName", "Region", "CITY", count(*) AS tickets FROM clean GROUP BY ALL""")
def site_names(spark, folder):
    return clean_view(spark, folder).groupBy("SiteName", "Region", "CITY").agg(F.count("*").alias("tickets"))


@query("region_scope", """
SELECT "Region", "ZONE", count(*) AS tickets FROM clean WHERE "Region" = 'Region 3' GROUP BY ALL""")
def region_scope(spark, folder):
    view = cleaning_view(spark, folder)
    scoped = cleaning_of(view.raw, spark, folder, region_scope="Region 3", infer=False)
    return scoped.clean.groupBy("Region", "ZONE").agg(F.count("*").alias("tickets"))
