"""Queries over the general table operators and column functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from outagelens import fixed_values as fixed
from outagelens.functions import service
from outagelens.functions.text import magnitude, month_label, short_site_name, tier_label, truncated
from outagelens.operators.inference import fill_from_text, inference_log, low_confidence, tier_distribution
from outagelens.operators.lookups import cohort_of_top, rows_of_large_groups, with_cohort_flag
from outagelens.operators.quantiles import grouped_quantiles
from outagelens.operators.ranking import (
    average_rank, lorenz, min_max, min_rank, pareto, top_n, top_n_per_group, value_counts, value_ranks,
)
from outagelens.operators.shape import compared, pivot, row_percentages, share_of_parent
from outagelens.plans import kpis, zones
from outagelens.plans.cleaning import audit_extracts
from outagelens.plans.snapshots import extreme_rows
from outagelens.registry import base_sql
from outagelens.registry.base_sql import q, r, values
from outagelens.registry.cleaning import STOP_WORDS
from outagelens.registry.core import query
from outagelens.registry.kpis import SCORECARD
from outagelens.sources.checkpoints import kept, stored
from outagelens.sources.star_tickets import (
    clean_table, cleaning_of, cleaning_view, raw_tickets, table,
)


def zoned(spark, folder):
    return kpis.reactive(clean_table(spark, folder))


# --- counts, shares, pivots ---------------------------------------------------------------

@query("value_counts", f"""
SELECT "NEType", count(*) AS "Count", {r('count(*) / (SELECT count(*) FROM clean WHERE "NEType" IS NOT NULL) * 100')} AS "Pct"
FROM clean WHERE "NEType" IS NOT NULL GROUP BY 1""")
def counts(spark, folder):
    return value_counts(clean_table(spark, folder), "NEType")


@query("value_counts_with_missing", f"""
SELECT "NEType", count(*) AS "Count", {r('count(*) / (SELECT count(*) FROM clean) * 100')} AS "Pct"
FROM clean GROUP BY 1""")
def counts_with_missing(spark, folder):
    return value_counts(clean_table(spark, folder), "NEType", keep_missing=True)


@query("share_of_parent", f"""
, counted AS (SELECT "ZONE", "NE_Category", count(*) AS n FROM clean GROUP BY 1, 2)
SELECT "ZONE", "NE_Category", n AS "Count", (sum(n) OVER (PARTITION BY "ZONE"))::BIGINT AS "Parent_Total",
       {r('n / sum(n) OVER (PARTITION BY "ZONE") * 100')} AS "Pct" FROM counted""")
def shares(spark, folder):
    return share_of_parent(clean_table(spark, folder), ["ZONE"], "NE_Category")


@query("pivot_counts", "SELECT \"ZONE\", " + ", ".join(
    f'count(*) FILTER ("Resolution_Path" = {q(p)}) AS "{p}"' for p in fixed.PATH_ORDER
) + ' FROM clean GROUP BY 1')
def pivot_counts(spark, folder):
    return pivot(clean_table(spark, folder), ["ZONE"], "Resolution_Path", fixed.PATH_ORDER, F.count(F.lit(1)), fill=0)


@query("row_percentages", "SELECT \"ZONE\", " + ", ".join(
    r(f'count(*) FILTER ("Resolution_Path" = {q(p)}) / count(*) * 100') + f' AS "{p}"' for p in fixed.PATH_ORDER
) + ' FROM clean GROUP BY 1')
def percentages(spark, folder):
    wide = pivot(clean_table(spark, folder), ["ZONE"], "Resolution_Path", fixed.PATH_ORDER, F.count(F.lit(1)), fill=0)
    return row_percentages(wide, fixed.PATH_ORDER)


@query("pivot_means", "SELECT \"ZONE\", " + ", ".join(
    r(f'avg("OUTAGEDURATION") FILTER ("Priority_Urgency" = {q(t)})') + f' AS "{t}"' for t in ("1.1", "2.2", "9.9")
) + ' FROM clean GROUP BY 1')
def pivot_means(spark, folder):
    return pivot(
        clean_table(spark, folder), ["ZONE"], "Priority_Urgency", ["1.1", "2.2", "9.9"], F.avg("OUTAGEDURATION")
    )


@query("conditional_shares", f"""
SELECT "ZONE", {r('''avg(("Standardized RFO" = 'UNKNOWN-Under Investigation')::INT) * 100''')} AS unknown_pct,
       count(*) FILTER ("Standardized RFO" = 'UNKNOWN-Under Investigation') AS unknown,
       {r('(1 - avg("SLA_Compliant")) * 100')} AS breach, {r('count(*) / count(DISTINCT "SiteName")')} AS density
FROM zoned GROUP BY 1""")
def conditional_shares(spark, folder):
    unknown = F.col("Standardized RFO") == fixed.UNKNOWN_CAUSE
    return zoned(spark, folder).groupBy("ZONE").agg(
        kpis.share_where(unknown, "unknown_pct"),
        F.count_if(unknown).alias("unknown"),
        kpis.breach_rate().alias("breach"),
        (F.count("*") / F.count_distinct("SiteName")).alias("density"),
    )


@query("large_groups", """
SELECT "TICKETID", "Standardized RFO" FROM clean
QUALIFY count(*) OVER (PARTITION BY "Standardized RFO") >= 500""")
def large_groups(spark, folder):
    rows = clean_table(spark, folder).select("TICKETID", "Standardized RFO")
    return rows_of_large_groups(rows, ["Standardized RFO"], 500)


@query("cohort_flag", """
, top AS (SELECT "SiteName" FROM clean GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 20)
SELECT "TICKETID", "SiteName" IN (SELECT "SiteName" FROM top) AS in_top FROM clean""")
def cohort_flag(spark, folder):
    rows = clean_table(spark, folder).select("TICKETID", "SiteName")
    return with_cohort_flag(rows, cohort_of_top(rows, "SiteName", 20), "SiteName", "in_top").select("TICKETID", "in_top")


@query("compared_cohorts", f"""
SELECT "NE_Category",
       {r('count(*) FILTER ("SLA_Compliant" = 1) / (SELECT count(*) FROM clean WHERE "SLA_Compliant" = 1) * 100')} AS met,
       {r('count(*) FILTER ("SLA_Compliant" = 0) / (SELECT count(*) FROM clean WHERE "SLA_Compliant" = 0) * 100')} AS missed
FROM clean GROUP BY 1""")
def compared_cohorts(spark, folder):
    return compared(clean_table(spark, folder), F.col("SLA_Compliant"), {1: "met", 0: "missed"}, "NE_Category")


@query("union_of_scopes", """
SELECT "TICKETID", "Region" FROM clean WHERE "Region" = 'Region 3'
UNION ALL SELECT "TICKETID", "Region" FROM clean WHERE "Region" <> 'Region 3'""")
def union_of_scopes(spark, folder):
    rows = clean_table(spark, folder).select("Region", "TICKETID")
    zoned_rows, others = rows.where("Region = 'Region 3'"), rows.where("Region <> 'Region 3'")
    return zoned_rows.unionByName(others.select("TICKETID", "Region"))


@query("distinct_places", """SELECT DISTINCT "Region", "ZONE", "CITY" FROM clean""")
def distinct_places(spark, folder):
    return clean_table(spark, folder).select("Region", "ZONE", "CITY").dropDuplicates()


@query("common_categories", """
SELECT "NE_Category" FROM clean WHERE "Resolution_Path" = 'Auto_Self_Restored'
INTERSECT SELECT "NE_Category" FROM clean WHERE "Priority_Urgency" = '1.1'""")
def common_categories(spark, folder):
    rows = clean_table(spark, folder)
    automatic = rows.where(F.col("Resolution_Path") == "Auto_Self_Restored").select("NE_Category")
    return automatic.intersect(rows.where(F.col("Priority_Urgency") == "1.1").select("NE_Category"))


@query("scope_subsets", f"""
SELECT count(*) FILTER ("ZONE" IN ({values(fixed.ZONE_ORDER)}) AND "Priority" < 4) AS reactive,
       count(*) FILTER ("Timestamp_Integrity") AS sound,
       count(*) FILTER ("Resolution_Path" = 'Field_Dispatch_Restored' AND "Timestamp_Integrity") AS dispatched_sound,
       count(*) FILTER ("Priority_Urgency" = '3.2') AS degraded,
       count(*) FILTER ("Standardized RFO" = 'UNKNOWN-Under Investigation') AS unresolved,
       count(*) FILTER ("ZONE" <> 'Unknown') AS zoned,
       count(*) FILTER ("Engineer_ID" <> 'Unknown') AS attributed
FROM clean""")
def scope_subsets(spark, folder):
    out = F.col("Resolution_Path") == "Field_Dispatch_Restored"
    listed = F.col("ZONE").isin(fixed.ZONE_ORDER) & (F.col("Priority") < 4)
    return clean_table(spark, folder).agg(
        F.count_if(listed).alias("reactive"),
        F.count_if("Timestamp_Integrity").alias("sound"),
        F.count_if(out & F.col("Timestamp_Integrity")).alias("dispatched_sound"),
        F.count_if(F.col("Priority_Urgency") == "3.2").alias("degraded"),
        F.count_if(F.col("Standardized RFO") == fixed.UNKNOWN_CAUSE).alias("unresolved"),
        F.count_if(F.col("ZONE") != "Unknown").alias("zoned"),
        F.count_if(F.col("Engineer_ID") != "Unknown").alias("attributed"),
    )


# --- ranks, running sums, extremes ------------------------------------------------------------

@query("top_rows", """
SELECT "TICKETID", "OUTAGEDURATION" FROM clean ORDER BY "OUTAGEDURATION" DESC, "TICKETID" LIMIT 25""")
def top_rows(spark, folder):
    rows = clean_table(spark, folder).select("TICKETID", "OUTAGEDURATION")
    return top_n(rows, [F.desc("OUTAGEDURATION"), F.asc("TICKETID")], 25)


@query("bottom_rows", """
SELECT "TICKETID", "OUTAGEDURATION" FROM clean ORDER BY "OUTAGEDURATION", "TICKETID" LIMIT 25""")
def bottom_rows(spark, folder):
    rows = clean_table(spark, folder).select("TICKETID", "OUTAGEDURATION")
    return top_n(rows, [F.asc("OUTAGEDURATION"), F.asc("TICKETID")], 25)


@query("top_rows_per_zone", """
SELECT "ZONE", "TICKETID", "OUTAGEDURATION",
       row_number() OVER (PARTITION BY "ZONE" ORDER BY "OUTAGEDURATION" DESC, "TICKETID")::INT AS "Rank"
FROM clean QUALIFY "Rank" <= 4""")
def top_rows_per_zone(spark, folder):
    rows = clean_table(spark, folder).select("ZONE", "TICKETID", "OUTAGEDURATION")
    return top_n_per_group(rows, ["ZONE"], [F.desc("OUTAGEDURATION"), F.asc("TICKETID")], 4)


@query("cause_ranks", f"""
, counted AS (SELECT "Standardized RFO", count(*) // 100 AS hundreds, avg("OUTAGEDURATION") AS mttr FROM clean GROUP BY 1)
SELECT "Standardized RFO", hundreds, rank() OVER (ORDER BY hundreds)::INT AS min_rank,
       {r('rank() OVER (ORDER BY hundreds DESC) + (count(*) OVER (PARTITION BY hundreds) - 1) / 2.0')} AS mean_rank,
       {r('(hundreds - min(hundreds) OVER ()) / (max(hundreds) OVER () - min(hundreds) OVER () + 1e-9) * 100')} AS scaled
FROM counted""")
def cause_ranks(spark, folder):
    counted = clean_table(spark, folder).groupBy("Standardized RFO").agg(
        F.floor(F.count("*") / 100).alias("hundreds")
    )
    return counted.withColumns(
        {
            "min_rank": min_rank(F.asc("hundreds")),
            "mean_rank": average_rank(F.desc("hundreds"), F.col("hundreds")),
            "scaled": min_max(F.col("hundreds")),
        }
    )


@query("percentile_ranks", f"""
, customers AS (SELECT c_nationkey, c_custkey, CASE WHEN c_custkey % 9 <> 0 THEN round(c_acctbal / 500) END AS v FROM customer)
SELECT c_custkey, c_nationkey, v AS level,
       {r('''(rank() OVER (PARTITION BY c_nationkey ORDER BY v ASC NULLS LAST)
           + (count(*) OVER (PARTITION BY c_nationkey, v) - 1) / 2.0::DOUBLE)
           / count(*) OVER (PARTITION BY c_nationkey) * 100''')} AS pct_rank
FROM customers""")
def percentile_ranks(spark, folder):
    customers = table(spark, folder, "customer").selectExpr(
        "c_custkey", "c_nationkey", "if(c_custkey % 9 != 0, round(c_acctbal / 500), NULL) AS level"
    )
    return value_ranks(customers, ["c_nationkey"], ["c_custkey"], {"level": "pct_rank"})


@query("site_pareto_all", f"""
, counted AS (SELECT "SiteName", count(*) AS n FROM clean GROUP BY 1)
SELECT "SiteName", n AS "Tickets", row_number() OVER w AS "Rank",
       (sum(n) OVER (w ROWS UNBOUNDED PRECEDING))::BIGINT AS "Running_Count",
       {r('sum(n) OVER (w ROWS UNBOUNDED PRECEDING) / sum(n) OVER () * 100')} AS "Cumulative_Pct"
FROM counted WINDOW w AS (ORDER BY n DESC, "SiteName")""")
def site_pareto_all(spark, folder):
    counted = clean_table(spark, folder).groupBy("SiteName").agg(F.count("*").alias("Tickets"))
    return pareto(counted, [], "SiteName", "Tickets")


@query("site_lorenz", f"""
, counted AS (SELECT "ZONE", "SiteName", count(*) AS n FROM clean GROUP BY 1, 2)
SELECT "ZONE", "SiteName", n AS "Tickets",
       {r('row_number() OVER w / count(*) OVER (PARTITION BY "ZONE")')} AS "Pop_Share",
       {r('sum(n) OVER (w ROWS UNBOUNDED PRECEDING) / sum(n) OVER (PARTITION BY "ZONE")')} AS "Cum_Share"
FROM counted WINDOW w AS (PARTITION BY "ZONE" ORDER BY n, "SiteName")""")
def site_lorenz(spark, folder):
    counted = clean_table(spark, folder).groupBy("ZONE", "SiteName").agg(F.count("*").alias("Tickets"))
    return lorenz(counted, ["ZONE"], "SiteName", "Tickets")


@query("exact_quantiles", f"""
SELECT l_returnflag, {", ".join(r(f'quantile_cont(l_extendedprice, {p})') + f' AS p{int(p * 100)}'
                                for p in (0.25, 0.5, 0.75, 0.8, 0.9, 0.95, 0.99))}
FROM lineitem GROUP BY 1""", base=False)
def exact_quantiles(spark, folder):
    shares = {f"p{int(p * 100)}": p for p in (0.25, 0.5, 0.75, 0.8, 0.9, 0.95, 0.99)}
    return grouped_quantiles(table(spark, folder, "lineitem"), ["l_returnflag"], "l_extendedprice", shares)


@query("zone_extremes", f"""
, z AS (
  SELECT "ZONE", avg("SLA_Compliant") * 100 AS sla, avg("OUTAGEDURATION") AS mttr,
         count("TICKETID") / count(DISTINCT "Area") AS density FROM zoned GROUP BY 1)
(SELECT 'best compliance' AS metric, "ZONE" AS zone, {r('sla')} AS value FROM z ORDER BY sla DESC, "ZONE" DESC LIMIT 1)
UNION ALL (SELECT 'worst compliance', "ZONE", {r('sla')} FROM z ORDER BY sla, "ZONE" LIMIT 1)
UNION ALL (SELECT 'longest repair', "ZONE", {r('mttr')} FROM z ORDER BY mttr DESC, "ZONE" DESC LIMIT 1)
UNION ALL (SELECT 'densest', "ZONE", {r('density')} FROM z ORDER BY density DESC, "ZONE" DESC LIMIT 1)""")
def zone_extremes(spark, folder):
    return extreme_rows(kpis.zone_summary(zoned(spark, folder)), "ZONE", "zone", [
        ("best compliance", "SLA_Compliance_Rate", True), ("worst compliance", "SLA_Compliance_Rate", False),
        ("longest repair", "MTTR", True), ("densest", "Fault_Density", True),
    ])


@query("scorecard_extremes", f"""{SCORECARD}
(SELECT 'leader' AS metric, "ZONE" AS zone, "Composite" AS value FROM shown ORDER BY "Composite" DESC, "ZONE" DESC LIMIT 1)
UNION ALL (SELECT 'last', "ZONE", "Composite" FROM shown ORDER BY "Composite", "ZONE" LIMIT 1)""")
def scorecard_extremes(spark, folder):
    card = zones.scorecard(zoned(spark, folder))
    return extreme_rows(card, "ZONE", "zone", [("leader", "Composite", True), ("last", "Composite", False)])


@query("cause_extremes", f"""
, f AS (SELECT * FROM zoned WHERE "Resolution_Path" = 'Field_Dispatch_Restored' AND "Timestamp_Integrity"),
causes AS (SELECT "Standardized RFO" AS name, avg("FIELD_TIME_HOURS") AS v FROM f GROUP BY 1 HAVING count(*) >= 30),
kinds AS (SELECT "NE_Category" AS name, avg("FIELD_TIME_HOURS") AS v FROM f GROUP BY 1)
(SELECT 'slowest cause' AS metric, name, {r('v')} AS value FROM causes ORDER BY v DESC, name DESC LIMIT 1)
UNION ALL (SELECT 'slowest category', name, {r('v')} FROM kinds ORDER BY v DESC, name DESC LIMIT 1)""")
def cause_extremes(spark, folder):
    from outagelens.plans import paths

    rows = zoned(spark, folder)
    causes = paths.cause_field_time(rows).withColumnRenamed(paths.CAUSE, "cause")
    return extreme_rows(causes, "cause", "name", [("slowest cause", "Avg_Field_Time", True)]).unionByName(
        extreme_rows(paths.category_field_time(rows), "NE_Category", "name", [("slowest category", "Avg_Field_Time", True)])
    )


# --- text and display columns ----------------------------------------------------------------------

@query("display_columns", f"""
SELECT "TICKETID", CASE WHEN length("Standardized RFO") <= 20 THEN "Standardized RFO"
         ELSE substr("Standardized RFO", 1, 17) || '...' END AS short_cause,
       strftime("REPORTDATE", '%b %Y') AS month,
       regexp_replace("SiteName", '^[^_]*_[^_]*_', '') AS site,
       "Priority_Urgency" || ' (' || CASE split_part("Priority_Urgency", '.', 2) WHEN '1' THEN 'Outage'
         WHEN '2' THEN 'Degradation' WHEN '3' THEN 'Mgmt Alarm' ELSE split_part("Priority_Urgency", '.', 2) END || ')' AS tier
FROM clean""")
def display_columns(spark, folder):
    return clean_table(spark, folder).select(
        "TICKETID",
        truncated(F.col("Standardized RFO"), 20).alias("short_cause"),
        month_label(F.col("REPORTDATE")).alias("month"),
        short_site_name(F.col("SiteName")).alias("site"),
        tier_label("Priority_Urgency", fixed.URGENCY_LABELS).alias("tier"),
    )


@query("magnitudes", """
SELECT o_orderkey, CASE WHEN abs(cents) >= 1e9 THEN printf('%.1fB', cents / 1e9)
         WHEN abs(cents) >= 1e6 THEN printf('%.1fM', cents / 1e6)
         WHEN abs(cents) >= 1e3 THEN printf('%.1fK', cents / 1e3) ELSE cents::VARCHAR END AS shown
FROM (SELECT o_orderkey, CAST(floor(o_totalprice * (o_orderkey % 5) * (o_orderkey % 7) * 8) AS BIGINT) AS cents FROM orders)""",
       base=False)
def magnitudes(spark, folder):
    orders = table(spark, folder, "orders").selectExpr(
        "o_orderkey", "cast(floor(o_totalprice * (o_orderkey % 5) * (o_orderkey % 7) * 8) AS bigint) AS cents"
    )
    return orders.select("o_orderkey", magnitude(F.col("cents")).alias("shown"))


# --- text inference -----------------------------------------------------------------------------------

_WORDS = f"""list_filter(string_split(regexp_replace(lower(coalesce(text, '')), '[^a-z0-9]+', ' ', 'g'), ' '),
       lambda w: length(w) > 2 AND NOT list_contains([{values(STOP_WORDS)}], w))"""


def inference_ctes(source: str, x: str = "") -> str:
    """Weights, norms and best category over a source of (id, target, text); x prefixes the table names."""
    return f"""
{x}source AS ({source}),
{x}words AS (SELECT id, target, unnest({_WORDS}) AS term FROM {x}source),
{x}tf AS MATERIALIZED (
  SELECT target IS NOT NULL AS known, coalesce(target, id) AS entity, term, count(*) AS tf
  FROM {x}words GROUP BY 1, 2, 3),
{x}n AS (SELECT count(*) AS n FROM (SELECT DISTINCT known, entity FROM {x}tf)),
{x}df AS (SELECT term, count(*) AS df FROM {x}tf GROUP BY 1),
{x}weight AS MATERIALIZED (
  SELECT known, entity, term, tf * (ln((1 + n) / (1 + df)::DOUBLE) + 1) AS w FROM {x}tf JOIN {x}df USING (term), {x}n),
{x}norm AS (SELECT known, entity, sqrt(sum(w * w)) AS norm FROM {x}weight GROUP BY 1, 2),
{x}dots AS (
  SELECT d.entity AS id, g.entity AS category, sum(d.w * g.w) AS dot
  FROM {x}weight d JOIN {x}weight g ON d.term = g.term AND NOT d.known AND g.known GROUP BY 1, 2),
{x}scores AS (
  SELECT e.id, category, round(dot / (a.norm * b.norm), 9) AS score
  FROM {x}dots e JOIN {x}norm a ON a.entity = e.id AND NOT a.known JOIN {x}norm b ON b.entity = category AND b.known),
{x}best AS (SELECT * FROM {x}scores QUALIFY row_number() OVER (PARTITION BY id ORDER BY score DESC, category) = 1),
{x}found AS MATERIALIZED (
  SELECT entity AS id, coalesce(category, (SELECT min(entity) FROM {x}tf WHERE known)) AS assigned,
         coalesce(score, 0) AS score
  FROM {x}norm LEFT JOIN {x}best b ON b.id = entity WHERE NOT known)"""


DOCUMENTS = """SELECT doc_id::VARCHAR AS id, quality::VARCHAR AS target, text
  FROM documents LEFT JOIN labels USING (doc_id)"""
TIER_SQL = """CASE WHEN score >= 0.40 THEN 'high' WHEN score >= 0.28 THEN 'medium'
         WHEN score >= 0.15 THEN 'low' ELSE 'very_low' END"""


def labelled_documents(spark, folder):
    documents = table(spark, folder, "documents")
    joined = documents.join(table(spark, folder, "labels"), "doc_id", "left")
    return joined.select(
        F.col("doc_id").cast("string").alias("doc_id"), F.col("quality").cast("string").alias("quality"), "text"
    )


def kept_counts(df):
    return stored(df, "term-counts")


def document_counts(spark, folder):
    """Stores the counts, and the term table, of the documents once in a session; its queries share them."""
    return lambda df: kept(spark, folder, f"documents by {' '.join(df.columns)}", lambda: kept_counts(df))


def document_log(spark, folder):
    """Stored once in a session: several queries read it."""
    def make():
        documents = labelled_documents(spark, folder)
        return stored(inference_log(documents, "doc_id", "quality", "text", STOP_WORDS, document_counts(spark, folder)), "document-log")

    return kept(spark, folder, "document-log", make)


@query("text_inference", f"""
WITH {inference_ctes(DOCUMENTS)}
SELECT id AS doc_id, assigned AS "Raw Inferred Value", {r('score')} AS "Similarity_Score", {TIER_SQL} AS "Confidence"
FROM found""", base=False)
def text_inference(spark, folder):
    return document_log(spark, folder)


@query("text_fill", f"""
WITH {inference_ctes(DOCUMENTS)}
SELECT source.id AS doc_id, coalesce(target, assigned) AS quality FROM source LEFT JOIN found USING (id)""", base=False)
def text_fill(spark, folder):
    documents = labelled_documents(spark, folder)
    filled = fill_from_text(documents, "doc_id", "quality", "text", "0", STOP_WORDS, document_counts(spark, folder))
    return filled.select("doc_id", "quality")


@query("confidence_tiers", f"""
WITH {inference_ctes(DOCUMENTS)}
SELECT {TIER_SQL} AS "Confidence", count(*) AS "Count" FROM found GROUP BY 1""", base=False)
def confidence_tiers(spark, folder):
    return tier_distribution(document_log(spark, folder))


@query("low_confidence", f"""
WITH {inference_ctes(DOCUMENTS)}
SELECT id AS doc_id, {r('score')} AS "Similarity_Score" FROM found WHERE score < 0.28""", base=False)
def low_confidence_rows(spark, folder):
    return low_confidence(document_log(spark, folder)).select("doc_id", "Similarity_Score")


TICKETS = """SELECT "TICKETID" AS id, "NEType" AS target, "DESCRIPTION" AS text FROM filtered"""


@query("equipment_inference", f"""
, {inference_ctes(TICKETS)}
SELECT id AS "TICKETID", assigned AS "Raw Inferred Value", {r('score')} AS "Similarity_Score",
       {TIER_SQL} AS "Confidence" FROM found""")
def equipment_inference(spark, folder):
    rows = cleaning_view(spark, folder).stages["filtered"]
    return inference_log(rows, "TICKETID", "NEType", "DESCRIPTION", STOP_WORDS, kept_counts)


TYPED = """
typed AS MATERIALIZED (
  SELECT filtered.* REPLACE (coalesce("NEType", assigned) AS "NEType")
  FROM filtered LEFT JOIN t_found ON id = "TICKETID")"""
CAUSED = """
caused AS MATERIALIZED (
  SELECT repaired.* REPLACE (coalesce("RFODescription", assigned) AS "RFODescription")
  FROM repaired LEFT JOIN c_found ON id = "TICKETID")"""
CAUSES = """SELECT "TICKETID" AS id, "RFODescription" AS target, "DESCRIPTION" AS text FROM repaired"""


INFERRED = [
    base_sql.RAW, base_sql.FILTERED, inference_ctes(TICKETS, "t_"), TYPED,
    base_sql.REPAIRED.replace("FROM filtered", "FROM typed"), inference_ctes(CAUSES, "c_"), CAUSED,
    base_sql.STANDARD.replace("FROM repaired", "FROM caused"),
]


def inferred_cleaning(spark, folder):
    """The cleaning plan with both inferences, through its default entry, built once in a session."""
    return kept(spark, folder, "inferred-cleaning", lambda: cleaning_of(
        raw_tickets(spark, folder), spark, folder, stop_words=STOP_WORDS
    ))


@query("unknown_cause_scores", "WITH " + ",".join(INFERRED) + f"""
SELECT "TICKETID", "RFODescription", "Urgency", "NEType", {r('score')} AS "Similarity_Score"
FROM standard LEFT JOIN c_found ON id = "TICKETID"
WHERE "Standardized RFO" = 'UNKNOWN-Under Investigation'""", base=False)
def unknown_cause_scores(spark, folder):
    """The audit of tickets whose cause stays unknown, with the score of an inferred one."""
    audits = audit_extracts(inferred_cleaning(spark, folder))
    return audits["unknown_rfo_analysis"].select("TICKETID", "RFODescription", "Urgency", "NEType", "Similarity_Score")


@query("clean_tickets_inferred", "WITH " + ",".join([*INFERRED, base_sql.SITED, base_sql.CLEAN]) + f"""
SELECT * REPLACE ({r('"DISPATCH_DELAY_HOURS"')} AS "DISPATCH_DELAY_HOURS",
                  {r('"FIELD_TIME_HOURS"')} AS "FIELD_TIME_HOURS")
FROM clean""", base=False)
def clean_tickets_inferred(spark, folder):
    """All 26 steps with both text inferences; the stages that branches share are stored."""
    return inferred_cleaning(spark, folder).clean


@query("sla_tiers", f"""
SELECT "Priority_Urgency", {r('''CASE WHEN "Priority_Urgency" LIKE '1.%' AND "Priority_Urgency" <> '1.0' THEN 3
       WHEN "Priority_Urgency" LIKE '2.%' AND "Priority_Urgency" <> '2.0' THEN 6 WHEN "Priority_Urgency" = '3.1' THEN 9
       WHEN "Priority_Urgency" = '3.2' THEN 12 ELSE 24 END''')} AS hours, count(*) AS tickets
FROM clean GROUP BY 1""")
def sla_tiers(spark, folder):
    counted = clean_table(spark, folder).groupBy("Priority_Urgency").agg(F.count("*").alias("tickets"))
    return counted.withColumn("hours", service.sla_hours("Priority_Urgency").cast("double"))
