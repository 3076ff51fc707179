"""The ticket view and its cleaning as DuckDB common table expressions.

Written on its own, statement by statement; only the fixed values are shared with
the library.
"""

from __future__ import annotations

from outagelens import fixed_values as fixed
from outagelens.sources import star_tickets as view


def q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def values(items) -> str:
    return ", ".join(q(i) if isinstance(i, str) else str(i) for i in items)


def has(text: str, needles) -> str:
    return "(" + " OR ".join(f"contains({text}, {q(n)})" for n in needles) + ")"


def switch(key: str, table: dict) -> str:
    return f"CASE {key} " + " ".join(f"WHEN {q(k)} THEN {q(v)}" for k, v in table.items()) + " END"


def branches(text: str, rules) -> str:
    return " ".join(f"WHEN {has(text, needles)} THEN {q(label)}" for label, needles in rules)


_DESCRIPTION = "CASE " + " ".join(f"WHEN p_size <= {n} THEN {q(t)}" for n, t in view.DESCRIPTION_TEXT)

RAW = f"""
raw AS MATERIALIZED (
  SELECT l_orderkey || '-' || l_linenumber AS "TICKETID",
         o_orderdate AS "REPORTDATE",
         {switch('o_orderstatus', view.STATUS)} AS "FT Status",
         CASE WHEN l_partkey % 53 <> 0 THEN CAST(substr(o_orderpriority, 1, 1) AS DOUBLE) END AS "Priority",
         CAST(l_linenumber % 5 AS DOUBLE) AS "Urgency",
         l_quantity AS "OUTAGEDURATION",
         {switch("split_part(p_name, ' ', 1)", view.CAUSE_TEXT)} AS "RFODescription",
         CASE l_partkey % 10 WHEN 0 THEN 'VIS_OPS' WHEN 1 THEN 'NLZ_FIELD' WHEN 2 THEN NULL
              WHEN 3 THEN 'TEAM_X' ELSE 'GMA_NOC' END AS "ContactGroup",
         CASE l_suppkey % 20 WHEN 18 THEN 'SL' WHEN 19 THEN 'X' ELSE 'NCR' END || l_suppkey AS "Area",
         CASE WHEN p_type = 'PROMO' THEN 'INVALID' ELSE p_type END AS "Fault Type",
         {_DESCRIPTION} ELSE 'service degraded on ' END || p_name || ' ' || lower(p_type) AS "DESCRIPTION",
         {switch("split_part(p_name, ' ', 2)", view.ROOT_CAUSE_TEXT)} AS "RootCause",
         CASE WHEN l_tax < 0.075 THEN o_orderdate + to_minutes(CASE WHEN l_partkey % 41 = 0 THEN -120
              ELSE CAST(round(l_discount * 100) AS BIGINT) * 60 + l_linenumber * 15 END) END AS "StartDateTime",
         CASE WHEN p_brand <> 'Brand#13'
              THEN list_extract([{values(view.EQUIPMENT)}], p_size % (1 + l_suppkey % 8) + 1) END AS "NEType",
         {switch('p_brand', view.ACTION_TEXT)} AS "ActionTaken",
         CASE WHEN l_tax < 0.005 THEN NULL WHEN l_tax < 0.015 THEN 'N/A'
              WHEN o_custkey % 4 = 0 THEN 'SHARED DESK' ELSE 'Operator ' || o_custkey END AS "FT_Owner",
         CASE WHEN l_returnflag <> 'N' THEN 'Lead ' ||
              CASE WHEN l_partkey % 10 = 0 THEN l_partkey % 25 ELSE s_nationkey END END AS "WOLeadName",
         CASE l_partkey % 12 WHEN 0 THEN 'NOC-WLN' WHEN 1 THEN 'CNO GMA' WHEN 2 THEN 'IBS-NEW' WHEN 3 THEN 'N/A'
              WHEN 4 THEN NULL WHEN 5 THEN 'zzz' WHEN 6 THEN 'fo_extra' ELSE 'FO_GMA' END AS "WOOwnerGroup",
         CASE WHEN l_linestatus = 'F' THEN 'NOC-GMA' ELSE CASE l_suppkey % 4 WHEN 0 THEN 'Field_FO_1'
              WHEN 1 THEN 'Customer CARE' WHEN 2 THEN NULL ELSE 'desk' END END AS "Issuer Team",
         l_shipdate, l_partkey, l_suppkey, l_extendedprice, l_discount, l_tax
  FROM lineitem
  JOIN orders ON l_orderkey = o_orderkey
  JOIN part ON l_partkey = p_partkey
  JOIN supplier ON l_suppkey = s_suppkey
),
sites AS (
  SELECT 'NCR' || s_suppkey AS "PLAID", 'ZONE ' || (n_regionkey + 1) AS "AssignArea",
         CASE WHEN n_regionkey = 4 THEN 'CITY OF ' || n_name ELSE n_name END AS "AssignCity"
  FROM supplier JOIN nation ON s_nationkey = n_nationkey
  WHERE s_suppkey % 25 <> 24
)"""

FILTERED = """
first_copy AS MATERIALIZED (
  SELECT * FROM raw
  QUALIFY row_number() OVER (PARTITION BY "TICKETID" ORDER BY l_shipdate, l_partkey, l_suppkey,
                             l_extendedprice, l_discount, l_tax) = 1
),
filtered AS MATERIALIZED (
  SELECT * FROM first_copy
  WHERE "Priority" IS NOT NULL AND "Priority" IN (1, 2, 3) AND "Urgency" IN (0, 1, 2, 3)
    AND "FT Status" IN ('CLOSED', 'RESOLVED', 'PENRESOLVE') AND "Fault Type" IS DISTINCT FROM 'INVALID'
)"""

_SQUEEZE = "trim(regexp_replace(replace(replace({0}, '-', ' '), '_', ' '), '\\s+', ' ', 'g'))"


def squeezed(column: str) -> str:
    return _SQUEEZE.format(column)


_CATEGORY = "CASE " + " ".join(
    f'WHEN upper(trim("NEType")) IN ({values(types)}) THEN {q(category)}'
    for category, types in fixed.NE_CATEGORIES.items()
) + " ELSE 'Other/Unknown' END"

REPAIRED = f"""
texts AS (
  SELECT * REPLACE ({squeezed('"RFODescription"')} AS "RFODescription", {squeezed('"RootCause"')} AS "RootCause",
                    {squeezed('"ActionTaken"')} AS "ActionTaken"),
         {_CATEGORY} AS "NE_Category"
  FROM filtered
),
repaired AS MATERIALIZED (
  SELECT * REPLACE (coalesce("RFODescription", "RootCause", CASE
           WHEN contains(upper("ActionTaken"), 'RECONFIGURED') THEN 'EQUIPMENT-Configuration Problem'
           WHEN contains(upper("ActionTaken"), 'HARDWARE RESET') THEN 'EQUIPMENT-Defective Hardware'
           WHEN contains(upper("ActionTaken"), 'REPLACED') THEN 'EQUIPMENT-Defective Hardware'
           WHEN contains(upper("ActionTaken"), 'SELF RESTORED COMMERCIAL POWER RESUMED') THEN 'FACILITIES-Power Failure'
           WHEN contains(upper("ActionTaken"), 'SPLICED') AND "Urgency" = 1 THEN 'FOC CUT - LINEAR'
           WHEN contains(upper("ActionTaken"), 'SPLICED') THEN 'FOC CUT WITH REDUNDANCY' END) AS "RFODescription")
  FROM texts
)"""

_FIBRE = (
    f"CASE WHEN {has('d', fixed.FIBRE_REDUNDANT_IN_DESCRIPTION)} OR u > 1 THEN 'FOC CUT WITH REDUNDANCY' "
    f"WHEN {has('d', fixed.FIBRE_LINEAR_IN_DESCRIPTION)} OR u = 1 THEN 'FOC CUT - LINEAR' "
    "ELSE 'TRANSMISSION-Fiber Problem' END"
)
CAUSE_CASE = "CASE " + " ".join(
    [f"WHEN c = {q(l.lower().replace('-', ' ').strip())} THEN {q(l)}" for l in fixed.CAUSE_LABELS]
    + [
        "WHEN contains(c, 'invalid') OR contains(c, 'test3') THEN 'Invalid'",
        f"WHEN {has('c', fixed.FIBRE_LINEAR)} OR contains(d, 'single link failure') THEN 'FOC CUT - LINEAR'",
        f"WHEN {has('c', fixed.FIBRE_REDUNDANT)} OR {has('d', fixed.FIBRE_REDUNDANT_IN_DESCRIPTION)} "
        "THEN 'FOC CUT WITH REDUNDANCY'",
        f"WHEN {has('c', fixed.FIBRE_GENERIC)} OR {has('d', fixed.FIBRE_GENERIC_IN_DESCRIPTION)} THEN {_FIBRE}",
        f"WHEN contains(a, 'spliced') THEN {_FIBRE}",
        "WHEN contains(a, 'replaced') OR contains(a, 'hardware reset') THEN 'EQUIPMENT-Defective Hardware'",
        "WHEN contains(a, 'reconfigured') THEN 'EQUIPMENT-Configuration Problem'",
        "WHEN contains(a, 'self restored commercial power resumed') THEN 'FACILITIES-Power Failure'",
        branches("t", fixed.CAUSE_PHRASES.items()),
    ]
    + [
        f"WHEN {has('c', fixed.UNKNOWN_TRIGGERS)} AND {has('d', needles)} THEN {q(label)}"
        for label, needles in fixed.UNKNOWN_PHRASES
    ]
    + [f"WHEN n = {q(k)} THEN {q(v)}" for k, v in fixed.NE_CAUSES.items()]
    + [branches("d", fixed.LAST_PHRASES), "WHEN similarity >= 85 THEN closest ELSE 'Uncategorized' END"]
)

STANDARD = f"""
labels AS (
  SELECT unnest([{values(fixed.CAUSE_LABELS)}]) AS label, unnest(range({len(fixed.CAUSE_LABELS)})) AS place
),
prepared AS MATERIALIZED (
  SELECT *, "RFODescription" AS "Original_RFO",
         trim(replace(lower(coalesce("RFODescription", '')), '-', ' ')) AS c,
         lower(coalesce("ActionTaken", '')) AS a, lower(coalesce("DESCRIPTION", '')) AS d,
         upper(trim(coalesce("NEType", ''))) AS n, "Urgency" AS u,
         trim(replace(lower(coalesce("RFODescription", '')), '-', ' ')) || ' ' || lower(coalesce("RootCause", ''))
           || ' ' || lower(coalesce("ActionTaken", '')) AS t
  FROM repaired
  WHERE "RFODescription" IS DISTINCT FROM 'Invalid' AND "RFODescription" IS DISTINCT FROM 'Uncategorized'
),
closest AS MATERIALIZED (
  SELECT c AS text, label AS closest, similarity FROM (
    SELECT c, label, place, 100 * (1 - levenshtein(c, lower(label)) / greatest(length(c), length(label))) AS similarity
    FROM (SELECT DISTINCT c FROM prepared) CROSS JOIN labels)
  QUALIFY row_number() OVER (PARTITION BY c ORDER BY similarity DESC, place) = 1
),
standard AS MATERIALIZED (
  SELECT prepared.*, {CAUSE_CASE} AS "Standardized RFO"
  FROM prepared JOIN closest ON c = text
),
usable AS (
  SELECT * FROM standard WHERE "Standardized RFO" NOT IN ('Invalid', 'Uncategorized')
)"""

_REGION = "CASE " + " ".join(
    [branches("upper(coalesce(\"ContactGroup\", ''))", fixed.REGION_BY_GROUP),
     branches("upper(coalesce(\"Area\", ''))", fixed.REGION_BY_AREA),
     branches("upper(coalesce(\"DESCRIPTION\", ''))", fixed.REGION_BY_DESCRIPTION)]
) + " ELSE 'Unknown Area' END"

SITED = f"""
placed AS MATERIALIZED (
  SELECT *, {_REGION} AS "Region" FROM usable
),
sited AS MATERIALIZED (
  SELECT placed.*, coalesce(sites."AssignArea", 'Unknown') AS "AssignArea",
         coalesce(sites."AssignCity", 'Unknown') AS "AssignCity"
  FROM placed LEFT JOIN sites ON placed."Area" = sites."PLAID" AND placed."Region" = 'Region 3'
  WHERE placed."Region" <> 'Unknown Area'
)"""

_LIMIT = "CASE tier " + " ".join(f"WHEN {q(k)} THEN {v}" for k, v in fixed.SLA_HOURS.items()) + " ELSE 24 END"
_GROUP = " ".join(f"WHEN g IN ({values(codes)}) THEN {q(label)}" for label, codes in fixed.OWNER_GROUPS.items())
_PREFIX = " ".join(
    "WHEN " + " OR ".join(f"starts_with(upper(g), {q(p)})" for p in prefixes) + f" THEN {q(label)}"
    for label, prefixes in fixed.OWNER_GROUP_PREFIXES
)


def person(column: str) -> str:
    return (
        f"CASE WHEN {column} IS NULL OR {column} = 'Unknown' THEN 'Unknown' "
        f"ELSE 'ENG_' || substr(sha256({column}), 1, 8) END"
    )


CLEAN = f"""
timed AS (
  SELECT *, CAST(CAST("Priority" AS INT) AS VARCHAR) || '.' || CAST(CAST("Urgency" AS INT) AS VARCHAR) AS tier,
         coalesce("StartDateTime", "REPORTDATE") AS started,
         CASE WHEN "FT_Owner" IN ({values(fixed.BLANK_TOKENS)}) THEN NULL ELSE "FT_Owner" END AS owner,
         CASE WHEN "WOLeadName" IN ({values(fixed.BLANK_TOKENS)}) THEN NULL ELSE "WOLeadName" END AS lead,
         trim("WOOwnerGroup") AS g, coalesce(substr(sha256("Area"), 1, 10), 'Unknown') AS place_code
  FROM sited
),
delayed AS (
  SELECT *, epoch_us(started - "REPORTDATE") / 3600000000.0::DOUBLE AS delay,
         CASE WHEN "OUTAGEDURATION" <= {_LIMIT} THEN 1 ELSE 0 END AS met
  FROM timed
),
clean AS MATERIALIZED (
  SELECT "TICKETID", "REPORTDATE", CAST("Priority" AS TINYINT) AS "Priority", CAST("Urgency" AS TINYINT) AS "Urgency",
         tier AS "Priority_Urgency", "OUTAGEDURATION",
         coalesce(substr(sha256("ContactGroup"), 1, 10), 'Unknown') AS "ContactGroup", place_code AS "Area",
         started AS "DISPATCHDATE", "NEType", "NE_Category", "Region", "Standardized RFO",
         "AssignArea" AS "ZONE", "AssignCity" AS "CITY",
         "REPORTDATE" + to_microseconds(CAST("OUTAGEDURATION" * 3600000000 AS BIGINT)) AS "RESOLVEDDATE",
         "OUTAGEDURATION" AS "RESOLUTION_TIME_HOURS", met AS "SLA_Compliant", delay AS "DISPATCH_DELAY_HOURS",
         met * 100.0::DOUBLE AS "SLA_Compliance_Rate", 100.0::DOUBLE - met * 100.0::DOUBLE AS "SLA_Breach_Rate",
         CASE WHEN owner IS NULL THEN 'Auto_Self_Restored' WHEN lead IS NULL THEN 'NOC_Remote_Restored'
              ELSE 'Field_Dispatch_Restored' END AS "Resolution_Path",
         CASE WHEN "Issuer Team" IS NULL THEN 'Unknown' {branches('upper("Issuer Team")', fixed.ISSUER_TEAMS)}
              ELSE 'Other' END AS "Issuer_Team",
         replace("Region", ' ', '') || '_' || "AssignCity" || '_' || substr(place_code, 1, 8) AS "SiteName",
         "OUTAGEDURATION" - delay AS "FIELD_TIME_HOURS",
         ("OUTAGEDURATION" - delay >= 0 AND delay >= 0 AND delay <= "OUTAGEDURATION") AS "Timestamp_Integrity",
         {person('owner')} AS "Engineer_ID", {person('lead')} AS "Field_Lead_ID",
         CASE WHEN g IS NULL OR g IN ({values(fixed.OWNER_GROUP_BLANKS)}) THEN 'Unknown' {_GROUP} {_PREFIX}
              ELSE 'Other' END AS "WOOwnerGroup"
  FROM delayed
),
zoned AS MATERIALIZED (
  SELECT * FROM clean WHERE "ZONE" IN ({values(fixed.ZONE_ORDER)}) AND "Priority" < 4
)"""

BASE = ",".join([RAW, FILTERED, REPAIRED, STANDARD, SITED, CLEAN])


def r(expression: str) -> str:
    """Six decimals, half to even, as a double."""
    return f"round_even(CAST({expression} AS DOUBLE), 6)"
