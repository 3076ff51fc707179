"""Schemas of the stored tables."""

from __future__ import annotations

from pyspark.sql import types as T


def _table(*columns: tuple[str, T.DataType]) -> T.StructType:
    return T.StructType([T.StructField(name, kind, True) for name, kind in columns])


# Number and time columns of the raw file stay text; cleaning reads them leniently.
RAW_TICKETS = _table(
    ("TICKETID", T.StringType()),
    ("REPORTDATE", T.StringType()),
    ("FT Status", T.StringType()),
    ("Priority", T.DoubleType()),
    ("Urgency", T.StringType()),
    ("OUTAGEDURATION", T.StringType()),
    ("RFODescription", T.StringType()),
    ("ContactGroup", T.StringType()),
    ("Area", T.StringType()),
    ("Fault Type", T.StringType()),
    ("DESCRIPTION", T.StringType()),
    ("RootCause", T.StringType()),
    ("StartDateTime", T.StringType()),
    ("NEType", T.StringType()),
    ("ActionTaken", T.StringType()),
)

SITES = _table(("PLAID", T.StringType()), ("AssignArea", T.StringType()), ("AssignCity", T.StringType()))

CLEAN_TICKETS = _table(
    ("TICKETID", T.StringType()),
    ("REPORTDATE", T.TimestampType()),
    ("Priority", T.ByteType()),
    ("Urgency", T.ByteType()),
    ("Priority_Urgency", T.StringType()),
    ("OUTAGEDURATION", T.DoubleType()),
    ("ContactGroup", T.StringType()),
    ("Area", T.StringType()),
    ("DISPATCHDATE", T.TimestampType()),
    ("NEType", T.StringType()),
    ("NE_Category", T.StringType()),
    ("Region", T.StringType()),
    ("Standardized RFO", T.StringType()),
    ("ZONE", T.StringType()),
    ("CITY", T.StringType()),
    ("RESOLVEDDATE", T.TimestampType()),
    ("RESOLUTION_TIME_HOURS", T.DoubleType()),
    ("SLA_Compliant", T.IntegerType()),
    ("DISPATCH_DELAY_HOURS", T.DoubleType()),
    ("SLA_Compliance_Rate", T.DoubleType()),
    ("SLA_Breach_Rate", T.DoubleType()),
    ("Resolution_Path", T.StringType()),
    ("Issuer_Team", T.StringType()),
    ("SiteName", T.StringType()),
    ("FIELD_TIME_HOURS", T.DoubleType()),
    ("Timestamp_Integrity", T.BooleanType()),
    ("Engineer_ID", T.StringType()),
    ("Field_Lead_ID", T.StringType()),
    ("WOOwnerGroup", T.StringType()),
)
