import os
import sys
from datetime import datetime, timedelta

import pytest

sys.path.insert(0, os.path.abspath(os.path.join(os.path.dirname(__file__), "..")))

from bench import local_session  # noqa: E402
from outagelens import fixed_values as fixed  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    return local_session("8")


#: Three kinds of clean ticket, each at the edge of a rule.
#: ZONE 4: exactly at its 3 hours; ZONE 2: a quarter of an hour over its 6, all of it before dispatch;
#: ZONE 5: dispatched at once, within the hours of a tier near the end of the list.
CLEAN_KINDS = [
    dict(zone="ZONE 4", city="TAGUIG", area="TAG-7", tickets=7, priority=1, urgency=3, hours=3.0, delay=0.25, met=1,
         ne="BTS", category="Access", cause="EQUIPMENT-Software Problem", path=fixed.PATH_ORDER[2], team="Field Operations"),
    dict(zone="ZONE 2", city="MANILA", area="MNL-3", tickets=11, priority=2, urgency=1, hours=6.25, delay=6.25, met=0,
         ne="DWDM", category="Transport", cause="TRANSMISSION-Cable Problem", path=fixed.PATH_ORDER[1], team="NOC"),
    dict(zone="ZONE 5", city="CAINTA", area="RIZ-1", tickets=4, priority=3, urgency=2, hours=12.0, delay=0.0, met=1,
         ne="MSAN", category="Access", cause="OTHERS-Force Majeure", path=fixed.PATH_ORDER[0], team="Unknown"),
]


@pytest.fixture(scope="session")
def sample_clean(spark):
    """22 clean tickets of the three kinds; ids are TK, the zone's number and a running number."""
    rows = []
    for kind in CLEAN_KINDS:
        for k in range(kind["tickets"]):
            rows.append((
                f"TK{kind['zone'][-1]}{k:02d}", datetime(2023, 11, 5, 22) + timedelta(minutes=95 * len(rows)),
                kind["priority"], kind["urgency"], f"{kind['priority']}.{kind['urgency']}", kind["hours"], kind["hours"],
                kind["met"], 100.0 * kind["met"], 100.0 - 100.0 * kind["met"], kind["delay"], kind["hours"] - kind["delay"], True,
                kind["zone"], kind["city"], "Region 3", kind["area"], kind["ne"], kind["category"], kind["cause"], kind["path"], kind["team"],
            ))
    return spark.createDataFrame(
        rows,
        "TICKETID string, REPORTDATE timestamp, Priority tinyint, Urgency tinyint, Priority_Urgency string, "
        "OUTAGEDURATION double, RESOLUTION_TIME_HOURS double, SLA_Compliant int, SLA_Compliance_Rate double, "
        "SLA_Breach_Rate double, DISPATCH_DELAY_HOURS double, FIELD_TIME_HOURS double, Timestamp_Integrity boolean, "
        "ZONE string, CITY string, Region string, Area string, NEType string, NE_Category string, "
        "`Standardized RFO` string, Resolution_Path string, WOOwnerGroup string",
    )


#: What a raw ticket says unless its own line says otherwise.
PLAIN_TICKET = {
    "REPORTDATE": "2023-11-05 22:10:00", "Priority": 2.0, "Urgency": 1.0, "FT Status": "RESOLVED", "Fault Type": "PROACTIVE",
    "OUTAGEDURATION": 4.5, "RFODescription": "genset failure - low fuel", "RootCause": None, "ActionTaken": "refuelled",
    "ContactGroup": "GMA-EAST", "Area": "TAG-7", "DESCRIPTION": "no commercial supply at the shelter", "NEType": "BTS",
    "StartDateTime": "2023-11-05 22:40:00", "FT_Owner": "Ana Cruz", "WOLeadName": "Ben Reyes", "Issuer Team": "NOC-EAST",
}
RAW_LINES = {
    "W01": dict(Priority=1.0, RFODescription="Fiber_cut along the road", OUTAGEDURATION=3.0),
    "W02": dict(WOLeadName=None),
    "W03": dict(Area="QZN-9", FT_Owner=None, WOLeadName=None),
    "W04": dict(NEType=None, Area="MNL-3"),
    "W05": dict(RFODescription=None, RootCause=None, ActionTaken="spliced 2 cores", Urgency=2.0),
    "W06": dict(StartDateTime="2023-11-05 21:40:00"),
    "W07": dict(Priority=3.0, Urgency=2.0, **{"FT Status": "PENRESOLVE"}),
    "X01": dict(Priority=None),
    "X02": dict(Priority=4.0),
    "X03": dict(Urgency=4.0),
    "X04": dict(Urgency=None),
    "X05": {"FT Status": "INPROG"},
    "X06": {"Fault Type": "INVALID"},
}


@pytest.fixture(scope="session")
def sample_raw(spark):
    """13 raw tickets: W01 to W07 pass the filters, each X fails one of them."""
    kinds = {name: "double" if isinstance(value, float) else "string" for name, value in PLAIN_TICKET.items()}
    schema = "TICKETID string, " + ", ".join(f"`{name}` {kind}" for name, kind in kinds.items())
    return spark.createDataFrame([(key, *(PLAIN_TICKET | own).values()) for key, own in RAW_LINES.items()], schema)


@pytest.fixture(scope="session")
def sample_sites(spark):
    """TAG-7 and MNL-3 are registered, QZN-9 is not."""
    return spark.createDataFrame(
        [("MNL-3", "ZONE 2", "MANILA"), ("TAG-7", "ZONE 4", "TAGUIG")],
        "PLAID string, AssignArea string, AssignCity string",
    )
