"""Fixed values of the ticket domain.

Everything here is data: word lists, lookup tables, thresholds and formats that
results must agree on.  Order matters wherever "first match wins".
"""

# --- Fixed values: canonical orders -----------------------------------------

REGION_ORDER = ["Region 1", "Region 2", "Region 3", "Region 4", "Region 5"]
ZONE_ORDER = ["ZONE 1", "ZONE 2", "ZONE 3", "ZONE 4", "ZONE 5", "ZONE 6"]
TIER_ORDER = ["P1.1", "P1.2", "P1.3", "P2.1", "P2.2", "P2.3", "P3.1", "P3.2", "P3.3"]
PATH_ORDER = ["Auto_Self_Restored", "NOC_Remote_Restored", "Field_Dispatch_Restored"]

# --- Fixed values: service-level thresholds in hours ---------------------------

SLA_HOURS = {
    "1-1": 3, "1-2": 3, "1-3": 3,
    "2-1": 6, "2-2": 6, "2-3": 6,
    "3-1": 9, "3-2": 12, "3-3": 24,
    "4-1": 72, "4-2": 72, "4-3": 72,
    "1.1": 3, "1.2": 3, "1.3": 3,
    "2.1": 6, "2.2": 6, "2.3": 6,
    "3.1": 9, "3.2": 12, "3.3": 24,
    "4.1": 72, "4.2": 72, "4.3": 72,
}
SLA_DEFAULT_HOURS = 24

# --- Fixed values: column contract and accepted domains -------------------------

REQUIRED_COLUMNS = [
    "TICKETID", "REPORTDATE", "FT Status", "Priority", "Urgency",
    "OUTAGEDURATION", "RFODescription", "ContactGroup", "Area",
    "Fault Type", "DESCRIPTION", "RootCause", "StartDateTime",
    "NEType", "ActionTaken",
]
SITE_COLUMNS = ["PLAID", "AssignArea", "AssignCity"]
KEPT_PRIORITIES = [1, 2, 3]
KEPT_URGENCIES = [0, 1, 2, 3]
KEPT_STATUSES = ["CLOSED", "RESOLVED", "PENRESOLVE"]
REPORTED_PRIORITIES = [1, 2, 3, 4]
REPORTED_STATUSES = ["CLOSED", "RESOLVED", "PENRESOLVE", "CANCELLED", "INPROG"]
SNAPSHOT_COLUMNS = ["TICKETID", "Priority", "Urgency", "FT Status", "Fault Type", "NEType", "RFODescription"]
# Cell texts of a delimited file that stand for a missing value.
MISSING_MARKERS = [
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
]
# Month names in dates.
MONTHS = [
    "january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november",
    "december",
]
BLANK_TOKENS = ["", " ", "N/A", "NA", "None", "NONE", "null", "NULL"]
PERSONNEL_COLUMNS = [
    "FT_OwnerID", "FT_reportedById", "WOOwnerID", "WOLeadID", "CHANGEBY",
    "FT_Owner", "WOLeadName", "FT_ReportedByName", "Cleared By", "Assigned To",
    "SUPERVISOR", "WOOwnerGroup",
]

# --- Fixed values: cause vocabulary ---------------------------------------------

CAUSE_LABELS = [
    "FOC CUT - LINEAR",
    "FOC CUT WITH REDUNDANCY",
    "ADMIN-Lessor Related Cause",
    "EQUIPMENT-Configuration Problem",
    "EQUIPMENT-Decommissioned",
    "EQUIPMENT-Defective Hardware",
    "EQUIPMENT-Software Problem",
    "FACILITIES-Cooling System Problem",
    "FACILITIES-Design Problem",
    "FACILITIES-Monitoring Equipment Problem",
    "FACILITIES-Power Failure",
    "FACILITIES-Water Seepage",
    "OTHERS-Force Majeure",
    "OTHERS-Preventive Maintenance",
    "OTHERS-Security Breach",
    "THIRD PARTY-Activity Related",
    "THIRD PARTY-POI",
    "TRANSMISSION-Cable Problem",
    "TRANSMISSION-Capacity Problem",
    "TRANSMISSION-Equipment Problem",
    "TRANSMISSION-Fiber Problem",
    "TRANSMISSION-IP Network Problem",
    "TRANSMISSION-Microwave Antenna System Problem",
    "TRANSMISSION-Offnetwork",
    "UNKNOWN-Under Investigation",
    "Invalid",
]
UNKNOWN_CAUSE = "UNKNOWN-Under Investigation"
FIBRE_CAUSES = ["FOC CUT - LINEAR", "FOC CUT WITH REDUNDANCY", "TRANSMISSION-Fiber Problem"]
FUZZY_THRESHOLD = 85

# --- Fixed values: equipment type -> category -------------------------------------

NE_CATEGORIES = {
    "Access": [
        "CELL", "BTS", "NODEB", "ENODEB", "GNODEB", "GPON", "MSAN",
        "AN", "ANTENNA", "2G REPEATER", "HYBRID_A", "HYBRID_B",
    ],
    "Transport": ["SDH_MUX", "SDH MUX", "SDH_RADIO", "PDH", "DWDM", "MW"],
    "Core Network": [
        "MSS", "MGW", "USN", "BSC", "RNC", "CGNAT", "GGSN",
        "MCO", "VCGW", "ASR", "AG", "ESS",
    ],
    "IP/Network Infra": [
        "ROUTER", "PE_ROUTER", "P_ROUTER", "SWITCH", "FIREWALL",
        "L7_FIREWALL", "SBC", "BNG", "GEOROAM",
    ],
    "Data Services": [
        "AAA", "PCRF", "DMS", "HSS", "SPG", "USCDB",
        "SEC_GW", "WLN DHCP", "CSCF", "SCP",
    ],
    "Network Management": ["NMS", "SERVER", "UAC", "CGPOMU"],
    "Power/Infra": ["POWER FACILITY", "ATS"],
    "Other/Unknown": ["UNKNOWN"],
}
NE_DEFAULT_CATEGORY = "Other/Unknown"
CORE_CATEGORIES = ["Core Network", "IP/Network Infra", "IP Network Infra"]

# --- Fixed values: equipment type -> cause, when no text decides --------------------

NE_CAUSES = {
    "CELL": "EQUIPMENT-Defective Hardware",
    "BTS": "EQUIPMENT-Defective Hardware",
    "NODEB": "EQUIPMENT-Defective Hardware",
    "ENODEB": "EQUIPMENT-Defective Hardware",
    "GNODEB": "EQUIPMENT-Defective Hardware",
    "DWDM": "TRANSMISSION-Equipment Problem",
    "SDH_MUX": "TRANSMISSION-Equipment Problem",
    "SDH_RADIO": "TRANSMISSION-Fiber Problem",
    "MW": "TRANSMISSION-Fiber Problem",
    "MSAN": "TRANSMISSION-Fiber Problem",
    "GPON": "TRANSMISSION-Fiber Problem",
    "AG": "TRANSMISSION-Fiber Problem",
    "ROUTER": "TRANSMISSION-IP Network Problem",
    "PE_ROUTER": "TRANSMISSION-IP Network Problem",
    "POWER FACILITY": "FACILITIES-Power Failure",
    "ATS": "FACILITIES-Power Failure",
    "HYBRID_B": "UNKNOWN-Under Investigation",
}

# --- Fixed values: fibre phrases -----------------------------------------------------

FIBRE_LINEAR = [
    "foc cut linear", "foc cut  linear", "single fiber cut", "fiber optic cut linear",
    "transmission foc cut", "spliced linear", "fiber break linear", "single link failure",
]
FIBRE_REDUNDANT = [
    "foc cut with redundancy", "foc cut  redundancy", "multiple fiber cut",
    "redundant link failure", "foc cut protected", "spliced redundancy",
    "multiple access link failure",
]
FIBRE_GENERIC = [
    "pfocn fiber", "others animal problem", "transmission foc cut burnt cable",
    "foc cut multiple cut", "transmission foc cut electrical discharge",
    "transmission foc cut fiber was dragged by vehicle", "transmission foc cut intentional cut",
    "transmission foc cut lashing wire", "transmission foc cut other telco",
    "transmission foc cut rat bites", "transmission foc cut road construction",
    "transmission foc cut submarine cut", "transmission foc cut tree fallen",
    "transmission foc cut tree trimming", "transmission foc cut vehicular accident",
    "transmission foc cut animal problem", "fbc", "fiber break", "fiber cut",
    "foc issue", "fiber optic issue", "fiber problem",
]
FIBRE_LINEAR_IN_DESCRIPTION = ["single link failure"]
FIBRE_REDUNDANT_IN_DESCRIPTION = ["multiple access link failure", "redundant link"]
FIBRE_GENERIC_IN_DESCRIPTION = ["fiber optic", "fiber issue", "foc problem"]

# --- Fixed values: cause phrases, in matching order -----------------------------------

INVALID_PHRASES = ["invalid", "test3"]

CAUSE_PHRASES = {
    "FOC CUT - LINEAR": FIBRE_LINEAR + ["single fiber outage", "linear fiber break"],
    "FOC CUT WITH REDUNDANCY": FIBRE_REDUNDANT + ["redundant fiber outage", "multiple fiber break"],
    "ADMIN-Lessor Related Cause": [
        "site access restriction", "community opposition", "extortion", "genset noise",
        "unsettled electric bill", "late payment", "unendorsed site utility notification form",
        "lessor lease issue", "non renewal of contract", "billing issue", "swat site",
        "prime site genset rest", "access restriction lessor", "lessor", "admin", "contract",
        "site access", "lease dispute", "landlord issue", "access denied",
    ],
    "EQUIPMENT-Configuration Problem": [
        "configuration", "reconfigured", "config", "misconfiguration", "config error", "setting issue",
    ],
    "EQUIPMENT-Decommissioned": [
        "decomissioned", "decommissioned", "to be decommissioned", "site shutdown",
    ],
    "EQUIPMENT-Defective Hardware": [
        "ops advance", "equipment antenna", "equipment cable", "card module", "equipment connector",
        "equipment design", "equipment port", "ht rru", "replaced", "hardware reset",
        "antenna system problem", "loose defective connector", "card failure", "module failure",
        "defective", "bts antenna", "antenna", "hardware failure", "equipment failure",
        "faulty hardware", "device failure", "rru issue",
    ],
    "EQUIPMENT-Software Problem": [
        "software", "software conflict", "card level software", "firmware issue",
        "software bug", "software crash",
    ],
    "FACILITIES-Cooling System Problem": [
        "cooling", "aircon", "temperature", "ac unit failure", "cooling failure",
    ],
    "FACILITIES-Design Problem": ["facilities design", "design issue", "infrastructure design"],
    "FACILITIES-Monitoring Equipment Problem": [
        "rms", "monitoring", "monitoring failure", "sensor issue",
    ],
    "FACILITIES-Power Failure": [
        "facilities cable", "power", "facilities connector", "ats", "rectifier",
        "ac mains failure", "batteries", "self restored commercial power resumed",
        "power outage", "dc under voltage alarm", "power supply abnormal", "spd fault alarm",
        "dc breaker tripped", "genset failure", "power supply issue", "power loss",
        "battery failure", "power disruption", "mains failure", "commercial power fluctuation",
    ],
    "FACILITIES-Water Seepage": ["facilities water", "water seepage", "leak", "flooding"],
    "OTHERS-Force Majeure": [
        "force", "force majeure", "natural disaster", "typhoon", "earthquake", "flood",
    ],
    "Invalid": ["invalid", "test3"],
    "OTHERS-Preventive Maintenance": [
        "preventive maintenance", "pm", "scheduled maintenance", "routine maintenance",
    ],
    "OTHERS-Security Breach": [
        "security", "sabotage", "pilferage", "theft", "unauthorized access", "vandalism",
    ],
    "THIRD PARTY-Activity Related": [
        "activity", "endorsed activity", "activity related", "activity triggered",
        "unendorsed activity", "third party activity", "construction activity", "road work",
    ],
    "THIRD PARTY-POI": ["last mile", "poi", "point of interconnect", "third party interconnect"],
    "TRANSMISSION-Cable Problem": [
        "transmission cable", "transmission connector", "cable issue", "cable damage",
    ],
    "TRANSMISSION-Capacity Problem": [
        "transmission capacity", "capacity issue", "congested", "congestion",
    ],
    "TRANSMISSION-Equipment Problem": [
        "transmission card module", "transmission port problem", "port problem", "transmission design",
    ],
    "TRANSMISSION-IP Network Problem": [
        "ip network", "logical trail", "ip issue", "network connectivity",
        "connectivity issue", "link down", "network outage",
    ],
    "TRANSMISSION-Microwave Antenna System Problem": [
        "transmission microwave", "transmission rf", "microwave issue", "microwave failure",
    ],
    "TRANSMISSION-Offnetwork": ["offnetwork", "off network"],
    "TRANSMISSION-Fiber Problem": [
        "odf", "high loss", "kinked fiber", "foc high loss", "tt",
        "fiber degradation", "fiber attenuation",
    ],
    "UNKNOWN-Under Investigation": [
        "inquiry", "unknown", "bau open", "under investigation",
        "work in progress", "self restored under investigation", "tba",
    ],
}

# --- Fixed values: description phrases for causes recorded as unknown -------------------

UNKNOWN_TRIGGERS = ["others complaint", "unknown under investigation", "unknown"]
UNKNOWN_PHRASES = [
    ("TRANSMISSION-IP Network Problem", ["communication with the device failed", "device unreachable"]),
    ("FACILITIES-Power Failure", [
        "ac mains failure", "dc under voltage", "power supply issue", "power outage", "genset failure",
    ]),
    ("ADMIN-Lessor Related Cause", ["ne is disconnected", "site access"]),
    ("TRANSMISSION-IP Network Problem", ["site connectivity", "link down", "connectivity issue", "network drop"]),
    ("EQUIPMENT-Defective Hardware", ["equipment failure", "hardware issue", "rru issue", "module failure"]),
    ("EQUIPMENT-Configuration Problem", ["configuration", "misconfiguration", "config error"]),
    ("FACILITIES-Cooling System Problem", ["cooling", "aircon failure", "temperature issue"]),
    ("FACILITIES-Water Seepage", ["water seepage", "leak", "flooding"]),
    ("THIRD PARTY-Activity Related", ["construction", "road work", "third party activity"]),
]

# --- Fixed values: last description scan before the fuzzy match ---------------------------

LAST_PHRASES = [
    ("FACILITIES-Power Failure", ["power", "battery", "genset", "rectifier"]),
    ("TRANSMISSION-Fiber Problem", ["fiber", "foc", "optic", "cable"]),
    ("EQUIPMENT-Defective Hardware", ["hardware", "equipment", "module", "card"]),
]

# --- Fixed values: action text that decides a cause -----------------------------------------

ACTION_CAUSES = [
    ("EQUIPMENT-Defective Hardware", ["replaced", "hardware reset"]),
    ("EQUIPMENT-Configuration Problem", ["reconfigured"]),
    ("FACILITIES-Power Failure", ["self restored commercial power resumed"]),
]
# Back-fill of a blank cause from the action text; the last listed match wins.
ACTION_BACKFILL = [
    ("SELF RESTORED COMMERCIAL POWER RESUMED", "FACILITIES-Power Failure"),
    ("REPLACED", "EQUIPMENT-Defective Hardware"),
    ("HARDWARE RESET", "EQUIPMENT-Defective Hardware"),
    ("RECONFIGURED", "EQUIPMENT-Configuration Problem"),
]

# --- Fixed values: region codes, in matching order --------------------------------------------

REGION_BY_GROUP = [
    ("Region 4", ["VIS"]),
    ("Region 1", ["NLZ"]),
    ("Region 2", ["SLZ"]),
    ("Region 3", ["GMA", "ALL"]),
    ("Region 5", ["MIN"]),
]
REGION_BY_AREA = [
    ("Region 3", ["NCR"]),
    ("Region 1", ["NL"]),
    ("Region 2", ["SL"]),
    ("Region 4", ["VIS"]),
    ("Region 5", ["MIN"]),
]
REGION_BY_DESCRIPTION = [
    ("Region 1", ["NLZ", "DUN", "SCS", "RXS", "CBN", "TRL", "BTN", "MABINIST"]),
    ("Region 2", ["SLZ", "BTY", "MAS", "GNR", "CMO", "NSB", "NSG", "AUA"]),
    ("Region 3", ["GMA", "NCR", "SJN", "VALERO", "BAC", "CLC", "MLB", "QCY", "ERM", "DELPAN"]),
    ("Region 4", ["DUM", "LHG", "VIZ", "LAHUG", "TLS", "ORM", "TABON", "CDZ", "JMB", "KALIBO", "BCD"]),
    ("Region 5", ["SURIG", "CDO", "ILG", "ILI", "DVO", "DAPITAN", "GEN", "TAGUM"]),
]
UNKNOWN_REGION = "Unknown Area"
ZONED_REGION = "Region 3"

# --- Fixed values: administrative code -> region number -> operational region ---------------------

ADMIN_CODE_TO_NUMBER = {
    "100000000": 1, "200000000": 2, "300000000": 3, "400000000": 4,
    "500000000": 5, "600000000": 6, "700000000": 7, "800000000": 8,
    "900000000": 9, "1000000000": 10, "1100000000": 11, "1200000000": 12,
    "1300000000": 13, "1400000000": 14, "1600000000": 15, "1700000000": 16,
    "1900000000": 17,
}
REGION_NUMBERS = {
    "Region 1": [1, 2, 14, 3],
    "Region 2": [4, 5, 16],
    "Region 3": [13],
    "Region 4": [6, 7, 8],
    "Region 5": [9, 10, 11, 12, 15, 17],
}

# --- Fixed values: issuing team, in matching order ---------------------------------------------------

ISSUER_TEAMS = [
    ("NOC", ["NOC", "ROC", "NETWORK OPERATIONS", "OPS"]),
    ("Field Operations", ["FIELD", "FO_", "FO-"]),
    ("Customer Support", ["CARE", "SUPPORT", "HELPDESK"]),
]

# --- Fixed values: work-order owner group, exact codes ---------------------------------------------------

OWNER_GROUPS = {
    "Field Operations": [
        "FO_GMA", "FO_MIN", "FO_SLZ", "FO_VIS", "FO_NLZ",
        "FO OPS MIN", "FO OPS NCR", "FO OPS NLZ", "FO OPS SLZ", "FO OPS VIS",
        "FOGMA", "FOSLZ", "OPS_VIS", "OPS_NLZ", "OPS_MIN", "OPS_SLZ",
        "AREA1GMA", "AREA2GMA", "AREA4GMA", "AREA5GMA", "AREA6GMA",
    ],
    "NOC": [
        "ROC", "ROC GMA", "ROC NLZ", "ROC VIS",
        "NOC-WLN", "NOC-TRS", "NOC-IPRAN", "NOC-RAN", "NOC-IPCORE", "NOC-VAS", "NOC-CSCORE",
        "NOC_ROAMNG", "NOC_WLS", "OSS", "EDSC", "RSCNFEMIN", "TRS_NOC", "SCC TAC", "GTNOCTRS",
    ],
    "Fiber Restoration": [
        "CNO", "CNO GMA", "CNO MIN", "CNO NLZ", "CNO SLZ", "CNO VIS",
        "CNOGMA", "CNOMIN", "CNONLZ", "CNOVIS", "OSP",
    ],
    "Core Operations": [
        "HEO", "HEO_GMA", "HEO_SLZ", "HEO_VIS", "HEO_NLZ", "HEO_MIN", "HEO_CRM", "HEO_ICS",
        "RMF_GMA", "RMF_SLZ", "RMF_VIS", "RMF_NLZ", "RMF_MIN", "RMFGMA", "RMFSLZ", "RMFVIS",
        "PGRP028", "PGRP029", "PGRP033", "PGRP034", "PGRP035", "PGRP036",
        "PGRP037", "PGRP038", "PGRP039", "PGRP040", "PGRP041", "PGRP042",
        "PGRP043", "PGRP044", "PGRP046", "PGRP047", "PGRP055", "PGRP072",
        "PGRP080", "PGRP095",
        "CNFM", "CNFM NCR", "CNFM VIS", "CNFM SLZ", "CNFM NLZ", "CNFM MIN", "EITSC-CNFM",
        "ECMPGRP003", "ECMPGRP004", "ECMPGRP005", "ECMPGRP006", "ECMPGRP008", "ECMPGRP021",
        "NCRFGRP019", "NCRFGRP024", "NCRFGRP025", "NCRFGRP052", "NCRFGRP054",
        "NCRFGRP060", "NCRFGRP069", "NCRFGRP077", "NCRFGRP080",
        "SDATIER1", "AMMINZMB", "AMMINDVO", "GTCOSS",
    ],
    "Engineering": [
        "IBSPD", "IBS_RETRO", "IBS NCR", "IBS NONNCR",
        "WLSPD NCR", "WLSPD_ENCR", "WLSPD SLZ", "WLSPD NLZ", "WLSPD VIS", "WLSPD MIN",
        "WLSPD_ENLZ", "WLSPD_ESLZ", "WLSPD_EMIN",
        "RGPM NCR", "RGPM MIN", "RGPM SLZ", "RGPM NLZ", "RGPM-DS-NC",
        "SWPR NCR", "PMO", "NPD", "TND_TNI", "TND_TNO",
        "TRIX010", "TRIX016", "TRIX017", "TRIX026", "TRIX028", "TRIX030", "TRIX031",
        "TRS_TNINCR", "AEPM_REPM", "AEPM_FACIL", "AEPM_RGPM", "AEPM_WCNFE", "AEPM NCR",
        "FTTHPD NCR", "FTTHPD LZN", "SLCKRRENLZ", "SLCKRRESLZ",
        "SQUAD_SL1", "PROP TEO", "PRP PD NCR",
    ],
    "Tier 2 Support": [
        "1211", "TRD", "TRDGMA",
        "TRD-AC-NCR", "TRD-AC-NLZ", "TRD-AC-VIS", "TRD-AC-SLZ", "TRD-AC-MIN",
        "TRD-COR-FX", "TRD-COR-TR", "TRD-COR-CS", "TRD-IPNO", "TRD-SPM",
        "TIER2_SDN", "CUS_TIER2", "CUS VISMIN",
    ],
    "Facilities Operations": ["FSGMA", "FACGMA", "CHGSO2APP", "EITSC_FM", "CFS GMA", "BFS_FMS"],
    "Enterprise Operations": ["ECOPS_GMA"],
    "Operations Support": ["RSOGMA"],
    "Third Party": ["NSP_MDTS"],
}

# --- Fixed values: work-order owner group, prefixes in matching order ------------------------------------

OWNER_GROUP_PREFIXES = [
    ("Third Party", ["NSP_", "NSP-"]),
    ("Facilities Operations", ["EITSC_FM", "EITSC-FM", "BFS_", "CFS ", "FACGMA", "FSGMA", "CHGSO"]),
    ("Fiber Restoration", ["CNO"]),
    ("NOC", ["NOC-", "NOC_", "ROC ", "ROC_", "ROC-"]),
    ("NOC", ["TRS_NOC", "RSCNFE", "SCC ", "GTNOC"]),
    ("Core Operations", [
        "HEO", "RMF_", "RMFG", "RMFS", "RMFV", "CNFM",
        "PGRP", "ECMPGRP", "NCRFGRP", "EITSC", "SDATIER", "AMMIN", "GTCOS",
    ]),
    ("Tier 2 Support", ["TRD-", "TRD ", "TRDG", "TIER2", "CUS_", "CUS "]),
    ("Engineering", [
        "IBS", "WLSPD", "RGPM", "SWPR", "PMO", "TND_", "TRIX", "TRS_T", "AEPM",
        "FTTHPD", "SLCKR", "SQUAD", "PROP ", "PRP ", "NPD",
    ]),
    ("Field Operations", ["FO_", "FO ", "FOSLZ", "FOGMA", "OPS_", "AREA"]),
    ("Enterprise Operations", ["ECOPS"]),
    ("Operations Support", ["RSO"]),
]
OWNER_GROUP_BLANKS = ["", "N/A", "NA", "None", "NONE", "null", "NULL"]

# --- Fixed values: confidence tiers of a similarity score ---------------------------------------------------

CONFIDENCE_TIERS = [(0.40, "high"), (0.28, "medium"), (0.15, "low")]
LOWEST_CONFIDENCE = "very_low"

# --- Fixed values: labels and weights of the composite reports ------------------------------------------------

PRIORITY_LABELS = {
    1: "P1 — National Core (3h)",
    2: "P2 — Regional Core (6h)",
    3: "P3 — Zone Equipment (9-24h)",
}
URGENCY_LABELS = {"1": "Outage", "2": "Degradation", "3": "Mgmt Alarm"}
BUSINESS_DISTRICT_CITIES = ["MAKATI CITY", "TAGUIG CITY", "PASAY CITY", "PATEROS"]
COMPLEXITY_SCORES = {"Low": 0, "Medium": 50, "High": 100}
COMPLEXITY_ORDER = ["Low", "Medium", "High"]
SCORECARD_WEIGHTS = {
    "SLA_Score": 0.30, "HighPrio_Score": 0.25, "Field_Score": 0.20,
    "Density_Score": 0.15, "MTTR_Score": 0.10,
}
SITE_RISK_WEIGHTS = {"Freq_Rank": 0.30, "MTTR_Rank": 0.30, "Breach_Rank": 0.25, "Complexity_Score": 0.15}
CITY_RISK_WEIGHTS = {"Breach_Rate": 0.35, "P32_Breach": 0.30, "Fault_Density": 0.20, "Unknown_Rate": 0.15}
MAINTENANCE_WEIGHTS = {"Score_Volume": 0.5, "Score_MTTR": 0.3, "Score_SLA": 0.2}
RATINGS = [(0.25, "Excellent"), (0.50, "Good"), (0.75, "Needs Attention")]
LOWEST_RATING = "Critical"
ZONE_EXPOSURE = {
    "ZONE 1": "Low", "ZONE 2": "Moderate", "ZONE 3": "Low",
    "ZONE 4": "High", "ZONE 5": "High", "ZONE 6": "Moderate",
}
# zone: (service-level margin in points, repair-time factor, field-time factor)
ZONE_TARGETS = {
    "ZONE 1": (2, 0.88, 0.85),
    "ZONE 2": (2, 0.88, 0.86),
    "ZONE 3": (2, 0.87, None),
    "ZONE 4": (2, 0.89, None),
    "ZONE 5": (3, 0.73, None),
    "ZONE 6": (3, 0.82, None),
}
DAYS_PER_MONTH = 30.44

# --- Fixed values: the seven post-clean rules ---------------------------------------------------------------

VALIDATION_COLUMNS = [
    "REPORTDATE", "Priority_Urgency", "OUTAGEDURATION", "Region",
    "Standardized RFO", "SLA_Compliant", "DISPATCH_DELAY_HOURS",
]
VALIDATION_CHECKS = [
    "Required columns present",
    "No duplicate tickets",
    "All regions valid",
    "SLA_Compliant values valid",
    "No negative outage durations",
    "Priority_Urgency format valid",
    "Resolution_Path values valid",
]

# --- Fixed values: clean column <- working column --------------------------------------------------------------

CLEAN_COLUMNS = {
    "TICKETID": "TICKETID", "REPORTDATE": "REPORTDATE",
    "Priority": "Priority", "Urgency": "Urgency", "Priority_Urgency": "Priority_Urgency",
    "OUTAGEDURATION": "OUTAGEDURATION", "ContactGroup": "ContactGroup", "Area": "Area",
    "DISPATCHDATE": "StartDateTime", "NEType": "NEType", "NE_Category": "NE_Category",
    "Region": "Region", "Standardized RFO": "Standardized RFO",
    "ZONE": "AssignArea", "CITY": "AssignCity",
    "RESOLVEDDATE": "RESOLVEDDATE", "RESOLUTION_TIME_HOURS": "RESOLUTION_TIME_HOURS",
    "SLA_Compliant": "SLA_Compliant", "DISPATCH_DELAY_HOURS": "DISPATCH_DELAY_HOURS",
    "SLA_Compliance_Rate": "SLA_Compliance_Rate", "SLA_Breach_Rate": "SLA_Breach_Rate",
    "Resolution_Path": "Resolution_Path", "Issuer_Team": "Issuer_Team_Normalized",
    "SiteName": "SiteName",
    "FIELD_TIME_HOURS": "FIELD_TIME_HOURS", "Timestamp_Integrity": "Timestamp_Integrity",
    "Engineer_ID": "FT_Owner_Anonymized", "Field_Lead_ID": "WOLeadName_Anonymized",
    "WOOwnerGroup": "WOOwnerGroup_Category",
}

# --- fixed outputs: columns that the inference logs carry next to the id ------------

INFERENCE_CONTEXT = ["DESCRIPTION", "NEType"]
