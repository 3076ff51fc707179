"""All audit extracts of a cleaning in two jobs: one pass tags rows with the extracts they belong to, one adds them up."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from outagelens import fixed_values as fixed
from outagelens.functions.nulls import differs, present_and
from outagelens.functions.rules import named
from outagelens.operators.inference import inference_log
from outagelens.operators.quality import validation_report
from outagelens.plans.cleaning import (
    CAUSE, STANDARD_CAUSE, Cleaning, hide_places, model_service, path_summary, protect_people, pseudonym_map, repair_texts, site_match,
    snapshot, top_sites, with_region, with_standard_cause, with_vocabulary,
)

EXTRACT = "extract"
#: Rows that the second job adds up, not extracts themselves.
FILTERED, MODELLED = "_filtered", "_modelled"
ROWS, TOTALS = "rows", "totals"
#: The columns of a person's code map and the extract's name.
PEOPLE = {"FT_Owner": "ft_owner_anonymization_map", "WOLeadName": "wo_lead_anonymization_map"}

#: The extracts of the second job.
TOTAL_NAMES = {"snapshot_pre_cleaning", "snapshot_after_phase1", "resolution_path_analysis", "top_100_sites", "data_validation_report",
               *PEOPLE.values()}

Tag = tuple[Column, dict[str, Column]]


def judged(cleaning: Cleaning) -> DataFrame:
    """Every row behind the structural filters with all later stages' columns, and a flag for each later filter.

    _before holds the columns that later stages overwrite, _caused and _kept say whether the row reaches the cause
    standard and the service model, _label is the cause label before the vocabulary, _site whether its site is known.
    """
    stage = cleaning.stages
    names = list(dict.fromkeys([CAUSE, "NEType", "DESCRIPTION", "Fault Type", *(c for c in fixed.SNAPSHOT_COLUMNS if c in cleaning.raw.columns)]))
    before = F.struct(*[F.col(named(name)).alias(name) for name in names]).alias("_before")
    if cleaning.infer:
        rows = stage["caused"].join(stage["filtered"].select(F.col("TICKETID").alias("_id"), before), F.col("TICKETID").eqNullSafe(F.col("_id"))).drop("_id")
    else:
        rows = repair_texts(stage["filtered"].withColumn("_before", before))
    usable = differs(F.col(CAUSE), "Invalid") & differs(F.col(CAUSE), "Uncategorized")
    rows = with_standard_cause(rows.withColumn("Original_RFO", F.col(CAUSE)).withColumn("_caused", usable))
    rows = with_vocabulary(rows.withColumn("_label", F.col(STANDARD_CAUSE)))
    kept = differs(F.col(STANDARD_CAUSE), "Invalid") & differs(F.col(STANDARD_CAUSE), "Uncategorized")
    rows = with_region(rows)
    rows = rows.withColumn("_kept", F.col("_caused") & kept & present_and(F.col("Region").isin(fixed.REGION_ORDER)))
    known = cleaning.sites.withColumn("_site", F.lit(True))
    sited = rows.join(known, site_match(rows, known), "left").select(
        *[rows[c] for c in rows.columns], F.coalesce("_site", F.lit(False)).alias("_site"),
        *[F.coalesce(known[a], F.lit("Unknown")).alias(a) for a in ("AssignArea", "AssignCity")])
    places = F.struct("Area", "Urgency").alias("_place")
    return model_service(hide_places(sited.withColumn("_place", places)), F.col("_kept"), cleaning.raw)


def _tags(cleaning: Cleaning, columns: list[str]) -> dict[str, Tag]:
    """For each extract of single rows: when a row belongs to it, and the columns it shows."""
    caused, kept = F.col("_caused"), F.col("_kept")
    zoned = kept & (F.col("Region") == fixed.ZONED_REGION)
    standard = F.col(STANDARD_CAUSE)
    urgency, area = F.col("_place.Urgency"), F.col("_place.Area")

    def shown(*names: str, **own: Column) -> dict[str, Column]:
        return {name: own.get(name, F.col(named(name))) for name in names}

    cause = shown("TICKETID", CAUSE, "RootCause", "ActionTaken", "Urgency", "NEType", Urgency=urgency)
    before = {name: F.col(f"_before.`{name}`") for name in (CAUSE, "DESCRIPTION", "Fault Type")}
    key = {"TICKETID": F.col("TICKETID")}
    scored = {"Similarity_Score": F.col("Similarity_Score")} if "Similarity_Score" in columns else {}
    missing = F.col("_before.NEType").isNull()
    tags = {
        "missing_ne_type_tickets": (missing, key | before),
        "reclassified_unknown_rfo": (
            caused & present_and(F.lower("Original_RFO") == "unknown under investigation") & differs(standard, fixed.UNKNOWN_CAUSE),
            shown("TICKETID", "Original_RFO", STANDARD_CAUSE, "RootCause", "ActionTaken", "Urgency", "NEType", Urgency=urgency)),
        "foc_categorization_log": (
            caused & present_and(standard.isin(fixed.FIBRE_CAUSES)), shown("TICKETID", CAUSE, "Urgency", STANDARD_CAUSE, Urgency=urgency)),
        "unknown_rfo_analysis": (caused & present_and(standard == fixed.UNKNOWN_CAUSE), cause | scored),
        "invalid_rfo_values": (caused & ~present_and(F.col("_label").isin(fixed.CAUSE_LABELS)), cause),
        "uncategorized_rfo_descriptions": (caused & present_and(standard == "Uncategorized"), cause),
        "unmatched_areas_region3": (zoned & ~F.col("_site"), shown("TICKETID", "Area", "Region", Area=area)),
        "region3_after_merge": (zoned, shown("TICKETID", "Area", "Region", "AssignArea", "AssignCity", Area=area)),
        FILTERED: (F.lit(True), key | {c: F.col(f"_before.`{c}`") for c in fixed.SNAPSHOT_COLUMNS if c in cleaning.raw.columns}),
        MODELLED: (kept, shown(*[c for c in MODELLED_COLUMNS if c in columns])),
    }
    if cleaning.infer:
        tags["generated_ne_type_tickets"] = (
            missing & F.col("TICKETID").isNotNull(),
            shown("TICKETID", "NEType", CAUSE, "DESCRIPTION", **{name: before[name] for name in (CAUSE, "DESCRIPTION")}))
    return tags


#: What the second job reads of the service model.
MODELLED_COLUMNS = list(dict.fromkeys([
    "TICKETID", "Resolution_Path", "OUTAGEDURATION", "SLA_Compliant", "DISPATCH_DELAY_HOURS", "SiteName", "Region", "AssignCity",
    *PEOPLE, *fixed.CLEAN_COLUMNS.values(), "WOOwnerGroup", "Issuer Team"]))


def _flat(columns: dict[str, Column], kinds: dict[str, str], own: str) -> Column:
    """A struct with all columns that any extract has: this one's, named by itself, and null for the rest."""
    return F.struct(F.lit(own).alias(EXTRACT), *[
        (columns[name].cast(kind) if name in columns else F.lit(None).cast(kind)).alias(name) for name, kind in kinds.items()])


def tagged_rows(cleaning: Cleaning) -> tuple[DataFrame, dict[str, list[str]]]:
    """One row for each extract that a ticket belongs to, in the columns of all extracts; and each extract's own columns."""
    rows = judged(cleaning)
    logs = {}
    if cleaning.infer:
        for label, source, target in (("netype", "filtered", "NEType"), ("rfodescription", "repaired", CAUSE)):
            logs[label] = inference_log(
                cleaning.stages[source], "TICKETID", target, "DESCRIPTION", cleaning.stop_words,
                context=dict.fromkeys([*fixed.INFERENCE_CONTEXT, target]), compared=cleaning.compared[target])
        scores = logs["rfodescription"].select(F.col("TICKETID").alias("_scored"), "Similarity_Score")
        rows = rows.join(scores, F.col("TICKETID") == F.col("_scored"), "left").drop("_scored")
    tags = _tags(cleaning, rows.columns)
    kinds: dict[str, str] = {}
    for _, columns in tags.values():
        for field in rows.select(*[column.alias(name) for name, column in columns.items()]).schema:
            kinds.setdefault(field.name, field.dataType.simpleString())
    members = F.array(*[F.when(belongs, _flat(columns, kinds, name)) for name, (belongs, columns) in tags.items()])
    out = rows.select(F.inline(F.array_compact(members)))
    own = {name: list(columns) for name, (_, columns) in tags.items()}
    for label, log in logs.items():
        low = F.when(F.col("Confidence").isin("low", "very_low"), F.lit(f"low_confidence_{label}"))
        names = F.explode(F.array_compact(F.array(F.lit(f"inferred_{label}_scores"), low)))
        out = out.unionByName(log.select(names.alias(EXTRACT), "*"), allowMissingColumns=True)
        own |= {name: log.columns for name in (f"inferred_{label}_scores", f"low_confidence_{label}")}
    return out, own


def write_audits(cleaning: Cleaning, folder: str, file_format: str = "parquet") -> dict[str, int]:
    """Write all audit extracts below the folder; the row counts by name, observed while they are written.

    The first job reads the cleaning's lineage once: each row is written to every extract that it belongs to, with the
    narrow rows that the second job turns into the extracts that add up, order or tell apart. An extract is a partition
    of one table of all their columns; `read_audit` gives its own. A column that two extracts of a job hold in
    different types is text in both.
    """
    rows, own = tagged_rows(cleaning)
    counts = _written(rows, own, f"{folder}/{ROWS}", file_format)
    written = _table(cleaning.raw.sparkSession, f"{folder}/{ROWS}", file_format, rows.schema)
    filtered, modelled = (written.where(F.col(EXTRACT) == name).select(*[named(c) for c in own[name]]) for name in (FILTERED, MODELLED))
    scoped = modelled if cleaning.region_scope is None else modelled.where(F.col("Region") == cleaning.region_scope)
    totals = {
        "snapshot_pre_cleaning": snapshot(cleaning.raw, cleaning.order),
        "snapshot_after_phase1": snapshot(filtered, ["TICKETID"]),
        "resolution_path_analysis": path_summary(modelled),
        "top_100_sites": top_sites(modelled),
        "data_validation_report": validation_report(protect_people(scoped)),
    }
    totals |= {extract: pseudonym_map(scoped, name) for name, extract in PEOPLE.items() if name in modelled.columns}
    kinds: dict[str, str] = {}
    for table in totals.values():
        kinds |= {name: kind if kinds.get(name, kind) == kind else "string" for name, kind in table.dtypes}
    every = None
    for name, table in totals.items():
        one = table.select(F.lit(name).alias(EXTRACT), *[F.col(named(c)).cast(kinds[c]).alias(c) for c in table.columns])
        every = one if every is None else every.unionByName(one, allowMissingColumns=True)
    return counts | _written(every, {name: table.columns for name, table in totals.items()}, f"{folder}/{TOTALS}", file_format)


def _options(file_format: str) -> dict[str, str]:
    return {"header": "true", "escape": '"', "multiLine": "true"} if file_format == "csv" else {}


def _table(spark: SparkSession, path: str, file_format: str, schema: StructType | None = None) -> DataFrame:
    reader = spark.read.format(file_format).options(**_options(file_format))
    return (reader.schema(schema) if schema else reader).load(path)


def _written(table: DataFrame, own: dict[str, list[str]], path: str, file_format: str) -> dict[str, int]:
    """Write the table by extract; each column says in its metadata which extracts it belongs to."""
    shown = table.select(EXTRACT, *[
        F.col(named(c)).alias(c, metadata={"extracts": [name for name, columns in own.items() if c in columns]})
        for c in table.columns if c != EXTRACT])
    names = [name for name in own if not name.startswith("_")]
    seen = Observation()
    counted = shown.observe(seen, *[F.count_if(F.col(EXTRACT) == name).alias(name) for name in names])
    counted.write.mode("overwrite").partitionBy(EXTRACT).format(file_format).options(**_options(file_format)).save(path)
    return {name: seen.get[name] for name in names}


def read_audit(spark: SparkSession, folder: str, name: str, file_format: str = "parquet") -> DataFrame:
    """One extract in its own columns; a format that keeps no metadata gives the columns of all extracts of its job."""
    part = TOTALS if name in TOTAL_NAMES else ROWS
    table = _table(spark, f"{folder}/{part}", file_format)
    own = [c.name for c in table.schema if c.name != EXTRACT and name in c.metadata.get("extracts", [name])]
    return table.where(F.col(EXTRACT) == name).select(*[F.col(named(c)) for c in own])
