"""Raw tickets to clean tickets in five phases, as one lazy plan."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import TimestampType

from outagelens import fixed_values as fixed
from outagelens.functions import service
from outagelens.functions.moments import day_comes_first, moment_or_missing
from outagelens.functions.nulls import differs, present_and
from outagelens.functions.rules import (
    any_of, case_when, contains_any, first_containing, is_any, literal, lookup, named,
)
from outagelens.functions.text import clean_text, closest_label
from outagelens.operators.dedupe import DUPLICATE_STEP, first_failed_step, keep_first
from outagelens.operators.inference import (
    Compared, Keep, as_is, compare, default_stop_words, fill_from_text, inference_log, low_confidence,
)
from outagelens.operators.lookups import frequent_keys, lookup_left, lookup_spread, may_be_broadcast, settled, unmatched
from outagelens.sources.checkpoints import stored
from outagelens.sources.files import require_columns

CAUSE = "RFODescription"
STANDARD_CAUSE = "Standardized RFO"


# --- phase 1: structural filters --------------------------------------------------

def structural_steps() -> list[tuple[str, Column]]:
    """Filter steps behind the duplicate step, in order."""
    return [
        ("Drop blank Priority", F.col("Priority").isNotNull()),
        ("Keep Priority 1-3", F.expr(is_any("Priority", fixed.KEPT_PRIORITIES))),
        ("Keep Urgency 0-3", F.expr(is_any("try_cast(Urgency AS double)", fixed.KEPT_URGENCIES))),
        ("Keep closing FT Status", F.expr(is_any("`FT Status`", fixed.KEPT_STATUSES))),
        ("Drop Fault Type INVALID", differs(F.col("Fault Type"), "INVALID")),
    ]


def keep_structural(
    raw: DataFrame, order: list[str], seen: Observation | None = None, dealt: Iterable[str] = (),
) -> DataFrame:
    """First row per ticket, if it passes the filters; `seen` counts the first rows and those that each filter drops.

    `dealt` names columns that the ticket id determines; rows already dealt by them are not shuffled again.

    The filters are judged before the duplicate step, but act behind it: a ticket
    whose first row fails is dropped even if a later copy would pass.  A failing
    row competes for first with its key, its order and a mark only; its texts are
    not shuffled.
    """
    judged = settled(raw, "_failed", first_failed_step(structural_steps()))
    competing = ["TICKETID", *dealt, *order]
    passes = F.col("_failed").isNull()
    narrowed = judged.select(
        *[F.col(f"`{c}`") if c in competing else F.when(passes, F.col(f"`{c}`")).alias(c) for c in raw.columns],
        "_failed",
    )
    first = keep_first(narrowed, [*dealt, "TICKETID"], order)
    if seen is not None:
        dropped = [F.count_if(F.col("_failed") == n).alias(f"dropped_{n}") for n in range(1, len(structural_steps()) + 1)]
        first = first.observe(seen, F.count("*").alias("first_rows"), *dropped)
    kept = first.where(passes).drop("_failed")
    return kept.withColumn("Urgency", F.col("Urgency").try_cast("double"))


# --- phase 2: repair -------------------------------------------------------------------

def backfilled_cause() -> Column:
    """Cause, else root cause, else what the action text says (the last listed match wins)."""
    action = "upper(ActionTaken)"
    linear, redundant, _ = (literal(label) for label in fixed.FIBRE_CAUSES)
    cases = [(contains_any(action, [text]), literal(cause)) for text, cause in reversed(fixed.ACTION_BACKFILL)]
    cases.append((contains_any(action, ["SPLICED"]), f"if(Urgency = 1, {linear}, {redundant})"))
    return F.coalesce(F.col(CAUSE), F.col("RootCause"), F.expr(case_when(cases)))


def fibre_cause(description: str, urgency: str) -> str:
    """Which fibre cause an ambiguous fibre text means."""
    linear, redundant, other = (literal(label) for label in fixed.FIBRE_CAUSES)
    several = any_of([contains_any(description, fixed.FIBRE_REDUNDANT_IN_DESCRIPTION), f"{urgency} > 1"])
    single = any_of([contains_any(description, fixed.FIBRE_LINEAR_IN_DESCRIPTION), f"{urgency} = 1"])
    return case_when([(several, redundant), (single, linear)], other)


def plain(label: str) -> str:
    return label.lower().replace("-", " ").strip()


def cause_rules(cause: str, action: str, texts: str, description: str, ne_type: str, urgency: str) -> str:
    """The ordered steps from cause text to label."""
    fibre = fibre_cause(description, urgency)
    linear, redundant, _ = (literal(label) for label in fixed.FIBRE_CAUSES)

    def labelled(text: str, rules) -> list[tuple[str, str]]:
        return [(contains_any(text, needles), literal(label)) for label, needles in rules]

    def in_cause_or_description(cause_needles: list[str], description_needles: list[str]) -> str:
        return any_of([contains_any(cause, cause_needles), contains_any(description, description_needles)])

    unknown = contains_any(cause, fixed.UNKNOWN_TRIGGERS)
    steps = [
        *[(f"{cause} = {literal(plain(label))}", literal(label)) for label in fixed.CAUSE_LABELS],
        (contains_any(cause, fixed.INVALID_PHRASES), "'Invalid'"),
        (in_cause_or_description(fixed.FIBRE_LINEAR, fixed.FIBRE_LINEAR_IN_DESCRIPTION), linear),
        (in_cause_or_description(fixed.FIBRE_REDUNDANT, fixed.FIBRE_REDUNDANT_IN_DESCRIPTION), redundant),
        (in_cause_or_description(fixed.FIBRE_GENERIC, fixed.FIBRE_GENERIC_IN_DESCRIPTION), fibre),
        (contains_any(action, ["spliced"]), fibre),
        *labelled(action, fixed.ACTION_CAUSES),
        *labelled(texts, fixed.CAUSE_PHRASES.items()),
        *[(f"({unknown} AND {hit})", label) for hit, label in labelled(description, fixed.UNKNOWN_PHRASES)],
    ]
    by_similarity = closest_label(cause, fixed.CAUSE_LABELS, fixed.FUZZY_THRESHOLD, "Uncategorized")
    by_description = first_containing(description, fixed.LAST_PHRASES, by_similarity)
    return case_when(steps, lookup(ne_type, fixed.NE_CAUSES, by_description))


def with_standard_cause(df: DataFrame, into: str = STANDARD_CAUSE) -> DataFrame:
    """Map the cause text to a label of the vocabulary; the first matching step wins."""
    def text(name: str) -> str:
        return f"lower(coalesce({named(name)}, ''))"

    prepared = df.withColumns(
        {
            "_cause": F.expr(f"trim(replace({text(CAUSE)}, '-', ' '))"),
            "_action": F.expr(text("ActionTaken")),
            "_description": F.expr(text("DESCRIPTION")),
            "_type": F.expr("upper(trim(coalesce(NEType, '')))"),
        }
    ).withColumn("_texts", F.expr(f"concat_ws(' ', _cause, {text('RootCause')}, _action)"))
    rules = cause_rules("_cause", "_action", "_texts", "_description", "_type", "Urgency")
    return settled(prepared, into, F.expr(rules)).drop("_cause", "_action", "_description", "_type", "_texts")


def with_vocabulary(df: DataFrame, column: str = STANDARD_CAUSE) -> DataFrame:
    """Labels outside the vocabulary become Uncategorized."""
    listed = is_any(named(column), fixed.CAUSE_LABELS)
    return df.withColumn(column, F.expr(case_when([(listed, named(column))], "'Uncategorized'")))


def drop_unusable(df: DataFrame, column: str) -> DataFrame:
    """Without rows whose cause is Invalid or Uncategorized; a missing cause stays."""
    return df.where(differs(F.col(column), "Invalid") & differs(F.col(column), "Uncategorized"))


def repair_texts(df: DataFrame) -> DataFrame:
    """Equipment category, clean texts and the back-filled cause."""
    cleaned = df.withColumn("NE_Category", service.equipment_category("NEType")).withColumns(
        {name: clean_text(F.col(name)) for name in (CAUSE, "RootCause", "ActionTaken")}
    )
    return cleaned.withColumn(CAUSE, backfilled_cause())


def standardise(df: DataFrame) -> DataFrame:
    """Both drop passes around the cause standard."""
    usable = drop_unusable(df, CAUSE).withColumn("Original_RFO", F.col(CAUSE))
    return with_vocabulary(with_standard_cause(usable))


# --- phase 3: places ----------------------------------------------------------------------

def with_region(df: DataFrame) -> DataFrame:
    return settled(df, "Region", service.region_of("ContactGroup", "Area", "DESCRIPTION"))


def keep_regions(df: DataFrame) -> DataFrame:
    return df.where(F.col("Region").isin(fixed.REGION_ORDER))


def site_match(df: DataFrame, sites: DataFrame) -> Column:
    """Only tickets of the zoned region look up a site."""
    return (df["Area"] == sites["PLAID"]) & (df["Region"] == fixed.ZONED_REGION)


def with_site(df: DataFrame, sites: DataFrame, shown: DataFrame | None = None) -> DataFrame:
    """Zone and city of each ticket's site.

    Where the sites are too many to broadcast, areas with very many tickets, as a sketch of the areas of `shown` finds
    them, are dealt over all partitions; `shown` is a table that costs less to read than the tickets at hand.
    """
    attributes = ["AssignArea", "AssignCity"]
    if may_be_broadcast(sites):
        return lookup_left(df, sites, site_match(df, sites), attributes, "Unknown")
    hot = frequent_keys(df if shown is None else shown, "Area")
    zoned = F.col("Region") == fixed.ZONED_REGION
    return lookup_spread(df, sites, ("Area", "PLAID"), attributes, "Unknown", hot, ["TICKETID"], zoned)


def hide_places(df: DataFrame) -> DataFrame:
    return df.withColumns({name: service.short_hash(F.col(name)) for name in ("ContactGroup", "Area")})


# --- phase 4: service model -------------------------------------------------------------------

def _moment(df: DataFrame, name: str, shown: DataFrame | None) -> Column:
    if isinstance(df.schema[name].dataType, TimestampType):
        return F.col(name)
    return moment_or_missing(F.col(name), day_comes_first(df if shown is None else shown, name))


def _verdict(df: DataFrame) -> Column:
    own = service.sla_verdict("Priority_Urgency", "RESOLUTION_TIME_HOURS")
    if "SLA_Compliant" not in df.columns:
        return own
    given = F.col("SLA_Compliant").try_cast("double")
    complete = df.agg(F.coalesce(F.bool_and(present_and(given.isin(0.0, 1.0))), F.lit(False))).scalar()
    return F.when(complete, given.cast("int")).otherwise(own)


def _own(df: DataFrame, name: str, derived: Callable[[str], Column]) -> Column:
    return derived(name) if name in df.columns else F.lit("Unknown")


def model_service(df: DataFrame, among: Column | None = None, shown: DataFrame | None = None) -> DataFrame:
    """Keys, times, verdicts, the resolution path, teams and the site key.

    Given verdicts count if all rows have one, or all rows `among` those named.  Whether dates in text have the day in
    front is inferred from the columns of `shown`, a table that costs less to read, or from the rows themselves.
    """
    verdict_source = df if among is None else df.where(among)
    timed = df.withColumns(
        {
            "Priority_Urgency": service.priority_urgency(F.col("Priority"), F.col("Urgency")),
            "Priority": F.col("Priority").cast("tinyint"),
            "Urgency": F.col("Urgency").cast("tinyint"),
            "REPORTDATE": _moment(df, "REPORTDATE", shown),
            "StartDateTime": _moment(df, "StartDateTime", shown),
            "OUTAGEDURATION": F.col("OUTAGEDURATION").try_cast("double"),
        }
    )
    report, duration = F.col("REPORTDATE"), F.col("OUTAGEDURATION")
    timed = timed.withColumns(
        {
            "RESOLVEDDATE": service.plus_hours(report, duration),
            "RESOLUTION_TIME_HOURS": duration,
            "StartDateTime": F.coalesce(F.col("StartDateTime"), F.when(duration.isNotNull(), report)),
        }
    )
    timed = timed.withColumns(
        {
            "SLA_Compliant": _verdict(verdict_source),
            "DISPATCH_DELAY_HOURS": service.hours_between(report, F.col("StartDateTime")),
        }
    )
    delay = F.col("DISPATCH_DELAY_HOURS")
    timed = timed.withColumns(
        {
            "SLA_Compliance_Rate": F.col("SLA_Compliant") * 100.0,
            "SLA_Breach_Rate": 100.0 - F.col("SLA_Compliant") * 100.0,
            "FIELD_TIME_HOURS": duration - delay,
            "Timestamp_Integrity": service.timestamps_hold(delay, duration - delay, duration),
        }
    )
    names = {
        name: service.blank_to_missing(name) for name in ("FT_Owner", "WOLeadName") if name in df.columns
    }
    timed = timed.withColumns(names) if names else timed

    def present(name: str) -> Column:
        return F.col(name) if name in df.columns else F.lit(None).cast("string")

    return timed.withColumns(
        {
            "Resolution_Path": service.resolution_path(present("FT_Owner"), present("WOLeadName")),
            "Issuer_Team_Normalized": _own(df, "Issuer Team", service.issuer_team),
            "WOOwnerGroup_Category": _own(df, "WOOwnerGroup", service.owner_group),
            "SiteName": service.site_name(F.col("Region"), F.col("AssignCity"), F.col("Area")),
        }
    )


# --- phase 5: privacy ------------------------------------------------------------------------------

def protect_people(df: DataFrame) -> DataFrame:
    """Pseudonyms for people, then only the columns of the clean table."""
    coded = df.withColumns(
        {
            "FT_Owner_Anonymized": _own(df, "FT_Owner", lambda name: service.person_code(F.col(name))),
            "WOLeadName_Anonymized": _own(df, "WOLeadName", lambda name: service.person_code(F.col(name))),
        }
    ).drop(*fixed.PERSONNEL_COLUMNS)
    return coded.select(
        *[F.col(source).alias(name) for name, source in fixed.CLEAN_COLUMNS.items() if source in coded.columns]
    )


# --- the whole plan -----------------------------------------------------------------------------------

@dataclass
class Cleaning:
    """The stages of one cleaning plan, for the result and its audit extracts.

    With the text inference, the stages that several branches read, the term
    counts and the comparisons are written once below the session's shared
    folder, while the plan is built; `cut` names another way to keep them.
    Without it the plan is lazy, but for given verdicts: the placed rows are written
    then, as all must be known before one is judged.  `seen` (see `watched`) counts rows inside the
    plan, while the clean table is written.  `dealt` names columns that the ticket
    id determines and the raw rows are dealt by; `areas` is a table with the raw
    rows' Area that costs less to read than they do.
    """

    raw: DataFrame
    sites: DataFrame
    order: list[str]
    region_scope: str | None = None
    infer: bool = True
    stop_words: Iterable[str] | None = None
    cut: Keep | None = None
    seen: dict[str, Observation] = field(default_factory=dict)
    dealt: Iterable[str] = ()
    areas: DataFrame | None = None
    stages: dict[str, DataFrame] = field(default_factory=dict)
    compared: dict[str, Compared] = field(default_factory=dict)

    def __post_init__(self) -> None:
        require_columns(self.raw, fixed.REQUIRED_COLUMNS)
        stage = self.stages
        raw = self.raw.observe(self.seen["raw"], F.count("*").alias("rows")) if self.seen else self.raw
        stage["filtered"] = keep_structural(raw, self.order, self.seen.get("first"), self.dealt)
        if self.infer:
            self.stop_words = list(self.stop_words if self.stop_words is not None else default_stop_words())
            cut = self.cut or (lambda df: stored(df, "cleaning"))
            stage["filtered"] = cut(stage["filtered"])
            stage["typed"] = cut(self._inferred("filtered", "NEType", "UNKNOWN", cut))
            stage["repaired"] = cut(repair_texts(stage["typed"]))
            stage["caused"] = cut(self._inferred("repaired", CAUSE, fixed.UNKNOWN_CAUSE, cut))
        else:
            stage["typed"] = stage["filtered"]
            stage["repaired"] = stage["caused"] = repair_texts(stage["typed"])
        stage["standard"] = standardise(stage["caused"])
        stage["usable"] = drop_unusable(stage["standard"], STANDARD_CAUSE)
        stage["placed"] = with_region(stage["usable"])
        stage["sited"] = with_site(
            keep_regions(stage["placed"]), self.sites, self.raw if self.areas is None else self.areas
        )
        if "SLA_Compliant" in self.raw.columns:  # read twice: to see whether all rows have a verdict, and to count them
            stage["sited"] = (self.cut or (lambda df: stored(df, "cleaning")))(stage["sited"])
        stage["modelled"] = model_service(hide_places(stage["sited"]), shown=self.raw)
        scoped = stage["modelled"]
        if self.region_scope:
            scoped = scoped.where(F.col("Region") == self.region_scope)
        stage["scoped"] = scoped
        clean = protect_people(scoped)
        stage["clean"] = clean.observe(self.seen["clean"], F.count("*").alias("rows")) if self.seen else clean

    def _inferred(self, source: str, target: str, constant: str, cut: Keep) -> DataFrame:
        rows = self.stages[source]
        self.compared[target] = compare(rows, "TICKETID", target, "DESCRIPTION", self.stop_words, cut)
        return fill_from_text(
            rows, "TICKETID", target, "DESCRIPTION", constant, self.stop_words, cut, self.compared[target]
        )

    @property
    def clean(self) -> DataFrame:
        return self.stages["clean"]


def clean_tickets(raw: DataFrame, sites: DataFrame, order: list[str], **options) -> DataFrame:
    """Clean tickets; `order` says which copy of a repeated ticket comes first."""
    return Cleaning(raw, sites, order, **options).clean


def watched() -> dict[str, Observation]:
    """Observations for the `seen` of a cleaning that is run once, as its clean table is written."""
    return {name: Observation(f"cleaning-{name}") for name in ("raw", "first", "clean")}


def recorded(cleaning: Cleaning) -> dict[str, int]:
    """What the observations of a written cleaning counted; waits for the write.

    Counts behind the duplicate step are taken where the table is written.  The raw rows are counted as they are read:
    should a lost executor make Spark read some again, they count again, and `dedupe.cleaning_funnel` and
    `quality.retention` count exactly, with scans of their own.
    """
    raw, first, clean = (cleaning.seen[name].get for name in ("raw", "first", "clean"))
    return {"initial_rows": raw["rows"], "final_rows": clean["rows"], **first}


def recorded_funnel(spark: SparkSession, counts: dict[str, int]) -> DataFrame:
    """The cleaning funnel from recorded counts."""
    left, rows = counts["initial_rows"], []
    dropped = [left - counts["first_rows"], *[counts[f"dropped_{n}"] for n in range(1, len(structural_steps()) + 1)]]
    for step, (rule, gone) in enumerate(zip([DUPLICATE_STEP, *[name for name, _ in structural_steps()]], dropped)):
        left -= gone
        rows.append((step, rule, gone, left))
    return spark.createDataFrame(rows, "step int, rule string, dropped long, remaining long")


def recorded_retention(spark: SparkSession, counts: dict[str, int]) -> DataFrame:
    """Rows before and after cleaning and the share kept, from recorded counts; no share of no rows."""
    table = spark.createDataFrame([(counts["initial_rows"], counts["final_rows"])], "initial_rows long, final_rows long")
    return table.withColumn("retained_pct", F.try_divide("final_rows", "initial_rows") * 100)


def snapshot(df: DataFrame, key: list[str], rows: int = 1000) -> DataFrame:
    """A bounded extract of the key columns for eyeballing."""
    columns = [name for name in fixed.SNAPSHOT_COLUMNS if name in df.columns]
    return df.select(*columns, *[name for name in key if name not in columns]).orderBy(*key).limit(rows)


def path_summary(modelled: DataFrame) -> DataFrame:
    """Volume, mean duration, compliance and mean dispatch delay per resolution path."""
    return modelled.groupBy("Resolution_Path").agg(
        F.count("TICKETID").alias("Count"),
        F.bround(F.avg("OUTAGEDURATION"), 2).alias("Avg_Duration"),
        F.bround(F.avg("SLA_Compliant"), 2).alias("SLA_Rate"),
        F.bround(F.avg("DISPATCH_DELAY_HOURS"), 2).alias("Avg_Dispatch"),
    )


def top_sites(modelled: DataFrame, city: str = "AssignCity", n: int = 100) -> DataFrame:
    """The n sites with most tickets; the site name already fixes region and city."""
    return (
        modelled.groupBy("SiteName")
        .agg(
            F.count("TICKETID").alias("Tickets"),
            F.bround(F.avg("SLA_Compliant"), 2).alias("SLA_Rate"),
            F.bround(F.avg("OUTAGEDURATION"), 2).alias("Avg_Duration"),
            F.min("Region").alias("Region"),
            F.min(city).alias("City"),
        )
        .orderBy(F.desc("Tickets"), F.asc("SiteName"))
        .limit(n)
    )


def pseudonym_map(df: DataFrame, name: str) -> DataFrame:
    """Each person with their code."""
    return df.select(name, service.person_code(F.col(name)).alias(f"{name}_Anonymized")).dropDuplicates()


def reclassified(standard: DataFrame) -> DataFrame:
    """Causes recorded as unknown that the standard resolved."""
    return standard.where(
        present_and(F.lower("Original_RFO") == "unknown under investigation")
        & differs(F.col(STANDARD_CAUSE), fixed.UNKNOWN_CAUSE)
    )


def audit_extracts(cleaning: Cleaning) -> dict[str, DataFrame]:
    """All audit extracts, each a lazy table over the plan's stages; writing one runs what it reads of them."""
    stage = cleaning.stages
    cause_columns = ["TICKETID", CAUSE, "RootCause", "ActionTaken", "Urgency", "NEType"]
    missing_type = stage["filtered"].where(F.col("NEType").isNull())
    standard = stage["standard"]
    unknown = standard.where(F.col(STANDARD_CAUSE) == fixed.UNKNOWN_CAUSE).select(*cause_columns)
    zoned = stage["sited"].where(F.col("Region") == fixed.ZONED_REGION)
    regional = keep_regions(stage["placed"])
    audits = {
        "snapshot_pre_cleaning": snapshot(cleaning.raw, cleaning.order),
        "snapshot_after_phase1": snapshot(stage["filtered"], ["TICKETID"]),
        "missing_ne_type_tickets": missing_type.select("TICKETID", CAUSE, "DESCRIPTION", "Fault Type"),
        "reclassified_unknown_rfo": reclassified(standard).select(
            "TICKETID", "Original_RFO", STANDARD_CAUSE, "RootCause", "ActionTaken", "Urgency", "NEType"
        ),
        "foc_categorization_log": standard.where(F.col(STANDARD_CAUSE).isin(fixed.FIBRE_CAUSES)).select(
            "TICKETID", CAUSE, "Urgency", STANDARD_CAUSE
        ),
        "unknown_rfo_analysis": unknown,
        "invalid_rfo_values": with_standard_cause(drop_unusable(stage["caused"], CAUSE))
        .where(~present_and(F.col(STANDARD_CAUSE).isin(fixed.CAUSE_LABELS)))
        .select(*cause_columns),
        "uncategorized_rfo_descriptions": standard.where(F.col(STANDARD_CAUSE) == "Uncategorized").select(
            *cause_columns
        ),
        "unmatched_areas_region3": unmatched(
            regional.where(F.col("Region") == fixed.ZONED_REGION),
            cleaning.sites,
            regional["Area"] == cleaning.sites["PLAID"],
            ["TICKETID", "Area", "Region"],
        ),
        "region3_after_merge": zoned.select("TICKETID", "Area", "Region", "AssignArea", "AssignCity"),
        "resolution_path_analysis": path_summary(stage["modelled"]),
        "top_100_sites": top_sites(stage["modelled"]),
    }
    for name in ("FT_Owner", "WOLeadName"):
        if name in stage["scoped"].columns:
            label = "ft_owner" if name == "FT_Owner" else "wo_lead"
            audits[f"{label}_anonymization_map"] = pseudonym_map(stage["scoped"], name)
    if cleaning.infer:
        for label, source, target in (("netype", "filtered", "NEType"), ("rfodescription", "repaired", CAUSE)):
            log = inference_log(
                stage[source], "TICKETID", target, "DESCRIPTION", cleaning.stop_words,
                context=dict.fromkeys([*fixed.INFERENCE_CONTEXT, target]), compared=cleaning.compared[target],
            )
            audits[f"inferred_{label}_scores"] = log
            audits[f"low_confidence_{label}"] = low_confidence(log)
        scores = audits["inferred_rfodescription_scores"].select("TICKETID", "Similarity_Score")
        audits["unknown_rfo_analysis"] = unknown.join(scores, "TICKETID", "left")
        audits["generated_ne_type_tickets"] = stage["typed"].join(
            missing_type.select("TICKETID"), "TICKETID", "left_semi"
        ).select("TICKETID", "NEType", CAUSE, "DESCRIPTION")
    from outagelens.operators.quality import validation_report

    audits["data_validation_report"] = validation_report(cleaning.clean)
    return audits
