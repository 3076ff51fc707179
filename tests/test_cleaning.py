import pytest
from pyspark.sql import functions as F

from outagelens import fixed_values as fixed
from outagelens.functions.nulls import absent_or, differs, not_in, present_and
from outagelens.operators import quality
from outagelens.operators.dedupe import cleaning_funnel, keep_first
from outagelens.operators.lookups import frequent_keys
from outagelens.plans import cleaning
from outagelens.plans.cleaning import Cleaning, audit_extracts, clean_tickets
from outagelens.schemas import CLEAN_TICKETS

WORDS = ["the", "and", "for"]


def report(df):
    return quality.initial_quality(df).collect()[0].asDict()


def checks(df):
    return {row["check"]: row["passed"] for row in quality.validation_report(df).collect()}


def status(df):
    return quality.overall_status(quality.validation_report(df)).collect()[0][0]


def test_missing_values_in_predicates(spark):
    rows = spark.createDataFrame([("a",), ("b",), (None,)], "x string")
    def kept(predicate):
        return [r["x"] for r in rows.where(predicate).collect()]
    assert kept(not_in(F.col("x"), ["a"])) == ["b", None]
    assert kept(differs(F.col("x"), "a")) == ["b", None]
    assert kept(present_and(F.col("x") > "a")) == ["b"]
    assert kept(absent_or(F.col("x") > "a")) == ["b", None]


def test_initial_quality(sample_raw):
    clean = report(sample_raw)
    assert clean["duplicate_tickets"] == 0 and 0 <= clean["quality_score"] <= 100
    doubled = report(sample_raw.unionByName(sample_raw.limit(2)))
    assert doubled["duplicate_tickets"] == 2


def test_missing_values_count_as_invalid_and_as_one_key(sample_raw):
    rows = sample_raw.withColumns({name: F.lit(None).cast("string") for name in ("TICKETID", "FT Status")})
    found = report(rows)
    assert (found["duplicate_tickets"], found["invalid_status"]) == (12, 13)


def test_validation(sample_clean):
    assert status(sample_clean) == "PASS"
    assert list(checks(sample_clean)) == fixed.VALIDATION_CHECKS
    first = F.col("TICKETID") == "TK400"
    assert status(sample_clean.unionByName(sample_clean.limit(3))) == "FAIL"
    assert status(sample_clean.withColumn("Region", F.when(~first, F.col("Region")).otherwise("Region 99"))) == "FAIL"
    assert status(sample_clean.withColumn("OUTAGEDURATION", F.when(~first, 1.0).otherwise(-1.0))) == "FAIL"
    assert status(sample_clean.withColumn("Priority_Urgency", F.lit("2.0"))) == "FAIL"
    assert status(sample_clean.withColumn("OUTAGEDURATION", F.lit(None).cast("double"))) == "FAIL"
    without = checks(sample_clean.drop("Region"))
    assert not without["Required columns present"] and not without["All regions valid"]


def test_keep_first_follows_the_declared_order_and_joins_missing_keys(spark):
    rows = spark.createDataFrame([("a", 2, "x"), ("a", 1, "y"), (None, 5, "p"), (None, 4, "q")], "k string, o int, v string")
    assert {r["v"] for r in keep_first(rows, ["k"], ["o"]).collect()} == {"y", "q"}


def test_a_hot_key_is_limited_before_the_shuffle(spark):
    rows = spark.range(20000).select(F.when(F.col("id") % 3 == 0, F.lit(-1)).otherwise(F.col("id")).alias("k"), "id")
    first = keep_first(rows, ["k"], ["id"])
    plan = first._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 2
    assert first.count() == rows.select("k").distinct().count()


def test_funnel_adds_up(spark, sample_raw):
    rows = sample_raw.withColumn("seq", F.col("TICKETID")).unionByName(
        sample_raw.limit(3).withColumn("seq", F.lit("zzz"))
    )
    funnel = cleaning_funnel(rows, ["TICKETID"], ["seq"], cleaning.structural_steps()).orderBy("step").collect()
    survivors = cleaning.keep_structural(rows, ["seq"]).count()
    assert funnel[0]["dropped"] == 3
    assert sum(r["dropped"] for r in funnel) + survivors == 16
    assert funnel[-1]["remaining"] == survivors == 7


def test_a_ticket_whose_first_copy_fails_is_dropped(spark, sample_raw):
    bad = sample_raw.where("TICKETID = 'W02'").withColumns({"Priority": F.lit(4.0), "seq": F.lit("0")})
    good = sample_raw.where("TICKETID = 'W02'").withColumn("seq", F.lit("1"))
    assert cleaning.keep_structural(good.unionByName(bad), ["seq"]).count() == 0


def test_whole_plan(spark, sample_raw, sample_sites):
    cleaned = clean_tickets(sample_raw, sample_sites, ["TICKETID"], stop_words=WORDS)
    assert cleaned.columns == list(fixed.CLEAN_COLUMNS)
    kinds = {f.name: f.dataType for f in CLEAN_TICKETS.fields}
    assert {f.name: f.dataType for f in cleaned.schema.fields} == kinds
    rows = {r["TICKETID"]: r for r in cleaned.collect()}
    assert set(rows) == {f"W0{k}" for k in range(1, 8)}
    one = rows["W01"]
    assert (one["ZONE"], one["CITY"], one["Standardized RFO"]) == ("ZONE 4", "TAGUIG", "FOC CUT - LINEAR")
    assert (one["DISPATCH_DELAY_HOURS"], one["FIELD_TIME_HOURS"], one["Timestamp_Integrity"]) == (0.5, 2.5, True)
    assert one["SLA_Compliant"] == 1 and one["Priority_Urgency"] == "1.1"  # exactly at its three hours
    assert one["Resolution_Path"] == "Field_Dispatch_Restored" and one["Field_Lead_ID"].startswith("ENG_")
    assert one["WOOwnerGroup"] == "Unknown" and one["Issuer_Team"] == "NOC"
    assert rows["W02"]["Resolution_Path"] == "NOC_Remote_Restored"
    assert rows["W03"]["Resolution_Path"] == "Auto_Self_Restored" and rows["W03"]["ZONE"] == "Unknown"
    assert rows["W04"]["NEType"] == "BTS" and rows["W04"]["CITY"] == "MANILA"
    assert rows["W05"]["Standardized RFO"] == "FOC CUT WITH REDUNDANCY"
    assert rows["W06"]["DISPATCH_DELAY_HOURS"] == -0.5 and not rows["W06"]["Timestamp_Integrity"]
    assert rows["W02"]["Standardized RFO"] == rows["W07"]["Standardized RFO"] == "FACILITIES-Power Failure"
    sound = [r for r in rows.values() if r["Timestamp_Integrity"]]
    assert all(r["DISPATCH_DELAY_HOURS"] + r["FIELD_TIME_HOURS"] == r["OUTAGEDURATION"] for r in sound)
    assert status(cleaned) == "PASS"


def test_a_given_verdict_is_used_only_when_complete(sample_raw, sample_sites):
    given = sample_raw.withColumn("SLA_Compliant", F.lit(0))
    used = clean_tickets(given, sample_sites, ["TICKETID"], infer=False)
    assert {r["SLA_Compliant"] for r in used.select("SLA_Compliant").collect()} == {0}
    written = sample_raw.withColumn("SLA_Compliant", F.when(F.col("TICKETID") == "W01", "1.0").otherwise("0.0"))
    shown = clean_tickets(written, sample_sites, ["TICKETID"], infer=False).select("TICKETID", "SLA_Compliant").collect()
    assert {r["TICKETID"] for r in shown if r["SLA_Compliant"] == 1} == {"W01"} and len(shown) == 7
    partial = sample_raw.withColumn("SLA_Compliant", F.when(F.col("TICKETID") != "W01", 0))
    own = clean_tickets(partial, sample_sites, ["TICKETID"], infer=False)
    assert own.where("TICKETID = 'W01'").collect()[0]["SLA_Compliant"] == 1


def test_blank_start_becomes_the_report_time(sample_raw, sample_sites):
    rows = sample_raw.withColumn("StartDateTime", F.lit(None).cast("string"))
    cleaned = clean_tickets(rows, sample_sites, ["TICKETID"], infer=False)
    assert {r[0] for r in cleaned.select("DISPATCH_DELAY_HOURS").collect()} == {0.0}


def test_scope_and_missing_columns(spark, sample_raw, sample_sites):
    import pytest

    scoped = clean_tickets(sample_raw, sample_sites, ["TICKETID"], region_scope="Region 1", infer=False)
    assert scoped.count() == 0
    with pytest.raises(ValueError, match="Missing required columns: .*NEType"):
        clean_tickets(sample_raw.drop("NEType"), sample_sites, ["TICKETID"])


def test_optional_columns_default(sample_raw, sample_sites):
    rows = sample_raw.drop("FT_Owner", "WOLeadName", "Issuer Team")
    cleaned = clean_tickets(rows, sample_sites, ["TICKETID"], infer=False).collect()
    assert {r["Issuer_Team"] for r in cleaned} == {"Unknown"}
    assert {r["Engineer_ID"] for r in cleaned} == {"Unknown"}
    assert {r["Resolution_Path"] for r in cleaned} == {"Auto_Self_Restored"}


def test_audit_extracts(sample_raw, sample_sites):
    run = Cleaning(sample_raw, sample_sites, ["TICKETID"], stop_words=WORDS)
    audits = audit_extracts(run)
    assert len(audits) == 20
    assert audits["snapshot_pre_cleaning"].count() == 13
    assert {r["Area"] for r in audits["unmatched_areas_region3"].collect()} == {"QZN-9"}
    assert audits["wo_lead_anonymization_map"].count() == 2
    assert audits["data_validation_report"].count() == 7
    assert audits["foc_categorization_log"].count() == 2
    assert [r["TICKETID"] for r in audits["inferred_netype_scores"].collect()] == ["W04"]
    assert [(r["TICKETID"], r["NEType"]) for r in audits["generated_ne_type_tickets"].collect()] == [("W04", "BTS")]
    for table in audits.values():
        table.schema


def test_reclassified_causes(spark):
    """Rows whose recorded unknown cause another label replaced."""
    rows = [("a", "UNKNOWN Under Investigation", "OTHERS-Force Majeure"), ("b", "unknown under investigation", fixed.UNKNOWN_CAUSE),
            ("c", "power", "FACILITIES-Power Failure"), ("d", None, None), ("e", "Unknown Under Investigation", None)]
    table = spark.createDataFrame(rows, "TICKETID string, Original_RFO string, `Standardized RFO` string")
    assert {r["TICKETID"] for r in cleaning.reclassified(table).collect()} == {"a", "e"}


def test_the_inferred_plan_is_short(sample_raw, sample_sites):
    """Shared stages are stored: the clean table's own plan reads a stored stage and the sites."""
    run = Cleaning(sample_raw, sample_sites, ["TICKETID"], stop_words=WORDS)
    plan = run.clean._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Relation") <= 3 and plan.count("Join") <= 1


def test_counts_are_recorded_while_the_table_is_written(spark, sample_raw, sample_sites, tmp_path):
    raw = sample_raw.unionByName(sample_raw.where("TICKETID IN ('W01', 'X02')"))
    run = Cleaning(raw, sample_sites, ["TICKETID"], infer=False, seen=cleaning.watched())
    run.clean.write.parquet(str(tmp_path / "clean"))
    counts = cleaning.recorded(run)
    counted = cleaning_funnel(raw, ["TICKETID"], ["TICKETID"], cleaning.structural_steps()).collect()
    assert cleaning.recorded_funnel(spark, counts).collect() == counted
    share = quality.retention(raw, spark.read.parquet(str(tmp_path / "clean"))).collect()
    assert cleaning.recorded_retention(spark, counts).collect() == share and share[0]["initial_rows"] == 15
    nothing = dict.fromkeys(counts, 0)
    assert cleaning.recorded_retention(spark, nothing).first()["retained_pct"] is None


@pytest.fixture
def no_broadcast(spark):
    settings = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.shuffle.partitions": "16", "spark.sql.adaptive.enabled": "false"}
    before = {name: spark.conf.get(name, None) for name in settings}
    for name, value in settings.items():
        spark.conf.set(name, value)
    yield
    for name, value in before.items():
        spark.conf.unset(name) if value is None else spark.conf.set(name, value)


def test_an_area_with_a_third_of_all_tickets_is_dealt_over_the_partitions(spark, no_broadcast):
    tickets = spark.range(30_000).selectExpr(
        "concat('T', id) AS TICKETID", "if(id % 3 = 0, 'HOT', if(id % 97 = 1, NULL, concat('A', id % 500))) AS Area",
        f"if(id % 7 = 0, 'Region 1', '{fixed.ZONED_REGION}') AS Region")
    sites = spark.range(400).selectExpr("concat('A', id) AS PLAID", "concat('Z', id) AS AssignArea", "concat('C', id) AS AssignCity").union(
        spark.createDataFrame([("HOT", "ZONE 9", "SPOT")], "PLAID string, AssignArea string, AssignCity string"))
    assert tickets.select(frequent_keys(tickets, "Area").alias("hot")).first()["hot"] == ["HOT"]
    found = cleaning.with_site(tickets, sites)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "_salt" in plan and "Broadcast" not in plan
    sizes = [r["count"] for r in found.groupBy(F.spark_partition_id()).count().collect()]
    plain = cleaning.lookup_left(tickets, sites, cleaning.site_match(tickets, sites), ["AssignArea", "AssignCity"], "Unknown")
    unsplit = [r["count"] for r in plain.groupBy(F.spark_partition_id()).count().collect()]
    assert max(sizes) < 2 * 30_000 / 16 and max(unsplit) > 10_000
    assert set(map(tuple, found.collect())) == set(map(tuple, plain.collect()))
    assert found.count() == 30_000
