from pyspark.sql import functions as F

from outagelens.plans import kpis


def by_zone(df):
    return {row["ZONE"]: row for row in df.collect()}


def test_mean_repair_time(sample_clean):
    grouped = by_zone(kpis.mean_repair_time(sample_clean, "ZONE"))
    assert {zone: row["MTTR"] for zone, row in grouped.items()} == {"ZONE 4": 3.0, "ZONE 2": 6.25, "ZONE 5": 12.0}
    assert kpis.mean_repair_time(sample_clean).collect()[0]["MTTR"] == (7 * 3 + 11 * 6.25 + 4 * 12) / 22


def test_sla_compliance(sample_clean):
    grouped = by_zone(kpis.sla_compliance(sample_clean, "ZONE"))
    assert [grouped[f"ZONE {i}"]["SLA_Compliance_Rate"] for i in (4, 2, 5)] == [100.0, 0.0, 100.0]


def test_grouped_count_skips_missing_verdicts_but_the_total_counts_rows(sample_clean):
    first = F.col("TICKETID") == "TK400"
    rows = sample_clean.withColumn("SLA_Compliant", F.when(~first, F.col("SLA_Compliant")))
    assert by_zone(kpis.sla_compliance(rows, "ZONE"))["ZONE 4"]["Ticket_Count"] == 6
    assert kpis.sla_compliance(rows).collect()[0]["Ticket_Count"] == 22


def test_missing_group_keys_are_left_out(sample_clean):
    rows = sample_clean.withColumn("ZONE", F.when(F.col("ZONE") != "ZONE 4", F.col("ZONE")))
    assert set(by_zone(kpis.mean_repair_time(rows, "ZONE"))) == {"ZONE 2", "ZONE 5"}


def test_fault_density(sample_clean):
    row = by_zone(kpis.fault_density(sample_clean, "ZONE"))["ZONE 2"]
    assert (row["Total_Faults"], row["Unique_Sites"], row["Fault_Density"]) == (11, 1, 11.0)


def test_phase_times_leave_out_bad_timestamps(sample_clean):
    rows = sample_clean.withColumn("Timestamp_Integrity", F.col("ZONE") != "ZONE 4")
    assert "ZONE 4" not in by_zone(kpis.triage_time(rows, "ZONE"))
    assert "ZONE 4" not in by_zone(kpis.field_time(rows, "ZONE"))
    assert by_zone(kpis.field_time(sample_clean, "ZONE"))["ZONE 4"]["Avg_Field_Time"] == 2.75


def test_phase_times_from_other_columns(sample_clean):
    moments = sample_clean.withColumn("DISPATCHDATE", F.expr("REPORTDATE + INTERVAL 90 MINUTES").cast("string"))
    derived = kpis.triage_time(moments.drop("DISPATCH_DELAY_HOURS"), "ZONE")
    assert by_zone(derived)["ZONE 2"]["Avg_NOC_Time"] == 1.5
    difference = kpis.field_time(sample_clean.drop("FIELD_TIME_HOURS"), "ZONE")
    assert by_zone(difference)["ZONE 2"]["Avg_Field_Time"] == 0.0
    nothing = sample_clean.select("ZONE", "Timestamp_Integrity")
    assert {r["Avg_NOC_Time"] for r in kpis.triage_time(nothing, "ZONE").collect()} == {0.0}
    assert kpis.field_time(nothing).collect()[0]["Avg_Field_Time"] == 0.0


def test_zone_summary(sample_clean):
    summary = kpis.zone_summary(sample_clean)
    assert summary.columns == [
        "ZONE", "Ticket_Count", "MTTR", "SLA_Compliance_Rate", "Total_Faults",
        "Unique_Sites", "Fault_Density", "Avg_NOC_Time", "Avg_Field_Time",
    ]
    unknown = sample_clean.withColumn(
        "ZONE", F.when(F.col("TICKETID") == "TK400", "Unknown").otherwise(F.col("ZONE"))
    )
    assert "Unknown" not in by_zone(kpis.zone_summary(unknown))
    everything = kpis.zone_summary(unknown, exclude_unknown=False).collect()
    assert [row["Ticket_Count"] for row in everything] == [11, 6, 4, 1]


def test_a_zone_without_sound_tickets_leaves_the_summary(sample_clean):
    rows = sample_clean.withColumn("Timestamp_Integrity", F.col("ZONE") != "ZONE 2")
    assert set(by_zone(kpis.zone_summary(rows))) == {"ZONE 4", "ZONE 5"}


def test_kpi_tables_equal_the_fused_summary(sample_clean):
    tables, fused = kpis.kpi_tables(sample_clean), by_zone(kpis.zone_summary(sample_clean))
    for name, column in (("mttr", "MTTR"), ("noc_time", "Avg_NOC_Time"), ("field_time", "Avg_Field_Time")):
        assert {z: r[column] for z, r in by_zone(tables[name]).items()} == {z: r[column] for z, r in fused.items()}


def test_region_aggregates_name_their_column(sample_clean):
    assert kpis.aggregate_by_region(sample_clean, "OUTAGEDURATION", "max").collect()[0]["OUTAGEDURATION_max"] == 12.0
    titled = kpis.aggregate_by_region(sample_clean, "OUTAGEDURATION", "sum", titled=True)
    assert "Outageduration (Sum)" in titled.columns
