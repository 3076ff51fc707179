import pytest
from pyspark.sql import functions as F

from outagelens.plans import cities, engineers, sites, zones


def test_site_attributes(spark):
    rows = [("s1", f"T{i}", "Access", "ZONE 1", "A") for i in range(6)] + [("s2", "T1", "Core Network", "ZONE 2", "B")]
    rows += [("s3", t, "Access", z, "C") for t, z in (("T1", "ZONE 2"), ("T2", "ZONE 1"), ("T3", "ZONE 2"))]
    rows += [("s4", "T1", None, "ZONE 2", "D"), ("s4", None, None, "ZONE 1", "D")]
    table = spark.createDataFrame(rows, "SiteName string, NEType string, NE_Category string, ZONE string, CITY string")
    got = {r["SiteName"]: (r["Complexity"], r["NE_Count"], r["ZONE"]) for r in sites.site_attributes(table).collect()}
    assert got == {
        "s1": ("High", 6, "ZONE 1"), "s2": ("High", 1, "ZONE 2"), "s3": ("Medium", 3, "ZONE 2"), "s4": ("Low", 1, "ZONE 1")
    }


def test_active_pool_needs_home_zone_team_and_volume(spark):
    rows = [("L1", "ZONE 1", "Field Operations")] * 5 + [("L1", "ZONE 2", "Field Operations")] * 2
    rows += [("L2", "ZONE 2", "Field Operations")] * 2 + [("L3", "ZONE 1", "NOC")] * 9
    rows += [("Unknown", "ZONE 1", "Field Operations")] * 9
    table = spark.createDataFrame(rows, "Field_Lead_ID string, ZONE string, WOOwnerGroup string").withColumn(
        "Resolution_Path", F.lit("Field_Dispatch_Restored")
    )
    pool = engineers.active_pool(table, 3).groupBy("ZONE", "Field_Lead_ID").count().collect()
    assert [tuple(r) for r in pool] == [("ZONE 1", "L1", 5)]


def test_mix_adjusted_weights_are_plain_averages(spark):
    rows = [("ZONE 1", 1, 10.0)] * 1 + [("ZONE 1", 3, 20.0)] * 3 + [("ZONE 2", 3, 40.0)] * 2
    table = spark.createDataFrame(rows, "ZONE string, Priority int, OUTAGEDURATION double").withColumns(
        {"Resolution_Path": F.lit("x"), "FIELD_TIME_HOURS": F.lit(1.0), "Timestamp_Integrity": F.lit(True)}
    )
    got = {r["ZONE"]: r["Adjusted_MTTR"] for r in zones.mix_adjusted(table).collect()}
    assert got["ZONE 1"] == pytest.approx(10 * 0.125 + 20 * 0.875)
    assert got["ZONE 2"] == pytest.approx(40 * 0.875)


def test_city_without_degradation_volume_has_no_score_and_comes_last(spark):
    rows = []
    for city, tier, met in (("A", "3.2", 0), ("B", "3.2", 1), ("C", "1.1", 0)):
        rows += [("ZONE 1", city, f"{city}{i % 3}", tier, met, 5.0, "x") for i in range(30)]
    table = spark.createDataFrame(
        rows, "ZONE string, CITY string, SiteName string, Priority_Urgency string, SLA_Compliant int, "
        "OUTAGEDURATION double, `Standardized RFO` string",
    ).withColumns({"DISPATCH_DELAY_HOURS": F.lit(1.0), "FIELD_TIME_HOURS": F.lit(4.0), "Timestamp_Integrity": F.lit(True)})
    ranked = cities.city_risk(table, 20, 20).orderBy("Rank").collect()
    assert [r["CITY"] for r in ranked] == ["A", "B", "C"] and ranked[-1]["Risk_Score"] is None


def test_class_verdict(spark):
    split = spark.createDataFrame([("CBD", 30.0), ("Non-CBD", 9.0)], "City_Type string, Avg_Field_Time double")
    assert cities.class_verdict(split).collect()[0]["Verdict"] == "material"
    assert cities.class_verdict(split.where("City_Type = 'CBD'")).count() == 0
