import pytest
from pyspark.sql import functions as F

from outagelens import fixed_values as fixed
from outagelens.functions import moments, service
from outagelens.functions.text import clean_text, fixed_point, magnitude, prepared_text, truncated


def one(spark, column, **values):
    kinds = {str: "string", int: "int", float: "double", type(None): "string"}
    schema = ", ".join(f"`{name}` {kinds[type(value)]}" for name, value in values.items())
    return spark.createDataFrame([tuple(values.values())], schema).select(column.alias("v")).collect()[0]["v"]


def test_verdict_at_every_limit(spark):
    cases = []
    for tier, limit in fixed.SLA_HOURS.items():
        cases += [(tier, float(limit), 1), (tier, limit - 0.1, 1), (tier, limit + 0.1, 0)]
    cases += [("9.9", 5.0, 1), ("9.9", 30.0, 0), ("2.0", 24.0, 1), (" 1.1 ", 3.5, 0), ("2.2", None, None)]
    rows = spark.createDataFrame(cases, "tier string, hours double, want int")
    wrong = rows.where(~service.sla_verdict("tier", "hours").eqNullSafe(F.col("want")))
    assert wrong.collect() == []


@pytest.mark.parametrize("score, tier", [
    (0.6, "high"), (0.4, "high"), (0.399, "medium"), (0.28, "medium"), (0.279, "low"),
    (0.15, "low"), (0.149, "very_low"), (0.001, "very_low"), (0.0, "very_low"),
])
def test_confidence_tiers(spark, score, tier):
    assert one(spark, service.confidence_tier("score"), score=score) == tier


@pytest.mark.parametrize("group, area, description, region", [
    ("GMA_NOC", "", "", "Region 3"), ("VIS_OPS", "", "", "Region 4"), ("", "NCR_001", "", "Region 3"),
    ("", "NL_SITE", "", "Region 1"), ("", "", "GMA CORE LINK DOWN", "Region 3"), ("", "", "", "Unknown Area"),
    (None, None, None, "Unknown Area"), ("ADMIN", "NCR", "", "Region 5"), ("x", "y", "at Lahug hub", "Region 4"),
    ("small team", "SLZ", "", "Region 3"),
])
def test_region_cascade(spark, group, area, description, region):
    column = service.region_of("g", "a", "d")
    assert one(spark, column, g=group, a=area, d=description) == region


@pytest.mark.parametrize("code, group", [
    (None, "Unknown"), (" N/A ", "Unknown"), ("FO_GMA", "Field Operations"), ("fo_gma", "Field Operations"),
    ("ROC", "NOC"), ("roc", "Other"), ("EITSC-CNFM", "Core Operations"), ("EITSC-FM9", "Facilities Operations"),
    ("cno east", "Fiber Restoration"), ("TRS_NOC2", "NOC"), ("trs_t9", "Engineering"), ("zzz", "Other"),
])
def test_owner_group(spark, code, group):
    assert one(spark, service.owner_group("code"), code=code) == group


@pytest.mark.parametrize("team, name", [
    (None, "Unknown"), ("NOC-GMA", "NOC"), ("roc", "NOC"), ("Field team", "Field Operations"),
    ("customer care", "Customer Support"), ("desk", "Other"), ("FO_OPS", "NOC"),
])
def test_issuer_team(spark, team, name):
    assert one(spark, service.issuer_team("team"), team=team) == name


def test_resolution_path_follows_the_names(spark):
    path = service.resolution_path(F.col("o"), F.col("l"))
    assert one(spark, path, o=None, l="x") == "Auto_Self_Restored"
    assert one(spark, path, o="x", l=None) == "NOC_Remote_Restored"
    assert one(spark, path, o="x", l="y") == "Field_Dispatch_Restored"


def test_blank_tokens_are_exact(spark):
    assert one(spark, service.blank_to_missing("x"), x="N/A") is None
    assert one(spark, service.blank_to_missing("x"), x="n/a") == "n/a"
    assert one(spark, service.blank_to_missing("x"), x=None) is None


def test_person_code_and_site_name(spark):
    assert one(spark, service.person_code(F.col("p")), p=None) == "Unknown"
    assert one(spark, service.person_code(F.col("p")), p="Unknown") == "Unknown"
    assert one(spark, service.person_code(F.col("p")), p="abc") == "ENG_ba7816bf"
    assert one(spark, service.site_name(F.col("r"), F.col("c"), F.col("a")), r="Region 3", c=None, a="0123456789") == (
        "Region3_Unknown_01234567"
    )


def test_timestamps_and_hours(spark):
    assert one(spark, moments.moment_or_missing(F.col("t")), t="nonsense") is None
    assert str(one(spark, moments.moment_or_missing(F.col("t")), t="2024-01-02 03:04:05")) == "2024-01-02 03:04:05"
    assert str(one(spark, moments.moment_or_missing(F.col("t")), t="1/2/2024 3:04")) == "2024-01-02 03:04:00"
    hold = service.timestamps_hold(F.col("d"), F.col("f"), F.col("o"))
    assert one(spark, hold, d=1.0, f=1.0, o=2.0) is True
    assert one(spark, hold, d=3.0, f=-1.0, o=2.0) is False
    assert one(spark, hold, d=0.0, f=0.0, o=0.0) is True


def test_missing_delay_is_not_sound(spark):
    frame = spark.createDataFrame([(None, None, 2.0)], "d double, f double, o double")
    assert frame.select(service.timestamps_hold(F.col("d"), F.col("f"), F.col("o"))).collect()[0][0] is False


def test_texts(spark):
    assert one(spark, clean_text(F.col("t")), t="  a-b__c \t d ") == "a b c d"
    assert one(spark, clean_text(F.col("t")), t=None) is None
    assert one(spark, prepared_text(F.col("t"), ["the", "and"]), t="The BTS, and an x1y2 node!") == "bts x1y2 node"
    assert one(spark, prepared_text(F.col("t"), ["the"]), t=None) == ""
    assert one(spark, truncated(F.col("t"), 8), t="abcdefghi") == "abcde..."
    assert one(spark, truncated(F.col("t"), 9), t="abcdefghi") == "abcdefghi"


@pytest.mark.parametrize("number", [0.05, 0.15, 0.25, 0.35, 656.05, 2.675, 999.95, 1.0, 12.345, -0.45])
def test_fixed_point_rounds_like_the_exact_binary_value(spark, number):
    assert one(spark, fixed_point(F.col("x"), 1), x=number) == f"{number:.1f}"
    assert one(spark, fixed_point(F.col("x"), 2), x=number) == f"{number:.2f}"


def test_magnitude(spark):
    shown = [one(spark, magnitude(F.col("x")), x=n) for n in (999, 1200, 3_400_000, -2_000_000_000)]
    assert shown == ["999", "1.2K", "3.4M", "-2.0B"]


@pytest.mark.parametrize("text, moment", [
    ("2024/01/05 10:00", "2024-01-05 10:00:00"), ("13/02/2024 10:00", "2024-02-13 10:00:00"), ("01-Jan-2024 10:00", "2024-01-01 10:00:00"),
    ("Jan 5, 2024", "2024-01-05 00:00:00"), ("20240105", "2024-01-05 00:00:00"), ("1/2/24 5:00", "2024-01-02 05:00:00"),
    ("1/2/2024 5:00 PM", "2024-01-02 17:00:00"), ("1/2/2024 12:00 am", "2024-01-02 00:00:00"), ("1/2/2024 12:30 p.m.", "2024-01-02 12:30:00"),
    ("5 September 2023, 7:08:09.250", "2023-09-05 07:08:09.250000"), ("Sept. 5th, 2023", "2023-09-05 00:00:00"), ("1.2.1999", "1999-01-02 00:00:00"),
    ("1/2/69", "1969-01-02 00:00:00"), ("1/2/68", "2068-01-02 00:00:00"), ("2024-01-02T03:04:05+01:00", "2024-01-02 02:04:05"),
    ("2/1/2024 3:04 +0130", "2024-02-01 01:34:00"), (" 2024-1-2 ", "2024-01-02 00:00:00"),
    ("31/4/2024", None), ("14/14/2024", None), ("1/2/2024 13:00 PM", None), ("1/2/2024 25:00", None), ("Jon 5, 2024", None), ("2024", None),
    ("12", None), ("", None), (None, None), ("20241301", None), ("1/2/024", None),
])
def test_spellings_of_moments(spark, text, moment):
    found = one(spark, moments.moment_or_missing(F.col("t").cast("string")), t=text)
    assert (None if found is None else str(found)) == moment


def test_a_column_shows_whether_the_day_comes_first(spark):
    def read(*texts):
        table = spark.createDataFrame([(t,) for t in texts], "t string")
        return [None if r[0] is None else str(r[0])[:10] for r in table.select(moments.inferred_moment(table, "t")).collect()]

    assert read("1/2/2024", "3/4/2024") == ["2024-01-02", "2024-03-04"]
    assert read("1/2/2024", "13/4/2024") == ["2024-02-01", "2024-04-13"]
    assert read("1/2/2024", "13/4/2024", "4/13/2024") == ["2024-01-02", "2024-04-13", "2024-04-13"]
    assert read(None, "x") == [None, None]
    found = spark.createDataFrame([("1/2/2024",), ("Jan 5, 2024",), ("nonsense",), ("31/4/2024",), ("",), (None,)], "t string")
    assert {r["spelling"]: r["rows"] for r in moments.spellings(found, "t").collect()} == {"numbers": 1, "month name and day": 1, "unread": 2}
