import csv
import os
import random
from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from outagelens import fixed_values as fixed
from outagelens.plans import audits
from outagelens.plans.cleaning import Cleaning, audit_extracts
from outagelens.sources import files
from outagelens.sources.checkpoints import checkpointed, shared_folder, stored
from outagelens.sources.regions import regions_with_volume

HEADER = [*fixed.REQUIRED_COLUMNS, "Extra"]


def line(number, **cells):
    base = {
        "TICKETID": f"T{number}", "REPORTDATE": "2024-01-01 00:00:00", "FT Status": "CLOSED", "Priority": "1",
        "Urgency": "2", "OUTAGEDURATION": "2.5", "RFODescription": "power outage", "ContactGroup": "GMA_X",
        "Area": "NCR1", "Fault Type": "REACTIVE", "DESCRIPTION": "  leading blanks", "RootCause": "NA",
        "StartDateTime": "2024-01-01 01:00:00", "NEType": "", "ActionTaken": '"quoted ""text"""', "Extra": "é",
    }
    base.update(cells)
    return "\t".join(base[name] for name in HEADER)


@pytest.fixture
def ticket_file(tmp_path):
    path = tmp_path / "tickets.tsv"
    rows = ["\t".join(HEADER), line(1), line(2, Priority="oops"), line(3) + "\tone\ttoo many", "T4\t2024-01-01"]
    path.write_text("\n".join(rows) + "\n", encoding="utf-8")
    return str(path)


def test_read_tickets(spark, ticket_file):
    rows = {r["TICKETID"]: r for r in files.read_tickets(spark, [ticket_file]).collect()}
    assert set(rows) == {"T1", "T2", "T4"}
    one = rows["T1"]
    assert one["Priority"] == 1.0 and one["DESCRIPTION"] == "leading blanks" and one["Extra"] == "é"
    assert one["RootCause"] is None and one["NEType"] is None and one["ActionTaken"] == 'quoted "text"'
    assert rows["T2"]["Priority"] is None and rows["T4"]["Area"] is None
    assert files.read_tickets(spark, [ticket_file]).select("TICKETID").count() == 3
    assert {r[0] for r in files.read_tickets(spark, [ticket_file]).select("Area").collect()} == {"NCR1", None}


def test_bad_lines(spark, ticket_file):
    skipped = files.bad_lines(spark, ticket_file).collect()
    assert len(skipped) == 1 and "too many" in skipped[0]["line"]


def test_whole_records(spark, tmp_path):
    cells = [line(1, ActionTaken='"first\nsecond"'), line(2, RootCause='"tab\there"'), "", line(3, Extra='"never closed'), line(4)]
    path = tmp_path / "whole.tsv"
    path.write_text("\n".join(["\t".join(HEADER), *cells]) + "\n", encoding="utf-8")
    rows = {r["TICKETID"]: r for r in files.read_tickets(spark, [str(path)]).collect()}
    assert set(rows) == {"T1", "T2"}
    assert rows["T1"]["ActionTaken"] == "first\nsecond" and rows["T2"]["RootCause"] == "tab\there"
    skipped = files.bad_lines(spark, str(path)).collect()
    assert len(skipped) == 1 and "T3" in skipped[0]["line"]
    split = {r["TICKETID"] for r in files.read_tickets(spark, [str(path)], multiline=False).collect()}
    assert "T2" in split and "T1" not in split and "T3" not in split
    assert any("T1" in r["line"] for r in files.bad_lines(spark, str(path), multiline=False).collect())


def test_column_order_does_not_matter(spark, tmp_path):
    names = list(reversed(HEADER))
    cells = dict(zip(HEADER, line(1).split("\t")))
    path = tmp_path / "turned.tsv"
    path.write_text("\t".join(names) + "\n" + "\t".join(cells[n] for n in names) + "\n")
    assert files.read_tickets(spark, [str(path)]).collect()[0]["TICKETID"] == "T1"


def test_fallback_and_missing_inputs(spark, ticket_file, tmp_path):
    absent = str(tmp_path / "absent.tsv")
    assert files.read_tickets(spark, [absent, ticket_file]).count() == 3
    with pytest.raises(FileNotFoundError):
        files.read_tickets(spark, [absent])
    short = tmp_path / "short.tsv"
    short.write_text("TICKETID\tArea\n1\tx\n")
    with pytest.raises(ValueError, match="Missing required columns"):
        files.read_tickets(spark, [str(short)])


def test_read_sites(spark, tmp_path):
    path = tmp_path / "sites.csv"
    path.write_text("Other,PLAID,AssignArea,AssignCity\n1, ncr1 ,ZONE 1,A\n2,NCR1,ZONE 2,B\n3,NCR2,ZONE 3,C\n")
    rows = {r["PLAID"]: r["AssignArea"] for r in files.read_sites(spark, [str(path)]).collect()}
    assert rows == {"NCR1": "ZONE 1", "NCR2": "ZONE 3"}
    empty = files.read_sites(spark, [str(tmp_path / "absent.csv")])
    assert empty.columns == fixed.SITE_COLUMNS and empty.count() == 0


def test_write_and_read_back(spark, sample_clean, tmp_path):
    path = str(tmp_path / "clean")
    assert files.write_table(sample_clean, path, partition_by=["ZONE"]) == 22
    back = files.read_clean(spark, path)
    assert files.write_clean(sample_clean, str(tmp_path / "clustered")) == 22
    again = files.read_clean(spark, str(tmp_path / "clustered"))
    assert again.columns == back.columns and sorted(map(repr, again.collect())) == sorted(map(repr, back.collect()))
    assert back.count() == 22 and dict(back.dtypes)["Priority_Urgency"] == "string"
    assert files.write_table(sample_clean.limit(3), str(tmp_path / "csv"), "csv") == 3


def as_text(table, columns):
    return sorted(map(repr, map(tuple, table.select(*[F.col(f"`{c}`").cast("string") for c in columns]).collect())))


@pytest.mark.parametrize("options", [dict(infer=False), dict(infer=False, region_scope="Region 3"), dict(stop_words=["the", "at"])])
def test_audits_are_written_in_two_jobs_with_the_same_rows(spark, sample_raw, sample_sites, tmp_path, options):
    run = Cleaning(sample_raw, sample_sites, ["TICKETID"], **options)
    counts = audits.write_audits(run, str(tmp_path))
    lazy = audit_extracts(run)
    assert set(counts) == set(lazy)
    for name, table in lazy.items():
        found = audits.read_audit(spark, str(tmp_path), name)
        assert set(found.columns) == set(table.columns), name
        assert as_text(found, table.columns) == as_text(table, table.columns), name
        assert counts[name] == table.count(), name


def test_given_verdicts_in_audits(spark, sample_raw, sample_sites, tmp_path):
    """Whether given verdicts are complete is judged on the rows that reach the service model only."""
    raw = sample_raw.withColumn("SLA_Compliant", F.when(F.col("TICKETID").startswith("W"), F.lit(1)))
    run = Cleaning(raw, sample_sites, ["TICKETID"], infer=False)
    audits.write_audits(run, str(tmp_path))
    want = audit_extracts(run)["resolution_path_analysis"]
    assert as_text(audits.read_audit(spark, str(tmp_path), "resolution_path_analysis"), want.columns) == as_text(want, want.columns)


def test_file_to_clean_table(spark, ticket_file, sample_sites):
    raw = files.read_tickets(spark, [ticket_file])
    rows = Cleaning(raw, sample_sites, ["TICKETID"], infer=False).clean.collect()
    assert [(r["TICKETID"], r["DISPATCH_DELAY_HOURS"], r["SLA_Compliant"]) for r in rows] == [("T1", 1.0, 1)]


def test_stored_and_checkpointed_tables_have_no_lineage(spark, sample_clean):
    for table in (stored(sample_clean, "t"), checkpointed(sample_clean)):
        assert table.count() == 22
        plan = table._jdf.queryExecution().optimizedPlan().toString()
        assert "LocalRelation" not in plan


def test_regions_with_volume(spark, sample_clean):
    areas = spark.createDataFrame([("1300000000", 1), ("9999", 7), ("100000000", 5), ("9999", 99)], "adm1_psgc string, file_number int")
    got = {r["Region Name"]: (r["Areas"], r["Ticket Volume"]) for r in regions_with_volume(areas, sample_clean).collect()}
    assert got == {"Region 3": (1, 22), "Region 4": (1, 0), "Region 1": (1, 0)}


@pytest.fixture
def small_splits(spark):
    """Files are read in splits of a few lines."""
    settings = {"spark.sql.files.maxPartitionBytes": "300", "spark.sql.files.openCostInBytes": "0", "spark.sql.files.minPartitionNum": "1"}
    for name, value in settings.items():
        spark.conf.set(name, value)
    yield
    for name in settings:
        spark.conf.unset(name)


def test_a_file_of_several_splits_reads_as_one(spark, tmp_path, small_splits):
    """Line breaks, separators, doubled and stray quotes in cells, wherever the splits fall."""
    rng = random.Random(2)
    pieces = ["a", "b c", "\n", "\t", '"', "é", "\n\n", "", "x" * 40]
    rows = [[str(k), *["".join(rng.choices(pieces, k=rng.randint(0, 5))).strip(" ") for _ in range(2)], "end"] for k in range(400)]
    path = tmp_path / "cells.tsv"
    with path.open("w", newline="", encoding="utf-8") as out:
        writer = csv.writer(out, delimiter="\t", lineterminator="\n")
        writer.writerow(["id", "one", "two", "last"])
        writer.writerows(rows)
        out.write('400\t5\'10" tall\t"closed"\tend\n')
    read = files._delimited(spark, str(path), "\t")
    assert spark.read.text(str(path)).rdd.getNumPartitions() > 20
    found = {r["id"]: [r["one"] or "", r["two"] or "", r["last"]] for r in read.collect()}
    assert found == {k: own for k, *own in rows} | {"400": ['5\'10" tall', "closed", "end"]}
    assert files.bad_lines(spark, str(path)).count() == 0


@pytest.mark.parametrize("lines, good, bad", [
    (["1\ta", "2\tb", "3\tc", '4\t"open', "5\tx"], ["1", "2", "3"], ['4\t"open', "5\tx"]),
    (["1\ta", '2\t"open', "3\tx", '4\t"fine"', "5\ty"], ["1", "5"], ['2\t"open\n3\tx\n4\t"fine"']),
    (['1\t"a\nb"', '2\t"c', 'd"\r', "3\te\r"], ["1", "2", "3"], []),
    (['1\t"a"', "", "2\tb\tc", '3\t"d" "e"'], ["1"], ["2\tb\tc", '3\t"d" "e"']),
])
def test_unclosed_quotes_and_what_they_reach_are_listed(spark, tmp_path, lines, good, bad):
    path = tmp_path / "open.tsv"
    path.write_text("\n".join(["id\tcell", *lines]) + "\n", newline="")
    assert sorted(r["id"] for r in files._delimited(spark, str(path), "\t").collect()) == good
    assert sorted(r["line"] for r in files.bad_lines(spark, str(path)).collect()) == bad


def test_a_cell_of_too_many_lines_is_listed_line_by_line(spark, tmp_path, monkeypatch, small_splits):
    monkeypatch.setattr(files.records, "MOST_LINES", 20)
    path = tmp_path / "long.tsv"
    path.write_text("\n".join(["id\tcell", '1\t"a', *["more of it"] * 30, 'end"', '2\t"b', 'c"', "3\td"]))
    assert sorted(r["id"] for r in files._delimited(spark, str(path), "\t").collect()) == ["2", "3"]
    assert files.bad_lines(spark, str(path)).count() == 32


def test_a_cluster_must_name_its_shared_folder():
    def session(master, **named):
        context = SimpleNamespace(master=master, getConf=lambda: {}, getCheckpointDir=lambda: None, setCheckpointDir=lambda folder: None)
        return SimpleNamespace(sparkContext=context, conf=SimpleNamespace(get=lambda name, default: named.get("folder", default)))

    for master in ("yarn", "spark://host:7077", "local-cluster[3,2,1024]", "k8s://host"):
        with pytest.raises(ValueError, match="spark.checkpoint.dir"):
            shared_folder(session(master))
        assert shared_folder(session(master, folder="s3://bucket/shared")) == "s3://bucket/shared"
    assert os.path.isdir(shared_folder(session("local[8]"))) and os.path.isdir(shared_folder(session("local")))
