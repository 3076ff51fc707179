import pytest
from pyspark.sql import functions as F

from outagelens.registry import load
from outagelens.sources.star_tickets import clean_table

FOLDER = "/root/testdata/sf0.001"


def physical(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def plans(spark):
    return {name: physical(query.run(spark, FOLDER)) for name, query in load().items()}


def test_no_cross_joins_and_no_python_rows(plans):
    for word in ("CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython", "ArrowEvalPython", "MapInPandas"):
        assert [name for name, plan in plans.items() if word in plan] == []


def test_reports_read_only_the_columns_they_use(plans):
    scan = next(line for line in plans["mean_repair_time"].splitlines() if "ReadSchema" in line)
    assert "ReadSchema: struct<OUTAGEDURATION:double>" in scan


def test_filters_reach_the_scan(spark, capsys):
    load()["slow_causes"].run(spark, FOLDER).explain(mode="formatted")
    shown = capsys.readouterr().out.splitlines()
    assert "Field_Dispatch_Restored" in next(line for line in shown if "PushedFilters" in line)
    assert "ZONE" in next(line for line in shown if "PartitionFilters" in line)


def test_a_report_on_one_zone_reads_the_files_of_that_zone(spark):
    table = clean_table(spark, FOLDER)
    zone = table.groupBy("ZONE").count().orderBy("count").first()["ZONE"]
    every, own = set(table.inputFiles()), {
        r[0] for r in table.where(F.col("ZONE") == zone).select(F.input_file_name()).distinct().collect()}
    assert own < every and len(own) <= len(every) / 3
    files_read = table.where(F.col("ZONE") == zone)
    files_read.collect()
    metrics = files_read._jdf.queryExecution().executedPlan().collectLeaves().head().metrics()
    assert metrics.apply("numFiles").value() == len(own)


def test_rank_filters_limit_groups_before_the_shuffle(plans):
    for name in ("dedupe_first", "top_rows_per_zone", "top_causes"):
        assert plans[name].count("WindowGroupLimit") >= 2, name


def test_ranks_join_on_the_value(plans):
    joins = [line for line in plans["percentile_ranks"].splitlines() if "Join" in line and "coalesce(_value" in line]
    assert joins
