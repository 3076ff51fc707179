"""Quality reports of raw and clean tickets."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from outagelens import fixed_values as fixed
from outagelens.functions.nulls import not_in, present_and


def _repeats(key: str) -> Column:
    """Rows beyond the first of each key; rows without a key repeat each other."""
    missing = F.count_if(F.col(key).isNull())
    return F.count("*") - F.count_distinct(F.col(key)) - F.least(missing, F.lit(1))


def initial_quality(df: DataFrame, dealt: Iterable[str] = ()) -> DataFrame:
    """One row: issue counts of the raw table and a score that starts at 100.

    A row can count in several issues, and a missing value counts as invalid.  Rows are counted per ticket first; `dealt`
    names columns that the ticket id determines, and rows already dealt by them are not shuffled for it.
    """
    def count_when(column: str, issue) -> Column:
        if column not in df.columns:
            return F.lit(0).cast("long")
        return F.count_if(issue(F.col(column)))

    issues = {
        "blank_priority": count_when("Priority", lambda c: c.isNull()),
        "invalid_priority": count_when("Priority", lambda c: not_in(c, fixed.REPORTED_PRIORITIES)),
        "invalid_urgency": count_when("Urgency", lambda c: not_in(c, fixed.KEPT_URGENCIES)),
        "invalid_status": count_when("FT Status", lambda c: not_in(c, fixed.REPORTED_STATUSES)),
        "invalid_fault_types": count_when("Fault Type", lambda c: present_and(c == "INVALID")),
    }
    keyed = "TICKETID" in df.columns
    tickets = df.groupBy(*dealt, "TICKETID") if keyed else df.groupBy()
    per_ticket = tickets.agg(F.count("*").alias("_rows"), *[c.alias(name) for name, c in issues.items()])

    def total(counts: Column) -> Column:
        return F.coalesce(F.sum(counts), F.lit(0))

    rows = F.col("_rows")
    beyond = F.lit(0).cast("long")
    if keyed:  # rows without an id repeat each other, whatever they are dealt by
        missing = total(F.when(F.col("TICKETID").isNull(), rows))
        beyond = total(F.when(F.col("TICKETID").isNotNull(), rows - 1)) + F.greatest(missing - 1, F.lit(0))
    counted = per_ticket.agg(
        total(rows).alias("total_records"), beyond.alias("duplicate_tickets"), *[total(F.col(name)).alias(name) for name in issues])
    found = sum((F.col(name) for name in ["duplicate_tickets", *issues]), F.lit(0))
    score = F.bround(100 - found / F.col("total_records") * 100, 2)
    return counted.withColumn("quality_score", F.when(F.col("total_records") > 0, score).otherwise(F.lit(0.0)))


def validation_report(df: DataFrame) -> DataFrame:
    """The seven post-clean rules as (check, passed), from one aggregation."""
    def every(column: str, rule) -> Column:
        if column not in df.columns:
            return F.lit(True)
        return F.coalesce(F.bool_and(rule(F.col(column))), F.lit(True))

    def within(values: list):
        return lambda c: present_and(c.isin(values))

    missing = [c for c in fixed.VALIDATION_COLUMNS if c not in df.columns]
    outcomes = [
        F.lit(not missing),
        _repeats("TICKETID") == 0 if "TICKETID" in df.columns else F.lit(True),
        every("Region", within(fixed.REGION_ORDER)) if "Region" in df.columns else F.lit(False),
        every("SLA_Compliant", lambda c: c.isNull() | c.isin(0, 1)),
        every("OUTAGEDURATION", lambda c: present_and(c >= 0)),
        every("Priority_Urgency", within(list(fixed.SLA_HOURS))),
        every("Resolution_Path", within(fixed.PATH_ORDER)),
    ]
    results = df.agg(
        F.count("*").alias("_rows"),
        *[outcome.alias(f"_rule_{i}") for i, outcome in enumerate(outcomes)],
    )
    entries = [
        F.struct(F.lit(check).alias("check"), F.col(f"_rule_{i}").alias("passed"))
        for i, check in enumerate(fixed.VALIDATION_CHECKS)
    ]
    return results.select(F.inline(F.array(*entries)))


def overall_status(report: DataFrame) -> DataFrame:
    """PASS when every rule passed."""
    return report.agg(F.when(F.bool_and("passed"), "PASS").otherwise("FAIL").alias("overall_status"))


def table_profile(df: DataFrame) -> DataFrame:
    """Type, missing count and share, and distinct values per column.

    Values are counted per (column, 128-bit hash of the value) before they are
    counted as distinct, so no column is gathered in one task and no text is shuffled.
    """
    types = dict(df.dtypes)
    cells = df.select(
        F.inline(
            F.array(
                *[
                    F.struct(
                        F.lit(name).alias("Column"),
                        F.lit(types[name]).alias("DataType"),
                        F.md5(F.col(f"`{name}`").cast("string").cast("binary")).alias("value"),
                    )
                    for name in df.columns
                ]
            )
        )
    )
    values = cells.groupBy("Column", "DataType", "value").agg(F.count("*").alias("n"))
    return values.groupBy("Column", "DataType").agg(
        F.coalesce(F.sum(F.when(F.col("value").isNull(), F.col("n"))), F.lit(0)).alias("MissingCount"),
        (F.coalesce(F.sum(F.when(F.col("value").isNull(), F.col("n"))), F.lit(0)) / F.sum("n") * 100).alias(
            "MissingPercent"
        ),
        F.count("value").alias("UniqueValues"),
    )


def category_counts(df: DataFrame, columns: list[str]) -> DataFrame:
    """Value counts of several text columns in long form."""
    cells = df.select(
        F.inline(F.array(*[F.struct(F.lit(c).alias("Column"), F.col(f"`{c}`").alias("Value")) for c in columns]))
    )
    return cells.where(F.col("Value").isNotNull()).groupBy("Column", "Value").agg(F.count("*").alias("Count"))


def number_profile(df: DataFrame, columns: list[str]) -> DataFrame:
    """count, mean, std, min and max of number columns in long form."""
    cells = df.select(
        F.inline(
            F.array(*[F.struct(F.lit(c).alias("Column"), F.col(f"`{c}`").cast("double").alias("value")) for c in columns])
        )
    )
    return cells.groupBy("Column").agg(
        F.count("value").alias("n"),
        F.avg("value").alias("mean"),
        F.stddev_samp("value").alias("std"),
        F.min("value").alias("low"),
        F.max("value").alias("high"),
    )


def retention(initial: DataFrame, final: DataFrame) -> DataFrame:
    """Rows before and after cleaning and the share kept."""
    before = initial.agg(F.count("*")).scalar()
    return final.agg(F.count("*").alias("final_rows")).select(
        before.alias("initial_rows"), "final_rows", (F.col("final_rows") / before * 100).alias("retained_pct")
    )


def reconciled(kpis: DataFrame, expected: DataFrame, by: str, tolerances: dict[str, float]) -> DataFrame:
    """Actual against expected KPI per group with an in-tolerance flag, in long form."""
    want = expected.select(by, *[F.col(name).alias(f"_want_{name}") for name in tolerances])
    entries = [
        F.struct(
            F.lit(name).alias("metric"),
            F.col(name).cast("double").alias("actual"),
            F.col(f"_want_{name}").cast("double").alias("expected"),
            present_and(F.abs(F.col(name) - F.col(f"_want_{name}")) <= tolerance).alias("within"),
        )
        for name, tolerance in tolerances.items()
    ]
    return want.join(kpis, by, "left").select(by, F.inline(F.array(*entries)))
