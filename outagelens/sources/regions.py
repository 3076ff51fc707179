"""Administrative areas, their operational regions and the ticket volume of each."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from outagelens import fixed_values as fixed
from outagelens.functions.rules import label_lookup, lookup, named


def region_number(admin_code: str, file_number: str) -> Column:
    """Region number of the administrative code, else the number of the source file."""
    return F.coalesce(F.expr(lookup(named(admin_code), fixed.ADMIN_CODE_TO_NUMBER)), F.col(file_number).cast("int"))


def operational_region(number: str) -> Column:
    return F.expr(label_lookup(named(number), fixed.REGION_NUMBERS))


def regions_with_volume(areas: DataFrame, tickets: DataFrame) -> DataFrame:
    """One row per operational region found in the areas, with its ticket count (0 without tickets)."""
    regions = (
        areas.withColumn("_number", region_number("adm1_psgc", "file_number"))
        .select(operational_region("_number").alias("Region Name"))
        .where(F.col("Region Name").isNotNull())
        .groupBy("Region Name")
        .agg(F.count("*").alias("Areas"))
    )
    volume = (
        tickets.where(F.col("Region").isNotNull())
        .groupBy(F.col("Region").alias("Region Name"))
        .agg(F.count("*").alias("Ticket Volume"))
    )
    return regions.join(volume, "Region Name", "left").fillna(0, ["Ticket Volume"])
