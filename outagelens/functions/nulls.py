"""Predicates that decide what a missing value means."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def present_and(predicate: Column) -> Column:
    """The predicate, with a missing outcome read as false."""
    return F.coalesce(predicate, F.lit(False))


def absent_or(predicate: Column) -> Column:
    """The predicate, with a missing outcome read as true."""
    return F.coalesce(predicate, F.lit(True))


def not_in(column: Column, values: list) -> Column:
    """True for a value outside the list and for a missing value."""
    return ~present_and(column.isin(values))


def differs(column: Column, value) -> Column:
    """True unless the column holds exactly this value; missing differs."""
    return ~column.eqNullSafe(F.lit(value))
