"""Registration of queries with their checking SQL."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from outagelens.registry.base_sql import BASE

DECIMALS = 6


@dataclass(frozen=True)
class Query:
    run: Callable[[SparkSession, str], DataFrame]
    sql: str | None


QUERIES: dict[str, Query] = {}


def rounded(df: DataFrame) -> DataFrame:
    """Doubles to six decimals, half to even: both engines add numbers up in their own order."""
    doubles = [f.name for f in df.schema.fields if isinstance(f.dataType, DoubleType)]
    return df.withColumns({name: F.bround(F.col(f"`{name}`"), DECIMALS) for name in doubles}) if doubles else df


def query(name: str, sql: str | None = None, base: bool = True):
    """Register a query; `sql` may use the tables of BASE unless base is false."""
    def register(run: Callable[[SparkSession, str], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"{name} is registered twice")
        text = None
        if sql is not None:
            text = f"WITH {BASE}\n{sql.strip()}" if base else sql.strip()
        QUERIES[name] = Query(lambda spark, folder: rounded(run(spark, folder)), text)
        return run

    return register
