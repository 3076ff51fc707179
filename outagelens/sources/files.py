"""Ticket and site files: readers with their column contracts, table writers."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from outagelens import fixed_values as fixed
from outagelens.functions.rules import case_when, is_any, named
from outagelens.operators.dedupe import keep_first
from outagelens.schemas import CLEAN_TICKETS, SITES
from outagelens.sources import records
from outagelens.sources.records import PLACE, RECORD


def path_exists(spark: SparkSession, path: str) -> bool:
    try:
        spark.read.text(path)
    except AnalysisException as problem:
        if "PATH_NOT_FOUND" in str(problem.getCondition()):
            return False
        raise
    return True


def first_existing(spark: SparkSession, paths: list[str]) -> str:
    for path in paths:
        if path_exists(spark, path):
            return path
    raise FileNotFoundError("None of these inputs exists: " + ", ".join(paths))


def require_columns(df: DataFrame, required: list[str]) -> DataFrame:
    missing = [name for name in required if name not in df.columns]
    if missing:
        raise ValueError(f"Missing required columns: {missing}")
    return df


def _options(separator: str) -> dict[str, str]:
    return {"sep": separator, "quote": '"', "escape": '"', "ignoreLeadingWhiteSpace": "true"}


def _records(spark: SparkSession, path: str, separator: str, multiline: bool) -> tuple[DataFrame, list[str]]:
    """All columns as text, named by the header, with the record's place and text and `_bad`.

    A record is bad with more cells than the header, with a quote that nothing closes, or with another quote behind a
    closing one. The text of whole records is judged, whichever columns a job reads later.
    """
    names = spark.read.options(**_options(separator), header="true").csv(path).columns
    columns = ", ".join(f"{named(name)} STRING" for name in names)
    if multiline:
        raw = records.raw_records(spark, path, separator)
    else:
        raw = spark.read.text(path).select(F.lit(None).alias(PLACE), F.col("value").alias(RECORD), F.lit(False).alias("_open"))
    header = spark.read.option("lineSep", "\n").text(path).limit(1).select(F.regexp_replace("value", "\r$", "")).scalar()
    lines = raw.where((F.col(RECORD) != header) & (F.trim(RECORD) != ""))
    parsed = F.from_csv(RECORD, columns, _options(separator)).alias("row")
    rows = lines.select(parsed, RECORD, PLACE, "_open").select("row.*", RECORD, PLACE, "_open")
    record = F.col(RECORD)
    bad = F.col("_open") | (records.cells(record, separator) > len(names)) | records.malformed(record, separator)
    cell = F.array(*[named(name) for name in names])
    blank = F.forall(cell, lambda x: F.coalesce(F.trim(x), F.lit("")) == "")
    return rows.withColumn("_bad", bad).where(F.col("_bad") | ~blank), names


def _delimited(spark: SparkSession, path: str, separator: str, multiline: bool = True, place: bool = False) -> DataFrame:
    """The good records; a record with fewer cells than the header is padded. With `place`, where each began."""
    rows, names = _records(spark, path, separator, multiline)
    return rows.where("NOT _bad").select(*[named(name) for name in names], *[PLACE] * place)


def bad_lines(spark: SparkSession, path: str, separator: str = "\t", multiline: bool = True) -> DataFrame:
    """The records that the reader skips; each line that an unclosed quote reaches is one."""
    rows, _ = _records(spark, path, separator, multiline)
    return rows.where("_bad").select(F.col(RECORD).alias("line"))


def read_tickets(spark: SparkSession, paths: list[str], separator: str = "\t", multiline: bool = True) -> DataFrame:
    """Raw tickets of the first path that exists; extra columns are kept.

    Quoted cells may hold line breaks; files are split all the same.  Pass
    multiline=False for files without such cells: every line is a record then.
    """
    lines = _delimited(spark, first_existing(spark, paths), separator, multiline)
    tickets = lines.select(
        *[
            F.expr(case_when([(is_any(named(name), fixed.MISSING_MARKERS), "NULL")], named(name))).alias(name)
            for name in lines.columns
        ]
    )
    require_columns(tickets, fixed.REQUIRED_COLUMNS)
    return tickets.withColumn("Priority", F.col("Priority").try_cast("double"))


def site_dimension(rows: DataFrame, order: list[str]) -> DataFrame:
    """One row per normalised site key: the first in the declared order."""
    require_columns(rows, fixed.SITE_COLUMNS)
    keyed = rows.withColumn("PLAID", F.upper(F.trim("PLAID")))
    return keep_first(keyed, ["PLAID"], order).select(*fixed.SITE_COLUMNS)


def read_sites(spark: SparkSession, paths: list[str], separator: str = ",") -> DataFrame:
    """Site dimension of the first path that exists, else an empty one.

    The file order decides which of two rows with one key is kept.
    """
    try:
        path = first_existing(spark, paths)
    except FileNotFoundError:
        return spark.createDataFrame([], SITES)
    lines = _delimited(spark, path, separator, place=True)
    require_columns(lines, fixed.SITE_COLUMNS)
    return site_dimension(lines, [PLACE])


#: The column that files of the clean table are told apart by, and the order within a file.
CLUSTERED, WITHIN = "ZONE", ["REPORTDATE", "TICKETID"]


def clustered(clean: DataFrame) -> DataFrame:
    """Clean tickets dealt by zone, a large zone over several tasks, and sorted by time within: a report on some zones
    reads only their files, and one on a period skips the row groups of other times."""
    return clean.hint("rebalance", F.col(CLUSTERED)).sortWithinPartitions(CLUSTERED, *WITHIN)


def write_clean(clean: DataFrame, path: str) -> int:
    """Write the clean table in its clustered layout; returns its row count."""
    return write_table(clustered(clean), path, partition_by=[CLUSTERED])


def read_clean(spark: SparkSession, path: str) -> DataFrame:
    """The clean table, in either layout, with its columns in the order of the schema."""
    table = spark.read.parquet(path)
    order = [name for name in CLEAN_TICKETS.names if name in table.columns]
    return table.select(*[F.col(named(name)) for name in [*order, *[c for c in table.columns if c not in order]]])


def write_table(df: DataFrame, path: str, file_format: str = "parquet", partition_by: list[str] | None = None) -> int:
    """Write a table and return its row count, observed during the write."""
    seen = Observation()
    writer = df.observe(seen, F.count("*").alias("rows")).write.mode("overwrite")
    if file_format == "csv":
        writer = writer.option("header", True)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.format(file_format).save(path)
    return seen.get["rows"]
