"""Records of delimited text whose quoted cells may hold line breaks, read by many tasks per file.

A line takes the reader from one state, outside or inside a quoted cell, to another. Most leave it as it is, an opening
or closing quote swaps it, and a line that both closes and opens cells sets it. Such steps can be joined in any
grouping, so every split of a file works out its own step, a scan over the splits says in which state each begins, and
the lines of a split follow from there.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from outagelens.operators.scans import running_sums
from outagelens.sources.checkpoints import stored

#: Lines of one record; what goes on longer is taken for a quote that nothing closes.
MOST_LINES = 10_000
#: Where a record begins, in file order.
PLACE = "_place"
RECORD = "_record"

_QUOTED = '"[^"]*+(?:""[^"]*+)*+'


def _cell(separator: str, strict: bool) -> str:
    """A closed cell; a strict one has no further quote behind its closing one."""
    other = f"[^{separator}{'\"' if strict else ''}]*+"
    return f'[ ]*+(?:{_QUOTED}"{other}|[^"{separator}][^{separator}]*+|)'


def _escaped(separator: str) -> str:
    return re.escape(separator)


def opens(line: Column, separator: str) -> Column:
    """Whether a line that begins outside a quoted cell ends inside one."""
    s = _escaped(separator)
    return line.rlike(f"^(?:{_cell(s, False)}{s})*+[ ]*+{_QUOTED}$")


def stays(line: Column, separator: str) -> Column:
    """Whether a line that begins inside a quoted cell ends inside one, the same or another."""
    s = _escaped(separator)
    return line.rlike(f'^[^"]*+(?:""[^"]*+)*+(?:$|"[^{s}]*+{s}(?:{_cell(s, False)}{s})*+[ ]*+{_QUOTED}$)')


def cells(record: Column, separator: str) -> Column:
    """How many cells a whole record has."""
    s = _escaped(separator)
    unquoted = F.regexp_replace(record, f'(^|{s})[ ]*+{_QUOTED}"', "$1")
    return F.length(unquoted) - F.length(F.replace(unquoted, F.lit(separator), F.lit(""))) + 1


def malformed(record: Column, separator: str) -> Column:
    """Whether a quoted cell isn't closed, or another quote follows its closing one."""
    s = _escaped(separator)
    return ~record.rlike(f"^(?:{_cell(s, True)}{s})*+{_cell(s, True)}$")


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, block, seq, line): the split that a line begins in, and its order there."""
    return spark.read.option("lineSep", "\n").text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("seq"), F.regexp_replace("value", "\r$", "").alias("line"))


def _with_steps(lines: DataFrame, separator: str) -> DataFrame:
    """With what each line does to the state (`swap`, or `set` to a state), and swaps and the last setting up to it."""
    quoted = F.contains("line", F.lit('"'))
    upto = Window.partitionBy("file", "block").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    out, inside = opens(F.col("line"), separator), stays(F.col("line"), separator)
    steps = lines.withColumn("out", quoted & out).withColumn("inside", ~quoted | inside)
    steps = steps.withColumn("swap", (F.col("out") & ~F.col("inside")).cast("int")).withColumn(
        "set", F.when(F.col("out") == F.col("inside"), F.col("out")))
    return steps.withColumn("swaps", F.sum("swap").over(upto)).withColumn(
        "last", F.last(F.when(F.col("set").isNotNull(), F.struct("set", "swaps", "seq")), ignorenulls=True).over(upto))


def _state(begins: Column, last: Column, swaps: Column) -> Column:
    """The state after so many swaps, of which the last setting may cancel some."""
    since = F.when(last.isNull(), swaps).otherwise(swaps - last["swaps"])
    return F.coalesce(last["set"], begins) != (since % 2 == 1)


def blocks(lines: DataFrame, separator: str) -> DataFrame:
    """(file, block, begins, ends, opened): the state that each split begins and ends in, and whether any line of it opens.

    Only lines with a quote take part, and of those only how they change the state.
    """
    steps = _with_steps(lines.filter(F.contains("line", F.lit('"'))), separator)
    own = steps.groupBy("file", "block").agg(
        F.max("swaps").alias("swaps"), F.max_by("last", "seq").alias("last"), F.max("out").alias("opened"))
    every = lines.select("file", "block").distinct().join(own, ["file", "block"], "left")
    # The same joining of steps as within a split, now with a split for a line.
    upto = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, 0)
    net = F.when(F.col("last").isNull(), F.coalesce("swaps", F.lit(0))).otherwise(F.lit(0))
    ends = F.when(F.col("last").isNotNull(), _state(F.lit(False), F.col("last"), F.col("swaps")))
    scanned = every.withColumn("total", F.sum(net).over(upto)).withColumn(
        "fixed", F.last(F.when(ends.isNotNull(), F.struct(ends.alias("set"), F.col("total").alias("swaps"))), ignorenulls=True).over(upto))
    after = scanned.withColumn("ends", _state(F.lit(False), F.col("fixed"), F.col("total")))
    before = Window.partitionBy("file").orderBy("block")
    return after.select("file", "block", F.coalesce(F.lag("ends").over(before), F.lit(False)).alias("begins"), "ends",
                        F.coalesce("opened", F.lit(False)).alias("opened"))


def raw_records(spark: SparkSession, path: str, separator: str) -> DataFrame:
    """(_place, _record, _open): the records of the files, and whether a record is a line that an unclosed quote reaches.

    Splits without any opening quote are read as they are; lines of the others are put in order and get their state.
    Only lines of records of several lines are gathered, at most MOST_LINES at a time. Where a file ends inside a
    cell, or a cell goes on for more lines, each of its lines is a record of its own, marked as open.
    """
    lines = _lines(spark, path)
    found = stored(blocks(lines, separator), "blocks")
    placed = lines.join(found.select("file", "block", "begins", (F.col("begins") | F.col("opened")).alias("broken")), ["file", "block"])
    place = F.struct("file", "block", "seq").alias(PLACE)
    plain = placed.filter("not broken").select(place, F.col("line").alias(RECORD), F.lit(False).alias("_open"))
    steps = _with_steps(placed.filter("broken"), separator)
    after = _state(F.col("begins"), F.col("last"), F.col("swaps"))
    order = Window.partitionBy("file", "block").orderBy("seq")
    states = steps.withColumn("after", after).withColumn("before", F.coalesce(F.lag("after").over(order), F.col("begins")))
    single = states.filter("not before and not after").select(place, F.col("line").alias(RECORD), F.lit(False).alias("_open"))
    several = states.filter("before or after").select("file", "block", "seq", "line", (~F.col("before")).cast("int").alias("starts"))
    numbered = stored(running_sums(several, ["file"], [F.col("block"), F.col("seq")], {"starts": "number"}), "several")
    sizes = numbered.groupBy("file", "number").agg(F.count("*").alias("size"))
    unclosed = found.groupBy("file").agg(F.max_by("ends", "block").alias("unclosed"))
    final = sizes.groupBy("file").agg(F.max("number").alias("final"))
    judged = stored(sizes.join(final, "file").join(unclosed, "file").select(
        "file", "number", ((F.col("size") > MOST_LINES) | F.col("unclosed") & (F.col("number") == F.col("final"))).alias("_open")), "judged")
    gathered = numbered.join(judged, ["file", "number"])
    one_by_one = gathered.filter("_open").select(place, F.col("line").alias(RECORD), "_open")
    parts = F.sort_array(F.collect_list(F.struct("block", "seq", "line")))
    joined = gathered.filter("not _open").groupBy("file", "number").agg(parts.alias("parts")).select(
        F.struct("file", F.col("parts")[0]["block"].alias("block"), F.col("parts")[0]["seq"].alias("seq")).alias(PLACE),
        F.array_join(F.transform("parts", lambda part: part["line"]), "\n").alias(RECORD), F.lit(False).alias("_open"))
    return plain.unionByName(single).unionByName(one_by_one).unionByName(joined)
