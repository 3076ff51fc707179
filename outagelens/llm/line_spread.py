"""Line dedup by distinct-site spread: one HyperLogLog sketch per line, exact counts near the threshold."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from outagelens.llm.shared import SPACES, stored

#: A line found in so many sites is boilerplate.
SITES = 8
#: log2 of the registers of a sketch; its standard error is about 1.04 / 2 ** (LOG_REGISTERS / 2).
LOG_REGISTERS = 12
#: Lines whose estimate is within so many parts of the threshold, and one site at least, are counted exactly.
BAND = 0.1


def line_keys(text: Column) -> Column:
    """A key for every \\n-split line: 128 hashed bits of the line without outer spaces, null for a line without a word."""
    line = lambda x: F.btrim(x, F.lit(SPACES))
    key = lambda x: F.struct(F.xxhash64(line(x)).alias("a"), F.xxhash64(line(x), F.lit(1)).alias("b"))
    return F.transform(F.split(F.coalesce(text, F.lit("")), "\n"), lambda x: F.when(line(x) != "", key(x)))


def lines(docs: DataFrame) -> DataFrame:
    """(doc_id, text_hash, site, place, line) for the lines of every document that hold a word; places count from 0.

    A null source is a site of its own.
    """
    site = F.coalesce(F.concat(F.lit("s"), F.col("source")), F.lit("none"))
    # Two steps, so that a text is hashed once and not for each of its lines.
    hashed = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), site.alias("site"), line_keys(F.col("text")).alias("keys"))
    return hashed.select("doc_id", "text_hash", "site", F.posexplode("keys").alias("place", "line")).filter(F.col("line").isNotNull())


def boilerplate(found: DataFrame, sites: int = SITES) -> DataFrame:
    """(line, first_doc) of the lines found in at least `sites` distinct sites; first_doc is the least doc_id with it.

    One sketch per line, merged from the tasks' partial sketches, so a line in a third of all documents reaches the
    shuffle as one row per task. Lines with an estimate within BAND of the threshold get exact distinct counts from
    a second aggregation, over those lines only. Outside the band the estimate is many standard errors off the
    threshold and decides alone.
    """
    slack = max(1.0, BAND * sites)
    sketched = found.groupBy("line").agg(
        F.hll_sketch_estimate(F.hll_sketch_agg("site", LOG_REGISTERS)).alias("estimate"), F.min("doc_id").alias("first_doc"))
    likely = stored(sketched.filter(F.col("estimate") >= sites - slack), "likely")
    near = likely.filter(F.col("estimate") <= sites + slack).select("line")
    exact = found.join(near, "line", "left_semi").groupBy("line").agg(F.count_distinct("site").alias("sites"))
    sure = likely.filter(F.col("estimate") > sites + slack).select("line", "first_doc")
    counted = likely.join(exact.filter(F.col("sites") >= sites), "line", "left_semi").select("line", "first_doc")
    return sure.unionByName(counted)


def without_boilerplate(docs: DataFrame, sites: int = SITES) -> DataFrame:
    """row (all columns of docs), text and lines_removed (long): docs (doc_id, source, text, ...) without boilerplate lines.

    A line, compared without outer spaces, that holds a word and occurs in `sites` or more distinct sources goes from
    every document but the one with the least doc_id, so that no content is lost to the corpus; that document keeps
    its repeats of it. Where only rows without an id hold the line, they keep it. A row without an id loses a line
    that a row with an id has. The order of other lines stays, and lines without a word stay.
    Null text stays null, empty text empty; repeated rows are treated alike; a document may end empty but is not
    dropped; an empty table gives an empty one. Other columns travel within `row`.
    """
    found = stored(lines(docs.select("doc_id", "source", "text")), "lines")
    spread = stored(boilerplate(found, sites), "boilerplate")
    numbered = found.select("doc_id", "text_hash", "place", "line")
    hits = numbered.join(spread, "line").filter(F.col("first_doc").isNotNull() & ~F.col("doc_id").eqNullSafe(F.col("first_doc")))
    own = hits.select(_id(F.col("doc_id"), F.col("text_hash")).alias("id"), "place")
    removed = stored(own.groupBy("id").agg(F.collect_set("place").alias("gone")), "hits")
    # One plan at every size: the documents that lose lines grow with the input, so they are never broadcast.
    rows = docs.select(F.struct("*").alias("row"), _id(F.col("doc_id"), F.xxhash64("text")).alias("id")).join(removed.hint("merge"), "id", "left")
    text = F.col("row.text")
    # The difference of two arrays is hashed, so a document's work grows with its lines, however many of them go.
    cut = rows.withColumn("split", F.when(F.col("gone").isNotNull(), F.split(text, "\n")))
    left = F.array_except(F.sequence(F.lit(0), F.size("split") - 1), F.col("gone"))
    stay = cut.withColumn("left", F.when(F.col("split").isNotNull(), left))
    return stay.select(
        "row", F.when(F.col("left").isNull(), text).otherwise(
            F.array_join(F.transform("left", lambda place: F.get("split", place)), "\n")).alias("text"),
        F.when(F.col("left").isNull(), F.lit(0)).otherwise(F.size("split") - F.size("left")).cast("long").alias("lines_removed"))


def _id(doc_id: Column, text_hash: Column) -> Column:
    """A key of the rows with one id, or none, and one text: what it loses are lines of that text only.

    Which lines go depends on the id and the line, so texts whose hashes collide still lose the right ones.
    """
    return F.concat(F.coalesce(doc_id.cast("string"), F.lit("none")), F.lit(" "), text_hash.cast("string"))


def deduplicated(docs: DataFrame, sites: int = SITES) -> DataFrame:
    """docs with the shorter texts, in their own columns; n_chars, where there is one, follows the text."""
    done = without_boilerplate(docs, sites)
    new = {"text": F.col("text"), "n_chars": F.length("text").cast("long")}
    return done.select(*[
        new[c].alias(c) if c in new else F.col("row")[c].alias(c) for c in docs.columns])


def report(docs: DataFrame) -> DataFrame:
    """doc_id, the text that is left, lines_removed."""
    return without_boilerplate(docs.select("doc_id", "source", "text")).select("row.doc_id", "text", "lines_removed")


REPORT_SQL = f"""
WITH split AS (
  SELECT doc_id, source, unnest(string_split(text, chr(10))) AS line,
         generate_subscripts(string_split(text, chr(10)), 1) AS pos
  FROM documents
), keyed AS (
  SELECT doc_id, source, pos, line, trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS k FROM split
), spread AS (
  SELECT k, min(doc_id) AS first_doc FROM keyed WHERE k <> ''
  GROUP BY k HAVING count(DISTINCT coalesce('s' || source, 'none')) >= {SITES}
), marked AS (
  SELECT doc_id, pos, line, spread.k IS NOT NULL AND first_doc IS NOT NULL AND doc_id IS DISTINCT FROM first_doc AS gone
  FROM keyed LEFT JOIN spread USING (k)
), rebuilt AS (
  SELECT doc_id, coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '') AS text,
         count(*) FILTER (gone) AS lines_removed
  FROM marked GROUP BY doc_id
)
SELECT doc_id, CASE WHEN documents.text IS NULL THEN NULL ELSE rebuilt.text END AS text,
       CAST(coalesce(lines_removed, 0) AS BIGINT) AS lines_removed
FROM documents LEFT JOIN rebuilt USING (doc_id)
"""
