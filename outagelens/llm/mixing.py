"""Mixing sources to target weights by systematic sampling: prefix sums of expected copies, one offset per source."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from outagelens.llm.shared import SPACES, stored

#: Weights that the sources, in code point order with null last, take in turn.
WEIGHTS = (5, 2, 1)
#: A source's target stops at so many times its size.
MOST = 3
#: Blocks that one size class of one source is dealt over by document id and text.
BLOCKS = 256


def n_words(text: Column) -> Column:
    """How many maximal runs of characters other than the six spaces the text has; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(f"[^{SPACES}]+")), F.lit(0)).cast("long")


def unit(text: Column) -> Column:
    """A number from 0 up to 1 that depends on the text only: the first 52 bits of its MD5."""
    return F.conv(F.substring(F.md5(F.coalesce(text, F.lit("\0")).cast("binary")), 1, 13), 16, 10).cast("double") / F.lit(2.0**52)


def own_hash(doc_id: Column, text: Column) -> Column:
    """A hash of a row's id and text; rows equal in both share it."""
    parts = [F.coalesce(doc_id.cast("string"), F.lit("")), F.md5(F.coalesce(text, F.lit("")).cast("binary"))]
    return F.md5(F.concat_ws("/", *parts).cast("binary"))


def source_targets(sizes: DataFrame, weights=WEIGHTS, most: int = MOST) -> DataFrame:
    """A target for each row of `sizes` (source, source_size), one row per source.

    Water filling: every source gets level x weight, but at most `most` x its size, and the targets add up to all
    sizes. The level follows from sources sorted by limit over weight: the first prefix of full sources whose level
    does not exceed the next source's ratio is the right one. Sources come in code point order, null last, and take
    the weights in turn. Empty input gives no row; sources of size 0 get target 0.
    The windows run over one row per source, never over documents.
    """
    turn = F.pmod(F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1, F.lit(len(weights)))
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (turn + 1).cast("int"))
    ranked = sizes.withColumn("weight", weight).withColumn("limit", F.col("source_size") * float(most))
    by_ratio = Window.orderBy(F.col("limit") / F.col("weight"), F.col("source").asc_nulls_last())
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    onward = by_ratio.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    everything = Window.partitionBy().rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    total = F.sum("source_size").over(everything)
    level = (total - F.coalesce(F.sum("limit").over(before), F.lit(0.0))) / F.sum("weight").over(onward)
    leveled = ranked.withColumn("own_level", level)
    fits = F.when(F.col("own_level") <= F.col("limit") / F.col("weight"), F.col("own_level"))
    reached = F.max(fits).over(everything)
    filled = F.least(F.coalesce(F.col("level") * F.col("weight"), F.col("limit")), F.col("limit"))
    return leveled.withColumn("level", reached).withColumn("target", filled).drop("weight", "limit", "own_level", "level")


def with_copies(docs: DataFrame, weights=WEIGHTS, most: int = MOST) -> DataFrame:
    """row (all columns of docs), size, source_size, target and copies (long) of every row of docs (doc_id, text, source, ...).

    Every document of a source expects target / source size copies. Documents are ordered within their source by size
    class, block, size and a hash of id and text, expected copies are summed along that order, and a document is
    emitted once for each integer that its interval crosses; one offset per source shifts all intervals. So a
    document gets the rounded-down or rounded-up expected number, never over `most`, and sizes are evenly covered.
    The order depends on values only, so reruns agree; rows that agree in all of these are interchangeable.

    The prefix sum has two levels: positions within blocks (source, size class, hashed id and text), and totals of the
    blocks before, from a table of counts, stored once. A source with a third of all rows is dealt over all its blocks,
    whether or not its rows have ids.
    Null text has size 0; a null source is a source of its own, the last. A source without words gets no copies.
    An empty table gives an empty one. Other columns travel within `row`, so their names cannot clash.
    """
    block = ["source_key", "size_class", "size_head", "block"]
    order = ["size", "own_hash"]
    bits = F.bin(F.col("size"))
    sized = (
        docs.select(
            F.struct("*").alias("row"), "doc_id", "source", n_words(F.col("text")).alias("size"),
            own_hash(F.col("doc_id"), F.col("text")).alias("own_hash"))
        .withColumn("source_key", F.coalesce(F.concat(F.lit("s"), F.col("source")), F.lit("none")))
        .withColumn("size_class", F.length(bits)).withColumn("size_head", F.substring(bits, 1, 4))
        .withColumn("block", F.conv(F.substring("own_hash", 1, 4), 16, 10).cast("int") % BLOCKS)
    )
    counts = stored(sized.groupBy("source", *block).agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("words")), "blocks")
    along = Window.partitionBy("source_key").orderBy(*block[1:])
    starts = counts.withColumn("before", F.sum("n").over(along) - F.col("n"))
    sizes = counts.groupBy("source_key", "source").agg(F.sum("words").cast("long").alias("source_size"))
    targets = source_targets(sizes, weights, most).select(
        "source_key", "source_size", "target", unit(F.col("source")).alias("offset"))
    blocks = starts.join(targets, "source_key").select(*block, "before", "source_size", "target", "offset")
    within = Window.partitionBy(*block).orderBy(*[F.col(c).asc_nulls_last() for c in order])
    placed = sized.drop("source").withColumn("rank", F.row_number().over(within)).join(blocks, block)
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    upto = F.col("before") + F.col("rank")
    crossed = F.floor(upto * rate + F.col("offset")) - F.floor((upto - 1) * rate + F.col("offset"))
    return placed.select("row", "size", "source_size", "target", crossed.cast("long").alias("copies"))


def mixed(docs: DataFrame, weights=WEIGHTS, most: int = MOST) -> DataFrame:
    """The mix itself: every document as often as the sample takes it, in the columns of docs."""
    taken = with_copies(docs, weights, most).filter(F.col("copies") > 0)
    return taken.select("row", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies")))).select("row.*")


def report(docs: DataFrame) -> DataFrame:
    """doc_id, size, source_size, target and taken words of every document."""
    return with_copies(docs.select("doc_id", "text", "source")).select(
        "row.doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


REPORT_SQL = """
WITH sized AS (
  SELECT doc_id, source, text, CAST(coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0) AS BIGINT) AS size,
         md5(coalesce(CAST(doc_id AS VARCHAR), '') || '/' || md5(coalesce(text, ''))) AS h
  FROM documents
), sources AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY source
), weighed AS (
  SELECT *, [5.0, 2.0, 1.0][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3]::DOUBLE AS weight,
         source_size * 3.0::DOUBLE AS most
  FROM sources
), tried AS (
  SELECT *, (sum(source_size) OVER ()
             - coalesce(sum(most) OVER (ORDER BY most / weight, source NULLS LAST
                                        ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0))::DOUBLE
            / sum(weight) OVER (ORDER BY most / weight, source NULLS LAST
                                ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS own_level
  FROM weighed
), targets AS (
  SELECT source, source_size,
         least(coalesce((max(CASE WHEN own_level <= most / weight THEN own_level END) OVER ()) * weight, most), most) AS target,
         CAST(CAST('0x' || substr(md5(coalesce(source, chr(0))), 1, 13) AS BIGINT) AS DOUBLE) / 4503599627370496.0::DOUBLE AS start
  FROM tried
), ranked AS (
  SELECT s.*, row_number() OVER (
           PARTITION BY source
           ORDER BY length(bin(size)), substr(bin(size), 1, 4), CAST('0x' || substr(h, 1, 4) AS BIGINT) % 256, size, h) AS r
  FROM sized s
)
SELECT doc_id, size, targets.source_size, targets.target,
       CAST(size * (floor(r * (CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END) + start)
                    - floor((r - 1) * (CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END) + start)) AS BIGINT) AS taken
FROM ranked JOIN targets ON ranked.source IS NOT DISTINCT FROM targets.source
"""
