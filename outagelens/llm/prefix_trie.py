"""Prefix trie of conversations by van Emde Boas recursion: sequences are cut at half their depth, the cuts named, both
halves built likewise, and totals of the lower forests grafted upward."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from outagelens.llm.shared import stored
from outagelens.operators.scans import running_sums

#: The name of the root, and the digest of no members.
ROOT = hashlib.md5(b"").digest()
NONE = hashlib.sha256(b"").hexdigest()
#: Turns that a conversation may take over from the first of its hundred.
SHARED, FAMILY = 6, 100
#: Characters of a joined list of members that travel in a row.
PIECE = 1 << 16


def _md5(*parts: Column) -> Column:
    return F.unhex(F.md5(F.concat(*parts)))


def rebuilt(conversations: DataFrame) -> DataFrame:
    """(conv_id, depth, turn_digest, chars, n_turns) of the rebuilt conversations' turns, and a row of depth 0 for each.

    Turns follow `turn`, null first, then a digest of role and text; null role or text is empty. A conversation takes
    the first h turns of the first one of its hundred, then its own after the first h; h is its id's crc32 modulo 6.
    Rows without a conv_id belong to no conversation. Texts don't travel: only their digests and lengths do.
    """
    role, text = (F.coalesce(F.col(name).cast("string"), F.lit("")) for name in ("role", "text"))
    own = conversations.filter("conv_id is not null").select(
        "conv_id", "turn", _md5(F.length(role).cast("string"), F.lit(":"), role, text).alias("turn_digest"),
        F.length(text).cast("long").alias("chars"), F.lit(1).alias("one"))
    placed = stored(running_sums(own, ["conv_id"], [F.col("turn").asc_nulls_first(), F.col("turn_digest")], {"one": "place"}).select(
        "conv_id", "place", "turn_digest", "chars"), "placed")
    sizes = stored(placed.groupBy("conv_id").agg(F.count(F.lit(1)).alias("size")).select(
        "conv_id", "size", (F.col("conv_id") - F.col("conv_id") % FAMILY).alias("base"),
        (F.crc32(F.col("conv_id").cast("string").cast("binary")) % SHARED).alias("h")), "sizes")
    taken = sizes.join(sizes.select(F.col("conv_id").alias("base"), F.col("size").alias("base_size")), "base", "left").withColumn(
        "taken", F.least("h", F.coalesce("base_size", F.lit(0))))
    taken = stored(taken.withColumn("n_turns", F.col("taken") + F.greatest(F.col("size") - F.col("h"), F.lit(0))), "taken")
    first = placed.filter(F.col("place") < SHARED).withColumnRenamed("conv_id", "base")
    heads = taken.select("conv_id", "base", "h", "n_turns").join(first, "base").filter(F.col("place") <= F.col("h")).select(
        "conv_id", F.col("place").alias("depth"), "turn_digest", "chars", "n_turns")
    tails = placed.join(taken.select("conv_id", "h", "taken", "n_turns"), "conv_id").filter(F.col("place") > F.col("h")).select(
        "conv_id", (F.col("place") - F.col("h") + F.col("taken")).alias("depth"), "turn_digest", "chars", "n_turns")
    roots = taken.select("conv_id", F.lit(0).cast("long").alias("depth"), F.lit(ROOT).alias("turn_digest"),
                         F.lit(0).cast("long").alias("chars"), "n_turns")
    return heads.unionByName(tails).unionByName(roots)


def named(turns: DataFrame) -> DataFrame:
    """`turns` (conv_id, depth, turn_digest, ...) with `name`: equal names where all turns up to there are equal.

    Digests of blocks of 2^k turns are paired up, level by level. Then, from the greatest level down, the cut in the
    middle of each block is named by the name of the block's top and the digest of its upper half: the halves of a
    conversation never meet in one row or task, and after as many rounds as the depth has bits each depth has a name.
    """
    height = _height(turns)
    blocks = [turns.filter("depth > 0").select("conv_id", F.col("depth").alias("block"), F.col("turn_digest").alias("digest"))]
    for _ in range(1, height):
        half = blocks[-1].groupBy("conv_id", F.floor((F.col("block") + 1) / 2).alias("block")).agg(
            F.max(F.when(F.col("block") % 2 == 1, F.col("digest"))).alias("upper"),
            F.max(F.when(F.col("block") % 2 == 0, F.col("digest"))).alias("lower"))
        blocks.append(stored(half.dropna().select("conv_id", "block", _md5("upper", "lower").alias("digest")), "blocks"))
    names = turns.filter("depth = 0").select("conv_id", "depth", F.lit(ROOT).alias("name"))
    for level in range(height - 1, -1, -1):
        size = 1 << level
        cut = blocks[level].filter("block % 2 = 1").select(
            "conv_id", (F.col("block") * size).alias("cut"), ((F.col("block") - 1) * size).alias("depth"), "digest")
        names = names.unionByName(stored(names.join(cut, ["conv_id", "depth"]).select(
            "conv_id", F.col("cut").alias("depth"), _md5("name", "digest").alias("name")), "names"))
    return turns.join(names, ["conv_id", "depth"])


def _height(turns: DataFrame) -> int:
    """The least k for which all depths are below 2^k."""
    return int(turns.agg(F.coalesce(F.max("depth"), F.lit(0))).first()[0]).bit_length()


def trie(turns: DataFrame) -> DataFrame:
    """The nodes over `turns` (conv_id, depth, turn_digest, chars, n_turns; a row of depth 0 per conversation).

    name, parent, conv_id (least member), depth, n_convs, n_children, and over its subtree n_leaves, saved_tokens;
    ends_sha256 of the members that end there. An empty table gives no node.
    """
    whole = stored(named(turns).select("conv_id", "depth", "name", "chars", "n_turns"), "named")
    names = whole.select("conv_id", "depth", F.col("name").alias("up"))
    grouped = whole.groupBy("depth", "name").agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_convs"), F.max("chars").alias("chars"))
    nodes = stored(_above(grouped, names, 0), "nodes")
    children = nodes.groupBy(F.col("up").alias("name")).agg(F.count(F.lit(1)).alias("n_children")).dropna(subset="name")
    known = stored(nodes.join(children, "name", "left").withColumn("n_children", F.coalesce("n_children", F.lit(0).cast("long"))), "known")
    totals = _totals(known, names, _height(turns))
    first = known.select(F.col("name").alias("up"), F.col("conv_id").alias("parent_conv_id"))
    ends = _digests(whole.filter("depth = n_turns").select("name", "conv_id"))
    return known.join(totals, "name").join(first, "up", "left").join(ends, "name", "left").select(
        "name", F.col("up").alias("parent"), "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens",
        F.coalesce("ends_sha256", F.lit(NONE)).alias("ends_sha256"))


def _above(nodes: DataFrame, names: DataFrame, level: int) -> DataFrame:
    """nodes with `up`, the name of the node 2^level turns above: null for the root."""
    size = 1 << level
    at = names.filter(F.col("depth") % size == 0).withColumn("depth", F.col("depth") + size)
    return nodes.join(at, ["conv_id", "depth"], "left")


def _totals(known: DataFrame, names: DataFrame, height: int) -> DataFrame:
    """(name, n_leaves, saved_tokens): each node's sums over its subtree.

    Upward, the sums over the next 2^k depths of nodes at multiples of 2^k double their reach, as those of the lower
    half's tops are grafted on the upper half's. Downward, the cut in each block's middle gets the whole subtree's sums:
    its own half's, and those of the next block's tops below it. Each node takes part in two rounds on average.
    """
    sums = ["n_leaves", "saved_tokens"]
    reach = [known.select("name", "depth", "conv_id", "up", (F.col("n_children") == 0).cast("long").alias("n_leaves"),
                          ((F.col("n_convs") - 1) * F.col("chars")).alias("saved_tokens"))]

    def grafted(upper: DataFrame, lower: DataFrame) -> DataFrame:
        """`upper` with the sums of the rows of `lower` whose `up` it is."""
        below = lower.groupBy(F.col("up").alias("name")).agg(*[F.sum(c).alias(f"_{c}") for c in sums])
        return upper.join(below, "name", "left").withColumns({c: F.col(c) + F.coalesce(f"_{c}", F.lit(0)) for c in sums}).drop(
            *[f"_{c}" for c in sums])

    for level in range(height):
        upper, lower = (reach[-1].filter(F.col("depth") % (2 << level) == middle) for middle in (0, 1 << level))
        reach.append(stored(_above(grafted(upper.drop("up"), lower), names, level + 1), "reach"))
    done = reach[-1].select("name", *sums)
    for level in range(height - 1, -1, -1):
        upper, lower = (reach[level].filter(F.col("depth") % (2 << level) == middle) for middle in (1 << level, 0))
        done = done.unionByName(stored(grafted(upper, lower.select("name", "up").join(done, "name")).select("name", *sums), "whole"))
    return done


def _digests(ends: DataFrame) -> DataFrame:
    """(name, ends_sha256) of the ids (name, conv_id), ascending, joined by commas.

    The ids are joined to pieces within ranges of (name, conv_id), so many members of one node are sorted and joined in
    several tasks; only the digest itself reads a node's pieces one after the other, as a stream.
    """
    parts = int(ends.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple[bytes, int, str]] = []
        name, first, held, size = None, 0, [], 0
        for batch in batches:
            for at, conv in zip(*(c.to_pylist() for c in batch.columns)):
                if at != name or size >= PIECE:
                    if held:
                        rows.append((name, first, ",".join(held)))
                    name, first, held, size = at, conv, [], 0
                held.append(str(conv))
                size += len(held[-1]) + 1
            yield _batch(rows, ["name", "first", "piece"], [pa.binary(), pa.int64(), pa.string()])
            rows.clear()
        if held:
            yield _batch([(name, first, ",".join(held))], ["name", "first", "piece"], [pa.binary(), pa.int64(), pa.string()])

    def digested(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, digest = None, None
        rows: list[tuple[bytes, str]] = []
        for batch in batches:
            for at, _, piece in zip(*(c.to_pylist() for c in batch.columns)):
                if at != name:
                    if digest:
                        rows.append((name, digest.hexdigest()))
                    name, digest = at, hashlib.sha256(piece.encode())
                else:
                    digest.update(b"," + piece.encode())
            yield _batch(rows, ["name", "ends_sha256"], [pa.binary(), pa.string()])
            rows.clear()
        if digest:
            yield _batch([(name, digest.hexdigest())], ["name", "ends_sha256"], [pa.binary(), pa.string()])

    pieces = ends.repartitionByRange(parts, "name", "conv_id").sortWithinPartitions("name", "conv_id").mapInArrow(
        joined, "name binary, first long, piece string")
    return pieces.repartition(parts, "name").sortWithinPartitions("name", "first").mapInArrow(digested, "name binary, ends_sha256 string")


def _batch(rows: list[tuple], names: list[str], kinds: list[pa.DataType]) -> pa.RecordBatch:
    columns = list(zip(*rows)) or [()] * len(names)
    return pa.record_batch([pa.array(c, k) for c, k in zip(columns, kinds)], names)


def report(conversations: DataFrame) -> DataFrame:
    """One row per node of the trie of the rebuilt conversations (see `rebuilt` for nulls, ties and repeated rows)."""
    turns = stored(rebuilt(conversations), "turns")
    return trie(turns).select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


#: What DuckDB says of the same rows.
REPORT_SQL = """
WITH numbered AS (
  SELECT conv_id, turn, coalesce(text, '') AS t, md5(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS m
  FROM conversations WHERE conv_id IS NOT NULL
), own AS (
  SELECT conv_id, list(m ORDER BY turn NULLS FIRST, m) AS ms, list(length(t) ORDER BY turn NULLS FIRST, m) AS cs
  FROM numbered GROUP BY conv_id
), hashed AS (  -- crc32, bit by bit
  SELECT *, CAST(xor(list_reduce(list_concat([4294967295::UBIGINT], list_transform(string_split(conv_id::VARCHAR, ''), lambda c: ord(c)::UBIGINT)),
    lambda crc, b: list_reduce(list_concat([xor(crc, b)], [0::UBIGINT, 0, 0, 0, 0, 0, 0, 0]),
                               lambda x, z: xor(x >> 1, 3988292384::UBIGINT * (x & 1)))), 4294967295::UBIGINT) % 6 AS BIGINT) AS h
  FROM own
), built AS (
  SELECT o.conv_id, list_concat(coalesce(b.ms[1:o.h], []), o.ms[o.h + 1:]) AS ms, list_concat(coalesce(b.cs[1:o.h], []), o.cs[o.h + 1:]) AS cs
  FROM hashed o LEFT JOIN own b ON b.conv_id = o.conv_id - o.conv_id % 100
), placed AS (SELECT *, unnest(range(0, len(ms) + 1)) AS depth FROM built),
members AS (
  SELECT conv_id, depth, array_to_string(ms[1:depth], '') AS node, CASE WHEN depth > 0 THEN cs[depth] ELSE 0 END AS chars, depth = len(ms) AS ended
  FROM placed
), nodes AS (
  SELECT node, depth, min(conv_id) AS conv_id, count(*) AS n_convs, max(chars) AS chars,
         sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (ended), '')) AS ends_sha256
  FROM members GROUP BY node, depth
), children AS (SELECT substr(node, 1, 32 * (depth - 1)) AS node, count(*) AS n FROM nodes WHERE depth > 0 GROUP BY 1),
up AS (
  SELECT substr(n.node, 1, 32 * k) AS node, c.n IS NULL AS leaf, (n.n_convs - 1) * n.chars AS saved
  FROM (SELECT *, unnest(range(0, depth + 1)) AS k FROM nodes) n LEFT JOIN children c ON c.node = n.node
), totals AS (SELECT node, count(*) FILTER (leaf) AS n_leaves, CAST(sum(saved) AS BIGINT) AS saved_tokens FROM up GROUP BY node)
SELECT n.conv_id, n.depth, p.conv_id AS parent_conv_id, n.n_convs, coalesce(c.n, 0) AS n_children, t.n_leaves, t.saved_tokens, n.ends_sha256
FROM nodes n JOIN totals t ON t.node = n.node LEFT JOIN children c ON c.node = n.node
LEFT JOIN nodes p ON n.depth > 0 AND p.node = substr(n.node, 1, 32 * (n.depth - 1))
"""
