"""SimHash near-duplicates: every fingerprint emits the ball of half the radius, and collisions are links."""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from outagelens.llm.shared import bounded_batches, spread, stored

SHINGLE = 3
RADIUS = 2
SEED = 42
#: Parts that the join on one node of the link graph is dealt over.
SALTS = 16


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """The 64-bit SimHash as a signed long: a bit is set where over half of the shingles' XXH64 have it.

    Words are runs of bytes other than space and U+0009 to U+000D, A-Z lower-cased; a shingle is so many words with
    single spaces between, repeats included. Fewer words: the whole sequence is one shingle. No word, or null: 0.
    """
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    hashes = np.array(_hashes(words, shingle), dtype=">u8")
    ones = np.zeros(64, dtype=np.int64)
    for at in range(0, len(hashes), 4096):  # bounds the unpacked bits of a very long text
        ones += np.unpackbits(hashes[at:at + 4096].view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes)).view(">u8")[0].astype(np.int64))


def _hashes(words: list[bytes], shingle: int) -> list[int]:
    digest = xxhash.xxh64_intdigest
    if len(words) <= shingle:
        return [digest(b" ".join(words), SEED)]
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = np.concatenate(([0], ends[:-1]))
    return [digest(joined[a:b], SEED) for a, b in zip(starts[:len(words) - shingle + 1].tolist(), (ends[shingle - 1:] - 1).tolist())]


def fingerprint_column(text: Column, shingle: int = SHINGLE) -> Column:
    @F.pandas_udf("long")
    def of(texts: pd.Series) -> pd.Series:
        return pd.Series([fingerprint(t, shingle) for t in texts], dtype="int64")

    return of(text)


def ball(radius: int) -> list[int]:
    """The masks, as signed longs, of all changes of up to `radius` bits."""
    masks = [sum(1 << bit for bit in chosen) for n in range(radius + 1) for chosen in combinations(range(64), n)]
    return [m - (1 << 64) if m >= 1 << 63 else m for m in masks]


def links(fingerprints: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Links (high, low) between the distinct values of `fingerprint` that connect all pairs within `radius` bits.

    Each fingerprint emits all variants within half the radius, rounded up. Two fingerprints within the radius share
    a variant; the members of a variant are linked to its least member, not to each other, once the distance is
    verified. For an even radius members of one variant are always within the radius, so nothing is lost; for an odd
    one the pairs of a variant are verified each. A variant has at most as many members as the ball has points
    (65 for radius 2), whatever the input. Empty input gives no link.
    """
    masks = F.array(*[F.lit(m) for m in ball((radius + 1) // 2)])
    # Each row becomes a whole ball, so Spark's estimate from the small input must not merge these partitions.
    parts = int(fingerprints.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    member = fingerprints.repartition(parts).select("fingerprint", F.explode(masks).alias("mask")).select(
        "fingerprint", F.col("fingerprint").bitwiseXOR(F.col("mask")).alias("variant"))
    members = member.groupBy("variant").agg(F.sort_array(F.collect_list("fingerprint")).alias("members"))
    shared = members.filter(F.size("members") > 1)
    if radius % 2 == 0:
        pairs = shared.select(F.explode("members").alias("high"), F.col("members")[0].alias("low"))
    else:
        pairs = shared.select(F.posexplode("members").alias("at", "high"), "members").select(
            "high", F.explode(F.slice("members", F.lit(1), F.col("at"))).alias("low"))
    near = F.bit_count(F.col("high").bitwiseXOR(F.col("low"))) <= radius
    return pairs.filter((F.col("high") != F.col("low")) & near).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node of `edges` (high, low): root is the least node of its component.

    Alternates two star operations until nothing changes: large-star points the larger neighbours of a node to its
    least neighbour, small-star does so with the smaller ones and the node itself. Each round is stored, so a lost
    executor repeats one round only. Joins on a node are salted: a node with very many neighbours is dealt over
    SALTS tasks, against the table of one row per node repeated as often.
    """
    edges, state = stored(edges, "edges"), None
    while True:
        found = edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("high", "low"))).first()
        if found == state:
            return edges.select(F.col("high").alias("node"), F.col("low").alias("root")).unionByName(
                edges.select(F.col("low").alias("node"), F.col("low").alias("root")).distinct())
        state = found
        both = edges.select(F.col("low").alias("node"), F.col("high").alias("other")).unionByName(
            edges.select(F.col("high").alias("node"), F.col("low").alias("other")))
        least = both.groupBy("node").agg(F.min("other").alias("least")).filter(F.col("least") < F.col("node"))
        large = _salted(edges.select(F.col("low").alias("node"), F.col("high").alias("other")), least).select(
            F.col("other").alias("high"), F.coalesce("least", "node").alias("low")).distinct()
        least = large.groupBy(F.col("high").alias("node")).agg(F.min("low").alias("least"))
        moved = _salted(large.select(F.col("high").alias("node"), F.col("low").alias("other")), least)
        small = moved.select(F.col("other").alias("high"), F.col("least").alias("low")).unionByName(
            least.select(F.col("node").alias("high"), F.col("least").alias("low")))
        edges = stored(small.filter(F.col("high") != F.col("low")).distinct(), "edges")


def _salted(edges: DataFrame, least: DataFrame) -> DataFrame:
    """edges (node, other) with the `least` of node, null where it has none."""
    dealt = edges.withColumn("salt", spread(F.col("other"), SALTS))
    copies = least.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
    return dealt.join(copies, ["node", "salt"], "left")


def classes(fingerprints: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(node, root) of every distinct value of `fingerprint`: the root is the least fingerprint reachable over links."""
    nodes = fingerprints.select("fingerprint").distinct()
    linked = components(links(nodes, radius))
    return nodes.select(F.col("fingerprint").alias("node")).join(linked, "node", "left").select(
        "node", F.coalesce("root", "node").alias("root"))


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """doc_id, fingerprint (long) and component_id of every row of docs (doc_id, text, ...).

    component_id is the least doc_id among the rows whose fingerprints are reachable over links of up to `radius`
    differing bits. Rows without words have fingerprint 0, linked like any other. Repeated rows are kept, each with
    the same result; a component whose ids are all null has a null component_id; an empty table gives an empty one.

    Python works out fingerprints, once; they are stored, 16 bytes a row. All else runs on distinct fingerprints,
    so a group of exact copies is one node whatever its size.
    """
    bounded_batches(docs.sparkSession)
    prints = stored(docs.select("doc_id", fingerprint_column(F.col("text"), shingle).alias("fingerprint")), "fingerprints")
    return prints.join(_resolved(prints, F.col("doc_id"), radius), "fingerprint").select(
        "doc_id", "fingerprint", F.col("first").alias("component_id"))


def _resolved(prints: DataFrame, value: Column, radius: int) -> DataFrame:
    """fingerprint and first: the least `value` of the rows in its component."""
    firsts = prints.groupBy(F.col("fingerprint").alias("node")).agg(F.min(value).alias("first"))
    rooted = stored(classes(prints, radius).join(firsts, "node"), "rooted")
    least = stored(rooted.groupBy("root").agg(F.min("first").alias("first")), "least")
    return stored(rooted.select(F.col("node").alias("fingerprint"), "root").join(least, "root").drop("root"), "classes")


def kept(docs: DataFrame, shingle: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """One row of each group of near-duplicates, in the columns of docs: that of the least doc_id.

    Null ids come last; rows that share an id are told apart by hashed text, and of rows equal in both one stays.
    Other columns travel within a struct, so their names cannot clash.
    """
    bounded_batches(docs.sparkSession)
    number = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id"), F.xxhash64("text").alias("text_hash"))
    prints = stored(docs.select(number.alias("number"), fingerprint_column(F.col("text"), shingle).alias("fingerprint")),
                    "fingerprints")
    first = _resolved(prints, F.col("number"), radius).select(_key(F.col("first")).alias("key")).distinct()
    rows = docs.select(F.struct("*").alias("row"), _key(number).alias("key"))
    once = rows.join(stored(first, "kept"), "key", "left_semi")
    at = F.row_number().over(Window.partitionBy("key").orderBy("key"))
    return once.withColumn("at", at).filter(F.col("at") == 1).select("row.*")


def _key(number: Column) -> Column:
    return F.concat_ws("/", F.coalesce(number["doc_id"].cast("string"), F.lit("none")), F.hex(number["text_hash"]))


def report(docs: DataFrame) -> DataFrame:
    """doc_id, the fingerprint as 16 lower-case hex digits, component_id."""
    return near_duplicates(docs).select(
        "doc_id", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), "component_id")
