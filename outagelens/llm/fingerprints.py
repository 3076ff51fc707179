"""Document fingerprints from prefix polynomial hashes."""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from outagelens.llm.shared import bounded_batches, per_process

#: A Mersenne prime: products of two residues fit 64 bits, and reduction is a shift and an addition.
PRIME = (1 << 31) - 1
#: Two bases below PRIME; equality of spans is judged by both, 62 bits.
BASES = (1_103_515_245, 1_664_525_013)
#: Code points of the spans that a fingerprint samples; a shorter text is one span.
SPAN = 16
#: The sampled spans: the least 24-bit value in each of so many bins.
BINS = 64
EMPTY = (1 << 24) - 1
MIX = np.uint64(0x9E3779B97F4A7C15)


def _reduced(x: np.ndarray) -> np.ndarray:
    """x modulo PRIME, for x below 2 ** 62."""
    x = (x & PRIME) + (x >> 31)
    x = (x & PRIME) + (x >> 31)
    return np.where(x >= PRIME, x - PRIME, x)


def _powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base ** k and its inverse, for k up to n at least; grown by doubling and kept in the process."""
    table = per_process(f"powers-{base}", dict)
    if len(table.get("up", ())) <= n:
        for way, b in (("up", base), ("down", pow(base, -1, PRIME))):
            found = table.get(way, np.ones(1, np.int64))
            while len(found) <= n:
                found = np.concatenate((found, _reduced(found * pow(b, len(found), PRIME))))
            table[way] = found
    return table["up"], table["down"]


class Prefixes:
    """The prefix hashes of a text: any span's hash, and so any comparison of spans, in constant time."""

    def __init__(self, text: str | None = None, arrays: list[np.ndarray] | None = None):
        if arrays is None:
            codes = np.frombuffer((text or "").encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64) + 1
            arrays = []
            for base in BASES:
                up, _ = _powers(base, len(codes))
                sums = np.zeros(len(codes) + 1, np.int64)
                np.cumsum(_reduced(codes * up[:len(codes)]), out=sums[1:])
                arrays.append(_reduced(sums))
        self.arrays = arrays

    def __len__(self) -> int:
        return len(self.arrays[0]) - 1

    def spans(self, starts: np.ndarray, ends: np.ndarray, which: int = 0) -> np.ndarray:
        """Hashes, free of the place, of text[start:end] for all pairs, under one base."""
        sums = self.arrays[which]
        _, down = _powers(BASES[which], len(self))
        return _reduced(_reduced(sums[ends] - sums[starts] + PRIME) * down[starts])

    def span(self, start: int, end: int) -> tuple[int, int]:
        at, to = np.array([start]), np.array([end])
        return int(self.spans(at, to, 0)[0]), int(self.spans(at, to, 1)[0])

    def common(self, at: int, other: Prefixes, other_at: int) -> int:
        """The length of the longest common extension from two places, by binary search over equal spans."""
        low, high = 0, min(len(self) - at, len(other) - other_at)
        while low < high:
            middle = (low + high + 1) // 2
            if self.span(at, at + middle) == other.span(other_at, other_at + middle):
                low = middle
            else:
                high = middle - 1
        return low

    def spliced(self, keep: int, other: Prefixes, take: int) -> Prefixes:
        """The prefixes of text[:keep] + other[:take], without hashing either again."""
        arrays = []
        for which, base in enumerate(BASES):
            up, _ = _powers(base, keep)
            moved = _reduced(other.arrays[which][1:take + 1] * up[keep])
            arrays.append(np.concatenate((self.arrays[which][:keep + 1], _reduced(moved + self.arrays[which][keep]))))
        return Prefixes(arrays=arrays)


def least_spans(text: Prefixes, start: int, end: int) -> np.ndarray:
    """For each bin, the least value of the SPAN-long spans that begin from start up to end."""
    bins = np.full(BINS, EMPTY, np.int64)
    length = min(SPAN, len(text))
    end = min(end, len(text) - length + 1) if length else 0
    if start < end:
        starts = np.arange(start, end)
        mixed = text.spans(starts, starts + length).astype(np.uint64) * MIX
        np.minimum.at(bins, (mixed >> np.uint64(58)).astype(np.int64),
                      np.minimum((mixed >> np.uint64(34)).astype(np.int64) & EMPTY, EMPTY - 1))
    return bins


def written(text: Prefixes, bins: np.ndarray) -> str:
    """16 hex digits of the whole text's two hashes, and six of each bin; equal texts give equal strings."""
    whole = "".join(f"{h:08x}" for h in text.span(0, len(text))) if len(text) else "0" * 16
    return whole + "".join([f"{b:06x}" for b in bins.tolist()])


def fingerprint(text: str | None) -> str:
    """The fingerprint of a text; null is empty, and an empty text has no span in any bin."""
    prefixes = Prefixes(text)
    return written(prefixes, least_spans(prefixes, 0, len(prefixes)))


def likeness(one: str, two: str) -> float:
    """How alike two fingerprints are, 0 to 1: 1 if equal, else the share of bins with the same least span.

    It estimates what share of the distinct spans of either text both have; bins that neither text fills don't count.
    """
    if one == two:
        return 1.0
    first, second = (np.array([int(f[k:k + 6], 16) for k in range(16, len(f), 6)]) for f in (one, two))
    return _alike(first, second)


def _alike(first: np.ndarray, second: np.ndarray) -> float:
    filled = (first != EMPTY) | (second != EMPTY)
    return float((first == second)[filled].mean()) if filled.any() else 0.0


# ---- the edited texts: each document with the next one's beginning in place of its last third

_RESULT = pa.schema([("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()),
                     ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64()),
                     ("common_chars", pa.int64())])


class _Document:
    """A text with its prefixes and fingerprint."""

    def __init__(self, doc_id: int | None, text: str | None):
        self.doc_id, self.text = doc_id, text or ""
        self.prefixes = Prefixes(self.text)
        self.keep = len(self.text) - len(self.text) // 3
        # Spans that lie in the part that an edit keeps are shared with the edited text.
        self.shared = max(0, self.keep - SPAN + 1) if len(self.text) >= SPAN else 0
        self.head = least_spans(self.prefixes, 0, self.shared)
        self.bins = np.minimum(self.head, least_spans(self.prefixes, self.shared, len(self.text)))
        self.fingerprint = written(self.prefixes, self.bins)

    def row(self, following: _Document) -> tuple:
        take = min(len(self.text) - self.keep, len(following.text))
        edited = self.prefixes.spliced(self.keep, following.prefixes, take)
        shared = self.shared if len(edited) >= SPAN else 0
        bins = least_spans(edited, shared, len(edited))
        if shared:
            bins = np.minimum(self.head, bins)
        text = self.text[:self.keep] + following.text[:take]
        mark = written(edited, bins)
        return (self.doc_id, len(self.text), hashlib.sha256(text.encode()).hexdigest(), self.fingerprint, mark,
                1.0 if mark == self.fingerprint else _alike(self.bins, bins),
                1.0 if following.fingerprint == self.fingerprint else _alike(self.bins, following.bins),
                self.prefixes.common(0, edited, 0))


def _pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (range, guest, doc_id, text), in order: each row that is no guest, with the one after it in its range."""
    before: tuple[int, _Document] | None = None
    for batch in batches:
        out = []
        for part, guest, doc_id, text in zip(*(c.to_pylist() for c in batch.columns)):
            if guest and (before is None or before[0] != part):
                continue  # a second copy of a guest
            document = _Document(doc_id, text)
            if before is not None and before[0] == part:
                out.append(before[1].row(document))
            before = None if guest else (part, document)
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), _RESULT)], schema=_RESULT)


class _Ranges:
    """Numbered ranges of rows (key, hash), keys descending and hashes ascending."""

    def __init__(self, cuts: list[int], inner: dict[int, list[int]]):
        """cuts begin a range each, the rows up to that key; inner are hashes that begin further ranges within a key."""
        self.bounds = np.array(sorted(set(cuts)), np.int64)
        self.inner = {key: np.array(sorted(set(hashes)), np.int64) for key, hashes in inner.items()}
        more = [len(self.inner.get(key, ())) for key in self.bounds[::-1].tolist()]
        #: By the number of bounds that a key is not above: the range of lower keys, which follow the last bound's own rows.
        self.lower = np.arange(len(self.bounds) + 1) + np.concatenate(([0], np.cumsum(more, dtype=np.int64)))

    def __len__(self) -> int:
        return int(self.lower[-1]) + 1

    def parts(self, keys: np.ndarray, hashes: np.ndarray) -> np.ndarray:
        found = self.lower[len(self.bounds) - np.searchsorted(self.bounds, keys, side="left")]
        for key, begins in self.inner.items():
            own = np.flatnonzero(keys == key)
            found[own] += np.searchsorted(begins, hashes[own], side="right") - len(begins)
        return found


def _inner(keyed: DataFrame, times: Counter, parts: int) -> dict[int, list[int]]:
    """For each key that is there more than once among the cuts: the hashes that divide its rows into as many ranges."""
    hot = {key: n for key, n in times.items() if n > 1}
    if not hot:
        return {}
    at = [k / parts for k in range(1, parts)]
    rows = keyed.filter(F.col("key").isin(list(hot))).groupBy("key").agg(
        F.percentile_approx("hash", at, max(10_000, 10 * parts)).alias("hashes")).collect()
    return {key: [hashes[k * parts // hot[key] - 1] for k in range(1, hot[key])] for key, hashes in rows}


def edits(docs: DataFrame) -> DataFrame:
    """Fingerprints of every document and of its edited text; the columns are those of the schema below.

    The last floor(n_chars / 3) code points go, and as many of the next document's first ones (or all) come. The next
    document is the one with the next lower doc_id; after the last comes the first. Null ids come last, and rows with
    one id follow their hashed texts. Null text is empty; one document alone is its own next; an empty table gives an
    empty one. Other columns are not read. common_chars is the longest common extension of both texts from their
    starts.

    Documents are dealt over ranges of their ids, at quantiles of all ids, and each range also gets the first
    document of the next range as a guest. An id, or none, that several quantiles fall on is cut further at quantiles
    of its hashed texts, so its rows span as many ranges; only rows with one id and one text stay together. So texts are
    shuffled once, a task reads its range as a stream and holds two documents, and the driver holds a few numbers for
    each range.
    """
    spark = bounded_batches(docs.sparkSession)
    lowest = -(1 << 63)
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").withColumns(
        {"key": F.coalesce(F.col("doc_id").cast("long"), F.lit(lowest)), "hash": F.xxhash64("text")})
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    at = [k / parts for k in range(1, parts)]
    cuts = keyed.select("key").agg(F.percentile_approx("key", at, max(10_000, 10 * parts))).first()[0] if at else []
    dealing = _Ranges(cuts or [], _inner(keyed, Counter(cuts or []), parts))

    @F.pandas_udf("int")
    def part_of(keys: pd.Series, hashes: pd.Series) -> pd.Series:
        return pd.Series(dealing.parts(keys.to_numpy(np.int64), hashes.to_numpy(np.int64)), dtype="int32")

    # ~key orders as the descending key does, and fits a long for every key.
    starts = keyed.select(F.struct(F.bitwise_not("key").alias("down"), "hash").alias("start"), part_of("key", "hash").alias("part"))
    firsts = {part: (~start.down, start.hash) for part, start in starts.groupBy("part").agg(F.min("start")).collect()}
    order = sorted(firsts)
    hosts = {firsts[part]: order[k - 1] for k, part in enumerate(order)}

    @F.pandas_udf("int")
    def host_of(keys: pd.Series, hashes: pd.Series) -> pd.Series:
        return pd.Series([hosts.get(row, -1) for row in zip(keys.tolist(), hashes.tolist())], dtype="int32")

    dealt = keyed.withColumn("part", part_of("key", "hash")).withColumn("host", host_of("key", "hash"))
    places = F.array_compact(F.array(
        F.struct(F.col("part").alias("part"), F.lit(False).alias("guest")),
        F.when(F.col("host") >= 0, F.struct(F.col("host").alias("part"), F.lit(True).alias("guest")))))
    rows = dealt.select("doc_id", "text", "key", "hash", F.explode(places).alias("place"))
    ordered = rows.repartitionById(len(dealing), F.col("place.part")).sortWithinPartitions(
        "place.part", "place.guest", F.col("key").desc(), "hash")
    return ordered.select("place.part", "place.guest", "doc_id", "text").mapInArrow(
        _pairs, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
                "near_edited double, near_next double, common_chars long")
