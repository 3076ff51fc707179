"""Repeated substrings: interval expansion on Burrows-Wheeler transforms of the places where texts share an anchor."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from outagelens.llm.shared import Filter, bounded_batches, carried, stored

LENGTH = 200
#: Bytes of an anchor, a multiple of 8; each string of LENGTH bytes holds one that its own bytes determine.
GRAM = 40
#: Bytes of text whose anchors are looked for at a time, and bytes that one transform holds.
PORTION, POOL = 1 << 18, 1 << 18
#: Different pieces around one anchor that share a transform; where there are more, the anchor is widened.
BUCKET = 2000
#: A byte that UTF-8 never holds.
END = 255

SPANS = "array<struct<start:int,end:int>>"


# --- anchors -------------------------------------------------------------------------

def anchored(flat: np.ndarray, ends: np.ndarray, length: int = LENGTH, gram: int = GRAM, portion: int = PORTION):
    """The stretches of `flat`, texts that end at `ends`, whose strings of `length` bytes have the same anchor.

    (first, last, anchor): the first and last start of the strings, and the anchor's hash. A string's anchor is its
    gram of least hash, the first of equal ones, so equal strings have equal anchors at equal places. Every start from
    which `length` bytes of the text are left is in exactly one stretch; on average one begins every 80 bytes.
    """
    for first, last, _, anchor in _stretches(flat, ends, length, gram, portion):
        yield first, last, anchor


def _stretches(flat: np.ndarray, ends: np.ndarray, length: int = LENGTH, gram: int = GRAM, portion: int = PORTION):
    """As `anchored`, with the place where the anchor begins: (first, last, place, anchor)."""
    wide = length - gram + 1
    for at in range(0, max(0, len(flat) - length + 1), portion):
        part = flat[at:at + portion + length - 1]
        word = np.ndarray((len(part) - 7,), "<u8", part, strides=(1,)).copy()
        grams = len(part) - gram + 1
        hashed = np.zeros(grams, np.uint64)
        for k, odd in zip(range(0, gram, 8), _odd_numbers()):
            hashed += word[k:k + grams] * odd
        hashed ^= hashed >> np.uint64(32)
        hashed *= np.uint64(0xD6E8FEB86659FD93)
        hashed ^= hashed >> np.uint64(32)
        marked = (hashed & np.uint64(0xFFFFFFFF00000000)) | np.arange(grams, dtype=np.uint64)
        least = _sliding_minimum(marked, wide) & np.uint64(0xFFFFFFFF)
        starts = np.arange(at, at + len(least))
        text = np.searchsorted(ends, starts, side="right")
        fits = np.flatnonzero(ends[text] - starts >= length)
        if not len(fits):
            continue
        place = least[fits].astype(np.int64)
        new = np.append(True, place[1:] != place[:-1])
        first, last = fits[new], fits[np.append(np.flatnonzero(new)[1:] - 1, len(fits) - 1)]
        yield first + at, last + at, place[new] + at, hashed[place[new]].view(np.int64)


def _odd_numbers() -> Iterator[np.uint64]:
    """Multipliers for the words of a gram."""
    number = 0x9E3779B97F4A7C15
    while True:
        yield np.uint64(number | 1)
        number = number * 0xBF58476D1CE4E5B9 % (1 << 64)


def _sliding_minimum(values: np.ndarray, wide: int) -> np.ndarray:
    """The least of each `wide` values in a row, from the minima up to and from the borders of blocks as wide."""
    whole = np.full(-(-len(values) // wide) * wide, np.iinfo(np.uint64).max, np.uint64)
    whole[:len(values)] = values
    blocks = whole.reshape(-1, wide)
    upto = np.minimum.accumulate(blocks, axis=1).ravel()
    after = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    count = len(values) - wide + 1
    return np.minimum(after[:count], upto[wide - 1:wide - 1 + count])


def _bytes_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a binary column without nulls in one array, and where each value begins, with the end."""
    offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset:column.offset + len(column) + 1].astype(np.int64)
    data = column.buffers()[2]
    flat = np.frombuffer(data, np.uint8)[offsets[0]:offsets[-1]] if data is not None else np.zeros(0, np.uint8)
    return flat, offsets - offsets[0]


def occurrences(texts: DataFrame, length: int = LENGTH) -> DataFrame:
    """(id, hash, start, size, anchor, digest) of the stretches of `texts` (id, hash, body): digest is of all their bytes."""
    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flat, bounds = _bytes_of(batch.column("body"))
            ids, hashes = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("id", "hash"))
            view = memoryview(flat)
            for first, last, anchor in anchored(flat, bounds[1:], length):
                text = np.searchsorted(bounds[1:], first, side="right")
                digest = np.fromiter((xxhash.xxh3_64_intdigest(view[a:b]) for a, b in zip(first.tolist(), (last + length).tolist())),
                                     np.uint64, len(first)).view(np.int64)
                yield pa.record_batch(
                    [ids[text], hashes[text], (first - bounds[text]).astype(np.int32), (last - first + length).astype(np.int32), anchor, digest],
                    ["id", "hash", "start", "size", "anchor", "digest"])

    return texts.mapInArrow(found, "id long, hash long, start int, size int, anchor long, digest long")


# --- one transform -------------------------------------------------------------------

def suffix_array(flat: np.ndarray, room: np.ndarray) -> np.ndarray:
    """The order of the suffixes of `flat`; `room` is how far the END of a suffix's own piece is.

    ENDs are greater than all bytes, and a later one greater than an earlier one. Suffixes are sorted by 8 bytes, then
    those that tie by twice as many each time.
    """
    n = len(flat)
    padded = np.append(flat, np.zeros(8, np.uint8))
    key = np.ndarray((n,), ">u8", padded, strides=(1,)).astype(np.uint64)
    short = np.flatnonzero(room < 7)
    key[short] &= np.uint64(0xFFFFFFFFFFFFFFFF) << (56 - 8 * room[short]).astype(np.uint64)
    order = np.argsort(key)
    sorted_ = key[order]
    new = np.append(True, sorted_[1:] != sorted_[:-1])
    rank = np.empty(n, np.int64)
    rank[order] = np.flatnonzero(new)[np.cumsum(new) - 1]
    reach, tied = 8, np.flatnonzero(~(new & np.append(new[1:], True)))
    while len(tied):
        at = order[tied]
        group = rank[at]
        ended = room[at] < reach
        second = np.where(ended, at, rank[np.minimum(at + reach, n - 1)])
        inner = np.argsort(group * n + second)
        at, group, second = at[inner], group[inner], second[inner]
        order[tied] = at
        new = np.append(True, (group[1:] != group[:-1]) | (second[1:] != second[:-1]))
        rank[at] = tied[np.flatnonzero(new)][np.cumsum(new) - 1]
        tied = tied[~(new & np.append(new[1:], True))]
        reach *= 2
    return order


def repeated_starts(flat: np.ndarray, room: np.ndarray, length: int = LENGTH) -> np.ndarray:
    """Places of `flat` from which `length` bytes begin that also begin elsewhere, in ascending order.

    The Burrows-Wheeler transform is expanded breadth first: from the intervals of all strings of one length, those of
    the strings one byte longer to the left follow by the last-to-first mapping. An interval whose end has not been met
    says that the common prefix of the suffixes on both sides is as long as the string that was extended; any other is
    dropped. So common prefixes appear by increasing value, each end is met once, and after `length` rounds the ends
    never met are those of longer ones.
    """
    n = len(flat)
    order = suffix_array(flat, room)
    place = np.empty(n, np.int64)
    place[order] = np.arange(n)
    back = place[order - 1]
    letter = flat[order]
    met = np.zeros(n + 1, bool)
    met[0] = met[n] = True
    low, high = np.zeros(1, np.int64), np.full(1, n - 1)
    for _ in range(length):
        sizes = high - low + 1
        ends = np.cumsum(sizes)
        owner = np.repeat(np.arange(len(low)), sizes)
        inside = back[np.repeat(low - (ends - sizes), sizes) + np.arange(ends[-1])]
        if 4 * len(inside) > n:
            whole = np.full(n, -1)
            whole[inside] = owner
            inside = np.flatnonzero(whole >= 0)
            owner = whole[inside]
        else:
            sort = np.argsort(inside)
            inside, owner = inside[sort], owner[sort]
        here = letter[inside]
        new = np.append(True, (inside[1:] != inside[:-1] + 1) | (owner[1:] != owner[:-1]) | (here[1:] != here[:-1]) | (here[1:] == END))
        low, high = inside[new], inside[np.append(np.flatnonzero(new)[1:] - 1, len(inside) - 1)]
        fresh = ~met[high + 1]
        low, high = low[fresh], high[fresh]
        if not len(low):
            break
        met[high + 1] = True
    longer = np.flatnonzero(~met)
    return np.unique(np.concatenate((order[longer - 1], order[longer])))


def repeated_runs(pieces: list[bytes], length: int = LENGTH) -> list[list[tuple[int, int]]]:
    """For each piece the runs (first, last) of starts whose `length` bytes also begin elsewhere in the pieces."""
    sizes = np.array([len(p) for p in pieces], np.int64)
    flat = np.frombuffer(b"\xff".join(pieces) + b"\xff", np.uint8)
    ends = np.cumsum(sizes + 1) - 1
    piece = np.repeat(np.arange(len(pieces)), sizes + 1)
    starts = repeated_starts(flat, ends[piece] - np.arange(len(flat)), length)
    out: list[list[tuple[int, int]]] = [[] for _ in pieces]
    if len(starts):
        new = np.append(True, (starts[1:] != starts[:-1] + 1) | (piece[starts[1:]] != piece[starts[:-1]]))
        first, last = starts[new], starts[np.append(np.flatnonzero(new)[1:] - 1, len(starts) - 1)]
        own = piece[first]
        before = ends[own] - sizes[own]
        for k, a, b in zip(own.tolist(), (first - before).tolist(), (last - before).tolist()):
            out[k].append((a, b))
    return out


# --- over all documents --------------------------------------------------------------

def keyed(docs: DataFrame) -> DataFrame:
    """(row, id, hash, body): the caller's row, what names it, and its text's bytes. Rows equal in id and text share a name."""
    return docs.select(
        F.struct("*").alias("row"), F.coalesce(F.col("doc_id").cast("long"), F.lit(0).cast("long")).alias("id"),
        F.xxhash64("doc_id", "text").alias("hash"), F.coalesce("text", F.lit("")).cast("binary").alias("body"))


def repeated_spans(docs: DataFrame, length: int = LENGTH, bucket: int = BUCKET) -> DataFrame:
    """(id, hash, spans) of the rows of `keyed(docs)` with repeats: disjoint runs (start, end) of bytes, in order.

    1. Texts are cut into stretches by anchor, and anchors that occur once are left.
    2. Where all stretches of an anchor are equal, they are one piece with a count: all of it repeats.
    3. Otherwise the different pieces are compared by transforms; a piece that occurs twice itself repeats as well.
    An anchor with more than `bucket` pieces is widened, see `_runs`. Anchors are found anew in the second pass, which
    costs less than storing them. Only stretches of repeated anchors, and the texts that lend a piece its bytes, are shuffled.
    """
    bounded_batches(docs.sparkSession)
    texts = keyed(docs).select("id", "hash", "body")
    places = occurrences(texts, length)
    repeated = stored(places.groupBy("anchor").agg(
        F.count(F.lit(1)).alias("n"), F.min("digest").alias("one"), F.max("digest").alias("other")).filter("n > 1").select(
        "anchor", (F.col("one") != F.col("other")).alias("mixed")), "anchors")
    hits = stored(places.join(repeated, "anchor"), "hits")
    pieces = stored(hits.filter("mixed").groupBy("anchor", "digest").agg(
        F.count(F.lit(1)).alias("n"), F.min(F.struct("id", "hash", "start", "size")).alias("at")), "pieces")
    runs = _runs(_with_bytes(pieces, texts, length), pieces.select("anchor"), length, bucket)
    whole = F.array(F.struct(F.lit(0).alias("start"), (F.col("size") - length).alias("end")))
    spans = hits.filter("not mixed").select("id", "hash", "start", whole.alias("runs")).unionByName(
        hits.filter("mixed").join(runs, ["anchor", "digest"]).select("id", "hash", "start", "runs"))
    placed = spans.select("id", "hash", "start", F.explode("runs").alias("run")).select(
        "id", "hash", F.struct((F.col("start") + F.col("run.start")).alias("start"),
                               (F.col("start") + F.col("run.end") + length).alias("end")).alias("span"))
    return stored(placed.groupBy("id", "hash").agg(F.collect_set("span").alias("spans")).select(
        "id", "hash", merged(F.col("spans")).alias("spans")), "spans")


def _with_bytes(pieces: DataFrame, texts: DataFrame, length: int) -> DataFrame:
    """(anchor, digest, n, low, high, piece): the pieces' bytes, from the text that each first occurs in.

    A piece's strings have between low and high bytes before the anchor.
    """
    wanted = pieces.groupBy("at.id", "at.hash").agg(F.collect_list(F.struct("anchor", "digest", "n", "at.start", "at.size")).alias("wanted"))
    lent = F.inline("wanted")
    return among(texts, pieces.select("at.hash")).join(stored(wanted, "wanted"), ["id", "hash"]).select("body", lent).select(
        "anchor", "digest", "n", F.lit(0).alias("low"), F.lit(length - GRAM).alias("high"), F.expr("substring(body, start + 1, size)").alias("piece"))


def _runs(pieces: DataFrame, anchors: DataFrame, length: int, bucket: int) -> DataFrame:
    """(anchor, digest, runs) of the `pieces` (anchor, digest, n, low, high, piece) with repeats; `anchors` holds their anchors.

    Up to `bucket` pieces of an anchor are compared by a transform; one alone repeats if it occurs twice itself. More are
    halved: strings with few bytes before the anchor are told from those with many. All strings of a half hold some bytes
    around the anchor, so these make a wider one, which fewer pieces share, and halves equal in all bytes are one piece
    again. A string is in one half only, with all that equal it. The last half is a string, its own anchor.
    """
    sizes = stored(anchors.groupBy("anchor").agg(F.count(F.lit(1)).alias("own")).filter("own > 1"), "sizes")
    dealt = stored(pieces.join(sizes, "anchor", "left"), "dealt")
    wide = f"coalesce(own, 1) > {bucket} and low < high"
    whole = F.array(F.struct(F.lit(0).alias("start"), (F.octet_length("piece") - length).alias("end")))
    found = stored(_compared(dealt.filter(f"own > 1 and not ({wide})"), length).filter(F.size("runs") > 0).unionByName(
        dealt.filter("own is null and n > 1").select("anchor", "digest", whole.alias("runs"))), "compared")
    if sizes.filter(F.col("own") > bucket).isEmpty():
        return found
    halves = stored(_halves(dealt.filter(wide), length), "halves")
    joined = stored(halves.groupBy(F.col("wider").alias("anchor"), F.col("name").alias("digest")).agg(
        F.sum("n").alias("n"), F.first("low").alias("low"), F.first("high").alias("high"), F.first("piece").alias("piece")), "joined")
    inner = _runs(joined, joined.select("anchor"), length, bucket).withColumnsRenamed({"anchor": "wider", "digest": "name"})
    moved = F.transform("runs", lambda run: F.struct((run["start"] + F.col("at")).alias("start"), (run["end"] + F.col("at")).alias("end")))
    outer = halves.select("anchor", "digest", "at", "wider", "name").join(inner, ["wider", "name"]).select("anchor", "digest", moved.alias("runs"))
    return stored(found.unionByName(outer).groupBy("anchor", "digest").agg(F.flatten(F.collect_list("runs")).alias("runs")), "runs")


def _halves(pieces: DataFrame, length: int) -> DataFrame:
    """(anchor, digest, at, wider, name, n, low, high, piece): one or two halves of each piece, `at` bytes into it, and
    the wider anchor and the digest that name a half."""
    def halved(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flat, bounds = _bytes_of(batch.column("piece"))
            view, begins, ends = memoryview(flat), bounds[:-1], bounds[1:]
            place = np.empty(len(begins), np.int64)
            for first, _, at, _ in _stretches(flat, ends, length):
                place[np.searchsorted(ends, first, side="right")] = at
            anchor, digest, n, low, high = (batch.column(c).to_numpy() for c in ("anchor", "digest", "n", "low", "high"))
            middle = (low + high) // 2
            for least, most in ((low, middle), (middle + 1, high)):
                first, last = np.maximum(begins, place - most), np.minimum(ends - length, place - least)
                own = np.flatnonzero(first <= last)
                spans = list(zip(first[own].tolist(), (last[own] + length).tolist()))
                held = zip((place - least)[own].tolist(), (place + length - most)[own].tolist(), least[own].tolist())
                wider = np.fromiter((xxhash.xxh3_64_intdigest(view[a:b], seed) for a, b, seed in held), np.uint64, len(own))
                name = np.fromiter((xxhash.xxh3_64_intdigest(view[a:b]) for a, b in spans), np.uint64, len(own))
                yield pa.record_batch(
                    [anchor[own], digest[own], (first - begins)[own].astype(np.int32), wider.view(np.int64), name.view(np.int64), n[own],
                     least[own].astype(np.int32), most[own].astype(np.int32), pa.array([bytes(view[a:b]) for a, b in spans], pa.binary())],
                    ["anchor", "digest", "at", "wider", "name", "n", "low", "high", "piece"])

    return pieces.select("anchor", "digest", "n", "low", "high", "piece").mapInArrow(
        halved, "anchor long, digest long, at int, wider long, name long, n long, low int, high int, piece binary")


def among(texts: DataFrame, hashes: DataFrame) -> DataFrame:
    """The rows of `texts` whose hash may be one of `hashes`: a filter of a fixed size, which lets some others pass."""
    return texts.filter(_maybe(texts, hashes)(F.col("hash")))


def _maybe(texts: DataFrame, hashes: DataFrame):
    model = carried(texts.sparkSession, Filter(hashes))

    @F.arrow_udf("boolean")
    def maybe(numbers: pa.Array) -> pa.Array:
        return pa.array(model().has(numbers.to_numpy()))

    return maybe


def _compared(pieces: DataFrame, length: int) -> DataFrame:
    """(anchor, digest, runs): runs of repeated starts, by transforms that hold all pieces of an anchor."""
    parts = int(pieces.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, last = [], 0, None

        def rows():
            kept = []
            for (anchor, digest, n, piece), own in zip(held, repeated_runs([h[3] for h in held], length)):
                runs = [(0, len(piece) - length)] if n > 1 else own
                kept.append({"anchor": anchor, "digest": digest, "runs": [{"start": a, "end": b} for a, b in runs]})
            held.clear()
            return pa.RecordBatch.from_pylist(kept, schema)

        schema = pa.schema([("anchor", pa.int64()), ("digest", pa.int64()), ("runs", pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])))])
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                if size >= POOL and row[0] != last:
                    yield rows()
                    size = 0
                held.append(row)
                size += len(row[3]) + 1
                last = row[0]
        if held:
            yield rows()

    return pieces.select("anchor", "digest", "n", "piece").repartition(parts, "anchor").sortWithinPartitions(
        "anchor").mapInArrow(compared, f"anchor long, digest long, runs {SPANS}")


def merged(spans: Column) -> Column:
    """The spans (start, end) of an array, in order, joined where they overlap or touch."""
    @F.arrow_udf(SPANS)
    def of(lists: pa.Array) -> pa.Array:
        sizes = np.diff(lists.offsets.to_numpy()).astype(np.int64)
        start, end = (c.to_numpy(zero_copy_only=False).astype(np.int64) for c in lists.flatten().flatten())
        row = np.repeat(np.arange(len(sizes)), sizes)
        # Rows follow one another with gaps between them, so that spans of two rows never touch.
        base = row << 33
        order = np.argsort(base + start)
        start, end, row = (base + start)[order], (base + end)[order], row[order]
        reach = np.maximum.accumulate(end)
        new = np.flatnonzero(np.append(True, start[1:] > reach[:-1])) if len(start) else np.zeros(0, np.int64)
        last = reach[np.append(new[1:] - 1, len(start) - 1)] if len(start) else new
        own = row[new]
        runs = pa.StructArray.from_arrays([pa.array((x - (own << 33)).astype(np.int32)) for x in (start[new], last)], ["start", "end"])
        ends = np.concatenate(([0], np.cumsum(np.bincount(own, minlength=len(sizes)))))
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), runs)

    return of(spans)


def deduplicated(docs: DataFrame, length: int = LENGTH, bucket: int = BUCKET) -> DataFrame:
    """(row, spans, kept): the caller's row, its runs of removed bytes and the bytes that remain.

    A byte goes if a string of `length` bytes that covers it also begins elsewhere, in the same text or another row's;
    no string crosses texts, and all are judged on the texts as given. Null text is empty; repeated rows are documents
    of their own, so all their strings of that length repeat; shorter texts stay whole; an empty table gives an empty one.
    Spans begin and end at any byte, so what remains need not be UTF-8.
    """
    spans = repeated_spans(docs, length, bucket)
    rows = keyed(docs)
    maybe = rows.withColumn("maybe", _maybe(rows, spans.select("hash"))(F.col("hash")))

    @F.arrow_udf("binary")
    def without(bodies: pa.Array, lists: pa.Array) -> pa.Array:
        out = []
        for body, own in zip(bodies.to_pylist(), lists.to_pylist()):
            at, left = 0, []
            for span in own:
                left.append(body[at:span["start"]])
                at = span["end"]
            out.append(b"".join([*left, body[at:]]))
        return pa.array(out, pa.binary())

    none = F.array().cast(SPANS)
    joined = maybe.filter("maybe").join(spans, ["id", "hash"], "left").select("row", "body", F.coalesce("spans", none).alias("spans"))
    cut = joined.select("row", "spans", without(F.col("body"), F.col("spans")).alias("kept"))
    return cut.unionByName(maybe.filter("not maybe").select("row", none.alias("spans"), F.col("body").alias("kept")))


def report(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, and the digest of the remaining bytes; see `deduplicated`."""
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda total, span: total + (span["end"] - span["start"]))
    return deduplicated(docs.select("doc_id", "text")).select(
        "row.doc_id", (F.octet_length("kept") + removed).alias("n_bytes"), removed.alias("n_removed"),
        F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
