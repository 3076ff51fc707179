"""Collocations: pairs of frequency-ranked ids are counted in tiles, frequent pairs are ranked anew and extended."""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from outagelens.llm.shared import Filter, bounded_batches, carried, stored

LONGEST = 5
LEAST = 100
TOP = 2000
#: Phrases of one length that get dense ids, by frequency; the rest are named by a hash. Bounds what is broadcast.
HEAD = 1 << 18
#: Ids on a side of a tile, and the share of its cells that its pairs must reach for it to be counted as an array.
TILE, DENSE = 256, 0.25
#: Pairs that a task counts at a time, distinct words that it holds, and rows that it hands over at a time.
PAIRS, WORDS, ROWS = 2_000_000, 200_000, 100_000
#: Bytes of text that are cut into words at a time.
PORTION = 1 << 20
#: Codes in a stored row, or a piece more, and rows that are looked up at a time. Parquet closes no page before 100 rows
#: and its reader takes 4,096 at once, so rows of whole portions would fill gigabytes outside the heap.
CODES, RUN = 512, 256
#: Codes from here on are hashes.
HASHED = 1 << 62

SPACE_AND_BREAK = bytes.maketrans(b"\t.,;:!?\x0a\x0b\x0c\x0d", b" " + b"\n" * 10)


def tokens(texts: list[str]) -> list[bytes]:
    """The words of the texts, A-Z in lower case, with a line feed between pieces and texts; empty ones mean nothing."""
    return b"\n".join(t.encode() for t in texts).lower().translate(SPACE_AND_BREAK).replace(b"\n", b" \n ").split(b" ")


def _by_language(batch: pa.RecordBatch) -> Iterator[tuple[str, list[str]]]:
    """The texts of a batch by language, in portions."""
    held: dict[str, list[str]] = defaultdict(list)
    size: Counter = Counter()
    for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist()):
        held[lang].append(text)
        size[lang] += len(text)
        if size[lang] >= PORTION:
            yield lang, held.pop(lang)
            del size[lang]
    yield from held.items()


def _plain(docs: DataFrame) -> DataFrame:
    return docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.coalesce("text", F.lit("")).alias("text"))


def word_counts(docs: DataFrame, least: int = LEAST) -> tuple[DataFrame, DataFrame]:
    """(lang, phrase, f) of the words found `least` times or more, and (lang, n) of all word occurrences."""
    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, Counter] = defaultdict(Counter)

        def rows():
            for lang, own in held.items():
                own.pop(b"", None)
                own.pop(b"\n", None)
                words = [w.decode() for w in own]
                yield pa.record_batch([pa.array([lang] * (len(words) + 1)), pa.array([*words, None], pa.string()),
                                       pa.array([*own.values(), own.total()], pa.int64())], ["lang", "phrase", "f"])
            held.clear()

        for batch in batches:
            for lang, texts in _by_language(batch):
                held[lang].update(tokens(texts))
            if sum(map(len, held.values())) > WORDS:
                yield from rows()
        yield from rows()

    partial = _plain(docs).mapInArrow(counted, "lang string, phrase string, f long")
    total = stored(partial.groupBy("lang", "phrase").agg(F.sum("f").alias("f"))
                   .filter(F.col("phrase").isNull() | (F.col("f") >= least)), "words")
    return total.filter(F.col("phrase").isNotNull()), total.filter(F.col("phrase").isNull()).select("lang", F.col("f").alias("n"))


def mixed(p: np.ndarray, w: np.ndarray) -> np.ndarray:
    """A hash of each pair of codes, as a long."""
    x = p.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + w.astype(np.uint64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return (x ^ (x >> np.uint64(31))).view(np.int64)


def word_hash(word: bytes) -> int:
    number = xxhash.xxh3_64_intdigest(word)
    return number - (1 << 64) if number >= 1 << 63 else number


def hashed_code(number: np.ndarray) -> np.ndarray:
    """The code of a phrase without a rank: the hash's low 62 bits, marked."""
    return number & (HASHED - 1) | HASHED


def ranked(frequent: DataFrame, names: list[str], number: Column, head: int = HEAD) -> DataFrame:
    """`frequent` with code: the rank within its language of the `head` most frequent rows, from 1, else a marked hash.

    `names` are the columns that tell a language's rows apart, `number` their hash.
    """
    order = [F.desc("f"), *names]
    first = frequent.orderBy(F.desc("f"), "lang", *names).limit(head).select(
        "lang", *names, F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long").alias("rank"))
    rest = F.lit(HASHED).bitwiseOR(number.bitwiseAND(F.lit(HASHED - 1)))
    return frequent.join(stored(first, "ranks"), ["lang", *names], "left").withColumn("hash", number).withColumn(
        "code", F.coalesce("rank", rest))


@F.arrow_udf(LongType())
def _word_hashes(words: pa.Array) -> pa.Array:
    return pa.array([word_hash(w.encode()) for w in words.to_pylist()], pa.int64())


@F.arrow_udf(LongType())
def _pair_hashes(p: pa.Array, w: pa.Array) -> pa.Array:
    return pa.array(mixed(p.to_numpy(), w.to_numpy()))


def _filter(coded: DataFrame) -> Filter:
    """Hashes that may be those of frequent phrases without a rank. One that passes by chance costs counting only: no
    phrase is frequent unless its parts are."""
    return Filter(coded.filter("rank is null").select("hash"))


def in_rows(codes: np.ndarray, most: int = CODES) -> list[np.ndarray]:
    """The codes, whose last is 0, in rows that each end with a 0: the first one after every `most` codes."""
    ends = np.flatnonzero(codes == 0) + 1
    cuts = np.unique(ends[np.searchsorted(ends, np.arange(most, len(codes), most))])
    return np.split(codes, cuts[cuts < len(codes)])


def encoded(docs: DataFrame, words: DataFrame) -> DataFrame:
    """(lang, codes): the codes of the texts' words, 0 where a piece ends or a word is not frequent. Stored once.

    A portion of texts is many rows, which stand together and each end with a 0.
    """
    known: dict[str, dict[bytes, int]] = defaultdict(lambda: {b"": -1, b"\n": 0})
    for lang, word, rank in words.filter("rank is not null").select("lang", "phrase", "rank").toLocalIterator():
        known[lang][word.encode()] = rank
    model = carried(docs.sparkSession, (dict(known), _filter(words)))

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranks, rest = model()
        none = {b"": -1, b"\n": 0}
        for batch in batches:
            langs, lists = [], []
            for lang, texts in _by_language(batch):
                found = tokens(texts)
                get = ranks.get(lang, none).get
                codes = np.array([get(t, 0) for t in found], np.int64)
                if rest.bits is not None:
                    open_ = [(k, word_hash(found[k])) for k in np.flatnonzero(codes == 0).tolist() if found[k] != b"\n"]
                    places, numbers = (np.array(x, np.int64) for x in (zip(*open_) if open_ else ((), ())))
                    codes[places] = np.where(rest.has(numbers), hashed_code(numbers), 0)
                codes = codes[codes >= 0]
                codes = codes[(codes > 0) | (np.append(codes[1:], 0) > 0)]  # one break instead of several
                rows = in_rows(np.append(codes, 0))
                langs += [lang] * len(rows)
                lists += rows
            if langs:
                ends = np.cumsum([0, *map(len, lists)])
                yield pa.record_batch([pa.array(langs), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), np.concatenate(lists))],
                                      ["lang", "codes"])

    return stored(_plain(docs).mapInArrow(coded, "lang string, codes array<long>"), "codes")


def tiled(p: np.ndarray, w: np.ndarray, tile: int = TILE, dense: float = DENSE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct pairs and how often each occurs.

    Pairs of ranks fall into tiles of `tile` x `tile` cells. Those that fill the share `dense` of a tile's cells are
    addressed directly, in one array of all such tiles; others, and pairs of hashes, are sorted and their runs counted.
    """
    inside = (p < HASHED) & (w < HASHED)
    out = []
    if not inside.all():
        q, v = p[~inside], w[~inside]
        order = np.lexsort((v, q))
        q, v = q[order], v[order]
        first = np.flatnonzero(np.append(True, (q[1:] != q[:-1]) | (v[1:] != v[:-1])))
        out.append((q[first], v[first], np.diff(np.append(first, len(q)))))
        p, w = p[inside], w[inside]
    if len(p):
        # Arrays as long as the pairs are few and go early: they are what a worker's memory is spent on.
        wide, side = int(w.max()) // tile + 1, int(w.max()) + 1
        at = p // tile
        at *= wide
        at += w // tile
        where = None
        if (int(p.max()) // tile + 1) * wide > 1 << 24:
            where, at = np.unique(at, return_inverse=True)
        full = np.flatnonzero(np.bincount(at) >= max(1, dense * tile * tile))
        direct = np.zeros(0, np.int64)
        if len(full):
            place = np.full(int(at.max()) + 1, -1, np.int32)
            place[full] = np.arange(len(full))
            place = place[at]
            del at
            direct = np.flatnonzero(place >= 0)
            cell = place[direct].astype(np.int64)
            del place
            for side_codes in (p, w):
                inner = side_codes[direct]
                inner %= tile
                cell *= tile
                cell += inner
            del inner, side_codes
            cells = np.bincount(cell)
            del cell
            held = np.flatnonzero(cells)
            corner = (full if where is None else where[full])[held // (tile * tile)]
            out.append((corner // wide * tile + held // tile % tile, corner % wide * tile + held % tile, cells[held]))
            del cells
        else:
            del at
        if len(direct) < len(p):
            keys = p * side
            keys += w
            del p, w
            if len(direct):
                keys = np.delete(keys, direct)
            keys.sort()
            first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
            often = np.diff(np.append(first, len(keys)))
            keys = keys[first]
            out.append((keys // side, keys % side, often))
    return tuple(np.concatenate(x).astype(np.int64, copy=False) for x in zip(*out)) if out else (np.zeros(0, np.int64),) * 3


class Level:
    """Codes of the frequent phrases of one length, looked up by the pair (code of all but the last word, last word)."""

    def __init__(self, coded: DataFrame):
        rows: dict[str, list] = defaultdict(list)
        for lang, p, w, rank in coded.filter("rank is not null").select("lang", "p", "w", "rank").toLocalIterator():
            rows[lang].append((p, w, rank))
        self.rest, self.first = _filter(coded), {}
        for lang, own in rows.items():
            p, w, rank = np.array(own, np.int64).T
            number = mixed(p, w)
            order = np.argsort(number)
            self.first[lang] = tuple(x[order] for x in (number, p, w, rank))

    def codes(self, lang: str, p: np.ndarray, w: np.ndarray) -> np.ndarray:
        """The code of each pair; 0 where it is not frequent, or a part is 0."""
        out = np.zeros(len(p), np.int64)
        some = np.flatnonzero((p > 0) & (w > 0))
        q, v = p[some], w[some]
        number = mixed(q, v)
        if lang in self.first:
            numbers, first, last, rank = self.first[lang]
            at = np.minimum(np.searchsorted(numbers, number), len(numbers) - 1)
            out[some] = np.where((numbers[at] == number) & (first[at] == q) & (last[at] == v), rank[at], 0)
        left = (out[some] == 0) & self.rest.has(number)
        out[some[left]] = hashed_code(number[left])
        return out


def _runs(batch: pa.RecordBatch, most: int = RUN) -> Iterator[tuple[str, np.ndarray]]:
    """The codes of up to `most` neighbouring rows of a language at a time."""
    at, codes = 0, batch.column("codes")
    for lang, rows in groupby(batch.column("lang").to_pylist()):
        end = at + sum(1 for _ in rows)
        for start in range(at, end, most):
            yield lang, codes.slice(start, min(most, end - start)).flatten().to_numpy()
        at = end


def longer(codes: DataFrame, levels: list[Level], least: int = LEAST) -> DataFrame:
    """(lang, p, w, f): phrases one word longer than those of the last level, found `least` times or more.

    A pair is counted where the phrase without its last and the phrase without its first word are both frequent.
    """
    model = carried(codes.sparkSession, levels)

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, held = model(), defaultdict(lambda: ([], []))
        size: Counter = Counter()

        def joined(parts):
            whole = np.concatenate(parts)
            parts.clear()
            return whole

        def rows(lang):
            del size[lang]
            first, last = held.pop(lang)
            counts = tiled(joined(first), joined(last))
            for at in range(0, len(counts[0]), ROWS):
                p, w, often = (x[at:at + ROWS] for x in counts)
                yield pa.record_batch([pa.array([lang] * len(p), pa.string()), pa.array(p), pa.array(w), pa.array(often)], ["lang", "p", "w", "f"])

        for batch in batches:
            for lang, word in _runs(batch):
                code = word
                for depth, level in enumerate(found, 1):
                    code = level.codes(lang, code[:-1], word[depth:])
                p, w = code[:-1], word[len(found) + 1:]
                some = (p > 0) & (w > 0)
                if found:
                    some &= code[1:] > 0
                for parts, codes_ in zip(held[lang], (p, w)):
                    parts.append(codes_[some])
                size[lang] += int(some.sum())
                if sum(size.values()) >= PAIRS:
                    for each in list(held):
                        yield from rows(each)
        for each in list(held):
            yield from rows(each)

    return codes.mapInArrow(counted, "lang string, p long, w long, f long").groupBy("lang", "p", "w").agg(
        F.sum("f").alias("f")).filter(F.col("f") >= least)


def phrases(docs: DataFrame, longest: int = LONGEST, least: int = LEAST, head: int = HEAD) -> tuple[DataFrame, DataFrame]:
    """(lang, phrase, words, f) of all phrases of 1 to `longest` words found `least` times or more, and (lang, n)."""
    bounded_batches(docs.sparkSession)
    words, sizes = word_counts(docs, least)
    words = stored(ranked(words, ["phrase"], _word_hashes("phrase"), head), "ranked-words")
    codes = encoded(docs, words)
    last = words.select("lang", F.col("code").alias("w"), F.col("phrase").alias("word"))
    out, before, levels = [words.select("lang", "phrase", F.lit(1).alias("words"), "f")], words, []
    for length in range(2, longest + 1):
        found = stored(longer(codes, levels, least), "pairs")
        named = found.join(before.select("lang", F.col("code").alias("p"), F.col("phrase").alias("start")), ["lang", "p"]).join(
            last, ["lang", "w"]).select("lang", "p", "w", "f", F.concat_ws(" ", "start", "word").alias("phrase"))
        before = stored(ranked(named, ["p", "w"], _pair_hashes("p", "w"), head).select(
            "lang", "p", "w", "f", "phrase", "rank", "hash", "code"), "phrases")
        out.append(before.select("lang", "phrase", F.lit(length).alias("words"), "f"))
        if length < longest:
            levels.append(Level(before))
    every = out[0]
    for more in out[1:]:
        every = every.unionByName(more)
    return stored(every, "all-phrases"), sizes


def collocations(docs: DataFrame, longest: int = LONGEST, least: int = LEAST, top: int = TOP, head: int = HEAD) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score of each language's first `top` phrases by score, a and phrase.

    Texts are cut at `.,;:!?` and U+000A to U+000D into pieces, pieces at space and tab into words, A-Z lower-cased.
    Null texts are empty, a null lang is `und`; repeated rows count each; an empty table gives an empty one. n counts
    a language's word occurrences, a a phrase's within pieces. A phrase is scored by its lowest cut into l and r,
    floor(1000 a n / (l r)) in decimals of 38 digits, and dropped where a longer phrase around it is as frequent. Equal scores go
    to the smaller cut, equal rows to the phrase that comes first in bytes. Phrases are counted with 64-bit hashes of
    those beyond the first `head`; the phrases of one length that share such a hash would be counted as one.
    """
    every, sizes = phrases(docs, longest, least, head)
    words = F.split("phrase", " ", -1)
    candidates = every.filter(F.col("words") > 1)
    # Within a longer phrase as frequent, every phrase between the two is as frequent, so one more word is enough.
    part = candidates.filter(F.col("words") > 2).select("lang", "f", F.explode(F.array(
        F.array_join(F.slice(words, F.lit(1), F.col("words") - 1), " "),
        F.array_join(F.slice(words, F.lit(2), F.col("words") - 1), " "))).alias("phrase"))
    around = part.groupBy("lang", "phrase").agg(F.max("f").alias("around"))
    left = candidates.join(around, ["lang", "phrase"], "left").filter(F.col("around").isNull() | (F.col("around") < F.col("f")))
    cuts = left.select("lang", "phrase", F.col("f").alias("a"), words.alias("own"), F.explode(F.sequence(F.lit(1), F.col("words") - 1)).alias("k"))
    cuts = cuts.select("lang", "phrase", "a", "k", F.array_join(F.slice("own", F.lit(1), F.col("k")), " ").alias("first"),
                       F.array_join(F.slice("own", F.col("k") + 1, F.size("own") - F.col("k")), " ").alias("last"))
    counted = every.select("lang", F.col("phrase").alias("first"), F.col("f").alias("l"))
    scored = cuts.join(counted, ["lang", "first"]).join(
        counted.select("lang", F.col("first").alias("last"), F.col("l").alias("r")), ["lang", "last"]).join(sizes, "lang")
    whole = "cast({} as decimal(19,0))"
    score = F.expr(f"({whole.format('1000 * a')} * {whole.format('n')}) div ({whole.format('l')} * {whole.format('r')})")
    best = scored.groupBy("lang", "phrase").agg(F.min(F.struct(score.alias("score"), "k", "a", "l", "r", "n")).alias("cut"))
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    return best.select("lang", "phrase", "cut.*").withColumn("rank", F.row_number().over(order).cast("long")).filter(
        F.col("rank") <= top).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


#: What DuckDB says of the same rows, for any documents.
REPORT_SQL = r"""
WITH pieces AS (
    SELECT coalesce(lang, 'und') AS lang,
           unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                        '[.,;:!?\x0A-\x0D]')) AS piece
    FROM documents),
listed AS (SELECT lang, list_filter(regexp_split_to_array(piece, '[ \t]'), lambda x: x <> '') AS w FROM pieces),
sizes AS (SELECT lang, sum(len(w))::BIGINT AS n FROM listed GROUP BY lang),
placed AS (SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM listed),
spans AS (SELECT lang, w, i, unnest(range(1, least(5, len(w) - i + 1) + 1)) AS words FROM placed),
every AS (
    SELECT lang, words, array_to_string(w[i:i + words - 1], ' ') AS phrase, count(*)::BIGINT AS f
    FROM spans GROUP BY ALL HAVING count(*) >= 100),
parts AS (
    SELECT q.lang, q.f, unnest([array_to_string(string_split(q.phrase, ' ')[1:words - 1], ' '),
                                array_to_string(string_split(q.phrase, ' ')[2:words], ' ')]) AS phrase
    FROM every q WHERE words > 2),
around AS (SELECT lang, phrase, max(f) AS f FROM parts GROUP BY ALL),
candidates AS (
    SELECT e.lang, e.phrase, e.words, e.f AS a FROM every e LEFT JOIN around o ON o.lang = e.lang AND o.phrase = e.phrase
    WHERE e.words > 1 AND (o.f IS NULL OR o.f < e.f)),
cuts AS (SELECT *, unnest(range(1, words)) AS k FROM candidates),
scored AS (
    SELECT c.lang, c.phrase, c.a, c.k, x.f AS l, y.f AS r, s.n,
           ((1000::HUGEINT * c.a * s.n) // (x.f::HUGEINT * y.f))::BIGINT AS score
    FROM cuts c
    JOIN every x ON x.lang = c.lang AND x.phrase = array_to_string(string_split(c.phrase, ' ')[1:c.k], ' ')
    JOIN every y ON y.lang = c.lang AND y.phrase = array_to_string(string_split(c.phrase, ' ')[c.k + 1:c.words], ' ')
    JOIN sizes s ON s.lang = c.lang),
best AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, encode(phrase)) AS rank, phrase, a, l, r, n, score
FROM best QUALIFY rank <= 2000
"""
