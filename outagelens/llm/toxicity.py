"""Toxicity: a convolutional classifier over hashed word embeddings, trained in numpy, calibrated by language."""

from __future__ import annotations

import copy
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from outagelens.llm.shared import bounded_batches, carried, first_rows, fold, sample_arrays, stored

#: Hashed words, and the length of an embedding.
BUCKETS, DIMENSIONS = 1 << 18, 8
#: Filter widths in words, and filters of each.
WIDTHS, FILTERS = (1, 2, 3), 8
#: Labelled rows of the first model, at most, chosen by hashed id and text, and the words that one of them may have.
#: Where there are more, or longer ones, that model is only the start: all labelled rows train and calibrate it further.
LEARN_ROWS, LEARN_WORDS = 16_000, 10_000
#: Rows of a shard, about, and passes over all shards. Shards are trained side by side; their networks are averaged.
SHARD_ROWS, ROUNDS = 6_000, 3
#: Languages with a threshold of their own, at most: those with most learning rows.
LANGUAGES = 64
#: A bucket in fewer learning rows keeps the embedding of an unknown word.
LEAST_ROWS = 3
#: Weight of the prior, in rows, of a bucket's first embedding.
PRIOR = 5.0
EPOCHS, BATCH, RATE = 6, 64, 0.01
#: One learning row in so many calibrates instead, where there are CALIBRATED rows; all train with fewer, and the cut is at 0.
CALIBRATE, CALIBRATED = 4, 160
#: A language with fewer calibrating rows of either label takes the common threshold.
LEAST_CALIBRATING = 15
#: The score that a language's threshold is mapped to.
CUT = 0.7

_LETTERS = bytes(c if chr(c).isalpha() or c > 127 else 32 for c in range(256))


def word_buckets(text: str | None) -> np.ndarray:
    """The buckets of all words of a text, in order: runs of ASCII letters and any non-ASCII characters, lower-cased."""
    words = (text or "").lower().encode("utf-8", "surrogatepass").translate(_LETTERS).split()
    return (np.fromiter(map(zlib.crc32, words), np.uint32, len(words)) & np.uint32(BUCKETS - 1)).astype(np.int32)


class Network:
    """Embeddings, convolutions of several widths, the maximum of each filter over the text, one logistic unit."""

    def __init__(self, rng: np.random.Generator):
        wide = len(WIDTHS) * FILTERS
        self.embedding = np.zeros((BUCKETS + 1, DIMENSIONS), np.float32)  # the last: padding
        self.kernels = [rng.normal(0, 0.5 / np.sqrt(w), (w * DIMENSIONS, FILTERS)).astype(np.float32) for w in WIDTHS]
        self.offsets = np.zeros(wide, np.float32)
        self.weights = rng.normal(0, 0.3, wide).astype(np.float32)
        self.bias = np.zeros(1, np.float32)

    def dense(self) -> dict[str, np.ndarray]:
        """All parameters but the embeddings."""
        return {"weights": self.weights, "bias": self.bias, "offsets": self.offsets} | {f"kernel{k}": v for k, v in enumerate(self.kernels)}

    def pooled(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The largest response of each filter, and where it is. Texts shorter than a filter are padded."""
        short = max(WIDTHS) - len(ids)
        if short > 0:
            ids = np.concatenate((ids, np.full(short, BUCKETS, ids.dtype)))
        words = self.embedding[ids]
        most, places = [], []
        for width, kernel in zip(WIDTHS, self.kernels):
            n = len(ids) - width + 1
            seen = sum(words[k:n + k] @ kernel[k * DIMENSIONS:(k + 1) * DIMENSIONS] for k in range(width))
            at = seen.argmax(axis=0)
            places.append(at)
            most.append(seen[at, np.arange(FILTERS)])
        return np.concatenate(most), np.concatenate(places)

    def logit(self, ids: np.ndarray) -> float:
        most, _ = self.pooled(ids)
        return float(np.maximum(most + self.offsets, 0) @ self.weights + self.bias[0])

    def gradients(self, ids: np.ndarray, label: int, into: dict) -> None:
        """Adds the gradients of one row's log loss to `into`; only the pooled places carry any."""
        if len(ids) < max(WIDTHS):
            ids = np.concatenate((ids, np.full(max(WIDTHS) - len(ids), BUCKETS, ids.dtype)))
        most, places = self.pooled(ids)
        active = np.maximum(most + self.offsets, 0)
        error = 1 / (1 + np.exp(-(active @ self.weights + self.bias[0]))) - label
        back = error * self.weights * (active > 0)
        into["weights"] += error * active
        into["bias"] += error
        into["offsets"] += back
        for number, width in enumerate(WIDTHS):
            own = slice(number * FILTERS, (number + 1) * FILTERS)
            spans = ids[places[own][:, None] + np.arange(width)]
            seen = self.embedding[spans].reshape(FILTERS, -1)
            into[f"kernel{number}"] += seen.T * back[own]
            into["spans"].append(spans.reshape(-1))
            into["moves"].append((self.kernels[number].T * back[own][:, None]).reshape(-1, DIMENSIONS))


class Learner:
    """Trains a network by batches: Adam for its few dense parameters, Adagrad for the embeddings that a batch touches.

    Only buckets that are `known` move.
    """

    def __init__(self, net: Network, known: np.ndarray):
        self.net, self.known, self.step = net, known, 0
        self.held = net.dense()
        self.means = {k: [np.zeros_like(v), np.zeros_like(v)] for k, v in self.held.items()}
        self.squares = np.full(len(net.embedding), 1e-6, np.float32)
        self.touched = np.zeros(len(net.embedding), bool)

    def learn(self, rows: list[np.ndarray], labels: list[int]) -> None:
        sums: dict = {k: np.zeros_like(v) for k, v in self.held.items()} | {"spans": [], "moves": []}
        for ids, label in zip(rows, labels):
            self.net.gradients(ids, label, sums)
        self.step += 1
        for name, value in self.held.items():  # Adam
            gradient, (mean, square) = sums[name] / len(rows), self.means[name]
            mean += 0.1 * (gradient - mean)
            square += 0.001 * (gradient * gradient - square)
            value -= RATE * (mean / (1 - 0.9 ** self.step)) / (np.sqrt(square / (1 - 0.999 ** self.step)) + 1e-8)
        spans, moves = np.concatenate(sums["spans"]), np.concatenate(sums["moves"]) / len(rows)
        spans, inverse = np.unique(spans, return_inverse=True)
        total = np.zeros((len(spans), DIMENSIONS), np.float32)
        np.add.at(total, inverse, moves)
        total[~self.known[spans]] = 0
        self.squares[spans] += (total * total).mean(axis=1)  # Adagrad, for the few rows that a batch touches
        self.net.embedding[spans] -= RATE * total / np.sqrt(self.squares[spans])[:, None]
        self.touched[spans] = True


def first_embeddings(found: np.ndarray, rows: int, toxic: int) -> tuple[np.ndarray, np.ndarray]:
    """Which buckets are known, and the shrunken log-odds of all, from the rows of either label that each bucket is in."""
    share = min(max(toxic / rows, 1e-3), 1 - 1e-3) if rows else 0.5
    odds = np.log((found[1] + PRIOR * share) / (found[0] + PRIOR * (1 - share))) - np.log(share / (1 - share))
    return found.sum(axis=0) >= LEAST_ROWS, odds / 4


def trained(rows: list[np.ndarray], labels: np.ndarray, seed: int = 7) -> Network:
    """A network for these rows. The first embedding of a bucket is its shrunken log-odds; rare buckets stay unknown."""
    rng = np.random.default_rng(seed)
    net = Network(rng)
    known, odds = first_embeddings(bucket_rows(rows, labels), len(labels), int(labels.sum()))
    net.embedding[known, 0] = odds[known]
    net.embedding[known, 1:] = rng.normal(0, 0.05, (int(known.sum()), DIMENSIONS - 1))
    learner = Learner(net, known)
    for _ in range(EPOCHS if len(rows) else 0):
        order = rng.permutation(len(rows))
        for at in range(0, len(order), BATCH):
            batch = order[at:at + BATCH]
            learner.learn([rows[k] for k in batch], [int(labels[k]) for k in batch])
    return net


def bucket_rows(rows: list[np.ndarray], labels: np.ndarray) -> np.ndarray:
    """Rows of either label that each bucket is in."""
    found = np.zeros((2, BUCKETS + 1))
    for ids, label in zip(rows, labels):
        found[int(label), np.unique(ids)] += 1
    return found


@dataclass(frozen=True)
class Model:
    """A network, and a threshold on its output for each language that texts are guessed to be in."""
    network: Network
    language_words: np.ndarray  # log-likelihood of each bucket in each language
    thresholds: np.ndarray  # for each language

    def score(self, text: str | None) -> float:
        ids = word_buckets(text)
        margin = self.network.logit(ids) - self.thresholds[self.language(ids)]
        return float(1 / (1 + np.exp(-np.clip(margin, -30, 30) - np.log(CUT / (1 - CUT)))))

    def language(self, ids: np.ndarray) -> int:
        """The likeliest language by word counts; the first where none differs."""
        return int(self.language_words[ids].sum(axis=0).argmax()) if len(ids) else 0


def _frequent(often: dict[str, int]) -> list[str]:
    """The languages with a threshold of their own, in order."""
    return sorted(sorted(often, key=lambda lang: (-often[lang], lang))[:LANGUAGES]) or [""]


def _language_words(rows: list[np.ndarray], langs: list[str | None]) -> np.ndarray:
    names = _frequent(Counter(lang for lang in langs if lang is not None))
    counts = np.zeros((BUCKETS + 1, len(names)))
    for ids, lang in zip(rows, langs):
        if lang in names:
            np.add.at(counts[:, names.index(lang)], ids, 1)
    return _likelihoods(counts)


def _likelihoods(counts: np.ndarray) -> np.ndarray:
    counts = counts + 0.1
    return np.log(counts / counts.sum(axis=0)).astype(np.float32)


def best_threshold(logits: np.ndarray, labels: np.ndarray, rows: np.ndarray | None = None) -> float:
    """The cut with the largest F1 where logits at or above it are called 1: midway between the two logits around it.

    With `rows`, a logit stands for so many rows, and its label is how many of them are 1.
    """
    order = np.argsort(-logits, kind="stable")
    hits = np.cumsum(labels[order])
    called = np.arange(1, len(order) + 1) if rows is None else np.cumsum(rows[order])
    f1 = 2 * hits / (called + labels.sum())
    f1[:-1][logits[order][:-1] == logits[order][1:]] = -1  # equal logits are not to be parted
    last = int(f1.argmax())
    here = logits[order][last]
    return float((here + logits[order][last + 1]) / 2 if last + 1 < len(order) else here - 1)


def fitted(rows: list[np.ndarray], labels: np.ndarray, langs: list[str | None], aside: np.ndarray | None = None) -> Model:
    """The model of labelled rows: three of four train the network, the others (`aside`) set the thresholds."""
    if aside is None:
        aside = np.arange(len(rows)) % CALIBRATE == 0 if len(rows) >= CALIBRATED else np.zeros(len(rows), bool)
    network = trained([r for r, a in zip(rows, aside) if not a], labels[~aside])
    model = Model(network, _language_words(rows, langs), np.zeros(1))
    chosen = np.flatnonzero(aside)
    logits = np.array([network.logit(rows[k]) for k in chosen])
    guessed = np.array([model.language(rows[k]) for k in chosen], np.int64)
    return Model(network, model.language_words, _thresholds(model.language_words.shape[1], guessed, logits, labels[chosen]))


def _thresholds(langs: int, guessed: np.ndarray, logits: np.ndarray, hits: np.ndarray, rows: np.ndarray | None = None) -> np.ndarray:
    """A threshold for each language: its own where it has enough rows of either label, else that of all."""
    rows = np.ones(len(logits), np.int64) if rows is None else rows
    common = best_threshold(logits, hits, rows) if hits.sum() else 0.0
    thresholds = np.full(langs, common)
    for lang in range(langs):
        own = guessed == lang
        if min(hits[own].sum(), (rows - hits)[own].sum()) >= LEAST_CALIBRATING:
            thresholds[lang] = best_threshold(logits[own], hits[own], rows[own])
    return thresholds


def learning_rows(docs: DataFrame, labels: DataFrame) -> tuple[DataFrame, int]:
    """All labelled rows of docs, stored by shards, as hashed words with a label, and how many they are.

    Rows that repeat a label's id count once, with the larger label. A shard is chosen by hashed id and text and sorted by it,
    so neither depends on the session.
    """
    known = labels.filter(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    total = docs.select("doc_id").join(known.hint("shuffle_hash"), "doc_id").count()
    shards = max(1, -(-total // SHARD_ROWS))

    @F.arrow_udf("array<int>")
    def hashed(texts: pa.Array) -> pa.Array:
        return pa.array([word_buckets(t) for t in texts.to_pylist()], pa.list_(pa.int32()))

    rows = docs.join(known.hint("shuffle_hash"), "doc_id").withColumn("text_hash", F.xxhash64("text")).withColumn(
        "mark", F.xxhash64("doc_id", "text_hash"))
    found = rows.select(
        "doc_id", "text_hash", "mark", F.col("toxic").cast("int").alias("toxic"), "lang",
        F.pmod(F.col("mark"), F.lit(shards)).cast("int").alias("shard"),
        # Numbers of other bits than those that choose the shard.
        (F.pmod(F.shiftright("mark", 32), F.lit(CALIBRATE)) == 0 if total >= CALIBRATED else F.lit(False)).alias("aside"),
        hashed(F.col("text")).alias("ids"))
    dealt = found.repartitionById(shards, F.col("shard")).sortWithinPartitions("shard", "mark", "doc_id")
    return stored(dealt, "toxicity-rows"), total


def learned(docs: DataFrame, labels: DataFrame) -> Model:
    """The model of all labelled rows of docs (doc_id, text, lang). Labels other than 0 and 1 teach nothing.

    A first model is learned on the driver from at most LEARN_ROWS rows of up to LEARN_WORDS words, as hashed words: a
    bound of 4 bytes x both numbers. Where these are not all rows, `refined` goes on with all.
    """
    bounded_batches(docs.sparkSession)
    rows, total = learning_rows(docs, labels)
    ids = rows.select("doc_id").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(LEARN_ROWS)
    sample = rows.join(F.broadcast(ids), "doc_id", "left_semi").filter(F.size("ids") <= LEARN_WORDS)
    found = first_rows(sample.select("doc_id", "text_hash", "toxic", "lang", "aside", "ids"), LEARN_ROWS)
    own = sample_arrays(found["ids"]), found["toxic"].to_numpy().astype(np.int64), found["lang"].to_pylist()
    if found.num_rows == total:
        return fitted(*own)
    aside = found["aside"].to_numpy(zero_copy_only=False)
    trains = own[1][~aside]
    began = first_embeddings(bucket_rows([r for r, a in zip(own[0], aside) if not a], trains), len(trains), int(trains.sum()))
    return refined(fitted(*own, aside), began, rows)


def refined(start: Model, began: tuple[np.ndarray, np.ndarray], rows: DataFrame) -> Model:
    """The model trained further and calibrated on all rows; `began` is what its embeddings started from.

    Each round trains every shard from the same network and averages what they reach; a bucket is averaged over the
    shards that touched it. Counts, averages and thresholds are aggregations of a bounded size: buckets and languages,
    buckets and dimensions, languages and logits of three decimals.
    """
    often = rows.filter("lang IS NOT NULL").groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(LANGUAGES)
    names = _frequent({r.lang: r.n for r in often.collect()})
    marked = {r.toxic: r.n for r in rows.filter("NOT aside").groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    found, words = _tallies(rows, names)
    known, odds = first_embeddings(found, sum(marked.values()), marked.get(1, 0))
    network, (known_before, odds_before) = copy.deepcopy(start.network), began
    both, new = known & known_before, known & ~known_before
    network.embedding[both, 0] += (odds - odds_before)[both]
    network.embedding[new, 0] = odds[new]
    network.embedding[new, 1:] = np.random.default_rng(11).normal(0, 0.05, (int(new.sum()), DIMENSIONS - 1))
    for _ in range(ROUNDS):
        network = _round(rows.filter("NOT aside"), network, known)
    model = Model(network, _likelihoods(words), np.zeros(1))
    return Model(network, model.language_words, _thresholds(len(names), *_margins(rows.filter("aside"), model)))


def _tallies(rows: DataFrame, names: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Training rows of either label that each bucket is in, and how often each bucket is in each language's rows."""
    place = {name: k + 2 for k, name in enumerate(names)}

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            lists = sample_arrays(pa.chunked_array([batch["ids"]]))
            for ids, toxic, lang, aside in zip(lists, *[batch[c].to_pylist() for c in ("toxic", "lang", "aside")]):
                buckets, often = np.unique(ids, return_counts=True)
                if not aside:
                    held.setdefault(toxic, np.zeros(BUCKETS, np.int64))[buckets] += 1
                if lang in place:
                    held.setdefault(place[lang], np.zeros(BUCKETS, np.int64))[buckets] += often
        for kind, counts in held.items():
            buckets = np.flatnonzero(counts)
            yield pa.record_batch({"kind": np.full(len(buckets), kind, np.int32), "bucket": buckets.astype(np.int32), "n": counts[buckets]})

    counted = rows.select("ids", "toxic", "lang", "aside").mapInArrow(count, "kind int, bucket int, n long")
    table = counted.groupBy("kind", "bucket").agg(F.sum("n").alias("n")).toArrow()
    found = np.zeros((len(names) + 2, BUCKETS + 1))
    found[table["kind"].to_numpy(), table["bucket"].to_numpy()] = table["n"].to_numpy()
    return found[:2], found[2:].T


def _round(rows: DataFrame, network: Network, known: np.ndarray) -> Network:
    """One pass over all shards from this network, and the average of the networks that they end with."""
    held = carried(rows.sparkSession, (network, known))
    values = [f"v{k}" for k in range(DIMENSIONS)]

    def reached(own: Learner) -> pa.RecordBatch:
        moved = np.flatnonzero(own.touched & own.known)
        flat = np.concatenate([v.ravel() for v in own.net.dense().values()])
        dense = np.pad(flat, (0, -len(flat) % DIMENSIONS)).reshape(-1, DIMENSIONS)  # in negative buckets
        buckets = np.concatenate((-1 - np.arange(len(dense)), moved)).astype(np.int32)
        table = np.concatenate((dense, own.net.embedding[moved]))
        return pa.record_batch({"bucket": buckets} | {name: table[:, k].astype(np.float64) for k, name in enumerate(values)})

    def train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, shard, waiting = None, None, []

        def learn() -> None:
            if waiting:
                own.learn([ids for ids, _ in waiting], [toxic for _, toxic in waiting])
                waiting.clear()

        for batch in batches:
            lists = sample_arrays(pa.chunked_array([batch["ids"]]))
            for ids, toxic, at in zip(lists, *[batch[c].to_pylist() for c in ("toxic", "shard")]):
                if at != shard:
                    if own is not None:
                        learn()
                        yield reached(own)
                    start, these = held()
                    own, shard = Learner(copy.deepcopy(start), these), at
                waiting.append((ids, toxic))
                if len(waiting) == BATCH:
                    learn()
        if own is not None:
            learn()
            yield reached(own)

    schema = "bucket int, " + ", ".join(f"{name} double" for name in values)
    ended = rows.select("ids", "toxic", "shard").mapInArrow(train, schema)
    table = ended.groupBy("bucket").agg(*[F.avg(name).alias(name) for name in values]).toArrow()
    buckets = table["bucket"].to_numpy()
    means = np.column_stack([table[name].to_numpy() for name in values]).astype(np.float32)
    averaged = copy.deepcopy(network)
    averaged.embedding[buckets[buckets >= 0]] = means[buckets >= 0]
    flat, at = means[buckets < 0][np.argsort(-buckets[buckets < 0])].ravel(), 0
    for value in averaged.dense().values() if len(flat) else ():
        value[...] = flat[at:at + value.size].reshape(value.shape)
        at += value.size
    return averaged


def _margins(rows: DataFrame, model: Model) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Guessed language, logit to three decimals, toxic rows and rows: one entry for each language and logit."""
    held = carried(rows.sparkSession, model)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, own = Counter(), held()
        for batch in batches:
            for ids, toxic in zip(sample_arrays(pa.chunked_array([batch["ids"]])), batch["toxic"].to_pylist()):
                seen[own.language(ids), round(float(np.clip(own.network.logit(ids), -30, 30)), 3), toxic] += 1
        lang, logit, toxic = zip(*seen) if seen else ((), (), ())
        n = np.array([*seen.values()], np.int64)
        yield pa.record_batch({"lang": np.array(lang, np.int32), "logit": np.array(logit, float), "hits": n * np.array(toxic, np.int64), "n": n})

    counted = rows.select("ids", "toxic").mapInArrow(measure, "lang int, logit double, hits long, n long")
    table = counted.groupBy("lang", "logit").agg(F.sum("hits").alias("hits"), F.sum("n").alias("n")).toArrow()
    table = table.sort_by([("lang", "ascending"), ("logit", "ascending")])
    return tuple(table[name].to_numpy() for name in ("lang", "logit", "hits", "n"))


def scored(text: Column, model: Model, spark) -> Column:
    held = carried(spark, model)

    @F.arrow_udf("double")
    def score(texts: pa.Array) -> pa.Array:
        own = held()
        return pa.array([own.score(t) for t in texts.to_pylist()], pa.float64())

    return score(text)


def report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score and predicted of every row; learned from rows that are not held out.

    A row without an id is not learned from and not held out. Null or empty text is scored as no words; repeated rows
    get the same score; without any label all rows get one score; an empty table gives an empty one.
    """
    number = fold(F.col("doc_id"))
    model = learned(docs.filter(number != 1).select("doc_id", "text", "lang"), labels)
    score = F.explode(F.array(scored(F.col("text"), model, docs.sparkSession))).alias("score")
    return docs.select("doc_id", F.coalesce(number == 1, F.lit(False)).alias("held_out"), score).withColumn(
        "predicted", (F.col("score") >= CUT).cast("int"))
