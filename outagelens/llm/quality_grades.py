"""Quality classifier: ordinal cumulative-link regression on hashed text, trained in numpy."""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from outagelens.llm.shared import bounded_batches, carried, first_rows, labelled_sample, sample_arrays

#: Hashed features.
BUCKETS = 1 << 16
#: The grades that the two labels amount to: 0 poor, 1 fair (good text, but toxic), 2 good.
GRADES = 3
#: Rated rows that are learned from, at most, chosen by hashed id and text, and the features that one may have.
LEARN_ROWS, LEARN_FEATURES = 8_000, 10_000
EPOCHS, BATCH, RATE, DECAY = 12, 128, 0.5, 1e-5
#: Words that count as near for the repetition feature.
NEAR = 8
#: A document is selected if it reaches GOOD_GRADE at least with this probability.
GOOD_GRADE, SELECT = 1, 0.5

_SHAPES = bytes(65 if 65 <= c <= 90 else 97 if 97 <= c <= 122 or c > 127 else 48 if 48 <= c <= 57 else c for c in range(256))
_AGAIN, _NEW = zlib.crc32(b"again"), zlib.crc32(b"new")
_PLAIN = bytes(c if chr(c).isalnum() or c > 127 else 32 for c in range(256))


def features(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """The buckets of a text's features and their values; a bucket that two features share is there twice.

    Three kinds share the buckets: words in lower case, shapes of space-separated tokens (letters, capitals, digits and
    signs, runs shortened to two), and repetition (a word equal to one of the NEAR words before it, or not). A value is
    the square root of the feature's share of its kind, so each kind has length 1 whatever the text's length.
    """
    whole = (text or "").encode("utf-8", "surrogatepass")
    words = whole.lower().translate(_PLAIN).split()
    shape = np.frombuffer(whole.translate(_SHAPES), np.uint8)
    longer = np.zeros(len(shape), np.bool_)
    longer[2:] = (shape[2:] == shape[1:-1]) & (shape[2:] == shape[:-2])
    shapes = shape[~longer].tobytes().split()
    hashes = np.fromiter(map(zlib.crc32, words), np.uint32, len(words))
    again = np.zeros(len(words), np.bool_)
    for back in range(1, min(NEAR, len(words) - 1) + 1):
        again[back:] |= hashes[back:] == hashes[:-back]
    kinds = (hashes, np.fromiter((zlib.crc32(s, 1) for s in shapes), np.uint32, len(shapes)),
             np.where(again, _AGAIN, _NEW).astype(np.uint32))
    keys = np.concatenate([(kind & np.uint32(BUCKETS - 1)).astype(np.int64) + k * BUCKETS for k, kind in enumerate(kinds)])
    found, counts = np.unique(keys, return_counts=True)
    sizes = np.array([max(1, len(kind)) for kind in kinds])
    return (found % BUCKETS).astype(np.int32), np.sqrt(counts / sizes[found // BUCKETS]).astype(np.float32)


def grade(quality: Column, toxic: Column) -> Column:
    """0 for poor text, 1 for good but toxic text, 2 for good text; null where the quality label is."""
    return F.when(quality == 0, 0).when(quality == 1, F.when(toxic == 1, 1).otherwise(2))


@dataclass(frozen=True)
class Model:
    """Weights that all grades share, and ascending thresholds: P(grade > k) = 1 / (1 + exp(threshold k - weight of the text))."""
    weights: np.ndarray
    thresholds: np.ndarray

    def tails(self, text: str | None) -> np.ndarray:
        """P(grade >= 1), P(grade >= 2), ... of a text, descending."""
        buckets, values = features(text)
        return _sigmoid(values @ self.weights[buckets] - self.thresholds)

    def expected(self, tails: np.ndarray) -> float:
        return float(tails.sum())


def _sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def fitted(rows: list[tuple[np.ndarray, np.ndarray]], grades: np.ndarray, seed: int = 7) -> Model:
    """The proportional-odds model by maximum likelihood, with Adagrad over small batches.

    The thresholds are a first one and positive steps, so they stay ordered. They start at the grades' observed odds;
    without rows all grades are equally likely.
    """
    above = np.array([(grades > k).mean() if len(rows) else (GRADES - 1 - k) / GRADES for k in range(GRADES - 1)])
    above = np.clip(above, 1e-3, 1 - 1e-3)
    first = np.log((1 - above) / above)
    place = np.concatenate((first[:1], np.log(np.maximum(np.diff(first), 1e-2))))  # first threshold, logs of the steps
    weights = np.zeros(BUCKETS)
    squares, place_squares = np.full(BUCKETS, 1e-4), np.full(len(place), 1e-2)
    rng = np.random.default_rng(seed)
    for _ in range(EPOCHS if len(rows) else 0):
        order = rng.permutation(len(rows))
        for at in range(0, len(order), BATCH):
            batch = order[at:at + BATCH]
            buckets = np.concatenate([rows[k][0] for k in batch])
            values = np.concatenate([rows[k][1] for k in batch]).astype(np.float64)
            of = np.repeat(np.arange(len(batch)), [len(rows[k][0]) for k in batch])
            score = np.bincount(of, values * weights[buckets], minlength=len(batch))
            by_score, by_threshold = _slopes(score, grades[batch], np.cumsum(np.concatenate((place[:1], np.exp(place[1:])))))
            slope = np.bincount(buckets, values * by_score[of], minlength=BUCKETS) / len(batch)
            touched = np.unique(buckets)
            slope = slope[touched] + DECAY * weights[touched]
            squares[touched] += slope * slope
            weights[touched] -= RATE * slope / np.sqrt(squares[touched])
            from_here = np.cumsum(by_threshold.mean(axis=0)[::-1])[::-1]  # a step moves its threshold and all later ones
            turn = from_here * np.concatenate(([1.0], np.exp(place[1:])))
            place_squares += turn * turn
            place -= RATE * turn / np.sqrt(place_squares)
    return Model(weights, np.cumsum(np.concatenate((place[:1], np.exp(place[1:])))))


def _slopes(score: np.ndarray, grades: np.ndarray, thresholds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Gradients of -log P(grade) by score, and by each threshold."""
    tails = np.column_stack((np.ones(len(score)), _sigmoid(score[:, None] - thresholds), np.zeros(len(score))))
    rows = np.arange(len(score))
    high, low = tails[rows, grades], tails[rows, grades + 1]
    chance = np.maximum(high - low, 1e-9)
    up, down = high * (1 - high) / chance, low * (1 - low) / chance
    by_threshold = np.zeros((len(score), len(thresholds) + 2))
    by_threshold[rows, grades] += up
    by_threshold[rows, grades + 1] -= down
    return down - up, by_threshold[:, 1:-1]


def learned(docs: DataFrame, labels: DataFrame) -> Model:
    """The model of rated documents, learned on the driver from a bounded sample.

    At most LEARN_ROWS rows of up to LEARN_FEATURES hashed features: a bound of 8 bytes x both numbers.
    """
    bounded_batches(docs.sparkSession)
    rated = labels.select("doc_id", grade(F.col("quality"), F.col("toxic")).alias("grade"))
    sample = labelled_sample(docs, rated, "grade", LEARN_ROWS)

    @F.arrow_udf("buckets array<int>, shares array<float>")
    def hashed(texts: pa.Array) -> pa.Array:
        found = [features(t) for t in texts.to_pylist()]
        return pa.StructArray.from_arrays(
            [pa.array([b for b, _ in found], pa.list_(pa.int32())), pa.array([v for _, v in found], pa.list_(pa.float32()))],
            ["buckets", "shares"])

    found = sample.select("doc_id", "text_hash", "grade", F.explode(F.array(hashed(F.col("text")))).alias("found")).select(
        "doc_id", "text_hash", "grade", "found.*")
    rows = first_rows(found.filter(F.size("buckets") <= LEARN_FEATURES), LEARN_ROWS)
    return fitted(list(zip(sample_arrays(rows["buckets"]), sample_arrays(rows["shares"]))), rows["grade"].to_numpy().astype(np.int64))


def graded(text: Column, model: Model, spark) -> Column:
    """struct of expected_grade and tail_probability, that of GOOD_GRADE or better, for each text."""
    held = carried(spark, model)

    @F.arrow_udf("expected_grade double, tail_probability double")
    def judge(texts: pa.Array) -> pa.Array:
        own = held()
        tails = [own.tails(t) for t in texts.to_pylist()]
        return pa.StructArray.from_arrays(
            [pa.array([own.expected(t) for t in tails], pa.float64()), pa.array([float(t[GOOD_GRADE - 1]) for t in tails], pa.float64())],
            ["expected_grade", "tail_probability"])

    return judge(text)


def report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, expected_grade (0 to 2), tail_probability and kept (it reaches SELECT) of every row.

    Null or empty text has no features and gets the odds of the thresholds alone; repeated rows get the same answer;
    labels without a quality teach nothing; without any the three grades are equally likely; an empty table gives an
    empty one.
    """
    model = learned(docs.select("doc_id", "text"), labels)
    found = F.explode(F.array(graded(F.col("text"), model, docs.sparkSession))).alias("found")
    return docs.select("doc_id", found).select("doc_id", "found.*").withColumn("kept", F.col("tail_probability") >= SELECT)
