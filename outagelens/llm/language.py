"""Language identification: each document is a mixture of languages, its shares inferred from hashed n-grams."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from outagelens.llm.shared import bounded_batches, carried, fold, per_process

#: Hashed n-grams: code points in one, and how many buckets they share.
GRAM, BUCKETS = 3, 1 << 15
#: Added to each bucket's count, so that no n-gram has likelihood 0.
SMOOTHING = 0.5
#: Rounds of expectation-maximisation for one set of languages, and the change of a share that ends them early.
ROUNDS, SETTLED = 30, 1e-4
#: What one more language must gain: so many times half the logarithm of the number of n-grams. Neighbouring n-grams
#: share GRAM - 1 of GRAM letters, so their likelihood counts each letter GRAM times.
PENALTY = float(GRAM)
#: A model of more languages than this is refused: the table of the model goes to every executor.
MOST_LANGUAGES = 1000

UNKNOWN = "und"


def _letters() -> np.ndarray:
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), np.bool_, 0x110000)


def gram_counts(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """The buckets of the text's n-grams, ascending, and their counts; none without letters.

    The text is lower-cased and every other run of characters than letters is one space; it begins and ends with one.
    """
    codes = np.frombuffer((text or "").lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    codes = np.where(per_process("letters", _letters)[codes], codes, 32)
    codes = np.concatenate(([32], codes, [32])).astype(np.uint32)
    codes = codes[np.concatenate(([True], (codes[1:] != 32) | (codes[:-1] != 32)))]
    if len(codes) < GRAM:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    mixed = np.zeros(len(codes) - GRAM + 1, np.uint32)
    for k in range(GRAM):
        mixed = mixed * np.uint32(0x01000193) ^ codes[k:len(codes) - GRAM + 1 + k]
    mixed = mixed * np.uint32(0x9E3779B1)
    counts = np.bincount(mixed >> np.uint32(32 - BUCKETS.bit_length() + 1), minlength=BUCKETS)
    found = np.flatnonzero(counts)
    return found, counts[found]


@dataclass(frozen=True)
class Model:
    """Languages, sorted, and the likelihood of each bucket in each of them, one row per bucket."""
    languages: list[str]
    likelihood: np.ndarray

    def mixture(self, text: str | None) -> dict[str, float]:
        """The languages of a text and their shares, which add up to 1; none without letters or languages.

        The set grows from the likeliest single language. The language whose share would rise most from zero is
        tried; if the mixture's log-likelihood gains more than the penalty, it stays, else the set is final. A share
        may fall to zero again. Equal likelihoods go to the language that sorts first.
        """
        buckets, counts = gram_counts(text)
        if not len(buckets) or not self.languages:
            return {}
        seen = self.likelihood[buckets]
        total = counts.sum()
        price = PENALTY * 0.5 * np.log(total)
        chosen = [int(np.argmax(counts @ np.log(seen)))]
        shares = np.ones(1)
        current = counts @ np.log(seen[:, chosen[0]])
        while len(chosen) < len(self.languages):
            rise = (counts / (seen[:, chosen] @ shares)) @ seen / total
            rise[chosen] = 0
            best = int(np.argmax(rise))
            if rise[best] <= 1:
                break
            tried = self._fit(seen[:, [*chosen, best]], counts, total)
            gained = counts @ np.log(seen[:, [*chosen, best]] @ tried)
            if gained - current <= price:
                break
            chosen, shares, current = [*chosen, best], tried, gained
        return {self.languages[k]: float(s) for k, s in zip(chosen, shares) if s > 0}

    @staticmethod
    def _fit(seen: np.ndarray, counts: np.ndarray, total: int) -> np.ndarray:
        """The shares that expectation-maximisation ends at, from equal ones."""
        shares = np.full(seen.shape[1], 1.0 / seen.shape[1])
        for _ in range(ROUNDS):
            new = shares * ((counts / (seen @ shares)) @ seen) / total
            moved = np.abs(new - shares).max()
            shares = new
            if moved < SETTLED:
                break
        return shares

    def predict(self, text: str | None) -> tuple[str, float]:
        """The language with the largest share, and that share; `und` and 0 where there is none."""
        shares = self.mixture(text)
        if not shares:
            return UNKNOWN, 0.0
        best = max(sorted(shares), key=lambda name: shares[name])
        return best, min(1.0, shares[best])


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per language and bucket that the task has seen: a task holds one table, whatever it reads."""
    tables: dict[str, np.ndarray] = {}
    for batch in batches:
        for lang, text in zip(*(c.to_pylist() for c in batch.columns)):
            table = tables.setdefault(lang, np.zeros(BUCKETS, np.int64))
            buckets, counts = gram_counts(text)
            table[buckets] += counts
    for lang, table in tables.items():
        buckets = np.flatnonzero(table)
        yield pa.RecordBatch.from_arrays(
            [pa.array([lang] * len(buckets), pa.string()), pa.array(buckets, pa.int32()), pa.array(table[buckets])],
            names=["lang", "bucket", "n"])


def learned(docs: DataFrame) -> Model:
    """The model of all rows of docs (lang, text) with a language, from counts of every n-gram; no rows, no languages.

    Tasks send one row per language and bucket; the driver gets the sums, a table bounded by languages x BUCKETS.
    """
    bounded_batches(docs.sparkSession)
    rows = docs.filter(F.col("lang").isNotNull()).select("lang", "text").mapInArrow(_count, "lang string, bucket int, n long")
    sums = rows.groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    found = sums.toArrow()
    languages = sorted(set(found["lang"].to_pylist()))
    if len(languages) > MOST_LANGUAGES:
        raise ValueError(f"{len(languages)} languages; at most {MOST_LANGUAGES} are held in one model")
    place = {name: k for k, name in enumerate(languages)}
    counts = np.full((BUCKETS, len(languages)), SMOOTHING)
    columns = np.array([place[name] for name in found["lang"].to_pylist()], np.int64)
    counts[found["bucket"].to_numpy(), columns] += found["n"].to_numpy()
    return Model(languages, (counts / counts.sum(axis=0)) if languages else counts)


def predicted(text: Column, model: Model, spark) -> Column:
    """struct of lang_pred and score for each text."""
    held = carried(spark, model)

    @F.arrow_udf("lang_pred string, score double")
    def predict(texts: pa.Array) -> pa.Array:
        own = held()
        found = [own.predict(t) for t in texts.to_pylist()]
        return pa.StructArray.from_arrays(
            [pa.array([lang for lang, _ in found], pa.string()), pa.array([score for _, score in found], pa.float64())],
            ["lang_pred", "score"])

    return predict(text)


def report(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score: learned from the rows that are not held out, told for all.

    A row without an id is not learned from and not held out. Null text, or one without letters, is `und` with score
    0; repeated rows get the same answer; rows without a language teach nothing; an empty table gives an empty one.
    """
    number = fold(F.col("doc_id"))
    model = learned(docs.filter(number != 1).select("lang", "text"))
    found = F.explode(F.array(predicted(F.col("text"), model, docs.sparkSession))).alias("found")
    return docs.select("doc_id", F.coalesce(number == 1, F.lit(False)).alias("held_out"), found).select(
        "doc_id", "held_out", "found.*")
