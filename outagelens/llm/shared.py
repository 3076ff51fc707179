"""What the operators share: words, line keys, the shared folder for cut lineage, fold numbers."""

from __future__ import annotations

import pickle
import sys
import types
import uuid

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from outagelens.sources.checkpoints import shared_folder

#: The characters that separate words: space and U+0009 to U+000D.
SPACES = " \t\n\x0b\x0c\r"


def read_table(spark: SparkSession, folder: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{table}.parquet")


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    """Where the public vocabulary file is; operators take any path."""
    import public_tokenizers

    return str(public_tokenizers.path(name))


def stored(table: DataFrame, label: str) -> DataFrame:
    """The table, written once to the shared folder and read back: its lineage ends there.

    A reader sees a plain scan, so joins on it get exchanges that Spark can split at run time, and its measured size
    decides whether it is broadcast. The folder is removed when the session ends.
    """
    spark = table.sparkSession
    path = f"{shared_folder(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"
    table.write.parquet(path)
    jvm = spark.sparkContext._jvm
    place = jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(place)
    return spark.read.schema(table.schema).parquet(path)


def let(value: Column, body) -> Column:
    """body(value), with value worked out once per row however often body names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def words_of(text: Column) -> Column:
    """The maximal runs of characters other than SPACES; none for a null text."""
    trimmed = F.btrim(F.coalesce(text, F.lit("")), F.lit(SPACES))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, r"[ \t\n\x0B\f\r]+"))


def spread(key: Column, parts: int) -> Column:
    """A part number, 0 up to parts, that depends on the key's value only."""
    return F.pmod(F.xxhash64(key), F.lit(parts))


def fold(doc_id: Column) -> Column:
    """crc32 of the id as text, modulo 3."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 3


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, rows: int) -> DataFrame:
    """docs with the label, and text_hash, for at most `rows` document ids that have one: the first by hashed id.

    Rows that repeat a label's id count once, with the larger label. The ids are a proven bound, so they are
    broadcast and no text is shuffled. An id that is there more than once gives as many rows: `first_rows` bounds them.
    """
    chosen = (labels.filter(F.col(label).isNotNull() & F.col("doc_id").isNotNull())
              .groupBy("doc_id").agg(F.max(label).alias(label)))
    there = chosen.join(docs.select("doc_id"), "doc_id", "left_semi")
    ids = there.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    return docs.withColumn("text_hash", F.xxhash64("text")).join(F.broadcast(ids), "doc_id")


def first_rows(learning: DataFrame, rows: int) -> pa.Table:
    """The first `rows` rows of features (doc_id, text_hash, ...) by hashed id and text, on the driver, in that order."""
    order = [F.xxhash64("doc_id"), "doc_id", "text_hash"]
    return learning.orderBy(*order).limit(rows).toArrow().sort_by([("doc_id", "ascending"), ("text_hash", "ascending")])


def sample_arrays(lists) -> list[np.ndarray]:
    """The lists of an Arrow column as arrays."""
    joined = lists.combine_chunks()
    offsets, values = joined.offsets.to_numpy(), joined.values.to_numpy()
    return [values[a:b] for a, b in zip(offsets, offsets[1:])]


BATCH_SETTING, BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", "4m"


def bounded_batches(spark: SparkSession) -> SparkSession:
    """The session, sending texts to Python in small Arrow batches, unless it names a size of its own.

    The usual 64 MB are held several times over, by the JVM and by each Python worker.
    """
    if spark.conf.get(BATCH_SETTING) == "67108864b":
        spark.conf.set(BATCH_SETTING, BATCH_BYTES)
    return spark


def per_process(name: str, make):
    """make(), once in each Python worker: a worker unpickles functions anew for every task, but keeps its modules."""
    held = sys.modules.setdefault("llm_worker_state", types.ModuleType("llm_worker_state")).__dict__
    if name not in held:
        held[name] = make()
    return held[name]


class _Whole:
    """A value that is pickled with its functions and classes, and unpickled as itself."""

    def __init__(self, value):
        self.value = value

    def __reduce__(self):
        return pickle.loads, (cloudpickle.dumps(self.value),)


def carried(spark: SparkSession, value):
    """A function that gives the value in any task: it is broadcast once, and a Python worker keeps it, but not its
    pickled form, until a task comes that is sent others.

    For models of a bounded size only.
    """
    held = bounded_batches(spark).sparkContext.broadcast(_Whole(value))
    return lambda: held.value


#: Bits of a filter.
FILTER_BITS = 1 << 26


class Filter:
    """Which numbers may be among the `hash` column's: a bit per slot, of a fixed number of slots.

    8 MB, whatever the table holds, so it may be broadcast; the fuller it is, the more others it lets pass.
    """

    def __init__(self, hashes: DataFrame):
        slot = F.pmod("hash", F.lit(FILTER_BITS))
        found = hashes.select(F.floor(slot / 32768).alias("part"), (slot % 32768).alias("bit")).groupBy("part").agg(
            F.bitmap_construct_agg("bit").alias("bits")).collect()
        self.bits = np.zeros(FILTER_BITS // 8, np.uint8) if found else None
        for part, bits in found:
            self.bits[part * 4096:(part + 1) * 4096] = np.frombuffer(bits, np.uint8)

    def has(self, numbers: np.ndarray) -> np.ndarray:
        if self.bits is None:
            return np.zeros(len(numbers), bool)
        slots = np.mod(numbers, FILTER_BITS)
        return (self.bits[slots >> 3] >> (slots & 7).astype(np.uint8)) & 1 == 1
