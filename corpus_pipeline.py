"""From raw documents to token ids: quality rules, line dedup, SimHash near-dedup, mixing, BPE."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from outagelens.llm import bpe, line_spread, mixing, quality_rules, simhash
from outagelens.llm.shared import read_table, stored, tokenizer_path


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that neither the base rules nor the learned list reject."""
    rules = quality_rules.learn(quality_rules.learning_rows(docs, read_table(spark, sf_dir, "labels")))
    return quality_rules.accepted(docs, rules)


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without lines that many sources share."""
    return line_spread.deduplicated(docs)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates."""
    return simhash.kept(docs)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it."""
    return mixing.mixed(docs)


def bpe_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with their token ids."""
    return bpe.encoded(docs, tokenizer_path())


STAGES = [
    ("quality_rules", quality_stage),
    ("line_dedup", line_stage),
    ("simhash_near_dedup", near_stage),
    ("mixing", mixing_stage),
    ("bpe", bpe_stage),
]

#: SQL cannot express the learned rules, the link graph and the tokenizer; tests compare with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each stored for the next."""
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
