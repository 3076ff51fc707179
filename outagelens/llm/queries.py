"""The registered queries of this subpackage, and the SQL that checks them where SQL can."""

from __future__ import annotations

from outagelens.llm import (
    bpe, chat, collocations, fingerprints, language, line_spread, mixing, prefix_trie, quality_grades, quality_rules,
    simhash, substrings, toxicity,
)
from outagelens.llm.shared import read_table, tokenizer_path


def op1_chat(spark, folder):
    return chat.report(read_table(spark, folder, "conversations"))


def op2_bpe(spark, folder):
    return bpe.report(read_table(spark, folder, "documents"), tokenizer_path())


def op3_quality_grades(spark, folder):
    return quality_grades.report(read_table(spark, folder, "documents"), read_table(spark, folder, "labels"))


def op4_quality_rules(spark, folder):
    return quality_rules.report(read_table(spark, folder, "documents"), read_table(spark, folder, "labels"))


def op5_line_dedup(spark, folder):
    return line_spread.report(read_table(spark, folder, "documents"))


def op6_toxicity(spark, folder):
    return toxicity.report(read_table(spark, folder, "documents"), read_table(spark, folder, "labels"))


def op7_language(spark, folder):
    return language.report(read_table(spark, folder, "documents"))


def op8_fingerprints(spark, folder):
    return fingerprints.edits(read_table(spark, folder, "documents"))


def op9_simhash(spark, folder):
    return simhash.report(read_table(spark, folder, "documents"))


def op10_mixing(spark, folder):
    return mixing.report(read_table(spark, folder, "documents"))


def op11_substrings(spark, folder):
    return substrings.report(read_table(spark, folder, "documents"))


def op12_collocations(spark, folder):
    return collocations.collocations(read_table(spark, folder, "documents"))


def op13_prefix_trie(spark, folder):
    return prefix_trie.report(read_table(spark, folder, "conversations"))


QUERIES = {f.__name__: f for f in (op1_chat, op2_bpe, op3_quality_grades, op4_quality_rules, op5_line_dedup, op6_toxicity, op7_language, op8_fingerprints,
                                 op9_simhash, op10_mixing, op11_substrings, op12_collocations, op13_prefix_trie)}

ORACLE_SQL = {"op5_line_dedup": line_spread.REPORT_SQL, "op10_mixing": mixing.REPORT_SQL,
              "op12_collocations": collocations.REPORT_SQL, "op13_prefix_trie": prefix_trie.REPORT_SQL}
