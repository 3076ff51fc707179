"""Bounds and odd input: samples, labels, turn numbers, rows without ids, shared lines, plain versions of the scores."""

import math
import random
import time
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from outagelens.llm import chat, line_spread, mixing, quality_grades, toxicity
from outagelens.llm.shared import first_rows, labelled_sample

from .rows import DOCS, sha

TURNS = "conv_id long, turn long, role string, text string"
LABELS = "doc_id long, quality int, toxic int"


def test_an_id_on_many_rows_fills_no_sample(spark):
    rows = spark.range(20_000).selectExpr("7L AS doc_id", "concat('text ', id) AS text").union(
        spark.createDataFrame([(8, "other")], "doc_id long, text string"))
    labels = spark.createDataFrame([(7, 1, 1), (8, 0, 0), (8, 1, 0)], LABELS)
    sample = labelled_sample(rows, labels, "toxic", 100)
    found = first_rows(sample.select("doc_id", "text_hash", "toxic"), 100)
    again = first_rows(sample.repartition(7).select("doc_id", "text_hash", "toxic"), 100)
    assert found.num_rows == 100 and found.equals(again)


def test_learning_takes_no_more_rows_or_features_than_it_says(spark, monkeypatch):
    rows = spark.range(3000).selectExpr("if(id < 2000, 7L, id) AS doc_id", "concat('word', id % 50, ' good text') AS text", "'en' AS lang")
    long = spark.createDataFrame([(5000, " ".join(f"w{k}" for k in range(3000)), "en")], "doc_id long, text string, lang string")
    labels = spark.range(6000).selectExpr("id AS doc_id", "int(id % 2) AS quality", "int(id % 2) AS toxic")
    seen = []
    for module, name, rows_at_most, size in ((quality_grades, "LEARN_FEATURES", 300, 1000), (toxicity, "LEARN_WORDS", 300, 1000)):
        monkeypatch.setattr(module, "LEARN_ROWS", rows_at_most)
        monkeypatch.setattr(module, name, size)
        kept = module.fitted
        monkeypatch.setattr(module, "fitted", lambda own, *rest, kept=kept: seen.append(own) or kept(own, *rest))
        module.learned(rows.union(long).select("doc_id", "text", *["lang"] * (module is toxicity)), labels)
    assert [len(own) for own in seen] == [300, 300]
    assert all(len(x[0] if isinstance(x, tuple) else x) <= 1000 for own in seen for x in own)


def test_all_labelled_rows_teach_beyond_the_first_model(spark, monkeypatch):
    """Counts, network and thresholds: a word that only rows behind the first model have is learned all the same."""
    monkeypatch.setattr(toxicity, "LEARN_ROWS", 200)
    monkeypatch.setattr(toxicity, "SHARD_ROWS", 400)
    rng = random.Random(4)
    rows = [(k, " ".join(rng.choices(["plain", "kind", "good", "calm"], k=6)), "en" if k % 2 else "fr", "s", 0) for k in range(1600)]
    docs = spark.createDataFrame(rows, DOCS)
    first = [r.doc_id for r in docs.orderBy(F.xxhash64("doc_id"), "doc_id").limit(200).select("doc_id").collect()]
    # The first model's rows are told apart by another word than all others.
    word = {k: ("vile" if k in first else "scorn") if k % 4 == 0 else "calm" for k, *_ in rows}
    docs = spark.createDataFrame([(k, f"{text} {word[k]}", *rest) for k, text, *rest in rows], DOCS)
    labels = spark.createDataFrame([(k, 1, int(k % 4 == 0)) for k in range(1600)], LABELS)
    stored, total = toxicity.learning_rows(docs.select("doc_id", "text", "lang"), labels)
    kept = stored.collect()
    assert total == len(kept) == 1600 and len({r.shard for r in kept}) == 4
    found, words = toxicity._tallies(stored, ["en", "fr"])
    trains = [r for r in kept if not r.aside]
    scorn = zlib.crc32(b"scorn") % toxicity.BUCKETS
    assert found[1, scorn] == sum(word[r.doc_id] == "scorn" for r in trains) and found[0, scorn] == 0
    assert words[:, 0].sum() == words[:, 1].sum() == 800 * 7
    model = toxicity.learned(docs.select("doc_id", "text", "lang"), labels)
    assert model.score("good calm scorn plain") >= toxicity.CUT > model.score("good calm kind plain")
    lang, logit, hits, n = toxicity._margins(stored.filter("aside"), model)
    assert n.sum() == len(kept) - len(trains) and hits.sum() == sum(r.toxic for r in kept if r.aside)
    assert toxicity.best_threshold(np.repeat(logit, n), np.concatenate([[1] * h + [0] * (m - h) for h, m in zip(hits, n)])) == pytest.approx(
        toxicity.best_threshold(logit, hits, n))


def test_labels_and_languages_of_any_kind(spark, monkeypatch):
    monkeypatch.setattr(toxicity, "LANGUAGES", 3)
    rows = [(k, "vile words here" if k % 2 else "kind words here", f"lang{k % 40}", "s", 0) for k in range(400)]
    docs = spark.createDataFrame(rows, DOCS)
    labels = spark.createDataFrame([(k, 1, k % 2 if k % 5 else (2 if k % 2 else -1)) for k in range(400)], LABELS)
    model = toxicity.learned(docs.select("doc_id", "text", "lang"), labels)
    assert model.language_words.shape == (toxicity.BUCKETS + 1, 3) and len(model.thresholds) == 3
    found = toxicity.report(docs, labels).collect()
    assert len(found) == 400 and all(0 <= r.score <= 1 for r in found)


def test_scores_equal_plain_ones(spark):
    """Convolutions, maxima and thresholds; cumulative links: worked out one by one from the learned weights."""
    rng = random.Random(3)
    texts = ["", None, "one", "Two Words!", "é ü", *[" ".join(rng.choices(["vile", "kind", "plain", "Words", "and", "42"], k=rng.randint(1, 30))) for _ in range(150)]]
    rows = [(k, t, "en", "s", 0) for k, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, DOCS)
    labels = spark.createDataFrame([(k, int("kind" in (t or "")), int("vile" in (t or ""))) for k, t, *_ in rows], LABELS)
    model = toxicity.learned(docs.select("doc_id", "text", "lang"), labels)
    net = model.network
    found = {r.doc_id: r.score for r in docs.select("doc_id", toxicity.scored(F.col("text"), model, spark).alias("score")).collect()}
    for k, text, *_ in rows:
        words = "".join(c if c.isalpha() or ord(c) > 127 else " " for c in (text or "").lower()).split()
        ids = [zlib.crc32(w.encode()) % toxicity.BUCKETS for w in words]
        padded = ids + [toxicity.BUCKETS] * (max(toxicity.WIDTHS) - len(ids))
        total, unit = float(net.bias[0]), 0
        for width, kernel in zip(toxicity.WIDTHS, net.kernels):
            for f in range(toxicity.FILTERS):
                best = max(sum(float(net.embedding[padded[i + j]][d]) * float(kernel[j * toxicity.DIMENSIONS + d][f])
                               for j in range(width) for d in range(toxicity.DIMENSIONS)) for i in range(len(padded) - width + 1))
                total += max(best + float(net.offsets[unit]), 0) * float(net.weights[unit])
                unit += 1
        margin = min(max(total - model.thresholds[0], -30), 30)
        assert found[k] == pytest.approx(1 / (1 + math.exp(-margin - math.log(toxicity.CUT / (1 - toxicity.CUT)))), abs=1e-4)
    grades = quality_grades.learned(docs.select("doc_id", "text"), labels)
    held = docs.select("doc_id", quality_grades.graded(F.col("text"), grades, spark).alias("g")).select("doc_id", "g.*").collect()
    for row in held:
        buckets, values = quality_grades.features(texts[row.doc_id])
        score = sum(float(v) * grades.weights[b] for b, v in zip(buckets, values))
        tails = [1 / (1 + math.exp(t - score)) for t in grades.thresholds]
        assert row.expected_grade == pytest.approx(sum(tails), abs=1e-5) and row.tail_probability == pytest.approx(tails[0], abs=1e-5)
    assert np.all(np.diff(grades.thresholds) > 0)


def test_turn_numbers_of_any_size(spark):
    rows = [(1, 2**40, "assistant", "late"), (1, 2147483648, "user", "middle " * 300), (1, -5, "system", "early"), (1, 2**63 - 1, "user", "last")]
    found = {r.conv_id: r for r in chat.report(spark.createDataFrame(rows, TURNS)).collect()}
    turns = sorted(rows, key=lambda r: r[1])
    assert found[1].n_turns == 4 and found[1].turns_sha256 == sha("".join(f"{role}\n{text}\n" for _, _, role, text in turns))


def test_rows_without_an_id_spread_over_blocks(spark):
    table = spark.range(20_000).selectExpr("if(id % 2 = 0, NULL, id) AS doc_id", "concat('some text ', id) AS text", "'a' AS source")
    block = F.conv(F.substring(mixing.own_hash(F.col("doc_id"), F.col("text")), 1, 4), 16, 10).cast("int") % mixing.BLOCKS
    sizes = [r["count"] for r in table.groupBy(block.alias("block")).count().collect()]
    assert len(sizes) == mixing.BLOCKS and max(sizes) < 2 * sum(sizes) / len(sizes)
    report = mixing.report(table)
    assert report.count() == 20_000 and report.agg(F.sum("taken")).first()[0] == pytest.approx(60_000, rel=0.01)


def test_many_shared_lines_in_a_document_take_time_in_proportion(spark):
    def took(lines):
        text = "\n".join(f"shared line {k}" for k in range(lines))
        table = spark.createDataFrame([(k, text + f"\nown {k}", "en", f"s{k}", 0) for k in range(9)], DOCS)
        start = time.time()
        found = {r.doc_id: r for r in line_spread.report(table).collect()}
        assert found[0].lines_removed == 0 and all(found[k].text == f"own {k}" and found[k].lines_removed == lines for k in range(1, 9))
        return time.time() - start

    took(100)
    small, large = took(6000), took(24_000)
    assert large < 4 * small + 10
