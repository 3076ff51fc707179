"""The fuzzy lookup against an edit distance to every label."""

import random

import pytest
from pyspark.sql import functions as F

from outagelens.functions.text import closest_label
from outagelens.operators.fuzzy import similar_pairs, with_closest_label

LABELS = ["Power-Failure", "Power-Failures", "Fibre Cut", "aaaa", "aaaaaa", "x", "", "Zz", "Über Kabel", "A rather long label of many words and letters"]


def changed(rng, text):
    letters = list(text)
    for _ in range(rng.randint(0, 4)):
        kind, at = rng.choice("ids"), rng.randint(0, len(letters))
        if kind == "i":
            letters.insert(at, rng.choice("aepz "))
        elif at < len(letters):
            letters[at:at + 1] = [] if kind == "d" else [rng.choice("aeüz")]
    return "".join(letters)


@pytest.mark.parametrize("threshold", [85, 60, 30])
def test_labels_equal_those_of_all_comparisons(spark, threshold):
    rng = random.Random(threshold)
    texts = [changed(rng, rng.choice(LABELS).lower()) for _ in range(300)] + ["", None, "nothing alike", "a" * 60]
    rows = spark.createDataFrame(list(enumerate(texts + texts[:50])), "id int, text string")
    plain = F.expr(closest_label("text", LABELS, threshold, "none"))
    want = rows.select("id", F.when(F.col("text").isNull(), "none").otherwise(plain).alias("found"))
    found = with_closest_label(rows, "text", LABELS, threshold, "none", "found")
    assert sorted(map(tuple, found.select("id", "found").collect())) == sorted(map(tuple, want.collect()))


def test_only_pairs_within_reach_are_compared(spark):
    texts = spark.range(2000).selectExpr("concat('unlike text number ', id) AS text")
    labels = spark.createDataFrame([(label, label.lower(), k) for k, label in enumerate(LABELS)], "label string, key string, place int")
    assert similar_pairs(texts, labels, 85).count() == 0
