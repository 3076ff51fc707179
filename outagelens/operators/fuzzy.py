"""Fuzzy lookup: the label of a table most similar to a text, worked out once per distinct text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from outagelens.sources.checkpoints import stored

GRAM = 2


def _grams(text: Column) -> Column:
    """The grams of a text, each with how often it came before, so that shared grams are counted with repeats."""
    places = F.sequence(F.lit(1), F.length(text) - (GRAM - 1))
    plain = F.when(F.length(text) >= GRAM, F.transform(places, lambda at: F.substring(text, at, F.lit(GRAM)))).otherwise(
        F.array().cast("array<string>"))
    return F.transform(plain, lambda gram, at: F.struct(
        gram.alias("gram"), F.size(F.filter(F.slice(plain, F.lit(1), at), lambda before: before == gram)).alias("nth")))


def _edits(longest: Column, threshold: float) -> Column:
    """How many edits a similarity of at least the threshold allows."""
    return F.floor(longest * (100.0 - threshold) / 100.0 + 1e-9).cast("int")


def similar_pairs(texts: DataFrame, labels: DataFrame, threshold: float) -> DataFrame:
    """(text, label, place, score) of all pairs of `texts` (text) and `labels` (label, key, place) that reach the threshold, over 0.

    The score is 100 for equal texts and falls with the edit distance over the longer length; labels are compared by
    their `key`. An edit changes at most GRAM grams, so a pair within reach shares so many, and its lengths differ by no
    more than the edits: pairs come from a join on grams, are counted, and only those left are compared. Where texts
    are so short that no shared gram is certain, pairs come from a join on length instead.
    """
    text_side = texts.select("text", F.length("text").alias("n"))
    label_side = labels.select("label", "key", "place", F.length("key").alias("m"))
    longest, shorter = F.greatest("n", "m"), F.least("n", "m")
    needed = longest - (GRAM - 1) - GRAM * _edits(longest, threshold)
    near = longest - shorter <= _edits(longest, threshold)
    by_gram = (
        text_side.select("text", "n", F.explode(_grams(F.col("text"))).alias("gram"))
        .join(label_side.select("label", "key", "place", "m", F.explode(_grams(F.col("key"))).alias("gram")), "gram")
        .where(near & (needed > 0))
        .groupBy("text", "n", "label", "key", "place", "m")
        .agg(F.count("*").alias("shared"))
        .where(F.col("shared") >= needed)
        .drop("shared")
    )
    # The lengths of labels, few numbers, each with the text lengths within reach: at most so many times as long.
    most = F.ceil(F.col("m") * (100.0 / threshold)).cast("int")
    spans = label_side.select("m").distinct().select("m", F.explode(F.sequence(F.lit(0), most)).alias("n")).where(near & (needed <= 0))
    by_length = text_side.join(spans, "n").join(label_side, "m").select("text", "n", "label", "key", "place", "m")
    distance = F.levenshtein("text", "key")
    score = F.when(longest == 0, 100.0).otherwise(100.0 * (1.0 - distance / longest.cast("double")))
    return by_gram.unionByName(by_length).select("text", "label", "place", score.alias("score")).where(F.col("score") >= threshold)


def with_closest_label(df: DataFrame, column: str, labels: list[str] | DataFrame, threshold: float, default: str, into: str) -> DataFrame:
    """df with the most similar label of each text, the first among equals, or the default below the threshold.

    `labels` is a list or a table (label, place); texts are compared with the labels in lower case. Work is done per
    distinct text, counted before the shuffle; a text in very many rows meets its one answer through a plain exchange,
    which Spark splits at run time. A missing text gets the default.
    """
    spark = df.sparkSession
    if isinstance(labels, list):
        labels = spark.createDataFrame([(label, place) for place, label in enumerate(labels)], "label string, place int")
    table = labels.select("label", F.lower("label").alias("key"), "place")
    texts = stored(df.select(F.col(f"`{column}`").alias("text")).where("text IS NOT NULL").distinct(), "texts")
    best = similar_pairs(texts, table, threshold).groupBy("text").agg(
        F.max(F.struct("score", (-F.col("place")).alias("place"), "label")).alias("best"))
    answers = stored(best.select(F.col("text").alias("_text"), F.col("best.label").alias("_label")), "labels")
    joined = df.join(answers, F.col(f"`{column}`") == F.col("_text"), "left")
    return joined.withColumn(into, F.coalesce("_label", F.lit(default))).drop("_text", "_label")
