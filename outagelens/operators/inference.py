"""Fill a missing category from free text: TF-IDF weights and cosine similarity.

All rows of one known category form one document; every row with a missing
category is a document of its own.  Weights use idf = ln((1 + n) / (1 + df)) + 1
over all documents, and length-normalised vectors.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from outagelens.functions.rules import is_any
from outagelens.functions.service import confidence_tier
from outagelens.functions.text import MIN_WORD, words_of

SCORE_DECIMALS = 9
Keep = Callable[[DataFrame], DataFrame]


def as_is(df: DataFrame) -> DataFrame:
    return df


def default_stop_words() -> list[str]:
    """Spark's own English list; needs an active session."""
    from pyspark.ml.feature import StopWordsRemover

    return StopWordsRemover.loadDefaultStopWords("english")


def term_counts(df: DataFrame, id_col: str, target: str, text: str, stop_words: Iterable[str]) -> DataFrame:
    """Occurrences per (known, entity, term); counts are combined before the shuffle."""
    words = df.select(
        F.col(target).isNotNull().alias("known"),
        F.coalesce(F.col(target).cast("string"), F.col(id_col).cast("string")).alias("entity"),
        F.explode(words_of(F.col(text))).alias("term"),
    )
    kept = words.where(F.length("term") >= MIN_WORD)
    stop = [word for word in stop_words if len(word) >= MIN_WORD]
    if stop:
        kept = kept.where(f"NOT {is_any('term', stop)}")
    return kept.groupBy("known", "entity", "term").agg(F.count("*").alias("tf"))


#: Categories whose products with a row are summed side by side.
BLOCK = 64


def category_table(counts: DataFrame, documents: Column, keep: Keep = as_is) -> DataFrame:
    """One row per known category, in sort order: its block and place there, and its norm."""
    df = counts.groupBy("term").agg(F.count("*").alias("df"), F.max("known").alias("shared")).where("shared")
    weighted = counts.where("known").join(df.select("term", _idf(documents).alias("idf")), "term")
    norms = weighted.groupBy(F.col("entity").alias("category")).agg(
        F.sqrt(F.sum(F.pow(F.col("tf") * F.col("idf"), 2))).alias("category_norm"))
    at = F.row_number().over(Window.orderBy("category")) - 1  # over one row per category
    return keep(norms.withColumn("block", F.floor(at / BLOCK).cast("int")).withColumn("at", (at % BLOCK).cast("int")))


def _idf(documents: Column) -> Column:
    return F.log((1 + documents) / (1 + F.col("df"))) + 1


def term_table(counts: DataFrame, categories: DataFrame, width: int) -> DataFrame:
    """One row per term: in how many documents it is (df), and its counts in the categories, an array for each block
    of them in which it occurs.  Counts are combined before the shuffle."""
    # Lists are gathered from the categories' counts only: gathering sorts its rows, counting does not.
    placed = counts.where("known").join(categories.select(F.col("category").alias("entity"), "block", "at"), "entity")
    lists = placed.groupBy("term").agg(F.collect_list(F.struct("block", "at", "tf")).alias("_used"))
    terms = counts.groupBy("term").agg(F.count("*").alias("df")).join(lists, "term", "left").withColumn(
        "used", F.coalesce("_used", F.array().cast(lists.schema["_used"].dataType)))
    numbers = F.array_sort(F.array_distinct(F.transform("used", lambda one: one["block"])))

    def dense(block: Column) -> Column:
        own = F.map_from_entries(F.transform(
            F.filter("used", lambda one: one["block"] == block), lambda one: F.struct(one["at"], one["tf"])))
        return F.transform(F.sequence(F.lit(0), F.lit(width - 1)), lambda at: F.coalesce(F.try_element_at(own, at), F.lit(0).cast("long")))

    return terms.select("term", "df", F.transform(numbers, lambda block: F.struct(block.alias("block"), dense(block).alias("counts"))).alias("blocks"))


def products(counts: DataFrame, terms: DataFrame, documents: Column, width: int) -> DataFrame:
    """(row, block, squares, sums): for each row with a missing target the products of its weights with a block of categories.

    A row's term meets a block's counts as one array, so a row has as many product rows as terms and blocks, not as
    terms and categories; the sums are combined before the shuffle.
    """
    rows = counts.where(~F.col("known")).select(F.col("entity").alias("row"), "term", F.col("tf").alias("row_tf"))
    met = rows.join(terms, "term").select("row", "row_tf", _idf(documents).alias("idf"), F.posexplode_outer("blocks").alias("nth", "met"))
    weight = F.col("row_tf") * F.col("idf")
    sums = [F.sum(weight * F.col("idf") * F.get("met.counts", F.lit(at))).alias(f"sum_{at}") for at in range(width)]
    summed = met.groupBy("row", F.col("met.block").alias("block")).agg(
        # A term counts once for the norm, in the first of its blocks.
        F.sum(F.when(F.coalesce("nth", F.lit(0)) == 0, weight * weight)).alias("squares"), *sums)
    return summed.select("row", "block", "squares", F.array(*[f"sum_{at}" for at in range(width)]).alias("sums"))


def similar_categories(counts: DataFrame, id_col: str, keep: Keep = as_is) -> DataFrame:
    """Best category and score for every row of the counts with a missing target.

    Ties, and rows that share no term with any category, go to the first category
    in sort order.  The counts meet the term table in one join on the term, which
    yields a row's products with all categories and its norm together, by blocks
    of categories.  When `keep` stores both sides, both reach the join through a
    plain exchange, and Spark splits a word that is in very many documents over
    several tasks.
    """
    documents = counts.select("known", "entity").distinct().agg(F.count("*")).scalar()
    categories = category_table(counts, documents, keep)
    width = max(1, min(BLOCK, categories.count()))
    terms = keep(term_table(counts, categories, width))
    blocks = categories.groupBy("block").agg(F.sort_array(F.collect_list(F.struct("at", "category", "category_norm"))).alias("own"))
    found = products(counts, terms, documents, width).join(blocks, "block", "left")
    norms = found.groupBy("row").agg(F.sqrt(F.sum("squares")).alias("row_norm"), F.collect_list(
        F.when(F.col("own").isNotNull(), F.transform("own", lambda one: F.struct(
            (F.get("sums", one["at"]) / one["category_norm"]).alias("part"), one["category"].alias("category"))))).alias("parts"))
    scored = F.transform(F.flatten("parts"), lambda part: F.struct(
        (-F.round(part["part"] / F.col("row_norm"), SCORE_DECIMALS)).alias("below"), part["category"].alias("category")
    ))
    first = counts.where("known").agg(F.min("entity")).scalar()
    return (
        norms.select(F.col("row").alias(id_col), F.array_min(scored).alias("best"))
        .select(
            id_col,
            # A block that a row shares no term with has scores of zero: the first category of all is among equals.
            F.when(F.col("best.below") < 0, F.col("best.category")).otherwise(first).alias("assigned"),
            F.coalesce(-F.col("best.below"), F.lit(0.0)).alias("score"),
        )
        .where(F.col("assigned").isNotNull())
    )


Compared = tuple[DataFrame, DataFrame]


def compare(
    df: DataFrame, id_col: str, target: str, text: str, stop_words: Iterable[str], keep: Keep = as_is
) -> Compared:
    """The term counts of a table, and the best category of every row with a missing target; both kept."""
    counts = keep(term_counts(df, id_col, target, text, stop_words))
    return counts, keep(similar_categories(counts, id_col, keep))


def fill_from_text(
    df: DataFrame, id_col: str, target: str, text: str, constant: str, stop_words: Iterable[str], keep: Keep = as_is,
    compared: Compared | None = None,
) -> DataFrame:
    """The table with missing targets filled.

    Without any known category, or when no row with a missing target has usable
    text, the constant is filled in.  Otherwise a row without usable text stays
    missing.  `keep` may store what several branches read; `compared` brings it along.

    Only rows with a missing target meet the comparisons, so only they are shuffled for it; the table is read for either kind.
    """
    for column in (text, target):
        if column not in df.columns:
            raise ValueError(f"Missing required column: '{column}'")
    counts, best = compared or compare(df, id_col, target, text, stop_words, keep)
    sides = counts.agg(F.count_if("known").alias("known"), F.count_if(~F.col("known")).alias("unknown"))
    nothing_to_compare = sides.select((F.col("known") == 0) | (F.col("unknown") == 0)).scalar()
    found = best.select(
        F.col(id_col).alias("_row"), F.col("assigned").alias("_assigned")
    )
    filled = F.coalesce(F.col(target), F.col("_assigned"), F.when(nothing_to_compare, F.lit(constant)))
    matches = F.col(id_col).cast("string") == F.col("_row")
    missing = F.col(target).isNull()
    joined = df.where(missing).join(found, matches, "left").withColumn(target, filled).drop("_row", "_assigned")
    given = df.where(~missing).withColumn("_assigned", F.lit(None).cast("string")).withColumn(target, filled).drop("_assigned")
    return given.unionByName(joined)


def inference_log(
    df: DataFrame, id_col: str, target: str, text: str, stop_words: Iterable[str], keep: Keep = as_is,
    context: Iterable[str] = (), compared: Compared | None = None,
) -> DataFrame:
    """Assigned value, score and confidence tier of every inferred row, behind its own `context` columns.

    The target, when it is among them, shows the assigned value.
    """
    _, best = compared or compare(df, id_col, target, text, stop_words, keep)
    found = best.select(
        F.col(id_col).alias("_row"),
        F.col("assigned").alias("Raw Inferred Value"),
        F.col("score").alias("Similarity_Score"),
        confidence_tier("score").alias("Confidence"),
    )
    shown = [name for name in context if name in df.columns and name != id_col]
    if not shown:
        return found.withColumnRenamed("_row", id_col)
    rows = df.where(F.col(target).isNull()).select(id_col, *shown)
    joined = rows.join(found, F.col(id_col).cast("string") == F.col("_row")).drop("_row")
    return joined.withColumn(target, F.col("Raw Inferred Value")) if target in shown else joined


def low_confidence(log: DataFrame) -> DataFrame:
    return log.where(F.col("Confidence").isin("low", "very_low"))


def tier_distribution(log: DataFrame) -> DataFrame:
    return log.groupBy("Confidence").agg(F.count("*").alias("Count"))
