import math
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from outagelens.operators.inference import (
    category_table, fill_from_text, inference_log, low_confidence, similar_categories, term_counts, term_table, tier_distribution,
)
from outagelens.sources.checkpoints import stored

STOP = ["the", "and"]
ROWS = [
    ("1", "power", "battery rectifier failure the battery"),
    ("2", "power", "generator rectifier alarm"),
    ("3", "fiber", "cable cut and splice"),
    ("4", "fiber", "fiber cable attenuation alarm"),
    ("5", None, "rectifier alarm at the site"),
    ("6", None, "splice of cable"),
    ("7", None, "unrelated words only"),
    ("8", None, "at a of"),
    ("9", None, None),
]
SCHEMA = "id string, kind string, text string"


def words(text):
    return [w for w in re.sub(r"[^a-z0-9]+", " ", (text or "").lower()).split() if len(w) > 2 and w not in STOP]


def brute_force(rows):
    known, unknown = {}, {}
    for key, kind, text in rows:
        tokens = words(text)
        if tokens:
            (known.setdefault(kind, Counter()) if kind else unknown.setdefault(key, Counter())).update(tokens)
    documents = list(known.values()) + list(unknown.values())
    spread = Counter(t for d in documents for t in d)

    def vector(document):
        raw = {t: n * (math.log((1 + len(documents)) / (1 + spread[t])) + 1) for t, n in document.items()}
        norm = math.sqrt(sum(w * w for w in raw.values()))
        return {t: w / norm for t, w in raw.items()}

    groups = {kind: vector(d) for kind, d in sorted(known.items())}
    found = {}
    for key, document in unknown.items():
        mine = vector(document)
        scores = {kind: sum(mine.get(t, 0) * w for t, w in group.items()) for kind, group in groups.items()}
        best = max(scores, key=lambda kind: scores[kind])
        found[key] = (best, scores[best])
    return found


def test_scores_match_brute_force(spark):
    log = inference_log(spark.createDataFrame(ROWS, SCHEMA), "id", "kind", "text", STOP).collect()
    want = brute_force(ROWS)
    assert {r["id"] for r in log} == set(want) == {"5", "6", "7"}
    for row in log:
        kind, score = want[row["id"]]
        assert row["Raw Inferred Value"] == kind
        assert row["Similarity_Score"] == pytest.approx(score, abs=1e-8)


def test_no_shared_word_takes_the_first_category(spark):
    filled = fill_from_text(spark.createDataFrame(ROWS, SCHEMA), "id", "kind", "text", "NONE", STOP)
    kinds = {r["id"]: r["kind"] for r in filled.collect()}
    assert kinds["5"] == "power" and kinds["6"] == "fiber" and kinds["7"] == "fiber"
    assert kinds["8"] is None and kinds["9"] is None
    assert kinds["1"] == "power"


def test_constant_only_without_any_comparison(spark):
    nothing_known = [(k, None, t) for k, _, t in ROWS]
    filled = fill_from_text(spark.createDataFrame(nothing_known, SCHEMA), "id", "kind", "text", "NONE", STOP)
    assert {r["kind"] for r in filled.collect()} == {"NONE"}
    blank = [r for r in ROWS if r[1]] + [("8", None, "at a"), ("9", None, None)]
    filled = fill_from_text(spark.createDataFrame(blank, SCHEMA), "id", "kind", "text", "NONE", STOP)
    assert {r["id"]: r["kind"] for r in filled.collect()}["8"] == "NONE"
    no_words = [("1", "power", "a"), ("2", None, "rectifier alarm")]
    filled = fill_from_text(spark.createDataFrame(no_words, SCHEMA), "id", "kind", "text", "NONE", STOP)
    assert {r["id"]: r["kind"] for r in filled.collect()} == {"1": "power", "2": "NONE"}


def test_nothing_missing_stays_as_it_is(spark):
    rows = [r for r in ROWS if r[1]]
    filled = fill_from_text(spark.createDataFrame(rows, SCHEMA), "id", "kind", "text", "NONE", STOP)
    assert sorted((r["id"], r["kind"]) for r in filled.collect()) == sorted((r[0], r[1]) for r in rows)


def test_tiers_of_the_log(spark):
    log = inference_log(spark.createDataFrame(ROWS, SCHEMA), "id", "kind", "text", STOP)
    assert sum(r["Count"] for r in tier_distribution(log).collect()) == 3
    assert {r["Confidence"] for r in low_confidence(log).collect()} <= {"low", "very_low"}


def test_missing_column_is_an_error(spark):
    with pytest.raises(ValueError, match="Missing required column"):
        fill_from_text(spark.createDataFrame(ROWS, SCHEMA).drop("text"), "id", "kind", "text", "x", STOP)


def test_a_word_in_every_document_is_split(spark):
    """With both sides stored, Spark deals the rows of one frequent word over several tasks at run time."""
    limits = {
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "32k", "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "32k",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5",
        "spark.sql.adaptive.coalescePartitions.enabled": "false",  # eight files, so eight tasks send rows
    }
    documents = spark.range(60_000).selectExpr(
        "cast(id AS string) AS id", "if(id < 20, concat('kind ', id % 4), NULL) AS kind",
        "concat('alarm rare', id % 5000) AS text")
    before = {name: spark.conf.get(name, None) for name in limits}
    for name, value in limits.items():
        spark.conf.set(name, value)
    try:
        counts = stored(term_counts(documents, "id", "kind", "text", STOP), "counts")
        found = similar_categories(counts, "id", lambda df: stored(df, "terms"))
        assert len(found.collect()) == 59_980
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert "skew=true" in plan
    finally:
        for name, value in before.items():
            spark.conf.unset(name) if value is None else spark.conf.set(name, value)


def test_more_categories_than_a_block_holds(spark):
    """150 categories in three blocks against plain TF-IDF; a row meets each block of a term once, not each category."""
    rng = random.Random(11)
    words = [f"word{k}" for k in range(60)]
    known = [(f"k{c}", f"kind {c:03d}", " ".join(rng.choices(words, k=6))) for c in range(150) for _ in range(2)]
    open_ = [(f"u{k}", None, " ".join(rng.choices([*words, "unseen", "elsewhere"], k=4))) for k in range(80)] + [("u98", None, "unseen only"), ("u99", None, None)]
    counts = stored(term_counts(spark.createDataFrame([*known, *open_], "id string, kind string, text string"), "id", "kind", "text", []), "counts")
    documents, tf = {}, Counter()
    for name, kind, text in [*known, *open_]:
        documents.setdefault(kind or name, Counter()).update((text or "").split())
    documents = {d: t for d, t in documents.items() if t}
    df = Counter(w for t in documents.values() for w in t)
    idf = {w: math.log((1 + len(documents)) / (1 + n)) + 1 for w, n in df.items()}

    def cosine(a, b):
        norm = [math.sqrt(sum((n * idf[w]) ** 2 for w, n in x.items())) for x in (a, b)]
        return sum(n * b[w] * idf[w] ** 2 for w, n in a.items()) / (norm[0] * norm[1])

    kinds = sorted({kind for _, kind, _ in known})
    want = {}
    for name, _, text in open_:
        if text:
            scores = [(-round(cosine(documents[name], documents[kind]), 9), kind) for kind in kinds]
            want[name] = (min(scores)[1], pytest.approx(-min(scores)[0], abs=1e-8))
    found = {r["id"]: (r["assigned"], r["score"]) for r in similar_categories(counts, "id", lambda t: stored(t, "terms")).collect()}
    assert found == want and found["u98"][0] == "kind 000"
    categories = category_table(counts, F.lit(len(documents)))
    assert [r["n"] for r in categories.groupBy("block").agg(F.count("*").alias("n")).orderBy("block").collect()] == [64, 64, 22]
    terms = term_table(counts, categories, 64)
    unknown = counts.where("NOT known")
    by_block = unknown.join(terms, "term").agg(F.sum(F.greatest(F.size("blocks"), F.lit(1)))).first()[0]
    by_category = unknown.join(counts.where("known").groupBy("term").agg(F.count("*").alias("n")), "term").agg(F.sum("n")).first()[0]
    assert by_block <= 3 * unknown.count() < by_category / 2


def test_only_category_counts_are_gathered_in_lists(spark):
    """The counts of rows, by far the most, are counted by term, never sorted to be gathered."""
    counts = stored(spark.createDataFrame(
        [(True, "a", "x", 2), (True, "b", "x", 1), (True, "b", "y", 3), (False, "r1", "x", 1), (False, "r2", "z", 1)],
        "known boolean, entity string, term string, tf long"), "counts")
    categories = category_table(counts, F.lit(4)).cache()
    terms = term_table(counts, categories, 2)
    plan = terms._jdf.queryExecution().optimizedPlan().toString()
    gathered = [line for line in plan.splitlines() if "collect_list" in line]
    at = plan.index(gathered[0])
    assert len(gathered) == 1 and "Filter" in plan[at:] and "known" in plan[at:].split("Filter", 1)[1].splitlines()[0]
    assert {(r.term, r.df, tuple(tuple(b.counts) for b in r.blocks)) for r in terms.collect()} == {
        ("x", 3, ((2, 1),)), ("y", 1, ((0, 3),)), ("z", 1, ())}


def test_rows_with_a_target_are_not_shuffled_to_be_filled(spark):
    rows = stored(spark.createDataFrame(ROWS + [("5", "fiber", "an id that is filled elsewhere")], "id string, kind string, text string"), "rows")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        filled = fill_from_text(rows, "id", "kind", "text", "none", STOP, lambda df: stored(df, "kept"))
        plan = filled._jdf.queryExecution().optimizedPlan().toString()
        given, met = plan[plan.index("Union"):].split("Join", 1)
        assert "isnotnull(kind" in given and "isnull(kind" in met
        found = sorted(filled.collect())
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert len(found) == len(ROWS) + 1 and filled.columns == rows.columns
    assert [r.kind for r in found if r.id == "5"] == ["fiber", "power"]
    assert [r.kind for r in found if r.id in ("1", "4")] == ["power", "fiber"]
