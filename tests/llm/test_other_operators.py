"""Chat formatting, the three classifiers and the fingerprints, against plain versions and held-out rows."""

import os
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from outagelens.llm import chat, fingerprints, language, quality_grades, toxicity
from outagelens.llm.queries import QUERIES
from outagelens.llm.shared import read_table

from .rows import DOCS, messy, sha

SMALL = "/root/testdata/sf0.001"
TRAIN = "/root/testdata/sf0.01"
TURNS = "conv_id long, turn long, role string, text string"
EVENTS = "conv_id long, message long, seq long, kind string, role string, text string"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(messy(), DOCS)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="module")
def no_labels(spark):
    return spark.createDataFrame([], "doc_id long, quality int, toxic int")


# ---- chat

def test_escapes_are_reversible_and_hide_control_strings():
    rng = random.Random(1)
    parts = [*chat.CONTROL, "\\", "\\\\", "<", "[", "/", "s>", "INST]", "a", " ", "\n", "</", "SYS>>", "é"]
    for _ in range(3000):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(0, 9)))
        hidden = chat.escaped(text)
        assert chat.unescaped(hidden) == text
        assert not any(c in hidden for c in chat.CONTROL)
        assert chat.parsed(chat.rendered("user", text)[0] + chat.rendered(text, "x")[0]) == [("user", text), (text, "x")]


def plain_digest(turns):
    said = "".join(text or "" for _, role, text in turns if role == "assistant")
    return (len(turns), sha("".join(f"{role or ''}\n{text or ''}\n" for _, role, text in turns)), len(said), sha(said))


def test_digests_equal_plain_ones(spark):
    rows = [(1, 1, "assistant", None), (1, 0, "user", "hi"), (1, 2, None, "</s>\\"), (2, 0, "assistant", "x" * 5000 + "é" * 700),
            (None, 0, "user", "no conversation"), (None, 1, "assistant", "[/INST]"), (3, None, "system", "first"), (3, 0, "user", ""),
            (4, 0, "user", "twice"), (4, 0, "user", "twice")]
    rows += [(5, k, "assistant" if k % 2 else "user", f"<<SYS>> {k} " * (k % 7)) for k in range(2500)]
    found = {r.conv_id: tuple(r[1:5]) for r in chat.report(spark.createDataFrame(rows, TURNS)).collect()}
    probe = "</s>[INST] ok [/INST]"
    rows += [(-1, 0, "user", probe), (-1, 1, "assistant", probe)]
    for conv in {r[0] for r in rows}:
        turns = sorted((r[1:] for r in rows if r[0] == conv), key=lambda r: (r[0] is not None, r[0] or 0))
        assert found[conv] == plain_digest(turns)
    assert chat.report(spark.createDataFrame([], TURNS)).count() == 1


def test_edits_and_regenerations_fold(spark):
    log = [
        (1, 0, 0, "open", "user", "hel"), (1, 0, 1, "delta", None, "lo"),
        (1, 1, 2, "open", "assistant", "bad "), (1, 1, 3, "delta", None, "answer"),
        (1, 2, 4, "open", "user", "lost with the answer"),
        (1, 1, 5, "regenerate", None, None), (1, 1, 6, "delta", None, "good"),
        (1, 2, 7, "open", "user", "again"), (1, 0, 8, "edit", None, "hello!"), (1, 3, 9, "mystery", "x", "y"),
        (2, 0, 0, "regenerate", None, None),
    ]
    random.Random(2).shuffle(log)
    found = chat.formatted(spark.createDataFrame(log, EVENTS)).orderBy("conv_id", "place").collect()
    assert [(r.conv_id, r.place, r.role, r.text) for r in found] == [
        (1, 0, "user", "hello!"), (1, 1, "assistant", "good"), (1, 2, "user", "again")]
    for row in found:
        assert row.formatted[row.loss_start:row.loss_start + row.loss_length] == ("good" if row.role == "assistant" else "")


# ---- fingerprints

def test_spans_and_extensions_equal_plain_ones():
    rng = random.Random(3)
    for _ in range(60):
        one = "".join(rng.choice("ab") for _ in range(rng.randint(1, 60)))
        two = "".join(rng.choice("ab\x00") for _ in range(rng.randint(1, 60)))
        a, b = fingerprints.Prefixes(one), fingerprints.Prefixes(two)
        for _ in range(30):
            i, j = rng.randint(0, len(one)), rng.randint(0, len(two))
            n = rng.randint(0, min(len(one) - i, len(two) - j))
            assert (a.span(i, i + n) == b.span(j, j + n)) == (one[i:i + n] == two[j:j + n])
            assert a.common(i, b, j) == len(os.path.commonprefix([one[i:], two[j:]]))
        keep, take = rng.randint(0, len(one)), rng.randint(0, len(two))
        whole = fingerprints.Prefixes(one[:keep] + two[:take])
        for x, y in zip(a.spliced(keep, b, take).arrays, whole.arrays):
            assert (x == y).all()


def test_likeness_estimates_shared_spans():
    rng = random.Random(4)
    text = "".join(rng.choice("abcdefgh ") for _ in range(6000))
    other = "".join(rng.choice("abcdefgh ") for _ in range(6000))
    mark = fingerprints.fingerprint(text)
    assert fingerprints.likeness(mark, mark) == 1
    assert fingerprints.likeness(mark, fingerprints.fingerprint(text[:5400] + other[:600])) > 0.6
    assert fingerprints.likeness(mark, fingerprints.fingerprint(other)) < 0.1
    assert fingerprints.fingerprint(None) == fingerprints.fingerprint("") != fingerprints.fingerprint("\x00")
    assert fingerprints.likeness(fingerprints.fingerprint(""), mark) == 0


@pytest.mark.parametrize("parts", ["1", "8", "40"])
def test_edits_equal_plain_ones(spark, docs, empty, parts):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        found = fingerprints.edits(docs).collect()
        assert fingerprints.edits(empty).count() == 0
        alone = fingerprints.edits(docs.filter("doc_id = 14")).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    # rows of one id follow a hash of their texts, so the plain order is read back from the result where ids repeat
    order = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), F.xxhash64("text").alias("h"),
                        F.col("text").isNull().alias("none")).collect()
    order.sort(key=lambda r: (r.doc_id is None, -(r.doc_id or 0), r.h))
    wanted = []
    for row, following in zip(order, [*order[1:], order[0]]):
        n = len(row.text)
        edited = row.text[:n - n // 3] + following.text[:n // 3]
        one, two, three = map(fingerprints.fingerprint, (row.text, edited, following.text))
        wanted.append((row.doc_id, n, sha(edited), one, two, fingerprints.likeness(one, two), fingerprints.likeness(one, three),
                       len(os.path.commonprefix([row.text, edited]))))
    assert sorted(map(repr, map(tuple, found))) == sorted(map(repr, wanted))
    assert alone[0].near_next == 1 and len(alone) == 1


def test_ids_with_many_rows_span_several_ranges(spark):
    rng = random.Random(8)
    ids = [*range(30), *[None] * 120, *[7] * 60]
    rows = [(k, "".join(rng.choice("abc") for _ in range(rng.randint(20, 60))), "en", "s", 0) for k in ids]
    rows += [(None, "twice and more", "en", "s", 0)] * 5 + [(7, None, "en", "s", 0)]
    docs = spark.createDataFrame(rows, DOCS)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "12")
    try:
        found = fingerprints.edits(docs).withColumn("task", F.spark_partition_id()).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    order = [(r.doc_id, r.text or "", r.h) for r in docs.select("doc_id", "text", F.xxhash64("text").alias("h")).collect()]
    order.sort(key=lambda r: (r[0] is None, -(r[0] or 0), r[2]))
    wanted = [(k, len(text), sha(text[:len(text) - len(text) // 3] + after[:len(text) // 3]))
              for (k, text, _), (_, after, _) in zip(order, [*order[1:], order[0]])]
    assert sorted(map(repr, (tuple(r)[:3] for r in found))) == sorted(map(repr, wanted))
    tasks = [r.task for r in found]
    assert max(map(tasks.count, tasks)) < len(rows) / 4


# ---- language

def test_counts_are_those_of_plain_trigrams():
    buckets, counts = language.gram_counts("Ab  ab--ÉT1é")
    assert counts.sum() == len(" ab ab ét é ") - 2
    again, more = language.gram_counts("ab ab ét é")
    assert (buckets == again).all() and (counts == more).all()
    assert all(len(x) == 0 for text in (None, "", "12 !", " ") for x in [language.gram_counts(text)[0]])


def test_mixture_equals_plain_maximisation():
    rng = np.random.default_rng(1)
    likelihood = rng.random((language.BUCKETS, 3))
    model = language.Model(["a", "b", "c"], likelihood / likelihood.sum(axis=0))
    seen, counts = model.likelihood[:200][:, :2], rng.integers(1, 9, 200)
    shares = model._fit(seen, counts, counts.sum())
    grid = np.linspace(0.001, 0.999, 999)
    best = grid[np.argmax([counts @ np.log(seen @ [s, 1 - s]) for s in grid])]
    assert shares.sum() == pytest.approx(1) and abs(shares[0] - best) < 0.02


def test_language_of_held_out_rows(spark, docs, empty):
    table = read_table(spark, TRAIN, "documents")
    found = language.report(table).join(table.select("doc_id", "lang"), "doc_id").filter("held_out").collect()
    assert sum(r.lang == r.lang_pred for r in found) >= 0.97 * len(found) > 200
    model = language.learned(table)
    mixed = {name: " ".join(r.text for r in table.filter(F.col("lang") == name).orderBy("doc_id").limit(5).collect()) for name in ("en", "fr")}
    shares = model.mixture(mixed["en"][:4000] + "\n" + mixed["fr"][:4000])
    assert set(shares) == {"en", "fr"} and 0.3 < shares["en"] < 0.7
    assert sum(model.mixture(mixed["fr"]).values()) == pytest.approx(1)
    odd = {r.doc_id: r for r in language.report(docs).collect()}
    assert all(odd[k].lang_pred == "und" and odd[k].score == 0 for k in (2, 3, 4))
    assert len(odd) and language.report(docs).count() == docs.count() and language.report(empty).count() == 0


# ---- classifiers

def test_toxicity_finds_marked_words(spark, docs, empty, no_labels):
    rng = random.Random(6)
    plain = [f"{a}{b}{c}" for a in "bdfgkl" for b in "aeiou" for c in "mnprst"]
    bad = ["vile", "scorn"]
    rows, labels = [], []
    for i in range(1500):
        text = [rng.choice(plain) for _ in range(rng.randint(1, 80))]
        toxic = i % 5 == 0
        if toxic:
            text.insert(rng.randint(0, len(text)), rng.choice(bad))
        rows.append((i, " ".join(text), rng.choice(["x", "y", None]), "s", 0))
        labels.append((i, 1, int(toxic)))
    table = spark.createDataFrame(rows, DOCS)
    found = toxicity.report(table, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).filter("held_out").collect()
    wrong = sum((r.doc_id % 5 == 0) != r.predicted for r in found)
    assert len(found) > 400 and wrong <= 0.02 * len(found)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= toxicity.CUT) for r in found)
    plainly = toxicity.report(docs, no_labels).collect()
    assert len(plainly) == docs.count() and all(0 <= r.score <= 1 for r in plainly)
    assert toxicity.report(empty, no_labels).count() == 0


def test_gradients_equal_differences():
    net = toxicity.trained([np.arange(5, dtype=np.int32), np.arange(3, 9, dtype=np.int32)] * 4, np.array([0, 1] * 4))
    net.embedding = net.embedding.astype(np.float64)
    ids, label = np.arange(2, 8, dtype=np.int32), 1
    held = {"weights": net.weights, "bias": net.bias, "offsets": net.offsets} | {f"kernel{k}": v for k, v in enumerate(net.kernels)}
    sums = {k: np.zeros(v.shape) for k, v in held.items()} | {"spans": [], "moves": []}
    net.kernels = [k.astype(np.float64) for k in net.kernels]
    net.gradients(ids, label, sums)
    loss = lambda: -np.log(1 / (1 + np.exp(-net.logit(ids))))
    before = loss()
    for number, kernel in enumerate(net.kernels):
        kernel[1, 2] += 1e-5
        assert (loss() - before) / 1e-5 == pytest.approx(sums[f"kernel{number}"][1, 2], abs=1e-3)
        kernel[1, 2] -= 1e-5


def test_threshold_has_the_best_f1():
    rng = np.random.default_rng(3)
    for _ in range(50):
        logits, labels = rng.integers(0, 6, 30).astype(float), rng.integers(0, 2, 30)
        if not labels.sum():
            continue
        f1 = lambda cut: 2 * labels[logits >= cut].sum() / ((logits >= cut).sum() + labels.sum())
        assert f1(toxicity.best_threshold(logits, labels)) == pytest.approx(max(f1(c) for c in set(logits)))


def test_grades_follow_their_features(spark, docs, empty, no_labels):
    table = read_table(spark, TRAIN, "documents")
    labels = read_table(spark, TRAIN, "labels").filter("quality is not null")
    learning, asked = labels.filter("doc_id % 3 != 0"), labels.filter("doc_id % 3 = 0")
    found = quality_grades.report(table, learning).join(asked, "doc_id").collect()
    good, poor = [r for r in found if r.quality == 1], [r for r in found if r.quality == 0]
    assert sum(r.kept for r in good) >= 0.98 * len(good) and sum(not r.kept for r in poor) >= 0.6 * len(poor)
    assert all(0 <= r.tail_probability <= 1 and 0 <= r.expected_grade <= 2 for r in found)
    even = quality_grades.report(docs, no_labels).collect()
    assert len(even) == docs.count() and {round(r.expected_grade, 6) for r in even} == {1.0}
    assert quality_grades.report(empty, no_labels).count() == 0


def test_ordinal_slopes_equal_differences():
    score, grades, cuts = np.array([0.3, -1.0, 2.0]), np.array([0, 1, 2]), np.array([-0.4, 0.9])

    def loss(s, c):
        tails = np.column_stack((np.ones(3), 1 / (1 + np.exp(c - s[:, None])), np.zeros(3)))
        return -np.log(tails[np.arange(3), grades] - tails[np.arange(3), grades + 1])

    by_score, by_cut = quality_grades._slopes(score, grades, cuts)
    assert by_score == pytest.approx((loss(score + 1e-6, cuts) - loss(score, cuts)) / 1e-6, abs=1e-4)
    for k in range(2):
        moved = cuts + 1e-6 * (np.arange(2) == k)
        assert by_cut[:, k] == pytest.approx((loss(score, moved) - loss(score, cuts)) / 1e-6, abs=1e-4)


def test_every_query_runs_over_its_whole_table(spark):
    documents, talks = read_table(spark, SMALL, "documents").count(), read_table(spark, SMALL, "conversations")
    assert sorted(QUERIES, key=lambda n: int(n[2:].split("_")[0]))[0] == "op1_chat" and len(QUERIES) == 10
    for name, query in QUERIES.items():
        wanted = talks.select("conv_id").distinct().count() + 1 if name == "op1_chat" else documents
        assert query(spark, SMALL).count() == wanted, name
