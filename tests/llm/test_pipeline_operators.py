"""The five operators of the pipeline, and the pipeline, against plain versions."""

import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from outagelens.llm import bpe, line_spread, mixing, quality_rules, simhash
from outagelens.llm.shared import read_table, tokenizer_path

from .rows import DOCS, classes, messy, sha, simhash as plain_simhash, statistics, without_shared_lines, words

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(messy(), DOCS)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="module")
def clashing(docs):
    """Extra columns with names that operators use inside."""
    names = ("row", "size", "target", "copies", "rank", "block", "offset", "stats", "kept", "rule", "key", "at", "id", "gone", "stay",
             "line", "node", "root", "fingerprint", "salt", "number", "first", "found")
    return docs.withColumns({name: F.lit(f"own {name}") for name in names})


def multiset(rows):
    return sorted(map(repr, map(tuple, rows)))


def test_statistics_equal_a_plain_count(docs):
    found = docs.select("text", quality_rules.statistics(F.col("text")).alias("s")).select(
        "text", *[F.col("s")[c] for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")]).collect()
    for row in found:
        assert tuple(row[1:]) == statistics(row[0]), row[0] and row[0][:60]


def test_repeated_windows_of_random_words(spark):
    rng = random.Random(3)
    texts = [(" ".join(rng.choice("ab") for _ in range(rng.randint(0, 40))),) for _ in range(300)]
    found = spark.createDataFrame(texts, "text string").select(
        "text", quality_rules.statistics(F.col("text"))["n_repeat_words"].alias("n")).collect()
    assert all(row.n == statistics(row.text)[4] for row in found)


def test_rules_learn_a_conjunction_and_keep_good_documents(spark):
    rng = random.Random(5)
    rows = [(i, " ".join(rng.choice(["alpha", "beta", "gamma"]) + ("$$$" if i % 4 == 0 else "") + str(rng.randint(0, 9999))
                         for _ in range(40)), "en", "s", 0) for i in range(400)]
    table = spark.createDataFrame(rows, DOCS)
    labels = spark.createDataFrame([(i, int(i % 4 != 0), 0) for i in range(400)], "doc_id long, quality int, toxic int")
    rules = quality_rules.learn(quality_rules.learning_rows(table, labels))
    assert rules and all(len(rule) <= quality_rules.MOST_LITERALS for rule in rules)
    judged = quality_rules.judged(table, rules).select("row.doc_id", "kept", "rule").collect()
    assert all(row.kept == (row.doc_id % 4 != 0) and (row.rule > 0) != row.kept for row in judged)


def test_rules_without_labels_leave_the_base_rules(spark, docs, empty):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    found = quality_rules.report(docs, labels).collect()
    assert len(found) == docs.count()
    for row in found:
        assert row.kept is not row.base_failed
        assert row.base_failed == (row.n_words < 10 or 100 * row.n_repeat_words > 20 * row.n_words)
    assert quality_rules.report(empty, labels).count() == 0


def test_rules_learn_from_labels_of_documents_that_are_there(spark):
    docs = spark.createDataFrame([(k, f"text {k}", "en", "s", 6) for k in range(40)], DOCS)
    labels = spark.createDataFrame([(k, k % 2, 0) for k in range(2000)], "doc_id long, quality int, toxic int")
    assert quality_rules.learning_rows(docs, labels, rows=40).count() == 40
    assert quality_rules.learning_rows(docs, labels, rows=25).count() == 25


def test_rules_of_a_verdict_apply_in_order(spark):
    one = (quality_rules.Literal("n_words", True, 5.0),)
    two = (quality_rules.Literal("n_words", True, 2.0),)
    table = spark.createDataFrame([(1, "a b c d e f g"), (2, "a b c"), (3, "a")], "doc_id long, text string")
    found = quality_rules.judged(table, [one, two]).select("row.doc_id", "rule").collect()
    assert sorted(map(tuple, found)) == [(1, 1), (2, 2), (3, 0)]


@pytest.mark.parametrize("sites", [2, 5, 10, 11])
def test_line_dedup_equals_a_plain_count(docs, sites):
    rows = messy()
    found = line_spread.without_boilerplate(docs, sites).select("row.doc_id", "text").collect()
    assert multiset(found) == multiset((r[0], t) for r, t in zip(rows, without_shared_lines(rows, sites)))


def test_line_dedup_counts_exactly_near_the_threshold(spark):
    rows = [(1000 * n + k, f"line of {n} sites", None, f"s{k}", 0) for n in range(30, 71) for k in range(n)]
    found = line_spread.boilerplate(line_spread.lines(spark.createDataFrame(rows, DOCS)), 50).collect()
    assert {r.first_doc // 1000 for r in found} == set(range(50, 71))


def test_line_dedup_gathers_the_lines_of_one_text_only(spark, monkeypatch):
    rows = [(k if k < 20 else None if k < 60 else 99, f"menu {k % 20}\nown {k}\nmenu {(k + 1) % 20}", "en", f"s{k % 9}", 0) for k in range(90)]
    kept = {}
    keep = line_spread.stored
    monkeypatch.setattr(line_spread, "stored", lambda table, label: kept.setdefault(label, keep(table, label)))
    found = line_spread.without_boilerplate(spark.createDataFrame(rows, DOCS), 2).select("row.doc_id", "text").collect()
    wanted = zip([row[0] for row in rows], without_shared_lines(rows, 2))
    assert multiset(found) == multiset(wanted)
    assert kept["hits"].agg(F.max(F.size("gone"))).first()[0] == 2


def test_line_dedup_keeps_columns_and_takes_empty_tables(clashing, empty):
    done = line_spread.deduplicated(clashing, 5)
    assert done.columns == clashing.columns and done.filter("gone != 'own gone'").count() == 0
    assert done.filter(F.length("text") != F.col("n_chars")).count() == 0
    assert line_spread.report(empty).count() == 0


def test_simhash_equals_all_pairs(docs):
    rows = messy()
    prints = [plain_simhash(r[1]) for r in rows]
    roots = classes(prints)
    least = defaultdict(list)
    for root, row in zip(roots, rows):
        if row[0] is not None:
            least[root].append(row[0])
    wanted = [(r[0], f"{p:016x}", min(least[root], default=None)) for r, p, root in zip(rows, prints, roots)]
    assert multiset(simhash.report(docs).collect()) == multiset(wanted)


@pytest.mark.parametrize("radius", [1, 2, 3])
def test_components_equal_all_pairs(spark, radius):
    rng = random.Random(radius)
    prints = {rng.getrandbits(64) for _ in range(60)}
    for _ in range(400):  # chains and balls around what is there
        flipped = rng.choice(sorted(prints))
        for _ in range(rng.randint(1, 4)):
            flipped ^= 1 << rng.randrange(64)
        prints.add(flipped)
    ordered = sorted(p - (1 << 64) if p >> 63 else p for p in prints)
    roots = classes([p % (1 << 64) for p in ordered], radius)
    found = simhash.classes(spark.createDataFrame([(p,) for p in ordered], "fingerprint long"), radius).collect()
    assert dict(map(tuple, found)) == {p: ordered[r] for p, r in zip(ordered, roots)}


def test_one_of_each_group_stays(docs, clashing, empty):
    kept = simhash.kept(docs).collect()
    rows = messy()
    roots = classes([plain_simhash(r[1]) for r in rows])
    assert len(kept) == len(set(roots))
    ids = {min((r[0] for r, k in zip(rows, roots) if k == root and r[0] is not None), default=None) for root in set(roots)}
    assert {r.doc_id for r in kept} == ids
    assert simhash.kept(clashing).columns == clashing.columns
    assert simhash.kept(empty).count() == 0 and simhash.report(empty).count() == 0


def plain_targets(sizes, weights=(5, 2, 1), most=3):
    """Reshares the excess until no source is above its limit."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[k % len(weights)] for k, s in enumerate(names)}
    left, open_, target = sum(sizes.values()), set(names), {}
    while open_:
        share = left / sum(weight[s] for s in open_)
        over = {s for s in open_ if share * weight[s] > most * sizes[s]}
        if not over:
            return target | {s: share * weight[s] for s in open_}
        target |= {s: float(most * sizes[s]) for s in over}
        left -= sum(most * sizes[s] for s in over)
        open_ -= over
    return target


def test_targets_equal_plain_resharing(spark):
    rng = random.Random(2)
    for _ in range(6):
        sizes = {name: rng.choice([0, 1, 5, 100, 10_000]) for name in [None, *"abcdefgh"]}
        table = spark.createDataFrame(list(sizes.items()), "source string, source_size long")
        found = {r.source: r.target for r in mixing.source_targets(table).collect()}
        assert found == pytest.approx(plain_targets(sizes))


def test_mix_comes_near_its_targets(spark, docs):
    rng = random.Random(8)
    rows = [(k, " ".join(["w"] * rng.choice([3, 30, 31, 400])), "en", rng.choice("aaaab"), 0) for k in range(2000)]
    for table, near in ((spark.createDataFrame(rows, DOCS), 0.01), (docs, None)):
        found = mixing.report(table).collect()
        assert len(found) == table.count() and multiset(found) == multiset(mixing.report(table.repartition(3)).collect())
        assert all(r.taken <= 3 * r.size and r.taken % max(1, r.size) == 0 for r in found)
        for target in {r.target for r in found} if near else ():
            assert sum(r.taken for r in found if r.target == target) == pytest.approx(target, rel=near)


def test_mix_repeats_rows_whole(docs, clashing, empty):
    taken = {}
    for row in mixing.with_copies(docs).select("row.*", "copies").collect():
        taken[tuple(row[:-1])] = taken.get(tuple(row[:-1]), 0) + row.copies
    found = defaultdict(int)
    for row in mixing.mixed(docs).collect():
        found[tuple(row)] += 1
    assert found == {k: n for k, n in taken.items() if n}
    assert mixing.mixed(clashing).columns == clashing.columns
    assert mixing.mixed(empty).count() == 0 and mixing.report(empty).count() == 0


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    found = Tokenizer.from_file(tokenizer_path())
    found.no_truncation()
    found.no_padding()
    return found


def test_bpe_equals_the_library(docs, empty, tokenizer):
    found = bpe.report(docs, tokenizer_path()).collect()
    wanted = []
    for doc_id, text, *_ in messy():
        ids = tokenizer.encode(text or "", add_special_tokens=False).ids
        wanted.append((doc_id, len(ids), sha(" ".join(map(str, ids))), sha(tokenizer.decode(ids, skip_special_tokens=False))))
    assert multiset(found) == multiset(wanted)
    assert bpe.report(empty, tokenizer_path()).count() == 0 and bpe.encoded(empty, tokenizer_path()).count() == 0


def test_bpe_columns_encode_and_decode(spark, docs, tokenizer):
    table = bpe.encoded(docs, tokenizer_path())
    again = table.select("text", "ids", bpe.decode_column(F.col("ids"), tokenizer_path(), spark).alias("back")).collect()
    for row in again:
        ids = tokenizer.encode(row.text or "", add_special_tokens=False).ids
        assert row.ids == ids and row.back == tokenizer.decode(ids, skip_special_tokens=False)


#: Letters of many kinds; those in the last two strings are composed, decomposed or reordered by normalisation.
ALPHABETS = ["abcdefghij", "aab", "thereinger", "'sretvmld!?.-", "0123ab", "éàüßeá", "日本語",
             "\U0001f600ab\u200d", "<|endoftext|>a", "ΣςσİIıſK", "각가", "THJYWAthjywa\u0308\u0331\u030c\u030a", "\u0323\u0302\u0301\u0344\u1100\u1161aE"]
#: Characters whose bytes stay separate tokens, two equal ones in a row or near each other.
TWINS = ["把游达盛议", "파됐", "把游a", "盛达é日", "\U0001f7df\U0001f61f", "\U0001d160\U0001d15e把"]


def definition(name="word_bpe_49k.json"):
    return open(tokenizer_path(name), encoding="utf-8").read()


def held_against(codec, tokenizer, texts):
    offsets, ids = codec.encode(texts)
    for text, a, b in zip(texts, offsets, offsets[1:]):
        assert ids[a:b].tolist() == tokenizer.encode(text, add_special_tokens=False).ids, text


def random_text(rng, letters, most):
    text = "".join(rng.choice(letters) for _ in range(rng.randint(0, most)))
    if rng.random() < 0.2:
        at = rng.randint(0, len(text))
        text = text[:at] + "<|endoftext|>" + text[at:]
    return text


@pytest.mark.parametrize("spaces", ["", " ", " \n\u3000\x85"])
def test_tree_of_any_text_equals_one_piece(tokenizer, spaces):
    codec = bpe.Codec(definition(), leaf=40, window=4)
    rng = random.Random(len(spaces))
    texts = []
    for _ in range(1500):
        letters = "".join(rng.sample([*ALPHABETS, *TWINS], rng.randint(1, 3))) + spaces
        texts.append(random_text(rng, letters, 400))
    held_against(codec, tokenizer, texts)


def test_long_texts_go_through_the_tree(tokenizer, monkeypatch):
    codec = bpe.Codec(definition(), leaf=40, window=4)
    joins, nodes = [], []
    monkeypatch.setattr(codec, "_join", lambda found: joins.extend(found) or bpe.Codec._join(codec, found))
    monkeypatch.setattr(codec, "_joined", lambda *node: nodes.append(1) or bpe.Codec._joined(codec, *node))
    held_against(codec, tokenizer, ["a few words of a text that has more than forty letters in several leaves, and some more " * 3])
    assert len(joins) == 7 and not nodes
    held_against(codec, tokenizer, ["unsplit" * 40])
    assert len(joins) == 7 and len(nodes) == 7


def test_sides_that_never_agree_are_an_error(tokenizer, monkeypatch):
    codec = bpe.Codec(definition(), leaf=40, window=4)
    monkeypatch.setattr(codec, "_ids", lambda run: [0])
    with pytest.raises(ValueError, match="White space"):
        codec.encode(["some words that are told to be other tokens than the library says they are"])


def test_tree_of_characters_with_equal_tokens(tokenizer):
    codec = bpe.Codec(definition(), leaf=40, window=4)
    for char in "把游达盛议파됐":
        found = tokenizer.encode(char * 3, add_special_tokens=False)
        tokens = list(zip(found.offsets, found.ids))
        assert any(one == two for one, two in zip(tokens, tokens[1:]))
    rng = random.Random(9)
    texts = []
    for _ in range(600):
        letters = "".join(rng.sample([*TWINS, *ALPHABETS], rng.randint(0, 2))) + rng.choice(TWINS)
        texts.append("".join(rng.choice(letters) for _ in range(rng.randint(41, 400))))
    held_against(codec, tokenizer, texts)


def test_marks_are_normalised_before_a_text_is_cut(tokenizer):
    """Marks are reordered over any distance, and letters composed before they are lower-cased."""
    rng = random.Random(5)
    texts = ["café T\u0308est of H\u0331ebrew", "\u0323\u0323\u0302" * 3000, "T\u0308", "x" * 5000 + "T\u0308" * 4000]
    texts += ["".join(rng.choice("ab\u0323\u0302\u0301\u0308\u0331") for _ in range(5000)) for _ in range(40)]
    held_against(bpe.Codec(definition()), tokenizer, texts)


@pytest.mark.parametrize("leaf", [40, bpe.LEAF])
def test_another_tokenizer_that_keeps_white_space(leaf):
    from tokenizers import Tokenizer

    codec = bpe.Codec(definition("byte_bpe_50k.json"), leaf=leaf, window=8)
    assert codec.local and not codec.splits
    whole = Tokenizer.from_str(definition("byte_bpe_50k.json"))
    rng = random.Random(8)
    texts = [random_text(rng, "".join(rng.sample([*ALPHABETS, *TWINS], 2)) + rng.choice(["", " ", "  \n\t", "\u3000  "]), 300) for _ in range(1500)]
    held_against(codec, whole, ["A first text.", "  two  spaces \n\n end ", " " * 500 + "x", *texts])
    offsets, ids = codec.encode(texts)
    assert codec.decode(offsets, ids).to_pylist() == [whole.decode(whole.encode(t).ids, skip_special_tokens=False) for t in texts]


def test_bpe_query_joins_runs_of_several_leaves(spark, tokenizer):
    rng = random.Random(12)
    texts = {k: "".join(rng.choice(letters) for _ in range(3 * bpe.LEAF + 77 * k)) for k, letters in enumerate([*TWINS, *ALPHABETS])}
    texts[len(texts)] = "short words " + texts[0] + " and " + "abcdefghij!" * 700
    texts[len(texts)] = "Café T\u0308est of words " * 2000
    whole = {k: tokenizer.encode(text, add_special_tokens=False).ids for k, text in texts.items()}
    table = spark.createDataFrame([(k, t, "zh", "s", len(t)) for k, t in texts.items()], DOCS)
    wanted = [(k, len(ids), sha(" ".join(map(str, ids))), sha(tokenizer.decode(ids, skip_special_tokens=False))) for k, ids in whole.items()]
    assert multiset(bpe.report(table, tokenizer_path()).collect()) == multiset(wanted)


def test_runs_and_their_tails_equal_whole_texts(tokenizer):
    codec = bpe.Codec(definition())
    rng = random.Random(4)
    odd = [*ALPHABETS, "ab c'", "DEF.'s ", "!?.,-' x", " \n\t\u3000\x85\x1c", "\u2014. a"]
    texts = ["".join(rng.choice("".join(rng.sample(odd, 2))) for _ in range(rng.randint(0, 60))) for _ in range(20_000)]
    held_against(codec, tokenizer, texts)


def test_pipeline_equals_plain_stages(spark, tokenizer):
    """Every stage by a plain version on what its predecessor kept; the learned rules are taken from their stage."""
    docs = read_table(spark, SMALL, "documents")
    rules = quality_rules.learn(quality_rules.learning_rows(docs, read_table(spark, SMALL, "labels")))
    judged = {r.doc_id: r.kept for r in quality_rules.judged(docs, rules).select("row.doc_id", "kept").collect()}
    rows = [tuple(r) for r in docs.collect() if judged[r.doc_id]]
    for row in rows:
        n, *_, repeated = statistics(row[1])
        assert n >= 10 and 100 * repeated <= 20 * n
    texts = without_shared_lines(rows, line_spread.SITES)
    rows = [(r[0], t, r[2], r[3], len(t)) for r, t in zip(rows, texts)]
    roots = classes([plain_simhash(r[1]) for r in rows])
    least = {}
    for row, root in zip(rows, roots):
        least[root] = min(least.get(root, row[0]), row[0])
    rows = [r for r, root in zip(rows, roots) if r[0] == least[root]]
    sizes = defaultdict(int)
    for row in rows:
        sizes[row[3]] += len(words(row[1]))
    targets = plain_targets(sizes)
    found = [tuple(r) for r in corpus_pipeline.run(spark, SMALL).collect()]
    assert {r[:5] for r in found} <= set(rows)
    for row in found:
        ids = tokenizer.encode(row[1], add_special_tokens=False).ids
        assert row[5] == ids and row[6] == len(ids)
    copies = defaultdict(int)
    for row in found:
        copies[row[:5]] += 1
    for row in rows:
        rate = targets[row[3]] / sizes[row[3]] if sizes[row[3]] else 0
        assert int(rate) <= copies[row] <= int(rate) + 1


def test_stages_keep_the_columns_of_documents(spark):
    docs = read_table(spark, SMALL, "documents")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, SMALL).columns == docs.columns
