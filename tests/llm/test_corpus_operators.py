"""Repeated substrings, collocations and the prefix trie against plain versions."""

import hashlib
import random
import re
import tracemalloc
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from outagelens.llm import collocations, prefix_trie, substrings
from outagelens.llm.queries import QUERIES
from outagelens.llm.shared import carried, read_table

from .rows import DOCS, messy

SMALL = "/root/testdata/sf0.001"
CONVERSATIONS = "conv_id long, turn long, role string, text string"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(messy(), DOCS)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="module")
def clashing(docs):
    names = ("row", "id", "hash", "body", "spans", "kept", "maybe", "anchor", "digest", "start", "size", "lang_", "p", "w", "f", "n", "codes",
             "phrase", "words", "rank", "code", "depth", "name", "up", "conv", "place", "one", "part", "parts")
    return docs.withColumns({name: F.lit(f"own {name}") for name in names})


# --- repeated substrings ---------------------------------------------------------------

def covered(texts, length):
    """For each text, which bytes go."""
    often = Counter(t[i:i + length] for t in texts for i in range(len(t) - length + 1))
    out = []
    for t in texts:
        gone = bytearray(len(t))
        for i in range(len(t) - length + 1):
            if often[t[i:i + length]] > 1:
                gone[i:i + length] = b"\1" * length
        out.append(bytes(gone))
    return out


def plain_substrings(rows, length=200):
    bodies = [(text or "").encode() for _, text, *_ in rows]
    out = []
    for (doc_id, *_), body, gone in zip(rows, bodies, covered(bodies, length)):
        kept = bytes(c for c, g in zip(body, gone) if not g)
        runs = sum(1 for _ in re.finditer(b"\1+", gone))
        out.append((doc_id, len(body), sum(gone), runs, hashlib.sha256(kept).hexdigest()))
    return sorted(map(repr, out))


def got(table):
    return sorted(map(repr, map(tuple, table.collect())))


def test_interval_expansion_finds_all_repeated_starts():
    rng = random.Random(1)
    for _ in range(300):
        letters = rng.choice([b"a", b"ab", b"abc", bytes(range(250))])
        texts = [bytes(rng.choice(letters) for _ in range(rng.randint(0, 60))) for _ in range(rng.randint(1, 12))]
        texts += [texts[0][3:] + b"x"] * rng.randint(0, 2)
        length = rng.choice([3, 8, 12, 20])
        often = Counter(t[i:i + length] for t in texts for i in range(len(t) - length + 1))
        found = [[x for a, b in runs for x in range(a, b + 1)] for runs in substrings.repeated_runs(texts, length)]
        assert found == [[i for i in range(len(t) - length + 1) if often[t[i:i + length]] > 1] for t in texts]


def test_equal_strings_have_equal_anchors_wherever_portions_end():
    rng = random.Random(2)
    text = "".join(rng.choice("abcd ") for _ in range(5000)).encode()
    flat = np.frombuffer(text + b"#" + text[1000:3000], np.uint8)
    ends = np.array([5000, 5000, 5001, len(flat)])
    anchors = {}
    for portion in (1 << 20, 700):
        seen = {}
        for first, last, anchor in substrings.anchored(flat, ends, portion=portion):
            for a, b, h in zip(first, last, anchor):
                for start in range(a, b + 1):
                    assert start not in seen
                    seen[start] = h
        assert sorted(seen) == [*range(4801), *range(5001, 6802)]
        assert all(seen[5001 + k] == seen[1000 + k] for k in range(1801))
        anchors[portion] = seen
    assert anchors[700] == anchors[1 << 20]


def test_substrings_of_odd_rows_equal_a_plain_count(docs, clashing, empty):
    assert got(substrings.report(docs)) == plain_substrings(messy())
    assert got(substrings.report(clashing)) == plain_substrings(messy())
    assert substrings.report(empty).count() == 0


def test_pieces_of_one_anchor_in_several_transforms_and_degenerate_texts(spark):
    rng = random.Random(3)
    line = "".join(rng.choice("abcdefgh ") for _ in range(150))
    words = ["".join(rng.choice("xyz") for _ in range(5)) for _ in range(60)]
    rows = [(i, " ".join(rng.choices(words, k=40)) + line + " ".join(rng.choices(words[:3], k=40)), "en", "s", 0) for i in range(60)]
    rows += [(100, "a" * 3000, "en", "s", 0), (101, "ab" * 500, "en", "s", 0), (102, "é日" * 300, "en", "s", 0),
             (None, rows[0][1] + "!", "en", "s", 0), (None, rows[0][1] + "!", "en", "s", 0), (103, line + "q" * 49, "en", "s", 0)]
    table = spark.createDataFrame(rows, DOCS)
    want = plain_substrings(rows)
    assert got(substrings.report(table)) == want
    removed = F.aggregate("spans", F.lit(0), lambda n, s: n + s["end"] - s["start"])
    split = substrings.deduplicated(table, bucket=4).select(
        "row.doc_id", F.octet_length("kept").cast("long") + removed, removed, F.size("spans"), F.sha2("kept", 256))
    assert got(split) == want


def around_one_passage(n, seed=4):
    """Rows whose texts hold one passage, in part, whole or with a changed letter, between texts of their own."""
    rng = random.Random(seed)
    passage = "".join(rng.choice("abcdefgh ") for _ in range(330))
    rows = []
    for i in range(n):
        kept = passage[rng.choice([0, 0, 70]):rng.choice([330, 330, 260])]
        if i % 3 == 0:
            at = rng.randrange(len(kept))
            kept = kept[:at] + rng.choice("XYZ") + kept[at + 1:]
        own = ["".join(rng.choice("klmnop ") for _ in range(rng.choice([0, 40, 180]))) for _ in range(2)]
        rows.append((i // 2 * 2 if i % 10 == 0 else i, own[0] + kept + own[1], "en", "s", 0))
    return rows + [rows[5], rows[5], (None, rows[7][1], "en", "s", 0)]


def test_widened_anchors_lose_no_string(spark):
    rows = around_one_passage(150)
    table = spark.createDataFrame(rows, DOCS)
    want = plain_substrings(rows)
    removed = F.aggregate("spans", F.lit(0), lambda n, s: n + s["end"] - s["start"])
    found = substrings.deduplicated(table, bucket=2).select(
        "row.doc_id", F.octet_length("kept").cast("long") + removed, removed, F.size("spans"), F.sha2("kept", 256))
    assert got(found) == want


def test_an_anchor_with_many_pieces_is_not_cut_into_all_its_strings(spark, monkeypatch):
    held = []
    kept = substrings.stored
    monkeypatch.setattr(substrings, "stored", lambda table, label: held.append((label, kept(table, label))) or held[-1][1])
    substrings.repeated_spans(spark.createDataFrame(around_one_passage(400), DOCS), bucket=50).count()
    pieces = next(table for label, table in held if label == "pieces").count()
    assert pieces > 500
    for label, table in held:
        lists = [F.size(f.name) for f in table.schema if f.dataType.typeName() == "array"]
        made = table.agg(F.count(F.lit(1)) + sum((F.coalesce(F.sum(n), F.lit(0)) for n in lists), F.lit(0))).first()[0]
        assert made <= 4 * pieces, label


def test_substrings_query_equals_brute_force(spark):
    rows = [tuple(r) for r in read_table(spark, SMALL, "documents").select("doc_id", "text").collect()]
    assert got(QUERIES["op11_substrings"](spark, SMALL)) == plain_substrings(rows)


# --- collocations ----------------------------------------------------------------------

def plain_collocations(rows, longest=5, least=100, top=2000):
    often, n = defaultdict(Counter), Counter()
    for _, text, lang, *_ in rows:
        low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split("[.,;:!?\x0a-\x0d]", low):
            own = re.findall("[^\x20\x09]+", piece)
            n[lang or "und"] += len(own)
            for i in range(len(own)):
                often[lang or "und"].update(tuple(own[i:i + k]) for k in range(1, min(longest, len(own) - i) + 1))
    out = []
    for lang, f in often.items():
        found = {p: a for p, a in f.items() if a >= least}
        inner = {p[i:j] for p, a in found.items() for i in range(len(p)) for j in range(i + 1, len(p) + 1)
                 if j - i < len(p) and f[p[i:j]] <= a}
        scored = []
        for p, a in found.items():
            if len(p) > 1 and p not in inner:
                score, k = min((1000 * a * n[lang] // (f[p[:k]] * f[p[k:]]), k) for k in range(1, len(p)))
                scored.append((-score, -a, " ".join(p).encode(), f[p[:k]], f[p[k:]]))
        out += [(lang, rank, p.decode(), -a, l, r, n[lang], -score) for rank, (score, a, p, l, r) in enumerate(sorted(scored)[:top], 1)]
    return sorted(map(repr, out))


PHRASE = ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]


def texts_with_phrases(seed, n=120):
    rng = random.Random(seed)
    words = [f"w{k}" for k in range(30)] + ["É", "日本", "The", "\x00", "\x85"]
    phrase = [" ".join(rng.choices(words, k=rng.randint(2, 6))) for _ in range(6)]
    ends = [". ", "\t", " ", "  ", "\n", "\r", "! ", ", "]
    return [(i, "".join(rng.choice([rng.choice(phrase), rng.choice(words)]) + rng.choice(ends) for _ in range(80)),
             rng.choice(["en", "en", "en", None, "é"]), "s", 0) for i in range(n)]


@pytest.mark.parametrize("least, top, head", [(5, 2000, collocations.HEAD), (5, 7, 20), (20, 2000, 1)])
def test_collocations_equal_a_plain_count(spark, least, top, head):
    rows = texts_with_phrases(least + head)
    found = collocations.collocations(spark.createDataFrame(rows, DOCS), least=least, top=top, head=head)
    assert got(found.select(*PHRASE)) == plain_collocations(rows, least=least, top=top)


def test_collocations_of_odd_rows(docs, clashing, empty):
    want = plain_collocations(messy(), least=8)
    assert want
    assert got(collocations.collocations(docs, least=8).select(*PHRASE)) == want
    assert got(collocations.collocations(clashing, least=8).select(*PHRASE)) == want
    assert collocations.collocations(empty).count() == 0


def test_tiles_count_as_a_plain_count_does():
    rng = np.random.default_rng(4)
    for high, hashed in ((5, 0), (900, 0), (40, 0.3), (70_000, 0.1)):
        p, w = (rng.integers(1, high, 20_000) for _ in "pw")
        far = rng.random(20_000) < hashed
        p[far] |= collocations.HASHED
        found = {(a, b): c for a, b, c in zip(*(x.tolist() for x in collocations.tiled(p, w, tile=16)))}
        assert found == Counter(zip(p.tolist(), w.tolist()))


def test_tiles_beyond_a_table_are_counted_too():
    rng = np.random.default_rng(5)
    p, w = (np.concatenate([rng.integers(1, 70_000, 20_000), np.full(500, 69_999)]) for _ in "pw")
    found = {(a, b): c for a, b, c in zip(*(x.tolist() for x in collocations.tiled(p, w, tile=8)))}
    assert found == Counter(zip(p.tolist(), w.tolist()))


@pytest.mark.parametrize("high", [30_000, 900])
def test_counting_pairs_takes_a_few_times_their_memory(high):
    rng = np.random.default_rng(6)
    pairs = [np.minimum(rng.pareto(0.8, 1_000_000) * 20 + 1, high).astype(np.int64) for _ in "pw"]
    tracemalloc.start()
    collocations.tiled(pairs.pop(0), pairs.pop())
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak <= 2.5 * 16_000_000  # beside the pairs


def test_codes_are_stored_in_short_rows(spark):
    """A portion of text in one row made pages and batches that filled an executor's memory."""
    docs = spark.createDataFrame([(1, "a b c. " * 20_000, "en", "s", 0), (2, "d " * 5_000, "fr", "s", 0)], DOCS).coalesce(1)
    words = collocations.ranked(collocations.word_counts(docs, 1)[0], ["phrase"], collocations._word_hashes("phrase"))
    rows = [(r.lang, r.codes) for r in collocations.encoded(docs, words).collect()]
    assert all(codes[-1] == 0 for _, codes in rows)
    assert max(len(codes) for lang, codes in rows if lang == "en") <= collocations.CODES + 4
    assert [c for lang, codes in rows if lang == "en" for c in codes] == [1, 2, 3, 0] * 20_000
    assert [codes for lang, codes in rows if lang == "fr"] == [[1] * 5_000 + [0]]  # a piece is not cut


def test_rows_and_portions_of_any_size_give_the_same_phrases(spark, monkeypatch):
    rows = texts_with_phrases(9)
    for name, size in (("CODES", 7), ("RUN", 2), ("PAIRS", 50), ("PORTION", 400)):
        monkeypatch.setattr(collocations, name, size)
    monkeypatch.setattr(collocations.in_rows, "__defaults__", (7,))
    monkeypatch.setattr(collocations._runs, "__defaults__", (2,))
    found = collocations.collocations(spark.createDataFrame(rows, DOCS), least=5, head=20)
    assert got(found.select(*PHRASE)) == plain_collocations(rows, least=5)


def test_a_worker_keeps_no_pickled_form_of_what_is_carried(spark):
    model = carried(spark, list(range(1000)))

    def kept(batches):
        from pyspark.core.broadcast import _broadcastRegistry

        for batch in batches:
            total = sum(model())
            values = [getattr(b, "_value", None) for b in _broadcastRegistry.values()]
            yield pa.record_batch([pa.array([total]), pa.array([sum(isinstance(v, bytes) for v in values)])], ["total", "pickled"])

    assert {tuple(r) for r in spark.range(4).mapInArrow(kept, "total long, pickled long").collect()} == {(499_500, 0)}


def test_scores_beyond_64_bits_stay_exact(spark):
    rows = [(i, "one two " * 50, "en", "s", 0) for i in range(2)]
    found = collocations.collocations(spark.createDataFrame(rows, DOCS), longest=2, least=100).first()
    assert (found.phrase, found.a, found.score) == ("one two", 100, 1000 * 100 * 200 // (100 * 100))
    product = spark.sql("select (cast(9000000000000000000L as decimal(19,0)) * cast(8000000000000000000L as decimal(19,0))) "
                        "div (cast(7000000000000000000L as decimal(19,0)) * cast(3L as decimal(19,0))) as x").first().x
    assert product == 9 * 8 * 10**36 // (21 * 10**18)


# --- prefix trie -----------------------------------------------------------------------

def plain_trie(rows):
    own = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            role, text = role or "", text or ""
            own[conv].append(((turn is not None, turn or 0, hashlib.md5(f"{len(role)}:{role}{text}".encode()).digest()), (role, text)))
    turns = {c: [t for _, t in sorted(ts)] for c, ts in own.items()}
    members, built = defaultdict(set), {}
    for c, ts in turns.items():
        h = zlib.crc32(str(c).encode()) % 6
        built[c] = tuple(turns.get(c - int(np.fmod(c, 100)), [])[:h] + ts[h:])
        for d in range(len(built[c]) + 1):
            members[built[c][:d]].add(c)
    children, leaves, saved = Counter(node[:-1] for node in members if node), Counter(), Counter()
    for node, m in members.items():
        for d in range(len(node) + 1):
            leaves[node[:d]] += not children[node]
            saved[node[:d]] += (len(m) - 1) * (len(node[-1][1]) if node else 0)
    out = []
    for node, m in members.items():
        ends = ",".join(str(c) for c in sorted(m) if built[c] == node)
        out.append((min(m), len(node), min(members[node[:-1]]) if node else None, len(m), children[node], leaves[node], saved[node],
                    hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(map(repr, out))


def odd_conversations():
    rng = random.Random(6)
    rows = [(c, t, rng.choice(["user", "assistant"]), rng.choice(["hi", "yes", "no", "", "é日"]))
            for c in [*range(95, 130), 200, 399, -5, -100, -230] for t in range(rng.randint(1, 9))]
    rows += [(300, None, "user", "null turn"), (300, None, None, None), (300, 2**40, "user", None), (300, 1, None, "x"), (300, 1, None, "x"),
             (None, 1, "user", "no conversation"), (500, None, None, None)]
    rows += [(700, t, "user", f"turn {t % 3}") for t in range(70)] + [(701, t, "user", f"turn {t % 3}") for t in range(66)]
    return rows


def test_trie_of_odd_rows_equals_a_plain_one(spark):
    table = spark.createDataFrame(odd_conversations(), CONVERSATIONS)
    want = plain_trie(odd_conversations())
    assert got(prefix_trie.report(table)) == want
    extra = table.withColumns({n: F.lit("own") for n in ("depth", "name", "up", "place", "one", "size", "base", "h", "block", "n_turns", "chars")})
    assert got(prefix_trie.report(extra)) == want
    assert prefix_trie.report(spark.createDataFrame([], CONVERSATIONS)).count() == 0


def test_trie_query_equals_brute_force(spark):
    rows = [tuple(r) for r in read_table(spark, SMALL, "conversations").select("conv_id", "turn", "role", "text").collect()]
    assert got(QUERIES["op13_prefix_trie"](spark, SMALL)) == plain_trie(rows)


def test_many_members_of_one_node_digest_in_order(spark, monkeypatch):
    monkeypatch.setattr(prefix_trie, "PIECE", 50)
    rows = [(c, 0, "user", "same") for c in range(1, 400) if zlib.crc32(str(c).encode()) % 6 == 0]
    assert got(prefix_trie.report(spark.createDataFrame(rows, CONVERSATIONS))) == plain_trie(rows)
