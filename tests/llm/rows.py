"""Small tables with the rows that break things, and plain versions of the operators to hold them against."""

import hashlib
import re
from collections import Counter

import xxhash

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
LONG = " ".join(f"word{i % 700} other{i % 11}\n" for i in range(6000))


def messy():
    """Nulls in every column, empty and very long texts, copies, near copies, repeated rows, odd spaces."""
    near = " ".join(f"token{i}" for i in range(400))
    rows = [
        (1, "The quick brown fox jumps over the lazy dog and runs away from it all day.", "en", "a"),
        (2, None, "en", "a"), (3, "", "fr", "a"), (4, " \t\n\x0b\x0c\r ", None, "b"),
        (5, LONG, "en", "b"), (6, LONG, "en", None), (7, near, "de", "c"), (8, near + " more", "de", "c"),
        (9, near, None, None), (9, near, None, None), (10, "same id one", "en", "c"), (10, "same id two", "en", "c"),
        (None, "no id at all", "en", "d"), (None, None, None, None),
        (11, "café ÉTÉ 日本語 \U0001f600 é \x00 \x1c \x85   　", "fr", "d"),
        (12, "x", "en", "é"), (13, "menu\nhome\nmenu\nhome\nbody of it", "en", "d"),
        (14, "one two three four five one two three four five six", "en", "e"),
    ]
    rows += [(100 + k, f"shared line of text\nown {k} {'abcdefghij'[k]} words here\n\nshared line of text", "en", f"s{k}") for k in range(10)]
    return [(i, t, lang, s, None if t is None else len(t)) for i, t, lang, s in rows]


def words(text):
    return WORD.findall(text or "")


def statistics(text):
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    text = text or ""
    found = words(text)
    windows = [tuple(found[i:i + 5]) for i in range(len(found) - 4)]
    often = Counter(windows)
    covered = {i + k for i, w in enumerate(windows) if often[w] > 1 for k in range(5)}
    lines = [line for line in text.split("\n") if words(line)]
    return len(found), sum(map(len, found)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered)


def simhash(text):
    found = words(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not found:
        return 0
    shingles = [" ".join(found[i:i + 3]) for i in range(len(found) - 2)] or [" ".join(found)]
    hashes = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in shingles]
    return sum(1 << bit for bit in range(64) if 2 * sum(h >> bit & 1 for h in hashes) > len(hashes))


def classes(prints, radius=2):
    """The components of all pairs within the radius, as a root for each place."""
    root = list(range(len(prints)))

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for i, a in enumerate(prints):
        for j in range(i):
            if (a ^ prints[j]).bit_count() <= radius:
                one, two = sorted((find(i), find(j)))
                root[two] = one
    return [find(k) for k in range(len(prints))]


def without_shared_lines(rows, sites):
    """Texts after line dedup, by place."""
    spread, first = {}, {}
    for doc_id, text, _, source, _ in rows:
        for line in {x.strip(" \t\n\x0b\x0c\r") for x in (text or "").split("\n")} - {""}:
            spread.setdefault(line, set()).add(source)
            if doc_id is not None:
                first[line] = min(first.get(line, doc_id), doc_id)
    out = []
    for doc_id, text, *_ in rows:
        gone = {line for line, found in spread.items() if len(found) >= sites and line in first and first[line] != doc_id}
        out.append(None if text is None else "\n".join(x for x in text.split("\n") if x.strip(" \t\n\x0b\x0c\r") not in gone))
    return out


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()
