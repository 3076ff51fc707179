"""BPE encoding and decoding: the halves of a long text are encoded on their own, then joined as a tree of windows."""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from itertools import chain, takewhile
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from outagelens.llm.shared import bounded_batches, per_process

#: Code points that are encoded as one piece; a longer text is halved until its parts are no longer.
LEAF = 4096
#: Code points on either side of a join that the first window holds; a window that doesn't agree is doubled.
WINDOW = 64
#: Consecutive tokens, with their places, that a window must share with a side to agree with it.
AGREED = 4
#: Leaves from which on a text's leaves are encoded by several threads.
THREADED = 64
#: Distinct runs whose ids a worker remembers; beyond them it forgets all and begins again.
REMEMBERED = 500_000
#: Bytes of text that are cut into runs at a time, a longer text alone.
PORTION = 1 << 20
#: ASCII punctuation but the apostrophe, which begins contractions.
TAIL = bytes(c for c in range(33, 127) if not chr(c).isalnum() and chr(c) != "'")

# The normaliser and the pre-tokenizer under which runs between white space are independent.
SPLITTING_NORMALIZER = {"type": "Sequence", "normalizers": [
    {"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]}
SPLITTING_PATTERN = {"type": "Split", "pattern": {
    "Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True}

#: What a key begins with that holds ids and not a run: no text's bytes begin so.
IDS = b"\xff"


class Codec:
    """Encodes and decodes as the tokenizer of a `tokenizers` library file does, without its truncation and padding.

    Two things are read from the definition. `splits`: the tokenizer drops white space and joins nothing across it, so
    the ids of a text are those of the runs between, and a run met before is looked up. `local`: what a piece becomes
    depends on its neighbourhood only, so that long texts can be encoded in parts and joined. Where either does not
    hold, whole texts go to the library.

    Long texts are halved between runs, and each join is held against a window that is encoded anew. What has no place
    to cut, a long run or any long text of a tokenizer that keeps white space, is cut at special tokens, which are looked
    for in the raw text, and normalised as a whole before it is halved: a normaliser may reorder any number of marks.
    Its parts go to a tokenizer without normaliser and without special tokens.
    """

    def __init__(self, definition: str, leaf: int = LEAF, window: int = WINDOW):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(definition)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        found = json.loads(definition)
        plain = found | {"normalizer": None, "added_tokens": [], "truncation": None, "padding": None, "post_processor": None}
        self.plain = Tokenizer.from_str(json.dumps(plain))
        self.added = {t["content"]: t["id"] for t in found.get("added_tokens") or []}
        self.splits, self.local = _splits(found), _local(found)
        self.special = re.compile("|".join(map(re.escape, sorted(self.added, key=len, reverse=True)))) if self.added else None
        self.leaf, self.window = leaf, window
        self.pool = ThreadPoolExecutor(max_workers=max(2, min(4, os.cpu_count() or 2)))
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        names: list[str | None] = [None] * (max(vocabulary.values()) + 1)
        for name, number in vocabulary.items():
            names[number] = name
        self.names = pa.array(names, pa.string())
        self._forget()

    def _forget(self) -> None:
        self.known: dict[bytes, int] = {}
        self.flat = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int32))

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Offsets, one more than texts, into the ids of all texts."""
        found = [self._runs(t) for t in texts]
        runs = [own for own, _ in found]
        if len(self.known) > REMEMBERED or len(self.flat[2]) > 40 * REMEMBERED:
            self._forget()
        self._learn(set().union(*runs).difference(self.known))
        self._join([(own, at) for own, joins in found for at in joins])
        places = np.fromiter(map(self.known.__getitem__, chain.from_iterable(runs)), np.int64)
        starts, ends, flat = self.flat
        lengths = ends[places] - starts[places]
        before = np.concatenate(([0], np.cumsum(lengths)))
        ids = flat[np.repeat(starts[places] - before[:-1], lengths) + np.arange(before[-1])]
        return before[np.concatenate(([0], np.cumsum([len(own) for own in runs], dtype=np.int64)))], ids

    def _runs(self, text: str | None) -> tuple[list[bytes], list[int]]:
        """The keys of the runs that a text is made of, and the runs that a leaf of a long text begins with.

        Where runs are independent, leaves are cut between them: no normaliser reaches across white space. A run that is
        longer than a leaf has a tree of its own, and so has a long text of a tokenizer that keeps white space.
        """
        if not text:
            return [], []
        long = len(text) > self.leaf
        if not self.splits:
            return (self.tree(text) if long and self.local else [text.encode()]), []
        runs = text.encode().split()
        if not long:
            return runs, []
        if max(map(len, runs), default=0) > self.leaf:
            runs = list(chain.from_iterable(self.tree(r.decode()) if len(r.decode()) > self.leaf else (r,) for r in runs))
        parts = 1 << (-(-len(text) // self.leaf) - 1).bit_length()
        return runs, sorted({len(runs) * k // parts for k in range(1, parts)} - {0})

    def _join(self, joins: list[tuple[list[bytes], int]]) -> None:
        """Hold a window around each join, encoded anew as one piece, against both sides; double it until they agree."""
        window = self.window
        while joins:
            spans = [(own, _reach(own, at, -1, window), _reach(own, at, 1, window)) for own, at in joins]
            texts = [b" ".join(own[a:b]).decode() for own, a, b in spans]
            again = [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
            left = []
            for join, (own, a, b), ids in zip(joins, spans, again):
                if ids != list(chain.from_iterable(map(self._ids, own[a:b]))):
                    left.append((join, own, a, b, ids))
            joins, window = [join for join, *_ in left], 2 * window
            if any(own[a:b] == own for _, own, a, b, _ in left):
                raise ValueError("White space does not end the tokens of this tokenizer")

    def _learn(self, runs: set[bytes]) -> None:
        """Remember the ids of these runs, and of the parts they are cut into. The library encodes each part once."""
        if not runs:
            return
        parts = {run: _parts(run) if self.splits else (run,) for run in runs if run[:1] != IDS}
        found = {run: np.frombuffer(run[1:], np.int32).tolist() for run in runs if run[:1] == IDS}
        pieces = list(set(chain.from_iterable(parts.values())).difference(self.known))
        encoded = self.tokenizer.encode_batch_fast([p.decode() for p in pieces], add_special_tokens=False)
        found.update((piece, e.ids) for piece, e in zip(pieces, encoded))
        for run, cut in parts.items():
            if run not in found:
                found[run] = [k for piece in cut for k in (found[piece] if piece in found else self._ids(piece))]
        self.known.update(zip(found, range(len(self.known), len(self.known) + len(found))))
        lengths = np.fromiter(map(len, found.values()), np.int64, len(found))
        ends = len(self.flat[2]) + np.cumsum(lengths)
        ids = np.fromiter(chain.from_iterable(found.values()), np.int32)
        self.flat = tuple(np.concatenate(pair) for pair in zip(self.flat, (ends - lengths, ends, ids)))

    def _ids(self, run: bytes) -> list[int]:
        starts, ends, flat = self.flat
        place = self.known[run]
        return flat[starts[place]:ends[place]].tolist()

    def tree(self, text: str) -> list[bytes]:
        """The keys of the parts of a long text between special tokens, and of those."""
        out, at = [], 0
        for special in self.special.finditer(text) if self.special else ():
            out += self._joined_keys(text[at:special.start()])
            out.append(IDS + np.array([self.added[special[0]]], np.int32).tobytes())
            at = special.end()
        return out + self._joined_keys(text[at:])

    def _joined_keys(self, raw: str) -> list[bytes]:
        """The key of a stretch without special tokens: leaves, joined in pairs, level by level."""
        text = self.tokenizer.normalizer.normalize_str(raw) if raw and self.tokenizer.normalizer else raw
        parts = max(1, 1 << (max(1, -(-len(text) // self.leaf)) - 1).bit_length())
        cuts = [len(text) * k // parts for k in range(parts + 1)]
        each = self.pool.map if parts >= THREADED else map
        nodes = list(each(lambda span: self._tokens(text, *span), [(a, b) for a, b in zip(cuts, cuts[1:]) if a < b]))
        while len(nodes) > 1:
            pairs = list(zip(nodes[::2], nodes[1::2]))
            nodes = list(each(lambda pair: self._joined(text, *pair), pairs)) + nodes[len(pairs) * 2:]
        return [IDS + np.array([number for _, _, number in nodes[0][2]], np.int32).tobytes()] if nodes else []

    def _tokens(self, text: str, a: int, b: int):
        """a, b and the tokens (start, end, id) of text[a:b], placed in the whole text."""
        found = self.plain.encode(text[a:b], add_special_tokens=False)
        return a, b, [(s + a, e + a, number) for (s, e), number in zip(found.offsets, found.ids)]

    def _joined(self, text: str, left, right):
        """The tokens of both sides' text, exactly as of one piece.

        A window around the join is encoded anew. Where AGREED tokens in a row are the same in it and in a side, the
        side goes on as it was: whether a token sequence is the encoding depends on neighbouring tokens only, and all
        neighbours then come from one encoding. Tokens that touch a cut don't count, as the cut may have changed them.
        The window doubles until it agrees with both sides, or it holds a side whole.
        """
        lo, at, one = left
        _, hi, two = right
        half = self.window
        while True:
            a, b = max(lo, at - half), min(hi, at + half)
            _, _, seen = self._tokens(text, a, b)
            first = (0, 0) if a == lo else _agreement(seen, one, a, at, False)
            last = (len(seen), len(two)) if b == hi else _agreement(seen, two, a, b, True)
            if first and last and first[0] <= last[0]:
                return lo, hi, one[:first[1]] + seen[first[0]:last[0]] + two[last[1]:]
            half *= 2

    def decode(self, offsets: np.ndarray, ids: np.ndarray) -> pa.Array:
        """The texts, as the library's decode(ids, skip_special_tokens=False): without a decoder, tokens and spaces."""
        if self.tokenizer.decoder is not None:
            lists = [ids[a:b].tolist() for a, b in zip(offsets, offsets[1:])]
            return pa.array(self.tokenizer.decode_batch(lists, skip_special_tokens=False), pa.string())
        return spaced(offsets, self.names.take(pa.array(ids)))


def spaced(offsets: np.ndarray, words: pa.Array) -> pa.Array:
    """The words between each two offsets, joined by single spaces."""
    return pc.binary_join(pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), words), " ")


def _splits(definition: dict) -> bool:
    """Whether white space ends a token and is dropped, and nothing is normalised across it."""
    before = definition.get("pre_tokenizer") or {}
    return (definition.get("normalizer") == SPLITTING_NORMALIZER and before.get("type") == "Sequence"
            and before["pretokenizers"][0] == SPLITTING_PATTERN and _local(definition))


def _local(definition: dict) -> bool:
    """Whether what a normalised piece becomes depends on its neighbourhood only: byte-level pieces cut by a pattern,
    merged without chance, and special tokens that are looked for in the raw text, just as they are."""
    before = definition.get("pre_tokenizer") or {}
    steps = before["pretokenizers"] if before.get("type") == "Sequence" else [before]
    cut = all(s.get("type") == "Split" or s.get("type") == "ByteLevel" and not s["add_prefix_space"] for s in steps)
    model = definition["model"]
    merges = model.get("type") == "BPE" and not any(
        model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "byte_fallback", "ignore_merges"))
    odd = any(t.get(k) for t in definition.get("added_tokens") or [] for k in ("single_word", "lstrip", "rstrip", "normalized"))
    return cut and merges and not odd


def _reach(runs: list[bytes], at: int, step: int, window: int) -> int:
    """How far a window of so many bytes reaches from `at` to one side: whole runs, up to one that is ids."""
    size = 0
    while size < window and 0 <= (at - 1 if step < 0 else at) < len(runs):
        run = runs[at - 1 if step < 0 else at]
        if run[:1] == IDS:
            break
        size += len(run) + 1
        at += step
    return at


def _parts(run: bytes) -> tuple[bytes, ...]:
    """A run of ASCII lower-cased, cut before its last punctuation where a letter or digit comes before.

    The tokenizer lower-cases anyway and never joins a letter or digit with punctuation other than the apostrophe.
    Other runs stay whole with their case, as letters are composed before they are lower-cased, and so do those that
    may hold a special token's name.
    """
    if b"<|" in run or not run.isascii():
        return (run,)
    low = run.lower()
    stem = low.rstrip(TAIL)
    return (stem, low[len(stem):]) if len(stem) < len(low) and stem[-1:].isalnum() else (low,)


def _agreement(seen: list, side: list, begin: int, end: int, from_end: bool):
    """Where the window's tokens `seen` may pass over to those of `side`: the places in `seen` and in `side`, or None.

    From the left side the window takes over after the first AGREED shared tokens; to the right side it hands over
    before the last ones. Tokens count from `begin` and if they end before `end`. One character can give equal tokens,
    so each place of a token is tried, and shared tokens of a single character don't count: only those that begin at
    two characters or more are found once at most in `seen` and once in `side`.
    """
    near = range(len(side)) if from_end else range(len(side) - 1, -1, -1)
    inside = (lambda t: t[1] <= end) if from_end else (lambda t: begin <= t[0])
    places: dict[tuple, list[int]] = {}
    for at in takewhile(lambda k: inside(side[k]), near):
        places.setdefault(side[at], []).append(at)
    starts = range(len(seen) - AGREED, -1, -1) if from_end else range(len(seen) - AGREED + 1)
    for k in starts:
        shared = seen[k:k + AGREED]
        if shared[0][0] == shared[-1][0] or any(t[1] >= end for t in shared):
            continue
        for at in places.get(shared[0], ()):
            if side[at:at + AGREED] == shared:
                return (k, at) if from_end else (k + AGREED, at + AGREED)
    return None


def _portions(texts: pa.Array) -> Iterator[pa.Array]:
    """The texts in portions of PORTION bytes or one text."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False))
    at = 0
    while at < len(texts):
        before = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, before + PORTION, side="right")))
        yield texts.slice(at, to - at)
        at = to


def _codec(definition) -> Codec:
    return per_process(f"codec-{hashlib.sha256(definition.value.encode()).hexdigest()}", lambda: Codec(definition.value))


def _shared(path: str, spark):
    """The tokenizer's file, read on the driver and broadcast: one vocabulary, whatever the corpus."""
    return bounded_batches(spark).sparkContext.broadcast(Path(path).read_text(encoding="utf-8"))


def encode_column(text: Column, path: str, spark) -> Column:
    """array<int>: the ids of each text; none for null or empty text."""
    definition = _shared(path, spark)

    @F.arrow_udf("array<int>")
    def encode(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        codec = _codec(definition)
        for texts in chain.from_iterable(map(_portions, batches)):
            offsets, ids = codec.encode(texts.to_pylist())
            yield pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(ids))

    return encode(text)


def decode_column(ids: Column, path: str, spark) -> Column:
    """string: the text that the ids decode to, special tokens included; null ids give empty text."""
    definition = _shared(path, spark)

    @F.arrow_udf("string")
    def decode(lists: pa.Array) -> pa.Array:
        filled = pc.fill_null(lists.cast(pa.large_list(pa.int32())), pa.scalar([], pa.large_list(pa.int32())))
        offsets = np.concatenate(([0], np.cumsum(pc.list_value_length(filled).to_numpy(zero_copy_only=False))))
        return _codec(definition).decode(offsets.astype(np.int64), pc.list_flatten(filled).to_numpy())

    return decode(ids)


def encoded(docs: DataFrame, path: str) -> DataFrame:
    """docs with n_tokens (long) and ids (array<int>) of the whole text; a column of one of these names is replaced.

    Map-only: each row is encoded where it is read, in Arrow batches. Null or empty text has no ids; repeated rows
    get the same ids; an empty table gives an empty one.
    """
    ids = encode_column(F.col("text"), path, docs.sparkSession)
    return docs.withColumn("ids", ids).withColumn("n_tokens", F.size("ids").cast("long"))


def report(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, and the digests of the ids and of the text that they decode to, from one pass."""
    definition = _shared(path, docs.sparkSession)

    @F.arrow_udf("n_tokens long, ids_sha256 string, decoded_sha256 string")
    def digests(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        codec = _codec(definition)
        for texts in chain.from_iterable(map(_portions, batches)):
            offsets, ids = codec.encode(texts.to_pylist())
            joined = spaced(offsets, pc.cast(pa.array(ids), pa.string()))
            yield pa.StructArray.from_arrays(
                [pa.array(np.diff(offsets)), _digests(joined), _digests(codec.decode(offsets, ids))],
                ["n_tokens", "ids_sha256", "decoded_sha256"])

    found = docs.select("doc_id", F.explode(F.array(digests(F.col("text")))).alias("found"))
    return found.select("doc_id", "found.*")


def _digests(texts: pa.Array) -> pa.Array:
    return pa.array([hashlib.sha256(t.as_buffer()).hexdigest() for t in texts], pa.string())
