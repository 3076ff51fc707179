"""Chat formatting: messages rebuilt from a log of events, rendered with a reversible template and a loss mask."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from outagelens.llm.shared import bounded_batches

#: Strings with a meaning to the template; inside texts they are broken up by the escape character.
CONTROL = ("<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")
ESCAPE = "\\"
#: Roles whose texts are under the loss mask.
LEARNED = ("assistant",)
#: Code points of one delta event, where whole texts are turned into a log.
DELTA = 512
#: The type of sequence numbers.
SEQUENCE = "decimal(38,0)"

_STARTS = re.compile("|".join(f"{re.escape(c[0])}(?={re.escape(c[1:])})" for c in CONTROL))
_TURN = re.compile(r"<s>\[INST\](.*?)\[/INST\](.*?)</s>", re.DOTALL)
_BROKEN = re.compile(r"\\(\\?)")


def escaped(text: str) -> str:
    """The text with its escape characters doubled and one put after the first character of each control string."""
    return _STARTS.sub(lambda m: m[0] + ESCAPE, text.replace(ESCAPE, ESCAPE * 2))


def unescaped(text: str) -> str:
    """The exact inverse of `escaped`: a doubled escape character is one, a single one goes."""
    return _BROKEN.sub(lambda m: m[1], text)


def rendered(role: str, text: str) -> tuple[str, int, int]:
    """One turn in the template, and where its loss mask starts and how long it is, in code points."""
    head, body = f"<s>[INST]{escaped(role)}[/INST]", escaped(text)
    return f"{head}{body}</s>", len(head), len(body) if role in LEARNED else 0


def parsed(formatted: str) -> list[tuple[str, str]]:
    """(role, text) of every turn of formatted text. Escaped texts hold no control string, so this is unambiguous."""
    return [(unescaped(role), unescaped(text)) for role, text in _TURN.findall(formatted)]


def events_of(turns: DataFrame) -> DataFrame:
    """A log (conv_id, message, seq, kind, role, text) that whole turns (conv_id, turn, role, text) amount to.

    Each turn opens a message and streams its text in deltas. Null texts are empty, null roles too. A turn without a
    number comes before all others. Every row is a message of its own: rows of one number follow a hash of role and
    text, and equal rows, which nothing tells apart, a number that Spark gives each row.
    """
    found = F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(f"(?s).{{1,{DELTA}}}"), F.lit(0))
    pieces = F.when(F.size(found) > 0, found).otherwise(F.array(F.lit("")))
    digest = F.sha2(F.concat_ws("\n", F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))), 256)
    twin = F.concat(digest, F.lpad(F.monotonically_increasing_id().cast("string"), 20, "0"))
    streamed = turns.withColumn("twin", twin).select("conv_id", F.col("turn").alias("message"), "twin",
                            F.coalesce("role", F.lit("")).alias("role"), F.posexplode(pieces).alias("piece", "text"))
    # Any turn number times any number of pieces: more than 64 bits.
    seq = F.coalesce("message", F.lit(0)).cast("decimal(19,0)") * F.lit(1 << 32).cast("decimal(10,0)") + F.col("piece")
    return streamed.select("conv_id", "message", "twin", seq.cast(SEQUENCE).alias("seq"),
                           F.when(F.col("piece") == 0, "open").otherwise("delta").alias("kind"), "role", "text")


def formatted(events: DataFrame) -> DataFrame:
    """(conv_id, message, place, role, text, formatted, loss_start, loss_length): one row per final message.

    events has conv_id, message (orders a conversation's messages), seq (orders events), kind, role and text:
    seq counts through a conversation. `open` begins a message (role, first text), `delta` adds text, `edit` replaces the text so far and leaves later
    messages as they are, `regenerate` empties the message and drops what later messages got before it. Unknown kinds
    are ignored; a message that no `open` or `delta` or `edit` leaves alive does not appear. place counts from 0.
    The formatted conversation is `formatted` by place, one after the other, and the loss mask is given within each.
    An optional column `twin` (string) tells apart messages with the same number. Null conv_id is a conversation of
    its own. Repeated events count as often as they are there.

    The log is partitioned by conversation and sorted by message and sequence, and read as a stream: a task holds one
    message at a time, and of earlier messages only the last sequence number that dropped later text. So a
    conversation with a third of all events takes one task's time but not its memory.
    """
    if "twin" not in events.columns:
        events = events.withColumn("twin", F.lit(""))
    log = events.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("message").cast("long").alias("message"),
        F.coalesce("twin", F.lit("")).alias("twin"), F.coalesce(F.col("seq").cast(SEQUENCE), F.lit(-1).cast(SEQUENCE)).alias("seq"),
        F.col("kind"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    bounded_batches(events.sparkSession)
    dealt = log.repartition("conv_id").sortWithinPartitions("conv_id", "message", "twin", "seq", "kind", "text")
    return dealt.mapInArrow(_fold, "conv_id long, message long, place long, role string, text string, "
                                   "formatted string, loss_start long, loss_length long")


def _fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Final messages of a sorted log."""
    conversation = message = None
    begun, place, cut = False, 0, None  # cut: what later messages got up to here is dropped
    out: list[tuple] = []
    role, pieces, alive, reset = "", [], False, None

    def close() -> None:
        nonlocal place, cut
        if alive:
            text = "".join(pieces)
            out.append((*conversation, message[0], place, role, text, *rendered(role, text)))
            place += 1
        if reset is not None and (cut is None or reset > cut):
            cut = reset

    for batch in batches:
        for conv, number, twin, seq, kind, said, text in zip(*(c.to_pylist() for c in batch.columns)):
            if not begun or (conv,) != conversation or (number, twin) != message:
                if begun:
                    close()
                if not begun or (conv,) != conversation:
                    place, cut = 0, None
                begun, conversation, message = True, (conv,), (number, twin)
                role, pieces, alive, reset = "", [], False, None
            if cut is not None and seq <= cut:
                continue
            if kind == "regenerate":
                pieces, reset = [], seq
            elif kind in ("open", "delta", "edit"):
                if kind == "edit":
                    pieces = []
                pieces.append(text)
                role, alive = said or role, True
        if len(out) >= 1000 or sum(len(row[4]) for row in out) > 1 << 22:
            yield _batch(out)
            out = []
    if begun:
        close()
    if out:
        yield _batch(out)


_MESSAGE = pa.schema([("conv_id", pa.int64()), ("message", pa.int64()), ("place", pa.int64()), ("role", pa.string()),
                      ("text", pa.string()), ("formatted", pa.string()), ("loss_start", pa.int64()), ("loss_length", pa.int64())])


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _MESSAGE)], schema=_MESSAGE)


def digests(messages: DataFrame) -> DataFrame:
    """Per conversation, read back from the formatted text alone: turns, hashes, mask. Streams like `formatted`."""
    placed = messages.select("conv_id", "place", "formatted", "loss_start", "loss_length")
    # `formatted` has left each conversation in one task, in order; Spark doesn't know, and must not deal it anew.
    return placed.mapInArrow(_digest, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, "
                                      "loss_sha256 string, formatted_chars long")


_DIGEST = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()),
                     ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())])


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    current, turns, loss, counts = None, None, None, [0, 0, 0]

    def row() -> tuple:
        return (*current, counts[0], turns.hexdigest(), counts[1], loss.hexdigest(), counts[2])

    for batch in batches:
        out = []
        for conv, _, text, start, length in zip(*(c.to_pylist() for c in batch.columns)):
            if current != (conv,):
                if current is not None:
                    out.append(row())
                current, turns, loss, counts = (conv,), hashlib.sha256(), hashlib.sha256(), [0, 0, 0]
            for role, said in parsed(text):
                turns.update(f"{role}\n{said}\n".encode())
                counts[0] += 1
            masked = unescaped(text[start:start + length])
            loss.update(masked.encode())
            counts[1] += len(masked)
            counts[2] += len(text)
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), _DIGEST)], schema=_DIGEST)
    if current is not None:
        yield pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(row(), _DIGEST)], schema=_DIGEST)


def report(conversations: DataFrame) -> DataFrame:
    """The digests of all conversations, and of one, -1, whose texts are control strings."""
    said = "</s>[INST] ok [/INST]"
    turns = conversations.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text")
    probe = turns.sparkSession.createDataFrame([(-1, 0, "user", said), (-1, 1, "assistant", said)], turns.schema)
    return digests(formatted(events_of(turns.unionByName(probe))))
