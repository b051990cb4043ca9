"""Conversations folded from event logs and rendered in a chat template that can be read back.

A log has rows (conv_id, turn, message, role, seq, kind, start, stop, text). In the order of seq, the events of a message make its text:

* ``delta`` (or a null kind) appends its text, as a reply that is streamed does;
* ``edit`` puts its text in place of the code points from ``start`` to ``stop``; without them in place of the whole text;
* ``regenerate`` empties the message, and the deltas that follow write it anew.

A message has the role of its first event. Logs are dealt out by conversation and blocks of its turns, sorted by turn, message and seq, and
folded as a stream: a task holds one message at a time, and a very long conversation is many blocks, which different tasks render.

The template writes ``<|turn|>role``, a line break, the text, ``<|end|>`` and a line break. In texts and roles a backslash is put behind the first
character of whatever looks like a control string, and one more where backslashes already stand there; so no control string is left in them, and
taking one backslash away restores any text. Roles have their backslashes and line breaks escaped before. What a model learns from is a list of
spans of code points, the texts of ``assistant``.

Nulls: a null text, role or kind is empty; a null turn stands first; rows without a conversation are one conversation. Ties: messages of one
turn stand in the order of their names, which ``logged`` makes of a digest of role and text, so that reruns agree; events of equal seq in any order.
Repeated rows are turns of their own. Empty texts are rendered as such. A very long text is one message: it is held whole in one task, as text.
An empty log gives no rows. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TURN, END = "<|turn|>", "<|end|>\n"

# What marks turns in the templates of public chat models, after a "<" or "[".
CONTROL = r"/?s>|/?INST\]|/?SYS>|\|[A-Za-z0-9_]+\|>"

_ESCAPE, _UNESCAPE = re.compile(rf"([<\[])(\\*)(?={CONTROL})"), re.compile(rf"([<\[])\\(\\*)(?={CONTROL})")

EVENTS = "conv_id bigint, turn bigint, message string, role string, seq bigint, kind string, start bigint, stop bigint, text string"
FORMATTED = "conv_id bigint, block bigint, part bigint, text string, loss array<struct<start: bigint, stop: bigint>>"
READ_BACK = "conv_id bigint, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint"


def escaped(text: str) -> str:
    return _ESCAPE.sub(r"\1\\\2", text)


def unescaped(text: str) -> str:
    return _UNESCAPE.sub(r"\1\2", text)


def escaped_role(role: str) -> str:
    return escaped(role.replace("\\", "\\\\").replace("\n", "\\n"))


def unescaped_role(role: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], unescaped(role))


def fold(events: Iterator[tuple[str | None, int | None, int | None, str | None]]) -> str:
    """The final text of a message of its events (kind, start, stop, text), in order. Appending is linear in the text."""
    parts: list[str] = []
    for kind, start, stop, text in events:
        if not kind or kind == "delta":
            parts.append(text or "")
        elif kind == "regenerate":
            parts = []
        elif kind == "edit":
            whole = "".join(parts)
            first = 0 if start is None else max(0, start)
            parts = [whole[:first], text or "", whole[len(whole) if stop is None else max(first, stop) :]]
        else:
            raise ValueError(f"{kind} isn't delta, edit or regenerate")
    return "".join(parts)


def rendered(role: str, text: str) -> tuple[str, int, int]:
    """A turn in the template, and where its text stands in it."""
    head, body = f"{TURN}{escaped_role(role)}\n", escaped(text)
    return f"{head}{body}{END}", len(head), len(head) + len(body)


def turns(text: str) -> Iterator[tuple[str, str]]:
    """Roles and texts of a part, read from it."""
    at = 0
    while at < len(text):
        line = text.index("\n", at)
        stop = text.index(END, line + 1)
        if not text.startswith(TURN, at):
            raise ValueError("a turn must begin with its mark")
        yield unescaped_role(text[at + len(TURN) : line]), unescaped(text[line + 1 : stop])
        at = stop + len(END)


def logged(conversations: DataFrame, piece: int = 400) -> DataFrame:
    """The log that a chat service would have written of finished conversations (conv_id, turn, role, text).

    Every text is streamed in deltas of at most ``piece`` code points. A user's first piece is typed wrongly (backwards) and edited; an assistant's
    first attempt breaks off after its first piece and is regenerated.
    """
    role, text = (F.coalesce(F.col(c), F.lit("")) for c in ("role", "text"))
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), role.alias("role"), text.alias("text"))
    name = F.concat(F.sha2(F.concat("role", F.lit("\0"), "text"), 256), F.lit("-"), F.lpad(F.hex(F.monotonically_increasing_id()), 16, "0"))
    rows = rows.withColumn("message", name).withColumn("pieces", F.regexp_extract_all("text", F.lit(rf"(?s).{{1,{piece}}}"), F.lit(0)))
    none = F.lit(None).cast("long")
    event = lambda kind, text, start=none, stop=none: F.struct(F.lit(kind).alias("kind"), start.alias("start"), stop.alias("stop"), text.alias("text"))
    first = F.coalesce(F.try_element_at("pieces", F.lit(1)), F.lit(""))
    rest = F.transform(F.slice("pieces", 2, F.greatest(F.size("pieces") - 1, F.lit(0))), lambda p: event("delta", p))
    edited = F.array(event("delta", F.reverse(first)), event("edit", first, F.lit(0).cast("long"), F.length(first).cast("long")))
    again = F.array(event("delta", first), event("regenerate", F.lit(None).cast("string")), event("delta", first))
    start = F.when(F.col("role") == "user", edited).when(F.col("role") == "assistant", again).otherwise(F.array(event("delta", first)))
    return rows.select("conv_id", "turn", "message", "role", F.posexplode(F.concat(start, rest)).alias("seq", "e")).select("conv_id", "turn", "message", "role", F.col("seq").cast("long").alias("seq"), "e.kind", "e.start", "e.stop", "e.text")


def formatted(events: DataFrame, trained_role: str = "assistant", block_turns: int = 64, part_chars: int = 16_384) -> DataFrame:
    """(conv_id, block, part, text, loss): conversations in the template, cut between turns into parts.

    A part ends at ``part_chars`` code points or at the end of its block of ``block_turns`` turns; parts in the order of block (null first) and part
    are the conversation. ``loss`` has the spans in the part, in code points, of texts of ``trained_role``.
    """

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []  # events of the message that is being read
        message: tuple | None = None  # conv_id, block, turn, message
        done: list[tuple] = []  # finished parts
        text: list[str] = []
        spans: list[dict] = []
        size = part = 0

        def cut() -> None:
            nonlocal text, spans, size, part
            if text:
                done.append((message[0], message[1], part, "".join(text), spans))
                text, spans, size, part = [], [], 0, part + 1

        def close() -> None:
            nonlocal held, size
            if message is not None:
                turn, a, b = rendered(held[0][0] or "", fold(e[1:] for e in held))
                if held[0][0] == trained_role:
                    spans.append({"start": size + a, "stop": size + b})
                text.append(turn)
                size += len(turn)
                held = []
                if size >= part_chars:
                    cut()

        def batch_of(rows: list[tuple]) -> pa.RecordBatch:
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())])))
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=["conv_id", "block", "part", "text", "loss"])

        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("conv_id", "block", "turn", "message", "role", "kind", "start", "stop", "text")]
            for row in zip(*columns, strict=True):
                if row[:4] != message:
                    close()
                    if message is None or row[:2] != message[:2]:
                        cut()
                        part = 0
                    message = row[:4]
                held.append(row[4:])
            yield batch_of(done)
            done = []
        close()
        cut()
        yield batch_of(done)

    names = [c.split()[0] for c in EVENTS.split(", ")]
    dealt = events.select(*names).withColumn("block", F.floor(F.col("turn") / block_turns).cast("long")).repartition("conv_id", "block")
    return dealt.sortWithinPartitions("conv_id", "block", "turn", "message", "seq").mapInArrow(task, FORMATTED)


def read_back(parts: DataFrame) -> DataFrame:
    """Counts and digests of each conversation, read from its parts alone: turns from the template, learned texts from the spans.

    A digest takes a conversation in order, so a conversation's parts meet in one task, which reads them as a stream and holds one part.
    """

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done: list[tuple] = []
        state: list | None = None  # conv_id, turns, their digest, learned code points, their digest, code points

        def close() -> None:
            if state is not None:
                done.append((state[0], state[1], state[2].hexdigest(), state[3], state[4].hexdigest(), state[5]))

        def batch_of(rows: list[tuple]) -> pa.RecordBatch:
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=[c.split()[0] for c in READ_BACK.split(", ")])

        for batch in batches:
            for conv_id, text, loss in zip(*[batch.column(c).to_pylist() for c in ("conv_id", "text", "loss")], strict=True):
                if state is None or state[0] != conv_id:
                    close()
                    state = [conv_id, 0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                for role, said in turns(text):
                    state[1] += 1
                    state[2].update(f"{role}\n{said}\n".encode())
                for span in loss:
                    learned = unescaped(text[span["start"] : span["stop"]])
                    state[3] += len(learned)
                    state[4].update(learned.encode())
                state[5] += len(text)
            yield batch_of(done)
            done = []
        close()
        yield batch_of(done)

    return parts.select("conv_id", "block", "part", "text", "loss").repartition("conv_id").sortWithinPartitions("conv_id", "block", "part").mapInArrow(task, READ_BACK)
