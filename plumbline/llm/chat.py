"""Chat formatting: event-sourced reconstruction.

A log of events (conv_id, turn, seq, kind, role, text) is dealt out by conversation and
sorted by turn and sequence. One pass folds each turn's events: `message` opens a message,
`delta` appends to it, `edit` replaces its text, `regenerate` empties it for the deltas
that follow, `retract` takes it back. The fold holds one message at a time, so a long
conversation needs no more memory than a short one; its messages are rendered, read back
from the rendered output, and digested as they come.

Null text is empty, null role is an empty role. Rows that agree in turn and sequence are
taken in order of role and text, so ties and repeated rows give one defined result. A
delta, edit or regeneration of a turn that has no message opens one. Very long texts are
rendered whole. An empty table gives an empty result. Other columns than these play no part,
whatever their names. A conversation is one task's work, since its digest runs over its
messages in order; the task streams them and holds one at a time.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plumbline.llm.common import to_arrow

OPEN, CLOSE = "<|turn|>", "<|end|>"
LOSS_ROLE = "assistant"
#: First characters of the control strings of this and other public templates, and the escape itself.
CONTROL = re.compile(r"<(?=\||/?s>|<|/?SYS>)|\[(?=/?INST\])|\\")
ESCAPED = re.compile(r"\\(.)", re.S)
HEADER = re.compile(r"((?:[^\\\n]|\\.)*)\n", re.S)
EVENT_ORDER = ("conv_id", "turn", "seq", "kind", "role", "text")
DIGEST = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
MESSAGES = "conv_id long, position long, turn long, role string, formatted string, loss_start long, loss_end long"


def escape(text: str) -> str:
    r"""Put a backslash behind the first character of each control string and behind each backslash."""
    return CONTROL.sub(lambda m: m[0] + "\\", text)


def unescape(text: str) -> str:
    return ESCAPED.sub(r"\1", text)


def render(role: str, text: str) -> tuple[str, int, int]:
    """The formatted message, and where its text starts and ends in it."""
    head = OPEN + escape(role).replace("\n", "\\\n") + "\n"
    body = escape(text)
    return f"{head}{body}{CLOSE}\n", len(head), len(head) + len(body)


def read_back(formatted: str) -> Iterator[tuple[str, str]]:
    """Roles and texts of formatted messages."""
    at = 0
    while at < len(formatted):
        if not formatted.startswith(OPEN, at):
            raise ValueError("a message must start with its control string")
        head = HEADER.match(formatted, at + len(OPEN))
        end = formatted.index(CLOSE, head.end())
        yield unescape(head[1]), unescape(formatted[head.end() : end])
        at = end + len(CLOSE) + 1


def fold(events: Iterator[tuple]) -> Iterator[tuple]:
    """(conv_id, turn, role, text) of the final messages, from events in order."""
    key, current = None, None  # of the open message: role and pieces of text
    for conv, turn, kind, role, text in events:
        if current is not None and (key != (conv, turn) or kind == "message"):
            yield *key, current[0], "".join(current[1])
            current = None
        key = (conv, turn)
        if kind == "retract":
            current = None
        elif current is None:
            current = [role, [] if kind == "regenerate" else [text]]
        elif kind == "delta":
            current[1].append(text)
        elif kind == "edit":
            current[1] = [text]
        elif kind == "regenerate":
            current[1] = []
    if current is not None:
        yield *key, current[0], "".join(current[1])


def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*(batch.column(k).to_pylist() for k in range(5)), strict=True)


def messages(events: DataFrame) -> DataFrame:
    """One row per final message with its rendered form and the span under the loss mask."""
    arrow = to_arrow(events, MESSAGES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, size, last, position, offset = [], 0, object(), 0, 0
        for conv, turn, role, text in fold(rows(batches)):
            if conv != last:
                last, position, offset = conv, 0, 0
            formatted, start, end = render(role, text)
            spoken = role == LOSS_ROLE
            out.append((conv, position, turn, role, formatted, offset + start if spoken else None, offset + end if spoken else None))
            position, offset, size = position + 1, offset + len(formatted), size + len(formatted)
            if size > 1 << 20:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), arrow.types, strict=True)], schema=arrow)
                out, size = [], 0
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), arrow.types, strict=True)], schema=arrow)

    return dealt(events).mapInArrow(run, MESSAGES)


def dealt(events: DataFrame) -> DataFrame:
    """Events by conversation, in order; nulls replaced."""
    filled = events.select(
        "conv_id", "turn", "seq", F.coalesce("kind", F.lit("message")).alias("kind"),
        F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"),
    )
    return filled.repartition("conv_id").sortWithinPartitions(*EVENT_ORDER).select("conv_id", "turn", "kind", "role", "text")


def digest(events: DataFrame) -> DataFrame:
    """One row per conversation, read back from its formatted output."""
    arrow = to_arrow(events, DIGEST)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, state = [], None

        def close() -> None:
            out.append((state[0], state[1], state[2].hexdigest(), state[3], state[4].hexdigest(), state[5]))

        for conv, _, role, text in fold(rows(batches)):
            if state is None or state[0] != conv:
                if state is not None:
                    close()
                state = [conv, 0, hashlib.sha256(), 0, hashlib.sha256(), 0]
            formatted, start, end = render(role, text)
            for r, t in read_back(formatted):
                state[1] += 1
                state[2].update(f"{r}\n{t}\n".encode())
            if role == LOSS_ROLE:
                under = unescape(formatted[start:end])
                state[3] += len(under)
                state[4].update(under.encode())
            state[5] += len(formatted)
            if len(out) >= 10_000:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), arrow.types, strict=True)], schema=arrow)
                out.clear()
        if state is not None:
            close()
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), arrow.types, strict=True)], schema=arrow)

    return dealt(events).mapInArrow(run, DIGEST)


def as_events(conversations: DataFrame) -> DataFrame:
    """A table of whole messages (conv_id, turn, role, text) as a log."""
    return conversations.select("conv_id", "turn", F.lit(0).cast("long").alias("seq"), F.lit("message").alias("kind"), "role", "text")


def as_log(conversations: DataFrame) -> DataFrame:
    """The same messages as a log of how they came about: each is streamed in two deltas, or drafted and edited, or drafted, regenerated and streamed.

    Which of the three a turn takes is decided by its hash. Rows of one turn keep the order of role and text, one after another.
    """
    c = F.col
    known = conversations.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    placed = known.withColumn("_n", F.row_number().over(Window.partitionBy("conv_id", "turn").orderBy("role", "text")))
    half = F.floor(F.length("text") / 2).cast("int")
    first, rest = F.substring("text", F.lit(1), half), F.substring("text", half + 1, F.length("text"))
    draft = F.concat(F.lit("draft: "), first)
    step = lambda k, kind, text: F.struct(F.lit(k).alias("step"), F.lit(kind).alias("kind"), text.alias("said"))
    ways = [
        F.array(step(0, "message", first), step(1, "delta", rest)),
        F.array(step(0, "message", draft), step(1, "edit", c("text"))),
        F.array(step(0, "message", draft), step(1, "regenerate", F.lit("")), step(2, "delta", first), step(3, "delta", rest)),
    ]
    way = F.pmod(F.xxhash64("conv_id", "turn"), F.lit(len(ways)))
    events = placed.withColumn("_e", F.explode(F.when(way == 0, ways[0]).when(way == 1, ways[1]).otherwise(ways[2])))
    return events.select("conv_id", "turn", (c("_n") * 4 + c("_e.step")).cast("long").alias("seq"), "_e.kind", "role", c("_e.said").alias("text"))
