"""Chat formatting from event logs.

A log has one row per event of a message: its start, streamed deltas, an edit that replaces the
text so far, a regeneration that drops it. Events are partitioned by conversation and message,
sorted by sequence and folded as they come; a message is rendered on its own, so a long
conversation is spread over tasks, and the formatted conversation is its rendered messages in
order. Control strings inside roles and texts are broken up reversibly.

Cases: a null text or role is empty; a message without events after its start has an empty text;
events of the same sequence number are taken by kind, then text; a null conversation is a
conversation, a null message number comes first; rows of `conversations` with the same turn are
separate turns, by role and text.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from faregrid.llm import common

TURN, END = "<|turn|>", "<|end|>"
LEARNED = "assistant"
#: This template's marks and those of other common templates.
CONTROL = (TURN, END, "<|im_start|>", "<|im_end|>", "<|endoftext|>", "<|startoftext|>", "<s>", "</s>",
           "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")
CHUNK = 200


# Logs

def conversation_events(rows: DataFrame) -> DataFrame:
    """An event log that leads to the given messages (conv_id, turn, role, text): what users and
    systems wrote is a draft that was edited, what assistants wrote was generated anew once."""
    text = F.coalesce("text", F.lit(""))
    chunks = F.regexp_extract_all(text, F.lit(rf"(?s).{{1,{CHUNK}}}"), F.lit(0))

    def event(kind: str, content: Column) -> Column:
        return F.struct(F.lit(kind).alias("kind"), content.alias("text"))
    draft = F.array(event("start", F.coalesce("role", F.lit(""))),
                    event("delta", F.substring(text, 1, CHUNK)))
    again = F.array(F.when(F.col("role") == LEARNED, event("regenerate", F.lit("")))
                    .otherwise(event("edit", F.coalesce(F.get(chunks, F.lit(0)), F.lit("")))))
    rest = F.when(F.col("role") == LEARNED, chunks).otherwise(
        F.slice(chunks, F.lit(2), F.greatest(F.size(chunks) - 1, F.lit(0))))
    events = F.concat(draft, again, F.transform(rest, lambda c: event("delta", c)))
    same = Window.partitionBy("conv_id", "turn").orderBy("role", "text")
    numbered = rows.withColumn("part", F.row_number().over(same))
    return numbered.select("conv_id", "turn", "part", F.posexplode(events).alias("seq", "e")).select(
        "conv_id", F.struct("turn", "part").alias("message"), "seq", "e.kind", "e.text")


# Folding

def fold(events: DataFrame) -> DataFrame:
    """(conv_id, message, role, text): the messages that the events end in."""
    kind = events.schema["message"].dataType.simpleString()
    n = int(events.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = events.select("conv_id", "message", "seq", "kind", "text").repartition(n, "conv_id", "message").sortWithinPartitions(
        "conv_id", "message", "seq", "kind", "text")

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, role, parts = None, "", []  # one message is open at a time
        for batch in batches:
            done, kinds, texts = [], batch.column(3).to_pylist(), batch.column(4).to_pylist()
            for key, what, text in zip(zip(batch.column(0).to_pylist(), map(_frozen, batch.column(1).to_pylist())), kinds, texts):
                if key != at:
                    if at is not None:
                        done.append((*at, role, "".join(parts)))
                    at, role, parts = key, "", []
                if what == "start":
                    role = text or ""
                elif what == "delta":
                    parts.append(text or "")
                elif what in ("edit", "regenerate"):
                    parts = [text or ""] if what == "edit" else []
            if done:
                yield _rows(done, batch.schema)
        if at is not None:
            yield _rows([(*at, role, "".join(parts))], batch.schema)

    return common.map_arrow(ordered, step, f"conv_id long, message {kind}, role string, text string")


def _frozen(value):
    return tuple(value.items()) if isinstance(value, dict) else value


def _rows(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    conv, message, role, text = zip(*rows)
    message = [dict(m) if isinstance(m, tuple) else m for m in message]
    return pa.RecordBatch.from_arrays(
        [pa.array(conv, pa.int64()), pa.array(message, schema.field(1).type),
         pa.array(role, pa.string()), pa.array(text, pa.string())], names=["conv_id", "message", "role", "text"])


# Rendering

def escape(text: Column) -> Column:
    """Doubles backslashes and puts a backslash and a point behind a control string's first letter."""
    out = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    for control in CONTROL:
        out = F.replace(out, F.lit(control), F.lit(f"{control[0]}\\.{control[1:]}"))
    return out


def unescape(text: str) -> str:
    return re.sub(r"\\([\\.n])", lambda m: {"\\": "\\", ".": "", "n": "\n"}[m[1]], text)


def render(messages: DataFrame) -> DataFrame:
    """`messages` with `formatted` and, for an assistant's, the loss mask: code points
    `loss_begin` to `loss_end` of `formatted`, its text."""
    head = F.concat(F.lit(TURN), F.replace(escape(F.col("role")), F.lit("\n"), F.lit("\\n")), F.lit("\n"))
    learned = F.col("role") == LEARNED
    return messages.withColumn("head", head).withColumn("body", escape(F.col("text"))).select(
        "conv_id", "message", "role", "text", F.concat("head", "body", F.lit(END + "\n")).alias("formatted"),
        F.when(learned, F.length("head")).alias("loss_begin"),
        F.when(learned, F.length("head") + F.length("body")).alias("loss_end"))


# Reading back

def read_back(rendered: DataFrame) -> DataFrame:
    """One row per conversation, from the formatted messages and their loss masks alone.

    A digest needs a conversation's messages in a row, so they meet in one task; it holds one
    message at a time.
    """
    n = int(rendered.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = rendered.select("conv_id", "message", "formatted", "loss_begin", "loss_end").repartition(
        n, "conv_id").sortWithinPartitions("conv_id", "message", "formatted")
    schema = ("conv_id long, n_turns long, turns_sha256 string, loss_chars long, "
              "loss_sha256 string, formatted_chars long")

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, state = None, None

        def row() -> tuple:
            turns, learned, n_turns, loss_chars, chars = state
            return at[0], n_turns, turns.hexdigest(), loss_chars, learned.hexdigest(), chars
        for batch in batches:
            done = []
            for conv, piece, begin, end in zip(*(batch.column(k).to_pylist() for k in (0, 2, 3, 4))):
                if at != (conv,):
                    if at is not None:
                        done.append(row())
                    at, state = (conv,), [hashlib.sha256(), hashlib.sha256(), 0, 0, 0]
                role, text = piece[len(TURN):-len(END) - 1].split("\n", 1)
                state[0].update(f"{unescape(role)}\n{unescape(text)}\n".encode())
                state[2] += 1
                state[4] += len(piece)
                if begin is not None:
                    learned = unescape(piece[begin:end])
                    state[1].update(learned.encode())
                    state[3] += len(learned)
            if done:
                yield _summary(done)
        if at is not None:
            yield _summary([row()])

    return common.map_arrow(ordered, step, schema)


def _summary(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
    return pa.RecordBatch.from_arrays(
        [pa.array(c, t) for c, t in zip(zip(*rows), kinds)],
        names=["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])
