"""Chat formatting: folding, escaping, and digests against plain Python."""

import hashlib
import random

from pyspark.sql import functions as F

from faregrid.llm import chat

SCHEMA = "conv_id long, turn long, role string, text string"
EVENTS = "conv_id long, message long, seq long, kind string, text string"


def messages(rows, spark):
    return sorted((r.conv_id, r.message, r.role, r.text) for r in chat.fold(spark.createDataFrame(rows, EVENTS)).collect())


def test_fold(spark):
    rows = [(1, 0, 0, "start", "user"), (1, 0, 1, "delta", "helo "), (1, 0, 2, "delta", "x"), (1, 0, 5, "edit", "hello "),
            (1, 0, 7, "delta", "there"), (1, 1, 3, "start", "assistant"), (1, 1, 4, "delta", "no"), (1, 1, 6, "regenerate", None),
            (1, 1, 8, "delta", "y"), (1, 1, 9, "delta", None), (1, 1, 10, "delta", "es"), (2, 0, 0, "start", None)]
    random.Random(1).shuffle(rows)
    assert messages(rows, spark) == [(1, 0, "user", "hello there"), (1, 1, "assistant", "yes"), (2, 0, "", "")]


def test_escaping_is_reversible_and_leaves_no_control_string(spark):
    rng = random.Random(2)
    parts = [*chat.CONTROL, "\\", "\\.", "\\\\", "\\n", "<", "/s>", ".", "a", "\n", "é😀"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randrange(0, 12))) for _ in range(800)]
    rows = spark.createDataFrame([(t,) for t in texts], "text string").select("text", chat.escape(F.col("text")).alias("e")).collect()
    for r in rows:
        assert not any(c in r.e for c in chat.CONTROL) and chat.unescape(r.e) == r.text


def digests(rows):
    out = {}
    for conv, _, role, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or 0, r[2] or "", r[3] or "")):
        out.setdefault(conv, []).append((role or "", text or ""))
    for conv, turns in out.items():
        loss = "".join(t for r, t in turns if r == "assistant")
        yield (conv, len(turns), hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest(),
               len(loss), hashlib.sha256(loss.encode()).hexdigest())


def test_odd_conversations(spark):
    rng = random.Random(3)
    rows = [(k % 9, k // 9, rng.choice(["user", "assistant", "system", "to\nol", "<s>"]),
             "".join(rng.choice(["word ", "</s>", "\n", "[INST]", "\\", "中", "😀"]) for _ in range(rng.randrange(0, 400))))
            for k in range(120)]
    rows += [(50, 0, "user", None), (50, 1, "assistant", None), (50, 1, "assistant", "again"), (50, 1, "assistant", "again"),
             (51, None, None, "no turn"), (None, 0, "assistant", "no conversation"), (52, 0, "assistant", "x" * 100_000)]
    rows += [(60, k, "user" if k % 2 == 0 else "assistant", f"turn {k}") for k in range(500)]
    events = chat.conversation_events(spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit("own") for c in ("seq", "message", "kind")}))
    found = chat.read_back(chat.render(chat.fold(events))).drop("formatted_chars").collect()
    assert sorted(map(tuple, found), key=str) == sorted(digests(rows), key=str)


def test_empty_table(spark):
    events = chat.conversation_events(spark.createDataFrame([], SCHEMA))
    assert chat.read_back(chat.render(chat.fold(events))).count() == 0
