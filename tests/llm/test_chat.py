"""Folding, the template's round trip, and conversations against a straight reading of their rows."""

import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from gridloom.llm import chat

SCHEMA = "conv_id bigint, turn bigint, role string, text string"
PARTS = ["<", "[", "\\", "/s>", "s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<|turn|>", "<|end|>", "<|end|>\n", "|end|>", "<|im_start|>", "\n", " ", "é", "日本", "x", "\\n", "</", "<\\/s>", "|>"]


def odd_text(rng, n=9):
    return "".join(rng.choice(PARTS) for _ in range(rng.randint(0, n)))


def test_escaping_is_reversible_and_leaves_no_control_string():
    rng = random.Random(4)
    for _ in range(20_000):
        text = odd_text(rng)
        assert chat.unescaped(chat.escaped(text)) == text and chat.unescaped_role(chat.escaped_role(text)) == text
        assert not re.search(rf"[<\[](?:{chat.CONTROL})", chat.escaped(text)) and "\n" not in chat.escaped_role(text)
    assert chat.escaped("a < b [1] plain") == "a < b [1] plain"


def test_turns_read_back_what_was_rendered():
    rng = random.Random(5)
    for _ in range(2_000):
        said = [(odd_text(rng, 3), odd_text(rng)) for _ in range(rng.randint(0, 5))]
        assert list(chat.turns("".join(chat.rendered(*x)[0] for x in said))) == said
    with pytest.raises(ValueError):
        list(chat.turns("x<|turn|>a\nb<|end|>\n"))


def test_fold():
    assert chat.fold([("delta", None, None, "ab"), (None, None, None, "cd"), ("edit", 1, 3, "XYZ"), ("delta", None, None, "!")]) == "aXYZd!"
    assert chat.fold([("delta", None, None, "ab"), ("regenerate", None, None, None), ("delta", None, None, None), ("delta", None, None, "c")]) == "c"
    assert chat.fold([("edit", None, None, "new")]) == "new" and chat.fold([]) == "" and chat.fold([("delta", None, None, "abc"), ("edit", -5, 99, "x")]) == "x"
    assert chat.fold([("delta", None, None, "abc"), ("edit", 2, 1, "-")]) == "ab-c"
    with pytest.raises(ValueError, match="isn't"):
        chat.fold([("move", None, None, "x")])


def rows(seed=1):
    rng = random.Random(seed)
    out = [(c, t, rng.choice(["user", "assistant", "system"]), odd_text(rng, 40) * rng.choice([1, 30])) for c in range(12) for t in range(rng.randint(1, 9))]
    out += [(50, t, "assistant" if t % 2 else "user", f"turn {t} </s>") for t in range(700)]  # a conversation of many blocks
    out += [(60, 0, "user", "y" * 3_000_000 + "</s>"), (60, 1, "assistant", "é" * 50_000)]
    out += [(None, 1, "user", "no id"), (None, 2, "assistant", None), (70, None, "assistant", "first"), (70, 0, None, "then"), (71, 3, "user", ""), (71, 3, "user", ""), (71, 3, "assistant", "tie"), (71, 3, "assistant", "other tie")]
    return out


def straight(data):
    found = {}
    for conv, turn, role, text in data:
        found.setdefault(conv, []).append((turn is not None, turn or 0, hashlib.sha256(f"{role or ''}\0{text or ''}".encode()).hexdigest(), role or "", text or ""))
    out = {}
    for conv, said in found.items():
        said = [x[3:] for x in sorted(said)]
        learned = "".join(t for r, t in said if r == "assistant")
        sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
        out[conv] = (len(said), sha("".join(f"{r}\n{t}\n" for r, t in said)), len(learned), sha(learned), sum(len(chat.rendered(r, t)[0]) for r, t in said))
    return out


def test_conversations_equal_a_straight_reading(spark):
    data = rows()
    table = spark.createDataFrame(data, SCHEMA).withColumns({c: F.lit("clash") for c in ("seq", "message", "kind", "part", "block", "loss")}).repartition(5)
    events = chat.logged(table)
    assert {r["kind"] for r in events.select("kind").distinct().collect()} == {"delta", "edit", "regenerate"}
    parts = chat.formatted(events.orderBy(F.rand(3)), part_chars=2_000)
    got = {r["conv_id"]: tuple(r)[1:] for r in chat.read_back(parts).collect()}
    assert got == straight(data)
    assert parts.where("conv_id = 50").count() > 10


def test_empty_log(spark):
    assert chat.read_back(chat.formatted(chat.logged(spark.createDataFrame([], SCHEMA)))).count() == 0
