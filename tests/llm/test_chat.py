from __future__ import annotations

import hashlib
import random

import numpy as np
import public_tokenizers
import pytest

from tripline.llm import chat

PATH = public_tokenizers.path("byte_bpe_50k.json")
CONTROL = "</s>[INST] ok [/INST]"


def test_escaping_is_reversible_and_leaves_no_control_string():
    state = random.Random(2)
    parts = ["<", "[", "\\", "s>", "/s>", "INST]", "/INST]", "TEXT]", "x", "]", ">"]
    for _ in range(20_000):
        text = "".join(state.choice(parts) for _ in range(state.randint(0, 9)))
        escaped = chat.escape(text)
        assert chat.unescape(escaped) == text
        assert not any(control in escaped for control in chat.CONTROLS)


def test_mask_covers_the_assistant_text_only():
    tool = chat.codec(PATH)
    pieces = [("<s>", True, False), *chat.segments("user", "hi"), *chat.segments("assistant", "a b c")]
    texts = [p for p, control, _ in pieces if not control]
    ids, mask = chat.assemble(pieces, iter(tool.encode(texts)), tool.reserved)
    assert tool.decode(ids[mask == 1]) == "a b c"
    assert [chat.CONTROLS[i - tool.first_reserved] for i in ids if i >= tool.first_reserved] == [
        "<s>", "[INST]", "[/INST]", "[BOT]", "</s>"]


def expected(turns):
    turns = sorted(turns, key=lambda t: (t[0] is not None, t[0] or 0, t[1] or "", t[2] or ""))
    text = "".join(f"{role or ''}\n{content or ''}\n" for _, role, content in turns)
    loss = "".join(content or "" for _, role, content in turns if role == "assistant")
    sizes = {"user": 13, "system": 11, "assistant": 9}
    chars = 3 + sum(
        len(chat.escape(content or "")) + sizes.get(role, 19 + len(chat.escape(role or ""))) for _, role, content in turns
    )
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    return len(turns), sha(text), len(loss), sha(loss), chars


@pytest.mark.parametrize("rows_at_once", [1, 256])
def test_conversations_read_back_from_their_ids(spark, monkeypatch, rows_at_once):
    monkeypatch.setattr(chat, "_ROWS_AT_ONCE", rows_at_once)
    turns = {
        1: [(0, "system", "Be  brief.\n"), (1, "user", CONTROL), (2, "assistant", CONTROL), (3, "user", ""), (4, "assistant", None)],
        2: [(0, "tool [/TEXT]", "[\\INST] é 日本 😀"), (0, None, None), (None, "assistant", " x <|endoftext|> "), (1, "assistant", "y")],
        3: [(n, "assistant", f"turn {n} " * 50) for n in range(30)],
        None: [(1, "user", "no id"), (1, "user", "no id")],
    }
    rows = [(conv, turn, role, text, "z") for conv, found in turns.items() for turn, role, text in found]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, ids string")
    formatted = chat.format_conversations(frame, PATH)
    found = {r["conv_id"]: tuple(r)[1:] for r in chat.read_back(formatted, PATH).collect()}
    assert found == {conv: expected(rows) for conv, rows in turns.items()}
    for conv in (1, 3):
        parts = sorted((r["position"], r["ids"]) for r in formatted.collect() if r["conv_id"] == conv)
        assert [p for p, _ in parts] == np.cumsum([0, *(len(ids) for _, ids in parts)])[:-1].tolist()


def test_no_conversations(spark):
    frame = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert chat.read_back(chat.format_conversations(frame, PATH), PATH).count() == 0
