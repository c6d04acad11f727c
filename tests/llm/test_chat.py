"""Chat formatting against a plain Python formatter, and its edge cases."""

import random

import pytest
from pyspark.sql import functions as F

from ensemblar.llm import chat

SCHEMA = "conv_id long, turn long, role string, text string, segments string, id string"


def frame(spark, rows):
    # names that the operator uses itself
    return spark.createDataFrame([(*r, "x", "y") for r in rows], SCHEMA)


def plain_escape(text):
    text = text.replace("\\", "\\\\")
    for c in chat.DEFAULT.controls:
        text = text.replace(c, c[0] + "\\" + c[1:])
    return text


def test_escape_round_trip(spark):
    rng = random.Random(1)
    pieces = [*chat.DEFAULT.controls, *(f" {c} " for c in chat.DEFAULT.controls), "[", "<", "\\", "INST]", "/s>", "\n", "ü", "🙂", "a"]
    texts = ["".join(rng.choices(pieces, k=rng.randrange(12))) for _ in range(400)] + ["", "\\", "[\\INST]", "<</s>", "[[INST]"]
    df = spark.createDataFrame([(t,) for t in texts], "text string").select("text", chat.escape(F.col("text"), chat.DEFAULT).alias("e"))
    for r in df.select("text", "e", chat.unescape(F.col("e")).alias("u")).collect():
        assert r.u == r.text and r.e == plain_escape(r.text) and not any(c in r.e for c in chat.DEFAULT.controls)


def test_conversations_read_back(spark):
    rng = random.Random(2)
    pieces = [*chat.DEFAULT.controls, " [/INST]", " </s>", "\\", "word ", "\n", "漢"]
    roles = ["system", "user", "assistant", "tool", "[ROLE] ", " [TEXT] ", "", None]
    rows = [(k, t, rng.choice(roles), rng.choice([None, "", "".join(rng.choices(pieces, k=6))])) for k in range(60) for t in range(rng.randrange(1, 9))]
    rows += [(100, t, "user" if t % 2 == 0 else "assistant", f"turn {t}") for t in range(700)]
    rng.shuffle(rows)
    got = chat.format_conversations(frame(spark, rows))
    got = got.select("*", chat.formatted(F.col("segments")).alias("whole"), chat.learnt(F.col("segments")).alias("learnt"))
    got = {r.conv_id: r for r in got.withColumn("read", chat.read_back(F.col("whole"))).collect()}
    assert set(got) == {r[0] for r in rows}
    for k, r in got.items():
        turns = sorted((x[1:] for x in rows if x[0] == k), key=lambda x: x[0])
        assert [(t.role, t.text) for t in r["read"]] == [(role or "", text or "") for _, role, text in turns]
        assert r.learnt == "".join(text or "" for _, role, text in turns if role == "assistant")
        state, bad = "start", None
        for t, role, _ in turns:
            if role not in chat.DEFAULT.follows.get(state, ()):
                bad = t
                break
            state = role
        assert r.valid == (bad is None) and r.first_bad_turn == bad and r.complete == (bad is None and state == "assistant")


def test_ties_nulls_and_lengths(spark):
    rows = [(1, 0, "user", "b"), (1, 0, "user", "a"), (1, 0, "user", "a"), (None, None, "assistant", "x" * 300_000), (None, 3, "user", None)]
    got = {r.conv_id: r for r in chat.format_conversations(frame(spark, rows)).withColumn("read", chat.read_back(chat.formatted(F.col("segments")))).collect()}
    assert [t.text for t in got[1]["read"]] == ["a", "a", "b"] and got[1].first_bad_turn == 0 and not got[1].valid
    assert [len(t.text) for t in got[None]["read"]] == [300_000, 0] and not got[None].valid and got[None].first_bad_turn is None
    assert chat.format_conversations(frame(spark, rows).limit(0)).count() == 0


def test_blocks_do_not_show(spark):
    rng = random.Random(3)
    rows = [(k, t, rng.choices(["user", "assistant"], [9, 8])[0] if rng.random() < 0.01 else ("user", "assistant")[t % 2], "") for k in range(20) for t in range(rng.randrange(1, 200))]
    one, many = (sorted(chat.turn_order(frame(spark, rows), block=b).collect()) for b in (1000, 3))
    assert one == many and {r.valid for r in one} == {True, False}


def test_own_template_and_bad_ones(spark):
    roles = {"q": chat.Role("<q>", "</q>"), "a": chat.Role("<a>", "</a>", True)}
    own = chat.Template(roles, {chat.START: ("q",), "q": ("a",)}, ("a",), begin="{begin}", other=("<o>", "<t>", "</o>"))
    rows = [(1, 0, "q", "<a>?"), (1, 1, "a", "{begin}")]
    r = chat.format_conversations(frame(spark, rows), own).select(chat.formatted(F.col("segments")).alias("w"), "valid", "complete").first()
    assert r.w == "{begin}<q><\\a>?</q><a>{\\begin}</a>" and r.valid and r.complete
    for mark in ("aa", "[", "[IN\\ST]", "[INST] x"):
        with pytest.raises(ValueError):
            chat.Template({"user": chat.Role("[INST]", "[/INST]"), "x": chat.Role(mark, "</s>")}, {chat.START: ("user",)}, ("user",))
