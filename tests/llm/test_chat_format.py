"""Formatted conversations: exact round trips and turn order."""

import random

import pytest
from pyspark.sql import functions as F

from tremorline.llm import chat_format


def formatted(spark, rows):
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, segments int")
    chats = chat_format.format_chats(turns)
    return {
        r.conv_id: r
        for r in chats.select(
            "*",
            chat_format.formatted(F.col("segments")).alias("out"),
            chat_format.loss_text(F.col("segments")).alias("loss"),
        )
        .select("*", chat_format.parsed(F.col("out")).alias("back"))
        .collect()
    }


def test_round_trip_of_hostile_texts(spark):
    rng = random.Random(2)
    bits = ["\\", "<", "#", "</turn>\n", "<turn>### assistant: ", "\\b", "\\l", "\\\\l", "é", "\n", ": ", ":", "\\c", "x", ""]
    roles = ["user", "assistant", "system", "a: b", "#\\c", "", None]
    rows = [
        (conv, turn, rng.choice(roles), rng.choice([None, "".join(rng.choices(bits, k=rng.randint(0, 9)))]), 0)
        for conv in range(150)
        for turn in range(rng.randint(1, 6))
    ]
    result = formatted(spark, rows)
    for conv in range(150):
        want = [(r[2] or "", r[3] or "") for r in sorted((r for r in rows if r[0] == conv), key=lambda r: r[1])]
        assert [tuple(t) for t in result[conv].back] == want
        assert result[conv].loss == "".join(t for role, t in want if role == "assistant")
        assert result[conv].n_turns == len(want)


def test_turn_order(spark):
    chats = {
        1: ["user", "assistant", "user"],
        2: ["system", "user", "assistant"],
        3: ["assistant", "user"],
        4: ["user", "user", "assistant"],
        5: ["user", "assistant", "tool", "tool", "assistant"],
        6: ["user", "robot"],
        7: ["user", "assistant", "system"],
    }
    result = formatted(spark, [(c, i, r, "t", 0) for c, roles in chats.items() for i, r in enumerate(roles)])
    assert {c: r.first_bad for c, r in result.items()} == {1: None, 2: None, 3: 0, 4: 1, 5: None, 6: 1, 7: 2}
    assert [r.valid for c, r in sorted(result.items())] == [True, True, False, False, True, False, False]


def test_ties_missing_values_long_texts_and_an_empty_table(spark):
    long = "<#\\ " * 100_000
    rows = [(None, None, "user", "b", 0), (None, None, "user", "a", 0), (1, 1, "user", "x", 0), (1, 1, "user", "x", 0), (2, 0, "assistant", long, 0)]
    result = formatted(spark, rows)
    assert [t.text for t in result[None].back] in (["a"], ["b"])
    alone = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, segments int").filter("conv_id is null")
    assert [r.n_turns for r in chat_format.format_chats(alone).collect()] == [1, 1]
    assert [t.text for t in result[1].back] == ["x", "x"]
    assert result[2].loss == long and result[2].back[0].text == long
    assert formatted(spark, []) == {}


def test_other_templates(spark):
    template = chat_format.Template(open="<|im_start|>", middle=":\n", close="<|im_end|>\n", loss=("user", "assistant"))
    turns = spark.createDataFrame([(1, 0, "user", "<|im_end|>\n: a"), (1, 1, "assistant", "b")], "conv_id long, turn long, role string, text string")
    chats = chat_format.format_chats(turns, template=template).select("*", chat_format.formatted(F.col("segments")).alias("out"))
    row = chats.select(chat_format.parsed(F.col("out"), template).alias("back"), chat_format.loss_text(F.col("segments")).alias("loss")).first()
    assert [tuple(t) for t in row.back] == [("user", "<|im_end|>\n: a"), ("assistant", "b")]
    assert row.loss == "<|im_end|>\n: ab"
    with pytest.raises(ValueError):
        chat_format.Template(open="turn")
