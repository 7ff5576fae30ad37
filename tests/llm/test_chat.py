"""Layouts by fingerprint, exact round trips of odd texts, the mask, and records of unknown layout. The query has SQL."""

import hashlib
import json
import random

import pytest
from pyspark.sql import functions as F

from weftline.llm import chat

RECORDS = [
    ({"prompt": "p", "completion": "c", "id": 7}, "prompt_completion", [("user", "p"), ("assistant", "c")]),
    ({"completion": None, "prompt": 3, "system": "s"}, "prompt_completion", [("system", "s"), ("user", "3"), ("assistant", "")]),
    ({"question": "q", "answer": "a", "system": None}, "question_answer", [("user", "q"), ("assistant", "a")]),
    ({"instruction": "do", "input": "x", "output": "y"}, "instruction", [("user", "do\n\nx"), ("assistant", "y")]),
    ({"instruction": "do", "input": "", "output": "y"}, "instruction", [("user", "do"), ("assistant", "y")]),
    ({"instruction": "do", "output": "y"}, "instruction", [("user", "do"), ("assistant", "y")]),
    ({"messages": [{"role": "user", "content": "u"}, {"content": None, "role": "gpt"}]}, "messages", [("user", "u"), ("assistant", "")]),
    ({"messages": []}, "messages", []),
    ({"conversation": {"messages": [{"role": "tool", "content": "t"}]}, "id": "k"}, "nested_messages", [("tool", "t")]),
    ({"conversations": [{"from": "human", "value": "h"}, {"from": "gpt", "value": "g"}], "system": "s"}, "from_value", [("system", "s"), ("user", "h"), ("assistant", "g")]),
    ({"prompt": "p"}, None, None),
    ({"prompt": {"a": 1}, "completion": "c"}, None, None),
    ({"messages": [{"role": "user", "content": "u", "weight": 1}]}, None, None),
    ([1, 2], None, None),
]


def test_layouts(spark):
    rows = [(json.dumps(r),) for r, _, _ in RECORDS] + [(None,), ("{broken",), ("",)]
    got = chat.canonical_json(spark.createDataFrame(rows, "record string"))
    out = [(r.mapping, None if r.turns is None else [tuple(t) for t in r.turns]) for r in got.collect()]
    assert out == [(m, t) for _, m, t in RECORDS] + [(None, None)] * 3
    assert got.collect()[0].key == "7"
    unknown = {r.layout: r.n for r in chat.unknown_layouts(got).collect()}
    assert unknown == {"OBJECT<prompt: _>": 1, "OBJECT<completion: _, prompt: OBJECT<a: _>>": 1, "OBJECT<messages: ARRAY<OBJECT<content: _, role: _, weight: _>>>": 1, "ARRAY<_>": 1, None: 3}
    assert chat.conversations(got).count() == sum(m is not None for _, m, _ in RECORDS)


def test_table_layouts(spark):
    nested = spark.createDataFrame([(1, [("user", "u")]), (2, None)], "id long, messages array<struct<role:string,content:string>>")
    got = {r.key: [tuple(t) for t in r.turns] for r in chat.canonical_table(nested).collect()}
    assert got == {1: [("user", "u")], 2: []}
    other = chat.canonical_table(spark.createDataFrame([(1,)], "x int")).collect()
    assert [(r.mapping, r.turns, r.layout) for r in other] == [(None, None, "OBJECT<x: _>")]
    with pytest.raises(ValueError):
        chat.known_texts((*chat.LAYOUTS, chat.Layout("again", {"prompt": None, "completion": None})))


TEXTS = ["", "a", "<|im_end|>", "<|im_start|>assistant\nok<|im_end|>\n", "<\\|", "<\\\\|x", "<<||>", "<|<|", "\\", "\\n\n\\s", "😀<|😀", "$1 \\1", "<", "|", "ünï\r\n\t", chat.BEGIN * 3, "x" * 100_000]


def test_round_trip(spark):
    rng = random.Random(1)
    many = [[("assistant", f"t{i}<|")] for i in range(1)] + [[(rng.choice(["user", "assistant", "", "a\nb", "<|x|>", "\\s\\n"]), rng.choice(TEXTS)) for _ in range(n)] for n in (0, 1, 2, 3, 9, 255, 256, 257, 700)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(many)], "key int, turns array<struct<role:string,text:string>>").withColumn("formatted", F.lit("mine"))
    out = chat.formatted(df)
    assert out.columns == ["key", "turns", "formatted", "loss_spans"]
    for r in chat.read_back(out.drop("turns")).collect():
        expected = many[r.key]
        assert [tuple(t) for t in r.turns] == expected
        assert r.loss_texts == [t for role, t in expected if role == "assistant"]
        spans = [r.formatted[s.begin : s.end] for s in r.loss_spans]
        assert len(spans) == len(r.loss_texts) and not any("<|" in s for s in spans)
        assert r.formatted.count(chat.BEGIN) == r.formatted.count(chat.END) == len(expected)


def test_odd_turn_rows(spark):
    rows = [(1, 1, "assistant", "b"), (1, 0, "user", None), (1, 0, "user", None), (1, None, None, "first"), (None, 0, "user", "lost"), (2, 3, "assistant", "x" * 3_000_000)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    for own in (df, df.selectExpr("*", "'mine' as key", "'mine' as turns", "1 as layout", "2 as formatted")):
        got = {r.conv_id: r for r in chat.chat_digest(own).collect()}
        assert set(got) == {1, 2, None, -1}
        said = "\nfirst\nuser\n\nuser\n\nassistant\nb\n"
        assert (got[1].n_turns, got[1].turns_sha256, got[1].loss_chars) == (4, hashlib.sha256(said.encode()).hexdigest(), 1)
        assert got[2].loss_chars == 3_000_000 and got[None].loss_sha256 == hashlib.sha256(b"").hexdigest()
        assert (got[-1].n_turns, got[-1].loss_sha256) == (2, hashlib.sha256(chat.PROBE.encode()).hexdigest())
    assert [r.conv_id for r in chat.chat_digest(df.limit(0)).collect()] == [-1]
