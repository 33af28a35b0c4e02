"""Decoders of request bodies and reply streams against stated items; odd bodies give nothing and raise nothing."""

from __future__ import annotations

import gzip
import json
import zlib

import pytest
from pyspark.sql import functions as F

from modlens.functions import protocol, requests
from modlens.plans import lifecycle
from modlens.sources import sinks
from modlens.sources.tables import Tables


def items(spark, name, *bodies):
    """For each body its items as (role, origin, message, parts), parts as texts with None for media; None if it can't be read."""
    texts = [b if b is None or isinstance(b, str) else json.dumps(b, ensure_ascii=False) for b in bodies]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, body string").select("i", requests.decode(name, F.col("body")).alias("d"))
    out = []
    for r in sorted(df.collect()):
        d = r["d"]
        out.append(None if d is None else [(x["role"], x["origin"], x["message"], [None if p["media"] else p["text"] for p in x["parts"]]) for x in d["items"]])
    return out


ODD = [None, "", "not json", "[]", "5", "null", '{"a":1', '{"a":1} {}', '{"a":1}{"a":1}', '{"a":1,"a":2}', '{"x":{"k":1,"k":1}}']


@pytest.mark.parametrize("name", ["chat_completions", "responses", "responses_websocket", "gemini", "openai_embeddings", "media"])
def test_odd_bodies(spark, name):
    assert items(spark, name, *ODD) == [None] * len(ODD)


def test_unknown_protocol():
    with pytest.raises(ValueError, match="no such protocol"):
        requests.decode("smtp", F.lit("{}"))


def test_messages(spark):
    blocks = [{"type": "text", "text": "a"}, {"type": "image"}, {"type": "tool_result"}, {"type": "thinking", "text": "t"}, "b", {"functionResponse": {}}, None, {"type": "document", "source": {"type": "text", "data": "d"}}, {"type": "document", "source": {"type": "url"}}, {"type": "new", "text": "n"}, {"type": "new", "file": 1}, {"type": "text"}]
    got = items(
        spark,
        "claude_messages",
        {"system": [{"type": "text", "text": "S"}, {"type": "text", "text": "T"}], "messages": [{"role": "user", "content": blocks}, {"role": "assistant", "content": None}, {"role": "developer", "content": {"text": "dev"}}, {"role": "function", "content": "f"}], "model": "m"},
        {"messages": [{"role": "assistant", "content": [{"type": "tool_use", "id": 1}]}, {"role": "user"}]},
        {"messages": []},
        *[{"messages": [m]} for m in ({"role": "robot", "content": "x"}, {"content": "x"}, {"role": 5, "content": "x"}, {"role": "user", "content": 5}, {"role": "user", "content": [5]}, {"role": "user", "content": [{"type": 5}]}, {"role": "tool", "content": [{"text": 5}]}, None, "x")],
        {"system": 5, "messages": []},
        {"messages": {"role": "user"}},
        {"messages": None},
        {"system": "only"},
    )
    assert got[0] == [
        ("instruction", "system", -1, ["S", "T"]),
        ("user", "message", 0, ["a", None]),
        ("tool", "", 0, []),
        ("user", "message", 0, ["b"]),
        ("tool", "", 0, []),
        ("user", "message", 0, ["d", None, "n", None]),
        ("assistant", "", 1, []),
        ("instruction", "developer", 2, ["dev"]),
        ("tool", "", 3, []),
    ]
    assert got[1:3] == [[("assistant", "", 0, [])], []] and got[3:] == [None] * 13


def test_responses(spark):
    entries = ["plain", {"type": "message", "role": "user", "content": [{"type": "input_text", "text": "x"}]}, {"role": "assistant", "content": "y"}, {"type": "function_call", "name": "f"}, {"type": "function_call_output", "output": "o"}, {"type": "reasoning"}, {"type": "item_reference"}, {"type": "unknown"}, {"content": "no role"}, {"type": "custom", "role": "user", "content": "kept"}, None]
    want = [
        ("instruction", "instructions", -1, ["I"]),
        ("user", "message", 0, ["plain"]),
        ("user", "message", 1, ["x"]),
        ("assistant", "", 2, ["y"]),
        ("assistant", "", 3, []),
        ("tool", "", 4, []),
        ("assistant", "", 5, []),
        ("user", "message", 8, ["no role"]),
        ("user", "message", 9, ["kept"]),
    ]
    own = {"instructions": "I", "input": entries, "previous_response_id": "p", "model": "m"}
    got = items(spark, "responses", own, {"type": "response.create", "response": own}, {"type": "response.create", **own}, {"type": "response.cancel", **own}, {"input": "hi"}, {"input": {"content": "one"}}, {"input": None}, {}, *[{"input": x} for x in (5, [5], [{"role": "robot"}], [{"type": 5}], [{"content": 5}])], {"type": "response.create", "input": None, "response": own}, {"type": "response.create", "response": 5})
    assert got[:3] == [want] * 3 and got[3] is None
    assert got[4:8] == [[("user", "message", 0, ["hi"])], [("user", "message", 0, ["one"])], [], []] and got[8:13] == [None] * 5 and got[13:] == [[], None]
    assert items(spark, "responses_websocket", own, {"type": "response.create", "response": own}) == [None, want]
    both = spark.createDataFrame([(json.dumps({"type": "response.create", "model": "outer", "previous_response_id": "o", "response": own}),)], "body string").select(requests.decode("responses", F.col("body")).alias("d")).first()["d"]
    assert (both["model"], both["previous"]) == ("m", "p")


def test_gemini(spark):
    deep = {"contents": {"parts": "bottom"}}
    for _ in range(12):
        deep = {"requests": [deep]}
    got = items(
        spark,
        "gemini",
        {"systemInstruction": {"parts": [{"text": "S"}]}, "contents": [{"parts": [{"text": "q"}, {"inlineData": {}}]}, {"role": "model", "parts": [{"functionCall": {}}]}, {"role": "user", "parts": [{"functionResponse": {}}]}]},
        {"contents": {"parts": [{"text": "one"}]}, "instances": [{"prompt": "p"}, {}, None], "requests": [{"contents": [{"parts": "a"}], "requests": [{"contents": [{"parts": "b"}], "system_instruction": {"parts": "T"}}]}, {"contents": [{"parts": "c"}]}]},
        deep,
        {},
        *[{"requests": x} for x in (5, [5], [None], [{"contents": 5}])],
        *[{"contents": x} for x in (5, [{"role": "robot"}], [{"role": 5}], ["x"])],
        *[{"instances": x} for x in (5, [{"prompt": 5}], ["x"])],
        {"systemInstruction": "text"},
        {"contents": None},
    )
    user = lambda i, *t: ("user", "message", i, list(t))
    assert got[0] == [("instruction", "system", -1, ["S"]), user(0, "q", None), ("assistant", "", 1, []), ("tool", "", 2, [])]
    assert got[1] == [("instruction", "system", -1, ["T"]), user(0, "one"), user(0, "p"), user(0, "a"), user(0, "b"), user(0, "c")]
    assert got[2:4] == [[user(0, "bottom")], []] and got[4:16] == [None] * 12 and got[16] == []


def test_embeddings_and_media(spark):
    assert items(spark, "openai_embeddings", {"input": "x"}, {"input": ["x", 5, [1], "y"]}, {"input": [1, 2]}, {"input": 5}, {"input": None}, {}) == [[("user", "message", 0, ["x"])], [("user", "message", 0, ["x", "y"])], [], [], [], []]
    deep = {"text": "bottom"}
    for _ in range(15):
        deep = {"q": [deep]}
    deeper = {"text": "too deep"}
    for _ in range(33):
        deeper = {"q": deeper}
    got = items(spark, "images", {"b": {"prompt": "p", "z": ["loose", {"Text-Prompt": "t"}]}, "a": {"input": "data:image/png;base64,x", "lyrics": "l"}, "prompt": {"query": "within"}}, deep, deeper, {"messages": [{"role": "user", "content": "chat"}], "prompt": "no"}, {"messages": 5}, {"size": 1})
    assert got == [[("user", "message", 0, ["l", "p", "t", "within"])], [("user", "message", 0, ["bottom"])], [], [("user", "message", 0, ["chat"])], None, []]


def test_long_texts(spark):
    body = {"messages": [{"role": "user", "content": [{"type": "text", "text": "x" * 2_000_000}, {"type": "text", "text": "é\U0001f600\n\"\\"}]}]}
    assert items(spark, "messages", body) == [[("user", "message", 0, ["x" * 2_000_000, "é\U0001f600\n\"\\"])]]


@pytest.mark.parametrize(
    ("events", "want"),
    [
        (['{"type":"response.output_text.delta","delta":"Hel"}', '{"type":"response.output_text.delta","delta":"lo"}', '{"type":"response.output_text.done","text":"late"}', '{"response":{"id":"x","output":[]}}'], ("Hello", None, None)),
        (['{"type":"response.output_text.done","text":"done"}', '{"response":{"id":"x"}}'], ("done", None, None)),
        (['{"type":"response.output_text.delta","delta":"no"}', '{"response":{"id":"x","output":[{"content":[{"text":"whole"},{"text":" "}]}]}}'], ("whole", None, None)),
        (['{"type":"response.refusal.delta","delta":"I "}', '{"type":"response.refusal.delta","delta":"won\'t"}', '{"type":"response.output_text.delta","delta":"x"}', '{"response":{"id":"x"}}'], (None, "I won't", None)),
        (['{"response":{"id":"a","output":[{"content":[{"refusal":"r"}]}]}}', '{"response":{"id":"b","output":5}}'], (None, None, None)),
        (['{"type":"response.output_text.delta","delta":"x"}'], (None, None, "no_final")),
        (['{"response":5}'], (None, None, "invalid_event")),
        (["{oops", '{"response":{}}'], (None, None, "invalid_event")),
        ([], (None, None, "no_final")),
    ],
)
def test_folded_streams(spark, events, want):
    body = "event: e\r\n" + "\r\n".join(f"data: {e}" for e in events) + "\r\n\r\ndata:\r\ndata: [DONE]\r\n: comment"
    got = spark.createDataFrame([(body,)], "body string").select(protocol.folded_stream(F.col("body")).alias("f")).first()["f"]
    assert (got["text"], got["refusal"], got["error"]) == want


def test_inflated_bodies():
    text = b"x" * 100_000
    assert sinks.inflate_body(gzip.compress(text), "gzip") == text == sinks.inflate_body(zlib.compress(text), "deflate")
    assert sinks.inflate_body(gzip.compress(b"a") + gzip.compress(b"b"), "gzip") == b"ab"
    assert sinks.inflate_body(gzip.compress(text)[:-20], "gzip") is None and sinks.inflate_body(b"junk", "deflate") is None
    most = b"\0" * sinks.MOST_BODY
    assert sinks.inflate_body(gzip.compress(most), "gzip") == most
    bomb = gzip.compress(b"\0" * (1 << 20)) * 2_000
    assert sinks.inflate_body(bomb, "gzip") is None and sinks.inflate_body(gzip.compress(most + b"\0"), "gzip") is None


def test_replay_in_blocks(spark):
    t = Tables(spark, "/root/testdata/sf0.001")
    want = sorted(tuple(r) for r in lifecycle.policy_replay(t).collect())
    assert sorted(tuple(r) for r in lifecycle.policy_replay(t, of_block=3).collect()) == want == sorted(tuple(r) for r in lifecycle.policy_replay(t, of_block=2, most=1).collect())
