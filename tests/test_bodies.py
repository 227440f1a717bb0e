"""Bodies of three wires: results out and back, cache marks, injection, texts, events."""

import json

import pytest
from pyspark.sql import functions as F

from stratalens.operators import bodies as B


def run(spark, body, f):
    v = f(B.body(F.col("t")))
    out = spark.createDataFrame([(json.dumps(body),)], "t string").select(v.alias("x"))
    return out.select(F.to_json("x").alias("x")) if "variant" in dict(out.dtypes)["x"] and not dict(out.dtypes)["x"].startswith(("array", "map", "struct")) else out


def one(spark, body, f):
    x = run(spark, body, f).first()["x"]
    return json.loads(x) if isinstance(x, str) and x[:1] in '{["' else x


def results(spark, body, wire):
    return [tuple(r) for r in run(spark, body, lambda b: B.tool_results(b, wire)).first()["x"]]


def replaced(spark, body, wire, new):
    m = F.create_map(*(F.lit(x) for kv in new.items() for x in kv)) if new else F.create_map().cast("map<string,string>")
    return one(spark, body, lambda b: B.with_results(b, wire, m))


IMAGE = {"type": "image", "source": {"data": "x", "n": 1.5}}
REQUEST = {"model": "m", "n": 3, "messages": [
    {"role": "user", "content": "hi"},
    {"role": "assistant", "content": [{"type": "tool_use", "id": "t1", "name": "Read", "input": {"b": 1, "a": "x"}}]},
    {"role": "user", "content": [
        {"type": "tool_result", "tool_use_id": "t1", "is_error": False, "content": [IMAGE, {"type": "text", "text": "one ", "citations": [1], "cache_control": {"type": "old"}}, {"type": "text", "text": "two", "cache_control": {"type": "last"}}, {"type": "text", "text": "!"}]},
        {"type": "text", "text": "and"}, {"type": "tool_result", "tool_use_id": "t2", "content": "plain"}, {"type": "tool_result", "tool_use_id": "t3", "content": [IMAGE]}, {"type": "tool_result"}, "odd"]},
    {"role": "assistant", "content": [{"type": "tool_result", "tool_use_id": "no", "content": "x"}]}]}


def test_results_of_messages(spark):
    assert results(spark, REQUEST, "messages") == [("2/0", "t1", "one two!"), ("2/2", "t2", "plain"), ("2/3", "t3", ""), ("2/4", "", "")]


def test_setting_a_result_keeps_the_rest(spark):
    out = replaced(spark, REQUEST, "messages", {"2/0": "new", "2/3": "text"})
    want = json.loads(json.dumps(REQUEST))
    want["messages"][2]["content"][0]["content"] = [{"type": "text", "text": "new", "citations": [1], "cache_control": {"type": "last"}}, IMAGE]
    want["messages"][2]["content"][3]["content"] = [{"type": "text", "text": "text"}, IMAGE]
    assert out == want
    assert replaced(spark, REQUEST, "messages", {"2/2": "s", "2/4": "t"})["messages"][2]["content"][2:5:2] == [{"type": "tool_result", "tool_use_id": "t2", "content": "s"}, {"type": "tool_result", "content": "t"}]
    assert replaced(spark, REQUEST, "messages", {}) == REQUEST and replaced(spark, {"a": [1]}, "messages", {"0/0": "x"}) == {"a": [1]}
    gone = {"messages": [{"role": "user", "content": [{"type": "tool_result", "content": [{"type": "text", "text": "x", "cache_control": None}]}]}]}
    assert replaced(spark, gone, "messages", {"0/0": "y"})["messages"][0]["content"][0]["content"] == [{"type": "text", "text": "y"}]


def test_results_of_the_other_wires(spark):
    chat = {"messages": [{"role": "system", "content": "s"}, {"role": "tool", "tool_call_id": "c1", "content": "r", "name": "n"}, {"role": "tool", "content": [1]}], "k": None}
    assert results(spark, chat, "chat") == [("1", "c1", "r"), ("2", "", "")]
    assert replaced(spark, chat, "chat", {"1": "q"}) == {"messages": [chat["messages"][0], {"role": "tool", "tool_call_id": "c1", "content": "q", "name": "n"}, chat["messages"][2]], "k": None}
    items = {"input": [{"type": "reasoning", "id": "rs"}, {"type": "function_call_output", "call_id": "c", "output": "o", "status": "done"}], "instructions": "i"}
    assert results(spark, items, "responses") == [("1", "c", "o")]
    assert replaced(spark, items, "responses", {"1": "p"})["input"] == [items["input"][0], {"type": "function_call_output", "call_id": "c", "output": "p", "status": "done"}]
    assert results(spark, {"input": "text"}, "responses") == [] and results(spark, [1], "chat") == []


def test_summarised_paths(spark):
    mark = "⟪summary:{}⟫ x"
    a = {"messages": [{"role": "user", "content": [{"type": "tool_result", "content": [{"type": "text", "text": mark.format("/a")}]}, {"type": "tool_result", "content": mark.format("/b")}]}, {"role": "user", "content": mark.format("/c")}, {"role": "user", "content": [{"type": "text", "text": mark.format("/no")}]}]}
    assert run(spark, a, lambda b: B.summarised_paths(b, "messages")).first()["x"] == ["/a", "/b", "/c"]
    b = {"input": [{"type": "function_call_output", "call_id": "c", "output": mark.format("/d")}, {"role": "user", "content": mark.format("/e")}]}
    assert run(spark, b, lambda x: B.summarised_paths(x, "responses")).first()["x"] == ["/d", "/e"]


def nested(levels, leaf):
    """An object `levels` levels down, through objects and arrays in turn."""
    x = leaf
    for k in range(levels):
        x = [x] if k % 2 else {"k": x}
    return x


@pytest.mark.parametrize("depth,found", [(0, True), (1, True), (39, True), (40, True), (41, False), (60, False)])
def test_a_mark_counts_to_depth_40(spark, depth, found):
    body = {"messages": nested(depth, {"cache_control": {"type": "x"}}), "system": "s", "tools": [{"name": "t"}]}
    assert one(spark, body["messages"], B.has_mark) is found
    out = one(spark, body, lambda b: B.with_marks(b, "messages"))
    assert (out == body) is found and ("cache_control" in out["tools"][-1]) is not found


def test_what_only_looks_like_a_mark(spark):
    for x in ({"text": '"cache_control":'}, ["cache_control"], {"a": "cache_control"}, {"a": '\\"cache_control": {'}, "cache_control", {"x_cache_control": 1}, None, 5):
        assert one(spark, x, B.has_mark) is False, x
    assert one(spark, {"a": "}}]]", "b": [{"cache_control": None}]}, B.has_mark) is True


def test_marks_on_the_last_system_block_and_the_last_tool(spark):
    mark = {"type": "ephemeral"}
    body = {"system": [{"type": "text", "text": "a"}, {"type": "text", "text": "b"}], "tools": [{"name": "x"}, {"name": "y", "input_schema": {"k": [1]}}], "messages": []}
    out = one(spark, body, lambda b: B.with_marks(b, "messages"))
    assert out == {"system": [body["system"][0], body["system"][1] | {"cache_control": mark}], "tools": [body["tools"][0], body["tools"][1] | {"cache_control": mark}], "messages": []}
    again = one(spark, out, lambda b: B.with_marks(b, "messages"))
    assert again == out and one(spark, body, lambda b: B.with_marks(b, "chat")) == body
    assert one(spark, {"system": "s"}, lambda b: B.with_marks(b, "messages")) == {"system": [{"type": "text", "text": "s", "cache_control": mark}]}
    for plain in ({"system": ""}, {"system": [], "tools": []}, {"tools": ["x"]}, {"x": 1}):
        assert one(spark, plain, lambda b: B.with_marks(b, "messages")) == plain


TOOL = [{"name": "index_read", "description": "d", "schema": '{"type":"object"}'}]


def test_injection_once_on_each_wire(spark):
    add = lambda wire: lambda b: B.with_tools(b, wire, TOOL, "[index] do", "[index]")
    out = one(spark, {"tools": [{"name": "x"}], "system": [{"type": "text", "text": "s"}], "messages": [1]}, add("messages"))
    assert out == {"tools": [{"name": "x"}, {"name": "index_read", "description": "d", "input_schema": {"type": "object"}}], "system": [{"type": "text", "text": "s"}, {"type": "text", "text": "[index] do"}], "messages": [1]}
    assert one(spark, out, add("messages")) == out
    assert one(spark, {}, add("messages"))["system"] == "[index] do" and one(spark, {"system": "s"}, add("messages"))["system"] == "s\n\n[index] do"
    fn = {"type": "function", "function": {"name": "index_read", "description": "d", "parameters": {"type": "object"}}}
    out = one(spark, {"messages": [{"role": "user", "content": "u"}]}, add("chat"))
    assert out == {"tools": [fn], "messages": [{"role": "system", "content": "[index] do"}, {"role": "user", "content": "u"}]} and one(spark, out, add("chat")) == out
    assert one(spark, {"messages": [{"role": "system", "content": "s", "k": 1}]}, add("chat"))["messages"] == [{"role": "system", "content": "s\n\n[index] do", "k": 1}]
    out = one(spark, {"input": "ask", "instructions": "i"}, add("responses"))
    assert out == {"input": [{"role": "user", "content": "ask"}], "instructions": "i\n\n[index] do", "tools": [{"type": "function", "name": "index_read", "description": "d", "parameters": {"type": "object"}}]} and one(spark, out, add("responses")) == out
    assert one(spark, {}, add("responses"))["input"] == []


def test_texts_and_tokens(spark):
    text = lambda b: run(spark, b, B.block_text).first()["x"]
    deep = {"type": "tool_result", "content": [{"type": "text", "text": "a"}, {"type": "tool_result", "content": [{"type": "tool_result", "content": "b"}, IMAGE]}]}
    assert text(deep) == "ab" + '{"source":{"data":"x","n":1.5},"type":"image"}'
    assert text({"type": "tool_use", "name": "Read", "input": {"b": 1, "a": "x"}}) == 'Read{"a":"x","b":1}' and text({"type": "tool_result"}) == "" and text("raw") == "raw"
    body = {"system": "s" * 40, "tools": [{"name": "t" * 20}], "messages": [{"role": "user", "content": "u" * 8}, {"role": "user", "content": [{"type": "text", "text": "v" * 5}, {"type": "text", "text": "w" * 7}]}, {"role": "user"}]}
    assert run(spark, body, B.body_tokens).first()["x"] == 10 + len('{"name":"' + "t" * 20 + '"}') // 4 + 2 + 3 + 1


def streamed(spark, wire, response):
    rows = B.events(spark.createDataFrame([(1, wire, json.dumps(response))], "rid int, wire string, t string").withColumn("body", B.body(F.col("t")))).orderBy("seq").collect()
    return [(r["event"], r["data"] if r["data"] == "[DONE]" else json.loads(r["data"])) for r in rows]


def test_events_of_messages(spark):
    e = streamed(spark, "messages", {"id": "m1", "model": "x", "stop_reason": "tool_use", "usage": {"output_tokens": 3}, "content": [{"type": "text", "text": "hi"}, {"type": "thinking"}, {"type": "tool_use", "id": "t", "name": "Read", "input": {"p": "a"}}]})
    assert [n for n, _ in e] == ["message_start", *["content_block_start", "content_block_delta", "content_block_stop"] * 2, "message_delta", "message_stop"]
    assert e[0][1]["message"] == {"id": "m1", "model": "x", "stop_reason": "tool_use", "usage": {"output_tokens": 3}, "content": [], "type": "message", "role": "assistant"}
    assert e[2][1] == {"type": "content_block_delta", "index": 0, "delta": {"type": "text_delta", "text": "hi"}}
    assert e[4][1] == {"type": "content_block_start", "index": 2, "content_block": {"type": "tool_use", "id": "t", "name": "Read", "input": {}}} and e[5][1]["delta"] == {"type": "input_json_delta", "partial_json": '{"p":"a"}'}
    assert e[-2][1] == {"type": "message_delta", "delta": {"stop_reason": "tool_use", "stop_sequence": None}, "usage": {"output_tokens": 3}}
    assert [n for n, _ in streamed(spark, "messages", {})] == ["message_start", "message_delta", "message_stop"]


def test_events_of_chat(spark):
    e = streamed(spark, "chat", {"id": "c", "model": "x", "created": 5, "choices": [{"message": {"content": "hi", "tool_calls": [{"id": "a", "function": {"name": "f", "arguments": "{}"}}, {"id": "b"}]}, "finish_reason": "tool_calls"}]})
    assert [n for n, _ in e] == ["data"] * 6 and e[-1][1] == "[DONE]"
    deltas = [x["choices"][0] for _, x in e[:-1]]
    assert [d["delta"] for d in deltas] == [{"role": "assistant"}, {"content": "hi"}, {"tool_calls": [{"index": 0, "id": "a", "type": "function", "function": {"name": "f", "arguments": "{}"}}]}, {"tool_calls": [{"index": 1, "id": "b", "type": "function", "function": {"name": None, "arguments": ""}}]}, {}]
    assert [d["finish_reason"] for d in deltas] == [None] * 4 + ["tool_calls"] and {(x["id"], x["created"], x["object"]) for _, x in e[:-1]} == {("c", 5, "chat.completion.chunk")}


def test_events_of_responses(spark):
    say = {"type": "message", "id": "m", "content": [{"type": "output_text", "text": "a"}, {"type": "refusal"}, {"type": "output_text", "text": "b"}]}
    call = {"type": "function_call", "call_id": "c", "name": "f", "arguments": "{}"}
    e = streamed(spark, "responses", {"id": "r", "output": [say, {"type": "reasoning"}, call]})
    assert [n.removeprefix("response.") for n, _ in e] == ["created", "in_progress", "output_item.added", "content_part.added", "output_text.delta", "output_text.done", "content_part.done", "output_item.done", "output_item.added", "function_call_arguments.delta", "function_call_arguments.done", "output_item.done", "completed"]
    assert [x["sequence_number"] for _, x in e] == list(range(13)) and all(x["type"] == n for n, x in e)
    assert e[2][1]["item"] == say | {"content": []} and e[4][1]["delta"] == "ab" and e[7][1]["item"] == say and e[9][1] == {"type": "response.function_call_arguments.delta", "item_id": "item_2", "output_index": 2, "delta": "{}", "sequence_number": 9}
    assert e[-1][1]["response"]["output"] == [say, {"type": "reasoning"}, call] and e[-1][1]["response"]["status"] == "completed" and e[0][1]["response"]["output"] == [] and e[0][1]["response"]["id"] == "r"


def test_nothing_but_objects_has_events(spark):
    rows = [(1, "messages", "[1]"), (2, "chat", "{bad"), (3, "other", "{}"), (4, None, None)]
    assert B.events(spark.createDataFrame(rows, "rid int, wire string, t string").withColumn("body", B.body(F.col("t")))).count() == 0
