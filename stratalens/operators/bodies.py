"""Request and response bodies as VARIANT: read, rewritten and rendered in the row, with everything else left as it was.

An object is a map of variants while a key is set, an array a list of variants; both go back to a variant, so unknown
blocks, sibling keys and values of any type survive. What a rewrite touches is addressed by its place in the body (message,
or message / block). Rendered JSON is compact, with keys in order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stratalens.functions.text import let, token_estimate
from stratalens.operators.transcript import SUMMARY_MARK

MESSAGES, CHAT, RESPONSES = "messages", "chat", "responses"
WIRES = (MESSAGES, CHAT, RESPONSES)
CACHE_KEY = "cache_control"
#: How deep a cache mark is looked for: its object may lie in so many others.
MAX_DEPTH = 40
#: Tool results within tool results are read to this depth; below it a block counts as JSON.
BLOCK_DEPTH = 4


def body(json: Column) -> Column:
    """A variant; null where the text is no JSON."""
    return F.try_parse_json(json)


def fields(v: Column) -> Column:
    """An object's fields; null for anything else."""
    return F.try_variant_get(v, "$", "map<string,variant>")


def items(v: Column) -> Column:
    """An array's items; null for anything else."""
    return F.try_variant_get(v, "$", "array<variant>")


def string(v: Column) -> Column:
    """A string's text; null for anything else."""
    return F.when(F.schema_of_variant(v) == "STRING", F.try_variant_get(v, "$", "string"))


def _v(text: Column) -> Column:
    return text.cast("variant")


def _array(a: Column) -> Column:
    return a.cast("variant")


def put(m: Column, key: str, value: Column) -> Column:
    """The fields with one of them set."""
    return F.map_concat(F.map_filter(m, lambda k, _: k != key), F.create_map(F.lit(key), value))


def _is(block: Column, kind: str) -> Column:
    """Whether a block (variant) is an object of this type."""
    return F.coalesce(string(fields(block)["type"]) == kind, F.lit(False))


def _none() -> Column:
    return F.array().cast("array<variant>")


def _list(v: Column) -> Column:
    return F.coalesce(items(v), _none())


# --- tool results, out and back ---


def _raw_text(raw: Column) -> Column:
    """A result's text: a string, or the texts of its text blocks."""
    texts = F.transform(F.filter(_list(raw), lambda b: _is(b, "text")), lambda b: F.coalesce(string(fields(b)["text"]), F.lit("")))
    return F.coalesce(string(raw), F.array_join(texts, ""))


RESULT = "array<struct<at:string,id:string,text:string>>"


def tool_results(b: Column, wire: str) -> Column:
    """(at, id, text) of all tool results of a request, in order; at is where they stand."""
    row = lambda at, i, t: F.struct(at.alias("at"), F.coalesce(string(i), F.lit("")).alias("id"), F.coalesce(t, F.lit("")).alias("text"))
    if wire == MESSAGES:
        def of_message(m, i):
            def of_block(x, j):
                return F.when(_is(x, "tool_result"), row(F.concat_ws("/", i.cast("string"), j.cast("string")), fields(x)["tool_use_id"], _raw_text(fields(x)["content"])))

            return F.when(string(fields(m)["role"]) == "user", F.array_compact(F.transform(_list(fields(m)["content"]), of_block)))

        found = F.flatten(F.array_compact(F.transform(_list(fields(b)["messages"]), of_message)))
    elif wire == CHAT:
        found = F.array_compact(F.transform(_list(fields(b)["messages"]), lambda m, i: F.when(string(fields(m)["role"]) == "tool", row(i.cast("string"), fields(m)["tool_call_id"], string(fields(m)["content"])))))
    else:
        found = F.array_compact(F.transform(_list(fields(b)["input"]), lambda m, i: F.when(_is(m, "function_call_output"), row(i.cast("string"), fields(m)["call_id"], string(fields(m)["output"])))))
    return F.coalesce(found, F.array().cast(RESULT))


def _with_text(block: Column, new: Column) -> Column:
    """A tool_result block with new text: the first text block keeps its other keys and takes the last mark of the text
    blocks, blocks of other types follow it; a string is replaced."""
    def of_list(raw):
        texts, others = F.filter(raw, lambda x: _is(x, "text")), F.filter(raw, lambda x: ~_is(x, "text"))
        marks = F.filter(F.transform(texts, lambda x: fields(x)[CACHE_KEY]), lambda x: x.isNotNull() & ~F.is_variant_null(x))
        first = F.when(F.size(texts) > 0, F.map_filter(fields(F.get(texts, F.lit(0))), lambda k, _: k != CACHE_KEY)).otherwise(F.create_map(F.lit("type"), _v(F.lit("text"))))
        written = put(first, "text", _v(new))
        marked = F.when(F.size(marks) > 0, put(written, CACHE_KEY, F.element_at(marks, -1))).otherwise(written)
        return _array(F.concat(F.array(F.to_variant_object(marked)), others))

    raw = fields(block)["content"]
    content = F.when(items(raw).isNotNull(), let(items(raw), of_list)).otherwise(_v(new))
    return F.to_variant_object(put(fields(block), "content", content))


def with_results(b: Column, wire: str, new: Column) -> Column:
    """The request with the texts of `new` (a map from a result's place to its text) in their places, all else unchanged."""
    def replaced(m, at, change):
        return F.when(F.map_contains_key(new, at), change(m, new[at])).otherwise(m)

    if wire == MESSAGES:
        def of_message(m, i):
            at = lambda j: F.concat_ws("/", i.cast("string"), j.cast("string"))
            blocks = F.transform(items(fields(m)["content"]), lambda x, j: F.when(_is(x, "tool_result"), replaced(x, at(j), _with_text)).otherwise(x))
            return F.when((string(fields(m)["role"]) == "user") & items(fields(m)["content"]).isNotNull(), F.to_variant_object(put(fields(m), "content", _array(blocks)))).otherwise(m)

        key, changed = "messages", of_message
    else:
        key, name = ("messages", "content") if wire == CHAT else ("input", "output")
        mine = lambda m: string(fields(m)["role"]) == "tool" if wire == CHAT else _is(m, "function_call_output")

        def changed(m, i):
            return F.when(F.coalesce(mine(m), F.lit(False)), replaced(m, i.cast("string"), lambda x, t: F.to_variant_object(put(fields(x), name, _v(t))))).otherwise(m)

    rewritten = _array(F.transform(items(fields(b)[key]), changed))
    return F.when(items(fields(b)[key]).isNotNull() & new.isNotNull(), F.to_variant_object(put(fields(b), key, rewritten))).otherwise(b)


def summarised_paths(b: Column, wire: str) -> Column:
    """The paths whose summary a request shows: in tool results, in plain contents, in function outputs."""
    texts = F.transform(_list(fields(b)["messages"]), lambda m: F.coalesce(string(fields(m)["content"]), F.lit("")))
    outputs = F.transform(_list(fields(b)["input"]), lambda m: F.concat_ws("\n", string(fields(m)["content"]), string(fields(m)["output"])))
    all_ = F.concat(F.transform(tool_results(b, wire), lambda r: r["text"]), texts, outputs)
    return F.array_sort(F.array_distinct(F.regexp_extract_all(F.array_join(all_, "\n"), F.lit(SUMMARY_MARK + "(.+?)⟫"), F.lit(1))))


# --- cache marks ---


def has_mark(v: Column, most: int = MAX_DEPTH) -> Column:
    """Whether an object at most `most` levels down has the cache key; values that only look like it don't count.

    One pass over the rendered JSON: brackets and keys in order, the depth a running count.
    """
    key = f'"{CACHE_KEY}":'
    tokens = F.filter(F.regexp_extract_all(F.to_json(v), F.lit(r'("(?:[^"\\]|\\.)*+":?|[{}\[\]])'), F.lit(1)), lambda x: x.isin("{", "}", "[", "]", key))

    def step(s, x):
        depth = s["depth"] + F.when(x.isin("{", "["), 1).when(x.isin("}", "]"), -1).otherwise(0)
        return F.struct(depth.alias("depth"), (s["found"] | ((x == key) & (depth - 1 <= most))).alias("found"))

    found = F.aggregate(tokens, F.struct(F.lit(0).alias("depth"), F.lit(False).alias("found")), step, lambda s: s["found"])
    return F.when(v.isNull() | ~F.contains(F.to_json(v), F.lit(CACHE_KEY)), F.lit(False)).otherwise(F.coalesce(found, F.lit(False)))


def with_marks(b: Column, wire: str) -> Column:
    """The request with a mark on the last system block and on the last tool, unless system, tools or messages have one.

    A system text becomes a block. Only the messages wire has marks; the others cache by themselves.
    """
    if wire != MESSAGES:
        return b
    mark = F.to_variant_object(F.create_map(F.lit("type"), F.lit("ephemeral")))
    last = lambda a: _array(F.transform(a, lambda x, i: F.when((i == F.size(a) - 1) & fields(x).isNotNull(), F.to_variant_object(put(fields(x), CACHE_KEY, mark))).otherwise(x)))

    def marked(f):
        block = F.to_variant_object(F.map_from_arrays(F.array(F.lit("type"), F.lit("text"), F.lit(CACHE_KEY)), F.array(_v(F.lit("text")), f["system"], mark)))
        system = F.when(F.coalesce(string(f["system"]) != "", F.lit(False)), _array(F.array(block))).when(F.size(_list(f["system"])) > 0, last(items(f["system"])))
        tools = F.when(F.size(_list(f["tools"])) > 0, last(items(f["tools"])))
        one = lambda m, key, value: F.when(value.isNotNull(), put(m, key, value)).otherwise(m)
        return F.to_variant_object(one(one(f, "system", system), "tools", tools))

    clean = ~(has_mark(fields(b)["system"]) | has_mark(fields(b)["tools"]) | has_mark(fields(b)["messages"]))
    return F.when(fields(b).isNotNull() & clean, let(fields(b), marked)).otherwise(b)


# --- injection ---


def with_tools(b: Column, wire: str, tools: list[dict], directive: str, mark: str) -> Column:
    """The request with tools that it doesn't have, and the directive where the wire keeps its system text, once.

    tools: name, description, schema (JSON text).
    """
    def definition(t):
        text = {k: _v(F.lit(t[k])) for k in ("name", "description")}
        pairs = lambda d: F.map_from_arrays(F.array(*(F.lit(k) for k in d)), F.array(*d.values()))
        schema = F.parse_json(F.lit(t["schema"]))
        if wire == MESSAGES:
            return F.to_variant_object(pairs(text | {"input_schema": schema}))
        flat = pairs(text | {"parameters": schema})
        if wire == RESPONSES:
            return F.to_variant_object(put(flat, "type", _v(F.lit("function"))))
        return F.to_variant_object(pairs({"type": _v(F.lit("function")), "function": F.to_variant_object(flat)}))

    name = lambda x: string(fields(fields(x)["function"])["name"] if wire == CHAT else fields(x)["name"])
    has = lambda text: F.coalesce(F.contains(text, F.lit(mark)), F.lit(False))
    joined = lambda text: _v(F.when(has(text), text).otherwise(F.concat(text, F.lit(f"\n\n{directive}"))))
    alone = _v(F.lit(directive))

    def tooled(f):
        have = F.transform(_list(f["tools"]), name)
        new = F.array_compact(F.array(*(F.when(~F.coalesce(F.array_contains(have, t["name"]), F.lit(False)), definition(t)) for t in tools)))
        return put(f, "tools", _array(F.concat(_list(f["tools"]), new)))

    def told(f):
        if wire == MESSAGES:
            block = F.to_variant_object(F.map_from_arrays(F.array(F.lit("type"), F.lit("text")), F.array(_v(F.lit("text")), alone)))
            blocks = items(f["system"])
            listed = F.when(F.exists(blocks, lambda x: has(string(fields(x)["text"]))), f["system"]).otherwise(_array(F.concat(blocks, F.array(block))))
            return put(f, "system", F.when(blocks.isNotNull(), listed).when(string(f["system"]).isNotNull(), joined(string(f["system"]))).when(f["system"].isNull() | F.is_variant_null(f["system"]), alone).otherwise(f["system"]))
        if wire == RESPONSES:
            asked = F.to_variant_object(F.map_from_arrays(F.array(F.lit("role"), F.lit("content")), F.array(_v(F.lit("user")), f["input"])))
            asked = F.when(string(f["input"]).isNotNull(), _array(F.array(asked))).when(f["input"].isNull() | F.is_variant_null(f["input"]), _array(_none())).otherwise(f["input"])
            return put(put(f, "input", asked), "instructions", F.when(string(f["instructions"]).isNull(), alone).otherwise(joined(string(f["instructions"]))))
        messages = _list(f["messages"])
        first = fields(F.get(messages, F.lit(0)))
        is_system = F.coalesce(string(first["role"]) == "system", F.lit(False))
        kept = F.when(string(first["content"]).isNull(), F.get(messages, F.lit(0))).otherwise(F.to_variant_object(put(first, "content", joined(string(first["content"])))))
        own = F.to_variant_object(F.map_from_arrays(F.array(F.lit("role"), F.lit("content")), F.array(_v(F.lit("system")), alone)))
        return put(f, "messages", _array(F.when(is_system, F.concat(F.array(kept), F.slice(messages, 2, F.greatest(F.size(messages), F.lit(1))))).otherwise(F.concat(F.array(own), messages))))

    return F.when(fields(b).isNotNull(), F.to_variant_object(told(tooled(fields(b))))).otherwise(b)


# --- texts and tokens ---


def block_text(block: Column, depth: int = BLOCK_DEPTH) -> Column:
    """What a block adds to a body: its text, a result's texts, a call's name and arguments, else its JSON."""
    f = fields(block)
    kind, content = string(f["type"]), f["content"]
    inner = F.array_join(F.transform(items(content), lambda x: block_text(x, depth - 1)), "") if depth else F.to_json(content)
    result = F.coalesce(string(content), F.when(items(content).isNotNull(), inner), F.lit(""))
    call = F.concat(F.coalesce(string(f["name"]), F.lit("")), F.coalesce(F.to_json(f["input"]), F.lit("{}")))
    other = F.coalesce(string(block), F.to_json(block), F.lit(""))
    return F.when(kind == "text", F.coalesce(string(f["text"]), F.lit(""))).when(kind == "tool_result", result).when(kind == "tool_use", call).otherwise(other)


def content_text(content: Column) -> Column:
    return F.coalesce(string(content), F.array_join(F.transform(items(content), lambda x: block_text(x)), ""), F.lit(""))


def body_tokens(b: Column, count=token_estimate) -> Column:
    """The tokens of a request of the messages wire: its system text, each tool as JSON, each message's text."""
    f = fields(b)
    total = lambda a, text: F.aggregate(_list(a), F.lit(0).cast("bigint"), lambda n, x: n + count(text(x)))
    system = F.when(string(f["system"]).isNotNull() | items(f["system"]).isNotNull(), count(content_text(f["system"]))).otherwise(F.lit(0).cast("bigint"))
    return system + total(f["tools"], F.to_json) + total(f["messages"], lambda m: content_text(fields(m)["content"]))


# --- events ---


def _event(name: str, data: Column) -> Column:
    return F.struct(F.lit(name).alias("event"), data.alias("data"))


def _object(**values: Column) -> Column:
    """An object of variants; missing (null) values are left out."""
    m = F.map_from_arrays(F.array(*map(F.lit, values)), F.array(*values.values()))
    return F.to_variant_object(F.map_filter(m, lambda _, v: v.isNotNull()))


def _text(x) -> Column:
    return _v(F.lit(x) if isinstance(x, str) else x)


def _null() -> Column:
    return F.parse_json(F.lit("null"))


def _messages_events(f: Column) -> Column:
    meta = F.to_variant_object(F.map_concat(F.create_map(F.lit("content"), _array(_none())), F.map_filter(F.map_concat(F.map_filter(F.map_from_arrays(F.array(F.lit("type"), F.lit("role")), F.array(_text("message"), _text("assistant"))), lambda k, _: ~F.map_contains_key(f, k)), f), lambda k, _: k != "content")))

    def of_block(x, i):
        b, at = fields(x), _v(i.cast("bigint"))
        kind = string(b["type"])
        start = F.when(kind == "text", _object(type=_text("text"), text=_text(""))).otherwise(_object(type=_text("tool_use"), id=b["id"], name=b["name"], input=F.parse_json(F.lit("{}"))))
        delta = F.when(kind == "text", _object(type=_text("text_delta"), text=F.coalesce(b["text"], _text("")))).otherwise(_object(type=_text("input_json_delta"), partial_json=_v(F.coalesce(F.to_json(b["input"]), F.lit("{}")))))
        events = F.array(_event("content_block_start", _object(type=_text("content_block_start"), index=at, content_block=start)), _event("content_block_delta", _object(type=_text("content_block_delta"), index=at, delta=delta)), _event("content_block_stop", _object(type=_text("content_block_stop"), index=at)))
        return F.when(kind.isin("text", "tool_use"), events)

    blocks = F.flatten(F.array_compact(F.transform(_list(f["content"]), of_block)))
    end = _object(type=_text("message_delta"), delta=_object(stop_reason=F.coalesce(f["stop_reason"], _text("end_turn")), stop_sequence=_null()), usage=F.coalesce(f["usage"], F.parse_json(F.lit("{}"))))
    return F.concat(F.array(_event("message_start", _object(type=_text("message_start"), message=meta))), blocks, F.array(_event("message_delta", end), _event("message_stop", _object(type=_text("message_stop")))))


def _chat_events(f: Column) -> Column:
    choice = fields(F.get(_list(f["choices"]), F.lit(0)))
    said = fields(choice["message"])
    base = {"id": F.coalesce(f["id"], _text("chat")), "object": _text("chat.completion.chunk"), "created": F.coalesce(f["created"], _v(F.lit(0).cast("bigint"))), "model": F.coalesce(f["model"], _text(""))}

    def chunk(delta, finish=None):
        one = _object(index=_v(F.lit(0).cast("bigint")), delta=delta, finish_reason=_null() if finish is None else finish)
        return _event("data", _object(**base, choices=_array(F.array(one))))

    def of_call(x, i):
        c = fields(x)
        f_ = fields(c["function"])
        call = _object(index=_v(i.cast("bigint")), id=F.coalesce(c["id"], _null()), type=_text("function"), function=_object(name=F.coalesce(f_["name"], _null()), arguments=F.coalesce(f_["arguments"], _text(""))))
        return chunk(_object(tool_calls=_array(F.array(call))))

    text = F.when(F.coalesce(string(said["content"]) != "", F.lit(False)), F.array(chunk(_object(content=said["content"])))).otherwise(F.array().cast("array<struct<event:string,data:variant>>"))
    done = F.array(chunk(F.parse_json(F.lit("{}")), F.coalesce(choice["finish_reason"], _text("stop"))), _event("data", _text("[DONE]")))
    return F.concat(F.array(chunk(_object(role=_text("assistant")))), text, F.transform(_list(said["tool_calls"]), of_call), done)


def _responses_events(f: Column) -> Column:
    zero = _v(F.lit(0).cast("bigint"))
    kept = F.map_filter(f, lambda k, _: k != "output")
    given = {"id": _text("resp"), "object": _text("response"), "created_at": F.coalesce(f["created"], zero), "model": _text(""), "tools": _array(_none()), "tool_choice": _text("auto"), "parallel_tool_calls": _v(F.lit(True))}
    base = F.map_concat(F.map_filter(F.map_from_arrays(F.array(*map(F.lit, given)), F.array(*given.values())), lambda k, _: ~F.map_contains_key(kept, k)), kept)
    whole = lambda status, out: F.to_variant_object(put(put(base, "status", _text(status)), "output", out))
    ev = lambda name, **values: _event(name, _object(type=_text(name), **values))

    def of_item(x, i):
        it, at = fields(x), _v(i.cast("bigint"))
        item_id = F.coalesce(it["id"], _v(F.concat(F.lit("item_"), i.cast("string"))))
        texts = F.transform(F.filter(_list(it["content"]), lambda p: _is(p, "output_text")), lambda p: F.coalesce(string(fields(p)["text"]), F.lit("")))
        text = _v(F.array_join(texts, ""))
        part = lambda t: _object(type=_text("output_text"), text=t, annotations=_array(_none()))
        place = {"item_id": item_id, "output_index": at}
        message = F.array(
            ev("response.output_item.added", output_index=at, item=F.to_variant_object(put(it, "content", _array(_none())))), ev("response.content_part.added", **place, content_index=zero, part=part(_text(""))),
            ev("response.output_text.delta", **place, content_index=zero, delta=text, logprobs=_array(_none())), ev("response.output_text.done", **place, content_index=zero, text=text, logprobs=_array(_none())),
            ev("response.content_part.done", **place, content_index=zero, part=part(text)), ev("response.output_item.done", output_index=at, item=x))
        args = _v(F.coalesce(string(it["arguments"]), F.lit("")))
        call = F.array(ev("response.output_item.added", output_index=at, item=F.to_variant_object(put(it, "arguments", _text("")))), ev("response.function_call_arguments.delta", **place, delta=args),
                       ev("response.function_call_arguments.done", **place, arguments=args), ev("response.output_item.done", output_index=at, item=x))
        return F.when(_is(x, "message"), message).when(_is(x, "function_call"), call)

    middle = F.flatten(F.array_compact(F.transform(_list(f["output"]), of_item)))
    begun = whole("in_progress", _array(_none()))
    all_ = F.concat(F.array(ev("response.created", response=begun), ev("response.in_progress", response=begun)), middle, F.array(ev("response.completed", response=whole("completed", F.coalesce(f["output"], _array(_none()))))))
    return F.transform(all_, lambda e, i: F.struct(e["event"].alias("event"), F.to_variant_object(put(fields(e["data"]), "sequence_number", _v(i.cast("bigint")))).alias("data")))


def events(responses: DataFrame) -> DataFrame:
    """(rid, seq, event, data) of responses (rid, wire, body: variant): a finished response as the stream that a host expects.

    data is JSON text. A wire that is none of WIRES, and a body that is no object, give no events.
    """
    of = {MESSAGES: _messages_events, CHAT: _chat_events, RESPONSES: _responses_events}
    parts = []
    for wire, make in of.items():  # a wire's rows meet its own expression only
        rows = responses.where(F.col("wire") == wire).select("rid", fields(F.col("body")).alias("f")).where("f is not null")
        e = rows.select("rid", F.posexplode(make(F.col("f"))).alias("seq", "x"))
        done = F.when(string(F.col("x.data")) == "[DONE]", F.lit("[DONE]")).otherwise(F.to_json("x.data"))
        parts.append(e.select("rid", "seq", "x.event", done.alias("data")))
    return parts[0].union(parts[1]).union(parts[2])
