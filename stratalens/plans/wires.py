"""Queries of request and response bodies over the three wires, each with its SQL twin."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stratalens.functions.text import let
from stratalens.operators import bodies as B
from stratalens.operators import replay as Y
from stratalens.plans import catalog, model
from stratalens.plans.catalog import query

TOOLS = [{"name": "index_read", "description": "a summary", "schema": '{"type":"object"}'}, {"name": "index_search", "description": "hits", "schema": '{"type":"object"}'}]
DIRECTIVE, MARK = "[index] ask first", "[index]"
#: Each turn of a conversation: a wire, the digest of its text, an id.
T = """t AS (SELECT conv_id, turn, ['messages', 'chat', 'responses'][(turn % 3 + 1)::INT] AS wire, sha256(coalesce(text, '')) AS h, 'c' || conv_id || '-' || turn AS id, (conv_id + turn) % 2 = 0 AS due FROM conversations)"""


def _turns(spark, sf) -> DataFrame:
    c, t = F.col("conv_id"), F.col("turn")
    wire = F.element_at(F.array(*map(F.lit, B.WIRES)), (t % 3 + 1).cast("int"))
    return model.read(spark, sf, "conversations").select("conv_id", "turn", wire.alias("wire"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("h"), F.format_string("c%d-%d", c, t).alias("id"), ((c + t) % 2 == 0).alias("due"))


def _filled(shape: str, *parts: str) -> Column:
    return F.format_string(shape, *map(F.col, parts))


def _by_wire(of) -> Column:
    """of(wire) for a row's own wire."""
    out = F.when(F.col("wire") == B.MESSAGES, of(B.MESSAGES))
    for w in B.WIRES[1:]:
        out = out.when(F.col("wire") == w, of(w))
    return out


RESULT_SHAPES = {
    "messages": '{"model":"m","messages":[{"role":"user","content":[{"type":"text","text":"q"},{"type":"tool_result","tool_use_id":"%s","content":[{"type":"image","n":%d},{"type":"text","text":"%s","cite":[1],"cache_control":{"type":"a"}},{"type":"text","text":"!","cache_control":{"type":"b"}}]}]}]}',
    "chat": '{"model":"m","messages":[{"role":"user","content":"q"},{"role":"tool","tool_call_id":"%s","n":%d,"content":"%s"}]}',
    "responses": '{"model":"m","input":[{"type":"reasoning"},{"type":"function_call_output","call_id":"%s","n":%d,"output":"%s"}]}',
}


@query(f"""WITH {T}, x AS (SELECT *, CASE WHEN due THEN 'new ' || turn ELSE h END AS n FROM t)
SELECT conv_id, turn, CASE wire WHEN 'messages' THEN '0/1' ELSE '1' END AS at, id, CASE wire WHEN 'messages' THEN h || '!' ELSE h END AS text,
  CASE wire WHEN 'messages' THEN '{{"messages":[{{"content":[{{"text":"q","type":"text"}},{{"content":[' || CASE WHEN due THEN '{{"cache_control":{{"type":"b"}},"cite":[1],"text":"' || n || '","type":"text"}},{{"n":' || turn || ',"type":"image"}}'
      ELSE '{{"n":' || turn || ',"type":"image"}},{{"cache_control":{{"type":"a"}},"cite":[1],"text":"' || h || '","type":"text"}},{{"cache_control":{{"type":"b"}},"text":"!","type":"text"}}' END || '],"tool_use_id":"' || id || '","type":"tool_result"}}],"role":"user"}}],"model":"m"}}'
    WHEN 'chat' THEN '{{"messages":[{{"content":"q","role":"user"}},{{"content":"' || n || '","n":' || turn || ',"role":"tool","tool_call_id":"' || id || '"}}],"model":"m"}}'
    ELSE '{{"input":[{{"type":"reasoning"}},{{"call_id":"' || id || '","n":' || turn || ',"output":"' || n || '","type":"function_call_output"}}],"model":"m"}}' END AS body FROM x""")
def rewritten_results(spark, sf):
    """Every second tool result gets a new text; blocks of other types, sibling keys and the last mark stay."""
    b = F.try_parse_json(_by_wire(lambda w: _filled(RESULT_SHAPES[w], "id", "turn", "h")))
    t = _turns(spark, sf).select("*", b.alias("b"))
    found = t.select("*", F.explode(_by_wire(lambda w: B.tool_results(F.col("b"), w))).alias("r"))
    new = F.when(F.col("due"), F.create_map(F.col("r.at"), F.concat(F.lit("new "), F.col("turn").cast("string")))).otherwise(F.create_map().cast("map<string,string>"))
    return found.select("conv_id", "turn", "r.at", "r.id", "r.text", F.to_json(_by_wire(lambda w: B.with_results(F.col("b"), w, new))).alias("body"))


@query("""WITH d AS (SELECT conv_id, turn, (conv_id * 7 + turn * 5) % 60 AS deep, turn % 4 = 0 AS none FROM conversations)
SELECT conv_id, turn, NOT none AND deep <= 40 AS found, CASE WHEN NOT none AND deep <= 40 THEN '[{"text":"s","type":"text"}]' ELSE '[{"cache_control":{"type":"ephemeral"},"text":"s","type":"text"}]' END AS system,
  CASE WHEN NOT none AND deep <= 40 THEN '[{"name":"x"},{"name":"y"}]' ELSE '[{"name":"x"},{"cache_control":{"type":"ephemeral"},"name":"y"}]' END AS tools FROM d""")
def cache_marks(spark, sf):
    """Marks on the last system block and the last tool, unless one lies at most 40 levels down the messages."""
    deep, none = ((F.col("conv_id") * 7 + F.col("turn") * 5) % 60).cast("int"), F.col("turn") % 4 == 0
    inside = F.when(none, '{"text":"\\"cache_control\\":"}').otherwise('{"cache_control":{"type":"x"}}')
    json = F.concat(F.lit('{"system":[{"type":"text","text":"s"}],"tools":[{"name":"x"},{"name":"y"}],"messages":'), F.repeat(F.lit("["), deep), inside, F.repeat(F.lit("]"), deep), F.lit("}"))
    t = model.read(spark, sf, "conversations").select("conv_id", "turn", B.body(json).alias("b"))
    out = B.fields(B.with_marks(F.col("b"), B.MESSAGES))
    return t.select("conv_id", "turn", B.has_mark(B.fields(F.col("b"))["messages"]).alias("found"), out.alias("o")).select("conv_id", "turn", "found", F.to_json(F.col("o")["system"]).alias("system"), F.to_json(F.col("o")["tools"]).alias("tools"))


REQUEST_SHAPES = {
    "messages": '{"system":"%s","tools":[{"name":"index_read"},{"name":"x"}],"messages":[]}',
    "chat": '{"messages":[{"role":"user","content":"%s"}],"tools":[{"type":"function","function":{"name":"index_read"}}]}',
    "responses": '{"input":"%s","instructions":"[index] there"}',
}


@query(f"""WITH {T} SELECT conv_id, turn, CASE wire WHEN 'messages' THEN '{{"messages":[],"system":"' || h || '\\n\\n{DIRECTIVE}","tools":[{{"name":"index_read"}},{{"name":"x"}},{{"description":"hits","input_schema":{{"type":"object"}},"name":"index_search"}}]}}'
  WHEN 'chat' THEN '{{"messages":[{{"content":"{DIRECTIVE}","role":"system"}},{{"content":"' || h || '","role":"user"}}],"tools":[{{"function":{{"name":"index_read"}},"type":"function"}},{{"function":{{"description":"hits","name":"index_search","parameters":{{"type":"object"}}}},"type":"function"}}]}}'
  ELSE '{{"input":[{{"content":"' || h || '","role":"user"}}],"instructions":"[index] there","tools":[{{"description":"a summary","name":"index_read","parameters":{{"type":"object"}},"type":"function"}},{{"description":"hits","name":"index_search","parameters":{{"type":"object"}},"type":"function"}}]}}' END AS body FROM t""")
def wire_requests(spark, sf):
    """Tools and directive added to each wire's request, twice: the second time changes nothing."""
    t = _turns(spark, sf).select("conv_id", "turn", "wire", B.body(_by_wire(lambda w: _filled(REQUEST_SHAPES[w], "h"))).alias("b"))
    once = lambda b: lambda w: B.with_tools(b, w, TOOLS, DIRECTIVE, MARK)
    first = t.withColumn("b", _by_wire(once(F.col("b"))))
    return first.select("conv_id", "turn", F.to_json(_by_wire(once(F.col("b")))).alias("body"))


@query("""SELECT conv_id, (sum(greatest(1, length(coalesce(text, '')) // 4)) + max(greatest(1, length(conv_id::VARCHAR || 'system') // 4)) + max(greatest(1, length('{"name":"t' || conv_id || '"}') // 4)))::BIGINT AS tokens,
  sum(length(coalesce(text, '')))::BIGINT AS n_chars FROM conversations GROUP BY 1""")
def request_tokens(spark, sf):
    """The tokens of each conversation as one request: system text, a tool, every message, half of them in blocks."""
    text = F.coalesce("text", F.lit(""))
    plain = F.struct(F.col("role"), text.alias("content"))
    listed = F.struct(F.col("role"), F.array(F.struct(F.lit("tool_result").alias("type"), F.array(F.struct(F.lit("text").alias("type"), text.alias("text"))).alias("content"))).alias("content"))
    m = model.read(spark, sf, "conversations").select("conv_id", "turn", F.when(F.col("turn") % 2 == 0, F.to_json(plain)).otherwise(F.to_json(listed)).alias("m"))
    g = m.groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "m"))), lambda x: x["m"]), ",").alias("ms"))
    b = B.body(F.concat(F.lit('{"system":"'), F.col("conv_id").cast("string"), F.lit('system","tools":[{"name":"t'), F.col("conv_id").cast("string"), F.lit('"}],"messages":['), F.col("ms"), F.lit("]}")))
    chars = lambda v: F.aggregate(B.items(B.fields(v)["messages"]), F.lit(0).cast("bigint"), lambda n, x: n + F.length(B.content_text(B.fields(x)["content"])))
    return g.select("conv_id", b.alias("b")).select("conv_id", B.body_tokens(F.col("b")).alias("tokens"), let(F.col("b"), chars).alias("n_chars"))


# --- events ---

ANSWER_SHAPES = {
    "messages": '{"id":"%s","model":"m","stop_reason":"tool_use","content":[{"type":"text","text":"%s"},{"type":"thinking"},{"type":"tool_use","id":"u","name":"Read","input":{"path":"p"}}]}',
    "chat": '{"id":"%s","model":"m","created":7,"choices":[{"message":{"content":"%s","tool_calls":[{"id":"u","function":{"name":"Read","arguments":"{}"}}]},"finish_reason":"tool_calls"}]}',
    "responses": '{"id":"%s","model":"m","output":[{"type":"message","id":"a","content":[{"type":"output_text","text":"%s"}]},{"type":"reasoning"},{"type":"function_call","call_id":"u","name":"Read","arguments":"{}"}]}',
}


def _events(spark, sf, wire: str) -> DataFrame:
    t = _turns(spark, sf).select("id", F.lit(wire).alias("wire"), B.body(_filled(ANSWER_SHAPES[wire], "id", "h")).alias("body"))
    return B.events(t.withColumnRenamed("id", "rid"))


def _event_sql(rows: list[tuple[str, str]]) -> str:
    """Each row of a stream with <ID> and <H> in its data."""
    return f"WITH {T} " + " UNION ALL ".join(f"SELECT id AS rid, {i}::INT AS seq, '{e}' AS event, replace(replace('{d}', '<ID>', id), '<H>', h) AS data FROM t" for i, (e, d) in enumerate(rows))


@query(_event_sql([
    ("message_start", '{"message":{"content":[],"id":"<ID>","model":"m","role":"assistant","stop_reason":"tool_use","type":"message"},"type":"message_start"}'),
    ("content_block_start", '{"content_block":{"text":"","type":"text"},"index":0,"type":"content_block_start"}'), ("content_block_delta", '{"delta":{"text":"<H>","type":"text_delta"},"index":0,"type":"content_block_delta"}'), ("content_block_stop", '{"index":0,"type":"content_block_stop"}'),
    ("content_block_start", '{"content_block":{"id":"u","input":{},"name":"Read","type":"tool_use"},"index":2,"type":"content_block_start"}'), ("content_block_delta", '{"delta":{"partial_json":"{\\"path\\":\\"p\\"}","type":"input_json_delta"},"index":2,"type":"content_block_delta"}'), ("content_block_stop", '{"index":2,"type":"content_block_stop"}'),
    ("message_delta", '{"delta":{"stop_reason":"tool_use","stop_sequence":null},"type":"message_delta","usage":{}}'), ("message_stop", '{"type":"message_stop"}')]))
def events_messages(spark, sf):
    return _events(spark, sf, B.MESSAGES)


def _chunk(delta: str, finish: str = "null") -> tuple[str, str]:
    return "data", f'{{"choices":[{{"delta":{delta},"finish_reason":{finish},"index":0}}],"created":7,"id":"<ID>","model":"m","object":"chat.completion.chunk"}}'


@query(_event_sql([_chunk('{"role":"assistant"}'), _chunk('{"content":"<H>"}'), _chunk('{"tool_calls":[{"function":{"arguments":"{}","name":"Read"},"id":"u","index":0,"type":"function"}]}'), _chunk("{}", '"tool_calls"'), ("data", "[DONE]")]))
def events_chat(spark, sf):
    return _events(spark, sf, B.CHAT)


_SAY, _CALL = '{"content":[{"text":"<H>","type":"output_text"}],"id":"a","type":"message"}', '{"arguments":"{}","call_id":"u","name":"Read","type":"function_call"}'
_WHOLE = lambda status, out: f'{{"created_at":0,"id":"<ID>","model":"m","object":"response","output":{out},"parallel_tool_calls":true,"status":"{status}","tool_choice":"auto","tools":[]}}'
_ITEMS = [
    ("created", ('"response":' + _WHOLE("in_progress", "[]"), "")), ("in_progress", ('"response":' + _WHOLE("in_progress", "[]"), "")),
    ("output_item.added", ('"item":{"content":[],"id":"a","type":"message"},"output_index":0', "")), ("content_part.added", ('"content_index":0,"item_id":"a","output_index":0,"part":{"annotations":[],"text":"","type":"output_text"}', "")),
    ("output_text.delta", ('"content_index":0,"delta":"<H>","item_id":"a","logprobs":[],"output_index":0', "")), ("output_text.done", ('"content_index":0,"item_id":"a","logprobs":[],"output_index":0', '"text":"<H>",')),
    ("content_part.done", ('"content_index":0,"item_id":"a","output_index":0,"part":{"annotations":[],"text":"<H>","type":"output_text"}', "")), ("output_item.done", ('"item":' + _SAY + ',"output_index":0', "")),
    ("output_item.added", ('"item":{"arguments":"","call_id":"u","name":"Read","type":"function_call"},"output_index":2', "")), ("function_call_arguments.delta", ('"delta":"{}","item_id":"item_2","output_index":2', "")),
    ("function_call_arguments.done", ('"arguments":"{}","item_id":"item_2","output_index":2', "")), ("output_item.done", ('"item":' + _CALL + ',"output_index":2', "")), ("completed", ('"response":' + _WHOLE("completed", f'[{_SAY},{{"type":"reasoning"}},{_CALL}]'), ""))]


@query(_event_sql([(f"response.{n}", f'{{{before},"sequence_number":{i},{after}"type":"response.{n}"}}') for i, (n, (before, after)) in enumerate(_ITEMS)]))
def events_responses(spark, sf):
    return _events(spark, sf, B.RESPONSES)


# --- histories replayed ---

_REPLAY = f"""WITH {model.SQL}, {catalog.CALLS}, b AS ({catalog.ORACLES['bound_grep']}), shown AS (SELECT doc_id::VARCHAR AS path, (SELECT string_agg('f' || (k % 3) || ':' || k || ':' || l, chr(10) ORDER BY k) FROM (SELECT unnest(string_split(d.text, chr(10))) AS l, generate_subscripts(string_split(d.text, chr(10)), 1) AS k)) AS t, bounded FROM documents d JOIN b USING (doc_id)),
r AS (SELECT c.conv_id, c.turn, c.id, coalesce(s.t, '') AS t, s.bounded FROM calls c LEFT JOIN shown s USING (path)),
k AS (SELECT r.conv_id, h.turn AS step, r.turn, any_value(r.t) AS t, any_value(r.bounded) AS bounded, CASE WHEN count(DISTINCT c.name) = 1 THEN min(c.name) ELSE '' END AS name, arg_max(c.path, c.turn) FILTER (c.name = 'Read') AS path
  FROM r JOIN calls h ON h.conv_id = r.conv_id AND r.turn <= h.turn JOIN calls c ON c.conv_id = r.conv_id AND c.id = r.id AND c.turn <= h.turn GROUP BY ALL),
g AS (SELECT k.*, length(t) AS raw, f.path IS NOT NULL AS gated, name = 'grep' AND length(t) >= 1500 AS bound, CASE WHEN f.path IS NOT NULL THEN length('sum ' || f.path) END AS gl, CASE WHEN name = 'grep' AND length(t) >= 1500 THEN length('⟪bounded:grep⟫' || chr(10) || bounded) END AS bl
  FROM k LEFT JOIN (SELECT path::VARCHAR AS path FROM files WHERE line_count > 5) f USING (path)),
m AS (SELECT g.conv_id, step, gated, bound, greatest(1, (n + raw) // 4) AS raw, greatest(1, (n + coalesce(bl, raw)) // 4) AS b, greatest(1, (n + coalesce(gl, raw)) // 4) AS ga, greatest(1, (n + coalesce(gl, bl, raw)) // 4) AS gb
  FROM g JOIN (SELECT conv_id, turn, length(coalesce(text, '')) AS n FROM conversations) USING (conv_id, turn)),
h AS (SELECT conv_id, 10 + 5 + greatest(1, (conv_id % 7 + 2) // 4) AS plain, 10 + 5 + CASE WHEN conv_id % 3 = 0 THEN greatest(1, (conv_id % 7 + 2) // 4) ELSE greatest(1, (conv_id % 7 + 2 + {Y.MARK_CHARS}) // 4) END AS cached FROM (SELECT DISTINCT conv_id FROM conversations)),
billed AS (SELECT conv_id AS task, step, (sum(raw) + any_value(plain))::BIGINT AS raw, (sum(b) + any_value(plain))::BIGINT AS bound, (sum(ga) + any_value(plain))::BIGINT AS gate, (sum(gb) + any_value(plain))::BIGINT AS gate_bound, (sum(gb) + any_value(cached))::BIGINT AS gate_bound_cache, bool_or(gated) AS gated, bool_or(bound) AS bounded FROM m JOIN h USING (conv_id) GROUP BY conv_id, step)"""


def _billed(spark, sf) -> DataFrame:
    c = model.read(spark, sf, "conversations")
    calls = catalog._calls(spark, sf).select(F.col("conv_id").alias("task"), F.col("turn").alias("step"), F.lit(0).alias("idx"), "id", "name", F.col("input")["path"].alias("path"))
    lines = F.transform(F.split("text", "\n", -1), lambda x, i: F.concat(F.lit("f"), F.pmod(i + 1, F.lit(3)).cast("string"), F.lit(":"), (i + 1).cast("string"), F.lit(":"), x))
    shown = model.files(spark, sf).select(F.col("path").cast("string").alias("path"), F.array_join(lines, "\n").alias("text"))
    results = calls.join(shown, "path", "left").select("task", "step", "idx", "id", "text")
    path = F.col("path").cast("string")
    summaries = model.files(spark, sf).where("line_count > 5").select(path.alias("path"), F.concat(F.lit("sum "), path).alias("summary"))
    none = spark.createDataFrame([], "path string, called_by bigint")
    steps = c.select(F.col("conv_id").alias("task"), F.col("turn").alias("step"), F.length(F.coalesce("text", F.lit(""))).alias("chars"))
    task = F.col("conv_id")
    heads = c.select("conv_id").distinct().select(task.alias("task"), F.lit(40).alias("system_chars"), F.array(F.lit(20), (task % 7 + 2).cast("int")).alias("tool_chars"), (task % 3 == 0).alias("marked"))
    return Y.replayed(steps, Y.result_states(results, calls, summaries, none), heads)


@query(_REPLAY + " SELECT * FROM billed")
def replay_billed(spark, sf):
    """What every step of every conversation bills under raw, bound, gate, gate + bound and with marks."""
    return _billed(spark, sf)


@query(_REPLAY + ", s AS (SELECT task, count(*) AS n_turns, count(*) FILTER (gated) AS gated_turns, count(*) FILTER (bounded) AS bounded_turns, " + ", ".join(f"sum({v})::BIGINT AS {v}" for v in Y.VARIANTS) + " FROM billed GROUP BY 1) SELECT *, " + ", ".join(f"round(100.0::DOUBLE * (raw - {v}) / raw, 2) AS {v}_cut" for v in Y.VARIANTS) + " FROM s")
def replay_totals(spark, sf):
    return Y.totals(_billed(spark, sf))
