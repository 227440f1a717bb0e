"""Queries of the operators on agents' turns, paths, reads and displays, each with its SQL twin."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratalens.functions import text as T
from stratalens.operators import agent as P
from stratalens.operators import graph as G
from stratalens.operators import loop as L
from stratalens.operators import maintain as M
from stratalens.operators import measure as A
from stratalens.operators import postings as Postings
from stratalens.operators import render as R
from stratalens.operators import search as X
from stratalens.operators import transcript as C
from stratalens.plans import catalog, model
from stratalens.plans.catalog import CALLS, FILE_TOKENS, ORACLES, TOKENS, query
from stratalens.sources import repo as S
from stratalens.sources.versions import shared_dir
from stratalens.streaming import watch as W

# --- wire shapes and turns ---

WIRES = """w AS (SELECT conv_id * 100 + turn AS rid, ['messages', 'chat', 'responses'][(turn % 3 + 1)::INT] AS wire, conv_id, turn, 'c' || conv_id || '-' || turn AS id FROM conversations)"""


def _responses(spark, sf) -> DataFrame:
    """A response in one of three shapes for each turn: two calls, the second one's arguments broken in every fifth."""
    t = model.read(spark, sf, "conversations").select((F.col("conv_id") * 100 + F.col("turn")).alias("rid"), "conv_id", "turn")
    i = F.concat(F.lit("c"), F.col("conv_id").cast("string"), F.lit("-"), F.col("turn").cast("string"))
    args = lambda v: F.concat(F.lit('{"path":"p'), v.cast("string"), F.lit('"}'))
    second = F.when(F.col("conv_id") % 5 == 0, F.lit("{broken")).otherwise(args(F.col("turn")))
    quoted = lambda c: F.concat(F.lit('"'), F.replace(c, F.lit('"'), F.lit('\\"')), F.lit('"'))
    fill = lambda shape, *parts: F.format_string(shape, *parts)
    messages = fill('{"content":[{"type":"text","text":"hm"},{"type":"tool_use","id":"%s","name":"Read","input":%s},{"type":"tool_use","id":"%sb","name":"grep","input":%s}]}', i, args(F.col("conv_id")), i, args(F.col("turn")))
    chat = fill('{"choices":[{"message":{"tool_calls":[{"id":"%s","function":{"name":"Read","arguments":%s}},{"id":"%sb","function":{"name":"grep","arguments":%s}}]}}]}', i, quoted(args(F.col("conv_id"))), i, quoted(second))
    items = fill('{"output":[{"type":"reasoning"},{"type":"function_call","call_id":"%s","name":"Read","arguments":%s},{"type":"function_call","call_id":"%sb","name":"grep","arguments":%s}]}', i, quoted(args(F.col("conv_id"))), i, quoted(second))
    wire = F.element_at(F.array(*map(F.lit, P.CALL_SCHEMAS)), (F.col("turn") % 3 + 1).cast("int"))
    return t.select("rid", wire.alias("wire"), F.when(wire == "messages", messages).when(wire == "chat", chat).otherwise(items).alias("body"))


@query(f"""WITH {WIRES} SELECT rid, CASE WHEN wire = 'x' THEN 9 ELSE 0 END::INT AS seq, id, 'Read' AS name, 'p' || conv_id AS path FROM w
UNION ALL SELECT rid, 1::INT, id || 'b', 'grep', CASE WHEN wire <> 'messages' AND conv_id % 5 = 0 THEN NULL ELSE 'p' || turn END FROM w""")
def tool_calls(spark, sf):
    return P.tool_calls(_responses(spark, sf)).select("rid", "seq", "id", "name", F.col("input")["path"].alias("path"))


@query(f"""WITH {WIRES}, x AS (SELECT *, '"' || id || '"' AS q, '"text ' || turn || '"' AS t FROM w)
SELECT rid, CASE wire WHEN 'messages' THEN '{{"role":"user","content":[{{"type":"tool_result","tool_use_id":' || q || ',"content":' || t || '}}]}}'
  WHEN 'chat' THEN '[{{"role":"tool","tool_call_id":' || q || ',"content":' || t || '}}]' ELSE '[{{"type":"function_call_output","call_id":' || q || ',"output":' || t || '}}]' END AS sent,
  CASE wire WHEN 'messages' THEN '{{"role":"assistant","stop_reason":"end_turn","content":[{{"type":"text","text":"{P.BUDGET_SPENT}"}}]}}'
  WHEN 'chat' THEN '{{"choices":[{{"message":{{"role":"assistant","content":"{P.BUDGET_SPENT}"}},"finish_reason":"stop"}}]}}' ELSE '{{"output":[{{"type":"message","role":"assistant","content":[{{"type":"output_text","text":"{P.BUDGET_SPENT}"}}]}}]}}' END AS closing FROM x""")
def sent_back(spark, sf):
    t = model.read(spark, sf, "conversations")
    wire = F.element_at(F.array(*map(F.lit, P.CALL_SCHEMAS)), (F.col("turn") % 3 + 1).cast("int"))
    i = F.concat(F.lit("c"), F.col("conv_id").cast("string"), F.lit("-"), F.col("turn").cast("string"))
    return t.select((F.col("conv_id") * 100 + F.col("turn")).alias("rid"), P.sent_back(wire, F.array(i), F.array(F.concat(F.lit("text "), F.col("turn").cast("string")))).alias("sent"), P.terminal(wire, F.lit(P.BUDGET_SPENT)).alias("closing"))


#: A log with two reads of each file by neighbouring turns, virtual calls, some turns without calls, some with a call of the host's.
LOGGED = """logged AS (SELECT conv_id, turn, 0 AS idx, 'Read' AS name, ((conv_id * 8 + turn // 2) % 1000)::VARCHAR AS path FROM conversations WHERE (conv_id + turn) % 5 <> 4 AND turn % 3 <> 2
UNION ALL SELECT conv_id, turn, 1, 'index_callers', 'x' FROM conversations WHERE (conv_id + turn) % 5 <> 4 UNION ALL SELECT conv_id, turn, 2, 'grep', 'x' FROM conversations WHERE (conv_id + turn) % 11 = 3),
known AS (SELECT DISTINCT conv_id, ((conv_id * 8) % 1000)::VARCHAR AS path FROM conversations WHERE conv_id % 6 = 0)"""


def _logged(spark, sf) -> DataFrame:
    c, t = F.col("conv_id"), F.col("turn")
    call = lambda i, name, path: F.struct(F.lit(i).alias("idx"), F.lit(name).alias("name"), F.create_map(F.lit("path"), path).alias("input"))
    none = (c + t) % 5 == 4
    reads = F.when(~none & (t % 3 != 2), call(0, "Read", ((c * 8 + F.floor(t / 2)) % 1000).cast("string")))
    of = F.array_compact(F.array(reads, F.when(~none, call(1, "index_callers", F.lit("x"))), F.when((c + t) % 11 == 3, call(2, "grep", F.lit("x")))))
    return model.read(spark, sf, "conversations").select("conv_id", "turn", F.explode(of).alias("x")).select("conv_id", "turn", "x.*")


def _loop_sql(most: int, remember: bool) -> str:
    """The loop as a recursion over turns, one state a conversation and turn."""
    kept = "f.seen" if remember else "f.given"
    return f"""WITH RECURSIVE {model.SQL}, {LOGGED}, c AS (SELECT l.*, f.path AS large FROM logged l LEFT JOIN (SELECT path::VARCHAR AS path FROM files WHERE line_count > 5) f ON l.name = 'Read' AND f.path = l.path),
k AS (SELECT conv_id, turn, count(*) AS n, count(*) FILTER (name = 'grep' OR name = 'Read' AND large IS NULL) AS n_host, coalesce(list(DISTINCT large) FILTER (large IS NOT NULL), []) AS reads FROM c GROUP BY 1, 2),
o AS (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS i, coalesce(n, 0) AS n, coalesce(n_host, 0) AS n_host, coalesce(reads, []) AS reads FROM (SELECT DISTINCT conv_id, turn FROM conversations) LEFT JOIN k USING (conv_id, turn)),
f AS (SELECT conv_id, 0::BIGINT AS i, NULL::BIGINT AS turn, 0::BIGINT AS n, 0::BIGINT AS "inner", '' AS action, []::VARCHAR[] AS gated, given, given AS seen
    FROM (SELECT DISTINCT conv_id FROM conversations) LEFT JOIN (SELECT conv_id, list(path) AS g FROM known GROUP BY 1) USING (conv_id), LATERAL (SELECT coalesce(g, []) AS given)
  UNION ALL SELECT o.conv_id, o.i, o.turn, o.n, CASE WHEN a = 'answer' THEN f.inner + 1 ELSE 0 END, a, CASE WHEN a IN ('answer', 'forward') THEN list_sort(fresh) ELSE [] END, f.given, CASE WHEN a = 'answer' THEN list_concat(f.seen, fresh) ELSE {kept} END
    FROM f JOIN o ON o.conv_id = f.conv_id AND o.i = f.i + 1, LATERAL (SELECT list_filter(o.reads, lambda x: NOT list_contains(f.seen, x)) AS fresh),
    LATERAL (SELECT CASE WHEN f.inner = {most} THEN 'terminal' WHEN o.n = 0 THEN 'final' WHEN o.n_host > 0 OR len(fresh) < len(o.reads) THEN 'forward' ELSE 'answer' END AS a))"""


def _loop(spark, sf, most: int, remember: bool) -> DataFrame:
    f = model.files(spark, sf).select(F.col("path").cast("string").alias("path"), "line_count")
    known = model.read(spark, sf, "conversations").where("conv_id % 6 = 0").select("conv_id", ((F.col("conv_id") * 8) % 1000).cast("string").alias("path"))
    return L.gate_loop(model.read(spark, sf, "conversations"), _logged(spark, sf), f, known, 5, most, remember)


@query(_loop_sql(2, True) + ' SELECT conv_id, turn, n AS n_calls, "inner", action, gated FROM f WHERE i > 0')
def turn_actions(spark, sf):
    """The loop over whole conversations: an answered read is seen for good."""
    return _loop(spark, sf, 2, True)


@query(_loop_sql(3, False) + ' SELECT conv_id, turn, n AS n_calls, "inner", action, gated FROM f WHERE i > 0')
def request_actions(spark, sf):
    """The loop request by request: the host's own log lacks what was answered in between."""
    return _loop(spark, sf, 3, False)


@query(_loop_sql(P.MAX_INNER_TURNS, True) + """ SELECT c.conv_id, c.turn, c.idx, f.action, CASE WHEN c.name = 'index_callers' THEN 'virtual' WHEN list_contains(f.gated, c.large) THEN 'gated' ELSE 'host' END AS kind FROM c JOIN f USING (conv_id, turn)""")
def loop_calls(spark, sf):
    f = model.files(spark, sf).select(F.col("path").cast("string").alias("path"), "line_count")
    return L.loop_calls(_logged(spark, sf), f, _loop(spark, sf, P.MAX_INNER_TURNS, True), 5).select("conv_id", "turn", "idx", "action", "kind")


#: Calls of every tool by the conversations' turns, on documents.
ASKED = """asked AS (SELECT conv_id, turn, 'c' || turn AS id, ['index_read', 'index_read_full', 'index_read_symbol', 'index_read_range', 'index_edit', 'index_impact', 'index_search', 'index_nothing', 'Read'][((conv_id * 8 + turn) % 9 + 1)::INT] AS name, ((conv_id * 8 + turn) % 1000)::VARCHAR AS path FROM conversations),
doc AS (SELECT doc_id::VARCHAR AS path, 'f' || doc_id AS label, text, string_split(text, chr(10)) AS l FROM documents),
cut AS (SELECT *, CASE WHEN text = '' THEN []::VARCHAR[] WHEN l[-1] = '' THEN l[:-2] ELSE l END AS ls FROM doc)"""


def _region_sql(label: str, lines: str, a: int, b: int) -> str:
    last = f"greatest({a}, least(len({lines}), {b}))"
    return f"""CASE WHEN len({lines}) = 0 THEN '[' || {label} || ', no lines]' WHEN {a} > len({lines}) THEN '[no line {a}: the file has ' || len({lines}) || ']' ELSE '[' || {label} || ', lines {a} to ' || {last} || ']' || chr(10) || array_to_string({lines}[{a}:{last}], chr(10)) END"""


@query(f"""WITH MODEL, {ASKED}, imp AS (SELECT to_path::VARCHAR AS path, '[' || string_agg(DISTINCT '"' || from_path || '"', ',' ORDER BY '"' || from_path || '"') || ']' AS found FROM resolved WHERE kind = 'call' AND to_path <> from_path GROUP BY 1)
SELECT a.conv_id, a.turn, a.id, CASE a.name WHEN 'index_read' THEN coalesce('sum ' || CASE WHEN c.path::BIGINT % 2 = 0 THEN c.path END, '(file not indexed)')
  WHEN 'index_read_full' THEN CASE WHEN c.path IS NULL THEN '(no file ' || a.path || ')' ELSE c.text END
  WHEN 'index_read_symbol' THEN CASE WHEN c.path IS NULL THEN '[no symbol sym in ' || a.path || '; index_read lists those it has]' WHEN c.path::BIGINT % 3 = 0 THEN '[no symbol sym in ' || c.label || '; index_read lists those it has]' ELSE {_region_sql('c.label', 'c.ls', 1, 3)} END
  WHEN 'index_read_range' THEN CASE WHEN c.path IS NULL THEN '(no file ' || a.path || ')' ELSE {_region_sql('c.label', 'c.ls', 2, 4)} END
  WHEN 'index_edit' THEN CASE WHEN c.path IS NULL THEN '(no file ' || a.path || ')' WHEN len(string_split(c.text, ' the ')) = 2 THEN '(edited)' ELSE '(refused: `old` must occur exactly once)' END
  WHEN 'index_impact' THEN coalesce(imp.found, '[]') WHEN 'index_search' THEN '[]' ELSE '(unknown tool: index_nothing)' END AS answer
FROM asked a LEFT JOIN cut c ON c.path = a.path LEFT JOIN imp ON imp.path = a.path WHERE starts_with(a.name, 'index_')""")
def virtual_answers(spark, sf):
    i = F.col("conv_id") * 8 + F.col("turn")
    names = ("index_read", "index_read_full", "index_read_symbol", "index_read_range", "index_edit", "index_impact", "index_search", "index_nothing", "Read")
    key = F.pmod(i, F.lit(1000)).cast("string")
    given = F.create_map(*(x for k, v in {"path": key, "symbol": F.lit("sym"), "start": F.lit("2"), "end": F.lit("4"), "old": F.lit(" the "), "new": F.lit(" a ")}.items() for x in (F.lit(k), v)))
    calls = model.read(spark, sf, "conversations").select("conv_id", "turn", F.concat(F.lit("c"), F.col("turn").cast("string")).alias("id"), F.element_at(F.array(*map(F.lit, names)), (F.pmod(i, F.lit(9)) + 1).cast("int")).alias("name"), given.alias("input"))
    path = F.col("path").cast("string")
    files = model.files(spark, sf).select(path.alias("path"), F.concat(F.lit("f"), path).alias("label"), "text", F.when(F.col("path") % 2 == 0, F.concat(F.lit("sum "), path)).alias("summary"))
    symbols = model.files(spark, sf).where("path % 3 <> 0").select(path.alias("path"), F.lit("sym").alias("name"), F.lit(1).alias("line"), F.lit(3).alias("end_line"))
    r = catalog._resolved(spark, sf).where("kind = 'call' and to_path <> from_path")
    lists = r.select(F.lit("impact").alias("tool"), F.col("to_path").cast("string").alias("key"), F.col("from_path").cast("string").alias("value"))
    return P.answers(calls, files, symbols, lists)


#: Lists that the call graph and the text index answer with; each conversation asks for one of each.
LISTED = """ask AS (SELECT conv_id, turn, 'c' || turn AS id, ['callers', 'callees', 'search'][(turn % 3 + 1)::INT] AS tool, CASE turn % 3 WHEN 0 THEN 'URGENT.d1995' || lpad((conv_id % 12 + 1)::VARCHAR, 2, '0') || lpad((turn % 28 + 1)::VARCHAR, 2, '0') WHEN 1 THEN (conv_id % 100)::VARCHAR ELSE ['onst', 'thsh', 'zzz'][(conv_id % 3 + 1)::INT] END AS key FROM conversations)"""


@query(f"""WITH MODEL, {LISTED}, {catalog.TOKENS}, l AS (SELECT 'callers' AS tool, to_name AS key, from_path::VARCHAR AS v FROM edges WHERE kind = 'call' UNION SELECT 'callees', from_path::VARCHAR, to_name FROM resolved WHERE kind = 'call' AND to_path IS NOT NULL
  UNION SELECT 'search', w, path FROM (SELECT w, path::VARCHAR AS path, row_number() OVER (PARTITION BY w ORDER BY path) AS r FROM pad, unnest(['onst', 'thsh', 'zzz']) u(w) WHERE list_contains(tokens, w)) WHERE r <= 15),
f AS (SELECT tool, key, '[' || string_agg('"' || v || '"', ',' ORDER BY v) || ']' AS found FROM l GROUP BY 1, 2)
SELECT conv_id, turn, id, coalesce(found, '[]') AS answer FROM ask LEFT JOIN f USING (tool, key)""")
def virtual_lists(spark, sf):
    """Callers, callees and searches, asked for by calls and answered from the call graph and the text index."""
    c, t = F.col("conv_id"), F.col("turn")
    two = lambda x: F.lpad(x.cast("string"), 2, "0")
    symbol = F.concat(F.lit("URGENT.d1995"), two(c % 12 + 1), two(t % 28 + 1))
    word = F.element_at(F.array(*map(F.lit, ("onst", "thsh", "zzz"))), (c % 3 + 1).cast("int"))
    given = F.when(t % 3 == 0, F.create_map(F.lit("symbol"), symbol)).when(t % 3 == 1, F.create_map(F.lit("path"), (c % 100).cast("string"))).otherwise(F.create_map(F.lit("text"), word))
    name = F.element_at(F.array(*map(F.lit, ("index_callers", "index_callees", "index_search"))), (t % 3 + 1).cast("int"))
    calls = model.read(spark, sf, "conversations").select("conv_id", "turn", F.concat(F.lit("c"), t.cast("string")).alias("id"), name.alias("name"), given.alias("input"))
    edges, index = model.edges(spark, sf), catalog._index(spark, sf)
    asked = calls.where("name = 'index_callers'").select(F.col("input")["symbol"].alias("name")).distinct()
    listed = lambda tool, df, key, value: df.select(F.lit(tool).alias("tool"), F.col(key).cast("string").alias("key"), F.col(value).cast("string").alias("value"))
    lists = listed("callers", G.callers(edges, asked).where("how = 'exact'"), "symbol", "from_path").union(listed("callees", G.callees(catalog._resolved(spark, sf)), "from_path", "to_name"))
    for w in ("onst", "thsh", "zzz"):
        lists = lists.union(X.search(index, w).select(F.lit("search"), F.lit(w), F.col("path").cast("string")))
    none = spark.createDataFrame([], "path string, label string, text string, summary string")
    return P.answers(calls, none, spark.createDataFrame([], "path string, name string, line int, end_line int"), lists)


@query("""SELECT doc_id AS path, CASE WHEN len(string_split(text, ' the ')) = 2 THEN 2 ELSE 1 END::BIGINT AS n_edited FROM documents WHERE len(string_split(text, ' the ')) = 2 OR (doc_id % 3 = 0 AND text <> '')""")
def edits_indexed(spark, sf):
    """Edits carried out in order, the changed files indexed again, and found by what the edits brought in."""
    f = model.files(spark, sf).select("path", "text")
    first = f.where("length(text) - length(replace(text, ' the ', '')) = 5 AND size(split(text, ' the ', -1)) = 2").select("path")
    one = f.select("path", F.lit(1).alias("seq"), F.lit(" the ").alias("old"), F.lit(" zzedited zzagain ").alias("new"))
    two = first.select("path", F.lit(2).alias("seq"), F.lit(" zzagain ").alias("old"), F.lit(" zztwice ").alias("new"))
    whole = f.where("path % 3 = 0 and text <> ''").select("path", F.lit(3).alias("seq"), F.col("text").alias("old"), F.lit("zzwhole").alias("new"))
    out = M.apply_edits(f, one.union(two)).unionByName(M.apply_edits(f.join(first, "path", "left_anti"), whole))
    folder = f"{shared_dir(spark)}/edited-{uuid.uuid4().hex}"
    index = Postings.Index.create(f, folder, "path", "text").add(M.edited(out), "path", "text")
    return index.found("zzedited NOT zzagain").select(F.col("doc").alias("path"), F.lit(2).cast("bigint").alias("n_edited")).union(index.found("^zzwhole").select(F.col("doc"), F.lit(1).cast("bigint")))


@query(f"""WITH MODEL, {CALLS}, r AS (SELECT conv_id, turn, 'c' || turn AS id, text FROM conversations), p AS (SELECT conv_id, id, path FROM calls WHERE name = 'Read')
SELECT r.conv_id, r.turn, CASE WHEN f.path IS NULL THEN r.text ELSE '⟪summary:' || p.path || '⟫' || chr(10) || 's' || p.path END AS text
FROM r LEFT JOIN p ON p.conv_id = r.conv_id AND p.id = r.id LEFT JOIN (SELECT path::VARCHAR AS path FROM files WHERE line_count > 5) f ON f.path = p.path""")
def gate_results(spark, sf):
    results = model.read(spark, sf, "conversations").select("conv_id", "turn", F.concat(F.lit("c"), F.col("turn").cast("string")).alias("id"), "text")
    path = F.col("path").cast("string")
    summaries = model.files(spark, sf).where("line_count > 5").select(path.alias("path"), F.concat(F.lit("s"), path).alias("summary"))
    return C.gate_results(results, catalog._calls(spark, sf), summaries).select("conv_id", "turn", "text")


@query(f"""WITH b AS ({ORACLES['bound_grep']}), d AS (SELECT doc_id, doc_id % 50 AS conv_id, ['grep', 'Read', 'dup'][(doc_id % 3 + 1)::INT] AS name, text, row_number() OVER (PARTITION BY doc_id % 50 ORDER BY doc_id DESC) AS rn FROM documents),
t AS (SELECT d.*, (SELECT string_agg('f' || (k % 3) || ':' || k || ':' || l, chr(10) ORDER BY k) FROM (SELECT unnest(string_split(d.text, chr(10))) AS l, generate_subscripts(string_split(d.text, chr(10)), 1) AS k)) AS shown FROM d)
SELECT doc_id, CASE WHEN rn > 2 AND name = 'grep' AND length(shown) >= 1500 THEN '⟪bounded:grep⟫' || chr(10) || bounded ELSE shown END AS text FROM t JOIN b USING (doc_id)""")
def bound_results(spark, sf):
    d = model.read(spark, sf, "documents").select("doc_id", (F.col("doc_id") % 50).alias("conv_id"), F.col("doc_id").alias("turn"), F.lit(0).alias("idx"), F.concat(F.lit("r"), F.col("doc_id").cast("string")).alias("id"), "text")
    lines = F.transform(F.split("text", "\n", -1), lambda x, i: F.concat(F.lit("f"), F.pmod(i + 1, F.lit(3)).cast("string"), F.lit(":"), (i + 1).cast("string"), F.lit(":"), x))
    named = d.select("conv_id", "id", F.element_at(F.array(F.lit("grep"), F.lit("Read"), F.lit("grep")), (F.col("doc_id") % 3 + 1).cast("int")).alias("name"))
    calls = named.union(d.where("doc_id % 3 = 2").select("conv_id", "id", F.lit("other")))  # one id, two tools: nobody's
    none = spark.createDataFrame([], "path string, called_by bigint")
    return C.bound_results(d.withColumn("text", F.array_join(lines, "\n")), calls, none).select("doc_id", "text")


@query(f"""SELECT conv_id, CASE WHEN s IS NULL THEN '{P.DIRECTIVE}' ELSE s || chr(10) || chr(10) || '{P.DIRECTIVE}' END AS system, CASE WHEN list_contains(have, 'read') THEN 3 ELSE 4 END AS n_tools,
  (CASE WHEN s IS NULL THEN 0 ELSE greatest(1, length(s) // 4) END + 4 + n)::BIGINT AS tokens, cached
FROM (SELECT conv_id, min(text) FILTER (role = 'system') AS s, CASE WHEN conv_id % 2 = 0 THEN ['read', 'x'] ELSE ['y', 'x'] END AS have,
  coalesce(sum(greatest(1, length(text) // 4)) FILTER (role <> 'system'), 0) AS n, CASE WHEN conv_id % 3 = 0 THEN 0 ELSE max(turn) END AS cached FROM conversations GROUP BY 1)""")
def prepared_requests(spark, sf):
    """Each conversation's request: the directive, two more tools unless taken, its tokens, and where the cache mark sits."""
    t = model.read(spark, sf, "conversations")
    blocks = F.array_sort(F.collect_list(F.struct("turn", "text", ((F.col("conv_id") % 3 == 0) & (F.col("turn") == 0)).alias("cached"))))
    g = t.groupBy("conv_id").agg(F.min(F.when(F.col("role") == "system", F.col("text"))).alias("s"), blocks.alias("blocks"), F.array_sort(F.collect_list(F.when(F.col("role") != "system", F.struct("turn", "text")))).alias("m"))
    tool = lambda n: F.struct(F.lit(n).alias("name"))
    have = F.when(F.col("conv_id") % 2 == 0, F.array(tool("read"), tool("x"))).otherwise(F.array(tool("y"), tool("x")))
    tools = C.add_tools(have, F.array(tool("read"), tool("z")))
    marked = C.mark_last(C.mark_last(F.col("blocks")))
    texts = F.transform("m", lambda x: x["text"])
    return g.select("conv_id", P.with_directive(P.with_directive(F.col("s"))).alias("system"), F.size(C.add_tools(tools, F.array(tool("read"), tool("z")))).alias("n_tools"),
                    P.body_tokens(F.col("s"), F.array(*map(F.lit, ("t" * 8, "u" * 8))), texts).alias("tokens"), F.filter(marked, lambda b: b["cached"])[0]["turn"].alias("cached"))


@query("""WITH t AS (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS k, text FROM conversations)
SELECT conv_id AS task, turn AS step, (2 * k)::BIGINT AS n_messages, sum(4 + length(text)) OVER (PARTITION BY conv_id ORDER BY turn)::BIGINT AS n_chars FROM t""")
def growing_history(spark, sf):
    return P.growing_history(model.read(spark, sf, "conversations").select(F.col("conv_id").alias("task"), F.col("turn").alias("step"), F.lit("call").alias("call"), F.col("text").alias("result")))


@query(f"""WITH MODEL, f AS (SELECT path, path % 40 AS task, coalesce(text, '') AS text, line_count, CASE WHEN path % 2 = 0 THEN 'refreshed: now' || chr(10) || 's' || path END AS summary FROM files),
p AS (SELECT task, path, '--- ' || path || ' (whole)' || chr(10) || text AS c, CASE WHEN line_count > 5 THEN '--- ' || path || ' (summary)' || chr(10) || '⟪summary:' || path || '⟫' || chr(10) || CASE WHEN summary IS NULL THEN '(file not indexed)' ELSE 's' || path END || chr(10) || chr(10) || '{P.FOOTER}'
  ELSE '--- ' || path || ' (whole, as it is short)' || chr(10) || text END AS t FROM f)
SELECT task, sha256(string_agg(c, chr(10) || chr(10) ORDER BY path)) AS control, sha256(string_agg(t, chr(10) || chr(10) ORDER BY path)) AS treatment, sum(length(t))::BIGINT + 2 * (count(*) - 1) AS treatment_chars FROM p GROUP BY 1""")
def paired_contexts(spark, sf):
    summary = F.when(F.col("path") % 2 == 0, F.concat(F.lit("refreshed: now\ns"), F.col("path").cast("string")))
    f = model.files(spark, sf).select("path", (F.col("path") % 40).alias("task"), "text", "line_count", summary.alias("summary"))
    return P.contexts(f, 5).select("task", F.sha2("control", 256).alias("control"), F.sha2("treatment", 256).alias("treatment"), F.length("treatment").cast("bigint").alias("treatment_chars"))


# --- documents, reads and displays ---


@query("""WITH l AS (SELECT conv_id AS doc, turn AS page, string_split(text, chr(10)) AS l, text FROM conversations), n AS (SELECT doc, page, CASE WHEN text = '' THEN 0 WHEN l[-1] = '' THEN len(l) - 1 ELSE len(l) END::BIGINT AS n_lines FROM l)
SELECT doc, page, n_lines, (1 + coalesce(sum(n_lines) OVER (PARTITION BY doc ORDER BY page ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::BIGINT AS start FROM n""")
def page_starts(spark, sf):
    return P.page_starts(model.read(spark, sf, "conversations").select(F.col("conv_id").alias("doc"), F.col("turn").alias("page"), "text")).drop("text")


@query(f"""WITH l AS (SELECT doc_id, text, string_split(text, chr(10)) AS l FROM documents), c AS (SELECT doc_id, text, l, 'f' || doc_id AS label, CASE WHEN text = '' THEN []::VARCHAR[] WHEN l[-1] = '' THEN l[:-2] ELSE l END AS ls FROM l)
SELECT doc_id AS path, {_region_sql('label', 'ls', 2, 5)} AS region, CASE WHEN len(l) > 5 THEN array_to_string(l[:5], chr(10)) || chr(10) || '(truncated at 5 of ' || len(l) || ' lines)' ELSE text END AS head,
  CASE WHEN len(string_split(text, ' the ')) = 2 THEN replace(text, ' the ', ' a ') END AS edited, coalesce(text, '') AS unstamped,
  CASE WHEN length(text) >= 4000 THEN '≈ ' || round_even(length(text) / 4 / 1000, 0)::BIGINT || 'k tokens' ELSE '≈ ' || round_even(length(text) / 4, 0)::BIGINT || ' tokens' END AS display FROM c""")
def file_reads(spark, sf):
    d, text = model.read(spark, sf, "documents"), F.col("text")
    stamped = F.concat(F.lit("refreshed: then\n"), F.coalesce(text, F.lit("")), F.lit("\nrefreshed: now"))
    label = F.concat(F.lit("f"), F.col("doc_id").cast("string"))
    return d.select(F.col("doc_id").alias("path"), P.region(label, text, F.lit(2), F.lit(5)).alias("region"), T.read_full(text, 5).alias("head"), T.replace_unique(text, F.lit(" the "), F.lit(" a ")).alias("edited"), T.strip_timestamp(stamped).alias("unstamped"), T.approx_tokens(F.length(text)).alias("display"))


@query(f"""WITH {catalog.TREE} SELECT doc_id, CASE WHEN contains(path, 'node_modules') THEN 'node_modules' ELSE split_part(path, '/', 3) END AS folder, path ILIKE '%SRC1_/F%' AS matches, starts_with(path, '/r/src1/') AS inside FROM tree""")
def path_labels(spark, sf):
    t, path = catalog._tree(spark, sf), F.col("path")
    return t.select("doc_id", T.folder_label(path).alias("folder"), T.like(path, "%SRC1_/F%").alias("matches"), T.confined(path, "/r/src1").alias("inside"))


@query("""SELECT event_id, [try_cast(x AS INT) FOR x IN string_split(value::DECIMAL(12, 2)::VARCHAR, '.')] AS version, json_extract_string(props, '$.k') AS k,
  CASE event_id % 3 WHEN 0 THEN event_id WHEN 1 THEN event_id + 1 ELSE 0 END AS output_tokens FROM events""")
def decoded_fields(spark, sf):
    e, i = model.read(spark, sf, "events"), F.col("event_id")
    usage = F.when(i % 3 == 0, F.format_string('{"usage":{"output_tokens":%d}}', i)).when(i % 3 == 1, F.format_string('{"usage":{"completion_tokens":%d}}', i + 1)).otherwise(F.lit("{no json"))
    return e.select("event_id", T.version_tuple(F.concat(F.lit("v"), F.col("value").cast("decimal(12,2)").cast("string"))).alias("version"), C.json_or_empty(F.col("props"))["k"].alias("k"), C.output_tokens(usage).alias("output_tokens"))


@query(f"WITH MODEL, {FILE_TOKENS} SELECT path, line_count, full_tokens, short_tokens, round(CASE WHEN full_tokens = 0 THEN 0 ELSE 100.0::DOUBLE * (full_tokens - short_tokens) / full_tokens END, 4) AS cut FROM ft WHERE line_count > 5 ORDER BY full_tokens DESC, path LIMIT 25")
def top_files(spark, sf):
    return A.top_files(catalog._file_tokens(spark, sf), 5, 25)


@query("""WITH MODEL SELECT path, sha256, left(text, 10) AS summary FROM files WHERE line_count > 5 AND length(text) % 3 <> 0 ORDER BY path LIMIT 40""")
def summarize_budget(spark, sf):
    todo = M.queue(model.files(spark, sf), catalog._cache(spark, sf).where("false"), 5)
    return M.within_budget(M.summarize(todo, lambda t: t[:10] if len(t) % 3 else None), 40)


# --- search over summaries, incremental step, changes ---


@query(f"""WITH s AS ({ORACLES['summary_render']}), files AS (SELECT path, text FROM s), {TOKENS} SELECT path FROM pad WHERE list_contains(tokens, 'high') AND NOT list_contains(tokens, 'urgent')""")
def search_summaries(spark, sf):
    return catalog._index(spark, sf, "summaries").found("high NOT urgent").select(F.col("doc").alias("path"))


@query(f"""WITH MODEL, {TOKENS}, p AS (SELECT * FROM pad WHERE list_contains(tokens, 'the') ORDER BY path LIMIT 50),
h AS (SELECT path, tokens, len(tokens) AS n, [i - 1 FOR i IN range(1, len(tokens) + 1) IF tokens[i] = 'the'] AS hits FROM p),
b AS (SELECT *, list_transform(hits, lambda a: {{'s': 1000 + len(list_filter(hits, lambda x: x >= a AND x < a + 8)) - 1, 'f': -a, 'l': list_max(list_filter(hits, lambda x: x >= a AND x < a + 8))}}) AS sc FROM h),
m AS (SELECT *, list_max(sc) AS best FROM b), s AS (SELECT *, greatest(0, least((-best.f) - floor((8 - (best.l + 1 + best.f)) / 2), n - 8))::INT AS st FROM m)
SELECT path, CASE WHEN st > 0 THEN '...' ELSE '' END || array_to_string([CASE WHEN x = 'the' THEN '<<the>>' ELSE x END FOR x IN tokens[st + 1:st + 8]], ' ') || CASE WHEN st + 8 < n THEN '...' ELSE '' END AS snippet, CASE WHEN path % 2 = 0 THEN 'a_THE_' || path END AS symbol FROM s""")
def search_snippets(spark, sf):
    """The pool of a search for one word with excerpts of 8 tokens, and the first symbol whose name holds the word."""
    names = model.files(spark, sf).where("path % 2 = 0").select("path", F.explode(F.array(F.struct(F.lit(2).alias("line"), F.lit("b_the").alias("name")), F.struct(F.lit(1).alias("line"), F.concat(F.lit("a_THE_"), F.col("path").cast("string")).alias("name")))).alias("x")).select("path", "x.*")
    hits = X.search(catalog._index(spark, sf), "the", symbols=names, limit=50, pool=50, size=8)
    return hits.select("path", "snippet", "symbol")


@query("""WITH MODEL, ch AS (SELECT DISTINCT path FROM symbols WHERE path % 97 = 0), s2 AS (SELECT * FROM symbols WHERE path % 97 <> 0 OR kind = 'class'),
r2 AS (SELECT e.*, d.to_path FROM edges e LEFT JOIN (SELECT name, min(path) AS to_path FROM s2 GROUP BY name HAVING count(DISTINCT path) = 1) d ON e.to_name = d.name)
SELECT from_path AS path FROM resolved WHERE from_path <> to_path AND to_path IN (FROM ch) UNION SELECT from_path FROM r2 WHERE from_path <> to_path AND to_path IN (FROM ch) UNION FROM ch""")
def sync_refresh(spark, sf):
    """What an incremental step refreshes after every 97th file lost its methods."""
    s, e = model.symbols(spark, sf), catalog._resolved(spark, sf)
    changed = s.where("path % 97 = 0").select("path").distinct()
    return M.sync(s, e, s.where("path % 97 = 0 and kind = 'class'"), e.join(changed.withColumnRenamed("path", "from_path"), "from_path", "left_semi"), changed)[2]


KINDS = {"click": "created", "view": "modified", "signup": "deleted", "purchase": "moved", "error": "modified"}
KINDS_SQL = "CASE event_type " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in KINDS.items()) + " END"


@query(f"""WITH e AS (SELECT event_id, ts, {KINDS_SQL} AS kind, event_type = 'error' AS d, '/r/' || CASE WHEN user_id % 7 = 0 THEN 'dist/' ELSE '' END || 'f' || user_id || ['.py', '.txt', '.key.md'][(user_id % 3 + 1)::INT] AS path FROM events)
SELECT event_id, path, ts FROM e WHERE kind IN ('created', 'modified') AND NOT d AND NOT contains(path, '/dist/') AND NOT ends_with(path, '.txt')""")
def change_events(spark, sf):
    kind = F.create_map(*(F.lit(x) for kv in KINDS.items() for x in kv))[F.col("event_type")]
    ends = F.element_at(F.array(F.lit(".py"), F.lit(".txt"), F.lit(".key.md")), (F.col("user_id") % 3 + 1).cast("int"))
    path = F.concat(F.lit("/r/"), F.when(F.col("user_id") % 7 == 0, "dist/").otherwise(""), F.lit("f"), F.col("user_id").cast("string"), ends)
    e = model.read(spark, sf, "events").select("event_id", "ts", kind.alias("kind"), (F.col("event_type") == "error").alias("is_directory"), path.alias("path"))
    return W.changes(e, S.relevant).select("event_id", "path", "ts")


@query(f"""WITH {catalog.HEADS} SELECT path, idx, line FROM (SELECT *, row_number() OVER (PARTITION BY path ORDER BY line, idx) AS r FROM hd) WHERE r <= 3""")
def outline_heads(spark, sf):
    """The first three headings of each page's outline, in line order."""
    h = catalog._heads(spark, sf).groupBy("path").agg(R.outline(F.collect_list(F.struct("line", "idx"))).alias("h"))
    return h.select("path", F.explode(F.slice("h", 1, 3)).alias("x")).select("path", "x.idx", "x.line")


@query("""WITH MODEL SELECT path, 'f' || (path % 5) AS name, CASE WHEN path % 5 = 0 THEN NULL ELSE 'doc of ' || path END AS doc FROM files""")
def function_docs(spark, sf):
    """Docstrings on demand, from source texts made of the documents' ids."""
    f = model.files(spark, sf).select("path", F.concat(F.lit("f"), (F.col("path") % 5).cast("string")).alias("name"))
    body = F.when(F.col("path") % 5 == 0, F.lit("    pass")).otherwise(F.concat(F.lit('    """\n    doc of '), F.col("path").cast("string"), F.lit('\n    more"""')))
    return S.function_docs(f.withColumn("content", F.concat(F.lit("def "), "name", F.lit("():\n"), body, F.lit("\n"))))


__all__ = ["G", "ORACLES"]
