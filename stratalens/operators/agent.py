"""An agent's turns as tables: calls out of three wire shapes, who answers a turn, the answers, and what is sent back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stratalens.functions import text as T
from stratalens.operators.transcript import SUMMARY_MARK, VIRTUAL_PREFIX, json_or_empty

#: So many turns are answered in a row before the host gets control back.
MAX_INNER_TURNS = 24
BUDGET_SPENT = "The index has answered as many turns in a row as it may; over to the host."
FOOTER = f"(Made from the index. The whole text: {VIRTUAL_PREFIX}read_full(path); who depends on it: {VIRTUAL_PREFIX}impact(path).)"
DIRECTIVE_MARK = "[index]"
DIRECTIVE = f"{DIRECTIVE_MARK} Long files have summaries: begin with {VIRTUAL_PREFIX}read(path) and go on with {VIRTUAL_PREFIX}read_range or {VIRTUAL_PREFIX}read_symbol where they point."
TOOLS = ("read", "read_full", "read_symbol", "read_range", "edit", "impact", "callers", "callees", "search")

# Where each wire shape keeps its calls.
CALL_SCHEMAS = {
    "messages": "content array<struct<type:string,id:string,name:string,input:string>>",
    "chat": "choices array<struct<message:struct<tool_calls:array<struct<id:string,function:struct<name:string,arguments:string>>>>>>",
    "responses": "output array<struct<type:string,call_id:string,name:string,arguments:string>>",
}


def tool_calls(responses: DataFrame) -> DataFrame:
    """(rid, seq, id, name, input) of all calls in responses (rid, wire, body: JSON text); arguments that are no JSON are {}."""
    body = {w: F.from_json("body", f"struct<{s.replace(' ', ':', 1)}>") for w, s in CALL_SCHEMAS.items()}
    row = lambda i, n, a: F.struct(F.coalesce(i, F.lit("")).alias("id"), F.coalesce(n, F.lit("")).alias("name"), json_or_empty(F.coalesce(a, F.lit("{}"))).alias("input"))
    of = {
        "messages": F.transform(F.filter(body["messages"]["content"], lambda b: b["type"] == "tool_use"), lambda b: row(b["id"], b["name"], b["input"])),
        "chat": F.transform(F.get(body["chat"]["choices"], F.lit(0))["message"]["tool_calls"], lambda c: row(c["id"], c["function"]["name"], c["function"]["arguments"])),
        "responses": F.transform(F.filter(body["responses"]["output"], lambda b: b["type"] == "function_call"), lambda b: row(b["call_id"], b["name"], b["arguments"])),
    }
    calls = F.coalesce(*(F.when(F.col("wire") == w, c) for w, c in of.items()))
    return responses.select("rid", F.posexplode(calls).alias("seq", "x")).select("rid", "seq", "x.id", "x.name", "x.input")


def sent_back(wire: Column, ids: Column, texts: Column) -> Column:
    """The message (messages) or items (other shapes) that carry the results of a turn, as JSON text."""
    both = F.arrays_zip(ids.alias("i"), texts.alias("t"))
    blocks = F.transform(both, lambda x: F.struct(F.lit("tool_result").alias("type"), x["i"].alias("tool_use_id"), x["t"].alias("content")))
    chat = F.transform(both, lambda x: F.struct(F.lit("tool").alias("role"), x["i"].alias("tool_call_id"), x["t"].alias("content")))
    items = F.transform(both, lambda x: F.struct(F.lit("function_call_output").alias("type"), x["i"].alias("call_id"), x["t"].alias("output")))
    return F.when(wire == "messages", F.to_json(F.struct(F.lit("user").alias("role"), blocks.alias("content")))).when(wire == "chat", F.to_json(chat)).when(wire == "responses", F.to_json(items))


def terminal(wire: Column, text: Column) -> Column:
    """A closing assistant turn as JSON text."""
    blocks = F.struct(F.lit("assistant").alias("role"), F.lit("end_turn").alias("stop_reason"), F.array(F.struct(F.lit("text").alias("type"), text.alias("text"))).alias("content"))
    chat = F.struct(F.array(F.struct(F.struct(F.lit("assistant").alias("role"), text.alias("content")).alias("message"), F.lit("stop").alias("finish_reason"))).alias("choices"))
    items = F.struct(F.array(F.struct(F.lit("message").alias("type"), F.lit("assistant").alias("role"), F.array(F.struct(F.lit("output_text").alias("type"), text.alias("text"))).alias("content"))).alias("output"))
    return F.when(wire == "messages", F.to_json(blocks)).when(wire == "chat", F.to_json(chat)).when(wire == "responses", F.to_json(items))


def region(label: Column, text: Column, start: Column, end: Column, cap: int = T.READ_CAP) -> Column:
    """Lines start..end under a title that names them; at most cap lines, with a notice of what is cut."""
    first = F.greatest(start, F.lit(1)).cast("int")

    def shown(lines):
        n = F.size(lines)
        last = F.greatest(first, F.least(n, F.when(end > 0, end).otherwise(start).cast("int")))
        cut = last - first + 1 > cap
        stop = F.when(cut, first + (cap - 1)).otherwise(last)
        body = F.concat(F.lit("["), label, F.lit(", lines "), first.cast("string"), F.lit(" to "), stop.cast("string"), F.lit("]\n"), F.array_join(F.slice(lines, first, stop - first + 1), "\n"))
        more = F.when(cut, F.concat(F.lit(f"\n\n[{cap} lines at a time; go on with line "), (stop + 1).cast("string"), F.lit("]"))).otherwise("")
        past = F.concat(F.lit("[no line "), first.cast("string"), F.lit(": the file has "), n.cast("string"), F.lit("]"))
        return F.when(n == 0, F.concat(F.lit("["), label, F.lit(", no lines]"))).when(first > n, past).otherwise(F.concat(body, more))

    return T.let(T.split_lines(text), shown)


def read_symbols(asked: DataFrame, symbols: DataFrame, files: DataFrame) -> DataFrame:
    """asked (path, name, ...) with answer: the symbol's lines, or that the file has no such symbol. files: path, label, text."""
    spans = symbols.select("path", "name", F.col("line").alias("__line"), F.col("end_line").alias("__end"))
    x = asked.join(spans, ["path", "name"], "left").join(files.select("path", "label", "text"), "path", "left")
    found = region(F.col("label"), F.col("text"), F.col("__line"), F.coalesce("__end", "__line"))
    none = F.concat(F.lit("[no symbol "), "name", F.lit(" in "), F.coalesce("label", F.col("path").cast("string")), F.lit(f"; {VIRTUAL_PREFIX}read lists those it has]"))
    return x.withColumn("answer", F.when(F.col("__line").isNull(), none).otherwise(found)).select(*asked.columns, "answer")


def summary_result(path: Column, summary: Column) -> Column:
    """What stands in for a gated read: the marked summary without its time stamp, and where the rest is to be had."""
    body = T.strip_timestamp(F.coalesce(summary, F.lit("(file not indexed)")))
    return F.concat(F.lit(SUMMARY_MARK), path, F.lit("⟫\n"), body, F.lit("\n\n" + FOOTER))


def answers(calls: DataFrame, files: DataFrame, symbols: DataFrame, lists: DataFrame) -> DataFrame:
    """(conv_id, turn, id, answer) of every call of a virtual tool in calls (conv_id, turn, id, name, input: map of strings).

    files: path, label, text, summary, all strings; symbols: path, name, line, end_line; lists (tool, key, value): the
    values that impact, callers, callees and search list for a key. An edit is answered, not carried out.
    """
    v = calls.where(F.col("name").startswith(VIRTUAL_PREFIX)).select("conv_id", "turn", "id", F.substring("name", len(VIRTUAL_PREFIX) + 1, 1 << 20).alias("tool"), "input")
    arg = lambda k: F.col("input")[k]
    at = v.withColumn("path", arg("path")).join(files, "path", "left")
    new = T.replace_unique(F.col("text"), arg("old"), arg("new"))
    read = (
        F.when(F.col("tool") == "read", F.coalesce("summary", F.lit("(file not indexed)")))
        .when(F.col("text").isNull(), F.concat(F.lit("(no file "), F.coalesce("path", F.lit("")), F.lit(")")))
        .when(F.col("tool") == "read_full", T.read_full(F.col("text")))
        .when(F.col("tool") == "read_range", region(F.col("label"), F.col("text"), arg("start").try_cast("int"), arg("end").try_cast("int")))
        .when(F.col("tool") == "edit", F.when(new.isNull(), F.lit("(refused: `old` must occur exactly once)")).otherwise(F.lit("(edited)")))
    )
    whole = at.where(F.col("tool").isin("read", "read_full", "read_range", "edit")).select("conv_id", "turn", "id", read.alias("answer"))
    one = v.where("tool = 'read_symbol'").select("conv_id", "turn", "id", arg("path").alias("path"), arg("symbol").alias("name"))
    one = read_symbols(one, symbols, files).select("conv_id", "turn", "id", "answer")
    many = v.where(F.col("tool").isin("impact", "callers", "callees", "search")).withColumn("key", F.coalesce(arg("path"), arg("symbol"), arg("text")))
    lists = lists.join(many.select("tool", "key").distinct(), ["tool", "key"], "left_semi")  # what nobody asks for is not collected
    listed = lists.groupBy("tool", "key").agg(F.to_json(F.sort_array(F.collect_set("value"))).alias("found"))
    many = many.join(listed, ["tool", "key"], "left").select("conv_id", "turn", "id", F.coalesce("found", F.lit("[]")).alias("answer"))
    odd = v.where(~F.col("tool").isin(*TOOLS)).select("conv_id", "turn", "id", F.concat(F.lit(f"(unknown tool: {VIRTUAL_PREFIX}"), "tool", F.lit(")")).alias("answer"))
    return whole.unionByName(one).unionByName(many).unionByName(odd)


def with_directive(system: Column) -> Column:
    """The system text with the directive at its end, once."""
    return F.when(system.isNull(), DIRECTIVE).when(system.contains(DIRECTIVE_MARK), system).otherwise(F.concat(system, F.lit("\n\n" + DIRECTIVE)))


def body_tokens(system: Column, tools: Column, messages: Column) -> Column:
    """The token estimate of a request: its system text, its tool definitions and its messages (arrays of texts)."""
    total = lambda a: F.aggregate(F.coalesce(a, F.array().cast("array<string>")), F.lit(0).cast("bigint"), lambda n, x: n + T.token_estimate(F.coalesce(x, F.lit(""))))
    return F.when(system.isNull(), 0).otherwise(T.token_estimate(system)) + total(tools) + total(messages)


def growing_history(steps: DataFrame) -> DataFrame:
    """(task, step, n_messages, n_chars): the request of each step carries all calls and results before and with it.

    steps: task, step, call, result. The running sums stand for the arrays, which would repeat every text of a task.
    """
    w = Window.partitionBy("task").orderBy("step").rowsBetween(Window.unboundedPreceding, 0)
    n = F.length(F.coalesce("call", F.lit(""))) + F.length(F.coalesce("result", F.lit("")))
    return steps.select("task", "step", (2 * F.count(F.lit(1)).over(w)).alias("n_messages"), F.sum(n).over(w).cast("bigint").alias("n_chars"))


def contexts(files: DataFrame, threshold: int) -> DataFrame:
    """(task, control, treatment): a task's files in full, and with summaries for those longer than the threshold.

    files: task, path, line_count, text, summary. A task's files, in path order, are one text; tasks are small by nature.
    """
    gated = F.col("line_count") > threshold
    part = lambda tag, body: F.concat(F.lit("--- "), F.col("path").cast("string"), F.lit(" ("), tag, F.lit(")\n"), body)
    control = part(F.lit("whole"), F.coalesce("text", F.lit("")))
    treatment = F.when(gated, part(F.lit("summary"), summary_result(F.col("path").cast("string"), F.col("summary")))).otherwise(part(F.lit("whole, as it is short"), F.coalesce("text", F.lit(""))))
    rows = F.array_sort(F.collect_list(F.struct("path", control.alias("c"), treatment.alias("t"))))
    joined = lambda k: F.array_join(F.transform("rows", lambda x: x[k]), "\n\n")
    return files.groupBy("task").agg(rows.alias("rows")).select("task", joined("c").alias("control"), joined("t").alias("treatment"))


def page_starts(pages: DataFrame) -> DataFrame:
    """pages (doc, page, text) with n_lines and start: the line of the document that the page begins with."""
    w = Window.partitionBy("doc").orderBy("page").rowsBetween(Window.unboundedPreceding, -1)
    x = pages.withColumn("n_lines", T.prose_lines(F.coalesce("text", F.lit(""))))
    return x.withColumn("start", (F.coalesce(F.sum("n_lines").over(w), F.lit(0)) + 1).cast("bigint"))
