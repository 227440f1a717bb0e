"""Replaying growing histories under composed transforms, without building a history twice.

The request of step k bills the system text, the tools and every message up to k. A transform changes a message by itself,
but for one thing: which call a result belongs to, since an id may be called again under another name or path. So a message
has a length that holds from its step on, and new ones only from the steps at which such a call comes. What a step bills is
a running sum of these changes: the shared prefix is summed, never rendered again.

A variant is a chain of transforms over a message's results, such as (gate, bound); cache adds its mark to the last tool.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stratalens.operators.bodies import CACHE_KEY
from stratalens.operators.transcript import BOUNDED_MARK, GREP_TOOLS, LIST_TOOLS, MIN_CHARS, READ_TOOLS, bound_grep, bound_listings

GATE, BOUND, CACHE = "gate", "bound", "cache"
VARIANTS = {"raw": (), "bound": (BOUND,), "gate": (GATE,), "gate_bound": (GATE, BOUND), "gate_bound_cache": (GATE, BOUND, CACHE)}
MARK_CHARS = len(f'"{CACHE_KEY}":{{"type":"ephemeral"}},')


def _tokens(chars: Column) -> Column:
    return F.greatest(F.lit(1), F.floor(chars / 4)).cast("bigint")


def call_states(calls: DataFrame) -> DataFrame:
    """(task, id, step, name, path): what an id stands for from a step on, one row for each change.

    calls (task, step, idx, id, name, path). An id called under two names is nobody's ('') from the second one on; its path
    is that of its last read.
    """
    w = Window.partitionBy("task", "id").orderBy("step", "idx")
    sofar = w.rowsBetween(Window.unboundedPreceding, 0)
    read = F.when(F.lower("name").isin(*READ_TOOLS), F.col("path"))
    x = calls.select("task", "id", "step", "idx", F.when(F.min("name").over(sofar) == F.max("name").over(sofar), F.col("name")).otherwise("").alias("name"), F.last(read, ignorenulls=True).over(sofar).alias("path"))
    # the last call of a step decides for the step
    last = x.groupBy("task", "id", "step").agg(F.max_by(F.struct("name", "path"), "idx").alias("s")).select("task", "id", "step", "s.name", "s.path")
    before = Window.partitionBy("task", "id").orderBy("step")
    same = F.lag(F.struct("name", "path")).over(before).eqNullSafe(F.struct("name", "path"))
    return last.withColumn("same", same & F.lag(F.lit(True)).over(before).isNotNull()).where(~F.col("same")).drop("same")


def result_states(results: DataFrame, calls: DataFrame, summaries: DataFrame, centrality: DataFrame) -> DataFrame:
    """(task, step, idx, since, raw, gate, bound, gate_bound, gated, bounded, gate_bounded): each result's characters under
    every chain, from a step on; the flags say whether a transform changed it.

    results (task, step, idx, id, text), summaries (path, summary) of the files that are gated.
    """
    states = call_states(calls)
    r = results.select("task", "step", "idx", "id", F.coalesce("text", F.lit("")).alias("text"))
    # what the id stands for when the result comes, and each later change
    known = states.select("task", "id", F.col("step").alias("at"), "name", "path")
    both = r.select("task", "id", "step", "idx").join(known, ["task", "id"])
    first = both.where("at <= step").groupBy("task", "step", "idx").agg(F.max_by(F.struct("name", "path"), "at").alias("s"))
    begun = r.join(first, ["task", "step", "idx"], "left").select(*r.columns, F.col("step").alias("since"), F.coalesce("s.name", F.lit("")).alias("name"), "s.path")
    later = both.where("at > step").join(r.drop("id"), ["task", "step", "idx"]).select(*r.columns, F.col("at").alias("since"), "name", "path")
    x = begun.unionByName(later).join(summaries.select("path", "summary"), "path", "left")
    x = x.withColumn("rid", F.concat_ws("/", *(F.col(c).cast("string") for c in ("task", "step", "idx", "since"))))
    due = lambda t: ~F.contains(t, F.lit(BOUNDED_MARK)) & (F.length(t) >= MIN_CHARS)
    # a result that is gated is its summary, which bounding leaves alone: only reads are gated, only searches bounded
    lists = bound_listings(x.where(due(F.col("text")) & F.col("name").rlike(LIST_TOOLS)).select("rid", "text"), centrality)
    x = x.join(lists, "rid", "left")
    new = F.when(due(F.col("text")) & F.col("name").rlike(GREP_TOOLS), bound_grep(F.col("text"))).otherwise(F.col("bounded"))
    stamp = F.length(F.concat(F.lit(BOUNDED_MARK), F.lower("name"), F.lit("⟫\n")))
    x = x.withColumns({"raw": F.length("text").cast("bigint"), "b": (stamp + F.length(new)).cast("bigint"), "g": F.length("summary").cast("bigint")})
    out = {"gate": F.coalesce("g", "raw"), "bound": F.coalesce("b", "raw"), "gate_bound": F.coalesce("g", "b", "raw")}
    flags = {"gated": F.col("g").isNotNull(), "bounded": F.col("b").isNotNull() | F.contains("text", F.lit(BOUNDED_MARK))}
    return x.select("task", "step", "idx", "since", "raw", *(c.cast("bigint").alias(k) for k, c in out.items()), *(c.alias(k) for k, c in flags.items()))


def _length(chain: tuple) -> str:
    """The column of result_states() that a chain of transforms leads to."""
    return "_".join(x for x in (GATE, BOUND) if x in chain) or "raw"


def replayed(steps: DataFrame, states: DataFrame, heads: DataFrame, variants: dict[str, tuple] = VARIANTS) -> DataFrame:
    """(task, step, <variant>, ..., gated, bounded): the tokens that each step's request bills, under every variant.

    steps (task, step, chars): one message a step with the characters beside its results; states from result_states();
    heads (task, system_chars, tool_chars: array, marked). gated and bounded say whether the step's request holds a result
    that the transform changed. Without a head a task has no system text and no tools.
    """
    names = list(dict.fromkeys(map(_length, variants.values())))
    # the characters of each message from a step on: its own, then what its results add or change
    w = Window.partitionBy("task", "step", "idx").orderBy("since")
    change = states.select("task", "step", "since", *((F.col(n) - F.coalesce(F.lag(n).over(w), F.lit(0))).alias(n) for n in names), *((F.col(c).cast("int") - F.coalesce(F.lag(F.col(c).cast("int")).over(w), F.lit(0))).alias(c) for c in ("gated", "bounded")))
    own = steps.select("task", "step", F.col("step").alias("since"), *(F.col("chars").cast("bigint").alias(n) for n in names), F.lit(0).alias("gated"), F.lit(0).alias("bounded"))
    message = own.unionByName(change).groupBy("task", "step", "since").agg(*(F.sum(n).alias(n) for n in (*names, "gated", "bounded")))
    m = Window.partitionBy("task", "step").orderBy("since")
    whole = message.select("task", "step", "since", "gated", "bounded", *(_tokens(F.sum(n).over(m)).alias(n) for n in names))
    delta = whole.select("task", "since", "gated", "bounded", *((F.col(n) - F.coalesce(F.lag(n).over(m), F.lit(0))).alias(n) for n in names))
    by_step = delta.groupBy("task", F.col("since").alias("step")).agg(*(F.sum(n).alias(n) for n in (*names, "gated", "bounded")))
    # a step is one of the task's own; a change of meaning comes with a call, so with a step
    t = Window.partitionBy("task").orderBy("step").rowsBetween(Window.unboundedPreceding, 0)
    billed = by_step.select("task", "step", *(F.sum(n).over(t).alias(n) for n in (*names, "gated", "bounded"))).join(steps.select("task", "step"), ["task", "step"], "left_semi")
    nothing = F.lit(0).cast("bigint")
    tools = lambda extra: F.coalesce(F.aggregate("tool_chars", nothing, lambda n, x: n + _tokens(x)) + extra, nothing)
    last = F.element_at(F.col("tool_chars"), -1)
    marked = F.when((F.size("tool_chars") > 0) & ~F.col("marked"), _tokens(last + MARK_CHARS) - _tokens(last)).otherwise(nothing)
    head = heads.select("task", F.when(F.col("system_chars").isNotNull(), _tokens(F.col("system_chars"))).otherwise(nothing).alias("system"), tools(nothing).alias("plain"), tools(marked).alias("cached"))
    x = billed.join(head, "task", "left")
    cols = [(F.col(_length(chain)) + F.coalesce(F.col("system") + F.col("cached" if CACHE in chain else "plain"), nothing)).cast("bigint").alias(v) for v, chain in variants.items()]
    return x.select("task", "step", *cols, (F.col("gated") > 0).alias("gated"), (F.col("bounded") > 0).alias("bounded"))


def totals(billed: DataFrame, variants: dict[str, tuple] = VARIANTS) -> DataFrame:
    """(task, n_turns, gated_turns, bounded_turns, <variant>, <variant>_cut): sums over a task's steps, and percent saved."""
    g = billed.groupBy("task").agg(F.count(F.lit(1)).alias("n_turns"), F.count_if("gated").alias("gated_turns"), F.count_if("bounded").alias("bounded_turns"), *(F.sum(v).alias(v) for v in variants))
    base = F.when(F.col("raw") == 0, 1).otherwise(F.col("raw"))
    return reduce(lambda d, v: d.withColumn(f"{v}_cut", F.round(100 * (base - F.col(v)) / base, 2)), variants, g)
