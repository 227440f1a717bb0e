"""Preference formatting: the longest common turn prefix of two conversations is the prompt, their rests the completions.

DataFrame expressions only; one shuffle brings the turns of a pair together.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Roles whose text is trained on; every other turn of a completion is masked.
TRAINED = ("assistant",)
END = "<|end|>\n"


def _head(t: Column) -> Column:
    return F.concat(F.lit("<|"), t["role"], F.lit("|>\n"))


def _body(t: Column) -> Column:
    """The turn's text and the end mark; marks inside the text are broken up, so a text cannot open or close a turn."""
    return F.concat(F.replace(t["text"], F.lit("<|"), F.lit("< |")), F.lit(END))


def render(turns: Column) -> Column:
    return F.array_join(F.transform(turns, lambda t: F.concat(_head(t), _body(t))), "")


def train_spans(turns: Column) -> Column:
    """(start, end) of what is trained on in render(turns), in code points, end exclusive."""
    none = F.array().cast("array<struct<start:int,end:int>>")

    def step(acc, t):
        s = acc["pos"] + F.length(_head(t))
        e = s + F.length(_body(t))
        span = F.array(F.struct(s.alias("start"), e.alias("end")))
        return F.struct(e.alias("pos"), F.concat(acc["out"], F.when(t["role"].isin(*TRAINED), span).otherwise(none)).alias("out"))

    return F.aggregate(turns, F.struct(F.lit(0).alias("pos"), none.alias("out")), step, lambda a: a["out"])


def common_turns(a: Column, b: Column) -> Column:
    """How many leading turns agree in role and text."""
    n = F.least(F.size(a), F.size(b))
    same = F.transform(F.slice(a, 1, n), lambda t, i: (t["role"] == F.get(b, i)["role"]) & (t["text"] == F.get(b, i)["text"]))
    at = F.array_position(same, False).cast("int")
    return F.when(at > 0, at - 1).otherwise(n)


def format_preferences(turns: DataFrame) -> DataFrame:
    """(pair_id, n_prompt_turns, prompt, chosen, chosen_spans, rejected, rejected_spans, usable) of each pair.

    turns has pair_id, is_chosen, turn, role, text. Turns are ordered by (turn, role, text), nulls first; a null role is
    'unknown', a null text empty; repeated rows are repeated turns. A pair is usable if both completions hold a trained
    turn. A side without turns gives null completions, and the other side's turns are all its own, with an empty prompt.
    Rows with a null pair_id or side belong to no pair and are left out. An empty table gives an empty result; other
    columns are not read. The turns of one pair meet in one row: that row is what is asked for.
    """
    row = F.struct(F.col("turn"), F.coalesce("role", F.lit("unknown")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    sided = turns.where("pair_id is not null and is_chosen is not null").select("pair_id", F.when(F.col("is_chosen"), row).alias("c"), F.when(~F.col("is_chosen"), row).alias("r"))
    met = sided.groupBy("pair_id").agg(F.sort_array(F.collect_list("c")).alias("c"), F.sort_array(F.collect_list("r")).alias("r"))
    c, r, n = F.col("c"), F.col("r"), F.col("n")
    cut = met.withColumn("n", common_turns(c, r)).select(
        "pair_id", "n", F.slice(c, F.lit(1), n).alias("p"), *(F.when(F.size(x) > 0, F.slice(x, n + 1, F.size(x) - n)).alias(name) for x, name in ((c, "c"), (r, "r"))))
    trained = lambda x: F.coalesce(F.exists(x, lambda t: t["role"].isin(*TRAINED)), F.lit(False))
    return cut.select(
        "pair_id", n.cast("bigint").alias("n_prompt_turns"), render(F.col("p")).alias("prompt"), render(c).alias("chosen"), train_spans(c).alias("chosen_spans"),
        render(r).alias("rejected"), train_spans(r).alias("rejected_spans"), (trained(c) & trained(r)).alias("usable"))


def op5_preference_formatting(spark, sf_dir: str) -> DataFrame:
    """The table states no preferences, so conversations 2k and 2k + 1 stand for the chosen and the rejected side of pair k."""
    t = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    turns = t.select(F.shiftright("conv_id", 1).alias("pair_id"), (F.pmod("conv_id", F.lit(2)) == 0).alias("is_chosen"), "turn", "role", "text")
    out = format_preferences(turns)
    listed = lambda x: F.array_join(F.transform(x, lambda s: F.concat_ws(":", s["start"].cast("string"), s["end"].cast("string"))), ",")
    return out.withColumns({k: listed(F.col(k)) for k in ("chosen_spans", "rejected_spans")})


def _oracle() -> str:
    text = "(replace(t.text, '<|', '< |') || '<|end|>' || chr(10))"
    head = "('<|' || t.role || '|>' || chr(10))"
    drawn = lambda x: f"coalesce(list_reduce(list_prepend('', list_transform({x}, lambda t: {head} || {text})), lambda a, b: a || b), '')"
    size = lambda x: f"coalesce(list_sum(list_transform({x}, lambda t: length({head} || {text}))), 0)::BIGINT"

    def spans(x):
        own = f"list_filter(list_transform(range(1, len({x}) + 1), lambda i: CASE WHEN {x}[i].role = 'assistant' THEN ({size(f'{x}[:i - 1]')} + length('<|assistant|>') + 1) || ':' || {size(f'{x}[:i]')} END), lambda y: y IS NOT NULL)"
        return f"array_to_string({own}, ',')"

    side = lambda p: f"coalesce(list({{'turn': turn, 'role': coalesce(role, 'unknown'), 'text': coalesce(text, '')}} ORDER BY turn NULLS FIRST, coalesce(role, 'unknown'), coalesce(text, '')) FILTER (conv_id % 2 = {p}), [])"
    has = lambda x: f"len(list_filter({x}, lambda t: t.role = 'assistant')) > 0"
    return f"""WITH g AS (SELECT conv_id >> 1 AS pair_id, {side(0)} AS c, {side(1)} AS r FROM conversations WHERE conv_id IS NOT NULL GROUP BY 1),
m AS (SELECT *, coalesce(list_min(list_filter(range(1, least(len(c), len(r)) + 1), lambda i: c[i].role <> r[i].role OR c[i].text <> r[i].text)) - 1, least(len(c), len(r)))::BIGINT AS n FROM g),
s AS (SELECT pair_id, n, c[:n] AS p, CASE WHEN len(c) > 0 THEN c[n + 1:] END AS c, CASE WHEN len(r) > 0 THEN r[n + 1:] END AS r FROM m)
SELECT pair_id, n AS n_prompt_turns, {drawn('p')} AS prompt, CASE WHEN c IS NOT NULL THEN {drawn('c')} END AS chosen, CASE WHEN c IS NOT NULL THEN {spans('c')} END AS chosen_spans,
  CASE WHEN r IS NOT NULL THEN {drawn('r')} END AS rejected, CASE WHEN r IS NOT NULL THEN {spans('r')} END AS rejected_spans, coalesce({has('c')}, false) AND coalesce({has('r')}, false) AS usable FROM s"""


ORACLE = _oracle()
