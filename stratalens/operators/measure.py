"""What transforms save: token sums by group, threshold sweeps, growing histories, paired outcomes."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stratalens.functions.text import percent_cut, token_estimate

THRESHOLDS = (0, 50, 75, 150, 400)
FALLBACKS = (0.0, 0.25, 0.5)


def savings(df: DataFrame, full: str, short: str, *by: str) -> DataFrame:
    """Token sums and percent cut by each grouping column and in total, in one pass over the rows."""
    sets = [[F.col(c)] for c in by] + [[]]
    g = df.groupingSets(sets, *(F.col(c) for c in by)).agg(F.sum(full).alias("full_tokens"), F.sum(short).alias("short_tokens"))
    return g.withColumn("cut", F.round(percent_cut(F.col("full_tokens"), F.col("short_tokens")), 4))


def gate_sweep(files: DataFrame, thresholds=THRESHOLDS) -> DataFrame:
    """(threshold, tokens): summary tokens for files longer than the threshold, full ones else. files: line_count, full_tokens, short_tokens.

    One aggregate per threshold in a single scan; the rows are turned into columns only after they are summed.
    """
    sums = [F.sum(F.when(F.col("line_count") > t, F.col("short_tokens")).otherwise(F.col("full_tokens"))).alias(f"t{t}") for t in thresholds]
    pairs = F.array(*(F.struct(F.lit(t).cast("bigint").alias("threshold"), F.col(f"t{t}").alias("tokens")) for t in thresholds))
    return files.agg(*sums).select(F.explode(pairs).alias("x")).select("x.*")


def fallback_sweep(files: DataFrame, parts=FALLBACKS) -> DataFrame:
    """(fallback, tokens): all summaries plus a part of the files read in full after all."""
    s = files.agg(F.sum("short_tokens").alias("s"), F.sum("full_tokens").alias("f"))
    return s.select("s", "f", F.explode(F.array(*map(F.lit, parts))).alias("fallback")).select("fallback", (F.col("s") + F.col("fallback") * F.col("f")).alias("tokens"))


def running_tokens(turns: DataFrame) -> DataFrame:
    """(conv_id, turn, tokens, billed): each turn bills the whole history before it again."""
    w = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, 0)
    return turns.select("conv_id", "turn", token_estimate(F.coalesce("text", F.lit(""))).alias("tokens")).withColumn("billed", F.sum("tokens").over(w))


def replay(turns: DataFrame, variants: dict) -> DataFrame:
    """(conv_id, raw, <variant>, <variant>_cut): tokens billed over a conversation under each text transform."""
    w = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, 0)
    text = F.coalesce("text", F.lit(""))
    cols = {"raw": token_estimate(text)} | {k: token_estimate(f(text)) for k, f in variants.items()}
    t = turns.select("conv_id", "turn", *(c.alias(k) for k, c in cols.items()))
    t = t.select("conv_id", *(F.sum(k).over(w).alias(k) for k in cols))
    g = t.groupBy("conv_id").agg(*(F.sum(k).alias(k) for k in cols))
    base = F.greatest("raw", F.lit(1))
    return g.withColumns({f"{k}_cut": F.round(100 * (F.col("raw") - F.col(k)) / base, 2) for k in variants})


def ledger(turns: DataFrame) -> DataFrame:
    """(conv_id, turn_id, tokens_in_est, tokens_out): what each assistant turn read before it, and wrote."""
    w = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, -1)
    n = F.length(F.coalesce("text", F.lit("")))
    t = turns.select("conv_id", "turn", "role", n.alias("n")).withColumn("before", F.coalesce(F.sum("n").over(w), F.lit(0)))
    return t.where("role = 'assistant'").select("conv_id", F.col("turn").alias("turn_id"), F.greatest(F.lit(1), F.floor(F.col("before") / 4)).cast("bigint").alias("tokens_in_est"), F.greatest(F.lit(1), F.floor(F.col("n") / 4)).cast("bigint").alias("tokens_out"))


def contingency(pairs: DataFrame) -> DataFrame:
    """One row over (control, treatment) booleans: counts, rates and McNemar's statistic with continuity correction."""
    c, t = F.col("control"), F.col("treatment")
    g = pairs.agg(F.count_if(c & t).alias("both"), F.count_if(c & ~t).alias("only_control"), F.count_if(~c & t).alias("only_treatment"), F.count_if(~c & ~t).alias("neither"))
    d = F.col("only_control") + F.col("only_treatment")
    stat = F.when(d == 0, 0.0).otherwise(F.pow(F.greatest(F.abs(F.col("only_control") - F.col("only_treatment")) - 1, F.lit(0)).cast("double"), 2.0) / d)
    n = F.col("both") + F.col("only_control") + F.col("only_treatment") + F.col("neither")
    rate = lambda x: F.when(n > 0, F.round((F.col("both") + F.col(x)) / n, 4)).otherwise(0.0)
    return g.withColumns({"statistic": F.round(stat, 6), "control_rate": rate("only_control"), "treatment_rate": rate("only_treatment")})


#: Beyond this statistic p is under 1e-14; up to it so many terms of the series leave no digit out.
FAR, TERMS = 60.0, 200


def survival(x: Column) -> Column:
    """P of a chi-square with one degree of freedom beyond x: 1 - erf(sqrt(x / 2)) by a series of positive terms."""
    z2 = x / 2

    def add(acc, n):
        term = acc["term"] * 2 * z2 / (2 * n + 1)
        return F.struct(term.alias("term"), (acc["sum"] + term).alias("sum"))

    first = F.sqrt(z2)
    total = F.aggregate(F.sequence(F.lit(1), F.lit(TERMS)), F.struct(first.alias("term"), first.alias("sum")), add, lambda a: a["sum"])
    erf = F.lit(2 / math.sqrt(math.pi)) * F.exp(-z2) * total
    return F.when(x <= 0, 1.0).when(x > FAR, 0.0).otherwise(F.greatest(F.lit(0.0), 1 - erf))


def with_p_value(one_row: DataFrame) -> DataFrame:
    """(statistic, p_value)."""
    return one_row.select("statistic", F.round(survival(F.col("statistic").cast("double")), 6).alias("p_value"))


def spotlight(files: DataFrame) -> DataFrame:
    """Totals over all files, and the file with the most characters (the smaller path of equals)."""
    return files.agg(F.sum("n_chars").alias("chars"), F.sum("line_count").alias("lines"), F.max_by("path", F.struct("n_chars", -F.col("path"))).alias("spotlight"), F.max("n_chars").alias("spotlight_chars"))


def top_files(files: DataFrame, threshold: int, most: int) -> DataFrame:
    """(path, line_count, full_tokens, short_tokens, cut) of the files with the most tokens among those longer than the threshold."""
    large = files.where(F.col("line_count") > threshold).orderBy(F.desc("full_tokens"), "path").limit(most)
    return large.select("path", "line_count", "full_tokens", "short_tokens", F.round(percent_cut(F.col("full_tokens"), F.col("short_tokens")), 4).alias("cut"))
