"""Quality rules: a threshold table compiled into one projection, without user functions and without a shuffle."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stratalens.llm.common import WORD_SPLIT, fresh
from stratalens.session import spread

SYMBOLS = "#*$%&|<>"
WINDOW = 8
MIN_WORDS, MAX_REPEAT_PERCENT = 20, 30
#: Frequent function words of English, German, French and Spanish.
STOP_WORDS = (
    "the be to of and that have with is in a for on was as it by at are this not "
    "der die das und ist zu den von mit ein eine nicht auf sich des dem "
    "le la les de du et un une que en qui dans pour il est pas sur ce "
    "el los las y se por con para del una su al lo como"
).split()


@dataclass(frozen=True)
class Rule:
    """A document passes when low <= feature <= high; None leaves a side open."""

    feature: str
    low: float | None = None
    high: float | None = None


RULES = (
    Rule("n_words", low=20, high=1_000_000),
    Rule("mean_word_chars", low=3, high=12),
    Rule("symbols_per_word", high=0.1),
    Rule("stop_word_ratio", low=0.06),
    Rule("alpha_word_ratio", low=0.7),
    Rule("upper_word_ratio", high=0.5),
    Rule("dup_line_ratio", high=0.4),
    Rule("shouted_line_ratio", high=0.5),
)


def _repeated_words(w: Column) -> Column:
    """Words covered by the windows of WINDOW words that the text holds twice or more.

    Windows are hashed to 64 bits and sorted with their positions; neighbours with one hash are compared word by word.
    """
    n = F.size(w)
    windows = F.sort_array(F.transform(F.sequence(F.lit(0), n - WINDOW), lambda i: F.struct(F.xxhash64(F.slice(w, i + 1, F.lit(WINDOW))).alias("h"), i.alias("i"))))
    # hashes alone first: few texts repeat a window, and only those pay for the sort
    hashes = F.transform(F.sequence(F.lit(0), n - WINDOW), lambda i: F.xxhash64(F.slice(w, i + 1, F.lit(WINDOW))))

    def covered(s: Column) -> Column:
        at = lambda k: F.slice(w, k["i"] + 1, F.lit(WINDOW))
        same = lambda x, y: F.coalesce((x["h"] == y["h"]) & (at(x) == at(y)), F.lit(False))
        twice = F.filter(s, lambda x, k: same(x, F.get(s, k + 1)) | same(x, F.get(s, k - 1)))
        p = F.sort_array(F.transform(twice, lambda x: x["i"]))
        return F.aggregate(p, F.struct(F.lit(0).cast("bigint").alias("n"), F.lit(-WINDOW).alias("last")),
                           lambda a, i: F.struct((a["n"] + F.least(i - a["last"], F.lit(WINDOW))).alias("n"), i.alias("last")), lambda a: a["n"])

    once = F.transform(F.array(windows), covered)[0]
    return F.when(n <= WINDOW, F.lit(0).cast("bigint")).when(F.size(F.array_distinct(hashes)) == n - WINDOW + 1, F.lit(0).cast("bigint")).otherwise(once)


def with_features(docs: DataFrame, text_col: str, into: str) -> DataFrame:
    """docs with a struct column `into` of every feature that a rule can name."""
    text, w, l = fresh(docs, "__q_text"), fresh(docs, "__q_words"), fresh(docs, "__q_lines")
    t = F.col(text)
    step1 = docs.withColumn(text, F.coalesce(F.col(text_col), F.lit("")))
    step2 = step1.withColumns({w: F.array_remove(F.split(t, WORD_SPLIT, -1), ""), l: F.filter(F.split(t, "\n", -1), lambda x: x.rlike("[^\\x20\\x09-\\x0D]"))})
    words, lines = F.col(w), F.col(l)
    n, n_lines = F.size(words).cast("bigint"), F.size(lines).cast("bigint")
    ratio = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    word_chars = F.length(F.translate(t, " \t\n\x0b\f\r", "")).cast("bigint")
    n_symbols = (F.length(t) - F.length(F.translate(t, SYMBOLS, ""))).cast("bigint")
    dup = (n_lines - F.size(F.array_distinct(lines))).cast("bigint")
    # one regular-expression pass each, instead of a lambda call per word
    stop = F.regexp_count(t, F.lit(r"(?i)(?<![^\x20\x09-\x0D])(?:" + "|".join(STOP_WORDS) + r")(?![^\x20\x09-\x0D.,;:!?])"))
    alpha = F.regexp_count(t, F.lit(r"(?<![^\x20\x09-\x0D])[^\x20\x09-\x0D\p{L}]*+\p{L}"))
    upper = F.regexp_count(t, F.lit(r"(?<![^\x20\x09-\x0D])[^\x20\x09-\x0D\p{Ll}\p{Lu}]*+\p{Lu}[^\x20\x09-\x0D\p{Ll}]++(?![^\x20\x09-\x0D])"))
    shouted = F.size(F.filter(lines, lambda x: F.rtrim(x).endswith("!!")))
    feats = {
        "n_words": n, "word_chars": word_chars, "n_symbols": n_symbols, "n_dup_lines": dup, "n_repeat_words": _repeated_words(words),
        "mean_word_chars": ratio(word_chars, n), "symbols_per_word": ratio(n_symbols, n), "stop_word_ratio": ratio(stop, n), "alpha_word_ratio": ratio(alpha, n),
        "upper_word_ratio": ratio(upper, n), "dup_line_ratio": ratio(dup, n_lines), "shouted_line_ratio": ratio(shouted, n_lines),
    }
    return step2.withColumn(into, F.struct(*(v.alias(k) for k, v in feats.items()))).drop(text, w, l)


def compiled(rules, f: Column) -> Column:
    """The whole table as one boolean expression over the feature struct f."""
    out = F.lit(True)
    for r in rules:
        if r.low is not None:
            out = out & (f[r.feature] >= r.low)
        if r.high is not None:
            out = out & (f[r.feature] <= r.high)
    return out


def base_failed(f: Column) -> Column:
    return (f["n_words"] < MIN_WORDS) | (100 * f["n_repeat_words"] > MAX_REPEAT_PERCENT * f["n_words"])


def judge(docs: DataFrame, text_col: str = "text", rules=RULES) -> DataFrame:
    """docs with a struct column `quality` (features, base_failed, kept), replacing a column of that name.

    A null or blank text has no words and fails; ratios over nothing are 0. Every row is judged by itself, so repeated
    rows get equal verdicts and an empty table stays empty.
    """
    into = fresh(docs, "__q_features")
    out = with_features(docs, text_col, into)
    f = F.col(into)
    failed = base_failed(f)
    return out.withColumn("quality", F.struct(f.alias("features"), failed.alias("base_failed"), (~failed & compiled(rules, f)).alias("kept"))).drop(into)


def keep_good(docs: DataFrame, text_col: str = "text", rules=RULES) -> DataFrame:
    """The rows of docs, with their own columns, that pass every rule."""
    name, verdict, row = fresh(docs, "__q_features"), fresh(docs, "__q_kept"), fresh(docs, "__q_row")
    out = with_features(docs, text_col, name)
    f = F.col(name)
    # the row number keeps the filter above the projection: below it, every rule would split the text again
    out = out.select(*docs.columns, (~base_failed(f) & compiled(rules, f)).alias(verdict), F.monotonically_increasing_id().alias(row))
    return out.where(F.col(verdict) & (F.col(row) >= 0)).select(*docs.columns)


def op6_quality_rules(spark, sf_dir: str) -> DataFrame:
    d = judge(spread(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")))
    f = F.col("quality.features")
    return d.select("doc_id", *(f[c].alias(c) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")), F.col("quality.base_failed"), F.col("quality.kept"))


_STOP = "|".join(STOP_WORDS)
_RULE_SQL = " AND ".join(f"{r.feature} >= {r.low}" for r in RULES if r.low is not None) + " AND " + " AND ".join(f"{r.feature} <= {r.high}" for r in RULES if r.high is not None)
FEATURES_SQL = rf"""d AS (SELECT row_number() OVER () AS r, *, coalesce(text, '') AS t FROM documents),
w AS (SELECT r, t, list_filter(string_split_regex(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws,
  list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM d),
win AS (SELECT r, i, array_to_string(ws[i:i + {WINDOW - 1}], ' ') AS g FROM (SELECT r, ws, unnest(range(1, len(ws) - {WINDOW - 2})) AS i FROM w)),
rep AS (SELECT r, count(DISTINCT p) AS n FROM (SELECT r, unnest(range(i, i + {WINDOW})) AS p FROM (SELECT r, i, count(*) OVER (PARTITION BY r, g) AS c FROM win) WHERE c > 1) GROUP BY r),
q AS (SELECT w.r, len(ws)::BIGINT AS n_words, coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0)::BIGINT AS word_chars,
  length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols, (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines, coalesce(rep.n, 0)::BIGINT AS n_repeat_words,
  len(list_filter(ws, lambda x: regexp_matches(x, '(?i)^(?:{_STOP})(?:$|[.,;:!?])'))) AS n_stop, len(list_filter(ws, lambda x: regexp_matches(x, '\p{{L}}'))) AS n_alpha,
  len(list_filter(ws, lambda x: regexp_matches(x, '^[^\p{{Ll}}\p{{Lu}}]*\p{{Lu}}[^\p{{Ll}}]+$'))) AS n_upper, len(list_filter(ls, lambda x: regexp_matches(x, '!! *$'))) AS n_shout, len(ls) AS n_lines
  FROM w LEFT JOIN rep USING (r)),
f AS (SELECT *, coalesce(word_chars / nullif(n_words, 0), 0) AS mean_word_chars, coalesce(n_symbols / nullif(n_words, 0), 0) AS symbols_per_word, coalesce(n_stop / nullif(n_words, 0), 0) AS stop_word_ratio,
  coalesce(n_alpha / nullif(n_words, 0), 0) AS alpha_word_ratio, coalesce(n_upper / nullif(n_words, 0), 0) AS upper_word_ratio, coalesce(n_dup_lines / nullif(n_lines, 0), 0) AS dup_line_ratio,
  coalesce(n_shout / nullif(n_lines, 0), 0) AS shouted_line_ratio, n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words AS base_failed FROM q),
v AS (SELECT *, NOT base_failed AND {_RULE_SQL} AS kept FROM f)"""
ORACLE = f"WITH {FEATURES_SQL} SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept FROM d JOIN v USING (r)"
