"""Request transcripts as tables: gating large reads, bounding long results, correlating calls with results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stratalens.functions.text import let, split_lines

# Tool names and keys that hosts use, and the shapes of their search and listing results.
READ_TOOLS = ("read", "read_file", "view", "cat")
PATH_KEYS = ("file_path", "path", "target_file", "filename")
VIRTUAL_PREFIX = "index_"
GREP_TOOLS = r"(?i)^(?:grep|rg|ripgrep|search_files)$"
LIST_TOOLS = r"(?i)^(?:ls|find|glob|list_dir|list_files)$"
SUMMARY_MARK, BOUNDED_MARK = "⟪summary:", "⟪bounded:"
MIN_CHARS = 1500
HIT = r"(?U)^((?:[A-Za-z]:[\\/])?[^\n:]+):(\d+):(.*)$"
HIT_BEGIN = r"(?U)^(?:[A-Za-z]:[\\/])?[^\n:]+:\d+:"
CONTEXT = r"(?U)^((?:[A-Za-z]:[\\/])?[^\n:]+)-\d+-"
PATHISH, LS_LONG = r"(?U)^[\w ./\\-]+$", r"^(?:[-dlbcps][-rwxsStT]{9}\s|total\s)"


def asked_path(input_map: Column) -> Column:
    """The first non-empty path argument of a call."""
    return F.coalesce(*(F.when(input_map[k] != "", input_map[k]) for k in PATH_KEYS))


def marked_paths(text: Column) -> Column:
    """Paths whose summary a text already shows."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit(SUMMARY_MARK + "(.+?)⟫"), F.lit(1)))


def classify(calls: DataFrame, files: DataFrame, summarized: DataFrame, threshold: int) -> DataFrame:
    """calls (conv_id, id, name, input) with kind virtual / gated / host and, where gated, the path.

    A read of a file longer than the threshold is gated unless its summary is in the conversation already.
    """
    path = F.when(F.lower("name").isin(*READ_TOOLS), asked_path(F.col("input")))
    large = files.where(F.col("line_count") > threshold).select(F.col("path").alias("p")).distinct()
    seen = summarized.select(F.col("conv_id").alias("c"), F.col("path").alias("sp")).distinct()
    x = calls.withColumn("p", path).join(large.withColumn("large", F.lit(True)), "p", "left").join(seen.withColumn("seen", F.lit(True)), (F.col("c") == F.col("conv_id")) & (F.col("sp") == F.col("p")), "left")
    kind = F.when(F.col("name").startswith(VIRTUAL_PREFIX), "virtual").when(F.col("large") & F.col("seen").isNull(), "gated").otherwise("host")
    return x.withColumn("kind", F.coalesce(kind, F.lit("host"))).withColumn("path", F.when(F.col("kind") == "gated", F.col("p"))).drop("p", "large", "seen", "c", "sp")


def call_names(calls: DataFrame) -> DataFrame:
    """(conv_id, id, name): an id under which two different names were called is nobody's: ''."""
    g = calls.groupBy("conv_id", "id").agg(F.min("name").alias("lo"), F.max("name").alias("hi"))
    return g.select("conv_id", "id", F.when(F.col("lo") == F.col("hi"), F.col("lo")).otherwise("").alias("name"))


def with_names(results: DataFrame, calls: DataFrame) -> DataFrame:
    return results.join(call_names(calls), ["conv_id", "id"], "left").withColumn("name", F.coalesce("name", F.lit("")))


def fresh(results: DataFrame, keep: int) -> DataFrame:
    """results with is_fresh: among the last `keep` of their conversation by (turn, idx)."""
    w = Window.partitionBy("conv_id").orderBy(F.desc("turn"), F.desc("idx"))
    return results.withColumn("is_fresh", F.row_number().over(w) <= keep)


def bound_grep(text: Column, per_file: int = 8, max_files: int = 40) -> Column:
    """A search result in fewer lines: hits by file, capped; null where most lines are no hits.

    Context lines count as structure only if their file has a hit. Everything is arrays of one row, each computed once:
    no shuffle, and one match of the pattern a line.
    """
    none = F.array().cast("array<string>")

    def parsed(x):  # path and number are taken from the matched beginning, which is short
        begin = F.regexp_extract(x, HIT_BEGIN, 0)
        number = F.regexp_extract(begin, r"(?U):(\d+):$", 1)
        path = F.left(begin, F.length(begin) - F.length(number) - 2)
        return F.struct(x.alias("x"), path.alias("p"), number.alias("n"), F.trim(F.substr(x, F.length(begin) + 1)).alias("r"))

    def shown(rows, hits, files):
        quiet = F.filter(rows, lambda h: (h["n"] == "") & ((F.trim(h["x"]) == "") | (h["x"].rlike(CONTEXT) & F.array_contains(files, F.regexp_extract(h["x"], CONTEXT, 1)))))
        n, other = F.size(hits), F.size(rows) - F.size(hits) - F.size(quiet)
        row = lambda h: F.concat(F.lit("  "), h["n"], F.lit(": "), h["r"])
        more = lambda of: F.when(F.size(of) > per_file, F.array(F.concat(F.lit("  (+"), (F.size(of) - per_file).cast("string"), F.lit(" more matches in this file)")))).otherwise(none)
        part = lambda p: let(F.filter(hits, lambda h: h["p"] == p), lambda of: F.concat(F.array(p), F.transform(F.slice(of, 1, per_file), row), more(of)))
        body = F.flatten(F.transform(F.slice(files, 1, max_files), part))
        rest = F.slice(files, max_files + 1, F.greatest(F.size(files) - max_files, F.lit(0)))
        dropped = F.size(F.filter(hits, lambda h: F.array_contains(rest, h["p"])))
        tail = F.when(F.size(files) > max_files, F.array(F.concat(F.lit("(+"), (F.size(files) - max_files).cast("string"), F.lit(" more files, "), dropped.cast("string"), F.lit(" matches)")))).otherwise(none)
        first = F.concat(F.lit("grep: "), n.cast("string"), F.lit(" matches in "), F.size(files).cast("string"), F.lit(" files"))
        return F.when((n == 0) | (n < F.floor(F.greatest(other, F.lit(1)) / 2)), None).otherwise(F.array_join(F.concat(F.array(first), body, tail), "\n"))

    of_rows = lambda rows: let(F.filter(rows, lambda h: h["n"] != ""), lambda hits: let(F.array_distinct(F.transform(hits, lambda h: h["p"])), lambda files: shown(rows, hits, files)))
    return let(F.transform(split_lines(text), parsed), of_rows)


def listing_paths(text: Column) -> Column:
    raw = F.filter(F.transform(split_lines(text), lambda x: F.trim(x)), lambda x: x != "")
    return F.filter(raw, lambda x: ~x.rlike(LS_LONG) & x.rlike(PATHISH) & x.rlike("[./\\\\]"))


def bound_listings(results: DataFrame, centrality: DataFrame, cap: int = 60) -> DataFrame:
    """(rid, bounded) for results (rid, text): paths by centrality and name, capped, grouped by folder.

    Results of which most lines are no paths give no row. The header counts all paths but only the folders shown.
    """
    raw = F.size(F.filter(split_lines(F.col("text")), lambda x: F.trim(x) != ""))
    p = results.select("rid", raw.alias("raw"), listing_paths(F.col("text")).alias("paths"))
    ok = p.where((F.size("paths") > 0) & (F.size("paths") >= F.floor(F.greatest("raw", F.lit(1)) / 2)))
    rows = ok.select("rid", F.size("paths").alias("n"), F.posexplode("paths").alias("pos", "path")).join(centrality, "path", "left").withColumn("c", F.coalesce("called_by", F.lit(0).cast("bigint")))
    w = Window.partitionBy("rid").orderBy(F.desc("c"), "path", "pos")
    norm = F.replace("path", F.lit("\\"), F.lit("/"))
    dir_ = F.when(norm.contains("/"), F.regexp_replace(norm, "/[^/]*$", "")).otherwise("")
    shown = rows.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= cap).withColumn("dir", F.when(dir_ == "", ".").otherwise(dir_))
    base = F.substring_index(norm, "/", -1)
    text = F.concat(F.lit("  "), base, F.when(F.col("c") > 0, F.concat(F.lit("  ·"), F.col("c").cast("string"), F.lit(" callers"))).otherwise(""))
    dirs = shown.withColumn("t", text).groupBy("rid", "n", "dir").agg(F.min("rn").alias("first"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rn", "t"))), lambda x: x["t"]), "\n").alias("members"), F.count(F.lit(1)).alias("m"))
    block = F.concat(F.col("dir"), F.lit("/  ("), F.col("m").cast("string"), F.lit(")\n"), F.col("members"))
    out = dirs.withColumn("b", block).groupBy("rid", "n").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("first", "b"))), lambda x: x["b"]), "\n").alias("body"), F.count(F.lit(1)).alias("nd"))
    header = F.concat(F.lit("listing: "), F.col("n").cast("string"), F.lit(" paths, "), F.col("nd").cast("string"), F.lit(" dirs (most-central first)\n"))
    tail = F.when(F.col("n") > cap, F.concat(F.lit("\n(+"), (F.col("n") - cap).cast("string"), F.lit(" more paths)"))).otherwise("")
    return out.select("rid", F.concat(header, F.col("body"), tail).alias("bounded"))


def bound_results(results: DataFrame, calls: DataFrame, centrality: DataFrame, keep_fresh: int = 2, min_chars: int = MIN_CHARS) -> DataFrame:
    """results (conv_id, turn, idx, id, text) with long search and listing results bounded; all others untouched.

    Spared are the last keep_fresh of a conversation, marked ones, short ones, and those of unknown or ambiguous tools.
    """
    r = fresh(with_names(results, calls), keep_fresh).withColumn("rid", F.concat_ws("/", F.col("conv_id").cast("string"), F.col("turn").cast("string"), F.col("idx").cast("string")))
    due = ~F.col("is_fresh") & ~F.col("text").contains(BOUNDED_MARK) & (F.length("text") >= min_chars)
    lists = bound_listings(r.where(due & F.col("name").rlike(LIST_TOOLS)).select("rid", "text"), centrality)
    new = F.when(due & F.col("name").rlike(GREP_TOOLS), bound_grep(F.col("text"))).otherwise(F.col("bounded"))
    stamped = F.concat(F.lit(BOUNDED_MARK), F.lower("name"), F.lit("⟫\n"), new)
    return r.join(lists, "rid", "left").withColumn("text", F.coalesce(stamped, F.col("text"))).drop("rid", "bounded", "is_fresh")


def gate_results(results: DataFrame, calls: DataFrame, summaries: DataFrame) -> DataFrame:
    """results of file reads replaced by the file's summary, marked with its path."""
    paths = calls.where(F.lower("name").isin(*READ_TOOLS)).select("conv_id", "id", asked_path(F.col("input")).alias("path")).where("path is not null")
    new = F.concat(F.lit(SUMMARY_MARK), F.col("path"), F.lit("⟫\n"), F.col("summary"))
    return results.join(paths, ["conv_id", "id"], "left").join(summaries, "path", "left").withColumn("text", F.coalesce(new, F.col("text"))).drop("path", "summary")


def add_tools(existing: Column, wanted: Column) -> Column:
    """Tool definitions added unless the name is taken; doing it twice changes nothing."""
    names = F.transform(existing, lambda d: d["name"])
    return F.concat(existing, F.filter(wanted, lambda d: ~F.array_contains(names, d["name"])))


def mark_last(blocks: Column) -> Column:
    """The last block gets the cache mark, unless some block has one."""
    n = F.size(blocks)
    return F.when(F.exists(blocks, lambda b: F.coalesce(b["cached"], F.lit(False))), blocks).otherwise(
        F.transform(blocks, lambda b, i: b.withField("cached", i == n - 1)))


def block_text(block: Column) -> Column:
    """What a block adds to a body's text: its text, or a call's name and arguments."""
    return F.when(block["type"] == "tool_use", F.concat_ws(" ", block["name"], F.to_json(F.map_from_entries(F.array_sort(F.map_entries(block["input"])))))).otherwise(F.coalesce(block["text"], F.lit("")))


def json_or_empty(text: Column) -> Column:
    """Tool arguments from JSON; {} where it is none."""
    return F.coalesce(F.from_json(text, "map<string,string>"), F.create_map().cast("map<string,string>"))


def output_tokens(response: Column) -> Column:
    at = lambda k: F.get_json_object(response, f"$.usage.{k}").try_cast("bigint")
    return F.coalesce(at("output_tokens"), at("completion_tokens"), F.lit(0).cast("bigint"))


def as_events(responses: DataFrame) -> DataFrame:
    """A finished response as the ordered events that a stream would send: (rid, seq, event, data)."""
    parts = F.transform("texts", lambda t, i: F.array(F.struct(F.lit("block_start").alias("event"), i.cast("string").alias("data")), F.struct(F.lit("delta").alias("event"), t.alias("data")), F.struct(F.lit("block_stop").alias("event"), i.cast("string").alias("data"))))
    e = F.concat(F.array(F.struct(F.lit("start").alias("event"), F.lit("").alias("data"))), F.flatten(parts), F.array(F.struct(F.lit("stop").alias("event"), F.lit("").alias("data"))))
    return responses.select("rid", F.posexplode(e).alias("seq", "x")).select("rid", "seq", "x.event", "x.data")
