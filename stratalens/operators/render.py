"""Deterministic summaries: a file's API, imports, calls and callers, or a document's table of contents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructType

from stratalens.functions.text import TIMESTAMP_PREFIX, anchor, dotted, heading_label, heading_level, leaf
from stratalens.operators.fold import folded

MAX_DEPS, MAX_CALLS, MAX_CALLERS = 10, 15, 5
PROSE = ("markdown", "pdf", "docx")


class _Spans:
    """Headings from the last to the first: the stack holds those that can still end a section, deepest on top."""

    def __init__(self):
        self.stack = []

    def __call__(self, row):
        path, idx, level, label, line, total = row
        while self.stack and self.stack[-1][0] > level:
            self.stack.pop()
        end = max(line, self.stack[-1][1] - 1) if self.stack else total
        self.stack.append((level, line))
        return [(path, idx, level, label, line, end)]


def section_ends(heads: DataFrame, total: Column) -> DataFrame:
    """heads (path, idx, level, label, line) with end_line: the line before the next heading of no deeper level.

    One fold from the last heading to the first, linear in their number; equal levels end each other.
    """
    rows = heads.select("path", "idx", "level", "label", "line", total.alias("total"))
    schema = StructType([*rows.schema.fields[:5]]).add("end_line", rows.schema["total"].dataType)
    return folded(rows, "path", [F.desc("idx")], _Spans, schema)


def outline(heads: Column) -> Column:
    """An array of (line, ...) structs in line order."""
    return F.array_sort(heads)


def next_end(line: Column, following: Column, total: Column) -> Column:
    return F.coalesce(F.greatest(line, following - 1), total)


class _Names:
    """The names that a document's sections have taken, and the ordinal from which each label looks for the next."""

    def __init__(self):
        self.taken, self.next = set(), {}

    def __call__(self, row):
        path, idx, base = row
        name, k = base, self.next.get(base, 2)
        while name in self.taken:  # ordinals are never free again, so the search goes on where it ended
            name, k = f"{base} #{k}", k + 1
        self.taken.add(name)
        self.next[base] = k
        return [(path, idx, name)]


def unique_names(sections: DataFrame) -> DataFrame:
    """(path, idx, name): the label, or 'label #k' with the least k that no earlier section of the document took."""
    base = F.when(F.col("label") == "", F.concat(F.lit("section-"), F.col("line").cast("string"))).otherwise(F.col("label"))
    rows = sections.select("path", "idx", base.alias("base"))
    return folded(rows, "path", ["idx"], _Names, StructType([*rows.schema.fields[:2]]).add("name", StringType()))


def toc(files: DataFrame, sections: DataFrame) -> DataFrame:
    """(path, text): headings indented by level with their line spans. sections: path, idx, signature, line, end_line."""
    sig = F.col("signature")
    line = F.concat(F.repeat(F.lit("  "), heading_level(sig)), heading_label(sig), anchor(F.col("line"), F.col("end_line")))
    body = sections.withColumn("t", line).groupBy("path").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line", "idx", "t"))), lambda x: x["t"]), "\n").alias("body"))
    head = F.concat(F.lit("# "), F.col("path").cast("string"), F.lit("  ["), "lang", F.lit(" · "), F.col("line_count").cast("string"), F.lit(" lines · sha:"), F.substring("sha256", 1, 8), F.lit("]\nsections (L-spans include nested sub-sections):\n"))
    return files.join(body, "path", "left").select("path", F.concat(head, F.coalesce("body", F.lit("  (no headings)"))).alias("text"))


def _first(df: DataFrame, key: str, value: str, most: int) -> DataFrame:
    """(key, shown, n) of the different rows (key, value) of df: the first values in order, at most `most`, joined, and how many there are.

    The limit on the rank goes before the shuffle, so a key with very many values sends each task's first ones only.
    """
    ranked = df.select(key, value).withColumn("rn", F.row_number().over(Window.partitionBy(key).orderBy(value))).where(F.col("rn") <= most)
    shown = ranked.groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rn", F.col(value).cast("string").alias("v")))), lambda x: x["v"]), ", ").alias("shown"))
    return shown.join(df.groupBy(key).agg(F.count(F.lit(1)).alias("n")), key)


def summaries(files: DataFrame, symbols: DataFrame, resolved: DataFrame, callers_of: DataFrame, cached: DataFrame | None = None, project: tuple[str, ...] = (), stamp: Column | None = None) -> DataFrame:
    """(path, text) of each file: five grouped parts joined once by path.

    symbols: path, name, kind, line[, signature, end_line]; callers_of: path, name, from_path, each once, or graph.first_callers()
    of MAX_CALLERS; cached: path, sha256, summary.
    """
    for c, kind in (("signature", "string"), ("end_line", "bigint")):
        if c not in symbols.columns:
            symbols = symbols.withColumn(c, F.lit(None).cast(kind))
    s = symbols.where("kind <> 'module_doc'")
    depth = F.size(F.split("name", "\\."))
    text = F.concat(F.repeat(F.lit("  "), F.when(depth == 1, 1).otherwise(2)), F.coalesce("signature", "name"), anchor(F.col("line"), F.col("end_line")))
    tops = s.where(~dotted(F.col("name"))).select("path", F.col("name").alias("top"), F.col("line").alias("top_line"))
    members = s.where(depth <= 2).withColumn("top", F.substring_index("name", ".", 1)).join(tops, ["path", "top"])
    order = F.struct("top_line", "top", F.when(depth == 1, 0).otherwise(1).alias("d"), "line", "name", text.alias("t"))
    api = members.groupBy("path").agg(F.array_join(F.transform(F.array_sort(F.collect_list(order)), lambda x: x["t"]), "\n").alias("api"))
    imports = resolved.where("kind = 'import'").select(F.col("from_path").alias("path"), "to_name").distinct()
    own = F.substring_index("to_name", ".", 1).isin(*project) if project else F.lit(False)
    flagged = imports.withColumn("own", own).withColumn("any_own", F.max("own").over(Window.partitionBy("path")))
    deps = _first(flagged.where(F.col("own") | ~F.col("any_own")).select("path", "to_name"), "path", "to_name", MAX_DEPS).select("path", F.col("shown").alias("deps"))
    calls = _first(resolved.where("kind = 'call' and to_path is not null and to_path <> from_path").select(F.col("from_path").alias("path"), "to_name").distinct(), "path", "to_name", MAX_CALLS)
    calls = calls.select("path", F.concat("shown", F.when(F.col("n") > MAX_CALLS, F.concat(F.lit(" (+"), (F.col("n") - MAX_CALLS).cast("string"), F.lit(" more)"))).otherwise("")).alias("calls"))
    if "callers" in callers_of.columns:
        lines = callers_of.select(F.struct("path", "name").alias("k"), F.array_join(F.transform("callers", lambda x: x.cast("string")), ", ").alias("shown"), "n")
    else:
        lines = _first(callers_of.select(F.struct("path", "name").alias("k"), "from_path"), "k", "from_path", MAX_CALLERS)
    lines = lines.select("k.*", F.concat(F.lit("  "), F.col("k.name"), F.lit(" ← "), "shown", F.when(F.col("n") > MAX_CALLERS, F.concat(F.lit(" (+"), (F.col("n") - MAX_CALLERS).cast("string"), F.lit(" more)"))).otherwise("")).alias("t"))
    called = lines.groupBy("path").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("name", "t"))), lambda x: x["t"]), "\n").alias("called"))
    doc = symbols.where("kind = 'module_doc'").groupBy("path").agg(F.min_by("signature", "line").alias("doc"))
    out = files.join(api, "path", "left").join(deps, "path", "left").join(calls, "path", "left").join(called, "path", "left").join(doc, "path", "left")
    lead = F.col("doc")
    if cached is not None:
        out = out.join(cached.select("path", "sha256", "summary"), ["path", "sha256"], "left")
        lead = F.coalesce("summary", "doc")
    head = F.concat(F.lit("# "), F.col("path").cast("string"), F.lit("  ["), "lang", F.lit(" · "), F.col("line_count").cast("string"), F.lit(" loc · sha:"), F.substring("sha256", 1, 8), F.lit("]"))
    parts = [head, F.when(lead.isNotNull(), F.concat(F.lit("summary: "), lead)), F.lit("api:"), F.coalesce("api", F.lit("  (none)")), F.concat(F.lit("deps: "), F.coalesce("deps", F.lit("(none)"))),
             F.concat(F.lit("calls: "), F.coalesce("calls", F.lit("(none)"))), F.lit("called_by:"), F.coalesce("called", F.lit("  (none)"))]
    if stamp is not None:
        parts.append(F.concat(F.lit(TIMESTAMP_PREFIX + " "), stamp))
    return out.select("path", F.concat_ws("\n", *parts).alias("text"))


def module_doc(symbols: DataFrame) -> DataFrame:
    return symbols.where("kind = 'module_doc'").select("path", "signature")


__all__ = ["leaf", "module_doc", "next_end", "section_ends", "summaries", "toc", "unique_names"]
