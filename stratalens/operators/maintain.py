"""Keeping an index current: upserts, carried-over caches, work queues, and the incremental step."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructType

from stratalens.functions.text import leaf
from stratalens.operators.fold import folded
from stratalens.operators.graph import dependents, first_wins, resolve
from stratalens.session import dealt


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """old with new's rows in place of those with equal keys. Last wins."""
    return old.join(new.select(*keys).distinct(), keys, "left_anti").unionByName(new)


def delete(old: DataFrame, gone: DataFrame, keys: list[str]) -> DataFrame:
    return old.join(gone.select(*keys).distinct(), keys, "left_anti")


def carry_over(cache: DataFrame, files: DataFrame) -> DataFrame:
    """Cached rows whose (path, sha256) the files still have."""
    return cache.join(files.select("path", "sha256").distinct(), ["path", "sha256"], "left_semi")


def queue(files: DataFrame, cache: DataFrame, threshold: int) -> DataFrame:
    """Large files without a valid cached summary, in path order: what a summarizer has to do."""
    return files.where(F.col("line_count") > threshold).join(cache.select("path", "sha256").distinct(), ["path", "sha256"], "left_anti")


def summarize(todo: DataFrame, model, text_col: str = "text") -> DataFrame:
    """(path, sha256, summary) from model(text) -> str | None on the executors; a failing call gives no row, never an error."""
    def one(text):
        try:
            return model(text)
        except Exception:  # one file must not stop the others
            return None

    def run(batches):
        for b in batches:  # a text at a time: a batch's texts are never all Python strings at once
            got = pa.array([one(x.as_py()) for x in b.column("text")], pa.string())
            yield pa.RecordBatch.from_arrays([b.column("path"), b.column("sha256"), got], ["path", "sha256", "summary"]).filter(got.is_valid())

    kinds = dict(todo.dtypes)
    return todo.select("path", "sha256", F.col(text_col).alias("text")).mapInArrow(run, f"path {kinds['path']}, sha256 string, summary string")


def within_budget(summaries: DataFrame, limit: int) -> DataFrame:
    """The first successes in path order; failed calls, which gave no row, cost nothing of the budget."""
    return summaries.orderBy("path").limit(limit)


def missing(files: DataFrame, sidecars: DataFrame, top: int = 30, least: int = 50) -> DataFrame:
    """The longest files without a sidecar."""
    return files.where(F.col("line_count") > least).join(sidecars.select("path").distinct(), "path", "left_anti").select("path", "line_count").orderBy(F.desc("line_count"), "path").limit(top)


def leaves(symbols: DataFrame, rows: int = 0) -> DataFrame:
    n = symbols.select("path", "name")
    return dealt(n.union(n.select("path", leaf(F.col("name")))), 2 * rows, "path", "name").distinct()


def lost(old: DataFrame, new: DataFrame, rows: int = 0) -> DataFrame:
    """(path, name) that a file defined, whole or by leaf, and defines no more; rows: about how many symbols, where many."""
    return leaves(old, rows).join(leaves(new, rows), ["path", "name"], "left_anti")


def sync(symbols: DataFrame, edges: DataFrame, new_symbols: DataFrame, new_edges: DataFrame, changed: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(symbols, edges, to refresh) after the changed paths were parsed again.

    Every name is resolved anew, so an incremental step always equals a rebuild. Refreshed are the changed files and
    their dependents before and after.
    """
    before = dependents(edges, changed)
    s = first_wins(delete(symbols, changed, ["path"]).unionByName(new_symbols), ["path", "name"], "line")
    gone = changed.select(F.col("path").alias("from_path"))
    kept = edges.drop("to_path").join(gone.distinct(), "from_path", "left_anti")
    e = resolve(kept.unionByName(new_edges.drop("to_path")), s)
    return s, e, before.union(dependents(e, changed)).union(changed.select("path")).distinct()


class _Text:
    """A file's text while its edits come in: one applies where its snippet stands exactly once."""

    def __init__(self):
        self.text = None

    def __call__(self, row):
        path, seq, old, new, text = row
        if seq is None:
            self.text = text or ""
            return []
        if self.text is None:
            return [(path, seq, "no file", None)]
        n = self.text.count(old) if old else 0
        if n != 1:
            return [(path, seq, "not found" if n == 0 else "ambiguous", None)]
        self.text = self.text.replace(old, new or "")
        return [(path, seq, "edited", self.text)]


def apply_edits(files: DataFrame, edits: DataFrame) -> DataFrame:
    """(path, seq, outcome, text) of edits (path, seq, old, new) to files (path, text), one file's in the order of seq.

    Each edit sees what those before it have made. text is the file's after an edit that applied, else null: an unknown
    file, a snippet that is empty, missing or there more than once. Files without edits are not read further.
    """
    kind = dict(edits.dtypes)["seq"]
    mine = files.join(edits.select("path").distinct(), "path", "left_semi").select("path", F.lit(None).cast(kind).alias("seq"), F.lit(None).cast("string").alias("old"), F.lit(None).cast("string").alias("new"), F.col("text").cast("string"))
    rows = mine.unionByName(edits.select("path", "seq", "old", "new", F.lit(None).cast("string").alias("text")))
    schema = StructType([*rows.schema.fields[:2]]).add("outcome", StringType()).add("text", StringType())
    return folded(rows, "path", [F.asc_nulls_first("seq")], _Text, schema)


def edited(outcomes: DataFrame) -> DataFrame:
    """(path, text) of the files that apply_edits() changed, as their last edit left them: what is to be written and indexed again."""
    return outcomes.where("outcome = 'edited'").groupBy("path").agg(F.max_by("text", "seq").alias("text"))


def changed_sidecars(rendered: DataFrame, stored: DataFrame, body: Column | None = None) -> DataFrame:
    """Rendered sidecars whose text, but for its time stamp, differs from the stored one."""
    from stratalens.functions.text import strip_timestamp

    key = F.sha2(strip_timestamp(F.col("text")), 256)
    return rendered.withColumn("k", key).join(stored.select("path", key.alias("k")), ["path", "k"], "left_anti").drop("k")
