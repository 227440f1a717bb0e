"""Source trees as tables: listing, reading and parsing on the executors.

Spark's file sources skip names that begin with _ or ., and so would lose __init__.py; hence tree.py lists the paths and
each task opens its own. Where executors share no file system with the driver, give scan_binary() a glob instead.
"""

from __future__ import annotations

import os
import subprocess
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stratalens.functions.text import excluded
from stratalens.sources import tree
from stratalens.sources.parsers import BINARY, LANGS, PARSERS, function_doc, parse

# Folders that hold no sources of the project, and suffixes that are known but not parsed.
EXCLUDES = ("/__pycache__/", "/.git/", "/.venv/", "/venv/", "/node_modules/", "/.next/", "/dist/", "/build/", "/.ruff_cache/", "/.pytest_cache/", "/.mypy_cache/", "/.claude/")
SKIP_DIRS = ("node_modules", "venv", ".venv", "__pycache__", "dist", "build", ".next", ".git", ".ruff_cache", ".claude", ".pytest_cache", ".mypy_cache", "target")
UNPARSED = (".go", ".rs", ".rb", ".php", ".swift", ".kt", ".scala", ".cs", ".lua", ".dart", ".ex", ".exs", ".clj", ".m")
SIDECAR = ".key.md"

PARSED = "path string, lang string, sha256 string, line_count bigint, symbols array<struct<name:string,kind:string,line:bigint,signature:string,end_line:bigint>>, edges array<struct<from_name:string,to_name:string,kind:string,line:bigint>>"


def project_root(variable: str | None = None) -> str:
    """The folder that a variable names, else the top of the git work tree around here, else this folder."""
    named = os.path.expanduser(os.path.expandvars(os.environ.get(variable or "", "")))
    if named and os.path.exists(named):
        return os.path.realpath(named)
    try:
        top = subprocess.run(["git", "rev-parse", "--show-toplevel"], capture_output=True, text=True, check=True, timeout=2).stdout.strip()
        if os.path.exists(top):
            return os.path.realpath(top)
    except (OSError, subprocess.SubprocessError):
        pass
    return os.path.realpath(os.getcwd())


def excludes(variable: str | None = None) -> tuple[str, ...]:
    """The default exclusions, and those that a variable lists, colon-separated."""
    return EXCLUDES + tuple(x.strip() for x in os.environ.get(variable or "", "").split(":") if x.strip())


def index_roots(root: str, variable: str | None = None) -> list[str]:
    """The folders that a variable lists, else visible child folders with at least one file that a parser takes."""
    if named := [x.strip() for x in os.environ.get(variable or "", "").split(":") if x.strip()]:
        return [x for x in (os.path.join(root, x) for x in named) if os.path.isdir(x)]
    takes = (*PARSERS, *BINARY)
    found = []
    for d in sorted(os.listdir(root)):
        full = os.path.join(root, d)
        if os.path.isdir(full) and not d.startswith(".") and d not in SKIP_DIRS and any(n.endswith(takes) for _, _, names in os.walk(full) for n in names):
            found.append(full)
    return found


def suffix(path: Column) -> Column:
    return F.regexp_extract(path, "(\\.[^./]+)$", 1)


def language(path: Column) -> Column:
    """The label of the suffix, else the bare suffix, else ?."""
    s = suffix(path)
    known = F.create_map(*(x for k, v in LANGS.items() for x in (F.lit(k), F.lit(v))))
    return F.coalesce(known[s], F.when(s != "", F.substring(s, 2, 1 << 20)), F.lit("?"))


def parsed_suffix(path: Column) -> Column:
    return path.rlike("(?:" + "|".join(k.replace(".", "\\.") for k in (*PARSERS, *BINARY)) + ")$")


def paths(spark: SparkSession, roots: Iterable[str], variable: str | None = None, suffixes: Iterable[str] | None = None) -> DataFrame:
    """(path) of the files under the roots, listed on the executors; variable names further exclusions."""
    return tree.dealt(tree.files(spark, roots, excludes(variable), suffixes))


def relevant(path: Column) -> Column:
    """Whether a change of the file matters to the index: a sidecar or a parsed suffix, outside of excluded folders."""
    return ~excluded(path, EXCLUDES) & (path.endswith(SIDECAR) | parsed_suffix(path))


def sources(listed: DataFrame) -> DataFrame:
    return listed.where(parsed_suffix(F.col("path")) & ~F.col("path").endswith(SIDECAR))


def sidecars(listed: DataFrame) -> DataFrame:
    return listed.where(F.col("path").endswith(SIDECAR))


def unsupported(listed: DataFrame) -> DataFrame:
    """(suffix, count) of files of known languages that no parser takes, the most frequent first."""
    s = listed.where(~excluded(F.col("path"), EXCLUDES)).select(suffix(F.col("path")).alias("suffix")).where(F.col("suffix").isin(*UNPARSED))
    return s.groupBy("suffix").count().orderBy(F.desc("count"), "suffix")


def parse_files(listed: DataFrame) -> DataFrame:
    """One row (see PARSED) for each file: read and parsed where the task runs; an unreadable file gives no row."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for p in b["path"]:
                try:
                    with open(p, "rb") as f:
                        rows.append(parse(p, f.read()))
                except OSError:
                    continue
            yield pd.DataFrame(rows, columns=["path", "lang", "sha256", "line_count", "symbols", "edges"])

    return listed.select("path").mapInPandas(run, PARSED)


def parse_contents(df: DataFrame) -> DataFrame:
    """The same for (path, content) rows, from any source that Spark reads."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [parse(p, c if isinstance(c, (bytes, bytearray)) else (c or "").encode()) for p, c in zip(b["path"], b["content"])]
            yield pd.DataFrame(rows, columns=["path", "lang", "sha256", "line_count", "symbols", "edges"])

    return df.select("path", "content").mapInPandas(run, PARSED)


def function_docs(asked: DataFrame) -> DataFrame:
    """(path, name, doc) for (path, name, content): the first line of the named function's docstring, read on demand."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield b[["path", "name"]].assign(doc=[function_doc(t, n or "") for t, n in zip(b["content"], b["name"])])

    kinds = dict(asked.dtypes)
    return asked.select("path", "name", "content").mapInPandas(run, f"path {kinds['path']}, name string, doc string")


def scan_binary(spark: SparkSession, glob: str) -> DataFrame:
    return spark.read.format("binaryFile").load(glob).select("path", "content")


def relations(parsed: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(files, symbols, edges); of symbols with one name in a file the first stays."""
    from stratalens.operators.graph import first_wins

    files = parsed.select("path", "lang", "sha256", "line_count")
    s = parsed.select("path", F.posexplode("symbols").alias("seq", "x")).select("path", "x.*", "seq")
    e = parsed.select("path", F.posexplode("edges").alias("seq", "x")).select(F.col("path").alias("from_path"), "x.*", "seq")
    return files, first_wins(s, ["path", "name"], "seq"), first_wins(e, ["from_path", "from_name", "to_name", "kind", "line"], "seq")
