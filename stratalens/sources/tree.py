"""Source trees listed level by level on the executors, files digested as streams.

Each level is one job: its folders are dealt to tasks, which list them; files and folders go to shared storage, and the
folders are the next level. The driver holds counts, never a path. Filters by suffix and by folder act while a folder is
listed, so what is not wanted is neither written nor read, and folders that are left out are not entered.

Executors must see the tree at the same place, on a shared file system.
"""

from __future__ import annotations

import hashlib
import os
import uuid
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratalens.sources.versions import shared_dir

#: Folders that a task lists, and bytes that are read at a time.
FOLDERS_PER_TASK, PIECE = 64, 1 << 16
#: Files that a task digests.
FILES_PER_TASK = 200


def _list(folder: str, excludes: tuple, suffixes: tuple | None) -> Iterator[tuple[str, bool]]:
    """(path, whether a folder to enter) of a folder's own entries; one that cannot be read has none.

    Links to folders are not entered; a file is known by its canonical path.
    """
    try:
        entries = sorted(os.scandir(folder), key=lambda e: e.name)
    except OSError:
        return
    for e in entries:
        path = f"{folder}/{e.name}"
        if e.is_dir(follow_symlinks=True):
            if not e.is_symlink() and not any(x in f"{path}/" for x in excludes):
                yield path, True
        elif not any(x in path for x in excludes) and (suffixes is None or e.name.endswith(suffixes)):
            yield os.path.realpath(path), False


def files(spark: SparkSession, roots: Iterable[str], excludes: Iterable[str], suffixes: Iterable[str] | None = None, folders_per_task: int = FOLDERS_PER_TASK) -> DataFrame:
    """(path) of all files under the roots, each once; of those with one of the suffixes, where they are given."""
    base, excludes, suffixes = f"{shared_dir(spark)}/tree-{uuid.uuid4().hex}", tuple(excludes), tuple(suffixes) if suffixes is not None else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for folder in b.column(0).to_pylist():
                found = list(_list(folder, excludes, suffixes))
                yield pa.RecordBatch.from_arrays([pa.array([p for p, _ in found], pa.string()), pa.array([d for _, d in found], pa.bool_())], ["path", "is_folder"])

    level, n, at = spark.createDataFrame([(r.rstrip("/") or "/",) for r in dict.fromkeys(roots)], "path string"), 1, 0
    schema = "path string, is_folder boolean"
    while n:
        tasks = max(1, -(-n // folders_per_task))
        level.select("path").repartition(tasks, "path").mapInArrow(run, schema).write.parquet(f"{base}/level={at}")
        level = spark.read.schema(schema).parquet(f"{base}/level={at}").where("is_folder")
        n, at = level.count(), at + 1
    return spark.read.schema(schema).parquet(*(f"{base}/level={i}" for i in range(at))).where("not is_folder").select("path").distinct()


def digests(listed: DataFrame, files_per_task: int | None = None) -> DataFrame:
    """(path, sha256, size, line_count) of listed files, read PIECE bytes at a time; an unreadable file gives no row."""

    def one(path: str):
        h, size, lines = hashlib.sha256(), 0, 0
        try:
            with open(path, "rb") as f:
                while piece := f.read(PIECE):
                    h.update(piece)
                    size, lines = size + len(piece), lines + piece.count(b"\n")
        except OSError:
            return None
        return path, h.hexdigest(), size, lines + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [r for p in b.column(0).to_pylist() if (r := one(p)) is not None]
            cols = list(zip(*rows)) or [()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.string(), pa.int64(), pa.int64()))], ["path", "sha256", "size", "line_count"])

    return dealt(listed, files_per_task or FILES_PER_TASK).select("path").mapInArrow(run, "path string, sha256 string, size bigint, line_count bigint")


def dealt(listed: DataFrame, files_per_task: int = FILES_PER_TASK) -> DataFrame:
    """listed files in tasks of about so many; they are counted first."""
    return listed.repartition(max(1, -(-listed.count() // files_per_task)), "path")
