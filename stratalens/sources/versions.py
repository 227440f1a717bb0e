"""Relations in versions: each write is a new version, seen by readers as a whole or not at all.

A version's parts are written to folders of their own. A manifest that names all parts of all relations, their row counts
and digests, comes last, by the rename of a finished file to its number; the highest number is the current version. A
write that dies before leaves folders that no manifest names. Two writers of one number cannot both succeed. Readers keep
the manifest that they opened. expire() removes what no kept manifest names.

  <folder>/manifests/00000003.json
  <folder>/<relation>/part=00000003-1f2e3d4c/...     appended or rewritten by version 3
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir; one of the session's own only where that is unset."""
    import tempfile

    conf = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not conf:
        have = spark.sparkContext._jsc.sc().getCheckpointDir()
        conf = have.get() if have.isDefined() else "file://" + tempfile.mkdtemp(prefix="stratalens-")
        if not have.isDefined():
            spark.sparkContext.setCheckpointDir(conf)
    return conf.rstrip("/")


#: Spark removes the shuffle files of a query with its end, not only when the driver's memory is next cleaned.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def tidy(spark: SparkSession) -> Iterator[None]:
    """Writes in it leave no shuffle files behind: what comes next reads what they wrote."""
    old = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        if old is None:
            spark.conf.unset(CLEANUP)
        else:
            spark.conf.set(CLEANUP, old)


def kept(df: DataFrame, what: str) -> DataFrame:
    """df written to the shared folder and read back: made once, whatever reads it."""
    path = f"{shared_dir(df.sparkSession)}/{what}-{uuid.uuid4().hex}"
    with tidy(df.sparkSession):
        df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: The partition column whose values can be replaced one by one.
BUCKET = "bucket"


def digest(df: DataFrame):
    """Rows and a digest that no order of rows changes."""
    return F.count(F.lit(1)).alias("rows"), F.coalesce(F.bit_xor(F.xxhash64(*df.columns)), F.lit(0)).alias("digest")


@dataclass(frozen=True)
class Manifest:
    version: int
    relations: dict  # name -> {"schema": json, "partitions": [...], "parts": [{"part", "rows", "digest"[, "buckets"]}]}


class Versions:
    """The versions under one folder, on any file system that Spark writes."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    # ---- the manifests

    def _path(self, *parts: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path("/".join((self.folder, *parts)))

    def _fs(self):
        return self._path().getFileSystem(self.spark._jsc.hadoopConfiguration())

    def numbers(self) -> list[int]:
        fs, at = self._fs(), self._path("manifests")
        names = [s.getPath().getName() for s in fs.listStatus(at)] if fs.exists(at) else []
        return sorted(int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit())

    def manifest(self, version: int | None = None) -> Manifest | None:
        """The manifest of a version, the current one by default; None where there is none."""
        have = self.numbers()
        number = have[-1] if version is None and have else version
        if number not in have:
            return None
        stream = self._fs().open(self._path("manifests", f"{number:08}.json"))
        try:
            text = self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()
        return Manifest(number, json.loads(text))

    def _publish(self, m: Manifest) -> None:
        fs, half, whole = self._fs(), self._path("manifests", f".{m.version:08}-{uuid.uuid4().hex}"), self._path("manifests", f"{m.version:08}.json")
        fs.mkdirs(self._path("manifests"))
        out = fs.create(half, False)
        out.write(bytearray(json.dumps(m.relations).encode()))
        out.close()
        # a rename onto an existing file fails on shared stores; where it would replace, the check before it narrows the gap
        if fs.exists(whole) or not fs.rename(half, whole):
            fs.delete(half, False)
            raise RuntimeError(f"version {m.version} was written by somebody else")

    # ---- writing

    def write(self, tables: dict, append: bool = False, partitions: dict[str, list[str]] | None = None, replace: dict[str, list[int]] | None = None) -> int:
        """A new version with these relations; with append they come on top of the current ones, else in place of all.

        With replace, the new rows of a relation partitioned by BUCKET take the place of these of its buckets. A table may
        be a function of those before it as they were written. Row counts and digests are read back.
        """
        now = self.manifest()
        number = now.version + 1 if now else 1
        relations = json.loads(json.dumps(now.relations)) if now and append else {}
        part = f"{number:08}-{uuid.uuid4().hex[:8]}"
        written: dict[str, DataFrame] = {}
        for name, table in tables.items():
            df = table(written) if callable(table) else table
            of = relations.get(name, {"parts": []})
            by = (partitions or {}).get(name, of.get("partitions", []))
            path = f"{self.folder}/{name}/part={part}"
            with tidy(self.spark):
                df.write.partitionBy(*by).option("parquet.writer.version", "PARQUET_2_0").parquet(path)
            written[name] = self.spark.read.schema(df.schema).parquet(path)
            new = self._measured(written[name], part, by)
            gone = {str(b) for b in (replace or {}).get(name, [])}
            for p in of["parts"] if gone else []:
                p["buckets"] = {b: m for b, m in p["buckets"].items() if b not in gone}
                p["whole"] = False
            relations[name] = {"schema": df.schema.json(), "partitions": by, "parts": [*(p for p in of["parts"] if p.get("buckets") != {}), new]}
        self._publish(Manifest(number, relations))
        return number

    @staticmethod
    def _measured(df: DataFrame, part: str, by: list[str]) -> dict:
        if by != [BUCKET]:
            rows, mark = df.agg(*digest(df)).first()
            return {"part": part, "rows": rows, "digest": mark}
        got = df.groupBy(BUCKET).agg(*digest(df)).collect()  # a row a bucket
        return {"part": part, "whole": True, "buckets": {str(r[BUCKET]): [r["rows"], r["digest"]] for r in got}, "rows": sum(r["rows"] for r in got)}

    # ---- reading

    def read(self, name: str, manifest: Manifest | None = None, with_part: bool = False) -> DataFrame:
        """A relation of a manifest, the current one by default; a later write doesn't change what was opened."""
        m = manifest or self.manifest()
        if m is None or name not in m.relations:
            raise FileNotFoundError(f"{self.folder} has no relation {name}")
        of = m.relations[name]
        schema, base = StructType.fromJson(json.loads(of["schema"])), f"{self.folder}/{name}"
        full, roots = StructType([*schema.fields]).add("part", "string"), []
        for p in of["parts"]:
            root = f"{base}/part={p['part']}"
            roots += [root] if p.get("whole", True) else [f"{root}/{BUCKET}={b}" for b in p["buckets"]]
        df = self.spark.read.option("basePath", base).schema(full).parquet(*roots) if roots else self.spark.createDataFrame([], full)
        return df.select(*schema.names, *(["part"] if with_part else []))

    def verified(self, manifest: Manifest | None = None) -> bool:
        """Whether every part still has the rows and the digests of its manifest."""
        m = manifest or self.manifest()
        for name, of in m.relations.items() if m else ():
            df, keys = self.read(name, m, with_part=True), ["part", *(of["partitions"] if of["partitions"] == [BUCKET] else [])]
            got = {tuple(str(r[k]) for k in keys): [r["rows"], r["digest"]] for r in df.groupBy(*keys).agg(*digest(df.drop("part"))).collect()}
            want = {(p["part"], b): m for p in of["parts"] if "buckets" in p for b, m in p["buckets"].items()} | {(p["part"],): [p["rows"], p["digest"]] for p in of["parts"] if "buckets" not in p and p["rows"]}
            if got != want:
                return False
        return True

    def expire(self, keep: int = 2) -> list[str]:
        """Remove all but the last manifests, then every part that none of them names; parts of a write under way are not spared."""
        fs, have = self._fs(), self.numbers()
        for n in have[: -keep or None]:
            fs.delete(self._path("manifests", f"{n:08}.json"), False)
        named = {f"{name}/part={p['part']}" for n in self.numbers() for name, of in self.manifest(n).relations.items() for p in of["parts"]}
        gone = []
        for s in fs.listStatus(self._path()):
            name = s.getPath().getName()
            if s.isDirectory() and name != "manifests":
                gone += [f"{name}/{x.getPath().getName()}" for x in fs.listStatus(s.getPath()) if f"{name}/{x.getPath().getName()}" not in named]
        for g in gone:
            fs.delete(self._path(*g.split("/")), True)
        return gone
