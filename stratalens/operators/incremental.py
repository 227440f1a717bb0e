"""The code graph kept by buckets, and brought up to date by what changed.

  symbols   (path, name, kind, line)                           by path    what each file defines
  outgoing  (path, to_bucket)                                  by path    the buckets that its edges lie in
  defs      (name, path)                                       by name    who defines a name
  definers  (name, n, to_path)                                 by name    how many do, and the only one where one does
  edges     (from_path, from_name, to_name, kind, line, to_path)  by to_name

A step reads the buckets of the changed paths, of the names that they define or defined, and of their edges; a name's edges
are resolved again only where its only definer became another one. Other buckets are neither read nor written: the new
version of the graph goes on pointing at them. Only numbers of buckets come to the driver.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stratalens.operators.graph import first_wins
from stratalens.sources.versions import BUCKET, Manifest, Versions

BUCKETS = 16
EDGE = ("from_path", "from_name", "to_name", "kind", "line")


def bucket_of(column: str, buckets: int) -> Column:
    return F.pmod(F.xxhash64(F.col(column).cast("string")), F.lit(buckets)).cast("int")


def _definers(defs: DataFrame) -> DataFrame:
    """(name, n, to_path): to_path where exactly one path defines the name."""
    g = defs.groupBy("name").agg(F.count(F.lit(1)).alias("n"), F.min("path").alias("only"))
    return g.select("name", "n", F.when(F.col("n") == 1, F.col("only")).alias("to_path"))


@dataclass
class Step:
    """What a step writes: for each relation its new rows and the buckets that they replace; and the paths to refresh."""

    tables: dict[str, DataFrame]
    replace: dict[str, list[int]]
    refreshed: DataFrame
    read_buckets: list[int]


class CodeGraph:
    """One opened version of the graph."""

    def __init__(self, versions: Versions, manifest: Manifest, buckets: int = BUCKETS):
        self.versions, self.manifest, self.buckets = versions, manifest, buckets

    @staticmethod
    def open(spark: SparkSession, folder: str, buckets: int = BUCKETS, version: int | None = None) -> CodeGraph | None:
        v = Versions(spark, folder)
        m = v.manifest(version)
        return CodeGraph(v, m, buckets) if m else None

    @staticmethod
    def create(symbols: DataFrame, edges: DataFrame, folder: str, buckets: int = BUCKETS) -> CodeGraph:
        """The whole graph anew, of symbols (path, name, kind, line) and edges without to_path."""
        v = Versions(symbols.sparkSession, folder)
        g = CodeGraph(v, Manifest(0, {}), buckets)
        s = first_wins(symbols.select("path", "name", "kind", "line"), ["path", "name"], "line")
        defs = s.select("name", "path")
        definers = _definers(defs)
        e = edges.select(*EDGE).join(definers.select(F.col("name").alias("to_name"), "to_path"), "to_name", "left")
        v.write({k: g._dealt(k, t) for k, t in {"symbols": s, "outgoing": g._outgoing(edges), "defs": defs, "definers": definers, "edges": e}.items()}, partitions=dict.fromkeys(("symbols", "outgoing", "defs", "definers", "edges"), [BUCKET]))
        return CodeGraph(v, v.manifest(), buckets)

    def _outgoing(self, edges: DataFrame) -> DataFrame:
        return edges.select(F.col("from_path").alias("path"), bucket_of("to_name", self.buckets).alias("to_bucket")).distinct()

    def _dealt(self, name: str, df: DataFrame) -> DataFrame:
        """Rows with their bucket, one task a bucket, columns as the relation has them."""
        key = {"symbols": "path", "outgoing": "path", "defs": "name", "definers": "name", "edges": "to_name"}[name]
        order = {"symbols": ("path", "name", "kind", "line"), "outgoing": ("path", "to_bucket"), "defs": ("name", "path"), "definers": ("name", "n", "to_path"), "edges": (*EDGE, "to_path")}[name]
        return df.select(*order, bucket_of(key, self.buckets).alias(BUCKET)).repartition(self.buckets, BUCKET)

    def relation(self, name: str, buckets: list[int] | None = None) -> DataFrame:
        """A relation, or these buckets of it: the scan's partition filter leaves the others alone."""
        df = self.versions.read(name, self.manifest)
        return (df if buckets is None else df.where(F.col(BUCKET).isin(buckets)) if buckets else df.where("false")).drop(BUCKET)

    @staticmethod
    def _numbers(*buckets: DataFrame) -> list[int]:
        """The numbers that stand in some one-column frames: not more than there are buckets."""
        out = buckets[0]
        for b in buckets[1:]:
            out = out.union(b)
        return sorted(r[0] for r in out.distinct().collect())

    def step(self, changed: DataFrame, new_symbols: DataFrame, new_edges: DataFrame) -> Step:
        """What changes when the changed paths (path) define new_symbols and have new_edges, and nothing else of them is left.

        A path without new rows is a deleted file, an unknown one a new file. Refreshed are the changed paths and the
        files with an edge resolved to one of them, before or after.
        """
        n, of = self.buckets, self.relation
        changed = changed.select("path").distinct()
        fresh = first_wins(new_symbols.select("path", "name", "kind", "line"), ["path", "name"], "line")
        own = self._numbers(changed.select(bucket_of("path", n)))
        were = of("symbols", own).join(changed, "path", "left_semi")
        involved = were.select("name").union(fresh.select("name")).distinct()
        names = self._numbers(involved.select(bucket_of("name", n)))
        touched = self._numbers(of("outgoing", own).join(changed, "path", "left_semi").select("to_bucket"), new_edges.select(bucket_of("to_name", n)))

        old_defs = of("defs", names)
        defs = old_defs.join(changed, "path", "left_anti").unionByName(fresh.select("name", "path"))
        redone = _definers(defs.join(involved, "name", "left_semi"))
        definers = of("definers", names).join(involved, "name", "left_anti").unionByName(redone)
        was, now = of("definers", names).select("name", F.col("to_path").alias("was")), redone.select("name", F.col("to_path").alias("now"))
        turned = involved.join(was, "name", "left").join(now, "name", "left").where(~F.col("was").eqNullSafe(F.col("now"))).select("name", "now")

        read, rewritten = sorted({*names, *touched}), self._numbers(turned.select(bucket_of("name", n)), self.versions.spark.createDataFrame([(b,) for b in touched], "b int"))
        edges = of("edges", read)
        stay = edges.join(changed.withColumnRenamed("path", "from_path"), "from_path", "left_anti")
        again = stay.join(turned.select(F.col("name").alias("to_name"), "now", F.lit(True).alias("turn")), "to_name", "left")
        again = again.select(*EDGE, F.when(F.col("turn"), F.col("now")).otherwise(F.col("to_path")).alias("to_path"))
        # names of new edges that no changed file defines keep their definers; of those involved the new ones count
        known = of("definers", touched).join(involved, "name", "left_anti").select("name", "to_path").unionByName(redone.select("name", "to_path"))
        after = again.unionByName(new_edges.select(*EDGE).join(known.withColumnRenamed("name", "to_name"), "to_name", "left").select(*EDGE, "to_path"))

        depend = lambda e: e.join(changed.withColumnRenamed("path", "to_path"), "to_path", "left_semi").where("from_path <> to_path").select(F.col("from_path").alias("path"))
        refreshed = depend(edges).union(depend(after)).union(changed).distinct()
        symbols = of("symbols", own).join(changed, "path", "left_anti").unionByName(fresh)
        outgoing = of("outgoing", own).join(changed, "path", "left_anti").unionByName(self._outgoing(new_edges))
        tables = {"symbols": symbols, "outgoing": outgoing, "defs": defs, "definers": definers, "edges": after.where(bucket_of("to_name", n).isin(rewritten) if rewritten else F.lit(False))}
        replace = {"symbols": own, "outgoing": own, "defs": names, "definers": names, "edges": rewritten}
        return Step({k: self._dealt(k, t) for k, t in tables.items()}, replace, refreshed, read)

    def commit(self, step: Step) -> CodeGraph:
        """The next version: the step's buckets in place of the old ones, all others as they are."""
        self.versions.write(step.tables, append=True, replace=step.replace)
        return CodeGraph(self.versions, self.versions.manifest(), self.buckets)
