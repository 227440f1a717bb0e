"""What the training-data operators share: shared storage, word rules, connected components."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words are runs of anything but these six characters.
SPACE = " \t\n\x0b\f\r"
WORD_SPLIT = "[\\x20\\x09-\\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir; a temporary one only where it is unset."""
    conf = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    sc = spark.sparkContext
    if not conf:
        have = sc._jsc.sc().getCheckpointDir()
        conf = have.get() if have.isDefined() else "file://" + tempfile.mkdtemp(prefix="stratalens-")
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        sc.setCheckpointDir(conf)
    return conf


def stored(df: DataFrame, what: str, partition_by: list[str] | None = None, base: str | None = None) -> DataFrame:
    """Cut the lineage: write to the shared folder, or to base in it, and read back. Lost executors don't lose it."""
    spark = df.sparkSession
    path = f"{(base or shared_dir(spark)).rstrip('/')}/{what}-{uuid.uuid4().hex}"
    w = df.write.option("compression", "zstd")
    (w.partitionBy(*partition_by) if partition_by else w).parquet(path)
    return spark.read.schema(df.schema).parquet(path) if not partition_by else spark.read.parquet(path)


def fresh(df: DataFrame, base: str) -> str:
    """A column name that df does not have, whatever its case."""
    have, name = {c.lower() for c in df.columns}, base
    while name.lower() in have:
        name += "_"
    return name


def words(text: Column) -> Column:
    """The words of a text; none for null."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), WORD_SPLIT, -1), "")


def ascii_lower(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


#: Slots of the map that sifted() broadcasts: 4 MB, whatever the input.
MAP_BITS = 1 << 25


def mapped(rows: DataFrame, wanted: DataFrame, on: list[str], seen: str) -> DataFrame:
    """rows with a boolean seen: false only where their `on` columns are not in wanted, by a map of fixed size."""
    slot, word, bits = (fresh(rows, c) for c in ("__slot", "__word", "__bits"))
    place = F.pmod(F.xxhash64(*on), F.lit(MAP_BITS)).alias(slot)
    marks = wanted.select(place).groupBy((F.col(slot) / 64).cast("int").alias(word)).agg(F.expr(f"bit_or(shiftleft(1L, cast(pmod({slot}, 64) AS int)))").alias(bits))
    some = rows.select("*", place).withColumn(word, (F.col(slot) / 64).cast("int")).join(F.broadcast(marks), word, "left")
    return some.select(*rows.columns, F.expr(f"coalesce(shiftright({bits}, cast(pmod({slot}, 64) AS int)) & 1 = 1, false)").alias(seen))


def sifted(rows: DataFrame, wanted: DataFrame, on: list[str]) -> DataFrame:
    """rows without most of those whose `on` columns are not in wanted: a map of fixed size spares them the next shuffle."""
    seen = fresh(rows, "__seen")
    return mapped(rows, wanted, on, seen).where(seen).drop(seen)


def removed(spark: SparkSession, path: str) -> None:
    """Remove a table in the shared folder that nothing needs any more."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def merged(roots: DataFrame, links: DataFrame) -> DataFrame:
    """(node, root) when the links (a, b) come on top of the components of roots (node, root), a root being its own node."""
    root = lambda c: roots.select(F.col("node").alias(c), F.col("root").alias(f"root_{c}"))
    over = links.join(root("a"), "a", "left").join(root("b"), "b", "left").select(F.coalesce("root_a", "a").alias("a"), F.coalesce("root_b", "b").alias("b"))
    top = stored(components(stored(over, "more-links")), "tops").withColumnRenamed("root", "top")
    below = roots.join(top.withColumnRenamed("node", "root"), "root", "left").select("node", F.coalesce("top", "root").alias("root"))
    return stored(below.union(top.join(roots, "node", "left_anti").select("node", "top")), "merged")


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """Distributed union-find over (a, b) edges: returns (node, root), root the smallest node reachable.

    Each round hooks every node to the smallest label around it and then halves the label chains, so a chain of
    length n takes about log n rounds; every round is a table in the shared folder, and the one before it goes. Only a count
    comes to the driver. Grouping is by min(), which combines before the shuffle, so a node with very many edges is no hot task.
    Null ends and self-loops are ignored; an empty input gives an empty result.
    """
    spark, base = edges.sparkSession, f"{shared_dir(edges.sparkSession).rstrip('/')}/components-{uuid.uuid4().hex}"

    def kept(df: DataFrame, n: int) -> DataFrame:
        df.write.option("compression", "zstd").parquet(f"{base}/{n}")
        return spark.read.schema(df.schema).parquet(f"{base}/{n}")

    both = edges.select("a", "b").where("a is not null and b is not null and a <> b")
    e = first = kept(both.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), 0)
    mark = lambda x: tuple(x.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b"))).first())
    last = mark(e)
    # large-star / small-star on edges (a > b): converges to stars pointing at the component's minimum
    for n in range(1, most_rounds + 1):
        sym = e.union(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = sym.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = sym.where("b > a").join(low, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        low2 = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low2, "a")
        new = kept(small.select("a", F.col("m").alias("b")).union(small.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))).where("a <> b").distinct(), n)
        if n > 1:
            removed(spark, f"{base}/{n - 1}")
        e, before, last = new, last, mark(new)
        if before == last:
            break
    else:
        raise RuntimeError(f"no fixed point after {most_rounds} rounds")
    nodes = first.select(F.col("a").alias("node")).union(first.select("b")).distinct()
    return nodes.join(e.select(F.col("a").alias("node"), F.col("b").alias("root")), "node", "left").select("node", F.coalesce("root", "node").alias("root"))
