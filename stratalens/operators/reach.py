"""How many different callers the names of a file have together, without a row for any pair of a file and a caller.

A popular name that very many files define and very many files call makes as many pairs as both numbers multiplied. Here
callers are numbered and dealt to blocks; a name's callers in a block are one list of short numbers, stored once, and bits
in memory; a file's callers in a block are the names' bits or-ed and counted. Files with the same names are one set, counted
once. A task is one block of callers with a group of the sets, which stream by; it holds the block's names only.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType

from stratalens.session import dealt
from stratalens.sources.versions import kept

#: Callers in a block (a short numbers them, with room for blocks that get more than others), (name, caller) rows in a block,
#: and sets in a group, all about.
BLOCK, ENTRIES, GROUP = 3 << 13, 1 << 23, 1 << 18
#: Bytes of bits that are or-ed at once.
AT_ONCE = 1 << 25
SIZES = "k1 bigint, k2 bigint, n bigint"


class _Block:
    """The callers of a block's names: rows of 64-bit words for names with many, lists for the others."""

    def __init__(self):
        self.names, self.lists, self.bits = {}, [], None

    def add(self, name, callers: np.ndarray) -> None:
        self.names[name] = len(self.lists)
        self.lists.append(callers)

    def close(self) -> None:
        width = (max((int(x.max()) for x in self.lists), default=0) >> 6) + 1
        many = [i for i, x in enumerate(self.lists) if len(x) * 4 >= width]
        self.width, self.row = width, np.full(len(self.lists) + 1, -1, np.int64)
        self.row[many] = np.arange(len(many))
        self.bits = np.zeros((len(many), width), np.uint64)
        for r, i in enumerate(many):
            line = np.zeros(width * 64, np.uint8)
            line[self.lists[i]] = 1
            self.bits[r] = np.packbits(line, bitorder="little").view(np.uint64)
            self.lists[i] = None
        few = [x if x is not None else np.zeros(0, np.int32) for x in self.lists]
        self.ends = np.concatenate([[0], np.cumsum([len(x) for x in few])]).astype(np.int64)
        self.flat = np.concatenate(few) if few else np.zeros(0, np.int32)
        self.lists = self.keys = None

    def _ids(self, names: pa.Array) -> np.ndarray:
        """The places of names in this block, -1 where none of its callers calls them."""
        distinct = names.dictionary_encode()
        ids = np.array([self.names.get(x, -1) for x in distinct.dictionary.to_pylist()], np.int64)
        return ids[distinct.indices.to_numpy(zero_copy_only=False)] if len(ids) else np.zeros(0, np.int64)

    def calls(self, names: pa.Array, i: np.ndarray) -> np.ndarray:
        """Whether the caller of each number calls the name beside it."""
        if self.keys is None:  # the lists as sorted numbers, to look up
            self.keys = np.sort(np.repeat(np.arange(len(self.ends) - 1), self.ends[1:] - self.ends[:-1]) * (self.width * 64) + self.flat)
        ids, out = self._ids(names), np.zeros(len(i), bool)
        known = np.flatnonzero((ids >= 0) & (i < self.width * 64))
        row, i = self.row[ids[known]], i[known].astype(np.int64)
        many = row >= 0
        out[known[many]] = (self.bits[row[many], i[many] >> 6] >> (i[many] & 63).astype(np.uint64)) & np.uint64(1)
        key = ids[known[~many]] * (self.width * 64) + i[~many]
        if len(self.keys):
            out[known[~many]] = self.keys[np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)] == key
        return out

    def counts(self, names: pa.ListArray) -> np.ndarray:
        """The number of different callers of each list of names."""
        ids = self._ids(names.flatten())
        of = np.repeat(np.arange(len(names)), names.value_lengths().to_numpy(zero_copy_only=False))
        of, ids = of[ids >= 0], ids[ids >= 0]
        out, step = np.zeros(len(names), np.int64), max(1, AT_ONCE // (8 * self.width))
        start = 0
        while start < len(of):
            end = min(len(of), start + step)
            if end < len(of) and of[end] == of[end - 1]:  # no set is cut; a very long one is a piece of its own
                first = int(np.searchsorted(of, of[end - 1]))
                end = first if first > start else int(np.searchsorted(of, of[end - 1], "right"))
            self._count(of[start:end], ids[start:end], out)
            start = end
        return out

    def _count(self, of: np.ndarray, ids: np.ndarray, out: np.ndarray) -> None:
        sets, at = np.unique(of, return_inverse=True)
        acc, row = np.zeros((len(sets), self.width), np.uint64), self.row[ids]
        many = row >= 0
        if many.any():
            where = at[many]
            begins = np.flatnonzero(np.r_[True, where[1:] != where[:-1]])
            acc[where[begins]] = np.bitwise_or.reduceat(self.bits[row[many]], begins, axis=0)
        few, n = ids[~many], (self.ends[1:] - self.ends[:-1])[ids[~many]]
        if n.sum():
            places = np.repeat(self.ends[few] - np.r_[0, np.cumsum(n)[:-1]], n) + np.arange(n.sum())
            bit = self.flat[places].astype(np.uint64)
            np.bitwise_or.at(acc, (np.repeat(at[~many], n), (bit >> np.uint64(6)).astype(np.int64)), np.uint64(1) << (bit & np.uint64(63)))
        out[sets] = np.bitwise_count(acc).sum(axis=1)


def _tiles(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[_Block, pa.RecordBatch]]:
    """A tile's block with each run of its other rows, of rows (tile, part, names, at, ...): a tile's names (part 0) come first."""
    tile, block = None, None
    for b in batches:
        key = np.stack([b.column(n).to_numpy(zero_copy_only=False) for n in ("tile", "part")], 1)
        cuts = [0, *(np.flatnonzero((key[1:] != key[:-1]).any(axis=1)) + 1), b.num_rows]
        for lo, hi in zip(cuts, cuts[1:]):
            if lo == hi:
                continue
            rows = b.slice(lo, hi - lo)
            if key[lo, 0] != tile:
                tile, block = key[lo, 0], _Block()
            if key[lo, 1] == 0:
                at = rows.column("at")
                for name, callers in zip(rows.column("names").flatten().to_pylist(), np.split(at.flatten().to_numpy(), np.cumsum(at.value_lengths().to_numpy())[:-1])):
                    block.add(name, callers)
                continue
            if block.bits is None:
                block.close()
            yield block, rows


def _sizes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for block, rows in _tiles(batches):
        yield pa.RecordBatch.from_arrays([rows.column("k1"), rows.column("k2"), pa.array(block.counts(rows.column("names")))], ["k1", "k2", "n"])


def _hits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for block, rows in _tiles(batches):
        names, n = rows.column("names"), rows.column("names").value_lengths().to_numpy()
        i = np.repeat(rows.column("i").to_numpy(zero_copy_only=False), n)
        hit = pa.ListArray.from_arrays(np.r_[0, np.cumsum(n)].astype(np.int32), pa.array(block.calls(names.flatten(), i)))
        rest = [c for c in rows.schema.names if c not in ("tile", "part", "at", "i")]
        yield pa.RecordBatch.from_arrays([*(rows.column(c) for c in rest), hit], [*rest, "hit"])


@dataclass(frozen=True)
class Lists:
    """The callers of names: names (name, id), numbers (caller, block, i) in the order of callers in a block, and lists
    (id, block, at), a name's different callers in a block. All are stored, so what made them is no longer on disk."""

    names: DataFrame
    numbers: DataFrame
    lists: DataFrame
    blocks: int

    def counts(self) -> DataFrame:
        """(name, n): how many different callers a name has; names without any are not listed."""
        n = self.lists.groupBy("id").agg(F.sum(F.size("at")).cast("bigint").alias("n"))
        return kept(self.names.join(n, "id").select("name", "n"), "caller-counts")

    def own(self, defined: DataFrame) -> DataFrame:
        """(path, id) of defined (path, id): the names that a file both defines and calls."""
        mine = defined.join(self.numbers.withColumnRenamed("caller", "path"), "path").select("path", "id", "block", "i")
        return kept(mine.join(self.lists, ["id", "block"]).where(F.array_contains("at", F.col("i"))).select("path", "id"), "own-names")


def listed(names: DataFrame, callers: DataFrame, block: int = BLOCK, entries: int = ENTRIES) -> Lists:
    """The Lists of callers (name, caller) of the names (name); rows of callers may repeat."""
    names = kept(names.select("name").distinct().withColumn("id", F.monotonically_increasing_id()), "names")
    met = callers.join(names, "name").select("id", "caller")
    each = kept(met.groupBy("caller").agg(F.count(F.lit(1)).alias("n")), "callers")
    n, rows = each.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    blocks = max(1, -(-n // block), -(-rows // entries))
    number = (F.row_number().over(Window.partitionBy("block").orderBy("caller")) - 1).cast("smallint").alias("i")
    numbers = kept(each.select("caller", F.pmod(F.xxhash64("caller"), F.lit(blocks)).cast("int").alias("block")).select("caller", "block", number), "caller-numbers")
    at = dealt(met.join(numbers, "caller").select("id", "block", "i"), rows, "id", "block").groupBy("id", "block").agg(F.sort_array(F.collect_set("i")).alias("at"))
    return Lists(names, numbers, kept(at, "caller-lists"), blocks)


def _each(to: int):
    return F.explode(F.sequence(F.lit(0), F.lit(to - 1)))


def _tiled(of: Lists, groups: int, rows: DataFrame) -> DataFrame:
    """rows (tile, names, ...) by tiles, the names and callers of each tile's block before them: a tile is block * groups + group."""
    others = [c for c in rows.columns if c not in ("tile", "names")]
    bits = of.lists.select("block", "id", "at", _each(groups).alias("group"))
    bits = bits.select((F.col("block") * groups + F.col("group")).alias("tile"), F.lit(0).alias("part"), F.array("id").alias("names"), "at", *(F.lit(None).cast(rows.schema[c].dataType).alias(c) for c in others))
    rows = rows.select("tile", F.lit(1).alias("part"), "names", F.lit(None).cast("array<smallint>").alias("at"), *others)
    return bits.union(rows).repartition(of.blocks * groups, "tile").sortWithinPartitions("tile", "part")


def union_sizes(sets: DataFrame, of: Lists, group: int = GROUP) -> DataFrame:
    """(k1, k2, n) of sets (k1, k2, names), each once: the different callers of its names, which are ids."""
    groups = max(1, -(-sets.count() // group), -(-2 * sets.sparkSession.sparkContext.defaultParallelism // of.blocks))
    own = F.pmod(F.col("k1"), F.lit(groups)).cast("int")
    rows = sets.select("k1", "k2", "names", own.alias("group"), _each(of.blocks).alias("block")).select((F.col("block") * groups + F.col("group")).alias("tile"), "k1", "k2", "names")
    return _tiled(of, groups, rows).mapInArrow(_sizes, SIZES).groupBy("k1", "k2").agg(F.sum("n").alias("n"))


def called(asked: DataFrame, of: Lists, group: int = GROUP) -> DataFrame:
    """asked (path, caller, names), names being ids, with hit: whether the caller calls each of them, an array of booleans.

    Rows of callers that call none of the Lists' names are left out. Each row goes to the one tile of its caller's block.
    """
    asked = asked.join(of.numbers, "caller")
    groups = max(1, -(-asked.count() // (of.blocks * group)), -(-2 * asked.sparkSession.sparkContext.defaultParallelism // of.blocks))
    tile = F.col("block") * groups + F.pmod(F.xxhash64("path"), F.lit(groups)).cast("int")
    rows = asked.select(tile.alias("tile"), "names", "path", "caller", "i")
    out = asked.select("names", "path", "caller").schema.add("hit", ArrayType(BooleanType()))
    return _tiled(of, groups, rows).mapInArrow(_hits, out)


def reached(defined: DataFrame, callers: DataFrame, group: int = GROUP, **sizes) -> DataFrame:
    """(path, n): how many files other than path call one of the names that it defines.

    defined is (path, name); callers is (name, caller), rows of which may repeat.
    """
    return reached_in(defined, listed(defined, callers, **sizes), group)


def reached_in(defined: DataFrame, of: Lists, group: int = GROUP) -> DataFrame:
    """reached() of the names' Lists. Files with the same names are one set, known by 128 bits of them."""
    ids = defined.join(of.names, "name").select("path", "id")
    sets = dealt(ids, defined.count(), "path").groupBy("path").agg(F.sort_array(F.collect_set("id")).alias("names"))
    sets = kept(sets.select("path", F.xxhash64("names").alias("k1"), F.xxhash64(F.lit(1), "names").alias("k2"), "names"), "name-sets")
    n = union_sizes(kept(sets.groupBy("k1", "k2").agg(F.first("names").alias("names")), "sets"), of, group)
    own = of.own(ids).select("path").distinct().withColumn("me", F.lit(1))
    return sets.select("path", "k1", "k2").join(n, ["k1", "k2"]).join(own, "path", "left").select("path", (F.col("n") - F.coalesce("me", F.lit(0))).alias("n"))
