"""Near-duplicate documents by min-max hashing: each permutation gives a minimum and a maximum, so half the hashing.

1. One pass in NumPy: a document's distinct shingles are hashed once; PERMUTATIONS bijections of 32 bits give twice as
   many signature values, and ROWS of them at a time make BANDS keys. The sorted shingles give a 128-bit digest.
2. Documents with one digest are one class; only its smallest id goes on.
3. Classes that share a band key are candidates. A key's members are not paired with each other: each is compared with
   the key's centre, the member with the most company over all its keys. Where keys still join different components,
   their members form clusters, and whoever is not of a cluster's main component is compared with the cluster in tiles:
   blocks of at most BLOCK documents of fitting size, intersected by one matrix product. No pair is ever a row.
   Before texts are read, pairs whose 256 signature bits agree too seldom (five standard deviations below what the
   wanted similarity gives: one linked pair in a million) are out.
4. Every candidate is confirmed on the full shingle sets of both texts; links become components by union-find.

A pair with Jaccard 0.8 shares no key with probability (1 - 0.8 ** ROWS) ** BANDS, about 1e-4 at the defaults; a pair
with Jaccard 0.3 shares one with about 3e-3, so that unrelated documents seldom meet.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratalens.llm.common import components, fresh, merged, sifted, stored

BANDS, ROWS = 50, 8
ENTRIES = 500_000
#: Documents in a block of the second step, and shingles in a slice of its matrix.
BLOCK, SLICE = 256, 1 << 14
SKETCH_BITS = 256
_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


def text_words(text: str | None) -> list[bytes]:
    """Lower-cases A-Z only; words are separated by the six ASCII spaces."""
    return (text or "").encode("utf-8", "surrogatepass").translate(_LOWER).split()


def shingle_set(text: str | None, k: int) -> set:
    w = text_words(text)
    return {tuple(w)} if 0 < len(w) < k else set(zip(*(w[i:] for i in range(k))))


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Signer:
    def __init__(self, k: int, bands: int = BANDS, rows: int = ROWS, seed: int = 7):
        self.k, self.bands, self.rows = k, bands, rows
        n, rng = -(-bands * rows // 2), np.random.default_rng(seed)
        self.a = rng.integers(1 << 31, size=n, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
        self.b = rng.integers(1 << 32, size=n, dtype=np.uint32)
        self.known: dict[bytes, int] = {}

    def hashes(self, text: str | None) -> np.ndarray:
        """Sorted distinct 64-bit hashes of the shingles."""
        parts, known = text_words(text), self.known
        if not parts:
            return np.zeros(0, np.uint64)
        if len(known) > ENTRIES:
            known.clear()
        for p in parts:
            if p not in known:
                known[p] = xxhash.xxh3_64_intdigest(p)
        w = np.fromiter(map(known.__getitem__, parts), np.uint64, len(parts))
        k = min(self.k, len(w))
        h = np.full(len(w) - k + 1, k, np.uint64)
        for i in range(k):
            h = _mix((h + w[i : len(w) - k + 1 + i]) * np.uint64(0x9E3779B97F4A7C15))
        return np.unique(h)

    def signature(self, h: np.ndarray) -> np.ndarray:
        """Minimum and maximum of each permutation: uint32 of length bands * rows."""
        x = (h >> np.uint64(32)).astype(np.uint32)
        low, high = np.full(len(self.a), 0xFFFFFFFF, np.uint32), np.zeros(len(self.a), np.uint32)
        for at in range(0, len(x), 1024):
            y = np.multiply.outer(self.a, x[at : at + 1024])
            y += self.b[:, None]
            y ^= y >> np.uint32(15)
            np.minimum(low, y.min(1), out=low)
            np.maximum(high, y.max(1), out=high)
        return np.stack([low, high], 1).reshape(-1)[: self.bands * self.rows]

    def sketch(self, sig: np.ndarray) -> list[int]:
        """One bit of each of the first SKETCH_BITS signature values, in 64-bit words."""
        bits = _mix(sig[:SKETCH_BITS].astype(np.uint64) + np.arange(min(len(sig), SKETCH_BITS), dtype=np.uint64)) >> np.uint64(63)
        return np.packbits(np.resize(bits.astype(np.uint8), SKETCH_BITS)).view(np.int64).tolist()

    def keys(self, sig: np.ndarray) -> np.ndarray:
        v = sig.reshape(self.bands, self.rows).astype(np.uint64)
        out = np.arange(self.bands, dtype=np.uint64) + np.uint64(1)
        for i in range(self.rows):
            out = _mix(out * np.uint64(0x9E3779B97F4A7C15) + v[:, i])
        return out.view(np.int64)


def sign(docs: DataFrame, k: int, bands: int, rows: int) -> DataFrame:
    """(doc_id, n_shingles, digest, keys) for each row of (doc_id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        signer = Signer(k, bands, rows)
        for b in batches:
            for at in range(0, b.num_rows, 2000):
                part, size, digest, keys, sketch = b.slice(at, 2000), [], [], [], []
                for text in part.column(1).to_pylist():
                    h = signer.hashes(text)
                    size.append(len(h))
                    digest.append(hashlib.blake2b(h.tobytes(), digest_size=16).digest() if len(h) else None)
                    sig = signer.signature(h)
                    keys.append(signer.keys(sig) if len(h) else np.zeros(0, np.int64))
                    sketch.append(signer.sketch(sig))
                ends = np.cumsum([0, *map(len, keys)]).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(keys) if keys else np.zeros(0, np.int64)))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(size, pa.int64()), pa.array(digest, pa.binary()), lists, pa.array(sketch, pa.list_(pa.int64()))], ["doc_id", "n_shingles", "digest", "keys", "sketch"])

    return docs.mapInArrow(run, "doc_id bigint, n_shingles bigint, digest binary, keys array<bigint>, sketch array<bigint>")


def _confirmed(pairs: DataFrame, texts: DataFrame, k: int, percent: int) -> DataFrame:
    """(a, b): the pairs (doc_id, centre) whose full shingle sets have 100 * intersection >= percent * union.

    A centre's documents are dealt to slots of about BLOCK; its text goes once to each slot, before theirs.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, centre = None, []
        for b in batches:
            left, right = [], []
            for at in range(0, b.num_rows, 64):  # texts may be very long
                for c, slot, a, text in zip(*(x.to_pylist() for x in b.slice(at, 64).columns)):
                    if (c, slot) != last:
                        last, centre = (c, slot), []
                    s = shingle_set(text, k)
                    if a is None:
                        centre.append(s)
                    elif any((both := len(s & t)) and 100 * both >= percent * (len(s) + len(t) - both) for t in centre):
                        left.append(a)
                        right.append(c)
            yield pa.RecordBatch.from_arrays([pa.array(left, pa.int64()), pa.array(right, pa.int64())], ["a", "b"])

    sizes = pairs.groupBy("centre").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("slots"))
    member = pairs.join(sizes, "centre").select("centre", F.pmod(F.xxhash64("doc_id"), F.col("slots")).cast("int").alias("slot"), "doc_id", F.lit(True).alias("member"))
    centre = sizes.select("centre", F.explode(F.sequence(F.lit(0), F.col("slots") - 1)).alias("slot"), F.col("centre").alias("doc_id"), F.lit(False).alias("member"))
    wanted = stored(member.union(centre), "wanted")
    filled = wanted.join(sifted(texts, wanted, ["doc_id"]), "doc_id").select("centre", "slot", F.when(F.col("member"), F.col("doc_id")).alias("doc_id"), "text")
    dealt = filled.repartition("centre", "slot").sortWithinPartitions("centre", "slot", F.asc_nulls_first("doc_id"))
    return dealt.mapInArrow(run, "a bigint, b bigint")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5, percent: int = 80, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for every row of docs.

    Rows with one id are one document: a link of any of them counts for all. A null id takes no part (component null,
    kept true, as nothing can name it a copy); a null or blank text has no shingles, is linked with nothing and is its
    own component. Equal texts, and different texts with equal shingle sets, are linked. An empty table gives an empty
    result. Other columns are not read.
    """
    d = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    signed = stored(sign(d, k, bands, rows), "signed")
    named = signed.where("doc_id is not null and n_shingles > 0")
    # classes of equal sets: min() combines before the shuffle, so a third of all rows in one class is no hot task
    classes = stored(named.groupBy("digest").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("n")), "classes")
    reps = named.join(classes.select("digest", F.col("rep").alias("doc_id")), ["digest", "doc_id"], "left_semi").dropDuplicates(["digest"])
    members = reps.select("doc_id", "n_shingles", F.explode("keys").alias("key"))
    sizes = members.groupBy("key").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
    shared = stored(members.join(sizes, "key"), "shared")  # only keys with company
    company = shared.groupBy("doc_id").agg(F.sum(F.col("size") - 1).alias("company"))
    ranked = shared.join(company, "doc_id")
    centres = stored(ranked.groupBy("key").agg(F.max(F.struct("company", (-F.col("doc_id")).alias("neg"), "n_shingles")).alias("m")).select("key", (-F.col("m.neg")).alias("centre"), F.col("m.n_shingles").alias("centre_n")), "centres")
    fits = 100 * F.least("n_shingles", "centre_n") >= percent * F.greatest("n_shingles", "centre_n")
    star = shared.join(centres, "key").where((F.col("doc_id") != F.col("centre")) & fits).select("doc_id", "centre").distinct()
    texts = d.where("doc_id is not null")
    first = stored(_alike(star, reps.select("doc_id", "sketch"), percent), "star")
    links = stored(_confirmed(first, texts, k, percent), "links")
    own = signed.select("doc_id", "n_shingles", "digest")
    # texts without shingles have no digest: they are no key of the join
    classed = own.where("digest is not null").join(classes.select("digest", "rep"), "digest", "left").select("doc_id", "n_shingles", "rep")
    of = stored(classed.union(own.where("digest is null").select("doc_id", "n_shingles", F.lit(None).cast("bigint"))), "class-of")
    roots = stored(components(links.union(_rows_of_one_id(of))), "roots")
    labelled = shared.select("key", "doc_id", "n_shingles").join(roots.withColumnRenamed("node", "doc_id"), "doc_id", "left").withColumn("root", F.coalesce("root", "doc_id"))
    split = labelled.groupBy("key").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), F.count(F.lit(1)).alias("n")).where("lo <> hi and n > 2").select("key")
    open_ = stored(labelled.join(split, "key").join(centres.select("key", "centre"), "key"), "open")
    final = merged(roots, stored(_tiled(open_, texts, k, percent), "more"))
    out = of.join(final.select(F.col("node").alias("rep"), F.col("root").alias("component_id")), "rep", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "rep", "doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def _rows_of_one_id(of: DataFrame) -> DataFrame:
    """(a, b): links between the classes of different texts under one id."""
    several = of.where("doc_id is not null").groupBy("doc_id").agg(F.min("rep").alias("b"), F.max("rep").alias("hi")).where("b <> hi").select("doc_id", "b")
    return of.join(several, "doc_id").where("rep <> b").select(F.col("rep").alias("a"), "b").distinct()


def _tiled(open_: DataFrame, texts: DataFrame, k: int, percent: int) -> DataFrame:
    """(a, b): links between different components among the documents of open keys.

    Documents that share an open key are in one cluster. Two of different components are never both of the cluster's
    largest one, so only the others (`out`) go against the cluster. Sizes in steps of 100 / percent are compatible with
    their neighbours only; within a step, blocks are dealt by hash. A tile is one block of others against one block.
    """
    step = -math.log(percent / 100) * (1 + 1e-9) if percent < 100 else 1e-9  # sizes at the very bound stay neighbours
    clusters = components(open_.where("doc_id <> centre").select(F.col("doc_id").alias("a"), F.col("centre").alias("b")).distinct()).select(F.col("node").alias("doc_id"), F.col("root").alias("cluster"))
    rows = open_.select("doc_id", "n_shingles", "root").distinct().join(clusters, "doc_id").withColumn("step", F.floor(F.log("n_shingles") / step).cast("int"))
    sizes = rows.groupBy("cluster", "root").agg(F.count(F.lit(1)).alias("n")).groupBy("cluster").agg(F.max(F.struct("n", "root")).alias("m")).select("cluster", F.col("m.root").alias("main"))
    rows = stored(rows.join(sizes, "cluster").withColumn("out", F.col("root") != F.col("main")), "clusters")
    blocks = lambda df, name: df.groupBy("cluster", "step").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias(name))
    own = stored(blocks(rows, "nb").join(blocks(rows.where("out"), "no"), ["cluster", "step"], "left"), "blocks")
    near = lambda df: df.withColumn("step", F.explode(F.array(F.col("step") - 1, F.col("step"), F.col("step") + 1)))
    placed = rows.join(own.select("cluster", "step", "nb", F.coalesce("no", F.lit(0)).alias("no")), ["cluster", "step"])
    slot = lambda n: F.pmod(F.xxhash64("doc_id"), F.greatest(F.col(n), F.lit(1))).cast("int")
    placed = placed.select("doc_id", "root", "out", "cluster", "step", slot("nb").alias("h"), slot("no").alias("ho"))
    # others go to every block of fitting size; every document goes to every block of others of fitting size
    left = near(placed.where("out").select("doc_id", "root", "cluster", F.col("step").alias("so"), "ho", "step")).join(own.select("cluster", "step", "nb"), ["cluster", "step"])
    left = left.select("doc_id", "root", F.lit(True).alias("out"), "cluster", "so", "ho", "step", F.explode(F.sequence(F.lit(0), F.col("nb") - 1)).alias("h"))
    right = near(placed.select("doc_id", "root", "cluster", F.col("step").alias("sm"), "h", "step")).join(own.where("no > 0").select("cluster", "step", "no"), ["cluster", "step"])
    right = right.select("doc_id", "root", F.lit(False).alias("out"), "cluster", F.col("step").alias("so"), F.explode(F.sequence(F.lit(0), F.col("no") - 1)).alias("ho"), F.col("sm").alias("step"), "h")
    dealt = left.unionByName(right).withColumn("tile", F.xxhash64("cluster", "so", "ho", "step", "h")).select("tile", "doc_id", "root", "out")
    filled = dealt.join(sifted(texts, rows, ["doc_id"]), "doc_id").select("tile", "doc_id", "root", "out", "text")

    def run(tile: pa.Table) -> pa.Table:
        signer, out = Signer(k), np.array(tile.column("out").to_pylist())
        ids, roots, text = (tile.column(c).to_pylist() for c in ("doc_id", "root", "text"))
        h = [signer.hashes(t) for t in text]
        x, y, pairs = np.flatnonzero(out), np.flatnonzero(~out), set()
        both = intersections([h[i] for i in x], [h[j] for j in y])
        nx, ny = np.array([len(h[i]) for i in x])[:, None], np.array([len(h[j]) for j in y])[None, :]
        rx, ry = np.array([roots[i] for i in x])[:, None], np.array([roots[j] for j in y])[None, :]
        seen = set()
        for i, j in zip(*np.nonzero((100 * both >= percent * (nx + ny - both)) & (rx != ry) & (both > 0))):
            a, b = int(x[i]), int(y[j])
            if (ids[a], roots[b]) not in seen and similar(text[a], text[b], k, percent):  # one link to a component is enough
                seen.add((ids[a], roots[b]))
                pairs.add((ids[a], ids[b]))
        return pa.table({"a": pa.array([p[0] for p in pairs], pa.int64()), "b": pa.array([p[1] for p in pairs], pa.int64())})

    return filled.groupBy("tile").applyInArrow(run, "a bigint, b bigint")


def intersections(x: list[np.ndarray], y: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of all sets of x with all of y, by slices of a 0/1 matrix."""
    out = np.zeros((len(x), len(y)), np.float64)
    if not x or not y:
        return out.astype(np.int64)
    of = lambda sets: (np.concatenate(sets), np.repeat(np.arange(len(sets)), [len(s) for s in sets]))
    (hx, ix), (hy, iy) = of(x), of(y)
    common = np.intersect1d(hx, hy)
    for at in range(0, len(common), SLICE):
        part = common[at : at + SLICE]
        a, b = np.zeros((len(x), len(part)), np.float32), np.zeros((len(y), len(part)), np.float32)
        for m, h, i in ((a, hx, ix), (b, hy, iy)):
            place = np.minimum(np.searchsorted(part, h), len(part) - 1)
            hit = part[place] == h
            m[i[hit], place[hit]] = 1
        out += a @ b.T
    return np.rint(out).astype(np.int64)


def similar(a: str | None, b: str | None, k: int, percent: int) -> bool:
    s, t = shingle_set(a, k), shingle_set(b, k)
    both = len(s & t)
    return both > 0 and 100 * both >= percent * (len(s) + len(t) - both)


def _alike(pairs: DataFrame, sketches: DataFrame, percent: int) -> DataFrame:
    """The pairs (doc_id, centre) whose sketches agree often enough for the wanted similarity."""
    q = (1 + percent / 100) / 2
    least = math.floor(SKETCH_BITS * q - 5 * math.sqrt(SKETCH_BITS * q * (1 - q)))
    x, y = sketches.select("doc_id", F.col("sketch").alias("x")), sketches.select(F.col("doc_id").alias("centre"), F.col("sketch").alias("y"))
    differ = sum((F.bit_count(F.get("x", F.lit(i)).bitwiseXOR(F.get("y", F.lit(i)))) for i in range(SKETCH_BITS // 64)), F.lit(0))
    return pairs.join(x, "doc_id").join(y, "centre").where(SKETCH_BITS - differ >= least).select("doc_id", "centre")


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """One document of each component, with docs' own columns: the one with the smallest id. Rows with a null id stay."""
    mark = fresh(docs, "__dup_of")
    gone = near_duplicates(docs, id_col, text_col, **options).where("not kept").select(F.col("doc_id").alias(mark)).distinct()
    return docs.join(stored(gone, "gone"), F.col(id_col).cast("bigint") == F.col(mark), "left_anti")


def op3_near_duplicates(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"), k=2)
