"""Token ids as binary files: canonical length-limited Huffman codes from global counts, read back block by block.

Layout of a dataset folder (Parquet as the container, so that any store Spark can write will do):
  codebook/  id, bits: code lengths; the canonical codes follow from them
  shards/    shard, block, first_token, n_tokens, data: one row a block, in ascending document order
A block's `data` stands alone: header, document table, bit offsets of every CHECKPOINT-th token, then the codes,
most significant bit first. All tokens between two checkpoints decode independently, so a block decodes with one table
lookup per step for all its lanes at once.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from stratalens.llm.common import shared_dir, stored
from stratalens.llm.tokens import Encoder

END_ID = 0
MAGIC, HEAD = b"SLHB", "<4sIQQII"  # magic, checkpoint distance, first token, tokens, documents, payload bytes
CHECKPOINT, BLOCK_TOKENS, SHARD_TOKENS = 64, 1 << 17, 1 << 22
#: Shards whose sizes are summed together.
STRETCH = 1024
NULL_ID = -(1 << 63)


def code_lengths(counts: np.ndarray, limit: int) -> np.ndarray:
    """Optimal code lengths of at most `limit` bits by package-merge; 0 for ids that never come."""
    used = np.flatnonzero(counts)
    bits = np.zeros(len(counts), np.uint8)
    if len(used) <= 1:
        bits[used] = 1
        return bits
    used = used[np.argsort(counts[used], kind="stable")]
    levels, weights = [], counts[used].astype(np.int64)
    current = weights
    for _ in range(limit - 1):
        pairs = current[: len(current) // 2 * 2].reshape(-1, 2).sum(1)
        merged = np.concatenate([weights, pairs])
        order = np.argsort(merged, kind="stable")
        levels.append(order)
        current = merged[order]
    take, n = 2 * len(used) - 2, len(used)
    for order in reversed(levels):
        chosen = order[:take]
        bits[used[chosen[chosen < n]]] += 1
        take = 2 * int((chosen >= n).sum())
    bits[used[:take]] += 1
    return bits


def limit_for(n_ids: int) -> int:
    return max(8, int(np.ceil(np.log2(max(n_ids, 2)))) + 2)


def canonical(bits: np.ndarray) -> np.ndarray:
    """Codes in order of (length, id)."""
    codes, order = np.zeros(len(bits), np.uint32), np.lexsort((np.arange(len(bits)), bits))
    order = order[bits[order] > 0]
    if len(order):
        lengths = bits[order].astype(np.int64)
        top = int(lengths.max())
        starts = np.cumsum(np.concatenate([[0], 1 << (top - lengths[:-1])]))
        codes[order] = (starts >> (top - lengths)).astype(np.uint32)
    return codes


def decode_table(bits: np.ndarray) -> tuple[int, np.ndarray, np.ndarray]:
    """(top, ids, lengths): what the next `top` bits begin with."""
    top = max(1, int(bits.max(initial=1)))
    codes, used = canonical(bits), np.flatnonzero(bits)
    ids, lengths = np.zeros(1 << top, np.uint32), np.ones(1 << top, np.uint8)
    used = used[np.argsort(codes[used].astype(np.int64) << (top - bits[used].astype(np.int64)))]
    span = 1 << (top - bits[used].astype(np.int64))
    n = int(span.sum())
    ids[:n], lengths[:n] = np.repeat(used, span), np.repeat(bits[used], span)
    return top, ids, lengths


def write_bits(ids: np.ndarray, bits: np.ndarray, codes: np.ndarray) -> tuple[bytes, np.ndarray]:
    """The codes of ids one after the other, and the bit at which each begins."""
    size = bits[ids].astype(np.int64)
    ends = np.cumsum(size)
    begins = ends - size
    if not len(ids):
        return b"", begins
    word = begins >> 5
    value = codes[ids].astype(np.uint64) << (64 - (begins & 31) - size).astype(np.uint64)
    first = np.flatnonzero(np.diff(word, prepend=-1))  # codes are shorter than a word, so every word has one beginning
    out = np.zeros(int(word[-1]) + 2, np.uint64)
    out[:-1] += np.add.reduceat(value >> np.uint64(32), first)
    out[1:] += np.add.reduceat(value & np.uint64(0xFFFFFFFF), first)
    return out.astype(">u4").tobytes()[: int(ends[-1] + 7) // 8], begins


def encode_block(docs: list[tuple[int | None, np.ndarray]], first_token: int, bits: np.ndarray, codes: np.ndarray) -> bytes:
    ids = np.concatenate([d[1] for d in docs])
    payload, begins = write_bits(ids, bits, codes)
    marks = begins[::CHECKPOINT].astype("<u8")
    head = struct.pack(HEAD, MAGIC, CHECKPOINT, first_token, len(ids), len(docs), len(payload))
    names = np.array([NULL_ID if d[0] is None else d[0] for d in docs], "<i8")
    lengths = np.array([len(d[1]) for d in docs], "<u8")
    return head + names.tobytes() + lengths.tobytes() + marks.tobytes() + payload


def decode_block(data: bytes, table) -> tuple[int, np.ndarray, np.ndarray, np.ndarray]:
    """(first token, document ids, their lengths, all ids of the block)."""
    magic, every, first_token, n, n_docs, size = struct.unpack_from(HEAD, data)
    if magic != MAGIC:
        raise ValueError("not a token block")
    at = struct.calcsize(HEAD)
    names = np.frombuffer(data, "<i8", n_docs, at)
    lengths = np.frombuffer(data, "<u8", n_docs, at + 8 * n_docs).astype(np.int64)
    lanes = -(-n // every)
    pos = np.frombuffer(data, "<u8", lanes, at + 16 * n_docs).astype(np.int64)
    payload = np.frombuffer(data, np.uint8, size, at + 16 * n_docs + 8 * lanes)
    top, ids, bits = table
    b = np.concatenate([payload, np.zeros(8 + every * 4, np.uint8)]).astype(np.uint32)
    word = (b[:-3] << 24) | (b[1:-2] << 16) | (b[2:-1] << 8) | b[3:]
    out, last = np.empty((lanes, every), np.uint32), len(word) - 1
    for k in range(every):
        code = (word[np.minimum(pos >> 3, last)] << (pos & 7).astype(np.uint32)) >> np.uint32(32 - top)
        out[:, k] = ids[code]
        pos += bits[code]
    return first_token, names, lengths, out.reshape(-1)[:n]


def write_tokens(docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None, end_id: int = END_ID) -> str:
    """Write the ids of every text, end_id after each, in ascending id order (nulls first); returns the folder.

    Null and empty texts are the end id alone; repeated ids keep all their rows, in order of their ids. An empty table
    writes an empty folder. Other columns are not read.
    """
    spark = docs.sparkSession
    path = path or f"{shared_dir(spark).rstrip('/')}/tokens-{uuid.uuid4().hex}"

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, end, total = Encoder(tokenizer), np.array([end_id], "<u4"), np.zeros(1 << 16, np.int64)
        names = ["doc_id", "n", "ids", "counts"]
        for b in batches:
            for i in range(0, b.num_rows, 1000):
                part = b.slice(i, 1000)
                ids = [np.concatenate([x, end]) for x in encoder.encode(part.column(1).to_pylist())]
                c = np.bincount(np.concatenate(ids))
                if len(c) > len(total):
                    total = np.concatenate([total, np.zeros(len(c) - len(total), np.int64)])
                total[: len(c)] += c
                wide = [x.astype("<u2").tobytes() if x.max() < 1 << 16 else b"+" + x.tobytes() for x in ids]  # an odd size marks 32 bits
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(map(len, ids), pa.int64()), pa.array(wide, pa.binary()), pa.nulls(len(ids), pa.binary())], names)
        yield pa.RecordBatch.from_arrays([pa.nulls(1, pa.int64()), pa.nulls(1, pa.int64()), pa.nulls(1, pa.binary()), pa.array([total.tobytes()], pa.binary())], names)

    written = stored(docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string")).mapInArrow(encode, "doc_id bigint, n bigint, ids binary, counts binary"), "ids")
    encoded = written.where("counts is null").select("doc_id", "ids")

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for raw in b.column(0).to_pylist():
                total = np.frombuffer(raw, np.int64)
                used = np.flatnonzero(total)
                yield pa.RecordBatch.from_arrays([pa.array(used, pa.int64()), pa.array(total[used])], ["id", "n"])

    # at most one row for each id of the vocabulary comes to the driver
    rows = written.where("counts is not null").select("counts").mapInArrow(spread, "id bigint, n bigint").groupBy("id").agg(F.sum("n").alias("n")).toPandas()
    counts = np.zeros(int(rows["id"].max()) + 1 if len(rows) else 1, np.int64)
    counts[rows["id"].to_numpy(np.int64)] = rows["n"].to_numpy(np.int64)
    bits = code_lengths(counts, limit_for(int((counts > 0).sum())))
    used = np.flatnonzero(bits)
    spark.createDataFrame([(int(i), int(bits[i])) for i in used], "id bigint, bits int").coalesce(1).write.parquet(f"{path}/codebook")
    codes = canonical(bits)

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, block, first, held, n = TaskContext.get().partitionId(), 0, 0, [], 0

        def out():
            nonlocal block, first, held, n
            data = encode_block(held, first, bits, codes)
            row = pa.RecordBatch.from_arrays([pa.array([shard], pa.int64()), pa.array([block], pa.int64()), pa.array([first], pa.int64()), pa.array([n], pa.int64()), pa.array([data], pa.binary())], ["shard", "block", "first_token", "n_tokens", "data"])
            block, first, held, n = block + 1, first + n, [], 0
            return row

        for b in batches:
            for i, raw in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                held.append((i, _ids(raw)))
                n += len(held[-1][1])
                if n >= BLOCK_TOKENS:
                    yield out()
        if held:
            yield out()

    parts = max(1, -(-int(counts.sum()) // SHARD_TOKENS))
    ordered = encoded.repartitionByRange(parts, "doc_id").sortWithinPartitions("doc_id", "ids").select("doc_id", "ids")
    ordered.mapInArrow(blocks, "shard bigint, block bigint, first_token bigint, n_tokens bigint, data binary").write.parquet(f"{path}/shards")
    return path


def _ids(raw: bytes) -> np.ndarray:
    return np.frombuffer(raw, "<u4", offset=1) if len(raw) & 1 else np.frombuffer(raw, "<u2").astype("<u4")


def read_tokens(spark: SparkSession, path: str, with_ids: bool = False) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32[, ids]) of every document of a folder that write_tokens wrote."""
    book = spark.read.parquet(f"{path}/codebook").toPandas()
    bits = np.zeros(int(book["id"].max()) + 1 if len(book) else 1, np.uint8)
    bits[book["id"].to_numpy(np.int64)] = book["bits"].to_numpy(np.uint8)
    shards = spark.read.parquet(f"{path}/shards")

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        book = decode_table(bits)
        for b in batches:
            for shard, data in zip(b.column(0).to_pylist(), b.column(1)):
                first, names, lengths, ids = decode_block(data.as_py(), book)
                begins = np.cumsum(lengths) - lengths
                cut = [ids[s : s + k].astype("<u4", copy=False).tobytes() for s, k in zip(begins.tolist(), lengths.tolist())]
                cols = [pa.array([shard] * len(names), pa.int64()), pa.array(names, pa.int64(), mask=names == NULL_ID), pa.array(begins + first), pa.array(lengths), pa.array(map(zlib.crc32, cut), pa.int64())]
                yield pa.RecordBatch.from_arrays(cols + [pa.array(cut, pa.binary())] * with_ids, ["shard", "doc_id", "within", "n_tokens", "ids_crc32"] + ["ids"] * with_ids)

    rows = shards.select("shard", "data").mapInArrow(decode, "shard bigint, doc_id bigint, within bigint, n_tokens bigint, ids_crc32 bigint" + ", ids binary" * with_ids)
    start = (F.col("base") + F.col("within")).alias("start")
    return rows.join(_bases(shards), "shard").select("doc_id", start, "n_tokens", "ids_crc32", *(["ids"] * with_ids))


def _bases(shards: DataFrame) -> DataFrame:
    """(shard, base): the ids of all shards before it, summed in stretches, so that no task sees one row of every shard."""
    n = shards.groupBy("shard").agg(F.sum("n_tokens").alias("n")).withColumn("stretch", F.floor(F.col("shard") / STRETCH))
    before = lambda w: F.coalesce(F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    stretches = n.groupBy("stretch").agg(F.sum("n").alias("n")).select("stretch", before(Window.orderBy("stretch")).alias("first"))
    inside = n.select("shard", "stretch", before(Window.partitionBy("stretch").orderBy("shard")).alias("inside"))
    return inside.join(stretches, "stretch").select("shard", (F.col("first") + F.col("inside")).alias("base"))


def op8_token_files(spark, sf_dir: str) -> DataFrame:
    return read_tokens(spark, write_tokens(spark.read.parquet(f"{sf_dir}/documents.parquet")))
