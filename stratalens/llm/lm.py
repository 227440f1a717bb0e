"""Language-model scores by deleted interpolation of bigrams, unigrams and a uniform floor.

P(w | u) = L2[b] * c(u, w) / c(u) + L1[b] * c(w) / N + L0[b] / (V + 1), b the bucket of c(u) (its number of binary digits).
The counts come from training documents. The weights of each bucket are learned by expectation-maximisation on the bigrams
of one fold of the training documents, the deleted one, each bigram looked up in the counts of the other training folds.
The held-out documents are scored only: nothing is learned from them.

The vocabulary grows with the corpus, so nothing of it is broadcast. Documents are cut into blocks; a block sends each
distinct n-gram hash once to the bucket that owns it and gets the corpus count back in the same order:
  blocks  (block, part, packed tokens)            -> stored
  asks    (bucket, block, hashes, counts)         -> grouped by bucket, merged  -> replies (block, bucket, counts)
Blocks and replies meet by block. The two passes over them (deleted blocks for the weights, all blocks for the scores)
read the same stored tables; only sums of a fixed size come to the driver.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratalens.llm.common import stored

FOLDS, HELD_OUT_FOLD, DELETED_FOLD = 10, 0, 1
#: The parts of the documents: held out, the deleted training fold, the other training folds. A block is of one part.
HELD_OUT, DELETED, OTHER = range(3)
ADD = 0.1
#: A block closes at so many tokens; so many block tokens go to one bucket of the counting shuffle.
BLOCK_TOKENS, BUCKET_TOKENS = 1 << 20, 1 << 21
CONTEXT_BUCKETS = 64
EM_ROUNDS, EM_TOLERANCE = 40, 1e-7
_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
#: No word holds a line feed.
END = xxhash.xxh3_64_intdigest(b"\n")
_ODD = np.uint64(0x9E3779B97F4A7C15)


def part_of(doc_id) -> int:
    fold = None if doc_id is None else zlib.crc32(str(doc_id).encode()) % FOLDS
    return {HELD_OUT_FOLD: HELD_OUT, DELETED_FOLD: DELETED}.get(fold, OTHER)


def is_held_out(doc_id) -> bool:
    return part_of(doc_id) == HELD_OUT


def bigram_hash(u: np.ndarray, w: np.ndarray) -> np.ndarray:
    x = (u ^ (u >> np.uint64(31))) * _ODD + w
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(27))


class Block:
    """Tokens of some documents as numbers of the block's own vocabulary, each document closed by the end token (0)."""

    def __init__(self):
        self.number, self.ids, self.lengths, self.tokens, self.n = {b"\n": 0}, [], [], [], 0

    def add(self, doc_id, text: str | None) -> None:
        number = self.number
        for w in (words := (text or "").encode("utf-8", "surrogatepass").translate(_LOWER).split()):
            if w not in number:
                number[w] = len(number)
        t = np.fromiter(map(number.__getitem__, words), np.uint32, len(words))
        self.ids.append(doc_id)
        self.lengths.append(len(t) + 1)
        self.tokens += [t, np.zeros(1, np.uint32)]
        self.n += len(t) + 1

    def packed(self):
        vocabulary = np.fromiter(map(xxhash.xxh3_64_intdigest, self.number), np.uint64, len(self.number))
        return np.array(self.lengths, np.int64), np.concatenate(self.tokens), vocabulary


def grams(tokens: np.ndarray, vocabulary: np.ndarray):
    """Contexts, and the distinct bigrams' hashes with each token's place among them. A text begins after an end token."""
    before = np.concatenate([np.zeros(1, np.uint32), tokens[:-1]])
    pair = before.astype(np.uint64) << np.uint64(32) | tokens
    distinct, place = np.unique(pair, return_inverse=True)
    return before, bigram_hash(vocabulary[distinct >> np.uint64(32)], vocabulary[distinct & np.uint64(0xFFFFFFFF)]), place


BLOCKS = "block bigint, part int, n bigint, ids array<bigint>, lengths binary, tokens binary, vocabulary binary"


def _blocks(docs: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_, n = [Block() for _ in range(3)], TaskContext.get().partitionId() << 32

        def out(part):
            nonlocal n
            b, n = open_[part], n + 1
            lengths, tokens, vocabulary = b.packed()
            cols = [pa.array([n - 1], pa.int64()), pa.array([part], pa.int32()), pa.array([b.n], pa.int64()), pa.array([b.ids], pa.list_(pa.int64())), *(pa.array([x.tobytes()], pa.binary()) for x in (lengths, tokens, vocabulary))]
            open_[part] = Block()
            return pa.RecordBatch.from_arrays(cols, [x.split()[0] for x in BLOCKS.split(", ")])

        for batch in batches:
            for i, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                part = part_of(i)
                open_[part].add(i, text)
                if open_[part].n >= BLOCK_TOKENS:
                    yield out(part)
        for part in range(3):
            if open_[part].n:
                yield out(part)

    return docs.mapInArrow(run, BLOCKS)


def _u64(x) -> np.ndarray:
    return np.frombuffer(x.as_py(), np.uint64)


ASKS = "bucket int, block bigint, part int, kind int, hashes binary, counts binary"


def _asks(blocks: DataFrame, buckets: int) -> DataFrame:
    """Each block's distinct unigrams (kind 1) and bigrams (kind 2), sorted by hash, dealt to buckets by hash range."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        edges = np.array([(1 << 64) * i // buckets for i in range(1, buckets)], np.uint64)
        for batch in batches:
            for r in range(batch.num_rows):
                block, part = batch.column(0)[r].as_py(), batch.column(1)[r].as_py()
                tokens, vocabulary = np.frombuffer(batch.column(2)[r].as_py(), np.uint32), _u64(batch.column(3)[r])
                _, two, place = grams(tokens, vocabulary)
                rows = []
                for kind, h, c in ((1, vocabulary, np.bincount(tokens, minlength=len(vocabulary))), (2, two, np.bincount(place, minlength=len(two)))):
                    order = np.argsort(h)
                    h, c = h[order], c[order].astype(np.uint32)
                    cuts = [0, *np.searchsorted(h, edges).tolist(), len(h)]
                    rows += [(i, block, part, kind, h[s:e].tobytes(), b"" if part == HELD_OUT else c[s:e].tobytes()) for i, (s, e) in enumerate(zip(cuts, cuts[1:])) if e > s]
                kinds = (pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], [x.split()[0] for x in ASKS.split(", ")])

    return blocks.select("block", "part", "tokens", "vocabulary").mapInArrow(run, ASKS)


REPLIES = "block bigint, part int, kind int, bucket int, counts binary, others binary, sizes array<bigint>"


def _answer(asked: pa.Table) -> pa.Table:
    """One bucket: merge the training counts of every hash; answer each block in its own order.

    Blocks of the deleted fold also get the counts of the other training folds. One reply of a bucket has its sizes:
    tokens and distinct ones in training, and both without the deleted fold.
    """
    out, bucket = [], asked.column("bucket")[0].as_py()
    kinds = np.array(asked.column("kind").to_pylist())
    for kind in (1, 2):
        rows = np.flatnonzero(kinds == kind).tolist()
        if not rows:
            continue
        part = [asked.column("part")[i].as_py() for i in rows]
        h = [_u64(asked.column("hashes")[i]) for i in rows]
        c = [np.zeros(len(x), np.uint32) if p == HELD_OUT else np.frombuffer(asked.column("counts")[i].as_py(), np.uint32) for i, x, p in zip(rows, h, part)]
        every, counts = np.concatenate(h), np.concatenate(c).astype(np.int64)
        other = np.where(np.repeat(np.array(part) == OTHER, [len(x) for x in h]), counts, 0)
        order = np.argsort(every, kind="stable")
        new = np.concatenate([[True], np.diff(every[order]) > 0])
        first, place = np.flatnonzero(new), np.empty(len(every), np.int64)
        place[order] = np.cumsum(new) - 1
        total, others = np.add.reduceat(counts[order], first), np.add.reduceat(other[order], first)
        sizes, at = [int(x) for t in (total, others) for x in (t.sum(), (t > 0).sum())] if kind == 1 else None, 0
        for i, p, x in zip(rows, part, h):
            mine, at = place[at : at + len(x)], at + len(x)
            out.append((asked.column("block")[i].as_py(), p, kind, bucket, total[mine].tobytes(), others[mine].tobytes() if p == DELETED else None, sizes))
            sizes = None
    types = (pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.list_(pa.int64()))
    return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], [x.split()[0] for x in REPLIES.split(", ")])


def _counted(block: pa.Table, replies: pa.Table, column: str):
    """(c(w), c(u), c(u, w)) for the tokens of one block, from its replies."""
    tokens, vocabulary = np.frombuffer(block.column("tokens")[0].as_py(), np.uint32), _u64(block.column("vocabulary")[0])
    before, two, place = grams(tokens, vocabulary)
    got = []
    kinds, buckets = np.array(replies.column("kind").to_pylist()), np.array(replies.column("bucket").to_pylist())
    for kind, h in ((1, vocabulary), (2, two)):
        rows = np.flatnonzero(kinds == kind)
        rows = rows[np.argsort(buckets[rows])]
        flat = np.concatenate([np.frombuffer(replies.column(column)[int(i)].as_py(), np.int64) for i in rows])
        back = np.empty(len(h), np.int64)
        back[np.argsort(h)] = flat
        got.append(back)
    one, two = got
    return one[tokens], one[before], two[place]


def context_bucket(c: np.ndarray) -> np.ndarray:
    """0 for an unseen context, else the binary digits of its count."""
    return np.minimum(np.frexp(c.astype(np.float64))[1], CONTEXT_BUCKETS - 1)


def estimates(cw, cu, cuw, n: int, v: int):
    """Maximum-likelihood bigram and unigram and the uniform floor; an empty model has the floor only."""
    return cuw / np.maximum(cu, 1), cw / max(n, 1), 1.0 / (v + 1)


def em_step(lam: np.ndarray, bucket, p2, p1, p0, times) -> np.ndarray:
    """Expected uses of (bigram, unigram, floor) in each bucket, and the log likelihood as the last row."""
    parts = np.stack([lam[bucket, 0] * p2, lam[bucket, 1] * p1, lam[bucket, 2] * p0])
    total = parts.sum(0)
    uses = np.zeros((CONTEXT_BUCKETS + 1, 3))
    for k in range(3):
        uses[:-1, k] = np.bincount(bucket, parts[k] / total * times, CONTEXT_BUCKETS)
    uses[-1, 0] = (np.log(total) * times).sum()
    return uses


def start_weights() -> np.ndarray:
    lam = np.tile([0.4, 0.4, 0.2], (CONTEXT_BUCKETS, 1))
    lam[0] = [0.0, 0.7, 0.3]
    return lam


def next_weights(lam: np.ndarray, uses: np.ndarray) -> np.ndarray:
    """Buckets without tokens keep their weights; the floor keeps a little, so no probability is ever 0."""
    total = uses[:-1].sum(1, keepdims=True)
    new = np.where(total > 0, uses[:-1] / np.maximum(total, 1e-300), lam)
    new[:, 2] = np.maximum(new[:, 2], 1e-6)
    return new / new.sum(1, keepdims=True)


SCORES = "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double"


def score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, np.ndarray]:
    """(scores (see SCORES), weights by context bucket).

    Null and blank texts are the end token alone. A null id is of the other training folds. Rows that repeat an id count
    as often as they come. With no training document every count is 0 and only the floors speak; with no document in the
    deleted fold the start weights stay. An empty table gives an empty result. Other columns are not read. A document is
    never cut: a block closes after the one that fills it, so a very long text is a block of its own, held whole.
    """
    d = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    blocks = stored(_blocks(d), "lm-blocks")
    tokens, n_blocks = blocks.agg(F.sum("n"), F.count("n")).first()
    buckets = max(1, -(-(tokens or 0) // BUCKET_TOKENS))
    asks = _asks(blocks, buckets).repartitionById(buckets, F.col("bucket"))  # a bucket is a task
    replies = stored(asks.groupBy("bucket").applyInArrow(_answer, REPLIES), "lm-replies")
    n, v, n_other, v_other = (x or 0 for x in replies.agg(*(F.sum(F.get("sizes", F.lit(i))) for i in range(4))).first())

    def met(which, f, schema, column):
        """f for every block of a part with its replies; as many tasks as blocks, so their size is a block's."""
        b = blocks.where(which).repartition(max(1, n_blocks), "block")
        r = replies.where(which).select("block", "kind", "bucket", column).repartition(max(1, n_blocks), "block")
        return b.groupBy("block").cogroup(r.groupBy("block")).applyInArrow(f, schema)

    def events(block: pa.Table, answers: pa.Table) -> pa.Table:
        rows, times = np.unique(np.stack(_counted(block, answers, "others"), 1), axis=0, return_counts=True)
        return pa.table({"cw": rows[:, 0], "cu": rows[:, 1], "cuw": rows[:, 2], "times": times.astype(np.int64)})

    seen = met(F.col("part") == DELETED, events, "cw bigint, cu bigint, cuw bigint, times bigint", "others")
    seen = stored(seen.groupBy("cw", "cu", "cuw").agg(F.sum("times").alias("times")), "lm-events")
    lam = learned(lambda lam: _expect(seen, lam, n_other, v_other))

    def scores(block: pa.Table, answers: pa.Table) -> pa.Table:
        cw, cu, cuw = _counted(block, answers, "counts")
        ids, lengths = block.column("ids")[0].as_py(), np.frombuffer(block.column("lengths")[0].as_py(), np.int64)
        p2, p1, p0 = estimates(cw, cu, cuw, n, v)
        at = context_bucket(cu)
        p = lam[at, 0] * p2 + lam[at, 1] * p1 + lam[at, 2] * p0
        firsts = np.cumsum(lengths) - lengths
        base = np.log10((cw + ADD) / (n + ADD * (v + 1)))
        held = block.column("part")[0].as_py() == HELD_OUT
        return pa.table({
            "doc_id": pa.array(ids, pa.int64()), "held_out": pa.array([held] * len(ids)), "n_tokens": lengths, "n_known": np.add.reduceat((cw > 0).astype(np.int64), firsts),
            "train_tokens": np.full(len(ids), n, np.int64), "base_score": np.add.reduceat(base, firsts), "score": np.add.reduceat(np.log10(p), firsts)})

    return met(F.lit(True), scores, SCORES, "counts"), lam


def learned(expect) -> np.ndarray:
    """The weights after expectation-maximisation; expect gives the expected uses under some weights."""
    lam, last = start_weights(), None
    for _ in range(EM_ROUNDS):
        uses = expect(lam)
        lam = next_weights(lam, uses)
        if last is not None and abs(uses[-1, 0] - last) <= EM_TOLERANCE * abs(last):
            break
        last = uses[-1, 0]
    return lam


def _expect(seen: DataFrame, lam: np.ndarray, n: int, v: int) -> np.ndarray:
    """One expectation step over the events of the deleted fold: every task sends one table of a fixed size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((CONTEXT_BUCKETS + 1, 3))
        for b in batches:
            cw, cu, cuw, times = (b.column(k).to_numpy() for k in range(4))
            total += em_step(lam, context_bucket(cu), *estimates(cw, cu, cuw, n, v), times)
        flat = total.reshape(-1)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(flat))), pa.array(flat)], ["place", "value"])

    got = seen.mapInArrow(run, "place bigint, value double").groupBy("place").agg(F.sum("value").alias("value")).collect()
    out = np.zeros((CONTEXT_BUCKETS + 1) * 3)
    for r in got:
        out[r["place"]] = r["value"]
    return out.reshape(-1, 3)


def op10_lm_scores(spark, sf_dir: str) -> DataFrame:
    return score(spark.read.parquet(f"{sf_dir}/documents.parquet"))[0]
