"""Packing by minimum bin slack: a bitset subset-sum picks the multiset of remaining lengths that fills a sequence best.

One pass without a shuffle: every task packs the documents of its own partition, window by window. A window first gives
the sequences that some multiset fills exactly. What is left waits for the next window as long as it is at most half of
one; beyond that the multiset closest to the capacity is taken, and the slack is filled by the head of a document that
is cut there. So memory is bounded by a window, whatever the lengths, and only a partition's last sequences, whose sizes
are powers of two, are shorter than the capacity.
"""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratalens.llm.tokens import Encoder

CAPACITY, END_ID = 2048, 1
#: A window closes at so many remainders or ids of them; at most half of it waits for the next one.
WINDOW, WINDOW_IDS = 20_000, 1 << 23
SCHEMA = "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint"


def best_fill(counts: dict[int, int], capacity: int) -> tuple[int, dict[int, int]]:
    """(sum, {length: times}) of a multiset from counts whose sum is the largest that capacity holds.

    A bit s of `reach` says that s is a sum of some lengths taken so far; lengths enter largest first, in binary parts of
    their count, until capacity is reached. The way back reads which part first made each sum.
    """
    mask, reach, steps = (1 << (capacity + 1)) - 1, 1, []
    for length in sorted((x for x in counts if x <= capacity and counts[x] > 0), reverse=True):
        left, part = min(counts[length], capacity // length), 1
        while left:
            take = min(part, left)
            steps.append((length, take, reach))
            reach |= (reach << (take * length)) & mask
            left, part = left - take, part * 2
        if reach >> capacity & 1:
            break
    best = s = reach.bit_length() - 1
    used: dict[int, int] = {}
    for length, take, before in reversed(steps):
        if not before >> s & 1:
            used[length] = used.get(length, 0) + take
            s -= take * length
    return best, used


def exact(counts: dict[int, int], capacity: int) -> tuple[list, dict[int, int]]:
    """Fill sequences exactly while it goes: [(lengths of a sequence, how often, None)], and the counts left over.

    Each choice holds the largest length left, so large remainders never pile up, and is repeated while counts last.
    """
    counts, done, over = dict(counts), [], {}
    heap = [-x for x in counts]
    heapq.heapify(heap)
    while heap:
        first = -heap[0]
        if not counts.get(first):
            heapq.heappop(heap)
            continue
        total, used = _with(first, counts, capacity)
        if total != capacity:
            over[first] = counts.pop(first)
            continue
        times = min(counts[x] // n for x, n in used.items())
        for x, n in used.items():
            counts[x] -= n * times
        done.append((_listed(used), times, None))
    return done, over


def closest(counts: dict[int, int], capacity: int, enough) -> tuple[list, dict[int, int]]:
    """Fill sequences as closely as it goes until enough(pieces, ids left): [(lengths, how often, (length cut, slack))].

    A piece that is in no closest fill is longer than the slack, so its head fills it; the tail is a piece again. What
    one sequence holds as a whole is left over.
    """
    counts, done = {x: n for x, n in counts.items() if n}, []
    pieces, ids = sum(counts.values()), sum(x * n for x, n in counts.items())
    while counts and not enough(pieces, ids):
        total, used = _with(max(counts), counts, capacity)
        rest, slack = [x for x in counts if counts[x] > used.get(x, 0)], capacity - total
        if slack and not rest:
            break
        need, cut = dict(used), None
        if slack:
            cut = (max(rest), slack)
            need[cut[0]] = need.get(cut[0], 0) + 1
        times = min(counts[x] // n for x, n in need.items())
        for x, n in need.items():
            counts[x] -= n * times
        if cut:
            counts[cut[0] - slack] = counts.get(cut[0] - slack, 0) + times
        counts = {x: n for x, n in counts.items() if n}
        done.append((_listed(used), times, cut))
        pieces, ids = pieces - sum(used.values()) * times, ids - capacity * times
    return done, counts


def _with(first: int, counts: dict[int, int], capacity: int) -> tuple[int, dict[int, int]]:
    """best_fill() of a sequence that holds the length first."""
    counts[first] -= 1
    total, used = best_fill(counts, capacity - first)
    counts[first] += 1
    used[first] = used.get(first, 0) + 1
    return first + total, used


def _listed(used: dict[int, int]) -> list[int]:
    return [x for x, n in sorted(used.items(), reverse=True) for _ in range(n)]


def powers(n: int) -> list[int]:
    return [1 << b for b in range(n.bit_length() - 1, -1, -1) if n >> b & 1]


class Packer:
    def __init__(self, first_sequence: int, capacity: int = CAPACITY, window: int = WINDOW, window_ids: int = WINDOW_IDS):
        self.capacity, self.window, self.window_ids, self.sequence = capacity, window, window_ids, first_sequence
        self.held: dict[int, list] = {}  # length -> [(doc, start, ids, tokens of the document)]
        self.n_held, self.ids_held, self.rows = 0, 0, []

    def _place(self, doc, start, ids, total, offset):
        self.rows.append((doc, start, len(ids), zlib.crc32(ids.tobytes()), total, self.sequence, offset))

    def add(self, doc, ids: np.ndarray) -> None:
        total = len(ids)
        for start in range(0, total, self.capacity):
            piece = ids[start : start + self.capacity]
            if len(piece) == self.capacity:
                self._place(doc, start, piece, total, 0)
                self.sequence += 1
            else:
                self.held.setdefault(len(piece), []).append((doc, start, piece.copy(), total))
                self.n_held += 1
                self.ids_held += len(piece)
        if self.n_held >= self.window or self.ids_held >= self.window_ids:
            self.fill(lambda pieces, ids: 2 * pieces <= self.window and 2 * ids <= self.window_ids)

    def fill(self, enough) -> None:
        done, left = exact({x: len(v) for x, v in self.held.items()}, self.capacity)
        done += closest(left, self.capacity, enough)[0]
        for lengths, times, cut in done:
            for _ in range(times):
                offset = 0
                for x in lengths:
                    self._place(*self.held[x].pop(), offset)
                    offset += x
                if cut:
                    doc, start, ids, total = self.held[cut[0]].pop()
                    self._place(doc, start, ids[: cut[1]], total, offset)
                    self.held.setdefault(cut[0] - cut[1], []).append((doc, start + cut[1], ids[cut[1] :], total))
                self.sequence += 1
        self.held = {x: v for x, v in self.held.items() if v}
        self.n_held = sum(map(len, self.held.values()))
        self.ids_held = sum(x * len(v) for x, v in self.held.items())

    def finish(self) -> None:
        """Fill all; the last ids, fewer than a sequence holds, are cut to powers of two."""
        self.fill(lambda pieces, ids: False)
        rest, sizes = [p for x in sorted(self.held, reverse=True) for p in self.held[x]], powers(self.ids_held)
        self.held, self.n_held, self.ids_held, at, offset = {}, 0, 0, 0, 0
        for doc, start, ids, total in rest:
            while len(ids):
                take = min(len(ids), sizes[at] - offset)
                self._place(doc, start, ids[:take], total, offset)
                ids, start, offset = ids[take:], start + take, offset + take
                if offset == sizes[at]:
                    at, offset, self.sequence = at + 1, 0, self.sequence + 1

    def take(self) -> pa.RecordBatch:
        rows, self.rows = self.rows, []
        cols = list(zip(*rows)) or [[]] * 7
        names = [x.split()[0] for x in SCHEMA.split(", ")]
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names)


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """Pieces of documents in sequences of at most `capacity` ids (see SCHEMA).

    Each row's ids, with end_id last, lie in exactly one piece each. Null and empty texts are the end id alone; a null
    id stays null; repeated rows are packed as often as they come; columns but the two are not read. No row gives none.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, p = Encoder(tokenizer), Packer(TaskContext.get().partitionId() << 40, capacity)
        end = np.array([end_id], "<u4")
        for b in batches:
            for at in range(0, b.num_rows, 1000):
                part = b.slice(at, 1000)
                for i, ids in zip(part.column(0).to_pylist(), encoder.encode(part.column(1).to_pylist())):
                    p.add(i, np.concatenate([ids, end]))
                yield p.take()
        p.finish()
        yield p.take()

    return docs.select(F.col(id_col).cast("bigint"), F.col(text_col).cast("string")).mapInArrow(run, SCHEMA)


def op7_packing(spark, sf_dir: str) -> DataFrame:
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"))
